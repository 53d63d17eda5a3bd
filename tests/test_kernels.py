"""Kernels against plain scalar versions and the properties that the models promise."""

import math
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wearcurve.kernels import bores, chunking, fit, mat, ratings, spectra, trackers


def scalar_pid(o, b, thr, regime=False):
    """One unit, one step at a time, with whole histories."""
    n, total, errors, adjusted, vols, usual, fast, out = len(o), 0.0, [], [], [], None, False, []
    for t in range(n):
        level = b[t] + total
        e = o[t] - level
        errors.append(e)
        adjusted.append(level)
        if regime and t >= 14:
            vol = float(np.std(errors[-15:]))
            if t < max(20, n // 4):
                vols.append(vol)
            elif usual is None:
                usual = max(float(np.median(vols)), 1e-8)
            if usual is not None:
                fast = vol > 2 * usual
        g = 1.45 if fast else 1.0
        raw = 0.08 * g * e + 0.02 * g * float(np.mean(errors[-10:])) + (0.03 * (e - errors[-2]) if t else 0.0)
        step = max(-0.05 * g, min(0.05 * g, raw))
        total += step
        rul = math.nan
        if t >= (5 if regime else 2):
            back = (min(t, 3) if fast else min(t, 8)) if regime else min(t, 5)
            rate = (level + total - adjusted[max(0, t - (back if regime else 5))]) / back
            rul = max(0.0, (thr - (level + step)) / rate) if rate > 1e-8 else n - t
        out.append((level, step, total, e, rul, fast))
    return out


@pytest.mark.parametrize("regime", [False, True])
def test_controllers_equal_scalar_versions(regime):
    rng = np.random.default_rng(1)
    lengths = [1, 2, 5, 14, 20, 21, 60, 200]
    o = np.full((len(lengths), 200), np.nan)
    b = np.full_like(o, np.nan)
    for u, n in enumerate(lengths):
        o[u, :n] = np.cumsum(rng.normal(0.01, 0.05 + 0.2 * (np.arange(n) > n * 0.7), n))
        b[u, :n] = np.linspace(0, 1, n)
    got = (trackers.pid_regime if regime else trackers.pid)(o, b, np.array(lengths), np.ones(len(lengths)))
    for u, n in enumerate(lengths):
        want = scalar_pid(o[u, :n], b[u, :n], 1.0, regime)
        for t in range(n):
            mine = [got[k][u, t] for k in ("adjusted", "correction", "cumulative", "error", "predicted_rul")]
            assert np.allclose(mine, want[t][:5], rtol=1e-9, atol=1e-12, equal_nan=True)
            assert bool(got["accelerated"][u, t]) == want[t][5]


def one(f, o, b):
    return f(np.array([o]), np.array([b]), np.array([len(o)]), np.ones(1))


def test_controller_properties():
    x = np.linspace(0, 1, 100)
    assert np.allclose(one(trackers.pid, x, x)["correction"], 0, atol=0.01)
    b = np.linspace(0, 1, 200)
    assert abs(one(trackers.pid, b + 0.1, b)["adjusted"][0, -1] - (b[-1] + 0.1)) < 0.05
    assert trackers.clip(np.array([math.nan]), -1.0, 2.0)[0] == 2.0


def test_step_controller():
    s = trackers.StepState()
    adjusted, rul = trackers.pid_step(0.5, 0.4, s)
    assert adjusted != 0.4 and rul == math.inf and s.seen == 1
    rng = np.random.default_rng(2)
    for k in range(400):  # past the 15th reading, with state that doesn't grow
        trackers.pid_step(float(rng.normal(0, 0.1 if k < 200 else 2.0)), 0.0, s)
    assert len(s.errors) == 15 and s.usual is not None and not s.volatilities and s.accelerated


def test_regime_detector():
    rng = np.random.default_rng(42)
    e = np.concatenate([rng.normal(0, 0.1, 50), rng.normal(0, 1, 50)])
    got = trackers.regimes(e[None, :], np.array([100]), 10)
    assert got["changed"].any() and got["accelerated"][0, -1]
    assert np.isnan(got["volatility"][0, :9]).all() and not np.isnan(got["volatility"][0, 9])


@settings(max_examples=40, deadline=None)
@given(st.floats(0.05, 3), st.floats(0.1, 8))
def test_fit_finds_exact_curves(a, b):
    t = np.linspace(0, 1, 60)
    fa, fb = fit.fit(t, fit.curve(t, a, b))
    assert np.allclose(fit.curve(t, fa, fb), fit.curve(t, a, b), rtol=1e-3, atol=1e-3)


def test_fit_models():
    y = np.concatenate([np.zeros(30), np.linspace(0, 1, 30)])
    fitted, life, a, b = fit.static(y, None, 0.5)
    assert (np.diff(life) <= 0).all() and life[-1] in (0, 1) and (np.diff(fitted) >= 0).all()
    # the refined fit is never worse than the grid's
    z = fit.normalised(y)[0]
    t = np.arange(60) / 60
    worse = fit.fit_grid(t, z)
    assert ((fit.curve(t, a, b) - z) ** 2).sum() <= ((fit.curve(t, *worse) - z) ** 2).sum() + 1e-9
    assert fit.normalised(np.ones(5))[1:] == (1.0, 2.0)
    _, life, refit = fit.rolling(np.linspace(0, 1, 40), 50, 10, 1.0)
    assert not refit.any() and life.tolist() == list(range(40, 0, -1))
    _, _, refit = fit.rolling(np.linspace(0, 1, 95), 50, 10, 1.0)
    assert np.flatnonzero(refit).tolist() == [50, 60, 70, 80, 90]


def test_band_energies():
    sr, n = 256.0, 256
    t = np.arange(n) / sr
    x = np.sin(2 * np.pi * 20 * t)[None, :]
    e = spectra.band_energies(x, sr, np.array([20.0, 50.0, 10.0]), 1.0)
    assert np.isclose(e[0, 0], 0.25) and np.isclose(e[0, 1], 0, atol=1e-12) and np.isclose(spectra.total_energy(x)[0], 0.25)
    assert np.isclose(spectra.band_energies(x, sr, np.array([10.0]), 1.0, 3, False)[0, 0], 0.25 * n * n)


def test_chunks_of_prose():
    assert chunking.prose("") == [] and chunking.prose("short text") == ["short text"]
    chunks = chunking.prose("word " * 500, 200)
    assert len(chunks) >= 2 and all(len(c.split()) <= 500 for c in chunks)
    text = "1.1 First\n" + "alpha beta. " * 60 + "\n2.1 Second\n" + "gamma delta. " * 60
    a, b = chunking.prose(text)
    assert a.startswith("1.1 First") and "2.1 Second" in b and b.startswith("alpha beta. alpha beta.")
    assert chunking.split_long("a b\n\nc d\n\ne f", 3) == ["a b", "c d", "e f"] and chunking.split_long("a b\n\nc d\n\ne f g", 4) == ["a b\n\nc d", "e f g"]


def test_chunks_of_tables():
    rows = "\n".join(["d D B C C0", *[f"{k} 52 15 14.8 7.8" for k in range(30)]])
    chunks = chunking.table(rows, 15)
    assert len(chunks) == 2 and all(c.startswith("d D B C C0") for c in chunks)
    block = "\n".join(f"line {k} of a block" for k in range(6))
    assert chunking.table(f"{block}\n\n{block}") == [block, block]
    assert chunking.table("only") == ["only"] and chunking.table(" \n ") == []
    small = "one\n\n" + block
    assert chunking.blocks(small) == ["one\n" + block]
    assert chunking.chunk_page("few words", "mixed") == ["few words"]


def test_ratings():
    tall = "Principal dimensions\n52\n15\n14,8\n7,8\n0,335\n28 000\n18 000\n0,13\n* 6205"
    assert ratings.from_table(tall, "6205", "SKF") == {"c_kn": 14.8, "c0_kn": 7.8, "bore_mm": 25.0}
    assert ratings.from_table("6205 25 52 15 14.8 7.8 0.335 28000", "6205", "SKF")["c_kn"] > 0
    pounds = ratings.from_table("ZA-2115\n5115\n20,300\n26,200", "ZA-2115", "Rexnord")
    assert pounds == {"c_kn": 90.3, "c0_kn": 116.54}
    assert ratings.from_table("UCF204 20 12.0 6.65 86", "UER204", "LDK")["c_kn"] in (12.0, 20.0)
    assert ratings.from_table("nothing here", "6205", "SKF") == {}
    assert ratings.from_prose("Its basic dynamic load rating is 14.8 kN and the static load rating: 7.8") == {"c_kn": 14.8, "c0_kn": 7.8}
    assert ratings.from_prose("C = 9000 kN") == {}


def test_bores():
    assert [bores.bore_of(x) for x in ("6205", "6204", "UER204", "ZA-2115", "6200", "6203", "x")] == [25.0, 20.0, 20.0, 49.2, 10.0, 17.0, None]
    assert bores.is_plausible(25, 14.8, "ball") and not bores.is_plausible(25, 200, "ball") and not bores.is_plausible(1, 5, "roller")


def element(kind, data):
    return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def numeric(name, values):
    v = np.asarray(values, "<f8")
    shape = v.shape if v.ndim == 2 else (len(v), 1)
    return element(14, element(6, struct.pack("<II", 6, 0)) + element(5, struct.pack("<ii", *shape)) + element(1, name.encode()) + element(9, v.tobytes(order="F")))


def structure(name, fields):
    head = element(6, struct.pack("<II", 2, 0)) + element(5, struct.pack("<ii", 1, 1)) + element(1, name.encode())
    names = b"".join(k.encode().ljust(32, b"\0") for k in fields)
    return element(14, head + struct.pack("<HHi", 5, 4, 32) + element(1, names) + b"".join(numeric("", v) for v in fields.values()))


def mat_file(*parts):
    return b"MATLAB 5.0 MAT-file".ljust(128, b" ") + b"".join(parts)


def test_mat_files():
    rng = random.Random(1)
    x = [rng.random() for _ in range(50)]
    packed = zlib.compress(numeric("X097_DE_time", x))
    found = mat.variables(mat_file(struct.pack("<II", 15, len(packed)) + packed, numeric("m", [[1.0, 2.0], [3.0, 4.0]])))
    assert np.allclose(found["X097_DE_time"].ravel(), x) and found["m"].tolist() == [[1.0, 2.0], [3.0, 4.0]]
    cells = mat.capacities(mat_file(structure("Cell1", {"other": [1.0] * 3, "capacity": x}), numeric("Cell2", x[:20])))
    assert np.allclose(cells["Cell1"], x) and len(cells["Cell2"]) == 20


def test_groups_of_digits_end_at_a_word():
    from wearcurve.kernels import ratings

    assert ratings.METRIC_GROUPED.cells("28 000") == [28000.0] and ratings.METRIC_GROUPED.cells("28 000,5 14,8") == [28000.5, 14.8]
    assert ratings.METRIC_GROUPED.cells("1 0005") == [1.0, 5.0]
    assert ratings.IMPERIAL.cells("20,300 26,200.5 1,2345") == [20300.0, 26200.5, 1.0, 2345.0]
