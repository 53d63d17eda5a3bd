"""Rating life, loads, defect frequencies and expected curves, as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def l10_hours(c, p, rpm, exponent=3.0) -> Column:
    """Hours that 90 % of bearings reach; an error where load or speed isn't positive."""
    c, p, rpm, e = map(_c, (c, p, rpm, exponent))
    hours = F.lit(1e6) / (F.lit(60.0) * rpm) * F.pow(c / p, e)
    return F.when((p <= 0) | (rpm <= 0), F.raise_error(F.lit("load and speed must be positive")).cast("double")).otherwise(hours)


def bearing_load_kn(hp, rpm, rotor_kg=2.0) -> Column:
    """Half the rotor's weight, and 5 % of the shaft's torque."""
    hp, rpm, kg = map(_c, (hp, rpm, rotor_kg))
    omega = F.lit(2 * math.pi) * rpm / F.lit(60.0)
    torque = F.when(omega > 0, hp * F.lit(745.7) / omega).otherwise(F.lit(0.0))
    return (kg * F.lit(9.81) * F.lit(0.5) + F.lit(0.05) * torque) / F.lit(1000.0)


#: Rolling elements, their diameter, pitch diameter and contact angle in degrees.
GEOMETRIES = {"ims": (16, 0.331, 2.815, 15.17), "xjtu_sy": (8, 7.92, 34.55, 0.0)}


def defect_frequencies(rpm, n, d, pitch, angle=0.0) -> dict[str, Column]:
    """Outer race, inner race, rolling element and cage."""
    rpm, n, d, pitch, angle = map(_c, (rpm, n, d, pitch, angle))
    f, r = rpm / F.lit(60.0), d / pitch * F.cos(F.radians(angle))
    half = F.lit(0.5)
    return {"bpfo": n * half * (1 - r) * f, "bpfi": n * half * (1 + r) * f, "bsf": pitch / (2 * d) * (1 - r * r) * f, "ftf": half * (1 - r) * f}


def place(t="t", n="n") -> Column:
    """t on an even scale from 0 to 1 (0 for a single row)."""
    t, n = _c(t), _c(n)
    return F.when(n > 1, t.cast("double") / (n - 1)).otherwise(F.lit(0.0))


def baseline(t="t", n="n", shape: str = "exponential") -> Column:
    u = place(t, n)
    if shape == "linear":
        return u
    if shape == "exponential":
        return (F.exp(3.0 * u) - 1) / F.lit(math.exp(3.0) - 1)
    raise ValueError(f"no such shape: {shape}")


def time_axis_hours(hours, t="t", n="n") -> Column:
    return _c(hours) * place(t, n)


def linear_fade(t="t", loss: float = 0.2, cycles: float = 500.0) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.lit(loss) * _c(t).cast("double") / cycles))


def aligned(curve="baseline_curve", t="t") -> Column:
    """The curve's value at t; its last value behind its end."""
    c, t = _c(curve), _c(t)
    return F.element_at(c, F.least(t + 1, F.size(c)).cast("int"))
