"""Feedback controllers and regime detectors over many units at once.

Arrays are units x time, padded behind each unit's length n; all units advance together, one step of time a pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class PIDParams:
    kp: float = 0.08
    ki: float = 0.02
    kd: float = 0.03
    integral_window: int = 10
    clip: float = 0.05


def clip(x, low, high):
    """NaN becomes high."""
    return np.where(np.isnan(x), high, np.maximum(low, np.minimum(high, x)))


def _life(threshold, level, rate, default):
    """Steps until the level reaches the threshold at this rate; default where it doesn't rise."""
    with np.errstate(divide="ignore", invalid="ignore"):
        steps = np.maximum(0, (threshold - level) / rate)
    return np.where(rate > 1e-8, steps, default)


def pid(observed: np.ndarray, baseline: np.ndarray, n: np.ndarray, threshold: np.ndarray, params: PIDParams = PIDParams()) -> dict[str, np.ndarray]:
    return _run(observed, baseline, n, threshold, params, None)


def pid_regime(observed, baseline, n, threshold, params: PIDParams = PIDParams(), vol_window: int = 15, vol_threshold: float = 2.0, gain: float = 2.5) -> dict[str, np.ndarray]:
    """As pid, with 30 % of the extra gain on P, I and clip while the volatility exceeds its calibrated level."""
    return _run(observed, baseline, n, threshold, params, (vol_window, vol_threshold, 1 + (gain - 1) * 0.3))


def _run(o, b, n, threshold, p, regime):
    units, steps = o.shape
    out = {k: np.full((units, steps), np.nan) for k in ("adjusted", "error", "p_term", "i_term", "d_term", "correction", "cumulative", "predicted_rul", "volatility")}
    fast = np.zeros((units, steps), bool)
    errors, adjusted = out["error"], out["adjusted"]
    total, state = np.zeros(units), np.zeros(units, bool)
    usual = np.full(units, np.nan)
    calibrated = np.maximum(regime[0] + 5, n // 4) if regime else n
    for t in range(steps):
        adjusted[:, t] = level = b[:, t] + total
        errors[:, t] = e = o[:, t] - level
        if regime and t >= regime[0] - 1:
            out["volatility"][:, t] = vol = errors[:, t - regime[0] + 1 : t + 1].std(axis=1)
            for u in np.flatnonzero((calibrated == t) & (calibrated > regime[0] - 1)):
                usual[u] = max(np.median(out["volatility"][u, regime[0] - 1 : t]), 1e-8)
            state = np.where(np.isnan(usual), state, vol > regime[1] * usual)
        fast[:, t] = state
        g = np.where(state, regime[2], 1.0) if regime else np.ones(units)
        pt = p.kp * g * e
        it = p.ki * g * errors[:, max(0, t + 1 - p.integral_window) : t + 1].mean(axis=1)
        dt = p.kd * (e - errors[:, t - 1]) if t else np.zeros(units)
        step = clip(pt + it + dt, -p.clip * g, p.clip * g)
        total = total + step
        for k, v in (("p_term", pt), ("i_term", it), ("d_term", dt), ("correction", step), ("cumulative", total)):
            out[k][:, t] = v
        if t >= (5 if regime else 2):
            back = np.where(state, min(t, 3), min(t, 8)) if regime else np.full(units, min(t, 5))
            past = adjusted[np.arange(units), np.maximum(0, t - (back if regime else 5))]
            out["predicted_rul"][:, t] = _life(threshold, level + step, (level + total - past) / back, n - t)
    out["accelerated"] = fast
    return out


class StepState:
    """What the streaming controller keeps of a unit: sums and short rings, whatever the length of its history."""

    def __init__(self, cumulative=0.0, errors=(), previous=0.0, accelerated=False, volatilities=(), usual=None, steps=0, seen=0):
        self.cumulative, self.errors, self.previous, self.accelerated = cumulative, list(errors), previous, accelerated
        self.volatilities, self.usual, self.steps, self.seen = list(volatilities), usual, steps, seen

    def pack(self) -> tuple:
        return float(self.cumulative), [float(x) for x in self.errors], float(self.previous), bool(self.accelerated), [float(x) for x in self.volatilities], None if self.usual is None else float(self.usual), int(self.steps), int(self.seen)


def pid_step(observed: float, baseline: float, s: StepState, p: PIDParams = PIDParams(), threshold: float = 1.0, vol_window: int = 15, vol_threshold: float = 2.0, gain: float = 2.5) -> tuple[float, float]:
    """One reading: (adjusted baseline after the correction, remaining life). Until the usual volatility is known (5 readings of it) no regime is tested."""
    error = observed - (baseline + s.cumulative)
    s.errors = [*s.errors, error][-max(vol_window, p.integral_window, 5) :]
    s.seen += 1
    g = 1.0
    if s.seen >= vol_window:
        vol = float(np.std(s.errors[-vol_window:]))
        if s.usual is None:
            s.volatilities.append(vol)
            if len(s.volatilities) >= 5:
                s.usual, s.volatilities = max(float(np.median(s.volatilities)), 1e-8), []
        s.steps += 1
        if s.usual is not None and s.steps >= 5 and (vol > vol_threshold * s.usual) != s.accelerated:
            s.accelerated, s.steps = not s.accelerated, 0
        g = gain if s.accelerated else 1.0
    raw = p.kp * g * error + p.ki * g * float(np.mean(s.errors[-p.integral_window :])) + p.kd * g * (error - s.previous)
    s.cumulative += max(-p.clip * g, min(p.clip * g, raw))
    s.previous = error
    rate = (s.errors[-1] - s.errors[-5]) / 4 if s.seen >= 5 else 0.0
    return baseline + s.cumulative, max(0.0, (threshold - observed) / rate) if rate > 1e-8 else float("inf")


def pid_steps(o: np.ndarray, b: np.ndarray, threshold: np.ndarray, p: PIDParams = PIDParams(), vol_window: int = 15, vol_threshold: float = 2.0, gain: float = 2.5) -> dict[str, np.ndarray]:
    """pid_step over units x time: all units take their t-th reading at once. The usual volatility is the median of the first 5."""
    units, steps = o.shape
    errors, vols = np.full((units, steps), np.nan), np.full((units, steps), np.nan)
    adjusted, life, fast = np.empty((units, steps)), np.empty((units, steps)), np.zeros((units, steps), bool)
    total, previous, usual = np.zeros(units), np.zeros(units), np.full(units, np.nan)
    state, since = np.zeros(units, bool), np.zeros(units, np.int64)
    known = vol_window + 3
    for t in range(steps):
        errors[:, t] = e = o[:, t] - (b[:, t] + total)
        if t >= vol_window - 1:
            vols[:, t] = errors[:, t - vol_window + 1 : t + 1].std(axis=1)
            since += 1
            if t == known:
                usual = np.maximum(np.median(vols[:, vol_window - 1 : t + 1], axis=1), 1e-8)
            if t >= known:
                flip = (since >= 5) & ((vols[:, t] > vol_threshold * usual) != state)
                state, since = state ^ flip, np.where(flip, 0, since)
        g = np.where(state, gain, 1.0)
        raw = p.kp * g * e + p.ki * g * errors[:, max(0, t + 1 - p.integral_window) : t + 1].mean(axis=1) + p.kd * g * (e - previous)
        total, previous = total + clip(raw, -p.clip * g, p.clip * g), e
        rate = (e - errors[:, t - 4]) / 4 if t >= 4 else np.zeros(units)
        with np.errstate(divide="ignore", invalid="ignore"):
            life[:, t] = np.where(rate > 1e-8, np.fmax(0.0, (threshold[:, t] - o[:, t]) / rate), np.inf)
        adjusted[:, t], fast[:, t] = b[:, t] + total, state
    return {"adjusted": adjusted, "predicted_rul": life, "accelerated": fast}


def regimes(errors: np.ndarray, n: np.ndarray, vol_window: int = 15, multiplier: float = 2.0, least: int = 5) -> dict[str, np.ndarray]:
    """Volatility, state and switches by a slowly learnt level and a debounce."""
    units, steps = errors.shape
    vols = np.full((units, steps), np.nan)
    state, changed = np.zeros((units, steps), bool), np.zeros((units, steps), bool)
    now, count, usual = np.zeros(units, bool), np.zeros(units, np.int64), np.zeros(units)
    for t in range(steps):
        if t >= vol_window - 1:
            vols[:, t] = vol = errors[:, t - vol_window + 1 : t + 1].std(axis=1)
            usual = np.maximum(vol, 1e-8) if t == vol_window - 1 else np.where(now, usual, 0.95 * usual + 0.05 * vol)
            count += 1
            flip = (count >= least) & ((vol > multiplier * usual) != now)
            now, count = now ^ flip, np.where(flip, 0, count)
            changed[:, t] = flip
        state[:, t] = now
    return {"volatility": vols, "accelerated": state, "changed": changed}
