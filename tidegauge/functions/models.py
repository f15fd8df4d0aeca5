"""Model types: fit the longest prefix of a run of ticks within an error bound.

`fit(values, si_ms, eps)` gets a float32 matrix (ticks x members) and returns a `Fit`. `eps` is a
percentage of each real value. A user-defined model type is any object with `mtid`, `fit` and
`decode(payload, count)`; pass it to `compress(models=...)` and to the reading functions. A model
type may also have `quick(values, si_ms, eps)`: computed once per run of one series, it returns the fit
of a start tick where what is known of the run is enough for it, else None.
"""

from typing import NamedTuple

import numpy as np

from tidegauge import schema
from tidegauge.functions import xor


class Fit(NamedTuple):
    length: int
    size: float  # bytes; NaN = the model cannot be used
    a: float = 0.0
    b: float = 0.0
    payload: bytes | None = None


_QUICK_TICKS = 32  # shorter runs do not repay the preparation
# Fixed value: the divisor that turns an error bound in percent into the slack of a line, a little below the bound.
SLACK = 100.1
NO_FIT = Fit(0, float("nan"))


def percentage_error(approx: np.ndarray, real: np.ndarray) -> np.ndarray:
    approx, real = np.asarray(approx, dtype=np.float64), np.asarray(real, dtype=np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        err = np.abs((real - approx) / real) * 100.0
    return np.where(approx == real, 0.0, err)


def _outside(approx: np.ndarray, real: np.ndarray, eps: float) -> np.ndarray:
    """percentage_error > eps; 0/0 is NaN and so inside. Division warnings are off in segment_run."""
    return np.abs((real - approx) / real) * 100.0 > eps


def _blocks(n: int, first: int = 64):
    """Growing blocks, so that a short fit does not scan a long run."""
    at = 0
    while at < n:
        yield at, min(n, at + first)
        at, first = at + first, first * 4


class Constant:
    """PMC-Mean (Lazaridis and Mehrotra, ICDE 2003): one float while it suits the extremes."""

    mtid = schema.CONSTANT

    def fit(self, values, si_ms, eps):
        n, width = values.shape
        total, low, high, mean, length = 0.0, np.inf, -np.inf, None, 0
        for at, end in _blocks(n):
            part = values[at:end].astype(np.float64)
            sums = np.cumsum(np.concatenate(([total], part.ravel())))[width::width]
            lows = np.minimum(np.minimum.accumulate(part.min(axis=1)), low)
            highs = np.maximum(np.maximum.accumulate(part.max(axis=1)), high)
            means = (sums / (np.arange(at + 1, end + 1) * width)).astype(np.float32)
            bad = _outside(means, lows, eps) | _outside(means, highs, eps)
            kept = int(bad.argmax()) if bad.any() else end - at
            if kept:
                mean, length = means[kept - 1], at + kept
            if kept < end - at:
                break
            total, low, high = sums[-1], lows[-1], highs[-1]
        return Fit(length, 4.0, 0.0, float(mean)) if length else NO_FIT

    def quick(self, values, si_ms, eps):
        x = values[:, 0].astype(np.float64)
        means = ((x[:-1] + x[1:]) / 2).astype(np.float32).astype(np.float64)
        alone = _outside(means, x[:-1], eps) | _outside(means, x[1:], eps)
        return lambda at: Fit(1, 4.0, 0.0, float(x[at])) if at < len(alone) and alone[at] else None


class Linear:
    """Swing filter (Elmeleegy et al., VLDB 2009): a line from the first tick between two bounds."""

    mtid = schema.LINEAR

    def fit(self, values, si_ms, eps):
        n, width = values.shape
        first = values[0].astype(np.float64)
        start = float(np.float32(first.sum() / width))
        if width > 1 and _outside(start, first, eps).any():
            return NO_FIT
        upper, lower, length, slope = np.inf, -np.inf, 1, 0.0
        for at, end in _blocks(n - 1):
            x = values[1 + at:1 + end].ravel().astype(np.float64)
            dt = np.repeat(np.arange(1 + at, 1 + end, dtype=np.float64) * si_ms, width)
            slack = np.abs(x * (eps / SLACK))
            uppers = np.minimum.accumulate(np.concatenate(([upper], (x + slack - start) / dt)))
            lowers = np.maximum.accumulate(np.concatenate(([lower], (x - slack - start) / dt)))
            bad = (x - slack > start + uppers[:-1] * dt) | (x + slack < start + lowers[:-1] * dt)
            if at == 0:
                bad[0] = False
            kept = int(bad.argmax()) // width if bad.any() else end - at
            upper, lower = uppers[kept * width], lowers[kept * width]
            length += kept
            if kept < end - at:
                break
        if length < 2:
            return Fit(length, float("nan"))
        slope = (upper + lower) / 2.0
        approx = (start + slope * (np.arange(length, dtype=np.float64) * si_ms)).astype(np.float32)
        if _outside(approx[:, None].astype(np.float64), values[:length], eps).any():
            return Fit(length, float("nan"))
        return Fit(length, 8.0 if float(np.float32(slope)) == slope else 16.0, float(slope), start)

    def quick(self, values, si_ms, eps):
        x = values[:, 0].astype(np.float64)
        slack = np.abs(x * (eps / SLACK))
        first, second, third = x[:-2], x[1:-1], x[2:]
        upper, lower = ((second + s - first) / si_ms for s in (slack[1:-1], -slack[1:-1]))
        pair = (third - slack[2:] > first + upper * (2.0 * si_ms)) | (third + slack[2:] < first + lower * (2.0 * si_ms))
        slope = (upper + lower) / 2.0
        lost = _outside((first + slope * si_ms).astype(np.float32).astype(np.float64), second, eps)
        size = np.where(lost, np.nan, np.where(slope.astype(np.float32) == slope, 8.0, 16.0))
        return lambda at: (Fit(2, float(size[at]), float(slope[at]), float(x[at])) if at < len(pair) and pair[at] else None)


class Xor:
    """Lossless XOR coding of at most `length_bound` ticks."""

    mtid = schema.XOR

    def __init__(self, length_bound: int = 50):
        self.length_bound = length_bound

    def fit(self, values, si_ms, eps):
        length = min(self.length_bound, len(values))
        payload = xor.encode(values[:length].ravel())
        return Fit(length, float(len(payload)), payload=payload)

    def quick(self, values, si_ms, eps):
        bits, steps = xor.prepared(values.ravel())

        def fit(at):
            length = min(self.length_bound, len(bits) - at)
            payload = xor.encoded(bits[at], steps[at:at + length - 1])
            return Fit(length, float(len(payload)), payload=payload)
        return fit


def compression_ratio(length: int, size: float, n_gaps: int) -> np.float32:
    raw, meta, gap = schema.POINT_BYTES, schema.SEGMENT_METADATA_BYTES, schema.GAP_BYTES
    return np.float32(raw * length) / np.float32(meta + size + gap * n_gaps)


def segment_run(values, si_ms, eps, models, length_bound, n_gaps=0, flush=True):
    """Greedy segments (start, mtid, Fit) of one gap-free run, and the tick where they end.

    The model with the best ratio wins, later models win ties, unusable ones are skipped. Without
    `flush` a segment is only final once every model has failed inside the run.
    """
    with np.errstate(divide="ignore", invalid="ignore"):
        return _greedy(values, si_ms, eps, models, length_bound, n_gaps, flush)


def _greedy(values, si_ms, eps, models, length_bound, n_gaps, flush):
    out, at = [], 0
    quick = [None] * len(models)
    if values.shape[1] == 1 and len(values) >= _QUICK_TICKS:
        quick = [m.quick(values, si_ms, eps) if hasattr(m, "quick") else None for m in models]
    while at < len(values):
        rest = values[at:]
        best, best_ratio, needed = None, None, 0
        for model, known in zip(models, quick):
            fit = (known and known(at)) or model.fit(rest, si_ms, eps)
            needed = max(needed + 1, fit.length + 1)
            if fit.length == 0 or np.isnan(fit.size):
                continue
            ratio = compression_ratio(fit.length, fit.size, n_gaps)
            if best is None or ratio >= best_ratio:
                best, best_ratio = (model.mtid, fit), ratio
        if not flush and needed > len(rest):
            break
        if best is None:
            length = min(length_bound, needed, len(rest))
            payload = rest[:length].astype("<f4").tobytes()
            best = (schema.RAW, Fit(length, float(len(payload)), payload=payload))
        out.append((at, *best))
        at += best[1].length
    return out, at


def correlated_members(values: np.ndarray, eps: float) -> list[np.ndarray]:
    """Column indexes of members within twice the bound of a leader at every tick, repeatedly."""
    left, groups = np.arange(values.shape[1]), []
    while len(left):
        lead = values[:, left[:1]]
        shared = ~np.isnan(lead) & ~np.isnan(values[:, left])
        close = (percentage_error(lead, values[:, left]) <= 2 * eps) | ~shared
        same = close.all(axis=0)
        same[0] = True
        groups.append(left[same])
        left = left[~same]
    return groups


def members_apart(values: np.ndarray, eps: float) -> np.ndarray:
    """Which member (column) is beyond twice the bound of which leader (row) at a tick that both have; leaders come before their followers."""
    width = values.shape[1]
    apart = np.zeros((width, width), dtype=bool)
    present = ~np.isnan(values)
    for lead in range(width - 1):
        later = slice(lead + 1, width)
        shared = present[:, lead:lead + 1] & present[:, later]
        apart[lead, later] = (shared & ~(percentage_error(values[:, lead:lead + 1], values[:, later]) <= 2 * eps)).any(axis=0)
    return apart
