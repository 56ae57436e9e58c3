"""Filters, reducers and chains over runs of consecutive records as arrays: what batch and live operators share."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: (values, valid) of consecutive positions -> the same of the outputs, a row each; the first ``halo`` rows count for nothing.
Compute = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def before(p: np.ndarray) -> np.ndarray:
    """How many consecutive positions come right before each of the ascending positions."""
    at = np.arange(len(p))
    starts = np.where(np.diff(p, prepend=p[:1] - 2) != 1, at, 0)
    return at - np.maximum.accumulate(starts)


def in_runs(p: np.ndarray, x: np.ndarray, valid: np.ndarray, halo: int, compute: Compute, outputs: int) -> tuple[np.ndarray, np.ndarray]:
    """``compute`` over each run of consecutive positions that is longer than the halo."""
    y, ok = np.zeros((len(p), outputs), np.int64), np.zeros((len(p), outputs), bool)
    cuts = np.flatnonzero(np.diff(p) != 1) + 1
    for a, b in zip([0, *cuts], [*cuts, len(p)], strict=True):
        if b - a > halo:
            y[a:b], ok[a:b] = compute(x[a:b], valid[a:b])
    return y, ok


def truncated(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """Quotient truncated toward zero."""
    return np.sign(a) * (np.abs(a) // b)


def moved(x: np.ndarray, length: int) -> np.ndarray:
    """Sums of the last ``length`` rows up to each row; of fewer at the start."""
    run = np.cumsum(x, axis=0)
    run[length:] -= run[:-length].copy()
    return run


def reducers(length: int, names: tuple[str, ...]) -> Compute:
    """Reducers over the last ``length`` values; missing values are skipped, and a window without any gives NULL."""
    bounds = {"min": (np.iinfo(np.int64).max, np.min), "max": (np.iinfo(np.int64).min, np.max)}

    def compute(x: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = moved(valid.astype(np.int64), length)
        total = moved(np.where(valid, x, 0), length)
        out = []
        for name in names:
            if name in bounds:
                fill, of = bounds[name]
                y = np.zeros(len(x), np.int64)
                y[length - 1 :] = of(np.lib.stride_tricks.sliding_window_view(np.where(valid, x, fill), length), axis=1)
                out.append(y)
            else:
                out.append({"sumc": total, "count": count, "avg": np.clip(truncated(total, np.maximum(count, 1)), -(2**31), 2**31 - 1)}[name])
        some = count > 0
        return np.stack(out, 1), np.stack([some | (name == "count") for name in names], 1)

    return compute


def weighted(x: np.ndarray, taps: list[int]) -> np.ndarray:
    """Sum over k of taps[k] times the value k rows before; rows before the first count as 0."""
    out = np.zeros_like(x)
    for k, c in enumerate(taps[: len(x)]):
        out[k:] += c * x[: len(x) - k]
    return out


def filtered(taps: list[int], scale: tuple[int, ...] = ()) -> Compute:
    """A filter, divided by each of ``scale`` in turn; a missing value makes its windows NULL."""

    def compute(x: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = weighted(np.where(valid, x, 0), taps)
        for s in scale:
            y = truncated(y, s)
        return y[:, None], (moved((~valid).astype(np.int64), len(taps)) == 0)[:, None]

    return compute


def qrs(taps: list[int], derivative: list[int], short: int, long: int) -> Compute:
    """The ECG chain: (value, short average, long average); a missing value in the halo makes both averages NULL."""
    halo = len(taps) + len(derivative) + short + long - 4

    def compute(x: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = np.where(valid, x, 0)
        bp = truncated(weighted(v, taps), 1000)
        d = weighted(bp, derivative)
        mwi = truncated(moved(truncated(d * d, 1000), short), short)
        thr = truncated(moved(mwi, long), long)
        whole = moved((~valid).astype(np.int64), halo + 1) == 0
        return np.stack([v, mwi, thr], 1), np.stack([valid, whole, whole], 1)

    return compute
