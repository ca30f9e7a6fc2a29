"""Filters along time. Finite kernels are windows in Spark; recursive filters are designed here and run in chunks of time."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glowtrace.functions import gaussian_kernel, round_odd, savgol_kernel
from glowtrace.operators.recursion import Cascade, Recursion, filtered, recursive_filter
from glowtrace.operators.windows import KEYS, by, frame_list, padded


def weighted(window: Column, weights: Sequence[float]) -> Column:
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.aggregate(F.zip_with(window, w, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def convolve(traces: DataFrame, weights: Sequence[float], mode: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, t_idx, f): a centred odd kernel over padded series."""
    r = len(weights) // 2
    ext = padded(traces, r, r, mode, keys)
    rows = ext.withColumn("_last", F.max("t_idx").over(Window.partitionBy(*keys)) - r).withColumn("w", frame_list("f", r, r, keys))
    return rows.where("t_idx >= 0 and t_idx <= _last").select(*keys, "t_idx", weighted(F.col("w"), weights).alias("f"))


def gaussian_smooth(traces: DataFrame, sigma: float, keys: Sequence[str] = KEYS) -> DataFrame:
    return convolve(traces, gaussian_kernel(sigma), "reflect", keys)


def median_smooth(traces: DataFrame, size: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """The median of an odd window, zeros beyond the ends."""
    r = size // 2
    ext = padded(traces, r, r, "zero", keys)
    rows = ext.withColumn("_last", F.max("t_idx").over(Window.partitionBy(*keys)) - r).withColumn("w", F.array_sort(frame_list("f", r, r, keys)))
    return rows.where("t_idx >= 0 and t_idx <= _last").select(*keys, "t_idx", F.get("w", F.lit(r)).alias("f"))


def savgol_smooth(traces: DataFrame, size: int, order: int = 2, keys: Sequence[str] = KEYS) -> DataFrame:
    """Savitzky-Golay: the middle of a polynomial fit; the first and last rows from the fits of the first and last window."""
    r = size // 2
    series = Window.partitionBy(*keys)
    rows = traces.select(*keys, "t_idx", F.col("f").cast("double").alias("f")).withColumn("_n", F.count("*").over(series))
    rows = rows.withColumn("w", frame_list("f", r, r, keys))
    whole = by(keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = F.when(F.size("w") == size, F.col("w"))
    rows = rows.withColumn("_head", F.first(full, True).over(whole)).withColumn("_tail", F.last(full, True).over(whole))
    out = F.when(F.size("w") == size, weighted(F.col("w"), savgol_kernel(size, order)))
    for i in range(r):
        out = out.when(F.col("t_idx") == i, weighted(F.col("_head"), savgol_kernel(size, order, i)))
        out = out.when(F.col("t_idx") == F.col("_n") - 1 - i, weighted(F.col("_tail"), savgol_kernel(size, order, size - 1 - i)))
    return rows.select(*keys, "t_idx", out.alias("f"))


def fir(traces: DataFrame, weights: Sequence[float], keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, t_idx, f): a causal filter, zeros before the start."""
    w = by(keys)
    terms = [F.coalesce(F.lag("f", j).over(w), F.lit(0.0)) * float(h) for j, h in enumerate(weights)]
    return traces.select(*keys, "t_idx", sum(terms[1:], terms[0]).alias("f"))


# Recursive filters: designs by the bilinear transform of the analogue prototypes.


def _zpk_to_ba(z: np.ndarray, p: np.ndarray, k: float) -> tuple[np.ndarray, np.ndarray]:
    return np.real(k * np.poly(z)), np.real(np.poly(p))


def _bilinear(z: np.ndarray, p: np.ndarray, k: float) -> tuple[np.ndarray, np.ndarray, float]:
    fs2 = 4.0
    degree = len(p) - len(z)
    zd = np.append((fs2 + z) / (fs2 - z), -np.ones(degree))
    return zd, (fs2 + p) / (fs2 - p), float(np.real(k * np.prod(fs2 - z) / np.prod(fs2 - p)))


def _butter_poles(order: int) -> np.ndarray:
    return -np.exp(1j * np.pi * np.arange(-order + 1, order, 2) / (2 * order))


def butter_lowpass(cutoff: float, fs: float, order: int = 5) -> tuple[np.ndarray, np.ndarray]:
    warped = 4 * np.tan(np.pi * cutoff / fs)
    return _zpk_to_ba(*_bilinear(np.empty(0), warped * _butter_poles(order), warped**order))


def _band(order_poles: np.ndarray, low: float, high: float, fs: float, stop: bool, gain: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    a, b = 4 * np.tan(np.pi * low / fs), 4 * np.tan(np.pi * high / fs)
    width, centre, n = b - a, np.sqrt(a * b), len(order_poles)
    if stop:
        half = (width / 2) / order_poles
        p = np.concatenate([half + np.sqrt(half**2 - centre**2 + 0j), half - np.sqrt(half**2 - centre**2 + 0j)])
        z = np.concatenate([1j * centre * np.ones(n), -1j * centre * np.ones(n)])
        k = gain * np.real(1 / np.prod(-order_poles))
    else:
        half = order_poles * width / 2
        p = np.concatenate([half + np.sqrt(half**2 - centre**2 + 0j), half - np.sqrt(half**2 - centre**2 + 0j)])
        z, k = np.zeros(n), gain * width**n
    return _zpk_to_ba(*_bilinear(z, p, k))


def butter_bandpass(low: float, high: float, fs: float, order: int = 5) -> tuple[np.ndarray, np.ndarray]:
    return _band(_butter_poles(order), low, high, fs, False)


def butter_bandstop(low: float, high: float, fs: float, order: int = 2) -> tuple[np.ndarray, np.ndarray]:
    return _band(_butter_poles(order), low, high, fs, True)


def chebyshev_lowpass(order: int, ripple: float, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """Type I, cutoff as a share of half the rate."""
    eps = np.sqrt(10 ** (0.1 * ripple) - 1)
    mu = np.arcsinh(1 / eps) / order
    theta = np.pi * np.arange(-order + 1, order, 2) / (2 * order)
    p = -np.sinh(mu + 1j * theta)
    k = np.real(np.prod(-p)) / (np.sqrt(1 + eps * eps) if order % 2 == 0 else 1)
    warped = 4 * np.tan(np.pi * cutoff / 2)
    return _zpk_to_ba(*_bilinear(np.empty(0), warped * p, k * warped**order))


def lfilter(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray | None = None) -> np.ndarray:
    """The difference equation over one array, from rest or from a state."""
    filt = Recursion(b, a)
    return filt.run(x, filt.rest if state is None else np.asarray(state, float))[0]


def steady_state(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The state after a long step of height 1."""
    return Recursion(b, a).steady


def filtfilt(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forwards and backwards over one array extended by its odd reflection."""
    return filtered(x, Cascade(b, a), True)


def lowpass(traces: DataFrame, cutoff: float, fs: float, order: int = 5, keys: Sequence[str] = KEYS, value: str = "f") -> DataFrame:
    b, a = butter_lowpass(cutoff, fs, order)
    return recursive_filter(traces, b, a, True, keys, value)


def bandpass(traces: DataFrame, low: float, high: float, fs: float, order: int = 5, keys: Sequence[str] = KEYS) -> DataFrame:
    b, a = butter_bandpass(low, high, fs, order)
    return recursive_filter(traces, b, a, True, keys)


def notch_filter(traces: DataFrame, dt: float, band: float = 2, freq: float = 60, order: int = 2, keys: Sequence[str] = KEYS) -> DataFrame:
    """A single causal pass of a band stop around ``freq``."""
    b, a = butter_bandstop(freq - band / 2, freq + band / 2, 1 / dt, order)
    return recursive_filter(traces, b, a, False, keys)


def filter_traces(traces: DataFrame, rate: float, method: str | None = "median", ksize: float = 0.24, keys: Sequence[str] = KEYS, **options) -> DataFrame:
    """The named filter with its kernel in seconds: median (or medfilt), gaussian, butterworth, savgol, or None."""
    if method is None:
        return traces.select(*keys, "t_idx", "f")
    if method in ("median", "medfilt"):
        return median_smooth(traces, round_odd(rate * ksize), keys)
    if method == "gaussian":
        return gaussian_smooth(traces, rate * ksize, keys)
    if method == "butterworth":
        return lowpass(traces, 1 / ksize, rate, keys=keys, **options)
    if method == "savgol":
        return savgol_smooth(traces, round_odd(rate * ksize), options.get("polyorder", 2), keys)
    raise ValueError(f"unknown filter {method!r}")


def preprocess(traces: DataFrame, rate: float, factor: int = 10, start: float = 0, end: float | None = None, centre: bool = True, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, t_idx, ts, f, mean): anti-aliased decimation of time, the half-open time range, and the mean taken off (NULL
    mean if not)."""
    rows = traces.select(*keys, "t_idx", "ts", "f")
    if factor > 1:
        b, a = chebyshev_lowpass(8, 0.05, 0.8 / factor)
        smooth = recursive_filter(rows, b, a, True, keys)
        rows = rows.drop("f").join(smooth, [*keys, "t_idx"]).where(F.col("t_idx") % factor == 0).withColumn("t_idx", F.expr(f"t_idx div {factor}"))
    rows = rows.where(F.col("ts") >= start) if end is None else rows.where((F.col("ts") >= start) & (F.col("ts") < end))
    mean = F.avg("f").over(Window.partitionBy(*keys)) if centre else F.lit(None).cast("double")
    rows = rows.withColumn("mean", mean)
    return rows.withColumn("f", F.col("f") - F.coalesce("mean", F.lit(0.0)))
