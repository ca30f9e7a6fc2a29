"""Spectra of frames: mean log spectrum, notch filters, band removal, low-pass windows."""

from __future__ import annotations

import warnings
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glowtrace.operators.images import detect_peaks, map_frames, peaks_with_retry
from glowtrace.sources.scratch import checkpointed


def mean_spectrum(frames: DataFrame, first: int = 300) -> DataFrame:
    """(rec_id, y, x, v): the mean of 20 ln |centred spectrum| over the first frames. Each task adds its frames up before
    anything is shuffled."""

    def add(batches):
        held: dict[tuple[str, int, int], list] = {}
        for batch in batches:
            for rec, h, w, pix in zip(batch["rec_id"], batch["h"], batch["w"], batch["pix"], strict=True):
                size = np.abs(np.fft.fftshift(np.fft.fft2(np.asarray(pix, float).reshape(h, w))))
                part = held.setdefault((rec, h, w), [0, np.zeros((h, w))])
                part[0] += 1
                part[1] += 20 * np.log(np.maximum(size, 1e-300))
        for (rec, h, w), (n, total) in held.items():
            y, x = np.divmod(np.arange(h * w), w)
            yield pd.DataFrame({"rec_id": rec, "y": y.astype(np.int32), "x": x.astype(np.int32), "s": total.ravel(), "n": n})

    sums = frames.where(F.col("t_idx") < first).mapInPandas(add, "rec_id string, y int, x int, s double, n long")
    return sums.groupBy("rec_id", "y", "x").agg((F.sum("s") / F.sum("n")).alias("v"))


def spectrum_peaks(frames: DataFrame, height: int, width: int, first: int = 300, relative: int = 3, edge: int = 5, tolerance: float = 10) -> DataFrame:
    """Peaks of the mean spectrum farther than ``tolerance`` from its centre."""
    peaks = peaks_with_retry(mean_spectrum(frames, first), height, width, relative, edge)
    return peaks.where(F.sqrt(F.pow(F.col("y") - height / 2, 2) + F.pow(F.col("x") - width / 2, 2)) > tolerance)


def notch_mask(height: int, width: int, peaks: list[tuple[int, int]], d0: float = 9, kind: str = "ideal", order: int = 1) -> np.ndarray:
    u, v = np.mgrid[:height, :width].astype(float)
    mask = np.ones((height, width))
    for y, x in peaks:
        du, dv = y - height / 2, x - width / 2
        one, two = np.hypot(u - height / 2 + du, v - width / 2 + dv), np.hypot(u - height / 2 - du, v - width / 2 - dv)
        if kind == "gaussian":
            mask *= 1 - np.exp(-0.5 * one * two / d0**2)
        elif kind == "butter":
            with np.errstate(divide="ignore"):
                mask *= 1 / (1 + (d0**2 / (one * two)) ** order)
        else:
            mask *= (one > d0) & (two > d0)
    return mask


@lru_cache(maxsize=64)
def _cached_notch(height: int, width: int, peaks: tuple[tuple[int, int], ...], d0: float, kind: str) -> np.ndarray:
    return notch_mask(height, width, list(peaks), d0, kind)


def masked(image: np.ndarray, mask: np.ndarray, pad: int = 0) -> np.ndarray:
    """The magnitude of the image whose centred spectrum is multiplied by the mask; zeros around it meanwhile."""
    wide = np.pad(image, pad)
    out = np.abs(np.fft.ifft2(np.fft.ifftshift(np.fft.fftshift(np.fft.fft2(wide)) * mask)))
    return out[pad : pad + image.shape[0], pad : pad + image.shape[1]]


#: Tables of one row a recording are broadcast up to this many recordings.
MOST_RECORDINGS = 100_000


def _with_peaks(frames: DataFrame, peaks: DataFrame, expected: int | None) -> DataFrame:
    """frames with ``_peaks``, the peaks of their recording in order: empty, with a warning, where there aren't as many as
    expected. One plan for all recordings."""
    found = peaks.groupBy("rec_id").agg(F.array_sort(F.collect_list(F.struct("y", "x"))).alias("_peaks"), F.count("*").alias("_n"))
    found = checkpointed(frames.sparkSession, found)
    n = F.coalesce("_n", F.lit(0))
    off = frames.select("rec_id").distinct().join(found, "rec_id", "left").where(n != expected if expected is not None else n == 0)
    for r in off.select("rec_id", n.alias("n")).orderBy("rec_id").limit(20).collect():
        warnings.warn(f"{r['rec_id']}: {r['n']} peaks" + (f" instead of {expected}" if expected is not None else "") + "; nothing is removed", stacklevel=3)
    kept = found.where(F.col("_n") == expected) if expected is not None else found
    kept = kept.drop("_n")
    return frames.join(F.broadcast(kept) if kept.count() <= MOST_RECORDINGS else kept, "rec_id", "left")


def _map_with_peaks(frames: DataFrame, schema, kernel) -> DataFrame:
    """Frames with ``_peaks`` through a kernel of (image, peaks); those without peaks as they are."""

    def run(batches):
        for batch in batches:
            out = []
            for h, w, pix, peaks in zip(batch["h"], batch["w"], batch["pix"], batch["_peaks"], strict=True):
                at = tuple((p["y"], p["x"]) for p in peaks) if peaks is not None else ()
                out.append(kernel(np.asarray(pix, float).reshape(h, w), at).ravel() if at else pix)
            yield batch.drop(columns="_peaks").assign(pix=out)

    columns = schema.names
    return frames.select(*columns, "_peaks").mapInPandas(run, schema)


def remove_artifact(frames: DataFrame, height: int, width: int, first: int = 300, d0: float = 5, tolerance: float = 10, kind: str = "gaussian", pad: int = 0, relative: int = 3, edge: int = 5, n_masks: int | None = 2) -> DataFrame:
    """Frames without the stripes that exactly ``n_masks`` peaks (None: any number) of their mean spectrum show, as
    magnitudes; recordings with others are left as they are, with a warning."""
    wide = map_frames(frames, lambda i: np.pad(i, pad)) if pad else frames
    peaks = spectrum_peaks(wide, height + 2 * pad, width + 2 * pad, first, relative, edge, tolerance)

    def kernel(image: np.ndarray, at: tuple) -> np.ndarray:
        return masked(image, _cached_notch(image.shape[0] + 2 * pad, image.shape[1] + 2 * pad, at, d0, kind), pad)

    return _map_with_peaks(_with_peaks(frames, peaks, n_masks), frames.schema, kernel)


def hamming_mask(height: int, width: int, power: float) -> np.ndarray:
    return np.sqrt(np.outer(np.hamming(height), np.hamming(width))) ** power


def lowpass_frames(frames: DataFrame, height: int, width: int, power: float | None = None, subtract: bool = False, default: float = 1.0) -> DataFrame:
    """Frames through the Hamming window of their spectrum to a power, as magnitudes, stretched back to the range of their
    recording. By default the power is one by the recording's largest peak frequency (``default`` without a peak);
    ``subtract`` takes the window of twice the power off, which leaves a band."""
    powers = frames.select("rec_id").distinct().select("rec_id", F.lit(power).alias("v")) if power is not None else max_frequency(frames, height, width, default).select("rec_id", (1 / F.col("v")).alias("v"))
    before = frames.groupBy("rec_id").agg(F.min(F.array_min("pix")).alias("_a"), F.max(F.array_max("pix")).alias("_b"))
    facts = checkpointed(frames.sparkSession, powers.join(before, "rec_id"))
    few = facts.count() <= MOST_RECORDINGS
    rows = frames.join(F.broadcast(facts) if few else facts, "rec_id")

    def run(batches):
        for batch in batches:
            out = []
            for h, w, pix, p in zip(batch["h"], batch["w"], batch["pix"], batch["v"], strict=True):
                mask = hamming_mask(h, w, p) - (hamming_mask(h, w, 2 * p) if subtract else 0)
                out.append(masked(np.asarray(pix, float).reshape(h, w), mask).ravel())
            yield batch.assign(pix=out)

    columns = frames.columns
    rows = rows.select(*columns, "v", "_a", "_b")
    rows = checkpointed(frames.sparkSession, rows.mapInPandas(run, rows.schema))
    after = rows.groupBy("rec_id").agg(F.min(F.array_min("pix")).alias("_lo"), F.max(F.array_max("pix")).alias("_hi"))
    rows = rows.join(F.broadcast(after) if few else after, "rec_id")
    stretched = F.transform("pix", lambda x: F.coalesce(F.try_divide(x - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0)) * (F.col("_b") - F.col("_a")) + F.col("_a"))
    return rows.withColumn("pix", stretched).select(columns)


def mask_boxes(frames: DataFrame, height: int, width: int, first: int = 300, sep: int = 5, surround: int = 12, tolerance: float = 10, relative: int = 3, edge: int = 5, n_masks: int | None = 2) -> DataFrame:
    """Frames whose spectrum has the box around each of exactly ``n_masks`` peaks replaced by the median of its surround
    without the box, as magnitudes clipped to 16-bit whole numbers; recordings with others are left as they are, with a
    warning."""

    def kernel(image: np.ndarray, at: tuple) -> np.ndarray:
        z = np.fft.fftshift(np.fft.fft2(image))
        h, w = image.shape
        for y, x in at:
            box = (slice(max(0, y - sep), y + sep), slice(max(0, x - sep), x + sep))
            around = np.zeros((h, w), bool)
            around[max(0, y - surround) : y + surround, max(0, x - surround) : x + surround] = True
            around[box] = False
            if around.any():
                ring = np.sort_complex(z[around])
                z[box] = (ring[(len(ring) - 1) // 2] + ring[len(ring) // 2]) / 2
        return np.floor(np.clip(np.abs(np.fft.ifft2(np.fft.ifftshift(z))), 0, 65535))

    peaks = spectrum_peaks(frames, height, width, first, relative, edge, tolerance)
    return _map_with_peaks(_with_peaks(frames, peaks, n_masks), frames.schema, kernel)


def remove_bands(frames: DataFrame, height: int, width: int, repeats: int = 3, mode: str = "notch", zeropad: int = 0, **options) -> DataFrame:
    """A band filter (notch, boxes or lowpass) several times over; each pass finds its own peaks in what the last one left,
    and warns where it finds none to remove. Between ``zeropad`` and its removal, all passes see a border of zeros."""
    if zeropad:
        frames, height, width = map_frames(frames, lambda i: np.pad(i, zeropad)), height + 2 * zeropad, width + 2 * zeropad
    for i in range(repeats):
        if mode == "notch":
            frames = remove_artifact(frames, height, width, **{"kind": "ideal"} | options)
        elif mode == "boxes":
            frames = mask_boxes(frames, height, width, **options)
        else:
            frames = lowpass_frames(frames, height, width, **options)
        if i + 1 < repeats:
            frames = checkpointed(frames.sparkSession, frames)
    return map_frames(frames, lambda i: i[zeropad:-zeropad, zeropad:-zeropad]) if zeropad else frames


def max_frequency(frames: DataFrame, height: int, width: int, default: float = 1.0, edge: int = 5) -> DataFrame:
    """(rec_id, v): the largest frequency of a spectrum peak, or the default."""
    peaks = detect_peaks(mean_spectrum(frames), height, width, 3, edge)
    f = F.sqrt(F.pow((F.col("y") - height / 2) / height, 2) + F.pow((F.col("x") - width / 2) / width, 2))
    found = peaks.groupBy("rec_id").agg(F.max(f).alias("v"))
    return frames.select("rec_id").distinct().join(found, "rec_id", "left").withColumn("v", F.coalesce("v", F.lit(default)))
