"""Recordings end to end: from raw frames to corrected movies, and from movies to regions and their traces."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glowtrace.operators import filters, images, models, project, register, spectra, traces
from glowtrace.sources.tables import frames_of, pixels_of


@dataclass(frozen=True)
class Corrected:
    """A corrected movie (pixels), the shifts applied, the seconds of its frames, and its rate."""

    pixels: DataFrame
    shifts: DataFrame
    timestamps: DataFrame
    rate: float


def motion_correct(
    frames: DataFrame, rate: float, height: int, width: int, timestamps: DataFrame | None = None, drop: float = 5, top: int = 0, bottom: int = 0, left: int = 10, right: int = 0,
    remove_artifacts: dict | None = None, median: int = 0, median_time: bool = False, avg_frames: int | None = None, avg_type: str = "mean", max_shifts: tuple[int, int] = (40, 40),
    iterations: int = 1, piecewise: int = 0, strides: tuple[int, int] = (120, 120), overlaps: tuple[int, int] = (100, 100), deviation: int = 3, border: str = "copy", denoise: int | None = 100, upsample: int = 10,
    cut_borders: bool = False, debleach: bool | int = False, replace_nans: bool = False, template: dict | None = None,
) -> Corrected:
    """Drop and crop, optional band removal, median and binning, rigid registration to 1 / ``upsample`` of a pixel (and
    ``piecewise`` rounds by patches),
    low rank, optional border cut, debleaching (True, or a number of knots) and NaNs to 0.

    ``timestamps`` (rec_id, t_idx, ts) follow the frames: those dropped are left out and binned ones averaged."""
    pixels = project.drop_and_crop(pixels_of(frames), rate, drop, top, bottom, left, right, height, width)
    height, width, k = height - top - bottom, width - left - right, int(drop * rate)
    times = timestamps if timestamps is not None else pixels.select("rec_id", "t_idx").distinct().withColumn("ts", (F.col("t_idx") + k) / rate)
    if timestamps is not None:
        times = times.where(F.col("t_idx") >= k).withColumn("t_idx", F.col("t_idx") - k)
    if remove_artifacts is not None:
        pixels = pixels_of(spectra.remove_bands(frames_of(pixels), height, width, **remove_artifacts))
    if median:
        pixels = pixels_of(images.median_filter(frames_of(pixels), median, median_time))
    if avg_frames and avg_frames > 1:
        n = times.groupBy("rec_id").agg(((F.max("t_idx") + 1) % avg_frames).alias("_rest"))
        block = F.floor((F.col("t_idx") - F.col("_rest")) / avg_frames).cast("long")
        times = times.join(n, "rec_id").where("t_idx >= _rest").groupBy("rec_id", block.alias("t_idx")).agg(F.avg("ts").alias("ts"))
        pixels, rate = project.bin_frames(pixels, avg_frames, avg_type), rate / avg_frames
    movie, shifts = register.register_rigid(frames_of(pixels), max_shifts, iterations, border, upsample, **(template or {}))
    for _ in range(piecewise):
        movie = register.piecewise(movie, register.template_of(movie), max_shifts, strides, overlaps, deviation, upsample)
    if denoise:
        movie = models.pca_denoise(movie, denoise)
    pixels = pixels_of(movie)
    if cut_borders:
        pixels = project.border_cut(pixels, shifts)
    if debleach is True:
        pixels = models.debleach(pixels)
    elif debleach:
        pixels = models.debleach_spline(pixels, int(debleach))
    if replace_nans:
        pixels = project.nan_to_zero(pixels)
    return Corrected(pixels, shifts, times, rate)


def motion_correct_filtered(frames: DataFrame, rate: float, height: int, width: int, drop: float = 5, top: int = 0, bottom: int = 0, left: int = 60, right: int = 0, max_shifts: tuple[int, int] = (6, 6), q_cut: tuple[float, float] = (1, 99), median: int = 3, median_time: bool = True, upsample: int = 10) -> tuple[Corrected, DataFrame, DataFrame]:
    """(corrected, frame quality, image quality): shifts from a clipped, filtered copy applied to the original; medians,
    means, deviations and local correlations before and after (column ``stage``)."""
    before = project.drop_and_crop(pixels_of(frames), rate, drop, top, bottom, left, right, height, width)
    movie, shifts = register.register_on_filtered(frames_of(before), max_shifts, q_cut, median, median_time, upsample)
    after = pixels_of(movie)
    staged = [(F.lit(name).alias("stage"), px) for name, px in (("before", before), ("after", after))]
    by_frame = [project.frame_quality(px).select(s, "*") for s, px in staged]
    by_image = [project.image_quality(px).join(project.local_correlation(px).withColumnRenamed("v", "correlation"), list(project.PIXEL), "left").select(s, "*") for s, px in staged]
    times = before.select("rec_id", "t_idx").distinct().withColumn("ts", (F.col("t_idx") + int(drop * rate)) / rate)
    return Corrected(after, shifts, times, rate), by_frame[0].union(by_frame[1]), by_image[0].union(by_image[1])


@dataclass(frozen=True)
class Regions:
    """Masks, weighted masks, centres and sizes, and relative-change traces of a recording's regions."""

    mask: DataFrame
    weighted: DataFrame
    stats: DataFrame
    traces: DataFrame


def _smoother(kind: str | None, rate: float, options: dict) -> Callable[[DataFrame], DataFrame] | None:
    return (lambda t: filters.filter_traces(t, rate, kind, **options)) if kind else None


def _extracted(pixels: DataFrame, mask: DataFrame, image: DataFrame, rate: float, height: int, width: int, sign: int, bg_subtract: bool, bg_dilate: int, filter_type: str | None, filter_before: bool, filter_options: dict, window: float) -> Regions:
    change = traces.rolling_dfof_pipeline(frames_of(pixels), mask, rate, height, width, window, bg_subtract, bg_dilate, _smoother(filter_type, rate, filter_options), filter_before)
    return Regions(mask, images.scaled_weights(mask, image, sign), images.roi_stats(mask), change)


def watershed_regions(
    pixels: DataFrame, rate: float, height: int, width: int, projection="std", blur: dict | None = None, thresh: float = 2, upper: float = 4, lower: float = 1, min_size: int = 5, sign: int = -1, edge: int = 5,
    bg_subtract: bool = True, bg_dilate: int = 0, filter_type: str | None = "gaussian", filter_before: bool = True, filter_options: dict | None = None, window: float = 30, smooth: str | None = None, smooth_factor: float = 10,
) -> Regions:
    """Regions found by watershed on a projection of the movie as whole numbers, and their traces. ``smooth`` filters every
    pixel in time first: ``butter`` with a cutoff of rate / ``smooth_factor``, or ``spline`` with that many knots a second."""
    if smooth == "butter":
        slow = filters.lowpass(pixels, rate / smooth_factor, rate, keys=("rec_id", "y", "x"), value="v")
        pixels = slow.select(pixels.columns)
    elif smooth == "spline":
        pixels = models.spline_smooth(pixels, per_second=smooth_factor, rate=rate)
    image = project.projection(project.to_uint8(pixels), projection)
    if blur is not None:
        image = images.gaussian_blur(image, height, width, **blur)
    mask = images.watershed_rois(image, height, width, thresh, upper, lower, min_size, edge)
    return _extracted(pixels, mask, image, rate, height, width, sign, bg_subtract, bg_dilate, filter_type, filter_before, filter_options or {"ksize": 0.08}, window)


def drawn_regions(
    pixels: DataFrame, polygons: DataFrame, rate: float, height: int, width: int, projection="mean", bg_subtract: bool = True, filter_type: str | None = "gaussian", filter_before: bool = True,
    filter_options: dict | None = None, window: float = 30, blur: dict | None = None,
) -> Regions:
    """Regions given as polygons, and their traces; traces carry their region's id. ``blur`` smooths the projection that
    weighs the regions' pixels."""
    image = project.projection(project.to_uint8(pixels), projection)
    if blur is not None:
        image = images.gaussian_blur(image, height, width, **blur)
    mask = images.rasterise(polygons, height, width)
    return _extracted(pixels, mask, image, rate, height, width, -1, bg_subtract, 0, filter_type, filter_before, filter_options or {"ksize": 0.08}, window)
