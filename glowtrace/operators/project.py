"""Movies: crops, clips, normalisations, projections over time, binning, templates and quality figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glowtrace.operators.quantiles import exact_percentiles

REDUCERS = {"mean": F.avg, "std": F.stddev_pop, "max": F.max, "min": F.min, "median": F.median, "sum": F.sum, "var": F.var_pop}
PIXEL = ("rec_id", "y", "x")


def reducer(name):
    """A named reducer, or any function of a column."""
    return name if callable(name) else REDUCERS[name]


def drop_and_crop(pixels: DataFrame, rate: float, drop: float = 5, top: int = 0, bottom: int = 0, left: int = 0, right: int = 0, height: int | None = None, width: int | None = None) -> DataFrame:
    """Without the first int(drop * rate) frames and the given borders; frames, rows and columns count from 0 again.
    ``height`` and ``width`` are read from the movie where they are not given."""
    k = int(drop * rate)
    if height is None or width is None:
        size = pixels.agg(F.max("y") + 1, F.max("x") + 1).first()
        height, width = size[0] or 0, size[1] or 0
    inside = pixels.where((F.col("t_idx") >= k) & F.col("y").between(top, height - bottom - 1) & F.col("x").between(left, width - right - 1))
    return inside.withColumn("t_idx", F.col("t_idx") - k).withColumn("y", F.col("y") - top).withColumn("x", F.col("x") - left)


def border_cut(pixels: DataFrame, shifts: DataFrame) -> DataFrame:
    """Without the borders that the largest measured shift (dy, dx) of the recording may have moved in from outside."""
    reach = shifts.groupBy("rec_id").agg(F.ceil(F.greatest(F.max(F.abs("dy")), F.max(F.abs("dx")))).alias("b"))
    size = pixels.groupBy("rec_id").agg(F.max("y").alias("h"), F.max("x").alias("w"))
    rows = pixels.join(reach.join(size, "rec_id"), "rec_id")
    return rows.where("y between b and h - b and x between b and w - b").select(pixels.columns)


def time_range(rows: DataFrame, start: float = 0, end: float | None = None) -> DataFrame:
    """Rows with start <= ts < end."""
    return rows.where(F.col("ts") >= start) if end is None else rows.where((F.col("ts") >= start) & (F.col("ts") < end))


def decimate(rows: DataFrame, d: int) -> DataFrame:
    return rows.where(F.col("t_idx") % d == 0)


def nan_to_zero(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("v", F.coalesce(F.nanvl("v", F.lit(None).cast("double")), F.lit(0.0)))


def nonnegative(v: Column) -> Column:
    return F.greatest(v, F.lit(0.0))


def _over_movie(pixels: DataFrame, *aggs: Column) -> DataFrame:
    return pixels.join(pixels.groupBy("rec_id").agg(*aggs), "rec_id")


def quantile_clip(pixels: DataFrame, low: float = 1, high: float = 99) -> DataFrame:
    """Values below the low quantile of the movie become 0, those above the high one become it."""
    limits = exact_percentiles(pixels, ["rec_id"], "v", [low / 100, high / 100])
    rows = pixels.join(limits.select("rec_id", F.col("quantiles")[0].alias("_lo"), F.col("quantiles")[1].alias("_hi")), "rec_id")
    v = F.when(F.col("v") < F.col("_lo"), 0.0).when(F.col("v") > F.col("_hi"), F.col("_hi")).otherwise(F.col("v"))
    return rows.withColumn("v", v).select(pixels.columns)


def to_uint8(pixels: DataFrame) -> DataFrame:
    """Minimum to 0 and maximum to 255 over the movie, cut to whole numbers; 0 if all are alike."""
    rows = _over_movie(pixels, F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    v = F.floor(F.try_divide(F.col("v") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * 255)
    return rows.withColumn("v", F.coalesce(v, F.lit(0)).cast("int")).select(pixels.columns)


def restore_range(pixels: DataFrame, original: DataFrame) -> DataFrame:
    """Stretched linearly to the range of the original movie."""
    rows = _over_movie(pixels, F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    rows = rows.join(original.groupBy("rec_id").agg(F.min("v").alias("_a"), F.max("v").alias("_b")), "rec_id")
    v = F.try_divide(F.col("v") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * (F.col("_b") - F.col("_a")) + F.col("_a")
    return rows.withColumn("v", v).select(pixels.columns)


def to_uint16(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("v", F.floor(F.least(F.greatest(F.col("v"), F.lit(0.0)), F.lit(65535.0))).cast("int"))


def standardise(pixels: DataFrame, scaling: str = "features") -> DataFrame:
    """Less the mean, by the population standard deviation, of each pixel (``features``) or of the movie (``overall``)."""
    keys = list(PIXEL) if scaling == "features" else ["rec_id"]
    stats = pixels.groupBy(*keys).agg(F.avg("v").alias("_m"), F.stddev_pop("v").alias("_s"))
    return pixels.join(stats, keys).withColumn("v", F.try_divide(F.col("v") - F.col("_m"), F.col("_s"))).select(pixels.columns)


def unstandardise(pixels: DataFrame, original: DataFrame, scaling: str = "features") -> DataFrame:
    keys = list(PIXEL) if scaling == "features" else ["rec_id"]
    stats = original.groupBy(*keys).agg(F.avg("v").alias("_m"), F.stddev_pop("v").alias("_s"))
    return pixels.join(stats, keys).withColumn("v", F.col("v") * F.col("_s") + F.col("_m")).select(pixels.columns)


def zero_pad(pixels: DataFrame, pad: int, height: int, width: int) -> DataFrame:
    """A border of zeros: border pixels are made from each frame's first pixel, so nothing is shuffled."""
    ys, xs = F.sequence(F.lit(0), F.lit(height + 2 * pad - 1)), F.sequence(F.lit(0), F.lit(width + 2 * pad - 1))
    cells = F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(y.alias("y"), x.alias("x")))))
    border = F.filter(cells, lambda c: ~(c["y"].between(pad, pad + height - 1) & c["x"].between(pad, pad + width - 1)))
    made = pixels.where("y = 0 and x = 0").select("rec_id", "t_idx", F.explode(border).alias("c")).select("rec_id", "t_idx", "c.y", "c.x", F.lit(0.0).alias("v"))
    return pixels.select("rec_id", "t_idx", (F.col("y") + pad).alias("y"), (F.col("x") + pad).alias("x"), "v").union(made)


def unpad(pixels: DataFrame, pad: int, height: int, width: int) -> DataFrame:
    inside = pixels.where(F.col("y").between(pad, pad + height - 1) & F.col("x").between(pad, pad + width - 1))
    return inside.withColumn("y", F.col("y") - pad).withColumn("x", F.col("x") - pad)


def projection(pixels: DataFrame, method="std") -> DataFrame:
    """(rec_id, y, x, v): the reducer over time."""
    return pixels.groupBy(*PIXEL).agg(reducer(method)("v").alias("v"))


def template(pixels: DataFrame, first: int | None = None, seconds: float | None = None, interval: tuple[float, float] | None = None, rate: float = 1.0) -> DataFrame:
    """(rec_id, y, x, v): the mean image of all frames, of the first frames or seconds, or of an interval of seconds."""
    if first is not None:
        pixels = pixels.where(F.col("t_idx") < first)
    elif seconds is not None:
        pixels = pixels.where(F.col("t_idx") < int(rate * seconds))
    elif interval is not None:
        pixels = pixels.where(F.col("t_idx").between(interval[0] * rate, interval[1] * rate))
    return pixels.groupBy(*PIXEL).agg(F.avg(F.nanvl("v", F.lit(None).cast("double"))).alias("v"))


def bin_frames(pixels: DataFrame, k: int, method: str = "mean") -> DataFrame:
    """Blocks of k frames reduced to one; the first T % k frames are dropped."""
    if method not in ("mean", "min", "median"):
        raise ValueError("method must be mean, min or median")
    n = pixels.groupBy("rec_id").agg(((F.max("t_idx") + 1) % k).alias("_rest"))
    rows = pixels.join(n, "rec_id").where("t_idx >= _rest").withColumn("t_idx", F.floor((F.col("t_idx") - F.col("_rest")) / k).cast("long"))
    return rows.groupBy("rec_id", "t_idx", "y", "x").agg(reducer(method)("v").alias("v"))


def frame_quality(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("rec_id", "t_idx").agg(F.median("v").alias("median"), F.avg("v").alias("mean"))


def image_quality(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy(*PIXEL).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def local_correlation(pixels: DataFrame) -> DataFrame:
    """(rec_id, y, x, v): the mean correlation of each pixel with its eight neighbours. Each pair is correlated once: a
    pixel is sent to its four following neighbours' keys, and the coefficient counts for both ends."""
    after = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))])
    sent = pixels.select("rec_id", "t_idx", F.col("y").alias("y0"), F.col("x").alias("x0"), F.col("v").alias("v0"), F.explode(after).alias("o"))
    sent = sent.select("rec_id", "t_idx", "y0", "x0", "v0", (F.col("y0") + F.col("o.dy")).alias("y"), (F.col("x0") + F.col("o.dx")).alias("x"))
    pairs = sent.join(pixels, ["rec_id", "t_idx", "y", "x"]).groupBy("rec_id", "y0", "x0", "y", "x").agg(F.corr("v0", "v").alias("r"))
    ends = pairs.select("rec_id", F.explode(F.array(F.struct(F.col("y0").alias("y"), F.col("x0").alias("x")), F.struct("y", "x"))).alias("p"), "r")
    return ends.groupBy("rec_id", "p.y", "p.x").agg(F.avg(F.nanvl("r", F.lit(None).cast("double"))).alias("v"))


def locally_weighted(pixels: DataFrame, height: int, width: int, hwin: int = 17, wwin: int = 27, method="std", local: str = "mean") -> DataFrame:
    """(rec_id, y, x, v): the projection by the mean of its box, boxes moved inside the frame at its borders; odd windows.
    The box is reduced over y, then over x."""
    if hwin % 2 == 0 or wwin % 2 == 0:
        raise ValueError("windows must be odd")
    image = projection(pixels, method)
    h, w = hwin // 2, wwin // 2
    down = Window.partitionBy("rec_id", "x").orderBy("y").rowsBetween(-h, h)
    across = Window.partitionBy("rec_id", "y").orderBy("x").rowsBetween(-w, w)
    box = image.withColumn("s", F.sum("v").over(down)).withColumn("s", F.sum("s").over(across) / (hwin * wwin)).select("rec_id", F.col("y").alias("cy"), F.col("x").alias("cx"), "s")
    at = image.withColumn("cy", F.greatest(F.lit(h), F.least(F.lit(height - 1 - h), F.col("y")))).withColumn("cx", F.greatest(F.lit(w), F.least(F.lit(width - 1 - w), F.col("x"))))
    return at.join(box, ["rec_id", "cy", "cx"]).select("rec_id", "y", "x", F.try_divide("v", "s").alias("v"))
