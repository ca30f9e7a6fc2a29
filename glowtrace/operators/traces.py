"""Traces of regions: masked means, background, relative change to a rolling or a percentile baseline."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glowtrace.operators.quantiles import exact_percentiles
from glowtrace.operators.windows import KEYS, by, frame_list, padded


def mean_extraction(pixels: DataFrame, mask: DataFrame, weighted: bool = False, nonzero: bool = True, nans: bool = True) -> DataFrame:
    """(rec_id, roi_id, t_idx, f). A plain mask gives the mean of its pixels; a weighted one the mean of value times weight
    over non-zero products, or over the whole frame (pixels outside the mask are zero) if not ``nonzero``. NULL and NaN
    pixels are left out, or with ``nans`` off make the mean NULL."""
    v = F.nanvl(F.col("v"), F.lit(None).cast("double"))
    rows = pixels.withColumn("v", v)
    area = rows.groupBy("rec_id", "t_idx").agg(F.count("*").alias("area")) if weighted and not nonzero else None
    rows = rows.join(mask, ["rec_id", "y", "x"]).withColumn("p", F.col("v") * F.col("weight") if weighted else F.col("v"))
    if weighted and nonzero:
        rows = rows.withColumn("p", F.nullif(F.col("p"), F.lit(0.0)))
    out = rows.groupBy("rec_id", "roi_id", "t_idx").agg(F.sum("p").alias("s"), F.count("p").alias("n"), F.count("*").alias("all"))
    whole = F.lit(True) if nans else F.col("n") == F.col("all")
    if area is not None:
        return out.join(area, ["rec_id", "t_idx"]).select("rec_id", "roi_id", "t_idx", F.when(whole, F.col("s") / F.col("area")).alias("f"))
    return out.select("rec_id", "roi_id", "t_idx", F.when(whole, F.try_divide("s", "n")).alias("f"))


def mean_extraction_frames(frames: DataFrame, mask: DataFrame, width: int) -> DataFrame:
    """As ``mean_extraction`` with a plain mask, on whole frames: pixels are picked inside each frame's array, so no pixel
    row is made and nothing but the masks is shuffled. A region's positions are one array."""
    places = mask.groupBy("rec_id", "roi_id").agg(F.sort_array(F.collect_list((F.col("y") * width + F.col("x")).cast("int"))).alias("at"))
    rows = frames.join(places, "rec_id")
    picked = F.filter(F.transform("at", lambda i: F.get("pix", i)), lambda v: v.isNotNull() & ~F.isnan(v))
    mean = F.aggregate(picked, F.lit(0.0), lambda a, v: a + v, lambda a: F.try_divide(a, F.size(picked)))
    return rows.select("rec_id", "roi_id", "t_idx", mean.alias("f"))


def region_traces(frames: DataFrame, mask: DataFrame, height: int, width: int, dilate: int = 0) -> DataFrame:
    """(rec_id, roi_id, t_idx, f, bg): plain-mask means and the mean of the pixels in no region (grown by ``dilate``), both
    picked from each frame's array in one pass. A recording's masks are one row; frames are never shuffled."""
    at = (F.col("y") * width + F.col("x")).cast("int")
    rois = mask.groupBy("rec_id", "roi_id").agg(F.sort_array(F.collect_list(at)).alias("at")).groupBy("rec_id").agg(F.collect_list(F.struct("roi_id", "at")).alias("rois"))
    grown = dilated(mask, dilate).where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)) if dilate else mask
    free = F.array_except(F.sequence(F.lit(0), F.lit(height * width - 1)), F.collect_set(at))
    places = rois.join(grown.groupBy("rec_id").agg(free.alias("free")), "rec_id")

    def mean(where: Column) -> Column:
        picked = F.filter(F.transform(where, lambda i: F.get("pix", i)), lambda v: v.isNotNull() & ~F.isnan(v))
        state = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"))
        return F.aggregate(picked, state, lambda a, v: F.struct((a["s"] + v).alias("s"), (a["n"] + 1).alias("n")), lambda a: F.try_divide(a["s"], a["n"]))

    rows = frames.join(places, "rec_id").select("rec_id", "t_idx", "pix", mean(F.col("free")).alias("bg"), F.explode("rois").alias("roi"))
    return rows.select("rec_id", "roi.roi_id", "t_idx", mean(F.col("roi.at")).alias("f"), "bg")


def dilated(mask: DataFrame, k: int) -> DataFrame:
    """(rec_id, y, x): pixels within k rows and columns of any region."""
    steps = F.sequence(F.lit(-k), F.lit(k))
    grown = F.flatten(F.transform(steps, lambda dy: F.transform(steps, lambda dx: F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")))))
    return mask.select("rec_id", F.explode(grown).alias("p")).select("rec_id", "p.y", "p.x").distinct()


def background_trace(pixels: DataFrame, mask: DataFrame, dilate: int = 0) -> DataFrame:
    """(rec_id, t_idx, f): the mean of the pixels in no region, regions grown by ``dilate`` first."""
    taken = dilated(mask, dilate) if dilate else mask.select("rec_id", "y", "x").distinct()
    outside = pixels.join(taken, ["rec_id", "y", "x"], "left_anti")
    return outside.groupBy("rec_id", "t_idx").agg(F.avg(F.nanvl("v", F.lit(None).cast("double"))).alias("f"))


def subtract_background(traces: DataFrame, background: DataFrame) -> DataFrame:
    """traces less their background, shifted so that each trace keeps its minimum."""
    return less_background(traces.join(background.select("rec_id", "t_idx", F.col("f").alias("bg")), ["rec_id", "t_idx"]))


def less_background(rows: DataFrame) -> DataFrame:
    """As ``subtract_background`` for rows that carry their background ``bg``."""
    series = Window.partitionBy("rec_id", "roi_id")
    less = F.col("f") - F.col("bg")
    return rows.select("rec_id", "roi_id", "t_idx", (less - (F.min(less).over(series) - F.min("f").over(series))).alias("f"))


def rolling_baseline(traces: DataFrame, w: int, method: str = "mean", keys: Sequence[str] = KEYS) -> DataFrame:
    """traces with ``baseline``: the reducer over w rows around each, series extended by their end values.

    The mean, minimum and maximum need no extended rows: the ends count as often as they would be repeated."""
    left, right = w // 2, -(-w // 2) - 1
    frame, series = by(keys).rowsBetween(-left, right), Window.partitionBy(*keys)
    f = F.nanvl(F.col("f").cast("double"), F.lit(None).cast("double"))
    rows = traces.withColumn("f", f)
    if method == "mean":
        whole = by(keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = rows.withColumn("_n", F.count("*").over(series)).withColumn("_a", F.first("f").over(whole)).withColumn("_b", F.last("f").over(whole))
        before, after = F.greatest(F.lit(0), left - F.col("t_idx")), F.greatest(F.lit(0), F.col("t_idx") + right - (F.col("_n") - 1))
        total = F.coalesce(F.sum("f").over(frame), F.lit(0.0)) + F.coalesce(before * F.col("_a"), F.lit(0.0)) + F.coalesce(after * F.col("_b"), F.lit(0.0))
        count = F.count("f").over(frame) + F.when(F.col("_a").isNotNull(), before).otherwise(0) + F.when(F.col("_b").isNotNull(), after).otherwise(0)
        return rows.withColumn("baseline", F.try_divide(total, count)).drop("_n", "_a", "_b")
    if method in ("min", "max"):
        return rows.withColumn("baseline", getattr(F, method)("f").over(frame))
    if method in ("median", "std"):
        ext = padded(rows, left, right, "edge", keys)
        of = F.percentile("f", 0.5) if method == "median" else F.stddev_pop("f")
        base = ext.select(*keys, "t_idx", of.over(frame).alias("baseline"))
        return rows.join(base, [*keys, "t_idx"])
    raise ValueError(f"unknown reducer {method!r}")


def dfof_rolling(traces: DataFrame, rate: float, window: float = 30, method: str = "mean", keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, t_idx, dfof): change relative to the rolling baseline over ``window`` seconds; NULL where that is 0."""
    rows = rolling_baseline(traces, int(window * rate), method, keys)
    return rows.select(*keys, "t_idx", F.try_divide(F.col("f") - F.col("baseline"), F.col("baseline")).alias("dfof"))


def dfof_percentile(traces: DataFrame, q: float, window: int | None, background: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, t_idx, dfof) = (f - b) / (b + b_background) with a percentile baseline.

    With a window, b is the order statistic of rank int(window * q / 100) in the centred window, ends reflected; without
    one, or for series not longer than it, the linearly interpolated percentile of the series."""
    rows = traces.select(*keys, "t_idx", F.col("f").cast("double").alias("f"))
    if window is None:
        whole = exact_percentiles(rows, keys, "f", [q / 100])
        rows = rows.join(whole.select(*keys, F.col("quantiles")[0].alias("b")), [*keys], "left")
    else:
        short = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") < window)
        short = rows.join(short, [*keys]).groupBy(*keys).agg(F.percentile("f", q / 100).alias("_all"), F.lit(True).alias("_short"))  # fewer rows than a window
        rows = rows.join(order_statistic(rows, window, min(int(window * q / 100), window - 1), keys), [*keys, "t_idx"]).join(short, [*keys], "left")
        rows = rows.withColumn("b", F.when(F.col("_short"), F.col("_all")).otherwise(F.col("b"))).drop("_all", "_short")
    if background is None:
        return rows.select(*keys, "t_idx", F.try_divide(F.col("f") - F.col("b"), F.col("b")).alias("dfof"))
    bg = dfof_baseline(background, q, window)
    return rows.join(bg, ["rec_id", "t_idx"]).select(*keys, "t_idx", F.try_divide(F.col("f") - F.col("b"), F.col("b") + F.col("bg")).alias("dfof"))


def dfof_baseline(background: DataFrame, q: float, window: int | None) -> DataFrame:
    series = background.select("rec_id", F.lit("bg").alias("roi_id"), "t_idx", F.col("f").cast("double").alias("f"))
    if window is None:
        whole = exact_percentiles(series, ["rec_id"], "f", [q / 100])
        return series.join(whole, "rec_id", "left").select("rec_id", "t_idx", F.col("quantiles")[0].alias("bg"))
    return order_statistic(series, window, min(int(window * q / 100), window - 1)).select("rec_id", "t_idx", F.col("b").alias("bg"))


#: Windows up to this size are lists inside Spark; longer ones use a sorted buffer over runs of rows.
LISTED, RUN = 24, 1 << 14


def order_statistic(traces: DataFrame, window: int, rank: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, t_idx, b): the value of ``rank`` in the sorted centred window, ends reflected.

    Long windows are kept sorted while they move over runs of RUN rows, each with the rows around it that its windows
    need, so that a long series is many groups."""
    left, right = window // 2, window - window // 2 - 1
    ext = padded(traces, left, right, "reflect", keys)
    ext = ext.join(traces.groupBy(*keys).agg(F.count("*").alias("_n")), [*keys])
    if window <= LISTED:
        rows = ext.select(*keys, "t_idx", "_n", F.get(F.array_sort(frame_list("f", left, right, keys)), F.lit(rank)).alias("b"))
        return rows.where((F.col("t_idx") >= 0) & (F.col("t_idx") < F.col("_n"))).drop("_n")
    runs = F.sequence(F.floor((F.col("t_idx") - right) / RUN).cast("long"), F.floor((F.col("t_idx") + left) / RUN).cast("long"))
    rows = ext.withColumn("run", F.explode(runs)).where("run >= 0 and run * %d < _n" % RUN)

    def moved(run: pd.DataFrame) -> pd.DataFrame:
        run = run.sort_values("t_idx")
        values, first = run["f"].tolist(), int(run["t_idx"].iloc[0])
        held = sorted(values[:window])
        out = [held[rank]]
        for i in range(window, len(values)):
            held.pop(bisect_left(held, values[i - window]))
            insort(held, values[i])
            out.append(held[rank])
        at = run[[*keys]].iloc[: len(out)].reset_index(drop=True)
        return at.assign(t_idx=range(first + left, first + left + len(out)), b=out)

    fields = ", ".join(f"{k} {t}" for k, t in traces.select(*keys).dtypes)
    return rows.groupBy(*keys, "run").applyInPandas(moved, f"{fields}, t_idx long, b double")


def rolling_dfof_pipeline(frames: DataFrame, mask: DataFrame, rate: float, height: int, width: int, window: float = 30, bg_subtract: bool = True, bg_dilate: int = 0, smooth=None, smooth_before: bool = True) -> DataFrame:
    """(rec_id, roi_id, t_idx, dfof): plain-mask means, background, optional smoothing (a function of traces), rolling dF/F.
    Means and windows share one shuffle by region."""
    traces = region_traces(frames, mask, height, width, bg_dilate)
    traces = less_background(traces) if bg_subtract else traces.drop("bg")
    if smooth and smooth_before:
        traces = smooth(traces)
    out = dfof_rolling(traces, rate, window)
    if smooth and not smooth_before:
        out = smooth(out.withColumnRenamed("dfof", "f")).withColumnRenamed("f", "dfof")
    return out
