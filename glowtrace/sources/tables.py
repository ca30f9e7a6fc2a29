"""Logical inputs over the test tables: movies, masks, traces, events and stimuli as plain DataFrames.

Layouts: pixels (rec_id, t_idx, y, x, v), frames (rec_id, t_idx, h, w, pix), roi_mask (rec_id, roi_id, y, x, weight),
traces (rec_id, roi_id, t_idx, ts, f), stimulus (rec_id, t_idx, x, y). Missing values are NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Frames of the test movie are 8 by 8.
SIDE = 8
EPOCH = "timestamp_ntz'2024-01-01 00:00:00'"


def _rec() -> Column:
    return F.lit("r0").alias("rec_id")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    pix = F.transform("embedding", lambda e: F.lit(100.0) + F.lit(10.0) * e.cast("double"))
    return table(spark, sf_dir, "embeddings").select(_rec(), F.col("vec_id").cast("long").alias("t_idx"), F.lit(SIDE).alias("h"), F.lit(SIDE).alias("w"), pix.alias("pix"))


def pixels_of(frames: DataFrame) -> DataFrame:
    """frames to pixels: one row a sample."""
    rows = frames.select("rec_id", "t_idx", "w", F.posexplode("pix").alias("pos", "v"))
    return rows.select("rec_id", "t_idx", F.expr("int(pos div w)").alias("y"), F.expr("pos % w").alias("x"), "v")


def frames_of(pixels: DataFrame) -> DataFrame:
    """pixels to frames: rows of a frame in raster order."""
    cells = F.array_sort(F.collect_list(F.struct("y", "x", "v")))
    return pixels.groupBy("rec_id", "t_idx").agg((F.max("y") - F.min("y") + 1).alias("h"), (F.max("x") - F.min("x") + 1).alias("w"), cells.alias("c")).select("rec_id", "t_idx", "h", "w", F.col("c.v").alias("pix"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels_of(frames(spark, sf_dir))


def grid(spark: SparkSession, side: int = SIDE) -> DataFrame:
    return spark.range(side * side).select(_rec(), F.expr(f"int(id div {side})").alias("y"), F.expr(f"int(id % {side})").alias("x"))


def roi_mask(spark: SparkSession, weighted: bool = False) -> DataFrame:
    """Four 3 by 3 regions inside a ring of background."""
    inner = grid(spark).where("y between 1 and 6 and x between 1 and 6")
    weight = 1 / (1 + F.abs(F.col("y") - 3.5) + F.abs(F.col("x") - 3.5)) if weighted else F.lit(1.0)
    return inner.select("rec_id", F.expr("int((y div 4) * 2 + (x div 4))").alias("roi_id"), "y", "x", weight.alias("weight"))


def seconds(ts: str = "ts") -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, {ts}) / 1e6")


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trace an event type, in the order of time."""
    order = Window.partitionBy("event_type").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("t_idx", (F.row_number().over(order) - 1).cast("long"))
    return rows.select(_rec(), F.col("event_type").alias("roi_id"), "t_idx", seconds().alias("ts"), F.col("value").alias("f"))


def psth_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("event_type = 'signup'")
    return rows.select(_rec(), "event_id", seconds().alias("start"), (F.col("value") * 60).alias("dur"), F.lit(600.0).alias("pause"))


def psth_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'view'").select(_rec(), seconds().alias("ts"), F.col("value").alias("v"))


def stimulus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two pixels of the test movie as stimulus x and response y."""
    return frames(spark, sf_dir).select("rec_id", "t_idx", F.col("pix")[0].alias("x"), F.col("pix")[1].alias("y"))
