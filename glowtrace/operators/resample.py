"""Joins in time: brackets around points, linear interpolation, uniform resampling and event-aligned tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bracket(samples: DataFrame, points: DataFrame, keys: Sequence[str], at: str, chunk: float) -> DataFrame:
    """``points`` with ``prev`` and ``next``, structs (ts, v) of the nearest samples (keys, ts, v) at or before and at or
    after column ``at``; NULL where there is none.

    An as-of join both ways. Samples and points meet in chunks of ``chunk`` seconds; what lies beyond a chunk comes from a
    table with a row a chunk, so a long recording is many small windows."""
    payload = [c for c in points.columns if c not in keys]
    none = F.lit(None)
    s = samples.where("ts is not null and v is not null").select(*keys, F.col("ts").cast("double").alias("_t"), F.struct(F.col("ts").cast("double").alias("ts"), F.col("v").cast("double").alias("v")).alias("_s"), *[none.cast(points.schema[c].dataType).alias(c) for c in payload])
    p = points.select(*keys, F.col(at).cast("double").alias("_t"), none.cast("struct<ts:double,v:double>").alias("_s"), *payload)
    rows = s.withColumn("_q", F.lit(False)).union(p.withColumn("_q", F.lit(True))).withColumn("_c", F.floor(F.col("_t") / chunk))
    ends = rows.groupBy(*keys, "_c").agg(F.min("_s").alias("lo"), F.max("_s").alias("hi"))
    order = Window.partitionBy(*keys).orderBy("_c")
    ends = ends.withColumn("_earlier", F.last("hi", True).over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_later", F.first("lo", True).over(order.rowsBetween(1, Window.unboundedFollowing))).drop("lo", "hi")
    inside = Window.partitionBy(*keys, "_c")
    back = inside.orderBy("_t", "_q").rowsBetween(Window.unboundedPreceding, 0)
    ahead = inside.orderBy(F.desc("_t"), "_q").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("prev", F.last("_s", True).over(back)).withColumn("next", F.last("_s", True).over(ahead)).where("_q")
    rows = rows.join(ends, [*keys, "_c"])
    return rows.select(*keys, *payload, F.coalesce("prev", "_earlier").alias("prev"), F.coalesce("next", "_later").alias("next"))


def lerp(at: Column, prev: Column, nxt: Column) -> Column:
    """The value at a time between two samples; NULL outside."""
    rise = prev["v"] + (nxt["v"] - prev["v"]) * F.try_divide(at - prev["ts"], nxt["ts"] - prev["ts"])
    return F.when(prev["ts"] == at, prev["v"]).when(nxt["ts"] == at, nxt["v"]).otherwise(rise)


def interp_traces(traces: DataFrame, rate: float = 25, keys: Sequence[str] = ("rec_id", "roi_id"), chunk: float | None = None) -> DataFrame:
    """(keys, t_idx, ts, f): traces on a uniform grid from their first time on, the last time excluded."""
    span = traces.groupBy(*keys).agg(F.min("ts").alias("t0"), F.max("ts").alias("tn"))
    n = F.ceil((F.col("tn") - F.col("t0")) * rate).cast("long")
    grid = span.where(n > 0).select(*keys, "t0", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("t_idx")).withColumn("ts", F.col("t0") + F.col("t_idx") / rate)
    found = bracket(traces.withColumnRenamed("f", "v"), grid.select(*keys, "t_idx", "ts"), keys, "ts", chunk or 1000 / rate)
    return found.select(*keys, "t_idx", "ts", lerp(F.col("ts"), F.col("prev"), F.col("next")).alias("f"))


def psth(samples: DataFrame, events: DataFrame, before: float = 0.5, after: float = 0.0, dt: float = 0.1, start_key: str = "synced_delay", dur_key: str | None = "dur", pause_key: str | None = "pause", chunk: float | None = None) -> DataFrame:
    """The event-aligned long table: for every event (rec_id, start and its other columns) a row each ``dt`` from ``before``
    its start to ``after`` + duration + pause later, with time, the interpolated signal, _start and _after. Columns come in the
    order of their names.

    A whole table at once: events are exploded to grid points and bracketed by samples (rec_id, ts, v); points outside the
    signal are NULL. Events whose end doesn't lie after their start are an error at run time."""
    before, dt = float(before), float(dt)
    extra = sum((F.coalesce(F.col(k).cast("double"), F.lit(0.0)) for k in (dur_key, pause_key) if k), F.lit(float(after)))
    rows = events.withColumn("_start", F.col(start_key) - before).withColumn("_after", extra)
    rows = rows.withColumn("_after", F.when(F.col("_after") > 0, F.col("_after")).otherwise(F.raise_error("an event's after, duration and pause must add up to more than 0").cast("double")))
    n = F.ceil((F.col("_after") + dt + before) / dt).cast("long")
    rows = rows.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).withColumn("_at", F.col("_start") + F.col("_k") * dt)
    found = bracket(samples, rows, ["rec_id"], "_at", chunk or 100 * dt)
    found = found.withColumn("time", F.col("_k") * dt - before).withColumn("psth", lerp(F.col("_at"), F.col("prev"), F.col("next")))
    return found.select(*sorted(set(found.columns) - {"_k", "_at", "prev", "next"}))


def trigger_times(voltage: DataFrame, time: Sequence[str] = ("Time(ms)",), value: Sequence[str] = ("trigger",), unit: float = 1e-3, offset: Column | float = 0.0, keep: Sequence[str] = ()) -> DataFrame:
    """(keep, ts, value) of a voltage table: blanks around its column names are ignored, exactly one of the alternative names must
    exist, and times are scaled and moved by ``offset`` seconds."""
    named = voltage.toDF(*[c.strip() for c in voltage.columns])
    t, v = one_column(named, time), one_column(named, value)
    offset = offset if isinstance(offset, Column) else F.lit(float(offset))
    return named.select(*keep, (F.col(f"`{t}`").cast("double") * unit + offset).alias("ts"), F.col(f"`{v}`").cast("double").alias("value"))


def one_column(df: DataFrame, names: Sequence[str]) -> str:
    found = [c for c in df.columns if c in set(names)]
    if len(found) != 1:
        raise ValueError(f"exactly one of {list(names)} must be a column; found {found}")
    return found[0]


def rate_of(rows: DataFrame, keys: Sequence[str] = ("rec_id", "roi_id")) -> DataFrame:
    return rows.groupBy(*keys).agg(F.try_divide(F.count("*") - 1, F.max("ts") - F.min("ts")).alias("rate"))
