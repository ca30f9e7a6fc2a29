"""Streams: causal filters with state, and binning by event time with a watermark."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fir_stream(traces: DataFrame, weights: Sequence[float], key: str = "roi_id") -> DataFrame:
    """(key, t_idx, f): a causal filter over a stream (key, t_idx, f) whose rows of a key come in the order of t_idx from batch
    to batch. The state of a key is its last values, as many as the filter is long."""
    taps = [float(w) for w in weights]

    def step(k, frames, state):
        last = list(state.get[0]) if state.exists else [0.0] * (len(taps) - 1)
        rows = pd.concat(list(frames)).sort_values("t_idx")
        out = []
        for f in rows["f"]:
            last.append(float(f))
            out.append(sum(w * x for w, x in zip(taps, reversed(last), strict=False)))
            del last[: len(last) - len(taps) + 1]
        state.update((last,))
        yield pd.DataFrame({key: [k[0]] * len(out), "t_idx": rows["t_idx"].to_numpy(), "f": out})

    kind = traces.schema[key].dataType.simpleString()
    rows = traces.select(key, F.col("t_idx").cast("long").alias("t_idx"), F.col("f").cast("double").alias("f"))
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, t_idx long, f double", "last array<double>", "append", "NoTimeout")


def bin_stream(events: DataFrame, width: str = "1 hour", late: str = "2 hours", ts: str = "ts", value: str = "value", key: str = "event_type") -> DataFrame:
    """(key, start, n, mean): tumbling bins of event time; rows later than the watermark are dropped by the stream."""
    bins = events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return bins.select(key, F.col("w.start").alias("start"), "n", "mean")


def run_to_table(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """All that the stream has so far, through an exactly-once file sink, as a table."""
    job = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    job.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")
