"""Streams over the events table, run to the end of what is there."""

import uuid

from pyspark.sql import functions as F

from glowtrace.plans.catalogue import TRACES, query, r8
from glowtrace.plans.signal_queries import WEIGHTS
from glowtrace.sources import tables as src
from glowtrace.sources.scratch import shared_folder
from glowtrace.streaming import causal


def folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("stream_hourly_bins", f"SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n, {r8('avg(value)', 'mean')} FROM events GROUP BY 1, 2")
def stream_hourly_bins(spark, sf):
    """All bins of a stream of files: those that the watermark closes go to an exactly-once table, one late row more closes
    all the others."""
    at = folder(spark, "bins")
    table = src.table(spark, sf, "events").select("ts", "event_type", "value")
    table.write.parquet(f"{at}/in/events")
    # A day after the last event; its own bin stays open.
    end = table.agg((F.max("ts") + F.expr("interval 1 day")).alias("ts"), F.lit(None).cast("string").alias("event_type"), F.lit(None).cast("double").alias("value"))
    events = spark.readStream.schema(table.schema).option("recursiveFileLookup", True).parquet(f"{at}/in").withColumn("ts", F.col("ts").cast("timestamp"))
    causal.run_to_table(causal.bin_stream(events), f"{at}/run")
    end.write.parquet(f"{at}/in/end")
    closed = causal.run_to_table(causal.bin_stream(events), f"{at}/run")
    return closed.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_fir", f"WITH {TRACES} SELECT roi_id, t_idx, {r8(' + '.join(f'{h} * coalesce(lag(f, {j}) OVER z, 0)' for j, h in enumerate(WEIGHTS)), 'f')} FROM t WINDOW z AS (PARTITION BY roi_id ORDER BY t_idx)")
def stream_fir(spark, sf):
    """The traces as a stream of files, filtered with state."""
    at = folder(spark, "fir")
    traces = src.traces(spark, sf)
    traces.select("roi_id", "t_idx", "f").write.parquet(f"{at}/in")
    stream = spark.readStream.schema("roi_id string, t_idx long, f double").parquet(f"{at}/in")
    return causal.run_to_table(causal.fir_stream(stream, WEIGHTS), f"{at}/run")
