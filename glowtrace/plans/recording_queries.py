"""Recordings written as folders of images, voltage tables and XML files, and read back as a data source."""

import uuid

from pyspark.sql import functions as F

from glowtrace.plans.catalogue import MOVIE, SECONDS, query, r8
from glowtrace.sources import array_files as arrays
from glowtrace.sources import recording_source as source
from glowtrace.sources import tables as src
from glowtrace.sources.scratch import shared_folder

#: The test movie dealt to three recordings of two planes each, in the order of frames.
DEALT = f"""{MOVIE}, f AS (SELECT vec_id, 'TSeries-' || vec_id % 3 AS recording, CAST(vec_id // 3 % 2 + 1 AS INTEGER) AS plane FROM embeddings),
  d AS (SELECT *, row_number() OVER (PARTITION BY recording, plane ORDER BY vec_id) - 1 AS t_idx, vec_id * 0.1 AS ts FROM f)"""


def written(spark, sf):
    """The folder of the three recordings."""
    rec = lambda c: F.concat(F.lit("TSeries-"), (F.col(c) % 3).cast("string"))
    movie = src.frames(spark, sf).select(rec("t_idx").alias("rec_id"), F.expr("int(t_idx div 3 % 2 + 1)").alias("plane"), F.expr("t_idx div 6").alias("t_idx"), (F.col("t_idx") * 0.1).alias("ts"), "h", "w", "pix")
    triggers = src.table(spark, sf, "events").select(rec("event_id").alias("rec_id"), src.seconds().alias("ts"), "value")
    entries = {"framePeriod": F.lit(0.5) * (F.col("id") + 1), "scanLinePeriod": F.lit(0.25), "pixelsPerLine": F.lit(8), "linesPerFrame": F.lit(8), "micronsPerPixelXAxis": F.lit(1.5), "micronsPerPixelYAxis": F.lit(2), "pmtGain1": F.col("id") * 10}
    pairs = [F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in entries.items()]
    pairs.append(F.struct(F.lit("date").alias("key"), F.concat(F.lit("1/"), (F.col("id") + 2).cast("string"), F.lit("/2024 3:04:05 PM")).alias("value")))
    settings = spark.range(3).select(rec("id").alias("rec_id"), F.inline(F.array(*pairs)))
    path = f"{shared_folder(spark)}/recordings-{uuid.uuid4().hex}"
    source.write_recordings(movie, path, settings, triggers)
    return path


@query("recording_frames", f"WITH {DEALT} SELECT recording, plane, d.t_idx, {r8('ts', 'ts')}, y, x, {r8('v', 'v')} FROM d JOIN m ON m.t_idx = vec_id")
def recording_frames(spark, sf):
    rows = source.read_recordings(spark, written(spark, sf))
    pixels = rows.select(F.col("rec_id").alias("recording"), "plane", "t_idx", "ts", "w", F.posexplode("pix").alias("pos", "v"))
    return pixels.select("recording", "plane", "t_idx", "ts", F.expr("int(pos div w)").alias("y"), F.expr("pos % w").alias("x"), "v")


@query("recording_selection", f"WITH {DEALT} SELECT recording, plane, t_idx, {r8('ts', 'ts')} FROM d WHERE recording IN ('TSeries-1', 'TSeries-2') AND plane = 2 AND t_idx >= 3 AND ts < 20")
def recording_selection(spark, sf):
    """Some columns of some frames; no image is opened."""
    rows = source.read_recordings(spark, written(spark, sf), columns="rec_id string, plane int, t_idx long, ts double", recordings=["TSeries-1", "TSeries-2"], planes=[2], frames=(3, None), seconds=(None, 20))
    return rows.withColumnRenamed("rec_id", "recording")


@query("recording_triggers", f"SELECT 'TSeries-' || event_id % 3 AS recording, {r8(SECONDS, 'ts')}, {r8('value', 'value')} FROM events")
def recording_triggers(spark, sf):
    return source.read_recordings(spark, written(spark, sf), "triggers").withColumnRenamed("rec_id", "recording")


@query("recording_facts", f"""WITH {DEALT}, o AS (SELECT recording, min(ts) AS imaging_offset FROM d GROUP BY 1)
  SELECT 'TSeries-' || k AS recording, TIMESTAMP '2024-01-02 15:04:05' + to_days(CAST(k AS INTEGER)) AS date, {r8('1 / (0.5 * (k + 1))', 'rate')}, CAST(4 AS DOUBLE) AS scan_line_rate,
    CAST(12 AS DOUBLE) AS fov_x, CAST(16 AS DOUBLE) AS fov_y, {r8('imaging_offset', 'imaging_offset')}
  FROM (SELECT unnest(range(3)) AS k) LEFT JOIN o ON o.recording = 'TSeries-' || k""")
def recording_facts(spark, sf):
    """What the settings say of each recording."""
    at = written(spark, sf)
    rows = source.facts(source.read_recordings(spark, at, "settings"), source.read_recordings(spark, at, columns="rec_id string, ts double"))
    return rows.withColumn("date", F.col("date").cast("timestamp_ntz")).withColumnRenamed("rec_id", "recording")


def dealt(spark, sf):
    """Frames of the three recordings, as many in each plane."""
    rows = source.read_recordings(spark, written(spark, sf))
    least = rows.groupBy("rec_id", "plane").agg(F.count("*").alias("n")).groupBy("rec_id").agg(F.min("n").alias("n"))
    return rows.join(least, "rec_id").where("t_idx < n").drop("n")


@query("numpy_files", f"WITH {DEALT} SELECT recording || '/plane' || plane || '.npy' AS file, d.t_idx, y, x, {r8('CAST(CAST(v AS FLOAT) AS DOUBLE)', 'v')} FROM d JOIN m ON m.t_idx = vec_id")
def numpy_files(spark, sf):
    """The recordings as NumPy files of single precision, a plane each, and read back."""
    path = f"{shared_folder(spark)}/arrays-{uuid.uuid4().hex}"
    arrays.save_npy(source.read_recordings(spark, written(spark, sf)), path)
    rows = arrays.read_arrays(spark, path).select("file", "t_idx", "w", F.posexplode("pix").alias("pos", "v"))
    return rows.select("file", "t_idx", F.expr("int(pos div w)").alias("y"), F.expr("pos % w").alias("x"), "v")


@query("matlab_files", f"""WITH {DEALT}, n AS (SELECT recording, min(n) AS n FROM (SELECT recording, plane, count(*) AS n FROM d GROUP BY 1, 2) GROUP BY 1)
  SELECT recording || '.mat' AS file, plane, d.t_idx, y, x, {r8('v', 'v')} FROM d JOIN n USING (recording) JOIN m ON m.t_idx = vec_id WHERE d.t_idx < n""")
def matlab_files(spark, sf):
    """The recordings as stacks of planes in MATLAB files, and read back."""
    path = f"{shared_folder(spark)}/arrays-{uuid.uuid4().hex}"
    arrays.save_mat(dealt(spark, sf), path)
    rows = arrays.read_arrays(spark, path).select("file", "plane", "t_idx", "w", F.posexplode("pix").alias("pos", "v"))
    return rows.select("file", "plane", "t_idx", F.expr("int(pos div w)").alias("y"), F.expr("pos % w").alias("x"), "v")
