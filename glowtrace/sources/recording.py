"""Recording folders: lookup, XML metadata, voltage tables, TIFF frames, and movies put together from them.

Files are read by Spark (``binaryFile`` and ``csv``), so they may lie in any store that Spark reads; one file is parsed in one
task, and any number of recordings is read at once.
"""

from __future__ import annotations

import datetime as dt
import warnings
import xml.etree.ElementTree as ET
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glowtrace.errors import RecordingError, XmlStructureError
from glowtrace.operators.resample import trigger_times
from glowtrace.sources import tiff
from glowtrace.sources.scratch import checkpointed

# The names of recording types, and the types that folders are named by.
TYPES = {
    "tseries": "TSeries",
    "tseries_2channel": "TSeries",
    "zseries": "ZSeries",
    "singleimage": "SingleImage",
}
FOLDER_TYPES = ("TSeries", "ZSeries", "SingleImage")
#: Tables of a row a recording are broadcast up to this many.
BROADCAST_RECORDINGS = 100_000


def find_recording(spark: SparkSession, folders: str | Sequence[str], kind: str, extension: str | int, date: dt.date | str, days_before: int = 0, date_format: str = "%m%d%Y", ext_fill: int = 3, pattern: str = "{recording_type}-{date}-????-{file_extension}", errors: str = "raise") -> str | None:
    """The folder of a recording by type, date and number, looked for in each folder from the date back; the search stops at
    the first folder with exactly one match. None without a match unless ``errors`` is raise; several are an error."""
    kind = TYPES.get(kind, kind)
    if kind not in FOLDER_TYPES:
        raise RecordingError(f"unknown recording type {kind!r}")
    day = dt.datetime.strptime(date, date_format).date() if isinstance(date, str) else date
    jvm, conf, found = spark._jvm, spark._jsc.hadoopConfiguration(), []
    for back in range(days_before + 1):
        name = pattern.format(recording_type=kind, date=(day - dt.timedelta(days=back)).strftime(date_format), file_extension=str(extension).zfill(ext_fill))
        for folder in [folders] if isinstance(folders, str) else folders:
            path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
            found = [s.getPath().toString() for s in path.getFileSystem(conf).globStatus(path) or []]
            if len(found) == 1:
                return found[0]
    if len(found) > 1:
        raise RecordingError(f"{len(found)} recordings match: {found}")
    if errors == "raise":
        raise RecordingError("no recording matches")
    if errors == "warn":
        warnings.warn("no recording matches", stacklevel=2)
    return None


def shard_values(shard: ET.Element) -> dict[str, str]:
    """A state shard as a flat map: key, key + index, key + index + subindex."""
    out: dict[str, str] = {}
    for value in shard:
        if value.tag != "PVStateValue":
            raise XmlStructureError(f"unknown element {value.tag}")
        key = value.attrib["key"]
        if "value" in value.attrib:
            out[key] = value.attrib["value"]
            continue
        for child in value:
            if child.tag == "IndexedValue":
                out[key + child.attrib["index"]] = child.attrib["value"]
            elif child.tag == "SubindexedValues":
                for sub in child:
                    if sub.tag != "SubindexedValue":
                        raise XmlStructureError(f"unknown element {sub.tag}")
                    out[key + child.attrib["index"] + sub.attrib["subindex"]] = sub.attrib["value"]
            else:
                raise XmlStructureError(f"unknown element {child.tag}")
    return out


def _attributes(root: ET.Element, channel: int | None) -> Iterator[tuple[str, int, int, dict[str, str]]]:
    """(kind, sequence, frame, attributes): one row of settings, then one a frame."""
    tags = [e.tag for e in root]
    if tags[:1] != ["PVStateShard"] and tags[:2] != ["SystemIDs", "PVStateShard"]:
        raise XmlStructureError("the state shard must come first, or after the system's ids")
    system = {"SystemID": root[0].attrib["SystemID"]} if root[0].tag == "SystemIDs" and "SystemID" in root[0].attrib else {}
    yield "settings", -1, -1, shard_values(root.find("PVStateShard")) | system | {"date": root.attrib.get("date", "")}
    for s, sequence in enumerate(root.iter("Sequence")):
        outer = dict(sequence.attrib)
        for tag, suffix in (("VoltageRecording", "Vin"), ("VoltageOutput", "Vout")):
            parts = sequence.findall(tag)
            if len(parts) > 1:
                raise XmlStructureError(f"several {tag} in a sequence")
            outer |= {k + suffix: v for p in parts for k, v in p.attrib.items()}
        for f, frame in enumerate(sequence.findall("Frame")):
            extra, files, shards = frame.findall("ExtraParameters"), frame.findall("File"), frame.findall("PVStateShard")
            if len(extra) != 1 or len(shards) > 1:
                raise XmlStructureError("a frame has one ExtraParameters and one shard at most")
            if channel is None and len(files) != 1:
                raise XmlStructureError(f"{len(files)} files in a frame: name a channel")
            chosen = files if channel is None else [x for x in files if x.attrib.get("channel") == str(channel)]
            if not chosen:
                raise RecordingError(f"no file of channel {channel}")
            yield "frame", s, f, dict(frame.attrib) | dict(extra[0].attrib) | dict(chosen[0].attrib) | (shard_values(shards[0]) if shards else {}) | outer


def read_xml(spark: SparkSession, path: str | list[str], channel: int | None = None) -> DataFrame:
    """(rec_id, kind, sequence, frame, attrs) of XML files: a row of settings each, and one a frame. Later sources of an
    attribute win, a sequence's attributes over its frames'. rec_id is the file's folder."""
    if channel is not None and not isinstance(channel, int):
        raise NotImplementedError("a channel is a whole number or None")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows = list(_attributes(ET.fromstring(content), channel))
                yield pd.DataFrame(rows, columns=["kind", "sequence", "frame", "attrs"]).assign(rec_id=name.rsplit("/", 2)[-2])[["rec_id", "kind", "sequence", "frame", "attrs"]]

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, "rec_id string, kind string, sequence int, frame int, attrs map<string,string>")


def typed(value):
    """(as_long, as_double, as_text): the first reading that fits."""
    whole, real = F.expr(f"try_cast({value} as bigint)"), F.expr(f"try_cast({value} as double)")
    return whole.alias("as_long"), F.when(whole.isNull(), real).alias("as_double"), F.when(whole.isNull() & real.isNull(), F.col(value)).alias("as_text")


def long_attributes(meta: DataFrame) -> DataFrame:
    """(rec_id, kind, sequence, frame, key, value)."""
    return meta.select("rec_id", "kind", "sequence", "frame", F.explode("attrs").alias("key", "value"))


def settings(meta: DataFrame) -> DataFrame:
    """(rec_id, key, value, as_long, as_double, as_text): settings, and frame attributes with one value in all frames that
    the settings lack."""
    rows = long_attributes(meta)
    own = rows.where("kind = 'settings'").select("rec_id", "key", "value")
    one = rows.where("kind = 'frame'").groupBy("rec_id", "key").agg(F.min("value").alias("value"), F.max("value").alias("hi")).where("value = hi").drop("hi")
    promoted = one.join(own, ["rec_id", "key"], "left_anti")
    return own.unionByName(promoted).select("rec_id", "key", "value", *typed("value"))


def frame_table(meta: DataFrame) -> DataFrame:
    """(rec_id, plane, t_idx, ts, filename, attrs): frames in order; a plane is a frame's index, t_idx counts within it."""
    rows = meta.where("kind = 'frame'").select("rec_id", "sequence", "frame", F.expr("try_cast(attrs['index'] as int)").alias("plane"), F.expr("try_cast(attrs['absoluteTime'] as double)").alias("ts"), F.expr("attrs['filename']").alias("filename"), "attrs")
    order = Window.partitionBy("rec_id", "plane").orderBy("sequence", "frame")
    return rows.withColumn("t_idx", (F.row_number().over(order) - 1).cast("long")).drop("sequence", "frame")


def read_tiffs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(rec_id, filename, h, w, pix) of TIFF files; a file is a row, and files are spread over tasks by Spark."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            images = [tiff.decode(c) for c in batch["content"]]
            names = batch["path"].str.rsplit("/", n=2)
            yield pd.DataFrame({"rec_id": names.str[-2], "filename": names.str[-1], "h": [i.shape[0] for i in images], "w": [i.shape[1] for i in images], "pix": [i.ravel().astype(float) for i in images]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, "rec_id string, filename string, h int, w int, pix array<double>")


def read_voltage(spark: SparkSession, path: str, offset: float | dict[str, float] | DataFrame = 0.0, time: Sequence[str] = ("Time(ms)",), value: Sequence[str] = ("trigger",)) -> DataFrame:
    """(ts, value) of voltage tables moved by ``offset`` seconds; with an offset for each recording, a dictionary or a table
    (rec_id, offset), (rec_id, ts, value), the recording being the table's folder, or the only one there is. A table whose
    recording has no offset is an error."""
    rows = spark.read.option("header", True).csv(path)
    if isinstance(offset, dict):
        offset = spark.createDataFrame([(k, float(v)) for k, v in offset.items()], "rec_id string, offset double")
    if not isinstance(offset, DataFrame):
        return trigger_times(rows, time, value, offset=offset)
    few = offset.limit(2).collect()
    if len(few) == 1:
        rows = rows.withColumn("_rec", F.lit(few[0]["rec_id"])).withColumn("_offset", F.lit(few[0]["offset"]).cast("double"))
    else:
        rows = rows.withColumn("_rec", F.url_decode(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)))
        offsets = offset.select(F.col("rec_id").alias("_rec"), F.col("offset").cast("double").alias("_offset"))
        rows = rows.join(F.broadcast(offsets) if offset.count() <= BROADCAST_RECORDINGS else offsets, "_rec", "left")
    moved = F.coalesce("_offset", F.raise_error(F.concat(F.lit("no absolute voltage time: "), "_rec")).cast("double"))
    return trigger_times(rows, time, value, offset=moved, keep=("_rec",)).withColumnRenamed("_rec", "rec_id")


@dataclass(frozen=True)
class Recording:
    """A recording's tables: frames (rec_id, plane, t_idx, ts, h, w, pix), facts (rec_id, rate, scan_line_rate, fov_x, fov_y,
    imaging_offset), settings and triggers (None without a voltage table)."""

    frames: DataFrame
    facts: DataFrame
    settings: DataFrame
    triggers: DataFrame | None


def load_recording(spark: SparkSession, folder: str, channel: int | None = None, voltage: str | None = None, absolute_trigger_time: bool = True) -> Recording:
    """A recording's folder, of one plane or several; planes are told apart by their frames' index."""
    meta = read_xml(spark, f"{folder}/*.xml", channel)
    table, known = frame_table(meta), settings(meta)
    frames = table.join(read_tiffs(spark, f"{folder}/*.tif"), ["rec_id", "filename"]).select("rec_id", "plane", "t_idx", "ts", "h", "w", "pix")
    got = known.groupBy("rec_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("m"))
    number = lambda k: F.expr(f"try_cast(m['{k}'] as double)")
    first = table.groupBy("rec_id").agg(F.min("ts").alias("imaging_offset"))
    facts = got.join(first, "rec_id").select(
        "rec_id", F.try_divide(F.lit(1.0), number("framePeriod")).alias("rate"), F.try_divide(F.lit(1.0), number("scanLinePeriod")).alias("scan_line_rate"),
        (number("pixelsPerLine") * number("micronsPerPixelXAxis")).alias("fov_x"), (number("linesPerFrame") * number("micronsPerPixelYAxis")).alias("fov_y"), "imaging_offset",
    )
    triggers = None
    if voltage:
        # Every recording's own offset, a row each.
        own = known.where("key = 'absoluteTimeVin'").select("rec_id", F.expr("try_cast(value as double)").alias("offset"))
        offsets = first.select("rec_id").join(own, "rec_id", "left") if absolute_trigger_time else first.select("rec_id", F.lit(0.0).alias("offset"))
        triggers = read_voltage(spark, voltage, checkpointed(spark, offsets))
    return Recording(frames, facts, known, triggers)


def write_movie(frames: DataFrame, path: str) -> None:
    """Frames as Parquet by recording (and plane), in the order of time within files."""
    keys = [c for c in ("rec_id", "plane") if c in frames.columns]
    frames.repartition(*keys, F.expr("t_idx div 4096")).sortWithinPartitions(*keys, "t_idx").write.mode("overwrite").partitionBy(*keys).parquet(path)


def read_movie(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
