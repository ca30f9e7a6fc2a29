"""Recording folders as a data source of Spark: ``spark.read.format("recording")`` and ``df.write.format("recording")``.

A folder is a recording if it holds an XML file; that is written last, so half-written recordings aren't seen. The folder is
listed on the driver, a name a recording; everything else happens in tasks. Stores are those that Arrow's file systems reach
(local and mounted folders, HDFS, S3, GCS); ``sources.recording`` reads the same files through Spark's own readers instead.
"""

from __future__ import annotations

import io
import json
import re
import uuid
import xml.etree.ElementTree as ET
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from fnmatch import fnmatch
from xml.sax.saxutils import quoteattr

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from glowtrace.errors import RecordingError
from glowtrace.sources import tiff
from glowtrace.sources.recording import _attributes

SCHEMAS = {
    "frames": "rec_id string, plane int, t_idx long, ts double, filename string, h int, w int, pix array<double>",
    "settings": "rec_id string, key string, value string",
    "triggers": "rec_id string, ts double, value double",
}
#: Bytes of XML, so about how many frames, for which a task is planned, and the most tasks that read one recording's XML.
SLICE_XML_BYTES, MOST_SLICES = 128 << 10, 64
#: Bytes of decoded frames in an Arrow batch.
BATCH_BYTES = 16 << 20


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path.rstrip("/")
    system, inner = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    return system, inner.rstrip("/")


def content(system: fs.FileSystem, path: str) -> bytes:
    with system.open_input_stream(path) as f:
        return f.read()


@dataclass
class Slice(InputPartition):
    """Part ``part`` of ``parts`` of the recording in ``folder``, whose XML file is ``xml``."""

    folder: str
    xml: str
    part: int = 0
    parts: int = 1


@dataclass
class Wanted:
    """What the options choose: recordings, planes, and half-open ranges of t_idx and ts. They are options and not pushed filters,
    since those stick to a frame that is used again without them (Spark 4.1), which then lacks rows."""

    recordings: set[str] | None = None
    planes: set[int] | None = None
    frames: tuple[float | None, float | None] = (None, None)
    seconds: tuple[float | None, float | None] = (None, None)

    @classmethod
    def of(cls, options: dict) -> Wanted:
        given = {k: json.loads(options[k]) for k in ("recordings", "planes", "frames", "seconds") if options.get(k) is not None}
        sets = {k: set(given[k]) for k in ("recordings", "planes") if k in given}
        return cls(**sets, **{k: tuple(given[k]) for k in ("frames", "seconds") if k in given})

    def has(self, plane: int | None, t_idx: int, ts: float | None) -> bool:
        """Whether a frame is chosen; one without a plane or time isn't where those are chosen by."""
        if self.planes is not None and plane not in self.planes:
            return False
        for v, (low, high) in ((t_idx, self.frames), (ts, self.seconds)):
            if (low is not None or high is not None) and (v is None or (low is not None and v < low) or (high is not None and v >= high)):
                return False
        return True


def number(text: str | None, kind=float):
    try:
        return kind(text)
    except (TypeError, ValueError):
        return None


class RecordingReader(DataSourceReader):
    """A task reads a slice of one recording's frames; only the columns of ``schema`` are made, and without ``pix``, ``h`` and
    ``w`` no image is opened. Recordings are chosen among folders, frames before their images are opened."""

    def __init__(self, options: dict, schema: StructType):
        options = {k.lower(): v for k, v in options.items()}
        self.path, self.table, self.columns = options["path"], options.get("table", "frames"), schema.names
        if self.table not in SCHEMAS:
            raise RecordingError(f"no table {self.table!r}: one of {sorted(SCHEMAS)}")
        known = re.findall(r"(\w+) [\w<>]+", SCHEMAS[self.table])
        if unknown := set(self.columns) - set(known):
            raise RecordingError(f"{self.table} have no columns {sorted(unknown)}")
        channel = options.get("channel")
        self.channel = None if channel is None else int(channel)
        self.pattern, self.absolute = options.get("pattern", "*"), options.get("absolutetriggertime", "true").lower() == "true"
        self.time, self.value = ([c.strip() for c in options.get(k, d).split(",")] for k, d in (("timecolumns", "Time(ms)"), ("valuecolumns", "trigger")))
        self.wanted = Wanted.of(options)

    def _xml(self, system: fs.FileSystem, folder: str) -> fs.FileInfo | None:
        """A folder's XML file: the one of its own name, or the only one."""
        own = system.get_file_info(f"{folder}/{folder.rsplit('/', 1)[-1]}.xml")
        if own.type == fs.FileType.File:
            return own
        found = [i for i in system.get_file_info(fs.FileSelector(folder)) if i.type == fs.FileType.File and i.base_name.lower().endswith(".xml")]
        if len(found) > 1:
            raise RecordingError(f"several XML files in {folder}")
        return found[0] if found else None

    def partitions(self) -> list[InputPartition]:
        system, path = store_of(self.path)
        one = self._xml(system, path)
        folders = [path] if one else sorted(i.path for i in system.get_file_info(fs.FileSelector(path)) if i.type == fs.FileType.Directory)
        out = []
        for folder in folders:
            name = folder.rsplit("/", 1)[-1]
            if name.startswith(("_", ".")) or not fnmatch(name, self.pattern) or (self.wanted.recordings is not None and name not in self.wanted.recordings):
                continue
            xml = one if one else self._xml(system, folder)
            if xml is None:
                continue
            parts = min(MOST_SLICES, -(-xml.size // SLICE_XML_BYTES)) if self.table == "frames" else 1
            out += [Slice(folder, xml.path, k, parts) for k in range(max(1, parts))]
        return out

    def read(self, partition: Slice | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no recording was chosen
            return
        system, _ = store_of(self.path)
        rows = _attributes(ET.fromstring(content(system, partition.xml)), self.channel)
        rec = partition.folder.rsplit("/", 1)[-1]
        if self.table == "frames":
            yield from self._frames(system, rec, partition, [attrs for kind, _, _, attrs in rows if kind == "frame"])
            return
        settings, common = {}, None
        for kind, _, _, attrs in rows:
            if kind == "settings":
                settings = attrs
            else:
                common = dict(attrs) if common is None else {k: v for k, v in common.items() if attrs.get(k) == v}
        settings = (common or {}) | settings
        if self.table == "settings":
            table = {"rec_id": [rec] * len(settings), "key": list(settings), "value": list(settings.values())}
            yield self._batch({"rec_id": pa.string(), "key": pa.string(), "value": pa.string()}, table)
        else:
            yield from self._triggers(system, rec, partition.folder, settings)

    def _batch(self, kinds: dict[str, pa.DataType], values: dict[str, list]) -> pa.RecordBatch:
        names = [c for c in self.columns]
        return pa.RecordBatch.from_arrays([values[c] if isinstance(values[c], pa.Array) else pa.array(values[c], kinds[c]) for c in names], names)

    def _triggers(self, system: fs.FileSystem, rec: str, folder: str, settings: dict[str, str]) -> Iterator[pa.RecordBatch]:
        offset, name = number(settings.get("absoluteTimeVin")), settings.get("dataFileVin")
        if offset is None or not name:
            raise RecordingError(f"{rec} has no voltage recording")
        table = pd.read_csv(io.BytesIO(content(system, f"{folder}/{name}"))).rename(columns=lambda c: str(c).strip())
        chosen = []
        for names in (self.time, self.value):
            found = [c for c in table.columns if c in names]
            if len(found) != 1:
                raise RecordingError(f"exactly one of {names} must be a column of {name}; found {found}")
            chosen.append(table[found[0]].to_numpy(float))
        ts = chosen[0] * 1e-3 + (offset if self.absolute else 0.0)
        for i in range(0, len(ts), 1 << 20):
            part = slice(i, i + (1 << 20))
            yield self._batch({"rec_id": pa.string(), "ts": pa.float64(), "value": pa.float64()}, {"rec_id": [rec] * len(ts[part]), "ts": ts[part], "value": chosen[1][part]})

    def _frames(self, system: fs.FileSystem, rec: str, partition: Slice, frames: list[dict[str, str]]) -> Iterator[pa.RecordBatch]:
        kinds = {"rec_id": pa.string(), "plane": pa.int32(), "t_idx": pa.int64(), "ts": pa.float64(), "filename": pa.string(), "h": pa.int32(), "w": pa.int32()}
        low, high = (len(frames) * k // partition.parts for k in (partition.part, partition.part + 1))
        counted: Counter = Counter()
        opened = not {"pix", "h", "w"}.isdisjoint(self.columns)
        held = {c: [] for c in self.columns}
        pix, size = [], 0

        def batch() -> pa.RecordBatch:
            values = dict(held)
            if "pix" in values:
                cuts = np.concatenate([[0], np.cumsum([p.size for p in pix])]).astype(np.int32)
                values["pix"] = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate([p.ravel() for p in pix]).astype(np.float64)))
            return self._batch(kinds, values)

        for k, attrs in enumerate(frames):
            plane = number(attrs.get("index"), int)
            row = {"rec_id": rec, "plane": plane, "t_idx": counted[plane], "ts": number(attrs.get("absoluteTime")), "filename": attrs.get("filename")}
            counted[plane] += 1
            if not low <= k < high or not self.wanted.has(plane, row["t_idx"], row["ts"]):
                continue
            if opened:
                image = tiff.decode(content(system, f"{partition.folder}/{row['filename']}"), (number(attrs.get("page"), int) or 1) - 1)
                row |= {"h": image.shape[0], "w": image.shape[1]}
                pix.append(image)
                size += image.size * 8
            size += 200
            for c in self.columns:
                if c != "pix":
                    held[c].append(row[c])
            if size >= BATCH_BYTES:
                yield batch()
                held, pix, size = {c: [] for c in self.columns}, [], 0
        if size:
            yield batch()


class RecordingWriter(DataSourceArrowWriter):
    """Images by rows (rec_id, plane, t_idx, h, w, pix), or with the option ``table`` = ``files`` any files by rows (rec_id,
    name, content). A file is written under another name and then moved, so tasks that run twice do no harm."""

    def __init__(self, options: dict):
        self.path, self.table = options["path"], options.get("table", "frames")
        self.kind = np.dtype(options.get("samples", "float64"))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, path = store_of(self.path)
        made: set[str] = set()
        for batch in iterator:
            names = batch.column("rec_id").to_pylist()
            if self.table == "files":
                files = ((f"{r}/{n}", c) for r, n, c in zip(names, batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True))
            else:
                files = self._images(names, batch)
            for name, data in files:
                folder = name.rsplit("/", 1)[0]
                if folder not in made:
                    system.create_dir(f"{path}/{folder}", recursive=True)
                    made.add(folder)
                at = f"{path}/{folder}/_{uuid.uuid4().hex}"
                with system.open_output_stream(at) as f:
                    f.write(data)
                system.move(at, f"{path}/{name}")
        return WriterCommitMessage()

    def _images(self, names: list[str], batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
        plane, t, h, w, pix = (batch.column(c) for c in ("plane", "t_idx", "h", "w", "pix"))
        for i, rec in enumerate(names):
            image = pix[i].values.to_numpy(zero_copy_only=False).reshape(h[i].as_py(), w[i].as_py())
            if self.kind.kind in "ui":
                image = np.rint(image)
            yield f"{rec}/{image_name(plane[i].as_py(), t[i].as_py())}", tiff.encode(image.astype(self.kind))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Nothing is left to do: a recording is seen once its XML file is there."""


def image_name(plane: int, t_idx: int) -> str:
    return f"plane{plane}_{t_idx:08d}.tif"


class RecordingSource(DataSource):
    """Options for reading: ``path`` (a recording, or a folder of recordings), ``table`` (frames, settings or triggers),
    ``channel``, ``pattern`` of folder names, JSON lists ``recordings`` and ``planes`` and half-open ranges ``frames`` and
    ``seconds`` (a pair, null for no bound), ``absoluteTriggerTime``, ``timeColumns`` and ``valueColumns``."""

    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "frames")]

    def reader(self, schema: StructType) -> RecordingReader:
        return RecordingReader(dict(self.options.items()), schema)

    def writer(self, schema: StructType, overwrite: bool) -> RecordingWriter:
        if overwrite:
            raise RecordingError("recordings are added to a folder, not overwritten")
        return RecordingWriter(dict(self.options.items()))


def read_recordings(
    spark: SparkSession, path: str, table: str = "frames", columns: str | None = None, recordings: Sequence[str] | None = None, planes: Sequence[int] | None = None,
    frames: tuple[int | None, int | None] = (None, None), seconds: tuple[float | None, float | None] = (None, None), **options,
) -> DataFrame:
    """A table of all recordings in a folder, or of those named; frames of some planes, and from the first to before the second
    bound of ``frames`` (t_idx) and ``seconds`` (ts). ``columns``, a schema with some of the table's columns, leaves the others
    unread."""
    spark.dataSource.register(RecordingSource)
    chosen = {"recordings": None if recordings is None else list(recordings), "planes": None if planes is None else list(planes), "frames": frames, "seconds": seconds}
    reader = spark.read.format("recording").option("table", table).options(**options, **{k: json.dumps(v) for k, v in chosen.items() if v is not None})
    return (reader.schema(columns) if columns else reader).load(path)


def facts(settings: DataFrame, frames: DataFrame) -> DataFrame:
    """(rec_id, date, rate, scan_line_rate, fov_x, fov_y, imaging_offset): a recording's timestamp as written in its file, its
    rates and field of view, and the time of its first frame."""
    m = settings.groupBy("rec_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("m"))
    double = lambda k: F.expr(f"try_cast(m['{k}'] as double)")
    date = F.coalesce(*[F.try_to_timestamp(F.expr("m['date']"), F.lit(form)) for form in ("M/d/yyyy h:mm:ss a", "M/d/yyyy H:mm:ss", "M/d/yyyy", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")])
    first = frames.groupBy("rec_id").agg(F.min("ts").alias("imaging_offset"))
    return m.join(first, "rec_id", "left").select(
        "rec_id", date.alias("date"), F.try_divide(F.lit(1.0), double("framePeriod")).alias("rate"), F.try_divide(F.lit(1.0), double("scanLinePeriod")).alias("scan_line_rate"),
        (double("pixelsPerLine") * double("micronsPerPixelXAxis")).alias("fov_x"), (double("linesPerFrame") * double("micronsPerPixelYAxis")).alias("fov_y"), "imaging_offset",
    )


def _xml(settings: dict[str, str], frames: pd.DataFrame, voltage: float | None) -> bytes:
    """Frames (plane, t_idx, ts), one sequence for each t_idx."""
    attributes = lambda a: "".join(f" {k}={quoteattr(str(v))}" for k, v in a.items())
    out = [f"<PVScan{attributes({'date': settings.get('date', '')})}><PVStateShard>"]
    out += [f"<PVStateValue{attributes({'key': k, 'value': v})}/>" for k, v in settings.items() if k != "date"]
    out.append("</PVStateShard>")
    for cycle, part in frames.sort_values(["t_idx", "plane"]).groupby("t_idx"):
        vin = f"<VoltageRecording{attributes({'absoluteTime': voltage, 'dataFile': 'voltage.csv'})}/>" if voltage is not None else ""
        out.append(f"<Sequence{attributes({'cycle': cycle})}>{vin}")
        for plane, ts in zip(part["plane"], part["ts"], strict=True):
            file = {"channel": 1, "filename": image_name(plane, cycle)}
            out.append(f"<Frame{attributes({'index': plane, 'absoluteTime': repr(float(ts))})}><ExtraParameters/><File{attributes(file)}/><PVStateShard/></Frame>")
        out.append("</Sequence>")
    return "".join([*out, "</PVScan>"]).encode()


def write_recordings(frames: DataFrame, path: str, settings: DataFrame | None = None, triggers: DataFrame | None = None, samples: str = "float64") -> None:
    """Recordings (rec_id, plane, t_idx, ts, h, w, pix) as folders of images, with their ``settings`` (rec_id, key, value) and
    voltage tables (rec_id, ts, value), whose times start from the recording's first.

    Images are written by all tasks; voltage tables and XML files, which hold no pixels, by one task a recording. The XML files come
    last."""
    spark = frames.sparkSession
    spark.dataSource.register(RecordingSource)
    put = lambda df, table: df.write.format("recording").options(table=table, samples=samples).mode("append").save(path)
    put(frames.select("rec_id", "plane", "t_idx", "h", "w", "pix"), "frames")
    starts = spark.createDataFrame([], "rec_id string, voltage double")
    if triggers is not None:
        starts = triggers.groupBy("rec_id").agg(F.min("ts").alias("voltage"))

        def voltages(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("ts", kind="stable")
            text = pd.DataFrame({"Time(ms)": (rows["ts"] - rows["ts"].min()) * 1e3, " trigger": rows["value"]}).to_csv(index=False)
            return pd.DataFrame({"rec_id": rows["rec_id"][:1], "name": "voltage.csv", "content": [text.encode()]})

        put(triggers.select("rec_id", "ts", "value").groupBy("rec_id").applyInPandas(voltages, "rec_id string, name string, content binary"), "files")
    known = settings.groupBy("rec_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("m")) if settings is not None else spark.createDataFrame([], "rec_id string, m map<string,string>")
    listed = frames.select("rec_id", "plane", "t_idx", "ts")

    def describe(key: tuple, rows: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
        facts_ = more.iloc[0] if len(more) else {"m": None, "voltage": None}
        voltage = None if pd.isna(facts_["voltage"]) else float(facts_["voltage"])
        return pd.DataFrame({"rec_id": [key[0]], "name": f"{key[0]}.xml", "content": [_xml(dict(facts_["m"] or {}), rows, voltage)]})

    about = known.join(starts, "rec_id", "full")
    put(listed.groupBy("rec_id").cogroup(about.groupBy("rec_id")).applyInPandas(describe, "rec_id string, name string, content binary"), "files")
