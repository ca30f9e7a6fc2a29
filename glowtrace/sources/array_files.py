"""Movies as single array files, NumPy's and MATLAB's (version 5), written and read in slices: format ``array_file``.

A file is laid out from front to back by the task that has its rows, in order, so no process holds a movie: frames follow each
other in the file in both layouts that put time behind the image. Files appear under their names when all tasks are done.
"""

from __future__ import annotations

import io
import math
import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from glowtrace.errors import RecordingError
from glowtrace.sources.recording_source import store_of

ROWS = "file string, place long, dims array<long>, extras map<string, array<double>>, values array<double>"
SCHEMA = "file string, t_idx long, plane int, h int, w int, pix array<double>"
#: MATLAB's type codes of data elements and classes of arrays, by the kind of samples.
MAT_KINDS = {"int8": (1, 8), "uint8": (2, 9), "int16": (3, 10), "uint16": (4, 11), "int32": (5, 12), "uint32": (6, 13), "float32": (7, 7), "float64": (9, 6)}
MAT_INT8, MAT_INT32, MAT_UINT32, MAT_MATRIX = 1, 5, 6, 14
#: Bytes of a slice that a task reads.
SLICE_BYTES = 64 << 20


def npy_header(dims: Sequence[int], kind: np.dtype) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array_header_1_0(out, {"descr": kind.str, "fortran_order": False, "shape": tuple(dims)})
    return out.getvalue()


def mat_variable(name: str, dims: Sequence[int], kind: np.dtype) -> tuple[bytes, int]:
    """(all of a variable before its samples, the zeros after them)."""
    code, class_ = MAT_KINDS[kind.name]
    size = math.prod(dims) * kind.itemsize
    if size + 256 >= 1 << 32:  # what comes before the samples is shorter
        raise RecordingError(f"{name} of {size} bytes doesn't fit into a MATLAB file of version 5")
    padded = lambda b: b + bytes(-len(b) % 8)
    parts = struct.pack("<IIII", MAT_UINT32, 8, class_, 0)
    parts += padded(struct.pack(f"<II{len(dims)}i", MAT_INT32, 4 * len(dims), *dims))
    parts += padded(struct.pack("<II", MAT_INT8, len(name)) + name.encode())
    parts += struct.pack("<II", code, size)
    return struct.pack("<II", MAT_MATRIX, len(parts) + size + -size % 8) + parts, -size % 8


def mat_header() -> bytes:
    return b"MATLAB 5.0 MAT-file".ljust(116) + bytes(8) + struct.pack("<H", 0x0100) + b"IM"


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class ArrayFileWriter(DataSourceArrowWriter):
    """Rows (file, place, dims, extras, values), those of a file in one partition in the order of places. Values are the samples
    in the order of the file; the first row's ``extras`` are further variables of a MATLAB file, as columns."""

    def __init__(self, options: dict):
        self.path, self.kind, self.name = options["path"], np.dtype(options.get("samples", "float64")).newbyteorder("<"), options.get("variable", "imageStack")
        self.mat = options.get("kind", "npy") == "mat"
        if self.mat and self.kind.name not in MAT_KINDS:
            raise RecordingError(f"MATLAB files hold no {self.kind.name}")
        self.job = f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, path = store_of(self.path)
        attempt, done = f"{path}/{self.job}/{uuid.uuid4().hex}", []
        held, name, left, after = None, None, 0, 0

        def finish() -> None:
            if held is None:
                return
            if left:
                raise RecordingError(f"{name} lacks {left} samples")
            held.write(bytes(after))
            held.close()
            done.append((f"{attempt}/{name}", name))

        for batch in iterator:
            for i, file in enumerate(batch.column("file").to_pylist()):
                if file != name:
                    finish()
                    if any(file == n for _, n in done):
                        raise RecordingError(f"the rows of {file} don't follow each other")
                    system.create_dir(f"{attempt}/{file}".rsplit("/", 1)[0], recursive=True)
                    held, name = system.open_output_stream(f"{attempt}/{file}"), file
                    dims = batch.column("dims")[i].as_py()
                    left, after = math.prod(dims), 0
                    if self.mat:
                        held.write(mat_header())
                        for k, v in sorted((batch.column("extras")[i].as_py() or {}) if batch.column("extras")[i].is_valid else []):
                            head, zeros = mat_variable(k, (len(v), 1), np.dtype("<f8"))
                            held.write(head + np.asarray(v, "<f8").tobytes() + bytes(zeros))
                        head, after = mat_variable(self.name, dims, self.kind)
                        held.write(head)
                    else:
                        held.write(npy_header(dims, self.kind))
                values = batch.column("values")[i].values.to_numpy(zero_copy_only=False)
                if len(values) > left:
                    raise RecordingError(f"{name} has more samples than its dimensions")
                left -= len(values)
                held.write((np.rint(values) if self.kind.kind in "ui" else values).astype(self.kind).tobytes())
        finish()
        return Written([f"{at}\0{name}" for at, name in done])

    def commit(self, messages: list[Written | None]) -> None:
        system, path = store_of(self.path)
        files = [m.split("\0") for message in messages if message for m in message.names]
        if len({name for _, name in files}) < len(files):
            self.abort(messages)
            raise RecordingError("the rows of a file are in several partitions")
        for at, name in files:
            if "/" in name:
                system.create_dir(f"{path}/{name}".rsplit("/", 1)[0], recursive=True)
            system.move(at, f"{path}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, path = store_of(self.path)
        if system.get_file_info(f"{path}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{path}/{self.job}")


@dataclass
class Part(InputPartition):
    file: str
    start: int
    dims: tuple[int, ...]
    kind: str
    mat: bool
    low: int
    high: int


def mat_layout(f: pa.NativeFile, name: str) -> tuple[int, tuple[int, ...], np.dtype]:
    """(first byte, dimensions, kind) of a variable of a plain little-endian file."""
    kinds = {code: np.dtype(kind).newbyteorder("<") for kind, (code, _) in MAT_KINDS.items()}
    head = f.read(128)
    if head[124:128] != struct.pack("<H", 0x0100) + b"IM":
        raise RecordingError("not a little-endian MATLAB file of version 5")
    at, end = 128, f.size()
    while at < end:
        f.seek(at)
        code, size = struct.unpack("<II", f.read(8))
        inner, found = at + 8, []
        while code == MAT_MATRIX and len(found) < 4:
            f.seek(inner)
            tag = f.read(8)
            kind, n = struct.unpack("<II", tag)
            if kind >> 16:  # up to four bytes in the tag itself
                kind, n, body, inner = kind & 0xFFFF, kind >> 16, tag[4:], inner + 8
                found.append((kind, n, body[:n], inner - 4))
            else:
                found.append((kind, n, f.read(n) if len(found) < 3 else b"", inner + 8))
                inner += 8 + n + -n % 8
        if found and found[2][2].decode() == name:
            return found[3][3], struct.unpack(f"<{found[1][1] // 4}i", found[1][2]), kinds[found[3][0]]
        at += 8 + size
    raise RecordingError(f"no variable {name}")


class ArrayFileReader(DataSourceReader):
    """Frames of all files in a folder; a task reads some 64 MB of one file."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.name, self.columns = options["path"], options.get("variable", "imageStack"), schema.names

    def partitions(self) -> list[InputPartition]:
        system, path = store_of(self.path)
        out = []
        for info in sorted(system.get_file_info(fs.FileSelector(path, recursive=True)), key=lambda i: i.path):
            name = info.path[len(path) :].lstrip("/")
            if info.type != fs.FileType.File or info.extension not in ("npy", "mat") or "_temporary-" in name:
                continue
            with system.open_input_file(info.path) as f:
                if info.extension == "mat":
                    start, dims, kind = mat_layout(f, self.name)
                    dims = (*dims, 1)[:4] if len(dims) < 4 else dims
                    frames, size = math.prod(dims[2:]), dims[0] * dims[1]
                else:
                    version = np.lib.format.read_magic(f)
                    dims, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
                    if fortran or len(dims) != 3:
                        raise RecordingError(f"{name} holds no frames in order")
                    start, frames, size = f.tell(), dims[0], dims[1] * dims[2]
            step = max(1, SLICE_BYTES // max(1, size * kind.itemsize))
            out += [Part(name, start, tuple(dims), kind.str, info.extension == "mat", k, min(k + step, frames)) for k in range(0, frames, step)]
        return out

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        system, path = store_of(self.path)
        kind, dims = np.dtype(partition.kind), partition.dims
        h, w = dims[:2] if partition.mat else dims[1:]
        with system.open_input_file(f"{path}/{partition.file}") as f:
            for k in range(partition.low, partition.high):
                row = {"file": partition.file, "t_idx": k % dims[2] if partition.mat else k, "plane": k // dims[2] + 1 if partition.mat else None, "h": h, "w": w}
                if "pix" in self.columns:
                    f.seek(partition.start + k * h * w * kind.itemsize)
                    image = np.frombuffer(f.read(h * w * kind.itemsize), kind)
                    row["pix"] = (image.reshape(w, h).T if partition.mat else image).ravel().astype(np.float64)
                kinds = {"file": pa.string(), "t_idx": pa.int64(), "plane": pa.int32(), "h": pa.int32(), "w": pa.int32(), "pix": pa.list_(pa.float64())}
                yield pa.RecordBatch.from_arrays([pa.array([row[c]], kinds[c]) for c in self.columns], self.columns)


class ArrayFileSource(DataSource):
    """Options: ``path``, ``variable`` of MATLAB files; for writing ``kind`` (npy or mat) and ``samples``."""

    @classmethod
    def name(cls) -> str:
        return "array_file"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ArrayFileReader:
        return ArrayFileReader(dict(self.options.items()), schema)

    def writer(self, schema: StructType, overwrite: bool) -> ArrayFileWriter:
        return ArrayFileWriter(dict(self.options.items()))


def _put(rows: DataFrame, path: str, **options) -> None:
    """Rows of a file in one partition, in order."""
    rows.sparkSession.dataSource.register(ArrayFileSource)
    rows = rows.select("file", "place", "dims", "extras", F.transform("values", lambda v: F.coalesce(v.cast("double"), F.lit(float("nan")))).alias("values"))
    rows.repartition("file").sortWithinPartitions("file", "place").write.format("array_file").options(**options).mode("append").save(path)


def _sizes(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row a file with the size of its frames; frames of several sizes are an error."""
    same = (F.min("h") == F.max("h")) & (F.min("w") == F.max("w"))
    found = frames.groupBy(*keys).agg(F.count("*").alias("n"), F.min("h").alias("hh"), F.min("w").alias("ww"), same.alias("same"))
    return found.withColumn("hh", F.when(F.col("same"), F.col("hh")).otherwise(F.raise_error(F.lit("frames of several sizes")).cast("int"))).drop("same")


def save_npy(frames: DataFrame, path: str, samples: str = "float32") -> None:
    """A file (time, row, column) for each recording, named by it, or for each plane of it, ``<rec_id>/plane<plane>.npy``.
    Frames (rec_id, [plane,] t_idx, h, w, pix) come in the order of t_idx."""
    keys = [c for c in ("rec_id", "plane") if c in frames.columns]
    file = F.concat("rec_id", F.lit("/plane"), F.col("plane").cast("string"), F.lit(".npy")) if len(keys) > 1 else F.concat("rec_id", F.lit(".npy"))
    rows = frames.join(_sizes(frames, keys), keys)
    dims = F.array(*[F.col(c).cast("long") for c in ("n", "hh", "ww")])
    _put(rows.select(file.alias("file"), F.col("t_idx").alias("place"), dims.alias("dims"), F.lit(None).cast("map<string,array<double>>").alias("extras"), F.col("pix").alias("values")), path, kind="npy", samples=samples)


def save_mat(frames: DataFrame, path: str, layout: str = "stack", samples: str = "float64") -> None:
    """``<rec_id>.mat`` with ``imageStack`` for each recording of frames (rec_id, plane, t_idx, ts, h, w, pix), whose planes have
    equally many. ``stack`` is (row, column, time, plane), with the variables imagingOffset and timestamps (in the order of
    time, then plane); ``planes`` is (plane, time, row, column) alone, where a pixel's series are what a row writes."""
    if layout not in ("stack", "planes"):
        raise ValueError(f"unknown layout {layout!r}")
    by_plane = frames.groupBy("rec_id", "plane").agg(F.count("*").alias("frames"))
    planes = by_plane.groupBy("rec_id").agg(F.count("*").alias("z"), F.min("frames").alias("lo"), F.max("frames").alias("hi"))
    planes = planes.select("rec_id", "z", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.raise_error(F.concat(F.lit("planes of different lengths: "), "rec_id")).cast("long")).alias("t"))
    sizes = _sizes(frames, ["rec_id"]).join(planes, "rec_id")
    file = F.concat("rec_id", F.lit(".mat")).alias("file")
    none = F.lit(None).cast("map<string,array<double>>")
    dims = lambda *names: F.array(*[F.col(c).cast("long") for c in names]).alias("dims")
    cell = lambda i: F.get("pix", ((i % F.col("h")) * F.col("w") + F.floor(i / F.col("h"))).cast("int"))
    if layout == "planes":
        pixels = frames.select("rec_id", "plane", "t_idx", "w", F.posexplode("pix").alias("pos", "v"))
        pixels = pixels.withColumn("y", F.expr("pos div w")).withColumn("x", F.expr("pos % w"))
        series = F.array_sort(F.collect_list(F.struct("t_idx", "plane", "v")))["v"]
        rows = pixels.groupBy("rec_id", "y", "x").agg(series.alias("values")).join(sizes, "rec_id")
        place = (F.col("x").cast("long") * F.col("hh") + F.col("y")).alias("place")
        _put(rows.select(file, place, dims("z", "t", "hh", "ww"), none.alias("extras"), "values"), path, kind="mat", samples=samples)
        return
    # The least plane's first frame carries the small variables.
    times = frames.groupBy("rec_id").agg(F.array_sort(F.collect_list(F.struct("t_idx", "plane", F.col("ts").cast("double").alias("ts"))))["ts"].alias("times"), F.min(F.struct("plane", "t_idx")).alias("first"))
    rows = frames.join(sizes, "rec_id").join(times, "rec_id")
    extras = F.create_map(F.lit("imagingOffset"), F.slice("times", F.lit(1), F.lit(1)), F.lit("timestamps"), F.col("times"))
    extras = F.when((F.col("plane") == F.col("first.plane")) & (F.col("t_idx") == F.col("first.t_idx")), extras)
    values = F.transform(F.sequence(F.lit(0), F.col("h") * F.col("w") - 1), cell)
    place = (F.col("plane").cast("long") * (1 << 40) + F.col("t_idx")).alias("place")
    _put(rows.select(file, place, dims("hh", "ww", "t", "z"), extras.alias("extras"), values.alias("values")), path, kind="mat", samples=samples)


def read_arrays(spark: SparkSession, path: str, columns: str | None = None, **options) -> DataFrame:
    """(file, t_idx, plane, h, w, pix) of the array files in a folder and those below it: NumPy's (time, row, column), whose plane
    is NULL, and MATLAB's stacks, whose planes count from 1."""
    spark.dataSource.register(ArrayFileSource)
    reader = spark.read.format("array_file").options(**options)
    return (reader.schema(columns) if columns else reader).load(path)
