"""Movies as NumPy and MATLAB files, read by NumPy and by a reader of the format written here."""

import pathlib
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from glowtrace.sources import array_files as arrays

H, W, T, Z = 3, 5, 7, 2


def movie(rec, z, t):
    return 1000.0 * rec + 100 * z + 10 * t + np.arange(H * W).reshape(H, W) / 4


@pytest.fixture
def frames(spark):
    rows = [(f"R{r}", z, t, r + t * 0.5 + z * 0.1, H, W, movie(r, z, t).ravel().tolist()) for r in (1, 2) for z in (1, 2) for t in range(T)]
    return spark.createDataFrame(rows, "rec_id string, plane int, t_idx long, ts double, h int, w int, pix array<double>").repartition(6)


def variables(data):
    """The variables of a MATLAB file: tags of a type and a size, bodies padded to eight bytes, columns first."""
    assert data[:19] == b"MATLAB 5.0 MAT-file" and data[124:128] == b"\0\1IM"
    kinds = {1: "i1", 2: "u1", 3: "<i2", 4: "<u2", 5: "<i4", 6: "<u4", 7: "<f4", 9: "<f8"}
    at, out = 128, {}
    while at < len(data):
        kind, size = struct.unpack_from("<II", data, at)
        assert kind == 14 and at % 8 == 0
        inner, parts = at + 8, []
        while inner < at + 8 + size:
            k, n = struct.unpack_from("<II", data, inner)
            parts.append((k, data[inner + 8 : inner + 8 + n]))
            inner += 8 + n + -n % 8
        at = inner
        dims = np.frombuffer(parts[1][1], "<i4")
        out[parts[2][1].decode()] = np.frombuffer(parts[3][1], kinds[parts[3][0]]).reshape(dims, order="F")
    return out


@pytest.mark.parametrize("samples", ["float32", "float64", "uint16"])
def test_numpy_files(spark, frames, tmp_path, samples):
    path = tmp_path / "npy"
    arrays.save_npy(frames, str(path), samples)
    assert sorted(str(p.relative_to(path)) for p in path.rglob("*") if p.is_file() and not p.name.startswith(".")) == [f"R{r}/plane{z}.npy" for r in (1, 2) for z in (1, 2)]
    for r in (1, 2):
        for z in (1, 2):
            got = np.load(path / f"R{r}" / f"plane{z}.npy", mmap_mode="r")
            want = np.array([movie(r, z, t) for t in range(T)])
            assert got.dtype == samples and got.shape == (T, H, W) and (got == (np.rint(want) if samples == "uint16" else want)).all()
    one = tmp_path / "one"
    arrays.save_npy(frames.where("plane = 1").drop("plane"), str(one), samples)
    assert sorted(p.name for p in one.iterdir()) == ["R1.npy", "R2.npy"]


@pytest.mark.parametrize("slices", [1, 1 << 26])
def test_files_are_read_in_slices(spark, frames, tmp_path, monkeypatch, slices):
    monkeypatch.setattr(arrays, "SLICE_BYTES", slices)
    arrays.save_npy(frames, str(tmp_path))
    arrays.save_mat(frames, str(tmp_path))
    got = arrays.read_arrays(spark, str(tmp_path)).collect()
    assert len(got) == 2 * 2 * Z * T
    for r in got:
        rec = int(r["file"][1])
        z = r["plane"] or int(r["file"][-5])
        assert (r["h"], r["w"]) == (H, W) and r["pix"] == movie(rec, z, r["t_idx"]).ravel().tolist()
    reader = arrays.ArrayFileReader({"path": str(tmp_path)}, spark.createDataFrame([], arrays.SCHEMA).schema)
    assert len(reader.partitions()) == (len(got) if slices == 1 else 6)
    assert arrays.read_arrays(spark, str(tmp_path), columns="file string, t_idx long").count() == len(got)


def test_matlab_stacks(spark, frames, tmp_path):
    arrays.save_mat(frames, str(tmp_path), samples="float32")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["R1.mat", "R2.mat"]
    for r in (1, 2):
        got = variables((tmp_path / f"R{r}.mat").read_bytes())
        assert sorted(got) == ["imageStack", "imagingOffset", "timestamps"] and got["imageStack"].dtype == np.float32
        assert (got["imageStack"] == np.array([[movie(r, z, t) for t in range(T)] for z in (1, 2)]).transpose(2, 3, 1, 0)).all()
        assert got["timestamps"].ravel().tolist() == [r + t * 0.5 + z * 0.1 for t in range(T) for z in (1, 2)] and got["imagingOffset"].tolist() == [[r + 0.1]]


def test_matlab_planes(spark, frames, tmp_path):
    arrays.save_mat(frames, str(tmp_path), "planes", "uint16")
    for r in (1, 2):
        got = variables((tmp_path / f"R{r}.mat").read_bytes())
        assert list(got) == ["imageStack"]
        assert (got["imageStack"] == np.rint([[movie(r, z, t) for t in range(T)] for z in (1, 2)])).all()
    with pytest.raises(ValueError, match="layout"):
        arrays.save_mat(frames, str(tmp_path), "other")


def test_what_fails_leaves_nothing(spark, frames, tmp_path):
    def left(path):
        return [p for p in pathlib.Path(path).rglob("*") if p.is_file()] if pathlib.Path(path).exists() else []

    cases = {
        "lengths": lambda p: arrays.save_mat(frames.where("plane = 1 or t_idx > 0"), p),
        "sizes": lambda p: arrays.save_npy(frames.withColumn("h", F.when(F.col("t_idx") == 2, 1).otherwise(F.col("h"))), p),
        "lacks": lambda p: arrays.save_npy(frames.withColumn("pix", F.when(F.col("t_idx") == 6, F.slice("pix", 1, 4)).otherwise(F.col("pix"))), p),
        "more samples": lambda p: arrays.save_npy(frames.withColumn("pix", F.concat("pix", "pix")), p),
        "hold no": lambda p: arrays.save_mat(frames, p, samples="float16"),
    }
    for said, case in cases.items():
        path = str(tmp_path / said.replace(" ", ""))
        with pytest.raises(Exception, match=said):
            case(path)
        assert not [p for p in left(path) if p.suffix in (".npy", ".mat") and "_temporary" not in str(p)], said
    with pytest.raises(Exception, match="version 5"):
        arrays.mat_variable("imageStack", (1 << 16, 1 << 16, 2), np.dtype("u1"))
    rows = spark.createDataFrame([("x.npy", i, [4], None, [float(i)]) for i in range(4)], arrays.ROWS).repartition(4)
    spark.dataSource.register(arrays.ArrayFileSource)
    with pytest.raises(Exception, match="lacks|several"):
        rows.write.format("array_file").mode("append").save(str(tmp_path / "parts"))
    assert not left(str(tmp_path / "parts" / "x.npy"))


def test_no_frames(spark, frames, tmp_path):
    arrays.save_npy(frames.limit(0), str(tmp_path))
    arrays.save_mat(frames.limit(0), str(tmp_path))
    assert list(tmp_path.iterdir()) == [] and arrays.read_arrays(spark, str(tmp_path)).count() == 0
