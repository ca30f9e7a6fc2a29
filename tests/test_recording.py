import pathlib

import numpy as np
import pytest

from glowtrace.errors import RecordingError, XmlStructureError
from glowtrace.sources import recording as rec
from glowtrace.sources import recording_source as source
from glowtrace.sources import tiff
from tests.test_tiff import made

SHARD = '<PVStateShard><PVStateValue key="framePeriod" value="0.5"/><PVStateValue key="micronsPerPixel"><IndexedValue index="XAxis" value="2.0"/><IndexedValue index="YAxis" value="3"/></PVStateValue><PVStateValue key="pos"><SubindexedValues index="Z"><SubindexedValue subindex="0" value="7"/></SubindexedValues></PVStateValue><PVStateValue key="pixelsPerLine" value="4"/><PVStateValue key="linesPerFrame" value="3"/></PVStateShard>'


@pytest.fixture
def folder(tmp_path):
    path = tmp_path / "TSeries-01022024-0001-007"
    path.mkdir()
    frames = []
    for s in range(2):
        inner = ""
        for z in (1, 2, 3):
            files = "".join(f'<File channel="{c}" filename="c{c}_{s}_{z}.tif"/>' for c in (1, 2))
            inner += f'<Frame index="{z}" absoluteTime="{s * 3 + z * 0.5}"><ExtraParameters gain="1"/>{files}<PVStateShard/></Frame>'
            for c, kind in ((1, np.uint8), (2, np.uint16)):
                (path / f"c{c}_{s}_{z}.tif").write_bytes(tiff.encode(np.full((3, 4), 100 * c + 10 * s + z, kind)))
        frames.append(f'<Sequence type="x" cycle="{s}"><VoltageRecording absoluteTime="2.5" dataFile="v.csv"/>{inner}</Sequence>')
    (path / "m.xml").write_text(f'<PVScan date="1/2/2024">{SHARD}{"".join(frames)}</PVScan>')
    (path / "v.csv").write_text("Time(ms), trigger\n0, 0.5\n1000, 4.5\n")
    return path


def test_lookup(spark, folder):
    found = rec.find_recording(spark, str(folder.parent), "tseries", 7, "01042024", days_before=3)
    assert found.endswith(folder.name)
    assert rec.find_recording(spark, str(folder.parent), "tseries", 8, "01042024", errors="ignore") is None
    with pytest.raises(RecordingError):
        rec.find_recording(spark, str(folder.parent), "tseries", 8, "01042024")
    with pytest.raises(RecordingError):
        rec.find_recording(spark, str(folder.parent), "other", 7, "01042024")
    (folder.parent / "TSeries-01022024-0002-007").mkdir()
    with pytest.raises(RecordingError):
        rec.find_recording(spark, str(folder.parent), "tseries", 7, "01022024")


def test_volume_recording(spark, folder):
    r = rec.load_recording(spark, str(folder), channel=2, voltage=str(folder / "v.csv"))
    rows = sorted((x["plane"], x["t_idx"], x["ts"], x["pix"][0], x["h"], x["w"]) for x in r.frames.collect())
    assert rows == [(z, s, s * 3 + z * 0.5, 200.0 + 10 * s + z, 3, 4) for z in (1, 2, 3) for s in (0, 1)]
    facts = r.facts.first()
    assert (facts["rate"], facts["fov_x"], facts["fov_y"], facts["imaging_offset"]) == (2.0, 8.0, 9.0, 0.5)
    known = {x["key"]: x["value"] for x in r.settings.collect()}
    assert known["posZ0"] == "7" and known["gain"] == "1" and known["type"] == "x" and "cycle" not in known
    assert [(x["ts"], x["value"]) for x in r.triggers.collect()] == [(2.5, 0.5), (3.5, 4.5)]
    assert {x["rec_id"] for x in r.triggers.collect()} == {x["rec_id"] for x in r.facts.collect()}


def test_channel_rules(spark, folder):
    with pytest.raises(Exception, match="name a channel"):
        rec.read_xml(spark, f"{folder}/*.xml").collect()
    with pytest.raises(Exception, match="channel 5"):
        rec.read_xml(spark, f"{folder}/*.xml", 5).collect()
    with pytest.raises(NotImplementedError):
        rec.read_xml(spark, f"{folder}/*.xml", "both")


def test_structure_is_checked():
    import xml.etree.ElementTree as ET

    with pytest.raises(XmlStructureError):
        list(rec._attributes(ET.fromstring("<PVScan><Sequence/></PVScan>"), None))
    with pytest.raises(XmlStructureError):
        rec.shard_values(ET.fromstring("<PVStateShard><Other/></PVStateShard>"))


def test_movie_round_trip(spark, folder, tmp_path):
    r = rec.load_recording(spark, str(folder), channel=1)
    rec.write_movie(r.frames, str(tmp_path / "movie"))
    back = rec.read_movie(spark, str(tmp_path / "movie"))
    key = lambda x: (x["plane"], x["t_idx"])
    assert [x["pix"] for x in sorted(back.collect(), key=key)] == [x["pix"] for x in sorted(r.frames.collect(), key=key)]


def test_offsets_of_very_many_recordings(spark, tmp_path, monkeypatch):
    folders = [f"TSeries-{i:05d}" for i in range(40)]
    for i, name in enumerate(folders):
        (tmp_path / name).mkdir()
        (tmp_path / name / "v.csv").write_text(f"Time(ms), trigger\n{i}, 1\n")
    offsets = {f"TSeries-{i:05d}": float(i) for i in range(10_000)}
    want = {(name, round(i + i / 1000, 9)) for i, name in enumerate(folders)}
    for most in (100_000, 10):
        monkeypatch.setattr(rec, "BROADCAST_RECORDINGS", most)
        got = rec.read_voltage(spark, str(tmp_path / "*/v.csv"), offsets).collect()
        assert {(r["rec_id"], round(r["ts"], 9)) for r in got} == want
    with pytest.raises(Exception, match="no absolute voltage time: TSeries-00039"):
        rec.read_voltage(spark, str(tmp_path / "*/v.csv"), dict(list(offsets.items())[:39])).collect()


def test_unknown_subindices_are_errors():
    import xml.etree.ElementTree as ET

    with pytest.raises(XmlStructureError):
        list(rec.shard_values(ET.fromstring('<PVStateShard><PVStateValue key="a"><SubindexedValues index="Z"><Other subindex="0" value="7"/></SubindexedValues></PVStateValue></PVStateShard>')))


# The data source


@pytest.fixture
def many(spark, tmp_path):
    """Two recordings of two planes, one of them with a voltage table."""
    rows = [(f"R-{r}", z, t, r * 100 + t * 0.5, 3, 4, [float(r * 1000 + z * 100 + t + k / 4) for k in range(12)]) for r in (1, 2) for z in (1, 2) for t in range(7)]
    frames = spark.createDataFrame(rows, "rec_id string, plane int, t_idx long, ts double, h int, w int, pix array<double>")
    settings = spark.createDataFrame([("R-1", "framePeriod", "0.5"), ("R-1", "date", "1/2/2024 3:04:05 PM"), ("R-1", "odd", 'a"<&'), ("R-2", "framePeriod", "x")], "rec_id string, key string, value string")
    triggers = spark.createDataFrame([("R-1", 7.25, 1.0), ("R-1", 7.75, 5.0)], "rec_id string, ts double, value double")
    path = str(tmp_path / "many")
    source.write_recordings(frames, path, settings, triggers)
    return path, rows


def test_written_recordings_are_read_back(spark, many):
    path, rows = many
    for at in (path, f"file://{path}"):
        got = source.read_recordings(spark, at)
        assert sorted((r["rec_id"], r["plane"], r["t_idx"], r["ts"], r["h"], r["w"], r["pix"]) for r in got.collect()) == rows
    one = source.read_recordings(spark, f"{path}/R-2")
    assert one.count() == 14 and {r["rec_id"] for r in one.collect()} == {"R-2"}
    known = {(r["rec_id"], r["key"]): r["value"] for r in source.read_recordings(spark, path, "settings").collect()}
    assert known["R-1", "odd"] == 'a"<&' and known["R-1", "dataFileVin"] == "voltage.csv" and ("R-2", "dataFileVin") not in known
    assert ("R-1", "filename") not in known and known["R-1", "channel"] == "1"
    facts = {r["rec_id"]: r for r in source.facts(source.read_recordings(spark, path, "settings"), source.read_recordings(spark, path)).collect()}
    assert (facts["R-1"]["rate"], facts["R-1"]["imaging_offset"], str(facts["R-1"]["date"])) == (2.0, 100.0, "2024-01-02 15:04:05")
    assert (facts["R-2"]["rate"], facts["R-2"]["imaging_offset"], facts["R-2"]["date"]) == (None, 200.0, None)
    voltage = source.read_recordings(spark, path, "triggers", recordings=["R-1"])
    assert [(r["ts"], r["value"]) for r in voltage.collect()] == [(7.25, 1.0), (7.75, 5.0)]
    with pytest.raises(Exception, match="R-2 has no voltage"):
        source.read_recordings(spark, path, "triggers").collect()
    # The readers by Spark's own sources see the same.
    same = rec.load_recording(spark, f"{path}/R-1", voltage=f"{path}/R-1/voltage.csv")
    assert sorted((r["plane"], r["t_idx"], r["pix"]) for r in same.frames.collect()) == [(r[1], r[2], r[6]) for r in rows if r[0] == "R-1"]
    assert [(r["ts"], r["value"]) for r in same.triggers.orderBy("ts").collect()] == [(7.25, 1.0), (7.75, 5.0)]


def test_choices_and_columns_reach_the_source(spark, many):
    path, rows = many
    some = "rec_id string, plane int, t_idx long, ts double"
    for chosen, keeps in (
        ({"recordings": ["R-2"], "planes": [1], "frames": (3, None)}, lambda r: r[0] == "R-2" and r[1] == 1 and r[2] > 2),
        ({"recordings": ["R-1", "none"], "seconds": (101, 102)}, lambda r: r[0] == "R-1" and 101 <= r[3] < 102),
        ({"recordings": []}, lambda r: False),
        ({"planes": [2, 7], "frames": (1, 4), "seconds": (None, 201.5)}, lambda r: r[1] == 2 and 1 <= r[2] < 4 and r[3] < 201.5),
    ):
        df = source.read_recordings(spark, path, columns=some, **chosen)
        assert sorted(map(tuple, df.collect())) == [r[:4] for r in rows if keeps(r)], chosen
        # Filters of a plan leave the frame as it is.
        assert df.where("t_idx > 5").count() == sum(keeps(r) and r[2] > 5 for r in rows) and df.count() == sum(map(keeps, rows))
    # Images that aren't asked for aren't opened: gone ones do no harm.
    for f in pathlib.Path(path).glob("R-1/*_0000000[0-4].tif"):
        f.unlink()
    assert source.read_recordings(spark, path, columns=some).count() == 28
    with pytest.raises(Exception, match="tif"):
        source.read_recordings(spark, path).collect()
    assert source.read_recordings(spark, path, frames=(5, None)).count() == 8
    assert source.read_recordings(spark, path, recordings=["R-2"]).count() == 14


def test_slices_cover_a_recording_once(spark, many, monkeypatch):
    path, rows = many
    monkeypatch.setattr(source, "SLICE_XML_BYTES", 100)
    monkeypatch.setattr(source, "MOST_SLICES", 5)
    reader = source.RecordingReader({"path": path}, spark.createDataFrame([], source.SCHEMAS["frames"]).schema)
    parts = reader.partitions()
    assert len(parts) == 10
    got = [row for p in parts for batch in reader.read(p) for row in batch.to_pylist()]
    assert sorted((r["rec_id"], r["plane"], r["t_idx"], r["pix"]) for r in got) == [(r[0], r[1], r[2], r[6]) for r in rows]
    monkeypatch.setattr(source, "BATCH_BYTES", 1)
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 28


def test_channels_pages_and_unfinished_recordings(spark, folder, tmp_path):
    path = str(folder.parent)
    (folder.parent / "Unfinished").mkdir()
    (folder.parent / "_hidden").mkdir()
    for channel in (1, 2):
        got = source.read_recordings(spark, path, channel=channel)
        assert sorted((r["plane"], r["t_idx"], r["pix"][0]) for r in got.collect()) == [(z, s, 100.0 * channel + 10 * s + z) for z in (1, 2, 3) for s in (0, 1)]
    assert source.read_recordings(spark, path, channel=1, pattern="ZSeries-*").count() == 0
    with pytest.raises(Exception, match="name a channel"):
        source.read_recordings(spark, path).collect()
    with pytest.raises(Exception, match="no table"):
        source.read_recordings(spark, path, "other", columns="rec_id string").collect()
    with pytest.raises(Exception, match="no columns"):
        source.read_recordings(spark, path, columns="rec_id string, mass double").collect()
    assert [(r["ts"], r["value"]) for r in source.read_recordings(spark, path, "triggers", channel=1).collect()] == [(2.5, 0.5), (3.5, 4.5)]
    assert [r["ts"] for r in source.read_recordings(spark, path, "triggers", channel=1, absoluteTriggerTime=False).collect()] == [0.0, 1.0]
    # Frames that are pages of one file.
    paged = tmp_path / "paged" / "P-1"
    paged.mkdir(parents=True)
    images = [np.full((2, 2), k, np.uint16) for k in range(3)]
    (paged / "all.tif").write_bytes(made(images))
    inner = "".join(f'<Frame index="1" absoluteTime="{k}"><ExtraParameters/><File channel="1" page="{k + 1}" filename="all.tif"/><PVStateShard/></Frame>' for k in range(3))
    (paged / "m.xml").write_text(f'<PVScan date="x"><SystemIDs SystemID="77"/>{SHARD}<Sequence>{inner}</Sequence></PVScan>')
    got = source.read_recordings(spark, str(tmp_path / "paged")).orderBy("t_idx").collect()
    assert [r["pix"] for r in got] == [[float(k)] * 4 for k in range(3)]
    known = {r["key"]: r["value"] for r in source.read_recordings(spark, str(tmp_path / "paged"), "settings").collect()}
    assert known["SystemID"] == "77" and known["posZ0"] == "7"
