"""Peaks of images whose last digits differ from one evaluation to the next, as those of sums over shuffled parts do."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from glowtrace.operators import images as im


def image_of(spark, images):
    """(rec_id, y, x, v) of a dict of arrays, computed anew wherever it is read."""

    def unsteady(v: pd.Series) -> pd.Series:
        return v + np.random.default_rng().uniform(-1e-9, 1e-9, len(v))

    rows = [(rec, y, x, float(v)) for rec, image in images.items() for (y, x), v in np.ndenumerate(image)]
    return spark.createDataFrame(rows, "rec_id string, y int, x int, v double").withColumn("v", F.pandas_udf(unsteady, "double").asNondeterministic()("v"))


def peaks_of(image, relative, edge):
    h, w = image.shape
    (bh, bw), wide = (h // relative, w // relative), np.pad(image, max(h, w), mode="symmetric")
    at = lambda y, x: wide[max(h, w) + y - bh // 2 :, max(h, w) + x - bw // 2 :][:bh, :bw].max()
    return {(y, x) for y in range(edge, h - edge) for x in range(edge, w - edge) if image[y, x] == at(y, x)}


def test_peaks_do_not_depend_on_last_digits(spark):
    rng = np.random.default_rng(5)
    images = {f"r{i}": rng.permutation(12 * 17).reshape(12, 17) for i in range(3)}
    df = image_of(spark, images)
    for relative, edge in ((3, 1), (4, 0), (5, 2)):
        rows = im.detect_peaks(df, 12, 17, relative, edge).collect()
        for rec, image in images.items():
            got = {(r["y"], r["x"]): r["v"] for r in rows if r["rec_id"] == rec}
            assert got.keys() == peaks_of(image, relative, edge) and got
            assert all(abs(v - image[p]) < 1e-8 for p, v in got.items())


def test_retried_peaks_are_counted_where_they_are_found(spark):
    """Two pixels side by side are alike up to their last digits, and one of them is nearer to the border: whichever is the
    peak, a recording keeps two."""
    image = np.zeros((16, 16))
    image[8, 12], image[4, 2], image[4, 3] = 9, 5, 5
    rows = im.peaks_with_retry(image_of(spark, {f"r{i}": image for i in range(40)}).where("v > 1"), 16, 16, 4, 6).collect()
    found = {}
    for r in rows:
        found.setdefault(r["rec_id"], set()).add((r["y"], r["x"]))
    assert len(found) == 40 and all(f in ({(8, 12), (4, 2)}, {(8, 12), (4, 3)}) for f in found.values())


def test_edges_of_retried_peaks(spark):
    """The edge against the reference's loop: it shrinks while at most one peak is left."""
    rng = np.random.default_rng(6)
    images = {f"r{i}": rng.permutation(11 * 14).reshape(11, 14) for i in range(6)}
    images["flat"], images["one"], images["two"] = np.zeros((11, 14)), np.arange(11 * 14).reshape(11, 14), np.add.outer(np.arange(11), abs(np.arange(14) - 6.5))
    rows = [(rec, y, x, float(v)) for rec, image in images.items() for (y, x), v in np.ndenumerate(image)]
    df = spark.createDataFrame(rows, "rec_id string, y int, x int, v double")
    for edge in (0, 2, 5):
        got = im.peaks_with_retry(df, 11, 14, 3, edge)
        assert got.columns == ["rec_id", "y", "x", "v"]
        got = got.collect()
        for rec, image in images.items():
            reach = edge
            while len(peaks_of(image, 3, reach)) <= 1 and reach:
                reach -= 1
            assert {(r["y"], r["x"]) for r in got if r["rec_id"] == rec} == peaks_of(image, 3, reach), (rec, edge)
