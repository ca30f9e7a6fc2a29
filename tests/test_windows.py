import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from glowtrace.operators import traces as t
from glowtrace.operators import windows as w


def series(spark, values):
    rows = [("r", "a", i, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "rec_id string, roi_id string, t_idx long, f double")


def lists(df):
    return [list(r["window"]) for r in df.orderBy("t_idx").collect()]


def values(df, name):
    return [r[name] for r in df.orderBy("t_idx").collect()]


def test_sliding(spark):
    s = series(spark, [7, -2, 0, 9, 4, 4, 1])
    assert lists(w.sliding_window(s, 4)) == [[7, -2, 0, 9], [-2, 0, 9, 4], [0, 9, 4, 4], [9, 4, 4, 1]]
    assert lists(w.sliding_window(s, 2, 3)) == [[7, -2], [9, 4]]
    assert lists(w.sliding_window(s, 8)) == []
    with pytest.raises(ValueError):
        w.sliding_window(s, 0)


def test_dilated(spark):
    squares = [i * i for i in range(11)]
    assert lists(w.dilated_window(series(spark, squares), 3, 4)) == [[i * i, (i + 4) ** 2, (i + 8) ** 2] for i in range(3)]


def test_two_dimensions(spark):
    image = np.array([[5, 1, 8, 2], [0, 3, 3, 9], [7, 6, 4, 1], [2, 2, 5, 0]], float)
    px = spark.createDataFrame([("r", 0, int(y), int(x), float(v)) for (y, x), v in np.ndenumerate(image)], "rec_id string, t_idx long, y int, x int, v double")
    got = {(r["y"], r["x"]): r["v"] for r in w.rolling_2d(px, (2, 3)).collect()}
    assert got == {(y, x): image[y : y + 2, x : x + 3].max() for y in range(3) for x in range(2)}


def test_rolling_borders(spark):
    s = series(spark, [1, 2, 3, 4, 5])
    assert lists(w.rolling_window(s, 3)) == [[3, 4, 5]]
    assert lists(w.rolling_window(s, 3, border="edge")) == [[1, 1, 2], [1, 2, 3], [2, 3, 4], [3, 4, 5], [4, 5, 5]]
    assert lists(w.rolling_window(s, 4, border=(0.0, 9.0), steps=2)) == [[0, 0, 1, 2], [1, 2, 3, 4], [3, 4, 5, 9]]
    assert lists(w.rolling_window(s, 3, border="nan"))[0] == [None, 1, 2]


def test_embedding_is_undone(spark):
    s = series(spark, [3, 1, 4, 1, 5, 9]).withColumnRenamed("f", "v")
    emb = w.delay_embed(s, 3, w.KEYS)
    assert values(w.overlap_average(emb, w.KEYS), "v") == [3, 1, 4, 1, 5, 9]
    assert values(w.middle_reconstruction(emb, 3, w.KEYS), "v") == [3, 1, 4, 1, 5, 9]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(1, 100), min_size=1, max_size=12), st.integers(1, 15))
def test_rolling_mean_is_edge_padded(spark, xs, size):
    got = values(t.rolling_baseline(series(spark, xs), size), "baseline")
    padded = np.pad(np.array(xs), (size // 2, -(-size // 2) - 1), mode="edge")
    assert np.allclose(got, [padded[i : i + size].mean() for i in range(len(xs))])


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(1, 100), min_size=80, max_size=90), st.sampled_from([5, 70]))
def test_order_statistic_reflects(spark, xs, size):
    got = values(t.order_statistic(series(spark, xs), size, size // 3), "b")
    padded = np.pad(np.array(xs), (size // 2, size - size // 2 - 1), mode="symmetric")
    assert np.allclose(got, [np.sort(padded[i : i + size])[size // 3] for i in range(len(xs))])


def test_long_series_in_runs(spark, monkeypatch):
    monkeypatch.setattr(t, "RUN", 50)
    xs = np.random.default_rng(1).normal(size=230)
    got = values(t.order_statistic(series(spark, xs), 80, 8), "b")
    padded = np.pad(xs, (40, 39), mode="symmetric")
    assert np.allclose(got, [np.sort(padded[i : i + 80])[8] for i in range(len(xs))])


def test_constant_trace_has_no_change(spark):
    assert values(t.dfof_rolling(series(spark, [5] * 9), 1, 4), "dfof") == [0.0] * 9
    assert values(t.dfof_rolling(series(spark, [0] * 4), 1, 4), "dfof") == [None] * 4


def test_missing_values_are_left_out(spark):
    got = values(t.rolling_baseline(series(spark, [None, 2, None, 4]), 3), "baseline")
    assert got[1:3] == [2.0, 3.0]


def test_background_keeps_the_minimum(spark):
    a = series(spark, [5, 7, 6])
    bg = spark.createDataFrame([("r", i, float(v)) for i, v in enumerate([1, 2, 3])], "rec_id string, t_idx long, f double")
    assert values(t.subtract_background(a, bg), "f") == [6.0, 7.0, 5.0]
    assert pd.Series(values(t.subtract_background(a, bg), "f")).min() == 5.0


def test_windows_over_named_axes(spark):
    cells = np.random.default_rng(2).normal(size=(4, 3, 5))
    pixels = spark.createDataFrame([("r", t, y, x, float(cells[t, y, x])) for t, y, x in np.ndindex(cells.shape)], "rec_id string, t_idx long, y int, x int, v double")
    got = {(r["t_idx"], r["y"], r["x"]): r["v"] for r in w.rolling_nd(pixels, {"t_idx": 2, "y": 0, "x": 3}, {"x": 2}, {"t_idx": 2}, "list").collect()}
    want = {(t, y, x): cells[[t, t + 2], y][:, x : x + 3].ravel().tolist() for t in range(2) for y in range(3) for x in (0, 2)}
    assert got == want
    repeated = w.rolling_nd(pixels, {"x": 2}, dilation={"x": 0}, reducer="list").where("t_idx = 0 and y = 0 and x = 1").first()["v"]
    assert repeated == [cells[0, 0, 1]] * 2
    for wrong in ({"window": {"z": 2}}, {"window": {"x": -1}}, {"window": {"x": 2}, "origin_step": {"x": 0}}):
        with pytest.raises(ValueError):
            w.rolling_nd(pixels, **wrong)
