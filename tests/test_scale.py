"""Operators whose groups are cut up: recursive filters in chunks of time, percentiles by digits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glowtrace.operators import filters, images, kde, models, project, quantiles, recursion, traces

DESIGNS = {
    "lowpass": filters.butter_lowpass(2, 30),
    "bandpass": filters.butter_bandpass(1, 4, 30, 3),
    "bandstop": filters.butter_bandstop(5, 7, 30),
    "decimation": filters.chebyshev_lowpass(8, 0.05, 0.08),
    "mean of four": (np.full(4, 0.25), np.ones(1)),
}


def direct(b, a, x, state):
    """The difference equation in its transposed form, sample by sample."""
    n = max(len(a), len(b))
    b, a, z, out = np.pad(b, (0, n - len(b))) / a[0], np.pad(a, (0, n - len(a))) / a[0], list(state), []
    for v in x:
        y = b[0] * v + z[0]
        z = [(z[k + 1] if k + 2 < n else 0.0) + b[k + 1] * v - a[k + 1] * y for k in range(n - 1)]
        out.append(y)
    return np.array(out), np.array(z)


@pytest.mark.parametrize("name", DESIGNS)
@pytest.mark.parametrize("n", [1, 127, 128, 129, 1000])
def test_sections_in_blocks_are_the_recursion(name, n):
    filt = recursion.Cascade(*DESIGNS[name])
    rng = np.random.default_rng(n)
    assert all(s.order <= 2 for s in filt.sections) and filt.order == max(map(len, DESIGNS[name])) - 1
    before, x = rng.normal(size=50), rng.normal(size=n)
    want = direct(*DESIGNS[name], np.concatenate([before, x]), filt.rest)[0]
    first, state = filt.run(before, filt.rest)
    y, after = filt.run(x, state)
    assert np.allclose(np.concatenate([first, y]), want, atol=1e-7 if name == "decimation" else 1e-9, rtol=0)  # a direct form of order 8 keeps as many digits
    # A constant goes on as it is from the steady state.
    flat = filt.run(np.ones(n), filt.steady)[0]
    assert np.allclose(flat, np.sum(DESIGNS[name][0]) / np.sum(DESIGNS[name][1]), atol=1e-9)
    # What a state leaves for the samples after, and for the way back; also where it is forgotten by then.
    alone, gone = filt.run(np.zeros(n), state)
    back = filt.run(alone[::-1], filt.rest)[1]
    for horizon in (filt.horizon, None):
        filt.horizon = horizon
        ahead, left = filt.echo(state, n)
        assert np.allclose(ahead, gone, atol=1e-12) and np.allclose(left, back, atol=1e-12)


def test_filters_of_one_piece():
    for b, a in (([0.0, 0.5, 0.25], [1.0, -0.3]), ([2.0], [4.0]), ([1.0, 0.2], [1.0, -0.5, 0.1, 0.05]), ([0.0], [1.0, 0.5]), ([0, 0, 1.0], [1.0])):
        x = np.random.default_rng(1).normal(size=300)
        filt = recursion.Cascade(b, a)
        n = max(len(a), len(b), 2) - 1
        assert np.allclose(filt.run(x, filt.rest)[0], direct(np.array(b), np.array(a), x, np.zeros(n))[0] if len(a) + len(b) > 2 else x * b[0] / a[0]), (b, a)


def test_horizons():
    assert recursion.Cascade(*DESIGNS["lowpass"]).horizon <= 1024 and recursion.Cascade(*DESIGNS["mean of four"]).horizon == 2 * recursion.BLOCK
    assert recursion.Cascade([1.0], [1.0, -1.0]).horizon is None  # a sum never forgets


@pytest.mark.parametrize("name", DESIGNS)
@pytest.mark.parametrize("both_ways", [True, False])
def test_chunks_are_the_series(spark, name, both_ways):
    rng = np.random.default_rng(2)
    series = {("r", "long"): np.arange(1200), ("r", "short"): np.arange(9), ("r", "one"): np.arange(1), ("r", "two"): np.arange(2), ("r", None): np.arange(40), ("s", "gaps"): np.sort(rng.choice(4000, 300, replace=False))}
    data = {k: (t, 100 + np.cumsum(rng.normal(size=len(t)))) for k, t in series.items()}
    df = spark.createDataFrame([(*k, int(i), float(v)) for k, (t, x) in data.items() for i, v in zip(t, x, strict=True)], "rec_id string, roi_id string, t_idx int, f double").repartition(5)
    out = recursion.recursive_filter(df, *DESIGNS[name], both_ways, chunk=64)
    assert out.dtypes == df.dtypes
    got = out.toPandas()
    filt = recursion.Cascade(*DESIGNS[name])
    assert len(got) == df.count()
    for (rec, roi), (t, x) in data.items():
        part = got[(got["rec_id"] == rec) & (got["roi_id"].isna() if roi is None else got["roi_id"] == roi)].sort_values("t_idx")
        assert part["t_idx"].tolist() == t.tolist()
        assert np.allclose(part["f"], recursion.filtered(x, filt, both_ways), atol=1e-7), (rec, roi)
    assert recursion.recursive_filter(df.limit(0), *DESIGNS[name], both_ways).count() == 0


def test_a_long_series_is_many_tasks(spark, monkeypatch):
    """Chunks meet in no task: the scan sees numbers of chunks only."""
    monkeypatch.setattr(recursion, "CHUNK", 1 << 12)
    monkeypatch.setattr(recursion, "BROADCAST_CHUNKS", 3)
    n = 1 << 17
    df = spark.range(n).select(F.lit("r").alias("rec_id"), F.lit(0).alias("roi_id"), F.col("id").alias("t_idx"), F.sin(F.col("id") / 50).alias("f"))
    out = filters.lowpass(df, 1.0, 30)
    x = np.sin(np.arange(n) / 50)
    b, a = filters.butter_lowpass(1.0, 30)
    got = out.orderBy("t_idx").toPandas()["f"].to_numpy()
    assert np.allclose(got, filters.filtfilt(b, a, x), atol=1e-9)


def test_missing_samples_spread_as_in_a_series(spark):
    rows = [("r", 0, i, None if i == 70 else 1.0) for i in range(200)]
    df = spark.createDataFrame(rows, "rec_id string, roi_id int, t_idx long, f double")
    got = recursion.recursive_filter(df, *DESIGNS["lowpass"], False, chunk=32).orderBy("t_idx").toPandas()["f"]
    assert got[:70].notna().all() and got[70:].isna().all()


# Percentiles


def test_keys_keep_the_order(spark):
    values = [float("-inf"), -1e308, -2.5, -1e-300, -0.0, 0.0, 5e-324, 1.0, 1.0000000000000002, 3e10, float("inf"), float("nan")]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", quantiles.ordered_key("v").alias("k")).withColumn("back", F.coalesce(quantiles.of_key("k"), F.lit(float("nan")))).toPandas()
    assert got["k"].is_monotonic_increasing and got["k"].is_unique
    assert got["back"].equals(got["v"])


@pytest.mark.parametrize("listed", [1 << 12, 3, 0])
@pytest.mark.parametrize("few", [100_000, 0])
def test_percentiles_by_digits(spark, monkeypatch, listed, few):
    monkeypatch.setattr(quantiles, "LISTED", listed)
    monkeypatch.setattr(quantiles, "BROADCAST_GROUPS", few)
    rng = np.random.default_rng(6)
    groups = {
        ("a", 1): rng.normal(100, 10, 3001), ("a", 2): rng.integers(0, 3, 500).astype(float), ("a", None): np.full(700, -7.25), ("b", 1): np.array([4.0]), ("b", 2): np.array([1.0, 2.0]),
        (None, 3): np.concatenate([-(10.0 ** rng.integers(-300, 300, 400)), 10.0 ** rng.integers(-300, 300, 401)]), ("b", 3): np.nextafter(1.0, 2.0) + np.arange(600) * 2**-52,
    }
    rows = [(*k, float(v)) for k, x in groups.items() for v in x] + [("c", 9, None), ("a", 1, None)]
    df = spark.createDataFrame(rows, "k string, j int, v double").repartition(6)
    shares = [0.0, 0.01, 0.08, 0.5, 0.99, 1.0]
    got = {(r["k"], r["j"]): r["quantiles"] for r in quantiles.exact_percentiles(df, ["k", "j"], "v", shares).collect()}
    want = {(r["k"], r["j"]): r["q"] for r in df.groupBy("k", "j").agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("q")).where("q is not null").collect()}
    assert got == want and len(got) == len(groups)
    assert quantiles.exact_percentiles(df.limit(0), ["k"], "v", shares).count() == 0


def test_nan_is_the_largest(spark):
    df = spark.createDataFrame([(1, float("nan")), (1, 5.0), (1, float("inf"))], "k int, v double")
    got = quantiles.exact_percentiles(df, ["k"], "v", [0.0, 0.5, 1.0]).first()["quantiles"]
    assert got[:2] == [5.0, float("inf")] and np.isnan(got[2])


def test_no_percentile_aggregate_over_a_movie_or_series(spark):
    px = spark.createDataFrame([("r", t, 0, x, float(t * x % 17)) for t in range(30) for x in range(4)], "rec_id string, t_idx long, y int, x int, v double")
    tr = px.select("rec_id", F.col("x").alias("roi_id"), "t_idx", F.col("v").alias("f"))
    for df in (project.quantile_clip(px), traces.dfof_percentile(tr, 8, None)):
        assert "percentile(" not in df._jdf.queryExecution().optimizedPlan().toString()


# Components of images


def plain_components(mask):
    """Labels from 1 in raster order, by flooding."""
    out, n = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask), strict=True):
        if out[y, x]:
            continue
        n += 1
        stack = [(y, x)]
        out[y, x] = n
        while stack:
            a, b = stack.pop()
            for i in range(max(a - 1, 0), min(a + 2, mask.shape[0])):
                for j in range(max(b - 1, 0), min(b + 2, mask.shape[1])):
                    if mask[i, j] and not out[i, j]:
                        out[i, j] = n
                        stack.append((i, j))
    return out


def serpentine(h, w):
    mask = np.zeros((h, w), bool)
    mask[::2] = True
    mask[1::4, -1] = mask[3::4, 0] = True
    return mask


MASKS = {
    "serpentine": serpentine(31, 29), "noise": np.random.default_rng(1).random((40, 37)) < 0.35, "full": np.ones((20, 20), bool), "none": np.zeros((9, 9), bool),
    "diagonals": np.eye(33, dtype=bool) | np.eye(33, dtype=bool)[::-1], "comb": np.add.outer(np.arange(30) == 29, np.arange(30) % 2 == 0) > 0, "dots": np.indices((24, 24)).sum(0) % 4 == 0,
}


def test_a_tile_by_flooding():
    rng = np.random.default_rng(4)
    for mask in [*MASKS.values(), *(rng.random((rng.integers(1, 12), rng.integers(1, 12))) < rng.random() for _ in range(200))]:
        y, x = np.nonzero(mask)
        mixed = rng.permutation(len(y))
        y, x = y[mixed], x[mixed]
        want = plain_components(mask)[y, x]
        got = images.tile_components(y, x)
        for k in np.unique(want):
            here = want == k
            first = np.lexsort((x[here], y[here]))[0]
            assert (got[here] == np.flatnonzero(here)[first]).all()


@pytest.mark.parametrize("side", [5, 8, 512])
def test_components_over_tiles(spark, monkeypatch, side):
    monkeypatch.setattr(images, "TILE", side)
    rows = [(name, int(y), int(x), float(v)) for name, mask in MASKS.items() for (y, x), v in np.ndenumerate(mask)]
    got = images.connected_components(spark.createDataFrame(rows, "rec_id string, y int, x int, v double").repartition(5)).collect()
    want = {(name, int(y), int(x)): int(k) for name, mask in MASKS.items() for (y, x), k in np.ndenumerate(plain_components(mask)) if k}
    assert {(r["rec_id"], r["y"], r["x"]): r["label"] for r in got} == want and len(got) == len(want)


# Low rank


def test_recordings_are_denoised_in_groups(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(f"r{r}", t, 3, 4, (100 + np.outer(np.sin(np.arange(12) + r), [1.0])[:, 0] * t + rng.normal(size=12)).tolist()) for r in range(5) for t in range(30)]
    df = spark.createDataFrame(rows, "rec_id string, t_idx long, h int, w int, pix array<double>").repartition(3)
    want = {(r["rec_id"], r["t_idx"]): r["pix"] for r in models.pca_denoise(df, 2, 3).collect()}
    monkeypatch.setattr(models, "MODEL_BYTES", 2 * 8 * 12 * 5)
    got = {(r["rec_id"], r["t_idx"]): r["pix"] for r in models.pca_denoise(df, 2, 3).collect()}
    assert got.keys() == want.keys() and len(got) == 150 and all(np.allclose(got[k], want[k]) for k in want)
    monkeypatch.setattr(models, "MODEL_BYTES", 100)
    with pytest.raises(ValueError, match="too large"):
        models.pca_denoise(df, 2, 3)


# Densities


def test_counts_of_blocks_are_numpy_s(spark):
    rng = np.random.default_rng(12)
    series = {0: rng.normal(100, 5, 450), 1: np.full(120, 3.0), 2: np.concatenate([rng.integers(0, 11, 200).astype(float), [np.nan, np.inf]]), 3: np.full(100, np.nan), 4: rng.normal(size=30)}
    df = spark.createDataFrame([("r", k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)], "rec_id string, roi_id int, t_idx long, f double").repartition(4)
    got = kde.block_counts(df, 100, 40).toPandas()
    for k, x in series.items():
        size = min(100, len(x))
        for b in range(len(x) // size):
            part = x[b * size : (b + 1) * size]
            part = part[np.isfinite(part)]
            rows = got[(got["roi_id"] == k) & (got["block"] == b)]
            if not len(part):
                assert len(rows) == 1 and rows["bin"].isna().all() and (rows["size"] == 0).all()
                continue
            reach = np.ptp(part) / 10
            assert (rows["size"] == len(part)).all() and np.allclose(rows[["low", "high"]], [part.min() - reach, part.max() + reach])
            counts = np.zeros(40, int)
            counts[rows["bin"].astype(int)] = rows["n"]
            assert counts.sum() == len(part) and (reach == 0 or (counts == np.histogram(part, 40, (part.min() - reach, part.max() + reach))[0]).all())
    assert len(got[["roi_id", "block"]].drop_duplicates()) == 4 + 1 + 2 + 1 + 1


def test_percentiles_of_blocks_are_those_of_their_samples(spark):
    rng = np.random.default_rng(13)
    series = {(0, "a"): np.concatenate([rng.normal(10, 1, 700), rng.normal(20, 3, 310)]), (1, None): rng.normal(size=180), (2, "c"): np.full(90, 5.0), (3, "d"): np.full(60, np.nan)}
    df = spark.createDataFrame([(f"r{k}", roi, i, float(v)) for (k, roi), x in series.items() for i, v in enumerate(x)], "rec_id string, roi_id string, t_idx long, f double").repartition(3)
    for window, most in ((250, None), (None, None), (250, 20.0)):
        got = {(r["rec_id"], r["roi_id"]): r["q"] for r in kde.block_percentiles(df, window, most).collect()}
        for (k, roi), x in series.items():
            size = min(window or len(x), len(x))
            want = np.median([kde.mode_percentile(x[i * size : (i + 1) * size])[0] for i in range(len(x) // size)])
            assert np.isclose(got[f"r{k}", roi], want if most is None else min(want, most)), (k, window)
    assert kde.block_percentiles(df.limit(0), 250).count() == 0
