"""Denoisers that are fitted on one movie, saved, loaded, and applied to another."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glowtrace.operators import denoisers as dn
from glowtrace.operators import models as md
from glowtrace.sources.tables import pixels_of


def movie(seed, n=90, noise=0.3):
    rng = np.random.default_rng(seed)
    t = np.arange(n)[:, None, None]
    y, x = np.mgrid[:4, :5]
    clean = 10 + 3 * np.sin(t / 6 + seed) * (y + 1) + 2 * np.cos(t / 9) * x
    return clean, clean + noise * rng.normal(size=clean.shape)


def frames(spark, *movies):
    rows = [(f"r{r}", i, 4, 5, m.ravel().tolist(), [float(np.sin(i / 6)), float(i)]) for r, movie_ in enumerate(movies) for i, m in enumerate(movie_)]
    return spark.createDataFrame(rows, "rec_id string, t_idx long, h int, w int, pix array<double>, x2 array<double>").repartition(3)


def rounded(df):
    return sorted(tuple(np.round(v, 9) if isinstance(v, float) else tuple(np.round(v, 9)) if isinstance(v, list) else v for v in r) for r in df.collect())


def saved(model, tmp_path):
    model.write().overwrite().save(str(tmp_path / "model"))
    return type(model).load(str(tmp_path / "model"))


@pytest.mark.parametrize("kind, options", [(dn.KernelRidgeDenoiser, {"support": 60}), (dn.KernelPcaDenoiser, {"support": 50, "components": 8, "k": 3})])
def test_kernel_models_are_kept(spark, tmp_path, kind, options):
    (_, one), (clean, two) = movie(1), movie(2)
    first, second = frames(spark, one).drop("x2"), frames(spark, two).drop("x2")
    model = kind(**options).fit(first)
    again = saved(model, tmp_path)
    assert again.uid == model.uid and {p.name: again.getOrDefault(p) for p in again.params if again.isDefined(p)} == {p.name: model.getOrDefault(p) for p in model.params if model.isDefined(p)}
    got = rounded(model.transform(second))
    assert got == rounded(again.transform(second)) and got != rounded(kind(**options).fit(second).transform(second))
    # On its own movie it is what the operator gives.
    whole = md.kernel_ridge(first, support=60) if kind is dn.KernelRidgeDenoiser else md.kernel_pca(first, 3, 8, support=50)
    assert rounded(again.transform(first)) == rounded(whole)


def test_features_are_kept(spark, tmp_path):
    first, second = (frames(spark, movie(s)[1]) for s in (3, 4))
    model = dn.KernelPcaDenoiser(k=3, components=6, support=40).fit(first)
    assert model.arrays["scales"].shape == (2, 2)
    again = saved(model, tmp_path)
    assert rounded(again.transform(second)) == rounded(model.transform(second))
    moved = second.withColumn("x2", F.transform("x2", lambda v: v + 5))
    assert rounded(again.transform(moved)) != rounded(model.transform(second))
    with pytest.raises(ValueError, match="both"):
        again.transform(second.drop("x2"))


@pytest.mark.parametrize("options", [{}, {"nonneg": True, "loss": "kl"}, {"loss": "huber", "intercept": False}])
def test_pixel_models_are_kept(spark, tmp_path, options):
    options = {"temporal": 1, "decimate": 1, "spatial": 1} | options
    (_, one), (clean, two) = movie(5), movie(6)
    first, second = (pixels_of(frames(spark, m).drop("x2")) for m in (one, two))
    model = dn.ShallowDenoiser(**options).fit(first)
    again = saved(model, tmp_path)
    both = second.union(second.withColumn("rec_id", F.lit("other")))
    got = again.transform(both).toPandas()
    assert len(got) == 2 * two.size and got["rec_id"].nunique() == 2
    assert rounded(again.transform(second)) == rounded(model.transform(second))
    mine = got[got["rec_id"] == "other"].sort_values(["t_idx", "y", "x"])["v"].to_numpy().reshape(two.shape)
    assert np.abs(mine - clean)[2:-2].mean() < 1.2
    # On its own movie it is what the operator gives.
    assert np.allclose([r[-1] for r in rounded(again.transform(first))], [r[-1] for r in rounded(md.shallow_denoise(first, **options))], atol=1e-6)
    with pytest.raises(ValueError, match="one recording"):
        dn.ShallowDenoiser(**options).fit(both)
    with pytest.raises(Exception, match="too many"):
        dn.ShallowDenoiser(**options | {"decimate": 10}).fit(first).table.collect()
