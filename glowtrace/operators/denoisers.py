"""Denoisers in the shape of pyspark.ml: fitted on one movie, applied to others, saved and loaded."""

from __future__ import annotations

import json

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession

from glowtrace.operators import models

#: Numbers of an array in one row of a saved model.
SAVED = 1 << 20


def _param(name: str, doc: str, kind) -> Param:
    return Param(Params._dummy(), name, doc, kind)


class _Neighbours(Params):
    k = _param("k", "frames of a window, odd", TypeConverters.toInt)
    alpha = _param("alpha", "ridge", TypeConverters.toFloat)
    support = _param("support", "centres that span the kernel's space", TypeConverters.toInt)


class _Patches(Params):
    spatial = _param("spatial", "neighbouring pixels on each side", TypeConverters.toInt)
    temporal = _param("temporal", "frames before and after", TypeConverters.toInt)
    loss = _param("loss", f"one of {models.LOSSES}", TypeConverters.toString)
    decimate = _param("decimate", "every how many frames one is fitted on", TypeConverters.toInt)
    nonneg = _param("nonneg", "weights of at least 0 on the movie as it is", TypeConverters.toBoolean)
    huber = _param("huber", "where the huber loss becomes linear", TypeConverters.toFloat)
    intercept = _param("intercept", "fit a constant", TypeConverters.toBoolean)


class _Writer(MLWriter):
    """Parameters as pyspark.ml saves them, arrays or the table of weights as Parquet."""

    def __init__(self, model: _Saved):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark = SparkSession.active()
        shapes = {k: list(v.shape) for k, v in self.model.arrays.items()}
        DefaultParamsWriter.saveMetadata(self.model, path, spark.sparkContext, {"shapes": json.dumps(shapes)})
        if self.model.table is not None:
            self.model.table.write.parquet(f"{path}/table")
        rows = [(k, i, v.ravel()[i : i + SAVED].tolist()) for k, v in self.model.arrays.items() for i in range(0, max(v.size, 1), SAVED)]
        spark.createDataFrame(rows, "name string, i long, a array<double>").write.parquet(f"{path}/arrays")


class _Reader(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str):
        spark = SparkSession.active()
        meta = DefaultParamsReader.loadMetadata(path, spark.sparkContext)
        shapes, held = json.loads(meta["shapes"]), {}
        for r in sorted(spark.read.parquet(f"{path}/arrays").collect(), key=lambda r: (r["name"], r["i"])):  # a bounded model
            held.setdefault(r["name"], []).append(np.array(r["a"], float))
        arrays = {k: np.concatenate(v).reshape(shapes[k]) for k, v in held.items()}
        model = self.kind(arrays, spark.read.parquet(f"{path}/table") if issubclass(self.kind, ShallowDenoiserModel) else None)
        model._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(model, meta)
        return model


class _Saved(Model, MLWritable, MLReadable):
    def __init__(self, arrays: dict[str, np.ndarray] | None = None, table: DataFrame | None = None):
        super().__init__()
        self.arrays, self.table = arrays or {}, table

    def write(self) -> _Writer:
        return _Writer(self)

    @classmethod
    def read(cls) -> _Reader:
        return _Reader(cls)


class KernelRidgeDenoiser(Estimator, _Neighbours):
    """Frames (rec_id, t_idx, h, w, pix) from their k - 1 neighbours."""

    @keyword_only
    def __init__(self, *, k=5, alpha=0.01, support=1000):
        super().__init__()
        self._setDefault(k=5, alpha=0.01, support=1000)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> KernelRidgeDenoiserModel:
        of = self.getOrDefault
        return self._copyValues(KernelRidgeDenoiserModel(models.fit_kernel_ridge(dataset, of("k"), of("alpha"), of("support"))))


class KernelRidgeDenoiserModel(_Saved, _Neighbours):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        return models.predict_kernel_ridge(dataset, self.getOrDefault("k"), self.arrays)


class KernelPcaDenoiser(Estimator, _Neighbours):
    """Windows of k frames through a kernel PCA and back, averaged where they overlap. ``fit`` and ``transform`` with a column
    ``x2`` take its features of each frame's time as further inputs."""

    components = _param("components", "leading axes", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, k=5, alpha=0.01, support=500, components=32):
        super().__init__()
        self._setDefault(k=5, alpha=0.01, support=500, components=32)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> KernelPcaDenoiserModel:
        of = self.getOrDefault
        features = dataset.select("rec_id", "t_idx", "x2") if "x2" in dataset.columns else None
        return self._copyValues(KernelPcaDenoiserModel(models.fit_kernel_pca(dataset.drop("x2"), of("k"), of("components"), of("alpha"), of("support"), features)))


class KernelPcaDenoiserModel(_Saved, _Neighbours):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        features = dataset.select("rec_id", "t_idx", "x2") if "x2" in dataset.columns else None
        return models.predict_kernel_pca(dataset.drop("x2"), self.getOrDefault("k"), self.arrays, features)


class ShallowDenoiser(Estimator, _Patches):
    """Pixels (rec_id, t_idx, y, x, v) from their neighbours in space and time, a regression a pixel; fitted on one recording."""

    @keyword_only
    def __init__(self, *, spatial=1, temporal=4, loss="mse", decimate=10, nonneg=False, huber=1.0, intercept=True):
        super().__init__()
        self._setDefault(spatial=1, temporal=4, loss="mse", decimate=10, nonneg=False, huber=1.0, intercept=True)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ShallowDenoiserModel:
        of = self.getOrDefault
        return self._copyValues(ShallowDenoiserModel({}, models.fit_shallow(dataset, **{p: of(p) for p in ("spatial", "temporal", "loss", "decimate", "nonneg", "huber", "intercept")})))


class ShallowDenoiserModel(_Saved, _Patches):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        of = self.getOrDefault
        return models.predict_shallow(dataset, self.table, of("spatial"), of("temporal"), of("intercept"))
