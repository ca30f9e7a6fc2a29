"""Fitted models in the shape of pyspark.ml: parameters, fit, transform, and a score."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glowtrace.operators import models
from glowtrace.operators.filters import fir

#: Nonlinearities that can follow the filter.
NONLINEARITIES = ("none", "interp", "sigmoid", "softplus")


class _Filter(Params):
    size = Param(Params._dummy(), "size", "samples of the filter", TypeConverters.toInt)
    hop = Param(Params._dummy(), "hop", "samples between windows", TypeConverters.toInt)
    eps = Param(Params._dummy(), "eps", "share of the mean auto-spectrum that is added to it", TypeConverters.toFloat)
    zeropad = Param(Params._dummy(), "zeropad", "spectrum length in filter sizes", TypeConverters.toInt)
    normalise = Param(Params._dummy(), "normalise", "keep the greatest auto-spectrum", TypeConverters.toBoolean)
    fitSpatial = Param(Params._dummy(), "fitSpatial", "weigh features by least squares", TypeConverters.toBoolean)
    nonlinearity = Param(Params._dummy(), "nonlinearity", "none, interp, sigmoid or softplus", TypeConverters.toString)
    bins = Param(Params._dummy(), "bins", "bins of the nonlinearity", TypeConverters.toInt)


class TemporalFilter(Estimator, _Filter):
    """Response filters of rows (rec_id, t_idx, x array, y): one causal filter a feature, spatial weights, a nonlinearity."""

    @keyword_only
    def __init__(self, *, size=16, hop=2, eps=0.01, zeropad=1, normalise=True, fitSpatial=True, nonlinearity="none", bins=10):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(size=16, hop=2, eps=0.01, zeropad=1, normalise=True, fitSpatial=True, nonlinearity="none", bins=10)

    def _fit(self, dataset: DataFrame) -> TemporalFilterModel:
        of = self.getOrDefault
        if of("nonlinearity") not in NONLINEARITIES:
            raise ValueError(f"nonlinearity must be one of {NONLINEARITIES}")
        first = dataset.select(F.size("x").alias("n")).first()
        n = first["n"] if first else 0
        filters = [
            models.temporal_filter(dataset.select("rec_id", "t_idx", F.col("x")[i].alias("x"), "y"), of("size"), of("hop"), of("eps"), of("zeropad"), of("normalise")).real.tolist()
            for i in range(n)
        ]
        model = TemporalFilterModel(filters, [1.0] * n, of("nonlinearity"), None)
        if of("fitSpatial") and n > 1:
            rows = model.filtered(dataset)
            model = TemporalFilterModel(filters, models.spatial_weights(rows, "y", "filtered", n).tolist(), of("nonlinearity"), None)
        if of("nonlinearity") != "none":
            model.table = models.binned(model.linear(dataset), "prediction", "y", of("bins"))
        return self._copyValues(model)


class TemporalFilterModel(Model, _Filter):
    """filters (a list a feature), weights (one a feature), table (the nonlinearity's bins)."""

    def __init__(self, filters: list[list[float]], weights: list[float], nonlinearity: str, table: DataFrame | None):
        super().__init__()
        self.filters, self.weights, self.kind, self.table = filters, weights, nonlinearity, table

    def filtered(self, dataset: DataFrame) -> DataFrame:
        """dataset with ``filtered``: each feature through its filter."""
        out = dataset
        for i, h in enumerate(self.filters):
            one = fir(dataset.select("rec_id", "t_idx", F.col("x")[i].alias("f")), h, ["rec_id"]).withColumnRenamed("f", f"_f{i}")
            out = out.join(one, ["rec_id", "t_idx"])
        names = [f"_f{i}" for i in range(len(self.filters))]
        return out.withColumn("filtered", F.array(*names)).drop(*names)

    def linear(self, dataset: DataFrame) -> DataFrame:
        total = sum((F.col("filtered")[i] * w for i, w in enumerate(self.weights)), F.lit(0.0))
        return self.filtered(dataset).withColumn("prediction", total).drop("filtered")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        rows = self.linear(dataset)
        if self.table is None:
            return rows
        rows = rows.withColumnRenamed("prediction", "_linear")
        fit = models.interpolated_nonlinearity(rows, "_linear", self.table) if self.kind == "interp" else models.fitted_nonlinearity(rows, "_linear", self.table, self.kind)
        return fit.withColumnRenamed("rate", "prediction").drop("_linear")

    def score(self, dataset: DataFrame) -> float:
        """R squared."""
        return models.r2_score(self.transform(dataset), "y", "prediction").first()["r2"]
