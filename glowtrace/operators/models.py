"""Fits: debleaching, low rank, neighbour regressions, kernel models, response filters and nonlinearities."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glowtrace.functions import sigmoid, softplus
from glowtrace.operators.project import standardise, unstandardise
from glowtrace.operators.quantiles import exact_percentiles
from glowtrace.operators.windows import by, delay_embed_without_middle
from glowtrace.sources.scratch import checkpointed


def least_squares(f: Callable[[np.ndarray, np.ndarray], np.ndarray], x: np.ndarray, y: np.ndarray, start: Sequence[float], w: np.ndarray | None = None, low: np.ndarray | None = None, high: np.ndarray | None = None, steps: int = 200) -> np.ndarray:
    """Levenberg-Marquardt with a numeric Jacobian, clipped to bounds."""
    p, lam = np.array(start, float), 1e-3
    w = np.ones_like(y) if w is None else w
    clip = lambda q: np.clip(q, -np.inf if low is None else low, np.inf if high is None else high)
    loss = lambda q: float(np.sum((w * (f(x, q) - y)) ** 2))
    best = loss(p)
    for _ in range(steps):
        h = 1e-6 * np.maximum(1e-4, np.abs(p))
        r = w * (f(x, p) - y)
        jac = np.stack([w * (f(x, p + h * e) - f(x, p - h * e)) / (2 * h[i]) for i, e in enumerate(np.eye(len(p)))], axis=1)
        gram = jac.T @ jac
        step = np.linalg.lstsq(gram + lam * np.diag(np.maximum(np.diag(gram), 1e-12)), -jac.T @ r, rcond=None)[0]
        q = clip(p + step)
        now = loss(q)
        if np.isfinite(now) and now < best:
            done = best - now < 1e-14 * max(best, 1e-300)
            p, best, lam = q, now, max(lam / 5, 1e-12)
            if done:
                break
        else:
            lam *= 4
            if lam > 1e12:
                break
    return p


# Bleaching.


def debleach_linear(pixels: DataFrame) -> DataFrame:
    """Less the line through the frames' medians, at their own median's level."""
    med = pixels.groupBy("rec_id", "t_idx").agg(F.median("v").alias("m"))
    fit = med.groupBy("rec_id").agg(F.regr_slope("m", "t_idx").alias("a"), F.regr_intercept("m", "t_idx").alias("b"), F.median("m").alias("level"))
    rows = pixels.join(fit, "rec_id")
    return rows.withColumn("v", F.col("v") - (F.col("a") * F.col("t_idx") + F.col("b") - F.col("level"))).select(pixels.columns)


def debleach(pixels: DataFrame) -> DataFrame:
    """Less the exponential through the frames' medians, or the line where no exponential fits better. A recording's medians,
    one number a frame, are fitted in one group."""
    med = pixels.groupBy("rec_id", "t_idx").agg(F.median("v").alias("m"))

    def fit(rec: pd.DataFrame) -> pd.DataFrame:
        rec = rec.sort_values("t_idx")
        x, y = rec["t_idx"].to_numpy(float), rec["m"].to_numpy(float)
        f = lambda x, p: p[0] * np.exp(-np.clip(p[1] * x, -700, 700)) + p[2]
        line = np.polyval(np.polyfit(x, y, 1), x) if len(x) > 1 else y
        curve = min((f(x, least_squares(f, x, y, s)) for s in ((y[0] - y[-1], 1e-6, y[-1]), (y[0] - y[-1], 1 / max(1, len(x)), y[-1]))), key=lambda c: ((c - y) ** 2).sum())
        best = curve if np.isfinite(curve).all() and ((curve - y) ** 2).sum() <= ((line - y) ** 2).sum() else line
        return rec[["rec_id", "t_idx"]].assign(off=best - np.median(y))

    off = med.groupBy("rec_id").applyInPandas(fit, "rec_id string, t_idx long, off double")
    return pixels.join(off, ["rec_id", "t_idx"]).withColumn("v", F.col("v") - F.col("off")).select(pixels.columns)


def hat_basis(n: int, knots: int) -> np.ndarray:
    at = np.linspace(0, n - 1, max(2, knots))
    return np.stack([np.interp(np.arange(n), at, e) for e in np.eye(len(at))], axis=1)


def debleach_spline(pixels: DataFrame, knots: int) -> DataFrame:
    """Less the piecewise-linear fit of the frames' means; the level isn't restored."""
    mean = pixels.groupBy("rec_id", "t_idx").agg(F.avg("v").alias("m"))

    def fit(rec: pd.DataFrame) -> pd.DataFrame:
        rec = rec.sort_values("t_idx")
        b = hat_basis(len(rec), knots)
        return rec[["rec_id", "t_idx"]].assign(off=b @ np.linalg.lstsq(b, rec["m"].to_numpy(float), rcond=None)[0])

    off = mean.groupBy("rec_id").applyInPandas(fit, "rec_id string, t_idx long, off double")
    return pixels.join(off, ["rec_id", "t_idx"]).withColumn("v", F.col("v") - F.col("off")).select(pixels.columns)


def spline_basis(n: int, knots: int, degree: int = 3) -> np.ndarray:
    """B-splines over n places with evenly spaced knots, the outermost at the ends, by Cox and de Boor's recursion."""
    if n == 1:
        return np.ones((1, 1))
    x, knots = np.arange(n, dtype=float), max(2, knots)
    step = (n - 1) / (knots - 1)
    t = step * np.arange(-degree, knots + degree)
    b = np.zeros((n, len(t) - 1))
    b[np.arange(n), np.minimum((x / step).astype(int), knots - 2) + degree] = 1
    for d in range(1, degree + 1):
        b = ((x[:, None] - t[: -d - 1]) * b[:, :-1] + (t[d + 1 :] - x[:, None]) * b[:, 1:]) / (d * step)
    return b


def spline_smooth(pixels: DataFrame, knots: int | None = None, per_second: float | None = None, rate: float = 1.0, degree: int = 3) -> DataFrame:
    """Every pixel's series through the least-squares fit of one shared basis of B-splines, of ``knots`` knots or of
    ``per_second`` for each second at the frame ``rate``. A pixel's series is a group."""
    if (knots is None) == (per_second is None):
        raise ValueError("give knots or per_second")

    def run(series: pd.DataFrame) -> pd.DataFrame:
        series = series.sort_values("t_idx")
        b = spline_basis(len(series), knots if knots is not None else round((len(series) - 1) / rate * per_second), degree)
        return series.assign(v=b @ np.linalg.lstsq(b, series["v"].to_numpy(float), rcond=None)[0])

    return pixels.groupBy("rec_id", "y", "x").applyInPandas(run, pixels.schema)


# Low rank.


def summed_arrays(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, a): arrays added up, in two rounds, so that no group holds the parts of all tasks."""
    keys = list(keys)

    def add(part: pd.DataFrame) -> pd.DataFrame:
        return part[keys].iloc[:1].assign(a=[np.sum(part["a"].to_list(), axis=0)])

    schema = parts.select(*keys, "a").schema
    once = parts.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(32))).groupBy(*keys, "_salt").applyInPandas(add, schema)
    return once.groupBy(*keys).applyInPandas(add, schema)


#: Columns of a sum that travel as one row, and the bytes of a model that is sent to every task.
TILE, MODEL_BYTES = 1024, 512 << 20


def _tiles(total: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """A sum (rows, columns) in tiles of columns."""
    return [(i, total[:, i : i + TILE].ravel()) for i in range(0, total.shape[1], TILE)]


def _untiled(rows: list, height: int) -> np.ndarray:
    return np.concatenate([np.asarray(r["a"]).reshape(height, -1) for r in sorted(rows, key=lambda r: r["i"])], axis=1)


def pca_denoise(frames: DataFrame, components: int = 100, oversample: int = 10, passes: int = 2) -> DataFrame:
    """Frames from their leading components, by a randomised range finder (Halko et al., 2011): a first pass adds up random
    mixtures of each recording's frames, the others multiply the covariance into their span. What meets the driver is
    ``components`` + ``oversample`` numbers a pixel and recording, never the pixels' covariance. Recordings are taken in
    groups whose models stay below ``MODEL_BYTES``, one group after the other, each written before the next; a single
    recording beyond that is refused."""
    wide = components + oversample
    sizes = frames.groupBy("rec_id").agg(F.max(F.size("pix")).alias("n")).orderBy("rec_id").collect()  # a row a recording
    groups, room = [], 0
    for rec, n in sizes:
        bytes_ = 8 * n * min(wide, n)
        if bytes_ > MODEL_BYTES:
            raise ValueError(f"the model of {rec} is too large: cut the movie into tiles, or take fewer components")
        if bytes_ > room:
            groups.append([])
            room = MODEL_BYTES
        groups[-1].append(rec)
        room -= bytes_
    if len(groups) < 2:
        return _pca_denoised(frames, components, wide, passes)
    parts = [checkpointed(frames.sparkSession, _pca_denoised(frames.where(F.col("rec_id").isin(g)), components, wide, passes)) for g in groups]
    return reduce(DataFrame.union, parts)


def _pca_denoised(frames: DataFrame, components: int, wide: int, passes: int) -> DataFrame:

    def summed(weigh: Callable[[str, np.ndarray, np.ndarray], np.ndarray]) -> dict[str, np.ndarray]:
        """For each recording the sums of (1, a frame's weights) times (1, the frame)."""

        def add(batches):
            total: dict[str, np.ndarray] = {}
            for batch in batches:
                for rec, part in batch.groupby("rec_id"):
                    x = np.stack(part["pix"].to_numpy()).astype(float)
                    w = np.column_stack([np.ones(len(x)), weigh(rec, x, part["t_idx"].to_numpy())])
                    total[rec] = total.get(rec, 0.0) + w.T @ np.column_stack([np.ones(len(x)), x])
                if sum(t.nbytes for t in total.values()) > MODEL_BYTES // 2:
                    yield from rows_of(total)
            yield from rows_of(total)

        def rows_of(total):
            for rec, t in total.items():
                for i, tile in _tiles(t):
                    yield pd.DataFrame({"rec_id": [rec], "h": [len(t)], "i": [i], "a": [tile]})
            total.clear()

        held: dict[str, list] = {}
        for r in summed_arrays(frames.mapInPandas(add, "rec_id string, h int, i int, a array<double>"), ["rec_id", "h", "i"]).collect():
            held.setdefault(r["rec_id"], []).append(r)
        return {rec: _untiled(rows, rows[0]["h"]) for rec, rows in held.items()}

    def centred(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The mean frame, and the sums of weights times frames less it, a column a weight."""
        mean = t[0, 1:] / t[0, 0]
        return mean, (t[1:, 1:] - t[1:, :1] * mean).T

    first = {rec: centred(t) for rec, t in summed(lambda rec, x, t: np.stack([np.random.default_rng(i).normal(size=wide) for i in t.tolist()])).items()}
    means = {rec: mean for rec, (mean, _) in first.items()}
    spans = {rec: np.eye(len(y)) if len(y) <= wide else np.linalg.qr(y)[0] for rec, (_, y) in first.items()}
    for i in range(passes):
        last = {rec: centred(t)[1] for rec, t in summed(lambda rec, x, t: (x - means[rec]) @ spans[rec]).items()}
        if i + 1 < passes:
            spans = {rec: spans[rec] if len(y) <= wide else np.linalg.qr(y)[0] for rec, y in last.items()}
    bases = {}
    for rec, y in last.items():
        inner = spans[rec].T @ y
        vectors = np.linalg.eigh((inner + inner.T) / 2)[1][:, ::-1][:, :components]
        bases[rec] = (means[rec], spans[rec] @ vectors)

    def run(batches):
        for batch in batches:
            out = []
            for rec, pix in zip(batch["rec_id"], batch["pix"], strict=True):
                mean, v = bases[rec]
                out.append(mean + v @ (v.T @ (np.asarray(pix, float) - mean)))
            yield batch.assign(pix=out)

    return frames.mapInPandas(run, frames.schema)


def normal_equations(rows: DataFrame, target: str, features: str, n: int, ridge: float = 0.0, intercept: bool = True) -> np.ndarray:
    """Least-squares weights of an array column, from sums of products: one row of n squared sums."""
    x = F.concat(F.col(features), F.array(F.lit(1.0))) if intercept else F.col(features)
    size = n + intercept
    rows = rows.select(x.alias("x"), F.col(target).alias("y")).where("y is not null")
    sums = [F.sum(F.col("x")[i] * F.col("x")[j]) for i in range(size) for j in range(i, size)] + [F.sum(F.col("x")[i] * F.col("y")) for i in range(size)]
    got = [0.0 if v is None else float(v) for v in rows.agg(*[s.alias(f"s{k}") for k, s in enumerate(sums)]).first()]
    gram = np.zeros((size, size))
    gram[np.triu_indices(size)] = got[: -size]
    gram = gram + np.triu(gram, 1).T
    penalty = np.eye(size) * ridge
    if intercept:
        penalty[-1, -1] = 0
    return np.linalg.lstsq(gram + penalty, np.array(got[-size:]), rcond=None)[0]


def neighbour_ridge(pixels: DataFrame, k: int = 5, ridge: float = 0.01, decimate: int | None = None) -> DataFrame:
    """(rec_id, y, x, t_idx, v): the middle frame from its k - 1 neighbours in time, one set of weights for all
    pixels; pixels are standardised first, and what lies outside the movie is their mean."""
    rows = delay_embed_without_middle(standardise(pixels), k)
    train = rows.where(F.col("t_idx") % decimate == 0) if decimate else rows
    w = normal_equations(train, "v", "window", k - 1, ridge)
    dot = sum((F.col("window")[i] * float(w[i]) for i in range(k - 1)), F.lit(float(w[-1])))
    return unstandardise(rows.select("rec_id", "y", "x", "t_idx", dot.alias("v")), pixels)


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, sweeps: int = 500) -> np.ndarray:
    """Least squares with weights of at least 0, by coordinates of the normal equations."""
    gram, right = a.T @ a, a.T @ b
    scale = np.maximum(np.diag(gram), 1e-12)
    w = np.zeros(len(right))
    for _ in range(sweeps):
        before = w.copy()
        for j in range(len(w)):
            w[j] = max(0.0, w[j] + (right[j] - gram[j] @ w) / scale[j])
        if np.abs(w - before).max() <= 1e-12 * max(1.0, np.abs(w).max()):
            break
    return w


def divergence_fit(a: np.ndarray, b: np.ndarray, steps: int = 500) -> np.ndarray:
    """Weights of at least 0 with the least Kullback-Leibler divergence of the prediction from b, both plus 1: projected
    gradient steps, halved until they help."""
    loss = lambda w: float(np.sum((p := a @ w + 1) * np.log(p / (b + 1)) - p + b + 1))
    w, size = nonnegative_least_squares(a, b), 1.0
    best = loss(w)
    for _ in range(steps):
        slope = a.T @ np.log((a @ w + 1) / (b + 1))
        while size > 1e-18:
            new = np.maximum(w - size * slope, 0)
            now = loss(new)
            if now < best:
                break
            size /= 2
        else:
            break
        done, w, best, size = best - now < 1e-12 * max(best, 1e-12), new, now, size * 4
        if done:
            break
    return w


LOSSES = ("mse", "mae", "huber", "kl")


def _fit(a: np.ndarray, b: np.ndarray, loss: str, nonneg: bool, huber: float) -> np.ndarray:
    if loss == "kl":
        return divergence_fit(a, b)
    w = np.ones(len(b))
    for _ in range(1 if loss == "mse" else 30):
        root = np.sqrt(w)[:, None]
        fit = nonnegative_least_squares(a * root, b * root[:, 0]) if nonneg else np.linalg.lstsq(a * root, b * root[:, 0], rcond=None)[0]
        r = np.abs(a @ fit - b)
        w = np.minimum(1.0, huber / np.maximum(r, 1e-9)) if loss == "huber" else 1 / np.maximum(r, 1e-6)
    return fit


def _neighbours(pixels: DataFrame, spatial: int) -> DataFrame:
    """(rec_id, t_idx, y, x, o, v): each sample sent to the pixels it is a neighbour of; o counts neighbours, 0 is the pixel."""
    side = F.sequence(F.lit(-spatial), F.lit(spatial))
    to = F.flatten(F.transform(side, lambda dy: F.transform(side, lambda dx: F.struct(dy.alias("dy"), dx.alias("dx")))))
    rows = pixels.select("rec_id", "t_idx", "y", "x", "v", F.explode(to).alias("o"))
    return rows.select("rec_id", "t_idx", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), (F.col("o.dy") * (2 * spatial + 1) + F.col("o.dx")).alias("o"), "v")


def _patches(series: pd.DataFrame, spatial: int, temporal: int, intercept: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(t_idx, inputs, targets) of one pixel's series; what lies outside is 0. None for a place beyond the image."""
    reach = (2 * spatial + 1) * spatial + spatial
    table = series.pivot_table(index="t_idx", columns="o", values="v", fill_value=0.0)
    if 0 not in table:
        return None
    y, n = table[0].to_numpy(float), len(table)
    padded = np.pad(table.reindex(columns=range(-reach, reach + 1), fill_value=0.0).to_numpy(float), ((temporal, temporal), (0, 0)))
    x = np.concatenate([padded[temporal + d : temporal + d + n] for d in range(-temporal, temporal + 1) if d], axis=1)
    return table.index.to_numpy(), np.column_stack([x, np.ones(n)]) if intercept else x, y


def _checked_weights(spatial: int, temporal: int, decimate: int, n: int, loss: str, nonneg: bool) -> None:
    if loss not in LOSSES or (loss == "kl" and not nonneg):
        raise ValueError(f"loss must be one of {LOSSES}, and kl needs nonneg")
    wide, fitted = (2 * spatial + 1) ** 2 * 2 * temporal, -(-n // decimate)
    if n >= 0 and wide >= fitted / 4:
        raise ValueError(f"{wide} weights are too many for {fitted} frames")


def shallow_denoise(pixels: DataFrame, spatial: int = 1, temporal: int = 4, loss: str = "mse", decimate: int = 10, nonneg: bool = False, huber: float = 1.0, intercept: bool = True) -> DataFrame:
    """Each pixel from the frames before and after of its spatial neighbours, by its own regression (loss mse, mae, huber or
    kl), fitted on every ``decimate``-th frame; the middle frame is left out. The movie is standardised, and what lies outside
    is its mean; with ``nonneg``, which kl needs, it is not, weights are at least 0 and outside is 0. Fewer than four fitted
    frames a weight are an error. Neighbours are sent to the pixel as rows; a group is one pixel's series."""
    _checked_weights(spatial, temporal, decimate, -1, loss, nonneg)

    def run(pixel: pd.DataFrame) -> pd.DataFrame:
        got = _patches(pixel, spatial, temporal, intercept)
        if got is None:
            return pixel[["rec_id", "y", "x", "t_idx", "v"]].iloc[:0]
        t, x, y = got
        _checked_weights(spatial, temporal, decimate, len(t), loss, nonneg)
        fit = _fit(x[::decimate], y[::decimate], loss, nonneg, huber)
        rec, py, px = (pixel[c].iloc[0] for c in ("rec_id", "y", "x"))
        return pd.DataFrame({"rec_id": [rec] * len(t), "y": [py] * len(t), "x": [px] * len(t), "t_idx": t, "v": x @ fit})

    rows = _neighbours(pixels if nonneg else standardise(pixels, "overall"), spatial)
    fitted = rows.groupBy("rec_id", "y", "x").applyInPandas(run, "rec_id string, y int, x int, t_idx long, v double")
    return fitted if nonneg else unstandardise(fitted, pixels, "overall")


def fit_shallow(pixels: DataFrame, spatial: int = 1, temporal: int = 4, loss: str = "mse", decimate: int = 10, nonneg: bool = False, huber: float = 1.0, intercept: bool = True) -> DataFrame:
    """(y, x, mean, scale, weights): the regressions of ``shallow_denoise`` of one recording, a row a pixel, as a table. Several
    recordings are an error."""
    _checked_weights(spatial, temporal, decimate, -1, loss, nonneg)
    if pixels.select("rec_id").distinct().limit(2).count() > 1:
        raise ValueError("weights are fitted on one recording")
    moments = pixels.agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("scale")).first()
    mean, scale = (0.0, 1.0) if nonneg else (float(moments["mean"] or 0.0), float(moments["scale"] or 0.0) or 1.0)

    def run(pixel: pd.DataFrame) -> pd.DataFrame:
        got = _patches(pixel, spatial, temporal, intercept)
        if got is None:
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("y", "x", "mean", "scale", "weights")})
        _, x, y = got
        _checked_weights(spatial, temporal, decimate, len(y), loss, nonneg)
        return pd.DataFrame({"y": pixel["y"][:1], "x": pixel["x"][:1], "mean": mean, "scale": scale, "weights": [_fit(x[::decimate], y[::decimate], loss, nonneg, huber)]})

    rows = _neighbours(pixels.withColumn("v", (F.col("v") - mean) / scale), spatial)
    return rows.groupBy("y", "x").applyInPandas(run, "y int, x int, mean double, scale double, weights array<double>")


def predict_shallow(pixels: DataFrame, weights: DataFrame, spatial: int = 1, temporal: int = 4, intercept: bool = True) -> DataFrame:
    """(rec_id, y, x, t_idx, v): pixels of any recordings by the weights of ``fit_shallow``; pixels without weights are left
    out. Weights meet each pixel's neighbours by a cogroup, so the model is never in one place."""
    scales = weights.select("mean", "scale").first()
    mean, scale = (scales["mean"], scales["scale"]) if scales else (0.0, 1.0)
    columns = ["rec_id", "y", "x", "t_idx", "v"]

    def run(pixel: pd.DataFrame, fit: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame(columns=columns)]
        if len(fit):
            for rec, series in pixel.groupby("rec_id"):
                got = _patches(series, spatial, temporal, intercept)
                if got is not None:
                    t, x, _ = got
                    out.append(pd.DataFrame({"rec_id": rec, "y": series["y"].iloc[0], "x": series["x"].iloc[0], "t_idx": t, "v": x @ fit["weights"].iloc[0] * scale + mean}))
        return pd.concat(out[1:]) if len(out) > 1 else out[0]

    rows = _neighbours(pixels.withColumn("v", (F.col("v") - mean) / scale), spatial)
    return rows.groupBy("y", "x").cogroup(weights.groupBy("y", "x")).applyInPandas(run, "rec_id string, y int, x int, t_idx long, v double")


def rbf(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    return np.exp(-gamma * np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


def _centres(rows: DataFrame, most: int, column: str) -> np.ndarray:
    """A bounded set of rows that span a kernel's space; the sums that fit a model run over all rows."""
    picked = rows.orderBy(F.xxhash64("rec_id", "t_idx"), "rec_id", "t_idx").limit(most).select(column).collect()
    return np.array([r[column] for r in picked], float)


def _sums(rows: DataFrame, columns: Sequence[str], add: Callable[[dict[str, np.ndarray]], list[np.ndarray]]) -> list[np.ndarray]:
    """Matrices that ``add`` makes of each batch's columns, summed over all rows."""

    def run(batches):
        total: list[np.ndarray] = []
        for batch in batches:
            if len(batch):
                parts = add({c: np.stack(batch[c].to_numpy()).astype(float) for c in columns})
                total = [t + p for t, p in zip(total, parts, strict=True)] if total else parts
        for m, t in enumerate(total):
            for i, tile in _tiles(t):
                yield pd.DataFrame({"m": [m], "h": [len(t)], "i": [i], "a": [tile]})

    found: dict[int, list] = {}
    for r in summed_arrays(rows.select(*columns).mapInPandas(run, "m int, h int, i int, a array<double>"), ["m", "h", "i"]).collect():
        found.setdefault(r["m"], []).append(r)
    return [_untiled(found[m], found[m][0]["h"]) for m in sorted(found)]


def _bounded(*arrays: np.ndarray) -> None:
    if sum(a.nbytes for a in arrays) > MODEL_BYTES:
        raise ValueError("the model is too large to send to every task: cut the movie into tiles, or take fewer centres")


def _ridge_on_centres(gram: np.ndarray, target: np.ndarray, kernel: np.ndarray, alpha: float) -> np.ndarray:
    """Kernel ridge weights of the centres from sums over all rows (Nystroem)."""
    return np.linalg.lstsq(gram + alpha * kernel + 1e-10 * np.trace(gram) / len(gram) * np.eye(len(gram)), target, rcond=None)[0]


def fit_kernel_ridge(frames: DataFrame, k: int = 5, alpha: float = 0.01, support: int = 1000) -> dict[str, np.ndarray]:
    """The arrays of a kernel ridge regression of frames on their k - 1 neighbours: ``scale`` (means of inputs and targets, and
    gamma), the centres ``x`` and their weights ``dual``. Sums run over all frames; ``support`` bounds the centres."""
    rows = embed_frames(frames, k, middle=False)
    ((sx, nx, sy, ny),) = _sums(rows, ["window", "pix"], lambda b: [np.array([[b["window"].sum(), b["window"].size, b["pix"].sum(), b["pix"].size]])])[0]
    mx, my = sx / nx, sy / ny
    x = _centres(rows, support, "window") - mx
    gamma = 1 / x.shape[1]

    def add(batch):
        at = rbf(batch["window"] - mx, x, gamma)
        return [at.T @ at, at.T @ (batch["pix"] - my)]

    gram, target = _sums(rows, ["window", "pix"], add)
    return {"scale": np.array([mx, my, gamma]), "x": x, "dual": _ridge_on_centres(gram, target, rbf(x, x, gamma), alpha)}


def predict_kernel_ridge(frames: DataFrame, k: int, model: dict[str, np.ndarray]) -> DataFrame:
    """Frames from their neighbours by the arrays of ``fit_kernel_ridge``, of this movie or another of the same size."""
    (mx, my, gamma), x, dual = (model[c] for c in ("scale", "x", "dual"))
    _bounded(x, dual)

    def run(batches):
        for batch in batches:
            if len(batch):
                out = rbf(np.stack(batch["window"]) - mx, x, gamma) @ dual + my
                yield batch.drop(columns=["window"]).assign(pix=list(out))

    return embed_frames(frames, k, middle=False).mapInPandas(run, frames.select("rec_id", "t_idx", "h", "w", "pix").schema)


def kernel_ridge(frames: DataFrame, k: int = 5, alpha: float = 0.01, support: int = 1000) -> DataFrame:
    """Each frame from its k - 1 neighbours by kernel ridge regression, fitted on all frames over the kernel's values at
    ``support`` centres, a documented bound; with as many centres as frames it is the exact one."""
    return predict_kernel_ridge(frames, k, fit_kernel_ridge(frames, k, alpha, support))


def support_vectors(kernel: np.ndarray, y: np.ndarray, most: float, epsilon: float, sweeps: int = 200) -> np.ndarray:
    """Dual weights of epsilon-insensitive regressions, a column each, by coordinates; the kernel includes the constant."""
    dual = np.zeros_like(y)
    for _ in range(sweeps):
        moved = 0.0
        for i in range(len(y)):
            rest = y[i] - kernel[i] @ dual + kernel[i, i] * dual[i]
            new = np.clip(np.sign(rest) * np.maximum(np.abs(rest) - epsilon, 0) / kernel[i, i], -most, most)
            moved = max(moved, float(np.abs(new - dual[i]).max()))
            dual[i] = new
        if moved < 1e-8:
            break
    return dual


def support_vector_frames(frames: DataFrame, k: int = 5, alpha: float = 0.01, decimate: int = 1, epsilon: float | None = None, most: int = 1000) -> DataFrame:
    """Each frame from its k - 1 neighbours by support vector regressions, one a pixel, fitted on every ``decimate``-th frame:
    fewer than ``most`` of them, or it is an error. The insensitive band is by default the tenth percentile of the fitted
    pixels' deviations, the bound of the weights is 1 / alpha; the movie is standardised."""
    rows = embed_frames(frames, k, middle=False)
    train = rows.where(F.col("t_idx") % decimate == 0).limit(most).select("window", "pix").collect()
    if len(train) >= most:
        raise ValueError(f"support vector regression takes fewer than {most} frames; decimate more")
    x, y = np.array([r["window"] for r in train]), np.array([r["pix"] for r in train])
    mean, scale = y.mean(), max(float(y.std()), 1e-12)
    x, y = (x - mean) / scale, (y - mean) / scale
    gamma = 1 / x.shape[1]
    dual = support_vectors(rbf(x, x, gamma) + 1, y, 1 / alpha, float(np.percentile(y.std(axis=0), 10)) if epsilon is None else epsilon)
    _bounded(x, dual)

    def run(batches):
        for batch in batches:
            if len(batch):
                out = (rbf((np.stack(batch["window"]) - mean) / scale, x, gamma) + 1) @ dual * scale + mean
                yield batch.drop(columns=["window"]).assign(pix=list(out))

    return rows.mapInPandas(run, frames.select("rec_id", "t_idx", "h", "w", "pix").schema)


def feature_scales(features: DataFrame) -> np.ndarray:
    """Rows (mean, deviation) of features (rec_id, t_idx, x2)."""
    stats = features.select(F.posexplode("x2").alias("j", "x")).groupBy("j").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    return np.array([(m, s or 1.0) for _, m, s in sorted(stats.collect())], float).reshape(-1, 2)  # a row a feature


def with_features(frames: DataFrame, features: DataFrame, scales: np.ndarray | None = None) -> DataFrame:
    """Frames whose ``pix`` starts with the features (rec_id, t_idx, x2) of their time, standardised, or by ``scales``."""
    scales = feature_scales(features) if scales is None else scales
    scaled = F.array(*[(F.get("x2", F.lit(j)) - float(m)) / float(s) for j, (m, s) in enumerate(scales)])
    return frames.join(features.select("rec_id", "t_idx", scaled.alias("_x2")), ["rec_id", "t_idx"]).withColumn("pix", F.concat("_x2", "pix")).select(frames.columns)


def _inside(window: np.ndarray, m: dict[str, np.ndarray]) -> np.ndarray:
    """Coordinates of windows in the space that the kernel's centres span."""
    return rbf((window - m["mean"]) / m["std"], m["x"], 1 / m["x"].shape[1]) @ m["root"]


def _at_codes(window: np.ndarray, m: dict[str, np.ndarray]) -> np.ndarray:
    """The second kernel's values of windows' codes at the centres' codes."""
    return rbf((_inside(window, m) - m["middle"]) @ m["axes"], m["codes"], 1 / m["codes"].shape[1])


def fit_kernel_pca(frames: DataFrame, k: int = 5, components: int = 32, alpha: float = 0.01, support: int = 500, features: DataFrame | None = None) -> dict[str, np.ndarray]:
    """The arrays of a kernel PCA of windows of k frames and of its ridge pre-image: ``mean`` and ``std`` of windows, centres
    ``x`` and the ``root`` of their kernel, ``middle`` and ``axes`` of the codes, the centres' ``codes``, the pre-image's weights
    ``dual``, and the ``scales`` of the features. Sums run over all windows; ``support`` bounds the centres."""
    m = {"scales": feature_scales(features) if features is not None else np.empty((0, 2))}
    rows = embed_frames(with_features(frames, features, m["scales"]) if features is not None else frames, k, middle=True)
    moments = _sums(rows, ["window"], lambda b: [np.stack([np.full(b["window"].shape[1], float(len(b["window"]))), b["window"].sum(0), (b["window"] ** 2).sum(0)])])[0]
    n, m["mean"] = moments[0, 0], moments[1] / moments[0]
    m["std"] = np.maximum(np.sqrt(np.maximum(moments[2] / n - m["mean"] ** 2, 0)), 1e-12)
    m["x"] = (_centres(rows, support, "window") - m["mean"]) / m["std"]
    own = rbf(m["x"], m["x"], 1 / m["x"].shape[1])
    values, vectors = np.linalg.eigh(own)
    kept = values > 1e-10
    m["root"] = vectors[:, kept] / np.sqrt(values[kept])

    def spread(batch):
        z = _inside(batch["window"], m)
        return [z.sum(0)[None], z.T @ z]

    total, square = _sums(rows, ["window"], spread)
    m["middle"] = total[0] / n
    values, axes = np.linalg.eigh(square / n - np.outer(m["middle"], m["middle"]))
    m["axes"] = axes[:, np.argsort(-values)[: min(components, max(1, int((values > 1e-12).sum())))]]
    m["codes"] = (own @ m["root"] - m["middle"]) @ m["axes"]

    def add(batch):
        at = _at_codes(batch["window"], m)
        return [at.T @ at, at.T @ ((batch["window"] - m["mean"]) / m["std"])]

    gram, target = _sums(rows, ["window"], add)
    m["dual"] = _ridge_on_centres(gram, target, rbf(m["codes"], m["codes"], 1 / m["codes"].shape[1]), alpha)
    return m


def predict_kernel_pca(frames: DataFrame, k: int, model: dict[str, np.ndarray], features: DataFrame | None = None) -> DataFrame:
    """(rec_id, y, x, t_idx, v): windows through the arrays of ``fit_kernel_pca``, of this movie or another of the same size,
    averaged where they overlap."""
    extra = len(model["scales"])
    if (features is None) != (extra == 0):
        raise ValueError("features are given to both fitting and prediction, or to none")
    _bounded(model["x"], model["root"], model["dual"])
    rows = embed_frames(with_features(frames, features, model["scales"]) if features is not None else frames, k, middle=True)

    def run(batches):
        for batch in batches:
            if len(batch):
                out = _at_codes(np.stack(batch["window"]).astype(float), model) @ model["dual"] * model["std"] + model["mean"]
                yield batch.drop(columns=["window"]).assign(pix=list(out))

    kind = frames.select("rec_id", "t_idx", "h", "w", "pix").schema
    wide = rows.mapInPandas(run, kind).select("rec_id", "t_idx", "w", (F.col("h") * F.col("w") + extra).alias("n"), F.posexplode("pix").alias("p", "v"))
    spread_out = wide.select("rec_id", (F.col("t_idx") + F.expr("p div n")).alias("t_idx"), "w", (F.expr("p % n") - extra).alias("q"), "v").where("q >= 0")
    spread_out = spread_out.select("rec_id", "t_idx", F.expr("int(q div w)").alias("y"), F.expr("int(q % w)").alias("x"), "v")
    return spread_out.groupBy("rec_id", "y", "x", "t_idx").agg(F.avg("v").alias("v"))


def kernel_pca(frames: DataFrame, k: int = 5, components: int = 32, alpha: float = 0.01, support: int = 500, features: DataFrame | None = None) -> DataFrame:
    """(rec_id, y, x, t_idx, v): windows of k frames through kernel PCA and its ridge pre-image, averaged where they overlap.

    The kernel's space is spanned by ``support`` centres, a documented bound; means, deviations, the covariance of its codes
    and the pre-image are sums over all windows. ``features`` (rec_id, t_idx, x2) join each frame's pixels as inputs."""
    return predict_kernel_pca(frames, k, fit_kernel_pca(frames, k, components, alpha, support, features), features)


#: Frames of a recording that one task puts into windows.
FRAME_CHUNK = 1024


def embed_frames(frames: DataFrame, k: int, middle: bool) -> DataFrame:
    """Frames with ``window``, k of them in a row (whole windows), or the k - 1 around each, zeros outside. A recording is cut
    into chunks of time; frames near a border are in both chunks."""
    back, ahead = (0, k - 1) if middle else (k // 2, k - k // 2 - 1)
    first, last = (F.expr(f"greatest(t_idx - {ahead}, 0) div {FRAME_CHUNK}"), F.expr(f"(t_idx + {back}) div {FRAME_CHUNK}"))
    rows = frames.select("rec_id", "t_idx", "h", "w", "pix").withColumn("_chunk", F.explode(F.sequence(first, last)))
    order = Window.partitionBy("rec_id", "_chunk").orderBy("t_idx")
    if middle:
        rows = rows.withColumn("window", F.collect_list("pix").over(order.rowsBetween(0, k - 1))).where(F.size("window") == k).withColumn("window", F.flatten("window"))
    else:
        zeros = F.array_repeat(F.lit(0.0), F.size("pix"))
        rows = rows.withColumn("window", F.concat(*[F.coalesce(F.lag("pix", -o).over(order), zeros) for o in range(-back, ahead + 1) if o]))
    return rows.where(F.expr(f"t_idx div {FRAME_CHUNK}") == F.col("_chunk")).drop("_chunk")


def r2_score(rows: DataFrame, target: str, predicted: str) -> DataFrame:
    y, p = F.col(target), F.col(predicted)
    return rows.agg((1 - F.try_divide(F.sum((y - p) * (y - p)), F.var_pop(y) * F.count(y))).alias("r2"))


def tube_width(pixels: DataFrame, q: float = 10) -> DataFrame:
    """(rec_id, epsilon): the width of the tube of support vector regression, a percentile of the pixels' deviations in time."""
    spread = pixels.groupBy("rec_id", "y", "x").agg(F.stddev_pop("v").alias("s"))
    return exact_percentiles(spread, ["rec_id"], "s", [q / 100]).select("rec_id", F.col("quantiles")[0].alias("epsilon"))


# Response filters.


def temporal_filter(stimulus: DataFrame, size: int, hop: int, eps: float = 0.01, zeropad: int = 1, normalise: bool = True) -> np.ndarray:
    """The filter from column x to column y: cross-spectrum by auto-spectrum, both means over windows. With ``normalise`` the
    auto-spectrum is regularised by ``eps`` and keeps its greatest magnitude; without, it is taken as it is.

    Windows are lists inside Spark; their spectra are added up in the tasks, so only one spectrum of ``size * zeropad``
    numbers a task meets the others."""
    if hop < 1:
        raise ValueError("windows must move on")
    n = stimulus.count()
    rows = stimulus.where(F.col("t_idx") >= n % size).withColumn("t_idx", F.col("t_idx") - n % size)
    frame = by(["rec_id"]).rowsBetween(0, size - 1)
    lists = rows.select("t_idx", F.collect_list("x").over(frame).alias("xs"), F.collect_list("y").over(frame).alias("ys"))
    lists = lists.where((F.size("xs") == size) & (F.size("ys") == size) & (F.col("t_idx") % hop == 0)).select("xs", "ys")
    length = size * zeropad

    def spectra(batches):
        count, total = 0, np.zeros((4, length))
        for batch in batches:
            if len(batch):
                x, y = (np.fft.fft(np.stack(batch[c]).astype(float), length, axis=1) for c in ("xs", "ys"))
                cov, auto = (y * x.conj()).sum(0), (x * x.conj()).sum(0)
                count, total = count + len(batch), total + np.stack([cov.real, cov.imag, auto.real, auto.imag])
        yield pd.DataFrame({"i": range(length), "n": count, "a": total[0], "b": total[1], "c": total[2], "d": total[3]})

    got = lists.mapInPandas(spectra, "i int, n long, a double, b double, c double, d double").groupBy("i").agg(*[F.sum(c).alias(c) for c in "nabcd"]).orderBy("i").toPandas()
    count = got["n"].to_numpy(float)
    cov, auto = (got["a"] + 1j * got["b"]).to_numpy() / count, (got["c"] + 1j * got["d"]).to_numpy() / count
    if normalise:
        safe = auto + eps * np.abs(auto.mean())
        auto = safe * np.abs(auto).max() / np.abs(safe).max()
    return np.fft.ifft(cov / auto, length // zeropad)


def spatial_weights(rows: DataFrame, target: str, features: str, n: int) -> np.ndarray:
    return normal_equations(rows, target, features, n, intercept=False)


def binned(rows: DataFrame, x: str, y: str, bins: int = 10) -> DataFrame:
    """(bin, edge, n, mean): the mean of y in equal bins of x, the last closed on the right; empty bins are interpolated from
    the bins around them."""
    span = rows.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    step = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.floor(F.coalesce(F.try_divide(F.col(x) - F.col("lo"), step), F.lit(0.0))).cast("int"), F.lit(bins - 1))
    found = rows.join(F.broadcast(span)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(y).alias("mean"))
    every = span.select("lo", step.alias("step"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    table = every.join(found, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * F.col("step")).alias("edge"), F.coalesce("n", F.lit(0)).alias("n"), "mean")
    order = Window.partitionBy(F.lit(0)).orderBy("bin")
    point = F.when(F.col("mean").isNotNull(), F.struct("bin", "mean"))
    back, ahead = F.last(point, True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.first(point, True).over(order.rowsBetween(0, Window.unboundedFollowing))
    filled = back["mean"] + (ahead["mean"] - back["mean"]) * F.try_divide(F.col("bin") - back["bin"], ahead["bin"] - back["bin"])
    return table.select("bin", "edge", "n", F.coalesce("mean", filled, back["mean"], ahead["mean"]).alias("mean"))


def interpolated_nonlinearity(rows: DataFrame, x: str, table: DataFrame) -> DataFrame:
    """rows with ``rate``: linear between the bins' middles, extrapolated from the two outermost. The table has a row a bin."""
    got = table.orderBy("bin").collect()
    half = (got[1]["edge"] - got[0]["edge"]) / 2 if len(got) > 1 else 0.0
    mids, means = [r["edge"] + half for r in got], [r["mean"] for r in got]
    out = None
    for i in range(max(1, len(got) - 1)):
        j = min(i + 1, len(got) - 1)
        slope = (means[j] - means[i]) / (mids[j] - mids[i]) if mids[j] != mids[i] else 0.0
        value = F.lit(means[i]) + F.lit(slope) * (F.col(x) - F.lit(mids[i]))
        last = i >= len(got) - 2
        out = (out.otherwise(value) if out is not None else value) if last else (F.when if out is None else out.when)(F.col(x) < mids[j], value)
    return rows.withColumn("rate", out)


def fitted_nonlinearity(rows: DataFrame, x: str, table: DataFrame, kind: str = "sigmoid") -> DataFrame:
    """rows with ``rate``: a sigmoid, or a softplus with positive parameters, fitted to the bins weighted by their counts."""
    got = table.where("mean is not null").orderBy("bin").toPandas()
    e, m, w = got["edge"].to_numpy(float), got["mean"].to_numpy(float), np.sqrt(got["n"].to_numpy(float))
    if kind == "sigmoid":
        f = lambda x, p: p[1] / (1 + np.exp(-np.clip(p[0] * (x - p[2]), -700, 700))) - p[3]
        p = least_squares(f, e, m, (4 / max(np.ptp(e), 1e-9), np.ptp(m) or 1.0, np.median(e), -m.min()), w)
        return rows.withColumn("rate", sigmoid(F.col(x), *p))
    f = lambda x, p: p[2] * np.log1p(np.exp(np.clip(p[0] * x + p[1], -700, 700))) ** p[4] + p[3]
    low, high = np.array([0, -np.inf, 0, -np.inf, 0.1]), np.array([np.inf, np.inf, np.inf, np.inf, 5])
    p = least_squares(f, e, m, (1 / max(np.ptp(e), 1e-9), 0.0, max(np.ptp(m), 1e-6), m.min(), 1.0), w, low, high)
    return rows.withColumn("rate", softplus(F.col(x), *p))

