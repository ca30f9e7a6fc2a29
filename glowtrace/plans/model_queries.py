"""Spectra, registration, fits and densities."""

import warnings

import numpy as np
from pyspark.sql import functions as F

from glowtrace import functions as fn
from glowtrace.operators import estimators as es
from glowtrace.operators import kde
from glowtrace.operators import models as md
from glowtrace.operators import pipelines as pl
from glowtrace.operators import project as p
from glowtrace.operators import register as rg
from glowtrace.operators import spectra as sp
from glowtrace.operators import windows as win
from glowtrace.plans.catalogue import MOVIE, STIMULUS, TRACES, query, r8
from glowtrace.sources import tables as src


@query("debleach_linear", f"WITH {MOVIE}, d AS (SELECT t_idx, median(v) AS k FROM m GROUP BY 1), f AS (SELECT regr_slope(k, t_idx) AS a, regr_intercept(k, t_idx) AS b, median(k) AS level FROM d) SELECT t_idx, y, x, {r8('v - (a * t_idx + b - level)', 'v')} FROM m, f")
def debleach_linear(spark, sf):
    return md.debleach_linear(src.pixels(spark, sf))


@query("debleach_exponential")
def debleach_exponential(spark, sf):
    decay = F.lit(20.0) * F.exp(-0.01 * F.col("t_idx"))
    return md.debleach(src.pixels(spark, sf).withColumn("v", F.col("v") + decay))


@query("debleach_spline")
def debleach_spline(spark, sf):
    return md.debleach_spline(src.pixels(spark, sf), 10)


@query("spline_smooth")
def spline_smooth(spark, sf):
    return md.spline_smooth(src.pixels(spark, sf), 20)


@query("histogram", f"WITH {TRACES} SELECT roi_id, CAST(least(floor(f / 400 * 64), 63) AS INTEGER) AS bin, count(*) AS n FROM t WHERE f BETWEEN 0 AND 400 GROUP BY 1, 2")
def histogram(spark, sf):
    return kde.histogram(src.traces(spark, sf), "f", 0, 400, 64, ["roi_id"])


@query("density_counts", f"""WITH {TRACES}, b AS (SELECT roi_id, t_idx // 500 AS block, f FROM t QUALIFY t_idx // 500 < count(*) OVER (PARTITION BY roi_id) // 500),
  e AS (SELECT roi_id, block, min(f) - (max(f) - min(f)) / 10 AS low, max(f) + (max(f) - min(f)) / 10 AS high, count(*) AS size FROM b GROUP BY 1, 2),
  g AS (SELECT *, CAST(least(floor((f - low) / (high - low) * 256), 255) AS BIGINT) AS i, (high - low) / 256 AS step FROM b JOIN e USING (roi_id, block)),
  a AS (SELECT *, CASE WHEN f < low + i * step THEN i - 1 WHEN f >= low + (i + 1) * step AND i < 255 THEN i + 1 ELSE i END AS place FROM g)
  SELECT roi_id, block, {r8('low', 'low')}, {r8('high', 'high')}, size, CAST(place AS INTEGER) AS bin, count(*) AS n FROM a GROUP BY roi_id, block, low, high, size, place""")
def density_counts(spark, sf):
    """What the densities of blocks are made of."""
    return kde.block_counts(src.traces(spark, sf), 500, 256)


@query("kde_percentile")
def kde_percentile(spark, sf):
    return kde.block_percentiles(src.traces(spark, sf), 500, most=90)


BINNED = f"""{STIMULUS}, l AS (SELECT min(x) AS lo, (max(x) - min(x)) / 10 AS step FROM s), a AS (SELECT CAST(least(floor((x - lo) / step), 9) AS INTEGER) AS bin, count(*) AS n, avg(y) AS mean FROM s, l GROUP BY 1),
  g AS (SELECT CAST(i AS INTEGER) AS bin, lo + i * step AS edge, coalesce(n, 0) AS n, mean FROM (SELECT unnest(generate_series(0, 9)) AS i) CROSS JOIN l LEFT JOIN a ON a.bin = i),
  b AS (SELECT g.bin, g.edge, g.n, coalesce(g.mean, u.mean + (o.mean - u.mean) * (g.bin - u.bin) / (o.bin - u.bin), u.mean, o.mean) AS mean FROM g
    LEFT JOIN g u ON u.bin = (SELECT max(bin) FROM g z WHERE z.bin < g.bin AND z.mean IS NOT NULL) LEFT JOIN g o ON o.bin = (SELECT min(bin) FROM g z WHERE z.bin > g.bin AND z.mean IS NOT NULL))"""


@query("binned_nonlinearity", f"WITH {BINNED} SELECT bin, {r8('edge', 'edge')}, CAST(n AS BIGINT) AS n, {r8('mean', 'mean')} FROM b")
def binned_nonlinearity(spark, sf):
    return md.binned(src.stimulus(spark, sf), "x", "y")


@query("nonlinearity_interp", f"""WITH {BINNED}, k AS (SELECT s.t_idx, s.x, CAST(greatest(0, least(8, floor((x - lo) / step - CAST(0.5 AS DOUBLE)))) AS INTEGER) AS i FROM s, l)
  SELECT k.t_idx, {r8('k.x', 'x')}, {r8('p.mean + (q.mean - p.mean) / (q.edge - p.edge) * (k.x - p.edge - step / 2)', 'rate')} FROM k, l, b p, b q WHERE p.bin = k.i AND q.bin = k.i + 1""")
def nonlinearity_interp(spark, sf):
    rows = src.stimulus(spark, sf)
    return md.interpolated_nonlinearity(rows, "x", md.binned(rows, "x", "y")).select("t_idx", "x", "rate")


for kind in ("sigmoid", "softplus"):

    @query(f"nonlinearity_{kind}")
    def nonlinearity(spark, sf, kind=kind):
        rows = src.stimulus(spark, sf)
        return md.fitted_nonlinearity(rows, "x", md.binned(rows, "x", "y"), kind).select("t_idx", "x", "rate")


@query("r2_score", f"WITH {STIMULUS} SELECT {r8('1 - sum((y - x) * (y - x)) / (var_pop(y) * count(y))', 'r2')} FROM s")
def r2_score(spark, sf):
    return md.r2_score(src.stimulus(spark, sf), "y", "x")


@query("linear_predict", f"WITH {STIMULUS}, f AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM s) SELECT t_idx, round(a * x + b, 5) + 0 AS v FROM s, f")
def linear_predict(spark, sf):
    rows = src.stimulus(spark, sf).withColumn("xs", F.array(F.col("x") - 100)).withColumn("y", F.col("y") - 100)
    w = md.normal_equations(rows, "y", "xs", 1)
    return rows.select("t_idx", F.round(F.col("xs")[0] * float(w[0]) + float(w[1]) + 100, 5).alias("v"))


@query("ridge_predict")
def ridge_predict(spark, sf):
    return md.neighbour_ridge(src.pixels(spark, sf).withColumn("v", F.col("v") - 100))


@query("spatial_weights", """WITH d AS (SELECT vec_id AS t_idx, 100 + 10 * CAST(embedding[1] AS DOUBLE) AS p, 100 + 10 * CAST(embedding[2] AS DOUBLE) AS q, 100 + 10 * CAST(embedding[3] AS DOUBLE) AS y FROM embeddings),
  s AS (SELECT sum(p * p) AS pp, sum(p * q) AS pq, sum(q * q) AS qq, sum(p * y) AS py, sum(q * y) AS qy FROM d)
  SELECT t_idx, round((p * (py * qq - qy * pq) + q * (qy * pp - py * pq)) / (pp * qq - pq * pq), 5) + 0 AS v FROM d, s""")
def spatial_weights(spark, sf):
    """The response from the first two pixels by least squares without an intercept."""
    rows = src.frames(spark, sf).select("t_idx", F.slice("pix", 1, 2).alias("xs"), F.col("pix")[2].alias("y"))
    w = md.spatial_weights(rows, "y", "xs", 2)
    return rows.select("t_idx", F.round(F.col("xs")[0] * float(w[0]) + F.col("xs")[1] * float(w[1]), 5).alias("v"))


@query("temporal_filter")
def temporal_filter(spark, sf):
    rows = src.stimulus(spark, sf).withColumn("x", F.col("x") - 100).withColumn("y", F.col("y") - 100)
    h = md.temporal_filter(rows, size=16, hop=2).real
    from glowtrace.operators.filters import fir

    return fir(rows.withColumnRenamed("x", "f"), h.tolist(), ["rec_id"])


@query("kernel_ridge")
def kernel_ridge(spark, sf):
    return src.pixels_of(md.kernel_ridge(src.frames(spark, sf), support=200))


@query("kernel_pca")
def kernel_pca(spark, sf):
    return md.kernel_pca(src.frames(spark, sf), support=200)


@query("kernel_pca_features")
def kernel_pca_features(spark, sf):
    """With each frame's label as an input beside its pixels."""
    labels = src.table(spark, sf, "embeddings").select(F.lit("r0").alias("rec_id"), F.col("vec_id").cast("long").alias("t_idx"), F.array(F.col("label").cast("double")).alias("x2"))
    return md.kernel_pca(src.frames(spark, sf), support=200, features=labels)


@query("shallow_denoise")
def shallow_denoise(spark, sf):
    return md.shallow_denoise(src.pixels(spark, sf), temporal=2, decimate=3)


@query("shallow_denoise_huber")
def shallow_denoise_huber(spark, sf):
    return md.shallow_denoise(src.pixels(spark, sf), temporal=1, loss="huber", decimate=5)


@query("shallow_denoise_kl")
def shallow_denoise_kl(spark, sf):
    """Weights of at least 0 by the divergence, on the movie as it is."""
    return md.shallow_denoise(src.pixels(spark, sf), temporal=1, loss="kl", nonneg=True, decimate=5)


@query("pca_denoise")
def pca_denoise(spark, sf):
    return src.pixels_of(md.pca_denoise(src.frames(spark, sf), 10))


#: The centred spectra of the first 300 frames as SQL, a row a frequency: the mean of 20 ln of its magnitude.
SPECTRUM = f"""{MOVIE}, w AS (SELECT j, cos(2 * pi() * j / 8) AS c, sin(2 * pi() * j / 8) AS s FROM (SELECT unnest(generate_series(0, 7)) AS j)),
  g AS (SELECT CAST(u AS INTEGER) AS y, CAST(v AS INTEGER) AS x FROM (SELECT unnest(generate_series(0, 7)) AS u), (SELECT unnest(generate_series(0, 7)) AS v)),
  ft AS (SELECT m.t_idx, g.y, g.x, sum(m.v * w.c) AS re, sum(m.v * w.s) AS im FROM m, g, w WHERE m.t_idx < 300 AND w.j = ((g.y + 4) * m.y + (g.x + 4) * m.x) % 8 GROUP BY 1, 2, 3),
  sp AS (SELECT y, x, avg(20 * ln(sqrt(re * re + im * im))) AS v FROM ft GROUP BY 1, 2)"""


@query("mean_spectrum", f"WITH {SPECTRUM} SELECT y, x, round(v, 5) + 0 AS v FROM sp")
def mean_spectrum(spark, sf):
    return sp.mean_spectrum(src.frames(spark, sf)).withColumn("v", F.round("v", 5))


#: A spectrum that falls by half with each step from its centre has no other peak than that.
FALLING = np.real(np.fft.ifft(np.fft.ifftshift(0.5 ** np.abs(np.arange(-4, 4)))))
PATTERN = np.outer(FALLING, FALLING)


def striped_frames(spark, sf):
    """Frames of one smooth pattern and one diagonal stripe, as strong as the first two values of each vector say."""
    pattern = F.array(*[F.lit(float(v)) for v in PATTERN.ravel()])
    y, x = np.mgrid[:8, :8]
    stripe = F.array(*[F.lit(float(v)) for v in np.cos(np.pi * 3 * (y + x) / 4).ravel()])
    one, two = (F.get("embedding", F.lit(i)).cast("double") for i in (0, 1))
    pix = F.zip_with(pattern, stripe, lambda p, q: F.lit(100.0) + (F.lit(30.0) + one) * p + (F.lit(5.0) + two) * q)
    return src.table(spark, sf, "embeddings").select(F.lit("r0").alias("rec_id"), F.col("vec_id").cast("long").alias("t_idx"), F.lit(8).alias("h"), F.lit(8).alias("w"), pix.alias("pix"))


def spectrally_masked_sql(source, mask, name):
    """CTEs for the magnitude of a movie whose centred spectrum is multiplied by a mask, an expression of u and v: a circular
    convolution with the mask's own transform."""
    return f"""{name}_h AS (SELECT a, b, sum(m * cos(2 * pi() * ((u + 4) * a + (v + 4) * b) / 8)) / 64 AS hr, sum(m * sin(2 * pi() * ((u + 4) * a + (v + 4) * b) / 8)) / 64 AS hi
        FROM (SELECT u, v, {mask} AS m FROM axis u_(u), axis v_(v)), axis a_(a), axis b_(b) GROUP BY 1, 2),
      {name} AS (SELECT p.t_idx, CAST((p.y + a) % 8 AS INTEGER) AS y, CAST((p.x + b) % 8 AS INTEGER) AS x, sqrt(pow(sum(p.v * hr), 2) + pow(sum(p.v * hi), 2)) AS v FROM {source} p, {name}_h GROUP BY 1, 2, 3)"""


AXIS = "axis AS (SELECT unnest(generate_series(0, 7)) AS n)"
STRIPED = f"""{AXIS}, pattern AS (SELECT CAST((i - 1) // 8 AS INTEGER) AS y, CAST((i - 1) % 8 AS INTEGER) AS x, ({[float(v) for v in PATTERN.ravel()]})[i] AS p FROM (SELECT unnest(generate_series(1, 64)) AS i)),
  m AS (SELECT vec_id AS t_idx, y, x, 100 + (30 + CAST(embedding[1] AS DOUBLE)) * p + (5 + CAST(embedding[2] AS DOUBLE)) * cos(pi() * 3 * (y + x) / 4) AS v FROM embeddings, pattern)"""
ONE, TWO = "sqrt(pow(u - 1, 2) + pow(v - 1, 2))", "sqrt(pow(u - 7, 2) + pow(v - 7, 2))"


@query("notch_frames", f"WITH {STRIPED}, {spectrally_masked_sql('m', f'pow(1 - exp(-0.5 * {ONE} * {TWO}), 2)', 'out')} SELECT t_idx, y, x, round(v, 6) + 0 AS v FROM out")
def notch_frames(spark, sf):
    return src.pixels_of(sp.remove_artifact(striped_frames(spark, sf), 8, 8, d0=1, tolerance=1, edge=0, relative=2)).withColumn("v", F.round("v", 6))


HAMMING = " * ".join(f"(CAST(0.54 AS DOUBLE) - CAST(0.46 AS DOUBLE) * cos(2 * pi() * {c} / 7))" for c in "uv")


def stretched_sql(source, name):
    return f"{name} AS (SELECT t_idx, y, x, (v - (SELECT min(v) FROM {source})) / ((SELECT max(v) FROM {source}) - (SELECT min(v) FROM {source})) * ((SELECT max(v) FROM m) - (SELECT min(v) FROM m)) + (SELECT min(v) FROM m) AS v FROM {source})"


BANDS = {
    "notch": ({"d0": 0.5, "tolerance": 1, "edge": 0, "relative": 2}, f"WITH {STRIPED}, {spectrally_masked_sql('m', f'CASE WHEN {ONE} > 0.5 AND {TWO} > 0.5 THEN 1 ELSE 0 END', 'out')} SELECT t_idx, y, x, round(v, 6) + 0 AS v FROM out"),
    "boxes": ({"sep": 1, "surround": 2, "tolerance": 1, "edge": 0, "relative": 2}, None),
    "lowpass": ({"power": 1.0}, f"WITH {STRIPED}, {spectrally_masked_sql('m', f'sqrt({HAMMING})', 'f1')}, {stretched_sql('f1', 's1')}, {spectrally_masked_sql('s1', f'sqrt({HAMMING})', 'f2')}, {stretched_sql('f2', 's2')} SELECT t_idx, y, x, round(v, 6) + 0 AS v FROM s2"),
    "bandpass": ({"subtract": True, "power": 1.0}, f"WITH {STRIPED}, {spectrally_masked_sql('m', f'sqrt({HAMMING}) - {HAMMING}', 'f1')}, {stretched_sql('f1', 's1')} SELECT t_idx, y, x, round(v, 6) + 0 AS v FROM s1"),
}

for mode, (options, sql) in BANDS.items():

    @query(f"remove_bands_{mode}", sql)
    def remove_bands(spark, sf, mode=mode, options=options):
        """Several passes; the second finds the notches empty and warns."""
        repeats = 1 if mode in ("bandpass", "boxes") else 2
        with warnings.catch_warnings():
            warnings.filterwarnings("ignore", message=".*0 peaks instead of 2")
            return src.pixels_of(sp.remove_bands(striped_frames(spark, sf), 8, 8, repeats=repeats, mode="lowpass" if mode == "bandpass" else mode, **options)).withColumn("v", F.round("v", 6))


@query("max_frequency", f"""WITH {SPECTRUM}, pk AS (SELECT a.y, a.x FROM sp a JOIN sp b ON b.y IN (a.y, greatest(a.y - 1, 0)) AND b.x IN (a.x, greatest(a.x - 1, 0)) GROUP BY a.y, a.x, a.v HAVING a.v >= max(b.v))
  SELECT {r8('max(sqrt(pow((y - 4) / CAST(8 AS DOUBLE), 2) + pow((x - 4) / CAST(8 AS DOUBLE), 2)))', 'v')} FROM pk""")
def max_frequency(spark, sf):
    return sp.max_frequency(src.frames(spark, sf), 8, 8, edge=0)


@query("register_rigid")
def register_rigid(spark, sf):
    return rg.register_rigid(src.frames(spark, sf), (3, 3))[1]


#: CTEs of frames of 8 by 8 against the mean image: circular correlations, the best whole shift within 2, and the best one in
#: steps of a tenth within three quarters of a pixel, by the trigonometric interpolation of the correlations.
SUBPIXEL = f"""{MOVIE}, p AS (SELECT y, x, avg(v) AS v FROM m GROUP BY y, x),
  a AS (SELECT t_idx, y, x, v - avg(v) OVER (PARTITION BY t_idx) AS v FROM m), b AS (SELECT y, x, v - avg(v) OVER () AS v FROM p),
  c AS (SELECT t_idx, (b.y - a.y + 8) % 8 AS sy, (b.x - a.x + 8) % 8 AS sx, sum(a.v * b.v) AS c FROM a, b GROUP BY ALL),
  n AS (SELECT t_idx, sqrt(sum(v * v) * (SELECT sum(v * v) FROM b)) AS norm FROM a GROUP BY t_idx),
  w AS (SELECT t_idx, dy, dx FROM c JOIN (SELECT unnest(range(-2, 3)) AS dy) ON sy = (dy + 8) % 8 JOIN (SELECT unnest(range(-2, 3)) AS dx) ON sx = (dx + 8) % 8
    QUALIFY row_number() OVER (PARTITION BY t_idx ORDER BY round(c, 9) DESC, abs(dy) + abs(dx), dy, dx) = 1),
  k AS (SELECT q, s, (1 + 2 * sum(cos(2 * pi() * f * (q / CAST(10 AS DOUBLE) - s) / 8)) + max(cos(pi() * (q / CAST(10 AS DOUBLE) - s)))) / 8 AS g
    FROM (SELECT unnest(range(-28, 29)) AS q), (SELECT unnest(range(8)) AS s), (SELECT unnest([1, 2, 3]) AS f) GROUP BY q, s),
  e AS (SELECT unnest(range(-8, 9)) AS e),
  u AS (SELECT c.t_idx, 10 * dy + e AS qy, sx, sum(c * g) AS c FROM c JOIN w USING (t_idx), e JOIN k ON s = sy AND q = 10 * dy + e WHERE abs(10 * dy + e) <= 20 GROUP BY ALL),
  z AS (SELECT u.t_idx, qy, 10 * dx + e AS qx, sum(c * g) AS c FROM u JOIN w USING (t_idx), e JOIN k ON s = sx AND q = 10 * dx + e WHERE abs(10 * dx + e) <= 20 GROUP BY ALL),
  j AS (SELECT t_idx, qy / CAST(10 AS DOUBLE) AS dy, qx / CAST(10 AS DOUBLE) AS dx, c FROM z QUALIFY row_number() OVER (PARTITION BY t_idx ORDER BY round(c, 9) DESC, abs(qy) + abs(qx), qy, qx) = 1)"""


@query("register_subpixel", f"WITH {SUBPIXEL} SELECT t_idx, {r8('dy', 'dy')}, {r8('dx', 'dx')}, round(c / norm, 6) + 0 AS r FROM j JOIN n USING (t_idx)")
def register_subpixel(spark, sf):
    """Shifts to a tenth of a pixel."""
    shifts = rg.register_rigid(src.frames(spark, sf), (2, 2), upsample=10)[1]
    return shifts.withColumn("r", F.round("r", 6))


@query("subpixel_movie", f"""WITH {SUBPIXEL}, l AS (SELECT unnest(range(8)) AS o), t AS (SELECT unnest(range(-1, 3)) AS tap),
  f AS (SELECT DISTINCT d, o, least(greatest(CAST(floor(o - d) AS INTEGER) + tap, 0), 7) AS i, tap, abs(o - d - floor(o - d) - tap) AS r FROM (SELECT dy AS d FROM j UNION SELECT dx FROM j), l, t),
  h AS (SELECT d, o, i, tap, CASE WHEN r <= 1 THEN ((1.25 * r - 2.25) * r * r + 1) ELSE -0.75 * (((r - 5) * r + 8) * r - 4) END AS g FROM f),
  v AS (SELECT t_idx, h.o AS y, m.x, sum(m.v * g) AS v FROM m JOIN j USING (t_idx) JOIN h ON h.d = j.dy AND h.i = m.y GROUP BY ALL)
  SELECT v.t_idx, v.y, CAST(h.o AS INTEGER) AS x, round(sum(v.v * g), 6) + 0 AS v FROM v JOIN j USING (t_idx) JOIN h ON h.d = j.dx AND h.i = v.x GROUP BY ALL""")
def subpixel_movie(spark, sf):
    """The frames moved by those shifts, by cubic convolution."""
    return src.pixels_of(rg.register_rigid(src.frames(spark, sf), (2, 2), upsample=10)[0]).withColumn("v", F.round("v", 6))


@query("piecewise_subpixel")
def piecewise_subpixel(spark, sf):
    frames = src.frames(spark, sf)
    return src.pixels_of(rg.piecewise(frames, rg.template_of(frames), (2, 2), (2, 2), (2, 2), 1, 10))


@query("register_piecewise")
def register_piecewise(spark, sf):
    frames = src.frames(spark, sf)
    return src.pixels_of(rg.piecewise(frames, rg.template_of(frames), (2, 2), (2, 2), (2, 2), 1))


@query("register_on_filtered")
def register_on_filtered(spark, sf):
    return rg.register_on_filtered(src.frames(spark, sf), (2, 2))[1]


@query("motion_corrected_movie")
def motion_corrected_movie(spark, sf):
    out = pl.motion_correct(src.frames(spark, sf), 1.0, 8, 8, drop=5, left=0, max_shifts=(2, 2), denoise=16, avg_frames=2, cut_borders=True, debleach=True, replace_nans=True)
    return out.pixels.join(out.timestamps, ["rec_id", "t_idx"])


@query("motion_corrected_quality")
def motion_corrected_quality(spark, sf):
    return pl.motion_correct_filtered(src.frames(spark, sf), 1.0, 8, 8, left=0, max_shifts=(1, 1))[2]


@query("watershed_regions")
def watershed_regions(spark, sf):
    return pl.watershed_regions(src.pixels(spark, sf), 1.0, 8, 8, upper=34, lower=30, min_size=0, edge=0, filter_options={"ksize": 2}).traces


@query("watershed_regions_smoothed")
def watershed_regions_smoothed(spark, sf):
    """With pixels filtered in time by a low pass first."""
    return pl.watershed_regions(src.pixels(spark, sf), 1.0, 8, 8, upper=34, lower=30, min_size=0, edge=0, filter_options={"ksize": 2}, smooth="butter", smooth_factor=4).traces


@query("drawn_regions")
def drawn_regions(spark, sf):
    corner = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    square = F.array(corner(0.5, 0.5), corner(3.5, 0.5), corner(3.5, 3.5), corner(0.5, 3.5))
    polygons = src.frames(spark, sf).select("rec_id").distinct().select("rec_id", F.lit(3).alias("roi_id"), square.alias("vertices"))
    return pl.drawn_regions(src.pixels(spark, sf), polygons, 1.0, 8, 8, filter_options={"ksize": 2}).traces


@query("regression_epsilon", f"WITH {MOVIE}, d AS (SELECT y, x, stddev_pop(v) AS s FROM m GROUP BY 1, 2) SELECT {r8('quantile_cont(s, 0.1)', 'epsilon')} FROM d")
def regression_epsilon(spark, sf):
    """The tenth percentile of the pixels' deviations."""
    return md.tube_width(src.pixels(spark, sf))


@query("cumulative_histogram", f"WITH {TRACES}, h AS (SELECT roi_id, CAST(least(floor(f / 400 * 64), 63) AS INTEGER) AS bin, count(*) AS n FROM t WHERE f BETWEEN 0 AND 400 GROUP BY 1, 2) SELECT roi_id, bin, CAST(sum(n) OVER (PARTITION BY roi_id ORDER BY bin) AS BIGINT) AS n FROM h")
def cumulative_histogram(spark, sf):
    return kde.cumulative(kde.histogram(src.traces(spark, sf), "f", 0, 400, 64, ["roi_id"]), ["roi_id"])


@query("nonneg_series", f"WITH {STIMULUS} SELECT t_idx, {r8('greatest(x - 100, 0)', 'x')}, {r8('greatest(y - 100, 0)', 'y')} FROM s")
def nonneg_series(spark, sf):
    return src.stimulus(spark, sf).select("t_idx", p.nonnegative(F.col("x") - 100).alias("x"), p.nonnegative(F.col("y") - 100).alias("y"))


@query("time_range", f"WITH {TRACES} SELECT roi_id, t_idx, {r8('ts', 'ts')}, {r8('f', 'f')} FROM t WHERE ts >= 1e5 AND ts < 5e5")
def time_range(spark, sf):
    return p.time_range(src.traces(spark, sf), 1e5, 5e5)


@query("response_model")
def response_model(spark, sf):
    """The third pixel from the first two: filters, spatial weights, interpolated nonlinearity."""
    rows = src.frames(spark, sf).select("rec_id", "t_idx", F.transform(F.slice("pix", 1, 2), lambda v: v - 100).alias("x"), (F.col("pix")[2] - 100).alias("y"))
    return es.TemporalFilter(size=16, hop=2, nonlinearity="interp").fit(rows).transform(rows).select("rec_id", "t_idx", "y", "prediction")


@query("response_curves", f"WITH {STIMULUS}, z AS (SELECT t_idx, x - 100 AS u, y - 100 AS w FROM s) SELECT t_idx, {r8('3 / (1 + exp(-1.5 * (u - 0.2))) - 0.5', 'sigmoid')}, {r8('2 * pow(ln(1 + exp(0.8 * u - 0.1)), 1.3) + 0.25', 'softplus')}, {r8('20 * exp(-0.01 * t_idx) + 3', 'bleach')}, {r8('20 * ln(sqrt(u * u + w * w))', 'magnitude')} FROM z")
def response_curves(spark, sf):
    rows = src.stimulus(spark, sf).select("t_idx", (F.col("x") - 100).alias("u"), (F.col("y") - 100).alias("w"))
    u, w = F.col("u"), F.col("w")
    curves = (fn.sigmoid(u, 1.5, 3, 0.2, 0.5), fn.softplus(u, 0.8, -0.1, 2, 0.25, 1.3), fn.bleach(F.col("t_idx"), 20, 0.01, 3), fn.log_magnitude(u, w))
    return rows.select("t_idx", *[c.alias(n) for c, n in zip(curves, ("sigmoid", "softplus", "bleach", "magnitude"), strict=True)])


@query("mean_cross_spectrum", f"""WITH {STIMULUS}, l AS (SELECT t_idx, list(x - 100) OVER z AS xs, list(y - 100) OVER z AS ys FROM s WINDOW z AS (ORDER BY t_idx ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING)),
  g AS (SELECT l.t_idx, k, sum(xs[j + 1] * cos(2 * pi() * ((k * j) % 16) / 16)) AS xr, -sum(xs[j + 1] * sin(2 * pi() * ((k * j) % 16) / 16)) AS xi, sum(ys[j + 1] * cos(2 * pi() * ((k * j) % 16) / 16)) AS yr, -sum(ys[j + 1] * sin(2 * pi() * ((k * j) % 16) / 16)) AS yi
    FROM l, (SELECT unnest(generate_series(0, 15)) AS k), (SELECT unnest(generate_series(0, 15)) AS j) WHERE len(xs) = 16 AND l.t_idx % 2 = 0 GROUP BY 1, 2)
  SELECT CAST(k AS INTEGER) AS k, round(avg(yr * xr + yi * xi), 6) + 0 AS re, round(avg(yi * xr - yr * xi), 6) + 0 AS im FROM g GROUP BY 1""")
def mean_cross_spectrum(spark, sf):
    """Spectra of windows of 16 samples as column functions, averaged by frequency."""
    rows = src.stimulus(spark, sf).select("rec_id", "t_idx", (F.col("x") - 100).alias("x"), (F.col("y") - 100).alias("y"))
    xs, ys = (win.sliding_window(rows, 16, 2, ["rec_id"], c).withColumnRenamed("window", f"{c}s") for c in "xy")
    both = xs.join(ys, ["rec_id", "t_idx"]).select(F.arrays_zip(fn.dft(F.col("xs"), 16).alias("a"), fn.dft(F.col("ys"), 16).alias("b")).alias("z"))
    cross = both.select(F.posexplode("z").alias("k", "z")).select("k", fn.times_conjugate(F.col("z")["b"], F.col("z")["a"]).alias("c"))
    return cross.groupBy("k").agg(F.round(F.avg("c.re"), 6).alias("re"), F.round(F.avg("c.im"), 6).alias("im"))
