"""Movies: crops, clips, projections, binning, windows."""

from pyspark.sql import functions as F

from glowtrace.operators import project as p
from glowtrace.operators import windows as w
from glowtrace.plans.catalogue import MOVIE, query, r8
from glowtrace.sources import tables as src

ALL = "t_idx, y, x"
REDUCE = {"std": "stddev_pop(v)", "mean": "avg(v)", "max": "max(v)", "min": "min(v)", "median": "median(v)"}

for name, agg in REDUCE.items():

    @query(f"proj_{name}", f"WITH {MOVIE} SELECT y, x, {r8(agg, 'v')} FROM m GROUP BY 1, 2")
    def proj(spark, sf, name=name):
        return p.projection(src.pixels(spark, sf), name)


@query("local_weighted_proj", f"""WITH {MOVIE}, i AS (SELECT y, x, stddev_pop(v) AS v FROM m GROUP BY 1, 2)
  SELECT a.y, a.x, {r8('a.v / avg(b.v)', 'v')} FROM i a JOIN i b ON abs(b.y - greatest(1, least(6, a.y))) <= 1 AND abs(b.x - greatest(2, least(5, a.x))) <= 2 GROUP BY a.y, a.x, a.v""")
def local_weighted_proj(spark, sf):
    return p.locally_weighted(src.pixels(spark, sf), 8, 8, 3, 5)


for name in ("mean", "min", "median"):

    @query(f"frame_bin_{name}", f"WITH {MOVIE}, n AS (SELECT count(DISTINCT t_idx) % 7 AS rest FROM m) SELECT CAST((t_idx - rest) // 7 AS BIGINT) AS t_idx, y, x, {r8(REDUCE[name], 'v')} FROM m, n WHERE t_idx >= rest GROUP BY 1, 2, 3")
    def frame_bin(spark, sf, name=name):
        return p.bin_frames(src.pixels(spark, sf), 7, name)


for name, where, kw in (("all", "TRUE", {}), ("first_n", "t_idx < 100", {"first": 100}), ("seconds", "t_idx < 25", {"seconds": 2.5, "rate": 10.0}), ("interval", "t_idx BETWEEN 50 AND 150", {"interval": (5, 15), "rate": 10.0})):

    @query(f"template_{name}", f"WITH {MOVIE} SELECT y, x, {r8('avg(v)', 'v')} FROM m WHERE {where} GROUP BY 1, 2")
    def template(spark, sf, kw=kw):
        return p.template(src.pixels(spark, sf), **kw)


@query("quality_frame", f"WITH {MOVIE} SELECT t_idx, {r8('median(v)', 'median')}, {r8('avg(v)', 'mean')} FROM m GROUP BY 1")
def quality_frame(spark, sf):
    return p.frame_quality(src.pixels(spark, sf))


@query("quality_image", f"WITH {MOVIE} SELECT y, x, {r8('avg(v)', 'mean')}, {r8('stddev_pop(v)', 'std')} FROM m GROUP BY 1, 2")
def quality_image(spark, sf):
    return p.image_quality(src.pixels(spark, sf))


@query("local_correlation", f"""WITH {MOVIE}, c AS (SELECT a.y, a.x, b.y AS y1, b.x AS x1, corr(a.v, b.v) AS r FROM m a JOIN m b ON a.t_idx = b.t_idx
    AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND (a.y <> b.y OR a.x <> b.x) GROUP BY 1, 2, 3, 4)
  SELECT y, x, {r8('avg(r)', 'v')} FROM c GROUP BY 1, 2""")
def local_correlation(spark, sf):
    return p.local_correlation(src.pixels(spark, sf))


@query("crop_drop", f"WITH {MOVIE} SELECT t_idx - 50 AS t_idx, y - 1 AS y, x - 2 AS x, {r8('v', 'v')} FROM m WHERE t_idx >= 50 AND y BETWEEN 1 AND 6 AND x BETWEEN 2 AND 7")
def crop_drop(spark, sf):
    return p.drop_and_crop(src.pixels(spark, sf), rate=10, drop=5, top=1, bottom=1, left=2)


SHIFTED = "h AS (SELECT ceil(max(greatest(abs(dy), abs(dx)))) AS b FROM (SELECT embedding[1] * 4 AS dy, embedding[2] * 4 AS dx FROM embeddings))"


@query("border_cut", f"WITH {MOVIE}, {SHIFTED} SELECT {ALL}, {r8('v', 'v')} FROM m, h WHERE y BETWEEN b AND 7 - b AND x BETWEEN b AND 7 - b")
def border_cut(spark, sf):
    shifts = src.table(spark, sf, "embeddings").select(F.lit("r0").alias("rec_id"), (F.col("embedding")[0] * 4).alias("dy"), (F.col("embedding")[1] * 4).alias("dx"))
    return p.border_cut(src.pixels(spark, sf), shifts)


@query("quantile_clip", f"WITH {MOVIE}, q AS (SELECT quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM m) SELECT {ALL}, {r8('CASE WHEN v < lo THEN 0 WHEN v > hi THEN hi ELSE v END', 'v')} FROM m, q")
def quantile_clip(spark, sf):
    return p.quantile_clip(src.pixels(spark, sf))


@query("uint8_normalise", f"WITH {MOVIE}, q AS (SELECT min(v) AS lo, max(v) AS hi FROM m) SELECT {ALL}, CAST(floor((v - lo) / (hi - lo) * 255) AS INTEGER) AS v FROM m, q")
def uint8_normalise(spark, sf):
    return p.to_uint8(src.pixels(spark, sf))


@query("uint16_clip", f"WITH {MOVIE} SELECT {ALL}, CAST(floor(least(greatest((v - 100) * 1e4, 0), 65535)) AS INTEGER) AS v FROM m")
def uint16_clip(spark, sf):
    return p.to_uint16(src.pixels(spark, sf).withColumn("v", (F.col("v") - 100) * 1e4))


@query("restore_range", f"WITH {MOVIE}, q AS (SELECT min(v) AS a, max(v) AS b, min(v * v) AS lo, max(v * v) AS hi FROM m) SELECT {ALL}, {r8('(v * v - lo) / (hi - lo) * (b - a) + a', 'v')} FROM m, q")
def restore_range(spark, sf):
    movie = src.pixels(spark, sf)
    return p.restore_range(movie.withColumn("v", F.col("v") * F.col("v")), movie)


@query("standardise_feature", f"WITH {MOVIE}, q AS (SELECT y, x, avg(v) AS a, stddev_pop(v) AS s FROM m GROUP BY 1, 2) SELECT {ALL}, {r8('(v - a) / s', 'v')} FROM m JOIN q USING (y, x)")
def standardise_feature(spark, sf):
    return p.standardise(src.pixels(spark, sf))


@query("standardise_overall", f"WITH {MOVIE} SELECT {ALL}, {r8('(v - avg(v) OVER ()) / stddev_pop(v) OVER ()', 'v')} FROM m")
def standardise_overall(spark, sf):
    return p.standardise(src.pixels(spark, sf), "overall")


@query("unstandardise", f"WITH {MOVIE} SELECT {ALL}, round(v, 6) + 0 AS v FROM m")
def unstandardise(spark, sf):
    movie = src.pixels(spark, sf)
    return p.unstandardise(p.standardise(movie), movie).withColumn("v", F.round("v", 6))


@query("zero_pad", f"WITH {MOVIE} SELECT t_idx, y + 2 AS y, x + 2 AS x, {r8('v', 'v')} FROM m UNION ALL SELECT t_idx, CAST(py AS INTEGER), CAST(px AS INTEGER), 0 FROM (SELECT DISTINCT t_idx FROM m), (SELECT unnest(generate_series(0, 11)) AS py), (SELECT unnest(generate_series(0, 11)) AS px) WHERE NOT (py BETWEEN 2 AND 9 AND px BETWEEN 2 AND 9)")
def zero_pad(spark, sf):
    return p.zero_pad(src.pixels(spark, sf), 2, 8, 8)


@query("nan_to_zero", f"WITH {MOVIE} SELECT {ALL}, {r8('CASE WHEN t_idx % 5 = 0 THEN 0 ELSE v END', 'v')} FROM m")
def nan_to_zero(spark, sf):
    return p.nan_to_zero(src.pixels(spark, sf).withColumn("v", F.when(F.col("t_idx") % 5 != 0, F.col("v")).otherwise(F.lit(float("nan")))))


@query("decimated_frames", f"WITH {MOVIE} SELECT {ALL}, {r8('v', 'v')} FROM m WHERE t_idx % 10 = 0")
def decimated_frames(spark, sf):
    return p.decimate(src.pixels(spark, sf), 10)


@query("frames_round_trip", f"WITH {MOVIE} SELECT {ALL}, {r8('v', 'v')} FROM m")
def frames_round_trip(spark, sf):
    return src.pixels_of(src.frames_of(src.pixels(spark, sf)))


@query("rolling_2d_max", f"WITH {MOVIE} SELECT a.t_idx, a.y, a.x, {r8('max(b.v)', 'v')} FROM m a JOIN m b ON a.t_idx = b.t_idx AND b.y - a.y IN (0, 2) AND b.x - a.x IN (0, 1, 2) WHERE a.x % 2 = 0 GROUP BY 1, 2, 3 HAVING count(*) = 6")
def rolling_2d_max(spark, sf):
    return w.rolling_2d(src.pixels(spark, sf), (2, 3), origin_step=(1, 2), dilation=(2, 1))


@query("rolling_nd_mean", f"WITH {MOVIE} SELECT a.t_idx, a.y, a.x, {r8('avg(b.v)', 'v')} FROM m a JOIN m b ON b.t_idx - a.t_idx IN (0, 3) AND b.y = a.y AND b.x - a.x IN (0, 1) WHERE a.t_idx % 2 = 0 GROUP BY 1, 2, 3 HAVING count(*) = 4")
def rolling_nd_mean(spark, sf):
    """Windows over time and columns; rows are skipped."""
    return w.rolling_nd(src.pixels(spark, sf), {"t_idx": 2, "y": 0, "x": 2}, {"t_idx": 2}, {"t_idx": 3}, "avg")


@query("delay_embed", f"WITH {MOVIE}, l AS (SELECT *, list(v) OVER (PARTITION BY y, x ORDER BY t_idx ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS w FROM m) SELECT {ALL}, {r8('list_sum(w)', 'total')}, {r8('w[5]', 'tail')} FROM l WHERE len(w) = 5")
def delay_embed(spark, sf):
    rows = w.delay_embed(src.pixels(spark, sf), 5)
    return rows.select("t_idx", "y", "x", F.aggregate("window", F.lit(0.0), lambda a, b: a + b).alias("total"), F.element_at("window", -1).alias("tail"))


@query("delay_embed_nomiddle", f"WITH {MOVIE} SELECT {ALL}, {r8('coalesce(lag(v, 2) OVER z, 0) + 2 * coalesce(lag(v) OVER z, 0) + 3 * coalesce(lead(v) OVER z, 0) + 4 * coalesce(lead(v, 2) OVER z, 0)', 'v')} FROM m WINDOW z AS (PARTITION BY y, x ORDER BY t_idx)")
def delay_embed_nomiddle(spark, sf):
    rows = w.delay_embed_without_middle(src.pixels(spark, sf), 5)
    return rows.select("t_idx", "y", "x", sum((F.col("window")[i] * (i + 1) for i in range(1, 4)), F.col("window")[0]).alias("v"))


for name in ("overlap_average", "middle_reconstruction"):

    @query(name, f"WITH {MOVIE} SELECT {ALL}, {r8('v', 'v')} FROM m")
    def rebuilt(spark, sf, name=name):
        windows = w.delay_embed(src.pixels(spark, sf), 4)
        return w.overlap_average(windows) if name == "overlap_average" else w.middle_reconstruction(windows, 4)
