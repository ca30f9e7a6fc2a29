"""Images: filters, peaks, regions, components, masks."""

from pyspark.sql import functions as F

from glowtrace import functions as fn
from glowtrace.operators import images as im
from glowtrace.operators import project as p
from glowtrace.plans.catalogue import MASK, MOVIE, query, r8
from glowtrace.sources import tables as src

STD = "i AS (SELECT y, x, stddev_pop(v) AS v FROM m GROUP BY 1, 2)"


def std_image(spark, sf):
    return p.projection(src.pixels(spark, sf), "std")


@query("gaussian_blur", f"""WITH {MOVIE}, {STD}, o AS (SELECT unnest(generate_series(-2, 2)) AS o), w AS (SELECT o, exp(-0.5 * o * o) / sum(exp(-0.5 * o * o)) OVER () AS w FROM o)
  SELECT a.y, a.x, {r8('sum(b.v * wy.w * wx.w)', 'v')} FROM i a, w wy, w wx, i b WHERE b.y = greatest(0, least(7, a.y + wy.o)) AND b.x = greatest(0, least(7, a.x + wx.o)) GROUP BY 1, 2""")
def gaussian_blur(spark, sf):
    return im.gaussian_blur(std_image(spark, sf), 8, 8)


MIRROR = "CASE WHEN {0} < 0 THEN -({0}) - 1 WHEN {0} > 7 THEN 15 - ({0}) ELSE {0} END"


@query("image_median", f"""WITH {MOVIE}, o AS (SELECT unnest(generate_series(-1, 1)) AS o)
  SELECT a.t_idx, a.y, a.x, {r8('median(b.v)', 'v')} FROM m a, o oy, o ox, m b WHERE a.t_idx = b.t_idx AND b.y = {MIRROR.format('a.y + oy.o')} AND b.x = {MIRROR.format('a.x + ox.o')} GROUP BY 1, 2, 3""")
def image_median(spark, sf):
    return src.pixels_of(im.median_filter(src.frames(spark, sf)))


@query("space_time_median", f"""WITH {MOVIE}, n AS (SELECT max(t_idx) AS n FROM m), o AS (SELECT unnest(generate_series(-1, 1)) AS o)
  SELECT a.t_idx, a.y, a.x, {r8('median(b.v)', 'v')} FROM m a, n, o ot, o oy, o ox, m b
  WHERE b.t_idx = least(n, greatest(0, a.t_idx + ot.o)) AND b.y = {MIRROR.format('a.y + oy.o')} AND b.x = {MIRROR.format('a.x + ox.o')} GROUP BY 1, 2, 3""")
def space_time_median(spark, sf):
    return src.pixels_of(im.median_filter(src.frames(spark, sf), time=True))


@query("detect_peaks", f"""WITH {MOVIE}, {STD}, o AS (SELECT unnest(generate_series(-1, 0)) AS o)
  SELECT a.y, a.x, {r8('a.v', 'v')} FROM i a, o oy, o ox, i b WHERE b.y = {MIRROR.format('a.y + oy.o')} AND b.x = {MIRROR.format('a.x + ox.o')} AND a.y BETWEEN 1 AND 6 AND a.x BETWEEN 1 AND 6 GROUP BY a.y, a.x, a.v HAVING a.v = max(b.v)""")
def detect_peaks(spark, sf):
    return im.detect_peaks(std_image(spark, sf), 8, 8, relative=4, edge=1)


@query("peaks_with_retry", f"""WITH {MOVIE}, {STD}, o AS (SELECT unnest(generate_series(-1, 0)) AS o),
  k AS (SELECT a.y, a.x, a.v, least(a.y, a.x, 7 - a.y, 7 - a.x) AS away FROM i a, o oy, o ox, i b WHERE b.y = {MIRROR.format('a.y + oy.o')} AND b.x = {MIRROR.format('a.x + ox.o')} GROUP BY a.y, a.x, a.v HAVING a.v = max(b.v))
  SELECT y, x, {r8('v', 'v')} FROM k WHERE away >= least(3, coalesce((SELECT away FROM k ORDER BY away DESC LIMIT 1 OFFSET 1), 0))""")
def peaks_with_retry(spark, sf):
    return im.peaks_with_retry(std_image(spark, sf), 8, 8, relative=4, edge=3)


@query("roi_stats", f"WITH {MOVIE}, {MASK} SELECT roi_id, {r8('avg(y)', 'com_y')}, {r8('avg(x)', 'com_x')}, count(*) AS pixels FROM k GROUP BY 1")
def roi_stats(spark, sf):
    return im.roi_stats(observed_mask(spark, sf))


def observed_mask(spark, sf, weighted=False):
    """The masks' pixels that the movie has."""
    return src.roi_mask(spark, weighted).join(src.pixels(spark, sf).select("rec_id", "y", "x").distinct(), ["rec_id", "y", "x"])


@query("roi_size_filter", f"WITH {MOVIE}, c AS (SELECT DISTINCT y, x, CAST(y // 3 * 3 + x // 3 AS INTEGER) AS roi_id FROM m), b AS (SELECT roi_id FROM c WHERE y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6 GROUP BY 1 HAVING count(*) > 4) SELECT roi_id, y, x FROM c JOIN b USING (roi_id) WHERE y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6")
def roi_size_filter(spark, sf):
    cells = src.pixels(spark, sf).select("rec_id", F.expr("int(y div 3 * 3 + x div 3)").alias("roi_id"), "y", "x").distinct()
    return im.roi_size_filter(cells, 8, 8, 4, 1, strip=True)


@query("scaled_weights", f"WITH {MOVIE}, {MASK}, {STD}, j AS (SELECT roi_id, y, x, v FROM i JOIN k USING (y, x)) SELECT roi_id, y, x, {r8('(v - min(v) OVER z) / (max(v) OVER z - min(v) OVER z)', 'weight')} FROM j WINDOW z AS (PARTITION BY roi_id)")
def scaled_weights(spark, sf):
    return im.scaled_weights(src.roi_mask(spark), std_image(spark, sf))


BINARY = "b AS (SELECT y, x FROM m GROUP BY 1, 2 HAVING avg(v) > 100)"


@query("connected_components", f"""WITH RECURSIVE {MOVIE}, {BINARY}, r AS (SELECT y, x, y * 8 + x AS root FROM b
    UNION SELECT b.y, b.x, r.root FROM r JOIN b ON abs(r.y - b.y) <= 1 AND abs(r.x - b.x) <= 1), l AS (SELECT y, x, min(root) AS root FROM r GROUP BY 1, 2)
  SELECT y, x, CAST(dense_rank() OVER (ORDER BY root) AS INTEGER) AS label FROM l""")
def connected_components(spark, sf):
    image = p.projection(src.pixels(spark, sf), "mean")
    return im.connected_components(im.binary_threshold(image, 100))


@query("watershed_rois")
def watershed_rois(spark, sf):
    image = p.projection(src.pixels(spark, sf), "mean")
    return im.watershed_rois(image, 8, 8, upper=100.02, lower=99.98, min_size=1)


@query("polygon_mask", f"""WITH e AS (SELECT vec_id AS roi_id, [struct_pack(x := CAST(1 AS DOUBLE), y := CAST(1 AS DOUBLE)), struct_pack(x := 6 + CAST(embedding[1] AS DOUBLE), y := CAST(1.5 AS DOUBLE)), struct_pack(x := 5 + CAST(embedding[2] AS DOUBLE), y := 6 + CAST(embedding[3] AS DOUBLE)), struct_pack(x := CAST(1.2 AS DOUBLE), y := CAST(5.5 AS DOUBLE))] AS v FROM embeddings),
  g AS (SELECT roi_id, y, x, v, i FROM e, (SELECT unnest(generate_series(0, 7)) AS y), (SELECT unnest(generate_series(0, 7)) AS x), (SELECT unnest(generate_series(1, 4)) AS i))
  SELECT roi_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x FROM g
  WHERE (v[i].y > y) <> (v[i % 4 + 1].y > y) AND x < v[i].x + (v[i % 4 + 1].x - v[i].x) * (y - v[i].y) / (v[i % 4 + 1].y - v[i].y) GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1""")
def polygon_mask(spark, sf):
    """A quadrilateral of each embedding's first values."""
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    e = [F.col("embedding")[i].cast("double") for i in range(3)]
    corners = F.array(point(F.lit(1), F.lit(1)), point(6 + e[0], F.lit(1.5)), point(5 + e[1], 6 + e[2]), point(F.lit(1.2), F.lit(5.5)))
    polygons = src.table(spark, sf, "embeddings").select(F.lit("r0").alias("rec_id"), F.col("vec_id").alias("roi_id"), corners.alias("vertices"))
    return im.rasterise(polygons, 8, 8).drop("weight")


@query("masked_by_notch", f"""WITH {MOVIE}, d AS (SELECT *, sqrt(pow(y - 4 + 2, 2) + pow(x - 4 + 1, 2)) AS a, sqrt(pow(y - 4 - 2, 2) + pow(x - 4 - 1, 2)) AS b FROM m)
  SELECT t_idx, y, x, {r8('CASE WHEN a <= 1.5 OR b <= 1.5 THEN 0 ELSE v END', 'ideal')}, {r8('v * (1 - exp(-0.5 * (a * b / 2.25)))', 'gaussian')}, {r8('CASE WHEN a * b = 0 THEN 0 ELSE v / (1 + pow(2.25 / nullif(a * b, 0), 2)) END', 'butter')} FROM d""")
def masked_by_notch(spark, sf):
    y, x = F.col("y"), F.col("x")
    masks = [(F.col("v") * fn.notch(y, x, 8, 8, 2, 1, 1.5, k, 2)).alias(k) for k in ("ideal", "gaussian", "butter")]
    return src.pixels(spark, sf).select("t_idx", "y", "x", *masks)


@query("hamming_lowpass_mask", f"WITH {MOVIE} SELECT t_idx, y, x, {r8('v * pow(sqrt((0.54 - 0.46 * cos(2 * pi() * y / 7)) * (0.54 - 0.46 * cos(2 * pi() * x / 7))), 1.5)', 'v')} FROM m")
def hamming_lowpass_mask(spark, sf):
    return src.pixels(spark, sf).withColumn("v", F.col("v") * fn.hamming_window(F.col("y"), F.col("x"), 8, 8, 1.5))


def axis_sql(name, n, m):
    """Two source pixels and the share of the second for each of m places along an axis of n."""
    return f"{name} AS (SELECT CAST(i AS INTEGER) AS i, CAST(least(floor(p), {n - 2}) AS INTEGER) AS lo, p - least(floor(p), {n - 2}) AS share FROM (SELECT i, greatest(0, least({n - 1}, (i + CAST(0.5 AS DOUBLE)) * {n} / {m} - CAST(0.5 AS DOUBLE))) AS p FROM (SELECT unnest(generate_series(0, {m - 1})) AS i)))"


def resized_sql(height, width):
    return f"""WITH {MOVIE}, {axis_sql('r', 8, height)}, {axis_sql('c', 8, width)}
      SELECT m.t_idx, r.i AS y, c.i AS x, round(sum(m.v * CASE WHEN m.y = r.lo THEN 1 - r.share ELSE r.share END * CASE WHEN m.x = c.lo THEN 1 - c.share ELSE c.share END), 8) + 0 AS v
      FROM m JOIN r ON m.y IN (r.lo, r.lo + 1) JOIN c ON m.x IN (c.lo, c.lo + 1) GROUP BY 1, 2, 3"""


@query("resize_frames", resized_sql(16, 12))
def resize_frames(spark, sf):
    return src.pixels_of(im.resize(src.frames(spark, sf), 16, 12))


@query("resize_expand", resized_sql(24, 24))
def resize_expand(spark, sf):
    """The largest whole factor that 30 pixels have room for."""
    return src.pixels_of(im.resize_by(src.frames(spark, sf), 8, 8, "expand", 30))
