"""Traces of regions and their relative change."""

from pyspark.sql import functions as F

from glowtrace.operators import traces as t
from glowtrace.operators import windows as w
from glowtrace.plans.catalogue import MASK, MOVIE, TRACES, query, r8
from glowtrace.sources import tables as src

MEANS = "a AS (SELECT k.roi_id, m.t_idx, avg(m.v) AS f FROM m JOIN k USING (y, x) GROUP BY 1, 2)"
BACKGROUND = "g AS (SELECT t_idx, avg(v) AS f FROM m WHERE y IN (0, 7) OR x IN (0, 7) GROUP BY 1)"
SUBTRACTED = """d AS (SELECT a.roi_id, a.t_idx, a.f AS f0, a.f - g.f AS f1 FROM a JOIN g USING (t_idx)),
  b AS (SELECT roi_id, t_idx, f1 - (min(f1) OVER (PARTITION BY roi_id) - min(f0) OVER (PARTITION BY roi_id)) AS f FROM d)"""


def rolling(of: str, size: int) -> str:
    left, right = size // 2, -(-size // 2) - 1
    return f"""n AS (SELECT *, count(*) OVER (PARTITION BY roi_id) AS n, first_value(f) OVER (PARTITION BY roi_id ORDER BY t_idx) AS fa,
        last_value(f) OVER (PARTITION BY roi_id ORDER BY t_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fb,
        sum(f) OVER z AS fs, count(f) OVER z AS fc FROM {of} WINDOW z AS (PARTITION BY roi_id ORDER BY t_idx ROWS BETWEEN {left} PRECEDING AND {right} FOLLOWING)),
      r AS (SELECT roi_id, t_idx, f, (fs + greatest(0, {left} - t_idx) * fa + greatest(0, t_idx + {right} - (n - 1)) * fb)
        / (fc + greatest(0, {left} - t_idx) + greatest(0, t_idx + {right} - (n - 1))) AS base FROM n)"""


DFOF = f"SELECT roi_id, t_idx, {r8('CASE WHEN base <> 0 THEN (f - base) / base END', 'dfof')} FROM r"


@query("roi_mean_trace", f"WITH {MOVIE}, {MASK}, {MEANS} SELECT roi_id, t_idx, {r8('f', 'f')} FROM a")
def roi_mean_trace(spark, sf):
    return t.mean_extraction(src.pixels(spark, sf), src.roi_mask(spark))


@query("roi_mean_trace_frames", f"WITH {MOVIE}, {MASK}, {MEANS} SELECT roi_id, t_idx, {r8('f', 'f')} FROM a")
def roi_mean_trace_frames(spark, sf):
    return t.mean_extraction_frames(src.frames(spark, sf), src.roi_mask(spark), src.SIDE)


@query("roi_weighted_trace", f"WITH {MOVIE}, {MASK} SELECT roi_id, t_idx, {r8('sum(v * weight) / 64', 'f')} FROM m JOIN k USING (y, x) GROUP BY 1, 2")
def roi_weighted_trace(spark, sf):
    return t.mean_extraction(src.pixels(spark, sf), src.roi_mask(spark, True), weighted=True, nonzero=False)


@query("roi_nonzero_trace", f"WITH {MOVIE}, {MASK} SELECT roi_id, t_idx, {r8('avg(nullif(v * weight, 0))', 'f')} FROM m JOIN k USING (y, x) GROUP BY 1, 2")
def roi_nonzero_trace(spark, sf):
    return t.mean_extraction(src.pixels(spark, sf), src.roi_mask(spark, True), weighted=True)


@query("background_trace", f"WITH {MOVIE}, {BACKGROUND} SELECT t_idx, {r8('f', 'f')} FROM g")
def background_trace(spark, sf):
    return t.background_trace(src.pixels(spark, sf), src.roi_mask(spark))


@query("dilated_background", f"WITH {MOVIE} SELECT t_idx, {r8('avg(v)', 'f')} FROM m WHERE NOT (y <= 5 AND x <= 5) GROUP BY 1")
def dilated_background(spark, sf):
    """Background of one 2 by 2 region grown by two pixels."""
    one = src.grid(spark).where("y between 2 and 3 and x between 2 and 3").withColumn("roi_id", F.lit(0))
    return t.background_trace(src.pixels(spark, sf), one, dilate=2)


@query("bg_subtracted_trace", f"WITH {MOVIE}, {MASK}, {MEANS}, {BACKGROUND}, {SUBTRACTED} SELECT roi_id, t_idx, {r8('f', 'f')} FROM b")
def bg_subtracted_trace(spark, sf):
    px, mask = src.pixels(spark, sf), src.roi_mask(spark)
    return t.subtract_background(t.mean_extraction(px, mask), t.background_trace(px, mask))


@query("rolling_dfof", f"WITH {TRACES}, {rolling('t', 30)} {DFOF}")
def rolling_dfof(spark, sf):
    return t.dfof_rolling(src.traces(spark, sf), rate=1.0)


for name in ("min", "max"):

    @query(f"rolling_dfof_{name}", f"WITH {TRACES}, r AS (SELECT roi_id, t_idx, f, {name}(f) OVER (PARTITION BY roi_id ORDER BY t_idx ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING) AS base FROM t) {DFOF}")
    def rolling_dfof_extreme(spark, sf, name=name):
        return t.dfof_rolling(src.traces(spark, sf), rate=1.0, method=name)


@query("rolling_dfof_median", f"""WITH {TRACES}, n AS (SELECT roi_id, count(*) AS n FROM t GROUP BY 1),
  e AS (SELECT roi_id, t_idx, f FROM t UNION ALL SELECT roi_id, -i, f FROM t, (SELECT unnest(generate_series(1, 15)) AS i) WHERE t_idx = 0
    UNION ALL SELECT t.roi_id, n.n - 1 + i, f FROM t JOIN n USING (roi_id), (SELECT unnest(generate_series(1, 14)) AS i) WHERE t_idx = n.n - 1),
  r AS (SELECT e.roi_id, t_idx, f, quantile_cont(f, 0.5) OVER (PARTITION BY e.roi_id ORDER BY t_idx ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING) AS base, n FROM e JOIN n USING (roi_id))
  {DFOF} WHERE t_idx >= 0 AND t_idx < n""")
def rolling_dfof_median(spark, sf):
    return t.dfof_rolling(src.traces(spark, sf), rate=1.0, method="median")


@query("roi_dfof_pipeline", f"WITH {MOVIE}, {MASK}, {MEANS}, {BACKGROUND}, {SUBTRACTED}, {rolling('b', 30)} {DFOF}")
def roi_dfof_pipeline(spark, sf):
    """The flagship: masked means, background, rolling relative change."""
    return t.rolling_dfof_pipeline(src.frames(spark, sf), src.roi_mask(spark), 1.0, src.SIDE, src.SIDE)


REFLECTED = """n AS (SELECT roi_id, count(*) AS n FROM t GROUP BY 1),
  e AS (SELECT t.roi_id, p AS t_idx, f, n FROM t JOIN n USING (roi_id), LATERAL (SELECT unnest([t_idx, -t_idx - 1, 2 * n - 1 - t_idx]) AS p) q WHERE p >= -{left} AND p < n + {right})"""


@query("dfof_percentile_window", f"""WITH {TRACES}, {REFLECTED.format(left=25, right=25)},
  r AS (SELECT roi_id, t_idx, f, n, list_sort(list(f) OVER (PARTITION BY roi_id ORDER BY t_idx ROWS BETWEEN 25 PRECEDING AND 24 FOLLOWING))[5] AS base FROM e)
  {DFOF} WHERE t_idx >= 0 AND t_idx < n""")
def dfof_percentile_window(spark, sf):
    return t.dfof_percentile(src.traces(spark, sf), q=8, window=50)


@query("dfof_percentile_long_window", f"""WITH {TRACES}, {REFLECTED.format(left=75, right=75)},
  r AS (SELECT roi_id, t_idx, f, n, list_sort(list(f) OVER (PARTITION BY roi_id ORDER BY t_idx ROWS BETWEEN 75 PRECEDING AND 74 FOLLOWING))[31] AS base FROM e)
  {DFOF} WHERE t_idx >= 0 AND t_idx < n""")
def dfof_percentile_long_window(spark, sf):
    """A window that is kept sorted in runs of rows."""
    return t.dfof_percentile(src.traces(spark, sf), q=20, window=150)


@query("dfof_percentile_global", f"WITH {TRACES}, r AS (SELECT roi_id, t_idx, f, quantile_cont(f, 0.08) OVER (PARTITION BY roi_id) AS base FROM t) {DFOF}")
def dfof_percentile_global(spark, sf):
    return t.dfof_percentile(src.traces(spark, sf), q=8, window=None)


LISTS = "round(list_sum(w), 8) + 0 AS total, round(w[1], 8) + 0 AS head, round(w[len(w)], 8) + 0 AS tail, CAST(list_count(w) AS BIGINT) AS n"


def described(df):
    """A window's sum, ends and count of values."""
    present = F.filter("window", lambda x: x.isNotNull())
    total = F.aggregate(present, F.lit(0.0), lambda a, x: a + x)
    return df.select("roi_id", F.col("t_idx").cast("long").alias("t_idx"), F.when(F.size(present) > 0, total).alias("total"), F.get("window", F.lit(0)).alias("head"), F.element_at("window", -1).alias("tail"), F.size(present).cast("long").alias("n"))


def listed(size: int, of: str = "t") -> str:
    return f"l AS (SELECT *, list(f) OVER (PARTITION BY roi_id ORDER BY t_idx ROWS BETWEEN CURRENT ROW AND {size - 1} FOLLOWING) AS w FROM {of})"


for step in (1, 3):

    @query(f"sliding_window_step{step}", f"WITH {TRACES}, {listed(5)} SELECT roi_id, t_idx, {LISTS} FROM l WHERE len(w) = 5 AND t_idx % {step} = 0")
    def sliding(spark, sf, step=step):
        return described(w.sliding_window(src.traces(spark, sf), 5, step))


@query("rolling_none", f"WITH {TRACES}, c AS (SELECT *, count(*) OVER (PARTITION BY roi_id) % 7 AS rest FROM t), d AS (SELECT roi_id, t_idx - rest AS t_idx, f FROM c WHERE t_idx >= rest), {listed(7, 'd')} SELECT roi_id, t_idx, {LISTS} FROM l WHERE len(w) = 7")
def rolling_none(spark, sf):
    return described(w.rolling_window(src.traces(spark, sf), 7))


for border, at in (("edges", None), ("nan", "NULL"), ("constant", (0.0, 1.0))):
    lo, hi = ("f", "f") if at is None else (("CAST(NULL AS DOUBLE)",) * 2 if at == "NULL" else map(str, at))

    @query(f"rolling_{border}", f"""WITH {TRACES}, n AS (SELECT roi_id, count(*) AS n FROM t GROUP BY 1),
      e AS (SELECT roi_id, t_idx, f FROM t UNION ALL SELECT roi_id, -i, {lo} FROM t, (SELECT unnest(generate_series(1, 3)) AS i) WHERE t_idx = 0
        UNION ALL SELECT t.roi_id, n.n - 1 + i, {hi} FROM t JOIN n USING (roi_id), (SELECT unnest(generate_series(1, 2)) AS i) WHERE t_idx = n.n - 1),
      l AS (SELECT *, list(f) OVER (PARTITION BY roi_id ORDER BY t_idx ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS w FROM e)
      SELECT l.roi_id, t_idx, {LISTS} FROM l JOIN n USING (roi_id) WHERE t_idx >= 0 AND t_idx < n.n""")
    def rolling_border(spark, sf, border={"edges": "edge", "nan": "nan", "constant": (0.0, 1.0)}[border]):
        return described(w.rolling_window(src.traces(spark, sf), 6, border=border))


@query("delay_embed_dilated", f"WITH {TRACES}, {listed(7)}, z AS (SELECT roi_id, t_idx, [w[1], w[3], w[5], w[7]] AS w FROM l WHERE len(w) = 7) SELECT roi_id, t_idx, {LISTS} FROM z")
def delay_embed_dilated(spark, sf):
    return described(w.dilated_window(src.traces(spark, sf), 4, 2))
