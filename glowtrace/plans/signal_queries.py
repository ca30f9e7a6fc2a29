"""Resampling, event alignment, filters along time."""

from pyspark.sql import functions as F

from glowtrace.functions import gaussian_kernel, savgol_kernel
from glowtrace.operators import filters as fl
from glowtrace.operators import resample as rs
from glowtrace.plans.catalogue import SECONDS, TRACES, filtered_sql, query, r8, zero_phase_sql
from glowtrace.plans.trace_queries import REFLECTED
from glowtrace.sources import tables as src

LERP = "CASE WHEN a.ts = q.at THEN a.v WHEN b.ts = q.at THEN b.v ELSE a.v + (b.v - a.v) * (q.at - a.ts) / (b.ts - a.ts) END"


@query("resample_uniform", f"""WITH {TRACES}, z AS (SELECT roi_id, min(ts) AS t0, max(ts) AS tn FROM t GROUP BY 1),
  q AS (SELECT roi_id, i AS t_idx, t0 + i / CAST(0.0005 AS DOUBLE) AS at FROM z, LATERAL (SELECT unnest(generate_series(0, CAST(ceil((tn - t0) * CAST(0.0005 AS DOUBLE)) AS BIGINT) - 1)) AS i) u),
  s AS (SELECT roi_id, ts, f AS v FROM t)
  SELECT q.roi_id, q.t_idx, {r8('q.at', 'ts')}, {r8(LERP, 'f')} FROM q ASOF LEFT JOIN s a ON q.roi_id = a.roi_id AND q.at >= a.ts ASOF LEFT JOIN s b ON q.roi_id = b.roi_id AND q.at <= b.ts""")
def resample_uniform(spark, sf):
    return rs.interp_traces(src.traces(spark, sf), rate=0.0005, chunk=50_000)


PSTH = f"""e AS (SELECT event_id, {SECONDS} AS start, value * 60 AS dur FROM events WHERE event_type = 'signup'),
  s AS (SELECT {SECONDS} AS ts, value AS v FROM events WHERE event_type = 'view'),
  q AS (SELECT *, start - 1800 + i * 600 AS at, CAST(i * 600 - 1800 AS DOUBLE) AS time FROM e, LATERAL (SELECT unnest(generate_series(0, CAST(ceil((dur + 600 + 600 + 1800) / 600) AS BIGINT) - 1)) AS i) u),
  o AS (SELECT q.event_id, q.time, q.start - 1800 AS _start, q.dur + 600 AS _after, {LERP} AS psth FROM q ASOF LEFT JOIN s a ON q.at >= a.ts ASOF LEFT JOIN s b ON q.at <= b.ts)"""


def aligned(spark, sf):
    return rs.psth(src.psth_signal(spark, sf), src.psth_events(spark, sf), before=1800, dt=600, start_key="start", chunk=20_000)


@query("psth_long", f"WITH {PSTH} SELECT event_id, {r8('time', 'time')}, {r8('psth', 'psth')}, {r8('_start', '_start')}, {r8('_after', '_after')} FROM o")
def psth_long(spark, sf):
    return aligned(spark, sf).select("event_id", "time", "psth", "_start", "_after")


@query("psth_mean", f"WITH {PSTH} SELECT {r8('time', 'time')}, {r8('avg(psth)', 'psth')}, count(psth) AS n FROM o GROUP BY o.time")
def psth_mean(spark, sf):
    return aligned(spark, sf).groupBy("time").agg(F.avg("psth").alias("psth"), F.count("psth").alias("n"))


@query("trace_rate", f"WITH {TRACES} SELECT roi_id, {r8('(count(*) - 1) / (max(ts) - min(ts))', 'rate')} FROM t GROUP BY 1")
def trace_rate(spark, sf):
    return rs.rate_of(src.traces(spark, sf))


@query("trigger_offset", f"SELECT {r8(f'({SECONDS}) * 0.1 + 12.5', 'ts')}, {r8('value', 'value')} FROM events")
def trigger_offset(spark, sf):
    volts = src.table(spark, sf, "events").select(src.seconds().alias(" Time(ms) "), F.col("value").alias(" trigger"))
    return rs.trigger_times(volts, unit=0.1, offset=12.5)


def kernel(weights: list[float]) -> str:
    return f"kw AS (SELECT i - {len(weights) // 2} AS o, w FROM (SELECT unnest(generate_series(0, {len(weights) - 1})) AS i, unnest({[float(x) for x in weights]!r}) AS w))"


@query("gaussian_smooth", f"""WITH {TRACES}, {REFLECTED.format(left=16, right=16)}, {kernel(gaussian_kernel(4.0))}
  SELECT t.roi_id, t.t_idx, {r8('sum(e.f * w)', 'f')} FROM t JOIN kw ON TRUE JOIN e ON e.roi_id = t.roi_id AND e.t_idx = t.t_idx + o GROUP BY 1, 2""")
def gaussian_smooth(spark, sf):
    return fl.filter_traces(src.traces(spark, sf), rate=16.0, method="gaussian", ksize=0.25)


@query("median_smooth", f"""WITH {TRACES}, l AS (SELECT roi_id, t_idx, list(f) OVER (PARTITION BY roi_id ORDER BY t_idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS w FROM t)
  SELECT roi_id, t_idx, {r8('list_sort(list_concat(w, list_transform(generate_series(1, 7 - len(w)), lambda i: CAST(0 AS DOUBLE))))[4]', 'f')} FROM l""")
def median_smooth(spark, sf):
    return fl.filter_traces(src.traces(spark, sf), rate=25.0, method="median", ksize=0.3)


@query("savgol_smooth", f"""WITH {TRACES}, {kernel(savgol_kernel(7, 2))}, n AS (SELECT roi_id, count(*) AS n FROM t GROUP BY 1),
  o AS (SELECT t.roi_id, t.t_idx, sum(e.f * w) AS f, n FROM t JOIN n USING (roi_id) JOIN kw ON TRUE JOIN t e ON e.roi_id = t.roi_id AND e.t_idx = t.t_idx + o GROUP BY 1, 2, 4)
  SELECT roi_id, t_idx, {r8('f', 'f')} FROM o WHERE t_idx BETWEEN 3 AND n - 4""")
def savgol_smooth(spark, sf):
    """Whole windows; the polynomial ends are in the unit tests."""
    traces = src.traces(spark, sf)
    n = traces.groupBy("roi_id").agg(F.count("*").alias("n"))
    return fl.savgol_smooth(traces, 7).join(n, "roi_id").where("t_idx between 3 and n - 4").drop("n")


WEIGHTS = [0.5, 0.25, -0.125, 0.0625]


@query("fir_predict", f"WITH {TRACES} SELECT roi_id, t_idx, {r8(' + '.join(f'{h} * coalesce(lag(f, {j}) OVER z, 0)' for j, h in enumerate(WEIGHTS)), 'f')} FROM t WINDOW z AS (PARTITION BY roi_id ORDER BY t_idx)")
def fir_predict(spark, sf):
    return fl.fir(src.traces(spark, sf), WEIGHTS)


@query("preprocess_plain", f"WITH {TRACES}, c AS (SELECT * FROM t WHERE ts >= 86400 AND ts < 864000) SELECT roi_id, t_idx, {r8('ts', 'ts')}, {r8('f - avg(f) OVER (PARTITION BY roi_id)', 'f')}, {r8('avg(f) OVER (PARTITION BY roi_id)', 'mean')} FROM c")
def preprocess_plain(spark, sf):
    return fl.preprocess(src.traces(spark, sf), rate=1.0, factor=1, start=86400, end=864000)


def rounded(df):
    """Recursions add up rounding errors: four digits are compared."""
    return df.withColumn("f", F.round("f", 4))


DECIMATING = fl.chebyshev_lowpass(8, 0.05, 0.8 / 4)


@query("preprocess_decimated", f"""WITH RECURSIVE {TRACES}, {zero_phase_sql(*DECIMATING, fl.steady_state(*DECIMATING))},
  d AS (SELECT zp.roi_id, zp.t_idx // 4 AS t_idx, t.ts, zp.f FROM zp JOIN t USING (roi_id, t_idx) WHERE zp.t_idx % 4 = 0 AND t.ts >= 0),
  a AS (SELECT *, avg(f) OVER (PARTITION BY roi_id) AS mean FROM d) SELECT roi_id, t_idx, {r8('ts', 'ts')}, round(f - mean, 4) + 0 AS f, round(mean, 4) + 0 AS mean FROM a""")
def preprocess_decimated(spark, sf):
    return rounded(fl.preprocess(src.traces(spark, sf), rate=1.0, factor=4)).withColumn("mean", F.round("mean", 4))


LOWPASS, BANDPASS, BANDSTOP = fl.butter_lowpass(0.1, 1.0), fl.butter_bandpass(0.05, 0.2, 1.0, 3), fl.butter_bandstop(0.25 - 0.05 / 2, 0.25 + 0.05 / 2, 1.0, 2)


@query("butter_lowpass", f"WITH RECURSIVE {TRACES}, {zero_phase_sql(*LOWPASS, fl.steady_state(*LOWPASS))} SELECT roi_id, t_idx, round(f, 4) + 0 AS f FROM zp")
def butter_lowpass(spark, sf):
    return rounded(fl.lowpass(src.traces(spark, sf), 0.1, 1.0))


@query("butterworth_smooth", f"WITH RECURSIVE {TRACES}, {zero_phase_sql(*LOWPASS, fl.steady_state(*LOWPASS))} SELECT roi_id, t_idx, round(f, 4) + 0 AS f FROM zp")
def butterworth_smooth(spark, sf):
    """The named filter with its kernel in seconds."""
    return rounded(fl.filter_traces(src.traces(spark, sf), 1.0, "butterworth", ksize=10.0))


@query("butter_bandpass", f"WITH RECURSIVE {TRACES}, {zero_phase_sql(*BANDPASS, fl.steady_state(*BANDPASS))} SELECT roi_id, t_idx, round(f, 4) + 0 AS f FROM zp")
def butter_bandpass(spark, sf):
    return rounded(fl.bandpass(src.traces(spark, sf), 0.05, 0.2, 1.0, order=3))


@query("notch_filter", f"WITH RECURSIVE {TRACES}, q AS MATERIALIZED (SELECT roi_id, t_idx AS i, f AS x FROM t), {filtered_sql(*BANDSTOP, 'q', 'one')} SELECT roi_id, i AS t_idx, round(y, 4) + 0 AS f FROM one")
def notch_filter(spark, sf):
    return rounded(fl.notch_filter(src.traces(spark, sf), dt=1.0, band=0.05, freq=0.25))
