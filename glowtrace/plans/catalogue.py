"""Named queries over the test tables, with the SQL of those that SQL can express.

Doubles are rounded to eight digits on both sides, as two engines add in different orders; -0.0 becomes 0.0.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def finish(df: DataFrame) -> DataFrame:
    """Rounded doubles, without the recording's name."""
    kinds = dict(df.dtypes)
    return df.select(*[(F.round(c, 8) + 0.0).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns if c != "rec_id"])


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) under a name."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: finish(f(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


#: The logical inputs of glowtrace.sources.tables as SQL.
MOVIE = """m AS (SELECT vec_id AS t_idx, CAST((i - 1) // 8 AS INTEGER) AS y, CAST((i - 1) % 8 AS INTEGER) AS x,
  CAST(100 AS DOUBLE) + CAST(10 AS DOUBLE) * CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS i) u)"""
MASK = "k AS (SELECT y, x, CAST((y // 4) * 2 + x // 4 AS INTEGER) AS roi_id, 1 / (1 + abs(y - CAST(3.5 AS DOUBLE)) + abs(x - CAST(3.5 AS DOUBLE))) AS weight FROM (SELECT DISTINCT y, x FROM m) WHERE y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6)"
SECONDS = "date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / CAST(1e6 AS DOUBLE)"
TRACES = f"t AS (SELECT event_type AS roi_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS t_idx, {SECONDS} AS ts, value AS f FROM events)"
STIMULUS = "s AS (SELECT vec_id AS t_idx, CAST(100 AS DOUBLE) + CAST(10 AS DOUBLE) * CAST(embedding[1] AS DOUBLE) AS x, CAST(100 AS DOUBLE) + CAST(10 AS DOUBLE) * CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"


def filtered_sql(b: Sequence[float], a: Sequence[float], source: str, name: str, state: Sequence[float] | None = None) -> str:
    """CTEs for the difference equation of a recursive filter over (roi_id, i, x), a row at a time; the result ``name`` is
    (roi_id, i, y). ``state`` is that after a long step of height 1, scaled by the first sample."""
    n = max(len(a), len(b))
    b, a = [float(x) / a[0] for x in [*b, *[0] * (n - len(b))]], [float(x) / a[0] for x in [*a, *[0] * (n - len(a))]]
    lit = lambda v: f"CAST({float(v)!r} AS DOUBLE)"
    out = f"{lit(b[0])} * s.x + r.z1"
    after = ", ".join(f"{f'r.z{k + 1} + ' if k + 1 < n else ''}{lit(b[k])} * s.x - {lit(a[k])} * ({out}) AS z{k}" for k in range(1, n))
    began = [lit(v) for v in (state if state is not None else [0.0] * (n - 1))]
    first = ", ".join(f"{v} * x AS z{k}" for k, v in enumerate(began, 1))
    return f"""{name}_r AS (SELECT roi_id, CAST(-1 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS y, {first} FROM {source} WHERE i = 0
      UNION ALL SELECT s.roi_id, s.i, {out} AS y, {after} FROM {name}_r r JOIN {source} s ON s.roi_id = r.roi_id AND s.i = r.i + 1),
      {name} AS (SELECT roi_id, i, y FROM {name}_r WHERE i >= 0)"""


def zero_phase_sql(b: Sequence[float], a: Sequence[float], state: Sequence[float], source: str = "t") -> str:
    """CTEs for a filter forwards and backwards over (roi_id, t_idx, f) extended by its odd reflection: ``zp`` (roi_id, t_idx,
    f). Series are longer than the extension."""
    pad = 3 * max(len(a), len(b))
    return f"""e0 AS (SELECT roi_id, t_idx, f, max(t_idx) OVER (PARTITION BY roi_id) AS m, first_value(f) OVER w AS f0, last_value(f) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f1 FROM {source} WINDOW w AS (PARTITION BY roi_id ORDER BY t_idx)),
      e1 AS MATERIALIZED (SELECT roi_id, t_idx + {pad} AS i, f AS x FROM e0 UNION ALL SELECT roi_id, {pad} - t_idx, 2 * f0 - f FROM e0 WHERE t_idx BETWEEN 1 AND {pad}
        UNION ALL SELECT roi_id, {pad} + 2 * m - t_idx, 2 * f1 - f FROM e0 WHERE t_idx BETWEEN m - {pad} AND m - 1),
      {filtered_sql(b, a, "e1", "fw", state)},
      e2 AS MATERIALIZED (SELECT roi_id, max(i) OVER (PARTITION BY roi_id) - i AS i, y AS x FROM fw),
      {filtered_sql(b, a, "e2", "bw", state)},
      zp AS (SELECT roi_id, n - i - {pad} AS t_idx, f FROM (SELECT roi_id, i, y AS f, max(i) OVER (PARTITION BY roi_id) AS n FROM bw) WHERE n - i - {pad} >= 0 AND i >= {pad})"""


def r8(x: str, name: str) -> str:
    return f"round({x}, 8) + 0 AS {name}"


for part in ("trace_queries", "movie_queries", "signal_queries", "image_queries", "model_queries", "source_queries", "recording_queries", "stream_queries"):
    import_module(f"glowtrace.plans.{part}")
