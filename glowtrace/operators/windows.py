"""Windows over ordered rows: padding, sliding and rolling windows, delay embeddings and their inverses."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("rec_id", "roi_id")
PADS = ("reflect", "edge", "zero", "nan")


def by(keys: Sequence[str], order: str = "t_idx"):
    return Window.partitionBy(*keys).orderBy(order)


def padded(df: DataFrame, left: int, right: int, mode: str, keys: Sequence[str] = KEYS, value: str = "f", constant: tuple[float, float] | None = None) -> DataFrame:
    """Rows (keys, t_idx, value) with ``left`` and ``right`` more rows at the ends of each series; t_idx is dense from 0.

    reflect repeats the series backwards and forwards including its ends, edge repeats the end values, zero and nan (NULL)
    are constants; ``constant`` gives the two values. Each row knows from its place which padded places it fills, so one
    count a series is all that is gathered.
    """
    if mode not in PADS and constant is None:
        raise ValueError(f"mode must be one of {PADS}, not {mode!r}")
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    df = df.select(*keys, F.col("t_idx").cast("long").alias("t_idx"), F.col(value).cast("double").alias(value)).join(sizes, [*keys])
    i, size = F.col("t_idx"), F.col("_n")
    if mode == "reflect" and constant is None:
        turns = F.sequence(-F.ceil(F.lit(max(left, right)) / size).cast("long"), F.ceil(F.lit(max(left, right)) / size).cast("long"))
        places = F.concat(F.transform(turns, lambda k: i + 2 * size * k), F.transform(turns, lambda k: -i - 1 + 2 * size * k))
        places = F.filter(F.array_distinct(places), lambda p: (p >= -left) & (p < size + right))
        return df.withColumn("t_idx", F.explode(places)).drop("_n")
    before = F.when(i == 0, F.sequence(F.lit(-left).cast("long"), F.lit(-1).cast("long"))) if left else F.lit(None).cast("array<bigint>")
    after = F.when(i == size - 1, F.sequence(size, size + right - 1)) if right else F.lit(None).cast("array<bigint>")
    none = F.array().cast("array<bigint>")
    rows = df.withColumn("_p", F.explode(F.concat(F.coalesce(before, none), F.array(i), F.coalesce(after, none))))
    if mode != "edge" or constant is not None:
        lo, hi = constant if constant is not None else ((0.0, 0.0) if mode == "zero" else (None, None))
        rows = rows.withColumn(value, F.when(F.col("_p") < 0, F.lit(lo).cast("double")).when(F.col("_p") >= size, F.lit(hi).cast("double")).otherwise(F.col(value)))
    return rows.withColumn("t_idx", F.col("_p")).drop("_p", "_n")


def frame_list(value: str, before: int, after: int, keys: Sequence[str] = KEYS) -> Column:
    """The values of a row's window in order, NULLs as such."""
    rows = F.collect_list(F.struct(F.col(value).alias("v"))).over(by(keys).rowsBetween(-before, after))
    return rows["v"]


def sliding_window(df: DataFrame, size: int, step: int = 1, keys: Sequence[str] = KEYS, value: str = "f") -> DataFrame:
    """(keys, t_idx, window): all whole windows of ``size`` rows that start at a multiple of ``step``; t_idx is the start."""
    if size < 1 or step < 1:
        raise ValueError("size and step must be at least 1")
    rows = df.select(*keys, "t_idx", frame_list(value, 0, size - 1, keys).alias("window"))
    return rows.where((F.size("window") == size) & (F.col("t_idx") % step == 0))


def rolling_window(df: DataFrame, window: int, steps: int = 1, border: str | tuple[float, float] | None = None, keys: Sequence[str] = KEYS, value: str = "f") -> DataFrame:
    """(keys, t_idx, window): centred windows, one a row with a border (``edge``, ``nan`` or two constants); without one, the
    first rows beyond a multiple of the window are dropped and whole windows remain, numbered from 0. Every ``steps``-th
    window is returned."""
    if window < 1 or steps < 1:
        raise ValueError("window and steps must be at least 1")
    if border is None:
        n = F.count("*").over(Window.partitionBy(*keys))
        rows = df.withColumn("_drop", n % window).where(F.col("t_idx") >= F.col("_drop")).withColumn("t_idx", F.col("t_idx") - F.col("_drop"))
        return sliding_window(rows, window, steps, keys, value)
    left, right = window // 2, -(-window // 2) - 1
    rows = padded(df, left, right, border, keys, value) if isinstance(border, str) else padded(df, left, right, "", keys, value, border)
    rows = rows.select(*keys, "t_idx", frame_list(value, left, right, keys).alias("window"))
    n = F.max("t_idx").over(Window.partitionBy(*keys)) - right
    return rows.withColumn("_last", n).where((F.col("t_idx") >= 0) & (F.col("t_idx") <= F.col("_last")) & (F.col("t_idx") % steps == 0)).drop("_last")


def rolling_nd(pixels: DataFrame, window: dict[str, int], origin_step: dict[str, int] | None = None, dilation: dict[str, int] | None = None, reducer: str = "max") -> DataFrame:
    """(rec_id, t_idx, y, x, v): the reducer over the windows whose first corner is the row, whole windows only. ``window`` names
    the axes (t_idx, y, x) and their sizes, a size of 0 skips its axis; ``dilation`` spaces a window's rows, 0 repeats one.
    The reducer is an aggregate, or ``list`` for the values in order, the last named axis fastest. Each row is sent to the
    windows that hold it, and windows are reduced before they are shuffled."""
    step, spacing = origin_step or {}, dilation or {}
    sizes = {axis: max(size, 1) for axis, size in window.items()}
    if not set(sizes) <= {"t_idx", "y", "x"} or set(step) | set(spacing) > {"t_idx", "y", "x"}:
        raise ValueError("axes are t_idx, y and x")
    if min(window.values(), default=0) < 0 or min(spacing.values(), default=0) < 0 or min(step.values(), default=1) < 1:
        raise ValueError("windows and dilations must be at least 0, steps at least 1")
    places = list(itertools.product(*[range(n) for n in sizes.values()]))
    moved = lambda axis, at: F.col(axis) - at.get(axis, 0) * spacing.get(axis, 1)
    to = F.array(*[F.struct(*[moved(axis, dict(zip(sizes, place, strict=True))).alias(axis) for axis in ("t_idx", "y", "x")], F.lit(i).alias("i")) for i, place in enumerate(places)])
    rows = pixels.select("rec_id", F.explode(to).alias("o"), "v").select("rec_id", "o.t_idx", "o.y", "o.x", "o.i", "v")
    for axis in ("t_idx", "y", "x"):
        rows = rows.where((F.col(axis) >= 0) & (F.col(axis) % step.get(axis, 1) == 0))
    value = F.array_sort(F.collect_list(F.struct("i", "v")))["v"] if reducer == "list" else getattr(F, reducer)("v")
    out = rows.groupBy("rec_id", "t_idx", "y", "x").agg(value.alias("v"), F.count("*").alias("n"))
    return out.where(F.col("n") == len(places)).drop("n")


def rolling_2d(pixels: DataFrame, window: tuple[int, int], origin_step: tuple[int, int] = (1, 1), dilation: tuple[int, int] = (1, 1), reducer: str = "max") -> DataFrame:
    """``rolling_nd`` over the images."""
    named = lambda pair: dict(zip(("y", "x"), pair, strict=True))
    return rolling_nd(pixels, named(window), named(origin_step), named(dilation), reducer)


def dilated_window(df: DataFrame, size: int, step: int, keys: Sequence[str] = KEYS, value: str = "f") -> DataFrame:
    """(keys, t_idx, window): every ``step``-th of the rows from t_idx on, ``size`` in all."""
    whole = sliding_window(df, (size - 1) * step + 1, 1, keys, value)
    return whole.withColumn("window", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda j: F.get("window", j * step)))


def delay_embed(df: DataFrame, k: int, keys: Sequence[str] = ("rec_id", "y", "x"), value: str = "v") -> DataFrame:
    """(keys, t_idx, window): k consecutive values."""
    return sliding_window(df, k, 1, keys, value)


def delay_embed_without_middle(df: DataFrame, k: int, keys: Sequence[str] = ("rec_id", "y", "x"), value: str = "v") -> DataFrame:
    """(keys, t_idx, value, window): the k - 1 neighbours in time, zero beyond the ends."""
    w = by(keys)
    around = [F.lag(value, -o, 0.0).over(w) for o in range(-(k // 2), k - k // 2) if o]
    return df.select(*keys, "t_idx", value, F.array(*around).alias("window"))


def overlap_average(windows: DataFrame, keys: Sequence[str] = ("rec_id", "y", "x")) -> DataFrame:
    """(keys, t_idx, v): the mean of each row over the windows that hold it."""
    rows = windows.select(*keys, "t_idx", F.posexplode("window").alias("o", "v"))
    return rows.groupBy(*keys, (F.col("t_idx") + F.col("o")).alias("t_idx")).agg(F.avg("v").alias("v"))


def middle_reconstruction(windows: DataFrame, k: int, keys: Sequence[str] = ("rec_id", "y", "x")) -> DataFrame:
    """(keys, t_idx, v): each row from the window that it is in the middle of; first rows from the first window, last rows
    from the last."""
    last = F.max("t_idx").over(Window.partitionBy(*keys))
    rows = windows.withColumn("_last", last).select(*keys, "t_idx", "_last", F.posexplode("window").alias("o", "v"))
    mid = k // 2
    kept = rows.where((F.col("o") == mid) | ((F.col("t_idx") == 0) & (F.col("o") < mid)) | ((F.col("t_idx") == F.col("_last")) & (F.col("o") > mid)))
    return kept.select(*keys, (F.col("t_idx") + F.col("o")).alias("t_idx"), "v")
