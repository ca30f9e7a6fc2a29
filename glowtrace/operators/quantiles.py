"""Exact percentiles of groups of any size: counts of the digits of ordered keys lead to the few values that are asked for."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from glowtrace.sources.scratch import checkpointed

#: Bits of a digit, the rows that are sorted as a list, and the groups up to which what is looked for is broadcast.
DIGIT, LISTED, BROADCAST_GROUPS = 16, 4096, 100_000


def _turned(bits: np.ndarray) -> np.ndarray:
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


@F.pandas_udf(LongType())
def ordered_key(values: pd.Series) -> pd.Series:
    """Longs in the order of doubles, NaN last."""
    return pd.Series(_turned(np.where(np.isnan(v := values.to_numpy(np.float64)), np.nan, v).view(np.int64)))


@F.pandas_udf(DoubleType())
def of_key(keys: pd.Series) -> pd.Series:
    return pd.Series(_turned(keys.to_numpy(np.int64)).view(np.float64))


def _found(counts: DataFrame, within: Sequence[str], wanted: Column) -> DataFrame:
    """(within, digit, n, wanted): from (within, digit, n) the digits that hold the places ``wanted`` of their group, and those
    places counted from the digit's first. A group has at most 2^DIGIT digits."""
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*within).orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = counts.withColumn("_before", before)
    inside = F.filter(wanted, lambda r: (r["at"] >= F.col("_before")) & (r["at"] < F.col("_before") + F.col("n")))
    moved = F.transform(inside, lambda r: F.struct(r["rank"].alias("rank"), (r["at"] - F.col("_before")).alias("at")))
    return rows.withColumn("wanted", moved).where(F.size("wanted") > 0)


def exact_percentiles(rows: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """(keys, quantiles): the percentiles ``shares`` (0 to 1) of each group, linearly interpolated; NULLs don't count, NaN is
    larger than all numbers, and a group without values isn't returned.

    Doubles are ordered as 64-bit numbers. Each pass counts the next 16 bits of the rows whose bits before lead to a place
    that is asked for, tasks adding up before the shuffle; after four passes at most, or once the groups of equal bits are
    small enough to be sorted as lists, the values are known. So no task holds more than 2^16 counts or a short list of any
    group, and rows are read a few times instead of sorted."""
    spark = rows.sparkSession
    base = rows.where(F.col(value).isNotNull()).select(F.struct(*keys).alias("_of"), ordered_key(F.col(value).cast("double")).alias("_key"))
    counts = base.groupBy("_of", F.shiftright("_key", 64 - DIGIT).alias("digit")).agg(F.count("*").alias("n"))
    counts = counts.withColumn("_all", F.sum("n").over(Window.partitionBy("_of")))
    places = [F.lit(float(s)) * (F.col("_all") - 1) for s in shares]
    ranks = F.array_distinct(F.array(*[f(p).cast("long") for p in places for f in (F.floor, F.ceil)]))
    wanted = F.transform(ranks, lambda r: F.struct(r.alias("rank"), r.alias("at")))
    found = checkpointed(spark, _found(counts, ["_of"], wanted).select("_of", "_all", F.col("digit").alias("bits"), "n", "wanted"))
    shift = 64 - DIGIT
    while shift:
        groups, most = found.agg(F.count("*"), F.max("n")).first()
        small = found.select("_of", F.col("bits").alias("_bits"), "_all", "wanted")
        inside = base.withColumn("_bits", F.shiftright("_key", shift)).join(F.broadcast(small.drop("wanted", "_all")) if groups <= BROADCAST_GROUPS else small.drop("wanted", "_all"), ["_of", "_bits"])
        if (most or 0) <= LISTED:
            lists = inside.groupBy("_of", "_bits").agg(F.array_sort(F.collect_list("_key")).alias("_list"))
            each = lists.join(small, ["_of", "_bits"]).select("_of", "_all", "_list", F.explode("wanted").alias("w"))
            values = each.select("_of", "_all", F.col("w.rank").alias("rank"), F.get("_list", F.col("w.at").cast("int")).alias("_key"))
            break
        shift -= DIGIT
        digit = F.shiftright("_key", shift).bitwiseAND(F.lit((1 << DIGIT) - 1))
        counts = inside.groupBy("_of", "_bits", digit.alias("digit")).agg(F.count("*").alias("n")).join(small, ["_of", "_bits"])
        bits = F.shiftleft("_bits", DIGIT).bitwiseOR(F.col("digit"))
        found = checkpointed(spark, _found(counts, ["_of", "_bits"], F.col("wanted")).select("_of", "_all", bits.alias("bits"), "n", "wanted"))
    else:
        values = found.select("_of", "_all", F.explode("wanted.rank").alias("rank"), F.col("bits").alias("_key"))
    known = values.withColumn("v", F.coalesce(of_key("_key"), F.lit(float("nan")))).groupBy("_of", "_all").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))

    def interpolated(place: Column) -> Column:
        low, high = F.floor(place).cast("long"), F.ceil(place).cast("long")
        a, b = F.element_at("at", low), F.element_at("at", high)
        return F.when((low == high) | (a == b), a).otherwise((high - place) * a + (place - low) * b)

    out = known.withColumn("quantiles", F.array(*[interpolated(p) for p in places]))
    return out.select(*[F.col(f"_of.{k}").alias(k) for k in keys], "quantiles")
