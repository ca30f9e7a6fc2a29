"""Exact duplicates by distributed MSD radix partitioning of the normalised texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glowtrace.llm.common import ROW, SPACE, Scratch, columns_of, join_groups, sized_broadcast, with_stable_keys, without_rows_of

#: Bytes of the first digit, and how many times longer each following digit is.
FIRST_DIGIT, GROWTH = 256, 8


def radix_groups(docs: DataFrame, first_digit: int = FIRST_DIGIT, growth: int = GROWTH, row: str | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for documents (doc_id, text); other columns are ignored.

    Texts are equal when they are identical without white space. Each round splits the open groups by the next bytes of
    their texts; a group is done when one row is left in it or when its texts have ended, which for equal digits shorter
    than the round's length they do together. Texts are compared byte by byte; the SHA-256 is only returned, and names a
    row among rows that repeat a doc_id. Only open rows carry their remaining bytes into the next round, and groups are
    counted by partial aggregation and joined by broadcast or salts, so a group of any size never meets in one task.

    The row with the most code points in the original text, then the smallest doc_id, stays. Null text counts as empty.
    Null doc_id: sorts after all others, and is the keep_id where a group has no other; kept is then true for the rows that
    hold it. Rows that repeat the kept doc_id and length are all kept. Empty table: empty result.

    ``row`` names a column with a stable key of each row. Rows are then known by it too, it is returned as well,
    and one row of each group is kept, the one with the least key among those.
    """
    keys_of = ["doc_id", *([row] if row else [])]
    spark = docs.sparkSession
    scratch = Scratch(spark, "radix")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    norm = F.regexp_replace(text, f"{SPACE}+", "")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keys_of[1:], F.length(text).cast("long").alias("chars"), norm.cast("binary").alias("bytes"))
    base = base.withColumn("sha", F.sha2("bytes", 256))

    def split(rows: DataFrame, digit: int, keys: list[str], carry: list[str]) -> DataFrame:
        """rows with the size and the label of their (keys, next digit) group; a single row is its own."""
        rows = rows.withColumn("digit", F.substring("bytes", 1, digit)).select(*keys, *keys_of, "sha", "chars", "digit", *carry)
        rows = rows if carry else scratch.save(rows, "heads")
        name = F.concat_ws(":", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys_of], "sha")
        groups = rows.groupBy(*keys, "digit").agg(F.count("*").alias("size"), F.min(name).alias("label")).where("size > 1")
        both = join_groups(rows, scratch.save(groups, "groups"), [*keys, "digit"], [*keys_of, "sha"])
        ended = F.col("size").isNull() | (F.length("digit") < digit)
        return both.select(*keys_of, "sha", "chars", F.coalesce("label", name).alias("grp"), F.coalesce("size", F.lit(1)).alias("size"), ended.alias("ended"), *carry)

    digit = first_digit
    state = scratch.save(split(base, digit, [], []), "round")
    done = [state.where("ended").drop("ended")]
    names = scratch.save(state.where("not ended").select(*keys_of, "sha", "grp").distinct(), "names")
    n = names.count()
    if n:
        rest = base.withColumn("bytes", F.expr(f"substring(bytes, {digit + 1})"))
        same = reduce(Column.__and__, [rest[k].eqNullSafe(names[k]) for k in keys_of], rest.sha == names.sha)
        state = scratch.save(rest.join(sized_broadcast(names), same).select(*[rest[k] for k in keys_of], rest.sha, "chars", "bytes", "grp"), "open")
    while n:
        digit *= growth
        after = scratch.save(split(state, digit, ["grp"], ["bytes"]).withColumn("bytes", F.when(~F.col("ended"), F.expr(f"substring(bytes, {digit + 1})"))), "round")
        scratch.drop(state)
        state = after.where("not ended").select(*keys_of, "sha", "chars", "bytes", "grp")
        state._scratch_path = after._scratch_path
        done.append(scratch.save(after.where("ended").select(*keys_of, "sha", "chars", "grp", "size"), "done"))
        n = state.limit(1).count()
    rows = reduce(DataFrame.union, done)

    single = rows.where("size = 1").select(*keys_of, F.col("doc_id").alias("keep_id"), F.col("size").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    many = rows.where("size > 1")
    best = many.groupBy("grp").agg(F.min(F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("keep_id"), *keys_of[1:])).alias("best"), F.count("*").alias("size"))
    kept = F.col("doc_id").eqNullSafe(F.col("best.keep_id")) & (-F.col("chars") == F.col("best.less"))
    for k in keys_of[1:]:
        kept = kept & (F.col(k) == F.col(f"best.{k}"))
    groups = join_groups(many.drop("size"), scratch.save(best, "best"), ["grp"], [*keys_of, "sha"])
    groups = groups.select(*keys_of, "best.keep_id", F.col("size").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"))
    return single.union(groups)


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, the longest original, then the smallest doc_id (null last);
    columns as they come. Null and empty texts are one group. Rows that repeat an id, or have none, are decided one by one.
    Empty table: empty result."""
    scratch = Scratch(docs.sparkSession, "exact")
    rows, key = with_stable_keys(docs, scratch)
    groups = radix_groups(rows.select(F.col(key).alias(ROW), "doc_id", "text"), row=ROW)
    return without_rows_of(rows, groups.where("not kept").select(F.col(ROW).alias(key)), key, scratch).select(columns_of(docs))
