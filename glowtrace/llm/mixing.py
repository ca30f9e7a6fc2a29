"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glowtrace.llm.common import ROW, SPACE, WORD, Scratch, columns_of, fresh_name, sized_broadcast, with_row_key, with_stable_keys, word_count

#: The schedule has at least this many slots where there are as many words, and more where blocks would exceed BLOCK_WORDS.
LEAST_SLOTS, BLOCK_WORDS = 1 << 16, 256
#: The fractional part of the golden ratio, as a multiplier of slot numbers in 32-bit fixed point.
GOLDEN = 2654435769
#: No document is repeated more often than this.
MAX_REPEATS = 3
#: Weights in the order of the sources, repeating.
WEIGHTS = (1, 2, 3)
#: Documents are shuffled into ranges by their keys' first digits, so many that a range has about this many rows at most.
RANGE_ROWS = 4096
#: Slots that are ranked in one task.
CHUNK = 1 << 16


def shuffle_key(doc_id: Column, text: Column, seed: str = "mix") -> Column:
    """A key that orders documents alike in every run and on every engine; also those that repeat an id, or have none."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}:"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) for (source, source_size): weights by the sources' code-point order, null last.

    A target is the least of 3 times the source's size and its weight times the level at which all targets add up to all
    words; sources that reach their limit below the level hand their excess to the rest by weight. One row per source: the
    sources, not the documents, are ordered in one task. Empty table: empty result.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int")).cast("long")
    w = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * MAX_REPEATS)
    everything = Window.partitionBy(F.lit(0))
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("total", F.sum("source_size").over(everything)).withColumn("weights", F.sum("weight").over(everything))
    before = w.withColumn("cap_before", F.coalesce(F.sum("cap").over(by_ratio), F.lit(0))).withColumn("weight_before", F.coalesce(F.sum("weight").over(by_ratio), F.lit(0)))
    level = (F.col("total") - F.col("cap_before")) / (F.col("weights") - F.col("weight_before"))
    before = before.withColumn("level", level).withColumn("fits", F.col("cap") >= F.col("level") * F.col("weight"))
    # The first source in the order of limits that stays below its limit sets the level for itself and all that follow.
    before = before.withColumn("level", F.min(F.when(F.col("fits"), F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("source").isNull(), "source", "level"))).over(everything)["level"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    return before.select("source", "source_size", target.alias("target"))


def block_words(total: int, slots: int | None = None) -> tuple[int, int]:
    """(words of a block, slots) for all words of the sources; ``slots`` asks for a number of slots."""
    block = max(1, -(-total // slots)) if slots else min(BLOCK_WORDS, max(1, total // LEAST_SLOTS))
    return block, -(-total // block)


def _plan(docs: DataFrame, slots: int | None) -> tuple[DataFrame, DataFrame]:
    """Two tables for rows with keys: each with its place in its shuffled source, and the pieces that the schedule takes."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    text = F.col("text").cast("string")
    sized = docs.select(ROW, F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"), shuffle_key(F.col("doc_id").cast("long"), text).alias("key"))
    sized = scratch.save(sized, "sized")
    sources = scratch.save(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "sources")
    rows, digits = sized.count(), 1
    while rows > RANGE_ROWS << (4 * digits):
        digits += 1
    block, slots = block_words(sources.agg(F.sum("source_size")).first()[0] or 0, slots)
    schedule = scratch.save(_schedule(spark, sources, slots), "schedule")
    # A source gives its target: its last block is cut to what is left of it, slots beyond that stay empty, and the few blocks,
    # or the one of a small source, that the schedule's discrepancy leaves without a slot get slots after all others.
    given = sources.select("source", "source_size", "target", F.least(F.round("target").cast("long"), F.col("source_size") * MAX_REPEATS).alias("upto"))
    drawn = schedule.groupBy("of").agg(F.count("*").alias("n"))
    short = given.join(drawn, F.col("source").eqNullSafe(F.col("of")), "left").select("source", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.expr(f"(upto + {block - 1}) div {block}").alias("need"))
    extra = short.where("need > n").select(F.col("source").alias("of"), F.explode(F.sequence(F.col("n"), F.col("need") - 1)).alias("rank"))
    schedule = scratch.save(schedule.union(extra.select("of", "rank", (F.col("rank") + slots).alias("slot"))), "slots")

    # Positions of documents in their shuffled source: the words of the ranges before, then those in the same range.
    sized = sized.withColumn("part", F.substring("key", 1, digits))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sized.groupBy("source", "part").agg(F.sum("size").alias("words")).withColumn("before", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    parts = parts.join(given.alias("s"), F.col("s.source").eqNullSafe(parts.source)).select(parts.source.alias("of"), F.col("part").alias("in_part"), "before", "source_size", "target", "upto")
    inside = Window.partitionBy("source", "part").orderBy("key", "size", ROW).rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(parts, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in_part"))).withColumn("at", F.col("before") + F.col("inside"))
    placed = scratch.save(placed.select(ROW, "doc_id", "source", "size", "source_size", "target", "upto", "at"), "placed")

    # Pieces of documents in the blocks of their source, which repeats, and the slots that take those blocks.
    pieces = placed.select("*", F.explode(F.sequence(F.lit(0), F.lit(MAX_REPEATS - 1))).alias("epoch"))
    pieces = pieces.withColumn("start", F.col("epoch") * F.col("source_size") + F.col("at")).withColumn("end", F.least(F.col("start") + F.col("size"), "upto"))
    pieces = pieces.where("end > start").withColumn("block", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(end - 1) div {block}"))))
    word = F.greatest(F.col("start"), F.col("block") * block)
    pieces = pieces.withColumn("from_word", word - F.col("start")).withColumn("n_words", F.least("end", (F.col("block") + 1) * block) - word)
    taken = pieces.join(schedule, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("rank")))
    return placed, taken.select("slot", "source", "block", "doc_id", "epoch", "from_word", "n_words", "size", "source_size", "target", ROW)


def mix(docs: DataFrame, slots: int | None = None, row: str | None = None) -> DataFrame:
    """The mix: (slot, source, block, doc_id, epoch, from_word, n_words, size, source_size, target), a row for each piece of
    a document in each block that a slot takes. In the order of slots, all sources come in their shares from start to end.

    Slot i points at the fractional part of i times the golden ratio; the cumulative targets map the point to a source, and
    the slot's rank among the source's slots is the block that it takes. A source's blocks cut its shuffled documents,
    repeated up to three times, into equal numbers of words, up to the source's target, where the last block is cut. The low
    discrepancy gives a source as many slots as it has blocks, but for a few: slots beyond the last block stay empty, and
    blocks without a slot come after all others. So a source gives its target to a word. ``slots`` is by default as many as
    give blocks of 256 words, or 65,536 if those are more.

    Null text: size 0. Null source: a source of its own, last in order. Rows that repeat a doc_id are documents of their
    own, one after the other in the shuffle; with ``row``, the name of a column with a stable key of each row, the keys are
    the last column. All sizes 0, or no rows: nothing is taken.
    """
    if row is None:
        return _plan(with_row_key(docs), slots)[1].drop(ROW)
    return _plan(docs.select(F.col(row).alias(ROW), "doc_id", "source", "text"), slots)[1]


def _schedule(spark: SparkSession, sources: DataFrame, slots: int) -> DataFrame:
    """(of, rank, slot): the slots of each source, by a join of points and cumulative weights in 256 strips of the unit
    interval. Points and borders are whole numbers of 2^-32. Slots are ranked in chunks, so no source's slots meet in one task."""
    strips, unit = 256, 1 << 32
    upto = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    spans = sources.where("target > 0").withColumn("sum", F.sum("target").over(Window.partitionBy(F.lit(0))))
    border = lambda window: F.floor(F.coalesce(F.sum("target").over(window), F.lit(0.0)) / F.col("sum") * float(unit))
    spans = spans.select(F.col("source").alias("of"), border(before).alias("low"), border(upto).alias("high"))
    strip_of = lambda c: F.floor(F.col(c) / (unit // strips))
    spans = spans.withColumn("strip", F.explode(F.sequence(strip_of("low"), strip_of("high"))))
    point = F.pmod(F.pmod("id", F.lit(unit)) * F.lit(GOLDEN - unit), F.lit(unit))
    points = spark.range(slots).select(F.col("id").alias("slot"), point.alias("point")).withColumn("strip", strip_of("point"))
    drawn = points.join(spans, "strip").where("point >= low and point < high").select("of", "slot", F.expr(f"slot div {CHUNK}").alias("chunk"))
    earlier = Window.partitionBy("of").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = drawn.groupBy("of", "chunk").agg(F.count("*").alias("n")).select(F.col("of").alias("_of"), F.col("chunk").alias("_chunk"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("of", "chunk").orderBy("slot")) - 1
    ranked = drawn.withColumn("inside", inside).join(chunks, F.col("of").eqNullSafe(F.col("_of")) & (F.col("chunk") == F.col("_chunk")))
    return ranked.select("of", (F.col("before") + F.col("inside")).alias("rank"), "slot")


def taken_words(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken): words that the mix takes of each document, repeats counted; a row for each
    row of ``docs``, whatever ids repeat. Nulls and empty tables as in ``mix``."""
    placed, pieces = _plan(with_row_key(docs), None)
    words = pieces.groupBy(F.col(ROW).alias("_row")).agg(F.sum("n_words").alias("taken"))
    rows = placed.join(words, F.col(ROW) == F.col("_row"), "left")
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix, columns as they come: a row each time that a document is taken whole, and its first words,
    with the white space between them, where the mix ends inside it. Each partition, and so each file that is written, is in
    the order of the slots, without a shuffle for it. Documents that the mix doesn't take, or that have no words, are left out.
    Rows that repeat an id, null ids, sources and texts, and empty tables are as in ``mix``."""
    scratch = Scratch(docs.sparkSession, "taken")
    rows, key = with_stable_keys(docs, scratch)
    take = fresh_name(rows, "_glow_take")
    taken = mix(rows.select(key, "doc_id", "source", "text"), row=key).groupBy(F.col(ROW).alias(key), "epoch", "size").agg(F.min("slot").alias("slot"), F.sum("n_words").alias("words"))
    taken = scratch.save(taken.select(key, F.struct("slot", "words", "size").alias(take)), "taken")
    both = rows.join(sized_broadcast(taken), key).sortWithinPartitions(F.col(f"{take}.slot"), key)
    heads = F.regexp_extract_all(F.col("text"), F.lit(f"({SPACE}*{WORD})"), F.lit(1))
    head = F.array_join(F.slice(heads, F.lit(1), F.col(f"{take}.words").cast("int")), "")
    text = F.when(F.col(f"{take}.words") == F.col(f"{take}.size"), F.col("text")).otherwise(head)
    new = {"text": text.alias("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return both.select([new.get(name, column) for name, column in zip(docs.columns, columns_of(docs), strict=True)])
