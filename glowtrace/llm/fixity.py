"""Merkle fixity audit of WARC replicas: trees over records and ordered offset ranges, descended only where they differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glowtrace.llm.common import Scratch

#: Children of a node, records in an archive file, and bytes of a file's offset ranges at the lowest level.
FANOUT, RECORDS_PER_FILE, RANGE_BYTES = 16, 1000, 1 << 14
#: Hexadecimal digits of a record's place by which the records of one id are parted.
PART_DIGITS = 3


def warc_records(pages: DataFrame) -> DataFrame:
    """(file, page_id, place, stored, record): WARC/1.1 response records of pages (page_id, url, html), for files of
    ``RECORDS_PER_FILE`` consecutive ids; ``stored`` is the record's length and ``place`` its digest, which orders rows that
    repeat an id. Null columns count as empty, a null page_id as -1."""
    page_id = F.coalesce(F.col("page_id").cast("long"), F.lit(-1))
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), page_id.cast("string"),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(F.col("url").cast("string"), F.lit("")),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"),
    )
    record = F.concat(head, html, F.lit("\r\n\r\n"))
    rows = pages.select(F.floor(page_id / RECORDS_PER_FILE).cast("long").alias("file"), page_id.alias("page_id"), record.alias("record"))
    return rows.select("file", "page_id", F.sha2(F.col("record").cast("binary"), 256).alias("place"), F.octet_length("record").cast("long").alias("stored"), "record")


def leaves(records: DataFrame) -> DataFrame:
    """(file, offset, length, page_id, digest): the hash of each record and where its file holds it, in the order of ids.

    Bodies are hashed where they are read; only hashes and lengths are shuffled. A null record takes its place's bytes but
    is not there. A file's lengths are added up by id and the first digits of ``place``, then within those, so a file with
    very many records, as all null ids are, is many groups. Records alike in everything are counted where they are read and
    numbered from their counts."""
    record = F.col("record").cast("binary")
    rows = records.select("file", "page_id", "place", F.substring("place", 1, PART_DIGITS).alias("part"), "stored", F.octet_length("record").cast("long").alias("length"), F.sha2(record, 256).alias("digest"))
    rows = rows.withColumn("source_task", F.spark_partition_id())
    alike = rows.groupBy(rows.columns).agg(F.count("*").alias("n"))
    alike = Scratch(records.sparkSession, "alike").save(alike, "alike")
    upto_here = lambda keys, order: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = alike.groupBy("file", "page_id", "part").agg(F.sum(F.col("n") * F.col("stored")).alias("bytes"))
    parts = parts.select("file", "page_id", "part", F.coalesce(F.sum("bytes").over(upto_here(["file"], ["page_id", "part"])), F.lit(0)).alias("before"))
    inside = F.sum(F.col("n") * F.col("stored")).over(upto_here(["file", "page_id", "part"], ["place", "source_task"]))
    placed = alike.withColumn("inside", F.coalesce(inside, F.lit(0))).join(parts, ["file", "page_id", "part"])
    each = placed.where("digest is not null").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return each.select("file", (F.col("before") + F.col("inside") + F.col("i") * F.col("stored")).alias("offset"), "length", "page_id", "digest")


def _parents(nodes: DataFrame, node: Column) -> DataFrame:
    """Nodes (file, node, digest) one level up: the hash of the children's numbers and digests in order. A node has at most
    ``FANOUT`` children."""
    rows = nodes.select("file", node.alias("node"), F.struct("node", "digest").alias("child"))
    parts = F.transform(F.array_sort(F.collect_list("child")), lambda c: F.concat_ws(":", c["node"].cast("string"), c["digest"]))
    return rows.groupBy("file", "node").agg(F.sha2(F.array_join(parts, "\n"), 256).alias("digest"))


def tree(leaf: DataFrame, scratch: Scratch, depth: int) -> list[DataFrame]:
    """The levels of a replica's trees, roots first, one tree a file: offset ranges of ``RANGE_BYTES`` over the records that
    start in them, then ``depth`` levels of ``FANOUT`` neighbouring ranges each, up to one node."""
    spans = leaf.withColumn("range", F.expr(f"offset div {RANGE_BYTES}"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "length", "digest"))), lambda c: F.concat_ws(":", c["offset"].cast("string"), c["length"].cast("string"), c["digest"]))
    levels = [scratch.save(spans.groupBy("file", F.col("range").alias("node")).agg(F.sha2(F.array_join(parts, "\n"), 256).alias("digest")), "ranges")]
    for _ in range(depth):
        levels.append(scratch.save(_parents(levels[-1], F.expr(f"node div {FANOUT}")), "nodes"))
    return levels[::-1]


def _differing(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    a, b = (t.select("file", "node", F.col("digest").alias(n)) for t, n in ((ours, "ours"), (theirs, "theirs")))
    return a.join(b, ["file", "node"], "full_outer").where(~F.col("ours").eqNullSafe(F.col("theirs"))).select("file", "node")


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(file, offset, length, page_id, state, our_digest, their_digest) for records of two replicas, given as ``leaves``, that
    are not in both alike: ``changed``, ``missing`` in or ``extra`` in the second.

    Each replica is hashed once. Roots are compared first, then only the children of nodes that differ, level by level,
    and at last the records of the ranges that differ. Records that repeat a (file, offset) are compared by length and
    digest. Empty replicas: nothing differs.
    """
    scratch = Scratch(ours.sparkSession, "fixity")
    both = [scratch.save(r, "leaves") for r in (ours, theirs)]
    last = max([t.agg(F.max("offset")).first()[0] or 0 for t in both])
    depth, node = 0, last // RANGE_BYTES
    while node:
        node, depth = node // FANOUT, depth + 1
    trees = [tree(t, scratch, depth) for t in both]
    open_nodes = _differing(trees[0][0], trees[1][0])
    for a, b in zip(trees[0][1:], trees[1][1:], strict=True):
        open_nodes = scratch.save(open_nodes, "open")
        below = [t.join(open_nodes.withColumnRenamed("node", "up"), (t.file == open_nodes.file) & (F.expr(f"node div {FANOUT}") == F.col("up")), "left_semi") for t in (a, b)]
        open_nodes = _differing(*below)
    open_nodes = scratch.save(open_nodes, "open")
    rows = [t.withColumn("node", F.expr(f"offset div {RANGE_BYTES}")).join(open_nodes, ["file", "node"], "left_semi").drop("node").distinct() for t in both]
    one, two = rows[0].alias("a"), rows[1].alias("b")
    joined = one.join(two, (F.col("a.file") == F.col("b.file")) & (F.col("a.offset") == F.col("b.offset")), "full_outer")
    same = F.col("a.digest").eqNullSafe(F.col("b.digest")) & F.col("a.length").eqNullSafe(F.col("b.length"))
    state = F.when(F.col("b.file").isNull(), "missing").when(F.col("a.file").isNull(), "extra").otherwise("changed")
    either = lambda c: F.coalesce(f"a.{c}", f"b.{c}").alias(c)
    return joined.where(~same).select(either("file"), either("offset"), either("length"), either("page_id"), state.alias("state"), F.col("a.digest").alias("our_digest"), F.col("b.digest").alias("their_digest"))


def damaged(records: DataFrame) -> DataFrame:
    """A replica with damage by rule: every 97th id has one byte of its body changed, every 101st record is gone, and every
    103rd body is cut short. Offsets stay, as in a file whose bytes were overwritten."""
    flipped = F.concat(F.expr("substring(record, 1, length(record) - 5)"), F.lit("~"), F.expr("substring(record, length(record) - 3)"))
    record = F.when(F.col("page_id") % 101 != 17, F.when(F.col("page_id") % 97 == 13, flipped).when(F.col("page_id") % 103 == 29, F.expr("substring(record, 1, length(record) - 40)")).otherwise(F.col("record")))
    return records.withColumn("record", record)
