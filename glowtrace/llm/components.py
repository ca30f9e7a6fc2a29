"""Connected components of a link table by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glowtrace.llm import common
from glowtrace.llm.common import Scratch, join_groups

#: Memory of a row of a broadcast table of ids with their least neighbours.
_ROW_BYTES = 96


def _lookup(rows: DataFrame, least: DataFrame, small: bool, scratch: Scratch) -> DataFrame:
    """rows (u, v) with u's row of ``least`` (u, m, size): broadcast where the edges are few, else by salts for hubs."""
    if small:
        return rows.join(F.broadcast(least.drop("size")), "u")
    return join_groups(rows, scratch.save(least, "least"), ["u"], ["v"])


def _stars(edges: DataFrame, count: int, scratch: Scratch, row_bytes: int) -> DataFrame:
    """One large-star and one small-star step over ``count`` rows (u, v) with u > v."""
    small = 2 * count * row_bytes <= common.BROADCAST_BYTES
    turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    least = edges.union(turned).groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("size")).select("u", F.least("u", "m").alias("m"), "size")
    large = _lookup(turned, least, small, scratch).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    large = large if small else scratch.save(large, "large")
    root = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("size"))
    moved = _lookup(large, root, small, scratch).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(root.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, scratch: Scratch, row_bytes: int = _ROW_BYTES) -> DataFrame:
    """Rows (id, component) for every id that any link (u, v) joins to a smaller one; all other ids are their own component.

    Least neighbours are aggregated before they are shuffled and joined back by broadcast, if the counted edges are few, or
    with salts, so a hub's edges never meet in one task. Every step is a written table, so a lost executor doesn't stop it.
    The number of steps grows with the logarithm of the longest path. ``row_bytes`` is what a row of two ids takes in memory,
    for ids longer than a number. Null ends, loops and repeated links count for nothing;
    no links: no rows.
    """
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = scratch.save(edges, "edges")
    before = None
    while True:
        mark = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before or mark[0] == 0:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        step = Scratch(scratch.spark, "stars")
        after = scratch.save(_stars(edges, mark[0], step, row_bytes), "stars")
        step.clear()
        scratch.drop(edges)
        before, edges = mark, after
