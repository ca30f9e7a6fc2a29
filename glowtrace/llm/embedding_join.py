"""Near-duplicate embeddings: an exact metric range join over pivot cells with boundary replication."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glowtrace.llm.common import ROW, Scratch, join_groups, small_batches, with_row_key
from glowtrace.llm.components import connected_components

#: Components of a cell's core and of its reach that are joined in one task, by the length of a vector; rows and columns of a
#: block of that join.
CORE_VALUES, TILE_VALUES, BLOCK = 1 << 19, 1 << 20, 1024
#: There is a pivot for each full core, up to a bound; pivots are chosen from a bounded sample of vectors.
MOST_PIVOTS, PIVOT_SAMPLE = 512, 4096


def _pivots(vectors: np.ndarray, k: int) -> np.ndarray:
    """Farthest-first choice of k of the sampled unit vectors."""
    chosen = [0]
    nearest = vectors @ vectors[0]
    while len(chosen) < min(k, len(vectors)):
        chosen.append(int(nearest.argmin()))
        np.maximum(nearest, vectors @ vectors[chosen[-1]], out=nearest)
    return vectors[chosen]


def cells_of(unit: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each vector, and which cells each may have a neighbour in.

    A vector at distances d1 from its own pivot and d2 from another is at least (d2^2 - d1^2) / (2 d12) from the plane
    between the two, beyond which the other's cell lies; if that exceeds ``radius``, no vector there is in reach.
    """
    squared = np.maximum(2 - 2 * (unit @ pivots.T), 0)
    between = np.sqrt(np.maximum(2 - 2 * (pivots @ pivots.T), 0))
    own = squared.argmin(axis=1)
    apart = squared - squared[np.arange(len(unit)), own][:, None]
    reach = apart <= 2 * between[own] * radius + 1e-9
    reach[np.arange(len(unit)), own] = True
    return own, reach


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1)[:, None]
    return scaled / np.linalg.norm(scaled, axis=1)[:, None]


def _links(core_ids: np.ndarray, core: np.ndarray, a: np.ndarray, ids: np.ndarray, rows: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of linked rows for each core vector, and the least id that links reach inside this block, for core and rows;
    a and b are their unit vectors in single precision."""
    cosine = a @ b.T
    linked = cosine >= least
    # Single precision decides only what is far from the threshold; the rest is computed in double precision.
    for i, j in np.argwhere(np.abs(cosine - np.float32(least)) < 1e-4):
        x, y = core[i], rows[j]
        linked[i, j] = float(x @ y) / math.sqrt(float(x @ x) * float(y @ y)) >= least
    linked &= core_ids[:, None] != ids[None, :]
    counts = linked.sum(axis=1)
    left, right = core_ids.copy(), ids.copy()
    if not counts.any():
        return counts, left, right
    p, q = np.flatnonzero(counts), np.flatnonzero(linked.any(axis=0))
    part, most = linked[np.ix_(p, q)], np.iinfo(np.int64).max
    while True:
        new_left = np.minimum(left[p], np.where(part, right[q][None, :], most).min(axis=1))
        new_right = np.minimum(right[q], np.where(part, new_left[:, None], most).min(axis=0))
        if (new_left == left[p]).all() and (new_right == right[q]).all():
            return counts, left, right
        left[p], right[q] = new_left, new_right


def join_core(cell: pd.DataFrame, least: float) -> pd.DataFrame:
    """(id, n, root) for one block of a cell's core (rows with ``core``) and one tile of its reach: links of core vectors,
    and edges from ids to the least id that they reach here."""
    held = cell["core"].to_numpy()
    ids, vectors = cell["id"].to_numpy(np.int64), np.stack(cell["vec"].to_numpy()).astype(np.float64)
    unit = _unit(vectors).astype(np.float32)
    core, tile = np.flatnonzero(held), np.flatnonzero(~held)
    counts = np.zeros(len(ids), np.int64)
    edges: set[tuple[int, int]] = set()
    for i in range(0, len(core), BLOCK):
        p = core[i : i + BLOCK]
        for j in range(0, len(tile), BLOCK):
            q = tile[j : j + BLOCK]
            n, left, right = _links(ids[p], vectors[p], unit[p], ids[q], vectors[q], unit[q], least)
            counts[p] += n
            for ends, roots in ((ids[p], left), (ids[q], right)):
                moved = np.flatnonzero(ends != roots)
                edges.update(zip(ends[moved].tolist(), roots[moved].tolist(), strict=True))
    linked = core[counts[core] > 0]
    out = pd.DataFrame({"id": ids[linked], "n": counts[linked], "root": None})
    more = pd.DataFrame([(u, None, v) for u, v in edges], columns=["id", "n", "root"])
    return pd.concat([out, more]).astype({"id": "int64", "n": "Int64", "root": "Int64"})


def similar_vectors(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for vectors (vec_id, embedding); other columns are ignored.

    Two vectors are linked if their cosine in double precision is at least ``least``. On unit vectors that is a range join
    at Euclidean distance sqrt(2 - 2 least): pivots cut space into cells, a vector is replicated into the cells within that
    distance of it, and each block of a cell's core is joined with each tile of all that its cell holds, so links count once
    for each end and no task holds more than a block and a tile. The join is exact whatever the pivots are. Vectors without
    clusters in many dimensions lie near most cells: then nearly all cells get nearly all vectors, as in any exact method.

    Null, empty or zero vectors, and those with null or non-finite components, link with nothing; so do vectors of other
    lengths than the partner's. Rows that repeat a vec_id, or have none, are vectors of their own, with links to each other
    too. A component's id is its smallest vec_id, null only if all are null; kept is true where the row's id is that one, null
    for null included. Single-precision vectors travel as such and are compared in double precision. Empty table: empty result.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "cosine")
    kind = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.coalesce(finite & F.exists("vec", lambda x: x != 0), F.lit(False))
    named = scratch.save(with_row_key(rows.select("vec_id", F.when(sound, F.col("vec")).alias("vec"))), "vectors")
    usable = named.where("vec is not null").select(F.col(ROW).alias("id"), F.size("vec").alias("dim"), "vec")

    sizes = {r["dim"]: r["n"] for r in usable.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row a length
    radius = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-7
    # A bounded sample of the vectors of each length that needs several pivots, one vector of the others.
    wide = [dim for dim, n in sizes.items() if n > _core_rows(dim)]
    points: dict[int, list] = {r["dim"]: [r["vec"]] for r in usable.where(~F.col("dim").isin(wide)).groupBy("dim").agg(F.min_by("vec", "id").alias("vec")).collect()}
    for dim in wide:
        # About four samples pass the hash before the smallest hashes are taken, task by task.
        drawn = usable.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("id"), F.lit(max(1, sizes[dim] // (4 * PIVOT_SAMPLE)))) == 0))
        points[dim] = [r["vec"] for r in drawn.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).collect()] or [usable.where(F.col("dim") == dim).first()["vec"]]
    pivots = {dim: _pivots(_unit(np.array(p, np.float64)), min(MOST_PIVOTS, -(-sizes[dim] // _core_rows(dim)))) for dim, p in points.items()}
    found = scratch.save(_range_join(usable, kind, pivots, radius, least, scratch), "found")
    links = connected_components(found.where("root is not null").select(F.col("id").alias("u"), F.col("root").alias("v")), scratch)
    counts = found.where("n is not null").groupBy("id").agg(F.sum("n").alias("n"))
    out = named.select("vec_id", F.col(ROW).alias("id")).join(counts, "id", "left").join(links, "id", "left")
    out = scratch.save(out.select("id", "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("root")), "rows")
    # The smallest id of each component: its root is only the key of a row.
    roots = scratch.save(out.groupBy("root").agg(F.min("vec_id").alias("least"), F.count("*").alias("size")).where("size > 1"), "roots")
    component = F.coalesce("least", "vec_id")
    return join_groups(out, roots, ["root"], ["id"]).select("vec_id", "n_links", component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


def _core_rows(dim: int) -> int:
    return max(1, CORE_VALUES // dim)


def _range_join(vectors: DataFrame, kind: str, pivots: dict[int, np.ndarray], radius: float, least: float, scratch: Scratch) -> DataFrame:
    """(id, n, root) of all cells; ``pivots`` are at most MOST_PIVOTS vectors of each length."""

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                own, reach = cells_of(_unit(np.stack(part["vec"].to_numpy()).astype(np.float64)), pivots[dim], radius)
                yield pd.DataFrame({"id": part["id"], "dim": dim, "vec": part["vec"], "own": own.astype(np.int32), "cells": [np.flatnonzero(r).astype(np.int32) for r in reach]})

    placed = scratch.save(vectors.mapInPandas(assign, f"id long, dim int, vec array<{kind}>, own int, cells array<int>"), "placed")
    reach = placed.select("dim", "own", F.explode("cells").alias("cell")).groupBy("dim", "cell").agg(F.count("*").alias("n"), F.count_if(F.col("own") == F.col("cell")).alias("cores"))
    most = lambda values: F.greatest(F.lit(1), F.expr(f"{values} div dim"))
    parts = reach.where("cores > 0").select("dim", "cell", F.ceil(F.col("cores") / most(CORE_VALUES)).cast("int").alias("parts"), F.ceil(F.col("n") / most(TILE_VALUES)).cast("int").alias("tiles"))
    # A row a pivot.
    cells = placed.select("id", "dim", "vec", "own", F.explode("cells").alias("cell")).join(F.broadcast(parts), ["dim", "cell"])
    dealt = lambda seed, n: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
    tile = cells.select("dim", "cell", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), dealt(1, "tiles").alias("tile"), "id", "vec", F.lit(False).alias("core"))
    core = cells.where("own = cell").select("dim", "cell", dealt(2, "parts").alias("part"), F.explode(F.expr("sequence(0, tiles - 1)")).alias("tile"), "id", "vec", F.lit(True).alias("core"))

    def joined(cell: pd.DataFrame) -> pd.DataFrame:
        return join_core(cell, least)

    return tile.union(core).groupBy("dim", "cell", "part", "tile").applyInPandas(joined, "id long, n long, root long")
