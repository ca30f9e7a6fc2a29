"""Near-duplicate documents: circulant MinHash, banding, and exact Jaccard on the full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glowtrace.llm.common import ROW, SALTED, Scratch, columns_of, join_groups, sized_broadcast, small_batches, spread_join, with_stable_keys, without_rows_of
from glowtrace.llm.components import connected_components

#: Signature coordinates = BANDS * ROWS. A pair at 0.75 shares no band with a chance of (1 - 0.75^4)^40, below 3e-7.
BANDS, ROWS = 40, 4
#: The permutations act on this many positions.
DOMAIN = 1 << 20
#: 64-bit words of the masks that bound a pair's intersection.
MASKS = 16
#: Pairs of members of bands that are looked at in one step.
FEW_PAIRS = 20_000_000
SEED = 20240229


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit codes of the ``width``-word shingles; a shorter text is one shingle, an empty one has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    code = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    span = min(width, len(words))
    n = len(words) - span + 1
    out = np.full(n, span, np.uint64)
    for k in range(span):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + code[k : k + n]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return np.unique(out)


@lru_cache(maxsize=2)
def permutations(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """The first permutation, and all circular shifts of the second as rows of a view."""
    rng = np.random.default_rng(SEED)
    first, second = rng.permutation(DOMAIN).astype(np.int32), rng.permutation(DOMAIN).astype(np.int32)
    ring = np.concatenate([second, second[: coordinates - 1]])
    return first, np.lib.stride_tricks.sliding_window_view(ring, coordinates)


def signature(hashes: np.ndarray, coordinates: int) -> np.ndarray:
    """Coordinate k is the least value of the second permutation, shifted k places, over the first one's images of the set."""
    first, shifted = permutations(coordinates)
    at = first[(hashes & np.uint64(DOMAIN - 1)).astype(np.int64)]
    least = np.full(coordinates, DOMAIN, np.int32)
    for i in range(0, len(at), 2048):
        np.minimum(least, shifted[at[i : i + 2048]].min(axis=0), out=least)
    return least


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    part = sig.astype(np.uint64).reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(rows):
        key = (key ^ (key >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + part[:, k]
    key ^= key >> np.uint64(30)
    return key.view(np.int64)


def set_key(hashes: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None


def _sketches(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_hashes(t, width) for t in batch["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    ROW: batch[ROW],
                    "n_shingles": [len(s) for s in sets],
                    "set_key": [set_key(s) for s in sets],
                    "bands": [band_keys(signature(s, bands * rows), bands, rows) if len(s) else None for s in sets],
                }
            )

    return docs.mapInPandas(sketch, f"doc_id long, {ROW} long, n_shingles long, set_key binary, bands array<long>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            codes = [shingle_hashes(t, width).view(np.int64) for t in batch["text"]]
            yield pd.DataFrame({ROW: batch[ROW], "n": [len(c) for c in codes], "codes": codes})

    return docs.mapInPandas(sets, f"{ROW} long, n long, codes array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(x, y, shared, joined): sizes of intersection and union, for a written table of pairs (x, y). The pairs of a document
    with many partners are spread, and its set is sent to each of their tasks."""
    of = lambda n: sets.select(F.col(ROW).alias(n), F.col("codes").alias(f"{n}_codes"))
    both = spread_join(spread_join(pairs, of("y"), "y", "x", scratch), of("x"), "x", "y", scratch)
    shared = F.size(F.array_intersect("x_codes", "y_codes")).cast("long")
    return both.select("x", "y", shared.alias("shared"), (F.size("x_codes") + F.size("y_codes")).cast("long").alias("sizes")).select(
        "x", "y", "shared", (F.col("sizes") - F.col("shared")).alias("joined")
    )


def _with_component(df: DataFrame, key: str, components: DataFrame, name: str) -> DataFrame:
    """``df`` with the component of its column ``key``, whose values are all but distinct."""
    of = components.select(F.col("id").alias(key), F.col("component").alias("_c"))
    return df.join(of, key, "left").withColumn(name, F.coalesce("_c", key)).drop("_c")


def near_duplicates(docs: DataFrame, similarity: int = 75, width: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for documents (doc_id, text); other columns are ignored.

    Documents are linked if 100 * intersection >= ``similarity`` * union over their sets of distinct ``width``-word shingles.
    A component is what links reach; its smallest doc_id is kept. Documents with equal sets are one before anything is
    compared. Candidates share a band; a band's members are compared first with one of them, and members of other
    components only where components still differ, so a band of any size costs about one comparison a member and no link
    that could join two components stays unchecked.

    Null or empty text: no shingles, own component. Rows that repeat a doc_id, or have none, are documents of their own with
    their own links and component; ``kept`` says whether a row's doc_id is its component's, so all rows of that id and
    component have it. Only where all of a component are null is its id null, and kept true. Empty table: empty result.
    """
    rows_, key = with_stable_keys(docs, Scratch(docs.sparkSession, "near"))
    return _near_rows(rows_, key, similarity, width, bands, rows).drop(ROW, "leads")


def _near_rows(docs: DataFrame, key: str, similarity: int = 75, width: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``near_duplicates`` with the key of each row, and ``leads``, true for one row of each component: the smallest doc_id's, a
    null one last."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "minhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(key).alias(ROW), F.col("text").cast("string").alias("text"))
    sketches = scratch.save(_sketches(docs, width, bands, rows), "sketches")
    heads = scratch.save(sketches.drop("bands"), "heads")
    usable = sketches.where("set_key is not null")

    # Equal sets: one representative row.
    same = scratch.save(usable.groupBy("set_key").agg(F.min(ROW).alias("rep"), F.count("*").alias("size")).where("size > 1"), "same")
    copies = join_groups(usable.select("set_key", ROW), same, ["set_key"], [ROW]).where(F.col(ROW) != F.col("rep")).select(F.col(ROW).alias("u"), F.col("rep").alias("v"))
    copies = scratch.save(copies, "copies")
    reps = usable.join(sized_broadcast(copies).select(F.col("u").alias(ROW)), ROW, "left_anti")

    # Bands with at least two representatives; c is the one with the least key.
    member = reps.select(F.col(ROW).alias("x"), F.explode("bands").alias("band"))
    shared = member.groupBy("band").agg(F.min("x").alias("c"), F.max("x").alias("last"), F.count("*").alias("size")).where("c < last").select("band", "c", "size")
    shared = scratch.save(shared, "shared")
    members = scratch.save(join_groups(member, shared, ["band"], ["x"]).where("c is not null").select("band", "x", "c").distinct(), "members")
    scratch.drop(sketches)

    # Full sets of the members only, read again.
    ids = scratch.save(members.select(F.col("x").alias(ROW)).distinct(), "ids")
    sets = scratch.save(_sets(docs.select(ROW, "text").join(sized_broadcast(ids), ROW, "left_semi"), width), "sets")

    def confirm(pairs: DataFrame, tag: str) -> DataFrame:
        step = Scratch(spark, "pairs")
        out = scratch.save(_verified(step.save(pairs, f"{tag}_pairs"), sets, step), tag)
        step.clear()
        return out

    def linked(checked: DataFrame) -> DataFrame:
        return checked.where(F.col("shared") * 100 >= F.col("joined") * similarity).select(F.col("x").alias("u"), F.col("y").alias("v"))

    def grown(found: DataFrame, checked: DataFrame) -> DataFrame:
        """The components with the links among newly checked pairs."""
        links = linked(checked)
        return found if links.isEmpty() else connected_components(links.union(found), scratch)

    def by_component(found: DataFrame, others: DataFrame, to: Scratch) -> DataFrame:
        """Rows (band, x, c) of members, of the bands that hold ``others`` of several components, with their own component
        (cx), that of the band's first member (cc), and the band's size."""
        step = Scratch(spark, "bands")
        own = step.save(_with_component(others, "x", found, "cx"), "own")
        mixed = own.groupBy("band").agg(F.min("cx").alias("lo"), F.max("cx").alias("hi")).where("lo < hi").select("band")
        mixed = step.save(_with_component(shared.join(mixed, "band"), "c", found, "cc").drop("c"), "mixed")
        out = to.save(join_groups(own, mixed, ["band"], ["x"]).where("cc is not null"), "state")
        step.clear()
        return out

    # 1: each document with the smallest first member of its bands.
    first = confirm(members.where("x <> c").groupBy("x").agg(F.min("c").alias("y")), "first")
    found = connected_components(linked(first), scratch)

    # 2: with the other first members, where components differ.
    step = Scratch(spark, "stars")
    stars = by_component(found, members, step).where("x <> c and cx <> cc").select("x", F.col("c").alias("y")).distinct()
    second = confirm(stars.join(first, ["x", "y"], "left_anti"), "second")
    step.clear()
    found = grown(found, second)
    checked = first.union(second)

    # 3: members of a band that are still apart, in two blocks. All of other components are compared with the first member by
    # now, so only bands whose further members are in several components count: two unlike documents that meet in a band cost
    # nothing more. Only shingles that also occur in another component can be shared by a new link, and a mask of them (a bit
    # that only one of two sets has is a shingle that the other lacks) bounds the similarity from above. Each pair is looked at
    # in the first band it shares, and a large band's pairs are dealt to tasks by a hash of their first document. Where the
    # bands hold few pairs, both blocks are one.
    slots, done = 64, 0
    while done < slots:
        step = Scratch(spark, "apart")
        state = by_component(found, members.where("x <> c"), step).withColumn("salts", F.ceil(F.col("size") / SALTED).cast("int"))
        if state.isEmpty():
            step.clear()
            break
        apart = step.save(state.groupBy("x", "cx").agg(F.array_sort(F.collect_set("band")).alias("at")), "apart")
        codes = apart.join(sets.withColumnRenamed(ROW, "x"), "x").select("x", "cx", F.explode("codes").alias("code"))
        across = codes.groupBy("code").agg(F.min("cx").alias("lo"), F.max("cx").alias("hi"), F.count("*").alias("size")).where("lo < hi").select("code", "size")
        common = join_groups(codes.drop("cx"), step.save(across, "across"), ["code"], ["x"]).where("size is not null")
        bit, word = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("code", F.lit(64)).cast("int")), F.pmod(F.shiftright("code", 6), F.lit(MASKS))
        masks = [F.bit_or(F.when(word == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"mask{k}") for k in range(MASKS)]
        common = common.groupBy("x").agg(F.count("*").alias("m"), *masks).join(sets.select(F.col(ROW).alias("x"), "n"), "x")
        able = step.save(apart.join(common, "x").where(F.col("m") * 100 >= F.col("n") * similarity), "able")
        at = state.select("band", "x", "cc", "salts").join(able, "x")
        at = step.save(at, "at")
        own = [k for k in able.columns if k not in ("band", "cc", "salts")]
        sizes = at.groupBy("band").agg(F.count("*").alias("all"), F.count_if(F.expr("cx <> cc")).alias("apart"))
        few = (sizes.agg(F.sum(F.col("all") * F.col("apart"))).first()[0] or 0) <= FEW_PAIRS
        upto = slots if few or done else 4
        slot = F.pmod(F.xxhash64("x"), F.lit(slots))
        a = at.where("cx <> cc").select("band", F.pmod(F.xxhash64("x", F.lit(1)), F.col("salts")).cast("int").alias("salt"), *[F.col(k).alias(f"{k}_a") for k in own])
        b = at.where((slot >= done) & (slot < upto)).select("band", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), *[F.col(k).alias(f"{k}_b") for k in own])
        alone = lambda p, q: sum(F.bit_count(F.col(f"mask{k}_{p}").bitwiseAND(F.bitwise_not(f"mask{k}_{q}"))) for k in range(MASKS))
        need = (F.col("n_a") + F.col("n_b")) * similarity
        possible = (F.least("m_a", "m_b") * (100 + similarity) >= need) & ((F.col("m_a") - alone("a", "b")) * (100 + similarity) >= need) & ((F.col("m_b") - alone("b", "a")) * (100 + similarity) >= need)
        here = F.array_min(F.array_intersect("at_a", "at_b")) == F.col("band")
        pairs = a.join(b, ["band", "salt"]).where((F.col("cx_a") != F.col("cx_b")) & possible & here)
        pairs = pairs.select(F.greatest("x_a", "x_b").alias("x"), F.least("x_a", "x_b").alias("y")).distinct().join(checked, ["x", "y"], "left_anti")
        more = confirm(pairs, "cross")
        step.clear()
        checked, done, found = checked.union(more), upto, grown(found, more)

    links = found.select(F.col("id").alias("u"), F.col("component").alias("v"))
    # A representative of very many copies is one key of this join, so its copies are spread.
    merged = spread_join(copies, _with_component(copies.select("v").distinct(), "v", links.toDF("id", "component"), "root"), "v", "u", scratch).select("u", F.col("root").alias("v"))
    final = links.union(merged).groupBy(F.col("u").alias(ROW)).agg(F.min("v").alias("root"))
    kept = Scratch(spark, "near")
    out = heads.join(final, ROW, "left").withColumn("root", F.coalesce("root", ROW))
    out = kept.save(out, "rows")
    scratch.clear()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "set_key", ROW)).alias("first")
    roots = kept.save(out.groupBy("root").agg(first, F.count("*").alias("size")).where("size > 1"), "roots")
    out = join_groups(out, roots, ["root"], [ROW])
    leads = F.coalesce(F.col(f"first.{ROW}") == F.col(ROW), F.lit(True))
    out = out.select(ROW, "doc_id", "n_shingles", F.coalesce("first.doc_id", "doc_id").alias("component_id"), leads.alias("leads"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, the one with the smallest doc_id (null last); columns as they
    come. Documents without words are copies of nothing and stay; rows that repeat an id or have none are decided one by
    one. Empty table: empty result."""
    scratch = Scratch(docs.sparkSession, "near")
    rows, key = with_stable_keys(docs, scratch)
    return without_rows_of(rows, _near_rows(rows, key).where("not leads").select(F.col(ROW).alias(key)), key, scratch).select(columns_of(docs))
