"""Ranked lexical search: term at a time over blocks of documents, with a limited set of accumulators."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glowtrace.llm.common import Scratch, small_batches

#: Results of an item.
TOP = 10
#: A group of items has about this many bytes of text; its terms go to every task. More items are more groups, one after the other.
GROUP_BYTES = 4 << 20
#: Postings that a task ranks at a time, about 24 bytes each.
BLOCK_POSTINGS = 2_000_000

#: What separates terms, and A-Z, as bytes; bytes of characters beyond ASCII belong to terms.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if not (c >= 128 or 48 <= c <= 57 or 97 <= c <= 122) else c for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text: longest runs of digits, letters and all characters beyond ASCII, only A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split(b" ")


class Query:
    """The terms of a group of items: ``numbers`` maps a term to its number, ``wanted`` has each item's distinct terms."""

    def __init__(self, texts: list[str | None]):
        sets = [{t for t in terms_of(x) if t} for x in texts]
        self.numbers = {t: i for i, t in enumerate(sorted(set().union(*sets)))}
        self.wanted = [np.array(sorted(map(self.numbers.get, s)), np.int64) for s in sets]


def _postings(docs: DataFrame, query: Query) -> DataFrame:
    """(doc_id, n, terms, times): how many terms each document has, and the numbers and frequencies of the query's."""
    numbers = docs.sparkSession.sparkContext.broadcast(query.numbers)  # at most the terms of GROUP_BYTES of text

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = numbers.value
        for batch in batches:
            lengths, cuts, found, times = [], [0], [], []
            for text in batch.column("text"):
                counts = Counter(terms_of(text.as_py()))
                counts.pop(b"", None)
                lengths.append(counts.total())
                hits = [(known[t], n) for t, n in counts.items() if t in known] if len(counts) < len(known) else [(known[t], counts[t]) for t in known.keys() & counts.keys()]
                found += [t for t, _ in hits]
                times += [n for _, n in hits]
                cuts.append(len(found))
            lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(v, pa.int32())) for v in (found, times)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths, pa.int64()), *lists], ["doc_id", "n", "terms", "times"])

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return columns.mapInArrow(index, "doc_id long, n long, terms array<int>, times array<int>")


def _frequencies(postings: DataFrame, size: int) -> dict[int, int]:
    """Documents of each term; tasks add up before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("terms").flatten().to_numpy(zero_copy_only=False), minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["term", "df"])

    counted = postings.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r["term"]: r["df"] for r in counted.collect()}  # at most the query's terms


class Block:
    """The postings of some documents by term, with the part of a score that each adds."""

    def __init__(self, n: np.ndarray, cuts: np.ndarray, terms: np.ndarray, times: np.ndarray, weights: np.ndarray, documents: int, length: int):
        doc = np.repeat(np.arange(len(n)), np.diff(cuts))
        m = 10 + (90 * n * documents) // max(length, 1)
        times = times.astype(np.int64)
        part = weights[terms] * ((1_000_000_000 * times) // (1000 * times + 8 * m[doc]))
        order = np.argsort(terms, kind="stable")  # documents stay in order within a term
        self.size, self.doc, self.part = len(n), doc[order], part[order]
        self.cut = np.searchsorted(terms[order], np.arange(len(weights) + 1))
        filled = np.flatnonzero(np.diff(self.cut))
        self.bound = np.zeros(len(weights), np.int64)
        if len(filled):
            self.bound[filled] = np.maximum.reduceat(self.part, self.cut[filled])

    def best(self, wanted: np.ndarray, top: int, floor_: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores): all that can be among the ``top`` of an item, where scores below ``floor_`` can't.

        The rarest term comes first. Once what the terms to come can add stays below the ``top``-th partial score, no document
        without an accumulator can be among the best, so none is created any more; those that are there, and can still reach
        that score, get all the rest."""
        wanted = wanted[self.bound[wanted] > 0]
        wanted = wanted[np.argsort((self.cut[wanted + 1] - self.cut[wanted]) * len(self.cut) + wanted)]
        rest = np.cumsum(self.bound[wanted][::-1])[::-1]
        total = rest[0] if len(rest) else 0
        score = np.zeros(self.size, np.int64)
        alive = None
        for k, term in enumerate(wanted):
            if alive is None and (rest[k] < floor_ or rest[k] <= total - rest[k]):
                bar = floor_
                if np.count_nonzero(score) >= top:
                    bar = max(bar, int(np.partition(score, self.size - top)[self.size - top]))
                if rest[k] < bar:
                    alive = np.flatnonzero((score > 0) & (score + rest[k] >= bar))
            low, high = self.cut[term], self.cut[term + 1]
            doc, part = self.doc[low:high], self.part[low:high]
            if alive is None:
                score[doc] += part
            elif len(alive):
                at = np.minimum(np.searchsorted(doc, alive), len(doc) - 1)
                hit = doc[at] == alive
                score[alive[hit]] += part[at[hit]]
        alive = np.flatnonzero(score) if alive is None else alive
        alive = alive[score[alive] >= max(floor_, 1)]
        return alive, score[alive]


def _leading(ids: np.ndarray, missing: np.ndarray, scores: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` highest scores, equal ones by ascending id, null ids last."""
    if len(scores) > 4 * top:
        bar = np.partition(scores, len(scores) - top)[len(scores) - top]
        near = np.flatnonzero(scores >= bar)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], missing[near], -scores[near]))[:top]]


def _ranked(postings: DataFrame, query: Query, weights: np.ndarray, documents: int, length: int, top: int) -> DataFrame:
    """(item, doc_id, score): the best of each task for each item, by its place in the group."""
    shipped = postings.sparkSession.sparkContext.broadcast((query.wanted, weights))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weights = shipped.value
        none = (np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64))
        held = [none] * len(wanted)

        def search(some: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(some).combine_chunks()
            ids = table["doc_id"].combine_chunks()
            missing, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
            lists = table["terms"].combine_chunks()
            cuts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            flat = [table[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("terms", "times")]
            block = Block(table["n"].to_numpy(), cuts, *flat, weights, documents, length)
            for i, terms in enumerate(wanted):
                before = held[i]
                at, score = block.best(terms, top, int(before[2][-1]) if len(before[2]) == top else 0)
                both = [np.concatenate(p) for p in zip(before, (ids[at], missing[at], score), strict=True)]
                lead = _leading(*both, top)
                held[i] = tuple(c[lead] for c in both)

        some, size = [], 0
        for batch in batches:
            some.append(batch)
            size += len(batch.column("terms").flatten()) + batch.num_rows
            if size >= BLOCK_POSTINGS:
                search(some)
                some, size = [], 0
        if some:
            search(some)
        ids, missing, scores = (np.concatenate([h[k] for h in held]) if held else none[k] for k in range(3))
        item = np.repeat(np.arange(len(held)), [len(h[0]) for h in held])
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(ids, pa.int64(), mask=missing), pa.array(scores, pa.int64())], ["item", "doc_id", "score"])

    return postings.mapInArrow(rank, "item long, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents (doc_id, text) of each item (item_id, text) by the integer score

        sum over the item's terms of w * ((10^9 tf) div (1000 tf + 8 m)),  m = 10 + (90 n N) div L,

    with w = floor(1000 ln((2N + 2) / (2 df + 1))): a saturating term frequency with length normalisation. Other columns are
    ignored. Equal scores come by ascending doc_id; only scores above 0 count.

    Each document's terms of the query are counted once and written. Then every task ranks its documents, some millions of
    postings at a time: term at a time, with accumulators limited by the bounds of the terms to come and by the best scores so
    far, and hands on ``top`` rows an item, so what is shuffled doesn't grow with the matches. Items are taken in groups of
    ``group_bytes`` of text, as many passes as there are groups.

    Null and empty texts, or without terms, match nothing and don't count in N; items without matches have no rows. Rows that
    repeat a doc_id are documents of their own, a null one comes last among equals; rows that repeat an item_id are items of
    their own. Empty tables: empty result."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "search")
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    groups = -(-int(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // group_bytes) or 1
    out = None
    for g in range(groups):
        mine = asked if groups == 1 else asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g)
        rows = mine.orderBy("item_id", "text").collect()  # about group_bytes of text
        query = Query([r["text"] for r in rows])
        postings = scratch.save(_postings(docs, query), "postings")
        documents, length = postings.where("n > 0").agg(F.count("*"), F.sum("n")).first()
        df = _frequencies(postings, len(query.numbers))
        weights = np.array([floor(1000 * log((2 * documents + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(query.numbers))], np.int64)
        best = _ranked(postings, query, weights, documents, length or 0, top)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        ids = scratch.save(spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], "item long, item_id long"), "items")
        found = scratch.save(best.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"), "found")
        scratch.drop(postings)
        out = found if out is None else out.union(found)
    return out
