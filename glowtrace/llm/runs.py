"""Periodic runs of words: Lyndon roots extended both ways by the suffix trees of a text and of its reversal."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glowtrace.llm.common import WORD, small_batches
from glowtrace.llm.suffix_tree import Extensions

#: A run has at least this many words, and repeats its period at least this often.
LEAST_WORDS, LEAST_REPEATS = 24, 3


def _next_past(rank: list[int], size: int) -> np.ndarray:
    """For each i the next j > i with rank[j] < rank[i], or ``size``."""
    out, open_ = [size] * size, []
    for j in range(size):
        here = rank[j]
        while open_ and rank[open_[-1]] > here:
            out[open_.pop()] = j
        open_.append(j)
    return np.array(out, np.int64)


def runs_of(symbols: np.ndarray, least: int, repeats: int) -> np.ndarray:
    """Rows (start, length, period) of all runs of ``least`` symbols or more that repeat their period ``repeats`` >= 2 times.

    Every run holds a root that is the longest Lyndon word at its place, in one of the two orders of the symbols; that word
    ends before the next smaller suffix. So a sequence has at most two candidates a place (Bannai et al., 2017), and each is
    extended to the right and to the left as far as it keeps its period. A Lyndon word is primitive, so the period of a run,
    which repeats it, is its smallest."""
    n = len(symbols)
    if n < 2:
        return np.empty((0, 3), np.int64)
    right, left = Extensions(symbols), Extensions(symbols[::-1])
    rank = right.rank[:n]
    at = np.arange(n)
    i = np.concatenate([at, at])
    # In the second order the end is not the smallest suffix, so nothing is known of words that end there.
    j = np.concatenate([_next_past(rank.tolist(), n), _next_past((-rank).tolist(), n)])
    near = (j - i <= n // repeats) & ((np.arange(2 * n) < n) | (j < n))
    i, j = i[near], j[near]
    start, stop = i - left(n - i, n - j), j + right(i, j)
    found = np.stack([start, stop - start, j - i], axis=1)
    return np.unique(found[found[:, 1] >= np.maximum(least, repeats * found[:, 2])], axis=0)


def window_codes(codes: np.ndarray, width: int) -> np.ndarray:
    """A code for each window of ``width`` codes; equal windows have equal ones."""
    out, have = codes.copy(), 1
    while have < width:
        step = min(have, width - have)
        out = (out[: len(out) - step] ^ (out[: len(out) - step] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + out[step:]
        have += step
    return out


def suspects(codes: np.ndarray, least: int, repeats: int) -> list[tuple[int, int]]:
    """Stretches outside of which no run can lie, from codes that are equal for equal words.

    A run of length L and period q repeats every window of ``width`` words in it q words on or back, as L - q is at least
    ``width``, and these windows cover it; q is at most L / repeats. So stretches without a window that recurs that near inside
    them hold no run, and what recurs is cut anew until nothing changes."""
    width = -(-least * (repeats - 1) // repeats)
    todo, done = [(0, len(codes))], []
    while todo:
        low, high = todo.pop()
        if high - low < least:
            continue
        windows = window_codes(codes[low:high], width)
        order = np.argsort(windows, kind="stable")
        near = (windows[order[1:]] == windows[order[:-1]]) & (order[1:] - order[:-1] <= (high - low) // repeats)
        if not near.any():
            continue
        edge = np.zeros(high - low + 1, np.int64)
        marked = np.unique(np.concatenate([order[1:][near], order[:-1][near]]))
        np.add.at(edge, marked, 1)
        np.add.at(edge, marked + width, -1)
        inside = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
        cuts = np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2)
        if len(cuts) == 1 and tuple(cuts[0]) == (0, high - low):
            done.append((low, high))
        else:
            todo += [(low + int(a), low + int(b)) for a, b in cuts]
    return sorted(done)


def word_runs(words: list[bytes], least: int = LEAST_WORDS, repeats: int = LEAST_REPEATS) -> np.ndarray:
    """Rows (start, length, period) of the runs of words, by start, then period."""
    if len(words) < least:
        return np.empty((0, 3), np.int64)
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    found = []
    for low, high in suspects(codes, least, repeats):
        number: dict[bytes, int] = {}
        symbols = np.array([number.setdefault(w, len(number) + 1) for w in words[low:high]], np.int64)
        found.append(runs_of(symbols, least, repeats) + [low, 0, 0])
    out = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def periodic_runs(docs: DataFrame, least: int = LEAST_WORDS, repeats: int = LEAST_REPEATS) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for documents (doc_id, text), rows as they come; other columns are ignored.

    ``runs`` are (start, length, period) in words, by start, then period: stretches whose smallest period is ``period``, of at
    least ``least`` words and ``repeats`` periods, which no neighbouring word extends. ``collapsed`` are the words, joined by one
    space, without those that any run holds after its first period. The suffix trees are built of the stretches that can
    hold a run, so a text without repetition costs a sort of its windows, and memory grows with the longest such stretch.

    Null or empty text: no words, no runs, an empty text. Null and repeated ids are kept as they are. Empty table: empty
    result. One pass without a shuffle; whole texts."""
    if repeats < 2 or least < 2:
        raise ValueError("a run repeats its period at least twice")
    small_batches(docs.sparkSession)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                runs = word_runs(words, least, repeats)
                kept = np.ones(len(words), bool)
                for start, length, period in runs:
                    kept[start + period : start + length] = False
                left = words if kept.all() else [w for w, k in zip(words, kept, strict=True) if k]
                rows.append((doc_id, len(words), [{"start": s, "length": n, "period": p} for s, n, p in runs.tolist()], b" ".join(left).decode("utf-8", "surrogatepass")))
            out = pd.DataFrame(rows, columns=["doc_id", "n_words", "runs", "collapsed"])
            yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return columns.mapInPandas(find, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the words of a tenth of the documents, drawn by the CRC-32 of their ids, made periodic from some
    word on: word i >= a becomes word a + (i - a) % p. A null id draws nothing."""
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.col("text").cast("string"), F.lit(WORD), F.lit(0))
    drawn = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.when(h % 10 == 0, words).alias("words"), F.floor(h / 10).cast("long").alias("g"))
    drawn = drawn.withColumn("n", F.size("words").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    drawn = drawn.withColumn("p", F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)).cast("long") + 1)
    at = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    planted = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.element_at("words", (at(i) + 1).cast("int"))), " ")
    return drawn.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """A row a document of ``periodic_runs``: the number of runs, the one that repeats its period most often (exactly, ties:
    the smallest start, then period), and the digests of all runs and of the collapsed text."""
    # Runs come by start, then period, so the first of equal ones stays.
    first = F.get("runs", F.lit(0))
    best = F.aggregate(F.slice("runs", F.lit(2), F.greatest(F.size("runs") - 1, F.lit(0))), first, lambda held, r: F.when(r["length"] * held["period"] > held["length"] * r["period"], r).otherwise(held))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    out = found.withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
