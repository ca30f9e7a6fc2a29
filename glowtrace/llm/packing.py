"""Best-fit packing of documents into token budgets under conflicts of source and duplicate cluster."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glowtrace.llm.common import SPACE, Scratch, word_count

#: Words in a bin, pieces of one source that a bin may hold, and words that are packed together in one task.
CAPACITY, PER_SOURCE, SHARD_WORDS = 2048, 2, 2_000_000


class Seen:
    """What pieces of one (source, conflicts) have passed over on the shelves: places before ``at[r]`` of shelf r are left or
    barred to them for good, and levels in ``dead`` hold nothing else."""

    def __init__(self) -> None:
        self.at: dict[int, int] = {}
        self.dead, self.log = 0, 0


class Bins:
    """Open bins of one shard in the order of their residual, for successor search.

    ``shelves[r]`` lists the bins that came to have r words free, in that order; a bin that has taken more since then has left
    the place. ``levels`` has a bit for each r with a bin. A bin carries a bitmap of its sources that can't enter it any more
    (``planes`` count a source's pieces up to its quota) and a 256-bit bitmap of its conflicts (duplicate clusters and
    documents), whose hits are confirmed in ``members``. A bin never opens again for a source or a conflict, so each search
    goes on where the last one for the same source, or source and conflicts, stopped.
    """

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.levels = 0
        self.shelves: dict[int, list[int]] = {}
        self.held: dict[int, int] = {}
        self.log: list[int] = []
        self.seen: dict[tuple, Seen] = {}
        self.bitmaps: list[int] = []
        self.members: list[set] = []
        self.planes: list[list[int]] = []
        self.free: list[int] = []

    def _shelve(self, b: int) -> None:
        r = self.free[b]
        if not r:
            return
        self.shelves.setdefault(r, []).append(b)
        self.held[r] = self.held.get(r, 0) + 1
        self.levels |= 1 << r
        self.log.append(r)

    def _seen(self, key: tuple) -> Seen:
        seen = self.seen.get(key)
        if seen is None:
            seen = self.seen[key] = Seen()
        # Levels that got a bin since the last search are worth a look again.
        if len(self.log) - seen.log > 64:
            seen.dead = 0
        else:
            for r in self.log[seen.log :]:
                seen.dead &= ~(1 << r)
        seen.log = len(self.log)
        return seen

    def _find(self, words: int, source: int, conflicts: tuple) -> int | None:
        """The first bin on the tightest shelf that takes the piece."""
        seen, bit, bits = self._seen((source, *conflicts)), 1 << source, 0
        plain = self._seen((source,)) if conflicts else seen
        for c in conflicts:
            bits |= 1 << (c % 256)
        free, planes, bitmaps, members = self.free, self.planes, self.bitmaps, self.members
        left = (self.levels & ~(seen.dead | plain.dead)) >> words << words
        while left:
            low = left & -left
            left ^= low
            r = low.bit_length() - 1
            shelf = self.shelves[r]
            j, prefix, hit = max(seen.at.get(r, 0), plain.at.get(r, 0)), True, None
            while j < len(shelf):
                b = shelf[j]
                if free[b] == r and not planes[b][-1] & bit and not (bitmaps[b] & bits and any(c in members[b] for c in conflicts)):
                    hit = b
                    break
                j += 1
            seen.at[r] = j
            if hit is not None:
                return hit
            seen.dead |= low
        return None

    def put(self, words: int, source: int, conflicts: tuple = ()) -> tuple[int, int]:
        """The bin and offset for a piece: successors of its length are searched until one is compatible, else a new bin."""
        b = self._find(words, source, conflicts)
        if b is None:
            b = len(self.free)
            self.bitmaps.append(0)
            self.members.append(set())
            self.planes.append([0] * self.per_source)
            self.free.append(self.capacity)
        else:
            r = self.free[b]
            self.held[r] -= 1
            if not self.held[r]:
                self.levels ^= 1 << r
        at = self.capacity - self.free[b]
        self.free[b] -= words
        for c in conflicts:
            self.bitmaps[b] |= 1 << (c % 256)
            self.members[b].add(c)
        for k, plane in enumerate(self.planes[b]):
            if not plane >> source & 1:
                self.planes[b][k] |= 1 << source
                break
        self._shelve(b)
        return b, at


def _codes(keys: pd.Series, first: int) -> list[int]:
    """A number from ``first`` for each key that several pieces here have; the others can't conflict, and get -1."""
    several = keys.where(keys.groupby(keys).transform("size") > 1)
    return (several.rank(method="dense").fillna(-first).astype(int) + first - 1).where(several.notna(), -1).tolist()


def pack_shard(pieces: pd.DataFrame, capacity: int, per_source: int) -> pd.DataFrame:
    """Pieces (doc_id, copy, piece, words, source, cluster) with their bin and offset, longest first, ties by id and piece."""
    pieces = pieces.sort_values(["words", "doc_id", "piece", "copy", "cluster"], ascending=[False, True, True, True, True], kind="stable", na_position="first")
    sources = pieces["source"].fillna("\0null").rank(method="dense").astype(int) - 1
    clusters = _codes(pieces["cluster"], 0)
    ids = _codes(pieces["doc_id"], max(clusters, default=0) + 1)
    bins = Bins(capacity, per_source)
    put = [bins.put(w, s, tuple(c for c in both if c >= 0)) for w, s, *both in zip(pieces["words"].tolist(), sources.tolist(), clusters, ids, strict=True)]
    return pieces.assign(bin=[b for b, _ in put], offset=[at for _, at in put])


def pack(docs: DataFrame, cluster: str | None = None, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, copy, piece, from_word, words, source, cluster, shard, bin, offset): a row for each piece of a document.

    A document longer than ``capacity`` is cut into full pieces and a rest. A bin holds at most ``capacity`` words, at most
    ``per_source`` pieces of a source, and no two pieces of a duplicate cluster or of one doc_id; full pieces fill bins of
    their own. ``cluster`` names the column of the duplicate clusters; without it, texts that are equal but for white space
    are one cluster. Pieces are dealt to shards by a hash of id, row and piece, as many as the
    words need, so that a shard is bounded whatever sources or clusters are large; each is packed best-fit, longest first.

    Null or empty text has no words and no piece. Null source: a source of its own. Null cluster, null doc_id: conflict with nothing.
    Repeated rows are packed apart; ``copy`` numbers them. Empty table: empty result.
    """
    text = F.col("text").cast("string")
    key = F.col(cluster).cast("string") if cluster else F.xxhash64(F.regexp_replace(text, f"{SPACE}+", "")).cast("string")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"), key.alias("cluster"))
    sized = Scratch(docs.sparkSession, "pack").save(sized.groupBy("doc_id", "source", "size", "cluster").agg(F.count("*").alias("copies")), "sized")
    total = sized.agg(F.sum(F.col("size") * F.col("copies"))).first()[0] or 0
    shards = max(1, -(-total // shard_words))

    starts = F.when(F.col("size") > 0, F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(capacity).cast("long")))
    rows = sized.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("*", F.posexplode(starts).alias("piece", "from_word"))
    rows = rows.withColumn("words", F.least(F.col("size") - F.col("from_word"), F.lit(capacity).cast("long"))).withColumn("piece", F.col("piece").cast("long"))
    shard = F.pmod(F.xxhash64("doc_id", "copy", "piece", "cluster"), F.lit(shards)).cast("long")
    rows = rows.select("doc_id", "copy", "piece", "from_word", "words", "source", "cluster", shard.alias("shard"))

    def packed(shard: pd.DataFrame) -> pd.DataFrame:
        return pack_shard(shard, capacity, per_source)

    return rows.groupBy("shard").applyInPandas(packed, rows.schema.simpleString()[7:-1].replace(":", " ") + ", bin long, offset long")


def packed_bins(docs: DataFrame, cluster: str | None = None) -> DataFrame:
    """(shard, bin, words, doc_ids, pieces): the bins with their documents in order; nulls, repeats and empty tables as in
    ``pack``."""
    rows = pack(docs, cluster)
    content = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "from_word", "words")))
    bins = rows.groupBy("shard", "bin").agg(F.sum("words").alias("words"), content.alias("pieces"))
    return bins.select("shard", "bin", "words", F.col("pieces.doc_id").alias("doc_ids"), "pieces")
