"""The corpus pipeline: from all documents to packed bins of a mixed, deduplicated, identified corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glowtrace.llm import exact_dedup, langid, minhash, mixing, packing
from glowtrace.llm.common import Scratch, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; those without text or letters, or far from all, go. Rows that
    repeat an id, or have none, are judged each; without labelled rows, or rows, nothing is kept."""
    return langid.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for white space: the longest, then the smallest id, a null one last.
    Rows, not ids, are dropped. Empty table: empty result."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that links of similar texts join: that of the smallest id, a null one last. Rows, not ids, are
    dropped; rows without words stay. Empty table: empty result."""
    return minhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of its slots; a null source is one of its own, rows that repeat
    an id are documents of their own, and those without words go. Empty table: empty result."""
    return mixing.mixed_documents(docs)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(shard, bin, words, doc_ids, pieces): no bin holds a document, or a copy of its text, twice. Null ids conflict with
    nothing. Empty table: empty result."""
    return packing.packed_bins(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("source mixing", mix_sources),
    ("best-fit packing", pack_bins),
]

#: Language ID can't be expressed in SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next; then what it was made of goes."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.save(docs, f"stage{i + 1}")
            if i:
                scratch.drop(before)
    return docs
