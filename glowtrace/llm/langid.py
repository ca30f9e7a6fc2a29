"""Language identification by rank-order n-gram profiles (Cavnar and Trenkle, 1994)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glowtrace.llm.common import ROW, Scratch, columns_of, small_batches, with_stable_keys, without_rows_of

#: Ranks of a profile; an n-gram that a profile lacks counts as this far out of place.
PROFILE = 400
#: The pipeline keeps a document whose score is at least LEAST_SHARE of what all but FEWEST of the training fold's documents
#: reach in their own language, those of its length or all of them, whichever is less.
LEAST_SHARE, FEWEST = 0.5, 0.01
UNDETERMINED = "und"

#: What isn't a letter, or a mark on one; digits, numerals and superscripts are neither.
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def letters(text: str | None) -> str:
    """Lower-case letters with their marks, other runs as one space, a space at both ends; empty if there is no letter."""
    kept = _OTHER.sub(" ", (text or "").lower()).strip(" ")
    return f" {kept} " if _LETTER.search(kept) else ""


def gram_codes(kept: str) -> np.ndarray:
    """Codes of all 1-, 2- and 3-grams: up to three code points of 21 bits. A lone space is no n-gram."""
    c = np.frombuffer(kept.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    two = (c[:-1] << 21) | c[1:]
    return np.concatenate([c[c != 32], two, (two[:-1] << 21) | c[2:]])


def ranked(codes: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes, most frequent first, ties by code."""
    found, counts = np.unique(codes, return_counts=True)
    return found[np.argsort(-counts, kind="stable")[:size]]


def fit_profiles(labelled: DataFrame, size: int = PROFILE) -> list[tuple[str, list[int]]]:
    """Profiles (lang, codes by rank) of all rows (text, lang) with neither null: the most frequent n-grams of each language.

    n-grams are counted in every task, then per (lang, n-gram). Only the profiles, ``size`` codes a language, reach the
    driver. Languages without a letter in any text have no profile.
    """
    small_batches(labelled.sparkSession)

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[np.ndarray]] = {}

        def merged(lang: str) -> tuple[np.ndarray, np.ndarray]:
            codes = np.concatenate([c for c, _ in held[lang]])
            found, at = np.unique(codes, return_inverse=True)
            return found, np.bincount(at, weights=np.concatenate([n for _, n in held[lang]])).astype(np.int64)

        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                kept = [k for k in map(letters, texts) if k]
                for i in range(0, len(kept), 200):
                    parts = np.concatenate([gram_codes(k) for k in kept[i : i + 200]])
                    held.setdefault(lang, []).append(np.unique(parts, return_counts=True))
                if len(held.get(lang, ())) > 8:
                    held[lang] = [merged(lang)]
                    if len(held[lang][0][0]) > 1_000_000:
                        yield pd.DataFrame({"lang": lang, "code": held[lang][0][0], "n": held[lang][0][1]})
                        held[lang] = []
        for lang in held:
            if held[lang]:
                codes, n = merged(lang)
                yield pd.DataFrame({"lang": lang, "code": codes, "n": n})

    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    totals = rows.mapInPandas(counts, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    profiles: dict[str, list[int]] = {}
    for row in totals.withColumn("rank", rank).where(F.col("rank") <= size).orderBy("lang", "rank").collect():
        profiles.setdefault(row["lang"], []).append(row["code"])
    return sorted(profiles.items())


def language(text: Column, profiles: list[tuple[str, list[int]]], size: int = PROFILE) -> Column:
    """A struct (lang_pred, score) for a text: the profile at the least out-of-place distance, and 1 less its distance as a
    share of the greatest possible one. Null text, or text without a letter, or no profiles: ``und`` and 0. Ties go to the
    language that sorts first."""
    names = [name for name, _ in profiles]
    known = np.unique(np.array([c for _, codes in profiles for c in codes], np.int64))
    rank_of = np.full((len(names), len(known) + 1), -1, np.int32)
    for i, (_, codes) in enumerate(profiles):
        rank_of[i, np.searchsorted(known, codes)] = np.arange(len(codes))

    def nearest(text: str | None) -> tuple[str, float]:
        kept = letters(text)
        if not kept or not names:
            return UNDETERMINED, 0.0
        codes = ranked(gram_codes(kept), size)
        at = np.searchsorted(known, codes)
        at[known[np.minimum(at, len(known) - 1)] != codes] = len(known)
        ranks = rank_of[:, at]
        places = np.where(ranks < 0, size, np.minimum(np.abs(ranks - np.arange(len(codes))), size)).sum(axis=1)
        best = int(places.argmin())
        return names[best], float(1 - places[best] / (size * len(codes)))

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([nearest(t) for t in texts], columns=["lang_pred", "score"])

    return predict(text.cast("string"))


def in_training(doc_id: Column) -> Column:
    """Whether a document may be learnt from: the CRC-32 of its id as text leaves a remainder other than 1 by 3."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 != 1


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every document, from profiles of the training fold's labelled documents.

    Null text or text without a letter: ``und`` and 0. Null doc_id: as an empty id. Null lang: not learnt from. Repeated
    rows are learnt from and returned each. No labelled row: every document is ``und``. Empty table: empty result.
    """
    small_batches(docs.sparkSession)
    profiles = fit_profiles(docs.where(in_training(F.col("doc_id"))))
    found = docs.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), language(F.col("text"), profiles).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


def length_band(text: Column) -> Column:
    """Documents of like length: the bits of the number of code points."""
    return F.length(F.bin(F.coalesce(F.length(text), F.lit(0)).cast("long")))


def least_scores(scored: DataFrame) -> DataFrame:
    """(band, least): the least score that a document of a length is kept with, from rows (band, lang, learnt, found); the row
    with a null band is for all lengths, the others are for those of training documents whose own language is the nearest.
    There are as many bands as bits in a length."""
    right = scored.where(F.col("learnt") & (F.col("lang") == F.col("found.lang_pred")))
    return right.rollup("band").agg((F.percentile_approx("found.score", FEWEST, 10_000) * LEAST_SHARE).alias("least"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without those in no language: no text, no letter, or too far from every profile for their length; columns as
    they come. Nulls, repeated rows and
    empty tables as in ``identify``; without a labelled row nothing is kept."""
    small_batches(docs.sparkSession)
    profiles = fit_profiles(docs.where(in_training(F.col("doc_id"))))
    scratch = Scratch(docs.sparkSession, "language")
    rows, key = with_stable_keys(docs, scratch)
    text = F.col("text").cast("string")
    learnt = in_training(F.col("doc_id"))
    scored = rows.select(F.col(key).alias(ROW), length_band(text).alias("band"), F.col("lang").cast("string").alias("lang"), learnt.alias("learnt"), language(text, profiles).alias("found"))
    scored = scratch.save(scored, "scored")
    bars = {r["band"]: r["least"] for r in least_scores(scored).where("least is not null").collect()}  # a row a bit of a length
    most = bars.pop(None, 0.0)
    bar = F.lit(most)
    for band, least in sorted(bars.items()):
        bar = F.when(F.col("band") == band, F.lit(min(most, least))).otherwise(bar)
    rejected = scored.where((F.col("found.lang_pred") == UNDETERMINED) | (F.col("found.score") < bar)).select(F.col(ROW).alias(key))
    return without_rows_of(rows, rejected, key, scratch).select(columns_of(docs))
