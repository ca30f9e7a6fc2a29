"""The pipeline against a plain version of its decisions."""

import glob
import os
import re

import corpus_pipeline
from glowtrace.llm import langid, mixing
from glowtrace.llm.common import checkpoint_root

SMALL = "/root/testdata/sf0.001"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def rows_of(df):
    return sorted((str(r["doc_id"]), str(r["source"]), r["text"] or "") for r in df.collect())


def check_stages(spark, docs):
    """Every stage against a plain version of its decisions on what its predecessor kept."""
    stages = [f for _, f in corpus_pipeline.STAGES]
    named = stages[0](spark, docs, SMALL)
    found = langid.identify(docs.select("doc_id", "text", "lang")).collect()
    # A document in no language goes; the bar for the others is tested with the operator.
    undetermined = sorted(str(r["doc_id"]) for r in found if r["lang_pred"] == "und")
    assert named.columns == docs.columns and docs.count() - named.count() == len(undetermined)
    assert all(langid.letters(t) for _, _, t in rows_of(named))

    once = stages[1](spark, named, SMALL)
    best = {}
    for i, s, t in rows_of(named):
        key = re.sub(r"[\x20\x09-\x0D]", "", t)
        best.setdefault(key, []).append((-len(t), i == "None", int(i) if i != "None" else 0))
    kept = rows_of(once)
    assert once.columns == docs.columns and len(kept) == len(best)
    for i, s, t in kept:
        assert (-len(t), i == "None", int(i) if i != "None" else 0) == min(best.pop(re.sub(r"[\x20\x09-\x0D]", "", t)))

    first = stages[2](spark, once, SMALL)
    rows = [(i, t, shingles(t)) for i, _, t in kept]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, (_, _, s) in enumerate(rows):
        for b, (_, _, t) in enumerate(rows[:a]):
            both = len(s & t)
            if both and 100 * both >= 75 * len(s | t):
                up[find(a)] = find(b)
    groups = {}
    for k, (i, t, _) in enumerate(rows):
        groups.setdefault(find(k), []).append((i == "None", int(i) if i != "None" else 0))
    left = sorted((i == "None", int(i) if i != "None" else 0) for i, _, _ in rows_of(first))
    assert first.columns == docs.columns and left == sorted(min(g) for g in groups.values())

    mixed = stages[3](spark, first, SMALL)
    taken, words = {}, {}
    for r in mixing.taken_words(first).collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["taken"]
    for r in mixed.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].encode().split())
    assert words == {i: n for i, n in taken.items() if n} and mixed.columns == docs.columns

    packed = {}
    for b in stages[4](spark, mixed, SMALL).collect():
        ids = [i for i in b["doc_ids"] if i is not None]
        assert b["words"] <= 2048 and len(set(ids)) == len(ids)
        for p in b["pieces"]:
            packed[p["doc_id"]] = packed.get(p["doc_id"], 0) + p["words"]
    assert packed == words


def test_stages(spark):
    check_stages(spark, spark.read.parquet(f"{SMALL}/documents.parquet"))


def test_stages_on_repeated_ids_null_ids_and_rows(spark):
    base = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = [r["text"] for r in base.orderBy("doc_id").limit(6).collect()]
    odd = [(1, texts[0]), (1, texts[0]), (1, texts[1] + " end"), (None, texts[2]), (None, texts[2]), (None, texts[3] + " more words"), (2, texts[4].upper()), (2, "a"), (3, None), (3, ""), (3, "12 ½"), (4, texts[5].replace(" ", "\n"))]
    odd += [(5, texts[5]), (5, " ".join(texts))]
    rows = spark.createDataFrame([(i, t, None, ("src1", None)[k % 2], None) for k, (i, t) in enumerate(odd)], base.schema)
    check_stages(spark, base.unionByName(rows).unionByName(base.limit(20)))


def test_stages_on_no_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        assert docs.count() == 0


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns == ["shard", "bin", "words", "doc_ids", "pieces"] and out.count() > 0


def test_run_keeps_only_the_stage_that_is_read(spark):
    root = checkpoint_root(spark).removeprefix("file://")
    before = set(glob.glob(f"{root}/pipeline-*"))
    out = corpus_pipeline.run(spark, SMALL)
    (mine,) = set(glob.glob(f"{root}/pipeline-*")) - before
    assert [p.split("-")[0] for p in os.listdir(mine)] == ["stage4"]
    assert out.count() == corpus_pipeline.run(spark, SMALL).count() > 0
