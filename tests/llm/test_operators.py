"""The operators on small fixtures: brute force, round trips, and defined results for odd rows."""

import hashlib
import json
import os
import re
import time
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from glowtrace.llm import chat, embedding_join, exact_dedup, fixity, html_extract, langid, minhash, mixing, packing, tokens

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def docs(spark, rows):
    """Rows (doc_id, text[, source[, lang]]) with columns whose names the operators also use."""
    full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "a", None) for r in rows]
    extra = [F.lit(7).alias(c) for c in ("size", "grp", "digit", "x", "band", "target", "slot", "block", "score", "bytes", "sha", "chars", "rank", "cluster", "component_id")]
    return spark.createDataFrame(full, DOCS).select("*", *extra)


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (5, "one two three four five six seven"), (None, "one"), (6, "x" * 200_000), (7, "word " * 30_000), (8, "One  TWO three four five six seven", None)]


def test_odd_rows_and_empty_tables(spark):
    odd, none = docs(spark, ODD), docs(spark, [])
    runs = {
        "pack": packing.pack, "identify": langid.identify, "mix": mixing.taken_words, "exact": exact_dedup.radix_groups,
        "tokens": tokens.document_tokens, "near": minhash.near_duplicates, "mixed": mixing.mixed_documents, "bins": packing.packed_bins,
        "keep": langid.keep_identified, "drop": exact_dedup.drop_exact_duplicates, "first": minhash.drop_near_duplicates,
    }
    n = {k: len(f(odd).collect()) for k, f in runs.items()}
    assert {k: len(f(none).collect()) for k, f in runs.items()} == dict.fromkeys(runs, 0)
    assert n["identify"] == n["exact"] == n["tokens"] == n["near"] == n["mix"] == len(ODD)


def test_odd_turns_pages_and_vectors_with_other_columns(spark):
    """Columns that the operators use inside, and tables without rows."""
    extra = [F.lit(7).alias(c) for c in ("turns", "window", "sums", "head", "part", "text_", "file", "offset", "digest", "record", "place", "id", "dim", "vec", "cell", "tile", "own", "n", "root", "size", "_glow_row")]
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (None, None, None, None)], "conv_id long, turn long, role string, text string").select("*", *extra)
    pages = spark.createDataFrame([(1, "u", "<p>a"), (1, "u", "<p>a"), (None, None, None)], "page_id long, url string, html string").select("*", *extra)
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, None)], "vec_id long, embedding array<double>").select("*", *extra)
    audit = lambda p: fixity.audit(fixity.leaves(fixity.warc_records(p)), fixity.leaves(fixity.damaged(fixity.warc_records(p))))
    runs = {"chat": lambda t: chat.read_back(chat.windows(t)), "pages": html_extract.page_texts, "vectors": embedding_join.similar_vectors, "audit": audit}
    tables = {"chat": turns, "pages": pages, "vectors": vectors, "audit": pages}
    assert {k: f(tables[k]).count() for k, f in runs.items()} == {"chat": 2, "pages": 3, "vectors": 3, "audit": 0}
    assert {k: f(tables[k].limit(0)).count() for k, f in runs.items()} == dict.fromkeys(runs, 0)


# Exact copies


def test_radix_groups(spark):
    long = "a" * 3000
    rows = [(1, "ab c"), (2, "a bc "), (3, "abc"), (4, "abd"), (5, None), (6, " \n"), (7, long + "x"), (8, long + "y"), (9, long + " x"), (10, long), (11, "ab"), (12, long + long)]
    got = {r["doc_id"]: r for r in exact_dedup.radix_groups(docs(spark, rows), first_digit=2, growth=3).collect()}
    assert {k: (r["keep_id"], r["group_size"], r["kept"]) for k, r in got.items()} == {
        1: (2, 3, False), 2: (2, 3, True), 3: (2, 3, False), 4: (4, 1, True), 5: (6, 2, False), 6: (6, 2, True),
        7: (9, 2, False), 8: (8, 1, True), 9: (9, 2, True), 10: (10, 1, True), 11: (11, 1, True), 12: (12, 1, True),
    }
    assert got[1]["text_sha256"] == hashlib.sha256(b"abc").hexdigest()


def test_digits_cut_inside_characters(spark):
    rows = [(1, "é" * 9 + "è"), (2, "é" * 9 + "ê"), (3, "é" * 9 + " è")]
    got = {r["doc_id"]: r["keep_id"] for r in exact_dedup.radix_groups(docs(spark, rows), first_digit=3, growth=2).collect()}
    assert got == {1: 3, 2: 2, 3: 3}


# Near copies


def components(sets, ids):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, s in enumerate(sets):
        for b in range(a):
            both = len(s & sets[b])
            if both and 100 * both >= 75 * len(s | sets[b]):
                p, q = find(ids[a]), find(ids[b])
                up[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates_of_the_small_table(spark, small):
    rows = small.select("doc_id", "text").collect()
    ids, sets = [r["doc_id"] for r in rows], [shingles(r["text"]) for r in rows]
    got = {r["doc_id"]: r for r in minhash.near_duplicates(small).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == components(sets, ids)
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in zip(ids, sets, strict=True)}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())


def test_chains_of_edits_in_one_band(spark):
    """A large group whose members are linked to some, not all: every link that joins components is found."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for p in rng.choice(120, rng.integers(0, 5), replace=False):
            words[p] = f"e{i}_{p}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, " ".join(f"u{i}_{k}" for k in range(30))) for i in range(20)]
    rows += [(300 + i, rows[i][1].upper()) for i in range(5)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs(spark, rows)).collect()}
    assert got == components([shingles(t) for _, t in rows], [i for i, _ in rows])


def test_circulant_signature_estimates_similarity():
    a, b = np.arange(1, 901, dtype=np.uint64), np.arange(301, 1201, dtype=np.uint64)
    mix = lambda s: np.unique((s * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20))
    same = (minhash.signature(mix(a), 1024) == minhash.signature(mix(b), 1024)).mean()
    assert abs(same - 0.5) < 0.06
    first, shifted = minhash.permutations(16)
    assert (np.sort(first) == np.arange(minhash.DOMAIN)).all() and shifted[5, 3] == shifted[8, 0]


# Embeddings


def test_embeddings_by_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 8))
    x = np.concatenate([centres[rng.integers(0, 12, 300)] + rng.normal(size=(300, 8)) * 0.15, rng.normal(size=(60, 8))])
    x[10], x[11] = x[12], x[12] * 3
    for name, v in {"CORE_VALUES": 16 * 8, "TILE_VALUES": 50 * 8, "BLOCK": 8}.items():
        monkeypatch.setattr(embedding_join, name, v)
    odd = [(1000, None), (1001, []), (1002, [0.0] * 8), (1003, [None] + [1.0] * 7), (1004, [float("nan")] + [1.0] * 7), (1005, [float("inf")] * 8), (1006, [1.0, 2.0])]
    # Rows that repeat an id, or have none, are vectors of their own; so is one of another length.
    ids = [*range(len(x)), 5, 5, None, None, 2000]
    x = np.concatenate([x, x[[5, 40, 7]], -x[:1], x[3:4] * 2])
    rows = [(i, v.tolist()) for i, v in zip(ids, x, strict=True)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").select("*", *[F.lit(1).alias(c) for c in ("id", "dim", "vec", "cell", "n", "root")])
    got = embedding_join.similar_vectors(frame).collect()
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    label = np.array([10**6 if i is None else i for i in ids])
    for _ in range(len(x)):
        label = np.minimum(label, np.where(linked, label[None], 10**6).min(1))
    named = [None if c == 10**6 else int(c) for c in label]
    want = [(i, int(n), c, i == c) for i, n, c in zip(ids, linked.sum(1), named, strict=True)] + [(i, 0, i, True) for i, _ in odd]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    single = spark.createDataFrame([(i, [float(f) for f in v.astype(np.float32)]) for i, v in enumerate(x[:300])], "vec_id long, embedding array<float>")
    near = x[:300].astype(np.float32).astype(float)
    near /= np.linalg.norm(near, axis=1)[:, None]
    linked = near @ near.T >= 0.95
    assert {r["vec_id"]: r["n_links"] for r in embedding_join.similar_vectors(single).collect()} == dict(enumerate((linked.sum(1) - 1).tolist()))


def test_cells_hold_all_in_reach():
    rng = np.random.default_rng(7)
    unit = rng.normal(size=(400, 5))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    own, reach = embedding_join.cells_of(unit, embedding_join._pivots(unit, 12), 0.4)
    near = np.linalg.norm(unit[:, None] - unit[None], axis=2) <= 0.4
    assert all(reach[j, own[i]] for i, j in np.argwhere(near))
    assert reach.mean() < 0.9


# Packing


def test_bins_keep_their_constraints(spark, small):
    rows = pd.DataFrame([r.asDict() for r in packing.pack(small, capacity=300, shard_words=20_000).collect()])
    words = small.select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("n")).toPandas().set_index("doc_id")["n"]
    assert (rows.groupby("doc_id")["words"].sum() == words[words > 0]).all()
    bins = rows.groupby(["shard", "bin"])
    assert bins["words"].sum().max() <= 300 and rows["shard"].nunique() > 1
    assert rows.groupby(["shard", "bin", "source"]).size().max() <= packing.PER_SOURCE
    assert rows.groupby(["shard", "bin", "cluster"]).size().max() == 1
    for _, b in bins:
        b = b.sort_values("offset")
        assert (b["offset"].to_numpy() == np.concatenate([[0], b["words"].cumsum()[:-1]])).all()
    assert bins["words"].sum().mean() > 0.8 * 300


def best_fit(pieces, capacity, per_source):
    """Every bin is tried for every piece; of the tightest, the one that has been so longest."""
    bins, placed, made = [], [], 0
    for words, source, *conflicts in pieces:
        fits = [b for b in bins if b["free"] >= words and not b["held"] & set(conflicts) and b["sources"].count(source) < per_source]
        b = min(fits, key=lambda b: b["free"], default=None)
        if b is None:
            bins.append(b := {"free": capacity, "held": set(), "sources": [], "number": made})
            made += 1
        placed.append((b["number"], capacity - b["free"]))
        b["free"] -= words
        b["held"] |= set(conflicts)
        b["sources"].append(source)
        bins.remove(b)
        bins.append(b)
    return placed


@pytest.mark.parametrize("hot", [0.0, 0.4])
def test_tightest_compatible_bin(hot):
    rng = np.random.default_rng(8)
    n = 600
    cluster = np.where(rng.random(n) < hot, "hot", rng.choice([f"c{i}" for i in range(300)], n))
    p = pd.DataFrame({"doc_id": rng.integers(0, 400, n), "piece": 0, "copy": 1, "words": rng.integers(1, 60, n), "source": rng.choice(list("abcde"), n, p=[0.4, 0.3, 0.1, 0.1, 0.1]), "cluster": cluster})
    out = packing.pack_shard(p, 100, 2)
    want = best_fit([(w, s, f"d{d}", c) for w, s, d, c in zip(out["words"], out["source"], out["doc_id"], out["cluster"], strict=True)], 100, 2)
    assert list(zip(out["bin"], out["offset"], strict=True)) == want


def test_search_is_not_quadratic():
    """Pieces of one source and one cluster fill two bins each or one: no search may walk over all the others."""
    n = 200_000
    p = pd.DataFrame({"doc_id": range(n), "piece": 0, "copy": 1, "words": 5, "source": "a", "cluster": [str(i) for i in range(n)]})
    began = time.perf_counter()
    assert packing.pack_shard(p, 2048, 2)["bin"].nunique() == n // 2
    assert packing.pack_shard(p.iloc[:50_000].assign(cluster="one"), 2048, 2)["bin"].nunique() == 50_000
    assert time.perf_counter() - began < 30


def test_no_bin_holds_a_document_twice(spark):
    rows = docs(spark, [(1, "w " * 40), (1, "w " * 25), (1, "v " * 25), (2, "u " * 30, "b"), (None, "x " * 5, "c"), (None, "y " * 5, "d")])
    bins = packing.packed_bins(rows).collect()
    assert sum(b["words"] for b in bins) == 130
    assert sorted(sum(i == 1 for i in b["doc_ids"]) for b in bins) == [1, 1, 1]


# Languages


def test_held_out_accuracy(spark, small):
    got = langid.identify(small).join(small.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.98 and got["score"].between(0, 1).all()
    assert held["doc_id"].map(lambda i: __import__("zlib").crc32(str(i).encode()) % 3 == 1).all()


def plain_letters(text):
    """Letters and their marks, character by character."""
    kept = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in (text or "").lower())
    words = kept.split(" ")
    return f" {' '.join(w for w in words if w)} " if any(unicodedata.category(c)[0] == "L" for c in kept) else ""


def plain_profile(texts, size):
    grams = Counter(g for t in texts for n in (1, 2, 3) for k in [plain_letters(t)] for i in range(len(k) - n + 1) if (g := k[i : i + n]) != " ")
    return sorted(grams, key=lambda g: (-grams[g], len(g), g))[:size]


def test_out_of_place_distance_by_brute_force(spark, small):
    rows = small.select("doc_id", "text", "lang").collect()
    learnt = [r for r in rows if r["lang"] and __import__("zlib").crc32(str(r["doc_id"]).encode()) % 3 != 1]
    size = langid.PROFILE
    profiles = {lang: plain_profile([r["text"] for r in learnt if r["lang"] == lang], size) for lang in sorted({r["lang"] for r in learnt})}
    ranks = {lang: {g: i for i, g in enumerate(p)} for lang, p in profiles.items()}
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(small).collect()}
    for r in rows[:120]:
        own = plain_profile([r["text"]], size)
        places = {lang: sum(min(abs(of[g] - i), size) if g in of else size for i, g in enumerate(own)) for lang, of in ranks.items()}
        best = min(places, key=places.get)
        assert got[r["doc_id"]] == ((best, pytest.approx(1 - places[best] / (size * len(own)))) if own else ("und", 0.0))


def test_letters_are_unicode_s():
    assert [langid.letters(t) for t in (None, "", "½", "²", "① Ⅷ 12", "_ - \u0301")] == [""] * 6
    assert langid.letters("Cafe\u0301 DÉJÀ-vu, 3x हिन्दी") == " cafe\u0301 déjà vu x हिन्दी "
    assert all(langid.letters(t) == plain_letters(t) for t in ("a\u00bd b", "\u0661\u0628", "ǅ x_y", "漢字 かな"))


def test_languages_that_were_not_learnt_are_rejected(spark, small):
    rng = np.random.default_rng(4)
    noise = [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 10))) for _ in range(n)) for n in (60, 300)]
    polish = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. "
    hexes = " ".join(hashlib.sha256(bytes([i])).hexdigest() for i in range(20))
    base = small.select("doc_id", "text", "lang", "source", "n_chars")
    odd = spark.createDataFrame([(10_000 + i, t, None, "a", None) for i, t in enumerate([*noise, polish, hexes, None, "½ ²"])], DOCS)
    kept = {r["doc_id"] for r in langid.keep_identified(base.unionByName(odd)).collect()}
    assert kept == {r["doc_id"] for r in base.collect()}


def test_rejected_documents(spark):
    rows = [(i, "the cat sat on the mat and the dog ran") for i in range(6)] + [(10, "12 34 !"), (11, None), (12, "漢字仮名交じり文", "a", None), (13, "the dog")]
    d = docs(spark, rows)
    pred = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(d).collect()}
    assert pred[10] == pred[11] == ("und", 0.0) and pred[13][0] == "en"
    assert sorted(r["doc_id"] for r in langid.keep_identified(d).collect()) == [0, 1, 2, 3, 4, 5, 13]


# Mixing


def test_mix_meets_its_targets(spark, small):
    got = mixing.taken_words(small).toPandas()
    by = got.join(small.select("doc_id", "source").toPandas().set_index("doc_id"), "doc_id").groupby("source")
    assert (by["taken"].sum() - by["target"].first()).abs().max() <= 0.5
    assert (got["taken"] <= 3 * got["size"]).all() and np.isclose(by["target"].first().sum(), got["size"].sum())
    again = mixing.taken_words(small.repartition(7)).toPandas()
    assert sorted(map(tuple, got.to_numpy())) == sorted(map(tuple, again.to_numpy()))


def test_targets_are_refilled(spark):
    sizes = [("a", 1000), ("b", 10), ("c", 500), (None, 40)]
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    weights, caps, total = {"a": 1, "b": 2, "c": 3, None: 1}, {s: 3 * n for s, n in sizes}, 1550
    want, open_ = {}, dict(weights)
    left = total
    while True:
        level = left / sum(open_.values())
        full = [s for s in open_ if level * open_[s] > caps[s]]
        if not full:
            break
        for s in full:
            want[s] = caps[s]
            left -= caps[s]
            del open_[s]
    want |= {s: level * w for s, w in open_.items()}
    assert got == pytest.approx(want)


def test_schedule_spreads_sources(spark):
    rows = [(i, "w " * 50, "ab"[i % 2]) for i in range(200)]
    got = mixing.mix(docs(spark, rows), slots=100).select("slot", "source", "block").distinct().orderBy("slot").toPandas()
    half = got[got["slot"] < 50]["source"].value_counts(normalize=True)
    assert abs(half["b"] - 2 / 3) < 0.06 and got["slot"].is_unique
    assert (got[got["source"] == "a"]["block"].to_numpy() == np.arange((got["source"] == "a").sum())).all()


def test_slots_decide_what_is_taken(spark):
    """Source by source, blocks lie in the slots whose golden-ratio points it gets; the few beyond them come last, and the last
    block is cut to the target."""
    rows = docs(spark, [(i, "w " * (20 + i % 30), "abc"[i % 3]) for i in range(300)])
    sizes = {s: sum(20 + i % 30 for i in range(300) if "abc"[i % 3] == s) for s in "abc"}
    total = sum(sizes.values())
    for slots in (7, 64, 1000):
        block, n = mixing.block_words(total, slots)
        points = [i * mixing.GOLDEN % (1 << 32) / (1 << 32) for i in range(n)]
        high = {"a": 1 / 6, "b": 1 / 2, "c": 1.0}
        drawn = {s: [] for s in "abc"}
        for i, p in enumerate(points):
            drawn[next(s for s in "abc" if p < high[s])].append(i)
        got = mixing.mix(rows, slots=slots).groupBy("source", "block", "slot").agg(F.sum("n_words").alias("n")).toPandas()
        for s, part in got.groupby("source"):
            target = round(total * {"a": 1, "b": 2, "c": 3}[s] / 6)
            assert part["n"].sum() == target
            blocks = -(-target // block)
            assert dict(zip(part["block"], part["slot"], strict=True)) == {k: drawn[s][k] if k < len(drawn[s]) else n + k for k in range(blocks)}
            assert len(part) == blocks and abs(blocks - len(drawn[s])) <= 3
    assert mixing.block_words(10**9) == (256, 3_906_250) and mixing.block_words(100) == (1, 100)


def test_small_sources_meet_their_targets(spark, monkeypatch):
    """A source of about a block, and one of less, among large ones."""
    monkeypatch.setattr(mixing, "LEAST_SLOTS", 1)
    rows = docs(spark, [(i, "w " * 1000, f"s{i % 6}") for i in range(240)] + [(500, "v " * 120, "tiny"), (501, "u " * 3, "less"), (502, "t", "word")])
    got = mixing.taken_words(rows).join(rows.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("t"))
    assert {r["source"]: r["n"] - r["t"] for r in got.collect() if abs(r["n"] - r["t"]) > 0.5} == {}


def test_rows_without_an_id_are_spread(spark):
    rows = docs(spark, [(None, f"text number {i}") for i in range(500)] + [(7, f"other number {i}") for i in range(500)])
    keys = rows.select(mixing.shuffle_key(F.col("doc_id"), F.col("text")).alias("k"))
    assert keys.distinct().count() == 1000


def test_slots_are_ranked_in_chunks(spark, monkeypatch):
    rows = docs(spark, [(i, "w " * 50, "ab"[i % 2]) for i in range(200)])
    want = sorted(map(str, mixing.mix(rows, slots=500).collect()))
    monkeypatch.setattr(mixing, "CHUNK", 16)
    assert sorted(map(str, mixing.mix(rows, slots=500).collect())) == want


def test_mixed_documents_come_in_the_order_of_slots(spark):
    rows = docs(spark, [(i, f"{i}\n\tw  " * 25, "ab"[i % 2]) for i in range(40)])
    got = mixing.mixed_documents(rows).collect()
    texts = {i: f"{i}\n\tw  " * 25 for i in range(40)}
    assert all(texts[r["doc_id"]].startswith(r["text"]) for r in got)
    share = np.mean([r["source"] == "b" for r in got[: len(got) // 2]])
    assert abs(share - np.mean([r["source"] == "b" for r in got])) < 0.15
    # In one partition, the first of each document come as the slots of the schedule do.
    one = rows.coalesce(1)
    first = mixing.mix(one).groupBy("doc_id", "epoch").agg(F.min("slot").alias("slot")).orderBy("slot").collect()
    assert [r["doc_id"] for r in mixing.mixed_documents(one).collect()] == [r["doc_id"] for r in first]


def test_mixed_documents_are_what_was_taken(spark, small):
    taken = {r["doc_id"]: r["taken"] for r in mixing.taken_words(small).collect()}
    words = {}
    for r in mixing.mixed_documents(small).collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    assert words == {i: n for i, n in taken.items() if n}


# Tokens


def test_token_counts_are_the_library_s(spark, small):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokens.vocabulary_path())
    hard = ["Don't we'll 3.14 x<|endoftext|>y", "a\x1cb c\x85d e f", "½ ² İstanbul ΣΑΣ naïve café 日本語 😀", "it's'll ''s !!?? 12a", "<|EndOfText|><|startoftext|>", "_ __ foo_bar", "​﻿", ""]
    d = docs(spark, list(enumerate(hard))).select("doc_id", "text").unionByName(small.select((F.col("doc_id") + 100).alias("doc_id"), "text"))
    for r in tokens.document_tokens(d).join(d, "doc_id").collect():
        assert r["n_tokens"] == len(lib.encode(r["text"], add_special_tokens=False).ids), r["text"][:80]
        assert r["n_bytes"] == len(r["text"].encode()) and r["over_limit"] == (r["n_tokens"] > 2048)


def test_other_vocabularies_are_refused(tmp_path):
    file = json.load(open(tokens.vocabulary_path(), encoding="utf-8"))
    file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"\p{L}+"
    (tmp_path / "other.json").write_text(json.dumps(file))
    for name in (str(tmp_path / "other.json"), tokens.vocabulary_path("byte_bpe_50k.json")):
        with pytest.raises(ValueError):
            tokens.prove_whole_tokens(name)


def test_whole_tokens_are_proven():
    whole = tokens.prove_whole_tokens(tokens.vocabulary_path())
    vocab = json.load(open(tokens.vocabulary_path(), encoding="utf-8"))["model"]["vocab"]
    assert "the" in whole and all(f"{w}</w>" in vocab for w in whole) and len(whole) > 30_000


# Chat


def test_windows_fit_and_texts_come_back(spark):
    said = [(1, t, r, x) for t, (r, x) in enumerate([("system", "be <|kind|> & [INST]"), *[(("user", "assistant")[i % 2], f"turn {i} " * (i % 7 + 1) + "</s><&|") for i in range(12)]])]
    said += [(2, 0, None, None), (3, 1, "assistant", "b" * 10), (3, 0, "a|b<&", "x"), (None, 0, "user", "n"), (4, 0, "assistant", "w " * 900)]
    turns = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    win = chat.windows(turns, budget=60, history=20)
    rows = win.collect()
    assert max(r["n_tokens"] for r in rows if r["conv_id"] == 1) <= 60 and sum(r["conv_id"] == 1 for r in rows) > 2
    assert all(r["formatted"].startswith("<|system|>be <&|kind|> & [&INST]</s>") for r in rows if r["conv_id"] == 1)
    got = {r["conv_id"]: r for r in chat.read_back(win).collect()}
    by = {}
    for c, t, role, text in sorted(said, key=lambda s: (str(s[0]), s[1])):
        by.setdefault(c, []).append((role or "", text or ""))
    for c, ts in by.items():
        loss = "".join(x for r, x in ts if r == "assistant")
        assert got[c]["n_turns"] == len(ts) and got[c]["loss_chars"] == len(loss)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in ts).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.read_back(chat.windows(turns.limit(0))).count() == 0


# Pages


def template(page):
    body = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1|br)[^>]*>", re.sub(r"</?b>", "", body))
    clean = (re.sub(r"[\x20\x09-\x0D]+", " ", __import__("html").unescape(re.sub(r"<[^>]*>", "", p))).strip(" ") for p in parts)
    return "\n".join(p for p in clean if p)


def test_articles_of_the_small_table(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    for r in html_extract.page_texts(pages).join(pages.select("page_id", "html"), "page_id").collect():
        assert r["text"] == template(r["html"]) and r["n_chars"] == len(r["text"])


def test_other_page_shapes(spark):
    page = """<body class="home"><header><h1>Site</h1><p>Tag, line.</p></header><div id="cookieNotice"><p>We use cookies, ok?</p></div>
      <div><h1>Title</h1><div class="content"><p>First, with text. And more, indeed.<p>Short.<ul><li>One, item.<li>Two</ul><p title="a>b">Last &amp; x &lt; y<br>line</div>
      <div class="user-comments"><p>Nice, thanks, a lot. Really.</p></div><aside>side</aside></div><form><p>Subscribe, now.</p></form>
      <script>var a = "<p>no</p>";</script><div style="display: none">hidden, text.</div><footer>foot</footer>"""
    assert html_extract.main_text(page) == "Title\nFirst, with text. And more, indeed.\nShort.\nOne, item.\nTwo\nLast & x < y line"
    assert [html_extract.main_text(p) for p in (None, "", "<p", "<div></div>", "plain")] == ["", "", "", "", "plain"]
    assert html_extract.main_text("<div>" * 3000 + "deep, text." + "</div>" * 3000) == "deep, text."
    rows = spark.createDataFrame([(1, None, None), (None, "u", "<p>a"), (1, None, None)], "page_id long, url string, html string")
    assert sorted((r["text"], r["n_chars"]) for r in html_extract.page_texts(rows).collect()) == [("", 0), ("", 0), ("a", 1)]


def test_all_content_paths_are_returned(spark):
    said = lambda n, k: " ".join(f"part {k}, word {i}." for i in range(n))
    intro, rest = said(6, "a"), [said(8, f"b{k}") for k in range(4)]
    split = f"<div><section><p>{said(60, 'a')}</p></section><section><p>{said(20, 'b')}</p></section></div>"
    pages = {
        f"<div><p>{intro}</p><blockquote>{said(30, 'b')}</blockquote></div>": [intro, said(30, "b")],
        f"<div><p>{intro}</p><ul>{''.join(f'<li>{r}' for r in rest)}</ul></div>": [intro, *rest],
        f"<div><p>{intro}</p><table><tr><td>{said(30, 'b')}</table></div>": [intro, said(30, "b")],
        split: [said(60, "a"), said(20, "b")],
        f"<table><tr><td>Home<td><p>{said(60, 'a')}<p>{said(20, 'b')}</table>": [said(60, "a"), said(20, "b")],
        f"<p>Menu</p><article>{split}</article><p>Imprint</p>": [said(60, "a"), said(20, "b")],
    }
    assert [html_extract.main_text(p).split("\n") for p in pages] == list(pages.values())


def test_marks_inside_a_line_and_wrappers(spark):
    """What a page says is no article stays out inside paragraphs too; names of wrappers don't hide the article."""
    p = " ".join(f"part {i}, word {i}." for i in range(40))
    pages = {
        f"<article><p>{p}</p><button>Share this</button><p>{p}</p></article>": f"{p}\n{p}",
        f"<article><p>{p}</p><label>E-mail</label><p>{p}</p><menu><li>Home</menu><dialog>Hi, there.</dialog></article>": f"{p}\n{p}",
        f"<article><p>{p} <span class='advert'>BUY NOW</span> end.</p></article>": f"{p} end.",
        f"<article><p>{p} <span style='display:none'>hid</span> end.</p></article>": f"{p} end.",
        f"<div class='page with-sidebar'><article><p>{p}</p></article></div>": p,
        f"<div class='layout share-nothing'><article><p>{p}</p></article></div>": p,
        f"<div><div>Home</div><h2>Head</h2><p>{p}</p><p>{p}</p><ul><li>a<li>b</ul><div>Imprint</div></div>": f"Head\n{p}\n{p}\na\nb",
        f"<div><p>{p}</p><div>x</div><p>{p}</p></div>": f"{p}\nx\n{p}",
    }
    rows = spark.createDataFrame([(i, "u", h, t) for i, (h, t) in enumerate(pages.items())], "page_id long, url string, html string, want string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.page_texts(rows).collect()}
    assert got == {i: (t, len(t)) for i, t in enumerate(pages.values())}


def test_names_do_not_hide_the_article(spark):
    said = lambda n, k: " ".join(f"part {k}, word {i}." for i in range(n))
    long, more = said(60, "a"), said(20, "b")
    whole = f"<article><p>{long}</p><p>{more}</p></article>"
    pages = [
        f"<div class='layout with-sidebar'>{whole}<div class='sidebar'><p>{said(9, 'x')}</p></div></div>",
        f"<div class='content no-comments'>{whole}</div>",
        f"<section id='related-work'><p>{long}</p><p>{more}</p></section>",
        f"<div class='comments'><p>{long}</p><p>{more}</p></div>",
        f"<div><p title='the hidden gem'>{long}</p><div data-state='hidden'><p data-hidden=false>{more}</p></div></div>",
        f"<div><section data-id='nav-3'><p>{long}</p></section><p data-x='a' title=\"role='menu' class=ad\">{more}</p></div>",
        f"<form id=aspnet><div><p>{long}</p><p>{more}</p></div><p hidden>{said(80, 'x')}</p></form>",
        f"{whole}<ol class=comments><li><article><p>{said(30, 'x')}</p></article></ol>",
        f"<div><p>{long}</p><p>{more}</p><div class=promo><p>{said(9, 'x')}</p></div><p hidden>{said(9, 'x')}</p></div>",
    ]
    assert [html_extract.main_text(p) for p in pages] == [f"{long}\n{more}"] * len(pages)


def test_paths_select_inside_articles(monkeypatch):
    """Menus and notices without a telling name go by the ratios of their paths, in a marked article as elsewhere."""
    said = lambda n, k: " ".join(f"part {k}, word {i}." for i in range(n))
    long, more = said(60, "a"), said(20, "b")
    whole = f"<h1>Head</h1><p>{long}</p><div>2 figures</div><p>{more}</p>"
    edges = "<div><div>Home</div><div>News today</div></div>", "<div><div>Read on in our app</div><div>Imprint</div><div>Top</div></div>"
    pages = [f"<{tag}>{edges[0]}{whole}{edges[1]}</{tag}>" for tag in ("article", "main", "div")]
    want = f"Head\n{long}\n2 figures\n{more}"
    assert [html_extract.main_text(p) for p in pages] == [want] * 3
    monkeypatch.setattr(html_extract, "content_paths", lambda candidates: {n.path for n, _ in candidates})
    assert all("Home" in html_extract.main_text(p) and "Imprint" in html_extract.main_text(p) for p in pages)


def test_names_with_two_meanings():
    said = " ".join(f"part {i}, word {i}." for i in range(60))
    kept = {
        '<section id="related-work"><h2>Related work</h2><p>Smith did it, earlier.</p></section>': "\nRelated work\nSmith did it, earlier.",
        '<div class="social-sciences"><p>They count, too.</p></div>': "\nThey count, too.",
        '<div class="related-posts"><p>Ten tricks, really.</p></div>': "", '<div class="related"><p>Ten tricks, really.</p></div>': "", '<div class="shareButtons"><p>Send it, now.</p></div>': "",
        '<div class="socialMedia share"><p>Follow us, please.</p></div>': "", "<fieldset><p>Pick one, or two.</p></fieldset>": "",
    }
    for part, text in kept.items():
        assert html_extract.main_text(f"<article><p>{said}</p>{part}<p>{said}</p></article>") == f"{said}{text}\n{said}", part


# Archives


def test_audit_finds_the_damage_only(spark):
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>{i}</p>" * (i % 50 + 1)) for i in range(2500)] + [(None, None, None)], "page_id long, url string, html string")
    records = fixity.warc_records(pages)
    ours, theirs = fixity.leaves(records), fixity.leaves(fixity.damaged(records))
    assert fixity.audit(ours, ours).count() == 0
    got = {r["page_id"]: r["state"] for r in fixity.audit(ours, theirs).collect()}
    want = {i: "changed" for i in range(2500) if i % 97 == 13 or i % 103 == 29} | {i: "missing" for i in range(2500) if i % 101 == 17}
    assert got == want
    back = {r["page_id"]: r["state"] for r in fixity.audit(theirs, ours).collect()}
    assert back == {i: s.replace("missing", "extra") for i, s in want.items()}
    assert fixity.audit(ours.limit(0), ours.limit(0)).count() == 0


def test_records_tile_their_files(spark):
    records = fixity.warc_records(spark.read.parquet(f"{SMALL}/pages.parquet"))
    for file, group in fixity.leaves(records).toPandas().groupby("file"):
        group = group.sort_values("offset")
        assert (group["offset"].to_numpy() == np.concatenate([[0], group["length"].cumsum()[:-1]])).all(), file
    head, body = records.orderBy("page_id").first()["record"].split("\r\n\r\n", 1)
    assert f"Content-Length: {len(body.encode()) - 4}" in head


@pytest.mark.parametrize("digits", [1, 3])
def test_records_of_repeated_ids_tile_their_files(spark, monkeypatch, digits):
    monkeypatch.setattr(fixity, "PART_DIGITS", digits)
    rows = [(None, f"u{i}", f"<p>{i % 40}</p>" * (i % 7)) for i in range(300)] + [(None, "same", "copy")] * 200 + [(5, "u", "x" * i) for i in range(50)] + [(5, None, None)] * 3 + [(1005, "v", "y")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    records = fixity.warc_records(pages)
    ours = fixity.leaves(records)
    plain, files = [], {}
    for r in sorted(records.collect(), key=lambda r: (r["page_id"], r["place"])):
        at = files.get(r["file"], 0)
        files[r["file"]] = at + r["stored"]
        plain.append((r["file"], at, r["stored"], r["page_id"], r["place"]))
    assert sorted(map(tuple, ours.collect())) == sorted(plain) and len(plain) == len(rows)
    gone = records.withColumn("record", F.when(F.col("page_id") != 5, F.col("record")))
    got = fixity.audit(ours, fixity.leaves(gone)).collect()
    assert [(r["page_id"], r["state"]) for r in got] == [(5, "missing")] * 53
    assert sorted(r["offset"] for r in got) == sorted(at for _, at, _, i, _ in plain if i == 5)


# Large groups, without broadcasts


def test_groups_are_salted_where_they_are_too_many_to_broadcast(spark, small, monkeypatch):
    from glowtrace.llm import common

    want = [sorted(map(tuple, f(small).collect())) for f in (exact_dedup.radix_groups, minhash.near_duplicates)]
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    for module in (common, minhash):
        monkeypatch.setattr(module, "SALTED", 2)
    assert [sorted(map(tuple, f(small).collect())) for f in (exact_dedup.radix_groups, minhash.near_duplicates)] == want


@pytest.mark.parametrize("bound", [-1, 100, 700, 3000, 1 << 20])
def test_lists_of_hot_keys_stay_below_the_bound(spark, monkeypatch, bound):
    """Salts hold however many keys are hot: the list that is broadcast fits, and no task gets many rows of a key."""
    from glowtrace.llm import common

    monkeypatch.setattr(common, "BROADCAST_BYTES", bound)
    monkeypatch.setattr(common, "SALTED", 4)
    scratch = common.Scratch(spark, "hot")
    sizes = {k: 1 + k * k // 20 for k in range(90)}
    rows = spark.createDataFrame([(k, i) for k, n in sizes.items() for i in range(n)] + [(None, -1), (999, -1)], "k long, i long")
    groups = scratch.save(rows.where("k < 90").groupBy("k").agg(F.count("*").alias("size"), F.max("i").alias("top")), "groups")
    hot = common.hot_keys(groups, ["k"])
    listed = {r["k"]: r["_salts"] for r in hot.collect()}
    assert all(listed[k] == -(-sizes[k] // 4) for k in listed)
    if bound > 400:
        assert common.table_bytes(scratch.save(hot, "list")) <= bound and (not listed or min(sizes[k] for k in listed) >= max(n for k, n in sizes.items() if k not in listed)) and len(listed) >= min(10, bound // 60)
    want = sorted(((k, i, sizes[k], sizes[k] - 1) for k, n in sizes.items() for i in range(n)), key=str)
    got = common.join_groups(rows, groups, ["k"], ["i"])
    assert sorted((tuple(r) for r in got.where("size is not null").collect()), key=str) == want and got.count() == len(want) + 2
    spread = common.spread_join(scratch.save(rows, "rows"), groups, "k", "i", scratch).select("k", "i", "size", "top")
    assert sorted(map(tuple, spread.collect()), key=str) == want


@pytest.mark.parametrize("bound", [-1, 0])
def test_lists_of_no_hot_keys(spark, monkeypatch, bound):
    from glowtrace.llm import common

    monkeypatch.setattr(common, "BROADCAST_BYTES", bound)
    scratch = common.Scratch(spark, "hot")
    for groups in ([], [(1, 2)]):  # no keys at all, and none that is hot
        groups = scratch.save(spark.createDataFrame(groups, "k long, size long"), "groups")
        assert common.hot_keys(groups, ["k"]).count() == 0
        assert common.join_groups(groups.select("k"), groups, ["k"], ["k"]).count() == groups.count()


@pytest.mark.parametrize("few", [True, False])
def test_components_of_hubs_chains_and_loops(spark, tmp_path, monkeypatch, few):
    from glowtrace.llm import common, components

    if not few:
        monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
        monkeypatch.setattr(common, "SALTED", 4)
    rng = np.random.default_rng(3)
    links = [(500, i) for i in range(501, 560)] + [(i, i + 1) for i in range(100, 160)] + [(7, 7), (None, 3), (4, None), (800, 801), (801, 800), (800, 801)]
    links += [tuple(map(int, p)) for p in rng.integers(1000, 1080, (40, 2))]
    up = {}

    def find(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for u, v in links:
        if u is not None and v is not None:
            a, b = find(u), find(v)
            up[max(a, b)] = min(a, b)
    got = components.connected_components(spark.createDataFrame(links, "u long, v long"), common.Scratch(spark, "test"))
    assert {r["id"]: r["component"] for r in got.collect() if r["id"] != r["component"]} == {i: find(i) for i in up if find(i) != i}
    assert components.connected_components(spark.createDataFrame([], "u long, v long"), common.Scratch(spark, "test")).count() == 0


def test_both_blocks_of_a_large_band_find_what_one_step_finds(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(80):
        words = list(base)
        for p in rng.choice(100, rng.integers(0, 5), replace=False):
            words[p] = f"e{i}_{p}"
        rows.append((i, " ".join(words)))
    want = components([shingles(t) for _, t in rows], [i for i, _ in rows])
    for few in (minhash.FEW_PAIRS, 0):
        monkeypatch.setattr(minhash, "FEW_PAIRS", few)
        assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs(spark, rows)).collect()} == want


def test_written_tables_leave_no_shuffle_files(spark):
    from glowtrace.llm import common

    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before, set_ = files(), spark.conf.get(common.FILE_CLEANUP, None)
    scratch = common.Scratch(spark, "files")
    sums = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s"))
    written = scratch.save(sums.join(sums.withColumnRenamed("s", "t"), "k"), "sums")
    assert not files() - before and spark.conf.get(common.FILE_CLEANUP, None) == set_
    assert written.count() == 7 and sums.count() == 7
    scratch.clear()
    assert scratch.save(sums, "more").count() == 7


def test_bands_of_two_unlike_documents_are_done_with_their_comparison(spark, monkeypatch):
    """Near duplicates explode no sets for a pair that was compared, and leave only the tables that the result reads."""
    from glowtrace.llm import common

    saved, save = [], common.Scratch.save

    def noted(self, df, tag):
        out = save(self, df, tag)
        saved.append((tag, out._scratch_path))
        return out

    monkeypatch.setattr(common.Scratch, "save", noted)
    rows = [(2 * i + k, " ".join(f"w{i}_{j}" for j in range(35 * k, 200 + 35 * k))) for i in range(20) for k in range(2)]
    got = minhash.near_duplicates(docs(spark, rows))
    tags = {t for t, _ in saved}
    assert "second" in tags and "across" not in tags
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {i: i for i, _ in rows}
    assert {t for t, p in saved if os.path.exists(p.removeprefix("file:"))} == {"rows", "roots"}


def test_rows_of_files_are_numbered_where_they_lie(spark, tmp_path):
    from glowtrace.llm import common

    docs(spark, [(i % 3, f"t{i}") for i in range(40)]).repartition(3).write.parquet(str(tmp_path / "d"))
    files = spark.read.parquet(str(tmp_path / "d"))
    scratch = common.Scratch(spark, "test")
    keyed, key = common.with_stable_keys(files, scratch)
    assert "rows-" not in keyed._jdf.queryExecution().toString()
    pairs = lambda df: sorted((r[key], r["text"]) for r in df.collect())
    want = pairs(keyed)
    assert len({k for k, _ in want}) == 40 and pairs(common.with_stable_keys(files.select("text", "doc_id"), scratch)[0]) == want
    # What isn't all rows of files once is written with its keys.
    for other in (files.where("doc_id = 1"), files.union(files), files.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))), files.join(files.select("doc_id"), "doc_id"), docs(spark, [(1, "a")])):
        rows, _ = common.with_stable_keys(other, scratch)
        assert rows.count() == other.count() == rows.select(key).distinct().count() and pairs(rows) == pairs(rows)
    assert common.with_stable_keys(files.limit(0), scratch)[0].count() == 0


# Columns with the operators' own names


INNER = ("_glow_row", "__glow_row", "_path", "_file", "_index", "_glow_path", "_glow_index", "_glow_file", "_glow_take", "_slot", "_words", "_size", "_row", "_c", "_salt", "_salts", "of", "key", "part", "place", "row", "at", "taken", "leads", "root", "first", "label", "ended", "digit", "bands", "band", "kept", "found", "size", "slot", "epoch", "words", "copy", "shard", "bin", "a.b", "a`c", "_metadata")


@pytest.mark.parametrize("written", [True, False])
def test_extra_columns_change_nothing(spark, small, tmp_path, written):
    """All stages and the operators behind them, with constant columns of every inner name."""
    plain = small.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id < 60").union(spark.createDataFrame([(3, "same words here", "en", "a", 15), (3, "same words here", "en", "a", 15), (None, None, None, None, None)], DOCS))
    full = plain.select("*", *[F.lit(7).alias(c) for c in INNER])
    if written:
        for name, df in (("plain", plain), ("full", full.drop("_metadata"))):
            df.repartition(3).write.parquet(str(tmp_path / name))
        plain, full = (spark.read.parquet(str(tmp_path / n)) for n in ("plain", "full"))
    own = ["doc_id", "text", "lang", "source", "n_chars"]
    for stage in (langid.keep_identified, exact_dedup.drop_exact_duplicates, minhash.drop_near_duplicates, mixing.mixed_documents):
        got = stage(full)
        assert got.columns == full.columns
        # Rows that are equal in all columns may take each other's place in the mix.
        assert sorted(map(str, got.select(own).collect())) == sorted(map(str, stage(plain).select(own).collect())), stage
    for operator in (packing.pack, langid.identify, mixing.taken_words, exact_dedup.radix_groups, tokens.document_tokens, minhash.near_duplicates, packing.packed_bins):
        assert sorted(map(str, operator(full).collect())) == sorted(map(str, operator(plain).collect())), operator


# Rows that repeat an id


def test_rows_that_repeat_an_id_are_decided_one_by_one(spark):
    said = lambda k: " ".join(f"{k}{i}" for i in range(40))
    a, b, c = said("a"), said("b"), said("c")
    near = lambda t: t + " end"
    rows = docs(spark, [(3, a), (5, a), (5, b), (7, c), (7, c)])
    assert sorted((r["doc_id"], r["text"]) for r in exact_dedup.drop_exact_duplicates(rows).collect()) == [(3, a), (5, b), (7, c)]
    rows = docs(spark, [(1, "a b c"), (1, "unique text of row one"), (0, "a  b c"), (2, "same"), (2, "same"), (None, "zz"), (None, "zz"), (None, "yy"), (9, "yy"), (8, None), (8, " ")])
    got = sorted((str(r["doc_id"]), r["text"]) for r in exact_dedup.drop_exact_duplicates(rows).collect())
    assert got == [("0", "a  b c"), ("1", "unique text of row one"), ("2", "same"), ("8", " "), ("9", "yy"), ("None", "zz")]
    # Rows without an id are documents as well.
    rows = docs(spark, [(None, a), (None, near(a)), (4, near(a) + " more"), (None, b), (None, b)])
    assert sorted((str(r["doc_id"]), r["text"]) for r in minhash.drop_near_duplicates(rows).collect()) == [("4", near(a) + " more"), ("None", b)]
    # 5 copies 3, and its other text is near to 9's; 6 has two texts with links of their own.
    rows = docs(spark, [(3, a), (5, near(a)), (5, a), (5, b), (9, near(b)), (7, c), (7, c), (2, said("d")), (6, near(said("d"))), (6, said("e")), (8, near(said("e")))])
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(rows).collect())
    assert got == [(2, 2, True), (3, 3, True), (5, 3, False), (5, 3, False), (5, 5, True), (6, 2, False), (6, 6, True), (7, 7, True), (7, 7, True), (8, 6, False), (9, 5, False)]
    kept = minhash.drop_near_duplicates(rows)
    assert kept.columns == rows.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted([(3, a), (5, b), (7, c), (2, said("d")), (6, said("e"))])


def test_repeated_rows_are_mixed_once_each(spark):
    rows = docs(spark, [(1, "w " * 40)] * 4 + [(2, "v " * 30), (2, "u " * 30), (3, "x " * 100, "b")])
    taken = sum(r["taken"] for r in mixing.taken_words(rows).collect())
    mixed = [len(r["text"].split()) for r in mixing.mixed_documents(rows).collect()]
    assert sum(mixed) == taken and abs(taken - 320) <= 1
