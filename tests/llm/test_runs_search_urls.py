"""Periodic runs, ranked search and URL rules against brute force, and defined results for odd rows."""

import hashlib
import random
import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest
from pyspark.sql import functions as F

from glowtrace.llm import common, runs, search, suffix_tree, url_rules
from glowtrace.llm.queries import op11_periodic_runs, op12_ranked_search

SMALL = "/root/testdata/sf0.001"
CLASHING = ("n", "row", "node", "host", "path", "rule", "own", "terms", "times", "item", "rank", "score", "runs", "words", "a", "p", "g", "size", "tags", "base", "tail", "best", "_glow_row", "_path")


def with_extra(df):
    return df.select("*", *[F.lit(7).alias(c) for c in CLASHING if c not in df.columns])


# Periodic runs


def plain_runs(s, least, repeats):
    out = set()
    for p in range(1, len(s) // repeats + 1):
        i = 0
        while i + p < len(s):
            j = i
            while j + p < len(s) and s[j] == s[j + p]:
                j += 1
            n = j + p - i
            if j > i and n >= max(least, repeats * p) and not any(s[i : i + n - q] == s[i + q : i + n] for q in range(1, p)):
                out.add((i, n, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(rng):
    s = [rng.randint(1, rng.choice([1, 2, 3])) for _ in range(rng.randint(0, 70))]
    if len(s) > 10 and rng.random() < 0.5:
        a = rng.randrange(len(s))
        p = rng.randint(1, max(1, (len(s) - a) // 3))
        s = [s[i] if i < a else s[a + (i - a) % p] for i in range(len(s))]
    return s


def test_runs_by_brute_force():
    rng = random.Random(3)
    for _ in range(800):
        s = some_words(rng)
        for least, repeats in ((2, 2), (6, 2), (9, 3), (24, 3), (20, 5)):
            want = plain_runs(s, least, repeats)
            assert [tuple(r) for r in runs.word_runs([b"%d" % x for x in s], least, repeats).tolist()] == want, (s, least, repeats)
        assert sorted(map(tuple, runs.runs_of(np.array(s, np.int64), 2, 2).tolist())) == sorted(plain_runs(s, 2, 2))


def test_extensions_by_brute_force():
    rng = random.Random(4)
    for _ in range(100):
        s = [rng.randint(1, 3) for _ in range(rng.randint(2, 40))]
        reach = suffix_tree.Extensions(np.array(s))
        i, j = map(np.array, zip(*[(a, b) for a in range(len(s) + 1) for b in range(len(s) + 1) if a != b], strict=True))
        want = [next((k for k in range(len(s)) if a + k >= len(s) or b + k >= len(s) or s[a + k] != s[b + k]), 0) for a, b in zip(i, j, strict=True)]
        assert reach(i, j).tolist() == want


def test_long_runs_and_texts_without_any(spark):
    words = [f"w{i * i % 997}" for i in range(900)]
    rows = [(1, " ".join(words * 4)), (2, " ".join(words)), (3, "a " * 50_000), (4, " ".join(words + ["x"] * 23)), (5, " ".join(words + ["x"] * 24 + words)), (None, None), (6, " \n\t"), (6, "é\u00a0b " * 30), (7, "y" * 300_000)]
    df = with_extra(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r["doc_id"], r["n_words"]): (r["runs"], r["collapsed"]) for r in runs.periodic_runs(df).collect()}
    found = {k: [tuple(r) for r in v[0]] for k, v in got.items()}
    # A sequence of squares has a period of its own, 997, which 900 words don't reach.
    assert found[(1, 3600)] == [(0, 3600, 900)] and got[(1, 3600)][1] == " ".join(words)
    assert found[(2, 900)] == [] and found[(4, 923)] == [] and found[(5, 1824)] == [(900, 24, 1)]
    assert found[(3, 50_000)] == [(0, 50_000, 1)] and got[(3, 50_000)][1] == "a"
    assert found[(None, 0)] == [] and got[(None, 0)][1] == "" and found[(6, 30)] == [(0, 30, 1)] and found[(7, 1)] == []
    assert runs.run_digests(runs.periodic_runs(df.limit(0))).count() == 0
    with pytest.raises(ValueError, match="twice"):
        runs.periodic_runs(df, repeats=1)


def test_the_query_s_digests_by_brute_force(spark):
    import zlib

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    planted = 0
    for r in op11_periodic_runs(spark, SMALL).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", docs[r["doc_id"]] or "")
        n, h = len(words), zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        want = plain_runs(words, 24, 3) if len(words) < 1500 or h % 10 == 0 else None
        if want is None:
            continue
        planted += bool(want)
        gone = {i for s, length, p in want for i in range(s + p, s + length)}
        assert r["n_runs"] == len(want)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{length},{p}\n" for s, length, p in want).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()
        best = max(want, key=lambda v: (v[1] / v[2], -v[0], -v[2]), default=(None,) * 3)
        assert (r["start"], r["length"], r["period"]) == best and r["exponent_milli"] == (1000 * best[1] // best[2] if want else None)
    assert planted > 5


# Ranked search


def plain_search(docs, items, top=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c, c.total()) for d, c in counts if c]
    total = sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, n in counts:
            m = 10 + 90 * n * len(counts) // total
            score = sum(floor(1000 * log((2 * len(counts) + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, k, d, -s) for k, (s, _, _, d) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("postings, groups", [(2_000_000, 1 << 22), (300, 1 << 22), (300, 1500)])
def test_search_by_brute_force(spark, monkeypatch, postings, groups):
    monkeypatch.setattr(search, "BLOCK_POSTINGS", postings)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    more = spark.createDataFrame([(-1, "zebra zebra"), (-1, "zebra Quagga"), (-2, "ÄÖ ä the"), (-3, "zebra" * 10_000), (None, None), (-4, "the THE the of")], "doc_id long, text string")
    docs = with_extra(docs.select("doc_id", "text").union(more).repartition(3))
    odd = spark.createDataFrame([(900, "zebra"), (900, "the quagga"), (901, None), (902, "!? "), (None, "Ä zebra"), (903, "no-such-term-at-all")], "item_id long, text string")
    items = with_extra(items.select("item_id", "text").union(odd))
    want = plain_search([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert found(search.ranked_search(docs, items, group_bytes=groups)) == want
    assert search.ranked_search(docs.limit(0), items).count() == search.ranked_search(docs, items.limit(0)).count() == 0


def test_ties_come_by_id(spark):
    docs = spark.createDataFrame([(i, "same words here" if i is None or i % 2 else "other") for i in [*range(60, 0, -1), None]], "doc_id long, text string").repartition(4)
    items = spark.createDataFrame([(1, "words")], "item_id long, text string")
    assert [r["doc_id"] for r in search.ranked_search(docs, items).orderBy("rank").collect()] == list(range(1, 20, 2))


def test_accumulators_are_limited():
    """A common last term can't lift a document that has no accumulator by then; those that have one get it."""
    rng = np.random.default_rng(0)
    rare, common_ = np.arange(40), np.arange(10_000)
    terms = np.concatenate([np.zeros(40, int), np.ones(10_000, int)])
    doc = np.concatenate([rare, common_])
    order = np.argsort(doc, kind="stable")
    n = np.full(10_000, 50)
    cuts = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=10_000))])
    block = search.Block(n, cuts, terms[order], rng.integers(1, 3, len(doc)).astype(np.int32), np.array([9000, 10]), 10_000, 500_000)
    at, score = block.best(np.array([0, 1]), 10, 0)
    assert 10 <= len(at) <= 40 and set(at) <= set(rare)
    whole = np.zeros(10_000, np.int64)
    np.add.at(whole, block.doc, block.part)
    assert (whole[at] == score).all() and set(np.argsort(-whole, kind="stable")[:10]) <= set(at)
    assert len(block.best(np.array([0, 1]), 10, int(whole.max()) + 1)[0]) == 0


def test_search_of_the_small_table(spark):
    rows = op12_ranked_search(spark, SMALL).collect()
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").count()
    assert len(rows) == len({(r["item_id"], r["rank"]) for r in rows}) <= 10 * items


# URL rules


def test_parts_of_urls(spark):
    urls = ["http://A.Example.ORG/x?y#z", "https://h", "x://h?/q", "no scheme", None, "", "://", "http://h#a/b", "a://b://c/d", "HTTP://ÉA.b/p\nq?x", "http:///p"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = [tuple(r) for r in df.select(url_rules.host_of(F.col("url")), url_rules.path_of(F.col("url"))).collect()]
    assert got == [("a.example.org", "/x"), ("h", ""), ("h", ""), ("", ""), ("", ""), ("", ""), ("", ""), ("h", ""), ("b:", "//c/d"), ("Éa.b", "/p\nq"), ("", "/p")]


def test_links_of_pages(spark):
    pages = [
        ("http://a.b/c/d?e", '<HEAD><LINK REL="Canonical" HREF="../f?g=1&amp;h=2"></HEAD>', ["http://a.b/f?g=1&h=2"]),
        ("http://a.b/c/", "<meta content='0; URL=\"//x.y/z\"' http-equiv=refresh>", ["http://x.y/z"]),
        ("http://a.b", "<link href=/r rel='nofollow canonical'><link rel=stylesheet href=/s><link rel=canonical2 href=/t>", ["http://a.b/r"]),
        ("http://a.b/c", '<!-- <link rel="canonical" href="/no"> --><script>"<link rel=canonical href=/no>"</script><base href="/deep/er/"><link rel=canonical href="./yes">', ["http://a.b/deep/er/yes"]),
        ("http://a.b/c", '<link rel=canonical href="mailto:x"><link rel=canonical href="#top"><link rel=canonical href=""><link rel=canonical>', []),
        ("http://a.b/c/d", '<link rel=canonical href="?q"><link rel="canonical" href="HTTPS://Q.r/s">', ["http://a.b/c/d?q", "HTTPS://Q.r/s"]),
        (None, "<link rel=canonical href=/x>", []),
        ("http://a.b/", None, []),
    ]
    df = spark.createDataFrame([p[:2] for p in pages], "url string, html string")
    assert sorted(r["target"] for r in url_rules.page_links(df).collect()) == sorted(t for p in pages for t in p[2])


def plain_verdicts(pages, rules, links):
    """By scanning rules and growing classes; ``links`` are pairs of urls."""

    def split(u):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?", u or "")
        return (m[1].lower(), m[2], m[3] or "") if m else ("", "", "")

    def key(u):
        host, path, asked = split(u)
        kept = "&".join(p for p in asked[1:].split("&") if not p.startswith("utm_"))
        return (re.sub(":(80|443)$", "", host), re.sub("/$", "", path), kept) if host else None

    def rule(u):
        host, path, _ = split(u)
        fits = [(len(h + p), v == "allow", h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[2:] if fits else (None, None)

    of = {}
    for u in {u for _, u in pages} | {u for pair in links for u in pair}:
        of[key(u)] = key(u)
    grown = True
    while grown:
        grown = False
        for a, b in links:
            low = min(of[key(a)], of[key(b)])
            for k in (key(a), key(b)):
                if of[k] != low:
                    of = {x: low if c == of[k] else c for x, c in of.items()}
                    grown = True
    said = {}
    for u in {u for _, u in pages} | {u for pair in links for u in pair}:
        if key(u):
            said.setdefault(of[key(u)], set()).add(rule(u)[1])
    out = []
    for i, u in pages:
        text, own = rule(u)
        caught = key(u) and said[of[key(u)]] >= {"block"} and "allow" not in said[of[key(u)]]
        out.append((i, *split(u)[:2], text, own or ("block" if caught else "allow"), "rule" if own else "alias" if caught else "default"))
    return sorted(out, key=str)


@pytest.mark.parametrize("few", [True, False])
def test_verdicts_by_brute_force(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
        for module in (common, url_rules):
            monkeypatch.setattr(module, "SALTED", 3)
    rng = random.Random(8)
    host = lambda: rng.choice(["a.example.org", "example.org", "x.net", "y.net", "b.com", "c.b.com", "notexample.org.net", "org"])
    urls = [f"{rng.choice(['http', 'https'])}://{host()}{rng.choice(['/es/', '/en/', '/fr/', '/de/', '/q'])}{rng.randint(1, 25)}{rng.choice(['', '/', '#top', '?utm_source=feed', '?page=2'])}" for _ in range(140)]
    pages = [(i, u) for i, u in enumerate(urls)] + [(5, urls[5]), (None, urls[6]), (1000, None), (1001, "nothing"), (1002, "")] + [(2000 + i, "http://hot.net/p") for i in range(30)]
    links = [(rng.choice(urls), rng.choice(urls)) for _ in range(40)]
    links += [("http://hot.net/p", "https://elsewhere.com/de/9"), (urls[3], "https://only.org/x"), ("http://m.net/1", "http://m.net/2"), ("http://m.net/2", "http://b.com/de/1")]
    pages += [(3000, "http://m.net/1"), (3001, "https://m.net/2/?utm_x=1")]
    named = [(u, v) for u, v in links if rng.random() < 0.5]
    html = {u: "".join(f'<link rel="canonical" href="{v}">' for a, v in links if a == u and (a, v) not in named) for u in {a for a, _ in links}}
    on_pages = {u for _, u in pages}
    named += [(u, v) for u, v in links if (u, v) not in named and u not in on_pages]
    df = with_extra(spark.createDataFrame([(i, u, html.get(u)) for i, u in pages], "page_id long, url string, html string").repartition(4))
    rules = [*url_rules.RULES, ("x.net", "/q1", "block"), ("x.net", "/q1", "allow")]
    redirects = spark.createDataFrame(named, "url string, target string")
    got = url_rules.judged_pages(df, url_rules.rule_table(spark, rules), redirects)
    want = plain_verdicts(pages, rules, [(u, v) for u, v in links])
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert {w[5] for w in want} == {"rule", "alias", "default"} and sum(w[5] == "alias" for w in want) > 30


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c", "<link rel=canonical href=/d>"), (None, None, None)], "page_id long, url string, html string")
    none = url_rules.rule_table(spark).limit(0)
    assert sorted((r["verdict"], r["decided_by"]) for r in url_rules.judged_pages(pages, none).collect()) == [("allow", "default")] * 2
    assert url_rules.judged_pages(pages.limit(0), url_rules.rule_table(spark)).count() == 0
