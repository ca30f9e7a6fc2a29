"""URL filters: the longest rule of an address decides, and block decisions go along redirects and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glowtrace.llm.common import SALTED, Scratch, join_groups, sized_broadcast, spread_join
from glowtrace.llm.components import connected_components

#: (host, path, verdict) of the query.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Memory of a row of broadcast links between address keys of 16 bytes.
_ROW_BYTES = 160

_ATTRIBUTE = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    rows = [F.struct(*[F.lit(v).cast("string").alias(k) for k, v in zip(("host", "path", "verdict"), r, strict=True)]) for r in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; without one, or null: empty."""
    return _lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def address_key(url: Column) -> Column:
    """A key of what a server answers alike: without scheme, fragment, default port, ``utm_`` parameters and a last slash.
    Null for what has no host."""
    host = F.regexp_replace(host_of(url), ":(80|443)$", "")
    asked = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), F.lit(""))
    asked = F.array_join(F.filter(F.split(asked, "&"), lambda p: ~p.startswith("utm_")), "&")
    spelt = F.concat(host, F.regexp_replace(path_of(url), "/$", ""), F.lit("?"), asked)
    return F.when(host_of(url) != "", F.substring(F.unhex(F.sha2(spelt.cast("binary"), 256)), 1, 16))


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value in a tag, trimmed; the last of its three spellings that matches."""
    found = [F.regexp_extract(tag, rf"(?i)\s{name}{_ATTRIBUTE}", k) for k in (1, 2, 3)]
    return F.trim(F.regexp_replace(F.concat(*found), "&(amp|#38|#x26);", "&"))


def resolved(base: Column, href: Column) -> Column:
    """The address that ``href`` names on a page of the address ``base``; null for other schemes, fragments and nothing."""
    root = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"(?s)^(.*?:)//", 1)
    folder = F.regexp_replace(path_of(base), "[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    path, rest = F.regexp_extract(href, r"(?s)^([^?#]*)", 1), F.regexp_extract(href, r"(?s)^[^?#]*(.*)", 1)
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(folder, path))

    def walk(seen: Column, part: Column) -> Column:
        up = F.slice(seen, F.lit(1), F.greatest(F.size(seen) - 1, F.lit(0)))
        return F.when(part == "..", up).when(part == ".", seen).otherwise(F.concat(seen, F.array(part)))

    parts = F.aggregate(F.split(F.regexp_replace(whole, r"/\.{1,2}$", "$0/"), "/"), F.array().cast("array<string>"), walk)
    flat = F.concat(root, F.regexp_replace(F.array_join(parts, "/"), "^/?", "/"), rest)
    relative = F.when(whole.contains("/."), flat).otherwise(F.concat(root, whole, rest))
    return (
        F.when((href == "") | href.startswith("#") | (root == ""), None)
        .when(href.rlike("(?i)^https?://"), href)
        .when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("?"), F.concat(root, path_of(base), href))
        .otherwise(relative)
    )


def page_links(pages: DataFrame) -> DataFrame:
    """(url, target): the canonical links and the redirects by ``<meta http-equiv=refresh>`` of pages (url, html), outside
    comments and scripts, and resolved against the page's address, or that of its ``<base>``. Pages without a url or html have none."""
    html = F.regexp_replace(F.col("html").cast("string"), r"(?is)<!--.*?-->|<script\b.*?</script\s*>", " ")
    asks = F.col("html").cast("string").rlike(r"(?i)\bcanonical\b|http-equiv")
    tags = pages.where(asks & F.col("url").isNotNull()).select(F.col("url").cast("string").alias("url"), F.regexp_extract_all(html, F.lit(r"(?i)<(?:link|meta|base)\s[^>]*>"), F.lit(0)).alias("tags"))
    base = F.get(F.filter("tags", lambda t: t.rlike("(?i)^<base") & (_attribute(t, "href") != "")), F.lit(0))
    tags = tags.withColumn("base", F.coalesce(resolved(F.col("url"), _attribute(base, "href")), "url"))
    tags = tags.select("url", "base", F.explode("tags").alias("tag"))
    canonical = F.col("tag").rlike("(?i)^<link") & F.array_contains(F.split(F.lower(_attribute(F.col("tag"), "rel")), r"\s+"), "canonical")
    refresh = F.col("tag").rlike("(?i)^<meta") & (F.lower(_attribute(F.col("tag"), "http-equiv")) == "refresh")
    to = F.regexp_extract(_attribute(F.col("tag"), "content"), r"""(?is)^\s*[\d.]*\s*[;,]\s*(?:url\s*=\s*)?["']?([^"']*)""", 1)
    href = F.when(canonical, _attribute(F.col("tag"), "href")).when(refresh, F.trim(to))
    return tags.select("url", resolved(F.col("base"), href).alias("target")).where("target is not null")


def with_rules(rows: DataFrame, rules: DataFrame, spread: str, scratch: Scratch) -> DataFrame:
    """``rows`` (host, path, ...) with the longest rule that fits, and its verdict; of equal ones that allow wins.

    Rules meet the distinct hosts, by the last labels of those; a host's rules are joined to its rows by broadcast or salts."""
    rules = rules.where("host <> '' and verdict in ('allow', 'block')").select(
        _lower(F.col("host")).alias("tail"), F.coalesce("path", F.lit("")).alias("from"), "verdict", F.concat(_lower(F.col("host")), F.coalesce("path", F.lit(""))).alias("rule")
    )
    rules = scratch.save(rules.distinct(), "rules")
    depths = sorted(r[0] for r in rules.select(F.size(F.split("tail", r"\."))).distinct().collect())  # labels of a name: few
    sizes = scratch.save(rows.groupBy("host").agg(F.count("*").alias("size")), "sizes")
    tails = [F.substring_index("host", ".", -d) for d in depths] or [F.lit("")]
    hosts = sizes.where("host <> ''").select("host", F.explode(F.array_distinct(F.array(*tails))).alias("tail"))
    small = sized_broadcast(rules)
    if small is not rules:
        fits = hosts.join(small, "tail")
    else:
        lists = scratch.save(rules.groupBy("tail").agg(F.collect_list(F.struct("from", "verdict", "rule")).alias("all")), "lists")
        fits = spread_join(scratch.save(hosts, "hosts"), lists, "tail", "host", scratch).select("host", F.inline("all"))
    order = F.struct(F.length("rule").alias("long"), (F.col("verdict") == "allow").alias("allows"), "rule", "verdict", "from")
    fits = sizes.join(fits.groupBy("host").agg(F.collect_list(order).alias("fits")), "host", "left")
    fits = scratch.save(fits.where((F.col("size") > SALTED) | F.col("fits").isNotNull()), "fits")  # large hosts are salted, with rules or without
    best = F.array_max(F.filter("fits", lambda r: F.col("path").startswith(r["from"])))
    out = join_groups(rows, fits, ["host"], [spread]).withColumn("best", best)
    return out.select(*rows.columns, F.col("best.rule").alias("rule"), F.col("best.verdict").alias("own"))


def judged_pages(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, decided_by) for pages (page_id, url, html), a row each; other columns are ignored.

    A rule (host, path, verdict) fits its host and all subdomains where the path starts with its own; the longest decides.
    Addresses that ``redirects`` (url, target), canonical links or refreshes join, whatever their direction and length, are
    aliases; so are spellings that servers answer alike (``address_key``). Pages that no rule fits are blocked if a rule blocks
    one of their aliases, whether it is a page or not, unless a rule explicitly allows one of them; else they are allowed.
    ``decided_by`` is ``rule``, ``alias`` or ``default``.

    Links are pairs of 16-byte keys; decisions are added up in tasks and joined by broadcast or salts, so one host or address
    with any share of the pages is many tasks. Null url or one without ``://``: empty host and path, no rule and no alias,
    allowed. Null html: no links. Null and repeated ids and urls stay rows. No rules: all allowed. Empty table: empty result."""
    scratch = Scratch(pages.sparkSession, "urls")
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), F.coalesce(address_key(url), F.lit(b"")).alias("node"))
    rows = scratch.save(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    judged = scratch.save(with_rules(rows, rules, "row", scratch), "judged")

    links = page_links(pages)
    if redirects is not None:
        links = links.union(redirects.select(F.col("url").cast("string"), F.col("target").cast("string")))
    ends = [F.struct(F.col(c).alias("url"), address_key(F.col(c)).alias("node")).alias(c) for c in ("url", "target")]
    links = scratch.save(links.select(*ends).where("url.node is not null and target.node is not null and url.node <> target.node"), "links")
    classes = connected_components(links.select(F.col("url.node").alias("u"), F.col("target.node").alias("v")), scratch, _ROW_BYTES)

    # What rules say of the addresses at the ends of links, besides that of pages.
    named = links.select(F.explode(F.array("url", "target")).alias("end")).select("end.*").distinct()
    named = scratch.save(named.select("node", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), "named")
    said = judged.select("node", "own", F.lit(1).alias("page")).union(with_rules(named, rules, "node", scratch).select("node", "own", F.lit(0).alias("page")))
    nodes = said.groupBy("node").agg(F.sum("page").alias("size"), F.max(F.col("own") == "block").alias("blocks"), F.max(F.col("own") == "allow").alias("allows"))
    nodes = nodes.join(classes.withColumnRenamed("id", "node"), "node", "left").select("node", "size", F.coalesce("component", "node").alias("alias"), "blocks", "allows")
    nodes = scratch.save(nodes, "nodes")
    blocked = nodes.groupBy("alias").agg(F.max("blocks").alias("blocks"), F.max("allows").alias("allows")).where("blocks and not coalesce(allows, false)").select("alias")
    blocked = scratch.save(blocked, "blocked")
    small = sized_broadcast(blocked)
    caught = nodes.join(small, "alias") if small is not blocked else spread_join(nodes, blocked, "alias", "node", scratch)
    caught = scratch.save(caught.where("size > 0").select("node", "size", F.lit(True).alias("caught")), "caught")
    large = nodes.where(F.col("size") > SALTED).join(caught.select("node"), "node", "left_anti").select("node", "size", F.lit(False).alias("caught"))
    spread = scratch.save(caught.union(large), "spread")
    out = join_groups(judged, spread, ["node"], ["row"])
    verdict = F.coalesce("own", F.when(F.col("caught"), "block").otherwise("allow"))
    by = F.when(F.col("own").isNotNull(), "rule").when(F.col("caught"), "alias").otherwise("default")
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), by.alias("decided_by"))
