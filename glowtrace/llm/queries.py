"""The queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glowtrace.llm import chat, embedding_join, exact_dedup, fixity, html_extract, langid, minhash, mixing, packing, runs, search, tokens, url_rules
from glowtrace.llm.common import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.with_control_strings(spark, table(spark, sf_dir, "conversations"))
    return chat.read_back(chat.windows(turns))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.radix_groups(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.document_tokens(table(spark, sf_dir, "documents"))


def op7_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.page_texts(table(spark, sf_dir, "pages"))


def op8_similar_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.similar_vectors(table(spark, sf_dir, "embeddings"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive of all pages against a replica that is damaged by rule."""
    records = fixity.warc_records(table(spark, sf_dir, "pages"))
    return fixity.audit(fixity.leaves(records), fixity.leaves(fixity.damaged(records)))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digests(runs.periodic_runs(runs.with_planted_runs(table(spark, sf_dir, "documents"))))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judged_pages(table(spark, sf_dir, "pages"), url_rules.rule_table(spark))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_language_id": op2_language_id,
    "op3_chat_windows": op3_chat_windows,
    "op4_source_mix": op4_source_mix,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_page_text": op7_page_text,
    "op8_similar_embeddings": op8_similar_embeddings,
    "op9_near_dedup": op9_near_dedup,
    "op10_merkle_audit": op10_merkle_audit,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_ranked_search": op12_ranked_search,
    "op13_url_filter": op13_url_filter,
}

ORACLE_SQL: dict[str, str] = {
    "op2_language_id": r"""
        WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text,
                list_transform(range(1, length(coalesce(CAST(doc_id AS VARCHAR), '')) + 1), lambda i: ascii(CAST(doc_id AS VARCHAR)[i])) AS digits FROM documents),
        c AS (SELECT *, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(digits, lambda b: [CAST(b AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
                lambda crc, b: CASE WHEN b >= 0 THEN xor(crc, b) ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END), 4294967295) % 3 = 1 AS held_out FROM d),
        k AS (SELECT doc_id, lang, held_out, string_split(' ' || trim(regexp_replace(lower(text), '[^\p{L}\p{M}]+', ' ', 'g')) || ' ', '') AS kept, regexp_matches(text, '\p{L}') AS spoken FROM c),
        s AS (SELECT doc_id, lang, held_out, unnest(list_zip(kept, kept[2:], kept[3:])) AS z FROM k WHERE spoken),
        g AS (SELECT doc_id, lang, held_out, unnest([z[1], z[1] || z[2], z[1] || z[2] || z[3]]) AS gram FROM s),
        n AS (SELECT doc_id, any_value(lang) AS lang, any_value(held_out) AS held_out, gram, count(*) AS n FROM g WHERE gram IS NOT NULL AND gram <> ' ' GROUP BY doc_id, gram),
        p AS (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, length(gram), gram) - 1 AS place FROM n
              WHERE lang IS NOT NULL AND NOT held_out GROUP BY lang, gram QUALIFY place < 400),
        o AS (SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, length(gram), gram) - 1 AS place FROM n QUALIFY place < 400),
        z AS (SELECT doc_id, count(*) AS grams FROM o GROUP BY doc_id),
        m AS (SELECT o.doc_id, p.lang, CAST(sum(400 - least(abs(o.place - p.place), 400)) AS BIGINT) AS near FROM o JOIN p ON o.gram = p.gram GROUP BY o.doc_id, p.lang),
        e AS (SELECT z.doc_id, l.lang, 400 * z.grams - coalesce(m.near, 0) AS places, z.grams
              FROM z CROSS JOIN (SELECT DISTINCT lang FROM p) l LEFT JOIN m ON m.doc_id = z.doc_id AND m.lang = l.lang),
        b AS (SELECT doc_id, lang, 1 - CAST(places AS DOUBLE) / (400 * grams) AS score FROM e QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY places, lang) = 1)
        SELECT k.doc_id, k.held_out, coalesce(b.lang, 'und') AS lang_pred, coalesce(b.score, 0) AS score FROM k LEFT JOIN b USING (doc_id)
    """,
    "op8_similar_embeddings": r"""
        WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
              WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
        r AS (SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u),
        n AS (SELECT u, count(*) AS n FROM l GROUP BY u), c AS (SELECT u, min(v) AS least FROM r GROUP BY u)
        SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(c.least, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(c.least, vec_id)) AS kept
        FROM embeddings LEFT JOIN n ON n.u = vec_id LEFT JOIN c ON c.u = vec_id
    """,
    "op9_near_dedup": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i+4], ' ') AS shingle FROM (SELECT doc_id, words, unnest(range(1, greatest(1, len(words) - 4) + 1)) AS i FROM w WHERE len(words) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * shared >= 75 * (a.n + b.n - shared)),
        r AS (SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u),
        c AS (SELECT u, min(v) AS least FROM r GROUP BY u)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(c.least, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(c.least, w.doc_id)) AS kept
        FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.u = w.doc_id
    """,
    "op3_chat_windows": r"""
        WITH RECURSIVE c AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i FROM c),
        r AS (SELECT conv_id, i, role, text, CAST(i = 0 AND role = 'system' AS INTEGER) AS head,
                CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) + 4 AS cost,
                8 + length(replace(replace(replace(role, '&', '&a'), '|', '&p'), '<', '&l'))
                  + length(regexp_replace(text, '([<\[])(&*)(\||/?s>|/?INST\])', '\1&\2\3', 'g')) AS chars
              FROM t),
        h AS (SELECT conv_id, sum(CASE WHEN head = 1 THEN cost ELSE 0 END) AS head_cost, sum(CASE WHEN head = 1 THEN chars ELSE 0 END) AS head_chars, sum(head) AS n_head FROM r GROUP BY conv_id),
        b AS (SELECT r.conv_id, r.i - h.n_head AS i, r.cost, h.head_cost, h.head_chars,
                sum(r.cost) OVER w - r.cost AS before, sum(r.chars) OVER w - r.chars AS chars_before
              FROM r JOIN h ON r.conv_id IS NOT DISTINCT FROM h.conv_id WHERE r.head = 0
              WINDOW w AS (PARTITION BY r.conv_id ORDER BY r.i)),
        f AS (SELECT b.conv_id, b.i, any_value(b.before) AS before, any_value(b.cost) AS cost, any_value(b.chars_before) AS chars_before,
                any_value(b.head_cost) AS head_cost, any_value(b.head_chars) AS head_chars, min(e.before) AS first_before, min(e.chars_before) AS first_chars
              FROM b JOIN b e ON b.conv_id IS NOT DISTINCT FROM e.conv_id AND e.i <= b.i
                AND (e.i = b.i OR b.before - e.before <= least(128, 512 - b.head_cost - b.cost))
              GROUP BY b.conv_id, b.i),
        w AS (SELECT conv_id, i, before AS base, 0 AS extra FROM f WHERE i = 0
          UNION ALL
          SELECT f.conv_id, f.i,
            CASE WHEN f.head_cost + f.before + f.cost - w.base <= 512 THEN w.base ELSE f.first_before END,
            CASE WHEN f.head_cost + f.before + f.cost - w.base <= 512 THEN 0 ELSE f.head_chars + f.chars_before - f.first_chars END
          FROM w JOIN f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = w.i + 1),
        x AS (SELECT conv_id, CAST(sum(extra) AS BIGINT) AS extra FROM w GROUP BY conv_id),
        g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS turns,
                coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY i), '') AS loss, CAST(sum(chars) AS BIGINT) AS chars
              FROM r GROUP BY conv_id)
        SELECT g.conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, chars + coalesce(extra, 0) AS formatted_chars
        FROM g LEFT JOIN x ON g.conv_id IS NOT DISTINCT FROM x.conv_id
    """,
    "op4_source_mix": r"""
        WITH d AS (SELECT doc_id, source, md5(coalesce(text, '')) AS hash, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (SELECT *, CAST([1, 2, 3][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS BIGINT) AS weight, source_size * 3 AS cap FROM s),
        b AS (SELECT *, cap / weight AS ratio,
                CAST(sum(source_size) OVER () AS BIGINT) - CAST(coalesce(sum(cap) OVER o, 0) AS BIGINT) AS words,
                CAST(sum(weight) OVER () AS BIGINT) - CAST(coalesce(sum(weight) OVER o, 0) AS BIGINT) AS weights
              FROM w WINDOW o AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        l AS (SELECT words / weights AS level FROM b WHERE cap >= (words / weights) * weight ORDER BY ratio, source ASC NULLS LAST LIMIT 1),
        t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce((SELECT level FROM l) * weight, CAST(cap AS DOUBLE))) AS target FROM w),
        g AS (SELECT source, source_size, target, least(CAST(round(target) AS BIGINT), source_size * 3) AS upto FROM t),
        p AS (SELECT d.doc_id, d.size, g.source_size, g.target, g.upto,
                CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':mix:' || d.hash), d.size
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos
              FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
        SELECT doc_id, size, source_size, target,
          greatest(0, least(pos + size, upto) - pos) + greatest(0, least(pos + size + source_size, upto) - pos - source_size)
            + greatest(0, least(pos + size + 2 * source_size, upto) - pos - 2 * source_size) AS taken
        FROM p
    """,
    "op5_exact_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
        SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
          doc_id = first_value(doc_id) OVER best AS kept, sha256(norm) AS text_sha256
        FROM d WINDOW best AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id)
    """,
    "op10_merkle_audit": r"""
        WITH p AS (SELECT coalesce(page_id, -1) AS page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
        r AS (SELECT page_id, CAST(floor(page_id / 1000) AS BIGINT) AS file,
                'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
                || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10)
                || 'Content-Length: ' || octet_length(encode(html)) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS record
              FROM p),
        a AS (SELECT file, page_id, record, octet_length(encode(record)) AS length, sha256(record) AS digest,
                CAST(coalesce(sum(octet_length(encode(record))) OVER (PARTITION BY file ORDER BY page_id, sha256(record) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
              FROM r),
        b AS (SELECT *, CASE WHEN page_id % 101 = 17 THEN NULL
                WHEN page_id % 97 = 13 THEN sha256(substring(record, 1, length(record) - 5) || '~' || substring(record, length(record) - 3))
                WHEN page_id % 103 = 29 THEN sha256(substring(record, 1, length(record) - 40)) ELSE digest END AS their_digest FROM a)
        SELECT file, "offset", length, page_id, CASE WHEN their_digest IS NULL THEN 'missing' ELSE 'changed' END AS state, digest AS our_digest, their_digest
        FROM b WHERE their_digest IS DISTINCT FROM digest
    """,
    # A repeated window of 16 words is found at its distance first; stretches of such windows are runs, and the smallest period counts.
    "op11_periodic_runs": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
                list_transform(range(1, length(coalesce(CAST(doc_id AS VARCHAR), '')) + 1), lambda i: ascii(CAST(doc_id AS VARCHAR)[i])) AS digits FROM documents),
        h AS (SELECT doc_id, words, len(words) AS n, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(digits, lambda b: [CAST(b AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
                lambda crc, b: CASE WHEN b >= 0 THEN xor(crc, b) ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END), 4294967295) AS h FROM d),
        a AS (SELECT doc_id, words, n, h % 10 = 0 AND n > 0 AS drawn, h // 10 AS g, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM h),
        p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
        t AS (SELECT doc_id, n, CASE WHEN drawn THEN list_transform(range(n), lambda i: words[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE words END AS words FROM p),
        w AS (SELECT doc_id, n, unnest(range(n - 15)) AS i, words FROM t WHERE n >= 24),
        k AS (SELECT doc_id, n, i, md5(array_to_string(words[i + 1:i + 16], ' ')) AS code FROM w),
        m AS (SELECT x.doc_id, y.i - x.i AS q, x.i AS i FROM k x JOIN k y ON x.doc_id = y.doc_id AND x.code = y.code AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
        s AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS stretch FROM m),
        c AS (SELECT doc_id, q AS period, min(i) AS start, count(*) + 15 + q AS length FROM s GROUP BY doc_id, q, stretch HAVING count(*) + 15 + q >= greatest(24, 3 * q)),
        r AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c z WHERE z.doc_id = c.doc_id AND z.period < c.period AND z.start <= c.start AND z.start + z.length >= c.start + c.length)),
        f AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY doc_id),
        b AS (SELECT doc_id, start, length, period FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) = 1),
        o AS (SELECT doc_id, list(DISTINCT i) AS gone FROM (SELECT doc_id, unnest(range(start + period, start + length)) AS i FROM r) GROUP BY doc_id),
        l AS (SELECT t.doc_id, array_to_string(CASE WHEN o.gone IS NULL THEN t.words ELSE list_filter(t.words, lambda x, i: NOT list_contains(o.gone, i - 1)) END, ' ') AS collapsed FROM t LEFT JOIN o USING (doc_id))
        SELECT t.doc_id, coalesce(f.n_runs, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli,
          sha256(coalesce(f.lines, '')) AS runs_sha256, sha256(l.collapsed) AS collapsed_sha256
        FROM t LEFT JOIN f USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id)
    """,
    "op12_ranked_search": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
        i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        c AS (SELECT count(*) AS docs, CAST(sum(len(terms)) AS BIGINT) AS total FROM d WHERE len(terms) > 0),
        t AS (SELECT doc_id, term, n, count(*) AS tf FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY doc_id, term, n),
        f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
        p AS (SELECT t.doc_id, t.term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total))) AS part
              FROM t JOIN f USING (term) CROSS JOIN c),
        s AS (SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM i JOIN p USING (term) GROUP BY item_id, doc_id HAVING sum(part) > 0)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s QUALIFY rank <= 10
    """,
    # The pages of the tables hold no links; what these do is tested against brute force.
    "op13_url_filter": r"""
        WITH r(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
        u AS (SELECT row_number() OVER () AS row, page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^?#]*\?([^#]*)', 1) AS asked FROM pages),
        k AS (SELECT *, regexp_replace(host, ':(80|443)$', '') || regexp_replace(path, '/$', '') || '?' || array_to_string(list_filter(string_split(asked, '&'), lambda p: NOT starts_with(p, 'utm_')), '&') AS node FROM u),
        b AS (SELECT k.row, r.host || r.path AS rule, r.verdict FROM k JOIN r ON (k.host = r.host OR ends_with(k.host, '.' || r.host)) AND starts_with(k.path, r.path)
              QUALIFY row_number() OVER (PARTITION BY k.row ORDER BY length(r.host || r.path) DESC, r.verdict) = 1),
        n AS (SELECT node, bool_or(verdict = 'block') AND NOT bool_or(verdict = 'allow') AS caught FROM k LEFT JOIN b USING (row) WHERE host <> '' GROUP BY node)
        SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN caught THEN 'block' ELSE 'allow' END) AS verdict,
          CASE WHEN verdict IS NOT NULL THEN 'rule' WHEN caught THEN 'alias' ELSE 'default' END AS decided_by
        FROM k LEFT JOIN b USING (row) LEFT JOIN n ON n.node = k.node AND k.host <> ''
    """,
}
