"""One query for each operator of this package: QUERIES, and ORACLES where SQL says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recurra.llm import decontamination, exact_dedup, language_id, line_dedup, mixing, near_dedup, sharding, token_counts, toxicity, url_filter
from recurra.llm.storage import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 40)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_classes(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_sharding, op3_toxicity, op4_exact_dedup, op5_token_counts, op6_language_id, op7_near_dedup, op8_decontamination, op9_line_dedup, op10_url_filter)}

ORACLES = {
    "op1_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0b\f\r]+')) AS BIGINT) AS size,
                   (CAST('0x' || substr(md5('mix:' || CAST(doc_id AS VARCHAR)), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
            FROM documents),
        q AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
        k AS (SELECT d.*, round(-ln(u) / CASE quality WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END, 12) AS key FROM d LEFT JOIN q USING (doc_id)),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, source_size * 3.0::DOUBLE AS cap FROM s),
        f AS (SELECT *, cap / weight AS fill, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM w),
        l AS (SELECT *, (total - coalesce(sum(cap) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
              FROM f WINDOW o AS (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        m AS (SELECT arg_min(level, fill) AS level FROM l WHERE fill >= level),
        t AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0 ELSE least(cap, m.level * weight) END AS target FROM l, m),
        e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size + 1e-9) AS BIGINT) ELSE 0 END AS epochs FROM t),
        p AS (SELECT k.doc_id, size, source_size, target, epochs, target - epochs * source_size AS rest,
                     CAST(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
              FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
        SELECT doc_id, size, source_size, target, size * (epochs + CASE WHEN rest > 0 AND upto - size / 2.0 <= rest AND upto - size < rest THEN 1 ELSE 0 END) AS taken FROM p""",
    "op4_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[ \t\n\x0b\f\r]+', '', 'g') AS content FROM documents),
        c AS (SELECT doc_id, content, first_value(doc_id) OVER (PARTITION BY content ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY content) AS group_size FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(content) AS text_sha256 FROM c""",
    "op7_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0b\f\r]+') AS w FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i : i + 4], ' '))) AS s FROM w WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s AS a JOIN s AS b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (
            SELECT x, y FROM p JOIN n AS nx ON x = nx.doc_id JOIN n AS ny ON y = ny.doc_id WHERE 100 * shared >= 75 * (nx.n + ny.n - shared)),
        r AS (SELECT x AS doc_id, x AS o FROM l UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.o = l.x),
        c AS (SELECT doc_id, min(o) AS c FROM r GROUP BY doc_id)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, w.doc_id) AS component_id, coalesce(c.c, w.doc_id) = w.doc_id AS kept
        FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "op8_decontamination": r"""
        WITH t AS (SELECT 'd' AS k, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
        w AS (SELECT k, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM t),
        i AS (SELECT id AS item, least(13, len(w)) AS n, unnest(list_transform(range(1, greatest(len(w) - 11, 2)), lambda i: array_to_string(w[i : i + 12], ' '))) AS s FROM w WHERE k = 'b' AND len(w) > 0),
        z AS (SELECT DISTINCT n FROM i),
        d AS (SELECT id, n, unnest(range(1, len(w) - n + 2)) AS p0, w FROM w, z WHERE k = 'd' AND len(w) >= n),
        h AS (SELECT d.id, d.p0, d.n, i.item FROM d JOIN (SELECT DISTINCT item, n, s FROM i) AS i ON i.n = d.n AND i.s = array_to_string(d.w[d.p0 : d.p0 + d.n - 1], ' ')),
        c AS (SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(range(p0, p0 + n)) AS p FROM h) GROUP BY id),
        m AS (SELECT id, count(DISTINCT item) AS n_items, string_agg(DISTINCT CAST(item AS VARCHAR), ',' ORDER BY CAST(item AS VARCHAR)) AS items FROM h GROUP BY id)
        SELECT w.id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM w LEFT JOIN c USING (id) LEFT JOIN m USING (id) WHERE k = 'd'""",
    "op10_url_filter": r"""
        WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        u AS (
            SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
            FROM r),
        k AS (SELECT * FROM (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) AS k(h, p, v)),
        b AS (
            SELECT list(n || '-' || w) || list(w || '-' || n) AS names
            FROM (SELECT unnest(['ad', 'ads', 'adult', 'bet', 'bets', 'cams', 'casino', 'clicks', 'crypto', 'loans', 'malware', 'pharma', 'phish', 'pills', 'poker', 'popup', 'porn', 'sex', 'slots', 'spam', 'viagra', 'warez', 'xxx']) AS n),
                 (SELECT unnest(['24', 'best', 'bonus', 'cheap', 'club', 'farm', 'free', 'hot', 'hub', 'live', 'online', 'server', 'shop', 'track', 'tracker', 'win', 'x', 'zone']) AS w)),
        f AS (
            SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
            FROM u JOIN k ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
        SELECT u.page_id, host, path, rule, coalesce(v, CASE WHEN list_has_any(string_split(host, '.'), b.names) THEN 'block' ELSE 'allow' END) AS verdict
        FROM u LEFT JOIN f USING (page_id), b""",
}
