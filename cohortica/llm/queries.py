"""The operators as queries over the driver's tables, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortica.llm import ann, embedding_dedup, lang_id, license_scan, line_dedup, mixing, ngram_join, sp_codec, substring_dedup, url_filter

#: The rules of the url query: (action, host, path).
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_read(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = line_dedup.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(_read(spark, sf_dir, "documents").select("doc_id", "text"), window=35, digests_only=True)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, url_filter.rules_frame(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_embeddings(_read(spark, sf_dir, "embeddings"), least=0.9)


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search_embeddings(_read(spark, sf_dir, "embeddings"), every=20, k=20)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_documents(_read(spark, sf_dir, "documents"), jaccard=0.9, width=3)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = spark.conf.get("spark.cohortica.tokenizer", sp_codec.MODEL)
    return sp_codec.encode_documents(_read(spark, sf_dir, "documents").select("doc_id", "text"), model, digests_only=True)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(_read(spark, sf_dir, "documents"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_line_dedup": op2_line_dedup,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_url_filter": op4_url_filter,
        "op5_embedding_dedup": op5_embedding_dedup,
        "op6_nearest_neighbours": op6_nearest_neighbours,
        "op7_ngram_join": op7_ngram_join,
        "op8_sentencepiece": op8_sentencepiece,
        "op9_language_id": op9_language_id,
        "op10_source_mix": op10_source_mix,
    }


SUBSTRING_SQL = r"""
WITH d AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35),
h AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS passage FROM p),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY passage) AS n FROM h) WHERE n > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM r),
l AS (SELECT doc_id, list(k) AS gone FROM g GROUP BY doc_id),
s AS (SELECT doc_id, k, w[k] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d)),
m AS (SELECT s.doc_id, string_agg(word, ' ' ORDER BY s.k) AS kept FROM s ANTI JOIN g ON s.doc_id = g.doc_id AND s.k = g.k GROUP BY s.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN l ON d.doc_id = l.doc_id LEFT JOIN m ON d.doc_id = m.doc_id
"""

EMBEDDING_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_dot_product(e, e) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
t(id, reached) AS (SELECT vec_id, vec_id FROM v UNION SELECT t.id, l.b FROM t JOIN l ON t.reached = l.a),
c AS (SELECT id, min(reached) AS component_id FROM t GROUP BY id),
k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON v.vec_id = c.id LEFT JOIN k ON v.vec_id = k.a
"""

JACCARD_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS x FROM d),
e AS (SELECT doc_id, CAST(len(x) AS BIGINT) AS n, unnest(x) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS both_have FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * both_have >= 90 * (na + nb - both_have)),
t(id, reached) AS (SELECT doc_id, doc_id FROM d UNION SELECT t.id, l.b FROM t JOIN l ON t.reached = l.a)
SELECT s.doc_id, CAST(len(x) AS BIGINT) AS n_shingles, min(reached) AS component_id FROM s JOIN t ON s.doc_id = t.id GROUP BY ALL
"""

LINE_DEDUP_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
h AS (SELECT doc_id, lines, list_transform(lines, lambda x: md5(x)) AS hs FROM d WHERE text IS NOT NULL),
e AS (SELECT doc_id, lines, len(lines) AS n, list_transform(range(1, len(lines) + 1), lambda i: i > 1 AND substr(md5((CASE WHEN i = 1 THEN '' ELSE hs[i - 1] END) || hs[i]), 1, 1) < '8') AS marked FROM h),
r AS (SELECT doc_id, lines, n, list_filter(range(1, n + 1), lambda i: i = n OR (i < n - 1 AND marked[i] AND NOT marked[i - 1])) AS ends FROM e),
c AS (SELECT doc_id, lines, k, (CASE WHEN k = 1 THEN 0 ELSE ends[k - 1] END) + 1 AS a, ends[k] AS b
      FROM (SELECT doc_id, lines, ends, unnest(range(1, len(ends) + 1)) AS k FROM r)),
m AS (SELECT doc_id, k, a, b, array_to_string(lines[a:b], chr(10)) AS bytes FROM c WHERE b > a),
f AS (SELECT *, row_number() OVER (PARTITION BY bytes ORDER BY doc_id, k) AS nth FROM m),
g AS (SELECT doc_id, list(a) AS ra, list(b) AS rb, CAST(sum(b - a + 1) AS BIGINT) AS n_removed FROM f WHERE nth > 1 GROUP BY doc_id),
k AS (SELECT d.doc_id, text, lines, n_removed, CASE WHEN n_removed IS NULL THEN text ELSE coalesce(array_to_string(list_transform(list_filter(range(1, len(lines) + 1),
      lambda i: len(list_filter(list_zip(ra, rb), lambda z: z[1] <= i AND i <= z[2])) = 0), lambda i: lines[i]), chr(10)), '') END AS kept FROM d LEFT JOIN g ON d.doc_id = g.doc_id)
SELECT doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k
"""

URL_SQL = r"""
WITH r(action, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
      coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path, row_number() OVER () AS n FROM pages),
m AS (SELECT n, h || p AS rule, action, row_number() OVER (PARTITION BY n ORDER BY length(h || p) DESC, length(h) DESC, h || p DESC) AS nth
      FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM u LEFT JOIN m ON u.n = m.n AND m.nth = 1
"""

MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END) AS weight FROM s),
f AS (SELECT *, source_size * 2 / weight AS full_at FROM w),
c AS (SELECT *, coalesce(sum(source_size) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2 AS capped,
      sum(weight) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight, sum(source_size) OVER () AS total FROM f),
l AS (SELECT *, max((CAST(total AS DOUBLE) * 1.5 - CAST(capped AS DOUBLE)) / CAST(open_weight AS DOUBLE)) OVER () AS level FROM c),
t AS (SELECT source, source_size, least(CAST(source_size AS DOUBLE) * 2, level * weight) AS target FROM l),
r AS (SELECT d.*, source_size, target, row_number() OVER () AS n, sum(size) OVER (PARTITION BY d.source ORDER BY digest, doc_id, size ROWS UNBOUNDED PRECEDING) AS run FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT n, size, digest, doc_id, p, CAST(run + p * source_size AS DOUBLE) / target AS finish FROM r, (VALUES (0), (1)) AS passes(p) WHERE target > 0),
q AS (SELECT n, sum(size) OVER (ORDER BY finish, digest, p, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM e),
k AS (SELECT n, count(*) AS passes FROM q WHERE upto <= (SELECT sum(source_size) * 1.5 FROM t) GROUP BY n)
SELECT doc_id, size, source_size, target, CAST(size * coalesce(passes, 0) AS BIGINT) AS taken FROM r LEFT JOIN k ON r.n = k.n
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": LINE_DEDUP_SQL,
        "op3_substring_dedup": SUBSTRING_SQL,
        "op4_url_filter": URL_SQL,
        "op5_embedding_dedup": EMBEDDING_SQL,
        "op7_ngram_join": JACCARD_SQL,
        "op10_source_mix": MIX_SQL,
    }
