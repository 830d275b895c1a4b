"""The queries of this subpackage: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arborlane.llm.exact_dedup import exact_groups
from arborlane.llm.fingerprints import edited_fingerprints
from arborlane.llm.mixing import Target, usage
from arborlane.llm.ngram_join import components_of
from arborlane.llm.packing import pack
from arborlane.llm.pitman_yor import score
from arborlane.llm.quality import classify
from arborlane.llm.substring_dedup import remove_repeats
from arborlane.llm.token_counts import token_counts
from arborlane.llm.url_filters import judge


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(_table(spark, sf_dir, "documents"))


def op3_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(_table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage(_table(spark, sf_dir, "documents"), Target(repeats=4.0))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_table(spark, sf_dir, "pages"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components_of(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_counts, op2_fingerprints, op3_pitman_yor, op4_mixing, op5_packing, op6_url_filters, op7_ngram_join, op8_quality, op9_exact_dedup, op10_substring_dedup)
}

OP6_SQL = r"""
WITH p AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), h AS (
  SELECT page_id,
         COALESCE(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         COALESCE(regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1), '') AS path
  FROM p
), r(verdict, rhost, rpath) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), m AS (
  SELECT page_id, max(struct_pack(n := length(rhost || rpath), rule := rhost || rpath, verdict := r.verdict)) AS best
  FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id
)
SELECT h.page_id, host, path, best.rule AS rule, COALESCE(best.verdict, 'allow') AS verdict
FROM h LEFT JOIN m ON h.page_id = m.page_id
"""

OP9_SQL = r"""
WITH a AS (
  SELECT doc_id, length(COALESCE(text, '')) AS n, regexp_replace(COALESCE(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(bare) AS text_sha256
FROM a
WINDOW w AS (PARTITION BY bare ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""

#: Shingles as text, all pairs that share one, and reach by links.
OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS g FROM d
), e AS (
  SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM s
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS c
  FROM e a JOIN e b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), l AS (
  SELECT x, y FROM p WHERE 100 * c >= 80 * (nx + ny - c)
), r(x, y) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x
), m AS (
  SELECT x, min(y) AS component_id FROM r GROUP BY x
)
SELECT s.doc_id, len(g) AS n_shingles, component_id FROM s JOIN m ON s.doc_id = m.x
"""

#: Windows as text; a word goes if one of the 35 windows that hold it starts again elsewhere.
OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS pos FROM d WHERE len(w) >= 35
), v AS (
  SELECT doc_id, pos, count(*) OVER (PARTITION BY array_to_string(w[pos : pos + 34], ' ')) > 1 AS again FROM s
), t AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d
), k AS (
  SELECT t.doc_id, t.pos, word, COALESCE(max(CASE WHEN again THEN 1 ELSE 0 END) OVER (PARTITION BY t.doc_id ORDER BY t.pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), 0) AS gone
  FROM t LEFT JOIN v ON t.doc_id = v.doc_id AND t.pos = v.pos
), o AS (
  SELECT doc_id, count(*) AS n_words, sum(gone)::BIGINT AS n_removed, COALESCE(string_agg(word, ' ' ORDER BY pos) FILTER (WHERE gone = 0), '') AS kept FROM k GROUP BY doc_id
)
SELECT d.doc_id, COALESCE(n_words, 0) AS n_words, COALESCE(n_removed, 0) AS n_removed, sha256(COALESCE(kept, '')) AS kept_sha256 FROM d LEFT JOIN o ON d.doc_id = o.doc_id
"""

ORACLE_SQL: dict[str, str] = {"op6_url_filters": OP6_SQL, "op7_ngram_join": OP7_SQL, "op9_exact_dedup": OP9_SQL, "op10_substring_dedup": OP10_SQL}
