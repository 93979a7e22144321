"""One query for each operator, with production parameters, over its whole table; SQL where it can express the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontamination import find_contamination
from .embedding_dedup import near_duplicates
from .encoding import tokenizer_path
from .line_dedup import dedup_lines
from .ngram_join import ngram_join
from .packing import pack_documents
from .quality import fit_quality, score_quality
from .revisits import page_records, resolve_revisits
from .sharding import assign_shards
from .tokens import token_counts
from .toxicity import fit_toxicity, score_toxicity

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "embeddings"), near=0.9)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), limit=1024, ranks=tokenizer_path("byte_bpe_50k.tiktoken"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, _table(spark, sf_dir, "labels")))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(_table(spark, sf_dir, "documents"), [1.0] * 8)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, _table(spark, sf_dir, "labels")))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(page_records(_table(spark, sf_dir, "pages")))
    h = F.col("headers")
    columns = [F.col("record_id.page").alias("page_id"), F.col("record_id.visit").alias("visit"), "canonical_url", "outcome", F.col("resolved_id.page").alias("resolved_page_id")]
    fields = [F.coalesce(h[title.lower()], h[title]).alias(title.lower().replace("-", "_")) for title in ("ETag", "Last-Modified", "Date", "Content-Length", "Content-Type", "Cache-Control")]
    return found.select(*columns, *fields)


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_neardup": VECTORS_SQL, "op8_ngram_join": JACCARD_SQL, "op5_sharding": SHARDING_SQL, "op9_decontamination": CONTAMINATION_SQL, "op10_warc_revisits": REVISITS_SQL}


SHARDING_SQL = """
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS body, strlen(coalesce(text, '')) + 1 AS size FROM documents
), poly AS (
  SELECT list(list_reduce([i, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, one:
           CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)
), crc AS (
  SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT,
           list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda h: ('0x' || h)::BIGINT)),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM docs, poly
), scored AS (
  SELECT doc_id, size, text_crc32, i AS shard,
         -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '#' || i), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) AS score
  FROM crc, (SELECT unnest(range(9)) AS i)
), best AS (
  SELECT doc_id, size, text_crc32, arg_min(shard, (score, shard)) FILTER (shard < 8) AS shard, arg_min(shard, (score, shard)) AS grown_shard
  FROM scored GROUP BY ALL
), parted AS (
  SELECT *, row_number() OVER (PARTITION BY shard
           ORDER BY substr(md5(concat_ws('#', doc_id::VARCHAR, size::VARCHAR, text_crc32::VARCHAR)), 1, 3), doc_id, size, text_crc32) - 1 AS slot
  FROM best
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard, slot::BIGINT AS slot,
       grown_shard::INT AS grown_shard
FROM parted
"""

CONTAMINATION_SQL = """
WITH texts AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') FROM benchmark
), cut AS (
  SELECT DISTINCT kind, id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
           ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle
  FROM texts
), sizes AS (
  SELECT id AS item_id, count(*) AS n_item_shingles FROM cut WHERE kind = 'i' GROUP BY id
), pairs AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared FROM cut d JOIN cut i USING (shingle)
  WHERE d.kind = 'd' AND i.kind = 'i' GROUP BY ALL
)
SELECT doc_id, item_id, n_item_shingles, n_shared, n_shared / n_item_shingles AS containment
FROM pairs JOIN sizes USING (item_id) WHERE n_shared >= 0.8 * n_item_shingles
"""

REVISITS_SQL = r"""
WITH bare AS (
  SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS u, md5(coalesce(html, '')) AS tag, strlen(coalesce(html, '')) AS size FROM pages
), parts AS (
  SELECT *, regexp_replace(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?:@]*)', 1)), '^(www[0-9]*|m)\.', '') AS host,
    regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?[^/?:@]*(:[0-9]+)', 1) AS port,
    regexp_replace(regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '(/index)?\.html?$', ''), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'),
      lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[a-z]+|ref|fbclid|gclid|sessionid|sid|phpsessid|jsessionid)(=|$)'))), '&') AS query
  FROM bare
), named AS (
  SELECT page_id, tag, size, CASE WHEN host <> '' THEN host || CASE WHEN port IN (':80', ':443') THEN '' ELSE port END || path
    || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS canonical_url
  FROM parts
), facts AS (
  SELECT *, '"' || tag || '"' AS quoted, ('0x' || substr(tag, 1, 1))::INT AS digit FROM named
), marked AS (
  SELECT page_id, canonical_url, size, tag, CASE WHEN digit < 8 THEN quoted END AS etag,
    CASE WHEN digit BETWEEN 4 AND 11 THEN 'version ' || substr(tag, 1, 8) END AS modified, CASE WHEN digit BETWEEN 8 AND 13 THEN tag END AS digest
  FROM facts
), visits AS (
  SELECT *, 1 AS visit, page_id AS at FROM marked
  UNION ALL SELECT *, 2, page_id + 1 + ('0x' || substr(tag, 1, 2))::INT FROM marked
), met AS (
  SELECT v.*, r.page_id AS old_id, r.size AS old_size, r.etag AS old_etag, r.modified AS old_modified,
    CASE WHEN v.canonical_url IS NULL THEN 'no_url' WHEN r.page_id IS NULL THEN 'no_response' ELSE
      CASE CASE WHEN v.etag IS NOT NULL AND r.etag IS NOT NULL THEN v.etag = r.etag
                WHEN v.modified IS NOT NULL AND r.modified IS NOT NULL THEN v.modified = r.modified
                WHEN v.digest IS NOT NULL AND r.digest IS NOT NULL THEN v.digest = r.digest END
      WHEN true THEN 'resolved' WHEN false THEN 'changed' ELSE 'no_validator' END END AS outcome
  FROM visits v ASOF LEFT JOIN marked r ON v.canonical_url = r.canonical_url AND v.at > r.page_id
)
SELECT page_id, visit::INT AS visit, canonical_url, outcome, CASE WHEN outcome IN ('resolved', 'changed') THEN old_id END AS resolved_page_id,
  CASE WHEN outcome = 'resolved' THEN coalesce(etag, old_etag) ELSE etag END AS etag,
  CASE WHEN outcome = 'resolved' THEN coalesce(modified, old_modified) ELSE modified END AS last_modified,
  'visit ' || page_id AS date, CASE WHEN outcome = 'resolved' THEN old_size::VARCHAR ELSE '0' END AS content_length,
  CASE WHEN outcome = 'resolved' THEN 'text/html' END AS content_type, 'max-age=60' AS cache_control
FROM met
"""

#: Links to and from; ids and what each reaches; the least of it.
_CLASSES = """both_ways AS MATERIALIZED (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT DISTINCT a AS id, a AS r FROM both_ways UNION SELECT reach.id, b FROM reach JOIN both_ways ON r = a
), classes AS (
  SELECT id, min(r) AS class FROM reach GROUP BY id
), counts AS (
  SELECT a AS id, count(*) AS n FROM both_ways GROUP BY a
)"""

VECTORS_SQL = f"""
WITH RECURSIVE good AS MATERIALIZED (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.vec_id < y.vec_id AND len(x.v) = len(y.v)
  WHERE list_dot_product(x.v, y.v) / sqrt(list_dot_product(x.v, x.v) * list_dot_product(y.v, y.v)) >= 0.9
), {_CLASSES}
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(class, vec_id) AS component_id, vec_id = coalesce(class, vec_id) AS kept, 1.0::DOUBLE AS audited_recall
FROM embeddings LEFT JOIN counts ON counts.id = vec_id LEFT JOIN classes ON classes.id = vec_id
"""

JACCARD_SQL = f"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents
), sets AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
           ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle
  FROM texts
), sizes AS MATERIALIZED (
  SELECT doc_id, count(*) AS size FROM sets GROUP BY doc_id
), pairs AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM sets x JOIN sets y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 5 * n >= 4 * (p.size + q.size - n)
), {_CLASSES}
SELECT doc_id, coalesce(class, doc_id) AS class_id, coalesce(n, 0)::BIGINT AS n_links, doc_id = coalesce(class, doc_id) AS kept
FROM documents LEFT JOIN counts ON counts.id = doc_id LEFT JOIN classes ON classes.id = doc_id
"""
