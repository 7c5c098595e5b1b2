"""The pN_ queries and, where SQL can say the same over whole tables, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundstelle.llm import leaks, near_duplicates, percentiles, personal, repeated_lines, scanned, splitting, token_ids
from fundstelle.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _t(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: table(spark, d, name)


chunks, source_documents, documents, query_logs, eval_questions, person_names = map(_t, ("chunks", "source_documents", "documents", "query_logs", "eval_questions", "person_names"))


def p1_found(s: SparkSession, d: str) -> DataFrame:
    return repeated_lines.repeated_lines(chunks(s, d), source_documents(s, d))


def p1_cleaned(s: SparkSession, d: str) -> DataFrame:
    return repeated_lines.without_lines(chunks(s, d), p1_found(s, d))


def _log_percentiles(keys: list[str]) -> Query:
    return lambda s, d: percentiles.percentiles(percentiles.log_sketch(query_logs(s, d), keys), keys, percentiles.SHARES)


def p2_day_sketches(s: SparkSession, d: str) -> DataFrame:
    return percentiles.log_sketch(query_logs(s, d), ["tenant_id", "config_hash", "day"])


def p2_by_day(s: SparkSession, d: str) -> DataFrame:
    """From the finer sketches, combined."""
    return percentiles.percentiles(percentiles.merge([p2_day_sketches(s, d)], ["day"]), ["day"], percentiles.SHARES)


def p3_pieces(s: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(chunks(s, d))


def p3_found(s: SparkSession, d: str) -> DataFrame:
    return p3_pieces(s, d).filter("piece_no = 0").select("chunk_id", "cut_at")


_SIMILAR = {"shingle": 3, "similarity": 0.5, "least_words": 40}


def p4_found(s: SparkSession, d: str) -> DataFrame:
    found = near_duplicates.similar_pairs(chunks(s, d), "id", "content", **_SIMILAR)
    return found.select(F.col("key_a").alias("chunk_id_a"), F.col("key_b").alias("chunk_id_b"))


def p4_groups(s: SparkSession, d: str) -> DataFrame:
    return near_duplicates.groups(chunks(s, d), "id", "content", **_SIMILAR).withColumnRenamed("key", "chunk_id")


def p5_found(s: SparkSession, d: str) -> DataFrame:
    return scanned.scan_noise(chunks(s, d))


def p5_paragraphs(s: SparkSession, d: str) -> DataFrame:
    return scanned.paragraphs(chunks(s, d))


def p6_ids(s: SparkSession, d: str) -> DataFrame:
    return token_ids.token_ids(documents(s, d))


_PARTS = ["question", "gold_passage"]


def p7_found(s: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(documents(s, d), eval_questions(s, d), _PARTS)


def p7_runs(s: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_runs(documents(s, d), eval_questions(s, d), _PARTS)


def p8_found(s: SparkSession, d: str) -> DataFrame:
    return personal.personal_information(documents(s, d), person_names(s, d))


def p8_redacted(s: SparkSession, d: str) -> DataFrame:
    return personal.redacted(documents(s, d), person_names(s, d))


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_cleaned": p1_cleaned,
    "p2_percentiles": _log_percentiles(["tenant_id", "config_hash", "day"]),
    "p2_day_sketches": p2_day_sketches,
    "p2_by_tenant": _log_percentiles(["tenant_id"]),
    "p2_by_config": _log_percentiles(["config_hash"]),
    "p2_by_day": p2_by_day,
    "p3_found": p3_found,
    "p3_pieces": p3_pieces,
    "p4_found": p4_found,
    "p4_groups": p4_groups,
    "p5_found": p5_found,
    "p5_paragraphs": p5_paragraphs,
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p7_runs": p7_runs,
    "p8_found": p8_found,
    "p8_redacted": p8_redacted,
}

#: Names of the p2 buckets' constants as in percentiles.py: base 4000000, logarithm of the bucket ratio at accuracy 0.01.
_P2_ROWS = """
WITH logs AS (
  SELECT id, tenant_id, config_hash, CAST(created_at AT TIME ZONE 'UTC' AS DATE) AS day,
         max(CASE WHEN latency_ms['total_ms'] >= 0 THEN latency_ms['total_ms'] END) AS total_ms,
         max(CASE WHEN latency_ms['retrieval_ms'] >= 0 THEN latency_ms['retrieval_ms'] END) AS retrieval_ms,
         max(CASE WHEN latency_ms['generation_ms'] >= 0 THEN latency_ms['generation_ms'] END) AS generation_ms
  FROM query_logs GROUP BY 1, 2, 3, 4),
long AS (
  SELECT tenant_id, config_hash, day, 'total_ms' AS metric, total_ms AS v FROM logs UNION ALL
  SELECT tenant_id, config_hash, day, 'retrieval_ms', retrieval_ms FROM logs UNION ALL
  SELECT tenant_id, config_hash, day, 'generation_ms', generation_ms FROM logs),
bucketed AS (
  SELECT *, CASE WHEN v > 0 THEN 4000000 + CAST(ceil(ln(v) / ln(1.01 / 0.99)) AS INT) WHEN v = 0 THEN 0 END AS bucket FROM long)
"""


def _p2_sql(keys: str) -> str:
    return _P2_ROWS + f""",
sketched AS (SELECT {keys}, metric, bucket, count(*) AS n FROM bucketed GROUP BY {keys}, metric, bucket),
ranked AS (
  SELECT *, sum(n) FILTER (WHERE bucket IS NOT NULL) OVER (PARTITION BY {keys}, metric) AS total,
         sum(CASE WHEN bucket IS NOT NULL THEN n ELSE 0 END) OVER (PARTITION BY {keys}, metric ORDER BY bucket NULLS FIRST) AS upto,
         CASE WHEN bucket = 0 THEN 0.0 ELSE pow(1.01 / 0.99, bucket - 4000000) * (2 / (1 + 1.01 / 0.99)) END AS value
  FROM sketched)
SELECT {keys}, metric, CAST(coalesce(sum(n) FILTER (WHERE bucket IS NOT NULL), 0) AS BIGINT) AS n_values,
       CAST(coalesce(sum(n) FILTER (WHERE bucket IS NULL), 0) AS BIGINT) AS n_null,
       min(value) FILTER (WHERE bucket IS NOT NULL AND upto >= floor(0.5 * (total - 1)) + 1) AS p50,
       min(value) FILTER (WHERE bucket IS NOT NULL AND upto >= floor(0.95 * (total - 1)) + 1) AS p95,
       min(value) FILTER (WHERE bucket IS NOT NULL AND upto >= floor(0.99 * (total - 1)) + 1) AS p99
FROM ranked GROUP BY {keys}, metric"""


_P1 = """
WITH named AS (SELECT DISTINCT id AS document_id, filename FROM source_documents WHERE filename IS NOT NULL),
own AS (SELECT DISTINCT c.id, d.filename, c.content FROM chunks c JOIN named d USING (document_id) WHERE c.id IS NOT NULL),
sizes AS (SELECT filename, count(DISTINCT id) AS n_chunks FROM own GROUP BY filename),
cut AS (SELECT id, filename, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS line_no FROM own),
letters AS (SELECT id, filename, line_no, regexp_replace(lower(line), '[^\\p{L}]', '', 'g') AS l FROM cut),
counted AS (SELECT filename, l, count(DISTINCT id) AS n FROM letters WHERE l <> '' GROUP BY filename, l)
SELECT DISTINCT id AS chunk_id, CAST(line_no AS INT) AS line_no FROM letters JOIN counted USING (filename, l) JOIN sizes USING (filename)
WHERE n >= 20 AND n >= 0.15 * n_chunks"""

_TOKENS = r"len(list_filter(regexp_split_to_array({}, '[\s\x0B\x1C-\x1F\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+'), lambda t: t <> ''))"
_P3 = (
    r"""
WITH own AS (SELECT DISTINCT id, content FROM chunks WHERE id IS NOT NULL AND """ + _TOKENS.format("content") + r""" > 800),
units AS (SELECT id, regexp_split_to_array(content, '\n\s*\n') AS paragraphs, string_split(content, chr(10)) AS lines,
  flatten(list_transform(string_split(content, chr(10)), lambda x: string_split(regexp_replace(x, '([.!?])\s+(\p{Lu})', '\1' || chr(1) || '\2', 'g'), chr(1)))) AS sentences FROM own)
SELECT id AS chunk_id, CASE WHEN list_max(list_transform(paragraphs, lambda u: """ + _TOKENS.format("u") + """)) <= 800 THEN 'paragraph'
  WHEN list_max(list_transform(lines, lambda u: """ + _TOKENS.format("u") + """)) <= 800 THEN 'line'
  WHEN list_max(list_transform(sentences, lambda u: """ + _TOKENS.format("u") + """)) <= 800 THEN 'sentence' ELSE 'word' END AS cut_at FROM units"""
)

_P4 = r"""
WITH own AS (SELECT id, regexp_extract_all(lower(first(content)), '[\p{L}\p{N}]+') AS w FROM chunks WHERE id IS NOT NULL AND content IS NOT NULL GROUP BY id),
s AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS shingle FROM own, unnest(range(1, len(w) - 1)) AS u(i) WHERE len(w) >= 40),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
common AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM s a JOIN s b USING (shingle) WHERE a.id < b.id GROUP BY a.id, b.id)
SELECT a AS chunk_id_a, b AS chunk_id_b FROM common JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE k >= 0.5 * (x.n + y.n - k)"""

_P1_CLEANED = f"""
WITH found AS ({_P1}), gone AS (SELECT chunk_id, list(line_no) AS gone FROM found GROUP BY 1), texts AS (SELECT id AS chunk_id, first(content) AS content FROM chunks WHERE id IS NOT NULL GROUP BY 1)
SELECT chunk_id, CASE WHEN gone IS NULL THEN content ELSE array_to_string(list_filter(string_split(content, chr(10)), lambda x, i: NOT list_contains(gone, CAST(i - 1 AS INT))), chr(10)) END AS content
FROM texts LEFT JOIN gone USING (chunk_id)"""

_P4_GROUPS = f"""
WITH RECURSIVE pairs AS ({_P4}), texts AS (SELECT id, first(content) AS content FROM chunks WHERE id IS NOT NULL AND content IS NOT NULL GROUP BY 1),
links AS (SELECT chunk_id_a AS a, chunk_id_b AS b FROM pairs UNION SELECT chunk_id_b, chunk_id_a FROM pairs UNION SELECT x.id, y.id FROM texts x JOIN texts y ON x.content = y.content),
reach AS (SELECT id AS a, id AS b FROM texts UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
part AS (SELECT a AS chunk_id, min(b) AS group_id FROM reach GROUP BY a), sizes AS (SELECT group_id, count(DISTINCT content) AS n_texts FROM part JOIN texts ON id = chunk_id GROUP BY 1)
SELECT chunk_id, group_id, n_texts FROM part JOIN sizes USING (group_id)"""

ORACLE: dict[str, str] = {
    "p1_cleaned": _P1_CLEANED,
    "p4_groups": _P4_GROUPS,
    "p3_found": _P3,
    "p4_found": _P4,
    "p1_found": _P1,
    "p2_percentiles": _p2_sql("tenant_id, config_hash, day"),
    "p2_by_tenant": _p2_sql("tenant_id"),
    "p2_by_config": _p2_sql("config_hash"),
    "p2_by_day": _p2_sql("day"),
    "p2_day_sketches": _P2_ROWS + "SELECT tenant_id, config_hash, day, metric, bucket, count(*) AS n FROM bucketed GROUP BY ALL",
}
