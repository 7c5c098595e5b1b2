"""All queries of the core with their SQL. Query sets of searches are the rows whose number is divisible by 50."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fundstelle.functions import text as T
from fundstelle.functions.python import compose_rows
from fundstelle.operators import chunking, context, evaluation, ingest, lexical, metrics, operations, ranking, reports, vectors
from fundstelle.plans import evaluation as plans_evaluation
from fundstelle.plans import index, retrieval
from fundstelle.session import cut_lineage
from fundstelle.sources.tables import latest_documents, table
from fundstelle.streaming import streams
from fundstelle.tenancy import TenantScope

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: Shared tables of the SQL side: one row per id.
_WITH = r"""
WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ordinal) AS rn FROM chunks WHERE id IS NOT NULL) WHERE rn = 1),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN status IN ('ready', 'failed') THEN 3 WHEN status = 'embedding' THEN 2 WHEN status = 'parsing' THEN 1 ELSE 0 END DESC,
      created_at DESC NULLS LAST, filename NULLS LAST) AS rn FROM source_documents WHERE id IS NOT NULL) WHERE rn = 1),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY received_at) AS rn FROM query_logs WHERE id IS NOT NULL) WHERE rn = 1),
q AS (SELECT id AS query_id, question FROM eval_questions WHERE CAST(substr(id, 2) AS INT) % 50 = 0)
"""


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; SQL that starts with a comma or SELECT gets the shared tables before it."""

    def register(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLE[key] = sql if sql.lstrip().startswith("WITH") else _WITH + sql
        return f

    return register


def _once(df: DataFrame) -> DataFrame:
    return df.filter("id IS NOT NULL").dropDuplicates(["id"])


def _chunks(s: SparkSession, d: str) -> DataFrame:
    return _once(table(s, d, "chunks"))


def _docs(s: SparkSession, d: str) -> DataFrame:
    return latest_documents(table(s, d, "source_documents"))


def _logs(s: SparkSession, d: str) -> DataFrame:
    return _once(table(s, d, "query_logs"))


def _queries(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "eval_questions").select(F.col("id").alias("query_id"), "question")
    return q.filter(F.substring("query_id", 2, 9).cast("int") % 50 == 0)


def _tenant_queries(s: SparkSession, d: str) -> DataFrame:
    """The query set, each question within one of the tenants with most chunks (the first question in the first, and so on)."""
    size = _chunks(s, d).filter("tenant_id IS NOT NULL").groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"))
    numbered = size.withColumn("number", F.row_number().over(Window.orderBy(F.col("n").desc(), "tenant_id"))).select("tenant_id", "number")  # one row per tenant
    q = _queries(s, d).withColumn("number", (F.substring("query_id", 2, 9).cast("int") / 50).cast("int"))
    return q.join(numbered, "number").select("query_id", "tenant_id", "question")


def _indexed(s: SparkSession, d: str) -> tuple[index.Index, DataFrame, DataFrame, DataFrame]:
    c = _chunks(s, d)
    return index.temporary(c, index.hashed()), c, _docs(s, d), _tenant_queries(s, d)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Questions to cited answers by all three branches, each within its tenant."""
    return retrieval.answer(*_indexed(spark, folder), "structural")


# --- retrieval -------------------------------------------------------------------------------------------------------

_VEC = """WITH v AS (SELECT vec_id, label, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS len FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda x: CAST(x[1] AS DOUBLE) * x[2])) / (q.len * v.len) AS score
      FROM v q JOIN v ON {on} WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s)
SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10"""


def _vectors(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"), "label")
    return e, e.filter("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")


@query(_VEC.format(on="true"))
def knn_topk_batch(s, d):
    e, q = _vectors(s, d)
    return vectors.nearest(e, q, 10).withColumn("score", F.round("score", 6))


@query(_VEC.format(on="v.label = q.label"))
def knn_filtered_by_model(s, d):
    e, q = _vectors(s, d)
    return vectors.nearest(e, q, 10, ["label"]).withColumn("score", F.round("score", 6))


@query(_VEC.format(on="true").replace("q.vec_id % 50 = 0", "q.vec_id = 0"))
def knn_topk_single(s, d):
    e, q = _vectors(s, d)
    return vectors.nearest(e, q.filter("query_id = 0"), 10).withColumn("score", F.round("score", 6))


_TERMS = r"""list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"""
_MATCH = rf""", t AS (SELECT id AS chunk_id, unnest({_TERMS.format('content_norm')}) AS term FROM c),
n AS (SELECT chunk_id, term, count(*) AS n FROM t GROUP BY ALL),
w AS (SELECT query_id, unnest(list_distinct({_TERMS.format('question')})) AS term, len(list_distinct({_TERMS.format('question')})) AS n_terms FROM q),
m AS (SELECT query_id, chunk_id, n_terms, count(*) AS n_matched, CAST(sum(n) AS BIGINT) AS occurrences FROM n JOIN w USING (term) GROUP BY ALL)
"""


@query(_MATCH + """, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n_matched DESC, occurrences DESC, chunk_id) AS rank FROM m)
SELECT query_id, chunk_id, n_matched, occurrences, CAST(rank AS INT) AS rank FROM r WHERE rank <= 40""")
def fts_any(s, d):
    return lexical.search_terms(_chunks(s, d), _queries(s, d), 40)


@query(rf""", t AS (SELECT id AS chunk_id, list_distinct({_TERMS.format('content_norm')}) AS terms FROM c),
w AS (SELECT id AS query_id, list_distinct({_TERMS.format("section_path || ' ' || heading")}) AS q FROM c WHERE section_path IS NOT NULL AND heading IS NOT NULL AND ordinal % 50 = 0)
SELECT query_id, chunk_id FROM w JOIN t ON list_has_all(terms, q) WHERE len(q) > 0""")
def fts_all(s, d):
    """Chunks that have all terms of a section's path and heading, for every section with an ordinal divisible by 50."""
    c = _chunks(s, d)
    q = c.filter("section_path IS NOT NULL AND heading IS NOT NULL AND ordinal % 50 = 0").select(F.col("id").alias("query_id"), F.concat_ws(" ", "section_path", "heading").alias("question"))
    return lexical.match(c, q, every=True).select("query_id", "chunk_id")


@query(rf""", t AS (SELECT id AS chunk_id, {_TERMS.format('content_norm')} AS terms FROM c),
w AS (SELECT id AS query_id, list_filter(regexp_split_to_array(lower(heading), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS q FROM c WHERE heading IS NOT NULL AND ordinal % 50 = 0)
SELECT query_id, chunk_id FROM w JOIN t ON contains(' ' || array_to_string(terms, ' ') || ' ', ' ' || q[1] || ' ' || q[2] || ' ') WHERE len(q) > 1 AND NOT list_contains(terms, 'lieferant')""")
def fts_web(s, d):
    """The first two words of a heading as a phrase, without chunks that name a supplier."""
    c = _chunks(s, d)
    h = c.filter("heading IS NOT NULL AND ordinal % 50 = 0").select(F.col("id").alias("query_id"), T.terms(F.col("heading")).alias("h")).filter("size(h) > 1")
    q = h.select("query_id", F.concat(F.lit('"'), F.col("h")[0], F.lit(" "), F.col("h")[1], F.lit('" -lieferant')).alias("question"))
    return lexical.match_web(c, q)


# The place in the document would nearly always pick first chunks, so these choose their sections by a number of the id.
_OF_ID = "CAST(('0x' || substr(md5(id), 1, 6)) AS BIGINT) % 50 = 0"


def _of_id() -> Column:
    return F.conv(F.substring(F.md5("id"), 1, 6), 16, 10).cast("long") % 50 == 0


@query(ORACLE["fts_all"].replace("ordinal % 50 = 0", _OF_ID))
def fts_all_by_id(s, d):
    """As ``fts_all``, for sections from all places of the documents."""
    c = _chunks(s, d)
    q = c.filter("section_path IS NOT NULL AND heading IS NOT NULL").filter(_of_id()).select(F.col("id").alias("query_id"), F.concat_ws(" ", "section_path", "heading").alias("question"))
    return lexical.match(c, q, every=True).select("query_id", "chunk_id")


@query(ORACLE["fts_web"].replace("ordinal % 50 = 0", _OF_ID))
def fts_web_by_id(s, d):
    """As ``fts_web``, for headings from all places of the documents."""
    c = _chunks(s, d)
    h = c.filter("heading IS NOT NULL").filter(_of_id()).select(F.col("id").alias("query_id"), T.terms(F.col("heading")).alias("h")).filter("size(h) > 1")
    q = h.select("query_id", F.concat(F.lit('"'), F.col("h")[0], F.lit(" "), F.col("h")[1], F.lit('" -lieferant')).alias("question"))
    return lexical.match_web(c, q)


@query()
def fts_cover_density(s, d):
    return lexical.search_german(_chunks(s, d), _queries(s, d), 40)


@query(rf""", w AS (SELECT id AS chunk_id, unnest(list_distinct({_TERMS.format('coalesce(heading, section_path)')})) AS w FROM c)
SELECT DISTINCT chunk_id, substr('  ' || w || ' ', CAST(i AS INT), 3) AS trigram FROM w, unnest(range(1, len(w) + 2)) AS u(i)""")
def trigram_extract(s, d):
    return _chunks(s, d).select(F.col("id").alias("chunk_id"), F.explode(T.trigrams(F.coalesce("heading", "section_path"))).alias("trigram"))


@query()
def word_similarity_topk(s, d):
    return lexical.search_trigrams(_chunks(s, d), _queries(s, d), 10)


#: The three rankings of a search in forms that SQL has too: matched terms, cosine of stored embeddings, trigrams in common with the heading.
#: An embedding belongs to the least chunk whose number (a digest of its id) names it, a question's has its own number.
_BRANCHES = _MATCH + rf""",
e AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS len FROM embeddings), ne AS (SELECT count(*) AS n FROM embeddings),
ce AS (SELECT CAST(('0x' || substr(md5(id), 1, 6)) AS BIGINT) % (SELECT n FROM ne) AS vec_id, min(id) AS chunk_id FROM c GROUP BY 1),
cs AS (SELECT query_id, chunk_id, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: CAST(x[1] AS DOUBLE) * x[2])) / (a.len * b.len) AS score
  FROM q JOIN e a ON a.vec_id = CAST(substr(query_id, 2) AS INT) % (SELECT n FROM ne) CROSS JOIN ce JOIN e b ON b.vec_id = ce.vec_id),
tw AS (SELECT id AS chunk_id, unnest(list_distinct({_TERMS.format('heading')})) AS w FROM c), qw AS (SELECT query_id, unnest(list_distinct({_TERMS.format('question')})) AS w FROM q),
tt AS (SELECT DISTINCT chunk_id, substr('  ' || w || ' ', CAST(i AS INT), 3) AS t FROM tw, unnest(range(1, len(w) + 2)) AS u(i)), qt AS (SELECT DISTINCT query_id, substr('  ' || w || ' ', CAST(i AS INT), 3) AS t FROM qw, unnest(range(1, len(w) + 2)) AS u(i)),
tc AS (SELECT query_id, chunk_id, count(*) AS n FROM tt JOIN qt USING (t) GROUP BY ALL),
b0 AS (SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY n_matched DESC, occurrences DESC, chunk_id) AS rank FROM m) WHERE rank <= 40),
b1 AS (SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM cs) WHERE rank <= 40),
b2 AS (SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, chunk_id) AS rank FROM tc) WHERE rank <= 40),
u AS (SELECT *, 0 AS b FROM b0 UNION ALL SELECT *, 1 FROM b1 UNION ALL SELECT *, 2 FROM b2)
"""


def _branches(s: SparkSession, d: str) -> list[DataFrame]:
    c, q = _chunks(s, d), _queries(s, d)
    m = lexical.match(c, q, every=False)
    e = table(s, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    n = F.lit(e.count())
    owners = c.select("id", (F.conv(F.substring(F.md5("id"), 1, 6), 16, 10).cast("long") % n).alias("vec_id")).groupBy("vec_id").agg(F.min("id").alias("chunk_id"))
    asked = q.select("query_id", (F.substring("query_id", 2, 9).cast("long") % n).alias("vec_id")).join(e, "vec_id").select("query_id", "vec")
    trigrams = lexical.trigram_postings(c, "heading").join(q.select("query_id", F.explode(T.trigrams(F.col("question"))).alias("trigram")), "trigram")
    return [
        ranking.top_k(m, 40, order=[F.col("n_matched").desc(), F.col("occurrences").desc(), F.col("chunk_id")]),
        vectors.nearest(owners.join(e, "vec_id").select("chunk_id", "vec"), asked, 40).select("query_id", "chunk_id", "rank"),
        ranking.top_k(trigrams.groupBy("query_id", "chunk_id").agg(F.count(F.lit(1)).alias("n")), 40, order=[F.col("n").desc(), F.col("chunk_id")]).select("query_id", "chunk_id", "rank"),
    ]


_RRF = """, f AS (SELECT query_id, chunk_id, sum({w} / (60 + rank)) AS score, min(b * 1000 + rank) AS tie FROM u GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, tie, chunk_id) AS rank FROM f)
"""


@query(_BRANCHES + _RRF.format(w="1.0") + "SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 40")
def rrf_three_branches(s, d):
    return ranking.rrf(_branches(s, d), top=40).withColumn("score", F.round("score", 6))


@query(_BRANCHES + _RRF.format(w="[2.0, 1.0, 0.5][b + 1]") + "SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 40")
def rrf_weighted(s, d):
    return ranking.rrf(_branches(s, d), weights=[2.0, 1.0, 0.5], top=40).withColumn("score", F.round("score", 6))


@query(_BRANCHES + _RRF.format(w="1.0") + """SELECT query_id, r.chunk_id, c.document_id, filename, page_from, page_to, section_path, version_label, ocr, round(score, 6) AS score, CAST(rank AS INT) AS rank
FROM r JOIN c ON c.id = r.chunk_id LEFT JOIN d ON d.id = c.document_id WHERE rank <= 10""")
def hybrid_rehydrate(s, d):
    hits = retrieval.hydrate(ranking.rrf(_branches(s, d), top=10), _chunks(s, d), _docs(s, d))
    return hits.select("query_id", "chunk_id", "document_id", "filename", "page_from", "page_to", "section_path", "version_label", "ocr", F.round("score", 6).alias("score"), "rank")


@query(_BRANCHES + """, f AS (SELECT query_id, chunk_id, min(b * 1000 + rank) AS place FROM u WHERE b <> 1 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank FROM f) SELECT query_id, chunk_id, CAST(rank AS INT) AS rank FROM r WHERE rank <= 50""")
def fts_concat_trigram(s, d):
    b = _branches(s, d)
    return ranking.concat_ranked([b[0], b[2]], 50)


@query(_BRANCHES + """, h AS (SELECT b0.query_id, b0.chunk_id, b0.rank AS incoming, m.n_matched AS score FROM b0 JOIN m USING (query_id, chunk_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, incoming) AS rank FROM h) SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 8""")
def rerank_stable(s, d):
    return ranking.rerank(_branches(s, d)[0].withColumn("score", F.col("n_matched")), 8).select("query_id", "chunk_id", "score", "rank")


@query(_BRANCHES + "SELECT query_id, chunk_id, CAST(rank AS INT) AS rank FROM b0 WHERE rank <= 8")
def rerank_noop(s, d):
    return ranking.truncate(_branches(s, d)[0], 8).select("query_id", "chunk_id", "rank")


@query(_BRANCHES + """, p AS (SELECT sha256('ns' || chr(0) || question || chr(0) || content) AS key, b0.rank FROM b0 JOIN q USING (query_id) JOIN c ON c.id = b0.chunk_id)
SELECT DISTINCT key FROM p WHERE key NOT IN (SELECT key FROM p WHERE rank <= 20)""")
def rerank_cache_misses(s, d):
    """Keys to score when the first half of each ranking is cached."""
    hits = _branches(s, d)[0].join(_queries(s, d), "query_id").join(_chunks(s, d).select(F.col("id").alias("chunk_id"), "content"), "chunk_id")
    pairs = hits.withColumn("key", ranking.cache_key("ns", F.col("question"), F.col("content")))
    cache = pairs.filter("rank <= 20").select("key", F.lit(1.0).alias("score")).dropDuplicates(["key"])
    return ranking.cached_scores(pairs, cache, lambda m: m.withColumn("score", ranking.token_overlap(F.col("question"), F.col("content"))))[1].select("key")


@query()
def hybrid_search(s, d):
    return retrieval.search(*_indexed(s, d), "structural").select("query_id", "chunk_id", "filename", F.round("score", 6).alias("score"), "rank")


@query()
def answers(s, d):
    return flagship(s, d).drop("retrieval_ms", "generation_ms")


@query(_BRANCHES + """, a AS (SELECT query_id, chunk_id, rank FROM b0 WHERE rank <= 5), x AS (SELECT query_id, chunk_id, rank FROM b2 WHERE rank <= 5)""" + _RRF.format(w="1.0") + """
SELECT r.query_id, r.chunk_id, CAST(r.rank AS INT) AS rank FROM r WHERE r.rank <= 5 AND NOT EXISTS (SELECT 1 FROM a WHERE a.query_id = r.query_id AND a.chunk_id = r.chunk_id)
AND NOT EXISTS (SELECT 1 FROM x WHERE x.query_id = r.query_id AND x.chunk_id = r.chunk_id)""")
def branch_promotions(s, d):
    """Fused top 5 that stand in neither the first nor the last branch's top 5."""
    b = _branches(s, d)
    return metrics.promotions(ranking.rrf(b, top=5), [b[0], b[2]], 5)


# --- tenancy ---------------------------------------------------------------------------------------------------------


@query("SELECT id, document_id, ordinal FROM c WHERE tenant_id = (SELECT min(tenant_id) FROM chunks)")
def tenant_scoped_scan(s, d):
    c = _chunks(s, d)
    return TenantScope(table(s, d, "chunks").agg(F.min("tenant_id")).first()[0]).rows(c).select("id", "document_id", "ordinal")


@query("SELECT id, document_id, ordinal FROM c WHERE false")
def tenant_null_fails_closed(s, d):
    return TenantScope(None).rows(_chunks(s, d)).select("id", "document_id", "ordinal")


# --- context and answers ---------------------------------------------------------------------------------------------

#: A ranking per document: its chunks in order of the text.
_RANKED = r""", h AS (SELECT c.document_id AS query_id, c.document_id, c.id AS chunk_id, row_number() OVER (PARTITION BY c.document_id ORDER BY ordinal, c.id) AS rank, section_path, content, page_from, page_to, filename, version_label, token_count
  FROM c JOIN d ON d.id = c.document_id),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, document_id, CASE WHEN section_path <> '' THEN section_path ELSE chr(1) || rank END ORDER BY rank) AS f FROM h) WHERE f = 1)
"""
_SELECTED = _RANKED + """, o AS (SELECT *, sum(token_count) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS total, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM k),
sel AS (SELECT * FROM o WHERE total <= 1000 OR place = 1)
"""


def _ranked(s: SparkSession, d: str) -> DataFrame:
    c = _chunks(s, d).select(F.col("document_id").alias("query_id"), "document_id", F.col("id").alias("chunk_id"), "ordinal", "section_path", "content", "page_from", "page_to", "token_count")
    docs = _docs(s, d).select(F.col("id").alias("document_id"), "filename", "version_label")
    order = Window.partitionBy("query_id").orderBy("ordinal", "chunk_id")
    return c.join(docs, "document_id").withColumn("rank", F.row_number().over(order))


def _selected(s: SparkSession, d: str) -> DataFrame:
    return context.select_context(_ranked(s, d), 1000, F.col("token_count"))


@query(_SELECTED + "SELECT query_id, chunk_id, CAST(place AS INT) AS place FROM sel")
def context_budget(s, d):
    return _selected(s, d).select("query_id", "chunk_id", "place")


@query(_RANKED + "SELECT query_id, chunk_id, CAST(rank AS INT) AS rank FROM k")
def context_section_dedup(s, d):
    return context.select_context(_ranked(s, d), 2**31 - 1, F.lit(0)).select("query_id", "chunk_id", "rank")


_NEUTRAL = r"""regexp_replace(regexp_replace({}, '(?i)<(/?quelle[^>]*)>', '‹\1›', 'g'), '\[(S\d+)\]', '(\1)', 'g')"""
_PAGES = "CASE WHEN page_from = page_to THEN 'Seite ' || page_from ELSE 'Seite ' || page_from || '–' || page_to END"
_HEAD = f"concat_ws(' | ', filename, {_PAGES}, nullif(version_label, ''), nullif(section_path, ''))"


@query(_SELECTED + f"""SELECT query_id, string_agg('[S' || place || '] ' || {_NEUTRAL.format(_HEAD)} || chr(10) || {_NEUTRAL.format('content')}, chr(10) || chr(10) ORDER BY place) AS context, count(*) AS n_sources
FROM sel GROUP BY query_id""")
def context_block_render(s, d):
    return context.context_block(_selected(s, d))


@query(rf"""WITH t AS (SELECT doc_id, text FROM documents) SELECT doc_id, {_NEUTRAL.format("text || ' [S1] <quelle id=1> x </Quelle>'")} AS neutral FROM t""")
def neutralise_markup(s, d):
    return table(s, d, "documents").select("doc_id", T.neutral(F.concat("text", F.lit(" [S1] <quelle id=1> x </Quelle>"))).alias("neutral"))


# Codes in SQL: RE2 has ASCII word bounds, so the character before is matched and put back.
_NORM = r"""trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace({}, '(^|[^\p{{L}}\p{{N}}_])([A-ZÄÖÜ]{{2,4}})[ -]?(\d+(\.\d+)+)\b', '\1\2\3', 'g'),
 '(?i)(^|[^\p{{L}}\p{{N}}_])(UN|ECE)[ -]?R[ -]?(\d+[A-Z]?)\b', '\1\2R\3', 'g'), '(?i)(^|[^\p{{L}}\p{{N}}_])R[ -]?(\d+[A-Z]?)\b', '\1R\2', 'g')), '[\s\x0B\x1C-\x1F\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g'), ' ')"""
_CODES = r"""list_distinct(list_transform(regexp_extract_all({}, '(?:^|[^\p{{L}}\p{{N}}_])([A-ZÄÖÜ]{{2,4}}[ -]?\d+(?:\.\d+)+)\b', 1), lambda x: lower(regexp_replace(x, '[ -]', '', 'g'))))"""


@query("SELECT id, " + _NORM.format("content") + " AS norm FROM c")
def normalize_codes(s, d):
    return compose_rows(_chunks(s, d).select("id", "content"), "content").select("id", T.normalize_codes(F.col("content")).alias("norm"))


@query("SELECT DISTINCT id, unnest(" + _CODES.format("content") + ") AS code FROM c")
def extract_codes(s, d):
    return _chunks(s, d).select("id", F.explode(T.extract_codes(F.col("content"))).alias("code"))


@query(_SELECTED + """, e AS (SELECT query_id, place, version_label, unnest(""" + _CODES.format("content") + """) AS code FROM sel WHERE version_label IS NOT NULL),
e2 AS (SELECT filename, place, version_label, code FROM (SELECT s2.filename, s2.version_label, s2.document_id, s2.chunk_id, row_number() OVER (PARTITION BY s2.filename ORDER BY s2.document_id, s2.place) AS place, unnest(""" + _CODES.format("s2.content") + """) AS code FROM sel s2 WHERE s2.version_label IS NOT NULL))
SELECT DISTINCT filename AS query_id, code, n_labels FROM (SELECT filename, code, count(DISTINCT version_label) AS n_labels FROM e2 GROUP BY ALL) WHERE n_labels >= 2""")
def version_conflicts(s, d):
    """Codes with several version labels among the selected sources of a filename."""
    own = _selected(s, d).withColumn("query_id", F.col("filename")).withColumn("place", F.struct("document_id", "place"))
    return context.version_conflicts(own).select("query_id", "code", F.size("labels").cast("long").alias("n_labels"))


_MARKERS = r"list_distinct(regexp_extract_all(answer, '\[(S\d+)\]', 1))"


@query(f"SELECT id, unnest({_MARKERS}) AS marker FROM l")
def citation_markers(s, d):
    return _logs(s, d).select("id", F.explode(T.markers(F.col("answer"))).alias("marker"))


@query(rf""", a AS (SELECT id, answer || ' [S9] x [S2]' AS answer, list_transform(range(1, len(retrieved_ids) + 1), lambda x: 'S' || x) AS known FROM l),
b AS (SELECT *, {_MARKERS} AS found FROM a),
v AS (SELECT id, list_filter(found, lambda m: list_contains(known, m)) AS cited, list_filter(found, lambda m: NOT list_contains(known, m)) AS bad, answer FROM b),
x AS (SELECT id, cited, bad, CASE WHEN len(bad) = 0 THEN answer ELSE regexp_replace(answer, ' ?\[(' || array_to_string(bad, '|') || ')\]', '', 'g') END AS cut FROM v)
SELECT id, CAST(len(cited) AS INT) AS n_cited, CAST(len(bad) AS INT) AS invented, CASE WHEN trim(cut) = 'NICHT_GEFUNDEN' OR len(cited) = 0 THEN 'NICHT_GEFUNDEN' ELSE trim(cut) END AS validated FROM x WHERE cut IS NOT NULL""")
def citation_validate(s, d):
    """Answers with an invented and a doubtful marker added."""
    known = F.when(F.size("retrieved_ids") > 0, F.transform(F.sequence(F.lit(1), F.size("retrieved_ids")), lambda n: F.concat(F.lit("S"), n))).otherwise(F.array().cast("array<string>"))
    a = _logs(s, d).filter("answer IS NOT NULL AND retrieved_ids IS NOT NULL").select("id", F.concat("answer", F.lit(" [S9] x [S2]")).alias("answer"), known.alias("known"))
    return context.validate_citations(a).select("id", F.size("cited").alias("n_cited"), "invented", "validated")


@query("SELECT id, CASE WHEN length(trim(content)) <= 240 THEN trim(content) ELSE rtrim(substr(trim(content), 1, 240)) || '…' END AS snippet FROM c")
def snippet_240(s, d):
    return _chunks(s, d).select("id", T.snippet(F.col("content")).alias("snippet"))


# --- chunking --------------------------------------------------------------------------------------------------------

_BLANK = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@query(rf"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '{_BLANK}'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(0, 1 + greatest(0, CAST(ceil((len(w) - 50) / 40.0) AS INT)))) AS i FROM w WHERE len(w) > 0)
SELECT doc_id, CAST(i AS INT) AS ordinal, CAST(i * 40 AS INT) AS start_word, CAST(len(w[CAST(i * 40 + 1 AS INT):CAST(i * 40 + 50 AS INT)]) AS INT) AS n_words, array_to_string(w[CAST(i * 40 + 1 AS INT):CAST(i * 40 + 50 AS INT)], ' ') AS content FROM i""")
def fixed_window_chunks(s, d):
    return chunking.fixed_windows(table(s, d, "documents"), "doc_id", "text", 50, 0.2)


#: Lines of documents as blocks; numbered ones and paragraphs are titles. The letters before a requirement's number are left out, so that it is one.
_LINES = r"""WITH t AS (SELECT doc_id AS document_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
b0 AS (SELECT document_id, regexp_replace(unnest(ls), '^[A-Z]{2,3}[ -](\d+(\.\d+)+)', '\1') AS text, CAST(generate_subscripts(ls, 1) - 1 AS INT) AS block_no FROM t),
b AS (SELECT *, coalesce(nullif(regexp_replace(regexp_extract(text, '^(§\s*\d+[a-z]?)', 1), '\s', '', 'g'), ''), nullif(regexp_extract(text, '^(\d+(?:\.\d+)*)\s', 1), '')) AS code
  FROM b0 WHERE trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') <> ''),
f AS (SELECT *, last_value(code IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY block_no ROWS UNBOUNDED PRECEDING) AS section_path FROM b)
"""


def _blocks(s: SparkSession, d: str) -> DataFrame:
    lines = chunking.lines_as_blocks(table(s, d, "documents").filter("text IS NOT NULL"), "doc_id", "text")
    own = lines.withColumn("text", F.regexp_replace("text", r"^[A-Z]{2,3}[ -](\d+(\.\d+)+)", "$1")).withColumn("is_title", T.section_code(F.col("text")).isNotNull())
    return chunking.fill_sections(own).withColumn("page", F.lit(1))


@query(_LINES + "SELECT document_id, block_no, section_path FROM f")
def section_fill_down(s, d):
    return _blocks(s, d).select("document_id", "block_no", "section_path")


_WC = rf"CAST(len(list_filter(regexp_split_to_array(text, '{_BLANK}'), lambda x: x <> '')) AS INT)"
_GROUPS = _LINES + f""", g0 AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY document_id ORDER BY block_no) > 1 AND section_path IS DISTINCT FROM lag(section_path) OVER (PARTITION BY document_id ORDER BY block_no) THEN 1 ELSE 0 END AS new FROM f),
g1 AS (SELECT *, sum(new) OVER (PARTITION BY document_id ORDER BY block_no ROWS UNBOUNDED PRECEDING) AS run FROM g0),
g AS (SELECT document_id, CAST(run AS INT) AS run, min(section_path) AS path, CAST(sum({_WC}) AS INT) AS n_words, CAST(count(*) AS INT) AS n_blocks, min(block_no) AS first_block FROM g1 GROUP BY document_id, run)
"""


@query(_GROUPS + "SELECT document_id, run, path, n_words, n_blocks FROM g")
def structural_groups(s, d):
    return chunking.structural_groups(_blocks(s, d)).select("document_id", "run", "path", "n_words", "n_blocks")


@query(_GROUPS.replace("WITH t AS", "WITH RECURSIVE t AS", 1) + """, o AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY run) AS k FROM g),
m AS (SELECT document_id, k, path, n_words AS acc, n_blocks AS blocks, n_words >= 100 AS done FROM o WHERE k = 1
  UNION ALL SELECT o.document_id, o.k, o.path, CASE WHEN m.done THEN o.n_words ELSE m.acc + o.n_words END, CASE WHEN m.done THEN o.n_blocks ELSE m.blocks + o.n_blocks END,
     CASE WHEN m.done THEN o.n_words ELSE m.acc + o.n_words END >= 100 FROM m JOIN o ON o.document_id = m.document_id AND o.k = m.k + 1)
SELECT document_id, path, CAST(acc AS INT) AS n_words, CAST(blocks AS INT) AS n_blocks FROM m WHERE done OR k = (SELECT max(k) FROM o WHERE o.document_id = m.document_id)""")
def structural_merge(s, d):
    return chunking.merged_sections(chunking.structural_groups(_blocks(s, d))).select("document_id", "path", "n_words", "n_blocks")


@query(_GROUPS.replace("WITH t AS", "WITH RECURSIVE t AS", 1) + f""", o AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY run) AS k FROM g),
m AS (SELECT document_id, k, n_words AS acc, n_words >= 100 AS done FROM o WHERE k = 1
  UNION ALL SELECT o.document_id, o.k, CASE WHEN m.done THEN o.n_words ELSE m.acc + o.n_words END, CASE WHEN m.done THEN o.n_words ELSE m.acc + o.n_words END >= 100 FROM m JOIN o ON o.document_id = m.document_id AND o.k = m.k + 1),
gn AS (SELECT o.document_id, o.run, o.k, o.path, coalesce(sum(CAST(done AS INT)) OVER (PARTITION BY o.document_id ORDER BY o.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM m JOIN o ON o.document_id = m.document_id AND o.k = m.k),
gp AS (SELECT document_id, grp, list(path ORDER BY k)[-1] AS path FROM gn GROUP BY ALL),
gw AS (SELECT g1.document_id, grp, flatten(list(list_filter(regexp_split_to_array(text, '{_BLANK}'), lambda x: x <> '') ORDER BY block_no)) AS w FROM g1 JOIN gn ON gn.document_id = g1.document_id AND gn.run = g1.run GROUP BY ALL),
tt AS (SELECT document_id, section_path, min_by(text, block_no) AS heading FROM f WHERE code IS NOT NULL GROUP BY ALL),
pp AS (SELECT document_id, path, unnest(range(1, len(string_split(path, '.')) + 1)) AS n FROM (SELECT DISTINCT document_id, path FROM gp WHERE path IS NOT NULL)),
bc AS (SELECT pp.document_id, path, string_agg(heading, ' > ' ORDER BY n) AS heading FROM pp JOIN tt ON tt.document_id = pp.document_id AND tt.section_path = array_to_string(string_split(path, '.')[1:CAST(n AS INT)], '.') GROUP BY ALL),
pc AS (SELECT document_id, grp, w, unnest(range(0, CAST(ceil(len(w) / 800.0) AS INT))) AS piece FROM gw WHERE len(w) > 0),
oc AS (SELECT pc.document_id, piece, gp.path AS path, bc.heading, w[CAST(piece * 800 + 1 AS INT):CAST(piece * 800 + 800 AS INT)] AS w, row_number() OVER (PARTITION BY pc.document_id ORDER BY pc.grp, piece) - 1 AS ordinal
  FROM pc JOIN gp ON gp.document_id = pc.document_id AND gp.grp = pc.grp LEFT JOIN bc ON bc.document_id = pc.document_id AND bc.path = gp.path)
SELECT document_id, CAST(ordinal AS INT) AS ordinal, path AS section_path, heading, CASE WHEN heading IS NULL THEN '' ELSE heading || chr(10) || chr(10) END || array_to_string(w, ' ') AS content, 1 AS page_from, 1 AS page_to,
CAST(len(w) + CASE WHEN heading IS NULL THEN 0 ELSE len(list_filter(regexp_split_to_array(heading, '{_BLANK}'), lambda x: x <> '')) END AS INT) AS token_count, CAST(CASE WHEN piece > 0 THEN ordinal - piece END AS INT) AS parent_ordinal FROM oc""")
def structural_chunks(s, d):
    return chunking.structural_chunks(_blocks(s, d)).drop("regions")


@query(rf""", w AS (SELECT id, ordinal, list_filter(regexp_split_to_array(content, '{_BLANK}'), lambda x: x <> '') AS w FROM c),
p AS (SELECT id, w, unnest(range(0, CAST(floor((len(w) - 1) / 800.0) AS INT) + 1)) AS piece FROM w WHERE len(w) > 0)
SELECT id, CAST(piece AS INT) AS piece, CAST(least(800, len(w) - piece * 800) AS INT) AS n_words, CAST(CASE WHEN piece > 0 THEN 0 END AS INT) AS parent_piece FROM p""")
def oversize_split(s, d):
    blocks = _chunks(s, d).select("id", F.lit(0).alias("block_no"), F.col("page_from").alias("page"), "section_path", F.col("content").alias("text"))
    pieces = chunking.word_windows(blocks, ["id"], chunking.CEILING, chunking.CEILING)
    return pieces.select("id", "piece", F.size("words").alias("n_words"), F.when(F.col("piece") > 0, 0).alias("parent_piece"))


#: Regions as blocks on pages: a chunk's boxes with its heading as text.
_REGIONS = """, r AS (SELECT document_id, id, unnest(regions) AS r, heading AS text FROM c WHERE regions IS NOT NULL AND heading IS NOT NULL),
b AS (SELECT document_id, id, text, r.page AS page, r.bbox AS bbox, row_number() OVER (PARTITION BY document_id ORDER BY id, r.page, r.bbox[2]) AS block_no FROM r),
a AS (SELECT *, round_even(bbox[1] / 5, 0) AS x, round_even(bbox[2] / 5, 0) AS y FROM b),
pg AS (SELECT document_id, coalesce(max(d.page_count), max(page)) AS pages FROM b LEFT JOIN d ON d.id = b.document_id GROUP BY document_id),
run AS (SELECT document_id, x, y FROM a JOIN pg USING (document_id) GROUP BY document_id, x, y, pages HAVING pages >= 2 AND count(DISTINCT page) >= 2 AND count(DISTINCT page) / pages > 0.6)
"""


def _regions(s: SparkSession, d: str) -> DataFrame:
    r = _chunks(s, d).filter("regions IS NOT NULL AND heading IS NOT NULL").select("document_id", "id", F.explode("regions").alias("r"), F.col("heading").alias("text"))
    b = r.select("document_id", "id", "text", F.col("r.page").alias("page"), F.col("r.bbox").alias("bbox"))
    return b.withColumn("block_no", F.row_number().over(Window.partitionBy("document_id").orderBy("id", "page", F.col("bbox")[1])))


@query(_REGIONS + "SELECT document_id, id, page FROM a WHERE NOT EXISTS (SELECT 1 FROM run WHERE run.document_id = a.document_id AND run.x = a.x AND run.y = a.y)")
def header_footer_filter(s, d):
    pages = _docs(s, d).select(F.col("id").alias("document_id"), "page_count")
    return chunking.without_running_headers(_regions(s, d), pages).select("document_id", "id", "page")


@query(r""", b AS (SELECT document_id, ordinal AS block_no, id, CAST(token_count AS DOUBLE) AS font_size, coalesce(heading, '') AS text FROM c),
m AS (SELECT document_id, median(font_size) AS median FROM b WHERE font_size > 0 GROUP BY document_id)
SELECT id, coalesce(font_size > median, false) OR coalesce(nullif(regexp_extract(text, '^(§\s*\d+[a-z]?)', 1), ''), nullif(regexp_extract(text, '^(\d+(?:\.\d+)*)\s', 1), '')) IS NOT NULL AS is_title FROM b LEFT JOIN m USING (document_id)""")
def title_by_median(s, d):
    """The title rule with the word count as the font size."""
    b = _chunks(s, d).select("document_id", F.col("ordinal").alias("block_no"), "id", F.col("token_count").cast("double").alias("font_size"), F.coalesce("heading", F.lit("")).alias("text"), F.lit("text").alias("kind"))
    return chunking.median_titles(b).select("id", "is_title")


@query(""", r AS (SELECT document_id, [string_agg(strategy, ',' ORDER BY id), CAST(count(*) AS VARCHAR)] AS cells, section_path FROM c GROUP BY document_id, section_path)
SELECT document_id, '| Abschnitt | n |' || chr(10) || '| --- | --- |' || string_agg(chr(10) || '| ' || replace(coalesce(section_path, ''), chr(10), ' / ') || ' | ' || cells[2] || ' |', '' ORDER BY coalesce(section_path, ''), cells[2]) AS markdown FROM r GROUP BY document_id""")
def table_to_markdown(s, d):
    rows = _chunks(s, d).groupBy("document_id", "section_path").agg(F.count(F.lit(1)).alias("n"))
    cells = F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("section_path", F.lit("")).alias("p"), F.col("n").cast("string").alias("n")))), lambda r: F.array(r["p"], r["n"]))
    t = rows.groupBy("document_id").agg(cells.alias("rows"))
    return t.select("document_id", T.markdown_table(F.concat(F.array(F.array(F.lit("Abschnitt"), F.lit("n"))), F.col("rows"))).alias("markdown"))


@query(r""", t AS (SELECT document_id, section_path, min_by(heading, ordinal) AS heading FROM c WHERE section_path IS NOT NULL AND heading IS NOT NULL GROUP BY ALL),
p AS (SELECT id, document_id, section_path, unnest(range(1, len(string_split(section_path, '.')) + 1)) AS n FROM c WHERE section_path IS NOT NULL)
SELECT id, string_agg(heading, ' > ' ORDER BY n) AS breadcrumb FROM p LEFT JOIN t ON t.document_id = p.document_id AND t.section_path = array_to_string(string_split(p.section_path, '.')[1:CAST(n AS INT)], '.') GROUP BY id""")
def breadcrumb(s, d):
    c = _chunks(s, d).filter("section_path IS NOT NULL")
    t = c.filter("heading IS NOT NULL").groupBy("document_id", "section_path").agg(F.min_by("heading", "ordinal").alias("heading"))
    maps = t.groupBy("document_id").agg(F.map_from_entries(F.collect_list(F.struct("section_path", "heading"))).alias("m"))
    return c.join(maps, "document_id", "left").select("id", T.breadcrumb(F.col("section_path"), F.col("m")).alias("breadcrumb"))


# --- ingestion -------------------------------------------------------------------------------------------------------


@query("""SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def content_hash_dedup(s, d):
    t = table(s, d, "documents").filter("text IS NOT NULL")
    return t.groupBy(ingest.content_hash(F.col("text")).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


@query("SELECT id FROM c WHERE CAST(ordinal AS BIGINT) NOT IN (SELECT vec_id FROM embeddings WHERE label = 3)")
def missing_embeddings(s, d):
    """The ordinal stands for the key of an embedding, a label for its model."""
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("string").alias("model"))
    c = _chunks(s, d).select(F.col("id").alias("chunk"), F.col("ordinal").cast("long").alias("id"))
    return ingest.missing_embeddings(c, e, "3").select(F.col("chunk").alias("id"))


@query(""", i AS (SELECT document_id, strategy, chunk_hash, min(id) AS id FROM chunks GROUP BY ALL)
SELECT document_id, strategy, chunk_hash, id FROM i WHERE NOT EXISTS (SELECT 1 FROM chunks e WHERE NOT e.ocr AND e.document_id = i.document_id AND e.strategy = i.strategy AND e.chunk_hash = i.chunk_hash)""")
def insert_ignore_chunks(s, d):
    """All chunks sent again over those that aren't scanned."""
    c, keys = table(s, d, "chunks"), ["document_id", "strategy", "chunk_hash"]
    return ingest.new_rows(c.filter("NOT ocr"), c, keys, [F.col("id")]).select(*keys, "id")


@query(""", e AS (SELECT tenant_id, content_hash, min_by(status, id) AS status, min(id) AS id FROM d WHERE status <> 'embedding' AND status <> 'parsing' GROUP BY ALL),
o AS (SELECT u.tenant_id, u.content_hash, u.id AS upload, e.id, e.status, row_number() OVER (PARTITION BY u.tenant_id, u.content_hash ORDER BY u.id, u.created_at, u.status) AS n FROM source_documents u LEFT JOIN e ON e.tenant_id = u.tenant_id AND e.content_hash = u.content_hash)
SELECT upload, CASE WHEN id IS NULL THEN CASE WHEN n = 1 THEN 'created' ELSE 'in_progress' END WHEN status = 'ready' THEN 'duplicate' WHEN status = 'failed' THEN 'retrying' ELSE 'in_progress' END AS outcome,
coalesce(id, sha256(tenant_id || chr(0) || content_hash)) AS document_id FROM o""")
def get_or_create_documents(s, d):
    uploads = table(s, d, "source_documents").select("tenant_id", "content_hash", F.col("id").alias("upload"), "created_at", "status")
    known = _docs(s, d).filter("status NOT IN ('embedding', 'parsing')")
    return ingest.get_or_create(uploads, known, [F.col("upload"), F.col("created_at"), F.col("status")]).select("upload", "outcome", "document_id")


@query("""SELECT c.id, min(p.id) AS parent_id FROM c LEFT JOIN c p ON p.document_id = c.document_id AND p.strategy = c.strategy AND p.ordinal = c.ordinal - 1 GROUP BY c.id""")
def parent_links(s, d):
    c = _chunks(s, d).withColumn("parent_ordinal", F.col("ordinal") - 1)
    return ingest.with_parents(c).select("id", "parent_id")


@query(""", f AS (SELECT document_id, chunk_hash, max(page_from) AS page FROM c GROUP BY ALL)
SELECT c.id, CAST(coalesce(c.regions[1].page, f.page) AS INT) AS page FROM c LEFT JOIN f ON f.document_id = c.document_id AND f.chunk_hash = c.chunk_hash""")
def region_backfill(s, d):
    c = _chunks(s, d)
    box = F.array(*(F.lit(x) for x in (0.0, 0.0, 1.0, 1.0)))
    found = c.groupBy("document_id", "chunk_hash").agg(F.array(F.struct(F.max("page_from").alias("page"), box.alias("bbox"))).alias("regions"))
    return ingest.backfill_regions(c, found).select("id", F.try_element_at("regions", F.lit(1))["page"].alias("page"))


@query(""", g AS (SELECT id FROM d WHERE status = 'ready' AND doc_type = 'norm') SELECT 'documents' AS t, count(*) AS n FROM d WHERE id NOT IN (SELECT id FROM g)
UNION ALL SELECT 'chunks', count(*) FROM c WHERE document_id NOT IN (SELECT id FROM g)""")
def delete_cascade(s, d):
    docs, c = _docs(s, d), _chunks(s, d)
    e = c.select(F.col("id").alias("chunk_id"))
    left = ingest.delete_cascade(docs, c, e, docs.filter("status = 'ready' AND doc_type = 'norm'"))
    return left[0].agg(F.lit("documents").alias("t"), F.count(F.lit(1)).alias("n")).union(left[1].agg(F.lit("chunks"), F.count(F.lit(1))))


@query(""", m AS (SELECT document_id AS id, count(*) AS n, count(*) FILTER (WHERE NOT ocr) AS e FROM c GROUP BY 1)
SELECT d.id, CASE WHEN error_code IS NOT NULL THEN 'failed' WHEN n = e THEN 'ready' WHEN n > 0 THEN 'embedding' ELSE 'pending' END AS status, error_code FROM d LEFT JOIN m USING (id)""")
def document_states(s, d):
    docs, c = _docs(s, d), _chunks(s, d)
    return ingest.document_states(docs, c, c.filter("NOT ocr").select(F.col("id").alias("chunk_id")), docs.filter("error_code IS NOT NULL").select(F.col("id").alias("document_id"), "error_code"))


# --- evaluation ------------------------------------------------------------------------------------------------------

# Each log row is a run of the evaluation question that its id's digest names; a missing answer is an error.
_NUMBER = "CAST(('0x' || substr(md5(l.id), 1, 6)) AS BIGINT)"
_RUNS = f""", r AS (SELECT l.id AS run_id, config_hash, e.id AS question_id, category, answer, abstained, should_abstain, retrieved_ids, expected_answer_points AS points, gold_sources, gold_passage, latency_ms, tokens, cost_usd, l.created_at,
   CASE WHEN answer IS NULL THEN 'no answer' END AS error, len(gold_sources) > 0 AS has_gold, CAST({_NUMBER} % 3 AS INT) AS judge, ({_NUMBER} % 101) / 100.0 AS top_score
 FROM l JOIN eval_questions e ON e.id = 'Q' || lpad(CAST({_NUMBER} % 300 + 1 AS VARCHAR), 3, '0')),
h AS (SELECT run_id, question_id, k AS rank, retrieved_ids[k] AS chunk_id FROM (SELECT run_id, question_id, retrieved_ids, unnest(range(1, len(retrieved_ids) + 1)) AS k FROM r)),
g AS (SELECT id AS question_id, unnest(gold_sources) AS g FROM eval_questions),
m AS (SELECT h.run_id, h.rank, h.question_id, coalesce(bool_or(g.g.document = d.filename AND CASE WHEN g.g.section IS NULL AND g.g.page IS NULL THEN true
   ELSE coalesce(g.g.section IS NOT NULL AND (contains(c.section_path, g.g.section) OR contains(g.g.section, c.section_path)), false) OR coalesce(g.g.page IS NOT NULL AND g.g.page BETWEEN c.page_from - 1 AND c.page_to + 1, false) END), false) AS hit
  FROM h JOIN c ON c.id = h.chunk_id JOIN d ON d.id = c.document_id LEFT JOIN g ON g.question_id = h.question_id GROUP BY h.run_id, h.rank, h.question_id),
o AS (SELECT r.run_id, config_hash, category, coalesce(found, 0) AS found, coalesce(1.0 / first, 0) AS reciprocal, precision FROM r LEFT JOIN
  (SELECT run_id, max(CAST(hit AS INT)) AS found, min(CASE WHEN hit THEN rank END) AS first, avg(CAST(hit AS INT)) AS precision FROM m WHERE rank <= 5 GROUP BY run_id) x ON x.run_id = r.run_id WHERE has_gold)
"""
_FM = r"""trim(regexp_replace(regexp_replace(regexp_replace(lower({}), '(\d),(\d)', '\1.\2', 'g'), '(\d),(\d)', '\1.\2', 'g'), '""" + _BLANK.replace("{", "{{").replace("}", "}}") + """', ' ', 'g'), ' ')"""
_MISSING = f"list_filter(points, lambda p: NOT coalesce(contains({_FM.format('answer')}, {_FM.format('p')}), false))"


def _runs(s: SparkSession, d: str) -> DataFrame:
    number = F.conv(F.substring(F.md5("id"), 1, 6), 16, 10).cast("long")
    own = _logs(s, d).withColumn("question_id", F.concat(F.lit("Q"), F.lpad((number % 300 + 1).cast("string"), 3, "0"))).withColumn("judge", (number % 3).cast("int")).withColumn("top_score", (number % 101) / 100.0)
    e = table(s, d, "eval_questions").select(F.col("id").alias("question_id"), "category", "should_abstain", F.col("expected_answer_points").alias("points"), "gold_sources", "gold_passage")
    own = own.withColumnRenamed("id", "run_id").withColumn("error", F.when(F.col("answer").isNull(), "no answer"))
    return own.join(e, "question_id").withColumn("has_gold", F.size("gold_sources") > 0)


def _hits(s: SparkSession, d: str) -> DataFrame:
    r = _runs(s, d).select("run_id", "question_id", F.posexplode("retrieved_ids").alias("pos", "chunk_id")).withColumn("rank", F.col("pos") + 1)
    c = _chunks(s, d).select(F.col("id").alias("chunk_id"), "document_id", "section_path", "page_from", "page_to")
    docs = _docs(s, d).select(F.col("id").alias("document_id"), "filename")
    gold = table(s, d, "eval_questions").select(F.col("id").alias("question_id"), F.explode("gold_sources").alias("g")).select("question_id", "g.*")
    return evaluation.matched(r.join(c, "chunk_id").join(docs, "document_id"), gold)


def _outcomes(s: SparkSession, d: str) -> DataFrame:
    return evaluation.retrieval_outcomes(_runs(s, d), _hits(s, d), 5)


def _round(*columns: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumns({c: F.round(c, 6) for c in columns})


@query(_RUNS + "SELECT config_hash, round(avg(found), 6) AS recall FROM o GROUP BY config_hash")
def recall_at_k(s, d):
    return _outcomes(s, d).groupBy("config_hash").agg(F.avg("found").alias("recall")).transform(_round("recall"))


@query(_RUNS + "SELECT config_hash, round(avg(reciprocal), 6) AS mrr FROM o GROUP BY config_hash")
def mrr(s, d):
    return _outcomes(s, d).groupBy("config_hash").agg(F.avg("reciprocal").alias("mrr")).transform(_round("mrr"))


@query(_RUNS + "SELECT config_hash, round(avg(precision), 6) AS precision FROM o GROUP BY config_hash")
def precision_at_k(s, d):
    return _outcomes(s, d).groupBy("config_hash").agg(F.avg("precision").alias("precision")).transform(_round("precision"))


@query(_RUNS + """, a AS (SELECT run_id, CAST(substr(unnest(list_distinct(regexp_extract_all(answer, '\\[(S\\d+)\\]', 1))), 2) AS INT) AS rank FROM r)
SELECT round(sum(CAST(hit AS INT)) / nullif(count(*), 0), 6) AS citation_precision, count(*) AS n FROM a JOIN m USING (run_id, rank)""")
def citation_precision(s, d):
    out = metrics.citation_precision(_runs(s, d).withColumn("_all", F.lit(1)), _hits(s, d), ["_all"])
    return out.select("citation_precision", F.col("n_cited").alias("n")).transform(_round("citation_precision"))


@query(_RUNS + """SELECT config_hash, round(avg(len(list_filter(list_distinct(regexp_extract_all(answer, '\\[S(\\d+)\\]', 1)), lambda x: CAST(x AS INT) > len(retrieved_ids) OR CAST(x AS INT) < 1))), 6) AS rate FROM r WHERE error IS NULL AND retrieved_ids IS NOT NULL GROUP BY config_hash""")
def hallucinated_rate(s, d):
    return metrics.hallucinated(_runs(s, d), ["config_hash"]).withColumnRenamed("hallucinated", "rate").transform(_round("rate"))


@query(_RUNS + f"SELECT run_id, CAST(len(points) - len({_MISSING}) AS INT) AS n_found, CAST(len({_MISSING}) AS INT) AS n_missing FROM r WHERE answer IS NOT NULL")
def layer1_points(s, d):
    found, missing = evaluation.layer1(F.col("answer"), F.col("points"))
    return _runs(s, d).filter("answer IS NOT NULL").select("run_id", F.size(found).alias("n_found"), F.size(missing).alias("n_missing"))


def _scored(s: SparkSession, d: str) -> DataFrame:
    _, missing = evaluation.layer1(F.col("answer"), F.col("points"))
    own = _runs(s, d).filter("answer IS NOT NULL").withColumn("missing", missing)
    return own.withColumn("accurate", evaluation.accurate(F.col("missing"), F.col("judge"))).withColumn("strict", evaluation.accurate(F.col("missing"), F.col("judge"), F.col("points")))


_SCORED = _RUNS + f""", sc AS (SELECT *, len(mis) = 0 OR judge = 2 AS accurate, (len(mis) = 0 AND len(points) > 0) OR judge = 2 AS strict FROM (SELECT *, {_MISSING} AS mis FROM r WHERE answer IS NOT NULL))
"""


@query(_SCORED + "SELECT config_hash, round(avg(CAST(accurate AS INT)), 6) AS accuracy, round(avg(CAST(strict AS INT)), 6) AS strict_accuracy FROM sc GROUP BY config_hash")
def answer_accuracy(s, d):
    out = _scored(s, d).groupBy("config_hash").agg(F.avg(F.col("accurate").cast("int")).alias("accuracy"), F.avg(F.col("strict").cast("int")).alias("strict_accuracy"))
    return out.transform(_round("accuracy", "strict_accuracy"))


@query(_RUNS + """SELECT config_hash, round(avg(CASE WHEN should_abstain THEN CAST(abstained AS INT) END), 6) AS correct_abstention, round(avg(CASE WHEN NOT should_abstain THEN CAST(abstained AS INT) END), 6) AS false_abstention
FROM r WHERE error IS NULL GROUP BY config_hash""")
def abstention_rates(s, d):
    return evaluation.abstention_rates(_runs(s, d), ["config_hash"]).transform(_round("correct_abstention", "false_abstention"))


_PHASES = ("retrieval_ms", "generation_ms", "total_ms")


@query(_RUNS + "SELECT config_hash, " + ", ".join(f"round(quantile_cont(CAST(latency_ms['{p}'] AS DOUBLE), {q}), 6) AS {p}_p{n}" for p in _PHASES for n, q in ((50, 0.5), (95, 0.95))) + " FROM r WHERE error IS NULL GROUP BY config_hash")
def latency_percentiles(s, d):
    return metrics.latency(_runs(s, d), ["config_hash"]).transform(_round(*(f"{p}_p{n}" for p in _PHASES for n in (50, 95))))


@query(_RUNS + "SELECT config_hash, round(avg(CAST(cost_usd AS DOUBLE)), 6) AS cost FROM r GROUP BY config_hash")
def cost_avg(s, d):
    return metrics.cost(_runs(s, d), ["config_hash"]).transform(_round("cost"))


@query(""", p AS (SELECT * FROM (VALUES (0, 2.0, 5.0), (1, 1.0, 3.0)) AS t(kind, price_in, price_out))
SELECT id, round(tokens['prompt'] / 1e6 * price_in + tokens['completion'] / 1e6 * price_out, 6) AS cost FROM l LEFT JOIN p ON kind = tokens['prompt'] % 3""")
def cost_from_prices(s, d):
    prices = s.createDataFrame([(0, 2.0, 5.0), (1, 1.0, 3.0)], "kind int, price_in double, price_out double")
    own = _logs(s, d).withColumn("kind", F.col("tokens")["prompt"] % 3).join(F.broadcast(prices), "kind", "left")  # a literal table of two rows
    return own.select("id", F.round(T.cost_usd(F.col("tokens")["prompt"], F.col("tokens")["completion"], F.col("price_in"), F.col("price_out")), 6).alias("cost"))


@query(_RUNS + "SELECT category, CAST(sum(found) AS BIGINT) AS hits, count(*) AS n, round(avg(found), 6) AS recall FROM o GROUP BY GROUPING SETS ((), (category))")
def recall_grouping_sets(s, d):
    return metrics.recall_sets(_outcomes(s, d), "category").transform(_round("recall"))


_CATEGORIES = ["requirement_lookup", "cross_reference", "code_lookup", "unanswerable", "conflict"]


@query(_SCORED + "SELECT config_hash, " + ", ".join(f"round(avg(CASE WHEN category = '{c}' THEN CAST(accurate AS INT) END), 6) AS {c}" for c in _CATEGORIES) + " FROM sc GROUP BY config_hash")
def accuracy_by_category_pivot(s, d):
    rates = evaluation.rates_by(_scored(s, d), "config_hash", "category", "accurate")
    return rates.groupBy("config_hash").pivot("category", _CATEGORIES).agg(F.round(F.first("rate"), 6))


_BY_CONFIG = _SCORED + ", t AS (SELECT config_hash, round(avg(CAST(accurate AS INT)), 6) AS accuracy, round(avg(CAST(cost_usd AS DOUBLE)), 6) AS cost FROM sc GROUP BY config_hash)\n"


@query(_BY_CONFIG + "SELECT *, accuracy = max(accuracy) OVER () AS best_accuracy, cost = min(cost) OVER () AS best_cost FROM t")
def best_per_column(s, d):
    t = _scored(s, d).groupBy("config_hash").agg(F.round(F.avg(F.col("accurate").cast("int")), 6).alias("accuracy"), F.round(F.avg(F.col("cost_usd").cast("double")), 6).alias("cost"))
    return evaluation.best_flags(t, {"accuracy": True, "cost": False})


_LATE = ", ".join(f"round(quantile_cont(CAST(latency_ms['{p}'] AS DOUBLE), {q}) FILTER (WHERE error IS NULL), 6) AS {p}_p{n}" for p in _PHASES for n, q in ((50, 0.5), (95, 0.95)))


@query(_SCORED + f""", x AS (SELECT config_hash, count(*) AS n_questions, count(error) AS n_errors, round(avg(CASE WHEN error IS NULL AND should_abstain THEN CAST(abstained AS INT) END), 6) AS correct_abstention,
  round(avg(CASE WHEN error IS NULL AND NOT should_abstain THEN CAST(abstained AS INT) END), 6) AS false_abstention, {_LATE}, round(avg(CAST(cost_usd AS DOUBLE)), 6) AS cost,
  round(avg(len(list_filter(list_distinct(regexp_extract_all(answer, '\\[S(\\d+)\\]', 1)), lambda x: CAST(x AS INT) > len(retrieved_ids) OR CAST(x AS INT) < 1))) FILTER (WHERE error IS NULL AND retrieved_ids IS NOT NULL), 6) AS hallucinated FROM r GROUP BY 1),
y AS (SELECT config_hash, round(avg(found), 6) AS recall, round(avg(reciprocal), 6) AS mrr, round(avg(precision), 6) AS precision FROM o GROUP BY 1),
a AS (SELECT run_id, config_hash, CAST(substr(unnest(list_distinct(regexp_extract_all(answer, '\\[(S\\d+)\\]', 1))), 2) AS INT) AS rank FROM r),
z AS (SELECT config_hash, round(sum(CAST(hit AS INT)) / count(*), 6) AS citation_precision, count(*) AS n_cited FROM a JOIN m USING (run_id, rank) GROUP BY 1),
w AS (SELECT config_hash, round(avg(CAST(accurate AS INT)), 6) AS accuracy, count(*) FILTER (WHERE judge = 0) AS n_judge_errors FROM sc GROUP BY 1)
SELECT * FROM x LEFT JOIN y USING (config_hash) LEFT JOIN z USING (config_hash) LEFT JOIN w USING (config_hash)""")
def all_metrics(s, d):
    """Every metric of each configuration in one row; a judgement of 0 stands for a judge's error."""
    scored = _scored(s, d).select("run_id", F.col("accurate").alias("correct"), F.when(F.col("judge") == 0, "bad").alias("judge_error"))
    out = metrics.compute(_runs(s, d), _hits(s, d), scored, ["config_hash"])
    return out.transform(_round(*(c for c, t in out.dtypes if t == "double")))


def _by_question(s: SparkSession, d: str) -> DataFrame:
    return _scored(s, d).groupBy("config_hash", "question_id").agg(F.avg(F.col("accurate").cast("int")).alias("value"))


@query(_SCORED + """, v AS (SELECT config_hash, question_id, avg(CAST(accurate AS INT)) AS value FROM sc GROUP BY ALL), b AS (SELECT * FROM v WHERE config_hash = (SELECT min(config_hash) FROM query_logs))
SELECT v.config_hash, v.question_id, round(v.value - b.value, 6) AS difference FROM v JOIN b USING (question_id) WHERE v.config_hash <> b.config_hash""")
def paired_diff(s, d):
    base = table(s, d, "query_logs").agg(F.min("config_hash")).first()[0]
    return evaluation.paired(_by_question(s, d), "config_hash", "question_id", "value", base).transform(_round("difference"))


@query()
def bootstrap_ci(s, d):
    return evaluation.bootstrap(_by_question(s, d), ["config_hash"], "value")


@query()
def paired_bootstrap(s, d):
    base = table(s, d, "query_logs").agg(F.min("config_hash")).first()[0]
    out = evaluation.bootstrap(evaluation.paired(_by_question(s, d), "config_hash", "question_id", "value", base), ["config_hash"], "difference")
    return out.withColumn("excludes_zero", (F.col("low") > 0) | (F.col("high") < 0))


@query(_SCORED + "SELECT count(*) AS n, round(avg(CAST((judge = 2) = (len(mis) = 0) AS INT)), 6) AS agreement FROM sc")
def percent_agreement(s, d):
    own = _scored(s, d).select((F.col("judge") == 2).alias("a"), (F.size("missing") == 0).alias("b"))
    return metrics.agreement(own, "a", "b").transform(_round("agreement"))


@query(_SCORED + """, k AS (SELECT judge = 2 AS a, len(mis) = 0 AS b FROM sc), po AS (SELECT count(*) AS n, avg(CAST(a = b AS INT)) AS po, avg(CAST(a AS INT)) AS pa, avg(CAST(b AS INT)) AS pb FROM k)
SELECT n, round(po, 6) AS agreement, round((po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 6) AS kappa FROM po""")
def cohens_kappa(s, d):
    own = _scored(s, d).select((F.col("judge") == 2).alias("a"), (F.size("missing") == 0).alias("b"))
    return evaluation.kappa(own, "a", "b").transform(_round("agreement", "kappa"))


_THRESHOLDS = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]


@query(_SCORED + f""", t AS (SELECT unnest({_THRESHOLDS}) AS threshold), x AS (SELECT threshold, top_score < threshold AS gated, should_abstain, abstained, accurate FROM sc, t)
SELECT CAST(threshold AS DOUBLE) AS threshold, round(avg(CAST(CASE WHEN gated THEN should_abstain ELSE accurate END AS INT)), 6) AS accuracy, round(avg(CASE WHEN NOT should_abstain THEN CAST(gated OR abstained AS INT) END), 6) AS false_abstention,
round(avg(CASE WHEN should_abstain THEN CAST(gated OR abstained AS INT) END), 6) AS correct_abstention, count(*) FILTER (WHERE gated) AS calls_saved FROM x GROUP BY threshold""")
def gate_sweep(s, d):
    own = _scored(s, d).select("should_abstain", "top_score", "abstained", F.col("accurate").alias("correct"))
    return evaluation.gate_sweep(own, _THRESHOLDS).transform(_round("accuracy", "false_abstention", "correct_abstention"))


@query(_RUNS + """, s AS (SELECT top_score, count(*) FILTER (WHERE NOT should_abstain) AS p, count(*) FILTER (WHERE should_abstain) AS q FROM r GROUP BY 1)
SELECT round(sum(a.p * b.q * CASE WHEN a.top_score > b.top_score THEN 1.0 WHEN a.top_score = b.top_score THEN 0.5 ELSE 0 END) / sum(a.p * b.q), 6) AS auc FROM s a, s b""")
def separability_auc(s, d):
    return evaluation.separability(_runs(s, d)).transform(_round("auc"))


@query(_SCORED + "SELECT min(top_score) AS lowest FROM sc WHERE accurate AND NOT should_abstain AND top_score > 0")
def lowest_correct_score(s, d):
    return metrics.lowest_correct(_scored(s, d).withColumn("correct", F.col("accurate")))


@query("SELECT id, category FROM (SELECT id, category, row_number() OVER (PARTITION BY category ORDER BY id) AS n FROM eval_questions) WHERE n <= 3")
def sample_per_category(s, d):
    return evaluation.first_per_category(table(s, d, "eval_questions"), "category", "id").select("id", "category")


@query(_RUNS + f""", x AS (SELECT run_id, answer, gold_passage, unnest(list_distinct(points)) AS point FROM r WHERE answer IS NOT NULL)
SELECT CASE WHEN contains({_FM.format('answer')}, {_FM.format('point')}) THEN 'context' WHEN contains({_FM.format('gold_passage')}, {_FM.format('point')}) THEN 'neighbour' ELSE 'missing' END AS place, count(*) AS n FROM x GROUP BY 1""")
def locate_points(s, d):
    p = _runs(s, d).filter("answer IS NOT NULL").select("answer", "gold_passage", F.explode(F.array_distinct("points")).alias("point"))
    return p.groupBy(evaluation.locate(F.col("point"), F.col("answer"), F.col("gold_passage")).alias("place")).agg(F.count(F.lit(1)).alias("n"))


_LOCATED = _RUNS + f""", fa AS (SELECT run_id, config_hash, retrieved_ids, points FROM r WHERE {{which}}),
i AS (SELECT DISTINCT run_id, unnest(retrieved_ids) AS chunk_id FROM fa), p AS (SELECT run_id, config_hash, k, {_FM.format('points[k]')} AS point FROM (SELECT *, unnest(range(1, len(points) + 1)) AS k FROM fa)),
t AS (SELECT i.run_id, 0 AS place, {_FM.format('c.content')} AS text FROM i JOIN c ON c.id = i.chunk_id
 UNION ALL SELECT i.run_id, 1, {_FM.format('n.content')} FROM i JOIN c ON c.id = i.chunk_id JOIN c n ON n.document_id = c.document_id AND n.strategy = c.strategy AND abs(n.ordinal - c.ordinal) = 1),
x AS (SELECT p.run_id, p.config_hash, k, CASE min(CASE WHEN point = '' THEN 0 WHEN contains(text, point) THEN place END) WHEN 0 THEN 'context' WHEN 1 THEN 'neighbour' ELSE 'missing' END AS place FROM p LEFT JOIN t ON t.run_id = p.run_id GROUP BY ALL)
"""
_FALSE = "abstained AND NOT should_abstain AND error IS NULL"


def _located(s: SparkSession, d: str, which: str) -> tuple[DataFrame, DataFrame]:
    """The runs, and the places of their points in retrieved and neighbouring chunks."""
    c = _chunks(s, d)
    runs = cut_lineage(_runs(s, d).filter(which).select("run_id", "config_hash", "question_id", "retrieved_ids", "points"))
    points = runs.select("run_id", "question_id", F.posexplode("points").alias("pos", "point"))
    retrieved = runs.select("run_id", "question_id", F.explode(F.array_distinct("retrieved_ids")).alias("chunk_id"))
    return runs, evaluation.located(points, retrieved, c, operations.neighbours(c, c, 1))


@query(_LOCATED.replace("{which}", "answer IS NOT NULL") + "SELECT place, count(*) AS n FROM x GROUP BY 1")
def locate_points_in_chunks(s, d):
    """Where the points of all answered runs are: in the chunks retrieved, in their neighbours, or in neither."""
    return _located(s, d, "answer IS NOT NULL")[1].groupBy("place").agg(F.count(F.lit(1)).alias("n"))


@query(_LOCATED.replace("{which}", _FALSE) + """, y AS (SELECT run_id, count(*) FILTER (WHERE place = 'context') AS context, count(*) FILTER (WHERE place = 'neighbour') AS neighbour, count(*) FILTER (WHERE place = 'missing') AS missing FROM x GROUP BY 1)
SELECT config_hash, count(*) AS n_false, CAST(coalesce(sum(context), 0) AS BIGINT) AS context, CAST(coalesce(sum(neighbour), 0) AS BIGINT) AS neighbour, CAST(coalesce(sum(missing), 0) AS BIGINT) AS missing,
count(*) FILTER (WHERE missing = 0 AND neighbour > 0) AS fixable FROM fa LEFT JOIN y USING (run_id) GROUP BY 1""")
def neighbour_coverage(s, d):
    """Of each configuration's false abstentions: points by place, and how many runs neighbours could complete."""
    runs, places = _located(s, d, _FALSE)
    total = [F.coalesce(F.sum(p), F.lit(0)).alias(p) for p in ("context", "neighbour", "missing")]
    each = runs.select("run_id", "config_hash").join(evaluation.fixable(places), "run_id", "left")
    return each.groupBy("config_hash").agg(F.count(F.lit(1)).alias("n_false"), *total, F.count_if("fixable").alias("fixable"))


@query(_RUNS + """, k AS (SELECT run_id, question_id, error, row_number() OVER (PARTITION BY question_id ORDER BY created_at DESC, run_id DESC) AS n FROM r) SELECT run_id, question_id FROM k WHERE n = 1 AND error IS NULL""")
def checkpoint_latest(s, d):
    lines = _runs(s, d).withColumn("line_no", F.struct("created_at", "run_id"))
    return evaluation.latest_lines(lines).select("run_id", "question_id")


@query(_RUNS + "SELECT run_id FROM r WHERE judge = 0 OR abstained OR substr(run_id, 1, 1) < '4'")
def stale_scores(s, d):
    """Scores exist for ids from 4 on; those of abstained runs hold another answer, judge 0 stands for an error."""
    r = _runs(s, d)
    old = r.filter("substring(run_id, 1, 1) >= '4'").select("run_id", F.when(F.col("abstained"), F.concat(F.coalesce("answer", F.lit("")), F.lit("!"))).otherwise(F.col("answer")).alias("answer"), F.when(F.col("judge") == 0, "bad").alias("judge_error"))
    return evaluation.stale(r, old).select("run_id")


@query(_RUNS + "SELECT run_id, CASE WHEN abstained THEN judge + 10 ELSE judge END AS score FROM r WHERE abstained OR substr(run_id, 1, 1) >= '4'")
def rescore_merge(s, d):
    r = _runs(s, d)
    old = r.filter("substring(run_id, 1, 1) >= '4'").select("run_id", F.col("judge").alias("score"))
    return evaluation.rescored(r, old, r.filter("abstained").select("run_id", (F.col("judge") + 10).alias("score")))


@query(_RUNS + """SELECT run_id, CASE WHEN judge > 0 THEN judge END AS score, CASE WHEN judge > 0 THEN 'ok' END AS rationale, CASE WHEN judge = 0 THEN 'invalid judge response' END AS error FROM r""")
def judge_parse(s, d):
    raw = F.when(F.col("judge") == 0, F.lit('{"score": 7, "rationale": "x"}')).otherwise(F.concat(F.lit('{"score": '), F.col("judge").cast("string"), F.lit(', "rationale": "ok"}')))
    return _runs(s, d).select("run_id", evaluation.judge_parse(raw).alias("j")).select("run_id", "j.*")


@query(""", k AS (SELECT DISTINCT config_hash FROM query_logs) SELECT config_hash, id AS question_id FROM k, eval_questions""")
def experiment_grid(s, d):
    configs = table(s, d, "query_logs").select("config_hash").distinct()
    ids = [r.id for r in table(s, d, "eval_questions").select("id").collect()]  # the fixed question set of 300 rows
    return configs.select("config_hash", F.explode(F.lit(ids)).alias("question_id"))


@query(_RUNS + """, a AS (SELECT config_hash, question_id FROM r GROUP BY ALL), k AS (SELECT DISTINCT config_hash FROM query_logs)
SELECT config_hash, id AS question_id FROM k, eval_questions e WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.config_hash = k.config_hash AND a.question_id = e.id)""")
def pending_runs(s, d):
    return experiment_grid(s, d).join(_runs(s, d).select("config_hash", "question_id"), ["config_hash", "question_id"], "left_anti")


@query(r""", a AS (SELECT id, answer, len(regexp_extract_all(answer, '\[S\d+\]')) AS n_citations FROM l WHERE answer IS NOT NULL) SELECT id, CAST(n_citations AS INT) AS n_citations FROM a""")
def answer_segments(s, d):
    seg = _logs(s, d).filter("answer IS NOT NULL").select("id", context.answer_segments(F.col("answer")).alias("seg"))
    return seg.select("id", F.size(F.filter("seg", lambda x: x["kind"] == "citation")).alias("n_citations"))


# --- operations ------------------------------------------------------------------------------------------------------


@query("""SELECT tenant_id, count(*) AS n, count(*) FILTER (WHERE abstained) AS n_abstained, round(CAST(coalesce(sum(cost_usd), 0) AS DOUBLE), 6) AS cost, quantile_cont(CAST(latency_ms['total_ms'] AS DOUBLE), 0.5) AS p50, round(quantile_cont(CAST(latency_ms['total_ms'] AS DOUBLE), 0.95), 6) AS p95
FROM l WHERE created_at >= (SELECT max(created_at) FROM query_logs) - INTERVAL 168 HOUR GROUP BY tenant_id""")
def tenant_stats(s, d):
    """The last 168 hours before the latest row."""
    end = table(s, d, "query_logs").agg(F.max("created_at")).first()[0]
    start = F.lit(end) - F.expr("interval 168 hours")
    return operations.tenant_stats(_logs(s, d), ["tenant_id"], start).transform(_round("cost", "p95"))


@query("SELECT tenant_id, CASE WHEN status IN ('ready', 'failed') THEN status ELSE 'processing' END AS bucket, count(*) AS n FROM d GROUP BY ALL")
def status_buckets(s, d):
    return operations.status_buckets(_docs(s, d), ["tenant_id"])


@query("SELECT id, substr(question, 1, 120) AS question, abstained FROM l ORDER BY created_at DESC, id LIMIT 10")
def recent_queries(s, d):
    return _logs(s, d).orderBy(F.col("created_at").desc(), "id").limit(10).select("id", F.substring("question", 1, 120).alias("question"), "abstained")


@query("SELECT CAST(created_at AT TIME ZONE 'UTC' AS DATE) AS day, count(*) AS n, count(*) >= 200 AS exhausted FROM l GROUP BY 1")
def daily_budget(s, d):
    return operations.daily_budget(_logs(s, d), 200)


@query("""SELECT CAST(date_trunc('hour', created_at AT TIME ZONE 'UTC') AS TIMESTAMP) AS start, count(*) AS n, count(*) FILTER (WHERE abstained) AS n_abstained FROM l GROUP BY 1""")
def rolling_stats_window(s, d):
    w = _logs(s, d).groupBy(F.window("created_at", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if("abstained").alias("n_abstained"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "n_abstained")


@query("""SELECT tenant_id, CAST(created_at AT TIME ZONE 'UTC' AS DATE) AS day, count(*) AS answers, count(*) FILTER (WHERE answer IS NULL) AS errors, round(CAST(coalesce(sum(cost_usd), 0) AS DOUBLE), 6) AS cost, CAST(coalesce(sum(len(retrieved_ids)), 0) AS BIGINT) AS retrieved FROM l GROUP BY ALL""")
def process_counters(s, d):
    out = _logs(s, d).groupBy("tenant_id", F.to_date("created_at").alias("day")).agg(
        F.count(F.lit(1)).alias("answers"), F.count_if(F.col("answer").isNull()).alias("errors"), F.coalesce(F.sum("cost_usd"), F.lit(0)).cast("double").alias("cost"), F.coalesce(F.sum(F.when(F.col("retrieved_ids").isNotNull(), F.size("retrieved_ids"))), F.lit(0)).cast("long").alias("retrieved")
    )
    return out.transform(_round("cost"))


@query("SELECT document_id, strategy, count(*) AS n FROM c GROUP BY ALL")
def chunk_counts_map(s, d):
    counts = operations.chunk_counts(table(s, d, "chunks").filter("id IS NOT NULL"))
    return counts.select("document_id", F.explode("counts").alias("strategy", "n"))


@query(""", n AS (SELECT document_id, count(*) AS n FROM c GROUP BY 1) SELECT d.id, filename, version_label, coalesce(n, 0) AS n_chunks FROM d LEFT JOIN n ON n.document_id = d.id""")
def document_listing(s, d):
    rows = operations.listing(_docs(s, d), table(s, d, "chunks").filter("id IS NOT NULL"))
    total = F.aggregate(F.map_values("counts"), F.lit(0).cast("long"), lambda a, v: a + v)
    return rows.select("id", "filename", "version_label", total.alias("n_chunks"))


_SEEDS = ", s AS (SELECT id, document_id, strategy, ordinal FROM c WHERE ordinal % 50 = 0)\n"


def _seeds(c: DataFrame) -> DataFrame:
    return c.filter("ordinal % 50 = 0").select("id", "document_id", "strategy", "ordinal")


@query(_SEEDS + "SELECT DISTINCT c.id FROM s JOIN c ON c.document_id = s.document_id AND c.strategy = s.strategy AND c.ordinal BETWEEN s.ordinal - 1 AND s.ordinal + 1 WHERE c.id NOT IN (SELECT id FROM s)")
def neighbour_range_join(s, d):
    c = _chunks(s, d)
    return operations.neighbours_outside(c, _seeds(c))


@query(_SEEDS + """SELECT s.id, CAST(count(c.id) FILTER (WHERE c.ordinal < s.ordinal) AS INT) AS n_before, CAST(count(c.id) FILTER (WHERE c.ordinal > s.ordinal) AS INT) AS n_after, min(CASE WHEN c.ordinal = s.ordinal + 1 THEN c.id END) AS next
FROM s LEFT JOIN c ON c.document_id = s.document_id AND c.strategy = s.strategy AND c.ordinal BETWEEN s.ordinal - 2 AND s.ordinal + 2 AND c.ordinal <> s.ordinal GROUP BY s.id""")
def chunk_context(s, d):
    c = _chunks(s, d)
    return _context(c, _seeds(c))


def _context(c: DataFrame, seeds: DataFrame) -> DataFrame:
    out = operations.chunk_context(c, seeds, 2)
    nxt = operations.neighbours(c, seeds, 1).filter("offset = 1").groupBy(F.col("seed_id").alias("id")).agg(F.min("id").alias("next"))
    return out.join(nxt, "id", "left").select("id", F.size("before").alias("n_before"), F.size("after").alias("n_after"), "next")


@query(ORACLE["chunk_context"].replace(" WHERE ordinal % 50 = 0", ""))
def chunk_context_all(s, d):
    """The context of every chunk."""
    c = _chunks(s, d).select("id", "document_id", "strategy", "ordinal")
    return _context(c, c)


@query(""", h AS (SELECT DISTINCT id AS query_id, unnest(retrieved_ids) AS seed FROM l)
SELECT DISTINCT query_id, n.id FROM h JOIN c ON c.id = seed JOIN c n ON n.document_id = c.document_id AND n.strategy = c.strategy AND n.ordinal BETWEEN c.ordinal - 1 AND c.ordinal + 1
WHERE NOT EXISTS (SELECT 1 FROM h k WHERE k.query_id = h.query_id AND k.seed = n.id)""")
def neighbours_of_hits(s, d):
    """Neighbours of what each logged query retrieved, without its own hits. The hits of one query are few and held in one row."""
    c = _chunks(s, d)
    near = operations.neighbours(c, c, 1).groupBy("seed_id").agg(F.collect_list("id").alias("near"))
    hits = _logs(s, d).select(F.col("id").alias("query_id"), F.explode(F.array_distinct("retrieved_ids")).alias("seed_id"))
    each = hits.join(near, "seed_id").groupBy("query_id").agg(F.array_except(F.flatten(F.collect_list("near")), F.collect_list("seed_id")).alias("ids"))
    return each.select("query_id", F.explode("ids").alias("id"))


@query(rf""", w AS (SELECT id, list_filter(regexp_split_to_array(answer, '{_BLANK}'), lambda x: x <> '') AS w FROM l WHERE answer IS NOT NULL) SELECT id AS request_id, array_to_string(w, '') AS text FROM w WHERE len(w) > 0""")
def token_stream_assemble(s, d):
    """Answers as streams of words, put together without the blanks."""
    deltas = _logs(s, d).select(F.col("id").alias("request_id"), F.posexplode(T.words(F.col("answer"))).alias("seq", "text"))
    deltas = deltas.withColumn("model", F.when(F.col("seq") == 0, "m")).withColumn("finish_reason", F.lit(None).cast("string"))
    return operations.assembled(deltas).select("request_id", "text")


@query("""WITH g AS (SELECT event_id, user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id)) / 1e6 AS gap FROM events) SELECT user_id, event_id, round(gap, 6) AS gap FROM g WHERE gap > 86400""")
def idle_gap_timeouts(s, d):
    return operations.idle_gaps(table(s, d, "events"), "user_id", "ts", "event_id", 86400).transform(_round("gap"))


@query("""WITH g AS (SELECT event_id, user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id)) / 1e6 AS gap FROM events)
SELECT user_id, event_id, unnest(range(1, CAST(floor(gap / 86400.0) AS BIGINT) + 1)) AS beat FROM g WHERE gap > 86400""")
def heartbeats(s, d):
    """A beat for each full day of a pause."""
    return operations.heartbeats(table(s, d, "events"), "user_id", "ts", "event_id", 86400.0)


@query("""WITH f AS (SELECT user_id, min(ts) AS first FROM events WHERE event_id % 7 > 0 GROUP BY 1), r AS (SELECT DISTINCT user_id, TIMESTAMP '2023-12-31 00:00:00' AS started_at FROM events)
SELECT user_id AS request_id, round((epoch_us(first) - epoch_us(started_at)) / 1e6, 6) AS wait FROM r LEFT JOIN f USING (user_id) WHERE first IS NULL OR (epoch_us(first) - epoch_us(started_at)) / 1e6 > 200000""")
def first_token_timeouts(s, d):
    """Users as requests that begin at one time, their events as pieces."""
    e = table(s, d, "events")
    requests = e.select(F.col("user_id").alias("request_id")).distinct().withColumn("started_at", F.lit("2023-12-31 00:00:00").cast("timestamp_ntz").cast("timestamp"))
    deltas = e.filter("event_id % 7 > 0").select(F.col("user_id").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"))
    return operations.first_token_timeouts(requests, deltas, 200_000).transform(_round("wait"))


@query()
def retrieval_grid(s, d):
    """The retrieval-only grid over the query set: three configurations, each question within its tenant."""
    gold = table(s, d, "eval_questions").select(F.col("id").alias("question_id"), F.explode("gold_sources").alias("g")).select("question_id", "g.*")
    configs = {"structural / hybrid": {}, "structural / fts": {"mode": "fts"}, "fixed_500 / hybrid": {"strategy": "fixed_500"}}
    return plans_evaluation.retrieval_grid(*_indexed(s, d), gold, configs)


@query()
def rate_limit_replay(s, d):
    return operations.rate_limited(table(s, d, "events"), ["user_id"], 3, 86400.0, seq="event_id")


@query(_WITH.replace("WITH c AS", "WITH RECURSIVE c AS", 1) + """, t AS (SELECT id, 0 AS depth FROM c WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM c)
UNION ALL SELECT c.id, depth + 1 FROM c JOIN t ON c.parent_id = t.id) SELECT id, CAST(depth AS INT) AS depth FROM t""")
def span_tree_depth(s, d):
    """Depth of each chunk below its topmost parent, by a recursive query."""
    c = _chunks(s, d).select("id", "parent_id")
    top = c.join(c.select(F.col("id").alias("parent_id"), F.lit(True).alias("_has")), "parent_id", "left")
    return s.sql(
        "WITH RECURSIVE t(id, depth) AS (SELECT id, 0 FROM {top} WHERE _has IS NULL UNION ALL SELECT c.id, t.depth + 1 FROM {c} c JOIN t ON c.parent_id = t.id) SELECT id, depth FROM t", top=top, c=c
    )


@query("SELECT document_id, coalesce(max(page_to), 0) AS pages, count(DISTINCT page_from) AS n_first FROM c GROUP BY document_id")
def page_count(s, d):
    return _chunks(s, d).groupBy("document_id").agg(F.coalesce(F.max("page_to"), F.lit(0)).alias("pages"), F.count_distinct("page_from").alias("n_first"))


@query(", o AS (SELECT document_id, list(DISTINCT page_from) AS pages FROM c WHERE ocr GROUP BY 1) SELECT id, coalesce(len(list_filter(range(page_from, page_to + 1), lambda x: list_contains(pages, CAST(x AS INT)))) > 0, false) AS flag FROM c LEFT JOIN o USING (document_id)")
def ocr_flags(s, d):
    c = _chunks(s, d)
    pages = c.filter("ocr").groupBy("document_id").agg(F.collect_set("page_from").alias("pages"))
    return c.join(pages, "document_id", "left").select("id", F.coalesce(chunking.ocr_flag(F.col("page_from"), F.col("page_to"), F.col("pages")), F.lit(False)).alias("flag"))


@query("SELECT id, CAST(greatest(1, 86400 - (CAST(floor(epoch(created_at)) AS BIGINT) % 86400)) AS INT) AS seconds FROM l")
def retry_after(s, d):
    return _logs(s, d).select("id", T.retry_after(F.col("created_at")).alias("seconds"))


@query("""SELECT id, 'Frage: ' || question || chr(10) || 'Punkte:' || chr(10) || CASE WHEN len(expected_answer_points) > 0 THEN array_to_string(list_transform(expected_answer_points, lambda x: '- ' || x), chr(10)) ELSE '(keine)' END || chr(10) || 'Quellen:' || chr(10)
 || CASE WHEN len(gold_sources) > 0 THEN array_to_string(list_transform(gold_sources, lambda x: '- ' || concat_ws(', ', x.document, 'Abschnitt ' || x.section, 'Seite ' || x.page)), chr(10)) ELSE '(keine)' END AS prompt FROM eval_questions""")
def judge_prompts(s, d):
    e = table(s, d, "eval_questions")
    template = "Frage: {question}\nPunkte:\n{points}\nQuellen:\n{gold}"
    return e.select("id", reports.rendered(template, {"question": F.col("question"), "points": reports.bullets(F.col("expected_answer_points")), "gold": reports.gold_lines(F.col("gold_sources"))}).alias("prompt"))


@query(_RUNS + "SELECT question_id, count(*) AS n_report, CAST(1 AS BIGINT) AS n_wanted FROM r GROUP BY 1 HAVING count(*) <> 1 UNION ALL SELECT id, 0, 1 FROM eval_questions WHERE id NOT IN (SELECT question_id FROM r)")
def report_coverage(s, d):
    wanted = table(s, d, "eval_questions").select(F.col("id").alias("question_id"))
    return reports.coverage(_runs(s, d), wanted, "question_id")


@query(r""", a AS (SELECT id, answer, len(list_filter(regexp_split_to_array(answer, '\s+'), lambda x: x <> '')) AS n FROM l) SELECT id AS query_id, CAST(CASE WHEN answer IS NULL THEN 2 ELSE n + 4 END AS BIGINT) AS n_events, CASE WHEN answer IS NULL THEN 'error' ELSE 'done' END AS last FROM a""")
def answer_events(s, d):
    a = _logs(s, d).select(F.col("id").alias("query_id"), F.col("retrieved_ids").alias("sources"), "answer", F.when(F.col("answer").isNull(), "no answer").alias("error"))
    e = reports.answer_events(a)
    return e.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_events"), F.max_by("event", "seq").alias("last"))


@query("SELECT sha256(request_id || chr(0) || tenant_id) AS id, coalesce(answer = 'NICHT_GEFUNDEN', false) AS abstained, CAST(latency_ms['retrieval_ms'] + latency_ms['generation_ms'] AS INT) AS total_ms, CAST(cost_usd AS DOUBLE) AS cost FROM l")
def log_rows(s, d):
    a = _logs(s, d).select("request_id", "tenant_id", "question", "retrieved_ids", "answer", F.col("latency_ms")["retrieval_ms"].alias("retrieval_ms"), F.col("latency_ms")["generation_ms"].alias("generation_ms"), F.col("tokens")["prompt"].alias("prompt_tokens"), F.col("tokens")["completion"].alias("completion_tokens"), F.col("cost_usd").alias("cost"))
    return reports.log_rows(a, "x", F.lit(None).cast("timestamp")).select("id", "abstained", F.col("latency_ms")["total_ms"].alias("total_ms"), F.col("cost_usd").cast("double").alias("cost"))


# --- streams: what lies in a folder is read as a stream and worked on in micro-batches ------------------------------------


def _log_stream(s: SparkSession, d: str) -> DataFrame:
    schema = table(s, d, "query_logs").schema
    return streams.read_stream(s, f"{d}/query_log[s].parquet", schema)


@query("""SELECT CAST(date_trunc('hour', created_at AT TIME ZONE 'UTC') AS TIMESTAMP) AS start, count(*) AS n, count(*) FILTER (WHERE abstained) AS n_abstained, round(CAST(coalesce(sum(cost_usd), 0) AS DOUBLE), 6) AS cost FROM l GROUP BY 1""")
def stream_rolling_stats(s, d):
    out = streams.result(streams.rolling_stats(_log_stream(s, d), "1 hour", "60 days", "id"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", "n_abstained", F.round(F.col("cost").cast("double"), 6).alias("cost"))


@query("SELECT CAST(created_at AT TIME ZONE 'UTC' AS DATE) AS day, count(*) AS n, count(*) >= 200 AS exhausted FROM l GROUP BY 1")
def stream_daily_budget(s, d):
    return streams.result(streams.daily_questions(_log_stream(s, d), 200, "60 days", "id"))


@query(rf""", w AS (SELECT id, list_filter(regexp_split_to_array(answer, '{_BLANK}'), lambda x: x <> '') AS w FROM l WHERE answer IS NOT NULL) SELECT id AS request_id, array_to_string(w, '') AS text FROM w WHERE len(w) > 0""")
def stream_token_assembly(s, d):
    """Answers as streams of words with an end mark; state is kept per request until it comes."""
    once = _log_stream(s, d).filter("id IS NOT NULL").withWatermark("created_at", "60 days").dropDuplicatesWithinWatermark(["id"])
    split = once.select(F.col("id").alias("request_id"), F.col("created_at").alias("ts"), T.words(F.col("answer")).alias("w")).filter("size(w) > 0")  # once per answer, not per word
    deltas = split.select("request_id", "ts", F.posexplode(F.concat("w", F.array(F.lit("")))).alias("pos", "text"), F.size("w").alias("n"))
    deltas = deltas.select("request_id", "ts", F.col("pos").cast("long").alias("seq"), "text", F.when(F.col("pos") == F.col("n"), "stop").alias("finish_reason"))
    return streams.result(streams.token_streams(deltas, late=None), "append").select("request_id", "text")
