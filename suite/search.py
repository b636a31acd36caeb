"""Vector search over the embedding table: documents, history and collections.

The queries are the mean vectors of the labels, so every search reads the whole table on both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quorumlens.functions import vectors
from quorumlens.operators import inverted_file, retrieval
from quorumlens.session import scratch_path
from quorumlens.sources import vector_table
from suite import bindings as b
from suite.registry import register

_PAIRS = """pairs AS (
  SELECT c.query_id, d.doc_id, d.type, d.collection, d.content,
    round(1 - least(1.0, greatest(-1.0, list_dot_product(c.embedding, d.embedding)
      / (sqrt(list_dot_product(c.embedding, c.embedding)) * sqrt(list_dot_product(d.embedding, d.embedding))))), 9)
      AS distance
  FROM centroids c, docs d)"""

_SCORE = "round(1 / (1 + distance), 6) AS score"


def _rank(partition: str) -> str:
    return f"ROW_NUMBER() OVER (PARTITION BY {partition} ORDER BY distance, doc_id)"


def _scored(hits, *columns):
    return hits.select(*columns, F.round("score", 6).alias("score"))


@register(
    "cosine_score",
    """SELECT d.doc_id, a.doc_id AS anchor, round(list_dot_product(d.embedding, a.embedding)
           / (sqrt(list_dot_product(d.embedding, d.embedding)) * sqrt(list_dot_product(a.embedding, a.embedding))), 6)
           AS cosine
       FROM docs d JOIN docs a ON a.doc_id = (SELECT MIN(doc_id) FROM docs x WHERE x.label = d.label)""",
    "docs",
)
def cosine_score(spark, folder):
    docs = b.docs(spark, folder)
    anchors = docs.groupBy("label").agg(
        F.min("doc_id").alias("anchor"), F.min_by("embedding", "doc_id").alias("anchor_vector")
    )
    cosine = vectors.cosine(F.col("embedding"), F.col("anchor_vector"))
    joined = docs.select("doc_id", "label", "embedding").join(
        anchors, "label"
    )
    return joined.select("doc_id", "anchor", F.round(cosine, 6).alias("cosine"))


@register(
    "vector_topk",
    f"""WITH {_PAIRS} SELECT query_id, doc_id, rank, {_SCORE} FROM
         (SELECT *, {_rank('query_id')} AS rank FROM pairs) WHERE rank <= 5""",
    "docs centroids",
)
def vector_topk(spark, folder):
    hits = retrieval.topk(b.centroids(spark, folder), b.docs(spark, folder), 5)
    return _scored(hits, "query_id", "doc_id", "rank")


@register(
    "vector_topk_blocks",
    f"""WITH {_PAIRS} SELECT query_id, doc_id, rank, {_SCORE} FROM
         (SELECT *, {_rank('query_id')} AS rank FROM pairs) WHERE rank <= 5""",
    "docs centroids",
)
def vector_topk_blocks(spark, folder):
    """The way taken beyond the sent-query bound; the bound is set low to take it here."""
    hits = retrieval.topk(
        b.centroids(spark, folder), b.docs(spark, folder), 5, max_sent_queries=3, block_rows=256
    )
    return _scored(hits, "query_id", "doc_id", "rank")


@register(
    "vector_topk_filtered",
    f"""WITH {_PAIRS} SELECT query_id, doc_id, rank, {_SCORE} FROM
         (SELECT *, {_rank('query_id')} AS rank FROM pairs WHERE type = 'type2') WHERE rank <= 4""",
    "docs centroids",
)
def vector_topk_filtered(spark, folder):
    docs = b.docs(spark, folder)
    hits = retrieval.topk(b.centroids(spark, folder), docs, 4, where=F.col("type") == "type2")
    return _scored(hits, "query_id", "doc_id", "rank")


_DUAL = f"""{_PAIRS}, hits AS (SELECT * FROM
    (SELECT *, collection AS source, {_rank('query_id, collection')} AS rank FROM pairs)
    WHERE rank <= CASE WHEN source = 'knowledge' THEN 5 ELSE 3 END)"""


def _dual(spark, folder):
    docs = b.docs(spark, folder)
    knowledge = docs.filter(F.col("collection") == "knowledge")
    schema = docs.filter(F.col("collection") == "schema")
    presets = retrieval.PRESETS["default"]
    queries = b.centroids(spark, folder)
    return retrieval.dual(queries, knowledge, schema, *presets, columns=["content", "type"])


@register(
    "retrieve_dual",
    f"WITH {_DUAL} SELECT query_id, source, doc_id, rank, content, {_SCORE} FROM hits",
    "docs centroids",
)
def retrieve_dual(spark, folder):
    return _scored(_dual(spark, folder), "query_id", "source", "doc_id", "rank", "content")


@register(
    "retrieval_context",
    f"""WITH {_DUAL}, sections AS (
         SELECT query_id, source, CASE source WHEN 'knowledge' THEN '### Retrieved Knowledge'
             ELSE '### Retrieved Schema Information' END || chr(10)
           || string_agg(chr(10) || rank || '. ' || content || chr(10), '' ORDER BY rank) AS section
         FROM hits GROUP BY query_id, source)
       SELECT query_id, string_agg(section, chr(10) ORDER BY source) AS context
       FROM sections GROUP BY query_id""",
    "docs centroids",
)
def retrieval_context(spark, folder):
    return retrieval.context(_dual(spark, folder))


@register(
    "retrieval_summary",
    f"WITH {_DUAL} SELECT query_id, source, type, COUNT(*) AS n FROM hits GROUP BY 1, 2, 3",
    "docs centroids",
)
def retrieval_summary(spark, folder):
    return retrieval.summary(_dual(spark, folder), "type")


def _every_twentieth(spark, folder):
    docs = b.docs(spark, folder)
    queries = docs.filter(F.col("doc_id") % 20 == 0).select(F.col("doc_id").alias("query_id"), "embedding", "label")
    return queries, docs.select("doc_id", "embedding")


_TWENTIETH = """pairs AS (
  SELECT q.doc_id AS query_id, q.label, d.doc_id,
    round(1 - least(1.0, greatest(-1.0, list_dot_product(q.embedding, d.embedding)
      / (sqrt(list_dot_product(q.embedding, q.embedding)) * sqrt(list_dot_product(d.embedding, d.embedding))))), 9)
      AS distance
  FROM docs q, docs d WHERE q.doc_id % 20 = 0)"""


@register("vector_ann")
def vector_ann(spark, folder):
    """Every document's nearest documents by an inverted file; both sides are the whole table."""
    docs = b.docs(spark, folder).select("doc_id", "embedding")
    hits = inverted_file.search(docs.withColumnRenamed("doc_id", "query_id"), docs, 5)
    return _scored(hits, "query_id", "doc_id", "rank")


@register(
    "vector_ann_exact",
    f"""WITH {_TWENTIETH} SELECT query_id, doc_id, rank, {_SCORE} FROM
         (SELECT *, {_rank('query_id')} AS rank FROM pairs) WHERE rank <= 5""",
    "docs",
)
def vector_ann_exact(spark, folder):
    """The same lists, opened as far as the bounds of the cells demand for the exact result."""
    queries, docs = _every_twentieth(spark, folder)
    return _scored(inverted_file.search(queries, docs, 5, exact=True), "query_id", "doc_id", "rank")


@register(
    "vector_ann_recall",
    f"""WITH {_TWENTIETH} SELECT label, COUNT(DISTINCT query_id) AS n_queries, COUNT(*) AS n_exact, COUNT(*) AS n_found_at_0_9
         FROM (SELECT *, {_rank('query_id')} AS rank FROM pairs) WHERE rank <= 5 GROUP BY label""",
    "docs",
)
def vector_ann_recall(spark, folder):
    """Per label: true neighbours by exact search, and as many again if at least 0.9 of them were found, else how many."""
    queries, docs = _every_twentieth(spark, folder)
    exact = retrieval.topk(queries, docs, 5)
    counted = inverted_file.recall(inverted_file.search(queries, docs, 5), exact).join(queries.select("query_id", "label"), "query_id")
    sums = counted.groupBy("label").agg(F.count(F.lit(1)).alias("n_queries"), F.sum("n_exact").alias("n_exact"), F.sum("n_found").alias("n"))
    reached = F.when(10 * F.col("n") >= 9 * F.col("n_exact"), F.col("n_exact")).otherwise(F.col("n"))
    return sums.select("label", "n_queries", "n_exact", reached.alias("n_found_at_0_9"))


@register(
    "vec_append_ids",
    """SELECT vec_id, collection || '_' || (n + ROW_NUMBER() OVER (PARTITION BY collection ORDER BY vec_id) - 1)
         AS doc_id
       FROM (SELECT doc_id AS vec_id, collection FROM docs)
         JOIN (SELECT collection, COUNT(*) AS n FROM docs GROUP BY 1) USING (collection)""",
    "docs",
)
def vec_append_ids(spark, folder):
    stored = b.docs(spark, folder)
    new = stored.select(F.col("doc_id").alias("vec_id"), "collection")
    return vector_table.with_default_ids(new, stored, "vec_id").select("vec_id", "doc_id")


_PARAGRAPHS = """paragraphs AS (SELECT doc_id, doc_id || ':' || i AS id, part AS content FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS part, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)
  WHERE part <> ''),
states AS (
  SELECT 1 AS run, id, content FROM paragraphs WHERE doc_id % 10 <> 3
  UNION ALL SELECT run, id, content || CASE WHEN doc_id % 10 = 5 THEN ' (edited)' ELSE '' END
    FROM paragraphs, (VALUES (2), (3)) AS runs(run) WHERE doc_id % 10 <> 4)"""


@register(
    "index_sync",
    f"""WITH {_PARAGRAPHS}
       SELECT CAST(coalesce(n.run, o.run + 1) AS BIGINT) AS run,
         CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN o.content = n.content THEN 'same' ELSE 'changed' END AS change,
         COUNT(*) AS n_chunks
       FROM states n FULL JOIN states o ON n.id = o.id AND n.run = o.run + 1
       WHERE coalesce(n.run, o.run + 1) <= 3 GROUP BY 1, 2""",
)
def index_sync(spark, folder):
    """Paragraphs of the documents, indexed in three states: a tenth comes, a tenth goes, a tenth is edited, nothing changes."""
    documents = b.table(spark, folder, "documents")
    part = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "content")).filter("content <> ''")
    chunks = part.select(
        F.col("doc_id").alias("source"), F.concat_ws(":", "doc_id", "i").alias("doc_id"), "content", F.create_map(F.lit("type"), F.lit("paragraph")).alias("metadata")
    )
    first = chunks.filter("source % 10 <> 3")
    edited = F.when(F.col("source") % 10 == 5, F.concat("content", F.lit(" (edited)"))).otherwise(F.col("content"))
    second = chunks.filter("source % 10 <> 4").withColumn("content", edited)
    table = vector_table.VectorTable(spark, scratch_path(spark, "index"))
    embed = F.array(F.length("content").cast("float"), F.lit(1.0).cast("float"))
    runs = [table.sync(state, "paragraphs", embed).withColumn("run", F.lit(n)) for n, state in enumerate((first, second, second), 1)]
    return runs[0].unionByName(runs[1]).unionByName(runs[2])


@register(
    "vec_collection_counts",
    "SELECT collection, COUNT(*) AS n FROM docs GROUP BY collection",
    "docs",
)
def vec_collection_counts(spark, folder):
    return vector_table.collection_counts(b.docs(spark, folder))


# --- history ------------------------------------------------------------------------------------------

#: Every embedding belongs to the question of one session; sessions beyond the log have no record.
STRIDE = 30


def _history_docs(spark, folder):
    session = F.concat(F.lit("s"), (F.col("doc_id") * STRIDE).cast("string"))
    return b.docs(spark, folder).select(
        F.concat(F.lit("history_"), session).alias("doc_id"),
        session.alias("session_id"),
        "content",
        "embedding",
    )


_HISTORY = f"""hits AS (
    SELECT query_id, 's' || (doc_id * {STRIDE}) AS session_id, content, distance,
      'history_s' || (doc_id * {STRIDE}) AS hist_id FROM pairs),
  cut AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY distance, hist_id) AS r
    FROM hits) WHERE r <= 10),
  joined AS (SELECT query_id, session_id, COALESCE(question, content) AS question, sql_query, user_score,
      self_score, 1 / (1 + distance) AS similarity, distance, hist_id
    FROM cut LEFT JOIN query_log ON cut.session_id = query_log.id)"""


@register(
    "history_match",
    f"""WITH {_PAIRS}, {_HISTORY}
       SELECT query_id, session_id, question, sql_query, CAST(user_score AS BIGINT) AS user_score, self_score,
         rank, round(similarity, 6) AS similarity
       FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY distance, hist_id) AS rank
         FROM joined WHERE similarity >= 0.3 AND (COALESCE(user_score >= 3, false)
           OR COALESCE(self_score >= 60, false))) WHERE rank <= 5""",
    "docs centroids query_log",
)
def history_match(spark, folder):
    matches = retrieval.history(
        b.centroids(spark, folder),
        _history_docs(spark, folder),
        b.query_log(spark, folder),
        k=5,
        successful_only=True,
    )
    return matches.drop("final_response").withColumn("similarity", F.round("similarity", 6))


@register(
    "history_context",
    f"""WITH {_PAIRS}, {_HISTORY}, best AS (
         SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY distance, hist_id) AS rank
         FROM (SELECT * FROM joined WHERE hist_id IN (SELECT hist_id FROM cut c WHERE c.query_id = joined.query_id
             AND r <= 6) AND similarity >= 0.5 AND (COALESCE(user_score >= 3, false)
           OR COALESCE(self_score >= 60, false))))
       SELECT query_id, '### Similar Past Queries' || chr(10) || chr(10) || string_agg(
         '**Query ' || rank || '** (similarity: ' || printf('%.2f', similarity) || ')' || chr(10)
           || 'Question: ' || question || chr(10)
           || COALESCE('SQL: ' || CASE WHEN length(sql_query) > 200 THEN left(sql_query, 200) || '...'
             ELSE sql_query END || chr(10), ''), chr(10) ORDER BY rank) AS context
       FROM best WHERE rank <= 3 GROUP BY query_id""",
    "docs centroids query_log",
)
def history_context(spark, folder):
    matches = retrieval.history(
        b.centroids(spark, folder),
        _history_docs(spark, folder),
        b.query_log(spark, folder),
        k=3,
        min_score=0.5,
        successful_only=True,
    )
    return retrieval.history_context(matches)


@register(
    "history_unindexed",
    f"""SELECT id, question FROM query_log WHERE 'history_' || id NOT IN
         (SELECT 'history_s' || (doc_id * {STRIDE}) FROM docs)""",
    "docs query_log",
)
def history_unindexed(spark, folder):
    missing = retrieval.unindexed(b.query_log(spark, folder), _history_docs(spark, folder))
    return missing.select("id", "question")


@register(
    "history_index",
    f"""SELECT 'history_' || id AS doc_id, id AS session_id, question AS content, len(embedding) AS dimension
       FROM query_log JOIN docs ON id = 's' || (docs.doc_id * {STRIDE})""",
    "docs query_log",
)
def history_index(spark, folder):
    embedded = _history_docs(spark, folder).select(F.col("session_id").alias("id"), "embedding")
    indexed = retrieval.history_documents(b.query_log(spark, folder), embedded)
    return indexed.select("doc_id", "session_id", "content", F.size("embedding").alias("dimension"))


@register(
    "history_success",
    """SELECT COALESCE(user_score >= 3, false) OR COALESCE(self_score >= 60, false) AS successful,
         COUNT(*) AS n FROM query_log GROUP BY 1""",
    "query_log",
)
def history_success(spark, folder):
    ok = retrieval.was_successful(F.col("user_score"), F.col("self_score")).alias("successful")
    return b.query_log(spark, folder).groupBy(ok).agg(F.count(F.lit(1)).alias("n"))
