"""Nearest-document search, exact and approximate, and the operators built on its hits.

Search never joins queries with documents row by row. Queries whose number is checked travel to every
task; each task multiplies its document batches with the query matrix and keeps its own best ``k`` per
query, so at most ``k`` rows per query and task are shuffled. Beyond the checked number both sides are
cut into blocks, and every (query block, document block) cell is reduced to ``k`` per query in its task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorumlens.functions import textguard, vectors

#: Queries up to this number are sent to every task; more are handled in blocks.
MAX_SENT_QUERIES = 4096
#: Rows of one side in one block of the blocked search.
BLOCK_ROWS = 8192
#: Documents, and queries, compared at once inside a task; bounds the distance matrix to the square of this.
CHUNK_ROWS = 1024
#: Hits up to this number may be sent to every task.
MAX_SENT_HITS = 1_000_000
#: Bucket tables up to this many rows are sent to every task.
MAX_SENT_BUCKETS = 100_000
#: Places to which distances are rounded before ranking, so that ties do not depend on summation order.
RANK_DIGITS = 9

QUERY, DOC, DISTANCE, SCORE, RANK = "query_id", "doc_id", "distance", "score", "rank"


def _unit_rows(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; a zero vector gives NaN and is never a hit."""
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    with np.errstate(invalid="ignore", divide="ignore"):
        return rows / length


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit rows of an Arrow list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.empty((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths != lengths[0]).any():
        raise ValueError("the vectors have unequal lengths")
    return _unit_rows(flat.reshape(len(column), -1))


def _stacked(column: pd.Series) -> np.ndarray:
    if len({len(v) for v in column}) > 1:
        raise ValueError("the vectors have unequal lengths")
    return np.stack(column.to_numpy()).astype(np.float64)


def _nearest(qids, queries: np.ndarray, dids, docs: np.ndarray, k: int) -> pd.DataFrame:
    """Best ``k`` documents of every query among one batch of documents."""
    done = []
    for first in range(0, max(1, len(queries)), CHUNK_ROWS):
        asked, best = slice(first, first + CHUNK_ROWS), None
        for start in range(0, len(docs), CHUNK_ROWS):
            part = slice(start, start + CHUNK_ROWS)
            found = _nearest_of_chunk(qids[asked], queries[asked], dids[part], docs[part], k)
            best = found if best is None else _best(pd.concat([best, found]), k)
        done.append(best)
    return done[0] if len(done) == 1 else pd.concat(done)


def _nearest_of_chunk(qids, queries, dids, docs, k: int) -> pd.DataFrame:
    if queries.size and docs.size and queries.shape[1] != docs.shape[1]:
        raise ValueError(f"queries have {queries.shape[1]} dimensions, documents {docs.shape[1]}")
    distance = np.round(1.0 - np.clip(queries @ docs.T, -1.0, 1.0), RANK_DIGITS)
    usable = ~np.isnan(distance)
    if distance.shape[1] > k:
        filled = np.where(usable, distance, np.inf)
        usable &= filled <= np.partition(filled, k - 1, axis=1)[:, k - 1 : k]
    q, d = np.nonzero(usable)
    return _best(pd.DataFrame({QUERY: qids[q], DOC: dids[d], DISTANCE: distance[q, d]}), k)


def _best(hits: pd.DataFrame, k: int) -> pd.DataFrame:
    ordered = hits.sort_values([QUERY, DISTANCE, DOC], kind="stable")
    return ordered.groupby(QUERY, sort=False).head(k)


def _hit_type(queries: DataFrame, docs: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField(QUERY, queries.schema[QUERY].dataType),
            T.StructField(DOC, docs.schema[DOC].dataType),
            T.StructField(DISTANCE, T.DoubleType()),
        ]
    )


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    """Global best ``k`` per query; the rank filter also runs before the shuffle."""
    order = Window.partitionBy(QUERY).orderBy(DISTANCE, DOC)
    best = hits.withColumn(RANK, F.row_number().over(order)).filter(F.col(RANK) <= k)
    return best.withColumn(SCORE, vectors.score(F.col(DISTANCE)))


def _sent_search(queries: pa.Table, docs: DataFrame, k: int, schema: T.StructType) -> DataFrame:
    qids = queries.column(QUERY).to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast((qids, _matrix(queries.column("embedding"))))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = sent.value
        best = None
        for batch in batches:
            if batch.num_rows and len(ids):
                names = batch.column(DOC).to_numpy(zero_copy_only=False)
                found = _nearest(ids, matrix, names, _matrix(batch.column("embedding")), k)
                best = found if best is None else _best(pd.concat([best, found]), k)
        if best is not None:
            yield pa.RecordBatch.from_pandas(best, preserve_index=False)

    return docs.select(DOC, "embedding").mapInArrow(search, schema)


def _cells(df: DataFrame, id_column: str, own: str, other: str) -> DataFrame:
    """Give each row its own block and a copy for every block of the other side.

    The columns n_qblock and n_dblock hold the number of blocks of each side.
    """
    own_block = F.pmod(F.xxhash64(id_column), F.col(f"n_{own}")).cast("int")
    others = F.sequence(F.lit(0), F.col(f"n_{other}").cast("int") - 1)
    copies = df.withColumn(own, own_block).withColumn(other, F.explode(others))
    return copies.drop("n_qblock", "n_dblock")


def _blocks(rows: Column, block_rows: int) -> Column:
    return F.ceil(rows / F.lit(block_rows)).cast("int")


def _bucket_blocks(
    queries: DataFrame, docs: DataFrame, keys: Sequence[str], block_rows: int
) -> DataFrame:
    """Number of blocks of both sides for every bucket that both sides use."""
    count = F.count(F.lit(1))
    sizes = [
        df.groupBy(*keys).agg(_blocks(count, block_rows).alias(name))
        for df, name in ((queries, "n_qblock"), (docs, "n_dblock"))
    ]
    return sizes[0].join(sizes[1], list(keys))


def _search_cells(
    queries: DataFrame, docs: DataFrame, keys: Sequence[str], k: int, schema: T.StructType
) -> DataFrame:
    """Best ``k`` per query of every cell. A cell is one query block and one document block of one
    bucket, so a hot bucket is spread over many tasks and no task holds all of it."""
    q = _cells(queries, QUERY, "qblock", "dblock")
    d = _cells(docs, DOC, "dblock", "qblock")
    cell = [*keys, "qblock", "dblock"]

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({QUERY: left[QUERY][:0], DOC: right[DOC][:0], DISTANCE: []})
        return _nearest(
            left[QUERY].to_numpy(),
            _unit_rows(_stacked(left["embedding"])),
            right[DOC].to_numpy(),
            _unit_rows(_stacked(right["embedding"])),
            k,
        )

    # a fresh alias keeps both sides apart when queries and documents are the same table
    own = F.col("embedding").alias("embedding")
    return (
        q.select(QUERY, *cell, own)
        .groupBy(*cell)
        .cogroup(d.select(DOC, *cell, "embedding").groupBy(*cell))
        .applyInPandas(search, schema)
    )


def _search(
    queries: DataFrame,
    docs: DataFrame,
    k: int,
    max_sent_queries: int = MAX_SENT_QUERIES,
    block_rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, bool]:
    """Ranked hits, and whether their number is known to be small enough to send to every task."""
    q = queries.select(QUERY, "embedding").filter(F.col("embedding").isNotNull())
    d = docs.select(DOC, "embedding").filter(F.col("embedding").isNotNull())
    schema = _hit_type(q, d)
    if k <= 0:
        return _ranked(d.sparkSession.createDataFrame([], schema), 0), True
    probe = q.limit(max_sent_queries + 1).toArrow()
    if probe.num_rows <= max_sent_queries:
        small = probe.num_rows * k <= MAX_SENT_HITS
        return _ranked(_sent_search(probe, d, k, schema), k), small
    counts = {"n_qblock": q.count(), "n_dblock": d.count()}
    blocks = {name: _blocks(F.lit(n), block_rows) for name, n in counts.items()}
    hits = _search_cells(q.withColumns(blocks), d.withColumns(blocks), [], k, schema)
    return _ranked(hits, k), False


def _with_columns(hits: DataFrame, small: bool, docs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fetch document columns for the hits only, after the search."""
    if not columns:
        return hits
    sent = F.broadcast(hits) if small else hits
    return docs.select(DOC, *columns).join(sent, DOC)


def topk(
    queries: DataFrame,
    docs: DataFrame,
    k: int,
    where: Column | None = None,
    columns: Sequence[str] = (),
    max_sent_queries: int = MAX_SENT_QUERIES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Exact ``k`` nearest documents of every query: query_id, doc_id, rank, distance, score.

    ``queries`` has query_id and embedding, ``docs`` has doc_id and embedding. ``where`` filters
    documents before the search; ``columns`` adds document columns to the hits. Ties in distance are
    broken by the smaller doc_id. Fewer documents than ``k``, or none, give as many hits as there are.
    """
    chosen = docs if where is None else docs.filter(where)
    hits, small = _search(queries, chosen, k, max_sent_queries, block_rows)
    return _with_columns(hits, small, chosen, columns)


def ann(
    queries: DataFrame,
    docs: DataFrame,
    k: int,
    bits: int = 8,
    tables: int = 8,
    seed: int = 7,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Approximate nearest documents for two large sides.

    Each vector gets the signs of ``bits`` random projections as its bucket in each of ``tables``
    hash tables; only documents that share a bucket with a query are compared. Choose ``bits`` near
    log2(number of documents / block_rows). A bucket that many vectors fall into is cut into cells, so
    no task ever holds a whole bucket, and no cell returns more than ``k`` hits per query.

    Equal vectors would all share their buckets, so they are searched once: of equal documents only
    the ``k`` smallest ids can be hits, and equal queries have equal hits.
    """
    dim = docs.select(F.size("embedding")).filter(F.col("embedding").isNotNull()).limit(1).collect()
    if not dim:
        return topk(queries, docs, k)
    asked = queries.select(QUERY, "embedding", _vector_key().alias("copy_"))
    one_each = asked.groupBy(F.col("copy_").alias(QUERY)).agg(
        F.any_value("embedding").alias("embedding")
    )
    planes = np.random.default_rng(seed).standard_normal((tables, bits, dim[0][0]))
    found = _ann_of_distinct(one_each, _smallest_ids(docs, k), k, planes, block_rows)
    return found.withColumnRenamed(QUERY, "copy_").join(
        asked.select(QUERY, "copy_"), "copy_"
    ).drop("copy_")


def _vector_key() -> Column:
    """128 hash bits of a vector as text."""
    # the hash of each argument seeds the next one, so the constant comes first
    first, second = F.xxhash64("embedding"), F.xxhash64(F.lit(1), F.col("embedding"))
    return F.concat_ws(":", first.cast("string"), second.cast("string"))


def _smallest_ids(docs: DataFrame, k: int) -> DataFrame:
    """The ``k`` smallest ids of every distinct vector; larger ones lose every tie against them."""
    copies = Window.partitionBy(F.xxhash64("embedding"), "embedding").orderBy(DOC)
    numbered = docs.select(DOC, "embedding").withColumn("copy_", F.row_number().over(copies))
    return numbered.filter(F.col("copy_") <= k).drop("copy_")


def _ann_of_distinct(
    queries: DataFrame, docs: DataFrame, k: int, planes: np.ndarray, block_rows: int
) -> DataFrame:
    """Search inside hash buckets; ``planes`` holds one normal vector per table and bit."""
    tables, bits, dimension = planes.shape
    flat = planes.reshape(tables * bits, dimension)
    weights = 2 ** np.arange(bits)

    @F.pandas_udf("array<int>")
    def buckets(column: pd.Series) -> pd.Series:
        signs = (_stacked(column) @ flat.T > 0).reshape(len(column), tables, bits)
        return pd.Series(list((signs * weights).sum(axis=2).astype(np.int32)))

    def hashed(df: DataFrame, key: str) -> DataFrame:
        known = df.select(key, "embedding").filter(F.col("embedding").isNotNull())
        found = known.select("*", buckets("embedding").alias("buckets_"))
        return found.select(key, "embedding", F.posexplode("buckets_").alias("table_", "bucket"))

    keys = ["table_", "bucket"]
    q, d = hashed(queries, QUERY), hashed(docs, DOC)
    blocks = _bucket_blocks(q, d, keys, block_rows)
    if tables * 2**bits <= MAX_SENT_BUCKETS:
        blocks = F.broadcast(blocks)
    schema = _hit_type(queries, docs)
    hits = _search_cells(q.join(blocks, keys), d.join(blocks, keys), keys, k, schema)
    # a pair found in several tables is one hit
    return _ranked(hits.groupBy(QUERY, DOC).agg(F.min(DISTANCE).alias(DISTANCE)), k)


def suggested_bits(n_docs: int, block_rows: int = BLOCK_ROWS) -> int:
    """Hash bits that bring an average bucket down to one block."""
    return max(1, math.ceil(math.log2(max(2.0, n_docs / block_rows))))


#: (knowledge hits, schema hits) for each use of the dual search.
PRESETS = {"default": (5, 3), "definition": (5, 2), "sql": (3, 5)}


def dual(
    queries: DataFrame,
    knowledge: DataFrame,
    schema_docs: DataFrame,
    k_knowledge: int = 5,
    k_schema: int = 3,
    columns: Sequence[str] = (),
) -> DataFrame:
    """Hits of two collections together, marked by ``source``; k = 0 leaves a side out."""
    left = topk(queries, knowledge, k_knowledge, columns=columns)
    right = topk(queries, schema_docs, k_schema, columns=columns)
    return left.withColumn("source", F.lit("knowledge")).unionByName(
        right.withColumn("source", F.lit("schema"))
    )


def context(hits: DataFrame, text: str = "content", max_chunks: int = 10) -> DataFrame:
    """One text per query: numbered chunks of each source under its heading.

    A query has at most max_chunks // 2 chunks per source, so the list put together is short.
    """
    half = max_chunks // 2
    entry = F.format_string("\n%d. %s\n", RANK, text)
    shown = hits.filter(F.col(RANK) <= half)

    def section(source: str, heading: str) -> Column:
        chunks = F.collect_list(F.when(F.col("source") == source, F.struct(RANK, entry.alias("t"))))
        body = F.array_join(F.transform(F.sort_array(chunks), lambda c: c["t"]), "")
        return F.when(F.size(chunks) > 0, F.concat(F.lit(heading), body))

    return shown.groupBy(QUERY).agg(
        F.concat_ws(
            "\n",
            section("knowledge", "### Retrieved Knowledge\n"),
            section("schema", "### Retrieved Schema Information\n"),
        ).alias("context")
    )


def summary(hits: DataFrame, kind: str) -> DataFrame:
    """Number of hits per query, source and document type."""
    label = F.coalesce(F.col(kind), F.lit("unknown")).alias("type")
    return hits.groupBy(QUERY, "source", label).agg(F.count(F.lit(1)).alias("n"))


# --- history ------------------------------------------------------------------------------------


def was_successful(user_score: Column, self_score: Column) -> Column:
    """User rating of at least 3, or self score of at least 60; unrated counts as not successful."""
    rated = F.coalesce(user_score >= 3, F.lit(False))
    return rated | F.coalesce(self_score >= 60, F.lit(False))


def history_documents(log: DataFrame, embeddings: DataFrame) -> DataFrame:
    """One document per logged question that has an embedding (``id``, ``embedding``)."""
    return log.join(embeddings, "id").select(
        F.concat(F.lit("history_"), F.col("id")).alias(DOC),
        F.col("id").alias("session_id"),
        F.col("question").alias("content"),
        "embedding",
    )


def unindexed(log: DataFrame, documents: DataFrame, newest: int | None = None) -> DataFrame:
    """Log rows without a history document, optionally among the newest rows only."""
    rows = log if newest is None else log.orderBy(F.desc("created_at"), "id").limit(newest)
    marked = rows.withColumn(DOC, F.concat(F.lit("history_"), F.col("id")))
    return marked.join(documents.select(DOC), DOC, "left_anti").drop(DOC)


def history(
    queries: DataFrame,
    documents: DataFrame,
    log: DataFrame,
    k: int = 5,
    min_score: float = 0.3,
    successful_only: bool = False,
) -> DataFrame:
    """Similar past questions with their log record.

    Twice ``k`` hits are fetched; score and success filters follow, so fewer than ``k`` may remain.
    A hit without a log record keeps the document's own text.
    """
    found, small = _search(queries, documents, 2 * k)
    near = found.filter(F.col(SCORE) >= min_score)
    hits = _with_columns(near, small, documents, ["session_id", "content"])
    # The log is far larger than the hits: cut it to the hits' sessions before the outer join.
    wanted = hits.select(F.col("session_id").alias("id")).distinct()
    columns = ["id", "question", "sql_query", "final_response", "user_score", "self_score"]
    records = log.select(*columns).join(F.broadcast(wanted) if small else wanted, "id", "left_semi")
    if small:
        records = F.broadcast(records)
    joined = hits.join(records, hits["session_id"] == records["id"], "left").select(
        QUERY,
        "session_id",
        F.coalesce("question", "content").alias("question"),
        "sql_query",
        "final_response",
        "user_score",
        "self_score",
        F.col(SCORE).alias("similarity"),
        DISTANCE,
        DOC,
    )
    if successful_only:
        joined = joined.filter(was_successful(F.col("user_score"), F.col("self_score")))
    order = Window.partitionBy(QUERY).orderBy(DISTANCE, DOC)
    best = joined.withColumn(RANK, F.row_number().over(order)).filter(F.col(RANK) <= k)
    return best.drop(DISTANCE, DOC)


def history_context(matches: DataFrame) -> DataFrame:
    """One text per query listing its matches; a query has at most ``k`` of them."""
    sql = F.coalesce(
        F.concat(F.lit("SQL: "), textguard.truncate(F.col("sql_query"), 200), F.lit("\n")), F.lit("")
    )
    entry = F.concat(
        F.format_string("**Query %d** (similarity: %.2f)\nQuestion: ", RANK, "similarity"),
        F.col("question"),
        F.lit("\n"),
        sql,
    )
    entries = F.sort_array(F.collect_list(F.struct(RANK, entry.alias("t"))))
    body = F.array_join(F.transform(entries, lambda e: e["t"]), "\n")
    return matches.groupBy(QUERY).agg(
        F.concat(F.lit("### Similar Past Queries\n\n"), body).alias("context")
    )
