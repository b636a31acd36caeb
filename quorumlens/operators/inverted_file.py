"""Inverted file for vector search: documents in cells around centroids, queries against the cells that matter.

Cells come from Lloyd rounds over a bounded sample; their number follows the number of documents, so a list keeps
its length as the table grows. How many cells a query probes is read off the data: a few documents are searched exactly,
and as many nearest cells are probed as hold the wanted share of their true neighbours. On data without clusters that is
a share of all cells, so neither a query nor its hits may travel once a cell: neighbouring cells stand on one shelf, and
a query moves once to each shelf, with a bit for each of its cells. Few shelves of bounded size hold all lists, and a
query has ``k`` hits of each shelf.

The exact search probes first, which bounds the distance of each query's ``k``-th neighbour, and then opens the
further cells that can hold something nearer: by the triangle inequality on unit vectors, |q - d| is at least
|q - c| - |c - d|, and a cell's radius is the largest |c - d| of its list.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlens.functions import vectors
from quorumlens.operators import retrieval as r
from quorumlens.session import discard, written

#: Documents of a list on average, as long as ``MOST_CELLS`` allows.
LIST_ROWS = 256
#: Centroids are known to every task; their number is the bound of what is sent.
MOST_CELLS = 16_384
#: Documents a cell that the centroids are fitted on: a sample of at most MOST_CELLS times as many rows.
SAMPLE_ROWS = 64
ROUNDS = 6
#: Share of true neighbours that the probed cells are to hold, and documents that it is measured on.
TARGET, MEASURED = 0.97, 256

#: Shelves and query blocks that a table is cut into, unless they grow beyond ``BLOCK_BYTES`` of vectors or below
#: ``LEAST_ROWS``; cells on a shelf.
PIECES, LEAST_ROWS, BLOCK_BYTES, SHELF_CELLS = 8, 1024, 1 << 25, 1024
#: Entries of a matrix of similarities that a task holds at once.
ENTRIES = 1 << 20

#: Slack for rounded distances in the exact search.
_SLACK = 1e-6


@dataclass(frozen=True)
class Cells:
    """Unit centroids, one a row."""

    centroids: np.ndarray

    def __len__(self) -> int:
        return len(self.centroids)

    def similarities(self, unit: np.ndarray) -> np.ndarray:
        if unit.shape[1] != self.centroids.shape[1]:
            raise ValueError(f"vectors have {unit.shape[1]} dimensions, centroids {self.centroids.shape[1]}")
        return np.nan_to_num(unit @ self.centroids.T, nan=-2.0)


def _distance(similarity: np.ndarray) -> np.ndarray:
    """Length of the difference of two unit vectors."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * similarity))


def _chunks(column: pd.Series, width: int) -> Iterator[np.ndarray]:
    """Unit rows of a column, as many at once as may be compared with ``width`` centroids."""
    rows = max(1, min(r.CHUNK_ROWS, ENTRIES // max(1, width)))
    for start in range(0, len(column), rows):
        yield r._unit_rows(r._stacked(column.iloc[start : start + rows]))


def _units(column: pd.Series) -> np.ndarray:
    """All unit rows of a column, without a second copy of them on the way."""
    out, at = None, 0
    for unit in _chunks(column, 1):
        out = np.empty((len(column), unit.shape[1])) if out is None else out
        if unit.shape[1] != out.shape[1]:
            raise ValueError("the vectors have unequal lengths")
        out[at : at + len(unit)] = unit
        at += len(unit)
    return out


def fit(
    docs: DataFrame,
    list_rows: int = LIST_ROWS,
    most_cells: int = MOST_CELLS,
    sample_rows: int = SAMPLE_ROWS,
    rounds: int = ROUNDS,
) -> Cells:
    """Centroids for about ``n / list_rows`` lists, from Lloyd rounds over a sample; runs a job a round.

    The sample takes documents by a hash of their id: all of a small table, at most about ``most_cells`` x
    ``sample_rows`` of a large one. Start and rounds are the same in every run. A table without vectors has no cell.
    """
    known = docs.select(r.DOC, "embedding").filter(F.col("embedding").isNotNull())
    n = known.count()
    if not n:
        return Cells(np.empty((0, 0)))
    cells = min(most_cells, max(1, math.ceil(n / list_rows)))
    of_million = math.ceil(1_000_000 * min(1.0, 2 * cells * sample_rows / n))
    chosen = known.filter(F.pmod(F.xxhash64(r.DOC), F.lit(1_000_000)) < of_million)
    sample = written(chosen, "cell-sample")
    # Equal vectors start one cell, not many.
    start = sample.groupBy("embedding").agg(F.min(F.xxhash64(F.lit(1), r.DOC)).alias("h")).orderBy("h").limit(cells)
    centroids = r._unit_rows(np.array([x["embedding"] for x in start.collect()], np.float64))
    centroids = centroids[~np.isnan(centroids).any(axis=1)]
    for _ in range(rounds if len(centroids) else 0):
        found = Cells(centroids)
        means = vectors.mean_vector("embedding", "cell")(_unit(listed(sample, found)).select("cell", "embedding"))
        moved = {x["cell"]: x["embedding"] for x in means.collect()}
        new = np.array([moved.get(i, centroids[i]) for i in range(len(centroids))], np.float64)
        new = np.where(np.linalg.norm(new, axis=1, keepdims=True) > 0, new, centroids)
        centroids = r._unit_rows(new)
    discard(sample)
    return Cells(centroids)


def _unit(df: DataFrame) -> DataFrame:
    length = vectors.norm(F.col("embedding"))
    unit = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.try_divide(x, F.col("length_")))
    return df.withColumn("length_", length).filter(F.col("length_") > 0).withColumn("embedding", unit).drop("length_")


def listed(docs: DataFrame, cells: Cells) -> DataFrame:
    """doc_id, embedding, cell and residual (distance to the centroid) of every document that has a direction."""
    sent = docs.sparkSession.sparkContext.broadcast(cells)

    @F.pandas_udf("cell int, residual double")
    def nearest(column: pd.Series) -> pd.DataFrame:
        cell, residual = [], []
        for unit in _chunks(column, len(sent.value)):
            near = sent.value.similarities(unit)
            best = near.argmax(axis=1)
            top = near[np.arange(len(best)), best]
            cell += np.where(top < -1.5, -1, best).tolist()
            residual += _distance(top).tolist()
        return pd.DataFrame({"cell": cell, "residual": residual})

    known = docs.select(r.DOC, "embedding").filter(F.col("embedding").isNotNull())
    return known.withColumn("at_", nearest("embedding")).select(r.DOC, "embedding", "at_.cell", "at_.residual").filter("cell >= 0")


def _boundary(similar: np.ndarray, probes: int) -> np.ndarray:
    """Similarity of the last of the ``probes`` nearest cells, one row a query."""
    last = similar.shape[1] - min(probes, similar.shape[1])
    return np.partition(similar, last, axis=1)[:, last : last + 1]


def _probed(similar: np.ndarray, probes: int) -> np.ndarray:
    """Which cells each query probes: the ``probes`` nearest, and those as near as the last of them."""
    return (similar >= _boundary(similar, probes)) & (similar > -1.5)


def _reachable(similar: np.ndarray, probes: int, reach: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Which cells beyond the probed ones may hold a nearer document than ``reach`` tells.

    Cells about as near as the last probed one are opened again, as similarities differ in the last digits between runs.
    """
    may = _distance(similar) - radius[None, :] <= reach[:, None] + _SLACK
    return may & (similar <= _boundary(similar, probes) + _SLACK) & (similar > -1.5) & (radius[None, :] >= 0)


def _shelves(cells: Cells, sizes: np.ndarray, rows: int, most: int = SHELF_CELLS) -> list[np.ndarray]:
    """The cells with documents, neighbours together, in groups of at most ``rows`` documents or of one cell.

    A group with more is cut across the coordinate in which its centroids differ most, where half of its documents are.
    """
    todo, done = [np.flatnonzero(sizes)], []
    while todo:
        part = todo.pop()
        if len(part) <= 1 or (sizes[part].sum() <= rows and len(part) <= most):
            done += [part] if len(part) else []
            continue
        axis = cells.centroids[part].var(axis=0).argmax()
        part = part[np.argsort(cells.centroids[part, axis], kind="stable")]
        before = np.cumsum(sizes[part])
        cut = min(len(part) - 1, int(np.searchsorted(before, before[-1] / 2)) + 1)
        todo += [part[cut:], part[:cut]]
    return done


def _routed(queries: DataFrame, cells: Cells, shelves: list[np.ndarray], probes: int, radius: np.ndarray | None = None) -> DataFrame:
    """query_id, embedding, shelf, bits: a row for each shelf with a cell that the query opens, and a bit for each cell on it.

    With ``radius``, the cells are those that ``reach`` demands beyond the probed ones.
    """
    sent = queries.sparkSession.sparkContext.broadcast((cells, shelves, radius))

    @F.pandas_udf("array<struct<shelf:int,bits:binary>>")
    def opened(column: pd.Series, reach: pd.Series) -> pd.Series:
        found, stands, radii = sent.value
        out, at = [], 0
        for unit in _chunks(column, len(found)):
            similar = found.similarities(unit)
            limit = reach.to_numpy()[at : at + len(unit)]
            open_ = _probed(similar, probes) if radii is None else _reachable(similar, probes, limit, radii)
            own = [[] for _ in unit]
            for number, stand in enumerate(stands):
                part = open_[:, stand]
                packed = np.packbits(part, axis=1)
                for i in np.flatnonzero(part.any(axis=1)).tolist():
                    own[i].append({"shelf": number, "bits": packed[i].tobytes()})
            out += own
            at += len(unit)
        return pd.Series(out)

    reach = F.lit(0.0) if radius is None else F.col("reach")
    return queries.select(r.QUERY, "embedding", F.explode(opened("embedding", reach)).alias("at_")).select(r.QUERY, "embedding", "at_.*")


def _block_rows(n: int, dimension: int) -> int:
    """Rows of one side in a block: the side in ``PIECES``, within bounds."""
    return max(1, min(BLOCK_BYTES // (8 * max(1, dimension)), max(LEAST_ROWS, math.ceil(n / PIECES))))


def _merged(best: tuple[np.ndarray, np.ndarray], q: np.ndarray, rank: np.ndarray, distance: np.ndarray) -> None:
    """Put hits (row of a query, rank of a document's id, distance) among the best ones of each query, in place."""
    far, ids = best
    rows, place = np.unique(q, return_inverse=True)
    k = far.shape[1]
    place = np.concatenate([place, np.repeat(np.arange(len(rows)), k)])
    distance = np.concatenate([distance, far[rows].ravel()])
    rank = np.concatenate([rank, ids[rows].ravel()])
    order = np.lexsort((rank, distance, place))
    first = np.searchsorted(place[order], np.arange(len(rows)))
    chosen = order[first[:, None] + np.arange(k)]
    far[rows], ids[rows] = distance[chosen], rank[chosen]


def _compare(best: tuple[np.ndarray, np.ndarray], rows: np.ndarray, queries: np.ndarray, rank: np.ndarray, docs: np.ndarray) -> None:
    """Compare some queries with some documents; only pairs that may enter a query's best hits are looked at further."""
    far, _ = best
    k = far.shape[1]
    similar = queries @ docs.T
    limit = 1.0 - far[rows, -1]
    new = np.flatnonzero(np.isinf(limit))
    if len(new) and len(rank) > k:
        limit[new] = np.partition(similar[new], len(rank) - k, axis=1)[:, len(rank) - k]
    q, d = np.nonzero(similar >= limit[:, None] - 10.0**-r.RANK_DIGITS)
    if len(q):
        distance = np.round(1.0 - np.clip(similar[q, d], -1.0, 1.0), r.RANK_DIGITS)
        _merged(best, rows[q], rank[d], distance)


def _searched(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    """Best ``k`` documents of each query on one shelf, among the cells whose bits are set."""
    if left.empty or right.empty:
        return pd.DataFrame({r.QUERY: left[r.QUERY][:0], r.DOC: right[r.DOC][:0], r.DISTANCE: []})
    right = right.sort_values(r.DOC, kind="stable")
    names, place = right[r.DOC].to_numpy(), right["place"].to_numpy()
    queries, docs = _units(left["embedding"]), _units(right["embedding"])
    if queries.shape[1] != docs.shape[1]:
        raise ValueError(f"queries have {queries.shape[1]} dimensions, documents {docs.shape[1]}")
    bits = np.frombuffer(b"".join(left["bits"]), np.uint8).reshape(len(left), -1)
    best = np.full((len(left), k), np.inf), np.full((len(left), k), len(names), np.int64)
    for cell in np.unique(place):
        asked = np.flatnonzero(bits[:, cell >> 3] & (128 >> (cell & 7)))
        own = np.flatnonzero(place == cell)
        for i in range(0, len(own), r.CHUNK_ROWS):
            part = own[i : i + r.CHUNK_ROWS]
            step = max(1, ENTRIES // len(part))
            for j in range(0, len(asked), step):
                rows = asked[j : j + step]
                _compare(best, rows, queries[rows], part, docs[part])
    q, at = np.nonzero(np.isfinite(best[0]))
    return pd.DataFrame({r.QUERY: left[r.QUERY].to_numpy()[q], r.DOC: names[best[1][q, at]], r.DISTANCE: best[0][q, at]})


def _found(routed: DataFrame, lists: DataFrame, shelves: list[np.ndarray], sizes: np.ndarray, blocks: tuple[int, int], k: int) -> DataFrame:
    """Best ``k`` of each query on each shelf it comes to. A long list, and the many queries of a shelf, are cut into blocks."""
    spark, (query_rows, doc_rows) = lists.sparkSession, blocks
    asked = {x["shelf"]: x["n"] for x in routed.groupBy("shelf").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = {i: (math.ceil(n / query_rows), max(1, math.ceil(int(sizes[shelves[i]].sum()) / doc_rows))) for i, n in asked.items()}
    schema = r._hit_type(routed, lists)
    if not parts:
        return spark.createDataFrame([], schema)
    # One row a shelf and one a cell: as bounded as the centroids, which every task knows.
    cut = spark.createDataFrame([(i, *n) for i, n in parts.items()], "shelf int, n_qblock int, n_dblock int")
    at = [(int(c), i, place, *parts[i]) for i in parts for place, c in enumerate(shelves[i])]
    stood = spark.createDataFrame(at, "cell int, shelf int, place int, n_qblock int, n_dblock int")
    q = r._cells(routed.join(F.broadcast(cut), "shelf"), r.QUERY, "qblock", "dblock")
    d = r._cells(lists.join(F.broadcast(stood), "cell"), r.DOC, "dblock", "qblock")
    key = ["shelf", "qblock", "dblock"]
    own = F.col("embedding").alias("embedding")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _searched(left, right, k)

    grouped = q.select(r.QUERY, *key, own, "bits").groupBy(*key)
    return grouped.cogroup(d.select(r.DOC, *key, "place", "embedding").groupBy(*key)).applyInPandas(search, schema)


def probes_needed(docs: DataFrame, cells: Cells, k: int, target: float = TARGET, measured: int = MEASURED) -> int:
    """Cells a query has to probe for ``target`` of the true ``k`` nearest, on ``measured`` documents searched exactly.

    The documents with the smallest hashes are the queries of one exact scan. All cells, if there is none to measure.
    """
    known = docs.select(r.DOC, "embedding").filter(F.col("embedding").isNotNull())
    asked = known.orderBy(F.xxhash64(F.lit(2), r.DOC)).limit(measured)
    hits = r.topk(asked.withColumnRenamed(r.DOC, r.QUERY), known, k)
    pairs = known.withColumnRenamed("embedding", "found").join(hits.select(r.QUERY, r.DOC), r.DOC)
    pairs = pairs.join(asked.select(F.col(r.DOC).alias(r.QUERY), "embedding"), r.QUERY).select("found", "embedding").toArrow()
    if not pairs.num_rows:
        return len(cells)
    cell = cells.similarities(r._matrix(pairs.column("found"))).argmax(axis=1)
    near = cells.similarities(r._matrix(pairs.column("embedding")))
    place = (near > near[np.arange(len(cell)), cell][:, None]).sum(axis=1)
    return int(np.sort(place)[math.ceil(target * len(place)) - 1]) + 1


def search(
    queries: DataFrame,
    docs: DataFrame,
    k: int,
    exact: bool = False,
    target: float = TARGET,
    list_rows: int = LIST_ROWS,
    most_cells: int = MOST_CELLS,
) -> DataFrame:
    """The ``k`` nearest documents of each query: query_id, doc_id, rank, distance, score.

    Without ``exact``, about ``target`` of the true neighbours are found, by the cells that hold them; with it, all.
    Ties go to the smaller doc_id. Of documents with equal vectors the ``k`` with the smallest ids are listed, as no
    other one can be a hit. Null and zero vectors are no hits and have none. Runs jobs: the fit, one exact scan for
    a few documents, and one that writes the lists.
    """
    spark = docs.sparkSession
    known = r._smallest_ids(docs.select(r.DOC, "embedding").filter(F.col("embedding").isNotNull()), max(k, 1))
    asked = queries.select(r.QUERY, "embedding").filter(F.col("embedding").isNotNull())
    if k <= 0:
        return r._ranked(spark.createDataFrame([], r._hit_type(asked, known)), 0)
    known = written(known, "vector-known")
    cells = fit(known, list_rows, most_cells)
    if not len(cells):
        return r._ranked(spark.createDataFrame([], r._hit_type(asked, known)), k)
    probes = probes_needed(known, cells, k, target)
    lists = written(listed(known, cells), "vector-lists")
    discard(known)
    radius, sizes = np.full(len(cells), -1.0), np.zeros(len(cells), np.int64)
    for x in lists.groupBy("cell").agg(F.max("residual").alias("r"), F.count(F.lit(1)).alias("n")).collect():
        radius[x["cell"]], sizes[x["cell"]] = x["r"], x["n"]
    lists, dimension = lists.drop("residual"), cells.centroids.shape[1]
    blocks = _block_rows(asked.count(), dimension), _block_rows(int(sizes.sum()), dimension)
    shelves = _shelves(cells, sizes, blocks[1])
    first = _found(_routed(asked, cells, shelves, probes), lists, shelves, sizes, blocks, k)
    if not exact:
        return r._ranked(first, k)
    first = written(r._ranked(first, k).select(r.QUERY, r.DOC, r.DISTANCE), "vector-first")
    # A query with fewer than k hits so far has to see every cell.
    kth = first.groupBy(r.QUERY).agg(F.count(F.lit(1)).alias("n"), F.max(r.DISTANCE).alias("far"))
    reach = F.when(F.col("n") == k, F.sqrt(2 * F.col("far"))).otherwise(F.lit(4.0))
    limits = kth.select(r.QUERY, reach.alias("reach"))
    bounded = asked.join(limits, r.QUERY, "left").withColumn("reach", F.coalesce("reach", F.lit(4.0)))
    more = _found(_routed(bounded, cells, shelves, probes, radius), lists, shelves, sizes, blocks, k)
    return r._ranked(first.unionByName(more).groupBy(r.QUERY, r.DOC).agg(F.min(r.DISTANCE).alias(r.DISTANCE)), k)


def compared(queries: DataFrame, docs: DataFrame, cells: Cells, probes: int) -> DataFrame:
    """n_pairs: how many (query, document) pairs a search with so many probes compares."""
    sent = queries.sparkSession.sparkContext.broadcast(cells)

    @F.pandas_udf("array<int>")
    def probed(column: pd.Series) -> pd.Series:
        chunks = _chunks(column, len(sent.value))
        return pd.Series([np.flatnonzero(row).tolist() for unit in chunks for row in _probed(sent.value.similarities(unit), probes)])

    sizes = listed(docs, cells).groupBy("cell").agg(F.count(F.lit(1)).alias("n_docs"))
    known = queries.filter(F.col("embedding").isNotNull())
    asked = known.select(F.explode(probed("embedding")).alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n_queries"))
    return asked.join(sizes, "cell").agg(F.coalesce(F.sum(F.col("n_docs") * F.col("n_queries")), F.lit(0)).alias("n_pairs"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """query_id, n_exact, n_found: hits of the exact search, and how many of them the other one has."""
    hit = found.select(r.QUERY, r.DOC).withColumn("hit_", F.lit(1))
    joined = exact.select(r.QUERY, r.DOC).join(hit, [r.QUERY, r.DOC], "left")
    return joined.groupBy(r.QUERY).agg(F.count(F.lit(1)).alias("n_exact"), F.count("hit_").alias("n_found"))
