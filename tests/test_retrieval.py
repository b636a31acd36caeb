import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorumlens.functions import vectors
from quorumlens.operators import inverted_file, retrieval
from quorumlens.sources import vector_table
from quorumlens.sources.vector_table import VectorTable
from tests.conftest import rows


def _vectors(spark, matrix, name, start=0):
    data = [(start + i, [float(x) for x in row]) for i, row in enumerate(matrix)]
    return spark.createDataFrame(data, f"{name} bigint, embedding array<float>")


def _brute(queries, docs, k):
    q = queries / np.linalg.norm(queries, axis=1, keepdims=True)
    d = docs / np.linalg.norm(docs, axis=1, keepdims=True)
    distance = np.round(1 - np.clip(q @ d.T, -1, 1), 9)
    found = set()
    for i, line in enumerate(distance):
        order = np.lexsort((np.arange(len(line)), line))[:k]
        found |= {(i, int(j), r + 1) for r, j in enumerate(order)}
    return found


@pytest.fixture(scope="module")
def clouds(spark):
    rng = np.random.default_rng(3)
    q = rng.standard_normal((23, 8)).astype(np.float32)
    d = rng.standard_normal((400, 8)).astype(np.float32)
    d[100:220] = d[7]  # a hot group of identical copies
    return q, d, _vectors(spark, q, "query_id"), _vectors(spark, d, "doc_id").repartition(5)


@pytest.mark.parametrize("bound, block", [(4096, 8192), (5, 64), (5, 7)])
def test_search_equals_brute_force(clouds, bound, block):
    q, d, queries, docs = clouds
    hits = retrieval.topk(queries, docs, 6, max_sent_queries=bound, block_rows=block)
    got = {(r.query_id, r.doc_id, r.rank) for r in hits.collect()}
    assert got == _brute(q.astype(float), d.astype(float), 6)


def test_search_of_a_table_against_itself(clouds):
    _, d, _, docs = clouds
    hits = retrieval.topk(docs.withColumnRenamed("doc_id", "query_id"), docs, 1, max_sent_queries=1)
    nearest = {r.query_id: r.doc_id for r in hits.collect()}
    assert nearest[5] == 5 and nearest[150] == 7 and len(nearest) == len(d)


def test_text_ids(spark, clouds):
    q, d, queries, docs = clouds
    named = docs.withColumn("doc_id", F.format_string("d%05d", "doc_id"))
    got = {(r.query_id, int(r.doc_id[1:]), r.rank) for r in retrieval.topk(queries, named, 4).collect()}
    assert got == _brute(q.astype(float), d.astype(float), 4)


def test_edge_cases(spark):
    queries = _vectors(spark, [[1, 0]], "query_id")
    docs = _vectors(spark, [[-1, 0], [0, 0], [2, 0]], "doc_id")
    got = rows(retrieval.topk(queries, docs, 10).select("doc_id", "rank", "score"))
    assert got == [(0, 2, 1 / 3), (2, 1, 1.0)]  # the zero vector is no hit, k is clipped
    assert rows(retrieval.topk(queries, docs.limit(0), 3)) == []
    assert rows(retrieval.topk(queries.limit(0), docs, 3)) == []
    assert rows(retrieval.topk(queries, docs, 0)) == []
    assert rows(retrieval.topk(queries, docs, 3, where=F.col("doc_id") > 5)) == []


def test_filter_comes_before_the_cut(clouds):
    q, d, queries, docs = clouds
    got = retrieval.topk(queries, docs, 3, where=F.col("doc_id") >= 300)
    assert got.count() == 3 * len(q) and got.agg(F.min("doc_id")).first()[0] >= 300


def test_approximate_search_recall_and_size(clouds):
    q, d, queries, docs = clouds
    exact = _brute(q.astype(float), d.astype(float), 5)
    near = retrieval.ann(queries, docs, 5, bits=3, tables=12, block_rows=50).collect()
    assert max(r.rank for r in near) <= 5
    pairs = {(r.query_id, r.doc_id) for r in near}
    assert len(pairs & {e[:2] for e in exact}) / len(exact) > 0.8


def test_equal_vectors_are_searched_once_with_whole_results(clouds):
    _, d, _, docs = clouds
    queries = docs.withColumnRenamed("doc_id", "query_id")
    near = retrieval.ann(queries, docs, 4, bits=4, tables=3, block_rows=64).collect()
    hits = {}
    for r in sorted(near, key=lambda r: (r.query_id, r.rank)):
        hits.setdefault(r.query_id, []).append(r.doc_id)
    assert len(hits) == len(d)
    assert all(hits[q] == [7, 100, 101, 102] for q in [7, *range(100, 220)])


def test_cosine_column(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])],
                               "a array<double>, b array<double>")
    got = [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 0.0 and got[1] == pytest.approx(1.0) and got[1] <= 1.0 and got[2] is None


def test_dual_leaves_a_side_out(clouds):
    _, _, queries, docs = clouds
    hits = retrieval.dual(queries, docs, docs, 0, 2)
    assert rows(hits.select("source").distinct()) == [("schema",)]


def test_context_lists_half_of_the_chunks_per_side(spark):
    hits = spark.createDataFrame(
        [(1, i, "knowledge", f"k{i}") for i in range(1, 8)] + [(1, 1, "schema", "s1")],
        "query_id int, rank int, source string, content string",
    )
    text = retrieval.context(hits, max_chunks=4).first().context
    assert text == (
        "### Retrieved Knowledge\n\n1. k1\n\n2. k2\n\n### Retrieved Schema Information\n\n1. s1\n"
    )


LOG = "id string, question string, sql_query string, final_response string, user_score int, self_score double"


def test_history_filters_after_the_cut_and_falls_back(spark):
    queries = _vectors(spark, [[1, 0]], "query_id")
    docs = spark.createDataFrame(
        [(f"history_s{i}", f"s{i}", f"text {i}", [1.0, i / 10]) for i in range(6)],
        "doc_id string, session_id string, content string, embedding array<float>",
    )
    log = spark.createDataFrame(
        [("s0", "q0", "x", None, 1, 10.0), ("s1", "q1", "y", None, None, 60.0), ("s5", "q5", "z", None, 5, None)],
        LOG,
    )
    every = retrieval.history(queries, docs, log, k=2).orderBy("rank").collect()
    assert [(r.session_id, r.question) for r in every] == [("s0", "q0"), ("s1", "q1")]
    good = retrieval.history(queries, docs, log, k=2, successful_only=True).collect()
    assert [r.session_id for r in good] == ["s1"]  # s5 is beyond the cut of 2k
    assert rows(retrieval.history(queries, docs, log, min_score=1.1)) == []
    found = retrieval.history(queries, docs, log, k=3).orderBy("rank").collect()
    assert found[2].question == "text 2" and found[2].sql_query is None


def test_unindexed(spark):
    log = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, created_at int")
    docs = spark.createDataFrame([("history_b",)], "doc_id string")
    assert rows(retrieval.unindexed(log, docs).select("id")) == [("a",), ("c",)]
    assert rows(retrieval.unindexed(log, docs, newest=2).select("id")) == [("c",)]


# --- collections --------------------------------------------------------------------------------------


@pytest.mark.parametrize("files", [1, 7, 64])
def test_dense_numbers_of_a_hot_group(spark, files):
    df = spark.range(500).select(F.col("id"), F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("g"))
    got = vector_table.dense_numbers(df.repartition(files), "g", "id").orderBy("id").collect()
    for group in ("a", "b"):
        assert [r.number for r in got if r.g == group] == list(range(sum(r.g == group for r in got)))


def test_vector_table(spark, tmp_path):
    table = VectorTable(spark, str(tmp_path / "vectors"))
    assert rows(table.read()) == [] and not table.is_indexed()
    chunks = spark.createDataFrame([("one", {"type": "a"}), ("two", {"type": "b"})], "content string, metadata map<string,string>")
    embed = F.array(F.length("content").cast("float"), F.lit(1.0).cast("float"))
    first = table.build_index(chunks, chunks.limit(1), embed)
    assert rows(first) == [("knowledge", 2, "indexed"), ("schema", 1, "indexed")]
    again = table.build_index(chunks, chunks, embed)
    assert rows(again) == [("knowledge", 2, "already_indexed"), ("schema", 1, "already_indexed")]
    forced = table.build_index(chunks, chunks, embed, force=True)
    assert rows(forced.select("collection", "n")) == [("knowledge", 2), ("schema", 2)]

    new = spark.createDataFrame([(5, "knowledge", "x"), (9, "knowledge", "y"), (1, "query_history", "z")],
                                "k int, collection string, content string")
    numbered = vector_table.with_default_ids(new, table.read(), "k")
    assert rows(numbered.select("k", "doc_id")) == [(1, "query_history_0"), (5, "knowledge_2"), (9, "knowledge_3")]
    table.append(numbered.withColumns({"metadata": F.create_map().cast("map<string,string>"),
                                       "embedding": F.array(F.lit(1.0).cast("float"))}))
    assert rows(table.counts()) == [("knowledge", 4), ("query_history", 1), ("schema", 2)]
    assert table.delete("schema") and not table.delete("schema")
    assert rows(table.collections()) == [("knowledge",), ("query_history",)]
    table.reset()
    assert rows(table.read()) == []


def test_dense_numbers_of_text_and_null(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), (None, "y"), ("a", "x"), (None, "b")], "g string, o string")
    got = rows(vector_table.dense_numbers(df, "g", "o"))
    assert got == rows(spark.createDataFrame([("a", None, 0), ("a", "x", 1), ("a", "x", 2), (None, "b", 0), (None, "y", 1)], "g string, o string, number long"))


def test_a_taken_id_is_refused(spark, tmp_path):
    table = VectorTable(spark, str(tmp_path / "vectors"))

    def docs(*ids):
        return spark.createDataFrame(
            [(i, i, {"k": "v"}, [1.0], "c") for i in ids],
            "doc_id string, content string, metadata map<string,string>, embedding array<float>, collection string",
        )

    table.append(docs("c_0", "c_1"))
    for more in (docs("c_1"), docs("c_2", "c_2")):
        with pytest.raises(ValueError, match="c/c_"):
            table.append(more)
    table.append(docs("c_2"))
    assert rows(table.counts()) == [("c", 3)]


def test_sync_embeds_only_what_changed(spark, tmp_path):
    table = VectorTable(spark, str(tmp_path / "vectors"))
    made = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<float>")
    def embed(content):
        made.add(len(content))
        return content.map(lambda t: [float(len(t)), 1.0])

    def chunks(**texts):
        data = [(i, t, {"of": "x"}) for i, t in texts.items()]
        return spark.createDataFrame(data, "doc_id string, content string, metadata map<string,string>")

    def sync(df):
        before = made.value
        changes = {r.change: r.n_chunks for r in table.sync(df, "notes", embed("content")).collect()}
        return changes, made.value - before

    assert sync(chunks(a="one", b="two")) == ({"added": 2}, 2)
    assert sync(chunks(a="one", b="two")) == ({"same": 2}, 0)
    assert sync(chunks(a="one", b="three", c="new")) == ({"same": 1, "changed": 1, "added": 1}, 2)
    assert {(r.doc_id, r.content, tuple(r.embedding)) for r in table.read("notes").collect()} == {
        ("a", "one", (3.0, 1.0)), ("b", "three", (5.0, 1.0)), ("c", "new", (3.0, 1.0)),
    }
    assert sync(chunks(c="new").unionByName(chunks(c="aaa"))) == ({"removed": 2, "same": 1}, 0)
    assert sync(chunks(c="new").limit(0)) == ({"removed": 1}, 0)
    assert rows(table.read("notes")) == [] and sync(chunks(c="new").limit(0)) == ({}, 0)


def test_sync_writes_texts_once(spark, tmp_path, monkeypatch):
    """Tables beside the collection hold ids, not texts; the collection is replaced while it is read."""
    table, beside = VectorTable(spark, str(tmp_path / "v")), []
    keep = vector_table.written
    monkeypatch.setattr(vector_table, "written", lambda df, name: beside.append(df.columns) or keep(df, name))
    embed = F.array(F.length("content").cast("float"))
    states = [{str(i): f"text {i}" for i in range(300)}, {str(i): f"text {i + i % 3 // 2}" for i in range(30, 330)}]
    states += [states[1], {**states[1], "x": "one more"}]
    for state, expected in zip(
        states, ({"added": 300}, {"removed": 30, "added": 30, "changed": 90, "same": 180}, {"same": 300}, {"added": 1, "same": 300}), strict=True
    ):
        some = spark.createDataFrame([(k, v, None) for k, v in state.items()], "doc_id string, content string, metadata map<string,string>")
        assert dict(table.sync(some.repartition(5), "notes", embed).collect()) == expected
        assert {(r.doc_id, r.content) for r in table.read("notes").collect()} == set(state.items())
    assert beside and not any("content" in columns for columns in beside)


# --- inverted file ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def groups(spark):
    """Vectors around forty directions, one of them with a third of all rows, and copies."""
    rng = np.random.default_rng(5)
    centers = rng.standard_normal((40, 12))
    of = np.where(rng.random(1500) < 0.33, 0, rng.integers(0, 40, 1500))
    d = (centers[of] + 0.4 * rng.standard_normal((1500, 12))).astype(np.float32)
    d[200:260] = d[3]
    return d, _vectors(spark, d, "doc_id").repartition(6)


def test_inverted_file_finds_the_wanted_share(spark, groups):
    d, docs = groups
    queries = docs.filter("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    hits = inverted_file.search(queries, docs, 5, list_rows=32)
    exact = retrieval.topk(queries, docs, 5)
    counted = inverted_file.recall(hits, exact).agg(F.sum("n_exact").alias("n"), F.sum("n_found").alias("found")).first()
    assert counted.n == 5 * 75 and counted.found >= 0.9 * counted.n
    assert hits.groupBy("query_id").count().agg(F.max("count")).first()[0] == 5


def test_inverted_file_opened_by_bounds_is_exact(spark, groups):
    d, docs = groups
    queries = docs.filter("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    hits = inverted_file.search(queries, docs, 5, exact=True, target=0.3, list_rows=32)
    expected = {(int(q), doc, rank) for q, doc, rank in _brute(d[::20].astype(float), d.astype(float), 5)}
    assert {(r.query_id // 20, r.doc_id, r.rank) for r in hits.collect()} == expected


def test_inverted_file_compares_few_pairs_at_any_size(spark, groups):
    d, docs = groups
    asked = docs.withColumnRenamed("doc_id", "query_id")
    pairs = []
    for n in (300, 1500):
        some, queries = docs.filter(f"doc_id < {n}"), asked.filter(f"query_id < {n}")
        cells = inverted_file.fit(some, list_rows=32)
        assert len(cells) == -(-n // 32)
        pairs.append(inverted_file.compared(queries, some, cells, 2).first().n_pairs)
    assert pairs[1] < 10 * pairs[0]


class _Kept:
    """Keeps the hits that come to be ranked. Tasks, which are sent the module, get a text in its place."""

    def __init__(self, ranked):
        self.ranked, self.hits = ranked, None

    def __call__(self, hits, k):
        self.hits = hits
        return self.ranked(hits, k)

    def __reduce__(self):
        return str, ()


def test_hits_of_many_probed_cells_are_few(spark, monkeypatch):
    """Without clusters a query probes most cells; it must not bring ``k`` hits of each of them."""
    d = np.random.default_rng(8).standard_normal((1500, 16)).astype(np.float32)
    docs, kept = _vectors(spark, d, "doc_id"), _Kept(retrieval._ranked)
    monkeypatch.setattr(retrieval, "_ranked", kept)
    queries = docs.filter("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    hits = inverted_file.search(queries, docs, 5, list_rows=8)
    assert hits.count() == 75 * 5
    assert kept.hits.count() <= 75 * 5 * 2 * 8


@pytest.mark.parametrize("rows_, cells", [(100, 7), (40, 3), (10**6, 1024)])
def test_shelves_hold_every_cell_with_documents_once(rows_, cells):
    rng = np.random.default_rng(3)
    sizes = rng.integers(0, 30, 50)
    sizes[7] = 500
    shelves = inverted_file._shelves(inverted_file.Cells(rng.standard_normal((50, 4))), sizes, rows_, cells)
    assert sorted(np.concatenate(shelves)) == np.flatnonzero(sizes).tolist()
    assert all(len(x) == 1 or (sizes[x].sum() <= rows_ and len(x) <= cells) for x in shelves)


def test_search_in_blocks_is_exact(spark, groups, monkeypatch):
    """Shelves of a few rows, lists longer than a block, and matrices of a few rows."""
    d, docs = groups
    for name, value in (("LEAST_ROWS", 1), ("PIECES", 20), ("ENTRIES", 100)):
        monkeypatch.setattr(inverted_file, name, value)
    queries = docs.filter("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    hits = inverted_file.search(queries, docs, 5, exact=True, target=0.3, list_rows=200)
    expected = {(int(q), doc, rank) for q, doc, rank in _brute(d[::20].astype(float), d.astype(float), 5)}
    assert {(r.query_id // 20, r.doc_id, r.rank) for r in hits.collect()} == expected


def test_comparing_many_queries_at_once_takes_little_memory():
    rng = np.random.default_rng(4)
    queries, docs = (retrieval._unit_rows(rng.standard_normal((n, 8))) for n in (8192, 1024))
    tracemalloc.start()
    found = retrieval._nearest(np.arange(8192), queries, np.arange(1024), docs, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    near = np.round(1 - queries @ docs.T, 9)
    assert found.distance.tolist() == np.sort(near, axis=1)[:, :2].ravel().tolist()
    assert peak < 64 << 20


def test_inverted_file_edge_cases(spark):
    docs = _vectors(spark, [[1, 0], [0, 0], [-1, 0]], "doc_id").union(spark.createDataFrame([(9, None)], "d bigint, e array<float>"))
    queries = _vectors(spark, [[1, 0], [0, 0]], "query_id")
    for exact in (False, True):
        found = inverted_file.search(queries, docs, 5, exact=exact).select("query_id", "doc_id", "rank")
        assert rows(found) == [(0, 0, 1), (0, 2, 2)]
        assert rows(inverted_file.search(queries, docs.limit(0), 5, exact=exact)) == []
        assert rows(inverted_file.search(queries.limit(0), docs, 5, exact=exact)) == []
    assert rows(inverted_file.search(queries, docs, 0)) == []


@pytest.mark.parametrize("bound", [4096, 1])
def test_unequal_lengths_are_an_error(spark, bound):
    docs = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0, 0.0, 1.0])], "doc_id bigint, embedding array<float>")
    queries = _vectors(spark, np.ones((2, 4)), "query_id")
    for some in (docs, docs.where("doc_id = 1")):
        with pytest.raises(Exception, match="unequal lengths|dimensions"):
            retrieval.topk(queries, some, 1, max_sent_queries=bound).collect()
