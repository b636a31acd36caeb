"""Each stage against a brute-force version of its decision, on a small folder."""

import random
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from quorumlens.llm import mixing, outliers, token_shards
from quorumlens.session import scratch_path
from tests.llm.test_minhash import brute as brute_groups
from tests.llm.test_tiling import brute as brute_items

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def made(spark):
    rnd = random.Random(12)
    words = ["".join(rnd.choice("etaoinshrd") for _ in range(rnd.randint(2, 8))) for _ in range(3000)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(i, prose(30)) for i in range(6)]
    rows = []
    for i in range(260):
        text = prose(rnd.randint(60, 300))
        if i % 13 == 0:
            text = " ".join(w + "$$$" for w in text.split())
        if i % 17 == 5:
            text = rows[i - 1][1] + " tail"
        if i % 29 == 7:
            text += " " + items[i % 6][1]
        rows.append((i, text, "en" if i % 4 else "fr", "s%d" % (i % 3) if i % 11 else None, len(text)))
    rows += [(300, None, None, None, None), (301, "", "en", "s0", 0), rows[3], (None, prose(80), "en", "s1", 1)]
    rows.append(rows[-1])
    folder = scratch_path(spark, "pipeline-test")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def test_stages(spark, made):
    folder, rows, items = made
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [r for r in rows if r[1] and "$$$" not in r[1]]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        path = scratch_path(spark, "stage")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if n < 4:
            assert docs.columns == COLUMNS, name
            found = [tuple(r) for r in docs.collect()]
        if n == 0:
            expected = kept
        elif n == 1:
            groups = brute_groups([r[:2] for r in expected], 5)
            first = {r[0]: r for r, g in zip(expected, groups) if r[0] is not None and r[0] == g[2]}
            expected = list(first.values()) + list({r for r in expected if r[0] is None})
        elif n == 2:
            bad = {r[0] for r in brute_items([r[:2] for r in expected], items, 60, 5)}
            assert len(bad) > 3
            expected = [r for r in expected if r[0] not in bad]
        elif n == 3:
            size = Counter()
            for r in expected:
                size[r[3]] += len(r[1].split())
            quota, taken = mixing.quotas(list(size.items())), Counter()
            for r in found:
                taken[r[3]] += len(r[1].split())
            assert set(found) <= set(expected) and max(Counter(found).values()) <= 2
            assert all(abs(taken[s] - quota[s]) <= 150 for s in size)
            expected = found
        else:
            encoder, ids = token_shards.Encoder(token_shards.read_ranks(token_shards.TOKENIZER)), []
            for r in expected:
                ids.append(len(np.frombuffer(encoder.encode(r[1]), "<u2")) + 1)
            got = docs.orderBy("slot").collect()
            assert [r.slot for r in got] == list(range(sum(-(-n // token_shards.LENGTH) for n in ids)))
            assert sum(r.n_tokens for r in got) == sum(ids)
            continue
        assert sorted(map(str, found)) == sorted(map(str, expected)), name


def test_empty_table(spark, made):
    folder = scratch_path(spark, "pipeline-empty")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


CLASHES = (
    "key copies _copy members size row place hash _hash _rank _text text_0 _lang _source _doc det m1 l11 z1 group distance kept base_failed "
    "n_words node n list band component component_id digest signature ticket gap shard slot"
).split()


def test_stages_keep_columns_of_any_name(spark, made):
    folder, rows, _ = made
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    own = docs.withColumns({c: F.concat(F.lit(c + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in CLASHES})
    for name, stage in corpus_pipeline.STAGES[:4]:
        found = stage(spark, own, folder)
        assert found.columns == own.columns, name
        plain = sorted(map(str, stage(spark, docs, folder).collect()))
        assert sorted(map(str, found.select(*COLUMNS).collect())) == plain, name
        wrong = [f"coalesce({c}, '') <> '{c}:' || coalesce(CAST(doc_id AS STRING), 'none')" for c in CLASHES]
        assert found.where(" OR ".join(wrong)).count() == 0, name


def test_statistics_beside_columns_of_the_same_names(spark, made):
    docs = spark.read.parquet(f"{made[0]}/documents.parquet")
    own = docs.withColumns({c: F.lit(7) for c in CLASHES})
    plain, found = outliers.judged(docs), outliers.judged(own)
    assert sorted(map(str, found.select(plain.columns).collect())) == sorted(map(str, plain.collect()))
    assert found.select("_lang", "det", "l11").distinct().collect() == [(7, 7, 7)]


def test_repeated_rows_and_documents_without_text(spark, made):
    folder, rows, _ = made
    odd = [(1, None, "en", "s0", 0), (2, "", "en", "s0", 0), (None, None, None, None, None)]
    docs = spark.createDataFrame(odd * 3 + [rows[3]] * 4 + [rows[4]] * 2, SCHEMA)
    counts = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        counts[name] = Counter(r["doc_id"] for r in stage(spark, docs, folder).collect())
    assert counts["quality_rules"] == {rows[3][0]: 4, rows[4][0]: 2}
    assert counts["near_dedup"] == {1: 1, 2: 1, None: 1, rows[3][0]: 1, rows[4][0]: 1}
    assert counts["decontaminate"] == {1: 3, 2: 3, None: 3, rows[3][0]: 4, rows[4][0]: 2}
    again = Counter(r["doc_id"] for r in corpus_pipeline.source_mix(spark, docs.repartition(7), folder).collect())
    assert counts["source_mix"] == again and set(again) <= {1, 2, None, rows[3][0], rows[4][0]}
