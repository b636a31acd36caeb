import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorumlens.llm import resampling
from tests.conftest import rows

KINDS = "doc_id bigint, text string"


def features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(x.encode()) % 10_000 for x in runs]


def brute(documents, target, percent=5, least=20):
    found = [(doc, *features(text)) for doc, text in documents]
    s, t = Counter(b for *_, f in found for b in f), Counter(b for text in target for b in features(text)[1])
    held, wanted = sum(s.values()), sum(t.values())
    out = []
    for doc, n, f in found:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (held + 10_000) / ((s[b] + 1) * (wanted + 10_000)))) for b in f)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    fit = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], math.inf if x[0] is None else x[0]))
    for rank, x in enumerate(fit[: len(fit) * percent // 100], 1):
        x[5] = rank
    return sorted(map(tuple, out), key=lambda r: tuple(str(v) for v in r))


def corpus(n, seed=1):
    rnd = random.Random(seed)
    words = ["Über", "ein", "the", "Cat", "x9", "naïve", "w" * 150, "日本", "a_b", "I'm", "#"]
    sep = [" ", "  ", "\n", "\t", "-", "\x00", "\x85", " "]
    return [(i, "".join(rnd.choice(words) + rnd.choice(sep) for _ in range(rnd.randint(0, 60)))) for i in range(n)]


def test_equals_the_definition(spark):
    documents = [*corpus(400), (400, None), (401, ""), (402, "the Cat " * 5000), (7, corpus(8)[7][1])]
    target = [(0, "the cat über the cat"), (1, None), (2, "naïve x9 ein " * 9)]
    got = resampling.resampled(spark.createDataFrame(documents, KINDS).repartition(3), spark.createDataFrame(target, KINDS))
    assert rows(got.select("doc_id", "n_words", "n_features", "weight", "score", "rank")) == brute(documents, [t for _, t in target])


def test_ties_go_to_the_smaller_id_and_repeated_rows_are_ranked_one_by_one(spark):
    text = "the cat sat " * 10
    documents = [(5, text)] * 60 + [(None, text)] * 40 + [(3, text)] * 3
    got = resampling.resampled(spark.createDataFrame(documents, KINDS), spark.createDataFrame([(0, text)], KINDS), percent=60)
    drawn = [r["doc_id"] for r in got.where("rank IS NOT NULL").orderBy("rank").collect()]
    expected = [x[0] for x in sorted((x for x in brute(documents, [text], 60) if x[5]), key=lambda x: x[5])]
    assert drawn == expected and len(drawn) == 61


def test_other_columns_with_clashing_names_and_empty_tables(spark):
    documents = [(i, "one two three " * 8) for i in range(40)]
    extra = spark.createDataFrame(documents, KINDS).withColumns({"score": F.lit("s"), "row": F.lit(1), "weight": F.lit(2)})
    empty = spark.createDataFrame([], KINDS)
    got = rows(resampling.resampled(extra, empty).select("doc_id", "n_words", "n_features", "weight", "score", "rank"))
    assert got == brute(documents, [])
    assert resampling.resampled(empty, extra).collect() == []


@pytest.mark.parametrize("values", [[5], [3, 3, 3], [-(2**62), 0, 2**62, 2**62], list(range(1000))])
def test_smallest_counts_exactly(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    for k in {1, len(values) // 2 + 1, len(values)}:
        at, below = resampling.smallest(df, F.col("v"), k)
        assert at == sorted(values)[k - 1] and below == sum(v < at for v in values)


def test_shifted_crc_joins_parts():
    rnd = random.Random(3)
    for n in (0, 1, 5, 64, 65, 300):
        a, b = rnd.randbytes(9), rnd.randbytes(n)
        joined = resampling._shifted(np.array([zlib.crc32(a)], np.uint32), np.array([n]))[0] ^ zlib.crc32(b)
        assert joined == zlib.crc32(a + b)
