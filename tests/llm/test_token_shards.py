import random
import zlib

import numpy as np
import pytest
import tiktoken

from quorumlens.llm import token_shards as ts
from quorumlens.session import scratch_path


def test_permutation():
    for n in (1, 2, 3, 7, 64, 1000, 4097):
        found = ts.permuted(np.arange(n), n, 5)
        assert sorted(found) == list(range(n))
        assert list(ts.permuted(np.arange(n)[::-1], n, 5)[::-1]) == list(found)
    assert list(ts.permuted(np.arange(1000), 1000, 5)) != list(ts.permuted(np.arange(1000), 1000, 6))


TEXTS = [
    "", " ", "a", "It's  two  spaces", " lead", "trail ", "a \n b\n\nc\td", "über straße naïve 123 4567 !? a.b", "x y  z",
    "one two three " * 200, "word\n" * 50, "\U0001f600 emoji\r\n",
]


def test_encoder():
    ranks = ts.read_ranks(ts.TOKENIZER)
    encoder = ts.Encoder(ranks)
    plain = tiktoken.Encoding("t", pat_str=ts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(1)
    texts = TEXTS + ["\0 a \0 b .\0 ,\0 word. \0", "x .", "a , b", "é. ü, a.b, 'tis, don't. \n", "ab. ab ab, ab.\nab,\nab"]
    texts += ["".join(rnd.choice("ab c.\n\t'é1") for _ in range(60)) for _ in range(300)]
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u2").tolist() == plain.encode_ordinary(text), repr(text)


@pytest.mark.parametrize("length,per_shard", [(8, 16), (64, 1000)])
def test_round_trip(spark, tmp_path, length, per_shard):
    rows = [(i, t, 0) for i, t in enumerate(TEXTS)] + [(None, "none", 0), (50, None, 0), (3, TEXTS[3], 0)]
    table = scratch_path(spark, "shard-input")
    spark.createDataFrame(rows, "doc_id bigint, text string, slot int").repartition(3).write.parquet(table)
    docs = spark.read.parquet(table)
    path = scratch_path(spark, "shards-test")
    size = ts.write_shards(docs, path, length=length, per_shard=per_shard)
    found = ts.read_shards(spark, path, size, length, per_shard).orderBy("slot").collect()
    assert [r.slot for r in found] == list(range(size))
    assert all(r.byte_offset == r.slot % per_shard * ts.stride(length) for r in found)
    encoder = ts.Encoder(ts.read_ranks(ts.TOKENIZER))
    expected = []
    for doc, text, _ in rows:
        ids = [*np.frombuffer(encoder.encode(text or ""), "<u2").tolist(), ts.END]
        expected += [(doc, k // length, ids[k : k + length]) for k in range(0, len(ids), length)]
    assert sorted(map(str, expected)) == sorted(str((r.doc_id, r.sequence, list(r.tokens))) for r in found)
    assert all(r.checksum == zlib.crc32(np.asarray(r.tokens, "<u2").tobytes()) and r.n_tokens == len(r.tokens) for r in found)
    plain = ts.read_shards(spark, path, size, length, per_shard, tokens=False).orderBy("slot").collect()
    assert [tuple(r) for r in plain] == [tuple(r)[:-1] for r in found]
    # The place of a sequence is the permutation of its running number: all numbers of a document's sequences differ by one.
    number = {int(slot): i for i, slot in enumerate(ts.permuted(np.arange(size), size, ts.KEY))}
    order = sorted(found, key=lambda r: number[r.slot])
    assert all(b.sequence == 0 or (b.doc_id, b.sequence) == (a.doc_id, a.sequence + 1) for a, b in zip(order, order[1:]))
    later = ts.read_shards(spark, path, size, length, per_shard, start=size // 2).collect()
    assert sorted(r.slot for r in later) == list(range(size // 2, size))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    path = scratch_path(spark, "shards-test")
    assert ts.read_shards(spark, path, ts.write_shards(docs, path)).count() == 0
