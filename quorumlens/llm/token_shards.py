"""Training order: token sequences at keyed random slots of binary shards with a fixed stride."""

from __future__ import annotations

import base64
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlens.llm.common import mixed, rows_of

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern that belongs to the vocabulary (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50256
LENGTH = 256
#: Sequences of a shard.
PER_SHARD = 8_192
KEY = 0x5EED_0F_0DE5
ROUNDS = 6
_HEAD = "<qii"  # doc_id, number of the sequence in its document, tokens
_NO_ID = -(1 << 63)


class Encoder:
    """Token ids of whole texts as little-endian 16-bit bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def count(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode(text), "<u2")

    def encode(self, text: str) -> bytes:
        ids = self.encoding.encode_ordinary(text)
        return struct.pack(f"<{len(ids)}H", *ids)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def permuted(index: np.ndarray, size: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """Keyed bijection of 0 .. size - 1: a balanced Feistel network, walked until the value is in range."""
    half = np.uint64(max(1, ((size - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = mixed(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))
    out = np.asarray(index, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (mixed(mixed(right + k) ^ k) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= np.uint64(size)]
    return out.astype(np.int64)


def _sequences(ids: bytes, length: int) -> int:
    return -(-(len(ids) // 2) // length)


def _counting(ranks: dict[bytes, int], length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, n = Encoder(ranks), 0
        for (text,) in rows_of(batches, "text"):
            n += -(-(encoder.count(text or "") + 1) // length)
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n": pa.array([n], pa.int64())})

    return run


def _placing(ranks: dict[bytes, int], length: int, first: dict[int, tuple[int, int]], size: int, key: int):
    end = struct.pack("<H", END)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks)
        part = TaskContext.get().partitionId()
        at, own = first.get(part, (0, 0))
        stop = at + own
        schema = pa.schema([("slot", pa.int64()), ("record", pa.binary())])
        records: list[bytes] = []

        def placed() -> pa.RecordBatch:
            slots = permuted(np.arange(at - len(records), at), size, key)
            return pa.RecordBatch.from_arrays([pa.array(slots), pa.array(records, pa.binary())], schema=schema)

        for doc, text in rows_of(batches, "doc_id", "text"):
            ids = encoder.encode(text or "") + end
            for k in range(_sequences(ids, length)):
                tokens = ids[2 * length * k : 2 * length * (k + 1)]
                head = struct.pack(_HEAD, _NO_ID if doc is None else doc, k, len(tokens) // 2)
                records.append(head + tokens + end * (length - len(tokens) // 2))
                at += 1
                if len(records) == 4000:
                    yield placed()
                    records = []
        if at != stop:
            raise ValueError(f"partition {part} has changed since its sequences were counted")
        if records:
            yield placed()

    return run


def write_shards(
    docs: DataFrame,
    path: str,
    tokenizer: str = TOKENIZER,
    length: int = LENGTH,
    per_shard: int = PER_SHARD,
    key: int = KEY,
) -> int:
    """Write the token sequences of ``docs`` (doc_id BIGINT, text STRING) and return their number.

    Each text, followed by the end token, is cut into sequences of ``length`` tokens, the last one filled with
    end tokens. A first pass counts the sequences of every partition, a second one numbers them and sends each
    to the slot of the keyed permutation. ``docs`` must give the same partitions twice, as a table read
    from files does; a partition with other counts fails. Shard s holds the slots from s * per_shard on, in
    order, as one file that one task writes: a header, the tokens and one closing byte make the stride. Null and empty texts are a
    single end token, rows without doc_id keep a mark of their own, and repeated rows are written repeatedly.
    """
    ranks = read_ranks(tokenizer)
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    counts = source.select("text").mapInArrow(_counting(ranks, length), "part int, n bigint").collect()
    first, size = {}, 0
    for r in sorted(counts, key=lambda r: r.part):
        first[r.part] = (size, r.n)
        size += r.n
    if not size:
        return 0
    shards = -(-size // per_shard)
    placed = source.mapInArrow(_placing(ranks, length, first, size, key), "slot bigint, record binary")
    (
        placed.withColumn("shard", F.expr(f"CAST(slot DIV {per_shard} AS INT)"))
        .repartitionById(shards, F.col("shard"))
        .sortWithinPartitions("shard", "slot")
        .select("shard", F.col("record").cast("string").alias("record"))
        .write.option("lineSep", "\n")
        .partitionBy("shard")
        .text(path)
    )
    return size


NUMBERS = ("slot", "shard", "byte_offset", "doc_id", "sequence", "n_tokens", "checksum")
READ = ", ".join(f"{n} bigint" for n in NUMBERS)
#: Sequences of an Arrow batch of the reader.
READ_ROWS = 2_000


def stride(length: int = LENGTH) -> int:
    return struct.calcsize(_HEAD) + 2 * length + 1


def _reading(length: int, per_shard: int, start: int, tokens: bool):
    record = np.dtype([("doc", "<i8"), ("k", "<i4"), ("n", "<i4"), ("ids", "<u2", (length,)), ("end", "u1")])
    head = struct.calcsize(_HEAD)

    def sequences(shard: int, content: memoryview) -> Iterator[pa.RecordBatch]:
        if len(content) % record.itemsize:
            raise ValueError(f"shard {shard} has {len(content)} bytes, no multiple of {record.itemsize}")
        rows = np.frombuffer(content, record)
        for first in range(max(0, start - shard * per_shard), len(rows), READ_ROWS):
            part = rows[first : first + READ_ROWS]
            places = np.arange(first, first + len(part))
            offsets = places * record.itemsize
            n = part["n"].astype(np.int64)
            begins = offsets + head
            sums = [zlib.crc32(content[a:b]) for a, b in zip(begins.tolist(), (begins + 2 * n).tolist(), strict=True)]
            columns = [
                pa.array(shard * per_shard + places),
                pa.array(np.full(len(part), shard, np.int64)),
                pa.array(offsets),
                pa.array(part["doc"].astype(np.int64), mask=part["doc"] == _NO_ID),
                pa.array(part["k"].astype(np.int64)),
                pa.array(n),
                pa.array(sums, pa.int64()),
            ]
            names = list(NUMBERS)
            if tokens:
                ids = part["ids"][np.arange(length) < n[:, None]].astype(np.int32)
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)))
                names.append("tokens")
            yield pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from sequences(batch.column("shard")[i].as_py(), memoryview(batch.column("content")[i].as_buffer()))

    return run


def read_shards(
    spark: SparkSession,
    path: str,
    size: int,
    length: int = LENGTH,
    per_shard: int = PER_SHARD,
    start: int = 0,
    tokens: bool = True,
) -> DataFrame:
    """Sequences of the shards from slot ``start`` on: slot, shard, byte_offset, doc_id, sequence, n_tokens, checksum, tokens.

    ``size`` is the number that was written. Shards before the start are not opened; a slot's place is its
    number in the shard times the stride. The checksum is the CRC-32 of a sequence's tokens; without ``tokens`` they
    are read and summed up, but not returned.
    """
    schema = f"{READ}, tokens array<int>" if tokens else READ
    if not size:
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").load(path)
    files = files.where(F.col("shard") >= start // per_shard).select("shard", "content")
    return files.mapInArrow(_reading(length, per_shard, start, tokens), schema)
