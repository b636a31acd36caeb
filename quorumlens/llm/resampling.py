"""Importance resampling: documents that look like a target set are drawn, by hashed phrase counts and seeded noise.

Gains of hashed one- to three-word features come from counts over all documents and all target texts. The
draw is exact: scored rows are written once, jobs that count rows in ever narrower ranges find the last score
drawn (and, among equal scores, the last doc_id), and only drawn rows are sorted, in ranges, for their ranks.

Building the result runs jobs: two scans of the texts, and about five counts of narrow rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlens.llm.common import rows_of
from quorumlens.session import written

BUCKETS = 10_000
#: Documents with fewer words are scored, not drawn.
LEAST_WORDS = 20
PERCENT = 5
SEED = 42

#: Ranges that one counting job tells apart.
_FAN = 64
#: Words that a task holds at once; a longer document is held alone.
_BLOCK = 300_000
_LONGEST_STEP = 64

_KEPT = bytes(range(48, 58)) + bytes(range(97, 123)) + bytes(range(128, 256))
#: A-Z become a-z, all other ASCII but digits and a-z becomes a space.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b in _KEPT else 32 for b in range(256))


def _shift_tables() -> np.ndarray:
    """[byte position, number of bytes, byte]: what a byte of a CRC becomes when so many zero bytes follow."""
    byte = np.arange(256, dtype=np.uint32)
    step = byte.copy()
    for _ in range(8):
        step = (step >> np.uint32(1)) ^ np.where(step & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    tables = np.empty((4, _LONGEST_STEP + 1, 256), np.uint32)
    for place in range(4):
        value = byte << np.uint32(8 * place)
        for n in range(_LONGEST_STEP + 1):
            tables[place, n] = value
            value = (value >> np.uint32(8)) ^ step[value & np.uint32(255)]
    return tables


_SHIFT = _shift_tables().reshape(4, -1)


def _shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC registers after ``length`` zero bytes: crc(a + b) = shifted(crc(a), len(b)) ^ crc(b)."""
    crc, length = crc.copy(), length.astype(np.int64)
    open_ = np.arange(len(crc))
    while len(open_):
        value, step = crc[open_], np.minimum(length[open_], _LONGEST_STEP)
        out = np.zeros(len(open_), np.uint32)
        for place in range(4):
            out ^= _SHIFT[place][step * 256 + ((value >> np.uint32(8 * place)) & np.uint32(255))]
        crc[open_] = out
        length[open_] -= step
        open_ = open_[length[open_] > 0]
    return crc


class _Vocabulary(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def _features(words: list[bytes], document: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, bucket) of every feature of one, two and three words; ``document`` numbers each word's document."""
    known = _Vocabulary()
    at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    alone = np.fromiter(map(zlib.crc32, known), np.uint32, len(known))[at]
    after = np.fromiter((zlib.crc32(b" " + w) for w in known), np.uint32, len(known))[at]
    length = np.fromiter(map(len, known), np.int64, len(known))[at] + 1
    crc = alone
    for width in (1, 2, 3):
        if width > 1:
            crc = _shifted(crc[:-1], length[width - 1 :]) ^ after[width - 1 :]
        whole = document[: len(crc)] == document[width - 1 :]
        yield document[: len(crc)][whole], crc[whole] % np.uint32(buckets)


def _blocks(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[list[tuple], list[bytes], np.ndarray]]:
    """Rows (without their text, the last column), their words, and the number of each word's row."""
    rows: list[tuple] = []
    words: list[bytes] = []
    counts: list[int] = []
    for *keys, text in rows_of(batches, *names):
        found = text.translate(_PLAIN).split() if text else []
        rows.append((*keys, len(found)))
        counts.append(len(found))
        words += found
        if len(words) >= _BLOCK or len(rows) >= _BLOCK:
            yield rows, words, np.repeat(np.arange(len(rows)), counts)
            rows, words, counts = [], [], []
    if rows:
        yield rows, words, np.repeat(np.arange(len(rows)), counts)


_COUNTS = pa.schema([("bucket", pa.int64()), ("n", pa.int64())])


def _counting(buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, words, document in _blocks(batches, "text"):
            for _, bucket in _features(words, document, buckets) if words else ():
                total += np.bincount(bucket, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], schema=_COUNTS)

    return run


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all rows of ``text``; ``buckets`` numbers reach the driver."""
    each = texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(_counting(buckets), "bucket bigint, n bigint")
    total = np.zeros(buckets, np.int64)
    for row in each.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[row["bucket"]] = row["n"]
    return total


def gains(source: np.ndarray, target: np.ndarray) -> list[int]:
    """floor(1000 ln) of how much more likely a bucket is in the target, both smoothed by one."""
    n, held, wanted = len(source), float(source.sum()), float(target.sum())
    return [
        math.floor(1000 * math.log((t + 1.0) * (held + n) / ((s + 1.0) * (wanted + n))))
        for s, t in zip(source.tolist(), target.tolist(), strict=True)
    ]


_WEIGHTS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])


def _weighing(gain: list[int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = np.array(gain, np.int64)
        for rows, words, document in _blocks(batches, "doc_id", "text"):
            count, weight = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
            for of, bucket in _features(words, document, len(value)) if words else ():
                count += np.bincount(of, minlength=len(rows))
                # Sums stay below 2**53, so they are exact as doubles.
                weight += np.bincount(of, weights=value[bucket], minlength=len(rows)).astype(np.int64)
            doc, n = zip(*rows, strict=True)
            columns = [pa.array(c, pa.int64()) for c in (doc, n, count, weight)]
            yield pa.RecordBatch.from_arrays(columns, schema=_WEIGHTS)

    return run


def noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 x Gumbel noise) seeded by the doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000.0 * F.ln(-F.ln(uniform))).cast("bigint")


def scores(documents: DataFrame, gain: list[int], seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each row."""
    texts = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary").alias("text"))
    kinds = "doc_id bigint, n_words bigint, n_features bigint, weight bigint"
    weighed = texts.mapInArrow(_weighing(gain), kinds)
    return weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def smallest(df: DataFrame, value: Column, k: int) -> tuple[int, int]:
    """The ``k``-th smallest integer of a column, and how many rows lie below it, by counts over narrowing ranges.

    ``k`` counts from 1 and is at most the number of rows.
    """
    exact = df.select(value.cast("decimal(38,0)").alias("v"))
    low, high = (int(x) for x in exact.agg(F.min("v"), F.max("v")).first())
    below = 0
    while low < high:
        step = -(-(high - low + 1) // _FAN)
        inside = exact.where(F.col("v").between(F.lit(low).cast("decimal(38,0)"), F.lit(high).cast("decimal(38,0)")))
        part = F.expr(f"(v - CAST('{low}' AS DECIMAL(38,0))) div CAST('{step}' AS DECIMAL(38,0))")
        for row in sorted(inside.groupBy(part.alias("part")).count().collect()):
            if below + row["count"] >= k:
                low += row["part"] * step
                high = min(high, low + step - 1)
                break
            below += row["count"]
    return low, below


def _drawn(rows: DataFrame, k: int, order: list[Column]) -> Column:
    """Condition that holds for the first ``k`` rows by integer columns; equal values are settled by the next column."""
    at, below = smallest(rows, order[0], k)
    edge = F.lit(at).cast("bigint")
    if len(order) == 1:
        return order[0] <= edge
    tied = rows.where(order[0] == edge)
    if tied.count() == k - below:
        return order[0] <= edge
    return (order[0] < edge) | (order[0] == edge) & _drawn(tied, k - below, order[1:])


def resampled(
    documents: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of each row of ``documents``; rank is null for rows not drawn.

    Of the rows with ``least_words`` words or more, ``percent`` of a hundred (rounded down) with the highest scores
    are drawn; equal scores go to the smaller doc_id, a null doc_id last. Repeated rows count and are ranked one by
    one. A null or empty text has no features and weight 0. Without target texts, or without documents, all gains
    come from the smoothing alone. Other columns are ignored; ``doc_id`` is an integer.
    """
    gain = gains(bucket_counts(documents, buckets), bucket_counts(target, buckets))
    row = F.monotonically_increasing_id()
    scored = written(scores(documents, gain, seed).withColumn("row", row), "resampling-scores")
    order = [-F.col("score"), F.coalesce("doc_id", F.lit((1 << 63) - 1)), F.col("row")]
    long_enough = F.col("n_words") >= least_words
    fitting = scored.where(long_enough)
    k = fitting.count() * percent // 100
    names = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    unranked = scored.withColumn("rank", F.lit(None).cast("bigint"))
    if not k:
        return unranked.select(*names)
    drawn = long_enough & _drawn(fitting, k, order)
    ranked = scored.where(drawn).repartitionByRange(*order).sortWithinPartitions(*order)
    ranked = written(ranked.withColumn("at", F.monotonically_increasing_id()), "resampling-drawn")
    # Ranges are numbered in order in the upper bits of "at", rows of a range in the lower 33.
    piece, within = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    before, offsets = 0, []
    for found in sorted(ranked.groupBy(piece.alias("piece")).count().collect()):
        offsets.append((found["piece"], before))
        before += found["count"]
    offset = documents.sparkSession.createDataFrame(offsets, "piece bigint, before bigint")
    placed = ranked.withColumn("piece", piece).join(offset, "piece").withColumn("rank", F.col("before") + within + 1)
    return unranked.where(~drawn).select(*names).unionByName(placed.select(*names))
