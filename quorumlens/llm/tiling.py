"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlens.llm.common import Batches, WordHashes, rows_of, shingle_hashes

#: Shortest tile in words, and the length of the seeds.
TILE = 5
#: Share of an item's words, in percent, that tiles must cover.
PERCENT = 60
#: Words of benchmark items that one pass over the documents compares; more items make more passes.
BLOCK_WORDS = 2_000_000

_FOUND = pa.schema(
    [("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_words", pa.int64()), ("covered", pa.int64()), ("tiles", pa.int64())]
)
FOUND = "doc_id bigint, item_id bigint, item_words bigint, covered bigint, tiles bigint"


def _windows(values: np.ndarray, free: np.ndarray, length: int) -> dict[int, list[int]]:
    """Karp-Rabin values of all windows of ``length`` free words, with where they start."""
    n = len(values) - length + 1
    if n <= 0:
        return {}
    hashes = shingle_hashes(values, length)
    taken = np.concatenate([[0], np.cumsum(~free)])
    starts = np.flatnonzero(taken[length:] == taken[:n])
    found: dict[int, list[int]] = {}
    for at, h in zip(starts.tolist(), hashes[starts].tolist(), strict=True):
        found.setdefault(h, []).append(at)
    return found


def _run(item: np.ndarray, text: np.ndarray, free_item: np.ndarray, free_text: np.ndarray, a: int, b: int) -> int:
    """Length of the match that starts at item word a and text word b."""
    most, done = min(len(item) - a, len(text) - b), 0
    while done < most:
        step = min(64, most - done)
        x, y = slice(a + done, a + done + step), slice(b + done, b + done + step)
        same = (item[x] == text[y]) & free_item[x] & free_text[y]
        if not same.all():
            return done + int(same.argmin())
        done += step
    return done


def tiles(item: np.ndarray, text: np.ndarray, shortest: int = TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two arrays of word hashes: (item start, text start, length).

    The search length halves down to ``shortest``. Windows of that length are matched by their Karp-Rabin values and
    confirmed word by word; matches that are far longer raise the length first. Matches are marked from the
    longest to the shortest; what is left of one that another has cut into goes back into the queue.
    """
    free_item, free_text = np.ones(len(item), bool), np.ones(len(text), bool)
    out: list[tuple[int, int, int]] = []
    length = max(shortest, min(len(item), 32))
    while True:
        starts = _windows(text, free_text, length)
        queue: list[tuple[int, int, int]] = []
        for h, places in _windows(item, free_item, length).items():
            for a in places:
                for b in starts.get(h, ()):
                    inside = a and b and item[a - 1] == text[b - 1] and free_item[a - 1] and free_text[b - 1]
                    run = 0 if inside else _run(item, text, free_item, free_text, a, b)
                    if run >= length:
                        queue.append((-run, a, b))
        longest = -min(queue)[0] if queue else 0
        if longest > 2 * length:
            length = longest
            continue
        heapq.heapify(queue)
        while queue:
            run, a, b = heapq.heappop(queue)
            free = free_item[a : a - run] & free_text[b : b - run]
            if free.all():
                free_item[a : a - run] = False
                free_text[b : b - run] = False
                out.append((a, b, -run))
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]])))
            for x, y in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                if y - x >= length:
                    heapq.heappush(queue, (x - y, a + x, b + x))
        if length == shortest:
            return out
        length = max(shortest, length // 2)


def _candidate(item: np.ndarray, text: np.ndarray, at: np.ndarray, percent: int, shortest: int) -> tuple[int, int]:
    """Covered words and tiles of an item in the parts of a text around its seeds."""
    near = np.zeros(len(text), bool)
    for k in range(shortest):
        near[np.minimum(at + k, len(text) - 1)] = True
    # Words outside all seeds cannot be in a tile, so each gap shrinks to one word that matches nothing.
    edge = np.concatenate([near[1:] | near[:-1], [False]]) if len(text) > 1 else near
    keep = near | edge
    parts = np.where(near, text, np.uint64(0))[keep]
    if 100 * min(int(near.sum()), len(item)) < percent * len(item):
        return 0, 0
    found = tiles(item, parts, shortest)
    return sum(t[2] for t in found), len(found)


def _finder(items: list[tuple[int, np.ndarray]], percent: int, shortest: int):
    """Function from a text to (item_id, item words, covered words, tiles) of the items of one block that it holds."""
    arrays = [(i, v) for i, v in items if len(v) >= shortest]
    brief = {v.tobytes(): i for i, v in items if len(v) < shortest}
    seeds = [shingle_hashes(v, shortest) for _, v in arrays]
    flat = np.concatenate([np.empty(0, np.uint64), *seeds])
    owner = np.repeat(np.arange(len(arrays)), np.asarray([len(s) for s in seeds], np.int64))
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    sieve = np.zeros(1 << 24, bool)
    sieve[(flat >> np.uint64(40)).astype(np.int64)] = True
    hashes = WordHashes()

    def find(text: bytes | None) -> Iterator[tuple[int, int, int, int]]:
        words = hashes.array((text or b"").lower().split())
        if len(words) < shortest:
            if words.tobytes() in brief:
                yield brief[words.tobytes()], len(words), len(words), 1
            return
        own = shingle_hashes(words, shortest)
        at = np.flatnonzero(sieve[(own >> np.uint64(40)).astype(np.int64)])
        low = np.searchsorted(flat, own[at], "left")
        high = np.searchsorted(flat, own[at], "right")
        at, low, high = at[high > low], low[high > low], high[high > low]
        places: dict[int, list[int]] = {}
        for p, a, b in zip(at.tolist(), low.tolist(), high.tolist(), strict=True):
            for k in set(owner[a:b].tolist()):
                places.setdefault(k, []).append(p)
        for k in sorted(places):
            item, values = arrays[k]
            covered, n = _candidate(values, words, np.asarray(places[k]), percent, shortest)
            if n and 100 * covered >= percent * len(values):
                yield item, len(values), covered, n

    return find


def _compare(items: list[tuple[int, np.ndarray]], percent: int, shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, out = _finder(items, percent, shortest), Batches(_FOUND)
        for doc, text in rows_of(batches, "doc_id", "text"):
            for found in find(text):
                yield from out.add((doc, *found))
        yield from out.end()

    return run


def _clean(items: list[tuple[int, np.ndarray]], percent: int, shortest: int, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder(items, percent, shortest)
        for batch in batches:
            texts = batch.column(column)
            kept = [next(find(texts[i].as_py()), None) is None for i in range(batch.num_rows)]
            yield batch.drop_columns([column]).filter(pa.array(kept, pa.bool_()))

    return run


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Items in blocks of bounded words, each distinct word sequence once under its least item_id."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("item_id", pa.int64()), ("key", pa.binary()), ("words", pa.list_(pa.int64()))])
        hashes, out = WordHashes(), Batches(schema)
        for item, text in rows_of(batches, "item_id", "text"):
            words = hashes.array((text or b"").lower().split())
            if len(words) and item is not None:
                yield from out.add((item, xxhash.xxh3_128_digest(words.tobytes()), words.view(np.int64).tolist()))
        yield from out.end()

    source = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("binary").alias("text"))
    items = source.mapInArrow(hashed, "item_id bigint, key binary, words array<bigint>")
    items = items.groupBy("key").agg(F.min("item_id").alias("item_id"), F.first("words").alias("words"))
    block: list[tuple[int, np.ndarray]] = []
    held = 0
    # Items come to the driver one partition at a time and leave it with their block.
    for row in items.select("item_id", "words").orderBy("item_id").toLocalIterator():
        block.append((row.item_id, np.asarray(row.words, np.int64).view(np.uint64)))
        held += len(row.words)
        if held >= block_words:
            yield block
            block, held = [], 0
    if block:
        yield block


def contaminated(
    docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, shortest: int = TILE, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """Pairs of a document and a benchmark item whose words its tiles cover: doc_id, item_id, item_words, covered, tiles.

    ``docs`` has doc_id BIGINT and text, ``benchmark`` item_id BIGINT and text. Words are lower-cased (A-Z).
    Each pass compares all documents with a block of items, inside the tasks and without a shuffle: a document
    that shares a seed of ``shortest`` words with an item is tiled with it, and the pair is returned when
    non-overlapping matches of that length or more cover ``percent`` of the item's words, in whatever order
    they stand. An item shorter than a seed matches only documents that consist of it.
    Items of equal words are one, under the least item_id; items without words or id match nothing. A
    document without words gives no row, one without a doc_id gives rows with null, a repeated row gives repeated rows.
    """
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    spark = docs.sparkSession
    found = spark.createDataFrame([], FOUND)
    for block in _blocks(benchmark, block_words):
        found = found.unionByName(source.mapInArrow(_compare(block, percent, shortest), FOUND))
    return found


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, shortest: int = TILE, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, as they are; one pass over them for each block, no shuffle.

    Other columns may have any names. A null or empty text holds no item, repeated rows go or stay together, and
    an empty table or benchmark changes nothing.
    """
    taken = {c.lower() for c in docs.columns}
    fresh = next(n for n in (f"text_{i}" for i in range(len(taken) + 1)) if n not in taken)
    for block in _blocks(benchmark, block_words):
        texts = docs.select(*docs.columns, F.col("text").cast("binary").alias(fresh))
        docs = texts.mapInArrow(_clean(block, percent, shortest, fresh), docs.schema)
    return docs
