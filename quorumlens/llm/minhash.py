"""Near-duplicate documents by an inverted join over the coordinates of MinHash signatures."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlens.llm.common import Batches, WordHashes, mixed, rows_of, shingle_hashes
from quorumlens.session import discard, written

COORDINATES = 108
#: A linked pair shares no list with this probability at most.
MISS = 1e-6
#: Columns of 64 bits that hold the parities of a set.
PARITIES = 8
#: Rounds that compare documents with pivots of their lists before the rest is compared pair by pair.
STAR_ROUNDS = 2
#: Pivots of a list in each round.
PIVOTS = 2


def match_threshold(coordinates: int, similarity: float, miss: float = MISS) -> int:
    """Most matches that a pair of this similarity has with probability 1 - ``miss``."""
    total = 0.0
    for k in range(coordinates + 1):
        total += math.comb(coordinates, k) * similarity**k * (1 - similarity) ** (coordinates - k)
        if total > miss:
            return k
    return coordinates


def coordinates_of_list(coordinates: int, similarity: float, miss: float = MISS) -> int:
    """Most coordinates that may make a list together: a linked pair shares one list at least with probability 1 - ``miss``."""
    for size in range(coordinates, 0, -1):
        if match_threshold(coordinates // size, similarity**size, miss):
            return size
    raise ValueError(f"{coordinates} coordinates are too few for similarity {similarity}")


def _sets(width: int):
    """Function from a text (bytes or None) to its sorted distinct shingle hashes."""
    hashes = WordHashes()

    def of(text: bytes | None) -> np.ndarray:
        return np.unique(shingle_hashes(hashes.array((text or b"").lower().split()), width))

    return of


def _factors(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_250_131)
    values = rng.integers(1, 1 << 63, (2, coordinates), dtype=np.uint64)
    return values[0] | np.uint64(1), values[1]


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Least scrambled value of each coordinate, 32 bits."""
    odd, mask = _factors(coordinates)
    found = np.full(coordinates, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 256):  # a part that stays in the cache
        part = shingles[at : at + 256] ^ mask[:, None]
        part *= odd[:, None]
        np.minimum(found, part.min(axis=1), out=found)
    return (found >> np.uint64(32)).astype(np.uint32)


def lists(values: np.ndarray, size: int) -> np.ndarray:
    """A number for each ``size`` coordinates, made of their place and their values."""
    values = values[: len(values) - len(values) % size].reshape(-1, size)
    out = mixed(np.arange(1, len(values) + 1, dtype=np.uint64))
    for column in values.T:
        out = mixed((out ^ column) * np.uint64(0x9E3779B97F4A7C15))
    return out.view(np.int64)


def parities(shingles: np.ndarray) -> np.ndarray:
    """Whether the number of shingles in each of 64 * PARITIES bins is odd, as bits. Two sets differ in as many shingles as bits at least."""
    odd = np.bincount((shingles >> np.uint64(32)).astype(np.int64) % (64 * PARITIES), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


_ODD = [f"odd{i}" for i in range(PARITIES)]
_SKETCH = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("lists", pa.binary()), *[(c, pa.int64()) for c in _ODD]]
)


def _sketches(width: int, coordinates: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, out = _sets(width), Batches(_SKETCH)
        for doc, text in rows_of(batches, "doc_id", "text"):
            own = of(text)
            row = (doc, len(own), None, None, *[None] * PARITIES)
            if len(own):
                named = lists(signature(own, coordinates), size).tobytes()
                row = (doc, len(own), xxhash.xxh3_128_digest(own.tobytes()), named, *parities(own).tolist())
            yield from out.add(row)
        yield from out.end()

    return run


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(list, node): a list, and the set that has it."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            values = np.frombuffer(b"".join(part.column("lists").to_pylist()), np.int64)
            nodes = np.repeat(part.column("node").to_numpy(zero_copy_only=False), len(values) // part.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(nodes)], names=["list", "node"])


def _confirming(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _sets(width)
        out = Batches(pa.schema([("a", pa.int64()), ("b", pa.int64())]))
        last, left = None, None
        for a, b, ta, tb in rows_of(batches, "a", "b", "ta", "tb"):
            if last is None or ta != last:
                last, left = ta, of(ta)
            right = of(tb)
            both = len(np.intersect1d(left, right, assume_unique=True))
            if 100 * both >= percent * (len(left) + len(right) - both):
                yield from out.add((a, b))
        yield from out.end()

    return run


def _texts(width: int):
    """Keeps the rows whose set is the one that stands for its class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _sets(width)
        out = Batches(pa.schema([("node", pa.int64()), ("text", pa.binary())]))
        for node, text, digest in rows_of(batches, "node", "text", "digest"):
            if xxhash.xxh3_128_digest(of(text).tobytes()) == digest:
                yield from out.add((node, text), len(text))
        yield from out.end()

    return run


def components(nodes: DataFrame, links: DataFrame, name: str = "component") -> DataFrame:
    """(node, component): the least node that each node reaches over ``links`` (a, b).

    Rounds take the least label of all neighbours and then jump to the label's own label; they end when no
    label moves. Labels are written to the shared folder each round, and only their count comes to the driver.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = nodes.select("node", F.col("node").alias(name))
    moved = 1
    while moved:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min(name).alias("near"))
        nearer = labels.join(near, labels.node == near.a, "left").select(
            "node", F.col(name).alias("old"), F.least(name, F.coalesce("near", name)).alias("new")
        )
        nearer = written(nearer, "labels")
        jump = nearer.select(F.col("node").alias("new"), F.col("new").alias("far"))
        labels = written(nearer.join(jump, "new", "left").select("node", F.least("new", F.coalesce("far", "new")).alias(name), "old"), "labels")
        moved = labels.where(F.col(name) != F.col("old")).limit(1).count()
        labels = labels.drop("old")
    return labels


def _hooked(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after each label with a link (a, b) has moved two steps along the links, from b's label to a's.

    Nodes of one label stay connected, but not all connected nodes get one label; that is left to the end.
    """
    left, right = (labels.select(F.col("node").alias(x), F.col("component").alias("c" + x)) for x in "ab")
    step = links.join(left, "a").join(right, "b").groupBy(F.col("cb").alias("component")).agg(F.min("ca").alias("one"))
    step = written(step, "hooks")
    again = step.select(F.col("component").alias("one"), F.col("one").alias("two"))
    both = step.join(again, "one", "left")
    # Two labels that point at each other meet in the smaller one.
    target = F.when(F.col("two") == F.col("component"), F.least("component", "one")).otherwise(F.coalesce("two", "one"))
    moved = labels.join(both.select("component", target.alias("to")), "component", "left")
    return written(moved.select("node", F.coalesce("to", "component").alias("component")), "labels")


def _apart() -> Column:
    """Shingles in which the sets of the columns ``na``, ``xa`` and ``nb``, ``xb`` differ at least."""
    odd = [F.bit_count(F.col("xa")[c].bitwiseXOR(F.col("xb")[c])) for c in _ODD]
    return F.greatest(reduce(Column.__add__, odd), F.abs(F.col("na") - F.col("nb"))).cast("bigint")


class _Join:
    """Comparison of candidate pairs of one table."""

    def __init__(self, sets: DataFrame, texts: DataFrame, width: int, percent: int):
        self.sets, self.texts, self.width, self.percent = sets, texts, width, percent

    def side(self, x: str) -> DataFrame:
        """Sets as the first or second of a pair: ``x``, n and parities."""
        return self.sets.select(F.col("node").alias(x), F.col("n").alias("n" + x), F.struct(*_ODD).alias("x" + x))

    def fits(self) -> Column:
        """Whether a pair may be similar enough. At this similarity two sets differ in so many shingles at most, so none is lost."""
        return _apart() * (100 + self.percent) <= (F.col("na") + F.col("nb")) * (100 - self.percent)

    def fitting(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that may be similar enough."""
        both = pairs.select("a", "b").join(self.side("a"), "a").join(self.side("b"), "b")
        return both.where(self.fits()).select("a", "b")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose full sets are similar enough."""
        left = self.texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
        right = self.texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
        both = pairs.select("a", "b").join(right, "b").join(left, "a")
        return both.select("a", "b", "ta", "tb").mapInArrow(_confirming(self.width, self.percent), "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame,
    width: int = 5,
    percent: int = 80,
    coordinates: int = COORDINATES,
    star_rounds: int = STAR_ROUNDS,
    pivots: int = PIVOTS,
) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of ``docs`` (doc_id BIGINT, text STRING).

    Documents are linked when 100 * |A & B| >= percent * |A | B| for their sets of distinct shingles of
    ``width`` lower-cased words (a shorter text is one shingle of all its words). Equal sets are one class.

    1. Each class posts its node under its lists: each few coordinates of its signature with their values. So many
       coordinates make a list as linked pairs still share one, but for :data:`MISS`. Lists of one node are left out.
    2. In a few rounds each list compares its nodes with some pivots, which joins large groups of near copies
       without all their pairs. Where lists still hold nodes of different components, these are joined pair by pair.
    3. A pair must differ in few parities of its sets, which loses no pair, and is confirmed on the full sets.

    Rows without words, text or doc_id are linked with nothing. Rows that repeat a doc_id are rows of
    their own with one number; an empty table gives no rows.
    """
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    size = coordinates_of_list(coordinates, percent / 100)
    sketch = source.mapInArrow(
        _sketches(width, coordinates, size), "doc_id bigint, n bigint, digest binary, lists binary, " + ", ".join(f"{c} bigint" for c in _ODD)
    )
    sketch = written(sketch, "sketches")
    named = sketch.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    sets = named.groupBy("digest").agg(F.min("doc_id").alias("node"), *[F.first(c).alias(c) for c in ("n", "lists", *_ODD)])
    sets = written(sets, "sets")

    posts = sets.select("node", "lists").mapInArrow(_postings, "list bigint, node bigint")
    lengths = posts.groupBy("list").count().where("count > 1")
    posts = written(posts.join(lengths, "list", "left_semi"), "postings")

    nodes = posts.select("node").distinct()
    held = written(sets.join(nodes, "node", "left_semi").drop("lists"), "nodes")
    nodes, wanted = held.select("node").distinct(), held.select("node", "digest")
    texts = source.join(wanted, source.doc_id == wanted.node).select("node", "text", "digest")
    texts = texts.mapInArrow(_texts(width), "node bigint, text binary").dropDuplicates(["node"])
    texts = written(texts, "texts")
    join = _Join(held, texts, width, percent)

    labels = written(nodes.select("node", F.col("node").alias("component")), "labels")
    links: list[DataFrame] = []
    seeds = [int(x) for x in np.random.default_rng(11).integers(0, 1 << 62, star_rounds * pivots)]
    for turn in range(star_rounds + 1):
        open_ = posts.join(labels, "node")
        split = open_.groupBy("list").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        open_ = written(open_.join(split.where("low <> high").select("list"), "list"), "open-lists")
        if turn < star_rounds:
            # The node nearest to a seed in the exclusive-or sense: each seed prefers another node, in all lists alike.
            own = seeds[turn * pivots : (turn + 1) * pivots]
            nearest = [F.min(F.col("node").bitwiseXOR(F.lit(x))).bitwiseXOR(F.lit(x)) for x in own]
            star = open_.groupBy("list").agg(F.array_distinct(F.array(*nearest)).alias("pivots"))
            pairs = open_.join(star, "list").select(F.explode("pivots").alias("a"), F.col("node").alias("b")).where("a <> b")
            pairs = pairs.distinct()
            left, right = (labels.select(F.col("node").alias(x), F.col("component").alias("c" + x)) for x in "ab")
            pairs = join.fitting(pairs.join(left, "a").join(right, "b").where("ca <> cb"))
        else:
            left, right = (open_.withColumnsRenamed({"node": x, "component": "c" + x}).join(join.side(x), x) for x in "ab")
            pairs = left.join(right, "list").where(join.fits()).where("a < b AND ca <> cb").select("a", "b").distinct()
        links.append(written(join.confirmed(pairs), "confirmed"))
        discard(open_)
        if turn < star_rounds - 1:
            labels = _hooked(labels, links[-1])
        elif turn < star_rounds:
            # The rest is compared pair by pair, so no two labels of connected nodes may be left.
            labels = components(nodes, reduce(DataFrame.union, links))
    # What the last links join is few: the labels of all other nodes stay.
    left, right = (labels.select(F.col("node").alias(x), F.col("component").alias("c" + x)) for x in "ab")
    last = written(links[-1].join(left, "a").join(right, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "last-links")
    joined = components(last.select(F.explode(F.array("a", "b")).alias("node")).distinct(), last, "to")
    joined = joined.select(F.col("node").alias("component"), "to")
    labels = labels.join(joined, "component", "left").select("node", F.coalesce("to", "component").alias("component"))

    found = labels.where("component <> node")
    placed = named.select("doc_id", "digest").distinct().join(sets.select("digest", "node"), "digest")
    placed = placed.join(found, "node", "left").select("doc_id", "digest", F.coalesce("component", "node").alias("component_id"))
    out = sketch.select("doc_id", "n", "digest").join(placed, ["doc_id", "digest"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
