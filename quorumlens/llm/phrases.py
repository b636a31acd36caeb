"""Phrases of each language, mined by Toivonen's method and scored by their weakest cut.

A first pass adds up, over all documents, the counts of the hashes of words and of pairs of words. A word or a pair
whose hash stays below the least count is infrequent for certain, so its spelling never leaves a task. A sample of
the documents proposes longer phrases. One pass over all documents then counts, exactly, the words and pairs that are
left and every longer phrase whose two maximal parts are held for frequent: the proposed ones and their negative
border. Where a phrase of the border turns out frequent, phrases that contain it may have been missed; an expansion
pass counts all of these, at every length, so that nothing stays open. The result depends neither on the sample nor
on hashes.

Which phrases are held for frequent, tasks look up in a bitmap of fixed size. A wrong hit there, or hashes that share
a count, make them count a phrase too many, which the exact count then removes. Building the result runs jobs: one
pass for hashes, one over the sample for each length between two words and the longest, one full pass, and one
expansion pass if the border fails.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorumlens.llm.common import mixed, rows_of
from quorumlens.session import written

LONGEST = 4
LEAST = 30
#: Phrases shown for each language.
TOP = 2000
SCALE = 2_000_000
#: A phrase goes when a longer one around it occurs at least so often, in percent.
COVERED = 80

#: One document in so many is in the sample.
SAMPLE = 4
#: Share of the expected sample count from which on the sample proposes a phrase.
LOWERED = 0.7
#: Bits of the bitmap of one phrase length.
BITS = 1 << 26

#: Words of a task's texts that are counted together before they leave the task.
_BLOCK = 400_000
#: Bits of the hashes that counts are kept of; the first ones choose the range, which is added up in one group.
_KEY_BITS, _RANGE_BITS = 34, 11
_REST = np.uint64(_KEY_BITS - _RANGE_BITS)
#: Hashes with counts that a task keeps before they leave it, each packed into one number with its count.
_KEPT = 4_000_000
_COUNT_BITS = np.uint64(30)
#: Words whose hashes a task remembers.
_REMEMBERED = 300_000
#: A byte that no UTF-8 text holds stands between pieces.
_END = b"\xff"

_CUTS = b".,;:!?\n\x0b\x0c\r"
#: A-Z become a-z, ends of pieces become one byte, tabs become spaces.
_PLAIN = bytes(
    b + 32 if 65 <= b <= 90 else 0xFF if b in _CUTS else 32 if b == 9 else b for b in range(256)
)

_FACTOR = np.uint64(0x9E3779B97F4A7C15)

_PHRASES = pa.schema([("lang", pa.string()), ("n_words", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())])
_KINDS = "lang string, n_words int, phrase string, n bigint"
#: Either words of a language, or a number of hashes of a range with their counts.
_PACKED = pa.schema([("range", pa.int32()), ("lang", pa.string()), ("n", pa.int64()), ("packed", pa.binary())])
_SUMS = pa.schema([("lang", pa.string()), ("total", pa.int64()), ("at", pa.int64()), ("bit", pa.int64())])


def _seed(lang: str) -> int:
    return xxhash.xxh32_intdigest(lang.encode())


def _word_hash(word: bytes, seed: int) -> int:
    """Never 0, which stands between pieces."""
    return xxhash.xxh3_64_intdigest(word, seed) or 1


def _pieces(text: bytes) -> list[bytes]:
    """Words of a text with ``_END`` after each piece."""
    found = text.translate(_PLAIN).replace(_END, b" \xff ").split()
    found.append(_END)
    return found


def _keys(hashes: np.ndarray) -> np.ndarray:
    """What is counted of each hash."""
    return mixed(hashes) & np.uint64((1 << _KEY_BITS) - 1)


def _places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Number and bit of each key in a bitmap."""
    at = (keys % np.uint64(bits)).astype(np.int64)
    return at >> 6, np.uint64(1) << (at & 63).astype(np.uint64)


def _held(bitmap: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Whether the bit of each hash is set."""
    at = (_keys(hashes) % np.uint64(bits)).astype(np.int64)
    return (bitmap[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


@dataclass
class _Test:
    """Which phrases of ``width`` words to count: with both maximal parts ``known`` (or followed so far, if None).

    With ``own``, only those that it holds themselves; with ``missed``, only those that hold a phrase that some ``missed`` of this or a smaller width has.
    """

    width: int
    known: Broadcast | None = None
    missed: Broadcast | None = None
    counted: bool = True
    own: Broadcast | None = None


class _Words:
    """Words of a block by number: spelling, language and hash. Number 0 stands between pieces."""

    def __init__(self) -> None:
        self.spelled: list[bytes] = [b""]
        self.langs: list[str] = [""]
        self.hashes: list[int] = [0]


class _Numbers(dict):
    """Numbers of the words of one language; a new word is entered in the words of its block."""

    def __init__(self, words: _Words, lang: str) -> None:
        super().__init__({_END: 0})
        self.words, self.lang, self.seed = words, lang, _seed(lang)

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.words.spelled)
        self.words.spelled.append(word)
        self.words.langs.append(self.lang)
        self.words.hashes.append(_word_hash(word, self.seed))
        return number


class _Hashes(dict):
    """Hashes of the words of one language."""

    def __init__(self, lang: str) -> None:
        super().__init__({_END: 0})
        self.seed = _seed(lang)

    def __missing__(self, word: bytes) -> int:
        value = self[word] = _word_hash(word, self.seed)
        return value


class _Block:
    """The words of some documents as numbers. Nothing here refers back to the block, so it goes as soon as it is done."""

    def __init__(self) -> None:
        self.words = _Words()
        self.numbers: dict[str, _Numbers] = {}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, text: bytes) -> None:
        if lang not in self.numbers:
            self.numbers[lang] = _Numbers(self.words, lang)
        found = _pieces(text)
        self.parts.append(np.fromiter(map(self.numbers[lang].__getitem__, found), np.int64, len(found)))
        self.size += len(found)

    def counts(self, tests: Sequence[_Test], bits: int) -> Iterator[pa.RecordBatch]:
        """Exact counts within the block of the phrases that the tests let through; ``tests`` are of width 1, 2, 3 ... or of 2, 3 ..."""
        words, hashes = np.concatenate(self.parts), np.array(self.words.hashes, np.uint64)
        # The number of the phrase of one word less that starts at a place, -1 where none does that matters,
        # and whether that phrase holds a missed one.
        label, holds = np.where(words > 0, words, -1), np.zeros(len(words), bool)
        for test in tests:
            width = test.width
            if width == 1:
                n = np.bincount(words, minlength=len(hashes))
                n[0] = 0
                if test.own is not None:
                    n[~_held(test.own.value, _joined(hashes, np.arange(len(hashes))[None, :]), bits)] = 0
                    label[n[words] == 0] = -1
                if test.counted:
                    yield from self._rows(np.flatnonzero(n)[None, :], n[n > 0])
                continue
            if len(label) < 2:
                return
            place = np.flatnonzero((label[:-1] >= 0) & (label[1:] >= 0))
            if test.own is not None:
                place = place[_held(test.own.value, _joined(hashes, [words[place + k] for k in range(width)]), bits)]
            key = label[place] << 32 | words[place + width - 1]
            _, first, inverse, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            start = place[first]
            phrase = np.stack([words[start + k] for k in range(width)])
            known = np.ones(len(n), bool)
            if test.known is not None or test.missed is not None:
                parts = _joined(hashes, phrase[:-1]), _joined(hashes, phrase[1:])
            if test.known is not None:
                known = _held(test.known.value, parts[0], bits) & _held(test.known.value, parts[1], bits)
            label = np.full(len(label) - 1, -1, np.int64)
            label[place] = np.where(known, np.arange(len(n)), -1)[inverse]
            if test.missed is not None:
                anew = _held(test.missed.value, parts[0], bits) | _held(test.missed.value, parts[1], bits)
                anew |= holds[start] | holds[start + 1]
                holds = np.zeros(len(label), bool)
                holds[place] = anew[inverse]
                known &= anew
            if test.counted:
                yield from self._rows(phrase[:, known], n[known])

    def _rows(self, phrases: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        words, langs = pa.array(self.words.spelled, pa.binary()), pa.array(self.words.langs, pa.string())
        width = len(phrases)
        for at in range(0, len(n), 200_000):
            part = phrases[:, at : at + 200_000]
            spelled = pc.binary_join_element_wise(*[words.take(pa.array(row)) for row in part], b" ")
            columns = [langs.take(pa.array(part[0])), pa.array(np.full(part.shape[1], width, np.int32)), spelled.cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n[at : at + 200_000].astype(np.int64))], schema=_PHRASES)


def _joined(hashes: np.ndarray, phrases: Sequence[np.ndarray]) -> np.ndarray:
    """Hash of each column of word numbers."""
    out = mixed(hashes[phrases[0]] + np.uint64(len(phrases)))
    for row in phrases[1:]:
        out = mixed(out * _FACTOR + hashes[row])
    return out


def _firsts(values: np.ndarray) -> np.ndarray:
    """Places of the first one of each run of equal values."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])


def _packed(keys: np.ndarray, most: int) -> np.ndarray:
    """Each key once with its count, in the order of the keys; counts of ``most`` or more are ``most``."""
    keys = np.sort(keys)
    begin = _firsts(keys)
    n = np.minimum(np.diff(begin, append=len(keys)), most).astype(np.uint64)
    return keys[begin] << _COUNT_BITS | n


def _merged(packed: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The same of packed numbers, as keys and counts."""
    packed = np.sort(packed)
    keys = packed >> _COUNT_BITS
    begin = _firsts(keys)
    n = np.add.reduceat(packed & ((np.uint64(1) << _COUNT_BITS) - np.uint64(1)), begin)
    return keys[begin], np.minimum(n, np.uint64(most))


def _sent(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Keys and counts by range: differences of neighbouring keys and counts, byte by byte, compressed."""
    ranges = (keys >> _REST).astype(np.int32)
    begin = _firsts(ranges)
    rest = (keys & ((np.uint64(1) << _REST) - np.uint64(1))).astype("<u4")
    step = np.diff(rest, prepend=rest[:1])
    step[begin] = rest[begin]
    both = np.stack([step, n.astype("<u4")], axis=1).view(np.uint8)
    codec, ends = pa.Codec("zstd", compression_level=1), np.append(begin[1:], len(keys))
    parts = [codec.compress(both[low:high].T.tobytes(), asbytes=True) for low, high in zip(begin.tolist(), ends.tolist(), strict=True)]
    columns = [pa.array(ranges[begin]), pa.nulls(len(begin), pa.string()), pa.array(ends - begin), pa.array(parts, pa.binary())]
    yield pa.RecordBatch.from_arrays(columns, schema=_PACKED)


def _received(number: int, sizes: Sequence[int], parts: Sequence[bytes]) -> np.ndarray:
    """Packed keys and counts of one range."""
    codec, out, at = pa.Codec("zstd"), np.empty(sum(sizes), np.uint64), 0
    for size, part in zip(sizes, parts, strict=True):
        both = np.frombuffer(codec.decompress(part, 8 * size, asbytes=True), np.uint8).reshape(8, size)
        step, n = np.ascontiguousarray(both.T).view("<u4").T
        out[at : at + size] = (np.uint64(number) << _REST | np.cumsum(step, dtype=np.uint64)) << _COUNT_BITS | n
        at += size
    return out


def _tallying(most: int) -> Callable:
    """Counts of the hashes of words and pairs, and words of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, _Hashes] = {}
        totals: dict[str, int] = {}
        parts: list[np.ndarray] = []
        kept: list[np.ndarray] = []

        def counted() -> None:
            hashes = np.concatenate(parts)
            parts.clear()
            word = hashes != 0
            pair = np.flatnonzero(word[:-1] & word[1:])
            keys = [_joined(hashes, [np.flatnonzero(word)]), _joined(hashes, [pair, pair + 1])]
            kept.append(_packed(_keys(np.concatenate(keys)), most))

        for lang, text in rows_of(batches, "lang", "text"):
            if lang not in known:
                known[lang] = _Hashes(lang)
            found = _pieces(text)
            parts.append(np.fromiter(map(known[lang].__getitem__, found), np.uint64, len(found)))
            totals[lang] = totals.get(lang, 0) + int(np.count_nonzero(parts[-1]))
            if sum(map(len, known.values())) > _REMEMBERED:
                known.clear()
            if sum(map(len, parts)) >= _BLOCK:
                counted()
                if sum(map(len, kept)) >= _KEPT:
                    keys, n = _merged(np.concatenate(kept), most)
                    kept.clear()
                    if len(keys) >= _KEPT // 2:
                        yield from _sent(keys, n)
                    else:
                        kept.append(keys << _COUNT_BITS | n)
        if parts:
            counted()
        if sum(map(len, kept)):
            yield from _sent(*_merged(np.concatenate(kept), most))
        if totals:
            columns = [pa.array([-1] * len(totals), pa.int32()), pa.array(totals.keys(), pa.string()), pa.array(totals.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(totals), pa.binary())], schema=_PACKED)

    return run


def _adding(most: int, bits: int) -> Callable:
    """Words of a language, or the places in a bitmap of the hashes of a range that are frequent enough."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        number, lang = (k.as_py() for k in key)
        if lang is not None:
            return pa.table([[lang], [pc.sum(table.column("n")).as_py()], [None], [None]], schema=_SUMS)
        packed = _received(number, table.column("n").to_pylist(), table.column("packed").to_pylist())
        keys, n = _merged(packed, most)
        at, bit = _places(keys[n >= np.uint64(most)], bits)
        nothing = pa.nulls(len(at))
        return pa.table([nothing.cast(pa.string()), nothing.cast(pa.int64()), pa.array(at), pa.array(bit.view(np.int64))], schema=_SUMS)

    return run


def _tallied(texts: DataFrame, bits: int, least: int) -> DataFrame:
    """(lang, total) of all words, and (at, bit) of the words and pairs whose hashes occur ``least`` times or more."""
    most = max(1, min(least, 1 << 29))
    each = texts.mapInArrow(_tallying(most), "range int, lang string, n bigint, packed binary")
    return each.groupBy("range", "lang").applyInArrow(_adding(most, bits), "lang string, total bigint, at bigint, bit bigint")


def _counting(tests: Sequence[_Test], bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block()
        for lang, text in rows_of(batches, "lang", "text"):
            block.add(lang, text)
            if block.size >= _BLOCK:
                yield from block.counts(tests, bits)
                block = _Block()
        if block.size:
            yield from block.counts(tests, bits)

    return run


def _counted(texts: DataFrame, tests: Sequence[_Test], bits: int, least: int) -> DataFrame:
    """lang, n_words, phrase, n of phrases that occur ``least`` times or more; blocks are added up before the shuffle."""
    each = texts.mapInArrow(_counting(tests, bits), _KINDS)
    return each.groupBy("lang", "n_words", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _hashes(batch: pa.RecordBatch) -> np.ndarray:
    """Hash of each phrase of a batch, the same as :func:`_joined` gives for its words."""
    out = np.empty(batch.num_rows, np.uint64)
    for i, (lang, phrase) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist(), strict=True)):
        seed = _seed(lang)
        words = np.array([_word_hash(w, seed) for w in phrase.encode().split(b" ")], np.uint64)
        out[i] = _joined(words, np.arange(len(words))[:, None])[0]
    return out


def _bitmap(phrases: DataFrame, bits: int) -> Broadcast:
    """Bitmap of the hashes of phrases of one width: ``bits`` / 64 numbers at most, however many phrases there are."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, bit = _places(_keys(_hashes(batch)), bits)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bit.view(np.int64))], names=["at", "bit"])

    return _bitmap_of(phrases.select("lang", "phrase").mapInArrow(places, "at bigint, bit bigint"), bits)


def _bitmap_of(set_bits: DataFrame, bits: int) -> Broadcast:
    found = set_bits.groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()
    bitmap = np.zeros(bits // 64, np.uint64)
    bitmap[found.column("at").to_numpy()] = found.column("bit").to_numpy().view(np.uint64)
    return set_bits.sparkSession.sparkContext.broadcast(bitmap)


def frequent(
    documents: DataFrame,
    least: int = LEAST,
    longest: int = LONGEST,
    sample: int = SAMPLE,
    lowered: float = LOWERED,
    bits: int = BITS,
) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): lang, n_words, phrase, n of every run of 1 to ``longest`` words that occurs ``least`` times
    or more in its language; and lang, total of all word occurrences.

    Hashes of words and pairs are counted over all documents first, so these need no sample. Of longer phrases, one
    document in ``sample`` proposes those that it holds ``lowered`` x ``least`` / ``sample`` times or more, once at least.
    """
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    texts = documents.select(lang.alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.col("doc_id").alias("doc"))
    chosen = texts.where(F.pmod(F.xxhash64("doc", "text"), F.lit(sample)) == 0).drop("doc")
    texts = texts.drop("doc")

    tallied = written(_tallied(texts, bits, least), "phrase-hashes")
    # A language without words has no total.
    totals = tallied.where("total > 0").select("lang", "total")
    common = _bitmap_of(tallied.where("bit IS NOT NULL").select("at", "bit"), bits)

    def tests(counted: Sequence[int], held: dict[int, Broadcast]) -> list[_Test]:
        """Phrases of words and pairs that may be frequent, and of longer parts that are held for it."""
        widths = range(1, max(counted) + 1)
        return [_Test(w, held.get(w - 1), counted=w in counted, own=common if w < 3 else None) for w in widths]

    held: dict[int, Broadcast] = {}
    proposed = max(1, int(lowered * least / sample))
    for width in range(3, longest):
        held[width] = _bitmap(_counted(chosen, tests([width], held), bits, proposed), bits)

    # The full pass counts what may be frequent: words and pairs by their hashes, and by the sample what it proposed
    # and the negative border.
    found = written(_counted(texts, tests(range(1, longest + 1), held), bits, least), "phrase-counts")
    if longest < 4:
        return found, totals
    inner = found.where((F.col("n_words") > 2) & (F.col("n_words") < longest))
    missed = written(inner.mapInArrow(_missing(held, bits), _KINDS), "phrases-missed")
    if missed.isEmpty():
        return found, totals
    # A phrase that was not counted holds a frequent phrase of the border, whose own parts the sample had: the
    # expansion follows all pairs that may be frequent and counts every longer phrase around a missed one, so it closes.
    around = [_Test(w, counted=False, own=common if w < 3 else None) for w in (1, 2, 3)]
    for width in range(4, longest + 1):
        around.append(_Test(width, None, _bitmap(missed.where(F.col("n_words") == width - 1), bits)))
    grown = written(_counted(texts, around, bits, least), "phrase-expansion")
    return found.unionByName(grown).dropDuplicates(["lang", "phrase"]), totals


def _missing(held: dict[int, Broadcast], bits: int) -> Callable:
    """Rows whose phrase is not in the bitmap of its width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, width = _hashes(batch), batch.column("n_words").to_numpy()
            outside = np.zeros(batch.num_rows, bool)
            for w, bitmap in held.items():
                outside |= (width == w) & ~_held(bitmap.value, hashes, bits)
            yield batch.filter(pa.array(outside))

    return run


def collocations(
    documents: DataFrame,
    least: int = LEAST,
    longest: int = LONGEST,
    top: int = TOP,
    scale: int = SCALE,
    covered: int = COVERED,
    sample: int = SAMPLE,
    lowered: float = LOWERED,
    bits: int = BITS,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best ``top`` phrases of two or more words of each language.

    Of the cuts of a phrase after its first words into parts with counts l and r, the one with the smallest
    floor(scale * a / (l + r)) gives the score, the earliest one of equals. Phrases inside a longer frequent phrase
    that occurs ``covered`` percent as often or more go, whether that one stays or not. n counts all words of the
    language. A null text is empty, a null language ``und``; other columns are ignored; a repeated row counts
    again; an empty table gives no rows.
    """
    counted, totals = frequent(documents, least, longest, sample, lowered, bits)
    counted = written(counted, "phrases")
    parts = F.split("phrase", " ")
    several = counted.where("n_words > 1").select("lang", "n_words", "phrase", F.col("n").alias("a"), parts.alias("words"))
    cut = several.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)))
    cut = cut.withColumn("first", F.array_join(F.slice("words", F.lit(1), F.col("k")), " "))
    cut = cut.withColumn("rest", F.array_join(F.slice("words", F.col("k") + 1, F.col("n_words")), " "))
    left = counted.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    right = counted.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    score = F.expr(f"(CAST({scale} AS DECIMAL(10,0)) * CAST(a AS DECIMAL(20,0))) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    cut = cut.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn("score", score)
    weakest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    scored = cut.groupBy("lang", "phrase", "a").agg(weakest).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    # Parts of two or more words of each phrase, with the count of the most frequent phrase around them.
    spans = [(first, width) for width in range(2, longest) for first in range(1, longest - width + 2)]
    inside = [
        F.when(F.col("n_words") >= max(first + width - 1, width + 1), F.array_join(F.slice("words", first, width), " "))
        for first, width in spans
    ]
    around = several.where("n_words > 2").select("lang", F.explode(F.array(F.lit(None).cast("string"), *inside)).alias("phrase"), F.col("a").alias("longer"))
    around = around.where("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    hidden = F.expr(f"CAST(100 AS DECIMAL(10,0)) * CAST(longer AS DECIMAL(20,0)) >= CAST({covered} AS DECIMAL(10,0)) * CAST(a AS DECIMAL(20,0))")
    kept = scored.join(around, ["lang", "phrase"], "left").where(F.col("longer").isNull() | ~hidden)

    # A language may hold most phrases: its best are chosen within pieces first.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    piece = F.pmod(F.xxhash64("phrase"), F.lit(16))
    place = F.row_number().over(Window.partitionBy("lang", "piece").orderBy(*order))
    best = kept.withColumn("piece", piece).withColumn("place", place).where(F.col("place") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    ranked = best.withColumn("rank", rank).where(F.col("rank") <= top).join(totals, "lang")
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
