"""Causal self-attention language model on subword ids, trained and run inside Spark tasks.

The executors' JVM takes steps and scores where it has vectors (``AttentionLm.java``), else numpy does the same here.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlens.llm.common import Batches, rows_of
from quorumlens.llm.jvm import loaded
from quorumlens.llm.token_shards import END, TOKENIZER, Encoder, read_ranks
from quorumlens.session import written

#: Tokens of a context window, and how far the next window starts behind it.
WINDOW = 64
STRIDE = 48
WIDTH = 16
#: Classes of the first level of the output. The most frequent tokens are classes of their own; the rest is cut into
#: ``TAILS`` classes of growing size, whose members are told apart by a second level.
CLASSES = 128
TAILS = 64
#: So many tail classes of few members, and so many of them at a time, are compared in one product of matrices.
SMALL = 32
TOGETHER = 8
#: Members of the first tail class, and how much larger each next one is (the last one has what is left).
LEAST_MEMBERS = 4
GROWTH = 1.121
VOCABULARY = 50_257
#: One in so many windows of every training document is trained on; 1 is all of them.
EVERY = 1
#: Each training document belongs to one of so many rounds.
ROUNDS = 4
BATCH = 16
RATE = 0.02
#: A word is frequent when it is one of so many tokens or more; there are no more frequent words than this.
FREQUENT = 200_000


class Subwords(Encoder):
    """Ids of lower-cased words with a space before each."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__(ranks)
        self.opens = np.zeros(VOCABULARY, bool)
        self.opens[[i for token, i in ranks.items() if token[:1] == b" "]] = True

    def words(self, words: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word by itself, and the number of the word that each id belongs to."""
        text = "".join([" " + w.decode() for w in words])
        if text[1:] == " ".join(text.split()):
            # No id reaches across a space, so each word begins with the id that has one.
            ids = self.ids(text)
            return ids, np.cumsum(self.opens[ids]) - 1
        # Other white space in a word is cut together with that around the word.
        each = [self.ids(" " + w.decode()) for w in words]
        return np.concatenate(each), np.repeat(np.arange(len(each)), [len(ids) for ids in each])

    def text(self, words: list[bytes]) -> np.ndarray:
        """The same with the end of the text."""
        return np.append(self.ids((b" " + b" ".join(words)).decode() if words else ""), np.uint16(END))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def held_out(doc: int | None) -> bool:
    """Whether a document is not learned from; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % 7 == 2


_NOTHING = np.float32(-1e9)  # logarithm of a share that is none


@dataclass
class Vocabulary:
    """Rank by count (the input number), class and log10 share of its class of every token id.

    ``first`` has the first rank of each class and, at its end, the number of ids; ``start`` has the natural
    logarithm of the share by rank, ``small`` the class of each member of a small class. ``groups`` are neighbouring classes of several members:
    first class, first rank and its end, and for each class ``start`` of its members and next to nothing for the other
    ranks (None for a class alone).
    """

    inputs: np.ndarray
    classes: np.ndarray
    share: np.ndarray
    prior: np.ndarray
    first: np.ndarray
    start: np.ndarray
    small: np.ndarray
    groups: list[tuple[int, int, int, np.ndarray | None]]

    @classmethod
    def of(cls, counts: np.ndarray) -> Vocabulary:
        order = np.lexsort((np.arange(len(counts)), -counts))
        inputs = np.empty(len(counts), np.int64)
        inputs[order] = np.arange(len(counts))
        weight = counts + 1.0
        single = CLASSES - TAILS
        sizes = np.round(LEAST_MEMBERS * GROWTH ** np.arange(TAILS - 1)).astype(np.int64)
        first = np.concatenate([np.arange(single + 1), single + np.cumsum(sizes), [len(counts)]])
        member = np.searchsorted(first, np.arange(len(counts)), "right") - 1
        classes = member[inputs]
        total = np.bincount(classes, weight, CLASSES)
        share = np.log10(weight / total[classes])
        start = (share * np.log(10))[order].astype(np.float32)
        groups = []
        for c in [*range(single, single + SMALL, TOGETHER), *range(single + SMALL, CLASSES)]:
            n = TOGETHER if c < single + SMALL else 1
            low, high = int(first[c]), int(first[c + n])
            own = np.where(member[low:high] == np.arange(c, c + n)[:, None], start[low:high], _NOTHING) if n > 1 else None
            groups.append((c, low, high, own))
        return cls(inputs.astype(np.int32), classes.astype(np.int32), share, np.log(np.maximum(total, 1.0) / weight.sum()), first, start, member[first[single] : first[single + SMALL]], groups)


def start_weights(vocabulary: Vocabulary, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    normal = lambda *n: (rng.standard_normal(n) * 0.3 / np.sqrt(n[-1])).astype(np.float32)
    weights = {"e": normal(VOCABULARY + 1, WIDTH) * 3, "p": normal(WINDOW, WIDTH)}
    weights |= {k: normal(WIDTH, WIDTH) for k in ("q", "k", "v", "o")}
    # Within its class a token starts with its share.
    weights["m"] = np.zeros((VOCABULARY, WIDTH), np.float32)
    return weights | {"c": normal(WIDTH, CLASSES), "b": vocabulary.prior.astype(np.float32)}


_SEEN = np.tri(WINDOW, dtype=np.float32)
#: Sums of exponentials between these are taken as they are; others have their largest logit subtracted first.
_LEAST, _MOST = 1e-20, 1e30


def _sums(m: np.ndarray) -> np.ndarray:
    return m @ np.ones((m.shape[-1], 1), m.dtype)


def _common(total: np.ndarray) -> bool:
    return bool(total.min() > _LEAST and total.max() < _MOST)


def exponentials(make: Callable[[], np.ndarray], seen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of the logits that ``make`` returns and the sum of each row, but for a factor of the row.

    ``seen`` is 1 for entries that count, else 0.
    """
    out = make()
    with np.errstate(over="ignore", invalid="ignore"):  # what overflows is worked out anew
        np.exp(out, out=out)
        if seen is not None:
            out *= seen
        total = _sums(out)
    if not _common(total):
        out = make()
        if seen is not None:
            out = np.where(seen > 0, out, -np.inf)
        out -= out.max(axis=-1, keepdims=True)
        np.exp(out, out=out)
        total = _sums(out)
    return out, total


def projections(w: dict[str, np.ndarray]) -> np.ndarray:
    """What makes queries, keys and values, side by side, of inputs."""
    return np.concatenate([w["q"] * w["q"].dtype.type(WIDTH**-0.5), w["k"], w["v"]], axis=1)


def hidden_states(w: dict[str, np.ndarray], x: np.ndarray, least: int = 0) -> tuple[np.ndarray, ...]:
    """What leads from each input to its hidden state, which comes last; rows of ``a`` are still to be divided by ``total``.

    Places before ``least`` are context only and have no hidden state.
    """
    e = w["e"].take(x, axis=0)
    e += w["p"]
    qkv = (e.reshape(-1, WIDTH) @ projections(w)).reshape(*x.shape, 3 * WIDTH)
    q, k, v = (qkv[:, :, i * WIDTH : (i + 1) * WIDTH] for i in range(3))
    q = q[:, least:]
    # Products are faster with a copy that lies as they read it.
    across = np.ascontiguousarray(k.transpose(0, 2, 1))
    a, total = exponentials(lambda: q @ across, _SEEN[least:])
    c = a @ v
    c /= total
    h = (c.reshape(-1, WIDTH) @ w["o"]).reshape(c.shape)
    h += e[:, least:]
    return e, q, k, v, a, total, c, h


def attend(w: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Class logits (windows * WINDOW, CLASSES) of the next token after each input, and what led there."""
    states = hidden_states(w, x)
    logits = states[-1].reshape(-1, WIDTH) @ w["c"]
    logits += w["b"]
    return logits, *states


def normalised(logits: np.ndarray) -> np.ndarray:
    """log of the sum of exponentials of each row."""
    with np.errstate(over="ignore"):
        total = _sums(np.exp(logits))
    if not _common(total):
        top = logits.max(axis=1, keepdims=True)
        return np.log(_sums(np.exp(logits - top)))[:, 0] + top[:, 0]
    return np.log(total)[:, 0]


def forward(w: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Log class probabilities instead of logits."""
    logits, *rest = attend(w, x)
    return logits - normalised(logits)[:, None], *rest


def by_class(vocabulary: Vocabulary, classes: np.ndarray, used: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
    """Used places of each class of several members, with the first rank of the class and its end."""
    at = np.flatnonzero(used & (classes >= CLASSES - TAILS))
    at = at[np.argsort(classes[at], kind="stable")]
    found, begin = np.unique(classes[at], return_index=True)
    for c, places in zip(found.tolist(), np.split(at, begin[1:]), strict=False):
        yield places, int(vocabulary.first[c]), int(vocabulary.first[c + 1])


def _member_logits(w: dict[str, np.ndarray], vocabulary: Vocabulary, h: np.ndarray, start: int, end: int, own=None) -> np.ndarray:
    logits = h @ w["m"][start:end].T
    logits += vocabulary.start[start:end] if own is None else own
    return logits


def member_logs(w: dict[str, np.ndarray], vocabulary: Vocabulary, h: np.ndarray, start: int, end: int) -> np.ndarray:
    """log probability, given the hidden states ``h``, of each member of the class of these ranks."""
    logits = _member_logits(w, vocabulary, h, start, end)
    logits -= logits.max(axis=1, keepdims=True)
    logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
    return logits


def _losses(make: Callable[[], np.ndarray], targets: np.ndarray, scale: np.floating) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the logits that ``make`` returns, but for a factor of each row, and these factors."""
    d, total = exponentials(make)
    d.reshape(-1)[np.arange(0, d.size, d.shape[1]) + targets] -= total[:, 0]
    return d, scale / total


def _put(table: np.ndarray, rows: np.ndarray | slice, values: np.ndarray) -> None:
    """``table[rows] = values``; whole rows are copied as one item each, which is faster."""
    item = np.dtype((np.void, table.itemsize * table.shape[1]))
    table.view(item)[rows] = values.view(item)


#: Rows of a block in products of long narrow matrices: many small products are faster than a large one.
_BLOCK = 64


def _gradients(w: dict[str, np.ndarray], x, y, used, ranks=None, vocabulary: Vocabulary | None = None) -> dict[str, np.ndarray | list]:
    """Like :func:`gradients`, with lists of (rows, values) for ``e`` and ``m``, ``q``, ``k`` and ``v`` side by side, ``b`` below ``c``."""
    e, q, k, v, a, total, c, h = hidden_states(w, x)
    flat = lambda m: m.reshape(-1, WIDTH)
    blocks = lambda m: m.reshape(-1, _BLOCK, m.shape[1])
    # Places that are not in use are context only: nothing is predicted there. The others stand by class.
    places, classes = used.ravel().nonzero()[0], y.ravel()
    places = places.take(classes.take(places).astype(np.uint16).argsort(kind="stable"))
    classes = classes.take(places)
    n = len(places)
    scale = h.dtype.type(1 / max(1, n))
    g = {"cb": np.zeros((WIDTH + 1, CLASSES), h.dtype), "m": []}
    dh = np.zeros((x.size, WIDTH), h.dtype)
    if n:
        # The last column is for ``b``; rows that fill the last block have no part in any sum.
        hidden = np.zeros((-(-n // _BLOCK) * _BLOCK, WIDTH + 1), h.dtype)
        hidden[:n, :WIDTH] = flat(h).take(places, axis=0)
        hidden[:n, WIDTH] = 1
        cb = np.concatenate([w["c"], w["b"][None]])
        # Factors of rows go to the narrow side of a product.
        filled = np.zeros(len(hidden), classes.dtype)
        filled[:n] = classes
        d, factors = _losses(lambda: (blocks(hidden) @ cb).reshape(-1, CLASSES), filled, scale)
        g["cb"] = (blocks(hidden * factors).transpose(0, 2, 1) @ blocks(d)).sum(axis=0)
        dhidden = (blocks(d) @ np.ascontiguousarray(w["c"].T)).reshape(-1, WIDTH)
        dhidden *= factors
        if ranks is not None:
            ranks = ranks.ravel().take(places)
            often = np.bincount(classes, minlength=CLASSES)
            begin = [0, *often.cumsum().tolist()]
            first = vocabulary.groups[0][1]
            small = np.empty((len(vocabulary.small), WIDTH), h.dtype)
            for least, start, end, own in vocabulary.groups:
                low, high = begin[least], begin[least + (1 if own is None else len(own))]
                if low == high:
                    continue
                one = hidden[low:high, :WIDTH]
                if own is not None:
                    own = own.take(classes[low:high] - least, axis=0)
                logits = _member_logits(w, vocabulary, one, start, end, own)
                dm, factors = _losses(logits.copy, ranks[low:high] - start, scale)
                back = dm @ w["m"][start:end]
                back *= factors
                dhidden[low:high] += back
                if own is None:
                    g["m"].append((slice(start, end), dm.T @ (one * factors)))
                else:
                    np.matmul(dm.T, one * factors, out=small[start - first : end - first])
            # Classes without a place stay as they are.
            moved = np.flatnonzero(often.take(vocabulary.small))
            g["m"].append((first + moved, small.take(moved, axis=0)))
        _put(dh, places, dhidden[:n])
    g["o"] = flat(c).T @ dh
    # As rows of a and v make c, the sum of da * a over a row is that of dc * c; it is one more column of dc and row of v.
    dc = np.empty((*x.shape, WIDTH + 1), h.dtype)
    plain = dc[:, :, :WIDTH]
    np.divide((dh @ w["o"].T).reshape(c.shape), total, out=plain)
    np.negative(_sums(plain * c), out=dc[:, :, WIDTH:])
    across = np.ones((len(x), WIDTH + 1, WINDOW), h.dtype)
    across[:, :WIDTH] = v.transpose(0, 2, 1)
    ds = dc @ across
    ds *= a
    dqkv = np.empty((*x.shape, 3 * WIDTH), h.dtype)
    np.matmul(ds, k, out=dqkv[:, :, :WIDTH])
    np.matmul(ds.transpose(0, 2, 1), q, out=dqkv[:, :, WIDTH : 2 * WIDTH])
    np.matmul(a.transpose(0, 2, 1), plain, out=dqkv[:, :, 2 * WIDTH :])
    dqkv = dqkv.reshape(-1, 3 * WIDTH)
    g["qkv"] = flat(e).T @ dqkv
    g["qkv"][:, :WIDTH] *= h.dtype.type(WIDTH**-0.5)
    de = dh
    de += dqkv @ np.ascontiguousarray(projections(w).T)
    g["p"] = de.reshape(e.shape).sum(axis=0)
    tokens = x.ravel().astype(np.uint16)
    order = tokens.argsort(kind="stable")
    tokens = tokens.take(order)
    new = np.ones(len(tokens), bool)
    np.not_equal(tokens[1:], tokens[:-1], out=new[1:])
    begin = new.nonzero()[0]
    g["e"] = [(tokens.take(begin).astype(np.int64), np.add.reduceat(de.take(order, axis=0), begin, axis=0))]
    return g


def gradients(w: dict[str, np.ndarray], x, y, used, ranks=None, vocabulary: Vocabulary | None = None) -> dict[str, np.ndarray]:
    """Gradients of the mean loss over the positions in ``used``; without ``ranks`` the loss of the classes ``y`` only."""
    g = _gradients(w, x, y, used, ranks, vocabulary)
    g["q"], g["k"], g["v"] = np.split(g.pop("qkv"), 3, axis=1)
    cb = g.pop("cb")
    g["c"], g["b"] = cb[:-1], cb[-1]
    for name in ("e", "m"):
        parts, g[name] = g[name], np.zeros_like(w[name])
        for rows, values in parts:
            g[name][rows] = values
    return g


def _adam(w: dict[str, np.ndarray], vocabulary: Vocabulary, batches: Iterator[tuple], rate: float) -> int:
    """Trains ``w`` in place; returns how many windows it has seen. Vectors of tokens move in steps that concern them."""
    # All weights are parts of one table of vectors.
    parts = {"e": w["e"], "m": w["m"], "cb": np.concatenate([w["c"], w["b"][None]])}
    parts |= {"o": w["o"], "p": w["p"], "qkv": np.concatenate([w["q"], w["k"], w["v"]], axis=1)}
    moving = np.concatenate([z.reshape(-1, WIDTH) for z in parts.values()])
    ends = np.cumsum([z.size // WIDTH for z in parts.values()])
    first = dict(zip(parts, [0, *ends.tolist()], strict=False))
    parts = {k: z.reshape(parts[k].shape) for k, z in zip(parts, np.split(moving, ends[:-1]), strict=True)}
    w["q"], w["k"], w["v"] = np.split(parts.pop("qkv"), 3, axis=1)
    cb = parts.pop("cb")
    w |= parts | {"c": cb[:-1], "b": cb[-1]}
    always = np.arange(first["cb"], len(moving))
    m, s = np.zeros_like(moving), np.zeros_like(moving)
    seen = 0
    for step, (x, y, used, ranks) in enumerate(batches, 1):
        seen += len(x)
        scale, spread = np.float32(rate / (1 - 0.9**step)), np.float32(1 / (1 - 0.98**step))
        g = _gradients(w, x, y, used, ranks, vocabulary)
        rows, values = [always], [g[k].reshape(-1, WIDTH) for k in ("cb", "o", "p", "qkv")]
        moved = []
        for k in ("e", "m"):
            for at, part in g[k]:
                if isinstance(at, slice):
                    moved.append((slice(first[k] + at.start, first[k] + at.stop), part))
                else:
                    rows.append(at + first[k])
                    values.append(part)
        for at, part in [(np.concatenate(rows), np.concatenate(values)), *moved]:
            mean, square = (z[at].copy() if isinstance(at, slice) else z.take(at, axis=0) for z in (m, s))
            mean += np.float32(0.1) * (part - mean)
            part *= part
            part -= square
            part *= np.float32(0.02)
            square += part
            _put(m, at, mean)
            _put(s, at, square)
            square *= spread
            np.sqrt(square, out=square)
            square += np.float32(1e-8)
            mean *= scale
            mean /= square
            _put(moving, at, (moving[at] if isinstance(at, slice) else moving.take(at, axis=0)) - mean)
    return seen


_FIRST = VOCABULARY  # input before the first token
#: Entries of a matrix of places and members.
_ENTRIES = 1 << 18
_SCORED_AT_ONCE = 64


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows over documents laid end to end: document, first token, and from which place on it scores.

    The first window scores all its places, each later one only those that no earlier window has scored, so
    each token is scored once, with at least WINDOW - STRIDE tokens before it.
    """
    n = 1 + np.maximum(0, -(-(lengths - WINDOW) // STRIDE))
    owner = np.repeat(np.arange(len(lengths)), n)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    return owner, place * STRIDE, np.where(place == 0, 0, WINDOW - STRIDE)


def gathered(vocabulary: Vocabulary, tokens: np.ndarray, lengths: np.ndarray, placed, chosen=slice(None)) -> tuple[np.ndarray, ...]:
    """Inputs, targets, scored places and document of the chosen windows; targets are token ids."""
    owner, start, least = (z[chosen] for z in placed)
    first = (np.cumsum(lengths) - lengths)[owner]
    place = start[:, None] + np.arange(WINDOW)
    inside = place < lengths[owner][:, None]
    at = np.where(inside, first[:, None] + place, 0)
    y = np.take(tokens, at)
    x = np.take(vocabulary.inputs, np.take(tokens, at - 1, mode="clip"))
    x[place == 0] = _FIRST
    return x, y, inside & (np.arange(WINDOW) >= least[:, None]), owner


def score_tokens(w: dict[str, np.ndarray], vocabulary: Vocabulary, tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 probability of each document of ``lengths`` tokens."""
    total = np.zeros(len(lengths))
    placed = windows(lengths)
    # First windows score all their places, the others none before the same one.
    for least in (0, WINDOW - STRIDE):
        chosen = np.flatnonzero(placed[2] == least)
        for first in range(0, len(chosen), 768):
            # Members are told apart for many windows at once.
            kept = []
            x, y, used, owner = gathered(vocabulary, tokens, lengths, placed, chosen[first : first + 768])
            y, used = y[:, least:], used[:, least:]
            classes = np.take(vocabulary.classes, y)
            for at in range(0, len(x), _SCORED_AT_ONCE):
                h = hidden_states(w, x[at : at + _SCORED_AT_ONCE], least)[-1]
                # One small product for each window is faster than a large one.
                logits = h @ w["c"]
                logits += w["b"]
                logits = logits.reshape(-1, CLASSES)
                own = logits.reshape(-1).take(np.arange(0, logits.size, CLASSES) + classes[at : at + _SCORED_AT_ONCE].ravel())
                own -= normalised(logits)
                places = np.flatnonzero(used[at : at + _SCORED_AT_ONCE])
                kept.append((h.reshape(-1, WIDTH).take(places, axis=0), own.take(places)))
            hidden, own = (np.concatenate(z) for z in zip(*kept, strict=True))
            owner, classes, ranks = np.repeat(owner, used.sum(axis=1)), classes[used], np.take(vocabulary.inputs, y[used])
            for places, start, end in by_class(vocabulary, classes, np.True_):
                most = max(1, _ENTRIES // (end - start))
                for k in range(0, len(places), most):
                    at = places[k : k + most]
                    logits = _member_logits(w, vocabulary, hidden.take(at, axis=0), start, end)
                    own[at] += logits[np.arange(len(at)), ranks[at] - start]
                    own[at] -= normalised(logits)
            total += np.bincount(owner, own, len(lengths)) * np.log10(np.e)
    return total


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of training documents with counts; the empty word stands for the end of a text."""
    counts: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        columns = [pa.array(list(counts.keys()), pa.binary()), pa.array(list(counts.values()), pa.int64())]
        counts.clear()
        return pa.RecordBatch.from_arrays(columns, names=["word", "n"])

    for doc, text in rows_of(batches, "doc_id", "text"):
        if not held_out(doc):
            counts.update(words_of(text))
            counts[b""] += 1
            if len(counts) > 400_000:
                yield out()
    if counts:
        yield out()


def _token_counts(ranks: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords, total = Subwords(ranks), np.zeros(VOCABULARY, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                n = dict(rows_of([batch.slice(at, 256)], "word", "n"))
                total[END] += n.pop(b"", 0)
                if n:
                    ids, word = subwords.words(n.keys())
                    np.add.at(total, ids, np.fromiter(n.values(), np.int64, len(n))[word])
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids])], names=["token", "n"])

    return run


def _token_ids(ranks: dict[bytes, int] | None, batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Ids of training documents: of rows (ids) without ``ranks``, else of rows (doc_id, text) of any documents."""
    if ranks is None:
        yield from (np.frombuffer(ids, "<u2") for (ids,) in rows_of(batches, "ids"))
    else:
        subwords = Subwords(ranks)
        yield from (subwords.text(words_of(text)) for doc, text in rows_of(batches, "doc_id", "text") if not held_out(doc))


def _steps(ranks: dict[bytes, int] | None, vocabulary: Vocabulary, every: int, batches: Iterator[pa.RecordBatch]):
    """Inputs, targets and scored places of the windows of training documents, ``BATCH`` windows at a time."""
    kept = []
    for tokens in _token_ids(ranks, batches):
        lengths = np.asarray([len(tokens)])
        # Windows at a fixed distance through the whole text, from a start that depends on the text.
        first = zlib.crc32(tokens.tobytes()) % every
        placed = windows(lengths)
        n = len(placed[0])
        chosen = np.arange(first % n if n < every else first, n, every)
        for at in range(0, len(chosen), 4 * BATCH):
            kept.append(gathered(vocabulary, tokens, lengths, placed, chosen[at : at + 4 * BATCH])[:3])
            if sum(len(z[0]) for z in kept) >= BATCH:
                x, y, used = (np.concatenate(z) for z in zip(*kept, strict=True))
                whole = len(x) - len(x) % BATCH
                for k in range(0, whole, BATCH):
                    yield x[k : k + BATCH], y[k : k + BATCH], used[k : k + BATCH]
                kept = [(x[whole:], y[whole:], used[whole:])] if whole < len(x) else []
    if kept:
        yield tuple(np.concatenate(z) for z in zip(*kept, strict=True))


_CHUNK = 1024


def _flat(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def _shaped(like: dict[str, np.ndarray], flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


_TRAINED = "chunk int, seen bigint, values binary"


def _training(vocabulary: Vocabulary, every: int, weights: dict[str, np.ndarray], rate: float):
    schema = pa.schema([("chunk", pa.int32()), ("seen", pa.int64()), ("values", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {k: v.copy() for k, v in weights.items()}
        steps = _steps(None, vocabulary, every, batches)
        seen = _adam(own, vocabulary, ((x, np.take(vocabulary.classes, y), used, np.take(vocabulary.inputs, y)) for x, y, used in steps), rate)
        if seen:
            flat, before, out = _flat(own), _flat(weights), Batches(schema)
            for k, at in enumerate(range(0, len(flat), _CHUNK)):
                part = flat[at : at + _CHUNK]
                if (part != before[at : at + _CHUNK]).any():
                    yield from out.add((k, seen, part.tobytes()), 4 * _CHUNK)
            yield from out.end()

    return run


def _averaged(frame: pd.DataFrame) -> pd.DataFrame:
    values = np.stack([np.frombuffer(v, np.float32) for v in frame["values"]])
    mean = np.average(values.astype(float), axis=0, weights=frame["seen"].to_numpy(float))
    return pd.DataFrame({"chunk": frame["chunk"].iloc[:1], "values": [mean.astype(np.float32).tobytes()]})


def by_eights(vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Members of classes of several, with eight places side by side: first place of each class and the end, place by rank (-1: alone)."""
    sizes = np.diff(vocabulary.first)
    sizes[: CLASSES - TAILS] = 0
    first = np.concatenate([[0], np.cumsum(-(-sizes // 8) * 8)])
    rank = np.arange(len(vocabulary.start))
    member = np.searchsorted(vocabulary.first, rank, "right") - 1
    return first, np.where(member < CLASSES - TAILS, -1, first[member] + rank - vocabulary.first[member])


class Kernel:
    """The steps of training and scores in the executors' JVM; the weights are one table, as AttentionLm.java has them."""

    def __init__(self, java, vocabulary: Vocabulary):
        self.java, self.vocabulary = java, vocabulary
        self.first, place = by_eights(vocabulary)
        self.tail = np.flatnonzero(place >= 0)
        self.at = place[self.tail] // 8, slice(None), place[self.tail] % 8
        start = np.full(self.first[-1], _NOTHING)
        start[place[self.tail]] = vocabulary.start[self.tail]
        numbers = (vocabulary.inputs, vocabulary.classes, place[vocabulary.inputs], self.first)
        self.fixed = [z.astype("<i4").tobytes() for z in numbers] + [start.astype("<f4").tobytes()]

    def table(self, w: dict[str, np.ndarray]) -> np.ndarray:
        members = np.zeros((self.first[-1] // 8, WIDTH, 8), np.float32)
        members[self.at] = w["m"][self.tail]
        qkv = np.concatenate([w["q"], w["k"], w["v"]], axis=1)
        return np.concatenate([z.ravel() for z in (w["e"], members, w["c"], w["b"], w["o"], w["p"], qkv)])

    def weights(self, like: dict[str, np.ndarray], table: np.ndarray) -> dict[str, np.ndarray]:
        sizes = (like["e"].size, self.first[-1] * WIDTH, *(like[k].size for k in "cbop"))
        e, members, *cbop, qkv = np.split(table, np.cumsum(sizes))
        out = {"e": e.reshape(like["e"].shape), "m": like["m"].copy()}
        out["m"][self.tail] = members.reshape(-1, WIDTH, 8)[self.at]
        out |= {k: z.reshape(like[k].shape) for k, z in zip("cbop", cbop, strict=True)}
        out["q"], out["k"], out["v"] = np.split(qkv.reshape(WIDTH, 3 * WIDTH), 3, axis=1)
        return out

    def _of(self, w: dict[str, np.ndarray]):
        return self.java.new(*self.fixed, self.table(w).astype("<f4").tobytes())

    def trained(self, documents: DataFrame, w: dict[str, np.ndarray], every: int, rate: float) -> DataFrame:
        return self.java.rows(documents.select("ids"), self._of(w).training(rate, every), _TRAINED)

    def scored(self, documents: DataFrame, w: dict[str, np.ndarray]) -> DataFrame:
        return self.java.rows(documents.select("row", "ids"), self._of(w).scoring(), _SCORED)


def kernel(spark: SparkSession, vocabulary: Vocabulary) -> Kernel | None:
    """None where only numpy can do it."""
    java = loaded(spark, "AttentionLm")
    return Kernel(java, vocabulary) if java is not None else None


def round_of(rounds: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds))


def of_round(source: DataFrame, turn: int, rounds: int) -> DataFrame:
    """The documents of one round, which may be in a column ``turn`` already; each belongs to exactly one."""
    return source.where((F.col("turn") if "turn" in source.columns else round_of(rounds)) == turn)


def train(
    encoded: DataFrame, vocabulary: Vocabulary, every: int = EVERY, rounds: int = ROUNDS, rate: float = RATE, java: Kernel | None = None
) -> dict[str, np.ndarray]:
    """Weights after rounds of parallel training.

    In each round every task trains from the same weights on the ids of its part of the round's documents;
    the weights, cut into chunks, are then averaged by the number of windows over the tasks that changed them.
    Only the average reaches the driver.
    """
    weights = start_weights(vocabulary)
    for turn in range(rounds):
        documents = of_round(encoded, turn, rounds).where(~F.col("held_out")).select("ids")
        if java is not None:
            trained = java.trained(documents, weights, every, rate / (1 + turn))
        else:
            trained = documents.mapInArrow(_training(vocabulary, every, weights, rate / (1 + turn)), _TRAINED)
        mean = trained.groupBy("chunk").applyInPandas(_averaged, "chunk int, values binary").collect()
        flat = java.table(weights) if java is not None else _flat(weights)
        for r in mean:
            flat[r.chunk * _CHUNK : (r.chunk + 1) * _CHUNK] = np.frombuffer(r["values"], np.float32)
        weights = java.weights(weights, flat) if java is not None else _shaped(weights, flat)
    return weights


_ENCODED = (
    "row bigint, doc_id bigint, held_out boolean, turn int, n_tokens bigint, n_known bigint, logs double, ids binary, "
    "rare array<binary>, times array<int>"
)


def _encoding(ranks: dict[bytes, int], frequent):
    """Ids of each row's tokens, and the counts of its words as far as ``frequent`` has them; other words with how often they come."""
    fields = [("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("turn", pa.int32()), ("n_tokens", pa.int64())]
    fields += [("n_known", pa.int64()), ("logs", pa.float64()), ("ids", pa.binary())]
    schema = pa.schema([*fields, ("rare", pa.list_(pa.binary())), ("times", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords, known, out = Subwords(ranks), frequent.value, Batches(schema, 4000, 4_000_000)
        end = known.get(b"", 0.0)  # the most frequent token of all, unless nothing was learned
        row = TaskContext.get().partitionId() << 40
        for doc, text, turn in rows_of(batches, "doc_id", "text", "turn"):
            words = words_of(text)
            logs = np.fromiter(map(known.get, words, repeat(np.nan)), float, len(words))
            new = np.isnan(logs)
            rare = Counter([words[i] for i in np.flatnonzero(new).tolist()])
            n_known = len(words) - int(new.sum()) + (b"" in known)
            ids = subwords.text(words).tobytes()
            row += 1
            yield from out.add(
                (row, doc, held_out(doc), turn, len(words) + 1, n_known, float(logs[~new].sum()) + end, ids, list(rare), list(rare.values())),
                len(ids) + 16 * len(rare),
            )
        yield from out.end()

    return run


_SCORED = "row bigint, score double"


def _scoring(weights: dict[str, np.ndarray], vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[int] = []
        kept: list[np.ndarray] = []

        def scored() -> pa.RecordBatch:
            found = score_tokens(weights, vocabulary, np.concatenate(kept), np.asarray([len(t) for t in kept]))
            out = pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(found)], names=["row", "score"])
            rows.clear()
            kept.clear()
            return out

        held = 0
        for row, ids in rows_of(batches, "row", "ids"):
            rows.append(row)
            kept.append(np.frombuffer(ids, "<u2"))
            held += len(kept[-1])
            if held >= 50_000:
                yield scored()
                held = 0
        if rows:
            yield scored()

    return run


def scores(
    docs: DataFrame, tokenizer: str = TOKENIZER, every: int = EVERY, rounds: int = ROUNDS, frequent: int = FREQUENT
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of ``docs`` (doc_id BIGINT, text STRING).

    Counts of all words of all training documents give the base score: words that make up at least one in
    ``frequent`` tokens, of which there are at most ``frequent``, are looked up in the task, all others
    are joined to the whole table of counts. The model reads the subwords of the lower-cased words and predicts
    the next one: its class, and which member of the class it is, both from the hidden state.
    It is trained on every ``every``-th window of each training document, by default on all. Null texts are empty and
    score their end only; null ids count as an empty id; repeated rows are scored repeatedly; without training
    documents all counts are 0.
    """
    spark = docs.sparkSession
    ranks = read_ranks(tokenizer)
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    counts = source.mapInArrow(_word_counts, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counts = written(counts, "word-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    size, distinct = total.n, total.v

    tokens = np.zeros(VOCABULARY)
    for r in counts.mapInArrow(_token_counts(ranks), "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).collect():
        tokens[r.token] = r.n
    vocabulary = Vocabulary.of(tokens)

    often = counts.where((F.col("n") * frequent >= size) | (F.col("word") == b"")).collect()
    known = spark.sparkContext.broadcast({bytes(r.word): float(np.log10(r.n + 1)) for r in often})
    # Every text is encoded once; rounds and scores read the ids.
    turns = source.withColumn("turn", round_of(rounds).cast("int"))
    encoded = written(turns.mapInArrow(_encoding(ranks, known), _ENCODED), "encoded")
    java = kernel(spark, vocabulary)
    weights = train(encoded, vocabulary, every, rounds, java=java)
    if java is not None:
        scored = java.scored(encoded, weights)
    else:
        scored = encoded.select("row", "ids").mapInArrow(_scoring(weights, vocabulary), _SCORED)
    scored = written(scored, "scored")

    rare = encoded.select("row", F.explode(F.arrays_zip("rare", "times")).alias("z")).select("row", F.col("z.rare").alias("word"), "z.times")
    rare = rare.join(counts, "word").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"), F.sum("times").alias("found")
    )
    all_ = F.log10(F.lit(float(size + distinct + 1)))
    return encoded.drop("ids", "rare", "times").join(scored, "row").join(rare, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(size).cast("bigint").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * all_).alias("base_score"),
        "score",
    )
