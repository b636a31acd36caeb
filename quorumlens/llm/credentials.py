"""Secrets in texts: fixed formats, and formats inferred as probabilistic automata from labelled credentials."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlens.llm.common import Batches, rows_of
from quorumlens.session import discard, written

#: Base kinds in the order in which equal starts are listed, then the kind of inferred formats.
KINDS = ("assign", "access", "hex", "format")
_ASSIGN = re.compile(
    r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII
)
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: A run is maximal, so one of enough characters is all that a shorter pattern would find and keep.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: Maximal runs of credential characters; full stops count inside only, as one may end a sentence.
_RUN = re.compile(r"[A-Za-z0-9+/_=-]+(?:\.[A-Za-z0-9+/_=-]+)*")

#: Labelled credentials of each kind that automata are fitted on, those with the smallest hashes.
MOST_LABELLED = 500
#: Fewer labelled credentials of a kind give no automaton.
LEAST_LABELLED = 20
#: Confidence of the Hoeffding test that keeps two states apart.
ALPHA = 0.05
#: Bits by which a format must be likelier than the runs of all documents.
LEAST_BITS = 24.0
#: Count that a symbol unseen in a state of an automaton gets; it leaves the state as it is.
UNSEEN = 0.5
#: Scores of runs that a task remembers.
REMEMBERED = 200_000

#: Symbols: digit, a-f, g-z, A-F, G-Z, and each sign by itself.
_CLASSES = {"d": "0123456789", "h": "abcdef", "l": "ghijklmnopqrstuvwxyz", "H": "ABCDEF", "U": "GHIJKLMNOPQRSTUVWXYZ"}
_SYMBOL = {c: k for k, chars in _CLASSES.items() for c in chars} | {c: c for c in "+/_.=-"}
_SHARE = {k: -math.log2(len(v)) for k, v in _CLASSES.items()} | {c: 0.0 for c in "+/_.=-"}
_SYMBOLS = "".join(_SHARE)


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, credential) of the fixed formats, leftmost and without overlap within a kind."""
    found = []
    lower = text.lower()
    if any(k in lower for k in _KEYWORDS):
        found += [("assign", m.start(), m.end(), m[1]) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text)]
    if any(len(w) >= 20 for w in text.split()):
        found += [("hex", m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    return found


def candidates(text: str, spans: Iterable[tuple[str, int, int, str]], least: int) -> Iterator[tuple[int, int, str]]:
    """Runs of credential characters of ``least`` or more, what base spans cover cut out of them."""
    taken = sorted((a, b) for _, a, b, _ in spans)
    k = 0
    for m in _RUN.finditer(text):
        start, end = m.span()
        if end - start < least:
            continue
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if k == len(taken) or taken[k][0] >= end:
            yield start, end, m[0]
            continue
        for a, b in [*(t for t in taken[k:] if t[0] < end), (end, end)]:
            # A full stop at a cut belongs to no part, as at the end of a run.
            part = text[start:a].strip(".")
            if len(part) >= least:
                at = text.index(part, start)
                yield at, at + len(part), part
            start = max(start, b)


class Automaton:
    """Deterministic stochastic automaton by state merging (red-blue order) on symbol strings."""

    def __init__(self, samples: Iterable[str], alpha: float = ALPHA):
        self.count, self.final = [0], [0]
        self.next: list[dict[str, list[int]]] = [{}]  # symbol -> [state, how often]
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        for s in samples:
            self._insert(s)
        self._merge_all()
        missing = [len(_SYMBOLS) - len(n) + (f == 0) for n, f in zip(self.next, self.final, strict=True)]
        self.total = [c + UNSEEN * m for c, m in zip(self.count, missing, strict=True)]
        scores = sorted(self.rate(s) for s in samples)
        self.least = scores[len(scores) // 100] - 0.5 if scores else 0.0

    def _insert(self, sample: str) -> None:
        state = 0
        self.count[0] += 1
        for c in sample:
            edge = self.next[state].get(_SYMBOL[c])
            if edge is None:
                edge = self.next[state][_SYMBOL[c]] = [len(self.count), 0]
                self.count.append(0)
                self.final.append(0)
                self.next.append({})
            edge[1] += 1
            state = edge[0]
            self.count[state] += 1
        self.final[state] += 1

    def _differ(self, f: int, n: int, g: int, m: int) -> bool:
        return bool(n and m) and abs(f / n - g / m) > self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if self._differ(self.final[a], self.count[a], self.final[b], self.count[b]):
                return False
            for c in self.next[a].keys() | self.next[b].keys():
                x, y = self.next[a].get(c), self.next[b].get(c)
                if self._differ(x[1] if x else 0, self.count[a], y[1] if y else 0, self.count[b]):
                    return False
                if x and y and x[0] != y[0]:
                    todo.append((x[0], y[0]))
        return True

    def _fold(self, red: int, blue: int) -> None:
        """Add the tree below ``blue`` to ``red``."""
        todo = [(red, blue)]
        while todo:
            a, b = todo.pop()
            self.count[a] += self.count[b]
            self.final[a] += self.final[b]
            for c, (y, n) in self.next[b].items():
                edge = self.next[a].get(c)
                if edge is None:
                    self.next[a][c] = [y, n]
                else:
                    edge[1] += n
                    todo.append((edge[0], y))

    def _merge_all(self) -> None:
        red = [0]
        known = {0}
        while True:
            blue = next(((r, c) for r in red for c in sorted(self.next[r]) if self.next[r][c][0] not in known), None)
            if blue is None:
                return
            r, c = blue
            b = self.next[r][c][0]
            target = next((x for x in red if self._compatible(x, b)), None)
            if target is None:
                red.append(b)
                known.add(b)
            else:
                self.next[r][c][0] = target
                self._fold(target, b)

    def bits(self, text: str) -> float:
        """log2 of the probability of a text; symbols that a state has not seen share :data:`UNSEEN` each."""
        state, total = 0, 0.0
        for c in text:
            symbol = _SYMBOL[c]
            edge = self.next[state].get(symbol)
            total += math.log2((edge[1] if edge else UNSEEN) / self.total[state]) + _SHARE[symbol]
            if edge:
                state = edge[0]
        return total + math.log2(max(self.final[state], UNSEEN) / self.total[state])

    def rate(self, text: str) -> float:
        """Bits a character."""
        return self.bits(text) / max(1, len(text))


class Background:
    """Runs of all documents: each symbol given the one before it, from counts of all neighbours."""

    def __init__(self, counts: np.ndarray):
        rates = np.log2((counts + 1.0) / (counts + 1.0).sum(axis=1, keepdims=True))
        self.rates = rates.tolist()
        self.index = {c: _SYMBOLS.index(k) for c, k in _SYMBOL.items()}
        self.share = [_SHARE[k] for k in _SYMBOLS]

    def bits(self, text: str) -> float:
        total, last = 0.0, _OUTSIDE
        for c in text:
            now = self.index[c]
            total += self.rates[last][now] + self.share[now]
            last = now
        return total + self.rates[last][_OUTSIDE]


#: What is no credential character: the place before and after a run.
_OUTSIDE = len(_SYMBOLS)
_PLACE = np.full(256, _OUTSIDE, np.uint16)
for _c, _k in _SYMBOL.items():
    _PLACE[ord(_c)] = _SYMBOLS.index(_k)
_COUNTS = pa.schema([("pair", pa.int32()), ("n", pa.int64())])


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each symbol follows each other one, over whole texts."""
    wide = _OUTSIDE + 1
    total = np.zeros(wide * wide, np.int64)
    for (text,) in rows_of(batches, "text"):
        places = _PLACE[np.frombuffer(b" " + (text or b"") + b" ", np.uint8)]
        total += np.bincount(places[:-1] * wide + places[1:], minlength=len(total))
    yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], schema=_COUNTS)


_LABELLED = pa.schema([("kind", pa.string()), ("value", pa.string())])


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind and credential of each base span."""
    out = Batches(_LABELLED)
    for (text,) in rows_of(batches, "text"):
        for kind, _, _, value in base_spans(text or ""):
            yield from out.add((kind, value), len(value))
    yield from out.end()


def _joined(spans: Iterable[tuple[str, int, int]]) -> str:
    order = sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in order)


class Likely(dict):
    """Whether a run is as likely a credential as ``least_bits`` ask for, remembered; forgets all when it holds many."""

    def __init__(self, automata: list[Automaton], background: Background, least_bits: float):
        super().__init__()
        self.automata, self.background, self.least_bits = automata, background, least_bits

    def __missing__(self, text: str) -> bool:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self._rated(text)
        if len(text) <= 64:
            self[text] = value
        return value

    def _rated(self, text: str) -> bool:
        ordinary = self.background.bits(text)
        if -ordinary < self.least_bits:
            return False  # No probability is above 1, so no automaton can be likelier by so much.
        for automaton in self.automata:
            bits = automaton.bits(text)
            if bits - ordinary >= self.least_bits and bits >= automaton.least * len(text):
                return True
        return False


_FOUND = pa.schema(
    [("doc_id", pa.int64())]
    + [(f"n_{k}", pa.int64()) for k in KINDS]
    + [("n_likely_base", pa.int64()), ("n_scored", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())]
)
_FOUND_SQL = (
    "doc_id bigint, " + ", ".join(f"n_{k} bigint" for k in KINDS)
    + ", n_likely_base bigint, n_scored bigint, base_sha256 string, spans string"
)


def _judging(automata: list[Automaton], background: Background, least_bits: float, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, likely = Batches(_FOUND), Likely(automata, background, least_bits)
        for doc, text in rows_of(batches, "doc_id", "text"):
            base = base_spans(text or "")
            own, added, scored = [s[:3] for s in base], [], len(base)
            for start, end, value in candidates(text or "", base, least) if automata else ():
                scored += 1
                if likely[value]:
                    added.append(("format", start, end))
            counts = [sum(k == s[0] for s in own + added) for k in KINDS]
            known = sum(likely[s[3]] for s in base)
            digest = hashlib.sha256(_joined(own).encode()).hexdigest()
            yield from out.add((doc, *counts, known, scored, digest, _joined(own + added)))
        yield from out.end()

    return run


def secrets(docs: DataFrame, most_labelled: int = MOST_LABELLED, least_bits: float = LEAST_BITS) -> DataFrame:
    """Secrets of each row of ``docs`` (doc_id BIGINT, text STRING).

    Columns: doc_id, n_assign, n_access, n_hex, n_format, n_likely_base, n_scored, base_sha256, spans, the latter as
    kind:start:end in code points. The fixed formats give the base spans and, as labelled credentials, a bounded
    sample of each kind: the ``most_labelled`` distinct ones with the smallest hashes, on which one automaton a
    kind is fitted. Then every run of credential characters of all documents is scored that is as long as the
    shortest labelled credential, whatever it is made of; a run that meets a base span is scored without it. It
    becomes a span of kind format when an automaton finds it as likely as its own samples and ``least_bits`` bits
    likelier than the neighbouring symbols of all documents make it. Base spans stay in any case; ``n_likely_base``
    of them have a credential that passes the same test, ``n_scored`` is the number of scored credentials and runs.

    Null texts are empty, repeated rows stay, and without labelled credentials there are base spans only. Two jobs
    over the texts run when this is called; the result is a third pass, and no text is shuffled or written.
    """
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    labelled = written(source.select("text").mapInArrow(_labelled, "kind string, value string").distinct(), "labelled")
    automata = []
    for kind in KINDS[:3]:
        rows = labelled.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(most_labelled).collect()
        if len(rows) >= LEAST_LABELLED:
            automata.append(Automaton([r.value for r in rows]))
    least = labelled.agg(F.min(F.length("value"))).first()[0] or 0
    discard(labelled)
    pairs = source.select(F.col("text").cast("binary").alias("text")).mapInArrow(_pair_counts, "pair int, n bigint")
    counts = np.zeros((_OUTSIDE + 1) ** 2)
    for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect():
        counts[r.pair] = r.n
    background = Background(counts.reshape(_OUTSIDE + 1, -1))
    return source.mapInArrow(_judging(automata, background, least_bits, least), _FOUND_SQL)
