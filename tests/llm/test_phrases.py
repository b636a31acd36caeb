import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quorumlens.llm import phrases
from tests.conftest import rows

KINDS = "doc_id bigint, text string, lang string"
NAMES = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(documents, least, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang in documents:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    several = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    longer = Counter()
    for (lang, w), a in several.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longer[lang, w[i : i + k]] = max(longer[lang, w[i : i + k]], a)
    best = {}
    for (lang, w), a in several.items():
        if 100 * longer[lang, w] >= 80 * a:
            continue
        cuts = [(2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
        score, _, l, r = min(cuts)
        best.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted(
        ((lang, rank, p.decode(), -a, l, r, n[lang], -s) for lang, found in best.items() for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)),
        key=lambda x: tuple(map(str, x)),
    )


def corpus(n, seed=1):
    rnd = random.Random(seed)
    words = [rnd.choice(["Ab", "é", "日", "x'y", "\x1c", "Q#", "w"]) + str(i) for i in range(12)]
    out = []
    for i in range(n):
        text = "".join(rnd.choice(words[: rnd.randint(2, 12)]) + rnd.choice([" ", " ", " ", "\t ", ", ", ".", "\n", "\x0b"]) for _ in range(rnd.randint(0, 40)))
        out.append((i, text, rnd.choice(["en", "en", "de", None])))
    return out


@pytest.mark.parametrize("options", [{}, {"sample": 1}, {"sample": 50, "lowered": 5.0}, {"bits": 64}])
def test_equals_the_definition_whatever_the_sample_proposes(spark, options):
    documents = [*corpus(250), (250, None, "en"), (251, "", None), (252, "ab cd ef " * 3000, "fr"), (0, *corpus(1)[0][1:])]
    df = spark.createDataFrame(documents, KINDS).repartition(3)
    assert rows(phrases.collocations(df, least=6, **options).select(*NAMES)) == brute(documents, 6)


def test_blocks_add_up():
    documents, whole, parts = corpus(200, seed=2), Counter(), Counter()
    for most, into in ((10**9, whole), (50, parts)):
        block = phrases._Block()
        for i, (_, text, lang) in enumerate(documents):
            block.add(lang or "und", (text or "").encode())
            if block.size > most or i == len(documents) - 1:
                for batch in block.counts([phrases._Test(1)], 64):
                    for r in batch.to_pylist():
                        into[r["lang"], r["phrase"]] += r["n"]
                block = phrases._Block()
    assert whole == parts and sum(whole.values()) > 1000


def test_a_sample_without_documents_is_mended_by_expansion_passes(spark):
    documents = corpus(120, seed=3)
    df = spark.createDataFrame(documents, KINDS)
    nothing = phrases.collocations(df, least=5, sample=1_000_000, lowered=1e6)
    assert rows(nothing.select(*NAMES)) == brute(documents, 5)


def test_top_ranks_ties_and_clashing_columns(spark):
    documents = [(i, "b a. a c. c b. d e", "en") for i in range(6)]
    df = spark.createDataFrame(documents, KINDS).withColumns({"n": F.lit(1), "phrase": F.lit("x"), "doc": F.lit(2)})
    got = phrases.collocations(df, least=6, top=2)
    assert rows(got.select(*NAMES)) == brute(documents, 6, top=2)
    assert phrases.collocations(df.limit(0), least=6).collect() == []


def test_counts_beyond_64_bits_in_products(spark):
    big = 9_000_000_000_000_000
    expr = f"(CAST(2000000 AS DECIMAL(10,0)) * CAST({big} AS DECIMAL(20,0))) div (CAST({big} AS DECIMAL(20,0)) + CAST(7 AS DECIMAL(20,0)))"
    assert spark.range(1).select(F.expr(expr)).first()[0] == 2_000_000 * big // (big + 7)


def test_packed_hashes_keep_every_key_and_count():
    rng = np.random.default_rng(1)
    last = (1 << phrases._KEY_BITS) - 1
    keys = np.concatenate([rng.integers(0, last, 5000, np.uint64), np.array([0, 0, 1, last, last], np.uint64)])
    got = Counter()
    for part in (keys[:3000], keys[3000:], keys[4990:]):
        for batch in phrases._sent(*phrases._merged(phrases._packed(part, 30), 30)):
            for r in batch.to_pylist():
                packed = phrases._received(r["range"], [r["n"]], [r["packed"]])
                found, n = phrases._merged(packed, 30)
                assert len(found) == len(packed) and (found >> phrases._REST == r["range"]).all()
                got.update(dict(zip(found.tolist(), n.tolist(), strict=True)))
    assert got == Counter(np.concatenate([keys, keys[4990:]]).tolist())
    many = phrases._merged(np.concatenate([phrases._packed(np.zeros(40, np.uint64), 30)] * 3), 30)
    assert [z.tolist() for z in many] == [[0], [30]]


@pytest.mark.parametrize("kept, block", [(4_000_000, 400_000), (50, 60)])
def test_spellings_of_infrequent_words_and_pairs_stay_in_their_tasks(spark, monkeypatch, kept, block):
    """Exact counts are taken of what the hashes leave over, which is all that is frequent and hardly more."""
    monkeypatch.setattr(phrases, "_KEPT", kept)
    monkeypatch.setattr(phrases, "_BLOCK", block)
    monkeypatch.setattr(phrases, "_REMEMBERED", 5)
    least, words, pairs, totals = 6, Counter(), Counter(), Counter()
    documents = [*corpus(200, seed=4), (200, "rare" + " word".join(map(str, range(500))), "en"), (201, "", "xx")]
    for _, text, lang in documents:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text.lower()):
            found = re.findall(r"[^\x20\x09]+", piece)
            words.update((lang or "und", w) for w in found)
            pairs.update((lang or "und", f"{a} {b}") for a, b in zip(found, found[1:]))
            totals[lang or "und"] += len(found)
    texts = pa.RecordBatch.from_pylist([{"lang": lang or "und", "text": text.encode()} for _, text, lang in documents])
    sent = pa.Table.from_batches(phrases._tallying(least)(iter([texts.slice(0, 90), texts.slice(90)])))
    ranges = {(r, lang): sent.filter((pa.compute.equal(sent["range"], r)) if lang is None else pa.compute.equal(sent["lang"], lang)) for r, lang in zip(sent["range"].to_pylist(), sent["lang"].to_pylist())}
    added = [r for k, t in ranges.items() for r in phrases._adding(least, phrases.BITS)(tuple(map(pa.scalar, k)), t).to_pylist()]
    assert {r["lang"]: r["total"] for r in added if r["total"]} == {k: n for k, n in totals.items() if n}

    bits = spark.createDataFrame([(r["at"], r["bit"]) for r in added if r["bit"] is not None], "at bigint, bit bigint")
    common = phrases._bitmap_of(bits, phrases.BITS)
    spelled = Counter()
    for batch in phrases._counting([phrases._Test(w, own=common) for w in (1, 2)], phrases.BITS)(iter([texts])):
        for r in batch.to_pylist():
            spelled[r["lang"], r["phrase"]] += r["n"]
    assert spelled == Counter({k: n for k, n in (words | pairs).items() if n >= least})
    assert len(spelled) > 50 and len(words | pairs) > 2 * len(spelled)


def test_texts_without_words(spark):
    documents = spark.createDataFrame([(1, "", "en"), (2, None, None), (3, " . \n", "de")], KINDS).repartition(2)
    assert phrases.collocations(documents, least=1).collect() == []
