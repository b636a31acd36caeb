import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quorumlens.llm import attention_lm as lm

SCHEMA = "doc_id bigint, text string, score int"


def vocabulary():
    counts = np.random.default_rng(3).integers(0, 1000, lm.VOCABULARY).astype(float)
    return lm.Vocabulary.of(counts)


def test_classes_share_their_probability():
    v = vocabulary()
    total = np.bincount(v.classes, 10.0**v.share, lm.CLASSES)
    assert np.allclose(total, 1) and np.isclose(np.exp(v.prior).sum(), 1)
    logits = lm.forward(lm.start_weights(v), np.zeros((3, lm.WINDOW), int))[0]
    assert np.allclose(np.exp(logits).sum(axis=1), 1, atol=1e-5)


def test_gradients():
    v = vocabulary()
    rng = np.random.default_rng(1)
    w = {k: a.astype(np.float64) for k, a in lm.start_weights(v).items()}
    x, y = rng.integers(0, 30, (4, lm.WINDOW)), rng.integers(0, lm.CLASSES, (4, lm.WINDOW))
    used = rng.random((4, lm.WINDOW)) < 0.7

    def loss():
        logits = lm.forward(w, x)[0]
        return -(logits[np.arange(len(logits)), y.ravel()] * used.ravel()).sum() / used.sum()

    g = lm.gradients(w, x, y, used)
    for name in w:
        for _ in range(3):
            at = (int(rng.choice(x.ravel())), 1) if name == "e" else tuple(int(rng.integers(n)) for n in w[name].shape)
            w[name][at] += 1e-4
            up = loss()
            w[name][at] -= 2e-4
            down = loss()
            w[name][at] += 1e-4
            assert g[name][at] == pytest.approx((up - down) / 2e-4, rel=2e-2, abs=2e-5)


def test_each_token_is_scored_once_with_its_context_only():
    v, rng = vocabulary(), np.random.default_rng(2)
    lengths = np.asarray([1, 2, 15, 16, 17, 28, 29, 100])
    tokens = rng.integers(0, lm.VOCABULARY, lengths.sum())
    w = lm.start_weights(v)
    x, y, used, owner = lm.gathered(v, tokens, lengths, lm.windows(lengths))
    assert np.bincount(owner, used.sum(axis=1)).tolist() == lengths.tolist()
    found = lm.score_tokens(w, v, tokens, lengths)
    first = 0
    for n, value in zip(lengths, found):
        own = tokens[first : first + n]
        first += n
        logp = 0.0
        for i in range(n):
            # The window that scores place i is the first one that reaches it.
            start = 0 if i < lm.WINDOW else lm.STRIDE * -(-(i - lm.WINDOW + 1) // lm.STRIDE)
            inputs = [lm._FIRST if j == 0 else v.inputs[own[j - 1]] for j in range(start, i + 1)]
            row = np.zeros((1, lm.WINDOW), int)
            row[0, : len(inputs)] = inputs
            logits = lm.forward(w, row)[0][len(inputs) - 1]
            logp += logits[v.classes[own[i]]] / math.log(10) + v.share[own[i]]
        assert value == pytest.approx(logp, abs=1e-3)


def test_normalised_far_apart():
    logits = np.zeros((2, lm.CLASSES))
    logits[0] -= 500
    logits[1, 0] = 700
    assert np.allclose(lm.normalised(logits.copy()), [-500 + math.log(lm.CLASSES), 700])


def brute(rows):
    counts = Counter()
    out = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
    for doc, text, *_ in rows:
        if not out(doc):
            counts.update((text or "").encode().lower().split() + [None])
    n, v = sum(counts.values()), len(counts)
    found = []
    for doc, text, *_ in rows:
        tokens = (text or "").encode().lower().split() + [None]
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens)
        found.append((str(doc), out(doc), len(tokens), sum(counts[t] > 0 for t in tokens), n, round(base, 6)))
    return sorted(found)


def corpus():
    rnd = random.Random(5)
    words = ["".join(rnd.choice(["th", "er", "ing", "on", "ti", "re"]) for _ in range(rnd.randint(1, 3))) for _ in range(300)]
    return [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 200))), 0) for i in range(150)]


@pytest.mark.parametrize("frequent", [200_000, 30])
def test_scores(spark, frequent):
    rows = corpus() + [(900, None, 0), (901, "", 0), (902, "Ünseen wörds \x0b here", 0), (None, "the THE", 0), (3, "again", 0)]
    found = lm.scores(spark.createDataFrame(rows, SCHEMA), frequent=frequent).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == brute(rows)
    assert all(r.score < 0 and math.isfinite(r.score) for r in found)


def test_training_helps_on_texts_held_out(spark):
    """Against the model before training, which knows how frequent the classes are."""
    rows = [r for r in corpus() if lm.held_out(r[0])]
    scores = {r.doc_id: r.score for r in lm.scores(spark.createDataFrame(corpus(), SCHEMA), every=1).collect()}
    subwords, counts = lm.Subwords(lm.read_ranks(lm.TOKENIZER)), np.zeros(lm.VOCABULARY)
    for doc, text, _ in corpus():
        if not lm.held_out(doc):
            np.add.at(counts, subwords.text(lm.words_of(text.encode())), 1)
    v = lm.Vocabulary.of(counts)
    w = lm.start_weights(v)
    w["c"][:] = 0
    before = [lm.score_tokens(w, v, t, np.asarray([len(t)]))[0] for t in (subwords.text(lm.words_of(r[1].encode())) for r in rows)]
    assert len(rows) > 5 and sum(scores[r[0]] for r in rows) > 0.9 * sum(before)


def test_no_rows(spark):
    assert lm.scores(spark.createDataFrame([], SCHEMA)).count() == 0


def test_every_token_of_training_documents_is_learned_from_once(spark):
    """With the settings that the query uses."""
    rows = corpus() + [(900, None, 0), (None, "the THE", 0), (901, " ".join(["long text"] * 9000), 0)]
    source = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "CAST(text AS BINARY) AS text")
    ranks, v = lm.read_ranks(lm.TOKENIZER), vocabulary()
    learned, expected = np.zeros(lm.VOCABULARY, int), np.zeros(lm.VOCABULARY, int)
    for turn in range(lm.ROUNDS):
        for x, y, used in lm._steps(ranks, v, lm.EVERY, lm.of_round(source, turn, lm.ROUNDS).toArrow().to_batches()):
            assert x.shape == y.shape == used.shape and len(x) <= lm.BATCH
            np.add.at(learned, y[used.astype(bool)], 1)
    subwords = lm.Subwords(ranks)
    for doc, text, _ in rows:
        if not lm.held_out(doc):
            np.add.at(expected, subwords.text(lm.words_of((text or "").encode())), 1)
    assert expected.sum() > 10_000 and (learned == expected).all()


def test_context_tells_members_of_a_class_apart():
    """Two rare tokens of one class, each after its own token: their odds depend on the context, and gradients agree."""
    v = vocabulary()
    start, end = int(v.first[lm.CLASSES - 1]), int(v.first[lm.CLASSES])
    ids = np.argsort(v.inputs)
    a, b = int(ids[start + 5]), int(ids[end - 1])
    assert v.classes[a] == v.classes[b] and len(set(v.inputs.tolist())) == lm.VOCABULARY
    w = lm.start_weights(v)
    tokens = np.asarray([ids[3], a, ids[9], b] * 40)
    lengths = np.asarray([len(tokens)])
    x, y, used, _ = lm.gathered(v, tokens, lengths, lm.windows(lengths))
    batch = (x, v.classes[y], used, v.inputs[y])
    lm._adam(w, v, iter([batch] * 60), 0.02)
    right = lm.score_tokens(w, v, np.asarray([ids[3], a, ids[9], b]), np.asarray([4]))[0]
    wrong = lm.score_tokens(w, v, np.asarray([ids[3], b, ids[9], a]), np.asarray([4]))[0]
    assert right > wrong + 1

    w = {k: z.astype(np.float64) for k, z in w.items()}
    g = lm.gradients(w, *batch, v)

    def loss():
        logits, *_, h = lm.forward(w, x)
        own = logits[np.arange(len(logits)), v.classes[y].ravel()]
        hidden = h.reshape(-1, lm.WIDTH)
        for at, first, last in lm.by_class(v, v.classes[y].ravel(), used.ravel()):
            own[at] += lm.member_logs(w, v, hidden[at], first, last)[np.arange(len(at)), v.inputs[y].ravel()[at] - first]
        return -own[used.ravel()].sum() / used.sum()

    for name, at in (("m", (v.inputs[a], 2)), ("m", (start, 3)), ("e", (3, 1)), ("v", (2, 2)), ("o", (1, 4))):
        w[name][at] += 1e-4
        up = loss()
        w[name][at] -= 2e-4
        down = loss()
        w[name][at] += 1e-4
        assert g[name][at] == pytest.approx((up - down) / 2e-4, rel=2e-2, abs=2e-5)


def test_every_token_has_its_own_probability():
    v = vocabulary()
    w = lm.start_weights(v)
    w["m"] = np.random.default_rng(4).normal(size=w["m"].shape).astype(np.float32)
    each = [lm.score_tokens(w, v, np.asarray([t]), np.asarray([1]))[0] for t in range(0, lm.VOCABULARY, 997)]
    logits, *_, h = lm.forward(w, np.full((1, lm.WINDOW), lm._FIRST))
    full = np.concatenate([logits[0, c] + lm.member_logs(w, v, h[0, :1], v.first[c], v.first[c + 1])[0] for c in range(lm.CLASSES)])
    assert np.isclose(np.exp(full.astype(float)).sum(), 1, atol=1e-4)
    assert np.allclose(each, full[v.inputs[::997]] / math.log(10), atol=1e-3)


@pytest.mark.parametrize("far", [0.0, 300.0])
def test_small_classes_are_compared_together(monkeypatch, far):
    """As many products as groups of classes, with the gradients of each class by itself, also where logits are far apart."""
    v, rng = vocabulary(), np.random.default_rng(6)
    w = {k: a.astype(np.float64) for k, a in lm.start_weights(v).items()}
    w["m"] = rng.normal(size=w["m"].shape)
    w["m"][v.first[lm.CLASSES - lm.TAILS] :: 5, 0] += far
    rank = rng.integers(0, v.first[lm.CLASSES - lm.TAILS + lm.SMALL], (lm.BATCH, lm.WINDOW))
    y = np.argsort(v.inputs)[rank]
    x, used = rng.integers(0, 50, y.shape), np.arange(lm.WINDOW) >= np.arange(lm.BATCH)[:, None]
    products, plain = [], lm._member_logits
    monkeypatch.setattr(lm, "_member_logits", lambda *a: products.append(a) or plain(*a))
    g = lm.gradients(w, x, v.classes[y], used, rank, v)
    assert 1 < len(products) <= lm.SMALL // lm.TOGETHER
    hidden, expected = lm.attend(w, x)[-1].reshape(-1, lm.WIDTH), np.zeros_like(w["m"])
    for at, start, end in lm.by_class(v, v.classes[y].ravel(), used.ravel()):
        d = np.exp(lm.member_logs(w, v, hidden[at], start, end))
        d[np.arange(len(at)), rank.ravel()[at] - start] -= 1
        expected[start:end] = d.T @ hidden[at] / used.sum()
    assert np.abs(expected).max() > 1e-3 and np.allclose(g["m"], expected, atol=1e-9)


def test_attention_far_apart():
    """Scores of attention that no common largest value fits are as those of each row by itself."""
    v = vocabulary()
    w = {k: a.astype(np.float64) for k, a in lm.start_weights(v).items()}
    x = np.random.default_rng(7).integers(0, 500, (3, lm.WINDOW))
    w["q"] *= 8000
    e, q, k, _, a, total, c, _ = lm.hidden_states(w, x)
    logits = np.where(np.tri(lm.WINDOW) > 0, q @ k.transpose(0, 2, 1), -np.inf)
    assert logits.max() - logits[np.isfinite(logits)].min() > 80
    expected = np.exp(logits - logits.max(axis=2, keepdims=True))
    expected /= expected.sum(axis=2, keepdims=True)
    assert np.allclose(a / total, expected, atol=1e-6) and np.allclose(c, expected @ (e @ w["v"]), atol=1e-5)


def test_words_are_counted_many_at_a_time(monkeypatch):
    """With the ids of each word by itself, also where a word holds white space that is not ASCII."""
    ranks, calls, plain = lm.read_ranks(lm.TOKENIZER), [], lm.Subwords.ids
    words = [f"{a}{i}" for i in range(300) for a in ("tion", "x-", "é", "'s", "\u4e16")]
    odd = ["a\u00a0", "\u00a0", "\u2003b", "c\x85d", "e\x1cf"]

    def counted(found):
        batch = pa.RecordBatch.from_pydict({"word": pa.array([w.encode() for w in found] + [b""], pa.binary()), "n": [*range(1, len(found) + 2)]})
        (out,) = lm._token_counts(ranks)(iter([batch]))
        return dict(zip(out["token"].to_pylist(), out["n"].to_pylist()))

    def each(found):
        subwords, total = lm.Subwords(ranks), Counter({lm.END: len(found) + 1})
        for n, w in enumerate(found, 1):
            for i in plain(subwords, " " + w).tolist():
                total[i] += n
        return total

    assert counted(words + odd) == each(words + odd)
    monkeypatch.setattr(lm.Subwords, "ids", lambda self, text: calls.append(text) or plain(self, text))
    assert counted(words) == each(words) and len(calls) < len(words) / 100


@pytest.mark.parametrize("far", [1, 8000])
def test_places_that_are_context_only_have_no_hidden_state(far):
    v = vocabulary()
    w = {k: a.astype(np.float64) for k, a in lm.start_weights(v).items()}
    w["q"] *= far
    x = np.random.default_rng(8).integers(0, 500, (3, lm.WINDOW))
    least = lm.WINDOW - lm.STRIDE
    some = lm.hidden_states(w, x, least)[-1]
    short = lm.hidden_states({k: a.astype(np.float32) for k, a in w.items()}, x, least)[-1]
    assert np.allclose(some, short, atol=1e-2)
    assert some.shape == (3, lm.STRIDE, lm.WIDTH) and np.allclose(some, lm.hidden_states(w, x)[-1][:, least:])


def test_steps_are_those_of_adam():
    """Each weight moves as by its own gradient, and vectors of tokens in steps that concern them only."""
    v, rng = vocabulary(), np.random.default_rng(9)
    w = lm.start_weights(v)
    own = {k: z.astype(np.float64) for k, z in w.items()}
    m, s = ({k: np.zeros_like(z) for k, z in own.items()} for _ in range(2))
    ids = np.argsort(v.inputs)
    batches = []
    for high in (lm.VOCABULARY, 70, lm.VOCABULARY):
        y = ids[rng.integers(0, high, (lm.BATCH, lm.WINDOW))]
        x, used = rng.integers(0, high, y.shape), rng.random(y.shape) < 0.7
        batches.append((x, v.classes[y], used, v.inputs[y]))
    lm._adam(w, v, iter(batches), 0.02)
    for step, (x, classes, used, ranks) in enumerate(batches, 1):
        g = lm.gradients(own, x, classes, used, ranks, v)
        hit = np.bincount(classes[used], minlength=lm.CLASSES) * (np.arange(lm.CLASSES) >= lm.CLASSES - lm.TAILS) > 0
        rows = {"e": np.unique(x), "m": np.flatnonzero(np.repeat(hit, np.diff(v.first)))}
        for k in own:
            at = rows.get(k, slice(None))
            m[k][at] += 0.1 * (g[k][at] - m[k][at])
            s[k][at] += 0.02 * (g[k][at] ** 2 - s[k][at])
            own[k][at] -= 0.02 / (1 - 0.9**step) * m[k][at] / (np.sqrt(s[k][at] / (1 - 0.98**step)) + 1e-8)
    for k in own:
        assert (np.abs(w[k] - own[k]) > 1e-3).mean() < 1e-3, k


def encoded(spark, rows):
    """Rows as training and scores read them."""
    source = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "CAST(text AS BINARY) AS text").coalesce(2)
    turns = source.withColumn("turn", lm.round_of(lm.ROUNDS).cast("int"))
    known = spark.sparkContext.broadcast({b"the": 1.0, b"": 2.0})
    return lm.written(turns.mapInArrow(lm._encoding(lm.read_ranks(lm.TOKENIZER), known), lm._ENCODED), "encoded")


def test_texts_are_encoded_once_for_all_rounds_and_scores(spark):
    rows = corpus() + [(900, None, 0), (None, "the THE new", 0), (901, " ".join(["long text"] * 9000), 0), (902, "new the new", 0)]
    frame, v, subwords = encoded(spark, rows), vocabulary(), lm.Subwords(lm.read_ranks(lm.TOKENIZER))
    found = {r.doc_id: r for r in frame.collect()}
    assert len(found) == len(rows) == len({r.row for r in found.values()})
    learned, expected = np.zeros(lm.VOCABULARY, int), np.zeros(lm.VOCABULARY, int)
    for doc, text, _ in rows:
        words = lm.words_of((text or "").encode())
        r, ids = found[doc], subwords.text(words)
        assert bytes(r.ids) == ids.tobytes() and r.held_out == lm.held_out(doc)
        rare = Counter(w for w in words if w != b"the")
        assert Counter(dict(zip(map(bytes, r.rare), r.times, strict=True))) == rare
        assert (r.n_tokens, r.n_known, r.logs) == (len(words) + 1, len(words) - rare.total() + 1, words.count(b"the") + 2.0)
        if not r.held_out:
            np.add.at(expected, ids, 1)
    for turn in range(lm.ROUNDS):
        documents = lm.of_round(frame, turn, lm.ROUNDS).where("NOT held_out").select("ids")
        for _, y, used in lm._steps(None, v, lm.EVERY, documents.toArrow().to_batches()):
            np.add.at(learned, y[used.astype(bool)], 1)
    assert expected.sum() > 10_000 and (learned == expected).all()


@pytest.mark.parametrize("every", [1, 3])
def test_executors_train_and_score_as_numpy_does(spark, every):
    """Texts of tokens of all classes, so that large classes and windows that are not full take part."""
    v, rng = vocabulary(), np.random.default_rng(11)
    subwords, ids = lm.Subwords(lm.read_ranks(lm.TOKENIZER)), np.argsort(v.inputs)
    tokens = [subwords.encoding.decode_bytes([i]).decode(errors="replace") for i in ids[: lm.END] if i != lm.END]
    rows = [(i, "".join(rng.choice(tokens[:: 1 + i % 40], n)), 0) for i, n in enumerate([0, 1, 2, 17, 63, 64, 65, 300, 900])]
    frame = encoded(spark, rows)
    java = lm.kernel(spark, v)
    if java is None:
        pytest.skip("no compiler or no vectors in this JVM")
    own, plain = (lm.train(frame, v, every, 1, java=z) for z in (java, None))
    start = lm.start_weights(v)
    for k in start:
        # Steps of weights whose gradients are next to nothing depend on the last digits of these.
        apart = np.abs(own[k] - plain[k])
        assert own[k].shape == plain[k].shape and np.median(apart) < 1e-4 and (apart > 1e-3).mean() < 1e-2, k
        assert (plain[k] != start[k]).any()
    documents = frame.select("row", "ids").collect()
    kept = [np.frombuffer(r.ids, "<u2") for r in documents]
    expected = lm.score_tokens(plain, v, np.concatenate(kept), np.asarray([len(t) for t in kept]))
    for found in (java.scored(frame, plain), frame.select("row", "ids").mapInArrow(lm._scoring(plain, v), lm._SCORED)):
        scored = {r.row: r.score for r in found.collect()}
        assert np.allclose([scored[r.row] for r in documents], expected, rtol=1e-5)


def test_executors_score_logits_far_apart(spark):
    v, frame = vocabulary(), encoded(spark, [(1, "some words far apart, and a name: Zyxomma", 0), (2, None, 0)])
    java = lm.kernel(spark, v)
    if java is None:
        pytest.skip("no compiler or no vectors in this JVM")
    w = lm.start_weights(v)
    w["m"][::3, 0] += 300
    w["b"][::5] += 200
    w["q"] *= 8000
    assert all(np.array_equal(z, w[k]) for k, z in java.weights(w, java.table(w)).items())
    documents = frame.select("row", "ids").collect()
    kept = [np.frombuffer(r.ids, "<u2") for r in documents]
    expected = lm.score_tokens(w, v, np.concatenate(kept), np.asarray([len(t) for t in kept]))
    scored = {r.row: r.score for r in java.scored(frame, w).collect()}
    assert expected.min() < -100 and np.allclose([scored[r.row] for r in documents], expected, rtol=1e-3)
