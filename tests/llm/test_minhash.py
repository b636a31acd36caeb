import random

import pytest

from quorumlens.llm import minhash


def brute(rows, width, percent=80):
    """component_id by comparing all pairs of rows that have a doc_id and words."""
    sets = []
    for doc, text, *_ in rows:
        words = (text or "").encode().lower().split()
        whole = [tuple(words[i : i + width]) for i in range(len(words) - width + 1)] or ([tuple(words)] if words else [])
        sets.append((doc, frozenset(whole)))
    root = {doc: doc for doc, _ in sets if doc is not None}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                a_, b_ = top(a), top(b)
                root[max(a_, b_)] = min(a_, b_)
    return [(doc, len(s), None if doc is None else top(doc)) for doc, s in sets]


def corpus(seed, groups, per, edits):
    rnd = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    rows, number = [], 0
    passage = [rnd.choice(words) for _ in range(60)]
    for _ in range(groups):
        base = [rnd.choice(words) for _ in range(rnd.randint(3, 120))]
        if rnd.random() < 0.5:
            base = passage + base
        for _ in range(rnd.randint(1, per)):
            own = list(base)
            for _ in range(rnd.randint(0, edits)):
                own[rnd.randrange(len(own))] = rnd.choice(words)
            rows.append((number, " ".join(own)))
            number += 1
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("width,groups,per,edits", [(2, 60, 5, 6), (5, 60, 5, 3), (2, 2, 60, 5)])
def test_components(spark, width, groups, per, edits):
    rows = corpus(width + groups, groups, per, edits)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = minhash.near_duplicates(df, width=width)
    assert sorted(map(tuple, found.collect())) == sorted(brute(rows, width))


def test_edge_cases(spark):
    long = " ".join("w%d" % (i * i % 7919) for i in range(60_000))
    rows = [
        (1, None, 1), (2, "", 1), (3, " \t\n", 1), (4, "One", 1), (5, "one", 1), (6, "ONE two", 1), (7, "one TWO", 1),
        (8, "Été vert", 1), (9, "été vert", 1), (11, long, 1), (10, long + " end", 1),
        (12, "a b", 1), (12, "a b", 1), (None, "a b", 1), (13, "one\x0btwo", 1), (14, "one two", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, component_id int")
    found = minhash.near_duplicates(df, width=2)
    order = lambda r: str(r)
    assert sorted(map(tuple, found.collect()), key=order) == sorted(brute(rows, 2), key=order)
    assert minhash.near_duplicates(df.limit(0), width=2).count() == 0


def test_threshold_keeps_pairs():
    least = minhash.match_threshold(128, 0.8)
    assert 75 < least < 85 and minhash.match_threshold(minhash.COORDINATES, 0.8) < 0.64 * minhash.COORDINATES


def test_components_of_a_path(spark):
    nodes = spark.createDataFrame([(i,) for i in range(40)], "node bigint")
    links = spark.createDataFrame([(i + 1, i) for i in range(29)] + [(33, 35), (35, 39)], "a bigint, b bigint")
    found = {r.node: r.component for r in minhash.components(nodes, links).collect()}
    assert all(found[i] == 0 for i in range(30)) and found[39] == 33 and found[31] == 31


def test_near_copies_below_the_threshold_are_not_compared_in_pairs(spark, monkeypatch):
    rnd = random.Random(5)
    base = ["w%d" % i for i in range(200)]
    rows = []
    for doc in range(90):
        own = list(base)
        for at in rnd.sample(range(0, 200, 4), 10):
            own[at] = "own%d-%d" % (doc, at)
        rows.append((doc, " ".join(own)))
    rows += [(100, rows[7][1] + " more"), (101, rows[60][1] + " more")]
    compared = []
    confirmed = minhash._Join.confirmed
    monkeypatch.setattr(minhash._Join, "confirmed", lambda self, pairs: compared.append(pairs.count()) or confirmed(self, pairs))
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), width=2)
    assert sorted(map(tuple, found.collect())) == sorted(brute(rows, 2))
    assert sum(compared) < 5 * len(rows), compared
