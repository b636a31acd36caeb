import random

import numpy as np

from quorumlens.llm import tiling

DOCS = "doc_id bigint, text string, item_id int"
ITEMS = "item_id bigint, text string, covered int"


def greedy(item, text, shortest):
    """Greedy string tiling by its definition: mark all longest free matches, again and again."""
    free_a, free_b, out = [True] * len(item), [True] * len(text), []
    while True:
        best, matches = shortest, []
        for a in range(len(item)):
            for b in range(len(text)):
                k = 0
                while a + k < len(item) and b + k < len(text) and item[a + k] == text[b + k] and free_a[a + k] and free_b[b + k]:
                    k += 1
                if k > best:
                    best, matches = k, []
                if k == best:
                    matches.append((a, b))
        if not matches:
            return out
        for a, b in matches:
            if all(free_a[a : a + best]) and all(free_b[b : b + best]):
                free_a[a : a + best] = [False] * best
                free_b[b : b + best] = [False] * best
                out.append((a, b, best))


def test_tiles_against_the_definition():
    rnd = random.Random(2)
    for _ in range(60):
        item = [rnd.randrange(6) for _ in range(rnd.randint(0, 40))]
        text = [rnd.randrange(6) for _ in range(rnd.randint(0, 40))]
        if rnd.random() < 0.6:
            text[5:5] = item[10:] + item[:10]
        found = tiling.tiles(np.asarray(item, np.uint64), np.asarray(text, np.uint64), 3)
        assert sum(t[2] for t in found) == sum(t[2] for t in greedy(item, text, 3))
        for a, b, n in found:
            assert item[a : a + n] == text[b : b + n]


def brute(docs, items, percent, shortest):
    out = []
    first = {}
    for i, text, *_ in items:
        words = tuple((text or "").encode().lower().split())
        if words and i is not None:
            first[words] = min(i, first.get(words, i))
    for doc, text, *_ in docs:
        words = (text or "").encode().lower().split()
        for item, i in first.items():
            if len(item) < shortest:
                covered = len(item) if tuple(words) == item else 0
            else:
                covered = sum(t[2] for t in greedy(item, words, shortest))
            if covered and 100 * covered >= percent * len(item):
                out.append((doc, i, len(item), covered))
    return sorted(out, key=str)


def test_contaminated(spark):
    rnd = random.Random(4)
    word = lambda: "w%d" % rnd.randrange(300)
    items = [(i, " ".join(word() for _ in range(rnd.randint(12, 40))), 0) for i in range(12)]
    items += [(50, items[0][1].upper(), 0), (51, "", 0), (52, None, 0), (None, "a b c d e f", 0), (53, "tiny item", 0)]
    docs = []
    for i in range(60):
        words = [word() for _ in range(rnd.randint(0, 80))]
        part = items[i % 12][1].split()
        cut = rnd.randint(0, len(part))
        if i % 3 == 0:
            words[len(words) // 2 : len(words) // 2] = part[cut:] + ["x"] + part[:cut]
        elif i % 3 == 1:
            words += part[: len(part) // 3]
        docs.append((i, " ".join(words), 0))
    docs += [(100, None, 0), (101, "", 0), (None, items[3][1], 0), (102, items[4][1], 0), (102, items[4][1], 0)]
    docs += [(103, "Tiny\nITEM", 0), (104, "a tiny item", 0), (105, (items[5][1] + " ") * 400, 0)]
    left, right = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    expected = brute(docs, items, 60, 5)
    assert len(expected) > 20
    for words in (10**6, 40):
        found = tiling.contaminated(left, right, block_words=words).drop("tiles").collect()
        assert sorted(map(tuple, found), key=str) == expected


def test_long_and_repetitive():
    one = np.full(20_000, 7, np.uint64)
    assert sum(t[2] for t in tiling.tiles(one[:500], one)) == 500


def test_empty(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert tiling.contaminated(docs, items).count() == 0
    assert tiling.contaminated(docs, spark.createDataFrame([(1, "a b c d e", 0)], ITEMS)).count() == 0
