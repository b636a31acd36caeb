import itertools

import pytest

from quorumlens.llm import mixing


def test_quotas():
    found = mixing.quotas([("b", 100), ("a", 1000), (None, 10), ("c", 0)])
    assert found[None] == 20 and found["c"] == 0  # stop at twice their size
    assert found["b"] == 200
    assert sum(found.values()) == pytest.approx(1.5 * 1110)
    assert mixing.quotas([]) == {}


def cost(given, patterns):
    total = 0
    for words, (_, size) in zip((sum(g.values()) for g in given), patterns):
        total += min(words, size) + 4 * max(0, words - size)
    return total


def test_route_is_the_cheapest():
    """Against all ways to split small capacities."""
    patterns = [(("a",), 3), (("a", "b"), 2), (("b",), 1)]
    quota = {"a": 4, "b": 4}
    best = None
    for x in itertools.product(range(7), range(5), range(5), range(3)):
        a, ab_a, ab_b, b = x
        if a + ab_a == 4 and ab_b + b == 4 and ab_a + ab_b <= 4 and a <= 6 and b <= 2:
            c = cost([{"a": a}, {"a": ab_a, "b": ab_b}, {"b": b}], patterns)
            best = c if best is None else min(best, c)
    given = mixing.route(patterns, quota)
    assert cost(given, patterns) == best
    assert [sum(g.get(s, 0) for g in given) for s in "ab"] == [4, 4]


@pytest.mark.parametrize("per_range", [2_000, 5])
def test_mix_meets_the_quota(spark, per_range):
    units = [(i, [s], 1 + (i * 37) % 50) for i, s in enumerate(["x"] * 300 + ["y"] * 60 + [None] * 40)]
    units += [(None, ["x"], 7), (None, ["x"], 7), (5, ["x"], 0), (6, [], 9)]
    held = {}
    for _, m, n in units:
        if m:
            held[m[0]] = held.get(m[0], 0) + n
    quota = mixing.quotas(list(held.items()))
    df = spark.createDataFrame(units, "key bigint, members array<string>, size bigint")
    found = mixing.mix(df, quota, range_documents=per_range).collect()
    assert len(found) == len(units)
    taken = {}
    for r in found:
        assert 0 <= r.copies <= 2 and (r["size"] or not r.copies)
        if r.members:
            taken[r.members[0]] = taken.get(r.members[0], 0) + r.copies * r["size"]
    for s in held:
        assert abs(taken[s] - quota[s]) <= 25
    again = mixing.mix(df.repartition(7), quota, range_documents=per_range).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_overlap_and_empty(spark):
    schema = "key bigint, members array<string>, size bigint"
    df = spark.createDataFrame([(1, ["a"], 10), (2, ["a", "b"], 10), (3, ["b"], 10)], schema)
    found = {r.key: r.copies for r in mixing.mix(df, {"a": 10, "b": 20}).collect()}
    assert found == {1: 1, 2: 1, 3: 1}
    assert mixing.mix(spark.createDataFrame([], schema), {}).count() == 0
