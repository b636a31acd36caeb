"""Mix overlapping sources to token quotas by min-cost flow, then pick seeded documents."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlens.session import written

#: Documents that one range of tickets holds on average; a range is sorted in one task.
RANGE_DOCUMENTS = 2_000


def quotas(
    sizes: Sequence[tuple[str | None, int]],
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    most: int = 2,
) -> dict[str | None, float]:
    """Target words of each source.

    Sources in code point order, null last, get the weights in turn and share ``share`` times all sizes.
    A target stops at ``most`` times its source's size; what is cut off is shared again by weight.
    """
    order = sorted((s for s, _ in sizes if s is not None)) + [s for s, _ in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    held = dict(sizes)
    rest, open_ = share * sum(held.values()), list(order)
    found: dict[str | None, float] = {}
    while open_:
        unit = rest / sum(weight[s] for s in open_)
        above = [s for s in open_ if weight[s] * unit > most * held[s]]
        if not above:
            return found | {s: weight[s] * unit for s in open_}
        for s in above:
            found[s] = float(most * held[s])
            rest -= found[s]
        open_ = [s for s in open_ if s not in found]
    return found


class _Flow:
    """Successive shortest paths with potentials on integer capacities and non-negative costs."""

    def __init__(self, nodes: int):
        self.edges: list[list[int]] = []  # to, capacity left, cost; the reverse edge is at index ^ 1
        self.out: list[list[int]] = [[] for _ in range(nodes)]

    def edge(self, a: int, b: int, capacity: int, cost: int) -> int:
        for x, y, c, w in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.edges))
            self.edges.append([y, c, w])
        return len(self.edges) - 2

    def run(self, source: int, sink: int) -> None:
        price = [0] * len(self.out)
        while True:
            dist: dict[int, int] = {source: 0}
            via: dict[int, int] = {}
            queue, done = [(0, source)], set()
            while queue:
                d, x = heapq.heappop(queue)
                if x in done:
                    continue
                done.add(x)
                for e in self.out[x]:
                    y, left, cost = self.edges[e]
                    to = d + cost + price[x] - price[y]
                    if left and y not in done and to < dist.get(y, to + 1):
                        dist[y], via[y] = to, e
                        heapq.heappush(queue, (to, y))
            if sink not in done:
                return
            for x in range(len(price)):
                price[x] += min(dist.get(x, dist[sink]), dist[sink])
            path, x = [], sink
            while x != source:
                path.append(via[x])
                x = self.edges[via[x] ^ 1][0]
            amount = min(self.edges[e][1] for e in path)
            for e in path:
                self.edges[e][1] -= amount
                self.edges[e ^ 1][1] += amount


def route(
    patterns: Sequence[tuple[tuple, int]], quota: dict, most: int = 2
) -> list[dict[str | None, int]]:
    """Words that each membership pattern gives to each of its sources.

    Repetition k of a pattern has the pattern's size as capacity and costs k squared a word, so words are
    repeated only where first reads are used up. Patterns that share no source are routed separately.
    """
    root: dict = {}

    def top(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for members, _ in patterns:
        for s in members[1:]:
            root[top(("s", s))] = top(("s", members[0]))
    parts: dict = {}
    for i, (members, _) in enumerate(patterns):
        if members:
            parts.setdefault(top(("s", members[0])), []).append(i)
    given: list[dict] = [{} for _ in patterns]
    for part in parts.values():
        sources = list(dict.fromkeys(s for i in part for s in patterns[i][0]))
        node = {s: 2 + len(part) + k for k, s in enumerate(sources)}
        flow = _Flow(2 + len(part) + len(sources))
        arcs = []
        for k, i in enumerate(part):
            members, size = patterns[i]
            for turn in range(1, most + 1):
                flow.edge(0, 2 + k, size, turn * turn)
            arcs += [(i, s, flow.edge(2 + k, node[s], most * size, 0)) for s in members]
        for s in sources:
            flow.edge(node[s], 1, round(quota.get(s, 0)), 0)
        flow.run(0, 1)
        for i, s, e in arcs:
            given[i][s] = flow.edges[e ^ 1][1]
    return given


def _fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """First fit in ticket order, and at last one more document if that comes nearer to the gap's end."""
    for frame in frames:
        frame = frame.sort_values(["ticket", "key", "size"], kind="stable", na_position="last")
        left, extra = int(frame["gap"].iloc[0]), []
        for size in frame["size"]:
            fits = size <= left
            left -= size if fits else 0
            extra.append(int(fits))
        more = [(abs(left - n), i) for i, n in enumerate(frame["size"]) if not extra[i] and n < 2 * left]
        if more:
            extra[min(more)[1]] = 1
        yield frame[["key", "members", "size", "copies"]].assign(copies=frame["copies"] + extra)


def mix(
    units: DataFrame,
    quota: dict[str | None, float],
    seed: int = 0,
    most: int = 2,
    range_documents: int = RANGE_DOCUMENTS,
) -> DataFrame:
    """How often the mix takes each document: columns key, members, size, copies.

    ``units`` has key BIGINT, members ARRAY<STRING> (the sources that hold the document) and size BIGINT.
    Documents are summed by membership pattern; only these sums, whose number depends on the sources
    and not on the documents, come to the driver, where min-cost flow routes them to ``quota``. A pattern
    that gives w words is read w div size times as a whole; the rest is filled in the order of seeded
    tickets: all ticket ranges before the last, and by first fit within the last range. A document is taken
    ``most`` times at most. Ties, repeated rows and null keys are ordinary rows; rows with equal tickets stay
    together in a range. Size 0 and empty memberships are never taken; empty tables give no rows.
    """
    spark = units.sparkSession
    members = F.array_sort(F.array_distinct(F.coalesce("members", F.array().cast("array<string>"))))
    units = units.select(
        "key",
        members.alias("members"),
        "size",
        F.xxhash64(F.lit(seed), "key", "size").alias("ticket"),
    )
    units = written(units, "mix-units")
    sums = units.groupBy("members").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    sums = sorted(sums, key=lambda r: [(s is None, s or "") for s in r.members or []])
    given = route([(tuple(r.members or ()), r["size"] or 0) for r in sums], quota, most)
    plan = []
    for i, (r, words) in enumerate(zip(sums, given, strict=True)):
        whole, rest = divmod(sum(words.values()), r["size"]) if r["size"] else (0, 0)
        bits = min(40, max(0, -(-r.n // range_documents) - 1).bit_length())
        plan.append((i, r.members, whole, rest, bits))
    plan = spark.createDataFrame(plan, "pattern int, members array<string>, whole bigint, rest bigint, bits int")
    ranges = F.when(F.col("bits") == 0, F.lit(0).cast("bigint")).otherwise(
        F.expr("shiftrightunsigned(ticket, 64 - bits)")
    )
    dealt = units.join(plan, "members").withColumn("range", ranges)
    totals = dealt.groupBy("pattern", "range").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    before = F.expr(
        "coalesce(sum(words) OVER (PARTITION BY pattern ORDER BY range "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    )
    totals = totals.withColumn("before", before)
    last = totals.where("before <= rest AND before + words > rest").groupBy("pattern").agg(
        F.min("range").alias("last"), F.max(F.col("rest") - F.col("before")).alias("gap")
    )
    dealt = dealt.join(last, "pattern", "left").withColumn("copies", F.col("whole"))
    outside = dealt.where("last IS NULL OR range <> last").select(
        "key",
        "members",
        "size",
        F.when(F.col("range") < F.col("last"), F.col("copies") + 1).otherwise(F.col("copies")).alias("copies"),
    )
    inside = dealt.where("range = last").select("pattern", "key", "members", "size", "ticket", "gap", "copies")
    filled = inside.groupBy("pattern").applyInPandas(
        _fill, "key bigint, members array<string>, size bigint, copies bigint"
    )
    return outside.unionByName(filled).withColumn(
        "copies", F.when(F.col("size") > 0, F.col("copies")).otherwise(F.lit(0)).cast("bigint")
    )
