import random

import numpy as np

from quorumlens.llm import line_chunks
from quorumlens.llm.common import WordHashes

SCHEMA = "doc_id bigint, text string, n_lines int"


def brute(rows):
    """(text, n_lines, removed lines, removed chunks) by id: every run of two lines and every chunk is looked at."""
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    texts = {d: t.split("\n") for d, t, _ in ordered if t is not None}
    hashes, places, chunks, repeats = WordHashes(), {}, set(), {}
    for doc, lines in texts.items():
        for k in range(len(lines) - 1):
            places.setdefault(tuple(lines[k : k + 2]), []).append((doc, k))
        start, repeats[doc] = 0, 0
        for end in line_chunks.chunk_ends(hashes.array([x.encode() for x in lines])):
            chunk = tuple(lines[start:end])
            repeats[doc] += len(chunk) > 1 and chunk in chunks
            chunks.add(chunk)
            start = end
    out = {d: (None, 0, 0, 0) for d, t, _ in rows if t is None}
    for doc, lines in texts.items():
        gone, stays = set(), set()
        for k in range(len(lines) - 1):
            at = places[tuple(lines[k : k + 2])]
            if len(at) > 1:
                (stays if at[0] == (doc, k) else gone).update((k, k + 1))
        kept = [x for k, x in enumerate(lines) if k not in gone or k in stays]
        out[doc] = ("\n".join(kept), len(lines), len(lines) - len(kept), repeats[doc])
    return out


def found_in(spark, rows, **parameters):
    rows = line_chunks.deduplicated(spark.createDataFrame(rows, SCHEMA), **parameters).collect()
    return {r.doc_id: (r.text, r.n_lines, r.removed_lines, r.removed_chunks) for r in rows}


def long_passages():
    rnd = random.Random(8)
    line = lambda: "line %d" % rnd.randrange(10**6)
    shared = [[line() for _ in range(12)] for _ in range(4)]
    rows = []
    for i in range(80):
        own = [line() for _ in range(rnd.randint(0, 20))]
        at = rnd.randint(0, len(own))
        own[at:at] = rnd.choice(shared) if i % 2 else []
        rows.append((i, "\n".join(own), 0))
    return rows + [(200, None, 0), (201, "", 0), (202, "\n" * 300, 0), (203, rows[1][1], 0), (None, rows[1][1], 0), (204, "é\n" * 4 + "x", 0)]


def test_against_brute_force(spark):
    rows = long_passages()
    expected = brute(rows)
    assert found_in(spark, rows) == expected
    assert sum(r[3] for r in expected.values()) > 50 and expected[203][0] == expected[None][0] == ""


def test_boundaries_decide_what_whole_chunks_settle(spark):
    """Without boundaries only the longest pieces are chunks; texts are the same, as runs find the rest."""
    rows = long_passages()
    with_boundaries, without = found_in(spark, rows), found_in(spark, rows, divisor=1 << 40)
    assert sum(r[3] for r in with_boundaries.values()) > 5 * sum(r[3] for r in without.values())
    assert {d: r[:3] for d, r in with_boundaries.items()} == {d: r[:3] for d, r in without.items()}


def test_chunks_reach_the_comparison_instead_of_their_runs(spark, monkeypatch):
    """Runs inside a repeated chunk are not looked at: with every run switched off, whole chunks still go."""
    tables, real = {}, line_chunks.written
    monkeypatch.setattr(line_chunks, "written", lambda df, name: tables.setdefault(name, real(df, name)))
    monkeypatch.setattr(line_chunks, "discard", lambda *_: None)
    rows = long_passages()
    found_in(spark, rows)
    pieces = tables["chunk-texts"].where("NOT first").collect()
    covered = {(p.doc_id, p.row, k) for p in pieces if p.whole for k in range(p.start, p.end - 1)}
    assert len(covered) > 250 and not covered & {(p.doc_id, p.row, p.start) for p in pieces if not p.whole}


def test_equal_rows_are_treated_alike(spark):
    text = "\n".join("l%d" % i for i in range(30))
    rows = [(1, text, 0), (1, text, 0), (2, text, 0)]
    found = sorted(map(tuple, line_chunks.deduplicated(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert [r[0] for r in found if r[3] == 0] == [1, 1] and found[2][1:4] == ("", 30, 30)


def test_boundaries_resist_shifts():
    lines = np.random.default_rng(1).integers(0, 1 << 62, 500, dtype=np.uint64)
    plain = set(line_chunks.chunk_ends(lines))
    moved = {e - 3 for e in line_chunks.chunk_ends(np.concatenate([lines[:3] + np.uint64(1), lines]))}
    assert {e for e in plain if e > 2} == {e for e in moved if e > 2}
    assert line_chunks.chunk_ends(np.empty(0, np.uint64)) == []
    assert max(np.diff([0, *line_chunks.chunk_ends(np.full(1000, 7, np.uint64))])) <= line_chunks.LONGEST


def test_empty(spark):
    assert line_chunks.deduplicated(spark.createDataFrame([], SCHEMA)).count() == 0


def test_short_passages_are_found_wherever_they_lie(spark):
    """Against all runs of two or more lines, found by looking at every place."""
    rnd = random.Random(11)
    line = lambda: "line %d" % rnd.randrange(10**6)
    shared = [[line() for _ in range(n)] for n in (2, 2, 3, 3, 4, 5, 6)]
    rows = []
    for i in range(120):
        own = [line() for _ in range(rnd.randint(1, 12))]
        at = rnd.randint(0, len(own))
        own[at:at] = shared[i % len(shared)]
        rows.append((i, "\n".join(own), 0))
    # Overlapping passages: the kept copy of "b c" lies in 301, next to a repeat of "a b".
    rows += [(300, "a\nb", 0), (301, "a\nb\nc", 0), (302, "b\nc", 0), (303, "\n" * 300, 0), (304, None, 0), (None, rows[0][1], 0), (305, "one", 0), (306, "one", 0)]
    found = found_in(spark, rows)
    assert found == brute(rows)
    assert found[304][0] is None and found[None][0] == "" and found[303][0] == "\n"
    assert [found[d][0] for d in (300, 301, 302)] == ["a\nb", "b\nc", ""] and found[306][0] == "one"
    # Every later copy of a shared passage is gone, as short as it is.
    for i in range(len(shared), 120):
        assert not set(shared[i % len(shared)]) & set(found[i][0].split("\n"))
