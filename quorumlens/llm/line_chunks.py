"""Removal of repeated multi-line passages: content-defined chunks of lines, then the runs that no whole chunk holds."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlens.llm.common import Batches, WordHashes, mixed, rows_of
from quorumlens.session import discard, written

#: Lines that the rolling hash covers; the boundary lies after the last of them.
WINDOW = 2
#: One window in so many ends a chunk.
DIVISOR = 3
#: A chunk ends after so many lines at the latest.
LONGEST = 64
LEAST_LINES = 2


def chunk_ends(hashes: np.ndarray, window: int = WINDOW, divisor: int = DIVISOR, longest: int = LONGEST) -> list[int]:
    """Ends (exclusive) of the chunks of a document with these line hashes.

    The rolling value of a place depends on the ``window`` lines before it only, so inserted or deleted lines
    move no boundary further away than that.
    """
    n = len(hashes)
    rolling = np.zeros(n, np.uint64)
    for k in range(window):
        rolling[k:] = rolling[k:] * np.uint64(0x9E3779B97F4A7C15) + hashes[: n - k]
    ends = (np.flatnonzero(mixed(rolling) % np.uint64(divisor) == 0) + 1).tolist()
    out, last = [], 0
    for end in [*ends, n]:
        while end - last > longest:
            last += longest
            out.append(last)
        if end > last:
            out.append(end)
            last = end
    return out


_CHUNKS = pa.schema(
    [("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.binary()), ("runs", pa.list_(pa.binary()))]
)
_CHUNKS_SQL = "doc_id bigint, row bigint, start int, end int, value binary, runs array<binary>"


def _chunks(window: int, divisor: int, least: int):
    """doc_id, row, start, end, value, runs of each chunk.

    ``row`` and ``value`` are hashes of text and chunk, ``runs`` those of the ``least`` lines from each line of the
    chunk on, as far as the text has so many.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, out = WordHashes(200_000), Batches(_CHUNKS)
        for doc, row, text in rows_of(batches, "doc_id", "row", "text"):
            lines = text.split(b"\n")
            start, last = 0, len(lines) - least + 1
            for end in chunk_ends(hashes.array(lines), window, divisor):
                value = xxhash.xxh3_128_digest(b"\n".join(lines[start:end]))
                runs = [xxhash.xxh3_128_digest(b"\n".join(lines[k : k + least])) for k in range(start, min(end, last))]
                yield from out.add((doc, row, start, end, value, runs), 16 * len(runs))
                start = end
        yield from out.end()

    return run


_CONTENTS = pa.schema(
    [
        ("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int32()), ("end", pa.int32()),
        ("whole", pa.bool_()), ("value", pa.binary()), ("first", pa.bool_()), ("content", pa.binary()),
    ]
)


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of the named pieces."""
    out = Batches(_CONTENTS)
    for doc, row, text, named in rows_of(batches, "doc_id", "row", "text", "named"):
        lines = text.split(b"\n")
        for x in named:
            content = b"\n".join(lines[x["start"] : x["end"]])
            yield from out.add((doc, row, x["start"], x["end"], x["whole"], x["value"], x["first"], content), len(content))
    yield from out.end()


def kept_lines(n: int, gone: Iterable[tuple[int, int]], first: Iterable[tuple[int, int]]) -> np.ndarray:
    """Which of ``n`` lines stay: those in no piece of ``gone``, and those in a run of ``first``."""
    keep = np.ones(n, bool)
    for start, end in gone:
        keep[start:end] = False
    for start, end in first:
        keep[start:end] = True
    return keep


_RESULT = pa.schema(
    [("doc_id", pa.int64()), ("text", pa.string())]
    + [(n, pa.int64()) for n in ("n_lines", "removed_lines", "removed_chunks", "removed_runs")]
)
_RESULT_SQL = "doc_id bigint, text string, n_lines bigint, removed_lines bigint, removed_chunks bigint, removed_runs bigint"


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = Batches(_RESULT)
    for doc, text, marks in rows_of(batches, "doc_id", "text", "marks"):
        if text is None:
            yield from out.add((doc, None, 0, 0, 0, 0))
            continue
        lines, marks = text.split(b"\n"), marks or ()
        gone = [(m["start"], m["end"]) for m in marks if not m["first"]]
        keep = kept_lines(len(lines), gone, [(m["start"], m["end"]) for m in marks if m["first"]])
        result = text if keep.all() else b"\n".join([lines[i] for i in np.flatnonzero(keep).tolist()])
        chunks = sum(m["whole"] and not m["first"] for m in marks)
        runs = np.count_nonzero(np.diff(keep.astype(np.int8), prepend=1) < 0)
        yield from out.add((doc, result.decode(), len(lines), len(lines) - int(keep.sum()), chunks, runs), len(result))
    yield from out.end()


def _repeated(pieces: DataFrame, seen: str = "false") -> DataFrame:
    """value, at of the pieces that are there twice, or that ``seen`` says so of; ``at`` is the first place."""
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "start")
    found = pieces.groupBy("value").agg(F.min(place).alias("at"), F.max(place).alias("to"), F.bool_or(F.expr(seen)).alias("seen"))
    return found.where("at < to OR seen").select("value", "at")


def _is_first():
    return F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "start").eqNullSafe(F.col("at"))


def _same(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["row"] == b["row"])


def deduplicated(docs: DataFrame, window: int = WINDOW, divisor: int = DIVISOR, least_lines: int = LEAST_LINES) -> DataFrame:
    """doc_id, text without repeats, n_lines, removed_lines, removed_chunks, removed_runs of each row of ``docs`` (doc_id BIGINT, text STRING).

    Lines are cut into chunks where the rolling hash says so, and chunks of ``least_lines`` lines or more are counted
    over all documents. Of equal ones that in the smallest (doc_id, text hash, place) stays, others go. What a whole
    chunk cannot show, the edges of longer passages and passages that hold no chunk, is found by the runs of
    ``least_lines`` lines outside the repeated chunks; of equal runs the first stays likewise, and so do lines that
    also belong to a run which stays for others: what is removed is still there whole at its first place. Chunks and
    runs go only after their bytes were compared with the first ones. So no passage of ``least_lines`` lines or more
    is left a second time, wherever the boundaries fall; they decide how much is settled by whole chunks.
    ``removed_chunks`` counts the repeated chunks, ``removed_runs`` the gaps that removed lines leave.

    Only hashes are shuffled to find repeats; texts are moved by key twice, for the comparison and for the result.
    Null texts stay null; null ids come after all others; rows equal in id and text are treated alike and keep
    what the first of them keeps; a document that is all repeats has an empty text; an empty table gives no rows.
    Runs jobs when it is called.
    """
    text = F.col("text").cast("binary")
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("row"), text.alias("text"))
    full = source.where("text IS NOT NULL")
    chunks = written(full.mapInArrow(_chunks(window, divisor, least_lines), _CHUNKS_SQL), "line-chunks")

    several = chunks.where(F.col("end") - F.col("start") >= least_lines)
    judged = several.join(_repeated(several), "value", "left").withColumn("first", F.when(F.col("at").isNotNull(), _is_first()))
    others = chunks.where(F.col("end") - F.col("start") < least_lines).withColumn("first", F.lit(None).cast("boolean"))
    judged = written(judged.drop("at").unionByName(others), "judged-chunks")

    # A repeated chunk settles the runs inside it; those of its first copy stand for them.
    runs = judged.select("doc_id", "row", "end", "first", "start", F.posexplode("runs").alias("k", "value"))
    inside = F.col("start") + F.col("k") + least_lines <= F.col("end")
    runs = runs.where(~(inside & F.expr("first IS NOT DISTINCT FROM false"))).select(
        "doc_id", "row", (F.col("start") + F.col("k")).alias("start"), "value", (inside & F.col("first").isNotNull()).alias("seen")
    )
    runs = runs.join(_repeated(runs, "seen"), "value").withColumn("first", _is_first())
    runs = runs.withColumn("end", F.col("start") + least_lines)

    columns = ("doc_id", "row", "start", "end", "value", "first")
    pieces = judged.where("first IS NOT NULL").select(*columns, F.lit(True).alias("whole"))
    pieces = pieces.unionByName(runs.select(*columns, F.lit(False).alias("whole")))
    named = pieces.groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", "end", "whole", "value", "first")).alias("named"))
    named = written(named, "repeated-chunks")
    discard(chunks, judged)

    # Both joins always move the documents by key, so the plan is the same at every size. Rows equal in id and text
    # give the same contents, which are compared alike.
    named_by_key = named.hint("merge")
    holders = full.join(named_by_key, _same(full, named_by_key)).select(full["doc_id"], full["row"], "text", "named")
    types = "doc_id bigint, row bigint, start int, end int, whole boolean, value binary, first boolean, content binary"
    contents = written(holders.mapInArrow(_contents, types), "chunk-texts")
    kept = contents.where("first").groupBy("whole", "value").agg(F.min("content").alias("kept"))
    mark = F.struct("start", "end", "whole", "first")
    gone = contents.where("NOT first").join(kept, ["whole", "value"]).where("content = kept").select("doc_id", "row", mark.alias("mark"))
    stays = contents.where("first AND NOT whole").select("doc_id", "row", mark.alias("mark"))
    marks = written(gone.union(stays).groupBy("doc_id", "row").agg(F.collect_set("mark").alias("marks")), "removed-chunks")
    discard(named, contents)
    marks = marks.hint("merge")
    result = source.join(marks, _same(source, marks), "left").select(source["doc_id"], "text", "marks")
    return result.mapInArrow(_without, _RESULT_SQL)
