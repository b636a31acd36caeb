"""WARC archives: write records, and read them back through a verified chain of record boundaries."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlens.llm.common import Batches
from quorumlens.session import written

#: Rows of an archive end where the next magic may begin. No header line starts with it, and it has no border
#: of its own, so a reader that looks for it misses none.
MAGIC = b"\nWARC/1."
_HEAD = len(MAGIC) - 1
_VERSION = re.compile(rb"[01]\r\n")
_FIELD = re.compile(rb"(?:^|\r\n)([A-Za-z-]+):[ \t]*([^\r\n]*)")

_CANDIDATE = pa.schema(
    [
        ("file", pa.string()),
        ("block", pa.int64()),
        ("at", pa.int64()),  # of the magic, from the block's first row on
        ("to", pa.int64()),  # of the successor's magic; null where there is no header
        ("size", pa.int64()),  # bytes of the row and of the magic after it
        ("whole", pa.bool_()),  # the declared record ends where the row ends
        ("type", pa.string()),
        ("record_id", pa.string()),
        ("refers_to", pa.string()),
        ("uri", pa.string()),
        ("declared", pa.string()),
        ("payload_at", pa.int64()),  # in the row
        ("payload_bytes", pa.int64()),
        ("digest", pa.string()),  # of a whole record's payload
    ]
)
_SPARK_CANDIDATE = (
    "file string, block bigint, at bigint, to bigint, size bigint, whole boolean, type string, record_id string, "
    "refers_to string, uri string, declared string, payload_at bigint, payload_bytes bigint, digest string"
)


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a BINARY column, without Python."""
    digest = F.sha1(data)
    parts = [
        F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)
    ]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _packing(change):
    """Applies zlib to the column data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                data = pa.array([change(x) for x in part.column("data").to_pylist()], pa.binary())
                yield part.set_column(part.schema.get_field_index("data"), "data", data)

    return run


def write_archives(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", records_per_file: int = 4096) -> None:
    """One WARC/1.1 record for each row of ``pages`` (page_id BIGINT, url STRING, html STRING).

    The payload is the page in UTF-8, empty for null. Of the records with equal payloads those with the
    smallest page_id are responses, the others revisit records without a payload that refer to it; rows that
    repeat the smallest page_id are all responses, and null ids come last. Line ends in a url become spaces.
    The text sink writes the records with the record end as its line separator, so files are committed by
    Spark and whatever store it knows can hold them.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.select("page_id", "url", base32_sha1(payload).alias("digest"), payload.alias("data"))
    groups = (
        pages.groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
        .where("copies > 1 AND first IS NOT NULL")
    )
    # The payloads move once, packed; the plan is the same however many groups there are.
    packed = pages.mapInArrow(_packing(zlib.compress), "page_id bigint, url string, digest string, data binary")
    joined = packed.join(groups.select("digest", "first").hint("merge"), "digest", "left")
    pages = joined.select("page_id", "url", "digest", "first", "data").mapInArrow(
        _packing(zlib.decompress), "page_id bigint, url string, digest string, first bigint, data binary"
    )
    pages = pages.withColumn("html", F.col("data").cast("string"))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(F.col("page_id").cast("string"), F.lit("null")),
        F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
        F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]", " "),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.when(
            revisit,
            F.concat(
                F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                F.lit("\r\nWARC-Refers-To: <urn:page:"),
                F.col("first").cast("string"),
                F.lit(">"),
            ),
        ).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"),
        block,
    )
    (
        pages.select(record.alias("value"))
        .write.option("lineSep", "\r\n\r\n")
        .option("maxRecordsPerFile", records_per_file)
        .text(path)
    )


def _header(row: bytes) -> tuple[int, dict[bytes, bytes]] | None:
    """Where the block starts, and the fields, of a row that starts after ``WARC/1.``."""
    if not _VERSION.match(row):
        return None
    end = row.find(b"\r\n\r\n")
    if end < 0:
        return None
    return end + 4, {m[1].lower(): m[2] for m in _FIELD.finditer(row, 1, end)}


def _payload_at(row: bytes, start: int, fields: dict[bytes, bytes]) -> int:
    """Where the payload starts in the row: after the HTTP header, if the block has one."""
    if fields.get(b"content-type", b"").startswith(b"application/http"):
        end = row.find(b"\r\n\r\n", start)
        return end + 4 if end >= 0 else len(row)
    return start


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, int, bytes]]:
    """Each row with its file, block, the offset of its magic from the block's first row, and its size."""
    here, at = None, 0
    for batch in batches:
        files, blocks, values = (batch.column(n) for n in ("file", "block", "value"))
        for i in range(batch.num_rows):
            file, block, row = files[i].as_py(), blocks[i].as_py(), values[i].as_py()
            size = len(row) + len(MAGIC)
            if (file, block) != here:
                here, at = (file, block), 0
                if block == 0 and row.startswith(MAGIC[1:]):
                    row, at = row[_HEAD:], _HEAD
            yield file, block, at - _HEAD, size, row
            at += len(row) + len(MAGIC)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = Batches(_CANDIDATE)
    text = lambda b: b.decode("utf-8", "replace") if b is not None else None
    for file, block, at, size, row in _placed(batches):
        head = _header(row)
        found: tuple = (None, False) + (None,) * 8
        if head and head[1].get(b"content-length", b"x").isdigit():
            start, fields = head
            declared = start + int(fields[b"content-length"])
            # After a record come two line ends; the last one belongs to the next magic, unless the file ends.
            whole = len(row) in (declared + 3, declared + 4) and row[declared:] == b"\r\n\r\n"[: len(row) - declared]
            first = _payload_at(row, start, fields) if whole else start
            found = (
                at + _HEAD + declared + 4,
                whole,
                text(fields.get(b"warc-type")),
                text(fields.get(b"warc-record-id")),
                text(fields.get(b"warc-refers-to")),
                text(fields.get(b"warc-target-uri")),
                text(fields.get(b"warc-payload-digest")),
                first,
                max(0, declared - first) if whole else None,
                base64.b32encode(hashlib.sha1(row[first:declared]).digest()).decode() if whole else None,
            )
        yield from out.add((file, block, at, found[0], size, *found[1:]))
    yield from out.end()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("value", pa.binary())])
    out = Batches(schema)
    for file, block, at, _, row in _placed(batches):
        yield from out.add((file, block, at, row), len(row))
    yield from out.end()


def _scan(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("value"),
    )


def _absolute(candidates: DataFrame) -> DataFrame:
    """Offsets from the start of the file: each block's rows follow those of the blocks before."""
    ends = candidates.groupBy("file", "block").agg(F.sum("size").alias("bytes"))
    base = ends.select(
        "file",
        "block",
        F.expr(
            "coalesce(sum(bytes) OVER "
            "(PARTITION BY file ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
        ).alias("base"),
    )
    return candidates.join(base, ["file", "block"]).withColumns(
        {"at": F.col("at") + F.col("base"), "to": F.col("to") + F.col("base")}
    )


def reachable(links: DataFrame) -> DataFrame:
    """Records that the chain from the start of their file reaches: columns file, at.

    ``links`` has one row (file, at, to) for each candidate. Each round joins every candidate with the one
    its pointer names, which doubles the length of all pointers, and marks what marked candidates point to. So
    a file of n candidates takes log2(n) rounds, each one written to the shared folder, and no task ever holds a file.
    """
    most = links.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    state = written(links.select("file", "at", "to", (F.col("at") == 0).alias("hit")), "warc-chain")
    for _ in range(most.bit_length()):
        onward = state.select("file", F.col("at").alias("to"), F.col("to").alias("beyond"), F.lit(True).alias("there"))
        moved = state.join(onward, ["file", "to"], "left")
        # One aggregate takes the longer pointer from the row itself and the mark from whoever points here.
        own = moved.select("file", "at", F.col("beyond").alias("to"), "hit")
        marks = moved.where("hit AND there").select(
            "file", F.col("to").alias("at"), F.lit(None).cast("bigint").alias("to"), F.lit(True).alias("hit")
        )
        joined = own.unionByName(marks).groupBy("file", "at").agg(F.max("to").alias("to"), F.max("hit").alias("hit"))
        state = written(joined, "warc-chain")
    return state.where("hit").select("file", "at")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Verified records of the archives under ``path``: file, at, type, record_id, refers_to, uri, declared, payload_bytes, digest.

    Tasks read file splits and emit a candidate at each magic, with the place its Content-Length gives for
    the successor. Candidates that the chain from the file's start does not reach lie in payloads and
    are dropped. The payload of a record whose text holds a magic is put together from its rows in order. A
    record that is cut off has null payload_bytes and digest; a folder without records gives no rows.
    """
    found = written(_scan(spark, path).mapInArrow(_candidates, _SPARK_CANDIDATE), "warc-candidates")
    found = _absolute(found)
    chain = reachable(found.select("file", "at", "to"))
    marked = written(found.join(chain.withColumn("hit", F.lit(True)), ["file", "at"], "left"), "warc-records")
    records = marked.where("hit AND type IS NOT NULL")
    kept = ["file", "at", "type", "record_id", "refers_to", "uri", "declared", "payload_bytes", "digest"]
    plain, broken = records.where("whole").select(*kept), records.where("NOT whole")
    if broken.isEmpty():
        return plain
    return plain.unionByName(_assembled(spark, path, marked).select(*kept))


def _assembled(spark: SparkSession, path: str, marked: DataFrame) -> DataFrame:
    """Records that spread over several rows, with the digest of their whole payload."""
    local = F.expr(
        "last(if(hit, at, NULL), true) OVER (PARTITION BY file, block ORDER BY at "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    )
    carried = marked.groupBy("file", "block").agg(F.max(F.when(F.col("hit"), F.col("at"))).alias("newest"))
    carried = carried.select(
        "file",
        "block",
        F.expr(
            "last(newest, true) OVER (PARTITION BY file ORDER BY block "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        ).alias("carried"),
    )
    owned = (
        marked.withColumn("local", local)
        .join(carried, ["file", "block"])
        .withColumn("owner", F.coalesce("local", "carried"))
    )
    heads = marked.where("hit AND NOT whole").withColumnRenamed("at", "owner")
    pieces = owned.join(heads.select("file", "owner"), ["file", "owner"], "left_semi")
    pieces = pieces.select("file", "block", (F.col("at") - F.col("base")).alias("at"), F.col("at").alias("place"), "owner")
    rows = _scan(spark, path).mapInArrow(_rows, "file string, block bigint, at bigint, value binary")
    texts = (
        rows.join(pieces, ["file", "block", "at"])
        .groupBy("file", "owner")
        .agg(F.sort_array(F.collect_list(F.struct("place", F.col("value").cast("string").alias("value")))).alias("rows"))
        .select("file", "owner", F.array_join(F.col("rows.value"), MAGIC.decode()).cast("binary").alias("text"))
    )
    joined = heads.drop("payload_bytes", "digest").join(texts, ["file", "owner"]).withColumnRenamed("owner", "at")
    declared = F.col("to") - F.col("at") - _HEAD - 4  # of the row
    whole = F.octet_length("text") >= declared
    schema = "file string, at bigint, type string, record_id string, refers_to string, uri string, declared string, payload_bytes bigint, digest string"
    return joined.select(
        "file", "at", "type", "record_id", "refers_to", "uri", "declared", F.when(whole, F.col("text")).alias("text"), declared.alias("end")
    ).mapInArrow(_measured, schema)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Payload size and digest of records put together."""
    for batch in batches:
        sizes, digests = [], []
        for text, end in zip(batch.column("text").to_pylist(), batch.column("end").to_pylist(), strict=True):
            head = _header(text) if text is not None else None
            at = _payload_at(text[:end], *head) if head else None
            sizes.append(None if at is None else end - at)
            digests.append(None if at is None else base64.b32encode(hashlib.sha1(text[at:end]).digest()).decode())
        names = ["file", "at", "type", "record_id", "refers_to", "uri", "declared"]
        columns = [batch.column(n) for n in names] + [pa.array(sizes, pa.int64()), pa.array(digests, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=[*names, "payload_bytes", "digest"])


def page_records(records: DataFrame) -> DataFrame:
    """One row for each record: page_id, payload_bytes, payload_digest, record_type, refers_to, verified.

    A revisit record takes size and digest from the response it refers to. ``verified``: the digest of the
    bytes read equals the one in the record's header.
    """
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(.*)>$', 1) AS BIGINT)")
    records = records.select(
        number("record_id").alias("page_id"),
        "type",
        number("refers_to").alias("refers_to"),
        F.regexp_replace("declared", "^sha1:", "").alias("declared"),
        "payload_bytes",
        "digest",
    )
    own = records.where("type = 'response'")
    sizes = own.groupBy(F.col("page_id").alias("refers_to"), F.col("digest").alias("declared")).agg(
        F.max("payload_bytes").alias("held")
    )
    back = records.where("type = 'revisit'").drop("payload_bytes", "digest").join(sizes, ["refers_to", "declared"], "left")
    return own.select(
        "page_id",
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.lit(None).cast("bigint").alias("refers_to"),
        (F.col("digest") == F.col("declared")).alias("verified"),
    ).unionByName(
        back.select(
            "page_id",
            F.col("held").alias("payload_bytes"),
            F.col("declared").alias("payload_digest"),
            F.col("type").alias("record_type"),
            "refers_to",
            F.col("held").isNotNull().alias("verified"),
        )
    )
