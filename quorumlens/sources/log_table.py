"""The query log: keyed upsert, keyed updates, reads, and a versioned table on plain Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T



LOG_STRUCT = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("question", T.StringType(), False),
        T.StructField("question_embedding", T.ArrayType(T.FloatType())),
        T.StructField("definition_json", T.StringType()),
        T.StructField("sql_query", T.StringType()),
        T.StructField("result_summary_json", T.StringType()),
        T.StructField("final_response", T.StringType()),
        T.StructField("agent_traces_json", T.StringType()),
        T.StructField("self_score", T.DoubleType()),
        T.StructField("self_scores_json", T.StringType()),
        T.StructField("user_score", T.IntegerType()),
        T.StructField("user_feedback", T.StringType()),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("total_tokens", T.IntegerType()),
        T.StructField("error_count", T.IntegerType()),
        T.StructField("tags", T.StringType()),
        T.StructField("created_at", T.TimestampType(), False),
    ]
)


def latest_per_key(df: DataFrame, key: str, version: Sequence[str]) -> DataFrame:
    """The row with the greatest version of every key.

    ``max_by`` combines before the shuffle: a key written a billion times still sends one row per
    map task. ``version`` must order the rows of a key completely.
    """
    row = F.max_by(F.struct(*df.columns), F.struct(*version)).alias("row_")
    return df.groupBy(F.col(key).alias("key_")).agg(row).select("row_.*")


def upsert(
    base: DataFrame, changes: DataFrame, key: str, version: Sequence[str]
) -> DataFrame:
    """Base rows, one per key, replaced or extended by the latest change of each key."""
    latest = latest_per_key(changes, key, version)
    replaced = changes.select(key).distinct()
    return base.join(replaced, key, "left_anti").unionByName(latest)


def update(
    base: DataFrame, changes: DataFrame, key: str, columns: Sequence[str], version: str
) -> DataFrame:
    """Overwrite columns of matching rows with the latest change, with NULL too; unknown keys are
    ignored."""
    latest = latest_per_key(changes, key, [version])
    new = latest.select(key, F.struct(*columns).alias("new_"))
    joined = base.join(new, key, "left")
    matched = F.col("new_").isNotNull()
    return joined.select(
        *[
            F.when(matched, F.col(f"new_.{c}")).otherwise(base[c]).alias(c)
            if c in columns
            else base[c]
            for c in base.columns
        ]
    )


def _known_keys(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Keys of the changes that are in the table; only these are looked up in the log."""
    asked = changes.select(key).distinct()
    return base.select(key).join(asked, key, "left_semi").distinct()


def unmatched(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Changes whose key is not in the table."""
    return changes.join(_known_keys(base, changes, key), key, "left_anti")


def matched_count(base: DataFrame, changes: DataFrame, key: str) -> int:
    """How many table rows an update with these changes touches."""
    return base.join(changes.select(key).distinct(), key, "left_semi").count()


def feedback_intake(log: DataFrame, feedback: DataFrame) -> DataFrame:
    """id, score, outcome: saved, unknown_session, or invalid_score for ratings outside 1..5."""
    valid = F.coalesce(F.col("score").between(1, 5), F.lit(False))
    known = _known_keys(log, feedback, "id").withColumn("known_", F.lit(True))
    outcome = (
        F.when(~valid, "invalid_score").when(F.col("known_"), "saved").otherwise("unknown_session")
    )
    return feedback.join(known, "id", "left").select("id", "score", outcome.alias("outcome"))


# --- reads ----------------------------------------------------------------------------------------


def recent(log: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """Newest first, one page."""
    return log.orderBy(F.desc("created_at"), "id").offset(offset).limit(limit)


def by_id(log: DataFrame, session_id: str) -> DataFrame:
    return log.filter(F.col("id") == session_id)


def by_score(
    log: DataFrame,
    low: float | None = None,
    high: float | None = None,
    score: str = "self_score",
) -> DataFrame:
    """Rows inside the given bounds; without bounds all rows, the unscored too."""
    if low is not None:
        log = log.filter(F.col(score) >= low)
    if high is not None:
        log = log.filter(F.col(score) <= high)
    return log


def unrated(log: DataFrame, limit: int | None = 20) -> DataFrame:
    rows = log.filter(F.col("user_score").isNull())
    return rows if limit is None else rows.orderBy(F.desc("created_at"), "id").limit(limit)


def has_tag(tags: Column, tag: str, exact: bool = False) -> Column:
    """Tag test on comma-separated text: substring without case, or whole tag with ``exact``."""
    if exact:
        return F.array_contains(F.split(tags, ","), tag)
    return tags.ilike(f"%{tag}%")


def display_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def result_summary(result: DataFrame, order: Sequence[str], n: int = 3) -> DataFrame:
    """row_count, columns and the first rows as JSON, as kept with a log row."""
    sample = result.orderBy(*order).limit(n)
    keyed = F.struct(F.struct(*order).alias("key"), F.to_json(F.struct("*")).alias("json"))
    rows = sample.agg(F.sort_array(F.collect_list(keyed)).alias("s"))
    count = result.agg(F.count(F.lit(1))).scalar()
    return rows.select(
        count.alias("row_count"),
        F.lit(",".join(result.columns)).alias("columns"),
        F.array_join(F.transform("s", lambda x: x["json"]), "\n").alias("sample"),
    )


# --- storage --------------------------------------------------------------------------------------


class LogTable:
    """Keyed log on plain Parquet with one writer at a time.

    A write appends its changes as one ``version`` and reads nothing but folder names, so its cost depends on the
    changes only. A read overlays the newest full copy with the later changes; older folders are not opened.
    ``compact`` stores the overlay as a new full copy and removes what no reader of the copy before needs. A job
    that fails half-way leaves no committed files of its version, and a repeated version replaces itself.
    """

    def __init__(
        self, spark: SparkSession, path: str, struct: T.StructType = LOG_STRUCT, order: Sequence[str] = ("version", "created_at")
    ):
        """``order`` says which row of an id counts: the last one written, or with created_at first, the newest one."""
        self.spark, self.path, self.struct, self.order = spark, path, struct, order

    def _folder(self, part: str):
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        return root, root.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self, part: str) -> list[int]:
        """Versions that are stored, from the names of their folders."""
        root, files = self._folder(part)
        if not files.exists(root):
            return []
        names = [f.getPath().getName() for f in files.listStatus(root)]
        return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))

    def _stored(self, part: str, versions: Sequence[int]) -> DataFrame:
        struct = T.StructType([*self.struct.fields, T.StructField("version", T.LongType())])
        if not versions:
            return self.spark.createDataFrame([], struct)
        folder = f"{self.path}/{part}"
        reader = self.spark.read.schema(struct).option("basePath", folder)
        return reader.parquet(*[f"{folder}/version={v}" for v in versions])

    def current_version(self) -> int:
        return max([0, *self.versions("changes"), *self.versions("full")])

    def read(self) -> DataFrame:
        full = max([0, *self.versions("full")])
        base = self._stored("full", [full] if full else [])
        changes = self._stored("changes", [v for v in self.versions("changes") if v > full])
        if self.order[0] == "version":
            return upsert(base, changes, "id", self.order).drop("version")
        return latest_per_key(base.unionByName(changes), "id", self.order).drop("version")

    def _write(self, df: DataFrame, part: str, version: int) -> None:
        (
            df.select(*self.struct.fieldNames())
            .withColumn("version", F.lit(version).cast("bigint"))
            .write.option("partitionOverwriteMode", "dynamic")
            .mode("overwrite")
            .partitionBy("version")
            .parquet(f"{self.path}/{part}")
        )

    def upsert(self, changes: DataFrame, version: int | None = None) -> int:
        """Insert or replace rows by id; returns the version."""
        number = self.current_version() + 1 if version is None else version
        self._write(changes, "changes", number)
        return number

    def compact(self, keep: int = 1) -> int:
        """Store the present rows as one full copy that later reads start from.

        The ``keep`` full copies before it stay, with the changes after the oldest of them, for reads that have
        begun; older folders are removed.
        """
        number = self.current_version()
        self._write(self.read(), "full", number)
        copies = self.versions("full")
        oldest = copies[max(0, len(copies) - 1 - keep)]
        for part, gone in (("full", lambda v: v < oldest), ("changes", lambda v: v <= oldest)):
            root, files = self._folder(part)
            for version in filter(gone, self.versions(part)):
                files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(root, f"version={version}"), True)
        return number

    def version_of(self, stream: str, batch: int) -> int:
        """The version of a batch of a stream: a new one at first, the same when the batch is replayed.

        Empty folders named by batch and version keep it, of the last two batches of each stream.
        """
        root, files = self._folder("streams")
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        files.mkdirs(path(root, stream))
        given = {}
        for folder in files.listStatus(root):
            for mark in files.listStatus(folder.getPath()):
                number, version = map(int, mark.getPath().getName().split("-"))
                given[folder.getPath().getName(), number] = version
        if (stream, batch) not in given:
            given[stream, batch] = max([self.current_version(), *given.values()]) + 1
            files.mkdirs(path(root, f"{stream}/{batch}-{given[stream, batch]}"))
            for (name, number), version in given.items():
                if name == stream and number < batch - 1:
                    files.delete(path(root, f"{stream}/{number}-{version}"), True)
        return given[stream, batch]
