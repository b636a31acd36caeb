"""Vector collections on Parquet, one partition per collection."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorumlens.session import discard, written

VECTOR_STRUCT = T.StructType(
    [
        T.StructField("doc_id", T.StringType(), False),
        T.StructField("content", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("collection", T.StringType(), False),
    ]
)

KNOWLEDGE, SCHEMA, HISTORY = "knowledge", "schema", "query_history"

#: Metadata key of the hash of what a document was embedded from.
HASH = "content_hash"


def collection_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy("collection").agg(F.count(F.lit(1)).alias("n"))


def dense_numbers(df: DataFrame, group: str, order: str) -> DataFrame:
    """Add ``number``: 0, 1, 2, … inside each group, in the order of a column; null comes first.

    The rows are dealt to sampled ranges of (group, order), as many as the data needs, and written sorted, so a
    group with most of the rows spans many ranges. A row's number is its place among the group's rows in its range
    plus the group's rows in earlier ranges; only counts by range and group are added up. The input is read once,
    while this is called. Rows equal in the order column are numbered in the order in which they arrive.
    """
    rows = df.repartitionByRange(group, order).sortWithinPartitions(group, order)
    rows = written(rows.withColumn("at_", F.monotonically_increasing_id()), "numbered")
    # The upper bits of "at_" number the ranges in order, the lower 33 the rows of a range.
    piece = F.shiftright("at_", 33)
    sizes = rows.groupBy(F.col(group).alias("of_"), piece.alias("in_")).agg(F.count(F.lit(1)).alias("n_"), F.min("at_").alias("first_"))
    earlier = Window.partitionBy("of_").orderBy("in_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("before_", F.coalesce(F.sum("n_").over(earlier), F.lit(0)))
    joined = rows.join(offsets, F.col(group).eqNullSafe(F.col("of_")) & (piece == F.col("in_")))
    numbered = joined.withColumn("number", F.col("before_") + F.col("at_") - F.col("first_"))
    return numbered.drop("at_", "of_", "in_", "n_", "first_", "before_")


def with_default_ids(new: DataFrame, existing: DataFrame, order: str) -> DataFrame:
    """Give new documents the ids ``<collection>_<n>``, counting on from the number of stored documents.

    After a removal such an id may be taken; :meth:`VectorTable.append` refuses it.
    """
    start = collection_counts(existing).withColumnRenamed("n", "start_")
    numbered = dense_numbers(new, "collection", order)
    numbered = numbered.join(start, "collection", "left")
    number = F.coalesce("start_", F.lit(0)) + F.col("number")
    return numbered.withColumn(
        "doc_id", F.concat("collection", F.lit("_"), number.cast("string"))
    ).drop("start_", "number")


class VectorTable:
    """Append, search source and administration of vector collections."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _exists(self) -> bool:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(root)

    def read(self, collection: str | None = None) -> DataFrame:
        """All documents, or one collection by partition pruning; empty when nothing is stored."""
        if not self._exists():
            docs = self.spark.createDataFrame([], VECTOR_STRUCT)
        else:
            docs = self.spark.read.schema(VECTOR_STRUCT).parquet(self.path)
        return docs if collection is None else docs.filter(F.col("collection") == collection)

    def append(self, docs: DataFrame) -> None:
        """Add documents; an id that is stored already, or comes twice, is refused and nothing is added."""
        names = VECTOR_STRUCT.fieldNames()
        new = written(docs.select(*names), "new-documents")
        key = ["collection", "doc_id"]
        twice = new.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*key)
        stored = self.read().select(*key).join(new.select(*key), key, "left_semi")
        taken = [f"{r.collection}/{r.doc_id}" for r in twice.union(stored).limit(5).collect()]
        if taken:
            raise ValueError(f"ids are taken: {', '.join(taken)}")
        new.write.mode("append").partitionBy("collection").parquet(self.path)
        discard(new)

    def replace(self, docs: DataFrame) -> None:
        """Replace exactly the collections that occur in ``docs``."""
        names = VECTOR_STRUCT.fieldNames()
        (
            docs.select(*names)
            .write.option("partitionOverwriteMode", "dynamic")
            .mode("overwrite")
            .partitionBy("collection")
            .parquet(self.path)
        )

    def delete(self, collection: str) -> bool:
        """Drop one collection's partition; whether it was there."""
        part = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/collection={collection}")
        files = part.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return bool(files.exists(part) and files.delete(part, True))

    def collections(self) -> DataFrame:
        return self.read().select("collection").distinct()

    def counts(self) -> DataFrame:
        return collection_counts(self.read())

    def reset(self) -> None:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        root.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(root, True)

    def is_indexed(self, needed: Sequence[str] = (KNOWLEDGE, SCHEMA)) -> bool:
        found = self.counts().filter(F.col("collection").isin(list(needed)) & (F.col("n") > 0))
        return found.count() == len(needed)

    def sync(self, chunks: DataFrame, collection: str, embed: Column) -> DataFrame:
        """Bring a collection to the state of ``chunks`` (doc_id, content, metadata); returns n_chunks by ``change``.

        A hash of content and metadata is kept with each document. Comparing it on both sides tells what was
        ``added``, ``changed``, ``removed`` or is the ``same``; only added and changed chunks are embedded, by the
        column ``embed`` over ``content``, and the others keep their vectors. Without a change nothing is written.
        Of chunks with one doc_id, the one with the greatest content counts; chunks without doc_id are left out.

        Ids and hashes are compared first, so texts move only where a part of a side is taken, and are written once.
        ``chunks`` is read up to three times and has to give the same rows each time.
        """
        entries = F.array_sort(F.map_entries(F.coalesce("metadata", F.create_map().cast("map<string,string>"))))
        mark = F.sha2(F.to_json(F.struct(F.coalesce("content", F.lit("")).alias("content"), entries.alias("metadata"))), 256)
        known = chunks.filter("doc_id IS NOT NULL").select("doc_id", "content", "metadata")
        twice = known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
        twice = written(twice, "repeated-ids")
        if not twice.isEmpty():
            first = F.max_by(F.struct("content", "metadata"), F.struct("content", F.to_json("metadata"))).alias("chunk")
            best = known.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(first).select("doc_id", "chunk.*")
            known = known.join(twice, "doc_id", "left_anti").unionByName(best)
        new, stored = known.withColumn("hash_", mark), self.read(collection)
        old = stored.select(F.col("doc_id").alias("old_"), F.unhex(F.col("metadata")[HASH]).alias("was_"))
        change = (
            F.when(F.col("old_").isNull(), "added").when(F.col("doc_id").isNull(), "removed")
            .when(F.col("was_").eqNullSafe(F.col("is_")), "same").otherwise("changed")
        )
        compared = new.select("doc_id", F.unhex("hash_").alias("is_")).join(old, F.col("doc_id") == F.col("old_"), "full")
        compared = written(compared.select(F.coalesce("doc_id", "old_").alias("doc_id"), change.alias("change")), "changes")
        counted = compared.groupBy("change").agg(F.count(F.lit(1)).alias("n_chunks"))
        found = {x["change"] for x in counted.collect()}
        parts = []
        if found & {"added", "changed"}:
            todo = compared.filter("change IN ('added', 'changed')").select("doc_id")
            own = F.map_concat(F.coalesce("metadata", F.create_map().cast("map<string,string>")), F.create_map(F.lit(HASH), F.col("hash_")))
            made = new.join(todo, "doc_id", "left_semi") if "same" in found else new
            parts.append(made.select("doc_id", "content", own.alias("metadata"), embed.cast("array<float>").alias("embedding")))
        if "same" in found:
            same = compared.filter("change = 'same'").select("doc_id")
            kept = stored.join(same, "doc_id", "left_semi") if found & {"removed", "changed"} else stored
            parts.append(kept.select("doc_id", "content", "metadata", "embedding"))
        if not parts:
            self.delete(collection)
        elif found != {"same"}:
            # Files are staged beside the partition and take its place when all are there, so it can be read meanwhile.
            self.replace(reduce(DataFrame.unionByName, parts).withColumn("collection", F.lit(collection)))
        discard(twice)
        return counted

    def build_index(
        self, knowledge: DataFrame, schema: DataFrame, embed: Column, force: bool = False
    ) -> DataFrame:
        """Embed and store both chunk tables unless they are there; returns status and counts.

        ``embed`` is the caller's column expression or pandas UDF over ``content``. To follow later changes of
        the chunks, :meth:`sync` embeds only what changed.
        """
        status = "already_indexed"
        if force or not self.is_indexed():
            status = "indexed"
            parts = [
                chunks.select("content", "metadata", F.lit(name).alias("collection"))
                for name, chunks in ((KNOWLEDGE, knowledge), (SCHEMA, schema))
            ]
            numbered = dense_numbers(parts[0].unionByName(parts[1]), "collection", "content")
            self.replace(
                numbered.select(
                    F.concat("collection", F.lit("_"), F.col("number").cast("string")).alias("doc_id"),
                    "content",
                    "metadata",
                    embed.cast("array<float>").alias("embedding"),
                    "collection",
                )
            )
        return self.counts().withColumn("status", F.lit(status))
