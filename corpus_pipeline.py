"""From documents to training shards in five stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlens.llm import minhash, mixing, outliers, tiling, token_shards
from quorumlens.llm.common import n_words
from quorumlens.session import scratch_path, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source.

    A null or empty text fails the base rules. Repeated rows are judged alike; other columns stay as they are.
    """
    return outliers.kept(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8), the one with the smallest doc_id.

    Of rows that share a doc_id, or have none and share a text, the one with the smallest text hash stays (of equal
    ones any). Documents without words are linked with nothing and stay.
    """
    found = minhash.near_duplicates(docs)
    first = found.where("doc_id = component_id").select("doc_id").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.xxhash64("text").alias("hash"))
    rows = rows.where("doc_id IS NOT NULL").join(first, "doc_id", "left_semi").unionByName(rows.where("doc_id IS NULL"))
    place = "row_number() OVER (PARTITION BY doc_id, if(doc_id IS NULL, hash, 0) ORDER BY hash)"
    return rows.withColumn("place", F.expr(place)).where("place = 1").select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark.

    A document without text holds none; repeated rows go or stay together.
    """
    return tiling.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice.

    Rows with equal doc_id and text are one document of the mix, whose size counts for each row; each of them is
    returned as often as the mix takes the document. A null source is a source, a document without words
    takes no quota.
    """
    key = F.xxhash64("doc_id", "text")
    sized = written(docs.select(key.alias("key"), "source", n_words(F.col("text")).alias("size")), "sizes")
    held = sized.groupBy("source").agg(F.sum("size").alias("size")).collect()
    quota = mixing.quotas([(r["source"], r["size"]) for r in held])
    mixed = mixing.mix(sized.select("key", F.array("source").alias("members"), "size"), quota)
    # Of rows that share a key the mix may take some more often than others; the least number counts for all.
    taken = mixed.groupBy("key").agg(F.min("copies").alias("copies")).where("copies > 0")
    rows = docs.select(F.struct(*docs.columns).alias("row"), key.alias("key")).join(taken, "key")
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).select("row.*")


def training_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences of the shards, as read back.

    A null or empty text is one sequence of an end token; repeated rows are written repeatedly.
    """
    path = scratch_path(spark, "training-shards")
    size = token_shards.write_shards(docs, path)
    return token_shards.read_shards(spark, path, size).drop("tokens")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("source_mix", source_mix),
    ("training_shards", training_shards),
]

#: SQL cannot express greedy tiling, min-cost flow or the keyed permutation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what a stage returns is written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
