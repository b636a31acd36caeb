"""JSON documents that describe the table and the business, as small relational tables.

Two documents are read: a schema document (table, hints, columns, enums, notes) and a knowledge
document (glossary, metrics, SQL patterns, business rules, question templates).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlens import fixed_values as fixed

_SCHEMA_DOCUMENT = """
  table_name string, `table` string, source string, description string,
  query_hints struct<
    default_time_grain: string,
    privacy: struct<no_identifier_output: boolean, k_anonymity_min_distinct_accounts: int>,
    cost_controls: struct<distinct_value_limit: int, result_row_limit: int>>,
  columns array<struct<name: string, type: string, description: string, is_categorical: boolean,
    enum: array<string>, values: array<string>,
    value_discovery: struct<enabled: boolean, `limit`: int>>>,
  enums map<string, variant>,
  metrics array<struct<name: string, description: string, sql: string>>,
  notes array<string>
"""

_KNOWLEDGE_DOCUMENT = """
  glossary struct<products: map<string,string>, terms: map<string,string>>,
  metrics map<string, array<struct<name: string, definition: string, sql: string>>>,
  sql_patterns map<string, struct<description: string, sql: string>>,
  business_rules array<string>,
  question_mapping array<struct<question_pattern: string, key_filters: string, aggregation: string>>
"""


def read_schema_document(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per document, which is a file or, with ``lines``, a line; both known layouts are read."""
    return spark.read.schema(_SCHEMA_DOCUMENT).json(path, multiLine=not lines)


def read_knowledge_document(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per document, which is a file or, with ``lines``, a line."""
    return spark.read.schema(_KNOWLEDGE_DOCUMENT).json(path, multiLine=not lines)


def sections(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """section and value (VARIANT) of each top-level entry of each document, known to a reader or not."""
    reader = spark.read.format("json").option("singleVariantColumn", "document").option("multiLine", not lines)
    exploded = spark.tvf.variant_explode(F.col("document").outer())
    return reader.load(path).lateralJoin(exploded).select(F.col("key").alias("section"), "value")


def unknown_sections(sections: DataFrame, known: Sequence[str]) -> DataFrame:
    """section, name and text of the entries of sections that none of the readers knows, so that nothing gets lost.

    An object or a list gives one row an entry, none if it is empty; anything else one row with the section's name.
    """
    other = sections.filter(~F.col("section").isin(list(known))).withColumnRenamed("value", "body")
    entries = other.lateralJoin(sections.sparkSession.tvf.variant_explode_outer(F.col("body").outer()))
    name = F.coalesce("key", F.col("pos").cast("string"), "section")
    plain = ~F.schema_of_variant("body").rlike("^(OBJECT|ARRAY)")
    return entries.filter(F.col("pos").isNotNull() | plain).select("section", name.alias("name"), F.coalesce("value", "body").cast("string").alias("text"))


def unknown_chunks(found: DataFrame) -> DataFrame:
    """content and metadata of :func:`unknown_sections`."""
    text = F.concat(F.col("section"), F.lit(" / "), F.col("name"), F.lit(": "), F.col("text"))
    return _chunk(found, text, "other", section=F.col("section"), name=F.col("name"))


# --- schema document ------------------------------------------------------------------------------


def columns(schema: DataFrame) -> DataFrame:
    """name, type, description, is_categorical, allowed values, and the limit for listing values."""
    return schema.select(F.posexplode("columns").alias("position", "c")).select(
        "position",
        "c.name",
        "c.type",
        "c.description",
        F.coalesce("c.is_categorical", F.lit(False)).alias("is_categorical"),
        F.coalesce("c.enum", "c.values").alias("allowed_values"),
        F.col("c.value_discovery.limit").alias("discovery_limit"),
    )


def column_info(schema: DataFrame, name: str) -> DataFrame:
    return columns(schema).filter(F.col("name") == name)


def enums(schema: DataFrame) -> DataFrame:
    """enum, value, meaning. Lists below a value are joined into its meaning."""
    entries = schema.select(F.explode("enums").alias("enum", "body"))
    maps = entries.select(
        "enum", F.explode(F.try_variant_get("body", "$", "map<string,variant>")).alias("value", "m")
    )
    text = F.coalesce(
        F.array_join(F.try_variant_get("m", "$", "array<string>"), ", "),
        F.try_variant_get("m", "$", "string"),
    )
    lists = entries.select(
        "enum", F.explode(F.try_variant_get("body", "$", "array<string>")).alias("value")
    )
    return maps.select("enum", "value", text.alias("meaning")).unionByName(
        lists.select("enum", "value", F.lit(None).cast("string").alias("meaning"))
    )


def enum_values(schema: DataFrame, enum: str) -> DataFrame:
    return enums(schema).filter(F.col("enum") == enum)


def notes(schema: DataFrame) -> DataFrame:
    return schema.select(F.posexplode("notes").alias("position", "note"))


def schema_metrics(schema: DataFrame) -> DataFrame:
    return schema.select(F.inline("metrics"))


# --- knowledge document ---------------------------------------------------------------------------


def glossary(knowledge: DataFrame) -> DataFrame:
    """category (product or term), term, definition."""
    parts = [
        knowledge.select(
            F.lit(category).alias("category"),
            F.explode(f"glossary.{field}").alias("term", "definition"),
        )
        for category, field in (("product", "products"), ("term", "terms"))
    ]
    return parts[0].unionByName(parts[1])


def metrics(knowledge: DataFrame, category: str | None = None) -> DataFrame:
    """category, name, definition, sql of the metrics of one category or of all."""
    listed = knowledge.select(F.explode("metrics").alias("category", "m"))
    table = listed.select("category", F.inline("m"))
    return table if category is None else table.filter(F.col("category") == category)


def sql_patterns(knowledge: DataFrame) -> DataFrame:
    return knowledge.select(F.explode("sql_patterns").alias("name", "p")).select("name", "p.*")


def business_rules(knowledge: DataFrame) -> DataFrame:
    return knowledge.select(F.posexplode("business_rules").alias("position", "rule"))


def question_mapping(knowledge: DataFrame) -> DataFrame:
    return knowledge.select(F.inline("question_mapping"))


def match_questions(questions: DataFrame, knowledge: DataFrame, column: str) -> DataFrame:
    """Questions with the filters and aggregation of their template, NULL when there is none.

    Templates are compared without case and outer blanks.
    """
    templates = question_mapping(knowledge).select(
        F.lower(F.trim("question_pattern")).alias("key_"), "key_filters", "aggregation"
    )
    keyed = questions.withColumn("key_", F.lower(F.trim(column)))
    return keyed.join(templates, "key_", "left").drop("key_")


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+)"), F.lit(1)))


def match_templates(
    questions: DataFrame, templates: DataFrame, question: str, pattern: str, least: float = 0.6
) -> DataFrame:
    """Each question with its best template: ``pattern``, n_shared and coverage, null when none covers enough.

    Coverage is the share of a template's distinct words (a-z and digits, without case) that the question has; the
    best template has the highest one, then the most words, then the first text. Templates are posted under their
    rarest words only: one that is covered by ``least`` shares a word of its first n - ceil(least n) + 1, so frequent
    words bring no pairs. Questions with equal text are matched once. Other columns of ``questions`` stay.
    """
    listed = templates.select(F.col(pattern).alias("t_")).filter(F.col("t_").isNotNull()).distinct()
    listed = listed.withColumn("words_", _tokens(F.col("t_"))).filter(F.size("words_") > 0)
    posted = listed.select("t_", F.explode("words_").alias("word_"))
    often = posted.groupBy("word_").agg(F.count(F.lit(1)).alias("often_"))
    rarest = posted.join(often, "word_").groupBy("t_").agg(F.sort_array(F.collect_list(F.struct("often_", "word_"))).alias("by_rarity_"))
    needed = F.ceil(F.lit(least) * F.size("by_rarity_")).cast("int")
    prefix = F.slice("by_rarity_", F.lit(1), F.size("by_rarity_") - needed + 1)
    posts = rarest.select("t_", F.transform("by_rarity_", lambda x: x["word_"]).alias("words_"), F.explode(prefix).alias("post_"))
    posts = posts.select("t_", "words_", F.col("post_.word_").alias("word_"))

    asked = questions.select(F.col(question).alias("q_")).filter(F.col("q_").isNotNull()).distinct()
    asked = asked.withColumn("own_", _tokens(F.col("q_")))
    met = asked.withColumn("word_", F.explode("own_")).join(posts, "word_")
    shared = F.size(F.array_intersect("own_", "words_"))
    coverage = shared / F.size("words_")
    pairs = met.select("q_", "t_", shared.alias("n_shared"), coverage.alias("coverage")).distinct()
    order = F.struct(-F.col("coverage"), -F.col("n_shared"), F.col("t_"))
    best = F.min_by(F.struct(F.col("t_").alias(pattern), "n_shared", "coverage"), order).alias("best_")
    found = pairs.filter(F.col("coverage") >= least).groupBy("q_").agg(best).select("q_", "best_.*")
    return questions.join(found, F.col(question) == F.col("q_"), "left").drop("q_")


# --- text chunks for retrieval --------------------------------------------------------------------


def _lines(*parts: tuple[str, Column]) -> Column:
    """Lines of a label and its value; a line without a value goes."""
    return F.concat_ws("\n", *[F.concat(F.lit(label), value) for label, value in parts])


def _chunk(df: DataFrame, text: Column, kind: str, **metadata: Column) -> DataFrame:
    pairs = [F.lit("type"), F.lit(kind)]
    for key, value in metadata.items():
        pairs += [F.lit(key), value.cast("string")]
    return df.select(text.alias("content"), F.create_map(*pairs).alias("metadata"))


def knowledge_chunks(knowledge: DataFrame) -> DataFrame:
    """content and metadata of every glossary entry, metric, pattern, rule and question template."""
    c = F.col
    terms = glossary(knowledge)
    label = fixed.CHUNK_LABELS
    product = _lines((label["product"], c("term")), (label["definition"], c("definition")))
    business = _lines((label["business"], c("term")), (label["definition"], c("definition")))
    metric = _lines(
        (label["metric"], c("name")),
        (label["category"], c("category")),
        (label["definition"], c("definition")),
        (label["pattern"], c("sql")),
    )
    pattern = _lines(
        (label["pattern"], c("name")), (label["description"], c("description")), (label["example"], c("sql"))
    )
    question = _lines(
        (label["question"], c("question_pattern")),
        (label["filters"], F.coalesce("key_filters", F.lit("None"))),
        (label["aggregation"], c("aggregation")),
    )
    parts = [
        _chunk(
            terms,
            F.when(c("category") == "product", product).otherwise(business),
            "glossary",
            category=c("category"),
            term=c("term"),
        ),
        _chunk(metrics(knowledge), metric, "metric", category=c("category"), name=c("name")),
        _chunk(sql_patterns(knowledge), pattern, "sql_pattern", name=c("name")),
        _chunk(
            business_rules(knowledge),
            _lines((label["rule"], c("rule"))),
            "business_rule",
            index=c("position"),
        ),
        _chunk(
            question_mapping(knowledge), question, "question_mapping", pattern=c("question_pattern")
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


def column_chunks(schema: DataFrame) -> DataFrame:
    """Short form of the column descriptions, one 'name: description' line each."""
    text = F.concat_ws(": ", "name", "description")
    return _chunk(columns(schema), text, "column", column_name=F.col("name"))


def schema_chunks(schema: DataFrame) -> DataFrame:
    """content and metadata of the table, its hints, columns, enum values and notes."""
    c, label = F.col, fixed.CHUNK_LABELS
    table = F.coalesce("table_name", "table", F.lit("events"))
    guidelines = F.concat(
        F.lit(label["guidelines"]),
        table,
        F.lit(label["grain"]),
        F.coalesce("query_hints.default_time_grain", F.lit("month")),
        F.lit(label["privacy"]),
        F.coalesce("query_hints.privacy.k_anonymity_min_distinct_accounts", F.lit(10)),
        F.lit(label["identifiers"]),
        F.initcap(
            F.coalesce("query_hints.privacy.no_identifier_output", F.lit(True)).cast("string")
        ),
        F.lit(label["row_limit"]),
        F.coalesce("query_hints.cost_controls.result_row_limit", F.lit(200)),
    )
    listed = columns(schema)
    column_text = F.concat_ws(
        "\n",
        _lines(
            (label["column"], c("name")), (label["type"], c("type")), (label["description"], c("description"))
        ),
        F.when(c("is_categorical"), label["categorical"]),
        F.concat(F.lit(label["allowed"]), F.array_join("allowed_values", ", ")),
    )
    enum_text = F.concat(
        F.lit(label["enum_value"]),
        c("enum"),
        F.lit(" = '"),
        c("value"),
        F.lit(label["meaning"]),
        c("meaning"),
    )
    valued = enums(schema).filter(c("meaning").isNotNull())
    bare = enums(schema).filter(c("meaning").isNull()).groupBy("enum")
    bare_values = bare.agg(F.array_join(F.sort_array(F.collect_set("value")), ", ").alias("values"))
    parts = [
        _chunk(schema, _lines((label["table"], table), (label["description"], c("description"))), "table_overview", table=table),
        _chunk(schema.filter(c("query_hints").isNotNull()), guidelines, "query_hints", table=table),
        _chunk(listed, column_text, "column", column_name=c("name"), column_type=c("type")),
        _chunk(valued, enum_text, "enum", enum_name=c("enum"), value=c("value")),
        _chunk(bare_values, _lines((label["enum"], c("enum")), (label["values"], c("values"))), "enum", enum_name=c("enum")),
        _chunk(notes(schema), _lines((label["note"], c("note"))), "note", index=c("position")),
    ]
    return reduce(DataFrame.unionByName, parts)


# --- schema description of any table ----------------------------------------------------------------


def describe(df: DataFrame) -> DataFrame:
    """position, column and type of a table; no job is started."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, type string")


def describe_with_samples(df: DataFrame, key: str, n: int = 3) -> DataFrame:
    """position, column, type and the column's values in the first ``n`` rows by ``key``."""
    sample = df.orderBy(key).limit(n)
    keyed = F.struct(F.col(key).alias("key_"), F.struct("*").alias("row_"))
    rows = sample.agg(F.sort_array(F.collect_list(keyed))["row_"].alias("rows"))

    def values(name: str) -> Column:
        return F.array_join(F.col(f"rows.{name}").cast("array<string>"), " | ", "None")

    entries = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("type"),
            values(f.name).alias("samples"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return rows.select(F.inline(F.array(*entries)))
