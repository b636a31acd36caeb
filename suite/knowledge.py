"""Knowledge and schema documents written from the part table, read back as tables and as chunks for retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorumlens.session import scratch_path
from quorumlens.sources import catalog
from suite import bindings as b
from suite.registry import register

#: Parts of one brand in one document, by part number.
BLOCK = 200

_P = f"""p AS (SELECT *, p_brand || ' ' || p_partkey // {BLOCK} AS doc, CAST(p_partkey AS VARCHAR) AS key FROM part),
  d AS (SELECT DISTINCT doc, p_brand FROM p)"""


def _parts(spark, folder):
    part = b.table(spark, folder, "part")
    doc = F.concat_ws(" ", "p_brand", F.expr(f"p_partkey div {BLOCK}"))
    return part.withColumns({"doc": doc, "key": F.col("p_partkey").cast("string")}).groupBy("doc", "p_brand")


def _some(condition: str, *fields):
    """The fields of the rows that meet a condition, as a list of structs in order."""
    return F.sort_array(F.collect_list(F.when(F.expr(condition), F.struct(*fields))))


def _named(prefix: str):
    return F.concat(F.lit(prefix), F.col("key"))


def _stored(spark, documents, name):
    path = scratch_path(spark, name)
    documents.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    return path


def _knowledge(spark, folder):
    documents = _parts(spark, folder).agg(
        F.map_from_entries(_some("true", _named("part ").alias("k"), F.col("p_name").alias("v"))).alias("terms"),
        _some("p_size > 40", _named("Stock ").alias("name"), F.col("p_name").alias("definition"), _named("SUM(x").alias("sql")).alias("retail"),
        F.transform(_some("p_partkey % 50 = 0", _named("rule ").alias("r")), lambda x: x["r"]).alias("rules"),
        _some(
            "p_partkey % 70 = 0",
            _named("How many ").alias("question_pattern"),
            F.when(F.col("p_size") > 25, _named("p_partkey = ")).alias("key_filters"),
            F.lit("COUNT(*)").alias("aggregation"),
        ).alias("question_mapping"),
        F.map_from_entries(_some("p_partkey % 30 = 0", _named("s").alias("k"), F.col("p_type").alias("v"))).alias("suppliers"),
    )
    pattern = F.struct(F.col("p_brand").alias("description"), F.lit("SELECT 1").alias("sql"))
    shaped = documents.select(
        F.struct(F.create_map("doc", "p_brand").alias("products"), "terms").alias("glossary"),
        F.create_map(F.lit("retail"), "retail").alias("metrics"),
        F.create_map("doc", pattern).alias("sql_patterns"),
        F.col("rules").alias("business_rules"),
        "question_mapping",
        "suppliers",
        F.length("doc").alias("version"),
    )
    return _stored(spark, shaped, "knowledge")


_ENTRIES = """
  SELECT 'glossary' AS type, 'Product Term: ' || doc || chr(10) || 'Definition: ' || p_brand AS content FROM d
  UNION ALL SELECT 'glossary', 'Business Term: part ' || key || chr(10) || 'Definition: ' || p_name FROM p
  UNION ALL SELECT 'metric', 'Metric: Stock ' || key || chr(10) || 'Category: retail' || chr(10) || 'Definition: ' || p_name
    || chr(10) || 'SQL Pattern: SUM(x' || key FROM p WHERE p_size > 40
  UNION ALL SELECT 'sql_pattern', 'SQL Pattern: ' || doc || chr(10) || 'Description: ' || p_brand || chr(10) || 'Example SQL: SELECT 1' FROM d
  UNION ALL SELECT 'business_rule', 'Business Rule: rule ' || key FROM p WHERE p_partkey % 50 = 0
  UNION ALL SELECT 'question_mapping', 'Question Pattern: How many ' || key || chr(10) || 'Key Filters: '
    || CASE WHEN p_size > 25 THEN 'p_partkey = ' || key ELSE 'None' END || chr(10) || 'Aggregation: COUNT(*)' FROM p WHERE p_partkey % 70 = 0"""


@register("knowledge_chunks", f"WITH {_P} {_ENTRIES}")
def knowledge_chunks(spark, folder):
    documents = catalog.read_knowledge_document(spark, _knowledge(spark, folder), lines=True)
    return catalog.knowledge_chunks(documents).select(F.col("metadata")["type"].alias("type"), "content")


_KNOWN = ["glossary", "metrics", "sql_patterns", "business_rules", "question_mapping"]


@register(
    "unknown_sections",
    f"""WITH {_P} SELECT 'suppliers' AS section, 's' || key AS name, p_type AS text FROM p WHERE p_partkey % 30 = 0
       UNION ALL SELECT 'version', 'version', CAST(length(doc) AS VARCHAR) FROM d""",
)
def unknown_sections(spark, folder):
    """What no reader of knowledge documents knows is still found."""
    found = catalog.sections(spark, _knowledge(spark, folder), lines=True)
    return catalog.unknown_sections(found, _KNOWN)


def _schema(spark, folder):
    even = F.col("p_partkey") % 2 == 0
    documents = _parts(spark, folder).agg(
        _some(
            "p_size < 10",
            F.concat(F.lit("c"), F.col("p_partkey") % 100).alias("name"),
            F.col("p_type").alias("type"),
            F.col("p_name").alias("description"),
            even.alias("is_categorical"),
            F.when(even, F.array("p_name", "p_brand")).alias("enum"),
            "key",
        ).alias("columns"),
        F.map_from_entries(_some("p_partkey % 20 = 0", _named("v").alias("k"), F.col("p_type").alias("v"))).alias("valued"),
        F.transform(_some("p_partkey % 25 = 0", "key"), lambda x: x["key"]).alias("bare"),
        F.transform(_some("p_partkey % 40 = 0", _named("note ").alias("n")), lambda x: x["n"]).alias("notes"),
    )
    hints = F.struct(
        F.lit("week").alias("default_time_grain"),
        F.struct(F.lit(True).alias("no_identifier_output"), F.lit(7).alias("k_anonymity_min_distinct_accounts")).alias("privacy"),
        F.struct(F.lit(9).alias("distinct_value_limit"), F.lit(50).alias("result_row_limit")).alias("cost_controls"),
    )
    enums = F.struct(F.col("valued").alias("kind"))
    shaped = documents.select(
        F.col("doc").alias("table_name"), F.col("p_brand").alias("description"), hints.alias("query_hints"), "columns", enums.alias("enums"), "notes"
    )
    return _stored(spark, shaped, "schema")


_COLUMNS = "'c' || p_partkey % 100"


@register(
    "schema_chunks",
    f"""WITH {_P}
       SELECT 'table_overview' AS type, 'Table: ' || doc || chr(10) || 'Description: ' || p_brand AS content FROM d
       UNION ALL SELECT 'query_hints', 'Query Guidelines for ' || doc || ':' || chr(10) || '- Default time grain: week' || chr(10)
         || '- Privacy: k-anonymity minimum 7 accounts' || chr(10) || '- No identifiers in output: True' || chr(10) || '- Result row limit: 50' FROM d
       UNION ALL SELECT 'column', 'Column: ' || {_COLUMNS} || chr(10) || 'Type: ' || p_type || chr(10) || 'Description: ' || p_name
         || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || 'Categorical: Yes' || chr(10) || 'Possible values: ' || p_name || ', ' || p_brand ELSE '' END
         FROM p WHERE p_size < 10
       UNION ALL SELECT 'enum', 'Enum Value: kind = ''v' || key || '''' || chr(10) || 'Meaning: ' || p_type FROM p WHERE p_partkey % 20 = 0
       UNION ALL SELECT 'note', 'Schema Note: note ' || key FROM p WHERE p_partkey % 40 = 0""",
)
def schema_chunks(spark, folder):
    documents = catalog.read_schema_document(spark, _schema(spark, folder), lines=True)
    return catalog.schema_chunks(documents).select(F.col("metadata")["type"].alias("type"), "content")


@register("column_chunks", f"SELECT {_COLUMNS} || ': ' || p_name AS content, {_COLUMNS} AS column_name FROM part WHERE p_size < 10")
def column_chunks(spark, folder):
    documents = catalog.read_schema_document(spark, _schema(spark, folder), lines=True)
    return catalog.column_chunks(documents).select("content", F.col("metadata")["column_name"].alias("column_name"))


@register(
    "column_lookup",
    f"""SELECT {_COLUMNS} AS name, p_type AS type, p_name AS description, p_partkey % 2 = 0 AS is_categorical,
         CASE WHEN p_partkey % 2 = 0 THEN p_name || ', ' || p_brand END AS allowed FROM part WHERE p_size < 10 AND p_partkey % 100 IN (20, 21)""",
)
def column_lookup(spark, folder):
    documents = catalog.read_schema_document(spark, _schema(spark, folder), lines=True)
    found = catalog.column_info(documents, "c20").unionByName(catalog.column_info(documents, "c21"))
    allowed = F.array_join("allowed_values", ", ").alias("allowed")
    return found.select("name", "type", "description", "is_categorical", allowed)


@register(
    "template_match",
    """WITH templates AS (SELECT DISTINCT array_to_string(string_split(text, ' ')[1:8], ' ') AS t FROM conversations WHERE turn = 0 AND conv_id % 5 = 0),
         tw AS (SELECT t, list_distinct(regexp_extract_all(lower(t), '[a-z0-9]+')) AS w FROM templates),
         qw AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM conversations WHERE role = 'user'),
         pairs AS (SELECT conv_id, turn, t, len(list_intersect(qw.w, tw.w)) AS shared, len(tw.w) AS n FROM qw, tw WHERE len(tw.w) > 0),
         best AS (SELECT * FROM pairs WHERE shared / n >= 0.6
           QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY shared / n DESC, shared DESC, t) = 1)
       SELECT q.conv_id, q.turn, b.t AS template, CAST(b.shared AS BIGINT) AS n_shared, round(b.shared / b.n, 9) AS coverage
       FROM qw q LEFT JOIN best b ON q.conv_id = b.conv_id AND q.turn = b.turn""",
)
def template_match(spark, folder):
    """Every question of the conversations with the template, taken from first turns, that covers it best."""
    said = b.table(spark, folder, "conversations")
    first = F.array_join(F.slice(F.split("text", " "), 1, 8), " ")
    templates = said.filter("turn = 0 AND conv_id % 5 = 0").select(first.alias("template"))
    questions = said.filter("role = 'user'").select("conv_id", "turn", "text")
    matched = catalog.match_templates(questions, templates, "text", "template")
    return matched.select("conv_id", "turn", "template", "n_shared", F.round("coverage", 9).alias("coverage"))
