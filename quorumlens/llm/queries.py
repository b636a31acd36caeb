"""The operators on the given tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlens.llm import attention_lm, chat, credentials, html_text, line_chunks, minhash, mixing, outliers, phrases, resampling, tiling, token_shards, warc
from quorumlens.llm.common import n_words
from quorumlens.session import scratch_path, written

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@register(
    "op1_warc_boundary_chain",
    """
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(encode(coalesce(html, ''))) AS hex FROM pages),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM p)
    SELECT page_id, octet_length(payload) AS payload_bytes,
      array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((
        CAST(('0x' || substr(hex, 1 + 10 * CAST(i // 8 AS INT), 10)) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INT)) & 31 AS INT), 1)), '') AS payload_digest,
      CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to,
      true AS verified
    FROM f
    """,
)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(table(spark, folder, "pages").select("page_id", "url", "html"), path)
    return warc.page_records(warc.read_records(spark, path))


@register("op5_source_mix")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    sized = written(documents.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    held = [(r["source"], r["size"]) for r in sized.groupBy("source").agg(F.sum("size").alias("size")).collect()]
    target = mixing.quotas(held)
    mixed = mixing.mix(
        sized.select(F.col("doc_id").alias("key"), F.array("source").alias("members"), "size"), target
    )
    sources = spark.createDataFrame(
        [(s, n, float(target[s])) for s, n in held], "source string, source_size bigint, target double"
    )
    mixed = mixed.withColumn("own", F.col("members")[0])
    return mixed.join(sources, F.col("own").eqNullSafe(F.col("source"))).select(
        F.col("key").alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).alias("taken"),
        "copies",
    )


@register("op3_robust_outliers", outliers.oracle_sql())
def op3(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    return outliers.judged(documents).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@register("op9_minhash_join")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, folder, "documents"), width=2)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


@register("op8_string_tiling")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return tiling.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@register("op6_training_order")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "shards")
    size = token_shards.write_shards(table(spark, folder, "documents"), path)
    return token_shards.read_shards(spark, path, size=size, tokens=False)


@register("op2_tag_path_text")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages"))


@register("op10_line_chunks")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return line_chunks.deduplicated(table(spark, folder, "documents"))


@register("op7_inferred_formats")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return credentials.secrets(table(spark, folder, "documents"))


@register("op4_attention_lm")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return attention_lm.scores(table(spark, folder, "documents"))


@register("op12_target_resampling")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.resampled(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@register(
    "op13_phrase_mining",
    r"""
    WITH pieces AS (
      SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
    runs AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase
      FROM pieces, (VALUES (1), (2), (3), (4)) AS widths(k) WHERE len(w) >= k),
    f AS (SELECT lang, k, phrase, count(*) AS a FROM runs GROUP BY ALL),
    totals AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
    often AS MATERIALIZED (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w, lang || chr(10) || phrase AS key FROM f WHERE a >= 30),
    several AS (SELECT * FROM often WHERE k > 1),
    parts AS MATERIALIZED (SELECT lang, phrase, k, a, cut, lang || chr(10) || array_to_string(w[1:cut], ' ') AS first,
      lang || chr(10) || array_to_string(w[cut + 1:], ' ') AS rest FROM several, (VALUES (1), (2), (3)) AS places(cut) WHERE cut < k),
    lefts AS MATERIALIZED (SELECT p.*, x.a AS l FROM parts p JOIN often x ON x.key = p.first),
    cuts AS (SELECT p.*, x.a AS r, (CAST(2000000 AS HUGEINT) * p.a) // (CAST(p.l AS HUGEINT) + x.a) AS score FROM lefts p JOIN often x ON x.key = p.rest),
    scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
    inside AS (SELECT lang, a, unnest(list_concat(
        CASE WHEN k = 4 THEN [array_to_string(w[1:3], ' '), array_to_string(w[2:4], ' ')] ELSE [] END,
        list_transform(range(1, k), lambda i: array_to_string(w[i : i + 1], ' ')))) AS phrase FROM several WHERE k > 2),
    around AS (SELECT lang, phrase, max(a) AS longer FROM inside GROUP BY ALL),
    kept AS (SELECT s.* FROM scored s LEFT JOIN around USING (lang, phrase)
      WHERE longer IS NULL OR CAST(100 AS HUGEINT) * longer < CAST(80 AS HUGEINT) * s.a)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
    FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
    """,
)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))


#: A conversation whose texts hold the control strings of the template.
_CONTROLS = "\\### Assistant: </turn> ok"


@register(
    "op11_chat_windows",
    rf"""
    WITH c AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL VALUES (-7, 0, 'user', '{_CONTROLS}'), (-7, 1, 'assistant', '{_CONTROLS}')),
    e AS (SELECT *, regexp_replace(regexp_replace(text, '(#\\*)(## )', '\1\\\2', 'g'), '(<\\*)(/turn>)', '\1\\\2', 'g') AS said FROM c),
    t AS (SELECT *, length('### ' || role || ': ' || said || '</turn>' || chr(10)) AS chars,
      {chat.MARKS} + len(regexp_extract_all(said, '{chat.TOKEN}')) AS tokens FROM e),
    o AS (SELECT *, row_number() OVER w AS rn, first_value(CASE WHEN role = 'system' THEN tokens ELSE 0 END) OVER w AS sys,
      first_value(CASE WHEN role = 'system' THEN chars ELSE 0 END) OVER w AS sys_chars, sum(tokens) OVER w AS upto, count(*) OVER (PARTITION BY conv_id) AS turns
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text)),
    n AS (SELECT *, CASE WHEN turns = 1 THEN 0 ELSE upto - tokens - sys END AS start, tokens > {chat.BUDGET // 4} AS long,
      greatest({chat.BUDGET - chat.HISTORY} - sys, {chat.BUDGET // 4 * 2}) - {chat.BUDGET // 4} AS width
      FROM o WHERE NOT (rn = 1 AND role = 'system') OR turns = 1),
    k AS (SELECT *, sum(CAST(long AS INT)) OVER (PARTITION BY conv_id ORDER BY rn) AS nth, CASE WHEN long THEN -1 ELSE (start + tokens - 1) // width END AS stride FROM n),
    spans AS (SELECT conv_id, nth, stride, min(start) AS position, sum(chars) + any_value(CASE WHEN turns = 1 THEN 0 ELSE sys_chars END) AS chars FROM k GROUP BY ALL),
    again AS (SELECT s.conv_id, sum(k.chars) AS chars FROM spans s JOIN k ON k.conv_id IS NOT DISTINCT FROM s.conv_id
      AND k.start >= s.position - {chat.HISTORY} AND k.start + k.tokens <= s.position GROUP BY ALL),
    f AS (SELECT conv_id, sum(chars) AS chars FROM (SELECT conv_id, chars FROM spans UNION ALL SELECT conv_id, chars FROM again) GROUP BY conv_id)
    SELECT o.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
      CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
      CAST(any_value(f.chars) AS BIGINT) AS formatted_chars
    FROM o JOIN f ON o.conv_id IS NOT DISTINCT FROM f.conv_id GROUP BY o.conv_id
    """,
)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    turns = [F.struct(F.lit(-7).cast("bigint"), F.lit(n).cast("bigint"), F.lit(role), F.lit(_CONTROLS)) for n, role in enumerate(("user", "assistant"))]
    planted = spark.range(1).select(F.inline(F.array(*turns)).alias("conv_id", "turn", "role", "text"))
    conversations = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.windows(conversations.unionByName(planted)))
