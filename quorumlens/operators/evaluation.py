"""Evaluation analytics over the query log and over agent traces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlens import fixed_values as fixed
from quorumlens.functions import scoring, terms
from quorumlens.operators import triage
from quorumlens.session import enable_checkpoints

# --- scores ---------------------------------------------------------------------------------------


def self_eval(log: DataFrame) -> DataFrame:
    """Log rows with the component scores, overall score, confidence, issues and stored score."""
    scored = log.withColumns(scoring.components())
    rated = scored.withColumn("overall", scoring.overall())
    return rated.withColumns(
        {
            "confidence": scoring.confidence(F.col("overall")),
            "issues": scoring.issues(),
            "stored_self_score": scoring.stored_score(),
        }
    )


def score_bands(scored: DataFrame, score: str = "overall") -> DataFrame:
    return scored.groupBy(scoring.band(F.col(score)).alias("stars")).agg(
        F.count(F.lit(1)).alias("n")
    )


def counts_by_day(df: DataFrame, ts: str, *dims: str | Column) -> DataFrame:
    return df.groupBy(F.to_date(ts).alias("day"), *dims).agg(F.count(F.lit(1)).alias("n"))


# --- log statistics -------------------------------------------------------------------------------


def _mean(column: str, digits: int) -> Column:
    """Average rounded half up; exact for columns with up to six decimals."""
    total = F.sum(F.col(column).cast("decimal(28,6)"))
    return F.round(F.try_divide(total, F.count(column).cast("decimal(18,0)")), digits)


def _percent(part: Column, whole: Column, digits: int = 1) -> Column:
    share = F.try_divide(part.cast("decimal(18,0)") * 100, whole.cast("decimal(18,0)"))
    return F.round(F.coalesce(share, F.lit(0)), digits)


def stats(log: DataFrame) -> DataFrame:
    """One row: totals, averages of the known values, error rate and share of rated queries."""
    rows = F.count(F.lit(1))
    return log.agg(
        rows.alias("total_queries"),
        _mean("self_score", 2).alias("avg_self_score"),
        _mean("user_score", 2).alias("avg_user_score"),
        _mean("latency_ms", 2).alias("avg_latency_ms"),
        _mean("total_tokens", 0).alias("avg_tokens"),
        _percent(F.count_if(F.col("error_count") > 0), rows).alias("error_rate"),
        _percent(F.count("user_score"), rows).alias("rated_percentage"),
    )


def correlation(log: DataFrame, x: str = "self_score", y: str = "user_score") -> DataFrame:
    """One row: pairs, Pearson r to three places (NULL below 3 pairs or without variance), label.

    Plain sums combine before the shuffle, and the guarded formula gives NULL where the built-in
    function would divide by zero.
    """
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    sums = log.filter(both).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.sum(a).alias("sx"),
        F.sum(b).alias("sy"),
        F.sum(a * b).alias("sxy"),
        F.sum(a * a).alias("sxx"),
        F.sum(b * b).alias("syy"),
    )
    n = F.col("n_pairs")
    top = n * F.col("sxy") - F.col("sx") * F.col("sy")
    spread_x = n * F.col("sxx") - F.col("sx") * F.col("sx")
    spread_y = n * F.col("syy") - F.col("sy") * F.col("sy")
    usable = (n >= 3) & (spread_x > 0) & (spread_y > 0)
    r = F.when(usable, F.try_divide(top, F.sqrt(spread_x * spread_y)))
    return sums.select(n, F.round(r, 3).alias("r")).withColumn(
        "label", scoring.correlation_label(F.col("r"))
    )


def feedback_stats(log: DataFrame) -> DataFrame:
    """Rated and unrated queries, counted exactly, with the correlation of both scores."""
    rated = F.count("user_score")
    r = correlation(log).select("r").scalar()
    return log.agg(
        F.count(F.lit(1)).alias("total_queries"),
        rated.alias("rated_queries"),
        (F.count(F.lit(1)) - rated).alias("unrated_queries"),
        _percent(rated, F.count(F.lit(1))).alias("feedback_rate"),
    ).withColumn("score_correlation", r)


def improvement_insights(log: DataFrame, themes: int = 3) -> DataFrame:
    """One row: low-rated queries, those with errors, those without rows, newest comments."""
    low = log.filter(F.col("user_score") <= 2)
    commented = low.filter(F.length("user_feedback") > 0)
    newest = commented.orderBy(F.desc("created_at"), "id").limit(themes)
    listed = F.sort_array(
        F.collect_list(F.struct(F.col("created_at"), F.col("user_feedback"))), asc=False
    )
    comments = newest.agg(
        F.array_join(F.transform(listed, lambda c: c["user_feedback"]), "; ").alias("t")
    )
    return low.agg(
        F.count(F.lit(1)).alias("low_rated"),
        F.count_if(F.col("error_count") > 0).alias("with_errors"),
        F.count_if(F.coalesce("row_count", F.lit(0)) == 0).alias("without_rows"),
    ).withColumn("themes", comments.scalar())


def sql_validity(log: DataFrame, ts: str = "created_at") -> DataFrame:
    """Checked and acceptable SQL texts per day."""
    ok = F.count_if(F.col("verdict.allowed"))
    return triage.sql(log, "sql_query").groupBy(F.to_date(ts).alias("day")).agg(
        F.count("sql_query").alias("sql_total"),
        ok.alias("sql_valid"),
        terms.ratio(ok, F.count("sql_query")).alias("validity_rate"),
    )


# --- metric samples -------------------------------------------------------------------------------


def metric_summary(samples: DataFrame) -> DataFrame:
    """Average and number of samples per metric name."""
    return samples.groupBy("name").agg(
        terms.ratio(F.sum("value"), F.count("value")).alias("average"),
        F.count("value").alias("samples"),
    )


def counters(increments: DataFrame) -> DataFrame:
    return increments.groupBy("name").agg(F.sum("amount").alias("total"))


def agent_latency(traces: DataFrame) -> DataFrame:
    """Runs and average duration per agent, with the total of all agents as ``latency_total``."""
    timed = traces.filter(F.col("duration_ms").isNotNull())
    per_agent = timed.groupBy("agent_name").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("duration_ms").alias("ms")
    )
    # the total comes from the agents' sums, not from a second copy of the traces
    return (
        per_agent.rollup("agent_name")
        .agg(
            F.sum("runs").alias("runs"),
            terms.ratio(F.sum("ms"), F.sum("runs")).alias("average_ms"),
            F.grouping("agent_name").alias("all_"),
        )
        .select(
            F.when(F.col("all_") == 1, F.lit("latency_total"))
            .otherwise(F.concat(F.lit("latency_"), "agent_name"))
            .alias("metric"),
            "runs",
            "average_ms",
        )
    )


def session_rollup(traces: DataFrame) -> DataFrame:
    """Tokens, duration, traces and distinct errors per session."""
    error = F.when(
        F.col("error").isNotNull(), F.concat("agent_name", F.lit(": "), F.col("error"))
    )
    return traces.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_traces"),
        F.sum("tokens_used").alias("total_tokens"),
        F.sum("duration_ms").alias("total_duration_ms"),
        F.countDistinct(error).alias("distinct_errors"),
    )


def session_errors(traces: DataFrame) -> DataFrame:
    """The distinct error texts of each session, one row each."""
    failed = traces.filter(F.col("error").isNotNull())
    text = F.concat("agent_name", F.lit(": "), F.col("error")).alias("error")
    return failed.select("session_id", text).distinct()


# --- stages ---------------------------------------------------------------------------------------


def _stage_flags(traces: DataFrame, stages: Sequence[str]) -> DataFrame:
    """Per session one number per stage: 2 completed, 1 only begun, 0 not run."""
    level = F.when(F.col("action") == "completed", 2).otherwise(1)
    return traces.groupBy("session_id").agg(
        *[
            F.coalesce(F.max(F.when(F.col("agent_name") == s, level)), F.lit(0)).alias(s)
            for s in stages
        ]
    )


def stage_status(traces: DataFrame, stages: Sequence[str] = tuple(fixed.STAGES)) -> DataFrame:
    """completed, started or not_run for every session and stage."""
    flags = _stage_flags(traces, stages).unpivot(["session_id"], list(stages), "stage", "flag")
    status = F.when(F.col("flag") == 2, "completed").when(F.col("flag") == 1, "started")
    return flags.select("session_id", "stage", status.otherwise("not_run").alias("status"))


def stage_funnel(traces: DataFrame, stages: Sequence[str] = tuple(fixed.STAGES)) -> DataFrame:
    """How many sessions wait at which stage: the first one, in order, that is not completed."""
    waiting = F.coalesce(*[F.when(F.col(s) < 2, s) for s in stages], F.lit("end"))
    return (
        _stage_flags(traces, stages)
        .groupBy(waiting.alias("next_stage"))
        .agg(F.count(F.lit(1)).alias("sessions"))
    )


def sessions_with_stage(sessions: DataFrame, traces: DataFrame, stage: str) -> DataFrame:
    """Sessions in which a stage completed. The stage side is reduced to one row per session first."""
    done = traces.filter((F.col("agent_name") == stage) & (F.col("action") == "completed"))
    return sessions.join(done.select("session_id").distinct(), "session_id", "left_semi")


# --- spans ----------------------------------------------------------------------------------------


def span_durations(spans: DataFrame) -> DataFrame:
    """Spans with duration in milliseconds, NULL while unfinished. Times are epoch milliseconds."""
    return spans.withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))


def span_paths(spans: DataFrame, max_rounds: int = 32) -> DataFrame:
    """Path of names from the root and depth (0 for a root) of every span of a flat span table.

    Every round doubles the number of ancestors a span knows, so a tree of depth d needs about
    log2(d) equi-joins on the unique (trace, span) key; a large trace is spread over all tasks. Each
    round is checkpointed to keep the plan short. A path longer than its trace has spans is a cycle.
    """
    enable_checkpoints(spans.sparkSession)
    key = ["trace_id", "span_id"]
    # above: nearest ancestor that is not yet part of the path; nodes: names in the path
    sizes = spans.groupBy("trace_id").agg(F.count(F.lit(1)).alias("spans_"))
    state = spans.join(sizes, "trace_id").select(
        *key,
        "spans_",
        F.col("parent_id").alias("above"),
        F.col("name").alias("path"),
        F.lit(1).cast("bigint").alias("nodes"),
    )
    for _ in range(max_rounds):
        state = state.checkpoint()
        if not state.filter("nodes > spans_").isEmpty():
            break
        if state.filter(F.col("above").isNotNull()).isEmpty():
            return state.select(*key, "path", (F.col("nodes") - 1).alias("depth"))
        upper = state.select(
            "trace_id",
            F.col("span_id").alias("above"),
            F.struct("above", "path", "nodes").alias("upper"),
        )
        # a span whose parent is missing keeps its own path and counts as a root
        known = F.col("upper").isNotNull()
        joined = state.join(upper, ["trace_id", "above"], "left")
        path = F.concat("upper.path", F.lit("/"), "path")
        state = joined.select(
            *key,
            "spans_",
            F.col("upper.above").alias("above"),
            F.when(known, path).otherwise(F.col("path")).alias("path"),
            (F.col("nodes") + F.coalesce("upper.nodes", F.lit(0))).alias("nodes"),
        )
    raise ValueError("the spans contain a cycle")


def trace_summary(roots: DataFrame) -> DataFrame:
    """Traces, total and average duration, errors."""
    duration = F.coalesce(F.col("duration_ms"), F.lit(0))
    return roots.agg(
        F.count(F.lit(1)).alias("traces"),
        F.sum(duration).alias("total_ms"),
        terms.ratio(F.sum(duration), F.count(F.lit(1))).alias("average_ms"),
        F.count("error").alias("errors"),
    )


# --- suites ---------------------------------------------------------------------------------------


def judge(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Every expected case with ``passed``: expected refusals refused, expected agents run, expected words found.

    A case without a result has not passed; results of unknown cases are left out.

    results: case_id, agents array<string>, response, refused. expected: case_id, expected_agents,
    expected_contains (arrays), expected_out_of_scope.
    """
    joined = expected.join(results.withColumn("ran_", F.lit(True)), "case_id", "left")
    agents = F.coalesce("agents", F.array().cast("array<string>"))
    ran = F.size(F.array_except("expected_agents", agents)) == 0
    text = F.coalesce("response", F.lit(""))
    words = F.forall("expected_contains", lambda w: F.contains(text, w))
    refused = F.coalesce("refused", F.lit(False))
    passed = F.when(F.coalesce("expected_out_of_scope", F.lit(False)), refused).otherwise(
        ~refused & ran & words
    )
    return joined.withColumn("passed", F.coalesce("ran_", F.lit(False)) & passed).drop("ran_")


def pass_rate(judged: DataFrame) -> DataFrame:
    """Total, passed, failed and pass rate in percent to one place."""
    ok = F.count_if("passed")
    rows = F.count(F.lit(1))
    return judged.agg(
        rows.alias("total"),
        ok.alias("passed"),
        (rows - ok).alias("failed"),
        _percent(ok, rows).alias("pass_rate"),
    )


def demo_tally(demos: DataFrame) -> DataFrame:
    """Demos per verdict."""
    verdict = demos.select(scoring.demo_verdict().alias("v")).select("v.*")
    return verdict.groupBy("passed", "reason").agg(F.count(F.lit(1)).alias("n"))


def outcomes(log: DataFrame) -> DataFrame:
    """Sessions per outcome."""
    return log.groupBy(scoring.outcome().alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
