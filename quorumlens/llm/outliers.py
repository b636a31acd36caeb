"""Quality rules and robust multivariate outliers of text statistics, in DataFrame operations only."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlens.session import written

SPACE = r"[\x20\x09-\x0D]+"
_SPACE_CHARS = " \t\n\x0b\x0c\r"
#: Bits of a packed value that hold a position; the rest holds the upper bits of a hash.
_AT = 24

#: Statistic vector: log word length, log symbols a word, repeated words a word, repeated lines a line with a word,
#: each as an integer number of thousandths, so that all sums are exact in any order.
VECTOR = {
    "z1": "ln(greatest(word_chars, 1) / (1e0 * greatest(n_words, 1)))",
    "z2": "ln(1e0 + n_symbols / (1e0 * greatest(n_words, 1)))",
    "z3": "n_repeat_words / (1e0 * greatest(n_words, 1))",
    "z4": "n_dup_lines / (1e0 * greatest(n_lines, 1))",
}
DIMENSIONS = len(VECTOR)
PAIRS = list(combinations_with_replacement(range(1, DIMENSIONS + 1), 2))
#: Least standard deviation of each statistic in thousandths. Most documents have no symbols and no repeats, so
#: the plain estimate can be singular; the squares are added to the diagonal, which keeps it regular.
LEAST = (60, 50, 100, 150)
#: The half set holds 3 of 4 rows; this makes its covariance consistent for normal data of four dimensions.
CONSISTENCY = 1.485
#: 99.99 % quantile of chi-squared with four degrees of freedom.
CUTOFF = 23.51
#: Groups with fewer rows are pooled by language, and pools with fewer all together.
LEAST_ROWS = 40
STEPS = 4


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row, however often it is used."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more.

    Sorts 64-bit values that hold the upper bits of a window's hash and its position; equal windows become
    neighbours and are confirmed by the full hash, one or two places away.
    """
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 3, F.lit(0))), lambda i: i + 2 < F.size(words))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    place = F.lit((1 << _AT) - 1).cast("bigint")
    top = F.lit(-(1 << _AT)).cast("bigint")

    def again(h: Column) -> Column:
        packed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(top).bitwiseOR(i.cast("bigint"))))

        def found(s: Column) -> Column:
            full = lambda x: F.get(h, x.bitwiseAND(place).cast("int"))
            near = lambda x, y: (F.shiftright(x, _AT) == F.shiftright(y, _AT)) & (full(x) == full(y))
            twice = lambda x, i: F.coalesce(
                near(x, F.get(s, i + 1)), F.lit(False)
            ) | F.coalesce(near(x, F.get(s, i - 1)), F.lit(False)) | F.coalesce(
                near(x, F.get(s, i + 2)), F.lit(False)
            ) | F.coalesce(near(x, F.get(s, i - 2)), F.lit(False))
            return F.sort_array(F.transform(F.filter(s, twice), lambda x: x.bitwiseAND(place)))

        return let(
            let(packed, found),
            lambda q: F.aggregate(
                F.transform(q, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(q, i + 1) - x, F.lit(3)))),
                F.lit(0).cast("bigint"),
                lambda a, b: a + b,
            ),
        )

    return let(hashes, again)


def statistics(text: Column) -> Column:
    """STRUCT of n_words, word_chars, n_symbols, n_lines (lines with a word), n_dup_lines, n_repeat_words, all BIGINT."""
    text = F.coalesce(text, F.lit(""))
    spaces = F.lit(_SPACE_CHARS)
    trimmed = F.btrim(text, spaces)
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, spaces) != "")
    n = lambda c: c.cast("bigint")
    of_words = let(
        words,
        lambda w: F.struct(
            n(F.size(w)).alias("n_words"),
            n(F.length(F.array_join(w, ""))).alias("word_chars"),
            n(_repeated(w)).alias("n_repeat_words"),
        ),
    )
    of_lines = let(
        lines,
        lambda x: F.struct(n(F.size(x)).alias("n_lines"), n(F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")),
    )
    return F.struct(
        of_words.alias("w"), of_lines.alias("l"), n(F.regexp_count(text, F.lit(r"[#*$%&|<>]"))).alias("n_symbols")
    )


def described(docs: DataFrame) -> DataFrame:
    """``docs`` with the statistics of its column text, and base_failed."""
    docs = docs.withColumn("_s", statistics(F.col("text")))
    docs = docs.withColumns(
        {
            "n_words": F.col("_s.w.n_words"),
            "word_chars": F.col("_s.w.word_chars"),
            "n_symbols": F.col("_s.n_symbols"),
            "n_lines": F.col("_s.l.n_lines"),
            "n_dup_lines": F.col("_s.l.n_dup_lines"),
            "n_repeat_words": F.col("_s.w.n_repeat_words"),
        }
    ).drop("_s")
    return docs.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))


def distance_sql() -> str:
    """Squared Mahalanobis distance by forward substitution with the Cholesky factor in l11 .. l44."""
    y: list[str] = []
    for i in range(1, DIMENSIONS + 1):
        less = "".join(f" - l{i}{j} * {y[j - 1]}" for j in range(1, i))
        y.append(f"((z{i} - m{i}{less}) / l{i}{i})")
    return " + ".join(f"{v} * {v}" for v in y)


def cholesky_sql() -> list[tuple[str, str]]:
    """Columns l11 .. l44 and det, in an order in which each uses earlier ones, from c11 .. c44."""
    found = []
    for j in range(1, DIMENSIONS + 1):
        for i in range(j, DIMENSIONS + 1):
            less = "".join(f" - l{i}{k} * l{j}{k}" for k in range(1, j))
            own = f"(c{j}{i}{less})"
            found.append((f"l{i}{j}", f"sqrt({own})" if i == j else f"{own} / l{j}{j}"))
    return [*found, ("det", " * ".join(f"l{i}{i}" for i in range(1, DIMENSIONS + 1)))]


def covariance_sql() -> list[tuple[str, str]]:
    """Columns c11 .. c44 of a half set from its sums n, s1 .. s4 and p11 .. p44."""
    least = {(i, i): f" + {LEAST[i - 1] ** 2}e0" for i in range(1, DIMENSIONS + 1)}
    return [
        (f"c{i}{j}", f"{CONSISTENCY}e0 * (p{i}{j} / (1e0 * n) - m{i} * m{j}){least.get((i, j), '')}") for i, j in PAIRS
    ]


_FACTOR = [f"m{i}" for i in range(1, DIMENSIONS + 1)] + [f"l{j}{i}" for i, j in PAIRS] + ["det"]


def _with(df: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    for name, text in columns:
        df = df.withColumn(name, F.expr(text))
    return df


def _group_keys(rows: DataFrame) -> DataFrame:
    """lang, source and the group whose estimate they use."""
    sizes = rows.groupBy("lang", "source").agg(F.sum(F.when(F.col("fit"), 1).otherwise(0)).alias("n"))
    language = F.coalesce(F.concat(F.lit("L"), "lang"), F.lit("-"))
    own = F.concat(language, F.lit("\0"), F.coalesce(F.concat(F.lit("S"), "source"), F.lit("-")))
    sizes = sizes.withColumns({"language": language, "own": own})
    pools = sizes.where(F.col("n") < LEAST_ROWS).groupBy("language").agg(F.sum("n").alias("pooled"))
    return sizes.join(pools, "language", "left").select(
        "lang",
        "source",
        F.when(F.col("n") >= LEAST_ROWS, F.col("own"))
        .when(F.col("pooled") >= LEAST_ROWS, F.col("language"))
        .otherwise(F.lit("*"))
        .alias("group"),
    )


def _starts(vectors: DataFrame) -> DataFrame:
    """Two diagonal estimates a group: median with quartile range, and median with the least deviations."""
    long = vectors.selectExpr(
        "group", "stack(4, 1, z1, 2, z2, 3, z3, 4, z4) AS (dim, v)"
    ).groupBy("group", "dim", "v").count()
    ranked = long.selectExpr(
        "group",
        "dim",
        "v",
        "sum(count) OVER (PARTITION BY group, dim ORDER BY v) AS upto",
        "sum(count) OVER (PARTITION BY group, dim) AS n",
    )
    at = lambda k: F.min(F.expr(f"if(4 * upto >= {k} * n, v, NULL)")).alias(f"q{k}")
    quartiles = ranked.groupBy("group", "dim").agg(at(1), at(2), at(3))
    least = F.element_at(F.array(*[F.lit(float(x)) for x in LEAST]), F.col("dim"))
    spread = F.greatest(F.expr("0.7413e0 * (q3 - q1)"), least)
    wide = quartiles.withColumns({"least": least, "spread": spread}).groupBy("group").agg(
        *[F.max(F.when(F.col("dim") == i, F.col("q2").cast("double"))).alias(f"m{i}") for i in range(1, DIMENSIONS + 1)],
        *[F.max(F.when(F.col("dim") == i, F.col(c))).alias(f"{c}{i}") for c in ("spread", "least") for i in range(1, DIMENSIONS + 1)],
    )
    both = []
    for k, c in enumerate(("spread", "least")):
        part = wide.withColumn("start", F.lit(k))
        for i, j in PAIRS:
            part = part.withColumn(f"l{j}{i}", F.col(f"{c}{i}") if i == j else F.lit(0.0))
        both.append(part.withColumn("det", F.lit(0.0)).select("group", "start", *_FACTOR))
    return both[0].unionByName(both[1])


def _concentrated(vectors: DataFrame, factor: DataFrame) -> DataFrame:
    """One C-step: the three quarters of a group that are nearest by ``factor`` give the next estimate.

    Distances are counted in fine logarithmic bins, so the cut of any group is found from a small histogram;
    rows that share the bin of the cut are all in.
    """
    placed = vectors.join(factor, "group").withColumn(
        "bin", F.floor(F.lit(64) * F.log(F.lit(1.0) + F.expr(distance_sql())))
    )
    cut = (
        placed.groupBy("group", "start", "bin")
        .count()
        .selectExpr(
            "group",
            "start",
            "bin",
            "sum(count) OVER (PARTITION BY group, start ORDER BY bin) AS upto",
            "sum(count) OVER (PARTITION BY group, start) AS n",
        )
        .where("4 * upto >= 3 * n")
        .groupBy("group", "start")
        .agg(F.min("bin").alias("cut"))
    )
    half = placed.select("group", "start", "bin", *VECTOR).join(cut, ["group", "start"]).where("bin <= cut")
    sums = half.groupBy("group", "start").agg(
        F.count("*").alias("n"),
        *[F.sum(f"z{i}").alias(f"s{i}") for i in range(1, DIMENSIONS + 1)],
        *[F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"p{i}{j}") for i, j in PAIRS],
    )
    means = [(f"m{i}", f"s{i} / (1e0 * n)") for i in range(1, DIMENSIONS + 1)]
    return _with(sums, [*means, *covariance_sql(), *cholesky_sql()]).select("group", "start", *_FACTOR)


def _matches(a: DataFrame, b: DataFrame) -> Column:
    return a["lang"].eqNullSafe(b["lang"]) & a["source"].eqNullSafe(b["source"])


def _measured(docs: DataFrame) -> DataFrame:
    return _with(described(docs), [(z, f"CAST(floor(1000e0 * ({text}) + 0.5e0) AS BIGINT)") for z, text in VECTOR.items()])


def estimates(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """Center and Cholesky factor for each language and source, of rows with VECTOR and base_failed that pass the base rules."""
    keys = _group_keys(rows.withColumn("fit", ~F.col("base_failed")))
    vectors = rows.where("NOT base_failed").select("lang", "source", *VECTOR)
    vectors = written(vectors.join(keys, _matches(vectors, keys)).select("group", *VECTOR), "text-vectors")
    factor = written(_starts(vectors), "mcd")
    for _ in range(steps):
        factor = written(_concentrated(vectors, factor), "mcd")
    best = factor.groupBy("group").agg(F.min_by(F.struct(*_FACTOR), F.struct("det", "start")).alias("f")).select("group", "f.*")
    return written(keys.join(best, "group", "left").drop("group"), "mcd-groups")


def _verdict(rows: DataFrame, groups: DataFrame) -> DataFrame:
    names = rows.columns
    own = groups.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    joined = rows.join(own, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    joined = joined.withColumn("distance", F.expr(distance_sql()))
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF)
    return joined.withColumn("kept", kept).select(*[n for n in names if n not in VECTOR], "distance", "kept")


def judged(docs: DataFrame, steps: int = STEPS) -> DataFrame:
    """Statistics and verdict of each row: ``docs`` without its text, with n_words ... base_failed, distance, kept.

    ``docs`` has text, lang, source and any other columns. A row fails the base rules, or its statistic vector
    lies beyond the cutoff of its language and source. Estimates use the rows that pass the base rules. A language
    and source with fewer than ``LEAST_ROWS`` such rows is not estimated by itself: those of a language are pooled,
    and over all languages where the pool is still too small. C-steps are ``steps``, whether or not they have settled. A null
    text has no words, null languages and sources are groups of their own, repeated rows count as often as they
    occur, an empty table gives no rows. Columns with the names of results are replaced.
    """
    results = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept"]
    own = [c for c in docs.columns if c.lower() not in (*results, "text")]
    plain = docs.select(F.struct(*own).alias("_doc"), "lang", "source", "text")
    rows = written(_measured(plain).drop("text"), "text-statistics")
    return _verdict(rows, estimates(rows, steps)).select("_doc.*", *results)


def kept(docs: DataFrame, steps: int = STEPS) -> DataFrame:
    """The rows of ``docs`` that :func:`judged` keeps, as they are, without a shuffle of their texts."""
    rows = written(_measured(docs.select("lang", "source", "text")).select("lang", "source", "base_failed", *VECTOR), "text-statistics")
    groups = estimates(rows, steps)
    numbered = _measured(docs.select(F.struct(*docs.columns).alias("_doc"), "lang", "source", "text")).drop("text")
    # One number for both reasons, so that no part of the condition is worked out a second time before the join.
    reason = F.coalesce("distance", F.lit(0.0)) + F.col("base_failed").cast("int") * (2.0 * CUTOFF)
    return _verdict(numbered, groups).where(reason <= CUTOFF).select("_doc.*")


def oracle_sql(steps: int = STEPS) -> str:
    """The same on DuckDB, one CTE for each step, from the table documents."""
    z = ", ".join(f"CAST(floor(1000e0 * ({t}) + 0.5e0) AS BIGINT) AS {k}" for k, t in VECTOR.items())
    names = ", ".join(VECTOR)
    means = [(f"m{i}", f"s{i} / (1e0 * n)") for i in range(1, DIMENSIONS + 1)]
    zero = ", ".join(f"CASE WHEN k = 0 THEN spread{i} ELSE {float(LEAST[i - 1])} END AS l{i}{i}" if i == j else f"0e0 AS l{j}{i}" for i, j in PAIRS)
    ctes = [
        r"""t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)""",
        """rid AS (SELECT *, row_number() OVER () AS r FROM t)""",
        """pos AS (SELECT r, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM rid)""",
        """tri AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c FROM pos)""",
        """rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM
             (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM tri WHERE c > 1) GROUP BY r)""",
        r"""line AS (SELECT r, unnest(string_split(text, chr(10))) AS x FROM rid)""",
        r"""lines AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines FROM line
             WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r)""",
        r"""st AS (SELECT r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
             FROM rid LEFT JOIN rep USING (r) LEFT JOIN lines USING (r))""",
        f"rows_ AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {z} FROM st)",
        """sizes AS (SELECT lang, source, count(*) FILTER (NOT base_failed) AS n, coalesce('L' || lang, '-') AS language,
             coalesce('L' || lang, '-') || '~' || coalesce('S' || source, '-') AS own FROM rows_ GROUP BY lang, source)""",
        f"pools AS (SELECT language, sum(n) AS pooled FROM sizes WHERE n < {LEAST_ROWS} GROUP BY language)",
        f"""keys AS (SELECT lang, source, CASE WHEN n >= {LEAST_ROWS} THEN own WHEN pooled >= {LEAST_ROWS} THEN language ELSE '*' END AS grp
             FROM sizes LEFT JOIN pools USING (language))""",
        f"""keyed AS (SELECT r.*, k.grp FROM rows_ r JOIN keys k
             ON r.lang IS NOT DISTINCT FROM k.lang AND r.source IS NOT DISTINCT FROM k.source)""",
        f"v AS (SELECT grp, {names} FROM keyed WHERE NOT base_failed)",
        "q AS (SELECT grp, " + ", ".join(
            f"CAST(quantile_disc(z{i}, 0.5) AS DOUBLE) AS m{i}, greatest(0.7413e0 * (quantile_disc(z{i}, 0.75) - quantile_disc(z{i}, 0.25)), {float(LEAST[i - 1])}) AS spread{i}"
            for i in range(1, DIMENSIONS + 1)) + " FROM v GROUP BY grp)",
        "f0 AS (SELECT grp, k AS start, " + ", ".join(f"m{i}" for i in range(1, DIMENSIONS + 1)) + f", {zero}, 0e0 AS det FROM q, (VALUES (0), (1)) AS s(k))",
    ]
    for s in range(1, steps + 1):
        ctes += [
            f"d{s} AS (SELECT v.grp, start, {names}, CAST(floor(64 * ln(1e0 + {distance_sql()})) AS BIGINT) AS bin FROM v JOIN f{s - 1} USING (grp))",
            f"""u{s} AS (SELECT grp, start, bin, sum(count(*)) OVER (PARTITION BY grp, start ORDER BY bin) AS upto,
                 sum(count(*)) OVER (PARTITION BY grp, start) AS n FROM d{s} GROUP BY grp, start, bin)""",
            f"k{s} AS (SELECT grp, start, min(bin) AS cut FROM u{s} WHERE 4 * upto >= 3 * n GROUP BY grp, start)",
            f"a{s} AS (SELECT grp, start, count(*) AS n, " + ", ".join(
                [f"CAST(sum(z{i}) AS BIGINT) AS s{i}" for i in range(1, DIMENSIONS + 1)] + [f"CAST(sum(z{i} * z{j}) AS BIGINT) AS p{i}{j}" for i, j in PAIRS]
            ) + f" FROM d{s} JOIN k{s} USING (grp, start) WHERE bin <= cut GROUP BY grp, start)",
            f"f{s} AS (SELECT *, " + ", ".join(f"{t} AS {k}" for k, t in [*means, *covariance_sql(), *cholesky_sql()]) + f" FROM a{s})",
        ]
    ctes.append(
        f"best AS (SELECT * FROM f{steps} QUALIFY row_number() OVER (PARTITION BY grp ORDER BY det, start) = 1)"
    )
    return "WITH " + ",\n".join(ctes) + f"""
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      NOT base_failed AND coalesce({distance_sql()}, 0e0) <= {CUTOFF}e0 AS kept
    FROM keyed LEFT JOIN best USING (grp)"""
