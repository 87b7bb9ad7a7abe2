"""Quality rules: text statistics and robust multivariate outliers, in DataFrame functions alone.

A text's statistics are transformed to a vector of ``DIMS``. Minimum-covariance-determinant estimates of centre and
scatter are fitted per language and source: from two starts (coordinate medians; mean and covariance of all)
concentration steps keep the half of the group nearest by Mahalanobis distance and re-estimate from it, and the start
whose half ends with the least determinant stands. A text whose distance exceeds ``CUTOFF`` is rejected.
Equal texts of a group count once in its estimates, so a group of copies cannot become the norm. Groups of fewer
than ``MIN_ROWS`` different texts use the estimate of their language, or else of all texts.

Defined results: a null text has no words (so it fails the base rules); null lang or source is a group of its own;
repeated rows are judged each; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, stage, unstage

DIMS = ("ln_words", "ln_word_len", "ln_symbols", "dup_lines", "repeats")
#: Standard deviations added to each dimension's scatter: spreads that are never a fault, and a floor where half of a group is constant.
FLOOR = (0.8, 0.06, 0.4, 0.15, 0.15)
#: Chi-square with 5 degrees of freedom: tail of one in a million.
CUTOFF = 36.0
#: Share of a group in the concentrated half, and the factor that makes its scatter consistent for normal data.
HALF, CONSISTENCY = 0.5, 1.9
STEPS = 3
MIN_ROWS = 50
#: Estimates of more groups than this (about 200 bytes each) are joined by shuffle.
BROADCAST_GROUPS = 50_000

SPACE = "[ \\\\t-\\\\r]+"


def words_sql(text: str) -> str:
    return f"array_remove(split({text}, '{SPACE}'), '')"


def _let(value: str, name: str, body: str) -> str:
    """SQL that evaluates ``value`` once and uses it by name."""
    return f"transform(array({value}), {name} -> {body})[0]"


def repeat_words_sql(w: str) -> str:
    """Words inside 3-word windows that occur twice or more: windows by 64-bit hash, sorted with their places, neighbours compared."""
    grams = f"transform(sequence(0, size({w}) - 3), i -> xxhash64({w}[i], {w}[i + 1], {w}[i + 2]))"
    twice = "filter(s, (e, k) -> (k > 0 AND s[k - 1].h = e.h) OR (k < size(s) - 1 AND s[k + 1].h = e.h))"
    places = f"size(array_distinct(flatten(transform({twice}, e -> array(e.p, e.p + 1, e.p + 2)))))"
    found = _let("sort_array(transform(g, (h, p) -> named_struct('h', h, 'p', p)))", "s", places)
    return f"CASE WHEN size({w}) < 4 THEN 0 ELSE {_let(grams, 'g', f'CASE WHEN size(array_distinct(g)) = size(g) THEN 0 ELSE {found} END')} END"


def text_stats(docs: DataFrame) -> DataFrame:
    """The base statistics of every whole text, beside doc_id, lang, source and a hash of the text."""
    t = "coalesce(text, '')"
    lines = f"filter(split({t}, '\\n'), x -> x RLIKE '[^ \\\\t-\\\\r]')"
    by_word = _let(words_sql(t), "w", f"named_struct('n', size(w), 'rep', {repeat_words_sql('w')})")
    by_line = _let(lines, "l", "named_struct('n', size(l), 'dup', size(l) - size(array_distinct(l)))")
    return docs.select(
        "doc_id",
        "lang",
        "source",
        F.xxhash64("text").alias("text_hash"),
        F.expr(by_word).alias("w"),
        F.expr(by_line).alias("l"),
        F.length(F.translate(F.expr(t), " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(F.expr(t)) - F.length(F.translate(F.expr(t), "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
    ).select(
        "doc_id",
        "lang",
        "source",
        "text_hash",
        F.col("w.n").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("l.dup").cast("long").alias("n_dup_lines"),
        F.col("w.rep").cast("long").alias("n_repeat_words"),
        F.col("l.n").cast("long").alias("n_lines"),
        F.expr("w.n < 50 OR 100 * w.rep > 50 * w.n").alias("base_failed"),
    )


def vector(stats: DataFrame) -> DataFrame:
    """The transformed statistics, rounded so that their exact quantiles need bounded memory."""
    n = F.col("n_words") + 1
    return stats.withColumns(
        {
            "ln_words": F.round(F.log(n.cast("double")), 3),
            "ln_word_len": F.round(F.log((F.col("word_chars") + 1) / n), 3),
            "ln_symbols": F.round(F.log1p(100 * F.col("n_symbols") / n), 3),
            "dup_lines": F.round(F.col("n_dup_lines") / (F.col("n_lines") + 1), 3),
            "repeats": F.round(F.col("n_repeat_words") / n, 3),
        }
    )


def _group_key(level: int) -> Column:
    own = [F.col("lang")] * (level < 2) + [F.col("source")] * (level < 1)
    return F.to_json(F.struct(F.lit(level).alias("level"), *own))


def _join_groups(rows: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    return rows.join(F.broadcast(groups) if n_groups <= BROADCAST_GROUPS else groups, "gkey")


def distance2(groups: DataFrame) -> DataFrame:
    """Adds the lower Cholesky factor l_ij of the scatter s_ij to each group (scatter + FLOOR is positive definite)."""
    d = len(DIMS)
    for j in range(d):
        cols = {}
        diag = F.col(f"s_{j}{j}") - sum((F.col(f"l_{j}{k}") * F.col(f"l_{j}{k}") for k in range(j)), F.lit(0.0))
        groups = groups.withColumn(f"l_{j}{j}", F.sqrt(F.greatest(diag, F.lit(1e-9))))
        for i in range(j + 1, d):
            off = F.col(f"s_{j}{i}") - sum((F.col(f"l_{i}{k}") * F.col(f"l_{j}{k}") for k in range(j)), F.lit(0.0))
            cols[f"l_{i}{j}"] = off / F.col(f"l_{j}{j}")
        if cols:
            groups = groups.withColumns(cols)
    return groups.select("gkey", "start", "n", *[f"m_{i}" for i in range(d)], *[f"l_{i}{j}" for i in range(d) for j in range(i + 1)])


def with_distance(rows: DataFrame) -> DataFrame:
    """Squared Mahalanobis distance by forward substitution, for rows that carry their group's m_i and l_ij."""
    d = len(DIMS)
    for i in range(d):
        part = F.col(DIMS[i]) - F.col(f"m_{i}") - sum((F.col(f"l_{i}{k}") * F.col(f"z_{k}") for k in range(i)), F.lit(0.0))
        rows = rows.withColumn(f"z_{i}", part / F.col(f"l_{i}{i}"))
    return rows.withColumn("d2", sum((F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(d)), F.lit(0.0)))


def mcd_estimates(vectors: DataFrame) -> DataFrame:
    """Centre m_i and Cholesky factor l_ij for each group key. A staged table of one row for each group."""
    d = len(DIMS)
    levels = F.explode(F.array(*[_group_key(x) for x in range(3)])).alias("gkey")
    sample = vectors.where("NOT base_failed").groupBy("lang", "source", "text_hash").agg(*[F.first(c).alias(c) for c in DIMS])
    rows = stage(sample.select(levels, *DIMS), "mcd-rows")
    by_median = rows.groupBy("gkey").agg(F.count("*").alias("n"), *[F.expr(f"percentile({c}, 0.5)").alias(f"m_{i}") for i, c in enumerate(DIMS)])
    for i in range(d):
        for j in range(i + 1):
            by_median = by_median.withColumn(f"l_{i}{j}", F.lit(float(FLOOR[i]) if i == j else 0.0))
    by_mean = distance2(_moments(rows.withColumn("start", F.lit(1)), F.count("*")))
    groups = stage(by_median.withColumn("start", F.lit(0)).unionByName(by_mean), "mcd-groups")
    n_groups = groups.count()
    for _ in range(STEPS):
        near = with_distance(_join_groups(rows, groups, n_groups)).withColumn("rank", F.round(F.log1p("d2"), 3))
        near = near.select("gkey", "start", "rank", *DIMS)
        limit = near.groupBy("gkey", "start").agg(F.count("*").alias("n"), F.expr(f"percentile(rank, {HALF})").alias("limit"))
        core = near.join(F.broadcast(limit) if n_groups <= BROADCAST_GROUPS else limit, ["gkey", "start"]).where("rank <= limit")
        before, groups = groups, stage(distance2(_moments(core, F.first("n"))), "mcd-groups")
        unstage(before)
    unstage(rows)
    log_det = sum((F.log(f"l_{i}{i}") for i in range(d)), F.lit(0.0))
    best = groups.groupBy("gkey").agg(F.min_by(F.struct(*[c for c in groups.columns if c not in ("gkey", "start")]), F.struct(F.round(log_det, 9), "start")).alias("g"))
    return stage(best.select("gkey", "g.*"), "mcd-best")


def _moments(rows: DataFrame, n: Column) -> DataFrame:
    """Means m_i and scatters s_ij of the rows of each group and start."""
    d = len(DIMS)
    sums = [F.avg(c).alias(f"m_{i}") for i, c in enumerate(DIMS)]
    sums += [F.covar_pop(DIMS[i], DIMS[j]).alias(f"c_{i}{j}") for i in range(d) for j in range(i, d)]
    est = rows.groupBy("gkey", "start").agg(n.alias("n"), *sums)
    return est.withColumns({f"s_{i}{j}": F.coalesce(F.col(f"c_{i}{j}"), F.lit(0.0)) * CONSISTENCY + (FLOOR[i] ** 2 if i == j else 0.0) for i in range(d) for j in range(i, d)})


def quality_rules(docs: DataFrame) -> DataFrame:
    """Every document with its statistics, base_failed, the squared distance and kept."""
    vectors = stage(vector(text_stats(docs)), "stats")
    groups = mcd_estimates(vectors)
    n_groups = groups.count()
    # the finest level with enough different texts: one row for each language and source
    choice = stage(
        vectors.groupBy("lang", "source")
        .agg(F.count("*").alias("rows"))
        .withColumn("k", F.explode(F.array(*[F.struct(F.lit(x).alias("level"), _group_key(x).alias("gkey")) for x in range(3)])))
        .select("lang", "source", "k.level", "k.gkey")
        .join(groups, "gkey", "left")
        .where(F.col("n").isNotNull() & ((F.col("n") >= MIN_ROWS) | (F.col("level") == 2)))
        .groupBy("lang", "source")
        .agg(F.min_by(F.struct(*groups.columns), "level").alias("g"))
        .select("lang", "source", "g.*"),
        "mcd-choice",
    )
    small = choice if n_groups > BROADCAST_GROUPS else F.broadcast(choice)
    same = [vectors["lang"].eqNullSafe(small["lang"]), vectors["source"].eqNullSafe(small["source"])]
    joined = vectors.join(small, same, "left").drop(small["lang"]).drop(small["source"])
    return with_distance(joined).select(
        "doc_id",
        "lang",
        "source",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= CUTOFF)).alias("kept"),
        F.round("d2", 6).alias("distance2"),
    )


def op1_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")


def op1_sql() -> str:
    """The same in DuckDB, with the estimation steps written out."""
    d, ws = len(DIMS), "[ \\t\\n\\x0b\\x0c\\r]"
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    lower = [(i, j) for i in range(d) for j in range(i + 1)]
    keys = ["'0|' || coalesce(lang, '~') || '|' || coalesce(source, '~')", "'1|' || coalesce(lang, '~')", "'2'"]

    def z(g: str) -> str:
        out = []
        for i in range(d):
            part = f"({DIMS[i]} - {g}.m_{i}" + "".join(f" - {g}.l_{i}{k} * z_{k}" for k in range(i)) + f") / {g}.l_{i}{i} AS z_{i}"
            out.append(part)
        return ", ".join([*out, " + ".join(f"z_{i} * z_{i}" for i in range(d)) + " AS d2"])

    def factor() -> str:
        out = []
        for j in range(d):
            out.append(f"sqrt(greatest(s_{j}{j}" + "".join(f" - l_{j}{k} * l_{j}{k}" for k in range(j)) + f", 1e-9)) AS l_{j}{j}")
            out += [f"(s_{j}{i}" + "".join(f" - l_{i}{k} * l_{j}{k}" for k in range(j)) + f") / l_{j}{j} AS l_{i}{j}" for i in range(j + 1, d)]
        return ", ".join(out)

    def lower_of() -> str:
        return ", ".join(f"l_{i}{j}" for i, j in lower)

    scatter = ", ".join(f"coalesce(covar_pop({DIMS[i]}, {DIMS[j]}), 0) * {CONSISTENCY} + {FLOOR[i] ** 2 if i == j else 0.0} AS s_{i}{j}" for i, j in pairs)
    ctes = [
        f"w AS (SELECT doc_id, lang, source, text, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '{ws}+'), lambda x: x <> '') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0b\\x0c\\r]')) AS ln FROM documents)",
        "gram AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w))",
        "twice AS (SELECT doc_id, i FROM gram QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1)",
        "rep AS (SELECT doc_id, count(DISTINCT p) AS r FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id)",
        f"st AS (SELECT w.doc_id, lang, source, text, len(w) AS n_words, length(regexp_replace(t, '{ws}', '', 'g')) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(ln) - len(list_distinct(ln)) AS n_dup_lines, coalesce(r, 0) AS n_repeat_words, len(ln) AS n_lines FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id)",
        "v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, round(ln(CAST(n_words + 1 AS DOUBLE)), 3) AS ln_words, round(ln((word_chars + 1) / (n_words + 1)), 3) AS ln_word_len, round(ln(1 + 100 * n_symbols / (n_words + 1)), 3) AS ln_symbols, round(n_dup_lines / (n_lines + 1), 3) AS dup_lines, round(n_repeat_words / (n_words + 1), 3) AS repeats FROM st)",
        f"smp AS (SELECT lang, source, text, {', '.join(f'any_value({c}) AS {c}' for c in DIMS)} FROM v WHERE NOT base_failed GROUP BY lang, source, text)",
        "rws AS (" + " UNION ALL ".join(f"SELECT {k} AS gkey, {', '.join(DIMS)} FROM smp" for k in keys) + ")",
        "g0 AS (SELECT gkey, 0 AS start, count(*) AS n, " + ", ".join(f"quantile_cont({c}, 0.5) AS m_{i}" for i, c in enumerate(DIMS)) + ", " + ", ".join(f"{FLOOR[i] if i == j else 0.0}::DOUBLE AS l_{i}{j}" for i, j in lower) + " FROM rws GROUP BY gkey"
        + f" UNION ALL SELECT gkey, 1 AS start, n, {', '.join(f'm_{i}' for i in range(d))}, {lower_of()} FROM (SELECT *, {factor()} FROM (SELECT gkey, count(*) AS n, {', '.join(f'avg({c}) AS m_{i}' for i, c in enumerate(DIMS))}, {scatter} FROM rws GROUP BY gkey)))",
    ]
    for s in range(1, STEPS + 1):
        g = f"g{s - 1}"
        ctes += [
            f"n{s} AS (SELECT gkey, start, round(ln(1 + d2), 3) AS rank, {', '.join(DIMS)} FROM (SELECT rws.*, {g}.start, {z(g)} FROM rws JOIN {g} USING (gkey)))",
            f"q{s} AS (SELECT gkey, start, count(*) AS n, quantile_cont(rank, {HALF}) AS lim FROM n{s} GROUP BY gkey, start)",
            f"e{s} AS (SELECT gkey, start, any_value(n) AS n, {', '.join(f'avg({c}) AS m_{i}' for i, c in enumerate(DIMS))}, {scatter} FROM n{s} JOIN q{s} USING (gkey, start) WHERE rank <= lim GROUP BY gkey, start)",
            f"g{s} AS (SELECT gkey, start, n, {', '.join(f'm_{i}' for i in range(d))}, {lower_of()} FROM (SELECT *, {factor()} FROM e{s}))",
        ]
    ctes.append(f"best AS (SELECT * FROM g{STEPS} QUALIFY row_number() OVER (PARTITION BY gkey ORDER BY round({' + '.join(f'ln(l_{i}{i})' for i in range(d))}, 9), start) = 1)")
    last = "best"
    ctes += [
        "pick AS (SELECT ls.lang, ls.source, g.* FROM (SELECT DISTINCT lang, source FROM v) ls JOIN "
        + f"(SELECT * FROM {last} WHERE n >= {MIN_ROWS} OR gkey = '2') g ON g.gkey IN ({', '.join(keys)}) QUALIFY row_number() OVER (PARTITION BY ls.lang, ls.source ORDER BY gkey) = 1)",
        f"scored AS (SELECT v.*, {z('pick')} FROM v LEFT JOIN pick ON v.lang IS NOT DISTINCT FROM pick.lang AND v.source IS NOT DISTINCT FROM pick.source)",
    ]
    return (
        "WITH " + ",\n".join(ctes) + "\nSELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, "
        f"NOT base_failed AND coalesce(d2, 0) <= {CUTOFF} AS kept, round(d2, 6) AS distance2 FROM scored"
    )


OP1_SQL = op1_sql()
