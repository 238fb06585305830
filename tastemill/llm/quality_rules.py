"""Quality rules with robust multivariate outliers, in DataFrame functions only.

Base statistics of the whole text: words, code points in words, symbols, lines equal to an earlier line, and
words inside five-word windows that occur twice or more. Five transformed statistics (log length, log
mean word length, log symbol rate, repeated-line and repeated-word shares) form a vector. Per language and
source, its centre and covariance are estimated by minimum covariance determinant. A text whose squared Mahalanobis
distance is above `cutoff` is rejected, as is one that fails a base rule.

The estimate is a regularised one (after Boudt, Rousseeuw, Vanduffel and Verdonck 2020). From a start, concentration
steps take the `subset` share of the group's rows that is nearest to the last estimate and estimate anew from these,
until no group's determinant changes. Two things are added to the rows taken: `floors`, standard deviations that are
always granted, so that a statistic that most clean texts have at 0 does not make every small deviation an outlier;
and `prior_rows` rows' worth of the estimate one level up (of the language for a source in it, of all texts for a
language), so that a group leans on its own rows as far as it has them, whatever its size. Both are the same in every
step, so with the exact share of rows no step can raise the determinant; the share is cut by quantile sketches, which
are exact to 1 in 10,000 ranks. A language starts from medians and median absolute deviations; a source in it from
its own ones and from the language's estimate, and the start that ends at the smaller determinant counts.

All estimates are sums and mergeable quantile sketches over the narrow table of vectors, summed on the map
side first, so a language or source with a third of all rows is no hot key. The covariance is scaled for the trimming.

Defined cases: a null text has no words (base_failed); null language and null source are groups of their own;
an empty table gives an empty result; repeated rows and null ids are judged row by row; other columns are not
read. Windows are compared by 64-bit hashes within one text. A group of one row is judged by the estimate above it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemill.llm._common import WORD, Scratch, written

SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
WINDOW = 5
#: The share of the covariance that stays when only the nearest three quarters of a normal sample in five
#: dimensions are taken; its inverse scales the estimate. Fixed value.
TRIMMED = {0.75: 0.708}
FLOORS = (0.5, 0.1, 0.3, 0.06, 0.05)
VECTOR = ("x0", "x1", "x2", "x3", "x4")


def base_statistics(df: DataFrame, text: Column, keep: list[str]) -> DataFrame:
    """keep and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words. Each step of the chain is
    named, as a column that is used inside a lambda would be computed for every element otherwise."""
    rows = df.select(*keep, F.coalesce(text, F.lit("")).alias("t"))
    rows = rows.select(
        *keep,
        F.regexp_extract_all("t", F.lit(WORD), 0).alias("w"),
        F.length(F.translate("t", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("t", "\n"), lambda x: F.translate(x, SPACE, "") != "").alias("lines"),
    )
    keep = [*keep, "word_chars", "n_symbols"]
    window = ", ".join(f"get(w, i + {j})" for j in range(WINDOW))
    rows = rows.select(
        *keep,
        F.size("w").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(f"if(size(w) < {WINDOW}, array(), transform(sequence(0, size(w) - {WINDOW}), i -> xxhash64({window})))").cast("array<bigint>").alias("h"),
    )
    keep = [*keep, "n_words", "n_lines", "n_dup_lines"]
    rows = rows.select(*keep, "h", (F.size(F.array_distinct("h")) < F.size("h")).alias("again"))
    rows = rows.select(*keep, F.expr("if(again, array_sort(transform(h, (x, i) -> struct(x as x, i as i))), null)").alias("s"))
    same = "(i > 0 and get(s, i).x = get(s, i - 1).x) or (i + 1 < size(s) and get(s, i).x = get(s, i + 1).x)"
    rows = rows.select(*keep, F.expr(f"if(s is null, null, array_sort(transform(filter(sequence(0, size(s) - 1), i -> {same}), i -> get(s, i).i)))").alias("p"))
    covered = f"if(p is null, 0L, cast({WINDOW} + aggregate(sequence(0, size(p) - 1), 0, (a, i) -> a + if(i = 0, 0, least({WINDOW}, get(p, i) - get(p, i - 1)))) as bigint))"
    return rows.select(*keep, F.expr(covered).alias("n_repeat_words"))


def statistics_vector() -> list[Column]:
    """A few words' worth of average text are added to each rate, so short texts vary little more than long ones."""
    n, chars = F.col("n_words"), F.col("word_chars")
    return [
        F.log(n + F.lit(1.0)).alias("x0"),
        F.log((chars + F.lit(250.0)) / (n + F.lit(50.0))).alias("x1"),
        F.log(F.lit(1.0) + F.lit(100.0) * F.col("n_symbols") / (chars + F.lit(100.0))).alias("x2"),
        (F.col("n_dup_lines") / (F.col("n_lines") + F.lit(10.0))).alias("x3"),
        (F.col("n_repeat_words") / (n + F.lit(50.0))).alias("x4"),
    ]


P = len(VECTOR)
MEANS = [f"m{i}" for i in range(P)]
CELLS = [(i, j) for i in range(P) for j in range(i + 1)]  # of a symmetric matrix, the lower half
COVARIANCE, FACTOR = [f"c{i}{j}" for i, j in CELLS], [f"l{i}{j}" for i, j in CELLS]


def _attached(rows: DataFrame, groups: DataFrame, most: int = 100_000) -> DataFrame:
    """rows with their group's columns: a broadcast if a count shows few groups."""
    return rows.join(F.broadcast(groups) if groups.count() <= most else groups, "g")


def _group(*columns: str) -> Column:
    """One text for the values of some columns; a null is no text."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    return F.to_json(F.array(*map(name, columns)))


def _factored(moments: DataFrame) -> DataFrame:
    """moments (means and covariances) with the Cholesky factor and the logarithm of the determinant."""
    out = moments
    for i, j in CELLS:
        c = F.col(f"c{i}{j}")
        for k in range(j):
            c = c - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(c, F.lit(1e-12))) if i == j else c / F.col(f"l{j}{j}"))
    return out.withColumn("log_det", sum((F.log(f"l{i}{i}") for i in range(1, P)), F.log("l00")) * 2)


def _moments(near: DataFrame, keys: list[str], prior: DataFrame | None, floors: tuple[float, ...], scale: float, prior_rows: float, scratch: Scratch) -> DataFrame:
    """keys, means, covariances and factor: of the rows and, so many rows' worth, of the prior (g, means, covariances)."""
    sums = [F.count(F.lit(1)).alias("n"), *[F.avg(x).alias(f"a{i}") for i, x in enumerate(VECTOR)]]
    own = near.groupBy(*keys).agg(*sums, *[F.coalesce(F.covar_pop(VECTOR[i], VECTOR[j]), F.lit(0.0)).alias(f"s{i}{j}") for i, j in CELLS])
    if prior is None:
        own = own.select("*", F.lit(0.0).alias("w"), *[F.lit(0.0).alias(f"p{c}") for c in MEANS + COVARIANCE])
    else:
        own = _attached(own, prior.select("g", F.lit(float(prior_rows)).alias("w"), *[F.col(c).alias(f"p{c}") for c in MEANS + COVARIANCE]))
    n, w = F.col("n"), F.col("w")
    off = lambda i: F.col(f"a{i}") - F.col(f"pm{i}")
    means = [((n * F.col(f"a{i}") + w * F.col(f"pm{i}")) / (n + w)).alias(f"m{i}") for i in range(P)]
    cells = [
        ((F.lit(scale) * (n * F.col(f"s{i}{j}") + n * w / (n + w) * off(i) * off(j)) + w * F.col(f"pc{i}{j}")) / (n + w) + F.lit(floors[i] ** 2 if i == j else 0.0) * n / (n + w)).alias(f"c{i}{j}")
        for i, j in CELLS
    ]
    return scratch.written(_factored(own.select(*keys, *means, *cells)), "robust-moments")


def _distance(rows: DataFrame, moments: DataFrame) -> DataFrame:
    """rows with the other keys of moments and d2, the squared Mahalanobis distance; by forward substitution."""
    extra = [c for c in ("start",) if c in moments.columns]
    out = _attached(rows, moments.select("g", *extra, *MEANS, *FACTOR))
    for i in range(P):
        y = F.col(VECTOR[i]) - F.col(f"m{i}")
        for k in range(i):
            y = y - F.col(f"l{i}{k}") * F.col(f"y{k}")
        out = out.withColumn(f"y{i}", y / F.col(f"l{i}{i}"))
    total = sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, P)), F.col("y0") * F.col("y0"))
    return out.withColumn("d2", total).select(*rows.columns, *extra, "d2")


def _medians(rows: DataFrame, floors: tuple[float, ...], scratch: Scratch) -> DataFrame:
    """g, means and covariances by medians and median absolute deviations."""
    median = scratch.written(rows.groupBy("g").agg(*[F.percentile_approx(x, 0.5, 10000).alias(f"m{i}") for i, x in enumerate(VECTOR)]), "medians")
    off = _attached(rows, median)
    spread = [F.greatest(F.lit(1.4826) * F.percentile_approx(F.abs(F.col(x) - F.col(f"m{i}")), 0.5, 10000), F.lit(floors[i])).alias(f"d{i}") for i, x in enumerate(VECTOR)]
    found = off.groupBy("g").agg(*[F.first(c).alias(c) for c in MEANS], *spread)
    cells = [(F.col(f"d{i}") * F.col(f"d{i}") if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in CELLS]
    return scratch.written(_factored(found.select("g", *MEANS, *cells)), "robust-start")


def concentrated(rows: DataFrame, starts: list[DataFrame], prior: DataFrame | None, floors: tuple[float, ...], subset: float, prior_rows: float, scratch: Scratch, settled: float = 1e-3) -> DataFrame:
    """rows (g, vector): g, means, covariances, factor of the start that ends at the smallest determinant."""
    columns = ["g", *MEANS, *COVARIANCE, *FACTOR, "log_det"]
    now = reduce(DataFrame.unionByName, [x.select(F.lit(k).alias("start"), *columns) for k, x in enumerate(starts)])
    first = True
    while True:
        far = _distance(rows, now)
        bar = scratch.written(far.groupBy("g", "start").agg(F.percentile_approx("d2", subset, 10000).alias("bar")), "robust-bars")
        many = bar.count() > 100_000
        near = far.join(bar if many else F.broadcast(bar), ["g", "start"]).where(F.col("d2") <= F.col("bar"))
        after = _moments(near, ["g", "start"], prior, floors, 1 / TRIMMED[subset], prior_rows, scratch)
        # a start may be smaller than what any rows give; from the first step on a determinant that grows has settled
        gain = now.select("g", "start", F.col("log_det").alias("before")).join(after, ["g", "start"]).agg(F.max(F.col("before") - F.col("log_det"))).first()[0]
        now, done = after, not first and (gain is None or gain < settled)
        if done or gain is None:
            break
        first = False
    best = now.groupBy("g").agg(F.min_by(F.struct(*columns[1:]), F.struct("log_det", "start")).alias("best"))
    return scratch.written(best.select("g", "best.*"), "robust-groups")


def robust_distances(rows: DataFrame, floors: tuple[float, ...] = FLOORS, subset: float = 0.75, prior_rows: float = 50.0, scratch: Scratch | None = None) -> DataFrame:
    """rows: lang, source and x0 to x4, a written table that is read a few times. Adds d2."""
    scratch = scratch or Scratch(rows.sparkSession, "quality-rules")
    keyed = scratch.written(rows.select("*", _group("lang").alias("by_lang"), _group("lang", "source").alias("by_source")), "quality-groups")
    least = tuple(x / 10 for x in floors)
    langs, sources = (keyed.select(F.col(c).alias("g"), *VECTOR) for c in ("by_lang", "by_source"))
    whole = _medians(keyed.select(F.lit("").alias("g"), *VECTOR), floors, scratch).first()  # one row, or none without texts
    if whole is None:
        return rows.withColumn("d2", F.lit(None).cast("double"))
    names = [*MEANS, *COVARIANCE, *FACTOR, "log_det"]
    above = scratch.written(langs.select("g").distinct().select("g", *[F.lit(whole[c]).alias(c) for c in names]), "robust-prior")
    by_lang = concentrated(langs, [_medians(langs, least, scratch)], above, floors, subset, prior_rows, scratch)
    groups = keyed.select(F.col("by_lang").alias("g"), "by_source").distinct()
    above = scratch.written(_attached(groups, by_lang).select(F.col("by_source").alias("g"), *names), "robust-prior")
    found = concentrated(sources, [_medians(sources, least, scratch), above], above, floors, subset, prior_rows, scratch)
    return _distance(keyed.withColumn("g", F.col("by_source")), found).select(*rows.columns, "d2")


def judge_quality(docs: DataFrame, cutoff: float = 35.0, **options) -> DataFrame:
    """One row per row of docs: doc_id, the base statistics, base_failed, distance, kept."""
    stats = base_statistics(docs, F.col("text"), ["doc_id", "lang", "source"])
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    scratch = Scratch(docs.sparkSession, "quality-rules")
    rows = scratch.written(stats.select(*columns, "lang", "source", *statistics_vector()), "quality-vectors")
    failed = (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))
    judged = robust_distances(rows, scratch=scratch, **options).select(*columns, failed.alias("base_failed"), F.col("d2").alias("distance"))
    judged = written(judged.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)), "quality")
    scratch.remove()
    return judged
