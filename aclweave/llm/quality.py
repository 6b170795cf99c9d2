"""Quality rules: base counts of every text, and robust multivariate outliers by language and source.

All work is DataFrame expressions. A text's counts become a vector of five transformed statistics: log of the words, mean
word length, and the square roots of the shares of symbols, of repeated lines and of repeated words. For each language and
source the minimum-covariance-determinant estimate is searched from four starts (medians and absolute deviations; mean and
covariance; correlations of squashed statistics; spatial signs). A concentration step keeps the ``KEEP`` of texts with the
smallest distances and estimates mean and covariance from them, so the determinant falls. After two steps from each start the
one with the least determinant goes on until that hardly falls; a last step takes in all texts up to the 97.5 % quantile of
chi-squared. Covariances are solved by a Cholesky factor written out as columns. Texts whose squared Mahalanobis distance
exceeds the quantile of chi-squared that a share ``ALPHA`` of normal vectors would exceed are rejected: so small a share that
chance alone takes less than one of all texts of a corpus of 100 TB, since real statistics have wider tails than normal ones.

Groups of fewer than ``LEAST`` texts use their language's estimate, and where that has too few, that of all texts. Equal
counts of copies can't make a covariance singular: every variance has a floor, the same in all steps.

Defined results: a null or empty text has no words and fails the base rule; null langs or sources form groups of their own;
an empty table gives no rows; repeated rows are judged each; further columns are ignored.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import saved, table

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"
STATS = ("s1", "s2", "s3", "s4", "s5")
#: Columns of an estimate: means and Cholesky factor.
NAMES = tuple([f"m{i}" for i in range(5)] + [f"l{i}{j}" for i in range(5) for j in range(i + 1)])
#: Least standard deviation of each statistic that an estimate may have.
FLOORS = (0.25, 0.4, 0.04, 0.08, 0.12)
LEAST, STEPS, KEEP, ALPHA = 50, 8, 0.75, 1e-11
#: Up to so many groups' estimates are sent to every task; more are joined, each in so many copies as there are salts.
GROUPS_IN_TASK, SALTS = 10_000, 16


def _repeats(words: Column) -> Column:
    """Words in 3-word windows that are found twice or more, the first included.

    Windows are hashed to 64 bits and sorted; where any hash is repeated, the repeated windows' places follow, either by
    looking each up among the few repeated hashes or, where these are many, by sorting (hash, place) pairs; both give the
    same. Each repeated window covers three words, less what the next one covers again.
    """
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)))
    return F.when(n >= 3, hashes).otherwise(F.array().cast("array<bigint>"))


def _pairwise(a: Column) -> Column:
    """Elements of a sorted array that equal the one before."""
    return F.filter(F.zip_with(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull())


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts."""
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(text, r"[ \t-\r]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    one = docs.select(
        "doc_id",
        "lang",
        "source",
        F.length(F.translate(text, SPACES, "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.size(lines).cast("bigint").alias("n_lines"),
        F.size(F.array_distinct(lines)).cast("bigint").alias("_distinct_lines"),
        words.alias("_words"),
    )
    two = one.select("*", F.size("_words").cast("bigint").alias("n_words"), _repeats(F.col("_words")).alias("_h")).drop("_words")
    three = two.select("*", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.array_distinct(_pairwise(F.sort_array("_h")))).otherwise(F.array().cast("array<bigint>")).alias("_again"))
    places = F.when(F.size("_again") == 0, F.array().cast("array<int>"))
    few = F.filter(F.transform("_h", lambda x, i: F.when(F.array_contains("_again", x), i)), lambda x: x.isNotNull())
    pairs = F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    many_of = lambda p: F.sort_array(
        F.filter(
            F.transform(
                p,
                lambda x, i: F.when(
                    F.get(p, i - 1)["h"].eqNullSafe(x["h"]) | F.get(p, i + 1)["h"].eqNullSafe(x["h"]),
                    x["i"],
                ),
            ),
            lambda x: x.isNotNull(),
        )
    )
    four = three.select("*", F.when(F.size("_again") > 64, pairs).alias("_pairs"))
    placed = places.when(F.size("_again") <= 64, few).otherwise(many_of(F.col("_pairs")))
    five = four.select("*", placed.alias("_places")).drop("_h", "_pairs", "_again")
    n = F.size("_places")
    steps = F.zip_with(F.slice("_places", 2, F.greatest(n - 1, F.lit(0))), F.slice("_places", 1, F.greatest(n - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(3)))
    covered = F.when(n == 0, F.lit(0)).otherwise(F.aggregate(steps, F.lit(3), lambda a, x: a + x))
    return five.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", (F.col("n_lines") - F.col("_distinct_lines")).alias("n_dup_lines"), covered.cast("bigint").alias("n_repeat_words"), "n_lines")


def statistics(counts: DataFrame) -> DataFrame:
    words = F.greatest("n_words", F.lit(1))
    return counts.select(
        "*",
        F.log1p("n_words").alias("s1"),
        F.least(F.col("word_chars") / words, F.lit(40.0)).alias("s2"),
        F.sqrt(F.col("n_symbols") / F.greatest("word_chars", F.lit(1))).alias("s3"),
        F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("s4"),
        F.sqrt(F.col("n_repeat_words") / words).alias("s5"),
    )


def _below(x: float, k: int) -> float:
    """The chi-squared distribution function, by its series."""
    a, x = k / 2, x / 2
    term = total = 1 / a
    for i in range(1, 600):
        term *= x / (a + i)
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def quantile(share: float, k: int, above: bool = False) -> float:
    """What a chi-squared variable falls below with chance ``share`` (or, with ``above``, exceeds)."""
    low, high = 1e-9, 400.0
    for _ in range(200):
        mid = (low + high) / 2
        # far out, the upper tail by its leading terms (k odd), since 1 less the series has no digits left
        beyond = math.erfc(math.sqrt(mid / 2)) + math.sqrt(2 * mid / math.pi) * math.exp(-mid / 2) * sum(mid**i / math.prod(range(3, 2 * i + 2, 2)) for i in range((k - 1) // 2)) if above else 0.0
        low, high = (mid, high) if (beyond > share if above else _below(mid, k) < share) else (low, mid)
    return low


def _consistency(keep: float, d: int) -> float:
    """What the covariance of the inner share ``keep`` of a normal cloud is multiplied by."""
    return keep / _below(quantile(keep, d), d + 2)


def _estimates(rows: DataFrame, keys: list[str], scale: float) -> DataFrame:
    """Count, means and Cholesky factor of the (floored) covariance of the rows of each group."""
    d = range(len(STATS))
    # plain sums of products: statistics are small numbers and variances have floors, so nothing is lost to rounding
    sums = [F.count("*").alias("_n")] + [F.sum(s).alias(f"_s{i}") for i, s in enumerate(STATS)]
    sums += [F.sum(F.col(STATS[i]) * F.col(STATS[j])).alias(f"_p{i}{j}") for i in d for j in d if j <= i]
    out = rows.groupBy(*keys).agg(*sums)
    means = [(F.col(f"_s{i}") / F.col("_n")).alias(f"m{i}") for i in d]
    out = out.select(*keys, "_n", *means, *[(F.col(f"_p{i}{j}") / F.col("_n") - F.col(f"_s{i}") / F.col("_n") * F.col(f"_s{j}") / F.col("_n")).alias(f"v{i}{j}") for i in d for j in d if j <= i])
    for i in d:  # column by column, so that no expression repeats another
        for j in range(i + 1):
            v = F.col(f"v{i}{j}") * scale + (F.lit(FLOORS[i] ** 2) if i == j else 0)
            for k in range(j):
                v = v - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(v, F.lit(FLOORS[i] ** 2 / 4))) if i == j else v / F.col(f"l{j}{j}"))
    logdet = functools.reduce(lambda a, b: a + b, [2 * F.log(f"l{i}{i}") for i in d])
    return out.select(*keys, "_n", *NAMES, logdet.alias("logdet"))


def _distance(rows: DataFrame) -> DataFrame:
    """rows with the squared Mahalanobis distance ``_d2`` by the estimate columns beside them."""
    for i, s in enumerate(STATS):
        y = F.col(s) - F.col(f"m{i}")
        for j in range(i):
            y = y - F.col(f"l{i}{j}") * F.col(f"_y{j}")
        rows = rows.withColumn(f"_y{i}", y / F.col(f"l{i}{i}"))
    total = functools.reduce(lambda a, b: a + b, [F.col(f"_y{i}") * F.col(f"_y{i}") for i in range(len(STATS))])
    return rows.withColumn("_d2", total)


def _match(rows: DataFrame, groups: DataFrame, keys: list[str], few: bool, how: str = "inner") -> DataFrame:
    """Join on null-safe keys; where groups are many, a crowded one is dealt to SALTS tasks."""
    right = groups.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = [rows[k].eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    if few:
        right = F.broadcast(right)
    else:
        rows = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
        right = right.withColumn("_k_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        same.append(F.col("_salt") == F.col("_k_salt"))
    return rows.join(right, functools.reduce(lambda a, b: a & b, same, F.lit(True)), how).drop(*[f"_k_{k}" for k in keys], "_salt", "_k_salt")


def _starts(stats: DataFrame, keys: list[str], least: Column) -> tuple[DataFrame, bool]:
    """Four first estimates (``_start``) of each group that ``least`` admits, and whether groups are few."""
    d = range(len(STATS))
    middle = lambda x, name: F.percentile_approx(x, 0.5, 1000).alias(name)
    medians = stats.groupBy(*keys).agg(F.count("*").alias("_n"), *[middle(s, f"m{i}") for i, s in enumerate(STATS)]).filter(least)
    medians = saved(medians, "medians")
    few = medians.count() <= GROUPS_IN_TASK
    spread = _match(stats, medians, keys, few).groupBy(*keys).agg(*[middle(F.abs(F.col(s) - F.col(f"m{i}")), f"_a{i}") for i, s in enumerate(STATS)])
    spread = spread.select(*keys, *[F.greatest(1.4826 * F.col(f"_a{i}"), F.lit(FLOORS[i])).alias(f"_a{i}") for i in d])
    centre = saved(_match(medians, spread, keys, few), "centre")
    first = centre.select(*keys, F.lit(0).alias("_start"), *[f"m{i}" for i in d], *[F.col(f"_a{i}").alias(f"l{i}{j}") if i == j else F.lit(0.0).alias(f"l{i}{j}") for i in d for j in range(i + 1)])
    z = [(F.col(s) - F.col(f"m{i}")) / F.col(f"_a{i}") for i, s in enumerate(STATS)]
    norm = F.sqrt(functools.reduce(lambda a, b: a + b, [x * x for x in z]) + 1e-12)
    kinds = [[F.col(s) for s in STATS], [(F.exp(2 * F.greatest(F.lit(-20.0), F.least(x, F.lit(20.0)))) - 1) / (F.exp(2 * F.greatest(F.lit(-20.0), F.least(x, F.lit(20.0)))) + 1) for x in z], [x / norm for x in z]]
    wide = _match(stats, centre, keys, few)
    forms = [F.struct(F.lit(k + 1).alias("_start"), *[(x if k == 0 else x * F.col(f"_a{i}")).alias(STATS[i]) for i, x in enumerate(form)]) for k, form in enumerate(kinds)]
    others = _estimates(wide.select(*keys, F.explode(F.array(*forms)).alias("x")).select(*keys, "x.*"), [*keys, "_start"], 1.0)
    own = centre.select(*keys, *[F.col(f"m{i}").alias(f"_c{i}") for i in d])
    others = _match(others, own, keys, few)
    others = others.select(*keys, "_start", *[F.when(F.col("_start") == 1, F.col(f"m{i}")).otherwise(F.col(f"_c{i}")).alias(f"m{i}") for i in d], *NAMES[len(STATS) :])
    return saved(first.unionByName(others), "starts"), few


def _concentrated(stats: DataFrame, estimate: DataFrame, keys: list[str], keep: float, few: bool) -> DataFrame:
    """The estimates (of each ``_start``) from the share ``keep`` of each group with the smallest distances."""
    by = [*keys, "_start"]
    near = _distance(_match(stats, estimate.select(*by, *NAMES), keys, few)).select(*by, *STATS, "_d2")
    cuts = near.groupBy(*by).agg(F.percentile_approx("_d2", keep, 1000).alias("_cut"))
    return _estimates(_match(near, cuts, by, few).filter("_d2 <= _cut"), by, _consistency(keep, len(STATS)))


def robust_estimates(stats: DataFrame, keys: list[str], steps: int = STEPS, keep: float = KEEP, least: Column | None = None) -> DataFrame:
    """Each group's minimum-covariance-determinant estimate: the least of four starts, concentrated until it hardly falls."""
    stats = stats.select(*keys, *STATS)
    estimate, few = _starts(stats, keys, F.lit(True) if least is None else least)
    for _ in range(2):
        estimate = saved(_concentrated(stats, estimate, keys, keep, few), "estimate")
    values = ["logdet", "_start", "_n", *NAMES]
    best = lambda df: df.groupBy(*keys).agg(F.min(F.struct(*values)).alias("_b")).select(*keys, "_b.*")
    estimate = saved(best(estimate), "estimate")
    for _ in range(steps):
        after = best(_concentrated(stats, estimate, keys, keep, few).select(*keys, *values).unionByName(estimate.select(*keys, *values)))
        before = estimate.select(*keys, F.col("logdet").alias("_was"))
        estimate = saved(_match(after, before, keys, few), "estimate")
        if (estimate.agg(F.max(F.col("_was") - F.col("logdet"))).first()[0] or 0.0) < 1e-3:
            break
    inner = _distance(_match(stats, estimate.select(*keys, *NAMES), keys, few)).filter(F.col("_d2") <= quantile(0.975, len(STATS)))
    return saved(_estimates(inner, keys, _consistency(0.975, len(STATS))), "estimate")


def judge(docs: DataFrame, alpha: float = ALPHA, least: int = LEAST) -> DataFrame:
    """Counts, squared distance, which level's estimate judged, and the verdicts."""
    stats = saved(statistics(base_counts(docs)), "statistics")
    none = F.lit(None).cast("string")
    levels = [("lang and source", F.col("lang"), F.col("source")), ("lang", F.col("lang"), none), ("all", none, none)]
    group = lambda k: F.struct(F.lit(k).alias("level"), levels[k][1].alias("lang"), levels[k][2].alias("source"))
    rows = stats.select(F.explode(F.array(*[group(k) for k in range(3)])).alias("_g"), *STATS)
    found = robust_estimates(rows, ["_g"], least=(F.col("_n") >= least) | (F.col("_g.level") == 2))
    found = found.select("_g", F.struct(*NAMES).alias("_e"))
    few = found.count() <= GROUPS_IN_TASK
    # each row takes the first level that has its group
    out = stats
    for k in range(3):
        own = found.filter(F.col("_g.level") == k).select(F.col("_g").alias(f"_g{k}"), F.col("_e").alias(f"_e{k}"))
        out = _match(out.withColumn(f"_g{k}", group(k)), own, [f"_g{k}"], few or k == 2, "left")
    level = F.when(F.col("_e0").isNotNull(), F.lit(levels[0][0])).when(F.col("_e1").isNotNull(), F.lit(levels[1][0])).otherwise(F.lit(levels[2][0]))
    out = out.withColumn("_e", F.coalesce("_e0", "_e1", "_e2")).withColumn("level", level)
    out = _distance(out.select("*", *[F.col("_e")[n].alias(n) for n in NAMES]))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    outlier = F.col("_d2") > quantile(alpha, len(STATS), above=True)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~F.coalesce(outlier, F.lit(False))).alias("kept"), F.col("_d2").alias("distance2"), "level")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
