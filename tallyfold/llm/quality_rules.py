"""Quality rules: text statistics, fixed limits, and robust multivariate outliers. Native.

For each language and source the centre and spread of the transformed statistics come from the
minimum-covariance-determinant estimate: keep the three quarters of rows nearest to the centre, estimate anew from
them, and repeat until the determinant of no group falls any more. There are two starts, the medians with their absolute
deviations and the moments of all rows; each group takes the estimate with the least determinant. Rows whose
Mahalanobis distance from the final estimate is beyond ``CUTOFF`` are rejected. The quantile that
bounds the nearest rows is a mergeable summary, so a hot source is never gathered in one task.

Null texts count as empty, and an empty text has no words and fails the fixed limits. Null
languages and sources form groups of their own. A group with fewer than ``LEAST_ROWS`` rows that pass
the fixed limits is judged by the estimate of its whole language, and if that has too few rows as well,
by the estimate of all rows, however few. Repeated rows are each judged.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.operators.keys import join_on_keys
from tallyfold.session import settle

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Fixed limits: least words, greatest share of repeated words in percent.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Share of rows that the estimate keeps, least rows of a group with an estimate of its own.
NEAREST, LEAST_ROWS = 0.75, 50
#: Fall of the logarithm of the determinant's root that counts as one, and steps after which a start is given up.
SETTLED, MOST_STEPS = 1e-6, 40
#: Squared distance beyond which a row is rejected (a chi-square with five degrees goes beyond 45
#: once in 10^8), and that chi-square's median, to which distances are scaled.
CUTOFF, MIDDLE = 45.0, 4.351
#: The transformed statistics and the least spread each is given, so that a statistic that is
#: constant in a group does not turn the smallest difference into an outlier.
LEAST_SPREAD = {"f_words": 0.5, "f_length": 0.3, "f_symbols": 0.3, "f_lines": 0.1, "f_repeats": 0.1}
FEATURES = tuple(LEAST_SPREAD)


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts of each text: ``n_words``, ``word_chars``, ``n_symbols``, ``n_lines``,
    ``n_dup_lines``, ``n_repeat_words``; the text itself is dropped."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    names = [c for c in docs.columns if c != text]
    keep = [F.col(f"`{c}`") for c in names]
    inner = F.btrim(t, F.lit(SPACES))
    words = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))
    df = docs.select(*keep, t.alias("__t"), words.alias("__w"))
    lines = F.filter(F.split("__t", "\n"), lambda s: F.btrim(s, F.lit(SPACES)) != "")
    df = df.select(
        *keep, "__w", lines.alias("__lines"), F.size("__w").cast("long").alias("n_words"),
        F.char_length(F.translate("__t", SPACES, "")).cast("long").alias("word_chars"),
        (F.char_length("__t") - F.char_length(F.translate("__t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    counts = [F.col("n_words"), F.col("word_chars"), F.col("n_symbols")]
    # Three words in a row as one 64-bit hash; two different ones of a text meet about once in 10^13.
    windows = F.slice(
        F.transform("__w", lambda w, i: F.xxhash64(w, F.get("__w", i + 1), F.get("__w", i + 2))),
        1, F.greatest(F.col("n_words").cast("int") - 2, F.lit(0)))
    df = df.select(
        *keep, *counts, F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"), windows.alias("__h"))
    counts += [F.col("n_lines"), F.col("n_dup_lines")]
    # Only texts with a repeated window pay for sorting the windows with their places.
    pairs = F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    pairs = F.when(F.size(F.array_distinct("__h")) < F.size("__h"), pairs)
    df = df.select(*keep, *counts, pairs.alias("__p"))

    def twice(p: Column, i: Column) -> Column:
        before, after = F.get("__p", i - 1), F.get("__p", i + 1)
        return F.coalesce(before["h"] == p["h"], F.lit(False)) | F.coalesce(after["h"] == p["h"], F.lit(False))

    places = F.sort_array(F.transform(F.filter("__p", twice), lambda p: p["i"]))
    df = df.select(*keep, *counts, places.alias("__at"))
    # Each repeated window adds its three words, less those that the next one covers too.
    added = F.transform("__at", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("__at", i + 1) - p, F.lit(3))))
    covered = F.aggregate(added, F.lit(0).cast("long"), lambda a, x: a + x)
    return df.select(*keep, *counts, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def transformed(stats: DataFrame) -> DataFrame:
    """Adds the transformed statistics and ``base_failed``."""
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return stats.withColumns({
        "base_failed": failed,
        "f_words": F.log1p(F.col("n_words").cast("double")),
        "f_length": F.col("word_chars") / n,
        "f_symbols": F.log1p(100 * F.col("n_symbols") / chars),
        "f_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "f_repeats": F.col("n_repeat_words") / n,
    })


def _cov(i: int, j: int) -> str:
    return f"c_{max(i, j)}_{min(i, j)}"


def _cholesky(groups: DataFrame) -> DataFrame:
    """Replaces the covariances by their lower triangular root, column by column."""
    p = len(FEATURES)
    for j in range(p):
        below = [F.col(f"l_{j}_{k}") for k in range(j)]
        pivot = F.col(_cov(j, j)) + F.lit(LEAST_SPREAD[FEATURES[j]] ** 2)
        root = F.sqrt(F.greatest(reduce(lambda a, c: a - c * c, below, pivot), F.lit(1e-9)))
        groups = groups.withColumn(f"l_{j}_{j}", root)
        groups = groups.withColumns({
            f"l_{i}_{j}": reduce(
                lambda a, k: a - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}"), range(j), F.col(_cov(i, j))) / F.col(f"l_{j}_{j}")
            for i in range(j + 1, p)})
    return groups.drop(*[_cov(i, j) for i in range(p) for j in range(i + 1)])


def _distance(rows: DataFrame) -> DataFrame:
    """Adds ``d2``, the squared Mahalanobis distance, by forward substitution."""
    p = len(FEATURES)
    for i, f in enumerate(FEATURES):
        rest = reduce(lambda a, k: a - F.col(f"l_{i}_{k}") * F.col(f"y_{k}"), range(i), F.col(f) - F.col(f"m_{i}"))
        rows = rows.withColumn(f"y_{i}", rest / F.col(f"l_{i}_{i}"))
    d2 = reduce(add, [F.col(f"y_{i}") * F.col(f"y_{i}") for i in range(p)])
    return rows.withColumn("d2", d2).drop(*[f"y_{i}" for i in range(p)])


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Means and the root of the covariances of each group."""
    aggs = [F.avg(f).alias(f"m_{i}") for i, f in enumerate(FEATURES)]
    aggs += [F.covar_pop(FEATURES[i], FEATURES[j]).alias(_cov(i, j)) for i in range(len(FEATURES)) for j in range(i + 1)]
    return _cholesky(rows.groupBy(*keys).agg(*aggs))


def _pools(level: Column) -> list[Column]:
    """Names the rows that an estimate is made from: 0 for a language and source, 1 for a language, 2 for all."""
    return [
        level.alias("pool"), F.when(level < 2, F.col("g_lang")).alias("p_lang"),
        F.when(level < 1, F.col("g_source")).alias("p_source")]


def pools_of_groups(stats: DataFrame) -> DataFrame:
    """The pool of each language and source: the smallest with enough rows that pass the fixed limits."""
    groups = stats.groupBy("g_lang", "g_source").agg(F.count_if(~F.col("base_failed")).alias("n"))
    groups = settle(groups, "quality-groups")
    langs = groups.groupBy("g_lang").agg(F.sum("n").alias("n_lang"))
    level = F.when(F.col("n") >= LEAST_ROWS, 0).when(F.col("n_lang") >= LEAST_ROWS, 1).otherwise(2)
    groups = join_on_keys(groups, langs, ["g_lang"]).withColumn("level", level)
    return settle(groups.select("g_lang", "g_source", *_pools(F.col("level"))), "quality-pools")


def _least_determinant(estimates: DataFrame, keys: list[str]) -> DataFrame:
    """Of several estimates of a pool the one with the least determinant."""
    rest = [c for c in estimates.columns if c not in (*keys, "log_det")]
    return estimates.groupBy(*keys).agg(F.min(F.struct("log_det", *rest)).alias("e")).select(*keys, "e.*")


def _concentrated(rows: DataFrame, estimate: DataFrame, keys: list[str]) -> DataFrame:
    """Estimates from the nearest rows, again and again until no pool's determinant falls any more.

    A step cannot raise the determinant but for the approximate quantile, so each pool keeps its least. The logarithm
    of the root's determinant is in ``log_det``.
    """
    log_det = reduce(add, [F.log(F.col(f"l_{i}_{i}")) for i in range(len(FEATURES))])
    estimate, best = settle(estimate, "quality-start"), None
    for _ in range(MOST_STEPS):
        near = _distance(join_on_keys(rows, estimate, keys)).select(*keys, *FEATURES, "d2")
        bound = settle(near.groupBy(*keys).agg(F.percentile_approx("d2", NEAREST, 1000).alias("bound")), "quality-bound")
        moments = _moments(join_on_keys(near, bound, keys).where(F.col("d2") <= F.col("bound")), keys)
        moments = settle(moments.withColumn("log_det", log_det), "quality-step")
        if best is None:
            best, fell = moments, True
        else:
            before = best.select(*keys, F.col("log_det").alias("before"))
            fell = not join_on_keys(moments, before, keys).where(F.col("log_det") < F.col("before") - SETTLED).isEmpty()
            best = settle(_least_determinant(best.unionByName(moments), keys), "quality-best")
        if not fell:
            break
        estimate = moments.drop("log_det")
    return best


def robust_estimates(rows: DataFrame, pools: DataFrame, keys: list[str]) -> DataFrame:
    """Centre (``m_i``), root of the covariance (``l_i_j``) and scale of each of the ``pools`` with rows."""
    p = range(len(FEATURES))
    middle = join_on_keys(rows, pools, keys).groupBy(*keys).agg(
        *[F.percentile_approx(f, 0.5, 1000).alias(f"m_{i}") for i, f in enumerate(FEATURES)])
    middle = settle(middle, "quality-middle")
    off = [F.abs(F.col(f) - F.col(f"m_{i}")) for i, f in enumerate(FEATURES)]
    spread = join_on_keys(rows, middle, keys).groupBy(*keys).agg(
        *[F.percentile_approx(o, 0.5, 1000).alias(f"s_{i}") for i, o in enumerate(off)])
    roots = {f"l_{i}_{i}": F.greatest(1.4826 * F.col(f"s_{i}"), F.lit(LEAST_SPREAD[FEATURES[i]])) for i in p}
    roots |= {f"l_{i}_{j}": F.lit(0.0) for i in p for j in range(i)}
    estimate = join_on_keys(middle, spread, keys).select(*keys, *[f"m_{i}" for i in p], *[c.alias(n) for n, c in roots.items()])
    # Two starts: medians with their deviations, and the moments of all rows.
    starts = [estimate, _moments(join_on_keys(rows, pools, keys), keys)]
    found = [_concentrated(rows, start, keys) for start in starts]
    estimate = settle(_least_determinant(found[0].unionByName(found[1]), keys).drop("log_det"), "quality-estimate")
    scale = _distance(join_on_keys(rows, estimate, keys)).groupBy(*keys).agg(
        F.greatest(F.percentile_approx("d2", 0.5, 1000) / MIDDLE, F.lit(1.0)).alias("scale"))
    return settle(join_on_keys(estimate, scale, keys), "quality-final")


def judge_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
) -> DataFrame:
    """Key, the counts, ``base_failed``, ``distance`` (null only if no row passes the fixed limits) and ``kept``."""
    docs = docs.select(
        F.col(key).alias("k"), F.col(lang).alias("g_lang"), F.col(source).alias("g_source"), F.col(text).cast("string").alias("text"))
    groups, keys = ["g_lang", "g_source"], ["pool", "p_lang", "p_source"]
    stats = settle(transformed(text_statistics(docs)), "quality-statistics")
    pools = pools_of_groups(stats)
    rows = stats.where(~F.col("base_failed")).select(*groups, *FEATURES, F.explode(F.array(*map(F.lit, range(3)))).alias("level"))
    estimates = robust_estimates(rows.select(*_pools(F.col("level")), *FEATURES), pools.select(*keys).distinct(), keys)
    estimates = settle(join_on_keys(pools, estimates, keys).drop(*keys), "quality-of-groups")
    judged = _distance(join_on_keys(stats, estimates, groups, how="left"))
    distance = F.col("d2") / F.col("scale")
    return judged.select(
        F.col("k").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        distance.alias("distance"), (~F.col("base_failed") & F.coalesce(distance <= CUTOFF, F.lit(True))).alias("kept"))
