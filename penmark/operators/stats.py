"""Group tests, correlation and summaries over ``speaker, method, f1`` tables.

``keys`` names the columns that separate independent tests (for example
``["method"]``). All sums are combined before the shuffle; exact medians and
quartiles come from counting passes, so no task holds the values of a group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from penmark.functions.tails import f_tail, normal_quantile, normal_tail, t_tail
from penmark.functions.tukey import studentized_range_tail
from penmark.operators.order import percentiles
from penmark.operators.ranks import sorted_numbers


def with_groups(values: DataFrame, labels: DataFrame) -> DataFrame:
    """Join each speaker's score with its group label, by name; drop groups of one.

    ``values``: keys, ``speaker``, ``f1``. ``labels``: ``speaker, label`` and, for several
    groupings at once, the ``kind`` of each label.
    """
    by = [c for c in labels.columns if c != "speaker"]
    sizes = labels.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    kept = labels.join(sizes, by, "left_semi").withColumnRenamed("label", "grp")
    return values.join(kept, "speaker")


def group_sums(values: DataFrame, keys: list[str], value: str = "f1") -> DataFrame:
    """Size, mean and within-group squared deviation of every group."""
    v = F.col(value)
    return values.groupBy(*keys, "grp").agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        (F.var_pop(v) * F.count(v)).alias("ss"),
    )


def anova(values: DataFrame, keys: list[str], value: str = "f1") -> DataFrame:
    """One-way analysis of variance: F, its degrees of freedom, p and MSE."""
    groups = group_sums(values, keys, value)
    total, n = F.sum(F.col("n") * F.col("mean")), F.sum("n")
    # Between-group sum of squares as a variance of the means, weighted by size.
    per_test = groups.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("k"), n.alias("n"), F.sum("ss").alias("ssw"), (total / n).alias("grand")
    )
    dev = F.col("mean") - F.col("grand")
    between = (
        groups.drop("ss").withColumnRenamed("n", "n_g").join(per_test, keys)
        .groupBy(*keys, "k", "n", "ssw").agg(F.sum(F.col("n_g") * dev * dev).alias("ssb"))
    )
    d1, d2 = F.col("k") - 1, F.col("n") - F.col("k")
    mse = F.try_divide(F.col("ssw"), d2)
    stat = F.try_divide(F.try_divide(F.col("ssb"), d1), mse)
    return between.select(
        *keys, "k", "n", d1.alias("df_between"), d2.alias("df_within"), mse.alias("mse"), stat.alias("f_stat"),
        f_tail(stat, d1, d2).alias("p"),
    )


def levene(values: DataFrame, keys: list[str], value: str = "f1") -> DataFrame:
    """Equal-variance test on absolute deviations from the group median."""
    medians = percentiles(values, [*keys, "grp"], value, [0.5]).select(*keys, "grp", F.col("q")[0].alias("_median"))
    dev = values.join(medians, [*keys, "grp"], "left").withColumn("_dev", F.abs(F.col(value) - F.col("_median")))
    return anova(dev, keys, "_dev")


def tukey(values: DataFrame, keys: list[str], value: str = "f1") -> DataFrame:
    """Studentized range statistic of every pair of groups.

    Joins group means (a row per group), never the rows themselves.
    """
    groups = group_sums(values, keys, value)
    error = anova(values, keys, value).select(*keys, "k", "df_within", "mse")
    a = groups.select(*keys, F.col("grp").alias("group_a"), F.col("n").alias("n_a"), F.col("mean").alias("mean_a"))
    b = groups.select(*keys, F.col("grp").alias("group_b"), F.col("n").alias("n_b"), F.col("mean").alias("mean_b"))
    pairs = a.join(b, keys).where(F.col("group_a") < F.col("group_b")).join(error, keys)
    spread = F.sqrt(F.col("mse") / 2 * (1 / F.col("n_a") + 1 / F.col("n_b")))
    diff = F.col("mean_b") - F.col("mean_a")
    return pairs.select(
        *keys, "group_a", "group_b", diff.alias("mean_diff"), F.try_divide(F.abs(diff), spread).alias("q"), "k", "df_within"
    )


def tukey_hsd(
    values: DataFrame, keys: list[str], value: str = "f1", alpha: float = 0.05, gate: float = 0.05
) -> DataFrame:
    """Pairs with p, for the tests whose analysis of variance has a p below ``gate``."""
    significant = anova(values, keys, value).where(F.col("p") < gate).select(*keys)
    pairs = tukey(values, keys, value).join(significant, keys, "left_semi")
    p = studentized_range_tail(F.col("q"), F.col("k").cast("double"), F.col("df_within").cast("double"))
    return pairs.withColumn("p", p).withColumn("reject", F.col("p") < alpha)


def average_ranks(values: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """``keys, value, name``: mean rank of every distinct value.

    Equal values are counted first, the distinct ones are numbered by a
    distributed sort, and a second sort-free pass adds up the counts before each.
    """
    counts = values.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    numbered = sorted_numbers(counts, [F.col(value)], keys)
    # Running sum of tie counts over blocks of numbers: no window holds more than a block.
    block = F.floor((F.col("rn") - 1) / 4096)
    blocked = numbered.withColumn("_b", block)
    totals = blocked.groupBy(*keys, "_b").agg(F.sum("_n").alias("_t"))
    run = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = totals.select(*keys, "_b", (F.sum("_t").over(run) - F.col("_t")).alias("_before"))
    inside = Window.partitionBy(*keys, "_b").orderBy("rn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.sum("_n").over(inside) + F.col("_before")
    ranked = blocked.join(before, [*keys, "_b"])
    return ranked.select(*keys, value, (upto - (F.col("_n") - 1) / 2).cast("double").alias(name))


def spearman(values: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation of two columns and its two-sided p."""
    rows = values.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    rows = rows.join(average_ranks(rows, keys, x, "_rx"), [*keys, x]).join(average_ranks(rows, keys, y, "_ry"), [*keys, y])
    stats = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr("_rx", "_ry").alias("r"))
    df = F.col("n") - 2
    t = F.col("r") * F.sqrt(F.try_divide(df.cast("double"), 1 - F.col("r") * F.col("r")))
    p = F.when(F.abs(F.col("r")) >= 1 - 1e-15, 0.0).otherwise(t_tail(t, df))
    return stats.select(*keys, "n", "r", F.when(df > 0, p).alias("p"))


def best_fit(values: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Least-squares line of y on x."""
    return values.groupBy(*keys).agg(
        F.regr_count(y, x).alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
    )


def box_summary(values: DataFrame, keys: list[str], value: str = "f1") -> DataFrame:
    """Quartiles, whiskers at 1.5 interquartile ranges, and outlier count per group."""
    v = F.col(value)
    quartiles = percentiles(values, [*keys, "grp"], value, [0.25, 0.5, 0.75]).withColumnRenamed("q", "_q")
    fences = quartiles.select(
        *keys, "grp", *[F.col("_q")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))]
    ).withColumn("_iqr", F.col("q3") - F.col("q1"))
    rows = values.join(fences, [*keys, "grp"], "left")
    inside = (v >= F.col("q1") - 1.5 * F.col("_iqr")) & (v <= F.col("q3") + 1.5 * F.col("_iqr"))
    return rows.groupBy(*keys, "grp", "q1", "median", "q3").agg(
        F.count(v).alias("n"),
        F.min(F.when(inside, v)).alias("whisker_low"),
        F.max(F.when(inside, v)).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
    )


def residuals(values: DataFrame, keys: list[str], value: str = "f1") -> DataFrame:
    means = values.groupBy(*keys, "grp").agg(F.avg(value).alias("_mean"))
    return values.join(means, [*keys, "grp"]).withColumn("resid", F.col(value) - F.col("_mean"))


def _poly(x: Column, *coefficients: float) -> Column:
    out = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        out = out * x + c
    return out


def shapiro(values: DataFrame, keys: list[str], value: str = "resid", row_id: str = "speaker") -> DataFrame:
    """Shapiro-Wilk W and p (Royston's 1995 approximation; exact for n = 3).

    Order statistics come from the distributed sort; W needs only sums over
    them and the two values at each end.
    """
    rows = values.where(F.col(value).isNotNull()).select(*keys, row_id, F.col(value).alias("x"))
    numbered = sorted_numbers(rows, [F.col("x"), F.col(row_id)], keys)
    totals = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.var_pop("x") * F.count(F.lit(1))).alias("ss"))
    scored = numbered.join(totals, keys).withColumn(
        "m", normal_quantile((F.col("rn") - 0.375) / (F.col("n") + 0.25))
    )
    at = lambda i: F.max(F.when(F.col("rn") == i, F.col("x")))
    m_at = lambda i: F.max(F.when(F.col("rn") == i, F.col("m")))
    n = F.col("n")
    sums = scored.groupBy(*keys, "n", "ss").agg(
        F.sum(F.col("m") * F.col("m")).alias("mm"),
        F.sum(F.when((F.col("rn") > 2) & (F.col("rn") < n - 1), F.col("m") * F.col("x"))).alias("inner2"),
        F.sum(F.when((F.col("rn") > 1) & (F.col("rn") < n), F.col("m") * F.col("x"))).alias("inner1"),
        at(F.lit(1)).alias("x1"), at(F.lit(2)).alias("x2"), at(n - 1).alias("y2"), at(n).alias("y1"),
        m_at(n).alias("m1"), m_at(n - 1).alias("m2"),
    )
    u = 1 / F.sqrt(n.cast("double"))
    root = F.sqrt("mm")
    # Royston's polynomial coefficients.
    a1 = _poly(u, -2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0) + F.col("m1") / root
    a2 = _poly(u, -3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0) + F.col("m2") / root
    m1, m2, mm = F.col("m1"), F.col("m2"), F.col("mm")
    phi2 = (mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)
    phi1 = (mm - 2 * m1 * m1) / (1 - 2 * a1 * a1)
    big = a1 * (F.col("y1") - F.col("x1")) + a2 * (F.col("y2") - F.col("x2")) + F.coalesce("inner2", F.lit(0.0)) / F.sqrt(phi2)
    small = a1 * (F.col("y1") - F.col("x1")) + F.coalesce("inner1", F.lit(0.0)) / F.sqrt(phi1)
    three = (F.col("y1") - F.col("x1")) / math.sqrt(2)
    b = F.when(n > 5, big).when(n > 3, small).otherwise(three)
    out = sums.select(*keys, "n", F.when(n >= 3, F.try_divide(b * b, F.col("ss"))).alias("w"))
    ln_n = F.log(n.cast("double"))
    few = n <= 11
    nd = n.cast("double")
    mu = F.when(few, _poly(nd, -0.0006714, 0.025054, -0.39978, 0.5440)).otherwise(
        _poly(ln_n, 0.0038915, -0.083751, -0.31082, -1.5861)
    )
    sigma = F.exp(
        F.when(few, _poly(nd, -0.0020322, 0.062767, -0.77857, 1.3822)).otherwise(
            _poly(ln_n, 0.0030302, -0.082676, -0.4803)
        )
    )
    rest = F.log(1 - F.col("w"))
    z = (F.when(few, -F.log(_poly(nd, 0.459, -2.273) - rest)).otherwise(rest) - mu) / sigma
    of_three = F.greatest(F.lit(0.0), 6 / math.pi * (F.asin(F.sqrt("w")) - math.asin(math.sqrt(0.75))))
    return out.withColumn("p", F.when(n == 3, of_three).when(F.col("w") < 1, normal_tail(z)))
