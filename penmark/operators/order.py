"""Exact order statistics of groups of any size, by counting passes instead of sorting a group.

Each wanted rank has an interval of values that holds it, at first the group's whole range. A pass
counts the rows of each interval in ``BINS`` equal bins, before the shuffle, and keeps the bin with
the rank, narrowed to the smallest and largest value in it. A rank is found when both are equal.
So a task holds counts, never the values of a group, and passes grow with the logarithm of its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from penmark.session import small_side, staged

BINS = 4096


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & left[k].eqNullSafe(right[f"_k_{k}"])
    return out


def _narrowed(values: DataFrame, keys: list[str], value: str, ranks: DataFrame) -> DataFrame:
    """One pass over the rows for the ranks (``keys, rank, before, lo, hi``) that are still open."""
    renamed = ranks.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "rank", "before", "lo", "hi")
    met = values.join(small_side(renamed, renamed.count()), _same(values, renamed, keys)).where(f"`{value}` >= lo AND `{value}` <= hi")
    # Halves, so that the width of a range is always finite.
    share = F.try_divide(F.col(value) / 2 - F.col("lo") / 2, F.col("hi") / 2 - F.col("lo") / 2)
    bins = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * BINS), F.lit(BINS - 1)).cast("int")
    counts = met.groupBy(*keys, "rank", "before", bins.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")
    )
    # At most ``BINS`` rows a rank.
    upto = F.sum("n").over(Window.partitionBy(*keys, "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("_ahead", F.col("before") + F.coalesce(upto, F.lit(0)))
    inside = (F.col("rank") >= F.col("_ahead")) & (F.col("rank") < F.col("_ahead") + F.col("n"))
    return counts.where(inside).select(*keys, "rank", F.col("_ahead").alias("before"), "lo", "hi")


def order_statistics(values: DataFrame, keys: list[str], value: str, ranks: DataFrame) -> DataFrame:
    """``keys, rank, v``: the value at each rank (from 0) of ``ranks`` (``keys, rank, lo, hi``), nulls left out."""
    values = values.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias(value))
    state = staged(ranks.select(*keys, "rank", F.lit(0).cast("long").alias("before"), "lo", "hi"))
    found = []
    while True:
        found.append(state.where("lo = hi").select(*keys, "rank", F.col("lo").alias("v")))
        state = state.where("lo < hi")
        if state.isEmpty():
            break
        state = staged(_narrowed(values, keys, value, state))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def percentiles(values: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """``keys, q``: the exact percentiles of each group, interpolated between neighbouring ranks."""
    v = F.col(value).cast("double")
    sizes = values.where(v.isNotNull()).groupBy(*keys).agg(F.count(v).alias("_n"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    sizes = staged(sizes)
    place = lambda p: (F.col("_n") - 1) * F.lit(float(p))
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(p)), F.ceil(place(p))) for p in shares])))
    ranks = sizes.select(*keys, F.explode(wanted.cast("array<long>")).alias("rank"), "lo", "hi")
    found = order_statistics(values, keys, value, ranks)
    # At most two ranks a share.
    by_rank = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("_v"))
    by_rank = by_rank.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_v")

    def between(p: float) -> Column:
        low, high = F.floor(place(p)).cast("long"), F.ceil(place(p)).cast("long")
        a, b = F.element_at("_v", low), F.element_at("_v", high)
        return F.when(low == high, a).otherwise((high - place(p)) * a + (place(p) - low) * b)

    return sizes.join(by_rank, _same(sizes, by_rank, keys)).select(*keys, F.array(*[between(p) for p in shares]).alias("q"))
