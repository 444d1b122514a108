"""Exact row numbers that never put a whole group into one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from penmark.session import staged

SEED = 42


def shuffle_key(row_id: str = "speech_id", seed: int = SEED) -> Column:
    """A reproducible random order: md5 of seed and row id."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row_id).cast("string")))


CUT_ROWS = 1 << 16  # rows that a cut of a group holds on average at most
DIGITS = 8


def _depth(size: Column) -> Column:
    """Hex digits that cut a group of ``size`` rows into cuts of ``CUT_ROWS``, exactly counted: 0 for a small group."""
    steps = [F.when(size > CUT_ROWS * 16**d, 1).otherwise(0) for d in range(DIGITS)]
    return reduce(lambda a, b: a + b, steps)


def shuffled_rank(df: DataFrame, keys: list[str], row_id: str = "speech_id", seed: int = SEED) -> DataFrame:
    """Add ``rn`` (1.. in shuffled order within ``keys``) and ``group_size``.

    A group is cut by as many leading hex digits of the shuffle key as its counted size needs; each
    cut is numbered by itself and shifted by the sizes of the cuts before it. No task holds more than
    a cut or, for the shifts, one row per ``CUT_ROWS / 16`` rows of a group.
    """
    cut = [*keys, "_cut"]
    same = lambda columns: reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in columns])
    # Written, so that the join knows how small it is and a large group stays where it was read.
    groups = staged(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_size")))
    groups = groups.select(*[F.col(c).alias(f"_s_{c}") for c in keys], "group_size", _depth(F.col("group_size")).alias("_depth"))
    hashed = df.withColumn("_h", shuffle_key(row_id, seed)).join(groups, same(keys)).select(
        *df.columns, "_h", "group_size", F.substring(F.col("_h"), F.lit(1), F.col("_depth")).alias("_cut")
    )
    sizes = hashed.groupBy(*cut).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_cut").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    shifts = sizes.select(*[F.col(c).alias(f"_s_{c}") for c in cut], (before - F.col("_n")).alias("_shift"))
    inside = F.row_number().over(Window.partitionBy(*cut).orderBy("_h", row_id))
    numbered = hashed.withColumn("_rn", inside).join(shifts, same(cut))
    return numbered.select(*df.columns, (F.col("_rn") + F.col("_shift")).alias("rn"), "group_size")


def sorted_numbers(df: DataFrame, order: list[Column], keys: list[str] | None = None) -> DataFrame:
    """Add ``rn``: the exact position in a total order, within ``keys`` when given.

    One range-partitioned sort, written with its partition number, then shifted
    by the row counts of the earlier partitions. ``order`` must be a total order.
    """
    keys = keys or []
    ordered = df.orderBy(*[F.col(k) for k in keys], *order)
    ordered = ordered.withColumn("_seq", F.monotonically_increasing_id())
    ordered = staged(ordered.withColumn("_part", F.shiftright("_seq", 33)))
    sizes = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # One row per sort partition: bounded by the shuffle partition setting.
    shifts = sizes.select(F.col("_part").alias("_p"), (before - F.col("_n")).alias("_shift"))
    local = F.col("_seq") - F.shiftleft("_part", 33) + 1
    numbered = ordered.join(F.broadcast(shifts), F.col("_part") == F.col("_p")).select(
        *df.columns, (local + F.col("_shift")).alias("rn")
    )
    if not keys:
        return numbered
    starts = numbered.groupBy(*keys).agg((F.min("rn") - 1).alias("_start"))
    return numbered.join(starts, keys).select(*df.columns, (F.col("rn") - F.col("_start")).alias("rn"))
