"""The series of feature sets that an experiment compares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from penmark.operators.features import SWITCHES

# Display names of the switches, in naming order.
DISPLAY = {
    "base_features": "BaseFeatures",
    "pos_tags": "POS",
    "stress": "STRESS",
    "liwc_gram": "LIWC_GRAM",
    "liwc_obj": "LIWC_OBJ",
    "liwc_cog": "LIWC_COG",
    "liwc_feels": "LIWC_FEELS",
}
# The full set leaves the object categories out.
FULL = [s for s in SWITCHES if s != "liwc_obj"]


def method_name(switches: list[str]) -> str:
    """``ALL`` for the full set, ``ALL - X`` for it without one, else the names joined."""
    on = {s for s in DISPLAY if s in switches}
    missing = [s for s in FULL if s not in on]
    if "liwc_obj" not in on and len(missing) <= 1:
        return " - ".join(["ALL", *[DISPLAY[s] for s in missing]])
    return " + ".join(DISPLAY[s] for s in DISPLAY if s in on)


def series() -> list[list[str]]:
    """Base; base plus one other; all; all but one."""
    others = FULL[1:]
    return [[FULL[0]], *[[FULL[0], s] for s in others], FULL, *[[s for s in FULL if s != out] for out in FULL]]


def feature_sets(spark: SparkSession) -> DataFrame:
    """``set_no, method, switches`` of the whole series."""
    rows = [F.struct(F.lit(i).alias("set_no"), F.lit(method_name(s)).alias("method"), F.lit(s).alias("switches"))
            for i, s in enumerate(series())]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
