"""Session settings and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def build_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the jobs are tuned for."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("penmark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _shared_folder(spark: SparkSession) -> str | None:
    """The folder named by the cluster; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if spark.sparkContext.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="penmark-")
        spark.conf.set("spark.checkpoint.dir", folder)
        return folder
    return None


def staged(df: DataFrame, schema: StructType | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage with a table that outlives an executor, gives the
    optimizer a real size (so a join is broadcast only when the file is small),
    and fixes values such as row numbers that must not change on a retry.
    ``schema`` reads the stored layout under other types.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)


def staged_together(frames: dict[str, DataFrame], parallelism: int = 4) -> dict[str, DataFrame]:
    """Write several independent tables at once, so that one's last tasks overlap the next."""
    with ThreadPool(parallelism) as pool:
        return dict(zip(frames, pool.map(staged, frames.values())))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    folder = _shared_folder(spark)
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return f"{folder.rstrip('/')}/penmark/{uuid.uuid4().hex}/{name}"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition only an input with fewer splits than the cluster has cores.

    Large inputs already arrive in enough splits and are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *[F.col(k) for k in keys])


def by_speech(df: DataFrame) -> DataFrame:
    """Partition by ``speech_id`` into the session's full number of shuffle partitions.

    For steps that expand a small text into many rows and regroup them by speech:
    the text is moved once instead of its expansion. The number is explicit
    because the adaptive plan would merge partitions by their input size.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, "speech_id")


def small_side(df: DataFrame, rows: int, limit: int = 200_000) -> DataFrame:
    """Broadcast a side whose counted rows are within ``limit``, else leave the join to Spark."""
    return F.broadcast(df) if rows <= limit else df
