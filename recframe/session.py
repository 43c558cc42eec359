"""Session helpers: one place for the configuration every job relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings the operators depend on for correctness (UTC clock, ANSI casts) and
# for scale (AQE re-planning, skew splitting, coalescing of tiny partitions).
_REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "recframe", driver_memory: str | None = None) -> SparkSession:
    """Return the active session, creating a local one when none exists.

    ``driver_memory`` only matters in local mode (the driver JVM runs the
    executors there) and only before the JVM starts."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    for k, v in _REQUIRED_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    for k in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled"):
        spark.conf.set(k, _REQUIRED_CONF[k])
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` is read from the session.  Where it is unset, only a
    local master may use a private folder (tests); on a cluster this raises, for
    a machine-local folder would not be shared.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="recframe-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written inside drops its shuffle files as it ends.  They are else kept
    until the driver collects its garbage, beside those of all later steps."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    Reliable checkpoints survive executor loss (unlike local checkpoints).
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame, name: str = "rows") -> DataFrame:
    """``df`` written to the shared checkpoint folder as compressed columns and read back.

    Cuts the lineage like ``cut_lineage``, for tables of many rows: a checkpoint
    writes whole rows uncompressed, several times the bytes, and is read whole
    whatever columns are asked for."""
    return store_parts([df], name)


def store_parts(parts: list[DataFrame], name: str = "rows") -> DataFrame:
    """The rows of all ``parts`` (of one schema) written like ``store``, one part after
    the other, so that only one part's shuffle files lie on the disks at a time."""
    spark = parts[0].sparkSession
    folder = f"{checkpoint_dir(spark)}/recframe-io/{name}-{uuid.uuid4().hex}"
    for df in parts:
        with shuffles_dropped(spark):
            df.write.option("compression", "zstd").mode("append").parquet(folder)
    return spark.read.schema(parts[0].schema).parquet(folder)


#: Rows of a few values that are sent to every executor.
FEW = 200_000


def few(df: DataFrame) -> DataFrame:
    """``df``, a stored or fitted table, marked to be sent to every executor if it has
    few rows; its counted rows tell, where Spark's estimate would exchange both sides."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def env_int(name: str, default: int) -> int:
    try:
        return int(os.environ.get(name, default))
    except ValueError:
        return default
