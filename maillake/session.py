"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
SHARED_KEY = "maillake.shared.dir"
SPREAD_KEY = "maillake.input.partitions"


def get_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("maillake")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a
    local session (tests, one machine) gets a temporary folder, remembered in
    the session; any other raises, as executors would each write to a disk of their own.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.conf.get(SHARED_KEY, None)
    if not named:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that the executors of {master} share")
        named = tempfile.mkdtemp(prefix="maillake-")
        spark.conf.set(SHARED_KEY, named)
    return named.rstrip("/")


def scratch_root(spark: SparkSession) -> str:
    """Folder of this application's intermediate tables; other applications have their own."""
    return f"{shared_dir(spark)}/maillake/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for a table that cuts lineage."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(spark: SparkSession, df, name: str):
    """Write ``df`` to the shared folder and read it back: later stages don't
    repeat the work, and a lost executor costs only a read."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; no result of it that is still lazy may be used after it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df):
    """``df``, a plain scan, in as many partitions as ``maillake.input.partitions``
    says: for a small input of few splits with heavy work per row. Unset, as by
    default, the scan's own splits stay and nothing is shuffled, at any size."""
    wanted = df.sparkSession.conf.get(SPREAD_KEY, None)
    return df.repartition(int(wanted)) if wanted else df
