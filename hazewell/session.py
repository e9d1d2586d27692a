"""Session settings the library expects; an existing session keeps its own values."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench."""
    os.environ.setdefault("TZ", "UTC")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("hazewell")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A folder for materialised tables under the cluster's ``spark.checkpoint.dir``.

    Where that is unset, only a session whose executors are threads of this process gets a folder of its own: on a
    cluster each machine would write to its own disk, and a later read would miss rows.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="hazewell-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}"


def bounded_broadcast(df: DataFrame, most: int = 100_000) -> DataFrame:
    """The frame worked out once. With ``most`` rows or fewer it is taken to the driver and marked for broadcast; beyond,
    it is written, joins with it shuffle and adaptive execution splits hot keys."""
    few = df.limit(most + 1).toArrow()
    if few.num_rows <= most:
        return F.broadcast(df.sparkSession.createDataFrame(few, df.schema))
    return stored(df, "side")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows read back from a written table: work done once where a plan needs them several times."""
    path = shared_dir(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
