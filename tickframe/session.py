"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dir: str | None = None
#: This process's work files lie in a folder of its own, so that they can be removed together.
_RUN = uuid.uuid4().hex[:12]


def local_session(cores: str = "*", name: str = "tickframe", memory: str = "12g") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    n = os.cpu_count() if cores == "*" else int(cores)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared folder named by ``spark.checkpoint.dir``.

    Only where the session names none and runs in one process on one machine (unit tests) a
    local temporary folder stands in; on a cluster it would be another one on every executor.
    """
    global _local_dir
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        if _local_dir is None:
            _local_dir = tempfile.mkdtemp(prefix="tickframe-")
        base = _local_dir
    return f"{base.rstrip('/')}/tickframe/{_RUN}/{purpose}-{uuid.uuid4().hex[:12]}"


def clean_up(spark: SparkSession) -> None:
    """Removes what this process wrote below the work folder; results that were not read or saved by then are gone."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(work_dir(spark, "x").rsplit("/", 1)[0])
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def stored(df: DataFrame, purpose: str, **options) -> DataFrame:
    """Written to the shared folder and read back: computed once, safe from lost executors. ``options`` are the writer's."""
    path = work_dir(df.sparkSession, purpose)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, purpose: str) -> DataFrame:
    """``stored``, and read by as many tasks as there are cores at least: for rows that take far more work than their bytes tell."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    kept = stored(df, purpose)
    return kept if kept.rdd.getNumPartitions() >= cores else stored(kept.repartition(cores), f"{purpose}-dealt")
