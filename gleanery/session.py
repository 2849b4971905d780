"""Session settings and the shared folder for checkpoints and written tables."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "gleanery", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs expect; anything in ``conf`` wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session, which every executor reaches: the context's own, else ``spark.checkpoint.dir``. Where
    neither is set, a single-process session (as in tests) uses a temporary folder; any other master is refused."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None:
            if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
            configured = tempfile.mkdtemp(prefix="gleanery-")
        sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so that later reads all see the same rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage like :func:`settle`, for rows that are many: written as compressed columns, a fraction of a checkpoint's size. Columns
    that files of columns do not hold are settled."""
    if any("void" in kind or kind == "interval" for _, kind in df.dtypes) or len({c.lower() for c in df.columns}) < len(df.columns):
        return settle(df)
    path = scratch_path(df.sparkSession, "rows")
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession):
    """What is written inside leaves no shuffle files behind; they would otherwise stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use all cores on inputs with too few splits (one small file). A large table has enough and is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df
