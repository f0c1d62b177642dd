"""Session settings and shared scratch space."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",                    # day keys are UTC days
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",         # last duplicate wins, as in JSON.parse
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = 8, memory: str = "12g", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName("veilspark")
               .config("spark.driver.memory", memory)
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.python.sql.dataFrameDebugging.enabled", "false")   # no call-site lookup per column
               .config("spark.sql.shuffle.partitions", str(partitions)))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_folders: dict[str, str] = {}      # of sessions on one machine that have no shared folder, by application
_scratch: list[list[str]] = []     # paths handed out inside each open ``scratch`` block


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: the session's ``spark.checkpoint.dir``.

    Where none is configured, a session on one machine gets a folder of its own;
    on a cluster that would lose rows, so it is an error. (The setting itself
    cannot be changed once a session runs.)
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir is not set: {master or 'this cluster'} needs a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _folders:
        _folders[application] = tempfile.mkdtemp(prefix="spark-")
    return _folders[application]


def new_path(spark: SparkSession, name: str) -> str:
    path = os.path.join(shared_dir(spark), "veilspark", f"{name}-{uuid.uuid4().hex}")
    for paths in _scratch:
        paths.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end every table stored inside it. Results must be written or collected before: they still read them."""
    paths: list[str] = []
    _scratch.append(paths)
    try:
        yield
    finally:
        _scratch.remove(paths)
        for path in paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def store(df: DataFrame, name: str = "stage", partition_by: list[str] | None = None) -> DataFrame:
    """Write a stage to a table in the shared folder and read it back.

    Cuts lineage without tying the data to the executors that made it, and
    gives the next stage column pruning and real sizes to plan with.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.partitionBy(*(partition_by or [])).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
