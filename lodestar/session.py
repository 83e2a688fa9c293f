"""Session defaults and the shared folder for checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lodestar", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a temporary one in tests."""
    sc = spark.sparkContext
    own = spark.conf.get("spark.checkpoint.dir", None)
    if own is None:
        own = sc._jsc.sc().getCheckpointDir()
        own = own.get() if own.isDefined() else None
    if own is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = "file://" + tempfile.mkdtemp(prefix="lodestar-checkpoint-", dir=os.environ.get("TMPDIR"))
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder once and goes on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def by_key(df: DataFrame, key: str, order: str) -> Iterator[DataFrame]:
    """``df`` as files in the shared folder, dealt out by a key: what groups, joins or windows by the key needs no shuffle.

    The files and the table's name go at the end.
    """
    spark = df.sparkSession
    name = f"lodestar_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.format("parquet").option("path", path).bucketBy(n, key).sortBy(key, order).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
