"""SparkSession construction and the few session-level settings every job relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings that change results or plans; applied to every session we build.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "evlens", extra: dict | None = None) -> SparkSession:
    """Create (or fetch) a session with the library defaults.

    On a cluster ``master`` stays None (spark-submit decides) and the shuffle
    partition count is left to the cluster config / AQE coalescing.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in SESSION_DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting points at shared storage and is only read. When it
    is unset a local session (tests) gets a scratch folder; a cluster session must set it.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="evlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


# Frames persisted by operators inside an open ``persist_scope`` are released when it closes.
_SCOPES: list[list] = []


def keep(df, level=None):
    """Persist a frame that an operator reads more than once (memory, then disk).

    A lost executor recomputes the blocks from lineage. Inside ``persist_scope``
    the frame is unpersisted when the scope closes.
    """
    from pyspark import StorageLevel
    df = df.persist(level or StorageLevel.MEMORY_AND_DISK)
    if _SCOPES:
        _SCOPES[-1].append(df)
    return df


def stored(df, name: str):
    """Write a (narrow) frame to the shared folder and read it back: its lineage and the text of
    its plan end there, and a lost executor costs a re-read. Inside ``persist_scope`` the
    folder goes when the scope closes."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/evlens-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_folder(spark, path: str) -> bool:
    """Delete a folder through its own file system (shared storage included)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True))


def folder_exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


@contextmanager
def persist_scope():
    """Release every frame ``keep`` persisted and every folder ``stored`` wrote while the scope
    was open (e.g. one micro-batch)."""
    held: list = []
    _SCOPES.append(held)
    try:
        yield held
    finally:
        _SCOPES.pop()
        for x in held:
            if isinstance(x, str):
                remove_folder(SparkSession.getActiveSession(), x)
            else:
                x.unpersist()
