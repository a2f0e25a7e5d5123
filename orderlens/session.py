"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Splits an oversized shuffle partition of a join, so a key that holds a large
    # share of the rows does not end in one task.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Also where the split costs a further shuffle, as before a grouping on the join key.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A query's shuffle files go when it ends, and not when the driver next collects its garbage.
    # Should anything still ask for them, Spark runs the stage again.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app_name: str = "orderlens", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the defaults above; ``conf`` keys use ``__`` in place of ``.``."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_skew_handling(spark: SparkSession) -> None:
    """Turn on skew splitting in a session made elsewhere."""
    for key, value in SESSION_DEFAULTS.items():
        if key.startswith("spark.sql.adaptive."):
            spark.conf.set(key, value)
    free_shuffles(spark)


def free_shuffles(spark: SparkSession) -> None:
    """Let shuffle files go as soon as their query ends, in a session made elsewhere."""
    spark.conf.set(FREE_SHUFFLES, SESSION_DEFAULTS[FREE_SHUFFLES])


# Temporary folder per application, for sessions without a configured one.
_OWN_FOLDERS: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Folder for written intermediate tables and checkpoints.

    A cluster names a shared folder in ``spark.checkpoint.dir``, or has set a checkpoint folder on
    the context. Only without either, and only on a single machine, is a temporary folder used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _OWN_FOLDERS:
        _OWN_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="orderlens-")
    return _OWN_FOLDERS[context.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the scratch folder; never reused, so nothing is overwritten."""
    return f"{scratch_root(spark)}/orderlens/{name}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Let iterative ML training cut its lineage in the shared folder."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(scratch_root(spark))
