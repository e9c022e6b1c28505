"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Lets a second grouping or join on (user, x) reuse a partitioning on user.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


_local_roots: dict[str, str] = {}


def get_session(app: str = "loanframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir"
    )
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        if context.applicationId not in _local_roots:
            _local_roots[context.applicationId] = tempfile.mkdtemp(prefix="loanframe-")
        root = _local_roots[context.applicationId]
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; nothing is written yet."""
    return os.path.join(checkpoint_root(spark), f"{name}-{uuid.uuid4().hex}")


def few_listing_tasks(spark: SparkSession, tasks: int = 64) -> None:
    """Tables of many folders are listed by so many tasks, each of which tells the driver of its own cost as well.

    Spark's default is a task for each of up to 10,000 folders.
    """
    spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(tasks))


def evenly(df: DataFrame, tasks_a_core: int = 4) -> DataFrame:
    """The rows dealt evenly to tasks, ahead of steps that cost more than the bytes of the rows tell.

    Spark reads a small file in one task and puts small partitions together; such steps would then have one core.
    """
    return df.repartition(tasks_a_core * df.sparkSession.sparkContext.defaultParallelism)


def memory_bytes(setting: str) -> int:
    """``4g``, ``512m``, ``134217728b`` or a plain number as bytes."""
    number, unit = re.fullmatch(r"(\d+)\s*([kmgt]?)i?b?", setting.strip().lower()).groups()
    return int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]


def task_memory_mb(spark: SparkSession, share: float = 0.25) -> int:
    """A share of the heap, divided by the tasks that run in it at once."""
    conf = spark.sparkContext.getConf()
    local = spark.sparkContext.master.startswith("local")
    heap = conf.get("spark.driver.memory" if local else "spark.executor.memory", "1g")
    tasks = spark.sparkContext.defaultParallelism if local else int(
        conf.get("spark.executor.cores", "1")
    )
    return max(16, int(memory_bytes(heap) * share) // (tasks << 20))
