"""Spark session defaults and the shared scratch location.

Scratch data (exports, replayed batches, streaming checkpoints) goes under
the directory the cluster names in ``spark.checkpoint.dir``.  Only when that
setting is absent (local runs and tests) do we create one.
"""

from __future__ import annotations

import tempfile
import uuid
from math import ceil

from pyspark.sql import SparkSession

SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Parquet footers answer count/max on the compacted table.
    "spark.sql.parquet.aggregatePushdown": "true",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app: str = "logloom", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(SESSION_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: wide rows of a task: few enough for its sorts to stay in memory
TASK_ROWS = 100_000


def partitions_for(spark: SparkSession, rows: int) -> int:
    """Partitions for an exchange of about ``rows`` wide rows: the session's
    number, or more, so that the sorts after it do not grow with the table.
    For rows that a count from footers or a caller tells."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(rows / TASK_ROWS))


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder; created locally only when unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # a remote (Connect) session has no SparkContext
        sc = None
    if not root and sc is not None:
        root = sc.getCheckpointDir()
    if not root:
        master = sc.master if sc is not None else spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="logloom-ckpt-")
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


_made: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused path under the checkpoint folder."""
    root = checkpoint_root(spark)
    _made.append(f"{root}/logloom/{name}-{uuid.uuid4().hex[:12]}")
    return _made[-1]


def drop_scratch(spark: SparkSession) -> int:
    """Delete the scratch tables that this process has made so far; to be
    called once the results that read them are written.  Returns how many."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    gone = 0
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


def _hadoop_path(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, there = _hadoop_path(spark, path)
    return fs.exists(there)


def drop_path(spark: SparkSession, path: str) -> bool:
    """Delete a folder that the library has written itself."""
    fs, there = _hadoop_path(spark, path)
    return bool(fs.delete(there, True))


def materialize(df, eager: bool = True):
    """Cut lineage with a reliable checkpoint in the shared checkpoint folder.

    Used where one derived table feeds several branches of a plan (the ranked
    streams of the batch engine): the branches then read the written table
    instead of recomputing it.  Its partitioning is not known to later plans,
    so joins on it shuffle what they read; keep such tables narrow.  Survives
    executor loss (unlike a local checkpoint).
    """
    from pyspark import StorageLevel

    checkpoint_root(df.sparkSession)
    # without a persisted copy the checkpoint job would compute the plan a
    # second time; the cache only lives until the checkpoint files exist
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return df.checkpoint(eager=eager)
    finally:
        if eager:
            df.unpersist()


def stored(df, name: str):
    """Cut lineage like :func:`materialize`, for wide tables: written once as
    compressed Parquet under the scratch folder and read back.  A checkpoint
    keeps rows uncompressed, and a second time on the executors until it is
    written."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
