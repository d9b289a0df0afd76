"""Session construction and shared-storage helpers."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # post-shuffle partitions sized for executor memory; AQE merges small ones
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, app: str = "lexiframe",
                shuffle_partitions: int | None = None, conf: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE on, UTC time zone and no web UI."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = dict(DEFAULT_CONF)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only when it is unset on a local master (tests, one machine) a private
    folder is created and set; on a cluster an unset folder is an error, since
    a machine-local path would not be shared by the executors.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master or ""
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder on shared storage "
                               "(intermediate tables are written there)")
        d = tempfile.mkdtemp(prefix="lexiframe-ckpt-")
        spark.sparkContext.setCheckpointDir(d)
        d = spark.sparkContext.getCheckpointDir() or d
    return d


_scratch: list[str] = []  # folders handed out and not dropped yet


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the checkpoint folder (never machine-local on a cluster)."""
    base = checkpoint_dir(spark)
    sep = "" if base.endswith("/") else "/"
    _scratch.append(f"{base}{sep}{name}-{uuid.uuid4().hex[:12]}")
    return _scratch[-1]


def drop_scratch(spark: SparkSession) -> None:
    """Delete the intermediate tables of this process. Results read them lazily, so the
    caller does this once it has consumed what it asked for."""
    while _scratch:
        path = spark._jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(table_path(sf_dir, name))


def spread(df, key, *more: str):
    """Hash-partition ``df`` by its row key only when its scan yields fewer
    partitions than the cluster runs tasks at once (a single large file or
    row group); meant for plain scans, whose partitions are known without work. Large inputs keep their scan partitioning: no extra shuffle.
    Hash partitioning (not round-robin) keeps retries deterministic. Pass the
    whole unique row key (e.g. conversation and turn): hashing by a column
    that one value dominates would put that value's rows in one task."""
    target = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(target, key, *more) if df.rdd.getNumPartitions() < target else df


def materialize(df, name: str):
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back: the lineage is cut, later consumers scan columnar files instead of
    recomputing the plan, and lost executors do not lose the data. Written once and
    read a few times, the files are packed with zstd: fewer bytes than the default."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)
