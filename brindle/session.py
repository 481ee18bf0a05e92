"""Session and table helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table `name` below `root`."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder shared by all executors. A temporary one is used only where the session names none (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="brindle-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


_kept: dict[str, SparkSession] = {}  # folders of the tables written here


def checkpoint(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """Cut the lineage through a table in the shared folder; survives the loss of any executor.

    `instead_of` is an earlier such table that nothing else reads: it is deleted once the new one is complete, so that a loop
    keeps one round. All others are deleted when the driver ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _kept[path] = spark
    if instead_of is not None:
        _delete(getattr(instead_of, "_checkpoint", None))
    out = spark.read.schema(df.schema).parquet(path)
    out._checkpoint = path
    return out


def checkpoint_by(df: DataFrame, key: str) -> DataFrame:
    """As `checkpoint`, bucketed by `key` into as many buckets as shuffles have partitions: later joins on it don't shuffle the table.

    `df` best comes from `by_key`, so that a task writes one bucket.
    """
    spark = df.sparkSession
    name = f"by_{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark)}/table-{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    _kept[path] = spark
    try:
        df.write.format("parquet").option("path", path).bucketBy(buckets, key).saveAsTable(name)
    except Exception:  # a session without a usable catalog: joins shuffle the table then; a failed job fails again here
        return checkpoint(df)
    out = spark.table(name)
    out._checkpoint = path
    return out


def by_key(df: DataFrame, key: str) -> DataFrame:
    """`df` shuffled by `key` into as many partitions as shuffles have; a join on it goes on from there."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _delete(path: str | None) -> None:
    spark = _kept.pop(path, None)
    if spark is not None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _delete_all() -> None:
    for path in list(_kept):
        try:
            _delete(path)
        except Exception:  # the JVM is gone; the folder is the cluster's to clean
            return


def widened(df: DataFrame) -> DataFrame:
    """`df` over all cores where its files give fewer partitions than that; a large input is left as it is scanned."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """`df` marked for broadcast where it has no more than `rows` rows; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def default_session(cpus: str = "*", **conf) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("brindle")
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.warehouse.dir": os.path.join(tempfile.gettempdir(), "brindle-warehouse"),
        "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "12g"),
    } | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
