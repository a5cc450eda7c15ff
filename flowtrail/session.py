"""Session defaults and the shared folder that intermediate tables go to."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Set where a session is built here; a session that is handed in keeps its own.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


# Files that a task keeps open while it writes a table partitioned by a column of few values, and the size of their row groups.
PARTITION_WRITERS, PARTITION_BLOCK = 16, 32 << 20
# What a write shuffled is deleted at its end, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Of staged tables, which are on the disk together with what the next step shuffles.
CODEC = "zstd"


def build_session(app: str = "flowtrail", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary folder only in local mode."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    current = sc.getCheckpointDir()
    if configured:
        if current is None:
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if current:
        return current.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    path = tempfile.mkdtemp(prefix="flowtrail-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    root = shared_dir(spark)
    return f"{root}/flowtrail/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Settings of a session that hold for a while."""
    before = {key: spark.conf.get(key, None) for key in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def stage(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write a table once to the shared folder and read it back.

    Cuts lineage like a checkpoint, but the copy is columnar: later readers prune
    columns, push filters and give the planner real sizes. It outlives any executor, and
    nothing that was shuffled for it stays on the disk.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer, conf = df.write.mode("overwrite").option("compression", CODEC), {CLEANUP: "true"}
    if partition_by:
        # A task would sort all its rows by the few values of these columns, in memory that grows with its
        # share of the input; with a file open for each value it need not. The row groups of these files are smaller.
        key = "spark.sql.maxConcurrentOutputFileWriters"
        conf[key] = str(max(int(spark.conf.get(key)), PARTITION_WRITERS))
        writer = writer.partitionBy(*partition_by).option("parquet.block.size", PARTITION_BLOCK)
    with settings(spark, conf):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(table: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    spark = table.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
