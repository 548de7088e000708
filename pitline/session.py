"""Session helpers: reading tables, and staging a result that several later steps read."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", name: str = "pitline") -> SparkSession:
    """A local session for tests and the benchmark; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def configure(spark: SparkSession) -> None:
    """Session settings the wide tables need.

    Constraint inference rewrites every known predicate for every alias; on tables with well over a hundred derived
    columns its set of predicates grows exponentially and planning takes longer than the query.
    """
    spark.conf.set("spark.sql.constraintPropagation.enabled", "false")


#: Rows of an Arrow batch where rows hold whole texts.
TEXTS_PER_BATCH = 1_000


def batch_texts(spark: SparkSession) -> None:
    """Batches of whole texts: ten thousand of them, Spark's default, fill buffers in the JVM and in Python for every core."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXTS_PER_BATCH)


def tasks_for(spark: SparkSession, rows: int, rows_per_task: int) -> int:
    """How many tasks share ``rows``, so that a task's share, and the memory of its sorts, stays the same as tables grow.

    Left alone, small shuffle partitions are joined up to a size in compressed bytes, which says little about wide rows that
    several windows sort; a number given to ``repartition`` is kept.
    """
    return max(spark.sparkContext.defaultParallelism, -(-rows // rows_per_task))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Only a local session without that setting (tests, the benchmark) gets one of its own; anywhere else a missing setting
    is an error, because a machine-local folder would lose files that other executors need.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


_SCRATCH: list[list[str]] = []


def delete_folder(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch(spark: SparkSession):
    """Tables staged inside go at the end, but for those staged with ``keep``; results must be staged by then."""
    own: list[str] = []
    _SCRATCH.append(own)
    try:
        yield
    finally:
        _SCRATCH.remove(own)
        for path in own:
            delete_folder(spark, path)


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Shuffle files of what is written inside go with the end of each write, not when the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stage(df: DataFrame, *partition_by: str, keep: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and read it from there afterwards.

    Used where several passes need the same costly table: the lineage ends at the files, a lost executor costs nothing,
    and every later reader scans only the columns and rows it asks for.
    """
    path = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    if _SCRATCH and not keep:
        _SCRATCH[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
