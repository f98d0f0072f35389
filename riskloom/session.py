"""Session helpers: time zone, scratch space and lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: dict[str, str] = {}


def local_session(cores: int = 8, app: str = "riskloom", **conf: str) -> SparkSession:
    """A local session for tests and the bench. Clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Event time is UTC everywhere; nothing else about the caller's session is touched."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a local session without one gets a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="riskloom-")
        spark.sparkContext.setCheckpointDir(_LOCAL_SCRATCH[app])
    return _LOCAL_SCRATCH[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise on reliable storage, so later rounds neither re-run nor lose the work."""
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager=True)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame) -> DataFrame:
    """``cut`` for rows that are many or wide: a compressed table in the scratch folder, whose shuffle files go with its write.

    Rows may be dealt otherwise when they are read back. A table cannot hold untyped nulls or a name twice; such rows are cut.
    """
    names = [c.lower() for c in df.columns]
    if "void" in df.schema.simpleString() or len(set(names)) < len(names):
        return cut(df)
    spark = df.sparkSession
    path, before = new_path(spark, "kept"), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


ROWS_A_TASK = 2_000   # documents that one task of a CPU-bound stage reads


def spread(df: DataFrame, rows: int = ROWS_A_TASK) -> DataFrame:
    """Deal the rows of a CPU-bound narrow stage to tasks of bounded work, one for every core at least.

    A split of the scan holds what a disk reads well, far more than a task should compute; so the longest task would grow
    with the files.
    """
    if df.isStreaming:
        return df
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def in_tasks(df: DataFrame, keys: list[str]) -> DataFrame:
    """Deal rows by key for work that costs far more than its bytes tell.

    An exchange with a number of its own is not coalesced by size; one more than the session's, because an equal one
    below it (a join by the same keys) would take its place and be coalesced.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(n + 1, *keys)
