"""Session set-up for local runs, lineage cuts and scratch folders."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Scratch paths handed out, by application.
_handed_out: dict[str, list[str]] = {}
#: Those of the job at work, which go when it ends.
_of_job: ContextVar[list[str] | None] = ContextVar("of_job", default=None)


def local_session(cores: int | str = 8, app: str = "statloom") -> SparkSession:
    """A local session for tests and the bench; on a cluster use the cluster's own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def _is_local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder.

    Only a local master, whose tasks all see the driver's disk, may go without: it gets a folder
    of its own, which goes when the process ends. Anywhere else a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if named is None and current is None:
        if not _is_local(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="statloom-")
        atexit.register(shutil.rmtree, current, ignore_errors=True)
    if current is None:
        spark.sparkContext.setCheckpointDir(named)
    elif named is None:
        spark.sparkContext.setCheckpointDir(current)
    return named or current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    _handed_out.setdefault(spark.sparkContext.applicationId, []).append(path)
    mine = _of_job.get()
    if mine is not None:
        mine.append(path)
    return path


def scratch_paths(spark: SparkSession) -> list[str]:
    """The scratch folders of this application that are still there."""
    return list(_handed_out.get(spark.sparkContext.applicationId, []))


@contextmanager
def scratch_freed(spark: SparkSession) -> Iterator[set[str]]:
    """Delete the scratch folders of the block when it ends, but those put into the set that it yields.

    For jobs whose results are stored, not read from scratch. Blocks may be nested; what an inner one keeps is kept.
    """
    mine, kept = [], set()
    token = _of_job.set(mine)
    try:
        yield kept
    finally:
        _of_job.reset(token)
        for path in mine:
            if path not in kept:
                free_scratch(spark, path)


def delete_path(spark: SparkSession, path: str) -> bool:
    """Delete a folder through Spark's file systems; False where there was none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def free_scratch(spark: SparkSession, path: str) -> None:
    """Delete one scratch folder."""
    delete_path(spark, path)
    known = _handed_out.get(spark.sparkContext.applicationId, [])
    if path in known:
        known.remove(path)


def drop_scratch(spark: SparkSession) -> int:
    """Delete what this application wrote to the shared folder; for when no frame that reads it is needed any more."""
    paths = _handed_out.pop(spark.sparkContext.applicationId, [])
    return sum(delete_path(spark, p) for p in paths)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting for the actions of the block."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def cut_lineage(df: DataFrame, name: str = "step") -> DataFrame:
    """Write the frame once to the shared folder and go on from the written table.

    Survives lost executors, and unlike a checkpointed frame its size is known to the optimizer.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
