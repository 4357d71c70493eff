"""Session helpers: a local session for tests, the shared scratch folder and tables written to it."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "viewpoint") -> SparkSession:
    """Local session used by tests and the benchmark (no UI, AQE on)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("VIEWPOINT_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_DIRS: dict[str, str] = {}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir`` of the session, else the folder that the
    application has set with ``setCheckpointDir``; neither is changed. Only a
    local session without either gets a scratch folder of its own, one per
    application: on a cluster that would be another disk on every machine, so
    there it is an error.
    """
    sc = spark.sparkContext
    set_ = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if set_:
        return set_
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[sc.applicationId] = tempfile.mkdtemp(prefix="viewpoint-ckpt-")
    return _LOCAL_DIRS[sc.applicationId]


def _tables_dir(spark: SparkSession) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), "tables", spark.sparkContext.applicationId)


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet; :func:`drop_tables` deletes what lies there."""
    return os.path.join(_tables_dir(spark), f"{name}-{uuid.uuid4().hex}")


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of what is written inside as soon as it is written,
    not when the driver's garbage collector comes by: nothing reads them after that."""
    old = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if old is None else spark.conf.set(SHUFFLE_CLEANUP, old)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut lineage by writing ``df`` as Parquet into the shared folder and
    reading it back (a lost executor then re-reads files instead of recomputing
    the plan, and the planner knows the table's bytes). The write's own shuffle files
    are deleted. The tables of an application lie in one folder, see :func:`drop_tables`."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    with _shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.parquet(path)


_KEPT: dict[tuple[str, ...], str] = {}


def materialize_once(spark: SparkSession, name: str, source: str, build: Callable[[], DataFrame]) -> DataFrame:
    """``build()``, written once per application for each ``name`` and ``source`` and read
    again on later calls, until :func:`drop_tables`. For small tables that a deployment loads
    once, such as a lexicon; what lies at ``source`` must not change meanwhile."""
    key = (_tables_dir(spark), name, source)
    if key not in _KEPT:
        path = shared_path(spark, name)
        table = build()
        with _shuffles_dropped(spark):
            table.write.parquet(path)
        _KEPT[key] = path
    return spark.read.parquet(_KEPT[key])


def drop_tables(spark: SparkSession) -> bool:
    """Delete the tables that this application has materialized so far. Results
    that still read them cannot be computed afterwards."""
    for key in [k for k in _KEPT if k[0] == _tables_dir(spark)]:
        del _KEPT[key]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_tables_dir(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
