"""Tables of intermediate results in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Tables written by :func:`shared_table` that are still there, with the session that wrote them.
_written: dict[str, SparkSession] = {}
#: Folders of local sessions without a shared one.
_own: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """What the cluster names in ``spark.checkpoint.dir``. Only a session on one machine may go without: it gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        named = _own.get(app) or _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="seabedflow-"))
    return named.rstrip("/")


@contextmanager
def shuffles_end_with_their_query(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside delete their shuffle files when they end; what is read again must be a written table."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def shared_table(t: DataFrame, tag: str) -> DataFrame:
    """Write ``t`` as Parquet in the shared folder and read it back.

    The lineage ends there: a lost executor costs the tasks it ran and nothing before this table, and nothing stays in memory.
    """
    spark = t.sparkSession
    path = f"{shared_dir(spark)}/seabedflow-{uuid.uuid4().hex}-{tag}"
    with shuffles_end_with_their_query(spark):
        t.write.parquet(path)
    out = spark.read.schema(t.schema).parquet(path)
    _written[path] = spark
    out._seabedflow_path = path
    return out


def drop_tables(*tables: DataFrame | None) -> None:
    """Delete tables of :func:`shared_table` that nothing reads any more; other tables are left alone."""
    for t in tables:
        path = getattr(t, "_seabedflow_path", None)
        spark = _written.pop(path, None)
        if spark is not None:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _delete_rest() -> None:
    for path, spark in list(_written.items()):
        try:
            _delete(spark, path)
        except Exception:  # the session has ended
            return
