"""Tables written to the cluster's shared folder, to cut lineage so that a lost executor costs no recomputation.

The folder is the one named by ``spark.checkpoint.dir``.  Only a local session
(one machine) may go without that setting; it then gets a temporary folder.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch while a table is written.  Spark's 10,000 would hold some 35 MB of texts at once in a task, and again in its Python worker.
ARROW_ROWS = 500

_LOCAL: dict[str, str] = {}
_OPEN: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("open", default=())


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="clausemill-")
    return f"file://{_LOCAL[app]}"


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt by key to as many partitions as a shuffle has, for work whose cost is not in its bytes, so that adaptive execution does not join them."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *by)


@contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside takes Arrow batches of at most ARROW_ROWS rows; the session's own setting comes back at the end."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(setting)
    try:
        if not 0 < int(own) <= ARROW_ROWS:  # zero or less: no bound
            spark.conf.set(setting, str(ARROW_ROWS))
        yield
    finally:
        spark.conf.set(setting, own)


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: same rows, no lineage."""
    return settle_all([df], label)


def settle_all(parts: Iterable[DataFrame], label: str) -> DataFrame:
    """Like :func:`settle` for tables of one schema, written one after the other into one; at least one is needed."""
    written = path = None
    for df in parts:
        path = path or f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
        with short_batches(df.sparkSession):
            df.write.mode("append").parquet(path)
        written = written or df
    written = written.sparkSession.read.schema(written.schema).parquet(path)
    written._settled_at = path
    if _OPEN.get():
        _OPEN.get()[-1].append(written)
    return written


def settled(df: DataFrame, label: str) -> DataFrame:
    """``df`` itself if :func:`settle` made it, else what that makes of it."""
    return df if hasattr(df, "_settled_at") else settle(df, label)


def discard(*tables: DataFrame) -> None:
    """Delete the files behind tables made by :func:`settle` once nothing reads them any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._settled_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Delete at the end all tables settled inside, but for those put in the list that this gives; an outer scratch then owns these."""
    made, kept = [], []
    token = _OPEN.set((*_OPEN.get(), made))
    try:
        yield kept
    finally:
        _OPEN.reset(token)
        paths = {df._settled_at for df in kept}
        discard(*(df for df in made if df._settled_at not in paths))
        if _OPEN.get():
            _OPEN.get()[-1].extend(kept)
