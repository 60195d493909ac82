"""Intermediate tables that several steps read, and sides that are counted before they are broadcast."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from tempfile import mkdtemp
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few numbers or short texts that a broadcast may hold (about 64 MB).
BROADCAST_ROWS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Only a session on one machine may leave it
    unset: then a temporary one is made and set. On a cluster such a folder would be another one on each machine, so
    that fails."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and all executors share (master {master})")
        folder = "file://" + mkdtemp(prefix="folioloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """The tables written while a scratch() is open."""

    def __init__(self) -> None:
        self.paths: list[str] = []
        self.kept: set[str] = set()

    def keep(self, *tables: DataFrame) -> None:
        """These tables (from materialized()) outlive the scope: its result reads them."""
        self.kept.update(_PATHS[table] for table in tables)


#: Where each materialized table lies.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_open: ContextVar[tuple[Scratch, ...]] = ContextVar("scratch", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Tables that are materialized inside are deleted at the end, but for those kept, which pass to the scope around it."""
    own, around = Scratch(), _open.get()
    token = _open.set((*around, own))
    try:
        yield own
    except BaseException:
        own.kept.clear()
        raise
    finally:
        _open.reset(token)
        delete(spark, *(p for p in own.paths if p not in own.kept))
        if around:
            around[-1].paths += [p for p in own.paths if p in own.kept]


def delete(spark: SparkSession, *paths: str) -> None:
    """Removes these folders, on whatever file system they are."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def materialized(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder, read again: what several steps read is computed once, and survives the loss of
    executors. Inside a scratch() the table is deleted at its end unless kept."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if scopes := _open.get():
        scopes[-1].paths.append(path)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    _PATHS[found] = path
    return found


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if a count proves that it has at most that many rows, else unmarked, for a shuffled join.
    df should be cheap to count: a materialized table."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
