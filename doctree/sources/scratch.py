"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Rows a file that a table of known size is written with, at least.
ROWS_A_FILE = 1 << 18
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: The folder of each local application that names none.
_temporary: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a local master, as in tests, may do without: it gets a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _temporary:
            _temporary[app] = "file://" + tempfile.mkdtemp(prefix="doctree-")
        path = _temporary[app]
    return path.rstrip("/")


def _write(df: DataFrame, path: str, rows: int | None) -> DataFrame:
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_A_FILE)))
    # Nothing reads the shuffles of a written table again, so their files need not wait for a collection of garbage.
    was = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


_scopes: ContextVar[tuple[Tables, ...]] = ContextVar("scopes", default=())


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: its lineage ends there and lost executors cost nothing.

    rows, if known, is about how many rows it has; small tables then get few files, however many partitions a shuffle has.
    Inside a `scope` the table is deleted at its end.
    """
    if scopes := _scopes.get():
        return scopes[-1].cut(df, rows)
    return keep(df, rows)


def keep(df: DataFrame, rows: int | None = None) -> DataFrame:
    """As `cut`, for results: the table stays when a `scope` ends."""
    return _write(df, f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}", rows)


@contextmanager
def scope(spark: SparkSession):
    """Deletes at its end, also after an error, all that `cut` writes inside it; what is to outlive it goes through `keep`."""
    with Tables(spark) as tables:
        token = _scopes.set((*_scopes.get(), tables))
        try:
            yield tables
        finally:
            _scopes.reset(token)


class Tables:
    """Intermediate tables as `cut` makes them, each deleted by `drop`, and what is left of them at the end of a `with`."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._kept: list[tuple[DataFrame, str]] = []

    def cut(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{uuid.uuid4().hex}"
        table = _write(df, path, rows)
        self._kept.append((table, path))
        return table

    def drop(self, *tables: DataFrame) -> None:
        for table, path in list(self._kept):
            if any(table is t for t in tables):
                self._kept.remove((table, path))
                delete(self.spark, path)

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *error) -> None:
        self.drop(*[t for t, _ in self._kept])
