"""Tables written to the shared folder: durable cuts in a long lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
#: Folders of the scopes that are open, and the catalog's tables that lie in the shared folder.
_scopes: list[str] = []
_tables: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by the cluster.

    Only a local session without the setting gets a temporary folder of its own.
    """
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{_SETTING} must name a folder that every executor can reach")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="scorewright-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def app_dir(spark: SparkSession) -> str:
    """This application's own part of the shared folder."""
    return f"{shared_dir(spark)}/scorewright/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{'/'.join([app_dir(spark), *_scopes])}/{label}-{uuid.uuid4().hex}"


def new_table(spark: SparkSession, label: str) -> tuple[str, str]:
    """A table name and a place in the shared folder that no other table has."""
    place = new_path(spark, label)
    name = f"{label}_{place.rsplit('-', 1)[1]}"
    _tables[name] = place
    return name, place


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a frame that several passes need to the shared folder, and read it back.

    The written rows survive lost executors, and a value that depends on the
    placement of rows (such as a partition number) is fixed by the write.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, folder: str) -> None:
    for name in [n for n, place in _tables.items() if place.startswith(f"{folder}/")]:
        spark.sql(f"DROP TABLE IF EXISTS `{name}`")
        del _tables[name]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def remove_intermediates(spark: SparkSession) -> None:
    """Delete this application's part of the shared folder, once its results are consumed."""
    _remove(spark, app_dir(spark))


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables of the jobs inside are removed at the end, also after a failure.

    Lazy results read them, so a result is to be written or collected inside the scope.
    Scopes may be nested; jobs of other threads do not share the scope's end with safety.
    """
    _scopes.append(f"scope-{uuid.uuid4().hex}")
    folder = "/".join([app_dir(spark), *_scopes])
    try:
        yield
    finally:
        _scopes.pop()
        _remove(spark, folder)
