"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_scopes: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`. Where it is unset, a new temporary folder that the process keeps, but only
    if the master is local: on a cluster no other machine would see it, so it has to be set."""
    if said := spark.conf.get("spark.checkpoint.dir", None):
        return said
    master = spark.sparkContext.master
    if master.split("[")[0] != "local":
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that driver and executors share (the master is {master})")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="spark-lakeloom-"))
    return _own[0]


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """The same rows, written to the shared folder and read again: later stages neither recompute
    them nor depend on the executors that made them."""
    path = new_path(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lakeloom_path = path
    if _scopes:
        _scopes[-1].append(out)
    return out


@contextmanager
def scope() -> Iterator[None]:
    """Removes the tables that `cut` writes inside, when it ends, but for those that `keep` names. What is to last must be
    written before: a DataFrame that is made inside and still to be computed reads tables that are gone then.

        with scope():
            keep(result := cut(some_operator(df)))
    """
    made: list[DataFrame] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.remove(made)
        discard(*made)


def keep(df: DataFrame) -> DataFrame:
    """A table that `cut` wrote stays when the innermost scope ends; it then belongs to the scope around that, if there is one."""
    if _scopes and any(df is x for x in _scopes[-1]):
        _scopes[-1][:] = [x for x in _scopes[-1] if x is not df]
        if len(_scopes) > 1:
            _scopes[-2].append(df)
    return df


def discard(*tables: DataFrame) -> None:
    """Removes tables that `cut` wrote. Nothing that is still to be computed may read them."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._lakeloom_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
