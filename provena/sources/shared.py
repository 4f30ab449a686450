"""Tables in the folder that all executors share: cut lineage there, never on one machine's disk."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}
_written: dict[str, list[str]] = {}
_mine: ContextVar[tuple[list[str], ...] | list[list[str]]] = ContextVar("mine", default=())


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a local folder where that is unset and executors are threads of this process (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("spark.checkpoint.dir is not set: executors of a cluster need a folder that all of them see")
    app = spark.conf.get("spark.app.id")
    if app not in _own_dirs:
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own_dirs[app] = f"file://{folder}"
    return _own_dirs[app]


def written(spark: SparkSession) -> list[str]:
    """Paths in the shared folder that this session has asked for, in order."""
    return list(_written.get(spark.conf.get("spark.app.id"), []))


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete tables (all, if none are given) that this session has written to the shared folder; DataFrames that read them are of no use any more."""
    app = spark.conf.get("spark.app.id")
    gone = set(_written.get(app, []) if paths is None else paths)
    _written[app] = [p for p in _written.get(app, []) if p not in gone]
    for path in gone:
        fs, at = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        if fs.get_file_info(at).type != pafs.FileType.NotFound:
            fs.delete_dir(at)


@contextmanager
def tables_of(spark: SparkSession) -> Iterator[list[str]]:
    """Collects the paths that this thread asks for within, less those that are released again."""
    mine: list[str] = []
    token = _mine.set([*_mine.get(), mine])
    try:
        yield mine
    finally:
        _mine.reset(token)
        still = set(written(spark))
        mine[:] = [p for p in mine if p in still]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for mine in _mine.get():
        mine.append(path)
    _written.setdefault(spark.conf.get("spark.app.id"), []).append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more: whatever was made of them has been written."""
    for df in tables:
        folders = {f.rsplit("/", 2)[-2] for f in df.inputFiles()}
        release(df.sparkSession, [p for p in written(df.sparkSession) if p.rsplit("/", 1)[-1] in folders])
