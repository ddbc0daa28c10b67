"""Cutting lineage in a folder that every executor shares.

Intermediate results are written as Parquet tables rather than checkpointed:
both survive the loss of an executor, but a table has true statistics, while a
checkpoint keeps the size estimated for its plan. In iterations such estimates
multiply from round to round until planning itself takes minutes.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir`` where the cluster names one. Only a
    local master, whose executors are this process, may go without: it gets a
    temporary folder, which is remembered in that setting's place."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not is_local(sc.master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {sc.master} share")
        named = tempfile.mkdtemp(prefix="plumbline-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def is_local(master: str) -> bool:
    """Whether driver and executors are one process."""
    return master == "local" or master.startswith("local[")


_kept: set[tuple[str, SparkSession]] = set()


@atexit.register
def drop_kept() -> None:
    """Drop the tables of :func:`cut`; runs at the end of the application, and
    may be called once their results have been written."""
    _drop_all(_kept)


def _drop_all(tables: set[tuple[str, SparkSession]]) -> None:
    for folder, spark in list(tables):
        _kept.discard((folder, spark))
        try:
            _drop(folder, spark)
        except Exception:  # noqa: S110, BLE001 - the session is gone
            pass


def _drop(folder: str, spark: SparkSession) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables of one computation, dropped together when it is done."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/plumbline-{uuid.uuid4().hex}"
        self.n = 0

    def cut(self, df: DataFrame) -> DataFrame:
        """Compute ``df`` once and go on from the written table."""
        self.n += 1
        path = f"{self.folder}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def cut_counting(self, df: DataFrame, rows: Column | None = None) -> tuple[DataFrame, int]:
        """The same, with the number of rows (those that meet a condition),
        which the writing tasks count: no job of its own."""
        seen = Observation()
        count = F.count(F.lit(1)) if rows is None else F.count_if(rows)
        table = self.cut(df.observe(seen, count.alias("n")))
        n = seen.get.get("n")  # missing where the plan was found to be empty
        return table, table.select(count).first()[0] if n is None else n

    def drop(self) -> None:
        _drop(self.folder, self.spark)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop()


def _lasting(spark: SparkSession) -> Scratch:
    kept = Scratch(spark)
    _kept.add((kept.folder, spark))
    return kept


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and go on from a table that lives as long as the
    application or the :func:`scope` around the call."""
    return _lasting(df.sparkSession).cut(df)


def cut_counting(df: DataFrame, rows: Column | None = None) -> tuple[DataFrame, int]:
    """:func:`cut` with the number of rows."""
    return _lasting(df.sparkSession).cut_counting(df, rows)


@contextmanager
def scope() -> Iterator[None]:
    """Tables of :func:`cut` made inside are dropped at its end, when what was
    read from them must have been written."""
    before = set(_kept)
    try:
        yield
    finally:
        _drop_all(_kept - before)
