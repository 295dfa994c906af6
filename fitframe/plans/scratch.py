"""Intermediate tables in the cluster's shared checkpoint folder.

A stored table cuts the lineage: a lost executor costs a re-read and never a replay
of earlier steps. The tables of one run are managed tables of a database of its own,
located in the folder that ``spark.checkpoint.dir`` names, so dropping them deletes
their files. The shuffle files that led to a table go as soon as it is written.

A bucketed table keeps rows of equal keys in the same bucket. Tables with the same
number of buckets over the same keys join and aggregate by them without a shuffle.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
WAREHOUSE_SETTING = "spark.sql.warehouse.dir"
# Shuffle files go when the query that wrote them ends, not when the driver collects its garbage.
CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_open_scopes: ContextVar[tuple[list["Scratch"], ...]] = ContextVar("open_scopes", default=())


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Without the setting, a local session uses its warehouse folder.
    """
    context = spark.sparkContext
    folder = (
        spark.conf.get(CHECKPOINT_SETTING, None)
        or context.getConf().get(CHECKPOINT_SETTING)
        or context.getCheckpointDir()
    )
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder that all executors share")
    return spark.conf.get(WAREHOUSE_SETTING)


class Scratch:
    """Tables of one run, in a folder and a database of their own."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.name = f"fitframe_{uuid.uuid4().hex}"
        self.root = f"{shared_folder(spark)}/{self.name}"
        self._count = 0
        for scope in _open_scopes.get()[-1:]:
            scope.append(self)

    def store(self, df: DataFrame, name: str) -> "StoredTable":
        return self._save(df.write, name)

    def store_bucketed(
        self, df: DataFrame, name: str, keys: list[str], buckets: int, aligned: bool = False
    ) -> "StoredTable":
        """Bucketed and sorted by the keys, one file per bucket: the one shuffle that later joins save.

        ``aligned`` says that ``df`` comes from tables that are bucketed so already.
        """
        dealt = df if aligned else df.repartition(buckets, *keys)
        return self._save(dealt.write.bucketBy(buckets, *keys).sortBy(*keys), name)

    def _save(self, writer, name: str) -> "StoredTable":
        if self._count == 0:
            self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.name} LOCATION '{self.root}'")
        self._count += 1
        table = f"{self.name}.t{self._count:05d}_{name.replace('-', '_')}"
        before = self.spark.conf.get(CLEANUP_SETTING, "false")
        self.spark.conf.set(CLEANUP_SETTING, "true")
        try:
            writer.format("parquet").saveAsTable(table)
        finally:
            self.spark.conf.set(CLEANUP_SETTING, before)
        return StoredTable(self.spark.table(table), table, f"{self.root}/{table.partition('.')[2]}")

    def discard(self, table: "StoredTable") -> None:
        """Delete a table of this run that nothing reads any more."""
        if not table.name.startswith(f"{self.name}."):
            raise ValueError(f"{table.name} is not a table of this run")
        self.spark.sql(f"DROP TABLE IF EXISTS {table.name}")

    def discard_all(self) -> None:
        """Delete all tables of this run."""
        if self._count:
            self.spark.sql(f"DROP DATABASE IF EXISTS {self.name} CASCADE")
            self._count = 0


class StoredTable:
    def __init__(self, df: DataFrame, name: str, path: str):
        self.df = df
        self.name = name
        self.path = path


@contextmanager
def collected_tables() -> Iterator[list[Scratch]]:
    """A list that gets every ``Scratch`` made inside, for a caller that deletes them later."""
    made: list[Scratch] = []
    token = _open_scopes.set((*_open_scopes.get(), made))
    try:
        yield made
    finally:
        _open_scopes.reset(token)


@contextmanager
def temporary_tables() -> Iterator[None]:
    """Delete at the end the tables of every ``Scratch`` that was made inside.

    For callers that have written the result they want: what an operator returns
    may read its stored tables.
    """
    made: list[Scratch] = []
    try:
        with collected_tables() as made:
            yield
    finally:
        for scratch in made:
            scratch.discard_all()
