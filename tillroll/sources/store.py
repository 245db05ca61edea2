"""Parquet tables, small reports, parameters and the shared work folder."""

from __future__ import annotations

import atexit
import copy
import json
import os
import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tillroll.sources.raw import path_exists, require_inputs


def read_table(spark: SparkSession, path: str, cols: Sequence[str] | None = None) -> DataFrame:
    """A written table, or the newest version of a published one."""
    versions = Versions(spark, path)
    df = spark.read.parquet(versions.current() if versions.exist() else path)
    return df.select(*cols) if cols else df


def sorted_ranges(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows in ranges of the keys, each sorted."""
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def write_table(
    df: DataFrame,
    path: str,
    order_by: Sequence[str] | None = None,
    partition_by: Sequence[str] = (),
    counts: Sequence[Column] = (),
    hidden: Sequence[str] = (),
    lookup: dict[str, int] | None = None,
    row_group_bytes: int | None = None,
) -> dict[str, int]:
    """Write Parquet with ZSTD.

    `counts` are aggregates over the rows as they are written, returned by name: the tasks that write
    the files take them, so they cost no scan of their own. `hidden` columns are only counted.

    `lookup` names columns that single values are looked up by, with how many different values a row
    group may have: each row group gets a bloom filter, so that others are not read.

    `order_by` range-partitions and sorts, so the file order says nothing about any other column.
    A range over (user, item) also cuts one very large user into several files.
    """
    if order_by:
        df = sorted_ranges(df, [*partition_by, *order_by])
    observed = Observation() if counts else None
    if observed:
        df = df.observe(observed, *counts)
    df = df.drop(*hidden)
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    for column, distinct in (lookup or {}).items():
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", True).option(
            f"parquet.bloom.filter.expected.ndv#{column}", distinct
        )
    if row_group_bytes:
        writer = writer.option("parquet.block.size", row_group_bytes)
    writer.parquet(path)
    return observed.get if observed else {}


class Versions:
    """The versions of a published table and which of them readers get.

    Each version is a folder of its own beside the others, and `_versions` has one small file per
    publication, numbered upwards, with the name of its folder. Readers take the highest number whose
    file is whole and whose folder is there. Nothing is renamed or written over, so the table is never
    absent, on stores without a rename as well; a file is created only if its number is free, so of two
    writers at once both are published, one after the other.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.pointers = self._at(f"{self.path}/_versions")
        self.fs = self.pointers.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def exist(self) -> bool:
        return self.fs.exists(self.pointers)

    def _numbers(self) -> list[int]:
        if not self.exist():
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(self.pointers)]
        return sorted((int(n) for n in names if n.isdigit()), reverse=True)

    def _pointer(self, number: int):
        return self._at(f"{self.path}/_versions/{number:012d}")

    def _named(self, number: int) -> str | None:
        """The folder that a pointer names; nothing if its writer was lost before the end of the line."""
        try:
            stream = self.fs.open(self._pointer(number))
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
        except Py4JJavaError:  # another writer removed an old pointer
            return None
        name = text[:-1]
        return name if text.endswith("\n") and self.fs.exists(self._at(f"{self.path}/{name}")) else None

    def current(self) -> str:
        """The folder of the newest version."""
        for number in self._numbers():
            if name := self._named(number):
                return f"{self.path}/{name}"
        raise FileNotFoundError(f"nothing is published at {self.path}")

    def point_to(self, name: str) -> None:
        number = next(iter(self._numbers()), 0)
        while True:
            number += 1
            try:
                stream = self.fs.create(self._pointer(number), False)
                break
            except Py4JJavaError:
                if not self.fs.exists(self._pointer(number)):
                    raise
        stream.write(bytearray(f"{name}\n".encode()))
        stream.close()

    def remove(self, name: str) -> None:
        self.fs.delete(self._at(f"{self.path}/{name}"), True)

    def prune(self, keep: int) -> None:
        """Delete all but the newest `keep` versions; pointers go first."""
        whole = [(n, name) for n in self._numbers() if (name := self._named(n))]
        for number, name in whole[keep:]:
            self.fs.delete(self._pointer(number), False)
            self.remove(name)


def publish_atomic(
    df: DataFrame, path: str, check: Callable[[DataFrame], None] | None = None, keep: int = 2, **how
) -> DataFrame:
    """Write a new version of a table, check what was written, then let readers find it.

    Readers use `read_table`. Until the last step they get the version before, and after a failure or
    the loss of the driver at any step they still do. The newest `keep` versions stay, so that a job that
    has begun to read one can end. `how` goes to `write_table`.
    """
    versions = Versions(df.sparkSession, path)
    name = f"v-{uuid.uuid4().hex[:12]}"
    try:
        write_table(df, f"{versions.path}/{name}", **how)
        if check:
            check(df.sparkSession.read.schema(df.schema).parquet(f"{versions.path}/{name}"))
        versions.point_to(name)
    except BaseException:
        versions.remove(name)
        raise
    versions.prune(keep)
    return read_table(df.sparkSession, path)


def read_rules(
    spark: SparkSession, path: str, min_confidence: float = 0.02, fmt: str = "parquet"
) -> DataFrame:
    """Published rules as antecedent, consequent and confidence, strongest first.

    `fmt` is "parquet", or "csv" for a report with a header.
    """
    require_inputs(spark, [path])
    types = {"producto_a_id": "int", "producto_b_id": "int", "confianza": "double"}
    rows = spark.read.format(fmt).option("header", True).load(path)
    return (
        rows.select(*[F.col(c).cast(t).alias(c) for c, t in types.items()])
        .where(F.col("confianza") >= min_confidence)
        .orderBy(F.desc("confianza"), "producto_a_id", "producto_b_id")
    )


def write_report(df: DataFrame, path: str) -> None:
    """Small result table as one CSV. Only for tables whose size does not grow with the data."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def save_params(spark: SparkSession, path: str, params: dict, **origin) -> None:
    """Model parameters with where they came from, as one JSON row."""
    row = json.dumps({"params": params, **origin})
    spark.createDataFrame([(row,)], "value STRING").coalesce(1).write.mode("overwrite").text(path)


def load_params(spark: SparkSession, path: str, default: dict) -> tuple[dict, str]:
    """Saved parameters and their origin, or the defaults if nothing was saved."""
    if not path_exists(spark, path):
        return dict(default), "default"
    saved = json.loads(spark.read.text(path).first()["value"])
    return dict(saved["params"]), f"tuned in {saved.get('trials', '?')} trials"


def work_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    It is the folder the cluster names in spark.checkpoint.dir, and without that setting a folder in
    the warehouse, which all executors reach as well. The session's settings are left as they are.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir')}/tillroll").rstrip("/")


class Store:
    """Intermediate tables of one run: each is built once, written, and read back.

    Reading back cuts the lineage and gives later jobs column pruning, pushed filters and real
    statistics, and a lost executor costs only the tasks it ran. `drop` removes the tables; it is also
    called when the driver's Python ends with the session still open.

    `counts` gives what to count of a table, by its name and columns, while it is written. `require` gets
    the counts of all tables so far and raises if they are wrong; then the table is never seen and its
    files are deleted. Columns whose names begin with _ are counted and not written, unless they are
    partitions.
    """

    def __init__(
        self,
        spark: SparkSession,
        folder: str | None = None,
        counts: Callable[[str, Sequence[str]], dict[str, Column]] = lambda name, columns: {},
        require: Callable[[str, dict[str, dict[str, int]]], None] = lambda name, observed: None,
    ):
        self.spark = spark
        self.counts, self.require = counts, require
        self.observed: dict[str, dict[str, int]] = {}
        base = folder or work_folder(spark)
        self.folder = os.path.join(base, f"tables-{uuid.uuid4().hex[:12]}")
        self._tables: dict[str, DataFrame] = {}
        self._paths: dict[str, str] = {}
        atexit.register(self._drop_at_exit)

    def fresh_path(self, name: str) -> str:
        """A path in the folder that no other call gets."""
        return f"{self.folder}/{name}-{uuid.uuid4().hex[:12]}"

    def _drop_at_exit(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                self.drop()
        except Exception:  # the JVM has gone: nothing can be deleted any more
            return

    def table(
        self,
        name: str,
        build: Callable[[], DataFrame],
        order_by: Sequence[str] | None = None,
        partition_by: Sequence[str] = (),
    ) -> DataFrame:
        if name not in self._tables:
            path, df = self.fresh_path(name), build()
            hidden = [c for c in df.columns if c.startswith("_") and c not in partition_by]
            wanted = list(self.counts(name, df.columns).values())
            try:
                seen = write_table(df, path, order_by, partition_by, wanted, hidden)
                self.require(name, {**self.observed, name: seen})
            except BaseException:
                self._delete(path)
                raise
            self.observed[name], self._paths[name] = seen, path
            # with its schema given, a table without rows can be read too, though it may have no files
            fields = [f for f in df.schema if f.name not in hidden]
            fields.sort(key=lambda f: f.name in partition_by)
            self._tables[name] = self.spark.read.schema(StructType(fields)).parquet(path)
        return self._tables[name]

    def branch(self, without: Sequence[str]) -> Store:
        """A store with the tables of this one but for some, which it builds anew. It has the same folder."""
        other = copy.copy(self)
        for kind in ("_tables", "_paths", "observed"):
            setattr(other, kind, {n: v for n, v in getattr(self, kind).items() if n not in without})
        return other

    def forget(self, name: str) -> None:
        """Take a table back."""
        self._delete(self._paths.pop(name))
        del self._tables[name], self.observed[name]

    def path(self, name: str, build: Callable[[], object]) -> str:
        """Where a table lies, after building it if it is not there yet."""
        if name not in self._tables:
            build()
        return self._paths[name]

    def drop(self) -> None:
        """Delete the tables of this run."""
        self._delete(self.folder)
        self._tables.clear()
        self._paths.clear()
        self.observed.clear()

    def _delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
