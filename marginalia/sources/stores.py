"""Keyed tables in buckets, with versions: a merge writes the buckets that it changes, and no others.

A bucket is the rows of one residue of a key's hash. A version is a list (`manifest`) that says for each bucket which version wrote it;
the rows of a bucket lie in the folder of that version. A merge reads the list of the version before it, copies the buckets that
it changes with their changes into the folder of its own version, and writes its list last: what fails
before leaves the version before as it is, and the same merge again gives the same version. Readers of an older version aren't disturbed.

The batch is broadcast up to a checked number of rows, so a merge doesn't shuffle the stored side; beyond that, or where buckets
have come to lie in many files, only the touched buckets are shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marginalia.functions.shared import shared_path

#: Rows of a batch up to which it is broadcast.
BROADCAST_ROWS = 500_000
#: Files of a bucket, on average, beyond which a merge deals its buckets out anew, to one task each.
MOST_FILES = 4


@dataclass(frozen=True)
class Store:
    """path: a folder that driver and executors share; schema: columns of the rows; buckets: so many that one is some hundred MB."""

    path: str
    schema: str
    keys: list[str]
    buckets: int = 64

    @property
    def columns(self) -> list[str]:
        return StructType.fromDDL(self.schema).names

    def cast(self, rows: DataFrame) -> DataFrame:
        """The store's columns of rows, with the store's types."""
        return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(self.schema)))

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")


def manifest(spark: SparkSession, store: Store, version: int) -> dict[int, int]:
    """bucket -> the version that wrote it; a row for each bucket that has rows."""
    return {r.bucket: r.version for r in spark.read.schema("bucket int, version long").parquet(f"{store.path}/manifest/{version}").collect()}


def _commit(spark: SparkSession, store: Store, version: int, entries: dict[int, int]) -> None:
    rows = spark.createDataFrame(sorted(entries.items()), "bucket int, version long")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{store.path}/manifest/{version}")


def _write(store: Store, version: int, rows: DataFrame) -> None:
    rows.withColumn("bucket", store.bucket()).write.mode("overwrite").partitionBy("bucket").parquet(f"{store.path}/data/{version}")


def create(store: Store, rows: DataFrame) -> None:
    """Version 0: rows, of which each key is there once."""
    spark = rows.sparkSession
    _write(store, 0, store.cast(rows).repartition(store.bucket()))
    wrote = spark.read.schema(f"{store.schema}, bucket int").parquet(f"{store.path}/data/0")
    _commit(spark, store, 0, {r.bucket: 0 for r in wrote.select("bucket").distinct().collect()})


def read(spark: SparkSession, store: Store, version: int, buckets: set[int] | None = None) -> DataFrame:
    """All rows of a version, or those of some buckets."""
    by_version = defaultdict(list)
    for bucket, wrote in manifest(spark, store, version).items():
        if buckets is None or bucket in buckets:
            by_version[wrote].append(bucket)
    paths = [f"{store.path}/data/{wrote}/bucket={b}" for wrote, own in sorted(by_version.items()) for b in sorted(own)]
    reader = spark.read.schema(store.schema)
    return reader.parquet(*paths) if paths else spark.createDataFrame([], store.schema)


def merge(spark: SparkSession, store: Store, version: int, batch: DataFrame, updates: dict[str, Callable[[Column, Column], Column]] | None = None, most: int = BROADCAST_ROWS) -> set[int]:
    """Writes version + 1: rows of batch (each key once) whose key isn't there, and of keys that are there the columns of `updates`,
    each from (old, new). Returns the buckets written; without updates these are the ones that get a new row."""
    path = shared_path(spark, "merge")
    store.cast(batch).withColumn("_bucket", store.bucket()).write.parquet(path)
    new = spark.read.parquet(path)
    entries = manifest(spark, store, version)

    def side(rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if rows.count() <= most else rows

    def touched(rows: DataFrame) -> set[int]:
        return {r["_bucket"] for r in rows.select("_bucket").distinct().collect()}  # at most the number of buckets

    buckets = touched(new)
    target = read(spark, store, version, buckets)
    small = side(new)
    known = target.select(*store.keys).join(small.select(*store.keys), store.keys, "left_semi")
    known.write.parquet(f"{path}-known")
    known = side(spark.read.schema(known.schema).parquet(f"{path}-known"))
    added = new.join(known, store.keys, "left_anti")
    if updates:
        values = small.select(*store.keys, F.lit(True).alias("_hit"), *(F.col(c).alias(f"_{c}") for c in updates))
        both = target.join(values, store.keys, "left")
        kept = both.select(*(F.when(F.col("_hit"), updates[c](F.col(c), F.col(f"_{c}"))).otherwise(F.col(c)).alias(c) if c in updates else F.col(c) for c in store.columns))
    else:
        buckets = touched(added)
        kept = read(spark, store, version, buckets)
    if buckets:
        rows = kept.unionByName(added.select(*store.columns))
        many = len(kept.inputFiles()) > MOST_FILES * len(buckets)
        _write(store, version + 1, rows.repartition(store.bucket()) if many else rows)
    _commit(spark, store, version + 1, entries | dict.fromkeys(buckets, version + 1))
    return buckets
