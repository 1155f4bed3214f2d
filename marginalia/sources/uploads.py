"""Stored uploads, their gate, and batches of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_BYTES = 50 * 1024 * 1024
MIME = "application/pdf"


def upload_dir(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """path, filename, length, modificationTime of stored files; content is read only if selected."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.withColumn("filename", F.element_at(F.split("path", "/"), -1))


def last_written(files: DataFrame) -> DataFrame:
    """Of files of one name the one written last."""
    best = files.groupBy("filename").agg(F.max(F.struct("modificationTime", "path")).alias("m"))
    return best.select("filename", "m.path", "m.modificationTime")


def upload_gate(files: DataFrame) -> DataFrame:
    """(filename, mime, length) with reject_reason, null where a file is accepted; no row is dropped."""
    reason = F.when(F.coalesce(F.col("mime"), F.lit("")) != MIME, "not a PDF").when(F.col("length") > MAX_BYTES, "over 50 MB")
    return files.withColumn("reject_reason", reason)


def upload_batch(files: DataFrame) -> DataFrame:
    """(batch_id, file_no, filename, ok) -> the files that enter the session of their batch, with doc_pos.

    The first file makes the session; if it fails the batch is given up, while a later failure is skipped. Files of one number
    go by name, so that the first one and all positions are the same on every run.
    """
    first = files.groupBy("batch_id").agg(F.min_by("ok", F.when(F.col("file_no").isNotNull(), F.struct("file_no", "filename", "ok"))).alias("first_ok"))
    kept = files.join(first.where("first_ok"), "batch_id").where("ok")
    return kept.select("batch_id", "filename", (F.row_number().over(Window.partitionBy("batch_id").orderBy("file_no", "filename")) - 1).alias("doc_pos"))


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """Plain-text documents, one a file: filename, text."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("filename"), F.col("value").alias("text"))


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Each table under its name; whole tables after a merge."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def read_tables(spark: SparkSession, path: str, names) -> dict[str, DataFrame]:
    """Stored tables by name."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def read_jdbc(spark: SparkSession, url: str, name: str, key: str, bounds: tuple[int, int], parts: int, **options) -> DataFrame:
    """A database table, read in ranges of a numeric key."""
    return spark.read.jdbc(url, name, column=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts, properties=options)


def as_json(rows: DataFrame, *columns: str) -> DataFrame:
    """A JSON object of the columns for each row."""
    return rows.select(F.to_json(F.struct(*columns)).alias("value"))
