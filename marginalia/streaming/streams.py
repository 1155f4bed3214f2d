"""Continuous jobs: chunks of new files, messages once by id, last activity, spells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.shared import shared_path
from marginalia.operators.chunking import chunk_rows
from marginalia.operators.tables import first_arrival
from marginalia.sources.stores import Store, merge

IDLE = "1 hour"


def read_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 1000) -> DataFrame:
    """The Parquet table `name` of a folder as a stream, be it one file or a folder of files, with the schema it has now."""
    now = spark.read.parquet(f"{folder}/{name}.parquet")
    stream = spark.readStream.schema(now.schema).option("maxFilesPerTrigger", files_per_trigger)
    if all(f.endswith(f"/{name}.parquet") for f in now.inputFiles()[:1]):
        return stream.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return stream.parquet(f"{folder}/{name}.parquet")


def run_all(stream: DataFrame, sink, mode: str = "append", progress: str | None = None) -> None:
    """Reads all that is there, from where `progress` (a checkpoint folder) ends."""
    progress = progress or shared_path(stream.sparkSession, "progress")
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", progress).foreachBatch(sink).trigger(availableNow=True).start()
    query.awaitTermination()


def drained(stream: DataFrame, mode: str = "append", path: str | None = None, progress: str | None = None) -> DataFrame:
    """What a stream gives once all that is there is read, with the number of its batch. Batches are written side by side in
    a folder; a repeated batch overwrites itself."""
    spark = stream.sparkSession
    path = path or shared_path(spark, "stream")

    def sink(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    run_all(stream, sink, mode, progress)
    return spark.read.schema(stream.schema.add("batch", "long")).option("basePath", path).parquet(f"{path}/batch=*")


def stream_chunks(docs: DataFrame) -> DataFrame:
    """Chunks of documents as they arrive; stateless."""
    return chunk_rows(docs)


def stream_dedup_messages(messages: DataFrame, ts: str = "created_at", delay: str = "10 minutes") -> DataFrame:
    """Messages once by id while the watermark allows; `merge_messages` catches later ones."""
    return messages.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["id"])


def merge_messages(store: Store):
    """A sink for foreachBatch that inserts the messages whose id isn't in the store yet, of several the first.

    Batch n reads version n of the store and writes version n + 1, of the buckets that get a message only. A repeated
    batch writes the same again.
    """

    def sink(rows: DataFrame, batch: int) -> None:
        merge(rows.sparkSession, store, batch, first_arrival(rows, store.keys, "created_at"))

    return sink


def stream_last_activity(messages: DataFrame, ts: str = "ts", key: str = "session_id") -> DataFrame:
    """For update mode: a batch gives the sessions whose time it changed. `latest_versions` reads what `drained` wrote of it."""
    return messages.groupBy(key).agg(F.max(ts).alias("last_activity"))


def latest_versions(changes: DataFrame, key: str = "session_id") -> DataFrame:
    """The newest row of each key among the changes of all batches (column batch)."""
    return changes.groupBy(key).agg(F.max_by("last_activity", "batch").alias("last_activity"))


def stream_sessions(activity: DataFrame, ts: str = "ts", key: str = "session_id", delay: str = "0 seconds") -> DataFrame:
    """Spells of activity that an hour without any ends; append mode gives a spell when it is over."""
    spells = activity.withWatermark(ts, delay).groupBy(F.session_window(ts, IDLE).alias("w"), key).agg(F.count("*").alias("n_events"), F.max(ts).alias("last_activity"))
    return spells.select(key, F.col("w.start").alias("started"), "last_activity", "n_events")
