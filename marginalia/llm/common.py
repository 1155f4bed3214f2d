"""What the corpus operators share: the shared folder, tables written to it, text in blocks."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_DIR = "marginalia"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where it is unset on one machine (tests) a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{TABLE_DIR}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts lineage, survives executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of (doc_id) up to which a set of documents is broadcast to filter others.
BROADCAST_IDS = 500_000


def without(docs: DataFrame, lost: DataFrame, id_col: str = "doc_id", most: int = BROADCAST_IDS) -> DataFrame:
    """The rows of docs, all columns, whose id isn't among lost (column lost_id). Rows without an id stay.

    The ids are broadcast while their number is under `most`; beyond, both sides are shuffled.
    """
    lost = written(lost.select("lost_id").distinct(), "lost")
    if lost.count() <= most:
        lost = F.broadcast(lost)
    return docs.join(lost, docs[id_col] == lost["lost_id"], "left_anti")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that operators read; others, whatever their names, are left in the scan.

    A null text is an empty text.
    """
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )


def give_back() -> None:
    """Returns memory that nothing uses to the system: Python workers outlive the tasks that made them grow."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)


def text_blocks(batches, chars: int):
    """Arrow batches (first column ids, second texts) cut into blocks of about `chars` bytes of text.

    Yields (batch slice, list of texts). A text longer than a block is a block of its own.
    """
    give_back()  # what the task before left in this worker
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(sizes, dtype=np.int64) // chars
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            part = batch.slice(start, end - start)
            yield part, [t or "" for t in part.column(1).to_pylist()]
    batch = part = None
    give_back()


def record_batch(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def word_hash(word: str | bytes, salt: bytes = b"") -> int:
    """A signed 64-bit hash, the same on every machine."""
    data = word if isinstance(word, bytes) else word.encode("utf-8", "surrogatepass")
    return int.from_bytes(hashlib.blake2b(data, digest_size=8, key=salt).digest(), "little", signed=True)


class HashCache(dict):
    """word -> 64-bit hash, computed once per word; emptied when it holds `most` words."""

    def __init__(self, most: int = 200_000, salt: bytes = b""):
        super().__init__()
        self.most, self.salt = most, salt

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        self[word] = value = word_hash(word, self.salt)
        return value


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every range, one range after the other."""
    lengths = np.asarray(lengths, dtype=np.int64)
    total = int(lengths.sum())
    if not total:
        return np.empty(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, dtype=np.int64) - (ends - lengths), lengths)


#: ASCII bytes that separate words in [^\x20\x09-\x0D]+; A-Z are lower-cased.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def lower_words(text: str) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
