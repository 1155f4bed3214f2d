"""The given tables in the shape that operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.numbering import numbered
from marginalia.operators.chunking import CHUNK_BYTES, chunk_rows


class Tables:
    """Each property is a plan over a table of sf_dir; nothing is read before an action."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def documents(self) -> DataFrame:
        return self.read("documents").select(
            F.col("doc_id").cast("string").alias("doc_id"), F.format_string("doc_%d.pdf", "doc_id").alias("filename"), "text", F.lit(1).alias("pages"), F.col("source").alias("session_id"), F.col("doc_id").alias("no")
        )

    @property
    def pages(self) -> DataFrame:
        """Lines of documents as pages; an empty line stands for a page that could not be read."""
        lines = self.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
        return lines.select("doc_id", (F.col("n") + 1).alias("page_no"), F.nullif("line", F.lit("")).alias("text"))

    @property
    def session_documents(self) -> DataFrame:
        own = numbered(self.documents.select("session_id", "doc_id", "filename", "pages", "no"), "session_id", "no", name="doc_pos")
        return own.withColumn("doc_pos", F.col("doc_pos").cast("int"))

    @property
    def text_sessions(self) -> DataFrame:
        return self.documents.groupBy("session_id").agg(F.min_by("doc_id", "no").alias("primary_doc_id"))

    @property
    def chunks(self) -> DataFrame:
        return chunk_rows(self.documents)

    @property
    def chunk_bounds(self) -> DataFrame:
        """session_id and at least the number of its chunks: two neighbours hold more than a chunk's bytes together."""
        return self.documents.groupBy("session_id").agg(F.sum(F.floor(F.octet_length("text") * 2 / CHUNK_BYTES) + 1).alias("n"))

    @property
    def messages(self) -> DataFrame:
        m = self.read("conversations")
        return m.select(F.format_string("%d-%d", "conv_id", "turn").alias("id"), F.col("conv_id").alias("session_id"), F.col("turn").alias("msg_seq"), "role", F.col("text").alias("content"))

    @property
    def questions(self) -> DataFrame:
        m = self.read("conversations").where("role = 'user'")
        return m.select(F.format_string("%d-%d", "conv_id", "turn").alias("question_id"), F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")).alias("session_id"), F.col("turn").alias("msg_seq"), F.col("text").alias("message"))

    @property
    def users(self) -> DataFrame:
        return self.read("customer").select(F.col("c_custkey").alias("id"), F.format_string("c%d@example.com", "c_custkey").alias("email"), F.md5("c_name").alias("password_hash"), F.col("c_name").alias("name"))

    @property
    def sessions(self) -> DataFrame:
        return self.read("orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("title"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("last_activity"))

    @property
    def files(self) -> DataFrame:
        """lineitem as uploaded files; doc_id repeats."""
        item = self.read("lineitem")
        return item.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("doc_id"), F.col("l_orderkey").alias("session_id"), F.format_string("part_%d.pdf", "l_partkey").alias("filename"), F.col("l_quantity").cast("int").alias("pages"), F.col("l_shipdate").alias("uploaded_at"))

    @property
    def activity(self) -> DataFrame:
        return self.read("events").select(F.col("event_id").alias("seq"), "ts", F.col("user_id").alias("session_id"), "event_type")
