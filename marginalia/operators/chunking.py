"""Page text to documents, documents to chunks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import ordered_join

CHUNK_BYTES = 2000
_SPACE = re.compile(r"[\s\x85]+")


def assemble_pages(pages: DataFrame, marked: bool = False) -> DataFrame:
    """(doc_id, page_no, text) -> doc_id, text, pages. Null pages are skipped but counted; marked: with headings."""
    kept = F.when(F.col("text").isNotNull(), F.concat(*([F.format_string("--- Page %d ---\n", "page_no")] if marked else []), "text", F.lit("\n\n")))
    return pages.groupBy("doc_id").agg(ordered_join("page_no", kept).alias("text"), F.count("*").alias("pages"))


def reject_blank(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with text, rejected doc_ids with an error code)."""
    some = F.col("text").rlike(r"(?U)\S")
    return docs.where(some), docs.where(~F.coalesce(some, F.lit(False))).select("doc_id", F.lit("PDF_PROCESSING_ERROR").alias("code"))


def words_of(text: str) -> list[str]:
    """Words between any Unicode white space, as `fields` has them."""
    # \s of Python also takes U+001C to U+001F, which aren't separators
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return [w for w in re.split(r"[^\S\x1c-\x1f]+|\x85", text) if w]
    return text.split()


def pack(text: str, limit: int = CHUNK_BYTES) -> list[str]:
    """Greedy packing of words; a text within the limit stays as it is, and a word is never cut."""
    if len(text.encode("utf-8", "surrogatepass")) <= limit:
        return [text]
    chunks, current, size = [], [], 0
    for word in words_of(text):
        n = len(word) if word.isascii() else len(word.encode("utf-8", "surrogatepass"))
        if current and size + n + 1 > limit:
            chunks.append(" ".join(current))
            current, size = [], 0
        size += n + (1 if current else 0)
        current.append(word)
    if current:
        chunks.append(" ".join(current))
    return chunks


def chunk_documents(docs: DataFrame, limit: int = CHUNK_BYTES) -> DataFrame:
    """All columns but text, and chunk_index from 0 and text of each chunk. No shuffle."""

    @F.pandas_udf("array<string>")
    def packed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: pack(t, limit), na_action="ignore")

    rest = [c for c in docs.columns if c != "text"]
    return docs.select(*rest, F.posexplode(packed("text")).alias("chunk_index", "text"))


def chunk_rows(docs: DataFrame, limit: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, chunk_id (the same on every run), chunk_index, page_number, text."""
    chunks = chunk_documents(docs.select("doc_id", "text"), limit)
    chunk_id = F.sha2(F.concat_ws(":", "doc_id", F.col("chunk_index").cast("string")), 256)
    return chunks.select("doc_id", chunk_id.alias("chunk_id"), "chunk_index", F.lit(1).alias("page_number"), "text")


def document_status(requests: DataFrame, docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """For each requested doc_id its filename, pages, number of chunks and status."""
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"))
    known = docs.select("doc_id", "filename", "pages").withColumn("known", F.lit(True))
    out = requests.join(known, "doc_id", "left").join(n, "doc_id", "left")
    return out.select(
        "doc_id", "filename", "pages", F.when(F.col("known"), F.coalesce("chunks", F.lit(0))).alias("chunks"),
        F.when(F.col("known"), "processed").otherwise("not found").alias("status"),
    )
