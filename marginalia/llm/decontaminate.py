"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased. A window is `n` consecutive
words of an item; an item of fewer words, but not none, is one window. Training texts are scanned
window by window: windows made only of benchmark words are hashed, looked up, and every hit is verified
word by word. The broadcast index is checked against `max_index_bytes`. A larger benchmark stays a table of windows: a
bit for each hash of a window is set in an array of that many bytes, which is broadcast in place of the index; the texts are scanned for
windows whose bit is set, and those are verified by a join with the windows, on all their words. So texts are read
twice, once to scan and once to give the result, whatever the benchmark, and no slice, item or hot window is one task.

Defined cases: a null or empty text has no words and no hit; a null item text and an item without words
have no window; items without an item_id count as one item, which lists of ids leave out; rows of one item_id are one item; repeated documents each give a row; empty tables give empty
(or hit-free) results; other columns of either table are never read.
"""

from __future__ import annotations

import hashlib
import re
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import BROADCAST_IDS, HashCache, give_back, id_text, record_batch, table, text_blocks, written

WINDOW = 10
MAX_INDEX_BYTES = 32 << 20

_KEEP = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if c in _KEEP else 32 for c in range(256))
#: The same words in a text whose case was not changed.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def _hash_rows(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), dtype=np.uint64)
    for column in rows.T:
        h = (h ^ (h >> np.uint64(29))) * _PRIME + column.astype(np.uint64)
    return h


def in_order(items) -> list[str | None]:
    """Sorted as strings; what has no id comes last."""
    return sorted(items, key=lambda x: (x is None, x or ""))


class WindowIndex:
    """The windows of some items: by length, sorted hashes, the words of each window, and its items."""

    def __init__(self, items: list[tuple[str | None, str]], n: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple, set[str | None]]] = {}
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(text or "")]
            size = min(n, len(ids))
            for i in range(len(ids) - size + 1) if size else ():
                by_length.setdefault(size, {}).setdefault(tuple(ids[i : i + size]), set()).add(item)
        self.tables = []
        for size, found in sorted(by_length.items()):
            rows = np.array(list(found), dtype=np.int64).reshape(-1, size)
            owners = [in_order(x) for x in found.values()]
            hashes = _hash_rows(rows)
            order = np.argsort(hashes, kind="stable")
            self.tables.append((size, hashes[order], rows[order], [owners[i] for i in order]))

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers of all texts, 0 for words that no item has; number of words of each)."""
        lists = [words(t) for t in texts]
        lengths = np.array([len(x) for x in lists], dtype=np.int64)
        return np.concatenate([np.fromiter(map(self.vocab.get, x, repeat(0)), np.int64, len(x)) for x in lists] or [np.empty(0, np.int64)]), lengths

    def scan(self, ids: np.ndarray, lengths: np.ndarray):
        """ids: word numbers of all texts of a block, 0 for other words. Returns hit words, and (position, owners)."""
        hit = np.zeros(len(ids) + 1, dtype=np.int32)
        found = []
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        ends = np.repeat(np.cumsum(lengths), lengths)
        for size, hashes, rows, owners in self.tables:
            at = np.flatnonzero(known[size:] - known[:-size] == size) if len(ids) >= size else np.empty(0, np.int64)
            at = at[at + size <= ends[at]]
            for part in np.array_split(at, len(at) // 500_000 + 1):
                window = ids[part[:, None] + np.arange(size)] if len(part) else np.empty((0, size), np.int64)
                h = _hash_rows(window)
                left, right = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
                some = np.flatnonzero(right > left)
                for k in range(int((right - left).max(initial=0))):  # windows that share a hash, hardly ever more than one
                    some = some[left[some] + k < right[some]]
                    row = left[some] + k
                    same = (rows[row] == window[some]).all(axis=1)
                    for i, r in zip(part[some[same]].tolist(), row[same].tolist()):
                        found.append((i, owners[r]))
                        hit[i] += 1
                        hit[i + size] -= 1
        return np.cumsum(hit[:-1]) > 0, found


def _scan(index):
    """mapInArrow: (doc_id, text, spans, items) -> the same with what this index hits added."""

    def run(batches):
        own: WindowIndex = index.value
        for part, texts in text_blocks(batches, 8 << 20):
            ids, lengths = own.numbers(texts)
            hit, found = own.scan(ids, lengths)
            ends = np.cumsum(lengths)
            items: dict[int, set[str]] = {}
            for doc, (_, owners) in zip(np.searchsorted(ends, [i for i, _ in found], "right").tolist(), found):
                items.setdefault(doc, set()).update(owners)
            spans_out, items_out = part.column(2).to_pylist(), part.column(3).to_pylist()
            for doc, new in items.items():
                begin = ends[doc] - lengths[doc]
                edge = np.flatnonzero(np.diff(np.concatenate(([0], hit[begin : ends[doc]], [0]))))
                spans_out[doc] = _merge([*spans_out[doc], *edge.tolist()])
                items_out[doc] = in_order({*items_out[doc], *new})
            yield record_batch({
                "doc_id": part.column(0), "text": part.column(1), "n_words": pa.array(lengths, pa.int64()),
                "spans": pa.array(spans_out, pa.list_(pa.int32())), "items": pa.array(items_out, pa.list_(pa.string())),
            })

    return run


def _merge(flat: list[int]) -> list[int]:
    """[s0, e0, s1, e1, ...] sorted, with overlapping ranges joined."""
    out: list[int] = []
    for s, e in sorted(zip(flat[::2], flat[1::2])):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def _merged(batches):
    """(doc_id, text, spans, items) with unmerged spans -> n_words and merged spans."""
    for part, texts in text_blocks(batches, 8 << 20):
        yield record_batch({
            "doc_id": part.column(0), "text": part.column(1), "n_words": pa.array([len(words(t)) for t in texts], pa.int64()),
            "spans": pa.array([_merge(x) for x in part.column(2).to_pylist()], pa.list_(pa.int32())), "items": part.column(3),
        })


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, max_index_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """doc_id, text, n_words, spans (word ranges hit, flat start/end pairs), items (ids as strings) of every document."""
    rows, schema = id_text(docs), "doc_id long, text string, n_words long, spans array<int>, items array<string>"
    no_spans, no_items = F.array().cast("array<int>"), F.array().cast("array<string>")
    if (index := small_index(benchmark, n, max_index_bytes)) is not None:
        return rows.select("doc_id", "text", no_spans.alias("spans"), no_items.alias("items")).mapInArrow(_scan(index), schema)
    rows = rows.withColumn("key", F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(" "), "text"), 256))
    places = F.collect_set(F.struct("pos", "size"))
    found = verified(rows, benchmark, n, max_index_bytes).groupBy("key").agg(
        F.flatten(F.transform(places, lambda x: F.array(x["pos"], x["pos"] + x["size"]))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("owners")))).alias("items"),
    )
    out = rows.join(found, "key", "left").select("doc_id", "text", F.coalesce("spans", no_spans).alias("spans"), F.coalesce("items", no_items).alias("items"))
    return out.mapInArrow(_merged, schema)


def small_index(benchmark: DataFrame, n: int, max_index_bytes: int):
    """The broadcast index of a benchmark under the bound; None beyond it."""
    spark = benchmark.sparkSession
    items = _items(benchmark)
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    # the index of a text takes about 40 times its bytes (n numbers and some objects a window)
    if size * 40 > max_index_bytes:
        return None
    return spark.sparkContext.broadcast(WindowIndex([(r.item, r.text) for r in items.collect()], n))  # max_index_bytes / 40 at most


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce("text", F.lit("")).alias("text"))


def window_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """Signed hashes of all windows of so many words; codes: hashes of the words."""
    h = np.full(max(len(codes) - size + 1, 0), size, dtype=np.uint64)
    for k in range(size):
        h = (h ^ (h >> np.uint64(29))) * _PRIME + codes[k : len(h) + k]
    return h.view(np.int64)


def _found(key, at, begins, size: int, h: np.ndarray, flat: list[bytes]):
    """Rows (key, pos, size, h, words) of windows, some at a time."""
    for i in range(0, len(at), 50_000):
        some = at[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([
            key.take(pa.array(np.searchsorted(begins, some, "right") - 1)), pa.array(some - begins[np.searchsorted(begins, some, "right") - 1], pa.int32()),
            pa.array(np.full(len(some), size), pa.int32()), pa.array(h[some]), pa.array([b" ".join(flat[j : j + size]) for j in some.tolist()], pa.binary()),
        ], names=["key", "pos", "size", "h", "words"])


_FOUND = "key string, pos int, size int, h long, words binary"


def _windows(sizes: list[int], n: int, bits=None):
    """mapInArrow: (key, text) -> windows of n words, and of texts of fewer those; for bits all windows of these sizes whose bit is set."""

    def run(batches):
        own, cache = None if bits is None else bits.value, HashCache()
        for part, texts in text_blocks(batches, 4 << 20):
            lists = [words(t) for t in texts]
            some = np.flatnonzero([len(x) > 0 for x in lists])
            lengths = np.array([len(lists[i]) for i in some], dtype=np.int64)
            flat = [w for x in lists for w in x]
            codes = np.fromiter(map(cache.__getitem__, flat), np.int64, len(flat)).view(np.uint64)
            begins = np.cumsum(lengths) - lengths
            key = part.column(0).take(pa.array(some, pa.int64()))
            left = np.repeat(begins + lengths, lengths) - np.arange(len(flat))  # words from here to the end of the text
            full = np.repeat(lengths, lengths)
            for size in sizes:
                h = window_hashes(codes, size)
                fits = left[: len(h)] >= size
                if own is None:
                    fits &= (size == n) | (full[: len(h)] == size)
                else:
                    bit = h % (8 * len(own))
                    fits &= (own[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0
                yield from _found(key, np.flatnonzero(fits), begins, size, h, flat)

    return run


#: Parts of the array of bits, each packed by one task; salts of a window that documents share.
PARTS, SALTS = 64, 16


def bit_array(spark: SparkSession, windows: DataFrame, max_bytes: int):
    """A broadcast array of max_bytes in which the bit of each window's hash is set; parts of it are packed in tasks."""
    width = max(max_bytes // PARTS, 1)

    def pack(group: pa.Table) -> pa.Table:
        at = group["at"].to_numpy()
        bits = np.zeros(width * 8, dtype=np.uint8)
        bits[at % (width * 8)] = 1
        return pa.table({"part": pa.array([int(at[0]) // (width * 8)], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    at = windows.select(F.pmod("h", F.lit(width * PARTS * 8)).alias("at")).distinct()
    parts = at.groupBy(F.floor(F.col("at") / (width * 8)).alias("p")).applyInArrow(pack, "part int, bits binary")
    out = np.zeros((PARTS, width), dtype=np.uint8)
    for r in parts.toLocalIterator():  # max_bytes in all
        out[r.part] = np.frombuffer(r.bits, dtype=np.uint8)
    return spark.sparkContext.broadcast(out.ravel())


def verified(rows: DataFrame, benchmark: DataFrame, n: int = WINDOW, max_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """key, pos, size, owners (item ids) of the windows of rows (key, text) that the benchmark, of any size, holds.

    Windows are met by hash and all words. Those that no document holds are dropped before the rest is salted, so
    that a window that a third of the documents hold is SALTS keys.
    """
    spark, window = rows.sparkSession, ["h", "size", "words"]
    own = written(_items(benchmark).select("item", "text").mapInArrow(_windows(list(range(1, n + 1)), n), _FOUND), "windows")
    sizes = [r.size for r in own.select("size").distinct().collect()]  # n at most
    scan = _windows(sorted(sizes), n, bit_array(spark, own, max_bytes))
    seen = written(rows.select("key", "text").mapInArrow(scan, _FOUND), "seen")
    owned = own.groupBy(*window).agg(F.collect_set(F.struct(F.col("key").alias("item"))).alias("o"))
    owned = owned.join(seen.select(*window).distinct(), window, "left_semi").select(*window, F.transform("o", lambda x: x["item"]).alias("owners"))
    salted = owned.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = seen.withColumn("salt", F.pmod(F.xxhash64("key", "pos"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, [*window, "salt"]).select("key", "pos", "size", "owners")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, max_index_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """The rows of docs, all columns, whose text holds no window of the benchmark."""
    if (index := small_index(benchmark, n, max_index_bytes)) is not None:
        return docs.where(~_holds(index)("text"))

    def digest(text):
        return F.sha2(F.coalesce(text, F.lit("")), 256)

    rows = docs.select(digest(F.col("text")).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    lost = written(verified(rows, benchmark, n, max_index_bytes).select(F.col("key").alias("lost_key")).distinct(), "lost")
    if lost.count() <= BROADCAST_IDS:
        lost = F.broadcast(lost)
    return docs.join(lost, digest(docs["text"]) == lost["lost_key"], "left_anti")


def _holds(index):
    @F.pandas_udf("boolean")
    def holds(texts: pd.Series) -> pd.Series:
        give_back()
        out = []
        for i in range(0, len(texts), 1_000):
            ids, lengths = index.value.numbers([t or "" for t in texts[i : i + 1_000]])
            ends = np.concatenate(([0], np.cumsum(lengths)))
            hits = np.concatenate(([0], np.cumsum(index.value.scan(ids, lengths)[0])))
            out += (hits[ends[1:]] > hits[ends[:-1]]).tolist()
        return pd.Series(out, dtype="bool")

    return holds


def decontaminate(docs: DataFrame, benchmark: DataFrame, action: str = "document", n: int = WINDOW) -> DataFrame:
    """doc_id and text of the documents without benchmark windows ("document"), or of all, with hit words cut ("span")."""
    hits = find_hits(docs, benchmark, n)
    if action == "document":
        return hits.where(F.size("spans") == 0).select("doc_id", "text")

    def cut(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for row, spans in enumerate(batch.column(2).to_pylist()):
                if spans:
                    at = [m.span() for m in _WORD.finditer(texts[row])]
                    parts, last = [], 0
                    for s, e in zip(spans[::2], spans[1::2]):
                        parts.append(texts[row][last : at[s][0]])
                        last = at[e - 1][1]
                    texts[row] = "".join([*parts, texts[row][last:]])
            yield record_batch({"doc_id": batch.column(0), "text": pa.array(texts, pa.string())})

    return hits.select("doc_id", "text", "spans").mapInArrow(cut, "doc_id long, text string")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: counts of hit words and items of every document."""
    hits = find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    signed = F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))  # ends less starts
    return hits.select(
        "doc_id", "n_words", F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(x for x in items if x is not None)).encode()).hexdigest()
