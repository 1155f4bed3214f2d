"""Passages that repeat across the corpus, by sparse suffix arrays.

A suffix of a text is kept only where the hash of its first PREFIX words is the least among the PASSAGE - PREFIX + 1
prefixes of some window of PASSAGE words (its minimiser): both copies of a passage keep the same suffixes, and one
word in some 18 begins one.

1. Equal texts are one (the smallest doc_id stands for them).
2. One scan keeps sparse suffixes. Sorted by prefix over the cluster (range partitions, ties broken by doc_id and
   place, so a frequent prefix is spread over tasks), neighbours are compared: a suffix whose neighbours begin
   otherwise repeats nothing and goes (copies of one text don't count). Suffixes of the first and last prefix of a
   partition stay; they are settled below. A task passes its partition batch by batch and holds one row between batches.
3. The texts of what is left are read again, and every match is extended to the left and right: each window of
   PASSAGE words whose minimiser is a kept suffix (so it begins up to PASSAGE - PREFIX words before it) is sorted
   by its hash, and neighbours are compared again. Equal neighbours are a repeated window; the union of
   overlapping windows is the maximal match. The first of equal windows, by doc_id and place, is the original.
   Where a run of equal windows crosses the edge of a partition, the first row of each part (two for a partition at
   most) is settled by a join.

So the words found are exactly those within windows of PASSAGE words that occur twice or more in the corpus,
overlaps within one text included. Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased.

Defined cases: null and empty texts and those of fewer than PASSAGE words repeat nothing; rows of equal doc_id and text
are copies of one another; a null doc_id sorts first; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.llm.common import HashCache, id_text, lower_words, record_batch, table, text_blocks, written
from marginalia.llm.minhash import _PRIME, _mix

PASSAGE, PREFIX = 50, 16

_NO_ID = -(2**63)
_NO_KEYS, _NO_PLACES = np.empty(0, np.int64), np.empty(0, np.int64)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of each `size` consecutive words (hashes), by powers of two: O(n log size)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, level, step = np.full(n, size, np.uint64), 0, words, 1
    while step <= size:
        if size & step:
            out = _mix(out * _PRIME + level[done : done + n])
            done += step
        if step * 2 <= size:
            level = _mix(level[:-step] * _PRIME + level[step:])
        step *= 2
    return out


def minimisers(prefixes: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` prefixes the place of the least (the first of equals)."""
    windows = np.lib.stride_tricks.sliding_window_view(prefixes, width)
    return windows.argmin(1) + np.arange(len(windows))


def _anchors(words: np.ndarray, passage: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the prefix at each word, for each passage window the place of its minimiser)."""
    prefixes = window_hashes(words, prefix)
    return prefixes, minimisers(prefixes, passage - prefix + 1)


def _words(text: str, cache: HashCache) -> np.ndarray:
    own = lower_words(text)
    return np.fromiter(map(cache.__getitem__, own), np.int64, len(own)).view(np.uint64)


_SUFFIX = "key long, t1 long, place long, doc long"
_WINDOW = "key long, doc long, place long"


def _suffixes(passage: int, prefix: int):
    """(doc, text, t1) -> its sparse suffixes."""

    def run(batches):
        cache = HashCache()
        for part, texts in text_blocks(batches, 8 << 20):
            found = []
            for text in texts:
                words = _words(text, cache)
                if len(words) < passage:
                    found.append((_NO_KEYS, _NO_PLACES))
                    continue
                prefixes, at = _anchors(words, passage, prefix)
                at = np.unique(at)
                found.append((prefixes[at].view(np.int64), at))
            sizes = [len(k) for k, _ in found]
            doc, t1 = (np.repeat(part.column(i).to_numpy(zero_copy_only=False), sizes) for i in (0, 2))
            yield record_batch({"key": pa.array(np.concatenate([k for k, _ in found])), "t1": pa.array(t1), "place": pa.array(np.concatenate([p for _, p in found])), "doc": pa.array(doc)})

    return run


def _sorted(batches, columns: int):
    """(columns as arrays, whether a row begins a run of its key, whether it differs from the row before) of each batch of a sorted partition.

    All but the key and what is compared stays in its batch; only the last row is carried over."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(columns)]
        before = [np.concatenate(([x[0] if last is None else y], x[:-1])) for x, y in zip(rows, last or rows)]
        begins = rows[0] != before[0]
        differs = begins | (rows[1] != before[1]) | (rows[2] != before[2])
        if last is None:
            begins[0] = differs[0] = True
        last = [x[-1] for x in rows]
        yield rows, begins, differs


def _kept_suffixes(batches):
    """(doc, place) of suffixes whose neighbours begin alike, once for equal texts; and those of the first and last run of a partition.

    The first suffix of a run waits until a second one comes."""
    waiting, seen, runs = None, 0, 0  # of the run that is open: its only suffix, how many there were; runs begun
    for (_, _, place, doc), begins, fresh in _sorted(batches, 4):
        run = np.cumsum(begins)  # 0: the open one
        n = np.bincount(run, fresh).astype(np.int64)
        n[0] += seen
        first = 1 if runs == 0 else 0 if runs == 1 else -1  # the number here of the partition's first run
        keep = fresh & ((n[run] > 1) | (run == first))
        at = np.flatnonzero(keep)
        docs, places = doc[at], place[at]
        if waiting is not None and n[0] > 1:
            docs, places = np.append(docs, waiting[0]), np.append(places, waiting[1])
        if run[-1] > 0 or n[0] > 1:
            waiting = None
        if n[-1] == 1 and run[-1] > 0 and run[-1] != first:
            own = int(np.flatnonzero(begins)[-1])
            waiting = (doc[own], place[own])
        seen, runs = int(n[-1]), runs + int(run[-1])
        yield record_batch({"doc": pa.array(docs), "place": pa.array(places)})
    if waiting is not None:
        yield record_batch({"doc": pa.array(np.array(waiting[:1])), "place": pa.array(np.array(waiting[1:]))})


def _windows(passage: int, prefix: int):
    """(doc, text, number of the text among those of its doc, places of kept suffixes) -> windows whose minimiser is one of them."""

    def run(batches):
        cache = HashCache()
        for part, texts in text_blocks(batches, 4 << 20):
            keys, places = [], []
            for text, no, kept in zip(texts, part.column(2).to_pylist(), part.column(3).to_pylist()):
                words = _words(text, cache)
                at = np.flatnonzero(np.isin(_anchors(words, passage, prefix)[1], kept))
                keys.append(window_hashes(words, passage)[at].view(np.int64))
                places.append(at + (no << 32))
            doc = np.repeat(part.column(0).to_numpy(zero_copy_only=False), [len(k) for k in keys])
            yield record_batch({"key": pa.array(np.concatenate(keys)), "doc": pa.array(doc), "place": pa.array(np.concatenate(places))})

    return run


_REPEATS = "doc long, place long, copy boolean, edge long, n long"


def _repeats(batches):
    """Windows with an equal neighbour, and whether they come after the first.

    What comes after an equal window in its partition is settled. The first of the partition's first run and of its
    last run are not: these two rows carry their key and the size of their run. The first row of a run waits for its end.
    """

    def heads(rows):
        doc, place, edge, n = (np.array(x) for x in zip(*rows))
        return record_batch({
            "doc": pa.array(doc, pa.int64()), "place": pa.array(place, pa.int64()), "copy": pa.array(np.zeros(len(doc), bool)),
            "edge": pa.array(edge.tolist(), pa.int64()), "n": pa.array(n, pa.int64()),
        })

    head, size, runs = None, 0, 0  # of the run that is open: (key, doc, place) of its first row, its size; runs begun
    for (key, doc, place), begins, fresh in _sorted(batches, 3):
        run = np.cumsum(begins)
        n = np.bincount(run, fresh).astype(np.int64)
        n[0] += size
        at = np.flatnonzero(fresh & ~begins)
        none = np.zeros(len(at), bool)
        yield record_batch({
            "doc": pa.array(doc[at]), "place": pa.array(place[at]), "copy": pa.array(~none), "edge": pa.array(key[at], mask=~none),
            "n": pa.array(np.zeros(len(at), np.int64)),
        })
        starts = np.flatnonzero(begins)
        out = []
        if head is not None and len(starts) and (n[0] > 1 or runs == 1):  # the open run ends here
            out.append((head[1], head[2], head[0] if runs == 1 else None, n[0]))
        number = np.arange(1, len(starts))  # of runs that begin and end here
        for k in number[(n[number] > 1) | (runs + number == 1)].tolist():
            i = starts[k - 1]
            out.append((doc[i], place[i], key[i] if runs + k == 1 else None, n[k]))
        if out:
            yield heads(out)
        if len(starts):
            i = starts[-1]
            head = (key[i], doc[i], place[i])
        size, runs = int(n[-1]), runs + int(run[-1])
    if head is not None:
        yield heads([(head[1], head[2], head[0], size)])


def _by_range(rows: DataFrame) -> DataFrame:
    return rows.repartitionByRange(*rows.columns).sortWithinPartitions(*rows.columns)


def _spans(passage: int):
    """(doc, no, places, whether each comes after the first) -> words in repeated windows and the ranges they make."""

    def union(at: np.ndarray) -> list[int]:
        if not len(at):
            return []
        at = np.sort(at)
        cut = np.flatnonzero(np.diff(at) > passage)
        return np.column_stack((at[np.concatenate(([0], cut + 1))], at[np.concatenate((cut, [len(at) - 1]))] + passage)).ravel().tolist()

    def run(batches):
        for batch in batches:
            every, later = [], []
            for places, copies in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                at, copy = np.array(places, np.int64), np.array(copies, bool)
                every.append(union(at))
                later.append(union(at[copy]))
            yield record_batch({"rep": batch.column(0), "no": batch.column(1), "repeated": pa.array(every, pa.list_(pa.int32())), "removed": pa.array(later, pa.list_(pa.int32()))})

    return run


def repeated_passages(docs: DataFrame, passage: int = PASSAGE, prefix: int = PREFIX) -> DataFrame:
    """doc_id, n_words, repeated and removed of every document: word ranges (flat start/end pairs, merged) within
    windows that occur more than once in the corpus, and within those that have occurred before."""
    texts = id_text(docs).select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc"), "text", F.xxhash64("text").alias("t1"))
    second = F.xxhash64(F.lit(7), F.col("text"))
    n_words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
    keyed = written(texts.select("doc", "t1", second.alias("t2"), n_words.alias("n_words")), "texts")
    classes = keyed.where(F.col("n_words") >= passage).groupBy("t1", "t2").agg(F.min("doc").alias("rep"), F.count("*").alias("copies"))
    # a doc_id may come with several texts
    numbered = F.row_number().over(Window.partitionBy("rep").orderBy("t1", "t2")) - 1
    classes = written(classes.withColumn("no", numbered.cast("long")), "classes")
    suffixes = written(texts.select("doc", "text", "t1").mapInArrow(_suffixes(passage, prefix), _SUFFIX), "suffixes")
    kept = _by_range(suffixes).mapInArrow(_kept_suffixes, "doc long, place long")
    kept = kept.groupBy("doc").agg(F.collect_set("place").alias("kept"))
    own = classes.select(F.col("rep").alias("doc"), "t1", "t2", "no").join(kept, "doc")
    again = texts.withColumnRenamed("t1", "own1").withColumn("own2", second).join(own, "doc").where("own1 = t1 and own2 = t2")
    windows = written(again.select("doc", "text", "no", "kept").mapInArrow(_windows(passage, prefix), _WINDOW), "windows")
    found = written(_by_range(windows).mapInArrow(_repeats, _REPEATS), "repeats")
    edges = found.where("edge is not null")
    at = F.struct("doc", "place")
    runs = edges.groupBy("edge").agg(F.min(at).alias("least"), F.max(at).alias("most"), F.max("n").alias("times"))  # two for a partition at most
    runs = runs.where("times > 1 or least != most").select("edge", "least")
    settled = edges.join(runs, "edge").select("doc", "place", (at != F.col("least")).alias("copy"))
    every = found.where("edge is null").select("doc", "place", "copy").union(settled)
    every = every.withColumn("no", F.shiftright("place", 32)).withColumn("place", F.col("place").bitwiseAND(0xFFFFFFFF).cast("int"))
    spans = every.groupBy("doc", "no").agg(F.collect_list(F.struct("place", "copy")).alias("x")).select("doc", "no", "x.place", "x.copy")
    spans = spans.mapInArrow(_spans(passage), "rep long, no long, repeated array<int>, removed array<int>")
    whole = F.array(F.lit(0), F.col("n_words").cast("int"))
    none = F.array().cast("array<int>")
    own = keyed.join(classes, ["t1", "t2"], "left").join(spans, ["rep", "no"], "left")
    return own.select(
        F.when(F.col("doc") != _NO_ID, F.col("doc")).alias("doc_id"), "n_words",
        F.when(F.col("copies") > 1, whole).otherwise(F.coalesce("repeated", none)).alias("repeated"),
        F.when(F.col("doc") != F.col("rep"), whole).otherwise(F.coalesce("removed", none)).alias("removed"),
    )


def _total(spans: str):
    return F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that repeat elsewhere, those that repeat something earlier, and their ranges."""
    found = repeated_passages(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", _total("repeated").alias("n_repeated"), _total("removed").alias("n_removed"),
        F.array_join(F.col("repeated").cast("array<string>"), ",").alias("repeated"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"),
    )
