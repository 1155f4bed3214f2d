"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Random indexing: each word has an index vector of DIMENSIONS places, all 0 but NONZERO of +1 or -1 that its hash
picks. The vector of a word is the sum of the index vectors of the words within REACH of its occurrences, over the
whole corpus; words share BUCKETS rows by hash, so the table has a fixed size whatever the vocabulary. Each task
adds up its texts; tables are summed by a tree in which FAN tables meet in a group at most, however many tasks there are.
A document is the mean and the spread of its words' vectors, its length, and how concentrated it is.

The network (hidden layer of HIDDEN rectified units, logistic output) is trained with numpy on a bounded sample of
SAMPLE labelled documents (smallest hashes of doc_id first, read by a broadcast of their ids); the temperature that
divides its output is chosen on a part that was held back from training, so scores are probabilities.

Words keep their marks apart and their capitals as a word of its own, so shouting, markup and mark-laden
texts show in the vectors. Defined cases: null and empty texts pool to zeros; repeated rows each count and each give
a row; without labels of both classes every score is 0.5; empty tables give empty results; other columns are not
read.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import id_text, ragged, record_batch, table, text_blocks

BUCKETS, DIMENSIONS, NONZERO, REACH = 8192, 48, 2, 2
HIDDEN, SAMPLE, EPOCHS = 32, 12_000, 60
THRESHOLD = 0.3
_PARTS = 16
#: Tables of one part that are added in a group.
FAN = 64

_PIECE = re.compile(r"[^\W_]+|[\W_]+")


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the index vector of each bucket."""
    rng = np.random.default_rng(11)
    return rng.integers(0, DIMENSIONS, (BUCKETS, NONZERO)), rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def _pieces(part: str) -> list[int]:
    """Buckets of the words of a part between blanks: letters lower-cased, marks apart, capitals as a word."""
    out = []
    for w in _PIECE.findall(part):
        if len(w) > 1 and w.isupper():
            out.append(zlib.crc32(b"<capitals>") % BUCKETS)
        out.append(zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) % BUCKETS)
    return out


def sequences(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of the words of all texts, one after the other; number of words of each)."""
    numbers: dict[str, int] = defaultdict(count().__next__)
    rows = [np.fromiter(map(numbers.__getitem__, t.split()), np.int64) for t in texts]
    pieces = [_pieces(p) for p in numbers]
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    starts = np.cumsum(sizes) - sizes
    pool = np.fromiter((x for p in pieces for x in p), np.int64, int(sizes.sum()))
    lengths = np.array([int(sizes[r].sum()) for r in rows], np.int64)
    own = np.concatenate(rows) if rows else np.empty(0, np.int64)
    return pool[ragged(starts[own], sizes[own])], lengths


def add_contexts(total: np.ndarray, words: np.ndarray, lengths: np.ndarray) -> None:
    """Adds to total (flat, BUCKETS * DIMENSIONS) what the words of some texts see around them."""
    places, signs = index_vectors()
    text = np.repeat(np.arange(len(lengths)), lengths)
    for distance in range(1, REACH + 1):
        same = text[distance:] == text[:-distance] if len(text) > distance else np.zeros(0, bool)
        left, right = words[:-distance][same], words[distance:][same]
        for a, b in ((left, right), (right, left)):
            for k in range(NONZERO):
                total += np.bincount(a * DIMENSIONS + places[b, k], signs[b, k], minlength=total.size)


def _count_contexts(batches):
    total = np.zeros(BUCKETS * DIMENSIONS)
    for _, texts in text_blocks(batches, 4 << 20):
        add_contexts(total, *sequences(texts))
    task = TaskContext.get().partitionId()
    parts = total.reshape(_PARTS, -1)
    yield record_batch({"part": pa.array(range(_PARTS), pa.int32()), "node": pa.array([task] * _PARTS, pa.int64()), "sums": pa.array([p.tobytes() for p in parts], pa.binary())})


def _add(rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), np.float64) for x in rows["sums"])
    return pa.table({"part": rows["part"][:1], "node": rows["node"][:1], "sums": pa.array([total.tobytes()], pa.binary())})


def word_vectors(docs: DataFrame, fan: int = FAN) -> np.ndarray:
    """The table of word vectors, centred and of length 1 each: BUCKETS x DIMENSIONS, always that size."""
    sums = id_text(docs).mapInArrow(_count_contexts, "part int, node long, sums binary")
    tasks = max(2, sums.rdd.getNumPartitions())
    while tasks > 1:
        sums = sums.withColumn("node", F.floor(F.col("node") / fan).cast("long")).groupBy("part", "node").applyInArrow(_add, "part int, node long, sums binary")
        tasks = -(-tasks // fan)
    out = np.zeros((_PARTS, BUCKETS * DIMENSIONS // _PARTS))
    for r in sums.select("part", "sums").collect():  # _PARTS rows
        out[r.part] += np.frombuffer(r.sums, np.float64)
    out = out.reshape(BUCKETS, DIMENSIONS)
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    used = np.abs(out).sum(1) > 0
    if used.any():
        out[used] -= out[used].mean(0)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pool(vectors: np.ndarray, words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Features of texts: means, spreads, length of the mean vector, logarithm of the number of words."""
    out = np.zeros((len(lengths), 2 * DIMENSIONS + 2), np.float32)
    ends = np.cumsum(lengths)
    for at in range(len(lengths)):
        n = int(lengths[at])
        if not n:
            continue
        own = words[ends[at] - n : ends[at]]
        if n > 2 * BUCKETS:  # a very long text: by how often each bucket occurs
            times = np.bincount(own, minlength=BUCKETS).astype(np.float32)
            mean, square = times @ vectors / n, times @ vectors**2 / n
        else:
            seen = vectors[own]
            mean, square = seen.mean(0), np.einsum("ij,ij->j", seen, seen) / n
        out[at, :DIMENSIONS], out[at, DIMENSIONS:-2] = mean, np.sqrt(np.maximum(square - mean**2, 0))
        out[at, -2:] = np.linalg.norm(mean), np.log1p(n)
    return out


class Network:
    """Two layers and a temperature, over features brought to mean 0 and spread 1."""

    def __init__(self, features: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = np.zeros(features), np.ones(features)
        self.w1 = rng.normal(0, np.sqrt(2 / features), (features, HIDDEN))
        self.b1, self.w2, self.b2 = np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), 0.0
        self.temperature = 1.0
        self.trained = False

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.spread @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(self.logits(x.astype(np.float64)) / self.temperature, -40, 40)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 3e-3, decay: float = 1e-4, seed: int = 5) -> Network:
        x, y = x.astype(np.float64), y.astype(np.float64)
        if len(set(y.tolist())) < 2:
            return self
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(x))
        aside, own = order[: len(x) // 5], order[len(x) // 5 :]
        self.mean, self.spread = x[own].mean(0), x[own].std(0) + 1e-6
        names = ("w1", "b1", "w2", "b2")
        first, second, step = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
        for _ in range(epochs):
            for batch in np.array_split(rng.permutation(own), max(1, len(own) // 64)):
                z = (x[batch] - self.mean) / self.spread
                pre = z @ self.w1 + self.b1
                hidden = np.maximum(pre, 0)
                error = (1 / (1 + np.exp(-np.clip(hidden @ self.w2 + self.b2, -40, 40))) - y[batch]) / len(batch)
                back = np.outer(error, self.w2) * (pre > 0)
                slopes = {"w1": z.T @ back + decay * self.w1, "b1": back.sum(0), "w2": hidden.T @ error + decay * self.w2, "b2": error.sum()}
                step += 1
                for k in names:
                    first[k] = 0.9 * first[k] + 0.1 * slopes[k]
                    second[k] = 0.999 * second[k] + 0.001 * slopes[k] ** 2
                    setattr(self, k, getattr(self, k) - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8))
        self.trained = True
        logits = self.logits(x[aside])
        grid = np.geomspace(0.25, 8, 41)
        loss = [np.logaddexp(0, np.where(y[aside] > 0, -1, 1) * logits / t).sum() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))]) if len(aside) else 1.0
        return self


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def features(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """doc_id and pooled features of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches):
        for part, texts in text_blocks(batches, 4 << 20):
            x = pool(shared.value, *sequences(texts))
            yield record_batch({"doc_id": part.column(0), "x": pa.array(list(x), pa.list_(pa.float32()))})

    return id_text(docs).mapInArrow(run, "doc_id long, x array<float>")


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, sample: int = SAMPLE) -> Network:
    """A network from a bounded sample of labelled documents whose crc32(doc_id) mod 5 is not 0."""
    known = labels.select("doc_id", "quality").where("doc_id is not null and quality in (0, 1)").where(~held_out("doc_id"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    own = id_text(docs).join(F.broadcast(known), "doc_id").select("doc_id", "text")
    rows = features(own, vectors).join(F.broadcast(known), "doc_id").select("doc_id", "x", "quality").collect()  # at most sample
    rows = sorted((r.doc_id, r.x, r.quality) for r in rows)
    net = Network(2 * DIMENSIONS + 2)
    return net.fit(np.array([r[1] for r in rows]), np.array([r[2] for r in rows])) if rows else net


def score(docs: DataFrame, vectors: np.ndarray, net: Network) -> DataFrame:
    """doc_id and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast((vectors, net))

    def run(batches):
        own, model = shared.value
        for part, texts in text_blocks(batches, 4 << 20):
            yield record_batch({"doc_id": part.column(0), "score": pa.array(model.probability(pool(own, *sequences(texts))), pa.float64())})

    return id_text(docs).mapInArrow(run, "doc_id long, score double")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: score and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    vectors = word_vectors(docs)
    scored = score(docs, vectors, train(docs, table(spark, sf_dir, "labels"), vectors))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
