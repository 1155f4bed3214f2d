"""Language identification by cross-parsing: the language whose text spells a document in the fewest phrases.

For each language the distinct words of a sample of labelled rows, joined by blanks, become a suffix automaton over UTF-8 bytes.
A document is parsed against each: a phrase is the longest match from where the last one ended (a byte that the
language lacks is a phrase of its own). A phrase points into a text of n bytes, so it costs log2(n) bits; phrases times
that, for each word of the document, is its cross entropy, and the smallest wins. The score is the winner's share of
2^-entropy over the languages.

Phrases end at word edges (the blank on both sides belongs to a word), and in words beyond `PART` bytes every `PART` bytes. So
each distinct word is parsed once and documents are sums over their words; all words that a block brings anew are parsed in lockstep,
one byte a step. Words are runs of letters after lower-casing; ASCII characters that aren't letters part them.

The sample is the only bounded thing, and only in rows (`Sample`): labelled rows of at most `row_bytes` are taken in the order of a
hash until there are `rows` of a language, or `bytes` of text; only rows of low hashes, some four times those, are ordered. So an automaton, a task that builds one and what is
broadcast have a bound, whatever the corpus. More than `languages` labels raise an error, none is dropped.
Every text is parsed whole, in its own partition, without a shuffle.

Defined cases: a null text, or one without a letter, is `und` with score 0, as is every text if nothing was learned; ties go to
the first language in order of its bytes; long texts are blocks of their own; repeated rows are learned from once and each
get a row; null labels and null or blank texts are not learned from; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.llm.common import ragged, record_batch, table, text_blocks, written

BLOCK = 8 << 20
PART = 32
UNKNOWN = "und"
#: Cells (words times languages) and bytes of words that a task remembers.
CACHE_CELLS, CACHE_BYTES = 4_000_000, 32 << 20

_FOLD = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Sample:
    """Bounds of what is learned from: rows and bytes of text of a language, bytes of a row, number of languages."""

    rows: int = 400
    bytes: int = 800_000
    row_bytes: int = 40_000
    languages: int = 200


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_FOLD).split()


def suffix_automaton(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(codes, targets): the transitions of the automaton of all substrings, sorted by code = state * 256 + byte. State 0 is the root."""
    following: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for b in data:
        new = len(following)
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and b not in following[p]:
            following[p][b] = new
            p = link[p]
        if p >= 0:
            q = following[p][b]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(following)
                following.append(dict(following[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and following[p].get(b) == q:
                    following[p][b] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    sizes = np.fromiter(map(len, following), np.int64, len(following))
    total = int(sizes.sum())
    keys = np.fromiter((b for f in following for b in f), np.int64, total)
    codes = np.repeat(np.arange(len(following), dtype=np.int64), sizes) * 256 + keys
    targets = np.fromiter((t for f in following for t in f.values()), np.int32, total)
    order = np.argsort(codes)
    return codes[order], targets[order]


class Parser:
    """Counts phrases of many strings against one language at once."""

    def __init__(self, codes: np.ndarray, targets: np.ndarray):
        # open addressing at a load of at most a half: a look-up is a few reads
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(codes)) * 2))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        slot, left = self._slot(codes), np.arange(len(codes))
        while len(left):
            free = left[self.keys[slot[left]] == -1]
            self.keys[slot[free]] = codes[free]  # of several that want a slot the last one gets it
            won = self.keys[slot[left]] == codes[left]
            self.values[slot[left[won]]] = targets[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
        self.root = self.step(np.zeros(256, np.int64), np.arange(256))

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The next state of each, -1 where there is none."""
        codes = states.astype(np.int64) * 256 + symbols
        slot = self._slot(codes)
        found = self.keys[slot]
        out = np.where(found == codes, self.values[slot], np.int32(-1))
        open_ = np.flatnonzero((found != codes) & (found != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[open_]]
            hit = found == codes[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out

    def phrases(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Phrases of each string data[start : start + length]; strings must be given longest first."""
        states, counts = np.zeros(len(starts), np.int32), np.zeros(len(starts), np.int64)
        active = len(starts)
        for k in range(int(lengths[0]) if len(lengths) else 0):
            active = int(np.searchsorted(-lengths[:active], -k))
            now = states[:active]
            symbols = data[starts[:active] + k]
            after = self.step(now, symbols)
            ended = np.flatnonzero(after < 0)
            again = np.where(now[ended] > 0, self.root[symbols[ended]], -1)
            # an ended phrase, and a byte that nothing begins with
            counts[ended] += (now[ended] > 0).astype(np.int64) + (again < 0)
            after[ended] = np.maximum(again, 0)
            states[:active] = after
        return counts + (states > 0)


class Model:
    """Languages in order, their parsers, and what a phrase costs in each."""

    def __init__(self, rows):
        rows = sorted(rows, key=lambda r: r["lang"].encode())
        self.languages = [r["lang"] for r in rows]
        self.parsers = [Parser(np.frombuffer(r["codes"], np.int64), np.frombuffer(r["targets"], np.int32)) for r in rows]
        self.bits = np.array([np.log2(r["n"]) for r in rows])

    def parse(self, words: list[bytes]) -> np.ndarray:
        """(words, languages): phrases of each word with a blank on both sides."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b" %b " % b" ".join(words), np.uint8)
        first = np.cumsum(sizes + 1) - sizes - 1  # of the blank before a word
        parts = np.maximum(1, -(-sizes // PART))
        owner = np.repeat(np.arange(len(words)), parts)
        at = ragged(np.zeros(len(words), np.int64), parts) * PART
        starts = first[owner] + at + (at > 0)  # the first part has the blank before, the last part the one behind
        ends = np.minimum(first[owner] + 1 + at + PART, first[owner] + 1 + sizes[owner])
        ends += at + PART >= sizes[owner]
        order = np.argsort(starts - ends, kind="stable")
        starts, lengths, owner = starts[order], (ends - starts)[order], owner[order]
        out = np.zeros((len(words), len(self.parsers)), np.int32)
        for i, parser in enumerate(self.parsers):
            out[:, i] = np.bincount(owner, parser.phrases(data, starts, lengths), len(words))
        return out


class Words(dict):
    """word -> row of a table of phrases; words met for the first time wait in `new` until the table is made longer."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.new, self.held = model, [], 0
        self.table = np.zeros((0, len(model.languages)), np.int32)

    def __missing__(self, word: bytes) -> int:
        self[word] = row = len(self)
        self.new.append(word)
        self.held += len(word)
        return row

    def rows(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        if len(self) * max(1, self.table.shape[1]) > CACHE_CELLS or self.held > CACHE_BYTES:
            self.clear()
            self.held, self.table = 0, self.table[:0]
        out = [np.fromiter(map(self.__getitem__, words), np.int32, len(words)) for words in texts]
        if self.new:
            self.table = np.concatenate((self.table, self.model.parse(self.new)))
            self.new = []
        return out

    def phrases(self, row: np.ndarray) -> np.ndarray:
        return sum((self.table[row[i : i + 100_000]].sum(0, dtype=np.int64) for i in range(0, len(row), 100_000)), np.zeros(self.table.shape[1], np.int64))


def sample(labelled: DataFrame, sizes: Sample = Sample()) -> DataFrame:
    """lang and text of the rows that are learned from. labelled: doc_id, text, lang."""
    size = F.octet_length("text")
    rows = labelled.select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64(F.col("doc_id"), F.col("text")).alias("key"), size.alias("size"))
    rows = rows.where(F.col("lang").isNotNull() & (F.trim("text") != "") & (size <= sizes.row_bytes))
    counts = written(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    if counts.count() > sizes.languages:
        raise ValueError(f"more than {sizes.languages} languages are labelled")
    # a share of the keys that holds about four times the rows wanted: of it alone, without texts, keys are ordered
    low = (F.col("key") / 2.0**64 + 0.5) * F.col("n") < 4 * sizes.rows
    some = rows.select("lang", "key", "size").join(F.broadcast(counts), "lang").where(low).drop("n")
    by_key = Window.partitionBy("lang").orderBy("key", "size")
    first = some.withColumn("i", F.row_number().over(by_key)).where(F.col("i") <= sizes.rows)
    kept = first.withColumn("total", F.sum("size").over(by_key)).where(F.col("total") <= sizes.bytes)
    keys = written(kept.select("lang", "key").distinct(), "sample")
    return rows.select("lang", "key", "text").join(F.broadcast(keys), ["lang", "key"], "left_semi").dropDuplicates(["lang", "key"]).select("lang", "text")


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    data = b" %b " % b" ".join(sorted({w for t in rows["text"] for w in words_of(t)}))
    codes, targets = suffix_automaton(data)
    return pd.DataFrame({"lang": rows["lang"].iloc[:1], "n": [len(data)], "codes": [codes.tobytes()], "targets": [targets.tobytes()]})


def train(labelled: DataFrame, sizes: Sample = Sample()) -> Model:
    """The model of labelled rows (doc_id, text, lang): an automaton for each language, built in a task of its own."""
    built = sample(labelled, sizes).groupBy("lang").applyInPandas(_build, "lang string, n long, codes binary, targets binary")
    return Model([r.asDict() for r in built.where("n > 2").toLocalIterator()])


def _identify(held):
    def run(batches):
        model: Model = held.value
        known = Words(model)
        for part, texts in text_blocks(batches, BLOCK):
            split = [words_of(t) for t in texts]
            languages, scores = [], []
            for text, row in zip(texts, known.rows(split) if model.languages else split):
                if not model.languages or not _LETTER.search(text):
                    languages.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                entropy = known.phrases(row) * model.bits / max(1, len(row))
                best = int(np.argmin(entropy))
                languages.append(model.languages[best])
                scores.append(float(1 / np.exp2(entropy[best] - entropy).sum()))
            yield record_batch({"doc_id": part.column(0), "lang_pred": pa.array(languages, pa.string()), "score": pa.array(scores, pa.float64())})

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every document."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_identify(held), "doc_id long, lang_pred string, score double")


def is_held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the language of every document, learned from rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs.where(~is_held_out("doc_id")).select("doc_id", "text", "lang")))
    return found.select("doc_id", is_held_out("doc_id").alias("held_out"), "lang_pred", "score")
