"""Two tokenizers' tokens of the same bytes, aligned in groups, and what the corpus says of their id pairs.

A is a byte-level BPE file of the tokenizers library, B a sentencepiece model. Where an A token and a B token end at the same byte
is a shared cut; cuts part a text into groups, and within a group an A and a B token are linked if their bytes overlap.

Groups are found by divide and conquer (`groups_of`): a common end near the middle is looked for by bisection, both halves are
treated alike, and an interval without one is a group. Halves of one depth are treated together, as arrays. Every search crosses a stretch
without a cut, and a stretch is crossed a few times at most, so the work is n log n in the tokens of a text.

A text is cut before each single blank or line end between two visible characters first. No token of either vocabulary crosses such a
place, so these are shared cuts already; each distinct part is encoded (many joined to one string, for speed) and aligned once and remembered by its task up to a bound
(`MOST_PARTS`, `MOST_BYTES`). Text with white space side by side is cut at fewer places, with the same result.

Counts of id pairs over the corpus take a first pass: tasks add up links of parts times occurrences, and Spark adds up the
tasks. A second pass encodes again and looks the counts up. Pairs are at most the product of two vocabularies, too many to broadcast
unseen: up to `BROADCAST_PAIRS` all are; beyond, the most frequent ones are, and links of others, each rarer than those, are
joined by pair. Both ways give equal rows.

Defined cases: texts null, empty, or with bytes that a tokenizer doesn't give back have no tokens: zeros and an empty
digest; special tokens' strings are plain text; very long texts and words are aligned whole; repeated rows each give a row and each
count; an empty table gives an empty result. Other columns are left in the scan.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.llm.common import ragged, record_batch, table, text_blocks, written

BLOCK = 8 << 20
MOST_PARTS, MOST_BYTES = 500_000, 48 << 20
BROADCAST_PAIRS = 4_000_000
#: Bytes of parts that are encoded as one string; distinct pairs that a task holds before it gives them away.
JOINED, HELD_PAIRS = 32_768, 1_000_000

_SIDE_BY_SIDE = regex.compile(r"[\s\x1c-\x1f]{2}|[\s\x1c-\x1f]$")
_CUT = regex.compile(r"(?V1)(?<=[^\s\x1c-\x1f])(?= [^\s\x1c-\x1f])")
_PLAIN = regex.compile(r"[ \n][^\s\x1c-\x1f](?:.*[^\s\x1c-\x1f])?", regex.S)
_FAR = np.int64(2**62)
_CROSSING = re.compile(rb"[^ ] |[^\n]\n|\n[^\n]")
_BLANK_MARK = "▁"
COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def groups_of(a_ends: np.ndarray, b_ends: np.ndarray, a_cuts=None, b_cuts=None) -> np.ndarray:
    """(first A, end A, first B, end B) of each group in order, a row each. Both arrays ascend and end alike.

    a_cuts and b_cuts: ends of intervals that are known to be apart, as numbers of tokens; else all is one. Intervals of
    one depth are treated at once: of each the ends around its middle are looked up by bisection, in widening rings.
    """
    a1 = np.array([len(a_ends)] if a_cuts is None else a_cuts, np.int64)
    b1 = np.array([len(b_ends)] if b_cuts is None else b_cuts, np.int64)
    a0, b0 = (np.concatenate((np.zeros(min(1, len(x)), np.int64), x[:-1])) for x in (a1, b1))
    step, done = np.zeros(len(a1), np.int64), []
    while len(a0):
        middle = (a0 + a1 - 1) // 2  # inner ends are a0 .. a1 - 2
        reach = np.where((a1 - a0 > 1) & (b1 - b0 > 1), np.maximum(middle - a0, a1 - 2 - middle) + 1 - step, 0)
        over = reach <= 0
        if over.any():
            done.append(np.stack((a0[over], a1[over], b0[over], b1[over]), 1))
            a0, a1, b0, b1, step, middle, reach = (x[~over] for x in (a0, a1, b0, b1, step, middle, reach))
            if not len(a0):
                break
        width = np.minimum(np.maximum(step, 1), reach)
        owner, off = np.repeat(np.arange(len(a0)), width), ragged(step, width)
        best = np.full(len(off), _FAR)
        for side, at in enumerate((middle[owner] - off, middle[owner] + off)):
            inside = np.flatnonzero((at >= a0[owner]) & (at < a1[owner] - 1))
            ends = a_ends[at[inside]]
            common = inside[b_ends[np.searchsorted(b_ends, ends)] == ends]
            best[common] = np.minimum(best[common], 2 * off[common] + side)
        nearest = np.minimum.reduceat(best, np.cumsum(width) - width)
        split = nearest < _FAR
        step += width
        if split.any():
            near = nearest[split]
            ca = middle[split] + np.where(near % 2 == 1, near // 2, -(near // 2)) + 1
            cb = np.searchsorted(b_ends, a_ends[ca - 1]) + 1
            rest = ~split
            new = np.zeros(len(ca), np.int64)
            a0, a1, b0, b1, step = (
                np.concatenate(x) for x in ((a0[rest], a0[split], ca), (a1[rest], ca, a1[split]), (b0[rest], b0[split], cb), (b1[rest], cb, b1[split]), (step[rest], new, new))
            )
    found = np.concatenate(done) if done else np.zeros((0, 4), np.int64)
    return found[np.argsort(found[:, 0], kind="stable")]


def links_of(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of A, places of B, end) of all tokens whose bytes overlap: each stretch between two ends lies in one of both."""
    ends = np.sort(np.concatenate((a_ends, b_ends)), kind="stable")
    ends = ends[np.concatenate((ends[1:] != ends[:-1], [True]))] if len(ends) else ends
    return np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends), ends


class Tokenizers:
    """Both vocabularies: ids of a string, and the bytes of each id."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark spreads the work
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        # byte-level letters: visible Latin-1 bytes stand for themselves, the others are numbered from 256
        visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [b for b in range(256) if b not in visible]
        letters = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
        a_bytes = [b""] * self.a.get_vocab_size(with_added_tokens=False)
        for token, i in self.a.get_vocab(with_added_tokens=False).items():
            a_bytes[i] = bytes(map(letters.get, token)) if all(c in letters for c in token) else token.encode()
        b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        rules = json.loads(self.a.to_str())
        byte_level = rules["normalizer"] is None and rules["pre_tokenizer"]["type"] == "ByteLevel" and rules["pre_tokenizer"]["use_regex"]
        #: Whether no token crosses a single blank or line end between visible characters; else texts are one part each.
        self.apart = byte_level and not any(_CROSSING.search(x) for x in b_bytes)
        self.size_b = len(b_bytes)
        #: Of A and of B: length of each id, its bytes, where they begin in all bytes of the side, and those.
        self.sides = []
        for x in (a_bytes, b_bytes):
            sizes = np.fromiter(map(len, x), np.int64, len(x))
            self.sides.append((sizes, x, np.cumsum(sizes) - sizes, np.frombuffer(b"".join(x), np.uint8)))
        # ids as text: of A inside and at the end of its part of a group, then of B
        self.spelled = [b"%d%b" % (i, mark) for side, marks in zip(self.sides, ((b",", b"|"), (b",", b";"))) for mark in marks for i in range(len(side[1]))]
        self.spelled_sizes = np.fromiter(map(len, self.spelled), np.int64, len(self.spelled))

    def _piece(self, i: int) -> bytes:
        return bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace(_BLANK_MARK, " ").encode()

    def encode(self, text: str) -> list[np.ndarray]:
        """Ids of A and of B of a text that begins with a blank."""
        return [np.array(x, np.int64) for x in (self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text[1:]))]

    def whole(self, text: str, found: list[list[int]]) -> bool:
        data = np.frombuffer(text.encode(), np.uint8)
        return all(np.array_equal(own[ragged(starts[ids], sizes[ids])], data) for (sizes, _, starts, own), ids in zip(self.sides, found))


_loaded: dict[tuple[str, str], Tokenizers] = {}


def load(a_path: str, b_path: str) -> Tokenizers:
    """The vocabularies, read once for each Python worker."""
    if (a_path, b_path) not in _loaded:
        _loaded[a_path, b_path] = Tokenizers(a_path, b_path)
    return _loaded[a_path, b_path]


def parts_of(text: str) -> list[str]:
    """Parts of a blank and the text; each begins with a blank or a line end."""
    whole = " " + text
    if _SIDE_BY_SIDE.search(whole):
        return _CUT.split(whole)
    out = []
    for i, line in enumerate(whole.split("\n")):
        first, *rest = line.split(" ")
        if i:
            out.append("\n" + first)
        out.extend([" " + word for word in rest])
    return out


class Parts(dict):
    """part -> row of the tables of what is known of parts; new ones wait until `learn`."""

    def __init__(self, tokenizers: Tokenizers, spell: bool = True, pairs: tuple | None = None):
        super().__init__()
        self.own, self.spell, self.pairs = tokenizers, spell, pairs
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.held = 0
        #: For each row the counts but n_links, whether a tokenizer loses bytes, the links' pairs and the groups spelled out.
        self.counts = np.zeros((0, len(COUNTS)), np.int64)
        self.lossy = np.zeros(0, bool)
        self.starts, self.codes = np.zeros(1, np.int64), np.zeros(0, np.int64)
        self.spelled: list[bytes] = []

    def __missing__(self, part: str) -> int:
        self[part] = row = len(self)
        self.new.append(part)
        self.held += len(part)
        return row

    def rows(self, texts: list[str]) -> list[np.ndarray]:
        """Rows of the parts of each text."""
        if len(self) > MOST_PARTS or self.held > MOST_BYTES:
            self.forget()
        out = []
        for text in texts:
            parts = () if not text else parts_of(text) if self.own.apart else [" " + text]
            out.append(np.fromiter(map(self.__getitem__, parts), np.int64, len(parts)))
        if self.new:
            self.learn()
        return out

    def _encoded(self, parts: list[str]):
        """(indices of parts, ids of A, ids of B): parts that are given back whole, many joined, odd ones alone."""
        alone, joined, size = [], [], 0

        def flush():
            text = " x" + "".join([parts[i] for i in joined])  # begins with a blank, as B needs
            found = self.own.encode(text)
            if self.own.whole(text, found):
                yield joined, *(ids[self._after(side[0], ids, 2) :] for side, ids in zip(self.own.sides, found))
            else:
                alone.extend(joined)

        for i, part in enumerate(parts):
            if not self.own.apart or len(part) > JOINED or _BLANK_MARK in part or not _PLAIN.fullmatch(part):
                alone.append(i)
                continue
            joined.append(i)
            size += len(part)
            if size > JOINED:
                yield from flush()
                joined, size = [], 0
        if joined:
            yield from flush()
        for i in alone:
            # a part that begins with a line end is encoded behind another one
            before = "" if parts[i][0] == " " else " x"
            found = self.own.encode(before + parts[i])
            if self.own.whole(before + parts[i], found):
                yield [i], *(ids[self._after(side[0], ids, len(before)) :] for side, ids in zip(self.own.sides, found))

    @staticmethod
    def _after(sizes: np.ndarray, ids: np.ndarray, n: int) -> int:
        """The first token after n bytes."""
        return int(np.searchsorted(np.cumsum(sizes[ids[:8]]), n)) + 1 if n else 0

    def learn(self) -> None:
        new, self.new = self.new, []
        order, ids = [], ([], [])
        for some, a, b in self._encoded(new):
            order += some
            ids[0].append(a)
            ids[1].append(b)
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in ids)
        sizes = np.fromiter((len(new[i].encode()) for i in order), np.int64, len(order))
        part_ends, (a_ends, b_ends) = np.cumsum(sizes), (np.cumsum(side[0][x]) for side, x in zip(self.own.sides, (a, b)))
        a_cuts, b_cuts = np.searchsorted(a_ends, part_ends) + 1, np.searchsorted(b_ends, part_ends) + 1
        groups = groups_of(a_ends, b_ends, a_cuts, b_cuts)
        a_at, b_at, ends = links_of(a_ends, b_ends)
        codes, cuts = a[a_at] * self.own.size_b + b[b_at], np.searchsorted(ends, part_ends, "right")
        place = np.full(len(new), -1)
        place[order] = np.arange(len(order))
        counts, lossy = np.zeros((len(new), len(COUNTS)), np.int64), place < 0
        group_cuts = np.searchsorted(groups[:, 1], a_cuts, "right")
        for i, x in enumerate((a_cuts, b_cuts, group_cuts, cuts)):
            counts[order, i] = np.diff(x, prepend=0)
        if self.pairs is not None:
            known, n, best = self.pairs
            at = np.minimum(np.searchsorted(known, codes), max(0, len(known) - 1))
            found = known[at] == codes if len(known) else np.zeros(len(codes), bool)
            owner = np.repeat(order, np.diff(cuts, prepend=0))
            np.add.at(counts[:, 4], owner[found], best[at[found]].astype(np.int64))
            np.add.at(counts[:, 5], owner[found], n[at[found]])
            # what stays in codes are links that the table of pairs lacks
            cuts = np.concatenate(([0], np.cumsum(~found)))[cuts]
            codes = codes[~found]
        own_sizes = np.zeros(len(new), np.int64)
        own_sizes[order] = np.diff(cuts, prepend=0)
        first = np.zeros(len(new), np.int64)
        first[order] = cuts - np.diff(cuts, prepend=0)
        self.counts = np.concatenate((self.counts, counts))
        self.lossy = np.concatenate((self.lossy, lossy))
        self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(own_sizes)))
        self.codes = np.concatenate((self.codes, codes[ragged(first, own_sizes)]))
        if self.spell:
            spelled, bounds = self._spelled(a, b, groups, a_cuts + b_cuts)
            self.spelled += [spelled[bounds[p] : bounds[p + 1]] if p >= 0 else b"" for p in place.tolist()]

    def _spelled(self, a: np.ndarray, b: np.ndarray, groups: np.ndarray, cuts: np.ndarray) -> tuple[bytes, list[int]]:
        """(groups as text, each with a mark behind, where the text of each part begins and the last one ends)."""
        a0, a1, b0, b1 = groups.T
        size_a = len(self.own.sides[0][1])
        keys = np.zeros(len(a) + len(b), np.int64)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[a1 - 1] = last_b[b1 - 1] = 1
        keys[np.arange(len(a)) + np.repeat(b0, a1 - a0)] = a + last_a * size_a
        keys[np.arange(len(b)) + np.repeat(a1, b1 - b0)] = b + last_b * self.own.size_b + 2 * size_a
        ends = np.concatenate(([0], np.cumsum(self.own.spelled_sizes[keys])))
        return b"".join(map(self.own.spelled.__getitem__, keys.tolist())), [0, *ends[cuts].tolist()]

    def text(self, rows: np.ndarray) -> bytes:
        """The groups of a text's parts."""
        return b"".join(map(self.spelled.__getitem__, rows.tolist()))[:-1]

    def links(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pairs, number of their links) of rows, each as often as it is given."""
        if not len(rows):
            return rows, rows
        rows, times = np.unique(rows, return_counts=True)
        sizes = self.starts[rows + 1] - self.starts[rows]
        return added(self.codes[ragged(self.starts[rows], sizes)], np.repeat(times, sizes))


def added(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes, owner = np.unique(codes, return_inverse=True)
    out = np.zeros(len(codes), np.int64)
    np.add.at(out, owner, n)
    return codes, out


def _count(a_path: str, b_path: str):
    def run(batches):
        parts = Parts(load(a_path, b_path), spell=False)
        held = []

        def out():
            codes, n = added(*map(np.concatenate, zip(*held)))
            held.clear()
            return record_batch({"code": pa.array(codes, pa.int64()), "n": pa.array(n, pa.int64())})

        for _, texts in text_blocks(batches, BLOCK):
            rows = [r for r in parts.rows(texts) if not parts.lossy[r].any()]
            if rows:
                held.append(parts.links(np.concatenate(rows)))
            if sum(len(c) for c, _ in held) > HELD_PAIRS:
                yield out()
        if held:
            yield out()

    return run


def pair_counts(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """a, b, n (links of the two ids in all texts) and best (no A id is linked with b more often)."""
    a_path, b_path = paths(a_path, b_path)
    size_b = load(a_path, b_path).size_b
    summed = _texts(docs).mapInArrow(_count(a_path, b_path), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    pairs = summed.select(F.floor(F.col("code") / size_b).cast("int").alias("a"), (F.col("code") % size_b).cast("int").alias("b"), "code", "n")
    # partners of a B id are at most the vocabulary of A
    return pairs.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))


def paths(a_path: str | None, b_path: str | None) -> tuple[str, str]:
    if a_path is None or b_path is None:
        import public_tokenizers

        a_path, b_path = a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")
    return a_path, b_path


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def _align(a_path: str, b_path: str, held):
    def run(batches):
        parts = Parts(load(a_path, b_path), pairs=held.value)
        for part, texts in text_blocks(batches, BLOCK):
            counts, digests, codes, numbers = np.zeros((len(texts), len(COUNTS)), np.int64), [], [], []
            for i, rows in enumerate(parts.rows(texts)):
                if not len(rows) or parts.lossy[rows].any():
                    digests.append("")
                    codes.append(rows[:0])
                    numbers.append(rows[:0])
                    continue
                counts[i] = parts.counts[rows].sum(0)
                digests.append(hashlib.sha256(parts.text(rows)).hexdigest())
                rest = parts.links(rows)
                codes.append(rest[0])
                numbers.append(rest[1])
            yield record_batch({
                "doc_id": part.column(0), **{c: pa.array(counts[:, j], pa.int64()) for j, c in enumerate(COUNTS)}, "groups_sha256": pa.array(digests, pa.string()),
                "codes": pa.array(codes, pa.list_(pa.int64())), "numbers": pa.array(numbers, pa.list_(pa.int64())),
            })

    return run


def _frequent(pairs: DataFrame, most: int) -> DataFrame:
    """The most frequent pairs, `most` at most: those whose count is over the smallest bound that allows it."""
    if pairs.count() <= most:
        return pairs
    # counts of pairs by the two leading digits of n in base 2: a few hundred rows
    step = F.floor(4 * F.log2("n"))
    total, bound = 0, None
    for row in pairs.groupBy(step.alias("step")).agg(F.count("*").alias("k"), F.min("n").alias("least")).orderBy(F.desc("step")).collect():
        total += row.k
        if total > most:
            break
        bound = row.least
    return pairs.where(F.lit(False) if bound is None else F.col("n") >= bound)


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, most: int = BROADCAST_PAIRS) -> DataFrame:
    """A row for each document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    a_path, b_path = paths(a_path, b_path)
    pairs = written(pair_counts(docs, a_path, b_path).select("code", "n", "best"), "pairs")
    frequent = _frequent(pairs, most)
    known = frequent.toPandas().sort_values("code")
    held = docs.sparkSession.sparkContext.broadcast((known["code"].to_numpy(np.int64), known["n"].to_numpy(np.int64), known["best"].to_numpy(bool)))
    columns = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", groups_sha256 string"
    found = _texts(docs).mapInArrow(_align(a_path, b_path, held), columns + ", codes array<long>, numbers array<long>")
    if frequent is pairs:
        return found.drop("codes", "numbers")
    found = written(found.withColumn("row", F.monotonically_increasing_id()), "aligned")
    rest = found.select("row", F.explode(F.arrays_zip("codes", "numbers")).alias("x")).select("row", F.col("x.codes").alias("code"), F.col("x.numbers").alias("times"))
    # a pair that isn't broadcast has fewer links than any that is, so none is a key of many rows
    more = rest.join(pairs, "code").groupBy("row").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("b"), F.sum(F.col("times") * F.col("n")).alias("s"))
    totals = {"n_best": F.col("n_best") + F.coalesce("b", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("s", F.lit(0))}
    return found.join(more, "row", "left").withColumns(totals).drop("row", "b", "s", "codes", "numbers")


def _spell(a_path: str, b_path: str):
    def run(batches):
        parts = Parts(load(a_path, b_path))
        for part, texts in text_blocks(batches, BLOCK):
            out = []
            for rows in parts.rows(texts):
                broken = not len(rows) or parts.lossy[rows].any()
                out.append(None if broken else parts.text(rows).decode())
            yield record_batch({"doc_id": part.column(0), "groups": pa.array(out, pa.string())})

    return run


def spelled_groups(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id and groups as `a1,a2|b1;a3|b2,b3` (ids of A and B in order), null where a text has no tokens."""
    return _texts(docs).mapInArrow(_spell(*paths(a_path, b_path)), "doc_id long, groups string")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: alignment of byte_bpe_50k.json with piece_bpe_32k.model over all documents."""
    return align(table(spark, sf_dir, "documents"))
