"""Byte-level BPE by merge replay over a corpus block, and decoding.

A block of texts is cut into pieces by the tokenizer's pattern; every distinct piece is held once, as bytes in
one array. An inverted index maps each mergeable pair (by the rank of what it merges to) to the positions where
it stands. Ranks are replayed in ascending order: all positions of a rank are merged at once, overlapping ones
from the left, and only the pairs that touch a merged position are entered anew. Pieces then spell documents.

The index is per block of a partition (`BLOCK` bytes of text), not one for the whole corpus: distinct
pieces grow without bound with the corpus, so a corpus-wide table could neither be broadcast nor joined to
every occurrence more cheaply than it is made. Results are the same, since pieces are independent.

If a merge makes a pair of a lower rank than itself (vocabularies that aren't made by merging can), the piece is
encoded alone by always taking the lowest rank, so ids equal the library's for any rank file.

No shuffle: each partition is a job of its own. Defined cases: null and empty texts give no ids; very long texts
are blocks of their own; repeated rows each give a row; empty tables give empty results.
"""

from __future__ import annotations

import base64
import hashlib
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from marginalia.llm.common import id_text, ragged, record_batch, table, text_blocks

BLOCK = 8 << 20
_NONE = np.int32(2**31 - 1)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class MergeReplay:
    """The merges of a rank file, ready to be replayed over many pieces at once."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.size = max(ranks.values()) + 1
        codes, to = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    codes.append(left * self.size + right)
                    to.append(rank)
        order = np.argsort(codes)
        self.codes, self.to = np.array(codes, np.int64)[order], np.array(to, np.int32)[order]
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        by_rank = sorted((r, t) for t, r in ranks.items())
        lengths = np.zeros(self.size, np.int64)
        lengths[[r for r, _ in by_rank]] = [len(t) for _, t in by_rank]
        self.token_starts, self.token_lengths = np.cumsum(lengths) - lengths, lengths
        self.token_bytes = np.frombuffer(b"".join(t for _, t in by_rank), np.uint8)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        code = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.to[at], _NONE)

    def lowest_first(self, piece: bytes) -> list[int]:
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(a + b, _NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == _NONE:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, one after the other; number of ids of each)."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        tok = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(tok)
        if not n:
            return tok, np.zeros(len(pieces), np.int64)
        owner = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
        following, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        alive = np.ones(n, bool)
        rank = np.full(n, _NONE, np.int32)  # of the pair that begins at a position
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner] = self.pair_ranks(tok[inner], tok[inner + 1])
        index: dict[int, list[np.ndarray]] = defaultdict(list)
        odd: set[int] = set()

        def enter(at: np.ndarray) -> None:
            at = at[rank[at] != _NONE]
            if len(at):
                own = rank[at]
                order = np.argsort(own, kind="stable")
                own, at = own[order], at[order]
                cut = np.flatnonzero(np.diff(own)) + 1
                for r, part in zip(own[np.concatenate(([0], cut))].tolist(), np.split(at, cut) if len(cut) else [at]):
                    index[r].append(part)

        enter(inner)
        for r in range(self.size):
            entered = index.pop(r, None)
            if entered is None:
                continue
            at = entered[0] if len(entered) == 1 else np.unique(np.concatenate(entered))
            at = at[(rank[at] == r) & alive[at]]
            if not len(at):
                continue
            if len(at) > 1:  # of a chain of overlapping pairs every second one stays, from the left
                chained = np.concatenate(([False], following[at[:-1]] == at[1:]))
                if chained.any():
                    begin = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                    at = at[(np.arange(len(at)) - begin) % 2 == 0]
            gone = following[at]
            tok[at], alive[gone], rank[gone] = r, False, _NONE
            after = following[gone]
            following[at] = after
            inside = after < n
            before[after[inside]] = at[inside]
            right = inside.copy()
            right[inside] = owner[after[inside]] == owner[at[inside]]
            rank[at] = _NONE
            rank[at[right]] = self.pair_ranks(tok[at[right]], tok[after[right]])
            prior = before[at]
            left = prior >= 0
            left[left] = owner[prior[left]] == owner[at[left]]
            prior = prior[left]
            rank[prior] = self.pair_ranks(tok[prior], tok[following[prior]])
            touched = np.concatenate((at, prior))
            if (low := touched[rank[touched] < r]).size:
                odd.update(owner[low].tolist())
            enter(touched)
        ids, lengths = tok[alive], np.bincount(owner[alive], minlength=len(pieces)).astype(np.int64)
        if odd:
            own = [self.lowest_first(pieces[i]) if i in odd else None for i in range(len(pieces))]
            starts = np.cumsum(lengths) - lengths
            whole = [np.array(x, np.int32) if x is not None else ids[s : s + k] for x, s, k in zip(own, starts.tolist(), lengths.tolist())]
            ids, lengths = np.concatenate(whole), np.fromiter(map(len, whole), np.int64, len(whole))
        return ids, lengths

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other; number of ids of each).

        Texts are cut at single spaces (which go with what follows) and line ends first, and each distinct part is
        cut by the pattern once. That is the same as the pattern over the whole text unless white-space
        characters stand side by side; such texts are cut whole.
        """
        number = count()
        bare: dict[str, int] = defaultdict(number.__next__)
        spaced: dict[str, int] = defaultdict(number.__next__)
        rows = []
        for text in texts:
            if _SIDE_BY_SIDE.search(text):
                row = list(map(bare.__getitem__, self.pattern.findall(text)))
            else:
                row = []
                for line in text.split("\n"):
                    first, *rest = line.split(" ")
                    row.append(bare[first])
                    row.extend(map(spaced.__getitem__, rest))
                    row.append(bare["\n"])
                row.pop()
            rows.append(np.array(row, np.int32))
        parts = [""] * (len(bare) + len(spaced))
        for part, i in bare.items():
            parts[i] = part
        for part, i in spaced.items():
            parts[i] = " " + part
        del bare, spaced
        pieces: dict[str, int] = defaultdict(count().__next__)
        flat, part_sizes, cut = [], [], self.pattern.findall
        for part in parts:
            word = part[1:] if part[:1] == " " else part
            if word.isalpha():
                flat.append(pieces[part])
                part_sizes.append(1)
            elif word[-1:] in _STOPS and word[:-1].isalpha():
                flat += (pieces[part[:-1]], pieces[part[-1]])
                part_sizes.append(2)
            else:
                own = cut(part)
                flat.extend(map(pieces.__getitem__, own))
                part_sizes.append(len(own))
        del parts
        ids, lengths = self.encode([p.encode("utf-8", "surrogatepass") for p in pieces])
        starts = np.cumsum(lengths) - lengths
        flat, part_sizes = np.array(flat, np.int64), np.array(part_sizes, np.int64)
        pool = ids[ragged(starts[flat], lengths[flat])]  # ids of each distinct part
        ends = np.concatenate(([0], np.cumsum(lengths[flat])))
        part_ends = np.cumsum(part_sizes)
        pool_starts = ends[part_ends - part_sizes]
        pool_lengths = ends[part_ends] - pool_starts
        out = [pool[ragged(pool_starts[r], pool_lengths[r])] for r in rows]
        return (np.concatenate(out) if out else ids[:0]), np.fromiter(map(len, out), np.int64, len(out))

    def decode(self, ids: np.ndarray) -> bytes:
        return self.token_bytes[ragged(self.token_starts[ids], self.token_lengths[ids])].tobytes()


_SIDE_BY_SIDE = regex.compile(r"\s\s")
#: Marks that the pattern always parts from letters before them.
_STOPS = (".", ",", "!", "?", ";", ":")


def _encode(replay, digests: bool, arrays: bool):
    def run(batches):
        own: MergeReplay = replay.value
        for part, texts in text_blocks(batches, BLOCK):
            ids, lengths = own.encode_texts(texts)
            ends = np.cumsum(lengths)
            out = {"doc_id": part.column(0), "n_tokens": pa.array(lengths, pa.int64())}
            if digests:
                little = ids.astype("<u4")
                docs = [little[e - k : e] for e, k in zip(ends.tolist(), lengths.tolist())]
                out["ids_sha256"] = pa.array([hashlib.sha256(d).hexdigest() for d in docs], pa.string())
                out["decoded_sha256"] = pa.array([hashlib.sha256(own.decode(d)).hexdigest() for d in docs], pa.string())
            if arrays:
                out["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids, pa.int32()))
            yield record_batch(out)

    return run


def _broadcast(spark: SparkSession, ranks_path: str | None, pattern: str | None):
    """The merges of a rank file; a vocabulary of fixed size, whatever the corpus."""
    if ranks_path is None or pattern is None:
        import public_tokenizers

        ranks_path = ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
        pattern = pattern or public_tokenizers.PATTERN
    return spark.sparkContext.broadcast(MergeReplay(load_ranks(ranks_path), pattern))


def encode(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (array of int) of every document."""
    replay = _broadcast(docs.sparkSession, ranks_path, pattern)
    return id_text(docs).mapInArrow(_encode(replay, False, True), "doc_id long, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and text from doc_id and ids; bytes that aren't UTF-8 become U+FFFD."""
    replay = _broadcast(encoded.sparkSession, ranks_path, pattern)

    def run(batches):
        for batch in batches:
            texts = [replay.value.decode(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield record_batch({"doc_id": batch.column(0), "text": pa.array(texts, pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encode_digests(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document, encoded and decoded again."""
    replay = _broadcast(docs.sparkSession, ranks_path, pattern)
    return id_text(docs).mapInArrow(_encode(replay, True, False), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_checked(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids, and the digests of the ids and of what they decode to, which must be that of the text."""
    replay = _broadcast(docs.sparkSession, ranks_path, pattern)
    return id_text(docs).mapInArrow(_encode(replay, True, True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: digests of the ids and of the decoded bytes of every document."""
    return encode_digests(table(spark, sf_dir, "documents"))
