"""Token ids in length-delimited binary records, with an offset index for shuffled reads.

A data file is the 8 bytes `MAGIC`, one byte for the width of an id (2 or 4), and a record for each document:

    length of the payload   unsigned 64-bit little-endian
    masked CRC-32 of those 8 bytes
    payload: doc_id (signed 64-bit; NO_ID for null), then the ids, little-endian
    masked CRC-32 of the payload

A checksum is masked by rotating it 15 bits right and adding MASK, so that a checksum over data that holds
checksums stays sound. Beside each data file lies an index file of 20 bytes a record: doc_id (signed 64-bit),
offset of the record in the data file (unsigned 64-bit), number of ids (unsigned 32-bit): a reader that wants
records in random order, or by doc_id, seeks to them.

Rows are range-partitioned and sorted by doc_id and the hash of the text, so that rows without an id, or of one id, are
dealt over tasks, too; each task streams its range to files named by its attempt, in
the shared folder, through any file system that pyarrow knows by URI. Only tasks that succeed enter the
manifest (a table that Spark commits), so a lost executor leaves unused files at worst. First ids of the
parts follow from the manifest's counts. Readers take one part each and verify every checksum.

Encoding is by the tokenizers library, part by part, where no word crosses the cut: before a blank, and between a letter or
digit and marks that end there. Texts are cut as arrays; each distinct part of a block is looked up once, encoded once per
worker and kept in a cache of two halves of about `CACHE` parts. Parts of letters go to the library `JOINED` at once,
and are told apart by the ids that end a word. A text that may hold the string of a special token, which the library then
takes for that token, and any text with a vocabulary of other rules, is given to it whole.

Defined cases: null and empty texts are records with the end id alone; the string of a special token is that token; rows of equal doc_id are written side by
side in the order of their texts' hashes; a null doc_id comes first; an empty table gives an empty manifest.
"""

from __future__ import annotations

import json
import os
import string
import struct
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.llm.common import id_text, new_path, ragged, record_batch, table, text_blocks, written

MAGIC = b"MGTOKEN1"
MASK = 0xA282EAD8
NO_ID = -(2**63)
END_ID = 1
CACHE = 600_000
#: Parts of letters that the library gets as one text.
JOINED = 100

_INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("n", "<u4")])
#: Rules of a vocabulary that let texts be cut into parts.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_WORDS = {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": _WORDS, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}
_IS_MARK = np.isin(np.arange(256), list(string.punctuation.encode()))
#: Last two bytes of letters and digits that stay one letter or digit when texts are normalised.
_BEFORE_MARKS = np.zeros((256, 256), bool)
_BEFORE_MARKS[:, list((string.ascii_letters + string.digits).encode())] = True
for _c in map(chr, range(0xC0, 0x250)):
    if _c.isalpha() and len(_c.lower()) == 1:
        _BEFORE_MARKS[tuple(_c.encode())] = True


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(doc_id: int, ids: bytes) -> bytes:
    payload = struct.pack("<q", doc_id) + ids
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked_crc(length)), payload, struct.pack("<I", masked_crc(payload))))


class PartEncoder:
    """text -> ids as bytes, by the tokenizers library, with a bounded cache of parts."""

    def __init__(self, path: str, most: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark spreads the work
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        #: Whether words end where `cut_parts` cuts; a text goes to the library whole, else.
        self.cuts = rules["normalizer"] == _NORMALIZER and rules["pre_tokenizer"] == _PRE_TOKENIZER
        #: How the strings of special tokens begin.
        self.marks = {t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.cache: dict[str, bytes] = {" ": b""}
        self.old: dict[str, bytes] = {}
        self.most = most
        self.end = np.array([END_ID], self.dtype).tobytes()
        #: Of each id, whether it ends a word.
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if suffix := self.tokenizer.model.end_of_word_suffix:
            self.ends[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith(suffix)]] = True

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, parts: list[str], ids: np.ndarray, sizes) -> None:
        data = ids.tobytes()
        ends = (np.cumsum(sizes, dtype=np.int64) * self.dtype.itemsize).tolist()
        self.cache.update(zip(parts, (data[s:e] for s, e in zip([0, *ends], ends))))

    def _learn(self, parts: list[str]) -> None:
        """Parts that aren't known yet. Those of letters go to the library `JOINED` at once. Each gives one word or more:
        where as many words come back as went, each is one, and ends where a word ends. Others go alone."""
        letters, alone = [], []
        for part in parts:
            if part in self.old:
                self.cache[part] = self.old[part]
            else:
                (letters if part.lstrip(" ").isalpha() else alone).append(part)
        for at in range(0, len(letters), 100 * JOINED):
            some = letters[at : at + 100 * JOINED]
            lines = [some[i : i + JOINED] for i in range(0, len(some), JOINED)]
            found = self._ids(list(map(" ".join, lines)))
            flat = np.fromiter(chain.from_iterable(found), self.dtype)
            together = np.count_nonzero(self.ends[flat]) == len(some)
            for words, ids in [(some, flat)] if together else zip(lines, (np.array(x, self.dtype) for x in found)):
                ends = np.flatnonzero(self.ends[ids]) + 1
                if len(ends) == len(words):
                    self._keep(words, ids, np.diff(ends, prepend=0))
                else:
                    alone += words
        for at in range(0, len(alone), 10_000):
            some = alone[at : at + 10_000]
            found = self._ids(some)
            self._keep(some, np.fromiter(chain.from_iterable(found), self.dtype), list(map(len, found)))

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        special = {i: self._whole(t) + self.end for i, t in enumerate(texts) if not self.cuts or any(m in t for m in self.marks)}
        parts, numbers, bounds = cut_parts(["" if i in special else t for i, t in enumerate(texts)])
        if len(self.cache) > self.most:  # the older half goes
            self.cache, self.old = {" ": b""}, self.cache
        found = list(map(self.cache.get, parts))
        new = [i for i, ids in enumerate(found) if ids is None]
        self._learn([parts[i] for i in new])
        for i in new:
            found[i] = self.cache[parts[i]]
        size = self.dtype.itemsize
        counts = np.fromiter(map(len, found), np.int64, len(found)) // size
        starts, ids = np.cumsum(counts) - counts, np.frombuffer(b"".join(found), self.dtype)
        steps = (numbers[i : i + 500_000] for i in range(0, len(numbers), 500_000))
        data = b"".join(ids[ragged(starts[x], counts[x])].tobytes() for x in steps)
        ends = (np.concatenate(([0], np.cumsum(counts[numbers])))[bounds] * size).tolist()
        return [special[i] if i in special else data[s:e] + self.end for i, (s, e) in enumerate(zip(ends, ends[1:]))]


def cut_parts(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct parts of texts, the number of each part in order, and the bounds of each text among those.

    A text is cut before every blank or line feed, and before marks that end at such a cut and follow a letter or digit;
    no word of the vocabulary crosses these. Parts in ASCII are in lower case.
    """
    array = pa.array(texts, pa.large_string())
    offsets = np.frombuffer(array.buffers()[1], np.int64, len(texts) + 1)
    data = np.frombuffer(array.buffers()[2] or b"", np.uint8, offsets[-1])
    data = np.where(data == 10, np.uint8(32), data)
    cut = np.empty(len(data) + 1, bool)
    np.equal(data, 32, out=cut[:-1])
    cut[offsets] = True
    marks = np.zeros(len(data) + 1, bool)
    marks[:-1] = _IS_MARK[data]
    # a run of marks is broken where a text ends, and ends where the next byte isn't one
    edge = np.flatnonzero((marks[1:] != marks[:-1]) | (cut[1:] & marks[:-1])) + 1
    begin = edge[:-1][marks[edge[:-1]] & cut[edge[1:]] & ~cut[edge[:-1]]]
    begin = begin[begin > 1]
    cut[begin[_BEFORE_MARKS[data[begin - 2], data[begin - 1]]]] = True
    cuts = np.flatnonzero(cut)
    ascii_part = np.repeat(np.maximum.reduceat(data, cuts[:-1]) < 128, np.diff(cuts))
    data |= (ascii_part & (data - np.uint8(65) < 26)).view(np.uint8) << 5
    parts = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(data)).dictionary_encode()
    return parts.dictionary.to_numpy(zero_copy_only=False).tolist(), parts.indices.to_numpy(), np.searchsorted(cuts, offsets)


_encoders: dict[str, PartEncoder] = {}


def _encoder(path: str) -> PartEncoder:
    if path not in _encoders:
        _encoders[path] = PartEncoder(path)
    return _encoders[path]


def _write(folder: str, vocabulary: str):
    def run(batches):
        task = TaskContext.get()
        name = f"{folder}/part-{task.partitionId():07d}-{task.taskAttemptId()}"
        encoder, store, at = _encoder(vocabulary), None, 0
        size = encoder.dtype.itemsize
        n_records = n_ids = 0
        data = index = None
        for part, texts in text_blocks(batches, 4 << 20):
            if store is None:
                store, path = pafs.FileSystem.from_uri(name)
                store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                data, index = store.open_output_stream(path + ".rec"), store.open_output_stream(path + ".idx")
                data.write(MAGIC + bytes([size]))
                at = len(MAGIC) + 1
            ids = [NO_ID if i is None else i for i in part.column(0).to_pylist()]
            encoded = encoder.encode(texts)
            frames = [frame(i, e) for i, e in zip(ids, encoded)]
            entries = np.zeros(len(ids), _INDEX)
            sizes = np.fromiter(map(len, frames), np.int64, len(frames))
            entries["doc_id"], entries["n"] = ids, [len(e) // size for e in encoded]
            entries["offset"] = at + np.cumsum(sizes) - sizes
            data.write(b"".join(frames))
            index.write(entries.tobytes())
            at += int(sizes.sum())
            n_records, n_ids = n_records + len(ids), n_ids + int(entries["n"].sum())
        if store is not None:
            data.close()
            index.close()
            yield record_batch({
                "part": pa.array([task.partitionId()], pa.int32()), "uri": pa.array([name]),
                "n_records": pa.array([n_records], pa.int64()), "n_ids": pa.array([n_ids], pa.int64()),
            })

    return run


def write_token_files(docs: DataFrame, folder: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """Writes all documents in ascending doc_id order; returns the manifest: part, uri, n_records, n_ids."""
    spark = docs.sparkSession
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    folder = folder or new_path(spark, "tokens")
    order = ("doc_id", F.xxhash64("text"))
    rows = id_text(docs).repartitionByRange(*order).sortWithinPartitions(*order)
    return written(rows.mapInArrow(_write(folder, vocabulary), "part int, uri string, n_records long, n_ids long"), "manifest")


def read_index(uri: str) -> np.ndarray:
    """The offset index of one part."""
    store, path = pafs.FileSystem.from_uri(uri)
    with store.open_input_stream(path + ".idx") as f:
        return np.frombuffer(f.read(), _INDEX)


def read_record(handle, entry, width: int) -> tuple[int, np.ndarray]:
    """The record of an index entry, from a seekable file: (doc_id, ids). For reads in any order."""
    handle.seek(int(entry["offset"]))
    return _parse(handle.read(12 + 8 + int(entry["n"]) * width + 4), width)


def _parse(record: bytes, width: int) -> tuple[int, np.ndarray]:
    length, check = struct.unpack_from("<QI", record)
    payload = record[12 : 12 + length]
    if check != masked_crc(record[:8]) or struct.unpack_from("<I", record, 12 + length)[0] != masked_crc(payload):
        raise ValueError("a record's checksum differs")
    return struct.unpack_from("<q", payload)[0], np.frombuffer(payload, f"<u{width}", offset=8)


def read_part(uri: str, chunk: int = 8 << 20):
    """(doc_id, ids) of every record of a part in file order, streamed, with every checksum verified."""
    store, path = pafs.FileSystem.from_uri(uri)
    with store.open_input_stream(path + ".rec") as f:
        head = f.read(len(MAGIC) + 1)
        if head[:-1] != MAGIC:
            raise ValueError("not a token file")
        width, rest, more = head[-1], b"", True
        while more:
            data = f.read(chunk)
            more, rest, at = bool(data), rest + data, 0
            while at + 8 <= len(rest):
                end = at + 16 + struct.unpack_from("<Q", rest, at)[0]
                if end > len(rest):
                    break
                yield _parse(rest[at:end], width)
                at = end
            rest = rest[at:]
        if rest:
            raise ValueError("a record is cut off")


def _read(digest: bool):
    def run(batches):
        for batch in batches:
            for uri, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, starts, counts, values, held = [], [], [], [], 0

                def out():
                    last = {"ids_crc32": pa.array(values, pa.int64())} if digest else {"ids": pa.array(values, pa.list_(pa.int32()))}
                    return record_batch({"doc_id": pa.array(ids, pa.int64()), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(counts, pa.int64()), **last})

                for doc_id, found in read_part(uri):
                    ids.append(None if doc_id == NO_ID else doc_id)
                    starts.append(first)
                    counts.append(len(found))
                    values.append(zlib.crc32(found.astype("<u4").tobytes()) if digest else found)
                    first += len(found)
                    held += len(found)
                    if held > 2_000_000 or len(ids) >= 10_000:
                        yield out()
                        ids, starts, counts, values, held = [], [], [], [], 0
                if ids:
                    yield out()

    return run


def read_token_files(manifest: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, and ids (or, for digest, their CRC-32)."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file, not for each document
    parts = manifest.select("uri", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")).alias("first"), "part")
    parts = parts.repartition(manifest.sparkSession.sparkContext.defaultParallelism * 8, "part").select("uri", "first")
    last = "ids_crc32 long" if digest else "ids array<int>"
    return parts.mapInArrow(_read(digest), f"doc_id long, start long, n_tokens long, {last}")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: encodes and writes all documents, reads the files back, and digests what they hold."""
    return read_token_files(write_token_files(table(spark, sf_dir, "documents")), digest=True)
