"""Stored uploads as a data source, read as a table or as a stream: spark.read.format("uploads"), spark.readStream.format("uploads").

A row a file: path, filename, modified, length, reject_reason, content. Files that the gate refuses are rows with a reason and without
content, which isn't read for them; a file that can't be read (gone since it was listed, say) is a row with the reason
"unreadable". Many small files share a task, up to a number of bytes and of files.
"""

from __future__ import annotations

import mimetypes
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone
from fnmatch import fnmatchcase
from typing import NamedTuple

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from marginalia.sources.uploads import MAX_BYTES, MIME

SCHEMA = "path string, filename string, modified timestamp, length long, reject_reason string, content binary"
#: Content and rows of an Arrow batch.
BATCH_BYTES, BATCH_ROWS = 4 * 1024 * 1024, 10_000


class Stored(NamedTuple):
    """A file as listed; order is that in which a stream gives files."""

    micros: int
    path: str
    length: int


class Pack(InputPartition):
    """The files of a task."""

    def __init__(self, files: list[Stored]):
        self.files = files


class Folder:
    """What the options say, and the files it names. Listing is recursive; names that begin with a dot or an underscore are left out,
    as are files that aren't of `pattern`."""

    def __init__(self, options):
        self.uri = options["path"]
        self.pattern = options.get("pattern", "*")
        self.mime = options.get("mime", MIME)
        self.max_bytes = int(options.get("maxBytes", MAX_BYTES))
        self.pack_bytes = int(options.get("packBytes", 128 * 1024 * 1024))
        self.pack_files = int(options.get("packFiles", 10_000))
        self.settle = float(options.get("settleSeconds", 0))

    def system(self):
        """The file system of the folder, and the path in it."""
        from pyarrow.fs import FileSystem, LocalFileSystem

        return FileSystem.from_uri(self.uri) if ":/" in self.uri else (LocalFileSystem(), self.uri)

    def listed(self) -> list[Stored]:
        from pyarrow.fs import FileSelector, FileType

        system, root = self.system()
        found = []
        for f in system.get_file_info(FileSelector(root, recursive=True)):
            below = f.path[len(root.rstrip("/")) :].strip("/").split("/")
            if f.type == FileType.File and fnmatchcase(f.base_name, self.pattern) and not any(x[:1] in "._" for x in below):
                found.append(Stored(f.mtime_ns // 1000 if f.mtime_ns else 0, f.path, f.size))
        return sorted(found)

    def settled(self) -> list[Stored]:
        """Files that were last written some time ago."""
        until = (datetime.now(timezone.utc).timestamp() - self.settle) * 1_000_000
        return [f for f in self.listed() if f.micros <= until]

    def reason(self, name: str, length: int) -> str | None:
        if self.mime != "*" and mimetypes.guess_type(name)[0] != self.mime:
            return "not a PDF" if self.mime == MIME else f"not {self.mime}"
        if length > self.max_bytes:
            return "over 50 MB" if self.max_bytes == MAX_BYTES else f"over {self.max_bytes} bytes"
        return None

    def packed(self, files: Iterable[Stored]) -> list[Pack]:
        """Files in order, as many to a task as its bytes and files allow; a refused file counts no bytes."""
        packs: list[Pack] = []
        held = 0
        for f in files:
            n = 0 if self.reason(f.path.rsplit("/", 1)[-1], f.length) else f.length
            if not packs or (n and held and held + n > self.pack_bytes) or len(packs[-1].files) >= self.pack_files:
                packs.append(Pack([]))
                held = 0
            packs[-1].files.append(f)
            held += n
        return packs

    def rows(self, files: Iterable[Stored]) -> Iterator[tuple]:
        system, _ = self.system()
        for micros, path, length in files:
            name = path.rsplit("/", 1)[-1]
            reason, content = self.reason(name, length), None
            if reason is None:
                try:
                    with system.open_input_stream(path) as stream:
                        content = stream.read(self.max_bytes + 1)
                    if len(content) > self.max_bytes:  # it grew since it was listed
                        reason, content = self.reason(name, len(content)), None
                except OSError:
                    reason = "unreadable"
            yield path, name, datetime.fromtimestamp(micros / 1_000_000, timezone.utc), length, reason, content

    def batches(self, files: Iterable[Stored]) -> Iterator:
        """The rows as Arrow batches of BATCH_BYTES of content, or of one file, so that a task doesn't hold its files at once."""
        import pyarrow as pa

        kinds = [pa.string(), pa.string(), pa.timestamp("us", "UTC"), pa.int64(), pa.string(), pa.binary()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        held, size = [], 0
        for row in self.rows(files):
            held.append(row)
            size += len(row[-1] or b"")
            if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)


class UploadReader(DataSourceReader):
    def __init__(self, folder: Folder):
        self.folder = folder

    def partitions(self) -> list[Pack]:
        return self.folder.packed(self.folder.settled()) or [Pack([])]

    def read(self, partition: Pack) -> Iterator:
        return self.folder.batches(partition.files)


class UploadStream(DataSourceStreamReader):
    """Files by (modified, path). An offset is the last file given, so a batch is what lies between two offsets, and a restart goes on after the
    last one. A file that appears with an older time than the offset's is not seen: settleSeconds holds new files back until clocks
    and writers agree. A file that is written again is a new one."""

    def __init__(self, folder: Folder):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"micros": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = self.folder.settled()
        return {"micros": files[-1].micros, "path": files[-1].path} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Pack]:
        low, high = (start["micros"], start["path"]), (end["micros"], end["path"])
        return self.folder.packed(f for f in self.folder.listed() if low < (f.micros, f.path) <= high)

    def read(self, partition: Pack) -> Iterator:
        return self.folder.batches(partition.files)


class UploadSource(DataSource):
    """Options: path; pattern (of file names); mime (what the gate accepts, "*" for all); maxBytes (of a file); packBytes, packFiles (of a task);
    settleSeconds (how long ago a file was last written, at least)."""

    @classmethod
    def name(cls) -> str:
        return "uploads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> UploadReader:
        return UploadReader(Folder(self.options))

    def streamReader(self, schema) -> UploadStream:
        return UploadStream(Folder(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(UploadSource)
