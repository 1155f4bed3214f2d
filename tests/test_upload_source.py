"""Stored uploads, read as a table and as a stream."""

import os

import pytest
from marginalia.sources import upload_source as U
from marginalia.streaming import streams as S


def put(folder, name, content, at):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content)
    os.utime(path, (at, at))


def got(rows):
    return sorted((r.filename, r.modified.timestamp(), r.length, r.reject_reason, r.content and bytes(r.content)) for r in rows.collect())


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "up"
    put(root, "a.pdf", b"%PDF a", 1000)
    put(root, "deep/b.pdf", b"%PDF b" * 9, 1000)
    put(root, "c.txt", b"text", 1001)
    put(root, "big.pdf", b"x" * 101, 999)
    put(root, "empty.pdf", b"", 1002)
    put(root, ".hidden.pdf", b"x", 1000)
    put(root, "_tmp/d.pdf", b"x", 1000)
    return root


WANT = sorted([
    ("a.pdf", 1000, 6, None, b"%PDF a"), ("b.pdf", 1000, 54, None, b"%PDF b" * 9), ("c.txt", 1001, 4, "not a PDF", None),
    ("big.pdf", 999, 101, "over 100 bytes", None), ("empty.pdf", 1002, 0, None, b""),
])


def test_batch_and_stream_agree(spark, folder, tmp_path):
    U.register(spark)
    read = {"path": f"file://{folder}", "maxBytes": "100"}
    assert got(spark.read.format("uploads").options(**read).load()) == WANT
    assert got(spark.read.format("uploads").options(**(read | {"path": str(folder)})).load()) == WANT
    progress, out = f"file://{tmp_path}/progress", f"file://{tmp_path}/out"

    def drained():
        return S.drained(spark.readStream.format("uploads").options(**read).load(), path=out, progress=progress)

    assert got(drained()) == WANT
    put(folder, "late.pdf", b"late", 2000)
    put(folder, "a.pdf", b"%PDF A", 2000)  # written again
    new = [("a.pdf", 2000, 6, None, b"%PDF A"), ("late.pdf", 2000, 4, None, b"late")]
    assert got(drained()) == sorted(WANT + new)
    assert got(drained()) == sorted(WANT + new)  # nothing new
    assert got(spark.read.format("uploads").options(**read).load()) == sorted([w for w in WANT if w[0] != "a.pdf"] + new)


def test_small_files_share_a_task(spark, tmp_path):
    for i in range(50):
        put(tmp_path, f"{i:02}.pdf", b"x" * 10, 1000 + i)
    put(tmp_path, "large.pdf", b"x" * 500, 2000)
    put(tmp_path, "refused.pdf", b"x" * 5000, 2001)
    U.register(spark)
    rows = spark.read.format("uploads").options(path=str(tmp_path), packBytes="100", maxBytes="1000").load()
    assert rows.count() == 52 and rows.rdd.getNumPartitions() == 6
    few = spark.read.format("uploads").options(path=str(tmp_path), packFiles="20", maxBytes="1000").load()
    assert few.rdd.getNumPartitions() == 3
    assert spark.read.format("uploads").options(path=str(tmp_path), pattern="0*.pdf", mime="*").load().count() == 10


def test_refused_and_unreadable_files_are_not_read(folder):
    own = U.Folder({"path": str(folder), "maxBytes": "100"})
    files = own.listed()
    (folder / "a.pdf").unlink()
    opened = []

    class Spy:
        def __init__(self, system):
            self.system = system

        def open_input_stream(self, path):
            opened.append(path.rsplit("/", 1)[-1])
            return self.system.open_input_stream(path)

    system, root = own.system()
    own.system = lambda: (Spy(system), root)
    found = {name: (reason, content) for _, name, _, _, reason, content in own.rows(files)}
    assert found["a.pdf"] == ("unreadable", None) and found["c.txt"][0] == "not a PDF" and found["big.pdf"] == ("over 100 bytes", None)
    assert sorted(opened) == ["a.pdf", "b.pdf", "empty.pdf"]
    put(folder, "deep/b.pdf", b"x" * 200, 1000)  # grew after it was listed
    assert {n: r for _, n, _, _, r, _ in own.rows(files)}["b.pdf"] == "over 100 bytes"


def test_files_settle_first(folder):
    put(folder, "new.pdf", b"x", 4_000_000_000)
    names = [f.path.rsplit("/", 1)[-1] for f in U.Folder({"path": str(folder), "settleSeconds": "5"}).settled()]
    assert names == ["big.pdf", "a.pdf", "b.pdf", "c.txt", "empty.pdf"]


def test_an_empty_folder(spark, tmp_path):
    U.register(spark)
    assert spark.read.format("uploads").option("path", str(tmp_path)).load().count() == 0
    stream = U.UploadStream(U.Folder({"path": str(tmp_path)}))
    assert stream.latestOffset() == stream.initialOffset() and stream.partitions(stream.initialOffset(), stream.latestOffset()) == []
