"""MinHash near-duplicates: circulant signatures, banding, exact Jaccard verification.

A document's set holds its distinct `n`-word shingles as 64-bit hashes. Two permutations make all coordinates of
a signature: sigma spreads shingles over a circle of 2^32 places, pi orders the circle, and coordinate k is the
least pi(place + k): the second permutation, shifted round the circle by k. BANDS bands of ROWS coordinates put a
document into BANDS buckets; at a similarity of 0.8 a pair shares none with a probability of 5e-8.

1. One scan gives each document its set size, a 128-bit fingerprint of the set, and its buckets.
2. Documents of equal sets are one class, represented by the smallest doc_id (aggregated before any join).
3. In each bucket every representative is tied to the smallest (no pairs within a bucket); components of these
   ties are clusters: any two documents that share a bucket are in one cluster.
4. A cluster of at most CELL_DOCS documents is verified in one cell: components under the exact condition
   100 * intersection >= SIMILARITY * union are found breadth first. A document is compared with all those that no
   link has reached, on full sets, so near copies cost one comparison each and no pair is written out.
   In a larger cluster all members are compared with PIVOTS of them; those linked to the first, directly or by way of
   other pivots, are settled. What is left is
   verified bucket by bucket, as only documents that share a bucket are candidates, however long the chains of buckets
   are that make a cluster: each bucket with an unsettled document is a cell (once for buckets of the same members).
   A bucket beyond a cell is split against its own pivots: those linked to them are its main part, in blocks; the rest,
   in blocks as well, meets each main block and each other block in a cell. So no link is lost, comparisons are
   those of the buckets, and a cluster of near copies, however large, costs in proportion to its size.
5. Components of the verified links, by joins, and back to all documents.

Cells carry texts, not sets: a text compresses to about half the bytes of its 64-bit shingles.

Defined cases: a document without words is linked with nothing; fewer than `n` words are one shingle; rows that
share a doc_id are one node, each with its own size; a null doc_id is linked with nothing, has a null component
and is kept; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import HashCache, give_back, id_text, lower_words, record_batch, table, text_blocks, without, written
from marginalia.llm.components import connected_components

SIMILARITY = 80
BANDS, ROWS = 32, 4
#: Documents and shingles of a block of a bucket; a cell holds two blocks at most.
BLOCK_DOCS, BLOCK_SHINGLES = 2_000, 1_500_000
#: Documents and shingles of a cluster that is verified in one cell, whoever shares a bucket.
CELL_DOCS, CELL_SHINGLES = 256, 400_000
#: Pivots of a cluster, and the members that are compared with them in one group.
PIVOTS, GROUP_DOCS = 16, 256
#: Members of clusters up to which their ids are broadcast to the scan of texts.
BROADCAST_ROWS = 500_000

#: A text with a word.
WORDY = r"[^\x20\x09-\x0D]"

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of a text; words: hashes, as unsigned 64-bit."""
    if not len(words):
        return words
    size = min(n, len(words))
    h = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        h = _mix(h * _PRIME + words[k : k + len(h)])
    return np.unique(h)


def _sets(texts: list[str], cache: HashCache, n: int) -> list[np.ndarray]:
    out = []
    for text in texts:
        own = lower_words(text)
        out.append(shingles(np.fromiter(map(cache.__getitem__, own), np.int64, len(own)).view(np.uint64), n))
    return out


def signatures(sets: list[np.ndarray], size: int = BANDS * ROWS) -> np.ndarray:
    """A row of `size` coordinates for each set; sets must not be empty."""
    out = np.empty((len(sets), size), np.uint32)
    begin = 0
    while begin < len(sets):
        end, total = begin + 1, len(sets[begin])
        while end < len(sets) and total + len(sets[end]) <= 65_536:
            total += len(sets[end])
            end += 1
        place = _mix(np.concatenate(sets[begin:end])).astype(np.uint32)  # sigma
        starts = np.concatenate(([0], np.cumsum([len(x) for x in sets[begin : end - 1]]))).astype(np.int64)
        x, y = np.empty_like(place), np.empty_like(place)
        for k in range(size):
            np.add(place, np.uint32(k), out=x)  # the shift
            np.right_shift(x, 16, out=y)  # pi, from here on
            x ^= y
            x *= np.uint32(0x85EBCA6B)
            np.right_shift(x, 13, out=y)
            x ^= y
            x *= np.uint32(0xC2B2AE35)
            np.right_shift(x, 16, out=y)
            x ^= y
            out[begin:end, k] = np.minimum.reduceat(x, starts)
        begin = end
    return out


def buckets(signature: np.ndarray) -> np.ndarray:
    """A 64-bit bucket for each band of each row; bands never share a bucket."""
    rows = signature.reshape(len(signature), -1, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, rows.shape[1] + 1, dtype=np.uint64), rows.shape[:2])
    for k in range(ROWS):
        h = _mix(h * _PRIME + rows[:, :, k])
    return h.view(np.int64)


def _scan(n: int):
    def run(batches):
        cache = HashCache()
        for part, texts in text_blocks(batches, 8 << 20):
            sets = _sets(texts, cache, n)
            full = [i for i, x in enumerate(sets) if len(x)]
            keys: list = [None] * len(sets)
            for i, row in zip(full, buckets(signatures([sets[i] for i in full])) if full else ()):
                keys[i] = row
            yield record_batch({
                "doc_id": part.column(0), "n": pa.array([len(x) for x in sets], pa.int64()),
                "f1": pa.array([int(_mix(x).sum(dtype=np.uint64).view(np.int64)) for x in sets], pa.int64()),
                "f2": pa.array([int(_mix(x ^ _PRIME).sum(dtype=np.uint64).view(np.int64)) for x in sets], pa.int64()),
                "buckets": pa.array(keys, pa.list_(pa.int64())),
            })

    return run


def _links(sets: list[np.ndarray], reached: np.ndarray, similarity: int) -> np.ndarray:
    """For each set the number of the first set of its component; those reached count as linked with one another."""
    root = np.arange(len(sets))
    if not len(sets):
        return root
    sizes = np.array([len(x) for x in sets], np.int64)
    tokens = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    held = np.zeros(int(tokens.max(initial=0)) + 1, np.int32)
    first = np.flatnonzero(reached)
    root[first] = first[0] if len(first) else 0
    open_ = np.flatnonzero(~reached & (sizes > 0))
    starts = np.zeros(0, np.int64)
    flat = owners = starts

    def gather():
        own = [tokens[ends[i] - sizes[i] : ends[i]] for i in open_]
        return (np.concatenate(own) if own else tokens[:0]), open_.copy(), np.cumsum(sizes[open_]) - sizes[open_]

    flat, owners, starts = gather()
    left = np.zeros(len(sets), bool)
    left[open_] = True
    n_left = len(open_)
    frontier = first.tolist()
    while n_left:
        if not frontier:
            seed = int(np.argmax(left))
            left[seed], n_left, frontier = False, n_left - 1, [seed]
            continue
        i = frontier.pop()
        if n_left * 2 < len(owners):
            open_ = np.flatnonzero(left)
            flat, owners, starts = gather()
        mine = tokens[ends[i] - sizes[i] : ends[i]]
        held[mine] = 1
        common = np.add.reduceat(held[flat], starts)
        held[mine] = 0
        hit = owners[(100 * common >= similarity * (sizes[i] + sizes[owners] - common)) & left[owners]]
        left[hit] = False
        n_left -= len(hit)
        root[hit] = root[i]
        frontier += hit.tolist()
    return root


def _verify(n: int, similarity: int):
    """A cell (doc_id, text, main) -> a link from each document to the first of its component."""

    def run(cell: pa.Table) -> pa.Table:
        if cell.num_rows > 500:
            give_back()
        cell = cell.sort_by("doc_id")
        ids = cell["doc_id"].to_numpy()
        root = _links(_sets(cell["text"].to_pylist(), HashCache(), n), cell["main"].to_numpy(), similarity)
        linked = root != np.arange(len(root))
        return pa.table({"a": pa.array(ids[linked], pa.int64()), "b": pa.array(ids[root[linked]], pa.int64())})

    return run


def _common(flat: np.ndarray, starts: np.ndarray, own: np.ndarray) -> np.ndarray:
    """How many members of each set (one after the other in flat) are in a sorted set."""
    at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
    return np.add.reduceat((own[at] == flat).astype(np.int64), starts)


def _with_pivots(n: int, similarity: int):
    """(some members of a cluster, its pivots) -> main: linked to the first pivot, maybe by way of others; link: the pivot it is
    linked with."""

    def run(rows: pa.Table, pivots: pa.Table) -> pa.Table:
        cache = HashCache()
        pivots = pivots.sort_by("place")
        heads, sets = pivots["pivot"].to_pylist(), _sets(pivots["pivot_text"].to_pylist(), cache, n)
        own = _sets(rows["text"].to_pylist(), cache, n)
        every = own + sets  # none is empty: empty sets have no bucket
        sizes = np.array([len(x) for x in every], np.int64)
        flat, starts = np.concatenate(every), np.cumsum(sizes) - sizes
        linked = np.array([100 * (c := _common(flat, starts, x)) >= similarity * (sizes + len(x) - c) for x in sets])
        tied = linked[:, len(own) :]  # among pivots
        reach, more = np.arange(len(sets)) == 0, True
        parent = np.zeros(len(sets), np.int64)
        while more:
            new = tied[reach].any(0) & ~reach
            parent[new] = np.flatnonzero(reach)[tied[reach][:, new].argmax(0)] if new.any() else 0
            reach, more = reach | new, bool(new.any())
        order = np.argsort(~reach, kind="stable")  # those that settle a member first
        hit = linked[order][:, : len(own)]
        first = order[hit.argmax(0)] if len(own) else order[:0]
        some, ids = hit.any(0), rows["doc_id"].to_pylist()
        numbers = {d: i for i, d in enumerate(heads)}
        link = []
        for d, f, ok in zip(ids, first.tolist(), some.tolist()):
            i = numbers.get(d)
            link.append(heads[parent[i]] if i is not None and reach[i] else heads[f] if ok else None)
        return rows.append_column("main", pa.array(some & reach[first], pa.bool_())).append_column("link", pa.array(link, pa.int64()))

    return run


def _blocks(docs_total, shingles_total, block_docs: int, block_shingles: int):
    return F.greatest(F.ceil(docs_total / block_docs), F.ceil(shingles_total / block_shingles)).cast("int")


def _few(rows: DataFrame) -> DataFrame:
    """rows, to be broadcast while there are few (some 40 bytes each); else both sides of a join are shuffled."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _split(rows: DataFrame, n: int, similarity: int) -> DataFrame:
    """rows of (doc_id, text, n, cluster) with main, settled by the pivots of their cluster, and link, a document that they are linked with."""
    # of each of PIVOTS parts of a cluster the least hash
    place = F.pmod(F.xxhash64("doc_id"), F.lit(PIVOTS)).cast("int")
    totals = rows.groupBy("cluster").agg(F.ceil(F.count("*") / GROUP_DOCS).cast("int").alias("groups"))
    pivots = rows.withColumn("place", place).groupBy("cluster", "place").agg(F.min(F.struct(F.xxhash64("doc_id", F.lit(5)), "doc_id")).alias("x"))
    pivots = _few(pivots.select("cluster", "place", F.col("x.doc_id").alias("doc_id")))
    heads = rows.select("doc_id", "cluster", F.col("text").alias("pivot_text")).join(pivots, ["cluster", "doc_id"]).dropDuplicates(["cluster", "place"])
    heads = heads.withColumnRenamed("doc_id", "pivot").join(_few(totals), "cluster").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    dealt = rows.join(_few(totals), "cluster").withColumn("group", F.pmod(F.xxhash64("doc_id"), F.col("groups")).cast("int"))
    own = dealt.select("doc_id", "text", "n", "cluster", "group").groupBy("cluster", "group")
    met = own.cogroup(heads.select(F.col("cluster").alias("of"), F.col("group").alias("part"), "place", "pivot", "pivot_text").groupBy("of", "part"))
    schema = "doc_id long, text string, n long, cluster long, group int, main boolean, link long"
    return written(met.applyInArrow(_with_pivots(n, similarity), schema).drop("group"), "parted")


def _links_of(parted: DataFrame) -> DataFrame:
    return parted.where("link is not null and link != doc_id").select(F.col("doc_id").alias("a"), F.col("link").alias("b"))


def bucket_members(dealt: DataFrame, settled: DataFrame) -> DataFrame:
    """doc_id, n, main, cluster (the bucket) of the buckets that hold a document that isn't settled; of buckets of equal
    members only one. dealt: rep, bucket, of buckets of more than one; settled: doc_id, n, main of some documents, once each."""
    left = settled.where("not main").select(F.col("doc_id").alias("rep"))
    open_ = written(dealt.join(_few(left), "rep").select("bucket").distinct(), "open")
    rows = dealt.join(_few(open_), "bucket").join(_few(settled), F.col("rep") == F.col("doc_id"))
    rows = written(rows.select("doc_id", "n", "main", "bucket").distinct(), "open")
    whole = [F.bit_xor(F.xxhash64("doc_id", F.lit(k))) for k in (1, 2)]
    per = rows.groupBy("bucket").agg(F.count("*").alias("docs"), whole[0].alias("x"), whole[1].alias("y"))
    chosen = per.where("docs > 1").groupBy("docs", "x", "y").agg(F.min("bucket").alias("bucket"))
    return rows.join(_few(chosen.select("bucket")), "bucket").select("doc_id", "n", "main", F.col("bucket").alias("cluster"))


def _in_cells(rows: DataFrame, n: int, similarity: int, block_docs: int, block_shingles: int) -> DataFrame:
    """a, b: links among the rows (doc_id, text, n, cluster) of clusters beyond a cell, which join up their components."""
    schema, verify = "a long, b long", _verify(n, similarity)
    parted = _split(rows, n, similarity)
    per = parted.groupBy("cluster").agg(
        _blocks(F.sum(F.col("main").cast("long")), F.sum(F.when(F.col("main"), F.col("n")).otherwise(0)), block_docs, block_shingles).alias("mains"),
        _blocks(F.sum((~F.col("main")).cast("long")), F.sum(F.when(F.col("main"), 0).otherwise(F.col("n"))), block_docs, block_shingles).alias("rests"),
    )
    rows = parted.join(_few(per), "cluster").withColumn("own", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.when(F.col("main"), F.col("mains")).otherwise(F.col("rests"))).cast("int"))
    none = F.array().cast("array<struct<x:int,y:int>>")

    def cells(count, cell):
        return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), cell)).otherwise(none)

    def cell(x, y):
        return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))

    own = F.col("own")
    with_rests = cells(F.col("rests"), lambda j: cell(own, j))
    with_mains = cells(F.col("mains"), lambda j: cell(j, own))
    among_rests = cells(F.col("rests"), lambda j: cell(-1 - F.least(own, j), F.greatest(own, j)))
    dealt = rows.withColumn("at", F.explode(F.when(F.col("main"), with_rests).otherwise(F.concat(with_mains, among_rests))))
    met = dealt.select("doc_id", "text", "main", "cluster", "at.x", "at.y").groupBy("cluster", "x", "y").applyInArrow(verify_cell(verify), schema)
    return met.union(_links_of(parted))


def verified_links(
    docs: DataFrame, members: DataFrame, dealt: DataFrame, n: int, similarity: int,
    block_docs: int = BLOCK_DOCS, block_shingles: int = BLOCK_SHINGLES, cell_docs: int = CELL_DOCS,
) -> DataFrame:
    """a, b: links that join up exactly the components of members (doc_id, n, cluster) under the exact condition.

    dealt: rep, bucket of all members, of buckets that more than one is in."""
    sizes = members.groupBy("cluster").agg(F.count("*").alias("docs_total"), F.sum("n").alias("shingles_total")).where("docs_total > 1")
    one = (F.col("docs_total") <= min(cell_docs, 2 * block_docs)) & (F.col("shingles_total") <= min(CELL_SHINGLES, 2 * block_shingles))
    wanted = written(members.join(_few(sizes.select("cluster", one.alias("one"))), "cluster"), "wanted")
    texts = written(docs.join(_few(wanted), "doc_id").select("doc_id", "text", "n", "cluster", "one"), "texts")
    schema, verify = "a long, b long", _verify(n, similarity)
    links = texts.where("one").select("doc_id", "text", "cluster", F.lit(False).alias("main")).groupBy("cluster").applyInArrow(verify_cell(verify), schema)
    large = texts.where("not one").drop("one")
    if large.isEmpty():
        return links
    parted = _split(large, n, similarity)
    settled = parted.groupBy("doc_id").agg(F.max("n").alias("n"), F.bool_or("main").alias("main"))
    settled = written(settled, "settled")
    buckets = written(bucket_members(dealt, settled), "buckets")
    blocks = _blocks(F.count("*"), F.sum("n"), block_docs, block_shingles).alias("blocks")
    buckets = written(buckets.join(_few(buckets.groupBy("cluster").agg(blocks)), "cluster"), "buckets")
    own = written(large.select("doc_id", "text").join(_few(buckets), "doc_id"), "own")
    near = own.where("blocks <= 2").select("doc_id", "text", "cluster", "main").groupBy("cluster").applyInArrow(verify_cell(verify), schema)
    links = links.union(_links_of(parted)).union(near)
    larger = own.where("blocks > 2").select("doc_id", "text", "n", "cluster")
    return links if larger.isEmpty() else links.union(_in_cells(larger, n, similarity, block_docs, block_shingles))


def verify_cell(verify):
    """For applyInArrow, which passes the group's table."""
    return lambda cell: verify(cell.select(["doc_id", "text", "main"]))


def near_duplicates(docs: DataFrame, n: int = 5, similarity: int = SIMILARITY, **blocks) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept (doc_id = component_id)."""
    docs = id_text(docs)
    scanned = written(docs.mapInArrow(_scan(n), "doc_id long, n long, f1 long, f2 long, buckets array<long>"), "signatures")
    known = scanned.where("doc_id is not null and n > 0")
    classes = written(known.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"), F.first("buckets").alias("buckets")), "classes")
    dealt = classes.select("rep", F.explode("buckets").alias("bucket"))
    hubs = dealt.groupBy("bucket").agg(F.min("rep").alias("hub"), F.count("*").alias("docs")).where("docs > 1").select("bucket", "hub")
    shared = written(dealt.join(hubs, "bucket").select("rep", "bucket", "hub"), "shared")
    ties = shared.where("rep != hub").select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    clusters = connected_components(ties)
    members = written(classes.join(clusters, classes.rep == clusters.node).groupBy("rep", "component").agg(F.max("n").alias("n")).select(F.col("rep").alias("doc_id"), "n", F.col("component").alias("cluster")), "members")
    tied = written(known.join(classes, ["f1", "f2", "n"]).select("doc_id", "rep").distinct(), "tied")
    # rows of one doc_id are one node: what represents their sets is linked, too
    first = tied.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("last")).where("b < last").select("doc_id", "b")
    same = tied.join(first, "doc_id").select(F.col("rep").alias("a"), "b")
    linked = connected_components(verified_links(docs.where(F.col("doc_id").isNotNull() & F.col("text").rlike(WORDY)), members, shared.select("rep", "bucket"), n, similarity, **blocks).union(same))
    own = tied.join(linked, tied.rep == linked.node, "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    own = own.groupBy("doc_id").agg(F.min("component").alias("component"))
    out = scanned.select("doc_id", F.col("n").alias("n_shingles")).join(own, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, n: int = 5, similarity: int = SIMILARITY) -> DataFrame:
    """The rows of docs, all columns, whose doc_id is the smallest of its component; rows without a doc_id stay."""
    return without(docs, near_duplicates(docs, n, similarity).where(~F.col("kept")).select(F.col("doc_id").alias("lost_id")))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: 4-word shingles, components of all links of similarity 0.8 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), n=4)
