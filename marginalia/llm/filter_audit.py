"""How five filters interact in every order: contingency counts per part, contracted as tensors.

A document is one cell of a 2x2x2x2x2 table: for each filter, whether it fails. Filters look at the whole text, or at the
whole table, never at what earlier filters left, so the counts of a part answer every order: `np.einsum` contracts the
reshaped counts of a part with a vector per axis, `PASS`, `FAIL` or `ALL`, for every step of the 120 orders at once.

Cells are DataFrame expressions. The filter for repeated texts compares digests (SHA-256): the smallest doc_id of each digest
is aggregated with partial sums on the map side, and documents meet it by (doc_id, digest), so a text with millions of
copies is no join key of many rows. Counts of a part are 32 cells, whatever its size. Only cells reach Python, a row for each part.

Defined cases: a null text is empty; a null doc_id is neither smaller nor larger than another, so such a row never fails E;
rows of one doc_id and one text don't fail E for each other; of several labels of a doc_id any 1 counts; a null part is the
empty string; an empty table has no parts and gives no rows. Columns other than those named are left in the scan.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import record_batch, table, written

FILTERS = "ABCDE"
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)
#: What is counted of the documents in a cell.
MEASURES = ("n", "good", "toxic")
RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failures(text: Column) -> dict[str, Column]:
    """The four conditions that a text alone decides."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    # letters A-Z are one byte each
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": n < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * n,
        "C": 100 * capitals > 5 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, cell (0 to 31; the bit of A is the highest, a set bit fails) and its counts n, good, toxic."""
    text = F.coalesce("text", F.lit(""))
    bits = sum((fails.cast("int") * (16 >> i) for i, fails in enumerate(failures(text).values())), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), bits.alias("bits"), F.sha2(text, 256).alias("digest"))
    rows = written(rows, "audit")
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.max((F.col(c) == 1).cast("int")).alias(t) for c, t in (("quality", "good"), ("toxic", "toxic"))))
    joined = rows.join(first, ["doc_id", "digest"], "left").join(known, "doc_id", "left")
    repeated = F.col("doc_id").isNotNull() & F.col("first").isNull()
    counted = joined.groupBy("part", (F.col("bits") + repeated.cast("int")).alias("cell"))
    return counted.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("good", "toxic")))


def steps() -> tuple[list[str], list[int], list[int], np.ndarray]:
    """(order, step, filter) of every step, and its vector on each axis: PASS before it, FAIL at it, ALL after it."""
    orders, numbers, own, axes = [], [], [], []
    for order in map("".join, permutations(FILTERS)):
        for k, letter in enumerate(order):
            orders.append(order)
            numbers.append(k + 1)
            own.append(FILTERS.index(letter))
            axes.append([PASS if order.index(f) < k else FAIL if f == letter else ALL for f in FILTERS])
    return orders, numbers, own, np.array(axes, np.int64)


def contract(counts: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """counts (measures, 2, 2, 2, 2, 2) and axes (steps, 5, 2) -> (steps, measures)."""
    return np.einsum("mabcde,sa,sb,sc,sd,se->sm", counts, *axes.transpose(1, 0, 2), optimize=True)


def audit_part(counts: np.ndarray, plan) -> dict[str, np.ndarray]:
    """The columns of one part, a value for each step of each order; counts (measures, 2, 2, 2, 2, 2)."""
    orders, _, own, axes = plan
    own = np.array(own)
    removed = contract(counts, axes)
    # after a step its own axis is one to pass, too
    after = axes.copy()
    after[np.arange(len(own)), own] = PASS
    kept = contract(counts[:1], after)[:, 0]
    alone = np.array([[[FAIL if j == i else other for j in range(5)] for i in range(5)] for other in (ALL, PASS)], np.int64)
    failing, only = contract(counts[:1], alone[0])[:, 0], contract(counts[:1], alone[1])[:, 0]
    shapley = np.bincount(own, removed[:, 0], 5).astype(np.int64)
    return {
        "kept": kept, "removed": removed[:, 0], "redundant": failing[own] - removed[:, 0], "unique_fails": only[own],
        "good_lost": removed[:, 1], "toxic_lost": removed[:, 2], "shapley": shapley[own],
    }


def _audit(batches):
    plan = steps()
    orders, numbers = plan[0], plan[1]
    for batch in batches:
        for row in batch.to_pylist():
            counts = np.zeros((len(MEASURES), 32), np.int64)
            for cell in row["cells"]:
                counts[:, cell["cell"]] = [cell[m] for m in MEASURES]
            out = audit_part(counts.reshape(len(MEASURES), 2, 2, 2, 2, 2), plan)
            yield record_batch({
                "part": pa.array([row["part"]] * len(orders)), "filter_order": pa.array(orders), "step": pa.array(numbers, pa.int32()),
                **{name: pa.array(values, pa.int64()) for name, values in out.items()},
            })


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text, source), labels (doc_id, quality, toxic) -> a row for each part, order and step."""
    listed = F.collect_list(F.struct("cell", *MEASURES)).alias("cells")
    return cells(docs, labels).groupBy("part").agg(listed).mapInArrow(_audit, RESULT)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the audit of five filters over all documents, for each source."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
