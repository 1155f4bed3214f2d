"""Personal data: pattern spans, and terms that give the protected values away.

Base kinds (email, ip, card, phone) are found by pattern in whole texts. Beside them, the corpus says which
ordinary terms disclose a protected value: with p from document frequencies over distinct texts,

    IC(c) = log2(N / n(c))                        what there is to know about value c
    PMI(t; c) = log2(N * n(t, c) / (n(t) * n(c))) what term t tells about it

where n(t, c) counts distinct texts in which t stands within `REACH` characters of c. A term is disclosing
for c when n(t, c) >= `SUPPORT` and PMI >= `REMOVE` * IC(c) (removed), or >= `GENERALISE` * IC(c)
(generalised to its shape). Exact copies of a text count once, so copying alone never makes a term disclosing.

Most values stand in one or two texts, so that nothing can be estimated for them alone. c is therefore the value, and
also what values have in common: their group (domain of an address, network of an ip, issuer of a card, area of a
phone) and their kind. A group or kind counts while it tells at least `RARE` bits: what stands in more texts than that is
no secret.

Jobs: one scan finds base spans and contexts and writes both to the shared folder; contexts are aggregated
to (value, term) pairs with map-side combination; document frequencies are counted for the terms of
surviving pairs only, by a broadcast set while it is under `MAX_TERMS` (each task adds up its texts), else by a join on
exploded words, which the same pattern finds, so that the size of the corpus never changes what a term is. A last scan finds base spans again and marks every occurrence of a disclosing term in every text,
however far from a value and whether or not the text holds one: the terms are broadcast while they are
under `MAX_TERMS`, else joined to exploded words.

Defined cases: null and empty texts have no spans; repeated rows (same doc_id) each give a row; a null doc_id
changes nothing; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import id_text, record_batch, table, text_blocks, word_hash, written

#: Characters to either side of a protected value in which terms are looked for.
REACH = 80
#: Distinct texts in which a term must stand beside a value.
SUPPORT = 3
#: Shares of a value's information at which a term is generalised or removed.
GENERALISE, REMOVE = 0.8, 0.95
#: Bits that a group or kind tells at least: it stands in an eighth of the texts at most.
RARE = 3.0
#: Terms up to which their set is broadcast (some 100 bytes each).
MAX_TERMS = 200_000

KINDS = ("email", "ip", "card", "phone")

# A match can only begin where a run of its first class begins or the last match ended, hence \G or a look-behind;
# possessive quantifiers keep long runs linear.
_EMAIL = regex.compile(r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")
_DIGIT = re.compile(r"[0-9]")


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return (odd + even) % 10 == 0


def _small_part(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of base spans, sorted; code points, end exclusive."""
    out = []
    if "@" in text:
        out += [(m.start(), 0, m.end()) for m in _EMAIL.finditer(text)]
    if _DIGIT.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_small_part, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and _luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(out)


def entities(kind: int, value: str) -> list[int]:
    """Hashes of what terms may disclose: the value, its group, its kind. Only that of the value is odd."""
    value = value.lower()
    if kind == 0:
        group = value.rsplit("@", 1)[1]
    elif kind == 1:
        group = value.rsplit(".", 1)[0]
    else:
        digits = "".join(_DIGIT.findall(value))
        group = digits[:6] if kind == 2 else digits[:-7]
    name = KINDS[kind]
    return [word_hash(f"{name}:{value}") | 1, word_hash(f"{name} group:{group}") & ~1, word_hash(f"{name} kind") & ~1]


def _find(batches):
    """(doc_id, text, text_id) -> the entities of a text's values, and for each the terms around it."""
    for part, texts in text_blocks(batches, 8 << 20):
        owned, contexts = [], []
        for text in texts:
            base = base_spans(text)
            near, own = [], set()
            for s, k, e in base:
                values = entities(k, text[s:e])
                own.update(values)
                for begin, end in ((max(0, s - REACH), s), (e, min(len(text), e + REACH))):
                    for m in _TERM.finditer(text, begin, end):
                        a, b = m.span()
                        whole = (a > begin or a == 0 or not text[a - 1].isalpha()) and (b < end or b == len(text) or not text[b].isalpha())
                        if whole and all(b <= x[0] or a >= x[2] for x in base):
                            near += [{"value": v, "term": m[0].lower()} for v in values]
            owned.append(sorted(own))
            contexts.append(near)
        yield record_batch({
            "text_id": part.column(2), "owned": pa.array(owned, pa.list_(pa.int64())),
            "near": pa.array(contexts, pa.list_(pa.struct([("value", pa.int64()), ("term", pa.string())]))),
        })


_FOUND = "text_id long, owned array<bigint>, near array<struct<value:bigint,term:string>>"


def _outside(text: str, base: list[tuple[int, int, int]]):
    """Matches of terms that touch no base span."""
    spans, last = sorted((s, e) for s, _, e in base), 0
    at = 0
    for m in _TERM.finditer(text):
        a, b = m.span()
        while at < len(spans) and spans[at][0] < b:
            last = max(last, spans[at][1])
            at += 1
        if a >= last:
            yield m


_MARKS = "array<struct<start:int,end:int,removed:boolean>>"
_BASE = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, text_id long, marks " + _MARKS


def _mark(shared):
    """(doc_id, text, text_id) -> base results and marks of the terms of shared (term -> removed)."""

    def run(batches):
        removed: dict[str, bool] = shared.value
        for part, texts in text_blocks(batches, 8 << 20):
            counts, digests, spans, marks = [[] for _ in KINDS], [], [], []
            for text in texts:
                base = base_spans(text)
                for k, own in enumerate(counts):
                    own.append(sum(x[1] == k for x in base))
                named = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base)
                digests.append(hashlib.sha256(named.encode()).hexdigest())
                spans.append(named)
                found = []
                if removed and not removed.keys().isdisjoint(map(str.lower, _TERM.findall(text))):
                    found = [{"start": m.start(), "end": m.end(), "removed": removed[t]} for m in _outside(text, base) if (t := m[0].lower()) in removed]
                marks.append(found or None)
            yield record_batch({
                "doc_id": part.column(0), **{f"n_{k}": pa.array(c, pa.int64()) for k, c in zip(KINDS, counts)},
                "base_sha256": pa.array(digests), "base": pa.array(spans), "text_id": part.column(2),
                "marks": pa.array(marks, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("removed", pa.bool_())]))),
            })

    return run


def _words(batches):
    """(doc_id, text, text_id) -> every term of a text that touches no base span, with its place."""
    for part, texts in text_blocks(batches, 1 << 20):
        for i, text in enumerate(texts):
            found = [(m[0].lower(), *m.span()) for m in _outside(text, base_spans(text))]
            if found:
                one = part.slice(i, 1)
                n = len(found)
                term, start, end = zip(*found)
                yield record_batch({
                    "doc_id": pa.array(one.column(0).to_pylist() * n, pa.int64()), "text_id": pa.array(one.column(2).to_pylist() * n, pa.int64()),
                    "term": pa.array(term, pa.string()), "start": pa.array(start, pa.int32()), "end": pa.array(end, pa.int32()),
                })


def _every_term(batches):
    """(doc_id, text, text_id) -> each distinct term of a text."""
    for part, texts in text_blocks(batches, 1 << 20):
        found = [set(map(str.lower, _TERM.findall(text))) for text in texts]
        ids = np.repeat(part.column(2).to_numpy(zero_copy_only=False), [len(x) for x in found])
        yield record_batch({"text_id": pa.array(ids, pa.int64()), "term": pa.array([t for x in found for t in x], pa.string())})


def _held_terms(wanted):
    """(doc_id, text, text_id) -> text_id and the numbers of the wanted terms that the text holds."""

    def run(batches):
        numbers: dict[str, int] = wanted.value
        for part, texts in text_blocks(batches, 8 << 20):
            held = [sorted({numbers[t] for t in map(str.lower, _TERM.findall(text)) if t in numbers}) for text in texts]
            yield record_batch({"text_id": part.column(2), "held": pa.array(held, pa.list_(pa.int32()))})

    return run


def _count_held(n_terms):
    """Rows of held numbers -> for each number how many of the task's rows hold it."""

    def run(batches):
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=n_terms)
        found = np.flatnonzero(total)
        yield record_batch({"i": pa.array(found, pa.int32()), "n": pa.array(total[found], pa.int64())})

    return run


def disclosing_terms(docs: DataFrame, found: DataFrame, max_terms: int = MAX_TERMS) -> DataFrame:
    """term, removed: terms whose information about any value is beyond a threshold. docs: doc_id, text, text_id."""
    spark = docs.sparkSession
    near = found.where(F.size("near") > 0).select("text_id", F.explode("near").alias("x")).select("text_id", "x.value", "x.term")
    pairs = written(
        near.distinct().groupBy("value", "term").agg(F.count("*").alias("n_pair")).where(F.col("n_pair") >= SUPPORT), "pairs"
    )
    terms = pairs.select("term").distinct()
    n_texts = found.select("text_id").distinct().count()
    if (n_terms := terms.count()) <= max_terms:
        names = sorted(r.term for r in terms.collect())
        numbers = spark.sparkContext.broadcast({t: i for i, t in enumerate(names)})
        held = docs.mapInArrow(_held_terms(numbers), "text_id long, held array<int>")
        # one row for a text, however many copies it has, before terms are counted
        counts = held.groupBy("text_id").agg(F.first("held").alias("held")).select("held").mapInArrow(_count_held(len(names)), "i int, n long")
        counts = counts.groupBy("i").agg(F.sum("n").alias("n"))
        n_term = counts.join(spark.createDataFrame(list(enumerate(names)), "i int, term string"), "i")
    else:
        words = docs.mapInArrow(_every_term, "text_id long, term string").join(terms, "term", "left_semi")
        n_term = words.distinct().groupBy("term").agg(F.count("*").alias("n"))
    n_term = n_term.groupBy("term").agg(F.sum("n").alias("n_term"))
    n_value = found.select("text_id", F.explode("owned").alias("value")).groupBy("value").agg(F.count_distinct("text_id").alias("n_value"))
    total = F.lit(float(n_texts))
    know = F.log2(total / F.col("n_value"))
    tells = F.log2(total * F.col("n_pair") / (F.col("n_term") * F.col("n_value")))
    scored = pairs.join(n_term, "term").join(n_value, "value").withColumns({"know": know, "tells": tells})
    enough = (F.col("know") >= RARE) | ((F.col("value") % 2 != 0) & (F.col("know") > 0))
    return scored.where(enough & (F.col("tells") >= GENERALISE * F.col("know"))).select(
        "term", (F.col("tells") >= REMOVE * F.col("know")).alias("removed")
    ).groupBy("term").agg(F.max("removed").alias("removed"))


def find_personal_data(docs: DataFrame, max_terms: int = MAX_TERMS) -> DataFrame:
    """Base results of every document, and marks: array of (start, end, removed) of its disclosing terms."""
    docs = id_text(docs).withColumn("text_id", F.xxhash64("text"))
    found = written(docs.mapInArrow(_find, _FOUND), "pii")
    terms = written(disclosing_terms(docs, found, max_terms), "terms")
    few = terms.count() <= max_terms
    shared = docs.sparkSession.sparkContext.broadcast({r.term: r.removed for r in terms.collect()} if few else {})
    out = docs.mapInArrow(_mark(shared), _BASE)
    if few:
        return out
    # by document and text; repeated rows have the same marks
    words = docs.mapInArrow(_words, "doc_id long, text_id long, term string, start int, end int")
    marks = words.join(terms, "term").groupBy("doc_id", "text_id").agg(F.array_sort(F.collect_set(F.struct("start", "end", "removed"))).alias("marks"))
    marks = marks.withColumnsRenamed({"doc_id": "own_doc", "text_id": "own_text"})
    both = out.drop("marks").join(marks, F.col("doc_id").eqNullSafe(F.col("own_doc")) & (F.col("text_id") == F.col("own_text")), "left")
    return both.drop("own_doc", "own_text")


def _mask(batches):
    for batch in batches:
        texts = []
        for text, base, marks in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
            cuts = [(int(s), int(e), f"[{kind.upper()}]") for kind, s, e in (x.split(":") for x in base.split(",") if x)]
            for m in marks or ():
                shape = "[REMOVED]" if m["removed"] else f"[TERM-{len(text[m['start'] : m['end']])}]"
                cuts.append((m["start"], m["end"], shape))
            out, last = [], 0
            for s, e, to in sorted(cuts, key=lambda c: (c[0], -c[1])):
                if s >= last:
                    out += [text[last:s], to]
                last = max(last, e)
            texts.append("".join([*out, text[last:]]))
        yield record_batch({"doc_id": batch.column(0), "text": pa.array(texts, pa.string())})


def sanitise(docs: DataFrame) -> DataFrame:
    """doc_id and text with protected values replaced by their kind and disclosing terms generalised or removed.

    Rows are matched by doc_id and text, so repeated rows stay as many as they were.
    """
    found = find_personal_data(docs).select("doc_id", "base", "marks", "text_id").dropDuplicates(["doc_id", "text_id"])
    own = id_text(docs).withColumn("text_id", F.xxhash64("text"))
    both = own.join(found, own.doc_id.eqNullSafe(found.doc_id) & (own.text_id == found.text_id), "left")
    return both.select(own.doc_id, own.text, found.base, found.marks).mapInArrow(_mask, "doc_id long, text string")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: counts, the digest of base spans, and all spans of every document."""
    found = find_personal_data(table(spark, sf_dir, "documents"))
    base = F.filter(F.split("base", ","), lambda x: x != "")
    term = F.transform(F.coalesce("marks", F.array()), lambda m: F.concat_ws(":", F.lit("term"), m["start"], m["end"]))
    order = F.array_sort(F.transform(F.concat(base, term), lambda x: F.struct(
        F.split(x, ":")[1].cast("int").alias("start"),
        F.array_position(F.array(*map(F.lit, (*KINDS, "term"))), F.split(x, ":")[0]).alias("kind"), x.alias("span"),
    )))
    return found.select(
        "doc_id", *(f"n_{k}" for k in KINDS), "base_sha256",
        F.when(F.size(F.coalesce("marks", F.array())) == 0, F.col("base")).otherwise(F.array_join(F.transform(order, lambda x: x["span"]), ",")).alias("spans"),
    )
