"""Secret scans: pattern spans, and encoded material confirmed by its structure.

Base kinds (assign, access, hex) are found by pattern. Beside them, candidates of base64, base64url or hex, broken over
lines or not, are decoded at each alignment, and reported only when what they decode to proves what it is:

* der: an ASN.1 SEQUENCE whose nested lengths fill it exactly and that is a private key: a version and at least
  two more INTEGERs; a version, an algorithm and an OCTET STRING whose content is an ASN.1 element that fills it
  exactly; or a version and an OCTET STRING of 16 to 72 bytes;
* openssh: the openssh-key-v1 magic followed by length-prefixed fields that stay within the bytes;
* token: three dot-joined base64url parts whose first decodes to a JSON object that names an `alg`;
* pem: a PRIVATE KEY block whose body decodes to either of the first two, to an encrypted key (an algorithm and an
  OCTET STRING), or, under Proc-Type and DEK-Info lines, to whole blocks of the cipher.

A key or header may begin within a run, behind other characters, but ends where the run or one of its lines ends. All work is linear in the text: a run is decoded once
at each of its alignments, and the beginnings of structures are looked for in what it decodes to.

Each row is scanned by itself, without a shuffle. Defined cases: null and empty texts have no spans;
repeated rows each give a row; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import id_text, record_batch, table, text_blocks

KINDS = ("assign", "access", "hex")
MORE = ("der", "openssh", "token", "pem")

_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_NEEDS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{32,}+(?:\r?\n[ \t]*+[A-Za-z0-9+/_-]++)*+")
_DOTTED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]*+){2,}+")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----((?:\s*[A-Za-z0-9-]{1,40}:[^\n]*\n)*)([A-Za-z0-9+/=\s]+)-----END \1-----")
_CIPHER = re.compile(r"DEK-Info:\s*([A-Z0-9-]+),[0-9A-Fa-f]+")
_HEX_RUN = re.compile(r"[0-9a-fA-F]{64,}+(?:\r?\n[ \t]*+[0-9a-fA-F]++)*+")
#: What a private key begins with: a SEQUENCE and its length, then a version of 0 to 2.
_KEY_HEAD = re.compile(rb"\x30(?:[\x00-\x7f]|\x81[\x80-\xff]|\x82[\x01-\xff][\x00-\xff]|\x83[\x01-\xff][\x00-\xff]{2})\x02\x01[\x00-\x02]")
_MAGIC = b"openssh-key-v1\0"
_URL = str.maketrans("-_", "+/")


def _header(data: bytes, at: int) -> tuple[int, int, int] | None:
    """(tag, start of content, end) of the ASN.1 element at `at`; None where it isn't one."""
    if at + 2 > len(data):
        return None
    size, begin = data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or begin + n > len(data):
            return None
        size, begin = int.from_bytes(data[begin : begin + n]), begin + n
        if size < 0x80 or n > 1 and size < 1 << 8 * (n - 1):  # not the shortest form
            return None
    return (data[at], begin, begin + size) if begin + size <= len(data) else None


def _elements(data: bytes, begin: int, end: int) -> list[tuple[int, int, int]] | None:
    """The ASN.1 elements (tag, start of content, end) that fill begin to end exactly; None where they don't."""
    out, at = [], begin
    while at < end:
        one = _header(data, at)
        if not one or one[2] > end:
            return None
        out.append(one)
        at = one[2]
    return out


def _algorithm(data: bytes, element: tuple[int, int, int]) -> bool:
    """Whether a SEQUENCE opens with an OBJECT IDENTIFIER."""
    inner = element[0] == 0x30 and _elements(data, *element[1:])
    return bool(inner) and inner[0][0] == 0x06


def der_key(data: bytes, at: int = 0) -> int | None:
    """Where the private key that begins at `at` ends; None where none does."""
    top = _header(data, at)
    inner = _elements(data, *top[1:]) if top and top[0] == 0x30 else None
    if not inner or len(inner) < 2 or inner[0][0] != 0x02 or inner[0][2] - inner[0][1] != 1 or data[inner[0][1]] > 2:
        return None
    tags, second = [x[0] for x in inner], inner[1]
    if tags[1] == 0x02:
        proven = len(tags) >= 3 and all(t == 0x02 for t in tags[:-1]) and tags[-1] in (0x02, 0x30)
    elif tags[1] == 0x30:
        proven = len(tags) >= 3 and tags[2] == 0x04 and _algorithm(data, second)
        key = _elements(data, *inner[2][1:]) if proven else None
        proven = bool(key) and len(key) == 1 and key[0][0] in (0x02, 0x04, 0x30) and (key[0][0] != 0x30 or bool(_elements(data, *key[0][1:])))
    else:
        proven = tags[1] == 0x04 and 16 <= second[2] - second[1] <= 72 and set(tags[2:]) <= {0xA0, 0xA1}
    return top[2] if proven else None


def encrypted_key(data: bytes) -> bool:
    top = _header(data, 0)
    inner = _elements(data, *top[1:]) if top and top[0] == 0x30 and top[2] == len(data) else None
    return bool(inner) and [x[0] for x in inner] == [0x30, 0x04] and _algorithm(data, inner[0])


def openssh_key(data: bytes, begin: int = 0) -> int | None:
    """Where an openssh key that begins at `begin` ends, which is with the data; None where none does."""
    if not data.startswith(_MAGIC, begin):
        return None
    at = begin + len(_MAGIC)
    for _ in range(3):  # cipher, key derivation, its options
        at += 4 + int.from_bytes(data[at : at + 4]) if at + 4 <= len(data) else len(data)
        if at > len(data):
            return None
    return len(data) if at + 4 <= len(data) and 1 <= int.from_bytes(data[at : at + 4]) <= 64 else None


def _keys(data: bytes):
    """(start, end, kind) of private keys in some bytes, leftmost first."""
    found = [(m.start(), end, "der") for m in _KEY_HEAD.finditer(data) if (end := der_key(data, m.start()))]
    at = data.find(_MAGIC)
    while at >= 0:
        if end := openssh_key(data, at):
            found.append((at, end, "openssh"))
        at = data.find(_MAGIC, at + 1)
    return found


def _base64(run: str) -> bytes:
    """Bytes of as many characters as make whole groups, and of what is left."""
    run = run[: len(run) - (len(run) % 4 == 1)]
    return base64.b64decode(run + "=" * (-len(run) % 4))


def _runs(text: str):
    """(start, end, kind) of keys in base64 or hex."""
    for pattern, shifts, bits in ((_RUN, 4, 6), (_HEX_RUN, 2, 4)):
        for m in pattern.finditer(text):
            run = m[0] if "\n" not in m[0] else "".join(m[0].split())
            plain = run.translate(_URL) if bits == 6 else run
            for shift in range(shifts):
                part = plain[shift:]
                data = _base64(part) if bits == 6 else bytes.fromhex(part[: len(part) // 2 * 2])
                for s, e, kind in _keys(data):
                    first, last = shift + s * 8 // bits, min(shift - (-e * 8 // bits), len(run)) - 1
                    if len(run) < len(m[0]):  # places in the run without its line breaks
                        places = [i for i, c in enumerate(m[0]) if not c.isspace()]
                        first, last = places[first], places[last]
                    end = m.start() + last + 1
                    if end < len(text) and (text[end].isalnum() or text[end] in "+/_-"):
                        continue  # more than the key
                    while bits == 6 and end < len(text) and text[end] == "=":
                        end += 1
                    yield m.start() + first, end, kind


def _marks_backwards(said: str, block: int = 1 << 16):
    for end in range(len(said), 0, -block):
        yield from reversed([m.start() for m in _MARKS.finditer(said, max(0, end - block), end)])


def _opening(said: str) -> int:
    """Where the object begins that the last character closes; -1 where it closes none.

    Backwards from there, quotes that aren't escaped open and close strings, in which braces don't count.
    """
    depth, quoted = 0, False
    for at in _marks_backwards(said):
        mark = said[at]
        if mark == '"':
            before = at
            while before and said[before - 1] == "\\":
                before -= 1
            quoted ^= (at - before) % 2 == 0
        elif not quoted:
            depth += 1 if mark == "}" else -1
            if depth == 0:
                return at
    return -1


def _token_head(part: str) -> int | None:
    """Where in a part the JSON object in base64url begins that ends with the part and names an `alg`; of several alignments the first."""
    best = None
    if len(part) < _SHORTEST:
        return best
    for shift in range(4):
        at = part.find("eyJ")
        while at >= 0 and at % 4 != shift:
            at = part.find("eyJ", at + 1)
        if at < 0 or (len(part) - at) % 4 == 1:
            continue
        said = _base64(part[at:].translate(_URL)).decode("latin-1")
        begin = _opening(said) if said.endswith("}") else -1
        if begin < 0 or begin % 3 or not said.startswith('{"', begin):
            continue
        try:
            found = json.loads(said[begin:])
        except (ValueError, RecursionError):
            continue
        if isinstance(found.get("alg"), str):
            place = at + begin // 3 * 4
            best = place if best is None else min(best, place)
    return best


_MARKS = re.compile(r'["{}]')
#: Characters of base64url of the shortest object with an `alg`.
_SHORTEST = len('{"alg":""}') * 4 // 3 + 1


def _tokens(text: str):
    """(start, end) of signed tokens."""
    for m in _DOTTED.finditer(text):
        parts, at, k = m[0].split("."), m.start(), 0
        while k + 2 < len(parts):
            head = _token_head(parts[k]) if parts[k + 1] and "eyJ" in parts[k] else None
            whole = sum(len(x) + 1 for x in parts[k : k + 3])
            if head is not None:
                yield at + head, at + whole - 1
            taken = 1 if head is None else 3
            at += sum(len(x) + 1 for x in parts[k : k + taken])
            k += taken


def _pem_proven(label: str, lines: str, body: str) -> bool:
    try:
        data = base64.b64decode("".join(body.split()), validate=True)
    except binascii.Error:
        return False
    if "ENCRYPTED" in lines:
        cipher = _CIPHER.search(lines)
        return bool(cipher) and len(data) > 0 and len(data) % (16 if "AES" in cipher[1] or "CAMELLIA" in cipher[1] else 8) == 0
    return der_key(data) == len(data) or openssh_key(data) is not None or label.startswith("ENCRYPTED") and encrypted_key(data)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of base spans, sorted; code points, end exclusive."""
    out = []
    low = text.lower()
    if any(x in low for x in _NEEDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number from 3, end) of structurally confirmed candidates, sorted."""
    out = []
    if "PRIVATE KEY" in text:
        out += [(m.start(), 6, m.end()) for m in _PEM.finditer(text) if _pem_proven(m[1], m[2], m[3])]
    if "eyJ" in text:
        out += [(s, 5, e) for s, e in _tokens(text)]
    blocks, last = sorted((s, e) for s, _, e in out), 0
    for s, e, kind in sorted(_runs(text), key=lambda x: (x[0], -x[1])):
        at = bisect_right(blocks, (s, len(text))) - 1
        if e > last and not (at >= 0 and e <= blocks[at][1]):  # not within another key, token or block
            out.append((s, 3 + MORE.index(kind), e))
            last = e
    return sorted(out)


def _name(spans) -> str:
    return ",".join(f"{(KINDS + MORE)[k]}:{s}:{e}" for s, k, e in spans)


def _find(batches):
    for part, texts in text_blocks(batches, 8 << 20):
        base = [base_spans(t) for t in texts]
        yield record_batch({
            "doc_id": part.column(0), **{f"n_{kind}": pa.array([sum(x[1] == k for x in b) for b in base], pa.int64()) for k, kind in enumerate(KINDS)},
            "base_sha256": pa.array([hashlib.sha256(_name(b).encode()).hexdigest() for b in base], pa.string()),
            "spans": pa.array([_name(sorted([*b, *confirmed_spans(t)])) for b, t in zip(base, texts)], pa.string()),
        })


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and all spans of every document."""
    return id_text(docs).mapInArrow(
        _find, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )


def _redact(mask: str):
    def run(batches):
        for part, texts in text_blocks(batches, 8 << 20):
            for row, text in enumerate(texts):
                if found := sorted([*base_spans(text), *confirmed_spans(text)], key=lambda x: (x[0], -x[2])):
                    out, last = [], 0
                    for s, _, e in found:
                        if s >= last:
                            out += [text[last:s], mask]
                        last = max(last, e)
                    texts[row] = "".join([*out, text[last:]])
            yield record_batch({"key": part.column(0), "text": pa.array(texts, pa.string()), **{n: part.column(i) for i, n in enumerate(part.schema.names) if i > 1}})

    return run


def redact_secrets(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs, all columns and rows, with every found span of the text replaced. A null text becomes empty."""
    rest = [c for c in docs.columns if c != text_col]
    whole = docs.select(F.lit(0).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct(*(F.col(f"`{c}`") for c in rest)).alias("rest"))
    out = whole.mapInArrow(_redact(mask), whole.schema)
    return out.select(*(F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`") for c in docs.columns))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: counts, the digest of base spans, and all spans of every document."""
    return find_secrets(table(spark, sf_dir, "documents"))
