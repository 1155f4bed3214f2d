"""Text rules that all operators share. Lengths and cuts are in UTF-8 bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SPACE_RE = r"(?U)\s+"
TRIM_RE = r"(?U)^\s+|\s+$"
TOKEN_RE = r"[ \n]*[^ \n]+(?:[ \n]+[^ \n]+){2}|(?s:.+)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fields(s: Column | str) -> Column:
    """Words between any Unicode white space, without empty ones."""
    return F.filter(F.split(col(s), SPACE_RE), lambda w: w != "")


def trim_space(s: Column | str) -> Column:
    return F.regexp_replace(col(s), TRIM_RE, "")


def byte_prefix(s: Column | str, n: int) -> Column:
    """The first n bytes, without a character that the cut would break."""
    s = col(s)
    head = F.make_valid_utf8(F.substring(F.encode(s, "UTF-8"), 1, n).cast("string"))
    return F.when(F.octet_length(s) > n, F.regexp_replace(head, "�$", "")).otherwise(s)


def cut(s: Column | str, n: int, suffix: str) -> Column:
    """s, or where it is longer than n bytes its prefix and a suffix."""
    s = col(s)
    return F.when(F.octet_length(s) > n, F.concat(byte_prefix(s, n), F.lit(suffix))).otherwise(s)


def ordered_join(order: str, value: Column | str, separator: str = "") -> Column:
    """Aggregate: values of a group in the order of a column, joined."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), col(value).alias("v"))))
    return F.array_join(F.transform(pairs, lambda x: x["v"]), separator)
