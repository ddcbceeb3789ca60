"""Small text helpers as Column builders. Everything stays inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, as a trim set and as a regex class.
WS = (
    " \t\n\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WS_CLASS = r"[\s\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

_INTEGER = r"^[+-]?[0-9]+\z"
_FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z|^[+-]?(?i:inf|infinity|nan)\z"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(WS))


def non_empty(c: Column) -> Column:
    """``''`` becomes NULL."""
    return F.when(c != "", c)


def to_int(c: Column) -> Column:
    """A strict 32-bit parse: NULL unless the whole text is an integer in range."""
    return F.when(c.rlike(_INTEGER), c.try_cast("int"))


def to_double(c: Column) -> Column:
    return F.when(c.rlike(_FLOAT), c.try_cast("double"))


def contains_any(text: Column, needles) -> Column:
    """Whether one of the needles is in the text; many are looked for in one pass, at characters that
    one of them begins with."""
    needles = list(dict.fromkeys(needles))
    if len(needles) > 2 and all(needle and needle.isascii() for needle in needles):
        heads = "".join(sorted({re.escape(needle[0]) for needle in needles}))
        return text.rlike(f"(?=[{heads}])(?:{'|'.join(map(re.escape, needles))})")
    hit = F.lit(False)
    for needle in needles:
        hit = hit | F.contains(text, F.lit(needle))
    return hit


def rest_from(text: Column, key: str) -> Column:
    """Text behind the first ``key`` (NULL when absent), untrimmed."""
    at = F.locate(key, text)
    return F.when(at > 0, F.substr(text, at + F.lit(len(key))))


def after(text: Column, key: str) -> Column:
    """Trimmed text behind the first ``key``; NULL when absent or blank."""
    return non_empty(strip(rest_from(text, key)))


def number_after(text: Column, key: str) -> Column:
    return to_int(F.regexp_extract(after(text, key), r"^[0-9-]*", 0))


def first_token(text: Column) -> Column:
    return F.regexp_extract(text, rf"^{WS_CLASS}*([^{WS_CLASS[1:-1]}]*)", 1)


def before(text: Column, sep: str) -> Column:
    """Text in front of the first ``sep``, or all of it."""
    return F.substring_index(text, sep, 1)


_PACKAGE = r"[A-Za-z][A-Za-z0-9._]*\.[A-Za-z0-9._]*"


def package_token(text: Column, extra: str = "") -> Column:
    """First package-looking token; tokens end at white space or one of ``, { } / :``."""
    sep = WS_CLASS[:-1] + ",{}/:" + extra + "]"
    return non_empty(F.regexp_extract(text, rf"(?:^|{sep})({_PACKAGE})(?=\z|{sep})", 1))


def literal_map(mapping: dict, key: Column) -> Column:
    """A fixed dictionary as a literal map lookup (NULL for an unknown key)."""
    items: list[Column] = []
    for k, v in mapping.items():
        items += [F.lit(k), F.lit(v)]
    return F.try_element_at(F.create_map(*items), key)
