"""Text keys: order by UTF-16 units, and search keys of folded text. All but the Unicode fold are Spark expressions."""

from __future__ import annotations

from functools import cache

import pandas as pd
from pyspark.sql import Column as C
from pyspark.sql import functions as F

from quern.errors import refuse
from quern.model import Collation

ASCII_FOLD, UNICODE_FOLD, UTF16 = "ascii-fold/1", "unicode-simple-upper/16.0", "utf16-hex/1"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def utf16_order(c: C) -> C:
    """A binary that orders as UTF-16 units do; Spark's own order is that of UTF-8 bytes."""
    return F.encode(c, "UTF-16BE")


def utf16_key(c: C) -> C:
    """Four hexadecimal digits for each UTF-16 unit."""
    return F.hex(utf16_order(c))


def ascii_key(c: C) -> C:
    """A-Z as a-z; text outside U+0020 to U+007E is refused at run time."""
    plain = c.rlike(r"^[\x20-\x7E]*$")
    return F.when(plain | c.isNull(), F.translate(c, _UPPER, _LOWER)).otherwise(F.raise_error(F.concat(F.lit("QN-KEY-001: not printable ASCII: "), c)))


@cache
def simple_upper() -> dict[int, int]:
    """Simple upper-case pairs of Unicode 16.0.

    Made by rule: every character whose upper case is one other character, without two that fold
    into ASCII letters. Fixed values: the pairs below, which the standard has as simple pairs though
    their full upper case is longer, or which are newer than this Python's tables.
    """
    pairs = {i: ord(chr(i).upper()) for i in range(0x110000) if not 0xD800 <= i <= 0xDFFF and len(chr(i).upper()) == 1 and chr(i).upper() != chr(i)}
    for i in (0x131, 0x17F):
        pairs.pop(i, None)
    for start in (0x1F80, 0x1F90, 0x1FA0):
        pairs |= {i: i + 8 for i in range(start, start + 8)}
    pairs |= {0x1FB3: 0x1FBC, 0x1FC3: 0x1FCC, 0x1FF3: 0x1FFC}
    pairs |= {i: i - 0x20 for i in range(0x10D70, 0x10D86)}
    pairs |= {0x19B: 0xA7DC, 0x264: 0xA7CB, 0x1C8A: 0x1C89, 0xA7CD: 0xA7CC, 0xA7CF: 0xA7CE, 0xA7D3: 0xA7D2, 0xA7D5: 0xA7D4, 0xA7DB: 0xA7DA}
    return pairs


def fold(text: str, collation: Collation) -> str:
    if collation is Collation.UNICODE_IGNORE_CASE:
        return text.translate(simple_upper())
    if collation is Collation.ASCII_IGNORE_CASE:
        return text.translate(str.maketrans(_UPPER, _LOWER))
    return text


def unicode_key_text(text: str) -> str:
    """Six hexadecimal digits for each scalar after the simple upper-case fold."""
    return "".join(f"{ord(c):06X}" for c in text.translate(simple_upper()))


def unicode_key(c: C) -> C:
    """Used when rows are written, never by queries."""

    @F.pandas_udf("string")
    def key(s: pd.Series) -> pd.Series:
        return s.map(unicode_key_text, na_action="ignore")

    return key(c)


def key_column(source: C, algorithm: str) -> C:
    if algorithm == ASCII_FOLD:
        return ascii_key(source)
    if algorithm == UNICODE_FOLD:
        return unicode_key(source)
    if algorithm == UTF16:
        return utf16_key(source)
    refuse("QN-KEY-002", algorithm, "no such key algorithm", "use a versioned one")


def key_text(text: str, algorithm: str) -> str:
    """The same key of a prefix, for a predicate."""
    if algorithm == ASCII_FOLD:
        if not all(0x20 <= ord(c) <= 0x7E for c in text):
            refuse("QN-KEY-001", text, "not printable ASCII")
        return fold(text, Collation.ASCII_IGNORE_CASE)
    if algorithm == UNICODE_FOLD:
        return unicode_key_text(text)
    return text.encode("utf-16-be").hex().upper()


def boundary_key(c: C) -> C:
    """UTF-16 units, each closed by a bar, for matches at unit boundaries."""
    return F.regexp_replace(utf16_key(c), "(....)", "$1|")


def successor(prefix: str) -> str | None:
    """The least text above every text with this prefix (hexadecimal keys); None if there is none."""
    for i in range(len(prefix) - 1, -1, -1):
        if prefix[i] < "￿":
            return prefix[:i] + chr(ord(prefix[i]) + 1)
    return None
