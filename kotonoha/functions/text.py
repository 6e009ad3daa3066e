"""Text primitives as Spark columns."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space of the contract (29 code points; U+FEFF is none), and its line ends.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
#: The same white space as characters.
_SPACES = "".join(c for c in map(chr, range(0x3001)) if re.fullmatch(SPACE, c))
#: The largest integer that a double holds with all below it.
MOST = (1 << 53) - 1
FULL_DIGITS, DIGITS = "０１２３４５６７８９", "0123456789"
NOTE = r"※?［＃[^］\r\n]*］"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@cache
def _decimal_digits() -> tuple[str, str]:
    """The decimal digits of all scripts but ASCII, and the ASCII digit of each."""
    found = [(chr(k), unicodedata.decimal(chr(k), None)) for k in range(128, sys.maxunicode + 1)]
    return "".join(c for c, v in found if v is not None), "".join(str(v) for _, v in found if v is not None)


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(_SPACES))


def rstrip(c: Column | str) -> Column:
    return F.rtrim(col(c), F.lit(_SPACES))


def is_space(c: Column | str) -> Column:
    return col(c).rlike(rf"\A{SPACE}+\z")


def split_lines(c: Column | str) -> Column:
    """Lines without their ends; a final end opens no line, an empty text has none."""
    parts = F.split(col(c), LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def lines(c: Column | str) -> Column:
    """The line table's rows: split at each newline only, the row behind a final one included."""
    return F.split(col(c), "\n", -1)


def fullwidth_digits(c: Column | str) -> Column:
    return F.translate(col(c), FULL_DIGITS, DIGITS)


def decimal(c: Column | str) -> Column:
    """The number of a run of decimal digits of any script, at most 2^53 - 1; null for the empty text, for other characters and beyond 4,300 digits."""
    digits = F.translate(col(c), *_decimal_digits())
    plain = F.regexp_replace(digits, r"\A0+(?=[0-9])", "")
    value = F.when(F.length(plain) > 16, F.lit(MOST)).otherwise(F.least(plain.try_cast("bigint"), F.lit(MOST)))
    return F.when((F.length(digits) <= 4300) & digits.rlike(r"\A[0-9]+\z"), value)


def utf8_length(c: Column | str) -> Column:
    return F.octet_length(col(c)).cast("bigint")


def utf16_length(c: Column | str) -> Column:
    return (F.octet_length(F.encode(col(c), "UTF-16BE")) / 2).cast("bigint")


def code_points(c: Column | str) -> Column:
    return F.filter(F.split(col(c), ""), lambda x: x != "")


def is_delimiter(c: Column | str) -> Column:
    """A row of five or more hyphens."""
    return col(c).rlike(r"\A[ \t　]*-{5,}[ \t　]*\z")


def file_id(*parts: Column | str) -> Column:
    """The JSON array of an input's id, and of an entry's index if there is one, without blanks."""
    quoted = [F.regexp_extract(F.to_json(F.struct(col(parts[0]).alias("v"))), r"\A\{\"v\":(.*)\}\z", 1)]
    return F.concat(F.lit("["), F.concat_ws(",", *quoted, *(col(p).cast("string") for p in parts[1:])), F.lit("]"))


def source_window(content: Column | str, limit: int = 131_072) -> Column:
    """The first bytes of a UTF-8 text, cut back to the last whole character."""
    c = col(content)
    byte = lambda k: F.conv(F.hex(F.substring(c, k, 1)), 16, 10).cast("int")
    back = F.lit(limit)
    for k in range(3):  # a character has three continuation bytes at most
        back = F.when((back == limit - k) & byte(limit - k + 1).between(128, 191), limit - k - 1).otherwise(back)
    return F.when(F.octet_length(c) <= limit, c).otherwise(F.substring(c, F.lit(1), back))


def between(c: Column | str, pattern: str, kept: Callable[[Column], Column], found: Callable[[Column], Column]) -> Column:
    """The text with kept() applied to what lies between the pattern's matches and found() to the matches."""
    gaps, hits = F.split(col(c), pattern, -1), F.regexp_extract_all(col(c), F.lit(pattern), F.lit(0))
    pairs = F.zip_with(gaps, hits, lambda g, h: F.concat(kept(g), F.coalesce(found(h), F.lit(""))))
    return F.when(col(c).rlike(pattern), F.array_join(pairs, "")).otherwise(kept(col(c)))


def occurrences(c: Column | str, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(col(c), F.lit(pattern), F.lit(0)))
