"""Names and paths: safe file names, collision keys, archive entries, destinations."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from kotonoha.functions.text import SPACE, col

#: Device names that are no file stems.
RESERVED = r"(?i)\A(con|prn|aux|nul|com[1-9¹²³]|lpt[1-9¹²³])(\.|\z)"
_EDGE = rf"\A(?:{SPACE}|\.)+|(?:{SPACE}|\.)+\z"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _cut(base: Column, points: int, budget: int) -> Column:
    """The longest beginning of so many characters and bytes, trimmed again."""

    def within(base: Column) -> Column:
        total = F.aggregate(
            F.split(base, ""),
            F.struct(F.lit("").alias("out"), F.lit(False).alias("full")),
            lambda s, ch: F.when(s["full"] | (F.octet_length(s["out"]) + F.octet_length(ch) > budget), F.struct(s["out"].alias("out"), F.lit(True).alias("full"))).otherwise(F.struct(F.concat(s["out"], ch).alias("out"), F.lit(False).alias("full"))),
            lambda s: s["out"],
        )
        return F.regexp_replace(F.when(F.octet_length(base) <= budget, base).otherwise(total), _EDGE, "")

    return _once(F.substring(base, 1, points), within)


def sanitize_filename(name: Column | str, extension: str = "", suffix: str = "", max_code_points: int = 100) -> Column:
    """A safe file name of at most so many characters and 240 bytes, suffix and extension included."""
    tail = suffix + (f".{extension}" if extension else "")
    points, budget = max(1, min(100, max_code_points)) - len(tail), 240 - len(tail.encode())
    if min(points, budget) < 1 or extension not in ("", "md", "txt"):
        raise ValueError("suffix or extension out of bounds")
    clean = F.regexp_replace(F.translate(col(name), '/\\:*?"<>|', "_" * 9), r"[\x00-\x1f\x7f-\x9f]", "")
    steps = (
        lambda base: F.when(base == "", "untitled").otherwise(base),
        lambda base: F.when(base.rlike(RESERVED), F.concat(F.lit("_"), base)).otherwise(base),
        lambda base: _cut(base, points, budget),
        lambda base: F.when(base == "", _cut(F.lit("untitled"), points, budget)).otherwise(base),
        lambda base: F.when(base.rlike(RESERVED), _cut(F.concat(F.lit("_"), base), points, budget)).otherwise(base),
    )
    base = F.regexp_replace(clean, _EDGE, "")
    for step in steps:
        base = _once(base, step)
    return F.concat(base, F.lit(tail))


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode normal form C, which Spark's functions lack."""
    return text.str.normalize("NFC")


def collision_key(path: Column | str) -> Column:
    """Equal for paths that a portable file system may take for one: NFC, lower case, no trailing blanks or dots in a segment."""
    return F.array_join(F.transform(F.split(F.lower(nfc(col(path))), "/"), lambda s: F.regexp_replace(s, r"[ .]+\z", "")), "/")


def zip_entry_problem(raw: Column, decoded: Column, index: Column, mode: Column) -> Column:
    """Why an archive entry is unsafe, the first reason that holds; null for a safe one."""
    out = F.when(index.isNull() | (index < 0), "invalid-entry-index").when(mode.bitwiseAND(0xF000) == 0xA000, "symlink")
    for name in (raw, F.coalesce(decoded, raw)):
        out = (
            out.when(name.rlike(r"[\x00-\x1f]"), "control-character")
            .when(name.rlike(r"(?i)\A[/\\]|\A[a-z]:"), "absolute-or-drive-path")
            .when(F.array_contains(F.split(name, r"[/\\]", -1), ".."), "parent-segment")
        )
    return out.when(zip_relative_name(F.coalesce(decoded, raw)) == "", "empty-path")


def zip_relative_name(decoded: Column) -> Column:
    return F.array_join(F.filter(F.split(decoded, r"[/\\]", -1), lambda s: ~s.isin("", ".")), "/")


def destination_check(containment: Column, inspection: Column, exclusive: Column, inside: Column, symlink: Column, exists: Column, alias: Column) -> Column:
    """Whether a destination may be written: ok, or the code that says why not."""
    unsafe = ~containment | ~inspection | ~inside | symlink | exists | alias
    return F.when(unsafe, "UNSAFE_DESTINATION").when(~exclusive, "EXCLUSIVE_CREATE_UNAVAILABLE").otherwise("ok")
