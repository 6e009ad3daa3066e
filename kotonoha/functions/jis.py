"""JIS X 0213 characters by plane, row and cell, as a table to join with."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def character(plane: int, row: int, cell: int) -> str | None:
    """The character, or the two characters, at a place; null where there is none. Bytes of EUC-JIS-2004 by their rule."""
    if plane not in (1, 2) or not 1 <= row <= 94 or not 1 <= cell <= 94:
        return None
    code = bytes([row + 160, cell + 160])
    try:
        return (b"\x8f" * (plane - 1) + code).decode("euc_jis_2004")
    except UnicodeDecodeError:
        return None


def table(spark: SparkSession) -> DataFrame:
    """(plane, row, cell, value) of all 17,672 places, small enough to broadcast whatever the corpus."""
    places = [(p, r, c, character(p, r, c)) for p in (1, 2) for r in range(1, 95) for c in range(1, 95)]
    return spark.createDataFrame(places, "plane int, row int, cell int, value string")


@cache
def _rows() -> list[str]:
    """The cells of each plane's rows as two characters each, blanks where there are none."""
    return ["".join((character(p, r, c) or "").ljust(2) for c in range(1, 95)) for p in (1, 2) for r in range(1, 95)]


def at(plane: Column, row: Column, cell: Column) -> Column:
    """The character at a place as an expression over constants: nothing is joined, whatever the number of notes."""
    rows = F.split(F.lit("\n".join(_rows())), "\n")  # folded into one literal when the query is planned
    found = F.rtrim(F.substring(F.get(rows, (plane - 1) * 94 + row - 1), (cell - 1) * 2 + 1, F.lit(2)))
    return F.when(plane.between(1, 2) & row.between(1, 94) & cell.between(1, 94) & (found != ""), found)
