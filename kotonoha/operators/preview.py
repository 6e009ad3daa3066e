"""What a reader of converted text would show: ruby, directives and headings, as tables with one row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kotonoha.functions.text import strip
from kotonoha.operators.inline import heading_base
from kotonoha.operators.notes import CODE, apart

#: Marks of ruby and of upright runs, and what beside Chinese characters takes ruby without a mark.
BASE, OPEN, CLOSE, UPRIGHT, UPRIGHT_END, ALSO = "｜", "《", "》", "｟", "｠", "々〆ヵヶ"
_HAN, _BODY = f"[\\p{{IsHan}}{ALSO}]+\\z", r"\A[A-Za-z0-9!?]{1,4}\z"


def _behind(text: Column, opener: str) -> tuple[Column, Column]:
    """What stands before the last opener of a text and behind it."""
    behind = F.substring_index(text, opener, -1)
    return F.substring(text, F.lit(1), F.length(text) - F.length(behind) - 1), behind


def _closed(line: Column, opener: str, closer: str) -> Column:
    """The parts of a line that end at a closing mark and hold an opener."""
    parts = F.split(line, closer, -1)
    return F.filter(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.contains(p, F.lit(opener)))


def _open_rows(df: DataFrame, id_col: str, holds: str) -> DataFrame:
    """(id, line, text) of the lines outside fences and front matter that hold something, without their inline code."""
    rows = df.select(id_col, F.posexplode(F.arrays_zip("lines", "shield")).alias("at", "x")).filter(~F.col("x.shield") & F.col("x.lines").rlike(holds))
    return apart(rows.select(id_col, (F.col("at") + 1).alias("line"), F.regexp_replace("x.lines", CODE, "`").alias("text")))


def ruby_spans(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, line, ord, base, ruby): explicit ruby, and ruby on the Chinese characters right before it.

    A line is cut at the closing marks; behind the last opening mark of a part stands a reading, and before it its base."""

    def one(part: Column) -> Column:
        before, ruby = _behind(part, OPEN)
        named = _behind(before, BASE)[1]
        explicit = F.contains(before, F.lit(BASE)) & (named != "") & ~F.contains(named, F.lit(OPEN))
        base = F.when(explicit, named).otherwise(F.regexp_extract(before, _HAN, 0))
        return F.struct(base.alias("base"), F.when(~F.contains(ruby, F.lit(BASE)), ruby).otherwise("").alias("ruby"))

    found = F.filter(F.transform(_closed(F.col("text"), OPEN, CLOSE), one), lambda r: (r["base"] != "") & (r["ruby"] != ""))
    return _open_rows(df, id_col, OPEN).select(id_col, "line", F.posexplode(found).alias("ord", "r")).select(id_col, "line", "ord", "r.base", "r.ruby")


def upright_spans(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, line, ord, body): upright runs."""
    bodies = F.transform(_closed(F.col("text"), UPRIGHT, UPRIGHT_END), lambda part: _behind(part, UPRIGHT)[1])
    return _open_rows(df, id_col, UPRIGHT).select(id_col, "line", F.posexplode(F.filter(bodies, lambda b: b.rlike(_BODY))).alias("ord", "body"))


def directives(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, line, name, last_line, closed): each opening row with the closing one that belongs to it.

    Blocks are flat: among the rows of colons an opening one is closed if a bare one comes right after
    it. A document's rows are one array of its directive rows only, so no window sorts whole corpora."""
    rows = F.filter(
        F.transform(F.arrays_zip("lines", "shield"), lambda r, i: F.struct((i + 1).alias("line"), F.when(~r["shield"] & r["lines"].rlike(r"\A:::([A-Za-z][A-Za-z0-9_-]*)?[ \t　\r]*\z"), F.substring(strip(r["lines"]), 4, 1000)).alias("name"))),
        lambda r: r["name"].isNotNull(),
    )
    df = apart(df.select(id_col, rows.alias("rows")))
    pairs = F.transform("rows", lambda r, i: F.struct(r["line"].alias("line"), r["name"].alias("name"), F.get("rows", i + 1).alias("next")))
    out = df.select(id_col, F.explode(pairs).alias("p")).filter("p.name <> ''")
    closed = F.coalesce(F.col("p.next.name") == "", F.lit(False))
    return out.select(id_col, "p.line", "p.name", F.when(closed, F.col("p.next.line")).alias("last_line"), closed.alias("closed"))


def outline(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, line, level, title): headings with their titles as plain text."""
    row = r"\A(#{1,6})[ \t]+(.*?)[ \t　\r]*\z"
    rows = _open_rows(df, id_col, r"\A#{1,6}[ \t]")
    title = strip(F.regexp_extract("text", row, 2))
    return rows.select(id_col, "line", F.length(F.regexp_extract("text", row, 1)).alias("level"), F.coalesce(heading_base(title), title).alias("title"))
