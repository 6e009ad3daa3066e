"""Protected ranges as rows of offsets, and the overlap join of tables of ranges.

The join is an equi-join: a range is laid into every bin of BIN units that it touches, ranges meet in bins, an exact
comparison follows, and a pair is kept only in the bin where the later of the two begins, so that it comes out once. A bin holds what a
document has there, not the document, so a long text is split like any other key and nothing is compared all against all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kotonoha.functions.text import NOTE, utf16_length
from kotonoha.operators.notes import CODE, apart, folded, front_rows
from kotonoha.operators.spans import hits, laid_out
from kotonoha.session import written

BIN = 4096
_RANGE = "struct<start:bigint,end:bigint,kind:string>"
_BORDER = r"\A[ \t　]*(`{3,}|~{3,})"


def _protected(df: DataFrame, id_col: str) -> DataFrame:
    """(id, row, start, end, kind) of texts that are laid out."""
    rows = df.withColumn("__front", F.when(F.exists("shield", lambda x: x), front_rows(F.col("lines"))).otherwise(0)).withColumn("__length", utf16_length("text"))
    rows = apart(rows.withColumn("__code", F.when(F.contains("text", F.lit("`")), hits(CODE, lambda line: ~line["shield"] & F.contains(line["text"], F.lit("`"))))))
    front, last = F.col("__front"), F.get("__zipped", F.col("__front") - 1)
    behind = F.transform(F.slice("__zipped", F.when(front < 0, F.size("__zipped") + 1).otherwise(front + 1), F.size("__zipped")), lambda r: F.struct(r["start"].alias("start"), (r["start"] + utf16_length(r["text"])).alias("end"), r["text"].alias("text")))
    rows = apart(rows.withColumn("__behind", F.when(F.exists("shield", lambda x: x), behind)))
    state = lambda run, start: F.struct(run.alias("run"), start.cast("bigint").alias("start"))
    one = lambda start, end, kind: F.struct(start.cast("bigint").alias("start"), end.alias("end"), F.lit(kind).alias("kind"))

    def step(s: Column, r: Column) -> tuple[Column, Column]:
        run, opened = F.regexp_extract(r["text"], _BORDER, 1), s["run"] != ""
        closes = opened & r["text"].rlike(_BORDER + r"[ \t　\r]*\z") & (F.substring(run, 1, 1) == F.substring(s["run"], 1, 1)) & (F.length(run) >= F.length(s["run"]))
        now = F.when(closes, state(F.lit(""), F.lit(0))).when(~opened & (run != ""), state(run, r["start"])).otherwise(s)
        return now, F.when(closes, one(s["start"], r["end"], "fence"))

    fences = folded(F.col("__behind"), state(F.lit(""), F.lit(0)), step, _RANGE, finish=lambda s, out: F.concat(out, F.array(F.when(s["run"] != "", one(s["start"], F.col("__length"), "fence")))))
    none = F.array().cast(f"array<{_RANGE}>")
    head = F.array(F.when(front < 0, one(F.lit(0), F.col("__length"), "frontmatter")).when(front > 0, one(F.lit(0), last["start"] + utf16_length(last["text"]), "frontmatter")))
    code = F.transform("__code", lambda h: one(h["start"], h["end"], "inline-code"))
    found = F.filter(F.concat(head, F.coalesce(fences, none), F.coalesce(code, none)), lambda r: r.isNotNull())
    return apart(rows.select(id_col, "row", found.alias("__found"))).select(id_col, "row", F.inline("__found"))


def protected_ranges(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, row, start, end, kind) of front matter, fences and inline code, in UTF-16 offsets, end exclusive; what is never closed reaches to the end."""
    return _protected(laid_out(df, id_col, text), id_col)


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], bin_: int = BIN) -> DataFrame:
    """Pairs of rows with equal keys (nulls are equal) whose [start, end) ranges overlap: all columns of left, and those of right that are no keys with right_ in front.

    Empty ranges overlap nothing."""
    bins = F.explode(F.sequence(F.floor(F.col("start") / bin_), F.floor((F.col("end") - 1) / bin_))).alias("__bin")
    dealt = lambda df, side: df.filter(F.col("start") < F.col("end")).select("*", bins).select(*(F.col(c).alias(c if side == "l" and c != "__bin" else f"{side}__{c}") for c in [*df.columns, "__bin"]))
    a, b = dealt(left, "l"), dealt(right, "r")
    same = F.col("l____bin") == F.col("r____bin")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"r__{k}"))
    met = a.join(b, same).filter((F.col("start") < F.col("r__end")) & (F.col("r__start") < F.col("end")) & (F.floor(F.greatest(F.col("start"), F.col("r__start")) / bin_) == F.col("l____bin")))
    others = [c for c in right.columns if c not in keys]
    return met.select(*left.columns, *(F.col(f"r__{c}").alias(f"right_{c}") for c in others))


def notes_by_protection(df: DataFrame, id_col: str = "doc_id", text: str = "text", pattern: str = NOTE) -> DataFrame:
    """(id, row, line, start, end, note, protection): every note of whole texts with the kind of the first range that it touches, null for open ones.

    A note that a range covers in part is protected like one that lies in it. Rows that repeat id and text are joined once and keep their rows."""
    rows = laid_out(df.filter(F.contains(text, F.lit("［＃"))), id_col, text)
    notes = apart(rows.select(id_col, "row", hits(pattern, lambda line: line["text"].rlike(pattern)).alias("__hits"))).select(id_col, "row", F.inline("__hits")).drop("shield")
    notes = written(notes, "notes")  # joined with the ranges, and once more with what they met
    keys = [id_col, "row"]
    met = overlaps(notes.select(*keys, "start", "end").distinct(), _protected(rows, id_col).distinct(), keys)
    first = met.groupBy(*keys, "start").agg(F.min_by("right_kind", "right_start").alias("protection"))
    a, b = notes.alias("a"), first.alias("b")
    same = F.col(f"a.{id_col}").eqNullSafe(F.col(f"b.{id_col}")) & (F.col("a.row") == F.col("b.row")) & (F.col("a.start") == F.col("b.start"))
    return a.join(b, same, "left").select("a.*", "b.protection")
