"""Notes and ranges over rows: events with their places, pairs of them, and rows joined for the stages that read whole texts.

Places are UTF-16 offsets from the beginning of a text. An event is a note that opens or closes a range, or stands alone; a
range reaches from an opening note to the first closing one of its kind, what opens again between them is part
of it (its depth is told). All of it is worked out within a document's row, so nothing is shuffled; the tables
are the rows' arrays laid out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kotonoha.functions.text import NOTE, utf16_length
from kotonoha.operators.notes import apart, bound, folded, with_lines
from kotonoha.session import spread

#: The kinds of ranges in notes; ［＃ここから…］ and ［＃ここで…終わり］ are ranges of their own.
KINDS = ("太字", "斜体", "傍線", "二重傍線", "鎖線", "破線", "波線", "傍点", "白ゴマ傍点", "白丸傍点", "黒三角傍点", "白三角傍点", "二重丸傍点", "蛇の目傍点", "ばつ傍点", "丸傍点", "大見出し", "中見出し", "小見出し")
_HIT = "struct<line:int,start:bigint,end:bigint,note:string,shield:boolean>"


def laid_out(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, row, text, noted, lines, shield, __zipped): whole texts with their lines <line, start, shield, text>.

    row is a hash of id and text: rows that share it are equal."""
    whole = spread(df.select(id_col, F.coalesce(F.col(text), F.lit("")).alias("text")))
    rows = with_lines(whole.withColumn("row", F.xxhash64(id_col, "text")))
    starts = folded(F.col("lines"), F.lit(0).cast("bigint"), lambda at, line: (at + utf16_length(line) + 1, at), "bigint")
    df = apart(rows.withColumn("__starts", starts))
    zipped = F.arrays_zip(F.col("lines").alias("line"), F.col("shield").alias("shield"), F.col("__starts").alias("start"))
    return apart(df.withColumn("__zipped", F.transform(zipped, lambda r, i: F.struct((i + 1).cast("int").alias("line"), r["start"].alias("start"), r["shield"].alias("shield"), r["line"].alias("text")))).drop("__starts"))


def hits(pattern: str, holds: Callable[[Column], Column]) -> Column:
    """The matches of a pattern in the lines that hold it, with their offsets, in order."""

    def of(line: Column) -> Column:
        parts = F.arrays_zip(F.split(line["text"], pattern, -1).alias("gap"), F.regexp_extract_all(line["text"], F.lit(pattern), F.lit(0)).alias("hit"))
        start = lambda at, p: at + utf16_length(p["gap"])
        end = lambda at, p: start(at, p) + F.coalesce(utf16_length(p["hit"]), F.lit(0))
        one = lambda at, p: F.when(p["hit"].isNotNull(), F.struct(line["line"].alias("line"), start(at, p).alias("start"), end(at, p).alias("end"), p["hit"].alias("note"), line["shield"].alias("shield")))
        found = folded(parts, line["start"], lambda at, p: (end(at, p), one(at, p)), _HIT)
        return F.filter(found, lambda x: x.isNotNull())

    return F.flatten(F.transform(F.filter("__zipped", holds), of))


def placed(df: DataFrame, id_col: str = "doc_id", text: str = "text", pattern: str = NOTE) -> DataFrame:
    """(id, row, line, start, end, note, shield): each match of a pattern within the lines of a text, protected or not, with its offsets."""
    rows = laid_out(df, id_col, text).withColumn("__hits", hits(pattern, lambda line: line["text"].rlike(pattern)))
    return apart(rows.select(id_col, "row", "__hits")).select(id_col, "row", F.inline("__hits"))


def _kind(note: Column) -> tuple[Column, Column]:
    """A note's kind of range and which side of it the note is; no kind for a note that stands alone."""
    inner = F.regexp_replace(note, r"\A※?［＃|］\z", "")
    closes = F.endswith(inner, F.lit("終わり"))
    block = F.startswith(inner, F.lit("ここから")) | F.startswith(inner, F.lit("ここで"))
    name = F.regexp_replace(F.regexp_replace(inner, r"\A(?:ここから|ここで)", ""), r"終わり\z", "")
    known = F.regexp_replace(name, r"\A左に", "").isin(*KINDS) & ~F.startswith(note, F.lit("※")) & (~block | (closes == F.startswith(inner, F.lit("ここで"))))
    return F.when(known, F.when(block, F.concat(F.lit("block "), name)).otherwise(name)), F.when(~known, "alone").when(closes, "close").otherwise("open")


def note_events(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, row, line, start, end, note, kind, side): the notes of whole texts outside fences and front matter as events in their order."""
    found = placed(df, id_col, text).filter("not shield")
    kind, side = _kind(F.col("note"))
    return apart(found.drop("shield").withColumn("kind", kind).withColumn("side", side))


def note_pairs(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, kind, start, end, first_line, last_line, depth, status): each range of a text, in UTF-16 offsets from its opening note to behind its closing one.

    depth: how often the kind is opened in it. status: paired, crossing (a protected row lies within), unclosed or unopened. The
    events of one kind are matched in one pass with the open one as state, within the document's row."""
    rows = laid_out(df.filter(F.contains(text, F.lit("［＃"))), id_col, text).withColumn("__hits", hits(NOTE, lambda line: ~line["shield"] & F.contains(line["text"], F.lit("［＃"))))
    hidden = folded(F.col("shield"), F.lit(0), lambda n, s: (n + s.cast("int"), n + s.cast("int")), "int")
    rows = apart(rows.select(id_col, "__hits", hidden.alias("__hidden")))

    def event(h: Column) -> Column:
        kind, side = _kind(h["note"])
        return F.struct(h["start"].alias("start"), h["end"].alias("end"), h["line"].alias("line"), kind.alias("kind"), (side == "open").alias("opens"))

    rows = apart(rows.withColumn("__events", F.filter(F.transform("__hits", event), lambda e: e["kind"].isNotNull())).drop("__hits"))
    kinds = F.array_distinct(F.transform("__events", lambda e: e["kind"]))
    rows = rows.select(id_col, "__hidden", "__events", F.explode(kinds).alias("kind"))
    rows = apart(rows.withColumn("__own", F.filter("__events", lambda e: e["kind"] == F.col("kind"))).drop("__events"))
    opened = "struct<start:bigint,line:int,depth:int>"
    pair = "struct<start:bigint,end:bigint,first_line:int,last_line:int,depth:int,status:string>"
    make = lambda start, end, first, last, depth, status: F.struct(start.alias("start"), end.alias("end"), first.alias("first_line"), last.alias("last_line"), depth.alias("depth"), F.lit(status).alias("status"))

    def step(s: Column, e: Column) -> tuple[Column, Column]:
        deeper = F.struct(s["start"].alias("start"), s["line"].alias("line"), (s["depth"] + 1).alias("depth"))
        now = F.when(~e["opens"], None).when(s.isNull(), F.struct(e["start"].alias("start"), e["line"].alias("line"), F.lit(1).alias("depth"))).otherwise(deeper)
        value = F.when(e["opens"], None).when(s.isNull(), make(e["start"], e["end"], e["line"], e["line"], F.lit(0), "unopened")).otherwise(make(s["start"], e["end"], s["line"], e["line"], s["depth"], "paired"))
        return now.cast(opened), value.cast(pair)

    left = lambda s, out: F.filter(F.concat(out, F.array(F.when(s.isNotNull(), make(s["start"], F.lit(None).cast("bigint"), s["line"], F.lit(None).cast("int"), s["depth"], "unclosed")).cast(pair))), lambda x: x.isNotNull())
    pairs = rows.select(id_col, "__hidden", "kind", F.explode(folded(F.col("__own"), F.lit(None).cast(opened), step, pair, finish=left)).alias("p")).select(id_col, "__hidden", "kind", "p.*")
    crossing = (F.col("status") == "paired") & (F.get("__hidden", F.col("last_line") - 1) > F.get("__hidden", F.col("first_line") - 1))
    return pairs.withColumn("status", F.when(crossing, "crossing").otherwise(F.col("status"))).drop("__hidden")


def over_rows(df: DataFrame, stage: Callable[[DataFrame], DataFrame], ranges: str | None = None) -> DataFrame:
    """Runs a stage with the rows joined that a note runs over, and those from an opening note of ranges (names of kinds, |) to its closing one.

    Rows are joined only where nothing protected lies between and the end does come; in all other texts, nearly all of them, no row is looked at."""
    split_note = F.exists("lines", lambda x: x.rlike(r"［＃[^］]*\z"))
    opener, closer = (rf"［＃(?:{ranges})］", rf"［＃(?:{ranges})終わり］") if ranges else ("", "")
    rest = lambda x: F.regexp_replace(x, rf"［＃({ranges})］[^\n]*?［＃\1終わり］", "")
    some = split_note | F.exists("lines", lambda x: F.contains(x, F.lit("［＃")) & rest(x).rlike(opener)) if ranges else split_note
    some = F.coalesce(F.col("noted") & some, F.lit(False))

    def names(line: Column, pattern: str) -> Column:
        return F.regexp_extract_all(line, F.lit(pattern.replace("(?:", "(", 1)), F.lit(1)) if ranges else F.array().cast("array<string>")

    facts = lambda r: F.struct(r["shield"].alias("shield"), r["lines"].rlike(r"［＃[^］]*\z").alias("cut"), F.contains(r["lines"], F.lit("］")).alias("end"), names(rest(r["lines"]) if ranges else r["lines"], opener).alias("opens"), names(r["lines"], closer).alias("closes"))
    state = lambda cut, kinds: F.struct(cut.alias("cut"), kinds.cast("array<string>").alias("kinds"))
    zero = state(F.lit(False), F.array())
    kind = "struct<cut:boolean,kinds:array<string>>"

    def down(s: Column, r: Column) -> tuple[Column, Column]:
        # what is open behind a row, and what of it a row behind a protected one has lost
        now = F.when(r["shield"], zero).otherwise(state(r["cut"] | (s["cut"] & ~r["end"]), F.array_union(F.array_except(s["kinds"], r["closes"]), r["opens"])))
        return now, now

    def up(s: Column, r: Column) -> tuple[Column, Column]:
        # what comes to its end below a row, read from the last row up
        now = F.when(r["shield"], zero).otherwise(state(r["end"] | s["cut"], F.array_union(s["kinds"], r["closes"])))
        return now, s

    def starts(found: Column) -> Column:
        # where each joined row begins; null if no row is joined
        falling = bound(F.reverse(found), lambda back: F.reverse(folded(back, zero, up, kind)))
        on = F.zip_with(folded(found, zero, down, kind), falling, lambda a, b: (a["cut"] & b["cut"]) | F.arrays_overlap(a["kinds"], b["kinds"]))
        firsts = lambda on: F.filter(F.transform(on, lambda x, i: F.when((i == 0) | ~F.get(on, i - 1), i)), lambda i: i.isNotNull())
        return bound(on, lambda on: F.when(F.exists(on, lambda x: x), firsts(on)))

    # in one step, as nearly all texts need none of it
    df = apart(df, __first=F.when(some, bound(F.transform(F.arrays_zip("lines", "shield"), facts), starts)))
    whole = F.transform("__first", lambda at, k: F.array_join(F.slice(F.col("lines"), at + 1, F.coalesce(F.get(F.col("__first"), k + 1), F.size("lines")) - at), "\n"))
    shield = F.transform("__first", lambda at: F.get(F.col("shield"), at))
    df = apart(df, ("__first",), __over=F.col("__first").isNotNull(), lines=F.coalesce(whole, "lines"), shield=F.coalesce(shield, "shield"))
    df = stage(df)
    # the joined rows fall apart again, with as many lines as the stage has left of them
    parts = F.flatten(F.transform("lines", lambda x: F.split(x, "\n", -1)))
    shields = F.flatten(F.transform(F.arrays_zip("lines", "shield"), lambda r: F.array_repeat(r["shield"], F.size(F.split(r["lines"], "\n", -1)))))
    return apart(df, ("__over",), lines=F.when(F.col("__over"), parts).otherwise(F.col("lines")), shield=F.when(F.col("__over"), shields).otherwise(F.col("shield")))
