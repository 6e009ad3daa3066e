"""Annotation notes of a corpus: protected lines, what is left after conversion, and its report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kotonoha.functions.text import NOTE, lines

_FENCE = r"\A[ \t　]*(`{3,}|~{3,})"
_RULE = r"\A[ \t]*---[ \t]*\r?\z"
#: Inline code: a run of backticks up to the next run of the same length.
CODE = r"(?<!`)(`+)(?!`)(?:.*?[^`])??(?<!`)\1(?!`)"


#: An item's or a key's lead in front matter, its value, and a value that starts a block of text.
_LEAD = r"\A( *(?:- +)*)"
_KEYED = r"\A(?:\"[^\"]*\"|'[^']*'|[^\s\"'#:][^:]*(?::[^\s:][^:]*)*)[ \t]*:(?:[ \t]+|\z)"
_BLOCK = r"\A[|>][-+0-9]*[ \t]*(?:#.*)?\r?\z"
_DOUBLE_END, _SINGLE_END = r"\A[^\"\\]*+(?:\\.[^\"\\]*+)*+\"", r"\A[^']*+(?:''[^']*+)*+'(?!')"


def _front_zero() -> Column:
    return F.struct(F.lit(0).alias("front"), F.lit("").alias("scalar"), F.lit(0).alias("deep"), F.lit(True).alias("first"))


def _front_step(s: Column, line: Column) -> Column:
    """The state of front matter behind a row. front: 0 none, 1 inside, 2 on the closing row, 3 behind it.

    scalar says what the row leaves open: a block of text that goes on as long as rows are deeper than deep, or a
    quotation. An indented rule in one of them is part of it and closes nothing; one at the margin always closes."""
    made = lambda scalar, deep: F.struct(scalar.alias("scalar"), deep.alias("deep"))

    def opened(line: Column, lead: Column) -> Column:
        # what a row of its own leaves open
        def of_key(x: Column) -> Column:
            deep = F.when(x["key"] != "", F.length(lead)).otherwise(F.length(F.regexp_extract(line, r"\A((?: *- +)*?) *- +[^-]", 1)))
            value = F.regexp_replace(F.substring(x["body"], F.length(x["key"]) + 1, F.length(x["body"])), r"\A(?:[&!][^ \t]*[ \t]+)*[\[{, ]*", "")

            def of_value(value: Column) -> Column:
                rest = F.substring(value, F.lit(2), F.length(value))
                quoted = lambda mark, end: F.startswith(value, F.lit(mark)) & ~rest.rlike(end)
                return made(F.when(value.rlike(_BLOCK), "|").when(quoted("\"", _DOUBLE_END), "\"").when(quoted("'", _SINGLE_END), "'").otherwise(""), deep)

            return bound(value, of_value)

        body = F.substring(line, F.length(lead) + 1, F.length(line))
        return bound(bound(body, lambda x: F.struct(x.alias("body"), F.regexp_extract(x, _KEYED, 0).alias("key"))), of_key)

    def step(f: Column) -> Column:
        in_block = (s["scalar"] == "|") & (f["blank"] | (f["indent"] > s["deep"]))
        in_quote = s["scalar"].isin("\"", "'") & (f["blank"] | (f["indent"] > 0) | line.rlike(r"\A\t"))
        inside = s["front"] == 1
        front = F.when(s["first"], F.when(f["rule"], 1).otherwise(0)).when(inside & f["rule"] & ~(in_block | in_quote), 2).when(s["front"] == 2, 3).otherwise(s["front"])
        quote_ends = F.when(s["scalar"] == "\"", line.rlike(_DOUBLE_END)).otherwise(line.rlike(_SINGLE_END))
        own = bound(F.regexp_extract(line, _LEAD, 1), lambda lead: opened(line, lead))
        left = lambda front: F.when((front != 1) | s["first"], made(F.lit(""), F.lit(0))).when(in_block, made(F.lit("|"), s["deep"])).when(in_quote, made(F.when(quote_ends, "").otherwise(s["scalar"]), s["deep"])).otherwise(own)
        return bound(front, lambda front: bound(left(front), lambda x: F.struct(front.alias("front"), x["scalar"].alias("scalar"), x["deep"].alias("deep"), F.lit(False).alias("first"))))

    return bound(F.struct(line.rlike(_RULE).alias("rule"), line.rlike(r"\A[ \t\r]*\z").alias("blank"), F.length(F.regexp_extract(line, r"\A *", 0)).alias("indent")), step)


def front_rows(rows: Column) -> Column:
    """How many rows a text's front matter has with both its rules; 0 without any, -1 if it is never closed."""

    def step(s: Column, line: Column) -> Column:
        # rows behind the closing one are not looked at
        now = F.when(s["first"] | (s["front"] == 1), _front_step(s, line)).otherwise(F.struct(F.lit(3).alias("front"), F.lit("").alias("scalar"), F.lit(0).alias("deep"), F.lit(False).alias("first")))
        return F.transform(F.array(now), lambda x: F.struct(x.alias("state"), x["front"].alias("value")))

    states = folded(rows, _front_zero(), step, "int")
    return F.when(~F.get(rows, F.lit(0)).rlike(_RULE), 0).otherwise(F.coalesce(F.nullif(F.array_position(states, 2), F.lit(0)), F.lit(-1)).cast("int"))


def shielded(rows: Column) -> Column:
    """For each line whether it lies in front matter or in a fence, its borders included.

    One pass with the open fence as state: a fence closes at a run of its own character that is as long
    at least, an open one and unclosed front matter reach to the end."""
    zero = F.struct(F.lit("").alias("fence"), _front_zero().alias("front"))

    def step(s: Column, line: Column) -> Column:
        first = s["front"]["first"]
        front = F.when(first | s["front"]["front"].isin(1, 2), _front_step(s["front"], line)).otherwise(s["front"])

        def of(f: Column) -> Column:
            run, in_front = f["run"], f["front"]["front"].isin(1, 2)
            bare = line.rlike(r"\A[ \t　]*(`{3,}|~{3,})[ \t　\r]*\z")
            closes = (s["fence"] != "") & (run != "") & bare & (F.substring(run, 1, 1) == F.substring(s["fence"], 1, 1)) & (F.length(run) >= F.length(s["fence"]))
            fence = F.when(in_front, "").when(closes, "").when((s["fence"] == "") & (run != ""), run).otherwise(s["fence"])
            return bound(fence, lambda fence: F.struct(F.struct(fence.alias("fence"), f["front"].alias("front")).alias("state"), (in_front | (fence != "") | (run != "")).alias("value")))

        return F.transform(F.array(F.struct(F.regexp_extract(line, _FENCE, 1).alias("run"), front.alias("front"))), of)

    # most texts have neither a fence nor front matter, and need no fold
    some = F.exists(rows, lambda x: x.rlike(_FENCE)) | F.get(rows, F.lit(0)).rlike(_RULE)
    return F.when(some, folded(rows, zero, step, "boolean")).otherwise(F.transform(rows, lambda x: F.lit(False)))


def folded(rows: Column, zero: Column, step, kind: str, piece: int = 128, finish=lambda state, out: out) -> Column:
    """What step(state, row) -> (state, value) gives for each row, the state handed on; finish(last state, values) makes the result.

    A growing array is copied whenever it grows, so the values are gathered piece by piece. rows should be a column: an expression
    is worked out anew for each piece."""
    none = F.array().cast(f"array<{kind}>")
    pack = lambda state, out: F.struct(state.alias("state"), out.alias("out"))

    def one(s: Column, row: Column) -> Column:
        found = step(s["state"], row)
        if isinstance(found, Column):  # an array of one <state, value>, worked out once
            return F.get(F.transform(found, lambda x: pack(x["state"], F.array_append(s["out"], x["value"]))), F.lit(0))
        return pack(found[0], F.array_append(s["out"], found[1]))

    def some(s: Column, at: Column) -> Column:
        return F.aggregate(F.slice(rows, at + 1, F.lit(piece)), pack(s["state"], none), one, lambda x: pack(x["state"], F.array_append(s["out"], x["out"])))

    starts = F.when(F.size(rows) > 0, F.sequence(F.lit(0), F.size(rows) - 1, F.lit(piece))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(starts, pack(zero, F.array().cast(f"array<array<{kind}>>")), some, lambda s: finish(s["state"], F.flatten(s["out"])))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once: in a lambda an expression is worked out wherever it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def covering(rows: Column, spans: Column, kind: str) -> Column:
    """For each row the span (first, last, ...) that it lies in, or null; spans are sorted and share no row. rows and spans should be columns."""

    def step(k: Column, i: Column) -> tuple[Column, Column]:
        span = F.get(spans, k)
        return F.when(i >= span["last"], k + 1).otherwise(k), F.when((i >= span["first"]) & (i <= span["last"]), span)

    return folded(rows, F.lit(0), step, kind)


def apart(df: DataFrame, drop: tuple[str, ...] = (), **new: Column) -> DataFrame:
    """The rows with new columns and without those of drop, behind a border that the optimizer does not move expressions across.

    A stage's result is used several times by the next one; merged into one projection, or substituted
    into a filter that is pushed down, the stages' expressions would double with every step. Columns are given
    here instead of by withColumn and drop: each of those is analysed with all that stands before it."""
    at = dict.fromkeys(c for c in df.columns if c not in drop)
    made = {c: v.alias(c) for c, v in new.items()}
    return df.select(F.inline(F.array(F.struct(*(made.get(c, c) for c in {**at, **made})))))


def with_lines(df: DataFrame, text: str = "text", names: tuple[str, str, str] = ("noted", "lines", "shield")) -> DataFrame:
    """Adds noted (whether there is any note opener), lines and shield, the state on which the stages work."""
    noted, rows, shield = names
    whole = F.coalesce(F.col(text), F.lit(""))
    df = apart(df, **{noted: F.contains(whole, F.lit("［＃")), rows: lines(whole)})
    return apart(df, **{shield: shielded(F.col(rows))})


def remaining(noted: str, rows: str, shield: str) -> Column:
    """How many notes there are outside front matter, fences and inline code."""
    open_ = F.filter(F.arrays_zip(F.col(rows).alias("line"), F.col(shield).alias("shield")), lambda r: ~r["shield"] & F.contains(r["line"], F.lit("［＃")))
    found = F.transform(open_, lambda r: F.size(F.regexp_extract_all(F.regexp_replace(r["line"], CODE, "`"), F.lit(NOTE), F.lit(0))))
    return F.when(F.col(noted), F.aggregate(found, F.lit(0), lambda a, n: a + n)).otherwise(0).cast("bigint")


def residual_notes(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, line, ord, note): notes left outside front matter, fences and inline code; lines count from 1."""
    rows = with_lines(df.select(id_col, text), text)
    # a document without a note opener has none, so most never reach the per-line work
    rows = rows.filter(F.contains(F.col(text), F.lit("［＃"))).select(id_col, F.posexplode(F.arrays_zip("lines", "shield")).alias("at", "x"))
    rows = rows.filter(~F.col("x.shield")).select(id_col, (F.col("at") + 1).alias("line"), F.regexp_replace("x.lines", CODE, "`").alias("line_text"))
    return rows.select(id_col, "line", F.posexplode(F.regexp_extract_all("line_text", F.lit(NOTE), F.lit(0))).alias("ord", "note"))


def note_report(notes: DataFrame, id_col: str = "doc_id", shown: int = 50) -> DataFrame:
    """(id, rank, note, n, first_lines) of each document's first shown kinds of notes in the order of their first place, and the rest as one row of rank shown + 1."""
    place = F.struct("line", "ord")
    kinds = notes.groupBy(id_col, "note").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.array_sort(F.collect_list("line")).alias("at"))
    kinds = kinds.withColumn("rank", F.row_number().over(Window.partitionBy(id_col).orderBy("first")))
    listed = F.concat(F.array_join(F.slice(F.col("at").cast("array<string>"), 1, 3), ", "), F.when(F.col("n") > 3, ", ...").otherwise(""))
    head = kinds.filter(F.col("rank") <= shown).select(id_col, "rank", "note", "n", listed.alias("first_lines"))
    rest = kinds.filter(F.col("rank") > shown).groupBy(id_col).agg(F.lit(shown + 1).alias("rank"), F.lit(None).cast("string").alias("note"), F.count("*").alias("n"), F.lit("").alias("first_lines"))
    return head.unionByName(rest)
