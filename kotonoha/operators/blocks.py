"""Block annotation stages: indentation, alignment, page breaks, annotation blocks, footers.

Each is one pass over a document's lines with a small state, or a window over its line table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kotonoha.functions.text import fullwidth_digits, is_delimiter, strip
from kotonoha.operators.inline import told
from kotonoha.operators.notes import apart, folded, shielded

_B, _E = r"\A[ \t　]*", r"[ \t　\r]*\z"
#: How the rows of a footer begin, and the note behind a body.
SOURCE, MADE, STAFF, BODY_END = "底本", "青空文庫作成ファイル", "入力|校正", "［＃本文終わり］"
_BLANKS = " \t　"
_DIRECTIVE = r"\A:::[A-Za-z][A-Za-z0-9_-]*\z"


def _state(**values) -> Column:
    return F.struct(*(v.alias(k) for k, v in values.items()))


def _fold(df: DataFrame, step, counters: tuple[str, ...], prefix: str) -> DataFrame:
    """Runs step(state, line, shield, next line that is not blank, next line) -> [<rows, open, existing, counter>] over the lines; an open block is closed at the end."""
    zero = _state(open=F.lit(""), existing=F.lit(False), **{c: F.lit(0).cast("bigint") for c in counters})
    # what comes next is found once, from the last line back; texts without a note opener need neither pass
    df = apart(df, __back=F.when(F.col("noted"), F.reverse(F.transform("lines", strip))))
    nexts = folded(F.col("__back"), F.lit("").cast("string"), lambda s, line: (F.when(line != "", line).otherwise(s), s), "string")
    df = apart(df, ("__back",), __next=F.when(F.col("noted"), F.reverse(nexts)))
    rows = F.transform(F.arrays_zip("lines", "shield", "__next"), lambda r, i: F.struct(r["lines"].alias("line"), r["shield"].alias("shield"), r["__next"].alias("next"), F.coalesce(F.get(F.col("lines"), i + 1), F.lit("")).alias("direct")))
    df = apart(df, ("__next",), __rows=F.when(F.col("noted"), rows))

    def one(s: Column, r: Column) -> Column:
        done = step(s, r["line"], r["shield"], r["next"], r["direct"])
        state = lambda x: _state(open=x["open"], existing=x["existing"], **{c: s[c] + F.when(x["counter"] == c, 1).otherwise(0) for c in counters})
        return F.transform(done, lambda x: _state(state=state(x), value=x["rows"]))

    done = folded(F.col("__rows"), zero, one, "array<string>", finish=lambda s, out: _state(state=s, out=out))
    df = apart(df, ("__rows",), __s=F.when(F.col("noted"), done))
    last = F.when(F.col("__s.state.open") != "", F.array(F.lit(":::"))).otherwise(F.array().cast("array<string>"))
    ended = F.concat(F.flatten("__s.out"), last)
    df = apart(df, ("__s",), lines=F.coalesce(ended, "lines"), **{f"{prefix}_{c}": F.coalesce(F.col(f"__s.state.{c}"), F.lit(0).cast("bigint")) for c in counters})
    return apart(df, shield=F.when(F.col("noted"), shielded(F.col("lines"))).otherwise(F.col("shield")))


def _rows(*xs: Column | str) -> Column:
    return F.array(*(F.lit(x) if isinstance(x, str) else x for x in xs))


def _chain(line: Column, s: Column, shield: Column, cases: list[tuple], default: tuple) -> tuple:
    """The first case (condition, rows, open, existing, counter) that holds, column by column.

    Which one it is is found once, and what holds no mark of a stage, outside blocks, is no case."""
    plain = ~shield & ~F.contains(line, F.lit("［＃")) & ~F.contains(line, F.lit(":::")) & ~s["existing"] & (s["open"] != "pair")
    which = F.when(plain, len(cases))
    for k, case in enumerate(cases):
        which = which.when(case[0], k)
    value = lambda v: F.lit(v) if isinstance(v, (str, bool)) else v

    def chosen(k: Column) -> Column:
        fields = []
        for at, name in enumerate(("rows", "open", "existing", "counter")):
            own = [value(x) for x in (*(case[at + 1] for case in cases), default[at])]
            out = own[-1]
            for j, v in reversed([*enumerate(own[:-1])]):
                out = F.when(k == j, v).otherwise(out)
            fields.append(out.alias(name))
        return F.struct(*fields)

    return F.transform(F.array(F.coalesce(which, F.lit(len(cases)))), chosen)


def indent(df: DataFrame, preserve: bool = False) -> DataFrame:
    """［＃N字下げ］ and its blocks become :::indent-N directives for N from 1 to 6; a new block replaces an open one."""
    start, end, single = _B + "［＃ここから([０-９0-9]+)字下げ］" + _E, _B + "［＃ここで字下げ終わり］" + _E, r"\A([ \t　]*)［＃([０-９0-9]+)字下げ］(.*)\z"

    def step(s, line, shield, following, direct):
        n = fullwidth_digits(F.coalesce(F.nullif(F.regexp_extract(line, start, 1), F.lit("")), F.regexp_extract(line, single, 2))).try_cast("int")
        good = F.coalesce(n.between(1, 6), F.lit(False))
        head = F.concat(F.lit(":::indent-"), n.cast("string"))
        closed = F.when(s["open"] != "", _rows(":::")).otherwise(F.array().cast("array<string>"))
        note = _rows(line) if preserve else F.array().cast("array<string>")
        body = F.concat(F.regexp_extract(line, single, 1), F.regexp_extract(line, single, 3))
        name = r"\A:::indent-[1-6]\z"
        cases = [
            (shield, F.concat(closed, _rows(line)), "", s["existing"], ""),
            (s["existing"], _rows(line), s["open"], strip(line) != ":::", ""),
            (strip(line).rlike(name), F.concat(closed, _rows(line)), "", True, ""),
            (line.rlike(start) & following.rlike(name), _rows(line), s["open"], False, ""),
            (line.rlike(start) & good, F.concat(closed, note, _rows(head)), "block", False, "converted"),
            (line.rlike(start), F.concat(closed, _rows(line)), "", False, "unconverted"),
            (line.rlike(end) & (s["open"] != ""), F.concat(_rows(":::"), note), "", False, ""),
            (line.rlike(single) & (s["open"] == "") & good & (strip(body) != ""), F.concat(note, _rows(head, body, ":::")), "", False, "converted"),
            (line.rlike("［＃(?:ここから)?[０-９0-9]+字下げ"), _rows(line), s["open"], False, "unconverted"),
        ]
        return _chain(line, s, shield, cases, (_rows(line), s["open"], False, ""))

    return _fold(df, step, ("converted", "unconverted"), "indent")


def align(df: DataFrame, approximate: bool = False, preserve: bool = False) -> DataFrame:
    """［＃地付き］ and its blocks become :::align-end directives, ［＃地からN字上げ］ likewise if it may be approximated."""
    start, end = _B + "［＃ここから地付き］" + _E, _B + "［＃ここで地付き終わり］" + _E
    raised, lowered = _B + "［＃ここから地から[０-９0-9]+字上げ］" + _E, _B + "［＃ここで字上げ終わり］" + _E
    single, single_raised = r"\A(.*?)［＃地付き］(.*)\z", r"\A(.*?)［＃地から[０-９0-9]+字上げ］(.*)\z"

    def step(s, line, shield, following, direct):
        closed = F.when(s["open"] != "", _rows(":::")).otherwise(F.array().cast("array<string>"))
        note = _rows(line) if preserve else F.array().cast("array<string>")
        more = F.size(F.regexp_extract_all(line, F.lit("［＃地付き］|［＃地から[０-９0-9]+字上げ］"), F.lit(0))) > 1
        can = F.lit(approximate)

        def one(pattern, counter):
            before, body = F.regexp_extract(line, pattern, 1), F.regexp_extract(line, pattern, 2)
            lead = F.when(strip(before) == "", F.array().cast("array<string>")).otherwise(_rows(before))
            return (line.rlike(pattern) & (s["open"] == "") & ~more & (strip(body) != "") & (F.lit(True) if counter == "converted" else can), F.concat(lead, _rows(":::align-end", body, ":::")), "", False, counter)

        cases = [
            (shield, F.concat(closed, _rows(line)), "", s["existing"], ""),
            (s["existing"], _rows(line), s["open"], strip(line) != ":::", ""),
            (strip(line).rlike(_DIRECTIVE), F.concat(closed, _rows(line)), "", True, ""),
            ((line.rlike(start) | line.rlike(raised)) & (following == ":::align-end"), _rows(line), s["open"], False, ""),
            (line.rlike(start), F.concat(closed, note, _rows(":::align-end")), "end", False, "converted"),
            (line.rlike(raised) & can, F.concat(closed, note, _rows(":::align-end")), "raised", False, "approximated"),
            (line.rlike(end) & (s["open"] == "end"), F.concat(_rows(":::"), note), "", False, ""),
            (line.rlike(lowered) & (s["open"] == "raised"), F.concat(_rows(":::"), note), "", False, ""),
            one(single, "converted"),
            one(single_raised, "approximated"),
            (line.rlike("［＃(?:ここから)?(?:地付き|地から[０-９0-9]+字上げ)］"), _rows(line), s["open"], False, "unconverted"),
        ]
        return _chain(line, s, shield, cases, (_rows(line), s["open"], False, ""))

    return _fold(df, step, ("converted", "approximated", "unconverted"), "align")


def page_breaks(df: DataFrame, approximate_spread: bool = False) -> DataFrame:
    """Page breaks, two of them with only blank lines between as one blank page; spread breaks if they may be approximated."""
    page, spread = _B + "［＃改ページ］" + _E, _B + "［＃(?:改丁|改見開き)］" + _E

    def step(s, line, shield, following, direct):
        # open: "pair" after the first of two breaks while only blank lines have come; the pair's second writes the blank page
        blank = strip(line) == ""
        here, pair = line.rlike(page), s["open"] == "pair"
        again = F.coalesce(following.rlike(page), F.lit(False))
        nothing = F.array().cast("array<string>")
        cases = [
            (shield, _rows(line), "", s["existing"], ""),
            (s["existing"], _rows(line), "", strip(line) != ":::", ""),
            (strip(line).rlike(_DIRECTIVE), _rows(line), "", True, ""),
            (pair & blank, nothing, "pair", False, ""),
            (pair & here, _rows(":::blank-page", ":::"), "", False, "blank_pages"),
            (here & (following == ":::page-break"), _rows(line), "", False, ""),
            (here & again & (strip(direct) == ""), nothing, "pair", False, ""),
            (here, _rows(":::page-break", ":::"), "", False, "page_breaks"),
            (line.rlike(spread) & (following == ":::page-break"), _rows(line), "", False, ""),
            (line.rlike(spread) & F.lit(approximate_spread), _rows(":::page-break", ":::"), "", False, "spread_approximated"),
            (line.rlike("［＃改段］"), _rows(line), "", False, "kaidan_unconverted"),
            (line.rlike("［＃(?:改ページ|改丁|改見開き)］"), _rows(line), "", False, "unconverted"),
        ]
        return _chain(line, s, shield, cases, (_rows(line), "", False, ""))

    return _fold(df, step, ("page_breaks", "blank_pages", "spread_approximated", "unconverted", "kaidan_unconverted"), "page")


def annotation_blocks(df: DataFrame) -> DataFrame:
    """Blocks between pairs of rows of hyphens go; an odd number of such rows leaves the text as it is."""
    rows = F.arrays_zip("lines", "shield")
    is_mark = lambda r: is_delimiter(r["lines"]) & ~r["shield"]
    df = apart(df, __n=F.size(F.filter(rows, is_mark)))
    even = (F.col("__n") % 2 == 0) & (F.col("__n") > 0)
    df = apart(df, __mark=F.when(even, F.transform(rows, is_mark)))
    inside = folded(F.col("__mark"), F.lit(False), lambda s, mark: (s != mark, s | mark), "boolean")
    df = apart(df, ("__mark",), __inside=F.when(even, inside))
    kept = F.transform(F.filter(F.arrays_zip("lines", "__inside"), lambda r: ~r["__inside"]), lambda r: r["lines"])
    unclosed = F.col("__n") % 2 == 1
    said = F.when(unclosed, F.array(F.struct(F.lit("annotationBlocks").alias("stage"), F.lit("UNCLOSED_ANNOTATION_BLOCK").alias("code"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("note"), F.lit(None).cast("string").alias("reason"))))
    lines = F.when(F.col("__inside").isNotNull(), kept).otherwise(F.col("lines"))
    removed = F.when(even, (F.col("__n") / 2).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    df = apart(df, ("__n", "__inside"), lines=lines, blocks_removed=removed, blocks_unclosed=unclosed, **told(df, said))
    return apart(df, shield=shielded(F.col("lines")))


def _date(line: Column) -> Column:
    """A real Gregorian date of making or changing at the start of a row."""
    row = F.ltrim(fullwidth_digits(line), F.lit(_BLANKS))
    day = F.substring_index(row, "日", 1)
    done = F.ltrim(F.substring(row, F.length(day) + 2, F.length(row)), F.lit(_BLANKS))
    real = F.coalesce(F.try_to_date(day, "yyyy年M月d") >= "0001-01-01", F.lit(False)) & (F.length(day) <= 10)
    return real & (F.startswith(done, F.lit("作成")) | F.startswith(done, F.lit("修正")))


def footer(df: DataFrame, window: int = 400) -> DataFrame:
    """Cuts the text before the last safe footer start among the last rows; blank rows before it go too."""
    # a text without the closing row of a footer has none: its lines are not looked at one by one
    start = F.greatest(F.size("lines") - window, F.lit(0))
    some = F.exists("lines", lambda x: F.contains(x, F.lit(MADE)))
    df = apart(df, __tail=F.when(some, F.slice(F.arrays_zip("lines", "shield"), start + 1, F.lit(window))).otherwise(F.slice(F.arrays_zip("lines", "shield"), 1, 0)))
    marked = lambda x: F.contains(x, F.lit("：")) | F.contains(x, F.lit(":"))
    flags = F.transform(
        "__tail",
        lambda r, i: F.struct(
            (start + i).alias("i"),
            (~r["shield"] & ~r["lines"].rlike(r"\A {0,3}>")).alias("usable"),
            (marked(r["lines"]) & r["lines"].rlike(rf"\A[ \t　]*{SOURCE}[：:]")).alias("source"),
            r["lines"].rlike(_B + BODY_END + _E).alias("end"),
            (marked(r["lines"]) & r["lines"].rlike(rf"\A[ \t　]*{MADE}[：:]")).alias("made"),
            ((marked(r["lines"]) & r["lines"].rlike(rf"\A[ \t　]*(?:{STAFF})[：:]")) | (F.contains(r["lines"], F.lit("年")) & F.contains(r["lines"], F.lit("日")) & _date(r["lines"]))).alias("who"),
            (r["shield"] | is_delimiter(r["lines"])).alias("stop"),
        ),
    )
    df = apart(df, ("__tail",), __f=flags)
    last = lambda name: F.array_max(F.transform(F.filter("__f", lambda r: r["usable"] & r[name]), lambda r: r["i"]))
    stop = F.coalesce(F.array_max(F.transform(F.filter("__f", lambda r: r["stop"]), lambda r: r["i"])), F.lit(-1))
    df = apart(df, __stop=stop, __limit=F.least(last("made"), last("who")), __both=last("made").isNotNull() & last("who").isNotNull())
    chosen = lambda name: F.array_max(F.transform(F.filter("__f", lambda r: r["usable"] & r[name] & (r["i"] > F.col("__stop")) & (r["i"] <= F.col("__limit"))), lambda r: r["i"]))
    df = apart(df, ("__stop", "__limit", "__both"), __at=F.when(F.col("__both"), F.coalesce(chosen("source"), chosen("end"))))
    kept = F.slice("lines", F.lit(1), F.col("__at"))
    body = F.array_max(F.transform(F.filter(F.transform(kept, lambda x, i: F.struct(i.alias("i"), strip(x).alias("x"))), lambda x: x["x"] != ""), lambda x: x["i"]))
    cut = F.when(body.isNull(), F.array(F.lit(""))).otherwise(F.array_append(F.slice("lines", F.lit(1), body + 1), F.lit("")))
    # what looks like a footer and stays is told
    kept_back = F.col("__at").isNull() & F.exists("__f", lambda r: r["source"] | r["end"])
    said = F.when(kept_back, F.array(F.struct(F.lit("footer").alias("stage"), F.lit("FOOTER_CANDIDATE_PRESERVED").alias("code"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("note"), F.lit(None).cast("string").alias("reason"))))
    df = apart(df, ("__f", "__at"), footer_removed=F.col("__at").isNotNull(), lines=F.when(F.col("__at").isNotNull(), cut).otherwise(F.col("lines")), **told(df, said))
    return apart(df, shield=shielded(F.col("lines")))


def line_table(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, line, text, shield, next_line): the lines as rows, each with the number of the next one that is not blank."""
    rows = df.select(id_col, F.posexplode(F.arrays_zip("lines", "shield")).alias("at", "x")).select(id_col, (F.col("at") + 1).alias("line"), F.col("x.lines").alias("text"), F.col("x.shield").alias("shield"))
    after = Window.partitionBy(id_col).orderBy("line").rowsBetween(1, Window.unboundedFollowing)
    return rows.withColumn("next_line", F.min(F.when(strip(F.col("text")) != "", F.col("line"))).over(after))
