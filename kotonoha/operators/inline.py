"""Inline annotation stages as column expressions on the line table.

A stage takes rows with lines, shield and noted (see notes.with_lines) and returns them converted,
with its counters and diagnostics as columns. Each line is cut once into pieces: a note of the
stage's kind with the text that stands before it. "「q」は…" converts where that text ends with q, so
a line costs time in proportion to its length. Shielded lines and inline code stay as they are, and
documents without a note opener are passed on untouched.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kotonoha.functions import jis
from kotonoha.functions.text import code_points, fullwidth_digits, is_space, strip
from kotonoha.operators.notes import CODE, apart, bound, covering, folded
from kotonoha.operators.spans import over_rows

#: Names of marks and lines in notes.
MARKS = "白ゴマ傍点|白丸傍点|黒三角傍点|白三角傍点|二重丸傍点|蛇の目傍点|ばつ傍点|丸傍点|傍点"
STYLES = "二重傍線|鎖線|破線|波線|傍線"
LEVELS = ("大", "中", "小")
#: Whatever notes follow a note, if ruby follows them: such a note lies inside a ruby base.
_RUBY_AFTER = "(?:(?:※?［＃[^］\r\n]*］)*《)?"
_EDGE, _END = r"\A[ \t　]*", r"[ \t　\r]*\z"
_PIECE = "struct<text:string,kind:string,note:string,code:string,reason:string>"
_DIAGNOSTICS = "array<struct<stage:string,code:string,line:int,note:string,reason:string>>"


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("string")


@cache
def _absent(context: SparkContext, name: str) -> Column:
    """A null of a name, made once a context: thousands of pieces are named while a plan is built."""
    return F.lit(None).cast("string").alias(name)


def piece(text, kind=None, note=None, code=None, reason=None) -> Column:
    """A part of a line: its text after the stage, what it counts as, and the note and code of a diagnostic."""
    context = SparkContext.getOrCreate()
    rest = {"kind": kind, "note": note, "code": code, "reason": reason}
    return F.struct(_lit(text).alias("text"), *(_absent(context, k) if v is None else _lit(v).alias(k) for k, v in rest.items()))


def _cut(line: Column, pattern: str, convert: Callable[[Column, Column], Column]) -> Column:
    gaps, hits = F.split(line, pattern, -1), F.regexp_extract_all(line, F.lit(pattern), F.lit(0))
    return F.zip_with(gaps, hits, lambda gap, hit: F.when(hit.isNull(), piece(gap)).otherwise(convert(gap, hit)))


def _around_code(line: Column, change: Callable[[Column], Column]) -> Column:
    gaps, codes = F.split(line, CODE, -1), F.regexp_extract_all(line, F.lit(CODE), F.lit(0))
    none = F.array().cast(f"array<{_PIECE}>")
    parts = F.zip_with(gaps, codes, lambda gap, code: F.concat(change(gap), F.when(code.isNull(), none).otherwise(F.array(piece(code)))))
    return F.when(F.contains(line, F.lit("`")), F.flatten(parts)).otherwise(change(line))


def counted(df: DataFrame, prefix: str, counts: dict[str, Column]) -> dict[str, Column]:
    """The stage's counters, which start at 0, with counts added to them."""
    there = set(df.columns)
    value = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return {f"{prefix}_{k}": (F.col(f"{prefix}_{k}") + value(c)) if f"{prefix}_{k}" in there else value(c) for k, c in counts.items()}


def told(df: DataFrame, found: Column) -> dict[str, Column]:
    """The diagnostics with (stage, code, line, note, reason) entries appended; lines count from 1 in the text as the stage saw it."""
    found = F.coalesce(found, F.array()).cast(_DIAGNOSTICS)
    return {"diagnostics": F.concat("diagnostics", found) if "diagnostics" in df.columns else found}


def notes_pass(df: DataFrame, stage: str, each: Callable[[Column], Column], counters: tuple[str, ...], mask: str = "shield") -> DataFrame:
    """Runs each(line) -> pieces on the lines outside the mask that hold a note opener."""
    one = lambda line, hidden: F.when(~hidden & F.contains(line, F.lit("［＃")), each(line))
    df = apart(df, __p=F.when(F.col("noted"), F.zip_with("lines", mask, one)))
    # few lines have pieces: counts and diagnostics look at no others
    flat = F.flatten(F.transform(F.filter(F.transform("__p", lambda ps, i: F.struct((i + 1).alias("line"), ps.alias("ps"))), lambda x: x["ps"].isNotNull()), lambda x: F.transform(F.filter(x["ps"], lambda p: p["kind"].isNotNull() | p["code"].isNotNull()), lambda p: F.struct(x["line"].alias("line"), p["kind"].alias("kind"), p["note"].alias("note"), p["code"].alias("code"), p["reason"].alias("reason")))))
    lines = F.zip_with("__p", "lines", lambda ps, line: F.when(ps.isNull(), line).otherwise(F.array_join(F.transform(ps, lambda p: p["text"]), "")))
    df = apart(df, ("__p",), __flat=flat, lines=F.coalesce(lines, "lines"))
    said = F.transform(F.filter("__flat", lambda p: p["code"].isNotNull()), lambda p: F.struct(F.lit(stage).alias("stage"), p["code"].alias("code"), p["line"].alias("line"), p["note"].alias("note"), p["reason"].alias("reason")))
    n = lambda kind: F.size(F.filter("__flat", lambda p: p["kind"] == kind))
    return apart(df, ("__flat",), **told(df, said), **counted(df, stage, {c: F.when(F.col("__flat").isNotNull(), n(c)) for c in counters}))


def _on_notes(df: DataFrame, stage: str, pattern: str, convert: Callable[[Column, Column], Column], counters: tuple[str, ...], mask: str = "shield") -> DataFrame:
    return notes_pass(df, stage, lambda line: _around_code(line, lambda part: _cut(part, pattern, convert)), counters, mask)


def cuts_upright(gap: Column, quoted: Column) -> Column:
    """Whether a quotation that ends a text begins inside an upright run, so that wrapping it would tear the run's brackets."""
    head = before(gap, quoted)
    run = F.concat(F.regexp_extract(head, r"｟([A-Za-z0-9!?]{0,4})\z", 1), F.regexp_extract(quoted, r"\A([A-Za-z0-9!?]{0,4})｠", 1))
    return head.rlike(r"｟[A-Za-z0-9!?]{0,4}\z") & quoted.rlike(r"\A[A-Za-z0-9!?]{0,4}｠") & F.length(run).between(1, 4)


def target(gap: Column, quoted: Column) -> Column:
    """The end of the text before a note that its quotation names: literally, or upright as a whole; null if neither."""
    upright = F.concat(F.lit("｟"), quoted, F.lit("｠"))
    return F.when(quoted == "", None).when(F.endswith(gap, quoted) & ~cuts_upright(gap, quoted), quoted).when(F.endswith(gap, upright), upright)


def before(gap: Column, found: Column) -> Column:
    return F.substring(gap, F.lit(1), F.length(gap) - F.length(found))


def in_ruby(head: Column, hit: Column) -> Column:
    """Whether ruby is open on the line before a target, or follows its note."""
    return head.rlike(r"[｜《][^》\n]*\z") | F.endswith(hit, F.lit("《"))


_SPAN = "struct<first:int,last:int,kind:string,verdict:string>"


def _span(first, last, kind, verdict) -> Column:
    return F.struct(first.cast("int").alias("first"), last.cast("int").alias("last"), kind.alias("kind"), F.lit(verdict).alias("verdict"))


def _laid(df: DataFrame, some: Column, extra: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Adds __rows<i, line, shield, ...> for the documents that a pass over rows concerns, as a column that a fold can cut up."""
    rows = F.transform(F.arrays_zip("lines", "shield"), lambda r, i: F.struct(i.cast("int").alias("i"), r["lines"].alias("line"), r["shield"].alias("shield"), *(f(r["lines"]).alias(k) for k, f in extra.items())))
    return apart(df, __rows=F.when(some, rows))


def _spans(df: DataFrame, zero: Column, step, finish=None) -> DataFrame:
    """Adds __spans, the spans of rows that step() closes, and __cover, for each row the span that it lies in."""
    end = lambda state, out: F.concat(out, F.array(finish(state))) if finish else out
    found = folded(F.col("__rows"), zero, step, _SPAN, finish=lambda state, out: F.filter(end(state, out), lambda x: x.isNotNull()))
    df = apart(df, __spans=F.when(F.col("__rows").isNotNull(), found), __at=F.transform("__rows", lambda r: r["i"]))
    return apart(df, ("__at",), __cover=F.when(F.col("__spans").isNotNull(), covering(F.col("__at"), F.col("__spans"), _SPAN)))


def gathered(df: DataFrame, stage: str, begins: str, ends: str, wrap: Callable[[Column, Column], Column], kind_of: Callable[[Column], Column], refused: Callable[[Column], Column], code: str) -> DataFrame:
    """Blocks between a row that begins a kind and the first row that ends one, wrapped row by row and without those two rows.

    begins, ends: patterns whose group 1 is the kind. A block is refused, and its rows are kept from the
    stage's later passes, if the kinds differ or a row in it holds a note opener or is refused(); without an
    ending row before a shielded one or the end, only the beginning row is. Adds __done, the rows that are settled."""
    some = F.col("noted") & F.exists("lines", lambda x: x.rlike(begins))
    group = lambda pattern: lambda line: F.nullif(F.regexp_extract(line, pattern, 1), F.lit(""))
    bad = lambda line: F.contains(line, F.lit("［＃")) | ((strip(line) != "") & refused(line))
    df = _laid(df, some, {"start": group(begins), "end": group(ends), "bad": bad})
    state = lambda head, kind, bad: F.struct(head.cast("int").alias("head"), kind.cast("string").alias("kind"), bad.alias("bad"))
    zero = state(F.lit(-1), F.lit(None), F.lit(False))

    def step(s: Column, r: Column) -> tuple[Column, Column]:
        opened, start, end = s["head"] >= 0, ~r["shield"] & r["start"].isNotNull(), ~r["shield"] & r["end"].isNotNull()
        same = r["end"] == s["kind"]
        good = ~s["bad"] & kind_of(s["kind"]).isNotNull()
        value = F.when(opened & end & same, F.when(good, _span(s["head"], r["i"], s["kind"], "good")).otherwise(_span(s["head"], r["i"], s["kind"], "kept"))).when(opened & (end | r["shield"]), _span(s["head"], s["head"], s["kind"], "broken"))
        now = F.when(opened & (end | r["shield"]), zero).when(opened, state(s["head"], s["kind"], s["bad"] | r["bad"])).when(start, state(r["i"], r["start"], F.lit(False))).otherwise(s)
        return now, value

    df = _spans(df, zero, step, lambda s: F.when(s["head"] >= 0, _span(s["head"], s["head"], s["kind"], "broken")))
    row = lambda text, done, shield: F.struct(text.alias("text"), done.alias("done"), shield.alias("shield"))

    def laid(r: Column, c: Column) -> Column:
        blank, verdict = strip(r["line"]) == "", c["verdict"]
        edge = (r["i"] == c["first"]) | (r["i"] == c["last"])
        inner = F.when(blank, row(r["line"], F.lit(False), r["shield"])).otherwise(row(wrap(r["line"], c["kind"]), F.lit(True), F.lit(False)))
        return F.when(c.isNull(), row(r["line"], F.lit(False), r["shield"])).when(verdict == "good", F.when(~edge, inner)).otherwise(row(r["line"], F.lit(True), r["shield"]))

    kinds = F.transform("__spans", lambda x: F.when(x["verdict"] == "good", kind_of(x["kind"])).otherwise("unconverted"))
    df = apart(df, ("__rows", "__cover"), __out=F.filter(F.zip_with("__rows", "__cover", laid), lambda x: x.isNotNull()), __kinds=kinds)
    n = lambda k: F.size(F.filter("__kinds", lambda x: x == k))
    said = F.transform(F.filter("__spans", lambda x: x["verdict"] != "good"), lambda x: F.struct(F.lit(stage).alias("stage"), F.lit(code).alias("code"), (x["first"] + 1).alias("line"), F.lit(None).cast("string").alias("note"), F.lit("unsupported-block").alias("reason")))
    done = F.coalesce(F.transform("__out", lambda r: r["done"] | r["shield"]), "shield")
    counters = {"emphasis": ("bold", "italic", "unconverted"), "underline": ("converted", "approximated", "unconverted")}[stage]
    new = told(df, said) | counted(df, stage, {k: F.greatest(n(k), F.lit(0)) for k in counters})
    lines, shield = F.coalesce(F.transform("__out", lambda r: r["text"]), "lines"), F.coalesce(F.transform("__out", lambda r: r["shield"]), "shield")
    return apart(df, ("__spans", "__kinds", "__out"), __done=done, lines=lines, shield=shield, **new)


def tcy(df: DataFrame) -> DataFrame:
    """Upright runs of one to four letters, digits, ! or ?, in brackets of their own."""
    note = "［＃「([^」]*)」は縦中横］"

    def of(gap: Column, hit: Column, q: Column, head: Column) -> Column:
        reason = (
            F.when(q == "", "empty")
            .when(~q.rlike(r"\A[A-Za-z0-9!?]{1,4}\z"), "invalid-body")
            .when(F.endswith(gap, F.concat(F.lit("｟"), q, F.lit("｠"))), "existing-tcy")
            .when(~F.endswith(gap, q), "target-mismatch")
            .when(head.rlike(r"｟[^｠\n]*\z"), "existing-tcy")
            .when(in_ruby(head, hit), "ruby-context")
        )
        kept = lambda why: piece(F.concat(gap, hit), "unconverted", hit, "TCY_NOT_CONVERTED", why)
        return bound(reason, lambda why: F.when(why.isNotNull(), kept(why)).otherwise(piece(F.concat(head, F.lit("｟"), q, F.lit("｠")), "converted")))

    def convert(gap, hit):
        return bound(F.regexp_extract(hit, note, 1), lambda q: bound(before(gap, q), lambda head: of(gap, hit, q, head)))

    return over_rows(df, lambda rows: _on_notes(rows, "tcy", note + _RUBY_AFTER, convert, ("converted", "unconverted")))


def emphasis(df: DataFrame) -> DataFrame:
    """Bold and italic: blocks of rows, two notes on one target, one note, nested and single ranges; targets with an asterisk are refused."""
    counters = ("bold", "italic", "both", "unconverted")
    mark = lambda kind: F.when(kind == "太字", "**").otherwise("*")
    name = lambda kind: F.when(kind == "太字", "bold").otherwise("italic")
    starred = lambda text: F.contains(text, F.lit("*"))
    df = gathered(df, "emphasis", rf"{_EDGE}［＃ここから(太字|斜体)］{_END}", rf"{_EDGE}［＃ここで(太字|斜体)終わり］{_END}", lambda text, kind: F.concat(mark(kind), text, mark(kind)), name, starred, "EMPHASIS_NOT_CONVERTED")
    one = "［＃「([^」]+)」は(太字|斜体字?)］"

    def both(gap, hit):
        q, k = F.regexp_extract(hit, one, 1), F.regexp_extract(hit, one, 2)
        q2, k2 = F.regexp_extract(hit, one + one, 3), F.regexp_extract(hit, one + one, 4)
        t = F.when((q == q2) & ((k == "太字") != (k2 == "太字")), target(gap, q))
        good = t.isNotNull() & ~starred(t)
        return F.when(good, piece(F.concat(before(gap, t), F.lit("***"), t, F.lit("***")), "both")).otherwise(piece(F.concat(gap, hit)))

    def single(gap, hit):
        q, k = F.regexp_extract(hit, one, 1), F.regexp_extract(hit, one, 2)
        t = target(gap, q)
        good = t.isNotNull() & ~starred(t)
        kept = piece(F.concat(gap, hit), "unconverted", hit, "EMPHASIS_NOT_CONVERTED", F.when(t.isNull(), "target-mismatch").otherwise("asterisk"))
        return F.when(good, piece(F.concat(before(gap, t), mark(k), t, mark(k)), name(k))).otherwise(kept)

    nest = r"［＃(太字|斜体)］［＃(太字|斜体)］((?:(?!［＃)[^\n])+?)［＃\2終わり］［＃\1終わり］"

    def nested(gap, hit):
        body = F.regexp_extract(hit, nest, 3)
        good = (F.regexp_extract(hit, nest, 1) != F.regexp_extract(hit, nest, 2)) & ~starred(body)
        return F.when(good, piece(F.concat(gap, F.lit("***"), body, F.lit("***")), "both")).otherwise(piece(F.concat(gap, hit)))

    def ranged(kind: str):
        note = rf"［＃{kind}］([^\n]*?)［＃{kind}終わり］"

        def convert(gap, hit):
            body = F.regexp_extract(hit, note, 1)
            good = (body != "") & ~starred(body) & ~body.rlike("［＃|\r")
            return F.when(good, piece(F.concat(gap, mark(F.lit(kind)), body, mark(F.lit(kind))), name(F.lit(kind)))).otherwise(piece(F.concat(gap, hit)))

        return note, convert

    left = lambda gap, hit: piece(F.concat(gap, hit), "unconverted", hit, "EMPHASIS_NOT_CONVERTED", "unsupported-range")
    for pattern, convert in ((one + one, both), (one, single), (nest, nested), ranged("太字"), ranged("斜体"), ("［＃(?:太字|斜体)］", left)):
        df = _on_notes(df, "emphasis", pattern, convert, counters, "__done")
    return df.drop("__done")


def underline(df: DataFrame, html: bool = False, approximate_styles: bool = False, approximate_left: bool = False) -> DataFrame:
    """Lines beside a block, a target or a range; other styles and the left side only if they may be approximated."""
    counters = ("converted", "approximated", "unconverted")
    a, b = ("<u>", "</u>") if html else ("||", "||")
    taken = (lambda t: t.rlike("(?i)</?u>")) if html else (lambda t: F.contains(t, F.lit("||")))

    def kind(left: Column, style: Column) -> Column:
        plain = style == "傍線"
        return F.when(plain & ~left, "converted").when(plain & left & F.lit(approximate_left), "approximated").when(~plain & F.lit(approximate_styles) & (~left | F.lit(approximate_left)), "approximated")

    of_head = lambda head: kind(F.startswith(head, F.lit("左に")), F.regexp_replace(head, r"\A左に", ""))
    head = f"((?:左に)?(?:{STYLES}))"
    df = gathered(df, "underline", f"{_EDGE}［＃ここから{head}］{_END}", f"{_EDGE}［＃ここで{head}終わり］{_END}", lambda text, kind: F.concat(F.lit(a), text, F.lit(b)), of_head, taken, "UNDERLINE_NOT_CONVERTED")
    # a following mark is read along with the note: between two marks its target is underlined already
    forward = rf"［＃「([^」]+)」(の左)?に({STYLES})］(\|\||(?i:</u>))?"

    def single(gap, hit):
        q, k = F.regexp_extract(hit, forward, 1), kind(F.regexp_extract(hit, forward, 2) != "", F.regexp_extract(hit, forward, 3))
        t, after = target(gap, q), F.regexp_extract(hit, forward, 4)
        rest = before(gap, t)
        inside = ((after == "||") & F.endswith(rest, F.lit("||"))) | ((F.lower(after) == "</u>") & rest.rlike(r"(?i)<u>\z"))
        good = k.isNotNull() & t.isNotNull() & ~taken(t) & ~inside
        return F.when(good, piece(F.concat(rest, F.lit(a), t, F.lit(b), after), k)).otherwise(piece(F.concat(gap, hit)))

    between = rf"［＃{head}］([^\n]*?)［＃\1終わり］"

    def ranged(gap, hit):
        k, body = of_head(F.regexp_extract(hit, between, 1)), F.regexp_extract(hit, between, 2)
        good = k.isNotNull() & (body != "") & ~taken(body) & ~body.rlike("［＃|\r")
        return F.when(good, piece(F.concat(gap, F.lit(a), body, F.lit(b)), k)).otherwise(piece(F.concat(gap, hit)))

    left = lambda gap, hit: piece(F.concat(gap, hit), "unconverted", hit, "UNDERLINE_NOT_CONVERTED", "left-over")
    for pattern, convert in ((forward, single), (between, ranged), (f"［＃「[^」]+」(?:の左)?に(?:{STYLES})］|［＃{head}］", left)):
        df = _on_notes(df, "underline", pattern, convert, counters, "__done")
    return df.drop("__done")


def marked(text: Column, mark: str) -> Column:
    """A mark as ruby at every character that is no white space."""
    return F.array_join(F.transform(code_points(text), lambda ch: F.when(is_space(ch), ch).otherwise(F.concat(F.lit("｜"), ch, F.lit(f"《{mark}》")))), "")


def bouten(df: DataFrame, mark: str = "﹅") -> DataFrame:
    """A mark at every character of a range or a target that is no white space; ruby in or around it is refused."""
    mark = mark[:1] or "﹅"
    between, forward = rf"［＃({MARKS})］((?s:.*?))［＃\1終わり］", f"［＃「([^」]*)」に(?:{MARKS})］"
    refuse = lambda gap, hit, why: piece(F.concat(gap, hit), "unconverted", hit, F.when(why == "ruby-context", "BOUTEN_RUBY_CONTEXT").when(why == "tcy-overlap", "BOUTEN_NOT_CONVERTED"), why)

    def ranged(gap, hit):
        body = F.regexp_extract(hit, between, 2)
        why = F.when(body.rlike("[｟｠]"), "tcy-overlap").when(in_ruby(gap, hit), "ruby-context").when(body.rlike("[｜《》\r\n]|［＃") | (strip(body) == ""), "unsupported")
        return F.when(why.isNotNull(), refuse(gap, hit, why)).otherwise(piece(F.concat(gap, marked(body, mark)), "converted"))

    def single(gap, hit):
        q = F.regexp_extract(hit, forward, 1)
        has = (q != "") & F.endswith(gap, q)
        head = before(gap, q)
        why = F.when((has & (q.rlike("[｟｠]") | head.rlike(r"｟[^｠\n]*\z"))) | F.endswith(gap, F.concat(F.lit("｟"), q, F.lit("｠"))), "tcy-overlap").when(~has | q.rlike("[｜《》]"), "target-mismatch").when(in_ruby(head, hit), "ruby-context")
        return F.when(why.isNotNull(), refuse(gap, hit, why)).otherwise(piece(F.concat(head, marked(q, mark)), "converted"))

    left = lambda gap, hit: piece(F.concat(gap, hit), "unconverted")
    def passes(df: DataFrame) -> DataFrame:
        for pattern, convert in ((between + _RUBY_AFTER, ranged), (forward + _RUBY_AFTER, single), (f"［＃「[^」]*」の左に(?:{MARKS})］|［＃左に(?:{MARKS})］", left)):
            df = _on_notes(df, "bouten", pattern, convert, ("converted", "unconverted"))
        return df

    return over_rows(df, passes, MARKS)


def heading_base(text: Column) -> Column:
    """A title without ruby and without the markup of earlier stages; null where ruby marks are left."""
    out = F.regexp_replace(text, r"\*{1,3}([^*\n]+)\*{1,3}", "$1")
    out = F.regexp_replace(F.regexp_replace(out, r"\|\|([^|\n]+)\|\||(?i:<u>)([^<\n]+)(?i:</u>)", "$1$2"), "｟([A-Za-z0-9!?]{1,4})｠", "$1")
    out = F.regexp_replace(F.regexp_replace(out, "｜([^｜《》\n]+)《[^｜《》\n]*》", "$1"), r"([\p{IsHan}々〆ヵヶ]+)《[^｜《》\n]*》", "$1")
    return F.when(~out.rlike("[｜《》]"), out)


def headings(df: DataFrame, levels: tuple[int, int, int] = (2, 3, 4)) -> DataFrame:
    """Whole-line headings: a range over one or more rows, or named by their own text; their indent goes in front of the title."""
    lead = rf"{_EDGE}(?:［＃([０-９0-9]+)字下げ］)?"
    level = f"({'|'.join(LEVELS)})"
    marks = lambda name: F.element_at(F.create_map(*(x for k, n in zip(LEVELS, levels) for x in (F.lit(k), F.lit("#" * n)))), name)
    deep = lambda digits: F.repeat(F.lit("　"), F.when(digits == "", 0).otherwise(F.least(F.coalesce(fullwidth_digits(digits).try_cast("bigint"), F.lit(40)), F.lit(40)).cast("int")))
    begins = rf"{lead}［＃(?:ここから)?{level}見出し］"
    df = _joined_headings(df, begins)
    ranges = [rf"{lead}［＃ここから{level}見出し］(.*?)［＃ここで\2見出し終わり］{_END}", rf"{lead}［＃{level}見出し］(.*?)［＃\2見出し終わり］{_END}"]
    forward = rf"{lead}([^\n［]+?)(［＃「([^」]*)」は{level}見出し］){_END}"
    unsupported = "［＃「[^」]*」は(?:同行|窓)(?:大|中|小)見出し］|［＃(?:ここから)?(?:同行|窓)(?:大|中|小)見出し］"

    def each(line):
        out = piece(line)
        body, quoted = F.regexp_extract(line, forward, 2), F.regexp_extract(line, forward, 4)
        base = heading_base(body)
        same = (quoted != "") & base.isNotNull() & ((strip(body) == quoted) | (strip(base) == quoted))
        titled = piece(F.concat(marks(F.regexp_extract(line, forward, 5)), F.lit(" "), deep(F.regexp_extract(line, forward, 1)), strip(body)), "converted")
        out = F.when(line.rlike(forward), F.when(same & (strip(body) != ""), titled).when(~same, piece(line, None, F.regexp_extract(line, forward, 3), "HEADING_TARGET_MISMATCH", "target-mismatch")).otherwise(out)).otherwise(out)
        for p in reversed(ranges):
            title = strip(F.regexp_replace(F.regexp_extract(line, p, 3), "\v", " "))
            out = F.when(line.rlike(p) & (title != ""), piece(F.concat(marks(F.regexp_extract(line, p, 2)), F.lit(" "), deep(F.regexp_extract(line, p, 1)), title), "converted")).otherwise(out)
        return F.array(out)

    df = notes_pass(df, "headings", each, ("converted",))
    return _on_notes(df, "headings", unsupported, lambda gap, hit: piece(F.concat(gap, hit), "unsupported"), ("unsupported",))


def _joined_headings(df: DataFrame, begins: str) -> DataFrame:
    """Puts a heading range that runs over rows into one row, its stripped rows joined by blanks.

    An ending that never comes before a shielded row or the end leaves the rows as they are."""
    closing = r"［＃(?:ここで)?(?:大|中|小)見出し終わり］[ \t　\r]*\z"
    some = F.col("noted") & F.exists("lines", lambda x: x.rlike(begins) & ~F.contains(x, F.lit("見出し終わり］")))
    df = _laid(df, some, {"begin": lambda x: x.rlike(begins) & ~x.rlike("見出し終わり］"), "closes": lambda x: x.rlike(closing)})

    def step(head: Column, r: Column) -> tuple[Column, Column]:
        opened = head >= 0
        ends = opened & ~r["shield"] & r["closes"]
        now = F.when(opened & (r["shield"] | r["closes"]), -1).when(~opened & ~r["shield"] & r["begin"], r["i"]).otherwise(head)
        return now, F.when(ends, _span(head, r["i"], F.lit(None).cast("string"), "joined"))

    df = _spans(df, F.lit(-1), step)

    def joined(first: Column, last: Column) -> Column:
        rows = F.filter(F.transform(F.slice("lines", first + 1, last - first + 1), strip), lambda x: x != "")
        return F.regexp_replace(F.regexp_replace(F.array_join(rows, " "), "(見出し］) ", "$1"), " (［＃(?:ここで)?(?:大|中|小)見出し終わり］)", "$1")

    row = lambda text, shield: F.struct(text.alias("text"), shield.alias("shield"))
    laid = lambda r, c: F.when(c.isNull(), row(r["line"], r["shield"])).when(r["i"] == c["first"], row(joined(c["first"], c["last"]), F.lit(False)))
    df = apart(df, ("__rows", "__spans", "__cover"), __out=F.filter(F.zip_with("__rows", "__cover", laid), lambda x: x.isNotNull()))
    return apart(df, ("__out",), lines=F.coalesce(F.transform("__out", lambda r: r["text"]), "lines"), shield=F.coalesce(F.transform("__out", lambda r: r["shield"]), "shield"))


def character(inner: Column) -> Column:
    """The character that a note names by its code point, or else by its place in JIS X 0213; null for neither."""
    s = fullwidth_digits(inner)
    hexa = F.regexp_extract(s, r"(?i)U\+([0-9A-F]{1,6})(?![0-9A-F])", 1)
    code = F.conv(hexa, 16, 10).cast("bigint")
    valid = (hexa != "") & (code >= 32) & (code != 127) & ~code.between(128, 159) & ~code.between(0xD800, 0xDFFF) & (code <= 0x10FFFF)
    level, bare = r"第[34]水準(?:漢字)?(\p{Nd})[-－](\p{Nd}+)[-－](\p{Nd}+)", r"(?<![0-9])([12])[-－](\p{Nd}+)[-－](\p{Nd}+)(?![0-9])"
    part = lambda k: F.when(s.rlike(level), F.regexp_extract(s, level, k)).otherwise(F.regexp_extract(s, bare, k)).try_cast("int")
    return F.when(valid, F.decode(F.unhex(F.lpad(hexa, 8, "0")), "UTF-32")).otherwise(jis.at(part(1), part(2), part(3)))


def gaiji(df: DataFrame) -> DataFrame:
    """Characters by code point or by their place in JIS X 0213, instead of a quoted stand-in or of a ※ note; other notes stay."""
    known = r"(?:[Uu]\+[0-9A-Fa-f０-９]|[12１２][-－]\p{Nd}+[-－]\p{Nd}+)"
    stand_in, spare = f"［＃「([^」]+)」は([^］]*{known}[^］]*)］", "※［＃([^］]*)］"

    def replaced(gap, hit):
        q, value = F.regexp_extract(hit, stand_in, 1), character(F.regexp_extract(hit, stand_in, 2))
        good = value.isNotNull() & F.endswith(gap, q)
        return F.when(good, piece(F.concat(before(gap, q), value), "converted")).otherwise(piece(F.concat(gap, hit), "unconverted"))

    def named(gap, hit):
        value = character(F.regexp_extract(hit, spare, 1))
        return F.when(value.isNotNull(), piece(F.concat(gap, value), "converted")).otherwise(piece(F.concat(gap, hit), "unconverted"))

    def passes(df: DataFrame) -> DataFrame:
        for pattern, convert in ((stand_in, replaced), (spare, named)):
            df = _on_notes(df, "gaiji", pattern, convert, ("converted", "unconverted"))
        return df

    return over_rows(df, passes)
