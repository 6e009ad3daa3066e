"""Operator 8: secrets by patterns and by sliding-window entropy, with SQL functions only.

Base spans, leftmost and non-overlapping for each kind: assignments to a password-like name, access
key ids, long runs of hexadecimal digits. Entropy spans lie in what base spans leave: candidates are
runs of CANDIDATE characters there; a window of WINDOW characters slides over each and
the sum of c*log2(c) over its characters' counts is kept up step by step (by the count of the character that
leaves and of the one that enters among those that stay), so that the window's Shannon entropy is
log2(WINDOW) minus that sum over WINDOW. The span runs from the first to the last window that
reaches the threshold of the candidate's character class. Candidates on the allow-list (plain words,
plain numbers, paths of words and numbers) are suppressed, and spans that hold a placeholder; base spans always stay.

A text is cut into characters once and into matches once, and positions are sums by two levels of pieces, so that the
work grows with the length of a text, of a candidate and with the number of matches.

Offsets are code points, ends exclusive. Defined results: a null or empty text has no spans; rows
depend on nothing but themselves, so ties, repeated rows, hot sources and empty tables need no care;
a null id keeps its row; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kotonoha.llm.common import documents, text_rows

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A maximal run that is too short holds no longer one, so the lengths stand in the patterns.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "entropy")
VALUE, WINDOW = 6, 20
#: Entropy in bits that a window must reach, by the class of its candidate; the first class that fits holds.
CLASSES = (("^[0-9a-fA-F]+$", 3.0), ("^[A-Z2-7=]+$", 3.4), ("^[A-Za-z0-9]+$", 3.6), ("", 3.8))
#: Candidates that are no secrets, and words that mark a span as a placeholder.
PLAIN = ("^[A-Za-z_=+/-]+$", "^[0-9_=+/-]+$")
PLACEHOLDER = "(?i)example|placeholder|changeme|dummy|sample|your_|xxxx"
#: A path of words begins with a word and has no part that is empty, longer than twelve characters, or of letters and digits mixed.
PATH, NO_PATH = "^[A-Za-z]+[/_-]", "[=+]|[/_-](?:[/_-]|$)|[/_-][A-Za-z0-9]{13}|[A-Za-z][0-9]|[0-9][A-Za-z]"
#: Numbers that are put together one after the other.
PIECE = 256

_SPANS = "array<struct<start:int,end:int,found:string>>"


def scanned(xs: Column, step, zero: int) -> Column:
    """The numbers of an array, each put together with all before it by step, which is associative; piece by piece, as a growing array is copied at each step."""
    last = lambda a: F.coalesce(F.get(a, F.size(a) - 1), F.lit(zero))
    grow = lambda a, x: F.array_append(a, step(last(a), x))
    none = F.array().cast("array<int>")
    pieces = F.transform(F.sequence(F.lit(0), F.size(xs) - 1, F.lit(PIECE)), lambda k: F.aggregate(F.slice(xs, k + 1, F.lit(PIECE)), none, grow))
    before = F.aggregate(F.transform(pieces, last), F.array(F.lit(zero)), grow)
    out = F.flatten(F.zip_with(pieces, F.slice(before, F.lit(1), F.size(before) - 1), lambda a, b: F.transform(a, lambda x: step(b, x))))
    return F.when(F.size(xs) > 0, out).otherwise(none)


def _cut(text: Column, pattern: str) -> Column:
    """Every match with the size of it and of the text before it: the pieces between matches and the matches take turns."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    cut = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda f, b: F.struct(f.alias("found"), (F.length(b) + F.length(f)).alias("size")))
    return F.when(text.rlike(pattern), cut).otherwise(F.array().cast("array<struct<found:string,size:int>>"))


def _placed(cut: Column) -> Column:
    """The matches of a cut text as (start, end, found)."""
    ends = scanned(F.transform(cut, lambda c: c["size"]), lambda a, b: a + b, 0)
    return F.zip_with(ends, cut, lambda e, c: F.struct((e - F.length(c["found"])).alias("start"), e.alias("end"), c["found"].alias("found"))).cast(_SPANS)


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _term(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))


def windows(chars: Column, threshold: Column) -> Column:
    """(first, last): starts of the first and the last window of a candidate that reach the threshold, null without one."""
    zero = F.struct(F.lit(0.0).alias("total"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))

    def step(state: Column, at: Column) -> Column:
        stay = F.slice(chars, F.greatest(at - WINDOW + 2, F.lit(1)), F.least(at, F.lit(WINDOW - 1)))  # the window that ends here without the character that enters
        among = lambda ch: F.size(F.filter(stay, lambda x: x == ch))
        more, less = among(F.get(chars, at)), among(F.get(chars, F.greatest(at - WINDOW, F.lit(0))))
        total = state["total"] + _term(more + 1) - _term(more) + F.when(at >= WINDOW, _term(less) - _term(less + 1)).otherwise(F.lit(0.0))
        begin = at - WINDOW + 1
        reached = (begin >= 0) & (math.log2(WINDOW) - total / WINDOW >= threshold - 1e-9)
        return F.struct(total.alias("total"), F.when(reached, F.coalesce(state["first"], begin)).otherwise(state["first"]).alias("first"), F.when(reached, begin).otherwise(state["last"]).alias("last"))

    return F.aggregate(F.sequence(F.lit(0), F.size(chars) - 1), zero, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))


def _threshold(found: Column) -> Column:
    out = F.lit(CLASSES[-1][1])
    for pattern, bits in reversed(CLASSES[:-1]):
        out = F.when(found.rlike(pattern), bits).otherwise(out)
    return out


def _allowed(found: Column) -> Column:
    out = found.rlike(PATH) & ~found.rlike(NO_PATH)
    for pattern in PLAIN:
        out = out | found.rlike(pattern)
    return out


def _masked(text: Column, chars: Column, base: Column, reach: Column) -> Column:
    """The text with blanks instead of the spans of base, which is sorted; reach: the greatest end up to each span."""
    before = F.concat(F.array(F.lit(0)), reach)
    starts = F.concat(F.transform(base, lambda b: b["start"]), F.array(F.size(chars)))
    gaps = F.zip_with(before, starts, lambda a, b: F.struct(a.alias("from"), b.alias("to")))
    gaps = F.zip_with(gaps, reach, lambda g, r: F.struct(g["from"].alias("from"), g["to"].alias("to"), F.coalesce(r - F.greatest(g["from"], g["to"]), F.lit(0)).alias("covered")))

    def part(gap: Column) -> Column:
        plain = F.array_join(F.slice(chars, gap["from"] + 1, F.greatest(gap["to"] - gap["from"], F.lit(0))), "")
        return F.concat(plain, F.repeat(F.lit(" "), F.greatest(gap["covered"], F.lit(0))))

    return F.when(F.size(base) == 0, text).otherwise(F.array_join(F.transform(gaps, part), ""))


def _kind(spans: Column, kind: str) -> Column:
    k = KINDS.index(kind)
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end")))


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, entropy): arrays of (start, kind, end), kind an index of KINDS; base is sorted."""
    text = F.col("text")
    kinds = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}
    rows = text_rows(df, id_col, text_col).select("doc_id", "text", *(_cut(text, p).alias(k) for k, p in kinds.items()))
    rows = rows.select("doc_id", "text", *(_placed(F.col(k)).alias(k) for k in kinds))
    long = F.filter("assign", lambda s: F.length(F.regexp_extract(s["found"], ASSIGN, 2)) >= VALUE)
    rows = rows.select("doc_id", "text", F.array_sort(F.concat(_kind(long, "assign"), _kind(F.col("access"), "access"), _kind(F.col("hex"), "hex"))).alias("base"))
    some = F.size("base") > 0
    ends = F.transform("base", lambda b: b["end"])
    rows = rows.select("doc_id", "text", "base", F.when(some, _characters(text)).alias("chars"), F.when(some, scanned(ends, F.greatest, 0)).alias("reach"))
    rows = rows.select("doc_id", "base", _masked(text, F.col("chars"), F.col("base"), F.col("reach")).alias("left"))
    rows = rows.select("doc_id", "base", _cut(F.col("left"), CANDIDATE).alias("cut"))
    rows = rows.select("doc_id", "base", F.filter(_placed(F.col("cut")), lambda s: ~_allowed(s["found"])).alias("candidates"))
    cut = F.transform("candidates", lambda s: F.struct(s["start"].alias("start"), s["found"].alias("found"), _threshold(s["found"]).alias("least"), _characters(s["found"]).alias("chars")))
    rows = rows.select("doc_id", "base", cut.alias("candidates"))
    reach = F.transform("candidates", lambda s: F.struct(s["start"].alias("start"), s["found"].alias("found"), windows(s["chars"], s["least"]).alias("w")))
    rows = rows.select("doc_id", "base", F.filter(reach, lambda s: s["w"]["first"].isNotNull()).alias("reach"))
    kept = F.filter("reach", lambda s: ~F.substring(s["found"], s["w"]["first"] + 1, s["w"]["last"] - s["w"]["first"] + WINDOW).rlike(PLACEHOLDER))
    spans = F.transform(kept, lambda s: F.struct((s["start"] + s["w"]["first"]).alias("start"), F.lit(KINDS.index("entropy")).alias("kind"), (s["start"] + s["w"]["last"] + WINDOW).alias("end")))
    return rows.select("doc_id", "base", spans.alias("entropy"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *map(count, KINDS[:3]),
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "entropy"))).alias("spans"),
        F.size("entropy").cast("bigint").alias("n_entropy"),
    )
