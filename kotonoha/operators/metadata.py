"""Bibliographic metadata: the header in front of a text, front matter, and names for files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kotonoha.functions.text import strip
from kotonoha.operators.inline import told
from kotonoha.operators.notes import apart, bound, front_rows

#: A scalar that YAML reads as the same plain string: no indicator in front, no separator inside, no word or number with a type.
_PLAIN = r"\A(?![-?:,\[\]{}#&*!|>'\"%@`\s])(?!(?i:null|true|false|~|\.inf|\.nan|[-+]?[0-9.][0-9_.eE+-]*|0x[0-9a-f]+|0o[0-7]+)\z)(?:(?!: |:\z| #)[^\x00-\x1f\x7f])*(?<![\s])\z"


def parse_header(df: DataFrame) -> DataFrame:
    """Adds header<title, author, authors, translator, translators, raw_header> and body_line, the number of lines before the body.

    The header are the lines before the first blank one: a title; a title and an author; or more, where
    lines that end in 訳 are translators and the line before the first of them is the author."""
    df = apart(df, __first=(F.array_position(F.transform("lines", lambda x: F.length(strip(x)) == 0), F.lit(True)) - 1).cast("int"))
    first = F.col("__first")
    shielded = F.exists(F.slice("shield", F.lit(1), F.greatest(first, F.lit(0))), lambda s: s)
    df = apart(df, ("__first",), __h=F.transform(F.slice("lines", F.lit(1), F.when((first > 0) & ~shielded, first).otherwise(0)), strip))
    h, n = F.col("__h"), F.size("__h")
    places = F.transform(h, lambda v, i: F.struct(i.alias("i"), (F.endswith(v, F.lit("訳")) & (i > 0)).alias("by")))
    by = F.transform(F.filter(places, lambda x: x["by"]), lambda x: x["i"])
    df = apart(df, __by=F.when(n >= 3, by).otherwise(F.slice(by, 1, 0)))
    by, n_by = F.col("__by"), F.size("__by")
    at = F.get(by, F.lit(0)) - 1
    author_at = F.when(n_by > 0, F.when(at >= 1, at)).when(n == 2, F.lit(1)).when(n == 3, F.lit(2))
    named = F.transform(by, lambda i: F.get(h, i))
    used = F.concat(F.array(F.lit(0)), by, F.array(F.coalesce(author_at, F.lit(-1))))
    others = F.filter(h, lambda v, i: ~F.array_contains(used, i))
    none, text = F.lit(None).cast("array<string>"), F.lit(None).cast("string")
    header = F.struct(
        F.get(h, F.lit(0)).alias("title"),
        F.when(author_at.isNotNull(), F.get(h, author_at)).otherwise(text).alias("author"),
        F.when((n > 3) & (n_by == 0), F.slice(h, F.lit(3), n)).otherwise(none).alias("authors"),
        F.when(n_by == 1, F.get(named, F.lit(0))).otherwise(text).alias("translator"),
        F.when(n_by > 1, named).otherwise(none).alias("translators"),
        F.when(n < 3, text).when(n_by == 0, F.get(h, F.lit(1))).when(F.size(others) > 0, F.array_join(others, "\n")).alias("raw_header"),
    )
    rest = F.slice("lines", n + 1, F.size("lines"))
    blank = F.array_position(F.transform(rest, lambda x: F.when(x == "", "").otherwise("x")), "x") - 1  # body starts at the first line that is not empty
    body = F.when(n > 0, n + F.when(blank < 0, F.size(rest)).otherwise(blank)).otherwise(0)
    return apart(df, ("__h", "__by"), header=header, body_line=body.cast("int"))


def reconstruct_header(header: Column) -> Column:
    """The header's lines in order of title, rest, authors, translators, and a blank line; empty without any."""
    many = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: strip(x) != "")
    pick = lambda xs, x: F.when(F.size(many(xs)) > 0, F.array_join(many(xs), "\n")).otherwise(x)
    parts = F.concat_ws("\n", header["title"], F.regexp_replace(header["raw_header"], r"\n\z", ""), pick(header["authors"], header["author"]), pick(header["translators"], header["translator"]))
    return F.when(parts == "", "").otherwise(F.concat(parts, F.lit("\n\n")))


def naming(header: Column) -> Column:
    """<title, author>: what files are named by; the first of several authors."""
    return F.struct(header["title"].alias("title"), F.coalesce(F.get(header["authors"], F.lit(0)), header["author"]).alias("author"))


def scalar(value: Column) -> Column:
    """A YAML scalar: plain if it reads back as the same string, in double quotes if not."""
    quoted = F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r"\A\{\"v\":(.*)\}\z", 1)
    return F.when(value.rlike(_PLAIN), value).otherwise(quoted)


def front_matter(header: Column) -> Column:
    """The YAML envelope of a header, null without a title."""
    line = lambda key: F.when(header[key].isNotNull(), F.concat(F.lit(f"{key}: "), scalar(header[key])))
    items = lambda key: F.when(F.size(header[key]) > 0, F.concat(F.lit(f"{key}:\n"), F.array_join(F.transform(header[key], lambda v: F.concat(F.lit("  - "), scalar(v))), "\n")))
    raw = F.when(header["raw_header"].isNotNull(), F.concat(F.lit("raw_header: |-\n  "), F.replace(header["raw_header"], F.lit("\n"), F.lit("\n  "))))
    body = F.concat_ws("\n", line("title"), line("author"), items("authors"), line("translator"), items("translators"), raw)
    return F.when(header["title"].isNotNull(), F.concat(F.lit("---\n"), body, F.lit("\n---\n")))


def add_front_matter(df: DataFrame, keep_header: bool = False, add: bool = True) -> DataFrame:
    """Puts the header into front matter in front of the body (add), or a header from front matter that is there into the body (keep_header).

    Front matter that is not ok is told and left. A header is not restored where one of the first ten rows of the body
    is its title already. Adds text, naming, front_matter_added and front_matter_restored; front and front_end are read unless they are there."""
    df = parse_header(df if "front_end" in df.columns else read_front_matter(df))
    front, exists = F.col("front"), F.col("front").isNotNull()
    said = F.when(exists & front["code"].isNotNull(), F.array(F.struct(F.lit("frontmatter").alias("stage"), front["code"].alias("code"), F.lit(1).alias("line"), F.lit(None).cast("string").alias("note"), front["reason"].alias("reason"))))
    own = lambda first: F.slice("lines", first + 1, F.size("lines"))
    envelope = front_matter(F.col("header"))
    kept = F.concat(reconstruct_header(F.col("header")), F.array_join(own(F.col("body_line")), "\n")) if keep_header else F.array_join(own(F.col("body_line")), "\n")
    added = ~exists & envelope.isNotNull() & F.lit(add)
    rows = own(F.col("front_end"))
    blank = F.array_position(F.transform(rows, lambda x: F.when(x == "", "").otherwise("x")), "x") - 1
    body = F.when(exists & front["ok"] & F.lit(keep_header), F.slice(rows, F.when(blank < 0, F.size(rows) + 1).otherwise(blank + 1).cast("int"), F.size(rows)))
    df = apart(df, __body=body, **told(df, said))
    stands = F.coalesce(F.exists(F.slice("__body", 1, 10), lambda x: strip(x) == front["title"]) & (front["title"] != ""), F.lit(False))
    restored = F.col("__body").isNotNull() & ~stands
    back = F.concat(F.array_join(F.slice("lines", F.lit(1), F.col("front_end")), "\n"), F.lit("\n"), reconstruct_header(front), F.array_join("__body", "\n"))
    text = F.when(restored, back).when(added, F.concat(envelope, F.lit("\n"), kept)).otherwise(F.array_join("lines", "\n"))
    named = F.when(~exists, naming(F.col("header"))).when(front["ok"], naming(front))
    return apart(df, ("__body",), text=text, naming=named, front_matter_added=added, front_matter_restored=restored)


def naming_of(df: DataFrame) -> DataFrame:
    """Adds naming, what a file is named by: its front matter where there is any, null if that is not ok, else its header."""
    df = parse_header(read_front_matter(df))
    return apart(df, naming=F.when(F.col("front").isNull(), naming(F.col("header"))).when(F.col("front.ok"), naming(F.col("front"))))


def read_front_matter(df: DataFrame) -> DataFrame:
    """Adds front<ok, code, reason, title, author, authors, translator, translators, raw_header> from the front matter on a text's first lines, null where there is none, and front_end, its number of rows.

    Read are block mappings of scalars (plain, quoted, literal or folded blocks) and of block or flow lists. A rule within a block
    or a quotation closes nothing. FRONTMATTER_PARSE_FAILED: an envelope that is never closed, another form at the top, a key that is
    repeated, aliases or tags; FRONTMATTER_INVALID_TYPE: a mapping or list where a text belongs. A single author may stand for the list."""
    rule = r"\A[ \t]*---[ \t]*\r?\z"
    df = apart(df, front_end=F.when(F.get("lines", F.lit(0)).rlike(rule), front_rows(F.col("lines"))).otherwise(0))
    df = apart(df, __fm=F.when(F.col("front_end") > 0, F.slice("lines", F.lit(2), F.col("front_end") - 2)))
    key = r"\A([A-Za-z_][A-Za-z0-9_-]*):(?:[ \t]+(.*?))?[ \t\r]*\z"
    entry = "struct<key:string,value:string,rows:array<string>>"
    state = lambda entries, ok: F.struct(entries.alias("entries"), ok.alias("ok"))
    last = lambda s: F.element_at(s["entries"], -1)

    def step(s, line):
        new = F.struct(F.regexp_extract(line, key, 1).alias("key"), F.regexp_extract(line, key, 2).alias("value"), F.array().cast("array<string>").alias("rows"))
        more = F.concat(F.slice(s["entries"], F.lit(1), F.size(s["entries"]) - 1), F.array(F.struct(last(s)["key"].alias("key"), last(s)["value"].alias("value"), F.array_append(last(s)["rows"], line).alias("rows"))))
        inner = (F.size(s["entries"]) > 0) & line.rlike(r"\A(?:[ \t]|-[ \t]|[ \t\r]*\z)")
        return F.when(inner, state(more, s["ok"])).when(line.rlike(key), state(F.array_append(s["entries"], new), s["ok"])).when(line.rlike(r"\A[ \t\r]*(?:#.*)?\z"), s).otherwise(state(s["entries"], F.lit(False)))

    df = apart(df, ("__fm",), __e=F.when(F.col("__fm").isNotNull(), F.aggregate("__fm", state(F.array().cast(f"array<{entry}>"), F.lit(True)), step)))
    entries = F.col("__e.entries")
    keys = F.transform(entries, lambda e: e["key"])
    item, nested = r"\A[ \t]*-[ \t]", r"\A[ \t]*(?:-[ \t]+)?[^\s\"'#:\[{-][^:]*:(?:[ \t]|\z)"
    odd = F.exists(entries, lambda e: e["value"].rlike(r"\A[&*!]") | F.exists(e["rows"], lambda x: x.rlike(r"\A[ \t]*-[ \t]+[&*!]")))
    cut = F.exists(entries, lambda e: e["value"].rlike(r"\A\[[^\]]*\z") | e["value"].rlike(r"\A\{[^}]*\z"))
    sound = F.col("__e.ok") & (F.size(F.array_distinct(keys)) == F.size(keys)) & ~odd & ~cut
    block = lambda e: e["value"].rlike(r"\A[|>]")
    is_map = lambda e: e["value"].rlike(r"\A\{") | ((e["value"] == "") & F.exists(e["rows"], lambda x: x.rlike(nested) & ~x.rlike(item)))
    is_list = lambda e: e["value"].rlike(r"\A\[") | ((e["value"] == "") & F.exists(e["rows"], lambda x: x.rlike(item)))
    deep = lambda e: e["value"].rlike(r"\A\[.*[\[{].*\]") | F.exists(e["rows"], lambda x: x.rlike(r"\A[ \t]*-[ \t]+[\[{]") | (x.rlike(item) & x.rlike(nested)))
    wrong = F.filter(entries, lambda e: ~block(e) & ((e["key"].isin("title", "author", "translator", "raw_header") & (is_map(e) | is_list(e))) | (e["key"].isin("authors", "translators") & (is_map(e) | deep(e)))))
    found = lambda name: F.get(F.filter(entries, lambda e: e["key"] == name), F.lit(0))

    def plain(v: Column) -> Column:
        """A scalar's string; null for the words and signs of nothing."""
        double = F.from_json(F.concat(F.lit('{"v":'), v, F.lit("}")), "v string")["v"]
        bare = F.regexp_replace(v, r"[ \t]+#.*\z", "")
        return F.when(v.rlike(r"\A\".*\"\z"), double).when(v.rlike(r"\A'.*'\z"), F.replace(F.substring(v, F.lit(2), F.length(v) - 2), F.lit("''"), F.lit("'"))).when(bare.rlike(r"\A(?:~|null|Null|NULL|)\z"), None).otherwise(bare)

    def whole(e: Column) -> Column:
        """A value with the rows that it goes on over, which are joined by blanks."""
        more = F.filter(F.transform(e["rows"], strip), lambda x: x != "")
        return F.when((F.size(more) > 0) & ~is_list(e) & ~is_map(e), F.concat_ws(" ", F.nullif(e["value"], F.lit("")), F.array_join(more, " "))).otherwise(e["value"])

    def scalar_of(e: Column) -> Column:
        deeper = F.length(F.regexp_extract(F.get(F.filter(e["rows"], lambda x: strip(x) != ""), F.lit(0)), r"\A *", 0))
        rows = F.transform(e["rows"], lambda x: F.regexp_replace(F.substring(x, F.least(deeper, F.length(x)) + 1, F.length(x)), r"\r\z", ""))
        ended = lambda text: F.when(e["value"].rlike(r"\+"), F.concat(text, F.lit("\n"))).when(e["value"].rlike("-"), F.regexp_replace(text, r"\n+\z", "")).otherwise(F.concat(F.regexp_replace(text, r"\n+\z", ""), F.lit("\n")))
        text = lambda t: F.when(e["value"].rlike(r"\A>"), F.regexp_replace(t, r"(?<!\n)\n(?=[^\n])", " ")).otherwise(t)
        return F.when(e.isNull(), None).when(block(e), bound(bound(F.array_join(rows, "\n"), ended), text)).otherwise(bound(whole(e), plain))

    def list_of(e: Column) -> Column:
        items = F.transform(F.filter(e["rows"], lambda x: x.rlike(item)), lambda x: bound(strip(F.regexp_replace(x, r"\A[ \t]*-[ \t]+", "")), plain))
        flow = F.transform(F.split(F.regexp_extract(e["value"], r"\A\[(.*)\]\z", 1), ","), lambda x: bound(strip(x), plain))
        some = F.filter(F.when(e["value"].rlike(r"\A\[.*\]\z"), flow).when(is_list(e), items).otherwise(F.array(bound(whole(e), plain))), lambda x: x.isNotNull() & (strip(x) != ""))
        return F.when(e.isNotNull(), bound(some, lambda x: F.when(F.size(x) > 0, x)))

    df = apart(df, __sound=sound, __odd=odd, __wrong=wrong)
    broken, mistyped = (F.col("front_end") < 0) | ~F.col("__sound"), F.size("__wrong") > 0
    code = F.when(broken, "FRONTMATTER_PARSE_FAILED").when(mistyped, "FRONTMATTER_INVALID_TYPE")
    reason = F.when(F.col("front_end") < 0, "unclosed-envelope").when(broken, F.when(F.col("__odd"), "alias-or-tag").otherwise("invalid-mapping")).when(mistyped, F.get("__wrong", F.lit(0))["key"])
    front = F.struct(code.isNull().alias("ok"), code.alias("code"), reason.alias("reason"), *(bound(found(n), f).alias(n) for n, f in (("title", scalar_of), ("author", scalar_of), ("authors", list_of), ("translator", scalar_of), ("translators", list_of), ("raw_header", scalar_of))))
    return apart(df, ("__e", "__sound", "__odd", "__wrong"), front=F.when(F.col("front_end") != 0, front))


def plain_fields(df: DataFrame) -> DataFrame:
    """Adds fields, an array of <key, value, items> by key: front matter as keys and values row by row, for comparison with older output; null without an envelope or fields.

    A row that has a colon and begins with no blank is a field, its value as it stands, quotes and all. authors and translators
    without a value have the rows below that begin with two blanks and a hyphen as items. Of repeated keys the last counts."""
    rule = F.transform("lines", lambda x: F.when(strip(x) == "---", "-").otherwise("x"))
    end = F.array_position(F.slice(rule, F.lit(2), F.size("lines")), "-")
    df = apart(df, __rows=F.when((F.get(rule, F.lit(0)) == "-") & (end > 0), F.array_join(F.slice("lines", F.lit(2), (end - 1).cast("int")), "\n")))
    field = r"(?<![^\n])(?! )([^:\n]*):([^\n]*)((?:\n  - [^\n]*)*+)"
    part = lambda x, k: F.regexp_extract(x, field, k)
    item = lambda x: strip(F.substring(x, F.lit(5), F.length(x)))
    items = lambda x: F.transform(F.filter(F.split(part(x, 3), "\n", -1), lambda y: y != ""), item)
    read = F.transform(F.regexp_extract_all("__rows", F.lit(field), F.lit(0)), lambda x, i: F.struct(strip(part(x, 1)).alias("key"), (-i).alias("at"), F.nullif(strip(part(x, 2)), F.lit("")).alias("value"), items(x).alias("items")))
    df = apart(df, ("__rows",), __read=F.array_sort(F.filter(read, lambda x: x["value"].isNotNull() | x["key"].isin("authors", "translators"))))
    last = F.filter("__read", lambda x, i: (i == 0) | ~F.get("__read", i - 1)["key"].eqNullSafe(x["key"]))
    kept = F.transform(last, lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value"), F.when(x["value"].isNull(), x["items"]).alias("items")))
    return apart(df, ("__read",), fields=F.when(F.size(kept) > 0, kept))
