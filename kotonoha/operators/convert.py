"""The whole conversion: all stages in their fixed order over a table of documents."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kotonoha.operators import blocks, inline, metadata
from kotonoha.operators.notes import apart, remaining, with_lines
from kotonoha.session import spread


#: First words of the counters' names, in the order of the stages.
STAGES = ("gaiji", "tcy", "emphasis", "underline", "bouten", "headings", "indent", "align", "page", "blocks")


@dataclass(frozen=True)
class Options:
    """Which stages run, and how."""

    gaiji: bool = True
    tcy: bool = True
    emphasis: bool = True
    underline: bool = True
    underline_html: bool = False
    approximate_styles: bool = False
    approximate_left: bool = False
    bouten: bool = True
    bouten_mark: str = "﹅"
    headings: bool = True
    heading_levels: tuple[int, int, int] = (2, 3, 4)
    indent: bool = False
    align: bool = False
    approximate_raised: bool = False
    page_breaks: bool = False
    approximate_spread: bool = False
    preserve_notes: bool = False
    footer: bool = True
    annotation_blocks: bool = True
    front_matter: bool = True
    keep_header: bool = False

    def __post_init__(self):
        for f in fields(self):
            if f.name not in ("bouten_mark", "heading_levels") and not isinstance(getattr(self, f.name), bool):
                raise ValueError(f"{f.name} is no boolean")
        if len(self.heading_levels) != 3 or not all(isinstance(n, int) and 1 <= n <= 6 for n in self.heading_levels):
            raise ValueError("heading_levels are three numbers from 1 to 6")


def convert(df: DataFrame, options: Options = Options(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, naming, counters of each stage, remaining_notes) of every document; nulls count as empty.

    Documents without a note opener, a header or a footer pass through the same plan unchanged."""
    o = options
    rows = with_lines(spread(df.select(id_col, F.col(text).alias("text"))))
    stages = [
        (o.gaiji, inline.gaiji),
        (o.tcy, inline.tcy),
        (o.emphasis, inline.emphasis),
        (o.underline, lambda x: inline.underline(x, o.underline_html, o.approximate_styles, o.approximate_left)),
        (o.bouten, lambda x: inline.bouten(x, o.bouten_mark)),
        (o.headings, lambda x: inline.headings(x, o.heading_levels)),
        (o.indent, lambda x: blocks.indent(x, o.preserve_notes)),
        (o.align, lambda x: blocks.align(x, o.approximate_raised, o.preserve_notes)),
        (o.page_breaks, lambda x: blocks.page_breaks(x, o.approximate_spread)),
    ]
    for on, stage in stages:
        rows = stage(rows) if on else rows
    # files are named by what stands in front before footers and annotation blocks go
    rows = metadata.naming_of(rows).drop("header", "body_line").withColumnRenamed("naming", "__naming")
    rows = blocks.footer(rows) if o.footer else rows
    rows = blocks.annotation_blocks(rows) if o.annotation_blocks else rows
    rows = metadata.add_front_matter(rows, o.keep_header, o.front_matter).drop("header", "body_line", "front", "front_end", "naming")
    return rows.withColumnRenamed("__naming", "naming").drop("lines", "shield", "noted")


def with_remaining(converted: DataFrame) -> DataFrame:
    """Adds remaining_notes, how many notes a converted text still has, counted within the row; they are told in the diagnostics as well, with their number as the reason."""
    done = with_lines(converted, names=("__noted", "__lines", "__shield")).withColumn("remaining_notes", remaining("__noted", "__lines", "__shield")).drop("__noted", "__lines", "__shield")
    if "diagnostics" not in done.columns:
        return done
    n = F.col("remaining_notes")
    told = F.when(n > 0, F.array(F.struct(F.lit("residual").alias("stage"), F.lit("REMAINING_AOZORA_NOTES").alias("code"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("note"), n.cast("string").alias("reason"))))
    done = apart(done)
    return done.withColumns(inline.told(done, told))


def events(converted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, ord, stage, action, count): what was done to each document, in the order of the stages; counters of 0 are no events."""
    names = [f.name for f in converted.schema if f.dataType.simpleString() == "bigint" and "_" in f.name and f.name.split("_")[0] in STAGES]
    names.sort(key=lambda n: STAGES.index(n.split("_")[0]))
    flags = [n for n in ("footer_removed", "front_matter_added", "front_matter_restored") if n in converted.columns]
    one = lambda k, name, n: F.struct(F.lit(k).alias("ord"), F.lit(name.rsplit("_", 1)[0] if name in flags else name.split("_")[0]).alias("stage"), F.lit(name.rsplit("_", 1)[1] if name in flags else name.split("_", 1)[1]).alias("action"), n.alias("count"))
    rows = [one(k, n, F.col(n)) for k, n in enumerate(names)] + [one(len(names) + k, n, F.col(n).cast("bigint")) for k, n in enumerate(flags)]
    return converted.select(id_col, F.explode(F.array(*rows)).alias("e")).filter("e.count <> 0").select(id_col, "e.*")


def totals(converted: DataFrame) -> DataFrame:
    """The counters of all stages over the corpus, in one row."""
    counters = [f.name for f in converted.schema if f.dataType.simpleString() == "bigint" and f.name not in ("doc_id",)]
    return converted.agg(F.count("*").alias("documents"), *(F.sum(c).alias(c) for c in counters))
