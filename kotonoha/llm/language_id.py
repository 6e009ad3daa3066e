"""Operator 1: languages of pages by Bayesian fusion of text, declared language, address suffix and host.

Text: byte trigrams of words (ASCII capitals lowered, a blank on either side) in SLOTS hashed bins,
their counts in each language taken over all labelled texts; the log-likelihood of a page's visible
text is tempered by TEMPER, as neighbouring trigrams are not independent. With the languages'
shares it gives a first posterior, which is summed over groups of pages: P(declared | language), and
a hierarchy of priors, all pages -> address suffix -> domain (its last two labels) -> host, each level
smoothed towards the one above with SMOOTH pages. A page's own posterior is taken out of its groups'
sums before it gets their priors. The final posterior is the product of tempered likelihood, declared
evidence (none where nothing is declared) and host prior.

Scale: counts are arrays of fixed size, summed in chunks; groups are aggregates of rows (page,
language) with partial sums before the shuffle, and hosts come back by a join that adaptive execution
splits, so one host may hold any share of the pages.

Defined results: a page of any length is read in one pass; a null page or address has empty text and no host; a text without words has no text
evidence, so the priors decide; pages are kept whatever the result, repeated ones each; ties go to
the first language by name; without labelled texts the language is null; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from kotonoha.llm.common import LOWER, documents
from kotonoha.session import written

SLOTS, CHUNK, TEMPER, SMOOTH = 1 << 16, 1 << 13, 0.3, 5.0
_HIDDEN = re.compile(r"(?i)<(script|style|noscript|template)\b")
_CLOSE = {name: re.compile(rf"(?i)</{name}\s*>") for name in ("script", "style", "noscript", "template")}
_HTML = re.compile(r"(?i)<html\b")
_LANG = re.compile(r"""(?i)\blang\s*+=\s*+["']?\s*+([A-Za-z]{2,8})(?![A-Za-z]*+=)""")  # nothing is given back, so blanks of any number are read once
_HOST = re.compile(r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")


def visible(html: str) -> str:
    """The text between tags, without comments and hidden elements; what is opened and never closed is text or an ordinary tag.

    One pass: a closing mark that is missing once is not looked for again."""
    out, at, missing = [], 0, set()

    def closed(name: str, find):
        if name in missing:
            return -1
        if (end := find()) < 0:
            missing.add(name)
        return end

    def end_of(name: str, start: int) -> int:
        found = _CLOSE[name].search(html, start)
        return found.end() if found else -1

    while (open_ := html.find("<", at)) >= 0:
        out.append(html[at:open_])
        end = -1
        if html.startswith("<!--", open_):
            end = closed("comment", lambda: html.find("-->", open_ + 4))
            end = end + 3 if end >= 0 else end
        elif hidden := _HIDDEN.match(html, open_):
            name = hidden[1].lower()
            end = closed(name, lambda: end_of(name, hidden.end()))
        if end < 0:
            end = html.find(">", open_) + 1
        if not end:
            at = open_
            break
        out.append(" ")
        at = end
    out.append(html[at:])
    return "".join(out)


def declared(html: str) -> str | None:
    at = 0
    while opened := _HTML.search(html, at):
        at = html.find(">", opened.end())
        found = _LANG.search(html, opened.end(), at if at >= 0 else len(html))
        if found or at < 0:
            return found[1].lower() if found else None
    return None


def host_of(url: str) -> str:
    found = _HOST.match(url)
    return found[1].lower().rstrip(".") if found else ""


def bins(text: bytes) -> np.ndarray:
    """Hashed bins of the trigrams of a text."""
    x = np.frombuffer(b" " + b" ".join(text.translate(LOWER).split()) + b" ", np.uint8).astype(np.uint32)
    if len(x) < 4:
        return np.empty(0, np.int64)
    code = x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)


def likelihoods(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages by name, log P(bin | language), and the languages' smoothed shares of the texts."""
    rows = df.select(F.col(lang_col).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter("lang is not null")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if lang not in sums:
                    sums[lang] = np.zeros(SLOTS + CHUNK, np.int64)  # the last chunk holds the number of texts
                sums[lang][:SLOTS] += np.bincount(bins(text.encode()), minlength=SLOTS)
                sums[lang][SLOTS] += 1
        for lang, c in sums.items():
            parts = c.reshape(-1, CHUNK)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(parts)), pa.array(np.arange(len(parts)).astype(np.int32)), pa.array([p.tobytes() for p in parts], pa.binary())], names=["lang", "chunk", "c"])

    def add(batches):
        total = {}
        for b in batches:
            for lang, chunk, c in zip(*(x.to_pylist() for x in b.columns)):
                c = np.frombuffer(c, np.int64)
                total[lang, chunk] = total[lang, chunk] + c if (lang, chunk) in total else c
        for (lang, chunk), c in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([chunk], pa.int32()), pa.array([c.tobytes()], pa.binary())], names=["lang", "chunk", "c"])

    schema = "lang string, chunk int, c binary"
    found: dict[str, np.ndarray] = {}
    for r in rows.mapInArrow(count, schema).repartition("lang", "chunk").mapInArrow(add, schema).collect():  # a fixed size for each language
        found.setdefault(r.lang, np.zeros(SLOTS + CHUNK))[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.c, np.int64)
    names = sorted(found)
    counts = np.array([found[n] for n in names]).reshape(len(names), SLOTS + CHUNK)
    texts = counts[:, SLOTS]
    counts = counts[:, :SLOTS] + 0.5
    return names, np.log(counts / counts.sum(axis=1, keepdims=True)), (texts + 1) / (texts.sum() + len(names))


def evidence(pages: DataFrame, names: list[str], log_p: np.ndarray, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, rid, host, domain, suffix, declared, text_log): tempered log-likelihoods in the order of names."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.monotonically_increasing_id().alias("rid"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    shared = pages.sparkSession.sparkContext.broadcast(log_p.astype(np.float32))
    text = [StructField(n, StringType()) for n in ("host", "domain", "suffix", "declared")]
    schema = StructType([rows.schema["page_id"], StructField("rid", LongType()), *text, StructField("text_log", ArrayType(DoubleType()))])

    def run(batches):
        table = shared.value
        for b in batches:
            out = [[], [], [], [], []]
            for url, html in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                host = host_of(url)
                labels = host.split(".")
                logs = table[:, bins(visible(html).encode())].sum(axis=1, dtype=np.float64) * TEMPER
                for to, v in zip(out, (host, ".".join(labels[-2:]), labels[-1], declared(html), logs.tolist())):
                    to.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(o, pa.string()) for o in out[:4]), pa.array(out[4], pa.list_(pa.float64()))], names=["page_id", "rid", "host", "domain", "suffix", "declared", "text_log"])

    return rows.mapInArrow(run, schema)


def fuse(found: DataFrame, names: list[str], shares: np.ndarray) -> DataFrame:
    """(page_id, rid, host, declared, text_lang, lang, probability) from the rows of evidence()."""
    levels = ("suffix", "domain", "host")
    lang = F.array(*map(F.lit, names))
    table = F.arrays_zip(lang.alias("lang"), F.array(*(F.lit(float(s)) for s in shares)).alias("share"), F.col("text_log").alias("log"))
    norm = F.aggregate(table, F.lit(0.0), lambda a, x: a + x["share"] * F.exp(x["log"] - F.array_max("text_log")))
    rows = found.select("page_id", "rid", *levels, "declared", F.array_max("text_log").alias("most"), norm.alias("norm"), F.explode(table).alias("x"))
    rows = rows.select("page_id", "rid", *levels, "declared", "x.lang", "x.log", "x.share", (F.col("x.share") * F.exp(F.col("x.log") - F.col("most")) / F.col("norm")).alias("p"))
    rows = written(rows, "language-rows")
    said = rows.filter("declared is not null").groupBy("declared", "lang").agg(F.sum("p").alias("said_n"))
    spoken = rows.filter("declared is not null").groupBy("lang").agg(F.sum("p").alias("lang_n"))
    kinds = rows.filter("declared is not null").agg(F.count_distinct("declared").alias("kinds"))
    rows = rows.join(said, ["declared", "lang"], "left").join(F.broadcast(spoken), "lang", "left").withColumn("kinds", F.lit(float(kinds.first().kinds)))
    own = F.col("p")
    heard = (F.greatest(F.col("said_n") - own, F.lit(0.0)) + 1) / (F.greatest(F.col("lang_n") - own, F.lit(0.0)) + F.col("kinds"))
    rows = rows.withColumn("said", F.when(F.col("declared").isNull(), F.lit(0.0)).otherwise(F.log(heard)))
    total = rows.groupBy("lang").agg(F.sum("p").alias("all_p"), F.count("*").alias("all_n"))
    rows = rows.join(F.broadcast(total), "lang")  # a row for each language
    prior = (F.col("all_p") - own + SMOOTH * F.col("share")) / (F.col("all_n") - 1 + SMOOTH)
    for level in levels:
        group = rows.groupBy(level, "lang").agg(F.sum("p").alias("group_p"), F.count("*").alias("group_n"))
        rows = rows.withColumn("prior", prior).join(group, [level, "lang"])
        prior = (F.greatest(F.col("group_p") - own, F.lit(0.0)) + SMOOTH * F.col("prior")) / (F.col("group_n") - 1 + SMOOTH)
        rows = rows.withColumn("next", prior).drop("prior", "group_p", "group_n").withColumnRenamed("next", "prior")
        prior = F.col("prior")
    rows = rows.withColumn("final", F.col("log") + F.col("said") + F.log("prior"))
    best = lambda c: F.min(F.struct((-F.col(c)).alias("minus"), "lang"))  # noqa: E731  ties: the first by name
    out = rows.groupBy("rid").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("declared").alias("declared"), best("log").alias("text"), best("final").alias("all"), F.collect_list("final").alias("finals"))
    probability = 1 / F.aggregate("finals", F.lit(0.0), lambda a, x: a + F.exp(x + F.col("all.minus")))
    return out.select("page_id", "rid", "host", "declared", F.col("text.lang").alias("text_lang"), F.col("all.lang").alias("lang"), probability.alias("probability"))


def identify(pages: DataFrame, labelled: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """fuse() over pages with likelihoods learnt from labelled (text, lang)."""
    names, log_p, shares = likelihoods(labelled)
    found = written(evidence(pages, names, log_p, id_col, url_col, html_col), "language-evidence")
    if not names:
        return found.select("page_id", "rid", "host", "declared", F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"))
    return fuse(found, names, shares)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(spark.read.parquet(f"{sf_dir}/pages.parquet"), documents(spark, sf_dir))
    return found.select("page_id", "host", "declared", "text_lang", "lang", F.round("probability", 6).alias("probability"))
