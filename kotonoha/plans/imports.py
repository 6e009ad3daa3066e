"""Batch import: files and archives to converted texts, planned outputs, outcomes and figures."""

from __future__ import annotations

from dataclasses import dataclass, fields
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kotonoha.functions.names import sanitize_filename
from kotonoha.functions.text import file_id
from kotonoha.operators.convert import Options, convert, with_remaining
from kotonoha.operators.notes import apart
from kotonoha.plans.budgets import Limits
from kotonoha.plans.jobs import batch_status, job_stats, outcome_events
from kotonoha.plans.outputs import plan_outputs
from kotonoha.session import written
from kotonoha.sources.files import entries, texts


@dataclass(frozen=True)
class ImportLimits:
    """Sources, bytes of one, of all, and of a text."""

    sources: int = 64
    input_bytes: int = 64 << 20
    total_bytes: int = 128 << 20
    text_bytes: int = 16 << 20

    def __post_init__(self):
        for f in fields(self):
            value = getattr(self, f.name)
            if not isinstance(value, int) or isinstance(value, bool) or not 1 <= value < 1 << 53:
                raise ValueError(f"INVALID_LIMIT: {f.name}")


class Imported(NamedTuple):
    """artifacts: file_id, input_id, index, path, text and the counters; outcomes: one row an input and entry."""

    artifacts: DataFrame
    outcomes: DataFrame
    status: DataFrame
    account: DataFrame


def identity_problems(sources: DataFrame, limits: ImportLimits | None = None) -> DataFrame:
    """(code, n): blank or repeated ids, contradicting kinds, and limits that the batch breaks; empty for a sound one.

    limits=None holds a corpus of any size to its ids and kinds only."""
    ids = sources.groupBy("input_id").agg(F.count("*").alias("n"))
    found = ids.filter((F.coalesce(F.trim("input_id"), F.lit("")) == "") | (F.col("n") > 1)).select(F.lit("INVALID_INPUT").alias("code"), "n")
    ext = F.lower(F.regexp_extract("name", r"\.([^.]*)\z", 1))
    found = found.unionByName(sources.filter(~ext.eqNullSafe(F.col("kind"))).select(F.lit("INVALID_INPUT").alias("code"), F.lit(1).cast("bigint").alias("n")))
    if limits:
        over = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
        total = sources.agg(F.count("*").alias("sources"), over(F.sum("length")).alias("total"), over(F.max("length")).alias("most"))
        broken = (F.col("sources") > limits.sources) | (F.col("total") > limits.total_bytes) | (F.col("most") > limits.input_bytes)
        found = found.unionByName(total.filter(broken).select(F.lit("LIMIT_EXCEEDED").alias("code"), F.lit(1).cast("bigint").alias("n")))
    return found.groupBy("code").agg(F.sum("n").alias("n"))


def requested_path(name: Column, naming: Column, from_naming: bool, extension: str) -> Column:
    """Where a text is asked to go: its folders and stem, or an author's folder and a title if it has both."""
    parts = F.split(name, "/")
    folders = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: sanitize_filename(p))
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*\z", "")
    own = F.array_join(F.array_append(folders, sanitize_filename(stem, extension)), "/")
    if not from_naming:
        return own
    named = naming["title"].isNotNull() & naming["author"].isNotNull()
    return F.when(named, F.concat(sanitize_filename(naming["author"]), F.lit("/"), sanitize_filename(naming["title"], extension))).otherwise(own)


def prepare_import(sources: DataFrame, options: Options = Options(), encoding: str = "auto", extension: str = "md", by_author: bool = False, limits: Limits = Limits()) -> Imported:
    """Decodes, converts and plans every text of the sources (see sources.files.read_sources). limits: on an archive's entries, what they declare, and a text.

    A text that fails takes only itself out. Decoded texts and conversions are written once, as
    several tables are made of them."""
    decoded = written(texts(sources, encoding, limits).withColumn("file_id", F.when(F.col("index").isNull(), file_id("input_id")).otherwise(file_id("input_id", "index"))), "import-texts")
    good = decoded.filter("code is null").select("file_id", "text")
    done = written(with_remaining(convert(good, options, "file_id")), "import-converted")
    rows = decoded.select("file_id", "input_id", "index", "name", "encoding", "bom").join(done, "file_id")
    archive = F.regexp_replace(F.regexp_extract("input_id", r"([^/]*)\z", 1), r"\.[^.]*\z", "")
    name = F.when(F.col("index").isNull(), F.col("name")).otherwise(F.concat(archive, F.lit("/"), F.col("name")))
    rows = apart(rows.withColumn("asked", requested_path(name, F.col("naming"), by_author, extension)))
    folder = F.regexp_extract("input_id", r"\A(.*/)?[^/]*\z", 1)
    requests = rows.select(folder.alias("batch"), F.struct("input_id", F.coalesce("index", F.lit(-1))).alias("ord"), F.col("asked").alias("path"))
    taken = sources.select(folder.alias("batch"), F.col("name").alias("path"))
    planned = plan_outputs(requests, taken).select("batch", "ord", F.col("output").alias("path"))
    artifacts = rows.withColumn("batch", folder).withColumn("ord", F.struct("input_id", F.coalesce("index", F.lit(-1)))).join(planned, ["batch", "ord"]).drop("ord", "asked")
    read = decoded.join(done.select("file_id", "remaining_notes"), "file_id", "left")
    kind = F.when(F.col("index").isNull() & ~F.lower("name").rlike(r"\.(md|txt)\z"), "zip").otherwise("text")
    outcome = read.select("input_id", "index", "file_id", kind.alias("kind"), F.when(F.col("code").isNull(), "ready").otherwise("failed").alias("status"), "code", F.col("code").isNull().alias("ready"), F.coalesce("remaining_notes", F.lit(0).cast("bigint")).alias("remaining"))
    ignored = entries(sources, limits).filter("content is null and problem is null").select("input_id", "index", file_id("input_id", "index").alias("file_id"), F.lit("text").alias("kind"), F.lit("ignored").alias("status"), F.lit(None).cast("string").alias("code"), F.lit(False).alias("ready"), F.lit(0).cast("bigint").alias("remaining"))
    outcomes = written(outcome.unionByName(ignored), "import-outcomes")
    account = job_stats(outcome_events(outcomes.withColumn("ord", F.struct("input_id", "index"))))
    return Imported(artifacts, outcomes, batch_status(outcomes.filter("status <> 'ignored'")), account)
