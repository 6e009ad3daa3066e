"""Plans for batches of archives: one unsafe or repeated entry rejects its batch, the texts of a sound one get paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kotonoha.functions.names import sanitize_filename, zip_entry_problem, zip_relative_name
from kotonoha.operators.notes import apart
from kotonoha.plans.outputs import plan_outputs
from kotonoha.session import written

_TEXT = r"(?i)\A(.*)\.(txt|md)\z"


def _judged(entries: DataFrame) -> DataFrame:
    """entries with problem, what is wrong with each by itself: what its names, index and mode say, then a foreign owner."""
    foreign = F.when(~F.col("owner_id").eqNullSafe(F.col("archive_id")), "invalid-entry-identity")
    return entries.withColumn("problem", F.coalesce(zip_entry_problem(F.col("raw_name"), F.col("name"), F.col("index"), F.col("mode")), foreign))


def _first_problems(judged: DataFrame, batch: str) -> DataFrame:
    """archive_problems() of (batch, archive_ord, archive_id, entry_ord, index, problem); names stay out of its shuffles."""
    archives = judged.filter(F.col(batch).isNotNull() & F.col("archive_id").isNotNull()).select(batch, "archive_id", "archive_ord").distinct()
    first = F.min("archive_ord").over(Window.partitionBy(batch, "archive_id"))
    again = archives.withColumn("first", first).filter("archive_ord > first")
    again = again.select(batch, "archive_ord", F.lit(-1).alias("entry_ord"), "archive_id", F.lit("duplicate-archive-identity").alias("reason"))
    same = Window.partitionBy(batch, "archive_ord", "index").orderBy("entry_ord")
    seen = judged.select(batch, "archive_ord", "archive_id", "entry_ord", "index", "problem").withColumn("__n", F.row_number().over(same))
    reason = F.coalesce("problem", F.when(F.col("__n") > 1, "invalid-entry-identity"))
    found = seen.select(batch, "archive_ord", F.col("entry_ord").cast("int").alias("entry_ord"), "archive_id", reason.alias("reason")).filter("reason is not null")
    first = F.min(F.struct("archive_ord", "entry_ord", "archive_id", "reason")).alias("e")
    return again.unionByName(found).groupBy(batch).agg(first).select(batch, "e.archive_id", "e.reason")


def archive_problems(entries: DataFrame, batch: str = "batch") -> DataFrame:
    """(batch, archive_id, reason): the first problem of each batch in the order of archives and entries; batches without one are left out.

    entries: (batch, archive_ord, archive_id, owner_id, entry_ord, index, raw_name, name, mode). An archive whose id an earlier
    one has is at fault before its entries, an entry by what its names, index and mode say, then by a foreign owner or an index that an earlier one has."""
    return _first_problems(_judged(entries), batch)


def plan_archives(entries: DataFrame, taken: DataFrame, extension: str = "md", batch: str = "batch") -> DataFrame:
    """(batch, archive_id, index, output) of every entry of sound batches; output is null for folders and for what is no text.

    entries as for archive_problems(), with stem (of the archive's name) and directory; taken: (batch, path). Only what is wrong with an
    entry and the path that it asks for are written and shuffled, not the names that they follow from."""
    parts = F.split(zip_relative_name(F.coalesce("name", "raw_name")), "/")
    rows = apart(_judged(entries).withColumn("__parts", parts).withColumn("__last", F.element_at(parts, -1)))
    is_text = ~F.coalesce("directory", F.lit(False)) & F.col("__last").rlike(_TEXT) & F.col(batch).isNotNull()
    folders = F.transform(F.concat(F.array("stem"), F.slice("__parts", F.lit(1), F.size("__parts") - 1)), lambda p: sanitize_filename(p))
    path = F.array_join(F.array_append(folders, sanitize_filename(F.regexp_extract("__last", _TEXT, 1), extension)), "/")
    rows = written(rows.select(batch, "archive_ord", "entry_ord", "archive_id", "index", "problem", F.when(is_text, path).alias("path")), "archive-entries")  # read four times
    unsound = written(_first_problems(rows, batch).select(batch), "archive-problems")  # read twice
    sound = rows.join(unsound, batch, "left_anti")
    # what an entry is known by goes along in its place, so that nothing has to be joined to it again
    place = F.struct("archive_ord", "entry_ord", "archive_id", "index")
    asked = apart(sound.filter("path is not null").select(batch, place.alias("ord"), "path"))
    planned = plan_outputs(asked, taken, batch).select(batch, "ord.archive_id", "ord.index", "output")
    return planned.unionByName(sound.filter("path is null").select(batch, "archive_id", "index", F.lit(None).cast("string").alias("output")))
