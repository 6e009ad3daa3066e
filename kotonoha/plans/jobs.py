"""Accounts of conversion jobs: a replay-safe fold of events, batch status, running budgets, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kotonoha.session import written


def job_stats(events: DataFrame) -> DataFrame:
    """Totals of (ord, type, file_id, attempt_id, delivery, remaining) events in one row.

    Of repeated events (type, file, attempt) the first counts, of several commits of a file the first."""
    place = F.struct("ord", "delivery", "remaining")
    once = events.groupBy("type", "file_id", "attempt_id").agg(F.min(place).alias("e"))
    files = once.groupBy("type", "file_id").agg(F.count("*").alias("attempts"), F.min("e").alias("e"))
    is_ = lambda t: F.col("type") == t
    count = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0)).cast("bigint")
    total = lambda c, v: F.coalesce(F.sum(F.when(c, v)), F.lit(0)).cast("bigint")
    done = is_("WriteCommitted")
    return files.agg(
        count(done).alias("files_converted"),
        count(is_("Skipped")).alias("files_skipped"),
        total(is_("WriteFailed") | is_("ArchiveFailed"), F.col("attempts")).alias("errors"),
        count(done & (F.col("e.remaining") > 0)).alias("files_with_remaining_notes"),
        total(done, F.col("e.remaining")).alias("remaining_notes"),
        count(is_("Cancelled")).alias("cancelled_files"),
        count(done & (F.col("e.delivery") == "browser-artifact")).alias("artifact_files"),
        count(done & (F.col("e.delivery") != "browser-artifact")).alias("saved_files"),
    )


def outcome_events(outcomes: DataFrame) -> DataFrame:
    """Events of import outcomes (ord, file_id, kind, status, ready, remaining): what failed, was passed over or committed."""
    kind = (
        F.when((F.col("status") == "failed") & (F.col("kind") == "zip"), "ArchiveFailed")
        .when(F.col("status") == "failed", "WriteFailed")
        .when(F.col("status").isin("ignored", "empty"), "Skipped")
        .when(F.col("status") == "cancelled", "Cancelled")
        .when(F.col("ready"), "WriteCommitted")
    )
    return outcomes.select("ord", kind.alias("type"), "file_id", F.lit("1").alias("attempt_id"), F.lit("browser-artifact").alias("delivery"), "remaining").filter("type is not null")


def batch_status(outcomes: DataFrame) -> DataFrame:
    """completed, partial or failed."""
    failed = F.col("status") == "failed"
    return outcomes.agg(F.when(F.bool_and(failed), "failed").when(F.bool_or(failed), "partial").otherwise("completed").alias("status"))


def running(rows: DataFrame, sums: dict[str, str], order: list[str], keys: list[str]) -> DataFrame:
    """Adds for each name of sums the running sum of a column, up to each row in order, among the rows with equal keys; nulls are equal and count 0.

    Rows are dealt in ranges, which are summed in themselves; the sums before each range are those of a table of one row for each
    range and key. So neither a key nor the whole has to fit into a task."""
    rows = rows.withColumn("__key", F.struct(*keys) if keys else F.struct(F.lit(0)))
    laid = written(rows.repartitionByRange("__key", *order).withColumn("__part", F.spark_partition_id()), "running")
    total = laid.groupBy("__key", "__part").agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(f"__{n}") for n, c in sums.items()))
    earlier = Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    total = total.select("__key", "__part", *(F.coalesce(F.sum(f"__{n}").over(earlier), F.lit(0)).alias(f"__{n}") for n in sums))
    upto = Window.partitionBy("__key", "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    a, b = laid.withColumns({n: F.coalesce(F.sum(c).over(upto), F.lit(0)).cast("bigint") for n, c in sums.items()}).alias("a"), total.alias("b")
    joined = a.join(b, (F.col("a.__part") == F.col("b.__part")) & F.col("a.__key").eqNullSafe(F.col("b.__key"))).select("a.*", *(f"b.__{n}" for n in sums))
    return joined.withColumns({n: F.col(n) + F.col(f"__{n}") for n in sums}).drop("__key", "__part", *(f"__{n}" for n in sums))


def running_budget(rows: DataFrame, size: str, limit: int, order: str, batch: str | None = None) -> DataFrame:
    """Adds used, the sum of sizes up to each row in order, and fits; equality fits. Sums run within a batch."""
    return running(rows, {"used": size}, [order], [batch] if batch else []).withColumn("fits", F.col("used") <= limit)


def first_over(rows: DataFrame, size: str, limit: int, order: str, batch: str) -> DataFrame:
    """The first row of each batch with which its running sum (used) goes over a limit."""
    over = running(rows, {"used": size}, [order], [batch]).filter(F.col("used") > limit)
    return over.groupBy(batch).agg(F.min_by(F.struct(*over.columns), order).alias("r")).select("r.*")


def page_of(rows: DataFrame, order: str, page: int, size: int = 50) -> DataFrame:
    """One page of rows in order; pages count from 0."""
    return rows.orderBy(order).offset(page * size).limit(size)
