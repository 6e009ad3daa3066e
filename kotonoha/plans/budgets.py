"""Nested budgets of an import: running sums over the job and over each archive, and the first breach of each.

Rows come in input order. A breach of a text or an archive ends that source: what lies behind it is neither read nor counted. A breach of
the job ends everything. All sums are running sums over ranges (plans.jobs.running), so the account of a corpus is a
few passes over thin rows, whatever the number of entries in one archive.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kotonoha.plans.jobs import running
from kotonoha.session import written


@dataclass(frozen=True)
class Limits:
    """The limits of an import, in sources, entries, bytes and milliseconds; None stands for no limit."""

    sources: int | None = 64
    input_bytes: int | None = 64 << 20
    total_input_bytes: int | None = 128 << 20
    archive_entries: int | None = 2_000
    total_entries: int | None = 8_000
    filename_bytes: int | None = 4_096
    text_bytes: int | None = 16 << 20
    declared_bytes: int | None = 128 << 20
    expanded_bytes: int | None = 128 << 20
    output_bytes: int | None = 128 << 20
    job_timeout_ms: int | None = 60_000

    def __post_init__(self):
        for f in fields(self):
            value = getattr(self, f.name)
            if value is not None and (not isinstance(value, int) or isinstance(value, bool) or not 1 <= value < 1 << 53):
                raise ValueError(f"INVALID_LIMIT: {f.name}")

    @classmethod
    def none(cls) -> Limits:
        return cls(**{f.name: None for f in fields(cls)})


def _over(limits: Limits, checks: list[tuple[str, str]]):
    """The name of the first limit that a column exceeds."""
    out = F.lit(None).cast("string")
    for column, name in reversed(checks):
        if (limit := getattr(limits, name)) is not None:
            out = F.when(F.col(column) > limit, name).otherwise(out)
    return out


def source_breaches(sources: DataFrame, limits: Limits) -> DataFrame:
    """(input_ord, input_id, scope, reason) of the sources (input_ord, input_id, length) that break a limit: the first that breaks one of the batch, else each that is too long itself."""
    summed = running(sources.select("input_ord", "input_id", "length", F.lit(1).alias("__one")), {"__n": "__one", "__bytes": "length"}, ["input_ord"], [])
    batch = summed.withColumn("reason", _over(limits, [("__n", "sources"), ("__bytes", "total_input_bytes")])).filter("reason is not null")
    batch = batch.orderBy("input_ord").limit(1).select("input_ord", "input_id", F.lit("batch").alias("scope"), "reason")
    unit = sources.withColumn("reason", _over(limits, [("length", "input_bytes")])).filter("reason is not null").select("input_ord", "input_id", F.lit("unit").alias("scope"), "reason")
    return batch.unionByName(unit.join(batch.limit(1).select(F.lit(1).alias("__none")), F.lit(True), "left_anti"))


def budget_account(entries: DataFrame, limits: Limits) -> DataFrame:
    """Entries with their running sums and breach <scope, reason>, null for those that fit; what comes behind a breach has the status "unread".

    entries: (input_ord, entry_ord, filename_bytes, declared, expanded, text_bytes, output, elapsed_ms), a loose text with a null entry_ord. Checked
    in order are: of the batch the entries so far, of the archive its entries, the name; of the batch the declared bytes so far, the
    expanded bytes so far; the text; of the batch the converted bytes and the time so far. A row that fails a check adds nothing to the sums of later ones."""
    columns = ("filename_bytes", "declared", "expanded", "text_bytes", "output", "elapsed_ms")
    rows = entries.withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in columns})
    rows = rows.withColumn("__entry", F.col("entry_ord").isNotNull().cast("int")).withColumn("__place", F.coalesce("entry_ord", F.lit(-1)))
    within = running(rows, {"archive_entries": "__entry"}, ["__place"], ["input_ord"])
    head = _over(limits, [("archive_entries", "archive_entries"), ("filename_bytes", "filename_bytes")])
    own = F.coalesce(head, _over(limits, [("text_bytes", "text_bytes")]))
    failed = within.withColumn("__head", head).withColumn("__own", own)
    # of a source only what comes up to its first failure is read: one row for each source that fails, joined by its key
    stops = failed.filter("__own is not null").groupBy(F.col("input_ord").alias("__source")).agg(F.min("__place").alias("__stop"))
    failed = failed.join(stops, F.col("input_ord").eqNullSafe(F.col("__source")), "left")
    read = F.coalesce(F.col("__place") <= F.col("__stop"), F.lit(True))
    rows = failed.withColumn("__read", read)
    count = lambda c, on: F.when(F.col("__read") & on, F.col(c)).otherwise(0)
    whole, yes = F.col("__own").isNull(), F.lit(True)
    sized = rows.withColumns({"__a": count("__entry", yes), "__d": count("declared", F.col("__head").isNull()), "__x": count("expanded", F.col("__head").isNull()), "__o": count("output", whole), "__t": count("elapsed_ms", yes)})
    order = ["input_ord", "__place"]
    summed = running(sized, {"total_entries": "__a", "declared_bytes": "__d", "expanded_bytes": "__x", "output_bytes": "__o", "job_ms": "__t"}, order, [])
    job = F.when(F.col("__read"), F.coalesce(_over(limits, [("total_entries", "total_entries")]), F.when(F.col("__head").isNull(), F.coalesce(_over(limits, [("declared_bytes", "declared_bytes"), ("expanded_bytes", "expanded_bytes")]), F.when(whole, _over(limits, [("output_bytes", "output_bytes")])))), _over(limits, [("job_ms", "job_timeout_ms")])))
    # of one row the batch's checks and its own come in turns: the first that fails counts
    late = job.isin("output_bytes", "job_timeout_ms") | (F.col("__head").isNotNull() & (job != "total_entries"))
    summed = summed.withColumn("__job", F.when(~(late & F.col("__own").isNotNull()), job))
    summed = written(summed, "budget")
    # everything behind the first breach of the job is unread: one row is told to all
    first = summed.filter("__job is not null").agg(F.min(F.struct(*order)).alias("__end"))
    ended = summed.join(F.broadcast(first), how="cross")
    after = F.coalesce(F.struct(*order) > F.col("__end"), F.lit(False))
    breach = F.when(after | ~F.col("__read"), None).when(F.col("__job").isNotNull(), F.struct(F.lit("batch").alias("scope"), F.col("__job").alias("reason"))).when(F.col("__own").isNotNull(), F.struct(F.lit("unit").alias("scope"), F.col("__own").alias("reason")))
    status = F.when(after | ~F.col("__read"), "unread").when(breach.isNotNull(), "breach").otherwise("fits")
    return ended.withColumn("breach", breach).withColumn("status", status).select(*entries.columns, "archive_entries", "total_entries", "declared_bytes", "expanded_bytes", "output_bytes", "breach", "status")


def first_breaches(account: DataFrame) -> DataFrame:
    """(input_ord, entry_ord, scope, reason): the breach of each source, and that of the job."""
    return account.filter("status = 'breach'").select("input_ord", "entry_ord", "breach.scope", "breach.reason")
