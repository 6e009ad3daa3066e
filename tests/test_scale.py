"""Archives in parts, nested budgets and keyed streams against versions that go one after the other."""

import io
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from kotonoha.functions.names import sanitize_filename
from kotonoha.operators.notes import bound
from kotonoha.plans import budgets, jobs, outputs, registry
from kotonoha.plans.budgets import Limits
from kotonoha.sources import archives
from kotonoha.sources.files import export_archives
from kotonoha.streaming.jobs import account, fold_into


def test_archives_in_parts(spark, tmp_path):
    rng = random.Random(5)
    rows = [(b, k, f"{b}/é{k}.md", rng.randbytes(rng.choice((0, 1, 50, 3000)))) for b in ("甲", "乙") for k in range(40)]
    df = spark.createDataFrame(rows, "batch string, ord int, path string, content binary").repartition(5)
    want = {r.batch: bytes(r.archive) for r in export_archives(df).collect()}
    manifest = {r.batch: r for r in archives.write_archives(df, str(tmp_path / "out"), part=4096).collect()}
    parts = archives.read_parts(spark, str(tmp_path / "out")).orderBy("batch", "at").collect()
    got = {}
    for p in parts:
        assert len(got.get(p.batch, b"")) == p.at and len(p.bytes) < 4096 + 3200
        got[p.batch] = got.get(p.batch, b"") + bytes(p.bytes)
    assert got == want and len(parts) > 10
    for b, data in got.items():
        assert manifest[b].size == len(data) and manifest[b].entries == 40 and manifest[b].code is None
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            assert z.testzip() is None
    assert archives.archive_parts(df.limit(0))[0].count() == 0


def test_archives_beyond_the_format(spark, monkeypatch):
    monkeypatch.setattr(archives, "MOST_ENTRIES", 2)
    df = spark.createDataFrame([("a", k, f"{k}.md", b"x") for k in range(3)] + [("b", 0, "0.md", None)], "batch string, ord int, path string, content binary")
    parts, manifest = archives.archive_parts(df)
    assert {(r.batch, r.code) for r in manifest.collect()} == {("a", "FILE_COUNT_LIMIT"), ("b", None)}
    assert [r.batch for r in parts.collect()] == ["b"]


@pytest.mark.parametrize("entries, size", [(2, 1 << 40), (1 << 40, 500)])
def test_archives_with_records_of_64_bits(spark, monkeypatch, tmp_path, entries, size):
    monkeypatch.setattr(archives, "MOST_ENTRIES", entries)
    monkeypatch.setattr(archives, "MOST_BYTES", size)
    df = spark.createDataFrame([("a", k, f"{k}.md", b"x" * k) for k in range(30)] + [("b", 0, "0.md", None)], "batch string, ord int, path string, content binary").repartition(4)
    manifest = {r.batch: r for r in archives.write_archives(df, str(tmp_path / "out"), part=300, zip64=True).collect()}
    data = {b: b"".join(bytes(r.bytes) for r in archives.read_parts(spark, str(tmp_path / "out")).filter(F.col("batch") == b).orderBy("at").collect()) for b in "ab"}
    assert all(manifest[b].size == len(data[b]) and manifest[b].code is None for b in "ab") and manifest["b"].wide_bytes == 0
    assert manifest["a"].wide_bytes == 76 + (12 * 30 if size == 500 else 0)
    with zipfile.ZipFile(io.BytesIO(data["a"])) as z:
        assert z.testzip() is None and {x.filename: x.file_size for x in z.infolist()} == {f"{k}.md": k for k in range(30)}
    # the end record is for readers of 16 bits, which must not take a part for the whole
    assert data["a"][-22:][10:12] == b"\xff\xff" and data["b"][-22:][10:12] == b"\x01\x00"


def test_more_files_than_an_archive_counts(spark, monkeypatch):
    monkeypatch.setattr(archives, "MOST_ENTRIES", 50)
    got = registry.QUERIES["archive_sizes"](spark, "/root/testdata/sf0.001").collect()
    files = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    path = F.octet_length(F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")))
    want = files.groupBy("lang").agg((F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 2 * path + 92) + 22).alias("n")).collect()
    assert {(r.batch, r.size, r.written) for r in got} == {(r.lang, r.n, r.n) for r in want}


def test_batches_of_many_exported_files(spark, tmp_path):
    spark.range(4 * 8_200).select(F.col("id").alias("s_suppkey"), F.concat(F.lit("s"), F.col("id") % 9_000).alias("s_name")).write.parquet(str(tmp_path / "supplier.parquet"))
    got = registry.QUERIES["export_checks"](spark, str(tmp_path)).collect()
    assert {(r.batch, r.code) for r in got} == {(0, None), (1, "DUPLICATE_FILE_ID"), (2, "UNSAFE_PATH"), (3, "PATH_COLLISION")}


def one_after_the_other(rows, limits):
    """(input, entry) -> breach, as a reader meets them; and what is read."""
    total = dict.fromkeys(("entries", "declared", "expanded", "output", "ms"), 0)
    found, read, dead, per = {}, set(), set(), {}
    over = lambda value, name: getattr(limits, name) is not None and value > getattr(limits, name)
    for i, e, name, declared, expanded, text, output, ms in rows:
        if i in dead:
            continue
        read.add((i, e))
        breach = None
        if e is not None:
            total["entries"] += 1
            per[i] = per.get(i, 0) + 1
        total["ms"] += ms
        if over(total["entries"], "total_entries"):
            breach = ("batch", "total_entries")
        elif over(per.get(i, 0), "archive_entries"):
            breach = ("unit", "archive_entries")
        elif over(name, "filename_bytes"):
            breach = ("unit", "filename_bytes")
        else:
            total["declared"] += declared
            total["expanded"] += expanded
            if over(total["declared"], "declared_bytes"):
                breach = ("batch", "declared_bytes")
            elif over(total["expanded"], "expanded_bytes"):
                breach = ("batch", "expanded_bytes")
            elif over(text, "text_bytes"):
                breach = ("unit", "text_bytes")
            else:
                total["output"] += output
                if over(total["output"], "output_bytes"):
                    breach = ("batch", "output_bytes")
        if breach is None and over(total["ms"], "job_timeout_ms"):
            breach = ("batch", "job_timeout_ms")
        if breach:
            found[i, e] = breach
            if breach[0] == "batch":
                break
            dead.add(i)
    return found, read


def test_budgets_against_a_reader(spark):
    rng = random.Random(9)
    schema = "input_ord int, entry_ord int, filename_bytes int, declared long, expanded long, text_bytes long, output long, elapsed_ms long"
    for trial in (2, 6):
        rows = []
        for i in range(25):
            if rng.random() < 0.3:
                rows.append((i, None, 5, 0, 0, rng.randrange(60), rng.randrange(60), 1))
            else:
                rows += [(i, e, rng.randrange(20), rng.randrange(30), rng.randrange(30), rng.randrange(50), rng.randrange(40), 1) for e in range(rng.randrange(1, 9))]
        limits = Limits(**({f: None for f in ("declared_bytes", "expanded_bytes", "output_bytes", "total_entries", "job_timeout_ms")} | [{}, {"declared_bytes": 500}, {"output_bytes": 700}, {"total_entries": 30}, {"job_timeout_ms": 40}, {"expanded_bytes": 300}, {"declared_bytes": 900, "total_entries": 50, "job_timeout_ms": 90}][trial] | {"archive_entries": 6, "filename_bytes": 17, "text_bytes": 45}))
        want, read = one_after_the_other(rows, limits)
        got = budgets.budget_account(spark.createDataFrame(rows, schema).repartition(3), limits).collect()
        assert {(r.input_ord, r.entry_ord): tuple(r.breach) for r in got if r.breach} == want, trial
        assert {(r.input_ord, r.entry_ord) for r in got if r.status != "unread"} == read, trial
    free = budgets.budget_account(spark.createDataFrame(rows, schema), Limits.none())
    assert free.filter("status <> 'fits'").count() == 0 and budgets.first_breaches(free).count() == 0
    with pytest.raises(ValueError):
        Limits(sources=0)


def test_source_budgets(spark):
    df = spark.createDataFrame([(k, f"s{k}", 10 * k) for k in range(6)], "input_ord int, input_id string, length long")
    unit = budgets.source_breaches(df, Limits(input_bytes=30, total_input_bytes=None, sources=None)).collect()
    assert sorted((r.input_ord, r.scope, r.reason) for r in unit) == [(4, "unit", "input_bytes"), (5, "unit", "input_bytes")]
    assert [(r.input_ord, r.scope, r.reason) for r in budgets.source_breaches(df, Limits(input_bytes=30, total_input_bytes=59)).collect()] == [(3, "batch", "total_input_bytes")]
    assert [(r.input_ord, r.reason) for r in budgets.source_breaches(df, Limits(sources=2)).collect()] == [(2, "sources")]


def test_stream_counts_replays_and_late_events_once(spark, tmp_path):
    rng = random.Random(3)
    kinds = ("WriteCommitted", "WriteFailed", "Skipped", "Cancelled", "ArchiveFailed")
    rows = [(k, rng.choice(kinds), f"f{rng.randrange(12)}", str(rng.randrange(2)), rng.choice(("saved", "browser-artifact")), rng.randrange(3)) for k in range(90)]
    schema = "ord int, type string, file_id string, attempt_id string, delivery string, remaining long"
    for part in range(2):  # in order of ord over the batches; replays of the first come with the last
        now = rows[45 * part : 45 * part + 45] + (rows[:30] if part else [])
        spark.createDataFrame(now, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "events"))
        fold_into(stream, str(tmp_path / "out"), str(tmp_path / "check"), keep=None).trigger(availableNow=True).start().awaitTermination(240)
    want = jobs.job_stats(spark.createDataFrame(rows, schema)).first().asDict()
    assert account(spark, str(tmp_path / "out")).first().asDict() == want


def test_running_sums(spark):
    rows = spark.range(300).select(F.col("id").alias("ord"), (F.col("id") % 3).alias("k"), F.when(F.col("id") % 7 > 0, F.col("id")).alias("v"))
    got = {r.ord: r.total for r in jobs.running(rows, {"total": "v"}, ["ord"], ["k"]).collect()}
    assert got == {i: sum(j for j in range(i + 1) if j % 3 == i % 3 and j % 7) for i in range(300)}


@pytest.mark.parametrize("name", ["front_matter_read", "import_requests"])
def test_small_tables_are_dealt_over_all_cores(spark, name):
    rows = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert rows.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_a_name_is_worked_out_once(spark):
    plan = spark.range(1).select(sanitize_filename(F.col("id").cast("string"), "md").alias("n"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("translate(") == 1


def test_what_an_expression_is_bound_to(spark):
    row = spark.range(1).select(bound(F.rand(3), lambda x: x == x).alias("same"), bound(F.lit(None).cast("int"), lambda x: x.isNull()).alias("none")).first()
    assert row.same and row.none


def test_a_budget_is_written_three_times(spark, monkeypatch):
    made = []
    for module in (jobs, budgets):
        monkeypatch.setattr(module, "written", lambda df, name="cut", keep=module.written: made.append(name) or keep(df, name))
    rows = spark.createDataFrame([(1, 1, 1, 1, 1, 1, 1, 1)], "input_ord int, entry_ord int, filename_bytes int, declared long, expanded long, text_bytes long, output long, elapsed_ms long")
    assert budgets.budget_account(rows, Limits()).first().status == "fits" and made == ["running", "running", "budget"]


def test_lines_are_totalled_before_they_are_converted(spark):
    plan = registry.QUERIES["tcy_codes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert 0 < plan.index("Generate") < plan.index("Aggregate") and plan.count("Generate") < 10


def test_claims_of_free_keys_are_not_moved(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(outputs, "running", lambda rows, sums, order, keys, keep=outputs.running: seen.append(rows) or keep(rows, sums, order, keys))
    claims = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 2), (None, 1)], "key string, ord int")
    held = spark.createDataFrame([("a", 0), ("a", 2)], "key string, n bigint")
    got = {(r.key, r.ord, r.free) for r in outputs.free_numbers(claims, held, ["key"], "ord").collect()}
    assert got == {("a", 1, 1), ("a", 2, 3), ("b", 1, 0), ("b", 2, 1), (None, 1, 0)} and seen[2].filter("key = 'b' or key is null").count() == 0


@pytest.mark.parametrize("large, told", [(2, -1), (100_000, 100_000), (0, 1)])
def test_outputs_of_small_and_large_keys(spark, monkeypatch, large, told):
    monkeypatch.setattr(outputs, "LARGE", large)
    monkeypatch.setattr(outputs, "TOLD", told)
    names = ("a.md", "A.md", "b.md", "b_converted.md", "c.", "が.md")
    rows = [(b, k, names[(k * k + len(b)) % 6]) for b in ("x", "yy", "zzz") for k in range(7 * len(b))]
    held = [("x", "a.md"), ("x", "a_converted.md"), ("zzz", "B_converted3.md"), ("yy", "other.md")]
    df = spark.createDataFrame(rows, "batch string, ord int, path string").repartition(3)
    got = {(r.batch, r.ord): r.output for r in outputs.plan_outputs(df, spark.createDataFrame(held, "batch string, path string")).collect()}
    key = str.lower
    marked = {(b, key(p)) for b, _, p in rows if "_converted" in p} | {(b, key(p)) for b, p in held}
    seen, want = set(), {}
    for b, k, path in rows:
        stem, dot, ext = path.rpartition(".")
        tries = [path] + [f"{stem}_converted{n if n > 1 else ''}{dot}{ext}" for n in range(1, 99)]
        own = lambda t: t == path and (b, key(t)) not in {(x, key(p)) for x, p in held}
        free = [t for t in tries if ((b, key(t)) not in marked or own(t)) and (b, key(t)) not in seen]
        want[b, k] = free[0]
        seen.add((b, key(free[0])))
    assert got == want


def test_archive_plan_moves_few_bytes(spark):
    context, source = spark.sparkContext._jsc.sc(), "/root/testdata/sf0.01"
    moved = lambda: context.listenerBus().waitUntilEmpty() or context.statusStore().executorSummary("driver").totalShuffleWrite()
    before = moved()
    assert registry.QUERIES["archive_plan"](spark, source).count() > 1000
    assert 0 < moved() - before < 8 * os.path.getsize(f"{source}/lineitem.parquet")
