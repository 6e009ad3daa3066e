"""Sources, names, jobs, exports and streams."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from kotonoha.functions import jis, names, text
from kotonoha.functions.decode import decode_text
from kotonoha.operators import metadata
from kotonoha.operators.notes import with_lines
from kotonoha.plans import jobs
from kotonoha.plans.exports import UNLIMITED, ExportLimits, artifact_problems, checked
from kotonoha.plans.imports import ImportLimits, identity_problems, prepare_import
from kotonoha.plans.outputs import plan_outputs
from kotonoha.plans.budgets import Limits
from kotonoha.sources.files import entries, export_archives, read_sources, texts
from kotonoha.streaming.jobs import account, distinct_events, fold_into


def test_decode(spark):
    cases = [
        ("e38182e38184", "cp932", ("縺ゅ＞", "cp932", None)), ("8160", "shift_jis", ("〜", "shift_jis", None)), ("8160", "cp932", ("～", "cp932", None)), ("efbbbf41", "cp932", (None, None, "ENCODING_BOM_CONFLICT")),
        ("efbbbf410d0a42", "auto", ("A\nB", "utf-8", None)), ("fffe4100", "auto", (None, None, "UNSUPPORTED_ENCODING")), ("82a0", "auto", ("あ", "cp932", None)), ("8101", "auto", (None, None, "DECODE_FAILED")), ("", "auto", ("", "utf-8", None)), (None, None, ("", "utf-8", None)),
    ]
    df = spark.createDataFrame([(i, bytes.fromhex(h) if h is not None else None, e) for i, (h, e, _) in enumerate(cases)], "i int, b binary, e string")
    got = df.withColumn("d", decode_text("b", "e")).orderBy("i").collect()
    for r, (_, _, want) in zip(got, cases):
        assert (r.d.text, r.d.encoding, r.d.code) == want


def test_text(spark):
    df = spark.createDataFrame([("a\r\nb\x0bc\n",), ("",), ("  x　",), ("𠀋１２",)], "t string")
    got = df.select(text.split_lines("t").alias("lines"), text.strip("t").alias("s"), text.utf16_length("t").alias("n"), text.fullwidth_digits("t").alias("d"), F.concat_ws("|", text.code_points("t")).alias("p"), text.is_delimiter(F.lit("　-----")).alias("rule"), text.source_window(F.encode(F.lit("aあ"), "UTF-8"), 3).alias("w"), text.file_id("t", F.lit(2)).alias("id")).collect()
    assert got[0].lines == ["a", "b", "c"] and got[1].lines == [] and got[2].s == "x" and (got[3].n, got[3].d, got[3].p) == (4, "𠀋12", "𠀋|１|２")
    assert got[0].rule and bytes(got[0].w) == b"a" and got[2].id == '["  x　",2]'


def test_jis(spark):
    places = [(1, 16, 1, "亜"), (1, 4, 87, "か゚"), (2, 1, 1, "𠂉"), (1, 94, 95, None), (3, 1, 1, None), (1, 1, 1, "　"), (None, 1, 1, None)]
    df = spark.createDataFrame(places, "p int, r int, c int, want string")
    assert all(x.got == x.want for x in df.withColumn("got", jis.at(F.col("p"), F.col("r"), F.col("c"))).collect())
    assert jis.table(spark).filter("value is not null").count() == 17_300


def test_names(spark):
    cases = [("CON.txt", "_CON.txt"), (". .", "untitled"), ("a/b:c*", "a_b_c_"), ("\x00x\x85", "x"), ("nul", "_nul"), ("あ" * 200, "あ" * 80)]
    df = spark.createDataFrame(cases, "n string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", names.sanitize_filename("n")).collect())
    assert df.limit(1).select(names.sanitize_filename(F.lit("𠀀" * 101)).alias("x")).first().x == "𠀀" * 60
    keys = spark.createDataFrame([("A/が. ", "a/が")], "p string, want string").withColumn("got", names.collision_key("p")).first()
    assert keys.got == keys.want
    flags = spark.createDataFrame([(True, True, True, True, False, False, False, "ok"), (True, True, False, True, False, False, False, "EXCLUSIVE_CREATE_UNAVAILABLE"), (True, True, True, True, True, False, False, "UNSAFE_DESTINATION")], "a boolean, b boolean, c boolean, d boolean, e boolean, f boolean, g boolean, want string")
    assert all(r.got == r.want for r in flags.withColumn("got", names.destination_check(*(F.col(c) for c in "abcdefg"))).collect())


def test_output_plan(spark):
    requests = spark.createDataFrame([("b", k, "work.md") for k in range(3)] + [("b", 9, "other.md"), ("c", 0, "work.md")], "batch string, ord int, path string")
    taken = spark.createDataFrame([("b", "work.txt"), ("b", "work.md"), ("b", "work_converted.md"), ("b", "WORK_converted2.md")], "batch string, path string")
    got = {(r.batch, r.ord): r.output for r in plan_outputs(requests, taken).collect()}
    assert got == {("b", 0): "work_converted3.md", ("b", 1): "work_converted4.md", ("b", 2): "work_converted5.md", ("b", 9): "other.md", ("c", 0): "work.md"}


def test_front_matter(spark):
    cases = {
        "---\ntitle: 題 # x\nauthors: [甲, \"乙\"]\nraw_header: |-\n  a\n  b\n---\n本文": (True, "題", ["甲", "乙"], "a\nb"),
        "---\nauthors: 夏目漱石\n---": (True, None, ["夏目漱石"], None),
        "---\ntitle: a\ntitle: b\n---": (False, "a", None, None),
        "---\ntitle: &x a\n---": (False, "&x a", None, None),
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id int, text string")
    rows = metadata.read_front_matter(with_lines(df)).orderBy("doc_id").collect()
    assert [(r.front.ok, r.front.title, r.front.authors, r.front.raw_header) for r in rows] == list(cases.values())
    none = metadata.read_front_matter(with_lines(spark.createDataFrame([(1, "---\nopen"), (2, None)], "doc_id int, text string"))).collect()
    assert {r.doc_id: r.front and (r.front.ok, r.front.reason) for r in none} == {1: (False, "unclosed-envelope"), 2: None}


def test_jobs(spark):
    e = [("WriteFailed", "a", "1", 0), ("WriteFailed", "a", "1", 0), ("WriteCommitted", "b", "1", 2), ("WriteCommitted", "b", "1", 2), ("WriteCommitted", "b", "2", 0), ("Skipped", "c", "1", 0), ("Cancelled", "d", "1", 0), ("ArchiveFailed", "z", "1", 0)]
    df = spark.createDataFrame([(k, t, f, a, "saved", n) for k, (t, f, a, n) in enumerate(e)], "ord int, type string, file_id string, attempt_id string, delivery string, remaining long")
    r = jobs.job_stats(df).first()
    assert (r.files_converted, r.files_skipped, r.errors, r.files_with_remaining_notes, r.remaining_notes, r.cancelled_files) == (1, 1, 2, 1, 2, 1)
    empty = jobs.job_stats(df.limit(0)).first()
    assert empty.files_converted == 0
    rows = spark.createDataFrame([("b", k, 5) for k in range(4)], "batch string, ord int, size int")
    assert [x.fits for x in jobs.running_budget(rows, "size", 10, "ord", "batch").orderBy("ord").collect()] == [True, True, False, False]
    assert [x.ord for x in jobs.first_over(rows, "size", 10, "ord", "batch").collect()] == [2]


def test_export(spark):
    rows = [("b", k, f"f{k}", p, "md", c) for k, (p, c) in enumerate([("a.md", b"A"), ("x/c.md", b""), ("あ.md", b"z" * 9)])]
    schema = "batch string, ord int, file_id string, path string, format string, content binary"
    df = spark.createDataFrame(rows, schema)
    assert artifact_problems(df).first().code is None
    archive = bytes(export_archives(df.select("batch", "ord", "path", "content")).first().archive)
    with zipfile.ZipFile(io.BytesIO(archive)) as z:
        assert z.testzip() is None and z.namelist() == ["a.md", "x/c.md", "あ.md"] and z.read("あ.md") == b"z" * 9
        assert all(i.flag_bits & 8 and i.external_attr >> 16 == 0o100644 for i in z.infolist())
    bad = [("f0", "a.md", "md", b""), ("f0", "b.md", "md", b""), ("f2", "A.md", "md", b""), ("f3", "b.exe", "md", b""), ("f4", "a.md/x.md", "md", b""), (" ", "q.md", "md", b""), ("f6", "r.md", "pdf", b""), ("f7", "s.md", "md", None), ("f8", "t.md", "md", b"x" * 20)]
    codes = [r.code for r in checked(spark.createDataFrame([("b", k, *r) for k, r in enumerate(bad)], schema), ExportLimits(file_bytes=10)).orderBy("ord").collect()]
    assert codes == ["PATH_COLLISION", "DUPLICATE_FILE_ID", "PATH_COLLISION", "UNSAFE_PATH", None, "INVALID_FILE_ID", "INVALID_FORMAT", "INVALID_BYTES", "FILE_BYTES_LIMIT"]
    sums = {r.ord: r.code for r in checked(df, ExportLimits(input_bytes=5)).collect()}
    assert sums == {0: None, 1: None, 2: "INPUT_BYTES_LIMIT"} and {r.code for r in checked(df, UNLIMITED).collect()} == {None}
    assert artifact_problems(df, ExportLimits(files=2)).first().code == "FILE_COUNT_LIMIT" and checked(df.limit(0)).count() == 0
    assert artifact_problems(df, mode="single").first().code == "SINGLE_FILE_COUNT"
    for call in (lambda: ExportLimits(files=0), lambda: ImportLimits(sources=True), lambda: artifact_problems(df, mode="x")):
        with pytest.raises(ValueError):
            call()


def test_import(spark, tmp_path):
    (tmp_path / "in").mkdir()
    with zipfile.ZipFile(tmp_path / "in/pack.zip", "w") as z:
        z.writestr("dir/one.txt", "青［＃「青」は太字］".encode("cp932"))
        z.writestr("skip.png", b"x")
    (tmp_path / "in/bad.zip").write_bytes(b"no archive")
    (tmp_path / "in/a.txt").write_text("題\n人\n\n※［＃U+0041］［＃不明］", encoding="utf-8")
    (tmp_path / "in/b.md").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "in/a_converted2.md").write_text("old")
    sources = read_sources(spark, str(tmp_path / "in"))
    assert sorted(r.name for r in sources.collect()) == ["a.txt", "b.md", "bad.zip", "pack.zip"]
    assert {(r.raw_name, r.problem) for r in entries(sources).collect()} == {("dir/one.txt", None), ("skip.png", None), ("", "ZIP_INVALID")}
    assert identity_problems(sources, ImportLimits()).count() == 0 and identity_problems(sources, ImportLimits(sources=3)).first().code == "LIMIT_EXCEEDED"
    tight = entries(sources, Limits(archive_entries=1)).collect()
    assert {(r.raw_name, r.problem) for r in tight} == {("", "LIMIT_EXCEEDED"), ("", "ZIP_INVALID")}
    assert {r.problem for r in entries(sources, Limits.none()).collect()} == {None, "ZIP_INVALID"}
    assert {(r.name, r.code) for r in texts(sources, limits=Limits(text_bytes=30)).collect() if r.name == "a.txt"} == {("a.txt", "LIMIT_EXCEEDED")}
    done = prepare_import(sources, limits=Limits.none())
    got = {r.path: (r.text, r.remaining_notes) for r in done.artifacts.collect()}
    assert got == {"a.md": ("---\ntitle: 題\nauthor: 人\n---\n\nA［＃不明］", 1), "pack/dir/one.md": ("**青**", 0)}
    assert sorted((r.status, r.code or "") for r in done.outcomes.collect()) == [("failed", "UNSUPPORTED_ENCODING"), ("failed", "ZIP_INVALID"), ("ignored", ""), ("ready", ""), ("ready", "")]
    a = done.account.first()
    assert (a.files_converted, a.errors, a.files_skipped, a.remaining_notes) == (2, 2, 1, 1) and done.status.first().status == "partial"


def test_stream(spark, tmp_path):
    schema = "ord int, type string, file_id string, attempt_id string, delivery string, remaining long, ts timestamp"
    rows = spark.createDataFrame([(k, "WriteCommitted", f"f{k % 3}", "1", "saved", 1) for k in range(9)], schema.rsplit(",", 1)[0]).withColumn("ts", F.current_timestamp())
    rows.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "events"))
    assert distinct_events(stream).isStreaming
    query = fold_into(stream, str(tmp_path / "out"), str(tmp_path / "check"), keep=None).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert account(spark, str(tmp_path / "out")).first().files_converted == 3


def test_archives(spark):
    from kotonoha.plans.archives import archive_problems, plan_archives

    rows = [
        ("a", 0, "x", "x", 0, 0, "d/one.txt", 0, "X?", False), ("a", 0, "x", "x", 1, 1, "d/one.md", 0, "X?", False), ("a", 0, "x", "x", 2, 2, "d/", 0, "X?", True), ("a", 1, "y", "y", 0, 0, "p.png", 0, "Y", False),
        ("b", 0, "x", "x", 0, 0, "one.txt", 0, "X", False), ("b", 1, "x", "x", 0, 0, "../one.txt", 0, "X", False),
        ("c", 0, "z", "z", 0, 0, "l.txt", 0xA1FF, "Z", False), ("d", 0, "z", "z", 0, 5, "l.txt", 0, "Z", False), ("d", 0, "z", "z", 1, 5, "m.txt", 0, "Z", False),
    ]
    df = spark.createDataFrame([(*r[:7], r[6], *r[7:]) for r in rows], "batch string, archive_ord int, archive_id string, owner_id string, entry_ord int, index int, raw_name string, name string, mode int, stem string, directory boolean")
    assert {(r.batch, r.archive_id, r.reason) for r in archive_problems(df).collect()} == {("b", "x", "duplicate-archive-identity"), ("c", "z", "symlink"), ("d", "z", "invalid-entry-identity")}
    got = {(r.batch, r.archive_id, r["index"]): r.output for r in plan_archives(df, df.limit(0).select("batch", F.col("name").alias("path"))).collect()}
    assert got == {("a", "x", 0): "X_/d/one.md", ("a", "x", 1): "X_/d/one_converted.md", ("a", "x", 2): None, ("a", "y", 0): None}
    assert plan_archives(df.limit(0), df.select("batch", F.col("name").alias("path"))).count() == 0


def test_remaining_notes_of_repeated_ids(spark):
    from kotonoha.operators.convert import with_remaining

    note = "［＃残］"
    df = spark.createDataFrame([(1, note), (1, note * 2), (None, note + "`" + note + "`"), (2, None), (3, "```\n" + note + "\n```\n" + note)], "doc_id bigint, text string")
    assert sorted((r.doc_id or 0, r.remaining_notes) for r in with_remaining(df).collect()) == [(0, 1), (1, 1), (1, 2), (2, 0), (3, 1)]


def test_budget_in_ranges(spark):
    rows = spark.range(500).select(F.col("id").alias("ord"), F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 2).alias("batch"), (F.col("id") % 7).alias("size"))
    got = {r.ord: r.used for r in jobs.running_budget(rows, "size", 10, "ord", "batch").collect()}
    used = {}
    for i in range(500):
        b = None if i % 3 == 0 else i % 2
        used[b] = used.get(b, 0) + i % 7
        assert got[i] == used[b]


def test_front_matter_of_every_kind(spark):
    cases = [
        ("---\ntitle: |\n  山\n  ---\n  川\nauthor: 甲\n---\n本文", "山\n---\n川\n", None),
        ("---\ntitle: \"山\n  ---\n  川\"\n---\n本文", "山 --- 川", None),
        ("---\ntitle: '山\n  --- \n  川'\nauthor: 甲\n---\n本文", "山 --- 川", None),
        ("---\nother:\n  - |\n   x\n   ---\ntitle: 山\n---\n", "山", None),
        ("---\ntitle: |-\n    深い\n     行\n---\n", "深い\n 行", None),
        ("---\nx: |\n  a\n---\ntitle: 本文\n---", None, None),
        ("---\ntitle: 山\n   ---\n本文", "山", None),
        ("---\ntitle: 山", None, "FRONTMATTER_PARSE_FAILED:unclosed-envelope"),
        ("---\ntitle: *a\n---", "*a", "FRONTMATTER_PARSE_FAILED:alias-or-tag"),
        ("---\nauthors: [甲\n---", None, "FRONTMATTER_PARSE_FAILED:invalid-mapping"),
        ("---\ntitle: {a: b}\n---", "{a: b}", "FRONTMATTER_INVALID_TYPE:title"),
        ("---\nauthors:\n  - 甲\n  - 名: 乙\n---", None, "FRONTMATTER_INVALID_TYPE:authors"),
        ("---\n---\n本文", None, None),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "doc_id int, text string")
    for r, (text, title, code) in zip(metadata.read_front_matter(with_lines(df)).orderBy("doc_id").collect(), cases):
        assert (r.front.title, r.front.code and f"{r.front.code}:{r.front.reason}") == (title, code), text


def test_conversion_keeps_front_matter(spark):
    from kotonoha.operators.convert import Options, convert

    texts = ["---\ntitle: 山\nauthors: [甲, 乙]\ntranslator: 丙\nraw_header: 副題\n---\n\n\n青［＃「青」は太字］", "---\ntitle: 山\n---\n 山 \n本文", "---\ntitle: &x\n  - 山\n---\n本文", "題\n人\n\n本文", "---\ntitle: |\n  甲\n  ---\n  ［＃改ページ］\n---\n［＃改ページ］"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    kept = {r.doc_id: r for r in convert(df, Options(keep_header=True, page_breaks=True)).collect()}
    assert kept[0].text == "---\ntitle: 山\nauthors: [甲, 乙]\ntranslator: 丙\nraw_header: 副題\n---\n山\n副題\n甲\n乙\n丙\n\n**青**" and kept[0].front_matter_restored
    assert (kept[0].naming.title, kept[0].naming.author) == ("山", "甲")
    assert kept[1].text == texts[1] and not kept[1].front_matter_restored
    assert kept[2].text == texts[2] and kept[2].naming is None and [d.code for d in kept[2].diagnostics] == ["FRONTMATTER_PARSE_FAILED"]
    assert kept[3].text == "---\ntitle: 題\nauthor: 人\n---\n\n題\n人\n\n本文" and kept[3].front_matter_added
    assert kept[4].text == "---\ntitle: |\n  甲\n  ---\n  ［＃改ページ］\n---\n甲\n---\n［＃改ページ］\n\n\n:::page-break\n:::"
    plain = {r.doc_id: r for r in convert(df, Options(front_matter=False)).collect()}
    assert plain[3].text == texts[3] and plain[0].text.endswith("---\n\n\n**青**") and [d.code for d in plain[2].diagnostics] == ["FRONTMATTER_PARSE_FAILED"]


def test_output_tree_against_one_after_the_other(spark):
    import random
    import unicodedata

    from kotonoha.plans.outputs import plan_tree

    rng = random.Random(11)
    key = lambda p: "/".join(unicodedata.normalize("NFC", s).lower().rstrip(" .") for s in p.split("/"))
    mark = lambda n: "" if n == 0 else "_converted" if n == 1 else f"_converted{n}"
    names, stems = ["a", "B", "b", "c"], ["x", "X", "y"]
    requests, taken = [], []
    for b in range(12):
        for k in range(rng.randrange(1, 14)):
            dirs = [{"name": rng.choice(names), "group": rng.choice("pqr")} for _ in range(rng.randrange(0, 4))]
            requests.append((b, k, "/".join([d["name"] for d in dirs] + [rng.choice(stems) + ".md"]), dirs))
        taken += [(b, p, kind) for p, kind in [("a", "file"), ("b/b", "file"), ("b", "directory"), ("c/x.md", "file"), ("x_converted.md", "file"), ("a_converted/a", "file"), ("B/b_converted", "directory")] if rng.random() < 0.5]
    want, folders = {}, set()
    for b in range(12):
        held = {}
        for _, p, kind in [t for t in taken if t[0] == b]:
            parts = p.split("/")
            for n in range(1, len(parts)):
                held.setdefault(key("/".join(parts[:n])), "directory")
            held[key(p)] = "file" if kind == "file" or held.get(key(p)) == "file" else "directory"
        groups, claimed = {}, {}
        for _, k, path, dirs in [r for r in requests if r[0] == b]:
            parent = ""
            for d in dirs:
                if (parent, d["group"]) not in groups:
                    n = 0
                    while held.get(key(parent + d["name"] + mark(n))) == "file" or key(parent + d["name"] + mark(n)) in claimed:
                        n += 1
                    made = parent + d["name"] + mark(n)
                    held[key(made)] = "directory"
                    claimed[key(made)] = groups[parent, d["group"]] = made
                    folders.add((b, made))
                parent = groups[parent, d["group"]] + "/"
            stem, n = path.rsplit("/", 1)[-1][:-3], 0
            while key(f"{parent}{stem}{mark(n)}.md") in held:
                n += 1
            want[b, k] = f"{parent}{stem}{mark(n)}.md"
            held[key(want[b, k])] = "file"
    df = spark.createDataFrame(requests, "batch int, ord int, path string, directories array<struct<name:string,group:string>>")
    tree = plan_tree(df, spark.createDataFrame(taken, "batch int, path string, kind string"))
    assert {(r.batch, r.ord): r.output for r in tree.outputs.collect()} == want
    assert {(r.batch, r.output) for r in tree.directories.collect()} == folders and tree.problems.count() == 0


def test_output_tree_problems(spark):
    from kotonoha.plans.outputs import plan_outputs, plan_tree

    paths = ["../x.md", "/x.md", "C:x.md", "a//x.md", "a\\..\\x.md", "x.long", "", None, "a/\x01.md"]
    rows = [(k, 0, "fine.md") for k in range(len(paths))] + [(k, 1, p) for k, p in enumerate(paths)] + [(99, 0, "著者/題.md"), (99, 1, "著者/別.TXT"), (98, 0, "work_converted.md")]
    none = spark.createDataFrame([(99, "著者", "file"), (98, "work_converted.md", "file")], "batch int, path string, kind string")
    tree = plan_tree(spark.createDataFrame(rows, "batch int, ord int, path string"), none)
    assert {(r.batch, r.output) for r in tree.outputs.collect()} == {(99, "著者_converted/題.md"), (99, "著者_converted/別.txt"), (98, "work_converted_converted.md")}
    assert sorted((r.batch, r.ord) for r in tree.problems.collect()) == [(k, 1) for k in range(len(paths))]
    empty = spark.createDataFrame([], "batch int, ord int, path string")
    assert plan_tree(empty, none).outputs.count() == 0 and plan_outputs(empty, none).count() == 0


def test_decimal(spark):
    given = {"0": 0, "0012": 12, "１２": 12, "٣४": 34, "𝟘𝟙": 1, "9" * 16: (1 << 53) - 1, "9007199254740991": (1 << 53) - 1, "0" * 4300: 0, "0" * 4301: None, "": None, "-1": None, "1 ": None, "²": None, "Ⅳ": None, "1.5": None}
    df = spark.createDataFrame([(k,) for k in given] + [(None,)], "t string")
    assert {r.t: r.n for r in df.select("t", text.decimal("t").alias("n")).collect()} == {**given, None: None}


def test_plain_fields(spark):
    given = {
        "---\ntitle: 甲\n---\n本文": [("title", "甲", None)],
        "---\ntitle: 甲\ntitle: 乙\nx y\n z: 1\nnone:\n---": [("title", "乙", None)],
        "---\nauthors:\n  - 甲\n  -乙\ntranslators: 丙\n---": [("authors", None, ["甲"]), ("translators", "丙", None)],
        "---\ntitle: 甲": None,
        "題\n---": None,
        "---\n---": None,
        "": None,
        "---\nauthors:\n" + "  - 甲\n" * 20_000 + "---": [("authors", None, ["甲"] * 20_000)],
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*given, None])], "doc_id int, text string")
    got = {r.doc_id: None if r.fields is None else [tuple(f) for f in r.fields] for r in metadata.plain_fields(with_lines(df)).select("doc_id", "fields").collect()}
    assert got == {**dict(enumerate(given.values())), len(given): None}
