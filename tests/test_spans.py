"""Ranges over rows, protected ranges and the overlap join, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from kotonoha.operators import blocks, inline, ranges, spans
from kotonoha.operators.notes import with_lines


def test_overlaps_against_all_pairs(spark):
    rng = random.Random(4)
    rows = lambda n: [(rng.choice(["a", "b", None]), s := rng.randrange(400), s + rng.choice([0, 1, 5, 90, 300]), k) for k in range(n)]
    left, right = rows(120), rows(80)
    schema = "doc string, start bigint, end bigint, k int"
    got = ranges.overlaps(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["doc"], bin_=16)
    want = sorted((a[3], b[3]) for a in left for b in right if a[0] == b[0] and a[1] < b[2] and b[1] < a[2] and a[1] < a[2] and b[1] < b[2])
    assert sorted((r.k, r.right_k) for r in got.collect()) == want and len(want) > 300
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_protected_ranges(spark):
    cases = {
        "---\na: |\n  ---\n---\n`x` ``y`z``": [("frontmatter", "---\na: |\n  ---\n---"), ("inline-code", "`x`"), ("inline-code", "``y`z``")],
        "𠀋\n~~~~\nb\n~~~\n~~~~\n```\nc": [("fence", "~~~~\nb\n~~~\n~~~~"), ("fence", "```\nc")],
        "---\nopen\n`x`": [("frontmatter", "---\nopen\n`x`")],
        "`a\nb` c": [],
        "": [],
    }
    df = spark.createDataFrame([(k, t) for k, t in enumerate(cases)] + [(None, None)], "doc_id int, text string")
    found = {}
    for r in ranges.protected_ranges(df).collect():
        units = list(cases)[r.doc_id].encode("utf-16-le")
        found.setdefault(r.doc_id, []).append((r.kind, units[2 * r.start : 2 * r.end].decode("utf-16-le"), r.start))
    for k, want in enumerate(cases.values()):
        assert [x[:2] for x in sorted(found.get(k, []), key=lambda x: x[2])] == want


def test_repeated_rows_keep_their_notes(spark):
    df = spark.createDataFrame([(1, "［＃a］`［＃b］`")] * 3 + [(None, "［＃c］"), (None, "［＃c］")], "doc_id int, text string")
    got = ranges.notes_by_protection(df).groupBy("doc_id", "note", "protection").count().collect()
    assert {(r.doc_id, r.note, r.protection, r["count"]) for r in got} == {(1, "［＃a］", None, 3), (1, "［＃b］", "inline-code", 3), (None, "［＃c］", None, 2)}
    assert spans.note_pairs(df.limit(0)).count() == 0 and ranges.notes_by_protection(df.limit(0)).count() == 0


def test_pairs_against_a_stack_of_one(spark):
    rng = random.Random(7)
    notes = ["［＃太字］", "［＃太字終わり］", "［＃ここから傍点］", "［＃ここで傍点終わり］", "［＃左に傍線］", "［＃左に傍線終わり］", "x", "\n", "［＃改ページ］", "\n~~~\n［＃太字］\n~~~\n"]
    texts = ["".join(rng.choice(notes) for _ in range(30)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {(r.doc_id, r.kind, r.start, r.end, r.depth, r.status) for r in spans.note_pairs(df).collect()}
    events = {}
    for r in spans.note_events(df).collect():
        assert texts[r.doc_id][r.start : r.end] == r.note
        events.setdefault((r.doc_id, r.kind), []).append((r.start, r.end, r.line, r.side))
    want = set()
    for (doc, kind), found in events.items():
        opened, fences = None, [k for k, x in enumerate(texts[doc].split("\n"), 1) if x == "~~~"]
        for start, end, line, side in sorted(found):
            if side == "open":
                opened = [start, line, opened[2] + 1] if opened is None and False else [*opened[:2], opened[2] + 1] if opened else [start, line, 1]
            elif side == "close":
                crossing = opened and any(opened[1] < f < line for f in fences)
                want.add((doc, kind, opened[0], end, opened[2], "crossing" if crossing else "paired") if opened else (doc, kind, start, end, 0, "unopened"))
                opened = None
        if opened:
            want.add((doc, kind, opened[0], None, opened[2], "unclosed"))
    assert got == want and len(want) > 100


OVER = [
    (inline.gaiji, "※［＃「木」、\n第3水準1-14-2］x", "𠀋x", (1, 0)),
    (inline.gaiji, "木［＃「木」は\n第3水準1-14-2］x\ny", "𠀋x\ny", (1, 0)),
    (inline.gaiji, "※［＃無\n```\nし］\n```", None, (0, 0)),
    (inline.gaiji, "※［＃無\n\nし］", None, (0, 1)),
    (inline.gaiji, "a※［＃閉じない\nb", None, (0, 0)),
    (inline.tcy, "1［＃「1\n2」は縦中横］", None, (0, 1)),
    (inline.bouten, "［＃傍点］あ\nい［＃傍点終わり］う［＃傍点］え［＃傍点終わり］", "［＃傍点］あ\nい［＃傍点終わり］う｜え《﹅》", (1, 1)),
    (inline.bouten, "［＃傍点］あ\n```\n```\nい［＃傍点終わり］", None, (0, 0)),
    (inline.bouten, "［＃傍点］あ\nい［＃丸傍点］う［＃丸傍点終わり］", "［＃傍点］あ\nい｜う《﹅》", (1, 0)),
    (inline.bouten, "《\n青［＃「青」に\n傍点］", None, (0, 0)),
    (inline.underline, "｟12｠［＃「2｠」に傍線］", None, (0, 1)),
    (inline.underline, "｟12｠［＃「｟12｠」に傍線］", "||｟12｠||", (1, 0)),
]


@pytest.mark.parametrize("stage", {f for f, *_ in OVER})
def test_over_rows(spark, stage):
    cases = [c[1:] for c in OVER if c[0] is stage]
    df = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(cases)], "doc_id int, text string")
    rows = stage(with_lines(df)).orderBy("doc_id").collect()
    for r, (text, want, counts) in zip(rows, cases):
        assert "\n".join(r.lines) == (want or text), text
        assert (r[f"{stage.__name__}_converted"], r[f"{stage.__name__}_unconverted"]) == counts, text
        assert len(r.shield) == len(r.lines)


def test_long_documents(spark):
    """80,000 rows, one block over all of them: time in proportion."""
    import time

    n = 80_000
    text = "［＃ここから太字］\n" + "あ\n" * n + "［＃ここで太字終わり］\n" + "［＃改ページ］\nい\n" * 1000
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    began = time.time()
    got = blocks.page_breaks(inline.emphasis(with_lines(df))).first()
    assert got.emphasis_bold == 1 and got.page_page_breaks == 1000 and got.lines[0] == "**あ**" and len(got.lines) == n + 3001
    assert time.time() - began < 90


def test_texts_in_one_row_group_are_dealt_and_notes_found_once(spark, tmp_path):
    text = "a［＃注］\n`b［＃注］`\n~~~\n［＃注］\n~~~"
    df = spark.createDataFrame([(i, text) for i in range(20)], "doc_id bigint, text string")
    df.coalesce(1).write.parquet(f"{tmp_path}/d")
    df = spark.read.parquet(f"{tmp_path}/d")
    found = ranges.notes_by_protection(df, pattern="［＃注］")
    assert "［＃注］" not in found._jdf.queryExecution().optimizedPlan().toString()  # written, not found anew for each join
    got = sorted((r.doc_id, r.line, r.protection) for r in found.collect())
    assert got == [(i, line, kind) for i in range(20) for line, kind in ((1, None), (2, "inline-code"), (4, "fence"))]
    assert spans.laid_out(df, "doc_id", "text").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
