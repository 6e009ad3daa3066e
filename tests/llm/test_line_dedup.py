import random

from kotonoha.llm import line_dedup


def brute(rows, least):
    """Numbers of the deleted lines (those with a word) by looking at every run of every text."""
    seqs = [[line for line in (t or "").split("\n") if line.encode().split()] for _, t in rows]
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0] is None, rows[r][0] or 0))
    seen, gone = set(), {}
    for r in order:
        s, out = seqs[r], set()
        own = []
        for i in range(len(s)):
            words = 0
            for j in range(i + 1, len(s) + 1):
                words += len(s[j - 1].encode().split())
                if words >= least:
                    run = tuple(s[i:j])
                    if run in seen or run in own_runs(s, i, j - i):
                        out.update(range(i, j))
                    own.append(run)
        seen.update(own)
        gone[r] = out
    return gone


def own_runs(s, i, n):
    return {tuple(s[k : k + n]) for k in range(i)}


def cleaned(text, gone):
    out, k = [], -1
    for line in text.split("\n"):
        k += bool(line.encode().split())
        if k not in gone:
            out.append(line)
    return "\n".join(out)


def corpus(rng, n):
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 1, 2, 3, 7]))) for _ in range(14)] + ["", " ", "\t"]
    rows = []
    for i in range(n):
        lines = [rng.choice(pool) for _ in range(rng.randrange(0, 12))]
        if rows and rng.random() < 0.5:
            old = rng.choice(rows)[1].split("\n")
            a = rng.randrange(len(old))
            lines[rng.randrange(len(lines) + 1) : 0] = old[a : a + rng.randrange(1, 9)]
        rows.append((i, "\n".join(lines)))
    return rows


def check(spark, rows, least):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, w string")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df, min_words=least).collect()}
    gone = brute(rows, least)
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        assert got[i].n_deleted == len(gone[k]) and got[i].w == "x"
        assert got[i].text == (t if t is None else cleaned(t, gone[k])), (i, t)


def test_random_corpora(spark):
    rng = random.Random(7)
    for least in (1, 4, 9):
        check(spark, corpus(rng, 60), least)


def test_edges(spark):
    long = "\n".join(f"line {i} of some words" for i in range(300))
    hot = "one line that is everywhere"
    rows = [(1, None), (2, ""), (3, long), (4, hot + "\n" + long), (5, hot), (6, hot), (7, "\n".join([hot] * 40)), (8, "\n" + long + "\n\n"), (None, "x\n" + long)]
    check(spark, rows, 50)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_repeated_rows(spark):
    """Rows that repeat both id and text count as one, and what repeats their lines elsewhere still goes."""
    ten = "\n".join(f"line {i} of these has as many as ten words now" for i in range(10))
    other = "\n".join(f"row {i} with a null id and ten words in it" for i in range(10))
    rows = [(1, ten)] * 3 + [(2, "before\n" + ten + "\nafter"), (3, "alone"), (None, other), (None, other), (None, other + "\nend")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r.doc_id or 9, r.text, r.deleted) for r in line_dedup.dedup_lines(df).collect()), key=str)
    null = sorted(r for r in got if r[0] == 9)
    assert [r for r in got if r[0] != 9] == [(1, ten, "")] * 3 + [(2, "before\nafter", "1-11"), (3, "alone", "")]
    # which of the two null texts comes first is a matter of their hashes
    assert len(null) == 3 and sorted(r[1] for r in null) in (sorted([other, other, "end"]), sorted(["", "", other + "\nend"]))
    rng = random.Random(3)
    once = corpus(rng, 40)
    gone = brute(once, 9)
    twice = line_dedup.dedup_lines(spark.createDataFrame(once + once, "doc_id bigint, text string"), min_words=9).collect()
    assert len(twice) == 80
    for r in twice:
        assert r.n_deleted == len(gone[r.doc_id]) and r.text == cleaned(once[r.doc_id][1], gone[r.doc_id])


def test_table(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    gone = brute(docs, 50)
    got = {r.doc_id: r for r in line_dedup.op4_line_dedup(spark, d).collect()}
    for k, (i, t) in enumerate(docs):
        assert got[i].n_deleted == len(gone[k]) and got[i].text == cleaned(t, gone[k])
