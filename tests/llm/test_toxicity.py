import math
import random

from pyspark.sql import functions as F

from kotonoha.llm import toxicity as tox


def brute_segments(scores):
    """Maximal segments by their definition: the best segment (leftmost, then shortest), then the same on either side."""
    best = None
    for a in range(len(scores)):
        for b in range(a + 1, len(scores) + 1):
            s = round(sum(scores[a:b]), 9)
            if s > 0 and (best is None or s > best[2]):
                best = (a, b, s)
    if best is None:
        return []
    a, b, _ = best
    return brute_segments(scores[:a]) + [best] + [(x + b, y + b, z) for x, y, z in brute_segments(scores[b:])]


def test_segments():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randrange(0, 25)
        scores = [rng.choice([-1.0] * 6 + [2.13, 3.71, 5.57]) for _ in range(n)]
        got = tox.segments([(i, s) for i, s in enumerate(scores) if s > 0], n, 1.0)
        assert [(a, b, round(s, 9)) for a, b, s in got] == brute_segments(scores)


def test_held_out(spark):
    d = "/root/testdata/sf0.1"
    got = tox.op9_toxicity(spark, d)
    labels = spark.read.parquet(f"{d}/labels.parquet")
    r = got.filter("held_out").join(labels, "doc_id").agg(F.sum(F.expr("int(toxic = 1 and predicted = 1)")).alias("tp"), F.sum(F.expr("int(toxic = 0 and predicted = 1)")).alias("fp"), F.sum("toxic").alias("p"), F.count("*").alias("n")).first()
    print(r)
    assert r.tp >= 0.9 * r.p and r.fp <= 0.01 * r.n
    assert got.count() == spark.read.parquet(f"{d}/documents.parquet").count()


def test_edges(spark):
    rows = [(1, "nice words here", 3), (2, None, 4), (3, "", 5), (None, "awful " * 5000, 6), (5, "awful awful thing", 1)] + [(i, f"awful thing w{i}" if i % 2 else f"nice thing w{i}", 0) for i in range(10, 60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, score int")
    marks = spark.createDataFrame([(i, i % 2) for i in range(10, 60)] + [(11, 0), (None, 1), (12, None)], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in tox.passages(df, tox.fit(df, marks)).collect()}
    assert len(got) == len(rows) and got[5].score > 0.5 > got[1].score and got[None].score > 0.5
    assert got[2].score == got[3].score < 0.5 and got[5].segments[0].start == 0
    one = tox.fit(df, marks.filter("toxic = 0"))
    assert {round(r.score, 6) for r in tox.passages(df, one).collect()} == {round(0.5 / 27, 6)}
    assert tox.passages(df.limit(0), tox.fit(df.limit(0), marks)).count() == 0


def test_score_against_brute_force(spark):
    """Scores from all stretches of a text: maximal ones, their evidence and the curve, without the scan."""
    model = tox.Model({b"bad ": 3.0, b"awfu": 2.0, b"awful ": 4.0, b"meh ": 0.4}, lam=0.7, slope=0.8, offset=-1.5)
    rng = random.Random(3)
    texts = [None, "", "bad", "!!", " ".join(["fine"] * 30)] + [" ".join(rng.choice(["bad", "Awful", "awfully", "meh", "fine", "ok", "Ünd"]) for _ in range(rng.randrange(1, 40))) for _ in range(40)]
    values = {"bad": 3.0, "awful": 4.0, "awfully": 2.0, "meh": 0.4}

    def maximal(x, a, b):
        """Maximal segments as their definition has them: the best one (the shortest of equals), and those beside it."""
        best = max(((sum(x[i:j]), i - j, -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None, key=lambda s: (round(s[0], 9), s[1], s[2]))
        if best is None or best[0] <= 1e-9:
            return []
        return maximal(x, a, best[3]) + [best[0]] + maximal(x, best[4], b)

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in tox.passages(df, model).collect()}
    for i, text in enumerate(texts):
        tokens = (text or "").lower().replace("!", " ").split()
        x = [values.get(t, -tox.DRIFT) for t in tokens]
        sums, level = sorted((0.7 * s for s in maximal(x, 0, len(x))), reverse=True), math.log(len(tokens) + tox.AROUND)
        e = (sums[0] if sums else 0.0) - level + sum(max(0.0, s - level) for s in sums[1:])
        assert abs(got[i] - 1 / (1 + math.exp(1.5 - 0.8 * e))) < 1e-9, text
