"""The discriminant against numpy's own formulas, held-out accuracy, and rows of every odd kind."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kotonoha.llm import quality
from kotonoha.llm.quality import NAMES, op11_quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = op11_quality(spark, "/root/testdata/sf0.1").join(labels, "doc_id").filter("held_out").select("quality", "predicted", "score").collect()
    good = [r for r in rows if r.quality]
    bad = [r for r in rows if not r.quality]
    assert sum(r.predicted for r in good) / len(good) > 0.98
    assert sum(1 - r.predicted for r in bad) / len(bad) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_statistics_are_finite_and_whole():
    for text in (b"", b" ", b"\n\n", "é".encode(), b"A" * 300_000, b"a b " * 50_000, b"||||"):
        x = quality.statistics(text)
        assert x.shape == (len(NAMES),) and np.isfinite(x).all()
    n = NAMES.index("share of symbol bytes")
    assert quality.statistics(b"plain words " * 1000 + b"#" * 40_000)[n] > quality.statistics(b"plain words " * 1000)[n] + 5  # the end counts
    w = NAMES.index("words")
    assert quality.statistics(b"one two\nthree")[w] == pytest.approx(math.log(4))
    assert quality.statistics(b"aa bb aa bb")[NAMES.index("distinct pairs")] == pytest.approx(math.log(2.5 / 1.5))


def test_discriminant_against_plain_formulas():
    rng = np.random.default_rng(5)
    d = len(NAMES)
    bad, good = rng.normal(1, 2, (300, d)) @ rng.normal(0, 1, (d, d)), rng.normal(0, 1, (500, d))
    packed = [(float(len(x)), x.sum(axis=0), x.T @ x) for x in (bad, good)]
    model = quality.discriminant(*packed, 0.3, 0.1)
    covs = [np.cov(x.T, bias=True) for x in (bad, good)]
    pooled = (covs[0] * 300 + covs[1] * 500) / 800
    s = np.diag(np.sqrt(np.diag(pooled)))
    odds = []
    for x, c, n in ((bad, covs[0], 300), (good, covs[1], 500)):
        r = np.linalg.inv(s) @ (0.7 * c + 0.3 * pooled) @ np.linalg.inv(s)
        c = s @ (0.9 * r + 0.1 * np.trace(r) / d * np.eye(d)) @ s
        z = good[:20] - x.mean(axis=0)
        odds.append(math.log(n / 800) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * (z * np.linalg.solve(c, z.T).T).sum(axis=1))
    assert np.allclose(model.evidence(good[:20]), np.clip(odds[1] - odds[0], -quality.MOST, quality.MOST), atol=1e-6)


def test_moments_are_those_of_all_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(7)
    stats = quality.document_statistics(docs)
    rows = stats.withColumn("aside", F.col("doc_id") % 3 == 0).withColumn("label", F.col("doc_id") % 2 == 0)
    found = quality.moments(rows)
    x = {r.doc_id: np.array(r.x) for r in stats.collect()}
    own = np.array([v for k, v in x.items() if k % 3 == 0 and k % 2])
    n, total, products = found[True, False]
    assert n == len(own) and np.allclose(total, own.sum(axis=0)) and np.allclose(products, own.T @ own)


def test_odd_rows(spark):
    schema = "doc_id bigint, text string, score double, x string, label int"
    docs = spark.createDataFrame([(1, "good words here.", 1.0, "", 0), (1, "good words here.", 1.0, "", 0), (None, "x", None, None, None), (2, None, 0.0, "", 1), (3, "", 0.0, "", 1), (4, "### | $$$ " * 30_000, 0.0, "", 1)], schema)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (3, 0), (None, 1)], "doc_id bigint, quality int")
    stats = quality.document_statistics(docs)
    rows = quality.scored(stats, quality.fit(stats, labels)).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["1", "1", "2", "3", "4", "None"]
    assert all(0 <= r.score <= 1 for r in rows)
    empty = {r.score for r in rows if r.doc_id in (2, 3)}
    assert len(empty) == 1  # null is empty
    for only in (labels.filter("quality = 1"), labels.limit(0)):
        assert len({r.score for r in quality.scored(stats, quality.fit(stats, only)).collect()}) == 1
    assert quality.scored(stats.limit(0), quality.Model()).count() == 0
