"""Operator 11: quality by a regularised quadratic discriminant over document statistics.

Statistics: lengths, shares of kinds of bytes, variety of words and lines, entropy (see NAMES), each taken
by a logarithm or a log-odds with half a count on either side, so that every one is finite for every text. They are
computed once for each document and written; labels meet the statistics, not the texts.

Fit: counts, sums and products of the statistics by class and part, added up by Spark over all
labelled rows. A class's covariance is shrunk twice: towards the pooled one by lambda, then towards a multiple of the
identity by gamma, in units of the pooled deviations. Of a small grid the pair is taken whose score has the
least log-loss on the labelled rows set aside; the same rows give the logistic curve that turns the
difference of the Mahalanobis log-densities into the score. The final classes are fitted on all labelled rows. The factors
are computed once: Cholesky factors, their inverses and log-determinants go out with the model.

Defined results: a null text is an empty one; an empty text has statistics like any other; a null label is no label, of several labels of
one id the higher one holds; rows that repeat an id are each scored and each learnt from; without both classes among the labels
every score is their smoothed share. Other columns are not read. Work and memory grow with the texts, whole texts are read, the
model has a fixed size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kotonoha.llm.common import documents, id_crc, text_rows
from kotonoha.session import written

#: Kinds of bytes whose shares are statistics; bytes above 127 count as letters.
KINDS = {"lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789", "stop": ".,;:", "shout": "!?", "quote": "\"'()-", "symbol": "#$%&*+/<=>@[\\]^_`{|}~", "line": "\n"}
NAMES = (*(f"share of {k} bytes" for k in KINDS), "bytes", "words", "mean word", "distinct words", "distinct pairs", "most frequent word", "words that end in no letter", "words in capitals", "distinct lines", "mean line", "byte entropy", "words a sentence")
LAMBDAS, GAMMAS = (0.0, 0.2, 0.5, 1.0), (0.01, 0.05, 0.2)
#: One labelled row in so many, by hash, is set aside for the grid and the curve.
ASIDE = 4
#: Log-density differences are counted in bins of this width up to this bound.
BIN, MOST = 0.25, 150.0
_GROUPS = np.zeros((256, len(KINDS)))
for _k, _chars in enumerate(KINDS.values()):
    _GROUPS[list(_chars.encode()), _k] = 1
_GROUPS[128:, 0] = 1
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _odds(count, total):
    """Log-odds of a share."""
    return np.log((count + 0.5) / (np.maximum(total - count, 0) + 0.5))


def statistics(text: bytes) -> np.ndarray:
    """The transformed statistics of one UTF-8 text, in the order of NAMES."""
    n = len(text)
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    w = len(words)
    share = seen[seen > 0] / max(n, 1)
    ends = sum(map(bool, (~_LETTER[np.frombuffer(bytes(x[-1] for x in words), np.uint8)]).tolist())) if w else 0
    counts: dict[bytes, int] = {}
    for x in words:
        counts[x] = counts.get(x, 0) + 1
    pairs = len(set(zip(words, words[1:])))
    stops = int(seen[list(b".!?")].sum())
    return np.concatenate([
        _odds(seen @ _GROUPS, n),
        [math.log1p(n), math.log1p(w), math.log((n + 1) / (w + 1)), _odds(len(counts), w), _odds(pairs, max(w - 1, 0)), _odds(max(counts.values(), default=0), w), _odds(ends, w), _odds(sum(map(bytes.isupper, words)), w),
         _odds(len(set(lines)), len(lines)), math.log((n + 1) / (len(lines) + 1)), float(-(share * np.log2(share)).sum()), math.log((w + 1) / (stops + 1))],
    ])


def document_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): the statistics of every row."""
    rows = text_rows(df, id_col, text_col)

    def run(batches):
        for b in batches:
            x = np.array([statistics(t.encode()) for t in b.column(1).to_pylist()], np.float32).reshape(b.num_rows, len(NAMES))
            flat = pa.array(x.ravel(), pa.float32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * len(NAMES)), flat)], names=["doc_id", "x"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, x array<float>")


def _matrix(column) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), len(NAMES))


@dataclass
class Gauss:
    """A class as its mean and the inverse Cholesky factor of its covariance."""

    mean: np.ndarray
    whiten: np.ndarray
    level: float  # log prior minus half the log-determinant

    @staticmethod
    def of(mean: np.ndarray, covariance: np.ndarray, prior: float) -> Gauss:
        factor = np.linalg.cholesky(covariance)
        return Gauss(mean, np.linalg.inv(factor), math.log(prior) - float(np.log(np.diag(factor)).sum()))

    def density(self, x: np.ndarray) -> np.ndarray:
        """The log density with the prior, without the constant that all classes share."""
        return self.level - 0.5 * np.square((x - self.mean) @ self.whiten.T).sum(axis=1)


@dataclass
class Model:
    good: Gauss | None = None
    bad: Gauss | None = None
    offset: float = 0.0
    slope: float = 0.0

    def evidence(self, x: np.ndarray) -> np.ndarray:
        return np.zeros(len(x)) if self.good is None else np.clip(self.good.density(x) - self.bad.density(x), -MOST, MOST)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.offset + self.slope * self.evidence(x))))


def moments(labelled: DataFrame) -> dict[tuple[bool, bool], tuple[float, np.ndarray, np.ndarray]]:
    """(aside, label) -> rows, sums and products of the statistics; each task hands on one sum of each."""
    d = len(NAMES)

    def run(batches):
        total: dict[tuple[bool, bool], np.ndarray] = {}
        for b in batches:
            x = _matrix(b.column(2))
            x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
            aside, label = (np.asarray(b.column(k).to_numpy(zero_copy_only=False), bool) for k in (0, 1))
            for key in {*zip(aside.tolist(), label.tolist())}:
                own = x[(aside == key[0]) & (label == key[1])]
                total[key] = total.get(key, 0) + own.T @ own
        for (aside, label), m in total.items():
            k = (d + 1) * (d + 1)
            yield pa.RecordBatch.from_arrays([pa.array([aside] * k), pa.array([label] * k), pa.array(range(k), pa.int32()), pa.array(m.ravel())], names=["aside", "label", "at", "value"])

    sums = labelled.select("aside", "label", "x").mapInArrow(run, "aside boolean, label boolean, at int, value double").groupBy("aside", "label", "at").agg(F.sum("value").alias("value")).collect()
    found: dict[tuple[bool, bool], np.ndarray] = {}
    for r in sums:
        found.setdefault((r.aside, r.label), np.zeros((d + 1) * (d + 1)))[r.at] = r.value
    square = {k: v.reshape(d + 1, d + 1) for k, v in found.items()}
    return {k: (m[0, 0], m[0, 1:], m[1:, 1:]) for k, m in square.items()}


def discriminant(bad: tuple, good: tuple, lam: float, gamma: float) -> Model:
    """Both classes with covariances shrunk towards the pooled one (lam) and towards the identity (gamma)."""
    n = bad[0] + good[0]
    means = [s / k for k, s, _ in (bad, good)]
    own = [p / k - np.outer(m, m) for (k, _, p), m in zip((bad, good), means)]
    pooled = (own[0] * bad[0] + own[1] * good[0]) / n
    unit = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    found = []
    for c, m, (k, _, _) in zip(own, means, (bad, good)):
        c = ((1 - lam) * c + lam * pooled) / np.outer(unit, unit)
        c = (1 - gamma) * c + gamma * max(np.trace(c) / len(c), 1e-3) * np.eye(len(c))
        found.append(Gauss.of(m, c * np.outer(unit, unit), k / n))
    return Model(found[1], found[0])


def _logistic(e: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float, float]:
    """Offset, slope and log-loss of the curve through y of n rows at evidence e, by Newton steps with a weak prior."""
    x = np.stack([np.ones_like(e), e], axis=1)
    beta, prior = np.array([0.0, 0.1]), np.array([1e-4, 1e-2])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(prior), x.T @ (y - n * p) - prior * beta)
        beta += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-10:
            break
    beta[1] = max(beta[1], 1e-4)  # more evidence never lowers the score
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ beta, -30, 30))), 1e-9, 1 - 1e-9)
    return float(beta[0]), float(beta[1]), float(-(y * np.log(p) + (n - y) * np.log(1 - p)).sum())


def fit(stats: DataFrame, labels: DataFrame, id_label: str = "doc_id", label: str = "quality") -> Model:
    """A model from the rows of stats whose ids labels has."""
    marks = labels.select(F.col(id_label).alias("doc_id"), (F.col(label).cast("int") > 0).alias("label")).filter("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    rows = stats.join(marks, "doc_id").select((F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(ASIDE)) == 0).alias("aside"), "label", "x")
    rows = written(rows, "quality-labelled")
    part = moments(rows)
    both = {k: [sum(v) for v in zip(*(m for (_, y), m in part.items() if y == k))] for k in (False, True)}
    if not all(both.values()):
        n = {k: v[0] if v else 0.0 for k, v in both.items()}
        share = (n[True] + 0.5) / (n[True] + n[False] + 1)
        return Model(offset=math.log(share / (1 - share)))
    whole = all((aside, y) in part for aside in (False, True) for y in (False, True))
    first = (part[False, False], part[False, True]) if whole else (both[False], both[True])
    grid = [(lam, gamma) for lam in LAMBDAS for gamma in GAMMAS]
    shared = stats.sparkSession.sparkContext.broadcast([discriminant(*first, *g) for g in grid])  # a dozen small matrices

    def run(batches):
        for b in batches:
            x = _matrix(b.column(1))
            for k, m in enumerate(shared.value):
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(x), pa.int32()), pa.array(np.round(m.evidence(x) / BIN) * BIN), b.column(0)], names=["k", "e", "label"])

    aside = (rows.filter("aside") if whole else rows).select("label", "x")
    seen = aside.mapInArrow(run, "k int, e double, label boolean").groupBy("k", "e").agg(F.count_if("label").alias("y"), F.count("*").alias("n")).collect()
    curves = []
    for k in range(len(grid)):
        e, y, n = (np.array(v, float) for v in zip(*((r.e, r.y, r.n) for r in seen if r.k == k)))
        curves.append(_logistic(e, y, n))
    best = min(range(len(grid)), key=lambda k: curves[k][2])
    final = discriminant(both[False], both[True], *grid[best])
    final.offset, final.slope, _ = curves[best]
    return final


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """(doc_id, evidence, score) of every row of statistics."""
    shared = stats.sparkSession.sparkContext.broadcast(model)  # two classes of fixed size

    def run(batches):
        for b in batches:
            x = _matrix(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.evidence(x)), pa.array(shared.value.score(x))], names=["doc_id", "evidence", "score"])

    return stats.mapInArrow(run, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, evidence double, score double")


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    stats = written(document_statistics(documents(spark, sf_dir)), "quality-statistics")
    out = scored(stats, fit(stats, labels.filter(id_crc() % 5 != 0)))
    return out.select("doc_id", (id_crc() % 5 == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
