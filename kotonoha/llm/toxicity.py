"""Operator 9: toxic passages as maximum-scoring segments over token log-odds.

Learning: from labelled rows only. A token is a run of letters (bytes above 127 count as letters),
ASCII capitals lowered. Its features are itself and its beginnings of 4 to 10 bytes, so that
inflected forms share evidence. A feature's log-odds between toxic and clean rows are taken with an
informative Dirichlet prior (half a count and its share in all labelled rows times PRIOR) and count where they exceed
MIN_ODDS and MIN_Z standard errors; the LEXICON features with the most standard errors form the model. A token
scores its best feature, any other token scores -DRIFT.

Scoring: the Ruzzo-Tompa scan finds every maximal scoring segment of a text in linear time. The best
segment's sum M is set against chance by the extreme-value law of such maxima (Karlin-Altschul):
with n tokens, E = lambda * M - ln(n + AROUND), lambda solved from the tokens' frequencies in clean rows,
and further segments add their own excess. A logistic curve fitted to labelled rows
that a trial lexicon has not seen turns E into the score.

Bounds: at most LABELLED labelled rows are learnt from (all of them below that, an even share by
hash above); the lexicon has at most LEXICON entries. Everything else covers all rows.

Defined results: a null or blank text has no tokens, M = 0 and a score like any other; a null label
is no label; of several labels of one id the toxic one holds; without both classes among the labels
every score is their smoothed share. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from kotonoha.llm.common import documents, id_crc, text_rows
from kotonoha.session import written

#: Labelled rows that are learnt from at most, entries of the lexicon at most.
LABELLED, LEXICON = 200_000, 20_000
PRIOR, MIN_Z, MIN_ODDS, MIN_ROWS, DRIFT = 500.0, 3.3, 2.5, 3, 0.05
#: Clean tokens that every text is taken to stand in, when its best segment is set against chance: a few words that score are rare by themselves, not because their text is short.
AROUND = 50
#: One labelled row in so many, by hash, is kept for the curve and counted only for the final lexicon.
ASIDE = 4
#: Lengths in bytes of the beginnings that are features.
BEGINNINGS = range(4, 11)
#: Remembered token scores in a Python worker at most.
REMEMBERED = 200_000
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def tokens(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


def features(token: bytes) -> list[bytes]:
    """The token (marked by a final blank) and its proper beginnings."""
    return [token + b" ", *(token[:k] for k in BEGINNINGS if k <= len(token))]


def segments(scores: list[tuple[int, float]], n: int, drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, sum) of n tokens, of which only the listed (position, score) differ from -drift.

    Ruzzo and Tompa's scan over the listed tokens, with each gap between them as one negative step.
    """
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after
    total, last = 0.0, 0
    for at, score in scores:
        total -= drift * (at - last)
        last = at + 1
        left, right = total, total + score
        total = right
        if score <= 0:
            continue
        start = at
        while True:
            k = len(found) - 1
            while k >= 0 and found[k][2] >= left:
                k -= 1
            if k < 0 or found[k][3] >= right:
                found.append((start, at + 1, left, right))
                break
            start, left = found[k][0], found[k][2]
            del found[k:]
    return [(a, b, r - le) for a, b, le, r in found]


@dataclass
class Model:
    lexicon: dict[bytes, float]
    lam: float = 1.0
    slope: float = 0.0
    offset: float = 0.0

    def evidence(self, found: list[tuple[int, int, float]], n: int) -> float:
        """lambda * M - ln(n + AROUND) of the best segment, and what the others exceed chance by."""
        level = math.log(n + AROUND)
        sums = sorted((self.lam * s for _, _, s in found), reverse=True)
        return (sums[0] if sums else 0.0) - level + sum(max(0.0, s - level) for s in sums[1:])

    def probability(self, e: float) -> float:
        x = self.offset + self.slope * e
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


class Scorer:
    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def score_of(self, token: bytes) -> float:
        return max((s for f in features(token) if (s := self.model.lexicon.get(f))), default=0.0)

    def listed(self, text: bytes) -> tuple[list[tuple[int, float]], int]:
        found, known = tokens(text), self.known
        if len(known) > REMEMBERED:
            known.clear()
        for t in set(found).difference(known):
            known[t] = self.score_of(t)
        return [(i, s) for i, s in enumerate(map(known.__getitem__, found)) if s], len(found)


def _labelled(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, id_label: str, label: str) -> DataFrame:
    marks = labels.select(F.col(id_label).alias("doc_id"), F.col(label).cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = marks.count()
    if n > LABELLED:
        marks = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * LABELLED / n))
    return text_rows(df, id_col, text_col).join(F.broadcast(marks), "doc_id")  # LABELLED rows of 12 bytes at most


def _counts(rows: DataFrame) -> DataFrame:
    """(feature, aside, toxic, clean): in how many tokens, each once a row, of toxic and of clean rows; aside: of the rows kept for the curve."""

    def run(batches):
        for b in (whole.slice(at, 2000) for whole in batches for at in range(0, whole.num_rows, 2000)):
            seen: dict[tuple[bool, bool], Counter] = {}
            for text, toxic, aside in zip(*(c.to_pylist() for c in b.columns)):
                seen.setdefault((aside, toxic > 0), Counter()).update(set(tokens(text.encode())))
            for aside in (False, True):
                out = Counter(), Counter()
                for k, to in enumerate(out):
                    for token, n in seen.get((aside, bool(k)), {}).items():
                        for f in features(token):
                            to[f] += n
                names = list(out[0].keys() | out[1].keys())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.binary()), pa.array([aside] * len(names), pa.bool_()), *(pa.array([to[f] for f in names], pa.int64()) for to in out[::-1])], names=["feature", "aside", "toxic", "clean"]
                )

    found = rows.select("text", "toxic", "aside").mapInArrow(run, "feature binary, aside boolean, toxic bigint, clean bigint")
    return found.groupBy("feature", "aside").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _lexicon(counts: DataFrame, n_toxic: float, n_clean: float) -> tuple[dict[bytes, float], float]:
    """The features that count with their log-odds; lambda of their scores in clean text."""
    y, c, nt, nc = F.col("toxic"), F.col("clean"), F.lit(n_toxic), F.lit(n_clean)
    weight = min(PRIOR, 0.1 * min(n_toxic, n_clean))
    prior = 0.5 + (y + c) / (n_toxic + n_clean) * weight
    odds = F.log((y + prior) / (nt + weight - y)) - F.log((c + prior) / (nc + weight - c))
    scored = counts.filter(y >= MIN_ROWS).select("feature", "clean", odds.alias("odds"), (odds / F.sqrt(1 / (y + prior) + 1 / (c + prior))).alias("z"))
    top = scored.filter((F.col("z") >= MIN_Z) & (F.col("odds") >= MIN_ODDS)).orderBy(F.desc("z"), "feature").limit(LEXICON).collect()
    kept = {bytes(r.feature): r.odds for r in top}
    share = np.array([(r.clean + 0.5) / n_clean for r in top] or [0.0])
    score = np.array([r.odds for r in top] or [0.0])
    low, high = 1e-3, 1.0  # the root of sum p e^(lambda s) = 1, at most 1 as the scores are log-odds
    for _ in range(60):
        mid = (low + high) / 2
        if (share * np.expm1(mid * score)).sum() + math.expm1(-mid * DRIFT) < 0:
            low = mid
        else:
            high = mid
    return kept, max(low, 0.05)


def _logistic(points: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Offset and slope by Newton steps over (evidence, toxic rows, clean rows), the slope held by a weak prior."""
    e, y, c = (np.array(v, float) for v in zip(*points))
    scale = max(1.0, float(np.abs(e).max()))
    x = np.stack([np.ones_like(e), e / scale], axis=1)
    beta = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (y - (y + c) * p) - np.array([1e-6, 1e-3]) * beta
        hess = (x * ((y + c) * p * (1 - p))[:, None]).T @ x + np.diag([1e-6, 1e-3])
        step = np.linalg.solve(hess, grad)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1] / scale)


def passages(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, segments, evidence, score): segments are (start, end, sum) in tokens, end exclusive."""
    rows = text_rows(df, id_col, text_col)
    shared = df.sparkSession.sparkContext.broadcast(model)  # LEXICON entries at most
    segment = StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("sum", DoubleType())])
    row = [StructField("n_tokens", LongType()), StructField("segments", ArrayType(segment)), StructField("evidence", DoubleType()), StructField("score", DoubleType())]
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("sum", pa.float64())]))

    def run(batches):
        model = shared.value
        scorer = Scorer(model)
        for b in batches:
            ns, segs, es, ps = [], [], [], []
            for text in b.column(1).to_pylist():
                listed, n = scorer.listed(text.encode())
                found = segments(listed, n)
                e = model.evidence(found, n)
                ns.append(n)
                segs.append([{"start": s, "end": t, "sum": v} for s, t, v in found])
                es.append(e)
                ps.append(model.probability(e))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ns, pa.int64()), pa.array(segs, arrow), pa.array(es, pa.float64()), pa.array(ps, pa.float64())], names=["doc_id", "n_tokens", "segments", "evidence", "score"])

    return rows.mapInArrow(run, StructType([rows.schema["doc_id"], *row]))


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", id_label: str = "doc_id", label: str = "toxic") -> Model:
    """A model from the rows of df whose ids labels has."""
    rows = _labelled(df, labels, id_col, text_col, id_label, label).withColumn("aside", F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(ASIDE)) == 0)
    counts = written(_counts(rows), "toxicity-counts")
    whole = F.substring("feature", -1, 1) == b" "
    n = {r.aside: (r.toxic, r.clean) for r in counts.filter(whole).groupBy("aside").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).collect()}
    toxic, clean = (float(sum(v[k] for v in n.values())) for k in (0, 1))
    if not toxic or not clean:
        n = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
        share = ((n.toxic or 0) + 0.5) / (n.n + 1)
        return Model({}, offset=math.log(share / (1 - share)))
    final = Model(*_lexicon(counts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), toxic, clean))
    if all(min(n.get(k, (0, 0))) for k in (False, True)):
        trial, rows = Model(*_lexicon(counts.filter("not aside"), *map(float, n[False]))), rows.filter("aside")
    else:  # too few labels to keep any aside
        trial = final
    bin_ = F.round(F.least(F.col("evidence"), F.lit(200.0)) * 4) / 4
    marked = rows.select(F.struct("doc_id", "toxic").alias("doc_id"), "text")
    seen = passages(marked, trial).groupBy(bin_.alias("e")).agg(F.sum("doc_id.toxic").alias("y"), F.count("*").alias("n")).collect()
    final.offset, final.slope = _logistic([(r.e, r.y, r.n - r.y) for r in seen])
    return final


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = documents(spark, sf_dir)
    model = fit(docs, labels.filter(id_crc() % 5 != 0))
    return passages(docs, model).select("doc_id", (id_crc() % 5 == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
