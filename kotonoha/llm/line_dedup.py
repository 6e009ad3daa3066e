"""Operator 4: repeated runs of lines by a suffix array over line ids.

Each text is a sequence of line ids (128-bit hashes of its lines that hold a word). Prefix doubling
ranks all suffixes by their first 1, 2, 4, ... lines: a suffix's next rank is its place in the order
of pairs (its rank, the rank as many lines further on). Suffixes that share their first L lines are
an interval of the suffix array whose longest common prefix is L or more; they have equal ranks at
the largest power of two within L, both at their start and at their last such window. Ranks of
single suffixes are dropped as soon as they occur: nothing that starts there is repeated.

A line goes if it lies in a run of at least MIN_WORDS words that also stands earlier in the corpus
(order: id, then text hash, then line; null ids last). It is enough to look at runs that just reach
MIN_WORDS: the shortest one from each line on and the shortest one up to each line. Together they
cover exactly the lines of all maximal repeated runs of that many words, and as a line that counts
has a word, they are at most MIN_WORDS lines long, which bounds the number of doublings.

Scale: only line hashes are shuffled; rows that repeat both id and text are made one by an aggregate
that combines before its shuffle; hot lines are aggregated before they are ranked (the ranks are
sums over distinct pairs, sorted in ranges), and come back by joins that adaptive execution splits.

Defined results: a null text stays null and an empty one empty; blank lines belong to the line
before them and go with it; overlapping repeats inside one text leave its first period; rows that
repeat both id and text share one decision, so that the first of them stays with its copies; a null
id is an id like any other; other columns are kept as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from kotonoha.llm.common import documents
from kotonoha.session import written

MIN_WORDS = 50
_KEY = ("d", "th")


def _lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d, th, ord, w, h1, h2) of each line with a word: its place among them, its words and its id."""
    import xxhash

    rows = df.select(F.col(id_col).alias("d"), F.xxhash64(text_col).alias("th"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["d"].dataType.simpleString()
    digest = xxhash.xxh3_128_digest

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                row, ords, ws, hs = [], [], [], []
                for r, text in enumerate(b.column(2).to_pylist()):
                    k = 0
                    for line in text.encode().split(b"\n"):
                        if w := len(line.split()):
                            row.append(r)
                            ords.append(k)
                            ws.append(w)
                            hs.append(digest(line))
                            k += 1
                h = np.frombuffer(b"".join(hs), ">i8").astype(np.int64).reshape(-1, 2)
                index = pa.array(row, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(index), b.column(1).take(index), pa.array(ords, pa.int32()), pa.array(ws, pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1])], names=["d", "th", "ord", "w", "h1", "h2"]
                )

    return rows.mapInArrow(run, f"d {kind}, th bigint, ord int, w int, h1 bigint, h2 bigint")


def ranked(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) with rank: how many suffixes have a smaller pair; n are a pair's suffixes.

    The distinct pairs are sorted in ranges; the driver sees one sum for each range."""
    spark = pairs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = written(pairs.repartitionByRange(parts, a, b).withColumn("part", F.spark_partition_id()), "ranks")
    sums = laid.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    offsets = spark.createDataFrame([(r.part, int(o)) for r, o in zip(sums, np.cumsum([0] + [r.n for r in sums]))], "part int, before bigint")
    within = F.sum("n").over(Window.partitionBy("part").orderBy(a, b).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return laid.withColumn("within", within).join(F.broadcast(offsets), "part").select(a, b, "n", (F.col("before") + F.col("within") + 1).alias("rank"))


def _windows(rows: DataFrame, min_words: int) -> DataFrame:
    """Adds end (of the island of repeated lines), and the lengths of the shortest runs from (f) and up to (b) each line, null where the island is too short."""
    packed = rows.groupBy(*_KEY).agg(F.sort_array(F.collect_list(F.struct("ord", "w", "rank"))).alias("x"))  # the lines of one text
    kind = rows.schema["d"].dataType.simpleString()

    def run(batches):
        for b in batches:
            row, out = [], []
            for r, x in enumerate(b.column(2)):
                x = x.values
                ord_, w, rank = (x.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                cut = np.flatnonzero(np.diff(ord_) != 1) + 1
                for s, e in zip(np.r_[0, cut], np.r_[cut, len(ord_)]):
                    total = np.r_[0, np.cumsum(w[s:e], dtype=np.int64)]
                    n, i = e - s, np.arange(e - s)
                    to = np.searchsorted(total, total[:-1] + min_words)  # total[to] reaches it: lines i..to-1
                    fro = np.searchsorted(total, total[1:] - min_words, "right") - 1
                    f = np.where(to <= n, to - i, 0)
                    back = np.where(total[1:] >= min_words, i + 1 - fro, 0)
                    row.append(np.full(n, r))
                    out.append(np.stack([ord_[s:e], np.full(n, ord_[e - 1] + 1), rank[s:e], f, back]))
            if not row:
                continue
            index, (o, end, rank, f, back) = pa.array(np.concatenate(row)), np.concatenate(out, axis=1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(index), b.column(1).take(index), pa.array(o.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(rank), pa.array(f.astype(np.int32)), pa.array(back.astype(np.int32))],
                names=["d", "th", "ord", "end", "r0", "f", "b"],
            )

    return packed.mapInArrow(run, f"d {kind}, th bigint, ord int, end int, r0 bigint, f int, b int")


def suffix_ranks(rows: DataFrame, levels: int) -> DataFrame:
    """Adds r1..r{levels}: the suffix's rank by its first 2**k lines, null where it is the only one or the island ends before."""
    by_text = Window.partitionBy(*_KEY).orderBy("ord")
    for k in range(levels):
        step, here, new = 1 << k, F.col(f"r{k}"), f"r{k + 1}"
        # rows of one island stand one after the other, so the row 2**k further on is that line if the island reaches it
        later = F.lead(f"r{k}", step).over(by_text)
        rows = rows.withColumn("next", F.when(here.isNotNull() & (F.col("ord") + 2 * step <= F.col("end")), later)).withColumn("own", F.when(F.col("next").isNotNull(), here))
        rows = written(rows, "suffixes")
        pairs = rows.filter("next is not null").groupBy("own", "next").agg(F.count("*").alias("n")).filter("n > 1")
        names = ranked(pairs, "own", "next").select("own", "next", F.col("rank").alias(new))
        rows = rows.join(names, ["own", "next"], "left").drop("own", "next")
    return rows


def repeated_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(d, th, start, length): runs of lines with a word, of at least min_words, that also stand earlier."""
    # copies of a row would stand for its later occurrences, so each text of an id counts once
    lines = written(_lines(df, id_col, text_col).dropDuplicates([*_KEY, "ord"]), "lines")
    symbols = ranked(lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1"), "h1", "h2").select("h1", "h2", "rank")
    rows = written(_windows(lines.join(symbols, ["h1", "h2"]).select(*_KEY, "ord", "w", "rank"), min_words), "islands")
    longest = rows.agg(F.greatest(F.max("f"), F.max("b"))).first()[0] or 1
    rows = suffix_ranks(rows, int(longest).bit_length() - 1)
    level = lambda n: F.floor(F.log2(n.cast("double")) + 1e-9).cast("int")
    ranks = F.array(*(F.col(c) for c in rows.columns if c[0] == "r" and c[1:].isdigit()))
    rows = written(rows.select(*_KEY, "ord", "f", "b", ranks.alias("ranks")), "ranked")
    starts = rows.select(*_KEY, F.explode(F.array_distinct(F.array(F.struct(F.col("ord").alias("start"), F.col("f").alias("n")), F.struct((F.col("ord") - F.col("b") + 1).alias("start"), F.col("b").alias("n"))))).alias("x"))
    starts = starts.filter("x.n > 0").select(*_KEY, "x.start", "x.n").distinct()
    at = rows.select(*_KEY, F.col("ord").alias("at"), "ranks")
    s, p = starts.alias("s"), at.alias("p")
    first = s.join(p, (F.col("s.th") == F.col("p.th")) & F.col("s.d").eqNullSafe(F.col("p.d")) & (F.col("s.start") == F.col("p.at"))).select("s.d", "s.th", "start", "n", F.get("ranks", level(F.col("n"))).alias("left"))
    first = first.filter("left is not null").withColumn("last", F.expr("start + n - shiftleft(1, cast(floor(log2(n) + 1e-9) as int))"))
    f = first.alias("f")
    runs = f.join(p, (F.col("f.th") == F.col("p.th")) & F.col("f.d").eqNullSafe(F.col("p.d")) & (F.col("f.last") == F.col("p.at"))).select("f.d", "f.th", "start", "n", "left", F.get("ranks", level(F.col("n"))).alias("right"))
    runs = written(runs.filter("right is not null"), "runs")
    place = F.struct(F.col("d").isNull().alias("none"), "d", "th", "start")
    earliest = runs.groupBy("n", "left", "right").agg(F.min(place).alias("first"), F.count("*").alias("many")).filter("many > 1")
    # a run that stands in a thousandth of the places or more is one of a thousand at most, and is not dealt by its key
    earliest = written(earliest, "earliest")
    many = max(1000, runs.count() // 1000)
    keys, later = ["n", "left", "right"], place != F.col("first")
    runs = runs.join(F.broadcast(earliest.filter(F.col("many") > many).select(*keys, F.col("first").alias("hot"))), keys, "left")
    hot = runs.filter("hot is not null").withColumn("first", F.col("hot")).filter(later).select("d", "th", "start", "n")
    rest = runs.filter("hot is null").join(earliest.filter(F.col("many") <= many), keys).filter(later).select("d", "th", "start", "n")
    return hot.unionByName(rest).withColumnRenamed("n", "length")


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """df with its text cleaned, and the columns n_lines (those with a word), n_deleted and deleted (their numbers, counted from zero, as ranges)."""
    runs = repeated_runs(df, id_col, text_col, min_words).groupBy("d", "th").agg(F.collect_list(F.struct("start", "length")).alias("__runs"))
    left = df.withColumn("__th", F.xxhash64(text_col)).alias("x")
    joined = left.join(runs.alias("y"), (F.col("__th") == F.col("y.th")) & F.col(f"x.{id_col}").eqNullSafe(F.col("y.d")), "left").select("x.*", "__runs").drop("__th")
    names = df.columns
    schema = StructType([*df.schema.fields, StructField("n_lines", IntegerType()), StructField("n_deleted", IntegerType()), StructField("deleted", StringType())])
    at = names.index(text_col)

    def clean(text: str, runs: list) -> tuple[str, int, int, str]:
        lines = text.split("\n")
        has_word = [bool(line.encode().split()) for line in lines]
        gone = np.zeros(sum(has_word) + 1, np.int64)
        for r in runs:
            gone[r["start"]] += 1
            gone[r["start"] + r["length"]] -= 1
        gone = np.cumsum(gone) > 0
        out, k = [], -1
        for line, word in zip(lines, has_word):
            k += word
            if k < 0 or not gone[k]:
                out.append(line)
        edge = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0])).reshape(-1, 2)
        return "\n".join(out), len(gone) - 1, int(gone.sum()), ",".join(f"{a}-{b}" for a, b in edge.tolist())

    def run(batches):
        for b in batches:
            texts, n, gone, spans = [], [], [], []
            for text, runs in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist()):
                if not runs:
                    texts.append(text)
                    n.append(sum(1 for line in (text or "").encode().split(b"\n") if line.strip(b" \t\n\v\f\r")))
                    gone.append(0)
                    spans.append("")
                else:
                    for to, v in zip((texts, n, gone, spans), clean(text, runs)):
                        to.append(v)
            columns = [pa.array(texts, b.column(at).type) if i == at else b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int32()), pa.array(gone, pa.int32()), pa.array(spans, pa.string())], names=[*names, "n_lines", "n_deleted", "deleted"])

    return joined.mapInArrow(run, schema)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_lines", "n_deleted", "deleted", "text")
