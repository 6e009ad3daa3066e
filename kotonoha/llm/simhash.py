"""Operator 10: near-duplicates by SimHash, compared exactly in tiles.

Fingerprint: words ``[^\\x20\\x09-\\x0D]+`` with ASCII capitals lowered, shingles of three words
joined by a space and counted as often as they occur, XXH64 with seed 42 of each; a bit is set
where more than half of the hashes have it.

Links: two fingerprints that differ in at most two of 64 bits agree in at least one of three bit
fields, so distinct fingerprints are laid out by (field, value) and compared only within such a
bucket: sorted by population count, exclusive-or and bit counts by numpy, and what lies further
apart in population count than the radius is skipped. A bucket of more than TILE fingerprints is
cut into tiles of one population count each; only pairs of tiles within the radius are made, each
pair a unit of work of its own. Each unit hands on a spanning forest of its links, never the pairs.

Defined results: a null or blank text has no words and fingerprint zero, linked like any other; a
text of one or two words is one shingle; a null id keeps its row and never names a component
unless all its members are null. Repeated rows share their fingerprint. Other columns are not read.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kotonoha.llm.common import documents, text_rows, words
from kotonoha.llm.components import components
from kotonoha.session import written

#: Fingerprints of a bucket or tile that are compared as one unit.
TILE = 2048
#: Lowest bit and width of the three fields.
FIELDS = ((0, 22), (22, 21), (43, 21))
RADIUS = 2
_WIDE = 16


def shingles(found: list[bytes], size: int = 3) -> list[bytes]:
    if len(found) <= size:
        return [b" ".join(found)] if found else []
    joined = b" ".join(found)
    ends = list(accumulate(len(w) + 1 for w in found))
    starts = [0, *ends[: len(found) - size]]
    return [joined[s : e - 1] for s, e in zip(starts, ends[size - 1 :])]


def fingerprint(text: bytes) -> int:
    """The 64 bits as an unsigned integer."""
    import xxhash

    parts = shingles(words(text))
    if not parts:
        return 0
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(p, 42) for p in parts]), np.uint8).reshape(-1, 8)
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        total += np.unpackbits(hashes[at : at + 4096], axis=1).sum(axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(total * 2 > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of each row as a signed 64-bit integer."""
    rows = text_rows(df, id_col, text_col)
    schema = rows.select("doc_id", F.lit(0).cast("bigint").alias("fp")).schema

    def run(batches):
        for b in batches:
            found = np.fromiter((fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return rows.mapInArrow(run, schema)


def forest(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) that connect what the links i-j connect."""
    nodes, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    a, b = at[: len(i)], at[len(i) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def close_pairs(unit: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within the radius and within a unit; unit is sorted."""
    order = np.lexsort((np.bitwise_count(fp), unit))
    unit, x = unit[order], fp[order]
    pop = np.bitwise_count(x).astype(np.int16)
    heads = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
    sizes = np.diff(np.r_[heads, len(unit)])
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    small = np.flatnonzero(np.repeat(sizes <= _WIDE, sizes))
    for s in range(1, _WIDE):
        a = small[:-s] if s < len(small) else small[:0]
        b = small[s:]
        ok = unit[a] == unit[b]
        if not ok.any():
            break
        a, b = a[ok], b[ok]
        hit = np.bitwise_count(x[a] ^ x[b]) <= radius
        left.append(a[hit])
        right.append(b[hit])
    for head, size in zip(heads[sizes > _WIDE], sizes[sizes > _WIDE]):
        own, own_pop = x[head : head + size], pop[head : head + size]
        for at in range(0, size, 256):
            tile = own[at : at + 256]
            end = int(np.searchsorted(own_pop, own_pop[at : at + 256][-1] + radius, "right"))
            a, b = np.nonzero(np.bitwise_count(tile[:, None] ^ own[None, at:end]) <= radius)
            keep = b > a
            left.append(a[keep] + head + at)
            right.append(b[keep] + head + at)
    return order[np.concatenate(left)], order[np.concatenate(right)]


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): edges between distinct fingerprints (column fp) that connect what lies within the radius."""
    fields = [F.struct(F.lit(k).alias("field"), F.expr(f"shiftrightunsigned(fp, {low}) & {(1 << width) - 1}L").alias("value")) for k, (low, width) in enumerate(FIELDS)]
    rows = distinct.select("fp", F.expr("cast(bit_count(fp) as int)").alias("pop"), F.explode(F.array(*fields)).alias("k")).select("fp", "pop", (F.col("k.value") * 3 + F.col("k.field")).alias("bucket"))
    per_pop = rows.groupBy("bucket", "pop").agg(F.count("*").alias("n"))
    large = (
        per_pop.groupBy("bucket")
        .agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("pop", F.ceil(F.col("n") / TILE).cast("int").alias("tiles")))).alias("tiles"))
        .filter(F.col("n") > TILE)
        .select("bucket", "tiles")
    )
    own = F.col("pop") * 1_000_000 + F.pmod(F.xxhash64("fp"), F.element_at("tiles", F.col("pop"))).cast("int")
    others = F.flatten(
        F.transform(
            F.filter(F.map_keys("tiles"), lambda q: F.abs(q - F.col("pop")) <= radius),
            lambda q: F.transform(F.sequence(F.lit(0), F.element_at("tiles", q) - 1), lambda t: q * 1_000_000 + t),
        )
    )
    laid = rows.join(large, "bucket", "left").withColumn("own", F.when(F.col("tiles").isNull(), 0).otherwise(own))
    laid = laid.withColumn("other", F.explode(F.when(F.col("tiles").isNull(), F.array(F.lit(0))).otherwise(others)))
    laid = laid.select("bucket", F.least("own", "other").alias("t"), F.greatest("own", "other").alias("u"), "fp")
    laid = laid.repartition("bucket", "t", "u").sortWithinPartitions("bucket", "t", "u")

    def flush(k, fp):
        unit = np.cumsum(np.r_[0, (k[1:] != k[:-1]).any(axis=1)])
        i, j = close_pairs(unit, fp, radius)
        a, b = forest(fp[i].view(np.int64), fp[j].view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches):
        keys, fps = np.empty((0, 3), np.int64), np.empty(0, np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3)], axis=1)
            keys, fps = np.concatenate([keys, new]), np.concatenate([fps, batch.column(3).to_numpy().view(np.uint64)])
            open_at = int(np.flatnonzero((keys != keys[-1]).any(axis=1)).max(initial=-1)) + 1
            if open_at:
                yield flush(keys[:open_at], fps[:open_at])
                keys, fps = keys[open_at:], fps[open_at:]
        if len(fps):
            yield flush(keys, fps)

    return laid.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest id reachable over links."""
    prints = written(fingerprints(df, id_col, text_col), "simhash")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(distinct.select("fp"), radius))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
