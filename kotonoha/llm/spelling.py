"""Operator 12: spelling variants by rolling-hash deletions.

Two words are near if one inserted, deleted or replaced code point makes the one the other. Every word gives the hash of
itself and, for each place, the hash of what is left without the code point there: prefix and suffix sums of a
polynomial hash over uint64, for all words of a batch at once in numpy. Words that share such a
key are candidates: a word and what another one leaves, or what two words leave at the same place. Keys are dealt by
their low bits and sorted within partitions; equal keys then lie side by side and are paired by shifted
comparison. Only hashes of words travel with the keys; the candidates are then joined with
the words and compared as strings, so a collision of hashes adds work and never a result.

A group of equal (key, place) holds words that differ in one code point at one place: at most as
many as the alphabet has letters (90), whatever the corpus; a word has at most 90 * (2 * length + 1) near words.

Defined results: a null or blank text has no words; a null id counts as the empty text; rows that repeat are counted as often
as they stand; of near words of equal n the smallest in code-point order is the form; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kotonoha.llm.common import documents, text_rows
from kotonoha.session import written

#: A word is long and frequent enough from here on; a form stands so many times as often as its variant.
MIN_LENGTH, MIN_COUNT, TIMES = 7, 2, 10
#: One run in so many, by hash, loses a code point before it is counted.
DAMAGE = 31
#: Words counted in a Python worker before they are handed on.
HELD = 200_000
#: Keys are dealt out by so many of their low bits.
RADIX_BITS = 16
#: Letters A to Z in either case and U+00C0 to U+00FF, capitals of A to Z lowered; every other byte of Latin-1 is a blank.
_RUNS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def runs(text: str) -> list[bytes]:
    """The maximal runs of letters of a text in Latin-1, A to Z lowered; a code point outside Latin-1 becomes a blank."""
    return text.encode("latin-1", "replace").translate(_RUNS).split()


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: int = DAMAGE, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) over whole texts. damage: where it divides the crc32 h of ``id:run``, the run loses its code point h % length."""
    rows = text_rows(df, id_col, text_col).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")

    def batch(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches):
        held: Counter = Counter()
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                start = zlib.crc32(f"{doc_id}:".encode())
                for word, n in Counter(runs(text)).items():
                    if len(word) < min_length:
                        continue
                    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                    if damage and h % damage == 0:
                        word = word[: (k := h % len(word))] + word[k + 1 :]
                        if len(word) < min_length:
                            continue
                    held[word] += n
                if len(held) > HELD:
                    yield batch(held)
                    held = Counter()
        yield batch(held)

    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def deletion_keys(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, word number, place, first): the key of each word (place -1) and of what it leaves without each place.

    first: whether the place begins a run of equal letters, of which each one leaves the same."""
    size = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    codes = np.frombuffer(b"".join(words), np.uint8)
    owner = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(codes)) - starts[owner]
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(size.max(initial=0)) + 1, _BASE, np.uint64)) * _INVERSE  # base ** 0, 1, ...
        mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        term = mixed * power[place]
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(term, dtype=np.uint64)])
        whole = upto[ends] - upto[starts]
        before, behind = upto[starts[owner] + place] - upto[starts[owner]], upto[ends[owner]] - upto[starts[owner] + place + 1]
        left = before + behind * _INVERSE  # what stands behind moves one place to the front
        key = np.concatenate([whole, left]) + np.concatenate([size, size[owner] - 1]).astype(np.uint64) * np.uint64(0x94D049BB133111EB)
        key ^= key >> np.uint64(32)
        key *= np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
    first = np.ones(len(codes), bool)
    first[1:] = (codes[1:] != codes[:-1]) | (place[1:] == 0)
    return key, np.concatenate([np.arange(len(words)), owner]), np.concatenate([np.full(len(words), -1), place]).astype(np.int32), np.concatenate([np.ones(len(words), bool), first])


def pairs(key: np.ndarray, place: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that may be near, of rows sorted by (key, place): whole words with what others leave, and what two leave at one place."""
    left, right = [], []
    k = 1
    while k < len(key):
        same = (key[k:] == key[:-k]) & (place[k:] == place[:-k]) & (place[k:] >= 0)
        if not same.any():
            break
        at = np.flatnonzero(same)
        left.append(at)
        right.append(at + k)
        k += 1
    begin = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    start = np.repeat(begin, np.diff(np.append(begin, len(key))))
    k = 0
    rest = np.flatnonzero((place >= 0) & first)
    while len(rest := rest[place[np.minimum(start[rest] + k, len(key) - 1)] < 0]):  # further whole words of one key are collisions
        left.append(start[rest] + k)
        right.append(rest)
        k += 1
    none = [np.zeros(0, np.int64)]
    return np.concatenate(left or none), np.concatenate(right or none)


def _keys(words: DataFrame) -> DataFrame:
    """(radix, key, place, first, id) of all words."""

    def run(batches):
        for b in batches:
            ids, texts = b.column(0).to_numpy(), [w.encode("latin-1") for w in b.column(1).to_pylist()]
            held, size = [], 0
            for at, text in enumerate(texts):  # long words in blocks of their own
                held.append(at)
                size += len(text)
                if size > 1_000_000 or at + 1 == len(texts):
                    key, owner, place, first = deletion_keys([texts[k] for k in held])
                    id_ = ids[held][owner]
                    radix = (key & np.uint64((1 << RADIX_BITS) - 1)).astype(np.int32)
                    for s in range(0, len(key), 500_000):
                        e = s + 500_000
                        yield pa.RecordBatch.from_arrays([pa.array(radix[s:e]), pa.array(key[s:e].view(np.int64)), pa.array(place[s:e]), pa.array(first[s:e]), pa.array(id_[s:e])], names=["radix", "key", "place", "first", "id"])
                    held, size = [], 0

    return words.select(F.xxhash64("word").alias("id"), "word").mapInArrow(run, "radix int, key bigint, place int, first boolean, id bigint")


def candidates(words: DataFrame) -> DataFrame:
    """(a, b, a_place, b_place): hashes of words that share a key; a place of -1 stands for the whole word."""

    def run(batches):
        held = None
        for b in batches:
            part = [b.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            if held is not None:
                part = [np.concatenate(x) for x in zip(held, part)]
            # what may go on in the next batch is held back
            done = int(np.searchsorted(part[0] == part[0][-1], True)) if len(part[0]) else 0
            held = [x[done:] for x in part]
            yield found([x[:done] for x in part])
        if held is not None:
            yield found(held)

    def found(part) -> pa.RecordBatch:
        key, place, first, id_ = part
        i, j = pairs(key, place, first)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (id_[i], id_[j], place[i], place[j])], names=["a", "b", "a_place", "b_place"])

    keys = _keys(words).repartition("radix").sortWithinPartitions("key", "place").select("key", "place", "first", "id")
    return keys.mapInArrow(run, "a bigint, b bigint, a_place int, b_place int")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n) for every ordered pair of near words, compared as strings."""
    known = words.select(F.xxhash64("word").alias("id"), "word", "n")
    left = lambda word, place: F.when(F.col(place) < 0, F.col(word)).otherwise(F.concat(F.substring(F.col(word), F.lit(1), F.col(place)), F.substring(F.col(word), F.col(place) + 2, F.length(word))))
    side = lambda s: known.select(*(F.col(c).alias(f"{s}{c}") for c in ("id", "word", "n")))
    rows = candidates(words).join(side("x"), F.col("a") == F.col("xid")).join(side("y"), F.col("b") == F.col("yid"))
    rows = rows.filter((left("xword", "a_place") == left("yword", "b_place")) & (F.col("xword") != F.col("yword")))
    both = F.array(*(F.struct(F.col(f"{s}word").alias("word"), F.col(f"{s}n").alias("n"), F.col(f"{t}word").alias("other"), F.col(f"{t}n").alias("other_n")) for s, t in (("x", "y"), ("y", "x"))))
    return rows.select(F.inline(both)).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form, following forms to the last; each round doubles the steps taken.

    A form stands TIMES as often as its variant, so there are few steps, and no circles."""
    now = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        next_ = now.select(F.col("word").alias("at"), F.col("root").alias("further"))
        now = written(now.join(next_, F.col("root") == F.col("at"), "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        if not now.filter("moved").limit(1).count():
            return now.select("word", "root")
        now = now.select("word", "root")


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each of (word, n): a written table or one that is cheap to read again."""
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word"))).alias("best"))
    rows = words.join(near, "word", "left")
    enough = -F.col("best.n") >= times * F.col("n")
    rows = written(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(enough, F.col("best.word")).alias("form"), F.when(enough, -F.col("best.n")).cast("bigint").alias("form_n")), "spelling-forms")
    found = roots(rows.filter("form is not null"))
    return rows.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(written(word_counts(documents(spark, sf_dir)), "spelling-words"))
