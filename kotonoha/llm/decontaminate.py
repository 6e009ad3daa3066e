"""Operator 6: benchmark decontamination by greedy string tiling.

Tokens are runs of letters and digits, ASCII capitals lowered; beyond ASCII, everything but
punctuation and spaces of Unicode counts as a letter, and each character of a script that is written
without blanks (Chinese, Japanese, Thai and others) is a token of its own.
Running Karp-Rabin hashes of MIN_MATCH tokens are taken over every text and every benchmark item and
joined: equal ones are seeds, checked token by token. For each (text, item) with seeds enough, greedy
string tiling marks the longest match of tokens that are not marked yet, again and again, until none
of MIN_MATCH tokens is left. The tiles may stand in any order, so reordered passages are found too. A text
is contaminated by an item if the tiles cover COVERAGE of the item's tokens. An item of fewer than
MIN_MATCH tokens is matched whole: its tile is its first occurrence in the text.

Scale: texts stay where they are. The benchmark is dealt by hash into blocks of half of BLOCK tokens on
average, each of its different rows once, and each block is broadcast and held against all texts in one pass; every block is taken. With
several blocks, the finds of each are written and its broadcast is dropped before the next, so that driver and tasks hold one block at a time.
A word that is repeated n times in an item and m times in a text costs time in proportion to n + m; r such runs in a text to r * (n + m),
as every run may be matched at every place.

Defined results: a null or empty text or item has no tokens and no match; among equally long matches the first in the item, then the first
in the text, is marked first; repeated texts and items each give rows of their own; null ids keep
their rows; other columns are not read.
"""

from __future__ import annotations

import bisect
import heapq
import re
import unicodedata
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from kotonoha.llm.common import documents, text_rows
from kotonoha.session import written

MIN_MATCH, COVERAGE, BLOCK = 4, 0.6, 2_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b > 127 else 32 for b in range(256))
#: Scripts without blanks between words, as ranges of a character class; their punctuation is cut before.
_UNSPACED = (
    "\u0e01-\u0e4e\u0e81-\u0ecd\u1000-\u109f\u1780-\u17dd\u1950-\u19df\u1a20-\u1aad\u3005-\u3007\u3021-\u3029\u3031-\u3035\u3038-\u303c\u3041-\u30ff"
    "\u3105-\u312f\u31a0-\u31bf\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua000-\ua48c\ua980-\ua9df\ua9e0-\ua9ff\uaa60-\uaa7f\uf900-\ufaff\uff66-\uff9f"
    "\U0001b000-\U0001b16f\U00020000-\U0003ffff"
)
#: Punctuation and spaces beyond ASCII (no plane behind the first two has any), with zero-width space and byte order mark.
_CUT = "".join(c for c in map(chr, range(0x80, 0x20000)) if unicodedata.category(c)[0] in "PZ" or c in "\x85\u200b\ufeff")
_TOKEN = re.compile(f"(?![ {re.escape(_CUT)}])[{_UNSPACED}]|[^ {re.escape(_CUT)}{_UNSPACED}]+")


def tokens(text: bytes) -> list[bytes]:
    text = text.translate(_LETTERS)
    if text.isascii():
        return text.split()
    return " ".join(_TOKEN.findall(text.decode())).encode().split()


def rolling(ids: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes modulo 2**64 of every window of so many ids."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    x, h = ids.astype(np.uint64) * np.uint64(0xD1342543DE82EF95), np.zeros(n, np.uint64)
    x ^= x >> np.uint64(29)
    for k in range(size):
        h = h * _BASE + x[k : k + n]
    return h


def _sums(ids: np.ndarray, power: np.ndarray) -> np.ndarray:
    """Sums of ids times powers up to each place: the hash of ids[a:b] is sums[b] - sums[a], moved by a places."""
    x = ids.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
    x ^= x >> np.uint64(29)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * power[: len(ids)], dtype=np.uint64)])


def extended(item: np.ndarray, text: np.ndarray, i: np.ndarray, t: np.ndarray, least: int) -> np.ndarray:
    """How long the matches are that begin with equal windows at (i, t), for all of them at once by bisection of hashes."""
    power = np.cumprod(np.full(max(len(item), len(text)) + 1, _BASE, np.uint64)) * np.uint64(pow(int(_BASE), -1, 1 << 64))
    a, b = _sums(item, power), _sums(text, power)
    low = np.full(len(i), least)
    high = np.minimum(len(item) - i, len(text) - t)
    while (low < high).any():
        mid = (low + high + 1) // 2
        same = (a[i + mid] - a[i]) * power[t] == (b[t + mid] - b[t]) * power[i]
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


class _Marks:
    """Marked stretches of a sequence, in order and apart."""

    def __init__(self):
        self.starts, self.ends = [], []

    def within(self, a: int, e: int) -> list[tuple[int, int]]:
        """The marked stretches that touch [a, e)."""
        k = bisect.bisect_right(self.ends, a)
        last = bisect.bisect_left(self.starts, e)
        return list(zip(self.starts[k:last], self.ends[k:last]))

    def add(self, a: int, e: int) -> None:
        k = bisect.bisect_left(self.starts, a)
        before, behind = k > 0 and self.ends[k - 1] == a, k < len(self.starts) and self.starts[k] == e
        if before and behind:
            self.ends[k - 1] = self.ends.pop(k)
            self.starts.pop(k)
        elif before:
            self.ends[k - 1] = e
        elif behind:
            self.starts[k] = a
        else:
            self.starts.insert(k, a)
            self.ends.insert(k, e)


def tiles(item: np.ndarray, text: np.ndarray, seeds: list[tuple[int, int]], least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling (item start, text start, length) from the starts (item, text) of equal windows of least tokens.

    Matches are handled as stretches: how long they are is found by bisection, what of them is free by the marked stretches that
    they touch. A match is compared token by token once, when it is marked."""
    if not seeds:
        return []
    i, t = np.array(seeds, np.int64).T
    order = np.lexsort((i, i - t))
    i, t = i[order], t[order]
    n = extended(item, text, i, t, least)
    heap, last, at = [], None, 0
    for size, a, b in zip(n.tolist(), i.tolist(), t.tolist()):  # along each diagonal
        if a - b == last and a < at:
            continue
        last, at = a - b, a + size - least + 1
        heap.append((-size, a, b))
    heapq.heapify(heap)
    in_item, in_text, out = _Marks(), _Marks(), []
    while heap:
        n, i, t = heapq.heappop(heap)
        n = -n
        taken = in_item.within(i, i + n) + [(a + i - t, e + i - t) for a, e in in_text.within(t, t + n)]
        if not taken:
            differ = np.flatnonzero(item[i : i + n] != text[t : t + n])
            if len(differ):  # equal hashes of different tokens
                taken = [(i + int(differ[0]), i + n)]
            else:
                in_item.add(i, i + n)
                in_text.add(t, t + n)
                out.append((i, t, n))
                continue
        free = i
        for a, e in [*sorted(taken), (i + n, i + n)]:  # what is left of it takes its place among the others
            if a - free >= least:
                heapq.heappush(heap, (free - a, free, t + free - i))
            free = max(free, e)
    return sorted(out)


class Index:
    """A block of the benchmark: vocabulary, items as ids, and its windows by hash."""

    def __init__(self, items: list[tuple], least: int, short: bool = False):
        """short: items of fewer than least tokens are matched whole."""
        self.least, self.names, self.vocabulary, self.items = least, [i for i, _ in items], {}, []
        for _, text in items:
            found = tokens((text or "").encode())
            self.items.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found], np.int64))
        hashes = [rolling(x, least) for x in self.items]
        self.of = np.repeat(np.arange(len(items)), [len(h) for h in hashes])
        self.at = np.concatenate([np.arange(len(h)) for h in hashes] or [np.empty(0, int)])
        h = np.concatenate(hashes or [np.empty(0, np.uint64)])
        before = np.concatenate([np.r_[0, x[: len(g) - 1]] for x, g in zip(self.items, hashes) if len(g)] or [np.empty(0, np.int64)])  # the token in front of each window
        order = np.lexsort((before, h))
        self.h, self.of, self.at, before = h[order], self.of[order], self.at[order], before[order]
        self.distinct, self.first, self.many = np.unique(self.h, return_index=True, return_counts=True)
        self.wide = len(self.vocabulary) + 2
        self.follows = np.repeat(np.arange(len(self.distinct)), self.many) * self.wide + before
        self.short: dict[int, dict[tuple, list[int]]] = {}  # by size: item numbers by ids
        for k, x in enumerate(self.items):
            if short and 0 < len(x) < least:
                self.short.setdefault(len(x), {}).setdefault(tuple(x.tolist()), []).append(k)
        self.short_h = {size: np.unique(np.concatenate([rolling(np.array(x), size) for x in known])) for size, known in self.short.items()}

    def whole(self, ids: np.ndarray) -> list[tuple]:
        """Matches of the short items, each at its first place."""
        out = []
        for size, known in self.short.items():
            at = np.flatnonzero(np.isin(rolling(ids, size), self.short_h[size]))
            if len(at):
                found, first = np.unique(ids[at[:, None] + np.arange(size)], axis=0, return_index=True)
                for x, t in zip(found.tolist(), at[first].tolist()):
                    out.extend((k, size, [(0, t, size)]) for k in known.get(tuple(x), ()))
        return out

    def matches(self, text: bytes, coverage: float) -> list[tuple]:
        """(item number, covered tokens, tiles) of each item that is covered enough."""
        if not self.vocabulary:
            return []
        found = tokens(text)
        ids = np.fromiter(map(self.vocabulary.get, found, repeat(0)), np.int64, len(found))
        return [*self.whole(ids), *self.tiled(ids, coverage)]

    def tiled(self, ids: np.ndarray, coverage: float) -> list[tuple]:
        if not len(self.distinct):
            return []
        h = rolling(ids, self.least)
        if not len(h):
            return []
        whole = np.convolve(ids != 0, np.ones(self.least, int), "valid") == self.least
        where = np.flatnonzero(whole)
        slot = np.searchsorted(self.distinct, h[where])
        hit = slot < len(self.distinct)
        hit[hit] = self.distinct[slot[hit]] == h[where][hit]
        where, slot = where[hit], slot[hit]
        if not len(where):
            return []
        good = self._covered(np.unique(slot), coverage)
        if not good.any():
            return []
        # a seed behind equal tokens goes on a longer match, and the match is known by its first seed: so a word that is repeated n and m times makes n + m pairs
        token = np.where(where > 0, ids[where - 1], 0)
        low, high = (np.searchsorted(self.follows, slot * self.wide + np.where(token > 0, token, self.wide - 1), side) for side in ("left", "right"))
        begin = np.r_[self.first[slot], high]
        many = np.r_[low, self.first[slot] + self.many[slot]] - begin
        where = np.repeat(np.r_[where, where], many)
        post = np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())
        kept = good[self.of[post]]
        where, post = where[kept], post[kept]
        of, at = self.of[post], self.at[post]
        order = np.argsort(of, kind="stable")
        of, at, where = of[order], at[order], where[order]
        out = []
        for a, e in zip(heads := np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.empty(0, int), np.r_[heads[1:], len(of)]):
            item = self.items[of[a]]
            same = (item[at[a:e, None] + np.arange(self.least)] == ids[where[a:e, None] + np.arange(self.least)]).all(axis=1)
            tiled = tiles(item, ids, list(zip(at[a:e][same].tolist(), where[a:e][same].tolist())), self.least)
            n = sum(k for _, _, k in tiled)
            if n >= coverage * len(item):
                out.append((int(of[a]), n, tiled))
        return out


    def _covered(self, slots: np.ndarray, coverage: float) -> np.ndarray:
        """For each item whether windows of these hashes cover enough of it; tiles cover no more."""
        many = self.many[slots]
        post = np.repeat(self.first[slots] - np.cumsum(many) + many, many) + np.arange(many.sum())
        of, at = self.of[post], self.at[post]
        order = np.argsort(of, kind="stable")
        of, at = of[order], at[order]
        good = np.zeros(len(self.items), bool)
        heads = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        for a, e in zip(heads.tolist(), np.r_[heads[1:], len(of)].tolist()):
            n = len(self.items[of[a]])
            covered = np.zeros(n + self.least, np.int64)
            covered[at[a:e]] += 1
            covered[at[a:e] + self.least] -= 1
            good[of[a]] = (np.cumsum(covered) > 0).sum() >= coverage * n
        return good


def _blocks(benchmark: DataFrame, block: int) -> list[DataFrame]:
    """The benchmark dealt out by hash, so that a block has half of block tokens on average; a token takes a byte and a space at least."""
    total = benchmark.agg(F.sum(F.octet_length("text") / 2 + 1)).first()[0] or 0
    count = max(1, int(np.ceil(2 * total / block)))
    return [benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k) for k in range(count)]


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, covered, n_item, coverage, tiles) of each pair whose item is covered enough."""
    rows = text_rows(df, id_col, text_col)
    items = benchmark.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    row = [StructField("covered", IntegerType()), StructField("n_item", IntegerType()), StructField("coverage", DoubleType())]
    place = StructType([StructField(x, IntegerType()) for x in ("item_start", "text_start", "length")])
    schema = StructType([rows.schema["doc_id"], items.schema["item_id"], *row, StructField("tiles", ArrayType(place))])
    tile = pa.list_(pa.struct([("item_start", pa.int32()), ("text_start", pa.int32()), ("length", pa.int32())]))
    out = None
    items = items.groupBy("item_id", "text").agg(F.count("*").cast("int").alias("copies"))
    parts = _blocks(items, block)
    for part in parts:
        held = part.toArrow()  # a block of the benchmark, of bounded size
        shared = df.sparkSession.sparkContext.broadcast((held.column("item_id").combine_chunks(), held.column("text").to_pylist(), held.column("copies").to_numpy()))

        def run(batches, shared=shared):
            names, held, copies = shared.value
            index = Index(list(enumerate(held)), min_match, short=True)
            for b in batches:
                row, found = [], []
                for r, text in enumerate(b.column(1).to_pylist()):
                    for m in index.matches(text.encode(), coverage):
                        row += [r] * int(copies[m[0]])
                        found += [m] * int(copies[m[0]])
                n = [len(index.items[k]) for k, _, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(row, pa.int32())),
                        names.take(pa.array([k for k, _, _ in found], pa.int64())),
                        pa.array([c for _, c, _ in found], pa.int32()),
                        pa.array(n, pa.int32()),
                        pa.array([c / k for (_, c, _), k in zip(found, n)], pa.float64()),
                        pa.array([[{"item_start": i, "text_start": t, "length": k} for i, t, k in x] for _, _, x in found], tile),
                    ],
                    names=["doc_id", "item_id", "covered", "n_item", "coverage", "tiles"],
                )

        found = rows.mapInArrow(run, schema)
        if len(parts) > 1:
            found = written(found, "tilings")
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    spans = F.transform("tiles", lambda t: F.concat_ws(":", t["item_start"].cast("string"), t["text_start"].cast("string"), t["length"].cast("string")))
    return found.select("doc_id", "item_id", "covered", "n_item", "coverage", F.array_join(spans, ",").alias("tiles"))
