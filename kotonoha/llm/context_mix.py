"""Operator 2: language-model scoring by online logistic mixing of hashed-context bit predictors.

Words: ASCII capitals lowered, runs of other bytes than blanks; an end follows each text. The HEAD
most frequent training words (those seen more than RARE times), the end and an escape have a Huffman code, so that a word is a few
binary decisions. Each decision is predicted from hashed contexts (none; the last word; the last two;
the last of the most frequent words, which tells the language) by counts over all training texts.
The predictions are mixed in the logistic domain by weights that a gate selects by how well the
contexts are known. Counts are those of all training texts, and all of them teach the weights: each of FOLDS parts of the texts is predicted
from the counts of the others, its decisions are tallied by their predictions (in bins, cells()), and each gate's weights are those of the least
loss over its tally (learnt()). Tallies are whole numbers, so the weights are the same however the rows are partitioned. They are refined online in each text,
after every BLOCK words, from its own errors; a block's probability uses only earlier blocks.
A word outside the head costs the escape and then a mixture of its training count and of a second
mixer over the bits of its bytes, in contexts of the last 1, 2, 3 and 5 bytes, counts and weights of which come from all such
words. A text's score is the log probability of its words and its end, one after the other: those of all sequences of words make 1 at
most. Bits per byte follow from the sum.

Scale: words are counted in each batch before they are shuffled, and their table grows with the corpus; bit counts are
summed in arrays of fixed size (SLOTS a context), in chunks; words outside the head (HEAD) meet their counts in a join. The driver gets the
head and the arrays, whose sizes are fixed parameters. Nodes that follow one another in a word's code
stand next to one another in an array, whatever the context.

Defined results: a null text counts as empty and consists of its end; a null id is a text like any
other (its crc32 is that of the empty text); repeated rows are scored each on their own; without
training texts every word is unknown; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
import struct
import zlib
from collections import Counter
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField, StructType

from kotonoha.llm.common import LOWER, documents, id_crc, words
from kotonoha.session import written

HEAD, RARE, SLOTS, FREQUENT, BLOCK = 65_000, 4, 1 << 19, 64, 64
#: Slots of an array that travel as one row; words or bytes that are worked on at once, texts as long as its first one that a portion has room for.
CHUNK, STEP, ALIKE = 1 << 14, 12_500, 4
RATE, START = 0.3, 0.3
#: Parts of the training texts, and of the words outside the head, that are predicted from the counts of the others; the pull of weights to START.
FOLDS, PULL = 2, 16.0
_LEVELS = (1, 4, 32)
#: The mixed prediction is held to so much on either side.
_MOST = 30.0
ORDERS = (1, 2, 3, 5)


#: Layout of a key that no word has: a blank and the number of a row.
_ROW = ">cq"


def _at(a: np.ndarray, index: np.ndarray) -> np.ndarray:
    """a[index] for indexes that lie within a, which are not tested again."""
    return a.take(index, mode="clip")


def _slot(h: np.ndarray) -> np.ndarray:
    """Where the counts of a context begin; the place of a node is exclusive-ored to it."""
    x = h.astype(np.uint32)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    x ^= x >> np.uint32(12)
    x *= np.uint32(0x297A2D39)
    return (x >> np.uint32(32 - SLOTS.bit_length() + 1)).astype(np.int64)


def _places(group: np.ndarray, local: np.ndarray) -> np.ndarray:
    """Places of nodes: those of one group, with local numbers below 16, stand in one line of memory whatever the context."""
    return _slot(group.astype(np.uint32) * np.uint32(0x85EBCA6B) + np.uint32(0x7F4A7C15)) & ~np.int64(15) | local


class Huffman:
    """Paths of a prefix code: nodes and bits of symbol s are nodes[start[s]:start[s]+length[s]] and so on."""

    def __init__(self, counts: list[int]):
        heap = [(c, i, i) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        parent, bit, n = {}, {}, len(counts)
        while len(heap) > 1:
            (a, i, x), (b, j, y) = heapq.heappop(heap), heapq.heappop(heap)
            parent[x], parent[y], bit[x], bit[y] = n, n, 0, 1
            heapq.heappush(heap, (a + b, min(i, j), n))
            n += 1
        self.n_nodes = n - len(counts)
        paths = []
        for s in range(len(counts)):
            path, x = [], s
            while x in parent:
                path.append((parent[x] - len(counts), bit[x]))
                x = parent[x]
            paths.append(path[::-1])
        # nodes in groups of up to four levels below one another
        group, local = np.zeros(max(1, self.n_nodes), np.int64), np.ones(max(1, self.n_nodes), np.int64)
        for path in paths:
            for depth in range(1, len(path)):
                (above, turn), x = path[depth - 1], path[depth][0]
                group[x], local[x] = (x, 1) if depth % 4 == 0 else (group[above], 2 * local[above] + turn)
        place = _places(group, local)
        self.length = np.array([len(p) for p in paths], np.int64)
        self.start = np.cumsum(np.r_[0, self.length[:-1]])
        self.nodes = np.array([x for x, _ in chain.from_iterable(paths)], np.int64)
        self.places = place[self.nodes]
        self.bits = np.array([b for _, b in chain.from_iterable(paths)], np.int8)
        #: Nodes and places with their bits behind them.
        self.taken, self.turns = self.nodes << 1 | self.bits, self.places << 1 | self.bits
        #: 1 for a bit of 0, -1 for one of 1.
        self.signs = (1 - 2 * self.bits).astype(np.float32)


class WordBits:
    """Decisions of word sequences.

    decisions(), block by block: for a list of texts, (slots by predictor, bit, 64 times the text, where each block ends).
    predictions(), in the same order: what known (see predicting()) tells in place of slots, and for a bit 1 (0) or -1 (1).
    outcomes(), in any order and part by part: for each predictor twice the slot, plus the bit."""

    K = 4

    def __init__(self, head: list[bytes], code: Huffman):
        self.ids = {w: i for i, w in enumerate(head)}
        self.end, self.escape, self.begin = len(head), len(head) + 1, len(head) + 2
        self.code = code
        self.sizes = [max(1, self.code.n_nodes), SLOTS, SLOTS, SLOTS]

    def symbols(self, found: list[bytes]) -> np.ndarray:
        out = np.full(len(found) + 1, self.end, np.int64)
        out[:-1] = np.fromiter(map(self.ids.get, found, repeat(self.escape)), np.int64, len(found))
        return out

    def contexts(self, texts: list[np.ndarray]):
        """Symbols of all texts, their places and those of their texts' first ones, the lengths of the texts, and where the counts of each symbol's contexts begin."""
        lengths = np.array([len(t) for t in texts])
        s, starts = np.concatenate(texts), np.repeat(np.cumsum(lengths) - lengths, lengths)
        at = np.arange(len(s))
        back = lambda k: np.where(at - k >= starts, s[np.maximum(at - k, 0)], self.begin).astype(np.uint32)
        seen = np.r_[-1, np.maximum.accumulate(np.where(s < FREQUENT, at, -1))[:-1]]
        last = np.where(seen >= starts, s[np.maximum(seen, 0)], self.begin).astype(np.uint32)
        one, two = back(1), back(2)
        hashes = [_slot(h) for h in ((one + np.uint32(1)) * np.uint32(0x9E3779B1), (one * np.uint32(0x27D4EB2F) ^ (two + np.uint32(7)) * np.uint32(0x165667B1)), (last + np.uint32(3)) * np.uint32(0xC2B2AE3D))]
        return s, at, starts, lengths, hashes

    def outcomes(self, texts: list[np.ndarray]):
        """The first decisions of all symbols, then the second ones, and so on: a symbol's contexts are not repeated for each of its decisions."""
        s, _, _, _, hashes = self.contexts(texts)
        code = self.code
        size = code.length[s]
        order = np.argsort(-size.astype(np.int8), kind="stable")  # those with further decisions stand first; a radix sort
        path, hashes = code.start[s[order]], [h[order] << 1 for h in hashes]
        for n in np.cumsum(np.bincount(size)[:0:-1])[::-1].tolist():
            path = path[:n]
            turns = _at(code.turns, path)
            yield [_at(code.taken, path), *(h[:n] ^ turns for h in hashes)]
            path += 1

    def predicting(self, known: list[np.ndarray]) -> list[np.ndarray]:
        """The predictions by slot as predictions() reads them: those without a context along the paths of the code."""
        return [_at(known[0], self.code.nodes), *known[1:]]

    def _laid(self, texts: list[np.ndarray]):
        """What decisions() and predictions() begin with, block by block: where the contexts of symbols begin, their numbers of decisions, the paths, and the ends of both."""
        s, at, starts, lengths, hashes = self.contexts(texts)
        text, block = np.repeat(np.arange(len(texts)), lengths), (at - starts) // BLOCK
        if len(block) and block.max():  # blocks of all texts one after the other
            order = np.argsort(block, kind="stable")
            s, text, block, hashes = s[order], text[order], block[order], [h[order] for h in hashes]
        code = self.code
        size = code.length[s]
        path = np.repeat(code.start[s] - np.cumsum(size) + size, size)
        path += np.arange(len(path))
        return hashes, size, path, np.repeat(text * 64, size), np.cumsum(np.bincount(block, size)).astype(np.int64)

    def decisions(self, texts: list[np.ndarray]):
        hashes, size, path, text, ends = self._laid(texts)
        place = _at(self.code.places, path)
        return [_at(self.code.nodes, path), *(np.repeat(h, size) ^ place for h in hashes)], _at(self.code.bits, path), text, ends

    def predictions(self, texts: list[np.ndarray], known: list[np.ndarray]):
        hashes, size, path, text, ends = self._laid(texts)
        place, x = _at(self.code.places, path), [_at(known[0], path)]
        for h, t in zip(hashes, known[1:]):
            at = np.repeat(h, size)
            at ^= place
            x.append(_at(t, at))
        return x, _at(self.code.signs, path), text, ends


_node = np.arange(256)
#: Places of the nodes of a byte's tree: the first four bits of a byte, and the last four behind each of their values.
_BYTE_PLACES = _places(np.where(_node < 16, 0, _node >> np.maximum(0, np.log2(np.maximum(_node, 1)).astype(int) - 4)), np.where(_node < 16, _node, 1 << np.maximum(0, np.log2(np.maximum(_node, 1)).astype(int) - 4) | (_node & ((1 << np.maximum(0, np.log2(np.maximum(_node, 1)).astype(int) - 4)) - 1))))

#: The eight nodes above every byte, their bits, and both together.
_PATH = (_node[:, None] | 256) >> (8 - np.arange(8))
_TREE, _TREE_BITS = _BYTE_PLACES[_PATH], ((_node[:, None] >> (7 - np.arange(8))) & 1).astype(np.int8)
_TURNS = _TREE << 1 | _TREE_BITS


class ByteBits:
    """Decisions of the bytes of words, each word with a final blank; a word is one block."""

    K = len(ORDERS)
    sizes = [SLOTS] * len(ORDERS)

    def contexts(self, found: list[bytes]):
        """Bytes of all words, the lengths of the words, and where the counts of each byte's contexts begin."""
        lengths = np.array([len(w) + 1 for w in found])
        x = np.frombuffer(b" ".join(found) + b" ", np.uint8).astype(np.uint32)
        starts, at = np.repeat(np.cumsum(lengths) - lengths, lengths), np.arange(len(x))
        hashes, h = [], np.zeros(len(x), np.uint32)
        for k in range(1, max(ORDERS) + 1):
            h = h * np.uint32(0x01000193) + np.where(at - k >= starts, x[np.maximum(at - k, 0)] + np.uint32(1), np.uint32(0))
            if k in ORDERS:
                hashes.append(_slot((h + np.uint32(k)) * np.uint32(0x9E3779B1)))
        return x.astype(np.intp), lengths, hashes

    def predicting(self, known: list[np.ndarray]) -> list[np.ndarray]:
        return known

    def decisions(self, found: list[bytes]):
        x, lengths, hashes = self.contexts(found)
        place = _TREE.take(x, axis=0)
        bit = _TREE_BITS.take(x, axis=0).ravel()
        word = np.repeat(64 * np.arange(len(found)), 8 * lengths)
        return [(h[:, None] ^ place).ravel() for h in hashes], bit, word, np.array([len(word)])

    def predictions(self, found: list[bytes], known: list[np.ndarray]):
        slots, bit, word, ends = self.decisions(found)
        return [_at(t, at) for t, at in zip(known, slots)], (1 - 2 * bit).astype(np.float32), word, ends

    def outcomes(self, found: list[bytes]):
        x, _, hashes = self.contexts(found)
        turns = _TURNS.take(x, axis=0)
        yield [((h << 1)[:, None] ^ turns).ravel() for h in hashes]


def _predicted(zeros: np.ndarray, ones: np.ndarray, k: int) -> np.ndarray:
    """The prediction of counts of zeros and ones, with how well they are known in its last bits; k: which of the three places of those, none below 0."""
    stretch = np.clip(np.log((ones + np.float32(0.4)) / (zeros + np.float32(0.4))), -8, 8)
    level = sum((zeros + ones >= least).astype(np.int32) for least in _LEVELS)
    return (stretch.view(np.int32) & ~np.int32(63) | (level << (4 - 2 * k) if k >= 0 else 0)).view(np.float32)


class Mixer:
    """Predictors of the decisions, and the weights that mix them."""

    def __init__(self, bits, counts: list[np.ndarray], weights: np.ndarray | None = None):
        self.bits = bits
        self.weights = np.full((64, bits.K), START, np.float32) if weights is None else weights.astype(np.float32)
        self.know(counts)

    def know(self, counts: list[np.ndarray]) -> None:
        """counts: for each predictor zeros and ones by slot, in turns.

        A slot's prediction carries in two of its last six bits how well the slot is known, so that one access finds both."""
        self.known = self.bits.predicting([_predicted(c[::2].astype(np.float32), c[1::2].astype(np.float32), k) for k, c in enumerate(counts, 3 - len(counts))])

    def run(self, items: list, rate: float) -> np.ndarray:
        """Natural log of the probability of each item; each item refines weights of its own, block by block."""
        order = np.arange(len(items))
        if rate:  # the longest first, so that those with a further block are always the first ones
            order = np.argsort([-len(x) for x in items], kind="stable")
            items = [items[i] for i in order]
        x, against, item, ends = self.bits.predictions(items, self.known)
        lanes = 64 * len(items) if rate else 64
        gate = x[-3].view(np.int32) | x[-2].view(np.int32)
        gate |= x[-1].view(np.int32)
        gate &= 63
        key = item + gate if lanes > 64 else gate.astype(np.intp)  # indexes as they are, not converted at each use
        weights = [np.tile(self.weights[:, k], lanes // 64) for k in range(self.bits.K)]
        odds, begin = np.empty(len(against), np.float32), 0  # 1 / p
        blocks = np.array([-(-len(x) // BLOCK) for x in items]) if rate else None
        for k, end in enumerate(ends):
            rows = slice(begin, end)
            ks, xs, sign, begin = key[rows], [a[rows] for a in x], against[rows], end
            z = np.multiply(xs[0], _at(weights[0], ks), out=odds[rows])
            for a, w in zip(xs[1:], weights[1:]):
                part = _at(w, ks)
                part *= a
                z += part
            z *= sign
            np.clip(z, -_MOST, _MOST, out=z)  # alike for both outcomes, whose probabilities still make 1
            np.exp(z, out=z)
            z += 1
            if rate and end < len(against):  # only texts with a further block, which stand first
                lanes = 64 * int((blocks > k + 1).sum())
                n_rows = int(np.searchsorted(item[rows], lanes))
                ks, xs, z, sign = ks[:n_rows], [a[:n_rows] for a in xs], z[:n_rows], sign[:n_rows]
                miss = 1 / z
                np.subtract(1, miss, out=miss)
                miss *= sign
                n = np.bincount(ks, minlength=lanes)
                step = (-rate / np.maximum(n, 16)).astype(np.float32)
                for a, w in zip(xs, weights):
                    w[:lanes] += step * np.bincount(ks, miss * a, lanes)
        np.log(odds, out=odds)
        total = np.empty(len(items))
        total[order] = -np.bincount(item // 64, odds, len(items))
        return total


def tallied(bits, portions, into: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """For each predictor the counts of zeros and ones by slot, in turns."""
    into = into or [np.zeros(2 * k, np.uint32) for k in bits.sizes]
    one = np.uint32(1)
    for items in portions:
        for part in bits.outcomes(items):
            for c, at in zip(into, part):
                np.add.at(c, at, one)
    return into


#: What a prediction is tallied as: 0 for an unseen slot, 1 to 9 for the counts of one seen less than four times, then bins of 0.4 below 32 times, of 0.5 above.
_PAIRS = [(a, b) for a in range(4) for b in range(4) if 0 < a + b < 4]
_FEW = np.zeros((4, 4), np.int32)
_FEW[tuple(zip(*_PAIRS))] = range(1, 10)
_SOME = math.log((_LEVELS[2] - 0.6) / 0.4)
_BINS = np.r_[0.0, [math.log((a + 0.4) / (b + 0.4)) for a, b in _PAIRS], (np.arange(22) + 0.5) / 11 * _SOME - _SOME, (np.arange(32) + 0.5) / 2 - 8]
_KNOWN = np.repeat(np.arange(4), [1, 9, 22, 32])


def _codes(counts: np.ndarray, first: bool) -> np.ndarray:
    """By slot and outcome, in turns: the bin of what the slot predicts for that outcome; first: the predictor without a level, in the last 32 bins only."""
    own = counts.astype(np.float32)
    other = own.reshape(-1, 2)[:, ::-1].ravel()
    stretch, n = np.clip(np.log((own + np.float32(0.4)) / (other + np.float32(0.4))), -8, 8), own + other
    many = np.clip((stretch + 8) * 2, 0, 31).astype(np.int32)
    if first:
        return many
    some = np.clip((stretch + _SOME) / _SOME * 11, 0, 21).astype(np.int32)
    few = _FEW[np.minimum(own, 3).astype(int), np.minimum(other, 3).astype(int)]
    return np.select([n < _LEVELS[0], n < _LEVELS[1], n < _LEVELS[2]], [np.int32(0), few, some + 10], many + 32)


def coded(counts: list[np.ndarray]) -> list[np.ndarray]:
    """For each predictor its share in the number of a cell, by slot and outcome."""
    last = len(counts) - 1
    return [_codes(c, len(counts) - k > 3) << np.int32(6 * (last - k)) for k, c in enumerate(counts)]


def cells(bits, codes: list[np.ndarray], portions, into: np.ndarray | None = None) -> np.ndarray:
    """How many decisions fall into each cell, that is have the same bins of all predictions for their outcome."""
    into = np.zeros(1 << 6 * bits.K - 1, np.uint32) if into is None else into
    for items in portions:
        for part in bits.outcomes(items):
            first, *others = (_at(c, at) for c, at in zip(codes, part))
            for x in others:
                first += x
            np.add.at(into, first.astype(np.intp), np.uint32(1))
    return into


def _gates(cell: np.ndarray) -> np.ndarray:
    return _KNOWN[cell >> 12 & 63] << 4 | _KNOWN[cell >> 6 & 63] << 2 | _KNOWN[cell & 63]


def learnt(cell: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """The weights of every gate under which n decisions of each cell lose least, by Newton's steps; PULL holds those that few decisions tell of."""
    gate, x = _gates(cell), [_BINS[(cell >> 6 * (k - 1 - j) & 63) + (32 if k - j > 3 else 0)] for j in range(k)]
    w = np.full((64, k), START)
    for _ in range(100):
        miss = 1 / (1 + np.exp(sum(a * w[gate, j] for j, a in enumerate(x))))
        slope = np.stack([np.bincount(gate, n * miss * a, 64) for a in x], axis=1) - PULL * (w - START)
        bend = np.stack([np.stack([np.bincount(gate, n * miss * (1 - miss) * a * b, 64) for a in x], axis=1) for b in x], axis=2) + PULL * np.eye(k)
        step = np.linalg.solve(bend, slope[:, :, None])[:, :, 0]
        w += step / np.maximum(1, np.abs(step).max(axis=1, keepdims=True))
        if np.abs(step).max() < 1e-6:
            break
    return w


def fitted(bits, counts: list[np.ndarray], portions) -> np.ndarray:
    """Weights learnt from portions that are predicted from counts."""
    found = cells(bits, coded(counts), portions)
    cell = np.flatnonzero(found)
    return learnt(cell, found[cell], bits.K)


def _portions(items, size, step: int = STEP, alike: int = 0):
    """Lists of items of a total size of step, or of the item that reaches it; alike: how many items of the size of its first one a list has room for at least."""
    part, n, now = [], 0, step
    for x in items:
        if alike and not part:
            now = max(step, alike * size(x))
        part.append(x)
        n += size(x)
        if n >= now:
            yield part
            part, n = [], 0
    if part:
        yield part


def _summed(df: DataFrame, make, sizes: list[int]) -> list[np.ndarray]:
    """The arrays of every partition (make(batches)), summed chunk by chunk."""

    def row(k, at, c):
        packed = zlib.compress(c.astype(np.min_scalar_type(c.max())).tobytes(), 1)
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([at], pa.int32()), pa.array([len(c)], pa.int32()), pa.array([packed], pa.binary())], names=["k", "at", "n", "c"])

    def unpacked(n, c):
        c = zlib.decompress(c)
        return np.frombuffer(c, f"u{len(c) // n}")

    def count(batches):
        for k, c in enumerate(make(batches)):
            for at in range(0, len(c), CHUNK):
                if (part := c[at : at + CHUNK]).any():
                    yield row(k, at, part)

    def add(batches):
        total = {}
        for b in batches:
            for k, at, n, c in zip(*(x.to_pylist() for x in b.columns)):
                if (k, at) not in total:
                    total[k, at] = np.zeros(n, np.int64)
                total[k, at] += unpacked(n, c)
        for (k, at), c in total.items():
            yield row(k, at, c)

    schema = "k int, at int, n int, c binary"
    out = [np.zeros(2 * n, np.float32) for n in sizes]
    for r in df.mapInArrow(count, schema).repartition("k", "at").mapInArrow(add, schema).collect():  # of fixed size
        out[r.k][r.at : r.at + r.n] = unpacked(r.n, r.c)
    return out


def _weights(rows: DataFrame, make, k: int) -> np.ndarray:
    """Weights of k predictors from the cells of every partition (make(batches)), which are summed and learnt from gate by gate."""

    def count(batches):
        found = make(batches)
        cell = np.flatnonzero(found)
        gates = _gates(cell)
        for gate in np.unique(gates).tolist():
            mine = cell[gates == gate]
            yield pa.RecordBatch.from_arrays([pa.array([gate], pa.int32()), pa.array([mine.astype(np.uint32).tobytes()], pa.binary()), pa.array([found[mine].tobytes()], pa.binary())], names=["gate", "cell", "n"])

    def learn(batches):
        total, gates = None, set()
        for b in batches:
            for gate, cell, n in zip(*(x.to_pylist() for x in b.columns)):
                total = np.zeros(1 << 6 * k - 1, np.int64) if total is None else total
                total[np.frombuffer(cell, np.uint32)] += np.frombuffer(n, np.uint32)
                gates.add(gate)
        if gates:
            cell = np.flatnonzero(total)
            w = learnt(cell, total[cell], k).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(sorted(gates), pa.int32()), pa.array([w[g].tobytes() for g in sorted(gates)], pa.binary())], names=["gate", "w"])

    out = np.full((64, k), START, np.float32)
    for r in rows.mapInArrow(count, "gate int, cell binary, n binary").repartition("gate").mapInArrow(learn, "gate int, w binary").collect():  # 64 at most
        out[r.gate] = np.frombuffer(r.w, np.float32)
    return out


def counted(df: DataFrame) -> DataFrame:
    """(word, c) over the trained ones of (text, trained) rows, counted in every batch before the shuffle; words of the others are listed with 0."""

    def run(batches):
        for whole in batches:
            for b in (whole.slice(at, 2000) for at in range(0, whole.num_rows, 2000)):
                seen = Counter()
                for t, trained in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    found = words(t.encode())
                    seen.update(found if trained else dict.fromkeys(found, 0))
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])

    return df.select("text", "trained").mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


class Model:
    """What scoring needs besides the counts of the words outside the head."""

    def __init__(self, head, head_counts, n_docs, tokens, types):
        self.head, self.head_counts, self.n_docs, self.tokens, self.types = head, head_counts, n_docs, tokens, types
        self.tail_tokens = tokens - n_docs - sum(head_counts)
        self.tail_types = types - len(head) - (n_docs > 0)
        self.code = Huffman([*head_counts, max(1, n_docs), max(1, self.tail_tokens)])
        self.made: dict = {}
        self.word_counts = self.byte_counts = self.word_weights = self.byte_weights = None

    def __getstate__(self):
        return self.__dict__ | {"made": {}}

    def once(self, name: str, make):
        """make() the first time that a Python worker asks for it."""
        if name not in self.made:
            self.made[name] = make()
        return self.made[name]

    def bits(self) -> WordBits:
        return self.once("bits", lambda: WordBits(self.head, self.code))

    def word_mixer(self) -> Mixer:
        return self.once("words", lambda: Mixer(self.bits(), self.word_counts, self.word_weights))

    def byte_mixer(self) -> Mixer:
        return self.once("bytes", lambda: Mixer(ByteBits(), self.byte_counts, self.byte_weights))

    def base(self, c):
        return np.log10((np.asarray(c, float) + 1) / (self.tokens + self.types + 1))


def covered(counts: DataFrame, df: DataFrame, text_col: str = "text") -> DataFrame:
    """counts with the words of further rows, which it has not seen, as 0."""
    new = counted(df.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.lit(False).alias("trained")))
    return counts.unionByName(new).groupBy("word").agg(F.sum("c").alias("c"))


def train(df: DataFrame, text_col: str = "text", trained: Column | bool = True, id_col: str = "doc_id") -> tuple[Model, DataFrame]:
    """The model of the trained rows, and the written counts of the words of all rows (0 for those that only others have)."""
    sc = df.sparkSession.sparkContext
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(trained if isinstance(trained, Column) else F.lit(trained), F.lit(False)).alias("trained"))
    train_rows = rows.filter("trained")
    counts = written(counted(rows), "words")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    docs = train_rows.count()
    top = counts.filter(F.col("c") > RARE).orderBy(F.desc("c"), "word").limit(HEAD).collect()
    model = Model([bytes(r.word) for r in top], [r.c for r in top], docs, total.n + docs, total.v + (docs > 0))
    shared = sc.broadcast(model)  # HEAD words

    def folds(batches, prepared, size):
        """(fold, portions) of every batch of (item, fold)."""
        for b in batches:
            items, fold = b.column(0).to_pylist(), b.column(1).to_pylist()
            for f in range(FOLDS):
                yield f, _portions(prepared(x for x, at in zip(items, fold) if at == f), size)

    symbol = np.min_scalar_type(model.bits().begin)

    def symbols(batches):
        bits = shared.value.bits()
        for whole in batches:
            for b in (whole.slice(at, 2000) for at in range(0, whole.num_rows, 2000)):
                yield pa.RecordBatch.from_arrays([pa.array([bits.symbols(words(t.encode())).astype(symbol).tobytes() for t in b.column(0).to_pylist()], pa.binary()), b.column(1)], names=["symbols", "fold"])

    def texts(batches):
        return folds(batches, lambda found: (np.frombuffer(x, symbol).astype(np.int64) for x in found), len)

    def tails(batches):
        head = shared.value.bits().ids
        return folds(batches, lambda found: (w for w in found if w not in head), lambda w: len(w) + 1)

    def tally(bits, parts):
        into = [[np.zeros(2 * k, np.uint32) for k in bits.sizes] for _ in range(FOLDS)]  # a task has fewer decisions
        for f, portions in parts:
            tallied(bits, portions, into[f])
        return list(chain.from_iterable(into))

    def by_fold(bits, found):
        return [found[f * bits.K : (f + 1) * bits.K] for f in range(FOLDS)]

    def others(counts):
        """For each fold the codes by the counts of the other ones."""
        total = [sum(c) for c in zip(*counts)]
        return [coded([t - c for t, c in zip(total, part)]) for part in counts]

    def celled(bits, codes, parts):
        into = None
        for f, portions in parts:
            into = cells(bits, codes[f], portions, into)
        return cells(bits, codes[0], ()) if into is None else into

    fold = lambda *columns: F.pmod(F.xxhash64(*columns), F.lit(FOLDS)).cast("int").alias("fold")
    learn_rows = written(train_rows.select("text", fold("id", "text")).mapInArrow(symbols, "symbols binary, fold int"), "symbols")
    learn_words = counts.filter("c > 0").select("word", fold("word"))
    word_counts = by_fold(WordBits, _summed(learn_rows, lambda batches: tally(shared.value.bits(), texts(batches)), model.bits().sizes * FOLDS))
    byte_counts = by_fold(ByteBits, _summed(learn_words, lambda batches: tally(ByteBits(), tails(batches)), ByteBits.sizes * FOLDS))
    known = sc.broadcast((word_counts, byte_counts))  # arrays of fixed size

    def codes(k):
        return shared.value.once(f"codes {k}", lambda: others(known.value[k]))

    model.word_weights = _weights(learn_rows, lambda batches: celled(shared.value.bits(), codes(0), texts(batches)), WordBits.K)
    model.byte_weights = _weights(learn_words, lambda batches: celled(ByteBits(), codes(1), tails(batches)), ByteBits.K)
    model.word_counts, model.byte_counts = ([sum(c) for c in zip(*found)] for found in (word_counts, byte_counts))
    shared.destroy()
    known.destroy()
    model.made.clear()
    return model, counts


def score(df: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, n_known, base_score, score, bits_per_byte); scores are log10 probabilities.

    counts: has every word of df, as train() gives it for its rows and covered() for others."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("rid"))
    shared = df.sparkSession.sparkContext.broadcast(model)
    longs = ("n", "n_bytes", "n_tokens", "n_known")
    schema = StructType([rows.schema["doc_id"], StructField("rid", LongType()), StructField("key", BinaryType()), *(StructField(x, LongType()) for x in longs), StructField("base", DoubleType()), StructField("score", DoubleType())])

    def run(batches):
        m = shared.value
        bits = m.bits()
        mixer = m.word_mixer()
        base = m.base([*m.head_counts, m.n_docs, 0])
        base[-1] = 0.0  # the words behind an escape follow in rows of their own
        for whole in batches:
            for b in (whole.slice(at, 2000) for at in range(0, whole.num_rows, 2000)):
                ids, rids = b.column(0), b.column(2)
                texts = sorted(((r, words(t.encode())) for r, t in enumerate(b.column(1).to_pylist())), key=lambda x: -len(x[1]))  # those of a portion have as many blocks
                for part in _portions(texts, lambda x: len(x[1]) + 1, alike=ALIKE):
                    symbols = [bits.symbols(f) for _, f in part]
                    logs = mixer.run(symbols, RATE)
                    index = pa.array([r for r, _ in part])
                    size = np.array([len(s) for s in symbols])
                    flat, label = np.concatenate(symbols), np.repeat(np.arange(len(part)), size)
                    gone, tails = flat == bits.escape, Counter()
                    for k, (s, (_, f)) in enumerate(zip(symbols, part)):
                        tails.update((k, f[e]) for e in np.flatnonzero(s == bits.escape).tolist())
                    known = size - np.bincount(label[gone], minlength=len(part)) - (m.n_docs == 0)
                    of, mine = ids.take(index), rids.take(index)
                    yield pa.RecordBatch.from_arrays(
                        [
                            of, mine, pa.array([struct.pack(_ROW, b" ", r) for r in mine.to_pylist()], pa.binary()), pa.array(np.zeros(len(part), np.int64)), pa.array([sum(map(len, f)) for _, f in part], pa.int64()),
                            pa.array(size), pa.array(known), pa.array(np.bincount(label, base[flat], len(part))), pa.array(logs / math.log(10)),
                        ],
                        names=schema.names,
                    )
                    if not tails:
                        continue
                    at, k = pa.array([a for a, _ in tails]), len(tails)
                    zero, none = pa.array(np.zeros(k, np.int64)), pa.array(np.zeros(k))
                    yield pa.RecordBatch.from_arrays([pa.nulls(k, ids.type), mine.take(at), pa.array([w for _, w in tails], pa.binary()), pa.array(list(tails.values()), pa.int64()), zero, zero, zero, none, none], names=schema.names)

    def spell(batches):
        m = shared.value
        mixer, head = m.byte_mixer(), m.bits().ids
        for b in batches:
            at = [i for i, w in enumerate(b.column(0).to_pylist()) if w not in head]
            if at:
                b = b.take(pa.array(at))
                logs = np.concatenate([mixer.run(some, 0.0) for some in _portions(b.column(0).to_pylist(), lambda w: len(w) + 1)]) / math.log(10)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(logs)], names=["word", "c", "spelled"])

    # words outside the head, each spelled once; a text's own row has a key that begins with a blank, which no word holds
    spelled = counts.select("word", "c").mapInArrow(spell, "word binary, c bigint, spelled double").select(F.col("word").alias("key"), "c", "spelled")
    known = float(max(1, model.tail_tokens))
    new = (model.tail_types + 1.0) / (model.tail_tokens + model.tail_types + 1.0)  # the share of words not seen before
    c, n, is_text = F.coalesce("c", F.lit(0)), F.col("n"), F.col("n") == 0
    by_letters = F.coalesce("spelled", F.raise_error(F.lit("counts lack a word of the texts: see covered()")).cast("double"))
    # of an unseen word only its letters are left, whose probability may be too small for a number
    tail = F.when(c == 0, F.lit(math.log10(new)) + by_letters).otherwise(F.log10(c * F.lit((1 - new) / known) + F.lit(new) * F.pow(F.lit(10.0), by_letters)))
    found = rows.mapInArrow(run, schema).join(spelled, "key", "left").select(
        "rid", "doc_id", "n_bytes", "n_tokens",
        (F.col("n_known") + F.when(~is_text & (c > 0), n).otherwise(0)).alias("n_known"),
        F.when(is_text, F.col("base")).otherwise(n * F.log10((c + 1) / F.lit(float(model.tokens + model.types + 1)))).alias("base"),
        F.when(is_text, F.col("score")).otherwise(n * tail).alias("score"),
    )
    out = found.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), *(F.sum(x).alias(x) for x in ("n_bytes", "n_tokens", "n_known", "base", "score")))
    n_bytes = F.col("n_bytes") + F.col("n_tokens")  # one blank or end behind each word
    return out.select("doc_id", "n_bytes", "n_tokens", "n_known", F.col("base").alias("base_score"), "score", (-F.col("score") / math.log10(2) / n_bytes).alias("bits_per_byte"))


def op2_context_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = id_crc() % 7 == 2
    model, counts = train(docs, trained=~held_out)
    out = score(docs, model, counts)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score", "bits_per_byte")
