import math
import zlib
from collections import Counter

import numpy as np
import pytest

from kotonoha.llm import context_mix as mix
from kotonoha.llm.common import id_crc, words


def test_huffman():
    counts = [50, 20, 20, 5, 1, 1]
    code = mix.Huffman(counts)
    paths = {tuple(code.bits[a : a + n].tolist()) for a, n in zip(code.start, code.length)}
    assert len(paths) == 6 and sum(2.0 ** -len(p) for p in paths) == 1.0 and code.length[0] == min(code.length)


def test_probabilities_sum_to_one():
    texts = [words(t) for t in (b"the cat sat", b"the dog sat on the mat", b"a cat and a dog", b"")] * 3
    seen = Counter(w for t in texts for w in t)
    head = [w for w, _ in seen.most_common(6)]
    n = sum(seen.values())
    model = mix.Model(head, [seen[w] for w in head], len(texts), n + len(texts), len(seen) + 1)
    bits = model.bits()
    model.word_counts = mix.tallied(bits, [[bits.symbols(t)] for t in texts])
    model.word_weights = mix.fitted(bits, model.word_counts, [[bits.symbols(t)] for t in texts])
    mixer = model.word_mixer()
    assert not np.allclose(mixer.weights, mix.START)
    for before in ([], [0], [1, 2]):
        logs = mixer.run([np.array([*before, s]) for s in range(bits.begin)], 0.0)
        first = mixer.run([np.array(before, int)], 0.0) if before else np.zeros(1)
        assert abs(np.exp(logs - first[0]).sum() - 1) < 1e-4


def test_blocks_do_not_look_ahead():
    texts = [[b"a", b"b"] * 200, [b"c"] * 30]
    model = mix.Model([b"a", b"b", b"c"], [200, 200, 30], 2, 432, 4)
    bits = model.bits()
    model.word_counts = mix.tallied(bits, [[bits.symbols(t) for t in texts]])
    model.word_weights = np.full((64, bits.K), mix.START)
    long = [bits.symbols(t) for t in texts]
    alone = [model.word_mixer().run([t], mix.RATE)[0] for t in long]
    assert np.allclose(model.word_mixer().run(long, mix.RATE), alone, rtol=1e-4)


def slot_of(h):
    return int(mix._slot(np.array([h & 0xFFFFFFFF], np.uint32))[0])


def slow_text(model, bits, text, rate):
    """log2 probability of a text without the spelling of its words outside the head, decision by decision, and those words."""
    code, begin = model.code, bits.begin
    found = text.encode().translate(mix.LOWER).split()
    symbols = [bits.ids.get(w, bits.escape) for w in found] + [bits.end]
    weights = model.word_weights.astype(np.float32).copy()
    log, errors = 0.0, []
    for at, s in enumerate(symbols):
        if at and at % mix.BLOCK == 0:
            moved = np.zeros(weights.shape)
            for gate in {g for g, _, _ in errors}:
                mine = [e * x for g, e, x in errors if g == gate]
                moved[gate] = rate / max(len(mine), 16) * sum(mine)
            weights, errors = weights + moved.astype(np.float32), []
        one = symbols[at - 1] if at else begin
        two = symbols[at - 2] if at > 1 else begin
        last = next((x for x in reversed(symbols[:at]) if x < mix.FREQUENT), begin)
        begins = [slot_of((one + 1) * 0x9E3779B1), slot_of((one * 0x27D4EB2F & 0xFFFFFFFF) ^ ((two + 7) * 0x165667B1 & 0xFFFFFFFF)), slot_of((last + 3) * 0xC2B2AE3D)]
        for k in range(code.start[s], code.start[s] + code.length[s]):
            slots = [code.nodes[k], *(b ^ code.places[k] for b in begins)]
            zeros, ones = ([float(c[2 * x + v]) for c, x in zip(model.word_counts, slots)] for v in (0, 1))
            x = np.clip([math.log((b + 0.4) / (a + 0.4)) for a, b in zip(zeros, ones)], -8, 8)
            level = [sum(a + b >= n for n in (1, 4, 32)) for a, b in zip(zeros, ones)]
            gate = level[1] * 16 + level[2] * 4 + level[3]
            p = 1 / (1 + math.exp(-float(np.clip(x @ weights[gate], -30, 30))))
            log += math.log2(p if code.bits[k] else 1 - p)
            errors.append((gate, code.bits[k] - p, x))
    return log, [w for w, s in zip(found, symbols) if s == bits.escape]


def sample_rows():
    rng = np.random.default_rng(5)
    pool = [f"w{int(x)}" for x in rng.zipf(1.6, 900)]
    line = lambda: " ".join(rng.choice(pool, rng.integers(1, 14)))
    rows = [(i, "\n".join(line() for _ in range(rng.integers(1, 7) if i % 5 else 30)), i % 4 != 0) for i in range(60)]
    return rows + [(100, "", True), (101, None, False), (102, "unheard-of w1\n \nW1", False), (103, rows[1][1], True), (104, rows[1][1], False), (105, "x" * 5000, False)]


def test_score_against_slow_version(spark, monkeypatch):
    monkeypatch.setattr(mix, "RARE", 1)
    rows = sample_rows()
    df = spark.createDataFrame(rows, "doc_id bigint, text string, train boolean").repartition(2)
    model, counts = mix.train(df, trained=mix.F.col("train"))
    bits = model.bits()
    got = {r.doc_id: r for r in mix.score(df, model, counts).collect()}
    seen = Counter(w for _, t, train in rows if train for w in words((t or "").encode()))
    spell = model.byte_mixer()
    new = (model.tail_types + 1) / (model.tail_tokens + model.tail_types + 1)
    for i, text, _ in rows:
        log, tail = slow_text(model, bits, text or "", mix.RATE)
        total = log * math.log10(2)
        for w in tail:
            letters = spell.run([w], 0.0)[0] / math.log(10)
            total += math.log10(seen[w] * (1 - new) / max(1, model.tail_tokens) + new * 10**letters) if seen[w] else math.log10(new) + letters
        assert got[i].score == pytest.approx(total, rel=2e-4), (i, text)
    assert got[103].score == got[104].score == got[1].score


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(mix, "RARE", 1)
    found = []
    for n in (1, 8):
        df = spark.createDataFrame(sample_rows(), "doc_id bigint, text string, train boolean").repartition(n)
        model, counts = mix.train(df, trained=mix.F.col("train"))
        found.append({r.doc_id: r.score for r in mix.score(df, model, counts).collect()})
    assert all(found[1][k] == pytest.approx(v, rel=1e-6) for k, v in found[0].items())


def test_weights_come_from_all_training_rows(spark, monkeypatch):
    """More texts and rare words than the sample had that weights once came from (2,000 and 20,000)."""
    monkeypatch.setattr(mix, "RARE", 1)
    df = spark.createDataFrame([(i, f"a b{i % 7} c{i % 50} {' '.join(f'x{i * 7 + k}' for k in range(7))} d{i % 3}", i % 50 != 0) for i in range(3200)], "doc_id bigint, text string, train boolean")
    model, counts = mix.train(df, trained=mix.F.col("train"))
    bits, head = model.bits(), set(model.head)
    fold = lambda *c: mix.F.pmod(mix.F.xxhash64(*c), mix.F.lit(mix.FOLDS)).alias("fold")
    texts = [(bits.symbols(words(r.text.encode())), r.fold) for r in df.filter("train").select("text", fold("doc_id", "text")).collect()]
    tails = [(bytes(r.word), r.fold) for r in counts.filter("c > 0").select("word", fold("word")).collect() if bytes(r.word) not in head]
    assert len(texts) == 3136 and len(tails) == 7 * 3136
    for of, items, total, weights in ((bits, texts, model.word_counts, model.word_weights), (mix.ByteBits(), tails, model.byte_counts, model.byte_weights)):
        parts = [[[x for x, f in items if f == k]] for k in range(mix.FOLDS)]
        counted = [mix.tallied(of, p) for p in parts]
        assert all(np.array_equal(sum(c), t) for c, t in zip(zip(*counted), total))
        found = sum(mix.cells(of, mix.coded([t - c for t, c in zip(total, counted[k])]), parts[k]).astype(int) for k in range(mix.FOLDS))
        assert found.sum() == sum(len(of.decisions(p[0])[1]) for p in parts)
        cell = np.flatnonzero(found)
        assert np.allclose(mix.learnt(cell, found[cell], of.K), weights, atol=1e-5) and not np.allclose(weights, mix.START)


def test_learnt_weights_lose_least():
    """Against plain descent over single decisions, whose predictions are the bins' own."""
    rng = np.random.default_rng(3)
    cell = np.unique(rng.integers(0, 32, 60) << 18 | 40 << 12 | 50 << 6 | rng.integers(32, 64, 60))
    n = rng.integers(1, 2000, len(cell))
    got = mix.learnt(cell, n, 4)
    x = np.stack([mix._BINS[(cell >> 18) + 32], mix._BINS[np.full(len(cell), 40)], mix._BINS[np.full(len(cell), 50)], mix._BINS[cell & 63]], axis=1)
    loss = lambda w: (n * np.log1p(np.exp(-(x @ w)))).sum() + mix.PULL / 2 * ((w - mix.START) ** 2).sum()
    best = loss(got[63])
    assert best < loss(np.full(4, mix.START))
    assert all(best <= loss(got[63] + d) for d in np.vstack([np.eye(4), -np.eye(4)]) * 1e-3)
    assert np.allclose(got[:63], mix.START)


def test_probabilities_of_texts_make_one_at_most(spark, monkeypatch):
    """All texts of up to four of three words, seen and unseen ones; different line breaks are the same words."""
    monkeypatch.setattr(mix, "RARE", 0)
    import itertools

    learnt = spark.createDataFrame([(i, " ".join(["w0", "w1"][: 1 + i % 2] * (1 + i % 3)), True) for i in range(160)], "doc_id bigint, text string, train boolean")
    every = [" ".join(x) for n in range(6) for x in itertools.product(["w0", "w1", "zz"], repeat=n)]
    df = spark.createDataFrame([*enumerate(every), (-1, "w0 w1\nw0 w1"), (-2, "w0\n\nw1 w0 w1")], "doc_id bigint, text string")
    model, counts = mix.train(learnt)
    got = {r.doc_id: r.score for r in mix.score(df, model, mix.covered(counts, df)).collect()}
    total = sum(10.0**v for k, v in got.items() if k >= 0)
    assert 0.3 < total <= 1 + 1e-6
    assert got[-1] == got[-2] == got[every.index("w0 w1 w0 w1")]


@pytest.fixture(scope="module")
def table(spark):
    return mix.op2_context_mix(spark, "/root/testdata/sf0.1").collect()


def test_base_score(spark, table):
    texts = {r.doc_id: words(r.text.encode()) for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    seen = Counter(w for i, t in texts.items() if not held[i] for w in t)
    docs = sum(not h for h in held.values())
    total, types = sum(seen.values()) + docs, len(seen) + 1
    assert len(table) == len(texts)
    for r in table:
        found = texts[r.doc_id]
        want = sum(math.log10((seen[w] + 1) / (total + types + 1)) for w in found) + math.log10((docs + 1) / (total + types + 1))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(found) + 1, 1 + sum(seen[w] > 0 for w in found), total)
        assert abs(r.base_score - want) < 1e-6 * abs(want)


def test_better_than_base(table):
    held = [r for r in table if r.held_out]
    print(sum(r.score for r in held), sum(r.base_score for r in held))
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score < 0 for r in table)


def test_edges(spark):
    rows = [(1, "a b c", 5), (2, None, 5), (3, "", 5), (None, "a zzz " * 3000, 5), (5, "a b c", 5), (5, "a b c", 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n int")
    for train in (df, df.limit(0)):
        model, counts = mix.train(train)
        counts = mix.covered(counts, df)
        got = mix.score(df, model, counts).collect()
        assert len(got) == 6 and {r.n_tokens for r in got} == {4, 1, 6001}
        assert all(np.isfinite(r.score) and np.isfinite(r.base_score) for r in got)
        assert len({r.score for r in got if r.doc_id in (1, 5)}) == 1
    assert mix.score(df.limit(0), model, counts).count() == 0
    assert df.filter(id_crc() >= 0).count() == 6


def test_outcomes_by_depth():
    """Outcomes come level by level, none longer than the symbols, with the slots and bits of decisions(); predictions() tell what those slots hold."""
    head = [b"a", b"b", b"c", b"d", b"e"]
    bits = mix.WordBits(head, mix.Huffman([16, 8, 4, 2, 1, 3, 1]))
    texts = [bits.symbols([b"a", b"b", b"x", b"e", b"a"] * 40), bits.symbols([]), bits.symbols([b"d", b"c"])]
    parts = list(bits.outcomes(texts))
    slots, bit, item, ends = bits.decisions(texts)
    assert len(parts) == bits.code.length.max() and len(parts[0][0]) == sum(map(len, texts))
    for k, at in enumerate(slots):
        assert np.array_equal(np.sort(np.concatenate([p[k] for p in parts])), np.sort(at << 1 | bit))
    known = [np.random.default_rng(k).random(n).astype(np.float32) for k, n in enumerate(bits.sizes)]
    x, sign, item2, ends2 = bits.predictions(texts, bits.predicting(known))
    assert np.array_equal(sign, 1 - 2 * bit) and np.array_equal(item, item2) and np.array_equal(ends, ends2)
    assert all(np.array_equal(a, t[at]) for a, t, at in zip(x, known, slots))
