import random

import numpy as np
import xxhash

from kotonoha.llm import simhash


def brute_print(text):
    found = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    grams = [" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))] if found else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    label = {i: i for i, _ in prints}
    changed = True
    while changed:
        changed = False
        for i, x in prints:
            for j, y in prints:
                if (x ^ y).bit_count() <= 2 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def test_fingerprint():
    for text in ("", " \n\t ", "One", "one two", "One two THREE", "é à ü " * 9, "a b c d e f g\x0bh\x0ci", "x" * 9999, "a b \x1c c"):
        assert simhash.fingerprint(text.encode()) == brute_print(text)


def test_pairs_and_forest():
    rng = np.random.default_rng(1)
    fp = np.unique(rng.integers(0, 1 << 9, 300, dtype=np.uint64))
    unit = np.sort(rng.integers(0, 5, len(fp)))
    i, j = simhash.close_pairs(unit, fp)
    got = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())}
    want = {(a, b) for a in range(len(fp)) for b in range(a + 1, len(fp)) if unit[a] == unit[b] and int(fp[a] ^ fp[b]).bit_count() <= 2}
    assert got == want and len(i) == len(got)


def test_links_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 8)
    rng = random.Random(3)
    prints = []
    for k in range(60):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 9, 40]) if k else 150):
            prints.append(x)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                x ^= 1 << rng.randrange(64)
    prints = sorted(set(prints))
    signed = [(np.uint64(x).astype(np.int64).item(),) for x in prints]
    from kotonoha.llm.components import components

    got = {r.node: r.root for r in components(simhash.links(spark.createDataFrame(signed, "fp bigint"))).collect()}
    label = brute_components([(s[0], x) for s, x in zip(signed, prints)])
    assert {s[0]: got.get(s[0], s[0]) for s in signed} == label


def test_query(spark):
    base = "the quick brown fox jumps over the lazy dog and runs away from " * 4
    rows = [(7, base, 0), (3, base.upper(), 0), (5, None, 0), (9, " \n", 0), (1, "unrelated words here", 0), (None, base, 1), (8, "Z", 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, fp int")
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert len(got) == 7 and got[7][1] == got[3][1] == got[None][1] == 3 and got[5] == got[9] == (0, 5) and got[1][1] == 1
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_table(spark):
    got = simhash.op10_simhash(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    prints = [(i, brute_print(t)) for i, t in texts.items()]
    label = brute_components(prints)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{x:016x}", label[i]) for i, x in prints}
