"""Spelling variants against brute force over all pairs."""

import re
import zlib
from collections import Counter

import numpy as np

from kotonoha.llm import spelling
from kotonoha.llm.spelling import op12_spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def counted(rows, damage=31, least=7):
    n = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= least and k >= 2}


def is_near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words):
    near = {w: [] for w in words}
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    for w in words:
        near[w] = [v for k in (-1, 0, 1) for v in by_length.get(len(w) + k, []) if is_near(w, v)]
    form = {}
    for w, vs in near.items():
        if vs:
            best = min(vs, key=lambda v: (-words[v], v))
            if words[best] >= 10 * words[w]:
                form[w] = best
    out = set()
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, words[w], len(near[w]), words[form[w]] if w in form else None))
    return out


def rows_of(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    words = counted([(r.doc_id, r.text) for r in docs])
    out = op12_spelling(spark, sf)
    assert out.count() == len(words) > 500
    assert rows_of(out) == brute(words)


def test_chains_ties_and_repeated_letters(spark):
    texts = ["colours " * 3000, "colourss " * 300, "colourrss " * 30, "colourrsss " * 3, "aaaaaaa aaaaaaaa " * 2, "bbbbbbba bbbbbbba bbbbbbbc bbbbbbbc " + "bbbbbbbd " * 40 + "bbbbbbbe " * 40, "étécole Étécole " * 2, "x×÷abcde " * 2, "œuvretotal аbcdefgh " * 2]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = spelling.variants(spelling.word_counts(docs, damage=0))
    assert rows_of(found) == brute(counted(enumerate(texts), damage=0))
    by = {r.word: r for r in found.collect()}
    assert by["colourrsss"].root == "colours" and by["colourrsss"].form == "colourrss"
    assert by["bbbbbbba"].form == "bbbbbbbd" and by["bbbbbbba"].n_near == 3
    assert by["aaaaaaa"].n_near == by["aaaaaaaa"].n_near == 1
    assert "x×÷abcde" in by and "uvretotal" in by and "bcdefgh" in by


def test_odd_rows(spark):
    schema = "doc_id bigint, text string, word string, n string"
    docs = spark.createDataFrame([(None, "variant variant variants", "a", "b"), (1, None, None, None), (2, "", "", ""), (3, "variants", "", ""), (3, "variants", "", "")], schema)
    rows = [(None, "variant variant variants"), (3, "variants"), (3, "variants")]
    assert rows_of(spelling.variants(spelling.word_counts(docs))) == brute(counted(rows))
    assert spelling.variants(spelling.word_counts(docs.limit(0))).count() == 0


def test_very_long_word(spark):
    long = "abcdefghij" * 3000
    docs = spark.createDataFrame([(1, f"{long} {long} {long[:15000]}x{long[15000:]} {long[:15000]}x{long[15000:]}")], "doc_id int, text string")
    got = rows_of(spelling.variants(spelling.word_counts(docs, damage=0)))
    assert {(len(w), k) for w, _, _, _, k, _ in got} == {(30000, 1), (30001, 1)}


def test_keys_of_deletions():
    words = [b"abcab", b"abab", b"abccab", b"z"]
    key, owner, place, first = spelling.deletion_keys(words)
    by = {(words[o], p): k for o, p, k in zip(owner.tolist(), place.tolist(), key.tolist())}
    assert by[b"abcab", 2] == by[b"abab", -1] and by[b"abccab", 2] == by[b"abccab", 3] == by[b"abcab", -1]
    assert by[b"abcab", 1] != by[b"abab", -1]
    assert not first[(owner == 2) & (place == 3)].any()


def test_collisions_of_hashes_give_no_result(spark, monkeypatch):
    """All keys the same: every pair is a candidate, and only real ones are left."""
    words = spark.createDataFrame([("abcdefg", 20), ("abcdefh", 2), ("xbcdefgy", 2), ("abcdefgg", 2)], "word string, n bigint")
    real = spelling.deletion_keys

    def same(found):
        key, *rest = real(found)
        return (np.zeros_like(key), *rest)

    code = spelling._keys.__globals__
    monkeypatch.setitem(code, "deletion_keys", same)
    got = {(r.word, r.other) for r in spelling.near_words(words).collect()}
    assert got == {("abcdefg", "abcdefh"), ("abcdefh", "abcdefg"), ("abcdefg", "abcdefgg"), ("abcdefgg", "abcdefg")}
