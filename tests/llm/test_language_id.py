import math
import time
from collections import Counter, defaultdict

import numpy as np

from kotonoha.llm import language_id as lid


def brute(pages, texts):
    """The fused posteriors by plain dictionaries, with exact trigram bins."""
    counts, n_texts = defaultdict(lambda: np.full(lid.SLOTS, 0.5)), Counter()
    for t, lang in texts:
        np.add.at(counts[lang], lid.bins((t or "").encode()), 1)
        n_texts[lang] += 1
    names = sorted(counts)
    log_p = np.array([np.log(counts[n] / counts[n].sum()) for n in names]).astype(np.float32)
    share = np.array([(n_texts[n] + 1) / (len(texts) + len(names)) for n in names])
    rows = []
    for i, url, html in pages:
        host = lid.host_of(url or "")
        logs = log_p[:, lid.bins(lid.visible(html or "").encode())].sum(axis=1, dtype=np.float64) * lid.TEMPER
        p = share * np.exp(logs - logs.max())
        rows.append((i, [host.split(".")[-1], ".".join(host.split(".")[-2:]), host], lid.declared(html or ""), logs, p / p.sum()))
    kinds = len({d for _, _, d, _, _ in rows if d})
    out = {}
    for i, groups, said, logs, p in rows:
        others = [r for r in rows if r[0] != i]
        prior = (sum((r[4] for r in others), 0 * share) + lid.SMOOTH * share) / (len(others) + lid.SMOOTH)
        for k, g in enumerate(groups):
            same = [r for r in others if r[1][k] == g]
            prior = (sum((r[4] for r in same), 0 * share) + lid.SMOOTH * prior) / (len(same) + lid.SMOOTH)
        final = logs + np.log(prior)
        if said:
            final += np.log((sum((r[4] for r in others if r[2] == said), 0 * share) + 1) / (sum((r[4] for r in others if r[2]), 0 * share) + kinds))
        best = int(np.argmax(final))
        out[i] = (names[best], 1 / np.exp(final - final[best]).sum())
    return out


def test_parts():
    assert lid.visible("<p>a<script>x</script>b<!-- c --><style>d</style>e</p>").split() == ["a", "b", "e"]
    assert lid.declared('<HTML class=x LANG="de-AT">') == "de" and lid.declared("<p lang=fr>") is None
    assert lid.host_of("https://u:p@A.Example.org:80/x") == "a.example.org" and lid.host_of("nonsense") == ""


def test_long_pages_in_one_pass():
    began = time.process_time()
    for page in ("<script>" * 130_000, "<" * 1_000_000, "<!--" * 250_000, "<style>a" * 100_000 + "</style>b", "<html" * 200_000, "<html lang=" * 90_000, "</script" + " " * 1_000_000):
        lid.visible(page)
        lid.declared(page)
    assert time.process_time() - began < 10
    assert lid.visible("a<script>b<p>c").split() == ["a", "b", "c"] and lid.visible("x <y") == "x <y" and lid.visible("<!--a<p>b").split() == ["b"]
    assert lid.visible("<SCRIPT>a</script  >b<style>c</style>d<script>e").split() == ["b", "d", "e"]
    assert lid.declared("<html><html lang=fr>") == "fr" and lid.declared("<html x lang='sv-SE'") == "sv"


def test_against_brute_force(spark):
    texts = [("the cat and the dog", "en"), ("the house of the man", "en"), ("der hund und die katze", "de"), ("das haus und der mann", "de"), (None, "en"), ("unlabelled", None)]
    pages = [(k, f"http://h{k % 3}.x{k % 2}.{'de' if k % 2 else 'com'}/p", f"<html lang={'de' if k % 2 else 'en'}><p>{'der mann und das' if k % 2 else 'the man of the'} {k}</p>") for k in range(12)]
    pages += [(20, "http://h1.x1.de/", "<html lang=en></html>"), (21, None, None), (22, "http://h0.x0.com", ""), (23, "bad", "<p>und der und die</p>")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id bigint, url string, html string, lang string")
    labelled = spark.createDataFrame(texts, "text string, lang string")
    got = {r.page_id: (r.lang, r.probability) for r in lid.identify(df, labelled).collect()}
    want = brute(pages, [t for t in texts if t[1]])
    assert got.keys() == want.keys()
    for i, (lang, p) in want.items():
        assert got[i][0] == lang and math.isclose(got[i][1], p, rel_tol=1e-6)
    assert got[20][0] == "de"
    assert {r.lang for r in lid.identify(df, labelled.limit(0)).collect()} == {None}
    assert lid.identify(df.limit(0), labelled).count() == 0
    twice = lid.identify(df.unionAll(spark.createDataFrame([(None, None, None, None)], df.schema)).unionAll(df), labelled)
    assert twice.count() == 2 * len(pages) + 1


def test_held_out_accuracy(spark):
    """Texts of the table as pages without any other evidence."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang is not null and length(text) > 50")
    names, log_p, shares = lid.likelihoods(docs.filter("doc_id % 2 = 0"))
    pages = docs.filter("doc_id % 2 = 1").selectExpr("doc_id as page_id", "cast(null as string) as url", "text as html")
    found = lid.fuse(lid.evidence(pages, names, log_p), names, shares).join(docs.selectExpr("doc_id as page_id", "lang as truth"), "page_id").collect()
    assert sum(r.lang == r.truth for r in found) >= 0.98 * len(found)


def test_table(spark):
    got = lid.op1_language_id(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == 250 and sum(r.lang == r.declared for r in got) > 150


def test_blanks_in_attributes():
    began = time.process_time()
    blanks = " " * 1_000_000
    assert lid.declared(f"<html lang={blanks}>") is None and lid.declared(f"<html lang{blanks}={blanks}'{blanks}fr'>") == "fr"
    assert lid.declared("<html " + f"lang= {' ' * 50}" * 20_000 + ">") is None
    assert lid.declared('<html lang = " DE ">') == "de"
    assert time.process_time() - began < 3
