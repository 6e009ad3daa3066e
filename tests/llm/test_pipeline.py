import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken
from test_line_dedup import brute, cleaned
from test_simhash import brute_components, brute_print

import corpus_pipeline
from kotonoha.llm import byte_bpe, decontaminate, toxicity


def test_run_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{d}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in table.orderBy("doc_id").collect()]
    model = toxicity.fit(table, spark.read.parquet(f"{d}/labels.parquet"))
    scorer, kept = toxicity.Scorer(model), []
    for i, t in docs:
        listed, n = scorer.listed(t.encode())
        if model.probability(model.evidence(toxicity.segments(listed, n), n)) < 0.5:
            kept.append((i, t))
    assert len(kept) < len(docs)
    gone, left = brute(kept, 50), []
    for k, (i, t) in enumerate(kept):
        n = sum(1 for line in t.split("\n") if line.encode().split())
        if not gone[k] or len(gone[k]) < n:
            left.append((i, cleaned(t, gone[k]) if gone[k] else t))
    label = brute_components([(i, brute_print(t)) for i, t in left])
    left = [(i, t) for i, t in left if label[i] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    index = decontaminate.Index(items, decontaminate.MIN_MATCH)
    left = [(i, t) for i, t in left if not index.matches(t.encode(), decontaminate.COVERAGE)]
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = {i: (hashlib.sha256(np.array(library.encode_ordinary(t), "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in left}
    got = corpus_pipeline.run(spark, d).collect()
    assert len(got) == len(want) < len(docs) and {r.doc_id: (r.ids_sha256, r.decoded_sha256) for r in got} == want


def test_stage_edges(spark):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(1, text, "en", "s", 9), (2, text, "en", "s", 9), (1, text, "en", "s", 9), (None, "other words", "en", "s", 9), (4, None, None, None, None), (5, "", "en", "s", 0), (6, text + " more", "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    d = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES:
        for df in (docs, docs.limit(0)):
            out = stage(spark, df, d)
            out.collect()
            assert name == "bpe" or out.columns == docs.columns
    left = [r.doc_id for r in corpus_pipeline.drop_copies(spark, docs, d).collect()]
    assert left.count(1) == left.count(None) == left.count(4) == 1 and 2 not in left and 5 not in left
    left = corpus_pipeline.cut_lines(spark, docs, d)
    assert sorted(str(r.doc_id) for r in left.collect()) == ["1", "1", "4", "5", "6", "None"]
