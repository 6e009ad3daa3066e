import random
import time

from kotonoha.llm import decontaminate as dec


def brute_tiles(item, text, least):
    """Greedy string tiling by its definition."""
    a, b, out = [False] * len(item), [False] * len(text), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for t in range(len(text)):
                n = 0
                while i + n < len(item) and t + n < len(text) and item[i + n] == text[t + n] and not a[i + n] and not b[t + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, t)
        n, i, t = best
        if n < least:
            return sorted(out)
        out.append((i, t, n))
        a[i : i + n] = [True] * n
        b[t : t + n] = [True] * n


def test_tiling():
    rng = random.Random(2)
    for _ in range(300):
        item = " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 14)))
        text = " ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 25)))
        got = dec.Index([(1, item)], 2).matches(text.encode(), 0.0)
        want = brute_tiles(item.split(), text.split(), 2)
        assert (got[0][2] if got else []) == want


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def test_pairs(spark):
    halves = ITEM.split()
    rows = [
        (1, f"x y {ITEM} z", 9), (2, " ".join(halves[6:] + ["and"] + halves[:6]).upper(), 9), (3, " ".join(halves[:6]), 9), (4, None, 9), (5, "", 9),
        (None, ITEM.replace(" ", ", "), 9), (7, "word " * 30_000 + ITEM, 9), (8, "unrelated text", 9), (9, f"{ITEM} {ITEM}", 9),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([(10, ITEM, 1), (11, None, 1), (12, "", 1), (13, "too short", 1), (14, ITEM, 2), (None, "something else that no text here has", 3)], "item_id bigint, text string, doc_id int")
    for block in (2_000_000, 40):
        got = dec.contaminated(df, items, block=block).collect()
        assert sorted((r.doc_id or 0, r.item_id) for r in got) == sorted((d, i) for d in (0, 1, 2, 7, 9) for i in (10, 14))
        assert all(r.coverage == 1.0 for r in got)
    assert dec.contaminated(df.limit(0), items).count() == 0 and dec.contaminated(df, items.limit(0)).count() == 0


def test_tokens():
    cut = lambda t: [w.decode() for w in dec.tokens(t.encode())]
    assert cut("“Don’t”—stop\u3000NOW… Élan naïve_x") == ["don", "t", "stop", "now", "Élan", "naïve", "x"]
    assert cut("東京は、ラーメンabcがﾊﾟ。") == [*"東京はラーメン", "abc", *"がﾊﾟ"]
    assert cut("नमस्ते दुनिया।") == ["नमस्ते", "दुनिया"] and cut("。、\u3000") == [] and cut("") == []


def test_short_and_unspaced(spark):
    """Items of few tokens are matched whole, and items inside longer runs without blanks are found."""
    rows = [(1, "Too short"), (2, "it is too short, too short."), (3, "too very short"), (4, "昔々、国の長いトンネルを抜けると雪国であったそうだ"), (5, "国の長い話"), (6, "“alpha”—beta—gamma—‘delta’"), (7, "yes"), (8, "答え。")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    items = [(10, "too short"), (11, "長いトンネルを抜けると雪国であった。"), (12, "alpha beta gamma delta"), (13, "Yes!"), (14, "答え"), (15, "too short"), (16, "…")]
    got = dec.contaminated(df, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 10), (1, 15), (2, 10), (2, 15), (4, 11), (6, 12), (7, 13), (8, 14)]
    assert all(r.coverage == 1.0 for r in got)
    assert [(t.item_start, t.text_start, t.length) for r in got if (r.doc_id, r.item_id) == (2, 10) for t in r.tiles] == [(0, 2, 2)]


def test_table(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, dec.tokens(r.text.encode())) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    items = [(r.item_id, dec.tokens(r.text.encode())) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): r.covered for r in dec.op6_decontaminate(spark, d).collect()}
    whole = {(i, k) for i, words in docs for k, item in items if b" " + b" ".join(item) + b" " in b" " + b" ".join(words) + b" "}
    assert whole and whole <= got.keys()
    for (i, k), n in got.items():
        if len(dict(docs)[i]) < 400:
            assert sum(x for _, _, x in brute_tiles(dict(items)[k], dict(docs)[i], dec.MIN_MATCH)) == n


def test_repeated_words_and_other_ids(spark):
    text, item = "a " * 40_000, "a " * 60
    began = time.process_time()
    index = dec.Index([(0, item), (1, "b " + item)], dec.MIN_MATCH, short=True)
    found = {k: n for k, n, _ in index.matches(text.encode(), dec.COVERAGE)}
    assert found == {0: 60, 1: 60} and time.process_time() - began < 20
    df = spark.createDataFrame([(1, "x the quick brown fox jumps over y"), (2, "nothing")], "doc_id bigint, text string")
    bench = spark.createDataFrame([((7, "q"), "the quick brown fox jumps"), (None, "the quick brown fox jumps over")], "item_id struct<a: int, b: string>, text string")
    assert sorted(str(r.item_id) for r in dec.contaminated(df, bench).collect()) == ["None", "Row(a=7, b='q')"]


def test_equal_tokens_take_linear_time():
    """10,000 equal tokens in 100,000."""
    index = dec.Index([(0, "a " * 10_000)], dec.MIN_MATCH)
    for text, want in (("a " * 100_000, [(0, 0, 10_000)]), ("x " + "a " * 99_999, [(0, 1, 10_000)])):
        began = time.process_time()
        found = index.matches(text.encode(), dec.COVERAGE)
        assert found[0][2] == want and time.process_time() - began < 5


def test_tiling_from_all_seeds():
    """Runs of few different tokens, from every pair of equal windows."""
    rng = random.Random(8)
    for _ in range(200):
        item, text = ([rng.choice((1, 1, 1, 2)) for _ in range(rng.randrange(3, 30))] for _ in range(2))
        seeds = [(i, t) for i in range(len(item) - 2) for t in range(len(text) - 2) if item[i : i + 3] == text[t : t + 3]]
        rng.shuffle(seeds)
        assert dec.tiles(dec.np.array(item), dec.np.array(text), seeds, 3) == brute_tiles(item, text, 3)


def test_repeated_items_in_blocks(spark):
    df = spark.createDataFrame([(1, ITEM), (1, ITEM)], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, ITEM)] * 3 + [(None, ITEM), (8, "other words that stand in no text at all")], "item_id bigint, text string")
    for block in (2_000_000, 10):
        got = dec.contaminated(df, items, block=block).groupBy("item_id").count().collect()
        assert {(r.item_id, r["count"]) for r in got} == {(7, 6), (None, 2)}
