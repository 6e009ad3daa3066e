import hashlib
import math
import random
import re
from collections import Counter

from kotonoha.llm import secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute_base(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def plain(s):
    if re.fullmatch("[A-Za-z_=+/-]+|[0-9_=+/-]+", s):
        return True
    head, *rest = re.split("[/_-]", s)
    return bool(rest) and re.fullmatch("[A-Za-z]+", head) is not None and all(re.fullmatch("[A-Za-z]{1,12}|[0-9]{1,12}", p) for p in rest)


def brute_entropy(text, base):
    left = list(text)
    for a, _, b in base:
        left[a:b] = " " * (b - a)
    out = []
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", "".join(left)):
        s, w = m[0], secrets.WINDOW
        if plain(s):
            continue
        limit = next(t for p, t in secrets.CLASSES if re.search(p, s))
        hits = [i for i in range(len(s) - w + 1) if -sum(c / w * math.log2(c / w) for c in Counter(s[i : i + w]).values()) >= limit - 1e-9]
        if hits and not re.search("example|placeholder|changeme|dummy|sample|your_|xxxx", s[hits[0] : hits[-1] + w], re.I):
            out.append((m.start() + hits[0], 3, m.start() + hits[-1] + w))
    return out


def written_as(spans):
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def texts():
    rng = random.Random(4)
    parts = ["token", "Secret", "api_key", "APIKEY", "PASSWORD", "passwd", '"', "'", " ", "  ", ":", "=", "abc", "abcdef12", "AKIA", "ABCDEFGH23456789", "0123456789abcdef" * 2, "é", "𠀀", "\n", "zQ9/xK2+vB7_mN4-pL6", "example", "aaaaaaaaaaaaaaaaaaaaaaa1", ".", "x", "1", "ſecret", "toKen="]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 30))) for _ in range(400)]
    return [None, "", "secret:token:abcdef12", "token = \"5d190bd7c06284de91015a36974748794293dd8a\"", "a" * 50_000 + "1", "token=abcdefg " * 2000, "AKIA" * 12, *made]


def test_against_brute_force(spark):
    rows = [(i, t, 1) for i, t in enumerate(texts())] + [(None, "token=abcdef", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, base int")
    got = {r.doc_id: r for r in secrets.find_secrets(df).select("doc_id", secrets.joined(secrets.F.col("base")).alias("b"), secrets.joined(secrets.F.col("entropy")).alias("e")).collect()}
    for i, t, _ in rows:
        base = brute_base(t or "")
        assert got[i].b == written_as(base), t
        assert got[i].e == written_as(brute_entropy(t or "", base)), t
    assert secrets.find_secrets(df.limit(0)).count() == 0


def test_long_candidates(spark):
    rng = random.Random(8)
    blob = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(200_000))
    rows = [(1, blob), (2, "key AKIA" + "A1B2C3D4E5F6G7H8" + "/" + blob[:40] + " end"), (3, (blob[:24] + " token=abcdefg ") * 5000), (4, "a/" * 50_000 + "x1")]
    got = {r.doc_id: r for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id", secrets.joined(secrets.F.col("base")).alias("b"), secrets.joined(secrets.F.col("entropy")).alias("e")).collect()}
    for i, t in rows:
        base = brute_base(t)
        assert got[i].b == written_as(base) and got[i].e == written_as(brute_entropy(t, base))
    assert got[2].e.startswith("entropy:") and got[3].e.count("entropy") == 5000


def test_table(spark):
    d = "/root/testdata/sf0.01"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = secrets.op8_secrets(spark, d).collect()
    assert len(got) == len(text)
    for r in got:
        base = brute_base(text[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, k, _ in base) for j in range(3))
        assert r.base_sha256 == hashlib.sha256(written_as(base).encode()).hexdigest()
        assert r.spans == written_as(base + brute_entropy(text[r.doc_id], base))
