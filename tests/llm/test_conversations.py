"""Repair of conversations against a search over all edits."""

import hashlib
import heapq
import random
import re
import time
import zlib

from kotonoha.llm import conversations
from kotonoha.llm.conversations import op13_conversations

GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def slow(rows):
    """Counts, cost, audit and repaired lines of rows (turn, role, text) in order, by a search in order of (cost, audit)."""
    seen, faults = set(), []
    for _, role, text in rows:
        last = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, roles, lines = heapq.heappop(heap)
        if at == len(rows) and GRAMMAR.match(roles):
            break
        state = (at, roles[-1:], len(roles) == 1 and roles == "s")
        if state in done:
            continue
        done.add(state)
        moves = []
        if at < len(rows):
            _, role, text = rows[at]
            more = 5 if faults[at] == "truncated" else 0
            moves.append((2, "D", 1, None))
            if faults[at] not in ("blank", "duplicate"):
                moves += [(more, "K", 1, (role[:1], f"{role}:{text}"))] + [(more + 1, "R", 1, (r[0], f"{r}:{text}")) for r in ("user", "assistant")]
        moves += [(5, "I", 0, (r[0], f"{r}:")) for r in ("user", "assistant")]
        for c, letter, step, line in moves:
            if line is not None and not (line[0] == "s" and not roles or line[0] == "u" and roles[-1:] in ("", "s", "a") or line[0] == "a" and roles[-1:] == "u"):
                continue
            heapq.heappush(heap, (cost + c, audit + letter, at + step, roles + (line[0] if line else ""), lines + ((line[1],) if line else ())))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        mine = out.setdefault(conv, [])
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h:
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            mine += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest())
    return {k: sorted(v, key=order) for k, v in out.items()}


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def found(df):
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in df.collect()}


def test_query_against_search(spark):
    sf = "/root/testdata/sf0.01"
    given = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(op13_conversations(spark, sf)) == {k: slow(v) for k, v in damaged(given).items()}


def test_odd_conversations(spark, tmp_path):
    rng = random.Random(3)
    texts = ["Well.", "", " ", "\t\n", "cut", "Yes! ", None, "é", "a. ", "same.", "same."]
    roles = ["system", "user", "assistant", "tool", "", None, "User", "s"]
    rows = [(c, rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts), "x", 1) for c in [*range(60), None] for _ in range(rng.randrange(1, 9))]
    rows += rows[:20]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, audit string, copy int").write.parquet(f"{tmp_path}/conversations.parquet")
    assert found(op13_conversations(spark, str(tmp_path))) == {k: slow(v) for k, v in damaged([r[:4] for r in rows]).items()}


def test_all_dropped_and_empty(spark, tmp_path):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id bigint, turn bigint, role string, text string")
    df.write.parquet(f"{tmp_path}/a/conversations.parquet")
    df.limit(0).write.parquet(f"{tmp_path}/b/conversations.parquet")
    assert found(op13_conversations(spark, f"{tmp_path}/a")) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}
    assert found(op13_conversations(spark, f"{tmp_path}/b")) == {}


def test_audit_against_search_on_random_codes():
    rng = random.Random(1)
    names = ["tool", "system", "user", "assistant"]
    for _ in range(400):
        rows, codes = [], []
        for k in range(rng.randrange(0, 9)):
            initial, kind = rng.randrange(4), rng.choice((0, 0, 0, conversations.MUST_GO, conversations.CUT))
            rows.append((k, names[initial], "" if kind == conversations.MUST_GO else f"{k}" if kind else f"{k}."))
            codes.append(initial | kind)
        assert conversations.audit(bytes(codes)) == (slow(rows)[5], slow(rows)[6].encode())


def test_long_conversation_takes_linear_time():
    rng = random.Random(2)
    times = []
    for n in (50_000, 200_000):
        codes = bytes(rng.choice((0, 1, 2, 3, 6, 7, 10, 11)) for _ in range(n))
        began = time.time()
        cost, audit = conversations.audit(codes)
        times.append(time.time() - began)
        assert cost > n / 4 and len(audit) >= n
    assert times[1] < 8 * times[0] + 1


def test_repaired_turns_are_legal_and_hash_to_the_digest(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    out = conversations.repair(conversations.damaged(given)).collect()
    turns, summaries = {}, {}
    for r in out:
        if r.ord is None:
            summaries[r.conv_id] = r.summary
        else:
            turns.setdefault(r.conv_id, []).append(r)
    assert len(summaries) > 90
    for k, s in summaries.items():
        mine = sorted(turns.get(k, []), key=lambda r: r.ord)
        assert GRAMMAR.match("".join(r.role[:1] for r in mine))
        assert "".join(r.edit for r in mine) == s.audit.replace("D", "")
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in mine).encode()).hexdigest() == s.repaired_sha256
