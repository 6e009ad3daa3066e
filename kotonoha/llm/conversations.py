"""Operator 13: repair of the turn structure of conversations by cost layers.

The grammar of role initials is (s?(ua)+)?, with four states: 0 nothing yet, 1 after s, 2 after u, 3 after a; 0
and 3 accept. Edits: Keep (0), Rerole to the role that the state wants, user or assistant (1), Delete (2; the only
edit of blank and duplicate rows), Insert an empty turn of the role that the state wants (5). Truncated rows that stay cost 5 more.

Layers: for each turn, from the last one back, a bitset of the four states for each increasing cost, all of them in one word of 64
bits: bit s of layer k is set if the conversation can be ended from state s at a cost of k above the turn's least.
An edit is a shift of the whole word by its cost, a change of state a shift within the layers, as in Wu
and Manber's matching with errors. From any state any other one is made up for at a cost of 12 or less (two
inserts and a deletion), so 16 layers above the least cost hold all that matters and a conversation costs time in
proportion to its turns, however many faults it has. The first layer that holds state 0 at the first turn gives the cost. The least audit follows
the bits from the first turn on: the first of D, I, K, R that stays within the cost left. Each state has one
role to rerole to or insert, so the audit also fixes the roles.

Rows are streamed: each conversation's rows come sorted to one task twice, first without their texts (a byte for each turn is
kept, and nine bytes of layers), then with them, and are written out one by one with the edit of each; texts are never
gathered. Whether a role and text was seen earlier is found by aggregation and a join, not in a group. What one conversation makes stays one
stream, as its digest is one pass over its repaired text.

Defined results: a null role or text is one space, a null turn comes first and is no number for gaps; rows of one turn
stand in order of role and of their text's hash, repeated rows side by side; a role is judged by its first letter, as it is written; a null
conversation is one of its own; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from array import array

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
LAYERS = 16
_ALL = (1 << 64) - 1
#: The bit of each state in every layer.
_S0, _S1, _S2, _S3 = (sum(1 << (4 * k + s) for k in range(LAYERS)) for s in range(4))
#: The state that a rerole or an insert leads to, and the role it has.
WANTED, ROLE = (2, 2, 3, 2), {2: "user", 3: "assistant"}
#: Initials as the low bits of a turn's code; what may be done with it as the next ones.
INITIALS = {"s": 1, "u": 2, "a": 3}
MUST_GO, CUT = 4, 8
_LEGAL = {(1, 2), (2, 3), (3, 2)}


def _to_user(w: int) -> int:
    """States from which a user turn leads into w: nothing yet, after s, after a."""
    u = w & _S2
    return u >> 2 | u >> 1 | u << 1


def _to_assistant(w: int) -> int:
    return (w & _S3) >> 1


def layers(codes: bytes) -> tuple[array, array]:
    """The layers in front of each turn and behind the last one, and the least cost of each."""
    n = len(codes)
    words, least = array("Q", bytes(8 * (n + 1))), array("q", bytes(8 * (n + 1)))
    w, base = _S0 | _S3, 0

    def closed(w: int) -> int:
        for _ in range(2):
            w |= (_to_user(w) | _to_assistant(w)) << 4 * INSERT & _ALL
        return w

    words[n] = w = closed(w)
    for at in range(n - 1, -1, -1):
        code = codes[at]
        new = w << 4 * DELETE & _ALL
        if not code & MUST_GO:
            more = 4 * TRUNCATED if code & CUT else 0
            user, assistant, initial = _to_user(w), _to_assistant(w), code & 3
            kept = user if initial == 2 else assistant if initial == 3 else (w & _S1) >> 1 if initial == 1 else 0
            new |= (kept << more | (user | assistant) << more + 4 * REROLE) & _ALL
        w = closed(new)
        while not w & 15:  # the least cost rises by a layer; all states are within the highest ones
            w, base = w >> 4 | 15 << 60, base + 1
        words[at], least[at] = w, base
    return words, least


def audit(codes: bytes) -> tuple[int, bytes]:
    """The least cost and the first of the cheapest edits' initials in ASCII order."""
    words, least = layers(codes)
    n, at, state = len(codes), 0, 0
    left = least[0] + next(k for k in range(LAYERS) if words[0] >> 4 * k & 1)
    cost, out = left, bytearray()

    def within(at: int, state: int, cost: int) -> bool:
        k = cost - least[at]
        return 0 <= k < LAYERS and bool(words[at] >> 4 * k + state & 1)

    while at < n or left:
        code = codes[at] if at < n else MUST_GO
        initial, more = code & 3, TRUNCATED if code & CUT else 0
        next_ = WANTED[state]
        if at < n and within(at + 1, state, left - DELETE):
            out.append(68)
            at, left = at + 1, left - DELETE
        elif within(at, next_, left - INSERT):
            out.append(73)
            state, left = next_, left - INSERT
        elif not code & MUST_GO and initial and (initial == next_ or (initial == 1 and state == 0)) and within(at + 1, initial, left - more):
            out.append(75)
            at, state, left = at + 1, initial, left - more
        else:
            out.append(82)
            at, state, left = at + 1, next_, left - more - REROLE
    return cost, bytes(out)


def _turns(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return df.select(F.col(conv).alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), space(role).alias("role"), space(text).alias("text"))


def _streamed(rows: DataFrame) -> DataFrame:
    """Each row twice, without its text and with it, in the order in which they are read."""
    digest = F.unhex(F.sha2("text", 256))
    end = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    initial = F.substring("role", 1, 1)
    thin = rows.select("conv_id", "turn", "role", digest.alias("digest"), (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("cut"), F.coalesce(*(F.when(initial == k, v) for k, v in INITIALS.items()), F.lit(0)).alias("initial"))
    key = F.coalesce("turn", F.lit(-(1 << 63)))  # a null turn is the first
    first = thin.groupBy("conv_id", "role", "digest").agg(F.min(key).alias("since"))
    a, b = thin.alias("a"), first.alias("b")
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.role") == F.col("b.role")) & (F.col("a.digest") == F.col("b.digest"))
    seen = a.join(b, same).select("a.*", (F.coalesce("a.turn", F.lit(-(1 << 63))) > F.col("b.since")).alias("later"))
    code = F.col("initial") + F.when(F.col("blank"), 16).otherwise(0) + F.when(F.col("cut"), 32).otherwise(0) + F.when(F.col("later"), 64).otherwise(0)
    none = F.lit(None).cast("string")
    both = seen.select("conv_id", F.lit(0).alias("pass"), "turn", "role", "digest", code.alias("code"), none.alias("text")).unionByName(rows.select("conv_id", F.lit(1).alias("pass"), "turn", "role", digest.alias("digest"), F.lit(0).alias("code"), "text"))
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "pass", "turn", "role", "digest")


class _Conversation:
    """What is kept of a conversation while its rows pass."""

    def __init__(self, conv_id):
        self.conv_id, self.codes, self.last = conv_id, bytearray(), None
        self.low = self.high = self.turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.audit, self.at, self.ord, self.state = None, 0, 0, 0
        self.digest = hashlib.sha256()

    def see(self, turn, role, digest, code: int) -> None:
        same = (turn, role, digest) == self.last
        self.last = (turn, role, digest)
        if turn is not None and turn != self.turn:
            self.turns, self.turn = self.turns + 1, turn
            self.low, self.high = turn if self.low is None else self.low, turn
        initial = code & 3
        if self.codes and (self.codes[-1] & 3, initial) not in _LEGAL:
            self.illegal += 1
        if code & 16:
            self.blank += 1
        elif same or code & 64:
            self.duplicate += 1
            code |= 16
        elif code & 32:
            self.truncated += 1
        self.codes.append(initial | (MUST_GO if code & 16 else CUT if code & 32 else 0))

    def decide(self) -> None:
        self.cost, self.audit = audit(bytes(self.codes))

    def _put(self, edit: str, turn, role: str, text: str) -> tuple:
        self.digest.update(f"{'' if self.ord == 0 else chr(10)}{role}:{text}".encode())
        self.ord += 1
        return self.conv_id, self.ord, edit, turn, role, text

    def inserted(self):
        while self.at < len(self.audit) and self.audit[self.at] == 73:
            self.at, self.state = self.at + 1, WANTED[self.state]
            yield self._put("I", None, ROLE[self.state], "")

    def take(self, turn, role: str, text: str):
        yield from self.inserted()
        edit = chr(self.audit[self.at])
        self.at += 1
        if edit == "D":
            return
        self.state = INITIALS[role[:1]] if edit == "K" else WANTED[self.state]
        yield self._put(edit, turn, role if edit == "K" else ROLE[self.state], text)

    def summary(self) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "cost": self.cost, "audit": self.audit.decode(), "repaired_sha256": self.digest.hexdigest()}


_SUMMARY = pa.struct([*((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
_SUMMARY_SQL = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def repair(df: DataFrame, texts: bool = True, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, ord, edit, turn, role, text, summary): the repaired turns of every conversation and, with a null ord, a row with its summary.

    texts: whether the repaired turns are returned, or the summaries alone."""
    rows = _streamed(_turns(df, conv, turn, role, text))
    id_type = rows.schema["conv_id"].dataType.simpleString()

    def run(batches):
        now: _Conversation | None = None

        def ended():
            yield from now.inserted()
            yield now.conv_id, None, None, None, None, None, now.summary()

        def stream(b):
            nonlocal now
            for conv_id, stage, turn, role, digest, code, text in zip(*(c.to_pylist() for c in b.columns)):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        yield from ended()
                    now = _Conversation(conv_id)
                if stage == 0:
                    now.see(turn, role, digest, code)
                else:
                    if now.audit is None:
                        now.decide()
                    yield from now.take(turn, role, text)

        def packed(found, kind):
            columns = list(zip(*(r if len(r) == 7 else (*r, None) for r in found if texts or len(r) == 7))) or [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), _SUMMARY))], names=["conv_id", "ord", "edit", "turn", "role", "text", "summary"])

        kind = None
        for b in batches:
            kind = b.schema.field(0).type
            for at in range(0, b.num_rows, 2000):
                yield packed(stream(b.slice(at, 2000)), kind)
        if now is not None:
            yield packed(ended(), kind)

    return rows.mapInArrow(run, f"conv_id {id_type}, ord bigint, edit string, turn bigint, role string, text string, summary struct<{_SUMMARY_SQL.replace(' ', ':').replace(',:', ',')}>")


def damage_of(conv: Column, turn: Column) -> Column:
    """What is done to a row: 0 drops it, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it the user's."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    return F.crc32(F.concat(part(conv), F.lit(":"), part(turn)).cast("binary")) % 20


def damaged(df: DataFrame) -> DataFrame:
    """Rows of conversations with the faults that the query repairs."""
    rows = _turns(df, "conv_id", "turn", "role", "text").withColumn("damage", damage_of(F.col("conv_id"), F.col("turn"))).filter("damage <> 0")
    kind = F.col("damage")
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = repair(damaged(given), texts=False).select(F.col("conv_id").alias("id"), "summary.*")
    known = given.select("conv_id").distinct()
    rows = known.join(found, F.col("conv_id").eqNullSafe(F.col("id")), "left")
    zero = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return rows.select("conv_id", *(v.alias(c) for c, v in zero.items()), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
