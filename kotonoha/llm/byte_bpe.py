"""Operator 5: byte-level BPE encoding and decoding through a sentencepiece model.

The rank file of a byte-level vocabulary is serialised as a sentencepiece BPE model: each of its
byte strings becomes a piece of characters (byte b is U+0100 + b), its score is the negative rank,
normalisation is the identity. A text is cut into pre-tokens by the vocabulary's pattern; a
pre-token that is itself in the vocabulary is that token, every other one is merged by
sentencepiece (highest score first, leftmost among equals, which is lowest rank first). Decoding
maps ids back to their byte strings.

Defined results: a null text counts as empty and has no ids; ids of one text are independent of
all other rows, so ties, repeated rows, a hot source or an empty table need no care. Columns other
than the id and the text are not read, so their names cannot clash.
"""

from __future__ import annotations

import base64
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kotonoha.llm.common import text_rows

#: Byte b is written as the character U+0100 + b.
CHARS = {b: 256 + b for b in range(256)}
#: Pre-tokens whose ids a Python worker remembers at most; beyond it the memory starts afresh.
REMEMBERED = 200_000

#: Letters and numbers assigned after Unicode 16, as ranges. The vocabulary's library
#: knows Unicode 16 and takes them for neither; the regex module here knows them.
LATER = (
    "\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    "\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8"
    "\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    "\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    "\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    "\U0001e6e0-\U0001e6e2\U0001e6e4\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe\U0001e6ff"
    "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)

_state: dict = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: a base64 byte string and its rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """The serialised ModelProto: pieces in order of rank, then <unk>."""
    ordered = sorted(ranks, key=ranks.get)
    pieces = b"".join(
        _field(1, _field(1, p.decode("latin-1").translate(CHARS).encode()) + _field(2, float(-ranks[p])) + _field(3, 1))
        for p in ordered
    )
    unknown = _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(ordered) + 1) + _field(40, len(ordered)) + b"".join(_field(k, -1) for k in (41, 42, 43))
    normalizer = _field(1, b"identity") + b"".join(_field(k, 0) for k in (3, 4, 5))
    return pieces + unknown + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encoder and decoder of one vocabulary, made once in each Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(ranks))
        self.ids = [ranks[p] for p in sorted(ranks, key=ranks.get)]
        self.whole = ranks
        self.bytes_of = {i: p for p, i in ranks.items()}
        self.findall = regex.compile(pattern).findall
        self.later = regex.compile(f"[{LATER}]")
        self.known: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        """Pre-tokens; a character that is no letter or number yet is looked at as an unassigned one."""
        if text.isascii() or not self.later.search(text):
            return self.findall(text)
        out, at = [], 0
        for seen in self.findall(self.later.sub("\u0378", text)):
            out.append(text[at : at + len(seen)])
            at += len(seen)
        return out

    def _learn(self, missing: list[str]) -> None:
        merged = []
        for token in missing:
            if (rank := self.whole.get(token.encode())) is not None:
                self.known[token] = struct.pack("<I", rank)
            else:
                merged.append(token)
        for token, found in zip(merged, self.sp.encode([t.encode().decode("latin-1").translate(CHARS) for t in merged], out_type=int, num_threads=1)):
            self.known[token] = struct.pack(f"<{len(found)}I", *(self.ids[i] for i in found))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        tokens = self.split(text)
        missing = [t for t in dict.fromkeys(tokens) if t not in self.known]
        if missing:
            if len(self.known) + len(missing) > REMEMBERED:
                self.known.clear()
                missing = list(dict.fromkeys(tokens))
            self._learn(missing)
        return b"".join(map(self.known.__getitem__, tokens))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, struct.unpack(f"<{len(packed) // 4}I", packed)))


def _codec(shared) -> Codec:
    key = shared.value["key"]
    if key not in _state:
        _state.clear()
        _state[key] = Codec(shared.value["ranks"], shared.value["pattern"])
    return _state[key]


def _shared(df: DataFrame, ranks_path: str, pattern: str):
    """The vocabulary, a file of fixed size, for all executors."""
    return df.sparkSession.sparkContext.broadcast({"key": (ranks_path, pattern), "ranks": read_ranks(ranks_path), "pattern": pattern})


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): ids of each whole text, packed as little-endian unsigned 32-bit integers."""
    shared = _shared(df, ranks_path, pattern)
    rows = text_rows(df, id_col, text_col)
    schema = rows.select("doc_id", F.lit(b"").alias("ids")).schema

    def run(batches):
        codec = _codec(shared)
        for b in batches:
            ids = [codec.encode(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return rows.mapInArrow(run, schema)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """(doc_id, ids, decoded): the byte strings of the ids, joined."""
    shared = _shared(df, ranks_path, pattern)
    rows = df.select("doc_id", F.col(ids_col).alias("ids"))
    schema = rows.withColumn("decoded", F.lit(b"")).schema

    def run(batches):
        codec = _codec(shared)
        for b in batches:
            texts = [None if x is None else codec.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.binary())], names=["doc_id", "ids", "decoded"])

    return rows.mapInArrow(run, schema)


def round_trip(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): encode() and decode() by one Python worker, so that a task holds the texts and the vocabulary once."""
    shared = _shared(df, ranks_path, pattern)
    rows = text_rows(df, id_col, text_col)
    schema = rows.select("doc_id", F.lit(b"").alias("ids"), F.lit(b"").alias("decoded")).schema

    def run(batches):
        codec = _codec(shared)
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                ids = [codec.encode(t) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array(list(map(codec.decode, ids)), pa.binary())], names=["doc_id", "ids", "decoded"])

    return rows.mapInArrow(run, schema)


def unpacked(ids_col: str = "ids"):
    """The packed ids as array<bigint>."""
    c = F.col(ids_col)
    at = lambda i, k: F.conv(F.hex(F.substring(c, i * 4 + k, 1)), 16, 10).cast("bigint") * (1 << 8 * (k - 1))
    return F.when(F.octet_length(c) == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), (F.octet_length(c) / 4).cast("int") - 1), lambda i: at(i, 1) + at(i, 2) + at(i, 3) + at(i, 4))
    )


def digests(df: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encode and decode every text of df and state both results by their digests."""
    out = round_trip(df, ranks_path, pattern)
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from kotonoha.llm.common import documents

    return digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
