"""Strict decoding of text bytes, in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

#: Byte order marks that are not read, and the encodings tried in turn.
OTHER_MARKS = (b"\xff\xfe\x00\x00", b"\x00\x00\xfe\xff", b"\xff\xfe", b"\xfe\xff")
ORDER = ("utf-8", "cp932", "shift_jis")
SCHEMA = StructType([StructField("ok", BooleanType()), StructField("text", StringType()), StructField("encoding", StringType()), StructField("bom", BooleanType()), StructField("code", StringType())])


def _decode(data: bytes | None, encoding: str | None) -> tuple:
    data = bytes(data or b"")
    if data.startswith(OTHER_MARKS):
        return False, None, None, None, "UNSUPPORTED_ENCODING"
    bom = data.startswith(b"\xef\xbb\xbf")
    if bom and encoding not in (None, "auto", "utf-8"):
        return False, None, None, None, "ENCODING_BOM_CONFLICT"
    tried = ORDER if encoding in (None, "auto") else (encoding,)
    for name in ("utf-8",) if bom else tried:
        try:
            text = data[3 * bom :].decode(name)
        except (UnicodeDecodeError, LookupError):
            continue
        return True, text.replace("\r\n", "\n").replace("\r", "\n"), name, bom, None
    return False, None, None, None, "DECODE_FAILED"


@F.pandas_udf(SCHEMA)
def decode_text(content: pd.Series, encoding: pd.Series) -> pd.DataFrame:
    """(ok, text, encoding, bom, code) of bytes, by the named encoding or, for "auto" or null, the first that fits."""
    return pd.DataFrame([_decode(a, b) for a, b in zip(content, encoding)], columns=["ok", "text", "encoding", "bom", "code"])
