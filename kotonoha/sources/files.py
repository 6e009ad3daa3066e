"""Text files and archives as tables, and tables as archives."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kotonoha.functions.decode import decode_text
from kotonoha.functions.names import zip_entry_problem, zip_relative_name
from kotonoha.plans.budgets import Limits


def read_sources(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(input_id, name, kind, length, content) of the txt, md and zip files below a path; earlier output is left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    name = F.regexp_extract("path", r"([^/]*)\z", 1)
    kind = F.lower(F.regexp_extract("path", r"\.((?i)txt|md|zip)\z", 1))
    files = files.select(F.col("path").alias("input_id"), name.alias("name"), kind.alias("kind"), "length", "content")
    return files.filter((F.col("kind") != "") & ~F.col("name").rlike(r"_converted\d*\.[^.]*\z"))


def entries(sources: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(input_id, index, raw_name, name, mode, size, content, problem) of the archives' entries; content of text entries only.

    Of limits hold those on an archive's entries, on what they declare together and on a text; None is no limit."""
    over = lambda value, limit: limit is not None and value > limit

    def run(batches):
        for b in batches:
            for input_id, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        infos = z.infolist()
                        if over(len(infos), limits.archive_entries) or over(sum(i.file_size for i in infos), limits.declared_bytes):
                            rows.append((0, "", 0, 0, None, "LIMIT_EXCEEDED"))
                            infos = []
                        for k, i in enumerate(infos):
                            text = i.filename.lower().endswith((".txt", ".md"))
                            problem = "ZIP_UNSUPPORTED" if i.flag_bits & 1 or text and i.compress_type not in (0, 8) else "LIMIT_EXCEEDED" if text and over(i.file_size, limits.text_bytes) else None
                            rows.append((k, i.orig_filename, i.external_attr >> 16, i.file_size, z.read(i) if text and not problem else None, problem))
                except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, UnicodeDecodeError):
                    rows = [(0, "", 0, 0, None, "ZIP_INVALID")]
                columns = list(zip(*rows)) or [()] * 6
                types = (pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([input_id] * len(rows), pa.string()), *(pa.array(list(c), t) for c, t in zip(columns, types))], names=["input_id", "index", "raw_name", "mode", "size", "content", "problem"])

    found = sources.filter("kind = 'zip'").select("input_id", "content").mapInArrow(run, "input_id string, index int, raw_name string, mode int, size bigint, content binary, problem string")
    unsafe = F.when(F.col("problem") == "ZIP_INVALID", None).otherwise(zip_entry_problem(F.col("raw_name"), F.col("raw_name"), F.col("index"), F.col("mode")))
    return found.withColumn("problem", F.coalesce("problem", unsafe)).withColumn("name", zip_relative_name(F.col("raw_name")))


def texts(sources: DataFrame, encoding: str = "auto", limits: Limits = Limits()) -> DataFrame:
    """(input_id, index, name, text, encoding, bom, code): the texts of loose files (index null) and of archive entries."""
    long = F.col("length") > limits.text_bytes if limits.text_bytes is not None else F.lit(False)
    loose = sources.filter("kind in ('txt', 'md')").select("input_id", F.lit(None).cast("int").alias("index"), "name", F.when(~long, F.col("content")).alias("content"), F.when(long, "LIMIT_EXCEEDED").alias("problem"))
    packed = entries(sources, limits).filter("content is not null or problem is not null").select("input_id", "index", "name", "content", "problem")
    rows = loose.unionByName(packed).withColumn("d", decode_text(F.coalesce("content", F.lit(b"")), F.lit(encoding)))
    value = lambda c: F.when(F.col("problem").isNull(), F.col(f"d.{c}")).alias(c)
    return rows.select("input_id", "index", "name", value("text"), value("encoding"), value("bom"), F.coalesce("problem", "d.code").alias("code"))


def export_archives(files: DataFrame, batch: str = "batch") -> DataFrame:
    """(batch, archive): one stored archive of each batch's (ord, path, content) rows in order; a batch is one download.

    UTF-8 names, a fixed date, regular files, sizes in data descriptors, so that equal rows give equal bytes."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        out, directory = io.BytesIO(), []
        rows = rows.sort_values("ord")
        for path, content in zip(rows["path"], rows["content"]):
            name, crc, at = path.encode(), zlib.crc32(content), out.tell()
            out.write(struct.pack("<4s5H3L2H", b"PK\x03\x04", 20, 0x0808, 0, 0, 0x21, 0, 0, 0, len(name), 0) + name + content)
            out.write(struct.pack("<4s3L", b"PK\x07\x08", crc, len(content), len(content)))
            directory.append(struct.pack("<4s6H3L5H2L", b"PK\x01\x02", 0x0314, 20, 0x0808, 0, 0, 0x21, crc, len(content), len(content), len(name), 0, 0, 0, 0, 0o100644 << 16, at) + name)
        start = out.tell()
        out.write(b"".join(directory))
        size = out.tell() - start
        out.write(struct.pack("<4s4H2LH", b"PK\x05\x06", 0, 0, len(directory), len(directory), size, start, 0))
        return pd.DataFrame({"batch": [rows[batch].iloc[0]], "archive": [out.getvalue()]})

    return files.groupBy(batch).applyInPandas(pack, f"batch {files.schema[batch].dataType.simpleString()}, archive binary")
