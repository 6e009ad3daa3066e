"""Archives assembled in parallel: where each entry goes by running sums, its bytes by columns, ranges of bytes by separate tasks.

The format is that of sources.files.export_archives (stored entries, UTF-8 names, a fixed date, sizes in data descriptors), byte for
byte; with zip64 a batch beyond what its 16 and 32 bits count has ZIP64 records. A batch may be larger than a task's memory: a part holds PART bytes and at most one entry more. Parts are written first,
the manifest last: what it does not list is no archive, so a lost task or run leaves nothing half done.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kotonoha.plans.jobs import running
from kotonoha.session import written

PART = 64 << 20
#: What the directory's 16 and 32 bits can count.
MOST_ENTRIES, MOST_BYTES = 0xFFFF - 1, 0xFFFFFFFF - 1


def _le(value, width: int) -> Column:
    """A number as so many bytes, the lowest first."""
    value = value if isinstance(value, Column) else F.lit(value)
    digits = F.lpad(F.hex(value.cast("bigint")), 2 * width, "0")
    return F.unhex(F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in reversed(range(width)))))


def _entry(name: Column, crc: Column, content: Column) -> Column:
    size = F.octet_length(content)
    fixed = lambda text: F.unhex(F.lit(text))
    head = F.concat(fixed("504B0304"), _le(20, 2), _le(0x0808, 2), _le(0, 2), _le(0, 2), _le(0x21, 2), _le(0, 4), _le(0, 4), _le(0, 4), _le(F.octet_length(name), 2), _le(0, 2))
    return F.concat(head, name, content, fixed("504B0708"), _le(crc, 4), _le(size, 4), _le(size, 4))


#: Bytes of an entry's place in 64 bits, and of the records of 64 bits in front of the end record.
_WIDE_PLACE, _WIDE_END = 12, 56 + 20


def _listing(name: Column, crc: Column, size: Column, at: Column, wide: Column) -> Column:
    """wide: whether the entry's place is written in 64 bits, behind its name."""
    start = F.concat(F.unhex(F.lit("504B0102")), _le(0x0314, 2), _le(F.when(wide, 45).otherwise(20), 2), _le(0x0808, 2), _le(0, 2), _le(0, 2), _le(0x21, 2), _le(crc, 4), _le(size, 4), _le(size, 4))
    extra = F.when(wide, F.concat(_le(1, 2), _le(8, 2), _le(at, 8))).otherwise(F.lit(b""))
    return F.concat(start, _le(F.octet_length(name), 2), _le(F.octet_length(extra), 2), _le(0, 2), _le(0, 2), _le(0, 2), _le(0o100644 << 16, 4), _le(F.when(wide, 0xFFFFFFFF).otherwise(at), 4), name, extra)


def _end(entries: Column, listing: Column, at: Column, wide: Column) -> Column:
    """The end record behind a directory at a place; wide: with those of 64 bits in front of it."""
    record = F.concat(F.unhex(F.lit("504B0606")), _le(44, 8), _le(0x032D, 2), _le(45, 2), _le(0, 4), _le(0, 4), _le(entries, 8), _le(entries, 8), _le(listing, 8), _le(at, 8))
    locator = F.concat(F.unhex(F.lit("504B0607")), _le(0, 4), _le(at + listing, 8), _le(1, 4))
    n, size, start = (F.when(wide, most).otherwise(c) for most, c in ((0xFFFF, entries), (0xFFFFFFFF, listing), (0xFFFFFFFF, at)))
    return F.concat(F.when(wide, F.concat(record, locator)).otherwise(F.lit(b"")), F.unhex(F.lit("504B0506")), _le(0, 2), _le(0, 2), _le(n, 2), _le(n, 2), _le(size, 4), _le(start, 4), _le(0, 2))


def entry_places(files: DataFrame, batch: str = "batch") -> DataFrame:
    """(batch, ord, name, size, crc, at, listed_at, nth): where each of (batch, ord, path, content) goes, and its listing in the directory, of which the first stands at 0; nth counts from 0."""
    name = F.encode("path", "UTF-8")
    content = F.coalesce("content", F.lit(b""))
    thin = files.select(batch, "ord", name.alias("name"), F.octet_length(content).cast("bigint").alias("size"), F.crc32(content).alias("crc"))
    thin = thin.withColumn("__entry", F.col("size") + F.octet_length("name") + 46).withColumn("__listing", F.octet_length("name").cast("bigint") + 46)
    summed = running(thin.withColumn("__one", F.lit(1)), {"__end": "__entry", "__listed": "__listing", "__n": "__one"}, ["ord"], [batch])
    return summed.select(batch, "ord", "name", "size", "crc", (F.col("__end") - F.col("__entry")).alias("at"), (F.col("__listed") - F.col("__listing")).alias("listed_at"), (F.col("__n") - 1).alias("nth"))


def archive_parts(files: DataFrame, batch: str = "batch", part: int = PART, zip64: bool = False) -> tuple[DataFrame, DataFrame]:
    """(batch, part, at, bytes) and the manifest (batch, entries, directory_at, size, wide_bytes, code).

    files: (batch, ord, path, content), ord unique in a batch. A batch beyond what the format counts has a code and no parts, or, with zip64,
    records of 64 bits, wide_bytes of its size."""
    places = written(entry_places(files, batch), "archive-places")
    totals = places.groupBy(batch).agg(F.count("*").alias("entries"), F.max(F.col("at") + F.col("size") + F.octet_length("name") + 46).alias("directory_at"), F.sum(F.octet_length("name").cast("bigint") + 46).alias("listing"))
    many, large = F.col("entries") > MOST_ENTRIES, F.col("directory_at") + F.col("listing") + 22 > MOST_BYTES
    wide, code = (large, F.lit(None).cast("string")) if zip64 else (F.lit(False), F.when(many, "FILE_COUNT_LIMIT").when(large, "OUTPUT_BYTES_LIMIT"))
    ends_wide = wide | many if zip64 else wide
    wide_bytes = F.when(wide, _WIDE_PLACE * F.col("entries")).otherwise(0) + F.when(ends_wide, _WIDE_END).otherwise(0)
    totals = totals.select(batch, "entries", "directory_at", (F.col("listing") + F.when(wide, _WIDE_PLACE * F.col("entries")).otherwise(0)).alias("listing"), wide.alias("wide"), ends_wide.alias("ends_wide"), wide_bytes.cast("bigint").alias("wide_bytes"), code.alias("code"))
    manifest = written(totals.withColumn("size", F.col("directory_at") + F.col("listing") + F.when(F.col("ends_wide"), _WIDE_END).otherwise(0) + 22), "archive-manifest")
    sound = manifest.filter("code is null")
    piece = lambda df, at, data: df.select(batch, at.alias("at"), data.alias("bytes"))
    both = files.select(batch, "ord", F.coalesce("content", F.lit(b"")).alias("content")).join(places.join(sound.select(batch), batch, "left_semi"), [batch, "ord"])
    bodies = piece(both, F.col("at"), _entry(F.col("name"), F.col("crc"), F.col("content")))
    listed_at = F.col("directory_at") + F.col("listed_at") + F.when(F.col("wide"), _WIDE_PLACE * F.col("nth")).otherwise(0)
    listings = piece(places.join(sound.select(batch, "directory_at", "wide"), batch), listed_at, _listing(F.col("name"), F.col("crc"), F.col("size"), F.col("at"), F.col("wide")))
    ends = piece(sound, F.col("directory_at") + F.col("listing"), _end(F.col("entries"), F.col("listing"), F.col("directory_at"), F.col("ends_wide")))
    pieces = bodies.unionByName(listings).unionByName(ends).withColumn("part", F.floor(F.col("at") / part).cast("bigint"))

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        return pd.DataFrame({"batch": rows[batch].iloc[:1], "part": rows["part"].iloc[:1], "at": rows["at"].iloc[:1], "bytes": [b"".join(rows["bytes"])]})

    parts = pieces.groupBy(batch, "part").applyInPandas(join, f"{batch} {files.schema[batch].dataType.simpleString()}, part bigint, at bigint, bytes binary".replace(f"{batch} ", "batch ", 1))
    return parts, manifest.select(F.col(batch).alias("batch"), "entries", "directory_at", "size", "wide_bytes", "code")


def write_archives(files: DataFrame, path: str, batch: str = "batch", part: int = PART, zip64: bool = False) -> DataFrame:
    """Writes parts below path/parts and then, as the commit, the manifest to path/manifest; returns the manifest."""
    parts, manifest = archive_parts(files, batch, part, zip64)
    parts.write.partitionBy("batch").parquet(f"{path}/parts")
    manifest.write.parquet(f"{path}/manifest")
    return files.sparkSession.read.parquet(f"{path}/manifest")


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """(batch, part, at, bytes) of the archives that are committed, to be sent one after the other in order of at."""
    manifest = spark.read.parquet(f"{path}/manifest").filter("code is null").select(F.col("batch").cast("string").alias("batch"))
    return spark.read.parquet(f"{path}/parts").withColumn("batch", F.col("batch").cast("string")).join(manifest, "batch", "left_semi")
