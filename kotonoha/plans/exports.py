"""Checks of what is to be exported: per batch the first problem in the order of its rows and checks."""

from __future__ import annotations

from dataclasses import astuple, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kotonoha.functions.names import RESERVED, collision_key
from kotonoha.operators.notes import apart
from kotonoha.plans.jobs import first_over


@dataclass(frozen=True)
class ExportLimits:
    """Files, bytes of a file, of all files, of a path; None for no limit."""

    files: int | None = 8_192
    file_bytes: int | None = 128 << 20
    input_bytes: int | None = 128 << 20
    path_bytes: int | None = 4_096

    def __post_init__(self):
        if any(x is not None and x < 1 for x in astuple(self)):
            raise ValueError("limits are positive")


#: A corpus of any size.
UNLIMITED = ExportLimits(None, None, None, None)


def checked(files: DataFrame, limits: ExportLimits = ExportLimits(), batch: str = "batch") -> DataFrame:
    """(batch, ord, file_id, path, format, content) rows with code, the first check that a row fails, null for a sound one.

    ord is unique in a batch. The first row of each id and path, and the first row that the batch's bytes do not hold, come from aggregates that are joined
    by their keys, so that no batch and no repeated key is one task's window; a file whose path is another's folder collides with it."""
    keyed = apart(files.withColumn("__key", collision_key("path")))
    for name, key in (("__first_id", "file_id"), ("__first_key", "__key")):
        keyed = keyed.join(keyed.groupBy(batch, key).agg(F.min("ord").alias(name)), [batch, key], "left")
    parts = F.split("__key", "/", -1)
    folders = keyed.filter(F.contains("__key", F.lit("/"))).select(batch, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("__key")).distinct().withColumn("__folder", F.lit(True))
    keyed = keyed.join(folders, [batch, "__key"], "left")
    if limits.input_bytes is None:
        keyed = keyed.withColumn("__over", F.lit(False))
    else:
        sizes = files.select(batch, "ord", F.coalesce(F.octet_length("content"), F.lit(0)).cast("bigint").alias("size"))
        first = first_over(sizes, "size", limits.input_bytes, "ord", batch).select(batch, F.col("ord").alias("__over_at"))
        keyed = keyed.join(first, batch, "left").withColumn("__over", F.col("ord") >= F.col("__over_at")).drop("__over_at")
    segments = F.split("path", "/", -1)
    unsafe = F.exists(segments, lambda s: s.isin("", ".", "..") | s.rlike(r"[\x00-\x1f\x7f-\x9f\\:*?\"<>|]|[. ]\z") | s.rlike(RESERVED)) | ~F.endswith(F.lower("path"), F.concat(F.lit("."), "format"))
    beyond = lambda c, limit: F.lit(False) if limit is None else F.octet_length(c) > limit
    again = lambda first: F.col("ord") > F.col(first)
    code = (
        F.when(F.coalesce(F.trim("file_id"), F.lit("")) == "", "INVALID_FILE_ID")
        .when(again("__first_id"), "DUPLICATE_FILE_ID")
        .when(F.col("format").isNull() | ~F.col("format").isin("md", "txt"), "INVALID_FORMAT")
        .when(beyond("path", limits.path_bytes), "PATH_LIMIT")
        .when(F.col("path").isNull() | unsafe, "UNSAFE_PATH")
        .when(again("__first_key") | F.col("__folder").isNotNull(), "PATH_COLLISION")
        .when(F.col("content").isNull(), "INVALID_BYTES")
        .when(beyond("content", limits.file_bytes), "FILE_BYTES_LIMIT")
        .when(F.col("__over"), "INPUT_BYTES_LIMIT")
    )
    return keyed.withColumn("code", code).drop("__key", "__first_id", "__first_key", "__folder", "__over")


def artifact_problems(files: DataFrame, limits: ExportLimits = ExportLimits(), mode: str = "zip", batch: str = "batch") -> DataFrame:
    """(batch, code): why a batch is not exported, null where it may be."""
    if mode not in ("zip", "single"):
        raise ValueError("mode is zip or single")
    found = checked(files, limits, batch).groupBy(batch).agg(F.count("*").alias("n"), F.min(F.when(F.col("code").isNotNull(), F.struct("ord", "code"))).alias("first"))
    many = F.when(F.lit(False) if limits.files is None else F.col("n") > limits.files, "FILE_COUNT_LIMIT").when(F.lit(mode == "single") & (F.col("n") != 1), "SINGLE_FILE_COUNT")
    return found.select(batch, F.coalesce(many, "first.code").alias("code"))
