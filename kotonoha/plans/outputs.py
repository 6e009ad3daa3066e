"""Output paths without collisions: files, and trees of folders level by level."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kotonoha.functions.names import collision_key, sanitize_filename
from kotonoha.operators.notes import apart
from kotonoha.plans.jobs import running
from kotonoha.session import written

_FILE = r"\A(.*?)(\.[^./]*)?\z"
_MARKED = r"\A(.*?)_converted([2-9]|[1-9][0-9]+)?\z"
#: Claims of a key that one task may hold; held names that every task is told.
LARGE, TOLD = 100_000, 100_000


def _mark(n: Column) -> Column:
    return F.when(n == 0, "").when(n == 1, "_converted").otherwise(F.concat(F.lit("_converted"), n.cast("string")))


def free_numbers(claims: DataFrame, held: DataFrame, keys: list[str], order: str) -> DataFrame:
    """claims with free: the k-th of a key in order gets the k-th number from 0 on that held (keys, n) does not have.

    Claims are counted by their key, those of a key of more than LARGE by running sums over ranges, so that no such key is gathered. Among held numbers all
    goes by running sums: a held number stands before as many free ones as it is large, less the held ones below it, and a claim moves on by those that
    stand before it. Nothing is reserved one after another."""
    more = lambda df, by: df.groupBy(*by).agg(F.count("*").alias("__n")).filter(F.col("__n") > LARGE).select(*by)
    crowded = written(more(claims, keys[:1]), "crowded")  # a key is large only where its first column is
    large = F.broadcast(written(more(claims.join(F.broadcast(crowded), keys[:1], "left_semi"), keys), "crowded"))
    many = running(claims.join(large, keys, "left_semi").withColumn("__one", F.lit(1)), {"__k": "__one"}, [order], keys).drop("__one")
    few, by_key = claims.join(large, keys, "left_anti"), Window.partitionBy(*keys).orderBy(order)
    ranked = running(held.select(*keys, "n").distinct().withColumn("__one", F.lit(1)), {"__j": "__one"}, ["n"], keys)
    spots = ranked.select(*keys, (F.col("n") - F.col("__j") + 1).cast("bigint").alias("__pos"), F.lit(0).alias("__claim"), F.lit(1).alias("__held"))
    # only claims of a key that holds a number have to move on
    busy = held.select(*keys).distinct()
    numbered = lambda how: few.join(busy, keys, how).withColumn("__k", F.row_number().over(by_key).cast("bigint")).unionByName(many.join(busy, keys, how))
    both = numbered("left_semi").withColumn("__pos", F.col("__k") - 1).withColumn("__claim", F.lit(1)).withColumn("__held", F.lit(0)).unionByName(spots, allowMissingColumns=True)
    done = running(both, {"__skip": "__held"}, ["__pos", "__claim"], keys).filter("__claim = 1").drop("__pos", "__claim", "__held")
    done = done.unionByName(numbered("left_anti").withColumn("__skip", F.lit(0).cast("bigint")))
    return done.withColumn("free", F.col("__k") - 1 + F.col("__skip")).drop("__k", "__skip")


def _holds(stem: Column, others: list[Column], exact: bool) -> Column:
    """What a taken name holds: itself (exact), and the number of the name that it looks converted from."""
    one = lambda base, n: F.struct(base.alias("stem_key"), *others, n.cast("bigint").alias("n"))
    marked = F.when(stem.rlike(_MARKED), one(F.regexp_extract(stem, _MARKED, 1), F.coalesce(F.regexp_extract(stem, _MARKED, 2).try_cast("bigint"), F.lit(1))))
    return F.explode(F.filter(F.array(*([one(stem, F.lit(0))] if exact else []), marked), lambda x: x.isNotNull()))


def plan_outputs(requests: DataFrame, taken: DataFrame, batch: str = "batch") -> DataFrame:
    """(batch, ord, path, output): each requested path, or the first free one of name_converted, name_converted2, ...

    requests: (batch, ord, path); taken: (batch, path) of inputs and existing files. The k-th request of a key gets the k-th number that no
    taken path and no request of a name that looks converted holds."""
    stem, ext = F.regexp_extract("path", _FILE, 1), F.regexp_extract("path", _FILE, 2)
    parts = apart(requests.select(batch, "ord", "path", collision_key("path").alias("key"), collision_key(stem).alias("stem_key")))
    # keys that follow from the path as it stands are not written beside it
    usual = lambda key: F.regexp_extract(key, _FILE, 1)
    unlike = lambda value, usual: F.when(~value.eqNullSafe(usual), value)
    parts = written(parts.select(batch, "ord", "path", unlike(F.col("key"), F.col("path")).alias("key"), unlike(F.col("stem_key"), usual("key")).alias("stem_key")), "outputs")
    parts = parts.withColumn("key", F.coalesce("key", "path"))
    names = parts.select(batch, F.coalesce("stem_key", usual("key")).alias("stem_key"), F.lower(ext).alias("ext_key"), "key")
    keyed = apart(apart(taken.select(batch, "path")).select(batch, collision_key("path").alias("key")))
    ext_key = F.regexp_extract("key", _FILE, 2).alias("ext_key")
    stem_of = F.regexp_extract("key", _FILE, 1)
    found = lambda df, exact: df.select(batch, _holds(stem_of, [ext_key], exact).alias("h")).select(batch, "h.*")
    own = names.filter(F.col("stem_key").rlike(_MARKED)).select(batch, "key").distinct()
    held = written(found(keyed, True).unionByName(found(own, False)), "outputs-held")
    name = [batch, "stem_key", "ext_key"]
    if held.count() <= TOLD:  # few names: only requests of these are gathered
        names = names.join(F.broadcast(held.select(*name).distinct()), name, "left_semi")
    held = written(held.join(names.distinct(), name), "outputs-held")
    free = free_numbers(parts.select(batch, "ord", "path", "key"), held, [batch, "key"], "ord")
    return free.select(batch, "ord", "path", F.concat(stem, _mark(F.col("free")), ext).alias("output"))


class Tree(NamedTuple):
    """outputs: (batch, ord, path, output); directories: (batch, output) that are made or used; problems: (batch, ord, path) of the first bad path of each batch that is left out."""

    outputs: DataFrame
    directories: DataFrame
    problems: DataFrame


def bad_path(path: Column) -> Column:
    """Whether a requested path leaves its root, has an empty segment, or is no md or txt file."""
    outside = path.rlike(r"(?i)\A[/\\]|\A[a-z]:|[\x00-\x1f\x7f]") | F.exists(F.split(path, r"[/\\]", -1), lambda x: x.isin("", ".", ".."))
    return path.isNull() | outside | ~F.element_at(F.split(path, "/", -1), -1).rlike(r"(?i)\.(md|txt)\z")


def plan_tree(requests: DataFrame, taken: DataFrame, batch: str = "batch") -> Tree:
    """Paths for files in folders, of which those that share a group under one parent share a folder.

    requests: (batch, ord, path) and, if given, directories array<struct<name, group>>, else a path's own folders are its groups. taken:
    (batch, path, kind) of inputs and existing paths, kind file or directory; the parents of each are directories. A folder that exists is used by the first
    group that asks for it; a file in its place, or another group, moves a group on to name_converted, name_converted2 and so
    on. Level by level: each level's groups are numbered under the parents that the level above has got. One bad path leaves
    out its whole batch."""
    given = "directories" in requests.columns
    bad = requests.filter(bad_path(F.col("path")))
    problems = bad.groupBy(batch).agg(F.min(F.struct("ord", "path")).alias("p")).select(batch, "p.*")
    good = requests.join(problems.select(batch), batch, "left_anti")
    parts = F.split("path", "/", -1)
    own = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda x, i: F.struct(x.alias("name"), F.concat(F.lit("path:"), F.array_join(F.slice(parts, F.lit(1), i + 1), "/")).alias("group")))
    dirs = F.coalesce(F.col("directories"), own) if given else own
    file = F.element_at(parts, -1)
    rows = good.select(batch, "ord", "path", dirs.alias("dirs"), F.concat(sanitize_filename(F.regexp_extract(file, r"(?i)\A(.*)\.(md|txt)\z", 1)), F.lit("."), F.lower(F.regexp_extract(file, r"(?i)\.(md|txt)\z", 1))).alias("file"), F.lit("").alias("parent"))
    now = written(apart(rows), "tree-rows")
    # every path that is held, with its parents, by the folder that it lies in
    above = F.split("path", "/", -1)
    each = F.explode(F.transform(F.sequence(F.lit(1), F.size(above)), lambda n: F.struct(F.array_join(F.slice(above, F.lit(1), n), "/").alias("path"), ((n == F.size(above)) & (F.coalesce("kind", F.lit("file")) != "directory")).alias("file"))))
    occupied = apart(taken.select(batch, each.alias("o")).select(batch, "o.path", "o.file")).groupBy(batch, "path").agg(F.max("file").alias("file"))
    occupied = written(apart(occupied).withColumn("key", collision_key("path")), "tree-taken")
    split = lambda key: (F.regexp_extract(key, r"\A(.*/)?[^/]*\z", 1), F.regexp_extract(key, r"([^/]*)\z", 1))
    folder, name = split("key")
    blocked = occupied.filter("file").select(batch, folder.alias("folder"), name.alias("name"))
    depth = now.agg(F.max(F.size("dirs"))).first()[0] or 0
    made = None
    for level in range(depth):
        step = F.get("dirs", F.lit(level))
        asking = now.filter(F.size("dirs") > level)
        groups = asking.groupBy(batch, "parent", step["group"].alias("group")).agg(F.min("ord").alias("first"), F.min_by(step["name"], "ord").alias("name"))
        groups = apart(groups.withColumn("base", sanitize_filename("name")))
        groups = apart(groups.withColumn("path", F.concat("parent", "base")))
        groups = apart(groups.withColumn("key", collision_key("path")).drop("path"))
        folder, name = split("key")
        groups = written(groups.withColumn("folder", folder).withColumn("stem_key", name), "tree-groups")
        # names of files that are asked for in the same folder and come first are files' names
        files = apart(now.filter(F.size("dirs") == level).select(batch, "ord", F.concat("parent", "file").alias("path")))
        files = apart(files.select(batch, "ord", collision_key("path").alias("key"))).groupBy(batch, "key").agg(F.min("ord").alias("ord"))
        earlier = files.join(groups.groupBy(batch, "key").agg(F.min("first").alias("first")), [batch, "key"]).filter(F.col("ord") < F.col("first"))
        folder, name = split("key")
        held = blocked.unionByName(earlier.select(batch, folder.alias("folder"), name.alias("name")))
        held = held.select(batch, "folder", _holds(F.col("name"), [], True).alias("h")).select(batch, "folder", "h.*")
        held = held.join(groups.select(batch, "folder", "stem_key").distinct(), [batch, "folder", "stem_key"])
        placed = free_numbers(groups, held, [batch, "folder", "stem_key"], "first")
        mark = _mark(F.col("free"))
        placed = written(placed.select(batch, "parent", "group", F.concat("parent", F.substring(F.col("base"), F.lit(1), 100 - F.length(mark)), mark).alias("output")), "tree-level")
        one = placed.select(batch, "output")
        made = one if made is None else made.unionByName(one)
        next_ = placed.select(batch, F.col("parent").alias("__parent"), F.col("group").alias("__group"), F.col("output").alias("__output"))
        a, b = now.alias("a"), next_.alias("b")
        same = (F.col(f"a.{batch}") == F.col(f"b.{batch}")) & (F.col("a.parent") == F.col("b.__parent")) & (F.get("a.dirs", F.lit(level))["group"] == F.col("b.__group"))
        joined = a.join(b, same, "left").select("a.*", "__output")
        now = written(joined.withColumn("parent", F.when(F.size("dirs") > level, F.concat("__output", F.lit("/"))).otherwise(F.col("parent"))).drop("__output"), "tree-rows")
    asked = now.select(batch, "ord", F.concat("parent", "file").alias("path"))
    all_taken = occupied.select(batch, "path")
    all_taken = all_taken if made is None else all_taken.unionByName(made.select(batch, F.col("output").alias("path")))
    planned = plan_outputs(asked, all_taken, batch).select(batch, "ord", "output")
    outputs = now.select(batch, "ord", "path").join(planned, [batch, "ord"])
    return Tree(outputs, (made if made is not None else now.limit(0).select(batch, F.col("path").alias("output"))).distinct(), problems)
