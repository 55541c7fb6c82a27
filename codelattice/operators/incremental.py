"""Change detection, refresh scope, dirty sets and lifecycle events of incremental indexing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(current: DataFrame, prior: DataFrame, renames: DataFrame | None = None) -> DataFrame:
    """(path, status, old_path) of files whose hashes differ between two manifests (path, content_hash).

    ``renames`` (old_path, path), as a version control system reports them, turn a removal and an addition into one rename.
    """
    both = current.select("path", F.col("content_hash").alias("now")).join(prior.select("path", F.col("content_hash").alias("was")), "path", "full_outer")
    status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("was"), "modified")
    found = both.select("path", status.alias("status")).where("status is not null")
    if renames is None:
        return found.withColumn("old_path", F.lit(None).cast("string"))
    real = renames.join(found.where("status = 'added'").select("path"), "path", "left_semi").join(found.where("status = 'removed'").select(F.col("path").alias("old_path")), "old_path", "left_semi").select("path", "old_path")
    rest = found.join(real.select("path"), "path", "left_anti").join(real.select(F.col("old_path").alias("path")), "path", "left_anti")
    return rest.withColumn("old_path", F.lit(None).cast("string")).unionByName(real.withColumn("status", F.lit("renamed")))


def touched(changed: DataFrame) -> DataFrame:
    return changed.where("status <> 'removed'").select("path").distinct()


def removed(changed: DataFrame) -> DataFrame:
    return changed.where("status = 'removed'").select("path").union(changed.where("status = 'renamed'").select("old_path")).distinct()


def importers(paths: DataFrame, imports: DataFrame, hops: int) -> DataFrame:
    """The given paths and those that import them, directly or through at most ``hops`` others; imports are (path, target)."""
    scope = frontier = paths.select("path").distinct()
    for _ in range(hops):
        frontier = imports.join(frontier.withColumnRenamed("path", "target"), "target", "left_semi").select("path").distinct().join(scope, "path", "left_anti")
        scope = scope.union(frontier)
    return scope


def dirty_after(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Touched symbols (id) and their neighbours."""
    s = symbols.select("id").distinct()
    out = edges.join(s.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
    back = edges.join(s.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))
    return s.union(out).union(back).distinct()


def mark_dirty(dirty: DataFrame, ids: DataFrame, consumers: list[str]) -> DataFrame:
    """The dirty table (consumer, id) with ``ids`` for each of the consumers."""
    each = F.explode(F.array(*map(F.lit, consumers))).alias("consumer")
    return dirty.unionByName(ids.select(each, "id")).distinct()


def mark_clean(dirty: DataFrame, consumer: str, ids: DataFrame) -> DataFrame:
    done = ids.select("id", F.lit(consumer).alias("consumer")).distinct()
    return dirty.join(done, ["consumer", "id"], "left_anti").select(*dirty.columns)


def lifecycle(before: DataFrame, after: DataFrame, commit_sha: str, ts: int) -> DataFrame:
    """Events of symbols (id) that appeared and disappeared."""
    row = lambda df, event: df.select(F.col("id").alias("symbol_id"), F.lit("symbol").alias("entity"), F.lit(event).alias("event"), F.lit(commit_sha).alias("commit_sha"), F.lit(ts).cast("long").alias("ts"), F.lit(None).cast("string").alias("ref"))
    old, new = before.select("id").distinct(), after.select("id").distinct()
    return row(new.join(old, "id", "left_anti"), "opened").union(row(old.join(new, "id", "left_anti"), "closed"))


def packs_changed(stored: dict[str, str], active: dict[str, str]) -> bool:
    """Whether extraction rules differ from those of the index, which then has to be built anew."""
    return stored != active


def unchanged_hashes(old: DataFrame, new: DataFrame, key: str = "path", value: str = "content_hash") -> DataFrame:
    """Keys whose sets of hashes are equal in both, so that work on them can be skipped."""
    sets = lambda df, name: df.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias(name))
    return sets(old, "a").join(sets(new, "b"), key).where("a = b").select(key)


def fingerprint(rows: DataFrame, key: str, value: str) -> DataFrame:
    """One sha256 of each key's values in their order."""
    return rows.groupBy(key).agg(F.sha2(F.concat_ws("", F.array_sort(F.collect_list(value))), 256).alias("fingerprint"))
