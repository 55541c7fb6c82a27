"""The append-only event log of symbols (symbol_id, entity, event, commit_sha, ts, ref) and what is read off it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelattice.functions.text import glob_to_regex

KEY = ("symbol_id", "commit_sha", "event", "ref_key")
DAY = 86_400


class HorizonError(ValueError):
    """The log doesn't reach back to the time asked for."""


def _keyed(events: DataFrame) -> DataFrame:
    return events.withColumn("ref_key", F.coalesce("ref", F.lit("")))


def record(log: DataFrame, new: DataFrame) -> DataFrame:
    """The log with the events that it doesn't hold yet, each once."""
    fresh = _keyed(new).dropDuplicates(list(KEY)).join(_keyed(log).select(*KEY), list(KEY), "left_anti")
    return log.unionByName(fresh.drop("ref_key").select(*log.columns))


def last_event(log: DataFrame, until: int | None = None, seq: str = "commit_sha") -> DataFrame:
    """The last event of each symbol, up to a time: (symbol_id, event, ts, commit_sha)."""
    known = log if until is None else log.where(F.col("ts") <= until)
    latest = F.max(F.struct("ts", F.col(seq).alias("seq"), "event", "commit_sha"))
    return known.groupBy("symbol_id").agg(latest.alias("e")).select("symbol_id", "e.event", "e.ts", "e.commit_sha")


def alive_at(log: DataFrame, ts: int, horizon: int | None = None, seq: str = "commit_sha") -> DataFrame:
    """Symbols whose last event up to ``ts`` doesn't close them."""
    if horizon is not None and ts < horizon:
        raise HorizonError(f"the log was pruned up to {horizon}")
    return last_event(log, ts, seq).where("event <> 'closed'").select("symbol_id")


def in_scope(path: Column, scope: str | None) -> Column:
    """Whether a path begins with ``scope`` or matches it as a glob."""
    return F.lit(True) if not scope else path.startswith(scope) | path.rlike(glob_to_regex(scope, crosses=True))


def changed_since(log: DataFrame, ts: int, mined: DataFrame | None = None, seq: str = "commit_sha") -> DataFrame:
    """The last change of each symbol after ``ts``, newest first; ``mined`` (symbol_id, ts, commit_sha) counts as modified where the log has no lifecycle event."""
    lifecycle = last_event(log.where(F.col("ts") > ts), None, seq)
    if mined is not None:
        other = mined.where(F.col("ts") > ts).join(lifecycle.select("symbol_id"), "symbol_id", "left_anti")
        lifecycle = lifecycle.unionByName(other.select("symbol_id", F.lit("modified").alias("event"), "ts", "commit_sha"))
    return lifecycle.orderBy(F.desc("ts"), "symbol_id")


def history(log: DataFrame, aggregates: DataFrame | None = None, seq: str = "commit_sha") -> DataFrame:
    """For each symbol when it was introduced and last changed and by how many events; mined aggregates fill in and extend."""
    first, last = F.struct("ts", F.col(seq).alias("seq"), "commit_sha"), F.struct("ts", F.col(seq).alias("seq"), "commit_sha")
    own = log.groupBy("symbol_id").agg(F.min(F.when(F.col("event") == "opened", first)).alias("f"), F.max(last).alias("l"), F.count("*").alias("events"))
    own = own.select("symbol_id", F.col("f.commit_sha").alias("introduced_sha"), F.col("f.ts").alias("introduced_ts"), F.col("l.commit_sha").alias("last_changed_sha"), F.col("l.ts").alias("last_changed_ts"), "events")
    if aggregates is None:
        return own
    m = aggregates.select("symbol_id", *(F.col(c).alias(f"m_{c}") for c in ("introduced_sha", "introduced_ts", "last_changed_sha", "last_changed_ts")), "churn_30d", "churn_90d", "top_authors")
    both = own.join(m, "symbol_id", "full_outer")
    newer = F.coalesce(F.col("m_last_changed_ts") > F.col("last_changed_ts"), F.col("last_changed_ts").isNull())
    return both.select(
        "symbol_id", F.coalesce("introduced_sha", "m_introduced_sha").alias("introduced_sha"), F.coalesce("introduced_ts", "m_introduced_ts").alias("introduced_ts"),
        F.when(newer, F.col("m_last_changed_sha")).otherwise(F.col("last_changed_sha")).alias("last_changed_sha"), F.when(newer, F.col("m_last_changed_ts")).otherwise(F.col("last_changed_ts")).alias("last_changed_ts"),
        F.coalesce("events", F.lit(0)).alias("events"), "churn_30d", "churn_90d", "top_authors",
    )


def prune(log: DataFrame, ts: int) -> DataFrame:
    """Without symbols' events of which the last closed them before ``ts``."""
    dead = last_event(log).where((F.col("event") == "closed") & (F.col("ts") < ts))
    return log.join(dead.select("symbol_id"), "symbol_id", "left_anti").select(*log.columns)


def overlapping(hunks: DataFrame, spans: DataFrame, bin_lines: int = 64) -> DataFrame:
    """Hunks (path, start, length, ...) with the symbols (symbol_id, path, span_start, span_end) whose lines they meet; a hunk of no lines stands at one.

    Both are put into bins of lines, so that a hot file is many keys and a hunk only meets spans near it; a pair counts in the
    first bin that both have.
    """
    bins = lambda a, z: F.sequence(F.floor(a / bin_lines), F.floor(z / bin_lines))
    ends = hunks.withColumn("end", F.col("start") + F.greatest(F.col("length"), F.lit(1)) - 1)
    left = ends.withColumn("__bin", F.explode(bins(F.col("start"), F.col("end"))))
    right = spans.where("span_start <= span_end").withColumn("__bin", F.explode(bins(F.col("span_start"), F.col("span_end"))))
    both = left.join(right, ["path", "__bin"]).where("start <= span_end and span_start <= end")
    return both.where(F.col("__bin") == F.floor(F.greatest("start", "span_start") / bin_lines)).drop("end", "__bin")


def churn(touches: DataFrame, now: int, top: int = 3) -> DataFrame:
    """From touches (symbol_id, commit_sha, author, ts, delta) the aggregates of each symbol.

    A hunk's whole delta counts for each symbol that it meets.  Authors are counted by commits, the first ``top`` by number and name.
    """
    recent = lambda days: F.sum(F.when(F.col("ts") >= now - days * DAY, F.col("delta")).otherwise(0))
    order = F.struct("ts", "commit_sha")
    sums = touches.groupBy("symbol_id").agg(recent(30).alias("churn_30d"), recent(90).alias("churn_90d"), F.min(order).alias("f"), F.max(order).alias("l"))
    authors = touches.groupBy("symbol_id", "author").agg(F.count_distinct("commit_sha").alias("commits"))
    rank = F.row_number().over(Window.partitionBy("symbol_id").orderBy(F.desc("commits"), "author"))
    best = authors.withColumn("n", rank).where(F.col("n") <= top).groupBy("symbol_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "author", "commits"))), lambda a: F.struct(a["author"].alias("name"), a["commits"].alias("commits"))).alias("top_authors"))
    out = sums.join(best, "symbol_id")
    return out.select("symbol_id", "churn_30d", "churn_90d", "top_authors", F.col("f.commit_sha").alias("introduced_sha"), F.col("f.ts").alias("introduced_ts"), F.col("l.commit_sha").alias("last_changed_sha"), F.col("l.ts").alias("last_changed_ts"))


def denormalised(graph, aggregates: DataFrame):
    """The graph with churn, authors and dates of its symbols among their attributes."""
    from codelattice.operators.store import set_attrs

    names = ("churn_30d", "churn_90d", "introduced_sha", "introduced_ts", "last_changed_sha", "last_changed_ts", "top_authors")
    return set_attrs(graph, aggregates.select(F.col("symbol_id").alias("id"), F.to_json(F.struct(*names)).alias("patch")))


def seeded(log: DataFrame, symbols: DataFrame, commit_sha: str, ts: int) -> DataFrame:
    """The log with an opening event for each symbol (id) that it doesn't know."""
    new = symbols.select(F.col("id").alias("symbol_id")).distinct().join(log.select("symbol_id"), "symbol_id", "left_anti")
    rows = new.select("symbol_id", F.lit("symbol").alias("entity"), F.lit("opened").alias("event"), F.lit(commit_sha).alias("commit_sha"), F.lit(ts).cast("long").alias("ts"), F.lit(None).cast("string").alias("ref"))
    return record(log, rows)
