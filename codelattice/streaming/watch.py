"""Watching a repository with Structured Streaming.

File events are rows (ts, path).  They are classified by columns (a source file, or git metadata that says that the commit
moved), and a keyed state machine decides when a refresh is due: it remembers the last event that counts and sets a timer for
the end of the debounce, idle or interval time.  Refreshes run in ``foreachBatch``, so never two at once.
"""

from __future__ import annotations

import os
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codelattice.extract.packs import BY_EXTENSION
from codelattice.functions.text import glob_to_regex
from codelattice.sources.repository import EXCLUDED, listed

POLICIES = ("interval", "manual", "on-commit", "on-idle", "on-save")


@dataclass(frozen=True)
class Policy:
    """When a refresh is due: ``on-commit`` and ``on-save`` wait until events have ceased for the debounce, ``on-idle`` for longer; ``interval`` fires at most so often; ``manual`` never."""

    trigger: str = "on-save"
    debounce_ms: int = 2000
    idle_ms: int = 30_000
    interval_ms: int = 300_000

    def __post_init__(self) -> None:
        if self.trigger not in POLICIES:
            raise ValueError(f"no trigger is named {self.trigger}; there are {', '.join(POLICIES)}")

    def counts(self, kind: str) -> bool:
        return self.trigger != "manual" and (self.trigger != "on-commit" or kind == "git")

    def due_at(self, last_event: int, last_fire: int) -> int:
        """The time in ms at which pending events make a refresh due."""
        if self.trigger == "interval":
            return last_fire + self.interval_ms
        return last_event + (self.idle_ms if self.trigger == "on-idle" else self.debounce_ms)


class Machine:
    """The policy's state without a stream: for loops and tests that own the clock (in ms)."""

    def __init__(self, policy: Policy, now: int = 0) -> None:
        self.policy, self.pending, self.last_event, self.last_fire = policy, False, now, now

    def observe(self, kind: str, now: int) -> None:
        if self.policy.counts(kind):
            self.pending, self.last_event = True, now

    def due_in(self, now: int) -> int | None:
        """Milliseconds until a refresh is due, 0 if it is; null if nothing is pending."""
        return max(0, self.policy.due_at(self.last_event, self.last_fire) - now) if self.pending else None

    def fired(self, now: int) -> None:
        self.pending, self.last_fire = False, now


def event_kind(path: Column, exclude: tuple[str, ...] = EXCLUDED) -> Column:
    """``git`` for moved heads and refs, ``file`` for source files, null for all else."""
    moved = path.rlike(r"^\.git/(?:HEAD|packed-refs|refs/.*)$")
    inside = path.rlike(r"^\.git/")
    source = F.concat(F.lit("."), F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*BY_EXTENSION)
    unwanted = path.rlike("|".join(f"(?:{glob_to_regex(g)})" for g in exclude))
    return F.when(moved, "git").when(source & ~inside & ~unwanted, "file")


def branch_is_active(branch: str, wanted: tuple[str, ...] = (), unwanted: tuple[str, ...] = ()) -> bool:
    """Whether a branch is watched: not if a glob excludes it, else if one includes it or none is given."""
    hit = lambda globs: any(re.match(glob_to_regex(g, crosses=True), branch) for g in globs)
    return not hit(unwanted) and (not wanted or hit(wanted))


def current_branch(root: str) -> str:
    try:
        with open(os.path.join(root, ".git", "HEAD"), encoding="utf-8") as f:
            return f.read().strip().removeprefix("ref: refs/heads/")
    except OSError:
        return ""


def ensure_watchable(read_only: bool, central: str) -> None:
    """Shared stores are built by one job, not by everybody's watch loop."""
    if read_only or central:
        raise PermissionError("a store that is read-only or central can't be watched")


# The source -----------------------------------------------------------------


def fingerprints(root: str) -> dict[str, int]:
    """Times of change (ns) of the source files and of git's heads and refs."""
    found = {p: os.stat(os.path.join(root, p)).st_mtime_ns for p, _ in listed(root)}
    git = os.path.join(root, ".git")
    for name in ("HEAD", "packed-refs"):
        if os.path.isfile(at := os.path.join(git, name)):
            found[f".git/{name}"] = os.stat(at).st_mtime_ns
    for folder, _, files in os.walk(os.path.join(git, "refs")):
        found |= {os.path.relpath(os.path.join(folder, f), root): os.stat(os.path.join(folder, f)).st_mtime_ns for f in files}
    return found


class _Span(InputPartition):
    def __init__(self, since: int, until: int) -> None:
        self.since, self.until = since, until


class _Changes(DataSourceStreamReader):
    """Offsets are times: a batch has the files that changed after the last offset and up to now.  Files that are gone are noticed by the next refresh, which compares manifests."""

    def __init__(self, options: dict) -> None:
        self.root = options["path"]
        self.start = int(options.get("since", time.time_ns()))

    def initialOffset(self) -> dict:
        return {"ns": self.start}

    def latestOffset(self) -> dict:
        return {"ns": max([self.start, *fingerprints(self.root).values()])}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Span(start["ns"], end["ns"])]

    def read(self, partition: _Span) -> Iterator[pa.RecordBatch]:
        found = sorted((ns, p) for p, ns in fingerprints(self.root).items() if partition.since < ns <= partition.until)
        stamps = pa.array([ns // 1000 for ns, _ in found], pa.timestamp("us", "UTC"))
        yield pa.RecordBatch.from_arrays([stamps, pa.array([p for _, p in found], pa.string())], ["ts", "path"])


class FileChanges(DataSource):
    """``readStream.format("file_changes").load(root)``: (ts, path) of files as they change."""

    @classmethod
    def name(cls) -> str:
        return "file_changes"

    def schema(self) -> str:
        return "ts timestamp, path string"

    def streamReader(self, schema: object) -> DataSourceStreamReader:
        return _Changes(dict(self.options))


def file_changes(spark: SparkSession, root: str, since_ns: int | None = None) -> DataFrame:
    spark.dataSource.register(FileChanges)
    reader = spark.readStream.format("file_changes")
    return (reader if since_ns is None else reader.option("since", since_ns)).load(root)


# Triggers -------------------------------------------------------------------


def classified(events: DataFrame) -> DataFrame:
    """Events (ts, path, and perhaps repo) with ``kind``; those that mean nothing are left out."""
    named = events if "repo" in events.columns else events.withColumn("repo", F.lit(""))
    return named.withColumn("kind", event_kind(F.col("path"))).where("kind is not null").select("repo", "ts", "path", "kind")


def refreshes(events: DataFrame, policy: Policy) -> DataFrame:
    """(repo, fired_ms, events): one row for each refresh that is due, from a stream of classified events, by processing time."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        last_event, last_fire, count = state.get if state.exists else (0, now, 0)
        fired = None
        if state.hasTimedOut:
            fired = (key[0], now, count)
            last_fire, count = now, 0
        else:
            fresh = sum(int(f["kind"].map(policy.counts).sum()) for f in frames)
            if fresh:
                last_event, count = now, count + fresh
        state.update((last_event, last_fire, count))
        if count:
            state.setTimeoutDuration(max(1, policy.due_at(last_event, last_fire) - now))
        yield pd.DataFrame([fired] if fired else [], columns=["repo", "fired_ms", "events"])

    keyed = events.select("repo", "kind").groupBy("repo")
    return keyed.applyInPandasWithState(step, "repo string, fired_ms long, events long", "last_event long, last_fire long, count long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def sessions(events: DataFrame, gap: str, watermark: str | None = None) -> DataFrame:
    """(repo, opened, closed, events): bursts of events with less than ``gap`` between them, in event time; on a stream with a watermark, each once it is over."""
    timed = events.withWatermark("ts", watermark) if watermark else events
    return timed.groupBy("repo", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events")).select("repo", F.col("w.start").alias("opened"), F.col("w.end").alias("closed"), "events")


def ticks(events: DataFrame, every: str, watermark: str | None = None) -> DataFrame:
    """(repo, opened, events): events of each interval."""
    timed = events.withWatermark("ts", watermark) if watermark else events
    return timed.groupBy("repo", F.window("ts", every).alias("w")).agg(F.count("*").alias("events")).select("repo", F.col("w.start").alias("opened"), "events")


def watch(spark: SparkSession, root: str, refresh: Callable[[], object], policy: Policy, checkpoint: str, wanted: tuple[str, ...] = (), unwanted: tuple[str, ...] = (), read_only: bool = False, central: str = "", poll: str = "1 second"):
    """Starts the loop: a query that calls ``refresh`` whenever the policy says so and the branch is watched."""
    ensure_watchable(read_only, central)

    def due(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty() and branch_is_active(current_branch(root), wanted, unwanted):
            refresh()

    return refreshes(classified(file_changes(spark, root)), policy).writeStream.outputMode("update").foreachBatch(due).option("checkpointLocation", checkpoint).trigger(processingTime=poll).start()


def append_events(stream: DataFrame, table: str, checkpoint: str, once: bool = True):
    """Appends a stream of events to a Parquet log, each once however often it is delivered: the batch drops repeats and what the log holds."""
    from codelattice.model import EVENTS

    spark = stream.sparkSession

    def write(batch: DataFrame, _: int) -> None:
        key = ["symbol_id", "commit_sha", "event", "ref_key"]
        fresh = batch.withColumn("ref_key", F.coalesce("ref", F.lit(""))).dropDuplicates(key)
        path = spark._jvm.org.apache.hadoop.fs.Path(table)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            known = spark.read.schema(EVENTS).parquet(table).withColumn("ref_key", F.coalesce("ref", F.lit("")))
            fresh = fresh.join(known.select(*key), key, "left_anti")
        fresh.select(*EVENTS.names).write.mode("append").parquet(table)

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query.trigger(processingTime="10 seconds")).start()
