"""Watching: classification, policies by their own clock, and the streams."""

import os
import time

import pytest
from pyspark.sql import functions as F

import repos
from codelattice.model import EVENTS
from codelattice.streaming import watch


def test_events_are_classified(spark):
    paths = [".git/HEAD", ".git/refs/heads/main", ".git/packed-refs", ".git/index", "a/x.py", "a/x.txt", "node_modules/x.js", "dist/y.ts", "b.RB", "c.rb"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string").select("path", watch.event_kind(F.col("path")).alias("k")).collect()
    assert {r["path"]: r["k"] for r in rows if r["k"]} == {".git/HEAD": "git", ".git/refs/heads/main": "git", ".git/packed-refs": "git", "a/x.py": "file", "c.rb": "file"}


def test_policies_by_their_own_clock():
    save = watch.Machine(watch.Policy("on-save", debounce_ms=100))
    assert save.due_in(0) is None
    save.observe("file", 10)
    save.observe("file", 60)
    assert (save.due_in(100), save.due_in(160), save.due_in(500)) == (60, 0, 0)
    save.fired(160)
    assert save.due_in(170) is None
    commit = watch.Machine(watch.Policy("on-commit", debounce_ms=100))
    commit.observe("file", 0)
    assert commit.due_in(1000) is None
    commit.observe("git", 1000)
    assert commit.due_in(1040) == 60
    idle, interval, manual = (watch.Machine(watch.Policy(t, idle_ms=500, interval_ms=1000)) for t in ("on-idle", "interval", "manual"))
    for m in (idle, interval, manual):
        m.observe("file", 100)
    assert (idle.due_in(200), interval.due_in(200), manual.due_in(200)) == (400, 800, None)
    with pytest.raises(ValueError, match="no trigger"):
        watch.Policy("sometimes")


def test_branches_and_guard(tmp_path):
    assert watch.branch_is_active("main") and watch.branch_is_active("feature/x", ("feature/*",)) and not watch.branch_is_active("main", ("feature/*",))
    assert not watch.branch_is_active("feature/x", ("feature/*",), ("*/x",))
    for how in ((True, ""), (False, "/central")):
        with pytest.raises(PermissionError):
            watch.ensure_watchable(*how)
    repos.commit(repos.write(tmp_path, {"a.py": "x = 1\n"}), "feat: a", 1_750_000_000)
    assert watch.current_branch(str(tmp_path)) == "main" and {"a.py", ".git/HEAD", ".git/refs/heads/main"} <= watch.fingerprints(str(tmp_path)).keys()


def test_file_changes_stream(spark, tmp_path):
    root = repos.write(tmp_path / "r", {"a.py": "x = 1\n", "b.txt": "no"})
    stream = watch.classified(watch.file_changes(spark, str(root), 1))
    query = stream.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
        repos.write(root, {"b.py": "y = 1\n"})
        later = time.time_ns() + 10**9
        os.utime(root / "b.py", ns=(later, later))
        query.processAllAvailable()
    finally:
        query.stop()
    assert [(r["path"], r["kind"]) for r in spark.table("seen").orderBy("ts").collect()] == [("a.py", "file"), ("b.py", "file")]


def test_a_watch_refreshes_once_a_burst(spark, tmp_path):
    root = repos.write(tmp_path / "r", {"a.py": "x = 1\n"})
    fired = []
    query = watch.watch(spark, str(root), lambda: fired.append(time.time()), watch.Policy("on-save", debounce_ms=500), str(tmp_path / "c"), poll="500 milliseconds")
    try:
        end = time.time() + 90
        while time.time() < end and not fired:
            for name in ("a.py", "b.py"):
                (root / name).write_text(f"x = {time.time()}\n")
            pause = time.time() + 15
            while time.time() < pause and not fired:
                time.sleep(0.5)
    finally:
        query.stop()
    assert fired


def test_event_log_is_idempotent(spark, tmp_path):
    rows = [("s", "symbol", "opened", "c1", 1, None), ("s", "symbol", "opened", "c1", 1, None), ("s", "symbol", "closed", "c2", 2, "r")]
    log = str(tmp_path / "log")
    for n in (1, 2):
        spark.createDataFrame(rows[: n + 1], EVENTS).write.parquet(str(tmp_path / "in" / str(n)))
        watch.append_events(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in" / str(n))), log, str(tmp_path / f"c{n}")).awaitTermination()
    assert sorted((r["event"], r["ref"]) for r in spark.read.parquet(log).collect()) == [("closed", "r"), ("opened", None)]
