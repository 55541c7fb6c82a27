"""Git as tables: file trees at a commit, hunks and messages of the log, and what changed between two commits.

Listings of commits and names are small and made by the driver; contents, diffs and messages are read by tasks, a group
of objects or commits each, from a repository on storage that all executors see.
"""

from __future__ import annotations

import hashlib
import re
import subprocess
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from codelattice.extract.packs import pack_of
from codelattice.sources.repository import EXCLUDED, MOST_KB, SCHEMA, grouped

COMMITS_AT_ONCE = 100
HUNKS = "commit_sha string, author string, ts long, path string, start int, length int, delta int"
MESSAGES = "commit_sha string, author string, ts long, subject string, body string, paths array<string>"


def git(repo: str, *args: str, data: bytes | None = None) -> bytes:
    done = subprocess.run(["git", "-C", repo, "-c", "core.quotepath=off", *args], input=data, capture_output=True, check=False)
    if done.returncode:
        raise RuntimeError(f"git {args[0]} failed: {done.stderr.decode(errors='replace').strip()[:500]}")
    return done.stdout


def head(repo: str) -> str:
    return git(repo, "rev-parse", "HEAD").decode().strip()


def commits(repo: str, last: int | None = None, until: str = "HEAD") -> list[tuple[str, int]]:
    """(sha, ts) of the first-parent history, oldest first; with ``last`` only so many and the one before them."""
    limit = [] if last is None else [f"-n{last + 1}"]
    lines = git(repo, "log", "--first-parent", "--format=%H %ct", *limit, until).decode().split("\n")
    return [(sha, int(ts)) for sha, ts in (x.split() for x in reversed(lines) if x)]


def changed_paths(repo: str, parent: str | None, commit: str) -> list[tuple[str, str, str | None]]:
    """(path, status, old_path) between two commits: added, modified, removed or renamed; everything is added without a parent."""
    if parent is None:
        return [(p, "added", None) for p in git(repo, "ls-tree", "-r", "-z", "--name-only", commit).decode(errors="replace").split("\0") if p]
    fields = git(repo, "diff", "--name-status", "-M", "-z", parent, commit).decode(errors="replace").split("\0")
    out, i = [], 0
    while i + 1 < len(fields):
        status = fields[i][:1]
        if status in "RC":
            out.append((fields[i + 2], "renamed" if status == "R" else "added", fields[i + 1] if status == "R" else None))
            i += 3
        else:
            out.append((fields[i + 1], {"A": "added", "D": "removed"}.get(status, "modified"), None))
            i += 2
    return out


def renames(spark: SparkSession, repo: str, base: str, commit: str = "HEAD") -> DataFrame:
    """(old_path, path) of the renames that git finds."""
    rows = [(old, path) for path, status, old in changed_paths(repo, base, commit) if status == "renamed"]
    return spark.createDataFrame(rows, "old_path string, path string")


class _Part(InputPartition):
    def __init__(self, items: list) -> None:
        self.items = items


class _Blobs(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.repo, self.commit, self.most = options["path"], options.get("commit", "HEAD"), 1024 * int(options.get("most_kb", MOST_KB))
        self.only = {x for x in options.get("only", "").split("\n") if x} if "only" in options else None

    def partitions(self) -> list[InputPartition]:
        files = []
        for line in git(self.repo, "ls-tree", "-r", "-l", "-z", self.commit).decode(errors="replace").split("\0"):
            if m := re.match(r"(\d+) blob (\w+)\s+(\d+)\t(.*)", line, re.S):
                path, folders = m[4], m[4].split("/")[:-1]
                if pack_of(path) and not {f.strip("*/") for f in EXCLUDED} & set(folders) and (self.only is None or path in self.only):
                    files.append(((path, m[2]), int(m[3])))
        return [_Part(g) for g in grouped(sorted(files))] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        wanted = [(path, sha, size) for (path, sha), size in partition.items]
        small = [w for w in wanted if w[2] <= self.most]
        data, at, texts = git(self.repo, "cat-file", "--batch", data="".join(f"{sha}\n" for _, sha, _ in small).encode()), 0, {}
        for path, _, size in small:
            at = data.index(b"\n", at) + 1
            texts[path] = data[at : at + size]
            at += size + 1
        rows = []
        for path, _, size in wanted:
            content = texts.get(path)
            rows.append((path, None if content is None else content.decode(errors="replace"), pack_of(path).slug, None if content is None else hashlib.sha256(content).hexdigest(), size, content is None))
        types = [pa.string()] * 4 + [pa.int64(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 6, types, strict=True)], [f.split()[0] for f in SCHEMA.split(", ")])


class GitBlobSource(DataSource):
    """``spark.read.format("git_blobs").option("commit", sha).load(repo)``: source files at a commit, without a checkout."""

    @classmethod
    def name(cls) -> str:
        return "git_blobs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _Blobs(dict(self.options))


_HUNK = re.compile(rb"^@@ -\d+(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def parsed_hunks(log: bytes) -> Iterator[tuple[str, str, int, str, int, int, int]]:
    """Rows of HUNKS from ``git log -U0`` whose headers are lines of SOH, sha, SOH, author, SOH and time."""
    sha, author, ts, path = "", "", 0, ""
    for line in log.split(b"\n"):
        if line[:1] == b"\x01":
            _, s, a, t = line.split(b"\x01")[:4]
            sha, author, ts, path = s.decode(), a.decode(errors="replace"), int(t), ""
        elif line.startswith(b"+++ "):
            name = line[4:].decode(errors="replace").strip('"')
            path = name[2:] if name.startswith("b/") else ""
        elif path and (m := _HUNK.match(line)):
            removed, start, added = int(m[1] or 1), int(m[2]), int(m[3] or 1)
            yield sha, author, ts, path, start, added, removed + added


class _Log(DataSourceReader):
    def __init__(self, options: dict, what: str) -> None:
        self.repo, self.what = options["path"], what
        self.since, self.last = options.get("since", ""), options.get("last", "")

    def partitions(self) -> list[InputPartition]:
        bounds = ([f"--since={self.since}"] if self.since else []) + ([f"-n{self.last}"] if self.last else [])
        shas = git(self.repo, "log", "--no-merges", "--format=%H", *bounds).decode().split()
        return [_Part(shas[i : i + COMMITS_AT_ONCE]) for i in range(0, len(shas), COMMITS_AT_ONCE)] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        schema = HUNKS if self.what == "hunks" else MESSAGES
        kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
        rows: list[tuple] = []
        if partition.items:
            wanted = "\n".join(partition.items).encode() + b"\n"
            if self.what == "hunks":
                rows = list(parsed_hunks(git(self.repo, "log", "--no-walk=unsorted", "--stdin", "-U0", "--no-color", "--no-ext-diff", "--format=%x01%H%x01%an%x01%ct", data=wanted)))
            else:
                text = git(self.repo, "log", "--no-walk=unsorted", "--stdin", "--name-only", "--format=%x1e%H%x1f%an%x1f%ct%x1f%s%x1f%b%x1f", data=wanted).decode(errors="replace")
                for record in text.split("\x1e")[1:]:
                    sha, author, ts, subject, body, names = record.split("\x1f")
                    rows.append((sha, author, int(ts), subject, body.strip(), [n for n in names.split("\n") if n]))
        columns = [f.split() for f in schema.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(list(zip(*rows, strict=True)) or [()] * len(columns), columns, strict=True)], [n for n, _ in columns])


class GitHunkSource(DataSource):
    """``format("git_hunks")``: each changed range of lines of each commit since ``since``."""

    @classmethod
    def name(cls) -> str:
        return "git_hunks"

    def schema(self) -> str:
        return HUNKS

    def reader(self, schema: object) -> DataSourceReader:
        return _Log(dict(self.options), "hunks")


class GitMessageSource(DataSource):
    """``format("git_messages")``: the last ``last`` commits with their messages and the paths that they touch."""

    @classmethod
    def name(cls) -> str:
        return "git_messages"

    def schema(self) -> str:
        return MESSAGES

    def reader(self, schema: object) -> DataSourceReader:
        return _Log(dict(self.options), "messages")


def blobs(spark: SparkSession, repo: str, commit: str = "HEAD", only: Iterable[str] | None = None) -> DataFrame:
    """Source files at a commit, as ``source_files`` has them for a tree; with ``only`` those paths."""
    spark.dataSource.register(GitBlobSource)
    reader = spark.read.format("git_blobs").option("commit", commit)
    return (reader if only is None else reader.option("only", "\n".join(only) or "\0")).load(repo)


def hunks(spark: SparkSession, repo: str, since: str = "") -> DataFrame:
    spark.dataSource.register(GitHunkSource)
    return spark.read.format("git_hunks").option("since", since).load(repo)


def messages(spark: SparkSession, repo: str, last: int = 500) -> DataFrame:
    spark.dataSource.register(GitMessageSource)
    return spark.read.format("git_messages").option("last", last).load(repo)


def checkout(url: str, folder: str, ref: str = "", fetch: bool = True, shallow: bool = True) -> str:
    """A clone of ``url`` in ``folder`` at ``ref``, made or brought up to date; its commit."""
    import os

    depth = ["--depth", "1"] if shallow else []
    if not os.path.isdir(os.path.join(folder, ".git")):
        subprocess.run(["git", "clone", "--quiet", *depth, *(["--branch", ref] if ref else []), "--", url, folder], check=True, capture_output=True)
    elif fetch:
        git(folder, "fetch", "--quiet", *depth, "origin", ref or "HEAD")
        git(folder, "checkout", "--quiet", "--detach", "FETCH_HEAD")
    return head(folder)
