"""A working tree as a table of source files.

Spark's file sources pass over names that begin with an underscore, and with them every ``__init__.py``, so this is a
data source of its own: the driver lists names and sizes, and tasks read contents in groups of about equal bytes.  The
tree has to be on storage that all executors see.
"""

from __future__ import annotations

import hashlib
import os
import posixpath
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from codelattice.extract.packs import BY_EXTENSION, pack_of
from codelattice.functions.text import dependency_name, glob_to_regex

EXCLUDED = ("**/.git/**", "**/.lattice/**", "**/.venv/**", "**/dist/**", "**/node_modules/**")
MOST_KB = 1024
GROUP_BYTES = 16 << 20
SCHEMA = "path string, text string, language string, content_hash string, bytes long, skipped boolean"


def listed(root: str, include: Iterable[str] = (), exclude: Iterable[str] = EXCLUDED, endings: Iterable[str] | None = None) -> list[tuple[str, int]]:
    """(path below root, bytes) of the wanted files in order of their paths; excluded folders aren't entered."""
    wanted = [re.compile(glob_to_regex(g)) for g in include]
    unwanted = [re.compile(glob_to_regex(g)) for g in exclude]
    ends = tuple(BY_EXTENSION if endings is None else endings)
    found, folders = [], [""]
    while folders:
        folder = folders.pop()
        with os.scandir(os.path.join(root, folder)) as entries:
            for e in entries:
                path = posixpath.join(folder, e.name)
                if e.is_dir(follow_symlinks=False):
                    if not any(r.match(f"{path}/x") for r in unwanted):
                        folders.append(path)
                elif e.is_file() and path.endswith(ends) and not any(r.match(path) for r in unwanted) and (not wanted or any(r.match(path) for r in wanted)):
                    found.append((path, e.stat().st_size))
    return sorted(found)


def grouped(files: list[tuple[str, int]], limit: int = GROUP_BYTES) -> list[list[tuple[str, int]]]:
    groups: list[list[tuple[str, int]]] = []
    room = 0
    for f in files:
        if not groups or room < f[1] or len(groups[-1]) >= 5000:
            groups.append([])
            room = limit
        groups[-1].append(f)
        room -= f[1]
    return groups


class _Group(InputPartition):
    def __init__(self, files: list[tuple[str, int]]) -> None:
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        split = lambda key, default: [x for x in options.get(key, default).split("\n") if x]
        self.root, self.most = options["path"], 1024 * int(options.get("most_kb", MOST_KB))
        self.include, self.exclude = split("include", ""), split("exclude", "\n".join(EXCLUDED))
        self.endings = split("endings", "") or None

    def partitions(self) -> list[InputPartition]:
        return [_Group(g) for g in grouped(listed(self.root, self.include, self.exclude, self.endings))] or [_Group([])]

    def read(self, partition: _Group) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        types = [pa.string()] * 4 + [pa.int64(), pa.bool_()]
        for a in range(0, max(1, len(partition.files)), 200):
            rows = [self._row(path, size) for path, size in partition.files[a : a + 200]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 6, types, strict=True)], names)

    def _row(self, path: str, size: int) -> tuple:
        pack = pack_of(path)
        slug = pack.slug if pack else None
        if size > self.most:
            return path, None, slug, None, size, True
        with open(os.path.join(self.root, path), "rb") as f:
            data = f.read()
        return path, data.decode(errors="replace"), slug, hashlib.sha256(data).hexdigest(), size, False


class RepositorySource(DataSource):
    """``spark.read.format("repository").load(root)``; options include, exclude and endings (one to a line) and most_kb."""

    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(dict(self.options))


def source_files(spark: SparkSession, root: str, include: Iterable[str] = (), exclude: Iterable[str] = EXCLUDED, most_kb: int = MOST_KB, endings: Iterable[str] = ()) -> DataFrame:
    """(path, text, language, content_hash, bytes, skipped) of a tree's source files; those over ``most_kb`` are skipped: they have no text."""
    spark.dataSource.register(RepositorySource)
    lists = {"include": include, "exclude": exclude, "endings": endings}
    return spark.read.format("repository").options(most_kb=most_kb, **{k: "\n".join(v) for k, v in lists.items()}).load(root)


def languages(spark: SparkSession) -> DataFrame:
    """(extension, slug, language) of all packs."""
    return spark.createDataFrame([(e, p.slug, p.language) for e, p in sorted(BY_EXTENSION.items())], "extension string, slug string, language string")


def go_module(root: str) -> str:
    """The module path that go.mod names; empty without one."""
    try:
        with open(os.path.join(root, "go.mod"), encoding="utf-8", errors="replace") as f:
            found = re.search(r"^\s*module\s+(\S+)", f.read(), re.M)
    except OSError:
        return ""
    return found[1].strip('"') if found else ""


# Documents ------------------------------------------------------------------

DECISION_GLOBS = ("**/adr/**/*.md", "**/adrs/**/*.md", "**/decisions/**/*.md")
DOCUMENT_GLOBS = ("**/*.md",)
NOT_DECISIONS = ("changelog", "contributing", "index", "readme", "template")


def documents(spark: SparkSession, root: str, globs: Iterable[str] = DOCUMENT_GLOBS, but: DataFrame | None = None) -> DataFrame:
    """(path, text, content_hash) of Markdown files by glob, without the paths in ``but``."""
    found = source_files(spark, root, globs, endings=(".md", ".markdown")).where("not skipped").select("path", "text", "content_hash")
    return found if but is None else found.join(but.select("path"), "path", "left_anti")


def decision_files(spark: SparkSession, root: str, globs: Iterable[str] = DECISION_GLOBS) -> DataFrame:
    """Decision records: Markdown files by glob that aren't a folder's readme, index or template; each once, whatever globs match it."""
    stem = F.lower(F.regexp_extract("path", r"([^/]*?)\.[^./]+$", 1))
    return documents(spark, root, globs).where(~stem.isin(*NOT_DECISIONS) & ~stem.contains("template"))


# Manifests and frameworks ---------------------------------------------------

_MANIFESTS = re.compile(r"(?:^|/)(?:pyproject\.toml|requirements[^/]*\.txt|package\.json|go\.mod|composer\.json|Gemfile|pom\.xml|build\.gradle(?:\.kts)?|[^/]+\.csproj)$")


def manifest_names(path: str, text: str) -> set[str]:
    """Names of the packages that a manifest depends on, normalised; what can't be parsed names none."""
    import json
    import tomllib

    base = posixpath.basename(path)
    found: list[str] = []
    try:
        if base == "pyproject.toml":
            data = tomllib.loads(text)
            project = data.get("project", {})
            found = [*project.get("dependencies", []), *(d for group in project.get("optional-dependencies", {}).values() for d in group)]
            poetry = data.get("tool", {}).get("poetry", {})
            found += [*poetry.get("dependencies", {}), *(d for g in poetry.get("group", {}).values() for d in g.get("dependencies", {}))]
        elif base.endswith(".json"):
            data = json.loads(text)
            found = [n for key in ("dependencies", "devDependencies", "require", "require-dev") for n in data.get(key) or {}]
            return {n.lower() for n in found}
        elif base == "go.mod":
            return set(re.findall(r"^\s*(?:require\s+)?([\w.-]+\.[\w.-]+/\S+)\s+v", text, re.M))
        elif base == "Gemfile":
            found = re.findall(r"^\s*gem\s+['\"]([^'\"]+)", text, re.M)
        elif base.endswith(".csproj"):
            found = re.findall(r"Include=\"([^\"]+)\"", text) + re.findall(r"Sdk=\"([^\"]+)\"", text)
            return {n.lower() for n in found} | {".".join(n.lower().split(".")[:2]) for n in found}
        elif base == "pom.xml" or base.startswith("build.gradle"):
            return set(re.findall(r"<artifactId>([^<]+)</artifactId>", text)) | set(re.findall(r"['\"][\w.-]+:([\w.-]+)", text))
        else:
            found = text.splitlines()
    except (ValueError, AttributeError, TypeError):
        return set()
    names = (re.match(r"\s*([A-Za-z0-9_.-]+)", str(d)) for d in found)
    return {m[1].lower().replace("_", "-") for m in names if m and not str(m[0]).lstrip().startswith("-")}


def dependencies(root: str, exclude: Iterable[str] = EXCLUDED) -> set[str]:
    """Packages that any manifest of the tree depends on."""
    out: set[str] = set()
    for path, _ in listed(root, exclude=exclude, endings=("",)):
        if _MANIFESTS.search(path):
            with open(os.path.join(root, path), encoding="utf-8", errors="replace") as f:
                out |= manifest_names(path, f.read())
    return out


def requirement_names(lines: DataFrame) -> DataFrame:
    """(name) of requirement lines (line), by column functions."""
    name = dependency_name(F.col("line"))
    return lines.where(~F.trim("line").startswith("-")).select(name.alias("name")).where("name <> ''").distinct()


SAMPLE_BYTES = 256 << 10


def source_sample(files: DataFrame, most: int = SAMPLE_BYTES) -> DataFrame:
    """The files (path, text, bytes) that fill ``most`` bytes in order of their paths; the first one always."""
    before = F.coalesce(F.sum("bytes").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    narrow = files.select("path", "bytes").withColumn("before", before).where(F.col("before") < most).select("path")
    return files.join(narrow, "path", "left_semi")


def active_frameworks(files: DataFrame, depends: Iterable[str], mode: str | Iterable[str] = "auto", forced: Iterable[str] = ()) -> list[str]:
    """Names of the framework packs to run: none (``off``), those listed, or those that a dependency or a marker in any source file speaks for."""
    from codelattice.extract.frameworks import PACKS

    if mode == "off":
        return sorted(set(forced))
    if mode != "auto":
        unknown = set(mode) - PACKS.keys()
        if unknown:
            raise ValueError(f"no framework pack is named {sorted(unknown)}")
        return sorted({*mode, *forced})
    depends = set(depends)
    known = {n for n, p in PACKS.items() if depends & set(p.dependencies)}
    rest = [p for n, p in PACKS.items() if n not in known]
    seen = files.agg(*(F.max(F.col("language").isin(*p.slugs) & F.greatest(F.lit(False), *(F.col("text").contains(m) for m in p.markers))).alias(p.name) for p in rest)).first() if rest else {}
    return sorted(known | {p.name for p in rest if seen[p.name]} | set(forced))


SPEC_NAMES = ("openapi.json", "openapi.yaml", "openapi.yml", "swagger.json", "swagger.yaml")


def openapi(spark: SparkSession, root: str) -> DataFrame:
    """(path, spec) of the first API description at the root, as JSON; none without one, or where it can't be parsed."""
    import json

    import yaml

    for name in SPEC_NAMES:
        at = os.path.join(root, name)
        if os.path.isfile(at):
            with open(at, encoding="utf-8", errors="replace") as f:
                try:
                    data = yaml.safe_load(f)  # JSON is YAML
                except yaml.YAMLError:
                    data = None
            rows = [(name, json.dumps(data, default=str))] if isinstance(data, dict) else []
            return spark.createDataFrame(rows, "path string, spec string")
    return spark.createDataFrame([], "path string, spec string")
