"""The graph store's operations as functions from graphs to graphs or DataFrames, and a versioned store of snapshots.

A bag of edges stays a bag; a node's id is unique, and the later of two versions wins.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelattice.lineage import cut
from codelattice.model import EDGES, NODES, STORE_FLOOR, Graph


def _ids(spark: SparkSession, ids: DataFrame | Iterable[str], name: str = "id") -> DataFrame:
    """One column of ids, from a DataFrame's first column or from a few values."""
    return ids.select(F.col(ids.columns[0]).alias(name)).distinct() if isinstance(ids, DataFrame) else spark.createDataFrame([(i,) for i in set(ids)], f"{name} string")


def _in(column: str, values: Iterable[str] | None) -> Column:
    return F.lit(True) if values is None else F.col(column).isin(*values)


def with_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends exist."""
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select(*EDGES.names)


def _merged(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.join(new.select("id"), "id", "left_anti").select(*NODES.names).union(new.select(*NODES.names))


def upsert(graph: Graph, file: Graph, path: str) -> Graph:
    """Replaces what the file at ``path`` owns.

    Its nodes are merged by id; nodes that it no longer has go with all their edges; its edges are replaced. Other files'
    edges to nodes that stay are kept.
    """
    nodes = file.nodes.withColumn("origin_path", F.lit(path)).select(*NODES.names)
    edges = file.edges.withColumn("origin_path", F.lit(path)).select(*EDGES.names)
    gone = graph.nodes.where(F.col("origin_path") == path).join(nodes.select("id"), "id", "left_anti").select("id")
    kept = graph.nodes.join(gone, "id", "left_anti")
    merged = _merged(kept, nodes)
    rest = _detached(graph.edges.where(F.col("origin_path") != path), gone)
    return Graph(merged, rest.union(with_endpoints(edges, merged)))


def _detached(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti").select(*EDGES.names)


def add(graph: Graph, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> Graph:
    """Adds facts that no file owns: nodes are merged (which detaches them from their file), edges appended without a check for equal ones."""
    merged = graph.nodes if nodes is None else _merged(graph.nodes, nodes.withColumn("origin_path", F.lit("")))
    return Graph(merged, graph.edges if edges is None else graph.edges.select(*EDGES.names).union(with_endpoints(edges.select(*EDGES.names), merged)))


def delete_file(graph: Graph, path: str) -> Graph:
    """Without the file's nodes, their edges, and the file's edges."""
    gone = graph.nodes.where(F.col("origin_path") == path).select("id")
    return Graph(graph.nodes.where(F.col("origin_path") != path), _detached(graph.edges.where(F.col("origin_path") != path), gone))


def find(graph: Graph, kinds: Iterable[str] | None = None, name: str | None = None, path_prefix: str | None = None, min_source: str | None = None, limit: int | None = None) -> DataFrame:
    """Nodes by kind, exact name, path prefix and least provenance, by id; with ``limit``, one row more tells that some were cut."""
    out = graph.nodes.where(_in("kind", kinds))
    if name is not None:
        out = out.where(F.col("name") == name)
    if path_prefix is not None:
        out = out.where(F.col("sym_path").startswith(path_prefix))
    if min_source is not None:
        out = out.where(F.col("prov_source").isin(*(s for s, rank in STORE_FLOOR.items() if rank >= STORE_FLOOR[min_source])))
    return out if limit is None else out.orderBy("id").limit(limit + 1)


def get(graph: Graph, ids: DataFrame | Iterable[str]) -> DataFrame:
    return graph.nodes.join(_ids(graph.nodes.sparkSession, ids), "id", "left_semi")


def hops(edges: DataFrame, kinds: Iterable[str] | None = None, direction: str = "both") -> DataFrame:
    """(from, to) for each edge, in the given direction; both directions for ``both``, a self-loop once."""
    edges = edges.where(_in("kind", kinds))
    out = edges.select(F.col("src").alias("from"), F.col("dst").alias("to"))
    back = edges.select(F.col("dst").alias("from"), F.col("src").alias("to"))
    return out if direction == "out" else back if direction == "in" else out.union(back.where("from <> to"))


def adjacent(graph: Graph, ids: DataFrame | Iterable[str], kinds: Iterable[str] | None = None, direction: str = "both") -> DataFrame:
    """The edges at the given nodes, as a bag; a self-loop, or an edge between two of them, once."""
    at = _ids(graph.edges.sparkSession, ids, "at").withColumn("is_at", F.lit(True))
    edges = graph.edges.where(_in("kind", kinds))
    if direction != "both":
        return edges.join(at.select(F.col("at").alias("src" if direction == "out" else "dst")), "src" if direction == "out" else "dst", "left_semi").select(*EDGES.names)
    flagged = edges.join(at.withColumnsRenamed({"at": "src", "is_at": "s"}), "src", "left").join(at.withColumnsRenamed({"at": "dst", "is_at": "d"}), "dst", "left")
    return flagged.where("s or d").select(*EDGES.names)


def neighbors(graph: Graph, ids: DataFrame | Iterable[str], kinds: Iterable[str] | None = None, depth: int = 1, direction: str = "both") -> DataFrame:
    """(start, id, depth): nodes within ``depth`` hops of each start, with their distance; the start is left out."""
    step = hops(graph.edges, kinds, direction).distinct()
    seen = frontier = _ids(graph.edges.sparkSession, ids).select(F.col("id").alias("start"), "id", F.lit(0).alias("depth"))
    for d in range(1, depth + 1):
        found = frontier.select("start", F.col("id").alias("from")).join(step, "from").select("start", F.col("to").alias("id")).distinct()
        frontier = found.join(seen, ["start", "id"], "left_anti").withColumn("depth", F.lit(d))
        if depth > 1:
            frontier = cut(frontier)
        seen = seen.union(frontier)
    return seen.where("depth > 0")


def expand(graph: Graph, refs: DataFrame | Iterable[str], kinds: Iterable[str] | None = None, depth: int = 1) -> DataFrame:
    """The given nodes and all within ``depth`` hops of one of them, each once."""
    refs = _ids(graph.nodes.sparkSession, refs)
    return get(graph, neighbors(graph, refs, kinds, depth).select("id").union(refs))


def set_attrs(graph: Graph, patches: DataFrame) -> Graph:
    """Merges (id, patch JSON) into attributes, one level deep, the patch winning; ids that don't exist are ignored.  The keys end up sorted."""
    both = graph.nodes.join(patches.select("id", F.col("patch").alias("__patch")), "id", "left")
    parsed = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    raw = lambda c: F.map_from_entries(F.transform(F.map_keys(parsed(c)), lambda k: F.struct(k.alias("key"), _json_text(c, k).alias("value"))))
    old, new = raw(F.col("attrs")), raw(F.col("__patch"))
    merged = F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)
    text = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(merged)), lambda e: F.concat(F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(":"), e["value"])), ","), F.lit("}"))
    return graph.with_nodes(both.withColumn("attrs", F.when(F.col("__patch").isNull(), F.col("attrs")).otherwise(text)).select(*NODES.names))


def _json_text(document: Column, key: Column) -> Column:
    """A value of an object as JSON text, so that types survive."""
    return F.coalesce(F.to_json(F.try_variant_get(F.try_parse_json(document), F.concat(F.lit("$['"), key, F.lit("']")), "variant")), F.lit("null"))


def clear_resolved(graph: Graph, paths: DataFrame | Iterable[str]) -> Graph:
    """Without resolved edges of the given files, and then without packages that nothing points to."""
    paths = _ids(graph.edges.sparkSession, paths, "origin_path")
    rest = graph.edges.where(F.coalesce(F.col("prov_source") != "resolved", F.lit(True))).select(*EDGES.names)
    kept = rest.union(graph.edges.where(F.col("prov_source") == "resolved").join(paths, "origin_path", "left_anti").select(*EDGES.names))
    packages = graph.nodes.where(F.col("kind") == "Package").select("id").join(kept.select(F.col("dst").alias("id")), "id", "left_anti")
    return Graph(graph.nodes.join(packages, "id", "left_anti").select(*NODES.names), _detached(kept, packages))


def clear_outgoing(graph: Graph, ids: DataFrame | Iterable[str], kind: str) -> Graph:
    """Without the edges of a kind that leave the given nodes."""
    at = _ids(graph.edges.sparkSession, ids, "src")
    return graph.with_edges(graph.edges.where(F.col("kind") != kind).union(graph.edges.where(F.col("kind") == kind).join(at, "src", "left_anti").select(*graph.edges.columns)))


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of the rows with the same key, the one that is last in ``order``."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


class SnapshotStore:
    """Graphs in Parquet snapshots below a folder; numbered pointer files name them, and the highest number is current.

    A pointer is written under another name and renamed to its number last, so readers always find a whole one: a write that is
    lost half-way leaves them where they were, and of two writers at once the second fails.  Old snapshots stay for readers
    that still hold them until ``vacuum``.  ``SCHEMA`` guards against snapshots of another layout.
    """

    SCHEMA = 1

    def __init__(self, spark: SparkSession, folder: str, read_only: bool = False) -> None:
        self.spark, self.folder, self.read_only = spark, folder.rstrip("/"), read_only

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        fs, pointers = self._fs(), self._path("pointers")
        if not fs.exists(pointers):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(pointers)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())

    def _pointer(self, number: int) -> dict:
        stream = self._fs().open(self._path(f"pointers/{number:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def current(self) -> dict | None:
        numbers = self._numbers()
        if not numbers:
            return None
        pointer = self._pointer(numbers[-1])
        if pointer["schema"] != self.SCHEMA:
            raise ValueError(f"the store has schema {pointer['schema']}, this engine {self.SCHEMA}: rebuild it")
        return pointer

    def read(self) -> Graph:
        pointer = self.current()
        if pointer is None:
            return Graph(self.spark.createDataFrame([], NODES), self.spark.createDataFrame([], EDGES))
        at = f"{self.folder}/{pointer['snapshot']}"
        return Graph(self.spark.read.schema(NODES).parquet(f"{at}/nodes").select(*NODES.names), self.spark.read.schema(EDGES).parquet(f"{at}/edges").select(*EDGES.names))

    def table(self, name: str) -> DataFrame | None:
        """A table that was written beside the graph; null without one."""
        pointer = self.current()
        if pointer is None or name not in pointer.get("tables", ()):
            return None
        return self.spark.read.parquet(f"{self.folder}/{pointer['snapshot']}/{name}")

    def write(self, graph: Graph, tables: dict[str, DataFrame] | None = None, **meta: object) -> None:
        """A new snapshot of the graph and of tables beside it.  Nodes lie by kind, so a label's scan prunes; edges are clustered by kind and source."""
        if self.read_only:
            raise PermissionError("the store was opened read-only")
        number = (self._numbers() or [0])[-1] + 1
        snapshot = f"v-{uuid.uuid4().hex}"
        graph.nodes.select(*NODES.names).write.partitionBy("kind").parquet(f"{self.folder}/{snapshot}/nodes")
        graph.edges.select(*EDGES.names).sortWithinPartitions("kind", "src").write.partitionBy("kind").parquet(f"{self.folder}/{snapshot}/edges")
        for name, table in (tables or {}).items():
            table.write.parquet(f"{self.folder}/{snapshot}/{name}")
        fs, made = self._fs(), self._path(f"pointers/{snapshot}.tmp")
        out = fs.create(made, True)
        out.write(bytearray(json.dumps(meta | {"schema": self.SCHEMA, "snapshot": snapshot, "tables": sorted(tables or {})}).encode()))
        out.close()
        target = self._path(f"pointers/{number:012d}.json")
        if fs.exists(target) or not fs.rename(made, target):
            fs.delete(made, False)
            raise RuntimeError(f"another writer made snapshot {number}")

    def vacuum(self, keep: int = 2) -> int:
        """Deletes all but the last ``keep`` snapshots; how many went."""
        old, fs = self._numbers()[:-keep] if keep > 0 else [], self._fs()
        for number in old:
            snapshot = self._pointer(number)["snapshot"]
            fs.delete(self._path(f"pointers/{number:012d}.json"), False)
            fs.delete(self._path(snapshot), True)
        return len(old)
