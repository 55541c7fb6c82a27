"""A property-graph view of relational tables.

Each node and edge kind is one projection of one table, written in SQL that Spark and DuckDB share, so the same
expressions make the DataFrames here and the common table expressions of the registered SQL.  A filter on ``kind`` meets
a literal in every branch, so Catalyst drops the branches, and scans, that can't match.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from codelattice.model import EDGES, NODES, Graph


def node_id(table: str, key: str) -> str:
    return f"'lat sql tables ' || '{table}/' || CAST({key} AS STRING) || ' ' || '{table}#'"


def _node(table: str, kind: str, key: str, name: str, start: str = "CAST(NULL AS BIGINT)", end: str = "CAST(NULL AS BIGINT)", attrs: str = "'{}'", path: str | None = None, source: str = "'parsed'", confidence: str = "1.0", label: str | None = None) -> tuple[str, list[str]]:
    at = path or f"'{table}/' || CAST({key} AS STRING)"
    values = [node_id(label or table, key), f"'{kind}'", name, start, end, attrs, at, source, "'tables@1'", "'c0'", f"CAST({confidence} AS DOUBLE)", at]
    return table, [f"{v} AS {f.name}" for v, f in zip(values, NODES.fields, strict=True)]


_FLAG = "CASE l_returnflag WHEN 'A' THEN 'parsed' WHEN 'N' THEN 'resolved' ELSE 'llm' END"
_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'parsed' WHEN 'O' THEN 'resolved' ELSE 'llm' END"

NODE_SPECS = [
    _node("region", "Repository", "r_regionkey", "r_name"),
    _node("nation", "Package", "n_nationkey", "n_name"),
    _node("customer", "Class", "c_custkey", "c_name", attrs="'{\"segment\":\"' || c_mktsegment || '\",\"layer\":{\"nation\":\"' || CAST(c_nationkey AS STRING) || '\"}}'", start="c_custkey", end="c_custkey + 10"),
    _node("supplier", "Service", "s_suppkey", "s_name"),
    _node("orders", "Function", "o_orderkey", "CAST(o_orderkey AS STRING)", start="o_orderkey", end="o_orderkey + 5", source=_STATUS, confidence="CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 1.0 ELSE 0.8 END", path="'orders/' || o_orderpriority || '/' || CAST(o_orderkey AS STRING)", attrs="'{\"status\":\"' || o_orderstatus || '\"}'"),
    _node("part", "Interface", "p_partkey", "p_name", attrs="'{\"brand\":\"' || p_brand || '\",\"size\":' || CAST(p_size AS STRING) || '}'"),
    _node("documents", "File", "doc_id", "source", path="source || '/' || lang || '/' || CAST(doc_id AS STRING)"),
]


def _edge(table: str, kind: str, src: str, dst: str, source: str = "'parsed'", confidence: str = "1.0", path: str = "''") -> tuple[str, list[str]]:
    values = [src, dst, f"'{kind}'", "'{}'", source, "'tables@1'", "'c0'", f"CAST({confidence} AS DOUBLE)", path, "''"]
    return table, [f"{v} AS {f.name}" for v, f in zip(values, EDGES.fields, strict=True)]


EDGE_SPECS = [
    _edge("nation", "CONTAINS", node_id("region", "n_regionkey"), node_id("nation", "n_nationkey")),
    _edge("customer", "CONTAINS", node_id("nation", "c_nationkey"), node_id("customer", "c_custkey")),
    _edge("supplier", "CONTAINS", node_id("nation", "s_nationkey"), node_id("supplier", "s_suppkey")),
    _edge("orders", "CONTAINS", node_id("customer", "o_custkey"), node_id("orders", "o_orderkey")),
    _edge("lineitem", "CALLS", node_id("orders", "l_orderkey"), node_id("part", "l_partkey"), _FLAG, "CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'N' THEN 1.0 ELSE 0.7 END", "'orders/' || CAST(l_orderkey AS STRING)"),
]
#: A supplier implements each part that it ever delivered, once.
_IMPLEMENTS = _edge("lineitem", "IMPLEMENTS", node_id("supplier", "l_suppkey"), node_id("part", "l_partkey"), "'resolved'")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    tables: dict[str, DataFrame] = {}

    def made(spec: tuple[str, list[str]]) -> DataFrame:
        table, columns = spec
        if table not in tables:
            tables[table] = read(spark, sf_dir, table)
        return tables[table].selectExpr(*columns)

    edges = [*map(made, EDGE_SPECS), made((_IMPLEMENTS[0], _IMPLEMENTS[1])).distinct()]
    return Graph(reduce(DataFrame.union, map(made, NODE_SPECS)), reduce(DataFrame.union, edges))


def ctes() -> str:
    """The same view for DuckDB: the tables ``nodes`` and ``edges``."""
    nodes = " UNION ALL ".join(f"SELECT {', '.join(c)} FROM {t}" for t, c in NODE_SPECS)
    edges = " UNION ALL ".join([*(f"SELECT {', '.join(c)} FROM {t}" for t, c in EDGE_SPECS), f"SELECT DISTINCT {', '.join(_IMPLEMENTS[1])} FROM lineitem"])
    return f"nodes AS ({nodes}), edges AS ({edges})"
