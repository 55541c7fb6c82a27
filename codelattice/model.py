"""The data model: vocabularies, row schemas and the graph as a pair of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

NODE_KINDS = (
    "Repository", "Package", "File", "Class", "Interface", "Function", "Method", "Variable", "TypeAlias", "Chunk",
    "DocChunk", "Decision", "Route", "DataModel", "Service", "Summary", "PatternTag", "RouteMount", "ServiceCall",
)
EDGE_KINDS = (
    "CONTAINS", "IMPORTS", "CALLS", "INHERITS", "IMPLEMENTS", "REFERENCES", "CHUNK_OF", "DESCRIBES", "GOVERNS",
    "SUPERSEDES", "HANDLED_BY", "INJECTED_INTO", "HAS_FIELD", "RELATES_TO", "PROVIDED_BY", "SUMMARIZES", "TAGGED",
)
SOURCES = ("parsed", "resolved", "llm", "manual")
#: Kinds that stand for code symbols (as opposed to files, documents and derived facts).
SYMBOL_KINDS = ("Class", "Interface", "Function", "Method", "Variable", "TypeAlias")
#: Trust in a fact's source, weakest first, as a store filter sees it and as retrieval does; the two differ on purpose.
STORE_FLOOR = {"llm": 0, "resolved": 1, "manual": 1, "parsed": 2}
RETRIEVAL_FLOOR = {"llm": 0, "parsed": 1, "resolved": 2, "manual": 3}

_S, _L, _D = StringType(), LongType(), DoubleType()
_PROVENANCE = [("prov_source", _S), ("prov_extractor", _S), ("prov_commit", _S), ("prov_confidence", _D), ("origin_path", _S)]


def _schema(*fields: tuple[str, object]) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields])


NODES = _schema(("id", _S), ("kind", _S), ("name", _S), ("span_start", _L), ("span_end", _L), ("attrs", _S), ("sym_path", _S), *_PROVENANCE)
EDGES = _schema(("src", _S), ("dst", _S), ("kind", _S), ("attrs", _S), *_PROVENANCE, ("resolved_from", _S))
EVENTS = _schema(("symbol_id", _S), ("entity", _S), ("event", _S), ("commit_sha", _S), ("ts", _L), ("ref", _S))
HISTORY_EVENTS = ("opened", "modified", "closed", "succeeds")


@dataclass(frozen=True)
class Graph:
    """A property graph: ``nodes`` by unique id, ``edges`` as a bag. Operators return new graphs."""

    nodes: DataFrame
    edges: DataFrame

    def with_nodes(self, nodes: DataFrame) -> "Graph":
        return replace(self, nodes=nodes)

    def with_edges(self, edges: DataFrame) -> "Graph":
        return replace(self, edges=edges)


def invalid_nodes(nodes: DataFrame) -> DataFrame:
    """Rows that break the model: unknown kinds or sources, ids without five fields, or less than full confidence in a fact that no model made."""
    from pyspark.sql import functions as F

    return nodes.where(
        ~F.coalesce(F.col("kind").isin(*NODE_KINDS), F.lit(False))
        | ~F.coalesce(F.col("prov_source").isin(*SOURCES), F.lit(False))
        | (F.size(F.split("id", " ")) != 5)
        | F.coalesce((F.col("prov_confidence") < 1) & (F.col("prov_source") != "llm"), F.lit(False))
    )
