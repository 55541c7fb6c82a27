"""What a query can refer to."""

from __future__ import annotations

from codelattice.model import EDGE_KINDS, NODE_KINDS

VERSION = "1.0"
#: Logical property: (column, type, meaning).
PROPERTIES = {
    "name": ("name", "str", "name of the symbol"),
    "kind": ("kind", "str", "node kind, also usable as a label"),
    "path": ("sym_path", "str", "path of the file within the repository"),
    "start_line": ("span_start", "int", "first line, from 1"),
    "end_line": ("span_end", "int", "last line, from 1"),
    "source": ("prov_source", "str", "parsed, resolved, llm or manual"),
    "extractor": ("prov_extractor", "str", "name and version of the producer"),
    "commit": ("prov_commit", "str", "commit at which the fact held"),
    "confidence": ("prov_confidence", "float", "confidence from 0 to 1"),
}
CAPABILITIES = frozenset({"core", "agg.basic", "agg.collect", "attrs.access", "path.varlen", "pattern.exists", "string.pred"})


def is_property(path: tuple[str, ...]) -> bool:
    return path[0] in PROPERTIES if len(path) == 1 else path[0] == "attrs"


def describe() -> dict:
    """The vocabulary as plain data."""
    return {
        "version": VERSION,
        "node_kinds": list(NODE_KINDS),
        "edge_kinds": list(EDGE_KINDS),
        "properties": [{"name": n, "type": t, "meaning": m} for n, (_, t, m) in PROPERTIES.items()],
        "attrs": "attrs.<key>... reaches into a node's attributes; values compare as strings, or as numbers with a number",
    }
