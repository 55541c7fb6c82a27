"""The table function from files to facts: every file is parsed once, in Arrow batches, and its rows go to one narrow table."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codelattice.extract import frameworks as fw
from codelattice.extract.packs import BY_SLUG, RULES, pack_of
from codelattice.extract.scan import CALLABLE, Definition, Scanned, scan
from codelattice.model import EDGES, NODES, Graph

SCHEME = "lat"
#: ``rel`` says what a row is: node, edge, import, ref, base, receiver, relation or unresolved.
COLUMNS = {
    "rel": pa.string(), "path": pa.string(), "slug": pa.string(), "id": pa.string(), "dst": pa.string(), "kind": pa.string(), "name": pa.string(), "span_start": pa.int64(), "span_end": pa.int64(),
    "attrs": pa.string(), "extra": pa.list_(pa.string()), "line": pa.int64(), "extractor": pa.string(),
}
_TYPES = {pa.string(): "string", pa.int64(): "long", pa.list_(pa.string()): "array<string>"}
FACTS = ", ".join(f"{n} {_TYPES[t]}" for n, t in COLUMNS.items())


def symbol(slug: str, repo: str, path: str, descriptor: str) -> str:
    return " ".join([SCHEME, *(x.replace("%", "%25").replace(" ", "%20") for x in (slug, repo, path, descriptor))])


def suffix(d: Definition, number: int) -> str:
    if d.kind in CALLABLE:
        return f"{d.name}{f'(+{number})' if number else ''}()."
    return d.name + ("#" if d.kind in ("Class", "Interface") else ".")


def _identify(found: Scanned, slug: str, repo: str, path: str) -> None:
    """Ids of all definitions: those of their scopes, and for equal callables of a scope their number in source order."""
    seen: dict[tuple[int, str], int] = {}
    descriptors: dict[int, str] = {}
    for d in found.definitions:  # in source order, scopes first
        number = 0
        if d.kind in CALLABLE:
            key = (id(d.parent), d.name)
            number = seen[key] = seen.get(key, -1) + 1
        descriptors[id(d)] = (descriptors[id(d.parent)] if d.parent else "") + suffix(d, number)
        d.id = symbol(slug, repo, path, descriptors[id(d)])


def facts_of(path: str, text: str, repo: str, packs: Iterable[str] = ()) -> list[dict]:
    """All rows of one file; none for a language without a pack."""
    pack = pack_of(path)
    if pack is None:
        return []
    slug, out = pack.slug, []
    base = {"path": path, "slug": slug, "extractor": f"scan-{pack.language}@{RULES}"}
    found = scan(text, slug)
    _identify(found, slug, repo, path)
    file_id = symbol(slug, repo, path, "")
    attrs = {k: v for k, v in (("namespace", found.namespace), ("default_export", found.default_export), ("parse_error", found.broken)) if v}
    nodes = {file_id: base | {"rel": "node", "id": file_id, "kind": "File", "name": path.rsplit("/", 1)[-1], "attrs": attrs}}
    edges: dict[tuple[str, str, str], dict] = {}

    def edge(src: str, dst: str, kind: str, **more: str) -> None:
        edges.setdefault((src, dst, kind), base | {"rel": "edge", "id": src, "dst": dst, "kind": kind} | more)

    for d in found.definitions:
        nodes[d.id] = base | {"rel": "node", "id": d.id, "kind": d.kind, "name": d.name, "span_start": d.lines[0], "span_end": d.lines[1], "attrs": {"signature": d.signature}}
        edge(d.parent.id if d.parent else file_id, d.id, "CONTAINS")
        out += [base | {"rel": "base", "id": d.id, "name": b} for b in d.bases]
        if d.receiver:
            out.append(base | {"rel": "receiver", "id": d.id, "name": d.receiver[0], "dst": d.receiver[1], "kind": d.name})
        if d.doc:
            doc_id = symbol(slug, repo, path, d.id.rsplit(" ", 1)[1].replace("%20", " ").replace("%25", "%") + "docstring.")
            about = {"path": path, "heading": d.name, "text": d.doc, "describes": d.id, "content_hash": hashlib.sha256(d.doc.encode()).hexdigest()}
            nodes[doc_id] = base | {"rel": "node", "id": doc_id, "kind": "DocChunk", "name": d.name, "attrs": about}
            edge(doc_id, d.id, "DESCRIBES")
    out += [base | {"rel": "import", "id": file_id, "name": i.module, "extra": i.names, "dst": i.default, "line": i.line} for i in found.imports if i.module]
    out += [base | {"rel": "ref", "id": c.owner.id if c.owner else file_id, "name": c.name, "dst": c.receiver, "line": c.line} for c in found.calls]
    for name in packs:
        if slug not in fw.PACKS[name].slugs:
            continue
        own = base | {"extractor": f"pack:{name}@{RULES}"}
        for fact in fw.PACKS[name].extract(found):
            if isinstance(fact, fw.Unresolved):
                out.append(own | {"rel": "unresolved", "id": file_id, "name": name})
                continue
            fact_id = symbol(slug, repo, path, fact.suffix)
            nodes.setdefault(fact_id, own | {"rel": "node", "id": fact_id, "kind": fact.kind, "name": fact.name, "span_start": fact.lines[0], "span_end": fact.lines[1], "attrs": fact.attrs})
            for kind, target in fact.edges:
                edge(*((fact_id, target, kind)), extractor=own["extractor"])
            for f in fact.fields:
                field_id = symbol(slug, repo, path, f.suffix)
                nodes.setdefault(field_id, own | {"rel": "node", "id": field_id, "kind": f.kind, "name": f.name, "span_start": f.lines[0], "span_end": f.lines[1], "attrs": f.attrs})
                edge(fact_id, field_id, "HAS_FIELD", extractor=own["extractor"])
            out += [own | {"rel": "relation", "id": fact_id, "name": field, "dst": target, "kind": kind, "extra": [name]} for field, target, kind in fact.relations]
    for n in nodes.values():
        n["attrs"] = json.dumps(n["attrs"], sort_keys=True)
    return [*nodes.values(), *edges.values(), *out]


def extracted(files: DataFrame, repo: str, frameworks: Iterable[str] = ()) -> DataFrame:
    """Facts of files (path, text).  Nothing is shuffled: a file's rows come from the task that read it.

    Files of other languages, and null paths, give no rows; a null text is an empty file.  A file that a scanner can't follow
    still gives its File node.
    """
    packs = tuple(frameworks)
    unknown = set(packs) - fw.PACKS.keys()
    if unknown:
        raise ValueError(f"no framework pack is named {sorted(unknown)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if path is not None:
                    rows += facts_of(path, text or "", repo, packs)
                if len(rows) > 20_000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    return files.select("path", F.col("text").cast("string")).mapInArrow(run, FACTS)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in COLUMNS.items()], list(COLUMNS))


def _provenance(commit: str, source: str = "parsed") -> dict:
    return {"prov_source": F.lit(source), "prov_commit": F.lit(commit), "prov_confidence": F.lit(1.0)}


def shaped(rows: DataFrame, schema: StructType, **values: object) -> DataFrame:
    """``rows`` with exactly the columns of ``schema``, from ``values`` or of the same name."""
    return rows.select(*((values[f.name] if f.name in values else F.col(f.name)).cast(f.dataType).alias(f.name) for f in schema.fields))


def graph_of(facts: DataFrame, commit: str = "") -> Graph:
    """The parsed graph: nodes and edges as rows of the model, owned by their files."""
    same = _provenance(commit) | {"prov_extractor": F.col("extractor"), "origin_path": F.col("path")}
    nodes = shaped(facts.where("rel = 'node'"), NODES, sym_path=F.col("path"), **same)
    edges = shaped(facts.where("rel = 'edge'"), EDGES, src=F.col("id"), attrs=F.lit("{}"), resolved_from=F.lit(""), **same)
    return Graph(nodes, edges)


def slugs() -> dict[str, str]:
    return {s: p.language for s, p in BY_SLUG.items()}
