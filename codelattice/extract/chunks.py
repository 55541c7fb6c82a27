"""Chunks of source files along their symbols, their embedding, and the skipping of what hasn't changed.

A file's chunks follow its outermost symbols; one that is too long is split at the symbols within it, and lines without any
are cut into windows.  Neighbouring gaps are put together again while they fit.  The packing is greedy and stateful, so it
runs once a file, over Arrow batches grouped by path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.extract.packs import pack_of
from codelattice.extract.rows import shaped, symbol
from codelattice.functions.text import fake_embedding
from codelattice.model import EDGES, NODES, Graph
from codelattice.operators.incremental import fingerprint, unchanged_hashes
from codelattice.operators.store import add, clear_outgoing
from codelattice.operators.vectors import delete_where, upsert

MOST_TOKENS, LEAST_TOKENS = 512, 64
EXTRACTOR = "chunker@1"
CHUNKS = "id string, path string, seq int, span_start long, span_end long, token_count int, content_hash string, text string, code string, symbol_ids array<string>"


def tokens_of(text: str) -> int:
    return max(len(text) // 4, len(text.split()), 1) if text.strip() else 0


class _File:
    def __init__(self, text: str, symbols: list[tuple[str, int, int]], most: int) -> None:
        self.lines, self.symbols, self.most = text.splitlines(), symbols, most

    def code(self, a: int, z: int) -> str:
        return "\n".join(self.lines[a - 1 : z])

    def fits(self, a: int, z: int) -> bool:
        return tokens_of(self.code(a, z)) <= self.most

    def within(self, a: int, z: int, itself: bool) -> list[tuple[int, int]]:
        """Spans of the outermost symbols between two lines, in order; without that of exactly these lines unless ``itself``."""
        spans = {(s, e) for _, s, e in self.symbols if a <= s and e <= z and (itself or (s, e) != (a, z))}
        ordered, out = sorted(spans, key=lambda x: (x[0], -x[1])), []
        for s, e in ordered:
            if not out or e > out[-1][1]:
                if out and s <= out[-1][1]:  # overlaps without containment: takes what is left
                    s = out[-1][1] + 1
                out.append((s, e))
        return out

    def windows(self, a: int, z: int) -> Iterator[tuple[int, int]]:
        """Runs of lines of at most the budget; a single line may exceed it.  Sizes are kept as a running sum, so a window costs its lines once."""
        first, size, words = a, 0, 0
        for n in range(a, z + 1):
            line = self.lines[n - 1]
            longer, more = size + len(line) + (n > first), words + len(line.split())
            if n > first and max(longer // 4, more) > self.most:
                yield first, n - 1
                first, longer, more = n, len(line), len(line.split())
            size, words = longer, more
        if a <= z:
            yield first, z

    def split(self, a: int, z: int) -> Iterator[tuple[int, int]]:
        """Pieces of a symbol, deepest symbols first; iterative, as nesting may be deep."""
        stack: list[tuple[int, int, bool]] = [(a, z, True)]
        while stack:
            a, z, is_symbol = stack.pop()
            if not is_symbol:
                yield from self.windows(a, z)
            elif self.fits(a, z):
                yield a, z
            elif not (inner := self.within(a, z, False)):
                yield from self.windows(a, z)
            else:
                parts, at = [], a
                for s, e in inner:
                    if s > at:
                        parts.append((at, s - 1, False))
                    parts.append((s, e, True))
                    at = e + 1
                if at <= z:
                    parts.append((at, z, False))
                stack += reversed(parts)

    def ranges(self) -> list[tuple[int, int]]:
        end, at, raw = len(self.lines), 1, []
        for s, e in self.within(1, max([end, *(e for _, _, e in self.symbols)]), True):
            if s > at:
                raw += self.windows(at, min(s - 1, end))
            raw += self.split(s, min(e, end))
            at = e + 1
        if at <= end:
            raw += self.windows(at, end)
        starts = sorted(self.symbols, key=lambda x: x[1])
        bare = lambda a, z: not any(s <= z and a <= e for _, s, e in starts)
        out: list[tuple[int, int, bool]] = []
        for a, z in raw:
            if self.code(a, z).strip():
                gap = bare(a, z)
                if out and gap and out[-1][2] and self.fits(out[-1][0], z):
                    out[-1] = (out[-1][0], z, True)
                else:
                    out.append((a, z, gap))
        return [(a, z) for a, z, _ in out]


def chunks_of(path: str, text: str, repo: str, symbols: list[tuple[str, int, int]], most: int = MOST_TOKENS, least: int = LEAST_TOKENS) -> list[dict]:
    """Chunks of one file with its symbols (id, first line, last line); none for a file without any."""
    pack = pack_of(path)
    if not symbols or not text or pack is None:
        return []
    file, out = _File(text, symbols, most), []
    for seq, (a, z) in enumerate(file.ranges()):
        code = file.code(a, z)
        ids = [i for i, s, e in symbols if s <= z and a <= e]
        where = ids[0].rsplit(" ", 1)[1].replace("%20", " ").replace("%25", "%") if ids else "module"
        whole = f"{path} | {where}\n{code}"
        out.append({
            "id": symbol(pack.slug, repo, path, f"chunk({seq})."), "path": path, "seq": seq, "span_start": a, "span_end": z, "token_count": tokens_of(code),
            "content_hash": hashlib.sha256(f"{whole}|{most}|{least}".encode()).hexdigest(), "text": whole, "code": code, "symbol_ids": ids,
        })
    return out


def chunked(files: DataFrame, nodes: DataFrame, repo: str, most: int = MOST_TOKENS, least: int = LEAST_TOKENS) -> DataFrame:
    """Chunks of files (path, text) along the spans of their nodes.  ``least`` only goes into the hashes.

    Files without symbols, and null or empty texts, have none.  A file's symbols meet its text by one join on the path.
    """
    spans = nodes.where("span_start is not null and kind <> 'Chunk'").groupBy(F.col("origin_path").alias("path")).agg(F.array_sort(F.collect_list(F.struct("span_start", "span_end", "id"))).alias("symbols"))
    both = files.select("path", "text").join(spans, "path").select("path", "text", F.transform("symbols", lambda s: F.struct(s["id"], s["span_start"], s["span_end"])).alias("symbols"))
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "array<string>": pa.list_(pa.string())}
    columns = [(n, kinds[t]) for n, t in (c.split() for c in CHUNKS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for path, text, symbols in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                rows += chunks_of(path, text or "", repo, [tuple(s.values()) for s in symbols], most, least)
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in columns], [n for n, _ in columns])

    return both.mapInArrow(run, CHUNKS)


#: An embedder takes a series of texts and returns one of vectors.
Embedder = Callable[[pd.Series], pd.Series]


def embedded(texts: DataFrame, embedder: Embedder | None = None, dimension: int = 64) -> DataFrame:
    """``texts`` with ``vector``: from an embedder over Arrow batches, or the deterministic one, which stays in the JVM."""
    if embedder is None:
        return texts.withColumn("vector", fake_embedding(F.col("text"), dimension).cast("array<float>"))
    embed = F.pandas_udf(embedder, "array<float>")
    return texts.withColumn("vector", embed("text"))


def changed_chunks(chunks: DataFrame, graph: Graph) -> DataFrame:
    """The chunks of files whose set of hashes isn't that of the chunks in the graph."""
    old = graph.nodes.where("kind = 'Chunk'").select(F.col("sym_path").alias("path"), F.get_json_object("attrs", "$.content_hash").alias("content_hash"))
    return chunks.join(unchanged_hashes(old, chunks), "path", "left_anti")


def with_chunks(graph: Graph, chunks: DataFrame, commit: str = "") -> Graph:
    """The graph with these chunks, in place of all earlier ones of their files, and their CHUNK_OF edges to symbols or else to the file."""
    made = {"prov_source": F.lit("parsed"), "prov_extractor": F.lit(EXTRACTOR), "prov_commit": F.lit(commit), "prov_confidence": F.lit(1.0), "origin_path": F.lit("")}
    old = graph.nodes.where("kind = 'Chunk'").join(chunks.select(F.col("path").alias("sym_path")).distinct(), "sym_path", "left_semi").select("id")
    rest = clear_outgoing(graph, old, "CHUNK_OF")
    rest = rest.with_nodes(rest.nodes.join(old, "id", "left_anti").select(*NODES.names))
    attrs = F.to_json(F.struct("code", "content_hash", "path", "seq", "token_count"))
    nodes = shaped(chunks, NODES, kind=F.lit("Chunk"), name=F.concat(F.lit("chunk"), F.col("seq").cast("string")), attrs=attrs, sym_path=F.col("path"), **made)
    file = F.concat(F.substring_index("id", " ", 4), F.lit(" "))
    targets = F.when(F.size("symbol_ids") > 0, F.col("symbol_ids")).otherwise(F.array(file))
    edges = shaped(chunks.select(F.col("id").alias("src"), F.explode(targets).alias("dst")), EDGES, kind=F.lit("CHUNK_OF"), attrs=F.lit("{}"), resolved_from=F.lit(""), **made)
    return add(rest, nodes, edges)


def embed_code(graph: Graph, vectors: DataFrame, chunks: DataFrame, embedder: Embedder | None = None, dimension: int = 64, commit: str = "") -> tuple[Graph, DataFrame]:
    """Graph and vectors with the changed chunks; a file's vectors are replaced as a whole, and unchanged files are left alone."""
    fresh = changed_chunks(chunks, graph)
    rows = embedded(fresh, embedder, dimension).select(F.col("id").alias("ref"), "vector", F.lit("Chunk").alias("kind"), "path", F.to_json(F.struct("symbol_ids", F.lit("code").alias("source_type"))).alias("attrs"))
    kept = vectors.join(fresh.select("path").distinct().withColumn("kind", F.lit("Chunk")), ["path", "kind"], "left_anti").select("ref", "vector", "kind", "path", "attrs")
    return with_chunks(graph, fresh, commit), upsert(kept, rows)


def document_fingerprint(graph: Graph) -> str:
    """One hash of the contents of all document chunks."""
    hashes = graph.nodes.where("kind = 'DocChunk'").select(F.lit("all").alias("k"), F.concat_ws(":", "id", F.get_json_object("attrs", "$.content_hash")).alias("v"))
    row = fingerprint(hashes, "k", "v").first()
    return row["fingerprint"] if row else ""


def embed_documents(graph: Graph, vectors: DataFrame, known: str = "", embedder: Embedder | None = None, dimension: int = 64) -> tuple[DataFrame, str]:
    """Vectors with those of all document chunks, and their fingerprint; nothing is done if that is the ``known`` one."""
    now = document_fingerprint(graph)
    if now == known:
        return vectors, now
    docs = graph.nodes.where("kind = 'DocChunk'").select("id", F.col("sym_path").alias("path"), F.coalesce(F.get_json_object("attrs", "$.text"), F.lit("")).alias("text"))
    rows = embedded(docs, embedder, dimension).select(F.col("id").alias("ref"), "vector", F.lit("DocChunk").alias("kind"), "path", F.lit('{"source_type": "doc"}').alias("attrs"))
    return upsert(delete_where(vectors, {"kind": "DocChunk"}), rows), now
