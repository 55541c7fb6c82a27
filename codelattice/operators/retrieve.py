"""Hybrid retrieval: vector hits, their graph neighbourhood, scores that decay, and packing into a token budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelattice.functions.text import blended, estimated_tokens, lexical_overlap
from codelattice.model import RETRIEVAL_FLOOR, SYMBOL_KINDS, Graph
from codelattice.operators.graphs import expand_scored
from codelattice.operators.vectors import search

#: Mode: kinds of edges that are followed, and their direction.
MODES = {
    "context": (("INHERITS", "CALLS", "REFERENCES", "CONTAINS", "TAGGED", "SUMMARIZES", "DESCRIBES", "GOVERNS"), "both"),
    "impact": (("CALLS", "IMPORTS", "IMPLEMENTS"), "in"),
    "definition": (("CHUNK_OF", "CONTAINS"), "both"),
    "similar": ((), "both"),
}
DOC_WEIGHT = 0.7
#: From a hit to what it stands for: (edge kind, whether the edge leaves the hit).
SEED_EDGES = (("CHUNK_OF", True), ("SUMMARIZES", True), ("CONTAINS", False), ("DESCRIBES", True))


def doc_weighted(score: Column, kind: Column, architectural: Column) -> Column:
    """Documents count less, unless the question is about architecture."""
    return F.when((kind == "DocChunk") & ~architectural, score * DOC_WEIGHT).otherwise(score)


def seeds_of(graph: Graph, hits: DataFrame) -> DataFrame:
    """(id, score): the nodes that scored hits (ref, score) stand for, with the best score of each; dangling refs go."""
    known = hits.join(graph.nodes.select(F.col("id").alias("ref")), "ref", "left_semi")
    out = known.select(F.col("ref").alias("id"), "score")
    for kind, leaves in SEED_EDGES:
        edges = graph.edges.where(F.col("kind") == kind).select(F.col("src" if leaves else "dst").alias("ref"), F.col("dst" if leaves else "src").alias("id"))
        out = out.union(known.join(edges, "ref").select("id", "score"))
    return out.groupBy("id").agg(F.max("score").alias("score"))


def floor(nodes: DataFrame, min_source: str | None = None, llm_facts: bool = True) -> DataFrame:
    """Nodes whose source is at least ``min_source`` as retrieval orders them."""
    if not llm_facts:
        nodes = nodes.where("prov_source <> 'llm'")
    if min_source is None:
        return nodes
    return nodes.where(F.col("prov_source").isin(*(s for s, r in RETRIEVAL_FLOOR.items() if r >= RETRIEVAL_FLOOR[min_source])))


def allowed(nodes: DataFrame, alive: DataFrame | None) -> DataFrame:
    """Code symbols only if they are in ``alive`` (symbol_id); other kinds pass."""
    if alive is None:
        return nodes
    is_symbol = F.col("kind").isin(*SYMBOL_KINDS)
    return nodes.where(~is_symbol).union(nodes.where(is_symbol).join(alive.select(F.col("symbol_id").alias("id")), "id", "left_semi").select(*nodes.columns))


def dedupe(items: DataFrame) -> DataFrame:
    """(id, score, why): of items (id, score, why array, seq) the best score of each id, and all its reasons in the order met."""
    grouped = items.groupBy("id").agg(F.max("score").alias("score"), F.min("seq").alias("seq"), F.array_sort(F.collect_list(F.struct("seq", "why"))).alias("w"))
    return grouped.select("id", "score", F.array_distinct(F.flatten(F.transform("w", lambda x: x["why"]))).alias("why"), "seq")


def rerank_lexical(items: DataFrame, query: str, text: Column, weight: float = 0.3, pool: int | None = None) -> DataFrame:
    """Items with their score blended with the share of the query's parts that their text has, best first."""
    if pool is not None:
        items = items.orderBy(F.desc("score"), "id").limit(pool)
    return items.withColumn("score", blended(F.col("score"), lexical_overlap(F.lit(query), text), weight)).orderBy(F.desc("score"), "id")


def retrieve(graph: Graph, vectors: DataFrame, query: Sequence[float], k: int = 8, mode: str = "context", depth: int = 1, min_source: str | None = None, llm_facts: bool = True, alive: DataFrame | None = None, architectural: bool = False, symbols: DataFrame | None = None) -> DataFrame:
    """(id, kind, name, sym_path, score, depth) around the ``k`` nearest vectors, or around given ``symbols`` (id), best first."""
    kinds, direction = MODES[mode]
    if symbols is None:
        hits = search(vectors, query, k)
        hits = hits.withColumn("score", doc_weighted(F.col("score"), F.col("kind"), F.lit(architectural)))
        seeds = seeds_of(graph, hits.select("ref", "score"))
    else:
        seeds = symbols.select("id", F.lit(1.0).alias("score"))
    found = expand_scored(graph, seeds, depth, kinds, direction) if kinds and depth else seeds.withColumn("depth", F.lit(0))
    nodes = allowed(floor(graph.nodes, min_source, llm_facts), alive)
    out = nodes.join(found, "id").select("id", "kind", "name", "sym_path", "score", "depth")
    return out.orderBy(F.desc("score"), "id")


def packed(items: list[dict], budget: int) -> tuple[list[str], int]:
    """Texts of ranked items within a token budget, and how many were left out.

    An item that doesn't fit in full is shown by its signature, and left out if that doesn't fit either; later ones
    are still tried. Items are dicts with ``text`` and ``signature``.
    """
    tokens = lambda t: 0 if not t.strip() else max(len(t) // 4, len(t.split()), 1)
    out, used, dropped = [], 0, 0
    for item in items:
        for text in (item["text"], item["signature"]):
            if used + tokens(text) <= budget:
                out.append(text)
                used += tokens(text)
                break
        else:
            dropped += 1
    return out, dropped


def budget_prefix(ranked: DataFrame, text: Column, budget: int, *order: Column) -> DataFrame:
    """The rows before the first that would break the budget, for rankings of a bounded size (a top-k): their running sum is one window."""
    from pyspark.sql import Window

    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("used", F.sum(estimated_tokens(text)).over(w)).where(F.col("used") <= budget)
