"""The typed questions about a code graph: routes, calls, models, services, decisions, tags, summaries, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelattice.functions.text import attribute, estimated_tokens
from codelattice.model import Graph
from codelattice.operators.store import adjacent

A = lambda *keys: F.coalesce(attribute(F.col("attrs"), *keys), F.lit(""))


def _located(nodes: DataFrame, kind: str, **values: Column) -> DataFrame:
    return nodes.where(F.col("kind") == kind).select("id", *(v.alias(k) for k, v in values.items()), F.col("sym_path").alias("file"), F.coalesce("span_start", F.lit(0)).alias("line"))


def routes(graph: Graph, method: str = "", path: str = "") -> DataFrame:
    """Endpoints by (path_pattern, method); of one method, whatever its case, and below a prefix of the whole or the own path."""
    out = _located(graph.nodes, "Route", method=A("method"), path=A("path"), path_pattern=F.coalesce(F.nullif(A("path_pattern"), F.lit("")), A("path")), framework=A("framework"), handler=A("handler"))
    if method:
        out = out.where(F.upper("method") == method.upper())
    if path:
        out = out.where(F.col("path_pattern").startswith(path) | F.col("path").startswith(path))
    return out.orderBy("path_pattern", "method", "id")


def service_calls(graph: Graph) -> DataFrame:
    """Calls to other services by (path, method)."""
    return _located(graph.nodes, "ServiceCall", method=A("method"), url=A("url"), path=A("path"), framework=A("framework")).orderBy("path", "method", "id")


def models(graph: Graph) -> DataFrame:
    """Data models by name, with their sorted fields and relations (to, kind, via)."""
    own = _located(graph.nodes, "DataModel", name=F.coalesce(F.nullif(A("table"), F.lit("")), F.col("name")), table=A("table"), framework=A("framework"), symbol=A("class"))
    fields = graph.edges.where("kind = 'HAS_FIELD'").select(F.col("src").alias("id"), F.col("dst").alias("field")).join(graph.nodes.where("kind = 'Variable'").select(F.col("id").alias("field"), F.col("name").alias("field_name")), "field")
    fields = fields.groupBy("id").agg(F.array_sort(F.collect_set("field_name")).alias("fields"))
    to = graph.edges.where("kind = 'RELATES_TO'").select(F.col("src").alias("id"), F.col("dst").alias("target"), A("kind").alias("how"), A("via").alias("via")).join(own.select(F.col("id").alias("target"), F.col("name").alias("to")), "target", "left")
    to = to.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("to", "target").alias("to"), "via", F.col("how").alias("kind")))).alias("relations"))
    out = own.join(fields, "id", "left").join(to, "id", "left")
    none = lambda c, t: F.coalesce(c, F.array().cast(t))
    return out.withColumn("fields", none("fields", "array<string>")).withColumn("relations", none("relations", "array<struct<to:string,via:string,kind:string>>")).orderBy("name", "id")


def services(graph: Graph) -> DataFrame:
    """Injected services by name, with the sorted symbols that they go into."""
    own = _located(graph.nodes, "Service", name=F.coalesce(F.nullif(A("provider"), F.lit("")), F.col("name")), framework=A("framework"))
    into = graph.edges.where("kind = 'INJECTED_INTO'").groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("injected_into"))
    return own.join(into, "id", "left").withColumn("injected_into", F.coalesce("injected_into", F.array().cast("array<string>"))).orderBy("name", "id")


def decisions(graph: Graph, scope: str = "", status: str = "") -> DataFrame:
    """Decisions, latest status and date first; those of a status, and those whose own path or that of something they govern begins with ``scope``."""
    own = graph.nodes.where("kind = 'Decision'").select("id", A("adr_id").alias("adr_id"), F.coalesce(F.nullif(A("title"), F.lit("")), F.col("name")).alias("title"), A("status").alias("status"), A("date").alias("date"), F.col("sym_path").alias("path"))
    if status:
        own = own.where(F.col("status") == status)
    governs = graph.edges.where("kind = 'GOVERNS'").select(F.col("src").alias("id"), F.col("dst").alias("target")).join(graph.nodes.select(F.col("id").alias("target"), F.col("sym_path").alias("at")), "target")
    inside = F.max(F.col("at").startswith(scope)).alias("inside") if scope else F.lit(True).alias("inside")
    governs = governs.groupBy("id").agg(F.array_sort(F.collect_set("target")).alias("governs"), inside)
    out = own.join(governs, "id", "left")
    if scope:
        out = out.where(F.col("path").startswith(scope) | F.coalesce("inside", F.lit(False)))
    return out.select("id", "adr_id", "title", "status", "date", "path", F.coalesce("governs", F.array().cast("array<string>")).alias("governs")).orderBy(F.desc("status"), F.desc("date"), "id")


def tagged(graph: Graph, pattern: str, least: float = 0.7) -> DataFrame:
    """(id, pattern, confidence, rationale) of symbols with a tag of at least this confidence, surest first; only things within files have tags."""
    tags = graph.nodes.where((F.col("kind") == "PatternTag") & (F.col("name") == pattern)).select(F.col("id").alias("dst"))
    sure = F.coalesce(attribute(F.col("attrs"), "confidence").try_cast("double"), F.col("prov_confidence"))
    found = graph.edges.where("kind = 'TAGGED'").join(tags, "dst", "left_semi").select(F.col("src").alias("id"), F.lit(pattern).alias("pattern"), sure.alias("confidence"), A("rationale").alias("rationale"))
    return found.where((F.col("confidence") >= least) & (F.element_at(F.split("id", " "), -1) != "")).orderBy(F.desc("confidence"), "id")


def tag_counts(graph: Graph) -> DataFrame:
    """(pattern, symbols): how many symbols have each tag."""
    names = graph.nodes.where("kind = 'PatternTag'").select(F.col("id").alias("dst"), F.col("name").alias("pattern"))
    return graph.edges.where("kind = 'TAGGED'").join(names, "dst").groupBy("pattern").agg(F.count_distinct("src").alias("symbols")).orderBy("pattern")


def summaries(graph: Graph, level: str | None = None) -> DataFrame:
    """(id, target, level, path, text) by level and path."""
    own = graph.nodes.where("kind = 'Summary'").select("id", A("level").alias("level"), F.col("sym_path").alias("path"), A("text").alias("text"))
    if level is not None:
        own = own.where(F.col("level") == level)
    of = graph.edges.where("kind = 'SUMMARIZES'").groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("target"))
    return own.join(of, "id", "left").select("id", F.coalesce("target", F.lit("")).alias("target"), "level", "path", "text").orderBy("level", "path", "id")


def facts(graph: Graph, symbol: str) -> DataFrame:
    """(src, dst, kind) of a symbol's edges but its tags."""
    return adjacent(graph, [symbol]).where("kind <> 'TAGGED'").select("src", "dst", "kind").distinct().orderBy("kind", "src", "dst")


def tags_of(graph: Graph, symbol: str) -> DataFrame:
    edges = graph.edges.where((F.col("kind") == "TAGGED") & (F.col("src") == symbol))
    return edges.join(graph.nodes.select(F.col("id").alias("dst"), F.col("name").alias("pattern")), "dst").select("pattern", F.col("prov_confidence").alias("confidence")).orderBy(F.desc("confidence"), "pattern")


def kind_counts(graph: Graph) -> DataFrame:
    """(what, kind, n) for nodes and edges."""
    count = lambda df, what: df.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "kind", "n")
    return count(graph.nodes, "node").union(count(graph.edges, "edge"))


def index_report(graph: Graph, stats: DataFrame | None = None) -> DataFrame:
    """One row of totals: files, nodes, edges, resolved edges, external packages and references that stayed unresolved."""
    nodes = graph.nodes.agg(F.count_if(F.col("kind") == "File").alias("files"), F.count("*").alias("nodes"), F.count_if((F.col("kind") == "Package") & (F.col("sym_path") == "<external>")).alias("external"))
    edges = graph.edges.agg(F.count("*").alias("edges"), F.count_if(F.col("prov_source") == "resolved").alias("resolved"))
    left = F.lit(None).cast("long")
    out = nodes.join(edges, F.lit(True))
    if stats is not None:
        return out.join(stats.agg(F.coalesce(F.sum(F.when(F.col("what") == "refs_unresolved", F.col("n"))), F.lit(0)).alias("unresolved")), F.lit(True))
    return out.withColumn("unresolved", left)


# Repository map and rankings ------------------------------------------------


def overload_numbers(callables: DataFrame, scope: tuple[str, ...], order: str) -> DataFrame:
    """``callables`` with ``overload``: the place of each among those of its name and scope, from 0."""
    return callables.withColumn("overload", F.row_number().over(Window.partitionBy(*scope).orderBy(order)) - 1)


def chunk_sequence(chunks: DataFrame) -> DataFrame:
    """``chunks`` with ``seq``, their place in the file."""
    return chunks.withColumn("seq", F.row_number().over(Window.partitionBy("path").orderBy("span_start", "span_end")) - 1)


def file_order(ranked: DataFrame) -> DataFrame:
    """(sym_path, place): files by the best rank of their symbols."""
    best = ranked.groupBy("sym_path").agg(F.max("rank").alias("best"), F.min("id").alias("first"))
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("best"), "first"))).select("sym_path", "place")


def strided_sample(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """At most ``most`` rows of each key, evenly spaced in ``order``; all where there are no more."""
    w = Window.partitionBy(key)
    numbered = rows.withColumn("__n", F.row_number().over(w.orderBy(order)) - 1).withColumn("__all", F.count("*").over(w))
    slot = F.floor(F.col("__n") * most / F.col("__all"))
    before = F.floor((F.col("__n") - 1) * most / F.col("__all"))
    return numbered.where((F.col("__all") <= most) | (F.col("__n") == 0) | (slot > before)).drop("__n", "__all")


def first_candidates(nodes: DataFrame, most: int = 60) -> DataFrame:
    """The first candidates for a matcher, by id: a prompt holds no more."""
    return nodes.orderBy("id").limit(most)


def top_authors(touches: DataFrame, top: int = 3) -> DataFrame:
    """(symbol_id, author, commits, place): the authors with most commits, then by name."""
    counts = touches.groupBy("symbol_id", "author").agg(F.count_distinct("commit_sha").alias("commits"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("symbol_id").orderBy(F.desc("commits"), "author"))).where(F.col("place") <= top)


def rendered_map(ranked: list[dict], budget: int, summary: dict[str, str] | None = None) -> str:
    """A repository map in a token budget: files by their best symbol, each with its signatures; it ends at the first line that doesn't fit.

    ``ranked`` are rows (path, name, signature), best first, of a top-k.
    """
    tokens = lambda t: max(len(t) // 4, len(t.split()), 1) if t.strip() else 0
    by_file: dict[str, list[dict]] = {}
    for r in ranked:
        by_file.setdefault(r["path"], []).append(r)
    out, shown = [], 0
    for path, rows in by_file.items():
        head = [f"{path}:"] + ([f"  # {summary[path]}"] if summary and summary.get(path) else [])
        for r in rows:
            more = [*head, f"  {r.get('signature') or r['name'] + '(...)'}"]
            if tokens("\n".join(out + more)) > budget:
                return "\n".join([*out, f"… {len(ranked) - shown} more symbols below the budget"])
            out, head, shown = out + more, [], shown + 1
    return "\n".join(out)


# Retrieval quality ----------------------------------------------------------


def reciprocal_ranks(hits: DataFrame) -> DataFrame:
    """(query, place, rr) of the first relevant hit of each query, from hits (query, id, score, relevant)."""
    placed = hits.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id")))
    return placed.groupBy("query").agg(F.min(F.when(F.col("relevant"), F.col("place"))).alias("place")).select("query", "place", F.coalesce(1 / F.col("place"), F.lit(0.0)).alias("rr"))


def quality(hits: DataFrame, ks: tuple[int, ...] = (1, 5, 8), gain_at: int = 8) -> DataFrame:
    """One row: mean reciprocal rank, the share of queries with a relevant hit among the first k, and mean nDCG."""
    placed = hits.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id")))
    good = F.when(F.col("relevant"), 1.0).otherwise(0.0)
    each = placed.groupBy("query").agg(
        F.min(F.when(F.col("relevant"), F.col("place"))).alias("first"),
        F.sum(F.when(F.col("place") <= gain_at, good / F.log2(F.col("place") + 1))).alias("dcg"),
        F.count_if(F.col("relevant")).alias("n"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least("n", F.lit(gain_at)), F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return each.agg(
        F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"), *(F.avg((F.coalesce("first", F.lit(1 << 30)) <= k).cast("double")).alias(f"recall_{k}") for k in ks),
        F.avg(F.when(F.col("n") > 0, F.col("dcg") / ideal).otherwise(0.0)).alias(f"ndcg_{gain_at}"),
    )


def bootstrap(differences: list[float], resamples: int = 2000, seed: int = 1) -> tuple[float, float, float]:
    """Mean of paired differences, one for each query, and its 95 % interval over resamples of a fixed generator."""
    import random

    if not differences:
        return 0.0, 0.0, 0.0
    rng, n = random.Random(seed), len(differences)
    means = sorted(sum(rng.choices(differences, k=n)) / n for _ in range(resamples))
    return sum(differences) / n, means[int(0.025 * resamples)], means[min(resamples - 1, int(0.975 * resamples))]


def within_tokens(rows: DataFrame, text: Column, budget: int, *order: Column) -> DataFrame:
    """The first rows of a bounded ranking whose texts together stay in the budget."""
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(estimated_tokens(text)).over(w)).where(F.col("used") <= budget)
