"""Graph algorithms as iterated joins."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelattice.lineage import cut
from codelattice.model import Graph
from codelattice.operators.store import _ids, hops

#: Trust in an edge when scores travel along it.
EDGE_WEIGHT = {"resolved": 1.0, "manual": 0.8, "parsed": 0.5, "llm": 0.3}
DECAY, FAN_OUT = 0.6, 25
RANK_EDGES = ("CALLS", "INHERITS", "REFERENCES")
#: How much less private symbols count in a ranking.
PUBLIC_BIAS = 0.5


def edge_weight(source: Column) -> Column:
    return reduce(lambda e, kv: e.when(source == kv[0], kv[1]), EDGE_WEIGHT.items(), F).otherwise(0.5)


def pagerank(edges: DataFrame, nodes: DataFrame, personal: DataFrame | None = None, damping: float = 0.85, tolerance: float = 1e-9, most: int = 100, iterations: int | None = None) -> DataFrame:
    """(id, rank) over edges (src, dst, weight), summing to one.

    ``personal`` (id, mass) is where the walk restarts, all nodes alike by default; the mass of nodes without outgoing
    weight restarts too.  It ends when ranks change by less than ``tolerance`` in total, or after ``most`` iterations
    (exactly ``iterations``, if given).  Edges are partitioned by source once and reused in each iteration.
    """
    ids = nodes.select("id").distinct()
    ends = edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight")).where("weight > 0")
    ends = ends.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    share = ends.join(ends.groupBy("src").agg(F.sum("weight").alias("out")), "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("share"))
    share = cut(share.repartition("src"), partitioned=True)
    teleport = ids.withColumn("mass", F.lit(1.0)) if personal is None else ids.join(personal.groupBy("id").agg(F.sum("mass").alias("mass")), "id", "left").fillna(0.0, ["mass"])
    total = teleport.agg(F.sum("mass")).first()[0]
    if not total:
        teleport, total = ids.withColumn("mass", F.lit(1.0)), ids.count()
    teleport = cut(teleport.select("id", (F.col("mass") / F.lit(float(total or 1))).alias("mass")).join(share.select(F.col("src").alias("id"), F.lit(True).alias("goes_on")).distinct(), "id", "left"))
    ranks = teleport.select("id", "mass", "goes_on", F.col("mass").alias("rank"))
    for _ in range(iterations if iterations is not None else most):
        lost = ranks.agg(F.sum(F.when(F.col("goes_on").isNull(), F.col("rank")).otherwise(0.0)).alias("lost"))
        came = ranks.join(share, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("came"))
        after = ranks.join(came, "id", "left").crossJoin(F.broadcast(lost)).select(  # one row
            "id", "mass", "goes_on", ((1 - damping) * F.col("mass") + damping * (F.coalesce("came", F.lit(0.0)) + F.col("lost") * F.col("mass"))).alias("rank"), F.col("rank").alias("before")
        )
        after = cut(after, partitioned=True)
        ranks = after.drop("before")
        if iterations is None and (after.agg(F.sum(F.abs(F.col("rank") - F.col("before")))).first()[0] or 0) < tolerance:
            break
    return ranks.select("id", "rank")


def weighted_edges(graph: Graph, kinds: Iterable[str] = RANK_EDGES) -> DataFrame:
    return graph.edges.where(F.col("kind").isin(*kinds)).select("src", "dst", edge_weight(F.col("prov_source")).alias("weight"))


def expand_scored(graph: Graph, seeds: DataFrame, depth: int, kinds: Iterable[str] | None = None, direction: str = "both", decay: float = DECAY, fan_out: int = FAN_OUT) -> DataFrame:
    """(id, score, depth) of what is within ``depth`` hops of the scored seeds (id, score).

    Each hop multiplies a score by ``decay`` and by the weight of the edge's source; of a node's edges the first ``fan_out`` by
    kind and ends are followed.  A node keeps its best score of the hop at which it is first reached.
    """
    edges = graph.edges.where(F.lit(True) if kinds is None else F.col("kind").isin(*kinds))
    weight = edge_weight(F.col("prov_source"))
    sides = [edges.select(F.col("src").alias("from"), F.col("dst").alias("to"), "kind", weight.alias("w")), edges.select(F.col("dst").alias("from"), F.col("src").alias("to"), "kind", weight.alias("w"))]
    steps = reduce(DataFrame.union, sides if direction == "both" else sides[:1] if direction == "out" else sides[1:])
    order = Window.partitionBy("from").orderBy("kind", "to")
    frontier = seen = seeds.groupBy("id").agg(F.max("score").alias("score")).withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        near = steps.join(frontier.select(F.col("id").alias("from"), "score"), "from")  # only edges at the frontier are ranked
        first = near.groupBy("from", "to", "kind").agg(F.max("w").alias("w"), F.first("score").alias("score")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= fan_out)
        reached = first.groupBy(F.col("to").alias("id")).agg(F.max(F.col("score") * decay * F.col("w")).alias("score"))
        frontier = reached.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(d))
        if depth > 1:
            frontier = cut(frontier)  # else each hop would hold the plan of all before it twice
        seen = seen.union(frontier)
    return seen


def impact(graph: Graph, ids: DataFrame | Iterable[str], depth: int = 3) -> DataFrame:
    """What depends on the given nodes by calls, imports or implementations: (id, score, depth)."""
    seeds = _ids(graph.nodes.sparkSession, ids).withColumn("score", F.lit(1.0))
    return expand_scored(graph, seeds, depth, ("CALLS", "IMPORTS", "IMPLEMENTS"), "in").where("depth > 0")


def edges_within(graph: Graph, ids: DataFrame | Iterable[str], depth: int, kinds: Iterable[str] | None = None) -> DataFrame:
    """Distinct (src, dst, kind) of the edges that a breadth-first search of ``depth`` hops crosses."""
    edges = graph.edges.where(F.lit(True) if kinds is None else F.col("kind").isin(*kinds)).select("src", "dst", "kind").distinct()
    seen = frontier = _ids(graph.edges.sparkSession, ids)
    crossed = []
    for _ in range(depth):
        out = edges.join(frontier.withColumnRenamed("id", "src"), "src", "left_semi").select("src", "dst", "kind")
        back = edges.join(frontier.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "kind")
        crossed.append(found := out.union(back).distinct())
        frontier = found.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(seen, "id", "left_anti")
        if depth > 1:
            frontier = cut(frontier)
        seen = seen.union(frontier)
    return reduce(DataFrame.union, crossed).distinct()


def trace(links: DataFrame, start: str, direction: str = "downstream", most: int = 50) -> DataFrame:
    """(service, hop) reachable over links (caller, callee), at the least number of hops; the start is left out and cycles end."""
    spark = links.sparkSession
    a, b = ("caller", "callee") if direction == "downstream" else ("callee", "caller")
    step = cut(links.select(F.col(a).alias("from"), F.col(b).alias("to")).where("from <> to").distinct())
    seen = frontier = spark.createDataFrame([(start, 0)], "service string, hop int")
    for hop in range(1, most + 1):
        found = frontier.select(F.col("service").alias("from")).join(step, "from").select(F.col("to").alias("service")).distinct()
        frontier = cut(found.join(seen, "service", "left_anti").withColumn("hop", F.lit(hop)))
        if not frontier.limit(1).count():
            break
        seen = seen.union(frontier)
    return seen.where("hop > 0")


def reachable(graph: Graph, ids: DataFrame | Iterable[str], kinds: Iterable[str], direction: str = "out", most: int = 50) -> DataFrame:
    """(start, id): the transitive closure from each start, until nothing new is found."""
    step = cut(hops(graph.edges, kinds, direction).distinct())
    seen = frontier = cut(_ids(graph.edges.sparkSession, ids).select(F.col("id").alias("start"), "id"))
    out = seen.limit(0)
    for _ in range(most):
        found = frontier.withColumnRenamed("id", "from").join(step, "from").select("start", F.col("to").alias("id")).distinct()
        frontier = cut(found.join(seen, ["start", "id"], "left_anti"))
        if not frontier.limit(1).count():
            break
        seen, out = seen.union(frontier), out.union(frontier)
    return out


def private_factor(name: Column, path: Column, bias: float = PUBLIC_BIAS) -> Column:
    """1 - ``bias`` for a name with a leading underscore (dunders are public) or in a module with one, else 1."""
    private = name.startswith("_") & ~(name.startswith("__") & name.endswith("__"))
    stem = F.regexp_extract(path, r"([^/.]*)[^/]*$", 1)
    return F.when(private | stem.startswith("_") & (stem != "__init__"), max(0.0, 1.0 - bias)).otherwise(1.0)


def focus(graph: Graph, paths: Iterable[str] = (), ids: Iterable[str] = ()) -> DataFrame:
    """(id, mass): nodes that are named or lie under one of the path prefixes."""
    wanted = reduce(Column.__or__, [F.col("sym_path").startswith(p) for p in paths], F.col("id").isin(*ids) if ids else F.lit(False))
    return graph.nodes.where(wanted).select("id", F.lit(1.0).alias("mass"))


def ranked_symbols(graph: Graph, scope: str | None = None, personal: DataFrame | None = None, kinds: Iterable[str] | None = None, **how) -> DataFrame:
    """(id, kind, name, sym_path, rank) of symbols, best first: PageRank over trusted edges, less for private names."""
    nodes = graph.nodes if kinds is None else graph.nodes.where(F.col("kind").isin(*kinds))
    if scope is not None:
        nodes = nodes.where(F.col("sym_path").startswith(scope))
    ranks = pagerank(weighted_edges(graph), nodes, personal, **how)
    scored = nodes.join(ranks, "id").withColumn("rank", F.col("rank") * private_factor(F.col("name"), F.col("sym_path")))
    return scored.select("id", "kind", "name", "sym_path", "span_start", "rank").orderBy(F.desc("rank"), "id")
