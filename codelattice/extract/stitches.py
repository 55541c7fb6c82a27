"""The second pass of the framework packs: what needs other files, as joins over the whole graph.

Every stitch takes away what an earlier run of it made and makes it anew, so that running it on a part of the changes or on
all of them gives the same graph.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelattice.extract.rows import shaped
from codelattice.functions.text import attribute
from codelattice.lineage import cut
from codelattice.model import EDGES, Graph
from codelattice.operators.store import clear_outgoing, set_attrs

EXTRACTOR = "cross-file@1"


@dataclass
class Stitched:
    graph: Graph
    stats: DataFrame  # (what, n)


def file_of(node: Column) -> Column:
    """The id of the File that a symbol's id lies in."""
    return F.concat(F.substring_index(node, " ", 4), F.lit(" "))


def path_of(node: Column) -> Column:
    return F.replace(F.replace(F.get(F.split(node, " "), 3), F.lit("%20"), F.lit(" ")), F.lit("%25"), F.lit("%"))


def composed(prefix: Column, path: Column) -> Column:
    rest = F.regexp_replace(path, "^/+", "")
    base = F.regexp_replace(prefix, "/+$", "")
    return F.when(F.coalesce(prefix, F.lit("")) == "", path).when(rest == "", base).otherwise(F.concat_ws("/", base, rest))


def visible_files(graph: Graph) -> DataFrame:
    """(file, seen): each file, and those of the repository that it imports."""
    files = graph.nodes.where("kind = 'File'").select(F.col("id").alias("file"))
    imported = graph.edges.where("kind = 'IMPORTS'").select(F.col("src").alias("file"), F.col("dst").alias("seen")).join(files.withColumnRenamed("file", "seen"), "seen", "left_semi")
    return files.select("file", F.col("file").alias("seen")).union(imported.select("file", "seen")).distinct()


def _edges(pairs: DataFrame, kind: str, attrs: Column | None = None) -> DataFrame:
    """Rows of the model from (src, dst), owned by the source's file."""
    made = {"prov_source": F.lit("resolved"), "prov_extractor": F.lit(EXTRACTOR), "prov_commit": F.lit(""), "prov_confidence": F.lit(1.0)}
    return shaped(pairs, EDGES, kind=F.lit(kind), attrs=F.lit("{}") if attrs is None else attrs, origin_path=path_of(F.col("src")), resolved_from=F.lit(""), **made)


def _patch(rows: DataFrame, **values: Column) -> DataFrame:
    return rows.select("id", F.to_json(F.struct(*(v.alias(k) for k, v in values.items()))).alias("patch"))


def _count(rows: DataFrame, what: str) -> DataFrame:
    return rows.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")


def compose_prefixes(graph: Graph) -> Stitched:
    """``path_pattern`` of each route: its path below the prefix of the one mount that includes its router.

    A mount applies to the routes of its router in the file itself and in those that it imports.  Where several files have
    a router of that name the reference's head has to name one; a route with two different prefixes stays bare.
    """
    mounts = graph.nodes.where("kind = 'RouteMount'").select(F.col("id").alias("mount"), file_of(F.col("id")).alias("file"), *(attribute(F.col("attrs"), k).alias(k) for k in ("router_var", "router_ref", "prefix")))
    routes = graph.nodes.where("kind = 'Route'").select("id", file_of(F.col("id")).alias("seen"), "sym_path", attribute(F.col("attrs"), "router_var").alias("router_var"), attribute(F.col("attrs"), "path").alias("path"))
    met = cut(mounts.join(visible_files(graph), "file").join(routes.where("router_var <> ''"), ["seen", "router_var"]))
    head = F.when(F.col("router_ref").contains("."), F.substring_index("router_ref", ".", 1))
    stem, parent = F.regexp_extract("sym_path", r"([^/]*?)\.[^./]*$", 1), F.regexp_extract("sym_path", r"([^/]+)/[^/]+$", 1)
    several = met.groupBy("mount").agg(F.count_distinct("seen").alias("files"), F.count_distinct(F.when((head == stem) | (head == parent), F.col("seen"))).alias("named"))
    met = met.join(several, "mount").where((F.col("files") == 1) | (F.col("named") == 1) & F.coalesce((head == stem) | (head == parent), F.lit(False)))
    prefixes = met.where("prefix <> ''").groupBy("id").agg(F.count_distinct("prefix").alias("n"), F.min("prefix").alias("prefix"))
    whole = cut(routes.join(prefixes, "id", "left").select("id", "path", "n", F.when(F.col("n") == 1, composed(F.col("prefix"), F.col("path"))).otherwise(F.col("path")).alias("pattern")))
    lost = mounts.join(met.select("mount").distinct(), "mount", "left_anti")
    stats = _count(whole.where("pattern <> path"), "route_prefixes_composed").union(_count(whole.where("n > 1").select("id").union(lost.select("mount")), "mounts_unresolved"))
    return Stitched(set_attrs(graph, _patch(whole, path_pattern=F.col("pattern"))), stats)


def ground_providers(graph: Graph) -> Stitched:
    """PROVIDED_BY from each service to the one definition of its provider's name that its file sees."""
    services = graph.nodes.where("kind = 'Service'").select(F.col("id").alias("service"), file_of(F.col("id")).alias("file"), attribute(F.col("attrs"), "provider").alias("name")).where("name is not null")
    definitions = graph.nodes.where(F.col("kind").isin("Class", "Function", "Method")).select("id", "name", file_of(F.col("id")).alias("seen"))
    found = services.join(visible_files(graph), "file").join(definitions, ["seen", "name"]).groupBy("service").agg(F.count_distinct("id").alias("n"), F.min("id").alias("dst")).where("n = 1")
    found = cut(found.select(F.col("service").alias("src"), "dst"))
    cleared = clear_outgoing(graph, services.select("service"), "PROVIDED_BY")
    made = cleared.with_edges(cleared.edges.select(*EDGES.names).union(_edges(found, "PROVIDED_BY")))
    stats = _count(found, "providers_grounded").union(_count(services.join(found.select(F.col("src").alias("service")), "service", "left_anti"), "providers_unresolved"))
    every = services.select(F.col("service").alias("id")).join(found.withColumnRenamed("src", "id"), "id", "left")
    return Stitched(set_attrs(made, _patch(every, provider_symbol=F.coalesce("dst", F.lit("")))), stats)


def ground_handlers(graph: Graph) -> Stitched:
    """HANDLED_BY for routes that name a controller and its method: the method of the one class of that name."""
    routes = graph.nodes.where("kind = 'Route'").select("id", *(attribute(F.col("attrs"), k).alias(k) for k in ("handler_class", "handler_method"))).where("handler_class <> ''")
    classes = graph.nodes.where("kind = 'Class'").groupBy(F.col("name").alias("handler_class")).agg(F.count_distinct("id").alias("n"), F.min("id").alias("owner")).where("n = 1").drop("n")
    methods = graph.nodes.where("kind = 'Method'").select(F.col("id").alias("dst"))
    wanted = routes.join(classes, "handler_class").withColumn("dst", F.concat("owner", "handler_method", F.lit("().")))
    found = cut(wanted.join(methods, "dst", "left_semi").select(F.col("id").alias("src"), "dst"))
    cleared = clear_outgoing(graph, routes.select("id"), "HANDLED_BY")
    made = cleared.with_edges(cleared.edges.select(*EDGES.names).union(_edges(found, "HANDLED_BY")))
    patches = routes.join(found.withColumnRenamed("src", "id"), "id", "left")
    stats = _count(found, "handlers_grounded").union(_count(patches.where("dst is null"), "handlers_unresolved"))
    return Stitched(set_attrs(made, _patch(patches, handler=F.coalesce("dst", F.lit("")))), stats)


def relate_models(graph: Graph, relations: DataFrame) -> Stitched:
    """RELATES_TO among the models of one framework, from relations (id, name, dst, kind, extra): foreign keys find a table, others a class, if it is unique."""
    models = graph.nodes.where("kind = 'DataModel'").select("id", *(attribute(F.col("attrs"), k).alias(k) for k in ("framework", "table", "model_class")))
    wanted = relations.select(F.col("id").alias("src"), F.get("extra", 0).alias("framework"), F.col("name").alias("via"), F.col("kind").alias("how"), F.col("dst").alias("target"))
    by_table = (F.col("framework") == "sqlalchemy") & (F.col("how") == "fk")
    parts = F.split("target", r"\.")
    wanted = wanted.withColumn("table_key", F.when(by_table, F.get(parts, F.greatest(F.size(parts) - 2, F.lit(0))))).withColumn("class_key", F.when(~by_table, F.element_at(parts, -1)))
    one = lambda key: models.where(F.col(key).isNotNull()).groupBy("framework", F.col(key).alias(f"{'table' if key == 'table' else 'class'}_key")).agg(F.count_distinct("id").alias("n"), F.min("id").alias(f"by_{key}")).where("n = 1").drop("n")
    found = wanted.join(one("table"), ["framework", "table_key"], "left").join(one("model_class"), ["framework", "class_key"], "left")
    found = found.select("src", F.coalesce("by_table", "by_model_class").alias("dst"), "how", "via")
    kept = cut(found.where("dst is not null").groupBy("src", "dst", "how").agg(F.min("via").alias("via")))
    cleared = clear_outgoing(graph, models.select("id"), "RELATES_TO")
    made = cleared.with_edges(cleared.edges.select(*EDGES.names).union(_edges(kept, "RELATES_TO", F.to_json(F.struct(F.col("how").alias("kind"), "via")))))
    return Stitched(made, _count(kept, "relations_resolved").union(_count(found.where("dst is null"), "relations_unresolved")))


def stitch(graph: Graph, relations: DataFrame) -> Stitched:
    """All of the above, where there is anything for them."""
    graph = Graph(cut(graph.nodes), cut(graph.edges))
    steps = {"Route": (compose_prefixes, ground_handlers), "Service": (ground_providers,), "DataModel": (lambda g: relate_models(g, relations),)}
    there = {r[0] for r in graph.nodes.where(F.col("kind").isin(*steps)).select("kind").distinct().collect()}
    stats = graph.nodes.sparkSession.createDataFrame([], "what string, n long")
    for kind in steps:
        for step in steps[kind] if kind in there else ():
            done = step(graph)
            graph = Graph(cut(done.graph.nodes), cut(done.graph.edges))
            stats = stats.union(done.stats)
    return Stitched(graph, stats)
