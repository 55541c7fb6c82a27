"""Many services as one: which service calls which, by matching calls to routes, and traces over that map."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelattice.functions.text import route_regex, route_template, url_path
from codelattice.operators.graphs import trace as _trace


def merged_routes(frameworks: DataFrame, specs: DataFrame) -> DataFrame:
    """Routes (service, method, path) of frameworks and of API descriptions, one for each method and template; a framework's comes first."""
    both = frameworks.select("service", "method", "path", F.lit(0).alias("rank")).union(specs.select("service", "method", "path", F.lit(1).alias("rank")))
    w = Window.partitionBy("service", F.upper("method"), route_template(F.col("path"))).orderBy("rank", "path")
    return both.withColumn("n", F.row_number().over(w)).where("n = 1").select("service", F.upper("method").alias("method"), "path")


def matches(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """Calls (service, method, url) with every route (service, method, path) of another service that serves them.

    Both sides are joined on method and number of path segments, so the regular expression is only tried on routes that can match.
    """
    segments = lambda path: F.size(F.split(F.regexp_replace(path, "^/+|/+$", ""), "/"))
    c = calls.select(F.col("service").alias("caller"), F.upper("method").alias("method"), url_path(F.col("url")).alias("call_path")).where("call_path is not null").withColumn("n", segments(F.col("call_path")))
    r = routes.select(F.col("service").alias("callee"), F.upper("method").alias("method"), F.col("path").alias("route")).withColumn("n", segments(F.col("route"))).withColumn("pattern", route_regex(F.col("route")))
    return c.join(r, ["method", "n"]).where("caller <> callee").where(F.expr("call_path rlike pattern")).select("caller", "method", "call_path", "callee", "route")


def service_map(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """(caller, callee, method, call_path, route) of calls that exactly one route serves; ambiguous ones are left out, as are those without a route."""
    found = matches(calls, routes).distinct()
    one = F.count("*").over(Window.partitionBy("caller", "method", "call_path"))
    return found.withColumn("k", one).where("k = 1").select("caller", "callee", "method", "call_path", "route")


def unresolved(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """(service, method, path) of calls that the map leaves out."""
    known = service_map(calls, routes).select(F.col("caller").alias("service"), "method", F.col("call_path").alias("path"))
    own = calls.select("service", F.upper("method").alias("method"), url_path(F.col("url")).alias("path")).distinct()
    return own.join(known, ["service", "method", "path"], "left_anti")


def trace(calls: DataFrame, routes: DataFrame, start: str, direction: str = "downstream", depth: int = 50) -> DataFrame:
    return _trace(service_map(calls, routes).select("caller", "callee"), start, direction, depth)


METHODS = ("get", "put", "post", "delete", "patch", "head", "options", "trace")


def openapi_routes(specs: DataFrame) -> DataFrame:
    """(service, method, path, operation_id) of OpenAPI documents (service, spec JSON); what is no operation is passed over."""
    paths = specs.select("service", F.explode(F.from_json(F.get_json_object("spec", "$.paths"), "map<string,map<string,string>>")).alias("path", "operations"))
    ops = paths.select("service", "path", F.explode("operations").alias("method", "operation")).where(F.lower("method").isin(*METHODS))
    return ops.select("service", F.upper("method").alias("method"), "path", F.coalesce(F.get_json_object("operation", "$.operationId"), F.lit("")).alias("operation_id"))


def fan_out(tables: dict[str, DataFrame]) -> DataFrame:
    """The same table of several members, with the member's name as ``service``."""
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("service", F.lit(name)) for name, df in tables.items()])
