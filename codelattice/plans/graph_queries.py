"""Queries over the graph view: the pattern language, the store's operations, algorithms, vectors and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.cypher.engine import plan
from codelattice.model import Graph
from codelattice.operators import graphs, retrieve, store, vectors, verbs
from codelattice.plans.registry import query
from codelattice.plans.tables import ctes, graph, read

G = ctes()


def _cypher(name: str, text: str, sql: str) -> None:
    """Registers a query of the pattern language; its columns are aliased in the text."""
    query(f"WITH {G} {sql}", name)(lambda spark, sf_dir: plan(graph(spark, sf_dir), text))


def _hop(kind: str, a: str = "a", b: str = "b", e: str = "e") -> str:
    return f"(SELECT DISTINCT src, dst FROM edges WHERE kind = '{kind}') {e} ON {e}.src = {a}.id JOIN nodes {b} ON {b}.id = {e}.dst"


_cypher("cy_flagship", "MATCH (n:Package)-[:CONTAINS]->(c:Class)-[:CONTAINS]->(o:Function) RETURN n.name AS name, count(o) AS orders ORDER BY orders DESC, name LIMIT 10",
    f"SELECT a.name AS name, count(c.id) AS orders FROM nodes a JOIN {_hop('CONTAINS', 'a', 'b', 'e1')} JOIN {_hop('CONTAINS', 'b', 'c', 'e2')} WHERE a.kind = 'Package' AND b.kind = 'Class' AND c.kind = 'Function' GROUP BY a.name ORDER BY orders DESC, name LIMIT 10")
_cypher("cy_project_label", "MATCH (c:Class) RETURN c.name AS name, c.path AS path, c.start_line AS first, c AS id", "SELECT name, sym_path AS path, span_start AS first, id FROM nodes WHERE kind = 'Class'")
_cypher("cy_inline_props", 'MATCH (c:Class {start_line: 7}) RETURN c.name AS name', "SELECT name FROM nodes WHERE kind = 'Class' AND span_start = 7")
_cypher("cy_filter_cmp", "MATCH (f:Function) WHERE f.start_line >= 100 AND f.end_line < 400 AND f.confidence <> 1.0 RETURN f.name AS name, f.confidence AS confidence", "SELECT name, prov_confidence AS confidence FROM nodes WHERE kind = 'Function' AND span_start >= 100 AND span_end < 400 AND prov_confidence <> 1")
_cypher("cy_in", 'MATCH (p:Package) WHERE p.name IN ["NATION_1", "NATION_7", "none", null] RETURN p.name AS name', "SELECT name FROM nodes WHERE kind = 'Package' AND name IN ('NATION_1', 'NATION_7', 'none')")
_cypher("cy_string_pred", 'MATCH (f:File) WHERE f.path STARTS WITH "src1" AND f.path CONTAINS "/en/" AND NOT f.path ENDS WITH "7" RETURN f.path AS path', "SELECT sym_path AS path FROM nodes WHERE kind = 'File' AND starts_with(sym_path, 'src1') AND contains(sym_path, '/en/') AND NOT ends_with(sym_path, '7')")
_cypher("cy_bool", 'MATCH (f:Function) WHERE (f.source = "llm" OR f.start_line < 50) AND NOT (f.source = "parsed" AND f.end_line > 30) RETURN f.name AS name', "SELECT name FROM nodes WHERE kind = 'Function' AND (prov_source = 'llm' OR span_start < 50) AND NOT (prov_source = 'parsed' AND span_end > 30)")
_cypher("cy_null_logic", "MATCH (p:Package) WHERE NOT p.start_line > 3 RETURN p.name AS name", "SELECT name FROM nodes WHERE kind = 'Package' AND NOT coalesce(span_start > 3, false)")
_cypher("cy_hop_out", "MATCH (r:Repository)-[:CONTAINS]->(p:Package) RETURN r.name AS region, p.name AS nation", f"SELECT a.name AS region, b.name AS nation FROM nodes a JOIN {_hop('CONTAINS')} WHERE a.kind = 'Repository' AND b.kind = 'Package'")
_cypher("cy_hop_in", "MATCH (i:Interface)<-[:CALLS]-(f:Function) RETURN i.name AS part, count(f) AS callers", f"SELECT b.name AS part, count(*) AS callers FROM nodes a JOIN {_hop('CALLS')} WHERE a.kind = 'Function' AND b.kind = 'Interface' GROUP BY b.name")
_cypher("cy_hop_both", "MATCH (p:Package)-[:CONTAINS]-(x) RETURN p.name AS nation, x.kind AS kind, count(x) AS n", "SELECT p.name AS nation, x.kind AS kind, count(*) AS n FROM nodes p JOIN (SELECT src AS s, dst AS d FROM edges WHERE kind = 'CONTAINS' UNION SELECT dst, src FROM edges WHERE kind = 'CONTAINS') e ON e.s = p.id JOIN nodes x ON x.id = e.d WHERE p.kind = 'Package' GROUP BY ALL")
_cypher("cy_hop_untyped", "MATCH (s:Service)-[]->(x:Interface) RETURN s.name AS supplier, count(x) AS parts", "SELECT s.name AS supplier, count(*) AS parts FROM nodes s JOIN (SELECT DISTINCT src, dst FROM edges) e ON e.src = s.id JOIN nodes x ON x.id = e.dst WHERE s.kind = 'Service' AND x.kind = 'Interface' GROUP BY s.name")
_cypher("cy_varlen_1_3", "MATCH (r:Repository)-[:CONTAINS*1..3]->(x) RETURN r.name AS region, x.kind AS kind, count(x) AS n",
    ", reach AS (WITH RECURSIVE w AS (SELECT id AS s, id AS t, 0 AS d FROM nodes WHERE kind = 'Repository' UNION SELECT w.s, e.dst, w.d + 1 FROM w JOIN edges e ON e.src = w.t AND e.kind = 'CONTAINS' WHERE w.d < 3) SELECT DISTINCT s, t FROM w WHERE d > 0) SELECT r.name AS region, x.kind AS kind, count(*) AS n FROM reach JOIN nodes r ON r.id = s JOIN nodes x ON x.id = t GROUP BY ALL")
_cypher("cy_varlen_2_2", "MATCH (p:Package)-[:CONTAINS*2]->(f:Function) RETURN p.name AS nation, count(DISTINCT f) AS n", f"SELECT a.name AS nation, count(DISTINCT c.id) AS n FROM nodes a JOIN {_hop('CONTAINS', 'a', 'b', 'e1')} JOIN {_hop('CONTAINS', 'b', 'c', 'e2')} WHERE a.kind = 'Package' AND c.kind = 'Function' GROUP BY a.name")
_cypher("cy_multi_pattern", "MATCH (n:Package)-[:CONTAINS]->(s:Service), (n)-[:CONTAINS]->(c:Class) RETURN n.name AS nation, count(DISTINCT s) AS suppliers, count(DISTINCT c) AS customers", f"SELECT n.name AS nation, count(DISTINCT s.id) AS suppliers, count(DISTINCT c.id) AS customers FROM nodes n JOIN {_hop('CONTAINS', 'n', 's', 'e1')} JOIN {_hop('CONTAINS', 'n', 'c', 'e2')} WHERE n.kind = 'Package' AND s.kind = 'Service' AND c.kind = 'Class' GROUP BY n.name")
_cypher("cy_triangle", "MATCH (n:Package)-[:CONTAINS]->(s:Service)-[:IMPLEMENTS]->(i:Interface)<-[:CALLS]-(f:Function)<-[:CONTAINS]-(c:Class)<-[:CONTAINS]-(n) RETURN n.name AS nation, count(*) AS paths",
    "SELECT n.name AS nation, count(*) AS paths FROM nodes n JOIN (SELECT DISTINCT src, dst FROM edges WHERE kind = 'CONTAINS') e1 ON e1.src = n.id JOIN nodes s ON s.id = e1.dst AND s.kind = 'Service' JOIN (SELECT DISTINCT src, dst FROM edges WHERE kind = 'IMPLEMENTS') e2 ON e2.src = s.id JOIN (SELECT DISTINCT src, dst FROM edges WHERE kind = 'CALLS') e3 ON e3.dst = e2.dst JOIN (SELECT DISTINCT src, dst FROM edges WHERE kind = 'CONTAINS') e4 ON e4.dst = e3.src JOIN (SELECT DISTINCT src, dst FROM edges WHERE kind = 'CONTAINS') e5 ON e5.dst = e4.src AND e5.src = n.id WHERE n.kind = 'Package' GROUP BY n.name")
_cypher("cy_exists", "MATCH (c:Class) WHERE (c)-[:CONTAINS]->(:Function) AND c.start_line > 5 RETURN c.name AS name", "SELECT name FROM nodes c WHERE kind = 'Class' AND span_start > 5 AND EXISTS (SELECT 1 FROM edges e JOIN nodes f ON f.id = e.dst WHERE e.src = c.id AND e.kind = 'CONTAINS' AND f.kind = 'Function')")
_cypher("cy_not_exists", 'MATCH (c:Class) WHERE NOT (c)-[:CONTAINS]->(:Function {source: "llm"}) RETURN c.name AS name', "SELECT name FROM nodes c WHERE kind = 'Class' AND NOT EXISTS (SELECT 1 FROM edges e JOIN nodes f ON f.id = e.dst WHERE e.src = c.id AND e.kind = 'CONTAINS' AND f.kind = 'Function' AND f.prov_source = 'llm')")
_cypher("cy_exists_or", 'MATCH (c:Class) WHERE NOT (c)-[:CONTAINS]->(:Function {source: "llm"}) OR c.start_line < 20 RETURN c.name AS name', "SELECT name FROM nodes c WHERE kind = 'Class' AND (span_start < 20 OR NOT EXISTS (SELECT 1 FROM edges e JOIN nodes f ON f.id = e.dst WHERE e.src = c.id AND e.kind = 'CONTAINS' AND f.kind = 'Function' AND f.prov_source = 'llm'))")
_cypher("cy_agg_count", "MATCH (c:Class)-[:CONTAINS]->(f:Function) RETURN count(*) AS pairs, count(DISTINCT c) AS owners", f"SELECT count(*) AS pairs, count(DISTINCT a.id) AS owners FROM nodes a JOIN {_hop('CONTAINS')} WHERE a.kind = 'Class' AND b.kind = 'Function' HAVING count(*) > 0")
_cypher("cy_agg_empty", 'MATCH (c:Class {name: "nobody"}) RETURN count(c) AS n', "SELECT count(*) AS n FROM nodes WHERE kind = 'Class' AND name = 'nobody' HAVING count(*) > 0")
_cypher("cy_agg_collect", "MATCH (r:Repository)-[:CONTAINS]->(p:Package) RETURN r.name AS region, collect(p.name) AS nations, collect(DISTINCT p.kind) AS kinds", f"SELECT a.name AS region, list_sort(list(b.name)) AS nations, list_sort(list(DISTINCT b.kind)) AS kinds FROM nodes a JOIN {_hop('CONTAINS')} WHERE a.kind = 'Repository' AND b.kind = 'Package' GROUP BY a.name")
_cypher("cy_agg_minmaxavg", "MATCH (c:Class)-[:CONTAINS]->(f:Function) RETURN c.name AS customer, min(f.start_line) AS low, max(f.end_line) AS high, avg(f.start_line) AS mean", f"SELECT a.name AS customer, min(b.span_start) AS low, max(b.span_end) AS high, avg(b.span_start) AS mean FROM nodes a JOIN {_hop('CONTAINS')} WHERE a.kind = 'Class' AND b.kind = 'Function' GROUP BY a.name")
_cypher("cy_group_order", "MATCH (i:Interface)<-[:CALLS]-(f:Function) RETURN i.name AS part, f.source AS source, count(f) AS n ORDER BY n DESC, part, source SKIP 3 LIMIT 20", f"SELECT b.name AS part, a.prov_source AS source, count(*) AS n FROM nodes a JOIN {_hop('CALLS')} WHERE a.kind = 'Function' AND b.kind = 'Interface' GROUP BY ALL ORDER BY n DESC, part, source LIMIT 20 OFFSET 3")
_cypher("cy_skip_limit", "MATCH (f:Function) RETURN f.name AS name, f.start_line AS line ORDER BY f.source DESC, f.start_line SKIP 10 LIMIT 25", "SELECT name, span_start AS line FROM nodes WHERE kind = 'Function' ORDER BY prov_source DESC, span_start LIMIT 25 OFFSET 10")
_cypher("cy_distinct", "MATCH (f:Function) RETURN DISTINCT f.source AS source, f.confidence AS confidence ORDER BY source", "SELECT DISTINCT prov_source AS source, prov_confidence AS confidence FROM nodes WHERE kind = 'Function'")
_cypher("cy_attrs_access", 'MATCH (c:Class) WHERE c.attrs.segment = "BUILDING" AND c.attrs.layer.nation <> "3" RETURN c.name AS name, c.attrs.layer.nation AS nation', "SELECT name, json_extract_string(attrs, '$.layer.nation') AS nation FROM nodes WHERE kind = 'Class' AND json_extract_string(attrs, '$.segment') = 'BUILDING' AND json_extract_string(attrs, '$.layer.nation') <> '3'")
_cypher("cy_attrs_number", "MATCH (i:Interface) WHERE i.attrs.size >= 40 RETURN i.attrs.brand AS brand, count(i) AS n", "SELECT json_extract_string(attrs, '$.brand') AS brand, count(*) AS n FROM nodes WHERE kind = 'Interface' AND CAST(json_extract_string(attrs, '$.size') AS DOUBLE) >= 40 GROUP BY 1")


# Store ------------------------------------------------------------------------

ID = "'lat sql tables {0}/{1} {0}#'"


def _id(table: str, key: object) -> str:
    return f"lat sql tables {table}/{key} {table}#"


@query(f"WITH {G} SELECT id, name FROM nodes WHERE kind IN ('Function', 'Class') AND starts_with(sym_path, 'orders/1') AND prov_source IN ('resolved', 'manual', 'parsed')")
def gs_query_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.find(graph(spark, sf_dir), ("Function", "Class"), path_prefix="orders/1", min_source="resolved").select("id", "name")


@query(f"WITH {G} SELECT id, name FROM nodes WHERE kind = 'Package' ORDER BY id LIMIT 6")
def gs_query_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row more than the limit, which tells that there are more."""
    return store.find(graph(spark, sf_dir), ("Package",), limit=5).select("id", "name")


@query(f"""WITH {G}, h AS (SELECT DISTINCT src AS s, dst AS d FROM edges WHERE kind = 'CONTAINS' UNION SELECT dst, src FROM edges WHERE kind = 'CONTAINS'),
 d0 AS (SELECT id AS start, id FROM nodes WHERE kind = 'Package'), d1 AS (SELECT DISTINCT start, d AS id FROM d0 JOIN h ON s = id WHERE d <> start),
 d2 AS (SELECT DISTINCT start, d AS id FROM d1 JOIN h ON s = id WHERE d <> start AND (start, d) NOT IN (SELECT start, id FROM d1))
 SELECT start, depth, count(*) AS n FROM (SELECT start, 1 AS depth FROM d1 UNION ALL SELECT start, 2 FROM d2) GROUP BY ALL""")
def gs_neighbors_d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return store.neighbors(g, g.nodes.where("kind = 'Package'").select("id"), ("CONTAINS",), 2).groupBy("start", "depth").agg(F.count("*").alias("n"))


@query(f"WITH {G}, p AS (SELECT id FROM nodes WHERE kind = 'Package') SELECT kind, prov_source, count(*) AS n FROM edges WHERE src IN (FROM p) OR dst IN (FROM p) GROUP BY ALL")
def gs_adjacent_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return store.adjacent(g, g.nodes.where("kind = 'Package'").select("id")).groupBy("kind", "prov_source").agg(F.count("*").alias("n"))


@query(f"WITH {G} SELECT id, kind, name FROM nodes WHERE id IN ({ID.format('nation', 3)}, {ID.format('part', 5)})")
def gs_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.get(graph(spark, sf_dir), [_id("nation", 3), _id("part", 5), "nothing"]).select("id", "kind", "name")


@query(f"WITH {G} SELECT src, count(*) AS n FROM edges WHERE NOT (kind = 'CALLS' AND src IN ({ID.format('orders', 1)}, {ID.format('orders', 2)})) AND kind IN ('CALLS', 'IMPLEMENTS') GROUP BY src")
def gs_clear_outgoing(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = store.clear_outgoing(graph(spark, sf_dir), [_id("orders", 1), _id("orders", 2)], "CALLS")
    return g.edges.where("kind in ('CALLS', 'IMPLEMENTS')").groupBy("src").agg(F.count("*").alias("n"))


@query(f"""WITH {G}, kept AS (SELECT * FROM edges e WHERE NOT (prov_source = 'resolved' AND origin_path IN (SELECT sym_path FROM (SELECT 'orders/' || CAST(o_orderkey AS STRING) AS sym_path FROM orders WHERE o_orderstatus = 'O')))),
 gone AS (SELECT id FROM nodes n WHERE kind = 'Package' AND NOT EXISTS (SELECT 1 FROM kept WHERE dst = n.id))
 SELECT kind, prov_source, count(*) AS n FROM kept WHERE src NOT IN (FROM gone) AND dst NOT IN (FROM gone) GROUP BY ALL""")
def gs_clear_resolved_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = read(spark, sf_dir, "orders").where("o_orderstatus = 'O'").selectExpr("'orders/' || CAST(o_orderkey AS STRING) AS path")
    return store.clear_resolved(graph(spark, sf_dir), paths).edges.groupBy("kind", "prov_source").agg(F.count("*").alias("n"))


@query(f"""WITH {G} SELECT n.id, coalesce(json_extract_string(n.attrs, '$.segment'), '-') AS segment, CASE WHEN c_acctbal > 5000 THEN CAST(c_custkey AS STRING) END AS key, json_extract_string(n.attrs, '$.layer.nation') AS nation
 FROM nodes n JOIN customer ON n.id = {"'lat sql tables customer/' || CAST(c_custkey AS STRING) || ' customer#'"}""")
def gs_set_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    patches = read(spark, sf_dir, "customer").where("c_acctbal > 5000").selectExpr("'lat sql tables customer/' || CAST(c_custkey AS STRING) || ' customer#' AS id", "'{\"key\":' || CAST(c_custkey AS STRING) || '}' AS patch")
    nodes = store.set_attrs(graph(spark, sf_dir), patches).nodes.where("kind = 'Class'")
    return nodes.select("id", F.coalesce(F.get_json_object("attrs", "$.segment"), F.lit("-")).alias("segment"), F.get_json_object("attrs", "$.key").alias("key"), F.get_json_object("attrs", "$.layer.nation").alias("nation"))


@query(f"""WITH {G}, fresh AS (SELECT 'lat sql tables customer/' || CAST(k AS STRING) || ' customer#' AS id, 'new ' || CAST(k AS STRING) AS name FROM (SELECT c_custkey AS k FROM customer WHERE c_nationkey = 4)),
 old AS (SELECT n.id, n.name FROM nodes n WHERE kind = 'Class' AND id NOT IN (SELECT id FROM fresh)) SELECT id, name FROM old UNION ALL SELECT id, name FROM fresh""")
def gs_add_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    keys = read(spark, sf_dir, "customer").where("c_nationkey = 4").selectExpr("'lat sql tables customer/' || CAST(c_custkey AS STRING) || ' customer#' AS id", "'new ' || CAST(c_custkey AS STRING) AS new_name")
    fresh = g.nodes.where("kind = 'Class'").join(keys, "id").withColumn("name", F.col("new_name")).drop("new_name")
    return store.add(g, fresh).nodes.where("kind = 'Class'").select("id", "name")


@query(f"""WITH {G}, own AS (SELECT id FROM nodes WHERE origin_path = 'orders/1-URGENT/1' OR origin_path IN (SELECT sym_path FROM nodes WHERE kind = 'Function' AND name = '7'))
 SELECT kind, count(*) AS n FROM edges WHERE src NOT IN (FROM own) AND dst NOT IN (FROM own) GROUP BY kind""")
def gs_delete_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    path = g.nodes.where("kind = 'Function' and name = '7'").select("sym_path").first()
    for p in ["orders/1-URGENT/1", *([path[0]] if path else [])]:
        g = store.delete_file(g, p)
    return g.edges.groupBy("kind").agg(F.count("*").alias("n"))


@query(f"""WITH {G}, f AS (SELECT sym_path AS p FROM nodes WHERE kind = 'Function' AND name = '7'), kept AS (SELECT id, name FROM nodes WHERE kind IN ('Function', 'Method') AND origin_path NOT IN (FROM f))
 SELECT id, name FROM kept UNION ALL SELECT 'lat sql tables extra/1 extra#', 'extra' """)
def gs_upsert_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    path = g.nodes.where("kind = 'Function' and name = '7'").select("sym_path").first()[0]
    own = g.nodes.where("kind = 'Function' and name = '7'").withColumns({"id": F.lit("lat sql tables extra/1 extra#"), "name": F.lit("extra"), "kind": F.lit("Method")})
    return store.upsert(g, Graph(own, g.edges.limit(0)), path).nodes.where("kind in ('Function', 'Method')").select("id", "name")


@query(f"WITH {G}, r AS (SELECT id FROM nodes WHERE kind = 'Package'), x AS (SELECT DISTINCT dst AS id FROM edges WHERE kind = 'CONTAINS' AND src IN (FROM r) UNION SELECT src FROM edges WHERE kind = 'CONTAINS' AND dst IN (FROM r) UNION FROM r) SELECT kind, count(*) AS n FROM nodes WHERE id IN (FROM x) GROUP BY kind")
def gs_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return store.expand(g, g.nodes.where("kind = 'Package'").select("id"), ("CONTAINS",)).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"WITH {G} SELECT 'node' AS what, kind, count(*) AS n FROM nodes GROUP BY kind UNION ALL SELECT 'edge', kind, count(*) FROM edges GROUP BY kind")
def ag_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verbs.kind_counts(graph(spark, sf_dir))


@query(f"WITH {G} SELECT (SELECT count(*) FROM nodes WHERE kind = 'File') AS files, (SELECT count(*) FROM nodes) AS nodes, CAST(0 AS BIGINT) AS external, count(*) AS edges, count(*) FILTER (prov_source = 'resolved') AS resolved, CAST(3 AS BIGINT) AS unresolved FROM edges")
def ag_index_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = spark.createDataFrame([("refs_unresolved", 1), ("imports_external", 5), ("refs_unresolved", 2)], "what string, n long")
    return verbs.index_report(graph(spark, sf_dir), stats)


@query(f"WITH {G} SELECT src, dst, round(sum(CASE prov_source WHEN 'resolved' THEN 1.0::DOUBLE WHEN 'manual' THEN 0.8 WHEN 'llm' THEN 0.3 ELSE 0.5 END), 6) AS weight FROM edges WHERE kind = 'CALLS' GROUP BY src, dst")
def ag_parallel_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.weighted_edges(graph(spark, sf_dir), ("CALLS",)).groupBy("src", "dst").agg(F.round(F.sum("weight"), 6).alias("weight"))


@query(f"WITH {G} SELECT id FROM nodes WHERE kind = 'Function' AND prov_source IN ('resolved', 'manual')")
def pf_retrieval_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.floor(graph(spark, sf_dir).nodes.where("kind = 'Function'"), "resolved", llm_facts=False).select("id")


@query(f"WITH {G} SELECT e.src, e.dst, e.kind FROM edges e SEMI JOIN (SELECT id FROM nodes WHERE kind <> 'Function') a ON a.id = e.src SEMI JOIN nodes b ON b.id = e.dst WHERE e.kind = 'CONTAINS'")
def jn_edge_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    kept = g.edges.where("kind = 'CONTAINS'").join(g.nodes.where("kind <> 'Function'").select(F.col("id").alias("src")), "src", "left_semi")
    return store.with_endpoints(kept, g.nodes).select("src", "dst", "kind")


# Algorithms -------------------------------------------------------------------


def _trade(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nations as nodes, and as weighted edges what customers of one ordered from suppliers of another."""
    line, order, customer, supplier, nation = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier", "nation"))
    joined = line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    edges = joined.select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst"), F.col("l_quantity").alias("weight"))
    return nation.select(F.col("n_nationkey").alias("id")), edges


def _pagerank_sql(personal: str) -> str:
    return f"""WITH RECURSIVE n AS MATERIALIZED (SELECT n_nationkey AS id, {personal} AS m FROM nation), t AS MATERIALIZED (SELECT id, m / sum(m) OVER () AS m FROM n),
 e AS MATERIALIZED (SELECT c_nationkey AS src, s_nationkey AS dst, sum(l_quantity) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
 s AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM e),
 r AS (SELECT 0 AS i, id, m AS rank FROM t UNION ALL SELECT any_value(c.i) + 1, t.id, 0.15 * any_value(t.m) + 0.85 * (coalesce(sum(CASE WHEN c.id = s.src THEN c.rank * s.p END), 0) + any_value(t.m) * sum(CASE WHEN c.first AND c.id NOT IN (SELECT src FROM s) THEN c.rank ELSE 0 END))
  FROM (SELECT r.*, true AS first FROM r) c CROSS JOIN t LEFT JOIN s ON s.dst = t.id AND s.src = c.id WHERE c.i < 20 GROUP BY t.id)
 SELECT id, round(rank, 9) AS rank FROM r WHERE i = 20"""


@query(_pagerank_sql("1.0::DOUBLE"))
def ga_pagerank20(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _trade(spark, sf_dir)
    return graphs.pagerank(edges, nodes, iterations=20).select("id", F.round("rank", 9).alias("rank"))


@query(_pagerank_sql("CASE WHEN n_regionkey = 1 THEN 1.0::DOUBLE ELSE 0 END"))
def ga_pagerank_personalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _trade(spark, sf_dir)
    personal = read(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("id"), F.lit(1.0).alias("mass"))
    return graphs.pagerank(edges, nodes, personal, iterations=20).select("id", F.round("rank", 9).alias("rank"))


_W = "CASE prov_source WHEN 'resolved' THEN 1.0 WHEN 'manual' THEN 0.8 WHEN 'llm' THEN 0.3 WHEN 'parsed' THEN 0.5 ELSE 0.5 END"


@query(f"""WITH {G}, b AS (SELECT f, t, kind, max(w) AS w FROM (SELECT src AS f, dst AS t, kind, {_W} AS w FROM edges WHERE kind IN ('CONTAINS', 'IMPLEMENTS') UNION ALL SELECT dst, src, kind, {_W} FROM edges WHERE kind IN ('CONTAINS', 'IMPLEMENTS')) GROUP BY ALL),
 c AS MATERIALIZED (SELECT f, t, w FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY kind, t) AS n FROM b) WHERE n <= 25),
 s0 AS (SELECT id, 1.0 AS score FROM nodes WHERE kind = 'Package'), s1 AS (SELECT t AS id, max(score * 0.6 * w) AS score FROM s0 JOIN c ON f = id WHERE t NOT IN (SELECT id FROM s0) GROUP BY t),
 s2 AS (SELECT t AS id, max(score * 0.6 * w) AS score FROM s1 JOIN c ON f = id WHERE t NOT IN (SELECT id FROM s0) AND t NOT IN (SELECT id FROM s1) GROUP BY t)
 SELECT id, round(score, 6)::DOUBLE AS score, depth FROM (SELECT *, 0 AS depth FROM s0 UNION ALL SELECT *, 1 FROM s1 UNION ALL SELECT *, 2 FROM s2)""")
def ga_expand_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    seeds = g.nodes.where("kind = 'Package'").select("id", F.lit(1.0).alias("score"))
    return graphs.expand_scored(g, seeds, 2, ("CONTAINS", "IMPLEMENTS")).select("id", F.round("score", 6).alias("score"), "depth")


@query(f"""WITH {G}, b AS (SELECT dst AS f, src AS t, kind, max({_W}) AS w FROM edges WHERE kind IN ('CALLS', 'IMPORTS', 'IMPLEMENTS') GROUP BY ALL), c AS (SELECT f, t, w FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY kind, t) AS n FROM b) WHERE n <= 25)
 SELECT t AS id, round(max(0.6 * w), 6)::DOUBLE AS score, 1 AS depth FROM c JOIN nodes p ON p.id = f AND p.kind = 'Interface' AND p.span_start IS NULL AND p.sym_path IN ('part/1', 'part/2', 'part/3') GROUP BY t""")
def ga_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.impact(graph(spark, sf_dir), [_id("part", k) for k in (1, 2, 3)], 1).select("id", F.round("score", 6).alias("score"), "depth")


@query(f"""WITH {G}, u AS MATERIALIZED (SELECT DISTINCT src, dst, kind FROM edges WHERE kind = 'CONTAINS'), d1 AS (SELECT * FROM u WHERE src = {ID.format('nation', 5)} OR dst = {ID.format('nation', 5)}),
 f AS (SELECT src AS id FROM d1 UNION SELECT dst FROM d1), d2 AS (SELECT * FROM u WHERE src IN (FROM f) OR dst IN (FROM f)) SELECT * FROM d1 UNION SELECT * FROM d2""")
def ga_edges_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.edges_within(graph(spark, sf_dir), [_id("nation", 5)], 2, ("CONTAINS",))


@query("WITH RECURSIVE l AS MATERIALIZED (SELECT DISTINCT l_orderkey AS a, l_partkey AS b FROM lineitem), w AS (SELECT 5::BIGINT AS n, 0 AS hop UNION SELECT b, hop + 1 FROM w JOIN l ON a = n WHERE hop < 5) SELECT CAST(n AS STRING) AS service, min(hop)::INTEGER AS hop FROM w WHERE n <> 5 GROUP BY n")
def ga_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five hops downstream over all of lineitem: an order calls its parts, and a part's key is the key of an order too."""
    links = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("caller"), F.col("l_partkey").cast("string").alias("callee"))
    return graphs.trace(links, "5", most=5)


@query(f"WITH RECURSIVE {G}, w AS (SELECT id AS start, id FROM nodes WHERE kind = 'Repository' UNION SELECT w.start, e.dst FROM w JOIN edges e ON e.src = w.id AND e.kind = 'CONTAINS') SELECT start, count(*) AS n FROM w WHERE id <> start GROUP BY start")
def ga_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return graphs.reachable(g, g.nodes.where("kind = 'Repository'").select("id"), ("CONTAINS",)).groupBy("start").agg(F.count("*").alias("n"))


# Vectors and retrieval ----------------------------------------------------------

_KIND = "CASE label % 3 WHEN 0 THEN 'Chunk' WHEN 1 THEN 'DocChunk' ELSE 'Summary' END"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").selectExpr("'vec/' || CAST(vec_id AS STRING) AS ref", "embedding AS vector", f"{_KIND} AS kind", "'label/' || CAST(label AS STRING) AS path", "'{}' AS attrs")


def _first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return read(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0]


_V = f"v AS (SELECT 'vec/' || CAST(vec_id AS STRING) AS ref, embedding::DOUBLE[] AS vector, {_KIND} AS kind, 'label/' || CAST(label AS STRING) AS path FROM embeddings), q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT ref, kind, path, round(greatest(0, least(1, list_cosine_similarity(vector, q))), 6) AS score FROM v, q)"


@query(f"WITH {_V} SELECT * FROM s ORDER BY score DESC, ref LIMIT 10")
def vs_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.search(_vectors(spark, sf_dir), _first_vector(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


@query(f"WITH {_V} SELECT * FROM s WHERE kind = 'DocChunk' ORDER BY score DESC, ref LIMIT 7")
def vs_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.search(_vectors(spark, sf_dir), _first_vector(spark, sf_dir), 7, {"kind": "DocChunk"}).withColumn("score", F.round("score", 6))


@query(f"WITH {_V} SELECT ref, CASE WHEN path = 'label/2' THEN 'Summary' ELSE kind END AS kind, path FROM v")
def vs_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _vectors(spark, sf_dir)
    return vectors.upsert(old, old.where("path = 'label/2'").withColumn("kind", F.lit("Summary")), 64).select("ref", "kind", "path")


@query(f"WITH {_V} SELECT ref FROM v WHERE NOT (kind = 'Chunk' AND path = 'label/3')")
def vs_delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.delete_where(_vectors(spark, sf_dir), {"kind": "Chunk", "path": "label/3"}).select("ref")


@query(f"WITH {_V} SELECT ref, kind, round(CASE WHEN kind = 'DocChunk' THEN 0.7 ELSE 1 END * greatest(0, least(1, list_cosine_similarity(vector, q))), 6) AS score FROM v, q")
def rt_doc_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.array(*(F.lit(float(x)) for x in _first_vector(spark, sf_dir)))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), vectors.cosine(F.col("vector"), q)))
    return _vectors(spark, sf_dir).select("ref", "kind", F.round(retrieve.doc_weighted(score, F.col("kind"), F.lit(False)), 6).alias("score"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("id"), F.col("value").alias("score"), F.array("event_type").alias("why"), F.col("event_id").alias("seq"))


@query("SELECT CAST(user_id AS STRING) AS id, max(value) AS score, min(event_id) AS seq, (SELECT list(e ORDER BY s) FROM (SELECT event_type AS e, min(event_id) AS s FROM events i WHERE i.user_id = o.user_id GROUP BY 1)) AS why FROM events o GROUP BY user_id")
def rt_dedupe_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.dedupe(_items(spark, sf_dir))


@query("""WITH t AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda w: lower(w))) AS words, 1.0 / (1 + n_chars) AS base FROM documents),
 s AS (SELECT doc_id, base, len(list_filter(['reou', 'tion', 'est'], lambda w: list_contains(words, w))) / 3.0 AS overlap FROM t) SELECT doc_id, round(0.7 * base + 0.3 * overlap, 6)::DOUBLE AS score FROM s ORDER BY score DESC, doc_id LIMIT 20""")
def rt_lexical_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best documents for three plain words; they are single lower-case parts, so that words and subtokens coincide."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (1.0 / (1 + F.col("n_chars"))).alias("score"), "text")
    ranked = retrieve.rerank_lexical(docs, "reou tion est", F.col("text")).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))
    return ranked.orderBy(F.desc("score"), "doc_id").limit(20)


@query(f"""WITH {G}, {_V}, h AS (SELECT ref, score FROM s ORDER BY score DESC, ref LIMIT 5), m AS (SELECT CAST(regexp_extract(ref, '[0-9]+') AS BIGINT) % 150 AS k, score FROM h),
 sd AS (SELECT 'lat sql tables customer/' || CAST(k + 1 AS STRING) || ' customer#' AS id, max(score) AS score FROM m GROUP BY 1), k AS (SELECT sd.* FROM sd JOIN nodes n ON n.id = sd.id), a AS (FROM k UNION ALL SELECT e.src, k.score FROM k JOIN edges e ON e.dst = k.id AND e.kind = 'CONTAINS') SELECT id, round(max(score), 5) AS score FROM a GROUP BY id""")
def rt_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits joined to the nodes that they stand for, and those that contain them; every vector stands for a customer."""
    g = graph(spark, sf_dir)
    hits = vectors.search(_vectors(spark, sf_dir), _first_vector(spark, sf_dir), 5)
    key = F.regexp_extract("ref", "[0-9]+", 0).cast("long") % 150 + 1
    named = hits.select(F.concat(F.lit("lat sql tables customer/"), key.cast("string"), F.lit(" customer#")).alias("ref"), F.round("score", 6).alias("score"))
    return retrieve.seeds_of(g, named).select("id", F.round("score", 5).alias("score"))
