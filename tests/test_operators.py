"""Column functions, bounds and validation of queries, and the operators that no registered query reaches."""

import json

import pytest
from pyspark.sql import functions as F

from codelattice.cypher import engine, errors
from codelattice.cypher.schema import CAPABILITIES, describe
from codelattice.functions import text as T
from codelattice.model import EDGES, NODES, Graph
from codelattice.operators import enrich, federation, graphs, incremental, retrieve, store, temporal, vectors, verbs
from codelattice.sources import workspace

L = F.lit


def values(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def test_path_and_import_functions(spark):
    assert values(
        spark, T.module_of(L("a/b/__init__.py")), T.module_of(L("a/b.py")), T.module_of(L("a/b.ts"), "relative"), T.module_of(L("a/b.go"), "go"), T.resolved_relative(L("a/b/c.py"), L("..x.y")), T.resolved_relative(L("a/b.py"), L("os.path")),
        T.normalized_segments(L("a/./b/../../c//d")), T.normal_path(L("./x\\y")),
    ) == ("a.b", "a.b", "a/b", "a", "a.x.y", "os.path", "c/d", "x/y")


def test_route_functions(spark):
    assert values(
        spark, T.joined_path(L("/api/"), L("/x/")), T.joined_path(L(None).cast("string"), L("")), T.route_template(L("/a/{id}/:k/<int:x>/b/")), L("/a/7").rlike("^/a/[^/]+/?$"), F.expr("'/a/7' rlike '^x'"),
        T.expanded_tokens(L("api/[controller]/[action]"), L("UsersController"), L("List")), T.url_path(L("http://h/x?y#z")), T.url_path(L("http://h")), T.url_path(L("x")),
    ) == ("/api/x", "/", "/a/{}/{}/{}/b", True, False, "api/Users/List", "/x", "/", None)
    assert values(spark, T.route_regex(L("/a.b/{id}")), T.route_regex(L("/"))) == (r"^/a\.b/[^/]+/?$", "^/?$")


def test_text_functions(spark):
    assert values(
        spark, T.subtokens(L("HTMLParser getUserName_v2 the")), T.lexical_overlap(L("user parser zebra"), L("UserParser")), T.dependency_name(L(" My_Pkg[x]>=1 ")), T.camelized(L("admin/user_posts")), T.base_names(L("class X(A, pkg.B[T], metaclass=M):")),
        T.commit_qualifies(L("feat(api)!: x")), T.commit_qualifies(L("fixes #12")), T.commit_qualifies(L("see ABC-12")), T.commit_qualifies(L("hello: world")), T.hunk(L("@@ -1,2 +3,4 @@ x")), T.hunk(L("@@ -1 +3 @@")), T.hunk(L("+ x")),
    ) == (["html", "parser", "user", "name", "v2"], pytest.approx(2 / 3), "my-pkg", "Admin::UserPosts", ["A", "B"], True, True, True, False, (3, 4), (3, 1), None)
    assert values(spark, T.price(L("small"), L(500_000)), T.price(L("none"), L(1)), T.rendered_signature(L("Class"), L("A"), L("a.py"), L(3)), T.rendered_signature(L("File"), L("a.py"), L("a.py"), L(None).cast("int"))) == (0.01, None, "class A (a.py:3)", "file a.py (a.py)")
    (one,), (two,) = values(spark, T.fake_embedding(L("x"), 8)), values(spark, T.fake_embedding(L("x"), 8))
    assert one == two and sum(v * v for v in one) == pytest.approx(1) and one != values(spark, T.fake_embedding(L("y"), 8))[0]
    assert values(spark, *(graphs.private_factor(L(n), L(p)) for n, p in (("f", "a/b.py"), ("_f", "a/b.py"), ("__init__", "a/b.py"), ("f", "a/_b.py"), ("f", "a/__init__.py")))) == (1.0, 0.5, 1.0, 0.5, 1.0)


# Queries --------------------------------------------------------------------


def node(i, kind, name, start=1, end=5, attrs="{}", source="parsed", path="src/app.py"):
    return (f"lat py r {path} {i}", kind, name, start, end, attrs, path, source, "t", "c", 1.0, path)


def edge(a, b, kind, source="parsed", path="src/app.py"):
    return (f"lat py r {path} {a}", f"lat py r {path} {b}", kind, "{}", source, "t", "c", 1.0, path, "")


@pytest.fixture(scope="module")
def graph(spark):
    names = {"Repo": "Class", "Cache": "Class", "Plain": "Class", "Store": "Interface", "Empty": "Interface", "foo": "Function", "bar": "Function", "baz": "Function", "qux": "Function", "Repository": "PatternTag"}
    nodes = [node("", "File", "app.py"), *(node(f"{n}.", k, n) for n, k in names.items())]
    links = [("", "Repo.", "CONTAINS"), ("", "Cache.", "CONTAINS"), ("", "Plain.", "CONTAINS"), ("Repo.", "Store.", "IMPLEMENTS"), ("Cache.", "Store.", "IMPLEMENTS"), ("foo.", "bar.", "CALLS"), ("bar.", "baz.", "CALLS"), ("Repo.", "Repository.", "TAGGED")]
    g = Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame([edge(*x) for x in links], EDGES))
    return Graph(g.nodes.cache(), g.edges.cache())


@pytest.mark.parametrize(("query", "columns", "rows"), [
    ("MATCH (f:Function) RETURN f.name", ("f.name",), {("foo",), ("bar",), ("baz",), ("qux",)}),
    ('MATCH (c:Class {name: "Repo"}) RETURN c.path, c.start_line', ("c.path", "c.start_line"), {("src/app.py", 1)}),
    ("MATCH (c:Class)-[:IMPLEMENTS]->(i:Interface) RETURN i.name, count(c) AS impls ORDER BY impls DESC", ("i.name", "impls"), {("Store", 2)}),
    ("MATCH (f:Function) WHERE NOT (f)<-[:CALLS]-() RETURN f.name", ("f.name",), {("foo",), ("qux",)}),
    ('MATCH (a:Function {name: "foo"})-[:CALLS*1..2]->(b:Function) RETURN b.name', ("b.name",), {("bar",), ("baz",)}),
    ("MATCH (f:Function) WHERE (x:Class)-[:TAGGED]->() OR f.name = 'foo' RETURN f.name", ("f.name",), {("foo",), ("bar",), ("baz",), ("qux",)}),
])
def test_query_results(graph, query, columns, rows):
    got = engine.run(graph, query, engine.Bounds(timeout_ms=120_000))
    assert got.columns == columns and set(got.rows) == rows and not got.truncated


def test_query_bounds(graph):
    query = "MATCH (f:Function) RETURN f.name"
    wide = lambda **how: engine.run(graph, query, engine.Bounds(**({"timeout_ms": 120_000} | how)))
    assert (wide(max_rows=2).truncated, wide(max_rows=2).stopped_reason, len(wide(max_rows=2).rows)) == (True, "row_cap", 2)
    capped = wide(max_rows=100, max_expansions=1)
    assert capped.rows == (("bar",),) and capped.stopped_reason == "expansion_cap"
    late = engine.run(graph, query, engine.Bounds(timeout_ms=0))
    assert late.rows == () and late.stopped_reason == "timeout" and late.columns == ("f.name",)
    with pytest.raises(errors.DisabledError):
        engine.run(graph, query, engine.Bounds(enabled=False))
    assert "row_cap" in engine.as_table(wide(max_rows=2)) and json.loads(engine.as_json(wide(max_rows=2)))["truncated"]


@pytest.mark.parametrize("query", ["CREATE (n:Class) RETURN n", "MATCH (n:Class) DETACH DELETE n", "MATCH (n:Class) SET n.name = 'x' RETURN n", "MATCH (n:Class RETURN n", "MATCH (n) RETURN 'x", "", "MATCH (n:Class) RETURN n.name LIMIT"])
def test_queries_that_do_not_parse(graph, query):
    with pytest.raises(errors.ParseError):
        engine.plan(graph, query)


@pytest.mark.parametrize("query", [
    "MATCH (n:Klass) RETURN n.name", "MATCH (n:Class)-[:KNOWS]->(m) RETURN m.name", "MATCH (n:Class) RETURN m.name", "MATCH (n:Class) RETURN n.color", "MATCH (n:Class)-[:CALLS*]->(m) RETURN m.name",
    "MATCH (n:Class)-[:CALLS*3..1]->(m) RETURN m.name", "MATCH (a:Class), (b:Class) RETURN a.name", "MATCH (n:Class)-[r:CALLS]->(m) RETURN r", "MATCH (n:Class) RETURN count(n) AS c ORDER BY n.name",
])
def test_queries_that_are_not_valid(graph, query):
    with pytest.raises((errors.ValidationError, errors.ParseError)):
        engine.plan(graph, query)


def test_capabilities_and_schema(graph):
    with pytest.raises(errors.CapabilityError):
        engine.plan(graph, "MATCH (a:Function)-[:CALLS*1..2]->(b:Function) RETURN b.name", CAPABILITIES - {"path.varlen"})
    assert "Class" in json.dumps(describe()) and "TAGGED" in json.dumps(describe())


# Operators ------------------------------------------------------------------


def test_vectors(spark):
    rows = [("a", [1.0, 0.0], "Chunk", "p"), ("b", [1.0, 0.0], "Chunk", "q"), ("c", [0.0, 1.0], "Summary", "p"), ("d", [0.0, 0.0], "Chunk", "p"), ("e", None, "Chunk", "p"), ("f", [1.0], "Chunk", "p"), ("g", [-1.0, 0.0], "Chunk", "p")]
    table = spark.createDataFrame([(*r, "{}") for r in rows], "ref string, vector array<float>, kind string, path string, attrs string")
    hits = [(r["ref"], r["score"]) for r in vectors.search(table, [2.0, 0.0], 3).collect()]
    assert hits == [("a", 1.0), ("b", 1.0), ("c", 0.0)]
    assert [r["ref"] for r in vectors.search(table, [1.0, 0.0], 1, {"path": "q"}).collect()] == ["b"]
    assert vectors.search(table, [0.0, 0.0], 3).count() == 0 == vectors.search(table, [1.0, 0.0], 0).count()
    with pytest.raises(ValueError, match="can't filter"):
        vectors.search(table, [1.0, 0.0], 1, {"attrs": "{}"})


def test_spans_meet_in_bins_once(spark):
    hunks = [("p", s, n) for s in (1, 60, 64, 65, 100, 1000) for n in (0, 1, 5, 70, 900)]
    spans = [(f"s{i}", "p", a, z) for i, (a, z) in enumerate([(1, 1), (1, 2000), (63, 66), (64, 64), (128, 300), (999, 1001)])]
    got = temporal.overlapping(spark.createDataFrame(hunks, "path string, start int, length int"), spark.createDataFrame(spans, "symbol_id string, path string, span_start int, span_end int"))
    wanted = sorted((s, n, i) for _, s, n in hunks for i, _, a, z in spans if s <= z and a <= s + max(n, 1) - 1)
    assert sorted((r["start"], r["length"], r["symbol_id"]) for r in got.collect()) == wanted


def test_changes_with_renames_and_dirty(spark):
    table = lambda rows: spark.createDataFrame(rows, "path string, content_hash string")
    found = incremental.changes(table([("a", "1"), ("n", "2"), ("c", "9")]), table([("a", "1"), ("o", "2"), ("c", "3"), ("x", "1")]), spark.createDataFrame([("o", "n"), ("zz", "a")], "old_path string, path string"))
    assert sorted(tuple(r) for r in found.select("path", "status", "old_path").collect()) == [("c", "modified", None), ("n", "renamed", "o"), ("x", "removed", None)]
    assert sorted(r[0] for r in incremental.touched(found).collect()) == ["c", "n"] and sorted(r[0] for r in incremental.removed(found).collect()) == ["o", "x"]
    edges = spark.createDataFrame([("a", "b"), ("c", "a"), ("d", "e")], "src string, dst string")
    assert sorted(r[0] for r in incremental.dirty_after(spark.createDataFrame([("a",)], "id string"), edges).collect()) == ["a", "b", "c"]
    assert incremental.packs_changed({"py": "1"}, {"py": "2"}) and not incremental.packs_changed({"py": "1"}, {"py": "1"})


def test_events_and_horizon(spark):
    log = spark.createDataFrame([("s", "symbol", "opened", "c1", 10, None), ("t", "symbol", "opened", "c1", 10, None), ("t", "symbol", "closed", "c2", 20, None)], "symbol_id string, entity string, event string, commit_sha string, ts long, ref string")
    with pytest.raises(temporal.HorizonError):
        temporal.alive_at(log, 5, horizon=8)
    assert [r[0] for r in temporal.alive_at(log, 25).collect()] == ["s"]
    mined = spark.createDataFrame([("s", 30, "c3"), ("t", 30, "c3")], "symbol_id string, ts long, commit_sha string")
    assert [(r["symbol_id"], r["event"]) for r in temporal.changed_since(log, 15, mined).collect()] == [("s", "modified"), ("t", "closed")]
    assert temporal.seeded(log, spark.createDataFrame([("s",), ("u",)], "id string"), "c4", 40).where("symbol_id = 'u'").count() == 1


def test_nomination_and_judgement(spark):
    rows = [("1", "Class", "UserRepository", "class UserRepository:", ["get"]), ("2", "Class", "Thing", "class Thing(BaseStore):", ["get", "save"]), ("3", "Function", "make_user", "def make_user():", []), ("4", "Class", "Plain", "class Plain:", ["run"]), ("5", "Class", "UserDTO", "class UserDTO:", ["__init__"]), ("6", "Class", "Bus", "class Bus:", ["subscribe", "notify"]), ("7", "Class", "S", "class S:", ["instance"])]
    symbols = spark.createDataFrame(rows, "id string, kind string, name string, signature string, methods array<string>")
    found = {r["id"]: r["patterns"] for r in enrich.nominate(symbols).collect()}
    assert found == {"1": ["Repository"], "2": ["Repository"], "3": ["Factory"], "5": ["DTO"], "6": ["Observer"], "7": ["Singleton"]}
    tags = enrich.judged(enrich.nominate(symbols), enrich.scripted_judge({"Repository": 0.91239, "Factory": 0.5}, 0.8, 1.0), budget=1.0, batch=2)
    assert sorted((r["id"], r["confidence"]) for r in tags.collect()) == [("1", 0.9124), ("2", 0.9124)]
    assert [r["batch"] for r in enrich.candidate_batches(symbols.select("id"), 3).orderBy("id").collect()] == [0, 0, 0, 1, 1, 1, 2]
    governs = enrich.inferred_governs(spark.createDataFrame([("d",)], "id string"), symbols, enrich.scripted_matcher({("d", "1"): 0.9, ("d", "2"): 0.1}))
    assert [(r["id"], r["target"]) for r in governs.collect()] == [("d", "1")]


def test_federated_routes(spark):
    own = spark.createDataFrame([("a", "get", "/x/{id}"), ("a", "POST", "/y")], "service string, method string, path string")
    specs = spark.createDataFrame([("a", "GET", "/x/:k"), ("a", "PUT", "/z")], "service string, method string, path string")
    assert sorted(tuple(r) for r in federation.merged_routes(own, specs).collect()) == [("a", "GET", "/x/{id}"), ("a", "POST", "/y"), ("a", "PUT", "/z")]
    spec = json.dumps({"paths": {"/p": {"get": {"operationId": "one"}, "parameters": []}, "/q": {"post": {}}}})
    assert sorted(tuple(r) for r in federation.openapi_routes(spark.createDataFrame([("a", spec)], "service string, spec string")).collect()) == [("a", "GET", "/p", "one"), ("a", "POST", "/q", "")]
    calls = spark.createDataFrame([("b", "GET", "http://a/x/1"), ("b", "GET", "/nope")], "service string, method string, url string")
    assert [tuple(r) for r in federation.unresolved(calls, own).collect()] == [("b", "GET", "/nope")]
    assert federation.fan_out({"m": own.drop("service"), "n": own.drop("service")}).count() == 4


def test_retrieval_and_packing(spark, graph):
    found = retrieve.retrieve(graph, None, (), mode="impact", depth=2, symbols=spark.createDataFrame([("lat py r src/app.py baz.",)], "id string"))
    assert [(r["name"], r["depth"]) for r in found.collect()] == [("baz", 0), ("bar", 1), ("foo", 2)]
    alive = spark.createDataFrame([("lat py r src/app.py foo.",)], "symbol_id string")
    assert {r["name"] for r in retrieve.allowed(graph.nodes, alive).collect()} == {"foo", "app.py", "Repository"}
    items = [{"text": "long " * 50, "signature": "short"}, {"text": "tiny", "signature": "t"}, {"text": "x " * 90, "signature": "y " * 90}]
    assert retrieve.packed(items, 10) == (["short", "tiny"], 1)
    ranked = [{"path": "b.py", "name": "f", "signature": "def f():"}, {"path": "a.py", "name": "g", "signature": ""}, {"path": "b.py", "name": "h", "signature": "def h():"}]
    assert verbs.rendered_map(ranked, 1000, {"b.py": "about b"}) == "b.py:\n  # about b\n  def f():\n  def h():\na.py:\n  g(...)"
    mean, low, high = verbs.bootstrap([0.1, 0.2, 0.3] * 10)
    assert low <= mean <= high and verbs.bootstrap([]) == (0.0, 0.0, 0.0)


def test_attrs_merge_keeps_types(spark, graph):
    patch = spark.createDataFrame([("lat py r src/app.py foo.", '{"n": 1, "x": {"y": [1, "2"]}, "z": null}'), ("nobody", '{"a": 1}')], "id string, patch string")
    got = store.set_attrs(store.set_attrs(graph, patch), spark.createDataFrame([("lat py r src/app.py foo.", '{"n": "two"}')], "id string, patch string"))
    assert json.loads(got.nodes.where("name = 'foo'").first()["attrs"]) == {"n": "two", "x": {"y": [1, "2"]}, "z": None}


def test_workspace_settings(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/lattice.yaml").write_text("retrieve: {k: 3}\nwatch: {policy: on-idle}\n")
    (tmp_path / "ws.yaml").write_text("defaults: {retrieve: {k: 2, depth: 4}}\nmembers:\n  - a\n  - {name: b, path: a, settings: {retrieve: {depth: 9}}}\n")
    a, b = workspace.members(str(tmp_path / "ws.yaml"))
    assert (a.name, a.settings["retrieve"]["k"], a.settings["retrieve"]["depth"], a.settings["watch"]["policy"], a.settings["chunking"]["max_tokens"]) == ("a", 3, 4, "on-idle", 512)
    assert b.settings["retrieve"] == {"k": 3, "depth": 9, "rerank": "off"} and workspace.problems(a.settings) == []
    assert len(workspace.problems({"nope": {}, "watch": {"policy": "x"}, "retrieve": {"rerank": "x", "y": 1}, "index": {"frameworks": ["zope"]}, "query": {"max_rows": 0}})) == 6
    assert workspace.repository_key(str(tmp_path / "a")).startswith("a-") and not workspace.is_read_only(str(tmp_path))
    assert workspace.store_root("/x", "/c").startswith("/c/") and workspace.store_root("/x") == "/x/.lattice"
