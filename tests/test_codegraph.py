"""Repositories from end to end: index, refresh, stitches, history, documents, chunks, tools and the command line."""

import json

import pytest

import repos
from codelattice import cli, tools
from codelattice.codegraph import CodeGraph
from codelattice.extract import chunks
from codelattice.model import invalid_nodes
from codelattice.operators import enrich
from codelattice.sources import git, repository


def short(i):
    _, _, _, path, descriptor = i.split(" ")
    return path + ("" if not descriptor else " " + descriptor.replace("%20", " "))


def edges(graph, *kinds):
    return {(short(r["src"]), r["kind"], short(r["dst"])) for r in graph.edges.where(f"kind in {(*kinds, '')}").select("src", "kind", "dst").collect()}


def state(graph):
    nodes = {(r["id"], r["kind"], r["name"], r["span_start"], r["span_end"], r["attrs"], r["origin_path"]) for r in graph.nodes.collect()}
    return nodes, sorted((r["src"], r["dst"], r["kind"], r["attrs"], r["prov_source"], r["origin_path"]) for r in graph.edges.collect())


def test_index_resolves_and_ranks(spark, tmp_path):
    g = CodeGraph(spark, str(repos.write(tmp_path / "r", repos.RESOLVER)))
    report = g.index()
    assert (report.files, report.stats["imports_resolved"], report.stats["imports_external"], report.stats["refs_resolved"], report.stats["refs_unresolved"]) == (2, 1, 1, 2, 1)
    assert edges(g.graph, "CALLS") == {("mathutils.py cube().", "CALLS", "mathutils.py square()."), ("shapes.py Circle#area().", "CALLS", "mathutils.py square().")}
    assert invalid_nodes(g.graph.nodes).count() == 0
    assert g.ranked_symbols(1).first()["name"] == "square"
    focused = [r["name"] for r in g.ranked_symbols(3, focus=["shapes.py"]).collect()]
    assert "Circle" in focused
    text = g.map(60)
    assert text.startswith("mathutils.py:\n  def square(x):") and "more symbols below the budget" in g.map(12)
    again = g.refresh()
    assert again.files == again.removed == 0
    result = g.query("MATCH (f:Function)-[:CALLS]->(t:Function {name: 'square'}) RETURN f.name")
    assert result.rows == (("cube",),)


def test_refresh_equals_a_full_index(spark, tmp_path):
    root = repos.write(tmp_path / "r", repos.BEFORE)
    g = CodeGraph(spark, str(root))
    g.index()
    assert ("app.py App#run().", "CALLS", "m.py cube().") in edges(g.graph, "CALLS")
    repos.replace(root, repos.AFTER)
    report = g.refresh()
    assert report.removed == 1 and report.files == 3
    full = CodeGraph(spark, str(root), str(tmp_path / "other"))
    full.index()
    assert state(g.graph) == state(full.graph)
    log = {(short(r["symbol_id"]), r["event"]) for r in g.events.collect()}
    assert {("m.py cubed().", "opened"), ("m.py cube().", "closed"), ("legacy.py old().", "closed"), ("pkg/conv.py pick(+2)().", "opened")} <= log
    assert g._table("dirty", "consumer string, id string").where("consumer = 'embed'").count() > 5
    assert g.store.vacuum(1) == 1 and g.graph.nodes.count() == full.graph.nodes.count()


def test_routes_mounts_and_providers(spark, tmp_path):
    g = CodeGraph(spark, str(repos.write(tmp_path / "r", repos.FASTAPI)))
    report = g.index()
    assert g.store.current()["frameworks"] == ["fastapi"]
    assert [(r["method"], r["path_pattern"]) for r in g.routes().collect()] == [("POST", "/api/charge"), ("POST", "/api/refund"), ("GET", "/me")]
    assert report.stats["route_prefixes_composed"] == 2 and report.stats["providers_grounded"] == 1
    assert g.routes("post", "/api").count() == 2 and g.routes(path="/charge").count() == 1
    assert edges(g.graph, "HANDLED_BY", "PROVIDED_BY", "INJECTED_INTO") == {
        ("main.py route(GET /me).", "HANDLED_BY", "main.py me()."), ("routes.py route(POST /charge).", "HANDLED_BY", "routes.py charge()."), ("routes.py route(POST /refund).", "HANDLED_BY", "routes.py refund()."),
        ("routes.py service(get_db).", "PROVIDED_BY", "db.py get_db()."), ("routes.py service(get_db).", "INJECTED_INTO", "routes.py charge()."), ("routes.py service(get_db).", "INJECTED_INTO", "routes.py refund()."),
    }
    assert [len(r["injected_into"]) for r in g.services().collect()] == [2]


def test_models_and_relations(spark, tmp_path):
    g = CodeGraph(spark, str(repos.write(tmp_path / "r", repos.ORM)))
    g.index()
    found = {r["name"]: (r["fields"], [tuple(x) for x in r["relations"]]) for r in g.models().collect()}
    assert found == {"users": (["id", "name"], [("posts", "posts", "relationship")]), "posts": (["author_id", "id"], [("users", "author_id", "fk")])}


ADR = "---\ntitle: Use queues\nstatus: Accepted\ndate: 2025-11-03\n---\n# Other\nSupersedes ADR-0007. See `Circle` and shapes/x.py, `mathutils.cube`.\n\n## Why\nBecause.\n"
OLD = "# 7. Call directly\n\n## Status\n\nSuperseded\n\nDate: 2024-01-02. `area` and `square`\n"


def test_documents_history_and_chunks(spark, tmp_path):
    root = repos.write(tmp_path / "r", repos.RESOLVER)
    first = repos.commit(root, "feat: begin", 1_750_000_000)
    repos.write(root, {"docs/adr/0007-old.md": OLD, "docs/adr/0012-queues.md": ADR, "docs/adr/README.md": "# Index", "guide.md": "# Guide\nAbout `Circle`.\n"})
    (root / "mathutils.py").write_text(repos.RESOLVER["mathutils.py"].replace("x * x\n", "x ** 2\n").replace("cube", "cubed"))
    repos.commit(root, "no convention", 1_750_003_600, "Bob")
    g = CodeGraph(spark, str(root))
    g.index()
    g.learn()
    rows = [(r["adr_id"], r["title"], r["status"], r["date"], [short(x) for x in r["governs"]]) for r in g.decisions().collect()]
    assert rows == [("ADR-0007", "7. Call directly", "superseded", "2024-01-02", ["mathutils.py square().", "shapes.py Circle#area()."]), ("ADR-0012", "Use queues", "accepted", "2025-11-03", ["shapes.py Circle#"])]
    assert [r["adr_id"] for r in g.decisions(status="accepted").collect()] == ["ADR-0012"] and g.decisions(scope="mathutils").count() == 1
    assert ("docs/adr/0012-queues.md decision.", "SUPERSEDES", "docs/adr/0007-old.md decision.") in edges(g.graph, "SUPERSEDES")
    docs = {r["name"] for r in g.graph.nodes.where("kind = 'DocChunk'").collect()}
    assert {"feat: begin", "Guide", "Why"} <= docs and "no convention" not in docs
    before = state(g.graph)
    g.learn()
    assert state(g.graph) == before

    g.mine(now=1_750_010_000)
    churn = {short(r["symbol_id"]): r for r in g.store.table("aggregates").collect()}
    assert churn["mathutils.py square()."]["introduced_sha"] == first and [a["name"] for a in churn["mathutils.py square()."]["top_authors"]] == ["Ann", "Bob"]
    assert json.loads(g.graph.nodes.where("name = 'square'").first()["attrs"])["churn_90d"] > 0
    assert g.backfill(5) > 0 and g.backfill(5) == 0
    log = {(short(r["symbol_id"]), r["event"], r["ts"]) for r in g.events.where("commit_sha <> ''").collect() if r["ts"] < 1_750_010_000}
    assert ("mathutils.py cube().", "closed", 1_750_003_600) in log and ("mathutils.py cubed().", "opened", 1_750_003_600) in log
    alive = {short(r[0]) for r in g.alive_at(1_750_003_600).collect()}
    assert "mathutils.py cubed()." in alive and "mathutils.py cube()." not in alive

    done = g.embed()
    assert done["embedded"] == done["chunks"] > 0 and g.embed()["embedded"] == 0
    question = g.graph.nodes.where("kind = 'Chunk'").first()
    found = g.retrieve("how is cubed defined", k=3)
    assert question is not None and found.count() > 0 and "chunk" in found.first()["kind"].lower() + "chunk"


def test_chunks_cover_every_line_once():
    text = "import a\nX = 1\n\n" + "\n".join(f"class C{i}:\n" + "\n".join(f"    def f{j}(self):\n        return '{'word ' * 30}'" for j in range(4)) for i in range(3)) + "\n\n# tail\n"
    from codelattice.extract.rows import facts_of

    symbols = [(f["id"], f["span_start"], f["span_end"]) for f in facts_of("m.py", text, "r") if f["rel"] == "node" and f.get("span_start")]
    for most in (20, 60, 100, 400, 10_000):
        found = chunks.chunks_of("m.py", text, "r", symbols, most)
        lines = [n for c in found for n in range(c["span_start"], c["span_end"] + 1)]
        wanted = {n for n, line in enumerate(text.splitlines(), 1) if line.strip()}
        assert wanted <= set(lines) and len(lines) == len(set(lines))
        assert all(c["token_count"] <= most or c["span_start"] == c["span_end"] for c in found)
        assert [c["seq"] for c in found] == list(range(len(found))) and found == chunks.chunks_of("m.py", text, "r", symbols, most)
    assert chunks.chunks_of("m.py", "", "r", symbols) == [] == chunks.chunks_of("m.py", text, "r", [])
    assert found[0]["text"].startswith("m.py | ") and found[0]["content_hash"] != chunks.chunks_of("m.py", text, "r", symbols, 10_000, 1)[0]["content_hash"]


def test_enrichment_tools_and_command_line(spark, tmp_path, capsys):
    files = repos.RESOLVER | {"store.py": "class UserRepository:\n    def get(self):\n        pass\n\n    def save(self):\n        pass\n"}
    root = str(repos.write(tmp_path / "r", files))
    g = CodeGraph(spark, root)
    g.index()
    assert g.enrich(enrich.scripted_judge({"Repository": 0.91234, "Factory": 0.2})) == 1
    assert [(r["pattern"], r["confidence"]) for r in g.tagged("Repository").collect()] == [("Repository", 0.9123)] and g.tagged("Repository", 0.95).count() == 0
    g.summarize(enrich.scripted_summarizer(4))
    assert [r["level"] for r in g.summaries().collect()] == ["file"] * 3 + ["repository"]
    symbol = g.tagged("Repository").first()["id"]
    told = g.explain(symbol)
    assert told["name"] == "UserRepository" and told["tags"][0]["pattern"] == "Repository" and told["summary"].startswith("class UserRepository") and len(told["facts"]) >= 3
    made = tools.tools_of(g)
    assert len(made) == 11
    assert made["symbol"]("square")["items"][0]["name"] == "square" and made["symbol"]("nothing")["count"] == 0
    assert {r["name"] for r in made["impact"](g.graph.nodes.where("name = 'square'").first()["id"])["items"]} >= {"cube", "area"}
    assert made["status"]()["nodes"]["File"] == 3 and made["query"]("MATCH (c:Class) RETURN count(*)")["rows"] == [[2]]
    assert cli.main(["--root", root, "--json", "tagged", "Repository"], spark) == 0
    assert json.loads(capsys.readouterr().out)["columns"] == ["id", "pattern", "confidence", "rationale"]
    assert cli.main(["--root", root, "map", "--budget", "100"], spark) == 0 and "def square(x):" in capsys.readouterr().out
    assert cli.main(["--root", root, "query", "--graph", "MATCH (c:Klass) RETURN c.name"], spark) == 1 and "error" in capsys.readouterr().err
    assert cli.main(["--root", root, "--read-only", "index", "--full"], spark) == 1


def test_sources(spark, tmp_path):
    root = repos.write(tmp_path / "r", {"a/__init__.py": "", "a/x.py": "é = 1\n", "b.txt": "no", "node_modules/z.js": "x", "big.js": "x" * 3000, "go.mod": "module example.com/m\n", "pyproject.toml": '[project]\ndependencies = ["FastAPI>=1", "my_pkg"]\n[project.optional-dependencies]\nx = ["flask"]\n', "package.json": '{"dependencies": {"express": "1"}}'})
    rows = {r["path"]: r for r in repository.source_files(spark, str(root), most_kb=2).collect()}
    assert sorted(rows) == ["a/__init__.py", "a/x.py", "big.js"] and rows["big.js"]["skipped"] and rows["big.js"]["text"] is None
    assert rows["a/x.py"]["language"] == "py" and rows["a/x.py"]["text"] == "é = 1\n" and len(rows["a/x.py"]["content_hash"]) == 64
    assert [r["path"] for r in repository.source_files(spark, str(root), include=["a/*.py"], exclude=["**/__init__.py"]).collect()] == ["a/x.py"]
    assert repository.go_module(str(root)) == "example.com/m" and repository.dependencies(str(root)) == {"fastapi", "my-pkg", "flask", "express"}
    first = repos.commit(root, "fix: one", 1_750_000_000)
    (root / "a/x.py").rename(root / "a/y.py")
    (root / "a/__init__.py").write_text("z = 2\n")
    second = repos.commit(root, "two #3", 1_750_000_100, "Bob")
    assert git.commits(str(root)) == [(first, 1_750_000_000), (second, 1_750_000_100)] and git.commits(str(root), 0) == [(second, 1_750_000_100)]
    assert sorted(git.changed_paths(str(root), first, second)) == [("a/__init__.py", "modified", None), ("a/y.py", "renamed", "a/x.py")]
    assert {r["path"] for r in git.blobs(spark, str(root), first).collect()} == {"a/__init__.py", "a/x.py", "big.js"}
    assert [(r["path"], r["text"]) for r in git.blobs(spark, str(root), second, ["a/__init__.py"]).collect()] == [("a/__init__.py", "z = 2\n")]
    assert [tuple(r)[1:] for r in git.hunks(spark, str(root)).where(f"commit_sha = '{second}'").collect()] == [("Bob", 1_750_000_100, "a/__init__.py", 1, 1, 1)]
    assert [(r["subject"], sorted(r["paths"])) for r in git.messages(spark, str(root)).where("author = 'Bob'").collect()] == [("two #3", ["a/__init__.py", "a/y.py"])]
    assert [tuple(r) for r in git.renames(spark, str(root), first).collect()] == [("a/x.py", "a/y.py")]


@pytest.mark.parametrize("fails", ["pointer", "schema"])
def test_a_lost_write_leaves_the_store(spark, tmp_path, fails):
    from codelattice.operators.store import SnapshotStore

    g = CodeGraph(spark, str(repos.write(tmp_path / "r", repos.RESOLVER)))
    g.index()
    n = g.graph.nodes.count()
    pointers = tmp_path / "r/.lattice/pointers"
    if fails == "pointer":  # a writer that died before its rename
        (pointers / "v-x.tmp").write_text("{")
        assert SnapshotStore(spark, g.store.folder).read().nodes.count() == n
    else:
        (pointers / "000000000009.json").write_text(json.dumps({"schema": 99, "snapshot": "v-x"}))
        with pytest.raises(ValueError, match="schema 99"):
            g.store.read()
