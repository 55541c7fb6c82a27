"""Queries of extraction, resolution, frameworks, chunks and typed verbs.

The tables hold no code, so every row of ``customer`` becomes a pair of source files by a template of its language, in which
``§`` stands for the customer's key.  What a template must give is written down beside it, and the SQL makes it from the same
rows: it never looks at the text.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.extract import chunks as chunking
from codelattice.extract import stitches
from codelattice.extract.packs import BY_SLUG
from codelattice.extract.resolve import Resolver
from codelattice.extract.rows import extracted, graph_of
from codelattice.lineage import cut
from codelattice.model import EDGES, NODES, Graph
from codelattice.operators import verbs
from codelattice.plans.registry import query
from codelattice.plans.tables import read

#: Language: its two files (path, text), their symbols (file, kind, descriptor, first line, last line), and its resolved edges (kind, from file, from descriptor, to file, to descriptor).
TEMPLATES = {
    "py": (
        [("py§/a.py", "import os\nfrom .b import Base\n\n\nclass A§(Base):\n    def run(self):\n        self.step()\n        return helper(§)\n\n    def step(self):\n        return self.up()\n\n\ndef helper(x):\n    return os.getpid()\n"), ("py§/b.py", "class Base:\n    def up(self):\n        return 1\n")],
        [(0, "Class", "A§#", 5, 11), (0, "Method", "A§#run().", 6, 8), (0, "Method", "A§#step().", 10, 11), (0, "Function", "helper().", 14, 15), (1, "Class", "Base#", 1, 3), (1, "Method", "Base#up().", 2, 3)],
        [("IMPORTS", 0, "", 1, ""), ("INHERITS", 0, "A§#", 1, "Base#"), ("CALLS", 0, "A§#run().", 0, "A§#step()."), ("CALLS", 0, "A§#run().", 0, "helper()."), ("CALLS", 0, "A§#step().", 1, "Base#up().")],
    ),
    "ts": (
        [("ts§/a.ts", "import { Base, make } from './b';\nclass A§ extends Base {\n  run(): number {\n    return make(this.step());\n  }\n  step(): number { return 1; }\n}\n"), ("ts§/b.ts", "export class Base {}\nexport function make(n: number) {\n  return n;\n}\n")],
        [(0, "Class", "A§#", 2, 7), (0, "Method", "A§#run().", 3, 5), (0, "Method", "A§#step().", 6, 6), (1, "Class", "Base#", 1, 1), (1, "Function", "make().", 2, 4)],
        [("IMPORTS", 0, "", 1, ""), ("INHERITS", 0, "A§#", 1, "Base#"), ("CALLS", 0, "A§#run().", 1, "make()."), ("CALLS", 0, "A§#run().", 0, "A§#step().")],
    ),
    "js": (
        [("js§/a.js", "const lib = require('./b');\nfunction go§() {\n  lib.make();\n  return lib();\n}\n"), ("js§/b.js", "function make() {}\nfunction main() {}\nmodule.exports = main;\n")],
        [(0, "Function", "go§().", 2, 5), (1, "Function", "make().", 1, 1), (1, "Function", "main().", 2, 2)],
        [("IMPORTS", 0, "", 1, ""), ("CALLS", 0, "go§().", 1, "make()."), ("CALLS", 0, "go§().", 1, "main().")],
    ),
    "go": (
        [("go§/a.go", 'package a\n\nimport "example.com/m/go§/b"\n\ntype S§ struct{}\n\nfunc (s *S§) Run() {\n\ts.Step()\n\tb.Make()\n}\n\nfunc (s *S§) Step() {}\n'), ("go§/b/b.go", "package b\n\nfunc Make() {}\n")],
        [(0, "Class", "S§#", 5, 5), (0, "Method", "Run().", 7, 10), (0, "Method", "Step().", 12, 12), (1, "Function", "Make().", 3, 3)],
        [("IMPORTS", 0, "", 1, ""), ("CALLS", 0, "Run().", 0, "Step().")],
    ),
    "rb": (
        [("rb§/a.rb", "require_relative 'b'\nclass A§ < Base\n  def run\n    self.step\n    make(1)\n  end\n\n  def step\n  end\nend\n"), ("rb§/b.rb", "class Base\nend\n\ndef make(n)\nend\n")],
        [(0, "Class", "A§#", 2, 10), (0, "Method", "A§#run().", 3, 6), (0, "Method", "A§#step().", 8, 9), (1, "Class", "Base#", 1, 2), (1, "Function", "make().", 4, 5)],
        [("IMPORTS", 0, "", 1, ""), ("INHERITS", 0, "A§#", 1, "Base#"), ("CALLS", 0, "A§#run().", 0, "A§#step()."), ("CALLS", 0, "A§#run().", 1, "make().")],
    ),
    "php": (
        [("php§/a.php", "<?php\nnamespace P§;\nuse Q§\\Base;\nclass A§ extends Base {\n  function run() {\n    return $this->up();\n  }\n}\n"), ("php§/b.php", "<?php\nnamespace Q§;\nclass Base {\n  function up() {}\n}\n")],
        [(0, "Class", "A§#", 4, 8), (0, "Method", "A§#run().", 5, 7), (1, "Class", "Base#", 3, 5), (1, "Method", "Base#up().", 4, 4)],
        [("IMPORTS", 0, "", 1, ""), ("INHERITS", 0, "A§#", 1, "Base#"), ("CALLS", 0, "A§#run().", 1, "Base#up().")],
    ),
    "java": (
        [("java§/A§.java", "package p§.x;\nimport q§.y.Base;\npublic class A§ extends Base {\n  public int run() {\n    return this.up();\n  }\n}\n"), ("java§/Base.java", "package q§.y;\npublic class Base {\n  int up() { return 1; }\n}\n")],
        [(0, "Class", "A§#", 3, 7), (0, "Method", "A§#run().", 4, 6), (1, "Class", "Base#", 2, 4), (1, "Method", "Base#up().", 3, 3)],
        [("IMPORTS", 0, "", 1, ""), ("INHERITS", 0, "A§#", 1, "Base#"), ("CALLS", 0, "A§#run().", 1, "Base#up().")],
    ),
    "cs": (
        [("cs§/A.cs", "using Q§.Y;\nnamespace P§ {\n  class A§ : Base {\n    int Run() {\n      return this.Up();\n    }\n  }\n}\n"), ("cs§/B.cs", "namespace Q§.Y;\nclass Base {\n  int Up() { return 1; }\n}\n")],
        [(0, "Class", "A§#", 3, 7), (0, "Method", "A§#Run().", 4, 6), (1, "Class", "Base#", 2, 4), (1, "Method", "Base#Up().", 3, 3)],
        [("IMPORTS", 0, "", 1, ""), ("INHERITS", 0, "A§#", 1, "Base#"), ("CALLS", 0, "A§#Run().", 1, "Base#Up().")],
    ),
    "cpp": (
        [("cpp§/a.cpp", '#include "b.h"\nclass A§ {\n  int run() { return this->step(); }\n  int step() { return 1; }\n};\nint helper§() { return 2; }\nint main() {\n  return helper§();\n}\n'), ("cpp§/b.h", "int make(int n);\n")],
        [(0, "Class", "A§#", 2, 5), (0, "Method", "A§#run().", 3, 3), (0, "Method", "A§#step().", 4, 4), (0, "Function", "helper§().", 6, 6), (0, "Function", "main().", 7, 9), (1, "Function", "make().", 1, 1)],
        [("IMPORTS", 0, "", 1, ""), ("CALLS", 0, "A§#run().", 0, "A§#step()."), ("CALLS", 0, "main().", 0, "helper§().")],
    ),
    "rs": (
        [("src/rs§/mod.rs", "use crate::rt§::make;\nstruct A§;\nimpl A§ {\n    fn run(&self) { self.step(); make(); }\n    fn step(&self) {}\n}\n"), ("src/rt§.rs", "pub fn make() {}\n")],
        [(0, "Class", "A§#", 3, 6), (0, "Method", "A§#run().", 4, 4), (0, "Method", "A§#step().", 5, 5), (1, "Function", "make().", 1, 1)],
        [("IMPORTS", 0, "", 1, ""), ("CALLS", 0, "A§#run().", 0, "A§#step()."), ("CALLS", 0, "A§#run().", 1, "make().")],
    ),
}
REPO = "gen"
#: Files that one task makes and reads: some seconds of work.
FILES_A_PART = 10_000


def _files(spark: SparkSession, sf_dir: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """Each pair (path, text) for each customer, in as many parts as there are files: the table itself may be one part.

    The pairs are a relation to join, so the optimizer takes the files for as large as they are and broadcasts none of what follows from many.
    """
    k = F.col("c_custkey").cast("string")
    keys = read(spark, sf_dir, "customer").select("c_custkey")
    parts = -(-keys.count() * len(pairs) // FILES_A_PART)
    templates = spark.createDataFrame(pa.table({"p": [p for p, _ in pairs], "t": [t for _, t in pairs]}))
    made = keys.repartition(max(1, parts)).crossJoin(F.broadcast(templates))
    return made.select(F.replace("p", F.lit("§"), k).alias("path"), F.replace("t", F.lit("§"), k).alias("text"))


def _text(value: str) -> str:
    """An SQL expression for a text with the customer's key in place of ``§``."""
    return "replace('" + value.replace("'", "''") + "', '§', CAST(c_custkey AS VARCHAR))"


def _rows(rows: list[tuple], names: tuple[str, ...], numbers: tuple[str, ...] = ()) -> str:
    """SQL for these rows, for each customer."""
    quoted = lambda n, v: "CAST(NULL AS VARCHAR)" if v is None else f"CAST({v} AS BIGINT)" if n in numbers else _text(str(v))
    return " UNION ALL ".join(f"SELECT {', '.join(f'{quoted(n, v)} AS {n}' for n, v in zip(names, r, strict=True))} FROM customer" for r in rows)


def _descriptor(node) -> F.Column:
    return F.replace(F.get(F.split(node, " "), 4), F.lit("%20"), F.lit(" "))


def _path(node) -> F.Column:
    return F.get(F.split(node, " "), 3)


def _name(descriptor: str) -> str:
    return descriptor.rstrip(".#").removesuffix("()").split("#")[-1].split("(+")[0]


def _language(slug: str) -> None:
    files, symbols, _ = TEMPLATES[slug]
    rows = [(files[f][0], kind, _name(d), d, a, z) for f, kind, d, a, z in symbols]

    @query(_rows(rows, ("path", "kind", "name", "descriptor", "span_start", "span_end"), ("span_start", "span_end")), name=f"lp_{BY_SLUG[slug].language}")
    def extracted_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
        nodes = graph_of(extracted(_files(spark, sf_dir, files), REPO)).nodes.where("kind <> 'File'")
        return nodes.select(F.col("sym_path").alias("path"), "kind", "name", _descriptor(F.col("id")).alias("descriptor"), "span_start", "span_end")


for _slug in TEMPLATES:
    _language(_slug)


def _everything(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of all templates; not kept, so every use reads the files again."""
    return extracted(_files(spark, sf_dir, [f for files, _, _ in TEMPLATES.values() for f in files]), REPO)


def _beside(facts: DataFrame, node: dict[str, str], edge: dict[str, str]) -> DataFrame:
    """The nodes among the facts, each with the edges that leave it or with nulls: columns of ``node`` and ``edge`` as in a left join on the id.

    It shuffles the facts once, so that files are read once; a join of two parts of them would read all files for each.
    """
    of = lambda rel, columns: F.collect_list(F.when(F.col("rel") == rel, F.struct(*(F.col(c).alias(n) for n, c in columns.items()))))
    both = facts.groupBy("id").agg(of("node", node).alias("n"), of("edge", edge).alias("e"))
    return both.select("id", F.inline("n"), "e").select("id", *node, F.inline_outer("e"))


_EXTERNAL = [("IMPORTS", "py§/a.py", "", "<external>", "os/")]


@query(_rows([("Class" if "#" in parent else "File", files[f][0], parent, d) for files, symbols, _ in TEMPLATES.values() for f, _, d, *_ in symbols for parent in [d[: d.index("#") + 1] if "#" in d[:-1] else ""]], ("owner_kind", "path", "owner", "descriptor")))
def ex_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which symbol or file holds each symbol, in all ten languages."""
    facts = _everything(spark, sf_dir).where("rel = 'node' or rel = 'edge' and kind = 'CONTAINS'")
    held = _beside(facts, {"owner_kind": "kind"}, {"path": "path", "dst": "dst"})
    return held.where("dst is not null").select("owner_kind", "path", _descriptor(F.col("id")).alias("owner"), _descriptor(F.col("dst")).alias("descriptor"))


@query(" UNION ALL ".join([_rows([(k, files[a][0], d, files[b][0], e) for files, _, edges in TEMPLATES.values() for k, a, d, b, e in edges], ("kind", "src_path", "src", "dst_path", "dst")), _rows(_EXTERNAL, ("kind", "src_path", "src", "dst_path", "dst"))]))
def rs_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports, inheritance and calls across files, in all ten languages at once."""
    edges = Resolver(cut(_everything(spark, sf_dir), packed=True), "example.com/m").resolved().graph.edges
    side = lambda c: (F.replace(_path(F.col(c)), F.lit("%20"), F.lit(" ")), _descriptor(F.col(c)))
    (sp, s), (dp, d) = side("src"), side("dst")
    return edges.select("kind", sp.alias("src_path"), s.alias("src"), dp.alias("dst_path"), d.alias("dst"))


_CALLS_WANTED = {k: sum(e[0] == k for _, _, edges in TEMPLATES.values() for e in edges) for k in ("CALLS", "IMPORTS", "INHERITS")}


@query(f"SELECT 'imports_resolved' AS what, {_CALLS_WANTED['IMPORTS']} * count(*) AS n FROM customer UNION ALL SELECT 'imports_external', count(*) FROM customer UNION ALL SELECT 'inherits_resolved', {_CALLS_WANTED['INHERITS']} * count(*) FROM customer UNION ALL SELECT 'refs_resolved', {_CALLS_WANTED['CALLS']} * count(*) FROM customer UNION ALL SELECT 'refs_unresolved', 4 * count(*) FROM customer")
def rs_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the resolution; unresolved are os.getpid, both require calls of script and Ruby, and a call into a Go package by its name."""
    return Resolver(cut(_everything(spark, sf_dir), packed=True), "example.com/m").resolved().stats


# Frameworks -----------------------------------------------------------------

#: Pack: its file (path, text) and the nodes that it must give (kind, name, handler descriptor or null).
FRAMEWORKS = {
    "fastapi": ("f§.py", "@app.get('/c/§')\ndef read(db=Depends(get_db)):\n    pass\n\n\napp.include_router(orders.router, prefix='/api')\n", [("Route", "GET /c/§", "read()."), ("Service", "get_db", None), ("RouteMount", "orders.router", None)]),
    "flask": ("f§.py", "@app.route('/c/§', methods=['GET', 'POST'])\ndef read():\n    pass\n", [("Route", "GET /c/§", "read()."), ("Route", "POST /c/§", "read().")]),
    "sqlalchemy": ("m§.py", "class C§(Base):\n    __tablename__ = 't§'\n    id = Column(Integer)\n    owner = Column(Integer, ForeignKey('t0.id'))\n", [("DataModel", "t§", None), ("Variable", "id", None), ("Variable", "owner", None)]),
    "django": ("m§.py", "class C§(models.Model):\n    name = models.CharField()\n    up = models.ForeignKey('self')\n", [("DataModel", "C§", None), ("Variable", "name", None), ("Variable", "up", None)]),
    "httpclient": ("h§.py", "import requests\nrequests.post('http://s§/v1/x?y=1')\n", [("ServiceCall", "POST http://s§/v1/x?y=1", None)]),
    "express": ("e§.js", "function read§(q, r) {}\napp.get('/c/§', read§);\n", [("Route", "GET /c/§", "read§().")]),
    "nestjs": ("n§.ts", "@Controller('c§')\nexport class N§ {\n  @Get('x')\n  read() { return 1; }\n}\n", [("Route", "GET /c§/x", "N§#read().")]),
    "jshttpclient": ("j§.js", "fetch('/c/§', { method: 'PUT' });\n", [("ServiceCall", "PUT /c/§", None)]),
    "spring": ("S§.java", '@RestController\n@RequestMapping("/c§")\nclass S§ {\n  @GetMapping("/x") int read() { return 1; }\n}\n', [("Route", "GET /c§/x", "S§#read().")]),
    "aspnet": ("A§.cs", '[Route("api/[controller]")]\nclass C§Controller : ControllerBase {\n  [HttpGet("{id}")] public int Read(int id) { return 1; }\n}\n', [("Route", "GET /api/C§/{id}", "C§Controller#Read().")]),
    "gin": ("g§.go", 'package g\nfunc read() {}\nfunc main() { r.GET("/c/§", read) }\n', [("Route", "GET /c/§", "read().")]),
    "laravel": ("l§.php", "<?php\nRoute::get('/c/§', [C§Controller::class, 'show']);\n", [("Route", "GET /c/§", None)]),
    "rails": ("r§.rb", "Rails.application.routes.draw do\n  get '/c/§', to: 'c§#show'\nend\n", [("Route", "GET /c/§", None)]),
}


def _framework(pack: str) -> None:
    path, text, wanted = FRAMEWORKS[pack]

    @query(_rows([(path, kind, name, handler) for kind, name, handler in wanted], ("path", "kind", "name", "handler")), name=f"fw_{pack}")
    def framework_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
        facts = extracted(_files(spark, sf_dir, [(path, text)]), REPO, [pack])
        both = facts.where(f"rel = 'node' and extractor like 'pack:{pack}@%' or rel = 'edge' and kind = 'HANDLED_BY'")
        return _beside(both, {"path": "path", "kind": "kind", "name": "name"}, {"dst": "dst"}).select("path", "kind", "name", _descriptor(F.col("dst")).alias("handler"))


for _pack in FRAMEWORKS:
    _framework(_pack)

_MOUNTED = [("w§/main.py", "from fastapi import FastAPI\nimport w§.routes\napp.include_router(routes.router, prefix='/v§')\n"), ("w§/routes.py", "@router.get('/x')\ndef read(a=Depends(get§)):\n    pass\n"), ("w§/db.py", "def get§():\n    pass\n")]
_SHOP = [("web/r§.rb", "Rails.application.routes.draw do\n  get '/c', to: 'c§#show'\n  get '/d', to: 'c§#gone'\nend\n"), ("app/c§.rb", "class C§Controller\n  def show\n  end\nend\n")]
_MODELS = [("m/m§.py", "class C§(Base):\n    __tablename__ = 't§'\n    id = Column(Integer)\n    up = Column(Integer, ForeignKey('t§.id'))\n    far = Column(Integer, ForeignKey('nowhere.id'))\n    self_ = relationship('C§')\n")]


def _stitching(spark: SparkSession, sf_dir: str, pairs: list[tuple[str, str]], packs: list[str], imports: list[tuple[str, str]] = ()) -> tuple[Graph, DataFrame]:
    """A graph of templates whose imports are given, so that only the stitch is tested."""
    facts = cut(extracted(_files(spark, sf_dir, pairs), REPO, packs), packed=True)
    g = graph_of(facts)
    if not imports:
        return g, facts
    k = F.col("c_custkey").cast("string")
    file = lambda p: F.concat(F.lit(f"lat py {REPO} "), F.replace(F.lit(p), F.lit("§"), k), F.lit(" "))
    made = F.array(*(F.struct(file(a).alias("src"), file(b).alias("dst")) for a, b in imports))
    rows = read(spark, sf_dir, "customer").select(F.explode(made).alias("e"))
    edges = rows.select(*(({"src": F.col("e.src"), "dst": F.col("e.dst"), "kind": F.lit("IMPORTS"), "attrs": F.lit("{}"), "prov_confidence": F.lit(1.0)}.get(n) if n in ("src", "dst", "kind", "attrs", "prov_confidence") else F.lit("")).alias(n) for n in EDGES.names))
    return g.with_edges(g.edges.union(edges)), facts


@query(_rows([("w§/routes.py", "/v§/x")], ("path", "path_pattern")))
def fw_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, _ = _stitching(spark, sf_dir, _MOUNTED, ["fastapi"], [("w§/main.py", "w§/routes.py")])
    return verbs.routes(stitches.compose_prefixes(g).graph).select(F.col("file").alias("path"), "path_pattern")


@query(_rows([("w§/routes.py", "w§/db.py", "get§().")], ("path", "provider_path", "provider")))
def fw_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, _ = _stitching(spark, sf_dir, _MOUNTED, ["fastapi"], [("w§/routes.py", "w§/db.py")])
    edges = stitches.ground_providers(g).graph.edges.where("kind = 'PROVIDED_BY'")
    return edges.select(F.col("origin_path").alias("path"), _path(F.col("dst")).alias("provider_path"), _descriptor(F.col("dst")).alias("provider"))


@query(_rows([("web/r§.rb", "route(GET /c).", "app/c§.rb", "C§Controller#show().")], ("path", "route", "handler_path", "handler")))
def fw_handlers(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, _ = _stitching(spark, sf_dir, _SHOP, ["rails"])
    edges = stitches.ground_handlers(g).graph.edges.where("kind = 'HANDLED_BY'")
    return edges.select(F.col("origin_path").alias("path"), _descriptor(F.col("src")).alias("route"), _path(F.col("dst")).alias("handler_path"), _descriptor(F.col("dst")).alias("handler"))


@query(_rows([("m/m§.py", "fk", "up"), ("m/m§.py", "relationship", "self_")], ("path", "how", "via")))
def fw_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, facts = _stitching(spark, sf_dir, _MODELS, ["sqlalchemy"])
    edges = stitches.relate_models(g, facts.where("rel = 'relation'")).graph.edges.where("kind = 'RELATES_TO'")
    return edges.select(F.col("origin_path").alias("path"), F.get_json_object("attrs", "$.kind").alias("how"), F.get_json_object("attrs", "$.via").alias("via"))


# Chunks ---------------------------------------------------------------------

_CHUNKED = [("k§.py", "import os\nX = §\n\nclass A§:\n    def f(self):\n        return 'one two three four five six seven eight'\n\n    def g(self):\n        return 'one two three four five six seven eight'\n\n\ndef h():\n    return §\n")]
_CHUNKS = [("k§.py", 0, 1, 3), ("k§.py", 1, 4, 4), ("k§.py", 2, 5, 6), ("k§.py", 3, 8, 9), ("k§.py", 4, 12, 13)]


def _chunks(spark: SparkSession, sf_dir: str, most: int = 22) -> tuple[DataFrame, Graph]:
    files = _files(spark, sf_dir, _CHUNKED)
    g = graph_of(cut(extracted(files, REPO), packed=True))
    return cut(chunking.chunked(files, g.nodes, REPO, most), packed=True), g


@query(_rows(_CHUNKS, ("path", "seq", "span_start", "span_end"), ("seq", "span_start", "span_end")))
def ch_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of chunks: gaps put together, a class that is too long split at its methods."""
    return _chunks(spark, sf_dir)[0].select("path", F.col("seq").cast("long").alias("seq"), "span_start", "span_end")


@query(_rows([("k§.py", 0, ""), ("k§.py", 1, "A§#"), ("k§.py", 2, "A§#"), ("k§.py", 2, "A§#f()."), ("k§.py", 3, "A§#"), ("k§.py", 3, "A§#g()."), ("k§.py", 4, "h().")], ("path", "seq", "symbol"), ("seq",)))
def ch_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHUNK_OF edges: to every symbol that a chunk meets, else to the file."""
    found, g = _chunks(spark, sf_dir)
    edges = chunking.with_chunks(g, found).edges.where("kind = 'CHUNK_OF'")
    return edges.select(_path(F.col("src")).alias("path"), F.regexp_extract("src", r"chunk\((\d+)\)", 1).cast("long").alias("seq"), _descriptor(F.col("dst")).alias("symbol"))


@query("SELECT count(*) * 5 AS changed, CAST(0 AS BIGINT) AS unchanged FROM customer")
def em_skip_unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many chunks are embedded against an empty graph, and against one that has them."""
    found, g = _chunks(spark, sf_dir)
    first = chunking.changed_chunks(found, g).agg(F.count("*").alias("changed"))
    return first.join(chunking.changed_chunks(found, chunking.with_chunks(g, found)).agg(F.count("*").alias("unchanged")), F.lit(True))


# Verbs ----------------------------------------------------------------------


def _nodes(rows: DataFrame, kind: str, **values) -> DataFrame:
    have = {"kind": F.lit(kind), "span_start": F.lit(1), "span_end": F.lit(1), "attrs": F.lit("{}"), "prov_source": F.lit("parsed"), "prov_confidence": F.lit(1.0), "sym_path": F.lit(""), "name": F.lit("")} | values
    return rows.select(*((have.get(f.name) if f.name in have else F.lit("")).cast(f.dataType).alias(f.name) for f in NODES.fields))


def _links(rows: DataFrame, what: str, **values) -> DataFrame:
    have = {"kind": F.lit(what), "attrs": F.lit("{}"), "prov_source": F.lit("parsed"), "prov_confidence": F.lit(1.0)} | values
    return rows.select(*((have.get(f.name) if f.name in have else F.lit("")).cast(f.dataType).alias(f.name) for f in EDGES.fields))


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], EDGES)


_ID = lambda what, key: F.concat(F.lit(f"lat x {REPO} {what}/"), F.col(key).cast("string"), F.lit(f" {what}."))


@query("SELECT CASE WHEN page_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, regexp_extract(url, '^[^:]+://[^/]+([^?#]*)', 1) AS path, '/v1' || regexp_extract(url, '^[^:]+://[^/]+([^?#]*)', 1) AS path_pattern FROM pages WHERE page_id % 2 = 0 AND ('/v1' || regexp_extract(url, '^[^:]+://[^/]+([^?#]*)', 1)) LIKE '/v1/%'")
def vb_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of one method below a prefix; each page's URL is one."""
    pages = read(spark, sf_dir, "pages").withColumn("p", F.regexp_extract("url", r"^[^:]+://[^/]+([^?#]*)", 1))
    attrs = F.to_json(F.struct(F.when(F.col("page_id") % 2 == 0, "GET").otherwise("POST").alias("method"), F.col("p").alias("path"), F.concat(F.lit("/v1"), "p").alias("path_pattern")))
    g = Graph(_nodes(pages, "Route", id=_ID("route", "page_id"), attrs=attrs), _empty(spark))
    return verbs.routes(g, "get", "/v1/").select("method", "path", "path_pattern")


@query("SELECT c_name AS name, list_sort(list(DISTINCT o_orderpriority)) AS fields FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name UNION ALL SELECT c_name, CAST([] AS VARCHAR[]) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def vb_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models with their sorted fields: a customer is a model, the priorities of its orders its fields."""
    customers, orders = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    fields = orders.select("o_custkey", "o_orderpriority").distinct()
    field_id = F.concat(F.lit(f"lat x {REPO} f/"), F.col("o_custkey").cast("string"), F.lit(" "), F.replace(F.col("o_orderpriority"), F.lit(" "), F.lit("%20")), F.lit("."))
    nodes = _nodes(customers, "DataModel", id=_ID("model", "c_custkey"), name=F.col("c_name")).union(_nodes(fields, "Variable", id=field_id, name=F.col("o_orderpriority")))
    g = Graph(nodes, _links(fields, "HAS_FIELD", src=_ID("model", "o_custkey"), dst=field_id))
    return verbs.models(g).select("name", "fields")


@query("SELECT s_name AS name, CAST(count(DISTINCT l_partkey) AS BIGINT) AS into_parts FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey, s_name UNION ALL SELECT s_name, CAST(0 AS BIGINT) FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem)")
def vb_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services and where they are injected: suppliers, and the parts that they ever delivered."""
    rows = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    g = Graph(_nodes(read(spark, sf_dir, "supplier"), "Service", id=_ID("service", "s_suppkey"), name=F.col("s_name")), _links(rows, "INJECTED_INTO", src=_ID("service", "l_suppkey"), dst=_ID("part", "l_partkey")))
    return verbs.services(g).select("name", F.size("injected_into").cast("long").alias("into_parts"))


_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'proposed' ELSE 'rejected' END"


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS title, {_STATUS} AS status FROM orders o WHERE {_STATUS} = 'accepted' AND EXISTS (SELECT 1 FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey = o_orderkey AND p_brand LIKE 'Brand#1%')")
def vb_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of a status that govern something below a path: orders, and the brands of their parts."""
    orders, lines, parts = (read(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    status = F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "O", "proposed").otherwise("rejected")
    nodes = _nodes(orders, "Decision", id=_ID("decision", "o_orderkey"), name=F.col("o_orderkey").cast("string"), attrs=F.to_json(F.struct(status.alias("status")))).union(_nodes(parts, "Class", id=_ID("part", "p_partkey"), sym_path=F.col("p_brand")))
    g = Graph(nodes, _links(lines, "GOVERNS", src=_ID("decision", "l_orderkey"), dst=_ID("part", "l_partkey")))
    return verbs.decisions(g, "Brand#1", "accepted").select("title", "status")


@query("SELECT doc_id, CAST(0.5 + quality * 0.4 AS DOUBLE) AS confidence FROM labels WHERE quality = 1")
def vb_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols with a tag of at least 0.7: labelled documents, by their quality."""
    labels = read(spark, sf_dir, "labels").withColumn("c", 0.5 + F.col("quality") * 0.4)
    tag = f"lat pattern {REPO} v1 Good#"
    g = Graph(_nodes(spark.range(1), "PatternTag", id=F.lit(tag), name=F.lit("Good")), _links(labels, "TAGGED", src=_ID("doc", "doc_id"), dst=F.lit(tag), attrs=F.to_json(F.struct(F.col("c").alias("confidence")))))
    return verbs.tagged(g, "Good").select(F.regexp_extract("id", r"doc/(\d+)", 1).cast("long").alias("doc_id"), "confidence")


@query("SELECT 'node' AS what, 'File' AS kind, count(*) AS n FROM documents UNION ALL SELECT 'edge', upper(source), count(*) FROM documents GROUP BY source")
def vb_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return verbs.kind_counts(Graph(_nodes(docs, "File", id=_ID("doc", "doc_id")), _links(docs, "x", src=_ID("doc", "doc_id"), dst=_ID("doc", "doc_id"), kind=F.upper("source"))))


@query("WITH b AS (SELECT l_returnflag || '/' || l_linestatus AS sym_path, max(l_extendedprice) AS best FROM lineitem GROUP BY 1) SELECT sym_path, row_number() OVER (ORDER BY best DESC, sym_path) AS place FROM b")
def wn_file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in order of their best symbol."""
    lines = read(spark, sf_dir, "lineitem")
    path = F.concat("l_returnflag", F.lit("/"), "l_linestatus")
    return verbs.file_order(lines.select(path.alias("sym_path"), F.col("l_extendedprice").alias("rank"), path.alias("id"))).select("sym_path", F.col("place").cast("long").alias("place"))


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_linenumber + 1) - 1 AS seq FROM lineitem")
def wn_chunk_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("span_start"), (F.col("l_linenumber") + 1).alias("span_end"))
    return verbs.chunk_sequence(lines).select("l_orderkey", "l_linenumber", F.col("seq").cast("long").alias("seq"))


@query("WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS m FROM orders) SELECT o_custkey, o_orderkey FROM n WHERE m <= 4 OR i = 0 OR CAST(floor(i * 4 / m) AS BIGINT) > CAST(floor((i - 1) * 4 / m) AS BIGINT)")
def wn_strided_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four orders of each customer, evenly spaced: the sampling operator's feature."""
    return verbs.strided_sample(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 4)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 60")
def wn_first_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verbs.first_candidates(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))).select(F.col("id").alias("o_orderkey"))


_HITS = "SELECT l_orderkey AS query, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS place, l_returnflag = 'R' AS good FROM lineitem"


@query(f"WITH h AS ({_HITS}), q AS (SELECT query, min(CASE WHEN good THEN place END) AS f, sum(CASE WHEN good AND place <= 8 THEN 1 / log2(place + 1) ELSE 0 END) AS dcg, count(*) FILTER (good) AS n FROM h GROUP BY query), i AS (SELECT n, (SELECT sum(1 / log2(x + 1)) FROM range(1, least(n, 8) + 1) t(x)) AS ideal FROM (SELECT DISTINCT n FROM q)) SELECT round(avg(coalesce(1 / f, 0)), 9) AS mrr, round(avg(CASE WHEN f <= 1 THEN 1.0::DOUBLE ELSE 0 END), 9) AS recall_1, round(avg(CASE WHEN f <= 5 THEN 1.0::DOUBLE ELSE 0 END), 9) AS recall_5, round(avg(CASE WHEN n > 0 THEN dcg / ideal ELSE 0 END), 9) AS ndcg_8 FROM q JOIN i USING (n)")
def ag_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean reciprocal rank, recall and nDCG: an order asks, its lines are hits, returned ones are relevant."""
    hits = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query"), F.col("l_linenumber").alias("id"), F.col("l_extendedprice").alias("score"), (F.col("l_returnflag") == "R").alias("relevant"))
    found = verbs.quality(hits)
    return found.select(*(F.round(c, 9).alias(c) for c in ("mrr", "recall_1", "recall_5", "ndcg_8")))
