"""What the scanners find in each language, and the packs in each framework: golden results."""

import pytest

from codelattice.extract.packs import BY_SLUG, fingerprints, pack_of, path_namespace
from codelattice.extract.rows import facts_of
from codelattice.extract.tokens import cleaned_doc


def found(path, text, *packs):
    rows = facts_of(path, text, "r", packs)
    name = lambda i: i.split(" ")[4].replace("%20", " ")
    return {
        "defs": [(r["kind"], name(r["id"]), r.get("span_start"), r.get("span_end")) for r in rows if r["rel"] == "node" and r["kind"] not in ("File", "DocChunk", "Route", "ServiceCall", "DataModel", "Service", "RouteMount")],
        "imports": [(r["name"], r["extra"], r["dst"]) for r in rows if r["rel"] == "import"],
        "calls": [(name(r["id"]), r["name"], r["dst"]) for r in rows if r["rel"] == "ref"],
        "bases": [(name(r["id"]), r["name"]) for r in rows if r["rel"] == "base"],
        "receivers": [(name(r["id"]), r["name"], r["dst"]) for r in rows if r["rel"] == "receiver"],
        "routes": [(r["name"], next((name(e["dst"]) for e in rows if e["rel"] == "edge" and e["kind"] == "HANDLED_BY" and e["id"] == r["id"]), None)) for r in rows if r["rel"] == "node" and r["kind"] == "Route"],
        "service_calls": [r["name"] for r in rows if r["rel"] == "node" and r["kind"] == "ServiceCall"],
        "unresolved": sum(r["rel"] == "unresolved" for r in rows),
        "docs": [r["name"] for r in rows if r["rel"] == "node" and r["kind"] == "DocChunk"],
        "rows": rows,
    }


def names(f):
    return [(k, n) for k, n, *_ in f["defs"]]


def test_python():
    f = found("a/m.py", '"""mod"""\nimport os, a.b as ab\nfrom .util import x, y as z\nfrom q import *\nclass A(B, mod.C, G[int]):\n    """Doc\n    here."""\n    def f(self):\n        return self.g(x(1)).h()\n    @dec\n    def f(self): pass\nasync def top():\n    def inner(): os.path.join("a")\n')
    assert f["defs"] == [("Class", "A#", 5, 11), ("Method", "A#f().", 8, 9), ("Method", "A#f(+1)().", 11, 11), ("Function", "top().", 12, 13), ("Function", "top().inner().", 13, 13)]
    assert f["imports"] == [("os", [], ""), ("a.b", [], "ab"), (".util", ["x"], ""), (".util", ["y"], "")]
    assert f["calls"] == [("A#f().", "h", "self.g(x(1))"), ("A#f().", "g", "self"), ("A#f().", "x", None), ("top().inner().", "join", "os.path")]
    assert f["bases"] == [("A#", "B"), ("A#", "mod.C")] and f["docs"] == ["A"]
    broken = found("m.py", "class A:\n    def f(self):\n        x = (\n\ndef g(:\n    pass\n")
    assert names(broken) == [("Class", "A#"), ("Method", "A#f()."), ("Function", "g().")] and '"parse_error": true' in broken["rows"][0]["attrs"]


TS = """import { a, b as c } from "./util";
import * as ns from '../x';
/** A doc
 * more */
class Foo extends Bar.Baz implements I {
  private x: number = call(1);
  constructor(private y: string) { super(); this.go(); }
  async go<T>(a: T): Promise<void> { await ns.run(`t ${a}`); if (x) { y(); } }
  get p(): string { return this.x.toString(); }
}
function plain(a: {b: string}): void { plain2(/re(x)/g, a / b); }
export const arrow = async (x: number): Promise<number> => { return x; };
export const TABLE = { a: 1, m() { return 2; } };
interface I { m(): void; }
enum E { A, B }
type T = string | number;
abstract class Abs { abstract q(): void; r() {} }
"""


def test_typescript():
    f = found("a/m.ts", TS)
    assert names(f) == [("Class", "Foo#"), ("Method", "Foo#constructor()."), ("Method", "Foo#go()."), ("Method", "Foo#p()."), ("Function", "plain()."), ("Function", "arrow()."), ("Variable", "TABLE."), ("Function", "TABLE.m()."), ("Interface", "I#"), ("Class", "E#"), ("TypeAlias", "T."), ("Class", "Abs#"), ("Method", "Abs#r().")]
    assert f["imports"] == [("./util", ["a"], ""), ("./util", ["b"], ""), ("../x", [], "ns")] and f["bases"] == [("Foo#", "Bar.Baz")] and f["docs"] == ["Foo"]
    assert f["calls"] == [("Foo#", "call", None), ("Foo#constructor().", "go", "this"), ("Foo#go().", "run", "ns"), ("Foo#go().", "y", None), ("Foo#p().", "toString", "this.x"), ("plain().", "plain2", None)]


def test_javascript():
    f = found("a/m.js", 'const {x, y} = require("./z"); const w = require(\'w\');\nmodule.exports = { f: function() { x(); }, g: () => 1 };\nexports.h = function () { w.go(); };\nmodule.exports.k = (a) => a;\nclass Q extends W { m() { return this.n(); } }\nmodule.exports = Q;\nlet h2 = function() {};\n')
    assert names(f) == [("Function", "f()."), ("Function", "g()."), ("Function", "h()."), ("Function", "k()."), ("Class", "Q#"), ("Method", "Q#m()."), ("Function", "h2().")]
    assert f["imports"] == [("./z", ["x"], ""), ("./z", ["y"], ""), ("w", [], "w")] and '"default_export": "Q"' in f["rows"][0]["attrs"] and f["bases"] == [("Q#", "W")]
    assert ("h().", "go", "w") in f["calls"] and ("Q#m().", "n", "this") in f["calls"]


def test_go():
    f = found("p/m.go", 'package p\nimport ("fmt"; "example.com/m/q")\nimport x "y/z"\nconst A = 1\nvar (\n  B = 2\n  C, D int\n)\ntype S struct { a int }\ntype I interface { M() }\ntype F func(int) error\ntype (\n  G = string\n  H map[string]int\n)\nfunc (s *S) M(a int) (int, error) { s.N(); fmt.Println("x"); return helper(a), nil }\nfunc (s S) N() {}\nfunc helper[T any](a T) T { return a }\n')
    assert names(f) == [("Variable", "A."), ("Variable", "B."), ("Variable", "C."), ("Variable", "D."), ("Class", "S#"), ("Interface", "I#"), ("TypeAlias", "F."), ("TypeAlias", "G."), ("TypeAlias", "H."), ("Method", "M()."), ("Method", "N()."), ("Function", "helper().")]
    assert [i[0] for i in f["imports"]] == ["fmt", "example.com/m/q", "y/z"] and f["receivers"] == [("M().", "s", "S"), ("N().", "s", "S")]
    assert f["calls"] == [("M().", "N", "s"), ("M().", "Println", "fmt"), ("M().", "helper", None)]


def test_ruby():
    f = found("a/m.rb", 'require_relative "thor/command"\nmodule Foo\n  CONST = [1, 2]\n  class Bar < Base\n    def initialize(a) = @a = a\n    def go(x)\n      return 1 if x\n      helper x\n      x.each do |y| puts y end\n      self.stop\n      while x do z(); end\n      foo = if x\n        1\n      end\n    end\n    def self.make(*args); new(*args); end\n    def stop; end\n  end\nend\n')
    assert f["defs"] == [("Class", "Foo#", 2, 19), ("Variable", "Foo#CONST.", 3, 3), ("Class", "Foo#Bar#", 4, 18), ("Method", "Foo#Bar#initialize().", 5, 5), ("Method", "Foo#Bar#go().", 6, 15), ("Method", "Foo#Bar#make().", 16, 16), ("Method", "Foo#Bar#stop().", 17, 17)]
    assert f["imports"] == [("thor/command", [], "")] and f["bases"] == [("Foo#Bar#", "Base")]
    assert {("Foo#Bar#go().", "helper", None), ("Foo#Bar#go().", "each", "x"), ("Foo#Bar#go().", "stop", "self"), ("Foo#Bar#go().", "z", None)} <= set(f["calls"])


def test_php():
    f = found("a/m.php", "<?php\nnamespace App\\Geo;\nuse App\\Foo\\Bar;\nuse App\\X\\{A, B};\nconst TOP = 1;\nabstract class Circle extends Shape implements I {\n  const PI = 3.14;\n  public function __construct(private int $r) { parent::__construct(); }\n  public function area(): float { return $this->half($this->r) + Helper::go(1) + util(2); }\n  abstract protected function half(float $x);\n}\ninterface I { function f(); }\ntrait T { function t() {} }\nfunction top($a) { return new Bar($a); }\n")
    assert names(f) == [("Variable", "TOP."), ("Class", "Circle#"), ("Variable", "Circle#PI."), ("Method", "Circle#__construct()."), ("Method", "Circle#area()."), ("Method", "Circle#half()."), ("Interface", "I#"), ("Method", "I#f()."), ("Class", "T#"), ("Method", "T#t()."), ("Function", "top().")]
    assert f["imports"] == [("App\\Foo\\Bar", [], "")] and f["bases"] == [("Circle#", "Shape")] and "App\\\\Geo" in f["rows"][0]["attrs"]
    assert f["calls"] == [("Circle#__construct().", "__construct", "parent"), ("Circle#area().", "half", "$this"), ("Circle#area().", "go", "Helper"), ("Circle#area().", "util", None)]


def test_java():
    f = found("a/M.java", 'package com.foo.geo;\nimport com.foo.util.Helper;\n@Entity(name = "x")\npublic class Circle extends Shape implements I<Foo> {\n  private final int x = init(3);\n  @Inject\n  public Circle(double r) { super(r); this.setup(); }\n  @Override public double area() throws Ex { return Helper.half(this.r) * pi(); }\n  abstract void q(int a);\n  enum Kind { A(1), B(2); Kind(int x) {} }\n  record P(int a, int b) {}\n}\ninterface I<T> { void f(T t); default int g() { return 1; } }\n')
    assert names(f) == [("Class", "Circle#"), ("Method", "Circle#Circle()."), ("Method", "Circle#area()."), ("Method", "Circle#q()."), ("Class", "Circle#Kind#"), ("Method", "Circle#Kind#Kind()."), ("Class", "Circle#P#"), ("Interface", "I#"), ("Method", "I#f()."), ("Method", "I#g().")]
    assert f["imports"] == [("com.foo.util.Helper", [], "")] and f["bases"] == [("Circle#", "Shape")]
    assert f["calls"] == [("Circle#", "init", None), ("Circle#Circle().", "setup", "this"), ("Circle#area().", "half", "Helper"), ("Circle#area().", "pi", None)]


def test_csharp():
    f = found("a/M.cs", 'using System; using App.Geo;\nnamespace App.Shapes {\n  public class Circle : Shape, IShape {\n    private int x = Init();\n    public Circle(double r) : base(r) { Setup(); }\n    [HttpGet("x")] public async Task<double> Area(int a) => await Helper.Half(a);\n    public int P { get; set; } = F();\n    abstract void Q();\n  }\n  public interface IShape { void Q(); }\n  public record Pt(int X, int Y);\n  struct V { }\n}\n')
    assert names(f) == [("Class", "Circle#"), ("Method", "Circle#Circle()."), ("Method", "Circle#Area()."), ("Method", "Circle#Q()."), ("Interface", "IShape#"), ("Method", "IShape#Q()."), ("Class", "Pt#"), ("Class", "V#")]
    assert f["imports"] == [("System", [], ""), ("App.Geo", [], "")] and f["bases"] == [("Circle#", "Shape"), ("Circle#", "IShape")] and "App.Shapes" in f["rows"][0]["attrs"]
    assert f["calls"] == [("Circle#", "Init", None), ("Circle#Circle().", "Setup", None), ("Circle#Area().", "Half", "Helper"), ("Circle#", "F", None)]


def test_cpp():
    f = found("a/m.cpp", '#include "geo/shape.h"\n#include <vector>\nnamespace geo {\nclass Circle : public Shape {\n public:\n  Circle(double r) : r_(r), v{1} { init(); }\n  double area() const override { return this->half(r_) + util(2) + geo::x(1); }\n  virtual void q() = 0;\n  ~Circle() {}\n private:\n  double r_;\n};\nenum class K { A, B };\n}\ndouble geo::Circle::half(double x) const { return x / 2; }\nstatic int helper(int a) { return a; }\nint proto(int);\nint main() { Circle c(1); c.area(); auto p = helper(2); return 0; }\n')
    assert names(f) == [("Class", "Circle#"), ("Method", "Circle#Circle()."), ("Method", "Circle#area()."), ("Method", "Circle#q()."), ("Class", "K#"), ("Function", "half()."), ("Function", "helper()."), ("Function", "proto()."), ("Function", "main().")]
    assert f["imports"] == [("geo/shape.h", [], "")]
    assert f["calls"] == [("Circle#Circle().", "init", None), ("Circle#area().", "half", "this"), ("Circle#area().", "util", None), ("main().", "area", "c"), ("main().", "helper", None)]


def test_rust():
    f = found("src/a/b.rs", 'use crate::util::Helper;\nuse std::{a, b};\npub struct Circle { r: f64 }\npub struct U(i32);\nenum E { A, B }\npub trait Shape { fn area(&self) -> f64; fn d(&self) { self.area(); } }\nimpl Shape for Circle { fn area(&self) -> f64 { self.half() + helper(1) + Circle::new(2) } }\nimpl<T> Foo<T> { fn g() {} }\nimpl Circle { pub fn new(r: f64) -> Self { println!("{}", f(1)); Circle { r } } fn half<\'a>(&\'a self) -> f64 { self.r } }\nconst MAX: usize = 3;\nstatic S: &str = "x";\ntype R = Result<i32, E>;\npub(crate) fn helper(x: i32) -> i32 { x }\n')
    assert set(names(f)) == {("Class", "Circle#"), ("Class", "U#"), ("Class", "E#"), ("Interface", "Shape#"), ("Method", "Shape#area()."), ("Method", "Shape#d()."), ("Method", "Circle#area()."), ("Function", "g()."), ("Method", "Circle#new()."), ("Method", "Circle#half()."), ("Variable", "MAX."), ("Variable", "S."), ("TypeAlias", "R."), ("Function", "helper().")}
    assert f["imports"] == [("crate::util::Helper", [], "")]
    assert f["calls"] == [("Shape#d().", "area", "self"), ("Circle#area().", "half", "self"), ("Circle#area().", "helper", None)]


@pytest.mark.parametrize("slug", sorted(BY_SLUG))
@pytest.mark.parametrize("text", ["", "\0", "}}}}))))", "{{{{((((", "'unclosed", "/* unclosed", "class", "func (", "x" * 200_000, "({[" * 2000, "a.b(" * 2000, 'f("' * 500])
def test_scanners_survive_anything(slug, text):
    path = "f" + BY_SLUG[slug].extensions[0]
    assert facts_of(path, text, "r")[0]["kind"] == "File"


def test_modules_and_imports():
    py, ts, rb = BY_SLUG["py"], BY_SLUG["ts"], BY_SLUG["rb"]
    assert (py.module("a/b/__init__.py"), py.module("a/b.py"), ts.module("a/b.ts"), BY_SLUG["go"].module("a/b.go")) == ("a.b", "a.b", "a/b", "a")
    assert (py.target("a/b/c.py", ".x", "a.b.c"), py.target("a/b/c.py", "..x", "a.b.c"), py.target("a/b/__init__.py", ".", "a.b"), py.target("c.py", "....x", "c")) == ("a.b.x", "a.x", "a.b", "x")
    assert (ts.target("a/b.ts", "../c/d.ts"), ts.target("a/b.ts", "react"), rb.target("a/b.rb", "c")) == ("c/d", "react", "a/c")
    assert (path_namespace("src/a/b.rs"), path_namespace("src/a/mod.rs"), path_namespace("src/lib.rs")) == ("a/b", "a", "")
    assert pack_of("x/y.HPP") is None and pack_of("x/y.hpp").slug == "cpp" and len(set(fingerprints().values())) == 10
    assert cleaned_doc("/** one\n * two\n */") == "one\ntwo"


# Frameworks -----------------------------------------------------------------


def test_fastapi():
    f = found("app.py", "@app.get('/a')\ndef a(x=Depends(get_db), y=Security(pkg.user)):\n    pass\n@app.middleware('http')\ndef m(): pass\n@app.post(PATH)\ndef b(): pass\nclass C:\n    @router.put('/c')\n    async def c(self): pass\n", "fastapi")
    assert f["routes"] == [("GET /a", "a()."), ("PUT /c", "C#c().")] and f["unresolved"] == 1
    assert sorted(r["name"] for r in f["rows"] if r["rel"] == "node" and r["kind"] == "Service") == ["get_db", "user"]


def test_flask():
    f = found("app.py", "@app.route('/h')\ndef h(): pass\n@app.route('/u/<int:i>', methods=['GET', 'POST'])\ndef u(i): pass\n@bp.get('/i')\ndef i(): pass\n@app.route(f'/{x}')\ndef d(): pass\n", "flask")
    assert [r[0] for r in f["routes"]] == ["GET /h", "GET /u/<int:i>", "POST /u/<int:i>", "GET /i"] and f["unresolved"] == 1


def test_django():
    f = found("models.py", "class User(models.Model):\n    name = models.CharField(max_length=3)\n    boss = models.ForeignKey('self', on_delete=1)\n    tags = models.ManyToManyField('app.Tag')\n    class Meta:\n        db_table = 'auth_user'\nclass Plain:\n    x = SomeField()\n", "django")
    models = [r for r in f["rows"] if r["rel"] == "node" and r["kind"] == "DataModel"]
    assert [m["name"] for m in models] == ["auth_user"]
    assert [(r["name"], r["dst"], r["kind"]) for r in f["rows"] if r["rel"] == "relation"] == [("boss", "User", "fk"), ("tags", "Tag", "m2m")]
    assert [d[1] for d in f["defs"] if d[0] == "Variable"] == ["User#name.", "User#boss."]


def test_http_clients():
    f = found("c.py", "import requests, httpx\nc = httpx.Client(base_url='http://orders/v1/')\nc.get('/x')\nrequests.post('http://pay/y?z=1')\ns = requests.Session()\ns.delete('/d')\nother.get('/no')\nrequests.get(url)\nwith httpx.AsyncClient() as k:\n    k.put('http://a/b')\n", "httpclient")
    assert sorted(f["service_calls"]) == ["DELETE /d", "GET http://orders/v1/x", "POST http://pay/y?z=1", "PUT http://a/b"] and f["unresolved"] == 1
    assert {r["attrs"].split('"path": ')[1].split(",")[0] for r in f["rows"] if r["rel"] == "node" and r["kind"] == "ServiceCall"} == {'"/d"', '"/v1/x"', '"/y"', '"/b"'}
    f = found("c.js", "fetch('/a'); fetch(`/b`, { method: 'POST' }); axios.put(\"http://x/c\"); fetch(url); axios(`/d/${x}`); obj.fetch('/no');\n", "jshttpclient")
    assert f["service_calls"] == ["GET /a", "POST /b", "PUT http://x/c"] and f["unresolved"] == 2


def test_express_and_nest():
    f = found("a.js", "function list(req, res) {}\napp.get('/a', auth, list);\nrouter.all('/b', (q, r) => {});\napp.get('setting');\nrouter.post(path, list);\ncache.get(key, other);\n", "express")
    assert f["routes"] == [("GET /a", "list()."), ("ALL /b", None)] and f["unresolved"] == 1
    f = found("a.ts", "@Controller('cats')\nexport class CatsController {\n  @Get()\n  all() { return 1; }\n  @Post('new')\n  make(@Body() b: X) { return 2; }\n  @Put(path)\n  dyn() {}\n}\nclass Other { @Get('x') no() {} }\n", "nestjs")
    assert f["routes"] == [("GET /cats", "CatsController#all()."), ("POST /cats/new", "CatsController#make().")] and f["unresolved"] == 1


def test_spring_and_aspnet():
    f = found("A.java", '@RestController\n@RequestMapping("/api")\nclass A {\n  @GetMapping("/x") int x() { return 1; }\n  @RequestMapping(value = "/y", method = RequestMethod.POST) int y() { return 1; }\n  @PutMapping(PATH) int z() { return 1; }\n}\nclass B { @GetMapping("/no") int n() { return 1; } }\n', "spring")
    assert f["routes"] == [("GET /api/x", "A#x()."), ("POST /api/y", "A#y().")] and f["unresolved"] == 1
    f = found("A.cs", '[ApiController]\n[Route("api/[controller]")]\npublic class UsersController : ControllerBase {\n  [HttpGet("{id}")] public int Get(int id) { return 1; }\n  [HttpPost] public int Make() { return 1; }\n  [HttpDelete("/root/[action]")] public int Gone() { return 1; }\n}\n', "aspnet")
    assert f["routes"] == [("GET /api/Users/{id}", "UsersController#Get()."), ("POST /api/Users", "UsersController#Make()."), ("DELETE /root/Gone", "UsersController#Gone().")]


def test_gin_laravel_rails():
    f = found("m.go", 'package m\nfunc list() {}\nfunc main() { r.GET("/a", list); r.Any("/b", func() {}); r.POST(path, list) }\n', "gin")
    assert f["routes"] == [("GET /a", "list()."), ("ALL /b", None)] and f["unresolved"] == 1
    f = found("web.php", "<?php\nRoute::get('/a', [UserController::class, 'index']);\nRoute::post('b', 'App\\Http\\OrderController@store');\nRoute::any('/c', function () {});\nRoute::put($x, 'C@m');\n", "laravel")
    handlers = [(r["name"], r["attrs"].split('"handler_class": ')[1].split(",")[0], r["attrs"].split('"handler_method": ')[1].split(",")[0]) for r in f["rows"] if r["rel"] == "node" and r["kind"] == "Route"]
    assert handlers == [("GET /a", '"UserController"', '"index"'), ("POST /b", '"OrderController"', '"store"'), ("ALL /c", '""', '""')] and f["unresolved"] == 1
    f = found("routes.rb", "Rails.application.routes.draw do\n  root 'home#index'\n  get '/a', to: 'admin/user_posts#show'\n  post 'b' => 'orders#make'\n  resources :cats\nend\n", "rails")
    handlers = [(r["name"], r["attrs"].split('"handler_class": ')[1].split(",")[0]) for r in f["rows"] if r["rel"] == "node" and r["kind"] == "Route"]
    assert handlers == [("GET /", '"HomeController"'), ("GET /a", '"UserPostsController"'), ("POST /b", '"OrdersController"')] and f["unresolved"] == 1
