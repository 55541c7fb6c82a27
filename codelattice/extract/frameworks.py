"""Framework facts of one file: routes and their handlers, injected services, router mounts, data models and calls to other services.

Each pack reads what its language's scanner has parsed already.  A fact that a pack recognises but can't read, such as a
route whose path is computed, is counted as unresolved and never guessed.  What needs other files (prefixes, providers,
controllers, relations) is left to the second pass.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from codelattice.extract.scan import Definition, Scanned

VERBS = frozenset({"delete", "get", "head", "options", "patch", "post", "put"})


@dataclass
class Fact:
    """A node with a ``suffix`` for its id, the ids that it points to, and attributes."""

    kind: str
    suffix: str
    name: str
    lines: tuple[int, int]
    attrs: dict = field(default_factory=dict)
    edges: list[tuple[str, str]] = field(default_factory=list)  # (kind, id of the target)
    fields: list["Fact"] = field(default_factory=list)
    relations: list[tuple[str, str, str]] = field(default_factory=list)  # (field, target, kind)


class Unresolved(str):
    """The name of a pack that saw something it couldn't read."""


@dataclass(frozen=True)
class FrameworkPack:
    name: str
    slugs: tuple[str, ...]
    dependencies: tuple[str, ...]
    markers: tuple[str, ...]
    extract: Callable[..., Iterator[Fact | Unresolved]]


def joined(base: str, path: str) -> str:
    """One slash between the parts of a route and one at its begin."""
    return "/" + "/".join(p for p in (base.strip("/"), path.strip("/")) if p)


def composed(base_url: str, url: str) -> str:
    return url if not base_url or "://" in url else f"{base_url.rstrip('/')}/{url.lstrip('/')}"


def path_of(url: str) -> str:
    rest = re.sub(r"^[^/?#]*://[^/?#]*", "", url)
    return "/" + re.split(r"[?#]", rest, maxsplit=1)[0].lstrip("/")


def route(pack: str, method: str, path: str, lines: tuple[int, int], handler: Definition | None = None, **more: str) -> Fact:
    method = method.upper()
    attrs = {"method": method, "path": path, "path_pattern": path, "framework": pack, "handler": handler.id if handler else ""} | more
    return Fact("Route", f"route({method} {path}).", f"{method} {path}", lines, attrs, [("HANDLED_BY", handler.id)] if handler else [])


def service_call(pack: str, method: str, url: str, lines: tuple[int, int]) -> Fact:
    method = method.upper()
    return Fact("ServiceCall", f"servicecall({method} {url}@{lines[0]}).", f"{method} {url}", lines, {"method": method, "url": url, "path": path_of(url), "framework": pack})


# ------------------------------------------------------------------ Python


def _literal(node: ast.AST | None) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def _dotted(node: ast.AST | None) -> str:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute) and (base := _dotted(node.value)):
        return f"{base}.{node.attr}"
    return ""


def _keyword(call: ast.Call, name: str) -> ast.AST | None:
    return next((k.value for k in call.keywords if k.arg == name), None)


def _last(node: ast.AST | None) -> str:
    return _dotted(node).rpartition(".")[2]


def _functions(found: Scanned) -> Iterator[tuple[ast.FunctionDef | ast.AsyncFunctionDef, Definition]]:
    by_line = {(d.lines, d.name): d for d in found.definitions}
    for n in ast.walk(found.tree) if found.tree else ():
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and (d := by_line.get(((n.lineno, n.end_lineno), n.name))):
            yield n, d


def _decorated(found: Scanned) -> Iterator[tuple[str, str, ast.Call, Definition, tuple[int, int]]]:
    """(object, method, call, handler, lines) of decorators like ``@app.get(...)``."""
    for n, d in _functions(found):
        for c in n.decorator_list:
            if isinstance(c, ast.Call) and isinstance(c.func, ast.Attribute):
                yield _dotted(c.func.value), c.func.attr, c, d, (c.lineno, n.end_lineno)


def _fastapi(found: Scanned) -> Iterator[Fact | Unresolved]:
    for owner, method, call, handler, lines in _decorated(found):
        if method in VERBS:
            path = _literal(call.args[0] if call.args else _keyword(call, "path"))
            yield Unresolved("fastapi") if path is None else route("fastapi", method, path, lines, handler, router_var=owner.rpartition(".")[2])
    services: dict[str, Fact] = {}
    for n, d in _functions(found):
        for default in [*n.args.defaults, *filter(None, n.args.kw_defaults)]:
            if isinstance(default, ast.Call) and _last(default.func) in ("Depends", "Security") and default.args and (provider := _last(default.args[0])):
                s = services.setdefault(provider, Fact("Service", f"service({provider}).", provider, (n.lineno, n.lineno), {"framework": "fastapi", "provider": provider}))
                if ("INJECTED_INTO", d.id) not in s.edges:
                    s.edges.append(("INJECTED_INTO", d.id))
    yield from services.values()
    for n in ast.walk(found.tree) if found.tree else ():
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr == "include_router":
            what = _dotted(n.args[0]) if n.args else ""
            if not what:
                yield Unresolved("fastapi")
                continue
            attrs = {"framework": "fastapi", "router_ref": what, "router_var": what.rpartition(".")[2], "prefix": _literal(_keyword(n, "prefix")) or ""}
            yield Fact("RouteMount", f"mount({what}@{n.lineno}).", what, (n.lineno, n.end_lineno), attrs)


def _flask(found: Scanned) -> Iterator[Fact | Unresolved]:
    for owner, method, call, handler, lines in _decorated(found):
        if method != "route" and method not in VERBS:
            continue
        path = _literal(call.args[0] if call.args else _keyword(call, "rule"))
        if path is None:
            yield Unresolved("flask")
            continue
        methods = [method]
        if method == "route":
            listed = _keyword(call, "methods")
            methods = [m for m in map(_literal, listed.elts) if m] if isinstance(listed, (ast.List, ast.Tuple, ast.Set)) else ["GET"]
        for m in methods:
            yield route("flask", m, path, lines, handler, router_var=owner.rpartition(".")[2])


def _assignments(body: list[ast.stmt]) -> Iterator[tuple[str, ast.AST, ast.stmt]]:
    for s in body:
        if isinstance(s, ast.Assign) and len(s.targets) == 1 and isinstance(s.targets[0], ast.Name):
            yield s.targets[0].id, s.value, s
        elif isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Name) and s.value is not None:
            yield s.target.id, s.value, s


def _classes(found: Scanned) -> Iterator[tuple[ast.ClassDef, Definition]]:
    by_line = {(d.lines, d.name): d for d in found.definitions}
    for n in ast.walk(found.tree) if found.tree else ():
        if isinstance(n, ast.ClassDef) and (d := by_line.get(((n.lineno, n.end_lineno), n.name))):
            yield n, d


def _model(pack: str, n: ast.ClassDef, d: Definition, table: str | None, fields: list[tuple[str, str, ast.stmt]], relations: list[tuple[str, str, str]]) -> Fact:
    attrs = {"framework": pack, "class": d.id, "model_class": n.name} | ({"table": table} if table else {})
    made = Fact("DataModel", f"model({n.name}).", table or n.name, d.lines, attrs, relations=relations)
    made.fields = [Fact("Variable", f"{n.name}#{name}.", name, (s.lineno, s.end_lineno), {"column_type": kind, "framework": pack}) for name, kind, s in fields]
    return made


def _sqlalchemy(found: Scanned) -> Iterator[Fact | Unresolved]:
    for n, d in _classes(found):
        table, fields, relations = None, [], []
        for name, value, s in _assignments(n.body):
            if name == "__tablename__":
                table = _literal(value) or table
            elif isinstance(value, ast.Call) and (what := _last(value.func)) in ("Column", "mapped_column"):
                first = value.args[0] if value.args else None
                kind = _last(first.func if isinstance(first, ast.Call) else first)
                if not kind and isinstance(s, ast.AnnAssign) and isinstance(s.annotation, ast.Subscript) and _last(s.annotation.value) == "Mapped":
                    kind = ast.unparse(s.annotation.slice)
                fields.append((name, kind, s))
                keys = [a for a in value.args if isinstance(a, ast.Call) and _last(a.func) == "ForeignKey"]
                relations += [(name, t, "fk") for a in keys[:1] if (t := _literal(a.args[0] if a.args else None))]
            elif isinstance(value, ast.Call) and what == "relationship" and (t := _literal(value.args[0] if value.args else None)):
                relations.append((name, t, "relationship"))
        if table is not None or fields:
            yield _model("sqlalchemy", n, d, table, fields, relations)


_LINKS = {"ManyToManyField": "m2m", "OneToOneField": "o2o", "ForeignKey": "fk"}


def _django(found: Scanned) -> Iterator[Fact | Unresolved]:
    for n, d in _classes(found):
        fields, relations, sure = [], [], any(_last(b) == "Model" for b in n.bases)
        for name, value, s in _assignments(n.body):
            kind = _last(value.func) if isinstance(value, ast.Call) else ""
            if not (kind.endswith("Field") or kind in _LINKS):
                continue
            sure |= _dotted(value.func).split(".")[-2:-1] == ["models"]
            if kind in _LINKS and value.args:
                text = _literal(value.args[0])
                target = n.name if text == "self" else text.rpartition(".")[2] if text else _last(value.args[0])
                if target:
                    relations.append((name, target, _LINKS[kind]))
            if _LINKS.get(kind) != "m2m":
                fields.append((name, kind, s))
        if sure:
            meta = [t for c in n.body if isinstance(c, ast.ClassDef) and c.name == "Meta" for name, v, _ in _assignments(c.body) if name == "db_table" and (t := _literal(v))]
            yield _model("django", n, d, meta[0] if meta else None, fields, relations)


_CLIENTS = {"requests": {"Session"}, "httpx": {"AsyncClient", "Client"}}


def _python_http(found: Scanned) -> Iterator[Fact | Unresolved]:
    clients = {m: (m, "") for m in _CLIENTS}
    nodes = list(ast.walk(found.tree)) if found.tree else []
    made = [(t.id, s.value) for s in nodes if isinstance(s, ast.Assign) for t in s.targets if isinstance(t, ast.Name)]
    made += [(i.optional_vars.id, i.context_expr) for s in nodes if isinstance(s, (ast.With, ast.AsyncWith)) for i in s.items if isinstance(i.optional_vars, ast.Name)]
    for name, value in made:
        if isinstance(value, ast.Call):
            module, _, maker = _dotted(value.func).partition(".")
            if maker in _CLIENTS.get(module, ()):
                clients[name] = (module, _literal(_keyword(value, "base_url")) or "")
    for n in nodes:
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr in VERBS and isinstance(n.func.value, ast.Name) and n.func.value.id in clients:
            module, base = clients[n.func.value.id]
            url = _literal(n.args[0] if n.args else _keyword(n, "url"))
            yield Unresolved("httpclient") if url is None else service_call(module, n.func.attr, composed(base, url), (n.lineno, n.end_lineno))


# ------------------------------------------------------------------ languages that are scanned as tokens


def _by_name(found: Scanned, name: str) -> Definition | None:
    """The one function of the file with this name that isn't a method."""
    own = [d for d in found.definitions if d.name == name and d.kind == "Function"]
    return own[0] if len(own) == 1 else None


def _arguments(k, opens: int) -> list[tuple[int, int]]:
    """(first, last) token of each argument in brackets."""
    out, first, i = [], opens + 1, opens + 1
    while i < k.pair[opens]:
        if k.text[i] == "," and k.kind[i] == "mark":
            out.append((first, i - 1))
            first = i + 1
        i = k.after(i)
    return out + [(first, k.pair[opens] - 1)] if first < k.pair[opens] else out


def _string(k, span: tuple[int, int]) -> str | None:
    a, z = span
    return k.unquoted(a) if a == z and k.kind[a] == "string" and not ("${" in k.text[a] and k.text[a][0] == "`") else None


def _lines(k, a: int, z: int) -> tuple[int, int]:
    return k.line(a), k.line_of_end(min(z, len(k) - 1))


def _verb_calls(found: Scanned, verbs: set[str], dot: str = ".") -> Iterator[tuple[str, str, int, list[tuple[int, int]]]]:
    """(object, verb, token of the object, arguments) of calls like ``router.get(...)``."""
    k = found.tokens
    for i in range(2, len(k) - 1):
        if k.kind[i] == "name" and k.text[i] in verbs and k.text[i + 1] == "(" and k.text[i - 1] == dot and k.is_name(i - 2):
            yield k.text[i - 2], k.text[i], i - 2, _arguments(k, i + 1)


def _express(found: Scanned) -> Iterator[Fact | Unresolved]:
    k = found.tokens
    for owner, verb, at, args in _verb_calls(found, VERBS | {"all"}):
        if len(args) < 2 or k.t(at - 1) == ".":
            continue
        path = _string(k, args[0])
        if path is None:
            if re.search(r"(?i)(app|router|server)$", owner):
                yield Unresolved("express")
            continue
        if path[:1] not in ("/", "*"):
            continue
        a, z = args[-1]
        yield route("express", verb, path, _lines(k, at, k.pair[at + 3]), _by_name(found, k.text[a]) if a == z and k.is_name(a) else None, router_var=owner)


def _marks(k, d: Definition, sign: str) -> list[tuple[str, int]]:
    """(name, token) of the annotations right before and in the head of a definition: ``@Name(...)`` or ``[Name(...)]``."""
    first = d.first
    if sign == "@":
        while first > 0:
            j = k.before(first)
            j = j - 1 if k.text[j] == "(" and k.is_name(j - 1) else j
            if k.t(j) in ("export", "default", "abstract"):
                first = j
            elif k.is_name(j) and k.t(j - 1) == "@":
                first = j - 1
            else:
                break
    name = next((i for i in range(d.first, d.last + 1) if k.text[i] == d.name and k.is_name(i) and k.up[i] == k.up[d.first] and k.t(i + 1) in ("(", "{", "<", ":", "extends", "implements", "where")), d.last)
    out = []
    for i in range(first, name):
        if sign == "@" and k.text[i] == "@" and k.is_name(i + 1):
            out.append((k.text[i + 1], i + 1))
        elif sign == "[" and k.is_name(i) and k.up[i] >= 0 and k.text[k.up[i]] == "[" and k.t(i - 1) in ("[", ","):
            out.append((k.text[i], i))
    return out


def _first_text(k, at: int, names: tuple[str, ...] = ("value", "path")) -> str | None:
    """The string of an annotation at token ``at``: its first argument, or one of these named ones; empty without any, null if it isn't literal."""
    if k.t(at + 1) != "(":
        return ""
    args = _arguments(k, at + 1)
    plain = [a for a in args if not (k.is_name(a[0]) and k.t(a[0] + 1) in ("=", ":"))]
    named = [(a[0] + 2, a[1]) for a in args if k.is_name(a[0]) and k.t(a[0] + 1) == "=" and k.text[a[0]] in names]
    for a, z in plain + named:
        if k.text[a] in ("{", "[") and z == k.pair[a]:
            inner = _arguments(k, a)
            a, z = inner[0] if inner else (a, z)
        return _string(k, (a, z))
    return ""


def _nestjs(found: Scanned) -> Iterator[Fact | Unresolved]:
    k = found.tokens
    bases = {}
    for d in found.definitions:
        if d.kind == "Class":
            bases |= {id(d): _first_text(k, at) for name, at in _marks(k, d, "@") if name == "Controller"}
    for d in found.definitions:
        if d.kind != "Method" or id(d.parent) not in bases:
            continue
        for name, at in _marks(k, d, "@"):
            if name.lower() in VERBS | {"all"} and name[:1].isupper():
                base, path = bases[id(d.parent)], _first_text(k, at)
                yield Unresolved("nestjs") if base is None or path is None else route("nestjs", name, joined(base, path), _lines(k, at - 1, d.last), d)


_MAPPINGS = {f"{v.title()}Mapping": v for v in ("delete", "get", "patch", "post", "put")}


def _spring(found: Scanned) -> Iterator[Fact | Unresolved]:
    k = found.tokens
    bases: dict[int, str | None] = {}
    for d in found.definitions:
        if d.kind == "Class" and (marks := dict(_marks(k, d, "@"))).keys() & {"Controller", "RestController"}:
            bases[id(d)] = _first_text(k, marks["RequestMapping"]) if "RequestMapping" in marks else ""
    for d in found.definitions:
        if d.kind != "Method" or id(d.parent) not in bases:
            continue
        for name, at in _marks(k, d, "@"):
            if name not in _MAPPINGS and name != "RequestMapping":
                continue
            base, path = bases[id(d.parent)], _first_text(k, at)
            if base is None or path is None:
                yield Unresolved("spring")
                continue
            verbs = [_MAPPINGS[name]] if name in _MAPPINGS else [k.text[i] for i in range(at, k.pair[at + 1] if k.t(at + 1) == "(" else at) if k.is_name(i) and k.t(i - 1) == "." and k.t(i - 2) == "RequestMethod"] or ["GET"]
            for v in verbs:
                yield route("spring", v, joined(base, path), _lines(k, at - 1, d.last), d)


def _aspnet(found: Scanned) -> Iterator[Fact | Unresolved]:
    k = found.tokens
    bases: dict[int, str | None] = {}
    for d in found.definitions:
        marks = dict(_marks(k, d, "["))
        if d.kind == "Class" and (d.name.endswith("Controller") or "ApiController" in marks or any(b.startswith("Controller") for b in d.bases)):
            bases[id(d)] = _first_text(k, marks["Route"], ("template",)) if "Route" in marks else ""
    for d in found.definitions:
        if d.kind != "Method" or id(d.parent) not in bases:
            continue
        marks = _marks(k, d, "[")
        own = next((_first_text(k, at, ("template",)) for name, at in marks if name == "Route"), "")
        for name, at in marks:
            if name.startswith("Http") and name[4:].lower() in VERBS:
                base, path = bases[id(d.parent)], _first_text(k, at, ("template",)) or own
                if base is None or path is None:
                    yield Unresolved("aspnet")
                    continue
                whole = joined("" if path.startswith(("/", "~/")) else base, path.removeprefix("~"))
                whole = whole.replace("[controller]", d.parent.name.removesuffix("Controller")).replace("[action]", d.name)
                yield route("aspnet", name[4:], whole, _lines(k, at - 1, d.last), d)


def _gin(found: Scanned) -> Iterator[Fact | Unresolved]:
    k = found.tokens
    for owner, verb, at, args in _verb_calls(found, {v.upper() for v in VERBS} | {"Any"}):
        if len(args) < 2:
            continue
        path = _string(k, args[0])
        if path is None:
            yield Unresolved("gin")
            continue
        a, z = args[-1]
        yield route("gin", "ALL" if verb == "Any" else verb, path, _lines(k, at, k.pair[at + 3]), _by_name(found, k.text[a]) if a == z and k.is_name(a) else None, router_var=owner)


def _laravel(found: Scanned) -> Iterator[Fact | Unresolved]:
    k = found.tokens
    for owner, verb, at, args in _verb_calls(found, VERBS | {"any"}, "::"):
        if owner != "Route" or not args:
            continue
        path = _string(k, args[0])
        if path is None:
            yield Unresolved("laravel")
            continue
        cls = method = ""
        if len(args) > 1:
            a, z = args[1]
            if k.text[a] == "[" and (inner := _arguments(k, a)) and len(inner) == 2 and k.text[inner[0][1]] == "class":
                names = [k.text[i] for i in range(inner[0][0], inner[0][1]) if k.is_name(i)]
                cls, method = names[-1] if names else "", _string(k, inner[1]) or ""
            elif "@" in (named := _string(k, (a, z)) or ""):
                cls, _, method = named.replace("\\", "/").rpartition("/")[2].partition("@")
        yield route("laravel", "ALL" if verb == "any" else verb, joined("", path), _lines(k, at, k.pair[at + 3]), handler_class=cls, handler_method=method)


def camelized(name: str) -> str:
    return "".join(p[:1].upper() + p[1:] for p in name.split("_"))


def _rails(found: Scanned) -> Iterator[Fact | Unresolved]:
    """Explicit verbs and ``root`` of a routes file; resources and scopes are seen and counted."""
    k = found.tokens
    if "draw" not in k.text and "routes" not in k.text:
        return
    for i in range(len(k)):
        if k.kind[i] != "name" or k.t(i - 1) == "." or not (k.text[i] in VERBS or k.text[i] in ("root", "resources", "resource", "namespace", "scope", "match")):
            continue
        verb, line = k.text[i], k.line(i)
        if verb not in VERBS and verb != "root":
            yield Unresolved("rails")
            continue
        row = [j for j in range(i + 1, len(k)) if k.line(j) == line]
        texts = [k.unquoted(j) for j in row if k.kind[j] == "string"]
        named = next((t for t in texts if "#" in t), "")
        plain = [t for t in texts if "#" not in t]
        if verb != "root" and not plain:
            yield Unresolved("rails")
            continue
        where, _, method = named.partition("#")
        cls = "::".join(map(camelized, where.split("/"))) + "Controller" if where else ""
        yield route("rails", "get" if verb == "root" else verb, "/" if verb == "root" else joined("", plain[0]), (line, line), handler_class=cls.rpartition("::")[2], handler_method=method)


def _script_http(found: Scanned) -> Iterator[Fact | Unresolved]:
    k = found.tokens
    for i in range(len(k) - 1):
        if k.kind[i] != "name" or k.text[i + 1] != "(":
            continue
        axios = k.t(i - 1) == "." and k.t(i - 2) == "axios" and k.text[i] in VERBS
        if not axios and not (k.text[i] in ("axios", "fetch") and k.t(i - 1) not in (".", "function")):
            continue
        args = _arguments(k, i + 1)
        if not args:
            continue
        url, pack = _string(k, args[0]), "axios" if axios or k.text[i] == "axios" else "fetch"
        if url is None:
            yield Unresolved("jshttpclient")
            continue
        method = k.text[i]
        if not axios:
            method = "GET"
            if len(args) > 1 and k.text[args[1][0]] == "{":
                for j in range(*args[1]):
                    if k.text[j] in ("method", "'method'", '"method"') and k.t(j + 1) == ":" and k.kind[j + 2] == "string":
                        method = k.unquoted(j + 2)
        yield service_call(pack, method, url, _lines(k, i, k.pair[i + 1]))


def _pack(name: str, slugs: str, dependencies: str, markers: tuple[str, ...], extract: Callable[..., Iterator[Fact | Unresolved]]) -> FrameworkPack:
    return FrameworkPack(name, tuple(slugs.split()), tuple(dependencies.split()), markers, extract)


_python = lambda module: (f"import {module}", f"from {module}")
_node = lambda module: (f"'{module}'", f'"{module}"')
PACKS = {
    p.name: p
    for p in (
        _pack("fastapi", "py", "fastapi", _python("fastapi"), _fastapi),
        _pack("flask", "py", "flask", _python("flask"), _flask),
        _pack("sqlalchemy", "py", "sqlalchemy", _python("sqlalchemy"), _sqlalchemy),
        _pack("django", "py", "django", _python("django"), _django),
        _pack("httpclient", "py", "httpx requests", _python("requests") + _python("httpx"), _python_http),
        _pack("express", "js ts", "express", _node("express"), _express),
        _pack("nestjs", "ts", "@nestjs/common @nestjs/core", ("@nestjs/",), _nestjs),
        _pack("jshttpclient", "js ts", "axios node-fetch", ("axios", "fetch("), _script_http),
        _pack("spring", "java", "spring-boot-starter-web", ("org.springframework",), _spring),
        _pack("aspnet", "cs", "microsoft.aspnetcore", ("Microsoft.AspNetCore",), _aspnet),
        _pack("gin", "go", "github.com/gin-gonic/gin", ("github.com/gin-gonic/gin",), _gin),
        _pack("laravel", "php", "laravel/framework", ("Illuminate\\", "Route::"), _laravel),
        _pack("rails", "rb", "rails", ("Rails.application",), _rails),
    )
}
