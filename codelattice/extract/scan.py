"""Definitions, imports and calls of one file, by language.

Python files are parsed by the standard parser.  Other languages are scanned as tokens with matched brackets: a scanner
knows where its language may define something and finds the body, and everything else follows from containment.  Scanners
never fail; what they don't recognise is not reported.
"""

from __future__ import annotations

import ast
import re
import textwrap
from dataclasses import dataclass, field

from codelattice.extract.tokens import Tokens, cleaned_doc

OWNERS = {"Class", "Interface"}
CALLABLE = {"Function", "Method"}


@dataclass
class Definition:
    kind: str
    name: str
    first: int  # offsets, or token numbers, that contain what is inside
    last: int
    lines: tuple[int, int]
    signature: str = ""
    bases: list[str] = field(default_factory=list)
    doc: str = ""
    receiver: tuple[str, str] | None = None
    parent: "Definition | None" = None
    id: str = ""


@dataclass
class Import:
    module: str
    names: list[str]
    default: str
    line: int


@dataclass
class Call:
    name: str
    receiver: str | None
    line: int
    at: int
    owner: Definition | None = None


@dataclass
class Scanned:
    definitions: list[Definition] = field(default_factory=list)
    imports: list[Import] = field(default_factory=list)
    calls: list[Call] = field(default_factory=list)
    namespace: str = ""
    default_export: str = ""
    broken: bool = False
    tokens: Tokens | None = None
    tree: ast.AST | None = None

    def linked(self) -> "Scanned":
        """Parents, methods and owners of calls, by containment."""
        order = sorted(self.definitions, key=lambda d: (d.first, -d.last))
        stack: list[Definition] = []
        marks = sorted([(d.first, 0, -d.last, i) for i, d in enumerate(order)] + [(c.at, 1, 0, i) for i, c in enumerate(self.calls)])
        for place, what, _, i in marks:
            while stack and stack[-1].last < place:
                stack.pop()
            if what:
                self.calls[i].owner = stack[-1] if stack else None
                continue
            order[i].parent = stack[-1] if stack else None
            if order[i].kind == "Function" and stack and stack[-1].kind in OWNERS:
                order[i].kind = "Method"
            stack.append(order[i])
        self.definitions = order
        return self


# ------------------------------------------------------------------ Python


def scan_python(source: str) -> Scanned:
    out = Scanned()
    try:
        tree = out.tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return _scan_broken_python(source)
    rows = source.splitlines()
    starts = [0]
    for row in source.encode().split(b"\n"):
        starts.append(starts[-1] + len(row) + 1)
    offset = lambda line, col: starts[line - 1] + col
    data = source.encode()
    text = lambda n: data[offset(n.lineno, n.col_offset) : offset(n.end_lineno, n.end_col_offset)].decode(errors="replace")
    for n in ast.walk(tree):
        if isinstance(n, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            is_class = isinstance(n, ast.ClassDef)
            d = Definition("Class" if is_class else "Function", n.name, offset(n.lineno, n.col_offset), offset(n.end_lineno, n.end_col_offset) - 1, (n.lineno, n.end_lineno), rows[n.lineno - 1].strip())
            if is_class:
                d.bases = [text(b) for b in n.bases if isinstance(b, (ast.Name, ast.Attribute))]
            head = n.body[0] if n.body else None
            if isinstance(head, ast.Expr) and isinstance(head.value, ast.Constant) and isinstance(head.value.value, str):
                d.doc = textwrap.dedent(re.sub(r"^[a-zA-Z]{0,2}('''|\"\"\"|'|\")(.*)\1$", r"\2", text(head.value), flags=re.S)).strip()
            out.definitions.append(d)
        elif isinstance(n, ast.Import):
            out.imports += [Import(a.name, [], a.asname or "", n.lineno) for a in n.names]
        elif isinstance(n, ast.ImportFrom) and (n.module != "__future__" or n.level):
            out.imports += [Import("." * n.level + (n.module or ""), [a.name], "", n.lineno) for a in n.names if a.name != "*"]
        elif isinstance(n, ast.Call) and isinstance(n.func, (ast.Name, ast.Attribute)):
            bare = isinstance(n.func, ast.Name)
            out.calls.append(Call(n.func.id if bare else n.func.attr, None if bare else text(n.func.value), n.lineno, offset(n.lineno, n.col_offset)))
    out.calls.sort(key=lambda c: c.at)
    out.imports.sort(key=lambda i: i.line)
    return out.linked()


_HEADER = re.compile(r"^([ \t]*)(?:async[ \t]+)?(class|def)[ \t]+(\w+)", re.M)


def _scan_broken_python(source: str) -> Scanned:
    """Headers and indentation of a file that doesn't parse."""
    out, rows = Scanned(broken=True), source.split("\n")
    starts = [0]
    for row in rows:
        starts.append(starts[-1] + len(row) + 1)
    for m in _HEADER.finditer(source):
        line = source.count("\n", 0, m.start()) + 1
        wide, last = len(m[1].expandtabs()), line
        for k in range(line, len(rows)):
            if rows[k].strip():
                if len(rows[k]) - len(rows[k].lstrip()) <= wide:
                    break
                last = k + 1
        out.definitions.append(Definition("Class" if m[2] == "class" else "Function", m[3], m.start() + len(m[1]), starts[last] - 1, (line, last), rows[line - 1].strip()))
    return out.linked()


# ------------------------------------------------------------------ what the brace languages share


class _Scanner:
    language = ""
    #: Words that look like calls when a bracket follows.
    WORDS: frozenset[str] = frozenset()
    DOTS = (".",)

    def __init__(self, source: str) -> None:
        self.k = Tokens(source, self.language)
        self.out = Scanned()
        self.named: set[int] = set()  # tokens that name a definition, so no calls
        self.bodies: set[int] = set()  # brackets whose members are declarations

    def define(self, kind: str, name: int, first: int, last: int, **more: object) -> Definition:
        k = self.k
        first, last = max(first, 0), min(max(last, name), len(k) - 1)
        head = k.source[k.at[first] : k.end[last]].split("\n", 1)[0].strip()
        d = Definition(kind, k.t(name).removeprefix("r#"), first, last, (k.line(first), k.line_of_end(last)), head, **more)  # type: ignore[arg-type]
        self.named.add(name)
        self.out.definitions.append(d)
        return d

    def statement(self, i: int) -> int:
        """The first token of the statement or member that token i is in, at its level."""
        k, up = self.k, self.k.up[i]
        j = i
        while (b := j - 1) >= 0:
            if b == up or k.t(b) in (";", "{", "}") and k.kind[b] == "mark" and (k.t(b) != "}" or k.up[b] == up):
                break
            j = k.pair[b] if k.t(b) in (")", "]") and k.pair[b] < b else b
        return j

    def body(self, i: int, stop: str = ";") -> int:
        return self.k.seek(i, "{", stop)

    def calls(self) -> None:
        k = self.k
        for i in range(len(k) - 1):
            if k.kind[i] == "name" and k.text[i + 1] == "(" and i not in self.named and k.text[i] not in self.WORDS and not self.skipped(i) and not self._declared(i):
                dotted = k.t(i - 1) in self.DOTS and k.kind[i - 1] == "mark"
                receiver = k.receiver(i - 1) if dotted else None
                if dotted and not self.receiver_counts(receiver):
                    continue
                first = k.at[i] - len(receiver) if receiver else k.at[i]
                self.out.calls.append(Call(k.text[i], receiver, k.source.count("\n", 0, max(0, first)) + 1 if receiver and "\n" in receiver else k.line(i), i))

    def _declared(self, i: int) -> bool:
        """Whether token i names a member without a body."""
        k = self.k
        return k.up[i] in self.bodies and not any(k.text[x] in ("=", "=>") for x in range(self.statement(i), i) if k.up[x] == k.up[i])

    def skipped(self, i: int) -> bool:
        return self.k.t(i - 1) in ("new", "function", "fn", "func", "def")

    def receiver_counts(self, receiver: str) -> bool:
        return True

    def structure(self) -> None:
        raise NotImplementedError

    def run(self) -> Scanned:
        self.out.tokens = self.k
        if len(self.k):
            self.structure()
            self.calls()
        return self.out.linked()


# ------------------------------------------------------------------ JavaScript and TypeScript


class _Script(_Scanner):
    language = "js"
    DOTS = (".", "?.")
    WORDS = frozenset("if for while switch catch return typeof await yield void delete function super import with do else case throw in of instanceof new async constructor".split())

    def structure(self) -> None:
        k = self.k
        self.docs: list[tuple[int, int]] = []
        for i in range(len(k)):
            if k.kind[i] != "name" or k.t(i - 1) in (".", "?."):
                continue
            word, after = k.text[i], k.t(i + 1)
            if word == "class" and k.is_name(i + 1):
                self._class(i)
            elif word == "function" and k.is_name(i + 1) and self._starts(i):
                first = i - 1 if k.t(i - 1) == "async" else i
                opens = self.body(k.after(i + 2), "; }")
                self._doc(self.define("Function", i + 1, first, k.pair[opens] if opens > 0 else i + 1), first)
            elif word in ("const", "let"):
                self._constants(i)
            elif word == "import" and after != "(":
                self._import(i)
            elif word == "require" and after == "(" and k.kind[i + 2 : i + 3] == ["string"]:
                self._require(i)
            elif word in ("module", "exports") and after in (".", "="):
                self._exports(i)
            elif (after == "(" or after == "<" and self.language == "ts" and self._parameters(i) > 0) and word not in self.WORDS - {"constructor", "catch", "delete", "import", "with", "of", "async"}:
                self._method(i)
            elif self.language == "ts" and k.is_name(i + 1) and self._starts(i):
                if word in ("interface", "enum"):
                    opens = self.body(i + 2)
                    if opens > 0:
                        self.bodies.add(opens)
                        self.define("Interface" if word == "interface" else "Class", i + 1, i, k.pair[opens])
                elif word == "type" and k.t(k.after(i + 2) if k.t(i + 2) == "<" else i + 2) in ("=", "<"):
                    end = k.seek(i + 2, ";")
                    self.define("TypeAlias", i + 1, i, end if end > 0 else i + 2)

    def _starts(self, i: int) -> bool:
        """Whether a declaration, rather than an expression, can begin here."""
        before = self.k.t(i - 1)
        return i == 0 or before in (";", "{", "}", ")", "export", "default", "async", "declare", "abstract", "const") or (self.k.kind[i - 1] in ("name", "string", "number") and before not in self.WORDS and self.k.line(i - 1) < self.k.line(i)) or before == "]"

    def _doc(self, d: Definition, first: int) -> None:
        if text := self.k.doc.get(first):
            d.doc = cleaned_doc(text)

    def _class(self, i: int) -> None:
        k = self.k
        if not self._starts(i):
            return
        first = i - 1 if k.t(i - 1) == "abstract" else i
        opens = self.body(i + 1)
        if opens < 0:
            return
        bases, j = [], i + 2
        while j < opens:
            if k.text[j] == "extends":
                end = j + 2
                while k.t(end) == "." and k.is_name(end + 1):
                    end += 2
                if k.is_name(j + 1) and k.t(end) in ("{", "implements", "<") and (end == opens or k.t(end) != "("):
                    bases.append("".join(k.text[j + 1 : end]))
                break
            j += 1
        self.bodies.add(opens)
        self._doc(self.define("Class", i + 1, first, k.pair[opens], bases=bases), first)

    def _parameters(self, i: int) -> int:
        """The bracket after a name and its type parameters, or -1."""
        k, deep = self.k, 0
        for j in range(i + 1, min(i + 60, len(k))):
            deep += (k.text[j] == "<") - (k.text[j] == ">")
            if not deep:
                return j + (k.text[j] == ">") if k.t(j + (k.text[j] == ">")) == "(" else -1
        return -1

    def _method(self, i: int) -> None:
        k, up = self.k, self.k.up[i]
        opened = self._parameters(i)
        if up < 0 or opened < 0 or k.text[up] != "{" or k.t(i - 1) in ("function", "new", "=", "(", "=>", "&&", "||", "!", "?", ":", "+", "-", "return", "await"):
            return
        close = k.pair[opened]
        opens = close + 1
        if k.t(opens) == ":" and self.language == "ts":
            opens = self._after_type(opens + 1)
        if k.t(opens) != "{":
            return
        first = i
        while k.t(first - 1) in ("async", "get", "set", "static", "*", "public", "private", "protected", "readonly", "override") and first - 1 > up:
            first -= 1
        d = self.define("Function", i, first, k.pair[opens])
        self._doc(d, first)

    def _after_type(self, i: int) -> int:
        """Past a type annotation, to the bracket of a body."""
        k, up = self.k, self.k.up[i]
        while i < len(k) and k.up[i] == up and k.text[i] not in (";", "=>"):
            if k.text[i] == "{" and k.t(i - 1) not in (":", "|", "&", "<", ","):
                return i
            i = k.after(i)
        return i

    def _constants(self, i: int) -> None:
        k = self.k
        if not k.is_name(i + 1) or k.text[i + 1] == "enum":
            return
        equals = k.seek(i + 2, "=", "; of in")
        if equals < 0 or equals > i + 2 and k.t(i + 2) != ":":
            return
        value = equals + 1
        start = value + 1 if k.t(value) == "async" else value
        end = k.seek(value, ";")
        made = None
        if k.t(start) == "function":
            opens = self.body(start)
            made = ("Function", k.pair[opens] if opens > 0 else start)
        elif k.t(start) == "(" or k.is_name(start) and k.t(start + 1) == "=>":
            arrow = k.after(start)
            if k.t(arrow) == ":" and self.language == "ts":
                arrow = k.seek(arrow, "=>", "; =")
            if arrow > 0 and k.t(arrow) == "=>":
                last = k.pair[arrow + 1] if k.t(arrow + 1) in ("{", "(", "[") else max(end - 1, arrow + 1)
                made = ("Function", last)
        elif k.t(value) in ("{", "[") and k.up[i] < 0:
            made = ("Variable", k.pair[value])
        if made:
            last = made[1] + 1 if k.t(made[1] + 1) == ";" else made[1]
            self.define(made[0], i + 1, i, last)

    def _import(self, i: int) -> None:
        k = self.k
        j, names, default = i + 1, [], ""
        while j < len(k) and k.kind[j] != "string" and k.text[j] != ";":
            if k.text[j] == "{":
                x = j + 1
                while x < k.pair[j]:
                    if k.is_name(x) and k.t(x - 1) in ("{", ",", "type"):
                        if k.text[x] != "type" or not k.is_name(x + 1):
                            names.append(k.text[x])
                    x += 1
                j = k.pair[j]
            elif k.text[j] == "*" and k.t(j + 1) == "as":
                default = k.t(j + 2)
            j += 1
        if j < len(k) and k.kind[j] == "string":
            self.out.imports += [Import(k.unquoted(j), [n], "", k.line(i)) for n in names]
            if default:
                self.out.imports.append(Import(k.unquoted(j), [], default, k.line(i)))

    def _require(self, i: int) -> None:
        k = self.k
        if self.language != "js" or k.t(i - 1) != "=" or k.t(k.pair[i + 1] + 1) in (".", "("):
            return
        module, line = k.unquoted(i + 2), k.line(i)
        if k.t(i - 2) == "}":
            opens = k.pair[i - 2]
            self.out.imports += [Import(module, [k.text[x]], "", line) for x in range(opens + 1, i - 2) if k.is_name(x) and k.t(x - 1) in ("{", ",") and k.t(x + 1) in ("}", ",")]
        elif k.is_name(i - 2):
            self.out.imports.append(Import(module, [], k.text[i - 2], line))

    def _exports(self, i: int) -> None:
        k = self.k
        if self.language != "js":
            return
        whole = k.text[i] == "module" and k.t(i + 2) == "exports"
        if k.text[i] == "module" and not whole:
            return
        j = i + 3 if whole else i + 1
        if k.t(j) == ".":
            name, j = j + 1, j + 2
            if k.t(j) == "=" and self._is_function(j + 1):
                self.define("Function", name, j + 1, self._function_end(j + 1))
        elif whole and k.t(j) == "=":
            if k.t(j + 1) == "function" and k.is_name(j + 2):
                self.define("Function", j + 2, j + 1, self._function_end(j + 1))
                self.out.default_export = k.text[j + 2]
            elif k.is_name(j + 1) and k.t(j + 2) not in (".", "(", "=>"):
                self.out.default_export = k.text[j + 1]
            elif k.t(j + 1) == "{":
                for x in range(j + 2, k.pair[j + 1]):
                    if k.up[x] == j + 1 and k.is_name(x) and k.t(x + 1) == ":" and self._is_function(x + 2):
                        self.define("Function", x, x + 2, self._function_end(x + 2))

    def _is_function(self, i: int) -> bool:
        i += self.k.t(i) == "async"
        return self.k.t(i) == "function" or self.k.t(i) == "(" and self.k.t(self.k.pair[i] + 1) == "=>" or self.k.is_name(i) and self.k.t(i + 1) == "=>"

    def _function_end(self, i: int) -> int:
        k = self.k
        i += k.t(i) == "async"
        if k.t(i) == "function":
            opens = self.body(i, "; ,")
            return k.pair[opens] if opens > 0 else i
        arrow = k.after(i)
        return k.pair[arrow + 1]


class _TypedScript(_Script):
    language = "ts"


# ------------------------------------------------------------------ Go


class _Go(_Scanner):
    language = "go"
    WORDS = frozenset("if for switch select return func go defer range case type struct interface map chan var const import package else".split())

    def structure(self) -> None:
        k = self.k
        for i in range(len(k)):
            if k.kind[i] != "name":
                continue
            word = k.text[i]
            if word == "func" and k.up[i] < 0 and (i == 0 or k.line(i - 1) < k.line(i) or k.t(i - 1) in (";", "}")):
                method = k.t(i + 1) == "("
                name = k.pair[i + 1] + 1 if method else i + 1
                if not k.is_name(name):
                    continue
                opens = self._body(name + 1)
                receiver = None
                if method:
                    inside = [k.text[x] for x in range(i + 2, k.pair[i + 1]) if k.kind[x] == "name"]
                    if len(inside) == 2 and k.t(k.pair[i + 1] - 1) != "]":
                        receiver = (inside[0], inside[1])
                self.define("Method" if method else "Function", name, i, k.pair[opens] if opens > 0 else name, receiver=receiver)
            elif word == "type" and k.t(i - 1) not in (".", "("):
                for x in self._specs(i + 1):
                    self._type(x)
            elif word in ("const", "var") and k.up[i] < 0:
                for x in self._specs(i + 1):
                    self._values(x)
            elif word == "import" and k.up[i] < 0:
                for x in self._specs(i + 1):
                    at = x if k.kind[x] == "string" else x + 1
                    if at < len(k) and k.kind[at] == "string" and k.text[at].startswith('"'):
                        self.out.imports.append(Import(k.unquoted(at), [], "", k.line(at)))

    def _body(self, i: int) -> int:
        """The block of a function: the last bracket on its header, past results such as ``struct{}`` and ``interface{}``."""
        k, up = self.k, self.k.up[i] if i < len(self.k) else -1
        while i < len(k) and k.up[i] == up:
            if k.text[i] == "{" and k.t(i - 1) not in ("struct", "interface"):
                return i
            if k.text[i] == "func" or (k.line(i) > k.line(i - 1) and k.text[i] != "{"):
                return -1
            i = k.after(i)
        return -1

    def _specs(self, i: int) -> list[int]:
        k = self.k
        if k.t(i) != "(":
            return [i] if i < len(k) else []
        inside = [x for x in range(i + 1, k.pair[i]) if k.up[x] == i]
        return [x for n, x in enumerate(inside) if n == 0 or k.line(inside[n - 1]) < k.line(x) and k.line_of_end(x - 1) < k.line(x) or k.t(x - 1) == ";"]

    def _type(self, i: int) -> None:
        k = self.k
        if not k.is_name(i):
            return
        j = i + 1
        if k.t(j) == "[" and k.is_name(j + 1) and k.pair[j] > j + 2:  # type parameters
            j = k.pair[j] + 1
        if k.t(j) in ("struct", "interface") and k.t(j + 1) == "{":
            self.bodies.add(j + 1)
            self.define("Class" if k.text[j] == "struct" else "Interface", i, i, k.pair[j + 1])
        elif j < len(k) and k.line(j) == k.line(i):
            end = j
            while end + 1 < len(k) and k.line(end + 1) == k.line(i) and k.up[end + 1] >= k.up[i] and k.t(end + 1) != ";" and not (k.t(end + 1) == ")" and k.pair[end + 1] < i):
                end += 1
            self.define("TypeAlias", i, i, end)

    def _values(self, i: int) -> None:
        k, line = self.k, self.k.line(i)
        names = []
        j = i
        while k.is_name(j):
            names.append(j)
            if k.t(j + 1) != ",":
                break
            j += 2
        last = j
        while last + 1 < len(k) and k.up[last + 1] == k.up[i] and k.line(last + 1) == line:
            last = k.pair[last + 1] if k.pair[last + 1] > last + 1 else last + 1
            line = k.line_of_end(last)
        for n in names:
            if k.text[n] != "_":
                self.define("Variable", n, *((n, n) if len(names) > 1 else (i, last)))

    def receiver_counts(self, receiver: str) -> bool:
        return receiver.isidentifier()


# ------------------------------------------------------------------ Java and C#


class _Managed(_Scanner):
    TYPES: dict[str, str] = {}
    MODIFIERS = frozenset("public private protected internal static final abstract sealed partial readonly async override virtual unsafe extern synchronized native default strictfp new".split())

    def structure(self) -> None:
        k = self.k
        self.types: dict[int, str] = {}
        for i in range(len(k)):
            if k.kind[i] != "name":
                continue
            word = k.text[i]
            if word in self.TYPES and k.is_name(i + 1) and k.t(i - 1) not in (".", "::") and not self._within_type_arguments(i):
                self._type(i)
            elif k.t(i + 1) == "(" and k.up[i] in self.types and k.text[i] not in self.WORDS and i not in self.named:
                self._method(i)
            else:
                self.other(i)

    def _within_type_arguments(self, i: int) -> bool:
        return self.k.up[i] >= 0 and self.k.text[self.k.up[i]] in ("(", "[")

    def _type(self, i: int) -> None:
        k = self.k
        name = i + 1
        if k.text[i] == "record" and k.t(name) in ("class", "struct"):
            name += 1
        if k.text[i] in ("class", "struct") and k.t(i - 1) == "record":
            return
        opens = self.body(name)
        end = k.seek(name, ";", "{")
        if k.text[i] == "record" and (k.t(name + 1) not in ("(", "<", "{", ":", ";")):
            return
        if opens < 0 and not (k.text[i] == "record" and end > 0):
            return
        first = self.statement(i)
        d = self.define(self.TYPES[k.text[i]], name, first, k.pair[opens] if opens > 0 else end)
        if opens > 0:
            self.types[opens] = k.text[name]
            self.bodies.add(opens)
        if k.text[i] == "class":
            d.bases = self.bases(name, opens)

    def _method(self, i: int) -> None:
        k = self.k
        owner, first = self.types[k.up[i]], self.statement(i)
        if any(k.t(x) == "=" for x in range(first, i) if k.up[x] == k.up[i]) or k.t(i - 1) in ("@", "new", ".", "&", "|", "+", ",", "=", "~", "operator"):
            return
        typed = [x for x in range(first, i) if k.kind[x] == "name" and k.up[x] == k.up[i] and k.text[x] not in self.MODIFIERS and k.t(x - 1) != "@"]
        if not typed and k.text[i] != owner:
            return
        close = k.pair[i + 1]
        after = k.t(close + 1)
        if after == "{":
            last = k.pair[close + 1]
        elif after == ";":
            last = close + 1
        elif after in ("throws", "where", ":", "=>", "default", "["):
            opens, end = self.body(close + 1), k.seek(close + 1, ";")
            last = k.pair[opens] if opens > 0 and (end < 0 or opens < end or after == "where") and after != "=>" else end
            if last < 0:
                return
        else:
            return
        self.define("Function", i, first, last)

    def skipped(self, i: int) -> bool:
        k, up = self.k, self.k.up[i]
        attribute = up >= 0 and k.text[up] == "[" and self.language == "cs" and k.t(up - 1) in ("{", "}", ";", "]", ",", "(", "")
        return super().skipped(i) or k.t(i - 1) == "@" or attribute

    def bases(self, name: int, opens: int) -> list[str]:
        return []

    def other(self, i: int) -> None:
        return None


class _Java(_Managed):
    language = "java"
    TYPES = {"class": "Class", "interface": "Interface", "enum": "Class", "record": "Class"}
    WORDS = frozenset("if for while switch catch return synchronized try super this new assert do else throw instanceof".split())

    def bases(self, name: int, opens: int) -> list[str]:
        k = self.k
        for j in range(name + 1, opens):
            if k.text[j] == "extends" and k.up[j] == k.up[name]:
                return [k.text[j + 1]] if k.t(j + 2) in ("{", "implements", "permits") else []
        return []

    def other(self, i: int) -> None:
        k = self.k
        if k.text[i] in ("import", "package") and k.up[i] < 0:
            j = i + 1 + (k.t(i + 1) == "static")
            end = k.seek(j, ";")
            parts = k.text[j:end] if end > 0 else []
            if len(parts) > 1 and all(p == "." or p.isidentifier() for p in parts if p != "*"):
                name = "".join(parts).removesuffix(".*")
                if "." in name:
                    if k.text[i] == "package":
                        self.out.namespace = name
                    else:
                        self.out.imports.append(Import(name, [], "", k.line(i)))


class _CSharp(_Managed):
    language = "cs"
    DOTS = (".",)
    TYPES = {"class": "Class", "interface": "Interface", "struct": "Class", "enum": "Class", "record": "Class"}
    WORDS = frozenset("if for foreach while switch catch return lock using fixed typeof sizeof nameof base this new when do else throw is as in checked unchecked default await stackalloc".split()) - {"nameof"}

    def bases(self, name: int, opens: int) -> list[str]:
        k = self.k
        colon = k.seek(name + 1, ":", "{ where")
        if colon < 0:
            return []
        found, j = [], colon + 1
        while j < opens and k.text[j] != "where":
            if k.is_name(j) and k.t(j - 1) in (":", ",") and k.t(j + 1) in (",", "{", "where"):
                found.append(k.text[j])
            j += 1
        return found

    def other(self, i: int) -> None:
        k = self.k
        if k.text[i] in ("using", "namespace") and k.is_name(i + 1):
            j = i + 1 + (k.t(i + 1) == "static")
            end = j
            while k.is_name(end) and k.t(end + 1) == "." and k.is_name(end + 2):
                end += 2
            name = "".join(k.text[j : end + 1])
            if k.text[i] == "namespace" and k.t(end + 1) in (";", "{"):
                self.out.namespace = name
            elif k.text[i] == "using" and k.t(end + 1) == ";":
                self.out.imports.append(Import(name, [], "", k.line(i)))


# ------------------------------------------------------------------ PHP


class _Php(_Scanner):
    language = "php"
    DOTS = ("->", "::", "?->")
    WORDS = frozenset("if for foreach while switch catch return function fn new array list isset unset empty echo print exit die include require match elseif and or declare use abstract".split())

    def structure(self) -> None:
        k = self.k
        for i in range(len(k)):
            if k.kind[i] != "name":
                continue
            word = k.text[i].lower()
            if word in ("class", "interface", "trait", "enum") and k.is_name(i + 1) and k.t(i - 1) not in ("::", "->", "new") and not k.t(i + 1).startswith("$"):
                opens = self.body(i + 2)
                if opens > 0:
                    bases = []
                    if word == "class" and k.t(i + 2) == "extends" and k.t(i + 4) in ("{", "implements"):
                        bases = [k.text[i + 3]]
                    first = i
                    while k.t(first - 1) in ("abstract", "final", "readonly"):
                        first -= 1
                    self.define("Interface" if word == "interface" else "Class", i + 1, first, k.pair[opens], bases=bases)
            elif word == "function":
                name = i + 1 + (k.t(i + 1) == "&")
                if k.is_name(name) and k.t(name + 1) == "(":
                    opens, end = self.body(k.pair[name + 1] + 1), k.seek(k.pair[name + 1] + 1, ";", "{")
                    first = i
                    while k.t(first - 1) in ("public", "private", "protected", "static", "abstract", "final"):
                        first -= 1
                    self.define("Function", name, first, k.pair[opens] if opens > 0 else max(end, name))
            elif word == "const" and k.t(i - 1) != "use":
                j = i + 1
                while k.is_name(j + 1) and k.t(j + 1) != "=":  # a typed constant
                    j += 1
                while k.is_name(j) and k.t(j + 1) == "=":
                    end, comma = k.seek(j, ";"), k.seek(j, ",", ";")
                    last = comma - 1 if comma > 0 else end - 1
                    self.define("Variable", j, j, last)
                    if comma < 0:
                        break
                    j = comma + 1
            elif word == "namespace" and k.is_name(i + 1):
                self.out.namespace = self._path(i + 1)[0]
            elif word == "use" and k.up[i] < 0 or word == "use" and self.out.namespace and self._in_namespace(i):
                j = i + 1
                while j < len(k):
                    j += k.t(j) in ("function", "const")
                    j += k.t(j) == "\\"
                    name, end = self._path(j)
                    if "\\" in name and k.t(end) != "\\" and k.t(end) != "{":
                        self.out.imports.append(Import(name, [], "", k.line(i)))
                    comma = k.seek(end, ",", ";") if end < len(k) else -1
                    if comma < 0:
                        break
                    j = comma + 1

    def _in_namespace(self, i: int) -> bool:
        up = self.k.up[i]
        return up >= 0 and self.k.up[up] < 0 and "namespace" in self.k.text[max(0, up - 12) : up]

    def _path(self, i: int) -> tuple[str, int]:
        k, j = self.k, i
        while k.is_name(j) and k.t(j + 1) == "\\" and k.is_name(j + 2):
            j += 2
        return "".join(k.text[i : j + 1]), j + 1

    def skipped(self, i: int) -> bool:
        return super().skipped(i) or self.k.text[i].startswith("$") or self.k.t(i - 1) == "\\"


# ------------------------------------------------------------------ C++


class _Cpp(_Scanner):
    language = "cpp"
    DOTS = (".", "->")
    WORDS = frozenset("if for while switch catch return sizeof decltype alignof noexcept static_assert new delete throw else do case defined operator typeid static_cast dynamic_cast reinterpret_cast const_cast requires explicit alignas".split())
    _FOLLOW = {"const", "noexcept", "override", "final", "volatile", "&", "&&", "->", "mutable", "try"}

    def structure(self) -> None:
        k = self.k
        types: set[int] = set()
        scopes = self.bodies = {-1}
        for i in range(len(k)):
            kind, word = k.kind[i], k.text[i]
            if kind == "line":
                if m := re.match(r"\s*#\s*include\s*\"([^\"]+)\"", word):
                    self.out.imports.append(Import(m[1], [], "", k.line_of_end(i)))
            elif kind == "mark" and word == "{" and (k.t(i - 1) == "namespace" or k.t(i - 2) == "namespace" or (k.kind[i - 1] == "string" and k.t(i - 2) == "extern") or self._nested_namespace(i)):
                scopes.add(i)
            elif kind != "name":
                continue
            elif word in ("class", "struct", "enum") and k.t(i - 1) not in ("enum", "<", ",", "friend") and not (k.up[i] >= 0 and k.text[k.up[i]] == "("):
                name = i + 1 + (word == "enum" and k.t(i + 1) in ("class", "struct"))
                while k.is_name(name) and k.is_name(name + 1) and k.t(name + 1) not in ("final",) and k.t(name + 2) in ("{", ":", ";", "final"):
                    name += 1  # an export macro
                if not k.is_name(name):
                    continue
                after = name + 1 + (k.t(name + 1) == "final")
                opens = self.body(after) if k.t(after) in ("{", ":") else -1
                if opens > 0:
                    self.define("Class", name, i, k.pair[opens])
                    if word != "enum":
                        types.add(opens)
                        self.bodies.add(opens)
                elif k.t(after) == ";":
                    self.define("Class", name, i, name)
            elif k.t(i + 1) == "(" and (k.up[i] in types or k.up[i] in scopes) and word not in self.WORDS:
                self._function(i, k.up[i] in types)

    def _nested_namespace(self, i: int) -> bool:
        j = i - 1
        while j > 0 and (self.k.is_name(j) or self.k.t(j) == "::") and self.k.t(j) != "namespace":
            j -= 1
        return self.k.t(j) == "namespace"

    def _function(self, i: int, in_class: bool) -> None:
        k = self.k
        first = self.statement(i)
        while first < i and (k.kind[first] == "line" or k.t(first) in ("public", "private", "protected") or k.t(first) == ":" and k.t(first - 1) in ("public", "private", "protected")):
            first += 1
        if k.t(i - 1) == "~" or any(k.t(x) in ("=", "operator", "return", "typedef", "using", "#") for x in range(first, i) if k.up[x] == k.up[i]):
            return
        qualified = k.t(i - 1) == "::"
        if first == i and not in_class and not qualified:
            return  # a macro call
        j = k.pair[i + 1] + 1
        while j < len(k) and (k.t(j) in self._FOLLOW or k.t(j) == "(" or k.t(j - 1) == "->" or k.is_name(j) and k.t(j - 1) in ("->", "::") or k.t(j) == "::"):
            j = k.after(j)
        if k.t(j) == "{":
            last = k.pair[j]
        elif k.t(j) == ":":
            x, opens = j, -1
            while (x := k.seek(x + 1, "{", ";")) > 0:  # braces of member initialisers come after a name
                if not k.is_name(x - 1):
                    opens = x
                    break
                x = k.pair[x]
            last = k.pair[opens] if opens > 0 else j
        elif k.t(j) == ";" or k.t(j) == "=" and k.t(j + 1) in ("0", "default", "delete"):
            if qualified or first == i and k.t(j) == ";" and not in_class:
                return
            last = k.seek(j, ";")
        else:
            return
        self.define("Function", i, first, last)

    def skipped(self, i: int) -> bool:
        k = self.k
        return super().skipped(i) or k.t(i - 1) in ("::", "~", ">") or k.is_name(i - 1) and k.t(i - 1) not in ("return", "else", "do", "case", "throw", "co_return", "co_await", "and", "or", "not")


# ------------------------------------------------------------------ Rust


class _Rust(_Scanner):
    language = "rs"
    WORDS = frozenset("if for while match return fn loop let in as move unsafe impl struct enum trait where use pub else mut ref".split())

    def structure(self) -> None:
        k = self.k
        self.macros: list[tuple[int, int]] = [(i + 1, k.pair[i + 1]) for i in range(1, len(k) - 1) if k.text[i] == "!" and k.is_name(i - 1) and k.text[i + 1] in ("(", "[", "{")]
        for i in range(len(k)):
            if k.kind[i] != "name" or self._in_macro(i):
                continue
            word = k.text[i]
            if word == "fn" and k.is_name(i + 1):
                opens, end = self.body(i + 2), k.seek(i + 2, ";", "{")
                self.define("Function", i + 1, self._first(i), k.pair[opens] if opens > 0 else max(end, i + 1))
            elif word in ("struct", "enum", "union", "trait") and k.is_name(i + 1) and k.t(i - 1) not in (".", "::"):
                opens, end = self.body(i + 2), k.seek(i + 2, ";", "{")
                if opens > 0 or end > 0:
                    self.define("Interface" if word == "trait" else "Class", i + 1, self._first(i), k.pair[opens] if opens > 0 else end)
            elif word == "impl" and k.t(i - 1) not in ("->", ":", "(", ",", "<", "&", "="):
                opens = self.body(i + 1)
                if opens < 0:
                    continue
                where = next((x for x in range(i + 1, opens) if k.text[x] == "where"), opens)
                after = next((x for x in range(i + 1, where) if k.text[x] == "for" and k.t(x + 1) != "<"), None)
                name = after + 1 if after is not None else where - 1
                if k.is_name(name) and name == where - 1 and k.t(name - 1) != "::":
                    self.define("Class", name, i, k.pair[opens])
            elif word in ("const", "static") and k.t(i + 1) != "fn":
                name = i + 1 + (k.t(i + 1) == "mut")
                if k.is_name(name) and k.t(name + 1) == ":" and k.t(name) != "_":
                    self.define("Variable", name, self._first(i), k.seek(name, ";"))
            elif word == "type" and k.is_name(i + 1) and k.seek(i + 2, "=", ";") > 0:
                self.define("TypeAlias", i + 1, self._first(i), k.seek(i + 2, ";"))
            elif word == "use":
                end = k.seek(i + 1, ";")
                parts = k.text[i + 1 : end] if end > 0 else []
                if len(parts) > 2 and all(p == "::" or k.kind[i + 1 + n] == "name" for n, p in enumerate(parts)) and "as" not in parts and "::" in parts:
                    self.out.imports.append(Import("".join(parts), [], "", k.line(i)))

    def _first(self, i: int) -> int:
        k = self.k
        while k.t(i - 1) in ("pub", "async", "unsafe", "const", "default") or k.t(i - 1) == ")" and k.t(k.pair[i - 1] - 1) == "pub":
            i = k.pair[i - 1] - 1 if k.t(i - 1) == ")" else i - 1
        return i

    def _in_macro(self, i: int) -> bool:
        return any(a < i < z for a, z in self.macros)

    def skipped(self, i: int) -> bool:
        return super().skipped(i) or self.k.t(i - 1) in ("::", "#") or self.k.text[i].startswith("'") or self._in_macro(i)


# ------------------------------------------------------------------ Ruby


class _Ruby(_Scanner):
    language = "rb"
    DOTS = (".", "&.")
    WORDS = frozenset("if unless while until case when then else elsif end def class module do begin rescue ensure return yield and or not in self super nil true false defined? alias undef next break redo retry BEGIN END for".split())
    _BLOCKS = {"class", "module", "def", "begin", "case", "if", "unless", "while", "until", "for", "do"}

    def structure(self) -> None:
        k = self.k
        stack: list[tuple[str, int]] = []
        loop_line = -1
        self.ends: dict[int, int] = {}
        for i in range(len(k)):
            if k.kind[i] != "name" or k.t(i - 1) in (".", "&.", "::") or k.t(i - 1) == ":" and k.t(i - 2) != "?" and k.at[i] == k.end[i - 1] or k.t(i + 1) == ":" and k.t(i + 2) != ":" and i + 1 < len(k) and k.at[i + 1] == k.end[i]:
                continue
            word = k.text[i]
            if word == "end" and stack:
                self.ends[stack.pop()[1]] = i
            elif word in self._BLOCKS:
                opens = True
                if word in ("if", "unless", "while", "until"):
                    opens = self._begins(i)
                    if opens and word in ("while", "until"):
                        loop_line = k.line(i)
                elif word == "for":
                    loop_line = k.line(i)
                elif word == "do" and loop_line == k.line(i):
                    opens, loop_line = False, -1
                elif word == "def":
                    opens = not self._endless(i)
                if opens:
                    stack.append((word, i))
        for i in range(len(k)):
            if k.kind[i] != "name" or k.t(i - 1) in (".", "&."):
                continue
            word = k.text[i]
            if word in ("class", "module") and k.is_name(i + 1) and k.t(i + 1)[:1].isupper() and i in self.ends:
                name, scoped = i + 1, False
                while k.t(name + 1) == "::" and k.is_name(name + 2):
                    name, scoped = name + 2, True
                bases = [k.text[name + 2]] if word == "class" and k.t(name + 1) == "<" and k.is_name(name + 2) and k.t(name + 3) != "::" and k.t(name + 2)[:1].isupper() else []
                if not scoped:
                    self.define("Class", name, i, self.ends[i], bases=bases)
            elif word == "def" and k.is_name(i + 1):
                own = k.t(i + 2) == "."
                name = i + 3 if own else i + 1
                if k.is_name(name) and (own or k.t(name)[-1:] not in "=") and not (k.t(name)[:1] in "@$"):
                    last = self.ends.get(i)
                    if last is None:
                        last = self._line_end(i)
                    if k.t(name + 1) != "=" or k.at[name + 1] > k.end[name]:
                        self.define("Method" if own else "Function", name, i, last)
            elif word[:1].isupper() and k.t(i + 1) == "=" and k.t(i + 2) != "=" and self._begins(i) and k.t(i - 1) != "::":
                self.define("Variable", i, i, self._line_end(i))
            elif word == "require_relative":
                at = i + 1 + (k.t(i + 1) == "(")
                if at < len(k) and k.kind[at] == "string":
                    self.out.imports.append(Import(k.unquoted(at), [], "", k.line(i)))

    def _begins(self, i: int) -> bool:
        k = self.k
        return i == 0 or k.line(i - 1) < k.line(i) or k.t(i - 1) in ("=", "(", "[", ",", "{", "&&", "||", "return", "then", "do", "else", ";", "and", "or", "not", "!", "=>", "->", "|", "+", "<<", "begin")

    def _endless(self, i: int) -> bool:
        k = self.k
        j = i + 1
        while k.t(j + 1) == ".":
            j += 2
        j = k.pair[j + 1] + 1 if k.t(j + 1) == "(" else j + 1
        return k.t(j) == "=" and k.line(j) == k.line(i) and k.at[j] > k.end[j - 1]

    def _line_end(self, i: int) -> int:
        k, line = self.k, self.k.line(i)
        while i + 1 < len(k) and k.line(i + 1) == line:
            i = k.pair[i + 1] if k.pair[i + 1] > i + 1 else i + 1
            line = k.line_of_end(i)
        return i

    def calls(self) -> None:
        k = self.k
        for i in range(len(k)):
            word = k.text[i]
            if k.kind[i] != "name" or i in self.named or word in self.WORDS or word[:1] in "@$":
                continue
            dotted = k.t(i - 1) == "." and k.kind[i - 1] == "mark"
            bracket = k.t(i + 1) == "(" and k.at[i + 1] == k.end[i]
            if dotted:
                dot = i - 2 if k.t(i - 2) == "&" else i - 1
                if k.t(dot - 1) == "def" or i - 2 >= 0 and k.t(i - 3) == "def":
                    continue
                self.out.calls.append(Call(word, k.receiver(dot), k.line(i), i))
            elif bracket and k.t(i - 1) not in ("def", "::") or self._command(i):
                self.out.calls.append(Call(word, None, k.line(i), i))

    def _command(self, i: int) -> bool:
        """``name argument`` without brackets, at the beginning of a statement."""
        k = self.k
        if i + 1 >= len(k) or k.line(i + 1) != k.line(i) or k.at[i + 1] == k.end[i] or not self._begins(i) or k.text[i][:1].isupper():
            return False
        following = k.text[i + 1]
        if k.kind[i + 1] in ("string", "number") or following == ":" and k.at[i + 2 : i + 3] == [k.end[i + 1]]:
            return True
        return k.kind[i + 1] == "name" and following not in self.WORDS - {"self", "nil", "true", "false", "not", "super", "yield"}


_SCANNERS: dict[str, type[_Scanner]] = {"js": _Script, "ts": _TypedScript, "go": _Go, "java": _Java, "cs": _CSharp, "php": _Php, "cpp": _Cpp, "rs": _Rust, "rb": _Ruby}


def scan(source: str, slug: str) -> Scanned:
    """What the file defines, imports and calls; ``slug`` names its language."""
    return scan_python(source) if slug == "py" else _SCANNERS[slug](source).run()
