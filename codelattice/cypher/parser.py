"""Text to syntax tree."""

from __future__ import annotations

import re

from codelattice.cypher import ast
from codelattice.cypher.errors import ParseError

_SCANNER = re.compile(
    r"""(?P<space>\s+)
      | (?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")
      | (?P<float>\d+\.\d+)
      | (?P<int>\d+)
      | (?P<word>[A-Za-z_][A-Za-z0-9_]*)
      | (?P<sign><-|->|<>|<=|>=|\.\.|[-<>=()\[\]{}:,.*])""",
    re.X | re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = frozenset("MATCH WHERE RETURN DISTINCT ORDER BY SKIP LIMIT AS AND OR NOT IN STARTS ENDS WITH CONTAINS ASC DESC TRUE FALSE NULL".split())
_AGGREGATES = frozenset("count collect min max avg".split())


class _Parser:
    def __init__(self, text: str) -> None:
        self.tokens: list[tuple[str, str, int]] = []
        at = 0
        while at < len(text):
            m = _SCANNER.match(text, at)
            if m is None:
                raise ParseError(f"unexpected character {text[at]!r}", at)
            if m.lastgroup != "space":
                kind = "key" if m.lastgroup == "word" and m[0].upper() in _WORDS else m.lastgroup
                self.tokens.append((kind, m[0], at))
            at = m.end()
        self.tokens.append(("end", "", len(text)))
        self.at = 0

    # Tokens -----------------------------------------------------------------

    def peek(self, *wanted: str, ahead: int = 0) -> bool:
        kind, text, _ = self.tokens[min(self.at + ahead, len(self.tokens) - 1)]
        return kind in ("sign", "key") and (text.upper() if kind == "key" else text) in wanted

    def accept(self, *wanted: str) -> str | None:
        if self.peek(*wanted):
            self.at += 1
            return self.tokens[self.at - 1][1].upper()
        return None

    def fail(self, wanted: str) -> ParseError:
        _, text, offset = self.tokens[self.at]
        return ParseError(f"expected {wanted}, found {text or 'the end'!r}", offset)

    def expect(self, *wanted: str) -> str:
        found = self.accept(*wanted)
        if found is None:
            raise self.fail(" or ".join(wanted))
        return found

    def take(self, kind: str, what: str) -> str:
        if self.tokens[self.at][0] != kind:
            raise self.fail(what)
        self.at += 1
        return self.tokens[self.at - 1][1]

    def name(self) -> str:
        return self.take("word", "a name")

    def vocabulary(self) -> str:
        """A label or a relationship type, which may look like a keyword."""
        return self.take("key", "a name") if self.is_a("key") else self.name()

    def is_a(self, kind: str, ahead: int = 0) -> bool:
        return self.tokens[min(self.at + ahead, len(self.tokens) - 1)][0] == kind

    # Clauses ----------------------------------------------------------------

    def query(self) -> ast.Query:
        self.expect("MATCH")
        match = self.several(self.path)
        where = self.disjunction() if self.accept("WHERE") else None
        self.expect("RETURN")
        distinct = bool(self.accept("DISTINCT"))
        items = self.several(self.item)
        order: tuple[ast.Order, ...] = ()
        if self.accept("ORDER"):
            self.expect("BY")
            order = self.several(self.order)
        skip = int(self.take("int", "a number")) if self.accept("SKIP") else None
        limit = int(self.take("int", "a number")) if self.accept("LIMIT") else None
        if not self.is_a("end"):
            raise self.fail("the end of the query")
        return ast.Query(match, where, items, distinct, order, skip, limit)

    def several(self, one) -> tuple:
        out = [one()]
        while self.accept(","):
            out.append(one())
        return tuple(out)

    def path(self) -> ast.Path:
        nodes, rels = [self.node()], []
        while self.peek("-", "<-"):
            rels.append(self.rel())
            nodes.append(self.node())
        return ast.Path(tuple(nodes), tuple(rels))

    def node(self) -> ast.NodeP:
        self.expect("(")
        var = self.name() if self.is_a("word") else None
        label = self.vocabulary() if self.accept(":") else None
        props = []
        if self.accept("{"):
            while True:
                key = self.name()
                self.expect(":")
                props.append((key, self.literal()))
                if not self.accept(","):
                    break
            self.expect("}")
        self.expect(")")
        return ast.NodeP(var, label, tuple(props))

    def rel(self) -> ast.RelP:
        start = self.expect("-", "<-")
        var = kind = None
        least, most = 1, 1
        if self.accept("["):
            var = self.name() if self.is_a("word") else None
            kind = self.vocabulary() if self.accept(":") else None
            if self.accept("*"):
                least, most = self.hops()
            self.expect("]")
        offset = self.tokens[self.at][2]
        end = self.expect("-", "->")
        if start == "<-" and end == "->":
            raise ParseError("a relationship can't point both ways", offset)
        return ast.RelP(var, kind, "in" if start == "<-" else "out" if end == "->" else "both", least, most)

    def hops(self) -> tuple[int, int | None]:
        least = int(self.take("int", "a number")) if self.is_a("int") else None
        if self.accept(".."):
            return least if least is not None else 1, int(self.take("int", "a number")) if self.is_a("int") else None
        return (1, None) if least is None else (least, least)

    # Conditions -------------------------------------------------------------

    def disjunction(self) -> ast.Expr:
        return self.chain("OR", self.conjunction)

    def conjunction(self) -> ast.Expr:
        return self.chain("AND", self.negation)

    def chain(self, op: str, one) -> ast.Expr:
        operands = [one()]
        while self.accept(op):
            operands.append(one())
        return operands[0] if len(operands) == 1 else ast.Bool(op, tuple(operands))

    def negation(self) -> ast.Expr:
        return ast.Not(self.negation()) if self.accept("NOT") else self.primary()

    def primary(self) -> ast.Expr:
        if self.peek("("):
            # A parenthesis begins a pattern or a group; a pattern has a relationship after its first node.
            start = self.at
            try:
                path = self.path()
                if path.rels:
                    return ast.Exists(path)
            except ParseError:
                pass
            self.at = start
            self.expect("(")
            inner = self.disjunction()
            self.expect(")")
            return inner
        left = self.prop()
        if self.accept("IN"):
            self.expect("[")
            values = self.several(self.literal)
            self.expect("]")
            return ast.In(left, values)
        for word, op in (("STARTS", "starts"), ("ENDS", "ends")):
            if self.accept(word):
                self.expect("WITH")
                return ast.Text(left, op, self.string())
        if self.accept("CONTAINS"):
            return ast.Text(left, "contains", self.string())
        return ast.Compare(left, self.expect("=", "<>", "<", "<=", ">", ">="), self.literal())

    def prop(self) -> ast.Prop:
        var = self.name()
        path = []
        while self.accept("."):
            if not (self.is_a("word") or self.is_a("key")):
                raise self.fail("a property name")
            path.append(self.tokens[self.at][1])
            self.at += 1
        if not path:
            raise self.fail("'.'")
        return ast.Prop(var, tuple(path))

    def ref(self) -> ast.Prop | ast.Var:
        return self.prop() if self.peek(".", ahead=1) else ast.Var(self.name())

    def item(self) -> ast.Item:
        expr: ast.Prop | ast.Var | ast.Agg
        if self.is_a("word") and self.peek("(", ahead=1):
            offset = self.tokens[self.at][2]
            func = self.name().lower()
            if func not in _AGGREGATES:
                raise ParseError(f"unknown function {func!r}", offset)
            self.expect("(")
            distinct = bool(self.accept("DISTINCT"))
            if self.peek("*"):
                if func != "count":
                    raise self.fail("a property or a variable")
                self.expect("*")
                expr = ast.Agg(func, None, distinct)
            else:
                expr = ast.Agg(func, self.ref(), distinct)
            self.expect(")")
        else:
            expr = self.ref()
        return ast.Item(expr, self.name() if self.accept("AS") else None)

    def order(self) -> ast.Order:
        ref = self.ref()
        return ast.Order(ref, self.accept("ASC", "DESC") == "DESC")

    # Literals ---------------------------------------------------------------

    def string(self) -> str:
        raw = self.take("string", "a string")[1:-1]
        return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), raw, flags=re.S)

    def literal(self) -> ast.Value:
        if self.is_a("string"):
            return self.string()
        word = self.accept("TRUE", "FALSE", "NULL")
        if word:
            return {"TRUE": True, "FALSE": False, "NULL": None}[word]
        sign = -1 if self.accept("-") else 1
        if self.is_a("float"):
            return sign * float(self.take("float", "a number"))
        return sign * int(self.take("int", "a literal"))


def parse(text: str) -> ast.Query:
    """The syntax tree of ``text``; raises ParseError."""
    return _Parser(text).query()
