"""Syntax tree of a query."""

from __future__ import annotations

from dataclasses import dataclass

Value = str | int | float | bool | None


@dataclass(frozen=True)
class Prop:
    var: str
    path: tuple[str, ...]


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class NodeP:
    var: str | None
    label: str | None
    props: tuple[tuple[str, Value], ...] = ()


@dataclass(frozen=True)
class RelP:
    var: str | None
    kind: str | None
    direction: str  # out, in or both
    least: int = 1
    most: int | None = 1


@dataclass(frozen=True)
class Path:
    nodes: tuple[NodeP, ...]
    rels: tuple[RelP, ...]


@dataclass(frozen=True)
class Compare:
    left: Prop
    op: str
    right: Value


@dataclass(frozen=True)
class In:
    left: Prop
    values: tuple[Value, ...]


@dataclass(frozen=True)
class Text:
    left: Prop
    op: str  # starts, ends or contains
    right: str


@dataclass(frozen=True)
class Exists:
    path: Path


@dataclass(frozen=True)
class Not:
    operand: "Expr"


@dataclass(frozen=True)
class Bool:
    op: str  # AND or OR
    operands: tuple["Expr", ...]


Expr = Compare | In | Text | Exists | Not | Bool


@dataclass(frozen=True)
class Agg:
    func: str
    arg: Prop | Var | None  # None: *
    distinct: bool = False


@dataclass(frozen=True)
class Item:
    expr: Prop | Var | Agg
    alias: str | None = None

    @property
    def column(self) -> str:
        if self.alias:
            return self.alias
        label = lambda e: e.name if isinstance(e, Var) else ".".join((e.var, *e.path))
        if isinstance(self.expr, Agg):
            return f"{self.expr.func}({'*' if self.expr.arg is None else label(self.expr.arg)})"
        return label(self.expr)


@dataclass(frozen=True)
class Order:
    ref: Prop | Var
    descending: bool = False


@dataclass(frozen=True)
class Query:
    match: tuple[Path, ...]
    where: Expr | None
    items: tuple[Item, ...]
    distinct: bool = False
    order: tuple[Order, ...] = ()
    skip: int | None = None
    limit: int | None = None


def exprs(e: Expr | None):
    """An expression and all below it."""
    if e is None:
        return
    yield e
    for x in (e.operand,) if isinstance(e, Not) else e.operands if isinstance(e, Bool) else ():
        yield from exprs(x)
