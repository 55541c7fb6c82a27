"""Checks of a parsed query before it is planned."""

from __future__ import annotations

from collections.abc import Iterator

from codelattice.cypher import ast
from codelattice.cypher.errors import CapabilityError, ValidationError
from codelattice.cypher.schema import CAPABILITIES, PROPERTIES, is_property
from codelattice.model import EDGE_KINDS, NODE_KINDS


def validate(query: ast.Query, offered: frozenset[str] = CAPABILITIES) -> ast.Query:
    """``query`` itself; raises ValidationError or CapabilityError."""
    paths = [*query.match, *(e.path for e in ast.exprs(query.where) if isinstance(e, ast.Exists))]
    for path in paths:
        for node in path.nodes:
            _known(node.label, NODE_KINDS, "node label")
            for key, _ in node.props:
                _known(key, tuple(PROPERTIES), "inline property")
        for rel in path.rels:
            _known(rel.kind, EDGE_KINDS, "relationship type")
            if rel.most is None:
                raise ValidationError("a path of variable length needs an upper bound, as in *1..3")
            if rel.least < 1 or rel.most < rel.least:
                raise ValidationError(f"a path can't have *{rel.least}..{rel.most} hops: 1 <= least <= most is needed")
    bound = {n.var for p in query.match for n in p.nodes if n.var}
    for ref in references(query):
        name = ref.var if isinstance(ref, ast.Prop) else ref.name
        if name not in bound:
            raise ValidationError(f"'{name}' is not a node variable of the MATCH clause")
        if isinstance(ref, ast.Prop) and not is_property(ref.path):
            raise ValidationError(f"unknown property '{'.'.join(ref.path)}'; there are {', '.join(PROPERTIES)} and attrs.<key>")
    columns = [i.column for i in query.items]
    if len(set(columns)) < len(columns):
        raise ValidationError("two columns of the result have the same name")
    _check_order(query, bound)
    for what, n in (("SKIP", query.skip), ("LIMIT", query.limit)):
        if n is not None and n < 0:
            raise ValidationError(f"{what} can't be negative")
    _check_connected(query)
    for needed in sorted(needs(query) - offered):
        raise CapabilityError(needed, offered)
    return query


def _known(name: str | None, names: tuple[str, ...], what: str) -> None:
    if name is not None and name not in names:
        raise ValidationError(f"unknown {what} '{name}'; there are {', '.join(sorted(names))}")


def references(query: ast.Query) -> Iterator[ast.Prop | ast.Var]:
    """What the conditions and the result refer to."""
    for e in ast.exprs(query.where):
        if isinstance(e, ast.Compare | ast.In | ast.Text):
            yield e.left
    for item in query.items:
        expr = item.expr.arg if isinstance(item.expr, ast.Agg) else item.expr
        if expr is not None:
            yield expr


def _check_order(query: ast.Query, bound: set[str]) -> None:
    grouped = any(isinstance(i.expr, ast.Agg) for i in query.items)
    for key in query.order:
        ref = key.ref
        if isinstance(ref, ast.Prop):
            if not is_property(ref.path):
                raise ValidationError(f"unknown property '{'.'.join(ref.path)}'")
            if ref.var not in bound:
                raise ValidationError(f"'{ref.var}' is not a node variable of the MATCH clause")
        elif ref.name not in bound and all(i.alias != ref.name for i in query.items):
            raise ValidationError(f"ORDER BY '{ref.name}' is neither a variable nor an alias")
        if grouped and all(ref != i.expr and not (isinstance(ref, ast.Var) and i.alias == ref.name) for i in query.items):
            raise ValidationError("with aggregates, ORDER BY can only name columns of the result")


def _check_connected(query: ast.Query) -> None:
    groups: list[set[str]] = []
    for path in query.match:
        names = {n.var for n in path.nodes if n.var}
        joined = [g for g in groups if g & names]
        groups = [g for g in groups if not g & names] + [names.union(*joined)]
        if not names and len(query.match) > 1:
            groups.append(set())
    if len(groups) > 1:
        raise ValidationError("the MATCH patterns share no variable, which would be a Cartesian product")


def needs(query: ast.Query) -> set[str]:
    """The capabilities that a query uses."""
    out = {"core"}
    for e in ast.exprs(query.where):
        if isinstance(e, ast.Text):
            out.add("string.pred")
        elif isinstance(e, ast.Exists):
            out.add("pattern.exists")
    paths = [*query.match, *(e.path for e in ast.exprs(query.where) if isinstance(e, ast.Exists))]
    if any((r.least, r.most) != (1, 1) for p in paths for r in p.rels):
        out.add("path.varlen")
    out |= {"agg.collect" if i.expr.func == "collect" else "agg.basic" for i in query.items if isinstance(i.expr, ast.Agg)}
    props = [*references(query), *(o.ref for o in query.order)]
    if any(isinstance(p, ast.Prop) and len(p.path) > 1 for p in props):
        out.add("attrs.access")
    return out
