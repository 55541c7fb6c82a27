"""Syntax tree to DataFrame plan.

A path is a chain of equi-joins; patterns are joined on the variables they share, and existence in WHERE becomes a
semi, anti or flag join, so Catalyst chooses order and strategy of all of them.  Only the id and the properties that the
query refers to are carried for a variable.  Logic is two-valued: a comparison with null is false.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelattice.cypher import ast
from codelattice.cypher.schema import PROPERTIES
from codelattice.cypher.validator import references
from codelattice.lineage import cut
from codelattice.model import Graph

#: From this many hops on, a variable-length path cuts its lineage at each layer.
LONG_PATH = 4
#: How many bindings a row stands for, where they are counted before they are joined.
WEIGHT = "__weight"


def _column(var: str, path: tuple[str, ...] = ()) -> str:
    return "__".join((var, "id") if not path else (var, "p", *path))


def _kind(path: tuple[str, ...]) -> str:
    return PROPERTIES[path[0]][1] if len(path) == 1 else "attr"


def _value(path: tuple[str, ...]) -> Column:
    """A property as a column of the nodes."""
    if len(path) == 1:
        return F.col(PROPERTIES[path[0]][0])
    keys = "".join(f"['{k}']" for k in path[1:])
    return F.get_json_object("attrs", f"${keys}")


def _text(column: Column, kind: str) -> Column:
    return column if kind in ("str", "attr") else column.cast("string")


def compare(column: Column, kind: str, op: str, right: ast.Value) -> Column:
    """A comparison with a literal, false for null; values of different types are unequal and not ordered."""
    if right is None:
        return column.isNotNull() if op == "<>" else F.lit(False)
    if isinstance(right, bool):
        literal = F.lit(str(right).lower()) if kind == "attr" else None
    elif isinstance(right, str):
        literal = F.lit(right) if kind in ("str", "attr") else None
    else:
        literal = None if kind == "str" else F.lit(float(right))
        column = column.try_cast("double") if kind == "attr" else column.cast("double")
    if literal is None:
        return column.isNotNull() if op == "<>" else F.lit(False)
    made = {"=": column == literal, "<>": column != literal, "<": column < literal, "<=": column <= literal, ">": column > literal, ">=": column >= literal}[op]
    return F.coalesce(made, F.lit(False))


def _inline(path: tuple[str, ...], value: ast.Value) -> Column:
    return _value(path).isNull() if value is None else compare(_value(path), _kind(path), "=", value)


@dataclass
class Planner:
    """Plans one query over one graph. ``cap`` is applied to what each MATCH pattern yields, for the bounded runner."""

    graph: Graph
    query: ast.Query
    cap: object = None
    _carried: dict[str, set[tuple[str, ...]]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for ref in (*references(self.query), *(o.ref for o in self.query.order)):
            if isinstance(ref, ast.Prop):
                self._carried.setdefault(ref.var, set()).add(ref.path)

    # Patterns ---------------------------------------------------------------

    def _nodes(self, node: ast.NodeP, carried: bool) -> DataFrame:
        """Candidates of a node pattern: ``cur``, and for a variable its id and properties."""
        nodes = self.graph.nodes
        if node.label is not None:
            nodes = nodes.where(F.col("kind") == node.label)
        for key, value in node.props:
            nodes = nodes.where(_inline((key,), value))
        columns = [F.col("id").alias("cur")]
        if node.var:
            columns.append(F.col("id").alias(_column(node.var)))
            if carried:
                columns += [_value(p).alias(_column(node.var, p)) for p in sorted(self._carried.get(node.var, ()))]
        return nodes.select(*columns)

    def _hops(self, rel: ast.RelP) -> DataFrame:
        """Distinct (from, to) of a single hop."""
        edges = self.graph.edges
        if rel.kind is not None:
            edges = edges.where(F.col("kind") == rel.kind)
        out, back = edges.select(F.col("src").alias("from"), F.col("dst").alias("to")), edges.select(F.col("dst").alias("from"), F.col("src").alias("to"))
        return (out if rel.direction == "out" else back if rel.direction == "in" else out.union(back)).distinct()

    def _reach(self, starts: DataFrame, rel: ast.RelP) -> DataFrame:
        """Distinct (from, to) of a path of ``least`` to ``most`` hops: layers of breadth-first search from each start.

        A layer grows from nodes first found in the one before it, but all that it reaches counts, as in a cycle back
        to the start.
        """
        hops = self._hops(rel).withColumnsRenamed({"from": "mid", "to": "next"})
        frontier = seen = starts.select(F.col("cur").alias("from"), F.col("cur").alias("to"))
        layers = []
        for depth in range(1, rel.most + 1):
            reached = frontier.withColumnRenamed("to", "mid").join(hops, "mid").select("from", F.col("next").alias("to")).distinct()
            if rel.most >= LONG_PATH:
                reached = cut(reached)
            if depth >= rel.least:
                layers.append(reached)
            frontier = reached.join(seen, ["from", "to"], "left_anti")
            seen = seen.union(frontier)
        return reduce(DataFrame.union, layers).distinct()

    def path(self, path: ast.Path, carried: bool = True, wanted: set[str] | None = None) -> DataFrame:
        """All bindings of a path, by itself. Unnamed nodes keep their multiplicity.

        With ``wanted`` only these variables of a ring are kept, and bindings that are equal in them are one row with its weight.
        """
        if (halves := self._halves(path)) is None:
            return self._walk(path, carried).drop("cur")
        ring = [_column(path.nodes[0].var), "cur"]
        one, two = (self._walk(half, carried) for half in halves)
        two = two.drop(*(c for c in two.columns if c in one.columns and c not in ring))
        if wanted is None:
            return one.join(two, ring).drop("cur")
        kept = lambda df: dict.fromkeys([*ring, *(c for c in df.columns if any(c == _column(v) or c.startswith(f"{v}__p__") for v in wanted))])
        counted = lambda df, name: df.groupBy(*kept(df)).agg(F.count(F.lit(1)).alias(name))
        both = counted(one, WEIGHT).join(counted(two, "__other"), ring)
        return both.withColumn(WEIGHT, F.col(WEIGHT) * F.col("__other")).drop("cur", "__other")

    @staticmethod
    def _halves(path: ast.Path) -> tuple[ast.Path, ast.Path] | None:
        """Both ways from the node at which a path begins and ends to the one in its middle; null for any other path.

        Walked in one direction, a ring has a row for every path around it before its end is compared with its begin.
        """
        names = [n.var for n in path.nodes[:-1] if n.var]
        middle = len(path.rels) // 2
        around = len(path.rels) > 2 and path.nodes[0].var is not None and path.nodes[-1].var == path.nodes[0].var
        if not around or len(set(names)) < len(names) or any((r.least, r.most) != (1, 1) for r in path.rels[middle:]):
            return None
        turned = tuple(replace(r, direction={"out": "in", "in": "out"}.get(r.direction, r.direction)) for r in reversed(path.rels[middle:]))
        end = path.nodes[-1] if path.nodes[-1].label or path.nodes[-1].props else path.nodes[0]
        ends = ast.NodeP(path.nodes[0].var, end.label, end.props)
        return ast.Path(path.nodes[: middle + 1], path.rels[:middle]), ast.Path((ends, *path.nodes[-2:middle:-1], ast.NodeP(None, None)), turned)

    def _walk(self, path: ast.Path, carried: bool) -> DataFrame:
        """The bindings of a path in its direction, and ``cur``, the node at which they end."""
        bound = self._nodes(path.nodes[0], carried)
        have = {path.nodes[0].var} - {None}
        for rel, node in zip(path.rels, path.nodes[1:], strict=True):
            single = (rel.least, rel.most) == (1, 1)
            hops = self._hops(rel) if single else self._reach(bound.select("cur").distinct(), rel)
            bound = bound.join(hops.withColumnRenamed("from", "cur"), "cur").drop("cur")
            repeated = node.var in have
            if repeated:  # the same variable again: the hop must end where it stands
                bound = bound.where(F.col("to") == F.col(_column(node.var)))
            if repeated and node.label is None and not node.props:
                bound = bound.withColumnRenamed("to", "cur")
            elif node.var is None and node.label is None and not node.props:
                bound = bound.withColumnRenamed("to", "cur")  # edges end at nodes, so there is nothing to look up
            else:
                wanted = self._nodes(node, carried)
                wanted = wanted.select("cur") if repeated else wanted
                bound = bound.join(wanted, F.col("to") == F.col("cur")).drop("to")
            have |= {node.var} - {None}
        return bound

    def match(self) -> DataFrame:
        """The bindings of all MATCH patterns, each joined to the ones before it by what it shares with them."""
        bound, waiting = None, list(self.query.match)
        while waiting:
            names = set() if bound is None else {c[:-4] for c in bound.columns if c.endswith("__id") and "__p__" not in c}
            which = next((i for i, p in enumerate(waiting) if bound is None or names & {n.var for n in p.nodes}), 0)
            path = waiting.pop(which)
            made = self.path(path)
            if bound is None:
                bound = made
            else:
                bound = self._joined(bound, made)
            if self.cap is not None:
                bound = self.cap(bound)
        return bound

    @staticmethod
    def _joined(bound: DataFrame, made: DataFrame) -> DataFrame:
        shared = [c for c in made.columns if c in bound.columns]
        keys = [c for c in shared if "__p__" not in c]
        return bound.join(made.drop(*(c for c in shared if c not in keys)), keys)

    # Bindings that aggregates need ------------------------------------------

    def _needed(self, part: ast.Expr | None) -> set[str]:
        """The variables of MATCH that a condition looks at."""
        bound = {n.var for p in self.query.match for n in p.nodes if n.var}
        seen = [{n.var for n in e.path.nodes} if isinstance(e, ast.Exists) else {e.left.var} for e in ast.exprs(part) if not isinstance(e, ast.Not | ast.Bool)]
        return bound & set().union(*seen)

    @staticmethod
    def _var(ref: ast.Prop | ast.Var) -> str:
        return ref.var if isinstance(ref, ast.Prop) else ref.name

    def bindings(self) -> DataFrame:
        """What the result is made of, with all conditions met: all bindings, or those that its aggregates can tell apart."""
        aggregates = [i.expr for i in self.query.items if isinstance(i.expr, ast.Agg)]
        grouping = {self._var(i.expr) for i in self.query.items if not isinstance(i.expr, ast.Agg)}
        if aggregates and len(self.query.match) > 1 and all(a.distinct or a.func in ("min", "max") for a in aggregates):
            if (bound := self._apart(aggregates, grouping)) is not None:
                return bound
        counts = all(a.func == "count" and not a.distinct and (a.arg is None or isinstance(a.arg, ast.Var)) for a in aggregates)
        if aggregates and counts and len(self.query.match) == 1 and self._halves(self.query.match[0]):
            return self.where(self.path(self.query.match[0], wanted=grouping | self._needed(self.query.where)))
        return self.where(self.match())

    def _apart(self, aggregates: list[ast.Agg], grouping: set[str]) -> DataFrame | None:
        """For aggregates to which repeated values are the same as one: for each variable they ask for, what it is bound to, without the product with what the others are bound to.

        Null where a condition spans several patterns.
        """
        names = [{n.var for n in p.nodes if n.var} for p in self.query.match]
        made: list[DataFrame] = [self.path(p) for p in self.query.match]
        for part in self._parts():
            home = next((i for i, n in enumerate(names) if self._needed(part) <= n), None)
            if home is None:
                return None
            made[home] = self._met(part, made[home])
        column = lambda ref: _column(ref.var, ref.path) if isinstance(ref, ast.Prop) else _column(ref.name)
        keys = [column(i.expr) for i in self.query.items if not isinstance(i.expr, ast.Agg)]
        asked: dict[str, list[str]] = {}
        for a in aggregates:
            asked.setdefault(self._var(a.arg), []).append(column(a.arg))
        some = [self._reduced(list(zip(names, made, strict=True)), grouping | {var}).select(*dict.fromkeys([*keys, *columns])) for var, columns in asked.items()]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), some)

    def _reduced(self, patterns: list[tuple[set[str], DataFrame]], needed: set[str]) -> DataFrame:
        """The join of patterns, of which those that add no needed variable only say whether there is a binding."""
        def leaf() -> tuple[int, int, set[str]] | None:
            for i, (names, _) in enumerate(patterns):
                shared = names & set().union(*(n for j, (n, _) in enumerate(patterns) if j != i))
                if needed & names <= shared and (at := next((j for j, (n, _) in enumerate(patterns) if j != i and shared <= n), None)) is not None:
                    return i, at, shared
            return None

        while found := leaf():
            i, at, shared = found
            ids = [_column(v) for v in sorted(shared)]
            patterns[at] = (patterns[at][0], patterns[at][1].join(patterns[i][1].select(*ids).distinct(), ids, "left_semi"))
            del patterns[i]
        have, bound = patterns.pop(0)
        while patterns:
            names, made = patterns.pop(next((i for i, (n, _) in enumerate(patterns) if n & have), 0))
            have, bound = have | names, self._joined(bound, made)
        return bound

    # Conditions -------------------------------------------------------------

    def _parts(self) -> tuple[ast.Expr, ...]:
        condition = self.query.where
        return condition.operands if isinstance(condition, ast.Bool) and condition.op == "AND" else () if condition is None else (condition,)

    def where(self, bound: DataFrame) -> DataFrame:
        return reduce(lambda b, part: self._met(part, b), self._parts(), bound)

    def _met(self, part: ast.Expr, bound: DataFrame) -> DataFrame:
        """The bindings that meet one condition."""
        bare = part.operand if isinstance(part, ast.Not) else part
        if isinstance(bare, ast.Exists) and (keys := self._keys(bare.path, bound)):
            return bound.join(self._existing(bare.path, keys), keys, "left_semi" if bare is part else "left_anti")
        columns = bound.columns
        bound, made = self._truth(part, bound)
        return bound.where(made).select(*columns)

    def _keys(self, path: ast.Path, bound: DataFrame) -> list[str]:
        return sorted({_column(n.var) for n in path.nodes if n.var} & set(bound.columns))

    def _existing(self, path: ast.Path, keys: list[str]) -> DataFrame:
        return self.path(path, carried=False).select(*keys).distinct()

    def _truth(self, e: ast.Expr, bound: DataFrame) -> tuple[DataFrame, Column]:
        """``bound``, perhaps with flag columns, and the condition as a column that is never null."""
        if isinstance(e, ast.Not):
            bound, inner = self._truth(e.operand, bound)
            return bound, ~inner
        if isinstance(e, ast.Bool):
            made = []
            for operand in e.operands:
                bound, one = self._truth(operand, bound)
                made.append(one)
            return bound, reduce(Column.__and__ if e.op == "AND" else Column.__or__, made)
        if isinstance(e, ast.Exists):
            keys = self._keys(e.path, bound)
            if not keys:
                return bound, self.path(e.path, carried=False).select(F.lit(1)).limit(1).agg((F.count(F.lit(1)) > 0).alias("some")).scalar()
            flag = f"flag__{len(bound.columns)}"
            return bound.join(self._existing(e.path, keys).withColumn(flag, F.lit(True)), keys, "left"), F.coalesce(F.col(flag), F.lit(False))
        column, kind = F.col(_column(e.left.var, e.left.path)), _kind(e.left.path)
        if isinstance(e, ast.Compare):
            return bound, compare(column, kind, e.op, e.right)
        if isinstance(e, ast.Text):
            text = _text(column, kind)
            return bound, F.coalesce({"starts": text.startswith, "ends": text.endswith, "contains": text.contains}[e.op](e.right), F.lit(False))
        options = [compare(column, kind, "=", v) for v in e.values if v is not None]
        if None in e.values:
            options.append(column.isNull())
        return bound, reduce(Column.__or__, options)

    # Result -----------------------------------------------------------------

    @staticmethod
    def _expr(ref: ast.Prop | ast.Var) -> Column:
        return F.col(_column(ref.var, ref.path)) if isinstance(ref, ast.Prop) else F.col(_column(ref.name))

    def _aggregate(self, agg: ast.Agg, weighted: bool = False) -> Column:
        if weighted:
            return F.coalesce(F.sum(WEIGHT), F.lit(0))
        if agg.arg is None:
            return F.count(F.lit(1))
        x = self._expr(agg.arg)
        if agg.func == "count":
            return F.count_distinct(x) if agg.distinct else F.count(x)
        if agg.func == "collect":
            return F.array_sort(F.collect_set(x) if agg.distinct else F.collect_list(x))
        if agg.func == "avg":
            return F.sum_distinct(x) / F.count_distinct(x) if agg.distinct else F.avg(x)
        return {"min": F.min, "max": F.max}[agg.func](x)

    @staticmethod
    def _sorted(df: DataFrame, keys: list[tuple[Column, bool]]) -> DataFrame:
        return df.orderBy(*(k.desc_nulls_last() if d else k.asc_nulls_first() for k, d in keys)) if keys else df

    def result(self, bound: DataFrame) -> DataFrame:
        """RETURN, ORDER BY and DISTINCT, without SKIP and LIMIT."""
        items = self.query.items
        quoted = lambda name: F.col(f"`{name}`")
        if any(isinstance(i.expr, ast.Agg) for i in items):
            plain = [i for i in items if not isinstance(i.expr, ast.Agg)]
            # Without keys there is a group only if there are rows.
            keys = [self._expr(i.expr).alias(i.column) for i in plain] or [F.lit(1).alias("__all")]
            out = bound.groupBy(*keys).agg(*(self._aggregate(i.expr, WEIGHT in bound.columns).alias(i.column) for i in items if isinstance(i.expr, ast.Agg)))
            out = out.select(*(quoted(i.column) for i in items))
            order = []
            for key in self.query.order:
                column = next(i.column for i in items if key.ref == i.expr or isinstance(key.ref, ast.Var) and i.alias == key.ref.name)
                order.append((quoted(column), key.descending))
            ties = [(quoted(i.column), False) for i in plain] if order else []
            return self._sorted(out, order + ties)
        aliases = {i.alias: i.expr for i in items if i.alias}
        order = [(self._expr(aliases[k.ref.name] if isinstance(k.ref, ast.Var) and k.ref.name in aliases else k.ref), k.descending) for k in self.query.order]
        ids = [(F.col(c), False) for c in sorted(c for c in bound.columns if c.endswith("__id") and "__p__" not in c)] if order else []
        shown = [self._expr(i.expr).alias(i.column) for i in items]
        if not self.query.distinct:
            return self._sorted(bound, order + ids).select(*shown)
        if not order:
            return bound.select(*shown).distinct()
        ranked = bound.select(*shown, *(k.alias(f"__o{n}") for n, (k, _) in enumerate(order + ids)))
        keys = [(F.col(f"__o{n}"), d) for n, (_, d) in enumerate(order + ids)]
        first = Window.partitionBy(*(quoted(i.column) for i in items)).orderBy(*(k.desc_nulls_last() if d else k.asc_nulls_first() for k, d in keys))
        return self._sorted(ranked.withColumn("__n", F.row_number().over(first)).where("__n = 1"), keys).select(*(quoted(i.column) for i in items))

    def plan(self) -> DataFrame:
        """The whole query as one lazy DataFrame."""
        out = self.result(self.bindings())
        if self.query.skip:
            out = out.offset(self.query.skip)
        return out if self.query.limit is None else out.limit(self.query.limit)
