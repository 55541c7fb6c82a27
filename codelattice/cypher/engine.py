"""Running queries: as a lazy plan, or bounded by rows, intermediate bindings and time."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from codelattice.cypher.errors import DisabledError, GuardrailError
from codelattice.cypher.parser import parse
from codelattice.cypher.planner import Planner
from codelattice.cypher.schema import CAPABILITIES
from codelattice.cypher.validator import validate
from codelattice.lineage import cut
from codelattice.model import Graph

#: What a query may take beyond its time before it is cancelled without a result.
GRACE_S = 2.0


@dataclass(frozen=True)
class Bounds:
    max_rows: int = 1000
    timeout_ms: int = 5000
    max_expansions: int = 50_000
    enabled: bool = True


@dataclass(frozen=True)
class Result:
    columns: tuple[str, ...]
    rows: tuple[tuple, ...]
    truncated: bool = False
    stopped_reason: str | None = None  # row_cap, expansion_cap or timeout


def plan(graph: Graph, text: str, capabilities: frozenset[str] = CAPABILITIES) -> DataFrame:
    """The query's unbounded DataFrame: no row is computed on the driver."""
    return Planner(graph, validate(parse(text), capabilities)).plan()


def run(graph: Graph, text: str, bounds: Bounds = Bounds(), capabilities: frozenset[str] = CAPABILITIES, clock: Callable[[], float] = time.monotonic) -> Result:
    """The query's rows within ``bounds``: one row more than is shown is fetched, to tell whether some were cut.

    A query that reaches its time returns the rows it has by then; one that isn't stopped by that raises GuardrailError.
    """
    if not bounds.enabled:
        raise DisabledError("structural queries are switched off")
    query, spark = validate(parse(text), capabilities), graph.nodes.sparkSession
    until, stopped = clock() + bounds.timeout_ms / 1000, None

    def cap(bound: DataFrame) -> DataFrame:
        """The first bindings in order of their ids, computed once; no more than the cap and one are kept."""
        nonlocal stopped
        ids = sorted(c for c in bound.columns if c.endswith("__id") and "__p__" not in c)
        few = cut(bound.orderBy(*ids).limit(bounds.max_expansions + 1))
        if few.count() <= bounds.max_expansions:
            return few
        stopped = "expansion_cap"
        return few.orderBy(*ids).limit(bounds.max_expansions)

    limit = bounds.max_rows if query.limit is None else min(query.limit, bounds.max_rows)
    columns = tuple(i.column for i in query.items)
    tag = f"bounded-{threading.get_ident()}-{time.monotonic_ns()}"
    cancel = threading.Timer(max(0.0, until - clock()) + GRACE_S, spark.interruptTag, [tag])
    rows: list[tuple] = []
    spark.addTag(tag)
    cancel.daemon = True
    cancel.start()
    try:
        if clock() >= until:
            return Result(columns, (), True, "timeout")
        planner = Planner(graph, query, cap)
        out = planner.result(planner.where(planner.match()))
        if query.skip:
            out = out.offset(query.skip)
        if clock() >= until:
            return Result(columns, (), True, "timeout")
        for row in out.limit(limit + 1).toLocalIterator():
            rows.append(tuple(row))
            if clock() >= until:
                stopped = stopped or "timeout"
                break
    except Exception as e:
        if clock() >= until:
            raise GuardrailError(f"the query took more than {bounds.timeout_ms} ms") from e
        raise
    finally:
        cancel.cancel()
        spark.removeTag(tag)
    reason = stopped or ("row_cap" if len(rows) > limit else None)
    return Result(columns, tuple(rows[:limit]), reason is not None, reason)


def as_table(result: Result) -> str:
    """Columns of equal width, with a closing line when rows were cut."""
    cells = [list(result.columns), *([("" if v is None else str(v)) for v in row] for row in result.rows)]
    widths = [max(len(r[i]) for r in cells) for i in range(len(result.columns))]
    lines = ["  ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() for r in cells]
    lines.insert(1, "  ".join("-" * w for w in widths))
    return "\n".join([*lines, *([f"({len(result.rows)} rows, more left out: {result.stopped_reason})"] if result.truncated else [])])


def as_json(result: Result) -> str:
    return json.dumps({"columns": result.columns, "rows": result.rows, "truncated": result.truncated, "stopped_reason": result.stopped_reason}, default=list)
