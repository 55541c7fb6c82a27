"""The tools that agents call: each takes plain arguments and returns a plain dict with how fresh its index is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.codegraph import CodeGraph
from codelattice.federation import Federation, merged_answers
from codelattice.operators import retrieve, store

MOST_ROWS, BUDGET = 1000, 4000


def _rows(df: DataFrame, most: int = MOST_ROWS) -> dict:
    rows = [r.asDict(recursive=True) for r in df.limit(most + 1).collect()]
    return {"items": rows[:most], "count": min(len(rows), most), "truncated": len(rows) > most}


def _packed(graph: CodeGraph, found: DataFrame, budget: int) -> dict:
    """Items with their code in a token budget."""
    g = graph.graph
    wanted = found.limit(100).join(g.nodes.select("id", "span_start", F.get_json_object("attrs", "$.signature").alias("signature"), F.coalesce(F.get_json_object("attrs", "$.code"), F.get_json_object("attrs", "$.text")).alias("code")), "id").orderBy(F.desc("score"), "id")
    items = []
    for r in wanted.collect():
        head = f"{r['kind'].lower()} {r['name']} ({r['sym_path']}{':' + str(r['span_start']) if r['span_start'] else ''})"
        items.append({"text": f"{head}\n{r['code'] or r['signature'] or ''}".rstrip(), "signature": head})
    texts, dropped = retrieve.packed(items, budget)
    return {"text": "\n\n".join(texts), "dropped": dropped, **_rows(found)}


def tools_of(graph: CodeGraph) -> dict[str, Callable[..., dict]]:
    """The eleven tools over one repository."""

    def fresh(answer: dict) -> dict:
        return answer | graph.staleness()

    def symbol(name: str, budget: int = BUDGET) -> dict:
        found = store.find(graph.graph, kinds=("Class", "Function", "Interface", "Method", "TypeAlias", "Variable"), name=name).orderBy("id").limit(5)
        ids = [r["id"] for r in found.select("id").collect()]
        if not ids:
            return fresh({"items": [], "count": 0, "truncated": False, "text": "", "dropped": 0})
        about = retrieve.retrieve(graph.graph, graph.vectors, (), mode="definition", depth=1, symbols=graph.spark.createDataFrame([(i,) for i in ids], "id string"))
        return fresh(_packed(graph, about, budget))

    def history(symbol_id: str) -> dict:
        return fresh(_rows(graph.history(symbol_id)))

    def query(text: str, max_rows: int = MOST_ROWS) -> dict:
        r = graph.query(text, max_rows=max_rows)
        return fresh({"columns": list(r.columns), "rows": [list(x) for x in r.rows], "truncated": r.truncated, "stopped_reason": r.stopped_reason})

    return {
        "repo_map": lambda budget=2000, scope=None, focus=(): fresh({"text": graph.map(budget, scope=scope, focus=focus)}),
        "search": lambda question, k=8, budget=BUDGET: fresh(_packed(graph, graph.retrieve(question, k=k), budget)),
        "symbol": symbol,
        "impact": lambda symbol_id, depth=3: fresh(_rows(graph.impact(symbol_id, depth))),
        "neighbors": lambda symbol_id, depth=1, kinds=None: fresh(_rows(graph.neighbors(symbol_id, depth, kinds))),
        "status": lambda: graph.status(),
        "routes": lambda method="", path="": fresh(_rows(graph.routes(method, path))),
        "decisions": lambda scope="", status="": fresh(_rows(graph.decisions(scope, status))),
        "explain": lambda symbol_id: fresh(graph.explain(symbol_id)),
        "history": history,
        "query": query,
    }


def federated_tools(federation: Federation) -> dict[str, Callable[..., dict]]:
    """The same questions over all members, or one of them by name, and the two that only make sense over several."""

    def surveyed(question: Callable[[CodeGraph], DataFrame], order: tuple[str, ...]) -> Callable[..., dict]:
        def ask(service: str = "", budget: int = BUDGET) -> dict:
            rows, dropped = merged_answers(federation.ask(question, service).limit(MOST_ROWS), budget, *order)
            return {"items": rows, "dropped": dropped, "services": {n: m.staleness() for n, m in federation.targets(service).items()}}

        return ask

    return {
        "routes": surveyed(lambda m: m.routes(), ("service", "path_pattern", "method")),
        "decisions": surveyed(lambda m: m.decisions(), ("service", "path")),
        "trace": lambda service, direction="downstream", depth=50: _rows(federation.trace(service, direction, depth)),
        "services_map": lambda: _rows(federation.services_map()),
    }
