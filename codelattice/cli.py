"""The command line: ``python -m codelattice.cli VERB ...``; answers are tables, or JSON with --json."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from codelattice.codegraph import CodeGraph
from codelattice.cypher import engine, errors
from codelattice.operators import enrich

MOST_ROWS = 1000


def shown(answer: object, as_json: bool) -> str:
    if isinstance(answer, DataFrame):
        rows = answer.limit(MOST_ROWS + 1).collect()
        answer = engine.Result(tuple(answer.columns), tuple(map(tuple, rows[:MOST_ROWS])), len(rows) > MOST_ROWS, "row_cap" if len(rows) > MOST_ROWS else None)
    if isinstance(answer, engine.Result):
        return engine.as_json(answer) if as_json else engine.as_table(answer)
    if isinstance(answer, str):
        return answer
    data = answer if isinstance(answer, (dict, list)) else vars(answer) if hasattr(answer, "__dict__") else answer
    return json.dumps(data, indent=None if as_json else 2, default=str)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="codelattice")
    out.add_argument("--root", default=".")
    out.add_argument("--store")
    out.add_argument("--read-only", action="store_true")
    out.add_argument("--json", action="store_true")
    verbs = out.add_subparsers(dest="verb", required=True)

    def verb(name: str, *arguments: tuple[str, dict]) -> None:
        own = verbs.add_parser(name)
        for flag, how in arguments:
            own.add_argument(flag, **how)

    text, number = {"default": ""}, lambda n: {"type": int, "default": n}
    verb("index", ("--full", {"action": "store_true"}))
    verb("status")
    verb("history", ("symbol", {}))
    verb("changed-since", ("ts", {"type": int}), ("--scope", {"default": None}))
    verb("backfill", ("--history", {"type": int, "default": None}))
    verb("mine")
    verb("embed")
    verb("learn")
    verb("routes", ("--method", text), ("--path", text))
    verb("service-calls")
    verb("models")
    verb("services")
    verb("decisions", ("--scope", text), ("--status", text))
    verb("enrich", ("--scores", {"default": "{}", "help": "JSON: a confidence for each pattern, for the judge without a model"}), ("--broad", {"action": "store_true"}))
    verb("summarize")
    verb("summaries", ("--level", {"default": None}))
    verb("tagged", ("pattern", {}), ("--least", {"type": float, "default": 0.7}))
    verb("map", ("--budget", number(2000)), ("--scope", {"default": None}), ("--focus", {"nargs": "*", "default": []}))
    verb("impact", ("symbol", {}), ("--depth", number(3)))
    verb("neighbors", ("symbol", {}), ("--depth", number(1)))
    verb("explain", ("symbol", {}))
    verb("query", ("text", {"nargs": "?", "default": ""}), ("--graph", {"action": "store_true"}), ("--schema", {"action": "store_true"}), ("--mode", {"default": "context"}), ("-k", number(8)))
    verb("services-map", ("workspace", {}))
    verb("trace", ("workspace", {}), ("service", {}), ("--direction", {"default": "downstream", "choices": ["downstream", "upstream"]}), ("--depth", number(50)))
    verb("build", ("workspace", {}))
    verb("doctor")
    verb("watch", ("--policy", {"default": None}), ("--seconds", {"type": float, "default": None}), ("--once", {"action": "store_true"}))
    return out


def answer(args: argparse.Namespace, spark: SparkSession) -> object:
    if args.verb in ("services-map", "trace", "build"):
        from codelattice.federation import Federation

        members = Federation.open(spark, args.workspace)
        if args.verb == "build":
            return {name: vars(report) for name, report in members.build().items()}
        return members.services_map() if args.verb == "services-map" else members.trace(args.service, args.direction, args.depth)
    if args.verb == "doctor":
        from codelattice.sources import workspace

        wrong = workspace.problems(workspace.settings_of(args.root))
        return {"problems": wrong, "ok": not wrong}
    graph = CodeGraph(spark, args.root, args.store, args.read_only)
    if args.verb == "watch":
        from codelattice.streaming import watch

        own = graph.settings["watch"]
        policy = watch.Policy(args.policy or own["policy"], own["debounce_ms"], own["idle_ms"], own["interval_ms"])
        watch.ensure_watchable(args.read_only, "")
        if args.once:
            return graph.refresh()
        running = watch.watch(spark, graph.root, graph.refresh, policy, f"{graph.store.folder}/watch", tuple(own["branches"]), tuple(own["not_branches"]))
        running.awaitTermination(args.seconds)
        running.stop()
        return {"watched": graph.root, "policy": policy.trigger}
    if args.verb == "query":
        if args.schema:
            return graph.schema()
        return graph.query(args.text) if args.graph else graph.retrieve(args.text, mode=args.mode, k=args.k)
    calls = {
        "index": lambda: graph.index() if args.full else graph.refresh(), "status": graph.status, "history": lambda: graph.history(args.symbol), "changed-since": lambda: graph.changed_since(args.ts, args.scope),
        "backfill": lambda: {"events": graph.backfill(args.history)}, "mine": lambda: graph.mine() or {"mined": True}, "embed": graph.embed, "learn": lambda: graph.learn() or {"learned": True}, "routes": lambda: graph.routes(args.method, args.path),
        "service-calls": graph.service_calls, "models": graph.models, "services": graph.services, "decisions": lambda: graph.decisions(args.scope, args.status),
        "enrich": lambda: {"tags": graph.enrich(enrich.scripted_judge(json.loads(args.scores)), broad=args.broad)}, "summarize": lambda: graph.summarize(enrich.scripted_summarizer()) or {"summarized": True}, "summaries": lambda: graph.summaries(args.level),
        "tagged": lambda: graph.tagged(args.pattern, args.least), "map": lambda: graph.map(args.budget, scope=args.scope, focus=args.focus), "impact": lambda: graph.impact(args.symbol, args.depth), "neighbors": lambda: graph.neighbors(args.symbol, args.depth), "explain": lambda: graph.explain(args.symbol),
    }
    return calls[args.verb]()


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("codelattice").getOrCreate()
    try:
        print(shown(answer(args, spark), args.json))
    except (errors.QueryError, ValueError, KeyError, PermissionError, RuntimeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
