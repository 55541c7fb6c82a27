"""Several repositories answered as one: a question goes to all members, or to one, and answers carry their service."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.codegraph import CodeGraph
from codelattice.operators import federation, verbs
from codelattice.sources import git, repository, workspace


class Federation:
    """The code graphs of a workspace's members by name."""

    def __init__(self, members: dict[str, CodeGraph]) -> None:
        if not members:
            raise ValueError("a federation needs a member")
        self.members = members

    @classmethod
    def open(cls, spark: SparkSession, path: str, fetch: bool = False, **settings: dict) -> "Federation":
        found = {}
        for m in workspace.members(path):
            if m.url:
                git.checkout(m.url, m.path, m.ref, fetch)
            found[m.name] = CodeGraph(spark, m.path, repo=m.name, **workspace.merged(m.settings, settings))
        return cls(found)

    def targets(self, service: str = "") -> dict[str, CodeGraph]:
        """One member, or all."""
        if service and service not in self.members:
            raise KeyError(f"no service is named {service}; there are {', '.join(sorted(self.members))}")
        return {service: self.members[service]} if service else self.members

    def one(self, service: str = "") -> CodeGraph:
        """The member asked for; without a name there has to be just one."""
        found = self.targets(service)
        if len(found) > 1:
            raise KeyError(f"say which service: {', '.join(sorted(found))}")
        return next(iter(found.values()))

    def ask(self, question: Callable[[CodeGraph], DataFrame], service: str = "") -> DataFrame:
        """A question's answers from all members, with ``service``."""
        return federation.fan_out({name: question(m) for name, m in self.targets(service).items()})

    def build(self) -> dict[str, object]:
        return {name: m.refresh() for name, m in self.members.items()}

    def _both(self) -> tuple[DataFrame, DataFrame]:
        calls = self.ask(lambda m: m.service_calls()).select("service", "method", "url")
        own = self.ask(lambda m: m.routes()).select("service", "method", F.col("path_pattern").alias("path"))
        specs = {n: repository.openapi(m.spark, m.root) for n, m in self.members.items()}
        described = federation.openapi_routes(federation.fan_out(specs).select("service", "spec")).select("service", "method", "path")
        return calls, federation.merged_routes(own, described)

    def services_map(self) -> DataFrame:
        return federation.service_map(*self._both()).orderBy("caller", "callee", "method", "call_path")

    def unresolved(self) -> DataFrame:
        return federation.unresolved(*self._both())

    def trace(self, service: str, direction: str = "downstream", depth: int = 50) -> DataFrame:
        self.targets(service)
        return federation.trace(*self._both(), service, direction, depth).orderBy("hop", "service")


def capabilities(members: list[frozenset[str]]) -> frozenset[str]:
    """What every member can do."""
    return reduce(frozenset.__and__, members) if members else frozenset()


def merged_answers(answers: DataFrame, budget: int, *order: str) -> tuple[list[dict], int]:
    """The first answers whose JSON stays in a budget of tokens, best first over all services, and how many were left out; answers are a bounded top-k."""
    packed = verbs.within_tokens(answers.withColumn("__json", F.to_json(F.struct(*answers.columns))), F.col("__json"), budget, *(F.col(c) for c in order))
    rows = [r.asDict(recursive=True) for r in packed.drop("__json", "used").collect()]
    return rows, answers.count() - len(rows)


