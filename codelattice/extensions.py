"""Named extension points: embedders, judges, summarisers, matchers, rerankers, enrichers and framework packs."""

from __future__ import annotations

from collections.abc import Callable
from importlib.metadata import entry_points

KINDS = ("embedder", "enricher", "framework", "judge", "matcher", "scorer", "summarizer")
_OWN: dict[tuple[str, str], object] = {}


def register(kind: str, name: str, thing: object) -> None:
    if kind not in KINDS:
        raise ValueError(f"there is no extension point {kind}; there are {', '.join(KINDS)}")
    _OWN[kind, name] = thing
    if kind == "framework":
        from codelattice.extract.frameworks import PACKS

        PACKS[name] = thing


def provider(kind: str, name: str) -> Callable | object:
    """What is registered under a name, or the entry point of that name in the group ``codelattice.<kind>``."""
    if (kind, name) in _OWN:
        return _OWN[kind, name]
    for point in entry_points(group=f"codelattice.{kind}"):
        if point.name == name:
            return point.load()
    known = sorted(n for k, n in _OWN if k == kind)
    raise LookupError(f"no {kind} is named {name}; registered: {', '.join(known) or 'none'}")


def _built_in() -> None:
    from codelattice.operators import enrich

    register("judge", "scripted", enrich.scripted_judge)
    register("summarizer", "scripted", enrich.scripted_summarizer)
    register("matcher", "scripted", enrich.scripted_matcher)


_built_in()
