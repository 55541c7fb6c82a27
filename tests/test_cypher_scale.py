"""Patterns whose bindings are many more than the rows that the result needs."""

import random

import pytest

from codelattice.cypher.engine import plan
from codelattice.cypher.parser import parse
from codelattice.cypher.planner import Planner
from codelattice.model import EDGES, NODES, Graph

random.seed(3)
KIND = {"p": "Package", "s": "Service", "i": "Interface", "f": "Function", "c": "Class"}
NAMES = [f"{k}{n}" for k, m in (("p", 3), ("s", 6), ("i", 5), ("f", 8), ("c", 7)) for n in range(m)]
LINKS = [(a, b, kind) for kind, x, y, n in (("CONTAINS", "p", "s", 7), ("CONTAINS", "p", "c", 9), ("CONTAINS", "c", "f", 12), ("IMPLEMENTS", "s", "i", 16), ("CALLS", "f", "i", 20)) for a, b in ((random.choice([v for v in NAMES if v[0] == x]), random.choice([v for v in NAMES if v[0] == y])) for _ in range(n))]
OUT = {(a, kind): {y for x, y, k in LINKS if (x, k) == (a, kind)} for a, _, kind in LINKS}
of = lambda a, kind, what: [b for b in OUT.get((a, kind), ()) if b[0] == what]


@pytest.fixture(scope="module")
def graph(spark):
    blank = {"span_start": None, "span_end": None, "prov_confidence": 1.0}
    row = lambda schema, **v: tuple((blank | v).get(f.name, "") for f in schema.fields)
    nodes = [row(NODES, id=n, kind=KIND[n[0]], name=f"name {n}") for n in NAMES]
    edges = [row(EDGES, src=a, dst=b, kind=k) for a, b, k in LINKS]
    return Graph(spark.createDataFrame(nodes, NODES).cache(), spark.createDataFrame(edges, EDGES).cache())


def rows(graph, text):
    return sorted(map(tuple, plan(graph, text).collect()))


AROUND = "MATCH (p:Package)-[:CONTAINS]->(s:Service)-[:IMPLEMENTS]->(i:Interface)<-[:CALLS]-(f:Function)<-[:CONTAINS]-(c:Class)<-[:CONTAINS]-(p)"
RINGS = sorted((p, s, i, f, c) for p in NAMES if p[0] == "p" for s in of(p, "CONTAINS", "s") for i in of(s, "IMPLEMENTS", "i") for c in of(p, "CONTAINS", "c") for f in of(c, "CONTAINS", "f") if i in of(f, "CALLS", "i"))


def test_rings_are_counted_and_shown_as_they_are(graph):
    count = lambda at: sorted((k, sum(r[at] == k for r in RINGS)) for k in {r[at] for r in RINGS})
    assert len(RINGS) > 5 and rows(graph, AROUND + " RETURN p, s, i, f, c") == RINGS
    assert rows(graph, AROUND + " RETURN p, count(*) AS n") == count(0)
    assert rows(graph, AROUND + " RETURN f, count(s) AS n") == count(3)
    assert rows(graph, AROUND + " RETURN count(*) AS n") == [(len(RINGS),)]
    assert rows(graph, AROUND + ' WHERE c.name <> "name c1" AND NOT s.name = "name s0" RETURN i, count(*) AS n') == sorted((i, n) for i in {r[2] for r in RINGS} if (n := sum(r[2] == i and r[4] != "c1" and r[1] != "s0" for r in RINGS)))


def test_a_ring_is_walked_from_both_ends(graph):
    first, back = Planner._halves(parse(AROUND + " RETURN count(*) AS n").match[0])
    assert [n.var for n in first.nodes] == ["p", "s", "i"] and [n.var for n in back.nodes] == ["p", "c", "f", None]
    assert Planner._halves(parse("MATCH (a)-[:CALLS]->(b)-[:CALLS*1..2]->(c)-[:CALLS]->(a) RETURN count(*) AS n").match[0]) is None


APART = "MATCH (p:Package)-[:CONTAINS]->(s:Service), (p)-[:CONTAINS]->(c:Class)"
PRODUCT = [(p, s, c) for p in NAMES if p[0] == "p" for s in of(p, "CONTAINS", "s") for c in of(p, "CONTAINS", "c")]


def test_distinct_aggregates_of_several_patterns(graph):
    ids = sorted({p for p, _, _ in PRODUCT})
    distinct = lambda at, p, keep=lambda r: True: len({r[at] for r in PRODUCT if r[0] == p and keep(r)})
    assert rows(graph, APART + " RETURN p, count(DISTINCT s) AS n, count(DISTINCT c) AS m") == [(p, distinct(1, p), distinct(2, p)) for p in ids]
    assert rows(graph, APART + " RETURN p.name AS name, min(s.name) AS low, max(p.name) AS own, count(DISTINCT c) AS m") == sorted((f"name {p}", f"name {min(r[1] for r in PRODUCT if r[0] == p)}", f"name {p}", distinct(2, p)) for p in ids)
    some = lambda r: r[1] != "s1" and bool(of(r[2], "CONTAINS", "f"))
    assert rows(graph, APART + ' WHERE s.name <> "name s1" AND (c)-[:CONTAINS]->(:Function) RETURN p, count(DISTINCT s) AS n') == [(p, n) for p in ids if (n := distinct(1, p, some))]
    either = lambda r: r[1] == "s1" or r[2] == "c1"
    assert rows(graph, APART + ' WHERE s.name = "name s1" OR c.name = "name c1" RETURN p, count(DISTINCT s) AS n, count(DISTINCT c) AS m') == [(p, n, distinct(2, p, either)) for p in ids if (n := distinct(1, p, either))]
    assert rows(graph, APART + ", (c)-[:CONTAINS]->(f:Function) RETURN count(DISTINCT f) AS n, count(DISTINCT s) AS m") == [(len({f for _, _, c in PRODUCT for f in of(c, "CONTAINS", "f")}), len({s for _, s, c in PRODUCT if of(c, "CONTAINS", "f")}))]


def test_distinct_aggregates_need_no_product(graph):
    bound = Planner(graph, parse(APART + " RETURN p, count(DISTINCT s) AS n, count(DISTINCT c) AS m")).bindings()
    assert bound.count() == len({r[:2] for r in PRODUCT}) + len({(r[0], r[2]) for r in PRODUCT}) < len(PRODUCT)
