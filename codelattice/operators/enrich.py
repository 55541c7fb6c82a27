"""Design-pattern candidates by structure, their judgement by a pluggable model, and what becomes of it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelattice.functions.text import base_names

TAXONOMY = ("Adapter", "Builder", "Controller", "DTO", "Decorator", "Facade", "Factory", "Observer", "Repository", "Service", "Singleton", "Strategy", "ValueObject")
ROLE_SUFFIXES = {
    "Adapter": "Adapter", "Builder": "Builder", "Controller": "Controller|Handler|Resource|View", "Decorator": "Decorator", "Facade": "Facade",
    "Factory": "Factory", "Observer": "Listener|Observer|Subscriber", "Repository": "DAO|Repo|Repository|Store", "Service": "Interactor|Service|UseCase", "Strategy": "Policy|Strategy",
}
BROAD_SUFFIXES = {"Adapter": "Client|Gateway|Proxy|Wrapper", "Service": "Coordinator|Engine|Manager|Provider"}
CRUD = sorted("add all create delete fetch find get insert list load query remove save store update".split())
OBSERVER = sorted("emit notify register subscribe unsubscribe update".split())
FACTORY_VERB = "^(build|create|from_|make|new|of)"
TRIVIAL_BASES = "ABC BaseException BaseModel Dict Enum Exception Generic IntEnum List NamedTuple Protocol Set StrEnum Tuple TypedDict dict list object set tuple".split()
FLOOR, BATCH = 0.7, 6


def _ending(ends: str) -> Callable[[Column], Column]:
    return lambda b: b.rlike(f"(?i)({ends})$")


def _names(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def nominate(symbols: DataFrame, broad: bool = False) -> DataFrame:
    """(id, patterns) of classes and functions (id, kind, name, signature, methods array) that look like a pattern."""
    lower, is_class = F.transform("methods", F.lower), F.col("kind") == "Class"
    bases = base_names(F.col("signature"))
    tests: dict[str, list[Column]] = {p: [] for p in TAXONOMY}
    for suffixes in (ROLE_SUFFIXES, BROAD_SUFFIXES if broad else {}):
        for pattern, ends in suffixes.items():
            tests[pattern].append(is_class & F.col("name").rlike(f"(?i)({ends})$"))
    for pattern, ends in ROLE_SUFFIXES.items():
        tests[pattern].append(is_class & F.exists(bases, _ending(ends)))
    tests["Repository"].append(is_class & (F.size(F.array_intersect(lower, _names(CRUD))) >= (1 if broad else 2)))
    tests["Factory"] += [is_class & F.exists(lower, lambda m: m.rlike(FACTORY_VERB)), (F.col("kind") == "Function") & F.lower("name").rlike(FACTORY_VERB)]
    tests["Builder"].append(is_class & F.array_contains(lower, "build") & F.exists(lower, lambda m: m.rlike("^(with|set|add)_")))
    tests["Singleton"].append(is_class & F.arrays_overlap(lower, _names(["get_instance", "instance"])))
    tests["Observer"].append(is_class & F.arrays_overlap(lower, _names(OBSERVER)))
    behaves = F.exists("methods", lambda m: ~m.startswith("__"))
    dto, value = F.col("name").rlike("(?i)dto$"), F.col("name").rlike("(?i)(valueobject|vo)$")
    data_only = is_class & ~behaves & ((F.size("methods") > 0) | dto | value)
    tests["DTO"].append(data_only & dto)
    tests["ValueObject"].append(data_only & ~dto)
    if broad:
        tests["Strategy"].append(is_class & behaves & (F.size(F.array_except(bases, _names(TRIVIAL_BASES))) > 0))
    any_of = lambda cs: F.coalesce(F.greatest(*cs) if len(cs) > 1 else cs[0], F.lit(False))
    found = F.filter(F.array(*(F.when(any_of(cs), F.lit(p)) for p, cs in tests.items() if cs)), lambda p: p.isNotNull())
    return symbols.where(F.col("kind").isin("Class", "Function")).select("id", F.array_sort(found).alias("patterns")).where("size(patterns) > 0")


#: Judges take a frame with id and pattern and return it with ``confidence`` and ``cost``.
Judge = Callable[[pd.DataFrame], pd.DataFrame]


def scripted_judge(table: dict[str, float], default: float = 0.0, cost: float = 0.0) -> Judge:
    """A judge without a model: a confidence for each pattern."""
    return lambda frame: frame.assign(confidence=frame["pattern"].map(table).fillna(default), cost=cost)


def judged(candidates: DataFrame, judge: Judge, floor: float = FLOOR, budget: float | None = None, batch: int = BATCH) -> DataFrame:
    """(id, pattern, confidence, cost) of judged candidates (id, patterns) at or above ``floor``.

    With a ``budget`` the batches, in order of id, are judged until their cost reaches it; a batch that began is finished.
    """
    pairs = candidates.select("id", F.explode("patterns").alias("pattern"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield judge(frame)

    out = pairs.mapInPandas(run, "id string, pattern string, confidence double, cost double")
    if budget is not None:
        # Batches are numbered by id over the candidates, which are few: they went through nomination.
        ids = candidates.select("id").distinct().withColumn("batch", F.floor((F.row_number().over(Window.orderBy("id")) - 1) / batch))
        costs = out.join(ids, "id").groupBy("batch").agg(F.sum("cost").alias("spent"))
        before = F.coalesce(F.sum("spent").over(Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        within = costs.withColumn("before", before).where(F.col("before") < budget).select("batch")
        out = out.join(ids, "id").join(within, "batch").select("id", "pattern", "confidence", "cost")
    return out.where(F.col("confidence") >= floor).withColumn("confidence", F.round("confidence", 4))


def tag_edges(tags: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """PatternTag nodes and TAGGED edges of judged tags, as rows of the graph's tables."""
    tag_id = F.concat(F.lit("lat pattern taxonomy v1 "), F.col("pattern"), F.lit("#"))
    provenance = [F.lit("llm").alias("prov_source"), F.lit(model).alias("prov_extractor"), F.lit("").alias("prov_commit"), F.col("confidence").alias("prov_confidence"), F.lit("").alias("origin_path")]
    nodes = tags.groupBy("pattern").agg(F.max("confidence").alias("confidence")).select(tag_id.alias("id"), F.lit("PatternTag").alias("kind"), F.col("pattern").alias("name"), F.lit(None).cast("long").alias("span_start"), F.lit(None).cast("long").alias("span_end"), F.lit("{}").alias("attrs"), F.lit("v1").alias("sym_path"), *provenance)
    edges = tags.select(F.col("id").alias("src"), tag_id.alias("dst"), F.lit("TAGGED").alias("kind"), F.lit("{}").alias("attrs"), *provenance, F.lit("").alias("resolved_from"))
    return nodes, edges


def summaries(files: DataFrame, summarize: Callable[[pd.Series], pd.Series], repository: str) -> DataFrame:
    """Two levels of summaries: of each file (path, text), and of the repository from those of its files in order of path."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"path": frame["path"], "summary": summarize(frame["text"])})

    low = files.select("path", "text").mapInPandas(run, "path string, summary string")
    joined = low.agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("path", "summary"))), lambda s: F.concat(s["path"], F.lit(": "), s["summary"]))).alias("text"))
    high = joined.select(F.lit(repository).alias("path"), "text").mapInPandas(run, "path string, summary string")
    return low.withColumn("level", F.lit("file")).union(high.withColumn("level", F.lit("repository")))


def summary_rows(made: DataFrame, graph, repo: str, model: str) -> tuple[DataFrame, DataFrame]:
    """Summary nodes and SUMMARIZES edges of ``summaries``, as rows of the graph's tables; the repository's own is about its Repository node, if there is one."""
    from codelattice.extract.rows import SCHEME, shaped
    from codelattice.functions.text import escaped
    from codelattice.model import EDGES, NODES

    node = F.concat_ws(" ", F.lit(SCHEME), F.lit("summary"), F.lit(repo), escaped(F.col("path")), F.concat("level", F.lit(".")))
    rows = made.withColumn("id", node)
    prov = {"prov_source": F.lit("llm"), "prov_extractor": F.lit(model), "prov_commit": F.lit(""), "prov_confidence": F.lit(1.0), "origin_path": F.lit("")}
    attrs = F.to_json(F.struct("level", "path", F.col("summary").alias("text")))
    nodes = shaped(rows, NODES, kind=F.lit("Summary"), name=F.col("path"), span_start=F.lit(None), span_end=F.lit(None), attrs=attrs, sym_path=F.col("path"), **prov)
    targets = graph.nodes.where("kind in ('File', 'Repository')").select(F.when(F.col("kind") == "File", F.col("sym_path")).otherwise(F.lit(repo)).alias("path"), F.col("id").alias("dst"))
    edges = shaped(rows.select(F.col("id").alias("src"), "path").join(targets, "path").select("src", "dst"), EDGES, kind=F.lit("SUMMARIZES"), attrs=F.lit("{}"), resolved_from=F.lit(""), **prov)
    return nodes, edges


def scripted_summarizer(words: int = 12) -> Callable[[pd.Series], pd.Series]:
    """A summariser without a model: the first words."""
    return lambda texts: texts.fillna("").map(lambda t: " ".join(t.split()[:words]))


def scripted_matcher(table: dict[tuple[str, str], float], cost: float = 0.0) -> Judge:
    """A matcher without a model: a confidence for each (id, target)."""
    return lambda frame: frame.assign(confidence=[table.get(k, 0.0) for k in zip(frame["id"], frame["target"], strict=True)], cost=cost)


def inferred_governs(decisions: DataFrame, candidates: DataFrame, matcher: Judge, floor: float = FLOOR) -> DataFrame:
    """(id, target, confidence, cost) of decisions (id) with the candidates (id) that a matcher says they govern.

    Candidates are few (``first_candidates``), so each decision carries all of them as one array.
    """
    every = candidates.agg(F.array_sort(F.collect_list("id")).alias("targets"))
    pairs = decisions.select("id").join(every, F.lit(True)).select("id", F.explode("targets").alias("target"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield matcher(frame)

    return pairs.mapInPandas(run, "id string, target string, confidence double, cost double").where(F.col("confidence") >= floor)


def candidate_batches(candidates: DataFrame, size: int = BATCH) -> DataFrame:
    """``candidates`` (id) with ``batch``: numbers of batches in order of id."""
    return candidates.withColumn("batch", F.floor((F.row_number().over(Window.orderBy("id")) - 1) / size))


def ungoverned(decisions: DataFrame, edges: DataFrame) -> DataFrame:
    """Decisions (id) of which no GOVERNS edge was read from their text, so that a model may infer some."""
    known = edges.where("kind = 'GOVERNS' and prov_source <> 'llm'").select(F.col("src").alias("id"))
    return decisions.join(known, "id", "left_anti")
