"""One repository's code graph from end to end: index and refresh it, fill in what documents, history and models know, and ask it.

Everything is kept in snapshots of one store: the graph, the facts that it was made from, the manifest of files, vectors,
events and aggregates.  Extraction runs once a file and version; the rest are joins.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelattice.cypher import engine
from codelattice.cypher.schema import describe
from codelattice.extract import chunks as chunking
from codelattice.extract.packs import fingerprints
from codelattice.extract.resolve import Resolver
from codelattice.extract.rows import FACTS, extracted, graph_of, shaped
from codelattice.extract.stitches import stitch
from codelattice.lineage import cut
from codelattice.model import EDGES, EVENTS, NODES, SYMBOL_KINDS, Graph
from codelattice.operators import enrich, graphs, incremental, knowledge, retrieve, store, temporal, verbs
from codelattice.operators.enrich import FLOOR
from codelattice.sources import git, repository, workspace

VECTORS = "ref string, vector array<float>, kind string, path string, attrs string"
DIRTY = "consumer string, id string"
MANIFEST = "path string, content_hash string"
CONSUMERS = ("embed", "patterns", "summaries")


@dataclass
class Report:
    """What a run did: files extracted and removed, totals by kind, and counts of the resolution."""

    files: int = 0
    removed: int = 0
    counts: dict[str, int] = field(default_factory=dict)
    stats: dict[str, int] = field(default_factory=dict)
    seconds: float = 0.0


def changed_graph(old: Graph, parsed: Graph, gone: DataFrame) -> Graph:
    """``old`` without what the files in ``gone`` (path) own, and with the newly parsed files: a node that vanishes takes all its edges along, one that stays keeps those of other files."""
    paths = gone.select(F.col("path").alias("origin_path")).distinct()
    nodes = old.nodes.join(paths, "origin_path", "left_anti").select(*NODES.names).join(parsed.nodes.select("id"), "id", "left_anti").union(parsed.nodes.select(*NODES.names))
    nodes = cut(nodes)
    edges = old.edges.join(paths, "origin_path", "left_anti").select(*EDGES.names).union(parsed.edges.select(*EDGES.names))
    return Graph(nodes, cut(store.with_endpoints(edges, nodes)))


def scope_of(changed: DataFrame, *imports: DataFrame) -> DataFrame:
    """(path): changed files and all that import them, however far; imports are (path, target path), of before and after."""
    links = cut(reduce(DataFrame.union, [i.select("path", "target") for i in imports]).distinct())
    scope = frontier = cut(changed.select("path").distinct())
    while not frontier.isEmpty():
        step = links.join(frontier.select(F.col("path").alias("target")), "target", "left_semi").select("path").distinct()
        frontier = cut(step.join(scope, "path", "left_anti"))
        scope = scope.union(frontier)
    return scope


class CodeGraph:
    """``CodeGraph.open(spark, root)``; verbs that write make a new snapshot, verbs that ask return DataFrames."""

    def __init__(self, spark: SparkSession, root: str, store_path: str | None = None, read_only: bool = False, repo: str | None = None, **settings: dict) -> None:
        self.spark, self.root = spark, os.path.abspath(root)
        self.settings = workspace.settings_of(self.root, **settings)
        if wrong := workspace.problems(self.settings):
            raise ValueError("; ".join(wrong))
        self.repo = repo or os.path.basename(self.root)
        self.store = store.SnapshotStore(spark, store_path or workspace.store_root(self.root), read_only)

    open = classmethod(lambda cls, *args, **kwargs: cls(*args, **kwargs))

    # Reading ----------------------------------------------------------------

    @property
    def graph(self) -> Graph:
        return self.store.read()

    def _table(self, name: str, schema: str | object) -> DataFrame:
        found = self.store.table(name)
        return self.spark.createDataFrame([], schema) if found is None else found

    @property
    def vectors(self) -> DataFrame:
        return self._table("vectors", VECTORS)

    @property
    def events(self) -> DataFrame:
        return self._table("events", EVENTS)

    @property
    def manifest(self) -> DataFrame:
        return self._table("manifest", MANIFEST)

    def _write(self, graph: Graph, tables: dict[str, DataFrame], **meta: object) -> None:
        before = self.store.current() or {}
        kept = {n: self.store.table(n) for n in before.get("tables", ()) if n not in tables}
        inherited = {k: v for k, v in before.items() if k not in ("schema", "snapshot", "tables")}
        self.store.write(graph, kept | tables, **(inherited | meta))

    def _commit(self) -> str:
        try:
            return git.head(self.root)
        except (RuntimeError, OSError):
            return ""

    # Indexing ---------------------------------------------------------------

    def files(self) -> DataFrame:
        """The source files of the working tree."""
        index = self.settings["index"]
        return repository.source_files(self.spark, self.root, index["include"], [*repository.EXCLUDED, *index["exclude"]], index["most_kb"])

    def frameworks(self, files: DataFrame) -> list[str]:
        return repository.active_frameworks(files, repository.dependencies(self.root), self.settings["index"]["frameworks"])

    def index(self) -> Report:
        """A full index, in place of what the store had; events of symbols are added to the log."""
        began = time.monotonic()
        files = self.files().where("not skipped")
        packs, commit = self.frameworks(files), self._commit()
        facts = cut(extracted(files, self.repo, packs))
        resolved = Resolver(facts, repository.go_module(self.root), commit).resolved()
        parsed = graph_of(facts, commit)
        whole = store.add(Graph(parsed.nodes, parsed.edges), resolved.graph.nodes)
        whole = whole.with_edges(whole.edges.select(*EDGES.names).union(resolved.graph.edges))
        done = stitch(whole, facts.where("rel = 'relation'"))
        before = self.graph.nodes.where(F.col("kind").isin(*SYMBOL_KINDS)).select("id")
        events = self._recorded(before, done.graph.nodes.where(F.col("kind").isin(*SYMBOL_KINDS)).select("id"), commit)
        tables = {"facts": facts, "manifest": files.select("path", "content_hash"), "events": events}
        self._write(done.graph, tables, indexed_commit=commit, packs=fingerprints(), frameworks=packs)
        return self._report(facts.select("path").distinct().count(), 0, resolved.stats.union(done.stats), began)

    def _recorded(self, before: DataFrame, after: DataFrame, commit: str) -> DataFrame:
        log = self.events
        if not self.settings["temporal"]["enabled"]:
            return log
        ts = int(git.git(self.root, "show", "-s", "--format=%ct", commit)) if commit else int(time.time())
        return temporal.record(log, incremental.lifecycle(before, after, commit or "working-tree", ts))

    def _report(self, files: int, removed: int, stats: DataFrame, began: float) -> Report:
        counts = {f"{r['what']}:{r['kind']}": r["n"] for r in verbs.kind_counts(self.graph).collect()}
        return Report(files, removed, counts, {r["what"]: r["n"] for r in stats.groupBy("what").agg(F.sum("n").alias("n")).collect()}, time.monotonic() - began)

    def changes(self, files: DataFrame | None = None) -> DataFrame:
        """(path, status, old_path) of the working tree against the manifest."""
        now = (self.files().where("not skipped") if files is None else files).select("path", "content_hash")
        return incremental.changes(now, self.manifest)

    def refresh(self, files: DataFrame | None = None) -> Report:
        """Brings the store to the working tree: only changed files are extracted, and only they and what imports them resolved anew.  The graph is that of a full index."""
        pointer, began = self.store.current(), time.monotonic()
        if pointer is None or incremental.packs_changed(pointer.get("packs", {}), fingerprints()):
            return self.index()
        files = self.files().where("not skipped") if files is None else files
        changed = cut(self.changes(files))
        if changed.isEmpty():
            return Report(seconds=time.monotonic() - began)
        commit, packs = self._commit(), self.frameworks(files)
        if packs != pointer.get("frameworks"):
            return self.index()
        touched, removed = cut(incremental.touched(changed)), cut(incremental.removed(changed))
        gone = cut(touched.union(removed).distinct())
        old_facts, old = self._table("facts", FACTS), self.graph
        fresh = cut(extracted(files.join(touched, "path", "left_semi"), self.repo, packs))
        facts = cut(old_facts.join(gone, "path", "left_anti").select(*fresh.columns).union(fresh))
        base = changed_graph(old, graph_of(fresh, commit), gone)
        resolver = Resolver(facts, repository.go_module(self.root), commit)
        before = old.edges.where("kind = 'IMPORTS'").select(F.col("origin_path").alias("path"), F.col("dst").alias("id")).join(old.nodes.where("kind = 'File'").select("id", F.col("sym_path").alias("target")), "id")
        after = resolver.inside.select("path", F.col("target").alias("file")).join(resolver.files.select("file", F.col("path").alias("target")), "file")
        same_module = resolver.files.where("slug = 'go'").select("family", "module", F.col("path").alias("target"))  # files of one package see each other
        siblings = same_module.withColumnRenamed("target", "path").join(same_module, ["family", "module"]).where("path <> target")
        scope = cut(scope_of(gone, before, after, siblings))
        resolved = resolver.resolved(scope)
        cleared = store.clear_resolved(base, scope)
        whole = store.add(cleared, resolved.graph.nodes)
        whole = whole.with_edges(whole.edges.select(*EDGES.names).union(resolved.graph.edges))
        done = stitch(whole, facts.where("rel = 'relation'"))
        inside = lambda g: g.nodes.where(F.col("kind").isin(*SYMBOL_KINDS)).join(gone.withColumnRenamed("path", "sym_path"), "sym_path", "left_semi").select("id")
        was, now = cut(inside(old)), cut(inside(done.graph))
        dirty = incremental.mark_dirty(self._table("dirty", DIRTY), incremental.dirty_after(was.union(now), done.graph.edges), list(CONSUMERS))
        vectors = self.vectors.join(removed, "path", "left_anti")
        tables = {"facts": facts, "manifest": files.select("path", "content_hash"), "events": self._recorded(was, now, commit), "dirty": dirty, "vectors": vectors.select("ref", "vector", "kind", "path", "attrs")}
        self._write(done.graph, tables, indexed_commit=commit, packs=fingerprints(), frameworks=packs)
        return self._report(touched.count(), removed.count(), resolved.stats.union(done.stats), began)

    # Embedding, documents, history, models ----------------------------------

    def embed(self, embedder: chunking.Embedder | None = None) -> dict[str, int]:
        """Chunks and vectors of changed code, and of documents if any has changed."""
        how, dimension = self.settings["chunking"], self.settings["embed"]["dimension"]
        graph, meta = self.graph, self.store.current() or {}
        found = cut(chunking.chunked(self.files().where("not skipped"), graph.nodes, self.repo, how["max_tokens"], how["min_tokens"]))
        changed = cut(chunking.changed_chunks(found, graph))
        graph, vectors = chunking.embed_code(graph, self.vectors, found, embedder, dimension)
        vectors, print_ = chunking.embed_documents(graph, vectors, meta.get("documents", ""), embedder, dimension)
        self._write(graph, {"vectors": vectors}, documents=print_)
        return {"chunks": found.count(), "embedded": changed.count(), "vectors": self.vectors.count()}

    def learn(self, commits: bool = True) -> None:
        """Decisions, documents and commit messages of the repository."""
        records = repository.decision_files(self.spark, self.root)
        graph = knowledge.with_knowledge(self.graph, records, repository.documents(self.spark, self.root), self.repo)
        if commits and self._commit():
            graph = knowledge.with_commits(graph, git.messages(self.spark, self.root), self.repo)
        self._write(graph, {})

    def mine(self, now: int | None = None) -> None:
        """Churn and authors of symbols from the log of git, also as attributes of their nodes."""
        now = int(time.time()) if now is None else now
        graph = self.graph
        spans = graph.nodes.where(F.col("kind").isin(*SYMBOL_KINDS) & F.col("span_start").isNotNull()).select(F.col("id").alias("symbol_id"), F.col("sym_path").alias("path"), "span_start", "span_end")
        touches = temporal.overlapping(git.hunks(self.spark, self.root), spans)
        aggregates = cut(temporal.churn(touches, now))
        self._write(temporal.denormalised(graph, aggregates), {"aggregates": aggregates})

    def backfill(self, history: int | None = None) -> int:
        """Events of symbols from the last ``history`` commits, read as one distributed job; how many were new."""
        done = git.commits(self.root, self.settings["temporal"]["history"] if history is None else history)
        found = temporal_events(self.spark, self.root, done, self.repo)
        log = self.events
        after = cut(temporal.record(log, found))
        self._write(self.graph, {"events": after}, backfilled_through=done[-1][0] if done else "")
        return after.count() - log.count()

    def enrich(self, judge: enrich.Judge, floor: float = FLOOR, budget: float | None = None, broad: bool = False, model: str = "judge@1") -> int:
        """Design patterns of classes and functions; how many tags there are."""
        graph = self.graph
        methods = graph.edges.where("kind = 'CONTAINS'").join(graph.nodes.where("kind = 'Method'").select(F.col("id").alias("dst"), "name"), "dst").groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("name")).alias("methods"))
        symbols = graph.nodes.where(F.col("kind").isin("Class", "Function")).select("id", "kind", "name", F.coalesce(F.get_json_object("attrs", "$.signature"), F.lit("")).alias("signature"))
        symbols = symbols.join(methods, "id", "left").withColumn("methods", F.coalesce("methods", F.array().cast("array<string>")))
        tags = cut(enrich.judged(enrich.nominate(symbols, broad), judge, floor, budget))
        nodes, edges = enrich.tag_edges(tags, model)
        base = store.clear_outgoing(graph, symbols.select("id"), "TAGGED")
        dirty = incremental.mark_clean(self._table("dirty", DIRTY), "patterns", symbols.select("id"))
        self._write(store.add(base, nodes, edges), {"dirty": dirty})
        return tags.count()

    def summarize(self, summarizer: Callable, model: str = "summarizer@1") -> None:
        """Summaries of each file and of the repository."""
        made = cut(enrich.summaries(self.files().where("not skipped"), summarizer, self.repo))
        nodes, edges = enrich.summary_rows(made, self.graph, self.repo, model)
        base = self.graph
        old = base.nodes.where("kind = 'Summary'").select("id")
        base = Graph(base.nodes.join(old, "id", "left_anti").select(*NODES.names), store.clear_outgoing(base, old, "SUMMARIZES").edges)
        dirty = incremental.mark_clean(self._table("dirty", DIRTY), "summaries", base.nodes.select("id"))
        self._write(store.add(base, nodes, edges), {"dirty": dirty})

    def infer_governs(self, matcher: enrich.Judge, floor: float = FLOOR, most: int = 60) -> int:
        """GOVERNS edges that a model infers for decisions whose text names none; how many."""
        graph = self.graph
        open_ = enrich.ungoverned(graph.nodes.where("kind = 'Decision'"), graph.edges)
        found = cut(enrich.inferred_governs(open_, verbs.first_candidates(graph.nodes.where(F.col("kind").isin("Class", "Interface")), most), matcher, floor))
        edges = shaped(found, EDGES, src=F.col("id"), dst=F.col("target"), kind=F.lit("GOVERNS"), attrs=F.lit("{}"), prov_source=F.lit("llm"), prov_extractor=F.lit("matcher@1"), prov_commit=F.lit(""), prov_confidence=F.col("confidence"), origin_path=F.lit(""), resolved_from=F.lit(""))
        self._write(store.add(graph, None, edges), {})
        return found.count()

    # Asking -----------------------------------------------------------------

    def query(self, text: str, **bounds: object) -> engine.Result:
        q = self.settings["query"]
        given = {"max_rows": q["max_rows"], "timeout_ms": q["timeout_ms"], "max_expansions": q["max_expansions"], "enabled": q["enabled"]} | bounds
        return engine.run(self.graph, text, engine.Bounds(**given))

    schema = staticmethod(describe)

    def routes(self, method: str = "", path: str = "") -> DataFrame:
        return verbs.routes(self.graph, method, path)

    def service_calls(self) -> DataFrame:
        return verbs.service_calls(self.graph)

    def models(self) -> DataFrame:
        return verbs.models(self.graph)

    def services(self) -> DataFrame:
        return verbs.services(self.graph)

    def decisions(self, scope: str = "", status: str = "") -> DataFrame:
        return verbs.decisions(self.graph, scope, status)

    def tagged(self, pattern: str, least: float = 0.7) -> DataFrame:
        return verbs.tagged(self.graph, pattern, least)

    def summaries(self, level: str | None = None) -> DataFrame:
        return verbs.summaries(self.graph, level)

    def history(self, symbol: str | None = None) -> DataFrame:
        out = temporal.history(self.events, self.store.table("aggregates"))
        return out if symbol is None else out.where(F.col("symbol_id") == symbol)

    def changed_since(self, ts: int, scope: str | None = None) -> DataFrame:
        aggregates = self.store.table("aggregates")
        mined = None if aggregates is None else aggregates.select("symbol_id", F.col("last_changed_ts").alias("ts"), F.col("last_changed_sha").alias("commit_sha"))
        return temporal.changed_since(self.events, ts, mined).where(temporal.in_scope(F.get(F.split("symbol_id", " "), 3), scope))

    def alive_at(self, ts: int) -> DataFrame:
        return temporal.alive_at(self.events, ts)

    def ranked_symbols(self, k: int = 20, scope: str | None = None, focus: Iterable[str] = ()) -> DataFrame:
        """The ``k`` symbols of the highest rank, with their signatures."""
        graph, focus = self.graph, list(focus)
        personal = graphs.focus(graph, focus, [f for f in focus if " " in f]) if focus else None
        ranked = graphs.ranked_symbols(graph, scope, personal, SYMBOL_KINDS)
        signature = graph.nodes.select("id", F.coalesce(F.get_json_object("attrs", "$.signature"), F.lit("")).alias("signature"))
        return ranked.orderBy(F.desc("rank"), "id").limit(k).join(signature, "id").orderBy(F.desc("rank"), "id")

    def map(self, budget: int = 2000, k: int = 500, scope: str | None = None, focus: Iterable[str] = ()) -> str:
        rows = [{"path": r["sym_path"], "name": r["name"], "signature": r["signature"]} for r in self.ranked_symbols(k, scope, focus).collect()]
        short = {r["path"]: r["text"].split("\n")[0] for r in self.summaries("file").collect()} if self.graph.nodes.where("kind = 'Summary'").limit(1).count() else {}
        return verbs.rendered_map(rows, budget, short)

    def retrieve(self, question: str = "", symbol: str | None = None, mode: str = "context", k: int | None = None, depth: int | None = None, rerank: str | None = None, embedder: chunking.Embedder | None = None, vector: Sequence[float] | None = None, **how: object) -> DataFrame:
        """What answers a question, or surrounds a symbol: (id, kind, name, sym_path, score, depth), best first."""
        own = self.settings["retrieve"]
        k, depth, rerank = own["k"] if k is None else k, own["depth"] if depth is None else depth, own["rerank"] if rerank is None else rerank
        if symbol is not None:
            found = retrieve.retrieve(self.graph, self.vectors, (), k, mode, depth, symbols=self.spark.createDataFrame([(symbol,)], "id string"), **how)
        else:
            if vector is None:
                row = chunking.embedded(self.spark.createDataFrame([(question,)], "text string"), embedder, self.settings["embed"]["dimension"]).first()
                vector = row["vector"]
            from codelattice.functions.text import is_architectural

            broad = self.spark.range(1).select(is_architectural(F.lit(question)).alias("b")).first()[0]
            found = retrieve.retrieve(self.graph, self.vectors, vector, k, mode, depth, architectural=bool(broad), **how)
        if rerank in ("lexical", True) and question:
            return retrieve.rerank_lexical(found, question, F.concat_ws(" ", "name", "sym_path"))
        return found

    def impact(self, symbol: str, depth: int = 3) -> DataFrame:
        found = graphs.impact(self.graph, [symbol], depth)
        return self.graph.nodes.join(found, "id").select("id", "kind", "name", "sym_path", "score", "depth").orderBy(F.desc("score"), "id")

    def neighbors(self, symbol: str, depth: int = 1, kinds: Iterable[str] | None = None) -> DataFrame:
        return graphs.edges_within(self.graph, [symbol], depth, kinds).orderBy("kind", "src", "dst")

    def explain(self, symbol: str) -> dict:
        """A symbol with its file's summary, its tags and its edges."""
        graph = self.graph
        node = store.get(graph, [symbol]).first()
        if node is None:
            return {"symbol_id": symbol, "name": "", "kind": "", "summary": "", "tags": [], "facts": []}
        about = verbs.summaries(graph, "file").where(F.col("path") == node["sym_path"]).first()
        listed = lambda df: [r.asDict() for r in df.limit(1000).collect()]
        return {"symbol_id": symbol, "name": node["name"], "kind": node["kind"], "summary": about["text"] if about else "", "tags": listed(verbs.tags_of(graph, symbol)), "facts": listed(verbs.facts(graph, symbol))}

    def staleness(self) -> dict:
        meta, head = self.store.current() or {}, self._commit()
        indexed = meta.get("indexed_commit", "")
        return {"indexed_commit": indexed, "dirty": bool(head and indexed and head != indexed)}

    def status(self) -> dict:
        """Totals by kind, vectors, events, frameworks and how fresh the index is."""
        meta = self.store.current() or {}
        counts: dict[str, dict[str, int]] = {"node": {}, "edge": {}}
        for r in verbs.kind_counts(self.graph).collect():
            counts[r["what"]][r["kind"]] = r["n"]
        return {"nodes": counts["node"], "edges": counts["edge"], "vectors": self.vectors.count(), "events": self.events.count(), "frameworks": meta.get("frameworks", []), "backfilled_through": meta.get("backfilled_through", ""), **self.staleness()}


def symbol_versions(spark: SparkSession, root: str, done: list[tuple[str, int]], repo: str) -> DataFrame:
    """(seq, commit_sha, ts, path, symbols): the sorted symbols of each file that a commit touches, after it; none where it is removed.  The first commit of the list is the state before."""
    rows = []
    for seq, (sha, ts) in enumerate(done):
        for path, status, old in git.changed_paths(root, done[seq - 1][0] if seq else None, sha):
            rows.append((seq, sha, ts, path, status != "removed"))
            if old:
                rows.append((seq, sha, ts, old, False))
    versions = spark.createDataFrame(rows, "seq int, commit_sha string, ts long, path string, there boolean")
    return versions.repartition(max(1, len(rows) // 200), "seq", "path").mapInArrow(_reading(root, repo), "seq int, commit_sha string, ts long, path string, symbols array<string>")


def _reading(root: str, repo: str):
    import pyarrow as pa

    from codelattice.extract.packs import pack_of
    from codelattice.extract.rows import facts_of

    def run(batches):
        for batch in batches:
            rows, wanted = batch.to_pylist(), []
            for r in rows:
                r["symbols"] = []
                if r.pop("there") and pack_of(r["path"]) and "\n" not in r["path"]:
                    wanted.append(r)
            data = git.git(root, "cat-file", "--batch", data="".join(f"{r['commit_sha']}:{r['path']}\n" for r in wanted).encode()) if wanted else b""
            at = 0
            for r in wanted:
                end = data.index(b"\n", at)
                head = data[at:end].split()
                at = end + 1
                if head[-1] == b"missing" or head[1] != b"blob":
                    continue
                size = int(head[2])
                text = data[at : at + size].decode(errors="replace")
                at += size + 1
                r["symbols"] = sorted({f["id"] for f in facts_of(r["path"], text, repo) if f["rel"] == "node" and f["kind"] in SYMBOL_KINDS})
            rows = [r for r in rows if pack_of(r["path"])]
            kinds = [("seq", pa.int32()), ("commit_sha", pa.string()), ("ts", pa.int64()), ("path", pa.string()), ("symbols", pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in kinds], [n for n, _ in kinds])

    return run


def temporal_events(spark: SparkSession, root: str, done: list[tuple[str, int]], repo: str) -> DataFrame:
    """Events of symbols over a list of commits, oldest first, of which the first only gives the state before: each version of a file against the one before it."""
    if not done:
        return spark.createDataFrame([], EVENTS)
    versions = symbol_versions(spark, root, done, repo)
    before = F.coalesce(F.lag("symbols").over(Window.partitionBy("path").orderBy("seq")), F.array().cast("array<string>"))
    steps = versions.withColumn("before", before).where("seq > 0" if len(done) > 1 else "true")
    event = lambda symbols, name: steps.select(F.explode(symbols).alias("symbol_id"), F.lit("symbol").alias("entity"), F.lit(name).alias("event"), "commit_sha", "ts", F.lit(None).cast("string").alias("ref"))
    opened, closed = event(F.array_except("symbols", "before"), "opened"), event(F.array_except("before", "symbols"), "closed")
    return opened.union(closed).select(*EVENTS.names)
