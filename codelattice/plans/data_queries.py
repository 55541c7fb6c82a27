"""Queries over the tables themselves: events over time, joins, incremental work, functions, documents and stream twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.functions import text
from codelattice.operators import federation, incremental, knowledge, retrieve, temporal, verbs
from codelattice.plans.registry import query
from codelattice.plans.tables import read
from codelattice.streaming import watch

# Time -------------------------------------------------------------------------

_EVENT = "CASE event_type WHEN 'signup' THEN 'opened' WHEN 'error' THEN 'closed' ELSE 'modified' END"
LOG = f"log AS (SELECT CAST(user_id AS VARCHAR) AS symbol_id, {_EVENT} AS event, lpad(CAST(event_id AS VARCHAR), 12, '0') AS commit_sha, epoch_us(ts) // 1000000 AS ts FROM events)"
#: Some time within the events: the 20th of January 2024, as seconds.
T = 1_705_708_800


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "signup", "opened").when(F.col("event_type") == "error", "closed").otherwise("modified")
    return events.select(
        F.col("user_id").cast("string").alias("symbol_id"), F.lit("symbol").alias("entity"), kind.alias("event"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("commit_sha"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"), F.lit(None).cast("string").alias("ref"),
    )


@query(f"WITH {LOG} SELECT symbol_id FROM (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY ts DESC, commit_sha DESC) AS n FROM log WHERE ts <= {T}) WHERE n = 1 AND event <> 'closed'")
def tm_alive_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.alive_at(_log(spark, sf_dir), T)


@query(f"WITH {LOG} SELECT symbol_id, event, ts, commit_sha FROM (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY ts DESC, commit_sha DESC) AS n FROM log WHERE ts > {T}) WHERE n = 1")
def tm_changed_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.changed_since(_log(spark, sf_dir), T)


@query(f"WITH {LOG} SELECT symbol_id, arg_min(commit_sha, (ts, commit_sha)) FILTER (event = 'opened') AS introduced_sha, min(ts) FILTER (event = 'opened') AS introduced_ts, arg_max(commit_sha, (ts, commit_sha)) AS last_changed_sha, max(ts) AS last_changed_ts, count(*) AS events FROM log GROUP BY symbol_id")
def tm_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.history(_log(spark, sf_dir))


@query(f"WITH {LOG}, dead AS (SELECT symbol_id FROM (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY ts DESC, commit_sha DESC) AS n FROM log) WHERE n = 1 AND event = 'closed' AND ts < {T}) SELECT symbol_id, count(*) AS n FROM log WHERE symbol_id NOT IN (FROM dead) GROUP BY symbol_id")
def tm_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.prune(_log(spark, sf_dir), T).groupBy("symbol_id").agg(F.count("*").alias("n"))


@query(f"WITH {LOG} SELECT event, count(*) AS n FROM log GROUP BY event")
def tm_record_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log's second half recorded twice over its first half."""
    log = _log(spark, sf_dir)
    old = log.where(F.col("ts") <= T)
    once = temporal.record(old, log.where(F.col("ts") > T - 86_400))
    return temporal.record(once, log).groupBy("event").agg(F.count("*").alias("n"))


_TOUCH = "touch AS (SELECT CAST(l_partkey AS VARCHAR) AS symbol_id, lpad(CAST(l_orderkey AS VARCHAR), 12, '0') AS commit_sha, CAST(l_suppkey AS VARCHAR) AS author, epoch(l_shipdate)::BIGINT AS ts, l_quantity::BIGINT AS delta FROM lineitem)"


def _touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("symbol_id"), F.lpad(F.col("l_orderkey").cast("string"), 12, "0").alias("commit_sha"), F.col("l_suppkey").cast("string").alias("author"), F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("ts"), F.col("l_quantity").cast("long").alias("delta"))


NOW = 900_000_000


@query(f"""WITH {_TOUCH}, c AS (SELECT symbol_id, author, count(DISTINCT commit_sha) AS commits FROM touch GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY commits DESC, author) AS n FROM c),
 a AS (SELECT symbol_id, string_agg(author || ':' || commits, ',' ORDER BY n) AS authors FROM r WHERE n <= 3 GROUP BY symbol_id)
 SELECT t.symbol_id, sum(CASE WHEN ts >= {NOW} - 30 * 86400 THEN delta ELSE 0 END)::BIGINT AS churn_30d, sum(CASE WHEN ts >= {NOW} - 90 * 86400 THEN delta ELSE 0 END)::BIGINT AS churn_90d, any_value(authors) AS authors,
 arg_min(commit_sha, (ts, commit_sha)) AS introduced_sha, arg_max(commit_sha, (ts, commit_sha)) AS last_changed_sha FROM touch t JOIN a USING (symbol_id) GROUP BY t.symbol_id""")
def tm_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = temporal.churn(_touches(spark, sf_dir), NOW)
    authors = F.array_join(F.transform("top_authors", lambda a: F.concat(a["name"], F.lit(":"), a["commits"].cast("string"))), ",")
    return out.select("symbol_id", "churn_30d", "churn_90d", authors.alias("authors"), "introduced_sha", "last_changed_sha")


@query("""WITH h AS (SELECT l_suppkey AS path, l_linenumber * 10 AS start, CAST(l_quantity AS INTEGER) % 12 AS length FROM lineitem), s AS (SELECT ps AS path, k AS symbol_id, (k % 9) * 8 AS a, (k % 9) * 8 + 6 AS b FROM (SELECT DISTINCT l_suppkey AS ps, l_partkey % 50 AS k FROM lineitem))
 SELECT s.path, symbol_id, count(*) AS hunks, sum(length)::BIGINT AS lines FROM h JOIN s ON h.path = s.path AND h.start <= s.b AND s.a <= h.start + greatest(h.length, 1) - 1 GROUP BY ALL""")
def jn_overlap_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    hunks = line.select(F.col("l_suppkey").alias("path"), (F.col("l_linenumber") * 10).alias("start"), (F.col("l_quantity").cast("int") % 12).alias("length"))
    spans = line.select(F.col("l_suppkey").alias("path"), (F.col("l_partkey") % 50).alias("symbol_id")).distinct().withColumns({"span_start": (F.col("symbol_id") % 9) * 8, "span_end": (F.col("symbol_id") % 9) * 8 + 6})
    return temporal.overlapping(hunks, spans).groupBy("path", "symbol_id").agg(F.count("*").alias("hunks"), F.sum("length").alias("lines"))


# Incremental work ---------------------------------------------------------------


def _manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = read(spark, sf_dir, "part")
    now = part.where("p_size <> 7").select(F.col("p_partkey").cast("string").alias("path"), F.concat("p_brand", F.when(F.col("p_size") > 40, "x").otherwise("")).alias("content_hash"))
    return now, part.where("p_size <> 11").select(F.col("p_partkey").cast("string").alias("path"), F.col("p_brand").alias("content_hash"))


@query("""WITH now AS (SELECT CAST(p_partkey AS VARCHAR) AS path, p_brand || CASE WHEN p_size > 40 THEN 'x' ELSE '' END AS h FROM part WHERE p_size <> 7), was AS (SELECT CAST(p_partkey AS VARCHAR) AS path, p_brand AS h FROM part WHERE p_size <> 11)
 SELECT path, CASE WHEN w.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' ELSE 'modified' END AS status, CAST(NULL AS VARCHAR) AS old_path FROM now n FULL JOIN was w USING (path) WHERE w.h IS DISTINCT FROM n.h""")
def in_manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.changes(*_manifests(spark, sf_dir))


@query("WITH imp AS (SELECT DISTINCT l_orderkey AS path, l_partkey AS target FROM lineitem), s0 AS (SELECT 5 AS path), s1 AS (SELECT path FROM imp WHERE target IN (FROM s0) UNION FROM s0), s2 AS (SELECT path FROM imp WHERE target IN (FROM s1) UNION FROM s1) SELECT path::BIGINT AS path FROM s2")
def in_scope_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hops over all of lineitem: an order imports its parts, and a part's key is the key of an order too."""
    imports = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_partkey").alias("target"))
    return incremental.importers(spark.createDataFrame([(5,)], "path long"), imports, 2)


@query("WITH a AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'P') SELECT CAST(k AS VARCHAR) AS symbol_id, 'opened' AS event FROM (SELECT k FROM b EXCEPT SELECT k FROM a) UNION ALL SELECT CAST(k AS VARCHAR), 'closed' FROM (SELECT k FROM a EXCEPT SELECT k FROM b)")
def in_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("id"), "o_orderstatus")
    return incremental.lifecycle(orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus = 'P'"), "c1", 1).select("symbol_id", "event")


@query("WITH d AS (SELECT c AS consumer, o_custkey AS k FROM orders, (VALUES ('embed'), ('enrich')) t(c)) SELECT consumer, CAST(k AS VARCHAR) AS id FROM d EXCEPT SELECT 'embed', CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'F'")
def in_dirty_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("id"), "o_orderstatus")
    dirty = incremental.mark_dirty(spark.createDataFrame([], "consumer string, id string"), ids, ["embed", "enrich"])
    return incremental.mark_clean(dirty, "embed", ids.where("o_orderstatus = 'F'"))


@query("WITH s AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_returnflag)) AS a FROM lineitem GROUP BY 1), t AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_returnflag)) AS a FROM lineitem WHERE l_linenumber > 1 GROUP BY 1) SELECT s.k AS path FROM s JOIN t ON s.k = t.k AND s.a = t.a")
def ag_hash_set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_returnflag").alias("content_hash"), "l_linenumber")
    return incremental.unchanged_hashes(rows, rows.where("l_linenumber > 1"))


@query("SELECT source AS path, sha256(string_agg(md5(text), '' ORDER BY md5(text))) AS fingerprint FROM documents GROUP BY source")
def ag_doc_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("source").alias("path"), F.md5(F.col("text").cast("binary")).alias("h"))
    return incremental.fingerprint(docs, "path", "h")


# Joins and windows --------------------------------------------------------------


@query("WITH u AS (SELECT p_brand || p_size || p_type AS name, min(p_partkey) AS target FROM part GROUP BY 1 HAVING count(*) = 1) SELECT p_partkey AS id, target FROM part JOIN u ON p_brand || p_size || p_type = name")
def jn_unique_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").withColumn("name", F.concat("p_brand", F.col("p_size").cast("string"), "p_type"))
    names = part.selectExpr("'Class' AS kind", "name", "p_partkey AS id")
    return part.join(knowledge.unique_names(names), "name").select(F.col("p_partkey").alias("id"), "target")


_CALLS = """calls AS (SELECT DISTINCT CAST(page_id % 3 AS VARCHAR) AS caller, 'GET' AS method, regexp_replace(regexp_replace(url, '^[A-Za-z]+://[^/?#]*', ''), '[?#].*$', '') AS path FROM pages),
 routes(callee, route, pattern) AS (VALUES ('7', '/en/{id}', '^/en/[^/]+/?$'), ('8', '/de/:page', '^/de/[^/]+/?$'), ('9', '/de/{x}', '^/de/[^/]+/?$'), ('1', '/es/<id>', '^/es/[^/]+/?$'))"""


@query(f"WITH {_CALLS}, m AS (SELECT *, count(*) OVER (PARTITION BY caller, method, path) AS k FROM calls JOIN routes ON regexp_matches(path, pattern) AND caller <> callee) SELECT caller, callee, method, path AS call_path, route FROM m WHERE k = 1")
def fd_service_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = read(spark, sf_dir, "pages").select((F.col("page_id") % 3).cast("string").alias("service"), F.lit("get").alias("method"), "url")
    routes = spark.createDataFrame([("7", "GET", "/en/{id}"), ("8", "GET", "/de/:page"), ("9", "GET", "/de/{x}"), ("1", "GET", "/es/<id>"), ("7", "POST", "/fr/{id}")], "service string, method string, path string")
    return federation.service_map(calls, routes)


@query("WITH r AS (SELECT l_suppkey AS scope, l_partkey % 20 AS name, l_orderkey * 10 + l_linenumber AS place FROM lineitem) SELECT *, (row_number() OVER (PARTITION BY scope, name ORDER BY place)) - 1 AS overload FROM r")
def wn_overload(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("scope"), (F.col("l_partkey") % 20).alias("name"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"))
    return verbs.overload_numbers(rows, ("scope", "name"), "place")


@query("WITH c AS (SELECT o_custkey AS symbol, o_orderpriority AS author, count(*) AS n FROM orders GROUP BY ALL) SELECT symbol, author, n FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY n DESC, author) AS r FROM c) WHERE r <= 3")
def wn_topk_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    touches = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("symbol_id"), F.col("o_orderpriority").alias("author"), F.col("o_orderkey").alias("commit_sha"))
    return verbs.top_authors(touches).select(F.col("symbol_id").alias("symbol"), "author", F.col("commits").alias("n"))


_TOKENS = r"CASE WHEN trim({0}, E' \t\n\r') = '' THEN 0 ELSE greatest(length({0}) // 4, len(regexp_split_to_array(trim({0}, E' \t\n\r'), '\s+')), 1) END"


@query(f"WITH top AS (SELECT doc_id, text, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50), t AS (SELECT doc_id, sum({_TOKENS.format('text')}) OVER (ORDER BY n_chars, doc_id) AS used FROM top) SELECT doc_id, used::BIGINT AS used FROM t WHERE used <= 60000")
def wn_budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest of the 50 longest documents, as many as fit a budget of tokens: a top-k and its running sum."""
    top = read(spark, sf_dir, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(50)
    return retrieve.budget_prefix(top, F.col("text"), 60_000, F.col("n_chars"), F.col("doc_id")).select("doc_id", "used")


@query("WITH r AS (SELECT user_id AS q, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank, event_type = 'purchase' AS hit FROM events), f AS (SELECT q, min(rank) FILTER (hit) AS first FROM r GROUP BY q) SELECT round(avg(coalesce(1.0 / first, 0)), 6)::DOUBLE AS mrr, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0 END), 6)::DOUBLE AS recall5 FROM f")
def ag_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = read(spark, sf_dir, "events").select(F.col("user_id").alias("query"), F.col("event_id").alias("id"), F.col("value").alias("score"), (F.col("event_type") == "purchase").alias("relevant"))
    return verbs.reciprocal_ranks(hits).agg(F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg(F.when(F.col("place") <= 5, 1.0).otherwise(0.0)), 6).alias("recall5"))


# Functions ------------------------------------------------------------------------


@query(f"SELECT doc_id, {_TOKENS.format('text')}::BIGINT AS tokens FROM documents")
def fn_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", text.estimated_tokens(F.col("text")).cast("long").alias("tokens"))


@query("SELECT page_id, regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', '') AS path FROM pages")
def fn_url_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", text.url_path(F.col("url")).alias("path"))


@query("SELECT s_suppkey, 'lat py re%20po src/' || s_name || '.py ' || replace(replace(s_name || '#', '%', '%25'), ' ', '%20') AS id, s_name || '.py' AS leaf FROM supplier")
def fn_symbol_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("s_name")
    made = text.symbol_id(F.lit("py"), F.lit("re po"), F.concat(F.lit("./src/"), name, F.lit(".py")), text.descriptor("type", name))
    return read(spark, sf_dir, "supplier").select("s_suppkey", made.alias("id"), F.regexp_extract(text.symbol_field(made, "path"), "([^/]+)$", 1).alias("leaf"))


@query("SELECT event_id, props::JSON ->> '$.k' AS k FROM events")
def fn_attrs_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", text.attribute(F.col("props"), "k").alias("k"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || '  ' || p_type), '[^a-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def fn_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", text.slug(F.concat_ws("  ", "p_name", "p_type")).alias("slug"))


@query("SELECT vec_id, round(1 / (1 + exp(-embedding[1]::DOUBLE)), 8) AS s, round(ln(greatest(1e-6, least(1 - 1e-6, abs(embedding[2]::DOUBLE))) / (1 - greatest(1e-6, least(1 - 1e-6, abs(embedding[2]::DOUBLE))))), 6) AS l FROM embeddings")
def fn_sigmoid_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(text.sigmoid(e[0].cast("double")), 8).alias("s"), F.round(text.logit(F.abs(e[1].cast("double"))), 6).alias("l"))


@query("SELECT conv_id, turn, len(list_filter(regexp_extract_all(lower(text), '[a-z0-9-]+'), lambda w: w IN ('why', 'decision', 'design', 'policy', 'allowed', 'constraint'))) > 0 AS architectural FROM conversations")
def pf_architectural(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", text.is_architectural(F.col("text")).alias("architectural"))


@query("SELECT doc_id FROM documents WHERE starts_with(source || '/' || lang, 'src1') OR regexp_matches(source || '/' || lang, '^src[25]/d.*$')")
def pf_scope_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", "source", "lang")
    return read(spark, sf_dir, "documents").where(temporal.in_scope(path, "src1") | temporal.in_scope(path, "src[25]/d*")).select("doc_id")


@query("SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda l: starts_with(l, '#'))) + CASE WHEN len(list_filter(string_split(regexp_replace(text, '(^|\n)#(.|\n)*$', ''), chr(10)), lambda l: trim(l, E' \\t\\r\\n') <> '')) > 0 THEN 1 ELSE 0 END AS sections FROM documents")
def kn_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = knowledge.sections(docs.select(F.col("doc_id").cast("string").alias("path"), "text")).groupBy(F.col("path").cast("long").alias("doc_id")).agg(F.count("*").alias("n"))
    return docs.join(found, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("sections"))


@query(r"SELECT conv_id, turn, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all('see `pkg.Mod#run` and src/a' || turn || '.py, ./lib/' || role || '.go ' || text, '([\w./-]+\.(?:c|cc|cpp|cs|cxx|go|h|hh|hpp|java|js|jsx|mjs|php|py|rb|rs|ts|tsx))\b', 1), lambda p: regexp_replace(p, '^(\./)+|^/+', '')), lambda p: contains(p, '/')))) AS paths FROM conversations")
def kn_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths in the texts, each of which is given some to find."""
    whole = F.concat(F.lit("see `pkg.Mod#run` and src/a"), F.col("turn").cast("string"), F.lit(".py, ./lib/"), F.col("role"), F.lit(".go "), F.col("text"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_sort(knowledge.mentioned_paths(whole)).alias("paths"))


# Stream twins -----------------------------------------------------------------------


@query("""WITH e AS (SELECT user_id, epoch_us(ts) AS t FROM events), g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) < 3600000000 THEN 0 ELSE 1 END AS new FROM e), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM g)
 SELECT user_id, min(t) // 1000000 AS start, max(t) // 1000000 AS last, count(*) AS n FROM s GROUP BY user_id, k""")
def st_session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of events an hour apart, as the idle trigger sees them."""
    events = read(spark, sf_dir, "events").select(F.col("user_id").alias("repo"), F.col("ts").cast("timestamp").alias("ts"))
    out = watch.sessions(events, "1 hour")
    return out.select(F.col("repo").alias("user_id"), F.unix_timestamp("opened").alias("start"), (F.unix_timestamp("closed") - 3600).alias("last"), F.col("events").alias("n"))


@query("SELECT epoch(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01'))::BIGINT AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def st_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select(F.col("event_type").alias("repo"), F.col("ts").cast("timestamp").alias("ts"))
    return watch.ticks(events, "6 hours").select(F.unix_timestamp("opened").alias("start"), F.col("repo").alias("event_type"), F.col("events").alias("n"))
