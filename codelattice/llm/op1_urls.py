"""URL filters by a sort-merge range join.

A URL's canonical key is its host's labels in reverse, each ended by a comma, then ``)`` and the path with query.  The
keys below a domain, a host or a path prefix are then one interval of the sorted order, and two rules' intervals
are nested or apart.  Keys and rules are divided at common split points, so that neighbouring keys are in one partition,
and a rule is sent to each partition that its interval meets.  Within a partition a sweep over the sorted rules
and keys keeps the active rules on a stack, the most specific on top, which decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.llm.textvec import column

#: Rules of production: a domain with its subdomains, ``=host`` for a host alone, each with an optional path prefix.
RULES = [
    (1, "example.net", "block"), (2, "tionsh.example.net", "allow"), (3, "tionsh.example.net/fr/", "block"), (4, "example.org/en/", "block"),
    (5, "blog.ththth.example.org", "allow"), (6, "=www.therth.example.org/", "block"), (7, "therha.example.net/en/", "allow"), (8, "ththing.example.com", "block"),
    (9, "blog.ththing.example.com", "allow"), (10, "m.therer.example.net/en/6", "allow"), (11, "example.com/es/", "block"), (12, "tionsh.example.net/fr/2", "allow"),
    (13, "therha.example.net/en/3", "block"), (14, "com", "allow"), (15, "www.theren.example.org/en/2", "allow"), (16, "tionsh.example.net/fr/25", "block"),
]
#: Split points are taken from this many keys for each partition, those with the smallest hashes.
SAMPLED = 50


def canonical(url: Column) -> Column:
    """The key of a URL; null for null and for what has no host.  Scheme, user, port, a final dot of the host and the fragment are left out; host and scheme are read in lower case; a missing path is ``/``."""
    trimmed = F.trim(url.cast("string"))
    host = F.regexp_extract(trimmed, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    rest = F.regexp_replace(F.regexp_replace(trimmed, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), r"#.*$", "")
    labels = F.reverse(F.split(F.regexp_replace(F.lower(host), r"\.+$", ""), r"\."))
    path = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(host != "", F.concat(F.array_join(labels, ","), F.lit(",)"), path))


def rule_prefix(pattern: Column) -> Column:
    """The prefix of the keys that a rule covers; null for an empty or null pattern."""
    bare = F.regexp_replace(F.trim(pattern), "^=", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?#]*)", 1)), r"\.+$", "")
    path = F.regexp_extract(bare, "^[^/?#]*(.*)$", 1)
    labels = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(","))
    alone = (path != "") | F.trim(pattern).startswith("=")
    return F.when(host != "", F.when(alone, F.concat(labels, F.lit(")"), path)).otherwise(labels))


def _split_points(keys: DataFrame, parts: int) -> np.ndarray:
    rows = keys.select("key").distinct().orderBy(F.xxhash64("key"), "key").limit(SAMPLED * parts).collect()
    ordered = sorted(r[0] for r in rows)
    return np.array(sorted({ordered[i * len(ordered) // parts] for i in range(1, parts)}) if len(ordered) >= parts else [], object)


def _placing(splits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = column(batch, "key").to_pylist()
            at = np.searchsorted(splits, np.array(keys, object), "right") if len(splits) and keys else np.zeros(len(keys))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], [*batch.schema.names, "part"])

    return run


def _spreading(splits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = column(batch, "key").to_pylist()
            rows, parts = [], []
            for i, key in enumerate(keys):
                first = int(np.searchsorted(splits, key, "right")) if len(splits) else 0
                last = int(np.searchsorted(splits, key + chr(0x10FFFF), "right")) if len(splits) else 0
                parts += range(first, last + 1)
                rows += [i] * (last + 1 - first)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows, pa.int64())) for c in batch.columns), pa.array(parts, pa.int32())], [*batch.schema.names, "part"])

    return run


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stack: list[tuple[str, int, str]] = []
    part = None
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [])
        for p, key, is_url, rule, action, row in zip(*(column(batch, c).to_pylist() for c in ("part", "key", "is_url", "rule_id", "action", "row_id")), strict=True):
            if p != part:
                stack, part = [], p
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if is_url:
                top = stack[-1] if stack else (None, None, None)
                for x, y in zip(out, (row, len(stack), top[1], top[2]), strict=True):
                    x.append(y)
            else:
                stack.append((key, rule, action))
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())], ["row_id", "active", "rule_id", "action"])


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "rule_id long, pattern string, action string")


def filtered(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", rule_id_col: str = "rule_id", pattern_col: str = "pattern", action_col: str = "action", parts: int | None = None) -> DataFrame:
    """(page_id, key, active, rule_id, action, keep): for each row the number of rules that cover it, and the rule that decides.

    The longest prefix decides; of rules with the same prefix ``allow`` wins over others, then the greatest rule id.  ``keep``
    is false only under ``block``.  Rows without a rule, with a null URL or a URL without a host are kept, without rule and
    with 0 active rules.  Null or empty patterns are no rules.  Rows that repeat an id are decided each.  Ids are
    integers or null.  Empty tables of either kind are allowed, and other columns are ignored, whatever their names.
    """
    spark = urls.sparkSession
    narrow = urls.select(F.col(id_col).cast("long").alias("row_id"), canonical(F.col(url_col)).alias("key"))
    keyed = narrow.where("key is not null")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    splits = _split_points(keyed, parts)
    schema = "key string, rule_id long, action string, row_id long, is_url boolean, part int"
    prefixes = rules.select(rule_prefix(F.col(pattern_col)).alias("key"), F.col(rule_id_col).cast("long").alias("rule_id"), F.col(action_col).alias("action"), F.lit(None).cast("long").alias("row_id"), F.lit(False).alias("is_url"))
    spread = prefixes.where("key is not null").mapInArrow(_spreading(splits), schema)
    placed = keyed.select("key", F.lit(None).cast("long").alias("rule_id"), F.lit(None).cast("string").alias("action"), "row_id", F.lit(True).alias("is_url")).mapInArrow(_placing(splits), schema)
    together = spread.union(placed).repartitionById(len(splits) + 1, "part").sortWithinPartitions("part", "key", "is_url", F.expr("action is not distinct from 'allow'"), "rule_id")
    # The key goes along with its row, since ids may repeat.
    decided = together.mapInArrow(_sweep_with_key, "row_id long, key string, active int, rule_id long, action string")
    rest = narrow.where("key is null").select("row_id", "key", F.lit(0).alias("active"), F.lit(None).cast("long").alias("rule_id"), F.lit(None).cast("string").alias("action"))
    return decided.union(rest).select(F.col("row_id").alias("page_id"), "key", "active", "rule_id", "action", (~F.coalesce(F.col("action") == "block", F.lit(False))).alias("keep"))


def _sweep_with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def urls_only(batch: pa.RecordBatch) -> pa.Array:
        return column(batch, "key").filter(column(batch, "is_url"))

    kept: list[pa.Array] = []

    def tee() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept.append(urls_only(batch))
            yield batch

    for done in _sweep(tee()):
        keys = kept.pop(0)
        yield pa.RecordBatch.from_arrays([done.column(0), keys, *done.columns[1:]], ["row_id", "key", "active", "rule_id", "action"])


def sql() -> str:
    """The DuckDB form of ``filtered`` over the table pages and the production rules."""
    values = ", ".join(f"({i}, '{p}', '{a}')" for i, p, a in RULES)
    rev = lambda host: f"array_to_string(list_reverse(string_split({host}, '.')), ',')"
    return f"""
    WITH rules AS (SELECT * FROM (VALUES {values}) t(rule_id, pattern, action)),
    split AS (SELECT rule_id, action, lower(regexp_extract(ltrim(pattern, '='), '^([^/?#]*)', 1)) AS host, regexp_extract(ltrim(pattern, '='), '^[^/?#]*(.*)$', 1) AS path, pattern LIKE '=%' AS alone FROM rules),
    prefixes AS (SELECT rule_id, action, {rev("host")} || ',' || CASE WHEN path <> '' OR alone THEN ')' || path ELSE '' END AS prefix FROM split),
    urls AS (SELECT page_id, regexp_replace(lower(regexp_extract(trim(url), '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\\.+$', '') AS host,
      regexp_replace(regexp_replace(trim(url), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', ''), '#.*$', '') AS rest FROM pages),
    keyed AS (SELECT page_id, CASE WHEN host <> '' THEN {rev("host")} || ',)' || CASE WHEN rest LIKE '/%' THEN rest ELSE '/' || rest END END AS key FROM urls),
    ranked AS (SELECT k.page_id, k.key, p.rule_id, p.action, count(p.rule_id) OVER (PARTITION BY k.page_id, k.key) AS active,
      row_number() OVER (PARTITION BY k.page_id, k.key ORDER BY length(p.prefix) DESC NULLS LAST, (p.action = 'allow') DESC, p.rule_id DESC) AS n
      FROM keyed k LEFT JOIN prefixes p ON starts_with(k.key, p.prefix))
    SELECT page_id, key, active::INTEGER AS active, rule_id::BIGINT AS rule_id, action, coalesce(action <> 'block', true) AS keep FROM ranked WHERE n = 1"""
