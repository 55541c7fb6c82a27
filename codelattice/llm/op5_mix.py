"""Mixing sources to target weights by iterative proportional fitting.

The corpus is a table of cells (source, language, topic) with token weights.  Raking multiplies the cells in turn
so that their sums meet the target shares of each margin, which after ``ROUNDS`` rounds hold for all three.  A document's
inclusion probability is its cell's factor divided by the largest factor, and a document is taken when the hash of its
id falls below that, so the expected token shares of the sample are the targets and a rerun takes the same documents.

Targets are tempered shares by default: a margin's share to the power of ``TEMPER``, made to sum to one.  A topic is the
first pattern of ``TOPICS`` that the text matches, else ``general``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelattice.llm.common import cut, unused, written

TOPICS = {"legal": "(?i)licen[cs]ed? |copyright|rights reserved", "tabular": " \\| ", "technical": "https?://|@[a-z]|[0-9]+[.][0-9]+", "shouted": "!!|[$]{3}|%{3}|&{3}"}
TEMPER = {"source": 0.8, "lang": 0.9, "topic": 0.9}
ROUNDS = 12
#: Up to this many cells are raked in numpy by the driver, more as a DataFrame.
DRIVER_CELLS = 200_000
_NONE = "(none)"
_DIMS = ["source", "lang", "topic"]


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\f\\r]+")), F.lit(0))


def topic_of(text: Column, topics: dict[str, str] | None = None) -> Column:
    out = F.lit("general")
    for name, pattern in reversed((TOPICS if topics is None else topics).items()):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def uniform(id_column: Column) -> Column:
    """A number in [0, 1) from the id's md5."""
    return F.conv(F.substring(F.md5(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def tempered(shares: dict[str, float], exponent: float) -> dict[str, float]:
    raised = {k: v**exponent for k, v in shares.items() if v > 0}
    return {k: v / sum(raised.values()) for k, v in raised.items()}


def _targets(margin: dict[str, float], wanted: dict[str, float] | None, exponent: float) -> dict[str, float]:
    """Target shares of the values that have tokens: others can't be reached, so what is wanted of them is shared out in proportion."""
    total = sum(margin.values())
    present = {k for k, v in margin.items() if v > 0}
    if wanted is None:
        return tempered({k: margin[k] / total for k in present}, exponent)
    kept = {k: v for k, v in wanted.items() if k in present and v > 0}
    return {k: v / sum(kept.values()) for k, v in kept.items()}


def rake(cells: dict[str, np.ndarray], weight: np.ndarray, targets: dict[str, dict[str, float]], rounds: int = ROUNDS) -> np.ndarray:
    """The factor of each cell; 0 for cells whose value of some margin has no target."""
    factor = np.ones(len(weight))
    coded = []
    for dim, values in cells.items():
        names, codes = np.unique(values, return_inverse=True)
        coded.append((codes, np.array([targets[dim].get(str(n), 0.0) for n in names])))
    total = weight.sum()
    for _ in range(rounds):
        for codes, share in coded:
            now = np.bincount(codes, weight * factor, len(share))
            factor *= np.divide(share * total, now, out=np.zeros_like(now), where=now > 0)[codes]
    return factor


def _rake_frame(cells: DataFrame, targets: dict[str, dict[str, float]], rounds: int) -> DataFrame:
    """``rake`` for more cells than a driver should hold; the margins' targets are joined."""
    spark = cells.sparkSession
    total = cells.agg(F.sum("weight")).first()[0] or 0
    out = cells.withColumn("factor", F.lit(1.0))
    for _ in range(rounds):
        for dim in _DIMS:
            want = spark.createDataFrame(pa.table({dim: list(targets[dim]), "share": list(targets[dim].values())}))
            ratio = out.groupBy(dim).agg(F.sum(F.col("weight") * F.col("factor")).alias("now")).join(want, dim, "left")
            ratio = ratio.select(dim, F.when(F.col("now") > 0, F.coalesce("share", F.lit(0.0)) * total / F.col("now")).otherwise(0.0).alias("ratio"))
            out = out.join(ratio, dim).select(*_DIMS, "weight", (F.col("factor") * F.col("ratio")).alias("factor"))
        out = cut(out)
    return out


def _celled(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = {"source": F.coalesce(F.col(source_col).cast("string"), F.lit(_NONE)), "lang": F.coalesce(F.col(lang_col).cast("string"), F.lit(_NONE)), "topic": topic_of(text)}
    return docs.select(F.col(id_col).alias("doc_id"), tokens(text).alias("tokens"), *(v.alias(k) for k, v in named.items()))


def weights(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", rounds: int = ROUNDS, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """(source, lang, topic, probability) of each cell."""
    return _weights(_celled(docs, id_col, text_col, source_col, lang_col), targets, rounds, driver_cells)


def _weights(celled: DataFrame, targets: dict[str, dict[str, float]] | None, rounds: int = ROUNDS, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    spark, targets = celled.sparkSession, targets or {}
    cells = cut(celled.groupBy(*_DIMS).agg(F.sum("tokens").alias("weight")))
    margins = {d: {r[0]: float(r[1]) for r in cells.groupBy(d).agg(F.sum("weight")).collect()} for d in _DIMS}
    if not sum(margins["topic"].values()):  # no tokens at all: nothing to weigh
        return cells.select(*_DIMS, F.lit(1.0).alias("probability"))
    goals = {d: _targets(margins[d], targets.get(d), TEMPER[d]) for d in _DIMS}
    if cells.limit(driver_cells + 1).count() > driver_cells:
        raked = _rake_frame(cells, goals, rounds)
        top = raked.where("weight > 0").agg(F.max("factor")).first()[0]
        return raked.select(*_DIMS, F.when(F.col("weight") > 0, F.col("factor") / F.lit(top)).otherwise(1.0).alias("probability"))
    rows = cells.orderBy(*_DIMS).collect()
    weight = np.array([r["weight"] for r in rows], float)
    factor = rake({d: np.array([r[d] for r in rows], object).astype(str) for d in _DIMS}, weight, goals, rounds)
    p = np.where(weight > 0, factor / factor[weight > 0].max(), 1.0)
    return spark.createDataFrame(pa.table({d: [r[d] for r in rows] for d in _DIMS} | {"probability": p}))


def sampling(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", **how) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, probability, taken) for every row.

    Null sources and languages are a value of their own, ``(none)``; null and empty texts have no tokens, and a cell
    without any tokens is kept whole.  Rows that repeat an id are taken or left together if their cells agree.  A target
    for a value that the corpus lacks is shared out among the others; a value without a target, where targets are given,
    is left out.  An empty table gives no rows.  Other columns are ignored.
    """
    celled = written(_celled(docs, id_col, text_col, source_col, lang_col), "op5-celled")  # texts are read once
    joined = celled.join(_weights(celled, targets, **how), _DIMS)
    return joined.select("doc_id", *_DIMS, "tokens", F.round("probability", 6).alias("probability"), (uniform(F.col("doc_id")) < F.round("probability", 6)).alias("taken"))


def mixed(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", **how) -> DataFrame:
    """The rows of ``docs`` that ``sampling`` takes."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    *of_dims, chance = unused(docs, "__mix_source", "__mix_lang", "__mix_topic", "__mix_p")
    names = dict(zip(_DIMS, of_dims, strict=True))
    wide = docs.withColumns({names["source"]: F.coalesce(F.col(source_col).cast("string"), F.lit(_NONE)), names["lang"]: F.coalesce(F.col(lang_col).cast("string"), F.lit(_NONE)), names["topic"]: topic_of(text)})
    chances = weights(docs, targets, id_col, text_col, source_col, lang_col, **how).withColumnsRenamed(names | {"probability": chance})
    return wide.join(chances, list(names.values())).where(uniform(F.col(id_col)) < F.round(chance, 6)).select(*(F.col(c) for c in docs.columns))


def sql(rounds: int = ROUNDS) -> str:
    """The DuckDB form of ``sampling`` over the table documents, with tempered targets."""
    case = " ".join(f"WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{n}'" for n, p in TOPICS.items())
    steps = [
        f"celled AS MATERIALIZED (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\f\\r]+')) AS tokens, coalesce(source, '{_NONE}') AS source, coalesce(lang, '{_NONE}') AS lang, CASE {case} ELSE 'general' END AS topic FROM documents)",
        "c0 AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::DOUBLE AS weight, 1::DOUBLE AS factor FROM celled GROUP BY ALL)",
        *(f"t_{d} AS MATERIALIZED (SELECT {d}, pow(m, {TEMPER[d]}) / sum(pow(m, {TEMPER[d]})) OVER () AS share FROM (SELECT {d}, sum(weight) / (SELECT sum(weight) FROM c0) AS m FROM c0 GROUP BY {d}) WHERE m > 0)" for d in _DIMS),
    ]
    last = 0
    for _ in range(rounds):
        for d in _DIMS:
            steps.append(f"c{last + 1} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.weight, c.factor * coalesce(t.share * (SELECT sum(weight) FROM c0) / nullif(sum(c.weight * c.factor) OVER (PARTITION BY c.{d}), 0), 0) AS factor FROM c{last} c LEFT JOIN t_{d} t ON t.{d} = c.{d})")
            last += 1
    steps.append(f"p AS MATERIALIZED (SELECT source, lang, topic, round(CASE WHEN weight > 0 THEN factor / (SELECT max(factor) FROM c{last} WHERE weight > 0) ELSE 1 END, 6) AS probability FROM c{last})")
    return "WITH " + ", ".join(steps) + " SELECT doc_id, source, lang, topic, tokens, probability, ('0x' || md5(coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT / 4294967296.0 < probability AS taken FROM celled JOIN p USING (source, lang, topic)"
