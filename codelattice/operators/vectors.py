"""Vector tables (ref, vector, kind, path, attrs): upsert, filtered deletion, cosine search and exact joins of hits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that a search or a deletion can filter by equality.
FILTERABLE = ("ref", "kind", "path")


def _condition(by: dict[str, str] | None) -> Column:
    out = F.lit(True)
    for key, value in (by or {}).items():
        if key not in FILTERABLE:
            raise ValueError(f"can't filter by '{key}', only by {', '.join(FILTERABLE)}")
        out = out & (F.col(key) == value)
    return out


def upsert(old: DataFrame, new: DataFrame, dimension: int | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same ref; vectors of another length than ``dimension`` are an error when they are read."""
    if dimension is not None:
        new = new.withColumn("vector", F.when(F.size("vector") == dimension, F.col("vector")).otherwise(F.raise_error(F.format_string("a vector has %d dimensions, not %d", F.size("vector"), F.lit(dimension)))))
    return old.join(new.select("ref"), "ref", "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def delete_where(vectors: DataFrame, by: dict[str, str]) -> DataFrame:
    return vectors.where(~F.coalesce(_condition(by), F.lit(False)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, null if one vector is null or zero; in the JVM, for pairs of columns."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def _nearest(query: Sequence[float], k: int):
    """The ``k`` best rows of each batch, scored by one matrix product; what no batch ranks can't be among the best of all."""
    q = np.array(query, np.float64)
    length = float(np.sqrt(q @ q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(3)
            sizes = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(sizes == len(q))
            if not len(rows) or not length:
                continue
            part = batch.take(pa.array(rows))
            values = part.column(3).flatten()
            m = values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), len(q))
            norms = np.sqrt((m * m).sum(1)) * length
            with np.errstate(divide="ignore", invalid="ignore"):
                score = np.clip((m @ q) / norms, 0.0, 1.0)
            good = np.flatnonzero(~np.isnan(score))
            if len(good) > k:  # all that tie with the k-th stay
                good = good[score[good] >= np.partition(score[good], len(good) - k)[len(good) - k]]
            chosen = part.take(pa.array(good))
            yield pa.RecordBatch.from_arrays([chosen.column(0), chosen.column(1), chosen.column(2), pa.array(score[good])], ["ref", "kind", "path", "score"])

    return run


def search(vectors: DataFrame, query: Sequence[float], k: int, by: dict[str, str] | None = None) -> DataFrame:
    """(ref, kind, path, score): the ``k`` rows nearest to ``query`` of those that pass the filter, which comes first.  Equal scores are in order of ref.

    Null and zero vectors, and those of another length than the query, have no score and are no hits.
    """
    if k <= 0 or not len(query):
        return vectors.select("ref", "kind", "path", F.lit(0.0).alias("score")).limit(0)
    narrow = vectors.where(_condition(by)).select("ref", "kind", "path", F.col("vector").cast("array<double>"))
    return narrow.mapInArrow(_nearest([float(x) for x in query], k), "ref string, kind string, path string, score double").orderBy(F.desc("score"), "ref").limit(k)
