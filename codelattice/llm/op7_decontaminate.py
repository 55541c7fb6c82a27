"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, units that follow a number, and names are replaced by typed placeholders.  Windows of
``WINDOW`` template words are hash-joined between documents and benchmark items, in three forms: one that leaves names
as they are, one that makes them placeholders too, and one in which any capitalised word that begins a sentence is a name.  Each matching window also pairs the values of its slots.  The
matches of an item at one distance between its words and the document's are one occurrence, within which the pairs
have to be consistent: within a type, one benchmark value always has the same value in the document.  A window with a
value that has several gives no evidence, unless all its values are those of the item.  An item counts as found in
a document when enough of its windows give evidence.  So a question whose numbers, names or units were exchanged
throughout is caught, however many other variants of it stand beside it.

A name is a capitalised word that doesn't begin a sentence.  Neighbouring numbers are one slot.  A window needs at
least half literal words, of which those that begin sentences may be placeholders if ``LITERAL`` others are left.  Items of less than ``WINDOW`` but at least ``SHORTEST`` template words are one window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.llm.common import drop, released, small_batches, without, written
from codelattice.llm.textvec import buffer_of, column, lowered, mix, runs, slices, span_hashes, window_hashes, word_mask

WINDOW, SHORTEST = 8, 4
#: Share of an item's windows that a document must have.
COVERAGE = 0.5
#: Words that a window has to have in common with another if words that begin sentences are placeholders.
LITERAL = 3
#: Up to this many distinct window hashes (8 bytes each) go to every task as a filter; beyond it, all windows are joined by a shuffle.
FILTER_HASHES = 2_000_000

UNITS = (
    "mm cm m km mi mile miles ft foot feet inch inches yd yard yards meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ton tons tonne tonnes ml cl l liter liters litre litres gallon gallons "
    "ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "usd eur gbp dollar dollars cent cents euro euros percent mph kmh kph w kw kwh v volt volts watt watts hz khz mhz ghz kb mb gb tb "
    "degree degrees celsius fahrenheit people apples tag tage stunde stunden jahr jahre prozent heure heures jour jours an ans "
    "hora horas dia dias metro metros kilo kilos litro litros"
).split()

_NUM, _UNIT, _NAME = (np.uint64(x) for x in (0x1B873593AAAAAAAB, 0x2545F4914F6CDD1D, 0x3C6EF372FE94F82B))
_KINDS = "", "number", "unit", "name", "name"
#: Kinds that are slots, by form.
_SLOTS = (1, 2), (1, 2, 3), (1, 2, 3, 4)


def _one(words: list[str]) -> np.ndarray:
    data, offsets = buffer_of(pa.array(words))
    return span_hashes(data, offsets[:-1], offsets[1:] - 1)


_UNIT_HASHES = np.sort(_one(UNITS))


class Template:
    """The template words of a slice of texts: per word its hash in each form, its kind (0 literal, 1 number, 2 unit, 3 name, 4 capitalised at the beginning of a sentence) and byte range."""

    def __init__(self, texts: pa.Array) -> None:
        self.data, self.offsets = buffer_of(texts)
        lower = lowered(self.data)
        start, end = runs(word_mask(self.data))
        text = np.searchsorted(self.offsets, start, "right") - 1
        hashes = span_hashes(lower, start, end)
        first, last = (self.data[start], self.data[end - 1]) if len(start) else (np.zeros(0, np.uint8),) * 2
        number = (first >= 48) & (first <= 57) & (last >= 48) & (last <= 57)
        same = np.zeros(len(start), bool)
        same[1:] = text[1:] == text[:-1]
        after_number = same.copy()
        after_number[1:] &= number[:-1]
        # Neighbouring numbers are one: the first one's range then ends where the last one's does.
        kept = ~(number & after_number)
        groups = np.cumsum(kept) - 1
        ends = np.zeros(int(kept.sum()), np.int64)
        ends[groups] = end
        spot = np.searchsorted(_UNIT_HASHES, hashes).clip(max=len(_UNIT_HASHES) - 1)
        unit = after_number & ~number & (_UNIT_HASHES[spot] == hashes)
        second = self.data[np.minimum(start + 1, len(self.data) - 1)] if len(start) else first
        capital = (first >= 65) & (first <= 90) | (first == 0xC3) & (second >= 0x80) & (second <= 0x9E) | (first == 0xD0) & (second >= 0x90) & (second <= 0xAF)
        stops = np.concatenate(([0], np.cumsum(np.isin(self.data, (0, 10, 33, 46, 58, 63)))))
        before = np.zeros(len(start), np.int64)
        before[1:] = end[:-1]
        name = capital & same & (stops[start] == stops[before]) & ~unit
        kind = np.where(number, 1, np.where(unit, 2, np.where(name, 3, np.where(capital, 4, 0))))[kept]
        self.start, self.end, self.text, self.kind = start[kept], ends, text[kept], kind
        plain = np.where(kind == 1, _NUM, np.where(kind == 2, _UNIT, hashes[kept]))
        self.forms = plain, np.where(kind == 3, _NAME, plain), np.where(kind >= 3, _NAME, plain)
        self.lower = lower

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, hash, form) of each admissible window within one text."""
        n = len(self.text) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32)
        inside = self.text[:n] == self.text[size - 1 :]
        salt = np.uint64(size)

        def among(of: np.ndarray) -> np.ndarray:
            counts = np.concatenate(([0], np.cumsum(of)))
            return counts[size:] - counts[:-size]

        numbers, names, initial = among((self.kind == 1) | (self.kind == 2)), among(self.kind == 3), among(self.kind == 4)
        few = inside & (2 * (numbers + names) <= size)
        # Without a name, or without a beginning of a sentence, a form is the same as the one before.
        admissible = inside & (2 * numbers <= size), few & (names > 0), few & (initial > 0) & (size - numbers - names - initial >= LITERAL)
        out = []
        for form, of in enumerate(admissible):
            at = np.flatnonzero(of)
            out.append((at, mix(window_hashes(self.forms[form], size) ^ salt)[at], np.full(len(at), form, np.int32)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def slots(self, at: int, size: int, form: int) -> list[str]:
        """The values of a window's slots, each with its type before it."""
        return [f"{_KINDS[k]} {self.lower[self.start[i] : self.end[i]].tobytes().decode(errors='replace')}" for i, k in enumerate(self.kind[at : at + size], at) if k in _SLOTS[form]]


_SCHEMA = "id long, at long, size int, form int, hash long, slots array<string>"


def _windowing(sizes: list[int], filter_hashes: np.ndarray | None, whole_short: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = column(batch, "id"), column(batch, "text")
            for a, z in slices(texts):
                t = Template(texts[a:z])
                begins = np.searchsorted(t.text, np.arange(z - a + 1))
                numbers = np.diff(begins)
                for size in sizes:
                    at, hashes, form = t.windows(size)
                    keep = np.ones(len(at), bool)
                    if filter_hashes is not None:
                        keep &= filter_hashes[np.searchsorted(filter_hashes, hashes).clip(max=len(filter_hashes) - 1)] == hashes if len(filter_hashes) else False
                    if whole_short and size < WINDOW:  # short items: their one window
                        keep &= numbers[t.text[at]] == size
                    at, hashes, form = at[keep], hashes[keep], form[keep]
                    if not len(at):
                        continue
                    slots = [t.slots(int(i), size, int(n)) for i, n in zip(at, form, strict=True)]
                    owner = pa.array(t.text[at])
                    yield pa.RecordBatch.from_arrays([ids[a:z].take(owner), pa.array(at - begins[t.text[at]]), pa.array(np.full(len(at), size, np.int32)), pa.array(form), pa.array(hashes.view(np.int64)), pa.array(slots, pa.list_(pa.string()))], ["id", "at", "size", "form", "hash", "slots"])

    return released(run)


def _narrow(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", filter_hashes: int = FILTER_HASHES) -> DataFrame:
    """(doc_id, item_id, matched, windows, coverage): each document with each item that it holds.

    Null ids and texts are ignored, as are texts and items of less than ``SHORTEST`` template words or without
    an admissible window.  Rows that repeat a document or an item count as one document or item.  Empty tables give no
    rows.  Other columns are ignored, whatever their names.
    """
    small_batches(docs.sparkSession)
    items = _narrow(benchmark, item_col, item_text_col)
    item_windows = written(items.mapInArrow(_windowing([WINDOW, *range(SHORTEST, WINDOW)], None, True), _SCHEMA).distinct(), "op7-items")
    sizes = [r[0] for r in item_windows.select("size").distinct().orderBy("size").collect()]
    distinct = item_windows.select("hash").distinct().limit(filter_hashes + 1)
    hashes = None
    if distinct.count() <= filter_hashes:
        hashes = np.sort(np.array([r[0] for r in distinct.toPandas().itertuples(index=False)], np.int64).view(np.uint64))
    found = _narrow(docs, id_col, text_col).mapInArrow(_windowing(sizes, hashes, False), _SCHEMA)
    totals = item_windows.groupBy(F.col("id").alias("item_id")).agg(F.count_distinct("at").alias("windows"))
    right = item_windows.select(F.col("id").alias("item_id"), F.col("at").alias("item_at"), "hash", "size", "form", F.col("slots").alias("item_slots"))
    hits = found.withColumnRenamed("slots", "doc_slots").join(right, ["hash", "size", "form"]).where("size(doc_slots) = size(item_slots)")
    hits = written(hits.select(F.col("id").alias("doc_id"), "item_id", "item_at", "form", (F.col("at") - F.col("item_at")).alias("distance"), F.arrays_zip("item_slots", "doc_slots").alias("pairs")), "op7-hits")
    keys = ["doc_id", "item_id", "form", "distance"]
    pairs = hits.select(*keys, F.explode("pairs").alias("p")).select(*keys, F.col("p.item_slots").alias("ours"), F.col("p.doc_slots").alias("theirs"))
    several = pairs.groupBy(*keys, "ours").agg(F.min("theirs").alias("low"), F.max("theirs").alias("high")).where("low <> high")
    contested = several.groupBy(*keys).agg(F.collect_list("ours").alias("contested"))
    sound = hits.join(contested, keys, "left").where("contested is null or not arrays_overlap(pairs.item_slots, contested) or forall(pairs, p -> p.item_slots = p.doc_slots)")
    matched = sound.groupBy("doc_id", "item_id").agg(F.count_distinct("item_at").alias("matched"))
    out = matched.join(totals, "item_id").withColumn("coverage", F.col("matched") / F.col("windows"))
    out = written(out.where(F.col("coverage") >= coverage).select("doc_id", "item_id", "matched", "windows", "coverage"), "op7-found")
    drop(item_windows, hits)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without those that hold an item; rows with null ids or texts stay."""
    found = contaminated(docs, benchmark, coverage, id_col, text_col, item_col, item_text_col)
    return without(docs, written(found.select("doc_id").distinct(), "op7-gone"), id_col)


def read_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")
