"""Substring deduplication by repeated-phrase automata.

A repeated passage is a run of at least ``PASSAGE`` words (as compared in lower case) that two documents share.

1. Each text's windows of ``PHRASE`` words are winnowed: of any ``PASSAGE - PHRASE + 1`` neighbouring windows the one with the
   smallest hash is selected, so two documents that share a passage select a common window inside it.
2. Windows that two documents selected are recurring phrases.  Around each of their occurrences, the windows of ``PASSAGE``
   words of which it is the selected phrase are compared by hash; those that two documents have are repeated.
   So every context of a phrase that recurs counts, however many others the phrase has.  The first document
   that has a repeated window gives its words: neighbouring ones are a *segment*.
3. Phrases are divided into shards, each small enough for one Aho-Corasick automaton over words.  Documents are
   streamed through the automata of the shards whose phrases they selected; the others can't hold a passage.  A shard
   with many documents is compiled several times, so a phrase that a large share of the corpus has is no bottleneck.
4. Around every occurrence that an automaton finds, the windows of ``PASSAGE`` words are looked up among those of the
   segments and compared with them word by word.  Overlapping ones are reported as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelattice.llm.common import drop, released, small_batches, written
from codelattice.llm.textvec import Words, column, mix, slices, window_hashes

PASSAGE, PHRASE = 50, 25
#: Phrases of an automaton, which bounds a task's memory (25 nodes each), and documents that one task streams through it.
PHRASES, DOCUMENTS = 40_000, 20_000


def _sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """``best`` of each run of ``width`` values, in a logarithmic number of passes."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = best(out[: len(out) - step], out[step:])
        have += step
    return out


def selected(words: Words, phrase: int, passage: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the windows that winnowing selects, with word numbers within the slice."""
    around = passage - phrase + 1
    if len(words.hash) < passage:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = window_hashes(words.hash, phrase) | np.uint64(1)
    text = words.text_of()
    least = _sliding(hashes, around, np.minimum)
    least[text[: len(least)] != text[passage - 1 :][: len(least)]] = 0  # not all within one text
    edge = np.zeros(around - 1, np.uint64)
    highest = _sliding(np.concatenate((edge, least, edge)), around, np.maximum)[: len(hashes)]
    at = np.flatnonzero(highest == hashes)
    return at, hashes[at]


def _selecting(phrase: int, passage: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = column(batch, "doc_id"), column(batch, "text")
            for a, z in slices(texts):
                words = Words(texts[a:z])
                at, hashes = selected(words, phrase, passage)
                row = np.searchsorted(words.bounds, at, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), ids[a:z].take(pa.array(row)), pa.array((at - words.bounds[row]).astype(np.int32))], ["hash", "doc_id", "at"])

    return released(run)


def _passages(phrases: np.ndarray, phrase: int, passage: int, words: np.ndarray) -> np.ndarray:
    """Hash of each window of ``passage`` words: from those of its first and last phrase where the two cover it."""
    if 2 * phrase < passage:
        return window_hashes(words, passage)
    n = max(0, len(words) - passage + 1)
    return mix(phrases[:n] * np.uint64(0xFF51AFD7ED558CCD) + phrases[passage - phrase :][:n])


def _contexts(phrase: int, passage: int):
    """From (doc_id, text, hits: [(shard, at, hash)]) a row for each window of ``passage`` words whose selected phrase is a hit: its hash and first word, and where the phrase is."""
    reach = passage - phrase + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, hits = column(batch, "doc_id"), column(batch, "text"), column(batch, "hits")
            cuts = hits.offsets.to_numpy()
            shard, at, hashed = (hits.values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            for a, z in slices(texts):
                words = Words(texts[a:z])
                if len(words.hash) < passage:
                    continue
                hashes = window_hashes(words.hash, phrase) | np.uint64(1)
                least = _sliding(hashes, reach, np.minimum)
                text = words.text_of()
                least[text[: len(least)] != text[passage - 1 :][: len(least)]] = 0
                own = slice(cuts[a], cuts[z])
                row = np.repeat(np.arange(z - a), np.diff(cuts[a : z + 1]))
                spot = words.bounds[row] + at[own]
                # Rows that repeat an id have each other's hits too.
                true = spot + phrase <= words.bounds[row + 1]
                true[true] = hashes[spot[true]] == hashed[own][true].view(np.uint64)
                row, spot, of = row[true], spot[true], shard[own][true]
                begin = spot[:, None] - np.arange(reach)
                good = (begin >= words.bounds[row][:, None]) & (begin < len(least))
                good[good] = (least[begin[good]] == np.broadcast_to(hashes[spot][:, None], begin.shape)[good])
                which = np.nonzero(good)[0]
                begin, base = begin[good], words.bounds[row[which]]
                whole = _passages(hashes, phrase, passage, words.hash)[begin]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(whole.view(np.int64)), ids[a:z].take(pa.array(row[which])), pa.array(of[which].astype(np.int32)), pa.array((begin - base).astype(np.int32)), pa.array((spot[which] - base).astype(np.int32))],
                    ["hash", "doc_id", "shard", "begin", "at"],
                )

    return released(run)


@released
def _repeating(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by hash and document, the first row of each hash that two documents have."""
    first, several = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        # The first row of a hash whose rows go on in this batch stands before them.
        batch = batch if first is None else pa.Table.from_batches([first, batch]).combine_chunks().to_batches()[0]
        hashes, ids = column(batch, "hash").to_numpy(), column(batch, "doc_id").to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
        ends = np.append(starts[1:], len(hashes)) - 1
        more = ids[starts] != ids[ends]
        more[0] |= several
        yield batch.take(pa.array(starts[:-1][more[:-1]]))
        first, several = batch.slice(int(starts[-1]), 1), bool(more[-1])
    if several:
        yield first


def _packed(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype(np.uint32)


def _segmenting(phrase: int, passage: int):
    """From (doc_id, text, reps: [(shard, begin, at)]) a row for each run of repeated windows that overlap: its words, and where in it the windows and the phrases begin (the number of windows first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, reps = column(batch, "doc_id"), column(batch, "text"), column(batch, "reps")
            cuts = reps.offsets.to_numpy()
            shards, begins, ats = (reps.values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            for a, z in slices(texts):
                words = Words(texts[a:z])
                out: tuple[list, ...] = ([], [], [], [])
                for i in range(z - a):
                    own = _packed(words.hash[words.bounds[i] : words.bounds[i + 1]])
                    x, y = cuts[a + i], cuts[a + i + 1]
                    order = np.lexsort((begins[x:y], shards[x:y])) + x
                    order = order[begins[order] + passage <= len(own)]
                    if not len(order):
                        continue
                    new = (np.diff(shards[order]) != 0) | (np.diff(begins[order]) > passage)
                    for part in np.split(order, np.flatnonzero(new) + 1):
                        first, begin, at = int(begins[part[0]]), np.unique(begins[part]), np.unique(ats[part])
                        marks = np.concatenate(([len(begin)], begin - first, at - first)).astype(np.int32)
                        for o, v in zip(out, (int(shards[part[0]]), ids[a + i].as_py(), own[first : int(begin[-1]) + passage].tobytes(), marks.tobytes()), strict=True):
                            o.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())], ["shard", "doc_id", "a", "b"])

    return released(run)


class _Scanner:
    """An automaton over word hashes, with the repeated windows in which its phrases are."""

    def __init__(self, phrase: int, passage: int) -> None:
        import ahocorasick

        self.phrase, self.passage = phrase, passage
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
        self.segments: list[np.ndarray] = []
        self.begins: list[np.ndarray] = []
        self.size = 0
        self.ready = False

    def add(self, words: np.ndarray, marks: np.ndarray) -> None:
        begins, at = marks[1 : 1 + marks[0]], marks[1 + marks[0] :]
        self.begins.append(self.size + begins.astype(np.int64))
        self.segments.append(words)
        self.size += len(words)
        as_list = words.tolist()
        for x in at.tolist():
            self.automaton.add_word(tuple(as_list[x : x + self.phrase]))

    def hashes(self, words: np.ndarray) -> np.ndarray:
        wide = words.astype(np.uint64)
        return _passages(window_hashes(wide, self.phrase), self.phrase, self.passage, wide)

    def prepare(self) -> None:
        self.automaton.make_automaton()
        self.words = np.concatenate(self.segments) if self.segments else np.zeros(0, np.uint32)
        begins = np.concatenate(self.begins) if self.begins else np.zeros(0, np.int64)
        keys, at = np.unique(self.hashes(self.words)[begins], return_index=True)
        self.keys, self.at = keys, begins[at]
        self.segments, self.begins, self.ready = [], [], True

    def spans(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word ranges [first, last) of the passages in the texts with ``bounds``; those of a text may overlap."""
        if not self.ready:
            self.prepare()
        none = np.zeros(0, np.int64)
        if not len(self.keys):
            return none, none
        near = np.zeros(len(words) + 1, np.int32)
        for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if z - a < self.passage:
                continue
            ends = np.array([end for end, _ in self.automaton.iter(tuple(words[a:z].tolist()))], np.int64)
            begins = a + ends - self.phrase + 1
            np.add.at(near, np.maximum(a, begins - (self.passage - self.phrase)), 1)
            np.add.at(near, np.minimum(begins, z - self.passage) + 1, -1)
        begins = np.flatnonzero(np.cumsum(near[:-1]) > 0)
        if not len(begins):
            return none, none
        hashes = self.hashes(words)[begins]
        spot = np.searchsorted(self.keys, hashes).clip(max=len(self.keys) - 1)
        same = self.keys[spot] == hashes
        begins, at = begins[same], self.at[spot[same]]
        if not len(begins):
            return none, none
        equal = np.ones(len(begins), bool)
        for j in range(self.passage):
            equal &= words[begins + j] == self.words[at + j]
        begins = begins[equal]
        new = np.flatnonzero(np.diff(begins) > 1) + 1
        return begins[np.concatenate(([0], new))] if len(begins) else none, begins[np.append(new - 1, len(begins) - 1)] + self.passage if len(begins) else none


def _scanning(phrase: int, passage: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, part = _Scanner(phrase, passage), None
        for batch in batches:
            parts, kinds, ids = column(batch, "part").to_numpy(), column(batch, "kind").to_numpy(), column(batch, "doc_id").to_numpy()
            first, second = column(batch, "a"), column(batch, "b")
            breaks = np.flatnonzero((np.diff(parts) != 0) | (np.diff(kinds) != 0)) + 1
            for a, z in zip([0, *breaks.tolist()], [*breaks.tolist(), len(parts)], strict=True):
                if a == z:
                    continue
                if parts[a] != part:
                    scanner, part = _Scanner(phrase, passage), parts[a]
                if kinds[a] == 0:
                    for i in range(a, z):
                        scanner.add(np.frombuffer(first[i].as_py(), np.uint32), np.frombuffer(second[i].as_py(), np.int32))
                    continue
                texts = first[a:z].cast(pa.string())
                for x, y in slices(texts):
                    words = Words(texts[x:y])
                    begin, end = scanner.spans(_packed(words.hash), words.bounds)
                    if not len(begin):
                        continue
                    chars = np.concatenate(([0], np.cumsum((words.data & 0xC0) != 0x80)))
                    row = np.searchsorted(words.bounds, begin, "right") - 1
                    base, zero = words.bounds[row], chars[words.offsets[row]]
                    rows = ids[a + x + row], begin - base, end - base, chars[words.start[begin]] - zero, chars[words.end[end - 1]] - zero
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], ["doc_id", "first_word", "last_word", "start", "end"])

    return released(run)


def repeated_passages(docs: DataFrame, passage: int = PASSAGE, phrase: int = PHRASE, id_col: str = "doc_id", text_col: str = "text", phrases: int = PHRASES, documents: int = DOCUMENTS) -> DataFrame:
    """(doc_id, start, end, words): the character range of every occurrence of a repeated passage, and its words.

    Null ids and texts, and texts of less than ``passage`` words, have none.  Rows that repeat an id are one document:
    they don't repeat each other, and their ranges are reported together.  Whole copies are passages as well.  An empty table
    gives no rows.  Other columns are ignored, whatever their names.  The ranges are the unions of all windows of ``passage``
    words that another document has too.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
    chosen = written(docs.mapInArrow(_selecting(phrase, passage), "hash long, doc_id long, at int"), "op9-selected")
    repeated = chosen.groupBy("hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("hash", "first")
    repeated = written(repeated, "op9-phrases")
    shards = max(1, -(-repeated.count() // phrases))
    hits = chosen.join(repeated.select("hash", F.pmod(F.xxhash64("first"), F.lit(shards)).cast("int").alias("shard")), "hash")
    routes = hits.groupBy("doc_id").agg(F.collect_set("shard").alias("shards"), F.collect_list(F.struct("shard", "at", "hash")).alias("hits"))
    routed = written(docs.join(routes.hint("merge"), "doc_id"), "op9-routed")
    drop(chosen, repeated)

    contexts = routed.select("doc_id", "text", "hits").mapInArrow(_contexts(phrase, passage), "hash long, doc_id long, shard int, begin int, at int")
    reps = contexts.repartition("hash").sortWithinPartitions("hash", "doc_id").mapInArrow(_repeating, contexts.schema)
    reps = written(reps.select("doc_id", "shard", "begin", "at"), "op9-windows")

    visits = routed.select("doc_id", "text", F.explode("shards").alias("shard"))
    tasks = visits.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(documents)).cast("int").alias("copies"))
    tasks = written(tasks.withColumn("from", (F.sum("copies").over(Window.orderBy("shard")) - F.col("copies")).cast("int")), "op9-tasks")
    total = tasks.agg(F.sum("copies")).first()[0] or 1
    reps = reps.groupBy("doc_id").agg(F.collect_list(F.struct("shard", "begin", "at")).alias("reps"))
    segments = routed.select("doc_id", "text").join(reps.hint("merge"), "doc_id").mapInArrow(_segmenting(phrase, passage), "shard int, doc_id long, a binary, b binary")
    loaded = segments.join(tasks, "shard").select(F.explode(F.expr("sequence(`from`, `from` + copies - 1)")).alias("part"), F.lit(0).alias("kind"), "doc_id", "a", "b")
    streamed = visits.join(tasks, "shard").select((F.col("from") + F.pmod(F.xxhash64("doc_id"), F.col("copies"))).cast("int").alias("part"), F.lit(1).alias("kind"), "doc_id", F.col("text").cast("binary").alias("a"), F.lit(None).cast("binary").alias("b"))
    both = loaded.union(streamed).repartitionById(int(total), "part").sortWithinPartitions("part", "kind")
    spans = both.mapInArrow(_scanning(phrase, passage), "doc_id long, first_word long, last_word long, start long, end long")

    order = Window.partitionBy("doc_id").orderBy("first_word", "last_word")
    before = F.max("last_word").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("new", F.when(F.col("first_word") <= before, 0).otherwise(1)).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.max("last_word") - F.min("first_word")).alias("words"))
    return merged.select("doc_id", "start", "end", "words")
