"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a text in stretches of ``STRETCH``, labels every byte with a probability for
each language, and a document's probability is the mean over all its bytes.  It is trained in numpy by
backpropagation through time (Adam on the mean cross-entropy of the positions) on a bounded, hash-chosen sample of
rows that have a language label: ``PER_LANGUAGE`` documents a language, from each of which ``STRETCHES``
stretches are drawn.  Prediction reads every byte of every text.

Stretches of all texts are steps of one matrix recurrence, so a byte costs a row of a few small matrix products
and no Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelattice.llm.common import released, small_batches
from codelattice.llm.textvec import buffer_of, column, slices

#: Bytes that are labelled at once, and those before and behind them that both directions read first.
HIDDEN, STRETCH, CONTEXT = 8, 64, 8
#: Bounds of the training sample.
PER_LANGUAGE, STRETCHES = 200, 24
STEPS, BATCH, RATE, SEED = 500, 128, 0.02, 7
#: A document is rejected if its best language has a lower mean probability, or if it has no letter.
LEAST = 0.4
_SLICE = 1 << 18


class Network:
    """Weights, in float32: for each direction the table of byte inputs, the recurrent matrices of gates and candidate; then the output layer."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        h, self.languages, self.hidden = hidden, languages, hidden
        self.w = {}
        for d in "fb":
            self.w[f"{d}x"] = rng.normal(0, 0.3, (256, 3 * h)).astype(np.float32)
            self.w[f"{d}g"] = rng.normal(0, 1 / np.sqrt(h), (h, 2 * h)).astype(np.float32)
            self.w[f"{d}c"] = rng.normal(0, 1 / np.sqrt(h), (h, h)).astype(np.float32)
        self.w["o"] = rng.normal(0, 0.3, (2 * h, len(languages))).astype(np.float32)
        self.w["ob"] = np.zeros(len(languages), np.float32)

    def _states(self, data: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states [time, row, unit]; data is [time, row]. Logistic gates by way of tanh; update gate, reset gate and candidate are separate arrays, as numpy is several times faster on contiguous ones."""
        h, half = self.hidden, np.float32(0.5)
        steps, rows = data.shape
        w, scale = self.w, np.concatenate((np.full(2 * h, half), np.ones(h, np.float32))).astype(np.float32)
        tables = [np.ascontiguousarray(x) for x in np.split(w[f"{d}x"] * scale, 3, 1)]
        wu, wr, wc = (np.ascontiguousarray(x) for x in (w[f"{d}g"][:, :h] * half, w[f"{d}g"][:, h:] * half, w[f"{d}c"]))
        out = np.empty((steps, rows, h), np.float32)
        state, product = np.zeros((rows, h), np.float32), np.empty((rows, h), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            update, reset, candidate = (x.take(data[t], 0) for x in tables)
            for gate, m in ((update, wu), (reset, wr)):
                gate += np.matmul(state, m, out=product)
                np.tanh(gate, out=gate)
                gate += 1
                gate *= half
            candidate += np.matmul(reset * state, wc, out=product)
            np.tanh(candidate, out=candidate)
            if keep is not None:
                keep.append((t, state.copy(), np.concatenate((update, reset), 1), candidate.copy()))
            candidate -= state
            candidate *= update
            state = np.add(state, candidate, out=out[t])
        return out

    def probabilities(self, data: np.ndarray) -> np.ndarray:
        """[language, time, row] for bytes [time, row]."""
        both = self.w["o"][: self.hidden].T @ self._states(data, "f").reshape(-1, self.hidden).T
        both += self.w["o"][self.hidden :].T @ self._states(data, "b").reshape(-1, self.hidden).T
        both += self.w["ob"][:, None]
        both -= both.max(0)
        np.exp(both, out=both)
        both /= both.sum(0)
        return both.reshape(-1, *data.shape)

    def gradients(self, data: np.ndarray, labels: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over the masked positions and its gradients, by backpropagation through all steps."""
        h, w = self.hidden, self.w
        kept: dict[str, list] = {"f": [], "b": []}
        hidden = np.concatenate([self._states(data, d, kept[d]) for d in "fb"], 2)
        logits = hidden @ w["o"] + w["ob"]
        logits -= logits.max(2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(2, keepdims=True)
        n = mask.sum()
        picked = p[:, np.arange(len(labels)), labels]
        loss = float(-(np.log(picked + 1e-9) * mask).sum() / n)
        d_logits = p
        d_logits[:, np.arange(len(labels)), labels] -= 1
        d_logits *= (mask / n)[:, :, None]
        grads = {"o": np.einsum("tbh,tbk->hk", hidden, d_logits), "ob": d_logits.sum((0, 1))}
        d_hidden = d_logits @ w["o"].T
        for i, d in enumerate("fb"):
            gx, gg, gc = np.zeros_like(w[f"{d}x"]), np.zeros_like(w[f"{d}g"]), np.zeros_like(w[f"{d}c"])
            inputs = np.empty((*data.shape, 3 * h), np.float32)
            d_state = np.zeros((data.shape[1], h), np.float32)
            for t, before, gates, candidate in reversed(kept[d]):
                update, reset = gates[:, :h], gates[:, h:]
                d_state += d_hidden[t, :, i * h : (i + 1) * h]
                d_candidate = d_state * update * (1 - candidate**2)
                d_update = d_state * (candidate - before) * update * (1 - update)
                d_part = d_candidate @ w[f"{d}c"].T
                d_reset = d_part * before * reset * (1 - reset)
                d_gates = np.concatenate((d_update, d_reset), 1)
                gc += (reset * before).T @ d_candidate
                gg += before.T @ d_gates
                inputs[t, :, : 2 * h], inputs[t, :, 2 * h :] = d_gates, d_candidate
                d_state = d_state * (1 - update) + d_part * reset + d_gates @ w[f"{d}g"].T
            order = np.argsort(data, axis=None, kind="stable")
            seen, starts = np.unique(data.reshape(-1)[order], return_index=True)
            gx[seen] = np.add.reduceat(inputs.reshape(-1, 3 * h)[order], starts)
            grads |= {f"{d}x": gx, f"{d}g": gg, f"{d}c": gc}
        return loss, grads

    def fit(self, texts: list[bytes], labels: np.ndarray, steps: int = STEPS, seed: int = SEED) -> "Network":
        rng = np.random.default_rng(seed)
        rows, marks = [], []
        for text, label in zip(texts, labels, strict=True):
            ends = max(1, len(text) - STRETCH)
            for at in np.unique(rng.integers(0, ends, STRETCHES)):
                piece = np.frombuffer(text[at : at + STRETCH], np.uint8)
                if len(piece):
                    rows.append(np.pad(piece, (0, STRETCH - len(piece))))
                    marks.append(label)
        data, marks = np.array(rows, np.uint8), np.array(marks)
        first, second = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(data), BATCH)
            part = np.ascontiguousarray(data[pick].T)
            _, grads = self.gradients(part, marks[pick], (part > 0).astype(np.float32))
            norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
            rate = RATE * (1 - step / (steps + 1))
            for k, g in grads.items():
                g = g * min(1.0, 1 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g**2
                self.w[k] -= (rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def documents(self, texts: pa.Array) -> np.ndarray:
        """Mean probabilities over all bytes of each text; rows of zeros for texts without bytes."""
        data, offsets = buffer_of(texts)
        sizes = np.diff(offsets) - 1  # buffer_of ends each text by a zero byte
        stretches = -(-sizes // STRETCH)
        total = int(stretches.sum())
        out = np.zeros((len(sizes), len(self.languages)), np.float64)
        if not total:
            return out
        owner = np.repeat(np.arange(len(sizes)), stretches)
        within = np.arange(total) - np.repeat(np.cumsum(stretches) - stretches, stretches)
        wide = np.arange(STRETCH + 2 * CONTEXT)
        place = within[:, None] * STRETCH - CONTEXT + wide
        inside = (place >= 0) & (place < sizes[owner][:, None])
        live = inside & (wide >= CONTEXT) & (wide < CONTEXT + STRETCH)
        padded = np.concatenate((np.zeros(CONTEXT, np.uint8), data, np.zeros(len(wide), np.uint8)))
        block = np.lib.stride_tricks.sliding_window_view(padded, len(wide))[offsets[:-1][owner] + within * STRETCH].copy()
        block[~inside] = 0
        p = self.probabilities(np.ascontiguousarray(block.T))
        p *= live.T
        sums = p.sum(1).T
        starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        out[owner[starts]] = np.add.reduceat(sums.astype(np.float64), starts)
        return out / np.maximum(sizes, 1)[:, None]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, steps: int = STEPS) -> Network:
    """A network fitted to the ``per_language`` labelled rows of each language whose ids have the smallest hashes.  Every language with a labelled row is a class, however small its share."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & (F.length(F.col(text_col)) > 0))
    languages = sorted(r[0] for r in labelled.select(lang_col).distinct().collect())
    if not languages:
        return Network([])
    order = Window.partitionBy("lang").orderBy("h", "id")
    chosen = labelled.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.xxhash64(F.col(id_col)).alias("h")).where(F.col("lang").isin(languages))
    ids = [r[0] for r in chosen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_language).select("id").collect()]
    rows = labelled.where(F.col(id_col).isin(ids)).select(F.col(id_col), F.col(lang_col), F.col(text_col)).collect()
    rows = sorted(((r[0], r[1], r[2].encode()) for r in rows if r[1] in languages and r[2]), key=lambda r: (r[0], r[1], r[2]))
    if not rows:
        return Network([])
    return Network(languages).fit([r[2] for r in rows], np.array([languages.index(r[1]) for r in rows]), steps)


def _labelling(network: Network, id_col: str, text_col: str):
    languages = pa.array(network.languages, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = column(batch, id_col), column(batch, text_col)
            for a, z in slices(texts, _SLICE):
                part = texts[a:z]
                if network.languages:
                    p = network.documents(part)
                    best, sure = p.argmax(1), p.max(1)
                else:
                    best, sure = np.zeros(z - a, np.int64), np.zeros(z - a)
                letters = pc.fill_null(pc.match_substring_regex(part, r"\pL"), False).to_numpy(zero_copy_only=False)
                known = (sure >= LEAST) & letters
                name = languages.take(pa.array(best, mask=~known)) if network.languages else pa.nulls(z - a, pa.string())
                yield pa.RecordBatch.from_arrays([ids[a:z], name, pa.array(np.where(letters, sure, 0.0))], ["doc_id", "predicted", "confidence"])

    return run


def identify(docs: DataFrame, network: Network | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, predicted, confidence) for every row, duplicates included.

    ``predicted`` is null where the document is rejected: its text is null, empty or without letters, or no language
    has a mean probability of ``LEAST``.  Rows with a null id are labelled too; rows with a null language are only left
    out of the training.  Without a labelled row every document is rejected.  Texts are read whole, however long; of
    equally probable languages the first by name is taken.  Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    network = network or train(docs, id_col, text_col, lang_col)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(released(_labelling(network, "doc_id", "text")), f"doc_id {kind}, predicted string, confidence double")


def accepted(docs: DataFrame, network: Network | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rows that ``identify`` rejects: one pass over the rows, without a join."""
    small_batches(docs.sparkSession)
    network = network or train(docs, id_col, text_col, lang_col)
    label = _labelling(network, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [x.column(1).is_valid() for x in label(iter([batch]))]
            yield batch.filter(pa.chunked_array(marks).combine_chunks()) if marks else batch

    return docs.mapInArrow(released(run), docs.schema)
