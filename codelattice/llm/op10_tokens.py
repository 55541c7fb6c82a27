"""Token counts by dynamic programming over a trie of pre-tokens.

A pre-token is a maximal run of letters and digits, or of other visible characters; one that white space or the
text's begin precedes has the word mark in front.  Under a unigram model its best segmentation has the highest
sum of piece scores (integers, so that ties are exact: fewer tokens win).  The scores are forward values of a
prefix, so the distinct pre-tokens of a slice are walked in sorted order, which is the depth-first order of their
trie: what a pre-token shares with the one before it is not computed again, and each end stores its count.
Counts are kept by worker, by pre-token hash, in a bounded table that is emptied when it is full.

The vocabulary's scores are used where it is a unigram model; for a merge-rank vocabulary the score is that of
Zipf's law for the piece's rank.  A character outside the vocabulary costs a token for each of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.llm.common import released, small_batches
from codelattice.llm.textvec import buffer_of, column, runs, slices, span_hashes, word_mask

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Entries of a worker's table of pre-token counts.
KEPT = 500_000
_SLICE = 2 << 20
_SCALE = 1000
_SPACE = np.zeros(256, bool)
_SPACE[[0, 9, 10, 11, 12, 13, 32]] = True
_KNOWN: dict[int, dict[int, int]] = {}


def vocabulary(path: str = TOKENIZER) -> dict[str, int]:
    """Integer score of each ordinary piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    scores = {model.id_to_piece(i): model.get_score(i) for i in pieces}
    by_rank = all(float(s).is_integer() for s in scores.values())
    ranked = sorted(scores, key=lambda p: (-scores[p], p))
    return {p: round(-_SCALE * log(r + 2)) for r, p in enumerate(ranked)} if by_rank else {p: round(_SCALE * s) for p, s in scores.items()}


def piece_trie(scores: dict[str, int]) -> dict:
    """Nested dicts by character; the empty key holds a piece's score."""
    root: dict = {}
    for piece, score in scores.items():
        node = root
        for c in piece:
            node = node.setdefault(c, {})
        node[""] = score
    return root


def unknown_score(scores: dict[str, int]) -> int:
    return min(scores.values(), default=0) - 10 * _SCALE


def counts_of(words: Iterable[str], root: dict, unknown: int) -> list[int]:
    """Tokens of each of the sorted ``words``.

    For each prefix length the stack holds the best (score, tokens) and the pieces that are still open there, each
    with what was best where it began.
    """
    out, before = [], ""
    stack: list[list[tuple[dict, int, int]]] = [[(root, 0, 0)]]
    for word in words:
        shared, most = 0, min(len(before), len(word))
        while shared < most and before[shared] == word[shared]:
            shared += 1
        del stack[shared + 1 :]
        for c in word[shared:]:
            alive, open_now = stack[-1], []
            _, best, tokens = alive[-1]
            size = len(c.encode("utf-8", "surrogatepass"))
            best, tokens = best + unknown * size, tokens + size
            for node, score, count in alive:
                if (node := node.get(c)) is not None:
                    open_now.append((node, score, count))
                    if (piece := node.get("")) is not None and ((score := score + piece) > best or score == best and count + 1 < tokens):
                        best, tokens = score, count + 1
            open_now.append((root, best, tokens))
            stack.append(open_now)
        out.append(stack[-1][-1][2])
        before = word
    return out


def pre_tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end, with mark, text row) of each pre-token."""
    data, offsets = buffer_of(texts)
    space = _SPACE[data]
    word = word_mask(data) & ~space
    a, b = runs(word), runs(~word & ~space)
    start, end = np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1]))
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    marked = np.ones(len(start), bool)
    later = start > 0
    marked[later] = space[start[later] - 1]
    return data, start, end, marked, np.searchsorted(offsets, start, "right") - 1


def _counting(scores: dict[str, int], id_col: str, text_col: str):
    key = hash(tuple(sorted(scores.items())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, unknown, known = piece_trie(scores), unknown_score(scores), _KNOWN.setdefault(key, {})
        for batch in batches:
            ids, texts = column(batch, id_col), column(batch, text_col)
            for a, z in slices(texts, _SLICE):
                data, start, end, marked, row = pre_tokens(texts[a:z])
                hashes = span_hashes(data, start, end)
                hashes[marked] ^= np.uint64(0x9E3779B97F4A7C15)
                distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
                keys = distinct.tolist()
                counts = np.fromiter((known.get(k, -1) for k in keys), np.int64, len(keys))
                new = np.flatnonzero(counts < 0)
                if len(new):
                    raw = data.tobytes()
                    words = sorted(((MARK if marked[i] else "") + raw[start[i] : end[i]].decode(errors="replace"), j) for i, j in zip(first[new].tolist(), new.tolist(), strict=True))
                    if len(known) + len(words) > KEPT:
                        known.clear()
                    for (_, j), n in zip(words, counts_of((w for w, _ in words), root, unknown), strict=True):
                        counts[j] = n
                        known[keys[j]] = n
                tokens = np.bincount(row, counts[which], z - a).astype(np.int64)
                yield pa.RecordBatch.from_arrays([ids[a:z], pa.array(tokens), pa.array(np.bincount(row, minlength=z - a))], ["doc_id", "tokens", "pre_tokens"])

    return released(run)


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text", scores: dict[str, int] | None = None) -> DataFrame:
    """(doc_id, tokens, pre_tokens) for every row, duplicates and null ids included.

    Null and empty texts have no tokens.  An empty table gives no rows.  Other columns are ignored, whatever their names.
    """
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(_counting(scores if scores is not None else vocabulary(tokenizer), "doc_id", "text"), f"doc_id {kind}, tokens long, pre_tokens long")
