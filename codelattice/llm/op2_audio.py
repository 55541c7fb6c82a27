"""Chroma audio fingerprints and the alignment of recordings by them.

A recording (16-bit PCM in a WAV container) becomes frames of 12 pitch-class energies.  Filters compare the
sums of neighbouring rectangles of that image, taken from its integral image, and quantise the log-ratio to two bits
each; sixteen filters make one packed 32-bit integer for each position.  Two recordings are candidates when they share
packed integers; a histogram of the time offsets of these votes gives the alignments, and the share of differing bits over
the whole overlap at the best of them decides whether they are the same recording.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelattice.llm.common import drop, written
from codelattice.llm.textvec import column

RATE, FRAME, HOP = 4000, 1024, 512
LOWEST = 110.0
#: (kind, first pitch class, pitch classes, frames): kind 0 whole sum against its rest, 1 time halves, 2 pitch halves, 3 checkerboard, 4 middle third of the pitches, 5 middle third of the time.
FILTERS = [(1, 0, 12, 8), (2, 0, 12, 12), (3, 0, 12, 8), (2, 0, 6, 6), (2, 6, 6, 6), (1, 0, 4, 8), (1, 4, 4, 8), (1, 8, 4, 8), (4, 0, 12, 10), (4, 0, 6, 14), (4, 6, 6, 14), (5, 0, 12, 12), (3, 0, 6, 12), (3, 6, 6, 12), (2, 3, 6, 8), (0, 0, 3, 16)]
WIDTH = 16
THRESHOLDS = (-0.12, 0.0, 0.12)
#: Share of differing bits up to which the overlap is the same recording, and the least overlap in positions.  Up to 0.1
#: nearly every pair shares an exact integer; chance alignments of unrelated recordings begin at about 0.14.
MOST_BITS, LEAST_OVERLAP = 0.1, 16
#: Positions around a vote that are compared before it counts, and the share of their bits that may differ.
AROUND, MOST_AROUND = (-8, -4, 4, 8), 0.25
#: Frames below this share of the recording's loudest frame are silence: they don't vote.
SILENCE = 0.01
_GRAY = np.array([0, 1, 3, 2], np.uint32)
_CLASS = np.full(FRAME // 2 + 1, 12)
_hertz = np.arange(FRAME // 2 + 1) * RATE / FRAME
_CLASS[1:] = np.where((_hertz[1:] >= LOWEST) & (_hertz[1:] < RATE / 2.2), np.round(12 * np.log2(np.maximum(_hertz[1:], 1) / LOWEST)).astype(int) % 12, 12)
_FOLD = np.zeros((FRAME // 2 + 1, 12), np.float32)
_FOLD[np.flatnonzero(_CLASS < 12), _CLASS[_CLASS < 12]] = 1
_HANN = np.hanning(FRAME).astype(np.float32)


def wav_samples(data: bytes) -> np.ndarray:
    """Mono samples in [-1, 1] at ``RATE`` of a 16-bit PCM WAV file; none if it isn't one."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return np.zeros(0, np.float32)
    at, channels, rate, bits = 12, 0, 0, 0
    while at + 8 <= len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if data[at : at + 4] == b"fmt ":
            channels, rate, bits = int.from_bytes(data[at + 10 : at + 12], "little"), int.from_bytes(data[at + 12 : at + 16], "little"), int.from_bytes(data[at + 22 : at + 24], "little")
        elif data[at : at + 4] == b"data" and bits == 16 and channels and rate:
            raw = np.frombuffer(data[at + 8 : at + 8 + min(size, len(data) - at - 8) // (2 * channels) * 2 * channels], "<i2").reshape(-1, channels)
            mono = raw.mean(1, dtype=np.float32) / np.float32(32768)
            if rate != RATE and len(mono):
                mono = np.interp(np.arange(0, len(mono), rate / RATE), np.arange(len(mono)), mono).astype(np.float32)
            return mono
        at += 8 + size + size % 2
    return np.zeros(0, np.float32)


def wav_bytes(samples: np.ndarray, rate: int = RATE) -> bytes:
    pcm = np.clip(np.round(samples * 32767), -32768, 32767).astype("<i2").tobytes()
    head = b"fmt " + (16).to_bytes(4, "little") + (1).to_bytes(2, "little") + (1).to_bytes(2, "little") + rate.to_bytes(4, "little") + (2 * rate).to_bytes(4, "little") + (2).to_bytes(2, "little") + (16).to_bytes(2, "little")
    return b"RIFF" + (4 + len(head) + 8 + len(pcm)).to_bytes(4, "little") + b"WAVE" + head + b"data" + len(pcm).to_bytes(4, "little") + pcm


def chroma(samples: np.ndarray) -> np.ndarray:
    """[frame, pitch class] energies, with the loudness of each frame taken out afterwards."""
    if len(samples) < FRAME:
        return np.zeros((0, 12), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP] * _HANN
    spectrum = np.fft.rfft(frames, axis=1)
    return ((spectrum.real**2 + spectrum.imag**2).astype(np.float32)) @ _FOLD


def fingerprint(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed integers, whether each may vote) for each position of the recording; none for one of less than ``WIDTH`` frames."""
    image = chroma(samples)
    positions = len(image) - WIDTH + 1
    if positions <= 0:
        return np.zeros(0, np.uint32), np.zeros(0, bool)
    energy = image.sum(1)
    loud = energy > SILENCE * energy.max()
    image = np.sqrt(image / np.maximum(energy, 1e-12)[:, None])
    integral = np.zeros((len(image) + 1, 13))
    integral[1:, 1:] = image.cumsum(0).cumsum(1)
    t = np.arange(positions)

    def box(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return integral[t + t1, p1] - integral[t + t0, p1] - integral[t + t1, p0] + integral[t + t0, p0]

    packed = np.zeros(positions, np.uint32)
    for kind, p, high, wide in FILTERS:
        whole = box(0, wide, p, p + high)
        if kind == 0:
            a, scale = whole, high / 12
            b = (box(0, wide, 0, 12) - whole) * scale / (1 - scale)
        elif kind == 1:
            a = box(0, wide // 2, p, p + high)
            b = whole - a
        elif kind == 2:
            a = box(0, wide, p, p + high // 2)
            b = whole - a
        elif kind == 3:
            a = box(0, wide // 2, p, p + high // 2) + box(wide // 2, wide, p + high // 2, p + high)
            b = whole - a
        elif kind == 4:
            a = box(0, wide, p + high // 3, p + 2 * high // 3)
            b = (whole - a) / 2
        else:
            a = box(wide // 3, 2 * wide // 3, p, p + high)
            b = (whole - a) / 2
        ratio = np.log((a + 1e-3) / (b + 1e-3))
        packed = packed << np.uint32(2) | _GRAY[np.searchsorted(THRESHOLDS, ratio)]
    return packed, loud[:positions]


def _fingerprinting(samples_of: Callable[[object], np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, media = column(batch, "id"), column(batch, "media")
            packed, votes = [], []
            for x in media:
                p, v = fingerprint(samples_of(x.as_py())) if x.is_valid else (np.zeros(0, np.uint32), np.zeros(0, bool))
                packed.append(p.view(np.int32))
                votes.append(v)
            kinds = [pa.list_(pa.int32()), pa.list_(pa.bool_())]
            yield pa.RecordBatch.from_arrays([ids, pa.array(packed, kinds[0]), pa.array(votes, kinds[1])], ["id", "fingerprint", "votes"])

    return run


def fingerprints(media: DataFrame, id_col: str = "id", media_col: str = "media", samples_of: Callable[[object], np.ndarray] = wav_samples) -> DataFrame:
    """(id, fingerprint, votes) of each row.

    Null media, bytes that are no 16-bit PCM WAV and recordings of less than ``WIDTH`` frames have an empty fingerprint.
    Rows that repeat an id are fingerprinted each.  Other columns are ignored, whatever their names.
    """
    narrow = media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(_fingerprinting(samples_of), f"id {kind}, fingerprint array<int>, votes array<boolean>")


def _comparing(most_bits: float, least_overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets = column(batch, "offset").to_pylist()
            bits, overlap = np.zeros(len(offsets), np.int64), np.zeros(len(offsets), np.int64)
            lists = [(c := column(batch, n)) and (c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy()) for n in ("fp_a", "fp_b")]
            for i, offset in enumerate(offsets):
                a, b = (values[at[i] : at[i + 1]] for values, at in lists)
                first, last = max(0, -offset), min(len(a), len(b) - offset)
                overlap[i] = max(0, last - first)
                if last > first:
                    bits[i] = np.bitwise_count((a[first:last] ^ b[first + offset : last + offset]).view(np.uint32)).sum()
            share = bits / np.maximum(32 * overlap, 1)
            keep = pa.array((overlap >= least_overlap) & (share <= most_bits))
            made = pa.RecordBatch.from_arrays([*(column(batch, n) for n in ("a", "b", "offset", "votes")), pa.array(overlap), pa.array(bits), pa.array(share)], ["a", "b", "offset", "votes", "overlap", "bit_errors", "error_rate"])
            yield made.filter(keep)

    return run


def _classes(prints: DataFrame) -> DataFrame:
    """(id, class_id, fingerprint, voting): one print for each id; equal prints are one class, named by its smallest id."""
    one = prints.where("id is not null and size(fingerprint) > 0").groupBy("id").agg(F.max(F.struct(F.size("fingerprint").alias("n"), "fingerprint", F.col("votes").alias("voting"))).alias("p"))
    one = one.select("id", "p.fingerprint", "p.voting", F.sha2(F.concat_ws(",", F.col("p.fingerprint").cast("array<string>")), 256).alias("print"))
    heads = one.groupBy("print").agg(F.min("id").alias("class_id"))
    return one.join(heads, "print").select("id", "class_id", "fingerprint", "voting")


def aligned(prints: DataFrame, most_bits: float = MOST_BITS, least_overlap: int = LEAST_OVERLAP) -> DataFrame:
    """(a, b, offset, votes, overlap, bit_errors, error_rate): the pairs a < b of the same recording; position p of a is position p + offset of b.

    Recordings with equal fingerprints are one class, of which only the smallest id is paired.  Every offset that has a
    vote is compared, and the one with the least error counts; of equal ones that with most votes, then the one nearest
    0, then the smaller.  A vote is an equal packed integer at two places whose surroundings (``AROUND``) differ in at most
    ``MOST_AROUND`` of their bits.  Null ids and empty fingerprints match nothing; of rows that repeat an id the longest
    fingerprint counts, then the greatest.  An empty table gives no rows.  Pairs that share no packed integer are not
    found; no integer is left out for being frequent, except in silence.
    """
    return _aligned(written(_classes(prints), "op2-prints"), most_bits, least_overlap)


def _aligned(classes: DataFrame, most_bits: float, least_overlap: int) -> DataFrame:
    kind = classes.schema["id"].dataType.simpleString()
    one = classes.where("id = class_id")
    keys = one.select("id", "fingerprint", F.posexplode(F.arrays_zip("fingerprint", "voting")).alias("at", "k")).where("k.voting").select("id", "at", F.col("k.fingerprint").alias("key"), *(F.get("fingerprint", F.col("at") + F.lit(d)).alias(f"n{i}") for i, d in enumerate(AROUND)))
    left, right = (keys.withColumnsRenamed({"id": x, "at": f"at_{x}"} | {f"n{i}": f"n{i}_{x}" for i in range(len(AROUND))}) for x in "ab")
    differing = [F.bit_count(F.col(f"n{i}_a").bitwiseXOR(F.col(f"n{i}_b"))) for i in range(len(AROUND))]
    bits = reduce(Column.__add__, (F.coalesce(d, F.lit(0)) for d in differing))
    there = reduce(Column.__add__, (d.isNotNull().cast("int") for d in differing))
    votes = left.join(right, "key").where((F.col("a") < F.col("b")) & (bits <= 32 * MOST_AROUND * there)).groupBy("a", "b", (F.col("at_b") - F.col("at_a")).alias("offset")).agg(F.count("*").alias("votes"))
    both = votes.join(one.select(F.col("id").alias("a"), F.col("fingerprint").alias("fp_a")), "a").join(one.select(F.col("id").alias("b"), F.col("fingerprint").alias("fp_b")), "b")
    near = both.mapInArrow(_comparing(most_bits, least_overlap), f"a {kind}, b {kind}, offset int, votes long, overlap long, bit_errors long, error_rate double")
    best = near.groupBy("a", "b").agg(F.min(F.struct("error_rate", (-F.col("votes")).alias("few"), F.abs("offset").alias("far"), "offset", "overlap", "bit_errors")).alias("v"))
    return best.select("a", "b", "v.offset", (-F.col("v.few")).alias("votes"), "v.overlap", "v.bit_errors", "v.error_rate")


def matches(prints: DataFrame, most_bits: float = MOST_BITS, least_overlap: int = LEAST_OVERLAP) -> DataFrame:
    """(id, class_id, copies, links, partner_id, offset, error_rate): a row for each recording that is found again.

    ``class_id`` is the smallest id with the same fingerprint, ``copies`` the number of others that have it, and ``links``
    the number of other classes that hold the same recording as ``aligned`` says.  ``partner_id`` is the linked class of
    the least error (then the smallest), at ``offset`` from this one; null for a recording that only has copies.
    """
    classes = written(_classes(prints), "op2-prints")
    pairs = written(_aligned(classes, most_bits, least_overlap), "op2-pairs")
    sides = pairs.select(F.col("a").alias("class_id"), F.col("b").alias("o"), "offset", "error_rate").union(pairs.select("b", "a", -F.col("offset"), "error_rate"))
    linked = sides.groupBy("class_id").agg(F.count("*").alias("links"), F.min(F.struct("error_rate", "o", "offset")).alias("p"))
    sizes = classes.groupBy("class_id").agg((F.count("*") - 1).alias("copies"))
    found = sizes.join(linked, "class_id", "left").where("copies > 0 or links is not null")
    out = classes.select("id", "class_id").join(found, "class_id")
    out = written(out.select("id", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.col("p.o").alias("partner_id"), F.col("p.offset").alias("offset"), F.col("p.error_rate").alias("error_rate")), "op2-matches")
    drop(classes, pairs)
    return out


STEPS, NOTE = 64, 512
_TONES = np.sin(2 * np.pi * (LOWEST * 2 ** (1 + np.arange(12) / 12))[:, None] * np.arange(NOTE) / RATE).astype(np.float32)


def rendered(vector: list[float]) -> np.ndarray:
    """A recording that plays a vector: step t sounds pitch class p as loud as component t + 5 p (cyclically), if that is positive."""
    v = np.nan_to_num(np.array(vector, np.float32))
    if not len(v):
        return np.zeros(0, np.float32)
    loud = np.maximum(v[(np.arange(STEPS)[:, None] + 5 * np.arange(12)) % len(v)], 0)
    sound = (loud @ _TONES).reshape(-1)
    return sound / max(1e-9, float(np.abs(sound).max()))


def rendered_wav(vector: list[float]) -> np.ndarray:
    """The samples of the WAV file of ``rendered``: encoded and decoded again, as a media column would hold it."""
    return wav_samples(wav_bytes(rendered(vector)))
