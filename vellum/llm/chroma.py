"""Chroma audio fingerprints: pitch-class frames, integral-image filters, packed integers, alignment by offset histograms.

A recording (WAV bytes, 16-bit PCM) becomes frames of twelve pitch-class energies. The integral image of these frames
gives any rectangle's sum in four reads; sixteen fixed filters compare rectangles, each comparison is coded in two bits,
and a frame's filters are packed into a 32-bit integer. Two recordings are aligned by offset histograms: each pair of frames
votes for its offset with the bits in which its integers agree. This gives the share of differing bits at every offset.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches

RATE, FRAME, HOP, SPAN = 4000, 512, 256, 8
PACK_BYTES, PIECE_FRAMES = 1 << 17, 1 << 13
# Fixed filters: (kind, first pitch class, pitch classes, frames); the kinds halve the rectangle in pitch, in time, or in both.
FILTERS = [("p", 0, 4, 8), ("p", 4, 4, 8), ("p", 8, 4, 8), ("p", 2, 8, 8), ("p", 0, 12, 4), ("p", 6, 6, 4), ("t", 0, 4, 8), ("t", 4, 4, 8), ("t", 8, 4, 8), ("t", 0, 12, 8), ("t", 2, 6, 4), ("t", 6, 6, 4), ("b", 0, 6, 8), ("b", 6, 6, 8), ("b", 0, 12, 8), ("b", 3, 6, 4)]


def wav_bytes(samples: np.ndarray, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((1, 2, rate, 0, "NONE", ""))
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def read_wav(raw: bytes | None) -> np.ndarray:
    """Mono samples at RATE; several channels are averaged, another rate is resampled linearly; unreadable bytes give none."""
    try:
        with wave.open(io.BytesIO(raw or b"")) as w:
            channels, rate, width = w.getnchannels(), w.getframerate(), w.getsampwidth()
            data = w.readframes(w.getnframes())
    except (wave.Error, EOFError):
        return np.zeros(0)
    if width != 2 or not rate:
        return np.zeros(0)
    x = np.frombuffer(data[: len(data) // (2 * channels) * 2 * channels], "<i2").reshape(-1, channels).mean(1) / 32768
    return x if rate == RATE or not len(x) else np.interp(np.arange(0, len(x), rate / RATE), np.arange(len(x)), x)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    f = np.fft.rfftfreq(FRAME, 1 / RATE)
    out = np.zeros((len(f), 12))
    for i, hz in enumerate(f):
        if 80 <= hz <= 1800:
            out[i, round(12 * np.log2(hz / 440)) % 12] = 1
    return out


def chroma(samples: np.ndarray) -> np.ndarray:
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP] * np.hanning(FRAME)
    power = (np.abs(np.fft.rfft(frames, axis=1)) ** 2) @ _classes()
    return power / np.maximum(power.sum(1, keepdims=True), 1e-9)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """A packed 32-bit integer for each frame that has SPAN frames from it on."""
    c = np.log1p(20 * chroma(samples))
    n = len(c) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(c) + 1, 13))
    image[1:, 1:] = c.cumsum(0).cumsum(1)
    t = np.arange(n)

    def area(frame: int, frames: int, first: int, classes: int) -> np.ndarray:
        a, b = t + frame, t + frame + frames
        return image[b, first + classes] - image[a, first + classes] - image[b, first] + image[a, first]

    out = np.zeros(n, np.uint32)
    for k, (kind, first, classes, frames) in enumerate(FILTERS):
        h, w = classes // 2, frames // 2
        if kind == "p":
            v = area(0, frames, first, h) - area(0, frames, first + h, h)
        elif kind == "t":
            v = area(0, w, first, classes) - area(w, w, first, classes)
        else:
            v = area(0, w, first, h) + area(w, w, first + h, h) - area(w, w, first, h) - area(0, w, first + h, h)
        scale = 0.05 * frames * classes / 12
        level = (v > -scale).astype(np.uint32) + (v > 0) + (v > scale)
        out |= (level ^ (level >> np.uint32(1))).astype(np.uint32) << np.uint32(2 * k)  # Gray code: neighbouring levels differ in one bit
    return out


def spectra(prints: list[np.ndarray], size: int) -> np.ndarray:
    """(frequencies, prints, 32): the transforms of the bits as 1 and -1, zero behind the end."""
    out = np.zeros((len(prints), 32, size), np.float32 if size <= 1 << 13 else np.float64)
    for x, p in zip(out, prints, strict=True):
        x[:, : len(p)] = (p >> np.arange(32, dtype=np.uint32)[:, None] & np.uint32(1)) * 2.0 - 1
    return np.ascontiguousarray(np.fft.rfft(out, axis=2).transpose(2, 0, 1))


def room(a: list[np.ndarray], b: list[np.ndarray]) -> int:
    """The length of transforms that holds all offsets of b against a."""
    return 1 << (max(map(len, a)) + max(map(len, b)) - 1).bit_length()


def histograms(a: list[np.ndarray], b: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, the frames that overlap and the votes there (bits that agree less bits that differ, within 0.01), as (offsets, a, b).

    ``x`` and ``y`` are the spectra: the votes of all pairs of frames are a correlation of the bits.
    """
    most_a, most_b = max(map(len, a)), max(map(len, b))
    votes = np.fft.irfft(np.conj(x) @ y.transpose(0, 2, 1), room(a, b), axis=0)
    offsets = np.arange(1 - most_a, most_b)
    # Equal lengths are kept once: the overlaps then need no row for each print.
    of_a, of_b = (np.array(n if len(set(n)) > 1 else n[:1]) for n in ([len(p) for p in a], [len(p) for p in b]))
    d = offsets[:, None, None]
    return offsets, np.minimum(of_a[:, None], of_b - d) - np.maximum(0, -d), votes[offsets]


def align(a: np.ndarray, b: np.ndarray, least: int = 8, most_errors: float = 0.1) -> tuple[int, float] | None:
    """(offset, share of differing bits) of b against a; None without an overlap of ``least`` frames.

    Of all offsets with at most ``most_errors`` differing bits the one where most bits agree (the first of equals); if
    there is none, the one with the least share.
    """
    if min(len(a), len(b)) < max(1, least):
        return None
    offsets, overlap, votes = (x.ravel() for x in histograms([a], [b], *(spectra([p], room([a], [b])) for p in (a, b))))
    keep = overlap >= least
    offsets, overlap = offsets[keep], overlap[keep]
    differ = 16 * overlap - np.rint(votes[keep].astype(float)) / 2
    share = differ / (32 * overlap)
    good = share <= most_errors
    at = int(np.argmax(np.where(good, 32 * overlap - differ, -1))) if good.any() else int(np.argmin(share))
    return int(offsets[at]), float(share[at])


def aligned(a: list[np.ndarray], b: list[np.ndarray], least: int = 8, most_errors: float = 0.1) -> Iterator[tuple[int, int, int, float]]:
    """(index in a, index in b, offset, share) for all pairs that ``align`` puts within ``most_errors``; in pieces of bounded memory."""

    def parts(prints: list[np.ndarray]) -> list[list[int]]:
        # Neighbours in length share a piece, so that short prints are not padded to long ones.
        out: list[list[int]] = []
        for i in sorted((i for i, p in enumerate(prints) if len(p) >= max(1, least)), key=lambda i: (len(prints[i]), i)):
            n = len(prints[i])
            if not out or n > 2 * len(prints[out[-1][0]]) or (len(out[-1]) + 1) * n > PIECE_FRAMES:
                out.append([])
            out[-1].append(i)
        return out

    asked, known = parts(a), {}
    for q in parts(b):
        there = [b[i] for i in q]
        spectrum: dict[int, np.ndarray] = {}
        for k, p in enumerate(asked):
            here = [a[i] for i in p]
            size = room(here, there)
            if size not in spectrum:
                spectrum[size] = spectra(there, size)
            if (k, size) not in known:
                known[k, size] = spectra(here, size)
            offsets, overlap, votes = histograms(here, there, known[k, size], spectrum[size])
            # A little under the limit, so that rounding loses none; the exact share decides.
            good = votes >= np.where(overlap >= least, overlap * (32 - 64 * most_errors) - 0.25, np.inf).astype(votes.dtype)
            i, j = np.nonzero(good.any(0))
            if not len(i):
                continue
            m = np.broadcast_to(overlap, votes.shape)[:, i, j]
            differ = 16 * m - np.rint(votes[:, i, j].astype(float)) / 2
            share = differ / (32 * np.maximum(m, 1))
            agree = np.where((share <= most_errors) & (m >= least), 32 * m - differ, -1)
            at, each = agree.argmax(0), np.arange(len(i))
            for n in np.flatnonzero(agree[at, each] >= 0).tolist():
                yield p[i[n]], q[j[n]], int(offsets[at[n]]), float(share[at[n], n])


def fingerprints(recordings: DataFrame) -> DataFrame:
    """(rec_id, n_frames, print) from (rec_id, audio): the print is the packed integers, little endian; empty for null, short or unreadable audio."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 100):
            prints = [fingerprint(read_wav(x)) for x in b.column("audio").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("rec_id"), pa.array([len(p) for p in prints], pa.int64()), pa.array([p.tobytes() for p in prints], pa.binary())], names=["rec_id", "n_frames", "print"])

    return recordings.select(F.col("rec_id").cast("long").alias("rec_id"), "audio").mapInArrow(run, "rec_id long, n_frames long, print binary")


def search(prints: DataFrame, every: int = 50, most_errors: float = 0.1) -> DataFrame:
    """Recordings whose id is divisible by ``every``, searched against all.

    A row for each recording: rec_id, n_frames, class_id (smallest id with the same print), is_query, and for queries
    ``matches``: an array of (class_id, offset, error) of all other classes that align with at most ``most_errors``
    differing bits over 8 frames or more. Every query is compared with every class at every offset, so no pair is missed;
    the work grows with queries times classes. A null id has no class and no matches; a print of under 8 frames matches
    nothing, and an empty print is a class of its own. Rows that repeat an id are rows of the result each. An empty table
    gives an empty result; other columns of ``prints`` play no part.
    """
    scratch = Scratch(prints.sparkSession, "chroma")
    prints = scratch.keep(prints.select("rec_id", "n_frames", "print"), "prints")
    classes = prints.where("rec_id is not null and n_frames > 0").groupBy("print").agg(F.min("rec_id").alias("class_id"), F.max((F.col("rec_id") % every == 0).cast("int")).alias("asked"))
    classes = scratch.keep(classes, "classes")

    def packed(name: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def row(ids: list[int], raw: list[bytes]) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([raw], pa.list_(pa.binary()))], names=[f"{name}_ids", name])

            ids, raw, size = [], [], 0
            for b in batches:
                for i, p in zip(b.column("class_id").to_pylist(), b.column("print").to_pylist(), strict=True):
                    if ids and size + len(p) > PACK_BYTES:
                        yield row(ids, raw)
                        ids, raw, size = [], [], 0
                    ids.append(i)
                    raw.append(p)
                    size += len(p)
            if ids:
                yield row(ids, raw)

        return run

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                asked, ids = b.column("a_ids")[k].as_py(), b.column("b_ids")[k].as_py()
                x, y = ([np.frombuffer(p, np.uint32) for p in b.column(n)[k].as_py()] for n in "ab")
                rows = ((asked[i], ids[j], offset, share) for i, j, offset, share in aligned(x, y, most_errors=most_errors) if asked[i] != ids[j])
                while some := list(islice(rows, 10_000)):
                    c = list(zip(*some, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.float64())], names=["query_id", "class_id", "offset", "error"])

    asked = classes.where("asked = 1").select("class_id", "print").mapInArrow(packed("a"), "a_ids array<long>, a array<binary>")
    index = classes.select("class_id", "print").mapInArrow(packed("b"), "b_ids array<long>, b array<binary>")
    # Packs are written first, so that the cross join repeats a read and not the packing.
    found = scratch.keep(index, "packs").crossJoin(scratch.keep(asked, "asked"))
    found = found.mapInArrow(compare, "query_id long, class_id long, offset long, error double")
    found = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("class_id", "offset", "error"))).alias("matches"))
    out = prints.join(classes.select("print", F.col("class_id").alias("own")), "print", "left").join(found, F.col("own") == F.col("query_id"), "left")
    is_query = F.coalesce(F.col("rec_id") % every == 0, F.lit(False))
    own_class = F.when(F.col("rec_id").isNotNull(), F.coalesce("own", "rec_id"))
    return out.select("rec_id", "n_frames", own_class.alias("class_id"), is_query.alias("is_query"), F.when(is_query, F.coalesce("matches", F.expr("array()").cast("array<struct<class_id:bigint,offset:bigint,error:double>>"))).alias("matches"))


def render(vectors: DataFrame) -> DataFrame:
    """(rec_id, audio) from (vec_id, embedding): each value plays a note of its size for two hops; a test signal for a table without audio."""
    scale = 220 * 2 ** (np.arange(24) / 12)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = np.arange(2 * HOP) / RATE
        tones = np.sin(2 * np.pi * scale[:, None] * t) * 0.4
        for b in small_batches(batches, 100):
            audio = []
            for v in b.column("embedding").to_pylist():
                x = np.nan_to_num(np.array([y or 0.0 for y in v or []], float))
                audio.append(wav_bytes(tones[np.clip((x * 40 + 12).astype(int), 0, 23)].ravel()) if len(x) else None)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(audio, pa.binary())], names=["rec_id", "audio"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding")).mapInArrow(run, "rec_id long, audio binary")
