"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Texts are sequences of lower-cased words. A document leaks an item of n words when a window is within an edit
distance of ``rate`` * n words of it. Windows start at every word of a document.

Three steps find candidates. The first loses none: an edit changes at most two pairs of neighbouring words, so a window
can only be within d edits of an item if at least n - 1 - 2d of its n - 1 pairs occur in the benchmark; a running sum
gives this for all starts of all documents. For the starts that pass, the CGK random walk (Chakraborty, Goldenberg,
Koucky) turns edit distance into Hamming distance: it reads the window word by word, writes the word at each step, and a
random bit of (step, word) says whether to move on. Positions of the embedding are sampled into keys; items with an
equal key in any of the repetitions are candidates. Copies always meet, and need no search; windows with many edits meet
less and less often the longer they are. So last, the pairs are counted again for each single item, and all starts that
hold enough pairs of an item that is not known as a copy are candidates too: whatever the length, none is missed.
Candidates are verified by the exact edit distance.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, free_name, mix64, slices, small_batches
from .words import words_of

GAP = np.uint64(0x5851F42D4C957F2D)
WORDS_ONLY = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def plain(raw: bytes) -> bytes:
    """ASCII punctuation as white space: it separates words but does not count."""
    return raw.translate(WORDS_ONLY)


def best_window(item: list[int], text: list[int], most: int) -> tuple[int, int] | None:
    """(distance, start) of the part of ``text`` with the least edit distance to ``item``; None over ``most``. Equal distances: the first end."""
    costs, starts = [0] * (len(text) + 1), list(range(len(text) + 1))
    for i, x in enumerate(item, 1):
        corner, corner_start = costs[0], starts[0]
        costs[0] = i
        for j, y in enumerate(text, 1):
            keep, keep_start = costs[j], starts[j]
            c, at = corner + (x != y), corner_start
            if keep + 1 < c:
                c, at = keep + 1, keep_start
            if costs[j - 1] + 1 < c:
                c, at = costs[j - 1] + 1, starts[j - 1]
            costs[j], starts[j] = c, at
            corner, corner_start = keep, keep_start
    least = min(costs)
    return (least, starts[costs.index(least)]) if least <= most else None


@lru_cache(maxsize=256)
def walk(n: int, repetitions: int, samples: int) -> tuple[np.ndarray, np.ndarray]:
    """For each step and repetition the salt of the walk's bit, and whether the step is sampled."""
    rng, steps = np.random.default_rng(n), 2 * n
    salts = rng.integers(0, 1 << 63, (steps, repetitions), dtype=np.uint64)
    taken = np.zeros((steps, repetitions), bool)
    for r in range(repetitions):
        taken[rng.choice(steps, min(samples, steps), replace=False), r] = True
    return salts, taken


class BenchmarkIndex:
    """Items as word hashes, their word pairs, and the keys of their sampled embeddings."""

    def __init__(self, items: list[tuple[int, str]], rate: float = 0.2, repetitions: int = 32, samples: int = 3):
        raw = [plain((t or "").lower().encode("utf-8", "replace")) for _, t in items]
        words, counts = words_of(raw) if raw else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        cuts = np.split(words, np.cumsum(counts)[:-1]) if len(raw) else []
        both = [(i, w) for (i, _), w in zip(items, cuts, strict=True) if len(w) >= 3 and i is not None]
        self.ids, self.words = [i for i, _ in both], [w for _, w in both]
        self.rate, self.repetitions, self.samples = rate, repetitions, samples
        self.lengths = sorted({len(w) for w in self.words})
        self.pairs = np.unique(np.concatenate([self.pair(w) for w in self.words])) if both else np.zeros(0, np.uint64)
        # For each pair the items that hold it: those of pair p are owners[first[p] : first[p + 1]].
        held = [np.unique(np.searchsorted(self.pairs, self.pair(w))) for w in self.words]
        flat = np.concatenate(held) if both else np.zeros(0, np.int64)
        self.owners = np.repeat(np.arange(len(held)), [len(h) for h in held])[np.argsort(flat, kind="stable")] if both else flat
        self.first = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=len(self.pairs)))])
        self.length = np.array([len(w) for w in self.words], np.int64)
        self.need = np.array([self.least(len(w)) for w in self.words], np.int64)
        # How often one item holds one pair, at most: longer runs of a pair in a document cannot stem from an item.
        self.runs = max((int(np.unique(self.pair(w), return_counts=True)[1].max()) for w in self.words), default=1)
        self.weights = mix64(np.arange(1, max(self.lengths, default=0) + 1, dtype=np.uint64)) | np.uint64(1)
        self.table: list[dict[int, list[int]]] = [{} for _ in range(repetitions)]
        self.by_length: dict[int, list[int]] = {}
        for n, w in enumerate(self.words):
            self.by_length.setdefault(len(w), []).append(n)
        # Lengths in classes: the walk over a window reads as many words as the shortest item of its class has.
        self.classes: dict[int, list[int]] = {}
        for n in self.lengths:
            least = max((c for c in self.classes if n <= 1.2 * c), default=n)
            self.classes.setdefault(least, []).append(n)
        for least, lengths in self.classes.items():
            own = [k for n in lengths for k in self.by_length[n]]
            keys = self.keys(np.stack([self.words[k][:least] for k in own]), least)
            for r in range(repetitions):
                for k, key in zip(own, keys[:, r].tolist(), strict=True):
                    self.table[r].setdefault(key, []).append(k)

    @staticmethod
    def pair(w: np.ndarray) -> np.ndarray:
        return mix64(w[:-1] * GAP + w[1:])

    def most(self, n: int) -> int:
        return int(math.floor(self.rate * n))

    def least(self, n: int) -> int:
        """Pairs that a window within ``most`` edits of an item of n words holds at least."""
        return n - 1 - 2 * self.most(n)

    def keys(self, windows: np.ndarray, n: int) -> np.ndarray:
        """For each window (a row of n words) and repetition a key of sampled positions of its embedding.

        The walk takes 2n steps, as many as it needs on average to read the window; what lies behind the end is zero.
        """
        rows = len(windows)
        salts, taken = walk(n, self.repetitions, self.samples)
        padded = np.concatenate([windows, np.zeros((rows, 1), np.uint64)], 1)
        every = np.arange(rows)[:, None]
        at, key = np.zeros((rows, self.repetitions), np.int64), np.full((rows, self.repetitions), n, np.uint64)
        for j in range(int(np.flatnonzero(taken.any(1))[-1]) + 1):
            word = padded[every, at]
            use = np.flatnonzero(taken[j])
            if len(use):
                key[:, use] = mix64(key[:, use] * GAP + word[:, use] + np.uint64(j))
            at = np.minimum(at + (((word ^ salts[j]) * GAP >> np.uint64(63)) == 1), n)
        return key

    def occurring(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each pair of the words its number among the benchmark's pairs, and whether it is one of them."""
        pairs = self.pair(words)
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        found = self.pairs[at] == pairs
        # Of a run of one pair both ends stay: an item may align to the first or to the last of them.
        if len(pairs) > 2 * self.runs:
            inner = slice(self.runs, len(pairs) - self.runs)
            same = np.ones(len(pairs) - 2 * self.runs, bool)
            for k in range(1, self.runs + 1):
                same &= (pairs[inner] == pairs[self.runs - k : len(pairs) - self.runs - k]) & (pairs[inner] == pairs[self.runs + k : len(pairs) - self.runs + k])
            found[inner] &= ~same
        return at, found

    def starts(self, words: np.ndarray, found: np.ndarray) -> dict[int, np.ndarray]:
        """For each item length the starts whose windows hold enough pairs of the benchmark."""
        if found.sum() < min(map(self.least, self.lengths)):
            return {}
        total = np.concatenate([[0], np.cumsum(found, dtype=np.int32), np.full(self.lengths[-1], found.sum(), np.int32)]).astype(np.int32)
        out = {}
        near = self.enough(total, np.arange(len(words)), self.lengths)
        for lengths in self.classes.values() if len(near) else ():
            own = self.enough(total, near, lengths)
            for n in lengths if len(own) else ():
                good = self.enough(total, own, [n])
                if len(good):
                    out[n] = good
        return out

    def enough(self, total: np.ndarray, starts: np.ndarray, lengths: list[int]) -> np.ndarray:
        """The starts that can hold an item of one of the lengths; exact for one length, no start too few for several."""
        need = min(map(self.least, lengths))
        return starts[total[starts + lengths[-1] - 1] - total[starts] >= need]

    def matches(self, words: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, first word, distance) for each item that the document leaks, at its best window."""
        best: dict[int, tuple[int, int]] = {}
        if len(words) < 2 or not len(self.pairs):
            return []
        at, found = self.occurring(words)
        viable = self.starts(words, found)
        for least, lengths in self.classes.items():
            good = [viable[n] for n in lengths if n in viable]
            if not good:
                continue
            starts = np.unique(np.concatenate(good))
            padded = np.concatenate([words, np.zeros(least, np.uint64)])
            for block in np.array_split(starts, len(starts) // 2048 + 1):
                windows = padded[block[:, None] + np.arange(least)]
                # Equal windows (repeated words or phrases) are looked at once, at their first start.
                first = np.unique(mix64(windows * self.weights[:least]).sum(1), return_index=True)[1]
                block, windows = block[first], windows[first]
                keys = self.keys(windows, least)
                pairs = {(k, row) for r in range(self.repetitions) for row, key in enumerate(keys[:, r].tolist()) if key in self.table[r] for k in self.table[r][key]}
                by_item: dict[int, list[int]] = {}
                for k, row in pairs:
                    by_item.setdefault(k, []).append(int(block[row]))
                for k, near in by_item.items():
                    self.verify(k, sorted(near), words, best)
        if viable:
            for k, near in self.by_count(viable, at, found):
                if best.get(k, (1, 0))[0]:
                    self.verify(k, near, words, best)
        return sorted((self.ids[k], start, d) for k, (d, start) in best.items())

    def by_count(self, viable: dict[int, np.ndarray], at: np.ndarray, found: np.ndarray, span: int = 4096) -> Iterator[tuple[int, list[int]]]:
        """Each item with the starts whose windows hold enough pairs of this item, in stretches of ``span`` words."""
        asked = np.zeros(self.lengths[-1] + 1, bool)
        for part in np.unique(np.concatenate([s // span for s in viable.values()])).tolist():
            lo, hi = part * span, min(len(found), (part + 1) * span + self.lengths[-1])
            own = {n: s[np.searchsorted(s, lo) : np.searchsorted(s, lo + span)] for n, s in viable.items()}
            asked[:] = False
            asked[[n for n, s in own.items() if len(s)]] = True
            where = lo + np.flatnonzero(found[lo:hi])
            begin, count = self.first[at[where]], self.first[at[where] + 1] - self.first[at[where]]
            item = self.owners[np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())]
            where = np.repeat(where, count)
            good = (np.bincount(item, minlength=len(self.need)) >= self.need) & asked[self.length]
            if not good.any():
                continue
            keep = good[item]
            item, where = item[keep], where[keep]
            order = np.argsort(item, kind="stable")
            item, where = item[order], where[order]
            for k in np.flatnonzero(good).tolist():
                held = where[np.searchsorted(item, k) : np.searchsorted(item, k, "right")]
                n, s = int(self.length[k]), own[int(self.length[k])]
                s = s[np.searchsorted(held, s + n - 1) - np.searchsorted(held, s) >= self.need[k]]
                if len(s):
                    yield k, s.tolist()

    def verify(self, k: int, at: list[int], words: np.ndarray, best: dict[int, tuple[int, int]]) -> None:
        """Exact search for item k around the candidate starts ``at``; neighbouring starts share one stretch of words."""
        item, n = self.words[k], len(self.words[k])
        most = self.most(n)
        for s in at:
            if s + n <= len(words) and (words[s : s + n] == item).all():
                if best.get(k, (1, 0))[0] or s < best[k][1]:
                    best[k] = 0, s
                return
        while at and best.get(k, (1, 0))[0]:
            near = [s for s in at if s <= at[0] + n]
            at = at[len(near) :]
            lo = max(0, near[0] - most)
            got = best_window(item.tolist(), words[lo : near[-1] + n + most].tolist(), best.get(k, (most + 1, 0))[0] - 1)
            if got:
                best[k] = got[0], lo + got[1]


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``limit`` bytes by a hash of the id, one block at a time on the driver; each is held by every executor for one pass over the documents."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    total = items.agg(F.sum(F.length(F.col("text").cast("binary")))).first()[0] or 0
    n = -(-total // limit)
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).collect()
        if rows:
            yield sorted((r.item_id, r.text) for r in rows)


INDEXES: dict[str, BenchmarkIndex] = {}


def _index(token: str, sent, *options) -> BenchmarkIndex:
    """The index of a block, made once by each Python worker; one is held at a time."""
    if token not in INDEXES:
        INDEXES.clear()
        INDEXES[token] = BenchmarkIndex(sent.value, *options)
    return INDEXES[token]


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.2, repetitions: int = 32, samples: int = 3, block_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, item_id, first_word, n_words, edit_distance: one row for each document and item that it leaks.

    Items under three words, null items and null texts match nothing; documents are read whole, and rows that repeat a
    doc_id are judged one by one (their equal matches are one row). A null doc_id comes back as null. An empty
    benchmark or document table gives an empty result. The benchmark is cut into blocks of about ``block_bytes``: each
    costs a pass over the documents, and a broadcast that Spark may move to disk.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, first_word long, n_words long, edit_distance long"
    parts = []
    for block in _blocks(benchmark, block_bytes):
        sent, token = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], sent=sent, token=token) -> Iterator[pa.RecordBatch]:
            index = _index(token, sent, rate, repetitions, samples)
            length = dict(zip(index.ids, map(len, index.words), strict=True))
            for b in small_batches(batches):
                ids, rows = b.column("doc_id").to_pylist(), []
                for at, raw in slices([(t or "").lower() for t in b.column("text").to_pylist()]):
                    words, counts = words_of([plain(t) for t in raw])
                    start = 0
                    for i, c in enumerate(counts.tolist(), at):
                        rows += [(ids[i], k, first, length[k], d) for k, first, d in index.matches(words[start : start + c])]
                        start += c
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "first_word", "n_words", "edit_distance"])

        parts.append(narrow.mapInArrow(run, schema))
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("doc_id", "item_id").agg(F.min(F.struct("edit_distance", "first_word", "n_words")).alias("m")).select("doc_id", "item_id", "m.first_word", "m.n_words", "m.edit_distance")


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that leak no item; all columns as they were. Rows with a null doc_id stay."""
    name = free_name(docs, "_leaks")
    found = leaks(docs, benchmark, **options).where("doc_id is not null").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(found, F.col("doc_id").cast("long") == F.col(name), "left_anti")
