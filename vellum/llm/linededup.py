"""Line dedup that can be undone: exact reference counts of lines, with sharded cuckoo filters in front.

The state is three tables. ``refs`` has a row for each line key and document that holds it; ``counts`` has for each key
the number of documents and the largest id; ``filters`` has, for each shard of the keys, a cuckoo filter of the *blocked*
keys, those found in enough documents. Inserting or deleting documents recounts the touched keys and adds to or removes
from the filters exactly the keys whose standing changed; so deleting what was inserted gives the earlier results.

Applying the state reads each text once. Documents none of whose lines is in a filter are done on the spot, nothing of
them is shuffled. The few possible hits are checked against the exact counts. Filters are sent to all executors while
their total size is under a limit; beyond it, the lines are joined with the exact counts directly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, free_name, replaced, small_batches, with_fields

BLANK = " \t\n\x0b\x0c\r"
SLOTS, KICKS, SHARD_KEYS, BROADCAST_KEYS = 4, 500, 1 << 15, 1 << 18


class Cuckoo:
    """A cuckoo filter of 64-bit hashes: 16-bit fingerprints, four in a bucket, and an exact list for what finds no place."""

    def __init__(self, raw: bytes | None = None, expect: int = 0):
        if raw:
            extra = int.from_bytes(raw[:4], "little")
            self.spilled = set(np.frombuffer(raw, np.uint64, extra, 4).tolist())
            self.table = np.frombuffer(raw, np.uint16, -1, 4 + 8 * extra).reshape(-1, SLOTS).copy()
        else:
            size = 1 << max(4, (int(expect / (SLOTS * 0.9)) + 1).bit_length())
            self.table, self.spilled = np.zeros((size, SLOTS), np.uint16), set()

    def dump(self) -> bytes:
        return len(self.spilled).to_bytes(4, "little") + np.array(sorted(self.spilled), np.uint64).tobytes() + self.table.tobytes()

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.table) - 1)
        print_ = (hashes >> np.uint64(48)).astype(np.uint16)
        print_[print_ == 0] = 1
        one = hashes & mask
        return print_, one, one ^ ((print_.astype(np.uint64) * np.uint64(0x5BD1E995)) & mask)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        f, one, two = self.places(hashes)
        found = ((self.table[one] == f[:, None]) | (self.table[two] == f[:, None])).any(1)
        return found | np.isin(hashes, np.fromiter(self.spilled, np.uint64, len(self.spilled))) if self.spilled else found

    def insert(self, key: int) -> None:
        f, one, two = (int(x[0]) for x in self.places(np.array([key], np.uint64)))
        mask, step = len(self.table) - 1, (lambda f: (f * 0x5BD1E995) & (len(self.table) - 1))
        undo = []
        for at in (one, two):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = f
                return
        at = two
        for k in range(KICKS):
            slot = (at + k) % SLOTS
            undo.append((at, slot, int(self.table[at, slot])))
            f, self.table[at, slot] = undo[-1][2], f
            at = (at ^ step(f)) & mask
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = f
                return
        for at, slot, old in reversed(undo):  # no place: put all back and keep the key itself
            self.table[at, slot] = old
        self.spilled.add(key)

    def delete(self, key: int) -> None:
        """Remove a key that was inserted."""
        if key in self.spilled:
            self.spilled.discard(key)
            return
        f, one, two = (int(x[0]) for x in self.places(np.array([key], np.uint64)))
        for at in (one, two):
            there = np.flatnonzero(self.table[at] == f)
            if len(there):
                self.table[at, there[0]] = 0
                return


def line_keys(text: str | None, least: int) -> list[bytes | None]:
    """For each line of the text the 16-byte hash of its key, or None for keys under ``least`` code points."""
    out = []
    for line in (text or "").split("\n"):
        key = line.strip(BLANK)
        out.append(hashlib.blake2b(key.encode("utf-8", "replace").lower(), digest_size=16).digest() if len(key) >= least else None)
    return out


def shard_and_hash(keys: list[bytes], shards: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
    return (both[:, 1] % np.uint64(shards)).astype(np.int64), both[:, 0].copy()


def _refs(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            keys, ids = [], []
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                own = {k for k in line_keys(t, least) if k is not None} if i is not None else ()
                keys.extend(own)
                ids.extend([i] * len(own))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], names=["key", "doc_id"])

    return run


class LineDedup:
    """The incremental index. Each change writes new tables beside the old ones, so a failed change leaves the state whole."""

    def __init__(self, spark: SparkSession, min_chars: int = 40, min_docs: int = 5, broadcast_limit: int = 64 << 20):
        self.spark, self.min_chars, self.min_docs, self.broadcast_limit = spark, min_chars, min_docs, broadcast_limit
        self.scratch = Scratch(spark, "linededup")
        self.refs = spark.createDataFrame([], "key binary, doc_id long")
        self.counts = spark.createDataFrame([], "key binary, n_docs long, last_doc long")
        self.filters = spark.createDataFrame([], "shard long, n_keys long, filter binary")
        self.shards = 1

    def _extract(self, docs: DataFrame) -> DataFrame:
        narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        return narrow.mapInArrow(_refs(self.min_chars), "key binary, doc_id long")

    def build(self, docs: DataFrame) -> LineDedup:
        """Index a whole table at once. The reference table is written, so that later changes don't depend on the source."""
        self.refs = self.scratch.keep(self._extract(docs).distinct(), "refs")
        self.counts = self.scratch.keep(self._count(self.refs), "counts")
        self._all_filters()
        return self

    def insert(self, docs: DataFrame) -> LineDedup:
        """Add documents; ids that are already there with the same line count once."""
        new = self.scratch.keep(self._extract(docs).join(self.refs, ["key", "doc_id"], "left_anti").distinct(), "delta")
        self.refs = self.scratch.keep(self.refs.unionByName(new), "refs")
        return self._recount(new)

    def delete(self, ids: DataFrame) -> LineDedup:
        """Take documents (doc_id) out again."""
        gone = self.scratch.keep(self.refs.join(ids.select("doc_id").distinct(), "doc_id", "left_semi").select("key", "doc_id"), "delta")
        self.refs = self.scratch.keep(self.refs.join(gone, ["key", "doc_id"], "left_anti"), "refs")
        return self._recount(gone)

    @staticmethod
    def _count(refs: DataFrame) -> DataFrame:
        return refs.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))

    def _recount(self, delta: DataFrame) -> LineDedup:
        touched = delta.select("key").distinct()
        old = self.counts.join(touched, "key", "left_semi")
        now = self._count(self.refs.join(touched, "key", "left_semi"))
        is_in, was_in = F.coalesce(F.col("n_docs") >= self.min_docs, F.lit(False)), F.coalesce(F.col("before") >= self.min_docs, F.lit(False))
        moved = old.select("key", F.col("n_docs").alias("before")).join(now, "key", "full").where(is_in != was_in).select("key", is_in.alias("add"))
        moved = self.scratch.keep(moved, "moved")
        self.counts = self.scratch.keep(self.counts.join(touched, "key", "left_anti").unionByName(now), "counts")
        held = self.filters.agg(F.coalesce(F.sum("n_keys"), F.lit(0))).first()[0] + moved.where("add").count()
        if held > 2 * SHARD_KEYS * self.shards or self.filters.isEmpty():  # more shards, each with room again
            self._all_filters()
            return self
        shards = self.shards

        def change(group: pd.DataFrame, moves: pd.DataFrame) -> pd.DataFrame:
            c = Cuckoo(group["filter"].iloc[0]) if len(group) else Cuckoo(expect=SHARD_KEYS)
            n = int(group["n_keys"].iloc[0]) if len(group) else 0
            shard = int((group if len(group) else moves)["shard"].iloc[0])
            if len(moves):
                for key, add in zip(shard_and_hash([bytes(k) for k in moves["key"]], shards)[1].tolist(), moves["add"], strict=True):
                    (c.insert if add else c.delete)(key)
                    n += 1 if add else -1
            return pd.DataFrame({"shard": [shard], "n_keys": [n], "filter": [c.dump()]})

        by = moved.withColumn("shard", self._shard())
        self.filters = self.scratch.keep(self.filters.groupBy("shard").cogroup(by.groupBy("shard")).applyInPandas(change, "shard long, n_keys long, filter binary"), "filters")
        return self

    def blocked(self) -> DataFrame:
        return self.counts.where(F.col("n_docs") >= self.min_docs)

    def _shard(self):
        """The second half of the key, little endian, modulo the number of shards, as ``shard_and_hash`` has it."""
        pairs = [F.substring(F.hex(F.substring("key", 9, 8)), 2 * i + 1, 2) for i in range(7, -1, -1)]
        return (F.conv(F.concat(*pairs), 16, 10).cast("decimal(20,0)") % F.lit(self.shards)).cast("long")

    def _all_filters(self) -> None:
        """Filters for all blocked keys; a shard holds about SHARD_KEYS of them, so none grows with the input."""
        self.shards = max(1, -(-self.blocked().count() // SHARD_KEYS))
        shards = self.shards

        def build(group: pd.DataFrame) -> pd.DataFrame:
            c = Cuckoo(expect=max(1024, 2 * len(group)))
            for key in shard_and_hash([bytes(k) for k in group["key"]], shards)[1].tolist():
                c.insert(key)
            return pd.DataFrame({"shard": [int(group["shard"].iloc[0])], "n_keys": [len(group)], "filter": [c.dump()]})

        made = self.blocked().select("key", self._shard().alias("shard")).groupBy("shard").applyInPandas(build, "shard long, n_keys long, filter binary")
        self.filters = self.scratch.keep(made, "filters")

    def drops(self, docs: DataFrame) -> DataFrame:
        """(doc_id, keys): the keys whose lines a document loses; only documents that lose any."""
        narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        size = self.filters.agg(F.coalesce(F.sum(F.length("filter")), F.lit(0))).first()[0]
        if size <= self.broadcast_limit:
            kept = self.spark.sparkContext.broadcast({r.shard: bytes(r["filter"]) for r in self.filters.select("shard", "filter").toLocalIterator()})
            shards, least = self.shards, self.min_chars

            def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                loaded = {k: Cuckoo(v) for k, v in kept.value.items()}
                refs = _refs(least)
                for b in refs(batches):
                    keys = b.column("key").to_pylist()
                    if not keys:
                        continue
                    shard, hashes = shard_and_hash(keys, shards)
                    hit = np.zeros(len(keys), bool)
                    for k, c in loaded.items():
                        own = np.flatnonzero(shard == k)
                        hit[own] = c.has(hashes[own])
                    yield b.filter(pa.array(hit))

            lines = narrow.mapInArrow(possible, "key binary, doc_id long")
        else:
            lines = self._extract(narrow)
        # A line of very many documents is one key of the join: few blocked keys are broadcast, more are left to Spark's skew handling.
        blocked = self.blocked()
        if (self.filters.agg(F.sum("n_keys")).first()[0] or 0) <= BROADCAST_KEYS and self.broadcast_limit > 0:
            blocked = F.broadcast(blocked)
        lost = lines.join(blocked, "key").where("doc_id <> last_doc")
        return lost.groupBy("doc_id").agg(F.collect_set("key").alias("lost_keys"))

    def apply(self, docs: DataFrame) -> DataFrame:
        """``docs`` with ``text`` without the lost lines, and n_lines, n_dropped, kept_sha256 (replaced if there).

        A null or empty text is one empty line and stays as it is; its digest is that of the empty text. Rows with a
        null doc_id count for no line and lose none. Rows that repeat a doc_id count once for a line and lose the same
        lines. A text that loses all of its lines becomes empty.
        """
        owner, keys_name = free_name(docs, "_lost_of"), free_name(docs, "_lost_keys")
        lost = self.drops(docs).select(F.col("doc_id").alias(owner), F.col("lost_keys").alias(keys_name))
        wide = docs.join(lost, F.col("doc_id").cast("long") == F.col(owner), "left").drop(owner)
        least = self.min_chars

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in small_batches(batches, 500):
                texts, n, gone, digests = [], [], [], []
                for t, keys in zip(b.column("text").to_pylist(), b.column(keys_name).to_pylist(), strict=True):
                    lines = (t or "").split("\n")
                    kept = lines
                    if keys:
                        away = set(keys)
                        kept = [x for x, k in zip(lines, line_keys(t, least), strict=True) if k not in away]
                    out = "\n".join(kept)
                    texts.append(t if t is None else out)
                    n.append(len(lines))
                    gone.append(len(lines) - len(kept))
                    digests.append(hashlib.sha256(out.encode("utf-8", "replace")).hexdigest())
                b = b.select([c for c in b.schema.names if c != keys_name])
                yield replaced(b, text=pa.array(texts, pa.string()), n_lines=pa.array(n, pa.int64()), n_dropped=pa.array(gone, pa.int64()), kept_sha256=pa.array(digests, pa.string()))

        return wide.mapInArrow(cut, with_fields(docs, "text string, n_lines long, n_dropped long, kept_sha256 string"))
