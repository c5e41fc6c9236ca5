"""Near-duplicate documents: MinHash signatures, a multi-index Hamming join, exact confirmation, connected components.

A signature holds 64 positions of 14 bits. It is split into 16 chunks of 4 positions. Two signatures that differ in at
most 31 positions have, by the pigeonhole principle, a chunk with at most one differing position; so every document is
indexed under each chunk with each one of its positions left open (64 keys), and every pair under the distance meets in
at least one key. Pairs at a similarity of 0.75 differ in 16 positions on average; more than 31 has a probability of
about 1e-5. Candidates are confirmed on the full shingle sets.

A finer signature of 512 single bits, of which pairs at 0.75 differ in 64 on average and in more than 95 with a
probability of about 1e-5, thins the candidates inside the joins. Work is kept near linear in the size of groups:
documents with equal sets are one class; each key first links its members to one pivot only (keys use eight orders, so
that a group has about eight pivots), and what is under both distances makes families. Inside a family each member's
link to its smallest neighbour is confirmed on the full sets; only members that this leaves outside the family's largest
part are compared with all others, by an inverted index, so a group of copies costs its size and not its square. Pairs of
different families that share a key are compared under both distances and a size ratio inside a join, and confirmed one
by one. So every pair is considered or already connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix64, slices, small_batches
from .words import shingle_sets

POSITIONS, CHUNK, MOST = 64, 4, 31
PIVOTS, BLOCK, LEAST_BLOCK, TASK_EDGES = 8, 1_000_000, 1 << 13, 1_000_000
LANES = POSITIONS // 4
SIG = [f"s{i}" for i in range(LANES)]
FINE, MOST_FINE = 512, 95
BITS = [f"b{i}" for i in range(FINE // 64)]
FACTORS = mix64(np.arange(1, POSITIONS + FINE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 64-bit words for each set: ``LANES`` with four 14-bit positions, a spare bit above each, then ``FINE`` single bits; zeros for an empty set."""
    out = np.zeros((len(sets), POSITIONS), np.uint64)
    fine = np.zeros((len(sets), len(BITS)), np.uint64)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        x = np.concatenate([sets[i] for i in full])
        at = np.cumsum([0] + [len(sets[i]) for i in full[:-1]])
        for k in range(POSITIONS):
            out[full, k] = mix64(np.minimum.reduceat(x * FACTORS[k], at)) & np.uint64(0x3FFF)
        for k in range(FINE):
            fine[full, k // 64] |= (mix64(np.minimum.reduceat(x * FACTORS[POSITIONS + k], at)) & np.uint64(1)) << np.uint64(k % 64)
    lanes = out.reshape(len(sets), LANES, 4)
    coarse = lanes[:, :, 0] << np.uint64(45) | lanes[:, :, 1] << np.uint64(30) | lanes[:, :, 2] << np.uint64(15) | lanes[:, :, 3]
    return np.concatenate([coarse, fine], 1)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small_batches(batches):
        ids = b.column("doc_id")
        for at, raw in slices(b.column("text").to_pylist()):
            sets = shingle_sets(raw)
            sig = signatures(sets).view(np.int64)
            one = np.array([s.sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            two = np.array([mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            columns = [ids.slice(at, len(raw)), pa.array([len(s) for s in sets], pa.int64()), pa.array(one), pa.array(two)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(np.ascontiguousarray(sig[:, i])) for i in range(sig.shape[1])], names=["doc_id", "n_shingles", "h1", "h2", *SIG, *BITS])


def _lane(word: Column, i: int) -> Column:
    return F.shiftrightunsigned(word, 45 - 15 * i).bitwiseAND(F.lit(0x3FFF))


def keys() -> Column:
    """The 64 index keys of a row: six bits for chunk and open position, then the other three positions."""
    out = []
    for q in range(LANES):
        word = F.col(SIG[q])
        for gap in range(CHUNK):
            a, b, c = (_lane(word, i) for i in range(CHUNK) if i != gap)
            out.append(F.lit((q * CHUNK + gap) << 42).bitwiseOR(F.shiftleft(a, 28)).bitwiseOR(F.shiftleft(b, 14)).bitwiseOR(c))
    return F.array(*out)


def close(a: str, b: str) -> Column:
    """Both signature distances are under their bounds, as arithmetic on 64-bit words that stays inside generated code."""
    low, high = sum(0x3FFF << 15 * i for i in range(4)), sum(0x4000 << 15 * i for i in range(4))
    # Adding 0x3FFF to a position carries into its spare bit unless the position is zero.
    coarse = " + ".join(f"bit_count((({a}.{s} ^ {b}.{s}) + {low}L) & {high}L)" for s in SIG)
    fine = " + ".join(f"bit_count({a}.{s} ^ {b}.{s})" for s in BITS)
    return F.expr(f"{fine} <= {MOST_FINE} AND {coarse} <= {MOST}")


def _confirm(need: int, whole: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for b in small_batches(batches, 500):
            a, c = b.column("a_text").to_pylist(), b.column("b_text").to_pylist()
            keep = np.zeros(b.num_rows, bool)
            for at, raw in slices(c):
                for i, s in enumerate(shingle_sets(raw), at):
                    if a[i] != last[0]:
                        last = a[i], shingle_sets([(a[i] or "").encode("utf-8", "replace")])[0]
                    both = len(np.intersect1d(last[1], s, assume_unique=True))
                    keep[i] = whole * both >= need * (len(last[1]) + len(s) - both)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return run


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) over the edges a[i], b[i], for the nodes that are not that smallest one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, two = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[one], root[two]
        open_ = x != y
        if not open_.any():
            break
        one, two, x, y = one[open_], two[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    low = root < np.arange(len(nodes))
    return nodes[low], nodes[root[low]]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
    if parts:
        node, root = forest(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["u", "v"])


def components(edges: DataFrame, scratch: Scratch, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b): root is the smallest id that the node reaches.

    Edges are joined in groups of about ``task_edges`` by one task each, which leaves a star for each component of the
    group. What one task can hold is done then; more goes on by large-star and small-star rounds, whose number grows with
    the logarithm of a component's size, until nothing changes. A node only needs its smallest neighbour, an aggregation;
    the join with it is left to Spark's skew handling where a node has very many. Every round is a written table.
    """

    def in_groups(now: DataFrame, n: int) -> DataFrame:
        return scratch.keep(now.repartition(-(-n // task_edges)).mapInArrow(_joined, "u long, v long"), "edges")

    now = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    n, seen = now.count(), None
    if n:
        now = in_groups(now, n)
    while n > task_edges:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        own = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(own, "u")
        after = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own.select("u", F.col("m").alias("v"))).distinct()
        after = scratch.keep(after, "edges")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        now, n = after, state[0]
        if state == seen:
            break
        if n <= task_edges:
            now = in_groups(now, n)
        seen = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, need: int = 75, whole: int = 100) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id, kept for every row of ``docs`` (doc_id, text).

    Documents are linked when ``whole`` * |intersection| >= ``need`` * |union| of their sets of five-word shingles.
    A null or empty text has an empty set and no link. Rows that share a doc_id are one document. A row with a null
    doc_id is linked with nothing, has a null component and is kept. An empty table gives an empty result; other
    columns of ``docs`` play no part. ``class_id`` is the smallest id with the same set.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_shingles long, h1 long, h2 long, " + ", ".join(f"{s} long" for s in SIG + BITS)
    signed = scratch.keep(narrow.mapInArrow(_sign, schema), "signed")

    linkable = signed.where("doc_id is not null and n_shingles > 0")
    classes = linkable.groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("class_id"), *[F.first(s).alias(s) for s in SIG + BITS])
    classes = scratch.keep(classes, "classes")
    slim = classes.select("class_id", "n_shingles", *SIG, *BITS)
    members = linkable.join(classes.select("n_shingles", "h1", "h2", "class_id"), ["n_shingles", "h1", "h2"]).select("doc_id", "class_id")
    shared_ids = members.groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("b")).where("a <> b").select("a", "b")

    entries = slim.select("class_id", F.explode(keys()).alias("key"))
    order = F.xxhash64(F.col("key") % PIVOTS, F.col("class_id"))
    pivots = entries.groupBy("key").agg(F.min("class_id").alias("low"), F.max("class_id").alias("high"), F.min_by("class_id", order).alias("pivot")).where("low <> high").select("key", "pivot")
    met = scratch.keep(entries.join(pivots, "key"), "met")
    star = met.where("class_id <> pivot").select(F.least("pivot", "class_id").alias("a"), F.greatest("pivot", "class_id").alias("b")).distinct()
    x, y = slim.alias("x"), slim.alias("y")
    near = star.join(y, F.col("b") == F.col("y.class_id")).join(x, F.col("a") == F.col("x.class_id")).where(_sizes("x", "y", need, whole) & close("x", "y")).select("a", "b")
    near = scratch.keep(near, "near")
    families = scratch.keep(components(near, scratch), "families")
    # One link a member is confirmed first, that to its smallest neighbour; what this connects needs no further pairs.
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    tree = _verified(scratch, narrow, both.groupBy("b").agg(F.min("a").alias("a")).where("a < b").select("a", "b"), need, whole)
    inside = tree.unionByName(scratch.keep(_within(narrow, slim, families, components(tree, scratch), need, whole), "inside"))

    # What is left: pairs that share a key and stand in different families.
    left = met.join(families, met.class_id == families.node, "left").select("key", "class_id", F.coalesce("root", "class_id").alias("root"))
    mixed = left.groupBy("key").agg(F.min("root").alias("one"), F.max("root").alias("two")).where("one <> two").select("key")
    left = left.join(mixed, "key").join(slim, "class_id")
    x, y = left.alias("x"), left.alias("y")
    meet = (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & (F.col("x.class_id") < F.col("y.class_id")) & _sizes("x", "y", need, whole) & close("x", "y")
    rest = x.join(y, meet).select(F.col("x.class_id").alias("a"), F.col("y.class_id").alias("b")).distinct()
    between = _verified(scratch, narrow, rest, need, whole)
    roots = components(inside.unionByName(between).unionByName(shared_ids), scratch)

    out = signed.select("doc_id", "n_shingles", "h1", "h2").join(classes.select("n_shingles", "h1", "h2", "class_id"), ["n_shingles", "h1", "h2"], "left")
    out = out.join(roots, out.class_id == roots.node, "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("root", "class_id", "doc_id"))
    return out.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def _sizes(a: str, b: str, need: int, whole: int) -> Column:
    """No pair whose set sizes differ by more than the similarity allows can be linked."""
    small, large = F.least(f"{a}.n_shingles", f"{b}.n_shingles"), F.greatest(f"{a}.n_shingles", f"{b}.n_shingles")
    return small * whole >= large * need


def _links(need: int, whole: int):
    """Confirmed links among the texts of one block, or between two: overlaps are counted by an inverted index of their shingles."""

    def run(table: pa.Table) -> pa.Table:
        ids, sides = table.column("class_id").to_numpy(), table.column("side").to_numpy()
        if sides.min() == 1:  # the other block is empty
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        sets = [s for _, raw in slices(table.column("text").to_pylist()) for s in shingle_sets(raw)]
        sizes = np.array([len(s) for s in sets])
        owners = np.repeat(np.arange(len(sets)), sizes)
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        every, owners = every[order], owners[order]
        group = list(range(len(sets)))

        def find(i: int) -> int:
            while group[i] != i:
                group[i] = group[group[i]]
                i = group[i]
            return i

        a, b = [], []
        two = sides.min() != sides.max()
        for i, s in enumerate(sets):
            if two and sides[i]:
                continue
            lo, hi = np.searchsorted(every, s), np.searchsorted(every, s, "right")
            n = hi - lo
            both = np.bincount(owners[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(sets))
            linked = (whole * both >= need * (len(s) + sizes - both)) & (both > 0)
            for j in np.flatnonzero(linked).tolist():
                if find(i) != find(j) and not (two and not sides[j]):
                    group[find(i)] = find(j)
                    a.append(min(ids[i], ids[j]))
                    b.append(max(ids[i], ids[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _within(docs: DataFrame, slim: DataFrame, families: DataFrame, linked: DataFrame, need: int, whole: int) -> DataFrame:
    """Confirmed links (a, b) that connect what is similar inside each family.

    ``linked`` says what is known to be connected. The largest part of a family is left as it is; every other member is
    compared with all members. Both kinds are cut by a hash into blocks of at most about BLOCK shingles; two blocks are a
    task, so a task's memory is bounded, and a family that is connected already has no task at all.
    """
    sized = slim.select("class_id", "n_shingles").join(families, F.col("class_id") == F.col("node")).select("class_id", "root", "n_shingles")
    sized = sized.join(linked.select(F.col("node").alias("class_id"), F.col("root").alias("part")), "class_id", "left").withColumn("part", F.coalesce("part", "class_id"))
    parts = sized.groupBy("root", "part").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    most = parts.groupBy("root").agg(F.max(F.struct("n", "part", "shingles")).alias("main"), F.sum("shingles").alias("all")).where("all > main.shingles")
    most = most.select("root", F.col("main.part").alias("main"), F.col("main.shingles").alias("own"), (F.col("all") - F.col("main.shingles")).alias("rest"))
    # Blocks of the main part are about as large as the rest, whose blocks are copied to each of them.
    size = F.least(F.lit(BLOCK), F.greatest(F.lit(LEAST_BLOCK), "rest"))
    most = most.select("root", "main", F.ceil(F.col("rest") / BLOCK).cast("int").alias("few"), F.ceil(F.col("own") / size).cast("int").alias("many"))
    placed = sized.select("class_id", "root", "part").join(most, "root")
    rest, own = F.col("part") != F.col("main"), F.pmod(F.xxhash64("class_id"), F.when(F.col("part") != F.col("main"), F.col("few")).otherwise(F.col("many"))).cast("int")
    # Blocks 0 to few - 1 are of the rest, the next ones of the main part; a block of the rest meets all, one of the main part only those.
    placed = placed.select("class_id", "root", F.when(rest, own).otherwise(own + F.col("few")).alias("own"), F.explode(F.when(rest, F.sequence(F.lit(0), F.col("few") + F.col("many") - 1)).otherwise(F.sequence(F.lit(0), F.col("few") - 1))).alias("other"))
    placed = placed.select("class_id", "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    rows = placed.join(docs.select(F.col("doc_id").alias("class_id"), "text"), "class_id")
    return rows.groupBy("root", "i", "j").applyInArrow(_links(need, whole), "a long, b long")


def _verified(scratch: Scratch, docs: DataFrame, pairs: DataFrame, need: int, whole: int) -> DataFrame:
    """The pairs whose full sets are similar enough; only texts that stand in a pair are moved."""
    pairs = scratch.keep(pairs, "between")
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = docs.join(ids, "doc_id", "left_semi")
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("b_text"))
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("a_text"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "a_text", "b_text")
    return scratch.keep(both.mapInArrow(_confirm(need, whole), "a long, b long").distinct(), "confirmed")
