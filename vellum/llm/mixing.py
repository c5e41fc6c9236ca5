"""Mixing sources to target weights as a Pfair schedule, with DataFrame functions only.

Documents of a source are cut into blocks of equally many rows in a hashed order. Block j of a source with weight w is
released at j / w and due at (j + 1) / w, counted in block slots; earliest deadline first among the released blocks
keeps every source within less than one block of its fluid share at all times. Weights are exact ratios of whole
numbers, so the schedule repeats after their sum: one period is planned per set of sources that still have blocks, or
less where a source runs out sooner (so a plan never has more slots than there are blocks), and every row finds its
slot by arithmetic and a join with the small plan. When a source runs out, the others go on in the proportion of their weights, so
each row appears exactly once; sources of weight zero come after all others, in equal parts.
"""

from __future__ import annotations

import heapq
import itertools
import json
import math
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name

MOST_SOURCES, MOST_SLOTS, BROADCAST_SLOTS = 2_000, 1 << 20, 1 << 16
LONG = 1 << 62


def shares(weights: dict[str, float]) -> dict[str, int]:
    """The least whole numbers in exactly the ratio of the weights as they are written in decimals."""
    exact = {s: Fraction(str(w)) for s, w in weights.items() if math.isfinite(w) and w >= 0}
    if len(exact) < len(weights):
        raise ValueError(f"weights must be finite and not negative: {sorted(set(weights) - set(exact))[:5]}")
    unit = math.lcm(*(x.denominator for x in exact.values()))
    whole = {s: int(x * unit) for s, x in exact.items()}
    common = math.gcd(*whole.values()) or 1
    return {s: x // common for s, x in whole.items()}


def one_period(slots: dict[str, int], left: dict[str, int] | None = None) -> list[str]:
    """The earliest-deadline-first order of one period: the source of each slot. It ends sooner with the last of ``left`` blocks of a source."""
    n = sum(slots.values())
    waiting = [(0, s, 0) for s in slots]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for t in range(n) if n < 1 << 62 else itertools.count():
        while waiting and waiting[0][0] <= t:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * n // slots[s]), s, j))
        _, s, j = heapq.heappop(ready)
        out.append(s)
        if left and j + 1 == left[s]:
            break
        if j + 1 < slots[s]:
            heapq.heappush(waiting, ((j + 1) * n // slots[s], s, j + 1))
    return out


def plan(blocks: dict[str, int], slots: dict[str, int]) -> tuple[list[dict], list[dict]]:
    """Phases, in each of which the same sources take part, and the pattern of each phase.

    A phase row has source, phase, first (its first block of the phase), until, begin (slot), q (slots of a period), n (period); a
    pattern row has phase, source and slots, those of its blocks in turn.
    """
    left, done = {s: b for s, b in blocks.items() if b > 0}, dict.fromkeys(blocks, 0)
    phases, patterns, begin = [], [], 0
    while left:
        active = {s: slots[s] for s in left if slots[s]} or dict.fromkeys(left, 1)
        common = math.gcd(*active.values())
        active = {s: q // common for s, q in active.items()}
        order = one_period(active, left)
        n, at = sum(active.values()), {s: [] for s in active}
        for t, s in enumerate(order):
            at[s].append(t)
        if len(order) < n or len(at[order[-1]]) == left[order[-1]]:
            length = len(order)  # a source runs out within the first period
        else:
            length = min((left[s] - 1) // q * n + at[s][(left[s] - 1) % q] + 1 for s, q in active.items())
        k = len(patterns) and patterns[-1]["phase"] + 1
        # A source that gets no slot before the first one ends has no block in this phase.
        for s in active:
            got = length // n * active[s] + sum(t < length % n for t in at[s])
            # Beyond 64 bits no block comes near the end of a period.
            phases.append({"source": s, "phase": k, "first": done[s], "until": done[s] + got, "begin": begin, "q": min(active[s], LONG), "n": min(n, LONG)})
            done[s] += got
            left[s] -= got
            patterns.append({"phase": k, "source": s, "slots": at[s]})
        left = {s: b for s, b in left.items() if b > 0}
        begin += length
    return phases, patterns


def planned(rows: dict[str, int], weights: dict[str, int], block_rows: int) -> tuple[int, list[dict], list[dict]]:
    """Rows of a block, phases and patterns. A plan has as many slots as the period or as there are blocks, whichever is
    less; only where both are over MOST_SLOTS, blocks get twice the rows until they are not."""
    while True:
        blocks = {s: -(-n // block_rows) for s, n in rows.items()}
        if min(sum(blocks.values()), sum(weights.values())) <= MOST_SLOTS or sum(weights.values()) == 0:
            return block_rows, *plan(blocks, weights)
        block_rows *= 2


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int = 16, bucket_rows: int = 2_000) -> DataFrame:
    """``docs`` with mix_block, mix_slot and mix_position (replaced if there): their place in the mixed order.

    ``weights`` are targets by source; a source that is not named has weight 1, with None all are equal; one of weight
    zero comes last. The ratios are kept exactly. A null source is a source of its own, the empty name. Every row is kept
    and placed once, repeated rows and null ids too; the order inside a source is by a hash of the whole row. An empty
    table gives an empty result. More than MOST_SOURCES sources are refused.
    """
    spark = docs.sparkSession
    docs = docs.drop("mix_block", "mix_slot", "mix_position")
    source, order, bucket, coarse, before, rank, phase, turn, of_phase, of_source, at_turn, at_slot = (free_name(docs, n) for n in "_source _order _bucket _coarse _before _rank _phase _turn _of_phase _of_source _at_turn _at_slot".split())
    name = F.coalesce(F.col("source").cast("string"), F.lit(""))
    # The whole row goes into the hash, so that rows with one id, or none, are spread as well.
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    keyed = docs.withColumn(source, name).withColumn(order, F.xxhash64(F.col("doc_id"), F.xxhash64(*hashed)))
    rows = {r[source]: r["n"] for r in keyed.groupBy(source).agg(F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()}
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    if not rows:
        return docs.select("*", *[F.lit(None).cast("long").alias(c) for c in ("mix_block", "mix_slot", "mix_position")])
    # Buckets by ranges of the hash bound a window's rows, also for a source with a third of all of them; coarse ranges
    # bound the windows that add up the buckets before.
    bits = max(0, sum(rows.values()) // bucket_rows).bit_length()
    keyed = keyed.withColumn(bucket, F.shiftrightunsigned(F.col(order), 64 - bits) if bits else F.lit(0).cast("long"))
    per = keyed.groupBy(source, bucket).agg(F.count("*").alias("n")).withColumn(coarse, F.shiftrightunsigned(F.col(bucket), bits // 2))
    earlier = lambda by, at: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wide = per.groupBy(source, coarse).agg(F.sum("n").alias("n")).select(source, coarse, earlier([source], coarse).alias("base"))
    per = per.withColumn("own", earlier([source, coarse], bucket)).join(wide, [source, coarse]).select(source, bucket, (F.col("base") + F.col("own")).alias(before))

    wanted = {s: float((weights or {}).get(s, 1.0)) for s in rows}
    block_rows, phases, patterns = planned(rows, shares(wanted), block_rows)

    def table(found: list[dict], ddl: str) -> DataFrame:
        return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(found)), f"array<struct<{ddl}>>")).alias("r")).select("r.*")

    # A source's phases follow each other, so the phase of a block is the last that starts at or before it.
    phases = table([p for p in phases if p["until"] > p["first"]], "source: string, phase: bigint, first: bigint, until: bigint, begin: bigint, q: bigint, n: bigint")
    phases = phases.groupBy(F.col("source").alias(source)).agg(F.array_sort(F.collect_list(F.struct("first", "phase", "begin", "q", "n"))).alias(phase))
    pattern = table(patterns, "phase: bigint, source: string, slots: array<bigint>").select(F.col("phase").alias(of_phase), F.col("source").alias(of_source), F.posexplode("slots").alias(at_turn, at_slot))
    small = sum(len(p["slots"]) for p in patterns) <= BROADCAST_SLOTS

    in_bucket = F.row_number().over(Window.partitionBy(source, bucket).orderBy(order, "doc_id")) - 1
    ranked = keyed.withColumn(rank, in_bucket).join(per, [source, bucket]).withColumn(rank, F.col(rank) + F.col(before))
    ranked = ranked.withColumn("mix_block", F.floor(F.col(rank) / block_rows).cast("long"))
    ranked = ranked.join(F.broadcast(phases), source).withColumn(phase, F.element_at(F.filter(phase, lambda p: p["first"] <= F.col("mix_block")), -1))
    since = F.col("mix_block") - F.col(f"{phase}.first")
    ranked = ranked.withColumn(turn, since % F.col(f"{phase}.q"))
    out = ranked.join(F.broadcast(pattern) if small else pattern, (F.col(source) == F.col(of_source)) & (F.col(f"{phase}.phase") == F.col(of_phase)) & (F.col(turn) == F.col(at_turn)))
    slot = (F.col(f"{phase}.begin") + F.floor(since / F.col(f"{phase}.q")) * F.col(f"{phase}.n") + F.col(at_slot)).cast("long")
    out = out.withColumn("mix_slot", slot)
    own = [F.col(f"`{c}`") for c in docs.columns]
    return out.select(*own, "mix_block", "mix_slot", (F.col("mix_slot") * block_rows + F.col(rank) % block_rows).cast("long").alias("mix_position"))
