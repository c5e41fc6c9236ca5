"""The reader's lookups as relational operators over any tables, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest_wins(entries: DataFrame, keys: list[str], revision: str) -> DataFrame:
    """Of the rows with equal keys the one with the smallest revision; an aggregation, so hot keys are combined before the shuffle."""
    rest = [c for c in entries.columns if c not in (*keys, revision)]
    best = entries.groupBy(*keys).agg(F.min(F.struct(revision, *rest)).alias("_b"))
    return best.select(*keys, F.col(f"_b.{revision}").alias(revision), *[F.col(f"_b.{c}").alias(c) for c in rest])


def resolve(refs: DataFrame, objects: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """References joined with what they refer to; a missing target gives nulls."""
    return refs.join(objects, [refs[a] == objects[b] for a, b in on], "left")


def as_of(rows: DataFrame, ranges: DataFrame, by: list[str], at: str, start: str, values: list[str], slices: int = 1) -> DataFrame:
    """Each row with the values of the last range that starts at or before ``at``, within equal ``by``.

    One shuffle of both sides and one window, no pairs: ranges and rows are sorted together and the last range is carried
    on. Where single keys hold much of the table, ``slices`` cuts each key by quantiles of the starts; a row without a
    range in its own slice takes the last one of the slices before, of which there is one row a key and slice.
    """
    value = F.struct(start, *values)
    left = rows.select("*", F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(ranges.select(value).schema[0].dataType).alias("_v"))
    right = ranges.select(*[F.lit(None).cast(rows.schema[c].dataType).alias(c) if c not in by else F.col(c) for c in rows.columns], F.col(start).alias("_at"), F.lit(0).alias("_kind"), value.alias("_v"))
    both, keys = left.unionByName(right), list(by)
    if slices > 1:
        number = lambda c: F.col(c).cast("timestamp").cast("double") if ranges.schema[start].dataType.typeName().startswith(("timestamp", "date")) else F.col(c).cast("double")
        cuts = sorted(set(ranges.select(number(start).alias("x")).approxQuantile("x", [i / slices for i in range(1, slices)], 0.25 / slices)))
        bounds = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<double>")
        both, keys = both.withColumn("_slice", F.size(F.filter(bounds, lambda x: x <= number("_at")))), [*by, "_slice"]
    w = Window.partitionBy(*keys).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_last", F.last("_v", ignorenulls=True).over(w)).where("_kind = 1")
    if slices > 1:
        ends = both.where("_kind = 0").groupBy(*keys).agg(F.max_by("_v", "_at").alias("_end"))
        ends = rows.select(*by).distinct().withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(len(cuts))))).join(ends, keys, "left")
        before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select(*keys, F.last("_end", ignorenulls=True).over(before).alias("_before")).where("_before is not null")
        found = found.join(ends, keys, "left").withColumn("_last", F.coalesce("_last", "_before"))
    return found.select(*rows.columns, *[F.col(f"_last.{c}").alias(c) for c in (start, *values)])


MOST_COPIES = 10_000_000


def in_range(rows: DataFrame, ranges: DataFrame, code: str, lo: str, hi: str, default: dict[str, Column], by: list[str] = ()) -> DataFrame:
    """Each row with the values of the disjoint range that holds its code, or the defaults: an as-of join and an upper bound.

    Without keys rows are spread by a hash of the code over all shuffle partitions, with a copy of the ranges for each;
    where that would be more than MOST_COPIES, by quantiles of the ranges' starts, and a range goes where it reaches.
    """
    keys = list(by) or ["_all"]
    if not by:
        n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        if ranges.count() * n <= MOST_COPIES:
            rows, ranges = rows.withColumn("_all", F.pmod(F.xxhash64(code), F.lit(n)).cast("int")), ranges.withColumn("_all", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        else:
            bounds = F.array(*map(F.lit, sorted(set(ranges.approxQuantile(lo, [i / n for i in range(1, n)], 0.25 / n)))))
            part = lambda c: F.size(F.filter(bounds, lambda x: x <= c))
            rows, ranges = rows.withColumn("_all", part(F.col(code))), ranges.withColumn("_all", F.explode(F.sequence(part(F.col(lo)), part(F.col(hi)))))
    out = as_of(rows, ranges, keys, code, lo, [hi, *default])
    inside = F.col(code) <= F.col(hi)
    return out.select(*[c for c in rows.columns if c != "_all"], *[F.when(inside, F.col(c)).otherwise(d).alias(c) for c, d in default.items()])


def inherited(own: Column, *above: Column) -> Column:
    """The nearest value from a node up to its root."""
    return F.coalesce(own, *above)


def mode_by(rows: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """The value with the largest summed weight in each group; of equals the smallest."""
    sums = rows.groupBy(*by, value).agg(F.sum(weight).alias("_w"))
    return sums.groupBy(*by).agg(F.min(F.struct((-F.col("_w")).alias("w"), F.col(value).alias("v"))).alias("_m")).select(*by, F.col("_m.v").alias(value), (-F.col("_m.w")).alias("weight"))
