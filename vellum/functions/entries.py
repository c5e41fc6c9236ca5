"""Dictionaries as map columns: entries set and removed, maps composed and turned round."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def with_entry(entries: Column, key: Column, value: Column) -> Column:
    """The map with an entry set; a null value removes the entry."""
    rest = without_entry(entries, key)
    return F.when(value.isNull(), rest).otherwise(F.map_concat(rest, F.create_map(key, value)))


def without_entry(entries: Column, key: Column) -> Column:
    return F.map_filter(entries, lambda k, _: k != key)


def composed(first: Column, second: Column, missing: Column) -> Column:
    """a to c from a to b and b to c; ``missing`` where b has no c."""
    return F.transform_values(first, lambda _, b: F.coalesce(second[b], missing))


def reversed_map(entries: Column) -> Column:
    """Values to keys; of entries with equal values the last counts."""
    pairs = F.map_entries(entries)
    last = F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda x: x["value"] == e["value"]))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["value"], e["key"])))
