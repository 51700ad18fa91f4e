"""Rows with columns that only the data know."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Different keys that one table may have as columns.
COLUMNS = 5000


def found_keys(pairs: DataFrame, key: str, order: list[str]) -> list[str]:
    """The different keys in the order of their first place; more than COLUMNS are an error, so what comes to the driver is bounded."""
    firsts = pairs.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min(F.struct(*order)).alias("at"))
    keys = [r["k"] for r in firsts.orderBy("at", "k").select("k").limit(COLUMNS + 1).collect()]
    if len(keys) > COLUMNS:
        raise ValueError(f"more than {COLUMNS} different keys in {key}")
    return keys


def wide(pairs: DataFrame, group: list[str], key: str, value: str, order: list[str]) -> DataFrame:
    """A row for each group with a column for each different key, in the order of their first place by ``order``; of repeated keys the last value counts, null for keys that a group hasn't got.

    The keys are found by one aggregate, the rows made by another, both combined before they are shuffled. Pairs with a null key
    only give their group its row. A key that is named like a group column, in any case, gets _ at its end, and keys that differ only in case are numbered.
    """
    keys = found_keys(pairs, key, order)
    taken, named = {g.lower() for g in group}, []
    for k in keys:
        name = k
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        named.append(name)
    chosen = [F.max_by(F.when(F.col(key) == k, F.col(value)), F.when(F.col(key) == k, F.struct(*order))).alias(n) for k, n in zip(keys, named)]
    return pairs.groupBy(*group).agg(*chosen) if chosen else pairs.select(*group).distinct()
