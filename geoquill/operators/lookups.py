"""Lookups, unions, row choice by order, and audits on keyed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row for each key: the first in the given order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def keep_last(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    return keep_first(df, keys, *[F.desc(c) for c in order])


def lookup(left: DataFrame, right: DataFrame, on: str, values: dict, order: str) -> DataFrame:
    """Adds columns of the right side by key; its last row wins and missing values get the default in `values`."""
    one = right.groupBy(on).agg(*[F.max_by(c, order).alias(c) for c in values])
    return left.join(one, on, "left").withColumns({c: F.coalesce(F.col(c), F.lit(d)) for c, d in values.items() if d is not None})


def first_match(left: DataFrame, right: DataFrame, on: str, columns: Sequence[str], order: str) -> DataFrame:
    """Left join to the first row of each key on the right."""
    return left.join(right.groupBy(on).agg(*[F.min_by(c, order).alias(c) for c in columns]), on, "left")


def not_done(df: DataFrame, *done: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Rows whose key is in none of the other tables."""
    for other in done:
        df = df.join(other.select(key), key, "left_anti")
    return df


def cap_per_group(df: DataFrame, keys: Sequence[str], n: int, *order: str | Column) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def sequence_ids(df: DataFrame, prefix: str, group: str, *order: str) -> DataFrame:
    """id `prefix_group_number`, numbered from 0 in each group; the order is unique in a group."""
    from geoquill.operators.ranks import ordered_rank

    numbers = ordered_rank(df.select(group, *order), [group], list(order), "_number")
    out = df.join(numbers, [group, *order])
    return out.withColumn("id", F.concat_ws("_", F.lit(prefix), F.col(group), (F.col("_number") - 1).cast("string"))).drop("_number")


def normalize_columns(df: DataFrame, columns: dict[str, str], flags: Sequence[str] = ()) -> DataFrame:
    """The union's columns in their order: missing ones null, flags booleans."""
    pick = lambda c, kind: (F.col(c) if c in df.columns else F.lit(None)).cast(kind)
    return df.select(*[(F.coalesce(pick(c, "boolean"), F.lit(False)) if c in flags else pick(c, kind)).alias(c) for c, kind in columns.items()])


def merge_clusters(base: DataFrame, rebuilt: Sequence[DataFrame], columns: dict[str, str], key: str = "cluster_id", group: str = "adm0") -> DataFrame:
    """Rows of groups that weren't rebuilt, with every rebuilt table; of equal keys the last table's last row stays."""
    parts = [normalize_columns(x, columns | {"ord": "long"}) for x in (base, *rebuilt)]
    groups = parts[1].select(group)
    for x in parts[2:]:
        groups = groups.union(x.select(group))
    kept = parts[0].join(groups.distinct(), group, "left_anti")
    every = kept.withColumn("_rank", F.lit(0))
    for k, x in enumerate(parts[1:], 1):
        every = every.unionByName(x.withColumn("_rank", F.lit(k)))
    return keep_last(every, [key], "_rank", "ord").drop("_rank")


def stage_audit(stages: dict[str, DataFrame], key: str) -> DataFrame:
    """Distinct-row counts of every stage by key, and whether they are all equal. Stages are counted first, then joined."""
    out = None
    for name, df in stages.items():
        n = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(name))
        out = n if out is None else out.join(n, key, "full")
    out = out.na.fill(0)
    names = list(stages)
    same = F.lit(True)
    for name in names[1:]:
        same = same & (F.col(name) == F.col(names[0]))
    return out.withColumn("equal", same)


def uniform(*parts: str | Column, seed: int = 42) -> Column:
    """A number from 0 to 1 that depends on the parts and the seed alone, the same in other SQL engines."""
    text = F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
