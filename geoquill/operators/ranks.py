"""Ranks and exact quantiles of groups of any size: no window and no buffer holds a whole group.

Rows are dealt by Spark's range partitioning, whose borders come from a sample of the data, and written once; a rank is the rows of the group in the
parts before, which are counted, plus the place within the part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoquill.sources.tables import write_table

#: Rows of a part, about, once there are as many parts as the session has shuffle partitions; and the least that a part is cut to before.
PART_ROWS, LEAST_PART = 500_000, 10_000


def in_parts(df: DataFrame, *order: str | Column) -> DataFrame:
    """df, written, with _part: rising in the given order, at most about PART_ROWS rows each; rows alike in the order are in one part.

    df is computed once, for the first table; counts and the borders' sample come from that.
    """
    rows = write_table(df, "rows")
    count = rows.count()
    n = max(count // PART_ROWS + 1, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), count // LEAST_PART + 1))
    return write_table((rows.repartitionByRange(n, *order) if n > 1 else rows.coalesce(1)).withColumn("_part", F.spark_partition_id()), "parts")


def ordered_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rank") -> DataFrame:
    """Adds the row's number, from 1, in its group in the given order. df should be narrow: it is written once."""
    parts = in_parts(df, *keys, *order)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    within = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    ranked = parts.withColumn("_within", within)
    joined = ranked.alias("x").join(sums.alias("y"), [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in (*keys, "_part")])
    return joined.select("x.*", (F.col("_within") + F.col("_before")).alias(name)).drop("_part", "_within")


def quantiles(df: DataFrame, keys: Sequence[str], column: str, shares: Sequence[float], names: Sequence[str]) -> DataFrame:
    """keys, _n (rows with a value), and the exact quantiles, by linear interpolation, of the column's values in each group.

    Values are counted first, so rows of one value, however many, are a row; counts are then summed up over range partitions.
    """
    counted = df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    parts = in_parts(counted, *keys, "_v")
    upto = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    sums = parts.groupBy(*keys, "_part").agg(F.sum("_c").alias("_s")).withColumn("_before", F.coalesce(F.sum("_s").over(upto), F.lit(0))).drop("_s")
    within = F.sum("_c").over(Window.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    same = lambda *cs: [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in cs]
    placed = parts.withColumn("_within", within).alias("x").join(sums.alias("y"), same(*keys, "_part")).select("x.*", (F.col("_within") + F.col("_before")).alias("_to"))
    sizes = parts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    joined = placed.alias("x").join(sizes.alias("y"), same(*keys)).select("x.*", "_n") if keys else placed.crossJoin(F.broadcast(sizes))  # one row
    # A value holds the places (from 0) from _to - _c to before _to.
    holds = lambda place: (place >= F.col("_to") - F.col("_c")) & (place < F.col("_to"))
    spot = [F.lit(p) * (F.col("_n") - 1) for p in shares]
    wanted = F.lit(False)
    for x in spot:
        wanted = wanted | holds(F.floor(x)) | holds(F.ceil(x))
    low, high = lambda x: F.max(F.when(holds(F.floor(x)), F.col("_v"))), lambda x: F.max(F.when(holds(F.ceil(x)), F.col("_v")))
    value = lambda x: low(x) + (high(x) - low(x)) * F.max(x - F.floor(x))
    return joined.where(wanted).groupBy(*keys).agg(F.max("_n").alias("_n"), *(value(x).alias(n) for x, n in zip(spot, names, strict=True)))
