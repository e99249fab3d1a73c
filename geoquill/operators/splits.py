"""Assignment of candidates to train, val, test and hold-out splits.

Every random order is a hash of the id and a seed, so splits don't change between runs or engines. Ranks are taken inside strata.
Stratified splits place every label of 0 or more, and rows are named by candidate_id throughout.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoquill.functions.labels import iso_prefix
from geoquill.operators.lookups import uniform
from geoquill.operators.ranks import ordered_rank


def _placed(rank: Column, n_test: Column, n_val: Column) -> Column:
    return F.when(rank <= n_test, "test").when(rank <= n_test + n_val, "val").otherwise("train")


def country_balanced_split(df: DataFrame, val: float, test: float, country: str = "country", key: str = "candidate_id", seed: int = 42) -> DataFrame:
    """As many val and test rows from each country as the smallest one gives: max(1, int(size * share)); the rest trains."""
    name = F.coalesce(F.col(country), F.lit("unknown"))
    least = F.broadcast(df.groupBy(name.alias("c")).count().agg(F.coalesce(F.min("count"), F.lit(0)).alias("_least")))  # one row
    n = lambda share: F.greatest(F.lit(1), F.floor(F.col("_least") * share).cast("int"))
    ranked = hash_rank(df.withColumn("_name", name), uniform(key, seed=seed), key, strata="_name")
    return ranked.crossJoin(least).withColumn("split", _placed(F.col("_rank"), n(test), n(val))).drop("_least", "_rank", "_name")


def stratified_split(df: DataFrame, val: float, test: float, label: str = "label", key: str = "candidate_id", seed: int = 42, at_least: int = 1) -> DataFrame:
    """Shares of val and test in each label; at_least 0 leaves small labels without."""
    n = lambda share: F.greatest(F.lit(at_least), F.floor(F.col("_size") * share).cast("int"))
    ranked = hash_rank(df, uniform(key, seed=seed), key, strata=label)
    return ranked.withColumn("split", _placed(F.col("_rank"), n(test), n(val))).drop("_rank", "_size")


def _listed(regions: Sequence[str]) -> Column:
    """Whether country_key and state match one of the regions `country` or `country/state`; a row without a state matches every region of its country."""
    hit = F.lit(False)
    for r in regions:
        country, _, state = r.partition("/")
        one = F.col("country_key") == country
        hit = hit | (one & (F.coalesce(F.col("state"), F.lit("")).isin("", state)) if state else one)
    return hit


def region_split(df: DataFrame, train: Sequence[str], val: Sequence[str], test: Sequence[str], order: str = "ord") -> DataFrame:
    """Split by region: test before val before train. Rows without a state whose country is only listed by states, or in several splits, are dealt
    in row order in proportion to the others: test first, then val, the rest to train. Rows of no region get none."""
    sides = {"train": train, "val": val, "test": test}
    whole: dict[str, set[str]] = {}
    for split, regions in sides.items():
        for r in regions:
            country, _, state = r.partition("/")
            whole.setdefault(country, set()).update([] if state else [split])
    fixed = {c: next(iter(s)) for c, s in whole.items() if len(s) == 1}
    loose = [c for c in whole if c not in fixed]
    stateless = F.coalesce(F.col("state"), F.lit("")) == ""
    by_country = F.coalesce(*[F.when(F.col("country_key") == c, s) for c, s in fixed.items()], F.lit(None).cast("string"))
    by_region = F.when(_listed(test), "test").when(_listed(val), "val").when(_listed(train), "train")
    deferred = stateless & F.col("country_key").isin(loose)
    out = df.withColumn("_wait", F.coalesce(deferred, F.lit(False))).withColumn("split", F.when(F.col("_wait"), None).when(stateless & by_country.isNotNull(), by_country).otherwise(by_region))
    n = F.broadcast(out.agg(F.count_if(F.col("_wait")).alias("_n"), *[F.count_if(F.col("split") == s).alias(f"_{s}") for s in sides]))  # one row
    total = F.col("_train") + F.col("_val") + F.col("_test")
    share = lambda s: F.when((F.col(f"_{s}") > 0) & (total > 0), F.greatest(F.lit(1), F.bround(F.col("_n") * F.col(f"_{s}") / total).cast("int"))).otherwise(0)
    dealt = ordered_rank(out.where("_wait").select(order), [], [order], "_k")
    joined = out.join(dealt, order, "left").crossJoin(n)
    return joined.withColumn("split", F.when(F.col("_wait"), _placed(F.col("_k"), share("test"), share("val"))).otherwise(F.col("split"))).drop("_wait", "_k", "_n", "_train", "_val", "_test")


def pool_split(df: DataFrame, regions: Sequence[str], val: float, test: float, key: str = "candidate_id", seed: int = 42) -> DataFrame:
    """Only rows of the training regions, split at random: max(1, int(n * share)) each for test and val.

    Rows are ranked in hash buckets with the counts of lower buckets added, so no task holds the whole pool.
    """
    pool = df.where(_listed(regions))
    ranked = hash_rank(pool, uniform(key, seed=seed), key)
    n = F.broadcast(pool.agg(F.count(F.lit(1)).alias("_n")))
    size = lambda share: F.greatest(F.lit(1), F.floor(F.col("_n") * share).cast("int"))
    return ranked.crossJoin(n).withColumn("split", _placed(F.col("_rank"), size(test), size(val))).drop("_rank", "_n")


def hash_rank(df: DataFrame, u: Column, key: str, buckets: int = 4096, strata: str | None = None) -> DataFrame:
    """Adds _rank, from 1, in the order of u (0 to 1) and key, by ranks within buckets of u plus the rows of the buckets before.

    With strata, ranks are taken in each of its values, and _size is the value's rows.
    """
    keys = [strata] if strata else []
    placed = df.withColumn("_u", u).withColumn("_b", F.floor(F.col("_u") * buckets))
    every = Window.partitionBy(*keys)
    before = every.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"))  # at most `buckets` rows for each value
    sums = sums.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    sums = sums.withColumn("_size", F.sum("_c").over(every)) if strata else F.broadcast(sums)
    rank = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_u", key)) + F.col("_before")
    return placed.join(sums.drop("_c"), [*keys, "_b"]).withColumn("_rank", rank).drop("_u", "_b", "_before")


def assign_splits(
    df: DataFrame, val: float, test: float, generalization: Sequence[str] = (), training: Sequence[str] = (), dmv_to_train: bool = True,
    inspected_as_test: bool = True, balanced: bool = True, key: str = "candidate_id", seed: int = 42,
) -> DataFrame:
    """All splits of candidates (candidate_id, label, eval_set, label_source, viz_status, country), in this priority:
    generalization (labelled rows of its countries), eval, unlabeled (also labelled rows outside a given training list), inspected, then val, test and train.
    Rows of a DMV source keep their places in the ranks but end in train."""
    iso, labelled = iso_prefix(key), F.coalesce(F.col("label"), F.lit(-1)) != -1
    gen = iso.isin([x.upper() for x in generalization]) & labelled
    held = F.coalesce(F.col("eval_set").cast("int"), F.lit(0)) == 1
    allowed = iso.isin([x.upper() for x in (*training, *generalization)]) if training else F.lit(True)
    pool = labelled & ~held & ~gen & allowed
    seen = pool & F.coalesce(F.col("viz_status") == "inspected", F.lit(False)) & F.lit(inspected_as_test)
    dmv = pool & F.lower(F.coalesce(F.col("label_source"), F.lit(""))).contains("dmv") & F.lit(dmv_to_train)
    marked = df.withColumns({"_gen": gen, "_eval": held, "_pool": pool, "_seen": seen, "_dmv": dmv})
    rest = marked.where("_pool and not _seen").select(key, "label", "country")
    dealt = country_balanced_split(rest, val, test, key=key, seed=seed) if balanced else stratified_split(rest, val, test, key=key, seed=seed, at_least=0 if inspected_as_test else 1)
    split = (
        F.when(F.col("_gen"), "generalization").when(F.col("_eval"), "eval").when(~F.col("_pool"), "unlabeled").when(F.col("_dmv"), "train")
        .when(F.col("_seen"), "inspected").otherwise(F.coalesce(F.col("split"), F.lit("unassigned")))
    )
    return marked.join(dealt.select(key, "split"), key, "left").select(key, split.alias("split"))
