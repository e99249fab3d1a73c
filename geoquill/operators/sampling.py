"""Samples of candidates: caps, balanced and weighted draws, generated negatives. Random numbers are hashes of ids and seeds."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoquill.functions.labels import valid_coords
from geoquill.operators.lookups import cap_per_group, keep_first, uniform
from geoquill.operators.ranks import in_parts, ordered_rank
from geoquill.operators.spatial import M, dedup_proximity, drop_near_existing, far_from
from geoquill.operators.splits import hash_rank
from geoquill.sources.tables import kept, steps, write_table


def sample_cap(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows in hash order; all where there are fewer."""
    return hash_rank(df, uniform(key, seed=seed), key).where(F.col("_rank") <= n).drop("_rank")


def downsample_negatives(df: DataFrame, ratio: float, key: str, seed: int = 42) -> DataFrame:
    """All positives, and negatives in hash order up to ratio times as many."""
    n_pos = F.broadcast(df.agg((F.floor(F.count_if(F.col("label") == 1) * ratio)).alias("_most")))
    negatives = hash_rank(df.where("label = 0"), uniform(key, seed=seed), key).crossJoin(n_pos).where(F.col("_rank") <= F.col("_most")).drop("_rank", "_most")
    return df.where("label = 1").unionByName(negatives)


def gallery_sample(df: DataFrame, group: Column, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows of each group in hash order."""
    return cap_per_group(df.withColumn("group", group), ["group"], n, uniform(key, seed=seed), key)


def top_k_errors(df: DataFrame, n: int, key: str = "candidate_id") -> DataFrame:
    """The n false positives of highest score and the n false negatives of lowest score."""
    from geoquill.operators.metrics import outcome_class

    kinds = df.withColumn("outcome", outcome_class())
    fp = kinds.where("outcome = 'FP'").orderBy(F.desc("predicted_score"), key).limit(n)
    return fp.unionByName(kinds.where("outcome = 'FN'").orderBy("predicted_score", key).limit(n))


def weighted_sample(df: DataFrame, n: int, weight: str, key: str, seed: int = 42) -> DataFrame:
    """n draws with replacement in proportion to the weight, which isn't negative: the row drawn and the draw's number, from 0.

    Draw k is the hash of k, a share of all weight. Rows lie on a line of weight in order of a hash and the key, each from its start to the next one's. Starts and draws are sorted together by place, in range partitions: a draw takes the last start
    before it, which may lie in an earlier part, so the work is a merge and no draw is compared with more than one row. Rows of null weight are never drawn; without any weight there are no draws.
    """
    spark = df.sparkSession
    money = "decimal(38, 6)"
    line = in_parts(df.where(F.col(weight) > 0).select(F.col(key).alias("_k"), uniform(key, seed=seed).alias("_u"), F.col(weight).cast(money).alias("_w")), "_u", "_k")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    sums = line.groupBy("_part").agg(F.sum("_w").cast(money).alias("_s")).withColumn("_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).cast(money))
    ends = F.sum("_w").over(Window.partitionBy("_part").orderBy("_u", "_k").rowsBetween(Window.unboundedPreceding, 0))
    placed = line.withColumn("_to", ends).join(F.broadcast(sums), "_part").withColumn("_to", (F.col("_to") + F.col("_b")).cast(money))
    starts = placed.select((F.col("_to") - F.col("_w")).cast(money).alias("_x"), F.lit(-1).cast("long").alias("draw"), F.struct(F.col("_k").alias("k"), F.col("_to").alias("to")).alias("_row"))
    total = F.broadcast(sums.agg(F.sum("_s").cast("double").alias("_total")))
    draws = spark.range(n).select(F.col("id").alias("draw"), uniform(F.col("id"), F.lit("draw"), seed=seed).alias("_share")).crossJoin(total)
    draws = draws.where("_total is not null").select((F.col("_share") * F.col("_total")).cast(money).alias("_x"), "draw", F.lit(None).cast(starts.schema["_row"].dataType).alias("_row"))
    both = in_parts(starts.union(draws), "_x", "draw")
    last = both.where("_row is not null").groupBy("_part").agg(F.max_by("_row", "_x").alias("_row"))
    parts = both.select("_part").distinct().join(last, "_part", "left").withColumn("_carried", F.last("_row", True).over(before)).select("_part", "_carried")
    upto = Window.partitionBy("_part").orderBy("_x", "draw").rowsBetween(Window.unboundedPreceding, 0)
    drawn = both.withColumn("_row", F.last("_row", True).over(upto)).where("draw >= 0").join(F.broadcast(parts), "_part")
    hit = drawn.select("draw", "_x", F.coalesce("_row", "_carried").alias("_row")).where(F.col("_x") < F.col("_row.to")).select("draw", F.col("_row.k").alias(key))
    return df.join(hit, key).select(*df.columns, "draw")


def negative_rows(df: DataFrame, prefix: str, source: str) -> DataFrame:
    """Candidate schema of generated points with country_key, country and n."""
    return df.select(F.concat_ws("_", F.lit(prefix), "country_key", F.col("n").cast("string")).alias("id"), "lat", "lng", F.lit(0).alias("label"), F.lit(source).alias("source"), "country", F.lit("").alias("state"), F.col("country_key").alias("region"))


def random_rural_negatives(boxes: DataFrame, positives: DataFrame, per_country: int, least: float, seed: int = 42, batch: int = 4, tried: list[int] | None = None) -> DataFrame:
    """Uniform points of each box, at least `least` metres from its country's positives: the first per_country of at most 20 times as many tries.

    Tries are made `batch` times per_country at once, and after that only for countries that are still short. tried: gets the number of tries.
    """
    most, done, found, short, total = 20 * per_country, 0, None, boxes, 0
    with steps(boxes.sparkSession) as made:
        while done < most:
            size = min(batch * per_country, most - done)
            tries = short.withColumn("k", F.explode(F.sequence(F.lit(done), F.lit(done + size - 1))))
            u = lambda axis: uniform(F.col("country_key"), F.col("k"), F.lit(axis), seed=seed)
            spots = tries.select("country_key", "country", "k", (F.col("min_lon") + (F.col("max_lon") - F.col("min_lon")) * u("x")).alias("lng"), (F.col("min_lat") + (F.col("max_lat") - F.col("min_lat")) * u("y")).alias("lat"))
            far = write_table(far_from(spots, positives, least), "far")
            found, done = far if found is None else found.union(far), done + size
            if tried is not None:
                total += size * short.count()
            short = boxes.join(found.groupBy("country_key").count().where(F.col("count") >= per_country), "country_key", "left_anti")
            if done < most and short.isEmpty():
                break
        if tried is not None:
            tried.append(total)
        if found is None:
            found = boxes.limit(0).select("country_key", "country", F.lit(0).alias("k"), F.lit(0.0).alias("lng"), F.lit(0.0).alias("lat"))
        kept_ = found.withColumn("n", F.row_number().over(Window.partitionBy("country_key").orderBy("k")) - 1).where(F.col("n") < per_country)  # at most 20 * per_country rows
        return kept(made, negative_rows(kept_, "neg", "random_rural"), "rural")


def hard_negatives(boxes: DataFrame, positives: DataFrame, per_country: int, least: float, seed: int = 42) -> DataFrame:
    """Positives drawn with replacement and moved by `least` to three times as many metres in any direction; points outside the box go."""
    named = positives.where("lat is not null and lng is not null").select("country", "ord", "lat", "lng")
    numbered = ordered_rank(named, ["country"], ["ord"], "i").withColumn("i", (F.col("i") - 1).cast("int"))
    sizes = numbered.groupBy("country").agg(F.count(F.lit(1)).alias("size"))
    draws = boxes.join(sizes, "country").withColumn("n", F.explode(F.sequence(F.lit(0), F.least(F.lit(per_country), F.col("size")).cast("int") - 1)))
    u = lambda axis: uniform(F.col("country_key"), F.col("n"), F.lit(axis), seed=seed)
    draws = draws.withColumn("i", F.floor(u("pick") * F.col("size")).cast("int")).withColumns({"bearing": 2 * F.pi() * u("bearing"), "far": least * (1 + 2 * u("far"))})
    moved = draws.join(numbered, ["country", "i"]).withColumns({
        "new_lat": F.col("lat") + F.col("far") * F.cos("bearing") / M, "new_lng": F.col("lng") + F.col("far") * F.sin("bearing") / (M * F.cos(F.radians("lat"))),
    })
    inside = F.col("new_lat").between(F.col("min_lat"), F.col("max_lat")) & F.col("new_lng").between(F.col("min_lon"), F.col("max_lon"))
    return negative_rows(moved.where(inside).select("country_key", "country", "n", F.col("new_lat").alias("lat"), F.col("new_lng").alias("lng")), "hn", "hard_negative")


def stratified_negatives(boxes: DataFrame, positives: DataFrame, per_country: int, least: float, seed: int = 42) -> DataFrame:
    """Half rural, half hard."""
    half = max(1, per_country // 2)
    return random_rural_negatives(boxes, positives, half, least, seed).unionByName(hard_negatives(boxes, positives, half, least, seed))


def osm_building_negatives(tagged: DataFrame, positives: DataFrame, kinds: Sequence[str], least: float, most: int, seed: int = 42) -> DataFrame:
    """Buildings of the listed kinds that aren't farms, first seen by id, far from every positive, at most `most` in hash order; ids `osm_<id>`."""
    from geoquill.functions.labels import match_tag

    rows = tagged.where(F.col("building").isin(list(kinds)) & ~F.coalesce(match_tag(F.concat(F.lit("building="), "building"))["group"] == "farm", F.lit(False)))
    rows = keep_first(rows, ["osm_id"], F.col("lat"), F.col("lng"))
    far = far_from(rows, positives, least, ())
    return sample_cap(far, most, "osm_id", seed).select(F.concat(F.lit("osm_"), F.col("osm_id").cast("string")).alias("id"), "lat", "lng", F.lit(0).alias("label"), F.lit("osm_building").alias("source"), F.col("building").alias("category"))


# Negatives by the name of their strategy: (boxes, positives, n for each country, least metres, seed) -> candidate rows.
NEGATIVE_STRATEGIES: dict[str, Callable[..., DataFrame]] = {
    "random_rural": random_rural_negatives, "hard_negative": hard_negatives, "stratified": stratified_negatives,
}


def generate_negatives(
    strategy: str, boxes: DataFrame, positives: DataFrame, per_country: int, least: float, seed: int = 42, tagged: DataFrame | None = None, kinds: Sequence[str] = (), footprints: DataFrame | None = None, ratio: float = 1.0,
) -> DataFrame:
    """Negatives of any strategy as id, lat, lng, label, source, country, state, region. osm_buildings takes `tagged` buildings of the `kinds`; building_footprints takes
    labelled `footprints` (building_id, label, region), keeps their positives too, and ratio times as many negatives; without footprints it falls back to random_rural."""
    columns = ("id", "lat", "lng", "label", "source", "country", "state", "region")
    if strategy == "osm_buildings":
        rows = osm_building_negatives(tagged, positives, kinds, least, per_country * boxes.count(), seed)
        return rows.withColumns({c: F.lit("") for c in ("country", "state", "region")}).select(*columns)
    if strategy == "building_footprints":
        if footprints is None or footprints.isEmpty():
            return NEGATIVE_STRATEGIES["random_rural"](boxes, positives, per_country, least, seed)
        kept = downsample_negatives(footprints, ratio, "building_id", seed)
        return kept.select(F.concat(F.lit("bf_"), "building_id").alias("id"), "lat", "lng", "label", F.lit("building_footprint").alias("source"), "country", F.lit("").alias("state"), F.coalesce("region", F.lit("")).alias("region"))
    if strategy not in NEGATIVE_STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known: {sorted(NEGATIVE_STRATEGIES)}, osm_buildings, building_footprints")
    return NEGATIVE_STRATEGIES[strategy](boxes, positives, per_country, least, seed).select(*columns)


def build_candidates(
    farms: DataFrame, boxes: DataFrame, strategy: str, per_country: int, least: float, extra: Sequence[DataFrame] = (), dedup_m: float = 100.0, existing_m: float = 200.0, seed: int = 42, **more,
) -> DataFrame:
    """Candidates end to end: positives without near doubles, negatives of the strategy, and extra sources (same columns) that aren't near anything before them."""
    positives = dedup_proximity(farms.where(valid_coords()), dedup_m)
    rows = positives.select("id", "lat", "lng", F.lit(1).alias("label"), "source", "country", "state", F.lower("country").alias("region"))
    negatives = generate_negatives(strategy, boxes, positives, per_country, least, seed, **more)
    if strategy == "building_footprints":  # footprints near farms stand for the farms themselves
        rows = rows.limit(0)
    out = rows.unionByName(negatives)
    for source in extra:
        out = out.unionByName(drop_near_existing(source.select(*out.columns), out, existing_m))
    return out
