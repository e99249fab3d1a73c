"""Sinks: candidates, splits, scores, registries, exports, metrics and map layers. Each writes a DataFrame; nothing passes through the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXPORT = ("id", "name", "lat", "lng", "species", "category", "source", "country", "state")


def write_candidates(df: DataFrame, path: str) -> None:
    """Partitions by country key; countries without rows make none."""
    df.where(F.col("country_key").isNotNull()).write.mode("overwrite").partitionBy("country_key").parquet(path)


def write_splits(df: DataFrame, path: str) -> None:
    df.select("candidate_id", "split").write.mode("overwrite").parquet(path)


def write_scored(df: DataFrame, path: str, date: str) -> None:
    """A dated copy and the canonical one."""
    df.write.mode("overwrite").parquet(f"{path}/dt={date}")
    df.sparkSession.read.parquet(f"{path}/dt={date}").write.mode("overwrite").parquet(f"{path}/current")


def write_merged_clusters(df: DataFrame, path: str, date: str) -> None:
    write_scored(df, path, date)


def append_registry(df: DataFrame, path: str) -> None:
    """Registry rows, partitioned by imagery hash so that reads of one configuration skip the others."""
    df.write.mode("append").partitionBy("imagery_config_hash").parquet(path)


def append_failures(df: DataFrame, path: str) -> None:
    df.select("candidate_id", F.substring("error", 1, 200).alias("error")).write.mode("append").parquet(path)


def clear_failures(df: DataFrame, path: str) -> None:
    """Starts the failure table anew, empty, when failed ids are to be tried again."""
    df.select("candidate_id", "error").limit(0).write.mode("overwrite").parquet(path)


def geojson_feature(properties: Sequence[str], lat: str = "lat", lng: str = "lng") -> Column:
    """A point feature as JSON."""
    return F.to_json(F.struct(
        F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(lng, lat).alias("coordinates")).alias("geometry"), F.struct(*properties).alias("properties"),
    ))


def export_results(df: DataFrame, path: str, properties: Sequence[str]) -> None:
    """One GeoJSON feature a line, and CSV."""
    df.select(geojson_feature(properties).alias("value")).write.mode("overwrite").text(f"{path}/geojson")
    df.select(*properties, "lat", "lng").write.mode("overwrite").csv(f"{path}/csv", header=True)


def write_all_farms(parts: Sequence[DataFrame], path: str) -> None:
    """Union of every source with nine columns."""
    out = parts[0].select(*EXPORT)
    for p in parts[1:]:
        out = out.unionByName(p.select(*EXPORT))
    out.write.mode("overwrite").csv(path, header=True)


def write_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def map_layers(df: DataFrame, layer: Column, colours: dict[str, str], properties: Sequence[str]) -> DataFrame:
    """The data under a map: each feature's layer, colour and JSON."""
    colour = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in colours.items() for x in kv]), F.col("layer")), F.lit("#999999"))
    return df.withColumn("layer", layer).select("layer", colour.alias("colour"), geojson_feature(properties).alias("feature"))


def layer_counts(layers: DataFrame) -> DataFrame:
    return layers.groupBy("layer", "colour").agg(F.count(F.lit(1)).alias("n"))
