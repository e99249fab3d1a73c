"""Sources: facility lists, candidates, clusters, footprints, map elements, features, patches and metrics."""

from __future__ import annotations

import io
import struct
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoquill.functions.labels import category_any_of, species_in, valid_coords
from geoquill.sources.documents import array_items
from geoquill.sources.tables import write_table

FARM_COLUMNS = ("id", "name", "lat", "lng", "species", "category", "source", "country", "state")
FARM_CSV = "Id string, Name string, Lat double, Lng double, Species string, Categories string, State string"
CANDIDATE = "id string, name string, lat double, lng double, label int, species string, category string, source string, country string, state string, region string"
ELEMENTS = "elements array<struct<type:string,id:long,lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>>>"
FEATURES = "features array<struct<geometry:struct<type:string,coordinates:array<double>>,properties:struct<source:string,area_m2:double,length_m:double,width_m:double,aspect_ratio:double,centroid_lon:double,centroid_lat:double>>>"


def farms(rows: DataFrame, source: str, country: str, species: Sequence[str] = (), categories: Sequence[str] = ()) -> DataFrame:
    """Rows of a facility list in the unified schema: valid coordinates, species and categories where given, source and country stamped."""
    out = rows.withColumnsRenamed({"Id": "id", "Name": "name", "Lat": "lat", "Lng": "lng", "Species": "species", "Categories": "category", "State": "state"})
    for name in ("category", "state"):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast("string"))
    out = out.where(valid_coords())
    if categories:
        out = out.where(category_any_of("category", categories))
    if species:
        out = out.where(species_in("species", species))
    return out.withColumns({"source": F.lit(source), "country": F.lit(country), "state": F.coalesce("state", F.lit(""))}).select(*FARM_COLUMNS)


def read_farm_source(spark: SparkSession, path: str, source: str, country: str, species: Sequence[str] = (), categories: Sequence[str] = ()) -> DataFrame:
    """A facility CSV with a header; columns are matched by name, State may be missing."""
    rows = spark.read.csv(path, header=True)
    kinds = dict(x.split(" ") for x in FARM_CSV.split(", "))
    return farms(rows.select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items() if c in rows.columns]), source, country, species, categories)


def known_farms(sources: Sequence[DataFrame], radius: float = 100.0) -> DataFrame:
    """The farms of all sources (with ord, their order) without doubles: of farms nearer than the radius the first stays."""
    from geoquill.operators.spatial import dedup_proximity

    rows = sources[0]
    for more in sources[1:]:
        rows = rows.unionByName(more)
    return dedup_proximity(rows.where(valid_coords()), radius)


def read_candidates(spark: SparkSession, path: str, countries: Sequence[str] = ()) -> DataFrame:
    """Candidates that write_candidates wrote; partitions of other countries aren't read."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    return df.where(F.col("country_key").isin(list(countries))) if countries else df


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """Cluster table with its label as final_label, which older files call modified_label."""
    df = spark.read.parquet(path)
    return df if "final_label" in df.columns else df.withColumnRenamed("modified_label", "final_label")


def query_buildings(buildings: DataFrame, bounds: tuple[float, float, float, float], least: float, most: float, confidence: float = 0.0, provider: str | None = None, prefix: str = "b") -> DataFrame:
    """Footprints in the bounds by area and confidence, with footprint_id `prefix_lng_lat` of six decimals."""
    x0, y0, x1, y1 = bounds
    out = buildings.where(F.col("lng").between(x0, x1) & F.col("lat").between(y0, y1) & F.col("area_m2").between(least, most) & (F.col("confidence") >= confidence))
    if provider:
        out = out.where(F.col("provider") == provider)
    return out.withColumn("footprint_id", F.format_string(f"{prefix}_%.6f_%.6f", "lng", "lat"))


def query_country_buildings(buildings: DataFrame, least: float, most: float, tile: float, cap: int) -> DataFrame:
    """The first `cap` footprints of each country, tile by tile in order of latitude and longitude, and by ord in a tile.

    Tiles are counted first, and summed up in order; only tiles that the cap reaches, at most `cap` a country, are read then, within their bounds, which reach the scan, and rows are numbered inside a tile alone.
    """
    from geoquill.operators.spatial import small

    fit = F.col("area_m2").between(least, most)
    at = [F.floor(F.col("lat") / tile).alias("_ty"), F.floor(F.col("lng") / tile).alias("_tx")]
    earlier = Window.partitionBy("country_key").orderBy("_ty", "_tx").rowsBetween(Window.unboundedPreceding, -1)  # a row a tile
    tiles = buildings.where(fit).groupBy("country_key", *at).agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    wanted = write_table(tiles.where(F.col("_before") < cap).drop("_n"), "tiles")
    low = wanted.agg(F.min("_ty"), F.max("_ty"), F.min("_tx"), F.max("_tx")).first()
    if low[0] is None:
        return buildings.limit(0)
    edge = lambda lo, hi: (float((lo - 1) * tile), float((hi + 2) * tile))  # noqa: E731  a tile to spare for rounding
    inside = fit & F.col("lat").between(*edge(low[0], low[1])) & F.col("lng").between(*edge(low[2], low[3]))
    rows = buildings.where(inside).select("*", *at).join(small(wanted), ["country_key", "_ty", "_tx"])
    order = Window.partitionBy("country_key", "_ty", "_tx").orderBy("ord")
    return rows.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= cap).where(F.col("_k") + F.col("_before") <= cap).select(*buildings.columns)


def choose_provider(countries: DataFrame, coverage: DataFrame, first: str, second: str) -> DataFrame:
    """Adds provider: the first where it covers the country, else the second."""
    covered = coverage.select("iso_code").distinct().withColumn("_c", F.lit(True))
    return countries.join(covered, "iso_code", "left").withColumn("provider", F.when(F.col("_c"), first).otherwise(second)).drop("_c")


def _google(buildings: DataFrame, coverage: DataFrame, confidence: float) -> DataFrame:
    return buildings.where((F.col("provider") == "google_open_buildings") & (F.col("confidence") >= confidence))


def _microsoft(buildings: DataFrame, coverage: DataFrame, confidence: float) -> DataFrame:
    return buildings.where(F.col("provider") == "ms_buildings")


def _auto(buildings: DataFrame, coverage: DataFrame, confidence: float) -> DataFrame:
    chosen = choose_provider(buildings.select("iso_code").distinct(), coverage, "google_open_buildings", "ms_buildings").withColumnRenamed("provider", "_chosen")
    kept = buildings.join(chosen, "iso_code").where((F.col("provider") == F.col("_chosen")) & ((F.col("_chosen") == "ms_buildings") | (F.col("confidence") >= confidence)))
    return kept.drop("_chosen")


#: Footprints by the name of their provider: (buildings with iso_code, provider and confidence; coverage with iso_code; least confidence) -> buildings.
FOOTPRINT_PROVIDERS: dict[str, Callable[[DataFrame, DataFrame, float], DataFrame]] = {"google_open_buildings": _google, "ms_buildings": _microsoft, "auto": _auto}


def footprints(name: str, buildings: DataFrame, coverage: DataFrame, confidence: float = 0.65) -> DataFrame:
    """Footprints of a provider; `auto` takes, country by country, the first provider where it covers the country and else the second."""
    if name not in FOOTPRINT_PROVIDERS:
        raise ValueError(f"unknown footprint provider {name!r}; known: {sorted(FOOTPRINT_PROVIDERS)}")
    return FOOTPRINT_PROVIDERS[name](buildings, coverage, confidence)


def _element(e: Column) -> tuple[Column, ...]:
    lat, lng = F.coalesce(e["lat"], e["center"]["lat"]), F.coalesce(e["lon"], e["center"]["lon"])
    return F.concat_ws("/", e["type"], e["id"].cast("string")).alias("osm_id"), lat.alias("lat"), lng.alias("lng"), F.coalesce(F.try_element_at(e["tags"], F.lit("name")), F.lit("")).alias("name"), e["tags"].alias("tags")


def _first_elements(rows: DataFrame, *order: str) -> DataFrame:
    """Elements (in e) with a position, the first of each id in the order: the least place is summed up in each task first."""
    out = rows.select(*order, *_element(F.col("e"))).where("lat is not null and lng is not null")
    return out.groupBy("osm_id").agg(F.min_by(F.struct("lat", "lng", "name", "tags"), F.struct(*order)).alias("f")).select("osm_id", "f.*")


def elements(rows: DataFrame, column: str = "value") -> DataFrame:
    """Map elements of JSON documents in a column: osm_id, lat, lng, name, tags. Elements without a position are skipped; the first of each id stays."""
    e = rows.select(F.monotonically_increasing_id().alias("_o"), F.from_json(column, ELEMENTS)["elements"].alias("e")).select("_o", F.posexplode("e").alias("_p", "e"))
    return _first_elements(e, "_o", "_p")


def read_osm_elements(spark: SparkSession, path: str) -> DataFrame:
    """Map elements of files, in order of path and place; a large file is read by several tasks."""
    items = array_items(spark, path, "elements")
    return _first_elements(items.select("path", "block", "n", F.from_json("value", _item(ELEMENTS)).alias("e")), "path", "block", "n")


def _item(array: str) -> str:
    """The item's type of `name array<type>`."""
    return array.split(" array<", 1)[1][:-1]


def _feature(f: Column) -> tuple[Column, ...]:
    xy, p = f["geometry"]["coordinates"], f["properties"]
    names = ("source", "area_m2", "length_m", "width_m", "aspect_ratio", "centroid_lon", "centroid_lat")
    return *[p[c].alias(c) for c in names], F.coalesce(F.get(xy, F.lit(0)), p["centroid_lon"]).alias("lng"), F.coalesce(F.get(xy, F.lit(1)), p["centroid_lat"]).alias("lat")


def features(rows: DataFrame, column: str = "value") -> DataFrame:
    """Detections of GeoJSON texts in a column, with lat and lng; centroid properties stand in for a missing geometry."""
    return rows.select(F.explode(F.from_json(column, FEATURES)["features"]).alias("f")).select(*_feature(F.col("f")))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Detections of GeoJSON files; a large file is read by several tasks."""
    return array_items(spark, path, "features").select(F.from_json("value", _item(FEATURES)).alias("f")).select(*_feature(F.col("f")))


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_patch_meta(spark: SparkSession, root: str, digest: str | None = None) -> DataFrame:
    """Registry of extracted patches: patch_meta.csv, or patch_meta.parquet where there is none; rows of one imagery configuration where a digest is given."""
    if exists(spark, f"{root}/patch_meta.csv"):
        meta = spark.read.csv(f"{root}/patch_meta.csv", header=True, inferSchema=True)
    elif exists(spark, f"{root}/patch_meta.parquet"):
        meta = spark.read.parquet(f"{root}/patch_meta.parquet")
    else:
        raise FileNotFoundError(f"no patch_meta.csv or patch_meta.parquet in {root}")
    meta = meta.withColumn("candidate_id", F.col("candidate_id").cast("string"))
    return meta.where(F.col("imagery_config_hash") == digest) if digest and "imagery_config_hash" in meta.columns else meta


def read_failed_ids(spark: SparkSession, root: str) -> DataFrame:
    """candidate_id of patches that failed; none where there is no failed_patches.csv."""
    if not exists(spark, f"{root}/failed_patches.csv"):
        return spark.createDataFrame([], "candidate_id string")
    return spark.read.csv(f"{root}/failed_patches.csv", header=True).select(F.col("candidate_id").cast("string").alias("candidate_id")).distinct()


def read_splits(spark: SparkSession, root: str, stem: str) -> DataFrame | None:
    """candidate_id, split of a configuration: splits/<stem>.csv, or the shared split_assignments.csv of older runs; None where there is neither."""
    for path in (f"{root}/splits/{stem}.csv", f"{root}/split_assignments.csv"):
        if exists(spark, path):
            return spark.read.csv(path, header=True).select(F.col("candidate_id").cast("string").alias("candidate_id"), "split")
    return None


def read_scored(spark: SparkSession, root: str, stem: str) -> DataFrame:
    """Scored candidates of a configuration, or those of older runs that lie at the root."""
    path = f"{root}/{stem}/current"
    return spark.read.parquet(path if exists(spark, path) else f"{root}/current")


def read_metrics_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def _ring(data: bytes, at: int, order: str, dims: int) -> tuple[np.ndarray, int]:
    n = struct.unpack_from(order + "I", data, at)[0]
    xy = np.frombuffer(data, order + "f8", n * dims, at + 4).reshape(n, dims)[:, :2]
    return xy, at + 4 + 8 * n * dims


def _polygon_moments(data: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """Signed area and first moments of a WKB polygon or multipolygon; holes take away."""
    order = "<" if data[at] else ">"
    kind = struct.unpack_from(order + "I", data, at + 1)[0]
    dims = 3 if kind & 0x80000000 or kind // 1000 in (1, 2) else 2
    kind, at = (kind & 0xFF) % 1000 if kind & 0xE0000000 else kind % 1000, at + 5
    n = struct.unpack_from(order + "I", data, at)[0]
    at, total = at + 4, np.zeros(3)
    for k in range(n):
        if kind == 6:
            part, at = _polygon_moments(data, at)
        else:
            xy, at = _ring(data, at, order, dims)
            x, y = (xy - xy[0]).T
            cross = x[:-1] * y[1:] - x[1:] * y[:-1]
            area = cross.sum() / 2
            part = np.array([area, ((x[:-1] + x[1:]) * cross).sum() / 6 + xy[0, 0] * area, ((y[:-1] + y[1:]) * cross).sum() / 6 + xy[0, 1] * area])
            part = part * (np.sign(area) or 1) * (1 if k == 0 else -1)
        total += part
    return total, at


def wkb_centroid(column: str) -> Column:
    """Area-weighted planar centroid (struct of lng, lat) of WKB polygons; null for null or empty ones."""

    @F.pandas_udf("lng double, lat double")
    def centroid(blobs: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if b is None else (m[1] / m[0], m[2] / m[0]) if (m := _polygon_moments(bytes(b))[0])[0] else (None, None) for b in blobs]
        return pd.DataFrame(rows, columns=["lng", "lat"], dtype="float64")

    return centroid(F.col(column))


def decode_patches(files: DataFrame) -> DataFrame:
    """candidate_id, n_channels, height, width, data of .npy contents (path, content) of (C, H, W); structured or (H, W, C) arrays are turned."""

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, content in zip(frame["path"], frame["content"], strict=True):
                a = normalise_layout(np.load(io.BytesIO(content), allow_pickle=False))
                rows.append((name.rsplit("/", 1)[-1].removesuffix(".npy"), *a.shape, a.astype(np.float32).ravel()))
            yield pd.DataFrame(rows, columns=["candidate_id", "n_channels", "height", "width", "data"])

    return files.select("path", "content").mapInPandas(decode, "candidate_id string, n_channels int, height int, width int, data array<float>")


def read_patches(spark: SparkSession, path: str) -> DataFrame:
    """Patches of a folder of .npy files."""
    return decode_patches(spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", "true").load(path))


def normalise_layout(a: np.ndarray) -> np.ndarray:
    """(C, H, W) of named bands, (H, W) or (H, W, C) where the last axis is the shortest."""
    if a.dtype.names:
        return np.stack([a[n] for n in a.dtype.names])
    if a.ndim == 2:
        return a[None]
    return np.moveaxis(a, -1, 0) if a.shape[2] < min(a.shape[:2]) else a
