"""Queries that run several operators end to end: merged farms, converted clusters, footprints, map elements, exports and streams."""

from __future__ import annotations

import struct
import uuid

import pandas as pd
from pyspark.sql import functions as F

from geoquill.functions import labels as L
from geoquill.operators import sampling as N
from geoquill.operators import spatial as S
from geoquill.operators.metrics import outcome_class
from geoquill.plans.metrics import OUTCOME
from geoquill.plans.registry import query
from geoquill.plans.space import CASCADE, TAGGED, greedy
from geoquill.plans.splits import HARD, RURAL
from geoquill.sources import readers, sinks
from geoquill.sources.tables import shared_dir


@query("s01_farm_source", "SELECT id, name, lat, lng, species, category, 'FarmTransparency' AS source, 'X' AS country, coalesce(state, '') AS state FROM fx_farms WHERE lat IS NOT NULL AND lng IS NOT NULL AND lat <> 0 AND lng <> 0 AND species IN ('Chickens', 'Ducks', 'Cows/Cattle') AND lower(coalesce(category, '')) LIKE '%farm%'")
def _(t):
    rows = t("fx_farms").select(F.col("id").alias("Id"), F.col("name").alias("Name"), F.col("lat").alias("Lat"), F.col("lng").alias("Lng"), F.col("species").alias("Species"), F.col("category").alias("Categories"), F.col("state").alias("State"))
    return readers.farms(rows, "FarmTransparency", "X", ["Chickens", "Ducks", "Cows/Cattle"], ["Farm"])


@query("s03_known_farms", f"WITH RECURSIVE v AS (SELECT * FROM fx_farms WHERE lat IS NOT NULL AND lng IS NOT NULL AND lat <> 0 AND lng <> 0), {greedy('v', 20000e0)} SELECT id, source, country FROM v SEMI JOIN kept USING (ord)")
def _(t):
    farms = t("fx_farms")
    return readers.known_farms([farms.where("source = 'OSM'"), farms.where("source <> 'OSM'")], 20000.0).select("id", "source", "country")


ELEMENT = "osm_id, lat, lng, name, building"


def _documents(items, key: str) -> str:
    """A folder of JSON documents whose arrays hold the items (texts), one document a partition, with a line for each item."""
    path, n = _folder(items.sparkSession, key), 4
    dealt = items.select((F.pmod(F.xxhash64("item"), F.lit(n))).alias("k"), F.lit(1).alias("o"), F.concat("item", F.lit(",")).alias("line"))
    ends = items.sparkSession.range(n).select(F.col("id").alias("k"), F.explode(F.array(F.struct(F.lit(0).alias("o"), F.lit(f'{{"about": "a \\"}}[{{", "{key}": [').alias("line")), F.struct(F.lit(2).alias("o"), F.lit("null]}").alias("line")))).alias("e"))
    lines = dealt.union(ends.select("k", "e.o", "e.line"))
    lines.repartitionByRange(n, "k").sortWithinPartitions("k", "o").select("line").write.text(path)
    return path


@query("s09_osm_elements", "SELECT 'way/' || osm_id AS osm_id, lat, lng, coalesce(name, '') AS name, building FROM fx_osm_tags WHERE osm_id % 7 <> 0 UNION ALL SELECT 'node/' || osm_id, lat, lng, coalesce(name, ''), building FROM fx_osm_tags WHERE osm_id % 7 = 0 AND osm_id % 2 = 0")
def _(t):
    tags = F.map_filter(F.create_map(F.lit("name"), F.col("name"), F.lit("building"), F.col("building")), lambda k, v: v.isNotNull())
    node = F.col("osm_id") % 7 == 0
    here = ~node | (F.col("osm_id") % 2 == 0)
    element = F.struct(
        F.when(node, "node").otherwise("way").alias("type"), F.col("osm_id").alias("id"), F.when(node & here, F.col("lat")).alias("lat"), F.when(node & here, F.col("lng")).alias("lon"),
        F.when(~node, F.struct(F.col("lat").alias("lat"), F.col("lng").alias("lon"))).alias("center"), tags.alias("tags"),
    )
    rows = t("fx_osm_tags")
    path = _documents(rows.select(F.explode(F.array(F.to_json(element), F.to_json(element))).alias("item")), "elements")
    return readers.read_osm_elements(rows.sparkSession, path).select("osm_id", "lat", "lng", "name", F.try_element_at("tags", F.lit("building")).alias("building"))


@query("s15_features", "SELECT provider AS source, area_m2, lat, lng FROM fx_buildings")
def _(t):
    props = F.struct(F.col("provider").alias("source"), "area_m2", F.col("lng").alias("centroid_lon"), F.col("lat").alias("centroid_lat"))
    geometry = F.when(F.col("ord") % 3 != 0, F.struct(F.lit("Point").alias("type"), F.array("lng", "lat").alias("coordinates")))
    rows = t("fx_buildings")
    path = _documents(rows.select(F.to_json(F.struct(geometry.alias("geometry"), props.alias("properties"))).alias("item")), "features")
    return readers.read_features(rows.sparkSession, path).select("source", "area_m2", "lat", "lng")


def _box(lng: pd.Series, lat: pd.Series) -> pd.Series:
    corners = lambda x, y: [(x, y), (x + 0.002, y), (x + 0.002, y + 0.001), (x, y + 0.001), (x, y)]
    return pd.Series([struct.pack("<BIII10d", 1, 3, 1, 5, *[v for p in corners(x, y) for v in p]) for x, y in zip(lng, lat, strict=True)])


@query("s12_wkb_centroid", "SELECT building_id, round(lng + 0.001e0, 6) AS lng, round(lat + 0.0005e0, 6) AS lat FROM fx_buildings")
def _(t):
    box = F.pandas_udf(_box, "binary")
    d = t("fx_buildings").select("building_id", box("lng", "lat").alias("geometry")).withColumn("c", readers.wkb_centroid("geometry"))
    return d.select("building_id", F.round("c.lng", 6).alias("lng"), F.round("c.lat", 6).alias("lat"))


@query("j16_tile_filter", "SELECT DISTINCT b.building_id FROM fx_buildings b JOIN fx_country c ON b.lng BETWEEN c.min_lon AND c.max_lon AND b.lat BETWEEN c.min_lat AND c.max_lat")
def _(t):
    return S.tile_filter(t("fx_buildings"), t("fx_country"), "building_id", bound=2).select("building_id")


@query("u07_find_farms", "SELECT osm_id, species FROM (SELECT osm_id, CASE WHEN contains(x, 'chicken') OR contains(x, 'poultry') OR contains(x, 'broiler') OR contains(x, 'layer') OR contains(x, 'egg') OR contains(x, 'hen') OR contains(x, 'hatchery') THEN 'Chickens' END AS species FROM (SELECT osm_id, lower(concat_ws(' ', coalesce(name, ''), building, landuse)) AS x FROM fx_osm_tags)) WHERE species IS NOT NULL")
def _(t):
    kind = L.classify_species(F.col("name"), F.array_compact(F.array("building", "landuse")))["species"]
    return t("fx_osm_tags").select("osm_id", kind.alias("species")).where(L.species_in("species", ["Chickens"]))


@query("u08_convert_clusters", """
SELECT cluster_id AS id, country_key, CASE WHEN final_label = 'NotFarm' THEN 0 WHEN final_label LIKE 'Farm: Poultry%' THEN 1 ELSE 2 END AS label, final_label AS category, coalesce(viz_status, '') AS viz_status, coalesce(CAST(eval_set AS INT), 0) AS eval_set,
       (SELECT arg_min(b.country_key, b.ord) FROM fx_country b WHERE c.lng BETWEEN b.min_lon AND b.max_lon AND c.lat BETWEEN b.min_lat AND b.max_lat) AS state
FROM fx_clusters c WHERE final_label IN ('NotFarm', 'Farm: Poultry: Meat Chickens', 'Farm: Poultry: Eggs', 'Farm: Poultry: Unspecified/Other', 'Farm: Pigs', 'Farm: Cattle')
AND NOT (coalesce(original_label, '') ILIKE '%osm%' AND (coalesce(standardized_label LIKE 'Farm%', FALSE) OR standardized_label IS NULL AND regexp_matches(lower(original_label), 'sty|chicken|poultry|cowshed|livestock|animal_breeding|pig|farm')))""")
def _(t):
    kept = t("fx_clusters").where(L.not_ambiguous("final_label") & L.not_excluded("final_label", L.AMBIGUOUS_TYPES) & ~L.is_osm_farm() & F.col("final_label").isNotNull())
    done = L.fill_defaults(kept, ["viz_status"], ["eval_set"]).withColumn("label", L.label_three_class("final_label"))
    boxes = t("fx_country").withColumnRenamed("country_key", "state")
    return S.bbox_lookup(done, boxes, "state", "ord", "cluster_id").select(F.col("cluster_id").alias("id"), "country_key", "label", F.col("final_label").alias("category"), "viz_status", "eval_set", "state")


@query("u07_species_counts", "WITH o AS (SELECT osm_id, lat, lng, lower(concat_ws(' ', coalesce(name, ''), building, landuse)) AS x FROM fx_osm_tags) SELECT CASE WHEN contains(x, 'chicken') OR contains(x, 'poultry') OR contains(x, 'broiler') OR contains(x, 'layer') OR contains(x, 'egg') OR contains(x, 'hen') OR contains(x, 'hatchery') THEN 'Chickens' END AS species, count(*) AS n FROM o GROUP BY 1 HAVING species IS NOT NULL")
def _(t):
    kind = L.classify_species(F.col("name"), F.array_compact(F.array("building", "landuse")))["species"]
    found = t("fx_osm_tags").select("osm_id", kind.alias("species")).where(L.species_in("species", ["Chickens"]))
    return found.groupBy("species").agg(F.count(F.lit(1)).alias("n"))


@query("u06_building_candidates", f"""{CASCADE}, {TAGGED}, w AS (SELECT l.building_id, lat, lng, CASE WHEN split_part(gl, '/', 1) = 'farm' THEN 1 ELSE label END AS label, coalesce(split_part(gl, '/', 2), unified_label) AS category FROM l LEFT JOIN nt USING (building_id))
SELECT 'bf_' || building_id AS id, w.label, category, (SELECT arg_min(c.country_key, c.ord) FROM fx_country c WHERE w.lng BETWEEN c.min_lon AND c.max_lon AND w.lat BETWEEN c.min_lat AND c.max_lat) AS region
FROM w JOIN fx_buildings b USING (building_id) WHERE area_m2 BETWEEN 500 AND 40000 AND confidence >= 0.3""")
def _(t):
    # The radius of a match depends on the mean latitude of the references alone, so footprints can be filtered first.
    chosen = readers.query_buildings(t("fx_buildings").drop("country_key"), (-180, -90, 180, 90), 500, 40000, 0.3)
    labelled = S.enrich_with_tags(S.label_buildings(chosen, t("fx_farms"), 3000), t("fx_osm_tags"), 2000)
    placed = S.bbox_lookup(labelled, t("fx_country"), "country_key", "ord", "building_id")
    return placed.select(F.concat(F.lit("bf_"), "building_id").alias("id"), "label", F.col("unified_label").alias("category"), F.col("country_key").alias("region"))


@query("u05_build_candidates", f"""WITH RECURSIVE v AS (SELECT * FROM fx_farms WHERE lat IS NOT NULL AND lng IS NOT NULL AND lat <> 0 AND lng <> 0), {greedy('v', 100e0)}, pos AS (SELECT * FROM v SEMI JOIN kept USING (ord)),
{RURAL.format(n=10).replace('fx_farms', 'pos')}, {HARD.format(n=10).replace('fx_farms', 'pos')},
r AS (SELECT id, lat, lng, 1 AS label FROM pos UNION ALL SELECT id, lat, lng, 0 FROM rr UNION ALL SELECT id, lat, lng, 0 FROM hr),
x AS (SELECT cluster_id AS id, lat, lng, CASE WHEN final_label = 'NotFarm' THEN 0 ELSE 1 END AS label FROM fx_clusters WHERE final_label IS NOT NULL)
SELECT id, label FROM r UNION ALL SELECT id, label FROM x WHERE NOT EXISTS (SELECT 1 FROM r WHERE sqrt((radians(r.lat) - radians(x.lat)) ** 2 + (radians(r.lng) - radians(x.lng)) ** 2) * 6371000 <= 200)""")
def _(t):
    extra = t("fx_clusters").where("final_label is not null").select(F.col("cluster_id").alias("id"), "lat", "lng", L.label_binary("final_label").alias("label"), F.lit("clusters").alias("source"), "country", F.lit("").alias("state"), F.col("country_key").alias("region"))
    return N.build_candidates(t("fx_farms"), t("fx_country"), "stratified", 20, 5000.0, [extra]).select("id", "label")


@query("k10_map_layers", f"SELECT o AS layer, CASE o WHEN 'TP' THEN '#2ca02c' WHEN 'FP' THEN '#d62728' WHEN 'FN' THEN '#ff7f0e' WHEN 'TN' THEN '#1f77b4' ELSE '#999999' END AS colour, count(*) AS n FROM (SELECT {OUTCOME} AS o FROM fx_scored) GROUP BY o")
def _(t):
    colours = {"TP": "#2ca02c", "FP": "#d62728", "FN": "#ff7f0e", "TN": "#1f77b4"}
    return sinks.layer_counts(sinks.map_layers(t("fx_scored"), outcome_class(), colours, ["candidate_id", "predicted_score"]))


def _folder(spark, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/geoquill-{uuid.uuid4().hex}/{name}"


@query("k01_write_read_candidates", "SELECT building_id, country_key FROM fx_buildings WHERE country_key IN ('nation_1', 'nation_2')")
def _(t):
    d = t("fx_buildings")
    path = _folder(d.sparkSession, "candidates")
    sinks.write_candidates(d, path)
    return readers.read_candidates(d.sparkSession, path, ["nation_1", "nation_2"]).select("building_id", "country_key")


@query("k03_write_read_scored", "SELECT candidate_id, predicted_score, split FROM fx_scored")
def _(t):
    d = t("fx_scored")
    path = _folder(d.sparkSession, "scored")
    sinks.write_scored(d, path, "2024-01-01")
    return d.sparkSession.read.parquet(f"{path}/current").select("candidate_id", "predicted_score", "split")


@query("k06_export_results", "SELECT building_id, area_m2, lat, lng FROM fx_buildings")
def _(t):
    d = t("fx_buildings")
    path = _folder(d.sparkSession, "export")
    sinks.export_results(d, path, ["building_id", "area_m2"])
    back = d.sparkSession.read.text(f"{path}/geojson").select(F.from_json("value", "geometry struct<coordinates:array<double>>, properties struct<building_id:string,area_m2:double>").alias("f"))
    return back.select("f.properties.*", F.get("f.geometry.coordinates", F.lit(1)).alias("lat"), F.get("f.geometry.coordinates", F.lit(0)).alias("lng"))


@query("ts1_resume_scoring", "SELECT CAST(user_id AS VARCHAR) AS candidate_id, user_id % 7 <> 3 AS seen, CASE WHEN user_id % 7 = 3 THEN 2 ELSE 1 END AS attempts FROM events WHERE user_id % 11 <> 5 GROUP BY ALL")
def _(t):
    """Three runs: half of the ids, all of them, nothing new. A seventh of them always fails and is tried twice; an eleventh was done before."""
    from geoquill.streaming.scoring import resume_scoring

    events = t("events").select(F.col("user_id").cast("string").alias("candidate_id"))
    spark = events.sparkSession
    base = _folder(spark, "stream")
    half, number = F.pmod(F.xxhash64("candidate_id"), F.lit(2)), F.col("candidate_id").cast("long")
    score = lambda d: d.select("candidate_id", F.when(F.col("candidate_id").cast("long") % 7 == 3, "no image").alias("error"))
    for k in range(3):
        if k < 2:
            events.where(half <= k).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema("candidate_id string").parquet(f"{base}/in")
        resume_scoring(stream, score, f"{base}/registry", f"{base}/failures", "h1", f"{base}/check", attempts=2, done=events.where(number % 11 == 5)).awaitTermination()
    good = spark.read.schema("candidate_id string").parquet(f"{base}/registry/*/").select("candidate_id", F.lit(True).alias("seen"))
    bad = spark.read.schema("candidate_id string").parquet(f"{base}/failures/*/").select("candidate_id", F.lit(False).alias("seen"))
    return good.unionByName(bad).groupBy("candidate_id", "seen").agg(F.count(F.lit(1)).alias("attempts"))
