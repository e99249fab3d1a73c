"""Test views derived from the driver's tables; each statement runs unchanged in Spark SQL and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")

FX = {
    # registry of bounding boxes, ordered by ord (first match wins)
    "fx_country": """
SELECT CAST(n_nationkey AS INT) AS ord, lower(n_name) AS country_key, n_name AS country,
       upper(substr(n_name, 1, 3)) || CAST(n_nationkey AS VARCHAR(10)) AS adm0,
       -60e0 + 5 * n_nationkey AS min_lon, -30e0 + 2 * n_nationkey AS min_lat,
       -54e0 + 5 * n_nationkey AS max_lon, -27e0 + 2 * n_nationkey AS max_lat
FROM nation
""",
    # state boxes inside one country, for lookups that take states before countries
    "fx_states": """
SELECT 'S' || CAST(k AS VARCHAR(4)) AS state, min_lon + k * 1e0 AS min_lon, min_lat AS min_lat, min_lon + (k + 1) * 1e0 AS max_lon, min_lat + 2e0 AS max_lat
FROM fx_country, (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 5) x WHERE ord = 1
""",
    # known farms (two sources; nullable / zero coordinates included)
    "fx_farms": """
SELECT CAST(s_suppkey AS BIGINT) AS ord, 'f' || CAST(s_suppkey AS VARCHAR(20)) AS id, s_name AS name,
       CASE WHEN s_suppkey % 41 = 40 THEN NULL WHEN s_suppkey % 37 = 36 THEN 0e0
            ELSE -30e0 + 2 * s_nationkey + (s_suppkey * 7919 % 2003) / 20030e0 END AS lat,
       -60e0 + 5 * s_nationkey + (s_suppkey * 104729 % 2011) / 20110e0 AS lng,
       CASE s_suppkey % 6 WHEN 0 THEN 'Chickens' WHEN 1 THEN 'Pigs (unconfirmed)' WHEN 2 THEN 'Cows/Cattle'
            WHEN 3 THEN 'Ducks' WHEN 4 THEN '' ELSE NULL END AS species,
       CASE s_suppkey % 8 WHEN 0 THEN 'Farm (meat)' WHEN 1 THEN 'Farm (eggs) (unconfirmed)'
            WHEN 2 THEN 'Farm (dairy), Hatchery' WHEN 3 THEN 'Slaughterhouse' WHEN 4 THEN 'building=barn'
            WHEN 5 THEN 'building=warehouse' WHEN 6 THEN 'Farm' ELSE NULL END AS category,
       CASE WHEN s_suppkey % 3 = 0 THEN 'OSM' ELSE 'FarmTransparency' END AS source,
       n_name AS country, CASE WHEN s_suppkey % 2 = 0 THEN 'S' || CAST(s_suppkey % 5 AS VARCHAR(4)) ELSE '' END AS state
FROM supplier JOIN nation ON s_nationkey = n_nationkey
""",
    # building footprints
    "fx_buildings": """
SELECT CAST(c_custkey AS BIGINT) AS ord, 'b' || CAST(c_custkey AS VARCHAR(20)) AS building_id,
       -30e0 + 2 * c_nationkey + (c_custkey * 7919 % 2003) / 20030e0 AS lat,
       -60e0 + 5 * c_nationkey + (c_custkey * 104729 % 2011) / 20110e0 AS lng,
       100e0 + c_custkey * 37 % 60000 AS area_m2, (c_custkey * 13 % 100) / 100e0 AS confidence,
       CASE WHEN c_custkey % 2 = 0 THEN 'google_open_buildings' ELSE 'ms_buildings' END AS provider,
       n_name AS country, lower(n_name) AS country_key
FROM customer JOIN nation ON c_nationkey = n_nationkey
""",
    # tagged buildings near the footprints (building / landuse tags)
    "fx_osm_tags": """
SELECT CAST(p_partkey AS BIGINT) AS osm_id,
       -30e0 + 2 * (p_partkey % 25) + (p_partkey * 7919 % 2003) / 20030e0 + 1e-4 AS lat,
       -60e0 + 5 * (p_partkey % 25) + (p_partkey * 104729 % 2011) / 20110e0 AS lng, p_name AS name,
       CASE p_size % 6 WHEN 0 THEN 'warehouse' WHEN 1 THEN 'barn' WHEN 2 THEN 'yes' WHEN 3 THEN 'chicken_coop'
            WHEN 4 THEN 'house' ELSE NULL END AS building,
       CASE WHEN p_size % 5 = 0 THEN 'farmyard' ELSE NULL END AS landuse
FROM part
""",
    # labelled building clusters (candidate parquet shape)
    "fx_clusters": """
SELECT CAST(o_orderkey AS BIGINT) AS ord, adm0,
       adm0 || '_cluster_' || CAST(o_orderkey AS VARCHAR(20)) AS cluster_id, country, country_key,
       min_lat + (o_orderkey * 7919 % 2003) / 20030e0 AS lat, min_lon + (o_orderkey * 104729 % 2011) / 20110e0 AS lng,
       CASE o_orderkey % 14 WHEN 0 THEN 'NotFarm' WHEN 1 THEN 'Farm: Poultry: Meat Chickens'
            WHEN 2 THEN 'Farm: Poultry: Eggs' WHEN 3 THEN 'Farm: Poultry: Unspecified/Other' WHEN 4 THEN 'Farm: Pigs'
            WHEN 5 THEN 'Farm: Cattle' WHEN 6 THEN 'Farm: Mixed' WHEN 7 THEN 'Farm: Unknown'
            WHEN 8 THEN 'Farm: PigsOrPoultry' WHEN 9 THEN 'Ambiguous' WHEN 10 THEN 'NotFarm' WHEN 11 THEN 'NotFarm'
            ELSE NULL END AS final_label,
       CASE o_orderkey % 9 WHEN 0 THEN 'OSM sty' WHEN 1 THEN 'osm warehouse' WHEN 2 THEN NULL ELSE 'manual' END AS original_label,
       CASE o_orderkey % 4 WHEN 0 THEN 'Farm: Pigs' WHEN 1 THEN NULL ELSE 'NotFarm' END AS standardized_label,
       CASE o_orderkey % 10 WHEN 0 THEN 'usa_dmv_2023' WHEN 1 THEN NULL ELSE 'visual' END AS label_source,
       CASE o_orderkey % 17 WHEN 0 THEN TRUE WHEN 1 THEN NULL ELSE FALSE END AS eval_set,
       CASE o_orderkey % 11 WHEN 0 THEN 'inspected' WHEN 1 THEN NULL ELSE 'skipped' END AS viz_status,
       (o_orderkey * 31 % 401) / 1000e0 - 2e-1 AS template_score_if,
       CAST(1 + o_orderkey % 12 AS INT) AS num_bldgs, o_totalprice AS total_area_m2
FROM orders JOIN fx_country ON o_custkey % 25 = ord
""",
    # model scores with ties, correlated with the label; -1 = no ground truth
    "fx_scored": """
SELECT ord, cluster_id AS candidate_id, adm0, country, lat, lng, final_label, template_score_if,
       CASE WHEN final_label IS NULL THEN -1 WHEN final_label = 'NotFarm' THEN 0 ELSE 1 END AS true_label,
       (CASE WHEN final_label = 'NotFarm' THEN 0 ELSE 300 END + ord * 7919 % 701) / 1000e0 AS predicted_score,
       CASE ord % 7 WHEN 0 THEN 'val' WHEN 1 THEN 'test' WHEN 2 THEN 'inspected' WHEN 3 THEN 'eval' ELSE 'train' END AS split
FROM fx_clusters WHERE final_label IS NULL OR final_label <> 'Ambiguous'
""",
    # dated multi-band observations per tile/pixel (composites, indices, masks)
    "fx_pixels": """
SELECT l_suppkey AS tile_id, CAST(l_partkey % 8 AS INT) AS row, CAST(l_orderkey % 8 AS INT) AS col,
       l_shipdate AS obs_ts, l_discount * 500 AS cloud_pct, l_quantity * 40 AS b2, l_quantity * 50 + 100 AS b3,
       l_tax * 20000 + 200 AS b4, l_quantity * 60 + 300 AS b8, l_extendedprice / 10 AS b11, l_quantity * 30 + 50 AS b12,
       CAST(l_linenumber AS INT) AS landcover, -20e0 + l_linenumber * 3 AS vv_db
FROM lineitem
""",
    # three-class truth and a prediction that is wrong for one row in five
    "fx_multi": """
SELECT ord, cluster_id AS candidate_id, country, country_key, adm0, true_class,
       CAST(CASE WHEN ord % 5 = 0 THEN (true_class + 1 + ord % 2) % 3 ELSE true_class END AS INT) AS pred_class,
       (ord * 7919 % 701) / 701e0 AS top_score,
       CASE ord % 7 WHEN 0 THEN 'val' WHEN 1 THEN 'test' WHEN 2 THEN 'inspected' WHEN 3 THEN 'eval' ELSE 'train' END AS split
FROM (SELECT *, CASE WHEN final_label = 'NotFarm' THEN 0 WHEN final_label LIKE 'Farm: Poultry%' THEN 1
                     WHEN final_label IN ('Farm: Pigs', 'Farm: Cattle') THEN 2 END AS true_class FROM fx_clusters) x
WHERE true_class IS NOT NULL
""",
    # patches of 4 channels of 4 x 4, channel-major
    "fx_patches": """
SELECT CAST(vec_id AS BIGINT) AS candidate_id, embedding AS data, 4 AS n_channels, 4 AS height, 4 AS width, label FROM embeddings
""",
}


def _needs(sql: str) -> list[str]:
    """Views that a statement uses, each after those it is made from."""
    wanted: list[str] = []

    def add(text: str) -> None:
        for name in FX:
            if re.search(rf"\b{name}\b", text) and name not in wanted:
                add(FX[name])
                if name not in wanted:
                    wanted.append(name)

    add(sql)
    return wanted


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a derived view."""
    for base in BASE:
        if name == base or name in FX and any(re.search(rf"\b{base}\b", FX[x]) for x in _needs(name)):
            spark.read.parquet(f"{sf_dir}/{base}.parquet").createOrReplaceTempView(base)
    for view in _needs(name):
        spark.sql(FX[view]).createOrReplaceTempView(view)
    return spark.table(name)


def oracle(sql: str) -> str:
    """A statement with the views it uses as common table expressions."""
    names = _needs(sql)
    if not names:
        return sql
    views = ",\n".join(f"{n} AS ({FX[n].strip()})" for n in names)
    body = sql.strip()
    if body[:4].upper() == "WITH":
        recursive = body[4:].strip()[:9].upper() == "RECURSIVE"
        rest = body[4:].strip()[9:] if recursive else body[4:]
        return f"WITH {'RECURSIVE ' if recursive else ''}{views},\n{rest}"
    return f"WITH {views}\n{body}"
