"""Queries on spatial joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoquill.operators import spatial as S
from geoquill.plans.labels import UNIFY
from geoquill.plans.registry import query

FARMS = "f AS (SELECT * FROM fx_farms WHERE lat IS NOT NULL AND lng IS NOT NULL)"

#: The nearest joins' cosine, to nine places. Equal to a tenth of a millimetre, distances are a tie.
COSINE = "floor(cos(radians(avg(lat))) * 1e9 + 0.5e0) / 1e9"


def _nearest(ref: str, rid: str, r: float, extra: str = "") -> str:
    return f"""k AS (SELECT {COSINE} AS k FROM {ref}),
d AS (SELECT b.building_id, r.{rid} AS rid{extra}, (b.lng - r.lng) * 111000 * k AS dx, (b.lat - r.lat) * 111000 AS dy, sqrt(dx * dx + dy * dy) AS m FROM fx_buildings b, {ref} r, k),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY floor(m * 10000 + 0.5e0), rid) AS p FROM d WHERE m <= {r}) WHERE p = 1)"""


@query("j06_nearest_within", f"WITH {FARMS}, {_nearest('f', 'id', 3000)} SELECT b.building_id, rid AS match_id, round(m, 4) AS match_m, m IS NOT NULL AS matched FROM fx_buildings b LEFT JOIN n USING (building_id)")
def _(t):
    got = S.nearest_within(t("fx_buildings"), t("fx_farms"), 3000, "building_id", "id")
    m = F.when(F.col("match_id").isNotNull(), F.round("match_m", 4))
    return got.select("building_id", "match_id", m.alias("match_m"), F.col("match_id").isNotNull().alias("matched"))


CASCADE = f"""WITH {UNIFY}, g AS (SELECT *, split_part(gl, '/', 1) = 'farm' AS is_farm, split_part(gl, '/', 2) AS lab FROM v WHERE lat IS NOT NULL AND lng IS NOT NULL),
ka AS (SELECT {COSINE} AS k FROM g WHERE source = 'FarmTransparency'), kb AS (SELECT {COSINE} AS k FROM g WHERE source <> 'FarmTransparency'),
d AS (SELECT b.building_id, g.id, g.lab, g.kind, g.is_farm, g.source <> 'FarmTransparency' AS second,
  (b.lng - g.lng) * 111000 * CASE WHEN g.source = 'FarmTransparency' THEN ka.k ELSE kb.k END AS dx, (b.lat - g.lat) * 111000 AS dy, sqrt(dx * dx + dy * dy) AS m FROM fx_buildings b, g, ka, kb),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY second, floor(m * 10000 + 0.5e0), id) AS p FROM d WHERE m <= 3000) WHERE p = 1),
l AS (SELECT b.building_id, b.lat, b.lng, CASE WHEN n.id IS NULL THEN 0 WHEN NOT second THEN 1 WHEN is_farm THEN 1 ELSE 0 END AS label, coalesce(lab, 'unknown') AS unified_label, coalesce(kind, '') AS matched_species,
  coalesce(id, '') AS matched_id, CASE WHEN n.id IS NULL THEN '' WHEN second THEN 'osm' ELSE 'farm_transparency' END AS source_label FROM fx_buildings b LEFT JOIN n USING (building_id))"""


@query("j07_label_buildings", f"{CASCADE} SELECT building_id, label, unified_label, matched_species, matched_id, source_label FROM l")
def _(t):
    return S.label_buildings(t("fx_buildings"), t("fx_farms"), 3000).select("building_id", "label", "unified_label", "matched_species", "matched_id", "source_label")


TAGGED = f"""tags AS (SELECT osm_id, lat, lng, coalesce(CASE building WHEN 'warehouse' THEN 'industrial/warehouse' WHEN 'barn' THEN 'farm/barn' WHEN 'yes' THEN 'unknown/building_unclassified' WHEN 'chicken_coop' THEN 'farm/farm_eggs' WHEN 'house' THEN 'residential/house' END,
  CASE landuse WHEN 'farmyard' THEN 'farm/farm_generic' END) AS gl FROM fx_osm_tags WHERE building IS NOT NULL OR landuse IS NOT NULL),
kt AS (SELECT {COSINE} AS k FROM tags), dt AS (SELECT l.building_id, osm_id, gl, (l.lng - r.lng) * 111000 * k AS dx, (l.lat - r.lat) * 111000 AS dy, sqrt(dx * dx + dy * dy) AS m FROM l, tags r, kt WHERE unified_label = 'unknown'),
nt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY floor(m * 10000 + 0.5e0), osm_id) AS p FROM dt WHERE m <= 2000) WHERE p = 1)"""


@query("j08_enrich_with_tags", f"{CASCADE}, {TAGGED} SELECT l.building_id, CASE WHEN split_part(gl, '/', 1) = 'farm' THEN 1 ELSE label END AS label, coalesce(split_part(gl, '/', 2), unified_label) AS unified_label FROM l LEFT JOIN nt USING (building_id)")
def _(t):
    return S.enrich_with_tags(S.label_buildings(t("fx_buildings"), t("fx_farms"), 3000), t("fx_osm_tags"), 2000).select("building_id", "label", "unified_label")


def greedy(points: str, radius: float) -> str:
    """CTEs p (points in order) and kept (one list): the rows of points (ord, lat, lng) that greedy dedup keeps."""
    return f"""p AS (SELECT ord, lat, lng, row_number() OVER (ORDER BY ord) AS i FROM {points}),
g AS (SELECT 0::BIGINT AS i, [{{'o': -1::BIGINT, 'y': 999e0, 'x': 999e0}}] AS kept
  UNION ALL SELECT p.i, CASE WHEN len(list_filter(g.kept, lambda k: sqrt(((p.lat - k.y) * 111000) ** 2 + ((p.lng - k.x) * 111000 * cos(radians(k.y))) ** 2) < {radius})) > 0 THEN g.kept
  ELSE list_append(g.kept, {{'o': p.ord, 'y': p.lat, 'x': p.lng}}) END FROM g JOIN p ON p.i = g.i + 1),
kept AS (SELECT unnest(kept).o AS ord FROM (SELECT kept FROM g ORDER BY i DESC LIMIT 1))"""


@query("j09_dedup_proximity", f"WITH RECURSIVE {greedy('fx_buildings', 1500e0)} SELECT building_id, ord FROM fx_buildings SEMI JOIN kept USING (ord)")
def _(t):
    return S.dedup_proximity(t("fx_buildings"), 1500.0).select("building_id", "ord")


@query("j10_drop_near_existing", f"WITH {FARMS} SELECT building_id FROM fx_buildings b WHERE NOT EXISTS (SELECT 1 FROM f WHERE sqrt((radians(f.lat) - radians(b.lat)) ** 2 + (radians(f.lng) - radians(b.lng)) ** 2) * 6371000 <= 2000)")
def _(t):
    return S.drop_near_existing(t("fx_buildings"), t("fx_farms"), 2000.0).select("building_id")


FAR = "sqrt(((f.lat - b.lat) * 111000) ** 2 + ((f.lng - b.lng) * 111000 * cos(radians(b.lat))) ** 2)"


@query("j11_far_from", f"WITH {FARMS} SELECT building_id FROM fx_buildings b WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.country = b.country AND {FAR} < 4000)")
def _(t):
    return S.far_from(t("fx_buildings"), t("fx_farms"), 4000.0).select("building_id")


@query("j12_validate_matches", f"""WITH {FARMS}, c AS (SELECT provider, lat, lng FROM fx_buildings UNION ALL SELECT 'combined', lat, lng FROM fx_buildings),
x AS (SELECT provider, count(*) AS candidates, count(*) FILTER (EXISTS (SELECT 1 FROM f WHERE {FAR.replace('b.', 'c.')} < 1000)) AS true_positives FROM c GROUP BY provider),
y AS (SELECT provider, count(*) AS known_matched FROM f, (SELECT DISTINCT provider FROM c) p WHERE EXISTS (SELECT 1 FROM c WHERE c.provider = p.provider AND sqrt(((c.lat - f.lat) * 111000) ** 2 + ((c.lng - f.lng) * 111000 * cos(radians(f.lat))) ** 2) < 1000) GROUP BY provider),
z AS (SELECT provider, candidates, true_positives, coalesce(known_matched, 0) AS known_matched, (SELECT count(*) FROM f) AS known_total FROM x LEFT JOIN y USING (provider)), w AS (SELECT *, true_positives / candidates AS p, known_matched / known_total AS r FROM z)
SELECT provider, candidates, true_positives, known_matched, known_total, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1 FROM w""")
def _(t):
    known = t("fx_farms").where("lat is not null and lng is not null")
    return S.validate_matches(t("fx_buildings").select("provider", "lat", "lng"), known.select("lat", "lng"), 1000.0, "provider")


@query("j13_bbox_lookup", "SELECT building_id, (SELECT arg_min(country_key, ord) FROM fx_country c WHERE b.lng BETWEEN min_lon AND max_lon AND b.lat BETWEEN min_lat AND max_lat) AS country_key FROM fx_buildings b")
def _(t):
    return S.bbox_lookup(t("fx_buildings").drop("country_key"), t("fx_country"), "country_key", "ord", "building_id").select("building_id", "country_key")


@query("j13_states_before_countries", """WITH r AS (SELECT 'nation_1/' || state AS v, 0 AS kind, 0 AS ord, state AS name, min_lon, min_lat, max_lon, max_lat FROM fx_states UNION ALL SELECT country_key, 1, ord, country_key, min_lon, min_lat, max_lon, max_lat FROM fx_country)
SELECT building_id, (SELECT first(v ORDER BY kind, ord, name) FROM r WHERE b.lng BETWEEN min_lon AND max_lon AND b.lat BETWEEN min_lat AND max_lat) AS region FROM fx_buildings b""")
def _(t):
    registry = S.region_order(t("fx_states"), t("fx_country"), "nation_1")
    return S.bbox_lookup(t("fx_buildings"), registry.withColumnRenamed("value", "region"), "region", "place", "building_id", bound=3).select("building_id", "region")


TILES = """t0 AS (SELECT country_key, min_lon, min_lat, max_lon, max_lat, i, j FROM fx_country, range(12) a(i), range(6) b(j) WHERE min_lon + i * 0.5e0 < max_lon AND min_lat + j * 0.5e0 < max_lat),
t1 AS (SELECT country_key, i, j, min_lon + i * 0.5e0 AS x0, least(min_lon + (i + 1) * 0.5e0, max_lon) AS x1, min_lat + j * 0.5e0 AS y0, least(min_lat + (j + 1) * 0.5e0, max_lat) AS y1 FROM t0)"""


@query("j14_generate_tiles", f"""WITH {FARMS}, {TILES} SELECT country_key, CAST(i AS INT) AS i, CAST(j AS INT) AS j FROM t1 WHERE EXISTS (SELECT 1 FROM f WHERE f.lng BETWEEN (x0 + x1) / 2 - 0.375e0 AND (x0 + x1) / 2 + 0.375e0 AND f.lat BETWEEN (y0 + y1) / 2 - 0.375e0 AND (y0 + y1) / 2 + 0.375e0)""")
def _(t):
    return S.generate_tiles(t("fx_country"), 0.5, t("fx_farms")).select("country_key", "i", "j")


@query("s13_query_buildings", """SELECT building_id, 'gob_' || printf('%.6f', lng) || '_' || printf('%.6f', lat) AS footprint_id FROM fx_buildings WHERE confidence >= 0.5 AND area_m2 BETWEEN 500 AND 40000 AND provider = 'google_open_buildings' AND lng BETWEEN -60 AND -20 AND lat BETWEEN -30 AND 0""")
def _(t):
    from geoquill.sources.readers import query_buildings

    return query_buildings(t("fx_buildings"), (-60, -30, -20, 0), 500, 40000, 0.5, "google_open_buildings", "gob").select("building_id", "footprint_id")


@query("s14_query_country_buildings", """SELECT building_id FROM (SELECT *, row_number() OVER (PARTITION BY country_key ORDER BY floor(lat / 0.05e0), floor(lng / 0.05e0), ord) AS r FROM fx_buildings WHERE area_m2 BETWEEN 500 AND 40000) WHERE r <= 30""")
def _(t):
    from geoquill.sources.readers import query_country_buildings

    return query_country_buildings(t("fx_buildings"), 500, 40000, 0.05, 30).select("building_id")
