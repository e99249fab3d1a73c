"""Queries on labels, taxonomies, lookups and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoquill.functions import labels as L
from geoquill.operators import lookups as J
from geoquill.plans.registry import query


def _case(values: dict, key: str, other: str = "NULL") -> str:
    lit = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {key} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in values.items()) + f" ELSE {other} END"


# Fixed values, written out apart from the operators' own tables: what the labels, tags, categories and species of the data should become.
THREE = {"NotFarm": 0, "Farm: Poultry: Meat Chickens": 1, "Farm: Poultry: Eggs": 1, "Farm: Poultry: Unspecified/Other": 1, "Farm: Pigs": 2, "Farm: Cattle": 2}
SEVEN = {
    "NotFarm": 0, "Farm: Poultry: Meat Chickens": 1, "Farm: Poultry: Eggs": 2, "Farm: Poultry: Unspecified/Other": 3, "Farm: Pigs": 4, "Farm: Cattle": 5, "Farm: Mixed": 6, "Farm: Unknown": 6,
    "Farm: PigsOrPoultry": 6,
}
FIVE_OF_SEVEN = {0: 0, 1: 1, 2: 1, 3: 1, 4: 2, 5: 3, 6: 4}
THREE_OF_SEVEN = {0: 0, 1: 1, 2: 1, 3: 1, 4: 2, 5: 2, 6: 2}
COUNTRY_KEYS = {"USA": "united_states", "GBR": "united_kingdom", "ZAF": "south_africa"}
KINDS = {"cows/cattle": "cattle", "pigs (unconfirmed)": "pigs"}
CATEGORIES = {"farm (meat)": ("farm", "farm_meat"), "farm (eggs)": ("farm", "farm_eggs"), "farm (dairy)": ("farm", "farm_dairy"), "slaughterhouse": ("processing", "slaughterhouse"), "farm": ("farm", "farm_generic")}
TAG_GROUPS = {
    "building=barn": ("farm", "barn"), "building=warehouse": ("industrial", "warehouse"), "building=yes": ("unknown", "building_unclassified"), "building=chicken_coop": ("farm", "farm_eggs"),
    "building=house": ("residential", "house"), "landuse=farmyard": ("farm", "farm_generic"),
}
WORDS_OF = {
    "Chickens": ("chicken", "poultry", "broiler", "layer", "egg", "hen", "hatchery"), "Pigs": ("pig", "swine", "pork", "sow", "boar", "sty"), "Cattle": ("cattle", "cow", "beef", "dairy", "buffalo"),
    "Ducks": ("duck",), "Turkeys": ("turkey",),
}
OSM_WORDS = "sty|chicken|poultry|cowshed|livestock|animal_breeding|pig|farm"


@query("p01_valid_coords", "SELECT id, lat, lng FROM fx_farms WHERE lat IS NOT NULL AND lng IS NOT NULL AND lat <> 0 AND lng <> 0")
def _(t):
    return t("fx_farms").where(L.valid_coords()).select("id", "lat", "lng")


@query("p02_category_any_of", "SELECT id, category FROM fx_farms WHERE lower(coalesce(category, '')) LIKE '%farm (%' OR lower(coalesce(category, '')) LIKE '%hatchery%'")
def _(t):
    return t("fx_farms").where(L.category_any_of("category", ["FARM (", "Hatchery"])).select("id", "category")


@query("p03_species_in", "SELECT id, species FROM fx_farms WHERE species IN ('Chickens', 'Ducks')")
def _(t):
    return t("fx_farms").where(L.species_in("species", ["Chickens", "Ducks"])).select("id", "species")


@query("p04_region_string", "SELECT id, lower(country) || CASE WHEN state <> '' THEN '/' || state ELSE '' END AS region, lower(country) AS country_key, CASE WHEN state <> '' THEN state END AS state FROM fx_farms")
def _(t):
    d = t("fx_farms").withColumn("country_key", F.lower("country")).withColumn("region", L.region_string())
    return d.select("id", "region", L.parse_region("region").alias("p")).select("id", "region", "p.country_key", "p.state")


@query("p06_filter_regions", "SELECT id, lower(country) AS country_key, state FROM fx_farms WHERE lower(country) IN ('nation_3', 'nation_7') OR lower(country) = 'nation_10' AND state IN ('', 'S2') OR lower(country) = 'nation_15' AND state IN ('', 'S0', 'S4')")
def _(t):
    d = t("fx_farms").select("id", F.lower("country").alias("country_key"), "state")
    regions = d.sparkSession.createDataFrame([("nation_3", None), ("nation_7", None), ("nation_10", "S2"), ("nation_15", "S0"), ("nation_15", "S4")], "country_key string, state string")
    return L.filter_regions(d, regions)


@query("p08_exclusions", "SELECT cluster_id, final_label FROM fx_clusters WHERE final_label IS DISTINCT FROM 'Ambiguous' AND (final_label IS NULL OR final_label NOT IN ('Farm: Mixed', 'Farm: Unknown')) AND viz_status = 'inspected'")
def _(t):
    keep = L.not_ambiguous("final_label") & L.not_excluded("final_label", ["Farm: Mixed", "Farm: Unknown"]) & (F.col("viz_status") == "inspected")
    return t("fx_clusters").where(keep).select("cluster_id", "final_label")


OSM_FARM = f"(coalesce(original_label, '') ILIKE '%osm%' AND (coalesce(standardized_label LIKE 'Farm%', FALSE) OR standardized_label IS NULL AND regexp_matches(lower(coalesce(original_label, '')), '{OSM_WORDS}')))"


@query("p09_exclude_osm_farms", f"SELECT cluster_id, original_label, standardized_label FROM fx_clusters WHERE NOT {OSM_FARM}")
def _(t):
    return t("fx_clusters").where(~L.is_osm_farm()).select("cluster_id", "original_label", "standardized_label")


@query("p10_labels", f"""SELECT cluster_id, CASE WHEN final_label IS NULL THEN -1 WHEN final_label = 'NotFarm' THEN 0 ELSE 1 END AS "binary", CASE WHEN final_label IS NULL THEN -1 WHEN final_label LIKE '%Poultry%' THEN 1 ELSE 0 END AS poultry,
{_case(THREE, 'final_label', '-1')} AS three, {_case(SEVEN, 'final_label', '-1')} AS seven FROM fx_clusters""")
def _(t):
    return t("fx_clusters").select("cluster_id", L.label_binary("final_label").alias("binary"), L.label_poultry("final_label").alias("poultry"), L.label_three_class("final_label").alias("three"), L.label_multiclass("final_label").alias("seven"))


CODES = "CASE ord % 4 WHEN 0 THEN 'USA' WHEN 1 THEN 'GBR' WHEN 2 THEN 'ZAF' ELSE adm0 END"


@query("p11_adm0_to_country", f"SELECT cluster_id, {_case(COUNTRY_KEYS, 'code', 'lower(code)')} AS country_key, CASE code WHEN 'USA' THEN 'United States' WHEN 'GBR' THEN 'United Kingdom' WHEN 'ZAF' THEN 'South Africa' ELSE code END AS country FROM (SELECT cluster_id, {CODES} AS code FROM fx_clusters)")
def _(t):
    return t("fx_clusters").withColumn("code", F.expr(CODES)).select("cluster_id", L.country_key_of("code").alias("country_key"), L.country_name_of("code").alias("country"))


@query("p12_fill_defaults", "SELECT cluster_id, coalesce(viz_status, '') AS viz_status, coalesce(label_source, '') AS label_source, coalesce(CAST(eval_set AS INT), 0) AS eval_set, 0 AS random_sample FROM fx_clusters")
def _(t):
    return L.fill_defaults(t("fx_clusters").select("cluster_id", "viz_status", "label_source", "eval_set"), ["viz_status", "label_source", "visual_label"], ["eval_set", "random_sample"])


CAT = "trim(split_part(regexp_replace(lower(trim(category)), '\\s*\\(unconfirmed\\)\\s*$', ''), ',', 1))"
SPECIES = f"coalesce({_case(KINDS, 'lower(trim(coalesce(species, chr(32))))')}, lower(trim(coalesce(species, ''))))"
UNIFY = f"""u AS (SELECT *, {SPECIES} AS kind, CASE WHEN source = 'FarmTransparency' THEN {_case({k: v[0] + '/' + v[1] for k, v in CATEGORIES.items()}, CAT)} END AS c1,
  {_case({k: v[0] + '/' + v[1] for k, v in TAG_GROUPS.items()}, 'lower(trim(category))')} AS c2 FROM fx_farms),
v AS (SELECT *, coalesce(c1, c2, CASE WHEN kind <> '' THEN 'farm/farm_generic' ELSE 'unknown/unknown' END) AS gl FROM u)"""


@query("p13_unify_label", f"WITH {UNIFY} SELECT id, split_part(gl, '/', 1) AS grp, split_part(gl, '/', 2) AS label, kind AS species, split_part(gl, '/', 1) = 'farm' AS is_farm FROM v")
def _(t):
    return t("fx_farms").select("id", L.unify_label("source", "category", "species").alias("u")).select("id", F.col("u.group").alias("grp"), "u.label", "u.species", "u.is_farm")


TAGS = {**{k: v[1] for k, v in TAG_GROUPS.items()}}


@query("p13_unify_tags", f"""SELECT osm_id, coalesce({_case(TAGS, "'building=' || building")}, {_case(TAGS, "'landuse=' || landuse")}, 'unknown') AS label FROM fx_osm_tags""")
def _(t):
    d = t("fx_osm_tags").withColumns({"none": F.lit(None).cast("string"), "source": F.lit("osm")})
    tags = F.map_filter(F.create_map(F.lit("building"), F.col("building"), F.lit("landuse"), F.col("landuse")), lambda k, v: v.isNotNull())
    return d.select("osm_id", L.unify_label("source", "none", "none", tags)["label"].alias("label"))


@query("p14_match_category", f"SELECT id, {_case({k: v[0] for k, v in CATEGORIES.items()}, CAT)} AS grp, {_case({k: v[1] for k, v in CATEGORIES.items()}, CAT)} AS label FROM fx_farms")
def _(t):
    return t("fx_farms").select("id", L.match_category("category").alias("m")).select("id", F.col("m.group").alias("grp"), "m.label")


@query("p15_normalise_species", f"SELECT id, {SPECIES} AS species FROM fx_farms")
def _(t):
    return t("fx_farms").select("id", L.normalise_species("species").alias("species"))


KEYWORDS = " ".join(f"WHEN {' OR '.join(f'contains(x, {chr(39)}{w}{chr(39)})' for w in ws)} THEN '{s}'" for s, ws in WORDS_OF.items())


@query("p16_classify_species", f"SELECT osm_id, coalesce(s, 'Unknown') AS species, CASE WHEN s IS NULL THEN 'Farm' ELSE 'Farm (meat)' END AS category FROM (SELECT osm_id, CASE {KEYWORDS} END AS s FROM (SELECT osm_id, lower(concat_ws(' ', coalesce(name, ''), building, landuse)) AS x FROM fx_osm_tags))")
def _(t):
    values = F.array_compact(F.array("building", "landuse"))
    return t("fx_osm_tags").select("osm_id", L.classify_species(F.col("name"), values).alias("c")).select("osm_id", "c.species", "c.category")


@query("p17_parse_tag", "SELECT id, trim(split_part(category, '=', 1)) AS key, CASE WHEN contains(category, '=') THEN trim(substr(category, strpos(category, '=') + 1)) WHEN category IS NOT NULL THEN '' END AS value FROM fx_farms WHERE category IS NOT NULL")
def _(t):
    return t("fx_farms").where("category is not null").select("id", L.parse_tag("category").alias("p")).select("id", "p.*")


@query("p38_confidence_tier", "SELECT candidate_id, CASE WHEN predicted_score >= 0.9 THEN 'high' WHEN predicted_score >= 0.7 THEN 'medium' WHEN predicted_score >= 0.5 THEN 'low' ELSE 'very_low' END AS tier FROM fx_scored")
def _(t):
    return t("fx_scored").select("candidate_id", L.confidence_tier("predicted_score").alias("tier"))


@query("p39_predict_label", "SELECT candidate_id, CASE WHEN predicted_score >= 0.5 THEN 1 ELSE 0 END AS two, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS three FROM (SELECT candidate_id, predicted_score, 1 - predicted_score AS a, predicted_score / 2 AS b, 0.3e0 AS c FROM fx_scored)")
def _(t):
    s = F.col("predicted_score")
    return t("fx_scored").select("candidate_id", L.predict_label(F.array(1 - s, s))["label"].alias("two"), L.predict_label(F.array(1 - s, s / 2, F.lit(0.3)))["label"].alias("three"))


@query("p41_three_way", f"SELECT cluster_id, CASE WHEN final_label = 'NotFarm' THEN 'NotFarm' WHEN final_label LIKE '%Poultry%' THEN 'Poultry' WHEN final_label IS NOT NULL THEN 'OtherFarm' END AS kind, {_case(FIVE_OF_SEVEN, 's', '-1')} AS five, {_case(THREE_OF_SEVEN, 's', '-1')} AS three FROM (SELECT *, {_case(SEVEN, 'final_label', '-1')} AS s FROM fx_clusters)")
def _(t):
    seven = L.label_multiclass("final_label")
    return t("fx_clusters").select("cluster_id", L.three_way("final_label").alias("kind"), L.collapse(seven, L.SEVEN_TO_FIVE).alias("five"), L.collapse(seven, L.SEVEN_TO_THREE).alias("three"))


@query("p43_id_parts", "SELECT cluster_id, upper(split_part(cluster_id, '_', 1)) AS iso, regexp_extract('x_' || substr(adm0, 1, 2) || '_' || cluster_id, '_([A-Z]{2})_', 1) AS state FROM fx_clusters")
def _(t):
    return t("fx_clusters").withColumn("x", F.concat(F.lit("x_"), F.substring("adm0", 1, 2), F.lit("_"), F.col("cluster_id"))).select("cluster_id", L.iso_prefix("cluster_id").alias("iso"), L.state_from_id("x").alias("state"))


@query("p46_maps_url", "SELECT cluster_id, printf('https://www.google.com/maps?q=%.6f,%.6f&t=k', lat, lng) AS url FROM fx_clusters")
def _(t):
    return t("fx_clusters").select("cluster_id", L.maps_url().alias("url"))


@query("p47_is_multiclass", f"SELECT max({_case(SEVEN, 'final_label', '-1')}) > 1 AS multi FROM fx_clusters")
def _(t):
    return t("fx_clusters").agg((F.max(L.label_multiclass("final_label")) > 1).alias("multi"))


COLUMNS = {"adm0": "string", "cluster_id": "string", "final_label": "string", "eval_set": "boolean", "dmv": "string"}


@query("p45_normalize_columns", "SELECT adm0, cluster_id, final_label, coalesce(eval_set, FALSE) AS eval_set, CAST(NULL AS VARCHAR) AS dmv FROM fx_clusters")
def _(t):
    return J.normalize_columns(t("fx_clusters"), COLUMNS, ["eval_set"])


@query("j01_lookup", "WITH r AS (SELECT adm0, arg_max(final_label, ord) AS final_label FROM fx_clusters WHERE ord % 3 = 0 AND final_label IS NOT NULL AND country_key <> 'nation_5' GROUP BY adm0) SELECT candidate_id, adm0, coalesce(r.final_label, 'none') AS final_label FROM (SELECT candidate_id, adm0 FROM fx_scored) LEFT JOIN r USING (adm0)")
def _(t):
    right = t("fx_clusters").where("ord % 3 = 0 and final_label is not null and country_key <> 'nation_5'")
    return J.lookup(t("fx_scored").select("candidate_id", "adm0"), right, "adm0", {"final_label": "none"}, "ord")


@query("j02_join_scores", "SELECT candidate_id, predicted_score, num_bldgs FROM fx_scored s JOIN fx_clusters c ON s.candidate_id = c.cluster_id")
def _(t):
    return t("fx_scored").join(t("fx_clusters").select(F.col("cluster_id").alias("candidate_id"), "num_bldgs"), "candidate_id").select("candidate_id", "predicted_score", "num_bldgs")


@query("j03_first_match", "WITH r AS (SELECT country, arg_min(id, ord) AS id FROM fx_farms GROUP BY country) SELECT cluster_id, country, r.id FROM fx_clusters LEFT JOIN r USING (country)")
def _(t):
    return J.first_match(t("fx_clusters").select("cluster_id", "country"), t("fx_farms"), "country", ["id"], "ord")


@query("j04_semi_join_ids", "SELECT candidate_id FROM fx_scored WHERE candidate_id IN (SELECT cluster_id FROM fx_clusters WHERE viz_status = 'inspected')")
def _(t):
    return t("fx_scored").select("candidate_id").join(t("fx_clusters").where("viz_status = 'inspected'").select(F.col("cluster_id").alias("candidate_id")), "candidate_id", "left_semi")


@query("j05_anti_join_done", "SELECT candidate_id FROM fx_scored WHERE split <> 'val' AND ord % 5 <> 0")
def _(t):
    s = t("fx_scored")
    return J.not_done(s.select("candidate_id"), s.where("split = 'val'"), s.where("ord % 5 = 0"))


@query("j15_stage_audit", """
SELECT country, coalesce(a, 0) AS source, coalesce(b, 0) AS csv, coalesce(c, 0) AS scored, coalesce(a, 0) = coalesce(b, 0) AND coalesce(a, 0) = coalesce(c, 0) AS equal FROM (SELECT country, count(*) AS a FROM fx_clusters GROUP BY 1)
FULL JOIN (SELECT country, count(*) AS b FROM fx_clusters WHERE country <> 'NATION_5' GROUP BY 1) USING (country) FULL JOIN (SELECT country, count(*) AS c FROM fx_scored GROUP BY 1) USING (country)""")
def _(t):
    c = t("fx_clusters")
    return J.stage_audit({"source": c, "csv": c.where("country <> 'NATION_5'"), "scored": t("fx_scored")}, "country")


MERGED = {"adm0": "string", "cluster_id": "string", "final_label": "string", "num_bldgs": "int"}


@query("u02_merge_clusters", """
WITH n AS (SELECT adm0, cluster_id, final_label, num_bldgs + 1 AS num_bldgs, ord FROM fx_clusters WHERE adm0 LIKE 'NAT1%' OR adm0 LIKE 'NAT2%'), m AS (SELECT adm0, cluster_id, 'NotFarm' AS final_label, num_bldgs, ord FROM fx_clusters WHERE adm0 LIKE 'NAT2%'),
a AS (SELECT adm0, cluster_id, final_label, num_bldgs, ord, 0 AS k FROM fx_clusters WHERE adm0 NOT LIKE 'NAT1%' AND adm0 NOT LIKE 'NAT2%' UNION ALL SELECT *, 1 FROM n UNION ALL SELECT *, 2 FROM m)
SELECT adm0, cluster_id, final_label, num_bldgs, ord FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY k DESC, ord DESC) AS r FROM a) WHERE r = 1""")
def _(t):
    c = t("fx_clusters")
    one = c.where("adm0 like 'NAT1%' or adm0 like 'NAT2%'").withColumn("num_bldgs", F.col("num_bldgs") + 1)
    two = c.where("adm0 like 'NAT2%'").withColumn("final_label", F.lit("NotFarm"))
    return J.merge_clusters(c, [one, two], MERGED)


@query("a28_merge_summary", "SELECT adm0, count(*) AS n, count(DISTINCT cluster_id) AS clusters, count(final_label) AS labelled, count(*) FILTER (eval_set) AS eval FROM fx_clusters GROUP BY adm0 ORDER BY n DESC, adm0 LIMIT 10")
def _(t):
    g = t("fx_clusters").groupBy("adm0").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cluster_id").alias("clusters"), F.count("final_label").alias("labelled"), F.count_if("eval_set").alias("eval"))
    return g.orderBy(F.desc("n"), "adm0").limit(10)  # a top-k report


@query("a36_label_summary", "SELECT country, count(*) FILTER (l = 1) AS pos, count(*) FILTER (l = 0) AS neg, count(*) FILTER (l = -1) AS unlabelled, count(*) FILTER (eval_set) AS eval FROM (SELECT *, CASE WHEN final_label IS NULL THEN -1 WHEN final_label = 'NotFarm' THEN 0 ELSE 1 END AS l FROM fx_clusters) GROUP BY country")
def _(t):
    one = L.label_binary("final_label")
    return t("fx_clusters").groupBy("country").agg(F.count_if(one == 1).alias("pos"), F.count_if(one == 0).alias("neg"), F.count_if(one == -1).alias("unlabelled"), F.count_if("eval_set").alias("eval"))


@query("a34_species_counts", "SELECT species, count(*) AS n FROM fx_farms WHERE species IS NOT NULL GROUP BY species")
def _(t):
    return t("fx_farms").where("species is not null").groupBy("species").agg(F.count(F.lit(1)).alias("n"))


@query("w01_keep_last", "SELECT adm0, final_label, cluster_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY adm0, final_label ORDER BY ord DESC) AS r FROM fx_clusters) WHERE r = 1")
def _(t):
    return J.keep_last(t("fx_clusters").select("adm0", "final_label", "cluster_id", "ord"), ["adm0", "final_label"], "ord")


@query("w02_first_seen", "SELECT name, min(osm_id) AS osm_id FROM fx_osm_tags GROUP BY name")
def _(t):
    return J.keep_first(t("fx_osm_tags").select("name", "osm_id"), ["name"], F.col("osm_id"))


@query("w09_cap_per_group", "SELECT building_id, country FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY ord) AS r FROM fx_buildings) WHERE r <= 20")
def _(t):
    return J.cap_per_group(t("fx_buildings"), ["country"], 20, "ord").select("building_id", "country")


@query("w10_sequence_ids", "SELECT building_id, 'neg_' || country_key || '_' || (row_number() OVER (PARTITION BY country_key ORDER BY ord) - 1) AS id FROM fx_buildings")
def _(t):
    return J.sequence_ids(t("fx_buildings"), "neg", "country_key", "ord").select("building_id", "id")


@query("w11_minmax", "SELECT candidate_id, round((template_score_if - min(template_score_if) OVER ()) / (max(template_score_if) OVER () - min(template_score_if) OVER ()), 6) AS scaled FROM fx_scored")
def _(t):
    from geoquill.operators.metrics import minmax

    return minmax(t("fx_scored"), "template_score_if", "scaled").select("candidate_id", F.round("scaled", 6).alias("scaled"))
