"""Queries on splits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoquill.functions.labels import label_binary
from geoquill.operators import sampling as N
from geoquill.operators import splits as P
from geoquill.operators.metrics import outcome_class
from geoquill.plans.metrics import OUTCOME
from geoquill.plans.registry import query


def _u(*parts: str, seed: int = 42) -> str:
    return "(('0x' || substr(md5(concat_ws(':', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + f", '{seed}')), 1, 8))::BIGINT / 4294967296e0)"


LABELLED = "(SELECT *, cluster_id AS candidate_id, CASE WHEN final_label IS NULL THEN -1 WHEN final_label = 'NotFarm' THEN 0 ELSE 1 END AS label FROM fx_clusters)"


def _candidates(t):
    return t("fx_clusters").withColumnRenamed("cluster_id", "candidate_id").withColumn("label", label_binary("final_label"))


def _place(rank: str, test: str, val: str) -> str:
    return f"CASE WHEN {rank} <= {test} THEN 'test' WHEN {rank} <= {test} + {val} THEN 'val' ELSE 'train' END"


BALANCED = f"(SELECT candidate_id, country, row_number() OVER (PARTITION BY country ORDER BY {_u('candidate_id')}, candidate_id) AS r FROM {{}})"


@query("w03_country_balanced_split", f"""WITH c AS (SELECT * FROM {LABELLED} WHERE label >= 0), m AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM c GROUP BY country)), r AS {BALANCED.format('c')}
SELECT candidate_id, {_place('r', 'greatest(1, floor(m.n * 0.15e0))', 'greatest(1, floor(m.n * 0.1e0))')} AS split FROM r, m""")
def _(t):
    return P.country_balanced_split(_candidates(t).where("label >= 0"), 0.1, 0.15).select("candidate_id", "split")


@query("w04_stratified_split", f"""WITH c AS (SELECT * FROM {LABELLED} WHERE label >= 0), r AS (SELECT candidate_id, row_number() OVER (PARTITION BY label ORDER BY {_u('candidate_id')}, candidate_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM c)
SELECT candidate_id, {_place('r', 'greatest(1, floor(n * 0.15e0))', 'greatest(1, floor(n * 0.1e0))')} AS split FROM r""")
def _(t):
    return P.stratified_split(_candidates(t).where("label >= 0"), 0.1, 0.15).select("candidate_id", "split")


@query("w04_stratified_split_with_holdout", f"""WITH c AS (SELECT * FROM {LABELLED} WHERE label >= 0), r AS (SELECT candidate_id, row_number() OVER (PARTITION BY label ORDER BY {_u('candidate_id')}, candidate_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM c)
SELECT candidate_id, {_place('r', 'floor(n * 0.0007e0)', 'floor(n * 0.1e0)')} AS split FROM r""")
def _(t):
    return P.stratified_split(_candidates(t).where("label >= 0"), 0.1, 0.0007, at_least=0).select("candidate_id", "split")


@query("w05_region_split", """
WITH f AS (SELECT ord, id, lower(country) AS country_key, coalesce(state, '') AS state FROM fx_farms),
s AS (SELECT *, state = '' AND country_key IN ('nation_1', 'nation_2') AS wait, CASE WHEN state = '' AND country_key IN ('nation_1', 'nation_2') THEN NULL WHEN state = '' AND country_key IN ('nation_3', 'nation_6', 'nation_9') THEN 'train'
  WHEN state = '' AND country_key IN ('nation_4', 'nation_8') THEN 'val' WHEN state = '' AND country_key IN ('nation_5', 'nation_7') THEN 'test'
  WHEN country_key IN ('nation_5', 'nation_7') OR country_key = 'nation_1' AND state = 'S4' THEN 'test' WHEN country_key IN ('nation_4', 'nation_8') OR country_key = 'nation_2' AND state = 'S2' THEN 'val'
  WHEN country_key IN ('nation_3', 'nation_6', 'nation_9') OR country_key IN ('nation_1', 'nation_2') AND state IN ('S0', 'S1', 'S3') THEN 'train' END AS split FROM f),
n AS (SELECT count(*) FILTER (wait) AS n, count(*) FILTER (split = 'train') AS tr, count(*) FILTER (split = 'val') AS va, count(*) FILTER (split = 'test') AS te FROM s),
q AS (SELECT CASE WHEN te > 0 THEN greatest(1, round_even(n * te / (tr + va + te), 0)) ELSE 0 END AS te, CASE WHEN va > 0 THEN greatest(1, round_even(n * va / (tr + va + te), 0)) ELSE 0 END AS va FROM n),
k AS (SELECT *, row_number() OVER (PARTITION BY wait ORDER BY ord) AS r FROM s)
SELECT id, CASE WHEN wait THEN CASE WHEN r <= te THEN 'test' WHEN r <= te + va THEN 'val' ELSE 'train' END ELSE split END AS split FROM k, q""")
def _(t):
    farms = t("fx_farms").withColumn("country_key", F.lower("country"))
    train = ["nation_3", "nation_6", "nation_9", *[f"nation_{k}/{s}" for k in (1, 2) for s in ("S0", "S1", "S3")]]
    return P.region_split(farms, train, ["nation_4", "nation_8", "nation_2/S2"], ["nation_5", "nation_7", "nation_1/S4"]).select("id", "split")


@query("w06_pool_split", f"""WITH p AS (SELECT id, row_number() OVER (ORDER BY {_u('id')}, id) AS r, count(*) OVER () AS n FROM fx_farms WHERE lower(country) IN ('nation_1', 'nation_2', 'nation_3') OR lower(country) = 'nation_4' AND coalesce(state, '') IN ('', 'S0'))
SELECT id, {_place('r', 'greatest(1, floor(n * 0.15e0))', 'greatest(1, floor(n * 0.1e0))')} AS split FROM p""")
def _(t):
    return P.pool_split(t("fx_farms").withColumn("country_key", F.lower("country")), ["nation_1", "nation_2", "nation_3", "nation_4/S0"], 0.1, 0.15, key="id").select("id", "split")


ISO = "upper(split_part(candidate_id, '_', 1))"


@query("w07_assign_splits", f"""
WITH a AS (SELECT candidate_id, country, label, label_source, {ISO} IN ('NAT3', 'NAT4') AND label <> -1 AS gen, coalesce(eval_set, FALSE) AS ev, label <> -1 AND NOT coalesce(eval_set, FALSE) AND {ISO} IN ('NAT0', 'NAT1', 'NAT2', 'NAT5', 'NAT6', 'NAT7', 'NAT8') AS pool,
  coalesce(viz_status = 'inspected', FALSE) AS insp FROM {LABELLED}),
c AS (SELECT * FROM a WHERE pool AND NOT insp), m AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM c GROUP BY country)), r AS {BALANCED.format('c')},
s AS (SELECT candidate_id, {_place('r', 'greatest(1, floor(m.n * 0.15e0))', 'greatest(1, floor(m.n * 0.1e0))')} AS split FROM r, m)
SELECT candidate_id, CASE WHEN gen THEN 'generalization' WHEN ev THEN 'eval' WHEN NOT pool THEN 'unlabeled' WHEN coalesce(label_source, '') ILIKE '%dmv%' THEN 'train' WHEN insp THEN 'inspected' ELSE split END AS split FROM a LEFT JOIN s USING (candidate_id)""")
def _(t):
    return P.assign_splits(_candidates(t), 0.1, 0.15, ["nat3", "NAT4"], ["NAT0", "NAT1", "NAT2", "NAT5", "NAT6", "NAT7", "NAT8"])


@query("l02_top_k_errors", f"""WITH o AS (SELECT candidate_id, predicted_score, {OUTCOME} AS outcome FROM fx_scored), r AS (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY CASE outcome WHEN 'FP' THEN -predicted_score ELSE predicted_score END, candidate_id) AS k FROM o WHERE outcome IN ('FP', 'FN'))
SELECT candidate_id, predicted_score, outcome FROM r WHERE k <= 20""")
def _(t):
    return N.top_k_errors(t("fx_scored"), 20).select("candidate_id", "predicted_score", "outcome")


@query("l03_sample_cap", f"SELECT building_id FROM (SELECT *, row_number() OVER (ORDER BY {_u('building_id')}, building_id) AS r FROM fx_buildings) WHERE r <= 700")
def _(t):
    return N.sample_cap(t("fx_buildings"), 700, "building_id").select("building_id")


@query("l04_downsample_negatives", f"""WITH c AS (SELECT * FROM {LABELLED}), n AS (SELECT floor(0.5e0 * count(*) FILTER (label = 1)) AS n FROM c), r AS (SELECT candidate_id, row_number() OVER (ORDER BY {_u('candidate_id')}, candidate_id) AS r FROM c WHERE label = 0)
SELECT candidate_id FROM c WHERE label = 1 UNION ALL SELECT candidate_id FROM r, n WHERE r <= n""")
def _(t):
    return N.downsample_negatives(_candidates(t), 0.5, "candidate_id").select("candidate_id")


RURAL = f"""rt AS (SELECT country_key, country, k, min_lon + (max_lon - min_lon) * {_u('country_key', 'k', "'x'")} AS lng, min_lat + (max_lat - min_lat) * {_u('country_key', 'k', "'y'")} AS lat FROM fx_country, range({{n}} * 20) t(k)),
rf AS (SELECT * FROM rt WHERE NOT EXISTS (SELECT 1 FROM fx_farms f WHERE f.country = rt.country AND sqrt(((f.lat - rt.lat) * 111000) ** 2 + ((f.lng - rt.lng) * 111000 * cos(radians(rt.lat))) ** 2) < 5000)),
rn AS (SELECT *, row_number() OVER (PARTITION BY country_key ORDER BY k) - 1 AS n FROM rf), rr AS (SELECT 'neg_' || country_key || '_' || n AS id, lat, lng, 'random_rural' AS source FROM rn WHERE n < {{n}})"""
HARD = f"""hn AS (SELECT country, lat, lng, row_number() OVER (PARTITION BY country ORDER BY ord) - 1 AS i, count(*) OVER (PARTITION BY country) AS size FROM fx_farms WHERE lat IS NOT NULL AND lng IS NOT NULL),
hd AS (SELECT c.*, n, size, floor({_u('country_key', 'n', "'pick'")} * size) AS i, 2 * pi() * {_u('country_key', 'n', "'bearing'")} AS b, 5000 * (1 + 2 * {_u('country_key', 'n', "'far'")}) AS far FROM fx_country c JOIN (SELECT DISTINCT country, size FROM hn) s USING (country), range({{n}}) t(n) WHERE n < size),
hm AS (SELECT d.*, h.lat + far * cos(b) / 111000 AS y, h.lng + far * sin(b) / (111000 * cos(radians(h.lat))) AS x FROM hd d JOIN hn h ON h.country = d.country AND h.i = d.i),
hr AS (SELECT 'hn_' || country_key || '_' || n AS id, y AS lat, x AS lng, 'hard_negative' AS source FROM hm WHERE y BETWEEN min_lat AND max_lat AND x BETWEEN min_lon AND max_lon)"""
OUT = "id, round(lat, 6) AS lat, round(lng, 6) AS lng, source"


def _rounded(df):
    return df.select("id", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), "source")


@query("l05_random_rural_negatives", f"WITH {RURAL.format(n=30)} SELECT {OUT} FROM rr")
def _(t):
    return _rounded(N.random_rural_negatives(t("fx_country"), t("fx_farms"), 30, 5000.0))


@query("l06_hard_negatives", f"WITH {HARD.format(n=30)} SELECT {OUT} FROM hr")
def _(t):
    return _rounded(N.hard_negatives(t("fx_country"), t("fx_farms"), 30, 5000.0))


@query("l07_stratified_negatives", f"WITH {RURAL.format(n=10)}, {HARD.format(n=10)} SELECT {OUT} FROM rr UNION ALL SELECT {OUT} FROM hr")
def _(t):
    return _rounded(N.stratified_negatives(t("fx_country"), t("fx_farms"), 20, 5000.0))


@query("l08_osm_building_negatives", f"""WITH x AS (SELECT * FROM fx_osm_tags o WHERE building IN ('warehouse', 'house', 'yes', 'barn') AND building <> 'barn' AND NOT EXISTS (SELECT 1 FROM fx_farms f WHERE sqrt(((f.lat - o.lat) * 111000) ** 2 + ((f.lng - o.lng) * 111000 * cos(radians(o.lat))) ** 2) < 3000)),
r AS (SELECT *, row_number() OVER (ORDER BY {_u('osm_id')}, osm_id) AS k FROM x) SELECT 'osm_' || osm_id AS id, building AS category FROM r WHERE k <= 200""")
def _(t):
    return N.osm_building_negatives(t("fx_osm_tags"), t("fx_farms"), ["warehouse", "house", "yes", "barn"], 3000.0, 200).select("id", "category")


@query("l09_weighted_sample", f"""WITH r AS (SELECT building_id, floor({_u('building_id')} * 1024)::INT AS b, {_u('building_id')} AS u, area_m2::DECIMAL(38, 6) AS w FROM fx_buildings WHERE area_m2 > 0),
e AS (SELECT building_id, w, sum(w) OVER (ORDER BY b, u, building_id ROWS UNBOUNDED PRECEDING)::DECIMAL(38, 6) AS hi, sum(w) OVER ()::DECIMAL(38, 6) AS total FROM r),
d AS (SELECT k AS draw, ({_u('k', "'draw'")} * (SELECT max(total)::DOUBLE FROM e))::DECIMAL(38, 6) AS x FROM range(5000) t(k))
SELECT building_id, draw FROM d JOIN e ON x >= hi - w AND x < hi""")
def _(t):
    return N.weighted_sample(t("fx_buildings"), 5000, "area_m2", "building_id").select("building_id", "draw")


@query("f02_negative_strategies", f"""WITH {RURAL.format(n=10)}, {HARD.format(n=10)},
ox AS (SELECT * FROM fx_osm_tags o WHERE building IN ('warehouse', 'house', 'yes') AND NOT EXISTS (SELECT 1 FROM fx_farms f WHERE sqrt(((f.lat - o.lat) * 111000) ** 2 + ((f.lng - o.lng) * 111000 * cos(radians(o.lat))) ** 2) < 5000)),
ok AS (SELECT *, row_number() OVER (ORDER BY {_u('osm_id')}, osm_id) AS k FROM ox), fb AS (SELECT building_id, ord % 5 = 0 AS yes FROM fx_buildings), fn AS (SELECT building_id, row_number() OVER (ORDER BY {_u('building_id')}, building_id) AS k FROM fb WHERE NOT yes)
SELECT 'random_rural' AS strategy, id, 0 AS label FROM rr UNION ALL SELECT 'hard_negative', id, 0 FROM hr UNION ALL SELECT 'osm_buildings', 'osm_' || osm_id, 0 FROM ok WHERE k <= 10 * (SELECT count(*) FROM fx_country)
UNION ALL SELECT 'building_footprints', 'bf_' || building_id, 1 FROM fb WHERE yes UNION ALL SELECT 'building_footprints', 'bf_' || building_id, 0 FROM fn WHERE k <= 2 * (SELECT count(*) FROM fb WHERE yes)""")
def _(t):
    marked = t("fx_buildings").select("building_id", "lat", "lng", "country", F.col("country_key").alias("region"), (F.col("ord") % 5 == 0).cast("int").alias("label"))
    more = {"osm_buildings": {"tagged": t("fx_osm_tags"), "kinds": ["warehouse", "house", "yes"]}, "building_footprints": {"footprints": marked, "ratio": 2.0}}
    out = None
    for name in ("random_rural", "hard_negative", "osm_buildings", "building_footprints"):
        rows = N.generate_negatives(name, t("fx_country"), t("fx_farms"), 10, 5000.0, **more.get(name, {})).select(F.lit(name).alias("strategy"), "id", "label")
        out = rows if out is None else out.union(rows)
    return out


@query("l10_gallery_sample", f"SELECT candidate_id, o AS grp FROM (SELECT candidate_id, {OUTCOME} AS o, row_number() OVER (PARTITION BY {OUTCOME} ORDER BY {_u('candidate_id')}, candidate_id) AS r FROM fx_scored) WHERE r <= 12")
def _(t):
    return N.gallery_sample(t("fx_scored"), outcome_class(), 12, "candidate_id").select("candidate_id", F.col("group").alias("grp"))
