"""Queries on pixels and patches."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoquill.operators import patches as P
from geoquill.operators import raster as R
from geoquill.plans.registry import query
from geoquill.plans.space import greedy

KEPT = "fx_pixels WHERE obs_ts >= '1993-01-01' AND obs_ts < '1998-01-01' AND cloud_pct < 30"
COMPOSITE = f"c AS (SELECT tile_id, row, col, {', '.join(f'median({b}) AS {b}' for b in R.BANDS)} FROM {KEPT} GROUP BY tile_id, row, col)"
INDICES = "i AS (SELECT *, (b8 - b4) / nullif(b8 + b4, 0) AS ndvi, (b11 - b8) / nullif(b11 + b8, 0) AS ndbi, (b3 - b8) / nullif(b3 + b8, 0) AS ndwi, (b3 - b11) / nullif(b3 + b11, 0) AS mndwi, (b4 + b3 + b2) / 3 AS brightness, b11 AS swir FROM c)"


def _composite(t):
    return R.composite_median(t("fx_pixels"), "1993-01-01", "1998-01-01", 30)


@query("a33_composite_median", f"WITH {COMPOSITE} SELECT tile_id, row, col, {', '.join(f'round({b}, 4) AS {b}' for b in R.BANDS)} FROM c")
def _(t):
    return _composite(t).select("tile_id", "row", "col", *[F.round(b, 4).alias(b) for b in R.BANDS])


@query("p18_spectral_indices", f"WITH {COMPOSITE}, {INDICES} SELECT tile_id, row, col, {', '.join(f'round({x}, 6) AS {x}' for x in ('ndvi', 'ndbi', 'ndwi', 'mndwi', 'brightness', 'swir'))} FROM i")
def _(t):
    return R.spectral_indices(_composite(t)).select("tile_id", "row", "col", *[F.round(x, 6).alias(x) for x in ("ndvi", "ndbi", "ndwi", "mndwi", "brightness", "swir")])


@query("p19_mask_ndbi", f"WITH {COMPOSITE}, {INDICES} SELECT tile_id, row, col, coalesce(ndbi > 0.1 AND ndvi < 0.6 AND ndwi < 0.2 AND mndwi < 0.2, FALSE) AS mask FROM i")
def _(t):
    return R.spectral_indices(_composite(t)).select("tile_id", "row", "col", R.mask_ndbi(0.1, 0.6, 0.2).alias("mask"))


@query("p20_mask_metal_roof", f"WITH {COMPOSITE}, {INDICES} SELECT tile_id, row, col, coalesce(brightness > 900 AND ndvi < 0.5 AND swir > 2500 AND mndwi < 0.1, FALSE) AS mask FROM i")
def _(t):
    return R.spectral_indices(_composite(t)).select("tile_id", "row", "col", R.mask_metal_roof(900, 0.5, 2500).alias("mask"))


@query("p21_mask_landcover", "SELECT tile_id, row, col, arg_min(landcover, (-n) * 100 + landcover) = 1 AS mask FROM (SELECT tile_id, row, col, landcover, count(*) AS n FROM fx_pixels GROUP BY ALL) GROUP BY tile_id, row, col")
def _(t):
    return R.mask_landcover(t("fx_pixels"), 1)


@query("p22_mask_sar", "SELECT tile_id, row, col, median(vv_db) > -12 AS mask FROM fx_pixels GROUP BY tile_id, row, col")
def _(t):
    return R.mask_sar(t("fx_pixels"), -12.0)


@query("p23_detect_footprints", "SELECT building_id, greatest(a, b) AS length_m, least(a, b) AS width_m, round(greatest(a, b) / (least(a, b) + 0.001e0), 6) AS aspect_ratio FROM (SELECT *, 10e0 + ord % 90 AS a, 5e0 + ord % 50 AS b FROM fx_buildings WHERE confidence >= 0.6 AND area_m2 BETWEEN 500 AND 40000)")
def _(t):
    b = t("fx_buildings").withColumns({"side_a_m": F.lit(10.0) + F.col("ord") % 90, "side_b_m": F.lit(5.0) + F.col("ord") % 50})
    return R.detect_footprints(b, 500, 40000, 0.6).select("building_id", "length_m", "width_m", F.round("aspect_ratio", 6).alias("aspect_ratio"))


CROSS = "(VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) AS d(di, dj)"
#: CTEs: masks (source, tile_id, row, col, mask) after opening by a disc of radius 1 over the whole map, 10 tiles of 8 by 8 pixels wide; pixels without a row don't count.
OPENED = f"""spot AS (SELECT *, (tile_id // 10) * 8 + row AS gr, (tile_id % 10) * 8 + col AS gc FROM masks),
around AS (SELECT x.source, x.gr, x.gc, y.gr AS nr, y.gc AS nc, y.mask AS m FROM (SELECT *, gr + di AS hr, gc + dj AS hc FROM spot, {CROSS}) x JOIN spot y ON y.source = x.source AND y.gr = x.hr AND y.gc = x.hc),
left_ AS (SELECT source, gr, gc FROM around GROUP BY ALL HAVING bool_and(m)),
grown AS (SELECT DISTINCT a.source, a.gr, a.gc FROM around a JOIN left_ e ON e.source = a.source AND e.gr = nr AND e.gc = nc),
opened AS (SELECT m.source, m.tile_id, m.row, m.col, g.gr IS NOT NULL AS mask FROM spot m LEFT JOIN grown g USING (source, gr, gc))"""


def components(masks: str) -> str:
    """CTEs px (true pixels of the masks with their place on the whole map) and comp (source, p, component: the least pixel of its 8-connected part)."""
    return f"""px AS (SELECT source, tile_id, row, col, (tile_id // 10) * 8 + row AS gr, (tile_id % 10) * 8 + col AS gc, ((tile_id // 10) * 8 + row) * 80 + (tile_id % 10) * 8 + col AS p FROM {masks} WHERE mask),
near AS (SELECT a.source, a.p AS a, b.p AS b FROM px a JOIN px b ON a.source = b.source AND b.gr BETWEEN a.gr - 1 AND a.gr + 1 AND b.gc BETWEEN a.gc - 1 AND a.gc + 1 AND a.p <> b.p),
reach AS (SELECT source, p AS s, p AS t FROM px UNION SELECT r.source, r.s, n.b FROM reach r JOIN near n ON n.source = r.source AND n.a = r.t AND n.b > -1),
comp AS (SELECT source, s AS p, min(t) AS component FROM reach GROUP BY ALL)"""


def geometry(cell: float) -> str:
    """CTE shapes: geometry of each component."""
    return f"""sides AS (SELECT source, component, count(*) AS n_pixels, (max(gr) - min(gr) + 1) * {cell}::DOUBLE * 111000e0 AS h, (max(gc) - min(gc) + 1) * {cell}::DOUBLE * 111000e0 * 0.9e0 AS w,
  -60e0 + (avg(gc) + 0.5e0) * {cell}::DOUBLE AS centroid_lon, -30e0 + (avg(gr) + 0.5e0) * {cell}::DOUBLE AS centroid_lat FROM px JOIN comp USING (source, p) GROUP BY ALL),
shapes AS (SELECT source, component, n_pixels, n_pixels * ({cell}::DOUBLE * 111000e0) ** 2 * 0.9e0 AS area_m2, greatest(h, w) AS length_m, least(h, w) AS width_m, greatest(h, w) / greatest(least(h, w), 0.1e0) AS aspect_ratio, centroid_lon, centroid_lat FROM sides)"""


def _sar(limit: float) -> str:
    return f"masks AS (SELECT 'sar' AS source, tile_id, row, col, median(vv_db) > {limit} AS mask FROM fx_pixels GROUP BY ALL)"


@query("p26_morphological_open", f"WITH {_sar(-10)}, {OPENED} SELECT tile_id, row, col, mask FROM opened")
def _(t):
    return R.morphological_open(R.mask_sar(t("fx_pixels"), -10.0), 1, (8, 8), 10)


@query("p27_vectorize_mask", f"WITH RECURSIVE {_sar(-9)}, {components('masks')} SELECT tile_id, row, col, component FROM px JOIN comp USING (source, p)")
def _(t):
    return R.vectorize_mask(R.mask_sar(t("fx_pixels"), -9.0), 8, 8, 10).select("tile_id", "row", "col", "component")


SHAPE = ("component", "n_pixels", "area_m2", "length_m", "width_m", "aspect_ratio", "centroid_lon", "centroid_lat")
SHAPE_SQL = "component, n_pixels, round(area_m2, 4) AS area_m2, round(length_m, 4) AS length_m, round(width_m, 4) AS width_m, round(aspect_ratio, 4) AS aspect_ratio, round(centroid_lon, 8) AS centroid_lon, round(centroid_lat, 8) AS centroid_lat"


def _shape(df, *more):
    digits = {"area_m2": 4, "length_m": 4, "width_m": 4, "aspect_ratio": 4, "centroid_lon": 8, "centroid_lat": 8}
    return df.select(*more, *[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in SHAPE])


@query("p25_geometry_properties", f"WITH RECURSIVE {_sar(-9)}, {components('masks')}, {geometry(1e-3)} SELECT {SHAPE_SQL} FROM shapes")
def _(t):
    found = R.vectorize_mask(R.mask_sar(t("fx_pixels"), -9.0), 8, 8, 10)
    return _shape(R.geometry_properties(found, 1e-3, (-60.0, -30.0), 0.9))


#: u09: optical and radar masks of the whole map, opened, with at most two detections of a tile and method.
TILE_OPTIONS = {"metal_roof": {"start": "1993-01-01", "end": "1998-01-01", "max_cloud": 30, "bright": 900, "green": 0.5, "swir": 2500}, "sar": {"threshold": -8.5}}


@query("u09_run_tiles", f"""WITH RECURSIVE {COMPOSITE}, {INDICES}, masks AS (SELECT 'metal_roof' AS source, tile_id, row, col, coalesce(brightness > 900 AND ndvi < 0.5 AND swir > 2500 AND mndwi < 0.1, FALSE) AS mask FROM i
  UNION ALL SELECT 'sar', tile_id, row, col, median(vv_db) > -8.5 FROM fx_pixels GROUP BY ALL
  UNION ALL SELECT 'landcover', tile_id, row, col, arg_min(landcover, (-n) * 100 + landcover) = 6 FROM (SELECT tile_id, row, col, landcover, count(*) AS n FROM fx_pixels GROUP BY ALL) GROUP BY ALL),
{OPENED}, {components('opened')}, {geometry(1e-4)},
tiled AS (SELECT *, floor((centroid_lat + 30) / (1e-4::DOUBLE * 8)) * 10 + floor((centroid_lon + 60) / (1e-4::DOUBLE * 8)) AS tile FROM shapes WHERE area_m2 >= 100),
capped AS (SELECT *, centroid_lat AS lat, centroid_lon AS lng, CASE source WHEN 'landcover' THEN 2199023255552 WHEN 'sar' THEN 1099511627776 ELSE 0 END + component AS ord FROM (SELECT *, row_number() OVER (PARTITION BY source, tile ORDER BY component) AS k FROM tiled) WHERE k <= 2),
{{greedy}} SELECT source, {SHAPE_SQL} FROM capped SEMI JOIN kept USING (ord)""".format(greedy=greedy("capped", 30e0)))
def _(t):
    got = R.run_tiles(t("fx_pixels"), ["metal_roof", "sar", "landcover"], (8, 8), 10, 1e-4, (-60.0, -30.0), 0.9, 1, 100.0, cap=2, dedup_m=30.0, options=TILE_OPTIONS)
    return _shape(got, "source")


@query("p28_channel_subset", "SELECT candidate_id, round(list_sum(list_transform(data[33:48], lambda x: CAST(x AS DOUBLE))), 6) AS first, round(list_sum(list_transform(data[1:16], lambda x: CAST(x AS DOUBLE))), 6) AS second FROM fx_patches")
def _(t):
    places, _ = P.channel_subset(["B4", "B2"], ["B2", "B3", "B4"], ["NDWI"])
    total = lambda a, n: F.round(F.aggregate(F.slice("data", a, n), F.lit(0.0), lambda s, x: s + x.cast("double")), 6)
    return P.take_channels(t("fx_patches"), places).select("candidate_id", total(1, 16).alias("first"), total(17, 16).alias("second"))


@query("p29_centre_crop", "SELECT candidate_id, CAST(data[6] AS DOUBLE) AS a, CAST(data[11] AS DOUBLE) AS b, CAST(data[59] AS DOUBLE) AS z, 16 AS n FROM fx_patches")
def _(t):
    d = P.centre_crop(t("fx_patches"), 2)
    at = lambda k: F.get("data", F.lit(k)).cast("double")
    return d.select("candidate_id", at(0).alias("a"), at(3).alias("b"), at(15).alias("z"), F.size("data").alias("n"))


@query("p30_scale_patch", "SELECT candidate_id, CAST(data[1] AS DOUBLE) / 10000e0 AS a, CAST(data[48] AS DOUBLE) / 10000e0 AS b, CAST(data[49] AS DOUBLE) AS c FROM fx_patches")
def _(t):
    d = t("fx_patches").withColumn("data", F.col("data").cast("array<double>")).withColumn("data", P.scale_patch(3))
    at = lambda k: F.get("data", F.lit(k))
    return d.select("candidate_id", at(0).alias("a"), at(47).alias("b"), at(48).alias("c"))


@query("p31_augment_patches")
def _(t):
    d = t("fx_patches").withColumn("data", F.transform("data", lambda x: x.cast("float")))
    return P.augment_patches(d, P.Augment(rotate_deg=15, crop=(0.7, 1.0), brightness=0.1, band_jitter=0.05, noise=0.01, channel_dropout=0.1, cutout=2), 42)


def _drawn(name: str) -> str:
    return f"(('0x' || substr(md5(candidate_id || ':3:{name}:7'), 1, 8))::BIGINT / 4294967296e0)"


def _bilinear(values: str, y: str, x: str) -> str:
    """Values of 4 by 4 pixels of the channel of place p at (y, x), lists of clipped places; list comprehension over p."""
    at = lambda i, j: f"{values}[((p // 16) * 16 + {i} * 4 + {j} + 1)::BIGINT]"
    i, j, fy, fx = f"floor({y}[p + 1])::INT", f"floor({x}[p + 1])::INT", f"({y}[p + 1] - floor({y}[p + 1]))", f"({x}[p + 1] - floor({x}[p + 1]))"
    k, n = f"least({i} + 1, 3)", f"least({j} + 1, 3)"
    return f"list_transform(range(64), lambda p: ({at(i, j)} * (1 - {fx}) + {at(i, n)} * {fx}) * (1 - {fy}) + ({at(k, j)} * (1 - {fx}) + {at(k, n)} * {fx}) * {fy})"


def _places(y: str, x: str) -> str:
    grid = lambda e: f"list_transform(range(64), lambda p: least(greatest({e}, 0e0), 3e0))"
    return f"{grid(y)} AS y, {grid(x)} AS x"


I, J = "((p % 16) // 4)", "(p % 4)"
R_SQL = f"CASE k WHEN 0 THEN {I} WHEN 1 THEN {J} WHEN 2 THEN 3 - {I} ELSE 3 - {J} END"
Q_SQL = f"CASE k WHEN 0 THEN {J} WHEN 1 THEN 3 - {I} WHEN 2 THEN 3 - {J} ELSE {I} END"


@query("p31_augment_drawn", f"""
WITH d AS (SELECT candidate_id, list_transform(data, lambda v: v::FLOAT::DOUBLE) AS a, {_drawn('h_flip')} < 0.5 AS hf, {_drawn('v_flip')} < 0.5 AS vf, floor({_drawn('rot90')} * 4)::INT AS k, radians(-15e0 + 30e0 * {_drawn('rotate')}) AS t,
  0.7e0 + (1.0e0 - 0.7e0) * {_drawn('crop')} AS s, 1 + (-0.1e0 + 0.2e0 * {_drawn('brightness')}) AS br, [{', '.join(f"1 + (-0.05e0 + 0.1e0 * {_drawn(f'jitter{k}')})" for k in range(3))}, 1e0] AS jit, [{', '.join(f"{_drawn(f'drop{k}')} < 0.1" for k in range(4))}] AS dropped,
  floor({_drawn('cut_y')} * 4)::INT AS cy, floor({_drawn('cut_x')} * 4)::INT AS cx, {_drawn('crop_y')} AS uy, {_drawn('crop_x')} AS ux FROM fx_patches),
f AS (SELECT *, list_transform(range(64), lambda p: a[((p // 16) * 16 + (CASE WHEN vf THEN 3 - ({R_SQL}) ELSE {R_SQL} END) * 4 + (CASE WHEN hf THEN 3 - ({Q_SQL}) ELSE {Q_SQL} END) + 1)::BIGINT]) AS b FROM d),
g AS (SELECT *, {_places(f"({I} - 1.5e0) * cos(t) - ({J} - 1.5e0) * sin(t) + 1.5e0", f"({I} - 1.5e0) * sin(t) + ({J} - 1.5e0) * cos(t) + 1.5e0")} FROM f),
h AS (SELECT * EXCLUDE (y, x), {_bilinear('b', 'y', 'x')} AS e FROM g), i AS (SELECT *, {_places(f"uy * (1 - s) * 3 + {I} * s", f"ux * (1 - s) * 3 + {J} * s")} FROM h), m AS (SELECT *, {_bilinear('e', 'y', 'x')} AS o FROM i),
n AS (SELECT candidate_id, unnest(range(64)) AS p, unnest(list_transform(range(64), lambda p: CASE WHEN dropped[p // 16 + 1] OR ({I} BETWEEN cy AND cy + 1 AND {J} BETWEEN cx AND cx + 1) THEN 0e0
  ELSE least(greatest(o[p + 1] * CASE WHEN p // 16 < 3 THEN br * jit[p // 16 + 1] ELSE 1e0 END, CASE WHEN p // 16 < 3 THEN 0e0 ELSE -1e0 END), 1e0) END)) AS v FROM m)
SELECT candidate_id, p::INT AS place, round(v::FLOAT::DOUBLE, 5) AS value FROM n""")
def _(t):
    """Flips, turns, rotation, crop, brightness, jitter, dropout and cutout; their draws are hashes that SQL can make too."""
    how = P.Augment(rotate_deg=15, crop=(0.7, 1.0), brightness=0.1, band_jitter=0.05, channel_dropout=0.1, cutout=2)
    return P.augment_patches(t("fx_patches"), how, 7, 3).select("candidate_id", F.posexplode("data").alias("place", "v")).select("candidate_id", "place", F.round(F.col("v").cast("double"), 5).alias("value"))


@query("p32_clear_fraction", "SELECT candidate_id, round(1 - len(list_filter(data, lambda x: x < 0)) / 64e0, 4) AS clear FROM fx_patches")
def _(t):
    d = t("fx_patches").withColumn("data", F.transform("data", lambda x: F.when(x < 0, F.lit(float("nan"))).otherwise(x)))
    return d.select("candidate_id", P.clear_fraction().alias("clear"))


@query("p33_utm_grid", "SELECT building_id, CAST(CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + floor((lng + 180) / 6) + 1 AS INT) AS epsg, round(lng - 640e0 / 2 / 111000, 6) AS min_lon, round(lat + 640e0 / 2 / 111000, 6) AS max_lat FROM fx_buildings")
def _(t):
    return t("fx_buildings").select("building_id", P.utm_grid()["epsg"].alias("epsg"), P.patch_bbox(640.0).alias("b")).select("building_id", "epsg", F.round("b.min_lon", 6).alias("min_lon"), F.round("b.max_lat", 6).alias("max_lat"))


HASH = P.config_hash({"size": 64, "bands": ["B2", "B3", "B4"]})
HASH_SQL = """substr(sha256('{"bands": ["B2", "B3", "B4"], "size": 64}'), 1, 12)"""


@query("p34_patch_path", f"SELECT id, coalesce(nullif(country, ''), '_') || '/' || coalesce(nullif(state, ''), '_') || '/' || {HASH_SQL} || '/' || id || '.npy' AS path FROM fx_farms")
def _(t):
    return t("fx_farms").withColumn("candidate_id", F.col("id")).select("id", P.patch_path(HASH).alias("path"))


@query("p35_row_hash", "SELECT candidate_id, substr(sha256(candidate_id || ':' || country), 1, 12) AS h FROM fx_scored")
def _(t):
    return t("fx_scored").select("candidate_id", F.substring(F.sha2(F.concat_ws(":", "candidate_id", "country"), 256), 1, 12).alias("h"))


@query("p35_config_hash", f"SELECT candidate_id, {HASH_SQL} AS patches, substr(sha256('{{\"cache\": true}}'), 1, 16) AS cache FROM fx_scored")
def _(t):
    return t("fx_scored").select("candidate_id", F.lit(HASH).alias("patches"), F.lit(P.config_hash({"cache": True}, 16)).alias("cache"))


@query("p36_same_imagery", f"SELECT candidate_id FROM (SELECT candidate_id, CASE WHEN ord % 3 = 0 THEN '{HASH}' ELSE 'other' END AS h FROM fx_scored) WHERE h = '{HASH}'")
def _(t):
    reg = t("fx_scored").withColumn("imagery_config_hash", F.when(F.col("ord") % 3 == 0, HASH).otherwise("other"))
    return P.same_imagery(reg, HASH).select("candidate_id")


@query("p48_band_stack", "SELECT candidate_id, 8 AS n_channels, len(data) * 2 AS n FROM fx_patches")
def _(t):
    d = t("fx_patches")
    return P.band_stack(d, d).select("candidate_id", "n_channels", F.size("data").alias("n"))


@query("a23_band_stats", """
WITH m AS (SELECT candidate_id, label, k AS channel, list_avg(list_transform(data[k * 16 + 1:k * 16 + 16], lambda x: CAST(x AS DOUBLE))) AS mean FROM fx_patches, range(4) r(k))
SELECT label, CAST(channel AS INT) AS channel, count(*) AS n, round(avg(mean), 6) AS mean, round(stddev_pop(mean), 6) AS std FROM m GROUP BY 1, 2""")
def _(t):
    d = t("fx_patches")
    return P.band_stats(P.band_means(d), d.select("candidate_id", "label"), "label")


WEIGHTS = [[1, -1], [-2, 2], [0.5, -0.5], [3, -3]]


@query("f04_score_candidates", """
WITH m AS (SELECT candidate_id, [list_avg(list_transform(data[k * 16 + 1:k * 16 + 16], lambda x: CAST(CAST(x AS FLOAT) AS DOUBLE))) FOR k IN range(4)] AS c, label % 4 - 1 AS y FROM fx_patches),
z AS (SELECT candidate_id, y, c[1] - 2 * c[2] + 0.5e0 * c[3] + 3 * c[4] AS z FROM m WHERE label_known), p AS (SELECT candidate_id, y, 1 / (1 + exp(2 * z)) AS s FROM z)
SELECT candidate_id, round(s, 5) AS predicted_score, CAST(s >= 0.5 AS INT) AS predicted_label, CASE WHEN s >= 0.9 THEN 'high' WHEN s >= 0.7 THEN 'medium' WHEN s >= 0.5 THEN 'low' ELSE 'very_low' END AS confidence_tier,
CAST(y AS INT) AS true_label, CASE WHEN candidate_id % 3 = 0 THEN 'unknown' ELSE 'test' END AS split FROM p""".replace("WHERE label_known", "WHERE y <> -1"))
def _(t):
    from geoquill.plans.flows import _folder
    from geoquill.sources import readers

    d = t("fx_patches")
    spark = d.sparkSession
    path, root = _folder(spark, "model"), _folder(spark, "patches")
    P.LinearScorer(WEIGHTS).save(spark, path)
    d.where("candidate_id % 3 <> 0").select("candidate_id", F.lit("test").alias("split")).write.csv(f"{root}/split_assignments.csv", header=True)
    candidates = d.select("candidate_id", (F.col("label") % 4 - 1).cast("int").alias("label"), F.lit("x").alias("country"), F.col("candidate_id").alias("ord"))
    splits = readers.read_splits(spark, root, "world").withColumn("candidate_id", F.col("candidate_id").cast("long"))
    got = P.scored_candidates(d, P.LinearScorer.read(spark, path), candidates, splits, labelled=True)
    return got.select("candidate_id", F.round("predicted_score", 5).alias("predicted_score"), "predicted_label", "confidence_tier", "true_label", "split")


@query("f05_fit_patch_classifier")
def _(t):
    """Three classes: fits on the training slice with class and region weights, stops by the validation slice, saves and loads the model, and rates it on the slices held out, and by country."""
    from geoquill.operators import training
    from geoquill.plans.flows import _folder

    d = t("fx_patches")
    slices = F.when(F.col("candidate_id") % 7 < 4, "train").when(F.col("candidate_id") % 7 == 4, "val").when(F.col("candidate_id") % 7 == 5, "test").otherwise("eval")
    labels = d.select("candidate_id", (F.col("label") % 3).alias("label"), slices.alias("split"), F.concat(F.lit("c"), F.col("candidate_id") % 3).alias("country"))
    path = _folder(d.sparkSession, "classifier")
    training.fit_patches(d, labels, training.Training(epochs=12, batches=2, patience=3, region_weighted=True)).save(d.sparkSession, path)
    held = labels.where(F.col("split").isin("test", "eval"))
    return training.slice_rates(training.predictions(training.PatchModel.read(d.sparkSession, path), d, held))


@query("f03_imagery_providers", """
WITH s AS (SELECT tile_id, row, col, median(b4) AS b4, median(b8) AS b8, median(b11) AS b11 FROM fx_pixels WHERE obs_ts >= '1994-01-01' AND obs_ts < '1997-01-01' AND cloud_pct < 40 GROUP BY ALL), r AS (SELECT tile_id, row, col, median(vv_db) AS vv_db FROM fx_pixels GROUP BY ALL)
SELECT tile_id, row, col, round(b4, 6) AS b4, round(b8, 6) AS b8, round((b8 - b4) / nullif(b8 + b4, 0), 6) AS ndvi, round(vv_db, 6) AS vv_db FROM s FULL JOIN r USING (tile_id, row, col)""")
def _(t):
    got = R.imagery(t("fx_pixels"), [{"bands": ["b4", "b8"], "indices": ["ndvi"], "date_range": ("1994-01-01", "1997-01-01"), "max_cloud_cover": 40}, {"provider": "earth_engine_s1"}])
    return got.select("tile_id", "row", "col", *[F.round(c, 6).alias(c) for c in ("b4", "b8", "ndvi", "vv_db")])


@query("f03_footprint_providers", """
WITH b AS (SELECT *, substr(country_key, 8) AS iso_code FROM fx_buildings), c AS (SELECT DISTINCT iso_code FROM b WHERE TRY_CAST(iso_code AS INT) % 3 = 0)
SELECT 'google_open_buildings' AS name, building_id FROM b WHERE provider = 'google_open_buildings' AND confidence >= 0.65 UNION ALL SELECT 'ms_buildings', building_id FROM b WHERE provider = 'ms_buildings'
UNION ALL SELECT 'auto', building_id FROM b WHERE CASE WHEN iso_code IN (SELECT iso_code FROM c) THEN provider = 'google_open_buildings' AND confidence >= 0.65 ELSE provider = 'ms_buildings' END""")
def _(t):
    from geoquill.sources import readers

    b = t("fx_buildings").withColumn("iso_code", F.substring("country_key", 8, 9))
    coverage = b.select("iso_code").distinct().where(F.expr("try_cast(iso_code AS int) % 3 = 0"))
    out = None
    for name in readers.FOOTPRINT_PROVIDERS:
        rows = readers.footprints(name, b, coverage).select(F.lit(name).alias("name"), "building_id")
        out = rows if out is None else out.union(rows)
    return out
