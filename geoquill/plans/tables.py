"""Queries that write and read tables, and small filters, unions and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoquill.functions import labels as L
from geoquill.operators import metrics as m
from geoquill.operators import raster as R
from geoquill.operators import spatial as S
from geoquill.operators.lookups import keep_first
from geoquill.plans.flows import _folder
from geoquill.plans.metrics import _binary
from geoquill.plans.registry import query
from geoquill.plans.splits import LABELLED, _candidates
from geoquill.sources import npy, readers, sinks


@query("s02_second_farm_source", "SELECT id, name, lat, lng, species, NULL::VARCHAR AS category, 'OSM' AS source, 'Y' AS country, '' AS state FROM fx_farms WHERE lat IS NOT NULL AND lng IS NOT NULL AND lat <> 0 AND lng <> 0 AND source = 'OSM' AND species IN ('Chickens', 'Ducks')")
def _(t):
    d = t("fx_farms").where("source = 'OSM'").select(F.col("id").alias("Id"), F.col("name").alias("Name"), F.col("lat").alias("Lat"), F.col("lng").alias("Lng"), F.col("species").alias("Species"))
    path = _folder(d.sparkSession, "farms")
    d.write.csv(path, header=True)
    return readers.read_farm_source(d.sparkSession, path, "OSM", "Y", ["Chickens", "Ducks"])


@query("s05_read_clusters", "SELECT cluster_id, final_label FROM fx_clusters")
def _(t):
    d = t("fx_clusters")
    path = _folder(d.sparkSession, "clusters")
    d.select("cluster_id", F.col("final_label").alias("modified_label")).write.parquet(path)
    return readers.read_clusters(d.sparkSession, path)


def _patch_folder(t) -> tuple:
    """The patches as .npy files."""
    d = t("fx_patches").withColumn("candidate_id", F.col("candidate_id").cast("string"))
    path = _folder(d.sparkSession, "npy")
    npy.write_patch_files(d, path)
    return d.sparkSession, path


@query("s08_read_patches", "SELECT CAST(candidate_id AS VARCHAR) AS candidate_id, 4 AS n_channels, 4 AS height, 4 AS width, CAST(CAST(data[1] AS FLOAT) AS DOUBLE) AS first, CAST(CAST(data[64] AS FLOAT) AS DOUBLE) AS last FROM fx_patches")
def _(t):
    return npy.patch_files(*_patch_folder(t)).select("candidate_id", "n_channels", "height", "width", F.get("data", F.lit(0)).cast("double").alias("first"), F.get("data", F.lit(63)).cast("double").alias("last"))


@query("s08_patch_shapes", "SELECT CAST(candidate_id AS VARCHAR) AS candidate_id, 4 * 4 * 4 AS n_values FROM fx_patches")
def _(t):
    shapes = npy.patch_files(*_patch_folder(t), columns=("candidate_id", "n_channels", "height", "width"))  # headers alone
    return shapes.select("candidate_id", (F.col("n_channels") * F.col("height") * F.col("width")).alias("n_values"))


@query("k04_append_registry", "SELECT candidate_id, CASE WHEN ord % 2 = 0 THEN 'h0' ELSE 'h1' END AS imagery_config_hash FROM fx_scored")
def _(t):
    d = t("fx_scored").select("candidate_id", F.when(F.col("ord") % 2 == 0, "h0").otherwise("h1").alias("imagery_config_hash"))
    path = _folder(d.sparkSession, "registry")
    for k in ("h0", "h1"):
        sinks.append_registry(d.where(F.col("imagery_config_hash") == k), path)
    return d.sparkSession.read.parquet(path).select("candidate_id", "imagery_config_hash")


@query("k05_append_failures", "SELECT candidate_id, substr(repeat(candidate_id || '!', 40), 1, 200) AS error FROM fx_scored WHERE ord % 9 = 0")
def _(t):
    d = t("fx_scored").where("ord % 9 = 0").select("candidate_id", F.repeat(F.concat("candidate_id", F.lit("!")), 40).alias("error"))
    path = _folder(d.sparkSession, "failures")
    sinks.append_failures(d, path)
    return d.sparkSession.read.parquet(path)


@query("k07_write_all_farms", "SELECT id, source, lat FROM fx_farms WHERE lat IS NOT NULL AND lat <> 0 AND lng <> 0")
def _(t):
    d = t("fx_farms").where(L.valid_coords())
    path = _folder(d.sparkSession, "all_farms")
    sinks.write_all_farms([d.where("source = 'OSM'"), d.where("source <> 'OSM'")], path)
    return d.sparkSession.read.csv(path, header=True).select("id", "source", F.col("lat").cast("double").alias("lat"))


@query("k08_write_metrics", _binary("split"))
def _(t):
    got = m.binary_metrics(t("fx_scored"), "split")
    path = _folder(got.sparkSession, "metrics")
    sinks.write_metrics(got, path)
    return got.sparkSession.read.schema(got.schema).json(path)


@query("k02_write_read_splits", "SELECT candidate_id, split FROM fx_scored")
def _(t):
    d = t("fx_scored")
    path = _folder(d.sparkSession, "splits")
    sinks.write_splits(d, path)
    return d.sparkSession.read.parquet(path)


@query("p07_region_bounds", """SELECT f.id, coalesce(s.min_lon, c.min_lon) AS min_lon, coalesce(s.min_lat, c.min_lat) AS min_lat, coalesce(s.max_lon, c.max_lon) AS max_lon, coalesce(s.max_lat, c.max_lat) AS max_lat
FROM fx_farms f LEFT JOIN fx_states s ON lower(f.country) = 'nation_1' AND f.state = s.state LEFT JOIN fx_country c ON lower(f.country) = c.country_key""")
def _(t):
    farms = t("fx_farms").select("id", F.lower("country").alias("country_key"), "state")
    return S.region_bounds(farms, t("fx_states"), t("fx_country"), "nation_1").drop("country_key", "state")


@query("p24_area_between", "SELECT building_id FROM fx_buildings WHERE area_m2 BETWEEN 1000 AND 20000")
def _(t):
    return R.detect_footprints(t("fx_buildings"), 1000, 20000, 0.0).select("building_id")


@query("p37_labeled_only", f"SELECT candidate_id, label FROM {LABELLED} WHERE label <> -1")
def _(t):
    return L.labeled_only(_candidates(t)).select("candidate_id", "label")


@query("l01_limit", "SELECT candidate_id FROM fx_scored ORDER BY ord LIMIT 500")
def _(t):
    return t("fx_scored").orderBy("ord").limit(500).select("candidate_id")


@query("l11_ordered_report", "SELECT country, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, country) AS place FROM fx_scored GROUP BY country")
def _(t):
    from pyspark.sql import Window

    g = t("fx_scored").groupBy("country").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "country")))


@query("u01_union_all", "SELECT id, lat, lng, country, species, NULL::DOUBLE AS area_m2 FROM fx_farms UNION ALL SELECT building_id, lat, lng, country, NULL, area_m2 FROM fx_buildings")
def _(t):
    a = t("fx_farms").select("id", "lat", "lng", "country", "species")
    return a.unionByName(t("fx_buildings").select(F.col("building_id").alias("id"), "lat", "lng", "country", "area_m2"), allowMissingColumns=True)


@query("u03_id_sets", "SELECT 'both' AS kind, cluster_id FROM (SELECT cluster_id FROM fx_clusters WHERE eval_set INTERSECT SELECT cluster_id FROM fx_clusters WHERE viz_status = 'inspected') UNION ALL SELECT 'eval only', cluster_id FROM (SELECT cluster_id FROM fx_clusters WHERE eval_set EXCEPT SELECT cluster_id FROM fx_clusters WHERE viz_status = 'inspected')")
def _(t):
    c = t("fx_clusters")
    a, b = c.where("eval_set").select("cluster_id"), c.where("viz_status = 'inspected'").select("cluster_id")
    return a.intersect(b).select(F.lit("both").alias("kind"), "cluster_id").union(a.subtract(b).select(F.lit("eval only").alias("kind"), "cluster_id"))


@query("f01_method_registry", "SELECT 'sar' AS source, tile_id, row, col, median(vv_db) > -12 AS mask FROM fx_pixels GROUP BY tile_id, row, col UNION ALL SELECT 'landcover', tile_id, row, col, arg_min(landcover, (-n) * 100 + landcover) = 6 FROM (SELECT tile_id, row, col, landcover, count(*) AS n FROM fx_pixels GROUP BY ALL) GROUP BY tile_id, row, col")
def _(t):
    parts = [t("fx_pixels").transform(R.METHODS[name]).select(F.lit(name).alias("source"), "tile_id", "row", "col", "mask") for name in ("sar", "landcover")]
    return parts[0].union(parts[1])


@query("ts2_first_arrivals", "SELECT DISTINCT user_id FROM events")
def _(t):
    from geoquill.streaming.scoring import first_arrivals

    events = t("events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    spark, base = events.sparkSession, _folder(events.sparkSession, "arrivals")
    events.write.parquet(f"{base}/in")
    stream = first_arrivals(spark.readStream.schema(events.schema).parquet(f"{base}/in"), "user_id", "ts", "36500 days")
    stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(events.schema).parquet(f"{base}/out").select("user_id")


@query("ts3_retry_failed", "SELECT candidate_id, CASE WHEN ord % 18 = 0 THEN 'no image' END AS error FROM fx_scored WHERE ord % 9 = 0")
def _(t):
    """A run whose ninth of ids fails, then a retry in which half of these fail again."""
    from geoquill.streaming.scoring import resume_scoring, retry_failed

    s = t("fx_scored").select("candidate_id", "ord")
    spark, base = s.sparkSession, _folder(s.sparkSession, "retry")
    s.write.parquet(f"{base}/in")
    score = lambda every: lambda d: d.select("candidate_id", F.when(F.col("ord") % every == 0, "no image").alias("error"))
    resume_scoring(spark.readStream.schema(s.schema).parquet(f"{base}/in"), score(9), f"{base}/registry", f"{base}/failures", "h1", f"{base}/check").awaitTermination()
    return retry_failed(s, score(18), f"{base}/registry", f"{base}/failures", "h1")


@query("s06_patch_registry", "SELECT k AS via, candidate_id, max(ord) AS ord FROM fx_scored, (SELECT unnest(['csv', 'parquet']) AS k) GROUP BY ALL UNION ALL SELECT 'h1', candidate_id, ord FROM fx_scored WHERE ord % 2 = 1")
def _(t):
    d = t("fx_scored").select("candidate_id", "ord", F.concat(F.lit("h"), F.col("ord") % 2).alias("imagery_config_hash"))
    spark, out = d.sparkSession, None
    for kind in ("csv", "parquet"):
        root = _folder(spark, "patches")
        getattr(d.union(d).write.option("header", True), kind)(f"{root}/patch_meta.{kind}")
        meta = readers.read_patch_meta(spark, root)
        rows = keep_first(meta, ["candidate_id"], F.desc("ord")).select(F.lit(kind).alias("via"), "candidate_id", F.col("ord").cast("long").alias("ord"))
        out = rows if out is None else out.union(rows)
    one = readers.read_patch_meta(spark, root, "h1").distinct().select(F.lit("h1").alias("via"), "candidate_id", "ord")
    return out.union(one)


@query("s07_failed_ids", "SELECT candidate_id FROM fx_scored WHERE ord % 9 = 0")
def _(t):
    d = t("fx_scored").where("ord % 9 = 0").select("candidate_id", F.lit("no image").alias("error"))
    spark, root = d.sparkSession, _folder(d.sparkSession, "patches")
    d.union(d).write.csv(f"{root}/failed_patches.csv", header=True)
    return readers.read_failed_ids(spark, root).union(readers.read_failed_ids(spark, f"{root}/none"))


@query("s10_read_splits", "SELECT k AS via, candidate_id, split FROM fx_scored, (SELECT unnest(['own', 'shared']) AS k)")
def _(t):
    d = t("fx_scored").select("candidate_id", "split")
    spark, out = d.sparkSession, None
    for kind, name in (("own", "splits/world.csv"), ("shared", "split_assignments.csv")):
        root = _folder(spark, "patches")
        d.write.csv(f"{root}/{name}", header=True)
        rows = readers.read_splits(spark, root, "world").select(F.lit(kind).alias("via"), "candidate_id", "split")
        out = rows if out is None else out.union(rows)
    return out


@query("s10_read_scored", "SELECT k AS via, candidate_id, predicted_score FROM fx_scored, (SELECT unnest(['own', 'old']) AS k)")
def _(t):
    d = t("fx_scored").select("candidate_id", "predicted_score")
    spark, out = d.sparkSession, None
    for kind in ("own", "old"):
        root = _folder(spark, "output")
        sinks.write_scored(d, f"{root}/world" if kind == "own" else root, "2024-01-01")
        rows = readers.read_scored(spark, root, "world").select(F.lit(kind).alias("via"), "candidate_id", "predicted_score")
        out = rows if out is None else out.union(rows)
    return out


@query("s11_read_metrics_json", _binary("split"))
def _(t):
    got = m.binary_metrics(t("fx_scored"), "split")
    path = _folder(got.sparkSession, "metrics")
    # One indented JSON value over many lines, as metrics files are; a row for each split.
    got.agg(F.to_json(F.collect_list(F.struct(*got.columns)), {"pretty": "true"}).alias("value")).coalesce(1).write.text(path)
    return readers.read_metrics_json(got.sparkSession, path).select(*[F.col(c).cast(k).alias(c) for c, k in got.dtypes])


@query("k09_write_merged_clusters", "SELECT k AS copy, cluster_id, final_label FROM fx_clusters, (SELECT unnest(['current', 'dt=2024-02-03']) AS k)")
def _(t):
    d = t("fx_clusters").select("cluster_id", "final_label")
    path = _folder(d.sparkSession, "merged")
    sinks.write_merged_clusters(d, path, "2024-02-03")
    parts = [d.sparkSession.read.parquet(f"{path}/{k}").select(F.lit(k).alias("copy"), "cluster_id", "final_label") for k in ("current", "dt=2024-02-03")]
    return parts[0].union(parts[1])


@query("p49_normalise_layout", """SELECT CAST(candidate_id AS VARCHAR) AS candidate_id, CAST(CASE candidate_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 4 END AS INT) AS n_channels, CAST(CASE candidate_id % 3 WHEN 2 THEN 4 ELSE 8 END AS INT) AS height,
CAST(CAST(CASE candidate_id % 3 WHEN 0 THEN data[3] ELSE data[2] END AS FLOAT) AS DOUBLE) AS second, CAST(CAST(CASE candidate_id % 3 WHEN 0 THEN data[4] ELSE data[34] END AS FLOAT) AS DOUBLE) AS later FROM fx_patches""")
def _(t):
    import io

    import numpy as np

    def pack(frames):
        for frame in frames:
            out = []
            for i, data in zip(frame["candidate_id"], frame["data"], strict=True):
                a = np.asarray(data, np.float32)
                if i % 3 == 0:
                    a = a.reshape(8, 4, 2)  # (H, W, C)
                elif i % 3 == 1:
                    a = a.reshape(8, 8)
                else:
                    bands = a.reshape(4, 4, 4)
                    a = np.zeros((4, 4), [(f"B{k}", np.float32) for k in range(4)])
                    for k in range(4):
                        a[f"B{k}"] = bands[k]
                sink = io.BytesIO()
                np.save(sink, a)
                out.append(sink.getvalue())
            yield frame[["candidate_id"]].assign(content=out)

    packed = t("fx_patches").select("candidate_id", "data").mapInPandas(pack, "candidate_id long, content binary")
    files = packed.select(F.concat(F.lit("f/"), F.col("candidate_id").cast("string"), F.lit(".npy")).alias("path"), "content")
    return readers.decode_patches(files).select("candidate_id", "n_channels", "height", F.get("data", F.lit(1)).cast("double").alias("second"), F.get("data", F.lit(33)).cast("double").alias("later"))


@query("p06_with_region", "SELECT f.id, c.country_key, CASE WHEN c.country_key IS NULL THEN NULL WHEN coalesce(f.state, '') <> '' THEN c.country_key || '/' || f.state ELSE c.country_key END AS region FROM fx_farms f LEFT JOIN fx_country c ON f.country = c.country")
def _(t):
    return L.with_region(t("fx_farms"), t("fx_country")).select("id", "country_key", "region")


@query("u04_all_regions", "SELECT id FROM fx_farms WHERE lower(country) IN ('nation_1', 'nation_3') OR lower(country) = 'nation_2' AND coalesce(state, '') IN ('', 'S2')")
def _(t):
    regions = L.all_regions(["nation_1", "nation_2/S2"], None, ["nation_3"])
    listed = t("fx_farms").sparkSession.createDataFrame([(r,) for r in regions], "region string").select(L.parse_region("region").alias("r")).select("r.*")
    return L.filter_regions(t("fx_farms").withColumn("country_key", F.lower("country")), listed).select("id")


@query("l11_best_metric_first", "SELECT split, round(avg(predicted_score), 6) AS score, row_number() OVER (ORDER BY round(avg(predicted_score), 6) DESC, split) AS place FROM fx_scored GROUP BY split")
def _(t):
    from pyspark.sql import Window

    g = t("fx_scored").groupBy("split").agg(F.round(F.avg("predicted_score"), 6).alias("score"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "split")))


@query("l11_correct_cells_first", "SELECT true_class, pred_class, count(*) AS n, row_number() OVER (ORDER BY CASE WHEN true_class = pred_class THEN 0 ELSE 1 END, count(*) DESC, true_class, pred_class) AS place FROM fx_multi GROUP BY 1, 2")
def _(t):
    from pyspark.sql import Window

    g = t("fx_multi").groupBy("true_class", "pred_class").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("place", F.row_number().over(Window.orderBy((F.col("true_class") != F.col("pred_class")).cast("int"), F.desc("n"), "true_class", "pred_class")))
