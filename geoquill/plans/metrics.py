"""Queries on the quality of scored candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoquill.operators import metrics as m
from geoquill.plans.registry import query

COUNTS = "count(*) FILTER (true_label = 1 AND predicted_score >= 0.5) AS tp, count(*) FILTER (true_label = 0 AND predicted_score >= 0.5) AS fp, count(*) FILTER (true_label = 1 AND predicted_score < 0.5) AS fn, count(*) FILTER (true_label = 0 AND predicted_score < 0.5) AS tn"
RATES = "round((tp + tn) / greatest(tp + fp + fn + tn, 1e0), 4) AS accuracy, round(p, 4) AS precision, round(r, 4) AS recall, round(2 * p * r / greatest(p + r, 1e-8), 4) AS f1"
PR = "tp / greatest(tp + fp, 1e0) AS p, tp / greatest(tp + fn, 1e0) AS r"
OUTCOME = "CASE true_label WHEN 1 THEN CASE WHEN predicted_score >= 0.5 THEN 'TP' ELSE 'FN' END WHEN 0 THEN CASE WHEN predicted_score >= 0.5 THEN 'FP' ELSE 'TN' END ELSE CASE WHEN predicted_score >= 0.5 THEN 'UP' ELSE 'UN' END END"


def _binary(keys: str, source: str = "fx_scored WHERE true_label IN (0, 1)") -> str:
    k = f"{keys}, " if keys else ""
    return f"SELECT {k}tp, fp, fn, tn, {RATES} FROM (SELECT *, {PR} FROM (SELECT {k}{COUNTS} FROM {source} {'GROUP BY ' + keys if keys else ''}))"


def _curve(keys: str, source: str, score: str = "predicted_score") -> str:
    """Common table expression `c` of a curve."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""g AS (SELECT {k}{score} AS score, count(*) FILTER (true_label = 1) AS p, count(*) FILTER (true_label = 0) AS n FROM {source} GROUP BY {k}{score}),
c AS (SELECT *, sum(p) OVER ({part} ORDER BY score DESC) AS tp, sum(n) OVER ({part} ORDER BY score DESC) AS fp, sum(p) OVER ({part}) AS pos, sum(n) OVER ({part}) AS neg FROM g)"""


AREAS = "round(sum(p * (neg - fp + n / 2)) / max(pos * neg), 6) AS roc_auc, round(sum(p / pos * tp / (tp + fp)), 6) AS average_precision"


@query("p40_outcome_class", f"SELECT candidate_id, {OUTCOME} AS outcome FROM fx_scored")
def _(t):
    return t("fx_scored").select("candidate_id", m.outcome_class().alias("outcome"))


@query("a01_confusion_counts", f"SELECT {COUNTS} FROM fx_scored")
def _(t):
    return t("fx_scored").agg(*m.counts())


@query("a02_binary_metrics", _binary(""))
def _(t):
    return m.binary_metrics(t("fx_scored"))


@query("a03_multiclass_metrics", """
WITH s AS (SELECT true_class AS class, CAST(true_class = pred_class AS INT) AS hit, 1 AS t, 0 AS p FROM fx_multi UNION ALL SELECT pred_class, 0, 0, 1 FROM fx_multi),
k AS (SELECT class, sum(hit) AS tp, sum(t) AS nt, sum(p) AS np FROM s GROUP BY class)
SELECT round(sum(tp) / sum(nt), 4) AS accuracy, round(avg(CASE WHEN np > 0 THEN tp / np ELSE 0 END), 4) AS precision, round(avg(CASE WHEN nt > 0 THEN tp / nt ELSE 0 END), 4) AS recall,
       round(avg(2 * tp / (nt + np)), 4) AS f1, count(*) AS n_classes FROM k""")
def _(t):
    return m.multiclass_metrics(t("fx_multi"))


@query("a04_metrics_by_split", f"""
WITH s AS (SELECT * FROM (VALUES ('train', 0), ('val', 1), ('test', 2), ('inspected', 3), ('eval', 4), ('generalization', 5)) v(split, place)),
g AS (SELECT split, {COUNTS} FROM fx_scored WHERE true_label IN (0, 1) GROUP BY split),
j AS (SELECT s.split, CAST(place AS INT) AS place, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, coalesce(tn, 0) AS tn FROM s LEFT JOIN g USING (split))
SELECT split, place, tp, fp, fn, tn, {RATES} FROM (SELECT *, {PR} FROM j)""")
def _(t):
    return m.metrics_by_split(t("fx_scored"))


@query("a05_metrics_by_country", f"""
SELECT country, n, tp, fp, fn, tn, up, un, {RATES} FROM (SELECT *, {PR} FROM (SELECT country, count(*) AS n, {COUNTS},
  count(*) FILTER (true_label NOT IN (0, 1) AND predicted_score >= 0.5) AS up, count(*) FILTER (true_label NOT IN (0, 1) AND predicted_score < 0.5) AS un FROM fx_scored GROUP BY country))""")
def _(t):
    return m.metrics_by_country(t("fx_scored"))


@query("a06_metrics_by_label", _binary("final_label"))
def _(t):
    return m.binary_metrics(t("fx_scored"), "final_label")


@query("a07_confusion_matrix", """
WITH c AS (SELECT true_class, pred_class, count(*) AS n FROM fx_multi GROUP BY CUBE (true_class, pred_class))
SELECT true_class, pred_class, n, round(n / max(n) OVER (PARTITION BY true_class), 6) AS row_share FROM c""")
def _(t):
    return m.confusion_matrix(t("fx_multi"))


@query("a08_classification_report", """
WITH s AS (SELECT true_class AS class, CAST(true_class = pred_class AS INT) AS hit, 1 AS t, 0 AS p FROM fx_multi UNION ALL SELECT pred_class, 0, 0, 1 FROM fx_multi),
k AS (SELECT class, sum(hit) AS tp, sum(t) AS nt, sum(p) AS np FROM s GROUP BY class),
r AS (SELECT class, CASE WHEN np > 0 THEN tp / np ELSE 0 END AS precision, CASE WHEN nt > 0 THEN tp / nt ELSE 0 END AS recall, 2 * tp / (nt + np) AS f1, nt AS support FROM k)
SELECT CAST(class AS VARCHAR) AS class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM r
UNION ALL SELECT 'macro', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM r
UNION ALL SELECT 'weighted', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM r""")
def _(t):
    return m.classification_report(t("fx_multi"))


@query("a09_crosstab", f"SELECT country, {', '.join(f'count(*) FILTER (o = {chr(39)}{k}{chr(39)}) AS {k}' for k in ('TP', 'FP', 'FN', 'TN', 'UP', 'UN'))} FROM (SELECT country, {OUTCOME} AS o FROM fx_scored) GROUP BY country")
def _(t):
    return m.crosstab(t("fx_scored"), "country", m.outcome_class(), ("TP", "FP", "FN", "TN", "UP", "UN"))


@query("a10_composition", "SELECT final_label, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM fx_clusters GROUP BY final_label")
def _(t):
    return m.composition(t("fx_clusters"), "final_label")


@query("a11_score_stats", """SELECT true_label, count(template_score_if) AS n, round(avg(template_score_if), 6) AS mean, round(stddev_samp(template_score_if), 6) AS std,
round(quantile_cont(template_score_if, 0.25), 6) AS q25, round(quantile_cont(template_score_if, 0.5), 6) AS median, round(quantile_cont(template_score_if, 0.75), 6) AS q75 FROM fx_scored GROUP BY true_label""")
def _(t):
    return m.score_stats(t("fx_scored"), "true_label", "template_score_if")


@query("a12_outcome_medians", f"""
WITH o AS (SELECT country, {OUTCOME} AS outcome, predicted_score FROM fx_scored)
SELECT country, outcome, count(*) AS n, round(median(predicted_score), 6) AS median_score FROM o GROUP BY country, outcome
UNION ALL SELECT 'ALL', outcome, count(*), round(median(predicted_score), 6) FROM o GROUP BY outcome""")
def _(t):
    return m.outcome_medians(t("fx_scored"))


@query("a12_medians_by_type", f"""
WITH o AS (SELECT coalesce(final_label, 'ALL') AS final_label, {OUTCOME} AS outcome, predicted_score FROM fx_scored)
SELECT final_label, outcome, count(*) AS n, round(median(predicted_score), 6) AS median_score FROM (SELECT * FROM o UNION ALL SELECT 'ALL', outcome, predicted_score FROM o) GROUP BY final_label, outcome""")
def _(t):
    return m.outcome_medians(t("fx_scored"), "final_label")


@query("a12_medians_by_type_and_country", f"""
WITH o AS (SELECT coalesce(final_label, 'ALL') AS final_label, country, {OUTCOME} AS outcome, predicted_score FROM fx_scored)
SELECT final_label, country, outcome, count(*) AS n, round(median(predicted_score), 6) AS median_score FROM (SELECT * FROM o UNION ALL SELECT 'ALL', 'ALL', outcome, predicted_score FROM o) GROUP BY final_label, country, outcome""")
def _(t):
    return m.outcome_medians(t("fx_scored"), "final_label", "country")


@query("a13_roc_auc", f"WITH {_curve('', 'fx_scored WHERE true_label IN (0, 1)')} SELECT {AREAS} FROM c")
def _(t):
    return m.auc(m.known(t("fx_scored")))


@query("a13_roc_curve", f"WITH {_curve('', 'fx_scored WHERE true_label IN (0, 1)')} SELECT score, round(fp / neg, 6) AS fpr, round(tp / pos, 6) AS tpr FROM c")
def _(t):
    return m.roc_curve(m.known(t("fx_scored")))


@query("a14_pr_curve", f"WITH {_curve('', 'fx_scored WHERE true_label IN (0, 1)')} SELECT score, round(tp / (tp + fp), 6) AS precision, round(tp / pos, 6) AS recall FROM c")
def _(t):
    return m.pr_curve(m.known(t("fx_scored"))).select("score", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("a15_precision_at_recall", f"""
WITH {_curve('', 'fx_scored WHERE true_label IN (0, 1)')}, pts AS (SELECT score, tp / (tp + fp) AS precision, tp / pos AS recall FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY goal ORDER BY abs(recall - goal), score) AS k FROM pts, (VALUES (0.99e0), (0.95e0), (0.9e0)) v(goal))
SELECT goal, score AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM r WHERE k = 1""")
def _(t):
    return m.precision_at_recall(m.known(t("fx_scored")))


@query("a16_weight_sweep", f"""
WITH e AS (SELECT min(template_score_if) AS lo, max(template_score_if) AS hi FROM fx_scored WHERE true_label IN (0, 1)),
x AS (SELECT w, true_label, w * ((template_score_if - lo) / (hi - lo)) + (1 - w) * predicted_score AS s FROM fx_scored, e, (SELECT k / 10e0 AS w FROM range(11) r(k)) WHERE true_label IN (0, 1)),
{_curve('w', 'x', 's')}, a AS (SELECT w, {AREAS} FROM c GROUP BY w) SELECT *, average_precision = max(average_precision) OVER () AS best FROM a""")
def _(t):
    return m.weight_sweep(t("fx_scored"), "template_score_if", "predicted_score")


@query("a17_sequential_filter_sweep", f"""
WITH k AS (SELECT * FROM fx_scored WHERE true_label IN (0, 1)), q AS (SELECT q, (SELECT quantile_cont(template_score_if, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5]) FROM k)[i] AS cut FROM (VALUES (0e0, 1), (0.1e0, 2), (0.2e0, 3), (0.3e0, 4), (0.4e0, 5), (0.5e0, 6)) v(q, i)),
x AS (SELECT * FROM k JOIN q ON template_score_if >= cut), {_curve('q', 'x')}
SELECT q, {AREAS}, sum(p + n)::BIGINT AS kept FROM c GROUP BY q HAVING sum(p + n) >= 100""")
def _(t):
    return m.sequential_filter_sweep(t("fx_scored"), "template_score_if")


@query("a18_auc_by_country", f"""
WITH k AS (SELECT * FROM fx_scored WHERE true_label IN (0, 1)), {_curve('country', 'k')},
a AS (SELECT country, {AREAS} FROM c WHERE pos > 0 AND neg > 0 GROUP BY country)
SELECT a.*, n, in_training FROM a JOIN (SELECT country, count(*) AS n, bool_or(split = 'train') AS in_training FROM k GROUP BY country HAVING count(*) >= 20) USING (country)""")
def _(t):
    return m.auc_by_country(t("fx_scored"))


@query("a18_auc_by_training", f"""
WITH k AS (SELECT * FROM fx_scored WHERE true_label IN (0, 1)), {_curve('country', 'k')},
a AS (SELECT country, {AREAS} FROM c WHERE pos > 0 AND neg > 0 GROUP BY country)
SELECT in_training, count(*) AS countries, round(avg(roc_auc), 6) AS mean_auc, round(median(roc_auc), 6) AS median_auc
FROM a JOIN (SELECT country, bool_or(split = 'train') AS in_training FROM k GROUP BY country HAVING count(*) >= 20) USING (country) GROUP BY in_training""")
def _(t):
    return m.auc_by_country(t("fx_scored")).groupBy("in_training").agg(F.count(F.lit(1)).alias("countries"), F.round(F.avg("roc_auc"), 6).alias("mean_auc"), F.round(F.median("roc_auc"), 6).alias("median_auc"))


GRID = [k / 20 for k in range(1, 20)]


@query("a19_threshold_sweep", f"""
WITH g AS (SELECT k / 20e0 AS threshold FROM range(1, 20) r(k)),
x AS (SELECT threshold, count(*) FILTER (true_label = 1 AND predicted_score >= threshold) AS tp, count(*) FILTER (true_label = 0 AND predicted_score >= threshold) AS fp,
  count(*) FILTER (true_label = 1 AND predicted_score < threshold) AS fn, count(*) FILTER (true_label = 0 AND predicted_score < threshold) AS tn FROM fx_scored, g WHERE true_label IN (0, 1) GROUP BY threshold),
y AS (SELECT threshold, tp, fp, fn, tn, {RATES} FROM (SELECT *, {PR} FROM x)) SELECT *, f1 = max(f1) OVER () AS best FROM y""")
def _(t):
    return m.threshold_sweep(t("fx_scored"), GRID)


@query("a20_agreement_matrix", """SELECT count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS first_only, count(*) FILTER (NOT a AND b) AS second_only, count(*) FILTER (NOT a AND NOT b) AS neither,
round(avg(CAST(a = b AS INT)), 6) AS agreement, round(corr(template_score_if, predicted_score), 6) AS pearson FROM (SELECT *, template_score_if >= 0 AS a, predicted_score >= 0.5 AS b FROM fx_scored)""")
def _(t):
    return m.agreement(t("fx_scored"), "template_score_if", 0.0, "predicted_score", 0.5)


@query("a21_calibration_bins", """SELECT CAST(least(greatest(ceil(top_score * 10), 1), 10) AS INT) AS bin, count(*) AS n, round(avg(CAST(true_class = pred_class AS INT)), 6) AS accuracy, round(avg(top_score), 6) AS confidence
FROM fx_multi GROUP BY 1""")
def _(t):
    return m.calibration_bins(t("fx_multi"), "top_score", F.col("true_class") == F.col("pred_class"))


@query("a22_score_histogram", """
WITH e AS (SELECT min(predicted_score) AS lo, max(predicted_score) AS hi FROM fx_scored),
b AS (SELECT true_label, CAST(least(floor((predicted_score - lo) / (hi - lo) * 20), 19) AS INT) AS bin, count(*) AS n, max(hi - lo) AS w FROM fx_scored, e GROUP BY 1, 2)
SELECT true_label, bin, n, round(n / sum(n) OVER (PARTITION BY true_label) / (w / 20), 6) AS density FROM b""")
def _(t):
    return m.score_histogram(t("fx_scored"), "true_label", "predicted_score")


@query("a24_morphology_by_outcome", f"""
WITH j AS (SELECT s.*, num_bldgs, total_area_m2 FROM fx_scored s JOIN fx_clusters c ON s.candidate_id = c.cluster_id),
l AS (SELECT {OUTCOME} AS outcome, 'num_bldgs' AS feature, CAST(num_bldgs AS DOUBLE) AS value FROM j UNION ALL SELECT {OUTCOME}, 'total_area_m2', CAST(total_area_m2 AS DOUBLE) FROM j)
SELECT outcome, feature, count(value) AS n, round(quantile_cont(value, 0.25), 4) AS q25, round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.75), 4) AS q75 FROM l GROUP BY 1, 2""")
def _(t):
    more = t("fx_clusters").select(F.col("cluster_id").alias("candidate_id"), "num_bldgs", "total_area_m2")
    return m.morphology_by_outcome(t("fx_scored").join(more, "candidate_id"), ["num_bldgs", "total_area_m2"])


LABELLED = "(SELECT cluster_id, country, CASE WHEN final_label IS NULL THEN -1 WHEN final_label = 'NotFarm' THEN 0 ELSE 1 END AS label FROM fx_clusters)"


@query("a25_sample_weights", f"""
WITH d AS (SELECT * FROM {LABELLED}), c AS (SELECT label, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS w FROM d WHERE label >= 0 GROUP BY label),
r AS (SELECT country, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS w FROM d WHERE label >= 0 GROUP BY country)
SELECT cluster_id, label, round(CASE WHEN label >= 0 THEN c.w ELSE 0 END, 6) AS class_weight, round(CASE WHEN label >= 0 THEN r.w ELSE 0 END, 6) AS region_weight, round(CASE WHEN label >= 0 THEN c.w * r.w ELSE 0 END, 6) AS weight
FROM d LEFT JOIN c USING (label) LEFT JOIN r USING (country)""")
def _(t):
    d = t("fx_clusters").select("cluster_id", "country", F.when(F.col("final_label").isNull(), -1).when(F.col("final_label") == "NotFarm", 0).otherwise(1).alias("label"))
    w = m.group_weights(m.group_weights(d, "label", "class_weight"), "country", "region_weight")
    return w.select("cluster_id", "label", F.round("class_weight", 6).alias("class_weight"), F.round("region_weight", 6).alias("region_weight"), F.round(F.col("class_weight") * F.col("region_weight"), 6).alias("weight"))


@query("a27_split_distribution", f"SELECT split, {', '.join(f'count(*) FILTER (true_class = {k}) AS n_{k}, round(count(*) FILTER (true_class = {k}) / count(*), 6) AS share_{k}' for k in range(3))} FROM fx_multi GROUP BY split")
def _(t):
    return m.split_distribution(t("fx_multi"), [0, 1, 2])


TIER = "CASE WHEN predicted_score >= 0.9 THEN 'high' WHEN predicted_score >= 0.7 THEN 'medium' WHEN predicted_score >= 0.5 THEN 'low' ELSE 'very_low' END"


@query("a29_fp_breakdown", f"""
WITH f AS (SELECT split, upper(split_part(candidate_id, '_', 1)) AS state, {TIER} AS tier FROM fx_scored WHERE true_label = 0 AND predicted_score >= 0.5)
SELECT 'split' AS "by", split AS value, count(*) AS n FROM f GROUP BY 2 UNION ALL (SELECT 'state', state, count(*) FROM f GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 15) UNION ALL SELECT 'tier', tier, count(*) FROM f GROUP BY 2""")
def _(t):
    from geoquill.functions.labels import confidence_tier, iso_prefix

    return m.fp_breakdown(t("fx_scored"), iso_prefix("candidate_id"), confidence_tier("predicted_score"))


@query("a30_country_f1_summary", """
WITH s AS (SELECT country, true_class AS class, CAST(true_class = pred_class AS INT) AS hit, 1 AS t, 0 AS p FROM fx_multi UNION ALL SELECT country, pred_class, 0, 0, 1 FROM fx_multi),
k AS (SELECT country, class, sum(hit) AS tp, sum(t) AS nt, sum(p) AS np FROM s GROUP BY 1, 2),
c AS (SELECT country, round(avg(2 * tp / (nt + np)), 4) AS f1, round(sum(tp) / sum(nt), 4) AS accuracy FROM k GROUP BY 1),
n AS (SELECT country, bool_or(split = 'train') AS in_training FROM fx_multi GROUP BY 1 HAVING count(*) >= 5)
SELECT in_training, count(*) AS countries, round(avg(f1), 6) AS mean_f1, round(median(f1), 6) AS median_f1, round(avg(accuracy), 6) AS mean_accuracy FROM c JOIN n USING (country) GROUP BY 1""")
def _(t):
    return m.country_f1_summary(t("fx_multi"))


@query("a31_model_comparison", """
SELECT country, count(*) AS n, round(2 * count(*) FILTER (l AND a) / greatest(2 * count(*) FILTER (l AND a) + count(*) FILTER (l <> a), 1), 6) AS f1_first,
round(2 * count(*) FILTER (l AND b) / greatest(2 * count(*) FILTER (l AND b) + count(*) FILTER (l <> b), 1), 6) AS f1_second
FROM (SELECT country, true_label = 1 AS l, template_score_if >= 0 AS a, predicted_score >= 0.5 AS b FROM fx_scored WHERE true_label IN (0, 1)) GROUP BY country""")
def _(t):
    return m.model_comparison(t("fx_scored"), "template_score_if", 0.0, "predicted_score", 0.5)


@query("a31_class_comparison", f"""
WITH k AS (SELECT final_label AS kind, predicted_score FROM fx_scored WHERE final_label IS NOT NULL), g AS (SELECT kind, count(*) AS n, round(median(predicted_score), 6) AS median_score, round(avg(CASE WHEN predicted_score >= 0.5 THEN 1e0 ELSE 0e0 END), 6) AS predicted_share FROM k GROUP BY kind),
s AS (SELECT predicted_score, count(*) FILTER (kind = 'Farm: Pigs') AS p, count(*) FILTER (kind = 'Farm: Cattle') AS n FROM k WHERE kind IN ('Farm: Pigs', 'Farm: Cattle') GROUP BY 1),
b AS (SELECT p, n, coalesce(sum(n) OVER (ORDER BY predicted_score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(p) OVER () AS pos, sum(n) OVER () AS neg FROM s)
SELECT *, (SELECT round(sum(p * (below + n / 2)) / max(pos * neg), 6) FROM b) AS pair_auc FROM g""")
def _(t):
    return m.class_comparison(t("fx_scored").withColumnRenamed("final_label", "kind"), "predicted_score", "kind", "Farm: Pigs", "Farm: Cattle")


@query("a32_log_loss", """
SELECT round(sum(-w * ln(CASE WHEN true_label = 1 THEN p ELSE 1 - p END)) / sum(w), 6) AS log_loss FROM (SELECT *, least(greatest(predicted_score, 1e-7), 1 - 1e-7) AS p, CASE WHEN true_label = 1 THEN 2e0 ELSE 1e0 END AS w FROM fx_scored WHERE true_label IN (0, 1))""")
def _(t):
    return m.log_loss(t("fx_scored"), 2.0)


@query("a35_map_centre", "SELECT country, round(avg(lat), 6) AS lat, round(avg(lng), 6) AS lng, count(*) AS n FROM fx_scored GROUP BY country")
def _(t):
    return t("fx_scored").groupBy("country").agg(F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lng"), 6).alias("lng"), F.count(F.lit(1)).alias("n"))
