"""Quality of scored candidates: confusion counts, rates, curves, sweeps and weights.

All are lazy transforms of a scored table (true_label, predicted_score, ...). Rows whose true_label isn't 0 or 1 have no ground truth.
Curves need running counts in score order, and quantiles places; they are taken over parts of the scores' range first, whose borders come from a sample, and then
inside each part, so no window or buffer holds all rows of a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoquill.operators.ranks import in_parts, quantiles

SPLITS = ("train", "val", "test", "inspected", "eval", "generalization")


def known(df: DataFrame) -> DataFrame:
    return df.where(F.col("true_label").isin(0, 1))


def outcome_class(threshold: float = 0.5) -> Column:
    """TP, FP, FN, TN; UP or UN where there is no ground truth."""
    positive = F.col("predicted_score") >= threshold
    return (
        F.when(F.col("true_label") == 1, F.when(positive, "TP").otherwise("FN"))
        .when(F.col("true_label") == 0, F.when(positive, "FP").otherwise("TN"))
        .otherwise(F.when(positive, "UP").otherwise("UN"))
    )


def counts(threshold: float | Column = 0.5) -> list[Column]:
    positive = F.col("predicted_score") >= threshold
    true, false = F.col("true_label") == 1, F.col("true_label") == 0
    return [F.count_if(true & positive).alias("tp"), F.count_if(false & positive).alias("fp"), F.count_if(true & ~positive).alias("fn"), F.count_if(false & ~positive).alias("tn")]


def rates(df: DataFrame, digits: int = 4) -> DataFrame:
    """Adds accuracy, precision, recall and f1 for columns tp, fp, fn, tn; empty denominators give 0."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    share = lambda a, b: a / F.greatest(b, F.lit(1.0))
    p, r = share(tp, tp + fp), share(tp, tp + fn)
    made = {"accuracy": share(tp + tn, tp + fp + fn + tn), "precision": p, "recall": r, "f1": 2 * p * r / F.greatest(p + r, F.lit(1e-8))}
    return df.withColumns({k: F.round(v, digits) for k, v in made.items()})


def binary_metrics(df: DataFrame, *keys: str, threshold: float = 0.5) -> DataFrame:
    """Counts and rates of rows with ground truth, for each value of the keys."""
    return rates(known(df).groupBy(*keys).agg(*counts(threshold)))


def metrics_by_split(df: DataFrame, splits: Sequence[str] = SPLITS) -> DataFrame:
    """One row for every split in a fixed order, with zeros where a split is empty."""
    place = F.array_position(F.array(*map(F.lit, splits)), F.col("split")).cast("int") - 1
    listed = df.sparkSession.createDataFrame([(s,) for s in splits], "split string")
    got = known(df).groupBy("split").agg(*counts())
    return rates(listed.join(got, "split", "left").na.fill(0)).withColumn("place", place)


def metrics_by_country(df: DataFrame) -> DataFrame:
    """Rates by country, with n rows and how many have no ground truth and are predicted positive (up) or not (un)."""
    kind = outcome_class()
    return rates(df.groupBy("country").agg(F.count(F.lit(1)).alias("n"), *counts(), F.count_if(kind == "UP").alias("up"), F.count_if(kind == "UN").alias("un")))


def class_counts(df: DataFrame, *keys: str, true: str = "true_class", pred: str = "pred_class") -> DataFrame:
    """tp, n_true, n_pred of every class that is true or predicted somewhere in its group."""
    sides = F.explode(F.array(F.struct(F.col(true).alias("class"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col(pred).alias("class"), F.lit(0).alias("t"), F.lit(1).alias("p"))))
    hit = (F.col(true) == F.col(pred)).cast("int").alias("hit")
    one = df.select(*keys, hit, sides.alias("s")).select(*keys, "s.*", (F.col("hit") * F.col("s.t")).alias("hit"))
    return one.groupBy(*keys, "class").agg(F.sum("hit").alias("tp"), F.sum("t").alias("n_true"), F.sum("p").alias("n_pred"))


def class_rates(df: DataFrame, *keys: str, **names: str) -> DataFrame:
    """Per class: precision, recall, f1 (0 where undefined) and support."""
    tp = F.col("tp").cast("double")
    share = lambda n: F.when(F.col(n) > 0, tp / F.col(n)).otherwise(0.0)
    both = F.col("n_true") + F.col("n_pred")
    return class_counts(df, *keys, **names).select(*keys, "class", share("n_pred").alias("precision"), share("n_true").alias("recall"), F.when(both > 0, 2 * tp / both).otherwise(0.0).alias("f1"), F.col("n_true").alias("support"))


def multiclass_metrics(df: DataFrame, *keys: str, **names: str) -> DataFrame:
    """Accuracy and macro precision, recall and f1 over the classes that are true or predicted."""
    per = class_counts(df, *keys, **names)
    tp = F.col("tp").cast("double")
    share = lambda n: F.when(F.col(n) > 0, tp / F.col(n)).otherwise(0.0)
    return per.groupBy(*keys).agg(
        F.round(F.sum("tp") / F.sum("n_true"), 4).alias("accuracy"), F.round(F.avg(share("n_pred")), 4).alias("precision"), F.round(F.avg(share("n_true")), 4).alias("recall"),
        F.round(F.avg(2 * tp / (F.col("n_true") + F.col("n_pred"))), 4).alias("f1"), F.count(F.lit(1)).alias("n_classes"),
    )


def classification_report(df: DataFrame, **names: str) -> DataFrame:
    """Rows by class and for the macro and weighted means."""
    per = class_rates(df, **names)
    mean = lambda c: F.avg(c).alias(c)
    weighted = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c)
    kinds = ("precision", "recall", "f1")
    total = F.sum("support").alias("support")
    rows = per.withColumn("class", F.col("class").cast("string")).unionByName(per.agg(F.lit("macro").alias("class"), *map(mean, kinds), total)).unionByName(per.agg(F.lit("weighted").alias("class"), *map(weighted, kinds), total))
    return rows.withColumns({c: F.round(c, 6) for c in kinds})


def confusion_matrix(df: DataFrame, true: str = "true_class", pred: str = "pred_class") -> DataFrame:
    """Cells, row and column totals and the grand total (nulls), and the share of the row."""
    cube = df.cube(true, pred).agg(F.count(F.lit(1)).alias("n"))
    return cube.withColumn("row_share", F.round(F.col("n") / F.max("n").over(Window.partitionBy(true)), 6))


def crosstab(df: DataFrame, row: str, col: Column, values: Sequence[str]) -> DataFrame:
    return df.withColumn("_col", col).groupBy(row).pivot("_col", list(values)).count().na.fill(0)


def composition(df: DataFrame, key: str) -> DataFrame:
    """Rows and percent of all rows for each value."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def score_stats(df: DataFrame, key: str, score: str) -> DataFrame:
    names = ("q25", "median", "q75")
    sums = df.groupBy(key).agg(F.count(score).alias("n"), F.round(F.avg(score), 6).alias("mean"), F.round(F.stddev_samp(score), 6).alias("std"))
    q = quantiles(df, [key], score, (0.25, 0.5, 0.75), names).select(F.col(key).alias("_key"), *(F.round(x, 6).alias(x) for x in names))
    return sums.join(q, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")


def outcome_medians(df: DataFrame, *keys: str) -> DataFrame:
    """Rows and exact median score by keys and outcome, with a row of ALL keys for each outcome."""
    keys = keys or ("country",)
    rows = df.withColumn("outcome", outcome_class()).select(*[F.coalesce(F.col(k).cast("string"), F.lit("ALL")).alias(k) for k in keys], "outcome", "predicted_score")
    rows = rows.union(rows.select(*[F.lit("ALL").alias(k) for k in keys], "outcome", "predicted_score"))
    by = [*keys, "outcome"]
    q = quantiles(rows, by, "predicted_score", (0.5,), ("median_score",))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).join(q.select(*by, F.round("median_score", 6).alias("median_score")), by, "left")


def curve(df: DataFrame, *keys: str, score: str = "predicted_score", label: str = "true_label") -> DataFrame:
    """For each distinct score of a group, from high to low: p and n at it, tp and fp at or above it, and the totals pos and neg."""
    per = df.groupBy(*keys, F.col(score).alias("score")).agg(F.sum((F.col(label) == 1).cast("long")).alias("p"), F.sum((F.col(label) == 0).cast("long")).alias("n"))
    per = in_parts(per, *keys, "score").withColumnRenamed("_part", "bucket")
    sums = per.groupBy(*keys, "bucket").agg(F.sum("p").alias("bp"), F.sum("n").alias("bn"))
    above = Window.partitionBy(*keys).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*keys)
    sums = sums.select(*keys, "bucket", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"over_{c}") for c in ("bp", "bn")), F.sum("bp").over(every).alias("pos"), F.sum("bn").over(every).alias("neg"))
    within = Window.partitionBy(*keys, "bucket").orderBy(F.desc("score"))
    joined = per.join(sums, [*keys, "bucket"])
    return joined.select(*keys, "score", "p", "n", (F.col("over_bp") + F.sum("p").over(within)).alias("tp"), (F.col("over_bn") + F.sum("n").over(within)).alias("fp"), "pos", "neg")


def auc_of_curve(c: DataFrame, *keys: str) -> DataFrame:
    """roc_auc (ties count half) and average_precision (step-wise) of each group of a curve that has both classes."""
    below = F.col("neg") - F.col("fp")
    return c.where("pos > 0 and neg > 0").groupBy(*keys).agg(
        F.round(F.sum(F.col("p") * (below + F.col("n") / 2)) / F.max(F.col("pos") * F.col("neg")), 6).alias("roc_auc"),
        F.round(F.sum(F.col("p") / F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))), 6).alias("average_precision"),
    )


def auc(df: DataFrame, *keys: str, score: str = "predicted_score", label: str = "true_label") -> DataFrame:
    return auc_of_curve(curve(df, *keys, score=score, label=label), *keys)


def roc_curve(df: DataFrame, **names: str) -> DataFrame:
    return curve(df, **names).select("score", F.round(F.col("fp") / F.col("neg"), 6).alias("fpr"), F.round(F.col("tp") / F.col("pos"), 6).alias("tpr"))


def pr_curve(df: DataFrame, **names: str) -> DataFrame:
    return curve(df, **names).select("score", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / F.col("pos")).alias("recall"))


def precision_at_recall(df: DataFrame, goals: Sequence[float] = (0.99, 0.95, 0.9), **names: str) -> DataFrame:
    """The point of the precision-recall curve nearest to each recall; the lowest threshold on a tie."""
    points = pr_curve(df, **names).withColumn("goal", F.explode(F.array(*map(F.lit, goals))))
    best = points.groupBy("goal").agg(F.min(F.struct(F.abs(F.col("recall") - F.col("goal")).alias("gap"), "score", "precision", "recall")).alias("b"))
    return best.select("goal", F.col("b.score").alias("threshold"), F.round("b.precision", 6).alias("precision"), F.round("b.recall", 6).alias("recall"))


def minmax(df: DataFrame, column: str, out: str) -> DataFrame:
    """column scaled to 0..1 by its least and greatest value, which come from one aggregated row."""
    ends = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    return df.crossJoin(F.broadcast(ends)).withColumn(out, (F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).drop("_lo", "_hi")


def weight_sweep(df: DataFrame, first: str, second: str, steps: int = 10) -> DataFrame:
    """Areas of w * minmax(first) + (1 - w) * second for w from 0 to 1, and whether a w has the best average precision."""
    weights = F.array(*[F.lit(k / steps) for k in range(steps + 1)])
    mixed = minmax(known(df), first, "_m").withColumn("w", F.explode(weights)).withColumn("_s", F.col("w") * F.col("_m") + (1 - F.col("w")) * F.col(second))
    areas = auc(mixed, "w", score="_s")
    return areas.withColumn("best", F.col("average_precision") == F.max("average_precision").over(Window.partitionBy()))


def sequential_filter_sweep(df: DataFrame, gate: str, shares: Sequence[float] = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5), least: int = 100) -> DataFrame:
    """Areas of the rest after the rows below each quantile of `gate` are dropped; sweeps that keep fewer than `least` rows are left out."""
    rows = known(df)
    names = [f"c{k}" for k in range(len(shares))]
    cuts = quantiles(rows, [], gate, shares, names).select(F.explode(F.array(*[F.struct(F.lit(p).alias("q"), F.col(c).alias("cut")) for p, c in zip(shares, names, strict=True)])).alias("z")).select("z.q", "z.cut")
    kept = rows.join(F.broadcast(cuts), F.col(gate) >= F.col("cut"))
    c = curve(kept, "q")
    return auc_of_curve(c, "q").join(kept.groupBy("q").agg(F.count(F.lit(1)).alias("kept")), "q").where(F.col("kept") >= least)


def auc_by_country(df: DataFrame, least: int = 20) -> DataFrame:
    """Areas of the countries with enough rows, and whether the country is in training."""
    rows = known(df)
    enough = rows.groupBy("country").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("split") == "train").alias("in_training")).where(F.col("n") >= least)
    return auc(rows, "country").join(enough, "country")


def threshold_sweep(df: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Rates at each of the rising thresholds. Rows are counted by how many thresholds they reach, so nothing is multiplied."""
    grid = F.array(*map(F.lit, thresholds))
    reach = F.size(F.filter(grid, lambda t: F.col("predicted_score") >= t)).alias("reach")
    got = known(df).groupBy(reach).agg(F.count_if(F.col("true_label") == 1).alias("p"), F.count_if(F.col("true_label") == 0).alias("n"))
    spots = df.sparkSession.createDataFrame([(k + 1, float(t)) for k, t in enumerate(thresholds)], "place int, threshold double")
    over = F.col("reach") >= F.col("place")
    out = F.broadcast(spots).join(got).groupBy("threshold").agg(
        F.sum(F.when(over, F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(over, F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when(over, 0).otherwise(F.col("p"))).alias("fn"), F.sum(F.when(over, 0).otherwise(F.col("n"))).alias("tn"),
    )
    return rates(out).withColumn("best", F.col("f1") == F.max("f1").over(Window.partitionBy()))


def agreement(df: DataFrame, first: str, cut_first: float, second: str, cut_second: float) -> DataFrame:
    a, b = F.col(first) >= cut_first, F.col(second) >= cut_second
    return df.agg(
        F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("first_only"), F.count_if(~a & b).alias("second_only"), F.count_if(~a & ~b).alias("neither"),
        F.round(F.avg((a == b).cast("double")), 6).alias("agreement"), F.round(F.corr(first, second), 6).alias("pearson"),
    )


def calibration_bins(df: DataFrame, confidence: str, correct: Column, bins: int = 10) -> DataFrame:
    """Right-closed bins of equal width; the first also holds 0."""
    place = F.least(F.greatest(F.ceil(F.col(confidence) * bins), F.lit(1)), F.lit(bins)).cast("int").alias("bin")
    return df.groupBy(place).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(correct.cast("double")), 6).alias("accuracy"), F.round(F.avg(confidence), 6).alias("confidence"))


def score_histogram(df: DataFrame, key: str, score: str, bins: int = 20) -> DataFrame:
    """Counts and densities in equal bins from the least to the greatest score of all rows."""
    ends = df.agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    wide = F.col("_hi") - F.col("_lo")
    place = F.least(F.floor((F.col(score) - F.col("_lo")) / wide * bins), F.lit(bins - 1)).cast("int")
    got = df.where(F.col(score).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(key, place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.max(wide).alias("_w"))
    return got.select(key, "bin", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(key)) / (F.col("_w") / bins), 6).alias("density"))


def morphology_by_outcome(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Exact quartiles of each feature by outcome."""
    long = df.withColumn("outcome", outcome_class()).select("outcome", *(F.col(c).cast("double").alias(c) for c in features)).unpivot("outcome", list(features), "feature", "value")
    names = ("q25", "median", "q75")
    return quantiles(long, ["outcome", "feature"], "value", (0.25, 0.5, 0.75), names).select("outcome", "feature", F.col("_n").alias("n"), *(F.round(x, 4).alias(x) for x in names))


def group_weights(df: DataFrame, key: str, out: str) -> DataFrame:
    """total / (groups * rows of the group) over labelled rows; unlabelled rows weigh 0."""
    rows = df.where("label >= 0").groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.withColumn(out, F.sum("_n").over(Window.partitionBy()) / (F.count(F.lit(1)).over(Window.partitionBy()) * F.col("_n"))).drop("_n")
    joined = df.join(rows, key, "left")
    return joined.withColumn(out, F.when(F.col("label") >= 0, F.coalesce(F.col(out), F.lit(0.0))).otherwise(0.0))


def split_distribution(df: DataFrame, classes: Sequence[int]) -> DataFrame:
    wide = df.groupBy("split").pivot("true_class", list(classes)).count().na.fill(0)
    total = sum((F.col(str(c)) for c in classes[1:]), F.col(str(classes[0])))
    return wide.select("split", *(F.col(str(c)).alias(f"n_{c}") for c in classes), *(F.round(F.col(str(c)) / total, 6).alias(f"share_{c}") for c in classes))


def fp_breakdown(df: DataFrame, state: Column, tier: Column, top: int = 15) -> DataFrame:
    """False positives by split, by state (the `top` states with most, the first by name on a tie) and by confidence tier, in one pass."""
    fp = df.where(outcome_class() == "FP").select("split", state.alias("state"), tier.alias("tier"))
    sets = fp.groupingSets([[F.col("split")], [F.col("state")], [F.col("tier")]], "split", "state", "tier").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 3, "split").when(F.col("g") == 5, "state").otherwise("tier")
    rows = sets.select(kind.alias("by"), F.coalesce("split", "state", "tier").alias("value"), "n")  # one row for each split, state and tier
    first = rows.where("by = 'state'").orderBy(F.desc("n"), "value").limit(top)
    return rows.where("by <> 'state'").union(first)


def country_f1_summary(df: DataFrame, least: int = 5) -> DataFrame:
    """Macro f1 and accuracy of countries with enough rows, summed up by whether the country is in training."""
    per = multiclass_metrics(df, "country").join(df.groupBy("country").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("split") == "train").alias("in_training")), "country").where(F.col("n") >= least)
    return per.groupBy("in_training").agg(F.count(F.lit(1)).alias("countries"), F.round(F.avg("f1"), 6).alias("mean_f1"), F.round(F.median("f1"), 6).alias("median_f1"), F.round(F.avg("accuracy"), 6).alias("mean_accuracy"))


def model_comparison(df: DataFrame, first: str, cut_first: float, second: str, cut_second: float) -> DataFrame:
    """f1 (2 tp / (2 tp + fp + fn)) of two scores side by side, by country."""
    true = F.col("true_label") == 1
    out = []
    for name, score, cut in (("first", first, cut_first), ("second", second, cut_second)):
        got = F.col(score) >= cut
        tp = F.count_if(true & got)
        out.append(F.round(2 * tp / F.greatest(2 * tp + F.count_if(true != got), F.lit(1)), 6).alias(f"f1_{name}"))
    return known(df).groupBy("country").agg(F.count(F.lit(1)).alias("n"), *out)


def class_comparison(df: DataFrame, score: str, kind: str, first: str, second: str, threshold: float = 0.5) -> DataFrame:
    """Share of rows predicted positive and median score of each kind, and the area under the curve of the score between two kinds."""
    rows = df.where(F.col(score).isNotNull() & F.col(kind).isNotNull())
    medians = quantiles(rows, [kind], score, (0.5,), ("median_score",)).select(kind, F.col("_n").alias("n"), F.round("median_score", 6).alias("median_score"))
    shares = rows.groupBy(kind).agg(F.round(F.avg((F.col(score) >= threshold).cast("double")), 6).alias("predicted_share"))
    pair = rows.where(F.col(kind).isin(first, second)).withColumn("_side", (F.col(kind) == first).cast("int"))
    area = auc(pair, score=score, label="_side").select(F.col("roc_auc").alias("pair_auc"))
    return medians.join(shares, kind).crossJoin(F.broadcast(area))


def log_loss(df: DataFrame, positive_weight: float = 1.0) -> DataFrame:
    """Weighted mean cross entropy of a binary score, clipped away from 0 and 1."""
    p = F.least(F.greatest(F.col("predicted_score"), F.lit(1e-7)), F.lit(1 - 1e-7))
    true = F.col("true_label") == 1
    w = F.when(true, positive_weight).otherwise(1.0)
    return known(df).agg(F.round(F.sum(-w * F.log(F.when(true, p).otherwise(1 - p))) / F.sum(w), 6).alias("log_loss"))
