"""Fitting patch classifiers: gradients, classes, weights, stopping, saved models, and rates against SQL."""

import math

import numpy as np
import pytest

from geoquill.operators import patches, training
from geoquill.operators.training import PatchModel, Training


def made(spark, n=360, few=3):
    """Three classes told apart by texture and not by a channel's mean alone; the third is rare, and in region b every label of the first two is swapped."""
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for k in range(n):
        label = 2 if k % (10 * few) == 0 else k % 2
        a = rng.normal(0.5, 0.05, (2, 6, 6))
        if label == 1:
            a[:, ::2] += 0.2
            a[:, 1::2] -= 0.2
        elif label == 2:
            a[:, :3, :3] += 0.3
        region = "b" if k % 12 == 3 else "a"
        rows.append((k, 2, 6, 6, a.astype(np.float32).ravel().tolist()))
        split = ("train", "train", "train", "val", "test")[(k // 2) % 5]
        labels.append((k, (1 - label if label < 2 and region == "b" else label), split, region))
    labels[5] = (5, -1, "train", "a")
    return spark.createDataFrame(rows, "candidate_id long, n_channels int, height int, width int, data array<float>"), spark.createDataFrame(labels, "candidate_id long, label int, split string, country string")


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(2)
    x, place, weight = rng.random((7, 5)), rng.integers(0, 3, 7), rng.random(7)
    model = PatchModel.start([0, 1, 4], x.mean(0), x.std(0), 4, 3)
    got = model.gradients(x, place, weight)
    for name, a in model.layers.items():
        for at in np.ndindex(a.shape):
            a[at] += 1e-6
            up = model.loss(x, place, weight)
            a[at] -= 2e-6
            assert abs((up - model.loss(x, place, weight)) / 2e-6 - got[name][at]) < 1e-5
            a[at] += 1e-6


def test_three_classes_early_stop_and_saved_model(spark, tmp_path):
    df, labels = made(spark)
    history: list[dict] = []
    how = Training(epochs=25, batches=2, patience=3)
    model = training.fit_patches(df, labels.where("country = 'a'"), how, history=history)
    assert model.classes == [0, 1, 2] and history[0]["loss"] > 2 * min(h["loss"] for h in history) and len(history) <= 26
    again = training.fit_patches(df.repartition(5), labels.where("country = 'a'"), how)
    assert all(np.allclose(model.layers[n], again.layers[n], atol=1e-8) for n in model.layers)
    model.save(spark, f"{tmp_path}/m")
    back = PatchModel.read(spark, f"{tmp_path}/m")
    batch = np.random.default_rng(3).random((4, 2, 6, 6))
    assert np.array_equal(model.predict(batch), back.predict(batch)) and np.allclose(back.predict(batch).sum(1), 1)
    probs = {r["candidate_id"]: r["probs"] for r in patches.score_candidates(df, back).collect()}
    held = training.predictions(back, df, labels.where("country = 'a' and split = 'test'")).collect()
    assert np.mean([r["predicted_label"] == r["label"] for r in held]) > 0.95
    assert all(r["predicted_label"] == int(np.argmax(probs[r["candidate_id"]])) and math.isclose(r["loss"], -math.log(probs[r["candidate_id"]][r["label"]]), rel_tol=1e-9) for r in held)


def test_weights_change_the_fit(spark):
    """Region b contradicts a: with plain rows a, with more of them, wins; rows of equal weight by region can't do so. A rare class weighs more."""
    df, labels = made(spark)
    two = labels.where("label < 2")
    plain = training.fit_patches(df, two, Training(epochs=12, class_weighted=False))
    by_region = training.fit_patches(df, two, Training(epochs=12, class_weighted=False, region_weighted=True))
    loss = {}
    for name, model in (("plain", plain), ("region", by_region)):
        rows = training.predictions(model, df, two).groupBy("country").avg("loss").collect()
        loss[name] = {r["country"]: r["avg(loss)"] for r in rows}
    assert loss["region"]["b"] < loss["plain"]["b"] and loss["region"]["a"] > loss["plain"]["a"]
    plain = training.fit_patches(df, labels, Training(epochs=2, class_weighted=False))
    weighted = training.fit_patches(df, labels, Training(epochs=2))
    rare = lambda m: np.mean([r["loss"] for r in training.predictions(m, df, labels.where("label = 2")).collect()])
    assert rare(weighted) < rare(plain)


def test_rates_agree_with_sql(spark, tmp_path):
    import duckdb

    df, labels = made(spark)
    model = training.fit_patches(df, labels, Training(epochs=3))
    training.predictions(model, df, labels.where("split <> 'train'")).write.parquet(f"{tmp_path}/p")
    got = {(r["split"], r["country"]): tuple(r)[2:] for r in training.slice_rates(spark.read.parquet(f"{tmp_path}/p")).collect()}
    sql = """WITH p AS (SELECT split, NULL AS country, label, predicted_label AS q, loss FROM '{0}/p/*.parquet' UNION ALL SELECT split, country, label, predicted_label, loss FROM '{0}/p/*.parquet'),
    c AS (SELECT DISTINCT split, country, unnest([label, q]) AS k FROM p),
    f AS (SELECT c.split, c.country, k, count(*) FILTER (label = k AND q = k) AS tp, count(*) FILTER (label = k) AS t, count(*) FILTER (q = k) AS q FROM c JOIN p ON p.split = c.split AND p.country IS NOT DISTINCT FROM c.country GROUP BY ALL),
    m AS (SELECT split, country, sum(tp) / sum(t) AS a, avg(CASE WHEN q > 0 THEN tp / q ELSE 0 END) AS pr, avg(CASE WHEN t > 0 THEN tp / t ELSE 0 END) AS re, avg(2 * tp / (t + q)) AS f1 FROM f GROUP BY ALL),
    n AS (SELECT split, country, count(*) AS n, avg(loss) AS loss FROM p GROUP BY ALL)
    SELECT m.split, m.country, n, loss, a, pr, re, f1 FROM m JOIN n ON n.split = m.split AND n.country IS NOT DISTINCT FROM m.country""".format(tmp_path)
    want = {(r[0], r[1]): r[2:] for r in duckdb.sql(sql).fetchall()}
    assert set(got) == set(want) and len(got) == 6
    for k, row in want.items():
        assert got[k][0] == row[0] and all(abs(a - b) < 1e-4 for a, b in zip(got[k][1:], row[1:], strict=True))


def test_odd_patches(spark):
    df, labels = made(spark, 40)
    with pytest.raises(ValueError, match="two classes"):
        training.fit_patches(df, labels.where("label = 1"))
    with pytest.raises(ValueError, match="two classes"):
        training.fit_patches(df.limit(0), labels)
    assert np.isfinite(training.patch_features(np.full((1, 2, 1, 1), np.nan))).all()
    without = training.fit_patches(df, labels.where("split = 'train'"), Training(epochs=1))
    assert training.predictions(without, df, labels.limit(0)).count() == 0
