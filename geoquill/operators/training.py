"""A patch classifier of any number of classes, fitted in mini-batches by Spark: weights go out with each step's job, and sums of gradients come back.

The model is a small network over features of a patch (of each channel: mean, spread, least, greatest, mean steps across and down, and means of the quarters). Features are computed once and written. A step is one pass over that table, of
whose rows those of the step's batch, by a hash of id and epoch, make gradients; each task sums its own, sums meet in GROUPS rows, and these come to the driver: as many numbers as the model has, whatever the data. The same pass gives
the loss on the validation slice before the step. A lost executor costs its tasks of one step; the steps so far live on the driver, and the best model is what is returned.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoquill.operators.lookups import uniform
from geoquill.operators.metrics import group_weights, multiclass_metrics
from geoquill.operators.patches import score_candidates
from geoquill.sources.tables import steps, write_table

GROUPS = 16


def patch_features(batch: np.ndarray) -> np.ndarray:
    """(n, C, H, W) -> (n, 10 C). Not-a-numbers count as 0; a patch of one row or column has no steps that way."""
    a = np.nan_to_num(np.asarray(batch, float))
    h, w = (a.shape[2] + 1) // 2, (a.shape[3] + 1) // 2
    step = lambda x, axis: np.abs(np.diff(x, axis=axis)).mean((2, 3)) if x.shape[axis] > 1 else np.zeros(x.shape[:2])
    quarters = [a[:, :, i, j].mean((2, 3)) for i in (slice(0, h), slice(-h, None)) for j in (slice(0, w), slice(-w, None))]
    return np.concatenate([a.mean((2, 3)), a.std((2, 3)), a.min((2, 3)), a.max((2, 3)), step(a, 2), step(a, 3), *quarters], axis=1)


@dataclass
class PatchModel:
    """Scales features, then one layer of tanh units and a softmax over the classes, in order of `classes`. It is also a scorer for score_candidates."""

    classes: list[int]
    mean: np.ndarray
    scale: np.ndarray
    layers: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def start(cls, classes: Sequence[int], mean: np.ndarray, scale: np.ndarray, hidden: int, seed: int) -> PatchModel:
        rng, n, k = np.random.default_rng(seed), len(mean), len(classes)
        return cls(list(classes), mean, scale, {"w1": rng.normal(0, n**-0.5, (n, hidden)), "b1": np.zeros(hidden), "w2": rng.normal(0, hidden**-0.5, (hidden, k)), "b2": np.zeros(k)})

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = (x - self.mean) / self.scale
        unit = np.tanh(z @ self.layers["w1"] + self.layers["b1"])
        out = unit @ self.layers["w2"] + self.layers["b2"]
        out = np.exp(out - out.max(1, keepdims=True))
        return z, unit, out / out.sum(1, keepdims=True)

    def predict(self, batch: np.ndarray) -> np.ndarray:
        return self._forward(patch_features(batch))[2]

    def __call__(self) -> Callable[[np.ndarray], np.ndarray]:
        return self.predict

    def loss(self, x: np.ndarray, place: np.ndarray, weight: np.ndarray) -> float:
        """Weighted sum of the cross entropy; place: the class's place in `classes`."""
        p = self._forward(x)[2][np.arange(len(place)), place]
        return float((weight * -np.log(np.maximum(p, 1e-12))).sum())

    def gradients(self, x: np.ndarray, place: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted sum of the cross entropy."""
        z, unit, p = self._forward(x)
        p[np.arange(len(place)), place] -= 1
        p *= weight[:, None]
        back = (p @ self.layers["w2"].T) * (1 - unit**2)
        return {"w1": z.T @ back, "b1": back.sum(0), "w2": unit.T @ p, "b2": p.sum(0)}

    def save(self, spark: SparkSession, path: str) -> None:
        parts = {"classes": np.array(self.classes, float), "mean": self.mean, "scale": self.scale, **self.layers}
        rows = [(n, list(map(int, a.shape)), a.ravel().tolist()) for n, a in parts.items()]
        spark.createDataFrame(rows, "part string, shape array<int>, numbers array<double>").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> PatchModel:
        parts = {r["part"]: np.array(r["numbers"]).reshape(tuple(r["shape"])) for r in spark.read.parquet(path).collect()}  # a row a part
        return cls([int(c) for c in parts.pop("classes")], parts.pop("mean"), parts.pop("scale"), parts)


@dataclass(frozen=True)
class Training:
    """epochs at most, each of `batches` steps; patience: epochs without a better loss on the validation slice before it stops. class_weighted, region_weighted: rows count in inverse proportion to their class's and region's rows."""

    epochs: int = 30
    batches: int = 2
    rate: float = 0.05
    decay: float = 1e-4
    hidden: int = 12
    patience: int = 6
    seed: int = 42
    class_weighted: bool = True
    region_weighted: bool = False


def _features(patches: DataFrame) -> DataFrame:
    """candidate_id, x: what patch_features gives. Patches of other numbers of channels give other lengths."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for (c, h, w), part in frame.groupby(["n_channels", "height", "width"]):
                batch = np.stack([np.asarray(d, float) for d in part["data"]]).reshape(-1, c, h, w)
                yield pd.DataFrame({"candidate_id": part["candidate_id"].to_numpy(), "x": list(patch_features(batch))})

    kept = patches.select("candidate_id", "n_channels", "height", "width", "data")
    return kept.mapInPandas(work, f"candidate_id {dict(kept.dtypes)['candidate_id']}, x array<double>")


def _summed(rows: DataFrame, work: Callable[[pd.DataFrame], np.ndarray], size: int) -> np.ndarray:
    """Sum over all batches of rows of what work gives (an array of `size`): in each task first, then in GROUPS rows, then on the driver."""

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, at = np.zeros(size), 0
        for frame in frames:
            if len(frame):
                total += work(frame)
                at = int(frame["k"].iloc[0]) % GROUPS
        yield pd.DataFrame({"g": [at], "v": [total]})

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"g": frame["g"].iloc[:1], "v": [np.sum(np.stack(frame["v"].to_numpy()), axis=0)]})

    schema = "g int, v array<double>"
    got = rows.mapInPandas(part, schema).groupBy("g").applyInPandas(meet, schema).collect()
    return np.sum([np.asarray(r["v"]) for r in got], axis=0) if got else np.zeros(size)


def fit_patches(patches: DataFrame, labels: DataFrame, how: Training = Training(), train: str = "train", validation: str = "val", history: list[dict] | None = None) -> PatchModel:
    """A model fitted to the patches whose split is `train`, and stopped by the loss of those in `validation`, where there are any. labels: candidate_id, label (-1: unknown, left out), split, and country where regions are weighted.

    history: gets epoch, loss (weighted mean of the validation slice, or else of the training one). Ids without a patch, or the other way round, are left out; without training rows or with a single class it raises ValueError.
    """
    spark = patches.sparkSession
    known = labels.where((F.col("label") >= 0) & F.col("split").isin(train, validation))
    weights = F.lit(1.0)
    for column, wanted in (("label", how.class_weighted), ("country", how.region_weighted)):
        if wanted:
            # Weights come from the training rows; validation rows keep their own slice's.
            rows = [group_weights(known.where(F.col("split") == s), column, f"_w_{column}") for s in (train, validation)]
            known, weights = rows[0].unionByName(rows[1]), weights * F.col(f"_w_{column}")
    with steps(spark):
        rows = known.select("candidate_id", F.col("label").cast("int").alias("label"), "split", weights.alias("weight"))
        rows = write_table(_features(patches).join(rows, "candidate_id").withColumn("k", F.floor(uniform("candidate_id", F.lit("deal"), seed=how.seed) * (1 << 30)).cast("long")), "features")
        facts = rows.where(F.col("split") == train).groupBy("label").agg(F.count(F.lit(1)), F.max(F.size("x"))).collect()  # a row a class
        classes = sorted(r[0] for r in facts)
        if len(classes) < 2:
            raise ValueError(f"training needs two classes or more, not {classes}")
        size = max(r[2] for r in facts)
        moments = _summed(rows.where(F.col("split") == train).select("k", "x"), lambda f: _moments(f, size), 1 + 2 * size)
        mean = moments[1 : size + 1] / moments[0]
        scale = np.sqrt(np.maximum(moments[size + 1 :] / moments[0] - mean**2, 0))
        model = PatchModel.start(classes, mean, np.where(scale > 1e-9, scale, 1.0), how.hidden, how.seed)
        has_validation = not rows.where(F.col("split") == validation).isEmpty()
        return _descend(rows, model, how, train, validation if has_validation else train, history)


def _moments(frame: pd.DataFrame, size: int) -> np.ndarray:
    x = np.stack(frame["x"].to_numpy())
    return np.concatenate([[len(x)], x.sum(0), (x**2).sum(0)])


def _descend(rows: DataFrame, model: PatchModel, how: Training, train: str, watched: str, history: list[dict] | None) -> PatchModel:
    shapes = {n: a.shape for n, a in model.layers.items()}
    size = sum(a.size for a in model.layers.values())
    m, v, turn, best, least, waited = np.zeros(size), np.zeros(size), 0, copy.deepcopy(model), np.inf, 0
    known = {c: i for i, c in enumerate(model.classes)}
    for epoch in range(how.epochs + 1):
        for batch in range(how.batches if epoch < how.epochs else 1):  # the last turn only looks at the loss

            def work(frame: pd.DataFrame, model: PatchModel = model, epoch: int = epoch, batch: int = batch) -> np.ndarray:
                """Weight and loss of the watched slice (with the first batch), weight and gradients of the batch."""
                x, weight = np.stack(frame["x"].to_numpy()), frame["weight"].to_numpy(float)
                place = frame["label"].map(known)
                fine, slice_ = place.notna().to_numpy(), frame["split"].to_numpy()
                place = place.fillna(0).to_numpy(int)
                look = fine & (slice_ == watched) & (batch == 0)
                use = fine & (slice_ == train) & ((frame["k"].to_numpy() // (1 + epoch)) % how.batches == batch)
                steps_ = model.gradients(x[use], place[use], weight[use])
                return np.concatenate([[weight[look].sum(), model.loss(x[look], place[look], weight[look]), weight[use].sum()], *[steps_[n].ravel() for n in shapes]])

            sums = _summed(rows.select("k", "x", "label", "split", "weight"), work, 3 + size)
            if batch == 0:
                loss = sums[1] / max(sums[0], 1e-12)
                if history is not None:
                    history.append({"epoch": epoch, "loss": loss})
                best, least, waited = (copy.deepcopy(model), loss, 0) if loss < least - 1e-6 else (best, least, waited + 1)
                if waited > how.patience or epoch == how.epochs:
                    return best
            if sums[2] > 0:
                turn += 1
                flat = np.concatenate([model.layers[n].ravel() for n in shapes])
                g = sums[3:] / sums[2] + how.decay * flat
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                flat = flat - how.rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)
                ends = np.cumsum([int(np.prod(s)) for s in shapes.values()])[:-1]
                model = PatchModel(model.classes, model.mean, model.scale, {n: part.reshape(s) for (n, s), part in zip(shapes.items(), np.split(flat, ends), strict=True)})
    return best


def predictions(model: PatchModel, patches: DataFrame, labels: DataFrame) -> DataFrame:
    """labels (known ones) with predicted_label, the likeliest class, and loss, the cross entropy of the true one (of a class that the model doesn't know: that of a probability of 1e-12)."""
    probs = score_candidates(patches.join(labels.select("candidate_id").distinct(), "candidate_id", "left_semi"), model)
    classes = F.array(*[F.lit(c) for c in model.classes])
    out = labels.where("label >= 0").join(probs, "candidate_id")
    place = F.array_position(classes, F.col("label").cast("int"))
    p = F.when(place > 0, F.try_element_at("probs", place.cast("int"))).otherwise(0.0)
    return out.withColumn("predicted_label", F.get(classes, F.array_position("probs", F.array_max("probs")).cast("int") - 1)).withColumn("loss", -F.log(F.greatest(p, F.lit(1e-12)))).drop("probs")


def slice_rates(predicted: DataFrame, keys: Sequence[str] = ("split", "country")) -> DataFrame:
    """n, loss, accuracy and macro precision, recall and f1 for every value of the first key, and, with the others, of all keys (null: all)."""
    out = None
    for some in dict.fromkeys((tuple(keys[:1]), tuple(keys))):
        rates = multiclass_metrics(predicted.withColumn("label", F.col("label").cast("int")), *some, true="label", pred="predicted_label")
        sums = predicted.groupBy(*some).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("loss"), 6).alias("loss"))
        part = sums.join(rates, list(some)).select(*[F.col(k) if k in some else F.lit(None).cast("string").alias(k) for k in keys], "n", "loss", "accuracy", "precision", "recall", "f1")
        out = part if out is None else out.unionByName(part)
    return out
