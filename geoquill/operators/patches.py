"""Image patches as rows (candidate_id, n_channels, height, width, data), data channel by channel: scaling, cropping, augmentation, scoring, fitting."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def channel_subset(wanted: Sequence[str], bands: Sequence[str], indices: Sequence[str]) -> tuple[list[int], int]:
    """Places of the wanted channels among bands then indices, and how many of them are bands."""
    every = [*bands, *indices]
    missing = [c for c in wanted if c not in every]
    if missing:
        raise ValueError(f"unknown channels: {missing}")
    return [every.index(c) for c in wanted], sum(c in bands for c in wanted)


def take_channels(df: DataFrame, places: Sequence[int]) -> DataFrame:
    size = F.col("height") * F.col("width")
    parts = [F.slice("data", size * k + 1, size) for k in places]
    return df.withColumns({"data": F.concat(*parts), "n_channels": F.lit(len(places))})


def band_stack(left: DataFrame, right: DataFrame) -> DataFrame:
    """Channels of both patches of each candidate, left before right."""
    r = right.select("candidate_id", F.col("data").alias("_data"), F.col("n_channels").alias("_n"))
    return left.join(r, "candidate_id").withColumns({"data": F.concat("data", "_data"), "n_channels": F.col("n_channels") + F.col("_n")}).drop("_data", "_n")


def scale_patch(n_bands: int, by: float = 10000.0) -> Column:
    """NaN becomes 0 and the first n_bands channels are divided."""
    edge = F.col("height") * F.col("width") * n_bands
    return F.transform("data", lambda x, i: F.when(F.isnan(x), 0.0).otherwise(F.when(i < edge, x / by).otherwise(x)))


def clear_fraction(column: str = "data") -> Column:
    """1 less the share of NaN, to 4 decimals."""
    bad = F.aggregate(column, F.lit(0), lambda a, x: a + F.isnan(x).cast("int"))
    return F.round(1 - bad / F.size(column), 4)


def centre_crop(df: DataFrame, size: int) -> DataFrame:
    """The middle size x size pixels of every channel; smaller patches stay as they are."""
    top, left = F.floor((F.col("height") - size) / 2), F.floor((F.col("width") - size) / 2)
    rows = F.transform(F.sequence(F.lit(0), F.col("n_channels") * size - 1), lambda k: F.slice("data", (F.floor(k / size) * F.col("height") * F.col("width") + (top + k % size) * F.col("width") + left + 1).cast("int"), size))
    fits = (F.col("height") >= size) & (F.col("width") >= size)
    cut = F.when(fits, F.flatten(rows)).otherwise(F.col("data"))
    return df.withColumns({"data": cut, "height": F.when(fits, size).otherwise(F.col("height")), "width": F.when(fits, size).otherwise(F.col("width"))})


def band_means(df: DataFrame) -> DataFrame:
    """candidate_id, channel, mean."""
    size = F.col("height") * F.col("width")
    mean = lambda k: F.aggregate(F.slice("data", (k * size + 1).cast("int"), size), F.lit(0.0), lambda a, x: a + x.cast("double")) / size
    return df.select("candidate_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n_channels") - 1), mean)).alias("channel", "mean"))


def band_stats(means: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Mean and population deviation of the per-patch means, by group and channel."""
    return means.join(groups, "candidate_id").groupBy(key, "channel").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("mean"), 6).alias("mean"), F.round(F.stddev_pop("mean"), 6).alias("std"))


# Grids, paths and hashes.
def utm_zone(lng: str = "lng", lat: str = "lat") -> Column:
    """EPSG code of a point's UTM zone."""
    zone = F.least(F.greatest(F.floor((F.col(lng) + 180) / 6) + 1, F.lit(1)), F.lit(60)).cast("int")
    return F.when(F.col(lat) >= 0, 32600 + zone).otherwise(32700 + zone)


def utm_grid(lat: str = "lat", lng: str = "lng") -> Column:
    """Struct of epsg, easting and northing on WGS 84 by the Krueger series to third order."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    big = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    zone = F.pmod(utm_zone(lng, lat), F.lit(100))
    phi, lam = F.radians(lat), F.radians(F.col(lng) - (zone * 6 - 183))
    e = 2 * math.sqrt(n) / (1 + n)
    atanh = lambda x: F.log((1 + x) / (1 - x)) / 2
    t = F.sinh(atanh(F.sin(phi)) - e * atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east = eta + sum((c * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, c in enumerate(alpha)), F.lit(0.0))
    north = xi + sum((c * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, c in enumerate(alpha)), F.lit(0.0))
    return F.struct(utm_zone(lng, lat).alias("epsg"), (500000 + 0.9996 * big * east).alias("easting"), (F.when(F.col(lat) < 0, 10_000_000.0).otherwise(0.0) + 0.9996 * big * north).alias("northing"))


def patch_bbox(extent_m: float, lat: str = "lat", lng: str = "lng") -> Column:
    half = extent_m / 2 / 111_000
    return F.struct((F.col(lng) - half).alias("min_lon"), (F.col(lat) - half).alias("min_lat"), (F.col(lng) + half).alias("max_lon"), (F.col(lat) + half).alias("max_lat"))


def patch_path(digest: str) -> Column:
    named = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", "_").otherwise(F.col(c))
    return F.concat(F.concat_ws("/", named("country"), named("state"), F.lit(digest), F.col("candidate_id")), F.lit(".npy"))


def config_hash(config: dict, digits: int = 12) -> str:
    """First digits of the sha256 of the config as JSON with sorted keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:digits]


def same_imagery(registry: DataFrame, digest: str) -> DataFrame:
    return registry.where(F.col("imagery_config_hash") == digest)


# Augmentation.
@dataclass(frozen=True)
class Augment:
    """Steps, in this order; probabilities and sizes of 0 leave a step out."""

    h_flip: float = 0.5
    v_flip: float = 0.5
    rot90: bool = True
    rotate_deg: float = 0.0
    crop: tuple[float, float] | None = None
    brightness: float = 0.0
    band_jitter: float = 0.0
    noise: float = 0.0
    channel_dropout: float = 0.0
    cutout: int = 0
    n_bands: int = 3


def _sampled(a: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bilinear values of (C, H, W) at float positions, edges repeated."""
    h, w = a.shape[1:]
    y, x = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1, fy, fx = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1), y - y0, x - x0
    return (a[:, y0, x0] * (1 - fx) + a[:, y0, x1] * fx) * (1 - fy) + (a[:, y1, x0] * (1 - fx) + a[:, y1, x1] * fx) * fy


class Draws:
    """Random numbers from 0 to 1 by name, which depend on seed, candidate and epoch alone: those of `lookups.uniform`, so that other engines can tell them."""

    def __init__(self, seed: int, candidate: object, epoch: int) -> None:
        self.seed, self.place = seed, f"{candidate}:{epoch}"

    def __call__(self, name: str) -> float:
        return int(hashlib.md5(f"{self.place}:{name}:{self.seed}".encode()).hexdigest()[:8], 16) / 4294967296.0

    def between(self, name: str, low: float, high: float) -> float:
        return low + (high - low) * self(name)

    def normal(self, name: str, scale: float, shape: tuple[int, ...]) -> np.ndarray:
        return np.random.default_rng(int(self(name) * 4294967296)).normal(0, scale, shape)


def augmented(a: np.ndarray, how: Augment, draws: Draws) -> np.ndarray:
    a = a.astype(float)
    c, h, w = a.shape
    b = min(how.n_bands, c)
    if draws("h_flip") < how.h_flip:
        a = a[:, :, ::-1]
    if draws("v_flip") < how.v_flip:
        a = a[:, ::-1]
    if how.rot90 and h == w:
        a = np.rot90(a, int(draws("rot90") * 4), (1, 2))
    yy, xx = np.mgrid[0:h, 0:w].astype(float)
    if how.rotate_deg:
        t = np.deg2rad(draws.between("rotate", -how.rotate_deg, how.rotate_deg))
        y, x = yy - (h - 1) / 2, xx - (w - 1) / 2
        a = _sampled(a, y * np.cos(t) - x * np.sin(t) + (h - 1) / 2, y * np.sin(t) + x * np.cos(t) + (w - 1) / 2)
    if how.crop:
        s = draws.between("crop", *how.crop)
        a = _sampled(a, draws("crop_y") * (1 - s) * (h - 1) + yy * s, draws("crop_x") * (1 - s) * (w - 1) + xx * s)
    a = np.array(a)
    if how.brightness:
        a[:b] *= 1 + draws.between("brightness", -how.brightness, how.brightness)
    if how.band_jitter:
        a[:b] *= np.array([1 + draws.between(f"jitter{k}", -how.band_jitter, how.band_jitter) for k in range(b)])[:, None, None]
    if how.noise:
        a[:b] += draws.normal("noise", how.noise, a[:b].shape)
    if how.channel_dropout:
        a[np.array([draws(f"drop{k}") < how.channel_dropout for k in range(c)])] = 0
    if how.cutout:
        y, x = int(draws("cut_y") * h), int(draws("cut_x") * w)
        a[:, y : y + how.cutout, x : x + how.cutout] = 0
    a[:b] = np.clip(a[:b], 0, 1)
    a[b:] = np.clip(a[b:], -1, 1)
    return a.astype(np.float32)


def augment_patches(df: DataFrame, how: Augment, seed: int, epoch: int = 0) -> DataFrame:
    """Patches after the toggled steps; the same for the same seed, candidate and epoch, in any partitioning."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for i, c, h, w, d in zip(frame["candidate_id"], frame["n_channels"], frame["height"], frame["width"], frame["data"], strict=True):
                out.append(augmented(np.asarray(d, np.float32).reshape(c, h, w), how, Draws(seed, i, epoch)).ravel())
            yield frame.assign(data=out)

    kept = df.select("candidate_id", "n_channels", "height", "width", F.col("data").cast("array<float>").alias("data"))
    return kept.mapInPandas(work, kept.schema)


# Scoring and fitting.
def score_candidates(patches: DataFrame, load: Callable[[], Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """candidate_id and probs. load gives predict((n, C, H, W)) -> (n, classes) and is called once per task."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = load()
        for frame in frames:
            for (c, h, w), part in frame.groupby(["n_channels", "height", "width"]):
                batch = np.stack([np.asarray(d, np.float32) for d in part["data"]]).reshape(-1, c, h, w)
                yield pd.DataFrame({"candidate_id": part["candidate_id"].to_numpy(), "probs": list(np.asarray(predict(batch), float))})

    kept = patches.select("candidate_id", "n_channels", "height", "width", "data")
    kind = dict(kept.dtypes)["candidate_id"]
    return kept.mapInPandas(work, f"candidate_id {kind}, probs array<double>")


class LinearScorer:
    """Softmax of channel means times fixed weights: the smallest scorer that score_candidates takes."""

    def __init__(self, weights: Sequence[Sequence[float]]) -> None:
        self.weights = np.asarray(weights, float)

    def __call__(self) -> Callable[[np.ndarray], np.ndarray]:
        return self.predict

    def predict(self, batch: np.ndarray) -> np.ndarray:
        z = batch.astype(float).mean((2, 3)) @ self.weights
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


    def save(self, spark: SparkSession, path: str) -> None:
        """One row for each channel, in order."""
        spark.createDataFrame([(k, list(map(float, w))) for k, w in enumerate(self.weights)], "channel int, weights array<double>").write.mode("overwrite").parquet(path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> LinearScorer:
        return cls([r["weights"] for r in spark.read.parquet(path).orderBy("channel").collect()])  # one row a channel


def scored_candidates(
    patches: DataFrame, load: Callable[[], Callable[[np.ndarray], np.ndarray]], candidates: DataFrame, splits: DataFrame | None, labelled: bool = False, without_split: str = "unknown", threshold: float = 0.5,
) -> DataFrame:
    """Patches of the candidates (candidate_id, label, country, ord: the last row of an id counts) with predicted_score, predicted_label, confidence_tier, probs (of all classes), true_label
    and country, and split. labelled: those of known label alone. Candidates without a split, or all where there are no splits, get `without_split`."""
    from geoquill.functions.labels import confidence_tier, labeled_only, predict_label
    from geoquill.operators.lookups import lookup

    wanted = labeled_only(candidates) if labelled else candidates
    scored = score_candidates(patches.join(wanted.select("candidate_id").distinct(), "candidate_id", "left_semi"), load).withColumn("_p", predict_label(F.col("probs"), threshold))
    out = scored.select("candidate_id", F.col("_p.score").alias("predicted_score"), F.col("_p.label").alias("predicted_label"), "probs").withColumn("confidence_tier", confidence_tier("predicted_score"))
    out = lookup(out, wanted, "candidate_id", {"label": -1, "country": ""}, "ord").withColumnRenamed("label", "true_label")
    if splits is None:
        return out.withColumn("split", F.lit(without_split))
    return out.join(splits.groupBy("candidate_id").agg(F.max("split").alias("split")), "candidate_id", "left").withColumn("split", F.coalesce("split", F.lit("unknown")))
