"""Pixel tables: composites, spectral indices, masks, opening, components and their geometry.

A pixel table has tile_id, row, col and bands. Opening and labelling work on one block of tiles at a time, of BLOCK pixels a side at most or else one tile, so a group is bounded and small tiles cost no group each. Tiles are
numbered row by row, `across` of them in a row. For opening each block first gets a halo, the pixels of its neighbours that can matter to it, so borders leave no trace; components that touch across blocks are joined
afterwards as a graph of border pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoquill.operators.graphs import least_labels
from geoquill.operators.lookups import cap_per_group
from geoquill.operators.spatial import dedup_proximity
from geoquill.sources.tables import write_table

BANDS = ("b2", "b3", "b4", "b8", "b11", "b12")
M = 111_000.0
#: Side of a block of tiles, in pixels.
BLOCK = 256


def composite_median(obs: DataFrame, start: str, end: str, max_cloud: float, bands: Sequence[str] = BANDS) -> DataFrame:
    """Exact median of each band and pixel over the observations in [start, end) below the cloud limit."""
    kept = obs.where((F.col("obs_ts") >= start) & (F.col("obs_ts") < end) & (F.col("cloud_pct") < max_cloud))
    return kept.groupBy("tile_id", "row", "col").agg(*[F.median(b).alias(b) for b in bands])


def normalised(a: str, b: str) -> Column:
    """(a - b) / (a + b); null where the sum is 0."""
    return (F.col(a) - F.col(b)) / F.nullif(F.col(a) + F.col(b), F.lit(0))


def spectral_indices(df: DataFrame) -> DataFrame:
    return df.withColumns({"ndvi": normalised("b8", "b4"), "ndbi": normalised("b11", "b8"), "ndwi": normalised("b3", "b8"), "mndwi": normalised("b3", "b11"), "brightness": (F.col("b4") + F.col("b3") + F.col("b2")) / 3, "swir": F.col("b11").cast("double")})


def mask_ndbi(built: float = 0.0, green: float = 0.3, water: float = 0.1) -> Column:
    return F.coalesce((F.col("ndbi") > built) & (F.col("ndvi") < green) & (F.col("ndwi") < water) & (F.col("mndwi") < water), F.lit(False))


def mask_metal_roof(bright: float = 1500, green: float = 0.25, swir: float = 1500) -> Column:
    return F.coalesce((F.col("brightness") > bright) & (F.col("ndvi") < green) & (F.col("swir") > swir) & (F.col("mndwi") < 0.1), F.lit(False))


def mask_landcover(obs: DataFrame, built: int, column: str = "landcover") -> DataFrame:
    """Pixels whose most frequent class, the least of equals, is the built one. A null class, of equals, is the least; where it is chosen the mask is null.

    Integer classes of up to 32 bits are ordered with their count in one long, which is aggregated by hash; a struct would have all counts sorted.
    """
    n = obs.groupBy("tile_id", "row", "col", column).agg(F.count(F.lit(1)).alias("n"))
    if not isinstance(obs.schema[column].dataType, (T.ByteType, T.ShortType, T.IntegerType)):
        return n.groupBy("tile_id", "row", "col").agg((F.min_by(column, F.struct(-F.col("n"), F.col(column))) == built).alias("mask"))
    place = F.coalesce(F.col(column).cast("long") + (1 << 31) + 1, F.lit(0).cast("long"))
    first = n.groupBy("tile_id", "row", "col").agg(F.pmod(F.min(place - F.col("n") * (1 << 33)), F.lit(1 << 33)).alias("place"))
    return first.select("tile_id", "row", "col", F.when(F.col("place") > 0, F.col("place") == built + (1 << 31) + 1).alias("mask"))


def mask_sar(obs: DataFrame, threshold: float, column: str = "vv_db") -> DataFrame:
    """Pixels whose median lies above the threshold, from counts: more values above it than not, or, of as many, a mean of the middle two above it. No pixel's values are kept."""
    above = F.col(column) > threshold
    sums = obs.groupBy("tile_id", "row", "col").agg(
        F.count(column).alias("n"), F.count_if(above).alias("high"), F.max(F.when(~above, F.col(column))).cast("double").alias("lower"), F.min(F.when(above, F.col(column))).cast("double").alias("upper"),
    )
    twice, middle = 2 * F.col("high"), F.col("lower") + (F.col("upper") - F.col("lower")) * 0.5
    return sums.select("tile_id", "row", "col", F.when(F.col("n") > 0, F.when(twice == F.col("n"), middle > threshold).otherwise(twice > F.col("n"))).alias("mask"))


def detect_footprints(buildings: DataFrame, least: float, most: float, confidence: float) -> DataFrame:
    """Footprints by confidence and area, with length, width and aspect ratio where the table has them."""
    out = buildings.where((F.col("confidence") >= confidence) & F.col("area_m2").between(least, most)).withColumn("source", F.lit("GoogleOpenBuildings"))
    if {"side_a_m", "side_b_m"} <= set(out.columns):
        long, short = F.greatest("side_a_m", "side_b_m"), F.least("side_a_m", "side_b_m")
        out = out.withColumns({"length_m": long, "width_m": short, "aspect_ratio": long / (short + 0.001)})
    return out


def _disc(radius: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j <= radius * radius]


def opened(mask: np.ndarray, radius: int, there: np.ndarray | None = None) -> np.ndarray:
    """Least, then greatest, over a disc; what lies beyond the edge or isn't there doesn't count."""
    there = np.ones(mask.shape, bool) if there is None else there

    def sweep(a: np.ndarray, pick: Callable, fill: bool) -> np.ndarray:
        h, w = a.shape
        wide = np.pad(a, radius, constant_values=fill)
        return pick.reduce([wide[radius + i : radius + i + h, radius + j : radius + j + w] for i, j in _disc(radius)])

    if radius <= 0:
        return mask & there
    return sweep(sweep(mask | ~there, np.logical_and, True) & there, np.logical_or, False) & there


def block_of(tile: tuple[int, int], across: int) -> tuple[tuple[int, int], int]:
    """Sides of a block, in pixels, which are whole tiles; and the number of blocks in a row of the map."""
    high, wide = (max(BLOCK // n, 1) for n in tile)
    wide = min(wide, across)
    return (high * tile[0], wide * tile[1]), -(-across // wide)


def with_halo(pixels: DataFrame, reach: int, tile: tuple[int, int], across: int, *columns: str) -> DataFrame:
    """Pixels sent to every block that they are in or at most `reach` away from: target (a block), own (whether it is the pixel's), tile_id, row, col, gr, gc (place on the whole map) and columns.

    Only pixels near a border are sent more than once. Blocks beyond the map's sides are no targets.
    """
    block, n = block_of(tile, across)
    gr, gc = F.floor(F.col("tile_id") / across) * tile[0] + F.col("row"), F.pmod("tile_id", F.lit(across)) * tile[1] + F.col("col")
    placed = pixels.select("tile_id", "row", "col", *columns).withColumns({"gr": gr.cast("long"), "gc": gc.cast("long")})
    at = lambda c, side: F.floor(c / side).cast("long")
    rows = F.sequence(F.greatest(at(F.col("gr") - reach, block[0]), F.lit(0).cast("long")), at(F.col("gr") + reach, block[0]))
    cols = F.sequence(F.greatest(at(F.col("gc") - reach, block[1]), F.lit(0).cast("long")), F.least(at(F.col("gc") + reach, block[1]), F.lit(n - 1).cast("long")))
    spread = placed.withColumn("target", F.explode(F.flatten(F.transform(rows, lambda r: F.transform(cols, lambda c: r * n + c)))))
    return spread.withColumn("own", F.col("target") == at(F.col("gr"), block[0]) * n + at(F.col("gc"), block[1]))


def morphological_open(masks: DataFrame, radius: int, tile: tuple[int, int], across: int) -> DataFrame:
    """masks (tile_id, row, col, mask) after opening by a disc over the whole map, as if it weren't cut in tiles: pixels without a row don't count. A null mask is false.

    An opened pixel depends on the pixels within twice the radius, so each block of tiles gets a halo as wide, works on it and gives back its own pixels.
    """
    columns = masks.select(F.col("tile_id").cast("long").alias("tile_id"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.coalesce("mask", F.lit(False)).alias("mask"))
    if radius <= 0:
        return columns

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        r, c = frame["gr"].to_numpy(), frame["gc"].to_numpy()
        r, c = r - r.min(), c - c.min()
        mask, there = np.zeros((r.max() + 1, c.max() + 1), bool), np.zeros((r.max() + 1, c.max() + 1), bool)
        mask[r, c], there[r, c] = frame["mask"].to_numpy(bool), True
        done = frame[["tile_id", "row", "col"]].assign(mask=opened(mask, radius, there)[r, c])
        return done[frame["own"].to_numpy(bool)]

    spread = with_halo(columns, 2 * radius, tile, across, "mask").select("target", "own", "tile_id", "row", "col", "gr", "gc", "mask")
    return spread.groupBy("target").applyInPandas(work, "tile_id long, row int, col int, mask boolean")


def labelled(mask: np.ndarray) -> np.ndarray:
    """Component of each true pixel, 8-connected, as the least flat index in it; -1 elsewhere.

    Two passes over runs: runs of true pixels in a row are tied to those they touch in the row above, and then each is named after the least run that it is tied to.
    """
    h, w = mask.shape
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1] - 1
    # Places on one line, with room between rows so that no run touches another row's.
    from_, to = row * (w + 2) + start, row * (w + 2) + end
    first = np.searchsorted(to, from_ - (w + 2) - 1, side="left")
    last = np.searchsorted(from_, to - (w + 2) + 1, side="right")
    root = list(range(len(row)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for k, (a, b) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
        for other in range(a, b):
            x, y = find(k), find(other)
            if x != y:
                root[max(x, y)] = min(x, y)
    name = np.array([find(k) for k in range(len(row))], np.int64)
    out = np.full(h * w, -1, np.int64)
    size = end - start + 1
    flat = np.repeat(row * w + start - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum()) if len(row) else np.zeros(0, np.int64)
    out[flat] = np.repeat((row * w + start)[name], size) if len(row) else 0
    return out.reshape(h, w)


def vectorize_mask(masks: DataFrame, tile_rows: int, tile_cols: int, tiles_across: int) -> DataFrame:
    """tile_id, row, col, gr, gc, component of the true pixels. A component's name is its least pixel on the whole map, counted row by row.

    Blocks of tiles are labelled by themselves; a border pixel that touches one of another block ties their names, and names are joined in rounds that grow with the logarithm of the number of blocks that a component runs through.
    """
    width, (block, n) = tiles_across * tile_cols, block_of((tile_rows, tile_cols), tiles_across)

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        r, c = frame["gr"].to_numpy(), frame["gc"].to_numpy()
        r0, c0 = r.min(), c.min()
        grid = np.zeros((r.max() - r0 + 1, c.max() - c0 + 1), bool)
        grid[r - r0, c - c0] = True
        k = labelled(grid)[r - r0, c - c0]  # the least place in the block's grid is also the least on the map
        return frame.assign(name=(k // grid.shape[1] + r0) * width + k % grid.shape[1] + c0)

    at = lambda c, side: F.floor(F.col(c) / side).cast("long")
    whole = masks.where("mask").select(F.col("tile_id").cast("long").alias("tile_id"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"))
    gr, gc = F.floor(F.col("tile_id") / tiles_across) * tile_rows + F.col("row"), F.pmod("tile_id", F.lit(tiles_across)) * tile_cols + F.col("col")
    whole = whole.withColumns({"gr": gr.cast("long"), "gc": gc.cast("long")}).withColumn("block", at("gr", block[0]) * n + at("gc", block[1]))
    named = write_table(whole.groupBy("block").applyInPandas(work, "tile_id long, row int, col int, gr long, gc long, block long, name long"), "pixels")
    side = lambda c, k: F.pmod(c, F.lit(k)).isin(0, k - 1)
    edge = named.where(side("gr", block[0]) | side("gc", block[1]))
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
    probe = edge.select(F.col("name").alias("a"), "block", "gr", "gc", F.explode(near).alias("s")).select("a", "block", (F.col("gr") + F.col("s.i")).alias("gr"), (F.col("gc") + F.col("s.j")).alias("gc"))
    other = edge.select(F.col("name").alias("b"), F.col("block").alias("block_b"), "gr", "gc")
    pairs = probe.join(other, ["gr", "gc"]).where(F.col("block") != F.col("block_b")).select("a", "b")
    return named.join(least_labels(pairs), "name", "left").select("tile_id", "row", "col", "gr", "gc", F.coalesce("comp", "name").alias("component"))


def geometry_properties(pixels: DataFrame, cell_deg: float, origin: tuple[float, float], cos_lat: float) -> DataFrame:
    """Per component: area, box length and width in metres, aspect ratio (width at least 0.1) and centroid. Pixels have gr, gc and component."""
    lon0, lat0 = origin
    high = (F.max("gr") - F.min("gr") + 1) * cell_deg * M
    wide = (F.max("gc") - F.min("gc") + 1) * cell_deg * M * cos_lat
    per = pixels.groupBy("component").agg(
        F.count(F.lit(1)).alias("n_pixels"), high.alias("_h"), wide.alias("_w"),
        (lon0 + (F.avg("gc") + 0.5) * cell_deg).alias("centroid_lon"), (lat0 + (F.avg("gr") + 0.5) * cell_deg).alias("centroid_lat"),
    )
    long, short = F.greatest("_h", "_w"), F.least("_h", "_w")
    return per.select("component", "n_pixels", (F.col("n_pixels") * (cell_deg * M) ** 2 * cos_lat).alias("area_m2"), long.alias("length_m"), short.alias("width_m"), (long / F.greatest(short, F.lit(0.1))).alias("aspect_ratio"), "centroid_lon", "centroid_lat")


def _from_composite(mask: Callable[..., Column]) -> Callable[..., DataFrame]:
    def method(obs: DataFrame, start: str = "1990-01-01", end: str = "2100-01-01", max_cloud: float = 101, **limits: float) -> DataFrame:
        return spectral_indices(composite_median(obs, start, end, max_cloud)).select("tile_id", "row", "col", mask(**limits).alias("mask"))

    return method


#: Detection methods by name: (pixel observations, options by name) -> masks (tile_id, row, col, mask). Optical ones take the composite's dates and cloud limit, and all the limits of their mask.
METHODS: dict[str, Callable[..., DataFrame]] = {
    "ndbi": _from_composite(mask_ndbi), "metal_roof": _from_composite(mask_metal_roof),
    "landcover": lambda obs, built=6, column="landcover": mask_landcover(obs, built, column), "sar": lambda obs, threshold=-12.0, column="vv_db": mask_sar(obs, threshold, column),
}


def _optical(obs: DataFrame, options: dict) -> DataFrame:
    bands = tuple(options.get("bands", BANDS))
    start, end = options.get("date_range", ("1990-01-01", "2100-01-01"))
    composite = spectral_indices(composite_median(obs, start, end, options.get("max_cloud_cover", 101)))
    return composite.select("tile_id", "row", "col", *bands, *options.get("indices", ()))


def _radar(obs: DataFrame, options: dict) -> DataFrame:
    bands = tuple(options.get("bands", ("vv_db",)))
    return obs.groupBy("tile_id", "row", "col").agg(*[F.median(b).alias(b) for b in bands])


#: Imagery by the name of its provider: (pixel observations, options) -> one row a pixel with the provider's bands.
IMAGERY_PROVIDERS: dict[str, Callable[[DataFrame, dict], DataFrame]] = {"earth_engine_s2": _optical, "earth_engine_s1": _radar}


def imagery(obs: DataFrame, sources: Sequence[dict]) -> DataFrame:
    """The bands of all sources, side by side for each pixel. A source names its provider, earth_engine_s2 where it doesn't, and the provider's options."""
    out = None
    for source in sources:
        name = source.get("provider", "earth_engine_s2")
        if name not in IMAGERY_PROVIDERS:
            raise ValueError(f"unknown imagery provider {name!r}; known: {sorted(IMAGERY_PROVIDERS)}")
        part = IMAGERY_PROVIDERS[name](obs, {k: v for k, v in source.items() if k != "provider"})
        out = part if out is None else out.join(part, ["tile_id", "row", "col"], "full")
    return out


def run_tiles(
    obs: DataFrame, methods: Sequence[str], tile: tuple[int, int], across: int, cell_deg: float, origin: tuple[float, float], cos_lat: float, radius: int = 0, least: float = 0.0, most: float = float("inf"),
    cap: int | None = None, dedup_m: float | None = None, options: dict[str, dict] | None = None,
) -> DataFrame:
    """Detections of each method, with its options: mask, opening across tile borders, components, geometry, area filter; the first `cap` of each tile and method by component; and, over all methods, those that
    no earlier detection (by method, then component) is nearer to than dedup_m. With lat, lng, tile (of the centroid) and ord, the place in that order."""
    out = None
    for at, name in enumerate(methods):
        mask = METHODS[name](obs, **(options or {}).get(name, {}))
        found = vectorize_mask(morphological_open(mask, radius, tile, across) if radius else mask, *tile, across)
        rows = geometry_properties(found, cell_deg, origin, cos_lat).where(F.col("area_m2").between(least, most)).withColumns({"source": F.lit(name), "ord": F.lit(at).cast("long") * (1 << 40) + F.col("component")})
        out = rows if out is None else out.unionByName(rows)
    place = lambda c, o, n: F.floor((F.col(c) - o) / (cell_deg * n))
    out = out.withColumns({"lat": F.col("centroid_lat"), "lng": F.col("centroid_lon"), "tile": place("centroid_lat", origin[1], tile[0]) * across + place("centroid_lon", origin[0], tile[1])})
    if cap is not None:
        out = cap_per_group(out, ["source", "tile"], cap, "component")
    return out if dedup_m is None else dedup_proximity(out, dedup_m)
