"""Spatial joins on points: nearest within a radius, far-from filters, matches, first-wins dedup, box lookup and tiles.

A distance test alone would be planned as a nested-loop join, so points are put in grid cells at least one radius wide: one
side goes to its own cell and the other to the nine around it, and the join is on the cell with the distance left to test. Semi joins stop at a point's first match; where the nearest of many is wanted, cells are
halved until few points are left in each. Metres are degrees times 111000, longitudes also times the cosine of the latitude that each operator names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoquill.sources.tables import kept, steps, write_table

M = 111_000.0
EARTH = 6_371_000.0
REGISTRY_BOUND = 10_000
#: Reference points of a cell that points are compared with one by one; fuller cells are halved, DEPTH times at most.
CELL_POINTS, DEPTH = 64, 20
#: Rows of a block that greedy dedup resolves in one task.
BLOCK_ROWS = 50_000
#: The nearest join tells distances apart by this part of a metre; its cosine has COS_STEP as its step.
STEP, COS_STEP = 1e4, 1e9
#: Metres by which cells are wider than the radius, and bounds looser, than rounding can matter.
SLACK = 1e-3


def small(df: DataFrame, bound: int = REGISTRY_BOUND) -> DataFrame:
    """Broadcast where the row count, which is checked, is within the bound; else left for the optimiser."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def around(cx: Column, cy: Column) -> Column:
    """The cell and its eight neighbours."""
    near = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    return F.flatten(F.transform(near, lambda i: F.transform(near, lambda j: F.struct((cx + i).alias("cx"), (cy + j).alias("cy")))))


def _points(df: DataFrame) -> DataFrame:
    return df.where(F.col("lat").isNotNull() & F.col("lng").isNotNull())


def nearest_within(
    left: DataFrame, right: DataFrame, radius: float, left_id: str, right_id: str, columns: tuple[str, ...] = (), most: int = CELL_POINTS, compared: list[int] | None = None,
) -> DataFrame:
    """Adds match_id, match_m (infinite where none is within the radius, which counts) and the match's columns, named match_*.

    One cosine, at the mean latitude of the reference points, to nine places. Distances that are equal to a tenth of a millimetre are a tie, which the least id wins: nearer than that, the last bits of places would decide. Of reference points at one spot only the least id is compared. Where no cell of the radius's size has more than `most` reference points left,
    a point is compared with those of its nine cells; otherwise cells are halved where they are full (`_close_cells`). compared: gets the number of pairs of points that the first join makes, of full cells only.
    """
    best = _nearest(left, right, radius, left_id, right_id, columns, most, compared)
    return left.join(best, left_id, "left").withColumn("match_m", F.coalesce("match_m", F.lit(float("inf"))))


def _nearest(left: DataFrame, right: DataFrame, radius: float, left_id: str, right_id: str, columns: tuple[str, ...] = (), most: int = CELL_POINTS, compared: list[int] | None = None) -> DataFrame:
    """left_id and match of the rows that have one, as `nearest_within` says, as a written table.

    Pairs of points are not sorted: a first join takes the least distance of each point and cell by hash, a second one the points of the cell that are so far.
    """
    named = [f"match_{c}" for c in columns]
    refs = _points(right).select(F.col(right_id).alias("match_id"), *[F.col(c).alias(f"match_{c}") for c in columns], F.col("lat").alias("rlat"), F.col("lng").alias("rlng"))
    k = refs.agg(F.floor(F.coalesce(F.cos(F.radians(F.avg("rlat"))), F.lit(1.0)) * COS_STEP + 0.5) / COS_STEP).first()[0]
    x, y, rx, ry = F.col("lng") * M * k, F.col("lat") * M, F.col("rlng") * M * k, F.col("rlat") * M
    spots = refs.groupBy("rlat", "rlng").agg(F.min(F.struct("match_id", *named)).alias("r")).select("r.*", "rlng", "rlat")
    own = _points(left).select(left_id, "lat", "lng")
    wide = radius + SLACK
    cell = lambda c, side: F.floor(c / side)
    dx, dy = (F.col("lng") - F.col("rlng")) * M * k, (F.col("lat") - F.col("rlat")) * M
    step = F.floor(F.col("match_m") * STEP + 0.5)

    def nearest(near: DataFrame, at: DataFrame) -> DataFrame:
        """left_id and the nearest of each cell (sx, sy) that the point is compared with, of those in its reach."""
        pairs = lambda rows: rows.join(at, ["sx", "sy"]).withColumn("match_m", F.sqrt(dx * dx + dy * dy)).where(F.col("match_m") <= radius)
        low = pairs(near).where(F.col("match_m") <= F.col("reach")).groupBy(left_id, "lat", "lng", "sx", "sy").agg(F.min(step).alias("step"))
        return pairs(low).where(step == F.col("step")).select(left_id, F.struct("step", "match_id", "match_m", *named).alias("b"))

    with steps(left.sparkSession) as made:
        if spots.groupBy(cell(rx, wide), cell(ry, wide)).count().where(F.col("count") > most).isEmpty():
            spread = spots.withColumn("c", F.explode(around(cell(rx, wide), cell(ry, wide)))).select(*spots.columns, F.col("c.cx").alias("sx"), F.col("c.cy").alias("sy"))
            found = nearest(own.withColumns({"sx": cell(x, wide), "sy": cell(y, wide), "reach": F.lit(wide)}), spread)
        else:
            spots, own = write_table(spots, "spots"), write_table(own.repartition(left_id), "own")
            found, pairs = None, 0
            for level, cells in _close_cells(own.select(x.alias("x"), y.alias("y")), spots.select(rx.alias("rx"), ry.alias("ry")), wide, most):
                side = wide / 2**level
                away = lambda c, at: F.greatest(F.col(c) * side - at, at - (F.col(c) + 1) * side, F.lit(0.0))  # noqa: B023, E731
                reach = F.least("bound", F.sqrt((x - F.col("px")) ** 2 + (y - F.col("py")) ** 2) + SLACK)
                near = own.withColumns({"qx": cell(x, side), "qy": cell(y, side)}).join(cells, ["qx", "qy"]).withColumn("reach", reach)
                near = near.where(F.sqrt(away("sx", x) ** 2 + away("sy", y) ** 2) <= F.col("reach"))
                if compared is not None:
                    pairs += near.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
                at = spots.withColumns({"sx": cell(rx, side), "sy": cell(ry, side)}).join(cells.select("sx", "sy").distinct(), ["sx", "sy"], "left_semi")
                part = nearest(near.select(left_id, "lat", "lng", "sx", "sy", "reach"), at)
                found = part if found is None else found.union(part)
            if compared is not None:
                compared.append(pairs)
        best = found.repartition(left_id).groupBy(left_id).agg(F.min("b").alias("b"))
        return kept(made, best.select(left_id, "b.match_id", "b.match_m", *[f"b.{c}" for c in named]), "nearest")


def _close_cells(own: DataFrame, spots: DataFrame, radius: float, most: int) -> list[tuple[int, DataFrame]]:
    """Pairs of cells, (qx, qy) of points (x, y) and (sx, sy) of reference points (rx, ry), that hold every nearest pair within the radius: a table for each level that has any, whose cells are radius / 2**level wide.

    A level starts with the pairs of the level before whose reference cell has more than `most` points, both cells cut in four. Of each reference cell one point is known, the nearest to its middle. The farthest that a cell's points can be from the nearest of these is the bound of their
    distances, which is handed down; cells that lie beyond it, or the radius, go. So rings are searched only as far as a nearer point can be, and cells, not points, are paired. Each pair comes with the bound, the reference cell's number n of points and the known point (px, py) that is nearest to the middle of the points' cell.
    """
    cell = lambda c, side: F.floor(F.col(c) / side)
    out, open_ = [], None
    for level in range(DEPTH + 1):
        side = radius / 2**level
        q = own.select(cell("x", side).alias("qx"), cell("y", side).alias("qy")).distinct()
        middle = lambda c, at: (F.col(c) - (F.col(at) + 0.5) * side) ** 2  # noqa: B023, E731
        s = spots.withColumns({"sx": cell("rx", side), "sy": cell("ry", side)}).withColumn("off", middle("rx", "sx") + middle("ry", "sy"))
        s = s.groupBy("sx", "sy").agg(F.count(F.lit(1)).alias("n"), F.min_by("rx", "off").alias("px"), F.min_by("ry", "off").alias("py"))  # both of one row: they compare alike
        if open_ is None:
            pairs = q.withColumn("c", F.explode(around(F.col("qx"), F.col("qy")))).select("qx", "qy", F.col("c.cx").alias("sx"), F.col("c.cy").alias("sy"), F.lit(float(radius)).alias("bound")).join(s, ["sx", "sy"])
        else:
            half = lambda c: F.floor(F.col(c) / 2)
            pairs = open_.select(F.col("qx").alias("tqx"), F.col("qy").alias("tqy"), F.col("sx").alias("tsx"), F.col("sy").alias("tsy"), "bound")
            pairs = pairs.join(q.withColumns({"tqx": half("qx"), "tqy": half("qy")}), ["tqx", "tqy"]).join(s.withColumns({"tsx": half("sx"), "tsy": half("sy")}), ["tsx", "tsy"])
        apart = lambda a, b: F.greatest(F.abs(F.col(a) - F.col(b)) - 1, F.lit(0)) * side  # noqa: B023, E731
        far = lambda c, at: F.greatest(F.col(c) - F.col(at) * side, (F.col(at) + 1) * side - F.col(c))  # noqa: B023, E731
        least = F.sqrt(apart("sx", "qx") ** 2 + apart("sy", "qy") ** 2)
        worst = F.sqrt(far("px", "qx") ** 2 + far("py", "qy") ** 2) + SLACK
        of_cell = Window.partitionBy("qx", "qy")  # a row a reference cell near the cell
        known = F.min(F.struct((middle("px", "qx") + middle("py", "qy")).alias("off"), "px", "py")).over(of_cell)
        pairs = pairs.withColumns({"bound": F.least("bound", F.min(worst).over(of_cell)), "known": known}).where(least <= F.col("bound"))
        pairs = write_table(pairs.select("qx", "qy", "sx", "sy", "n", "bound", "known.px", "known.py"), f"cells_{level}")
        done = F.lit(True) if level == DEPTH else F.col("n") <= most
        ready, left = pairs.agg(F.count_if(done), F.count_if(~done)).first()
        if ready or not (left or out):
            out.append((level, pairs.where(done)))
        open_ = pairs.where(~done)
        if not left:
            return out
    return out


def _near(points: DataFrame, refs: DataFrame, radius: float, inclusive: bool, how: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Semi or anti join of points to references within the radius, with the cosine at each point."""
    refs = _points(refs).select(*[F.col(k).alias(f"r_{k}") for k in keys], F.col("lat").alias("rlat"), F.col("lng").alias("rlng"))
    widest = F.broadcast(_points(points).agg(F.cos(F.radians(F.least(F.coalesce(F.max(F.abs("lat")), F.lit(0.0)), F.lit(89.0)))).alias("_cos")))  # one row; cells wide enough for the highest latitude
    names = points.columns
    tall, wide = radius / M, F.lit(radius / M) / F.col("_cos")
    own = points.crossJoin(widest).withColumns({"cx": F.floor(F.col("lng") / wide), "cy": F.floor(F.col("lat") / tall)})
    spread = refs.crossJoin(widest).withColumn("c", F.explode(around(F.floor(F.col("rlng") / wide), F.floor(F.col("rlat") / tall)))).select(*[f"r_{k}" for k in keys], "rlat", "rlng", F.col("c.cx").alias("rcx"), F.col("c.cy").alias("rcy"))
    far = F.sqrt(((F.col("rlat") - F.col("lat")) * M) ** 2 + ((F.col("rlng") - F.col("lng")) * M * F.cos(F.radians("lat"))) ** 2)
    on = (F.col("cx") == F.col("rcx")) & (F.col("cy") == F.col("rcy")) & (far <= radius if inclusive else far < radius)
    for k in keys:
        on = on & (F.col(k) == F.col(f"r_{k}"))
    return own.join(spread, on, how).select(*names)


def far_from(points: DataFrame, positives: DataFrame, least: float, keys: tuple[str, ...] = ("country",)) -> DataFrame:
    """Points at least `least` metres from every positive of the same keys."""
    return _near(points, positives, least, False, "left_anti", keys)


def matched(points: DataFrame, refs: DataFrame, radius: float) -> DataFrame:
    """Points nearer than the radius to some reference."""
    return _near(points, refs, radius, False, "left_semi")


def drop_near_existing(extra: DataFrame, existing: DataFrame, radius: float = 200.0) -> DataFrame:
    """Extra points further than the radius from all existing ones, in radians of latitude and longitude without a cosine."""
    step = radius / EARTH * 180 / 3.141592653589793
    refs = _points(existing).select(F.col("lat").alias("rlat"), F.col("lng").alias("rlng"))
    names = extra.columns
    own = extra.withColumns({"cx": F.floor(F.col("lng") / step), "cy": F.floor(F.col("lat") / step)})
    spread = refs.withColumn("c", F.explode(around(F.floor(F.col("rlng") / step), F.floor(F.col("rlat") / step)))).select("rlat", "rlng", F.col("c.cx").alias("rcx"), F.col("c.cy").alias("rcy"))
    far = F.sqrt((F.radians("rlat") - F.radians("lat")) ** 2 + (F.radians("rlng") - F.radians("lng")) ** 2) * EARTH
    return own.join(spread, (F.col("cx") == F.col("rcx")) & (F.col("cy") == F.col("rcy")) & (far <= radius), "left_anti").select(*names)


def validate_matches(candidates: DataFrame, known: DataFrame, radius: float = 200.0, method: str = "source") -> DataFrame:
    """Per method and combined: candidates, those near a known point, known points near one, precision, recall, f1."""
    n_known = known.agg(F.count(F.lit(1)).alias("known_total"))
    both = candidates.unionByName(candidates.withColumn(method, F.lit("combined")))
    near = matched(both, known, radius).groupBy(method).agg(F.count(F.lit(1)).alias("true_positives"))
    methods = candidates.select(method).distinct().union(candidates.sparkSession.createDataFrame([("combined",)], "m string"))
    probes = known.select(F.monotonically_increasing_id().alias("k"), "lat", "lng").crossJoin(small(methods))
    found = _near(probes, both, radius, False, "left_semi", (method,)).groupBy(method).agg(F.count(F.lit(1)).alias("known_matched"))
    out = both.groupBy(method).agg(F.count(F.lit(1)).alias("candidates")).join(near, method, "left").join(found, method, "left").na.fill(0).crossJoin(F.broadcast(n_known))
    p, r = F.try_divide("true_positives", "candidates"), F.try_divide("known_matched", "known_total")
    p, r = F.coalesce(p, F.lit(0.0)), F.coalesce(r, F.lit(0.0))
    return out.withColumns({"precision": F.round(p, 4), "recall": F.round(r, 4), "f1": F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 4)})


def _resolve(radius: float, key: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Greedy dedup of a block: its own rows that are kept, or that can't be decided here because an earlier row near them, which stands in the halo or depends on one that does, isn't."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(key, kind="stable")
        kept_at: dict[tuple[int, int], list[tuple[float, float, float]]] = {}
        open_at: dict[tuple[int, int], list[tuple[float, float, float]]] = {}
        state = []
        for lat, lng, cx, cy, own in zip(frame["lat"], frame["lng"], frame["cx"], frame["cy"], frame["own"], strict=True):

            def near(at: dict, lat: float = lat, lng: float = lng, cx: int = cx, cy: int = cy) -> bool:
                return any(
                    math.sqrt(((lat - y) * M) ** 2 + ((lng - x) * M * k) ** 2) < radius for i in (cx, cx - 1, cx + 1) for j in (cy, cy - 1, cy + 1) for y, x, k in at.get((i, j), ())
                )

            if near(kept_at):
                state.append(-1)
                continue
            open_here = not own or near(open_at)
            (open_at if open_here else kept_at).setdefault((cx, cy), []).append((lat, lng, math.cos(math.radians(lat))))
            state.append(0 if open_here else 1)
        frame = frame.assign(state=state, kept=[x == 1 for x in state])
        return frame.loc[frame["own"] & (frame["state"] >= 0), [key, "lat", "lng", "cx", "cy", "kept"]]

    return work


def _block_level(rows: DataFrame, most: int) -> tuple[int, int]:
    """The largest level, up to 20, of blocks 2**level cells wide of which none has more than `most` rows, 0 if there is none; and the most rows of a cell."""
    cells = rows.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n")).withColumn("level", F.explode(F.array(*[F.lit(k) for k in range(0, 21, 2)])))
    scale = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level"))
    full = cells.groupBy("level", F.floor(F.col("cx") / scale).alias("bx"), F.floor(F.col("cy") / scale).alias("by")).agg(F.sum("n").alias("n")).groupBy("level").agg(F.max("n").alias("n"))
    most_of = {r["level"]: r["n"] for r in full.collect()}
    return max([k for k, n in most_of.items() if n <= most], default=0), most_of.get(0, 0)


def dedup_proximity(df: DataFrame, radius: float, key: str = "ord", block_rows: int = BLOCK_ROWS, rounds: list[int] | None = None) -> DataFrame:
    """Greedy dedup: rows in order of `key`, a number that no two rows share; a row nearer than the radius to an earlier kept row goes (cosine at the kept row). Rows without a place stay.

    Rows at one spot are the first of them. The others stand in cells a radius wide, and cells in blocks as wide as leave no block more than `block_rows` rows. A task resolves a block in order, with a halo of the cells
    around it; what depends on an undecided row of the halo waits for the next round, whose blocks are shifted by half and, as fewer rows are left, wider. Where one cell alone has more rows than that, a round takes only
    rows up to the key that leaves it few enough: earlier rows never depend on later ones, and what is kept of them clears most of the cell. rounds: gets the number of rounds. A round is a written table; a lost executor costs tasks of one.
    """
    if radius <= 0:
        return df
    spots = _points(df).groupBy("lat", "lng").agg(F.min(key).alias(key))
    widest = F.broadcast(spots.agg(F.cos(F.radians(F.least(F.coalesce(F.max(F.abs("lat")), F.lit(0.0)), F.lit(89.0)))).alias("k")))  # one row
    tall, wide = radius / M, F.lit(radius / M) / F.col("k")
    far = F.sqrt(((F.col("lat") - F.col("klat")) * M) ** 2 + ((F.col("lng") - F.col("klng")) * M * F.cos(F.radians("klat"))) ** 2)
    with steps(df.sparkSession) as made:
        at = spots.crossJoin(widest).select(key, "lat", "lng", F.floor(F.col("lng") / wide).alias("cx"), F.floor(F.col("lat") / tall).alias("cy"))
        open_, found, turn = write_table(at, "undecided"), None, 0
        while True:
            level, fullest = _block_level(open_, block_rows)
            if not fullest:
                break
            turn += 1
            part, rest = open_, None
            if fullest > block_rows:
                hot = open_.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(key, F.array(*[F.lit(0.5**k) for k in range(1, 31)]), F.lit(10_000)).alias("q")).where(F.col("n") > block_rows)
                last = hot.select(F.get("q", F.greatest(F.ceil(F.log2(F.col("n") / block_rows)).cast("int") - 1, F.lit(0))).alias("last")).agg(F.min("last")).first()[0]
                part, rest = open_.where(F.col(key) <= last), open_.where(F.col(key) > last)
                level, _ = _block_level(part, block_rows)
            size = 1 << level
            shift = size // 2 if turn % 2 == 0 else 0
            block = lambda c: F.array_distinct(F.array(*[F.floor((F.col(c) + (d + shift)) / size) for d in (0, -1, 1)]))  # noqa: B023, E731
            spread = part.withColumn("bx", F.explode(block("cx"))).withColumn("by", F.explode(block("cy")))
            spread = spread.withColumn("own", (F.col("bx") == F.floor((F.col("cx") + shift) / size)) & (F.col("by") == F.floor((F.col("cy") + shift) / size)))
            schema = ", ".join(f"`{c}` {t}" for c, t in part.select(key, "lat", "lng", "cx", "cy").dtypes) + ", kept boolean"
            done = write_table(spread.groupBy("bx", "by").applyInPandas(_resolve(radius, key), schema), "resolved")
            new = done.where("kept")
            found = new.select(key) if found is None else found.union(new.select(key))
            left = done.where("not kept").drop("kept")
            left = left if rest is None else left.unionByName(rest)
            if left.isEmpty():
                break
            near = new.select(F.col("lat").alias("klat"), F.col("lng").alias("klng"), F.explode(around(F.col("cx"), F.col("cy"))).alias("c")).select("klat", "klng", F.col("c.cx").alias("kx"), F.col("c.cy").alias("ky"))
            on = (F.col("cx") == F.col("kx")) & (F.col("cy") == F.col("ky")) & (far < radius)
            open_ = write_table(left.join(near, on, "left_anti"), "undecided")
        if rounds is not None:
            rounds.append(turn)
        if found is None:
            return df
        first = kept(made, found, "kept")
    return df.join(first, key, "left_semi").unionByName(df.where(F.col("lat").isNull() | F.col("lng").isNull()))


def in_boxes(points: DataFrame, boxes: DataFrame, bound: int = REGISTRY_BOUND) -> DataFrame:
    """Points joined with the boxes (min_lon, min_lat, max_lon, max_lat) that hold them. Beyond the bound, boxes are dealt to grid cells about as large as a box, so the join stays an equi join."""
    inside = F.col("lng").between(F.col("min_lon"), F.col("max_lon")) & F.col("lat").between(F.col("min_lat"), F.col("max_lat"))
    if boxes.limit(bound + 1).count() <= bound:
        return points.join(F.broadcast(boxes), inside)
    size = F.broadcast(boxes.agg(F.greatest(F.avg(F.col("max_lon") - F.col("min_lon")), F.avg(F.col("max_lat") - F.col("min_lat")), F.lit(1e-3)).alias("_g")))  # one row
    cell = lambda c: F.floor(F.col(c) / F.col("_g"))
    dealt = boxes.crossJoin(size).withColumn("_cx", F.explode(F.sequence(cell("min_lon"), cell("max_lon")))).withColumn("_cy", F.explode(F.sequence(cell("min_lat"), cell("max_lat")))).drop("_g")
    own = points.crossJoin(size).withColumns({"_cx": cell("lng"), "_cy": cell("lat")}).drop("_g")
    return own.join(dealt, ["_cx", "_cy"]).where(inside).drop("_cx", "_cy")


def bbox_lookup(points: DataFrame, boxes: DataFrame, value: str, order: str, key: str, bound: int = REGISTRY_BOUND) -> DataFrame:
    """Adds the value of the first box, in registry order, that holds the point. boxes: min_lon, min_lat, max_lon, max_lat."""
    named = boxes.select(F.col(value).alias("_v"), F.col(order).alias("_o"), "min_lon", "min_lat", "max_lon", "max_lat")
    first = in_boxes(points.select(key, "lat", "lng"), named, bound)
    return points.join(first.groupBy(key).agg(F.min_by("_v", "_o").alias(value)), key, "left")


def tile_filter(points: DataFrame, boxes: DataFrame, key: str, bound: int = REGISTRY_BOUND) -> DataFrame:
    """Points inside any of the boxes."""
    hits = in_boxes(points.select(key, "lat", "lng"), boxes.select("min_lon", "min_lat", "max_lon", "max_lat"), bound).select(key).distinct()
    return points.join(hits, key, "left_semi")


def region_order(states: DataFrame, countries: DataFrame, state_country: str) -> DataFrame:
    """One registry of boxes for bbox_lookup: states (state, box) before countries (country_key, ord, box). value, place, box."""
    box = ("min_lon", "min_lat", "max_lon", "max_lat")
    first = states.select(F.concat(F.lit(f"{state_country}/"), "state").alias("value"), F.struct(F.lit(0).alias("kind"), F.lit(0).cast("long").alias("ord"), F.col("state").alias("name")).alias("place"), *box)
    return first.union(countries.select(F.col("country_key").alias("value"), F.struct(F.lit(1).alias("kind"), F.col("ord").cast("long").alias("ord"), F.col("country_key").alias("name")).alias("place"), *box))


def region_bounds(df: DataFrame, states: DataFrame, countries: DataFrame, state_country: str) -> DataFrame:
    """Adds the box of country_key and state: the state's where the country is `state_country` and the state is known, else the country's."""
    box = ("min_lon", "min_lat", "max_lon", "max_lat")
    s = states.select(F.lit(state_country).alias("country_key"), "state", *[F.col(c).alias(f"s_{c}") for c in box])
    c = countries.select("country_key", *[F.col(c).alias(f"c_{c}") for c in box])
    joined = df.join(s, ["country_key", "state"], "left").join(c, "country_key", "left")
    return joined.select(*df.columns, *[F.when(F.col("s_min_lon").isNotNull(), F.col(f"s_{x}")).otherwise(F.col(f"c_{x}")).alias(x) for x in box])


def generate_tiles(boxes: DataFrame, size: float, seeds: DataFrame | None = None, factor: float = 1.5, key: str = "country_key") -> DataFrame:
    """Tiles (key, i, j) of each box; with seeds only those whose zone, the tile's size times the factor around its centre, has one.

    With seeds, tiles are made from these: a seed names the few tiles whose zone can hold it, and no others are made, however fine the grid is.
    """
    n = lambda lo, hi: F.ceil((F.col(hi) - F.col(lo)) / size).cast("int") - 1
    side = lambda lo, hi, k: (F.col(lo) + F.col(k) * size, F.least(F.col(lo) + (F.col(k) + 1) * size, F.col(hi)))
    (x0, x1), (y0, y1) = side("min_lon", "max_lon", "i"), side("min_lat", "max_lat", "j")
    corners = {"tile_min_lon": x0, "tile_max_lon": x1, "tile_min_lat": y0, "tile_max_lat": y1}
    names = (key, "i", "j", "tile_min_lon", "tile_min_lat", "tile_max_lon", "tile_max_lat")
    if seeds is None:
        tiles = boxes.select("*", F.explode(F.sequence(F.lit(0), n("min_lon", "max_lon"))).alias("i")).select("*", F.explode(F.sequence(F.lit(0), n("min_lat", "max_lat"))).alias("j"))
        return tiles.withColumns(corners).select(*names)
    half = size * factor / 2
    wide = boxes.select(key, *[F.col(c).alias(f"_{c}") for c in ("min_lon", "min_lat", "max_lon", "max_lat")])
    wide = wide.select("*", *[(F.col(f"_{c}") + (d * half)).alias(c) for c, d in (("min_lon", -1), ("min_lat", -1), ("max_lon", 1), ("max_lat", 1))])
    near = in_boxes(_points(seeds).select("lat", "lng"), wide).select("lat", "lng", key, *[F.col(f"_{c}").alias(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")])

    def places(at: str, lo: str, hi: str) -> Column:
        # A tile's centre is (k + 1/2) * size from the box's edge, or less in a last tile that is cut off.
        first, last = F.floor((F.col(at) - half - F.col(lo)) / size - 0.5), F.ceil((F.col(at) + half - F.col(lo)) / size + 0.5)
        first, last = F.greatest(first.cast("int"), F.lit(0)), F.least(last.cast("int"), n(lo, hi))
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    tiles = near.withColumn("i", F.explode(places("lng", "min_lon", "max_lon"))).withColumn("j", F.explode(places("lat", "min_lat", "max_lat"))).withColumns(corners)
    cx, cy = (F.col("tile_min_lon") + F.col("tile_max_lon")) / 2, (F.col("tile_min_lat") + F.col("tile_max_lat")) / 2
    return tiles.where(F.col("lng").between(cx - half, cx + half) & F.col("lat").between(cy - half, cy + half)).select(*names).distinct()


def label_buildings(buildings: DataFrame, farms: DataFrame, radius: float, key: str = "building_id") -> DataFrame:
    """Adds label, unified_label, species, matched_id, matched_m, source_label: the nearest first-source facility makes a building positive; else the
    nearest other one labels it as its taxonomy says; else it is unknown and negative. A source counts as the first when it names FarmTransparency in any case."""
    from geoquill.functions.labels import unify_label

    first = F.coalesce(F.lower("source").rlike("farmtransparency|farm_transparency"), F.lit(False))
    tag = lambda s: farms.where(s).withColumn("source", F.lit("FarmTransparency") if s is first else F.lit("osm")).withColumn("u", unify_label("source", "category", "species"))
    named = lambda got, of: got.select(key, *[F.col(c).alias(f"{of}_{c}") for c in ("match_id", "match_m", "match_u")])
    a = _nearest(buildings, tag(first), radius, key, "id", ("u",))
    b = _nearest(buildings.join(a, key, "left_anti"), tag(~first), radius, key, "id", ("u",))
    hit_a, hit_b = F.col("a_match_id").isNotNull(), F.col("b_match_id").isNotNull()
    pick = lambda c: F.when(hit_a, F.col(f"a_{c}")).when(hit_b, F.col(f"b_{c}"))
    u = F.when(hit_a, F.col("a_match_u")).when(hit_b, F.col("b_match_u"))
    return buildings.join(named(a, "a"), key, "left").join(named(b, "b"), key, "left").select(
        *buildings.columns, F.when(hit_a, 1).when(hit_b & F.col("b_match_u.is_farm"), 1).otherwise(0).alias("label"), F.coalesce(u["label"], F.lit("unknown")).alias("unified_label"),
        F.coalesce(u["species"], F.lit("")).alias("matched_species"), F.coalesce(pick("match_id"), F.lit("")).alias("matched_id"), F.coalesce(pick("match_m"), F.lit(float("inf"))).alias("matched_m"),
        F.when(hit_a, "farm_transparency").when(hit_b, "osm").otherwise("").alias("source_label"),
    )


def enrich_with_tags(labelled: DataFrame, tagged: DataFrame, radius: float, key: str = "building_id") -> DataFrame:
    """Unknown buildings take the label of the nearest tagged building: its building tag, then landuse; a farm tag makes it positive."""
    from geoquill.functions.labels import match_tag

    by_building, by_land = match_tag(F.concat(F.lit("building="), "building")), match_tag(F.concat(F.lit("landuse="), "landuse"))
    refs = tagged.where("building is not null or landuse is not null").withColumn("u", F.when(by_building["group"].isNotNull(), by_building).otherwise(by_land))
    got = _nearest(labelled.where("unified_label = 'unknown'"), refs, radius, key, "osm_id", ("u",)).select(key, F.col("match_u").alias("u"))
    out = labelled.join(got, key, "left")
    return out.withColumns({"label": F.when(F.col("u.group") == "farm", 1).otherwise(F.col("label")), "unified_label": F.coalesce("u.label", "unified_label")}).drop("u")
