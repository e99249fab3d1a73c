"""Registered queries: contract, one oracle run on the smallest data, and brute force where SQL has no answer."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from geoquill.operators import graphs, lookups, metrics, patches, raster, spatial, splits
from geoquill.sources import readers

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def points(spark, n, seed, ids="ord"):
    rng = np.random.default_rng(seed)
    rows = [(k, float(10 + y), float(20 + x), "A" if k % 2 else "B") for k, (x, y) in enumerate(rng.uniform(0, 0.2, (n, 2)))]
    return spark.createDataFrame(rows, f"{ids} long, lat double, lng double, country string"), rows


def test_nearest_and_far_against_brute_force(spark):
    left, a = points(spark, 120, 1, "lid")
    right, b = points(spark, 60, 2, "rid")
    k = math.cos(math.radians(sum(r[1] for r in b) / len(b)))
    want = {}
    for i, y, x, _ in a:
        best = min((math.hypot((x - u) * 111000 * k, (y - v) * 111000), j) for j, v, u, _ in b)
        want[i] = best[1] if best[0] <= 1500 else None
    got = {r["lid"]: r["match_id"] for r in spatial.nearest_within(left, right, 1500, "lid", "rid").collect()}
    assert got == want
    far = {i for i, y, x, c in a if all(math.hypot((x - u) * 111000 * math.cos(math.radians(y)), (y - v) * 111000) >= 2000 for _, v, u, d in b if c == d)}
    assert {r["lid"] for r in spatial.far_from(left, right, 2000).collect()} == far
    near = {i for i, y, x, _ in a if any(math.hypot((x - u) * 111000 * math.cos(math.radians(y)), (y - v) * 111000) < 900 for _, v, u, _ in b)}
    assert {r["lid"] for r in spatial.matched(left, right, 900).collect()} == near


@pytest.mark.parametrize("radius", [800.0, 3000.0])
def test_dedup_is_the_sequential_one(spark, radius):
    df, rows = points(spark, 150, 3)
    kept = []
    for i, y, x, _ in rows:
        if all(math.hypot((y - v) * 111000, (x - u) * 111000 * math.cos(math.radians(v))) >= radius for _, v, u, _ in kept):
            kept.append((i, y, x, None))
    assert {r["ord"] for r in spatial.dedup_proximity(df, radius).collect()} == {k[0] for k in kept}


def test_curves_against_brute_force(spark):
    rng = np.random.default_rng(5)
    y, s = rng.integers(0, 2, 300), np.round(rng.uniform(-0.2, 1.3, 300), 2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "true_label int, predicted_score double")
    got = metrics.auc(df).first()
    pos, neg = s[y == 1], s[y == 0]
    assert got["roc_auc"] == pytest.approx(np.mean([(p > neg).mean() + (p == neg).mean() / 2 for p in pos]), abs=1e-6)
    ap, last = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        tp, fp = (pos >= t).sum(), (neg >= t).sum()
        ap += (tp / len(pos) - last) * tp / (tp + fp)
        last = tp / len(pos)
    assert got["average_precision"] == pytest.approx(ap, abs=1e-6)


def test_splits_cover_and_keep_priority(spark):
    rows = [(f"{'NAT1' if k % 3 else 'NAT2'}_cluster_{k}", k % 4 - 1, k % 17 == 0, "usa_dmv" if k % 10 == 0 else None, "inspected" if k % 11 == 0 else None, "A" if k % 3 else "B") for k in range(400)]
    df = spark.createDataFrame(rows, "candidate_id string, label int, eval_set boolean, label_source string, viz_status string, country string")
    got = {r["candidate_id"]: r["split"] for r in splits.assign_splits(df, 0.1, 0.1, generalization=["NAT2"]).collect()}
    assert len(got) == 400
    for i, label, held, source, viz, _ in rows:
        gen = i.startswith("NAT2") and label != -1
        want = "generalization" if gen else "eval" if held else "unlabeled" if label == -1 else "train" if source else "inspected" if viz else None
        assert got[i] == want or want is None and got[i] in ("train", "val", "test")


def test_components_across_tiles(spark):
    rng = np.random.default_rng(7)
    mask = rng.random((24, 24)) < 0.35
    whole = raster.labelled(mask)
    rows = [((r // 8) * 3 + c // 8, r % 8, c % 8, bool(mask[r, c])) for r in range(24) for c in range(24)]
    df = spark.createDataFrame(rows, "tile_id long, row int, col int, mask boolean")
    got = {(r["gr"], r["gc"]): r["component"] for r in raster.vectorize_mask(df, 8, 8, 3).collect()}
    assert got == {(r, c): whole[r, c] for r in range(24) for c in range(24) if mask[r, c]}


def test_opening_leaves_no_trace_of_tiles(spark):
    """A mask cut in tiles opens as the whole one does, also with a halo wider than a tile and with pixels that have no row."""
    rng = np.random.default_rng(8)
    mask, there = rng.random((24, 32)) < 0.8, rng.random((24, 32)) < 0.95
    rows = [((r // 8) * 4 + c // 8, r % 8, c % 8, bool(mask[r, c])) for r in range(24) for c in range(32) if there[r, c]]
    df = spark.createDataFrame(rows, "tile_id long, row int, col int, mask boolean")
    for radius in (0, 1, 2, 5):
        got = {(r["tile_id"] // 4 * 8 + r["row"], r["tile_id"] % 4 * 8 + r["col"]): r["mask"] for r in raster.morphological_open(df, radius, (8, 8), 4).collect()}
        want = np.zeros(mask.shape, bool)
        for r, c in np.argwhere(there):  # by the definition
            disc = [(r + i, c + j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j <= radius * radius]
            solid = lambda y, x: all(mask[y + i, x + j] for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j <= radius * radius and 0 <= y + i < 24 and 0 <= x + j < 32 and there[y + i, x + j])
            want[r, c] = any(solid(y, x) for y, x in disc if 0 <= y < 24 and 0 <= x < 32 and there[y, x])
        assert len(got) == there.sum() and all(v == want[p] for p, v in got.items()), radius


def test_labels_of_a_spiral(spark):
    """Labels equal those of a flood fill, for random masks and a spiral, whose one path runs through all of the tile."""
    spiral = np.zeros((41, 41), bool)
    r, c, dr, dc = 0, 0, 0, 1
    spiral[0, 0] = True
    while True:
        for _ in range(2):
            y, x = r + 2 * dr, c + 2 * dc
            if 0 <= y < 41 and 0 <= x < 41 and not spiral[y, x]:
                break
            dr, dc = dc, -dr
        else:
            break
        spiral[r + dr, c + dc] = spiral[y, x] = True
        r, c = y, x
    rng = np.random.default_rng(9)
    for mask in (spiral, np.zeros((3, 4), bool), np.ones((1, 5), bool), *(rng.random((rng.integers(1, 30), rng.integers(1, 30))) < p for p in (0.2, 0.4, 0.6))):
        want = np.full(mask.shape, -1)
        for at in np.argwhere(mask):
            if want[tuple(at)] < 0:
                todo, name = [tuple(at)], at[0] * mask.shape[1] + at[1]
                while todo:
                    y, x = todo.pop()
                    if 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and mask[y, x] and want[y, x] < 0:
                        want[y, x] = name
                        todo += [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        assert (raster.labelled(mask) == want).all()


def test_components_of_a_long_chain_take_few_rounds(spark):
    n, rounds = 10_000, []
    order = np.random.default_rng(4).permutation(n)
    for names in (np.arange(n), order):
        df = spark.createDataFrame([(int(names[k]), int(names[k + 1])) for k in range(n - 1)] + [(n + 5, n + 3), (n + 3, n + 4), (n + 7, n + 7)], "a long, b long")
        got = dict(tuple(r) for r in graphs.least_labels(df, rounds).collect())
        assert got == dict.fromkeys(range(n), 0) | {n + 5: n + 3, n + 4: n + 3, n + 3: n + 3}
    assert max(rounds) <= 20


def greedy(rows, radius):
    kept = []
    for key, lat, lng in sorted(rows):
        if not any(math.hypot((lat - y) * 111_000, (lng - x) * 111_000 * math.cos(math.radians(y))) < radius for _, y, x in kept):
            kept.append((key, lat, lng))
    return {k for k, _, _ in kept}


def test_greedy_dedup_in_blocks(spark):
    """Equal to the sequential rule: scattered rows over many blocks, a cell fuller than a block, rows at one spot, and rows without a place."""
    rng = random.Random(5)
    rows = [(lat, lng) for lat, lng in ((rng.uniform(10, 10.2), rng.uniform(20, 20.2)) for _ in range(700))] + [(10.1 + rng.uniform(0, 0.004), 20.1 + rng.uniform(0, 0.004)) for _ in range(400)] + [(10.05, 20.05)] * 60
    rng.shuffle(rows)
    rows = [(k, *r) for k, r in enumerate(rows)]
    df = spark.createDataFrame([*rows, (5000, None, 20.0), (5001, 10.0, None)], "ord long, lat double, lng double")
    for most in (30, 200, 50_000):
        assert {r["ord"] for r in spatial.dedup_proximity(df, 700.0, block_rows=most).collect()} == greedy(rows, 700.0) | {5000, 5001}
    assert spatial.dedup_proximity(df.limit(0), 700.0).count() == 0


def test_greedy_dedup_of_a_long_chain(spark):
    """A chain over 10,000 cells, in which every row depends on the one before: few rounds, also over many blocks."""
    rows, rounds = [(k, 0.0, k * 0.9 * 100 / 111_000) for k in range(10_000)], []
    df = spark.createDataFrame(rows, "ord long, lat double, lng double")
    want = set(range(0, 10_000, 2))
    for most in (2_000, 50_000):
        assert {r["ord"] for r in spatial.dedup_proximity(df, 100.0, block_rows=most, rounds=rounds).collect()} == want
    assert rounds[0] < 20 and rounds[1] == 1


def test_nearest_ties_go_to_the_least_id(spark):
    """References as far to the left as to the right are a tie, whatever the last bits of their places say."""
    at = lambda k: -60.0 + k / 20110.0
    left = spark.createDataFrame([(k, -30.0, at(100 * k)) for k in range(1, 200)], "pid long, lat double, lng double")
    refs = [(2 * k + side, -30.0, at(100 * k + (7 if side else -7) * (-1 if k % 2 else 1))) for k in range(1, 200) for side in (0, 1)]
    right = spark.createDataFrame(refs, "rid long, lat double, lng double")
    for most in (1, 10**6):
        assert {r["pid"]: r["match_id"] for r in spatial.nearest_within(left, right, 100.0, "pid", "rid", most=most).collect()} == {k: 2 * k for k in range(1, 200)}


def test_nearest_in_full_cells(spark):
    """Halved cells find what comparing all pairs finds, for points among, beside and far from the references, with ties and spots of several ids; pairs stay near the number of points."""
    rng, compared = random.Random(6), []
    refs = [(k, 10 + rng.gauss(0, 0.0004), 20 + rng.gauss(0, 0.0004)) for k in range(1500)] + [(k, 10.0, 20.0) for k in range(1500, 1600)] + [(k, 10 + rng.uniform(-0.05, 0.05), 20 + rng.uniform(-0.05, 0.05)) for k in range(1600, 1700)]
    points = [(k, 10 + rng.gauss(0, 0.0004), 20 + rng.gauss(0, 0.0004)) for k in range(1200)] + [(k, 10 + rng.uniform(-0.05, 0.05), 20 + rng.uniform(-0.05, 0.05)) for k in range(1200, 1500)] + [(1500, 10.0, 20.0), (1501, None, 1.0)]
    left, right = spark.createDataFrame(points, "pid long, lat double, lng double"), spark.createDataFrame(refs, "rid long, lat double, lng double").withColumn("tag", F.concat(F.lit("t"), "rid"))
    got = {r["pid"]: (r["match_id"], r["match_tag"], r["match_m"]) for r in spatial.nearest_within(left, right, 500.0, "pid", "rid", ("tag",), most=20, compared=compared).collect()}
    k = math.cos(math.radians(np.mean([r[1] for r in refs])))
    x, y = np.array([r[2] for r in refs]) * 111_000 * k, np.array([r[1] for r in refs]) * 111_000
    for i, lat, lng in points:
        best = (math.inf, None) if lat is None else min((d, r) for d, r in zip(np.hypot(x - lng * 111_000 * k, y - lat * 111_000), range(len(refs)), strict=True))
        want = (best[1], f"t{best[1]}") if best[0] <= 500 else (None, None)
        assert got[i][:2] == want and (got[i][2] == math.inf if want[0] is None else abs(got[i][2] - best[0]) < 1e-6)
    assert compared[0] < 400 * len(points) < len(points) * len(refs)
    assert got == {r["pid"]: (r["match_id"], r["match_tag"], r["match_m"]) for r in spatial.nearest_within(left, right, 500.0, "pid", "rid", ("tag",), most=10**6).collect()}


def dense(spark, n_left, n_right):
    rng = random.Random(8)
    made = lambda n: [(k, 10 + rng.uniform(0, 0.02), 20 + rng.uniform(0, 0.02)) for k in range(n)]
    return spark.createDataFrame(made(n_left), "pid long, lat double, lng double"), spark.createDataFrame(made(n_right), "rid long, lat double, lng double")


def test_nearest_compares_with_few_cells(spark):
    """Among evenly dense references a point meets those of its own cell and of the few that a known point leaves in reach, not of all cells around."""
    left, right = dense(spark, 800, 3000)
    compared = []
    got = {r["pid"]: r["match_id"] for r in spatial.nearest_within(left, right, 1500.0, "pid", "rid", most=20, compared=compared).collect()}
    assert compared[0] < 60 * 800
    assert got == {r["pid"]: r["match_id"] for r in spatial.nearest_within(left, right, 1500.0, "pid", "rid", most=10**6).collect()}


def nearest_plans(monkeypatch):
    """Gets the plan of each nearest join's result."""
    plans, write = [], spatial.write_table
    note = lambda df, name: (plans.append(df._jdf.queryExecution().sparkPlan()) if name == "nearest" else None) or write(df, name)
    for module in (spatial, __import__("geoquill.sources.tables", fromlist=["tables"])):
        monkeypatch.setattr(module, "write_table", note)
    return plans


def sorts_pairs(node):
    """A sort aggregate stands above a join without an exchange between; that of the spots (rlat, rlng) is of references alone."""
    below = lambda n: [n.children().apply(k) for k in range(n.children().size())]

    def joins(n):
        return "Join" in n.nodeName() or "Exchange" not in n.nodeName() and any(joins(c) for c in below(n))

    of_pairs = node.nodeName() == "SortAggregate" and "rlat" not in node.groupingExpressions().toString()
    return of_pairs and joins(node) or any(sorts_pairs(c) for c in below(node))


@pytest.mark.parametrize("most", [20, 10**6])
def test_nearest_sorts_no_pairs(spark, monkeypatch, most):
    """No plan sorts what a join of points and references gives: pairs are taken by hash, and only a point's few best are sorted."""
    plans = nearest_plans(monkeypatch)
    left, right = dense(spark, 300, 600)
    spatial.nearest_within(left, right, 1500.0, "pid", "rid", most=most).collect()
    assert len(plans) == 1 and not sorts_pairs(plans[0])


@needs_data
@pytest.mark.parametrize("name, joins", [("u06_building_candidates", 3), ("j06_nearest_within", 1)])
def test_queries_sort_no_pairs(spark, monkeypatch, name, joins):
    """The same for queries on the nearest join, each of whose joins is made once."""
    from geoquill.plans import registry

    plans = nearest_plans(monkeypatch)
    registry.queries()[name](spark, SF).collect()
    assert len(plans) == joins and not any(map(sorts_pairs, plans))


def test_labels_keep_rows_of_odd_ids(spark, monkeypatch):
    """A building without an id stays, unlabelled, and two rows of one id stay two, as in the SQL; the second source is asked for those alone that the first leaves."""
    asked, nearest = [], spatial._nearest
    monkeypatch.setattr(spatial, "_nearest", lambda left, *args: asked.append(sorted(str(r[0]) for r in left.select("building_id").collect())) or nearest(left, *args))
    buildings = spark.createDataFrame([("a", 10.0, 20.0), ("b", 10.5, 20.0), ("b", 10.5, 20.0), (None, 10.0, 20.0), ("c", None, 20.0), ("d", 11.0, 20.0)], "building_id string, lat double, lng double")
    farms = spark.createDataFrame(
        [("f1", 10.0, 20.0001, "FarmTransparency", "Farm (meat)", "Pigs"), ("f2", 10.5, 20.0001, "OSM", "building=barn", None), ("f3", 10.0, 20.0, "OSM", "building=barn", None)],
        "id string, lat double, lng double, source string, category string, species string",
    )
    tags = spark.createDataFrame([(1, 11.0, 20.0, "barn", None)], "osm_id long, lat double, lng double, building string, landuse string")
    labelled = spatial.label_buildings(buildings, farms, 1000)
    got = labelled.collect()
    assert sorted((str(r["building_id"]), r["matched_id"], r["source_label"]) for r in got) == [("None", "", ""), ("a", "f1", "farm_transparency"), ("b", "f2", "osm"), ("b", "f2", "osm"), ("c", "", ""), ("d", "", "")]
    assert asked == [["None", "a", "b", "b", "c", "d"], ["None", "b", "b", "c", "d"]]
    rich = spatial.enrich_with_tags(labelled, tags, 1000).collect()
    assert len(rich) == 6 and {str(r["building_id"]): (r["label"], r["unified_label"]) for r in rich}["d"] == (1, "barn")


def test_draws_merge_with_the_line(spark, monkeypatch):
    """Draws equal a search on the cumulated weights, over many parts, also where one row holds most of the weight; the plan has no join with more than one row a draw."""
    from geoquill.operators import ranks, sampling

    monkeypatch.setattr(ranks, "PART_ROWS", 100)
    monkeypatch.setattr(ranks, "LEAST_PART", 50)
    weights = {f"r{k}": (5e6 if k == 77 else 0.0 if k % 10 == 0 else None if k % 11 == 0 else float(k % 13 + 1)) for k in range(900)}
    df = spark.createDataFrame(list(weights.items()), "rid string, w double")
    u = lambda *parts: int(__import__("hashlib").md5(":".join([*map(str, parts), "42"]).encode()).hexdigest()[:8], 16) / 4294967296
    line = sorted((u(k), k, w) for k, w in weights.items() if w)
    ends = np.cumsum([w for _, _, w in line])
    for n in (0, 1, 2000):
        got = {r["draw"]: r["rid"] for r in sampling.weighted_sample(df, n, "w", "rid").collect()}
        assert got == {k: line[int(np.searchsorted(ends, u(k, "draw") * ends[-1], side="right"))][1] for k in range(n)}
    assert sampling.weighted_sample(df.where("w is null"), 5, "w", "rid").count() == 0


def test_tiles_come_from_seeds(spark):
    """A fine grid of a continent with seeds makes few rows, and those that testing every tile gives on a coarse one."""
    rng = random.Random(2)
    boxes = spark.createDataFrame([("a", -60.0, -30.0, 40.0, 30.3), ("b", 39.0, -10.0, 41.7, 5.0)], "country_key string, min_lon double, min_lat double, max_lon double, max_lat double")
    seeds = spark.createDataFrame([(rng.uniform(-32, 32), rng.uniform(-62, 43)) for _ in range(1000)] + [(None, 1.0), (30.29, 39.99), (5.1, 41.69)], "lat double, lng double")
    assert spatial.generate_tiles(boxes, 0.001, seeds).count() < 10_000
    every = spatial.generate_tiles(boxes, 0.7)
    half = 0.7 * 1.5 / 2
    x, y = (F.col("tile_min_lon") + F.col("tile_max_lon")) / 2, (F.col("tile_min_lat") + F.col("tile_max_lat")) / 2
    want = every.join(seeds, (F.col("lng").between(x - half, x + half)) & (F.col("lat").between(y - half, y + half)), "left_semi")
    assert sorted(map(tuple, spatial.generate_tiles(boxes, 0.7, seeds).collect())) == sorted(map(tuple, want.collect()))


def test_tries_stop_when_there_are_enough(spark):
    from geoquill.operators import sampling

    boxes = spark.createDataFrame([("a", "A", 0.0, 0.0, 1.0, 1.0), ("b", "B", 0.0, 0.0, 0.02, 0.02)], "country_key string, country string, min_lon double, min_lat double, max_lon double, max_lat double")
    near = spark.createDataFrame([("B", 0.01, 0.01)], "country string, lat double, lng double")
    tried: list[int] = []
    got = sampling.random_rural_negatives(boxes, near, 50, 1300.0, tried=tried)
    whole = sampling.random_rural_negatives(boxes, near, 50, 1300.0, batch=20, tried=tried)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))
    assert tried[0] <= 200 + 1000 and tried[1] == 2000 and {r[0]: r[1] for r in got.groupBy("region").count().collect()}["a"] == 50


def test_country_buildings_read_only_reached_tiles(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k, f"c{rng.randrange(3)}", rng.uniform(0, 1), rng.uniform(0, 1), 100.0 if k % 5 else 1.0) for k in range(2000)] + [(9000 + k, "hot", 0.501, 0.501, 50.0) for k in range(500)]
    spark.createDataFrame(rows, "ord long, country_key string, lat double, lng double, area_m2 double").write.parquet(f"{tmp_path}/b")
    got = readers.query_country_buildings(spark.read.parquet(f"{tmp_path}/b"), 10, 1000, 0.1, 40)
    want = []
    for c in ("c0", "c1", "c2", "hot"):
        want += sorted((r for r in rows if r[1] == c and r[4] >= 10), key=lambda r: (math.floor(r[2] / 0.1), math.floor(r[3] / 0.1), r[0]))[:40]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    plan = spark._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(lat" in plan and "LessThanOrEqual(lng" in plan


def test_quantiles_count_hot_values(spark, monkeypatch):
    """Exact quantiles where one value holds most rows of a group, over many parts, with null keys and values; the hot value is one row of the parts."""
    from geoquill.operators import ranks

    monkeypatch.setattr(ranks, "PART_ROWS", 50)
    monkeypatch.setattr(ranks, "LEAST_PART", 20)
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([0.5] * 8 + [rng.random(), None])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, v double")
    for keys in ((), ("g",)):
        got = {tuple(r[k] for k in keys): (r["_n"], r["q0"], r["q1"], r["q2"]) for r in ranks.quantiles(df, keys, "v", (0.05, 0.5, 0.987), ("q0", "q1", "q2")).collect()}
        for key in {tuple(r[:1] if keys else ()) for r in rows}:
            v = [x for g, x in rows if x is not None and (not keys or (g,) == key)]
            assert got[key][0] == len(v) and np.allclose(got[key][1:], np.quantile(v, [0.05, 0.5, 0.987]))
    assert ranks.quantiles(df.limit(0), ("g",), "v", (0.5,), ("q",)).count() == 0


def test_augmentation_is_stable_and_bounded(spark):
    df = spark.createDataFrame([(k, 4, 4, 4, [float((k + j) % 7) / 7 for j in range(64)]) for k in range(20)], "candidate_id long, n_channels int, height int, width int, data array<float>")
    how = patches.Augment(rotate_deg=20, crop=(0.6, 1.0), brightness=0.2, band_jitter=0.1, noise=0.05, channel_dropout=0.2, cutout=2)
    one = {r["candidate_id"]: list(r["data"]) for r in patches.augment_patches(df, how, 1).collect()}
    two = {r["candidate_id"]: list(r["data"]) for r in patches.augment_patches(df.repartition(5), how, 1).collect()}
    assert one == two and all(len(v) == 64 and all(-1 <= x <= 1 for x in v) and min(v[:48]) >= 0 for v in one.values())
    assert one != {r["candidate_id"]: list(r["data"]) for r in patches.augment_patches(df, how, 2).collect()}


def snyder(lat, lng):
    """Transverse Mercator by the power series in the longitude difference, with the meridian arc integrated numerically."""
    a, f = 6378137.0, 1 / 298.257223563
    e2 = f * (2 - f)
    phi, zone = math.radians(lat), int((lng + 180) // 6) + 1
    d = math.radians(lng - (zone * 6 - 183)) * math.cos(phi)
    n, t, c = a / math.sqrt(1 - e2 * math.sin(phi) ** 2), math.tan(phi) ** 2, e2 / (1 - e2) * math.cos(phi) ** 2
    x = np.linspace(0, phi, 20001)
    arc = np.trapezoid(a * (1 - e2) / (1 - e2 * np.sin(x) ** 2) ** 1.5, x)
    east = 500000 + 0.9996 * n * (d + (1 - t + c) * d**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * e2 / (1 - e2)) * d**5 / 120)
    north = 0.9996 * (arc + n * math.tan(phi) * (d * d / 2 + (5 - t + 9 * c + 4 * c * c) * d**4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * e2 / (1 - e2)) * d**6 / 720))
    return zone + (32600 if lat >= 0 else 32700), east, north + (1e7 if lat < 0 else 0)


def test_utm_against_another_series(spark):
    spots = [(48.8584, 2.2945), (-33.8568, 151.2153), (0.5, -59.2), (-29.7, -55.1), (60.0, 24.9)]
    got = spark.createDataFrame(spots, "lat double, lng double").select("lat", "lng", patches.utm_grid().alias("g")).collect()
    for r in got:
        epsg, east, north = snyder(r["lat"], r["lng"])
        assert r["g"]["epsg"] == epsg and r["g"]["easting"] == pytest.approx(east, abs=0.05) and r["g"]["northing"] == pytest.approx(north, abs=0.05)


def test_wkb_centroid_of_holes_and_multipolygons(spark):
    import struct

    ring = lambda pts: struct.pack("<I", len(pts)) + b"".join(struct.pack("<2d", *p) for p in pts)
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]
    poly = lambda *rings: struct.pack("<BII", 1, 3, len(rings)) + b"".join(map(ring, rings))
    multi = struct.pack("<BII", 1, 6, 2) + poly(square(0, 0, 1)) + poly(square(3, 0, 1))
    df = spark.createDataFrame([(1, poly(square(0, 0, 4), square(0, 0, 2))), (2, multi), (3, None)], "k int, g binary").withColumn("c", readers.wkb_centroid("g"))
    got = {r["k"]: r["c"] for r in df.collect()}
    assert (got[1]["lng"], got[1]["lat"]) == pytest.approx(((16 * 2 - 4 * 1) / 12,) * 2) and (got[2]["lng"], got[2]["lat"]) == pytest.approx((2, 0.5)) and got[3]["lng"] is None


def test_merge_keeps_the_last(spark):
    kind = {"adm0": "string", "cluster_id": "string", "final_label": "string"}
    base = spark.createDataFrame([("A", "a1", "x", 1), ("B", "b1", "x", 2)], "adm0 string, cluster_id string, final_label string, ord long")
    new = spark.createDataFrame([("A", "a1", "y", 1), ("A", "a2", "y", 2), ("A", "a2", "z", 3)], base.schema)
    got = {r["cluster_id"]: r["final_label"] for r in lookups.merge_clusters(base, [new], kind).collect()}
    assert got == {"a1": "y", "a2": "z", "b1": "x"}


def test_patches_of_a_folder(spark, tmp_path):
    import numpy as np

    from geoquill.sources import readers

    (tmp_path / "x").mkdir()
    for k in range(3):
        np.save(tmp_path / "x" / f"c{k}.npy", np.full((2, 3, 4), k, np.float32))
    got = {r["candidate_id"]: r for r in readers.read_patches(spark, str(tmp_path)).collect()}
    assert set(got) == {"c0", "c1", "c2"} and [got["c2"][c] for c in ("n_channels", "height", "width")] == [2, 3, 4] and set(got["c2"]["data"]) == {2.0}


def test_failures_start_anew(spark, tmp_path):
    from geoquill.sources import sinks

    df = spark.createDataFrame([("a", "x" * 300), ("b", None)], "candidate_id string, error string")
    sinks.append_failures(df, f"{tmp_path}/f")
    assert {r["candidate_id"]: len(r["error"] or "") for r in spark.read.parquet(f"{tmp_path}/f").collect()} == {"a": 200, "b": 0}
    sinks.clear_failures(df, f"{tmp_path}/f")
    assert spark.read.parquet(f"{tmp_path}/f").count() == 0


def test_ranks_and_quantiles_over_many_parts(spark, monkeypatch):
    import numpy as np

    from geoquill.operators import ranks

    monkeypatch.setattr(ranks, "PART_ROWS", 40)
    rng = np.random.default_rng(3)
    rows = [(["a", "b", None][int(k)], float(v), i) for i, (k, v) in enumerate(zip(rng.integers(0, 3, 500), rng.integers(0, 30, 500), strict=True))]
    df = spark.createDataFrame(rows, "k string, v double, i long").repartition(5)
    got = ranks.ordered_rank(df, ["k"], ["v", "i"]).collect()
    for key in ("a", "b", None):
        want = sorted((v, i) for k, v, i in rows if k == key)
        assert [(r["v"], r["i"]) for r in sorted((r for r in got if r["k"] == key), key=lambda r: r["rank"])] == want
    for r in ranks.quantiles(df, ["k"], "v", (0.1, 0.5, 0.97), ("x", "y", "z")).collect():
        values = [v for k, v, _ in rows if k == r["k"]]
        assert r["_n"] == len(values) and [r["x"], r["y"], r["z"]] == [float(q) for q in np.round(np.quantile(values, (0.1, 0.5, 0.97)), 9)] or np.allclose([r["x"], r["y"], r["z"]], np.quantile(values, (0.1, 0.5, 0.97)))


def test_dedup_at_one_spot_and_in_a_chain(spark):
    from geoquill.operators import spatial

    spot = [(k, 10.0, 20.0) for k in range(400)]
    chain = [(1000 + k, 30.0, 20.0 + k * 60 / 111000 / 0.866) for k in range(40)]  # each near its neighbours only
    lost = [(5000, None, 1.0)]
    got = {r["ord"] for r in spatial.dedup_proximity(spark.createDataFrame(spot + chain + lost, "ord long, lat double, lng double"), 100.0).collect()}
    assert got == {0, 5000, *range(1000, 1040, 2)}


def test_boxes_by_cells_are_those_by_broadcast(spark):
    from pyspark.sql import functions as F

    from geoquill.operators import spatial

    boxes = spark.range(60).select(F.col("id").alias("o"), F.concat(F.lit("v"), "id").alias("v"), (F.col("id") % 10 * 3.0).alias("min_lon"), (F.col("id") % 6 * 2.0).alias("min_lat")).withColumns({"max_lon": F.col("min_lon") + 4 + F.col("o") % 3, "max_lat": F.col("min_lat") + 3})
    points = spark.range(300).select("id", (F.col("id") * 7 % 400 / 10).alias("lng"), (F.col("id") * 11 % 170 / 10).alias("lat"))
    look = lambda bound: sorted(map(tuple, spatial.bbox_lookup(points, boxes, "v", "o", "id", bound).collect()))
    assert look(5) == look(1000) and any(r[-1] for r in look(5))


def test_radar_mask_keeps_no_values(spark):
    """The mask is that of the median, of odd, even, missing and NaN values, but is made from counts."""
    rng = random.Random(8)
    values = [-13.0, -12.0, -11.0, -11.5, -12.5, float("nan"), None]
    rows = [(tile, 0, 0, rng.choice(values)) for tile in range(200) for _ in range(rng.randrange(1, 6))]
    df = spark.createDataFrame(rows, "tile_id long, row int, col int, vv_db double")
    got = raster.mask_sar(df, -12.0)
    want = df.groupBy("tile_id", "row", "col").agg((F.median("vv_db") > -12.0).alias("mask"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "ObjectHashAggregate" not in got._jdf.queryExecution().executedPlan().toString()


def test_small_tiles_share_a_group(spark):
    """Tiles of 8 by 8 pixels are opened and labelled by blocks, and block borders leave no trace."""
    rng = np.random.default_rng(9)
    mask = rng.random((600, 80)) < 0.45
    rows = [(int(r // 8 * 10 + c // 8), int(r % 8), int(c % 8), bool(mask[r, c])) for r in range(600) for c in range(80)]
    df = spark.createDataFrame(rows, "tile_id long, row int, col int, mask boolean")
    assert raster.with_halo(df, 2, (8, 8), 10).select("target").distinct().count() == 3
    names = raster.labelled(mask)
    for blocks, found in ((3, raster.vectorize_mask(df, 8, 8, 10)), (1, raster.vectorize_mask(df.where("tile_id < 320"), 8, 8, 10))):
        got = {(r["gr"], r["gc"]): r["component"] for r in found.collect()}
        part = names if blocks == 3 else raster.labelled(mask[:256])
        assert got == {(int(r), int(c)): int(part[r, c]) for r, c in zip(*np.nonzero(part >= 0), strict=True)}
    opened = raster.opened(mask, 1)
    assert {(r["tile_id"] // 10 * 8 + r["row"], r["tile_id"] % 10 * 8 + r["col"]) for r in raster.morphological_open(df, 1, (8, 8), 10).where("mask").collect()} == {(int(r), int(c)) for r, c in zip(*np.nonzero(opened), strict=True)}


def test_landcover_takes_the_least_of_the_most_frequent_classes_without_a_sort(spark, capsys):
    from geoquill.operators.raster import mask_landcover

    rows = [(0, 1), (0, 1), (0, 6), (1, 6), (1, 1), (2, 6), (2, 6), (2, 1), (3, None), (3, 6), (4, None), (4, 6), (4, 6), (5, -(1 << 31)), (5, 6), (6, (1 << 31) - 1), (6, 6), (7, None)]
    df = spark.createDataFrame([(1, 0, c, k) for c, k in rows], "tile_id long, row int, col int, landcover int")
    want = {0: False, 1: False, 2: True, 3: None, 4: True, 5: False, 6: True, 7: None}
    for kind in ("int", "string"):
        got = mask_landcover(df.withColumn("landcover", df["landcover"].cast(kind)), 6)
        assert kind == "string" or {r["col"]: r["mask"] for r in got.collect()} == want
        got.explain()
        assert ("SortAggregate" in capsys.readouterr().out) == (kind == "string")
    at = {k: mask_landcover(df, k).where("mask").count() for k in (-(1 << 31), (1 << 31) - 1)}
    assert at == {-(1 << 31): 1, (1 << 31) - 1: 0}
