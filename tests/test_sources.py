"""Sources over real files: patches of a folder, and documents larger than a split."""

import os

import numpy as np
import pytest

from geoquill.sources import documents, npy, readers


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(1)
    arrays = {
        "plain": rng.random((3, 5, 6)), "last": rng.random((8, 7, 2)).astype(np.float32), "flat": rng.random((4, 4)), "ints": rng.integers(0, 9, (2, 3, 3)),
        "named": np.array([[(1.0, 2), (3.0, 4)], [(5.0, 6), (7.0, 8)]], [("b2", "f4"), ("b3", "i2")]),
        "wide": np.zeros((2, 2), [(f"band_with_a_long_name_{k}", "f4") for k in range(200)]),
    }
    (tmp_path / "deep").mkdir()
    for k, (name, a) in enumerate(arrays.items()):
        np.save(tmp_path / ("deep" if k % 2 else "") / f"{name}.npy", a)
    (tmp_path / "notes.txt").write_text("no patch")
    return tmp_path, {name: readers.normalise_layout(a) for name, a in arrays.items()}


def test_patch_files(spark, folder):
    path, want = folder
    got = {r["candidate_id"]: r for r in npy.patch_files(spark, str(path)).collect()}
    assert set(got) == set(want)
    for name, a in want.items():
        assert (got[name]["n_channels"], got[name]["height"], got[name]["width"]) == a.shape
        assert np.array_equal(np.array(got[name]["data"], np.float32), a.astype(np.float32).ravel())
    same = {r["candidate_id"]: list(r["data"]) for r in readers.read_patches(spark, str(path)).collect()}
    assert same == {k: list(r["data"]) for k, r in got.items()}


def test_shapes_come_from_headers(spark, folder):
    path, want = folder
    for file in path.rglob("*.npy"):  # the data is cut off: only headers can be read
        n = 9000 if file.stem == "wide" else 128
        file.write_bytes(file.read_bytes()[:n])
    got = {r["candidate_id"]: (r["n_channels"], r["height"], r["width"]) for r in npy.patch_files(spark, str(path), ("candidate_id", "n_channels", "height", "width")).collect()}
    assert got == {name: a.shape for name, a in want.items()}


def test_only_wanted_files_are_opened(spark, folder):
    path, want = folder
    (path / "broken.npy").write_bytes(b"not an array")
    assert {r["candidate_id"] for r in npy.patch_files(spark, str(path), ids=["plain", "flat"]).collect()} == {"plain", "flat"}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert [r["height"] for r in npy.patch_files(spark, str(path)).where("candidate_id = 'plain'").collect()] == [5]
        assert npy.patch_files(spark, str(path)).where("candidate_id in ('plain', 'last') and height = 8").count() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_partitions_are_bounded(folder, monkeypatch):
    path, want = folder
    monkeypatch.setattr(npy, "PART_FILES", 2)
    from pyspark.sql.types import StructType

    reader = npy.PatchReader(StructType.fromDDL(npy.SCHEMA), {"path": str(path)})
    parts = reader.partitions()
    assert [len(p.paths) for p in parts] == [2, 2, 2] and sorted(npy.candidate(x) for p in parts for x in p.paths) == sorted(want)


def test_patches_round_trip(spark, tmp_path):
    rows = [(f"c{k}", 2, 3, 4, [float(k * 24 + j) for j in range(24)]) for k in range(50)]
    df = spark.createDataFrame(rows, npy.SCHEMA)
    npy.write_patch_files(df, str(tmp_path / "out"))
    assert len(os.listdir(tmp_path / "out")) == 50
    assert sorted(map(tuple, npy.patch_files(spark, str(tmp_path / "out")).collect())) == sorted((*r[:4], r[4]) for r in rows)
    os.mkdir(tmp_path / "empty")
    assert npy.patch_files(spark, str(tmp_path / "empty")).count() == 0


def test_documents_larger_than_a_split(spark, tmp_path):
    """Items of documents in every shape, cut anywhere: nested arrays and objects, braces and quotes in strings, arrays of the same name elsewhere, items over several splits, files without items."""
    import json
    import random

    rng = random.Random(3)
    odd = ['}', '{', '"', '\\', '\\"', ']', '[', 'é', '"elements": [', ' ', '\n', ',', 'x']

    def value(depth=0):
        kind = rng.randrange(6 if depth < 4 else 3)
        text = lambda: "".join(rng.choice(odd) for _ in range(rng.randrange(12)))
        if kind < 3:
            return rng.choice([None, True, rng.random(), text()])
        return [value(depth + 1) for _ in range(rng.randrange(4))] if kind < 4 else {text(): value(depth + 1) for _ in range(rng.randrange(4))}

    want = []
    for k in range(6):
        items = [{"id": i, "v": value(), "long": "}{" * (rng.randrange(2000) if rng.random() < 0.1 else 0)} for i in range(rng.choice([0, 1, 60]))]
        doc = {"a": value(), "other": [{"elements": [{"id": -1}]}, {"id": -2}], "b": {"elements": [{"id": -3}]}, "elements": items, "more": [{"id": -4}]}
        if k == 5:
            del doc["elements"]
            items = []
        (tmp_path / f"{k}.json").write_text(json.dumps(doc, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5))
        want += [(f"{k}.json", json.dumps(i, sort_keys=True)) for i in items]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (300, 1500, 1 << 27):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            rows = documents.array_items(spark, str(tmp_path), "elements").collect()
            got = [(r["path"].rsplit("/", 1)[1], json.dumps(json.loads(r["value"]), sort_keys=True)) for r in sorted(rows, key=lambda r: (r["path"], r["block"], r["n"]))]
            assert got == want
            assert size > 300 or len({(r["path"], r["block"]) for r in rows}) > 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
