"""Scoring with keyed state: once an id over restarts and replays, retries, waits, and a state that grows with ids and not with batches."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from geoquill.streaming import scoring


@pytest.fixture
def runs(spark, tmp_path):
    """put(ids) lands a file; run(...) scores what landed, ids divisible by 5 fail; got() gives registry and failures."""

    def put(*ids):
        spark.createDataFrame([(None if i is None else str(i), float(i or 0)) for i in ids], "candidate_id string, x double").write.mode("append").parquet(f"{tmp_path}/in")

    def score(d):
        return d.select("candidate_id", (F.col("x") * 2).alias("y"), F.when(F.col("x") % 5 == 0, "no image").alias("error"))

    def run(**options):
        stream = spark.readStream.schema("candidate_id string, x double").parquet(f"{tmp_path}/in")
        scoring.resume_scoring(stream, score, f"{tmp_path}/registry", f"{tmp_path}/failures", "h1", f"{tmp_path}/check", **options).awaitTermination()

    def got():
        good = sorted((int(r["candidate_id"]), r["y"]) for r in spark.read.schema("candidate_id string, y double").parquet(f"{tmp_path}/registry/*/").collect())
        bad = spark.read.schema("candidate_id string, attempt int").parquet(f"{tmp_path}/failures/*/").collect() if os.path.isdir(f"{tmp_path}/failures") else []
        return good, sorted((int(r["candidate_id"]), r["attempt"]) for r in bad)

    return put, run, got


def test_each_id_is_scored_once(spark, tmp_path, runs):
    put, run, got = runs
    put(1, 2, 5, 2, None)
    run(done=spark.createDataFrame([("7",), (None,)], "candidate_id string"))
    assert got() == ([(1, 2.0), (2, 4.0)], [(5, 1)])
    put(2, 3, 5, 7)  # a restart: known, new, failed and formerly done ids
    run(done=spark.createDataFrame([("7",)], "candidate_id string"))
    assert got() == ([(1, 2.0), (2, 4.0), (3, 6.0)], [(5, 1)])
    # a crash after the batch was written and before it was committed: the batch is replayed
    last = max(int(f) for f in os.listdir(tmp_path / "check/commits") if f.isdigit())
    for name in (str(last), f".{last}.crc"):
        (tmp_path / "check/commits" / name).unlink(missing_ok=True)
    run()
    assert got() == ([(1, 2.0), (2, 4.0), (3, 6.0)], [(5, 1)])


def test_failures_are_tried_again(runs):
    put, run, got = runs
    put(1, 5)
    for _ in range(4):
        run(attempts=3)
    assert got() == ([(1, 2.0)], [(5, 1), (5, 2), (5, 3)])


def test_waits_are_timers(runs):
    put, run, got = runs
    put(1, 5)
    for k in range(3):  # lands, is heard of, and is due
        run(attempts=2, wait=1, ttl=3_600_000)
        put(10 + k * 5 + 1)
    assert got()[1] == [(5, 1), (5, 2)]


def test_batches_read_no_history(spark, tmp_path, runs):
    """The registry of earlier batches can be gone."""
    put, run, got = runs
    put(1, 2)
    run()
    shutil.rmtree(tmp_path / "registry")
    put(2, 3)
    run()
    assert got()[0] == [(3, 6.0)]


def test_retry_failed_clears_what_went_well(spark, tmp_path):
    schema = "candidate_id string, error string, attempt int, imagery_config_hash string"
    spark.createDataFrame([("1", "e", 1, "h1"), ("2", "e", 1, "h1"), ("2", "e", 2, "h1"), ("3", "e", 1, "h2")], schema).write.parquet(f"{tmp_path}/failures/run=h1-0")
    docs = spark.createDataFrame([(str(k),) for k in range(5)], "candidate_id string")
    for fails, want in (("2", {("1", None), ("2", "still")}), ("", {("2", None)})):
        score = lambda d, fails=fails: d.select("candidate_id", F.when(F.col("candidate_id") == fails, "still").alias("error"))
        out = scoring.retry_failed(docs, score, f"{tmp_path}/registry", f"{tmp_path}/failures", "h1")
        assert {tuple(r) for r in out.collect()} == want
    left = spark.read.schema(schema).parquet(f"{tmp_path}/failures/*/").select("candidate_id", "imagery_config_hash").collect()
    assert [tuple(r) for r in left] == [("3", "h2")]
    assert sorted(r[0] for r in spark.read.schema("candidate_id string").parquet(f"{tmp_path}/registry/*/").collect()) == ["1", "2"]
    assert scoring.retry_failed(docs, None, f"{tmp_path}/none", f"{tmp_path}/none", "h1").count() == 0


def test_ids_are_kept_by_an_aggregation(spark, tmp_path, runs):
    """Without waits no Python call is made an id; ids done before win over their own batch, null ids are left out, and an id that comes again after its failures isn't tried anew."""
    put, run, got = runs
    put(*range(1, 2001), None)
    stream = spark.readStream.schema("candidate_id string, x double").parquet(f"{tmp_path}/in")
    done = spark.createDataFrame([(str(k),) for k in range(1, 2001) if k % 7 == 0], "candidate_id string")
    score = lambda d: d.select("candidate_id", F.col("x").alias("y"), F.when(F.col("x") % 5 == 0, "no image").alias("error"))
    for turn in range(2):
        query = scoring.resume_scoring(stream, score, f"{tmp_path}/registry", f"{tmp_path}/failures", "h1", f"{tmp_path}/check", attempts=2, done=done if turn == 0 else None)
        query.awaitTermination()
        assert {op["operatorName"] for p in query.recentProgress for op in p["stateOperators"]} == {"stateStoreSave"}
        put(5, 6, 7)
    open_ = [k for k in range(1, 2001) if k % 7]
    good, bad = got()
    assert [k for k, _ in good] == [k for k in open_ if k % 5] and bad == sorted((k, a) for k in open_ if k % 5 == 0 for a in (1, 2))
