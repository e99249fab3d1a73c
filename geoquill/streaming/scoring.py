"""Incremental scoring with Structured Streaming: new candidates once, resumed after failures, retried after a while or on request.

What was seen is keyed state, an entry an id, so a batch costs its own rows and not the history's. State lies in the RocksDB store, which keeps it on disk and saves only what a batch changed. Without waits it is that of a streaming
aggregation (`first_tries`), which costs no Python call an id; timers and limited lives take a keyed processor (`admitted`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from geoquill.sources.readers import exists

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FAILED = "_failed"


class Admission(StatefulProcessor):
    """Lets every id pass once; after a failure again, when `wait` milliseconds are over, until it was tried `attempts` times. An id's state is kept for `ttl` milliseconds after its last change, None: for ever.

    Input rows are candidates, and failures reported by the scoring (FAILED is set). Output: the candidate and attempt, from 1.
    """

    def __init__(self, columns: list[str], schema: T.StructType, attempts: int, wait: int, ttl: int | None) -> None:
        self.columns, self.schema, self.attempts, self.wait, self.ttl = columns, schema, attempts, wait, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tries = handle.getValueState("tries", "attempt int, due boolean", self.ttl)
        self.row = handle.getValueState("row", self.schema, self.ttl)

    def _admit(self, row: tuple, attempt: int) -> Row:
        self.tries.update((attempt, False))
        return Row(*self.columns, "attempt")(*row, attempt)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        for row in rows:
            seen = self.tries.get() if self.tries.exists() else None
            if row[FAILED]:
                # A failure counts once: for the last attempt made, and while no retry is due.
                if seen is not None and not seen[1] and row["attempt"] == seen[0] and seen[0] < self.attempts and self.row.exists():
                    if self.wait:
                        self.tries.update((seen[0], True))
                        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait)
                    else:
                        yield self._admit(tuple(self.row.get()), seen[0] + 1)
            elif seen is None:
                values = tuple(row[c] for c in self.columns)
                if self.attempts > 1:
                    self.row.update(values)
                yield self._admit(values, 1)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:  # noqa: N802, N803
        if self.tries.exists() and self.row.exists():
            yield self._admit(tuple(self.row.get()), self.tries.get()[0] + 1)

    def handleInitialState(self, key: tuple, initialState: Row, timerValues: object) -> None:  # noqa: N802, N803
        self.tries.update((self.attempts, False))

    def close(self) -> None:
        pass


def admitted(stream: DataFrame, key: str = "candidate_id", failures: DataFrame | None = None, done: DataFrame | None = None, attempts: int = 1, wait: int = 0, ttl: int | None = None) -> DataFrame:
    """Rows of the stream whose key comes for the first time, and those whose retry is due, with attempt.

    failures: a stream of (key, attempt) of what went wrong. done: a table of keys that count as seen when the query starts for the first time. The session's state store must be RocksDB (`start` sees to it).
    """
    columns = [key, *[c for c in stream.columns if c != key]]
    both = stream.select(*columns, F.lit(None).cast("int").alias("attempt"), F.lit(False).alias(FAILED))
    if failures is not None:
        both = both.unionByName(failures.select(key, "attempt", F.lit(True).alias(FAILED)), allowMissingColumns=True)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in (stream.schema[c] for c in columns)])
    out = T.StructType([*schema.fields, T.StructField("attempt", T.IntegerType())])
    start = None if done is None else done.select(key).where(F.col(key).isNotNull()).distinct().groupBy(key)
    gate = Admission(columns, schema, attempts, wait, ttl)
    return both.where(F.col(key).isNotNull()).groupBy(key).transformWithState(gate, out, "Append", "ProcessingTime" if wait or ttl else "None", initialState=start)


def first_tries(stream: DataFrame, done: DataFrame, key: str = "candidate_id", failures: DataFrame | None = None, attempts: int = 1) -> DataFrame:
    """What `admitted` gives without waits and limited lives, from an aggregation whose state is an id's row, when it came, and the failures reported of it. For update mode.

    done: a stream of keys that count as seen; they win over rows of their own batch. Batches are told apart by their time, which Spark logs with them, so a replay gives the same rows. Failures count in the order of
    their batches: one of the last attempt made leads to the next, while attempts are left; others, and those of ids that hadn't come before, don't count.
    """
    columns = [key, *[c for c in stream.columns if c != key]]
    kinds = {"row": stream.select(F.struct(*columns)).schema[0].dataType, "attempt": "int", "done": "boolean"}
    part = lambda df, **given: df.select(F.col(key), *[given.get(c, F.lit(None)).cast(kind).alias(f"_{c}") for c, kind in kinds.items()])
    every = part(stream, row=F.struct(*columns)).union(part(done, done=F.lit(True)))
    if failures is not None:
        every = every.union(part(failures, attempt=F.col("attempt")))
    at = F.when(F.col("_row").isNotNull(), F.col("_at"))
    state = [F.min(at).alias("_came"), F.min_by("_row", at).alias("_row"), F.max("_done").alias("_done")]
    if failures is not None:
        state.append(F.collect_set(F.when(F.col("_attempt").isNotNull(), F.struct(F.col("_at").alias("at"), F.col("_attempt").alias("attempt")))).alias("_failures"))
    kept = every.where(F.col(key).isNotNull()).withColumn("_at", F.current_timestamp()).groupBy(key).agg(*state)
    last = F.struct(F.lit(1).alias("attempt"), F.col("_came").alias("at"))
    if failures is not None:
        counts = lambda s, f: (f["at"] > F.col("_came")) & (f["attempt"] == s["attempt"]) & (s["attempt"] < attempts)
        step = lambda s, f: F.when(counts(s, f), F.struct((s["attempt"] + 1).alias("attempt"), f["at"].alias("at"))).otherwise(s)
        last = F.aggregate(F.array_sort("_failures"), last, step)
    made = kept.where(F.col("_came").isNotNull() & F.col("_done").isNull()).withColumn("_last", last)
    return made.where(F.col("_last.at") == F.current_timestamp()).select("_row.*", F.col("_last.attempt").alias("attempt"))


def _landed(done: DataFrame | None, stream: DataFrame, checkpoint: str, key: str) -> DataFrame:
    """The keys done before the query's first start, as a stream. They are written once, beside the checkpoint's own folders; later starts read what the first one wrote."""
    spark, path = stream.sparkSession, f"{checkpoint}/done"
    keys = stream.select(key).schema
    if not exists(spark, f"{path}/_SUCCESS"):
        rows = spark.createDataFrame([], keys) if done is None else done.select(F.col(key).cast(keys[0].dataType).alias(key)).where(F.col(key).isNotNull()).distinct()
        rows.write.mode("overwrite").parquet(path)
    return spark.readStream.schema(keys).parquet(path)


def resume_scoring(
    stream: DataFrame, score: Callable[[DataFrame], DataFrame], registry: str, failures: str, digest: str, checkpoint: str, key: str = "candidate_id", attempts: int = 1, wait: int = 0, ttl: int | None = None,
    done: DataFrame | None = None,
) -> StreamingQuery:
    """Scores each candidate of the stream once and appends it to the registry, or, where it went wrong, to the failures; these are tried again while attempts are left.

    score gives the key, further columns and error, null where it went well. The registry and the failures have a folder for each batch, digest and query: a batch that is replayed after a
    crash overwrites its own and adds nothing, so results hold each (id, hash) once, and no batch reads what earlier ones wrote. Failures come back as a stream. `done`: ids that were registered, or have
    failed, before the query's first start. Null ids are left out. The query ends when it has read what there is; with a wait or a ttl, whose clock always asks for another batch, after one batch of all there is.
    """
    spark = stream.sparkSession
    again = None
    if attempts > 1:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(failures)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
        again = spark.readStream.schema(f"{key} string, error string, attempt int, imagery_config_hash string").parquet(f"{failures}/*/").where(F.col("imagery_config_hash") == digest)
    timed = bool(wait or ttl)
    fresh = admitted(stream, key, again, done, attempts, wait, ttl) if timed else first_tries(stream, _landed(done, stream, checkpoint, key), key, again, attempts)

    def work(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        scored = score(batch.drop("attempt")).persist()
        hashed = F.lit(digest).alias("imagery_config_hash")
        scored.where("error is null").drop("error").select("*", hashed).write.mode("overwrite").parquet(f"{registry}/run={digest}-{batch_id}")
        bad = scored.where("error is not null").join(batch.select(key, "attempt"), key).select(key, F.substring("error", 1, 200).alias("error"), "attempt", hashed)
        if not bad.isEmpty():
            bad.write.mode("overwrite").parquet(f"{failures}/run={digest}-{batch_id}")
        scored.unpersist()
        batch.unpersist()

    how = {"once": True} if timed else {"availableNow": True}
    return start(fresh, lambda w: w.outputMode("append" if timed else "update").foreachBatch(work).option("checkpointLocation", checkpoint).trigger(**how).start())


def start(df: DataFrame, run: Callable[[object], StreamingQuery]) -> StreamingQuery:
    """run(df.writeStream) with the state store that keyed processors need; the session's own setting is put back."""
    spark = df.sparkSession
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        return run(df.writeStream)
    finally:
        spark.conf.set(STORE, before) if before is not None else spark.conf.unset(STORE)


def first_arrivals(stream: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """Each key at most once within the watermark, whose state is then dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def retry_failed(
    candidates: DataFrame, score: Callable[[DataFrame], DataFrame], registry: str, failures: str, digest: str, key: str = "candidate_id",
) -> DataFrame:
    """Scores all candidates that the failures hold, adds those that went well to the registry, and leaves the failures with those that failed again; gives these and the others, with error.

    The new failures are written beside the old ones first, which then go: a crash in between leaves both, and the next run takes each id once.
    """
    spark = candidates.sparkSession
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(failures).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [str(f.getPath()) for f in fs.listStatus(fs_path(failures))] if exists(spark, failures) else []
    old = [p for p in old if p.rsplit("/", 1)[-1].startswith("run=")]
    if not old:
        return candidates.select(key).limit(0).withColumn("error", F.lit(None).cast("string"))
    turn = 1 + max((int(p.rsplit("-retry", 1)[1]) for p in old if "-retry" in p), default=0)
    ids = spark.read.schema(f"{key} string, imagery_config_hash string").parquet(*old).where(F.col("imagery_config_hash") == digest).select(key).distinct()
    scored = score(candidates.dropDuplicates([key]).join(ids, key, "left_semi")).persist()
    hashed = F.lit(digest).alias("imagery_config_hash")
    scored.where("error is null").drop("error").select("*", hashed).write.mode("overwrite").parquet(f"{registry}/run={digest}-retry{turn}")
    others = spark.read.schema(f"{key} string, error string, attempt int, imagery_config_hash string").parquet(*old).where(F.col("imagery_config_hash") != digest)
    scored.where("error is not null").select(key, F.substring("error", 1, 200).alias("error"), F.lit(1).alias("attempt"), hashed).unionByName(others).write.mode("overwrite").parquet(f"{failures}/run={digest}-retry{turn}")
    for p in old:
        fs.delete(fs_path(p), True)
    out = spark.read.schema(f"{key} string, error string, imagery_config_hash string").parquet(f"{failures}/run={digest}-retry{turn}").where(F.col("imagery_config_hash") == digest).select(key, "error")
    good = spark.read.schema(f"{key} string").parquet(f"{registry}/run={digest}-retry{turn}").select(key, F.lit(None).cast("string").alias("error"))
    scored.unpersist()
    return out.union(good)
