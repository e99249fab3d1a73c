"""Centroid clustering: Lloyd's rounds in integers, where each vector finds its nearest centroid by the threshold algorithm.

For every dimension the centroids are listed in the order of that component. A vector enters each list at its own value and walks outward, always to the nearer of the two next entries; what a walk reaches is
compared exactly. The squares of the distances that the walks have reached add up to the least distance that a centroid not met yet can have, so a vector stops when that sum
strictly exceeds its best exact distance (a centroid at the same distance could have a smaller number). Walks of all vectors of a batch go on side by side in numpy.

Scale: vectors stay where they lie, as one written table of integers; each round is one pass that sends a row for each task and cluster, of sums that Spark then adds, to the driver k rows; so a cluster that holds most
vectors costs nothing more. Only centroids, k times the dimensions, go through the driver. A lost executor costs its tasks of one pass, as a round's sums don't depend on who made them.

Defined cases: vectors of other lengths, null vectors and those with a null or non-finite component are left out; components beyond LARGEST in size, after scaling, count as LARGEST, so that a distance is exact
in 64 bits; repeated vectors are vectors each; a null id hashes as an empty text; ids of one hash are ordered by their vectors; fewer vectors than k give as many centroids; no vectors give no
rows; ties go to the smaller number; an empty cluster keeps its centroid; extra columns aren't read by the query, and carried by `clustered` under any name but those that it adds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoquill.llm.common import prepare, read, settled, unused, write_table

DIMS = 64
CLUSTERS = 8
ROUNDS = 10
SEED = 3
SCALE = 1024
LARGEST = 1 << 26
#: Vectors of a numpy block.
BLOCK = 4096


class Lists:
    """Per dimension the centroids' components in rising order, and whose they are."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids
        self.k, self.dims = centroids.shape
        self.who = np.argsort(centroids, axis=0, kind="stable").T.copy()  # dims x k
        self.value = np.take_along_axis(centroids.T, self.who, axis=1)

    def enter(self, x: np.ndarray) -> np.ndarray:
        """For each vector and dimension how many entries lie below its value."""
        return np.stack([np.searchsorted(self.value[d], x[:, d]) for d in range(self.dims)], axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of the nearest centroid of each row of x, and how many entries were read."""
        n = len(x)
        best, number = np.full(n, np.iinfo(np.int64).max), np.full(n, self.k)
        seen = np.zeros((n, self.k), bool)
        high = self.enter(x)
        low = high - 1
        rows, dims, read = np.arange(n), np.arange(self.dims), 0
        far = np.int64(4 * LARGEST)
        for _ in range(self.k):
            own = x[rows]
            down = np.where(low >= 0, own - self.value[dims, np.maximum(low, 0)], far)
            up = np.where(high < self.k, self.value[dims, np.minimum(high, self.k - 1)] - own, far)
            left = down <= up
            met = np.where(left, self.who[dims, np.maximum(low, 0)], self.who[dims, np.minimum(high, self.k - 1)])
            frontier = np.where(left, down, up)
            low, high = low - left, high + ~left
            read += met.size
            new = np.zeros((len(rows), self.k), bool)
            new[np.arange(len(rows))[:, None], met] = True
            at, c = np.nonzero(new & ~seen[rows])
            if len(at):
                d = ((own[at] - self.centroids[c]) ** 2).sum(axis=1)
                order = np.lexsort((c, d, at))
                first = np.unique(at[order], return_index=True)
                pick = order[first[1]]
                who, dist, num = rows[first[0]], d[pick], c[pick]
                better = (dist < best[who]) | ((dist == best[who]) & (num < number[who]))
                best[who[better]], number[who[better]] = dist[better], num[better]
                seen[rows[at], c] = True
            going = (frontier**2).sum(axis=1) <= best[rows]
            if not going.any():
                break
            rows, low, high = rows[going], low[going], high[going]
        return number, best, read


def _blocks(batches: Iterator[pa.RecordBatch], column: str, dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part, part.column(part.schema.get_field_index(column)).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def integers(df: DataFrame, column: str, out: str, dims: int = DIMS) -> DataFrame:
    """Rows whose vector has exactly `dims` components, all finite, with the vector as integers floor(SCALE * x)."""
    x = F.transform(F.col(column), lambda v: v.cast("double"))
    fine = (F.size(column) == dims) & F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False)))
    whole = F.transform(x, lambda v: F.floor(F.greatest(F.least(v * SCALE, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))).cast("int"))
    return df.where(F.coalesce(fine, F.lit(False))).withColumn(out, whole)


def first_centroids(rows: DataFrame, key: str, vector: str, k: int, seed: int) -> np.ndarray:
    """The k vectors whose ids have the least hashes, in that order."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    return np.array([r["v"] for r in rows.select(h.alias("h"), F.col(vector).alias("v")).orderBy("h", "v").limit(k).collect()], np.int64)


def moved(rows: DataFrame, vector: str, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: floor of the exact mean of what each is nearest to. Tasks send a row for each cluster."""
    k, dims = centroids.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, n, sums = Lists(centroids), np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for _, x in _blocks(batches, vector, dims):
            number = lists.nearest(x)[0]
            n += np.bincount(number, minlength=k)
            np.add.at(sums, number, x)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"c": pa.array(some, pa.int32()), "n": pa.array(n[some], pa.int64()), "s": pa.array(list(sums[some]), pa.list_(pa.int64()))})

    parts = rows.select(vector).mapInArrow(work, "c int, n long, s array<long>")
    total = parts.groupBy("c").agg(F.sum("n").alias("n"), *[F.sum(F.get("s", F.lit(d))).alias(f"s{d}") for d in range(dims)])
    out = centroids.copy()
    for r in total.collect():
        out[r["c"]] = [r[f"s{d}"] // r["n"] for d in range(dims)]
    return out


def clustered(df: DataFrame, column: str = "embedding", key: str = "vec_id", k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, seed: int = SEED, carry: tuple[str, ...] | None = None) -> DataFrame:
    """Kept rows of df with cluster, distance (squared), cluster_inertia, inertia and centroid_sha256. carry: the columns to keep, all where it is not given."""
    carry = tuple(df.columns) if carry is None else carry

    def build() -> DataFrame:
        (vector,) = unused(df, "whole_")
        rows = write_table(integers(df, column, vector, dims).select(*dict.fromkeys([key, *carry]), vector), "vectors")
        centroids = first_centroids(rows, key, vector, k, seed)
        names = [c for c in carry if c not in ("cluster", "distance")]
        if not len(centroids):
            return rows.select(*names, *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
        for _ in range(rounds):
            centroids = moved(rows, vector, centroids)

        own = rows.select(*names, vector)
        plain = [own.schema[c] for c in names]

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lists = Lists(centroids)
            for part, x in _blocks(batches, vector, dims):
                number, distance, _ = lists.nearest(x)
                cols = [part.column(part.schema.get_field_index(c)) for c in names]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(number, pa.int32()), pa.array(distance, pa.int64())], names=[*names, "cluster", "distance"])

        schema = T.StructType([*plain, T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
        placed = write_table(own.mapInArrow(work, schema), "placed")
        sums = {r["cluster"]: int(r["s"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38, 0)")).alias("s")).collect()}
        most, everything = (1 << 63) - 1, sum(sums.values())
        facts = [(c, min(sums.get(c, 0), most), hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.tolist())]
        table = df.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, centroid_sha256 string")  # k rows
        out = placed.join(F.broadcast(table), "cluster").withColumn("inertia", F.lit(min(everything, most)).cast("long"))
        return out.select(*names, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

    return settled(df.sparkSession, build, "clustered")


def op13_centroid_clusters(spark, sf_dir: str) -> DataFrame:
    return clustered(read(prepare(spark), sf_dir, "embeddings").select("vec_id", "embedding"), carry=("vec_id",))


def _sql() -> str:
    assign = lambda t: f"""a{t} AS MATERIALIZED (SELECT i, min(struct_pack(d := dist, c := c)) AS m
        FROM (SELECT k.i, c.c, list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS dist FROM kept k, c{t} c) GROUP BY i)"""  # noqa: E731
    move = lambda t: f"""s{t} AS (SELECT m.c AS c, j, sum(v[j]) AS s, count(*) AS n FROM a{t} JOIN kept USING (i), range(1, {DIMS + 1}) r(j) GROUP BY 1, 2),
    m{t} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS v FROM s{t} GROUP BY c), c{t + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{t} o LEFT JOIN m{t} m USING (c))"""  # noqa: E731
    steps = ",\n".join(f"{assign(t)},\n{move(t)}" for t in range(ROUNDS))
    last = f"a{ROUNDS}"
    return f"""
WITH sound AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
    WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}),
kept AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(e, lambda x: floor(greatest(least(x * {SCALE}, {LARGEST}), -{LARGEST}))::BIGINT) AS v FROM sound),
firsts AS (SELECT v, row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c FROM kept),
c0 AS MATERIALIZED (SELECT c, v FROM firsts WHERE c < {CLUSTERS}),
{steps},
{assign(ROUNDS)},
fin AS (SELECT k.vec_id, m.c AS c, m.d AS d FROM {last} JOIN kept k USING (i))
SELECT f.vec_id, f.c::INT AS cluster, f.d::BIGINT AS distance, (sum(f.d) OVER (PARTITION BY f.c))::BIGINT AS cluster_inertia, (sum(f.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM fin f JOIN c{ROUNDS} c USING (c)
"""


OP13_SQL = _sql()
