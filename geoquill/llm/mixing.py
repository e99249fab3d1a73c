"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Every document of a source expects the same number of copies, target / source size. The documents of a source are
put in an order by size class, hash bucket, size and id; the prefix sum of expected copies is then an index times that
number, one random offset is added, and a document is emitted once per integer boundary its interval crosses. Ordering by
size makes the words taken follow the target closely, not only the number of documents.

Scale: the text is read once for its size; only (id, size, source) is kept. Prefix counts are taken over buckets of a
bounded number of rows (pre-aggregated), then within each bucket, so a source with a third of all rows is spread over
many tasks.

Defined cases: null text has size 0; the null source is a source of its own and comes last; a source of size 0 has target 0
and gives nothing; null ids sort first; repeated rows are separate documents, and rows that differ in any column stay apart; rows alike in size and id
stand next to each other in any order; texts are counted whole; an empty table gives an empty result; extra
columns are ignored by `plan_mix` and carried by `mix` under any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoquill.llm.common import WORD, prepare, read, settled, unused, write_table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: A bucket is split by hash so that it has about this many rows of its source at most.
BUCKET_ROWS = 20_000
SEED = 7


def _uniform(*parts: Column) -> Column:
    """An integer from 0 to 2^32 - 1, the same in other SQL engines."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def row_hash(docs: DataFrame) -> Column:
    """128 bits of all columns of a row."""
    whole = F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]))
    return F.struct(F.xxhash64(whole).alias("a"), F.xxhash64(F.lit(1), whole).alias("b"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size in words, source, row_ (a hash of the whole row), and the source's key, which tells null from any text."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.col("source").cast("string").alias("source"),
        row_hash(docs).alias("row_"),
    ).withColumn("src_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source: src_key, source_size, n_docs, target.

    Targets are proportional to the weights and stop at `most` times the source's size; what is cut off is shared again by
    weight. That ends at target = min(cap, level * weight) with one level for all, which running sums in order of
    cap / weight give. The rows here are sources, one each, after aggregation.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy("ratio", "nr")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    held = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    gone = F.coalesce(F.sum("w").over(before), F.lit(0.0))
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod("nr", F.lit(len(weights))) + 1).cast("int"))
    return (
        sizes.groupBy("src_key", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
        .withColumn("nr", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumn("w", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("ratio", F.col("cap") / F.col("w"))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("all_w", F.sum("w").over(everything))
        .withColumn("level", (F.col("total") - held) / (F.col("all_w") - gone))
        .withColumn("open", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "nr", "level"))).over(everything))
        .select("src_key", "source_size", "n_docs", F.coalesce(F.least("cap", F.col("open.level") * F.col("w")), F.col("cap")).alias("target"))
    )


def plan_mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, row_ (hash of the row), size, source_size, target, copies, taken (= copies * size)."""
    return settled(docs.sparkSession, lambda: _plan_mix(docs, weights, share, most, seed), "mix_plan")


def _plan_mix(docs: DataFrame, weights, share: float, most: float, seed: int) -> DataFrame:
    base = write_table(sized(docs), "sizes")
    per = write_table(targets(base, weights, share, most), "targets")
    splits = (F.lit(1) + F.floor(F.col("n_docs") / BUCKET_ROWS)).cast("long")
    placed = base.join(per, "src_key").select(
        "doc_id", "size", "row_", "src_key", "source_size", "target",
        F.floor(F.sqrt(F.col("size").cast("double"))).cast("long").alias("cls"),
        (_uniform(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % splits).alias("part"),
    )
    cell = ["src_key", "cls", "part"]
    starts = placed.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).select(
        *cell,
        F.coalesce(F.sum("n").over(Window.partitionBy("src_key").orderBy("cls", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"),
    )
    index = F.col("start") + F.row_number().over(Window.partitionBy(*cell).orderBy("size", "doc_id")) - 1
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = _uniform(F.lit(str(seed)), "src_key") / F.lit(float(2**32))
    return (
        placed.join(starts, cell)
        .withColumn("i", index).withColumn("e", each).withColumn("u", offset)
        .withColumn("copies", (F.floor(F.col("u") + F.col("e") * (F.col("i") + 1)) - F.floor(F.col("u") + F.col("e") * F.col("i"))).cast("long"))
        .select("doc_id", "row_", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with the number of the copy (copy_no, or with underscores where docs has it) from 1. Rows alike in all columns count together."""
    r1, r2, copies, copy_no = unused(docs, "r1", "r2", "copies", "copy_no")
    taken = plan_mix(docs, weights, share, most, seed).groupBy(F.col("row_.a").alias(r1), F.col("row_.b").alias(r2)).agg(F.sum("copies").cast("int").alias(copies)).where(F.col(copies) > 0)
    h = row_hash(docs)
    rows = docs.withColumns({r1: h["a"], r2: h["b"]}).dropDuplicates([r1, r2])
    return rows.join(taken, [r1, r2]).withColumn(copy_no, F.explode(F.sequence(F.lit(1), F.col(copies)))).drop(r1, r2, copies)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: columns of docs and copy_no. Nulls, repeats, empty tables: as for the module."""
    prepare(spark)
    return mix(docs)


def op4_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = read(prepare(spark), sf_dir, "documents").select("doc_id", "text", "source")
    return plan_mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH base AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, source,
         coalesce('s' || source, 'null') AS src_key FROM documents),
per0 AS (SELECT src_key, source, sum(size)::BIGINT AS source_size, count(*) AS n_docs FROM base GROUP BY 1, 2),
per1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nr FROM per0),
per2 AS (SELECT *, CASE nr % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS w, source_size * 2e0 AS cap FROM per1),
per3 AS (SELECT *, cap / w AS ratio, (sum(source_size) OVER ())::DOUBLE * 1.5e0 AS total, sum(w) OVER () AS all_w FROM per2),
per4 AS (SELECT *, (total - coalesce(sum(cap) OVER before, 0e0)) / (all_w - coalesce(sum(w) OVER before, 0e0)) AS level FROM per3
         WINDOW before AS (ORDER BY ratio, nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lvl AS (SELECT level FROM per4 WHERE ratio > level ORDER BY ratio, nr LIMIT 1),
per AS (SELECT src_key, source_size, n_docs, coalesce(least(cap, (SELECT level FROM lvl) * w), cap) AS target FROM per4),
placed AS (
  SELECT doc_id, size, src_key, source_size, target, floor(sqrt(size::DOUBLE))::BIGINT AS cls,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % (1 + n_docs // 20000) AS part
  FROM base JOIN per USING (src_key)),
indexed AS (
  SELECT *, row_number() OVER (PARTITION BY src_key ORDER BY cls, part, size, doc_id NULLS FIRST) - 1 AS i,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0e0 END AS e,
         ('0x' || substr(md5('7:' || src_key), 1, 8))::BIGINT / 4294967296e0 AS u FROM placed)
SELECT doc_id, size, source_size, target, ((floor(u + e * (i + 1)) - floor(u + e * i))::BIGINT * size)::BIGINT AS taken FROM indexed
"""
