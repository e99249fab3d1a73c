"""Target-distribution importance resampling: documents are weighed by how much likelier their words are in a target set than in the corpus, and the k best noisy weights are drawn.

A feature is a run of consecutive words; its bucket is a hash. Counts by bucket, of the corpus and of the target, give each bucket a gain, an array of one number a bucket, and a document's weight is
the sum over its features. Noise of the Gumbel distribution, by a hash of the id, makes the best k a draw without replacement in proportion to the exponential of the weight.

Scale: counts are summed in each task before the shuffle, which gets a row a bucket and task. The array, BUCKETS numbers whatever the corpus, is a constant of the scoring pass. The k-th best is found by distributed
quickselect over composite keys (score, id, features, row), which no two rows share: each round draws PIVOTS random keys among the rows still open, counts exactly how many
lie below, on and between them, and goes on with the one interval that holds the k-th; a round's open rows, about 1 / PIVOTS of the last one's, are a written table, and counts alone come to the driver.
Only winners are sorted, by range partitions, and ranked.

Defined cases: a null or empty text has no features, weight 0 and too few words to be drawn; texts of any length are read whole; a null id counts as the text "null" for the noise and comes before others in a tie; rows
alike in id and score are told apart by their features, then by their place in the written table (such rows differ in nothing that decides); an empty corpus or target counts no features; extra
columns are carried, whatever their names.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoquill.llm.common import prepare, read, settled, unused, write_table
from geoquill.operators.ranks import ordered_rank

BUCKETS = 10_000
PIVOTS = 32
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024

#: Words are runs of digits, lower-case ASCII letters and all characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str | Column) -> Column:
    """Words of the text, A-Z lower-cased; none for null."""
    low = F.translate(F.col(text) if isinstance(text, str) else text, UPPER, LOWER)
    return F.regexp_extract_all(F.coalesce(low, F.lit("")), F.lit(WORD), F.lit(0))


def bucket(feature: Column, buckets: int = BUCKETS) -> Column:
    return (F.crc32(feature.cast("binary")) % buckets).cast("int")


def features(found: Column, n: int = 1) -> Column:
    """Runs of 1 to n of the words, joined by one space."""

    def runs(size: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(found) - (size - 1))
        return F.when(F.size(found) >= size, F.transform(starts, lambda i: F.array_join(F.slice(found, i, size), " "))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.array(found, *map(runs, range(2, n + 1)))) if n > 1 else found


def bucket_counts(df: DataFrame, text: str = "text", n: int = 1, buckets: int = BUCKETS) -> dict[int, int]:
    """Features in each bucket, of whole texts and repeats counted: at most one row a bucket comes to the driver."""
    each = df.select(F.explode(features(words(text), n)).alias("f")).groupBy(bucket(F.col("f"), buckets).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return {r["b"]: r["n"] for r in each.collect()}


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """floor(1000 * ln(p / q)) by bucket, p and q the smoothed shares of the bucket in target and corpus."""
    all_, aim = sum(corpus.values()), sum(target.values())
    return [math.floor(1000 * math.log((float(target.get(b, 0)) + 1) * (float(all_) + buckets) / ((float(corpus.get(b, 0)) + 1) * (float(aim) + buckets)))) for b in range(buckets)]


def noise(key: str, seed: int = SEED) -> Column:
    """floor(1000 * g), g of the Gumbel distribution by a hash of the seed and the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null"))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def scored(df: DataFrame, gain: list[int], key: str = "doc_id", text: str = "text", n: int = 1, seed: int = SEED) -> DataFrame:
    """Adds n_features, weight and score. The gains are an array of the plan, of a fixed size."""
    table = F.from_json(F.lit(str(gain)), "array<int>")
    found = F.transform(features(words(text), n), lambda f: F.get(table, bucket(f, len(gain))).cast("long"))
    (hit,) = unused(df, "gained")
    out = df.withColumn(hit, found)
    out = out.withColumns({"n_features": F.size(hit).cast("long"), "weight": F.aggregate(hit, F.lit(0).cast("long"), lambda s, x: s + x)}).drop(hit)
    return out.withColumn("score", F.col("weight") + noise(key, seed))


def _before(key: list[str], pivot: tuple) -> Column:
    """Whether the row's key, without nulls, comes before the pivot's."""
    return F.struct(*key) < F.struct(*[F.lit(x).cast("long") for x in pivot])


def kth_key(rows: DataFrame, key: list[str], k: int) -> tuple | None:
    """The k-th least composite key (long columns without nulls, all rows differ), k from 1, by quickselect; None where there are fewer rows.

    A round's pivots are the rows whose hash, of key and round, is least: a random sample of open rows. Rows below, on and between pivots are counted, and rows of other intervals than that of the k-th are closed.
    """
    left, turn = rows.select(*key), 0
    while True:
        turn += 1
        pivots = sorted(tuple(r) for r in left.orderBy(F.xxhash64(F.lit(turn), *key), *key).limit(PIVOTS).select(*key).collect())
        if not pivots:
            return None
        # Even places lie between pivots, odd ones on them.
        place = reduce(lambda a, b: a + b, [F.when(_before(key, p), 0).when(reduce(lambda a, b: a & b, [F.col(c) == v for c, v in zip(key, p, strict=True)]), 1).otherwise(2) for p in pivots])
        counts = {r["place"]: r["n"] for r in left.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n")).collect()}
        at = None
        for p in sorted(counts):
            if k <= counts[p]:
                at = p
                break
            k -= counts[p]
        if at is None:
            return None
        if at % 2:
            return pivots[at // 2]
        left = write_table(left.where(place == at), "open_rows")


def draw(df: DataFrame, n: int | None = None, percent: int = 100, key: str = "doc_id", score: str = "score", wide: str = "n_features", drawn: str = "rank", eligible: Column | None = None) -> DataFrame:
    """Adds `drawn`: 1, 2, ... for the n eligible rows of highest score (ties: smaller key), or for so many percent of the eligible rows, rounded down; null for all others. df is written once."""
    names = df.columns
    row, able, a, b, c = unused(df, "row_", "able_", "key_a", "key_b", "key_c")
    least = F.lit(-(1 << 63)).cast("long")
    can = F.coalesce(eligible, F.lit(False)) if eligible is not None else F.lit(True)
    rows = write_table(df.withColumns({row: F.monotonically_increasing_id(), able: can, a: -F.col(score), b: F.coalesce(F.col(key).cast("long"), least), c: F.col(wide).cast("long")}), "scored")
    keys, open_ = [a, b, c, row], rows.where(able)
    if n is None:
        n = percent * open_.count() // 100
    last = kth_key(open_, keys, n) if n > 0 else None
    won = F.col(able) & F.lit(n > 0)
    if last is not None:
        won = won & ~(F.struct(*keys) > F.struct(*[F.lit(x).cast("long") for x in last]))
    order = ordered_rank(rows.where(won).select(*keys), [], keys, drawn).select(row, F.col(drawn).cast("long").alias(drawn))
    return rows.where(won).join(order, row).select(*names, drawn).unionByName(rows.where(~won).select(*names, F.lit(None).cast("long").alias(drawn)))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, n: int = 1, key: str = "doc_id", text: str = "text", seed: int = SEED, carry: tuple[str, ...] | None = None) -> DataFrame:
    """docs with n_features, weight, score and rank: `percent` of the documents of at least `least` words are drawn. carry: the columns to keep, all where it is not given."""
    carry = tuple(docs.columns) if carry is None else carry
    # A document of w words has w + (w - 1) + ... features; for single words these are the words.
    enough = sum(max(0, least - size) for size in range(n))

    def build() -> DataFrame:
        gain = gains(bucket_counts(docs, text, n), bucket_counts(target, text, n))
        rows = scored(docs, gain, key, text, n, seed).select(*carry, "n_features", "weight", "score")
        return draw(rows, percent=percent, key=key, eligible=F.col("n_features") >= enough)

    return settled(docs.sparkSession, build, "resampled")


def op11_resample(spark, sf_dir: str) -> DataFrame:
    prepare(spark)
    return resample(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"), carry=("doc_id",))


#: crc32 by a table that its polynomial gives, over the bytes of each distinct word.
OP11_SQL = r"""
WITH RECURSIVE crc AS (SELECT i, i AS c, 0 AS k FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM crc WHERE k < 8),
steps AS (SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8),
split AS (SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
          UNION ALL SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
each AS (SELECT side, unnest(w) AS word FROM split),
n AS (SELECT word, count(*) FILTER (side = 'd') AS d, count(*) FILTER (side = 'b') AS b FROM each GROUP BY word),
coded AS (SELECT word, d, b, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(hex(encode(word))), 2), lambda i: ('0x' || substr(hex(encode(word)), i::BIGINT, 2))::BIGINT)),
          lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) % 10000 AS bucket FROM n, steps),
per AS (SELECT bucket, sum(d) AS s, sum(b) AS t FROM coded GROUP BY bucket),
tot AS (SELECT coalesce(sum(s), 0)::DOUBLE AS big_s, coalesce(sum(t), 0)::DOUBLE AS big_t FROM per),
gain AS (SELECT c.word, floor(1000 * ln((p.t::DOUBLE + 1) * (big_s + 10000) / ((p.s::DOUBLE + 1) * (big_t + 10000))))::BIGINT AS g FROM coded c JOIN per p USING (bucket), tot),
rows AS (SELECT row_number() OVER () AS r, id AS doc_id, w FROM split WHERE side = 'd'),
used AS (SELECT r, unnest(w) AS word FROM rows),
sums AS (SELECT r, sum(g)::BIGINT AS weight FROM used JOIN gain USING (word) GROUP BY r),
fin AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
        (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT + 0.5) / 4294967296.0)))::BIGINT)::BIGINT AS score FROM rows LEFT JOIN sums USING (r)),
best AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST, n_features) END AS place, (SELECT count(*) FROM fin WHERE n_features >= 20) * 10 // 100 AS k FROM fin)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= k THEN place END::BIGINT AS rank FROM best
"""
