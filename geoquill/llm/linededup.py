"""Line dedup by a segment-partition edit join, in DataFrame functions only.

Lines are what newline bytes divide. A line that isn't blank is a repeat, and dropped, when the same line stands earlier in the corpus (by
doc_id, row, line number), or when an earlier line is within as many edits as the shorter of the two allows, one for each CHARS_PER_EDIT characters up to MAX_EDITS, whether or not that
one was kept: two edits in a few characters are another text. Distinct
lines are cut into MAX_EDITS + 1 segments; two lines within the threshold share a segment
at nearly the same place, so each line's segments are indexed by (number, length, content) and each line probes, for every
length it could match, the few substrings that the shift bounds allow. Candidates are verified by a banded bit-parallel edit distance: an automaton
whose states, MAX_EDITS + 1 lanes of 2 * MAX_EDITS + 1 diagonals each, are the bits of one integer that every character moves at once.

Scale: identical lines are aggregated first, by 128 bits of their content, so the join sees each distinct line once, by a number, and no copies meet each other; only
hashes are shuffled, and texts are fetched for candidates alone, through a sieve. Keys of KEY_BITS bits that fall together by chance cost a comparison. Both sides of the join are plain shuffles that AQE can split.

Defined cases: null text is no line and stays null; an empty text is one blank line; blank lines (nothing but 0x20 and 0x09 to 0x0D) are never repeats; null doc_ids come first in order; rows
alike in doc_id and text count as one row, and all of them keep or lose the same lines; lines of any length are compared whole; of equal lines the earliest stays, so there are no
ties; an empty table gives an empty result; extra columns aren't read by `dropped_lines`, and carried by `dedup` under any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoquill.llm.common import WORD, hash_128, prepare, read, settled, sieved, unused, write_table

MAX_EDITS = 2
CHARS_PER_EDIT = 16
#: Enough for some 10^12 keys with few that fall together; each bit more is shuffled with every probe.
KEY_BITS = 44


def allowed(length: Column, edits: int, every: int = CHARS_PER_EDIT) -> Column:
    """Edits within which a line of the length has near copies."""
    return F.least(F.lit(edits), F.floor(length / every).cast("int"))


def segment(length: Column, i: int, parts: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment i (from 0): the last `length % parts` segments are one longer."""
    base, rest = F.floor(length / parts), length % parts
    longer = F.greatest(F.lit(0), F.lit(i) - (parts - rest))
    return (base * i + longer + 1).cast("int"), (base + F.when(F.lit(i) >= parts - rest, 1).otherwise(0)).cast("int")


def probe_keys(line: Column, length: Column, edits: int, least: int) -> list[Column]:
    """Keys by which a line finds lines shorter by 0 to `edits`: for segment i only shifts that leave the edits balanced. Those of own_places are its index keys.
    Lines of fewer than `least` characters have none. The test stands inside each key and not around all, so that generated code computes what keys share once."""
    out = []
    for less in range(edits + 1):
        other = (length - less).cast("int")
        for i in range(edits + 1):
            start, size = segment(other, i, edits + 1)
            for shift in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1):
                ok = (length >= least) & (start + shift >= 1) & (start + shift + size - 1 <= length)
                out.append(F.when(ok, F.shiftrightunsigned(F.xxhash64(F.lit(i), other, line.substr((start + shift).cast("int"), size)), 64 - KEY_BITS)))
    return out


def own_places(edits: int) -> list[int]:
    """Places in probe_keys of the line's own index keys: no length less, no shift."""
    out, place = [], 0
    for i in range(edits + 1):
        shifts = range(max(-i, -(edits - i)), min(i, edits - i) + 1)
        out.append(place + shifts.index(0))
        place += len(shifts)
    return out


def _rows(docs: DataFrame) -> DataFrame:
    return docs.withColumn("row_", hash_128("doc_id", "text"))


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, row_, line_no, line of the lines that aren't blank, with h, a hash of the line."""
    split = _rows(docs.select("doc_id", "text")).select("doc_id", "row_", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return split.where(F.col("line").rlike(WORD)).withColumn("h", hash_128("line"))


def _texts(pairs: DataFrame, docs: DataFrame, uniq: DataFrame) -> DataFrame:
    """id, line, first of every line in the pairs (a, b)."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = write_table(uniq.select("id", "h", "first").join(wanted, "id"), "line_wanted")
    return write_table(sieved(lines(docs).select("h", "line"), "h", wanted).dropDuplicates(["h"]).join(wanted, "h").select("id", "line", "first"), "line_texts")


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether two texts are within `edits` edits, by a banded bit-parallel automaton.

    After i characters of a, bit j of lane d tells whether the first i + j - edits characters of b can be made of them with d edits. A character
    of a keeps the bits where b has the same one; to the next lane go all bits (substitution), those shifted down (insertion) and, after the step,
    those shifted up (deletion).
    """
    wide = 2 * edits + 1
    lanes = [1 << (wide * d) for d in range(edits + 1)]
    whole, low, high = (1 << wide * (edits + 1)) - 1, sum(lanes), sum(x << (wide - 1) for x in lanes)
    num = lambda x: F.lit(x).cast("long")
    once = lambda x, use: F.get(F.transform(F.array(x), use), F.lit(0))  # noqa: E731  x is computed once, however often use names it

    def matches(letters: Column) -> Column:
        # The place of every character of b that a step compares is looked up in an array; places outside it give null, which is no match.
        bit = lambda x, i, j: F.when(F.get(letters, i + (j - edits)) == x, num(low << j)).otherwise(num(0))
        return F.transform(F.split(a, ""), lambda x, i: sum((bit(x, i, j) for j in range(1, wide)), bit(x, i, 0)))

    def step(state: Column, match: Column) -> Column:
        down = F.shiftright(state, 1).bitwiseAND(num(whole & ~high))
        moved = state.bitwiseAND(match).bitwiseOR(F.shiftleft(state.bitwiseOR(down), wide).bitwiseAND(num(whole)))
        # Deletions go on to the next lane, and from there to the one after it.
        further = lambda x, k: x.bitwiseOR(F.shiftleft(further(x, k - 1).bitwiseAND(num(whole & ~high)), wide + 1).bitwiseAND(num(whole))) if k else x
        return once(moved, lambda x: further(x, edits))

    start = sum((1 << (edits + k)) << (wide * d) for d in range(edits + 1) for k in range(d + 1))
    end = F.aggregate(once(F.split(b, ""), matches), num(start), step)
    last = (F.length(b) - F.length(a) + (edits + wide * edits)).cast("int")
    near = F.abs(F.length(a) - F.length(b)) <= edits
    return near & (end.bitwiseAND(F.call_function("shiftleft", num(1), F.greatest(last, F.lit(0)))) != 0)


def _late(pairs: DataFrame, texts: DataFrame, edits: int, every: int) -> DataFrame:
    """id of the later line of those pairs (a, b) that are within the edits that the shorter line allows."""
    side = lambda x: texts.select(F.col("id").alias(x), F.col("line").alias(f"line_{x}"), F.col("first").alias(f"first_{x}"))
    a, b = F.col("line_a"), F.col("line_b")
    limit, near = allowed(F.least(F.length(a), F.length(b)), edits, every), F.lit(False)
    for k in range(1, edits + 1):
        near = F.when(limit == k, within(a, b, k)).otherwise(near)
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(near)
    return both.select(F.when(F.col("first_a") < F.col("first_b"), F.col("b")).otherwise(F.col("a")).alias("id")).distinct()


LETTERS = "etaoinshrdlucmwfgypbvkjxqz0123456789"


def letter_counts(line: Column) -> Column:
    """Counts of LETTERS, up to 127: a byte each, as these are shuffled. Cut-off counts differ by no more than the counts do."""
    return F.array(*[F.least(F.length(line) - F.length(F.replace(line, F.lit(c), F.lit(""))), F.lit(127)).cast("byte") for c in LETTERS])


def letter_keys(counts: Column, edits: int) -> Column:
    """Hashes of the letter counts, dealt into 2 * edits + 1 groups. An edit changes the counts of two characters at most, so lines within
    `edits` edits agree in one group at least."""
    groups = 2 * edits + 1
    return F.array(*[F.xxhash64(F.lit(g), *[F.get(counts, F.lit(k)) for k in range(g, len(LETTERS), groups)]) for g in range(groups)])


def letters_apart(a: str, b: str) -> Column:
    """Sum of the differences of two lines' letter counts: at most twice the edits."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)


def near_lines(docs: DataFrame, uniq: DataFrame, edits: int, every: int) -> DataFrame:
    """id of lines that have an earlier line within the edits allowed, other than themselves. uniq: id, h, first, probe (nulls for lines that have no near copies).

    Every probe first meets the earliest line of its key. Only where a key has more lines, and the later line of a pair isn't
    known as late yet, do they meet each other, and then only where the counts of a group of letters agree and all counts together differ by two for each
    edit at most: a family of like lines costs about its size, and so do lines that share a segment alone.
    """
    at = own_places(edits)
    long = uniq.where(F.get("probe", F.lit(at[0])).isNotNull())
    index = long.select(F.explode(F.array(*[F.get("probe", F.lit(k)) for k in at])).alias("key"), F.struct(F.col("first.doc_id").alias("doc_id"), "id").alias("at"))
    heads = index.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("head")).select("key", "n", F.col("head.id").alias("head"))
    probe = long.select("id", F.posexplode("probe").alias("place", "key")).where("key is not null").select("id", "key", F.col("place").isin(at).alias("own"))
    met = write_table(probe.join(heads, "key").where("id <> head or n > 1").select("key", "id", "head", "n", "own"), "line_met")
    first = write_table(met.where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b")).distinct(), "line_pairs")
    texts = _texts(first, docs, uniq)
    late = write_table(_late(first, texts, edits, every), "late_first")
    letters = texts.select("id", "first", letter_counts(F.col("line")).alias("counts")).withColumn("letters", F.explode(letter_keys(F.col("counts"), edits)))
    more = met.where("n > 1").select("key", "id", "own").join(letters, "id").join(late.withColumn("done", F.lit(True)), "id", "left")
    more = write_table(more.select("key", "letters", "id", "first", "counts", "own", F.coalesce("done", F.lit(False)).alias("done")), "line_more")
    r = more.select("key", "letters", F.col("id").alias("a"), F.col("first").alias("fa"), F.col("counts").alias("ca"), F.col("done").alias("done_a"))
    s = more.where("own").select("key", "letters", F.col("id").alias("b"), F.col("first").alias("fb"), F.col("counts").alias("cb"), F.col("done").alias("done_b"))
    like = (F.col("a") != F.col("b")) & (letters_apart("ca", "cb") <= 2 * edits)
    open_r = r.where("not done_a").join(s, ["key", "letters"]).where(like & (F.col("fb") < F.col("fa"))).select("a", "b")
    open_s = s.where("not done_b").join(r, ["key", "letters"]).where(like & (F.col("fa") < F.col("fb"))).select("a", "b")
    rest = open_r.union(open_s).distinct().join(first, ["a", "b"], "left_anti").join(first.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti")
    rest = write_table(rest, "line_pairs_rest")
    return late if rest.isEmpty() else late.union(_late(rest, texts, edits, every)).distinct()


def dropped_lines(docs: DataFrame, edits: int = MAX_EDITS, every: int = CHARS_PER_EDIT) -> DataFrame:
    """row_, dropped: the line numbers to drop, for rows that have any. A line has near copies within one edit for each `every` characters, up to `edits`."""
    return settled(docs.sparkSession, lambda: _dropped_lines(docs, edits, every), "drops")


def _dropped_lines(docs: DataFrame, edits: int, every: int) -> DataFrame:
    # Rows of one id are told apart by half of their hash here: it only has to differ within the id.
    place = F.struct("doc_id", F.col("row_.a").alias("row"), "line_no")
    keys = F.array(*probe_keys(F.col("line"), F.length("line"), edits, max(every, edits + 1)))
    keyed = lines(docs).select("h", place.alias("first"), keys.alias("probe"))
    uniq = keyed.groupBy("h").agg(F.min(F.struct("first", "probe")).alias("m"), F.count(F.lit(1)).alias("n")).select("h", "m.*", "n")
    uniq = write_table(uniq.withColumn("id", F.monotonically_increasing_id()), "lines")
    late = write_table(near_lines(docs, uniq, edits, every), "late")
    firsts = uniq.select("id", "h", "first", "n").join(late.withColumn("late", F.lit(True)), "id", "left").where("n > 1 or late").select("h", "first", "late")
    firsts = write_table(firsts, "firsts")
    gone = sieved(lines(docs).select("h", "doc_id", "row_", "line_no"), "h", firsts, exact=False).join(firsts, "h")
    gone = gone.where(F.col("late") | ~place.eqNullSafe(F.col("first")))
    return gone.groupBy("row_").agg(F.sort_array(F.collect_set("line_no")).alias("dropped"))


def dedup(docs: DataFrame, edits: int = MAX_EDITS, every: int = CHARS_PER_EDIT) -> DataFrame:
    """docs with repeats cut out of text; a document that had lines and lost all of them goes."""
    names = docs.columns
    row, drops = unused(docs, "row_", "drops")
    found = dropped_lines(docs, edits, every).select(F.col("row_").alias(row), F.col("dropped").alias(drops))
    parts = F.split("text", "\n")
    kept = F.filter(parts, lambda x, i: ~F.array_contains(F.col(drops), i))
    out = docs.withColumn(row, hash_128("doc_id", "text")).join(found, row, "left")
    left = out.where(F.col(drops).isNull() | (F.size(drops) < F.size(parts)))
    return left.withColumn("text", F.when(F.col(drops).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))).select(*names)


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = read(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    drops = dropped_lines(docs).withColumnRenamed("row_", "drop_row_")
    sizes = _rows(docs).select("doc_id", "row_", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("n_lines"))
    sizes = sizes.withColumn("n_lines", F.greatest("n_lines", F.lit(0)))
    return sizes.join(drops, F.col("row_") == F.col("drop_row_"), "left").select(
        "doc_id", "n_lines", F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped")).alias("n_dropped"), F.coalesce(F.array_join(F.col("dropped").cast("array<string>"), ","), F.lit("")).alias("dropped_lines")
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines, with all their columns; n_chars follows the text where there is one. Nulls, repeats, empty tables: as for the module."""
    prepare(spark)
    out = dedup(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


OP8_SQL = r"""
WITH rows AS (SELECT DISTINCT doc_id, text FROM documents),
parts AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM rows),
filled AS (SELECT * FROM parts WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
uniq AS (SELECT line, min(row(doc_id, line_no)) AS first, length(line) AS n FROM filled GROUP BY line),
late AS (SELECT DISTINCT b.line FROM uniq a JOIN uniq b ON a.n BETWEEN b.n - 2 AND b.n + 2 AND a.n >= 16 AND b.n >= 16 AND a.first < b.first AND levenshtein(a.line, b.line) <= least(2, least(a.n, b.n) // 16)),
gone AS (SELECT p.doc_id, p.text, p.line_no FROM filled p JOIN uniq u USING (line)
         WHERE row(p.doc_id, p.line_no) <> u.first OR p.line IN (SELECT line FROM late)),
drops AS (SELECT doc_id, text, count(*) AS n, string_agg(line_no::VARCHAR, ',' ORDER BY line_no) AS l FROM gone GROUP BY 1, 2)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::INT AS n_lines, coalesce(r.n, 0)::INT AS n_dropped, coalesce(r.l, '') AS dropped_lines
FROM documents d LEFT JOIN drops r ON d.doc_id = r.doc_id AND d.text = r.text
"""
