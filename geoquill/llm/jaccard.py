"""N-gram Jaccard join by a token-group matrix: exact links between documents' sets of 5-word shingles at a similarity of 0.8.

1. Each text becomes a set of 64-bit shingle hashes; documents with equal sets (by 128 bits) are one set from here on.
2. A linked set shares most of its shingles, so it also shares many of its lowest: of the n - ceil(0.8 n) + n / 10 lowest hashes of each of two linked
   sets, 0.08 n at least stand in both. Sets with fewer shingles that another set holds too can't be linked and are left here; of the others all
   shingles are read, and those remain of which others share 0.8 n or more. What no other set holds is dropped: it can't be in an intersection.
3. The shared shingles of a set are ordered by the number of sets that hold them, rare ones first. At its shingle of place i, a set of m
   shared ones can meet another for the first time only if the smaller m - i of the two suffices for 0.8 ("left"). So a set stands in the
   matrix at its first shingles alone, where m - i >= 0.8 n.
4. First every set is compared with the head of each of its cells, the set that leaves most of itself there: the middle of a family of near copies. Linked sets
   are groups. The matrix then has a row for each shingle and group, with the most that a member may share and the least size there.
   A set whose rows pass these bounds for another group is a query for that group, if their sketches (a bit a shingle, modulo 8192) leave enough in common: a bit that
   only the set has is a shingle that only it has. The query is held against the union of all shingles of the group, and only where that overlap suffices is the group opened and its members compared one by one.

Scale: texts are read once, and again for those sets that step 2 keeps of the lowest hashes, shuffled where these are more than BROADCAST. Hashes are shuffled as packed arrays by bucket, whose
number follows the number of hashes, and copies within a partition are one set before that; what a bucket counts goes on packed, too. A family of near copies costs about its size: members
meet their head, and not each other unless the bounds let them link across groups. Nothing is collected, and nothing broadcast but that list and the sieve of
`sieved`, which have fixed bounds; a bucket holds the sets of a shingle, so one that very many different sets hold makes its bucket larger; the joins are plain shuffles that AQE splits where one shingle or group is hot.

Defined cases: A-Z are lower-cased, words are split at 0x20 and 0x09 to 0x0D; with 1 to 4 words the whole sequence is the one
shingle; without words or text the set is empty and links with nothing; a null id takes part and is a component's name only where no member has an id; repeated
rows are equal sets; texts of any length are read whole; ties between heads go to the larger set number; an empty table gives an empty result; extra
columns aren't read, and the stage carries them under any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoquill.llm.common import prepare, read, settled, sieved, text_of, unused, write_table

WORDS = 5
LEAST = 80  # per cent
ENTRIES = 500_000  # hashes a bucket holds, about
CHUNK = 500_000  # hashes a task deals at once
COUNTS = 4_000_000  # counts of keys that a task sums, at most about
#: Rows of four numbers that are broadcast at most, to read the texts of chosen sets where they lie; beyond that the texts are shuffled to them.
BROADCAST = 500_000
LOW_BYTES = 6  # of the lowest hashes, which only choose candidates
#: 64-bit words of a sketch.
SKETCH = 128
_STEP = [np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) & 0xFFFFFFFFFFFFFFFF) for k in range(WORDS)]


class _Ids(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str, ids: _Ids) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(ids.__getitem__, words), np.uint64, len(words))
    out = np.zeros(len(h) - WORDS + 1, np.uint64)
    for k in range(WORDS):
        part = h[k : len(h) - WORDS + 1 + k] * _STEP[k]
        out += part ^ (part >> np.uint64(31))
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0x94D049BB133111EB)
    return np.unique(out)


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed 64-bit numbers."""
    h = xxhash.xxh3_128_intdigest(s.tobytes())
    return tuple(x - (1 << 64) if x >> 63 else x for x in (h >> 64, h & 0xFFFFFFFFFFFFFFFF))


def packed(x: np.ndarray, size: int = 8) -> bytes:
    """The low `size` bytes of 64-bit numbers, byte by byte: what is alike in all of them takes little room once compressed."""
    return x.view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def unpacked(parts: Iterable[bytes], size: int = 8) -> np.ndarray:
    """The numbers of all parts; those packed in less than 8 bytes aren't negative."""
    parts = list(parts)
    out = np.zeros((sum(map(len, parts)) // size, 8), np.uint8)
    at = 0
    for p in parts:
        n = len(p) // size
        out[at : at + n, :size] = np.frombuffer(p, np.uint8).reshape(size, n).T
        at += n
    return out.view(np.int64).ravel()


def runs(x: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal numbers (and equal ones of the other arrays) begin, and how long they are."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = x[1:] != x[:-1]
    for y in more:
        new |= y[1:] != y[:-1]
    begin = np.concatenate([[0], np.flatnonzero(new) + 1])
    return begin, np.diff(begin, append=len(x))


def needed(n: int) -> int:
    """The least overlap of a set of n shingles with any that it links with."""
    return -(-LEAST * n // 100)


def spare(n: int) -> int:
    return max(1, n // 10)


def low_size(n: int) -> int:
    """How many of its lowest hashes a set shows first: two linked sets share spare(needed(n)) of these at least."""
    return n - needed(n) + spare(n)


def _row(docs: DataFrame) -> list:
    """A row's two hashes of id and text."""
    return [F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64(F.lit(1), "doc_id", "text").alias("r2")]


def sets(docs: DataFrame) -> DataFrame:
    """doc_id, r1, r2 (the row's hash), n, k1, k2 (the set's hash) and low (its lowest hashes, packed) of every row."""

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = _Ids()
        for frame in frames:
            n, keys, low = [], [], []
            for text in frame["text"]:
                s = shingles(text, ids)
                n.append(len(s))
                keys.append(set_key(s))
                low.append(packed(s[: low_size(len(s))] >> np.uint64(64 - 8 * LOW_BYTES), LOW_BYTES) if len(s) else b"")
            k = np.array(keys, np.int64).reshape(-1, 2)
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "r1": frame["r1"], "r2": frame["r2"], "n": n, "k1": k[:, 0], "k2": k[:, 1], "low": low})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), *_row(docs))
    return rows.mapInPandas(make, "doc_id long, r1 long, r2 long, n long, k1 long, k2 long, low binary")


def _dealt(keys: np.ndarray, tokens: list[np.ndarray], buckets: int, key_size: int, token_size: int) -> pd.DataFrame:
    """bucket, token, key: the tokens of all keys by bucket, packed."""
    key = np.repeat(keys, [len(t) for t in tokens])
    token = np.concatenate([*tokens, np.zeros(0, np.uint64)])
    of = token % np.uint64(buckets)
    order = np.argsort(of, kind="stable")
    of, token, key = of[order], token[order], key[order]
    begin, size = runs(of)
    first, times = runs(of, key)  # a set's tokens in a bucket stand together, so its key is sent once
    at = np.searchsorted(first, np.append(begin, len(of)))
    return pd.DataFrame({
        "bucket": of[begin].astype(np.int64), "token": [packed(token[a : a + n], token_size) for a, n in zip(begin, size, strict=True)],
        "key": [packed(key[first[a:b]], key_size) for a, b in zip(at, at[1:], strict=False)], "times": [packed(times[a:b], 4) for a, b in zip(at, at[1:], strict=False)],
    })


def _deal(frames: Iterator[pd.DataFrame], tokens_of: Callable, buckets: int, key_size: int = 8, token_size: int = 8) -> Iterator[pd.DataFrame]:
    """Packed arrays by bucket of each frame's sets, CHUNK tokens at once; a key that the partition has dealt isn't dealt again."""
    seen: set[tuple[int, int]] = set()
    for frame in frames:
        keys, tokens, n = [], [], 0
        for row in frame.itertuples(index=False):
            if (row.key, row.k2) in seen:
                continue
            t = tokens_of(row)
            if t is None:
                continue
            if len(seen) < 1_000_000:
                seen.add((row.key, row.k2))
            keys.append(row.key)
            tokens.append(t)
            n += len(t)
            if n >= CHUNK:
                yield _dealt(np.array(keys, np.int64), tokens, buckets, key_size, token_size)
                keys, tokens, n = [], [], 0
        if keys:
            yield _dealt(np.array(keys, np.int64), tokens, buckets, key_size, token_size)


def _shared(frame: pd.DataFrame, key_size: int = 8, token_size: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """token, key and number of keys of the token, for the tokens of a bucket that several keys have."""
    token = unpacked(frame["token"], token_size)
    key = np.repeat(unpacked(frame["key"], key_size), unpacked(frame["times"], 4))
    order = np.lexsort((key, token))
    token, key = token[order], key[order]
    del order
    alone, _ = runs(token, key)
    token, key = token[alone], key[alone]
    _, times = runs(token)
    times = np.repeat(times, times)
    many = times > 1
    return token[many], key[many], times[many]


def _counts(dealt: DataFrame, size: int, parts: int) -> DataFrame:
    """part, key, times, packed: of every key in a bucket, how many of its tokens other keys have there. A row for a bucket and part, as there may be as many (bucket, key) as there are tokens."""

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        key, times = np.unique(_shared(frame, size, LOW_BYTES)[1], return_counts=True)
        of = key % parts
        order = np.argsort(of, kind="stable")
        of, key, times = of[order], key[order], times[order].astype(np.int64)
        begin, n = runs(of)
        cut = [slice(a, a + k) for a, k in zip(begin, n, strict=True)]
        return pd.DataFrame({"part": of[begin], "key": [packed(key[c], size) for c in cut], "times": [packed(times[c], 4) for c in cut]})

    return dealt.groupBy("bucket").applyInPandas(count, "part long, key binary, times binary")


def _totals(counts: DataFrame, size: int) -> DataFrame:
    """key, held: _counts summed over the buckets, a row a key."""

    def total(frame: pd.DataFrame) -> pd.DataFrame:
        key, times = unpacked(frame["key"], size), unpacked(frame["times"], 4)
        order = np.argsort(key, kind="stable")
        begin, _ = runs(key[order])
        return pd.DataFrame({"key": key[order][begin], "held": np.add.reduceat(times[order], begin)})

    return counts.groupBy("part").applyInPandas(total, "key long, held long")


def candidates(table: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of keys whose sets share enough of their lowest hashes."""
    seen = table.agg(F.coalesce(F.sum(F.length("low") / LOW_BYTES), F.lit(0)).alias("low"), F.count(F.lit(1)).alias("rows")).first()
    buckets = 1 + int(seen["low"]) // ENTRIES
    # A set goes by as many bytes of its hash as nearly all sets need to differ.
    size = min(7, max(4, (2 * int(seen["rows"]).bit_length() + 11) // 8))
    short = F.col("k1").bitwiseAND(F.lit((1 << 8 * size) - 1)).alias("key")

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _deal(frames, lambda r: unpacked([r.low], LOW_BYTES).view(np.uint64), buckets, size, LOW_BYTES)

    dealt = table.where("n > 0").select(short, "k2", "low").mapInPandas(deal, "bucket long, token binary, key binary, times binary")
    held = _totals(_counts(dealt, size, 1 + int(seen["low"]) // COUNTS), size)
    # Sets that agree in these bytes count as one above, so they stay whatever they share.
    keyed = keys.withColumn("key", short)
    same = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("key", F.lit(True).alias("same"))
    least = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * LEAST / 100) / 10))
    return keyed.join(held, "key", "left").join(same, "key", "left").where((F.col("held") >= least) | F.col("same")).select(*keys.columns)


def members(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """sid, n, m, tokens (packed, rare ones first): the shared shingles of those chosen sets that share 0.8 n or more."""
    seen = chosen.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("rows")).first()
    buckets = 1 + int(seen["n"]) // ENTRIES

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = _Ids()

        def tokens_of(row):
            s = shingles(row.text, ids)
            return s if set_key(s) == (row.k1, row.k2) else None

        return _deal(frames, tokens_of, buckets)

    def share(frame: pd.DataFrame) -> pd.DataFrame:
        token, key, times = _shared(frame)
        of = key % buckets
        order = np.lexsort((key, of))
        cut = np.searchsorted(of[order], np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(cut))
        few = np.minimum(times, 0xFFFF)  # only an order, the same for all
        rows = []
        for k in full:
            at = order[cut[k] : cut[k + 1]]
            first, n = runs(key[at])
            rows.append((k, packed(key[at][first]), packed(n, 4), packed(token[at]), packed(few[at], 2)))
        return pd.DataFrame(rows, columns=["part", "key", "n", "token", "times"])

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        token, times = unpacked(frame["token"]).view(np.uint64), unpacked(frame["times"], 2)
        key = np.repeat(unpacked(frame["key"]), unpacked(frame["n"], 4))
        order = np.lexsort((token, times, key))
        key, token = key[order], token[order]
        begin, size = runs(key)
        return pd.DataFrame({"sid": key[begin], "m": size, "tokens": [token[a : a + n].tobytes() for a, n in zip(begin, size, strict=True)]})

    texts, wanted = docs.select(text_of().alias("text"), _row(docs)[0]), chosen.select("r1", F.col("sid").alias("key"), "k1", "k2")
    rows = texts.join(F.broadcast(wanted), "r1") if seen["rows"] <= BROADCAST else sieved(texts, "r1", chosen).join(wanted, "r1")
    rows = rows.select("key", "k1", "k2", "text")
    dealt = rows.mapInPandas(deal, "bucket long, token binary, key binary, times binary")
    parts = dealt.groupBy("bucket").applyInPandas(share, "part long, key binary, n binary, token binary, times binary")
    gathered = parts.groupBy("part").applyInPandas(gather, "sid long, m long, tokens binary")
    return gathered.join(chosen.select("sid", "n"), "sid").where(F.col("m") * 100 >= F.col("n") * LEAST).select("sid", "n", "m", "tokens")


def matrix_rows(table: DataFrame, group: str = "sid") -> DataFrame:
    """token, sid, n, reach, and comp (the column `group`): where a set can first meet another. table: members().

    reach is what the row leaves for the other set: its size may be a LEASTth of this at most, and the other's row must leave as much for its own.
    """

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 2000):
                some = frame.iloc[at : at + 2000]
                tokens = [np.frombuffer(t, np.int64) for t in some["tokens"]]
                n, m = some["n"].to_numpy(), some["m"].to_numpy()
                first = m - -(-LEAST * n // 100) + 1
                place = np.concatenate([*(np.arange(k) for k in first), np.zeros(0, np.int64)]).astype(np.int64)
                again = lambda x, first=first: np.repeat(x, first)
                token = np.concatenate([*(t[:k] for t, k in zip(tokens, first, strict=True)), np.zeros(0, np.int64)])
                reach = (again(m) - place) * (100 + LEAST) - again(n) * LEAST
                yield pd.DataFrame({"token": token, "sid": again(some["sid"].to_numpy()), "n": again(n), "reach": reach, "comp": again(some["comp"].to_numpy())})

    return table.select("sid", "n", "m", "tokens", F.col(group).alias("comp")).mapInPandas(cut, "token long, sid long, n long, reach long, comp long")


def each_token(table: DataFrame, name: str) -> DataFrame:
    """name, token: every shared shingle of members; name: the column that goes with it."""

    def explode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 2000):
                some = frame.iloc[at : at + 2000]
                tokens = [np.frombuffer(t, np.int64) for t in some["tokens"]]
                yield pd.DataFrame({name: np.repeat(some[name].to_numpy(), [len(t) for t in tokens]), "token": np.concatenate(tokens)})

    return table.select(name, "tokens").mapInPandas(explode, f"{name} long, token long")


def verified(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """The pairs (a, b) of sids whose sets are similar; shared shingles and sizes tell."""

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ok = []
            for n, x, y in zip(frame["both"], frame["tokens_a"], frame["tokens_b"], strict=True):
                same = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                ok.append((100 + LEAST) * same >= LEAST * n)
            yield frame.loc[ok, ["a", "b"]]

    needed_sets = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    table = table.join(needed_sets, "sid", "left_semi")
    side = lambda x: table.select(F.col("sid").alias(x), F.col("n").alias(f"n_{x}"), F.col("tokens").alias(f"tokens_{x}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", (F.col("n_a") + F.col("n_b")).alias("both"), "tokens_a", "tokens_b").mapInPandas(check, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """key, comp: the smallest key that links lead to, for keys with links. Labels spread to neighbours and then jump to their label's label."""
    both = write_table(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = write_table(both.groupBy(F.col("a").alias("key")).agg(F.least(F.col("a"), F.min("b")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("key").alias("b"), F.col("comp").alias("c")), "b").groupBy(F.col("a").alias("key")).agg(F.min("c").alias("c"))
        spread = labels.join(near, "key").select("key", F.least("comp", "c").alias("new"), F.col("comp").alias("old"))
        jump = labels.select(F.col("key").alias("new"), F.col("comp").alias("far"))
        stepped = write_table(spread.join(jump, "new", "left").select("key", F.least("new", F.coalesce("far", "new")).alias("comp"), "old"), "labels")
        labels = stepped.select("key", "comp")
        if stepped.where("comp <> old").isEmpty():
            return labels


def links(table: DataFrame) -> DataFrame:
    """key (sid), comp for sets with links. table: the written result of members()."""
    rows = write_table(matrix_rows(table).drop("comp"), "matrix_rows")
    head = rows.groupBy("token").agg(F.max(F.struct(F.col("reach") / F.col("n"), "sid", "n", "reach")).alias("head"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    met = rows.join(head, "token").where((F.col("sid") != F.col("head.sid")) & (F.col("reach") >= LEAST * F.col("head.n")) & (F.col("head.reach") >= LEAST * F.col("n")))
    first = write_table(met.select(F.least("sid", "head.sid").alias("a"), F.greatest("sid", "head.sid").alias("b")).distinct(), "pairs")
    linked = write_table(verified(first, table), "linked_first")
    groups = components(linked)

    named = groups.select(F.col("key").alias("sid"), "comp")
    grouped = matrix_rows(table.join(named, "sid", "left").withColumn("group", F.coalesce("comp", "sid")).drop("comp"), "group")
    mixed = grouped.groupBy("token").agg(F.min("comp").alias("one"), F.max("comp").alias("other")).where("one <> other").select("token")
    open_rows = write_table(_open_rows(write_table(grouped.join(mixed, "token"), "matrix_mixed")), "matrix_open")
    cells = _cells(open_rows)
    meets = open_rows.join(cells.withColumnRenamed("comp", "other"), "token").where((F.col("comp") != F.col("other")) & (F.col("reach") >= LEAST * F.col("cell_n")) & (F.col("cell_reach") >= LEAST * F.col("n")))
    met = write_table(meets.groupBy("sid", "n", F.col("other").alias("comp")).agg(F.min("cell_n").alias("cell_n")), "met")
    inside = table.join(named, "sid", "left").select("tokens", F.coalesce("comp", "sid").alias("comp")).join(met.select("comp").distinct(), "comp", "left_semi")
    unions = write_table(each_token(inside, "comp").distinct(), "unions")
    queries = write_table(_queries(met, unions, table), "queries")
    if queries.isEmpty():
        return groups
    qualified = write_table(_qualified(queries, unions, table), "qualified")
    asking = open_rows.select("token", F.col("sid").alias("q"), F.col("n").alias("qn"), F.col("reach").alias("q_reach"))
    opened = qualified.withColumnRenamed("sid", "q").join(asking, "q").join(open_rows, ["token", "comp"])
    pairs = opened.where((F.col("q_reach") >= LEAST * F.col("n")) & (F.col("reach") >= LEAST * F.col("qn"))).select(F.least("q", "sid").alias("a"), F.greatest("q", "sid").alias("b"))
    rest = write_table(pairs.distinct().join(first, ["a", "b"], "left_anti"), "pairs_rest")
    more = write_table(verified(rest, table), "linked_rest")
    return groups if more.isEmpty() else components(linked.union(more))


def _cells(rows: DataFrame) -> DataFrame:
    """The token-group matrix: for each shingle and group, the most that a member's row leaves and the least size of those members."""
    return rows.groupBy("token", "comp").agg(F.max("reach").alias("cell_reach"), F.min("n").alias("cell_n"))


def _open_rows(grouped: DataFrame) -> DataFrame:
    """The rows that pass the bounds of some other group at their shingle."""
    cells = _cells(grouped)
    best = cells.groupBy("token").agg(F.max(F.struct("cell_reach", "comp")).alias("far"), F.min(F.struct("cell_n", "comp")).alias("low"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
    away = lambda x, y: F.when(F.col("comp") != F.col(f"{x}.comp"), F.col(y))
    second = cells.join(best, "token").groupBy("token").agg(
        F.first("far").alias("far"), F.first("low").alias("low"), F.max(away("far", "cell_reach")).alias("far_2"), F.min(away("low", "cell_n")).alias("low_2")
    )
    reach = F.when(F.col("comp") == F.col("far.comp"), F.col("far_2")).otherwise(F.col("far.cell_reach"))
    least = F.when(F.col("comp") == F.col("low.comp"), F.col("low_2")).otherwise(F.col("low.cell_n"))
    return grouped.join(second, "token").where((reach >= LEAST * F.col("n")) & (F.col("reach") >= LEAST * least)).select("token", "sid", "n", "reach", "comp")


def _sketches(rows: DataFrame, name: str) -> DataFrame:
    """name, m (its rows) and words (word, bits), from rows of name and token: a bit for each token, modulo 64 * SKETCH, in the words that have one. Of a bounded size, however many tokens there are."""
    word, bit = F.pmod(F.shiftright("token", 6), F.lit(SKETCH)).cast("int"), F.expr("bit_or(shiftleft(1L, CAST(token & 63 AS INT)))")
    words = rows.groupBy(name, word.alias("word")).agg(bit.alias("bits"), F.count(F.lit(1)).alias("m"))
    return words.groupBy(name).agg(F.sum("m").alias("m"), F.collect_list(F.struct("word", "bits")).alias("words"))


def _queries(met: DataFrame, unions: DataFrame, table: DataFrame) -> DataFrame:
    """Those of met (sid, n, comp, cell_n) whose sketches don't rule out that enough of the set is in the group's union. A set has one shingle at least for each bit that the union lacks."""
    asking = _sketches(each_token(table.join(met.select("sid").distinct(), "sid", "left_semi"), "sid"), "sid")
    groups = _sketches(unions, "comp").select("comp", F.map_from_entries("words").alias("bits"))
    groups = groups.select("comp", F.transform(F.sequence(F.lit(0), F.lit(SKETCH - 1)), lambda k: F.coalesce(F.try_element_at("bits", k), F.lit(0).cast("long"))).alias("bits"))
    lacks = F.aggregate("words", F.lit(0), lambda n, w: n + F.bit_count(w["bits"].bitwiseAND(F.bitwise_not(F.get("bits", w["word"])))))
    return met.join(asking, "sid").join(groups, "comp").where((F.col("m") - lacks) * (100 + LEAST) >= (F.col("n") + F.col("cell_n")) * LEAST).select(*met.columns)


def _qualified(queries: DataFrame, unions: DataFrame, table: DataFrame) -> DataFrame:
    """sid, comp: queries that share enough with the union of all shingles of the group."""
    asking = each_token(table.join(queries.select("sid").distinct(), "sid", "left_semi"), "sid").join(queries, "sid")
    held = asking.join(unions, ["comp", "token"]).groupBy("sid", "comp", "n", "cell_n").agg(F.count(F.lit(1)).alias("held"))
    return held.where(F.col("held") * (100 + LEAST) >= (F.col("n") + F.col("cell_n")) * LEAST).select("sid", "comp")


def with_components(docs: DataFrame) -> DataFrame:
    """doc_id, r1, r2 (the row's hash), n_shingles, component_id, and group (a component's number, null for empty sets) of every row of docs."""
    return settled(docs.sparkSession, lambda: _with_components(docs), "components")


def _with_components(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    table = write_table(sets(docs), "sets")
    keys = table.where("n > 0").groupBy("k1", "k2").agg(F.min("n").alias("n"), F.min("r1").alias("r1"), F.min("doc_id").alias("least_id"))
    keys = write_table(keys.withColumn("sid", F.monotonically_increasing_id()), "set_keys")
    chosen = write_table(candidates(table, keys), "candidates")
    groups = links(write_table(members(docs, chosen), "members"))
    placed = keys.join(groups, F.col("sid") == F.col("key"), "left").select("k1", "k2", "least_id", F.coalesce("comp", "sid").alias("group"))
    names = placed.groupBy("group").agg(F.min("least_id").alias("name"))
    placed = placed.join(names, "group").select("k1", "k2", "group", "name")
    out = table.where("n > 0").select("doc_id", "r1", "r2", "n", "k1", "k2").join(placed, ["k1", "k2"])
    out = out.select("doc_id", "r1", "r2", F.col("n").alias("n_shingles"), F.coalesce("name", "doc_id").alias("component_id"), "group")
    alone = table.where("n = 0").select("doc_id", "r1", "r2", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("group"))
    return out.union(alone)


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = read(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    return with_components(docs).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, with all its columns: the one with the smallest id, then the smallest hash of id and text; of rows alike in both, any. Rows without words stay."""
    r1, r2, drop, times = unused(docs, "r1", "r2", "drop", "times")
    each = with_components(docs).where("group is not null")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "r1", "r2")
    first = each.groupBy("group").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    judged = each.join(first, "group").select("r1", "r2", ((F.col("r1") != F.col("first.r1")) | (F.col("r2") != F.col("first.r2"))).alias("drop"))
    judged = judged.groupBy(F.col("r1").alias(r1), F.col("r2").alias(r2)).agg(F.max("drop").alias(drop), F.count(F.lit(1)).alias(times))
    # Of rows that are neither dropped nor single, one stays; all others are unique or have no words.
    judged = write_table(judged.where(F.col(drop) | (F.col(times) > 1)), "judged")
    a, b = _row(docs)
    kept = docs.withColumns({r1: a, r2: b}).join(judged, [r1, r2], "left")
    single = kept.where(F.col(drop).isNull())
    repeated = kept.where(~F.col(drop)).dropDuplicates([r1, r2])
    return single.union(repeated).select(*docs.columns)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, see keep_one: nulls, repeats, empty tables and extra columns as there."""
    prepare(spark)
    return keep_one(docs)


OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS d, doc_id AS r FROM sets UNION SELECT reach.d, links.b FROM reach JOIN links ON reach.r = links.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r)::BIGINT AS component_id FROM sets s JOIN reach ON s.doc_id = d GROUP BY 1, 2
"""
