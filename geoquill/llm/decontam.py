"""Benchmark decontamination by greedy string tiling.

Documents and test items become words (lower case, letters and digits only). Shared runs of SEED words, or of all words of a shorter item, found by a
rolling Karp-Rabin hash, are the seeds that join a document with items. For each such pair the longest run common to both
is marked again and again, never overlapping a marked one, down to SEED words; the share of the item's words
that is marked is its coverage. Passages in another order are several tiles and count in full. A document is contaminated when
some item's coverage reaches `least`.

Scale: one pass over the documents for each block of items. Items are taken in blocks of BLOCK_BYTES of text
by hash, so what the driver or a task holds is bounded, and a larger benchmark means more passes. One block needs no shuffle; with more, each pass writes
the texts' hashes and tilings where there are any, and their best ones are joined with the documents by the hash.

Defined cases: null or empty texts are clean; items of fewer than SEED words are matched as a whole, but those of one or two (LEAST_WORDS) stand in any text and are never matched; among
items of equal coverage the one with the smallest id is named; null item ids come last; of matches of one length the first in the item, then in the document, is marked; repeated rows are judged
alike; texts of any length are read whole; an empty benchmark leaves every document clean, an empty table gives an empty result; extra columns are carried, but one named as
the result (`name`) is overwritten.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoquill.llm.common import prepare, read, settled, text_of, unused, write_table

SEED, LEAST_WORDS = 6, 3
LEAST = 0.5
BLOCK_BYTES = 8 << 20
#: Pairs of equal seeds that are held at once.
PAIRS = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


class _Ids(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def runs(ids: np.ndarray, k: int) -> np.ndarray:
    """Rolling hash of every run of k ids."""
    if len(ids) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(ids) - k + 1, np.uint64)
    for j in range(k):
        out = out * _MIX + ids[j : len(ids) - k + 1 + j]
    return out ^ (out >> np.uint64(29))


def diagonals(item: np.ndarray, at: np.ndarray, place: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Seeds (item, place in it, place in the text; count: how many follow each other) that go on where another one ends, joined to one. A word that is repeated thousands of times costs a run a diagonal."""
    order = np.lexsort((at, place - at, item))
    item, at, place, count = item[order], at[order], place[order], count[order]
    new = np.ones(len(item), bool)
    new[1:] = (item[1:] != item[:-1]) | (place[1:] - at[1:] != place[:-1] - at[:-1]) | (at[1:] != at[:-1] + count[:-1])
    first = np.flatnonzero(new)
    return item[first], at[first], place[first], np.add.reduceat(count, first) if len(first) else count


def tile(size: int, spans: list[tuple[int, int, int]], least: int = SEED) -> tuple[int, int]:
    """Marked words of an item of `size` words, and number of tiles. spans: (words, place in the item, place in the text) of the longest equal runs, each of `least` words or more."""
    spans = [(-n, i, j) for n, i, j in spans]
    heapq.heapify(spans)
    in_item, in_doc, tiles, left = np.zeros(size, bool), set(), 0, size
    while spans and left >= least:
        n, i, j = heapq.heappop(spans)
        free = [not in_item[i + k] and j + k not in in_doc for k in range(-n)]
        if all(free):
            in_item[i : i - n] = True
            in_doc.update(range(j, j - n))
            tiles += 1
            left += n
            continue
        k = 0  # what a longer tile has left of this match may still be tiles
        while k < -n:
            if not free[k]:
                k += 1
                continue
            end = k
            while end < -n and free[end]:
                end += 1
            if end - k >= least:
                heapq.heappush(spans, (k - end, i + k, j + k))
            k = end
    return int(in_item.sum()), tiles


class Seeds:
    """Runs of `size` words of items by hash: item numbers and places."""

    def __init__(self, items: list[np.ndarray], numbers: list[int], size: int) -> None:
        self.size = size
        hashes = [runs(items[k], size) for k in numbers]
        keys = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        of = np.repeat(np.array(numbers, int), [len(h) for h in hashes])
        at = np.concatenate([*(np.arange(len(h)) for h in hashes), np.zeros(0, int)]).astype(int)
        order = np.argsort(keys, kind="stable")
        self.keys, self.of, self.at = keys[order], of[order], at[order]
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.keys >> np.uint64(44)).astype(int)] = True

    def found(self, every: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """document, and its runs of seeds: items, places in them and in the document, and seeds of the run. At most about PAIRS pairs of equal seeds are held at once."""
        if len(every) < self.size:
            return
        h = runs(every, self.size)
        hit = np.flatnonzero(self.sieve[(h >> np.uint64(44)).astype(int)])
        lo, hi = np.searchsorted(self.keys, h[hit], "left"), np.searchsorted(self.keys, h[hit], "right")
        doc = np.searchsorted(ends, hit, "right")
        whole = (hi > lo) & (hit + self.size <= ends[np.minimum(doc, len(ends) - 1)])
        hit, lo, hi, doc = hit[whole], lo[whole], hi[whole], doc[whole]
        edges = np.flatnonzero(np.diff(doc)) + 1
        for part in np.split(np.arange(len(hit)), edges) if len(hit) else ():
            d, joined = int(doc[part[0]]), []
            before = int(ends[d - 1]) if d else 0
            chunk = (np.cumsum(hi[part] - lo[part]) - 1) // PAIRS
            for some in np.split(part, np.flatnonzero(np.diff(chunk)) + 1):
                n = hi[some] - lo[some]
                seed = np.repeat(lo[some] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                joined.append(diagonals(self.of[seed], self.at[seed], np.repeat(hit[some] - before, n), np.ones(len(seed), int)))
            yield d, *(diagonals(*map(np.concatenate, zip(*joined, strict=True))) if len(joined) > 1 else joined[0])


class Tiler:
    """Items of one block with their seeds; the best item of each text."""

    def __init__(self, items: list[tuple[int | None, str]]) -> None:
        self.names = [i for i, _ in items]
        ids = _Ids()
        self.items = [np.fromiter(map(ids.__getitem__, text.split()), np.uint64) for _, text in items]
        by: dict[int, list[int]] = {}
        for k, x in enumerate(self.items):
            if len(x) >= LEAST_WORDS:
                by.setdefault(min(SEED, len(x)), []).append(k)
        self.seeds = [Seeds(self.items, numbers, size) for size, numbers in sorted(by.items())]

    def order(self, k: int, marked: int) -> tuple[float, bool, int]:
        return -marked / len(self.items[k]), self.names[k] is None, self.names[k] or 0

    def best(self, texts: list[str]) -> list[tuple[int, int, int, int]]:
        """For each text: index of the best item (-1: none), words marked, words of the item, tiles."""
        ids, words = _Ids(), [t.split() for t in texts]
        every = np.fromiter((ids[w] for ws in words for w in ws), np.uint64)
        lengths = np.array([len(ws) for ws in words], int)
        out = [(-1, 0, 0, 0)] * len(texts)
        ends = np.cumsum(lengths)
        for seeds in self.seeds:
            for d, item, at, place, count in seeds.found(every, ends):
                for part in np.split(np.arange(len(item)), np.flatnonzero(np.diff(item)) + 1):
                    k = int(item[part[0]])
                    least = min(SEED, len(self.items[k]))
                    spans = list(zip((count[part] + (least - 1)).tolist(), at[part].tolist(), place[part].tolist(), strict=True))
                    marked, tiles = tile(len(self.items[k]), spans, least)
                    if out[d][0] < 0 or self.order(k, marked) < self.order(*out[d][:2]):
                        out[d] = k, marked, len(self.items[k]), tiles
        return out


def blocks(benchmark: DataFrame, bound: int = BLOCK_BYTES) -> list[DataFrame]:
    """Distinct items in blocks by hash; a block holds about half of `bound` bytes."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words_text(text_of()).alias("words")).distinct()
    n = 1 + (items.agg(F.sum(F.octet_length("words"))).first()[0] or 0) * 2 // bound
    return [items.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(n)) == k) for k in range(n)]


def _tiler(block: DataFrame) -> Tiler:
    return Tiler(sorted(((r["item_id"], r["words"]) for r in block.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1])))


def _matcher(tiler: Tiler):
    @F.pandas_udf("item_id long, coverage double, tiles int")
    def best(texts: pd.Series) -> pd.DataFrame:
        rows = [(tiler.names[i], marked / size, tiles) if i >= 0 else (None, None, None) for i, marked, size, tiles in tiler.best(texts.tolist())]
        return pd.DataFrame(rows, columns=["item_id", "coverage", "tiles"]).astype({"item_id": "Int64", "coverage": "float64", "tiles": "Int32"})

    return best


def tiled(docs: DataFrame, benchmark: DataFrame, bound: int = BLOCK_BYTES, name: str = "tiling") -> DataFrame:
    """docs with the column `name`: struct of item_id, coverage, tiles of the best item; null where no item shares a seed."""
    every, text = blocks(benchmark, bound), words_text(text_of())
    (words,) = unused(docs, "words_")
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    if len(every) > 1:
        best = settled(docs.sparkSession, lambda: _best(docs.select(text.alias("words_")), every), "tilings")
        best = best.select(F.col("words_").alias(words), F.col("tiling").alias(name))
        return docs.select(*kept, F.sha2(text, 256).alias(words)).join(best, words, "left").select(*kept, name)
    out = docs.select(*kept, text.alias(words)).withColumn(name, _matcher(_tiler(every[0]))(words))
    return out.withColumn(name, F.when(F.col(f"{name}.coverage").isNotNull(), F.col(name))).drop(words)


def _best(texts: DataFrame, every: list[DataFrame]) -> DataFrame:
    """words_ (a hash of the words), tiling: the best item of all blocks, one written pass for each block."""
    found = None
    for block in every:
        hits = texts.withColumn("tiling", _matcher(_tiler(block))("words_")).where("tiling.coverage is not null").select(F.sha2("words_", 256).alias("words_"), "tiling")
        hits = write_table(hits, "block")
        found = hits if found is None else found.union(hits)
    order = F.struct((-F.col("tiling.coverage")).alias("neg_coverage"), F.col("tiling.item_id").isNull().alias("id_is_null"), F.col("tiling.item_id").alias("item_id"), F.col("tiling"))
    return found.groupBy("words_").agg(F.min(order).alias("best")).select("words_", F.col("best.tiling").alias("tiling"))


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return tiled(docs, read(spark, sf_dir, "benchmark")).select(
        "doc_id", (F.coalesce(F.col("tiling.coverage"), F.lit(0.0)) >= LEAST).alias("contaminated"), "tiling.item_id", "tiling.coverage", "tiling.tiles"
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, with all their columns. Nulls, repeats, empty tables: as for the module."""
    prepare(spark)
    (name,) = unused(docs, "tiling")
    return tiled(docs, read(spark, sf_dir, "benchmark"), name=name).where(F.coalesce(F.col(f"{name}.coverage"), F.lit(0.0)) < LEAST).select(*docs.columns)
