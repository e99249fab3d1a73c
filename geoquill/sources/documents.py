"""Items of JSON documents of any size: a document is read by as many tasks as it has splits.

Spark's text source cuts a file at closing braces and byte ranges, so a task gets pieces of text that start after a brace, perhaps inside a string or deep in an item. A first pass tells of each split how it changes the depth of
brackets and whether quotes are open, for both things that its start can be; these few numbers, a row a split, are put together in order and give the state at each split's start. The second pass, which knows it, cuts the items out;
an item that runs over a split's end is put together from its parts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN = re.compile(r"\\.|[\"{}\[\]]", re.S)


def _opens(key: str) -> re.Pattern:
    return re.compile(rf'"{re.escape(key)}"\s*:\s*\Z')


def _pieces(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple[str, int], str]]:
    """((file, start of the split), text) in order; a split may come in several texts. Cut-off braces are put back."""
    for frame in frames:
        splits = frame["path"] + "\0" + frame["block"].astype(str)
        for _, part in frame.groupby((splits != splits.shift()).cumsum(), sort=False):
            yield (part["path"].iloc[0], int(part["block"].iloc[0])), "}".join(part["value"]) + "}"


class Change:
    """What a split does to the state, if it starts outside (0) or inside (1) a string."""

    def __init__(self, key: str) -> None:
        self.parity, self.delta, self.low, self.opens, self.key = 0, [0, 0], [0, 0], [{}, {}], _opens(key)

    def read(self, text: str) -> None:
        for m in TOKEN.finditer(text):
            c = m[0]
            if c == '"':
                self.parity ^= 1
            elif len(c) == 1:
                h = self.parity  # brackets count if the split started so
                if c in "{[":
                    if c == "[" and self.key.search(text, max(0, m.start() - 200), m.start()):
                        self.opens[h][self.delta[h]] = self.delta[h] + 1
                    self.delta[h] += 1
                else:
                    self.delta[h] -= 1
                    self.low[h] = min(self.low[h], self.delta[h])
                    for at, low in self.opens[h].items():
                        self.opens[h][at] = min(low, self.delta[h])

    def row(self) -> str:
        return json.dumps([self.parity, self.delta, self.low, [list(x.items()) for x in self.opens]])


def _states(changes: list[tuple[str, int, str]]) -> dict[tuple[str, int], tuple[int, int, bool, int]]:
    """(depth, inside a string, inside the array, split in which the item at the start begins) of each split, in order."""
    out, path_now = {}, None
    for path, block, row in sorted(changes):
        if path != path_now:
            path_now, depth, quoted, inside, owner = path, 0, 0, False, block
        out[path, block] = (depth, quoted, inside, owner)
        parity, delta, low, opens = json.loads(row)
        if not (inside and depth >= 3 and depth + low[quoted] > 2):  # unless one item holds the whole split
            owner = block
        inside = inside and depth + low[quoted] >= 2
        for at, least in opens[quoted]:
            if depth + at == 1:
                inside = depth + least >= 2
        depth, quoted = depth + delta[quoted], quoted ^ parity
    return out


class Cutter:
    """Cuts items out of a split's texts. An item is an object of the array."""

    def __init__(self, state: tuple[int, int, bool, int], key: str, block: int) -> None:
        self.depth, self.quoted, self.inside, owner = state
        self.key, self.block, self.n = _opens(key), block, 0
        self.part = owner if self.inside and self.depth >= 3 else None  # where the open item began
        self.open_ = self.part is not None
        self.held: list[str] = []

    def read(self, text: str) -> Iterator[tuple[int, int | None, str]]:
        """(number, split where it began if that is another, text)."""
        start = 0
        for m in TOKEN.finditer(text):
            c = m[0]
            if c == '"':
                self.quoted ^= 1
            elif len(c) == 1 and not self.quoted:
                if c in "{[":
                    if c == "{" and self.inside and self.depth == 2:
                        start, self.open_, self.n = m.start(), True, self.n + 1
                    elif c == "[" and self.depth == 1 and self.key.search(text, max(0, m.start() - 200), m.start()):
                        self.inside = True
                    self.depth += 1
                else:
                    self.depth -= 1
                    if self.open_ and self.depth == 2:
                        yield self.n, self.part, "".join(self.held) + text[start : m.end()]
                        self.open_, self.part = False, None
                        self.held.clear()
                    self.inside = self.inside and self.depth >= 2
        if self.open_:
            self.held.append(text[start:])

    def rest(self) -> Iterator[tuple[int, int | None, str]]:
        if self.open_ and self.held:
            yield self.n, self.block if self.part is None else self.part, "".join(self.held)


def array_items(spark: SparkSession, path: str, key: str) -> DataFrame:
    """path, block, n (the order) and value: each object of the array `key` of the documents' top level, as text.

    Arrays of that name deeper down don't count. A document without the array has no items, nor has an empty one; an item that the file's end cuts off is left out. The driver gets a row a split.
    """
    pieces = spark.read.text(path, lineSep="}").select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))

    def change(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple[str, int], Change] = {}
        for split, text in _pieces(frames):
            found.setdefault(split, Change(key)).read(text)
        yield pd.DataFrame([(*k, c.row()) for k, c in found.items()], columns=["path", "block", "change"])

    states = _states([tuple(r) for r in pieces.mapInPandas(change, "path string, block long, change string").collect()])

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, cutter = None, None
        rows = lambda split, found: pd.DataFrame([(*split, *x) for x in found], columns=["path", "block", "n", "part", "value"]).astype({"part": "Int64"})
        for split, text in _pieces(frames):
            if split != now:
                if cutter:
                    yield rows(now, cutter.rest())
                now, cutter = split, Cutter(states[split], key, split[1])
            yield rows(split, cutter.read(text))
        if cutter:
            yield rows(now, cutter.rest())

    found = pieces.mapInPandas(cut, "path string, block long, n long, part long, value string")
    parts = found.where("part is not null").groupBy("path", "part").agg(F.max(F.when(F.col("block") == F.col("part"), F.col("n"))).alias("n"), F.sort_array(F.collect_list(F.struct("block", "value"))).alias("p"))
    joined = parts.select("path", F.col("part").alias("block"), "n", F.array_join(F.transform("p", lambda x: x["value"]), "").alias("value"))
    return found.where("part is null").select("path", "block", "n", "value").unionByName(joined)
