"""Masked pseudo-likelihood: a bidirectional window network predicts every word from both sides.

Words of the whole corpus are counted. The most frequent are classes of their own and every other word falls into one of the rest
classes by its ending (a hash of its last ENDING characters), which tells much of its language and part of speech; the number of both grows with the cube root of the number of distinct words. The network sees SIDE words on either side of
the masked one (embeddings, one hidden layer, softmax over classes). It is trained in numpy, first on TRAIN_WORDS words in a row, from a place set by
hash, of at most TRAIN_DOCS documents in hash order; from there every partition goes on over every STRIDE-th window of all
its documents, and the partitions' weights are averaged by their windows. A word's conditional log-probability is that of
its class and its share of the class: its count in the corpus over that of the class, smoothed by ALPHA so that unseen words have a share too. A
document's score is the sum over all its words.

Scale: the word count is a pre-aggregated groupBy over all documents and grows with them. The counts of at most LISTED words, the most frequent,
reach the driver and the tasks; the other words of documents are joined with the table of counts. Every document is read once for counts, once for training and once
for scores, without a shuffle of texts.

Defined cases: null and blank texts have no tokens, a log-probability of 0 and no score; null and repeated ids and repeated rows are scored like others; texts of any length are
scored whole; words of equal counts are ordered by code point; an empty table gives an empty result; extra columns are carried, but one named lm is overwritten. The weights
depend on how documents lie in partitions.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoquill.llm.common import hash_sample, prepare, read, settled, text_of, unused, write_table

#: The least numbers of classes.
TOP, REST = 96, 32
#: Words with their counts that tasks hold.
LISTED = 1 << 17
ALPHA = 0.5
ENDING = 2
SIDE = 2
WIDTH, HIDDEN = 12, 16
TRAIN_DOCS, TRAIN_WORDS = 2000, 150
STEPS, BATCH, RATE = 600, 512, 0.01
STRIDE, PASS_RATE = 8, 0.002
ROWS = 8192
#: Documents whose words and windows a task holds at once.
TEXTS = 128
SPACES = r"[\x20\x09-\x0D]+"


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over every word of every document."""
    return docs.select(F.explode(F.split(F.lower(text_of()), SPACES)).alias("word")).where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def rest_class(word: str, rest: int) -> Column:
    return F.crc32(F.substring(word, -ENDING, ENDING)) % rest


class Vocabulary(dict):
    """Listed words, most frequent first, to their places; other words are given the place after the list at their class, and remembered up to a bound.

    The first `top` places are classes of their own. kinds: distinct words and tokens of each rest class.
    """

    def __init__(self, listed: list[tuple[str, int]], top: int, rest: int, kinds: dict[int, tuple[int, int]]) -> None:
        super().__init__({w: k for k, (w, _) in enumerate(listed)})
        self.made = listed, top, rest, kinds
        self.top, self.rest, self.size, self.listed = top, rest, top + rest, len(listed)
        self.totals = np.array([(n := kinds.get(k, (0, 0)))[1] + ALPHA * (n[0] + 1) for k in range(rest)])
        own = [k if k < top else self.hashed(w) for k, (w, _) in enumerate(listed)]
        self.classes = np.array([*own, *range(top, self.size)], np.int64)
        #: Log of the share of the class; 0 for words that aren't listed, whose share is joined.
        self.log_share = np.zeros(len(self.classes))
        for k, (_, n) in enumerate(listed[top:], top):
            self.log_share[k] = np.log((n + ALPHA) / self.totals[own[k] - top])

    def __reduce__(self):
        return Vocabulary, self.made

    def hashed(self, word: str) -> int:
        return self.top + zlib.crc32(word[-ENDING:].encode()) % self.rest

    def __missing__(self, word: str) -> int:
        k = self.listed + self.hashed(word) - self.top
        if len(self) < 1_000_000:
            self[word] = k
        return k


def gather(docs: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary, and word, n of every word."""
    counts = write_table(word_counts(docs), "word_counts")
    least, listed, every = None, 0, 0
    for r in sorted(counts.groupBy("n").agg(F.count(F.lit(1)).alias("types")).collect(), key=lambda r: -r["n"]):
        every += r["types"]
        if every <= LISTED:
            least, listed = r["n"], every
    words = [] if least is None else [(r["word"], r["n"]) for r in counts.where(F.col("n") >= least).collect()]
    words.sort(key=lambda x: (-x[1], x[0]))
    grown = round(every ** (1 / 3))
    top, rest = min(max(TOP, grown), listed), max(REST, grown // 3)
    others = counts.where(~F.col("word").isin([w for w, _ in words[:top]])) if top else counts
    kinds = others.groupBy(rest_class("word", rest).alias("k")).agg(F.count(F.lit(1)).alias("types"), F.sum("n").alias("n")).collect()
    return Vocabulary(words, top, rest, {r["k"]: (r["types"], r["n"]) for r in kinds}), counts


class WindowModel:
    """Parameters: embeddings e (classes + 1 for the edge, width), one projection per offset, hidden bias, output weights and bias."""

    OFFSETS = [k for k in range(-SIDE, SIDE + 1) if k]

    def __init__(self, classes: int, width: int = WIDTH, hidden: int = HIDDEN, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        self.classes = classes
        made = {"e": rng.normal(0, 0.5, (classes + 1, width)), "p": rng.normal(0, 0.3, (len(self.OFFSETS), width, hidden)), "a": np.zeros(hidden), "o": rng.normal(0, 0.2, (hidden, classes)), "b": np.zeros(classes)}
        self.w = {k: v.astype(np.float32) for k, v in made.items()}

    def loss_and_grads(self, context: np.ndarray, y: np.ndarray):
        """context (n, offsets) and masked classes y (n): mean cross entropy and gradients."""
        w, n = self.w, len(y)
        emb = w["e"][context]
        flat, p_flat = emb.reshape(n, -1), w["p"].reshape(-1, w["p"].shape[2])
        x = flat @ p_flat + w["a"]
        s = x / (1 + np.abs(x))
        logits = s @ w["o"] + w["b"]
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(1, keepdims=True)
        loss = float(-np.log(p[np.arange(n), y] + 1e-9).mean())
        p[np.arange(n), y] -= 1
        p /= n
        dx = (p @ w["o"].T) * (1 - np.abs(s)) ** 2
        de = np.zeros_like(w["e"])
        np.add.at(de, context, (dx @ p_flat.T).reshape(emb.shape))
        return loss, {"o": s.T @ p, "b": p.sum(0), "a": dx.sum(0), "p": (flat.T @ dx).reshape(w["p"].shape), "e": de}

    def train(self, context: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 1) -> float:
        rng, losses, adam = np.random.default_rng(seed), [], Adam(self)
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(y), batch)
            losses.append(adam.step(context[pick], y[pick], rate * (1 - step / (steps + 1))))
        return float(np.mean(losses[-max(1, steps // 10) :]))

    def log_probs(self, context: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Log-probability of each masked class."""
        w = self.w
        tables = [w["e"] @ w["p"][k] for k in range(len(self.OFFSETS))]
        out = np.empty(len(y), np.float64)
        for at in range(0, len(y), ROWS):
            c, t = context[at : at + ROWS], y[at : at + ROWS]
            x = tables[0][c[:, 0]] + w["a"]
            for k in range(1, len(tables)):
                x += tables[k][c[:, k]]
            x /= 1 + np.abs(x)
            logits = x @ w["o"]
            logits += w["b"]
            chosen = logits[np.arange(len(t)), t]
            np.clip(logits, -60, 60, out=logits)
            np.exp(logits, out=logits)
            out[at : at + ROWS] = chosen - np.log(logits.sum(1))
        return out


class Adam:
    def __init__(self, model: WindowModel) -> None:
        self.model, self.steps = model, 0
        self.m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.w.items()}

    def step(self, context: np.ndarray, y: np.ndarray, rate: float) -> float:
        self.steps += 1
        loss, grads = self.model.loss_and_grads(context, y)
        for k, g in grads.items():
            a, b = self.m[k]
            a += 0.1 * (g - a)
            b += 0.01 * (g**2 - b)
            self.model.w[k] -= (rate * (a / (1 - 0.9**self.steps)) / (np.sqrt(b / (1 - 0.99**self.steps)) + 1e-8)).astype(np.float32)
        return loss


def windows(ids: list[np.ndarray], edge: int, skip: int = 0, stride: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Contexts and masked classes of every position, or every `stride`-th after `skip`; beyond a document's ends stands the edge."""
    gap = np.full(SIDE, edge, np.int64)
    line = np.concatenate([x for d in ids for x in (gap, d)] + [gap])
    at = np.flatnonzero(line != edge)[skip::stride]
    return np.stack([line[at + k] for k in WindowModel.OFFSETS], 1), line[at]


def split(text: str | None) -> list[str]:
    # str.split() would also cut at spaces beyond ASCII, bytes.split() cuts at 0x20 and 0x09 to 0x0D only.
    return [w.decode() for w in (text or "").lower().encode().split()]


def places(words: list[str], vocabulary: Vocabulary) -> np.ndarray:
    return np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words))


def fit(docs: DataFrame) -> tuple[Vocabulary, WindowModel, DataFrame]:
    """Vocabulary, model and counts of all words."""
    vocabulary, counts = gather(docs)
    words = F.split(text_of(), SPACES)
    start = 1 + F.pmod(F.xxhash64("doc_id"), F.greatest(F.size(words) - TRAIN_WORDS, F.lit(0)) + 1)
    few = docs.where("doc_id is not null").select("doc_id", F.array_join(F.slice(words, start.cast("int"), TRAIN_WORDS), " ").alias("text"))
    sample = [r["text"] for r in hash_sample(few, TRAIN_DOCS, "doc_id", total=docs.select("doc_id")).collect()]  # at most TRAIN_DOCS * TRAIN_WORDS words
    model = WindowModel(vocabulary.size)
    ids = [vocabulary.classes[places(split(t), vocabulary)] for t in sample]
    if sum(map(len, ids)):
        model.train(*windows(ids, vocabulary.size))
    return vocabulary, trained_on_all(docs, vocabulary, model), counts


def trained_on_all(docs: DataFrame, vocabulary: Vocabulary, model: WindowModel, stride: int = STRIDE) -> WindowModel:
    """The mean, by windows, of what the partitions make of the model over every `stride`-th window of all their documents."""

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = WindowModel(vocabulary.size)
        own.w = {k: v.copy() for k, v in model.w.items()}
        adam, rng, n, skip = Adam(own), np.random.default_rng(2), 0, 0
        for text in (frame["text"].iloc[k : k + TEXTS] for frame in frames for k in range(0, len(frame), TEXTS)):
            ids = [vocabulary.classes[places(split(t), vocabulary)] for t in text]
            context, y = windows(ids, vocabulary.size, skip, stride)
            skip = (skip - sum(map(len, ids))) % stride
            pick = rng.permutation(len(y))
            n += len(y)
            for at in range(0, len(y), BATCH):
                now = pick[at : at + BATCH]
                adam.step(context[now], y[now], PASS_RATE * len(now) / BATCH)
        if n:
            yield pd.DataFrame({"n": [n], "weights": [pickle.dumps(own.w)]})

    total, sums = 0, {k: np.zeros(v.shape) for k, v in model.w.items()}
    for r in write_table(docs.select(text_of().alias("text")).mapInPandas(learn, "n long, weights binary"), "lm_weights").toLocalIterator():
        total += r["n"]
        for k, v in pickle.loads(r["weights"]).items():
            sums[k] += r["n"] * v
    if total:
        model.w = {k: (v / total).astype(np.float32) for k, v in sums.items()}
    return model


def score(docs: DataFrame, vocabulary: Vocabulary, model: WindowModel, counts: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """docs, or its columns `keep`, with lm: struct of tokens and log_prob."""

    def judged_texts(texts: pd.Series) -> pd.DataFrame:
        words = [split(t) for t in texts]
        at = [places(w, vocabulary) for w in words]
        lengths = np.array([len(x) for x in at], int)
        rest = [Counter(w[k] for k in np.flatnonzero(x >= vocabulary.listed)) for w, x in zip(words, at, strict=True)]
        out = pd.DataFrame({"tokens": lengths, "log_prob": np.zeros(len(at)), "tail": [list(c) for c in rest], "times": [list(c.values()) for c in rest]})
        if lengths.sum():
            context, y = windows([vocabulary.classes[x] for x in at], vocabulary.size)
            each = model.log_probs(context, y) + vocabulary.log_share[np.concatenate(at)]
            out["log_prob"] = np.bincount(np.repeat(np.arange(len(at)), lengths), each, len(at))
        return out

    @F.pandas_udf("tokens long, log_prob double, tail array<string>, times array<long>")
    def judge(texts: pd.Series) -> pd.DataFrame:
        return pd.concat([judged_texts(texts.iloc[k : k + TEXTS]) for k in range(0, max(1, len(texts)), TEXTS)], ignore_index=True)

    names = [c for c in keep or docs.columns if c.lower() != "lm"]
    (row,) = unused(docs, "lm_row")

    def build() -> DataFrame:
        judged = write_table(docs.select(*names, F.monotonically_increasing_id().alias(row), judge("text").alias("lm")), "lm_judged")
        tail = judged.select(row, F.explode(F.arrays_zip("lm.tail", "lm.times")).alias("x")).select(row, F.col("x.tail").alias("word"), F.col("x.times").alias("times"))
        totals = F.get(F.array(*[F.lit(float(x)) for x in vocabulary.totals]), rest_class("word", vocabulary.rest).cast("int"))
        shares = tail.join(counts, "word", "left").select(row, (F.col("times") * F.log((F.coalesce("n", F.lit(0)) + ALPHA) / totals)).alias("share"))
        joined = judged.join(shares.groupBy(row).agg(F.sum("share").alias("share")), row, "left")
        return joined.select(*names, F.struct("lm.tokens", (F.col("lm.log_prob") + F.coalesce("share", F.lit(0.0))).alias("log_prob")).alias("lm"))

    return settled(docs.sparkSession, build, "lm_scores")


def op7_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = read(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    per_word = F.when(F.col("lm.tokens") > 0, F.col("lm.log_prob") / F.col("lm.tokens"))
    return settled(spark, lambda: score(docs, *fit(docs), keep=["doc_id"]).select("doc_id", "lm.tokens", "lm.log_prob", per_word.alias("score")), "lm")
