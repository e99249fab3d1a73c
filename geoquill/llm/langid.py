"""Language ID by a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

One network reads a text's UTF-8 bytes forwards and one backwards, every position gets a probability for each language, and a document's
probabilities are the means over all its positions. So that one array operation serves many texts, they are read in chunks of CHUNK bytes; the forward
network begins WARM bytes before its chunk and the backward one WARM bytes behind it, so that neither starts a chunk without a state.

Training takes WINDOWS pieces of PIECE characters from at most TRAIN_DOCS labelled documents, as many of each language, in hash order. Scoring is one pass over
whole texts without a shuffle; a task holds one Arrow batch.

Defined cases: a text that is null or has no letter is `und` with score 0; with nothing to learn from, all are `und`; null and
repeated ids are scored like others; of equal probabilities the first language by code point is named; texts of any length are read whole; an empty table gives an empty
result; extra columns are carried, but lang_pred and lang_score are overwritten.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoquill.llm.common import crc_mod, prepare, read, unused

CHUNK, WARM, PIECE = 128, 32, 64
HIDDEN = 8
TRAIN_DOCS, WINDOWS = 3000, 4
#: Documents of a language that are taken at least, if it has them.
LANG_DOCS = 20
STEPS, BATCH, RATE = 500, 192, 0.01
ROWS = 2048  # chunks that are run together


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(np.minimum(x, 80, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Reader:
    """One direction: byte inputs (3h, 256), recurrent weights (3h, h) and a bias of the candidate's recurrent part (h, 1). Rows: update, reset, candidate."""

    def __init__(self, h: int, rng: np.random.Generator) -> None:
        self.h = h
        self.p = {"x": rng.normal(0, 0.5, (3 * h, 256)), "u": rng.normal(0, 0.6 / np.sqrt(h), (3 * h, h)), "c": np.zeros((h, 1))}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def run(self, bytes_: np.ndarray, keep: list | None = None):
        """bytes_ (t, n) -> yields the state (h, n) after each step; keep collects what backward needs."""
        h, n = self.h, bytes_.shape[1]
        x, u, c = self.p["x"], self.p["u"], self.p["c"]
        state = np.zeros((h, n), x.dtype)
        g, a, room = (np.empty((3 * h, n), x.dtype) for _ in range(3))
        for row in bytes_:
            np.matmul(u, state, out=g)
            np.take(x, row, axis=1, out=a, mode="clip")
            a[: 2 * h] += g[: 2 * h]
            _sigmoid(a[: 2 * h])
            g[2 * h :] += c
            np.multiply(a[h : 2 * h], g[2 * h :], out=room[:h])
            a[2 * h :] += room[:h]
            np.tanh(a[2 * h :], out=a[2 * h :])
            if keep is not None:
                keep.append((row, state, a.copy(), g[2 * h :].copy()))
            step = state - a[2 * h :]
            step *= a[:h]
            step += a[2 * h :]
            state = step
            yield state

    def backward(self, kept: list, dstates: list[np.ndarray]) -> dict[str, np.ndarray]:
        """Gradients by backpropagation through time; dstates: what the output layer sends to each state."""
        h, u = self.h, self.p["u"]
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        dh, inputs, rows = np.zeros_like(dstates[0]), [], []
        for (row, before, a, gn), d in zip(reversed(kept), reversed(dstates), strict=True):
            dh = dh + d
            z, r, n = a[:h], a[h : 2 * h], a[2 * h :]
            dn = dh * (1 - z) * (1 - n**2)
            dz = dh * (before - n) * z * (1 - z)
            dr = dn * gn * r * (1 - r)
            dg = np.concatenate([dz, dr, dn * r])
            grads["u"] += dg @ before.T
            grads["c"] += dg[2 * h :].sum(1, keepdims=True)
            inputs.append(np.concatenate([dz, dr, dn]))
            rows.append(row)
            dh = dh * z + u.T @ dg
        hot = np.zeros((256, sum(len(r) for r in rows)), np.float32)
        hot[np.concatenate(rows), np.arange(hot.shape[1])] = 1
        grads["x"] = np.concatenate(inputs, 1) @ hot.T
        return grads


class LanguageModel:
    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.readers = [Reader(hidden, rng), Reader(hidden, rng)]
        self.out = {"w": rng.normal(0, 0.3, (len(langs), 2 * hidden)).astype(np.float32), "b": np.zeros((len(langs), 1), np.float32)}

    def params(self) -> list[dict[str, np.ndarray]]:
        return [self.readers[0].p, self.readers[1].p, self.out]

    def probabilities(self, bytes_: np.ndarray, skip: int = 0) -> np.ndarray:
        """(t, n) bytes -> (t - 2 * skip, languages, n), for every position but the first and last `skip`, which the networks only start on."""
        h, t = self.readers[0].h, len(bytes_) - 2 * skip
        logits = np.empty((t, len(self.langs), bytes_.shape[1]), np.float32)
        for k, state in enumerate(self.readers[0].run(bytes_[: skip + t]), -skip):
            if k >= 0:
                np.matmul(self.out["w"][:, :h], state, out=logits[k])
        for k, state in enumerate(self.readers[1].run(bytes_[: skip - 1 if skip else None : -1]), -skip):
            if k >= 0:
                logits[t - 1 - k] += self.out["w"][:, h:] @ state
        logits += self.out["b"]
        logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(1, keepdims=True)
        return logits

    def loss_and_grads(self, bytes_: np.ndarray, mask: np.ndarray, y: np.ndarray):
        """Mean cross entropy over all positions (t, n) of mask, whose language is y (n), and its gradients."""
        h, (t, n) = self.readers[0].h, bytes_.shape
        kept: list[list] = [[], []]
        states = [list(self.readers[0].run(bytes_, kept[0])), list(self.readers[1].run(bytes_[::-1], kept[1]))]
        both = np.stack([np.concatenate([a, b]) for a, b in zip(states[0], reversed(states[1]), strict=True)])
        logits = self.out["w"] @ both + self.out["b"]
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(1, keepdims=True)
        weight = mask / max(1, mask.sum())
        at = np.arange(n)
        loss = float(-(np.log(p[:, y, at] + 1e-9) * weight).sum())
        p[:, y, at] -= 1
        p *= weight[:, None, :]
        grads = {"w": np.einsum("tln,thn->lh", p, both), "b": p.sum((0, 2))[:, None]}
        d = self.out["w"].T @ p
        return loss, [self.readers[0].backward(kept[0], list(d[:, :h])), self.readers[1].backward(kept[1], list(d[::-1, h:])), grads]

    def train(self, bytes_: np.ndarray, lengths: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 1) -> float:
        """Adam over random batches of windows, with as many of each language; gives the mean loss of the last tenth."""
        rng, losses = np.random.default_rng(seed), []
        by = [np.flatnonzero(y == k) for k in range(len(self.langs))]
        moments = [{k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()} for p in self.params()]
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(b, 1 + batch // len(by)) for b in by])
            mask = (np.arange(bytes_.shape[1])[:, None] < lengths[pick]).astype(np.float32)
            loss, grads = self.loss_and_grads(np.ascontiguousarray(bytes_[pick].T), mask, y[pick])
            losses.append(loss)
            for p, g, m in zip(self.params(), grads, moments, strict=True):
                for k in p:
                    a, b = m[k]
                    a += 0.1 * (g[k] - a)
                    b += 0.01 * (g[k] ** 2 - b)
                    p[k] -= (rate * (1 - step / (steps + 1)) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return float(np.mean(losses[-max(1, steps // 10) :]))

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities (documents, languages) over every byte of every text; zeros for an empty one."""
        lengths = np.array([len(b) for b in texts], int)
        chunks = -(-lengths // CHUNK)
        out = np.zeros((len(texts), len(self.langs)))
        if not chunks.sum():
            return out
        edge = b" " * WARM
        data = np.frombuffer(b"".join(edge + b.ljust(c * CHUNK, b" ") + edge for b, c in zip(texts, chunks.tolist(), strict=True)), np.uint8)
        doc = np.repeat(np.arange(len(texts)), chunks)
        first = np.cumsum(chunks) - chunks
        start = np.arange(len(doc)) * CHUNK + doc * 2 * WARM
        valid = np.minimum(CHUNK, lengths[doc] - (np.arange(len(doc)) - first[doc]) * CHUNK)
        for a in range(0, len(doc), ROWS):
            p = self.probabilities(data[start[a : a + ROWS] + np.arange(CHUNK + 2 * WARM)[:, None]], WARM)
            short = np.flatnonzero(valid[a : a + ROWS] < CHUNK)
            sums = p.sum(0)
            for k in short.tolist():
                sums[:, k] = p[: valid[a + k], :, k].sum(0)
            for k in range(len(self.langs)):
                out[:, k] += np.bincount(doc[a : a + ROWS], sums[k], len(texts))
        return out / np.maximum(lengths, 1)[:, None]


def training_windows(docs: DataFrame, n_docs: int = TRAIN_DOCS, windows: int = WINDOWS, size: int = PIECE) -> DataFrame:
    """lang, piece: evenly spaced pieces of at most n_docs labelled documents outside the held-out third, or LANG_DOCS of each language if that is more."""
    named = docs.where("lang is not null and doc_id is not null").where(crc_mod("doc_id", 3) != 1)
    counts = {r["lang"]: r["n"] for r in named.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    each = max(LANG_DOCS, n_docs // max(1, len(counts)))
    # A threshold on a hash lets about 1.5 times as many through, so the sort below meets a bounded number of rows.
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32))
    limits = [x for lang, n in counts.items() for x in (F.lit(lang), F.lit((1 << 32) if n <= 2 * each else int((1 << 32) * 1.5 * each / n)))]
    known = named.where(u < F.element_at(F.create_map(*limits), F.col("lang"))) if limits else named
    known = known.where(F.col("text").rlike(r"\p{L}"))
    pieces = F.array(*[F.expr(f"substring(text, 1 + cast(floor(greatest(length(text) - {size}, 0) * {k / max(1, windows - 1)}) as int), {size})") for k in range(windows)])
    few = known.select("doc_id", "lang", pieces.alias("pieces"), F.row_number().over(Window.partitionBy("lang").orderBy(u, "doc_id")).alias("nr")).where(F.col("nr") <= each)
    return few.select("lang", F.explode("pieces").alias("piece"))


def fit(docs: DataFrame) -> LanguageModel | None:
    rows = training_windows(docs.select("doc_id", "lang", "text")).collect()  # bounded: see training_windows
    rows = sorted((r["lang"], r["piece"]) for r in rows)
    langs = sorted({lang for lang, _ in rows})
    if not langs:
        return None
    pieces = [piece.encode()[:PIECE] for _, piece in rows]
    data = np.frombuffer(b"".join(p.ljust(PIECE, b" ") for p in pieces), np.uint8).reshape(-1, PIECE)
    model = LanguageModel(langs)
    model.train(data, np.array([len(p) for p in pieces]), np.array([langs.index(lang) for lang, _ in rows]))
    return model


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """docs with lang_pred and lang_score."""
    if model is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "lang_score": F.lit(0.0)})

    @F.pandas_udf("lang string, score double")
    def best(texts: pd.Series) -> pd.DataFrame:
        p = model.documents([b"" if t is None else t.encode() for t in texts])
        return pd.DataFrame({"lang": [model.langs[k] for k in p.argmax(1)], "score": np.clip(p.max(1), 0, 1)})

    known = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    (name,) = unused(docs, "best_")
    out = docs.withColumn(name, best("text"))
    return out.withColumns({"lang_pred": F.when(known, F.col(f"{name}.lang")).otherwise("und"), "lang_score": F.when(known, F.col(f"{name}.score")).otherwise(0.0)}).drop(name)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = read(prepare(spark), sf_dir, "documents")
    return predict(docs.select("doc_id", "text"), fit(docs)).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
