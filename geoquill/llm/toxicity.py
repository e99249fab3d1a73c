"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding lower-cases, replaces look-alike letters (of other scripts, full-width, mathematical, circled) and digits that stand for letters, drops invisible
characters and combining marks, and turns every run of other characters into one space, so that an entry with a leading space is a word stem and one with spaces at both ends a whole word. A small fixed
lexicon is widened by stems and words that a bounded sample of labelled documents (TRAIN_TOXIC and TRAIN_CLEAN rows by hash
order) shows far more often in toxic ones. Hits inside an exception phrase don't count. The score is logistic in the weight of
the hits and in that weight by length.

Scale: one pass over the texts without a shuffle; the automaton is bounded by the sample. Term counts of the sample are a
pre-aggregated groupBy.

Defined cases: null and empty text count as a text without words (low score); null ids are scored, and never train; repeated
ids in labels count once (toxic if any row says so); repeated rows get equal scores, and a score of 0.5 counts as toxic; texts of any length are read whole; with no labels of both kinds, or none that hits go with, the
fixed slopes decide; an empty table gives an empty result; extra columns are carried, but tox_weight, tox_words and tox_score are overwritten.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoquill.llm.common import crc_mod, hash_sample, prepare, read, scratch, text_of, unused, write_table

# Words, phrases that excuse them, and look-alikes with the letters they stand for.
LEXICON = {"idiot": 6.0, "moron": 6.0, "stupid": 5.0, "scum": 6.0, "trash": 5.0, "loser": 5.0, "clown": 5.0, "pathetic": 5.0, "worthless": 5.0, "disgusting": 5.0}
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "circus clown", "idiot proof", "stupid simple")
LOOK_ALIKE = "аеорсухіјѕԁһԛԝвкмнтαοερνικυ0134578@$"
STANDS_FOR = "aeopcyxijsdhqwbkmhtaoepvikuoieastbas"

#: Characters beyond ASCII that are a plain letter or digit in another form, by Unicode's compatibility rule, and characters that don't show.
_FORMS = {chr(c): x for c in range(0x2000, min(0x1FBFF, sys.maxunicode)) if len(x := unicodedata.normalize("NFKC", chr(c)).lower()) == 1 and x.isascii() and x.isalnum()}
_PLAIN = dict(zip(LOOK_ALIKE, STANDS_FOR, strict=True))
MATCHING = LOOK_ALIKE + "".join(_FORMS)
REPLACING = STANDS_FOR + "".join(_PLAIN.get(x, x) for x in _FORMS.values())
HIDDEN = r"[\p{Mn}\p{Cf}]+"

TRAIN_TOXIC, TRAIN_CLEAN = 3000, 6000
LEAST_WEIGHT = 3.0
STEM = (3, 10)
#: Slope and offset for the logistic score where nothing was learned: log1p(weight), 100 * weight / words, constant.
DEFAULT_MODEL = (1.0, 0.5, -2.0)


def folded(text: Column) -> Column:
    letters = F.translate(F.regexp_replace(F.lower(text), HIDDEN, ""), MATCHING, REPLACING)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(letters, r"[^\p{L}]+", " ")), F.lit(" "))


def labelled_sample(docs: DataFrame, labels: DataFrame, n_toxic: int, n_clean: int) -> DataFrame:
    """fold, toxic of at most n_toxic + n_clean labelled documents outside the held-out fifth, in hash order."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(crc_mod("doc_id", 5) != 0)
    ids = hash_sample(known.where("toxic = 1"), n_toxic, "doc_id").unionByName(hash_sample(known.where("toxic = 0"), n_clean, "doc_id"))
    ids = ids.select(F.col("doc_id").alias("label_id"), "toxic")
    kept = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("label_id"))  # at most n_toxic + n_clean ids
    words = F.array_distinct(F.split(F.trim(folded(text_of())), " "))
    few = F.slice(F.array_sort(F.transform(words, lambda w: F.xxhash64(w))), 1, 3)
    # Copies and near copies of a text teach nothing more, so one of each stays.
    return kept.select(folded(text_of()).alias("_fold"), words.alias("words"), few.alias("few"), "toxic").dropDuplicates(["few", "toxic"]).drop("few")


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Stems and whole words of the sample with a log ratio of LEAST_WEIGHT or more, without those that a kept stem implies."""
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return {}
    stems = [F.transform(F.filter("words", lambda w, k=k: F.length(w) >= k), lambda w, k=k: F.concat(F.lit(" "), F.substring(w, 1, k))) for k in range(STEM[0], STEM[1] + 1)]
    whole = F.transform("words", lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    counts = (
        sample.select("toxic", F.explode(F.array_distinct(F.flatten(F.array(*stems, whole)))).alias("entry"))
        .groupBy("entry").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
        .where((F.col("t") >= max(5, toxic // 150)) & (F.col("entry") != "  "))
        .withColumn("weight", F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1)))
        .where(F.col("weight") >= LEAST_WEIGHT)
    )
    kept: dict[str, float] = {}
    for r in sorted(counts.collect(), key=lambda r: (len(r["entry"]), r["entry"])):
        stem = r["entry"].rstrip()
        implied = max((kept.get(stem[:k], 0.0) for k in range(STEM[0] + 1, len(stem) + (r["entry"] != stem))), default=0.0)
        if r["weight"] > implied + 0.5:
            kept[r["entry"]] = float(r["weight"])
    return kept


class Matcher:
    """Weight of hits and number of words of folded texts; built once in each Python worker."""

    _built: dict = {}

    def __init__(self, lexicon: dict[str, float], exceptions: tuple[str, ...]) -> None:
        self.lexicon, self.exceptions = lexicon, exceptions

    def automaton(self):
        key = (len(self.lexicon), hash(tuple(sorted(self.lexicon.items()))), self.exceptions)
        if key not in Matcher._built:
            import ahocorasick

            made = ahocorasick.Automaton()
            for entry, weight in self.lexicon.items():
                made.add_word(entry, (len(entry), weight))
            for phrase in self.exceptions:
                made.add_word(f" {phrase} ", (len(phrase) + 2, None))
            made.make_automaton()
            Matcher._built.clear()
            Matcher._built[key] = made
        return Matcher._built[key]

    def weigh(self, fold: str) -> float:
        best: dict[int, tuple[int, float]] = {}  # by the word's start: the longest entry there counts
        excused: list[tuple[int, int]] = []
        for end, (size, weight) in self.automaton().iter(fold):
            at = end - size + 1
            if weight is None:
                excused.append((at, end))
            elif at not in best or size > best[at][0]:
                best[at] = size, weight
        return sum(w for at, (_, w) in best.items() if not any(a <= at < b for a, b in excused))


def with_hits(df: DataFrame, lexicon: dict[str, float], exceptions=EXCEPTIONS, fold: str = "_fold", name: str = "_hits") -> DataFrame:
    """Adds the column `name` (struct of weight and words) for the column `fold`."""
    matcher = Matcher(lexicon, tuple(exceptions))

    @F.pandas_udf("weight double, words long")
    def hits(folds: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"weight": [matcher.weigh(x) for x in folds], "words": [max(0, x.count(" ") - 1) for x in folds]})

    return df.withColumn(name, hits(fold))


def _features(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.log1p(weight), np.minimum(100 * weight / np.maximum(words, 20), 50), np.ones(len(weight))], 1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> tuple[float, ...]:
    """Logistic regression by Newton steps."""
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * len(x) * np.eye(x.shape[1]) / 100
        beta = beta + np.linalg.solve(hessian, x.T @ (y - p) - ridge * len(x) / 100 * beta)
    return tuple(float(b) for b in beta)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], tuple[float, ...]]:
    """Lexicon and logistic coefficients from the labelled sample."""
    with scratch(docs.sparkSession):
        sample = write_table(labelled_sample(docs, labels, TRAIN_TOXIC, TRAIN_CLEAN), "toxicity_sample")
        lexicon = {f" {w}": x for w, x in LEXICON.items()} | learn_lexicon(sample)
        rows = with_hits(sample, lexicon).select("_hits.weight", "_hits.words", "toxic").collect()  # at most TRAIN_TOXIC + TRAIN_CLEAN
    y = np.array([r["toxic"] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return lexicon, DEFAULT_MODEL
    model = fit_logistic(_features(np.array([r["weight"] for r in rows]), np.array([r["words"] for r in rows])), y)
    return lexicon, model if max(model[:2]) > 0 else DEFAULT_MODEL  # labels that hits don't go with tell nothing


def score(docs: DataFrame, lexicon: dict[str, float], model: tuple[float, ...], exceptions=EXCEPTIONS) -> DataFrame:
    """docs with tox_weight, tox_words and tox_score."""
    a, b, c = model
    fold, hits = unused(docs, "_fold", "_hits")
    out = with_hits(docs.withColumn(fold, folded(text_of())), lexicon, exceptions, fold, hits)
    weight, words = F.col(f"{hits}.weight"), F.col(f"{hits}.words")
    x = a * F.log1p(weight) + b * F.least(100 * weight / F.greatest(words, F.lit(20)), F.lit(50.0)) + c
    return out.withColumns({"tox_weight": weight, "tox_words": words, "tox_score": 1 / (1 + F.exp(-x))}).drop(fold, hits)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, *fit(docs, read(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), F.col("tox_score").alias("score"),
        (F.col("tox_score") >= 0.5).cast("int").alias("predicted"), "tox_weight", "tox_words",
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic, with all their columns. Nulls, repeats, empty tables: as for the module."""
    prepare(spark)
    lexicon, model = fit(docs, read(spark, sf_dir, "labels"))
    renamed = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    texts = renamed.withColumns({c: F.col(f"c{docs.columns.index(c)}") for c in ("doc_id", "text")})
    return score(texts, lexicon, model).where("tox_score < 0.5").select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
