"""Resampling, main text and centroid clusters against brute force, on held-out and unseen pages, and on odd input."""

import hashlib
import html
import json
import math
import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from test_operators import DOCS, odd, words  # noqa: E402

from geoquill.llm import centroids, maintext, registry, resample  # noqa: E402

DATA = Path("/root/testdata")
needs_data = pytest.mark.skipif(not DATA.exists(), reason="the tables aren't here")


# 11: resampling
def brute_resample(docs, bench, percent=10, least=20, runs=1):
    split = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(str.maketrans(resample.UPPER, resample.LOWER)))
    grams = lambda t: [" ".join(w[i : i + n]) for w in [split(t)] for n in range(1, runs + 1) for i in range(len(w) - n + 1)]
    code = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = Counter(code(f) for _, x in docs for f in grams(x)), Counter(code(f) for x in bench for f in grams(x))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000))))
    rows = []
    for i, x in docs:
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(code(f)) for f in grams(x))
        rows.append((i, len(grams(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((-sc, -math.inf if i is None else i, n, k) for k, (i, n, _, sc) in enumerate(rows) if len(split(docs[k][1])) >= least)
    rank = {k: r for r, (*_, k) in enumerate(able[: percent * len(able) // 100], 1)}
    return sorted(((*row, rank.get(k)) for k, row in enumerate(rows)), key=str)


@pytest.mark.parametrize("runs", [1, 2])
def test_resample_against_brute_force(spark, runs):
    """Also with ties: many rows of one id and text, of which some are drawn and some are not."""
    rng = random.Random(11)
    docs = [(i, words(rng, rng.choice([0, 5, 19, 20, 21, 60]))) for i in range(300)] + [(None, None), (900, None), (901, ""), (902, "ÀB äé 12x"), (None, words(rng, 30))]
    docs += [(7000, " ".join(["Ka"] * 25))] * 60
    bench = [words(rng, 40), None, "", "ka " * 2000]
    df, target = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(b,) for b in bench], "text string")
    for percent in (0, 10, 37, 100):
        got = resample.resample(df, target, percent, n=runs, carry=("doc_id",)).collect()
        assert sorted(map(tuple, got), key=str) == brute_resample(docs, bench, percent, runs=runs)


def test_quickselect_finds_every_rank(spark, monkeypatch):
    monkeypatch.setattr(resample, "PIVOTS", 3)
    rng = random.Random(12)
    keys = [(rng.choice([5, -5, 1 << 60]), rng.randrange(4), k) for k in range(200)]
    df = spark.createDataFrame(keys, "a long, b long, c long")
    for k in (1, 2, 57, 133, 199, 200):
        assert resample.kth_key(df, ["a", "b", "c"], k) == sorted(keys)[k - 1]
    assert resample.kth_key(df, ["a", "b", "c"], 201) is None and resample.kth_key(df.limit(0), ["a", "b", "c"], 1) is None


def test_resample_odd_input(spark):
    clash = ("row_", "able_", "key_a", "key_b", "key_c", "gained", "n", "place", "_part", "b")
    bench = spark.createDataFrame([(None,), ("word word",)], "text string")
    got = resample.resample(odd(spark).withColumns({c: F.lit("x") for c in clash}), bench)
    assert got.count() == 7 and all(r[c] == "x" for r in got.collect() for c in clash)
    assert {r["doc_id"]: r["n_features"] for r in got.collect()} == {None: 0, 1: 0, 2: 0, 3: 20000, 4: 3, 5: 3}
    assert resample.resample(spark.createDataFrame([], DOCS), bench).count() == 0
    assert resample.resample(odd(spark), bench.limit(0)).count() == 7


# 12: main text
def held_out(name="sf0.01"):
    import pyarrow.parquet as pq

    rows = pq.read_table(DATA / name / "pages.parquet").to_pylist()
    apart = lambda r: zlib.crc32(str(r["page_id"]).encode()) % 5 == 0
    return [r for r in rows if not apart(r)], [r for r in rows if apart(r)]


def blocks(article):
    """The lines of an article of the tables' pages, by their own few tags."""
    parts = re.split(r"</?(?:p|h1|article)>", re.sub(r"</?b>", "", article).replace("<br>", " "))
    return [x for x in (" ".join(html.unescape(p).split()) for p in parts) if x]


@needs_data
def test_main_text_of_held_out_pages():
    """Pages that nothing was learned from: every character of every article, and nothing else."""
    learned, rest = held_out()
    weights = maintext.learn([r["html"] for r in learned][:100])
    assert len(rest) > 40
    for r in rest:
        assert maintext.extract(r["html"], weights) == "\n".join(blocks(maintext.labelled(r["html"])[1]))


@needs_data
def test_main_text_of_other_layouts():
    """Held-out articles in other elements, among menus, sidebars, notices, forms and comments with other pages' texts: nearly all pages exactly."""
    learned, rest = held_out()
    weights, rng = maintext.learn([r["html"] for r in learned][:100]), random.Random(9)
    texts = [t for r in rest for p in maintext.PARAGRAPH.findall(maintext.labelled(r["html"])[1]) if (t := " ".join(maintext.STRIP.sub(" ", p).split()))]
    good, hit, kept, wanted = 0, 0, 0, 0
    for r in rest * 4:
        page = maintext.restyled(maintext.labelled(r["html"])[1], texts, rng)
        want = [" ".join("".join(map(html.unescape, b.texts)).split()) for b in maintext.parse(page)[0] if b.inside]
        got = maintext.extract(page, weights).split("\n")
        a, b = Counter(" ".join(got).split()), Counter(" ".join(want).split())
        good, hit, kept, wanted = good + (got == want), hit + sum((a & b).values()), kept + sum(a.values()), wanted + sum(b.values())
    assert good >= 0.95 * 4 * len(rest) and hit > 0.98 * kept and hit > 0.98 * wanted


def test_region_is_the_best_of_all():
    rng = random.Random(13)
    for _ in range(200):
        scores = [rng.choice([-3.0, -1.0, -0.5, 0.0, 0.5, 2.0]) for _ in range(rng.randrange(25))]
        first, last = maintext.best_region(scores)
        assert sum(scores[first:last]) == max([0.0] + [sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)])


PLAIN = maintext.Weights({}, {"": 1.0})


@pytest.mark.parametrize(("page", "want"), [
    (None, ""), ("", ""), ("<p></p><br>", ""), ("just words", "just words"), ("a &amp; b &lt;c&gt; &#x41;&#66; &am &amp", "a & b <c> AB &am &"),
    ("<p>one two three four</p><p>five  six\n\tseven eight</p>", "one two three four\nfive six seven eight"), ("<p>a<b>b</b>c d e f<br>g h</p>", "abc d e f g h"),
    ("<p>one two three <!-- no <p> --> four five</p>", "one two three four five"), ("<p>one two three four<script>if (a < b) { x = '</p>' }</script> five six</p>", "one two three four five six"),
    ("<p>one two three four five<script>never ends", "one two three four five"), ("<p title='a > b'>one two three</p>", "one two three"), ("<p>one two 3 < 4 and 5</p>", "one two 3 < 4 and 5"), ("<p>one two three <", "one two three <"),
    ("<div class=x <p>one two three four", "one two three four"), ("one two &nbsp; three", "one two three"),
])
def test_pages_of_all_kinds(page, want):
    assert maintext.extract(page, PLAIN) == want


def test_long_and_broken_pages_take_their_length():
    import time

    began = time.time()
    for page in ("<div " * 200_000, "<" * 500_000, '<a href="' * 100_000, "<!--" * 200_000, "<p>" * 300_000 + "word", "</div>" * 200_000, "<script>" * 100_000, "word " * 500_000, "<b>x</b>" * 100_000):
        maintext.extract(page, PLAIN)
    assert time.time() - began < 60
    assert len(maintext.extract("<p>" + "word " * 500_000 + "</p>", PLAIN).split()) == 500_000


def test_main_text_odd_rows(spark):
    rows = [(None, None, None), (1, "u", ""), (2, "u", "<article><p>one two three.</p></article>"), (2, "u", "<article><p>one two three.</p></article>"), (3, "u", "<nav><a href=x>menu</a></nav>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("_class", "inside", "words", "h", "n")})
    assert maintext.with_text(pages, maintext.fit(pages)).count() == 5
    got = maintext.with_text(pages, PLAIN).collect()
    assert sorted((r["page_id"] or 0, r["text"] if r["page_id"] != 3 else "", r["n_chars"] if r["page_id"] != 3 else 0, r["words"]) for r in got) == [(0, "", 0, "x"), (1, "", 0, "x"), (2, "one two three.", 14, "x"), (2, "one two three.", 14, "x"), (3, "", 0, "x")]
    assert maintext.with_text(pages.limit(0), maintext.fit(pages.limit(0))).count() == 0


# 13: centroid clusters
def brute_clusters(rows, k=8, rounds=10, dims=64, seed=3):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    cents = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        where = [near(v)[1] for _, v in kept]
        for n in range(len(cents)):
            mine = [v for (_, v), w in zip(kept, where, strict=True) if w == n]
            if mine:
                cents[n] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    last = [(i, *reversed(near(v))) for i, v in kept]
    total = Counter()
    for _, c, d in last:
        total[c] += d
    return sorted([(i, c, d, total[c], sum(total.values()), hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for i, c, d in last], key=str)


def test_clusters_against_brute_force(spark):
    """Small dims with many ties, copies, empty clusters, negative and left-out vectors."""
    rng = random.Random(14)
    rows = [(i, [rng.choice([-0.01, -0.001, 0.0, 0.001, 0.5]) for _ in range(4)]) for i in range(300)] + [(i, [0.25] * 4) for i in range(300, 340)]
    rows += [(400, None), (401, []), (402, [1.0] * 3), (403, [1.0, None, 1.0, 1.0]), (404, [1.0, float("nan"), 1.0, 1.0]), (405, [1.0, float("-inf"), 1.0, 1.0]), (None, [0.1] * 4), (None, [0.2] * 4), (5, [0.3] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(7)
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    for k, rounds in ((8, 10), (1, 2), (5, 0), (1000, 1)):
        got = centroids.clustered(df, k=k, rounds=rounds, dims=4, carry=("vec_id",)).collect()
        assert sorted(map(tuple, got), key=str) == brute_clusters(exact, k, rounds, 4)


def test_threshold_walk_is_exact_and_stops_early():
    rng = np.random.default_rng(15)
    for k, dims in ((1, 3), (8, 64), (200, 3)):
        cents = rng.integers(-50, 50, (k, dims)) * (20 if k == 200 else 1)
        lists, x = centroids.Lists(cents), rng.integers(-60, 60, (500, dims)) * (20 if k == 200 else 1)
        number, distance, read = lists.nearest(x)
        every = ((x[:, None] - cents[None]) ** 2).sum(2)
        assert (number == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert read < 500 * 200 * 3 / 4  # most entries of the lists are never read


def test_clusters_odd_input(spark):
    df = spark.createDataFrame([(1, [1.0] * 64), (2, [1e30] * 64), (3, [-1e30] * 64)], "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("whole_", "c", "n", "s", "v", "h")})
    got = centroids.clustered(df).collect()
    assert len(got) == 3 and all(r["c"] == r["whole_"] == "x" for r in got) and {r["distance"] for r in got} == {0}
    assert centroids.clustered(df.limit(0)).columns == centroids.clustered(df).columns and centroids.clustered(df.limit(0)).count() == 0


@needs_data
@pytest.mark.parametrize("name", ["op11_resample", "op12_html_extract", "op13_centroid_clusters"])
def test_contract(spark, name):
    kinds = {
        "op11_resample": {"doc_id": "bigint", "n_features": "bigint", "weight": "bigint", "score": "bigint", "rank": "bigint"}, "op12_html_extract": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
        "op13_centroid_clusters": {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"},
    }
    got = registry.queries()[name](spark, str(DATA / "sf0.001"))
    assert dict(got.dtypes) == kinds[name]
    assert json.dumps([str(r) for r in got.limit(2).collect()])


def test_a_repeated_word_costs_its_length():
    """Item and text of one word: the pairs of places are many, runs are few."""
    import time

    from geoquill.llm import decontam

    tiler = decontam.Tiler([(1, " ".join(["word"] * 60)), (2, " ".join(f"w{k % 7}" for k in range(50)))])
    for n in (59, 60, 8_000, 200_000):
        began = time.time()
        assert tiler.best([" ".join(["word"] * n)]) == [(0, min(n, 60), 60, 1)]
        assert time.time() - began < 8
    assert tiler.best(["a b c", " ".join(f"w{k % 7}" for k in range(3, 5000))])[1][:3] == (1, 50, 50)
