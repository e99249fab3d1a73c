"""All operators, stages and the pipeline on nulls, empty, blank and very long texts, ties, repeated rows, empty tables and clashing column names; and the queries on the smallest tables."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from test_operators import DOCS, odd  # noqa: E402

from geoquill.llm import decontam, jaccard, langid, linededup, lmscore, media, mixing, registry, secrets, toxicity, urlfilter  # noqa: E402

CLASH = ("_hits", "_fold", "best_", "lang_pred", "media", "n_bytes", "lm", "lm_row", "words_", "tiling", "copy_no", "drops", "_drops", "row_", "r1", "r2", "drop", "times", "gone_id", "h", "key", "n", "size", "label", "tox_score", "taken", "group", "_class")
DATA = Path("/root/testdata/sf0.001")


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASH})


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 1, 1), (None, 0, 1), (4, 1, None)], "doc_id long, quality int, toxic int")


def bench(spark):
    return spark.createDataFrame([(None, None), (1, "word word word"), (2, "")], "item_id long, text string")


#: name: (operator, rows that the seven odd documents give; columns that it may overwrite)
OPERATORS = {
    "toxicity": (lambda s, d: toxicity.score(d, *toxicity.fit(d, labels(s))), 7, {"tox_score"}),
    "language_id": (lambda s, d: langid.predict(d, langid.fit(d)), 7, {"lang_pred"}),
    "mix": (lambda s, d: mixing.mix(d), None, set()),
    "media": (lambda s, d: media.with_media(d), 7, {"media", "n_bytes"}),
    "components": (lambda s, d: jaccard.with_components(d), 7, set(CLASH)),
    "keep_one": (lambda s, d: jaccard.keep_one(d), 5, set()),
    "lm_score": (lambda s, d: lmscore.score(d, *lmscore.fit(d)), 7, {"lm"}),
    "line_dedup": (lambda s, d: linededup.dedup(d), 6, set()),
    "findings": (lambda s, d: secrets.findings(d, secrets.dictionary(d)), 0, set(CLASH)),
    "tiled": (lambda s, d: decontam.tiled(d, bench(s)), 7, {"tiling"}),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators(spark, name):
    work, n, written = OPERATORS[name]
    for docs in (odd(spark), clashing(odd(spark))):
        got = work(spark, docs)
        rows = got.collect()
        assert n is None or len(rows) == n
        kept = [c for c in docs.columns if c in CLASH and c not in written]
        assert all(r[c] == "x" for r in rows for c in kept)
    none = clashing(spark.createDataFrame([], DOCS))
    assert work(spark, none).count() == 0


STAGES = {"toxicity": (toxicity.stage, None), "line_dedup": (linededup.stage, 6), "ngram_jaccard": (jaccard.stage, 5), "decontaminate": (decontam.stage, 6), "mix_sources": (mixing.stage, None)}


@pytest.mark.parametrize("name", STAGES)
def test_stages(spark, tmp_path, name):
    stage, n = STAGES[name]
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    bench(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = clashing(odd(spark))
    got = stage(spark, docs, str(tmp_path))
    rows = got.collect()
    assert got.columns[: len(docs.columns)] == docs.columns and (n is None or len(rows) == n)
    assert len(got.columns) == len(docs.columns) + (name == "mix_sources")
    assert all(r[c] == "x" for r in rows for c in CLASH)
    assert stage(spark, clashing(spark.createDataFrame([], DOCS)), str(tmp_path)).count() == 0


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_pipeline(spark, tmp_path, rows):
    import corpus_pipeline

    docs = odd(spark) if rows == "odd" else odd(spark).limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    bench(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == [*docs.columns, "copy_no"] and (got.count() > 0) == (rows == "odd")
    # the long text of document 3 is the item; 5 repeats 4, and rows alike in all columns are one document
    assert not {r["doc_id"] for r in got.collect()} & {3, 5}


def test_pipeline_against_brute_force(spark, tmp_path):
    """Stage by stage over made-up documents whose fate is known."""
    import random

    import corpus_pipeline
    from test_operators import brute_tiling, words

    rng = random.Random(21)
    item = words(rng, 24)
    docs, fate = [], {}
    for i in range(60):
        docs.append((i, words(rng, 50), "en", f"s{i % 3}", 0))
        fate[i] = "kept"
    for i in range(60, 66):
        docs.append((i, words(rng, 30) + " you stupid worthless idiot, pathetic scum", "en", "s0", 0))
        fate[i] = "toxic"
    for i in range(66, 70):  # near copies: one word of fifty is another
        w = docs[i - 66][1].split()
        w[7] = f"other{i}"
        docs.append((i, " ".join(w), "en", "s1", 0))
        fate[i] = "copy"
    for i in range(70, 73):
        w = item.split()
        docs.append((i, words(rng, 30) + " " + " ".join(w[12:] + w[:12]) + " " + words(rng, 3), "en", "s2", 0))
        fate[i] = "leak"
        assert brute_tiling(w, docs[-1][1].split(), 6)[0] >= 12
    shared = words(rng, 12)
    docs += [(80, words(rng, 40) + "\n" + shared, "en", "s0", 0), (81, words(rng, 40) + "\n" + shared, "en", "s1", 0), (82, shared, "en", "s1", 0)]
    fate |= {80: "kept", 81: "kept", 82: "line"}
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(f == "toxic")) for i, f in fate.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), set(fate)
    for (name, stage), gone in zip(corpus_pipeline.STAGES, ("toxic", "line", "copy", "leak", None), strict=True):
        now = stage(spark, now, str(tmp_path))
        left -= {i for i, f in fate.items() if f == gone}
        ids = [r["doc_id"] for r in now.select("doc_id").collect()]
        if gone:
            assert sorted(ids) == sorted(left), name
    assert set(ids) <= left and len(ids) > len(left)
    assert all(shared not in r["text"] for r in now.where("doc_id = 81").collect())


@pytest.mark.skipif(not DATA.exists(), reason="the tables aren't here")
@pytest.mark.parametrize("name", registry.queries())
def test_queries_on_the_smallest_tables(spark, name):
    """Rows by the contract, and those of the SQL where there is one."""
    got = registry.queries()[name](spark, str(DATA))
    rows = got.collect()
    table = {"op2": "pages", "op12": "pages", "op13": "embeddings"}.get(name.split("_")[0], "documents")
    if not name.startswith("op9_"):
        assert len(rows) == spark.read.parquet(f"{DATA}/{table}.parquet").count()
    if name in registry.oracle_sql():
        import duckdb

        con = duckdb.connect()
        for view in ("documents", "benchmark", "embeddings"):
            con.execute(f"CREATE VIEW {view} AS SELECT * FROM '{DATA}/{view}.parquet'")
        want = con.execute(registry.oracle_sql()[name])
        columns = [d[0] for d in want.description]
        line = lambda r, names: tuple(round(r[names.index(c)], 6) if isinstance(r[names.index(c)], float) else r[names.index(c)] for c in sorted(names))
        assert sorted(line(r, columns) for r in want.fetchall()) == sorted(line(tuple(r), got.columns) for r in rows)


def test_rules_decide_urls_of_the_smallest_tables(spark):
    """Host, path and rule of every page against the contract written out plainly."""
    if not DATA.exists():
        pytest.skip("the tables aren't here")
    rules = sorted(urlfilter.RULES, key=lambda r: -len(r[1]))
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    for r in registry.queries()["op2_url_filter"](spark, str(DATA)).collect():
        url = pages[r["page_id"]]
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        ends = [k for k in (rest.find(c) for c in "/?#") if k >= 0]
        host, tail = (rest[: min(ends)], rest[min(ends) :]) if ends else (rest, "")
        path = tail.split("?")[0].split("#")[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [(a, rule) for a, rule in rules if (host == rule.split("/")[0] or host.endswith("." + rule.split("/")[0])) and path.startswith("/" + rule.split("/", 1)[1])]
        assert (r["host"], r["path"], r["rule"]) == (host, path, fits[0][1] if fits else None)
        assert not fits or r["verdict"] == fits[0][0]
