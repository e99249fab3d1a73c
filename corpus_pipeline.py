"""The corpus pipeline: documents in, a mixed training corpus out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. A stage's result is written
as Parquet in the shared folder and read again, so a lost executor costs one stage's tasks at most; what the stage itself wrote on the way is dropped then.

Defined cases: rows with null ids or texts pass through the stages as each says; texts of any length are read whole; of repeated rows and copies one stays (ties: the smallest id); an empty table
gives an empty result; extra columns are carried, and the copies' number is copy_no, or with underscores where documents has that column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geoquill.llm import decontam, jaccard, linededup, mixing, toxicity
from geoquill.llm.common import prepare, read, settled

STAGES = [
    ("toxicity", toxicity.stage),
    ("line_dedup", linededup.stage),
    ("ngram_jaccard", jaccard.stage),
    ("decontaminate", decontam.stage),
    ("mix_sources", mixing.stage),
]

#: SQL can't express the learned toxicity score; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
    return docs
