"""A pipeline over documents: toxicity, near duplicates, contamination, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusql.llm.common import Staged, drop_since, staged, table
from corpusql.llm.decontaminate import drop_contaminated
from corpusql.llm.minhash import keep_first
from corpusql.llm.packing import packed
from corpusql.llm.secrets import redacted
from corpusql.llm.toxicity import drop_toxic

STAGES = [
    ("toxicity", lambda spark, docs, sf_dir: drop_toxic(spark, docs, sf_dir)),
    ("near_duplicates", lambda spark, docs, sf_dir: keep_first(spark, docs, sf_dir)),
    ("decontamination", lambda spark, docs, sf_dir: drop_contaminated(spark, docs, sf_dir)),
    ("secrets", lambda spark, docs, sf_dir: redacted(spark, docs, sf_dir)),
    ("packing", lambda spark, docs, sf_dir: packed(spark, docs, sf_dir)),
]

#: Learned models and packing can't be told in SQL: tests/llm/test_pipeline.py holds each stage and the whole run against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what each stage before it returns is written and read again.

    Once a stage's rows are written, the tables that it and the stage before have staged are removed."""
    docs, before = table(spark, sf_dir, "documents"), staged()
    for name, step in STAGES[:-1]:
        written = Staged(step(spark, docs, sf_dir), name)
        drop_since(before, written)
        docs = written.df
    return STAGES[-1][1](spark, docs, sf_dir)
