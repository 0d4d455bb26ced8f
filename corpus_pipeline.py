"""A corpus pipeline: what is toxic, a near copy or part of a benchmark goes; the rest is mixed and encoded.

Each stage takes (spark, docs, sf_dir), where docs has the columns of documents, and returns a DataFrame: all but the last
the columns of documents, the last the token table of what is left (a document that the mix repeats is encoded as often).
Null and empty texts pass the first four stages (of several without words one stays); the encoder gives them an end id. Each row is judged
by its own text, also if it has no doc_id or shares it; columns beyond those of documents pass through the first four stages. An empty table
gives no rows. What stages leave between them is stored; shapeloom.storage.clear() removes it once the result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shapeloom.llm import decontamination, mixing, simhash, token_files
from shapeloom.llm import toxicity as tox
from shapeloom.llm._util import stored, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tox.keep_clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_rows(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files.token_table(docs, token_files.default_tokenizer())


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing", mixing_sources),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{name}")
    return docs


#: SQL cannot express the fitted model or the tokenizer.
ORACLE_SQL = None
