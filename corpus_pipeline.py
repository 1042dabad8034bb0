"""A training corpus from raw documents, in five stages.

language_id    documents whose language cannot be told with the calibrated
               threshold go; a missing label is filled in from the prediction.
near_copies    of each group linked by five-word shingles at a similarity of 0.8
               the document of smallest id stays.
secrets        spans that the scanner finds are replaced; no document goes.
mixture        documents are drawn by epochs to the token budget and weights;
               a document taken in two epochs is two rows from here on.
tokens         byte-level BPE; one row of digests for each row.

A stage is a function (spark, docs, sf_dir) -> DataFrame.  ``run`` writes each
result as Parquet in the shared folder and reads it back as the next stage's
``docs``, so a lost executor never reaches back further than one stage.

Edge cases, beyond those of the operators: rows without id are never named as
copies and stay; rows that share an id are one document and stay or go together;
columns besides those of documents are dropped by the first stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rebound.llm import bpe, language, mixing, overlap, secrets
from rebound.session import checkpoint_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(COLUMNS)
    told = language.identify(docs, language.fit_model(docs)).where(~F.col("rejected"))
    return told.withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = overlap.similar_components(docs, 5, 4, 5)
    go = groups.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    return docs.join(go, "doc_id", "left_anti").select(COLUMNS)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, secrets.scan(docs, secrets.new_ledger(spark))).select(COLUMNS)


def draw_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.select_mix(docs, mixing.MIX).select(COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.token_digests(docs, bpe.open_codec())


STAGES = [("language_id", identify_language), ("near_copies", drop_near_copies), ("secrets", hide_secrets),
          ("mixture", draw_mixture), ("tokens", tokenise)]

#: A trained classifier decides the first stage, which SQL cannot express; tests/llm compares ``run`` with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``."""
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
