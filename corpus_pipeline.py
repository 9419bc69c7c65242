"""A corpus from documents to packed sequences: language, near copies, secrets, mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as Parquet to the shared folder
and gives the next stage what it reads back. All stages but the last return the columns of documents.

Edges, at every stage: null, empty and blank texts go with the first stage; very long texts are read whole; null ids are kept
apart from each other; rows repeated in doc_id and text are near copies, of which one stays (that whose other columns have
the least hash); an empty table gives an empty result; further columns pass through all stages but the last, whatever their
names, also those that a stage uses for itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportmill.llm.common import column, packed, stored, table, unpacked
from reportmill.llm.language import predicted, train
from reportmill.llm.mixing import mixed
from reportmill.llm.near_dup import deduplicated
from reportmill.llm.packing import pack
from reportmill.llm.secrets import redacted


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (``und``) go, the others' lang becomes the predicted one.

    The machines learn from the documents' own lang; null and wrong ones are put right. Null and empty texts are ``und``.
    """
    found = docs.select(packed(docs).alias("row"), predicted(train(docs), column("text"))["lang_pred"].alias("lang")).filter("lang <> 'und'")
    return found.select(*unpacked("row", docs.columns, lang=F.col("lang")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, at five words and a similarity of 0.8."""
    return deduplicated(docs, size=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark; every document stays."""
    return redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences."""
    return pack(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: The cube method, min-hashes and tokenizers are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
