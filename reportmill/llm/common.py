"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.workers import giving_back, small_batches  # noqa: F401 (the operators import giving_back from here)

#: A word of the contracts: a run without ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only on a local master where none is named, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local[") and spark.conf.get("spark.master", "") != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="reportmill-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Written to the shared folder and read back: cuts the lineage, and lost executors cost nothing before it.

    Without compression ("none"), a reader's tasks are as large in memory as their files say, however many copies there are.
    """
    small_batches(df.sparkSession)
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def column(name: str) -> Column:
    """The column of just this name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame, *leave: str) -> Column:
    """All columns but those left out, as one struct: no column of a job's own can clash with what is inside."""
    return F.struct(*[column(c) for c in docs.columns if c not in leave])


def unpacked(row: str, names: list[str], **instead: Column) -> list[Column]:
    """The columns again, some given anew."""
    return [(instead[c] if c in instead else F.col(row).getField(c)).alias(c) for c in names]


def n_words(text: Column | str) -> Column:
    """Words in the text, 0 for null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def crc_mod4(doc_id: Column | str) -> Column:
    """crc32 of the id as text, mod 4; a null id counts as remainder 0."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4, F.lit(0))
