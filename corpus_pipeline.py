"""A corpus pipeline of four of the training-data operators.

Each stage takes the documents that the one before kept, written as Parquet
and read again; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.language_id import held_out, identify
from ledgerlens.llm.near_dedup import near_duplicates
from ledgerlens.llm.packing import pack
from ledgerlens.llm.substring_dedup import substring_dedup
from ledgerlens.llm.workspace import Workspace


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: those that the identifier rejects go."""
    named = identify(docs, usable=~held_out(), outputs=("_lang_pred", "_score", "_rejected"))
    return named.filter("NOT _rejected").select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group of near copies (five words, 0.8).

    Rows that share a doc_id are one document; the row of least hash over all
    columns stands for it.  Rows without a doc_id are linked with nothing: one of
    each distinct row stays.
    """
    kept = near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    rows = docs.join(kept, docs.doc_id == kept["_kept_id"], "left_semi")
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64(*docs.columns))
    named = rows.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").drop("_nth")
    return named.unionByName(docs.filter("doc_id IS NULL").distinct())


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 35-word windows that start anywhere else."""
    out = substring_dedup(docs)
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    length = F.when(changed, F.length("kept_text").cast("long"))
    new = {"text": text.alias("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = length.otherwise(F.col("n_chars")).alias("n_chars")
    return out.select(*(new.get(c, F.col(c)) for c in docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts in sequences of 1,024 tokens."""
    return pack(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("near_dedup", keep_one_of_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("packing", pack_sequences),
]

#: Language prediction and packing are beyond SQL; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = space.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
