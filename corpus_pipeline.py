"""A training corpus from documents: language ID, exact and near dedup, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import exact, langid, mixing, near, packing
from ledgerloom.llm.common import settled, table, whole_row

SURE = 0.5  # score from which a language counts as told

ORACLE_SQL = None  # models, hashes and plans have no SQL; tests compare the stages with brute force


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told: texts without a letter, or without a clear language, go."""
    train = docs.filter(~langid.held_out(docs) & docs["doc_id"].isNotNull())
    rows = docs.select(whole_row(docs).alias("row"), docs["text"].alias("text"))
    told = langid.predict(rows, langid.fit(train), row="row")
    return told.filter((F.col("lang_pred") != "und") & (F.col("score") >= SURE)).select("row.*")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that with the smallest id."""
    return exact.survivors(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that with the smallest id."""
    return near.survivors(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a repeated document is a repeated row."""
    return mixing.mixed_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact_copies),
    ("minhash_dedup", near_copies),
    ("mixing", mixture),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each but the last returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
