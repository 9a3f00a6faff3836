"""A corpus pipeline: five operators one after another over ``documents``.

Each stage takes (spark, docs, sf_dir) and gives the documents that it keeps, with the columns they
came with; the last gives the encodings. Stages don't look at each other's decisions, only at
``docs``. Rows, not ids, are documents: stages that settle rows in another order number them first.

Defined results: a null text is an empty one. Null and repeated ids are ids like others: each row is judged,
kept and copied by itself. Repeated rows are copies of each other, of which one stays. Extra columns are carried along,
whatever their names. A table without rows gives one without rows. A table without labels, or with
one label only, has no toxic documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillforge.llm import bpe, mixing, ngram_join, quality_rules, toxicity
from rillforge.llm.common import checkpointed, fresh, numbered, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5."""
    model = toxicity.fit_documents(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return docs.where(toxicity.score_column(spark, model, F.col("text")) < 0.5)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, as they are: failing lines count, but stay in the text."""
    return quality_rules.keep(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the least id, nulls last, and of equal ids the first row.

    Texts without a word are no copies of each other, and all stay.
    """
    row = fresh(docs.columns, "row")
    rows = numbered(docs, row)
    classes = ngram_join.join_documents(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), "class_id")
    named = classes.join(rows.select(row, "doc_id"), row)
    first = named.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row)).alias("f")).select(F.col(f"f.{row}").alias(row))
    return rows.join(first, row, "left_semi").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes it."""
    row, copies = fresh(docs.columns, "row"), fresh(docs.columns, "copies")
    rows = numbered(docs, row)
    taken = mixing.mix(rows.select(row, "doc_id", "text", "source"), row=row).where(F.col("copies") > 0).select(F.col("row").alias(row), F.col("copies").cast("int").alias(copies))
    return rows.join(taken, row).select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(copies))).alias(copies)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded bytes of each row."""
    return bpe.encode_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Trained models and the similarity join have no SQL; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpointed(docs)
    return docs
