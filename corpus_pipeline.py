"""A training corpus from documents: toxic ones go, one of each group of near duplicates stays, secrets are masked,
sources are mixed to target weights, and the texts are encoded as pieces.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns the columns of documents
(the last one adds the pieces); run() writes each stage's rows as a table in the shared folder and reads them again.
Null texts are empty ones to the first stages and have null pieces at the end; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import WS, arrow_rows, shared_dir, staged, table
from tidemark.llm.mixing import mix
from tidemark.llm.ngramjoin import near_duplicates
from tidemark.llm.pieces import encode
from tidemark.llm.secrets import find_secrets
from tidemark.llm.toxicity import THRESHOLD, score, train

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose toxicity is THRESHOLD or more; the model learns from the stage's documents and the labels."""
    arrow_rows(spark)
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).where(F.col("toxicity") < THRESHOLD).select(*COLUMNS)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of similar texts - that of the smallest doc_id, null last - and all rows without words.

    Rows are told apart by doc_id and text, so that different texts under one doc_id are judged each for itself, and
    copies without a doc_id go like others. Of repeated rows one stays.
    """
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("text"))
    keyed = docs.select(*COLUMNS).withColumn("row", row)
    found = near_duplicates(spark, keyed.select("row", "text"), key="row")
    folder = shared_dir(spark)
    first = staged(spark, found.where(F.col("node").isNotNull() & (F.col("row") == F.col("component_id"))).select("row").distinct(), folder, "first", small=True)
    wordless = F.length(F.translate(F.coalesce("text", F.lit("")), WS, "")) == 0
    kept = keyed.where(~wordless).join(first, "row", "left_semi").dropDuplicates(["row"])
    return kept.select(*COLUMNS).unionByName(docs.where(wordless).select(*COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts and counts their characters anew."""
    arrow_rows(spark)
    df = find_secrets(docs, redact=True)
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents by their source's target weight, in a shuffled order."""
    return mix(docs).select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the sampled pieces of each text, their number, and whether they decode to the text."""
    arrow_rows(spark)
    return encode(docs.select(*COLUMNS)).select(*COLUMNS, "pieces", "n_pieces", "lossless")


STAGES = [("toxicity", toxicity), ("near duplicates", near_duplicate), ("secrets", secrets), ("mixing", mixing), ("pieces", pieces)]

ORACLE_SQL = None  # the network, the grammar and the lattice are beyond SQL: tests/llm holds the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, docs = shared_dir(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(spark, stage(spark, docs, sf_dir), folder, name.replace(" ", "-"))
    return docs
