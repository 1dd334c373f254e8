"""A corpus from documents: known language, no exact or near copies, no benchmark items, packed into sequences.

Each stage takes (spark, documents, folder of the tables) and works on all that the one before it kept; all
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinline.llm import language_id as lid
from kinline.llm.common import MIN_LONG, materialize, table
from kinline.llm.decontamination import clean_documents
from kinline.llm.exact_dedup import exact_dedup
from kinline.llm.ngram_jaccard import jaccard_classes
from kinline.llm.packing import pack, with_digest
from kinline.session import ship_package

ID, KEY, ROW = "__kinline_id", "__kinline_key", "__kinline_row"
WORD = r"[^\x20\x09-\x0D]"
LANGUAGES = None  # wanted languages; None: any that the labelled rows have
LEAST_SCORE = 0.5  # probability of the predicted language
LEAST_FIT = 0.0  # nats for each n-gram over what a text without a language would have


def _keep(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """One row for each id and key that ``kept`` (ID, KEY) has. Rows equal in both are joined up within tasks before any shuffle."""
    tagged = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(MIN_LONG)).alias(ID), F.struct(*docs.columns).alias(ROW)).withColumn(KEY, F.xxhash64(ID, F.col(f"{ROW}.text").cast("string")))
    hashable = [F.col(f"{ROW}.{f.name}") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    one = tagged.groupBy(ID, KEY).agg(F.min_by(ROW, F.xxhash64(*hashable)).alias(ROW))
    return one.join(kept.select(ID, KEY).distinct(), [ID, KEY], "left_semi").select(*[F.col(f"{ROW}.{c}").alias(c) for c in docs.columns])


def _id(col: str):
    return F.coalesce(F.col(col), F.lit(MIN_LONG)).alias(ID)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that are in none of ``LANGUAGES`` by a probability of ``LEAST_SCORE`` and a fit of ``LEAST_FIT``, or without a letter or text.

    The model learns from all labelled rows but a fifth; without labelled rows only texts without a letter go.
    Repeated rows and null ids are kept or go like any others.
    """
    ship_package(spark)
    model = lid.train(docs.filter(lid.fold("doc_id", 5) != 0))
    return lid.accepted(docs, model, languages=LANGUAGES, least_score=LEAST_SCORE, least_fit=LEAST_FIT)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for white space one stays: the longest, then the one with the smallest id (null before all).

    Null and empty texts are equal to each other; of rows equal in everything one stays.
    """
    ship_package(spark)
    kept = exact_dedup(docs).filter("kept").select(_id("doc_id"), F.col("key").alias(KEY))
    return _keep(docs, kept)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents the one with the smallest id stays; all documents without words stay."""
    ship_package(spark)
    full = F.coalesce(F.col("text").cast("string").rlike(WORD), F.lit(False))
    classes = jaccard_classes(docs).filter("n_shingles > 0")
    one = classes.groupBy("class_node").agg(F.min(F.struct(_id("doc_id"), F.col("key").alias(KEY))).alias("x"))
    return _keep(docs.filter(full), one.select(f"x.{ID}", f"x.{KEY}")).unionByName(docs.filter(~full))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; those without text, and repeated rows that hold none, stay."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4,096 tokens; a document without text is its end token alone."""
    ship_package(spark)
    return with_digest(pack(docs))


STAGES = [
    ("language_id", language_id),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

ORACLE_SQL = None  # a trained model and a tokenizer aren't SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
