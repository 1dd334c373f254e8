"""Three sources of business records, and the truth between them, derived from the ``documents`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinline.functions.text import normalise_source, tokens
from kinline.session import scratch_base, ship_package
from kinline.sources.files import cached, version


def raw_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, source, business_name, business_address, country): source 0 is the anchor, 1 and 2 are noisy targets."""
    ship_package(spark)
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "n_chars")
    s, q = F.pmod("doc_id", F.lit(3)).cast("int"), F.floor(F.col("doc_id") / 3)
    words = tokens("text")
    name, backwards = F.array_join(F.slice(words, 1, 4), " "), F.array_join(F.reverse(F.slice(words, 1, 4)), " ")
    ending = F.element_at(F.array(F.lit(" ltd"), F.lit(" pvt ltd"), F.lit(" inc"), F.lit("")), (F.pmod(q, F.lit(4)) + 1).cast("int"))
    dropped = F.concat(F.substring(name, 1, 5), F.substring(name, 7, 1_000_000))
    noisy = F.when(s == 0, name).when(s == 1, F.concat(name, ending)).otherwise(F.when(F.pmod(q, F.lit(2)) == 0, backwards).otherwise(dropped))
    return d.select(
        F.concat(F.lit("S"), (s + 1).cast("string"), F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"),
        s.alias("source"),
        noisy.alias("business_name"),
        F.concat(F.coalesce(F.col("n_chars").cast("string"), F.lit("")), F.lit(" "), F.array_join(F.slice(words, 5, 4), " ")).alias("business_address"),
        F.coalesce("lang", F.lit("")).alias("country"),
        F.substring(F.regexp_replace(F.lower("text"), r"\s+", " "), 1, 120).alias("truth_key"),
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raw_entities``, normalised once for each version of the files and then read back."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return cached(spark, f"{scratch_base(spark)}/entities-{version(documents)}", lambda: normalise_source(raw_entities(spark, sf_dir)))


def split_sources(ents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(ents.filter(F.col("source") == i) for i in range(3))


def truth(ents: DataFrame) -> DataFrame:
    """(s1_entity_id, candidate_entity_id) of records of one document text."""
    left = ents.filter("source = 0").select(F.col("entity_id").alias("s1_entity_id"), "truth_key")
    right = ents.filter("source > 0").select(F.col("entity_id").alias("candidate_entity_id"), "truth_key")
    return left.join(right, "truth_key").select("s1_entity_id", "candidate_entity_id")
