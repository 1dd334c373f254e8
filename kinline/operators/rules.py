"""Deterministic matching rules and the address rule of the first blocking generation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinline.functions.keys import numeric_tokens
from kinline.operators.keyed_pass import CAND, S1

#: Key columns of the rules.
RULES = {
    "A": ["name_norm"],
    "B": ["name_clean_legal"],
    "C": ["address_norm"],
    "D": ["name_norm", "country_norm"],
    "E": ["name_clean_legal", "country_norm"],
    "F": ["name_norm", "address_norm"],
    "G": ["name_clean_legal", "address_norm"],
    "H": ["name_clean_legal", "address_norm", "country_norm"],
}


def address_tokens_v1(left: DataFrame, right: DataFrame, max_df: int = 1000, lone_df: int = 50, cap: int = 30) -> DataFrame:
    """Anchors with two or more numbers need two shared ones; those with one need a number that few targets have.

    The number of an anchor's numbers counts repeats, shared numbers do not.
    """
    keys = numeric_tokens()
    a = left.filter("address_norm != ''").select(F.col("entity_id").alias(S1), F.size(keys).alias("n"), F.explode(F.array_distinct(keys)).alias("k"))
    b = right.select(F.col("entity_id").alias(CAND), F.explode(F.array_distinct(keys)).alias("k"))
    frequency = b.groupBy("k").agg(F.count("*").alias("df")).filter(F.col("df") <= max_df)
    hits = a.join(b.join(frequency, "k"), "k").groupBy(S1, CAND, "n").agg(F.max("df").alias("df"), F.count("*").alias("score"))
    found = hits.filter(((F.col("n") >= 2) & (F.col("score") >= 2)) | ((F.col("n") == 1) & (F.col("df") <= lone_df)))
    rank = F.row_number().over(Window.partitionBy(S1).orderBy(CAND)).cast("int")
    return found.select(S1, CAND, "score").withColumn("rank", rank).filter(F.col("rank") <= cap)


def rule_matches(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """(s1, candidate) of rows that agree in all columns, none of them empty."""
    full = " and ".join(f"{c} != ''" for c in columns)
    a = left.filter(full).select(F.col("entity_id").alias(S1), *columns)
    return a.join(right.filter(full).select(F.col("entity_id").alias(CAND), *columns), columns).select(S1, CAND)


def rule_counts(anchors: DataFrame, targets: DataFrame, columns: list[str], truth: DataFrame) -> DataFrame:
    """(s1, n_pred, n_true, tp) of every anchor, without its matches: a name that k anchors and m targets share is
    counted once on each side, not k * m times. Ids are unique on either side."""
    full = " and ".join(f"{c} != ''" for c in columns)
    sizes = targets.filter(full).groupBy(*columns).agg(F.count("*").alias("n_pred"))
    predicted = anchors.filter(full).select(F.col("entity_id").alias(S1), *columns).join(sizes, columns).select(S1, "n_pred")
    key = F.when(F.expr(full), F.struct(*columns))
    pairs = truth.select(S1, CAND).distinct().join(anchors.select(F.col("entity_id").alias(S1), key.alias("ka")), S1, "left").join(targets.select(F.col("entity_id").alias(CAND), key.alias("kb")), CAND, "left")
    true = pairs.groupBy(S1).agg(F.count("*").alias("n_true"), F.count_if(F.col("ka") == F.col("kb")).alias("tp"))
    return anchors.select(F.col("entity_id").alias(S1)).join(predicted, S1, "left").join(true, S1, "left").fillna(0, ["n_pred", "n_true", "tp"])
