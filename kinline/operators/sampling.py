"""Folds, splits and samples by hashes of ids, so that membership never depends on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinline.operators.keyed_pass import CAND, S1


def fold(id_col: str, folds: int = 5) -> Column:
    """1 to ``folds``."""
    return (F.pmod(F.crc32(F.col(id_col).cast("binary")), F.lit(folds)) + 1).cast("int")


def in_training(id_col: str, percent: int = 80) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("binary")), F.lit(100)) < percent


def hard_negative(sort_sim: str = "name_token_sort_sim", jw: str = "name_jaro_winkler", passes: str = "num_passes") -> Column:
    return (F.col(sort_sim) >= 0.50) | (F.col(jw) >= 0.70) | (F.col(passes) >= 2)


def first_by_hash(df: DataFrame, group: str, quotas: DataFrame, key: Column, ties: list[str], few: bool = False) -> DataFrame:
    """Of each group the first ``quota`` rows by an MD5 key (``quotas``: group, quota).

    Rows are counted by the first three hex digits of the key; digits below the quota are taken whole, and only
    the rows of the one that crosses it (about 1 in 4,096) are ordered, so no task sees a whole group.
    Of a ``few`` groups the counts, at most 4,096 rows of each, are broadcast, so no row taken whole is shuffled.
    """
    keyed = df.withColumn("__key", key).withColumn("__bucket", F.substring("__key", 1, 3))
    upto = F.sum("n").over(Window.partitionBy(group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sizes = keyed.groupBy(group, "__bucket").agg(F.count("*").alias("n")).withColumn("__upto", upto).join(quotas, group)
    sizes = sizes.withColumn("__room", F.col("quota") - (F.col("__upto") - F.col("n"))).filter("__room > 0").withColumn("__whole", F.col("__room") >= F.col("n"))
    sizes = sizes.select(group, "__bucket", "__room", "__whole")
    joined = keyed.join(F.broadcast(sizes) if few else sizes, [group, "__bucket"])
    place = F.row_number().over(Window.partitionBy(group, "__bucket").orderBy("__key", *ties))
    whole = joined.filter("__whole").select(df.columns)
    return whole.unionByName(joined.filter("not __whole").withColumn("__place", place).filter("__place <= __room").select(df.columns))


def training_sample(pairs: DataFrame, hard_ratio: int = 3, easy_ratio: int = 1) -> DataFrame:
    """All positives, and at most a ratio of hard and of easy negatives, by order of a hash of the pair."""
    kind = F.when(F.col("label") == 1, "positive").when(F.col("hard"), "hard").otherwise("easy")
    marked = pairs.withColumn("kind", kind)
    n = marked.agg(F.count_if(F.col("label") == 1).alias("n"))
    ratio = F.create_map(F.lit("positive"), F.lit(1), F.lit("hard"), F.lit(hard_ratio), F.lit("easy"), F.lit(easy_ratio))
    quotas = n.select(F.explode(F.map_entries(ratio)).alias("e"), "n").select(F.col("e.key").alias("kind"), (F.col("e.value") * F.col("n")).alias("quota"))
    return first_by_hash(marked, "kind", quotas, F.md5(F.concat_ws("|", S1, CAND)), [S1, CAND], few=True)  # three kinds


def stratified(df: DataFrame, stratum: str, id_col: str, total: int) -> DataFrame:
    """About ``total`` rows, by share of each stratum; the last stratum takes what is left."""
    every = Window.partitionBy()  # over one row for each stratum
    sizes = df.groupBy(stratum).agg(F.count("*").alias("n")).withColumn("quota", F.floor(F.col("n") * total / F.sum("n").over(every)))
    rest = total - F.sum("quota").over(every) + F.col("quota")
    quotas = sizes.select(stratum, F.when(F.col(stratum) == F.max(stratum).over(every), rest).otherwise(F.col("quota")).alias("quota"))
    return first_by_hash(df, stratum, quotas, F.md5(id_col), [id_col])
