"""Readers and writers of source files, ground truth, benchmarks and reports."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinline.functions.wordlists import MISSING
from kinline.operators.keyed_pass import CAND, S1
from kinline.session import shuffles_go

SOURCE_SCHEMA = "entity_id string, business_name string, business_address string, country string"
TRUTH_ID_COLUMNS = ("source1_entity_id", "s1_entity_id")


def read_source(spark: SparkSession, path: str, missing_as_empty: bool = False) -> DataFrame:
    """A tab-separated source with a header, all text; texts that mean a missing value become null, or empty."""
    header = spark.read.csv(path, sep="\t", header=True, escape='"', inferSchema=False)
    cols = [c.split()[0] for c in SOURCE_SCHEMA.split(", ")]
    out = header.select(*[F.when(~F.col(c).isin(MISSING), F.col(c)).alias(c) for c in cols])
    return out.fillna("") if missing_as_empty else out


def head(df: DataFrame, n: int, order: str = "entity_id") -> DataFrame:
    """The first n rows by id; the order of a file isn't one of a table."""
    return df.orderBy(order).limit(n)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def normalised_path(spark: SparkSession, folder: str, source: str) -> str:
    """Where the normalised test table of a source is, under either of its names."""
    for name in (f"{source}_test_normalized", f"test_{source}_normalized"):
        for path in (f"{folder}/{name}", f"{folder}/{name}.parquet"):
            if _exists(spark, path):
                return path
    raise FileNotFoundError(f"{folder} has no normalised table of {source}")


def back_up(spark: SparkSession, path: str) -> str:
    """Copies an output once beside itself; a copy that is there is never overwritten."""
    copy = f"{path.rstrip('/')}.backup"
    if _exists(spark, path) and not _exists(spark, copy):
        hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
        a, b = hadoop.Path(path), hadoop.Path(copy)
        hadoop.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf)
    return copy


def read_threshold(spark: SparkSession, path: str, default: float = 0.95) -> float:
    """``optimal_threshold`` of a JSON file of metrics, or the default where the file or the value is missing."""
    if not _exists(spark, path):
        return default
    value = spark.read.text(path, wholetext=True).select(F.get_json_object("value", "$.optimal_threshold").cast("double")).first()
    return default if value is None or value[0] is None else value[0]


def truth_sets(pairs: DataFrame, anchors: DataFrame) -> DataFrame:
    """(s1, ids): every anchor with the set of its matches, empty where it has none."""
    return anchors.select(S1).join(pairs.groupBy(S1).agg(F.array_sort(F.collect_set(CAND)).alias("ids")), S1, "left").select(S1, F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))


def truth_id_column(columns: list[str]) -> str:
    for c in TRUTH_ID_COLUMNS:
        if c in columns:
            return c
    raise ValueError(f"none of {TRUTH_ID_COLUMNS} is among {columns}")


def read_truth_lists(spark: SparkSession, path: str) -> DataFrame:
    """(s1, ids): every anchor with the list of its matches, blanks left out."""
    raw = spark.read.csv(path, sep="\t", header=True, inferSchema=False)
    ids = F.filter(F.transform(F.split(F.coalesce("matched_entity_ids", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return raw.select(F.trim(truth_id_column(raw.columns)).alias(S1), ids.alias("ids")).filter(F.col(S1).isNotNull() & (F.col(S1) != ""))


def read_truth_pairs(spark: SparkSession, path: str, prefix: str | None = None) -> DataFrame:
    """Distinct (s1, candidate), of one target source where ``prefix`` names it."""
    out = read_truth_lists(spark, path).select(S1, F.explode("ids").alias(CAND)).distinct()
    return out.filter(F.col(CAND).startswith(prefix)) if prefix else out


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """(source, s1, candidate) of a JSON benchmark whose sources are named s2, s3 or s1_s2, s1_s3."""
    text = spark.read.text(path, wholetext=True)
    wanted = F.from_json("value", "s2 map<string,array<string>>, s3 map<string,array<string>>, s1_s2 map<string,array<string>>, s1_s3 map<string,array<string>>")
    doc = text.select(wanted.alias("j")).select(F.coalesce("j.s2", "j.s1_s2").alias("s2"), F.coalesce("j.s3", "j.s1_s3").alias("s3"))
    parts = [doc.select(F.lit(s).alias("source"), F.explode(s).alias(S1, "ids")).select("source", S1, F.explode("ids").alias(CAND)) for s in ("s2", "s3")]
    return parts[0].unionByName(parts[1])


def adapt_pairs(df: DataFrame, default_passes: str = "v3_blocker") -> DataFrame:
    """Pair columns under their usual names, a passes column, and each pair once."""
    for old, new in (("s1_idx", S1), ("s2_idx", CAND), ("s3_idx", CAND), ("matched_entity_id", CAND), ("entity_id_other", CAND)):
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    passes = F.coalesce(F.col("blocking_passes").cast("string"), F.lit(default_passes)) if "blocking_passes" in df.columns else F.lit(default_passes)
    return df.withColumn("blocking_passes", passes).dropDuplicates([S1, CAND])


def discover(names: list[str], defaults: list[str]) -> str:
    """The first folder that an environment variable or a default names and that exists."""
    for path in [*(os.environ.get(n, "") for n in names), *defaults]:
        if path and os.path.isdir(path):
            return path
    raise FileNotFoundError(f"none of {names} or {defaults} is a folder")


def version(df: DataFrame) -> str:
    """A name for the files that a table is read from, by their paths, sizes and times of change."""
    spark, seen = df.sparkSession, []
    for f in sorted(df.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        seen.append(f"{f} {status.getLen()} {status.getModificationTime()}")
    return hashlib.md5("\n".join(seen).encode()).hexdigest()


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """A table that is made once: read if it is there, else computed and written; the shuffle files of that go at once."""
    if not _exists(spark, f"{path}/_SUCCESS"):
        with shuffles_go(spark):
            make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_report(df: DataFrame, path: str, form: str = "json") -> None:
    (df.coalesce(1).write.json if form == "json" else lambda p: df.coalesce(1).write.csv(p, header=True))(path)
