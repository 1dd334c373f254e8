"""Connected components of an edge table by contraction; nothing goes to the driver but counts and hot keys.

Each round hooks every node to its least neighbour, follows these pointers to their ends by doubling, and
replaces the ends of every edge by what they lead to. Edges within a component vanish, the others go on to
the next round among far fewer nodes; at the end the rounds' pointers are followed one after another.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinline.llm.common import discard, materialize

MOST_HOT = 1_000  # keys that are dealt out with a salt
LEAST_HOT = 500  # rows that no key is hot with
SALTS = 64


def hot_keys(rows: DataFrame, *keys: str) -> dict[str, list]:
    """Of each column of longs the ``MOST_HOT`` values with the most rows, of those with over ``LEAST_HOT``; any other
    has less than 1 / ``MOST_HOT`` of all rows."""
    one = lambda k: rows.filter(F.col(k).isNotNull()).groupBy(F.lit(k).alias("key"), F.col(k).alias("v")).agg(F.count("*").alias("n")).filter(F.col("n") > LEAST_HOT).orderBy(F.desc("n"), "v").limit(MOST_HOT)
    found = reduce(DataFrame.unionByName, map(one, keys)).collect()
    return {k: [r["v"] for r in found if r["key"] == k] for k in keys}


def lookup(rows: DataFrame, key: str, values: DataFrame, how: str = "inner", hot: list | None = None) -> DataFrame:
    """``rows`` joined with ``values``, in which ``key`` is unique. Rows of ``hot`` keys are dealt to ``SALTS`` places each by
    a hash of their other columns, and the few rows of ``values`` that they look up are sent to all of these."""
    if not hot:
        return rows.join(values, key, how)
    is_hot = F.col(key).isin(hot)
    salted = rows.filter(is_hot).withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    copies = values.filter(is_hot).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rest = rows.filter(~is_hot | F.col(key).isNull()).join(values, key, how)
    return rest.unionByName(salted.join(copies, [key, "__salt"], how).drop("__salt"))


def _ends(up: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pointers (node, up) followed to their ends, and the table they are in; each round halves the way that is left."""
    before = up
    while True:
        above = up.select(F.col("node").alias("up"), F.col("up").alias("upper"))
        after = materialize(lookup(up, "up", above, hot=hot_keys(up, "up")["up"]).select("node", F.col("upper").alias("up"), (F.col("upper") != F.col("up")).alias("moved")))
        up = after.select("node", "up")
        moved = after.filter("moved").limit(1).count()
        discard(before)
        before = after
        if not moved:
            return up, after


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 100) -> DataFrame:
    """(node, comp) of every node that has an edge to another; ``comp`` is the least node that it reaches."""
    least, most = F.least(a, b).alias("a"), F.greatest(a, b).alias("b")
    left = materialize(edges.filter(F.col(a) != F.col(b)).select(least, most).distinct())
    rounds, tables = [], []
    for _ in range(most_rounds):
        near = left.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(left.select(F.col("b").alias("node"), F.col("a").alias("other")))
        up, table = _ends(materialize(near.groupBy("node").agg(F.least("node", F.min("other")).alias("up"))))
        rounds.append(up)
        tables += [table, left]
        hot = hot_keys(left, "a", "b")
        ends = lookup(left, "a", up.select(F.col("node").alias("a"), F.col("up").alias("x")), hot=hot["a"])
        ends = lookup(ends, "b", up.select(F.col("node").alias("b"), F.col("up").alias("y")), hot=hot["b"])
        left = materialize(ends.filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if not left.limit(1).count():
            break
    else:
        raise RuntimeError("components didn't settle")
    comp = rounds[0].withColumnRenamed("up", "comp")
    for up in rounds[1:]:
        comp = lookup(comp, "comp", up.select(F.col("node").alias("comp"), F.col("up").alias("root")), "left", hot_keys(comp, "comp")["comp"]).select("node", F.coalesce("root", "comp").alias("comp"))
    comp = materialize(comp)
    discard(*tables, left)
    return comp


def merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` (node, comp) after more edges between nodes: only edges between components are worked on."""
    edges = materialize(edges)
    of = lambda end: labels.select(F.col("node").alias(end), F.col("comp").alias(f"c{end}"))
    hot = hot_keys(edges, "a", "b")
    between = lookup(lookup(edges.select("a", "b"), "a", of("a"), "left", hot["a"]), "b", of("b"), "left", hot["b"])
    between = materialize(between.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).filter("a != b"))
    moved = connected_components(between).select(F.col("node").alias("comp"), F.col("comp").alias("root"))
    fresh = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct().join(labels, "node", "left_anti").select("node", F.col("node").alias("comp"))
    labels = labels.unionByName(fresh)
    return materialize(lookup(labels, "comp", moved, "left", hot_keys(labels, "comp")["comp"]).select("node", F.coalesce("root", "comp").alias("comp")))
