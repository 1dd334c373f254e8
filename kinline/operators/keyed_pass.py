"""The generic blocking join: sources meet on keys that few targets share, and each anchor keeps its best.

Any number of passes runs as one join. Keys of all passes are exploded together, with the number of the pass
and of the key as parts of the join key, so a table is read and normalised once, and what grows with the
number of passes is the rows of one shuffle, not the number of shuffles. Guards and caps hold for each pass and
each target source by itself.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

S1, CAND = "s1_entity_id", "candidate_entity_id"


@dataclass(frozen=True)
class Key:
    """Keys of either side (functions, as a column needs a session), and what a shared one counts."""

    left: Callable[[], Column]
    right: Callable[[], Column]
    max_df: int
    posting_cap: int | None = None
    weight: int = 1


@dataclass(frozen=True)
class Pass:
    name: str
    keys: list[Key]
    cap: int
    by_score: bool = True  # rank by shared keys, then id; else by id alone
    least_score: int = 1
    distinct: bool = False  # count a key once for each row
    valid: str = field(default="true")  # rows of either side that take part


def _exploded(df: DataFrame, passes: list[Pass], side: str, id_as: str, extra: list[str]) -> DataFrame:
    """(id, p, j, k): every key of every pass; ``p`` is the pass's place, ``j`` the key's."""

    def of(i: int, j: int, p: Pass, key: Key) -> Column:
        own = F.array_distinct(getattr(key, side)()) if p.distinct else getattr(key, side)()
        own = own if p.valid == "true" else F.when(F.expr(p.valid), own).otherwise(F.array().cast("array<string>"))
        return F.transform(own, lambda k: F.struct(F.lit(i).alias("p"), F.lit(j).alias("j"), k.alias("k")))

    keys = [of(i, j, p, key) for i, p in enumerate(passes) for j, key in enumerate(p.keys)]
    rows = df.select(F.col("entity_id").alias(id_as), *extra, F.explode(F.concat(*keys)).alias("x"))
    return rows.select(id_as, *extra, "x.p", "x.j", "x.k").filter("k != ''")


def _by_key(passes: list[Pass], value: Callable[[Pass, Key], int | None]) -> Column:
    """A number of each (p, j), as one expression of constants."""
    out = None
    for i, p in enumerate(passes):
        for j, key in enumerate(p.keys):
            this = (F.col("p") == i) & (F.col("j") == j)
            out = F.when(this, F.lit(value(p, key)).cast("long")) if out is None else out.when(this, F.lit(value(p, key)).cast("long"))
    return out


def _by_pass(passes: list[Pass], value: Callable[[Pass], int]) -> Column:
    return F.element_at(F.array(*[F.lit(value(p)) for p in passes]), F.col("p") + 1)


def postings(left: DataFrame, right: DataFrame, passes: list[Pass]) -> tuple[DataFrame, DataFrame]:
    """Keys of anchors, (s1, p, i, j, k, times) with ``i`` as the key's place in its row and pass, and of targets,
    (candidate, source, p, j, k, times, place): those that at most their guard's number of a source's rows have.

    The guard is applied before any join, so no key fans out by more than it; target rows whose key no anchor has
    are left out first. Frequencies are added up within each task before they are shuffled. ``place`` is by falling
    ``times`` where the pass ranks by score, then by id.
    """
    a = _exploded(left, passes, "left", S1, [])
    b = _exploded(right, passes, "right", CAND, ["source"])
    frequency = b.groupBy("source", "p", "j", "k").count().filter(F.col("count") <= _by_key(passes, lambda p, key: key.max_df)).select("source", "p", "j", "k")
    wanted = frequency.join(a.select("p", "j", "k").distinct(), ["p", "j", "k"], "left_semi")
    b = b.join(wanted, ["source", "p", "j", "k"])
    if any(key.posting_cap for p in passes for key in p.keys):
        place = F.row_number().over(Window.partitionBy("source", "p", "j", "k").orderBy(CAND))
        most = _by_key(passes, lambda p, key: key.posting_cap)
        b = b.withColumn("place", place).filter(most.isNull() | (F.col("place") <= most)).drop("place")
    b = b.groupBy("source", "p", "j", "k", CAND).agg(F.count("*").alias("times"))
    first = F.when(_by_pass(passes, lambda p: int(p.by_score)) == 1, -F.col("times")).otherwise(F.lit(0))
    b = b.withColumn("place", F.row_number().over(Window.partitionBy("source", "p", "j", "k").orderBy(first, CAND)))
    a = a.groupBy(S1, "p", "j", "k").agg(F.count("*").alias("times")).join(frequency.select("p", "j", "k").distinct(), ["p", "j", "k"], "left_semi")
    rows = a.groupBy(S1, "p").agg(F.array_sort(F.collect_list(F.struct("j", "k", "times"))).alias("x"))
    return rows.select(S1, "p", F.posexplode("x").alias("i", "x")).select(S1, "p", "i", "x.*"), b


def _two(keys: DataFrame, row: list[str], extra: str) -> DataFrame:
    """Every two keys of a row and pass: (row, p, x, y), structs of j, k and ``extra``, in order."""
    lists = keys.groupBy(*row, "p").agg(F.array_sort(F.collect_list(F.struct("j", "k", extra))).alias("e")).filter(F.size("e") > 1)
    pairs = F.flatten(F.transform("e", lambda x, n: F.transform(F.slice("e", n + 2, F.size("e")), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    return lists.select(*row, "p", F.explode(pairs).alias("z")).select(*row, "p", *[F.col(f"z.{s}.{c}").alias(f"{s}_{c}") for s in "xy" for c in ("j", "k", extra)])


def shared_keys(left: DataFrame, right: DataFrame, passes: list[Pass]) -> DataFrame:
    """(s1, candidate, source, p, i, score): shared keys of all pairs that a pass's cap can keep, and perhaps of more.

    Where a pass ranks by id, a target beyond the cap in a list has the cap's number of better ones there: only the
    firsts of each list are joined, and what is left shares no other key. Where it ranks by score, a target beyond
    the cap in a list is as far behind unless it shares another key: it is found by its two keys instead.
    """
    a, b = postings(left, right, passes)
    weight = _by_key(passes, lambda p, key: key.weight)
    capped = [i for i, p in enumerate(passes) if p.by_score or p.least_score <= min(key.weight for key in p.keys)]
    firsts = b.filter(~F.col("p").isin(capped) | (F.col("place") <= _by_pass(passes, lambda p: p.cap)))
    out = a.withColumn("score", F.col("times") * weight).drop("times").join(firsts.drop("place"), ["p", "j", "k"]).select(S1, CAND, "source", "p", "i", (F.col("score") * F.col("times")).alias("score"))
    scored = [i for i, p in enumerate(passes) if p.by_score]
    if scored:
        of = F.col("p").isin(scored)
        own = _two(a.filter(of).select(S1, "p", "j", "k", F.struct("i", (F.col("times") * weight).alias("n")).alias("l")), [S1], "l")
        both = own.join(_two(b.filter(of).withColumnRenamed("times", "r"), [CAND, "source"], "r"), ["p", "x_j", "x_k", "y_j", "y_k"])
        shared = F.explode(F.array(*[F.struct(F.col(f"{s}_l.i").alias("i"), (F.col(f"{s}_l.n") * F.col(f"{s}_r")).alias("score")) for s in "xy"]))
        out = out.unionByName(both.select(S1, CAND, "source", "p", shared.alias("x")).select(S1, CAND, "source", "p", "x.*"))
    return out


def keyed_passes(left: DataFrame, right: DataFrame, passes: list[Pass]) -> DataFrame:
    """(s1_entity_id, candidate_entity_id, source, p, score, rank) of all passes; ``right`` has a column ``source``.

    Shared keys are shuffled once, by the anchor: all that follows is within it.
    """
    once = shared_keys(left, right, passes).repartition(S1).groupBy(S1, CAND, "source", "p", "i").agg(F.max("score").alias("score"))
    score = once.groupBy(S1, CAND, "source", "p").agg(F.sum("score").cast("long").alias("score")).filter(F.col("score") >= _by_pass(passes, lambda p: p.least_score))
    best = F.when(_by_pass(passes, lambda p: int(p.by_score)) == 1, -F.col("score")).otherwise(F.lit(0))
    rank = F.row_number().over(Window.partitionBy(S1, "source", "p").orderBy(best, CAND)).cast("int")
    return score.withColumn("rank", rank).filter(F.col("rank") <= _by_pass(passes, lambda p: p.cap))


def keyed_pass(left: DataFrame, right: DataFrame, p: Pass) -> DataFrame:
    """(s1_entity_id, candidate_entity_id, score, rank) of one pass; sources of ``right`` are taken as one."""
    return keyed_passes(left, right.withColumn("source", F.lit(0)), [p]).select(S1, CAND, "score", "rank")
