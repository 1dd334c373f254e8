"""Joins of pairs: results as by brute force, and rows that grow with the tables, not with the square of a key's."""

import random
from collections import Counter, defaultdict
from math import log, sqrt

import pytest

from kinline.operators import keyed_pass as K
from kinline.operators import similarity as T
from kinline.sources.files import cached


def names(n, seed, repeat=1):
    r = random.Random(seed)
    words = ["north", "river", "mill", "works", "supply", "harbour", "stone", "bridge", "lark", "oak"]
    return [" ".join(r.choices(words, k=r.randint(1, 4))) + (f" {r.randint(0, 30)}" if r.random() < 0.5 else "") for _ in range(n)] * repeat


def joined(df):
    """Rows that joins made of it, after it has run."""
    rows, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        x = todo.pop()
        kind = x.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(x.finalPhysicalPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(x.plan())
        else:
            if "Join" in kind:
                rows = max(rows, x.metrics().apply("numOutputRows").value())
            todo += [x.children().apply(i) for i in range(x.children().size())]
    return rows


def by_hand(left, right, min_sim, k):
    """Rows are (id, name); the full product."""
    rows = {(s, i): Counter(n[j : j + 3] for j in range(len(n) - 2)) for s, side in enumerate((left, right)) for i, n in side}
    df = Counter(g for c in rows.values() for g in c)
    w = {x: {g: tf * (log((1 + len(rows)) / (1 + df[g])) + 1) for g, tf in c.items() if df[g] >= 2} for x, c in rows.items()}
    norm = {x: sqrt(sum(v * v for v in c.values())) for x, c in w.items()}
    out = defaultdict(list)
    for i, _ in left:
        for j, _ in right:
            dot = sum(v * w[1, j].get(g, 0) for g, v in w[0, i].items())
            if dot and (c := round(dot / norm[0, i] / norm[1, j], 9)) > min_sim:
                out[i].append((-c, j))
    return sorted((i, j, rank, -c) for i, found in out.items() for rank, (c, j) in enumerate(sorted(found)[:k], 1))


@pytest.mark.parametrize("block", [7, 16384])
def test_cosine_join_is_the_full_product(spark, monkeypatch, block):
    """Blocks of seven vectors and one block, with many equal names; ties go to the smaller id."""
    monkeypatch.setattr(T, "BLOCK", block)
    monkeypatch.setattr(T, "PRODUCTS", 50)
    left, right = ([(f"S{s}-{i}", n) for i, n in enumerate(names(30, s, 3))] for s in (1, 2))
    got = T.tfidf_join(*(spark.createDataFrame(x, "entity_id string, name string") for x in (left, right)), T.char_grams("name"), 0.45, 5)
    rows = sorted((r[0], r[1], r["rank"], r["cosine"]) for r in got.collect())
    want = by_hand(left, right, 0.45, 5)
    assert [r[:3] for r in rows] == [r[:3] for r in want] and [r[3] for r in rows] == pytest.approx([r[3] for r in want], abs=2e-9)


def test_cosine_join_emits_no_pairs_of_a_shared_term(spark):
    """300 names of either side share a rare word, and nothing else: 90,000 pairs meet in it."""
    side = lambda s: spark.createDataFrame([(f"S{s}-{i}", f"{s}{i:03d}zq x{i:03d}{s}") for i in range(300)] + [(f"S{s}-x{i}", "other") for i in range(900)], "entity_id string, name string")
    out = T.tfidf_join(side(1), side(2), T.char_grams("name"), 0.9, 3)
    out.collect()
    assert joined(out) < 20_000


def test_keyed_join_stops_at_the_cap(spark):
    """200 anchors and 200 targets share a word; of its 40,000 pairs the five firsts of each anchor matter, and those that share two words."""
    from pyspark.sql import functions as F

    keys = lambda: F.split("name", " ")
    side = lambda s: spark.createDataFrame([(f"S{s}-{i:03d}", f"common w{i}") for i in range(200)], "entity_id string, name string").withColumn("source", F.lit(s - 1))
    p = K.Pass("p", [K.Key(keys, keys, 800)], 5)
    assert K.shared_keys(side(1), side(2), [p]).count() <= 200 * (5 + 1 + 2)
    got = {(r[0], r["rank"]): (r[1], r["score"]) for r in K.keyed_passes(side(1), side(2), [p]).collect()}
    assert len(got) == 1000 and all(got[f"S1-{i:03d}", 1] == (f"S2-{i:03d}", 2) for i in range(200)) and got["S1-199", 2] == ("S2-000", 1)


@pytest.mark.parametrize("by_score", [True, False])
def test_keyed_join_is_the_full_join(spark, by_score):
    """Repeated words, several keys of other weights, a guard, a posting cap, and a least score."""
    from pyspark.sql import functions as F

    words, ends = lambda: F.split("name", " "), lambda: F.transform(F.split("name", " "), lambda w: F.substring(w, 1, 2))
    p = K.Pass("p", [K.Key(words, words, 60, 40, 2), K.Key(ends, ends, 80)], 4, by_score, least_score=1 if by_score else 3)
    left, right = ([(f"S{s}-{i:03d}", n) for i, n in enumerate(names(90, s))] for s in (3, 4))
    of = {0: lambda n: n.split(" "), 1: lambda n: [w[:2] for w in n.split(" ")]}
    want = []
    lists = {j: defaultdict(list) for j in of}
    for j, f in of.items():
        for i, n in sorted(right):
            for k in f(n):
                lists[j][k].append(i)
    for i, n in left:
        score = Counter()
        for j, key in enumerate(p.keys):
            for k in of[j](n):
                if len(lists[j][k]) <= key.max_df:
                    for c in lists[j][k][: key.posting_cap]:
                        score[c] += key.weight
        order = sorted((-v if by_score else 0, c) for c, v in score.items() if v >= p.least_score)
        want += [(i, c, score[c], rank) for rank, (_, c) in enumerate(order[: p.cap], 1)]
    frames = [spark.createDataFrame(x, "entity_id string, name string") for x in (left, right)]
    assert sorted(map(tuple, K.keyed_pass(*frames, p).collect())) == sorted(want)


def test_a_table_made_once_leaves_no_shuffle_files(spark, tmp_path):
    open_ = lambda: spark._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()
    before = open_()
    made = lambda: spark.range(1000).selectExpr("id % 700 AS k").groupBy("k").count()
    table = cached(spark, str(tmp_path / "t"), made)
    assert open_() <= before and table.count() == 700


def test_keyed_passes_are_made_part_by_part(spark):
    """No part holds the shuffles of all passes, and the parts together hold what one join does."""
    from kinline.plans import passes as P
    from kinline.queries import blocking as B
    from kinline.sources.entities import entities

    ents = entities(spark, "/root/testdata/sf0.001")
    parts = {n: make() for n, make in B._parts(ents, P.v3(), P.V3_BITS, {}, B.KEYED).items()}
    bits = [{r["bit"] for r in x.select("bit").distinct().collect()} for x in parts.values()]
    assert len(parts) == B.KEYED > 1 and max(map(len, bits)) <= 4 and sum(map(len, bits)) == len(set().union(*bits))
    rows = lambda x: sorted(map(tuple, x.collect()))
    assert sorted(r for x in parts.values() for r in rows(x)) == rows(B.found(ents, P.v3(), P.V3_BITS, {}))


def test_sample_shuffles_no_row_that_is_taken_whole(spark):
    """The counts of three kinds are broadcast, whatever the session's threshold."""
    from kinline.operators.sampling import training_sample

    pairs = spark.range(6_000).selectExpr("cast(id AS string) AS s1_entity_id", "cast(id AS string) AS candidate_entity_id", "cast(id < 2000 AS int) AS label", "false AS hard")
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        out = training_sample(pairs)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") >= 2
        assert sorted((r["kind"], r["count"]) for r in out.groupBy("kind").count().collect()) == [("easy", 2000), ("positive", 2000)]
    finally:
        spark.conf.set(key, before)
