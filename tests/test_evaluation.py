"""Readers, writers, matcher, greedy selection and categories, by hand-made rows."""

import pytest
from pyspark.sql import functions as F

from kinline.functions.features import FEATURES
from kinline.operators import diagnostics as D
from kinline.operators import matcher
from kinline.operators import metrics as M
from kinline.operators import submission as X
from kinline.operators.keyed_pass import CAND, S1
from kinline.operators.rules import rule_counts, rule_matches
from kinline.operators.sampling import hard_negative
from kinline.sources import files


def pairs(spark, rows, more=""):
    return spark.createDataFrame(rows, f"{S1} string, {CAND} string{more}")


def test_hard_negatives(spark):
    rows = [("a", "w", 0.5, 0.0, 1), ("a", "x", 0.49, 0.7, 1), ("a", "y", 0.49, 0.69, 2), ("a", "z", 0.49, 0.69, 1)]
    got = pairs(spark, rows, ", name_token_sort_sim double, name_jaro_winkler double, num_passes int").filter(hard_negative())
    assert sorted(r[1] for r in got.collect()) == ["w", "x", "y"]


def test_greedy_selection(spark):
    """Base finds 0 to 9; "b" adds 10 to 19, "a" the same and 20 to 23, "c" five of its own, "d" four."""
    truth = pairs(spark, [("s", str(i)) for i in range(40)])
    ranges = {1: range(10), 2: range(5, 20), 4: range(10, 24), 8: range(24, 29), 16: range(29, 33)}
    found = pairs(spark, [("s", str(i), b) for b, r in ranges.items() for i in r] + [("s", "no", 16)] * 9, ", bit int")
    assert M.greedy_selection(found, truth, {"base": 1}, {"b": 2, "a": 4, "c": 8, "d": 16}) == [("a", 14), ("c", 5)]
    assert M.greedy_selection(found, truth, {"base": 1}, {"b": 2, "d": 16}, least=4) == [("b", 10), ("d", 4)]


def test_sweep_equals_counting_at_each_threshold(spark):
    universe = spark.createDataFrame([(x,) for x in "abcd"], f"{S1} string")
    truth = pairs(spark, [("a", "1"), ("a", "2"), ("b", "1"), ("d", "9")])
    scored = pairs(spark, [("a", "1", 0.9), ("a", "1", 0.2), ("a", "2", 0.5), ("a", "3", 0.5), ("b", "2", 0.7), ("c", "1", 0.1)], ", probability double")
    for convention in M.EMPTY:
        got = {r.threshold: r for r in M.sweep(universe, scored, truth, [0.1, 0.5, 0.7, 0.95], convention).collect()}
        for t, r in got.items():
            want = M.macro_metrics(M.entity_counts(universe, scored.filter(F.col("probability") >= t), truth), convention).first()
            assert all(r[c] == want[c] for c in want.asDict())


def test_rule_counts_equal_those_of_the_pairs(spark):
    cols = "entity_id string, name_norm string, country_norm string"
    a = spark.createDataFrame([("S1-1", "x", "de"), ("S1-2", "x", "de"), ("S1-3", "", "de"), ("S1-4", "y", "fr")], cols)
    b = spark.createDataFrame([("S2-1", "x", "de"), ("S2-2", "x", "de"), ("S3-1", "x", "fr"), ("S3-2", "", "de")], cols)
    truth = pairs(spark, [("S1-1", "S2-1"), ("S1-1", "S3-1"), ("S1-3", "S3-2"), ("S1-1", "S2-1")])
    universe = a.select(F.col("entity_id").alias(S1))
    see = lambda df: sorted((r[S1], r.n_pred, r.n_true, r.tp) for r in df.collect())
    for keys in (["name_norm"], ["name_norm", "country_norm"]):
        assert see(rule_counts(a, b, keys, truth)) == see(M.entity_counts(universe, rule_matches(a, b, keys), truth))


def test_conversion_and_containment(spark):
    one = lambda b, m: spark.createDataFrame([(b, m)], "blocking_recall double, macro_recall double")
    assert tuple(M.conversion(one(50.0, 0.5), one(70.0, 0.6)).first()) == (20.0, 10.0, 50.0)
    assert M.conversion(one(70.0, 0.5), one(50.0, 0.6)).first().conversion_pct == 0
    ents = spark.createDataFrame([("a",), ("x",)], "entity_id string")
    assert M.containment(pairs(spark, [("a", "x"), ("a", "y")]), ents) == (2, 1)
    with pytest.raises(ValueError):
        M.containment(pairs(spark, []), ents)


def test_categories(spark):
    sides = ", ".join(f"{s}_{c} string" for s in "lr" for c in ("name_norm", "name_clean_legal", "address_norm", "country_norm"))
    cases = [
        ("country mismatch", "oak mill", "oak mill", "", "de", "oak mill", "oak mill", "", "fr"),
        ("legal suffix", "oak mill inc", "oak mill", "", "de", "oak mill ltd", "oak mill", "", "de"),
        ("token reorder", "mill oak kk", "mill oak", "", "de", "oak mill", "oak mill", "", "de"),
        ("punctuation", "oakmill", "oakmill", "", "de", "oak mill", "oak mill", "", "de"),
        ("abbreviation", "intl house", "intl house", "", "de", "intlinked barn", "intlinked barn", "", "de"),
        ("spelling variation", "harborside", "harborside", "", "de", "harbourside", "harbourside", "", "de"),
        ("missing name token", "stone river quarry", "stone river quarry", "", "de", "western quarry and granite works", "western quarry and granite works", "", "de"),
        ("numeric/address variation", "zebra", "zebra", "12 a", "de", "quilting", "quilting", "14 b", "de"),
        ("common name", "zebra", "zebra", "", "de", "quilting", "quilting", "", "de"),
    ]
    df = pairs(spark, [(f"S1-{i}", "S2-1", *c[1:]) for i, c in enumerate(cases)], f", {sides}")
    got = {r[S1]: r.category for r in df.withColumn("category", D.investigation_category()).collect()}
    assert got == {f"S1-{i}": c[0] for i, c in enumerate(cases)}
    audit = {r[S1]: r.category for r in df.withColumn("category", D.audit_category()).collect()}
    assert (audit["S1-1"], audit["S1-2"], audit["S1-6"], audit["S1-8"]) == ("exact_name_capped", "word_order_variation_capped", "partial_token_overlap_only", "extreme_name_divergence")
    few = {r.category: (r.n, r.examples) for r in D.category_samples(df, F.lit("all"), 2).collect()}
    assert few == {"all": (len(cases), "S1-0 S2-1, S1-1 S2-1")}


def test_matcher(spark, tmp_path):
    rows = [(f"S1-{i}", f"S2-{j}", int(j == 0), *[float((j == 0) + 0.01 * ((i * 7 + k) % 5)) for k in range(len(FEATURES))]) for i in range(30) for j in range(3)]
    df = pairs(spark, rows, ", label int, " + ", ".join(f"{f} double" for f in FEATURES)).coalesce(1).cache()
    models = matcher.train_ensemble(df, iterations=2, depth=2)
    assert set(matcher.importances(models)) == set(FEATURES)
    assert list(matcher.importances(models).values()) == sorted(matcher.importances(models).values(), reverse=True)
    scored = {(r[0], r[1]): r.probability for r in matcher.score_ensemble(df, models).collect()}
    assert min(p for (_, c), p in scored.items() if c == "S2-0") > max(p for (_, c), p in scored.items() if c != "S2-0")
    matcher.save(models, str(tmp_path / "m"))
    again = {(r[0], r[1]): r.probability for r in matcher.score_ensemble(df, matcher.load(str(tmp_path / "m"))).collect()}
    assert again == pytest.approx(scored)
    folds = df.withColumn("fold", F.when(F.col(S1) == "S1-0", 0).otherwise(F.pmod(F.crc32(F.col(S1).cast("binary")), F.lit(5)).cast("int") + 1))
    oof = {(r[0], r[1]): r.probability for r in matcher.score_out_of_fold(folds, models).collect()}
    assert len(oof) == 90 and all((p == 0.0) == (k[0] == "S1-0") for k, p in oof.items())
    assert matcher.accepted(pairs(spark, [("a", "x", 0.95), ("a", "y", 0.94)], ", probability double"), 0.95).count() == 1


def test_deliverables(spark, tmp_path):
    anchors = spark.createDataFrame([("b", 0), ("a", 1)], f"{S1} string, place int")
    lists = anchors.withColumn("matched_entity_ids", F.when(F.col(S1) == "a", "x").otherwise(""))
    matches, candidates = pairs(spark, [("a", "x")]), pairs(spark, [("a", "y")])
    with pytest.raises(ValueError):
        X.write_deliverable(lists, str(tmp_path / "bad"), "place", matches, candidates)
    assert not (tmp_path / "bad").exists()
    fixed = X.repaired(matches, candidates)
    assert sorted(map(tuple, fixed.collect())) == [("a", "x"), ("a", "y")] and X.violations(matches, fixed).count() == 0
    X.write_deliverable(lists, str(tmp_path / "good"), "place", matches, fixed)
    lines = [x for f in sorted((tmp_path / "good").glob("part-*")) for x in f.read_text().splitlines() if not x.startswith(S1)]
    assert lines == ["b\t", "a\tx"]
    table = pairs(spark, [("a", "x", 1.0), ("a", "x", float("nan")), ("b", "x", None)], ", f double")
    assert X.integrity(table, ["f", "g"]).first().asDict() == {"repeated_pairs": 1, "bad_rows": 2, "missing_features": 1}


def test_files(spark, tmp_path):
    where = str(tmp_path / "metrics.json")
    assert files.read_threshold(spark, where) == 0.95
    (tmp_path / "metrics.json").write_text('{"optimal_threshold": 0.7, "x": 1}')
    assert files.read_threshold(spark, where) == 0.7 and files.read_threshold(spark, where.replace(".json", "2.json"), 0.5) == 0.5
    spark.range(5).write.parquet(str(tmp_path / "test_s2_normalized"))
    assert files.normalised_path(spark, str(tmp_path), "s2").endswith("test_s2_normalized")
    with pytest.raises(FileNotFoundError):
        files.normalised_path(spark, str(tmp_path), "s3")
    copy = files.back_up(spark, str(tmp_path / "test_s2_normalized"))
    spark.range(9).write.mode("overwrite").parquet(str(tmp_path / "test_s2_normalized"))
    assert files.back_up(spark, str(tmp_path / "test_s2_normalized")) == copy and spark.read.parquet(copy).count() == 5
    made = []
    make = lambda: made.append(1) or spark.range(3).toDF("x")
    assert files.cached(spark, str(tmp_path / "c"), make).count() == files.cached(spark, str(tmp_path / "c"), make).count() == 3 and made == [1]
    table = spark.read.parquet(str(tmp_path / "c"))
    assert files.version(table) == files.version(spark.read.parquet(str(tmp_path / "c"))) != files.version(spark.read.parquet(copy))
    adapted = files.adapt_pairs(spark.createDataFrame([("a", "x"), ("a", "x")], "s1_idx string, s2_idx string"))
    assert [tuple(r) for r in adapted.collect()] == [("a", "x", "v3_blocker")]
    assert files.discover(["KINLINE_NO_SUCH_NAME"], [str(tmp_path / "no"), str(tmp_path)]) == str(tmp_path)
    with pytest.raises(FileNotFoundError):
        files.discover([], [str(tmp_path / "no")])
    for form in ("json", "csv"):
        files.write_report(spark.createDataFrame([(1, "a")], "n int, t string"), str(tmp_path / form), form)
        assert spark.read.format(form).option("header", True).load(str(tmp_path / form)).count() == 1
    assert [r[0] for r in files.head(spark.createDataFrame([("c",), ("a",), ("b",)], "entity_id string"), 2).collect()] == ["a", "b"]
    sets = files.truth_sets(pairs(spark, [("a", "y"), ("a", "x"), ("a", "x")]), spark.createDataFrame([("a",), ("b",)], f"{S1} string"))
    assert {r[0]: r[1] for r in sets.collect()} == {"a": ["x", "y"], "b": []}
