import json

import pytest

from kinline.functions import similarity as S
from kinline.functions.features import FEATURES, with_features
from kinline.operators import metrics as M
from kinline.operators.keyed_pass import CAND, S1, Key, Pass, keyed_pass
from kinline.operators.submission import id_lists, prune, violations
from kinline.sources import files


def pairs(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"{S1} string, {CAND} string{extra}")


def test_similarities():
    assert S.jaro_winkler("ab", "ax") == pytest.approx(2 / 3)
    assert S.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert S.indel_ratio("kitten", "sitting") == pytest.approx(8 / 13)
    assert S.token_sort_ratio("b a", "a b") == 1 and S.token_set_ratio("a b", "a b c") == 1
    assert S.partial_ratio("abc", "xxabcxx") == 1 and S.indel_ratio("", "a") == 0


def test_guard_and_cap(spark):
    from kinline.functions import keys as k

    cols = "entity_id string, name_norm string"
    left = spark.createDataFrame([("S1-1", "x"), ("S1-2", "y"), ("S1-3", "")], cols)
    right = spark.createDataFrame([(f"S2-{i}", "x") for i in range(5)] + [("S2-9", "y"), ("S2-8", "")], cols)
    by_name = lambda df, cap: Pass("p", [Key(lambda: k.equal("name_norm"), lambda: k.equal("name_norm"), df)], cap, by_score=False)
    got = lambda p: sorted((r[0], r[1]) for r in keyed_pass(left, right, p).collect())
    assert got(by_name(4, 9)) == [("S1-2", "S2-9")]
    assert got(by_name(5, 2)) == [("S1-1", "S2-0"), ("S1-1", "S2-1"), ("S1-2", "S2-9")]


def test_features_by_hand(spark):
    """Two words of three shared; nothing shared and no address; equal names of other countries."""
    rows = [
        ("red fox mill", "red fox mill", "9 elm 20", "de", "red fox barn", "red fox barn", "9 oak 20", "de", 3),
        ("abc", "abc", "", "de", "xyzw", "xyzw", "1 q", "", 1),
        ("lark", "lark", "5 lark row", "fr", "lark", "lark", "5 lark row", "it", 2),
    ]
    names = [f"{s}_{c}" for s in "lr" for c in ("name_norm", "name_clean_legal", "address_norm", "country_norm")]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names) + ", passes int")
    got = [r.asDict() for r in with_features(df, df.passes).select(FEATURES).collect()]
    assert len(FEATURES) == 30 and all(v is not None and v == v for r in got for v in r.values())
    # "mill" to "barn" are four replacements; 8 characters are a common subsequence of 12 and 12; the numbers 9 and 20 are shared
    assert got[0] == pytest.approx({
        "name_norm_exact": 0, "name_clean_exact": 0, "name_jaro_winkler": S.jaro_winkler("red fox mill", "red fox barn"), "name_levenshtein_sim": 2 * 8 / 24, "name_token_sort_sim": S.token_sort_ratio("red fox mill", "red fox barn"),
        "name_token_set_sim": 2 * 7 / (7 + 12), "name_partial_sim": S.partial_ratio("red fox mill", "red fox barn"), "name_token_jaccard": 2 / 4, "name_token_overlap": 2 / 3, "name_len_diff": 0, "name_token_count_diff": 0,
        "name_jw_gap": 1 - S.jaro_winkler("red fox mill", "red fox barn"), "name_lev_gap": 1 - 16 / 24, "name_sort_gap": 1 - S.token_sort_ratio("red fox mill", "red fox barn"), "name_edit_distance": 4, "addr_exact": 0,
        "addr_token_jaccard": 2 / 4, "addr_token_overlap": 2 / 3, "addr_levenshtein_sim": 2 * 5 / 16, "addr_numeric_match": 1, "country_exact": 1, "num_blocking_passes": 3, "name_addr_both_present": 1, "addr_missing_either": 0,
        "name_in_addr": 0, "common_rare_name_tokens": 0, "name_containment": 0, "name_first_token_match": 1, "name_x_addr_sim": S.token_sort_ratio("red fox mill", "red fox barn") * 10 / 16, "name_x_country": S.token_sort_ratio("red fox mill", "red fox barn"),
    }, abs=1e-9)
    assert {k for k, v in got[1].items() if v} == {"name_len_diff", "name_jw_gap", "name_lev_gap", "name_sort_gap", "name_edit_distance", "num_blocking_passes", "addr_missing_either"}
    assert (got[1]["name_len_diff"], got[1]["name_edit_distance"]) == (0.25, 4)
    ones = {"name_norm_exact", "name_clean_exact", "addr_exact", "name_containment", "name_first_token_match", "common_rare_name_tokens", "name_x_addr_sim", "name_partial_sim", "name_token_set_sim", "addr_numeric_match"}
    assert all(got[2][k] == 1 for k in ones) and got[2]["country_exact"] == got[2]["name_x_country"] == 0 and got[2]["name_in_addr"] == 2


@pytest.mark.parametrize(("convention", "expected"), [("macro", (0.75, 0.625, 0.25)), ("rule", (0.5, 0.375, 0.25 + 0.25 * 0.0)), ("zero", (0.25, 0.125, 0.0))])
def test_conventions(spark, convention, expected):
    """Neither; predictions only; truth only; one of two truths found."""
    universe = spark.createDataFrame([(x,) for x in "abcd"], f"{S1} string")
    counts = M.entity_counts(universe, pairs(spark, [("b", "1"), ("d", "1")]), pairs(spark, [("c", "1"), ("d", "1"), ("d", "2")]))
    r = M.macro_metrics(counts, convention).first()
    f = 1.25 * 0.5 / (0.25 + 0.5)
    assert (r.macro_precision, r.macro_recall) == pytest.approx(expected[:2], abs=1e-6)
    assert r.macro_f05 == pytest.approx((f + (convention != "zero")) / 4, abs=1e-6)


def test_prune_and_lists(spark):
    m = pairs(spark, [("a", "x", 0.9), ("a", "y", 0.8), ("a", "z", 0.7), ("b", "x", 0.4)], ", probability double")
    kept = prune(m, 0.15, 4)
    assert sorted((r[0], r[1]) for r in kept.select(S1, CAND).collect()) == [("a", "x"), ("a", "y"), ("b", "x")]
    anchors = spark.createDataFrame([("a",), ("b",), ("c",)], f"{S1} string")
    assert {r[0]: r[1] for r in id_lists(anchors, kept, [kept[CAND]], "ids").collect()} == {"a": "x,y", "b": "x", "c": ""}
    assert violations(kept, m).count() == 0


def test_prune_by_source(spark):
    """The margin and the limit hold for each target source: S3 stays beside a better S2, and four of either."""
    m = [("a", "S2-1", 0.9), ("a", "S3-1", 0.6), ("a", "S3-2", 0.5), ("a", "S3-3", 0.4)] + [("b", f"S{s}-{i}", 0.9) for s in (2, 3) for i in range(6)]
    kept = prune(pairs(spark, m, ", probability double"), 0.15, 4)
    assert sorted((r[0], r[1], r["rank"]) for r in kept.collect()) == [("a", "S2-1", 1), ("a", "S3-1", 1), ("a", "S3-2", 2)] + [("b", f"S{s}-{i}", i + 1) for s in (2, 3) for i in range(4)]


def test_unions_have_all_passes_and_sources(spark):
    """Records 3 to 5 differ in letters, 9 and 10 share only numbers of the address; 5 is of source 3."""
    from kinline.plans import passes as P
    from kinline.queries import blocking as B

    rows = [(0, 3, "nightingale harbour supply works", "12 main"), (1, 4, "nightingalle harbor supply works", "13 side"), (2, 5, "nghtingale harbour supply works", "14 hill"), (0, 9, "one two", "4711 0815 v"), (1, 10, "five six", "4711 0815 x")]
    ents = spark.createDataFrame([(s, f"S{s + 1}-{i}", n, n, a, "en") for s, i, n, a in rows], "source int, entity_id string, name_norm string, name_clean_legal string, address_norm string, country_norm string").cache()
    for specs, bits, more in ((P.v1(), P.V1_BITS, B.V1_MORE), (P.v2(), P.V2_BITS, B.V2_MORE), (P.v3(), P.V3_BITS, B.V3_MORE)):
        rows = B.found(ents, specs, bits, more).collect()
        runs = {b: sorted((r[0], r[1]) for r in rows if r.bit == b) for b in {r.bit for r in rows}}
        assert set(runs) <= set(bits.values()) and {p.name for p in specs} | set(more) == set(bits)
        for n in {8: ["address_token"], 256: ["partitioned_tfidf"]}.get(bits.get("address_token", bits.get("partitioned_tfidf")), []):  # joins of a kind once
            assert runs[bits[n]] == ([("S1-9", "S2-10")] if n == "address_token" else [("S1-3", "S2-4"), ("S1-3", "S3-5")]), n


def test_candidates_take_all_passes_and_guard_each_source(spark):
    """210 targets of one name, 105 of each source: over the guard of 200 together, under it apart."""
    from kinline.plans import passes as P
    from kinline.queries import linkage as L

    rows = [(0, "S1-1", "xy")] + [(s, f"S{s + 1}-{i:03d}", "xy") for s in (1, 2) for i in range(105)]
    ents = spark.createDataFrame([(s, i, n, n, "", "") for s, i, n in rows], "source int, entity_id string, name_norm string, name_clean_legal string, address_norm string, country_norm string")
    got = L._found(ents).collect()
    assert {r.bit for r in got} <= set(P.V3_BITS.values())
    assert sorted(r[1] for r in got if r.bit == 2) == [f"S{s}-{i:03d}" for s in (2, 3) for i in range(30)]


def test_name_distances_of_all_scripts(spark):
    """Pairs outside ASCII stay, and letters count, not bytes."""
    from kinline.queries import linkage as L

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    names = [("große straße", "grosse strasse"), ("日本商事", "日本商社"), ("завод", "завот"), ("plain name", "plane name")]
    sides = ", ".join(f"{s}_{c} string" for s in "lr" for c in ("name_norm", "name_clean_legal", "address_norm", "country_norm"))
    looked = spark.createDataFrame([(f"S1-{i}", f"S2-{i}", a, a, "", "", b, b, "", "") for i, (a, b) in enumerate(names)], f"{S1} string, {CAND} string, {sides}")
    assert {r[0]: r.value for r in L._name_edit_distance(looked).collect()} == {f"S1-{i}": distance(a, b) for i, (a, b) in enumerate(names)}
    assert {r[0]: r.value for r in L._name_jaro_winkler(looked).collect()} == pytest.approx({f"S1-{i}": S.jaro_winkler(a, b) for i, (a, b) in enumerate(names)}, abs=1e-6)


def test_files(spark, tmp_path):
    src = tmp_path / "s.tsv"
    src.write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\textra\nS1-1\tNA\t\tIN\tq\n")
    assert tuple(files.read_source(spark, str(src)).first()) == ("S1-1", None, None, "IN")
    assert tuple(files.read_source(spark, str(src), missing_as_empty=True).first()) == ("S1-1", "", "", "IN")
    gt = tmp_path / "t.tsv"
    gt.write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1, S3-1,,S2-1\nS1-2\t\n")
    assert sorted(map(tuple, files.read_truth_pairs(spark, str(gt), "S2-").collect())) == [("S1-1", "S2-1")]
    assert {r[0]: len(r[1]) for r in files.read_truth_lists(spark, str(gt)).collect()} == {"S1-1": 3, "S1-2": 0}
    with pytest.raises(ValueError):
        files.truth_id_column(["x"])
    bench = tmp_path / "b.json"
    bench.write_text(json.dumps({"s1_s2": {"S1-1": ["S2-1", "S2-2"]}, "s3": {"S1-1": ["S3-1"]}, "stats": {}}))
    assert files.read_benchmark(spark, str(bench)).count() == 3


def test_stream_resumes(spark, tmp_path):
    from pyspark.sql import functions as F

    from kinline.streaming.scoring import score_new_files

    where = [str(tmp_path / x) for x in ("in", "out", "cp")]
    for part in ([("a", "x", 0.9), ("b", "y", 0.1)], [("c", "z", 0.8)]):
        pairs(spark, part, ", p double").coalesce(1).write.mode("append").parquet(where[0])
        score_new_files(spark, *where, lambda df: df.withColumn("probability", F.col("p")), 0.5)
    assert sorted(r[0] for r in spark.read.parquet(where[1]).collect()) == ["a", "c"]


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) >= 160
