"""Evaluation across generations, samples and deliverables: what combines blocking, matching and the truth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinline.operators import diagnostics as D
from kinline.operators import metrics as M
from kinline.operators import submission as X
from kinline.operators.keyed_pass import CAND, S1
from kinline.operators.rules import RULES, rule_counts, rule_matches
from kinline.plans import passes as P
from kinline.queries import sql
from kinline.queries.blocking import V1_MORE, V2_MORE, found_ctes, found_once
from kinline.queries.linkage import _COUNTS, _ID, _MISSED, _PRUNED, _REPORT, CAND_SQL, SCORED, _candidates, _found, _macro_sql, _missed, _q, _rule_tables, _scored, _sweep_sql, _universe
from kinline.queries.registry import query
from kinline.sources.entities import entities, truth
from kinline.sources.files import head, truth_sets

_V1 = found_ctes(P.v1(), P.V1_BITS, sql.v1_keys(), V1_MORE, "one_")
_V2 = found_ctes(P.v2(), P.V2_BITS, sql.v2_keys(), V2_MORE, "two_")


def _generation(ents: DataFrame, name: str, specs, bits, more) -> DataFrame:
    return found_once(ents, name, specs, bits, more).select(S1, CAND).distinct()


@query("e_04_refined_sweep", f"""WITH sw AS ({_sweep_sql(M.FINE, 'zero')}), b AS (SELECT threshold AS best FROM sw WHERE threshold IN ({', '.join(map(str, M.COARSE))}) ORDER BY macro_f05 DESC, threshold LIMIT 1)
SELECT sw.* FROM sw, b WHERE abs(threshold - best) <= {M.REACH} + 1e-9""")
def _e_04_refined(spark, d):
    e = entities(spark, d)
    return M.refined_sweep(_universe(e), _scored(e), truth(e), "zero")


_NAMES = ", ".join(f"({b}, '{n}')" for n, b in P.V3_BITS.items())
_ABLATION = """t AS (SELECT DISTINCT s1, c FROM truth), k AS (SELECT DISTINCT s1, c, b FROM found), h AS (SELECT * FROM k SEMI JOIN t USING (s1, c)), f AS (SELECT b, count(*) AS new_gt FROM (SELECT s1, c, min(b) AS b FROM h GROUP BY s1, c) GROUP BY b)"""


@query("e_08_ablation", f"""WITH {CAND_SQL}, {_ABLATION}, p(b, pass_name) AS (VALUES {_NAMES}),
x AS (SELECT p.b, pass_name, (SELECT count(*) FROM k WHERE k.b = p.b) AS candidates, (SELECT count(*) FROM h WHERE h.b = p.b) AS gt_found, coalesce(new_gt, 0) AS new_gt, CAST(sum(coalesce(new_gt, 0)) OVER (ORDER BY p.b) AS BIGINT) AS cumulative_gt, (SELECT count(*) FROM t) AS total FROM p LEFT JOIN f ON f.b = p.b)
SELECT pass_name, candidates, gt_found, new_gt, cumulative_gt, round(coalesce(new_gt / nullif(total, 0), 0), 6) AS incremental_recall, round(coalesce(cumulative_gt / nullif(total, 0), 0), 6) AS cumulative_recall, round(candidates / nullif(new_gt, 0), 6) AS cand_per_new_gt FROM x""")
def _e_08(spark, d):
    e = entities(spark, d)
    return M.ablation(_found(e), truth(e), P.V3_BITS)


@query("w_11_greedy_passes")
def _w_11(spark, d):
    """Passes that add five truths or more to those of equal names."""
    e = entities(spark, d)
    base = {n: b for n, b in P.V3_BITS.items() if n.startswith("exact")}
    taken = M.greedy_selection(_found(e), truth(e), base, {n: b for n, b in P.V3_BITS.items() if n not in base})
    return spark.createDataFrame([(i, *x) for i, x in enumerate(taken, 1)], "place int, pass_name string, new_truths long")


@_q("e_10_diagnostics", f""", r AS (SELECT s1, c, probability, row_number() OVER (PARTITION BY s1 ORDER BY probability DESC, c) AS rank FROM scored), t AS (SELECT DISTINCT s1, c FROM truth), x AS (SELECT r.* FROM t LEFT JOIN r USING (s1, c)), k AS (SELECT s1, c FROM scored WHERE probability >= 0.6)
SELECT round(avg(CAST(coalesce(rank <= 1, false) AS INTEGER)), 6) AS top1, round(avg(CAST(coalesce(rank <= 3, false) AS INTEGER)), 6) AS top3, round(avg(CAST(coalesce(rank <= 5, false) AS INTEGER)), 6) AS top5, round(avg(CAST(rank <= 1 AS INTEGER)), 6) AS conditional_top1,
round((SELECT count(*) FROM k SEMI JOIN t USING (s1, c)) / (SELECT count(*) FROM k), 6) AS pair_precision FROM x""")
def _e_10_diagnostics(spark, d):
    e = entities(spark, d)
    scored, t = _scored(e), truth(e).distinct()
    rank = F.row_number().over(Window.partitionBy(S1).orderBy(F.desc("probability"), CAND))
    x = scored.select(S1, CAND, "probability", rank.alias("rank")).join(t.withColumn("hit", F.lit(1)), [S1, CAND], "full")
    is_true, kept = F.col("hit").isNotNull(), F.col("probability") >= 0.6
    share = lambda a, b: F.round(F.try_divide(F.count_if(a), F.count_if(b)), 6)
    top = {f"top{k}": share(is_true & (F.col("rank") <= k), is_true) for k in (1, 3, 5)}
    return x.agg(*[c.alias(n) for n, c in top.items()], share(is_true & (F.col("rank") <= 1), is_true & F.col("rank").isNotNull()).alias("conditional_top1"), share(is_true & kept, kept).alias("pair_precision"))


_TWO_COUNTS = """t AS (SELECT s1, count(DISTINCT c) AS n_true FROM truth GROUP BY s1), tt0 AS (SELECT DISTINCT s1, c FROM truth),
{p}b AS (SELECT s1, count(*) AS n_cand, count(tt0.c) AS cand_tp, count(*) FILTER (probability >= 0.6) AS n_pred, count(tt0.c) FILTER (probability >= 0.6) AS tp FROM {scored} LEFT JOIN tt0 USING (s1, c) GROUP BY s1),
{p}counts AS (SELECT u.s1, coalesce(n_true, 0) AS n_true, coalesce(n_cand, 0) AS n_cand, coalesce(cand_tp, 0) AS cand_tp, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp FROM uni u LEFT JOIN t USING (s1) LEFT JOIN {p}b USING (s1))"""
_PCT = lambda a, b: f"round(coalesce(100.0 * {a} / nullif({b}, 0), 0), 6)"


@query("e_13_end_to_end", f"""WITH {SCORED}, {_TWO_COUNTS.format(p='', scored='scored')}, m AS ({_macro_sql('macro')})
SELECT CAST(sum(n_cand) AS BIGINT) AS candidate_count, round(sum(n_cand) / count(*), 6) AS candidates_per_s1, CAST(sum(cand_tp) AS BIGINT) AS blocking_tp, {_PCT('sum(cand_tp)', 'sum(n_true)')} AS blocking_recall, {_PCT('sum(cand_tp)', 'sum(n_cand)')} AS candidate_precision,
{_PCT('count(*) FILTER (n_true > 0 AND cand_tp = n_true)', 'count(*) FILTER (n_true > 0)')} AS complete_s1_pct, {_PCT('count(*) FILTER (n_true > 0 AND cand_tp = 0)', 'count(*) FILTER (n_true > 0)')} AS zero_s1_pct, CAST(sum(n_pred) AS BIGINT) AS predicted_matches, CAST(sum(tp) AS BIGINT) AS matching_tp,
any_value(m.macro_precision) AS macro_precision, any_value(m.macro_recall) AS macro_recall, any_value(m.macro_f05) AS macro_f05, any_value(m.macro_f1) AS macro_f1, {_PCT('sum(tp)', 'sum(n_true)')} AS end_to_end_recall, {_PCT('sum(tp)', 'sum(cand_tp)')} AS conditional_recall, {_PCT('sum(tp)', 'sum(n_pred)')} AS matching_precision,
count(*) FILTER (n_pred = 0) AS s1_singletons, count(*) FILTER (n_pred > 0) AS s1_with_matches FROM counts, m""")
def _e_13(spark, d):
    e = entities(spark, d)
    return M.pair_report(_universe(e), _scored(e), truth(e), 0.6)


def _scored_sql(cand: str, out: str) -> str:
    """``SCORED`` for another table of candidates."""
    part = SCORED[len(CAND_SQL) :]
    return part.replace("looked", f"{out}looked").replace("scored AS", f"{out}scored AS").replace("SELECT cand.*", f"SELECT {cand}.*").replace("FROM cand ", f"FROM {cand} ").split(", uni AS")[0].lstrip(", ")


@query("e_12_conversion", f"""WITH {SCORED}, {_V1}, {_scored_sql('one_cand', 'one_')}, {_TWO_COUNTS.format(p='', scored='scored')}, {_TWO_COUNTS.format(p='one_', scored='one_scored').split('),', 2)[2].strip()},
x AS (SELECT (SELECT 100.0 * sum(cand_tp) / nullif(sum(n_true), 0) FROM counts) AS b3, (SELECT 100.0 * sum(cand_tp) / nullif(sum(n_true), 0) FROM one_counts) AS b1,
  (SELECT macro_recall FROM ({_macro_sql('macro')})) AS m3, (SELECT macro_recall FROM ({_macro_sql('macro').replace('FROM counts', 'FROM one_counts')})) AS m1), y AS (SELECT round(b3, 6) - round(b1, 6) AS db, 100 * (m3 - m1) AS dm FROM x)
SELECT round(db, 6) AS delta_blocking, round(dm, 6) AS delta_matching, round(CASE WHEN db > 0 THEN 100 * dm / db ELSE 0 END, 6) AS conversion_pct FROM y""")
def _e_12(spark, d):
    e = entities(spark, d)
    reports = [M.pair_report(_universe(e), _scored(e, c), truth(e), 0.6) for c in (_generation(e, "b1", P.v1(), P.V1_BITS, V1_MORE), None)]
    return M.conversion(*reports)


_RULE_TABLES = _rule_tables()


@query("r_11_best_rule", f"WITH {sql.ENT}, uni AS (SELECT entity_id AS s1 FROM ent WHERE source = 0) SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{r}' AS rule, x.* FROM (WITH {p}, {_COUNTS.format(pred='rp')} {_REPORT}) x" for r, p in _RULE_TABLES.items()) + ") ORDER BY macro_f05 DESC, rule LIMIT 1")
def _r_11(spark, d):
    e = entities(spark, d)
    reports = [M.rule_report(rule_counts(e.filter("source = 0"), e.filter("source > 0"), cols, truth(e))).withColumn("rule", F.lit(r)) for r, cols in RULES.items()]
    return reduce(DataFrame.unionByName, reports).orderBy(F.desc("macro_f05"), "rule").limit(1)


@_q("r_09_combined_lists", f", {_RULE_TABLES['B']} SELECT u.entity_id AS s1_entity_id, coalesce(string_agg(c, ',' ORDER BY substring(c, 1, 2), c), '') AS ids FROM ent u LEFT JOIN rp ON rp.s1 = u.entity_id WHERE u.source = 0 GROUP BY 1", sql.ENT)
def _r_09(spark, d):
    """Matches of one rule in source 2, then those in source 3."""
    e = entities(spark, d)
    pairs = reduce(DataFrame.unionByName, [rule_matches(e.filter("source = 0"), e.filter(f"source = {s}"), RULES["B"]).withColumn("src", F.lit(s)) for s in (1, 2)])
    return X.id_lists(_universe(e), pairs, [F.col("src"), F.col(CAND).alias("c")], "ids")


@query("j_16_generations", f"""WITH {CAND_SQL}, {_V1}, t AS (SELECT DISTINCT s1, c FROM truth), x AS (SELECT t.s1, t.c, a.s1 IS NOT NULL AS v1, b.s1 IS NOT NULL AS v3 FROM t LEFT JOIN one_cand a ON a.s1 = t.s1 AND a.c = t.c LEFT JOIN cand b ON b.s1 = t.s1 AND b.c = t.c)
SELECT count(*) FILTER (v1 AND v3) AS both, count(*) FILTER (v3 AND NOT v1) AS gained, count(*) FILTER (v1 AND NOT v3) AS lost, count(*) FILTER (NOT v1 AND NOT v3) AS neither FROM x""")
def _j_16(spark, d):
    """Truths that the first and the third generation find."""
    e = entities(spark, d)
    mark = lambda df, n: df.select(S1, CAND, F.lit(True).alias(n))
    x = truth(e).distinct().join(mark(_generation(e, "b1", P.v1(), P.V1_BITS, V1_MORE), "v1"), [S1, CAND], "left").join(mark(_candidates(e), "v3"), [S1, CAND], "left").fillna(False, ["v1", "v3"])
    return x.agg(F.count_if(F.col("v1") & F.col("v3")).alias("both"), F.count_if(F.col("v3") & ~F.col("v1")).alias("gained"), F.count_if(F.col("v1") & ~F.col("v3")).alias("lost"), F.count_if(~F.col("v1") & ~F.col("v3")).alias("neither"))


@query("d_12_newly_recovered", f"WITH {sql.ENT}, {_V1}, {_V2} SELECT s1 AS s1_entity_id, c AS candidate_entity_id FROM (SELECT s1, c FROM two_cand EXCEPT SELECT s1, c FROM one_cand) SEMI JOIN truth USING (s1, c)")
def _d_12(spark, d):
    e = entities(spark, d)
    new = _generation(e, "b2", P.v2(), P.V2_BITS, V2_MORE).subtract(_generation(e, "b1", P.v1(), P.V1_BITS, V1_MORE))
    return new.join(truth(e), [S1, CAND], "left_semi")


@_q("s_01_sorted_candidates", f"SELECT {_ID}, pass_mask FROM cand ORDER BY s1, c", CAND_SQL)
def _s_01(spark, d):
    return _candidates(entities(spark, d)).orderBy(S1, CAND)


@_q("io_03_head", "SELECT entity_id, business_name FROM ent ORDER BY entity_id LIMIT 100", sql.ENT)
def _io_03(spark, d):
    return head(entities(spark, d), 100).select("entity_id", "business_name")


@_q("s_05_sample_limit", "SELECT a.entity_id AS s1_entity_id, b.entity_id AS candidate_entity_id FROM (SELECT * FROM ent WHERE source = 0 ORDER BY entity_id LIMIT 100) a JOIN (SELECT * FROM ent WHERE source = 1 ORDER BY entity_id LIMIT 100) b ON a.name_clean_legal = b.name_clean_legal AND a.name_clean_legal <> ''", sql.ENT)
def _s_05(spark, d):
    """A rule on the first hundred rows of either side."""
    e = entities(spark, d)
    return rule_matches(head(e.filter("source = 0"), 100), head(e.filter("source = 1"), 100), RULES["B"])


@_q("io_07_truth_sets", "SELECT u.entity_id AS s1_entity_id, coalesce(string_agg(DISTINCT c, ',' ORDER BY c), '') AS ids FROM ent u LEFT JOIN truth ON s1 = u.entity_id WHERE source = 0 GROUP BY 1", sql.ENT)
def _io_07(spark, d):
    e = entities(spark, d)
    return truth_sets(truth(e), _universe(e)).select(S1, F.array_join("ids", ",").alias("ids"))


@_q("x_04_repaired_candidates", f", {_PRUNED}, few AS (SELECT s1, c FROM cand WHERE bit_count(pass_mask) >= 2) SELECT s1 AS s1_entity_id, c AS candidate_entity_id FROM few UNION SELECT s1, c FROM pruned")
def _x_04(spark, d):
    """Candidates of two passes or more, with the matches that they lack."""
    e = entities(spark, d)
    kept = X.prune(_scored(e).filter("probability >= 0.3").select(S1, CAND, "probability"))
    return X.repaired(kept, _candidates(e).filter(F.bit_count("pass_mask") >= 2))


@_q("x_07_integrity", "SELECT count(*) - count(DISTINCT (s1, c)) AS repeated_pairs, count(*) FILTER (probability IS NULL) AS bad_rows, CAST(0 AS INTEGER) AS missing_features FROM scored")
def _x_07(spark, d):
    return X.integrity(_scored(entities(spark, d)), ["probability", "pass_mask"])


@_q("d_01_profile", "SELECT source, count(*) AS n, count(*) - count(DISTINCT entity_id) AS repeated_ids, count(*) FILTER (business_name = '') AS no_name, count(*) FILTER (address_norm = '') AS no_address, count(*) FILTER (country = '') AS no_country, count(DISTINCT country) AS countries FROM ent GROUP BY source", sql.ENT)
def _d_01(spark, d):
    empty = lambda c: F.count_if(F.col(c) == "")
    return entities(spark, d).groupBy("source").agg(F.count("*").alias("n"), (F.count("*") - F.countDistinct("entity_id")).alias("repeated_ids"), empty("business_name").alias("no_name"), empty("address_norm").alias("no_address"), empty("country").alias("no_country"), F.countDistinct("country").alias("countries"))


@_q("d_04_raw_signals", """, x AS (SELECT a.business_name = b.business_name AS n, lower(a.business_name) = lower(b.business_name) AS l, a.business_address = b.business_address AS ad, a.country = b.country AS co FROM truth JOIN ent a ON a.entity_id = s1 JOIN ent b ON b.entity_id = c)
SELECT count(*) AS pairs, round(avg(CAST(n AS INTEGER)), 6) AS raw_name, round(avg(CAST(l AS INTEGER)), 6) AS lower_name, round(avg(CAST(ad AS INTEGER)), 6) AS raw_address, round(avg(CAST(co AS INTEGER)), 6) AS raw_country FROM x""", sql.ENT)
def _d_04(spark, d):
    """Equal raw values of true pairs."""
    e = entities(spark, d)
    side = lambda p, key: e.select(F.col("entity_id").alias(key), *[F.col(c).alias(f"{p}_{c}") for c in ("business_name", "business_address", "country")])
    x = truth(e).join(side("l", S1), S1).join(side("r", CAND), CAND)
    same = {"raw_name": F.col("l_business_name") == F.col("r_business_name"), "lower_name": F.lower("l_business_name") == F.lower("r_business_name"), "raw_address": F.col("l_business_address") == F.col("r_business_address"), "raw_country": F.col("l_country") == F.col("r_country")}
    return x.agg(F.count("*").alias("pairs"), *[F.round(F.avg(c.cast("int")), 6).alias(n) for n, c in same.items()])


@_q("d_11_category_samples", """, k AS (SELECT s1, c, CASE WHEN la = '' OR ra = '' THEN 'no address' WHEN la = ra THEN 'same address' ELSE 'other address' END AS category FROM missed), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY s1, c) AS place FROM k)
SELECT category, count(*) AS n, string_agg(s1 || ' ' || c, ', ' ORDER BY s1 || ' ' || c) FILTER (place <= 3) AS examples FROM r GROUP BY category""", _MISSED)
def _d_11(spark, d):
    l, r = F.col("l_address_norm"), F.col("r_address_norm")  # noqa: E741
    return D.category_samples(_missed(spark, d), F.when((l == "") | (r == ""), "no address").when(l == r, "same address").otherwise("other address"))
