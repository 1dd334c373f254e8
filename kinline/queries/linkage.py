"""Joins, aggregates, windows, metrics, submission and diagnostics over candidate pairs of the derived entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinline.functions.features import FEATURES, jaccard, lookup, native_features, with_features
from kinline.functions.similarity import jaro_winkler_col, token_sort_col
from kinline.functions.text import tokens
from kinline.operators import diagnostics as D
from kinline.operators import metrics as M
from kinline.operators import submission as X
from kinline.operators.combine import combine
from kinline.operators.keyed_pass import CAND, S1
from kinline.operators.rules import RULES, rule_counts, rule_matches
from kinline.operators.sampling import fold, hard_negative, in_training, stratified, training_sample
from kinline.plans import passes as P
from kinline.queries import sql
from kinline.queries.blocking import V3_MORE, found, found_ctes, found_once
from kinline.queries.registry import query
from kinline.session import scratch_base
from kinline.sources.entities import entities, truth
from kinline.sources.files import cached, version

EXACT, TOKENS = P.V3_BITS["exact_clean_legal"], P.V3_BITS["rare_token_ranked"]


def _found(ents: DataFrame) -> DataFrame:
    """(s1, candidate, bit) of all passes of the third generation, for each target source; made once for each version of the records' files."""
    return found_once(ents, "b3", P.v3(), P.V3_BITS, V3_MORE)


def _once(ents: DataFrame, name: str, make) -> DataFrame:
    """A table of pairs, made once for each version of the records' files."""
    if not ents.inputFiles():
        return make()
    return cached(ents.sparkSession, f"{scratch_base(ents.sparkSession)}/found-{version(ents)}/{name}", make)


def _candidates(ents: DataFrame) -> DataFrame:
    return combine(_found(ents))


def _exact(ents: DataFrame) -> DataFrame:
    return found(ents, [p for p in P.v3() if p.name == "exact_clean_legal"], P.V3_BITS, {}).select(S1, CAND)


def _scored(ents: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """Candidates (those of the third generation by default) with a probability that both engines agree on: word Jaccard of the legal names."""
    words = lambda c: F.array_distinct(tokens(c))
    return lookup(_candidates(ents) if candidates is None else candidates, ents).withColumn("probability", F.round(jaccard(words("l_name_clean_legal"), words("r_name_clean_legal")), 6))


def _universe(ents: DataFrame) -> DataFrame:
    return ents.filter("source = 0").select(F.col("entity_id").alias(S1))


_W = lambda c: f"list_distinct({sql.tok(c)})"
_JAC = lambda a, b: f"CASE WHEN len(list_distinct(list_concat({a}, {b}))) > 0 THEN len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) ELSE 0 END"
_exact_spec = [p for p in P.v3() if p.name == "exact_clean_legal"]
EXACT_SQL = f"{sql.ENT}, {found_ctes(_exact_spec, P.V3_BITS, sql.v3_keys(), {}).replace('cand AS', 'exact AS')}"
CAND_SQL = f"{sql.ENT}, {found_ctes(P.v3(), P.V3_BITS, sql.v3_keys(), V3_MORE)}"
SCORED = f"""{CAND_SQL}, looked AS (SELECT cand.*, a.name_norm AS ln, b.name_norm AS rn, a.name_clean_legal AS lc, b.name_clean_legal AS rc, a.address_norm AS la, b.address_norm AS ra, a.country_norm AS lo, b.country_norm AS ro
  FROM cand LEFT JOIN ent a ON a.entity_id = s1 LEFT JOIN ent b ON b.entity_id = c),
scored AS (SELECT s1, c, pass_mask, round({_JAC(_W("lc"), _W("rc"))}, 6) AS probability FROM looked), uni AS (SELECT entity_id AS s1 FROM ent WHERE source = 0)"""
_ID = "s1 AS s1_entity_id, c AS candidate_entity_id"


def _q(name: str, body: str, base: str = SCORED):
    """``body`` may begin with a comma and more common tables."""
    return query(name, f"WITH {base}{body}" if body.startswith(",") else f"WITH {base} {body}")


# ------------------------------------------------------------------ projections, joins, sets


@_q("p_01_non_empty_key", "SELECT entity_id, name_clean_legal FROM ent WHERE name_clean_legal <> ''", sql.ENT)
def _p_01(spark, d):
    return entities(spark, d).filter("name_clean_legal != ''").select("entity_id", "name_clean_legal")


@_q("p_03_valid_keys", "SELECT entity_id FROM ent WHERE source = 1 AND name_clean_legal IN (SELECT name_clean_legal FROM ent WHERE source = 0)", sql.ENT)
def _p_03(spark, d):
    e = entities(spark, d)
    return e.filter("source = 1").join(e.filter("source = 0").select("name_clean_legal"), "name_clean_legal", "left_semi").select("entity_id")


@_q("p_05_threshold", f"SELECT {_ID}, probability FROM scored WHERE probability >= 0.5")
def _p_05(spark, d):
    return _scored(entities(spark, d)).filter("probability >= 0.5").select(S1, CAND, "probability")


# DuckDB's distances count bytes. Names are in lower case, so capital letters can stand for the letters beyond ASCII that
# European names keep after normalisation; then bytes are letters. Fixed values.
_BEYOND, _STANDIN = "ßæœøłđðþıħŋŧ", "ABCDEFGHIJKL"
_ONE_BYTE = lambda c: f"translate({c}, '{_BEYOND}', '{_STANDIN}')"
_SORTED = lambda c: _ONE_BYTE(f"array_to_string(list_sort({sql.tok(c)}), ' ')")
_JW = f"CASE WHEN ln = '' OR rn = '' THEN 0 ELSE jaro_winkler_similarity({_ONE_BYTE('ln')}, {_ONE_BYTE('rn')}) END"


def _common_sql(a: str, b: str) -> str:
    """Longest common subsequence, with a row of the table as the bits of a number."""
    full = f"((CAST(1 AS HUGEINT) << length({a})) - 1)"
    where = f"list_transform(string_split({b}, ''), lambda ch: list_sum(list_transform(range(1, length({a}) + 1), lambda i: CASE WHEN substring({a}, i, 1) = ch THEN CAST(1 AS HUGEINT) << CAST(i - 1 AS INTEGER) ELSE CAST(0 AS HUGEINT) END))::HUGEINT)"
    row = f"list_reduce(list_prepend({full}, {where}), lambda row, hit: ((row + (row & hit)) | (row - (row & hit))) & {full})"
    return f"length({a}) - bit_count({row})"


_SORT_SIM = "CASE WHEN ln = '' OR rn = '' THEN 0 ELSE 2 * lcs / (length(ls) + length(rs)) END"
SIMS = f"sorted0 AS (SELECT s1, c, ln, rn, {_SORTED('ln')} AS ls, {_SORTED('rn')} AS rs FROM looked), sims AS (SELECT s1, c, round({_JW}, 9) AS jw, round({_SORT_SIM}, 9) AS sort_sim FROM (SELECT *, {_common_sql('ls', 'rs')} AS lcs FROM sorted0))"
_HARD = "sort_sim >= 0.50 OR jw >= 0.70 OR bit_count(pass_mask) >= 2"


def _with_sims(pairs: DataFrame) -> DataFrame:
    """Pairs with what the hard-negative predicate looks at; rounded, so that sums of thirds are equal at its bounds in any engine."""
    return pairs.withColumns({"name_token_sort_sim": F.round(token_sort_col("l_name_norm", "r_name_norm"), 9), "name_jaro_winkler": F.round(jaro_winkler_col("l_name_norm", "r_name_norm"), 9), "num_passes": F.bit_count("pass_mask")})


@_q("p_06_hard_negative", f", {SIMS} SELECT {_ID} FROM scored JOIN sims USING (s1, c) WHERE {_HARD}")
def _p_06(spark, d):
    return _with_sims(_scored(entities(spark, d))).filter(hard_negative()).select(S1, CAND)


@_q("p_07_name_or_address", f"SELECT {_ID} FROM looked WHERE (lc = rc AND lc <> '') OR (la = ra AND la <> '')")
def _p_07(spark, d):
    e = entities(spark, d)
    return lookup(_candidates(e), e).filter("(l_name_clean_legal = r_name_clean_legal and l_name_clean_legal != '') or (l_address_norm = r_address_norm and l_address_norm != '')").select(S1, CAND)


@_q("j_02_rule_lists", "SELECT a.entity_id AS s1_entity_id, coalesce(string_agg(b.entity_id, ',' ORDER BY b.entity_id), '') AS ids FROM ent a LEFT JOIN ent b ON a.name_clean_legal = b.name_clean_legal AND a.country_norm = b.country_norm AND b.source > 0 AND a.name_clean_legal <> '' AND a.country_norm <> '' WHERE a.source = 0 GROUP BY a.entity_id", sql.ENT)
def _j_02(spark, d):
    e = entities(spark, d)
    return X.id_lists(_universe(e), rule_matches(e.filter("source = 0"), e.filter("source > 0"), RULES["E"]), [F.col(CAND)], "ids")


@_q("j_04_recovered_truth", "SELECT s1 AS s1_entity_id, c AS candidate_entity_id FROM cand JOIN truth USING (s1, c)", CAND_SQL)
def _j_04(spark, d):
    e = entities(spark, d)
    return _candidates(e).join(truth(e), [S1, CAND]).select(S1, CAND)


@_q("j_05_attribute_lookup", f"SELECT {_ID}, ln AS l_name_norm, rn AS r_name_norm, la AS l_address_norm, ra AS r_address_norm FROM looked")
def _j_05(spark, d):
    e = entities(spark, d)
    return lookup(_candidates(e), e).select(S1, CAND, "l_name_norm", "r_name_norm", "l_address_norm", "r_address_norm")


@_q("j_08_pairs_of_selected", f"SELECT {_ID} FROM cand WHERE s1 IN (SELECT entity_id FROM ent WHERE source = 0 AND country_norm = 'de')", CAND_SQL)
def _j_08(spark, d):
    e = entities(spark, d)
    return _candidates(e).join(e.filter("source = 0 and country_norm = 'de'").select(F.col("entity_id").alias(S1)), S1, "left_semi").select(S1, CAND)


@_q("j_09_needed_targets", "SELECT entity_id, name_norm FROM ent WHERE entity_id IN (SELECT c FROM truth)", sql.ENT)
def _j_09(spark, d):
    e = entities(spark, d)
    return e.join(truth(e).select(F.col(CAND).alias("entity_id")), "entity_id", "left_semi").select("entity_id", "name_norm")


@_q("j_10_containment", "SELECT count(*) AS pairs, count(*) FILTER (s1 IN (SELECT entity_id FROM ent) AND c IN (SELECT entity_id FROM ent)) AS contained FROM truth", sql.ENT)
def _j_10(spark, d):
    e = entities(spark, d)
    t = truth(e)
    ids = e.select("entity_id", F.lit(1).alias("hit"))
    both = t.join(ids.toDF(S1, "h1"), S1, "left").join(ids.toDF(CAND, "h2"), CAND, "left")
    return both.agg(F.count("*").alias("pairs"), F.count_if(F.col("h1").isNotNull() & F.col("h2").isNotNull()).alias("contained"))


@_q("j_11_missed_truth", "SELECT s1 AS s1_entity_id, c AS candidate_entity_id FROM truth ANTI JOIN exact USING (s1, c)", EXACT_SQL)
def _j_11(spark, d):
    e = entities(spark, d)
    return truth(e).join(_exact(e), [S1, CAND], "left_anti").select(S1, CAND)


@_q("j_12_labels", f"SELECT {_ID}, CAST((s1, c) IN (SELECT (s1, c) FROM truth) AS INTEGER) AS label FROM cand", CAND_SQL)
def _j_12(spark, d):
    e = entities(spark, d)
    return _candidates(e).join(truth(e).distinct().withColumn("hit", F.lit(1)), [S1, CAND], "left").select(S1, CAND, F.coalesce("hit", F.lit(0)).alias("label"))


_COUNTS = """hits AS (SELECT s1, count(*) AS n_pred, count(*) FILTER ((s1, c) IN (SELECT (s1, c) FROM truth)) AS tp FROM {pred} GROUP BY s1), tt AS (SELECT s1, count(DISTINCT c) AS n_true FROM truth GROUP BY s1),
counts AS (SELECT u.s1, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp, coalesce(n_true, 0) AS n_true FROM uni u LEFT JOIN hits USING (s1) LEFT JOIN tt USING (s1))"""


@query("j_13_outer_alignment", f"WITH {SCORED}, {_COUNTS.format(pred='cand')} SELECT s1 AS s1_entity_id, n_pred, tp, n_true FROM counts")
def _j_13(spark, d):
    e = entities(spark, d)
    return M.entity_counts(_universe(e), _candidates(e), truth(e)).select(S1, "n_pred", "tp", "n_true")


@_q("u_04_recovered_by_tokens_only", f"SELECT s1 AS s1_entity_id, c AS candidate_entity_id FROM (SELECT s1, c FROM found WHERE b = {TOKENS} EXCEPT SELECT s1, c FROM found WHERE b = {EXACT}) SEMI JOIN truth USING (s1, c)", CAND_SQL)
def _u_04(spark, d):
    e = entities(spark, d)
    rows = found(e, [p for p in P.v3() if P.V3_BITS[p.name] in (EXACT, TOKENS)], P.V3_BITS, {})
    by_bit = {b: rows.filter(F.col("bit") == b).select(S1, CAND) for b in (EXACT, TOKENS)}
    return by_bit[TOKENS].subtract(by_bit[EXACT]).join(truth(e), [S1, CAND], "left_semi")


@_q("u_05_subset_violations", "SELECT count(*) AS violations FROM (SELECT * FROM scored WHERE probability >= 0.5) ANTI JOIN cand USING (s1, c)")
def _u_05(spark, d):
    e = entities(spark, d)
    return X.violations(_scored(e).filter("probability >= 0.5"), _candidates(e)).agg(F.count("*").alias("violations"))


@_q("u_06_exact_overlap", "SELECT 'name' AS kind, count(*) AS shared FROM (SELECT business_name FROM raw WHERE source = 0 INTERSECT SELECT business_name FROM raw WHERE source > 0) UNION ALL SELECT 'address', count(*) FROM (SELECT business_address FROM raw WHERE source = 0 INTERSECT SELECT business_address FROM raw WHERE source > 0) UNION ALL SELECT 'both', count(*) FROM (SELECT business_name, business_address FROM raw WHERE source = 0 INTERSECT SELECT business_name, business_address FROM raw WHERE source > 0)", sql.RAW)
def _u_06(spark, d):
    e = entities(spark, d)
    a, b = e.filter("source = 0"), e.filter("source > 0")
    parts = [D.exact_overlap(a, b, cols).agg(F.count("*").alias("shared")).select(F.lit(n).alias("kind"), "shared") for n, cols in (("name", ["business_name"]), ("address", ["business_address"]), ("both", ["business_name", "business_address"]))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ------------------------------------------------------------------ aggregates


@_q("a_01_key_frequency", "SELECT name_clean_legal AS k, count(*) AS df FROM ent WHERE source = 1 AND name_clean_legal <> '' GROUP BY 1", sql.ENT)
def _a_01(spark, d):
    return entities(spark, d).filter("source = 1 and name_clean_legal != ''").groupBy(F.col("name_clean_legal").alias("k")).agg(F.count("*").alias("df"))


@_q("a_02_token_frequency", f"SELECT k, count(*) AS df FROM (SELECT unnest({_W('name_norm')}) AS k FROM ent WHERE source = 1) GROUP BY k", sql.ENT)
def _a_02(spark, d):
    return entities(spark, d).filter("source = 1").select(F.explode(F.array_distinct(tokens("name_norm"))).alias("k")).groupBy("k").agg(F.count("*").alias("df"))


@_q("a_06_ids_by_key", "SELECT name_clean_legal AS k, string_agg(entity_id, ',' ORDER BY entity_id) AS ids FROM ent WHERE source = 1 AND name_clean_legal <> '' GROUP BY 1", sql.ENT)
def _a_06(spark, d):
    return entities(spark, d).filter("source = 1 and name_clean_legal != ''").groupBy(F.col("name_clean_legal").alias("k")).agg(F.array_join(F.array_sort(F.collect_list("entity_id")), ",").alias("ids"))


@_q("a_07_collisions", "SELECT name_clean_legal AS k, count(DISTINCT name_norm) AS n FROM ent GROUP BY 1 HAVING count(DISTINCT name_norm) > 1", sql.ENT)
def _a_07(spark, d):
    return entities(spark, d).groupBy(F.col("name_clean_legal").alias("k")).agg(F.countDistinct("name_norm").alias("n")).filter("n > 1")


@_q("a_08_value_counts", "SELECT country, source, count(*) AS n FROM raw GROUP BY 1, 2", sql.RAW)
def _a_08(spark, d):
    return entities(spark, d).groupBy("country", "source").agg(F.count("*").alias("n"))


@_q("a_09_length_stats", "SELECT source, min(length(business_name)) AS lo, round(avg(length(business_name)), 6) AS mean, median(length(business_name)) AS median, max(length(business_name)) AS hi, round(stddev_samp(length(business_name)), 6) AS sd FROM raw GROUP BY source", sql.RAW)
def _a_09(spark, d):
    n = F.length("business_name")
    return entities(spark, d).groupBy("source").agg(F.min(n).cast("long").alias("lo"), F.round(F.avg(n), 6).alias("mean"), F.percentile(n, F.lit(0.5)).alias("median"), F.max(n).cast("long").alias("hi"), F.round(F.stddev_samp(n), 6).alias("sd"))


@_q("a_10_duplicates", "SELECT source, count(*) - count(DISTINCT business_name) AS repeated FROM raw GROUP BY source", sql.RAW)
def _a_10(spark, d):
    return entities(spark, d).groupBy("source").agg((F.count("*") - F.countDistinct("business_name")).alias("repeated"))


@_q("a_12_mean_by_group", "SELECT country_norm, round(avg(probability), 6) AS mean, count(*) AS n FROM scored JOIN ent ON entity_id = s1 GROUP BY 1")
def _a_12(spark, d):
    return _scored(entities(spark, d)).groupBy(F.col("l_country_norm").alias("country_norm")).agg(F.round(F.avg("probability"), 6).alias("mean"), F.count("*").alias("n"))


@_q("a_16_most_common", "SELECT name_clean_legal AS k, count(*) AS n FROM ent WHERE source > 0 GROUP BY 1 ORDER BY n DESC, k LIMIT 10", sql.ENT)
def _a_16(spark, d):
    return entities(spark, d).filter("source > 0").groupBy(F.col("name_clean_legal").alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "k").limit(10)


@_q("a_17_mean_and_spread", "SELECT round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS sd FROM (SELECT country_norm, avg(probability) AS m FROM scored JOIN ent ON entity_id = s1 GROUP BY 1)")
def _a_17(spark, d):
    by = _scored(entities(spark, d)).groupBy("l_country_norm").agg(F.avg("probability").alias("m"))
    return by.agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.stddev_pop("m"), 6).alias("sd"))


# ------------------------------------------------------------------ windows, top-k


@_q("w_06_ranks", f"SELECT {_ID}, CAST(row_number() OVER (PARTITION BY s1 ORDER BY probability DESC, c) AS INTEGER) AS rank FROM scored QUALIFY rank <= 5")
def _w_06(spark, d):
    rank = F.row_number().over(Window.partitionBy(S1).orderBy(F.desc("probability"), CAND)).cast("int")
    return _scored(entities(spark, d)).select(S1, CAND, rank.alias("rank")).filter("rank <= 5")


# each target source by itself; its name is what an id has before its first hyphen
_PRUNED = "pruned AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY s1, split_part(c, '-', 1) ORDER BY probability DESC, c) AS INTEGER) AS rank FROM (SELECT *, round(max(probability) OVER (PARTITION BY s1, split_part(c, '-', 1)) - probability, 9) AS gap FROM scored WHERE probability >= 0.3) WHERE gap <= 0.15) WHERE rank <= 4)"


@_q("w_07_top_margin", f", {_PRUNED} SELECT {_ID}, probability, rank FROM pruned")
def _w_07(spark, d):
    return X.prune(_scored(entities(spark, d)).filter("probability >= 0.3").select(S1, CAND, "probability"))


_BY_BIT = " ".join(f"WHEN {b} THEN '{n}'" for n, b in P.V3_BITS.items())


@query("w_09_incremental_recall", f"""WITH {CAND_SQL}, f AS (SELECT s1, c, min(b) AS b FROM found SEMI JOIN truth USING (s1, c) GROUP BY s1, c), n AS (SELECT b, count(*) AS pairs FROM found GROUP BY b)
SELECT n.b AS pass_order, CASE n.b {_BY_BIT} END AS pass_name, pairs, coalesce(k, 0) AS new_truths, CAST(sum(coalesce(k, 0)) OVER (ORDER BY n.b) AS BIGINT) AS found_so_far
FROM n LEFT JOIN (SELECT b, count(*) AS k FROM f GROUP BY b) x ON n.b = x.b""")
def _w_09(spark, d):
    e = entities(spark, d)
    return M.incremental_recall(_found(e).withColumnRenamed("bit", "pass_order"), truth(e), P.V3_BITS)


@_q("w_10_stratified_sample", """, z AS (SELECT country_norm, count(*) AS n FROM ent WHERE source = 0 GROUP BY 1), q0 AS (SELECT country_norm, CAST(floor(n * 100 / sum(n) OVER ()) AS BIGINT) AS q FROM z
), q AS (SELECT country_norm, CASE WHEN country_norm = max(country_norm) OVER () THEN 100 - sum(q) OVER () + q ELSE q END AS quota FROM q0)
SELECT entity_id, country_norm FROM (SELECT e.*, quota, row_number() OVER (PARTITION BY e.country_norm ORDER BY md5(entity_id), entity_id) AS place FROM ent e JOIN q ON e.country_norm = q.country_norm WHERE source = 0) WHERE place <= quota""", sql.ENT)
def _w_10(spark, d):
    return stratified(entities(spark, d).filter("source = 0").select("entity_id", "country_norm"), "country_norm", "entity_id", 100)


# ------------------------------------------------------------------ features, samples

_NATIVE = [n for n in FEATURES if n in ("name_norm_exact", "name_clean_exact", "name_token_jaccard", "name_token_overlap", "name_len_diff", "name_token_count_diff", "addr_exact", "addr_token_jaccard", "addr_token_overlap", "addr_numeric_match", "country_exact", "num_blocking_passes", "name_addr_both_present", "addr_missing_either", "name_in_addr", "common_rare_name_tokens", "name_containment", "name_first_token_match")]
_S, _O, _SA, _OA = _W("ln"), _W("rn"), _W("la"), _W("ra")
_DIG = lambda a: rf"list_filter({a}, lambda t: regexp_matches(t, '\d'))"
_OVER = lambda a, b: f"CASE WHEN least(len({a}), len({b})) > 0 THEN len(list_intersect({a}, {b})) / least(len({a}), len({b})) ELSE 0 END"
_FEATURE_SQL = {
    "name_norm_exact": "CAST(ln = rn AND ln <> '' AS INTEGER)", "name_clean_exact": "CAST(lc = rc AND lc <> '' AS INTEGER)", "name_token_jaccard": _JAC(_S, _O), "name_token_overlap": _OVER(_S, _O),
    "name_len_diff": "CASE WHEN greatest(length(ln), length(rn)) > 0 THEN abs(length(ln) - length(rn)) / greatest(length(ln), length(rn)) ELSE 0 END", "name_token_count_diff": f"least(abs(CAST(len({_S}) AS BIGINT) - CAST(len({_O}) AS BIGINT)), 10)",
    "addr_exact": "CAST(la = ra AND la <> '' AS INTEGER)", "addr_token_jaccard": _JAC(_SA, _OA), "addr_token_overlap": _OVER(_SA, _OA), "addr_numeric_match": _JAC(_DIG(_SA), _DIG(_OA)), "country_exact": "CAST(lo = ro AND lo <> '' AS INTEGER)",
    "num_blocking_passes": "bit_count(pass_mask)", "name_addr_both_present": "CAST(ln <> '' AND rn <> '' AND la <> '' AND ra <> '' AS INTEGER)", "addr_missing_either": "CAST(la = '' OR ra = '' AS INTEGER)",
    "name_in_addr": f"len(list_intersect({_S}, {_OA})) + len(list_intersect({_O}, {_SA}))", "common_rare_name_tokens": f"len(list_filter(list_intersect({_S}, {_O}), lambda t: length(t) >= 4))",
    "name_containment": "CAST(ln <> '' AND rn <> '' AND CASE WHEN length(ln) <= length(rn) THEN contains(rn, ln) ELSE contains(ln, rn) END AS INTEGER)", "name_first_token_match": f"CAST(coalesce(({sql.tok('ln')})[1] = ({sql.tok('rn')})[1], false) AS INTEGER)",
}


@_q("f_native_features", f"SELECT {_ID}, " + ", ".join(f"CAST(round({_FEATURE_SQL[n]}, 6) AS DOUBLE) AS {n}" for n in _NATIVE) + " FROM looked")
def _f_native(spark, d):
    e = entities(spark, d)
    cols = native_features(F.bit_count("pass_mask"))
    return lookup(_candidates(e), e).select(S1, CAND, *[F.round(cols[n], 6).alias(n) for n in _NATIVE])


@_q("f_02_jaro_winkler", f"SELECT {_ID}, round({_JW}, 6) AS value FROM looked")
def _f_02(spark, d):
    e = entities(spark, d)
    return _name_jaro_winkler(lookup(_candidates(e), e))


def _name_jaro_winkler(x: DataFrame) -> DataFrame:
    return x.select(S1, CAND, F.round(jaro_winkler_col("l_name_norm", "r_name_norm"), 6).alias("value"))


@_q("f_14_edit_distance", f"SELECT {_ID}, CAST(CASE WHEN ln = '' OR rn = '' THEN 0 ELSE levenshtein({_ONE_BYTE('ln')}, {_ONE_BYTE('rn')}) END AS BIGINT) AS value FROM looked")
def _f_14(spark, d):
    e = entities(spark, d)
    return _name_edit_distance(lookup(_candidates(e), e))


def _name_edit_distance(x: DataFrame) -> DataFrame:
    return x.select(S1, CAND, native_features(F.lit(0))["name_edit_distance"].cast("long").alias("value"))


@query("f_all_features")
def _f_all(spark, d):
    e = entities(spark, d)
    return with_features(lookup(_candidates(e), e), F.bit_count("pass_mask")).select(S1, CAND, *FEATURES)


@_q("m_03_training_sample", f""", {SIMS}, lab AS (SELECT s1, c, CAST((s1, c) IN (SELECT (s1, c) FROM truth) AS INTEGER) AS label, {_HARD} AS hard FROM scored JOIN sims USING (s1, c)
), k AS (SELECT *, CASE WHEN label = 1 THEN 'positive' WHEN hard THEN 'hard' ELSE 'easy' END AS kind FROM lab), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY md5(s1 || '|' || c), s1, c) AS place, sum(label) OVER () AS np FROM k)
SELECT {_ID}, label, kind FROM r WHERE kind = 'positive' OR (kind = 'hard' AND place <= 3 * np) OR (kind = 'easy' AND place <= np)""")
def _m_03(spark, d):
    e = entities(spark, d)

    def labelled() -> DataFrame:
        x = _with_sims(_scored(e)).select(S1, CAND, hard_negative().alias("hard"))
        return x.join(truth(e).distinct().withColumn("hit", F.lit(1)), [S1, CAND], "left").select(S1, CAND, F.coalesce("hit", F.lit(0)).alias("label"), "hard")

    # the sample reads the pairs three times; similarities are taken once, and their shuffles go before it shuffles any pair
    return training_sample(_once(e, "labelled", labelled)).select(S1, CAND, "label", "kind")


@query("m_05_folds")
def _m_05(spark, d):
    return _universe(entities(spark, d)).select(S1, fold(S1).alias("fold"), in_training(S1).alias("training"))


@query("m_13_ensemble")
def _m_13(spark, d):
    """Five models of boosted trees on the sampled pairs, and their mean over all candidates."""
    from kinline.operators.matcher import score_ensemble, train_ensemble

    e = entities(spark, d)
    rows = with_features(lookup(_candidates(e), e), F.bit_count("pass_mask")).join(truth(e).distinct().withColumn("hit", F.lit(1)), [S1, CAND], "left").withColumn("label", F.coalesce("hit", F.lit(0)))
    rows = rows.withColumn("hard", hard_negative(passes="num_blocking_passes"))
    return score_ensemble(rows.select(S1, CAND, *FEATURES), train_ensemble(training_sample(rows).cache()))


# ------------------------------------------------------------------ rules and metrics

_REPORT = """SELECT count(*) AS s1_entities, count(*) FILTER (n_pred > 0) AS coverage_count, round(100.0 * count(*) FILTER (n_pred > 0) / count(*), 6) AS coverage_pct, count(*) FILTER (n_pred > 1) AS ambiguous_count,
round(100.0 * count(*) FILTER (n_pred > 1) / count(*), 6) AS ambiguous_pct_total, round(coalesce(100.0 * count(*) FILTER (n_pred > 1) / nullif(count(*) FILTER (n_pred > 0), 0), 0), 6) AS ambiguous_pct_matched, max(n_pred) AS max_candidates,
round(coalesce(sum(n_pred) / nullif(count(*) FILTER (n_pred > 0), 0), 0), 6) AS mean_candidates_matched, round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(avg(f), 6) AS macro_f05,
round(coalesce(avg(p) FILTER (n_true > 0), 0), 6) AS pos_macro_precision, round(coalesce(avg(r) FILTER (n_true > 0), 0), 6) AS pos_macro_recall, round(coalesce(avg(f) FILTER (n_true > 0), 0), 6) AS pos_macro_f05,
count(*) FILTER (n_true = 0) AS singleton_count, count(*) FILTER (n_true = 0 AND n_pred > 0) AS singleton_fp_count, round(coalesce(count(*) FILTER (n_true = 0 AND n_pred > 0) / nullif(count(*) FILTER (n_true = 0), 0), 0), 6) AS singleton_fp_rate,
count(*) FILTER (tp = n_true AND tp = n_pred) AS exact_match_count, count(*) FILTER (n_true > 1) AS multi_match_truth_count, count(*) FILTER (n_true > 1 AND tp > 0 AND NOT (tp = n_true AND tp = n_pred)) AS partially_correct_multi,
count(*) FILTER (n_true > 1 AND tp = n_true AND tp = n_pred) AS completely_correct_multi FROM
(SELECT *, CASE WHEN n_pred = 0 AND n_true = 0 THEN 1.0 WHEN n_pred = 0 OR n_true = 0 THEN 0 ELSE tp / n_pred END AS p, CASE WHEN n_pred = 0 AND n_true = 0 THEN 1.0 WHEN n_pred = 0 OR n_true = 0 THEN 0 ELSE tp / n_true END AS r,
  CASE WHEN n_pred = 0 AND n_true = 0 THEN 1.0 WHEN tp = 0 THEN 0 ELSE 1.25 * (tp / n_pred) * (tp / n_true) / (0.25 * tp / n_pred + tp / n_true) END AS f FROM counts)"""
_UNI = "uni AS (SELECT entity_id AS s1 FROM ent WHERE source = 0)"


def _rule_tables() -> dict[str, str]:
    """A common table ``rp`` (s1, c) of each rule's matches."""
    same = lambda cols: " AND ".join(f"a.{c} = b.{c} AND a.{c} <> ''" for c in cols)
    return {r: f"rp AS (SELECT a.entity_id AS s1, b.entity_id AS c FROM ent a JOIN ent b ON {same(cols)} WHERE a.source = 0 AND b.source > 0)" for r, cols in RULES.items()}


for _i, (_rule, _cols) in enumerate(RULES.items(), 1):
    _pred = _rule_tables()[_rule]

    @query(f"r_{_i:02d}_rule_{_rule.lower()}", f"WITH {sql.ENT}, {_UNI}, {_pred}, {_COUNTS.format(pred='rp')} {_REPORT}")
    def _rule_report(spark, d, cols=_cols):
        e = entities(spark, d)
        return M.rule_report(rule_counts(e.filter("source = 0"), e.filter("source > 0"), cols, truth(e)))


@_q("r_10_ambiguous_keys", "SELECT name_clean_legal AS k, count(*) AS targets FROM ent WHERE source > 0 AND name_clean_legal <> '' AND name_clean_legal IN (SELECT name_clean_legal FROM ent WHERE source = 0) GROUP BY 1 HAVING count(*) > 1 ORDER BY targets DESC, k LIMIT 10", sql.ENT)
def _r_10(spark, d):
    e = entities(spark, d)
    known = e.filter("source = 0").select("name_clean_legal")
    n = e.filter("source > 0 and name_clean_legal != ''").join(known, "name_clean_legal", "left_semi").groupBy(F.col("name_clean_legal").alias("k")).agg(F.count("*").alias("targets"))
    return n.filter("targets > 1").orderBy(F.desc("targets"), "k").limit(10)


def _case(convention: str, i: int, value: str) -> str:
    a, b, c = (x[i] for x in M.EMPTY[convention])
    return f"CASE WHEN n_pred = 0 AND n_true = 0 THEN {a}.0 WHEN n_true = 0 THEN {b}.0 WHEN n_pred = 0 THEN {c}.0 ELSE {value} END"


def _macro_sql(convention: str, by: str = "") -> str:
    f = lambda beta: f"CASE WHEN tp = 0 THEN 0 ELSE (1 + {beta}) * (tp / n_pred) * (tp / n_true) / ({beta} * tp / n_pred + tp / n_true) END"
    cols = {"precision": (0, "tp / n_pred"), "recall": (1, "tp / n_true"), "f05": (2, f("0.25")), "f1": (2, f("1.0"))}
    return f"SELECT {by}" + ", ".join(f"round(avg({_case(convention, i, v)}), 6) AS macro_{n}" for n, (i, v) in cols.items()) + ", CAST(sum(n_pred) AS BIGINT) AS predicted_pairs, count(*) AS entities FROM counts"


_KEPT = "kept AS (SELECT * FROM scored WHERE probability >= 0.6)"
for _name, _conv in (("e_01_macro_metrics", "macro"), ("e_01_rule_metrics", "rule"), ("e_01_zero_metrics", "zero")):

    @query(_name, f"WITH {SCORED}, {_KEPT}, {_COUNTS.format(pred='kept')} {_macro_sql(_conv)}")
    def _e_01(spark, d, conv=_conv):
        e = entities(spark, d)
        return M.macro_metrics(M.entity_counts(_universe(e), _scored(e).filter("probability >= 0.6"), truth(e)), conv)


_GRID = [round(0.05 * i, 2) for i in range(1, 20)]


def _sweep_sql(grid: list[float], convention: str, truth_table: str = "truth") -> str:
    ts = ", ".join(f"({t})" for t in grid)
    return f"""WITH {SCORED}, g AS (SELECT CAST(t AS DOUBLE) AS threshold FROM (VALUES {ts}) v(t)), tr AS ({'SELECT * FROM truth' if truth_table == 'truth' else 'SELECT truth.* FROM truth SEMI JOIN cand USING (s1, c)'}),
h AS (SELECT threshold, s1, count(*) AS n_pred, count(*) FILTER ((s1, c) IN (SELECT (s1, c) FROM tr)) AS tp FROM scored JOIN g ON probability >= threshold GROUP BY 1, 2), tt AS (SELECT s1, count(DISTINCT c) AS n_true FROM tr GROUP BY s1),
counts AS (SELECT g.threshold, u.s1, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp, coalesce(n_true, 0) AS n_true FROM g CROSS JOIN uni u LEFT JOIN h ON h.threshold = g.threshold AND h.s1 = u.s1 LEFT JOIN tt ON tt.s1 = u.s1)
{_macro_sql(convention, 'threshold, ')} GROUP BY threshold"""


for _name, _grid, _conv, _only in (("e_02_threshold_sweep", _GRID, "macro", False), ("e_04_coarse_sweep", [round(0.5 + 0.05 * i, 2) for i in range(10)], "zero", False), ("e_09_conditional_sweep", _GRID, "macro", True), ("e_14_sampled_sweep", [round(0.30 + 0.05 * i, 2) for i in range(14)] + [0.98], "macro", True)):

    @query(_name, _sweep_sql(_grid, _conv, "recovered" if _only else "truth"))
    def _sweep(spark, d, grid=_grid, conv=_conv, only=_only):
        e = entities(spark, d)
        t = truth(e).join(_candidates(e), [S1, CAND], "left_semi") if only else truth(e)
        return M.sweep(_universe(e), _scored(e), t, grid, conv)


@query("s_04_best_threshold", f"SELECT * FROM ({_sweep_sql(_GRID, 'macro')}) ORDER BY macro_f05 DESC, threshold LIMIT 1")
def _s_04(spark, d):
    e = entities(spark, d)
    return M.best_threshold(M.sweep(_universe(e), _scored(e), truth(e), _GRID))


@query("e_05_blocking_report", f"""WITH {SCORED}, {_COUNTS.format(pred='cand')} SELECT CAST(sum(n_pred) AS BIGINT) AS total_candidates, CAST(sum(tp) AS BIGINT) AS tp_recovered, CAST(sum(n_true) AS BIGINT) AS true_pairs, round(coalesce(sum(tp) / nullif(sum(n_true), 0), 0), 6) AS candidate_recall, round(sum(n_pred) / count(*), 6) AS mean_candidates,
round(coalesce(count(*) FILTER (n_true > 0 AND tp = n_true) / nullif(count(*) FILTER (n_true > 0), 0), 0), 6) AS complete_coverage, round(coalesce(count(*) FILTER (n_true > 0 AND tp = 0) / nullif(count(*) FILTER (n_true > 0), 0), 0), 6) AS zero_coverage,
round(1 - sum(n_pred) / (count(*) * (SELECT count(*) FROM ent WHERE source > 0)), 6) AS reduction_ratio FROM counts""")
def _e_05(spark, d):
    e = entities(spark, d)
    return M.blocking_report(_universe(e), _candidates(e), truth(e), e.filter("source > 0").agg(F.count("*").alias("n2")))


_MODE = "CASE WHEN probability IS NULL THEN 'not_blocked' WHEN top > probability THEN 'out_ranked' WHEN probability < 0.6 THEN 'below_threshold' ELSE 'accepted' END"


@_q("e_11_failure_modes", f", tp AS (SELECT s1, max(probability) AS top FROM scored GROUP BY s1) SELECT truth.s1 AS s1_entity_id, truth.c AS candidate_entity_id, {_MODE} AS mode FROM truth LEFT JOIN scored USING (s1, c) LEFT JOIN tp ON tp.s1 = truth.s1")
def _e_11(spark, d):
    e = entities(spark, d)
    return M.failure_modes(_scored(e), truth(e), 0.6)


@_q("e_10_top_k_recall", ", r AS (SELECT s1, c, row_number() OVER (PARTITION BY s1 ORDER BY probability DESC, c) AS rank FROM scored) SELECT k, round(count(*) FILTER (rank <= k) / count(*), 6) AS recall FROM truth LEFT JOIN r USING (s1, c) CROSS JOIN (VALUES (1), (3), (5)) v(k) GROUP BY k")
def _e_10(spark, d):
    e = entities(spark, d)
    rank = F.row_number().over(Window.partitionBy(S1).orderBy(F.desc("probability"), CAND))
    x = truth(e).join(_scored(e).select(S1, CAND, rank.alias("rank")), [S1, CAND], "left").select("rank", F.explode(F.array(F.lit(1), F.lit(3), F.lit(5))).alias("k"))
    return x.groupBy("k").agg(F.round(F.avg(F.coalesce(F.col("rank") <= F.col("k"), F.lit(False)).cast("int")), 6).alias("recall"))


@_q("e_15_pair_counts", f", {_KEPT} SELECT count(*) FILTER (k.c IS NOT NULL AND t.c IS NOT NULL) AS tp, count(*) FILTER (k.c IS NOT NULL AND t.c IS NULL) AS fp, count(*) FILTER (k.c IS NULL) AS fn FROM kept k FULL JOIN (SELECT DISTINCT * FROM truth) t ON k.s1 = t.s1 AND k.c = t.c")
def _e_15(spark, d):
    e = entities(spark, d)
    p = _scored(e).filter("probability >= 0.6").select(S1, CAND, F.lit(1).alias("p"))
    both = p.join(truth(e).distinct().withColumn("t", F.lit(1)), [S1, CAND], "full")
    return both.agg(F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))


# ------------------------------------------------------------------ submission


@_q("x_03_matching_results", f", {_PRUNED}, o AS (SELECT s1, string_agg(c, ',' ORDER BY substring(c, 1, 2), -probability, c) AS ids FROM pruned GROUP BY s1) SELECT s1 AS s1_entity_id, coalesce(ids, '') AS matched_entity_ids FROM uni LEFT JOIN o USING (s1)")
def _x_03(spark, d):
    e = entities(spark, d)
    kept = X.prune(_scored(e).filter("probability >= 0.3").select(S1, CAND, "probability"))
    return X.id_lists(_universe(e), kept, [F.substring(CAND, 1, 2).alias("src"), (-F.col("probability")).alias("p"), F.col(CAND).alias("c")], "matched_entity_ids")


@_q("x_03_candidate_lists", "SELECT uni.s1 AS s1_entity_id, coalesce(string_agg(c, ',' ORDER BY c), '') AS candidate_entity_ids FROM uni LEFT JOIN cand USING (s1) GROUP BY uni.s1")
def _x_03c(spark, d):
    e = entities(spark, d)
    return X.id_lists(_universe(e), _candidates(e), [F.col(CAND).alias("c")], "candidate_entity_ids")


@_q("x_05_distribution", f", {_PRUNED}, n AS (SELECT uni.s1, count(c) AS n, count(DISTINCT substring(c, 1, 2)) AS srcs FROM uni LEFT JOIN pruned USING (s1) GROUP BY uni.s1) SELECT count(*) FILTER (n = 0) AS singletons, count(*) FILTER (n = 1) AS single, count(*) FILTER (n > 1) AS multi, count(*) FILTER (srcs = 2) AS both_sources FROM n")
def _x_05(spark, d):
    e = entities(spark, d)
    kept = X.prune(_scored(e).filter("probability >= 0.3").select(S1, CAND, "probability"))
    n = _universe(e).join(kept.groupBy(S1).agg(F.count("*").alias("n"), F.countDistinct(F.substring(CAND, 1, 2)).alias("srcs")), S1, "left").fillna(0)
    return n.agg(F.count_if(F.col("n") == 0).alias("singletons"), F.count_if(F.col("n") == 1).alias("single"), F.count_if(F.col("n") > 1).alias("multi"), F.count_if(F.col("srcs") == 2).alias("both_sources"))


# ------------------------------------------------------------------ diagnostics


@_q("d_02_truth_counts", ", k AS (SELECT e.entity_id, count(DISTINCT c) FILTER (c LIKE 'S2-%') AS s2, count(DISTINCT c) FILTER (c LIKE 'S3-%') AS s3 FROM ent e LEFT JOIN truth ON s1 = e.entity_id WHERE source = 0 GROUP BY 1) SELECT s2, s3, count(*) AS entities FROM k GROUP BY 1, 2", sql.ENT)
def _d_02(spark, d):
    e = entities(spark, d)
    n = truth(e).distinct().groupBy(S1).agg(F.count_if(F.col(CAND).startswith("S2-")).alias("s2"), F.count_if(F.col(CAND).startswith("S3-")).alias("s3"))
    return _universe(e).join(n, S1, "left").fillna(0).groupBy("s2", "s3").agg(F.count("*").alias("entities"))


@_q("d_07_exact_recovery", """, x AS (SELECT a.name_norm = b.name_norm AND a.name_norm <> '' AS n, a.name_clean_legal = b.name_clean_legal AND a.name_clean_legal <> '' AS l, a.address_norm = b.address_norm AND a.address_norm <> '' AS ad, a.country_norm = b.country_norm AND a.country_norm <> '' AS co
FROM truth JOIN ent a ON a.entity_id = s1 JOIN ent b ON b.entity_id = c) SELECT count(*) AS pairs, round(avg(CAST(n AS INTEGER)), 6) AS name_norm_rate, round(avg(CAST(l AS INTEGER)), 6) AS name_clean_legal_rate, round(avg(CAST(ad AS INTEGER)), 6) AS address_norm_rate,
round(avg(CAST(co AS INTEGER)), 6) AS country_norm_rate, round(avg(CAST(l OR ad AS INTEGER)), 6) AS name_or_address_rate, round(avg(CAST(l AND co AS INTEGER)), 6) AS name_and_country_rate FROM x""", sql.ENT)
def _d_07(spark, d):
    e = entities(spark, d)
    return D.recovery_signals(lookup(truth(e), e))


_LEGAL = sql.texts(D.LEGAL_TERMS)
_EXC = lambda a, b: f"list_filter({a}, lambda t: NOT list_contains({b}, t) AND NOT list_contains({_LEGAL}, t))"
_LS, _LO = _W("lc"), _W("rc")
_CHARS = lambda c: f"list_distinct(list_filter(string_split(replace({c}, ' ', ''), ''), lambda z: z <> ''))"
_TYPO = f"len(list_filter({_EXC(_LS, _LO)}, lambda a: len(list_filter({_EXC(_LO, _LS)}, lambda b: abs(length(a) - length(b)) <= 2 AND len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: substring(a, i, 1) = substring(b, i, 1))) >= greatest(length(a), length(b)) * 0.6)) > 0)) > 0"
_OTHER = "lo <> '' AND ro <> '' AND lo <> ro"
_MISSED = f"{EXACT_SQL}, missed AS (SELECT t.s1, t.c, a.name_norm AS ln, b.name_norm AS rn, a.name_clean_legal AS lc, b.name_clean_legal AS rc, a.address_norm AS la, b.address_norm AS ra, a.country_norm AS lo, b.country_norm AS ro FROM truth t JOIN ent a ON a.entity_id = s1 JOIN ent b ON b.entity_id = c ANTI JOIN exact ON exact.s1 = t.s1 AND exact.c = t.c)"


@_q("d_08_bench_categories", f""", j AS (SELECT *, {_JAC(_LS, _LO)} AS jac FROM missed), k AS (SELECT CASE
WHEN jac = 0 AND NOT (length(lc) >= 6 AND length(rc) >= 6 AND substring(lc, 1, 6) = substring(rc, 1, 6)) THEN CASE WHEN length(lc) <= 4 OR length(rc) <= 4 THEN 'K_SHORT_NAME' WHEN len(list_filter(list_concat({_LS}, {_LO}), lambda t: length(t) <= 2)) > 0 THEN 'L_ACRONYM' WHEN {_JAC(_CHARS('lc'), _CHARS('rc'))} >= 0.3 THEN 'E_TRANSLITERATION' ELSE 'O_NO_OVERLAP' END
WHEN jac > 0 AND jac <= 0.3 THEN CASE WHEN {_OTHER} THEN 'J_COUNTRY_VARIATION' WHEN len(list_intersect({_LS}, {_LO})) = 1 AND len(list_distinct(list_concat({_LS}, {_LO}))) >= 5 THEN 'N_MULTI_TOKEN_VARIATION' ELSE 'A_NAME_VARIATION' END
WHEN jac > 0.3 AND jac < 1 THEN CASE WHEN len({_EXC(_LS, _LO)}) = 0 AND len({_EXC(_LO, _LS)}) = 0 THEN 'B_LEGAL_SUFFIX' WHEN {_TYPO} THEN 'D_TYPO_SPELLING' WHEN {_OTHER} THEN 'J_COUNTRY_VARIATION' WHEN la = '' OR ra = '' THEN 'G_ADDRESS_MISSING' ELSE 'A_NAME_VARIATION' END
WHEN jac = 1 THEN 'P_FREQ_CAP_ISSUE' ELSE 'O_OTHER' END AS category FROM j) SELECT category, count(*) AS n FROM k GROUP BY 1""", _MISSED)
def _d_08(spark, d):
    return _missed(spark, d).groupBy(D.bench_category().alias("category")).agg(F.count("*").alias("n"))


def _missed(spark, d):
    """Truths that equal legal names don't find."""
    e = entities(spark, d)
    return lookup(truth(e).join(_exact(e), [S1, CAND], "left_anti"), e)


@query("d_09_audit_categories")
def _d_09(spark, d):
    return _missed(spark, d).groupBy(D.audit_category().alias("category")).agg(F.count("*").alias("n"))


@query("d_10_investigation_categories")
def _d_10(spark, d):
    return _missed(spark, d).groupBy(D.investigation_category().alias("category")).agg(F.count("*").alias("n"))
