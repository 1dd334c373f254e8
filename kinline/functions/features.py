"""The 30 features of a candidate pair. Inputs are columns with prefixes ``l_`` and ``r_``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinline.functions import similarity as S
from kinline.functions.text import tokens

#: Names and order of the features.
FEATURES = [
    "name_norm_exact", "name_clean_exact", "name_jaro_winkler", "name_levenshtein_sim", "name_token_sort_sim", "name_token_set_sim", "name_partial_sim", "name_token_jaccard", "name_token_overlap",
    "name_len_diff", "name_token_count_diff", "name_jw_gap", "name_lev_gap", "name_sort_gap", "name_edit_distance", "addr_exact", "addr_token_jaccard", "addr_token_overlap", "addr_levenshtein_sim",
    "addr_numeric_match", "country_exact", "num_blocking_passes", "name_addr_both_present", "addr_missing_either", "name_in_addr", "common_rare_name_tokens", "name_containment", "name_first_token_match",
    "name_x_addr_sim", "name_x_country",
]


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    return _share(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def native_features(num_passes: Column) -> dict[str, Column]:
    """Those that built-in functions express."""
    same = lambda c: ((F.col(f"l_{c}") == F.col(f"r_{c}")) & (F.col(f"l_{c}") != "")).cast("double")
    ln, rn, la, ra = (F.col(c) for c in ("l_name_norm", "r_name_norm", "l_address_norm", "r_address_norm"))
    s, o, sa, oa = (F.array_distinct(tokens(c)) for c in (ln, rn, la, ra))
    digits = lambda t: F.filter(t, lambda x: x.rlike(r"\d"))
    overlap = lambda a, b: _share(F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b)))
    number = lambda c: c.cast("double")
    both = (ln != "") & (rn != "")
    first = lambda c: F.try_element_at(tokens(c), F.lit(1))
    return {
        "name_norm_exact": same("name_norm"),
        "name_clean_exact": same("name_clean_legal"),
        "name_token_jaccard": jaccard(s, o),
        "name_token_overlap": overlap(s, o),
        "name_len_diff": _share(F.abs(F.length(ln) - F.length(rn)), F.greatest(F.length(ln), F.length(rn))),
        "name_token_count_diff": number(F.least(F.abs(F.size(s) - F.size(o)), F.lit(10))),
        "name_edit_distance": number(F.when(both, F.levenshtein(ln, rn)).otherwise(0)),
        "addr_exact": same("address_norm"),
        "addr_token_jaccard": jaccard(sa, oa),
        "addr_token_overlap": overlap(sa, oa),
        "addr_numeric_match": jaccard(digits(sa), digits(oa)),
        "country_exact": same("country_norm"),
        "num_blocking_passes": number(num_passes),
        "name_addr_both_present": number(both & (la != "") & (ra != "")),
        "addr_missing_either": number((la == "") | (ra == "")),
        "name_in_addr": number(F.size(F.array_intersect(s, oa)) + F.size(F.array_intersect(o, sa))),
        "common_rare_name_tokens": number(F.size(F.filter(F.array_intersect(s, o), lambda t: F.length(t) >= 4))),
        "name_containment": number(both & F.when(F.length(ln) <= F.length(rn), rn.contains(ln)).otherwise(ln.contains(rn))),
        "name_first_token_match": number(F.coalesce(first(ln) == first(rn), F.lit(False))),
    }


def with_features(pairs: DataFrame, num_passes: Column) -> DataFrame:
    out = pairs.withColumns(native_features(num_passes))
    out = out.withColumns(
        {
            "name_jaro_winkler": S.jaro_winkler_col("l_name_norm", "r_name_norm"),
            "name_levenshtein_sim": S.indel_ratio_col("l_name_norm", "r_name_norm"),
            "name_token_sort_sim": S.token_sort_col("l_name_norm", "r_name_norm"),
            "name_token_set_sim": S.token_set_col("l_name_norm", "r_name_norm"),
            "name_partial_sim": S.partial_ratio_col("l_name_norm", "r_name_norm"),
            "addr_levenshtein_sim": S.indel_ratio_col("l_address_norm", "r_address_norm"),
        }
    )
    return out.withColumns(
        {
            "name_jw_gap": 1 - F.col("name_jaro_winkler"),
            "name_lev_gap": 1 - F.col("name_levenshtein_sim"),
            "name_sort_gap": 1 - F.col("name_token_sort_sim"),
            "name_x_addr_sim": F.col("name_token_sort_sim") * F.col("addr_levenshtein_sim"),
            "name_x_country": F.col("name_token_sort_sim") * F.col("country_exact"),
        }
    )


def lookup(pairs: DataFrame, ents: DataFrame) -> DataFrame:
    """Attributes of both records of each pair, empty where a record is missing."""
    cols = ["name_norm", "name_clean_legal", "address_norm", "country_norm"]
    for side, key in (("l", "s1_entity_id"), ("r", "candidate_entity_id")):
        own = ents.select(F.col("entity_id").alias(key), *[F.col(c).alias(f"{side}_{c}") for c in cols])
        pairs = pairs.join(own, key, "left")
    return pairs.fillna("", [f"{s}_{c}" for s in "lr" for c in cols])
