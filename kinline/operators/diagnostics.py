"""Why true pairs are missed, and how well single signals recover the truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinline.functions.features import jaccard
from kinline.functions.similarity import jaro_winkler_col
from kinline.functions.text import tokens

#: Words that count as legal forms here.
LEGAL_TERMS = ["inc", "corp", "corporation", "limited", "ltd", "llc", "llp", "plc", "gmbh", "ag", "sa", "srl", "spa", "bv", "nv", "pvt", "co", "company", "ab", "as", "oy", "sas", "kk", "pty"]


def _words(col: str) -> Column:
    return F.array_distinct(tokens(col))


def _no_space(col: str) -> Column:
    return F.replace(F.col(col), F.lit(" "), F.lit(""))


def char_jaccard(a: str, b: str) -> Column:
    chars = lambda c: F.array_distinct(F.filter(F.split(_no_space(c), ""), lambda x: x != ""))
    return jaccard(chars(a), chars(b))


def typo_like(a: Column, b: Column) -> Column:
    """Lengths within two, and as many equal places as 60 % of the longer word."""
    chars = lambda x: F.filter(F.split(x, ""), lambda c: c != "")
    same = F.size(F.filter(F.zip_with(chars(a), chars(b), lambda x, y: F.coalesce(x == y, F.lit(False))), lambda e: e))
    return (F.abs(F.length(a) - F.length(b)) <= 2) & (same >= F.greatest(F.length(a), F.length(b)) * 0.6)


def bench_category() -> Column:
    """Category of a missed pair with columns ``l_`` and ``r_``, by shared words first."""
    s, o = _words("l_name_clean_legal"), _words("r_name_clean_legal")
    l, r = F.col("l_name_clean_legal"), F.col("r_name_clean_legal")  # noqa: E741
    jac = jaccard(s, o)
    prefix = (F.length(l) >= 6) & (F.length(r) >= 6) & (F.substring(l, 1, 6) == F.substring(r, 1, 6))
    other_country = (F.col("l_country_norm") != "") & (F.col("r_country_norm") != "") & (F.col("l_country_norm") != F.col("r_country_norm"))
    terms = F.array(*[F.lit(x) for x in LEGAL_TERMS])
    only_s, only_o = F.array_except(F.array_except(s, o), terms), F.array_except(F.array_except(o, s), terms)
    short_word = lambda a: F.exists(a, lambda t: F.length(t) <= 2)
    typo = F.exists(only_s, lambda a: F.exists(only_o, lambda b: typo_like(a, b)))
    none = F.when((F.length(l) <= 4) | (F.length(r) <= 4), "K_SHORT_NAME").when(short_word(s) | short_word(o), "L_ACRONYM").when(char_jaccard("l_name_clean_legal", "r_name_clean_legal") >= 0.3, "E_TRANSLITERATION").otherwise("O_NO_OVERLAP")
    few = F.when(other_country, "J_COUNTRY_VARIATION").when((F.size(F.array_intersect(s, o)) == 1) & (F.size(F.array_union(s, o)) >= 5), "N_MULTI_TOKEN_VARIATION").otherwise("A_NAME_VARIATION")
    many = F.when((F.size(only_s) == 0) & (F.size(only_o) == 0), "B_LEGAL_SUFFIX").when(typo, "D_TYPO_SPELLING").when(other_country, "J_COUNTRY_VARIATION").when((F.col("l_address_norm") == "") | (F.col("r_address_norm") == ""), "G_ADDRESS_MISSING").otherwise("A_NAME_VARIATION")
    return F.when((jac == 0) & ~prefix, none).when((jac > 0) & (jac <= 0.3), few).when((jac > 0.3) & (jac < 1), many).when(jac == 1, "P_FREQ_CAP_ISSUE").otherwise("O_OTHER")


def audit_category() -> Column:
    """Category of a missed pair, by name and address agreement."""
    l, r = F.col("l_name_clean_legal"), F.col("r_name_clean_legal")  # noqa: E741
    s, o, sa, oa = (_words(c) for c in ("l_name_clean_legal", "r_name_clean_legal", "l_address_norm", "r_address_norm"))
    shared, shared_addr = F.size(F.array_intersect(s, o)), F.size(F.array_intersect(sa, oa))
    numbers = F.size(F.filter(F.array_intersect(sa, oa), lambda t: t.rlike(r"\d")))
    near = (jaro_winkler_col(l, r) >= 0.75) | (F.levenshtein(l, r) <= 3)
    initials = lambda c: F.array_join(F.transform(tokens(c), lambda t: F.substring(t, 1, 1)), "")
    acronym = ((initials("l_name_clean_legal") != "") & (initials("l_name_clean_legal") == _no_space("r_name_clean_legal"))) | ((initials("r_name_clean_legal") != "") & (initials("r_name_clean_legal") == _no_space("l_name_clean_legal")))
    apart = F.when((numbers >= 1) | (shared_addr >= 3), "disjoint_name_strong_address").when(near, "name_typo_or_ocr").when(acronym, "acronym_or_abbreviation").when((F.length(l) <= 4) | (F.length(r) <= 4), "short_or_single_token_name").otherwise("extreme_name_divergence")
    subset = (F.size(F.array_except(s, o)) == 0) | (F.size(F.array_except(o, s)) == 0)
    same = (F.size(F.array_except(s, o)) == 0) & (F.size(F.array_except(o, s)) == 0)
    return (
        F.when((F.col("l_name_norm") == F.col("r_name_norm")) | (l == r), "exact_name_capped").when(shared == 0, apart).when(same, "word_order_variation_capped").when(subset, "token_subset_or_expansion")
        .when(shared_addr >= 1, "partial_name_plus_address").otherwise("partial_token_overlap_only")
    )


#: Words that count as legal forms in the investigation.
INVESTIGATION_LEGAL = ["inc", "corp", "corporation", "incorporated", "llc", "ltd", "limited", "pvt", "private", "co", "company", "plc", "llp", "gmbh", "ag", "sa", "srl", "sl"]


def investigation_category() -> Column:
    """Category of a missed pair in the order of the investigation; what no category before takes is ``other``."""
    from kinline.functions.keys import phonetic_code
    from kinline.functions.similarity import indel_ratio_col, partial_ratio_col

    l, r = F.col("l_name_clean_legal"), F.col("r_name_clean_legal")  # noqa: E741
    s, o = _words("l_name_clean_legal"), _words("r_name_clean_legal")
    full = (l != "") & (r != "")
    code = lambda c: phonetic_code(F.try_element_at(tokens(c), F.lit(1)))
    inside = lambda a, b: F.exists(a, lambda t: (F.length(t) <= 4) & F.exists(b, lambda u: u.contains(t) & (F.length(u) > F.length(t) + 2)))
    same = (F.size(s) > 0) & (F.size(F.array_except(s, o)) == 0) & (F.size(F.array_except(o, s)) == 0)
    digits = F.col("l_address_norm").rlike(r"\d") & F.col("r_address_norm").rlike(r"\d")
    a, b = _words("l_name_norm"), _words("r_name_norm")
    legal = F.array(*[F.lit(x) for x in INVESTIGATION_LEGAL])
    only_legal = lambda x, y: F.size(F.array_except(F.array_except(x, y), legal)) == 0
    suffix = (F.col("l_name_norm") != F.col("r_name_norm")) & only_legal(a, b) & only_legal(b, a)
    return (
        F.when(F.col("l_country_norm") != F.col("r_country_norm"), "country mismatch").when(suffix, "legal suffix").when(same & (l != r), "token reorder").when(_no_space("l_name_norm") == _no_space("r_name_norm"), "punctuation")
        .when(inside(s, o) | inside(o, s), "abbreviation").when(full & ((F.levenshtein(l, r) <= 2) | (indel_ratio_col(l, r) >= 0.8)), "spelling variation").when(full & (code("l_name_clean_legal") == code("r_name_clean_legal")), "phonetic miss")
        .when(F.size(F.array_intersect(s, o)) >= 1, "missing name token").when(partial_ratio_col(l, r) >= 0.7, "transliteration").when(digits, "numeric/address variation").when((F.size(F.array_intersect(s, o)) == 0) & (indel_ratio_col(l, r) < 0.4), "common name").otherwise("other")
    )


def category_samples(missed: DataFrame, category: Column, most: int = 3) -> DataFrame:
    """(category, n, examples): the number of missed pairs of each category and the first ``most`` of them by id."""
    named = missed.withColumn("category", category)
    place = F.row_number().over(Window.partitionBy("category").orderBy("s1_entity_id", "candidate_entity_id"))
    few = named.select("category", "s1_entity_id", "candidate_entity_id", place.alias("place")).filter(F.col("place") <= most)
    shown = few.groupBy("category").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "s1_entity_id", "candidate_entity_id"))), ", ").alias("examples"))
    return named.groupBy("category").agg(F.count("*").alias("n")).join(shown, "category")


def recovery_signals(pairs: DataFrame) -> DataFrame:
    """Share of true pairs that each equality recovers; a missing value equals nothing."""
    same = {c: (F.col(f"l_{c}") == F.col(f"r_{c}")) & (F.col(f"l_{c}") != "") for c in ("name_norm", "name_clean_legal", "address_norm", "country_norm")}
    either = same["name_clean_legal"] | same["address_norm"]
    both = same["name_clean_legal"] & same["country_norm"]
    signals = {**same, "name_or_address": either, "name_and_country": both}
    return pairs.agg(F.count("*").alias("pairs"), *[F.round(F.coalesce(F.avg(F.coalesce(x, F.lit(False)).cast("int")), F.lit(0.0)), 6).alias(f"{n}_rate") for n, x in signals.items()])


def exact_overlap(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values of the columns that both sides have."""
    return left.select(columns).intersect(right.select(columns))
