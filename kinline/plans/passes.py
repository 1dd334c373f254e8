"""Blocking passes of the four generations, as declarative specifications."""

from __future__ import annotations

from kinline.functions import keys as k
from kinline.functions import wordlists as W
from kinline.operators.keyed_pass import Key, Pass

# Words that say little, for the experimental passes.
FIRST_STOP = [
    "the", "and", "for", "of", "in", "de", "del", "la", "el", "le", "les", "das", "der", "die", "van", "von", "den", "het", "group", "services", "company", "international", "global", "solutions",
    "management", "systems", "technologies", "consulting", "enterprises", "partners", "associates", "holdings", "industries", "products", "national", "general", "american", "business", "financial", "capital", "investments",
]
PAIR_STOP = ["the", "and", "for", "of", "in", "de", "del", "la", "el", "le", "group", "services", "company", "international", "global", "solutions", "management", "systems", "technologies", "consulting"]

# Bits of the passes.
V3_BITS = {
    "exact_name_norm": 1, "exact_clean_legal": 2, "rare_token_ranked": 4, "address_num_distinctive_token": 8, "compact_name_prefix": 16, "rare_token_pairs": 32,
    "name_prefix_plus_addr_num": 64, "phonetic": 128, "partitioned_tfidf": 256, "postal_prefix": 512, "consonant_skeleton": 1024, "street_rare_token": 2048,
}
V2_BITS = {
    "exact_name_norm": 1, "exact_clean_legal": 2, "rare_token_ranked": 4, "improved_address": 8, "first_token": 16, "last_token": 32, "sorted_token": 64, "name_prefix": 128,
    "country_name_token": 256, "phonetic": 512, "partitioned_tfidf": 1024,
}
V1_BITS = {
    "exact_name_norm": 1, "exact_clean_legal": 2, "rare_token": 4, "address_token": 8, "char_ngram_0.70": 16, "char_ngram_0.50": 32, "sorted_token": 64, "name_prefix_6": 128,
    "country_name_token": 256, "phonetic": 512,
}


def _one(name, left, right, max_df, cap, by_score=True, posting_cap=None, **more) -> Pass:
    return Pass(name, [Key(left, right, max_df, posting_cap)], cap, by_score, **more)


def v3() -> list[Pass]:
    return [
        _one("exact_name_norm", lambda: k.equal(k.NAME), lambda: k.equal(k.NAME), 200, 30, False),
        _one("exact_clean_legal", lambda: k.equal(k.CLEAN), lambda: k.equal(k.CLEAN), 200, 30, False),
        _one("rare_token_ranked", lambda: k.longest_tokens(3), lambda: k.longest_tokens(4), 800, 20),
        _one("address_num_distinctive_token", lambda: k.number_and_word(), lambda: k.number_and_word(), 50, 25),
        _one("compact_name_prefix", lambda: k.compact_prefix(6), lambda: k.compact_prefix(1), 300, 20, False),
        _one("rare_token_pairs", lambda: k.longest_pairs(), lambda: k.longest_pairs(), 50, 20),
        _one("name_prefix_plus_addr_num", lambda: k.name4_and_number(), lambda: k.name4_and_number(), 100, 15),
        _one("phonetic", lambda: k.phonetic_each(3), lambda: k.phonetic_each(1), 400, 15),
        _one("postal_prefix", lambda: k.postal_and_name3(), lambda: k.postal_and_name3(), 25, 15),
        _one("consonant_skeleton", lambda: k.consonants(), lambda: k.consonants(), 150, 15, False),
        _one("street_rare_token", lambda: k.street_and_longest(), lambda: k.street_and_longest(), 30, 15),
    ]


def v2() -> list[Pass]:
    stop = W.NAME_STOPWORDS_V2
    return [
        _one("exact_name_norm", lambda: k.equal(k.NAME), lambda: k.equal(k.NAME), 1000, 50, False, 80),
        _one("exact_clean_legal", lambda: k.equal(k.CLEAN), lambda: k.equal(k.CLEAN), 1000, 50, False, 80),
        _one("rare_token_ranked", lambda: k.distinct_name_tokens(), lambda: k.distinct_name_tokens(1), 500, 40, True, 100),
        Pass("improved_address", [Key(lambda: k.first_number_and_word(), lambda: k.first_number_and_word(), 300, 80, 3), Key(lambda: k.numeric_tokens(), lambda: k.numeric_tokens(), 800, 100, 1)], 30, least_score=2, distinct=True),
        _one("first_token", lambda: k.first_informative(stop), lambda: k.first_word(), 800, 25, False, 100),
        _one("last_token", lambda: k.last_informative(stop), lambda: k.last_word(), 400, 20, False, 100),
        _one("sorted_token", lambda: k.sorted_tokens(), lambda: k.sorted_tokens(), 300, 40, False, 80),
        _one("name_prefix", lambda: k.prefix(6), lambda: k.prefix(6), 150, 25, False, 60),
        _one("country_name_token", lambda: k.country_and_token(stop), lambda: k.country_and_token(stop), 250, 30, True, 80),
        _one("phonetic", lambda: k.phonetic_joined(), lambda: k.phonetic_joined(), 200, 30, False, 60),
    ]


def v1(rare=(500, 30), sort=(500, 50), prefix=(200, 30), country=(300, 40), phonetic=(300, 40)) -> list[Pass]:
    """Ties in the caps go to the smaller id. The pass over address tokens has a rule of its own, see ``operators.rules``."""
    return [
        _one("exact_name_norm", lambda: k.equal(k.NAME), lambda: k.equal(k.NAME), 1000, 50, False),
        _one("exact_clean_legal", lambda: k.equal(k.CLEAN), lambda: k.equal(k.CLEAN), 1000, 50, False),
        _one("rare_token", lambda: k.distinct_name_tokens(), lambda: k.distinct_name_tokens(), rare[0], rare[1], False),
        _one("sorted_token", lambda: k.sorted_tokens(), lambda: k.sorted_tokens(), sort[0], sort[1], False),
        _one("name_prefix_6", lambda: k.prefix(6), lambda: k.prefix(6), prefix[0], prefix[1], False),
        _one("country_name_token", lambda: k.country_and_token(W.NAME_STOPWORDS_V1, 4), lambda: k.country_and_token(W.NAME_STOPWORDS_V1, 4), country[0], country[1], False),
        _one("phonetic", lambda: k.phonetic_joined(), lambda: k.phonetic_joined(), phonetic[0], phonetic[1], False),
    ]


# Guards and caps of the first generation on test tables; its second cosine pass takes 0.45 and 20.
V1_TEST = {"rare": (800, 80), "sort": (500, 50), "prefix": (200, 30), "country": (500, 60), "phonetic": (300, 40)}


def v3_eval() -> list[Pass]:
    stop = W.NAME_STOPWORDS_V3_EVAL
    return [
        _one("exact_name_norm", lambda: k.equal(k.NAME), lambda: k.equal(k.NAME), 1000, 50, False, 80),
        _one("exact_clean_legal", lambda: k.equal(k.CLEAN), lambda: k.equal(k.CLEAN), 1000, 50, False, 80),
        _one("rare_token_ranked", lambda: k.distinct_name_tokens(), lambda: k.distinct_name_tokens(1), 500, 40, True, 100),
        _one("address_num_distinctive_token", lambda: k.number_and_word_eval(), lambda: k.number_and_word_eval(), 300, 35, True, 60, distinct=True),
        _one("compact_name_prefix", lambda: k.compact_prefix(6), lambda: k.compact_prefix(6), 250, 25, False, 60),
        _one("rare_token_pairs", lambda: k.all_pairs(k._first(k.EVAL_TOKENS(), 4)), lambda: k.all_pairs(k.F.filter(k._first(k.tokens(k.CLEAN), 4), lambda t: (k.F.length(t) >= 3) & ~t.isin(stop))), 250, 30, True, 60, distinct=True),
        _one("name_prefix_plus_addr_num", lambda: k.name4_and_number_eval(), lambda: k.name4_and_number_eval(), 150, 25, True, 60, distinct=True),
        _one("first_token", lambda: k.first_informative(stop), lambda: k.first_word(), 800, 20, False, 80),
        _one("last_token", lambda: k.last_informative(stop), lambda: k.last_word(), 400, 15, False, 80),
        _one("sorted_token", lambda: k.sorted_tokens(), lambda: k.sorted_tokens(), 300, 35, False, 80),
        _one("phonetic", lambda: k.phonetic_joined(), lambda: k.phonetic_joined(), 200, 25, False, 60),
        _one("country_name_token", lambda: k.country_and_token(stop), lambda: k.country_and_token(stop), 250, 25, True, 80),
    ]


def experimental() -> list[Pass]:
    last = lambda: k.F.slice(k.F.reverse(k.informative(FIRST_STOP)), 1, 1)
    no_country = lambda: k.F.array_distinct(k.informative(W.NAME_STOPWORDS_V1, 4))
    return [
        _one("first_info_token", lambda: k._first(k.informative(FIRST_STOP), 1), lambda: k._first(k.informative(FIRST_STOP), 1), 300, 50, False),
        _one("last_info_token", lambda: last(), lambda: last(), 300, 50, False),
        _one("token_pair", lambda: k.near_pairs(k.informative(PAIR_STOP)), lambda: k.near_pairs(k.informative(PAIR_STOP)), 100, 60, False),
        _one("char_prefix_4", lambda: k.prefix(4), lambda: k.prefix(4), 500, 40, False),
        _one("name_token_nocountry", lambda: no_country(), lambda: no_country(), 200, 50, False),
        _one("rare_token_relaxed", lambda: k.distinct_name_tokens(), lambda: k.distinct_name_tokens(), 1500, 80),
        _one("name_token_postal", lambda: k.token_and_postal(), lambda: k.token_and_postal(), 200, 40, False),
        _one("phonetic_ext", lambda: k.phonetic_joined(3), lambda: k.phonetic_joined(3), 500, 60, False),
        _one("consonant_skeleton", lambda: k.skeleton_with_head(), lambda: k.skeleton_with_head(), 300, 50, False),
        _one("sorted_token_relaxed", lambda: k.sorted_tokens(), lambda: k.sorted_tokens(), 800, 60, False),
    ]
