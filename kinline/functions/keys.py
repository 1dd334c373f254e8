"""Blocking keys: each is an array column of texts for one row; a row without a key has an empty array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinline.functions import wordlists as W
from kinline.functions.text import tokens

NAME, CLEAN, ADDRESS, COUNTRY = "name_norm", "name_clean_legal", "address_norm", "country_norm"


def _if(condition: Column, key: Column) -> Column:
    return F.when(condition, F.array(key)).otherwise(F.array().cast("array<string>"))


def _pairs(a: Column, b: Column, sep: str = "|") -> Column:
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.concat(x, F.lit(sep), y))))


def _first(a: Column, n: int) -> Column:
    return F.slice(a, 1, n)


def phonetic_code(word: Column) -> Column:
    """First letter in upper case, then the classes of the consonants after it, none like the one before; six at most."""
    low = F.lower(word)
    head = F.upper(F.substring(low, 1, 1))

    def step(acc: Column, ch: Column) -> Column:
        code = F.when(F.lit(W.PHONETIC_FROM).contains(ch), F.translate(ch, W.PHONETIC_FROM, W.PHONETIC_TO)).when(ch == "x", F.lit("KS")).otherwise(F.lit(""))
        new = (code != "") & (code != acc["last"])
        return F.struct(F.when(new, F.concat(acc["out"], code)).otherwise(acc["out"]).alias("out"), F.when(new, code).otherwise(acc["last"]).alias("last"))

    rest = F.filter(F.split(F.substring(low, 2, 1_000_000), ""), lambda c: c != "")
    code = F.aggregate(rest, F.struct(head.alias("out"), head.alias("last")), step, lambda acc: F.substring(acc["out"], 1, 6))
    return F.when(F.length(word) >= 2, code).otherwise(F.lit(""))


def equal(col: str) -> Column:
    return _if(F.col(col) != "", F.col(col))


def informative(stop: list[str], least: int = 3) -> Column:
    return F.filter(tokens(CLEAN), lambda t: (F.length(t) >= least) & ~t.isin(stop))


def longest_first(words: Column) -> Column:
    """Stable order by falling length."""
    marked = F.transform(words, lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), t.alias("t")))
    return F.transform(F.array_sort(marked), lambda s: s["t"])


def compact() -> Column:
    return F.regexp_replace(CLEAN, r"\s+", "")


def address_numbers(most: int = 10) -> Column:
    return F.filter(tokens(ADDRESS), lambda t: t.rlike(r"\d") & (F.length(t) <= most))


def address_words(stop: list[str], least: int = 4) -> Column:
    return F.filter(tokens(ADDRESS), lambda t: t.rlike(r"^\p{L}+$") & (F.length(t) >= least) & ~t.isin(stop))


def numeric_tokens(least: int = 2) -> Column:
    return F.filter(tokens(ADDRESS), lambda t: t.rlike(r"\d") & (F.length(t) >= least))


V3_TOKENS = lambda: informative(W.NAME_STOPWORDS_V3)
EVAL_TOKENS = lambda: informative(W.NAME_STOPWORDS_V3_EVAL)


def longest_tokens(n: int) -> Column:
    return _first(longest_first(V3_TOKENS()), n)


def longest_pairs() -> Column:
    t = longest_first(V3_TOKENS())
    pair = lambda i: F.concat(F.least(t[0], t[i]), F.lit("|"), F.greatest(t[0], t[i]))
    return F.when(F.size(t) >= 3, F.array(pair(1), pair(2))).when(F.size(t) == 2, F.array(pair(1))).otherwise(F.array().cast("array<string>"))


def all_pairs(words: Column) -> Column:
    """Pairs of sorted words, every two positions."""
    s = F.array_sort(words)
    return F.flatten(F.transform(s, lambda a, i: F.transform(F.slice(s, i + 2, F.size(s)), lambda b: F.concat(a, F.lit("_"), b))))


def near_pairs(words: Column, reach: int = 3) -> Column:
    s = F.array_sort(words)
    return F.flatten(F.transform(s, lambda a, i: F.transform(F.slice(s, i + 2, F.lit(reach)), lambda b: F.concat(a, F.lit("|"), b))))


def number_and_word(words: int = 2) -> Column:
    return _pairs(_first(address_numbers(), 2), _first(address_words(W.ADDRESS_STOPWORDS_V3), words))


def number_and_word_eval() -> Column:
    return _pairs(_first(numeric_tokens(), 2), _first(address_words(W.ADDRESS_STOPWORDS_V3_EVAL), 3))


def compact_prefix(least: int) -> Column:
    return _if(F.length(compact()) >= least, F.substring(compact(), 1, 8))


def name4_and_number() -> Column:
    return _pairs(_if(F.length(compact()) >= 4, F.substring(compact(), 1, 4)), _first(address_numbers(), 2))


def name4_and_number_eval() -> Column:
    return _pairs(_if(F.length(CLEAN) >= 4, F.substring(CLEAN, 1, 4)), _first(numeric_tokens(), 2))


def phonetic_each(least: int) -> Column:
    return F.filter(F.transform(_first(V3_TOKENS(), 2), phonetic_code), lambda c: (c != "") & (F.length(c) >= least))


def phonetic_joined(words: int = 2) -> Column:
    codes = F.filter(F.transform(_first(tokens(CLEAN), words), phonetic_code), lambda c: c != "")
    return _if(F.size(codes) > 0, F.array_join(codes, "|"))


def postal_and_name3() -> Column:
    postal = F.filter(address_numbers(), lambda t: F.length(t).between(5, 6))
    return _pairs(_first(postal, 2), _if(F.length(compact()) >= 3, F.substring(compact(), 1, 3)))


def consonants() -> Column:
    c = F.regexp_replace(CLEAN, r"[^\p{L}]|[aeiou]", "")
    return _if(F.length(c) >= 4, F.substring(c, 1, 6))


def skeleton_with_head() -> Column:
    x = compact()
    s = F.substring(F.concat(F.substring(x, 1, 1), F.regexp_replace(F.substring(x, 2, 1_000_000), "[aeiou]", "")), 1, 10)
    return _if((F.length(CLEAN) >= 3) & (F.length(s) >= 4), s)


def street_and_longest() -> Column:
    return _pairs(_first(address_words(W.ADDRESS_STOPWORDS_V3), 1), _first(longest_first(V3_TOKENS()), 1))


def distinct_name_tokens(least: int = 3) -> Column:
    return F.array_distinct(F.filter(tokens(NAME), lambda t: F.length(t) >= least))


def sorted_tokens() -> Column:
    t = F.array_sort(tokens(CLEAN))
    return _if((F.size(t) >= 2) & (F.length(CLEAN) >= 4), F.array_join(t, " "))


def prefix(n: int) -> Column:
    return _if(F.length(CLEAN) >= n, F.substring(CLEAN, 1, n))


def country_and_token(stop: list[str], least: int = 4) -> Column:
    words = F.array_distinct(informative(stop, least))
    return F.when(F.col(COUNTRY) != "", F.transform(words, lambda t: F.concat(F.col(COUNTRY), F.lit("|"), t))).otherwise(F.array().cast("array<string>"))


def first_number_and_word() -> Column:
    words = F.filter(tokens(ADDRESS), lambda t: t.rlike(r"^\p{L}+$") & (F.length(t) >= 3))
    return _pairs(_first(numeric_tokens(), 1), _first(words, 1))


def first_informative(stop: list[str]) -> Column:
    return F.filter(_first(informative(stop), 1), lambda t: F.length(t) >= 4)


def last_informative(stop: list[str]) -> Column:
    t = informative(stop)
    return F.when((F.size(t) >= 2) & (F.try_element_at(t, F.lit(-1)) != F.try_element_at(t, F.lit(1))), F.filter(F.slice(t, -1, 1), lambda x: F.length(x) >= 4)).otherwise(F.array().cast("array<string>"))


def first_word() -> Column:
    return _first(tokens(CLEAN), 1)


def last_word() -> Column:
    t = tokens(CLEAN)
    return F.when(F.size(t) >= 2, F.slice(t, -1, 1)).otherwise(F.array().cast("array<string>"))


def token_and_postal() -> Column:
    return _pairs(_first(F.filter(tokens(CLEAN), lambda t: F.length(t) >= 4), 3), _first(numeric_tokens(3), 3))
