"""Pieces of the SQL that queries are held against: entities, keys and passes, written for DuckDB."""

from __future__ import annotations

from kinline.functions import wordlists as W
from kinline.operators.keyed_pass import Pass


def text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def texts(xs: list[str]) -> str:
    return "[" + ", ".join(text(x) for x in xs) + "]"


def tok(col: str) -> str:
    return rf"list_filter(string_split_regex({col}, '\s+'), lambda t: t <> '')"


def clean(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(strip_accents(coalesce({x}, ''))), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


_SUFFIX = text(r"\s+(?:" + "|".join(sorted(W.LEGAL_SUFFIXES, key=len, reverse=True)) + r")$")


def suffix_rounds(source: str, col: str = "name_norm") -> str:
    """CTE bodies of three guarded rounds over table ``source``; the last is ``suffix3``."""
    out, prev, cur = [], source, col
    for i in (1, 2, 3):
        new = f"trim(regexp_replace({cur}, {_SUFFIX}, ''))"
        out.append(f"suffix{i} AS (SELECT *, CASE WHEN length({new}) >= 2 THEN {new} ELSE {cur} END AS cut{i} FROM {prev})")
        prev, cur = f"suffix{i}", f"cut{i}"
    return ", ".join(out)


RAW = rf"""
e0 AS (SELECT doc_id, doc_id % 3 AS s, doc_id // 3 AS q, {tok("coalesce(text, '')")} AS tk, n_chars, lang, text FROM documents),
e1 AS (SELECT *, array_to_string(tk[1:4], ' ') AS n0, array_to_string(list_reverse(tk[1:4]), ' ') AS n1 FROM e0),
raw AS (SELECT 'S' || (s + 1) || '-' || doc_id AS entity_id, CAST(s AS INTEGER) AS source,
  CASE WHEN s = 0 THEN n0 WHEN s = 1 THEN n0 || [' ltd', ' pvt ltd', ' inc', ''][q % 4 + 1] WHEN q % 2 = 0 THEN n1 ELSE substring(n0, 1, 5) || substring(n0, 7) END AS business_name,
  coalesce(CAST(n_chars AS VARCHAR), '') || ' ' || array_to_string(tk[5:8], ' ') AS business_address, coalesce(lang, '') AS country,
  substring(regexp_replace(lower(text), '\s+', ' ', 'g'), 1, 120) AS truth_key FROM e1)"""

ENT = f"""{RAW},
norm0 AS (SELECT *, {clean("business_name")} AS name_norm, {clean("business_address")} AS address_norm, {clean("country")} AS country_norm FROM raw),
{suffix_rounds("norm0")},
ent AS (SELECT entity_id, source, business_name, business_address, country, truth_key, name_norm, cut3 AS name_clean_legal, address_norm, country_norm FROM suffix3),
truth AS (SELECT a.entity_id AS s1, b.entity_id AS c FROM ent a JOIN ent b ON a.truth_key = b.truth_key AND a.source = 0 AND b.source > 0)"""

NONE = "CAST([] AS VARCHAR[])"
C, N, A, O = "name_clean_legal", "name_norm", "address_norm", "country_norm"  # noqa: E741


def one(condition: str, key: str) -> str:
    return f"CASE WHEN {condition} THEN [{key}] ELSE {NONE} END"


def pairs(a: str, b: str, sep: str = "|") -> str:
    return f"flatten(list_transform({a}, lambda x: list_transform({b}, lambda y: x || '{sep}' || y)))"


def first(a: str, n: int) -> str:
    return f"({a})[1:{n}]"


def equal(col: str) -> str:
    return one(f"{col} <> ''", col)


def informative(stop: list[str], least: int = 3) -> str:
    return f"list_filter({tok(C)}, lambda w: length(w) >= {least} AND NOT list_contains({texts(stop)}, w))"


def longest(a: str) -> str:
    return f"list_transform(list_sort(list_transform({a}, lambda t, i: {{'n': -length(t), 'i': i, 't': t}})), lambda s: s.t)"


COMPACT = rf"regexp_replace({C}, '\s+', '', 'g')"
NUMBERS = rf"list_filter({tok(A)}, lambda w: regexp_matches(w, '\d') AND length(w) <= 10)"


def numeric(least: int = 2) -> str:
    return rf"list_filter({tok(A)}, lambda w: regexp_matches(w, '\d') AND length(w) >= {least})"


def address_words(stop: list[str], least: int = 4) -> str:
    return rf"list_filter({tok(A)}, lambda w: regexp_matches(w, '^\p{{L}}+$') AND length(w) >= {least} AND NOT list_contains({texts(stop)}, w))"


def code(w: str) -> str:
    m = f"CASE WHEN ch = 'x' THEN 'KS' WHEN contains('{W.PHONETIC_FROM}', ch) THEN translate(ch, '{W.PHONETIC_FROM}', '{W.PHONETIC_TO}') ELSE '' END"
    head = f"CASE WHEN substring(lower({w}), 1, 1) = 'ß' THEN 'SS' ELSE upper(substring(lower({w}), 1, 1)) END"
    step = f"CASE WHEN ({m}) <> '' AND ({m}) <> split_part(acc, '|', 2) THEN split_part(acc, '|', 1) || ({m}) || '|' || ({m}) ELSE acc END"
    chars = f"list_filter(string_split(substring(lower({w}), 2), ''), lambda z: z <> '')"
    return f"CASE WHEN length({w}) >= 2 THEN substring(split_part(list_reduce(list_prepend(({head}) || '|' || ({head}), {chars}), lambda acc, ch: {step}), '|', 1), 1, 6) ELSE '' END"


def phonetic_each(least: int) -> str:
    return f"list_filter(list_transform({first(informative(W.NAME_STOPWORDS_V3), 2)}, lambda pw: {code('pw')}), lambda pc: pc <> '' AND length(pc) >= {least})"


def phonetic_joined(n: int = 2) -> str:
    codes = f"list_filter(list_transform({first(tok(C), n)}, lambda pw: {code('pw')}), lambda pc: pc <> '')"
    return one(f"len({codes}) > 0", f"array_to_string({codes}, '|')")


def longest_pairs() -> str:
    t = longest(informative(W.NAME_STOPWORDS_V3))
    pair = lambda i: f"least(({t})[1], ({t})[{i}]) || '|' || greatest(({t})[1], ({t})[{i}])"
    return f"CASE WHEN len({t}) >= 3 THEN [{pair(2)}, {pair(3)}] WHEN len({t}) = 2 THEN [{pair(2)}] ELSE {NONE} END"


def combos(a: str, sep: str, reach: int | None = None) -> str:
    s = f"list_sort({a})"
    upper = f"len({s})" if reach is None else f"least(len({s}), i + {reach})"
    return f"flatten(list_transform({s}, lambda x, i: list_transform(({s})[i + 1:{upper}], lambda y: x || '{sep}' || y)))"


def consonants() -> str:
    c = rf"regexp_replace({C}, '[^\p{{L}}]|[aeiou]', '', 'g')"
    return one(f"length({c}) >= 4", f"substring({c}, 1, 6)")


def skeleton() -> str:
    s = f"substring(substring({COMPACT}, 1, 1) || regexp_replace(substring({COMPACT}, 2), '[aeiou]', '', 'g'), 1, 10)"
    return one(f"length({C}) >= 3 AND length({s}) >= 4", s)


def sorted_tokens() -> str:
    return one(f"len({tok(C)}) >= 2 AND length({C}) >= 4", f"array_to_string(list_sort({tok(C)}), ' ')")


def prefix(n: int) -> str:
    return one(f"length({C}) >= {n}", f"substring({C}, 1, {n})")


def country_and_token(stop: list[str]) -> str:
    return f"CASE WHEN {O} <> '' THEN list_transform(list_distinct({informative(stop, 4)}), lambda x: {O} || '|' || x) ELSE {NONE} END"


def first_informative(stop: list[str]) -> str:
    return f"list_filter({first(informative(stop), 1)}, lambda v: length(v) >= 4)"


def last_informative(stop: list[str]) -> str:
    t = informative(stop)
    return f"CASE WHEN len({t}) >= 2 AND ({t})[-1] <> ({t})[1] AND length(({t})[-1]) >= 4 THEN [({t})[-1]] ELSE {NONE} END"


NAME_TOKENS = lambda least: f"list_distinct(list_filter({tok(N)}, lambda w: length(w) >= {least}))"
LAST_WORD = f"CASE WHEN len({tok(C)}) >= 2 THEN [({tok(C)})[-1]] ELSE {NONE} END"
NUM_ALPHA = pairs(first(numeric(), 1), first(address_words([], 3), 1))
V3T = informative(W.NAME_STOPWORDS_V3)
NAME4 = lambda whole, x, nums: pairs(one(f"length({whole}) >= 4", f"substring({x}, 1, 4)"), first(nums, 2))
PREFIX8 = lambda least: one(f"length({COMPACT}) >= {least}", f"substring({COMPACT}, 1, 8)")


def pass_ctes(p: Pass, keys: list[tuple[str, str]], name: str = "pass", target: str = "source = 1") -> str:
    """CTEs that end in ``{name}`` (s1, c, score, rank)."""
    d = (lambda x: f"list_distinct({x})") if p.distinct else (lambda x: x)
    ctes, parts = [], []
    for i, (k, (left, right)) in enumerate(zip(p.keys, keys, strict=True)):
        n = f"{name}{i}"
        ctes += [
            f"{n}_l AS (SELECT * FROM (SELECT entity_id AS s1, unnest({d(left)}) AS k FROM ent WHERE source = 0) WHERE k <> '')",
            f"{n}_r AS (SELECT * FROM (SELECT entity_id AS c, unnest({d(right)}) AS k FROM ent WHERE {target}) WHERE k <> '')",
            f"{n}_p AS (SELECT c, k, count(*) OVER (PARTITION BY k) AS df, row_number() OVER (PARTITION BY k ORDER BY c) AS place FROM {n}_r)",
        ]
        parts.append(f"SELECT s1, c, {k.weight} AS w FROM {n}_l JOIN {n}_p USING (k) WHERE df <= {k.max_df}" + (f" AND place <= {k.posting_cap}" if k.posting_cap else ""))
    order = "score DESC, c" if p.by_score else "c"
    ctes += [
        f"{name}_s AS (SELECT s1, c, CAST(sum(w) AS BIGINT) AS score FROM ({' UNION ALL '.join(parts)}) GROUP BY s1, c HAVING sum(w) >= {p.least_score})",
        f"{name} AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY s1 ORDER BY {order}) AS INTEGER) AS rank FROM {name}_s) WHERE rank <= {p.cap})",
    ]
    return ", ".join(ctes)


S2, V3E = W.NAME_STOPWORDS_V2, W.NAME_STOPWORDS_V3_EVAL
_both = lambda x: [(x, x)]


def v3_keys() -> dict[str, list[tuple[str, str]]]:
    street = pairs(first(address_words(W.ADDRESS_STOPWORDS_V3), 1), first(longest(V3T), 1))
    return {
        "exact_name_norm": _both(equal(N)), "exact_clean_legal": _both(equal(C)), "rare_token_ranked": [(first(longest(V3T), 3), first(longest(V3T), 4))],
        "address_num_distinctive_token": _both(pairs(first(NUMBERS, 2), first(address_words(W.ADDRESS_STOPWORDS_V3), 2))), "compact_name_prefix": [(PREFIX8(6), PREFIX8(1))],
        "rare_token_pairs": _both(longest_pairs()), "name_prefix_plus_addr_num": _both(NAME4(COMPACT, COMPACT, NUMBERS)), "phonetic": [(phonetic_each(3), phonetic_each(1))],
        "postal_prefix": _both(pairs(first(f"list_filter({NUMBERS}, lambda v: length(v) BETWEEN 5 AND 6)", 2), one(f"length({COMPACT}) >= 3", f"substring({COMPACT}, 1, 3)"))),
        "consonant_skeleton": _both(consonants()), "street_rare_token": _both(street),
    }


def v2_keys(stop: list[str] = S2) -> dict[str, list[tuple[str, str]]]:
    return {
        "exact_name_norm": _both(equal(N)), "exact_clean_legal": _both(equal(C)), "rare_token_ranked": [(NAME_TOKENS(3), NAME_TOKENS(1))],
        "improved_address": [(NUM_ALPHA, NUM_ALPHA), (numeric(), numeric())], "first_token": [(first_informative(stop), first(tok(C), 1))], "last_token": [(last_informative(stop), LAST_WORD)],
        "sorted_token": _both(sorted_tokens()), "name_prefix": _both(prefix(6)), "country_name_token": _both(country_and_token(stop)), "phonetic": _both(phonetic_joined()),
    }


def v1_keys() -> dict[str, list[tuple[str, str]]]:
    return {
        "exact_name_norm": _both(equal(N)), "exact_clean_legal": _both(equal(C)), "rare_token": _both(NAME_TOKENS(3)), "sorted_token": _both(sorted_tokens()), "name_prefix_6": _both(prefix(6)),
        "country_name_token": _both(country_and_token(W.NAME_STOPWORDS_V1)), "phonetic": _both(phonetic_joined()),
    }


def v3_eval_keys() -> dict[str, list[tuple[str, str]]]:
    e = informative(V3E)
    right = f"list_filter({first(tok(C), 4)}, lambda w: length(w) >= 3 AND NOT list_contains({texts(V3E)}, w))"
    number_word = pairs(first(numeric(), 2), first(address_words(W.ADDRESS_STOPWORDS_V3_EVAL), 3))
    return v2_keys(V3E) | {
        "address_num_distinctive_token": _both(number_word), "compact_name_prefix": _both(PREFIX8(6)), "rare_token_pairs": [(combos(first(e, 4), "_"), combos(right, "_"))],
        "name_prefix_plus_addr_num": _both(NAME4(C, C, numeric())),
    }


def experimental_keys(first_stop: list[str], pair_stop: list[str]) -> dict[str, list[tuple[str, str]]]:
    return {
        "first_info_token": _both(first(informative(first_stop), 1)), "last_info_token": _both(first(f"list_reverse({informative(first_stop)})", 1)), "token_pair": _both(combos(informative(pair_stop), "|", 3)),
        "char_prefix_4": _both(prefix(4)), "name_token_nocountry": _both(f"list_distinct({informative(W.NAME_STOPWORDS_V1, 4)})"), "rare_token_relaxed": _both(NAME_TOKENS(3)),
        "name_token_postal": _both(pairs(first(f"list_filter({tok(C)}, lambda w: length(w) >= 4)", 3), first(numeric(3), 3))), "phonetic_ext": _both(phonetic_joined(3)),
        "consonant_skeleton": _both(skeleton()), "sorted_token_relaxed": _both(sorted_tokens()),
    }
