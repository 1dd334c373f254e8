"""Scalar functions and key builders over the derived entities: sources, FN, P."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinline.functions import keys as k
from kinline.functions import wordlists as W
from kinline.functions.text import canonical_address, normalise_source, strip_accents, strip_domain, strip_legal_suffix, tokens
from kinline.operators.combine import mask_names
from kinline.operators.diagnostics import char_jaccard, typo_like
from kinline.plans.passes import V1_BITS
from kinline.queries import sql
from kinline.queries.registry import query
from kinline.session import ship_package
from kinline.sources.entities import entities, raw_entities


def _column(name: str, col, expr: str, source=entities, ctes: str = sql.ENT, table: str = "ent") -> None:
    """A query of one computed column by entity; ``col`` is a function, as a column needs a session."""

    @query(name, f"WITH {ctes} SELECT entity_id, {expr} AS value FROM {table}")
    def run(spark, sf_dir):
        return source(spark, sf_dir).select("entity_id", col().alias("value"))


_RAW = {"source": raw_entities, "ctes": sql.RAW, "table": "raw"}
_column("fn_01_strip_accents", lambda: strip_accents("business_name"), "strip_accents(coalesce(business_name, ''))", **_RAW)
_column("fn_02_basic_clean", lambda: F.col("address_norm"), "address_norm")
_column("fn_03_strip_legal_suffix", lambda: strip_legal_suffix("name_norm"), "name_clean_legal")
_column("fn_06_normalize_names", lambda: F.col("name_norm"), "name_norm")
_column("fn_11_numeric_tokens", lambda: F.array_join(k.numeric_tokens(), ","), f"array_to_string({sql.numeric()}, ',')")
_ARRAYS = {
    "fn_09_phonetic_key": (lambda: k.phonetic_joined(), sql.phonetic_joined()),
    "fn_10_phonetic_keys_v3": (lambda: k.phonetic_each(3), sql.phonetic_each(3)),
    "fn_12_address_numbers": (lambda: k.address_numbers(), sql.NUMBERS),
    "fn_12_address_words": (lambda: k.address_words(W.ADDRESS_STOPWORDS_V3), sql.address_words(W.ADDRESS_STOPWORDS_V3)),
    "fn_13_sorted_tokens": (lambda: k.sorted_tokens(), sql.sorted_tokens()),
    "fn_14_prefix": (lambda: k.prefix(6), sql.prefix(6)),
    "fn_15_compact_prefix": (lambda: k.compact_prefix(6), sql.PREFIX8(6)),
    "fn_16_informative_tokens": (lambda: k.longest_first(k.V3_TOKENS()), sql.longest(sql.V3T)),
    "fn_17_token_pairs_prod": (lambda: k.longest_pairs(), sql.longest_pairs()),
    "fn_18_token_pairs_eval": (lambda: k.all_pairs(k._first(k.EVAL_TOKENS(), 4)), sql.combos(sql.first(sql.informative(W.NAME_STOPWORDS_V3_EVAL), 4), "_")),
    "fn_19_token_pairs_bench": (lambda: k.near_pairs(k.V3_TOKENS()), sql.combos(sql.V3T, "|", 3)),
    "fn_20_number_and_word": (lambda: k.number_and_word(), sql.pairs(sql.first(sql.NUMBERS, 2), sql.first(sql.address_words(W.ADDRESS_STOPWORDS_V3), 2))),
    "fn_21_name4_and_number": (lambda: k.name4_and_number(), sql.NAME4(sql.COMPACT, sql.COMPACT, sql.NUMBERS)),
    "fn_22_consonants": (lambda: k.consonants(), sql.consonants()),
    "fn_23_skeleton_with_head": (lambda: k.skeleton_with_head(), sql.skeleton()),
    "fn_24_postal_and_name3": (lambda: k.postal_and_name3(), sql.v3_keys()["postal_prefix"][0][0]),
    "fn_25_street_and_longest": (lambda: k.street_and_longest(), sql.v3_keys()["street_rare_token"][0][0]),
    "fn_26_number_and_alpha": (lambda: k.first_number_and_word(), sql.NUM_ALPHA),
    "fn_27_first_token": (lambda: k.first_informative(W.NAME_STOPWORDS_V2), sql.first_informative(W.NAME_STOPWORDS_V2)),
    "fn_27_last_token": (lambda: k.last_informative(W.NAME_STOPWORDS_V2), sql.last_informative(W.NAME_STOPWORDS_V2)),
    "fn_29_token_and_postal": (lambda: k.token_and_postal(), sql.experimental_keys([], [])["name_token_postal"][0][0]),
    "fn_30_country_and_token": (lambda: k.country_and_token(W.NAME_STOPWORDS_V1), f"list_sort({sql.country_and_token(W.NAME_STOPWORDS_V1)})"),
}
for _name, (_col, _sql) in _ARRAYS.items():
    _join = (lambda c: lambda: F.array_join(F.array_sort(c()), ";"))(_col) if "country" in _name else (lambda c: lambda: F.array_join(c(), ";"))(_col)
    _column(_name, _join, f"array_to_string({_sql}, ';')")
_column("fn_08_phonetic_code", lambda: F.coalesce(k.phonetic_code(F.try_element_at(tokens("name_norm"), F.lit(1))), F.lit("")), f"coalesce({sql.code(f'({sql.tok(sql.N)})[1]')}, '')")
_column("fn_28_first_informative", lambda: F.array_join(k._first(k.informative(["the", "and", "for"]), 1), ""), f"array_to_string({sql.first(sql.informative(['the', 'and', 'for']), 1)}, '')")
_column("fn_32_safe_text", lambda: F.coalesce(F.col("country").cast("string"), F.lit("")), "coalesce(CAST(country AS VARCHAR), '')")
_column("fn_33_initials", lambda: F.array_join(F.transform(tokens("name_norm"), lambda t: F.substring(t, 1, 1)), ""), f"array_to_string(list_transform({sql.tok(sql.N)}, lambda t: substring(t, 1, 1)), '')")
_column("fn_36_prefix_routing", lambda: F.col("entity_id").startswith("S2-").cast("int"), "CAST(starts_with(entity_id, 'S2-') AS INTEGER)", **_RAW)
_column("fn_38_length", lambda: F.length("business_name"), "CAST(length(business_name) AS INTEGER)", **_RAW)


@query("fn_04_strip_domain", r"""SELECT page_id, trim(regexp_replace(trim(regexp_replace(regexp_replace(trim(coalesce(url, '')), '^(?:https?://)?(?:www\.)?', '', 'i'), '[./?=&#]', ' ', 'g')), '\s+(?:com|org|net|co\s+in|in|biz|info)$', '', 'i')) AS value FROM pages""")
def _fn_04(spark, sf_dir):
    """Web addresses, with their signs as spaces before the ending is looked at."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    bare = F.btrim(F.regexp_replace(F.regexp_replace(F.btrim(F.coalesce("url", F.lit(""))), r"(?i)^(?:https?://)?(?:www\.)?", ""), "[./?=&#]", " "))
    return pages.select("page_id", strip_domain(bare).alias("value"))


_MAP = "MAP {" + ", ".join(f"{sql.text(a)}: {sql.text(b)}" for a, b in W.ADDRESS_WORDS.items()) + "}"


@query("fn_05_canonical_address", rf"WITH {sql.ENT} SELECT entity_id, array_to_string(list_transform({sql.tok('address_norm')}, lambda t: regexp_replace(coalesce(({_MAP})[t], t), '^(\d+)(?:st|nd|rd|th)$', '\1')), ' ') AS value FROM ent")
def _fn_05(spark, sf_dir):
    return entities(spark, sf_dir).select("entity_id", canonical_address("address_norm").alias("value"))


@query("fn_07_normalize_source", f"WITH {sql.ENT} SELECT entity_id, name_norm, name_clean_legal, address_norm, country_norm FROM ent")
def _fn_07(spark, sf_dir):
    return normalise_source(raw_entities(spark, sf_dir)).select("entity_id", "name_norm", "name_clean_legal", "address_norm", "country_norm")


@query("fn_31_mask_names", "SELECT o_orderkey, concat_ws('|', " + ", ".join(f"CASE WHEN (o_orderkey % 1024) & {b} <> 0 THEN '{n}' END" for n, b in sorted(V1_BITS.items(), key=lambda x: x[1])) + ") AS value FROM orders")
def _fn_31(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select("o_orderkey", mask_names(F.pmod("o_orderkey", F.lit(1024)).cast("int"), V1_BITS).alias("value"))


_PARTS = "(SELECT p_partkey, p_name, lead(p_name) OVER (ORDER BY p_partkey) AS other FROM part)"


def _name_pairs(spark, sf_dir):
    """Each part with the name of the part whose key is one more; keys are dense."""
    ship_package(spark)
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name")
    return part.join(part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other")), "p_partkey")


@query("fn_34_char_jaccard", f"""SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS value FROM (
  SELECT p_partkey, list_distinct(string_split(replace(p_name, ' ', ''), '')) AS a, list_distinct(string_split(replace(other, ' ', ''), '')) AS b FROM {_PARTS} WHERE other IS NOT NULL)""")
def _fn_34(spark, sf_dir):
    return _name_pairs(spark, sf_dir).select("p_partkey", F.round(char_jaccard("p_name", "other"), 6).alias("value"))


@query("fn_35_typo_like", f"""SELECT p_partkey, CAST(abs(length(a) - length(b)) <= 2 AND len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: substring(a, i, 1) = substring(b, i, 1))) >= greatest(length(a), length(b)) * 0.6 AS INTEGER) AS value
FROM (SELECT p_partkey, string_split(p_name, ' ')[1] AS a, string_split(other, ' ')[1] AS b FROM {_PARTS} WHERE other IS NOT NULL)""")
def _fn_35(spark, sf_dir):
    word = lambda c: F.split(c, " ")[0]
    return _name_pairs(spark, sf_dir).select("p_partkey", typo_like(word("p_name"), word("other")).cast("int").alias("value"))


@query("fn_37_split_explode", "SELECT c_custkey, trim(x) AS value FROM (SELECT c_custkey, unnest(string_split(c_name || ', ' || c_mktsegment || ',,', ',')) AS x FROM customer) WHERE trim(x) <> ''")
def _fn_37(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    listed = F.concat("c_name", F.lit(", "), "c_mktsegment", F.lit(",,"))
    return c.select("c_custkey", F.explode(F.split(listed, ",")).alias("x")).select("c_custkey", F.trim("x").alias("value")).filter("value != ''")
