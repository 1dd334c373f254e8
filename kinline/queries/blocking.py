"""Blocking passes of all generations between source 1 and the target sources, and their unions."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinline.operators.combine import combine, mask_names
from kinline.operators.keyed_pass import CAND, S1, Pass, keyed_passes
from kinline.operators.rules import address_tokens_v1
from kinline.operators.similarity import char_grams, tfidf_join, word_terms
from kinline.plans import passes as P
from kinline.queries import sql
from kinline.queries.registry import ORACLES, QUERIES
from kinline.session import scratch_base
from kinline.sources.entities import entities
from kinline.sources.files import cached, version

OUT = "SELECT s1 AS s1_entity_id, c AS candidate_entity_id, score, rank FROM pass"
TARGETS = ("source = 1", "source = 2")
TWICE = {1: "", 2: "z"}  # names of the common tables of either target source


def _sides(ents: DataFrame) -> tuple[DataFrame, DataFrame]:
    return ents.filter("source = 0"), ents.filter("source > 0")


def _by_source(one: Callable[[DataFrame, DataFrame], DataFrame], left: DataFrame, right: DataFrame) -> DataFrame:
    """What a join gives for each target source by itself."""
    return reduce(DataFrame.unionByName, [one(left, right.filter(f"source = {s}")) for s in (1, 2)])


def _register(name: str, p: Pass, keys: list[tuple[str, str]]) -> None:
    QUERIES[name] = lambda spark, sf_dir: keyed_passes(*_sides(entities(spark, sf_dir)), [p]).select(S1, CAND, "score", "rank")
    ctes = ", ".join(sql.pass_ctes(p, keys, f"pass{s}", f"source = {s}") for s in (1, 2))
    ORACLES[name] = f"WITH {sql.ENT}, {ctes}, pass AS (SELECT * FROM pass1 UNION ALL SELECT * FROM pass2) {OUT}"


# Numbers of the passes in the catalogue of each generation.
NUMBERS = {
    "b1": {"exact_name_norm": 1, "exact_clean_legal": 2, "rare_token": 3, "sorted_token": 7, "name_prefix_6": 8, "country_name_token": 9, "phonetic": 10},
    "b2": {n: i for i, n in enumerate(P.V2_BITS, 1)},
    "b3": {n: i for i, n in enumerate(P.V3_BITS, 1)},
    "b3e": {p.name: i for i, p in enumerate(P.v3_eval(), 1)},
    "b4": {p.name: i for i, p in enumerate((p for p in P.experimental()), 1)} | {"name_token_postal": 8, "phonetic_ext": 9, "consonant_skeleton": 10, "sorted_token_relaxed": 11},
}
for _gen, _specs, _keys in (("b1", P.v1, sql.v1_keys()), ("b2", P.v2, sql.v2_keys()), ("b3", P.v3, sql.v3_keys()), ("b3e", P.v3_eval, sql.v3_eval_keys()), ("b4", P.experimental, sql.experimental_keys(P.FIRST_STOP, P.PAIR_STOP))):
    for _p in _specs():
        _register(f"{_gen}_{NUMBERS[_gen][_p.name]:02d}_{_p.name}", _p, _keys[_p.name])


def _b1_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_source(address_tokens_v1, *_sides(entities(spark, sf_dir)))


def address_ctes(name: str, target: str, max_df: int = 1000, lone_df: int = 50, cap: int = 30) -> str:
    """CTEs of the pass over address tokens, ending in ``name`` (s1, c, score, rank)."""
    n = name
    return f"""{n}l AS (SELECT entity_id AS s1, {sql.numeric()} AS ks FROM ent WHERE source = 0 AND address_norm <> ''
), {n}lk AS (SELECT s1, len(ks) AS n, unnest(list_distinct(ks)) AS k FROM {n}l
), {n}r AS (SELECT entity_id AS c, unnest(list_distinct({sql.numeric()})) AS k FROM ent WHERE {target}
), {n}rk AS (SELECT c, k, count(*) OVER (PARTITION BY k) AS df FROM {n}r
), {n}h AS (SELECT s1, c, n, max(df) AS df, count(*) AS score FROM {n}lk JOIN {n}rk USING (k) WHERE df <= {max_df} GROUP BY s1, c, n
), {n}ok AS (SELECT s1, c, score FROM {n}h WHERE (n >= 2 AND score >= 2) OR (n = 1 AND df <= {lone_df})
), {n} AS (SELECT s1, c, CAST(score AS BIGINT) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY s1 ORDER BY c) AS INTEGER) AS rank FROM {n}ok) WHERE rank <= {cap})"""


QUERIES["b1_04_address_token"] = _b1_04
ORACLES["b1_04_address_token"] = f"WITH {sql.ENT}, {address_ctes('p1_', TARGETS[0])}, {address_ctes('p2_', TARGETS[1])}, pass AS (SELECT * FROM p1_ UNION ALL SELECT * FROM p2_) {OUT}"


def tfidf_ctes(name: str, target: str, terms: str, min_sim: float, k: int, part: str = "''", max_df: float = 1.0) -> str:
    """CTEs of a TF-IDF pass against one target source, ending in ``name`` (s1, c, cosine, rank)."""
    n = name
    return f"""{n}v AS (SELECT entity_id, source, {part} AS p, {terms} AS t FROM ent WHERE (source = 0 OR {target}) AND name_clean_legal <> ''
), {n}n AS (SELECT p, count(*) AS n FROM {n}v GROUP BY p
), {n}tf AS (SELECT source, p, entity_id, g, count(*) AS tf FROM (SELECT source, p, entity_id, unnest(t) AS g FROM {n}v) GROUP BY ALL
), {n}df AS (SELECT p, g, count(*) AS df FROM {n}tf GROUP BY p, g
), {n}w0 AS (SELECT source, p, entity_id, g, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM {n}tf JOIN {n}df USING (p, g) JOIN {n}n USING (p) WHERE df >= 2 AND df <= n * {max_df}
), {n}w AS (SELECT source, p, entity_id, g, w / sqrt(sum(w * w) OVER (PARTITION BY entity_id)) AS w FROM {n}w0
), {n}s AS (SELECT a.entity_id AS s1, b.entity_id AS c, round(sum(a.w * b.w), 9) AS cosine FROM {n}w a JOIN {n}w b ON a.p = b.p AND a.g = b.g AND a.source = 0 AND b.source > 0 GROUP BY a.entity_id, b.entity_id
), {n} AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY s1 ORDER BY cosine DESC, c) AS INTEGER) AS rank FROM {n}s WHERE cosine > {min_sim}) WHERE rank <= {k})"""


_GRAMS = f"list_transform(range(1, length({sql.C}) - 1), lambda i: substring({sql.C}, i, 3))"
_WORDS = rf"list_filter(string_split_regex({sql.C}, '[^\p{{L}}\p{{N}}_]+'), lambda w: length(w) >= 2)"
_FIRST = "substring(name_clean_legal, 1, 1)"


def _cosine(left: DataFrame, right: DataFrame, min_sim: float, k: int, partitioned: bool = False, by_word: bool = False, max_df: float = 1.0) -> DataFrame:
    a, b = (x.filter(F.col("name_clean_legal") != "") for x in (left, right))
    terms = word_terms("name_clean_legal") if by_word else char_grams("name_clean_legal")
    return tfidf_join(a, b, terms, min_sim, k, F.substring("name_clean_legal", 1, 1) if partitioned else None, max_df)


def _tfidf(name: str, min_sim: float, k: int, partitioned: bool = False, by_word: bool = False, max_df: float = 1.0) -> None:
    QUERIES[name] = lambda spark, sf_dir: _by_source(partial(_cosine, min_sim=min_sim, k=k, partitioned=partitioned, by_word=by_word, max_df=max_df), *_sides(entities(spark, sf_dir)))
    ctes = ", ".join(tfidf_ctes(f"p{s}_", f"source = {s}", _WORDS if by_word else _GRAMS, min_sim, k, _FIRST if partitioned else "''", max_df) for s in (1, 2))
    ORACLES[name] = f"WITH {sql.ENT}, {ctes} SELECT s1 AS s1_entity_id, c AS candidate_entity_id, cosine, rank FROM (SELECT * FROM p1_ UNION ALL SELECT * FROM p2_)"


_tfidf("b1_05_char_ngram_070", 0.70, 10)
_tfidf("b1_06_char_ngram_050", 0.50, 10)
_tfidf("b2_11_partitioned_tfidf", 0.50, 15, partitioned=True)
_tfidf("b3_09_partitioned_tfidf", 0.45, 15, partitioned=True)
_tfidf("b3e_13_partitioned_tfidf", 0.45, 15, partitioned=True)
_tfidf("b4_07_char_tfidf_relaxed", 0.35, 20)
_tfidf("b4_12_word_tfidf", 0.50, 15, by_word=True, max_df=0.1)
_tfidf("s_02_top_k_cosine", 0.60, 3)


# Passes of the unions that aren't keyed ones, as (operator, CTEs of its SQL); the third generation's takes 20 where it is combined.
def _grams(min_sim: float, k: int, partitioned: bool = False) -> tuple[Callable, Callable]:
    return partial(_cosine, min_sim=min_sim, k=k, partitioned=partitioned), lambda name, target: tfidf_ctes(name, target, _GRAMS, min_sim, k, _FIRST if partitioned else "''")


V1_MORE = {"address_token": (address_tokens_v1, address_ctes), "char_ngram_0.70": _grams(0.70, 10), "char_ngram_0.50": _grams(0.50, 10)}
V2_MORE = {"partitioned_tfidf": _grams(0.50, 15, True)}
V3_MORE = {"partitioned_tfidf": _grams(0.45, 20, True)}


KEYED = 3  # tables of keyed passes, where they are made one after another; as few read the records, as many take little disk


def _parts(ents: DataFrame, specs: list[Pass], bits: dict[str, int], more: dict[str, tuple], keyed_parts: int = 1) -> dict[str, Callable[[], DataFrame]]:
    """What makes (s1, candidate, bit) of the keyed passes, dealt out to so many parts, and of each other pass and target source."""
    one, targets = _sides(ents)

    def keyed(some: list[Pass]) -> DataFrame:
        number = F.element_at(F.array(*[F.lit(bits[p.name]) for p in some]), F.col("p") + 1)
        return keyed_passes(one, targets, some).select(S1, CAND, number.alias("bit"))

    def other(name: str, s: int) -> DataFrame:
        return more[name][0](one, targets.filter(f"source = {s}")).select(S1, CAND, F.lit(bits[name]).alias("bit"))

    dealt = [specs[i::keyed_parts] for i in range(keyed_parts)]
    return {f"keyed-{i}": partial(keyed, some) for i, some in enumerate(dealt) if some} | {f"{name}-{s}": partial(other, name, s) for name in more for s in (1, 2)}


def found(ents: DataFrame, specs: list[Pass], bits: dict[str, int], more: dict[str, tuple]) -> DataFrame:
    """(s1, candidate, bit): the pairs of every pass; each target source has guards and caps of its own."""
    return reduce(DataFrame.unionByName, [make() for make in _parts(ents, specs, bits, more).values()])


def found_once(ents: DataFrame, name: str, specs: list[Pass], bits: dict[str, int], more: dict[str, tuple]) -> DataFrame:
    """``found``, made once under ``name`` for each version of the records' files, part by part: no two parts' shuffles take disk at a time."""
    if not ents.inputFiles():
        return found(ents, specs, bits, more)
    base = f"{scratch_base(ents.sparkSession)}/found-{version(ents)}/{name}"
    return reduce(DataFrame.unionByName, [cached(ents.sparkSession, f"{base}-{part}", make) for part, make in _parts(ents, specs, bits, more, KEYED).items()])


def found_ctes(specs: list[Pass], bits: dict[str, int], keys: dict, more: dict[str, tuple], as_: str = "") -> str:
    """CTEs that end in ``found`` (s1, c, b) and ``cand`` (s1, c, pass_mask), all names with ``as_`` before them."""
    ctes, rows = [], []
    for s in (1, 2):
        for i, p in enumerate(specs):
            ctes.append(sql.pass_ctes(p, keys[p.name], f"{as_}u{s}_{i}_", f"source = {s}"))
            rows.append(f"SELECT s1, c, {bits[p.name]} AS b FROM {as_}u{s}_{i}_")
        for i, (name, (_, more_ctes)) in enumerate(more.items()):
            ctes.append(more_ctes(f"{as_}x{s}_{i}_", f"source = {s}"))
            rows.append(f"SELECT s1, c, {bits[name]} AS b FROM {as_}x{s}_{i}_")
    return f"{', '.join(ctes)}, {as_}found AS ({' UNION ALL '.join(rows)}), {as_}cand AS (SELECT s1, c, CAST(bit_or(b) AS INTEGER) AS pass_mask FROM {as_}found GROUP BY s1, c)"


def _union(name: str, specs: list[Pass], bits: dict[str, int], keys: dict, more: dict[str, tuple]) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = combine(found_once(entities(spark, sf_dir), name.removesuffix("_u_combined"), specs, bits, more))
        return out.withColumn("blocking_passes", mask_names(F.col("pass_mask"), bits)).withColumn("num_passes", F.bit_count("pass_mask").cast("int"))

    QUERIES[name] = query
    names = ", ".join(f"CASE WHEN pass_mask & {b} <> 0 THEN '{n}' END" for n, b in sorted(bits.items(), key=lambda x: x[1]))
    ORACLES[name] = f"""WITH {sql.ENT}, {found_ctes(specs, bits, keys, more)}
SELECT s1 AS s1_entity_id, c AS candidate_entity_id, pass_mask, concat_ws('|', {names}) AS blocking_passes, CAST(bit_count(pass_mask) AS INTEGER) AS num_passes FROM cand"""


_union("b1_u_combined", P.v1(), P.V1_BITS, sql.v1_keys(), V1_MORE)
_union("b2_u_combined", P.v2(), P.V2_BITS, sql.v2_keys(), V2_MORE)
_union("b3_u_combined", P.v3(), P.V3_BITS, sql.v3_keys(), V3_MORE)
V1_TEST_MORE = V1_MORE | {"char_ngram_0.50": _grams(0.45, 20)}
_union("b1_t_combined_test", P.v1(**P.V1_TEST), P.V1_BITS, sql.v1_keys(), V1_TEST_MORE)
