"""Queries ``opN_<name>`` and ``pipeline``, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from kinline.llm import language_id, quality, toxicity
from kinline.llm.chat import format_chats
from kinline.llm.common import table
from kinline.llm.decontamination import find_matches
from kinline.llm.exact_dedup import exact_dedup
from kinline.llm.ngram_jaccard import jaccard_classes
from kinline.llm.packing import pack, with_digest
from kinline.llm.substring_dedup import substring_dedup
from kinline.llm.warc import BLANKS, BLOCK_TAG, ENTITIES, HEADERS, LINES, TAG, TITLE, UNSEEN, derivatives

ORACLES: dict[str, str] = {}


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLES["op1_substring_dedup"] = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, unnest(range(1, len(ws) - 18)) AS p, ws FROM w WHERE len(ws) >= 20
), k AS (
  SELECT doc_id, p, md5(array_to_string(ws[p:p + 19], ' ')) AS h FROM s
), later AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS n FROM k) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, p + i AS q FROM later, range(0, 20) AS r(i)
), tokens AS (
  SELECT doc_id, unnest(ws) AS t, unnest(range(1, len(ws) + 1)) AS q FROM w
), kept AS (
  SELECT t.doc_id, string_agg(t.t, ' ' ORDER BY t.q) AS kept, count(*) AS n_kept
  FROM tokens t ANTI JOIN gone g ON t.doc_id = g.doc_id AND t.q = g.q GROUP BY t.doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""

def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("key")


ORACLES["op2_exact_dedup"] = r"""
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS x FROM documents
), g AS (
  SELECT doc_id, x, first_value(doc_id) OVER (PARTITION BY x ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size FROM n
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(x) AS text_sha256 FROM g
"""


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


SHINGLES = r"""
w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w
)"""
ORACLES["op3_ngram_jaccard"] = f"""
WITH RECURSIVE {SHINGLES}, e AS (
  SELECT doc_id, len(sh) AS n, unnest(sh) AS s FROM sets
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS r FROM sets UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON reach.r = links.x
)
SELECT sets.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id
FROM sets JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = language_id.fold("doc_id", 3) == 1
    model = toxicity.train(documents, labels.filter(~held_out))
    out = toxicity.score(documents, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_restored")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_digest(pack(table(spark, sf_dir, "documents")))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


ORACLES["op6_chat_formatting"] = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL
), k AS (SELECT conv_id, turn, string_agg(coalesce('.' || role, '') || chr(1) || coalesce('.' || text, ''), chr(2) ORDER BY role, text) AS x FROM t GROUP BY conv_id, turn
), p AS (SELECT conv_id, turn, string_agg(coalesce(CAST(turn AS VARCHAR), '') || chr(3) || x, chr(4)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST ROWS UNBOUNDED PRECEDING) AS pre,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST) AS back FROM k
), whole AS (SELECT conv_id, pre FROM p WHERE back = 1
), own AS (SELECT pre, min(conv_id) AS conv_id, count(*) AS n_copies FROM whole GROUP BY pre
), kept AS (SELECT conv_id, n_copies FROM own WHERE pre NOT IN (SELECT pre FROM p WHERE back > 1)
)
SELECT t.conv_id, CAST(floor(coalesce(turn, -1) / 256.0) AS BIGINT) AS segment, any_value(n.n) AS n_turns, any_value(n_copies) AS n_copies,
  string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY coalesce(turn, -1), coalesce(role, ''), coalesce(text, '')) AS rendered
FROM t JOIN kept USING (conv_id) JOIN (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id) n USING (conv_id)
GROUP BY t.conv_id, segment
"""


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(table(spark, sf_dir, "pages"))


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql_resolved(x: str) -> str:
    for name, sign in ENTITIES:
        x = f"replace({x}, {_sql_text(name)}, {_sql_text(sign)})"
    return x


def _sql_urn(kind: str) -> str:
    h = f"md5(concat_ws(chr(10), {kind}, coalesce(CAST(page_id AS VARCHAR), ''), coalesce(url, ''), digest))"
    return "'urn:uuid:' || " + " || '-' || ".join(f"substring({h}, {at}, {n})" for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))


_SQL_TEXT = f"regexp_replace(regexp_replace(payload, {_sql_text(UNSEEN)}, ' ', 'g'), {_sql_text(BLOCK_TAG)}, chr(10), 'g')"
_SQL_TEXT = f"regexp_replace(regexp_replace({_sql_resolved(f'regexp_replace({_SQL_TEXT}, {_sql_text(TAG)}, {_sql_text("")}, {_sql_text("g")})')}, {_sql_text(BLANKS)}, ' ', 'g'), {_sql_text(LINES)}, chr(10), 'g')"
ORACLES["op8_warc_derivatives"] = f"""
WITH a AS (
  SELECT page_id, url, coalesce(html, '') AS raw, regexp_extract(coalesce(html, ''), {_sql_text(HEADERS)}, 1) AS head FROM pages
), b AS (
  SELECT page_id, url, head, CASE WHEN head = '' THEN raw ELSE regexp_replace(raw, {_sql_text(HEADERS)}, '') END AS payload FROM a
), c AS (
  SELECT *, 'sha256:' || sha256(payload) AS digest, trim({_SQL_TEXT}, ' ' || chr(10)) AS text,
    trim(regexp_replace({_sql_resolved(f"regexp_extract(payload, {_sql_text(TITLE)}, 1)")}, '\\s+', ' ', 'g')) AS title FROM b
), d AS (
  SELECT *, {_sql_urn("'response'")} AS refers_to FROM c
), e AS (
  SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS content_type,
    'title: ' || title || chr(13) || chr(10) || 'source-length: ' || strlen(payload) || chr(13) || chr(10) || 'text-length: ' || strlen(text) || chr(13) || chr(10) || 'source-digest: ' || digest
    || CASE WHEN head <> '' THEN chr(13) || chr(10) || 'source-headers: ' || regexp_replace(head, '\\r?\\n', ' | ', 'g') ELSE '' END || chr(13) || chr(10) AS content FROM d
  UNION ALL SELECT *, 'conversion', 'text/plain; charset=UTF-8', text FROM d
)
SELECT page_id, record_type, {_sql_urn("record_type")} AS record_id, refers_to, url AS target_uri, content_type, digest AS payload_digest,
  'sha256:' || sha256(content) AS block_digest, CAST(strlen(content) AS BIGINT) AS content_length, content FROM e
"""


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = language_id.fold("doc_id", 5) == 0
    model = language_id.train(documents.filter(~held_out))
    return language_id.identify(documents, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contaminated documents and the items they hold; clean documents have no row."""
    out = find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.withColumn("similarity", F.round("similarity", 9))


ORACLES["op9_decontamination"] = r"""
WITH w AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
), t AS (
  SELECT kind, id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM w
), items AS (
  SELECT id AS item_id, len(ws) AS m, list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) AS sh FROM t WHERE kind = 'b' AND len(ws) >= 5
), docs AS (
  SELECT id AS doc_id, len(ws) AS n, list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) AS sh FROM t WHERE kind = 'd' AND len(ws) >= 5
), hit AS (
  SELECT DISTINCT d.doc_id, i.item_id, d.p FROM (SELECT doc_id, unnest(sh) AS s, unnest(range(1, len(sh) + 1)) AS p FROM docs) d
  JOIN (SELECT DISTINCT item_id, unnest(sh) AS s FROM items) i ON d.s = i.s
), starts AS (
  SELECT DISTINCT h.doc_id, h.item_id, unnest(range(greatest(1, p - least(m, n) + 5), least(p, n - 4 - (least(m, n) - 4) + 1) + 1)) AS st
  FROM hit h JOIN items USING (item_id) JOIN docs USING (doc_id)
), win AS (
  SELECT doc_id, item_id, st, least(m, n) - 4 AS k, len(i.sh) AS ni, d.sh[st:st + least(m, n) - 5] AS ds, i.sh AS ish
  FROM starts JOIN items i USING (item_id) JOIN docs d USING (doc_id)
), sims AS (
  SELECT doc_id, item_id, st, k, ni, list_sum(list_transform(list_distinct(ish), lambda x: least(len(list_filter(ish, lambda y: y = x)), len(list_filter(ds, lambda z: z = x))))) AS n_both FROM win
), good AS (
  SELECT doc_id, item_id, st, k, n_both / (k + ni - n_both) AS similarity, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_both / (k + ni - n_both) DESC, st) AS rn FROM sims
)
SELECT doc_id, item_id, round(CAST(similarity AS DOUBLE), 9) AS similarity, CAST(st - 1 AS BIGINT) AS first_word, CAST(k + 4 AS BIGINT) AS n_words FROM good WHERE rn = 1 AND similarity >= 0.8
"""


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = language_id.fold("doc_id", 5) == 0
    out = quality.score(documents, quality.train(documents, labels.filter(~held_out)))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_exact_dedup, op3_ngram_jaccard, op4_toxicity, op5_packing, op6_chat_formatting, op7_language_id, op8_warc_derivatives, op9_decontamination, op10_quality)}
QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
