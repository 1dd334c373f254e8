"""WARC derivatives of web pages: a metadata and a plain-text conversion record for each response.

Both name the response they come from (WARC-Refers-To, WARC-Refers-To-Target-URI), the metadata record
carries the response's own HTTP header block and payload digest, and each has the digest and length of its
own block. Record ids are urn:uuid names made from page id, URL and digest, so a rerun gives the same ones.

Text: scripts, styles and comments go; block tags end lines; other tags go; five common entities and the
no-break space are resolved; blanks are joined. Everything is DataFrame functions on single rows, without a
shuffle. Defined results: null html is empty and gives records with empty text; null ids and URLs are empty
in names and null in the output; repeated rows give the same records again; an empty table gives none; a page whose html begins with
``HTTP/`` has its header block up to the first empty line; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the conversion, for any engine without back-references.
HEADERS = r"(?s)\A(HTTP/.*?)\r?\n\r?\n"
UNSEEN = r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->"
BLOCK_TAG = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>"
TAG = r"<[^>]*>"
BLANKS = r"[ \t\r\f\x0B]+"
LINES = r" ?\n[ \n]*"
TITLE = r"(?is)<title\b[^>]*>(.*?)</title"
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def _resolved(x: Column) -> Column:
    for name, sign in ENTITIES:
        x = F.replace(x, F.lit(name), F.lit(sign))
    return x


def html_to_text(html: Column) -> Column:
    x = F.regexp_replace(html, UNSEEN, " ")
    x = F.regexp_replace(x, BLOCK_TAG, "\n")
    x = _resolved(F.regexp_replace(x, TAG, ""))
    return F.btrim(F.regexp_replace(F.regexp_replace(x, BLANKS, " "), LINES, "\n"), F.lit(" \n"))


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\n", *parts))
    return F.concat(F.lit("urn:uuid:"), *[x for i, (at, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] if i else []) + [F.substring(h, at, n)]])


def derivatives(pages: DataFrame) -> DataFrame:
    """(page_id, record_type, record_id, refers_to, target_uri, content_type, payload_digest, block_digest, content_length, content)."""
    raw = F.coalesce(F.col("html").cast("string"), F.lit(""))
    head = F.regexp_extract(raw, HEADERS, 1)
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), head.alias("head"), F.when(head == "", raw).otherwise(F.regexp_replace(raw, HEADERS, "")).alias("payload"))
    name = [F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit(""))]
    digest = F.concat(F.lit("sha256:"), F.sha2("payload", 256))
    base = base.withColumns({"digest": digest, "source": _urn(F.lit("response"), *name, digest), "text": html_to_text(F.col("payload")), "title": F.btrim(F.regexp_replace(_resolved(F.regexp_extract("payload", TITLE, 1)), r"\s+", " "))})
    fields = F.concat(
        F.lit("title: "), "title",
        F.lit("\r\nsource-length: "), F.octet_length("payload").cast("string"),
        F.lit("\r\ntext-length: "), F.octet_length("text").cast("string"),
        F.lit("\r\nsource-digest: "), "digest",
        F.when(F.col("head") != "", F.concat(F.lit("\r\nsource-headers: "), F.regexp_replace("head", r"\r?\n", " | "))).otherwise(F.lit("")),
        F.lit("\r\n"),
    )
    records = F.array(
        F.struct(F.lit("metadata").alias("type"), F.lit("application/warc-fields").alias("mime"), fields.alias("content")),
        F.struct(F.lit("conversion").alias("type"), F.lit("text/plain; charset=UTF-8").alias("mime"), F.col("text").alias("content")),
    )
    out = base.select("page_id", "url", "digest", "source", F.explode(records).alias("r"))
    return out.select(
        "page_id",
        F.col("r.type").alias("record_type"),
        _urn(F.col("r.type"), *name, "digest").alias("record_id"),
        F.col("source").alias("refers_to"),
        F.col("url").alias("target_uri"),
        F.col("r.mime").alias("content_type"),
        F.col("digest").alias("payload_digest"),
        F.concat(F.lit("sha256:"), F.sha2("r.content", 256)).alias("block_digest"),
        F.octet_length("r.content").cast("long").alias("content_length"),
        F.col("r.content").alias("content"),
    )


def rendered(records: DataFrame, date: str) -> DataFrame:
    """Each record as the text of a WARC/1.1 file's record, dated ``date``. A record without a URL has no header for one, and none
    claims the response's payload digest as its own; the metadata record names it as the source's."""
    of_response = F.when(F.col("target_uri").isNotNull(), F.concat(F.lit("\r\nWARC-Refers-To-Target-URI: "), "target_uri", F.lit("\r\nWARC-Target-URI: "), "target_uri")).otherwise(F.lit(""))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), "record_type", F.lit("\r\nWARC-Record-ID: <"), "record_id", F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Refers-To: <"), "refers_to",
        F.lit(">"), of_response, F.lit("\r\nWARC-Block-Digest: "), "block_digest", F.lit("\r\nContent-Type: "), "content_type",
        F.lit("\r\nContent-Length: "), F.col("content_length").cast("string"), F.lit("\r\n\r\n"), "content", F.lit("\r\n\r\n"),
    )
    return records.select("page_id", "record_type", "record_id", header.alias("record"))
