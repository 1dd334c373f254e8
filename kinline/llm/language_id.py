"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, everything else is one kind of separator, and every run of two and of three code
points of a text that holds a letter is hashed into a bucket. Counts come from all labelled training rows:
each task adds up its own, Spark adds up the tasks'. The matrix of log-probabilities (languages by buckets,
at most ``MAX_CELLS`` cells) is broadcast; a batch is scored by sparse lookups in numpy.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text where no
labelled row exists. Texts and languages may repeat; ties go to the language that sorts first. Null ids
count as an empty text in the fold rule and hence are held out. Other columns are ignored.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinline.llm import kernels as K
from kinline.llm.common import batch_of, id_and_text, lean, public_id

BITS = 16
MAX_CELLS = 1 << 25
UNKNOWN = "und"
SMOOTHING = 0.5
BLOCK = 1 << 18  # bytes of text whose n-grams are held at a time; some 30 times as much
_TABLE: list[np.ndarray] = []


def fold(id_col: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def _letters() -> np.ndarray:
    """Code point -> lower-case code point of a letter, or 0."""
    if not _TABLE:
        out = np.zeros(0x110000, np.uint32)
        for c in range(0x20000):
            ch = chr(c)
            if unicodedata.category(ch)[0] == "L":
                low = ch.lower()
                out[c] = ord(low) if len(low) == 1 else c
        out[0x20000:0x323B0] = np.arange(0x20000, 0x323B0)  # ideographs
        _TABLE.append(out)
    return _TABLE[0]


def code_points(b: K.Block) -> tuple[np.ndarray, np.ndarray]:
    """All code points of a block, and where each row's begin."""
    points = np.frombuffer(b.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    heads = np.concatenate(([0], np.cumsum((b.data & 0xC0) != 0x80)))[b.offsets]
    return points, heads


def grams(b: K.Block, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, first, has_letter): n-gram buckets of all rows one after another, where each row's begin."""
    points, heads = code_points(b)
    m = _letters()[points]
    n = len(m)
    row_end = np.repeat(heads[1:], np.diff(heads)) if n else np.zeros(0, np.int64)
    some = np.concatenate(([0], np.cumsum(m > 0)))
    letters = some[heads[1:]] - some[heads[:-1]] > 0
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(b.rows + 1, np.int64), letters
    at = np.arange(n)
    shift = np.uint32(32 - bits)
    two = m[:-1] * np.uint32(0x9E3779B1) + m[1:] * np.uint32(0x85EBCA77)
    take2 = (at[:-1] + 2 <= row_end[:-1]) & ((m[:-1] > 0) | (m[1:] > 0))
    out = np.zeros((n, 2), np.int64)
    ok = np.zeros((n, 2), bool)
    out[:-1, 0] = ((two ^ (two >> np.uint32(15))) * np.uint32(0xC2B2AE3D)) >> shift
    ok[:-1, 0] = take2
    if n > 2:
        three = two[:-1] * np.uint32(0x27D4EB2F) + m[2:] * np.uint32(0x165667B1)
        out[:-2, 1] = ((three ^ (three >> np.uint32(15))) * np.uint32(0xC2B2AE3D)) >> shift
        ok[:-2, 1] = (at[:-2] + 3 <= row_end[:-2]) & (m[1:-1] > 0)
    flat = ok.ravel()
    ends = np.concatenate(([0], np.cumsum(flat)))[2 * heads]
    return out.ravel()[flat], ends, letters


def _count(langs: list[str], bits: int):
    def run(batches):
        lean()
        total = np.zeros((len(langs), 1 << bits), np.int64)
        most = BLOCK if total.size <= 1 << 20 else K.CHUNK_BYTES  # all cells are added up for each block
        index = {x: i for i, x in enumerate(langs)}
        for batch in batches:
            label = np.array([index[x] for x in batch.column("_lang").to_pylist()], np.int64)
            for b in K.blocks(batch.column("_text"), most):
                g, ends, _ = grams(b, bits)
                row = np.repeat(label[b.first_row : b.first_row + b.rows], np.diff(ends))
                total += np.bincount(row << bits | g, minlength=len(langs) << bits).reshape(total.shape)
        i, j = np.nonzero(total)
        if len(i):
            yield batch_of(lang=i.astype(np.int32), bucket=j.astype(np.int32), n=total[i, j])

    return run


class LanguageModel:
    def __init__(self, langs: list[str], bits: int, log_prob: np.ndarray, prior: np.ndarray):
        self.langs, self.bits, self.log_prob, self.prior = langs, bits, log_prob, prior


def train(documents: DataFrame, lang_col: str = "lang", text_col: str = "text") -> LanguageModel:
    """From all rows given; those without a language or text are passed over."""
    rows = documents.select(F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).cast("string").alias("_text")).filter("_lang is not null and _text is not null")
    sizes = {r[0]: r[1] for r in rows.groupBy("_lang").count().limit(100_001).collect()}
    langs = sorted(sizes)
    if len(langs) > 100_000:
        raise ValueError("more than 100,000 languages: the column doesn't hold languages")
    bits = BITS
    while len(langs) << bits > MAX_CELLS and bits > 8:
        bits -= 1
    counts = np.zeros((len(langs), 1 << bits))
    if langs:
        got = rows.mapInArrow(_count(langs, bits), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
        counts[got["lang"].to_numpy(), got["bucket"].to_numpy()] = got["n"].to_numpy()
    log_prob = np.log(counts + SMOOTHING) - np.log(counts.sum(1, keepdims=True) + SMOOTHING * (1 << bits)) if langs else counts
    prior = np.log(np.array([sizes[x] for x in langs], float) / max(1, sum(sizes.values())))
    return LanguageModel(langs, bits, log_prob, prior)


def _score(model, least_fit: float | None = None):
    """``least_fit``: texts whose n-grams are on average less likely, by so many nats, in the best language than if all n-grams were alike are unknown."""

    def run(batches):
        lean()
        m = model.value
        names = [*m.langs, UNKNOWN]
        for batch in batches:
            for b in K.blocks(batch.column("_text"), BLOCK):
                g, ends, letters = grams(b, m.bits)
                ll = np.zeros((len(m.langs), b.rows))
                full = np.flatnonzero(np.diff(ends))
                for i in range(len(m.langs)):
                    if len(full):
                        ll[i, full] = np.add.reduceat(m.log_prob[i].take(g), ends[full])
                    ll[i] += m.prior[i]
                if len(m.langs):
                    best = ll.argmax(0)
                    score = 1 / np.exp(ll - ll.max(0)).sum(0)
                    if least_fit is not None:
                        n = np.diff(ends)
                        alike = -n * m.bits * np.log(2)
                        letters = letters & (ll.max(0) - m.prior[best] - alike >= least_fit * n)
                    best[~letters], score[~letters] = len(m.langs), 0
                else:
                    best, score = np.zeros(b.rows, np.int64), np.zeros(b.rows)
                rows = slice(b.first_row, b.first_row + b.rows)
                out = {"_id": batch.column("_id")[rows], "lang_pred": pa.array([names[x] for x in best], pa.string()), "score": np.clip(score, 0, 1)}
                yield batch_of(**out, **({"_row": batch.column("_row")[rows]} if "_row" in batch.schema.names else {}))

    return run


def identify(documents: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of each row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    out = id_and_text(documents, id_col, text_col).mapInArrow(_score(shared), "_id long, lang_pred string, score double")
    return out.select(public_id().alias(id_col), "lang_pred", "score")


def accepted(documents: DataFrame, model: LanguageModel, text_col: str = "text", languages: list[str] | None = None, least_score: float = 0.5, least_fit: float | None = None) -> DataFrame:
    """The rows whose language is one of ``languages`` (any that the model knows if None) with a probability of ``least_score``
    or more, with all their columns and without a shuffle.

    With a ``least_fit`` (0 will do), a text whose n-grams are on average less likely in its best language, by so many nats,
    than if all n-grams were alike is in none of them. Texts without a letter go. A model without languages can tell nothing else, so it keeps all texts with a letter.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    wanted = set(model.langs if languages is None else languages)

    def known(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([pa.nulls(len(texts), pa.int64()), texts], ["_id", "_text"])
        if not shared.value.langs:
            return pa.array(np.concatenate([np.zeros(0, bool), *(grams(b, 16)[2] for b in K.blocks(texts))]), pa.bool_())
        out = list(_score(shared, least_fit)([batch]))
        return pa.array([x in wanted and p >= least_score for b in out for x, p in zip(b.column("lang_pred").to_pylist(), b.column("score").to_pylist(), strict=True)], pa.bool_())

    def call(x: pa.Array) -> pa.Array:
        return known(x)

    return documents.filter(F.arrow_udf(call, "boolean")(F.col(text_col).cast("string")))
