"""Quality by positive-unlabelled learning.

Rows labelled 1 are trusted positives; everything else is unlabelled web text, and rows labelled 0 are never
looked at. A model of binned text statistics is fitted by minimising the non-negative unbiased risk
``prior * R(positive, +) + max(0, R(unlabelled, -) - prior * R(positive, -))`` with the logistic loss. The
class prior is estimated: a first classifier of positives against unlabelled texts orders them, and the
prior is the least ratio, over all cuts, of the share of unlabelled texts above a cut to the share of
positives above it, each within its sampling error.

Weights are fitted on at most ``SAMPLE`` rows of trusted positives and as many unlabelled ones, by the order of a hash
of id and text; that is documented as a bound on what is fitted. The unlabelled side of the class prior comes from all rows: the
first classifier scores every text into a histogram of ``LEVELS`` levels, added up within tasks. Every row is scored.

Defined results: null and empty texts have the statistics of an empty text; rows and ids may repeat; a null
id counts as an empty text in the fold rule, and labels with one are passed over; without positives every score is 0.5; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinline.llm import kernels as K
from kinline.llm.common import batch_of, bounded_rows, cut, id_and_text, public_id
from kinline.llm.linear import adam, sigmoid

SAMPLE = 20_000
BINS = 12
LEVELS = 4_000  # of scores in the histograms that the class prior comes from
_KIND = np.zeros(256, np.int64)  # 0 sign, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 other byte, 7 sentence sign
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[[9, 11, 12, 13, 32]], _KIND[10], _KIND[128:] = 1, 2, 3, 4, 5, 6
_KIND[[ord(c) for c in ".,;:?'"]] = 7
NAMES = ["words", "word_length", "upper", "digit", "sign", "sentence", "lines", "distinct", "distinct_pairs", "same_as_before", "bare_signs", "shouted", "no_letter"]


def statistics(b: K.Block) -> np.ndarray:
    """One row of numbers for each text."""
    w = K.words(b)
    n = np.maximum(w.counts, 1)
    row = np.repeat(np.arange(b.rows), np.diff(b.offsets))
    kind = _KIND[b.data]
    kinds = np.bincount(row * 8 + kind, minlength=b.rows * 8).reshape(b.rows, 8).astype(float)
    size = np.maximum(kinds.sum(1), 1)
    letters = np.maximum(kinds[:, [1, 2, 6]].sum(1), 1)
    h = K.word_hashes(b, w, lower=True)
    of = w.row
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    pair = K.mix(h + np.concatenate((h[1:], h[:1])) * np.uint64(3)) if len(h) else h
    ends = kind[w.end - 1] if len(h) else np.zeros(0, np.int64)
    is_letter = np.concatenate(([0], np.cumsum((kind == 1) | (kind == 2) | (kind == 6))))
    is_lower = np.concatenate(([0], np.cumsum((kind == 1) | (kind == 6))))
    has_letter = is_letter[w.end] > is_letter[w.start]
    share = lambda flag: np.bincount(of, weights=flag, minlength=b.rows) / n
    return np.stack(
        [
            np.log1p(w.counts),
            np.bincount(of, weights=w.end - w.start, minlength=b.rows) / n,
            kinds[:, 2] / letters,
            kinds[:, 3] / size,
            kinds[:, 0] / size,
            kinds[:, 7] / size,
            kinds[:, 5] / n,
            _distinct(of, h, b.rows) / n,
            _distinct(of, pair, b.rows) / n,
            share(same),
            share(ends == 0),
            share(has_letter & (is_lower[w.end] == is_lower[w.start])),
            share(~has_letter),
        ],
        axis=1,
    )


def _distinct(row: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    key = np.sort((row.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))  # within a block, 40 bits of hash do for a statistic
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=rows)


class QualityModel:
    def __init__(self, edges: np.ndarray, weights: np.ndarray, bias: float, prior: float):
        self.edges, self.weights, self.bias, self.prior = edges, weights, bias, prior

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.edges[j], x[:, j], "right") + j * (BINS + 1) for j in range(x.shape[1])], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.weights[self.bins(x)].sum(1) + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.raw(x))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Least ratio of unlabelled to positive mass above a cut, with Hoeffding margins of each share. Both are counts by rising level of score."""
    n_p, n_u = positive.sum(), unlabelled.sum()
    above = lambda n: np.cumsum(n[::-1])[::-1] / max(1, n.sum())
    up, uu = above(positive), above(unlabelled)
    e_p, e_u = (np.sqrt(np.log(40) / (2 * max(1, n))) for n in (n_p, n_u))
    ok = up > max(2 * e_p, 0.05)
    return float(np.clip(np.min((uu[ok] + e_u) / (up[ok] - e_p), initial=1), 0.02, 0.98))


def levels(z: np.ndarray) -> np.ndarray:
    """Counts of scores before the sigmoid in LEVELS steps from -20 to 20."""
    return np.bincount(np.clip((z + 20) / 40 * LEVELS, 0, LEVELS - 1).astype(np.int64), minlength=LEVELS)


class Fit:
    """The two classifiers over one binning of the statistics of the sampled rows."""

    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray, steps: int = 400):
        both = np.concatenate((positive, unlabelled))
        edges = np.quantile(both, np.linspace(0, 1, BINS + 2)[1:-1], axis=0).T
        self.steps, self.model = steps, QualityModel(edges, np.zeros(both.shape[1] * (BINS + 1)), 0.0, 0.5)
        self.p, self.u, self.size = self.model.bins(positive), self.model.bins(unlabelled), len(self.model.weights)

    def _spread(self, d, at):
        return np.bincount(at.ravel(), weights=np.repeat(d, at.shape[1]), minlength=self.size)

    def ordering(self) -> QualityModel:
        """Positives against unlabelled rows: its scores only order texts."""
        p, u, size = self.p, self.u, self.size

        def gradient(w):
            dp = (sigmoid(w[p].sum(1) + w[size]) - 1) / len(p)
            du = sigmoid(w[u].sum(1) + w[size]) / len(u)
            return np.append(self._spread(dp, p) + self._spread(du, u) + 1e-4 * w[:size], dp.sum() + du.sum())

        w = adam(gradient, size + 1, self.steps, 0.05)
        return QualityModel(self.model.edges, w[:size], float(w[size]), 0.5)

    def non_negative(self, prior: float) -> QualityModel:
        """Minimises the non-negative unbiased risk under a class prior."""
        p, u, size = self.p, self.u, self.size

        def gradient(w):
            zp, zu = w[p].sum(1) + w[size], w[u].sum(1) + w[size]
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            du, dn = sigmoid(zu) / len(u), -prior * sigmoid(zp) / len(p)
            dp = prior * (sigmoid(zp) - 1) / len(p)
            if negative < 0:  # only climb back until the risk of the negatives isn't below 0
                return np.append(-(self._spread(du, u) + self._spread(dn, p)), -(du.sum() + dn.sum()))
            return np.append(self._spread(dp + dn, p) + self._spread(du, u) + 1e-4 * w[:size], (dp + dn).sum() + du.sum())

        w = adam(gradient, size + 1, self.steps, 0.05)
        return QualityModel(self.model.edges, w[:size], float(w[size]), prior)


def _histogram(model):
    """Levels of all texts of a task."""

    def run(batches):
        m, total = model.value, np.zeros(LEVELS, np.int64)
        for batch in batches:
            for b in K.blocks(batch.column("_text")):
                total += levels(m.raw(statistics(b)))
        at = np.flatnonzero(total)
        if len(at):
            yield batch_of(level=at, n=total[at])

    return run


def _statistics(batches):
    for batch in batches:
        for b in K.blocks(batch.column("_text")):
            s = slice(b.first_row, b.first_row + b.rows)
            yield batch_of(kind=batch.column("_kind")[s], x=pa.array(list(statistics(b)), pa.list_(pa.float64())))


def train(documents: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> QualityModel | None:
    """``labels`` are those that may be learned from, of which only the positive ones are read."""
    docs = id_and_text(documents, id_col, text_col)
    trusted = labels.filter((F.col(label_col) == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id")).distinct()
    positive = bounded_rows(docs, trusted, sample).withColumn("_kind", F.lit(1))
    anything = cut(docs, docs.count(), sample).withColumn("_kind", F.lit(0))
    rows = positive.unionByName(anything)
    got = rows.mapInArrow(_statistics, "kind int, x array<double>").toArrow().combine_chunks()
    kind = got["kind"].to_numpy()
    x = got["x"].combine_chunks().flatten().to_numpy().reshape(len(kind), -1) if len(kind) else np.zeros((0, len(NAMES)))
    if not (kind == 1).any() or not (kind == 0).any():
        return None
    fit = Fit(x[kind == 1], x[kind == 0])
    first = fit.ordering()
    shared = documents.sparkSession.sparkContext.broadcast(first)
    got = docs.select("_text").mapInArrow(_histogram(shared), "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).toArrow()  # LEVELS rows at most
    everything = np.zeros(LEVELS, np.int64)
    everything[got["level"].to_numpy()] = got["n"].to_numpy()
    positives = levels(first.raw(x[kind == 1]))
    return fit.non_negative(estimate_prior(positives, everything))


def _score(model):
    def run(batches):
        m = model.value
        for batch in batches:
            for b in K.blocks(batch.column("_text")):
                s = slice(b.first_row, b.first_row + b.rows)
                yield batch_of(_id=batch.column("_id")[s], score=m.score(statistics(b)) if m else np.full(b.rows, 0.5))

    return run


def score(documents: DataFrame, model: QualityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    return id_and_text(documents, id_col, text_col).mapInArrow(_score(shared), "_id long, score double").select(public_id().alias(id_col), "score")
