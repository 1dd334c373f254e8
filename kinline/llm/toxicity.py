"""Toxicity by noisy-channel deobfuscation.

1. *Language model.* Character 4-gram counts over every text of the input (letters a to z, one class for
   other letters, one for the space between words); each task adds up its own, Spark adds up the tasks'.
2. *Restoring.* Words that look disguised (letters beside a digit or sign that resembles one, a separator
   before a letter, a letter three times running, runs of single letters and signs), of any length, become
   a lattice: each character may stand for itself, for letters it resembles,
   or for nothing (a separator or a repeat). Viterbi finds the path with the best product of channel and
   language model. Other words have one path and stay as they are. Decisions are remembered by word.
3. *Scoring.* Words of the restored text and their first four to six bytes are features; those that lean
   towards toxic rows in a bounded sample of labelled training rows get weights by logistic regression.

Labels are learned from at most ``SAMPLE`` rows of documents with a label, by the order of a hash of id and text; a
feature has a weight if ``MIN_TOXIC`` toxic rows of these have it and it is among the ``FEATURES`` that lean most
towards them. These are parameters of what is fitted. Every text is counted, restored and scored whole.

Defined results: null and empty texts score like a text without features; rows and ids may repeat; a null
id counts as an empty text in the fold rule; labels with a null id or of unknown ids are passed over, repeated ones count once for each row;
without labels of both kinds every score is the share of toxic rows (0 without labels); other columns are
ignored.
"""

from __future__ import annotations

import zlib
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinline.llm import kernels as K
from kinline.llm.common import batch_of, bounded_rows, id_and_text, kept, numpy, public_id, signed
from kinline.llm.language_id import fold
from kinline.llm.linear import adam, sigmoid

SAMPLE = 20_000  # labelled rows at most that weights are fitted on, by the order of a hash of the id
FEATURES = 4_096  # features at most that have a weight
MIN_TOXIC = 3  # toxic rows that have a feature with a weight
ORDER = 4
OTHER, SPACE = 26, 27
SYMBOLS = 28

# What a sign may stand for.
RESEMBLES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "*": "aeiou", "#": "h", "%": "o", "&": "a"}
SEPARATORS = "-_.*~'`"
SAME, LIKE, DROP, REPEAT = log(0.9), log(0.08), log(0.05), log(0.4)

_CLASS = np.full(256, SPACE, np.int64)
_CLASS[97:123] = np.arange(26)
_CLASS[65:91] = np.arange(26)
_CLASS[128:] = OTHER
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[65:91] = _LETTER[128:] = True
_LIKE = np.zeros(256, bool)
_LIKE[[ord(c) for c in RESEMBLES]] = True
_LIKES = [c.encode() for c in RESEMBLES]
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in RESEMBLES]] = True
_SIGN[[ord(c) for c in SEPARATORS]] = True


def _count(batches):
    total = np.zeros(SYMBOLS**ORDER, np.int64)
    for batch in batches:
        for b in K.blocks(batch.column("_text")):
            if not len(b.data):
                continue
            c = np.insert(_CLASS[b.data], b.offsets[:-1], SPACE)
            keep = np.ones(len(c), bool)
            keep[1:] = (c[1:] < OTHER) | (c[1:] != c[:-1])  # one space between words, one mark for the bytes of a letter
            c = c[keep]
            code = c[: max(0, len(c) - ORDER + 1)].copy()
            for i in range(1, ORDER):
                code = code * SYMBOLS + c[i : i + len(code)]
            if len(code):
                total += np.bincount(code, minlength=len(total))
    at = np.flatnonzero(total)
    if len(at):
        yield batch_of(gram=at.astype(np.int32), n=total[at])


class CharModel:
    """Interpolated 1- to 4-gram probabilities of characters."""

    def __init__(self, counts: np.ndarray):
        p = np.full(SYMBOLS, 1 / SYMBOLS)
        for n in range(1, ORDER + 1):
            c = counts.reshape((SYMBOLS,) * ORDER).sum(axis=tuple(range(ORDER - n))) if n < ORDER else counts.reshape((SYMBOLS,) * ORDER)
            whole = c.sum(-1, keepdims=True)
            kinds = (c > 0).sum(-1, keepdims=True) + 1
            p = (c + kinds * p) / (whole + kinds)
        self.log = np.log(p)

    def of(self, a: int, b: int, c: int, d: int) -> float:
        return self.log[a, b, c, d]


def language_model(documents: DataFrame, text_col: str = "text") -> np.ndarray:
    """4-gram counts over all texts."""
    texts = documents.select(F.col(text_col).cast("string").alias("_text")).filter("_text is not null")
    got = texts.mapInArrow(_count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SYMBOLS**ORDER)
    out[got["gram"].to_numpy()] = got["n"].to_numpy()
    return out


def _symbol(ch: str) -> int:
    return ord(ch) - 97 if "a" <= ch <= "z" else OTHER if ch.isalpha() else SPACE


def steps(text: str, spaced: bool = False) -> list[list[tuple[str, float]]]:
    """The lattice: what each character may stand for, and the channel's log-probability of that."""
    out, previous = [], ""
    for ch in text.lower():
        options: list[tuple[str, float]] = [(ch, SAME)]
        options += [(x, LIKE - log(len(RESEMBLES[ch]))) for x in RESEMBLES.get(ch, "")]
        if ch in SEPARATORS or (spaced and ch == " "):
            options.append(("", log(0.5) if spaced else DROP))
        if ch == previous:
            options.append(("", REPEAT))
        out.append(options)
        previous = ch
    return out


def viterbi(text: str, model: CharModel, spaced: bool = False) -> str:
    """The likeliest plain text of a disguised word; ``spaced``: single blanks may be part of the disguise too.

    A state is the last three symbols, so there are as many at most as three characters have readings, whatever the
    length; none is dropped. Paths share their beginnings, so memory grows with the length and not with its square.
    """
    states: dict[tuple, tuple[float, tuple | None]] = {(SPACE, SPACE, SPACE): (0.0, None)}
    for options in steps(text, spaced):
        new: dict[tuple, tuple[float, tuple | None]] = {}
        for (a, b, c), (score, path) in states.items():
            for x, channel in options:
                key, s = (a, b, c), score + channel
                if x:
                    d = _symbol(x)
                    if not (d == SPACE and c == SPACE):
                        s += model.of(a, b, c, d)
                        key = (b, c, d)
                if key not in new or s > new[key][0]:
                    new[key] = (s, (path, x) if x else path)
        states = new
    path = max(((s + model.of(a, b, c, SPACE) * (c != SPACE), path) for (a, b, c), (s, path) in states.items()), key=lambda x: x[0])[1]
    out = []
    while path:
        path, x = path
        out.append(x)
    return "".join(reversed(out))


class Restorer:
    MEMO, MAX_WORD = 200_000, 40  # longer words are decoded too, but not remembered

    def __init__(self, counts: np.ndarray):
        self.model, self.memo = CharModel(counts), {}

    def word(self, w: str, spaced: bool = False) -> str:
        got = self.memo.get(w)
        if got is None:
            if len(w) > 2 * self.MAX_WORD:
                return viterbi(w, self.model, spaced)
            if len(self.memo) >= self.MEMO:
                self.memo.clear()
            got = self.memo[w] = viterbi(w, self.model, spaced)
        return got

    def blocks(self, batch_texts) -> tuple[K.Block, np.ndarray]:
        """Blocks of restored texts, and how many places of each were restored."""
        for b in K.blocks(batch_texts):
            n = len(b.data)
            changed = np.zeros(b.rows, np.int64)
            if n > 3:
                data, letter = b.data, _LETTER[b.data]
                flag = np.zeros(n, bool)
                flag[:-1] = _SIGN[data[:-1]] & letter[1:]
                flag[:-2] |= (data[:-2] == data[1:-1]) & (data[1:-1] == data[2:]) & letter[:-2] & (data[:-2] < 128)
                w = K.words(b)
                if len(w.start):
                    inside = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[np.stack((w.start, w.end))], axis=0)[0]
                    mixed = (inside(_LIKE[data]) > 0) & (inside(letter) > 0)
                    last = self._runs(data, letter, w)
                    plain = ~(inside(flag) > 0) & (last < 0)  # disguised only if a sign of the word goes
                    at = np.flatnonzero(mixed | ~plain)
                    rows = np.searchsorted(w.first, at, "right") - 1
                    b, changed = self._rewrite(b, w, at, rows, last, plain)
            yield b, changed

    @staticmethod
    def _runs(data: np.ndarray, letter: np.ndarray, w: K.Words) -> np.ndarray:
        """Where a run of single letters and signs begins (three of them may be letters, two are), its last word; else -1."""
        head = data[w.start]
        single = (w.end - w.start == 1) & (letter[w.start] | _SIGN[head])
        begins = single.copy()
        begins[1:] &= ~single[:-1]
        first = w.first[w.first < len(single)]
        begins[first] = single[first]
        ends = np.append(begins[1:] | ~single[1:], True) & single
        start, end = np.flatnonzero(begins), np.flatnonzero(ends)
        some = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[np.stack((start, end + 1))], axis=0)[0]
        last = np.full(len(single), -1, np.int64)
        ok = (some(single & letter[w.start]) >= 2) & (some(single & (letter[w.start] | _LIKE[head])) >= 3)
        last[start[ok]] = end[ok]
        return last

    def _rewrite(self, b: K.Block, w: K.Words, at: np.ndarray, rows: np.ndarray, last: np.ndarray, plain: np.ndarray):
        changed = np.zeros(b.rows, np.int64)
        out, done = [], 0
        shift = np.zeros(b.rows, np.int64)
        for i, row in zip(at.tolist(), rows.tolist(), strict=True):
            start, end = int(w.start[i]), int(w.end[i])
            if start < done:
                continue
            spaced = bool(last[i] >= 0)
            if spaced:
                end = int(w.end[last[i]])
            old = b.data[start:end].tobytes()
            if spaced and len(set(old.lower().split())) == 1:
                continue
            new = self.word(" ".join(old.decode().split()) if spaced else old.decode(), spaced).encode()
            if plain[i] and sum(map(new.count, _LIKES)) == sum(map(old.count, _LIKES)):
                continue
            if new != old.lower():
                out += [b.data[done:start].tobytes(), new]
                done = end
                changed[row] += 1
                shift[row] += len(new) - (end - start)
        if not changed.any():
            return b, changed
        out.append(b.data[done:].tobytes())
        offsets = b.offsets + np.concatenate(([0], np.cumsum(shift)))
        return K.Block(b.first_row, np.frombuffer(b"".join(out), np.uint8), offsets, b.null), changed


def restorer_of(counts: np.ndarray) -> Restorer:
    """The restorer of this Python worker, whose memory of words later tasks find again."""
    return kept(("restorer", zlib.crc32(counts.tobytes())), lambda: Restorer(counts))


PREFIXES = (4, 5, 6)


def features(b: K.Block) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each distinct word and word beginning of each row, in lower case, signs at a word's ends left out."""
    data = K._LOWER[b.data]
    letter = _LETTER[data] | ((data >= 48) & (data < 58))
    masked = K.Block(b.first_row, np.where(letter, data, 32).astype(np.uint8), b.offsets, b.null)
    w = K.words(masked)
    if not len(w.start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row = w.row
    rows, hashes = [row], [K.word_hashes(masked, w)]
    for k in PREFIXES:
        long = w.end - w.start > k
        rows.append(row[long])
        part = K.Words(w.start[long], w.start[long] + k, w.first)
        hashes.append(K.mix(K.word_hashes(masked, part) + np.uint64(k)))
    return np.concatenate(rows), np.concatenate(hashes)


def _pairs(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash) and their counts."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return row[at], h[at], np.diff(np.append(at, len(h)))


def _feature_counts(counts):
    """(feature, toxic rows, other rows) of a task."""

    def run(batches):
        restorer, parts, n = restorer_of(counts.value), [], 0

        def summed():
            h, y = (np.concatenate(x) for x in zip(*parts, strict=True))
            u, inverse = np.unique(h, return_inverse=True)
            toxic = np.bincount(inverse, weights=y, minlength=len(u)).astype(np.int64)
            return batch_of(f=signed(u), toxic=toxic, other=np.bincount(inverse, minlength=len(u)) - toxic)

        for batch in batches:
            label = numpy(batch, "_label")
            for b, _ in restorer.blocks(batch.column("_text")):
                row, h, _ = _pairs(*features(b))
                parts.append((h, label[row + b.first_row]))
                n += len(h)
                if n >= 2_000_000:
                    yield summed()
                    parts, n = [], 0
        if n:
            yield summed()

    return run


def _sparse(counts, known):
    def run(batches):
        restorer, hashes = restorer_of(counts.value), known.value
        for batch in batches:
            ids, label = numpy(batch, "_id"), numpy(batch, "_label")
            for b, _ in restorer.blocks(batch.column("_text")):
                row, h, c = _pairs(*_known(*features(b), hashes))
                at = [(h[i:j], c[i:j]) for i, j in zip(np.searchsorted(row, np.arange(b.rows)), np.searchsorted(row, np.arange(b.rows), "right"), strict=True)]
                s = slice(b.first_row, b.first_row + b.rows)
                yield batch_of(id=ids[s], label=label[s], f=pa.array([np.searchsorted(hashes, x).astype(np.int32) for x, _ in at], pa.list_(pa.int32())), n=pa.array([y.astype(np.int32) for _, y in at], pa.list_(pa.int32())))

    return run


def _known(row: np.ndarray, h: np.ndarray, hashes: np.ndarray):
    if not len(hashes) or not len(h):
        return row[:0], h[:0]
    maybe = np.zeros(1 << 16, bool)
    maybe[hashes & np.uint64(0xFFFF)] = True
    at = np.flatnonzero(maybe[h & np.uint64(0xFFFF)])
    at = at[hashes[np.minimum(np.searchsorted(hashes, h[at]), len(hashes) - 1)] == h[at]]
    return row[at], h[at]


class ToxicModel:
    def __init__(self, counts: np.ndarray, hashes: np.ndarray, weights: np.ndarray, bias: float):
        self.counts, self.hashes, self.weights, self.bias = counts, hashes, weights, bias


def train(documents: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> ToxicModel:
    """``labels`` are those that may be learned from; language-model counts come from all ``documents``."""
    sc = documents.sparkSession.sparkContext
    counts = language_model(documents, text_col)
    shared = sc.broadcast(counts)
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_label"))
    rows = bounded_rows(id_and_text(documents, id_col, text_col), known, sample)
    n = {r[0]: r[1] for r in rows.groupBy("_label").count().collect()}
    toxic, other = n.get(1, 0), n.get(0, 0)
    prior = toxic / max(1, toxic + other)
    none = ToxicModel(counts, np.zeros(0, np.uint64), np.zeros(0), log(min(max(prior, 1e-4), 1 - 1e-4) / (1 - min(max(prior, 1e-4), 1 - 1e-4))))
    if not toxic or not other:
        return none
    by_feature = rows.mapInArrow(_feature_counts(shared), "f long, toxic long, other long").groupBy("f").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    lean = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("other") + 0.5) / (other + 1))
    best = by_feature.filter(f"toxic >= {MIN_TOXIC} and toxic * {other} > 2 * other * {toxic}").orderBy(F.desc(F.col("toxic") * lean), "f").limit(FEATURES).toArrow()
    hashes = np.sort(best["f"].to_numpy().view(np.uint64))
    if not len(hashes):
        return none
    got = rows.mapInArrow(_sparse(shared, sc.broadcast(hashes)), "id long, label int, f array<int>, n array<int>").toArrow().combine_chunks()
    y = got["label"].to_numpy().astype(float)
    f, c = got["f"].combine_chunks(), got["n"].combine_chunks()
    row = np.repeat(np.arange(len(y)), f.value_lengths().to_numpy(zero_copy_only=False))
    col, x = f.flatten().to_numpy(), _strength(c.flatten().to_numpy())
    size = len(hashes)

    def gradient(w):
        z = np.bincount(row, weights=x * w[col], minlength=len(y)) + w[size]
        d = (sigmoid(z) - y) / len(y)
        g = np.append(np.bincount(col, weights=x * d[row], minlength=size), d.sum())
        g[:size] += 1e-5 * w[:size]
        return g

    w = adam(gradient, size + 1, 600, 0.05)
    return ToxicModel(counts, hashes, w[:size], float(w[size]))


def _strength(n: np.ndarray) -> np.ndarray:
    return 1 + np.log(np.maximum(n, 1))


def _score(model):
    def run(batches):
        m = model.value
        restorer = restorer_of(m.counts)
        for batch in batches:
            for b, changed in restorer.blocks(batch.column("_text")):
                row, h, c = _pairs(*_known(*features(b), m.hashes))
                z = np.full(b.rows, m.bias)
                if len(h):
                    z += np.bincount(row, weights=_strength(c) * m.weights[np.searchsorted(m.hashes, h)], minlength=b.rows)
                s = slice(b.first_row, b.first_row + b.rows)
                texts = [b.text(i).decode() if changed[i] else None for i in range(b.rows)]
                yield batch_of(_id=batch.column("_id")[s], score=sigmoid(z), n_restored=changed, restored_text=pa.array(texts, pa.string()))

    return run


def score(documents: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, n_restored, restored_text); the text is null where nothing was restored."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    out = id_and_text(documents, id_col, text_col).mapInArrow(_score(shared), "_id long, score double, n_restored long, restored_text string")
    return out.select(public_id().alias(id_col), "score", "n_restored", "restored_text")


__all__ = ["ToxicModel", "fold", "language_model", "score", "train", "viterbi"]
