"""Substring deduplication by difference-cover anchors.

A passage of ``size`` words is removed where its word sequence also starts earlier (smaller id, or the
same document further up). Hashing a window at every position and shuffling it would move the corpus
several times over. Instead:

1. *Anchors.* With a difference cover D modulo v, any two positions i, j have a shift k < v with i+k and
   j+k both in D modulo v. Windows of ``size - v + 1`` words are hashed at positions in D only; every
   passage of ``size`` words that occurs twice then has an anchor whose hash occurs twice.
2. *Chunks.* Windows of full size that hold a repeated anchor are candidates. Runs of candidates are cut
   at content-defined places; a run piece that also occurs earlier is settled as a whole.
3. *Windows.* Each candidate in the first occurrence of its piece is compared by a 96-bit hash with the
   others; all but the earliest are repeats.
4. Words under a repeated window go; the rest is joined by single spaces.

Each task settles its own repeats first and asks about one row per hash, so a passage that a third of all
documents hold sends one row per task, not one per document. What a task answers streams over sorted rows.
All steps stand in one plan; the exchange of texts by document is shared by them.

Defined results: a null text has no words (kept text is empty); a null id counts as the smallest; rows
equal in id and text are one document in comparisons and are all returned; of rows with the same id and
different texts the order is by a hash of the text; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinline.llm import kernels as K
from kinline.llm.common import batch_of, id_and_text, numpy, public_id, signed

FLUSH = 1_000_000  # hashes that a task holds before it settles its own repeats
CUT = np.uint64(31)  # a run is cut before windows whose hash has these bits clear


def difference_cover(period: int) -> list[int]:
    """A small set D with {a - b mod period} covering every residue, found by greedy search with backtracking."""
    size = 1
    while size * (size - 1) + 1 < period:
        size += 1
    for n in range(size, period + 1):
        if found := _extend([0, 1][:n], n, period):
            return found
    return list(range(period))


def _extend(have: list[int], size: int, period: int) -> list[int] | None:
    covered = {(a - b) % period for a in have for b in have}
    if len(covered) == period:
        return have
    left = size - len(have)
    if left <= 0 or len(covered) + sum(2 * (len(have) + i) for i in range(left)) < period:
        return None
    for x in range(have[-1] + 1, period):
        if found := _extend([*have, x], size, period):
            return found
    return None


def cover_for(size: int) -> tuple[int, list[int], int]:
    """(period, cover, anchor words): the longest period q*q+q+1 that leaves anchors of size/3 words at least."""
    period = max((q * q + q + 1 for q in (1, 2, 3, 5, 7) if size - q * q - q >= max(2, size // 3)), default=1)
    return period, difference_cover(period), size - period + 1


class _Asked:
    """Hashes of a task, settled block by block. Rows leave in the order of the texts, where neighbours are alike and compress well."""

    def __init__(self, names: str):
        self.names, self.parts, self.n = names.split(), [], 0

    def add(self, *columns: np.ndarray) -> None:
        if len(columns[0]):
            self.parts.append([x.astype(np.int32) if n in ("pos", "length") else x for n, x in zip(self.names, columns, strict=True)])
            self.n += len(columns[0])

    def _taken(self) -> dict[str, np.ndarray]:
        out = {n: np.concatenate(x) for n, x in zip(self.names, zip(*self.parts, strict=True), strict=True)}
        self.parts, self.n = [], 0
        return out

    def _rows(self, x: dict, state: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(state), 100_000):
            s = slice(i, i + 100_000)
            yield batch_of(**{n: signed(v[s]) if v.dtype == np.uint64 else v[s] for n, v in x.items()}, state=state[s])

    def members(self) -> Iterator[pa.RecordBatch]:
        """One question per hash; ``state`` 0 asks, 1 asks and is known to repeat, 2 is known to repeat."""
        if not self.n:
            return
        x = self._taken()
        order = np.argsort(x["h"], kind="stable")
        h = x["h"][order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        last = np.append(new[1:], True)
        state = np.empty(len(h), np.int8)
        state[order] = np.where(new & last, 0, np.where(new, 1, 2))
        yield from self._rows(x, state)

    def later(self) -> Iterator[pa.RecordBatch]:
        """The earliest row of each hash asks (state 0); the others are known to come later (2)."""
        if not self.n:
            return
        x = self._taken()
        order = np.lexsort((x["pos"], x["key"], x["doc"], x["c"], x["h"]))
        y = {n: v[order] for n, v in x.items()}
        new = np.ones(len(order), bool)
        new[1:] = (y["h"][1:] != y["h"][:-1]) | (y["c"][1:] != y["c"][:-1])
        head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        same = (y["doc"] == y["doc"][head]) & (y["key"] == y["key"][head]) & (y["pos"] == y["pos"][head])
        state = np.empty(len(order), np.int8)
        state[order] = np.where(new, 0, np.where(same, 3, 2))
        keep = state != 3
        yield from self._rows({n: v[keep] for n, v in x.items()}, state[keep])


ANCHORS, ANCHOR_ANSWER = "h long, key long, pos int, state byte", "key long, pos int"
WINDOWS, WINDOW_ANSWER = "h long, c int, doc long, key long, pos int, length int, state byte", "doc long, key long, pos int, length int"


def _full(x: np.ndarray, n: int) -> np.ndarray:
    """Hash per word, 0 where no whole window starts."""
    out = np.zeros(n, x.dtype)
    out[: len(x)] = x
    return out


def _anchors(size: int):
    period, cover, words = cover_for(size)
    at = np.zeros(period, bool)
    at[cover] = True

    def run(batches):
        asked = _Asked("h key pos")
        for batch in batches:
            key = numpy(batch, "_key")
            for b in K.blocks(batch.column("_text")):
                w = K.words(b)
                row = w.row
                pos = np.arange(len(row)) - w.first[row]
                # only what can lie in a window of full size
                take = at[pos % period] & K.window_mask(w, words) & (w.counts[row] >= size)
                h = _full(K.sequence_hashes(K.word_hashes(b, w), words), len(row))[take]
                asked.add(h, key[row[take] + b.first_row], pos[take])
                if asked.n >= FLUSH:
                    yield from asked.members()
        yield from asked.members()

    return run


def _repeated(batches):
    """Of rows sorted by hash: the place of each row that asked and whose hash occurs elsewhere too."""
    held: list | None = None  # the last row, which the next one may be like; state 3: it is known to repeat and not yet said

    for batch in batches:
        if not batch.num_rows:
            continue
        h, state, key, pos = (numpy(batch, x) for x in ("h", "state", "key", "pos"))
        if held is not None:
            h, state, key, pos = (np.concatenate((np.array([x], y.dtype), y)) for x, y in zip(held, (h, state, key, pos), strict=True))
        like = np.zeros(len(h), bool)  # like the row above
        like[1:] = h[1:] == h[:-1]
        twice = like | (state == 3)
        twice[:-1] |= like[1:]
        out = twice & ((state == 0) | (state == 3))
        held = [h[-1], 3 if out[-1] else state[-1], key[-1], pos[-1]]
        out[-1] = False
        if out.any():
            yield batch_of(key=key[out], pos=pos[out])
    if held is not None and held[1] == 3:
        yield batch_of(key=np.array([held[2]], np.int64), pos=np.array([held[3]], np.int32))


def _later(batches):
    """Of rows sorted by hash and place: all but the earliest of each hash."""
    head = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [numpy(batch, x) for x in ("h", "c", "doc", "key", "pos", "length")]
        if head is not None:
            cols = [np.concatenate((np.array([x], y.dtype), y)) for x, y in zip(head, cols, strict=True)]
        h, c, doc, key, pos, length = cols
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        out = ~new & ~((doc == doc[first]) & (key == key[first]) & (pos == pos[first]))
        head = tuple(x[first[-1]] for x in cols)
        if out.any():
            yield batch_of(doc=doc[out], key=key[out], pos=pos[out], length=length[out])


def _ask(asked: DataFrame, judge, order: list[str], answer: str) -> DataFrame:
    """Answers to the questions of all tasks: places of repeats."""
    open_ = asked.filter("state < 2").repartition("h").sortWithinPartitions(*order)
    told = open_.mapInArrow(judge, answer)
    return asked.filter("state >= 1").select(*told.columns).unionByName(told)


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A list column's values, and where each row's begin; a null is an empty list."""
    col = batch.column(name)
    sizes = np.nan_to_num(np.asarray(col.value_lengths().to_numpy(zero_copy_only=False), np.float64)).astype(np.int64)
    return col.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(sizes)))


def _marks(values: np.ndarray, ends: np.ndarray, lengths: np.ndarray | int, b: K.Block, w: K.Words) -> np.ndarray:
    """How many of the intervals [value, value + length) of its row hold each word."""
    lo, hi = ends[b.first_row], ends[b.first_row + b.rows]
    row = np.repeat(np.arange(b.rows), np.diff(ends[b.first_row : b.first_row + b.rows + 1]))
    n = len(w.start)
    start = w.first[row] + values[lo:hi]
    stop = start + (lengths if np.isscalar(lengths) else lengths[lo:hi])
    return np.cumsum(np.bincount(start, minlength=n + 1)[:n] - np.bincount(np.minimum(stop, n), minlength=n + 1)[:n])


def _candidates(batch, b: K.Block, w: K.Words, size: int, period: int, cols: dict) -> np.ndarray:
    """Windows of full size that hold a repeated anchor."""
    values, ends = cols["anchors"]
    # an anchor at p lies in the windows from p-period+1 to p
    lo, hi = ends[b.first_row], ends[b.first_row + b.rows]
    row = np.repeat(np.arange(b.rows), np.diff(ends[b.first_row : b.first_row + b.rows + 1]))
    p = w.first[row] + values[lo:hi]
    start = np.maximum(p - period + 1, w.first[row])
    n = len(w.start)
    near = np.cumsum(np.bincount(start, minlength=n + 1)[:n] - np.bincount(p + 1, minlength=n + 2)[:n])
    return (near > 0) & K.window_mask(w, size)


def _pieces(cand: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of candidates cut at content-defined places: (start, length)."""
    edge = cand.copy()
    edge[1:] &= ~cand[:-1] | ((h[1:] & CUT) == 0)
    start = np.flatnonzero(edge)
    stop_at = np.flatnonzero(~cand)
    stop = np.minimum(np.append(start[1:], len(cand)), np.append(stop_at, len(cand))[np.searchsorted(stop_at, start)])
    return start, stop - start


def _windows(size: int, whole_pieces: bool):
    period, _, _ = cover_for(size)

    def run(batches):
        asked = _Asked("h c doc key pos length")
        for batch in batches:
            doc, key = numpy(batch, "_id"), numpy(batch, "_key")
            cols = {"anchors": _lists(batch, "anchors")}
            if not whole_pieces:
                settled, settled_ends = _lists(batch, "piece_pos")
                settled_len, _ = _lists(batch, "piece_len")
            for b in K.blocks(batch.column("_text")):
                w = K.words(b)
                n = len(w.start)
                if not n:
                    continue
                row = w.row
                cand = _candidates(batch, b, w, size, period, cols)
                wh = K.word_hashes(b, w)
                h = _full(K.sequence_hashes(wh, size), n)
                if whole_pieces:
                    start, length = _pieces(cand, h)
                    if not len(start):
                        continue
                    up, down = K._WORDS2.take(n + 1)
                    sums = np.concatenate(([np.uint64(0)], np.cumsum(h * up[:n])))
                    x = K.mix((sums[start + length] - sums[start]) * down[start] + length.astype(np.uint64))
                    check = (K.mix(h[start] ^ x) >> np.uint64(33)).astype(np.int32)
                else:
                    start = np.flatnonzero(cand & (_marks(settled, settled_ends, settled_len, b, w) == 0))
                    length = np.ones(len(start), np.int32)
                    x = h[start]
                    check = (_full(K.sequence_hashes(wh, size, second=True), n)[start] >> np.uint64(33)).astype(np.int32)
                r = row[start]
                asked.add(x, check, doc[r + b.first_row], key[r + b.first_row], start - w.first[r], length)
                if asked.n >= FLUSH:
                    yield from asked.later()
        yield from asked.later()

    return run


RESULT = "_id long, n_words long, n_removed long, kept_text string, removed array<struct<start:int,end:int>>"


def _keep(size: int):
    schema = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            pieces, piece_ends = _lists(batch, "piece_pos")
            piece_len, _ = _lists(batch, "piece_len")
            single, single_ends = _lists(batch, "window_pos")
            for b in K.blocks(batch.column("_text")):
                w = K.words(b)
                gone = (_marks(pieces, piece_ends, piece_len + (size - 1), b, w) + _marks(single, single_ends, size, b, w)) > 0
                kept, spans, removed = [], [], []
                for i in range(b.rows):
                    mask = gone[w.first[i] : w.first[i + 1]]
                    tokens = b.text(i).split()
                    if mask.any():
                        edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
                        spans.append([{"start": int(s), "end": int(e)} for s, e in edges.reshape(-1, 2)])
                        tokens = compress(tokens, ~mask)
                    else:
                        spans.append([])
                    removed.append(int(mask.sum()))
                    kept.append(b" ".join(tokens).decode())
                rows = slice(b.first_row, b.first_row + b.rows)
                yield batch_of(_id=batch.column("_id")[rows], n_words=w.counts.astype(np.int64), n_removed=np.array(removed, np.int64), kept_text=pa.array(kept, pa.string()), removed=pa.array(spans, schema))

    return run


def _own(answers: str, **fields: str):
    """Fields of the answers that concern this very row: other rows could have the same 64-bit key."""
    own = F.filter(answers, lambda x: x["doc"] == F.col("_id"))
    get = lambda f: lambda x: x[f]
    return [F.transform(own, get(f)).alias(name) for name, f in fields.items()]


def substring_dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 20) -> DataFrame:
    """(id, n_words, n_removed, kept_text, removed): ``removed`` has word intervals [start, end) of the input text."""
    docs = id_and_text(documents, id_col, text_col).withColumn("_key", F.xxhash64("_id", "_text"))
    anchors = docs.filter("_text is not null").mapInArrow(_anchors(size), ANCHORS)
    repeated = _ask(anchors, _repeated, ["h"], ANCHOR_ANSWER).groupBy(F.col("key").alias("_key")).agg(F.collect_list("pos").alias("anchors"))
    found = docs.join(repeated, "_key")
    earlier = ["h", "c", "doc", "key", "pos"]
    pieces = _ask(found.mapInArrow(_windows(size, whole_pieces=True), WINDOWS), _later, earlier, WINDOW_ANSWER)
    pieces = pieces.groupBy(F.col("key").alias("_key")).agg(F.collect_list(F.struct("doc", "pos", "length")).alias("_pieces"))
    rest = found.join(pieces, "_key", "left").select("_id", "_key", "_text", "anchors", *_own("_pieces", piece_pos="pos", piece_len="length"))
    single = _ask(rest.mapInArrow(_windows(size, whole_pieces=False), WINDOWS), _later, earlier, WINDOW_ANSWER)
    single = single.groupBy(F.col("key").alias("_key")).agg(F.collect_list(F.struct("doc", "pos", "length")).alias("_windows"))
    out = docs.join(pieces, "_key", "left").join(single, "_key", "left")
    out = out.select("_id", "_text", *_own("_pieces", piece_pos="pos", piece_len="length"), *_own("_windows", window_pos="pos")).mapInArrow(_keep(size), RESULT)
    return out.select(public_id().alias(id_col), "n_words", "n_removed", "kept_text", "removed")
