"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

Words are lower-cased in ASCII; shingles are five words (an item of fewer words is one shingle, and so is a
window of its size). A window of as many words as an item (or a whole document that has fewer) matches the
item if the weighted Jaccard similarity of their shingles, weights being counts, is at least 0.8.

A match shares a shingle, so windows without any shingle of an item of that length are passed over. The 128-bit
SimHash of each other window is looked up among the items of its length. Fingerprints are cut into blocks; two
within the radius are within radius // blocks in at least one of them, so looking up all values of each block that
are so near misses none. The number of blocks is the one with the least estimated cost for the number of items,
one block being a plain scan of all fingerprints. What is found is verified exactly. At similarity 0.8 fingerprints of
texts without repeated shingles differ in 19.4 of 128 bits on average with a standard deviation of 4.1, and in more
than the radius of 36 about twice in 100,000. SimHash doesn't hold for repeated shingles, whose weight may be anything:
windows and items that have some are compared exactly with whatever shares enough shingles with them.

Items are taken in blocks of about ``ITEM_BYTES`` of text (each block is broadcast and all documents pass by it), so
any number of items works. Documents are never shuffled.

Defined results: null and empty texts or items match nothing; rows, ids and items may repeat and each match
is reported for each row; null ids show as null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinline.llm import kernels as K
from kinline.llm.common import batch_of, id_and_text, public_id

ITEM_BYTES = 8_000_000
BITS, RADIUS = 128, 36
MOST_BLOCK = 16  # bits of a block, whose table has an entry for each value
WINDOWS = 4_096  # fingerprints at a time
WORDS = 5
SIMILARITY = 0.8


def _bits(x: np.ndarray) -> np.ndarray:
    """BITS values of 1 or -1 for each hash."""
    both = np.stack((x, K.mix(x ^ np.uint64(0x9E3779B97F4A7C15))), axis=1)
    return np.unpackbits(both.view(np.uint8).reshape(-1, BITS // 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def simhashes(shingles: np.ndarray, size: int) -> np.ndarray:
    """Of each run of ``size`` shingles, as two 64-bit numbers."""
    sums = np.concatenate((np.zeros((1, BITS), np.int32), np.cumsum(_bits(shingles), axis=0)))
    return np.packbits(sums[size:] - sums[:-size] > 0, axis=1, bitorder="little").view(np.uint64)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def _ball(bits: int, radius: int) -> int:
    return sum(comb(bits, i) for i in range(min(bits, radius) + 1))


def choose_blocks(n: int, radius: int = RADIUS) -> int:
    """The number of blocks with the least cost of a query among n fingerprints: table lookups and fingerprints met. One block is a scan."""

    def cost(blocks: int) -> float:
        if blocks == 1:
            return n
        near = [_ball(w, radius // blocks) / 2**w * n + 0.25 * _ball(w, radius // blocks) for w in _widths(blocks)]
        return sum(near)

    return min((b for b in range(1, radius + 2) if b == 1 or max(_widths(b)) <= MOST_BLOCK), key=cost)


def _widths(blocks: int) -> list[int]:
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    return [hi - lo for lo, hi in zip(edges[:-1], edges[1:], strict=True)]


class MultiIndex:
    """Fingerprints by the value of each of some blocks of their bits."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS, blocks: int | None = None):
        self.prints, self.radius, self.met = prints, radius, 0  # ``met``: fingerprints compared so far
        n = blocks or choose_blocks(len(prints), radius)
        self.blocks = []
        if n == 1:
            return
        at = 0
        for width in _widths(n):
            value = self._value(prints, at, width)
            order = np.argsort(value, kind="stable")
            flips = np.array([sum(1 << i for i in c) for k in range(radius // n + 1) for c in combinations(range(width), k)], np.int64)
            self.blocks.append((at, width, order, np.searchsorted(value[order], np.arange((1 << width) + 1)), flips))
            at += width

    @staticmethod
    def _value(prints: np.ndarray, at: int, width: int) -> np.ndarray:
        bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(-1, BITS // 8), axis=1, bitorder="little")[:, at : at + width]
        return bits.astype(np.int64) @ (1 << np.arange(width))

    def find(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, item): all pairs within the radius."""
        found, n = [np.zeros(0, np.int64)], len(self.prints)
        step = max(1, 4_000_000 // max(1, n if not self.blocks else max(len(b[4]) for b in self.blocks)))
        for i in range(0, len(queries), step):
            part = queries[i : i + step]
            if not self.blocks:
                self.met += n * len(part)
                q, item = np.nonzero(distance(part[:, None], self.prints[None]) <= self.radius)
                found.append((q + i) * n + item)
            for at, width, order, first, flips in self.blocks:
                value = (self._value(part, at, width)[:, None] ^ flips).ravel()
                c = first[value + 1] - first[value]
                some = np.flatnonzero(c)
                q, c, start = np.repeat(some // len(flips), c[some]), c[some], first[value[some]]
                item = order[np.repeat(start - (np.cumsum(c) - c), c) + np.arange(len(q))]
                self.met += len(q)
                near = distance(part[q], self.prints[item]) <= self.radius
                found.append((q[near] + i) * n + item[near])
        code = np.unique(np.concatenate(found))
        return code // n, code % n


class _Size(NamedTuple):
    """Items of one number of words."""

    items: list[int]  # places in the block of those without a repeated shingle
    index: MultiIndex
    repeats: set[int]  # places of the others


class Items:
    """A block of benchmark items, ready for lookups."""

    def __init__(self, rows: list[tuple[int, str | None]], words: int = WORDS):
        self.ids, self.words, self.shingles = [r[0] for r in rows], words, []
        lengths = []
        for _, text in rows:
            (b,) = K.blocks(pa.array([text or ""]))
            w = K.words(b)
            h = K.word_hashes(b, w, lower=True)
            n = len(h)
            lengths.append(n)
            self.shingles.append(K.sequence_hashes(h, min(n, words)) if n else np.zeros(0, np.uint64))
        self.lengths = np.array(lengths, np.int64)
        sets = [np.unique(x, return_counts=True) for x in self.shingles]
        self.sets = sets
        self.sizes: dict[int, _Size] = {}
        for n in np.unique(self.lengths[self.lengths > 0]).tolist():
            at = np.flatnonzero(self.lengths == n).tolist()
            repeats = {i for i in at if (sets[i][1] > 1).any()}
            once = [i for i in at if i not in repeats]
            prints = np.concatenate([np.zeros((0, 2), np.uint64), *(simhashes(self.shingles[i], len(self.shingles[i])) for i in once)])
            self.sizes[n] = _Size(once, MultiIndex(prints), repeats)
        # shingle -> the items that have it, by size of shingle
        self.by_words = {}
        for k in {min(n, words) for n in self.sizes}:
            pairs = sorted({(int(s), i) for i in range(len(rows)) if min(self.lengths[i], words) == k for s in sets[i][0]})
            keys = np.array([p[0] for p in pairs], np.uint64)
            maybe = np.zeros(1 << 20, bool)
            maybe[keys & np.uint64((1 << 20) - 1)] = True
            self.by_words[k] = (keys, np.array([p[1] for p in pairs], np.int64), maybe)

    def similarity(self, window: np.ndarray, item: int) -> float:
        """Weighted Jaccard; the window's shingles may be in any order."""
        keys, counts = self.sets[item]
        place = np.minimum(np.searchsorted(keys, window), len(keys) - 1)
        both = int(np.minimum(np.bincount(place[keys[place] == window], minlength=len(keys)), counts).sum())
        return both / (len(window) + int(counts.sum()) - both)

    def matches(self, b: K.Block, least: float = SIMILARITY) -> Iterator[tuple[int, int, float, int, int]]:
        """(row, item, similarity, first word, words) of the best window for each row and item that match."""
        w = K.words(b)
        if not len(w.start):
            return
        h = K.word_hashes(b, w, lower=True)
        for k, (keys, of, maybe) in self.by_words.items():
            s = K.sequence_hashes(h, k)
            at = np.flatnonzero(maybe[s & np.uint64((1 << 20) - 1)] & K.window_mask(w, k)[: len(s)])
            left, right = np.searchsorted(keys, s[at]), np.searchsorted(keys, s[at], "right")
            n = right - left
            place = np.repeat(at, n)
            item = of[np.repeat(left, n) + np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)]
            size, row = self.lengths[item], np.searchsorted(w.first, place, "right") - 1
            order = np.lexsort((place, size, row))
            place, item, size, row = place[order], item[order], size[order], row[order]
            if not len(row):
                continue
            edge = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (size[1:] != size[:-1]))))
            for i, j in zip(edge, [*edge[1:], len(row)], strict=True):
                r, m = int(row[i]), int(size[i])
                yield from self._row(s, k, r, m, place[i:j], item[i:j], int(w.first[r]), int(w.first[r + 1]), least)

    def _row(self, s, k: int, row: int, m: int, hits, hit_items, first: int, end: int, least: float):
        sized = self.sizes[m]
        take = min(m, end - first) - k + 1  # shingles of a window
        last = end - k + 1 - take  # where the last window may start
        windows = np.arange(first, last + 1)
        with_hit = _within(hits, windows, take) > 0
        repeated = _within(_again(s[first : last + take], take) + first, windows, take) > 0
        best: dict[int, tuple] = {}

        def verify(item: int, at: int) -> None:
            sim = self.similarity(s[at : at + take], item)
            if sim >= least and (sim, -at) > best.get(item, (0, 0)):
                best[item] = (sim, -at)

        starts = windows[with_hit & ~repeated]
        runs = np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1) if sized.items else []
        for run in (r[i : i + WINDOWS] for r in runs for i in range(0, len(r), WINDOWS)):
            prints = simhashes(s[run[0] : run[-1] + take], take)
            for q, x in zip(*sized.index.find(prints), strict=True):
                verify(sized.items[x], int(run[q]))
        # repeated shingles, on either side: whatever shares enough of them
        exact = np.unique(hit_items) if repeated.any() else np.array(sorted(sized.repeats & set(hit_items.tolist())), np.int64)
        for item in exact.tolist():
            shared = _within(hits[hit_items == item], windows, take)
            enough = shared * (1 + least) >= least * (take + len(self.shingles[item])) - 1e-9
            for at in windows[enough & (repeated | (item in sized.repeats))].tolist():
                verify(item, at)
        for item, (sim, at) in best.items():
            yield row, item, sim, -at - first, take + k - 1


def _within(places: np.ndarray, windows: np.ndarray, take: int) -> np.ndarray:
    """How many of the sorted places each window of ``take`` from its start on holds."""
    return np.searchsorted(places, windows + take) - np.searchsorted(places, windows)


def _again(x: np.ndarray, reach: int) -> np.ndarray:
    """Places whose value has been there less than ``reach`` places before: every window with a repeat holds one, and maybe some without."""
    order = np.argsort(x, kind="stable")
    same = x[order][1:] == x[order][:-1]
    near = same & (np.diff(order) < reach)
    return np.sort(order[1:][near])


MATCHES = "_id long, item_id long, similarity double, first_word long, n_words long"


def _find(items, least: float):
    def run(batches):
        its = items.value
        for batch in batches:
            ids = batch.column("_id")
            for b in K.blocks(batch.column("_text")):
                found = list(its.matches(b, least))
                if found:
                    row, item, sim, at, n = (np.array(x) for x in zip(*found, strict=True))
                    yield batch_of(_id=ids.take(pa.array(row + b.first_row)), item_id=pa.array([its.ids[i] for i in item], pa.int64()), similarity=sim.astype(float), first_word=at.astype(np.int64), n_words=n.astype(np.int64))

    return run


def item_blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> Iterator[Items]:
    """Blocks of items by a hash, of about ``ITEM_BYTES`` of text each; an empty benchmark is one empty block."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("t"), F.lit(0)) + 16)).first()[0] or 0
    n = max(1, -(-size // ITEM_BYTES))
    for k in range(n):
        part = rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) if n > 1 else rows
        yield Items(sorted(((r.i, r.t) for r in part.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")))


def find_matches(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id, item_id, similarity, first_word, n_words): the best window of each document for each item that it holds."""
    docs = id_and_text(documents, id_col, text_col)
    out = None
    for items in item_blocks(benchmark):
        part = docs.mapInArrow(_find(documents.sparkSession.sparkContext.broadcast(items), similarity), MATCHES)
        out = part if out is None else out.unionByName(part)
    return out.select(public_id().alias(id_col), "item_id", "similarity", "first_word", "n_words")


def clean_documents(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of documents that hold no item, with all their columns."""
    for items in item_blocks(benchmark):
        shared = documents.sparkSession.sparkContext.broadcast(items)

        def holds(texts: pa.Array, shared=shared) -> pa.Array:
            out = np.zeros(len(texts), bool)
            for b in K.blocks(texts):
                out[[m[0] + b.first_row for m in shared.value.matches(b, similarity)]] = True
            return pa.array(out)

        documents = documents.filter(~F.arrow_udf(_one_argument(holds), "boolean")(F.col(text_col).cast("string")))
    return documents


def _one_argument(f):
    def call(x: pa.Array) -> pa.Array:
        return f(x)

    return call
