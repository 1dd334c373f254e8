"""N-gram Jaccard join: exact links and classes of documents whose shingle sets are alike.

Two sets link when 100 * |A and B| >= 80 * |A or B| (the percentage is a parameter). Sets are joined by size:

* *Small sets* (up to a boundary) enumerate subsets: A and B share the subset "A and B", whose size is at
  least 80 % of either, so each set emits all its subsets of 80 % of its size or more. Of the sets that hold
  a subset S, whatever links by way of S also links with the smallest of them, so that one's star is enough:
  no pairs, and no verification.
* *Large sets* scan inverted lists. In one global order of shingles, rare before common, two linked sets
  share one of their first n - ceil(0.8 n) + 1. Each set is first compared with one pivot, the first member
  of most of its lists, lists being ordered by the place of the shingle in the set: of near copies the one with
  the fewest shingles of its own comes first, which is the one that most others link with. Then, for a few rounds, one
  member of each class with the first of each list of more than two that has several classes. What is still in different
  classes meets list by list, but only where the places of the shared shingle in both sets leave room for enough others
  after it; a linked pair always has that room at the first shingle that it shares. That leaves few pairs that don't link,
  and loses none that does.
* The *boundary* is the size with the least estimated cost, from a histogram of set sizes.

Equal sets count as one node from the start. A node is known by 64 bits of hash; sets whose 64 bits are equal
but whose next 64 differ get nodes of their own, so that two sets are one only if 128 bits agree. Tasks settle
their own lists first and send one row for each list, so a shingle in a third of all documents sends one row
for each task. The order of shingles is by a sketch of fixed size that counts all shingles of the input; any
order gives the same links. Texts are read for the profile, the subsets and the lists, and once for each of the at most
four comparisons that has pairs: parity sketches of about one bit for each shingle rule out those that are too far apart, and never
a link, before any text is shuffled; only texts of the pairs that are left are.


Defined results: a null or empty text has no shingles, is a class of its own and linked with nothing; texts
of fewer than ``words`` words have one shingle; a null id counts as the smallest and shows as null; rows may
repeat, also ids, and each is returned; other columns of the input are ignored.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinline.llm import kernels as K
from kinline.llm.common import batch_of, discard, id_and_text, lean, materialize, numpy, public_id, signed
from kinline.llm.components import connected_components, hot_keys, lookup, merged
from kinline.session import shuffles_go

FLUSH, HELD = 1_000_000, 250_000  # shingles that a task gathers before it settles or counts them
BLOCK = 1 << 18  # bytes of text whose hashes are held at a time; some 50 times as much
BUCKETS, CHUNK = 22, 16  # bits of the sketch of shingle counts, and of one row of it
SEEN = 500_000  # nodes that a task remembers to pass over equal sets
MAX_BOUNDARY = 16
BLOOM_BITS = 26
ROUNDS = 2  # of comparing one member of each class with the first of each list; what they leave is compared exactly
MAX_CLASHES = 1_000_000  # sets at most that share 64 bits of hash with another (some 300 expected among 10**11)


def shingle_sets(b: K.Block, words: int):
    """(row, sorted distinct 64-bit shingle hashes) of the rows that have a word."""
    w = K.words(b)
    h = K.word_hashes(b, w, lower=True)
    s = K.sequence_hashes(h, words)
    short = (w.counts < words) & (w.counts > 0)
    whole = K.whole_hashes(h, w.first) if short.any() else None
    for i in range(b.rows):
        n = int(w.first[i + 1] - w.first[i])
        if n >= words:
            x = np.sort(s[w.first[i] : w.first[i + 1] - words + 1])
            if len(x) > 1:
                x = x[np.concatenate(([True], x[1:] != x[:-1]))]
            yield i, x
        elif n:
            yield i, whole[i : i + 1]


def set_hash(x: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """Two 64-bit hashes of a set; of the first one only ``bits`` count (fewer than 64 are for tests of clashes)."""
    sums = [K.mix(x + np.uint64(c)).sum(dtype=np.uint64) + np.uint64(len(x)) for c in (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)]
    node, check = K.mix(np.array(sums)).view(np.int64).tolist()
    return node >> (64 - bits), check


def node_of(x: np.ndarray, bits: int, clashes: dict) -> int:
    node, check = set_hash(x, bits)
    return clashes.get((node, check), node) if clashes else node


def least_overlap(n: int, percent: int) -> int:
    """Of a set of n with any set that it links with."""
    return -(-percent * n // 100)


def sketch(x: np.ndarray) -> bytes:
    """Parity of the number of shingles in each of about as many buckets; see ``sketch_distance``."""
    size = 1 << max(6, (len(x) - 1).bit_length())
    odd = np.bincount((x & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """Buckets of different parity: never more than the shingles that only one of the sets has."""
    if len(a) < len(b):
        a, b = b, a
    x, size = int.from_bytes(a, "little"), 8 * len(a)
    while size > 8 * len(b):
        size >>= 1
        x = (x & ((1 << size) - 1)) ^ (x >> size)
    return (x ^ int.from_bytes(b, "little")).bit_count()


PROFILE = "kind byte, x long, y long, n int, node long, check long, sketch binary"


def _bucket(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(64 - BUCKETS)).astype(np.int64)


def _profile(words: int, bits: int):
    """Kind 0: (id, key, set size, node) of each row. Kind 1: counts of the shingles of the task's different sets, by bucket, in rows of 2**CHUNK buckets."""

    def run(batches):
        lean()
        seen: set[tuple[int, int]] = set()
        held, n_held = [], 0
        counts = np.zeros(1 << BUCKETS, np.uint32)

        def add():
            u, c = np.unique(_bucket(np.concatenate(held)), return_counts=True)
            counts[u] += c.astype(np.uint32)

        for batch in batches:
            ids, keys = numpy(batch, "_id"), numpy(batch, "_key")
            for b in K.blocks(batch.column("_text"), BLOCK):
                n, node, check, sketches = np.zeros(b.rows, np.int32), np.zeros(b.rows, np.int64), np.zeros(b.rows, np.int64), [None] * b.rows
                for i, x in shingle_sets(b, words):
                    node[i], check[i] = known = set_hash(x, bits)
                    n[i], sketches[i] = len(x), sketch(x)
                    if known not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(known)
                        held.append(x)
                        n_held += len(x)
                at = slice(b.first_row, b.first_row + b.rows)
                yield batch_of(kind=np.zeros(b.rows, np.int8), x=ids[at], y=keys[at], n=n, node=node, check=check, sketch=pa.array(sketches, pa.binary()))
                if n_held >= HELD:
                    add()
                    held, n_held = [], 0
        if held:
            add()
        rows = [(i, _pack_counts(part)) for i, part in enumerate(counts.reshape(-1, 1 << CHUNK)) if part.any()]
        if rows:
            z = np.zeros(len(rows), np.int64)
            yield batch_of(kind=np.ones(len(rows), np.int8), x=np.array([i for i, _ in rows], np.int64), y=z, n=z.astype(np.int32), node=z, check=z, sketch=pa.array([r for _, r in rows], pa.binary()))

    return run


def _pack_counts(part: np.ndarray) -> bytes:
    """Counts of up to 255 for each bucket; only those that aren't 0, with their places, where that is shorter."""
    at = np.flatnonzero(part)
    few = np.minimum(part[at], 255).astype(np.uint8)
    if 3 * len(at) < len(part):
        return b"s" + at.astype("<u2").tobytes() + few.tobytes()
    return b"d" + np.minimum(part, 255).astype(np.uint8).tobytes()


def _unpack_counts(row: bytes) -> tuple[np.ndarray, np.ndarray]:
    if row[:1] == b"d":
        return np.arange(1 << CHUNK), np.frombuffer(row, np.uint8, offset=1)
    n = (len(row) - 1) // 3
    return np.frombuffer(row, "<u2", n, 1).astype(np.int64), np.frombuffer(row, np.uint8, n, 1 + 2 * n)


def _add_counts(batches):
    """(chunk, levels): sums of a chunk's counts over all tasks, as 16-bit logarithms."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, row in zip(batch.column("x").to_pylist(), batch.column("sketch").to_pylist(), strict=True):
            at, n = _unpack_counts(row)
            np.add.at(sums.setdefault(i, np.zeros(1 << CHUNK, np.int64)), at, n)
    for i, n in sums.items():
        yield batch_of(chunk=np.array([i], np.int64), levels=pa.array([np.floor(256 * np.log2(1 + n)).astype("<u2").tobytes()], pa.binary()))


def shingle_levels(profile: DataFrame) -> np.ndarray:
    """How common the shingles of each of 2**BUCKETS buckets are: 8 MB, whatever the input's size."""
    out = np.zeros((1 << (BUCKETS - CHUNK), 1 << CHUNK), np.uint16)
    with shuffles_go(profile.sparkSession):
        rows = profile.filter("kind = 1").select("x", "sketch").repartition("x").mapInArrow(_add_counts, "chunk long, levels binary").collect()  # 64 rows at most
    for r in rows:
        out[r["chunk"]] = np.frombuffer(r["levels"], "<u2")
    return out.ravel()


LISTS = "kind byte, h long, node long, n int, pos int, pivot long"
MEMBERS = "h long, node long, n int, pos int, pivot long"


def prefix(x: np.ndarray, n: int, levels: np.ndarray) -> np.ndarray:
    """The first n of a sorted set in the global order: by level of the bucket, then by hash."""
    return x[np.argsort(levels[_bucket(x)], kind="stable")[:n]]


def _lists(words: int, percent: int, boundary: int, levels, bits: int, clashes):
    """Prefix shingles of large sets, settled within the task: kind 0 asks, 1 asks and has company, 2 has a pivot already."""

    def settle(h, node, n, pos):
        order = np.lexsort((node, n, pos, h))
        h, node, n, pos = h[order], node[order], n[order], pos[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        pivot = node[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
        kind = np.where(new, np.where(np.append(new[1:], True), 0, 1), 2).astype(np.int8)
        keep = new | (node != pivot)
        back = np.argsort(order[keep])  # in the order of the texts, where neighbours are alike
        for i in range(0, len(back), 100_000):
            s = np.flatnonzero(keep)[back[i : i + 100_000]]
            yield batch_of(kind=kind[s], h=signed(h[s]), node=node[s], n=n[s], pos=pos[s], pivot=pivot[s])

    def run(batches):
        lean()
        order, clash = levels.value, clashes.value
        seen: set[int] = set()
        parts, total = [], 0
        for batch in batches:
            for b in K.blocks(batch.column("_text"), BLOCK):
                for _, x in shingle_sets(b, words):
                    size = len(x)
                    if 100 * size <= percent * boundary:
                        continue
                    node = node_of(x, bits, clash)
                    if node in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(node)
                    p = prefix(x, size - least_overlap(size, percent) + 1, order)
                    parts.append((p, np.full(len(p), node), np.full(len(p), size, np.int32), np.arange(len(p), dtype=np.int32)))
                    total += len(p)
                if total >= FLUSH:
                    yield from settle(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                    parts, total = [], 0
        if parts:
            yield from settle(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    return run


def _no_room(x: dict, new: np.ndarray, percent: int) -> np.ndarray:
    """Of rows of lists, of which the first and the last may be cut: those that no other row of their list can link with, by the bounds of ``_mixed``.

    A list of which a task has settled members (kind 1) isn't whole here, and is left as it is.
    """
    n = x["n"].astype(np.int64)
    room = (100 + percent) * (n - x["pos"]) - percent * n
    first = np.flatnonzero(new)
    if not len(first):
        return np.zeros(len(n), bool)
    size = np.diff(np.append(first, len(n)))
    whole = np.maximum.reduceat(x["kind"], first) == 0
    whole[-1] = False
    at = np.repeat(np.arange(len(first)), size)
    two, row = (size == 2)[at], np.arange(first[0], len(n))
    other = np.where(two, 2 * first[at] + 1 - row, row)
    other_n = np.where(two, n[other], np.minimum.reduceat(n, first)[at])
    other_room = np.where(two, room[other], np.maximum.reduceat(room, first)[at])
    out = np.zeros(len(n), bool)
    out[first[0] :] = whole[at] & ~((room[row] >= percent * other_n) & (other_room >= percent * n[row]))
    return out


def _meet(percent: int):
    """Of lists sorted by shingle, its place in the set, set size and node: members of those with company, each with the list's first as its pivot.

    Members of a list without room for a link with another of it have no company there.
    """

    def run(batches):
        head = None  # of the last list: its first row, and whether that has been said to have company
        row = lambda x, at: batch_of(**{c: np.atleast_1d(x[c][at]) for c in ("h", "node", "n", "pos", "pivot")})
        for batch in batches:
            if not batch.num_rows:
                continue
            x = {c: numpy(batch, c) for c in ("kind", "h", "node", "n", "pos")}
            goes_on = head is not None and x["h"][0] == head[0]["h"]
            new = np.append(not goes_on, x["h"][1:] != x["h"][:-1])
            stays = ~_no_room(x, new, percent)  # the last list does, and one that goes on
            x, new = {c: v[stays] for c, v in x.items()}, np.append(False, x["h"][stays][1:] != x["h"][stays][:-1])
            new[0] = not goes_on
            node = x["node"]
            first = np.maximum.accumulate(np.where(new, np.arange(len(node)), -1))
            x["pivot"] = np.where(first >= 0, node[first], head[0]["node"] if goes_on else 0)
            out = ~new & (node != x["pivot"])
            firsts = np.unique(first[out])
            if len(firsts) and firsts[0] < 0:  # a first row of the batch before, which asked alone, has company now
                if head[0]["kind"] == 0 and not head[1]:
                    yield row({c: np.atleast_1d(v) for c, v in head[0].items()}, slice(None))
                head, firsts = (head[0], True), firsts[1:]
            take = out.copy()
            take[firsts[x["kind"][firsts] == 0]] = True
            if take.any():
                yield row(x, take)
            i = first[-1]
            if i >= 0:
                head = ({c: v[i] for c, v in x.items()}, bool(out[i:].any()))

    return run


def _subsets(words: int, percent: int, boundary: int, bits: int, clashes):
    """(subset hash of 128 bits, its size, set size, node) of the small sets."""

    def run(batches):
        lean()
        for batch in batches:
            for b in K.blocks(batch.column("_text"), BLOCK):
                key, key2, size, n, node = [], [], [], [], []
                for _, x in shingle_sets(b, words):
                    if len(x) > boundary:
                        continue
                    y, me = K.mix(x + np.uint64(0xA0761D6478BD642F)), node_of(x, bits, clashes.value)
                    z = K.mix(x + np.uint64(0xE7037ED1A0B428DB))
                    for k in range(least_overlap(len(x), percent), len(x) + 1):
                        at = np.array(list(combinations(range(len(x)), k)))
                        key.append(K.mix(y[at].sum(1, dtype=np.uint64) + np.uint64(k)))
                        key2.append(K.mix(z[at].sum(1, dtype=np.uint64)))
                        size += [k] * len(at)
                        n += [len(x)] * len(at)
                        node += [me] * len(at)
                if key:
                    yield batch_of(key=signed(np.concatenate(key)), key2=signed(np.concatenate(key2)), size=np.array(size, np.int32), n=np.array(n, np.int32), node=np.array(node, np.int64))

    return run


def _verify(words: int, percent: int):
    """Of pairs with both texts: those that link."""

    def run(batches):
        lean()
        last: tuple = (None, None)
        for batch in batches:
            a, bb = numpy(batch, "a"), numpy(batch, "b")
            left = batch.column("text_a")
            for b in K.blocks(batch.column("text_b"), BLOCK):
                keep = []
                for i, y in shingle_sets(b, words):
                    r = b.first_row + i
                    if last[0] != a[r]:
                        (blk,) = K.blocks(left[r : r + 1])
                        last = (a[r], next(iter(shingle_sets(blk, words)), (0, np.zeros(0, np.uint64)))[1])
                    x = last[1]
                    small, large = (x, y) if len(x) < len(y) else (y, x)
                    place = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    both = int((large[place] == small).sum())
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        keep.append(r)
                if keep:
                    yield batch_of(a=a[keep], b=bb[keep])

    return run


def _near(percent: int):
    """Of pairs with both sketches: those that may link; none that links is lost."""

    def run(batches):
        for batch in batches:
            n = (numpy(batch, "n_a").astype(np.int64) + numpy(batch, "n_b")) * (100 - percent)
            apart = [sketch_distance(a, b) for a, b in zip(batch.column("sketch_a").to_pylist(), batch.column("sketch_b").to_pylist(), strict=True)]
            yield batch.filter(pa.array((100 + percent) * np.array(apart, np.int64) <= n)).select(["a", "b"])

    return run


def subset_rows(n: int, percent: int) -> int:
    return sum(comb(n, k) for k in range(least_overlap(n, percent), n + 1))


def choose_boundary(sizes: dict[int, int], percent: int, verify_cost: float = 4.0) -> int:
    """The boundary with the least estimated rows: subsets of small sets, list entries and their verification of large ones."""

    def cost(boundary: int) -> float:
        lists = sum(c * (n - least_overlap(n, percent) + 1) * (1 + verify_cost) for n, c in sizes.items() if 100 * n > percent * boundary)
        return lists + sum(c * subset_rows(n, percent) for n, c in sizes.items() if n <= boundary)

    return min(range(1, MAX_BOUNDARY + 1), key=cost)


def _bloom(rows: DataFrame, col: str) -> np.ndarray:
    """A Bloom filter of fixed size (8 MB) over a column of longs."""
    bit = F.explode(F.array(*[F.pmod(F.xxhash64(F.col(col), F.lit(k)), F.lit(1 << BLOOM_BITS)) for k in range(3)]))
    words = rows.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).cast("int").alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("w"))
    out = np.zeros(1 << (BLOOM_BITS - 6), np.int64)
    got = words.toArrow()
    out[got["i"].to_numpy()] = got["w"].to_numpy()
    return out


def _in_bloom(bloom, key: str, columns: list[str]):
    """Rows whose key may be in the filter, each key once for a task (as far as it remembers)."""

    def run(batches):
        words, seen = bloom.value, set()
        for batch in batches:
            hit = np.ones(batch.num_rows, bool)
            for k in range(3):
                bit = numpy(batch, f"_b{k}")
                hit &= (words[bit >> 6].view(np.uint64) >> (bit & 63).astype(np.uint64)) & np.uint64(1) > 0
            for i, k in zip(np.flatnonzero(hit), numpy(batch, key)[hit].tolist(), strict=True):
                hit[i] = k not in seen
                seen.add(k)
            if len(seen) > SEEN:
                seen.clear()
            yield batch.filter(pa.array(hit)).select(columns)

    return run


def _clashes(nodes: DataFrame, bits: int) -> dict:
    """(node, check) -> another node, for sets that share their first hash with a different set."""
    shared = nodes.groupBy("node").agg(F.count("*").alias("c"), F.min("check").alias("least")).filter("c > 1")
    others = nodes.join(shared, "node").filter("check != least").select("node", "check").limit(MAX_CLASHES + 1).collect()
    if len(others) > MAX_CLASHES:
        raise RuntimeError("too many different sets have equal hashes")
    fresh = lambda node, check: int(K.mix(np.array([(check ^ (node * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF], np.uint64))[0].view(np.int64))
    return {(r[0], r[1]): fresh(*r) for r in others}


def _renamed(rows: DataFrame, clashes: dict) -> DataFrame:
    """``node`` of rows with (node, check) after ``_clashes``; those are few by ``MAX_CLASHES``."""
    if not clashes:
        return rows.drop("check")
    fresh = rows.sparkSession.createDataFrame([(*k, v) for k, v in clashes.items()], "node long, check long, fresh long")
    return rows.join(F.broadcast(fresh), ["node", "check"], "left").withColumn("node", F.coalesce("fresh", "node")).drop("check", "fresh")


def _mixed(placed: DataFrame, percent: int, *more: str) -> DataFrame:
    """Members of lists with several classes, without those that have no room for a link with any other of their list.

    Sets of n and m link by way of a shingle at places i and j only if ``room`` of each, (100 + percent) * (n - i) - percent * n,
    is at least percent * the other's size. In a list of two that is tested with the other member, in longer ones with
    the least size and the most room of the list, which are bounds for any member. ``more``: ``c``, how many members the list had.
    """
    n = F.col("n").cast("long")
    placed = placed.withColumn("room", (100 + percent) * (n - F.col("pos")) - percent * n)
    lists = placed.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c"), F.sum(n).alias("all_n"), F.sum("room").alias("all_room"), F.min(n).alias("least"), F.max("room").alias("most"))
    # a list whose members have no room for its smallest set has no link
    lists = lists.filter(f"lo != hi and most >= {percent} * least").withColumnRenamed("h", "list")
    other_n = F.when(F.col("c") == 2, F.col("all_n") - n).otherwise(F.col("least"))
    other_room = F.when(F.col("c") == 2, F.col("all_room") - F.col("room")).otherwise(F.col("most"))
    may = (F.col("room") >= percent * other_n) & (other_room >= percent * n)
    return placed.join(lists, (F.col("h") == F.col("list")) & may).select("h", "node", "n", "pos", "comp", *more)


def jaccard_classes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, hash_bits: int = 64) -> DataFrame:
    """(id, n_shingles, component_id, class_node, key) of each row. ``component_id`` is the smallest id that links reach; ``class_node``
    names the class (null without shingles), ``key`` is a hash of id and text."""
    spark = documents.sparkSession
    docs = id_and_text(documents, id_col, text_col).withColumn("_key", F.xxhash64("_id", "_text"))
    full = docs.filter("_text is not null")
    profile = materialize(docs.mapInArrow(_profile(words, hash_bits), PROFILE))
    sets = profile.filter("kind = 0 and n > 0").groupBy("node", "check").agg(F.min(F.struct(F.col("x").alias("_id"), F.col("y").alias("_key"))).alias("first"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    sets = materialize(sets)
    clashes = _clashes(sets, hash_bits)
    nodes = _renamed(sets, clashes)
    rows = profile.filter("kind = 0").select(F.col("x").alias("_id"), F.col("y").alias("_key"), "n", "node", "check")

    sizes = {r[0]: r[1] for r in rows.filter(f"n between 1 and {2 * MAX_BOUNDARY}").groupBy("n").count().collect()}
    boundary = choose_boundary(sizes, percent)
    common = spark.sparkContext.broadcast(shingle_levels(profile))
    shared = spark.sparkContext.broadcast(clashes)

    small = materialize(full.mapInArrow(_subsets(words, percent, boundary, hash_bits, shared), "key long, key2 long, size int, n int, node long").distinct())
    heads = small.groupBy("key", "key2").agg(F.min(F.struct("n", "node")).alias("head"), F.count("*").alias("c")).filter("c > 1")
    exact = small.join(heads, ["key", "key2"]).filter(f"head.node != node and {100 + percent} * size >= {percent} * (n + head.n)").select(F.col("head.node").alias("a"), F.col("node").alias("b")).distinct()

    asked = full.mapInArrow(_lists(words, percent, boundary, common, hash_bits, shared), LISTS)
    met = asked.filter("kind < 2").select("kind", "h", "node", "n", "pos").repartition("h").sortWithinPartitions("h", "pos", "n", "node").mapInArrow(_meet(percent), MEMBERS)
    members = materialize(asked.filter("kind > 0").select("h", "node", "n", "pos", "pivot").unionByName(met))
    stars = members.filter("pivot != node").groupBy("node", "pivot").agg(F.count("*").alias("c")).groupBy("node").agg(F.max(F.struct("c", "pivot")).alias("best"))
    tried = materialize(stars.select(F.least("best.pivot", "node").alias("a"), F.greatest("best.pivot", "node").alias("b")).distinct())
    links = materialize(_linked(docs, nodes, tried, words, percent).unionByName(exact))
    labels = connected_components(links)

    # the lists whose members are in several classes still
    placed = members.select("h", "node", "n", "pos").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    apart = materialize(_mixed(placed, percent, "c").select("h", "node", "n", "pos", "c").distinct())
    long = apart.filter("c > 2")  # a list of two is one pair, which is compared once at the end
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))

    def may_link(x: str, y: str):
        """Sizes fit, and both sets have room for enough shared shingles from this one on."""
        n, m, i, j = (F.col(f"{s}.{c}") for c in ("n", "pos") for s in (x, y))
        return (percent * n <= 100 * m) & (percent * m <= 100 * n) & ((100 + percent) * F.least(n - i, m - j) >= percent * (n + m))

    for _ in range(ROUNDS):
        # one member of each class against the list's first: merges what belongs together with few comparisons
        placed = long.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        heads = placed.groupBy("h", "comp").agg(F.min(F.struct("pos", "n", "node")).alias("x"))
        firsts = heads.groupBy("h").agg(F.min(F.struct("x.pos", "x.n", "x.node", "comp")).alias("f"))
        meet = lookup(heads, "h", firsts, hot=hot_keys(long, "h")["h"]).filter((F.col("comp") != F.col("f.comp")) & may_link("x", "f"))
        some = meet.select(*pair("comp", "f.comp"), F.struct(*[c.alias(n) for c, n in zip(pair("x.node", "f.node"), "pq", strict=True)]).alias("m"))
        some = some.groupBy("a", "b").agg(F.min("m").alias("m")).select(F.col("m.p").alias("a"), F.col("m.q").alias("b")).distinct()
        some = materialize(some.join(tried, ["a", "b"], "left_anti"))
        if not some.limit(1).count():
            break
        tried = materialize(tried.unionByName(some))
        more = _linked(docs, nodes, some, words, percent)
        if not more.limit(1).count():
            break
        labels = merged(labels, more)

    # whatever is left in different classes is compared exactly, list by list, wherever there is room for a link
    placed = apart.drop("c").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    placed = materialize(_mixed(placed, percent))  # both sides of the join read it
    one, two = placed.alias("one"), placed.alias("two")
    rest = one.join(two, (F.col("one.h") == F.col("two.h")) & (F.col("one.comp") < F.col("two.comp")) & may_link("one", "two"))
    rest = materialize(rest.select(*pair("one.node", "two.node")).distinct().join(tried, ["a", "b"], "left_anti"))
    if rest.limit(1).count():
        labels = merged(labels, _linked(docs, nodes, rest, words, percent))

    own = nodes.join(labels, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"), F.col("first._id").alias("least"))
    class_id = own.groupBy("comp").agg(F.min("least").alias("component"))
    verdict = materialize(lookup(own, "comp", class_id, hot=hot_keys(labels, "comp")["comp"]).select("node", "component", "comp"))
    discard(members, tried, links, apart, placed, rest, small)
    # a node can have a third of all rows; rows without shingles have none
    full_rows = lookup(_renamed(rows.filter("n > 0"), clashes), "node", verdict, hot=hot_keys(rows.filter("n > 0"), "node")["node"])
    empty = rows.filter("n = 0").select("_id", "_key", "n", F.lit(None).cast("long").alias("component"), F.lit(None).cast("long").alias("comp"))
    return full_rows.select("_id", "_key", "n", "component", "comp").unionByName(empty).select(
        public_id().alias(id_col),
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") == 0, public_id()).otherwise(public_id("component")).alias("component_id"),
        F.col("comp").alias("class_node"),
        F.col("_key").alias("key"),
    )


def _texts(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, _text) of the wanted nodes, by one scan of the documents; the others are left out before anything is shuffled."""
    need = materialize(nodes.join(wanted, "node").select("node", F.col("first._id").alias("_id"), F.col("first._key").alias("_key")))
    found = _maybe(docs.filter("_text is not null").select("_id", "_key", "_text"), need, "_key")
    # rows may repeat; with the join's keys, these are left out where the join has put them
    texts = materialize(found.join(need, ["_key", "_id"]).dropDuplicates(["_key", "_id", "node"]).select("node", "_text"))
    discard(need)
    return texts


def _maybe(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows (with texts) whose key is among the wanted, and some others, by a Bloom filter of fixed size; no shuffle."""
    bloom = rows.sparkSession.sparkContext.broadcast(_bloom(wanted, key))
    bits = [F.pmod(F.xxhash64(F.col(key), F.lit(k)), F.lit(1 << BLOOM_BITS)).alias(f"_b{k}") for k in range(3)]
    return rows.select(*rows.columns, *bits).mapInArrow(_in_bloom(bloom, key, rows.columns), rows.schema)


def _linked(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs of nodes that link: first by sketches, which lose none, then exactly by the texts of those that are left."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    hot = hot_keys(pairs, "a", "b")
    near = materialize(lookup(lookup(pairs, "a", side("a"), hot=hot["a"]), "b", side("b"), hot=hot["b"]).mapInArrow(_near(percent), "a long, b long"))
    if not near.limit(1).count():
        return near
    ends = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
    texts = _texts(docs, nodes, ends)
    hot = hot_keys(near, "a", "b")
    with_a = lookup(near, "a", texts.select(F.col("node").alias("a"), F.col("_text").alias("text_a")), hot=hot["a"])
    both = lookup(with_a, "b", texts.select(F.col("node").alias("b"), F.col("_text").alias("text_b")), hot=hot["b"])
    linked = materialize(both.select("a", "b", "text_a", "text_b").mapInArrow(_verify(words, percent), "a long, b long"))
    discard(near, texts)
    return linked
