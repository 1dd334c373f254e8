"""Exact deduplication through a cuckoo-filter index of live digests.

Texts are equal when identical after white space is deleted; of equal texts the row with the most code
points stays, then the one with the smallest id, then the one read first. Each task keeps a cuckoo filter
of 16-bit fingerprints; a hit is verified against the full digest kept in the same bucket slot, an insert
that finds no free slot within a bound of kicks makes the index rebuild at twice the size from its stored
keys, and digests whose groups have been sent on are deleted again.

Rows are dealt by digest and a salt, so a text that a third of all rows hold is shared by many tasks; what
is left of each (one row for a digest and salt) is merged by digest, and the verdict goes back to the same
salted places. Only digests travel, never texts.

Defined results: a null text is an empty one, and empty texts are equal to each other; a null id counts as
the smallest; rows equal in everything are still one group, of which one row is kept; every row of the
input is returned; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinline.llm import kernels as K
from kinline.llm.common import batch_of, id_and_text, materialize, public_id

WHITE = b" \t\n\x0b\x0c\r"
SALTS = 64
MAX_LIVE = 200_000  # digests that a task holds before it sends the oldest half on and deletes them; their groups are merged later


class CuckooIndex:
    """Digest -> value, with a cuckoo filter in front: insert, find, delete, and growth from stored keys."""

    SLOTS, MAX_KICKS = 4, 200

    def __init__(self, buckets: int = 256):
        self._make(buckets)
        self.live = self.resizes = self.false_hits = 0

    def _make(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = array("H", bytes(2 * buckets * self.SLOTS))
        self.keys: list[bytes | None] = [None] * (buckets * self.SLOTS)
        self.values: list = [None] * (buckets * self.SLOTS)

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") or 1
        one = int.from_bytes(digest[2:10], "little") & self.mask
        return mark, one, self._other(one, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def _slot(self, digest: bytes) -> int:
        mark, one, two = self._places(digest)
        for bucket in (one, two):
            for slot in range(bucket * self.SLOTS, (bucket + 1) * self.SLOTS):
                if self.prints[slot] == mark:
                    if self.keys[slot] == digest:
                        return slot
                    self.false_hits += 1
        return -1

    def find(self, digest: bytes):
        slot = self._slot(digest)
        return None if slot < 0 else self.values[slot]

    def insert(self, digest: bytes, value) -> None:
        """Puts a digest that isn't live, or replaces the value of one that is."""
        slot = self._slot(digest)
        if slot >= 0:
            self.values[slot] = value
            return
        while not self._place(digest, value):
            pass
        self.live += 1

    def _place(self, digest: bytes, value) -> bool:
        mark, one, two = self._places(digest)
        bucket = one
        for kick in range(self.MAX_KICKS):
            for b in (one, two) if not kick else (bucket,):
                for slot in range(b * self.SLOTS, (b + 1) * self.SLOTS):
                    if not self.prints[slot]:
                        self.prints[slot], self.keys[slot], self.values[slot] = mark, digest, value
                        return True
            slot = bucket * self.SLOTS + (mark + kick) % self.SLOTS
            mark, self.prints[slot] = self.prints[slot], mark
            digest, self.keys[slot] = self.keys[slot], digest
            value, self.values[slot] = self.values[slot], value
            bucket = self._other(bucket, mark)
        self._grow(digest, value)
        return True

    def _grow(self, digest: bytes, value) -> None:
        held = [(k, v) for k, v in zip(self.keys, self.values, strict=True) if k is not None] + [(digest, value)]
        self.resizes += 1
        self._make(2 * (self.mask + 1))
        for k, v in held:
            self._place(k, v)

    def delete(self, digest: bytes) -> bool:
        slot = self._slot(digest)
        if slot < 0:
            return False
        self.prints[slot], self.keys[slot], self.values[slot] = 0, None, None
        self.live -= 1
        return True

    def items(self) -> Iterator[tuple[bytes, object]]:
        return ((k, v) for k, v in zip(self.keys, self.values, strict=True) if k is not None)


DIGESTS = "_id long, _key long, _chars long, _digest binary"


def _digest(batches):
    for batch in batches:
        for b in K.blocks(batch.column("_text")):
            rows = slice(b.first_row, b.first_row + b.rows)
            # a code point has one byte that isn't a continuation
            heads = np.concatenate(([0], np.cumsum((b.data & 0xC0) != 0x80)))[b.offsets]
            digests = [hashlib.sha256(b.text(i).translate(None, WHITE)).digest() for i in range(b.rows)]
            yield batch_of(_id=batch.column("_id")[rows], _key=batch.column("_key")[rows], _chars=np.diff(heads).astype(np.int64), _digest=pa.array(digests, pa.binary()))


GROUPS = "_digest binary, chars long, keep long, row long, size long, salts long"


def _better(a: tuple, b: tuple) -> tuple:
    """The group of both: most code points, then smallest id, then first row; sizes add up, salts unite."""
    best = a if (-a[0], a[1], a[2]) <= (-b[0], b[1], b[2]) else b
    return (*best[:3], a[3] + b[3], a[4] | b[4])


def _batch(items: list) -> pa.RecordBatch:
    k, v = zip(*items, strict=True)
    chars, keep, row, size, salts = (np.array(x, np.uint64).view(np.int64) if i == 4 else np.array(x, np.int64) for i, x in enumerate(zip(*v, strict=True)))
    return batch_of(_digest=pa.array(k, pa.binary()), chars=chars, keep=keep, row=row, size=size, salts=salts)


def _through_index(batches, most: int):
    index, order = CuckooIndex(), []
    for batch in batches:
        for digest, value in _rows(batch):
            held = index.find(digest)
            if held is None:
                order.append(digest)
            index.insert(digest, value if held is None else _better(held, value))
            if index.live >= most:
                old, order = order[: most // 2], order[most // 2 :]
                yield _batch([(k, index.find(k)) for k in old])
                for k in old:
                    index.delete(k)
    items = list(index.items())
    for i in range(0, len(items), 50_000):
        yield _batch(items[i : i + 50_000])


def _rows(batch):
    cols = (batch.column(x).to_pylist() for x in ("_digest", "_chars", "_id", "_row", "_salt"))
    return ((d, (c, i, r, 1, 1 << s)) for d, c, i, r, s in zip(*cols, strict=True))


def _groups(batch):
    cols = (batch.column(x).to_pylist() for x in ("_digest", "chars", "keep", "row", "size", "salts"))
    return ((d, (c, i, r, n, s & 0xFFFFFFFFFFFFFFFF)) for d, c, i, r, n, s in zip(*cols, strict=True))


def _partial(most: int):
    return lambda batches: _through_index(batches, most)


def _merge(batches):
    """Of groups sorted by digest one for each: a digest that is followed by another is complete, is sent on and deleted from the index."""
    index, done, last = CuckooIndex(), [], None
    for batch in batches:
        for digest, value in _groups(batch):
            if digest != last and last is not None:
                done.append((last, index.find(last)))
                index.delete(last)
                if len(done) >= 50_000:
                    yield _batch(done)
                    done = []
            held = index.find(digest)
            index.insert(digest, value if held is None else _better(held, value))
            last = digest
    done += index.items()
    if done:
        yield _batch(done)


def digests(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Narrow rows, written once: row numbers that were given again, after an executor is lost, could be others."""
    docs = id_and_text(documents, id_col, text_col).withColumn("_key", F.xxhash64("_id", "_text"))
    out = docs.mapInArrow(_digest, DIGESTS).withColumn("_row", F.monotonically_increasing_id())
    return materialize(out).withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int"))


def verdicts(rows: DataFrame, max_live: int = MAX_LIVE) -> DataFrame:
    """(_digest, _salt, keep, row, size) of each group, once for every salt that it has rows of."""
    partial = rows.repartition("_digest", "_salt").mapInArrow(_partial(max_live), GROUPS)
    merged = partial.repartition("_digest").sortWithinPartitions("_digest").mapInArrow(_merge, GROUPS)
    salt = F.explode(F.expr(f"filter(sequence(0, {SALTS - 1}), s -> (shiftrightunsigned(salts, s) & 1) = 1)"))
    return merged.select("_digest", salt.alias("_salt"), F.col("keep").alias("_keep"), F.col("row").alias("_kept_row"), F.col("size").alias("_size"))


def exact_dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_live: int = MAX_LIVE) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256, key): one row for each row of the input; ``key`` is a hash of id and text."""
    rows = digests(documents, id_col, text_col)
    out = rows.join(verdicts(rows, max_live), ["_digest", "_salt"])
    return out.select(
        public_id().alias(id_col),
        public_id("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        (F.col("_row") == F.col("_kept_row")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
        F.col("_key").alias("key"),
    )
