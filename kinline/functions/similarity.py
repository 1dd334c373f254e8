"""String similarities that Spark lacks, as Arrow functions; each is 0 where either text is empty."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, with a prefix bonus above 0.7."""
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, matched = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == ch:
                taken[j] = True
                matched.append(ch)
                break
    m = len(matched)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(matched, (ch for ch, t in zip(b, taken, strict=True) if t), strict=True)) // 2
    sim = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if sim > 0.7:
        same = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
        sim += 0.1 * same * (1 - sim)
    return sim


def common_length(a: str, b: str) -> int:
    """Longest common subsequence, bit-parallel."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    row = (1 << len(a)) - 1
    full = row
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    return 2 * common_length(a, b) / (len(a) + len(b)) if a and b else 0.0


def token_sort_ratio(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """Best ratio among the shared words and the shared words with either side's own."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_a, only_b = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_a or not only_b):
        return 1.0
    with_a, with_b = f"{both} {only_a}".strip(), f"{both} {only_b}".strip()
    return max(indel_ratio(both, with_a), indel_ratio(both, with_b), indel_ratio(with_a, with_b))


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text with a piece of the longer one of its length, or at an end."""
    if not a or not b:
        return 0.0
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    n = len(small)
    if small in large:
        return 1.0
    return max(indel_ratio(small, large[max(0, i) : i + n]) for i in range(1 - n, len(large)))


def _column(f, a: Column | str, b: Column | str) -> Column:
    def call(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([f(p or "", q or "") for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.float64())

    return F.arrow_udf(call, "double")(a, b)


def jaro_winkler_col(a, b) -> Column:
    return _column(jaro_winkler, a, b)


def indel_ratio_col(a, b) -> Column:
    return _column(indel_ratio, a, b)


def token_sort_col(a, b) -> Column:
    return _column(token_sort_ratio, a, b)


def token_set_col(a, b) -> Column:
    return _column(token_set_ratio, a, b)


def partial_ratio_col(a, b) -> Column:
    return _column(partial_ratio, a, b)
