"""Edge rows and brute force for the deduplication operators, decontamination and the pipeline."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from kinline.llm import kernels as K
from kinline.llm import ngram_jaccard as J
from kinline.llm.common import materialize
from kinline.llm.components import connected_components, merged
from kinline.llm.decontamination import Items, MultiIndex, find_matches, simhashes
from kinline.llm.exact_dedup import CuckooIndex, exact_dedup
from kinline.llm.ngram_jaccard import _meet, _mixed, _pack_counts, _unpack_counts, jaccard_classes, prefix, sketch, sketch_distance
from kinline.llm.substring_dedup import cover_for, difference_cover, substring_dedup

SCHEMA = "doc_id long, text string, n_words long, kept string, _id long, h long"  # with names that clash
LOW = -(1 << 63)
key = lambda x: LOW if x is None else x


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 7, "z", 1, 2) for i, t in rows], SCHEMA).repartition(3)


def corpus(seed: int):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(60)}"
    passage = [word() for _ in range(33)]
    rows = [(None, "a b c"), (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "x " * 90), (6, "ä ö ü " * 20)]
    base = [[word() for _ in range(rng.choice([6, 12, 40, 90]))] for _ in range(8)]
    for i in range(40):
        x = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            x[rng.randrange(len(x))] = f"n{rng.randrange(999)}"
        if i % 4 == 0:
            x[3:3] = passage
        rows.append((10 + i, rng.choice([" ", "\n"]).join(x)))
    return [*rows, rows[12], rows[12], (rows[13][0], "other text of a repeated id")]


def test_difference_cover():
    for v in (1, 3, 7, 13, 31):
        d = difference_cover(v)
        assert {(a - b) % v for a in d for b in d} == set(range(v))
    assert cover_for(20) == (13, [0, 1, 3, 9], 8)


def test_word_kernel():
    import pyarrow as pa

    texts = ["a b", "", None, "  x\x0by z ", "ß" * 3, "\x1c q"]
    (b,) = K.blocks(pa.array(texts))
    w = K.words(b)
    got = [[b.data[w.start[i] : w.end[i]].tobytes().decode() for i in range(w.first[r], w.first[r + 1])] for r in range(b.rows)]
    assert got == [re.findall("[^\x20\x09-\x0d]+", t or "") for t in texts]


@pytest.mark.parametrize("seed", [1, 2])
def test_substring(spark, seed):
    rows = [r for r in corpus(seed) if r[1] != "other text of a repeated id"]
    seen, expected = {}, {}
    for i, t in sorted(set(rows), key=lambda r: key(r[0])):
        ws = re.findall("[^\x20\x09-\x0d]+", t or "")
        gone = set()
        for p in range(len(ws) - 19):
            if seen.setdefault(tuple(ws[p : p + 20]), (i, p)) != (i, p):
                gone |= set(range(p, p + 20))
        expected[i] = (len(ws), len(gone), " ".join(w for j, w in enumerate(ws) if j not in gone))
    got = substring_dedup(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_removed, r.kept_text) == expected[r.doc_id]
        assert sum(s.end - s.start for s in r.removed) == r.n_removed


def test_cuckoo_index():
    index, live = CuckooIndex(2), {}
    rng = random.Random(3)
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for d in rng.choices(digests, k=9000):
        if rng.random() < 0.3:
            assert index.delete(d) == (live.pop(d, None) is not None)
        else:
            live[d] = rng.random()
            index.insert(d, live[d])
    assert index.live == len(live) and dict(index.items()) == live and index.resizes > 3
    assert all(index.find(d) == live.get(d) for d in digests)


def test_exact_with_deletion(spark):
    """Tasks that may hold four digests at a time send groups on, delete them and meet them again."""
    rows = [(i, f"text {i % 37}" + " " * (i % 5)) for i in range(400)]
    got = exact_dedup(docs(spark, rows), max_live=4).collect()
    assert len(got) == 400 and sum(r.kept for r in got) == 37
    for r in got:
        same = [(-len(t), i) for i, t in rows if i % 37 == r.doc_id % 37]
        assert (r.keep_id, r.group_size) == (min(same)[1], len(same))


def test_exact(spark):
    rows = [*corpus(5), (90, "a bc"), (91, "ab  \n c"), (92, "abc"), (93, "ab c    ")]
    norm = lambda t: re.sub("[\x20\x09-\x0d]", "", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), key(i)))
    got = exact_dedup(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.text_sha256, []).append(r)
    for n, members in groups.items():
        found = by[hashlib.sha256(n.encode()).hexdigest()]
        assert len(found) == len(members) and sum(r.kept for r in found) == 1
        assert {(key(r.keep_id), r.group_size) for r in found} == {(min(members)[1], len(members))}


@pytest.mark.parametrize("seed", [1, 2])
def test_classes(spark, seed):
    rows = corpus(seed)

    def shingles(t):
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])

    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 80 * len(sets[a] | sets[b]):
            up[root(a)] = root(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), 1 << 62), key(d))
    expected = sorted((key(d), len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows))
    got = sorted((key(r.doc_id), r.n_shingles, key(r.component_id)) for r in jaccard_classes(docs(spark, rows)).collect())
    assert got == expected


def test_classes_where_hashes_clash(spark):
    """With five bits of hash most sets share theirs with others, and are still told apart."""
    rows = corpus(4)
    see = lambda bits: sorted((key(r.doc_id), r.n_shingles, key(r.component_id)) for r in jaccard_classes(docs(spark, rows), hash_bits=bits).collect())
    assert see(5) == see(64)


def test_prefix_of_the_global_order():
    rng = np.random.default_rng(0)
    levels = rng.integers(0, 50, 1 << 22).astype(np.uint16)
    x = np.sort(rng.integers(0, 2**63, 400, dtype=np.uint64) * np.uint64(2))
    want = sorted(x.tolist(), key=lambda h: (int(levels[h >> 42]), h))
    assert prefix(x, 90, levels).tolist() == want[:90]
    for part in (rng.integers(0, 2, 1 << 16).astype(np.uint32), (rng.random(1 << 16) < 0.01).astype(np.uint32) * 999):
        at, n = _unpack_counts(_pack_counts(part))
        out = np.zeros(1 << 16, np.int64)
        out[at] = n
        assert (out == np.minimum(part, 255)).all()


def test_sketch_never_overstates():
    rng = np.random.default_rng(1)
    for _ in range(200):
        pool = rng.integers(0, 2**63, 900, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 800))) for _ in range(2))
        assert sketch_distance(sketch(a), sketch(b)) <= len(np.setxor1d(a, b))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7)]
    got = {r.node: r.comp for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    rng = random.Random(9)
    edges = [(0, i) for i in range(1, 1500)] + [(rng.randrange(2000, 4000), rng.randrange(2000, 4000)) for _ in range(900)]
    want = {i: i for e in edges for i in e}
    while True:
        after = dict(want)
        for a, b in edges:
            after[a] = after[b] = min(after[a], after[b])
        if after == want:
            break
        want = after
    half = len(edges) // 2
    one = connected_components(spark.createDataFrame(edges[:half], "a long, b long"))
    got = {r.node: r.comp for r in merged(one, spark.createDataFrame(edges[half:], "a long, b long")).collect()}
    group = lambda labels: {frozenset(i for i in labels if labels[i] == c) for c in set(labels.values())}
    lone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert group({i: c for i, c in got.items() if i not in lone}) == group({i: c for i, c in want.items() if i not in lone})


@pytest.mark.parametrize(("n", "blocks"), [(300, None), (300, 1), (300, 8), (300, 13), (300, 37)])
def test_multi_index_is_complete(n, blocks):
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 2**63, (n, 2), dtype=np.uint64)
    near = prints[:50].copy()
    for p in near:
        for bit in rng.choice(128, rng.integers(0, 46), replace=False):
            p[bit // 64] ^= np.uint64(1 << int(bit % 64))
    q, item = MultiIndex(prints, blocks=blocks).find(near)
    brute = {(i, j) for i in range(50) for j in range(n) if sum(int(x).bit_count() for x in near[i] ^ prints[j]) <= 36}
    assert len(brute) > 30 and set(zip(q.tolist(), item.tolist(), strict=True)) == brute
    assert simhashes(prints[:20, 0], 5).shape == (16, 2)


def test_multi_index_prunes_many_items():
    """A query meets far fewer fingerprints than there are where there are many, and each once where there are few."""
    rng = np.random.default_rng(4)
    for n, share in ((50, 1.0), (400_000, 0.4)):
        index = MultiIndex(rng.integers(0, 2**63, (n, 2), dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, (n, 2), dtype=np.uint64))
        index.find(rng.integers(0, 2**63, (3, 2), dtype=np.uint64))
        assert index.met <= share * 3 * n


def test_recall_at_the_threshold():
    """Windows that match with a similarity of 0.8 to 0.82, with and without repeated shingles, against brute force."""
    rng = random.Random(5)
    seen = total = 0
    for t in range(120):
        item = [f"w{rng.randrange(9000)}" for _ in range(60)]
        if t % 3 == 0:
            item[40:] = ["again"] * 20
        window = list(item)
        for at in ([20, 21] if t % 3 else [30, 31, 32]) if t % 2 else [3]:
            window[at] = "changed"
        if t % 3 == 0:
            window[-3:] = ["other"] * 3
        sh = lambda x: collections.Counter(tuple(x[i : i + 5]) for i in range(len(x) - 4))
        a, b = sh(item), sh(window)
        both = sum((a & b).values())
        if both >= 0.8 * sum((a | b).values()):
            total += 1
            (blk,) = K.blocks(pa.array([" ".join(window)]))
            seen += bool(list(Items([(1, " ".join(item))]).matches(blk)))
    assert total > 40 and seen == total


def test_decontamination(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(5000)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 3, 14, 30, 59])] + [(8, None), (9, "")]
    filler = lambda: [word() for _ in range(40)]
    rows = [(None, items[3][1]), (1, None), (2, ""), (3, "x"), (4, " ".join(filler()))]
    rows += [(10 + i, " ".join(filler() + t.upper().split() + filler())) for i, t in items[1:5]]
    broken = items[4][1].split()
    broken[30] = "changed"
    rows += [(20, " ".join(broken)), (21, " ".join(items[4][1].split()[:20])), (22, items[3][1]), (22, items[3][1])]
    got = sorted((key(r.doc_id), r.item_id, round(r.similarity, 6)) for r in find_matches(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect() if r.item_id)
    assert got == [(LOW, 3, 1.0), (11, 1, 1.0), (12, 2, 1.0), (13, 3, 1.0), (14, 4, 1.0), (20, 4, round(50 / 60, 6)), (22, 3, 1.0), (22, 3, 1.0)]
    assert find_matches(docs(spark, rows), spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert find_matches(docs(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert list(Items([(1, "a b c d e f")]).matches(next(K.blocks(__import__("pyarrow").array(["q " * 50])))) ) == []


def test_empty_tables(spark):
    none = docs(spark, [(1, "x")]).filter("false")
    for f in (substring_dedup, exact_dedup, jaccard_classes):
        assert f(none).count() == 0


def test_mixed_lists_keep_every_pair_with_room(spark):
    """Of random lists: both members of every pair that may link stay, and of a list of two nothing else does."""
    rng = random.Random(5)
    rows = []
    for h in range(300):
        for node in rng.sample(range(1000), rng.choice([1, 2, 2, 3, 6])):
            n = rng.randint(17, 60)
            rows.append((h, node, n, rng.randint(0, n // 5), node % 7))
    got = {tuple(r) for r in _mixed(spark.createDataFrame(rows, "h long, node long, n int, pos int, comp long"), 80).collect()}
    room = lambda x, y: 180 * min(x[2] - x[3], y[2] - y[3]) >= 80 * (x[2] + y[2])
    lists = {}
    for r in rows:
        lists.setdefault(r[0], []).append(r)
    need = {x for members in lists.values() for x in members if any(x[4] != y[4] and room(x, y) for y in members)}
    assert need and need <= got <= set(rows)
    assert all(r in need for r in got if len(lists[r[0]]) == 2)


def _met(rows, cuts):
    """Members that ``_meet`` gives for (kind, h, node, n, pos), in batches cut at some places."""
    rows = sorted(rows, key=lambda r: (r[1], r[4], r[3], r[2]))
    types = ("int8", "int64", "int64", "int32", "int32")
    batches = [pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in rows[x:y]], t) for i, (c, t) in enumerate(zip(("kind", "h", "node", "n", "pos"), types, strict=True))}) for x, y in itertools.pairwise([0, *sorted(cuts), len(rows)])]
    return [tuple(r.values()) for b in _meet(80)(iter(batches)) for r in b.to_pylist()]


@pytest.mark.parametrize("seed", range(4))
def test_lists_pass_on_members_with_room(seed):
    """Wherever batches are cut, both members of a pair that may link are passed on, or known from their task; most others aren't."""
    rng = random.Random(seed)
    rows = []
    for h in range(400):
        for node in rng.sample(range(1000), rng.choice([1, 2, 2, 2, 3, 6])):
            n = rng.randint(17, 200)
            rows.append((int(rng.random() < 0.05), h, node, n, rng.randint(0, n // 5)))
    got = _met(rows, rng.sample(range(len(rows)), rng.choice([0, 3, 40])))
    lists = {}
    for r in rows:
        lists.setdefault(r[1], []).append(r)
    may = lambda x, y: 180 * min(x[3] - x[4], y[3] - y[4]) >= 80 * (x[3] + y[3])
    need = {x[1:] for m in lists.values() for x, y in itertools.permutations(m, 2) if may(x, y)}
    known = {r[1:] for r in rows if r[0]}  # these go another way as well
    found = {r[:4] for r in got}
    assert need <= found | known and len(got) == len(found)
    assert found <= {r[1:] for m in lists.values() if len(m) > 1 for r in m}
    alone = [m for m in lists.values() if len(m) == 2 and not any(r[0] for r in m) and not may(*m)]
    assert len([m for m in alone if m[0][1:] in found or m[1][1:] in found]) <= 41 < len(alone)  # at most one list for each batch


def test_tables_between_steps_leave_no_shuffle_files(spark):
    open_ = lambda: spark._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()
    before = open_()
    table = materialize(spark.range(1000).selectExpr("id % 700 AS k").groupBy("k").count())
    assert open_() <= before and table.count() == 700


def test_texts_of_chance_company_stay_where_they_are(spark, monkeypatch):
    """Sets that share a passage but are far apart by their sketches have their texts shuffled in no comparison."""
    asked = []
    laid = J._texts
    monkeypatch.setattr(J, "_texts", lambda docs, nodes, wanted: asked.append({r[0] for r in wanted.collect()}) or laid(docs, nodes, wanted))
    rng = random.Random(3)
    text = lambda: [f"w{rng.randrange(10**6)}" for _ in range(40)]
    shared, rows = text()[:12], [(i, " ".join([*text(), *text()])) for i in range(4)]
    rows += [(10 + i, " ".join([*shared, *text()])) for i in range(12)]
    rows += [(30, rows[0][1] + " x"), (31, rows[1][1] + " y")]
    got = {r.doc_id: r.component_id for r in jaccard_classes(docs(spark, rows)).collect()}
    assert got == {i: {30: 0, 31: 1}.get(i, i) for i, _ in rows}
    assert len(set().union(*asked)) == 4
