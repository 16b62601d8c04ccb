"""Operators on vectors against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from strandmill.llm import codebooks, pivots

SCHEMA = "vec_id long, embedding array<double>, label int, unit string, cid long, size int"
NAN, INF = float("nan"), float("inf")


def close_by(rng, vector, spread):
    out = vector + rng.normal(size=len(vector)) * spread
    return (out / np.linalg.norm(out)).tolist()


def nasty_vectors(dim=16, seed=3):
    rng = np.random.default_rng(seed)
    rows, k = [], 0

    def add(vector, label, i=None):
        nonlocal k
        rows.append((k if i is None else i, vector, label, "u", 1, 2))
        k += 1

    for label in (0, 1, 2):
        for _ in range(40):
            base = rng.normal(size=dim)
            add(base.tolist(), label)
            for _ in range(int(rng.integers(0, 4))):
                add(close_by(rng, base / np.linalg.norm(base), 0.02), label)
    family = rng.normal(size=dim)
    family /= np.linalg.norm(family)
    for _ in range(120):  # near misses of one another, of one hot label
        add(close_by(rng, family, 0.03), 1)
    for _ in range(90):
        add(family.tolist(), 1)
    add((family * 7).tolist(), 1)  # another length, the same direction
    add(family.tolist(), None)
    add(family.tolist(), 3)
    for odd in (None, [], [0.0] * dim, [NAN] * dim, [INF] + [0.0] * (dim - 1), [None] + [1.0] * (dim - 1)):
        add(odd, 1)
    for odd in ([1e300] * dim, [1e-300] * dim, family[:4].tolist(), [1.0]):
        add(odd, 2)
    add(family.tolist(), 1, i=5)  # an id that is there already
    add(family.tolist(), 1, i=None)
    rows.append((None, family.tolist(), 1, "u", 1, 2))
    random.Random(seed).shuffle(rows)
    return rows


def usable(v, label):
    return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute_links(rows):
    good = [usable(r[1], r[2]) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    n = [0] * len(rows)
    units = [pivots.unit(np.array([r[1]], float))[0] if ok else None for r, ok in zip(rows, good, strict=True)]
    for i in range(len(rows)):
        for j in range(i):
            if good[i] and good[j] and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and float(units[i] @ units[j]) >= 0.98:
                n[i] += 1
                n[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return [(r[0], n[i], least.get(root(i)), r[0] is not None and r[0] == least.get(root(i))) for i, r in enumerate(rows)]


@pytest.mark.parametrize("options", [{}, {"limit": 8}, {"limit": 16, "pivots": 24}])
def test_near_duplicates_against_brute_force(spark, options):
    rows = nasty_vectors()
    found = pivots.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), **options)
    assert Counter(tuple(r) for r in found.collect()) == Counter(brute_links(rows))


def test_recall(spark):
    """Links found of those that brute force finds, with many more vectors than pivots, pairs near the threshold and a family."""
    rng = np.random.default_rng(8)
    base = pivots.unit(rng.normal(size=(1500, 64)))
    near = pivots.unit(base + rng.normal(size=base.shape) * 0.023)
    family = pivots.unit(base[:1] + rng.normal(size=(700, 64)) * 0.012)
    vectors = np.concatenate([base, near, family])
    labels = np.concatenate([np.arange(1500) % 3, np.arange(1500) % 3, np.zeros(700, int)])
    links = sum(int((u @ u.T >= 0.98).sum()) - len(u) for u in (vectors[labels == k] for k in range(3)))
    frame = spark.createDataFrame([(k, v, int(label)) for k, (v, label) in enumerate(zip(vectors.tolist(), labels, strict=True))], "vec_id long, embedding array<double>, label int")
    found = pivots.near_duplicates(frame, limit=256).agg({"n_links": "sum"}).first()[0]
    assert 0.999 * links <= found <= links and links > 100_000


def test_equal_ids_and_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert pivots.near_duplicates(none).collect() == []
    one = spark.createDataFrame([(1, [1.0, 0.0], 1, "", 1, 1)] * 3, SCHEMA)
    assert [tuple(r) for r in pivots.near_duplicates(one).collect()] == [(1, 2, 1, True)] * 3


def test_pivots_are_far_apart():
    """A dense family gets few of the pivots."""
    rng = np.random.default_rng(1)
    family = pivots.unit(rng.normal(size=(1, 8)) + 0.01 * rng.normal(size=(500, 8)))
    others = pivots.unit(rng.normal(size=(100, 8)))
    chosen = pivots.choose(np.concatenate([family, others]), 40)
    assert (chosen @ family[0] > 0.99).sum() <= 2


# ---- codebooks


def brute_codes(rows):
    kept = []
    for i, v, label, *_ in rows:
        if v and all(x is not None and np.isfinite(x) and abs(x) < codebooks.LARGEST for x in v):
            kept.append((i, label, [int(np.floor(x * 1024)) for x in v]))
    first = min((r for r in kept if len(r[2]) % 4 == 0), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    dim = len(first[2])
    kept = sorted((r for r in kept if len(r[2]) == dim), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    w = dim // 4
    books = [[list(r[2][p * w : (p + 1) * w]) for r in kept[:256]] for p in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign():
        return [[min(range(len(books[p])), key=lambda k: (far(r[2][p * w : (p + 1) * w], books[p][k]), k)) for p in range(4)] for r in kept]

    for _ in range(4):
        codes = assign()
        for p in range(4):
            for k in range(len(books[p])):
                own = [r[2][p * w : (p + 1) * w] for r, c in zip(kept, codes, strict=True) if c[p] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    codes = assign()
    errors = [sum(far(r[2][p * w : (p + 1) * w], books[p][c[p]]) for p in range(4)) for r, c in zip(kept, codes, strict=True)]
    return Counter((r[0], None if r[1] is None else str(r[1]), bytes(c).hex(), e) for r, c, e in zip(kept, codes, errors, strict=True)), books


@pytest.mark.parametrize("large", [False, True])
def test_codes_against_plain_rounds(spark, large, monkeypatch):
    monkeypatch.setattr(codebooks, "BLOCK", 100)
    rows = nasty_vectors(dim=8, seed=9)
    if large:  # distances beyond what doubles, and then longs, hold exactly
        rows = [(i, [x * 50_000 if x is not None else x for x in v] if v else v, *rest) for i, v, *rest in rows]
    found, books = codebooks.compress(spark.createDataFrame(rows, SCHEMA).repartition(3))
    want, plain = brute_codes(rows)
    assert books.tolist() == plain
    assert Counter(tuple(r) for r in found.collect()) == want


def test_more_vectors_than_entries_pop_few(spark):
    """Later rounds scan only violated parts, and still agree with full scans."""
    rng = np.random.default_rng(4)
    numbers = np.floor(rng.normal(size=(3000, 8)) * 300).astype(np.int32)
    books = numbers[:256].astype(np.int64).reshape(256, 4, 2).transpose(1, 0, 2).copy()
    drift = np.zeros((4, 256))
    codes, heaps, _ = codebooks.advance(numbers, None, None, books, drift)
    again = books.copy()
    again[:, 7] += 3
    moved = np.sqrt(((again - books) ** 2).sum(axis=2))
    drift = moved + np.where(np.arange(256) == 7, 0, moved.max())
    popped = [len(h.violated(d)) for h, d in zip([codebooks.Heaps(h.keys, h.members, h.cuts) for h in heaps], drift, strict=True)]
    assert 0 < sum(popped) < 0.9 * 4 * len(numbers)
    now = codebooks.advance(numbers, codes, heaps, again, drift)[0]
    assert np.array_equal(now, codebooks.advance(numbers, None, None, again, drift)[0])


def test_no_vectors(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert codebooks.compress(none)[0].collect() == []
    odd = spark.createDataFrame([(1, None, 1, "", 1, 1), (2, [1.0, 2.0], 1, "", 1, 1)], SCHEMA)
    assert codebooks.compress(odd)[0].collect() == []
