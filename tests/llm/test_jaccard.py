import random
import re

import pytest

from strandmill.llm import jaccard
from tests.llm.conftest import prose


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))) if words else frozenset()


def brute(rows):
    """rows: (id, text) -> least id reachable, for each distinct (id, set)."""
    nodes = sorted({(i, shingles(t)) for i, t in rows if i is not None}, key=lambda x: (x[0], str(x[1])))
    label = list(range(len(nodes)))

    def find(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(nodes)):
        for b in range(a):
            x, y = nodes[a][1], nodes[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(a), find(b)))
                label[q] = p
    return {(i, s): nodes[find(k)][0] for k, (i, s) in enumerate(nodes)}


def check(frame, rows):
    expected = sorted((i, len(shingles(t)), e) for i, t in rows if i is not None for e in [brute(rows)[(i, shingles(t))]])
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.link_components(frame).collect()) == expected


def test_nasty_rows(docs, nasty_rows):
    check(docs, [(r[0], r[1]) for r in nasty_rows])


def test_any_long_is_an_id(spark):
    """Repeated ids near the ends of the range, with equal and with different texts."""
    rng = random.Random(6)
    texts = [prose(rng, 30) for _ in range(3)]
    rows = [(2**62 + 5, texts[0]), (2**62 + 5, texts[0]), (2**62 + 5, texts[1]), (-(2**63), texts[1]), (2**63 - 1, texts[0]), (2**63 - 1, texts[2]), (0, None), (0, ""), (3, texts[2] + " more")]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows)


@pytest.mark.parametrize(("seed", "blocks"), [(1, 512), (2, 5)])
def test_families_around_the_threshold(spark, monkeypatch, seed, blocks):
    """Near copies just over and under 0.8 of one text, shared lines, short texts and chains."""
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", blocks)
    monkeypatch.setattr(jaccard, "HEAVY_AT_LEAST", 6)
    rng, rows = random.Random(seed), []
    base, line = prose(rng, 100).split(), prose(rng, 12)
    for _ in range(40):
        words = list(base)
        for k in rng.sample(range(100), rng.randint(1, 5)):
            words[k] = f"w{rng.randint(0, 9)}"
        rows.append(" ".join(words))
    rows += [f"{line} {prose(rng, rng.randint(1, 8))}" for _ in range(30)] + [line, line.upper(), prose(rng, 2), "a b c", "A  b c"]
    chain = prose(rng, 60).split()
    rows += [" ".join(chain[k : k + 45]) for k in range(0, 16, 2)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows)


@pytest.mark.parametrize(("seed", "blocks"), [(3, 512), (4, 5)])
def test_every_link_is_counted(spark, docs, nasty_rows, monkeypatch, seed, blocks):
    """Families, chains and a shared line: each link between distinct sets once, joined already or not."""
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", blocks)
    monkeypatch.setattr(jaccard, "HEAVY_AT_LEAST", 6)
    rng, texts = random.Random(seed), []
    base, line, chain = prose(rng, 100).split(), prose(rng, 12), prose(rng, 900).split()
    for _ in range(40):
        words = list(base)
        for k in rng.sample(range(100), rng.randint(1, 3)):
            words[k] = f"w{rng.randint(0, 9)}"
        texts.append(" ".join(words))
    texts += [f"{line} {prose(rng, rng.randint(1, 4))}" for _ in range(20)] + [line, line.upper(), texts[0], "a b c"]
    texts += [" ".join(chain[k : k + 60]) for k in range(0, 800, 4)]
    rng.shuffle(texts)
    units, kinds = jaccard._units, set()

    def noted(*args):
        out = units(*args)
        kinds.update(r["kind"] for r in out.select("kind").distinct().collect())
        return out

    monkeypatch.setattr(jaccard, "_units", noted)
    own = list(enumerate(texts))
    for frame, rows in ((spark.createDataFrame(own, "doc_id long, text string").repartition(4), own), (docs, [(r[0], r[1]) for r in nasty_rows])):
        sets = {shingles(t) for i, t in rows if i is not None}
        links = {x: sum(x != y and 100 * len(x & y) >= 80 * len(x | y) for y in sets if x and y) for x in sets}
        found = jaccard.link_counts(frame).collect()
        assert sorted((r["doc_id"], r["n_shingles"], r["n_links"]) for r in found) == sorted((i, len(shingles(t)), links[shingles(t)]) for i, t in rows if i is not None)
        if frame is not docs:
            assert sum(r["n_links"] for r in found if r["is_rep"]) == sum(links.values()) > 2 * len(sets)
    assert kinds == {0, 1}  # families and single lists


def test_the_bound_on_shared_shingles():
    """Linked sets of n >= m share more(n) of the shingles looked up, whatever the order."""
    for n in range(1, 300):
        for m in range(-(-80 * n // 100), n + 1):
            both = max(-(-80 * (n + m) // 180), 1)
            k = jaccard.more(n)
            prefix = lambda s: s - (80 * s + 99) // 100 + 1 + jaccard.more(s)
            assert n - both + k <= prefix(n) and m - both + k <= prefix(m)


def test_one_of_each_and_empty(docs, none):
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 5").count() == 1 and kept.where("doc_id IN (6, 9, 10)").count() == 0
    assert kept.where("doc_id = 0").count() == 1 and kept.where("doc_id IS NULL").count() == 1
    assert jaccard.link_components(none).count() == 0 and jaccard.one_of_each(none).count() == 0
