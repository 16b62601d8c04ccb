"""Language identification and the quality classifier."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill.llm import language, packing, perplexity
from tests.conftest import TINY


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.op8_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, rows = found.select(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert rows > 200 and right / rows > 0.97


def test_filter_holds_all_it_was_given():
    rng = np.random.default_rng(0)
    grams = {name: rng.integers(0, 2**63, 5000, dtype=np.uint64) for name in ("aa", "bb", "cc")}
    known = language.Languages(grams, {"bb": 9})
    for k, name in enumerate(known.names):
        assert ((known.holders(grams[name])[0] >> known.kind(k)) & known.kind(1)).all()
    other = rng.integers(0, 2**63, 100_000, dtype=np.uint64)
    for k in range(3):
        assert ((known.holders(other)[0] >> known.kind(k)) & known.kind(1)).mean() < 3 * known.false[k] + 1e-3
    assert known.common == "bb"


def plain_grams(text):
    """4-grams of bytes: letters of ASCII in lower case, every other ASCII byte a blank, no two blanks in a row."""
    data = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in (text or "").encode())
    return [g for k in range(len(data) - 3) if b"  " not in (g := data[k : k + 4])]


@pytest.mark.parametrize("languages", [3, 70])
def test_predictions_equal_brute_force(spark, monkeypatch, languages):
    """Counts, shares, holders and classes with dictionaries and sets; ties, over 64 languages, nulls, texts without a hit."""
    monkeypatch.setattr(packing, "FAN", 2)
    rng, rows = random.Random(languages), []
    names = [f"l{k:02}" for k in range(languages)]
    for k in range(6 * languages):
        name = names[k % languages]
        own = random.Random(name)
        words = ["".join(own.choices("abcdefghijklmnopé", k=own.randint(2, 6))) for _ in range(25)]
        rows.append((k, " ".join(rng.choices(words, k=40)), name))
    rows += [(900, rows[0][1], "l01"), (901, None, "l00"), (902, "", "l01"), (903, "12 34 !", "l00"), (904, rows[1][1], None)]
    asked = [*rows, (905, "ZZZZZ yyyy", None), (906, "ab", "x"), rows[2], rows[2], (907, rows[0][1] + " " + rows[1][1], None), (908, "數字數字", None), (909, rows[3][1] * 500, None)]
    frame = lambda r: spark.createDataFrame(r, "doc_id long, text string, lang string").repartition(5)
    known = language.learn(frame(rows))
    assert known.names == names and known.false.max() < 1e-4
    counts = {name: Counter(g for _, t, lang in rows if lang == name for g in plain_grams(t)) for name in names}
    total = {name: sum(c.values()) for name, c in counts.items()}
    share = {name: {g: n / total[name] for g, n in c.items() if n >= language.LEAST_COUNT} for name, c in counts.items()}
    most = Counter()
    for own in share.values():
        for g, x in own.items():
            most[g] = max(most[g], x)
    holds = {name: {g for g, x in own.items() if x >= language.LEAST_SHARE and x >= language.RELATIVE * most[g]} for name, own in share.items()}
    found = sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in language.identify(frame(asked), known).collect())
    expected = []
    for k, t, _ in asked:
        if not any(c.isalpha() for c in t or ""):
            expected.append((k, "und", 0.0))
            continue
        hits = dict.fromkeys(names, 0.0)
        for g in plain_grams(t):
            holders = [name for name in names if g in holds[name]]
            for name in holders:
                hits[name] += 1 / min(len(holders), language.MOST_HOLDERS)
        best = max(names, key=lambda name: (round(hits[name], 6), -names.index(name)))
        whole = sum(hits.values())
        expected.append((k, best, hits[best] / whole) if whole else (k, max(names, key=lambda name: (total[name], -names.index(name))), 0.0))
    assert [(a, b) for a, b, _ in found] == [(a, b) for a, b, _ in sorted(expected)]
    assert all(abs(a - b) < 1e-3 for (_, _, a), (_, _, b) in zip(found, sorted(expected), strict=True))


def test_many_languages_have_fewer_rows(monkeypatch):
    monkeypatch.setattr(language, "MOST_BYTES", 1 << 22)
    rng = np.random.default_rng(0)
    grams = {f"l{k:03}": rng.integers(0, 2**63, 50, dtype=np.uint64) for k in range(130)}
    known = language.Languages(grams, {})
    assert known.table.shape == (3, 1 << 17)
    for k, name in enumerate(known.names):
        assert ((known.holders(grams[name])[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).all()


def test_odd_texts_have_defined_languages(spark, docs, none):
    known = language.learn(docs)
    found = {(r["doc_id"], r["lang_pred"]) for r in language.identify(docs, known).collect()}
    assert {(0, "und"), (1, "und"), (2, "und"), (3, "en"), (4, "en")} <= found
    assert language.identify(none, language.learn(none)).count() == 0
    assert {r["lang_pred"] for r in language.identify(docs, language.learn(none)).collect()} == {"und"}


def plain_probabilities(texts, asked):
    """Interpolated modified Kneser-Ney of order 5 with dictionaries."""
    levels = {5: Counter(t[k : k + 5] for t in texts for k in range(len(t) - 4))}
    for n in (4, 3, 2, 1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    cut = {}
    for n, held in levels.items():
        times = Counter(held.values())
        cut[n] = perplexity.discounts([times[k] for k in (1, 2, 3, 4)])
    total = sum(levels[1].values())
    one = {w: max(c - cut[1][min(c, 3) - 1], 0) / total for w, c in levels[1].items()}
    rest = (1 - sum(one.values())) / 256

    def p(g):
        if len(g) == 1:
            return one.get(g, 0) + rest
        low, held, d = p(g[1:]), levels[len(g)], cut[len(g)]
        after = [c for h, c in held.items() if h[:-1] == g[:-1]]
        if not after:
            return low
        spared = sum(d[min(c, 3) - 1] for c in after)
        c = held.get(g, 0)
        return ((max(c - d[min(c, 3) - 1], 0) if c else 0) + spared * low) / sum(after)

    return {t: math.exp(-sum(math.log(p(t[k : k + 5])) for k in range(len(t) - 4)) / (len(t) - 4)) for t in asked}


@pytest.mark.parametrize("shard", [1 << 24, 150])
def test_perplexity_equals_plain_counting(spark, monkeypatch, shard):
    monkeypatch.setattr(perplexity, "SHARD_BYTES", shard)
    monkeypatch.setattr(perplexity, "SALT_CODES", 9)
    monkeypatch.setattr(perplexity, "SAMPLE_ONE_IN", 1)
    monkeypatch.setattr(perplexity, "SLICE", 300)
    monkeypatch.setattr(packing, "FAN", 2)
    split = perplexity._salts

    def some_are_split(*args):
        out = split(*args)
        assert out and set(out.values()) != {1}
        return out

    monkeypatch.setattr(perplexity, "_salts", some_are_split)
    rng = random.Random(1)
    texts = ["".join(rng.choices("abcd e", k=rng.randint(5, 80))) for _ in range(40)]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate([*texts, "abc", None, "zzzzzz"])], "doc_id long, text string, lang string").repartition(3)
    found = {r["doc_id"]: r["perplexity"] for r in perplexity.perplexities(docs, docs.where("doc_id < 25")).collect()}
    expected = plain_probabilities([t.encode() for t in texts[:25]], [*(t.encode() for t in texts), b"zzzzzz"])
    for k, t in enumerate(texts):
        assert abs(found[k] / expected[t.encode()] - 1) < 2e-3
    assert found[40] is None and found[41] is None and abs(found[42] / expected[b"zzzzzz"] - 1) < 2e-3


def test_classifier(spark, docs, none):
    labels = spark.read.parquet(f"{TINY}/labels.parquet")
    found = perplexity.op9_quality_classifier(spark, TINY).join(labels, "doc_id")
    good, junk = (found.where(f"quality = {q} AND toxic = 0").select(F.avg(F.col("kept").cast("int"))).first()[0] for q in (1, 0))
    assert good > 0.97 and junk < 0.5
    assert perplexity.classify(docs, labels.limit(0)).where("NOT kept").count() == 0
    odd = spark.createDataFrame([(5, 1, 0), (5, 1, None), (None, 1, 0), (9, None, None)], "doc_id long, quality int, toxic int")
    assert perplexity.classify(docs, odd).count() == docs.count()
    assert perplexity.classify(none, odd).count() == 0


def test_limits_and_verdicts_equal_brute_force(spark, monkeypatch):
    """Quantiles of held-out trusted texts by language, of all for languages with few or none, ties at the limit, short, long and repeated texts."""
    monkeypatch.setattr(perplexity, "FEWEST", 6)
    rng, rows = random.Random(5), []
    for k in range(150):
        lang = rng.choice(["en", "en", "de", "xx", None])
        rows.append((k, " ".join("".join(rng.choices("etaoin" if lang == "en" else "ernsti", k=rng.randint(2, 6))) for _ in range(rng.randint(1, 30))), lang))
    rows += [(200, "zq" * 40, "en"), (201, "zq", "en"), (202, None, "de"), (203, "", None), (204, rows[0][1] * 3000, "en"), rows[3], rows[3], (None, rows[4][1], "en"), (205, "qqqq zzzz", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(k, 1, 0) for k in range(120)] + [(5, 1, 0), (130, 0, 0), (131, 1, 1), (999, 1, 0)], "doc_id long, quality int, toxic int")
    found = perplexity.classify(docs, labels, quantile=0.8).collect()
    trusted = spark.range(120).select("id", (F.pmod(F.xxhash64("id"), F.lit(perplexity.FOLDS)) == 0).alias("held"))
    held = {r["id"] for r in trusted.collect() if r["held"]}
    train = [t.encode() for k, t, _ in rows if k is not None and k < 120 and k not in held]
    expected = plain_probabilities(train, [t.encode() for k, t, _ in rows[:150:30]])
    assert all(abs(r["perplexity"] / expected[rows[r["doc_id"]][1].encode()] - 1) < 2e-3 for r in found if r["doc_id"] in range(0, 150, 30) and r["perplexity"])

    def quantile(values):
        values = sorted(values)
        return values[max(math.ceil(0.8 * len(values)) - 1, 0)]

    known = [r for r in found if r["doc_id"] in held and r["perplexity"] is not None]
    groups = {}
    for r in known:
        groups.setdefault(r["lang"], []).append(r)
    assert {lang for lang, g in groups.items() if len(g) >= 6} >= {"en", "de"} and len(found) == len(rows)
    for r in found:
        own = groups.get(r["lang"], []) if r["lang"] is not None and len(groups.get(r["lang"], [])) >= 6 else known
        limit, peak = quantile([x["perplexity"] for x in own]), quantile([x["peak"] for x in own])
        assert (r["limit"], r["peak_limit"]) == (limit, peak)
        assert r["kept"] == (r["n_grams"] < perplexity.FEWEST_GRAMS or (r["perplexity"] <= limit and r["peak"] <= peak))
    assert {r["kept"] for r in found} == {True, False} and any(r["kept"] and r["perplexity"] == r["limit"] for r in found)


def test_tree_sums(spark):
    import pyarrow as pa

    rng = np.random.default_rng(3)
    rows, plain = [], Counter()
    for part in range(300):
        keys = np.unique(rng.integers(0, 50, 20))
        n = rng.integers(1, 9, len(keys))
        group = "ab"[part % 7 == 0]
        plain.update({(group, int(k)): int(c) for k, c in zip(keys, n, strict=True)})
        rows.append((group, part, bytearray(packing.pack([keys, n]))))
    frame = spark.createDataFrame(rows, "name string, part long, blob binary")
    found = packing.tree_sum(frame, {"name": pa.string()}, packing.tree_rounds(300)).collect()
    assert packing.tree_rounds(64) == 1 and packing.tree_rounds(65) == packing.tree_rounds(300) == 2 and packing.tree_rounds(5000) == 3
    assert {(r["name"], int(k)): int(c) for r in found for k, c in zip(*packing.unpack(bytes(r["blob"]))[0], strict=True)} == plain


def test_limits_reject_junk_and_a_few_toxic_words(spark):
    place = "/root/testdata/sf0.1"
    found = perplexity.op9_quality_classifier(spark, place).join(spark.read.parquet(f"{place}/labels.parquet"), "doc_id")
    kept = {tuple(r[:2]): r[2] for r in found.groupBy("quality", "toxic").agg(F.avg(F.col("kept").cast("int"))).collect()}
    assert kept[1, 0] > 0.97 and kept[0, 0] < 0.06 and kept[0, 1] < 0.06 and kept[1, 1] < 0.5


def test_shards_grow_with_the_text():
    assert [perplexity.shards_of(n) for n in (0, 1, 1 << 24, 1 << 38)] == [1, 1, 1, 1 << 14]


def test_peaks_equal_plain_windows():
    rng = np.random.default_rng(2)
    sizes = [0, 3, 6, 7, 0, 40, 5]
    cost, cuts = rng.integers(0, 9000, sum(sizes)), np.concatenate([[0], np.cumsum(sizes)])
    run = np.concatenate([[0], np.cumsum(cost)])
    mean = np.array([cost[a:b].mean() / perplexity.SCALE if b > a else 0 for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
    found, w = perplexity.peaks(run, cuts, mean), perplexity.PEAK
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        plain = max((cost[j : j + w].mean() / perplexity.SCALE for j in range(a, b - w + 1)), default=mean[k])
        assert abs(found[k] - plain) < 1e-9


def test_exact_quantiles(spark):
    """Of many values, ties among them, spread over bins or all in one; the rank is exact whatever the size."""
    rng = random.Random(12)
    groups = {"a": [math.exp(rng.uniform(0, 9)) for _ in range(30_000)], "b": [3.0 + k * 1e-9 for k in range(12_000)], "c": [5.0] * 500 + [7.0], "d": [2.0], "e": [rng.choice([1.0, 1.5, 2.5]) for _ in range(999)]}
    frame = spark.createDataFrame([(g, v) for g, values in groups.items() for v in values], "l string, v double").repartition(5)
    for q in (0.5, 0.99, 1.0, 0.001):
        found = {r["l"]: (r["limit"], r["n"]) for r in perplexity.exact_quantile(frame, q).collect()}
        assert found == {g: (sorted(v)[max(math.ceil(q * len(v)) - 1, 0)], len(v)) for g, v in groups.items()}
    assert perplexity.exact_quantile(frame.limit(0), 0.5).collect() == []
