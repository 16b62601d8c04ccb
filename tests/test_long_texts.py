"""Columns over long texts: in time that grows with the text, and compact enough for compiled code."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandmill.functions import metrics, text, treebank

WORDS = 12_000


@pytest.fixture(scope="module")
def long_pair():
    rng = random.Random(5)
    make = lambda n: " ".join(f"{rng.choice(['W', 'w'])}ord{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in (rng.randrange(6000) for _ in range(n)))
    return make(WORDS), make(WORDS - 500)


def timed(frame, seconds):
    began = time.perf_counter()
    row = frame.first()
    assert time.perf_counter() - began < seconds
    return row


def test_metrics_of_long_texts(spark, long_pair):
    a, b = (Counter(x.lower().split()) for x in long_pair)
    frame = spark.createDataFrame([long_pair], "p string, r string").repartition(1)
    row = timed(frame.select(metrics.bleu1(F.col("p"), F.col("r")).alias("bleu1"), metrics.f1(F.col("p"), F.col("r")).alias("f1")), 10)
    assert row.bleu1 == pytest.approx((a & b).total() / a.total())
    common, n, m = len(a.keys() & b.keys()), len(a), len(b)
    assert row.f1 == pytest.approx(2 * (common / n) * (common / m) / (common / n + common / m))


@pytest.mark.parametrize("pair", [("a a b", "a c a a"), ("", "a"), ("a", ""), ("!", "!"), ("a b", "c"), ("Straße a", "STRASSE a b b"), (None, "a")])
def test_bleu_counts_clipped_words(spark, pair):
    words = lambda x: Counter((x or "").casefold().replace("!", "").split())
    p, r = words(pair[0]), words(pair[1])
    n, m = p.total(), r.total()
    want = 0.0 if not n or not m else (1.0 if n >= m else 2.718281828459045 ** (1 - m / n)) * (p & r).total() / n
    frame = spark.createDataFrame([pair], "p string, r string")
    assert frame.select(metrics.bleu1(F.col("p"), F.col("r")).alias("x")).first().x == pytest.approx(want)


def test_guessed_keywords_of_a_long_text(spark, long_pair):
    found = timed(spark.createDataFrame([(long_pair[0],)], "t string").repartition(1).select(text.capitalised_keywords(F.col("t"), ["the"], 8000).alias("k")), 10).k
    first = {}
    for w in long_pair[0].split():
        first.setdefault(w.lower(), w[0].isupper())
    assert found == [w for w, cap in first.items() if cap] + [w for w, cap in first.items() if not cap]


def test_folding_is_one_small_expression(spark):
    frame = spark.createDataFrame([("ŉ ﬁn ὒΐ ſt µ ς ẛ ﬗ ǰ և ß Ꭰ ꭰ É x ’ 漢",), ("STRASSE ß",), ("plain",), ("ÉCOLE – 漢",)], "t string")
    out = frame.select("t", text.fold(F.col("t")).alias("f"))
    assert all(r.f == r.t.casefold() for r in out.collect())
    # A replacement for each character that folds to several stood in the plan, four times over in a token column.
    assert out._jdf.queryExecution().analyzed().toString().count("replace(") < 10


def test_every_rule_holds_what_it_needs():
    assert set(treebank.NEEDED) <= {pattern for pattern, _ in treebank.RULES}


@pytest.mark.parametrize("line", ['"Hi," he said...  "no--yes" (it\'s) cannot.', "Cannot gonna D'ye 'Tis more'n they'll WE'LL don't DON'T ' \"x.\")", "a.b.", "", "...", "$5 & 6% [x]{y} gimme lemme wanna gotta 'twas", "x\r\ny\n", None, "a' b' 'S 's ", "it''s \"'"])
def test_rules_are_as_written(spark, duck, line):
    """Rules that are only tried where they can change something make the same tokens as the SQL, which tries all."""
    found = spark.createDataFrame([(line,)], "t string").select(treebank.tokens(F.col("t")).alias("x")).first().x
    assert found == duck.execute(f"SELECT {treebank.sql('t')} FROM (SELECT ?::VARCHAR AS t)", [line]).fetchone()[0]


def test_a_needless_rule_is_not_tried(spark):
    """A long text without quotes or periods: each rule is a look for what it needs, not a search for its pattern."""
    plan = spark.createDataFrame([("x",)], "t string").select(treebank.tokens(F.col("t")))._jdf.queryExecution().analyzed().toString()
    assert plan.count("contains") >= len(treebank.NEEDED)
