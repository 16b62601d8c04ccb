import re

import pytest
from pyspark.sql import functions as F

from strandmill.functions import metrics, parsers, text
from strandmill.functions.porter import stem
from strandmill.functions.vectors import cosine

CASES = ["Straße ² don't a_b", "", "é́ naïve X1", "  padded　\t", "a\nb c", "one,two three", "İstanbul", "- x\n* y, z\n3) \"q\""]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(k, t) for k, t in enumerate([*CASES, None])], "k int, t string").cache()


def values(frame, column):
    return [r[0] for r in frame.orderBy("k").select(column).collect()]


def test_tokens_and_words(texts):
    assert values(texts, text.tokens(F.col("t")))[:5] == [re.findall(r"[\w']+", t.casefold()) for t in CASES[:5]]
    assert values(texts, text.words(F.col("t")))[:6] == [re.findall(r"\w+", t.lower()) for t in CASES[:6]]
    assert values(texts, text.tokens(F.col("t")))[-1] == []


def test_trimming_lines_and_counts(texts):
    assert values(texts, text.strip(F.col("t")))[:-1] == [t.strip() for t in CASES]
    assert values(texts, text.first_line(F.col("t"))) == [(t.splitlines() or [""])[0] if t else "" for t in [*CASES, None]]
    assert values(texts, text.word_count(F.col("t")))[:-1] == [len(t.split()) for t in CASES]


def test_keywords_and_lists(texts):
    assert values(texts, text.normal_keyword(F.col("t")))[:-1] == [parsers.normal(t) for t in CASES]
    assert values(texts, text.list_items(F.col("t")))[:-1] == [parsers.items(t) for t in CASES]
    assert values(texts, text.first_sentence(F.col("t")))[:-1] == [parsers.guessed_context(t) for t in CASES]


def test_choice_order(spark):
    one = spark.createDataFrame([("q5",), ("locomo:0:0",), ("locomo:0:1",)], "q string")
    assert [r[0] for r in one.select(text.flip(0, F.col("q"))).collect()] == [False, True, False]
    assert one.select(text.flip(17, F.col("q"))).first()[0]


def test_metrics_of_a_known_pair(spark):
    one = spark.createDataFrame([("Alice moved to Taipei", "Alice moved to Taipei yesterday")], "p string, r string")
    em, f1, bleu = one.select(metrics.exact_match(F.col("p"), F.col("r")), metrics.f1(F.col("p"), F.col("r")), metrics.bleu1(F.col("p"), F.col("r"))).first()
    assert em == 0 and abs(f1 - 8 / 9) < 1e-12 and abs(bleu - 0.7788007831) < 1e-9
    with pytest.raises(ValueError, match="rouge"):
        metrics.metric_map(["rouge"], F.col("p"), F.col("r"))


def test_cosine_of_a_zero_vector(spark):
    assert spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>").select(cosine(F.col("a"), F.col("b"))).first()[0] == 0


@pytest.mark.parametrize(("word", "root"), [("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("agreed", "agre"), ("hopping", "hop"), ("hissing", "hiss"), ("sky", "sky"), ("relational", "relat"), ("vietnamization", "vietnam"), ("sensibiliti", "sensibl"), ("adjustment", "adjust"), ("adoption", "adopt"), ("controll", "control"), ("probate", "probat"), ("enjoy", "enjoy"), ("dying", "die"), ("geologi", "geolog")])
def test_stems(word, root):
    assert stem(word) == root


def test_sections_and_decisions():
    reply = "KEYWORDS:\nred, blue\nCONTEXT: a car.\nTAGS: t1, t2"
    assert parsers.section(reply, "KEYWORDS", ("CONTEXT",)) == "red, blue"
    assert parsers.decision("DECISION: strengthen and update\nREASON: x")["decision"] == "STRENGTHEN_AND_UPDATE"
    assert parsers.decision("I would update the neighbours")["decision"] == "UPDATE_NEIGHBOR"
    assert parsers.decision('{"should_evolve": true, "actions": ["strengthen"]}')["decision"] == "STRENGTHEN"
    assert parsers.decision('{"x": 1}')["decision"] == "NO_EVOLUTION"
    assert parsers.strengthening("CONNECTIONS: 0, x, 2\nTAGS: a") == {"connections": [0, 2], "tags": ["a"]}
    assert parsers.strengthening('{"suggested_connections": [1], "tags_to_update": ["b"]}')["connections"] == [1]
    assert parsers.neighbour_updates("NEIGHBOR 1:\nCONTEXT: c\nTAGS: t", 2) == [{"context": "", "tags": []}, {"context": "c", "tags": ["t"]}]
    assert parsers.field_or_text('```json\n{"answer": 7}\n```', "answer") == "7"


def test_objects():
    assert parsers.outer_object('so: {"a": 1} end') == {"a": 1} and parsers.outer_object("none") == {}
    assert parsers.empty_object({"properties": {"k": {"type": "array"}, "s": {"type": "string"}, "n": {"type": "number"}, "x": {"type": "other"}}}) == {"k": [], "s": "", "n": 0, "x": None}


def test_pruning():
    content = "Alice says the painting exhibition in Taipei was great. Painting again today."
    given = ["Painting exhibition", "painting", "great", "Alice says", "unicorn", "Taipei"]
    assert parsers.prune(content, given, "none") == ["painting exhibition", "painting", "great", "alice says", "unicorn"]
    assert parsers.prune(content, given, "simple") == ["painting exhibition", "taipei"]
    assert parsers.prune(content, ["paintings"], "simple") == [] and parsers.prune(content, ["paintings"], "nltk") == ["paintings"]
    with pytest.raises(ValueError, match="other"):
        parsers.prune(content, given, "other")
