"""Notes by one completion, Treebank tokens, full folding, pruning with stems: each against a plain version or published examples."""

import json
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandmill.functions import keywords, parsers, porter, text, treebank
from strandmill.functions import vocabulary as V
from strandmill.operators import construct, schema_fold
from strandmill.plans import standins


@pytest.mark.parametrize(("given", "want"), [
    ("They'll save and invest more.", "They 'll save and invest more ."),
    ("hi, my name can't hello,", "hi , my name ca n't hello ,"),
    ("Good muffins cost $3.88\nin New York.  Please buy me two of them.", "Good muffins cost $ 3.88 in New York. Please buy me two of them ."),
    ('"We beat some pretty good teams to get here," Slocum said.', "`` We beat some pretty good teams to get here , '' Slocum said ."),
    ("I cannot cannot work; gimme that--now...", "I can not cannot work ; gim me that -- now ..."),
    ("the children's dogs' [bone] isn't (really) mine?", "the children 's dogs ' [ bone ] is n't ( really ) mine ?"),
    ("He said it (yesterday.)", "He said it ( yesterday . )"), ("", ""), (None, ""),
])
def test_treebank(spark, given, want):
    found = spark.createDataFrame([(given,)], "t string").select(treebank.tokens(F.col("t"))).first()[0]
    assert " ".join(found) == want


def test_full_folding(spark):
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i <= 0xDFFF and chr(i) != chr(i).casefold()]
    rows = spark.createDataFrame([(k, f"a{c}b") for k, c in enumerate(every)], "k int, t string")
    found = {r["k"]: r["f"] for r in rows.select("k", text.fold(F.col("t")).alias("f")).collect()}
    wrong = [every[k] for k, f in found.items() if f != f"a{every[k]}b".casefold()]
    # Versions of Unicode differ in a few new letters.
    assert len(wrong) <= 0.02 * len(every) and not set(wrong) & set(text.FOLDS)
    assert spark.range(1).select(text.fold(F.lit("STRASSE straße ΌΣΟΣ ﬀ"))).first()[0] == "STRASSE straße ΌΣΟΣ ﬀ".casefold()


def plain_prune(content, given):
    """The rules of pruning with stems, word by word."""
    words = re.findall(r"[a-z0-9]+", content.lower())
    known = set(words) | {porter.stem(w) for w in words}
    usable = {}
    for keyword in given:
        keyword = re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s-]", " ", re.sub(r"[_/-]+", " ", keyword.lower()))).strip(" -")
        parts = re.findall(r"[a-z0-9]+", keyword)
        core = [w for w in parts if w not in V.FILTERED]
        if not core or any(w.endswith("says") or w in V.BARRED for w in parts) or len(core) == 1 and core[0] in V.GENERIC:
            continue
        if known and not all(w in known or porter.stem(w) in known for w in core):
            continue
        usable.setdefault(keyword, core)
    kept = {k: c for k, c in usable.items() if not any(set(c) < set(o) for o in usable.values())}
    first = lambda c: min([content.lower().find(w) for w in c if w in content.lower()] or [len(content) + 1])
    return sorted(kept, key=lambda k: (-sum(content.lower().count(w) for w in kept[k]), -min(len(kept[k]), 3), first(kept[k]), k))[:5]


def test_pruning_with_stems(spark):
    rng = random.Random(4)
    stems = ["paint", "walk", "argu", "museum", "relat", "hop", "happi", "connect"]
    ends = ["", "s", "ing", "ed", "ion", "ional", "er", "ness"]
    word = lambda: rng.choice(stems) + rng.choice(ends)
    rows = []
    for k in range(300):
        content = " ".join(word() for _ in range(rng.randint(0, 9)))
        given = [" ".join(word() if rng.random() < 0.8 else rng.choice(["the", "time", "alice says", "X_y"]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(0, 6))]
        rows.append((k, content, given))
    found = spark.createDataFrame(rows, "k int, c string, g array<string>").select("k", keywords.pruned(F.col("c"), F.col("g"), "nltk").alias("p")).collect()
    want = {k: plain_prune(c, g) for k, c, g in rows}
    assert {r["k"]: r["p"] for r in found} == want and sum(map(len, want.values())) > 100
    assert any(not set(re.findall(r"[a-z]+", " ".join(want[k]))) <= set(c.split()) for k, c, _ in rows)  # some are grounded by stems alone


@pytest.mark.parametrize(("said", "content", "want"), [
    ({"keywords": "museum, walk", "context": ["a", "b"], "tags": "x\ny"}, "a museum walk", {"keywords": ["museum", "walk"], "context": "a b", "tags": ["x", "y"]}),
    (None, "Paris trip. More.", {"keywords": ["paris", "trip"], "context": "Paris trip.", "tags": ["paris", "trip"]}),
    ({"keywords": ["unicorn"], "tags": [], "more": 1}, "Museum here", {"keywords": ["museum"], "context": "Museum here", "tags": ["museum"], "more": 1}),
    ({"keywords": 7, "context": ""}, "", {"keywords": [], "context": "", "tags": []}),
])
def test_repaired(said, content, want):
    assert parsers.repaired(said, content) == want


def plain_notes(turns, threshold):
    """One conversation's notes by the rules, with what the stand-in says worked out here."""
    notes, documents, evolved = [], [], 0
    unit = lambda t: [x / (sum(y * y for y in v) ** 0.5 or 1.0) for v in [standins.letter_counts([t])[0]] for x in v]
    for record, body in turns:
        said = sorted(set(re.findall(r"[a-z]{4,}", body.lower())))[:4]
        kept = plain_prune(body, said) or plain_prune(body, [w for w in dict.fromkeys(re.findall(r"\b[a-zA-Z]{3,}\b", body))])
        note = {"id": record, "text": body, "keywords": kept, "context": " ".join(["about", *said[:2]]), "tags": said[:2], "links": []}
        near = sorted(range(len(documents)), key=lambda p: (round(sum(a * b for a, b in zip(documents[p], unit(body), strict=True)), 9), p), reverse=True)[:5]
        size = len(body)
        if near and size % 7 != 6:
            if size & 1:
                note["links"], note["tags"] = near[:2], ["linked", str(size % 5)]
            if size & 2:
                for k, p in enumerate(near[: 1 + size % 3]):
                    notes[p]["tags"] = [f"t{p}"]
                    if k == 0:
                        notes[p]["context"] = f"seen {p}"
            evolved += 1
        notes.append(note)
        documents.append(unit(f"content:{body} context:{note['context']} keywords: {', '.join(note['keywords'])} tags: {', '.join(note['tags'])}"))
        if near and size % 7 != 6 and evolved % threshold == 0:
            documents = [unit(f"{n['text']} , {n['context']} {' '.join(n['keywords'])} {' '.join(n['tags'])}") for n in notes]
    return [(n["id"], k, n["context"], ",".join(n["keywords"]), ",".join(n["tags"]), ",".join(notes[p]["id"] for p in n["links"])) for k, n in enumerate(notes)]


def test_notes_by_one_completion(spark):
    rng = random.Random(8)
    words = "museum painting garden travel river mountain kitchen letter window bridge".split()
    turns = [(s, f"{s}{k}", k, " ".join(rng.choices(words, k=rng.randint(1, 7))) + "." * rng.randint(0, 6), None) for s in "ab" for k in range(40)]
    frame = spark.createDataFrame(turns, "sample_id string, turn_id string, turn_pos int, text string, timestamp string")
    found = schema_fold.build_notes(frame, standins.schema_model, lambda: standins.letter_counts, evolution_threshold=3)
    rows = Counter((r["record_id"], r["pos"], r["context"], ",".join(r["keywords"]), ",".join(r["tags"]), ",".join(r["links"])) for r in found.collect())
    want = Counter(x for s in "ab" for x in plain_notes([(t, body) for u, t, _, body, _ in turns if u == s], 3))
    assert rows == want and any(r[5] for r in want) and any(r[2].startswith("seen") for r in want)
    assert {(r["completions"], r["error"]) for r in found.collect()} == {(80, None)}


def test_replies_that_are_no_objects():
    script = iter(["nothing", "{broken", '{"keywords": ["museum"], "context": ["a", "b"], "tags": null}', '{"actions": ["strengthen"]}', json.dumps({"keywords": [], "context": "c", "tags": ["t"]}), 'x {"should_evolve": true, "actions": ["strengthen", "update_neighbor", "other"], "suggested_connections": [0, 9], "tags_to_update": ["n"], "new_context_neighborhood": [], "new_tags_neighborhood": [["u"], ["v"], ["w"]]} y'])
    fold = schema_fold.SchemaFold(lambda prompt, schema: next(script), standins.letter_counts)
    for k, body in enumerate(["first museum", "museum again", "Garden walk"]):
        fold.add(body, "now", f"n{k}")
    rows = fold.rows("s")
    assert rows[0][5:8] == ("General", [], ["u"]) and rows[1][5:9] == ("a b", ["museum"], ["v"], [])
    assert rows[2][5:9] == ("c", ["garden", "walk"], ["n"], ["n0", "9"]) and fold.evolved == 1 and len(fold.usage) == 6


def test_a_failing_provider_is_an_error_of_its_sample(spark):
    def model(name):
        if name == "b":
            raise RuntimeError("no model")
        return standins.schema_model(name)

    frame = spark.createDataFrame([(s, f"{s}0", 0, "museum walk", None) for s in "ab"], "sample_id string, turn_id string, turn_pos int, text string, timestamp string")
    found = {r["sample_id"]: r["error"] for r in schema_fold.build_notes(frame, model, lambda: standins.letter_counts).collect()}
    assert found == {"a": None, "b": "RuntimeError: no model"}
    with pytest.raises(ValueError, match="pruning"):
        schema_fold.build_notes(frame, model, lambda: standins.letter_counts, mode="odd")


def test_many_small_samples_come_in_few_batches(spark):
    """Samples are folded one after the other within a task, not as a group each; order, errors and odd ids stay theirs."""
    turns = [(f"s{k % 400}", f"s{k % 400}:{k // 400}", k // 400, f"word{k % 7} other{k % 5}", None) for k in range(1200)]
    frame = spark.createDataFrame(turns, "sample_id string, turn_id string, turn_pos int, text string, timestamp string").repartition(7)

    def model(sample_id):
        if sample_id == "s7":
            raise ValueError("none")
        return construct.rule_model(sample_id)

    found = construct.build_notes(frame, model)
    plan = found._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    rows = found.select("sample_id", "record_id", "pos", "error").collect()
    assert Counter(r.sample_id for r in rows) == {f"s{k}": 1 if k == 7 else 3 for k in range(400)}
    assert all(r.error == "ValueError: none" if r.sample_id == "s7" else r.record_id == f"{r.sample_id}:{r.pos}" for r in rows)


def test_unchanged_documents_are_not_encoded_again():
    asked = []

    def encode(texts):
        asked.extend(texts)
        return [[float(len(t)), 1.0] for t in texts]

    held = schema_fold.Vectors(encode)
    for k in range(20):
        held.add("x" * k)
    held.again(["x" * k if k != 3 else "other" for k in range(20)])
    assert len(asked) == 21 and held.search("x" * 19, 1) == [19]


def test_notes_are_built_once_for_questions(spark, monkeypatch):
    """What is read of built notes comes from a table: a plan that builds them stands nowhere in the questions' plan."""
    from strandmill.plans import catalogue

    plan = catalogue.QUERIES["graph_memory_qa"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "InArrow" not in plan and "InPandas" not in plan
