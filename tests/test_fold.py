"""The note fold, questions over its notes, and stems, each against a plain version written from the rules."""

import math
import re
from collections import Counter

import pytest

from strandmill.functions import porter
from strandmill.functions import vocabulary as V
from strandmill.operators import construct
from strandmill.plans import catalogue
from tests.conftest import TINY
from tests.test_notes_again import plain_prune


def okapi_order(documents, query):
    """Places of the documents by Okapi BM25 from scratch, then by place."""
    split = [re.findall(r"\w+", d.lower()) for d in documents]
    n = len(split)
    df = Counter(w for d in split for w in set(d))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(raw.values()) / len(raw) if raw else 0.0
    average = sum(map(len, split)) / n or 1.0
    scores = []
    for d in split:
        tf = Counter(d)
        scores.append(sum((raw[w] if raw[w] >= 0 else 0.25 * mean) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(d) / average)) for w in re.findall(r"\w+", query.lower()) if w in tf))
    return sorted(range(n), key=lambda k: (-round(scores[k], 9), k))


def plain_guess(body):
    """Words of three letters and more that count as keywords: capitalised ones first, at most five."""
    found = [w for w in dict.fromkeys(w.lower() for w in re.findall(r"\b[a-zA-Z]{3,}\b", body)) if w not in V.FILTERED and not w.endswith("says")]
    written = {}
    for w in re.findall(r"\b[a-zA-Z]{3,}\b", body):
        written.setdefault(w.lower(), w)
    return ([w for w in found if written[w][0].isupper()] + [w for w in found if not written[w][0].isupper()])[:5]


def plain_fold(turns):
    """Notes of one conversation. turns: (id, text) in order. What the rule model says is worked out here, not parsed."""
    notes, documents = [], []
    for turn_id, body in turns:
        said = sorted(set(re.findall(r"[a-z]{4,}", body.lower())))[:4]
        kept = plain_prune(body, said) or plain_prune(body, plain_guess(body))
        calls = 1 + (not kept)
        note = {"id": turn_id, "text": body, "keywords": kept, "context": f"about {' '.join(said[:2])}".strip(), "tags": said[:2] or kept[:3], "links": []}
        near = okapi_order(documents, body)[:5] if notes else []
        if near:
            calls += 1
            kind = len(near) % 4  # none, strengthen, update, both
            if kind in (1, 3):
                calls += 1
                note["links"], note["tags"] = near[:2], ["linked", "seen"]
            if kind in (2, 3):
                calls += 1
                for k in range(0, len(near), 2):  # a block without its successor takes in the header of the one after that
                    notes[near[k]]["context"], notes[near[k]]["tags"] = f"updated {k}", ["updated"] + [f"NEIGHBOR {k + 2}:"] * (k + 2 < len(near))
        note["calls"] = calls
        notes.append(note)
        documents.append(f"{note['context']} keywords: {', '.join(note['keywords'])}".strip())
    return notes


@pytest.fixture(scope="module")
def conversations(spark):
    held = {}
    for r in spark.read.parquet(f"{TINY}/conversations.parquet").orderBy("conv_id", "turn").collect():
        held.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"] or ""))
    return held


@pytest.fixture(scope="module")
def folded(conversations):
    return {c: plain_fold([(f"conv:{c}:turn:{t}", body) for t, _, body in turns]) for c, turns in conversations.items()}


def test_notes_equal_the_plain_fold(spark, folded):
    rows = {r["record_id"]: r for r in catalogue.QUERIES["graph_memory_fold"](spark, TINY).collect()}
    assert len(rows) == sum(map(len, folded.values()))
    kinds = Counter()
    for notes in folded.values():
        total = sum(n["calls"] for n in notes)
        for pos, n in enumerate(notes):
            r = rows[n["id"]]
            links = ",".join(notes[k]["id"] for k in n["links"])
            assert (r["pos"], r["context"], r["keywords"], r["tags"], r["links"], r["completions"], r["failures"]) == (pos, n["context"], ",".join(n["keywords"]), ",".join(n["tags"]), links, total, 0)
            kinds[bool(n["links"]), n["context"].startswith("updated")] += 1
    assert kinds[True, False] and kinds[False, True]


def words_of(x):
    return re.findall(r"[\w']+", x.lower().replace("ß", "ss"))


def test_answers_over_notes_equal_the_plain_version(spark, conversations, folded):
    found = {r["question_id"]: r for r in catalogue.QUERIES["graph_memory_qa"](spark, TINY).collect()}
    asked = 0
    for c, turns in conversations.items():
        notes, at = folded[c], {t: k for k, (t, _, _) in enumerate(turns)}
        split = [words_of(n["text"]) for n in notes]
        df, average = Counter(w for s in split for w in set(s)), sum(map(len, split)) / len(split) or 1.0
        for t, role, question in turns:
            if role != "user" or t + 1 not in at or turns[at[t + 1]][1] != "assistant":
                continue
            asked += 1
            scores = []
            for s in split:
                tf = Counter(s)
                scores.append(round(sum(q * math.log(1 + (len(split) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(s) / average)) for w, q in Counter(words_of(question)).items() if w in tf), 9))
            first = sorted(range(len(notes)), key=lambda k: (-scores[k], notes[k]["id"]))[:2]
            items = list(first)
            for k in first:
                items += [x for x in notes[k]["links"] if x not in items]
            shown = "\n".join(f"talk start time:\nmemory content: {notes[k]['text']}\nmemory context: {notes[k]['context']}\nmemory keywords: {', '.join(notes[k]['keywords'])}\nmemory tags: {', '.join(notes[k]['tags'])}" for k in items)
            p, r = set(words_of(shown)), set(words_of(turns[at[t + 1]][2]))
            both = len(p & r)
            f1 = 2 * (both / len(p)) * (both / len(r)) / (both / len(p) + both / len(r)) if both else 0.0
            row = found[f"conv:{c}:{t}"]
            assert row["item_ids"].split(",") == [notes[k]["id"] for k in items] and row["context_text"] == shown and abs(row["f1"] - f1) < 1e-6
    assert asked == len(found) > 10


#: Word and stem pairs of the published description of the algorithm.
PAIRS = """
caresses caress, ponies poni, caress caress, cats cat, feed feed, agreed agre, plastered plaster, bled bled, motoring motor, sing sing, conflated conflat, troubled troubl, sized size, hopping hop, tanned tan, falling fall,
hissing hiss, fizzed fizz, failing fail, filing file, happy happi, sky sky, relational relat, conditional condit, rational ration, valenci valenc, hesitanci hesit, digitizer digit, conformabli conform, radicalli radic, differentli differ,
vileli vile, analogousli analog, vietnamization vietnam, predication predic, operator oper, feudalism feudal, decisiveness decis, hopefulness hope, callousness callous, formaliti formal, sensitiviti sensit, sensibiliti sensibl,
triplicate triplic, formative form, formalize formal, electriciti electr, electrical electr, hopeful hope, goodness good, revival reviv, allowance allow, inference infer, airliner airlin, gyroscopic gyroscop, adjustable adjust,
defensible defens, irritant irrit, replacement replac, adjustment adjust, dependent depend, adoption adopt, homologou homolog, communism commun, activate activ, angulariti angular, homologous homolog, effective effect, bowdlerize bowdler,
probate probat, rate rate, cease ceas, controll control, roll roll, generalizations gener, oscillators oscil
"""


@pytest.mark.parametrize("pair", [x.split() for x in PAIRS.replace("\n", " ").split(",")], ids=lambda p: p[0])
def test_stems_of_the_published_examples(pair):
    word, stem = pair
    assert porter.stem(word) == stem


def test_consolidation_changes_only_the_index():
    plain, often = construct.Fold(construct.rule_model("s")), construct.Fold(construct.rule_model("s"), evolution_threshold=1)
    for k in range(8):
        for fold in (plain, often):
            fold.add(f"shared words about thing{k} and place{k % 3}", "t", f"n{k}")
    assert often.documents == [n.document() for n in often.notes.values()] and often.evolved > 0 and plain.documents != [n.document() for n in plain.notes.values()]
