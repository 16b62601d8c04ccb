"""Quality rules, decontamination, licences, chat, tokens: one text at a time."""

import collections
import re

import pytest
from pyspark.sql import functions as F

from strandmill.llm import bpe, chat, decontaminate, licences, repetition


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ---- quality rules


def brute_repeats(words):
    """For each word the longest run from it that starts elsewhere too."""
    n, out = len(words), []
    for i in range(n):
        best = 0
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and words[i + k] == words[j + k]:
                k += 1
            best = max(best, k)
        out.append(best)
    return out


def test_features_equal_brute_force(docs, nasty_rows):
    found = collections.Counter(tuple(r[:6]) for r in repetition.features(docs).collect())
    expected = collections.Counter()
    for r in nasty_rows:
        text = r[1] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        seen = collections.Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        hit = {j for k in range(len(words) - 4) if seen[tuple(words[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines, before = 0, set()
        for x in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", x):
                lines += x in before
                before.add(x)
        expected[(r[0], len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(hit))] += 1
    assert found == expected


@pytest.mark.parametrize("text", ["a b a b a b c a b", "x x x x", "a b c d", "one", "a b c a b d a b c", "p q r p q r s p q r"])
def test_suffix_array_matches(text):
    import pyarrow as pa

    from strandmill.llm.textarrays import SPACED, slices, words_of

    (part,) = slices([pa.record_batch({"text": pa.array([text, "a b", text])})])
    words = words_of(part.data, part.offsets, SPACED)
    assert repetition.longest_matches(words).tolist() == brute_repeats(text.split()) + [0, 0] + brute_repeats(text.split())


def test_repeats_equal_brute_force(spark, nasty_rows):
    """Covered fraction, longest repeat and verdict from every pair of places."""
    import random

    rng, texts = random.Random(7), {r[1] for r in nasty_rows if r[1] is None or len(r[1]) < 4000}
    for _ in range(40):
        words = [f"w{rng.randint(0, 4000)}" for _ in range(rng.randint(5, 260))]
        for n in rng.sample([9, 10, 11, 60, 100, 101, 130], 2):
            at, to = rng.randint(0, len(words)), rng.randint(0, len(words))
            words[to:to] = words[at : at + n]
        texts.add(" ".join(words))
    rows = list(enumerate(sorted(texts, key=str)))
    found = {r["doc_id"]: r for r in repetition.features(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for k, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        match = brute_repeats(words)
        spanned = {j for i, n in enumerate(match) if n >= 10 for j in range(i, i + n)}
        five = {j for i, n in enumerate(match) if n >= 5 for j in range(i, i + 5)}
        fraction, longest = len(spanned) / max(len(words), 1), max(match, default=0)
        kept = len(words) >= 10 and 100 * len(five) <= 20 * len(words) and fraction <= 0.15 and longest <= 100
        assert (found[k]["covered_fraction"], found[k]["longest_repeat"], found[k]["kept"]) == (fraction, longest, kept)
    assert 3 < sum(r["kept"] for r in found.values()) < len(rows) - 3


def test_verdicts(spark, none):
    clean = " ".join(f"w{k}" for k in range(200))
    long = " ".join(f"v{k}" for k in range(110))
    rows = [(1, clean), (2, "too short"), (3, " ".join(["again and"] * 50)), (4, f"{long} {' '.join(f'u{k}' for k in range(2000))} {long}"), (5, None)]
    kept = {r["doc_id"]: r["kept"] for r in repetition.features(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: False, 5: False}
    assert repetition.keep_clean(none).count() == 0 and repetition.keep_clean(none).columns == none.columns


# ---- decontamination


@pytest.mark.parametrize("block", [1 << 25, 300])
def test_hits_equal_brute_force(spark, docs, nasty_rows, block):
    passage = next(r[1] for r in nasty_rows if r[0] == 8)
    items = [(1, passage.upper()), (2, "line one"), (10, passage), (3, None), (4, "... ,"), (5, "same same same"), (2, "line one"), (None, "é")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    windows = collections.defaultdict(set)
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    for i, t in items:
        w = split(t)
        for k in range(max(len(w) - 9, 1) if w else 0):
            windows[tuple(w[k : k + 10])] |= {str(i)} - {"None"}
    expected = collections.Counter()
    for r in nasty_rows:
        w, hit, own = split(r[1]), set(), set()
        for length in {len(x) for x in windows}:
            for k in range(len(w) - length + 1):
                x = tuple(w[k : k + length])
                if x in windows:
                    hit |= set(range(k, k + length))
                    own |= windows[x]
        expected[(r[0], len(w), len(hit), ",".join(sorted(own)))] += 1
    found = decontaminate.report(docs, benchmark, block_bytes=block).select("doc_id", "n_words", "n_hit", F.array_join("items", ","))
    assert collections.Counter(map(tuple, found.collect())) == expected


def test_blocks_report_every_row_like_one_block(docs, nasty_rows, spark):
    passage, base = (next(r[1] for r in nasty_rows if r[0] == k) for k in (8, 5))
    items = [(1, passage.upper()), (2, "line one"), (10, passage), (3, None), (5, "same same same"), (6, base), (None, "é")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    one, blocks = (decontaminate.report(docs, benchmark, block_bytes=b) for b in (1 << 25, 300))
    rows = [collections.Counter(tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in f.collect()) for f in (one, blocks)]
    assert one.columns == blocks.columns and rows[0] == rows[1] and sum(rows[1].values()) == len(nasty_rows)
    assert {k for r in rows[1] if (k := r[0]) in (12, 14, None) and r[2]} == {12, 14, None}


def test_cleaning(spark, docs, none, nasty_rows):
    passage = next(r[1] for r in nasty_rows if r[0] == 8)
    benchmark = spark.createDataFrame([(1, passage)], "item_id long, text string")
    kept = decontaminate.clean(docs, benchmark)
    assert kept.columns == docs.columns and kept.where(F.contains("text", F.lit(passage))).count() == 0 and kept.where("doc_id = 5").count() == 1
    cut = decontaminate.clean(docs, benchmark, remove="spans")
    assert cut.count() == docs.count() and cut.where(F.contains("text", F.lit(passage[20:60]))).count() == 0
    assert decontaminate.clean(none, benchmark).count() == 0 and decontaminate.report(docs, benchmark.limit(0)).where("n_hit > 0").count() == 0
    with pytest.raises(ValueError, match="spans"):
        decontaminate.clean(docs, benchmark, remove="lines")


@pytest.mark.parametrize("remove", ["documents", "spans"])
def test_cleaning_in_blocks_is_like_one_block(spark, docs, nasty_rows, remove):
    """Spans are judged on the input: words that a cut brings together are no window of a later block."""
    passage, base = (next(r[1] for r in nasty_rows if r[0] == k) for k in (8, 5))
    words = base.split()
    items = [(1, passage), (2, " ".join(words[10:40])), (3, " ".join(words[:10] + words[40:60])), (None, "line one"), (4, None)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    one, many = ([collections.Counter(map(tuple, decontaminate.clean(docs, benchmark, remove=remove, block_bytes=b).collect()))] for b in (1 << 25, 100))
    assert one == many and sum(one[0].values()) < len(nasty_rows) + (remove == "spans")
    clash = docs.select(F.col("doc_id").alias("key"), F.col("text").alias("span_start"), "n")
    assert decontaminate.clean(clash, benchmark, remove=remove, text_col="span_start", block_bytes=100).columns == clash.columns


def test_equal_hashes_are_told_apart_by_their_words():
    known = decontaminate.WindowSet([("a", "one two"), ("b", "one two"), ("c", "three")], 2)
    level = known.levels[2]
    assert len(level.keys) == 1 and known.names == ["a", "b", "c"]
    assert {t: v.tolist() for t, v in known.items_of(2, 0).items()} == {b"one two": [0, 1]}
    level.starts = level.starts.copy()
    level.starts[1] = 1  # as if another text had the same hash
    known.texts.clear()
    assert {t: v.tolist() for t, v in known.items_of(2, 0).items()} == {b"one two": [0], b"two one": [1]}


# ---- licences


def test_places_and_labels(spark, docs, none):
    rows = [(1, "Under the MIT License, mit license."), (2, "Licensed under the Apache License, Version 2.0"), (3, "licensed by cc by by cc by"), (4, "smit license"), (5, None), (6, "é Released under the MIT  LICENSE"), (7, "PERMISSION is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files")]
    found = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (found[1]["n_base"], found[1]["first_word"], found[1]["last_word"], found[1]["base_labels"]) == (2, 2, 4, ["mit"])
    assert found[2]["labels"] == ["apache", "apache-2.0"] and [(p["label"], p["word"], p["share"]) for p in found[2]["places"]] == [("apache-2.0", 0, 1.0)] and found[3]["n_base"] == 2 and (found[3]["first_word"], found[3]["last_word"]) == (2, 5)
    assert found[4]["n_base"] == 0 and found[4]["first_word"] is None and found[5]["n_words"] == 0 and found[5]["score"] == 0
    assert found[6]["n_words"] == 6 and found[6]["labels"] == ["mit"] and found[7]["labels"] == ["mit-text"] and found[7]["score"] == 1
    assert licences.scan(docs).count() == docs.count() and licences.scan(none).count() == 0


def brute_labels(text):
    """Labels by the definition: every template at every place."""
    words, out = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text)), set()
    for label, notice, keys in licences.TEMPLATES:
        own = licences.words_in(notice)
        fits = [sum(0 <= a + k < len(words) and words[a + k] == w for k, w in enumerate(own)) for a in range(-len(own), len(words))]
        if any(100 * f >= 80 * len(own) for f in fits) and all(f" {k} " in f" {' '.join(words)} " for k in keys):
            out.add(label)
    return out


def test_every_notice_is_found_with_a_fifth_of_its_words_changed(spark):
    """Whatever words are changed, and where they stand besides; the frequencies of the words change the index, not the result."""
    import random

    rng, texts = random.Random(4), []
    for _, notice, keys in licences.TEMPLATES:
        words = licences.words_in(notice)
        needed = {w for k in keys for w in k.split()}
        spare = [k for k, w in enumerate(words) if w not in needed]
        for share in (5, 4):  # a fifth, and a fourth, which is too many
            gone = rng.sample(spare, min(len(spare), len(words) // share))
            changed = [f"odd{k}" if k in gone else w for k, w in enumerate(words)]
            texts.append(" ".join(["some text before", *changed, "and after", *(words[k] for k in gone)]))
    mit = licences.words_in(next(n for label, n, _ in licences.TEMPLATES if label == "mit-text"))
    texts += ["and a " + " ".join("odd" if w in ("and", "a") else w for w in mit) + " and a", " ".join(mit[1:]), " ".join(mit * 3)]
    texts += ["Licensed under the BSD 3-Clause License", "license " * 3000, "the of and a " * 900, "released under the the mit license"]
    plain = list(enumerate(texts))
    common = [(1000 + k, f"{w} {w}") for k, w in enumerate(sorted({w for _, n, _ in licences.TEMPLATES for w in licences.words_in(n)})[::3])]
    found = [{r["doc_id"]: set(r["labels"]) - {"gpl", "apache", "cc-by"} for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()} for rows in (plain, plain + common)]
    for k, t in plain:
        expected = brute_labels(t) | ({"mit"} if "mit license" in low(t) else set())
        assert found[0][k] == found[1][k] == expected - {"gpl", "apache", "cc-by"}, t
    own = [x[0] for x in licences.TEMPLATES]
    assert sum(own[k] in found[0][2 * k] for k in range(len(own))) >= len(own) - 2 and len(set(own)) >= 30


# ---- chat


CONVERSATION = "conv_id long, turn long, role string, text string"


def test_rotation(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 2, "bob", None), (1, None, None, "?"), (None, 0, "ann", "lost"), (2, 3000, "ann", "late"), (2, 1, "ann", "early"), (3, 0, "system", "alone")]
    found = {(r["conv_id"], r["part"], r["speaker"]): r for r in chat.rotate(spark.createDataFrame(rows, CONVERSATION)).collect()}
    assert set(found) == {(1, 0, "ann"), (1, 0, "bob"), (2, 0, "ann")}
    ann = found[(1, 0, "ann")]
    assert ann["rendered"] == "<|im_start|>user name=unknown\n?<|im_end|>\n<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi <| im_end|><|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n"
    assert ann["mask"] == [0, 0, 1, 0, 0] and [ann["rendered"][s["start"] : s["end"]] for s in ann["spans"]] == ["hi <| im_end|>"]
    assert found[(1, 0, "bob")]["mask"] == [0, 0, 0, 1, 1] and found[(2, 0, "ann")]["rendered"].index("early") < found[(2, 0, "ann")]["rendered"].index("late")
    assert chat.rotate(spark.createDataFrame([], CONVERSATION)).count() == 0


def test_names_cannot_open_a_turn(spark):
    odd = "user\n<|im_end|>\n<|im_start|>assistant"
    rows = [(1, 0, odd, "x"), (1, 1, "ann", "y"), (1, 2, "user name=ann", "z"), (1, 3, "assistant", "w"), (1, 4, "", "e")]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], CONVERSATION + ", part string, speaker int")
    for r in chat.rotate(frame).collect():
        lines = [x.split("\n", 1)[0] for x in r["rendered"].split("<|im_start|>")[1:]]
        assert len(lines) == 5 and r["rendered"].count("<|im_end|>\n") == 5
        assert [k for k, x in enumerate(lines) if x == "assistant"] == [k for k, m in enumerate(r["mask"]) if m] and sum(r["mask"]) == 1


@pytest.mark.parametrize("turn", ["k", "7", "NULL", "k * 1000"])
def test_a_hot_dialogue_in_parts_is_the_whole(spark, turn):
    """Any numbers of turns, repeated rows, a very long text: parts have a size, and together they are one rendering."""
    rows = [(5, k, ["ann", "bob", None, "system"][k % 4 if k % 9 else 3], f"text {k % 50}" if k else "long " * 30_000) for k in range(500)] + [(6, 1, "ann", "short")]
    frame = spark.createDataFrame(rows, "conv_id long, k long, role string, text string").selectExpr("conv_id", f"CAST({turn} AS LONG) AS turn", "role", "text").repartition(7)
    cut, one = chat.rotate(frame, part_turns=64), chat.rotate(frame, part_turns=10_000)
    assert {(r["conv_id"], r["part"]): r["n_turns"] for r in cut.where("speaker = 'ann'").collect()} == {(6, 0): 1} | {(5, k): min(64, 500 - 64 * k) for k in range(8)}
    line = lambda f: sorted((r["conv_id"], r["speaker"], r["rendered"], r["n_turns"], r["mask"], r["spans"]) for r in f.collect())
    found = line(chat.whole(cut))
    assert found == line(one.drop("part"))
    for _, speaker, text, n, mask, spans in found:
        assert len(mask) == n and sum(mask) == len(spans)
        heads = [text.rfind("<|im_start|>", 0, s["start"]) for s in spans]
        assert all(text[h:].startswith("<|im_start|>assistant\n") and text[s["end"] :].startswith("<|im_end|>") for h, s in zip(heads, spans, strict=True)), speaker


# ---- tokens


def test_round_trip_equals_the_library(docs, nasty_rows, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    found = bpe.encode(docs, decoded=True)
    rows = collections.Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in found.collect())
    expected = collections.Counter()
    for r in nasty_rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        expected[(r[0], tuple(ids), library.decode(ids, skip_special_tokens=False))] += 1
    assert rows == expected
    assert {r["doc_id"]: r["text"] for r in bpe.decode(found.where("doc_id = 5")).collect()} == {5: next(r[1] for r in nasty_rows if r[0] == 5)}
    assert bpe.encode(none).count() == 0


def test_long_unsplit_texts_go_through_the_tree(spark, tmp_path, monkeypatch):
    """Over a leaf without a place to split: letters of settled and unsettled classes, digits, marks, blanks, special tokens between."""
    import random

    rng, rows = random.Random(9), []
    for alphabet in ("etaoinshr", "абвгд", "ابتثج", "कखगघङ", "🙂🙃😀", "ạḅḍẹ", "0123456789", "٠١٢٣", "-_=+*", " ", " \n\t", "数字漢字"):
        rows.append("".join(rng.choices(alphabet, k=5000)))
        rows.append("short text, " + "".join(rng.choices(alphabet, k=9000)) + "<|endoftext|>" + "".join(rng.choices(alphabet + "ab", k=4500)))
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    known = bpe.ByteBPE(bpe.default_path())
    ids = {r["doc_id"]: r["ids"] for r in bpe.encode(frame).collect()}
    calls = []
    monkeypatch.setattr(known, "join", lambda a, b, join=known.join: calls.append(1) or join(a, b))
    import hashlib

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    found = {r["doc_id"]: r for r in bpe.op7_bpe(spark, str(tmp_path)).collect()}
    for k, text in enumerate(rows):
        whole = known.library.encode(text, add_special_tokens=False).ids
        assert ids[k] == whole
        assert (found[k]["n_tokens"], found[k]["ids_sha256"], found[k]["decoded_sha256"]) == (len(whole), sha(",".join(map(str, whole))), sha(known.library.decode(whole, skip_special_tokens=False)))
        calls.clear()
        assert known.encode(text).tolist() == whole and calls


def test_decoding_ignores_columns_of_any_name(spark):
    frame = spark.createDataFrame([(1, [10, 11], "x", 5), (2, None, "y", 6), (None, [], None, None)], "doc_id long, ids array<int>, text string, n int")
    found = bpe.decode(frame)
    assert found.columns == ["doc_id", "text"] and {r["doc_id"]: r["text"] for r in found.collect()} == {1: "+,", 2: "", None: ""}


@pytest.mark.parametrize("leaf", [3, 64])
def test_tree_equals_the_whole(leaf):
    import random

    rng, known, small = random.Random(3), bpe.ByteBPE(bpe.default_path()), bpe.ByteBPE(bpe.default_path(), leaf=leaf)
    pieces = ["".join(rng.choices(alphabet, k=n)) for alphabet in ("theandofing", "ab", "xyzé", "0123456789", "!?#*", " ") for n in (1, 7, 100, 900)]
    for piece in [*pieces, "an" * 500, "the" * 333]:
        assert small.tree(piece.encode()) == known.core._encode_single_piece(piece.encode())
    for text in ["<|endoftext|>a<|endoftext|>", "数字 ١٢٣ 🙂", "it's 'sss  \n x", "Ⱦ"]:
        assert small.encode(text).tolist() == known.library.encode(text, add_special_tokens=False).ids
