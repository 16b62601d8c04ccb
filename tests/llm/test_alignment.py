"""The alignment of two tokenizers against plain versions over byte offsets."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import tokenizers

from strandmill.llm import alignment
from strandmill.llm.textarrays import slices

TEXTS = ["a", "x" * 9000, "hello <|endoftext|> and <s> there", "naïve▁x", "日本語 テスト 🙂🙂", "a\x00b  c\n\n d", " lead", "trail ", "　x y", "\t", "no. 1, no. 1", "A A A A"]


@pytest.fixture(scope="module")
def both():
    library = tokenizers.Tokenizer.from_file(alignment.byte_path())
    library.encode_special_tokens = True
    return library, sentencepiece.SentencePieceProcessor(model_file=alignment.piece_path())


def plain(both, text):
    """(a, b, groups, links) of a text by the ends of its tokens; nothing if the sides differ."""
    library, pieces = both
    if not text:
        return [], [], [], []
    a, b = library.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
    bytes_a = [bytes(alignment.ByteBPE(alignment.byte_path()).by_id[t]) for t in a] if not hasattr(plain, "by_id") else [plain.by_id[t] for t in a]
    bytes_b = [bytes([int(pieces.id_to_piece(t)[3:5], 16)]) if pieces.is_byte(t) else pieces.id_to_piece(t).replace("▁", " ").encode() for t in b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return [], [], [], []
    spans = []
    for side in (bytes_a, bytes_b):
        ends = np.cumsum([len(x) for x in side]).tolist()
        spans.append(list(zip([0, *ends], ends, strict=False)))
    shared = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    groups, low = [], 0
    for high in shared:
        groups.append(tuple([t for t, (s, e) in zip(ids, span, strict=True) if low <= s and e <= high] for ids, span in zip((a, b), spans, strict=True)))
        low = high
    links, first = [], 0
    for i, (s, e) in enumerate(spans[0]):
        while spans[1][first][1] <= s:
            first += 1
        j = first
        while j < len(b) and spans[1][j][0] < e:
            links.append((a[i], b[j]))
            j += 1
    return a, b, groups, links


plain.by_id = alignment.ByteBPE(alignment.byte_path()).by_id


def expected(both, rows):
    """The query's rows, by dictionaries over the whole table."""
    found = [(i, *plain(both, t)) for i, t in rows]
    count = Counter(pair for _, _, _, _, links in found for pair in set(links))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for i, a, b, groups, links in found:
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((i, len(a), len(b), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(shown.encode()).hexdigest() if shown else ""))
    return Counter(out)


def test_rows_against_plain_version(spark, both, docs, nasty_rows):
    found = alignment.link_counts(docs)
    assert Counter(tuple(r) for r in found.collect()) == expected(both, [(r[0], r[1]) for r in nasty_rows])


def test_hard_texts(spark, both):
    rows = list(enumerate([*TEXTS, None, "", *TEXTS]))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(tuple(r) for r in alignment.link_counts(frame).collect()) == expected(both, rows)


def test_groups(spark, both):
    frame = spark.createDataFrame([(1, "hello <|endoftext|> there"), (2, None), (3, "naïve▁x")], "doc_id long, text string")
    found = {r["doc_id"]: r["groups"] for r in alignment.align(frame).collect()}
    assert found[2] is None and found[3] is None
    assert [(g["a"], g["b"]) for g in found[1]] == plain(both, "hello <|endoftext|> there")[2]


def test_empty_table(spark, none):
    assert alignment.link_counts(none).collect() == []


def test_steps_and_single_runs_agree(monkeypatch):
    """Whatever the number of runs that step together."""
    texts = pa.table({"text": [" ".join(["wörld of tokens", "x" * 500, "1234 5678,90"] * 30), *TEXTS]})
    part = next(slices(texts.to_batches(), max_bytes=1 << 30))
    pair = alignment.loaded(alignment.byte_path(), alignment.piece_path())
    shown, links = [], []
    for few in (1, 10**9):
        monkeypatch.setattr(alignment, "FEW_RUNS", few)
        found = pair.align(part)
        shown.append(found.shown())
        links.append(sorted(zip(found.link_a.tolist(), found.link_b.tolist(), strict=True)))
    assert shown[0] == shown[1] and links[0] == links[1]


def test_transducer_refuses_other_bytes():
    with pytest.raises(ValueError, match="not the same bytes"):
        alignment.Transducer([b"ab"], [b"b"]).run(np.array([0]), np.array([0]), np.array([0, 1]), np.array([0, 1]))


def test_memo_with_colliding_slots(monkeypatch):
    """Transitions that share a slot of the table are still told apart."""
    monkeypatch.setattr(alignment, "_SLOT_BITS", 1)
    a, b = [b"a", b"b", b"ab", b"ba"], [b"a", b"b", b"aba"]
    machine = alignment.Transducer(a, b)
    monkeypatch.setattr(alignment, "FEW_RUNS", 1)
    for _ in range(2):
        links_a, links_b, last_a, last_b = machine.run(np.array([2, 0, 0, 1]), np.array([2, 0, 1]), np.array([0, 2, 4]), np.array([0, 1, 3]))
        assert sorted(zip(links_a.tolist(), links_b.tolist(), strict=True)) == [(0, 0), (1, 0), (2, 1), (3, 2)]
        assert last_a.tolist() == [False, True, True, True] and last_b.tolist() == [True, True, True]
