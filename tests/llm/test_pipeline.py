import random
import re
from collections import Counter

import corpus_pipeline
from tests.llm.conftest import prose
from tests.llm.test_jaccard import brute as components
from tests.llm.test_jaccard import shingles
from tests.llm.test_suffixes import brute as _  # noqa: F401  the same definition, applied below to kept texts


def test_pipeline_equals_brute_force(spark, nasty_rows, tmp_path):
    """All stages by their definitions on the small fixture."""
    rng = random.Random(11)
    long = prose(rng, 105)
    rows = [*nasty_rows, (300, f"{long} {prose(rng, 2000)} {long}", *nasty_rows[0][2:]), (301, f"{prose(rng, 100)} {' '.join(long.split()[:12] * 2)}", *nasty_rows[0][2:]), (None, prose(rng, 30), *nasty_rows[0][2:]), (2**62 + 1, prose(rng, 30), *nasty_rows[0][2:])]
    frame = spark.createDataFrame([(*r[:5], "clash", 1, 2, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, gone string, id long, c0 int, key string")
    frame.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    item = " ".join(next(r[1] for r in rows if r[0] == 15).split()[:12])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = sorted(((r["doc_id"], r["n_tokens"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str)

    kept = []
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")
        windows = {n: Counter(tuple(words[k : k + n]) for k in range(len(words) - n + 1)) for n in (5, 10, 101)}
        hit = {n: {j for k in range(len(words) - n + 1) if windows[n][tuple(words[k : k + n])] > 1 for j in range(k, k + n)} for n in windows}
        if len(words) >= 10 and 100 * len(hit[5]) <= 20 * len(words) and len(hit[10]) <= 0.15 * len(words) and not hit[101]:
            kept.append((r[0], r[1]))
    assert not {300, 301} & {i for i, _ in kept}
    least = components(kept)
    gone = {i for i, t in kept if i is not None and least[(i, shingles(t))] != i}
    kept = [(i, t) for i, t in kept if i not in gone]
    first = {}
    for i, t in kept:
        b = t.encode()
        for p in range(len(b) - 49) if i is not None else ():
            first[b[p : p + 50]] = min(first.get(b[p : p + 50], i), i)
    cut = []
    for i, t in kept:
        b, mark = t.encode(), bytearray(len(t.encode()))
        for p in range(len(b) - 49) if i is not None else ():
            if first[b[p : p + 50]] < i:
                mark[p : p + 50] = b"\x01" * 50
        left = bytes(x for x, g in zip(b, mark, strict=True) if not g).decode("utf-8", "ignore")
        if left or not t:
            cut.append((i, left))
    window = tuple(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", item.lower()))
    windows = {window[k : k + 10] for k in range(len(window) - 9)}
    clean = []
    for i, t in cut:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        if not any(tuple(w[k : k + 10]) in windows for k in range(len(w) - 9)):
            clean.append((i, t))
    from strandmill.llm import bpe

    library = bpe.ByteBPE(bpe.default_path()).library
    ids = [(i, library.encode(t, add_special_tokens=False).ids) for i, t in clean]
    assert found == sorted(((i, len(x), tuple(x)) for i, x in ids), key=str)
    assert len(clean) < len(cut) < len(rows) and None in {i for i, _ in clean}


def test_stages_pass_other_columns_on(spark, nasty_rows):
    """Columns beyond those of documents stay, whatever their names."""
    docs = spark.createDataFrame([(*r[:5], "clash", 1, 2, "x", 3) for r in nasty_rows], "doc_id long, text string, lang string, source string, n_chars long, gone string, id long, c0 int, key string, _id int").repartition(3)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, "/root/testdata/sf0.001")
        assert found.columns == docs.columns and found.where("gone = 'clash'").count() > 0, name


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns
    empty = docs.limit(0)
    for _name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0
