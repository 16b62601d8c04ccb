import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, blob long, id string, _group string, n int"


def prose(rng: random.Random, words: int) -> str:
    """Invented prose."""
    parts = ["ka", "lo", "mi", "re", "su", "té", "na", "vo", "pi", "du", "xe", "fa"]
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(words))


def nasty(seed: int = 5) -> list[tuple]:
    """Nulls, empty and very long texts, copies, near copies, shared passages, repeated rows and ids."""
    rng = random.Random(seed)
    base, passage = prose(rng, 120), prose(rng, 60)
    near = base.split()
    texts: list[str | None] = [None, "", "   \n\t ", "a", "É", base, base, base.upper(), passage]
    for k in range(6):
        words = list(near)
        words[k * 15 + 3] = f"changed{k}"
        texts.append(" ".join(words))
    texts += [f"{prose(rng, 30)} {passage} {prose(rng, 30)}" for _ in range(6)]
    texts += [prose(rng, 3000), "x" * 20000, " ".join(["same"] * 400), "line one here is long enough to count\n" * 12, "\x00 odd \x1f bytes é\x85", prose(rng, 9), prose(rng, 4)]
    texts += [prose(rng, 40) for _ in range(10)]
    rows = [(k, t, "en" if k % 3 else None, "src", k, "b", 1, "i", "g", 2) for k, t in enumerate(texts)]
    rows += [rows[12], rows[12], (14, base + " other text of one id", None, None, None, None, None, None, None, None), (None, base, "en", None, 1, None, None, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def nasty_rows():
    return nasty()


@pytest.fixture(scope="session")
def docs(spark, nasty_rows):
    return spark.createDataFrame(nasty_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
