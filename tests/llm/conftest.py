from __future__ import annotations

import random

import pytest

WORDS = [f"w{i}" for i in range(400)]


@pytest.fixture(scope="session")
def texts() -> list[str]:
    """A small corpus: originals, copies, near copies, shared passages, odd texts."""
    rng = random.Random(5)
    out = []
    for _ in range(40):
        out.append(" ".join(rng.choice(WORDS) for _ in range(rng.randint(30, 160))))
    passage = " ".join(f"p{i}" for i in range(60))
    for i in range(12):
        words = out[i].split()
        words[rng.randrange(len(words))] = "changed"
        out.append(" ".join(words))
        out.append(out[i])
        out.append(f"{' '.join(rng.choice(WORDS) for _ in range(20))} {passage}\n{' '.join(rng.choice(WORDS) for _ in range(rng.randint(0, 9)))}")
    out += ["", " \n\t ", "one", "One", "two words", "a b c", "A B C", "a b c d", "same same same same same", "x\x0by\x0cz q  r", "été Été ÉTÉ déjà vu", "a" * 3000, "the end " * 500]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """doc_id, text and clashing extra columns; a null text, a null id, a repeated row."""
    rows = [(i * 3 + 1, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    rows += [(100_000, None, None, None, None), (None, texts[0], "en", None, 1), rows[2]]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return frame.selectExpr("*", "1 AS score", "2 AS n_words", "3 AS block", "'x' AS component").repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")
