import random

import pytest
from llm_cases import DE, EN, make_docs, odd_rows, prose


@pytest.fixture(scope="session")
def odd(spark):
    return make_docs(spark, odd_rows())


@pytest.fixture(scope="session")
def empty(spark, odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def collection(spark):
    """Two languages, exact and near copies of several sizes, and documents
    that share a passage."""
    rng = random.Random(11)
    passage = prose(rng, 60)
    texts = []
    for i in range(40):
        base = DE if i % 3 == 0 else EN
        text = prose(rng, rng.choice([5, 12, 40, 150, 400]), base)
        texts.append((text, "de" if i % 3 == 0 else "en"))
        for _ in range(rng.choice([0, 0, 1, 3])):
            w = text.split(" ")
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = "edited"
            texts.append((" ".join(w), texts[-1][1]))
    texts += [(prose(rng, 80) + " " + passage, "en") for _ in range(6)]
    big = prose(rng, 200)
    for i in range(30):  # one large group of near copies
        w = big.split(" ")
        w[i] = f"changed{i}"
        texts.append((" ".join(w), "en"))
    texts += [("same short text", "en")] * 5
    rng.shuffle(texts)
    rows = [(i * 3, t, g, f"s{i % 4}" if i % 7 else None) for i, (t, g) in enumerate(texts)]
    return rows, make_docs(spark, rows)
