"""Small corpora for the operators: copies, near copies, odd rows."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, n int, cls string, key string, size int, h1 long, row_key string"
CLASH = (7, 3, "c", "k", 5, 9, "r")


def make_rows(seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [sentence(rng.randint(1, 160)).replace(" a", "\na") for _ in range(40)]
    base = sentence(120)
    texts += [base, base.upper(), base + " ", base]
    for _ in range(8):  # near copies
        w = base.split(" ")
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(" ".join(w))
    passage = sentence(70)
    texts += [sentence(20) + "\n" + passage + "\n" + sentence(9) for _ in range(4)]
    texts += ["", " \n\t ", "é" * 400, "ab" * 3000, "x", None, "one two", "one two", "One two", "z " * 900, sentence(9000)]
    rows = [(i, t, ("en", "fr", None)[i % 3], ("s1", "s2", "s3", None)[i % 4], 0, *CLASH) for i, t in enumerate(texts)]
    rows.append(rows[3])  # a row twice
    rows.append((5, texts[3], "en", "s1", 0, *CLASH))  # one id with two texts
    rows.append((None, texts[4], None, None, None, *CLASH))
    rows.append((None, None, None, None, None, *CLASH))
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
