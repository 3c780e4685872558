import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, t int, n long, score string, node long"


def random_docs(seed=3, n=60):
    """Random texts with exact and near copies, shared passages, repeated lines and long runs."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(150)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(70))
    docs = []
    for _ in range(n):
        kind = rng.random()
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 160))]
        text = "".join(w + rng.choice([" ", " ", " ", "\n", "\t", "  "]) for w in words)
        if kind < 0.2 and docs:
            text = rng.choice(docs)
        elif kind < 0.45 and docs:
            words = rng.choice(docs).split(" ")
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary).upper()
            text = " ".join(words)
        elif kind < 0.6:
            text = " ".join(words[:20]) + " " + passage + " " + " ".join(words[20:])
        elif kind < 0.7:
            text = " ".join([rng.choice("ab")] * rng.randint(40, 120) + ["b", "a"] * rng.randint(1, 40))
        docs.append(text)
    return docs


def table(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", 1, 2, "y", 3) for i, t in zip(ids, texts)], SCHEMA)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Ids and texts with every odd case, and the table, whose further columns have clashing names."""
    texts = random_docs() + [
        None, "", " \n\t ", "one", "one two three", "ONE two three", "x " * 30_000,
        "same line of seven words here now\nsame line of seven words here now\nother", "tab\tand\x0bbreak\x0c here\r\nΣΑΣ İ"]
    ids = [*range(len(texts)), None, None]
    texts += ["row without an id " * 20, None]
    # A row that occurs twice.
    ids.append(2)
    texts.append(texts[2])
    return list(zip(ids, texts)), table(spark, texts, ids)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
