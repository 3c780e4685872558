"""Learned operators: held-out accuracy, targets met, and defined results for odd input."""

import random

import pytest
from conftest import random_docs
from pyspark.sql import functions as F

from tallyfold.llm import mixing, secret_scan, toxicity
from tallyfold.llm.queries import table

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def real(spark):
    return table(spark, SF, "documents"), table(spark, SF, "labels")


def test_toxicity_on_held_out_rows(real):
    docs, labels = real
    scored = toxicity.score_documents(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert scored.score.between(0, 1).all() and ((scored.score >= 0.5) == (scored.predicted == 1)).all()
    assert (scored.predicted == scored.toxic).mean() > 0.96
    clean = scored[scored.toxic == 0]
    assert (clean.predicted == 1).mean() < 0.01


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs, no_labels):
    rows, df = odd_docs
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)] + [(3, 1, None), (4, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.score_documents(df, labels).toPandas()
    assert len(out) == len(rows) and out.score.between(0, 1).all() and not out.predicted.isna().any()
    kept = toxicity.without_toxic(df, labels)
    assert kept.columns == df.columns and kept.count() == (out.score < 0.5).sum()
    assert {r.score for r in toxicity.score_documents(df, no_labels).collect()} == {0.0}
    only = labels.where("toxic = 1 AND doc_id IS NOT NULL")
    assert {r.score for r in toxicity.score_documents(df, only).collect()} == {1.0}
    assert toxicity.score_documents(no_docs, labels).count() == 0


def test_labels_of_held_out_rows_are_not_learned_from(spark):
    labels = spark.createDataFrame([(i, 1, 1) for i in range(500)], "doc_id long, quality int, toxic int")
    used = toxicity.training_rows(labels)
    assert used.where(F.crc32(F.col("k").cast("string")) % 5 == 0).count() == 0
    assert used.count() == labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).count()


def test_obfuscated_and_near_second_person_hits_count():
    plain, close = toxicity.features("word " * 20 + "idiot", {"idiot": 3.0}), toxicity.features("word " * 20 + "you idiot", {"idiot": 3.0})
    at = {n: i for i, n in enumerate(toxicity.FEATURES)}
    assert plain[at["near_second_person"]] == 0 < close[at["near_second_person"]]
    assert toxicity.features("an 1d1ot or id10t here", {"idiot": 3.0})[at["obfuscated_hits"]] == 1
    assert toxicity.features("", {}) == [0.0] * len(toxicity.FEATURES)


def test_mixing_meets_its_targets(real):
    docs, labels = real
    out = mixing.document_rates(docs, labels).toPandas()
    total = out.n_words.sum()
    assert (out.rate >= 0).all()
    for domain, share in mixing.TARGETS.items():
        assert abs((out.n_words * out[f"p_{domain}"] * out.rate).sum() / total - share) < 0.02
        assert abs((out.n_words * out[f"p_{domain}"] * out.copies).sum() / total - share) < 0.03
    known = out.merge(labels.toPandas(), on="doc_id")
    good = known[(known.quality == 1) & (known.toxic == 0)]
    assert good.p_good.mean() > 0.9 and (good.copies > 0).mean() > 0.98


def test_rates_solve_the_least_squares(spark):
    """The fitted rates against a long plain projected gradient run."""
    import numpy as np

    rng = np.random.default_rng(1)
    words, p = rng.integers(1, 50, 300), rng.dirichlet([0.4, 0.3, 0.2], 300)
    rows = spark.createDataFrame([(int(w), [float(x) for x in q]) for w, q in zip(words, p)], "__words long, __p array<double>")
    targets = {"good": 0.7, "poor": 0.3, "toxic": 0.0}
    y = mixing.fit_rates(rows, targets)
    goal, r = np.array([targets[d] for d in mixing.DOMAINS]) * words.sum(), np.ones(300)
    for _ in range(20000):
        error = (r * words) @ p - goal
        r = np.maximum(0, r - 0.002 * (p @ error / (mixing.RIDGE * words.sum()) + r - 1))
    assert np.abs(np.maximum(0, 1 - p @ y) - r).max() < 1e-3


def test_rates_that_do_not_settle_are_an_error(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(7)
    words, p = np.exp(rng.normal(0, 3, 60)).round() + 1, rng.dirichlet([0.1, 0.1, 0.1], 60)
    rows = spark.createDataFrame([(int(w), [float(x) for x in q]) for w, q in zip(words, p)], "__words long, __p array<double>")
    targets = {"good": 0.1, "poor": 0.9, "toxic": 0.0}
    y, goal = mixing.fit_rates(rows, targets), np.array([targets[d] for d in mixing.DOMAINS]) * words.sum()
    error = (np.maximum(0, 1 - p @ y) * words) @ p - goal
    assert np.abs(error / (mixing.RIDGE * words.sum()) - y).max() < 1e-4
    monkeypatch.setattr(mixing, "STEPS", 1)
    with pytest.raises(RuntimeError, match="did not settle"):
        mixing.fit_rates(rows, targets)


def test_mixing_of_odd_rows(spark, odd_docs, no_docs, no_labels):
    rows, df = odd_docs
    rng = random.Random(0)
    labels = spark.createDataFrame([(i, rng.randint(0, 1), 0) for i in range(50)] + [(7, None, 1), (None, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int")
    out = mixing.document_rates(df, labels).toPandas()
    assert len(out) == len(rows) and (out[out.n_words == 0].copies == 1).all()
    mixed = mixing.mixed_documents(df, labels)
    assert mixed.columns == df.columns and mixed.count() == out.copies.sum()
    alone = mixing.document_rates(df, no_labels)
    assert alone.count() == len(rows) and {round(r.p_good, 6) for r in alone.collect()} == {1.0}
    assert mixing.document_rates(no_docs, labels).count() == 0


def test_random_docs_are_stable():
    assert random_docs() == random_docs()


def test_hidden_credentials_of_learned_formats_are_found(spark):
    """Keys and tokens that no fixed pattern shows, of the formats of those that it does; prose and paths are left alone."""
    import string

    rng = random.Random(11)
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    upper = string.ascii_uppercase + string.digits
    token, key = lambda: "ghp_" + pick(string.ascii_letters + string.digits, 36), lambda start: start + pick(upper, 16)
    vocabulary = [pick("aeioutrnsl", rng.randint(3, 9)) for _ in range(400)]
    prose = lambda: " ".join(rng.choice(vocabulary) for _ in range(30)) + f" see www.example.com/{rng.choice(vocabulary)}/page{rng.randrange(90)} or first.last.{rng.randrange(99)}@mail, 2024-01-{rng.randrange(10, 29)}T10"
    texts = []
    for _ in range(400):
        texts += [f"{prose()} token = \"{token()}\"", f"{prose()} {key('AKIA')} {prose()}", f"{pick('0123456789abcdef', rng.choice([32, 40]))} {prose()}"]
    hidden = [(f"{prose()} {v} {prose()}", v) for v in [token() for _ in range(100)] + [key("ASIA") for _ in range(100)]]
    rows = [(i, t) for i, t in enumerate([h for h, _ in hidden] + texts + [prose() for _ in range(600)])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r.doc_id: [tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x.startswith("format")] for r in secret_scan.scan_documents(df).collect()}
    exact = [[rows[i][1][a:b] for a, b in found[i]] == [v] for i, (_, v) in enumerate(hidden)]
    assert sum(exact[:100]) >= 90 and sum(exact[100:]) >= 90
    assert not any(found[i] for i in range(200, len(rows)))
    automata, _ = secret_scan.learn_formats(df.select("text"))
    assert all(len(a.moves) >= 20 for a in automata)
