"""Toxicity scores: boosted trees over dense text features, calibrated by isotonic regression.

Features are rates of a text: hits of a weighted lexicon (fixed words, and words and word beginnings
that the labelled rows show to be toxic), hits near a second-person word, capitals, punctuation and
obfuscated spellings. Labels are learned from at most ``TRAIN_ROWS`` labelled rows, in three parts by
hash of the id: one for the lexicon, one for the trees, one for the calibration, so that no part
sees its own labels through another. Every text is scored whole, in one pass without a shuffle.

Null and empty texts have zero features and get the score that goes with them. Where the labels
hold fewer than two classes the score is the share of toxic labels, 0 without labels. Repeated label
rows count once, as toxic if one of them is; null labels are left out.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.session import settle

from .batches import bounded_batches, frugal, slices, texts

#: At most so many labelled rows are learned from, the first by hash of the id.
TRAIN_ROWS = 20_000
#: At most so many learned lexicon entries, each seen in at least MIN_SEEN toxic texts.
LEXICON_ROWS, MIN_SEEN, MIN_ODDS = 4_000, 4, 3.0
BEGINNINGS = (4, 5, 6)
TREES, DEPTH = 24, 3
NEAR = 6

# Common insults and second-person words.
INSULTS = ("idiot", "moron", "stupid", "scum", "trash", "loser", "clown", "pathetic", "worthless", "disgusting")
SECOND_PERSON = (
    "you", "your", "yours", "yourself", "du", "dich", "dir", "dein", "deine", "ihr", "euch",
    "tu", "toi", "ton", "ta", "vous", "votre", "tú", "ti", "tus", "usted", "ustedes", "vosotros",
)
LEET = str.maketrans("@4310$57!", "aaeiossti")

FEATURES = (
    "log_words", "hits", "log_hits", "kinds", "strongest", "weight_rate", "near_second_person",
    "second_person", "capitals", "capital_words", "marks", "mark_runs", "obfuscated", "obfuscated_hits",
)
_word = re.compile(r"\w+")
_odd = re.compile(r"[^\W\d_]+[@$!*013457][^\W_]*[\w@$!*]*")
_marks = re.compile(r"[!?]+")


def held_out(key: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def entries(words: list[str]) -> set[str]:
    """Lexicon entries a text can hit: its words, and their beginnings marked with a star."""
    found = set(words)
    for n in BEGINNINGS:
        found |= {w[:n] + "*" for w in words if len(w) > n}
    return found


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    """The dense features of one text, in the order of ``FEATURES``."""
    words = _word.findall(text.lower())
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    weight: dict[str, float] = {}
    hits: list[int] = []
    for i, w in enumerate(words):
        got = weight.get(w)
        if got is None:
            found = [lexicon[e] for e in (w, w[:4] + "*", w[:5] + "*", w[:6] + "*") if e in lexicon]
            got = weight[w] = max(found, default=0.0)
        if got:
            hits.append(i)
    you = [i for i, w in enumerate(words) if w in _YOU]
    near = 0
    if you and hits:
        at = np.searchsorted(you, hits)
        before = np.abs(np.asarray(hits) - np.asarray(you)[np.maximum(at - 1, 0)])
        after = np.abs(np.asarray(you)[np.minimum(at, len(you) - 1)] - np.asarray(hits))
        near = int((np.minimum(before, after) <= NEAR).sum())
    weights = [weight[words[i]] for i in hits]
    upper = len(text) - len(text.translate(_NO_CAPITALS)) if text.isascii() else sum(map(str.isupper, text))
    marks = _marks.findall(text)
    odd = _odd.findall(text)
    plain = [w.translate(LEET).lower() for w in odd]
    return [
        float(np.log1p(n)), len(hits) / n, float(np.log1p(len(hits))), float(len({words[i] for i in hits})),
        max(weights, default=0.0), sum(weights) / n, near / n, len(you) / n, upper / len(text),
        sum(1 for w in _word.findall(text) if len(w) > 1 and w.isupper()) / n, sum(map(len, marks)) / n,
        sum(1 for m in marks if len(m) > 1) / n, len(odd) / n, float(sum(1 for w in plain if w in lexicon)),
    ]


_YOU = frozenset(SECOND_PERSON)
_NO_CAPITALS = {c: None for c in range(ord("A"), ord("Z") + 1)}


def training_rows(labels: DataFrame, key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """Ids and labels (``k``, ``label``, ``part``) of the bounded sample that is learned from."""
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("double").alias("label"))
    known = known.where(F.col("k").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("k")))
    known = known.groupBy("k").agg(F.max("label").alias("label"))
    order = F.xxhash64(F.col("k").cast("string"))
    sample = known.orderBy(order, "k").limit(TRAIN_ROWS)
    return sample.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), F.col("k").cast("string")), F.lit(10)))


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Log odds of the entries that toxic texts hold far more often; ``rows``: label, text."""
    @frugal
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=1 << 20):
                found = [entries(_word.findall(t.lower())) for t in texts(part)]
                label = np.repeat(part.column("label").to_numpy(zero_copy_only=False), list(map(len, found)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([e for f in found for e in f], pa.string()), pa.array(label, pa.float64())], ["entry", "label"])

    totals = rows.agg(F.count_if(F.col("label") == 1).alias("t"), F.count_if(F.col("label") != 1).alias("n")).first()
    seen = bounded_batches(rows).mapInArrow(spread, "entry string, label double").groupBy("entry").agg(
        F.count_if(F.col("label") == 1).alias("t"), F.count_if(F.col("label") != 1).alias("n"))
    odds = F.log((F.col("t") + 0.5) / (totals.t + 1.0)) - F.log((F.col("n") + 0.5) / (totals.n + 1.0))
    best = seen.where(F.col("t") >= MIN_SEEN).select("entry", odds.alias("odds")).where(F.col("odds") >= MIN_ODDS)
    top = best.orderBy(F.desc("odds"), "entry").limit(LEXICON_ROWS).collect()
    return {w: MIN_ODDS for w in INSULTS} | {r.entry: float(r.odds) for r in top}


def featured(docs: DataFrame, lexicon: dict[str, float], text: str = "text") -> DataFrame:
    """Adds ``x``, the features of ``text``; ``docs``: any columns, which stay, but for one called text.

    ``text`` may be a field of a struct, such as ``row.text``: rows that come back whole then hold their text once.
    """
    kept = [n for n in docs.columns if n != "text"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")

    @frugal
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                x = pa.array([features(t, lexicon) for t in texts(part, text)], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), x], [*kept, "x"])

    return bounded_batches(docs).mapInArrow(extract, f"{fields}, x array<double>")


def fit_scorer(docs: DataFrame, labels: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Learns from the labels of ``docs`` (``k``, ``text``); the result adds ``score`` in place of ``text``."""
    sample = settle(training_rows(labels), "toxicity-sample")
    # The sample has at most TRAIN_ROWS rows of three numbers.
    rows = settle(docs.join(F.broadcast(sample), "k").select("k", "text", "label", "part"), "toxicity-rows")
    classes = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    share = sum(n for label, n in classes.items() if label == 1) / max(1, sum(classes.values()))
    constant = lambda df, text="text": df.drop("text").withColumn("score", F.lit(float(share)))
    if len(classes) < 2:
        return constant
    lexicon = learn_lexicon(rows.where("part < 5").select("text", "label"))
    learned = settle(featured(rows.where("part >= 5").select("label", "part", "text"), lexicon), "toxicity-features")
    learned = learned.withColumn("v", array_to_vector("x"))
    trees, check = learned.where("part < 8"), learned.where("part >= 8")
    if min(part.select("label").distinct().count() for part in (trees, check)) < 2:
        trees = check = learned
        if learned.select("label").distinct().count() < 2:
            return constant
    few = trees.select("label", "v").coalesce(4)
    model = GBTClassifier(labelCol="label", featuresCol="v", maxIter=TREES, maxDepth=DEPTH, seed=7).fit(few)
    probability = vector_to_array(F.col("probability"))[1]
    raw = model.transform(check).select("label", probability.alias("__raw"))
    curve = IsotonicRegression(labelCol="label", featuresCol="__raw", predictionCol="__score").fit(raw)

    def score(df: DataFrame, text: str = "text") -> DataFrame:
        names = [c for c in df.columns if c != "text"]
        out = model.transform(featured(df, lexicon, text).withColumn("v", array_to_vector("x")))
        out = curve.transform(out.select(*names, probability.alias("__raw")))
        return out.select(*names, F.greatest(F.lit(0.0), F.least(F.lit(1.0), "__score")).alias("score"))

    return score


def score_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) of every document."""
    docs = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text"))
    scored = fit_scorer(docs, labels)(docs)
    return scored.select(
        F.col("k").alias(key), held_out(F.col("k")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, columns unchanged, that are not predicted toxic; no shuffle of the texts."""
    plain = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return fit_scorer(plain, labels)(rows, f"row.{text}").where("score < 0.5").select("row.*")
