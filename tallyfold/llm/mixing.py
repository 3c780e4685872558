"""Mixing to target weights with soft membership.

A softmax classifier, learned from a bounded sample of the labelled table, gives every document a
probability for each domain. Document i with c_i words then stands for c_i * p_ik expected words of
domain k. Rates r_i >= 0 minimise the squared errors of the domain totals sum_i r_i c_i p_ik against
their targets, plus a small ridge that keeps each rate near 1 (without it a target that is out of
reach would be paid for by wild rates). The gradient of a rate, in words, is p_i . e with e the K errors.
So a projected gradient step from 1 is r_i = max(0, 1 - p_i . y) for some y of K numbers, and the minimum
has this form. The y are found by Newton steps on the K numbers: a projected gradient step scaled by the
Gram matrix of the rates that are not held at 0. A step that does not lower the dual objective enough is
halved, and steps go on until y settles; not settling in ``STEPS`` sums is an error. Each step needs one
distributed sum, of the K errors, the Gram matrix and the objective; rates never leave the executors.

A document is emitted floor(rate + u) times, u a fixed uniform number of its id. Null and empty texts
have no words, move no sum, and are kept once. A domain without labels gets probability 0 and its
target stays out of reach. Without labels all documents are of the first domain. Labels of one id are
taken together (the least quality, the greatest toxicity); null labels are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.session import settle

from .batches import bounded_batches, frugal, slices, texts_of
from .fingerprints import _FOLDED, Words, prefix_sums, span, words_of

#: Domains in the order of their probabilities, and the share of words each should have.
DOMAINS = ("good", "poor", "toxic")
TARGETS = {"good": 0.92, "poor": 0.08, "toxic": 0.0}
#: Labelled rows that are learned from; half give the evidence of words, half the softmax.
TRAIN_ROWS = 16_000
#: Words and word beginnings are counted in so many (a power of two) hash buckets; a bucket is evidence for a
#: domain when it was seen in so many documents, with such log odds.
BUCKET_BITS, LEAST_SEEN, LEAST_ODDS = 18, 4, 2.0
BEGINNING = 5
#: Distributed sums at most, the change of y that ends the steps, and weight of the ridge towards 1.
STEPS, SETTLED, RIDGE = 60, 1e-6, 0.01
SLICE = 1 << 20
_MARKS = [np.frombuffer(m, np.uint8) for m in (b"!?", b"#*$%&<>", b"|", b"0123456789", bytes(range(65, 91)))]


def buckets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Text and bucket of every word and of every word's beginning."""
    sums = prefix_sums(_FOLDED[words.raw])
    begun = span(sums, words.starts, np.minimum(words.starts + BEGINNING, words.ends)) ^ np.uint64(0x5DEECE66D << 20)
    text = np.repeat(np.arange(len(words.first) - 1), words.counts())
    both = np.concatenate([words.hashes, begun]) >> np.uint64(64 - BUCKET_BITS)
    return np.concatenate([text, text]), both.astype(np.int64)


def features(texts: pa.Array, evidence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word counts, and a row of features for every text: shares of marks, and evidence for each domain."""
    words = words_of(texts, fold=True)
    counts, rows = words.counts(), len(words.first) - 1
    size = np.maximum(counts, 1)
    columns = [np.log1p(counts) / 10]
    first = np.concatenate([words.starts, [len(words.raw)]])[np.minimum(words.first, len(words.starts))]
    for kind in _MARKS:
        table = np.zeros(256, bool)
        table[kind] = True
        seen = np.searchsorted(np.flatnonzero(table[words.raw]), first)
        columns.append(np.sqrt(np.diff(seen) / size))
    text, bucket = buckets(words)
    for weight in evidence:
        w = weight[bucket]
        some = np.flatnonzero(w)
        total = np.bincount(text[some], w[some], minlength=rows)
        most = np.zeros(rows)
        np.maximum.at(most, text[some], w[some])
        columns += [np.log1p(total), total / np.sqrt(size), most]
    return counts, np.stack(columns, 1)


@dataclass
class Softmax:
    weights: np.ndarray
    bias: np.ndarray
    #: Domain of each row of the weights.
    domains: list[int]
    evidence: np.ndarray

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(DOMAINS)))
        z = x @ self.weights.T + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        out[:, self.domains] = z / z.sum(1, keepdims=True)
        return out


def domain_labels(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """``k`` and ``domain`` (place in ``DOMAINS``) of the labelled documents."""
    known = labels.where(F.col(key).isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy(F.col(key).alias("k")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return known.select("k", F.when(F.col("toxic") > 0, 2).when(F.col("quality") > 0, 0).otherwise(1).alias("domain"))


def learn_evidence(rows: DataFrame) -> np.ndarray:
    """Log odds of each bucket for each domain, 0 where there is little; ``rows``: ``domain``, ``text``."""
    @frugal
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                text, bucket = buckets(words_of(part.column("text"), fold=True))
                once = np.unique(text << BUCKET_BITS | bucket)
                domain = part.column("domain").to_numpy()[once >> BUCKET_BITS]
                yield pa.RecordBatch.from_arrays([pa.array(domain), pa.array(once & ((1 << BUCKET_BITS) - 1))], ["domain", "bucket"])

    size = np.zeros(len(DOMAINS))
    for r in rows.groupBy("domain").count().collect():
        size[r.domain] = r["count"]
    seen = np.zeros((len(DOMAINS), 1 << BUCKET_BITS), np.float32)
    counts = bounded_batches(rows).mapInArrow(spread, "domain int, bucket long").groupBy("domain", "bucket").count()
    counts = counts.toArrow()  # at most domains x 2^BUCKET_BITS rows
    seen[counts.column("domain").to_numpy(), counts.column("bucket").to_numpy()] = counts.column("count").to_numpy()
    rest, whole = seen.sum(0) - seen, size.sum()
    odds = np.log((seen + 0.5) / (size[:, None] + 1)) - np.log((rest + 0.5) / (whole - size[:, None] + 1))
    return np.where((seen >= LEAST_SEEN) & (odds >= LEAST_ODDS), odds, 0).astype(np.float32)


def learn_domains(docs: DataFrame, labels: DataFrame) -> Softmax:
    """Softmax over the features of at most TRAIN_ROWS labelled documents; ``docs``: ``k``, ``text``."""
    order = F.xxhash64(F.col("k").cast("string"))
    sample = domain_labels(labels).orderBy(order, "k").limit(TRAIN_ROWS).withColumn("part", F.pmod(order, F.lit(2)))
    rows = settle(docs.join(F.broadcast(settle(sample, "mixing-sample")), "k").select("domain", "part", "text"), "mixing-rows")
    evidence = learn_evidence(rows.where("part = 0").select("domain", "text"))
    sent = docs.sparkSession.sparkContext.broadcast(evidence)

    @frugal
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                x = features(part.column("text"), sent.value)[1]
                yield pa.RecordBatch.from_arrays([part.column("domain"), pa.array(list(x), pa.list_(pa.float64()))], ["domain", "x"])

    learned = rows.where("part = 1").select("domain", "text").mapInArrow(extract, "domain int, x array<double>")
    learned = settle(learned, "mixing-features")
    seen = sorted(r.domain for r in learned.select("domain").distinct().collect())
    if len(seen) < 2:
        width = 1 + len(_MARKS) + 3 * len(DOMAINS)
        return Softmax(np.zeros((1, width)), np.zeros(1), seen or [0], evidence)
    number = F.lit(0)
    for i, d in enumerate(seen):
        number = F.when(F.col("domain") == d, F.lit(i)).otherwise(number)
    learned = learned.select(number.cast("double").alias("label"), array_to_vector("x").alias("features")).coalesce(4)
    model = LogisticRegression(family="multinomial", regParam=1e-4, maxIter=60).fit(learned)
    return Softmax(model.coefficientMatrix.toArray(), model.interceptVector.toArray(), seen, evidence)


def with_posteriors(docs: DataFrame, model: Softmax, text: str) -> DataFrame:
    """``row``, a struct of all columns of the documents, ``__words`` and ``__p``, the domain probabilities."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    names, text = ["row"], f"row.{text}"
    fields = f"row {docs.schema['row'].dataType.simpleString()}"

    @frugal
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, SLICE):
                counts, x = features(texts_of(part, text), sent.value.evidence)
                p = pa.array(list(sent.value.posteriors(x)), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(counts, pa.int64()), p], [*names, "__words", "__p"])

    return bounded_batches(docs).mapInArrow(score, f"{fields}, __words long, __p array<double>")


def _dot(p: Column, g: np.ndarray) -> Column:
    out = F.lit(0.0)
    for k, v in enumerate(g):
        out = out + p[k] * F.lit(float(v))
    return out


def fit_rates(scored: DataFrame, targets: dict[str, float], total: float | None = None) -> np.ndarray:
    """The y of the fitted rates ``max(0, 1 - p . y)``; ``scored``: ``__words``, ``__p``.

    ``total`` is the number of words to reach, that of the input unless given.
    """
    domains = range(len(DOMAINS))
    p, words = F.col("__p"), F.col("__words")
    held = float(scored.agg(F.sum("__words").alias("w")).first().w or 0)
    y = np.zeros(len(DOMAINS))
    if not held:
        return y
    goal = np.array([targets.get(d, 0.0) for d in DOMAINS])
    goal = goal / max(goal.sum(), 1e-12) * (held if total is None else total)
    ridge = RIDGE * held

    def measured(y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The dual objective at y, its downhill slopes, and its curvature."""
        rate = rates(p, y)
        free = (rate > 0).cast("double") * words
        aggs = [F.sum(rate * words * p[k]).alias(f"s{k}") for k in domains]
        aggs += [F.sum(free * p[i] * p[j]).alias(f"g{i}{j}") for i in domains for j in domains if i <= j]
        row = scored.agg(F.sum(rate * rate * words).alias("r"), *aggs).first()
        error = np.array([row[f"s{k}"] for k in domains]) - goal
        gram = np.array([[row[f"g{min(i, j)}{max(i, j)}"] for j in domains] for i in domains])
        return 0.5 * row["r"] + 0.5 * ridge * (y @ y) + goal @ y, error - ridge * y, gram + np.eye(len(DOMAINS)) * ridge

    value, slopes, curvature = measured(y)
    share, change = 1.0, np.linalg.solve(curvature, slopes)
    for _ in range(STEPS):
        if np.abs(change).max() < SETTLED:
            return y + change
        at = measured(y + share * change)
        # Sums of doubles differ in their last digits from run to run.
        if at[0] <= value - 1e-4 * share * (slopes @ change) + 1e-12 * (abs(value) + held):
            y = y + share * change
            value, slopes, curvature = at
            share, change = 1.0, np.linalg.solve(curvature, slopes)
        else:
            share /= 2
    raise RuntimeError(f"mixing rates did not settle in {STEPS} steps: y would still change by {np.abs(change).max():.3g}")


def rates(p: Column, y: np.ndarray) -> Column:
    """Rates of the projected step from 1 along ``y``."""
    return F.greatest(F.lit(0.0), 1.0 - _dot(p, y))


def _copies(key: Column, rate: Column) -> Column:
    u = F.pmod(F.xxhash64(F.lit("mixing"), key.cast("string")), F.lit(1 << 40)) / float(1 << 40)
    return F.when(F.col("__words") == 0, 1).otherwise(F.floor(rate + u)).cast("int")


def _fitted(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None, total: float | None, key: str, text: str):
    plain = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text"))
    model = learn_domains(plain, labels)
    scored = settle(with_posteriors(plain, model, "text").select("row.k", "__words", "__p"), "mixing-scores")
    return model, scored, fit_rates(scored, TARGETS if targets is None else targets, total)


def document_rates(
    docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, total: float | None = None,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Key, ``n_words``, a probability for each domain, ``rate`` and ``copies`` of every document."""
    _, scored, y = _fitted(docs, labels, targets, total, key, text)
    rate = rates(F.col("__p"), y)
    return scored.select(
        F.col("k").alias(key), F.col("__words").alias("n_words"), *[F.col("__p")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)],
        rate.alias("rate"), _copies(F.col("k"), rate).alias("copies"))


def mixed_documents(
    docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, total: float | None = None,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """The documents, columns unchanged, each as often as its rate says; no shuffle of the texts."""
    model, _, y = _fitted(docs, labels, targets, total, key, text)
    scored = with_posteriors(docs.withColumn(text, F.col(text).cast("string")), model, text)
    copies = _copies(F.col("row")[key], rates(F.col("__p"), y))
    return scored.select("row", F.explode(F.array_repeat(F.lit(1), copies)).alias("__copy")).select("row.*")
