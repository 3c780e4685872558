"""The pipeline stage by stage, each against brute force on its own input."""

import brute
import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyfold.llm import line_dedup
from tallyfold.llm.queries import QUERIES, VOCABULARY, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The result of every stage, by name, and the documents first."""
    df = table(spark, SF, "documents")
    out = {"documents": df.cache()}
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, SF).cache()
        out[name] = df
    return out


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard", "mixing", "bpe"]
    for name in ("toxicity", "line_dedup", "ngram_jaccard", "mixing"):
        assert stages[name].dtypes == stages["documents"].dtypes


def test_toxicity_keeps_rows_as_they_are(stages):
    before = {r.doc_id: r for r in stages["documents"].collect()}
    assert all(before[r.doc_id] == r for r in stages["toxicity"].collect())


def test_lines(stages):
    docs = [(r.doc_id, r.text) for r in stages["toxicity"].collect()]
    gone = brute.removed_lines(docs, line_dedup.PERCENT, line_dedup.LEAST_WORDS)
    want = {k: "\n".join(s for i, s in enumerate(t.split("\n")) if i not in gone.get(k, [])) for k, t in docs}
    got = stages["line_dedup"].collect()
    assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_near_copies(stages):
    docs = [(r.doc_id, r.text) for r in stages["line_dedup"].collect()]
    want = {k for k, (_, c) in brute.ngram_groups(docs).items() if k == c}
    assert {r.doc_id for r in stages["ngram_jaccard"].collect()} == want


def test_mixing_only_repeats_or_drops(stages):
    before = {r.doc_id: r for r in stages["ngram_jaccard"].collect()}
    after = stages["mixing"].collect()
    assert after and all(before[r.doc_id] == r for r in after)


def test_tokens(stages):
    library = Tokenizer.from_file(VOCABULARY)
    texts = {r.doc_id: r.text for r in stages["mixing"].collect()}
    rows = stages["bpe"].collect()
    assert len(rows) == stages["mixing"].count()
    assert all(r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids for r in rows)


def test_queries_are_registered():
    import __spark_entry__ as entry

    found = entry.queries()
    assert set(QUERIES) <= set(found) and "pipeline" in found
    assert all(any(n.startswith(f"op{i}_") for n in found) for i in range(1, 14))


def test_stages_of_an_empty_table(spark):
    df = table(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, SF)
        assert df.count() == 0, name


def test_user_columns_of_any_name_stay(spark):
    """Names that the stages use themselves, and names with underscores."""
    odd = ["__k", "__words", "__p", "__copy", "row", "k", "t", "line", "score", "removed"]
    rows = [(i, f"some words of document number {i} " * 12 if i < 8 else "some words of document number 3 " * 12, *range(10)) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` long" for c in odd)).withColumn("n_chars", F.length("text").cast("long"))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns, name
        assert all(tuple(r)[2:12] == tuple(range(10)) for r in out.collect()), name
