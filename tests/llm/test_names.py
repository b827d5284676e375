"""Columns of any name pass through the operators that keep them, and through the pipeline's stages."""

import pytest

import corpus_pipeline
from oppengine.llm import jaccard, langid, linededup, personal, toxicity

ODD = ["a.b", "with blank", "tick`s", "ünï", "_keep", "select"]
ROWS = [(i, f"one two three four five {i % 3}\nsix seven\neight nine\nten", "en", *[f"{c}{i}" for c in ODD]) for i in range(12)]
DDL = "doc_id long, text string, lang string, " + ", ".join(f"`{c.replace('`', '``')}` string" for c in ODD)


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, DDL)


def kept(df):
    return sorted(tuple(r[c] for c in ODD) for r in df.collect())


def test_operators(spark, docs):
    want = sorted(r[3:] for r in ROWS)
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(12)], "doc_id long, toxic int, quality int")
    assert kept(toxicity.detect_toxicity(docs, labels, keep=ODD)) == want
    assert kept(langid.identify(docs, keep=ODD)) == want
    assert kept(linededup.dedup_lines(docs)) == want
    assert kept(personal.find_personal_data(docs, keep=ODD)) == want
    one = kept(jaccard.one_of_each(docs, 3, 80))
    assert set(one) <= set(want) and len(one) < len(want)


def test_stages(spark, docs, sf_dir):
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        assert set(kept(out)) <= {r[3:] for r in ROWS}
