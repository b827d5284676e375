"""The pipeline against a brute-force chain: each stage is checked on what its predecessor kept."""

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from oppengine.llm import langid, toxicity
from oppengine.llm.common import read_table, stage

from .test_near_copies import by_hand
from .test_packing import check
from .test_sql_operators import lines_by_hand


def test_stages(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    columns, seen = docs.columns, {}
    for name, step in corpus_pipeline.STAGES:
        before = docs
        docs = stage(step(spark, before, sf_dir), name.replace(" ", "-"))
        was = {r.doc_id: r.text for r in before.collect()}
        if name != "packing":
            assert docs.columns == columns and [f.dataType for f in docs.schema] == [f.dataType for f in before.schema]
        rows = docs.collect()
        if name == "toxicity":
            flags = {r.doc_id: r.predicted for r in toxicity.detect_toxicity(before, read_table(spark, sf_dir, "labels")).collect()}
            assert {r.doc_id for r in rows} == {d for d, p in flags.items() if not p}
        elif name == "language":
            ok = {r.doc_id for r in langid.identify(before).collect() if r.accepted}
            assert {r.doc_id for r in rows} == ok
        elif name == "line dedup":
            want = [(d, t) for d, t in lines_by_hand(list(was.items())) if t == was[d] or t.strip(" \t\n\x0b\x0c\r")]
            assert sorted([(r.doc_id, r.text) for r in rows], key=repr) == sorted(want, key=repr)
            assert all(r.n_chars == len(r.text) for r in rows if r.text != was[r.doc_id])
        elif name == "near copies":
            assert {r.doc_id for r in rows} == {d for d, _, c in by_hand(list(was.items()), 5, 80) if d == c}
            assert all(r.text == was[r.doc_id] for r in rows)
        else:
            check(rows, list(was.items()), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
        seen[name] = len(rows)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).select("doc_id", "piece", "ids_crc32").collect())) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in rows)


def test_odd_tables(spark, tmp_path):
    """Nulls in every column, clashing names, repeated rows, no rows."""
    d = str(tmp_path)
    text = "the river runs along many green hills and wide open fields near our old town "
    rows = [(i, text + f"number {i} and {i * 3} more", "en", None, None, "x", 1.0) for i in range(60)] + [(None, None, None, None, None, None, None), (3, None, "en", "s", 1, None, None), (4, text + "number 4 and 12 more", "en", None, None, "x", 1.0), (None, text, None, "s", 2, "y", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string, score double")
    df.coalesce(1).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{d}/labels.parquet")
    docs = read_table(spark, d, "documents")
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = stage(step(spark, docs, d), name.replace(" ", "-"))
        assert docs.columns == df.columns
    assert docs.count() > 0 and corpus_pipeline.STAGES[-1][1](spark, docs, d).count() == docs.count()
    none = df.limit(0)
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, none, d).count() == 0
