"""From raw documents to packed training sequences, in five stages.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over what its predecessor kept; ``run`` writes every
stage's result to the shared folder and reads it again as the next one's docs. All stages but the last return the
columns of ``docs``, whatever they are besides doc_id and text; the last returns the packed pieces.

Defined cases: null and empty texts pass the toxicity stage, and the language stage rejects them, as no language can
be told; a document that line deduplication leaves without any word goes; of rows that repeat id and text one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oppengine.llm import jaccard, langid, linededup, packing, toxicity
from oppengine.llm.common import quoted, read_table, stage

ORACLE_SQL = None  # learned models and tokenizers; tests compare with a brute-force version

#: Near-duplicate documents: word shingles of this size, at this similarity in percent or more.
WORDS, PERCENT = 5, 80


def _packed_rows(docs: DataFrame, *plain: str) -> DataFrame:
    """All columns of ``docs`` in one struct, so that no operator's columns clash with them, beside the plain ones."""
    return docs.select(F.struct(*map(quoted, docs.columns)).alias("_row"), *plain)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents predicted toxic go."""
    rows = _packed_rows(docs, "doc_id", "text")
    scored = toxicity.detect_toxicity(rows, read_table(spark, sf_dir, "labels"), keep=["_row"])
    return scored.where("predicted = 0").select("_row.*")


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents in no learned language go."""
    rows = _packed_rows(docs, "doc_id", "text", "lang")
    return langid.identify(rows, keep=["_row"]).where("accepted").select("_row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: later occurrences of repeated three-line windows go, and documents that lose all their words."""
    out = linededup.dedup_lines(_packed_rows(docs, "doc_id", "text")).where((F.col("_n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_n_removed") > 0, F.length("text")).otherwise(F.col("_row")["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: one document of each group of near copies stays."""
    return jaccard.one_of_each(docs, WORDS, PERCENT)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: pieces and their places in sequences."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("language", keep_known_languages), ("line dedup", dedup_lines), ("near copies", one_of_near_copies), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
