"""Changes to plain Parquet tables: upserts, overlays, updates by key, and safe rewrites."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import RESULT_COLUMNS, conform


def upsert(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Rows of ``source``, and those of ``target`` whose key it doesn't have."""
    return target.join(source.select(key), key, "left_anti").select(*target.columns).unionByName(source.select(*target.columns))


#: The fields of an organisation that can be read and changed.
ORG_FIELDS = ["id", "name", "ein", "city", "state", "mission", "services", "annual_income", "staff_count", "volunteer_count", "website", "ai_system_prompt", "ai_user_prompt"]


def update_by_key(target: DataFrame, changes: DataFrame, key: str, allowed: list[str] | None = None) -> DataFrame:
    """Sparse update: non-null fields of ``changes`` replace those of the row with the same key; other keys are ignored.

    With ``allowed``, only those fields change, and only they and the key come out.
    """
    if allowed is not None:
        target = target.select(*[c for c in target.columns if c == key or c in allowed])
    cols = [c for c in changes.columns if c != key and c in target.columns]
    if not cols:
        raise ValueError("nothing to update")
    new = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in cols])
    out = target.join(new, key, "left")
    return out.select(*[F.coalesce(out[f"_new_{c}"], out[c]).alias(c) if c in cols else out[c] for c in target.columns])


def overlay(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """A map overlay on rows: entries of ``new`` win."""
    return upsert(old, new, key)


def union_distinct(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """``a``, then the first rows of ``b`` whose key ``a`` doesn't have; (…, place) keeps the order of appending."""
    from .prepare import keep_first

    both = a.withColumn("_side", F.lit(0)).unionByName(b.withColumn("_side", F.lit(1)))
    return keep_first(both, key, F.struct("_side", "ord")).drop("_side")


def append_results(df: DataFrame, path: str) -> None:
    conform(df, RESULT_COLUMNS).write.mode("append").parquet(path)


def delete_in(df: DataFrame, urls: DataFrame, url: str = "fund_url") -> DataFrame:
    """Every row whose raw URL is listed goes, with all its history."""
    return df.join(urls.select(F.col(url)).distinct(), url, "left_anti")


def with_id(df: DataFrame, name: str = "id") -> DataFrame:
    return df.withColumn(name, F.expr("uuid()"))


def cut_error(c: str = "error_message", limit: int = 2000):
    return F.substring(F.col(c), 1, limit)


def rewrite(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Replace the table at ``path`` by ``df``, which may read it: written beside, then swapped by rename.

    Stores have no rename that replaces, so there is a moment without a table; a run that ends just then leaves
    ``path.old-…`` and ``path.new-…`` beside it, and either may be renamed to ``path``. Where readers must never meet
    that, use ``streaming.ingest.overlay_sink``, whose versions are only added.
    """
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(new)
    store = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(fs_path(path)):
        store.rename(fs_path(path), fs_path(old))
    store.rename(fs_path(new), fs_path(path))
    store.delete(fs_path(old), True)
