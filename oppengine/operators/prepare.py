"""Classification of incoming links against what is already known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.url import normalize_url


def keep_first(df: DataFrame, key: Column | str, order: Column | str) -> DataFrame:
    """The first row of each key in the given order (a plain dropDuplicates keeps any)."""
    k = F.col(key) if isinstance(key, str) else key
    w = Window.partitionBy("_key").orderBy("_order")
    return df.select("*", k.alias("_key"), (F.col(order) if isinstance(order, str) else order).alias("_order")).withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_key", "_order", "_rank")


def processed_keys(df: DataFrame, url: str = "fund_url") -> DataFrame:
    """Distinct normalised URLs; null URLs are dropped first."""
    return df.where(F.col(url).isNotNull()).select(normalize_url(F.col(url)).alias("url_key")).distinct()


def new_urls(candidates: DataFrame, processed: DataFrame, url: str = "url") -> DataFrame:
    """Candidates whose normalised URL is not among ``processed`` (url_key): raw rows, not deduplicated again."""
    return candidates.join(processed.select("url_key"), normalize_url(candidates[url]) == F.col("url_key"), "left_anti")


def prepare_urls(payload: DataFrame, processed: DataFrame, allow_rescrape: DataFrame | None = None) -> DataFrame:
    """(pos, raw_url, url_key, status, output) of ``payload`` (pos, raw_url).

    The first row of a key is already_processed if its key is known and not allowed again, else to_scrape (which
    outputs the key); every later row of it is duplicates_in_payload, whatever is known.
    """
    p = payload.select("pos", "raw_url", normalize_url(F.col("raw_url")).alias("url_key"))
    known = processed.select("url_key").distinct().withColumn("_known", F.lit(True))
    if allow_rescrape is not None:
        known = known.join(allow_rescrape.select(normalize_url(F.col("raw_url")).alias("url_key")), "url_key", "left_anti")
    p = p.join(known, "url_key", "left").withColumn("_nth", F.row_number().over(Window.partitionBy("url_key").orderBy("pos")))
    status = F.when(F.col("_nth") > 1, "duplicates_in_payload").when(F.col("_known"), "already_processed").otherwise("to_scrape")
    return p.select("pos", "raw_url", "url_key", status.alias("status")).withColumn("output", F.when(F.col("status") == "to_scrape", F.col("url_key")).otherwise(F.col("raw_url")))


def with_metadata(df: DataFrame, metadata: DataFrame, on: str) -> DataFrame:
    return df.join(metadata, on, "left")
