"""Latest record per key, and which of those are stale."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_nonempty
from ..functions.time import parse_timestamp, subtract_months
from ..functions.url import canonical_host_url, normalize_url, normalize_url_client


def latest_by(df: DataFrame, key: Column, ts: Column, order: Column) -> DataFrame:
    """The row of each key with the largest ``ts`` (null is smallest), later ``order`` winning ties.

    A window limited to rank 1, so Spark cuts each partition to one row per key before it shuffles
    (WindowGroupLimit); only the key, and the row, travel.
    """
    w = Window.partitionBy("_key").orderBy(F.col("_ts").desc_nulls_last(), F.col("_order").desc())
    ranked = df.select("*", key.alias("_key"), ts.alias("_ts"), order.alias("_order")).withColumn("_rank", F.row_number().over(w))
    return ranked.where("_rank = 1").drop("_key", "_ts", "_order", "_rank")


def _trimmed_key(df: DataFrame, url: str, key_func: Callable[[Column], Column]) -> Column:
    u = F.trim(F.coalesce(df[url], F.lit("")))
    return F.when(u == "", "").otherwise(key_func(u))


def latest_results_by_key(df: DataFrame, *, key_func: Callable[[Column], Column] = normalize_url, order: str = "ord", url: str = "fund_url", ts: str = "extraction_timestamp") -> DataFrame:
    """Latest result per key of the trimmed URL; all rows without a URL are one key."""
    if url not in df.columns:
        return df
    return latest_by(df, _trimmed_key(df, url, key_func), parse_timestamp(df[ts]), df[order])


def latest_results_by_url(df: DataFrame, **kw) -> DataFrame:
    return latest_results_by_key(df, key_func=normalize_url, **kw)


def latest_results_by_host(df: DataFrame, **kw) -> DataFrame:
    return latest_results_by_key(df, key_func=canonical_host_url, **kw)


def stale(df: DataFrame, ts: Column, as_of: Column, months: int = 3) -> DataFrame:
    """Rows without a time or older than ``months`` calendar months before ``as_of``."""
    return df.where(ts.isNull() | (ts < subtract_months(as_of, months)))


def stale_results_by_key(df: DataFrame, *, as_of: Column, months: int = 3, ts: str = "extraction_timestamp", **kw) -> DataFrame:
    """Staleness is judged on the latest rows only: the filter stays above the window."""
    if not 1 <= months <= 24:
        raise ValueError("months must be between 1 and 24")
    latest = latest_results_by_key(df, ts=ts, **kw)
    return stale(latest, parse_timestamp(latest[ts]), as_of, months)


def first_of_latest(df: DataFrame, key: Column, ts: Column, order: Column) -> DataFrame:
    """Like ``latest_by``, but the earlier row wins ties, and rows without a key are left out."""
    return latest_by(df.where(key.isNotNull() & (key != "")), key, ts, -order)


def option_key(url: Column, name: Column) -> Column:
    return first_nonempty(normalize_url_client(url), url, name)


def row_key(url: Column, name: Column, folder: Column, ts: Column, position: Column) -> Column:
    return first_nonempty(url, name, folder, ts, F.concat(F.lit("row-"), position.cast("string")))
