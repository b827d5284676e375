"""Sources of candidate links: reshaping, filters, provenance, rotation and high-water marks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_nonempty
from ..functions.time import rfc2822_date
from ..functions.url import useful_url

#: The states in rotation order, and how many a run takes.
STATES = [
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS", "KY", "LA", "ME",
    "MD", "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ", "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA",
    "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY",
]
STATES_PER_RUN, QUERIES = 5, 5
#: Which sources run unless configured otherwise.
SOURCE_DEFAULTS = {"propublica": True, "grants_gov": True, "sam_gov": False, "web_search": True, "federal_register": True}
MIN_RECEIPTS, DAYS_BACK = 100_000, 30


def _text(*names: str) -> list[Column]:
    return [F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n) for n in names]


def foundations(raw: DataFrame, min_receipts: int = MIN_RECEIPTS) -> DataFrame:
    """Nonprofit records; unknown receipts pass the threshold."""
    ein = F.coalesce(F.col("ein").cast("string"), F.lit(""))
    site = F.coalesce(first_nonempty(F.col("website"), F.col("url")), F.lit(""))
    return raw.where(F.col("gross_receipts").isNull() | (F.col("gross_receipts") >= min_receipts)).select(
        *_text("name", "ein", "city", "state"), site.alias("website"), *_text("ntee_code"), F.col("gross_receipts").cast("long").alias("gross_receipts"),
        F.coalesce(F.col("asset_amount").cast("long"), F.lit(0)).alias("asset_amount"),
        F.concat(F.lit("https://projects.propublica.org/nonprofits/organizations/"), ein).alias("propublica_url"),
    )


def federal_grants(raw: DataFrame) -> DataFrame:
    t = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    return raw.select(
        t("id", "opportunity_id"), t("number", "opportunity_number"), t("title", "opportunity_title"), t("agencyName", "agency_name"),
        t("openDate", "post_date"), t("closeDate", "close_date"), F.col("estimatedFunding").cast("string").alias("estimated_funding"),
        F.concat(F.lit("https://grants.gov/search-results-detail/"), t("id", "i")).alias("opportunity_url"), t("synopsis", "synopsis"),
    )


def opportunities(raw: DataFrame) -> DataFrame:
    t = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    notice = F.coalesce(first_nonempty(F.col("noticeId"), F.col("id")), F.lit(""))
    agency = F.when(F.size("organizationHierarchy") > 0, t(F.col("organizationHierarchy")[0]["name"])).otherwise(t(F.col("organizationName")))
    return raw.select(
        notice.alias("opportunity_id"), t(F.col("title")).alias("title"), agency.alias("agency_name"), t(F.col("postedDate")).alias("posted_date"),
        t(F.col("responseDeadLine")).alias("close_date"), t(F.col("type")).alias("opportunity_type"),
        F.when(notice != "", F.concat(F.lit("https://sam.gov/opp/"), notice, F.lit("/view"))).otherwise("").alias("opportunity_url"), notice.alias("notice_id"),
    )


def notices(raw: DataFrame, since_date: str | None = None, k: int | None = None) -> DataFrame:
    """(url) of register notices (html_url, pdf_url, publication_date): the page, else its PDF; newest first where cut to ``k``."""
    out = raw.where(F.col("publication_date") >= F.lit(since_date).cast("date")) if since_date else raw
    if k is not None:
        out = out.orderBy(F.desc("publication_date"), F.asc("html_url")).limit(k)
    return urls_of(out, "html_url", "pdf_url")


def urls_of(records: DataFrame, *columns: str) -> DataFrame:
    """(url): the first nonempty of the columns; rows without any are dropped."""
    return records.select(first_nonempty(*[F.col(c) for c in columns]).alias("url")).where("url is not null")


def since(df: DataFrame, date: Column, mark: Column, as_of: Column, days_back: int = DAYS_BACK, keep_unknown: bool = False) -> DataFrame:
    """Rows from the mark on (inclusive), or from ``days_back`` days before ``as_of`` where there is no mark."""
    ok = date >= F.coalesce(mark, F.date_sub(as_of, days_back))
    return df.where(ok | date.isNull()) if keep_unknown else df.where(ok)


def rss_urls(items: DataFrame, since_date: str | None = None) -> DataFrame:
    """(url) of feed items (link, pubDate); items without a link go, unreadable dates stay."""
    out = items.where(F.coalesce(F.trim("link"), F.lit("")) != "")
    d = rfc2822_date(F.col("pubDate"))
    out = out.where(d.isNull() | (d >= F.lit(since_date).cast("date"))) if since_date else out
    return out.select(F.trim("link").alias("url"))


def search_hits(pages: DataFrame) -> DataFrame:
    """``pages`` (…, html) as (…, url) of the result links in them: absolute ones, and the decoded target of redirects."""
    others = [c for c in pages.columns if c != "html"]
    href = F.explode(F.regexp_extract_all("html", F.lit('class="result__a"[^>]*href="([^"]+)"'), 1)).alias("h")
    target = F.try_url_decode(F.regexp_extract("h", "uddg=([^&]+)", 1))
    return pages.select(*others, href).select(*others, F.when(F.col("h").startswith("http"), F.col("h")).when(F.col("h").contains("uddg="), target).alias("url")).where("url is not null and url <> ''")


def search_hit_urls(html: DataFrame) -> DataFrame:
    """(url) of result links in search pages (html)."""
    return search_hits(html.select("html"))


def useful(urls: DataFrame) -> DataFrame:
    return urls.where(useful_url(F.col("url")))


def tagged_union(sources: dict[str, DataFrame]) -> DataFrame:
    """(url, source, seq) of all sources in the order given; ``seq`` numbers the sources."""
    return reduce(DataFrame.unionByName, [df.select("url", F.lit(name).alias("source"), F.lit(i).alias("seq")) for i, (name, df) in enumerate(sources.items())])


def last_source_wins(tagged: DataFrame) -> DataFrame:
    """(url, source, first_seq): the value of the last source that has the URL, the place of the first."""
    return tagged.groupBy("url").agg(F.max_by("source", "seq").alias("source"), F.min("seq").alias("first_seq"))


def enabled_sources(config: dict[str, bool], has_sam_key: bool = False) -> list[str]:
    """Sources that run; opportunities also if a key is there."""
    return [s for s, d in SOURCE_DEFAULTS.items() if config.get(s, d) or (s == "sam_gov" and has_sam_key)]


def in_rotation(position: Column, start: Column | int, n: int = len(STATES), take: int = STATES_PER_RUN) -> Column:
    return F.pmod(position - (F.lit(start) if isinstance(start, int) else start), F.lit(n)) < take


def next_rotation(start: Column, n: int = len(STATES), take: int = STATES_PER_RUN) -> Column:
    return F.pmod(start + take, F.lit(n))


def limit_per(df: DataFrame, key: str, order: list[Column | str], k: int) -> DataFrame:
    """The first ``k`` rows of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def per_state_limit(max_per_source: int, n_states: int) -> int:
    return max(10, max_per_source // n_states)


def url_list(df: DataFrame, at: Column) -> DataFrame:
    """(fund_url, discovered_at, source) for the CSV of a discovery run; the source is told by the URL."""
    source = F.when(F.col("url").contains("grants.gov"), "federal").otherwise("foundation")
    return df.select(F.col("url").alias("fund_url"), at.alias("discovered_at"), source.alias("source"))
