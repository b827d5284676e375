"""URL expressions (Column -> Column). Nothing here is a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: scheme, authority, path and query of a generic URI; works alike in Java regexes and RE2
URI = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
#: The same parts each by itself, so that a match reads no further than its part.
_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_NETLOC = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"
#: A whole URI of which authority, path (no trailing slashes, no parameters) and query are kept.
_KEPT = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://([^/?#]*))?([^?#]*?)/*(?:;[^/?#]*)?(?:(\?[^#]+)|\?)?(?:#[\s\S]*)?$"

#: Hosts that are never useful, and what marks a URL as relevant.
EXCLUDED_HOSTS = [
    "facebook.com", "twitter.com", "x.com", "instagram.com", "youtube.com", "linkedin.com", "reddit.com",
    "wikipedia.org", "nytimes.com", "washingtonpost.com", "forbes.com", "bloomberg.com", "huffpost.com",
    "medium.com", "substack.com", "quora.com", "indeed.com", "glassdoor.com", "salary.com", "yelp.com",
    "amazon.com", "ebay.com", "eventbrite.com", "meetup.com", "zoom.us", "wordpress.com",
]
SIGNAL = "grant|fund|rfp|opportunit|apply|award|deadline|fellowship|scholarship|philanthrop|nonprofit|501c3"
#: Link targets that are not pages.
FILE_ENDINGS = r"\.(pdf|jpg|jpeg|png|zip|mp4|doc|docx)$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, _NETLOC, 1)


def path(url: Column) -> Column:
    """The path without parameters of its last segment."""
    return F.regexp_replace(F.regexp_extract(url, _PATH, 1), ";[^/]*$", "")


def query(url: Column) -> Column:
    return F.regexp_extract(url, _QUERY, 1)


def normalize_url(url: Column) -> Column:
    """https by default, path without trailing slashes, no parameters and no fragment; null stays null; line breaks are plain characters."""
    s = scheme(url)
    return F.concat(F.when(s == "", "https").otherwise(s), F.regexp_replace(url, _KEPT, "://$1$2$3"))


def normalize_url_client(url: Column) -> Column:
    """The browser's variant: lower-case host, one trailing slash less, query kept; what is no absolute URL stays; null is ''."""
    host, q = F.lower(netloc(url)), query(url)
    raw_path = F.regexp_extract(url, _PATH, 1)
    out = F.concat(scheme(url), F.lit("://"), host, F.regexp_replace(raw_path, "/$", ""), F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))
    return F.coalesce(F.when((scheme(url) == "") | (host == ""), url).otherwise(out), F.lit(""))


def seed_url(url: Column) -> Column:
    """Base link of a seed: trimmed, lower-case host without any "www.", no query."""
    u = F.trim(url)
    s = scheme(u)
    out = F.concat(F.when(s == "", "https").otherwise(s), F.lit("://"), F.replace(F.lower(netloc(u)), F.lit("www."), F.lit("")), F.regexp_replace(path(u), "/+$", ""))
    return F.when(u == "", u).otherwise(out)


def canonical_host_url(url: Column, prefix_only: bool = False) -> Column:
    """``https://host``; every "www." goes, wherever it stands, or only a leading one with ``prefix_only``."""
    host = F.lower(netloc(normalize_url(url)))
    host = F.regexp_replace(host, r"^www\.", "") if prefix_only else F.replace(host, F.lit("www."), F.lit(""))
    return F.when(F.coalesce(url, F.lit("")) == "", "").otherwise(F.concat(F.lit("https://"), host))


def safe_filename(url: Column) -> Column:
    name = F.regexp_replace(F.concat(netloc(url), path(url)), "^/+|/+$", "")
    return F.substring(F.regexp_replace(F.translate(name, "/", "_"), "[^a-zA-Z0-9._-]", "_"), 1, 150)


def folder_name(url: Column) -> Column:
    return safe_filename(normalize_url(url))


def domain(url: Column) -> Column:
    """Host without a leading "www."; what has no host stays as it is."""
    host = F.regexp_replace(F.lower(F.regexp_extract(netloc(url), r"^(?:.*@)?([^:]*)", 1)), r"^www\.", "")
    return F.when(host == "", url).otherwise(host)


def safe_domain(url: Column) -> Column:
    host = F.lower(F.regexp_extract(netloc(url), r"^(?:.*@)?([^:]*)", 1))
    return F.coalesce(F.nullif(host, F.lit("")), F.lit("unknown"))


def useful_url(url: Column, excluded: list[str] = EXCLUDED_HOSTS, signal: str = SIGNAL) -> Column:
    """Host neither excluded nor under an excluded one, and a .gov or .edu host or a relevant word anywhere in the URL."""
    host = F.regexp_replace(F.lower(netloc(url)), r"^www\.", "")
    out = host.isin(*excluded) | F.exists(F.array(*[F.lit("." + h) for h in excluded]), lambda h: host.endswith(h))
    return F.coalesce((host != "") & ~out & (host.endswith(".gov") | host.endswith(".edu") | url.rlike(f"(?i){signal}")), F.lit(False))


def crawlable(href: Column, base_domain: Column | str) -> Column:
    """Absolute http link whose host contains the base domain and that doesn't end like a file."""
    base = F.lit(base_domain) if isinstance(base_domain, str) else base_domain
    return F.coalesce(href.startswith("http") & F.contains(netloc(href), base) & ~href.rlike("(?i)" + FILE_ENDINGS), F.lit(False))


def extract_urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"""((?i)https?://[^\s,"'>)]+)"""), 0)
