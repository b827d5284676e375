"""Bounded crawl of a link graph, relevance scores and the best pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.url import crawlable, netloc, normalize_url, path
from ..sources.tables import staged

#: The words that make a page relevant, and the limits of a crawl.
KEYWORDS = [
    "grant", "grants", "apply", "fund", "funding", "eligible", "eligibility", "criteria", "who-can-apply",
    "what-we-fund", "apply-for", "apply-for-funding", "support", "programme", "award", "awarded", "application",
    "guidelines",
]
DEPTH, PAGES, BEST = 2, 40, 10


def any_keyword(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(k)) for k in KEYWORDS])


def score_candidate(url: Column, anchors: Column | None = None, titles: Column | None = None, snippets: Column | None = None) -> Column:
    """50 for each keyword in the URL, 25, 10 and 7 for each anchor, title and snippet with any; deep paths and long URLs cost."""
    score = sum((F.when(F.contains(F.lower(url), F.lit(k)), 50.0).otherwise(0.0) for k in KEYWORDS), F.lit(0.0))
    for c, weight in ((anchors, 25.0), (titles, 10.0), (snippets, 7.0)):
        if c is not None:
            score = score + F.coalesce(F.size(F.filter(c, any_keyword)), F.lit(0)) * weight
    inner = F.regexp_replace(path(url), "^/+|/+$", "")
    deep = F.greatest(F.lit(0), F.size(F.split(inner, "/")) - 3)
    return score - 3.0 * deep + F.greatest(F.lit(0.0), 10.0 - F.length(url) / 50.0)


def top_candidates(scored: DataFrame, k: int = BEST) -> DataFrame:
    """The best by score, then by URL downwards."""
    return scored.orderBy(F.desc("score"), F.desc("url")).limit(k)


def top_candidates_per(scored: DataFrame, seed: str, k: int = BEST) -> DataFrame:
    w = Window.partitionBy(seed).orderBy(F.desc("score"), F.desc("url"))
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def link_edges(links: DataFrame) -> DataFrame:
    """(from_url, to_url, to_host, position, anchor, title, snippet) of crawlable links; a crawl follows those in its seed's domain."""
    return links.where(crawlable(F.col("href"), "")).select("from_url", normalize_url(F.col("href")).alias("to_url"), netloc(F.col("href")).alias("to_host"), "position", "anchor", "title", "snippet")


def seed_domain(url: Column) -> Column:
    return F.replace(netloc(url), F.lit("www."), F.lit(""))


def _inside(rows: DataFrame) -> DataFrame:
    return rows.where(F.contains("to_host", F.col("domain"))) if "domain" in rows.columns else rows


def bounded_bfs(seeds: DataFrame, edges: DataFrame, depth: int = DEPTH, pages: int | None = PAGES) -> DataFrame:
    """(seed, url, depth, parent_order, position): pages in the order in which a first-in first-out crawl visits them.

    ``seeds`` is (seed, url), ``edges`` is (from_url, to_url, position). ``depth`` joins, each over the frontier
    only; what is visited is staged after each, so that no join is computed twice. With ``pages``, each seed visits so
    many pages at most, in that order, and one that has them is left alone from there on; without, ``parent_order``
    counts the pages of one depth only, so that no window sees all that was visited. If seeds have a ``domain``, only
    links are followed whose ``to_host`` contains it.
    """
    domain = [c for c in ("domain",) if c in seeds.columns]
    links = edges.select("from_url", F.col("to_url").alias("url"), "position", *["to_host" for _ in domain])
    own = ["seed", "url", *domain, "depth", "parent_order", "position"]
    visited = seeds.select("seed", "url", *domain, F.lit(0).alias("depth"), F.lit(0).cast("long").alias("parent_order"), F.lit(0).alias("position"))
    frontier, full = visited.withColumn("_nth", F.lit(1).cast("long")), []
    for d in range(1, depth + 1):
        out = _inside(_few(frontier.select("seed", *domain, F.col("url").alias("from_url"), F.col("_nth").alias("parent_order")), pages).join(links, "from_url"))
        rows = visited.unionByName(out.select("seed", "url", *domain, F.lit(d).alias("depth"), "parent_order", "position"))
        if pages is not None:
            rows = rows.repartition("seed")  # serves the window, too
        first = F.min(F.struct("depth", "parent_order", "position", *domain)).alias("m")
        rows = rows.groupBy("seed", "url").agg(first).select("seed", "url", "m.*").select(own)
        if pages is None:
            w = Window.partitionBy("seed", "depth").orderBy("parent_order", "position", "url")
            ordered = rows.select("*", F.row_number().over(w).cast("long").alias("_nth"), F.lit(False).alias("_full"))
        else:
            w = Window.partitionBy("seed")
            nth = F.row_number().over(w.orderBy("depth", "parent_order", "position", "url")).cast("long")
            ordered = rows.select("*", nth.alias("_nth"), (F.count(F.lit(1)).over(w) >= pages).alias("_full")).where(F.col("_nth") <= pages)
        ordered = staged(ordered, f"crawled-{d}")
        if pages is not None:
            full.append(ordered.where("_full").select(own))
        open_ = ordered.where("not _full")
        visited, frontier = open_.select(own), open_.where(F.col("depth") == d)
    return reduce(DataFrame.unionByName, full, visited)


def _few(visited: DataFrame, pages: int | None) -> DataFrame:
    """Visited pages as the side of a join with links that tasks hold, as a seed has few."""
    return visited if pages is None else visited.hint("shuffle_hash")


def candidates(edges: DataFrame, visited: DataFrame, pages: int | None = None) -> DataFrame:
    """(seed, url, anchors, titles, snippets): links seen from visited pages, and the seeds themselves, with their texts as sets.

    With ``pages``, the most that a seed has visited, the rows come by seed.
    """
    domain = [c for c in ("domain",) if c in visited.columns]
    seen = _inside(_few(visited.select("seed", *domain, F.col("url").alias("from_url")), pages).join(edges, "from_url")).select("seed", F.col("to_url").alias("url"), "anchor", "title", "snippet")
    none = F.lit(None).cast("string")
    rows = seen.unionByName(visited.where("depth = 0").select("seed", "url", none.alias("anchor"), none.alias("title"), none.alias("snippet")))
    if pages is not None:
        rows = rows.repartition("seed")
    sets = lambda c: F.sort_array(F.collect_set(F.nullif(F.col(c), F.lit("")))).alias(c + "s")
    return rows.groupBy("seed", "url").agg(sets("anchor"), sets("title"), sets("snippet"))


def concatenated(pages: DataFrame, key: str, rank: str, text: str) -> DataFrame:
    """(key, text): texts of a key in rank order with a blank between (a key has BEST pages at most)."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(text).alias("t"))))
    return pages.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["t"]), " ").alias("text"))


def prioritized_crawl(seeds: DataFrame, edges: DataFrame, texts: DataFrame, pages: int = PAGES, key: Column | None = None) -> DataFrame:
    """(seed, text, pages_scraped, visited_urls): crawl, score, best pages, their texts in rank order.

    ``texts`` is (url, text) of pages that can be fetched, or (key, text) where pages are stored by ``key``, an
    expression over ``url``; the visited list has all best links, fetched or not.
    """
    edges = staged(edges, "crawl-edges", by="from_url")  # read by each depth and by the candidates; resolving links is their costly part
    start = seeds.select("seed", normalize_url(F.col("seed")).alias("url")).withColumn("domain", seed_domain(F.col("url")))
    visited = bounded_bfs(start, edges, pages=pages)
    c = candidates(edges, visited, pages)
    best = top_candidates_per(c.withColumn("score", score_candidate(F.col("url"), F.col("anchors"), F.col("titles"), F.col("snippets"))), "seed").select("seed", "url", "place")
    if key is None:
        got = best.join(texts, "url", "left")
    else:
        got = best.withColumn("_key", key).join(texts.select(F.col("key").alias("_key"), "text"), "_key", "left")
    parts = F.array_sort(F.collect_list(F.struct("place", "url", "text")))
    return got.groupBy("seed").agg(parts.alias("p")).select(
        "seed", F.array_join(F.filter(F.transform("p", lambda x: x["text"]), lambda t: t.isNotNull()), " ").alias("text"),
        F.size(F.filter("p", lambda x: x["text"].isNotNull())).alias("pages_scraped"), F.transform("p", lambda x: x["url"]).alias("visited_urls"),
    )
