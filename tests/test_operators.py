"""Semantics that the tables don't show: ties, nulls, order, properties, plans, files."""

from datetime import datetime

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from oppengine.functions.url import normalize_url
from oppengine.operators import crawl, discovery, extract, latest, mutate, prepare, results
from oppengine.plans import catalog
from oppengine.schema import ELIGIBILITY, EXPORT_COLUMNS, RESULT_COLUMNS, conform
from oppengine.sources import tables

HISTORY = [
    ("https://a.org/x", "2025-01-01", 1), ("https://a.org/x/", "2025-03-01", 2), ("https://a.org/x#f", "2025-03-01", 3), (None, "2025-01-01", 4), ("", None, 5),
    ("  ", "bad", 6), ("https://b.org", "2025-01-01 10:00:60", 7), ("https://b.org/;p", None, 8), ("https://c.org", None, 9),
]


def history(spark):
    return spark.createDataFrame(HISTORY, "fund_url string, extraction_timestamp string, ord int")


def test_latest_ties_nulls_and_empty_urls(spark):
    assert sorted(r.ord for r in latest.latest_results_by_url(history(spark)).collect()) == [3, 4, 7, 9]
    assert sorted(r.ord for r in latest.latest_results_by_host(history(spark)).collect()) == [3, 4, 7, 9]
    assert latest.latest_results_by_url(spark.createDataFrame([(1,)], "x int")).columns == ["x"]


def test_latest_is_idempotent(spark):
    once = latest.latest_results_by_url(history(spark))
    assert sorted(r.ord for r in latest.latest_results_by_url(once).collect()) == sorted(r.ord for r in once.collect())


def test_stale_judges_the_latest_only(spark):
    as_of = F.lit("2025-05-01").cast("timestamp")
    assert sorted(r.ord for r in latest.stale_results_by_key(history(spark), as_of=as_of).collect()) == [4, 7, 9]


def test_first_of_latest_keeps_the_earlier_of_equals(spark):
    h = history(spark)
    got = latest.first_of_latest(h, normalize_url(F.trim("fund_url")), F.to_timestamp(F.lit("2025-01-01")), h["ord"])
    assert {1, 7, 9} <= {r.ord for r in got.collect()}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["a.org", "a.org/", "b.org", "c.org/x", "c.org/x#y"]), min_size=1, max_size=8))
def test_prepare_parts_the_payload(spark, urls):
    payload = spark.createDataFrame(list(enumerate(urls)), "pos int, raw_url string")
    processed = spark.createDataFrame([("https://b.org",)], "url_key string")
    got = prepare.prepare_urls(payload, processed).orderBy("pos").collect()
    seen, want = set(), []
    for u in urls:
        k = "https://" + u.split("#")[0].rstrip("/")
        want.append("duplicates_in_payload" if k in seen else "already_processed" if k == "https://b.org" else "to_scrape")
        seen.add(k)
    assert [r.status for r in got] == want


def test_prepare_allows_rescrape(spark):
    payload = spark.createDataFrame([(0, "b.org/"), (1, "b.org")], "pos int, raw_url string")
    processed = spark.createDataFrame([("https://b.org",)], "url_key string")
    got = prepare.prepare_urls(payload, processed, spark.createDataFrame([("https://b.org",)], "raw_url string")).orderBy("pos").collect()
    assert [(r.status, r.output) for r in got] == [("to_scrape", "https://b.org"), ("duplicates_in_payload", "b.org")]


def test_semi_and_anti_part_the_input(spark, sf_dir):
    d, l = tables.table(spark, sf_dir, "documents").select("doc_id"), tables.table(spark, sf_dir, "labels")
    assert results.selected(d, l, "doc_id").count() + results.without(d, l, "doc_id").count() == d.count()


def test_group_drops_unknown_labels(spark):
    df = spark.createDataFrame([("Eligible",), (None,), ("",), ("odd",)], "eligibility string")
    assert [(r.label, r.n) for r in results.group_by_eligibility(df).orderBy("position").collect()] == [("Eligible", 1), ("Unknown", 2)]


def test_result_filters(spark):
    rows = [("u1", "Alpha", "", "Eligible", "$50k", "Rolling", "x"), ("u2", "beta", "n", None, "none", "2024-01-01", "y"), ("u3", None, "alphabet", "Low Match", "$9", None, "x")]
    df = spark.createDataFrame(rows, "fund_url string, fund_name string, notes string, eligibility string, funding_range string, deadline string, discovery_source string")
    as_of = F.lit("2025-01-01").cast("timestamp")
    ids = lambda **k: sorted(r.fund_url for r in results.filter_results(df, as_of=as_of, **k).collect())
    assert ids(search=" ALPHA ") == ["u1", "u3"]
    assert ids(labels=ELIGIBILITY) == ["u1", "u3"]
    assert ids(only_open=True) == ["u1"]
    assert ids(least_funding=1000) == ["u1"]
    assert ids(least_funding=40, variant="simple") == ["u1", "u2"]
    assert ids(source="x", archived=spark.createDataFrame([("u1",)], "fund_url string")) == ["u3"]
    assert results.active_filters() == 0 and results.active_filters("q", [], True, 1, "x") == 5


def test_sort_alphabetical_ignores_case_and_accents(spark):
    df = spark.createDataFrame([("B", 0), ("á", 1), ("A", 2), ("b", 3), ("Z", 4), (None, 5)], "n string, ord int")
    got = df.orderBy(*results.sort_alphabetical(F.col("n"), F.lit("y"), F.col("ord"))).collect()
    assert [r.ord for r in got] == [1, 2, 0, 3, 5, 4]


def test_numbered_is_a_global_order(spark):
    got = results.numbered(spark.range(1000).repartition(7), [F.col("id").desc()]).orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, 1001)) and [r.id for r in got] == list(range(999, -1, -1))


def test_toggle(spark):
    s = lambda *x: spark.createDataFrame([(v,) for v in x], "k int")
    assert sorted(r.k for r in results.toggle(s(1, 2, 3), s(1, 2), "k").collect()) == [3]
    assert sorted(r.k for r in results.toggle(s(1, 2, 3), s(1, 4), "k").collect()) == [1, 2, 3, 4]


def test_export_file(spark, tmp_path):
    df = spark.createDataFrame([("u,1", 'a"b', ["x", "y"], None)], "fund_url string, fund_name string, notes array<string>, error string")
    tables.write_export(df.coalesce(1), str(tmp_path / "out"))
    text = b"".join(p.read_bytes() for p in (tmp_path / "out").glob("*.csv"))
    head, row = text.split(b"\r\n")[:2]
    assert head.decode().split(",") == EXPORT_COLUMNS and row.startswith(b'"u,1","a""b",')
    assert results.export_lines(df).first().line.startswith('"u,1","a""b",,,,,,,,"x, y"')


def test_conform_and_append(spark, tmp_path):
    df = spark.createDataFrame([("u", 3, "drop me")], "fund_url string, pages_scraped int, other string")
    out = conform(df)
    assert out.columns == RESULT_COLUMNS and out.first().pages_scraped == "3" and out.first().notes == ""
    path = str(tmp_path / "results")
    mutate.append_results(df, path)
    mutate.append_results(df, path)
    assert tables.load_results(spark, path).count() == 2
    mutate.rewrite(spark, mutate.delete_in(spark.read.parquet(path), df.select("fund_url")), path)
    assert spark.read.parquet(path).count() == 0


def test_upsert_and_update(spark):
    t = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    assert sorted(mutate.upsert(t, spark.createDataFrame([(2, "B", None), (3, "c", "z")], t.schema), "k").collect()) == [(1, "a", "x"), (2, "B", None), (3, "c", "z")]
    got = mutate.update_by_key(t, spark.createDataFrame([(2, None, "new"), (9, "q", "q")], t.schema), "k")
    assert sorted(got.collect()) == [(1, "a", "x"), (2, "b", "new")]


def test_sources(spark, tmp_path):
    raw = spark.createDataFrame([("A", "1", None, "http://a.org", None), ("B", "2", 5, None, None), ("C", "3", 200_000, "", "")], "name string, ein string, gross_receipts long, website string, url string")
    raw = raw.withColumns({c: F.lit(None).cast("string") for c in ("city", "state", "ntee_code")}).withColumn("asset_amount", F.lit(None).cast("long"))
    f = discovery.foundations(raw)
    assert sorted((r.name, r.asset_amount) for r in f.collect()) == [("A", 0), ("C", 0)]
    assert sorted(r.url for r in discovery.urls_of(f, "website", "propublica_url").collect()) == ["http://a.org", "https://projects.propublica.org/nonprofits/organizations/3"]
    items = spark.createDataFrame([("http://x", "Mon, 06 Jan 2025 10:00:00 +0000"), ("http://y", "bad"), ("", None), ("http://old", "Mon, 01 Jan 2024 10:00:00 +0000")], "link string, pubDate string")
    assert sorted(r.url for r in discovery.rss_urls(items, "2025-01-01").collect()) == ["http://x", "http://y"]
    html = spark.createDataFrame([('<a class="result__a" rel="x" href="https://a.org/">A</a><a class="result__a" href="//d?uddg=https%3A%2F%2Fb.org%2Fx&r=1">B</a>',)], "html string")
    assert sorted(r.url for r in discovery.search_hit_urls(html).collect()) == ["https://a.org/", "https://b.org/x"]
    assert discovery.enabled_sources({"grants_gov": False}, has_sam_key=True) == ["propublica", "sam_gov", "web_search", "federal_register"]
    (tmp_path / "a_x.txt").write_text("one")
    (tmp_path / "b.txt").write_text("two https://u.org/p")
    folder = tables.combined_text(tables.read_text_folder(spark, str(tmp_path))).first()
    assert (folder.text, folder.files, folder.url) == ("\n=== a_x.txt ===\none\n\n=== b.txt ===\ntwo https://u.org/p", 2, "https://a")
    assert [r.url for r in tables.uploaded_urls(spark, str(tmp_path / "b.txt")).collect()] == ["https://u.org/p"]
    (tmp_path / "feed.xml").write_text("<rss><channel><item><title>t</title><link>http://l</link><pubDate>x</pubDate></item></channel></rss>")
    assert tables.read_rss(spark, str(tmp_path / "feed.xml")).first().link == "http://l"


def test_bfs_budget_and_order(spark):
    seeds = spark.createDataFrame([("s", "a")], "seed string, url string")
    edges = spark.createDataFrame([("a", "c", 0), ("a", "b", 1), ("b", "d", 0), ("c", "e", 0), ("e", "f", 0), ("c", "a", 1)], "from_url string, to_url string, position int")
    full = crawl.bounded_bfs(seeds, edges, pages=None).orderBy("depth", "parent_order", "position").collect()
    assert [(r.url, r.depth) for r in full] == [("a", 0), ("c", 1), ("b", 1), ("e", 2), ("d", 2)]
    assert sorted(r.url for r in crawl.bounded_bfs(seeds, edges, pages=3).collect()) == ["a", "b", "c"]


def test_prioritized_crawl(spark):
    seeds = spark.createDataFrame([("https://a.org",)], "seed string")
    links = spark.createDataFrame([("https://a.org", 0, "https://a.org/grants", "Apply", "T", "S"), ("https://a.org", 1, "https://a.org/x.pdf", "F", "T", "S"), ("https://a.org", 2, "https://b.org/", "B", "T", "S")], "from_url string, position int, href string, anchor string, title string, snippet string")
    texts = spark.createDataFrame([("https://a.org/grants", "grants text"), ("https://a.org", "home")], "url string, text string")
    r = crawl.prioritized_crawl(seeds, crawl.link_edges(links), texts).first()
    assert (r.text, r.pages_scraped, r.visited_urls) == ("grants text home", 2, ["https://a.org/grants", "https://a.org"])


def test_crawl_follows_the_seeds_domain(spark):
    """From blog.a.org back to a.org, and from a.org to what contains it; not to others."""
    seeds = spark.createDataFrame([("https://www.a.org",)], "seed string")
    rows = [("https://www.a.org", 0, "https://blog.a.org/x"), ("https://blog.a.org/x", 0, "https://a.org/grants"), ("https://blog.a.org/x", 1, "https://c.org/grants")]
    links = spark.createDataFrame([(*r, "Go", "", "") for r in rows], "from_url string, position int, href string, anchor string, title string, snippet string")
    r = crawl.prioritized_crawl(seeds, crawl.link_edges(links), spark.createDataFrame([], "url string, text string")).first()
    assert sorted(r.visited_urls) == ["https://a.org/grants", "https://blog.a.org/x", "https://www.a.org"] and r.pages_scraped == 0


def test_links_of_a_crawl_are_moved_once(spark):
    """Joins with the staged links move what was visited only, and a seed that has its pages is not followed any more."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = [(f"https://s{s}.org/{p}", i, f"https://s{s}.org/{p}{i}") for s in range(5) for p in ("", "0", "1", "2", "00") for i in range(s + 1)]
        links = spark.createDataFrame([(f.rstrip("/"), n, h, "Go", "", "") for f, n, h in rows], "from_url string, position int, href string, anchor string, title string, snippet string")
        edges = tables.staged(crawl.link_edges(links), "edges", by="from_url")
        seeds = spark.createDataFrame([(f"s{s}", f"https://s{s}.org", f"s{s}.org") for s in range(5)], "seed string, url string, domain string")
        visited = crawl.bounded_bfs(seeds, edges, pages=3)
        c = crawl.candidates(edges, visited, 3)
        plan = c._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2  # visited pages by address, and what they link to by seed
        assert {k: sorted(r.url[len(f"https://{k}.org"):] for r in visited.where(F.col("seed") == k).collect()) for k in ("s0", "s1", "s4")} == {"s0": ["", "/0", "/00"], "s1": ["", "/0", "/1"], "s4": ["", "/0", "/1"]}
        assert {r.url for r in c.where("seed = 's0'").collect()} == {"https://s0.org", "https://s0.org/0", "https://s0.org/00", "https://s0.org/000"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_texts_of_a_crawl_by_the_key_they_are_stored_under(spark):
    seeds = spark.createDataFrame([("https://a.org",), ("https://b.org",)], "seed string")
    links = spark.createDataFrame([(f"https://{s}.org", i, f"https://{s}.org/grants/p{i}", "Apply", "", "") for s in "ab" for i in range(3)], "from_url string, position int, href string, anchor string, title string, snippet string")
    texts = spark.createDataFrame([("p0", "zero"), ("p2", "two"), ("p9", "nine")], "key string, text string")
    got = crawl.prioritized_crawl(seeds, crawl.link_edges(links), texts, key=F.regexp_extract("url", "/grants/(p[0-9]+)$", 1)).collect()
    assert {(r.seed, r.text, r.pages_scraped, len(r.visited_urls)) for r in got} == {(f"https://{s}.org", "two zero", 2, 4) for s in "ab"}


def test_numbered_with_other_columns_on_many_partitions(spark):
    rows = spark.range(20_000).select((F.col("id") * 7919 % 20_000).alias("k"), F.col("id").alias("_id"), F.lit("x").alias("_part"))
    saved = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 50)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
        got = results.numbered(rows.repartition(13), [F.col("k").asc()]).orderBy("place").collect()
    finally:
        for c, v in saved.items():
            spark.conf.set(c, v)
    assert [r.place for r in got] == list(range(1, 20_001)) and [r.k for r in got] == list(range(20_000))
    assert got[0].asDict().keys() == {"k", "_id", "_part", "place"}
    assert results.numbered(rows.limit(0), [F.col("k")]).count() == 0


def test_alternate_sorts_and_tails(spark):
    df = spark.createDataFrame([(1, None, "2025-01-02", "b"), (2, "2025-01-01", None, "A"), (3, None, None, None)], "ord int, ts string, deadline string, name string")
    order = lambda by: [r.ord for r in df.orderBy(*by).collect()]
    assert order(results.sort_recent(df["ts"], df["deadline"], df["ord"])) == [1, 2, 3]
    assert order(results.sort_recent(df["ts"], None, df["ord"])) == [2, 1, 3]
    assert order(results.sort_alphabetical(df["name"], None, df["ord"], "UNICODE")) == [3, 2, 1]
    assert [r.ord for r in results.last_reversed(df, "ord", 2).collect()] == [3, 2]


def test_small_helpers(spark):
    from oppengine.functions import text as X
    from oppengine.functions import time as M

    df = spark.createDataFrame([("https://A.org/x/", " ", "f", "2025", 3, "Grant (a) grant")], "url string, name string, folder string, ts string, position int, text string")
    c = F.col
    got = df.select(
        latest.row_key(F.lit(""), F.lit(None).cast("string"), F.lit(""), F.lit(""), c("position")).alias("row"), latest.option_key(c("url"), c("name")).alias("option"), latest.option_key(F.lit(""), F.lit("n")).alias("by_name"),
        extract.fund_name(c("name"), c("url")).alias("fund"), X.highlight(c("text"), "grant").alias("marked"), X.highlight(c("text"), "(A)").alias("escaped"), discovery.next_rotation(F.lit(48)).alias("next"),
    ).first()
    assert (got.row, got.option, got.by_name, got.fund) == ("row-3", "https://a.org/x", "n", "A.org")
    assert (got.marked, got.escaped, got.next) == ("<mark>Grant</mark> (a) <mark>grant</mark>", "Grant <mark>(a)</mark> grant", 3)
    long = spark.createDataFrame([("e" * 3000,)], "error_message string")
    assert len(long.select(mutate.cut_error().alias("e")).first().e) == 2000
    meta = spark.createDataFrame([("https://A.org/x/", "feed")], "url string, discovery_source string")
    assert prepare.with_metadata(df, meta, "url").first().discovery_source == "feed"
    e = lambda *v: df.select(M.elapsed_seconds(*map(F.lit, v)).alias('e')).first().e
    assert (e(10, 15, 99), e(10, None, 99), e(20, 15, 99)) == (5, 89, 0)


def test_writers(spark, tmp_path):
    one = spark.createDataFrame([("https://a.org/grants", 'Fund "A", B'), ("https://grants.gov/x", None)], "url string, name string")
    tables.write_fund_csv(one, str(tmp_path / "funds"), F.regexp_extract("url", "//([^/]+)", 1))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "funds")).orderBy("domain").collect()
    assert [(r.domain, r.name) for r in back] == [("a.org", 'Fund "A", B'), ("grants.gov", None)]
    texts = spark.createDataFrame([("a.org", "p", "one\r\ntwo\n"), ("a.org", "q r+ü%", "é"), ("a.org", "void", None), ("b.org", "x/y", "three")], "domain string, name string, text string")
    assert tables.write_page_texts(texts, str(tmp_path / "texts")) == 4
    assert (tmp_path / "texts" / "a.org" / "void.txt").read_bytes() == b""
    assert (tmp_path / "texts" / "a.org" / "p.txt").read_bytes() == b"one\r\ntwo\n"
    files = tables.read_text_folder(spark, str(tmp_path / "texts"))
    assert sorted((r.folder.rsplit("/", 1)[1], r.name, r.text) for r in files.collect()) == [("a.org", "p.txt", "one\r\ntwo\n"), ("a.org", "q r+ü%.txt", "é"), ("b.org", "x_y.txt", "three")]
    assert sorted((r.files, r.text) for r in tables.combined_text(files).collect())[0] == (1, "\n=== x_y.txt ===\nthree")
    assert sorted(r.domain for r in tables.saved_domains(files.select(F.concat("folder", F.lit("/"), "name").alias("path"))).collect()) == ["a.org", "b.org"]
    tables.write_page_texts(texts.select(F.upper("domain").alias("domain"), "name", "text"), str(tmp_path / "texts"))
    assert sorted(r.domain for r in tables.saved_domains(spark.read.option("recursiveFileLookup", True).text(str(tmp_path / "texts"))).collect()) == ["a.org", "b.org"]
    listed = discovery.url_list(one, F.lit("2025-01-01")).orderBy("fund_url").collect()
    assert [(r.fund_url, r.source) for r in listed] == [("https://a.org/grants", "foundation"), ("https://grants.gov/x", "federal")]
    ids = [r.id for r in mutate.with_id(one).collect()]
    assert len(set(ids)) == 2 and all(len(i) == 36 for i in ids)
    assert tables.as_json(one).orderBy("record").first().record == '{"url":"https://a.org/grants","name":"Fund \\"A\\", B"}'
    spark.createDataFrame([("u", "2025-01-01 10:00:00")], "url string, fetched_at string").select("url", F.to_timestamp("fetched_at").alias("fetched_at")).write.parquet(str(tmp_path / "store"))
    fresh = lambda t: tables.read_pages(spark, str(tmp_path / "store"), F.lit(t).cast("timestamp")).count()
    assert (fresh("2025-01-02 09:59:59"), fresh("2025-01-02 10:00:01")) == (1, 0)


def test_state_overlay_by_batch(spark, tmp_path):
    from oppengine.streaming.ingest import current_state, overlay_sink

    path = str(tmp_path / "state")
    sink = overlay_sink(spark, path, "source", "at")
    rows = lambda *r: spark.createDataFrame(list(r), "source string, at int, mark string")
    assert current_state(spark, path) is None
    sink(rows(("a", 1, "x"), ("b", 1, "x"), ("a", 2, "y")), 0)
    sink(rows(("b", 5, "z")), 1)
    sink(rows(("b", 5, "z")), 1)  # a repeated batch changes nothing
    sink(rows(("c", 1, "w")), 2)
    got = sorted(tuple(r) for r in current_state(spark, path).collect())
    assert got == [("a", 2, "y"), ("b", 5, "z"), ("c", 1, "w")]


def test_extract(spark):
    long = "Open funding of $5k - $10k for nonprofits. " * 5
    df = spark.createDataFrame([(1, long), (2, "short"), (3, None)], "id int, text string")
    got = {r.id: r for r in extract.extract(df).collect()}
    assert got[1].record.funding_range == "$5k - $10k" and got[1].record.applicant_types == "nonprofits" and got[1].error == ""
    assert got[2].record is None and got[2].error == got[3].error == "Insufficient text extracted"
    raw = spark.createDataFrame([('{"eligibility": "odd", "restrictions": ["a", "b"]}',), ("not json",), (None,)], "r string")
    recs = [r.x for r in raw.select(extract.record_from_json(F.col("r")).alias("x")).collect()]
    assert (recs[0].eligibility, recs[0].restrictions, recs[0].application_status) == ("Low Match", "a; b", "unclear")
    assert recs[1].notes.startswith("JSON parsing error") and recs[2].grant_type == "other"
    thin = raw.limit(1).select(extract.is_thin(extract.error_record("x")).alias("t")).first().t
    assert thin is True


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, sf_dir):
    q = catalog.QUERIES
    assert "WindowGroupLimit" in plan(q["latest_by_key"](spark, sf_dir))
    assert "LeftAnti" in plan(q["anti_processed"](spark, sf_dir))
    assert "TakeOrderedAndProject" in plan(q["recent_runs"](spark, sf_dir))
    native = [n for n in q if not n.startswith(("stream_", "paged_")) and n not in ("page_text", "extract_links", "extract_records", "extract_with_fallback", "lateral_links", "bfs_bounded")]
    for n in native:
        assert "Python" not in plan(q[n](spark, sf_dir)) and "Pandas" not in plan(q[n](spark, sf_dir)), n
    assert "PushedFilters: [IsNotNull(ts)" in plan(q["incremental_since"](spark, sf_dir))


def test_stream_equals_batch(spark, sf_dir):
    for n in ("stream_dedupe", "stream_progress"):
        assert catalog.QUERIES[n](spark, sf_dir).count() == tables.table(spark, sf_dir, "events").select("user_id").distinct().count()


def test_incremental_ingest(spark, tmp_path):
    from oppengine.streaming.ingest import ingest_new_urls

    src, done, ck = (str(tmp_path / x) for x in ("src", "done", "ck"))
    df = spark.createDataFrame([("a.org/",), ("a.org",), ("b.org",)], "url string")
    spark.createDataFrame([("https://b.org",)], "url_key string").write.parquet(done)
    df.write.parquet(src)
    ingest_new_urls(spark, src, df, done, ck)
    assert sorted(r.url_key for r in spark.read.parquet(done).collect()) == ["https://a.org", "https://b.org"]
    spark.createDataFrame([("c.org",)], "url string").write.mode("append").parquet(src)
    ingest_new_urls(spark, src, df, done, ck)
    assert sorted(r.url_key for r in spark.read.parquet(done).collect()) == ["https://a.org", "https://b.org", "https://c.org"]


def test_watermarked_new_rows_keep_state_bounded(spark, sf_dir):
    from oppengine.streaming.ingest import new_rows

    s = spark.readStream.schema("ts timestamp, k int").parquet(sf_dir)
    assert "DeduplicateWithinWatermark" in new_rows(s, "k", "ts", "1 hour")._jdf.queryExecution().analyzed().toString()
    assert datetime(2024, 1, 1)
