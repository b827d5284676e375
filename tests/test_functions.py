"""Hand-computed vectors for the scalar functions, with null, empty and malformed inputs."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from oppengine.functions import html as H
from oppengine.functions import text as X
from oppengine.functions import time as M
from oppengine.functions import url as U
from oppengine.operators import crawl


def values(spark, f, inputs, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}").select("i", f(F.col("v")).alias("o")).orderBy("i").collect()
    return [r.o for r in rows]


def check(spark, f, pairs, kind="string"):
    assert values(spark, f, [a for a, _ in pairs], kind) == [b for _, b in pairs]


def test_normalize_url(spark):
    check(spark, U.normalize_url, [
        ("https://A.org/x;p=1?q=1#f", "https://A.org/x?q=1"), ("example.com/x/", "https://example.com/x"), ("HTTP://x.org//", "http://x.org"),
        ("https://a.org/?", "https://a.org"), ("example.com:8080/x", "example.com://8080/x"), ("foo bar:x", "https://foo bar:x"),
        ("https://u:p@a.org:8/x/y;z/w;k", "https://u:p@a.org:8/x/y;z/w"), ("", "https://"), (None, None), ("1a:b", "https://1a:b"),
    ])


def test_normalize_url_is_idempotent(spark):
    once = values(spark, U.normalize_url, ["https://A.org/x/?q#f", "a.org/b//", "http://x.org"])
    assert values(spark, U.normalize_url, once) == once


def test_url_variants(spark):
    check(spark, U.canonical_host_url, [("https://awww.com/x", "https://acom"), ("", ""), (None, ""), ("https://www.A.org", "https://a.org"), ("https://b.www.c.org/", "https://b.c.org")])
    check(spark, lambda c: U.canonical_host_url(c, prefix_only=True), [("https://awww.com/x", "https://awww.com"), ("https://www.a.org", "https://a.org")])
    check(spark, U.safe_filename, [("https://www.A.org/what we/fund/?x=1", "www.A.org_what_we_fund"), ("", ""), (None, None), ("https://a.org/" + "x" * 200, "a.org_" + "x" * 144), ("a.org/b", "a.org_b")])
    check(spark, U.seed_url, [("  https://www.A.org/x/?q=1 ", "https://a.org/x"), ("", ""), (None, None), ("a.org/x//", "https://a.org/x"), ("http://b.org", "http://b.org")])
    check(spark, U.normalize_url_client, [("https://A.org/x/?q=1#f", "https://a.org/x?q=1"), (None, ""), ("nonsense", "nonsense"), ("https://a.org//", "https://a.org/"), ("", "")])
    check(spark, U.domain, [("https://www.a.org:8/x", "a.org"), ("bad", "bad"), (None, None), ("", ""), ("https://u@B.org", "b.org")])
    check(spark, U.safe_domain, [("https://www.a.org/x", "www.a.org"), ("bad", "unknown"), (None, "unknown"), ("", "unknown"), ("http://C.org:80", "c.org")])
    check(spark, U.useful_url, [("https://www.nasa.gov/x", True), ("https://facebook.com/grant", False), ("https://m.facebook.com/grant", False), ("https://a.org/GRANTS", True), ("https://a.org/x", False), (None, False), ("grant", False)])


def test_urls_in_text(spark):
    check(spark, U.extract_urls, [("see https://a.org/x, (HTTP://b.org) 'https://c.org'", ["https://a.org/x", "HTTP://b.org", "https://c.org"]), ("", []), (None, None), ("none", []), ('"https://d.org">x', ["https://d.org"])])


def test_parse_timestamp(spark):
    t = datetime
    check(spark, M.parse_timestamp, [
        ("2025-11-20 11:33:60", t(2025, 11, 20, 11, 34)), ("2025-11-20 11:33:75", t(2025, 11, 20, 11, 34, 15)), ("20251120", t(2025, 11, 20)),
        ("2025-11-20T11:33:00Z", t(2025, 11, 20, 11, 33)), ("2025-11-20", t(2025, 11, 20)), ("2025", None), ("2025-11", None), ("bad", None), ("", None), (None, None),
    ])


def test_subtract_months(spark):
    for a, n, b in [("2024-05-31 10:00:00", 3, datetime(2024, 2, 29, 10)), ("2025-01-31", 2, datetime(2024, 11, 30)), ("2024-03-31", 1, datetime(2024, 2, 29)), ("2024-03-31", 0, datetime(2024, 3, 31)), ("2024-03-31", -2, datetime(2024, 3, 31))]:
        assert spark.range(1).select(M.subtract_months(F.lit(a).cast("timestamp"), n).alias("o")).first().o == b


def test_dates_and_durations(spark):
    now = F.lit("2025-01-31 12:00:00").cast("timestamp")
    check(spark, lambda c: M.date_bucket(c.cast("timestamp"), now), [("2025-01-31 01:00:00", "Today"), ("2025-01-30 01:00:00", "Yesterday"), ("2025-01-25", "This week"), ("2025-01-05", "This month"), ("2024-01-05", "Older"), ("2025-02-05", "This week"), (None, "Unknown date")])
    check(spark, lambda c: M.age_label(c.cast("timestamp"), now), [("2025-01-31 01:00:00", "today"), ("2025-01-20", "11d ago"), ("2024-11-01", "3mo ago"), (None, None), ("2026-01-01", "today")])
    check(spark, M.format_seconds, [(3723, "1h 2m 3s"), (60, "1m 0s"), (5, "5s"), (0, "0s"), (3600, "1h 0s")], "int")
    check(spark, M.us_date, [("2025-01-31", "01/31/2025"), ("bad", "bad"), (None, None), ("2025-13-01", "2025-13-01"), ("", "")])
    check(spark, M.rfc2822_date, [("Mon, 06 Jan 2025 10:00:00 +0000", datetime(2025, 1, 6).date()), ("06 Jan 2025 23:00:00 -0500", datetime(2025, 1, 7).date()), ("bad", None), ("", None), (None, None)])


def test_amounts(spark):
    check(spark, X.funding_max, [("$10,000 - $100,000", 100.0), ("up to 5 million", 5_000_000.0), ("12 months, $9", 12_000_000.0), ("$50k", 50_000.0), ("", None), (None, None), ("none", None)])
    check(spark, lambda c: X.funding_max(c, strict_commas=True), [("$10,000 - $100,000", 100_000.0)])
    check(spark, X.currency_input, [("1,500", 1500.0), ("2.5k", 2500.0), ("3 m", 3_000_000.0), ("x5", None), ("", None), (None, None)])
    check(spark, X.last_integer, [("10 to 1,000", 1000), ("none", None), (None, None), ("", None), ("7", 7)])


def test_text_helpers(spark):
    check(spark, X.mask_secret, [("sk-1234567890", "sk-1234…7890"), ("short", "***"), ("", "***"), ("12345678901", "***"), ("123456789012", "1234567…9012")])
    check(spark, X.loose_boolean, [(" YES ", True), ("1", True), ("no", False), (None, False), ("", False)])
    check(spark, X.comma_list, [("a, b,,c ", ["a", "b", "c"]), ("", []), (None, None), (",", []), ("x", ["x"])])
    check(spark, X.email_initials, [("jane.doe@x.org", "JD"), ("bob@x.org", "B"), ("", ""), (None, None), ("a_b_c@x", "AB")])
    check(spark, X.csv_cell, [('a"b', '"a""b"'), ("a,b", '"a,b"'), ("a\nb", '"a\nb"'), ("a b", "a b"), (None, "")])
    check(spark, X.clean_setting, [(' "x" ', "x"), ("''", None), ("", None), (None, None), ("y", "y")])
    check(spark, X.describe_cron, [("0 6 * * *", "daily"), ("0 6 * * 1", "weekly"), ("0 6 1 * *", "monthly"), ("0 6 1 1 *", "monthly"), ("0 6 1 * 2", "custom"), ("x", "custom")])
    check(spark, lambda c: X.truncate_middle(c, 10, "|"), [("0123456789ab", "01234|789ab"), ("0123456789", "0123456789"), ("", ""), (None, None), ("x", "x")])
    check(spark, X.eligibility_rank, [("Highly Eligible", 0), ("Not Eligible", 4), ("?", 5), (None, 5), ("", 5)])
    assert values(spark, lambda c: X.search_queries(c)[0], ["", "water"]) == ["nonprofit grants grants 2026 open applications nonprofit", "water grants 2026 open applications nonprofit"]


def test_derive_keywords(spark):
    df = spark.createDataFrame([("We help adults in Georgia find work, training and jobs today", ["Job training, coaching and placement"]), (None, None), ("the a an", [])], "m string, s array<string>")
    got = [r.k for r in df.select(X.derive_keywords(F.col("m"), F.col("s")).alias("k")).collect()]
    assert got == ["help adults georgia find work training", X.DEFAULT_KEYWORDS, X.DEFAULT_KEYWORDS]


def test_org_profile(spark):
    df = spark.createDataFrame([("N", None, " A ", "GA", "M", ["x", "y"], 1234567, 0, 3)], "name string, ein string, city string, state string, mission string, services array<string>, annual_income long, staff_count int, volunteer_count int")
    assert df.select(X.org_profile_text().alias("t")).first().t == "Organization: N\nLocation: A, GA\nMission: M\nServices: x, y\nAnnual income: $1,234,567\nVolunteers: 3"


def test_scores(spark):
    urls = [("https://a.org", 9.74), ("https://a.org/grants", 109.6)]
    got = values(spark, crawl.score_candidate, [u for u, _ in urls])
    assert got == pytest.approx([s for _, s in urls])
    df = spark.createDataFrame([("https://a.org/a/b/c/d/e", ["Apply now", "Contact"], ["Funding"], ["support us"])], "u string, a array<string>, t array<string>, s array<string>")
    assert df.select(crawl.score_candidate(F.col("u"), F.col("a"), F.col("t"), F.col("s")).alias("o")).first().o == pytest.approx(45.54)


def test_html(spark):
    page = "<html><head><title> T </title><script>var t='</p>';</script></head><body><nav><p>no</p></nav><h1>Head</h1><p>One <b>two</b></p><ul><li>x<p>y</p></li></ul><a href='/z#f'>Go  there</a><footer><p>no</p></footer></body></html>"
    assert H.page_visible_text(page) == "Head One two x y y"
    assert H.page_visible_text(None) == "" == H.page_visible_text("")
    assert H.parse_page("<a href='/x'><b>Foo</b><i> Bar </i></a>").links == [("/x", "Foo Bar")]
    p = H.parse_page(page)
    assert (p.title, p.links) == ("T", [("/z#f", "Go  there")])
    links = H.page_links(spark.createDataFrame([("https://a.org/b/c", page), (None, None)], "url string, html string")).collect()
    assert [(r.href, r.anchor, r.title) for r in links] == [("https://a.org/z", "Go  there", "T")]
    assert spark.createDataFrame([(page,), (None,)], "h string").select(H.visible_text(F.col("h")).alias("t")).collect()[1].t == ""
