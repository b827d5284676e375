"""Pages: their text by a plain tree, links as a table function, records of all pages, schedules and runs that go on."""

import json
import re
import time
import weakref
from html.parser import HTMLParser

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from oppengine.functions import html as H
from oppengine.functions import text as X
from oppengine.operators import extract, results
from oppengine.plans import catalog
from oppengine.streaming.ingest import rotate


class Tree(HTMLParser):
    """The page as nested lists [tag, child, ...]; an end tag closes up to the innermost open element of its name."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.root = ["", ]
        self.path = [self.root]
        self.feed(html or "")
        self.close()

    def handle_starttag(self, tag, attrs):
        node = [tag]
        self.path[-1].append(node)
        if tag not in H.VOID:
            self.path.append(node)

    def handle_endtag(self, tag):
        if tag in [n[0] for n in self.path[1:]]:
            while self.path.pop()[0] != tag:
                pass

    def handle_data(self, data):
        self.path[-1].append(data)


def strings(node):
    for x in node[1:]:
        if isinstance(x, str):
            yield x
        elif x[0] not in H.DROPPED:
            yield from strings(x)


def text_by_hand(html):
    out = []

    def visit(node):
        for x in node[1:]:
            if not isinstance(x, str) and x[0] not in H.DROPPED:
                if x[0] in H.KEPT:
                    out.append(" ".join(s.strip() for s in strings(x) if s.strip()))
                visit(x)

    visit(Tree(html).root)
    return re.sub(r"\s+", " ", " ".join(x for x in out if x)).strip()


ODD = [
    "<p>a<p>b<li>c<td>d", "<li>" * 40 + "x" + "</li>" * 3 + "y", "</p></li>z<p>q</b></p>", "<nav><p>no<p>no</nav><p>yes", "<p>a<script>var x='<p>b</p>'</script>c</p>", "<h1> </h1><h2>\n</h2><p>&amp;&nbsp;x</p>",
    "<header><nav>no</header>still<p>no</p></nav><p>out", "<p>one<br>two<img>three</p>", "plain", "<p", "<!-- <p>no</p> --><p>c", "<P>Up<LI>per</P>", "<form><p>f</p></form><table><tr><th>h<td>d</table>", "", None,
]


def test_text_of_all_pages_by_hand(spark, sf_dir):
    for html in ODD:
        assert H.page_visible_text(html) == text_by_hand(html), html
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    got = {r.page_id: r for r in catalog.QUERIES["page_text"](spark, sf_dir).collect()}
    assert len(got) == len(pages)
    for p in pages:
        assert got[p.page_id].text == text_by_hand(p.html)
        title = re.search(r"<title>(.*?)</title>", p.html, re.S)
        assert re.sub(r"\s", "", got[p.page_id].title) == re.sub(r"\s", "", title.group(1).replace("&amp;", "&") if title else "")


def test_unclosed_elements_stay_within_their_bound():
    n = 1_000_000 // 6
    began = time.time()
    text = H.page_visible_text("".join(f"<li>{i % 10}{i % 7}" for i in range(n)))
    assert time.time() - began < 60 and len(text) <= H.REPEATS * 3 * n
    assert H.page_visible_text("<td>" * 200 + "x").split() == ["x"] * H.REPEATS
    for html in ("<p>" * 300_000, "</p>" * 300_000, "<b>" * 200_000 + "x" + "</i>" * 200_000, "<nav>" * 300_000, "<a href=x>" * 100_000, "<p>x</p>" * 100_000, "<" * 300_000):
        began = time.time()
        H.page_visible_text(html)
        assert time.time() - began < 30, html[:10]


def test_few_pages_of_a_batch_are_held(monkeypatch):
    alive, most = weakref.WeakSet(), []

    class Counted(H._Page):
        def __init__(self):
            super().__init__()
            alive.add(self)
            most.append(len(alive))

    monkeypatch.setattr(H, "_Page", Counted)
    html = pa.array(["<title>t</title><p>x", None] * 1000)
    for got in (H._page_view.func(html), H._page_meta.func(html), H._visible_text.func(html)):
        assert len(got) == 2000
    assert H._page_view.func(html)[-2:].to_pylist() == [{"text": "x", "title": "t", "snippet": "x"}, {"text": "", "title": "", "snippet": ""}]
    assert len(most) == 8000 and max(most) <= H.ROWS and len(H._page_view.func(html[:0])) == 0


def test_links_by_sql(spark):
    H.register_page_links(spark)
    rows = [
        ("https://a.org/b/c?q=1", "<title> T </title><a href='d#f'>One <b>1</b></a><a href='//x.org/y'>2</a><a href=''>3</a><a>no</a><a href='mailto:a@b.c'>4</a><p>Snip</p>"),
        ("https://[bad", "<a href='/x'>x</a><a href='http://ok/'>y</a>"), (None, "<a href='rel'>z</a>"), ("https://e.org", None), ("https://e.org", ""),
    ]
    df = spark.createDataFrame(rows, "url string, html string")
    got = spark.sql("SELECT p.url, l.* FROM {p} p, LATERAL page_links(p.url, p.html) l", p=df).collect()
    want = H.page_links(df).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want)))
    assert [(r.position, r.href, r.anchor, r.title, r.snippet) for r in got if r.url == rows[0][0]] == [
        (0, "https://a.org/b/d", "One 1", "T", "Snip"), (1, "https://x.org/y", "2", "T", "Snip"), (2, "https://a.org/b/c?q=1", "3", "T", "Snip"), (3, "mailto:a@b.c", "4", "T", "Snip"),
    ]


def record_by_hand(raw):
    try:
        d = json.loads(raw)
    except ValueError:
        d = None
    if not isinstance(d, dict):
        return None
    out = {}
    for f, default in X.RECORD_DEFAULTS.items():
        v = d.get(f)
        if isinstance(v, list) and f in X.LIST_FIELDS:
            v = "; ".join(map(str, v))
        out[f] = default if v is None else v
    if out["eligibility"] not in extract.ELIGIBILITY:
        out["eligibility"] = "Low Match"
    return out


def thin(r):
    return sum(not r[k] for k in X.KEY_FIELDS) >= 3 or r["eligibility"] not in extract.ELIGIBILITY


@pytest.mark.parametrize("name", ["extract_records", "extract_with_fallback"])
def test_records_of_all_pages_by_hand(spark, sf_dir, name):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    got = {r.page_id: r for r in catalog.QUERIES[name](spark, sf_dir).collect()}
    asked_again = 0
    for p in pages:
        text, r = text_by_hand(p.html), got[p.page_id]
        if len(text) < X.MIN_TEXT:
            assert r.error == X.SHORT_TEXT_ERROR and r.notes is None
            continue
        most = X.MAX_TEXT if hasattr(X, "MAX_TEXT") else 30_000
        prompt = text if len(text) <= most else text[: most // 2] + "\n...[content truncated]...\n" + text[-(most // 2) :]
        want = record_by_hand((extract.rule_extractor if name == "extract_records" else catalog.thin_extractor)(prompt))
        if name == "extract_with_fallback" and thin(want) and len(text) > 2000:
            want, asked_again = record_by_hand(extract.rule_extractor(prompt)), asked_again + 1
        assert {k: r[k] for k in want} == want and r.error == "", p.page_id
    assert (asked_again > 0) == (name == "extract_with_fallback")


def test_schedules(spark):
    rows = [("5 7 * * 0", ("weekly", 7, 5, 1, 1), "Every Monday at 07:05 UTC"), ("0 12 31 2 *", ("monthly", 12, 0, 1, 31), "Day 31 of every month at 12:00 UTC"), ("*/5 8-9 * * *", ("daily", 8, 0, 1, 1), "Every day at 08:00 UTC"), ("1 2 3 4 5", ("custom", 2, 1, 1, 1), ""), ("", ("custom", 2, 0, 1, 1), ""), ("5 7 * * 9", ("weekly", 7, 5, 9, 1), "Every undefined at 07:05 UTC")]
    df = spark.createDataFrame([(r[0],) for r in rows], "c string").withColumn("s", X.parse_cron(F.col("c")))
    s = [F.col(f"s.{x}") for x in ("mode", "hour", "minute", "dow", "dom")]
    got = df.select("c", "s", X.describe_schedule(*s).alias("said"), X.build_cron(*s, F.col("c")).alias("again")).collect()
    assert [(r.c, tuple(r.s), r.said) for r in got] == rows
    assert [r.again for r in got] == ["5 7 * * 1", "0 12 31 * *", "0 8 * * *", "1 2 3 4 5", "", "5 7 * * 9"]


def test_runs_go_on_and_can_be_repeated(spark, tmp_path):
    ring = spark.range(7).select(F.col("id").alias("position"), F.concat(F.lit("s"), "id").alias("state"))
    took = lambda run: sorted(r.position for r in rotate(spark, str(tmp_path), run, ring, 7, 3).collect())
    assert [took(r) for r in (1, 2, 2, 3, 4)] == [[0, 1, 2], [3, 4, 5], [3, 4, 5], [0, 1, 6], [2, 3, 4]]
    (tmp_path / "state" / "version=5").mkdir()  # a run that was broken off while it wrote its state
    assert took(5) == [0, 5, 6]


def test_first_section_of_overlapping_rules(spark):
    rules = results.section_rules(spark, {"A": ["x", "y"], "B": ["y", "z"], "C": ["x"]})
    rows = spark.createDataFrame([("x",), ("y",), ("z",), ("w",), (None,), ("x",)], "field string")
    assert sorted(map(str, (tuple(r) for r in results.first_section(rows, rules).collect()))) == sorted(map(str, [("x", "A", 0), ("x", "A", 0), ("y", "A", 0), ("z", "B", 1), ("w", None, None), (None, None, None)]))
