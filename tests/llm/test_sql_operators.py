"""Operators with SQL: the SQL, and the rows that the tables don't have."""

import base64
import hashlib
import zlib

import duckdb
import pytest

from pyspark.sql import functions as F

from oppengine.llm import linededup, urlfilter, warc
from oppengine.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    cur = c.execute(SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr(tuple(r[names.index(x)] for x in df.columns)) for r in cur.fetchall())
    assert sorted(repr(tuple(r)) for r in df.collect()) == want


# --- line dedup
def lines_by_hand(docs):
    """docs: (doc_id, text) -> texts, by the definition."""
    places = {}
    for d, t in sorted((x for x in docs if x[1] is not None), key=lambda x: (x[0] is None, x[0] or 0)):
        ls = [(i, l) for i, l in enumerate(t.split("\n")) if l.strip(" \t\n\x0b\x0c\r")]
        for j in range(len(ls) - 2):
            places.setdefault(tuple(l for _, l in ls[j : j + 3]), []).append((d, t, [i for i, _ in ls[j : j + 3]]))
    gone = {}
    for p in places.values():
        for d, t, at in p:
            if (d, t, at) != p[0]:
                gone.setdefault((d, t), set()).update(at)
    return sorted([(d, t if (d, t) not in gone else "\n".join(l for i, l in enumerate(t.split("\n")) if i not in gone[d, t])) for d, t in docs], key=repr)


def test_line_dedup_edges(spark):
    p = "one\ntwo\nthree\nfour"
    docs = [
        (1, p), (2, "start\n" + p + "\nend"), (3, "one\ntwo\n\n \nthree"), (4, None), (5, ""), (6, "a\na\na\na\na"), (7, "a\nb\na\nb\na\nb"), (8, p), (8, p), (9, "two\nthree"),
        (None, p + "\nmore"), (10, "x\n" * 3000 + "y"), (11, "ONE\ntwo\nthree"),
    ]
    df = spark.createDataFrame([(d, t, "h", 3) for d, t in docs], "doc_id long, text string, h string, rid int").repartition(3)
    out = linededup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "h", "rid", "_n_lines", "_n_removed"]
    rows = out.collect()
    assert sorted([(r.doc_id, r.text) for r in rows], key=repr) == lines_by_hand(docs)
    assert {r.doc_id: r["_n_removed"] for r in rows}[2] == 4
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def test_line_dedup_of_a_long_text(spark):
    import time

    n, began = 60_000, time.time()
    df = spark.createDataFrame([(1, "\n".join(f"line {i % n}" for i in range(2 * n))), (2, "\n".join(f"line {i}" for i in range(n)))], "doc_id long, text string")
    rows = {r.doc_id: r for r in linededup.dedup_lines(df).collect()}
    assert rows[1].text == "\n".join(f"line {i}" for i in range(n)) and rows[1]["_n_removed"] == n and rows[2].text == "" and time.time() - began < 60


# --- URL filters
def test_url_edges(spark):
    urls = [None, "", "no scheme", "HTTP://WWW.Example.COM/en/x?q#f", "https://example.com", "https://example.com/", "https://a.b.net/es/1", "https://net/fr/", "x://h?q/en/", "https://notcom/", "https://É.COM/Z", "http://u@h.org:80/p;q"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(3, urls[3], "again")], "page_id long, url string, host string")
    got = {r.page_id: r for r in urlfilter.filter_urls(df, spark.createDataFrame([(0, None, None), (5, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")).collect()}
    t = {i: (got[i].host, got[i].path, got[i].rule) for i in got}
    assert t[0] == t[1] == t[2] == ("", "", None)
    assert t[3] == ("www.example.com", "/en/x", "www.example.com/en/") and got[3].verdict == "allow"
    assert t[4] == ("example.com", "", None) and t[5] == ("example.com", "/", "com/")
    assert t[6] == ("a.b.net", "/es/1", "net/es/") and got[6].verdict == "block" and t[7][2] == "net/fr/"
    assert t[8] == ("h", "", None) and t[9] == ("notcom", "/", None) and t[10] == ("É.com", "/Z", "com/") and t[11] == ("u@h.org:80", "/p;q", None)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.verdict for r in urlfilter.filter_urls(df.where("page_id in (0, 8)"), none).collect()} == {"allow"}
    assert urlfilter.filter_urls(df.limit(0), none).count() == 0


def test_reputation_blocks_bad_hosts_only(spark):
    rows = [(f"h{i}.good.org", 40, 2) for i in range(30)] + [("bad.evil.org", 60, 58), ("new.evil.org", 0, 0), ("tiny.org", 1, 1)]
    rep = {r.host: r for r in urlfilter.host_reputation(spark.createDataFrame(rows, "host string, n long, bad long")).collect()}
    assert rep["bad.evil.org"].low > 0.5 > rep["h1.good.org"].low and rep["tiny.org"].low < 0.5
    assert rep["h1.good.org"].mean < rep["new.evil.org"].mean <= rep["bad.evil.org"].mean


# --- WARC
def test_warc_edges(spark, tmp_path):
    pages = [(5, "https://a.org/\r\nx", "<p>é</p>"), (2, None, "<p>é</p>"), (7, "https://b.org", None), (8, "https://c.org", ""), (9, "u", "\r\n\r\nbody\r\n\r\n"), (None, "n", "<p>é</p>"), (2, "again", "<p>é</p>"), (10, "long", "x" * 3_000_000), (None, "z", "only")]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, revisit string").repartition(3)
    folder = f"file://{tmp_path}/warc"
    index = warc.write_archives(df, folder)
    got = sorted([(r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload) for r in warc.read_records(index, folder, payloads=True).collect()], key=repr)
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, u, h in pages:
        raw = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        ref = first.get(h or "")
        again = ref is not None and i != ref
        want.append((i, (u or "").replace("\r", "%0D").replace("\n", "%0A"), len(raw), digest, "revisit" if again else "response", ref if again else None, None if again else h or ""))
    assert got == sorted(want, key=repr)
    some = warc.read_records(index.where("page_id = 9"), folder, payloads=True).collect()
    assert [r.payload for r in some] == ["\r\n\r\nbody\r\n\r\n"]
    assert warc.write_archives(df.limit(0), folder).count() == 0


def test_archives_are_standard_members(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    index = warc.write_archives(spark.createDataFrame([(1, "u", "x"), (2, "v", "y")], "page_id long, url string, html string").coalesce(1), folder)
    data = next((tmp_path / "w").glob("*.gz")).read_bytes()
    kinds = []
    while data:
        z = zlib.decompressobj(31)
        kinds.append(warc.parse(z.decompress(data))[0]["warc-type"])
        data = z.unused_data
    assert kinds == ["warcinfo", "response", "response"] and index.count() == 2


def test_small_payloads_can_be_kept(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "x"), (2, "v", "x")], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    assert {r.record_type for r in warc.read_records(warc.write_archives(df, folder, least=2), folder).collect()} == {"response"}


def test_ranges():
    assert warc.ranges([0, 10, 25, 1000], [10, 10, 5, 5], gap=5, most=100) == [(0, 3, 0, 30), (3, 4, 1000, 1005)]
    assert warc.ranges([0, 10, 20], [10, 10, 10], gap=5, most=20) == [(0, 2, 0, 20), (2, 3, 20, 30)]
    assert warc.ranges([], []) == []


def test_line_dedup_with_clashing_columns(spark):
    names = ["_rid", "_gone", "_gone_doc", "_gone_rid", "rid", "gone", "own_id", "own_text", "own_rid", "_keep", "_n_lines"]
    df = spark.createDataFrame([(1, "a\nb\nc\nd", *range(11)), (2, "x\na\nb\nc", *range(11)), (None, None, *[None] * 11)], "doc_id int, text string, " + ", ".join(f"{n} int" for n in names))
    out = linededup.dedup_lines(df)
    assert out.columns == [*df.columns[:-1], "_n_lines", "_n_removed"]
    got = {r.doc_id: r for r in out.collect()}
    assert (got[2].text, got[2]["_n_removed"], got[2]["_n_lines"], got[2].gone) == ("x", 3, 4, 5) and got[1].text == "a\nb\nc\nd" and got[None].text is None


def test_operators_keep_columns_of_any_name(spark):
    import public_tokenizers

    from oppengine.llm import langid, quality, sentencepieces, toxicity

    df = spark.createDataFrame([(1, "a few words of a text", "t", "s", "k"), (2, None, None, None, None)], "doc_id long, text string, _text string, stratum string, _keep string").withColumn("lang", F.lit("en"))
    keep, none = ["doc_id", "_text", "stratum", "_keep"], spark.createDataFrame([], "doc_id long, quality int, toxic int")
    path = public_tokenizers.path("piece_bpe_32k.model")
    for out in (langid.identify(df, keep), quality.quality_rules(df, none, keep=keep), toxicity.detect_toxicity(df, none, keep), sentencepieces.encode(df, path, keep), sentencepieces.round_trip(df, path, keep)):
        assert sorted(tuple(r[c] for c in keep) for r in out.collect()) == [(1, "t", "s", "k"), (2, None, None, None)]
