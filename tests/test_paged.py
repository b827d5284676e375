"""Saved API pages as a data source: where a search ends, what is opened, and what is pushed."""

import json

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oppengine.sources import paged

SCHEMA = "state string, page int, n long, name string, x double, tags array<struct<name: string>>"


def saved(base, state, page, records, count=True, text=None):
    folder = base / f"state={state}" / f"page={page}"
    folder = folder / f"count={len(records)}" if count else folder
    folder.mkdir(parents=True)
    (folder / "part-0.json").write_text(text if text is not None else json.dumps({"rows": records}), encoding="utf-8")


def read(spark, base, **options):
    return paged.read_saved_api(spark, str(base), "rows", SCHEMA, ["state"], **options)


def numbers(df):
    return sorted((r.state, r.n) for r in df.where("n is not null").collect())


def rows(*ns):
    return [{"n": n, "name": f"n{n}"} for n in ns]


def test_a_search_ends_at_a_short_page_an_empty_page_or_a_gap(spark, tmp_path):
    for page, ns in enumerate([(0, 1, 2), (3, 4, 5), (6,), (7, 8, 9)]):
        saved(tmp_path, "short", page, rows(*ns))
    for page, ns in enumerate([(0, 1, 2), (), (3, 4, 5)]):
        saved(tmp_path, "empty", page, rows(*ns))
    for page in (0, 2):
        saved(tmp_path, "gap", page, rows(page))
    saved(tmp_path, "late", 1, rows(1))
    for counted in (True, False):
        for page, ns in enumerate([(0, 1, 2), (3,), (4, 5, 6)]):
            saved(tmp_path, f"c{counted}", page, rows(*ns), counted)
    got = numbers(read(spark, tmp_path, page_size=3))
    want = {"short": range(7), "empty": range(3), "gap": range(1), "cTrue": range(4), "cFalse": range(4)}
    assert got == sorted((s, n) for s, ns in want.items() for n in ns)
    assert [x for x in numbers(read(spark, tmp_path)) if x[0] in ("short", "empty")] == [("empty", n) for n in range(3)] + [("short", n) for n in range(10)]


def test_pages_past_the_limit_and_other_searches_are_not_opened(spark, tmp_path):
    for s in ("a", "b"):
        saved(tmp_path, s, 0, rows(0, 1))
        saved(tmp_path, s, 1, rows(2, 3))
    saved(tmp_path, "a", 2, rows(4, 5), text="not JSON")
    saved(tmp_path, "c", 0, rows(1), text="not JSON")
    ab = "state in ('a', 'b')"
    assert numbers(read(spark, tmp_path, limit=3, where=ab)) == [(s, n) for s in "ab" for n in range(3)]
    assert numbers(read(spark, tmp_path, limit=4, where=ab)) == [(s, n) for s in "ab" for n in range(4)]
    assert numbers(read(spark, tmp_path, limit=3, least=("n", 1), where="state = 'a'")) == [("a", 1), ("a", 2), ("a", 3)]
    assert numbers(read(spark, tmp_path, limit=0, where=ab)) == []
    for where in ("state = 'c'", "state = 'a'"):
        with pytest.raises(PythonException):
            read(spark, tmp_path, where=where).collect()


def test_every_counted_page_is_a_partition():
    page = lambda i, c: paged.Page({}, i, c, f"p{i}")
    cut = lambda pages, *a: [([p.number for p in x.pages], x.take) for x in paged.planned(pages, *a)]
    five = [page(i, 10) for i in range(5)]
    assert cut(five, None, None, False) == [([i], None) for i in range(5)]
    assert cut(five, 10, 25, False) == [([0], 25), ([1], 15), ([2], 5)]
    assert cut(five, 10, 25, True) == [([0, 1, 2, 3, 4], 25)]
    assert cut([*five[:2], page(2, 3), page(3, 10)], 10, None, False) == [([0], None), ([1], None), ([2], None)]
    assert cut([page(0, 10), page(1, None)], 10, None, False) == [([0, 1], None)]
    assert cut([], 10, None, False) == [] and cut([page(0, 0)], 10, None, False) == []


def test_filters_are_pushed_and_uses_do_not_mix(spark, tmp_path, capsys):
    for s in "abc":
        saved(tmp_path, s, 0, [{"n": i if i else None, "name": f"{s}{i}", "x": i / 2} for i in range(6)])
    df = read(spark, tmp_path, where="state <> 'c' and n >= 2 and name like 'a%' and x < 2.5")
    df.explain("formatted")
    plan = capsys.readouterr().out
    for pushed in ("GreaterThanOrEqual(n,2)", "StringStartsWith(name,a)", "LessThan(x,2.5)"):
        assert pushed in plan
    assert numbers(df) == [("a", 2), ("a", 3), ("a", 4)]
    every = read(spark, tmp_path)
    assert numbers(every.where("state = 'a'").union(every.where("state = 'b' and n > 4"))) == [("a", n) for n in range(1, 6)] + [("b", 5)]
    both = every.where("state = 'a'").select("n").join(every.where("state = 'b'").select("n"), "n")
    assert both.count() == 5 and every.count() == 18 and every.where("n is null").count() == 3
    limited = read(spark, tmp_path, limit=3, where="n >= 1")
    assert numbers(limited) == [(s, n) for s in "abc" for n in (1, 2)]  # of the first three records


def test_names_values_and_odd_pages(spark, tmp_path):
    odd = [{"n": "7", "name": 5, "x": 2, "tags": [{"name": "a", "more": 1}, {}]}, {"n": True, "name": {"k": "é"}, "x": "2", "tags": "none"}, {"other": 1}]
    saved(tmp_path, "a%2Fb c", 0, odd)
    saved(tmp_path, "__HIVE_DEFAULT_PARTITION__", 0, rows(1))
    (tmp_path / "_SUCCESS").write_text("")
    (tmp_path / "state=a%2Fb c" / "page=0" / "count=3" / ".part-0.json.crc").write_bytes(b"\0")
    got = {(r.state, r.n, r.name, r.x): r.tags for r in read(spark, tmp_path).collect()}
    assert got == {("a/b c", None, "5", 2.0): [("a",), (None,)], ("a/b c", None, '{"k": "é"}', None): None, ("a/b c", None, None, None): None, (None, 1, "n1", None): None}
    assert read(spark, tmp_path, where="state = 'a/b c'").count() == 3
    (tmp_path / "none").mkdir()
    assert read(spark, tmp_path / "none").count() == 0


def test_what_is_saved_comes_back(spark, tmp_path):
    df = spark.createDataFrame([(f"s {i % 3}/%", i, f"n{i}", i / 4, [(str(i),)]) for i in range(50)], T._parse_datatype_string(SCHEMA.replace("page int, ", "")))
    paged.save_pages(df, str(tmp_path / "x"), "rows", ["state"], "n", 7)
    back = read(spark, tmp_path / "x", page_size=7)
    assert sorted(map(tuple, back.drop("page").collect())) == sorted(map(tuple, df.collect()))
    assert back.groupBy("state", "page").count().where("count > 7").count() == 0
    assert sorted(r.n for r in read(spark, tmp_path / "x", page_size=7, limit=10).collect()) == list(range(30))


def test_many_pages_are_few_files_and_few_partitions(spark, tmp_path):
    """Pages of blocks are read as pages of folders are: to a short one, a gap or an empty one, and to the limit."""
    df = spark.range(4000).select((F.col("id") % 2).cast("string").alias("state"), F.col("id").alias("n"), F.concat(F.lit("a\n"), "id").alias("name"))
    paged.save_pages(df, str(tmp_path / "x"), "rows", ["state"], "n", 5)  # 400 pages a search
    assert len(list((tmp_path / "x").rglob("part-*"))) == 8
    back = read(spark, tmp_path / "x", page_size=5)
    assert sorted((r.state, r.n, r.name) for r in back.collect()) == sorted((str(i % 2), i, f"a\n{i}") for i in range(4000))
    assert back.rdd.getNumPartitions() == 8 and back.where("page = 200").count() == 10
    of = lambda n: [(s, i) for s in ("0", "1") for i in range(int(s), 2 * n, 2)]
    for limit in (3, 640, 641, 645, 1999, 5000):
        assert numbers(read(spark, tmp_path / "x", page_size=5, limit=limit)) == of(min(limit, 2000))
    assert numbers(read(spark, tmp_path / "x", page_size=5, limit=400, least=("n", 1000))) == [(s, i + 1000) for s, i in of(400)]
    rows = [(s, p, 10 * p + i) for s, sizes in {"short": {200: 2}, "gap": {130: 0}, "next": {128: 0}, "late": {0: 0}, "full": {}}.items() for p in range(300) for i in range(sizes.get(p, 3))]
    paged.save_pages(spark.createDataFrame(rows, "state string, page int, n long"), str(tmp_path / "y"), "rows", ["state"], "n", 3, "page")
    last = {"short": 200, "gap": 129, "next": 127, "full": 299}
    assert numbers(read(spark, tmp_path / "y", page_size=3)) == sorted((s, n) for s, p, n in rows if p <= last.get(s, -1))
    assert {s for s, n in numbers(read(spark, tmp_path / "y"))} == set(last) and ("short", 2010) in numbers(read(spark, tmp_path / "y"))
