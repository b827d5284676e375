"""Keyed state against plain replays, progress that is written while a query runs, and cancelling."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from oppengine.plans import catalog
from oppengine.streaming import jobs, state
from oppengine.streaming.ingest import run_available

START = datetime(2024, 1, 1)


@pytest.fixture
def small(spark):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.streaming.stateStore.providerClass")}
    state.use_rocksdb(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v) if v else spark.conf.unset(k)


def streamed(spark, base, batches, schema, build):
    """The rows that a stateful stream appends over ``batches``, one a trigger."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        time.sleep(0.05)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    out = build(source)
    run_available(out, f"{base}/checkpoint", lambda b, i: b.write.mode("overwrite").parquet(f"{base}/out/batch={i}"))
    return spark.read.schema(out.schema).option("recursiveFileLookup", True).parquet(f"{base}/out")


def test_marks_expire_by_event_time_and_do_not_come_back(small, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    batches = [
        [("a", at(0)), ("a", at(5)), ("b", at(3)), (None, at(1)), ("x", None)],
        [("a", at(30)), ("c", at(34))],
        [("a", at(60)), ("late", at(2)), ("d", at(80.5))],
        [("e", at(100)), ("a", at(101))],
    ]
    changes = streamed(small, tmp_path, batches, "k string, seen timestamp", lambda s: state.expiring_marks(s, "k", "seen"))
    got = sorted((r.key, (r.at - START).total_seconds(), r.new) for r in changes.collect())
    assert got == [("a", 0, True), ("a", 35, False), ("b", 3, True), ("b", 38, False), ("c", 34, True), ("c", 69, False), ("d", 80.5, True), ("e", 100, True)]
    assert sorted(r.key for r in state.live_marks(changes).collect()) == ["d", "e"]


def test_page_store_by_hand(small, tmp_path):
    rng, rows, t = random.Random(8), [], START
    for i in range(600):
        t += timedelta(minutes=rng.choice([1, 7, 60]))
        rows.append((rng.choice("xxy"), i, f"u{rng.randrange(9)}", t, f"b{i}" if rng.random() < 0.85 else None))
    want, held = set(), {"x": {}, "y": {}}
    for store, i, url, at, body in rows:
        h, evicted = held[store], None
        hit = url in h and at - h[url][0] < timedelta(hours=5)
        if hit:
            body = h[url][1]
        else:
            h.pop(url, None)
            if body is not None:
                if len(h) >= 4:
                    evicted = next(iter(h))
                    del h[evicted]
                h[url] = (at, body)
        want.add((store, i, url, hit, body, evicted))
    cut = [rows[:250], rows[250:260], rows[260:]]
    for part in cut:
        rng.shuffle(part)  # a micro-batch comes in any order
    cut[0].append((None, 1, "u", t, "b"))
    out = streamed(small, tmp_path, cut, "store string, number long, url string, at timestamp, body string", lambda s: state.stored_pages(s, pages=4, hours=5))
    assert {tuple(r) for r in out.collect()} == want
    assert {r.hit for r in out.collect()} == {True, False} and any(x[5] for x in want)


def test_micro_batches_do_not_grow_with_the_input(spark, tmp_path, monkeypatch):
    at = lambda i: START + timedelta(seconds=i if i < 950 else 50 * i)
    df = spark.createDataFrame([(i, at(i)) for i in range(1000)] + [(-1, None)], "i long, at timestamp").repartition(3)
    for rows, most in ((None, 1000), (1000, 1000), (100, 110)):
        path = tmp_path / f"of-{rows}"
        monkeypatch.setattr(catalog, "shared_path", lambda spark, name, path=path: str(path))
        assert catalog._in_order(spark, df, "in", "at", 3, rows).isStreaming
        parts = [sorted(r.i for r in spark.read.parquet(str(f)).collect()) for f in sorted(path.glob("part-*"), key=lambda f: f.stat().st_mtime_ns)]
        assert [i for p in parts for i in p] == list(range(1000)) and max(map(len, parts)) <= most
        assert len(parts) == (10 if rows == 100 else 3)


def test_progress_is_there_while_the_query_runs(spark, tmp_path):
    for n in (3, 5, 2):
        spark.range(n).select("id", F.when(F.col("id") == 1, "bad").alias("err")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.05)
    seen = []

    def sink(batch, i):
        batch.count()
        if i == 2:
            for _ in range(100):  # rows of the batches before this one
                if (tmp_path / "progress" / "job-j" / "1" / "_SUCCESS").exists():
                    break
                time.sleep(0.1)
            seen.append(jobs.progress_rows(spark, f"{tmp_path}/progress", {"j": 10}).count())

    source = spark.readStream.schema("id long, err string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    jobs.run_with_progress(spark, jobs.observed(source, "err"), "j", f"{tmp_path}/checkpoint", sink, f"{tmp_path}/progress")
    got = sorted(tuple(r) for r in jobs.progress_rows(spark, f"{tmp_path}/progress", {"j": 20}).collect())
    assert seen == [2] and got == [("j", 0, 3, 1, 3, 15), ("j", 1, 5, 1, 8, 40), ("j", 2, 2, 1, 10, 50)]


def sleepy(spark, seconds):
    def run(batches):
        for b in batches:
            time.sleep(seconds)
            yield b

    return lambda: spark.range(2).mapInArrow(run, "id long")


def test_cancel_ends_tagged_work_only(spark, tmp_path):
    j = jobs.Jobs(spark, str(tmp_path))
    j.start("gone", {"first": lambda: spark.range(3), "long": sleepy(spark, 60), "never": lambda: spark.range(1)})
    j.start("other", {"slow": sleepy(spark, 4), "after": lambda: spark.range(5)})
    for _ in range(200):
        if j.finished("gone") == ["first"]:
            break
        time.sleep(0.1)
    assert j.snapshot("gone") == {"job": "gone", "state": "running", "done": False, "completed": 1, "percent": 33, "items": ["first"], "error": None}
    assert j.cancel("gone")
    assert j.snapshot("gone") == {"job": "gone", "state": "cancelled", "done": True, "completed": 1, "percent": 33, "items": ["first"], "error": None}
    assert j.wait("other", 60) and j.snapshot("other")["state"] == "completed" and j.finished("other") == ["after", "slow"]
    assert spark.read.parquet(f"{tmp_path}/job=gone/item=first").count() == 3


def test_the_flag_alone_stops_nothing_and_errors_are_kept(spark, tmp_path):
    j = jobs.Jobs(spark, str(tmp_path))
    j.start("flagged", {"slow": sleepy(spark, 2), "next": lambda: spark.range(2)})
    j.flag("flagged")
    assert j.snapshot("flagged")["done"] and j.snapshot("flagged")["state"] == "cancelled"
    assert j.wait("flagged", 60) and j.finished("flagged") == ["next", "slow"] and j.state["flagged"] == "cancelled"
    j.start("bad", {"ok": lambda: spark.range(1), "error": lambda: spark.range(1).select(F.raise_error(F.lit("no such page")))})
    assert j.wait("bad", 60) and j.state["bad"] == "failed" and "no such page" in j.errors["bad"] and j.finished("bad") == ["ok"]
