"""Collocations against the definition, and the parts that only large inputs reach."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from oppengine.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
        yield re.findall(r"[^\x20\x09]+", piece)


def by_hand(docs, least, top=2000):
    """docs: (text, lang) -> {(lang, rank, phrase, a, l, r, n, score)}"""
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        for w in pieces(text):
            n[lang or "und"] += len(w)
            for k in range(1, 6):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, c in f.items():
        rows = []
        for p, a in c.items():
            if len(p) < 2 or a < least:
                continue
            cuts = [(1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p))]
            longer = [q for q in c if len(q) > len(p) and 100 * c[q] >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if not longer:
                s, k = min(cuts)
                rows.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1):
            out.add((lang, i, p.decode(), -a, l, r, n[lang], -s))
    return out


def corpus():
    rng = random.Random(5)
    words = ["the", "of", "And", "naïve", "x#1", "日本", "a\x1cb", "o'clock", "#", "the"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", " ", ", ", ".", "\n", "\r\n"]) for _ in range(n))
    docs = [(text(rng.randrange(60)), rng.choice(["en", "en", "de", None])) for _ in range(150)]
    docs += [(None, "en"), ("", None), (" \t", "fr"), (".,;:!?", "en"), ("the the the the the the", "en"), ("rare words here", "fr"), ("Big Old Red New Tin BOX of joy", "fr")]
    docs += [("one Two three four five six seven", "en")] * 30 + [("big old red new tin box", "fr")] * 12
    return docs + docs[:25]


@pytest.mark.parametrize("least", [2, 10])
def test_collocations_by_hand(spark, least):
    docs = corpus()
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "text string, lang string, n int, rank int").repartition(6)
    out = phrases.collocations(df, least=least)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == by_hand(docs, least)


def test_top_and_nothing(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "text string, lang string").repartition(3)
    assert {tuple(r) for r in phrases.collocations(df, least=5, top=3).collect()} == by_hand(docs, 5, 3)
    assert phrases.collocations(df.limit(0)).count() == 0
    assert phrases.collocations(df, least=10**6).count() == 0


def test_one_long_text_among_many_partitions(spark):
    long = "to be or not " * 30_000 + "x" * 1_000_000
    docs = [(long, "en")] + [("to be or not, that", "en")] * 200
    rows = {r.phrase: r for r in phrases.collocations(spark.createDataFrame(docs, "text string, lang string").repartition(8)).collect()}
    assert rows["to be or not"].a == 30_200 and rows["be or not to be"].a == 29_999 and rows["to be or not"].n == 30_000 * 4 + 1 + 200 * 5


def test_shards_are_cut_and_numbers_come_back(monkeypatch):
    monkeypatch.setattr(phrases, "SHARD_WORDS", 40)
    monkeypatch.setattr(phrases, "OPEN_WORDS", 60)
    docs = [(f"A b c{i % 5}. D e\tf", ["en", "de", "fr"][i % 3]) for i in range(50)]
    batch = pa.RecordBatch.from_pylist([dict(zip(("text", "lang"), d, strict=True)) for d in docs])
    shards = list(phrases._sharded(iter([batch])))
    assert len(shards) > 6
    got = defaultdict(Counter)
    for s in shards:
        words, places = s["words"][0].as_py(), phrases.unpacked(s["places"][0].as_py())
        assert list(np.bincount(places, minlength=len(words))) == s["counts"][0].as_py() and words[0] == "."
        got[s["lang"][0].as_py()].update(words[p] for p in places if p)
    want = defaultdict(Counter)
    for text, lang in docs:
        for w in pieces(text):
            want[lang].update(w)
    assert got == want


@pytest.mark.parametrize("together", [3, 1 << 17])
def test_bitmaps_by_hand(monkeypatch, together):
    monkeypatch.setattr(phrases, "TOGETHER", together)
    rng = np.random.default_rng(7)
    places = rng.choice(6, 3000, p=[0.1, 0.4, 0.3, 0.1, 0.05, 0.05])
    pairs = [(1, 1), (1, 2), (2, 1), (2, 2), (2, 3), (3, 1), (4, 5)]
    want = Counter()
    for k in range(2, 6):
        for i in range(len(places) - k + 1):
            p = tuple(int(x) for x in places[i : i + k])
            if all(x in pairs for x in zip(p, p[1:], strict=False)):
                want[p] += 1
    got = Counter()
    for p, c in phrases.frequent_phrases(places, *map(np.array, zip(*pairs, strict=True))):
        for row, n in zip(p.tolist(), c.tolist(), strict=True):
            assert tuple(row) not in got
            got[tuple(row)] = n
    assert got == want


def sent_and_grown(shards, ids, least, tasks, classes=4, buckets=20):
    """(entries that each task sends, {phrase of ids: f} that leaves the classes) of shards dealt over tasks."""
    heavy = type("Broadcast", (), {"value": [np.full(1 << (buckets - 3), 255, np.uint8)] * 2})
    entries, rows = [], []
    for t in range(tasks):
        mine = [{"ids": ids.tolist(), "places": phrases.packed(p)} for p in shards[t::tasks]]
        out = [r for b in phrases._windows(heavy, buckets, classes)(iter([pa.RecordBatch.from_pylist(mine)])) for r in b.to_pylist()]
        entries.append(sum(int.from_bytes(r["counts"][:8], "little") for r in out))
        rows += out
    rows.sort(key=lambda r: r["class"])
    out = [r for b in phrases._grown(least)(iter([pa.RecordBatch.from_pylist(rows)])) for r in b.to_pylist()]
    assert len({tuple(r["ids"]) for r in out}) == len(out)  # a phrase leaves one class, once
    return entries, {tuple(r["ids"]): r["f"] for r in out}


def of_shards(shards, ids, least):
    f = Counter()
    for p in shards:
        for k in range(2, 6):
            f.update(t for t in zip(*(p[i:].tolist() for i in range(k)), strict=False) if all(t))
    return {tuple(ids[list(t)].tolist()): n for t, n in f.items() if n >= least}


@pytest.mark.parametrize("together, held", [(1, 5), (7, 100), (1 << 16, 1 << 19)])
def test_phrases_leave_their_class_once_and_frequent(monkeypatch, together, held):
    monkeypatch.setattr(phrases, "WINDOWS_TOGETHER", together)
    monkeypatch.setattr(phrases, "HELD", held)
    rng = np.random.default_rng(11)
    ids = np.array([0, *rng.permutation(9)])  # 0 is a word's id, too
    shards = [rng.choice(10, n, p=[0.1, *[0.1] * 9]) for n in (500, 900, 1, 0, 300, 700)]
    for least in (1, 8, 10**6):
        assert sent_and_grown(shards, ids, least, 2)[1] == of_shards(shards, ids, least)


def test_shards_send_no_counts_of_their_own():
    rng = np.random.default_rng(12)
    ids = np.array([0, *range(50, 70)])
    shard = rng.choice(21, 2000)
    few, many = ([shard] * n for n in (2, 40))
    (one, *_), got = sent_and_grown(few, ids, 4, 1)
    (more, *_), got_many = sent_and_grown(many, ids, 80, 1)
    assert one == more and got == of_shards(few, ids, 4) and got_many == {p: 20 * f for p, f in got.items()}


def test_light_buckets_hold_nothing_frequent(spark, monkeypatch):
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 2**62, 9)
    shards = [rng.choice(9, 400, p=[0.1, *[0.9 / 8] * 8]) for _ in range(6)]
    true = [Counter(), Counter()]
    for p in shards:
        for k in (2, 3):
            true[k - 2].update(t for t in zip(*(p[i:].tolist() for i in range(k)), strict=False) if all(t))
    rows = [(ids.tolist(), phrases.packed(p)) for p in shards]
    for least in (4, 30, 300):
        heavy = phrases.heavy_buckets(spark.createDataFrame(rows, "ids array<long>, places binary").repartition(3), least, 24)
        for bits, counts in zip(heavy, true, strict=True):
            keys = np.array(list(counts))
            got = phrases.among(bits, phrases.bucket(24, *(ids[keys[:, i]] for i in range(keys.shape[1]))))
            assert got.tolist() == [counts[tuple(k)] >= least for k in keys.tolist()]  # no two meet in a bucket here


def test_scores_beyond_64_bits(spark):
    rows = [(10**12 + 3, 10**15 + 11, 10**12 + 7, 10**13 + 1), (100, 5, 100, 100), (7 * 10**9, 10**17, 7 * 10**9, 7 * 10**9)]
    df = spark.createDataFrame(rows, "a long, n long, l long, r long").select(phrases.score(*map(F.col, "anlr")))
    assert [r[0] for r in df.collect()] == [1000 * a * n // (l * r) for a, n, l, r in rows]
