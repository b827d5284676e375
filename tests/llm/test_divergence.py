"""Source divergence against the definition, term by term."""

import random
import re
from collections import Counter, defaultdict

from oppengine.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(docs, least=10, top=10):
    """docs: (text, lang, source) -> {(lang, source, part, item, value, rank)}"""
    docs = [tuple(x or "" for x in d) for d in docs]
    counts, df = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        terms = TERM.findall(text.translate(LOWER))
        counts[lang, source].update(terms)
        df[lang].update(set(terms))
    out = set()
    for lang, frequent in df.items():
        kept = [t for t, n in frequent.items() if n >= least]
        v = len(kept)
        own = {s: {t: counts[x, s][t] for t in kept} for x, s in counts if x == lang}
        price = lambda c, n: 1 + 1_000_000_000 * (c + 2) // (n + 2 * v)
        p = {s: {t: price(c[t], sum(c.values())) for t in kept} for s, c in own.items()}
        every = Counter()
        for c in own.values():
            every.update(c)
        q = {t: price(every[t], sum(every.values())) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pairs = [(-sum(f(p[s][t], p[u][t]) for t in kept), u.encode(), u) for u in own if u != s]
            more = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if own[s][t] and p[s][t] > q[t]]
            out |= {(lang, s, "pair", u, -x, i) for i, (x, _, u) in enumerate(sorted(pairs), 1)}
            out |= {(lang, s, "term", t, -x, i) for i, (x, _, t) in enumerate(sorted(more)[:top], 1)}
    return out


def test_divergence_by_hand(spark):
    rng = random.Random(3)
    words = ["the", "Of", "naïve", "straße", "ÉCOLE", "日本", "x"] + [f"w{chr(97 + i)}" for i in range(20)]
    docs = [(" ".join(rng.choices(words, k=rng.randrange(30))), rng.choice(["en", "en", "en", "de", None]), rng.choice(["a", "b", "c", None])) for _ in range(300)]
    docs += [(None, "en", "silent"), ("", "en", "a"), ("12 34 --", "en", "numbers"), ("only here", "fr", "a"), (None, "fr", "b"), ("the " * 40_000, "en", "b")]
    docs += docs[:40]  # repeated rows are documents of their own
    docs += [("hot the " * 5, "en", "hot")] * 150  # a hot group
    df = spark.createDataFrame([(*d, 1, "t") for d in docs], "text string, lang string, source string, c int, term string").repartition(5)
    out = divergence.divergence(df)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == by_hand(docs)
    assert divergence.divergence(df.limit(0)).count() == 0


def test_counts_beyond_64_bits(spark):
    """Prices are exact where WHOLE times the count is not a 64-bit number."""
    from pyspark.sql import functions as F

    big = [(10**13 + 7, 3 * 10**14 + 1, 12_345), (0, 10**17, 10**6), (9_223_372_036, 9_223_372_037, 1)]
    df = spark.createDataFrame(big, "c long, n long, v long").select(divergence.price(F.col("c"), F.col("n"), F.col("v")))
    assert [r[0] for r in df.collect()] == [1 + 10**9 * (c + 2) // (n + 2 * v) for c, n, v in big]


def test_tasks_hand_counts_on(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_COUNTS", 3)
    docs = [(f"a b{i % 7 * 'b'} c", "en", f"s{i % 3}") for i in range(60)]
    df = spark.createDataFrame(docs, "text string, lang string, source string").coalesce(2)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([dict(zip(("text", "lang", "source"), d, strict=True)) for d in docs])
    parts = list(divergence._counted(iter([batch.slice(i, 5) for i in range(0, 60, 5)])))
    assert len(parts) > 3
    assert {tuple(r) for r in divergence.divergence(df).collect()} == by_hand(docs)
