import math

import numpy as np

from pyspark.sql import functions as F

from oppengine.llm.common import fold
from oppengine.llm.langid import CALIBRATION_FOLD, ORDER, detect, identify, keys, kneser_ney, learn, op2_langid, standard, symbols

EN = "the quick brown fox jumps over the lazy dog while the children are playing with another red ball in the garden "
DE = "der schnelle braune fuchs springt über den faulen hund während die kinder mit einem roten ball im garten spielen "
FR = "le renard brun rapide saute par dessus le chien paresseux pendant que les enfants jouent avec un ballon rouge "


def test_symbols():
    assert symbols("Ab  1c!").tolist() == [0, 0, 0, 97, 98, 0, 99, 0]
    assert not symbols("12 !").any() and symbols("𝒳é")[-2:].tolist() == [0xFFFF, 0xE9]


def brute(counts, gram):
    """P(last | before) for a tuple of symbols by the textbook recursion over continuation counts."""
    top = {tuple(int(k) >> 16 * (ORDER - 1 - i) & 0xFFFF for i in range(ORDER)): int(c) for k, c in zip(*counts, strict=True)}
    by = {ORDER: top}
    for n in range(ORDER - 1, 0, -1):
        low = {}
        for g in by[n + 1]:
            low[g[1:]] = low.get(g[1:], 0) + 1
        by[n] = low

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / (len(by[1]) + 1)
        c = by[n]
        n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        same = {k: v for k, v in c.items() if k[:-1] == g[:-1]}
        total = sum(same.values())
        if not total:
            return p(g[1:])
        return max(c.get(g, 0) - d, 0) / total + d * len(same) / total * p(g[1:])

    return p(gram)


def test_model_equals_textbook_recursion():
    counts = {}
    for lang, text in (("en", EN * 2 + "a zoo"), ("de", DE * 2)):
        s = symbols(text)
        counts[lang] = np.unique(keys(s, ORDER)[ORDER - 1 :], return_counts=True)
    m = kneser_ney(counts)
    s = symbols("the zebra über qqq")
    h = m.entropies([s])
    for j, lang in enumerate(m.languages):
        want = -np.mean([math.log(brute(counts[lang], tuple(int(x) for x in s[i - ORDER + 1 : i + 1]))) for i in range(ORDER - 1, len(s))])
        assert abs(h[0, j] - want) < 1e-4


def rows():
    out = []
    for i in range(300):
        lang, text = (("en", EN), ("de", DE), ("fr", FR))[i % 3]
        words = text.split()
        k = i % len(words)
        out.append((i, " ".join(words[k:] + words[:k]), lang))
    return out


def test_edges(spark):
    extra = [(1000, None, "en"), (1001, "", "de"), (1002, "12 !?", "fr"), (None, EN, None), (1003, DE * 400, None), (1004, EN, "en"), (1004, EN, "en")]
    df = spark.createDataFrame([(*r, "clash") for r in rows() + extra], "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in identify(df).collect()}
    for d, _, lang in rows():
        assert got[d].lang_pred == lang and 0 <= got[d].score <= 1 and got[d].accepted
    assert [got[d].lang_pred for d in (1000, 1001, 1002)] == ["und"] * 3 and not any(got[d].accepted for d in (1000, 1001, 1002))
    assert got[None].lang_pred == "en" and got[1003].lang_pred == "de" and got[1004].lang_pred == "en"


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, EN, None), (2, None, None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in identify(df).collect()] == ["und", "und"]
    assert identify(df.limit(0)).count() == 0


def test_rejects_another_language(spark):
    czech = "příliš žluťoučký kůň úpěl ďábelské ódy zvlášť když přišel večer a všechno ztichlo " * 4
    df = spark.createDataFrame([*rows(), (9000, czech, None)], "doc_id long, text string, lang string")
    assert not [r.accepted for r in identify(df).collect() if r.doc_id == 9000][0]


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in op2_langid(spark, d).collect() if r.held_out]
    assert len(held) > 100 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98 and np.mean([r.accepted for r in held]) > 0.98


def test_bound_is_a_rank_among_all_rows_of_the_fold(spark):
    rng = np.random.default_rng(3)
    n = {"de": 6000, "en": 6000, "fr": 900}
    texts = {"de": DE.split(), "en": EN.split(), "fr": FR.split()}
    rows = [(l, " ".join(rng.choice(texts[l], rng.integers(4, 30)))) for l in n for _ in range(n[l])]
    df = spark.createDataFrame([(i, t, l) for i, (l, t) in enumerate(rows)], "doc_id long, text string, lang string").withColumn("_fold", fold())
    m = learn(df, sample_texts=400)
    largest = {}
    for j, lang in enumerate(m.languages):
        held = [symbols(r.text) for r in df.where((F.col("lang") == lang) & (F.col("_fold") == CALIBRATION_FOLD)).collect()]
        h, size = m.entropies(held), np.array([len(s) - ORDER + 1 for s in held], float)
        own = h.argmin(1) == j
        z = np.sort(standard(h[own, j], size[own], m.bounds[[j] * own.sum()]))
        k = math.ceil(0.999 * (len(z) + 1))
        assert (k <= len(z)) == (lang != "fr")
        assert m.bounds[j, 3] == (z[k - 1] if lang != "fr" else max(3 * z[-1], 12.0))
        largest[lang] = z[-1]
    # texts beyond the bound, but well within the uncalibrated one, are rejected
    mixed = [" ".join(rng.choice(texts["en"], 25)) for _ in range(60)]
    mixed = ["".join("z" if rng.random() < i / 300 else c for c in t) for i, t in enumerate(mixed)]
    h, size = m.entropies([symbols(t) for t in mixed]), np.array([len(symbols(t)) - ORDER + 1 for t in mixed], float)
    j = m.languages.index("en")
    z = standard(h.min(1), size, m.bounds[[j] * len(mixed)])
    between = (h.argmin(1) == j) & (z > m.bounds[j, 3]) & (z <= max(3 * largest["en"], 12.0))
    got = {r.doc_id: r.accepted for r in detect(spark.createDataFrame(list(enumerate(mixed)), "doc_id long, text string"), m, ["doc_id"]).collect()}
    assert between.any(), z
    assert not any(got[i] for i in np.flatnonzero(between))


class Recursion:
    """The textbook recursion with its sums made once."""

    def __init__(self, texts):
        by = {ORDER: {}}
        for t in texts:
            s = tuple(symbols(t).tolist())
            for i in range(ORDER - 1, len(s)):
                g = s[i - ORDER + 1 : i + 1]
                by[ORDER][g] = by[ORDER].get(g, 0) + 1
        for n in range(ORDER - 1, 0, -1):
            by[n] = {}
            for g in by[n + 1]:
                by[n][g[1:]] = by[n].get(g[1:], 0) + 1
        self.by, self.total, self.kinds, self.d, self.known = by, {}, {}, {}, {}
        for n, c in by.items():
            n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
            self.d[n] = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            for g, v in c.items():
                self.total[g[:-1]] = self.total.get(g[:-1], 0) + v
                self.kinds[g[:-1]] = self.kinds.get(g[:-1], 0) + 1

    def p(self, g):
        if not g:
            return 1 / (len(self.by[1]) + 1)
        if g not in self.known:
            total, d, lower = self.total.get(g[:-1], 0), self.d[len(g)], self.p(g[1:])
            self.known[g] = max(self.by[len(g)].get(g, 0) - d, 0) / total + d * self.kinds[g[:-1]] / total * lower if total else lower
        return self.known[g]

    def entropy(self, s):
        return -sum(math.log(self.p(s[i - ORDER + 1 : i + 1])) for i in range(ORDER - 1, len(s))) / max(1, len(s) - ORDER + 1)


def test_query_by_hand(spark, sf_dir):
    import zlib

    docs = {r.doc_id: (r.text, r.lang, zlib.crc32(str(r.doc_id).encode()) % 5) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    learned = sorted({lang for t, lang, f in docs.values() if lang and t and f not in (0, CALIBRATION_FOLD)})
    models = [Recursion([t for t, lang, f in docs.values() if lang == own and t and f not in (0, CALIBRATION_FOLD) and symbols(t).any()]) for own in learned]
    h = {i: [m.entropy(tuple(symbols(t).tolist())) for m in models] for i, (t, _, _) in docs.items() if t and symbols(t).any()}
    n = {i: len(symbols(docs[i][0])) - ORDER + 1 for i in h}

    def posterior(i, t):
        x = [-v * math.sqrt(n[i]) * t for v in h[i]]
        return [math.exp(v - max(x)) / sum(math.exp(w - max(x)) for w in x) for v in x]

    held_back = [i for i, (_, lang, f) in docs.items() if f == CALIBRATION_FOLD and lang in learned and i in h]
    loss = lambda t: -sum(math.log(max(posterior(i, t)[learned.index(docs[i][1])], 1e-12)) for i in held_back) / len(held_back)
    t = min((loss(2.0**k), 2.0**k) for k in range(-6, 7))[1]
    for r in op2_langid(spark, sf_dir).collect():
        text, _, f = docs[r.doc_id]
        assert r.held_out == (f == 0)
        if r.doc_id not in h:
            assert (r.lang_pred, r.score) == ("und", 0)
        else:
            best = min(range(len(learned)), key=lambda j: h[r.doc_id][j])
            assert r.lang_pred == learned[best] and abs(r.score - posterior(r.doc_id, t)[best]) < 1e-3 and abs(r.cross_entropy - h[r.doc_id][best]) < 1e-4


def test_long_texts_in_pieces(monkeypatch):
    from oppengine.llm import langid

    counts = {lang: np.unique(keys(symbols(text * 2), ORDER)[ORDER - 1 :], return_counts=True) for lang, text in (("en", EN), ("de", DE), ("fr", FR))}
    m = kneser_ney(counts)
    rows = [symbols(t) for t in (EN * 3, "a", "über " * 70, DE, "x y", FR * 2)]
    whole = m.entropies(rows)
    assert np.allclose(whole, [m.entropies([r])[0] for r in rows])
    for piece in (1, 3, 7, 50, 333):
        monkeypatch.setattr(langid, "_PIECE", piece)
        assert np.allclose(m.entropies(rows), whole, atol=1e-5), piece
