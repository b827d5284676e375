import itertools
import math
import time

import numpy as np

from oppengine.llm import toxicity
from oppengine.llm.toxicity import Field, detect_toxicity, features, marginals, offsets, op4_toxicity, train_field


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    t, start, lengths = rng.normal(size=(2, 2)), 0.3, np.array([5, 3, 1])
    e = rng.normal(size=9)
    got, logz, moves = marginals(e, lengths, t, start, pairs=True)
    at, want, z_all, want_moves = 0, [], 0.0, np.zeros((2, 2))
    for n in lengths:
        s = e[at : at + n]
        score = {y: start * y[0] + sum(s[i] * y[i] for i in range(n)) + sum(t[y[i], y[i + 1]] for i in range(n - 1)) for y in itertools.product((0, 1), repeat=int(n))}
        z = sum(map(math.exp, score.values()))
        z_all += math.log(z)
        want += [sum(math.exp(v) for y, v in score.items() if y[i]) / z for i in range(n)]
        for y, v in score.items():
            for i in range(n - 1):
                want_moves[y[i], y[i + 1]] += math.exp(v) / z
        at += n
    assert np.allclose(got, want) and np.allclose(moves, want_moves)


def test_training_finds_the_marked_word():
    bad = (["you", "are", "an", "idiot", "today"], np.array([0, 0, 0, 1, 0]))
    good = (["you", "are", "an", "expert", "today"], np.array([0] * 5))
    f = train_field([bad, good] * 40)
    m = marginals(f.emissions(["an", "idiot"]), np.array([2]), f.transition, f.start)
    assert m[1] > 0.5 > m[0]
    assert isinstance(f, Field) and len(features("x")) >= 3
    assert (train_field([]).weights == 0).all()


def test_emissions_equal_the_sum_of_features():
    f = Field(np.random.default_rng(0).normal(size=1 << 18), np.zeros((2, 2)), 0.0)
    for t in ("Idiot,", "a", "%%%", "Überlänge!!", "abcdefgh"):
        assert math.isclose(f.emissions([t])[0], f.weights[features(t)].sum())


def test_offsets():
    assert offsets("ab  cd\nef gh", np.array([False, True, True, False])) == [{"start": 4, "end": 9}]
    assert offsets("x y", np.array([True, True])) == [{"start": 0, "end": 3}]


def corpus():
    rng = np.random.default_rng(1)
    words = ["river", "stone", "green", "paper", "music", "cloud", "table", "light", "horse", "bread"]
    out = []
    for i in range(400):
        w = list(rng.choice(words, 30))
        bad = i % 4 == 0
        if bad:
            w[int(rng.integers(30))] = "moron,"
        out.append((i, " ".join(w) + f" n{i}", int(bad)))
    return out


def test_edges(spark):
    rows = corpus()
    docs = [(d, t, "clash") for d, t, _ in rows] + [(2000, None, ""), (2001, "", ""), (2002, "river " * 20_000 + "moron", ""), (None, "a moron", ""), (5, rows[5][1], "again")]
    labels = [(d, 1, y) for d, _, y in rows] + [(None, 1, 1), (7, 1, None), (7, None, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, score string").repartition(3)
    got = {}
    for r in detect_toxicity(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect():
        got.setdefault(r.doc_id, r)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    assert all(got[d].predicted == y for d, _, y in rows)
    text = rows[0][1]
    assert [text[s.start : s.end] for s in got[0].spans] == ["moron,"]
    assert got[2000].predicted == got[2001].predicted == 0 and got[2000].score == got[2001].score
    assert got[2002].predicted == 1 and got[None].predicted == 1


def test_no_labels(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert detect_toxicity(df, none).first().score == 0.0
    assert detect_toxicity(df.limit(0), none).count() == 0


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = [(truth[r.doc_id], r.predicted) for r in op4_toxicity(spark, d).collect() if r.held_out and r.doc_id in truth]
    assert np.mean([p for y, p in held if y]) > 0.8 and np.mean([p for y, p in held if not y]) < 0.02


def test_field_trains_on_all_spans_of_the_sampled_rows(spark, monkeypatch):
    docs = [(i, int(i % 3 == 0), " ".join([f"w{i}x{k}" for k in range(600)] + ["idiot"] * (i % 3 == 0) + ["end"] * (i % 7))) for i in range(40)] + [(99, 1, ""), (98, 0, "one")]
    df = spark.createDataFrame(docs, "doc_id long, toxic int, text string").repartition(5)
    sequences = [(w, np.array(y)) for _, toxic, text in docs for w, y in toxicity.cut(text, {"=idiot"} if toxic else set())]
    assert max(len(w) for w, _ in sequences) == toxicity.TRAIN_SPAN and sum(len(w) for w, _ in sequences) == sum(len(t.split()) for *_, t in docs)
    assert sum(int(y.sum()) for _, y in sequences) == 14
    whole = train_field(sequences, rounds=5)
    f = toxicity.train_on(df, {"=idiot"}, rounds=5)
    assert np.allclose(f.weights, whole.weights) and np.allclose(f.transition, whole.transition) and np.isclose(f.start, whole.start)
    several = [toxicity.encoded(sequences[i::3]) for i in range(3)]
    one = toxicity.encoded([s for s in sequences if s[0]])
    assert np.allclose(sum(toxicity.gradient(whole, b) for b in several), toxicity.gradient(whole, one))
    assert (toxicity.train_on(df.limit(0), set(), rounds=2).weights == 0).all()


def test_query_by_hand(spark, tmp_path):
    """Marks, spans, field, calibration and scores again by plain loops over the same rows; a sample of all of them."""
    rows = corpus() + [(900 + i, t, None) for i, t in enumerate(["", None, "moron", "a b", "Moron! moron; x"])]
    spark.createDataFrame([(i, t, "en", "s") for i, t, _ in rows], "doc_id long, text string, lang string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y, 1) for i, _, y in rows if y is not None], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    import zlib

    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    known = {t: (i, y) for i, t, y in rows if y is not None and fold(i)}
    thirds = {r.id: r.f for r in spark.createDataFrame([(i,) for i, _ in known.values()], "id long").selectExpr("id", "pmod(xxhash64('calibrate', id), 3) AS f").collect()}
    bad, every = {}, {}
    for t, (_, y) in known.items():
        for u in {u for w in t.split() if toxicity.normal(w) for u in toxicity.units(toxicity.normal(w))}:
            every[u] = every.get(u, 0) + 1
            bad[u] = bad.get(u, 0) + y
    z = toxicity.MARK_Z

    def low(k, n):
        s = k / n
        return (s + z * z / (2 * n) - z * math.sqrt(s * (1 - s) / n + z * z / (4 * n * n))) / (1 + z * z / n)

    marks = {u for u, n in every.items() if bad[u] >= toxicity.MARK_TEXTS and low(bad[u], n) >= toxicity.MARK_SHARE}
    assert "=moron" in marks
    f = train_field([(w, np.array(y)) for t, (i, toxic) in known.items() if thirds[i] for w, y in toxicity.cut(t, marks if toxic else set())])

    def inputs(text):
        e = [f.weights[features(t)].sum() for t in (text or "").split()]
        m = one_by_one(e, f.transition, f.start)
        top = sorted(m, reverse=True) + [0, 0]
        return [sum(m), top[0], len(m), top[1] if len(m) > 1 else 0], m

    seen = [(inputs(t)[0], y) for t, (i, y) in known.items() if not thirds[i]]
    x, y = np.array([v for v, _ in seen], float), np.array([y for _, y in seen], float)
    b = toxicity.fit_logistic(toxicity._logit_inputs(x), y)
    ones = sum(y for _, y in known.values())
    b[0] += math.log(ones / (len(known) - ones) / (y.sum() / (1 - y).sum()))
    for r in op4_toxicity(spark, str(tmp_path)).collect():
        v, m = inputs(dict((i, t) for i, t, _ in rows)[r.doc_id])
        p = 1 / (1 + math.exp(-float(toxicity._logit_inputs(np.array([v], float))[0] @ b)))
        assert math.isclose(r.score, p, abs_tol=1e-6) and r.predicted == (p >= 0.5) and r.held_out == (fold(r.doc_id) == 0)
        assert len(r.spans) == sum(q >= 0.5 and not (i and m[i - 1] >= 0.5) for i, q in enumerate(m))


def one_by_one(e, transition, start):
    """P(state 1) of each token, forward and backward in logarithms."""
    if not e:
        return []
    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    forward, back = [(0.0, start + e[0])], [(0.0, 0.0)]
    for x in e[1:]:
        a = forward[-1]
        forward.append(tuple(add(a[0] + transition[0][s], a[1] + transition[1][s]) + x * s for s in (0, 1)))
    for x in e[:0:-1]:
        c = back[-1]
        back.append(tuple(add(transition[s][0] + c[0], transition[s][1] + x + c[1]) for s in (0, 1)))
    return [1 / (1 + math.exp((a[0] + c[0]) - (a[1] + c[1]))) for a, c in zip(forward, back[::-1], strict=True)]


def test_long_tokens_and_texts(spark):
    began = time.time()
    n = 1_000_000
    assert toxicity.normal("a" + "." * n + "a") == "a" + "." * n + "a" and toxicity.normal("_" * n + "A" + "." * n) == "a" and toxicity.normal("." * n) == ""
    rows = corpus() + [(1000, "x" + "-" * n + "x moron", 1), (1001, "river moron " * (n // 12), 1), (1002, "." * n, 0)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    out = {r.doc_id: r for r in detect_toxicity(df, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")).collect()}
    assert len(out) == len(rows) and out[1001].predicted == 1 and time.time() - began < 120


def test_second_largest_marginal_counts_ties_and_single_tokens():
    f = toxicity.Field(np.zeros(1 << toxicity.HASH_BITS), np.zeros((2, 2)), 0.0)
    f.weights[toxicity.slot("wbad")] = 4.0
    x, found = toxicity.document_features(f, ["bad ok bad", "ok bad", "bad", "", None])
    assert np.allclose(x[:3, 1], x[0, 1]) and x[0, 1] > 0.9
    assert np.allclose(x[:, 3], [x[0, 1], 0.5, 0, 0, 0])
    assert [q is not None for q in found] == [True, True, True, False, False]


def test_marks_of_beginnings_up_to_nine_letters():
    assert "bomentec" in toxicity.units("bomentecara") and "bomenteca" in toxicity.units("bomentecara")
