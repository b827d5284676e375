import re
from math import comb

import numpy as np
import pytest

from oppengine.llm.quality import COUNTS, RISK, binomial_tail, certify, measure, op3_quality, quality_rules


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows, covered, seen, dup = {}, set(), set(), 0
    for i in range(len(w) - 4):
        windows.setdefault(tuple(w[i : i + 5]), []).append(i)
    for v in windows.values():
        if len(v) > 1:
            for i in v:
                covered.update(range(i, i + 5))
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


TEXTS = [None, "", " \n\t", "a b c d e a b c d e", "x " * 500, "one\none\n\n\none \n two", "é#*$ 日本&|<>\x0bz\x0c", "a b c d e f g h i j k l", "a a a a a a"]


@pytest.mark.parametrize("text", TEXTS)
def test_counts(text):
    assert measure(text)[:5] == brute(text)


def test_binomial_tail_is_exact():
    for n, p, k in ((10, 0.3, 2), (50, 0.01, 0), (7, 0.5, 7)):
        assert abs(binomial_tail(k, n, p) - sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))) < 1e-12


def test_certify_stops_at_the_first_failure_and_corrects():
    assert certify({"a": (2000, [0, 3, 40, 0]), "b": (50, [0, 0]), "c": (0, [0])}, 0.01, 0.05) == {"a": 1, "b": -1, "c": -1}
    assert certify({"a": (300, [0])}, 0.01, 0.05) == {"a": 0}
    assert certify({k: (300, [0]) for k in "abcdef"}, 0.01, 0.05) == dict.fromkeys("abcdef", -1)


def test_certified_levels_keep_the_risk():
    rng = np.random.default_rng(0)
    broken = 0
    for _ in range(300):
        true = [0.002, 0.02, 0.05]
        n = 1000
        level = certify({"s": (n, np.cumsum(rng.binomial(n, np.diff([0, *true]))).tolist())})["s"]
        broken += level >= 0 and true[level] > RISK
    assert broken <= 0.08 * 300


def test_edges(spark):
    base = "The river runs along many green hills and wide open fields near our old town number "
    rows = [(i, base + f"{i} {i * 7} w{i}", "en") for i in range(3000)] + [(5000 + i, t, None) for i, t in enumerate(TEXTS)]
    junk = [(9000, " ".join("w%d#$%%" % i for i in range(40)), "en"), (None, base, "en"), (3, base + "3 21 w3", "en")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows + junk], "doc_id long, text string, lang string, stratum string, n_words int")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(3000)] + [(None, 0, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_rules(df, labels).collect()}
    for d, t, _ in rows[3000:]:
        r = got[d]
        assert tuple(r[c] for c in COUNTS[:5]) == brute(t)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed)
    assert not got[9000].kept and got[9000].reason == "symbol_share" and not got[9000].base_failed
    assert np.mean([got[i].kept for i in range(3000)]) > 1 - RISK


def test_no_labels_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h i j k", None)], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules(df, none).first().kept
    assert quality_rules(df.limit(0), none).count() == 0


def test_query_counts_equal_brute_force(spark, sf_dir):
    truth = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    for r in op3_quality(spark, sf_dir).collect():
        assert tuple(r[c] for c in COUNTS[:5]) == brute(truth[r.doc_id])


def made_up(n=4000, bad=400):
    """Clean texts of one stratum, and bad ones with symbols that the base rules let through; a second, small stratum."""
    rng = np.random.default_rng(3)
    words = ["river", "field", "green", "stone", "under", "light", "north", "water", "morning", "valley"]
    line = lambda k: " ".join(f"{words[rng.integers(10)]}{rng.integers(1000)}" for _ in range(k))
    rows = [(i, line(30), "en", 1) for i in range(n)] + [(n + i, " ".join(w + "###" for w in line(30).split()), "en", 0) for i in range(bad)]
    rows += [(100_000 + i, line(30) + (" #a# #b# #c# #d#" if i % 2 else ""), "xx", i % 2 == 0) for i in range(60)]
    return rows


def test_learned_cutoffs_reject_the_bad_and_keep_the_clean(spark):
    from oppengine.llm.quality import counts, learn

    rows = made_up()
    df = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], int(r[3])) for r in rows], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_rules(df, labels).collect()}
    en = [r for r in rows if r[2] == "en"]
    assert np.mean([got[r[0]].kept for r in en if r[3]]) > 1 - RISK
    assert not any(got[r[0]].kept for r in en if not r[3]) and got[4001].reason == "symbol_share"
    assert all(got[r[0]].kept for r in rows if r[2] == "xx")  # too few texts: nothing is certified
    limits, strata = learn(counts(df, ["doc_id"], df["lang"]), labels)
    found = {r.stratum: r for r in limits.collect()}
    assert strata == 2 and found["xx"].certified == 0 and found["en"].certified > 0 and found["en"].caught == found["en"].bad > 0


def brute_rules(rows, levels, risk, error):
    """kept and reason of (doc_id, text, stratum, good or None), row by row."""
    import zlib

    from oppengine.llm.quality import LEARN_FOLDS, METRICS, TEST_FOLDS

    def values(t):
        c = dict(zip(COUNTS, measure(t), strict=True))
        div = lambda a, b: a / b if b else 0.0
        mean = div(c["word_chars"], c["n_words"])
        return [div(c["n_symbols"], c["word_chars"]), div(c["n_dup_lines"], c["n_lines"]), div(c["n_repeat_words"], c["n_words"]), div(c["n_upper"], c["n_letters"]), mean, -mean], c["n_words"] < 10 or 100 * c["n_repeat_words"] > 20 * c["n_words"]

    data = [(i, s or "none", g, *values(t), zlib.crc32(str(i).encode()) % 5) for i, t, s, g in rows]
    usable = [d for d in data if d[2] is not None and not d[4]]
    strata = {d[1] for d in usable if d[2] and d[5] in TEST_FOLDS}
    limits = {}
    for s in {d[1] for d in usable}:
        own = [d for d in usable if d[1] == s]
        seen = [d for d in own if d[5] in LEARN_FOLDS]
        clean, bad = [d[3] for d in seen if d[2]], [d[3] for d in seen if not d[2]]
        if not clean:
            continue
        at = lambda m, x: sorted(v[m] for v in clean)[max(0, int(np.ceil((1 - x) * len(clean) - 1e-9)) - 1)]
        cuts = [[at(m, x) for x in levels] for m in range(6)]
        goes = lambda v, rule: any(j and v[m] > cuts[m][j - 1] for m, j in enumerate(rule))
        rule, rules = [0] * 6, []
        while bad:
            gone_bad, gone_clean, best = sum(goes(v, rule) for v in bad), sum(goes(v, rule) for v in clean), None
            for m in range(6):
                for j in range(rule[m] + 1, len(levels) + 1):
                    new = [*rule[:m], j, *rule[m + 1 :]]
                    b, c = sum(goes(v, new) for v in bad), sum(goes(v, new) for v in clean)
                    if c <= risk * len(clean) and (b - gone_bad) / len(bad) > (c - gone_clean) / len(clean):
                        key = ((b - gone_bad) / (c - gone_clean + 1), -m, -j)
                        best = max(best, (key, new)) if best else (key, new)
            if not best:
                break
            rule = best[1]
            rules.append(rule)
        if not bad:
            rules = [[1] * k + [0] * (6 - k) for k in range(1, 7)]
        test = [d[3] for d in own if d[5] in TEST_FOLDS and d[2]]
        chosen = None
        for r in rules:
            k, n = sum(goes(v, r) for v in test), len(test)
            if not n or k > n * risk or sum(comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(k + 1)) > error / max(1, len(strata)):
                break
            chosen = r
        if chosen:
            limits[s] = [cuts[m][j - 1] if j else None for m, j in enumerate(chosen)]
    out = {}
    for i, s, _, v, base, _ in data:
        first = next((METRICS[m] for m, x in enumerate(limits.get(s, [None] * 6)) if x is not None and v[m] > x), None)
        out[i] = (base, "base" if base else first)
    return out


@pytest.mark.parametrize("source", ["made up", "tables"])
def test_every_verdict_equals_brute_force(spark, source):
    levels, risk, error = (0.0, 0.02, 0.05), 0.08, 0.2
    if source == "made up":
        rows = [(i, t, s, bool(g)) for i, t, s, g in made_up(600, 80)]
    else:
        d = "/root/testdata/sf0.01"
        known = {r.doc_id: r.quality == 1 for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
        rows = [(r.doc_id, r.text, r.lang, known.get(r.doc_id)) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    df = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], int(r[3])) for r in rows if r[3] is not None], "doc_id long, quality int")
    got = {r.doc_id: (r.base_failed, r.reason) for r in quality_rules(df, labels, levels=levels, risk=risk, error=error).collect()}
    want = brute_rules(rows, levels, risk, error)
    assert got == want and any(x[1] == "symbol_share" for x in want.values())


def test_query_verdicts_equal_brute_force(spark, sf_dir):
    from oppengine.llm.quality import ERROR, LEVELS

    known = {r.doc_id: r.quality == 1 for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [(r.doc_id, r.text, r.lang, known.get(r.doc_id)) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = op3_quality(spark, sf_dir).collect()
    want = brute_rules(rows, LEVELS, RISK, ERROR)
    assert {r.doc_id: (r.base_failed, r.reason) for r in got} == want and all(r.kept == (r.reason is None) for r in got)


def test_many_strata_are_joined_in_parts(spark, monkeypatch):
    from oppengine.llm import quality

    rows = made_up(300, 40)
    df = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], int(r[3])) for r in rows], "doc_id long, quality int")
    small = {r.doc_id: (r.kept, r.reason) for r in quality_rules(df, labels, risk=0.1).collect()}
    monkeypatch.setattr(quality, "SENT_STRATA", 0)
    assert {r.doc_id: (r.kept, r.reason) for r in quality_rules(df, labels, risk=0.1).collect()} == small
