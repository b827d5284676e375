"""Personal data: the base by its patterns, the estimates by plain loops, planted spans, and texts that are made to be slow."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np

from oppengine.llm import personal

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, s):
    d = [int(c) for c in s if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if 2 * x > 9 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def base_by_hand(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if holds(k, m.group())]


def with_luhn(d):
    return next(d + str(c) for c in range(10) if personal.luhn(d + str(c)))


def sentences(rng):
    words = "call me at the office and send it to us before 2024-01-31 version 1.2.3 page 12 or order 1234567 über ñandú 日本".split()
    card, ip = with_luhn("4" + "".join(rng.choices("0123456789", k=14))), ".".join(str(rng.randrange(20, 256)) for _ in range(4))
    plant = [f"ann.{rng.randrange(99)}@mail{rng.randrange(9)}.example.com", ip, card, " ".join(card[i : i + 4] for i in range(0, 16, 4)), f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}", "300.1.2.3", card[:-1] + str((int(card[-1]) + 1) % 10)]
    out = rng.choices(words, k=rng.randrange(30))
    for x in rng.choices(plant, k=rng.randrange(3)):
        out.insert(rng.randrange(len(out) + 1), x)
    return " ".join(out)


def test_base_by_hand_on_mixed_characters():
    rng = random.Random(2)
    for alphabet in ("aZ@.-_ %9", "0129.-+() ", "19 -", "a@b.c@d.e", "+1.(2) -é"):
        for _ in range(1500):
            t = "".join(rng.choices(alphabet, k=rng.randrange(1, 40)))
            good, _ = personal.base_and_failed(t)
            assert [(personal.KINDS[k], s, e) for k, s, e in sorted(good)] == sorted(base_by_hand(t), key=lambda x: (personal.KINDS.index(x[0]), x[1])), t
            spans = personal.candidates(t)
            for k, s, e, base in spans:
                assert base or all(e <= a or b <= s for _, a, b, other in spans if (a, b, other) != (s, e, base))


def test_query_by_hand(spark, tmp_path):
    rng = random.Random(4)
    texts = [sentences(rng) for _ in range(400)] + [None, "", " ", "x@y.z", "1.2.3.4.5.6.7.8", "é😀 a@b.co +49 30 123456-78"]
    texts += texts[:20]
    path = str(tmp_path)
    spark.createDataFrame([(i, t, "h", 1.0) for i, t in enumerate(texts)], "doc_id long, text string, spans string, `a.b` double").repartition(4).write.parquet(f"{path}/documents.parquet")
    rows = {r.doc_id: r for r in personal.op11_personal(spark, path).collect()}
    assert len(rows) == len(texts)

    # The method by plain loops over all rows.
    found = [(i, c, personal.votes(t or "", *c), personal.features(t or "", *c[:3])) for i, t in enumerate(texts) for c in personal.candidates(t or "")]
    posterior = {}
    for kind in range(4):
        rows_ = [(tuple(x + 1 for x in v), c[3]) for _, c, v, _ in found if c[0] == kind]
        for (v, base), p in zip(rows_, loops(rows_), strict=True):
            posterior[kind, base, v] = p
    drawn = sorted((c[0], c[3], code(v), f) for _, c, v, f in found)
    p = np.array([posterior[k, b, tuple(personal.unpack_votes(v))] for k, b, v, _ in drawn])
    weights = personal.train([f for *_, f in drawn], p, np.ones(len(drawn)))
    want = {i: [] for i in range(len(texts))}
    for i, c, _, f in found:
        if c[3] or 1 / (1 + np.exp(-weights[f].sum())) >= personal.ADD_AT:
            want[i].append(c)
    for i, t in enumerate(texts):
        base = base_by_hand(t)
        written = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert rows[i].base_sha256 == hashlib.sha256(written(base).encode()).hexdigest(), t
        assert [rows[i][f"n_{k}"] for k in personal.KINDS] == [sum(b[0] == k for b in base) for k in personal.KINDS]
        assert rows[i].spans == written([(personal.KINDS[k], s, e) for k, s, e, _ in want[i]])


def code(v):
    out = 0
    for x in v:
        out = 3 * out + x + 1
    return out


def loops(rows):
    """Posterior of each row (votes, base), row by row."""
    if not rows:
        return []
    n, trust = len(rows[0][0]), [(1 - personal.TRUST) / 2, 0.5, personal.TRUST / 2]

    def normal(t):
        for j in range(n):
            t[j] = [[x / sum(c) for x in c] for c in t[j]]
        bad = t[0][1][0]
        if bad > personal.FAILED_CHECK:
            t[0][1] = [personal.FAILED_CHECK] + [x * (1 - personal.FAILED_CHECK) / (1 - bad) for x in t[0][1][1:]]
        return t

    table, prior = normal([[trust[::-1], list(trust)] for _ in range(n)]), 0.5
    for i in range(personal.ROUNDS + 1):
        p = []
        for r, base in rows:
            a, b = prior, 1 - prior
            for j, v in enumerate(r):
                a, b = a * table[j][1][v], b * table[j][0][v]
            p.append(max(a / (a + b), personal.BASE_LEAST if base else 0))
        if i == personal.ROUNDS:
            return p
        table = [[[personal.TRUST_SPANS * x for x in trust[::-1]], [personal.TRUST_SPANS * x for x in trust]] for _ in range(n)]
        for (r, _), q in zip(rows, p, strict=True):
            for j, v in enumerate(r):
                table[j][1][v] += q
                table[j][0][v] += 1 - q
        table, prior = normal(table), (1 + sum(p)) / (2 + len(p))


def test_reliabilities_are_found():
    rng = np.random.default_rng(1)
    y = rng.random(20_000) < 0.3
    right = np.array([0.95, 0.9, 0.8, 0.75, 0.6, 0.9, 0.7])
    votes = np.where(rng.random((len(y), 7)) < right, y[:, None], ~y[:, None]) * 2
    votes[rng.random(votes.shape) < 0.2] = 1
    seen = Counter(map(tuple, votes.tolist()))
    r = personal.estimate(np.array(list(seen)), np.array(list(seen.values()), float), np.zeros(len(seen)))
    assert abs(r.prior - 0.3) < 0.02
    for j, share in list(enumerate(right))[1:]:
        assert abs(r.table[j, 1, 2] / (r.table[j, 1, 0] + r.table[j, 1, 2]) - share) < 0.03
    assert np.mean((r.posterior(votes) > 0.5) == y) > 0.96


def test_spelled_out_spans_are_added_and_decoys_are_not(spark):
    rng = random.Random(9)
    texts = [sentences(rng) for _ in range(500)]
    added = ["mail to jane.roe (at) example (dot) org today", "contact jane [at] example [dot] com please", "server 83[.]229[.]25[.]126 is down", "phone (212) 555-0187 after six", "call 415-555-0132 now"]
    decoys = ["look at it. The end", "on 2023-11-05 and 1999-2004", "ratio 12:30:45", "version 4.10.2 of part 1234567", "4111 1111 1111 1112 fails", "at 300.400.500.600", "isbn 978-3-16-148410-0", "f(0x12) = 44 12"]
    for i in range(60):
        texts += [a.replace("jane", f"jane{i}").replace("83[", f"{30 + i}[").replace("555-01", f"555-{10 + i}") for a in added[: 5 if i % 3 == 0 else 0]]
        texts += [d.replace("1112", f"11{10 + i}") if i % 10 != 7 else d for d in decoys]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    out = {r.doc_id: [s for s in r.spans if not s.base] for r in personal.find_personal_data(df).collect()}
    spelled = re.compile(r"\[at\]|\(at\)|\[\.\]|\(212\)|415-")
    hit = [bool(out[i]) for i, t in enumerate(texts) if spelled.search(t)]
    wrong = [(texts[i], s) for i, own in out.items() for s in own if not spelled.search(texts[i]) and not (s.kind == "card" and personal._card(texts[i][s.start : s.end]) or re.search(r"\([0-9]{3}\) 555-[0-9]{4}", texts[i][s.start : s.end]))]  # with a number behind it, it still is one
    assert sum(hit) >= 0.8 * len(hit) and not wrong, (sum(hit), len(hit), wrong[:3])


def test_long_runs_take_linear_time(spark):
    n = 1_000_000
    began = time.time()
    for t in ("a" * n, "a." * (n // 2) + "@", "1" * n, "1.1.1." * (n // 6), "1-" * (n // 2), "+1" + "(" * n, "+" * n, "@" * n, "a@" * (n // 2), ":" * n, "f:" * (n // 2), "[at]" * (n // 4), " at a" * (n // 5), "(1" * (n // 2), "0000 " * (n // 5), "a@" + "b." * (n // 2)):
        for c in personal.candidates(t):
            personal.votes(t, *c), personal.features(t, *c[:3])
    assert time.time() - began < 60
    assert personal.find_personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0
