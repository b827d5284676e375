"""Packing: the plan on histograms, and whole runs against the tokenizer and brute-force checks."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from oppengine.llm.packing import CAPACITY, cut, encoder, op1_pack, pack_documents, plan_packing, sequences

PATH = public_tokenizers.path("byte_bpe_50k.json")


def placed(lengths, capacity):
    """(length, sequence, offset) of every piece by the plan."""
    out = []
    for l, r, n, s, o in plan_packing(Counter(lengths), capacity):
        out += [(l, r + i, s + i, o) for i in range(n)]
    return out


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_gapless_and_complete(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 30, 100, 2048])
    lengths = [rng.randint(1, rng.choice([capacity, max(1, capacity // 4)])) for _ in range(rng.randint(0, 300))]
    rows = placed(lengths, capacity)
    assert Counter(r[0] for r in rows) == Counter(lengths)
    assert len({r[:2] for r in rows}) == len(rows)
    by = defaultdict(list)
    for l, _, s, o in rows:
        by[s].append((o, l))
    for parts in by.values():
        at = 0
        for o, l in sorted(parts):
            assert o == at
            at += l
        assert at <= capacity
        assert sum(3 * l > capacity for _, l in parts) <= 2
    assert sorted(by) == list(range(len(by)))


@pytest.mark.parametrize("seed", range(10))
def test_plan_is_no_worse_than_best_fit_decreasing(seed):
    rng = random.Random(100 + seed)
    lengths = [min(100, int(rng.lognormvariate(3, 1)) + 1) for _ in range(400)]
    gaps = []
    for l in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= l]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - l)
        else:
            gaps.append(100 - l)
    assert len({r[2] for r in placed(lengths, 100)}) <= len(gaps) + 1


def test_plan_rejects_impossible_lengths():
    with pytest.raises(ValueError):
        plan_packing({101: 1}, 100)


def test_cut():
    assert cut(1, 4) == [(0, 1)] and cut(4, 4) == [(0, 4)] and cut(5, 4) == [(0, 1), (1, 4)] and cut(12, 4) == [(0, 4), (4, 4), (8, 4)]


TEXTS = ["", "a", "Hello,  world!\n\n it's 12³ ½x", "<|endoftext|> in text", "日本語 テキスト", "é è x y\x1cz", "emoji 👩‍👩‍👧 ok", "_under_score__ a_b", "tabs\t\tand\r\n\r\nlines ", "ªº²ⅷ ٣٤"]


def test_encoder_equals_tokenizer():
    t, enc = Tokenizer.from_file(PATH), encoder(PATH)
    for x in TEXTS:
        assert np.frombuffer(enc.encode(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x


def check(rows, docs, tokenizer):
    """Every document's ids are cut and placed whole."""
    want = []
    for d, x in docs:
        ids = tokenizer.encode(x or "", add_special_tokens=False).ids + [0]
        want += [(d, i, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for i, (s, n) in enumerate(cut(len(ids), CAPACITY))]
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= CAPACITY
    return len(by)


def test_edge_rows(spark):
    docs = [(1, None), (2, ""), (3, "x " * 5000), (None, "no id"), (4, "same"), (4, "same"), *((10 + i, t) for i, t in enumerate(TEXTS))]
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in docs], "doc_id long, text string, length string, chunk int").repartition(3)
    check(pack_documents(df, PATH).collect(), docs, Tokenizer.from_file(PATH))


def test_empty_table(spark):
    out = pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() == 0


def test_query(spark, sf_dir):
    rows = op1_pack(spark, sf_dir).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    n = check(rows, docs, Tokenizer.from_file(PATH))
    assert n <= -(-sum(r.length for r in rows) // CAPACITY) * 1.02 + 1


def test_sequences_hold_the_ids(spark):
    df = spark.createDataFrame([(i, "word " * (300 * i)) for i in range(9)], "doc_id long, text string")
    placed_rows = pack_documents(df, PATH)
    t = Tokenizer.from_file(PATH)
    for s in sequences(df, placed_rows, PATH).collect():
        assert len(s.ids) <= CAPACITY and set(s.ids) <= {0, *t.encode("word word ", add_special_tokens=False).ids}


@pytest.mark.parametrize("seed", range(20))
def test_small_pieces_are_best_fit_one_by_one(seed):
    """Few lengths, many of each: small pieces take as many sequences as placing them one by one, longest first, in the smallest gap."""
    rng = random.Random(200 + seed)
    capacity = rng.choice([60, 100, 2048])
    kinds = [rng.randint(1, capacity if k < 2 else max(1, capacity // 3)) for k in range(6)]
    lengths = [rng.choice(kinds) for _ in range(600)]
    large, gaps = Counter(l for l in lengths if 3 * l > capacity), []
    while large:
        a = max(large)
        large[a] -= 1
        large += Counter()
        b = max((l for l in large if l <= capacity - a), default=0)
        large -= Counter([b] if b else [])
        gaps.append(capacity - a - b)
    for l in sorted((l for l in lengths if 3 * l <= capacity), reverse=True):
        fit = min((g for g in gaps if g >= l), default=None)
        if fit is None:
            fit = capacity
        else:
            gaps.remove(fit)
        gaps.append(fit - l)
    assert len({r[2] for r in placed(lengths, capacity)}) <= len(gaps)
