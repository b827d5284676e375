"""Components, the Jaccard join and embeddings against brute force."""

import itertools
import random
import re

import numpy as np
import pytest

from oppengine.llm.common import components
from oppengine.llm import embeddings
from oppengine.llm.embeddings import Graph, _places, audited_pairs, near_duplicates, op10_embeddings
from oppengine.llm.jaccard import Region, one_of_each, op9_jaccard, shingles, signatures, similar_documents, size_groups


def groups(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("finish", [10**6, 0, 40])
def test_components(spark, finish):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(120)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(180)] + [(5000, x) for x in range(4000, 4200)] + [(7, 7)]
    want = groups({n for e in edges if e[0] != e[1] for n in e}, edges)
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long").repartition(5)
    assert {r.node: r.component for r in components(df, finish_edges=finish).collect()} == want
    assert components(df.limit(0)).count() == 0


def text_set(t, words=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    return set() if not w else {tuple(w)} if len(w) < words else {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}


def by_hand(docs, words=4, percent=85):
    sets = [text_set(t, words) for _, t in docs]
    links = [(i, j) for i, j in itertools.combinations(range(len(docs)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    at = groups(range(len(docs)), links)
    low = {}
    for i, c in at.items():
        if docs[i][0] is not None:
            low[c] = min(low.get(c, docs[i][0]), docs[i][0])
    return sorted(((d, len(sets[i]), low.get(at[i])) for i, (d, _) in enumerate(docs)), key=repr)


def near_texts(seed, n=160):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    passage = [word() for _ in range(30)]
    out = []
    while len(out) < n:
        base = [word() for _ in range(rng.choice([2, 5, 9, 20, 60, 200]))]
        if rng.random() < 0.3:
            base[len(base) // 2 : len(base) // 2] = passage
        for _ in range(rng.choice([1, 1, 2, 6, 12])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                w[rng.randrange(len(w))] = word()
            if rng.random() < 0.2:
                w += [word() for _ in range(rng.randint(1, 6))]
            out.append(" ".join(x.upper() if rng.random() < 0.05 else x for x in w))
    return list(enumerate(out))


@pytest.mark.parametrize("seed", [1, 2])
def test_join_equals_brute_force(spark, seed):
    docs = near_texts(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in similar_documents(df).collect()), key=repr)
    assert got == by_hand(docs)


def test_blocks_and_recursion_equal_brute_force(spark):
    docs = near_texts(3)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in similar_documents(df, words=5, percent=80, block_bytes=4000).collect()), key=repr)
    assert got == by_hand(docs, 5, 80)


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, " \n\x0b"), (4, "one"), (5, "ONE"), (6, "one two three"), (7, "one\ntwo\tthree"), (None, "one two three"), (None, "alone here"), (8, "x y " * 4000), (9, "x y " * 4001), (10, "same text of words here"), (10, "same text of words here"), (10, "another text of more words"), (11, "Écouter ÉCOUTER a b c"), (12, "écouter écouter a b c")]
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in docs], "doc_id long, text string, n string, k1 int").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in similar_documents(df).collect()), key=repr)
    assert got == by_hand(docs)
    assert similar_documents(df.limit(0)).count() == 0
    kept = one_of_each(df, 4, 85)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(1, None), (2, ""), (3, " \n\x0b"), (4, "one"), (6, "one two three"), (8, "x y " * 4000), (10, "same text of words here"), (10, "another text of more words"), (11, "Écouter ÉCOUTER a b c"), (12, "écouter écouter a b c"), (None, "alone here")], key=repr)


@pytest.mark.parametrize("percent", [80, 85])
def test_every_linked_pair_shares_a_cell(percent):
    rng = np.random.default_rng(percent)
    for _ in range(600):
        n = int(rng.choice([1, 2, 6, 7, 13, 40, 200, 900]))
        a = np.unique(rng.integers(0, 2**64 - 1, n, dtype=np.uint64))
        drop = int(rng.integers(0, n // 5 + 2))
        b = np.unique(np.concatenate([a[rng.permutation(n)[drop:]], rng.integers(0, 2**64 - 1, int(rng.integers(0, n // 6 + 2)), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= percent * (len(a) + len(b) - both):
            for seed in (0, 1):
                x, y = signatures(a, percent, seed), signatures(b, percent, seed)
                assert any(p[:2] == q[:2] and meets(p, q, order) for p in x for q in y for order in (1, -1))
                assert all(meets(p, q, order) for p in x for q in y if p[:2] == q[:2] for order in (1, -1)) or len(x) > 1


def meets(p, q, order):
    """Do the first cells that either has to enter, in an order of all cells with the filled ones first, meet?"""
    (enter, _, fp, a), (_, _, fq, b) = p, q
    first = lambda names, filled: {int(v) for v in [*sorted(names[:filled], key=lambda v: order * int(v)), *sorted(names[filled:], key=lambda v: order * int(v))][:enter]}
    return bool(first(a, fp) & first(b, fq))


def test_size_groups_hold_all_partners():
    upper, _ = size_groups(85, 5000)
    for a in range(1, 4000):
        g, h = np.searchsorted(upper, a), np.searchsorted(upper, a * 100 // 85)
        assert h - g <= 1


def test_region_pivots_and_direct_agree():
    rng = np.random.default_rng(0)
    base = [rng.integers(0, 2**63, 60, dtype=np.uint64) for _ in range(60)]
    sets = [np.unique(np.concatenate([b[rng.random(60) > 0.05], rng.integers(0, 2**63, 2, dtype=np.uint64)])) for b in base for _ in range(20)]
    want = groups(range(len(sets)), [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if i // 20 == j // 20 and 100 * (n := len(np.intersect1d(sets[i], sets[j]))) >= 85 * (len(sets[i]) + len(sets[j]) - n)])
    a, b = Region(sets, 85).links()
    assert groups(range(len(sets)), list(zip(a.tolist(), b.tolist(), strict=True))) == want


def test_shingles():
    assert len(shingles(None)) == len(shingles(" ")) == 0 and len(shingles("a b c")) == 1 and len(shingles("a b c d e")) == 2
    assert (shingles("A B") == shingles("a  b")).all() and shingles("a b")[0] != shingles("b a")[0]


def test_query_equals_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in op9_jaccard(spark, sf_dir).collect()), key=repr) == by_hand(docs)


# --- embeddings
def vectors_by_hand(rows):
    x = [None if v is None or any(c is None or not np.isfinite(c) for c in v) or not any(v) else np.array(v, float) for _, v in rows]
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if x[i] is not None and x[j] is not None and len(x[i]) == len(x[j]) and x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]) >= 0.9]
    at, n = groups(range(len(rows)), links), np.bincount(np.array(links, int).ravel(), minlength=len(rows))
    low = {}
    for i, c in at.items():
        if rows[i][0] is not None:
            low[c] = min(low.get(c, rows[i][0]), rows[i][0])
    return sorted(((d, int(n[i]), low.get(at[i])) for i, (d, _) in enumerate(rows)), key=repr)


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + rng.normal(size=16) * rng.choice([0.05, 0.15, 1.0])).tolist()) for i in range(900)]
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] + [1.0] * 15), (1003, [float("inf")] + [1.0] * 15), (1004, [None] + [1.0] * 15), (1005, []), (1006, [1.0, 2.0]), (1007, [2.0, 4.0]), (1008, rows[3][1]), (1009, rows[3][1]), (None, rows[3][1])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, k string").repartition(3)
    got = near_duplicates(df, least_shards=3, block_rows=400)
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got.collect()), key=repr) == vectors_by_hand(rows)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got.collect())
    assert near_duplicates(df.limit(0)).count() == 0


def test_graph_recall():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    x[1500:] = x[:1500] + 0.2 * rng.normal(size=(1500, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    r, i = Graph(x).pairs_above(x, 0.9, 24)
    assert len(r) >= 0.95 * (x @ x.T >= 0.9).sum()


def test_vector_query_recall(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in op10_embeddings(spark, d).collect()), key=repr) == vectors_by_hand(rows)


class Misses:
    """A graph whose beams find a large group, but only wide ones find the pairs, and every vector finds itself."""

    def __init__(self, x):
        self.x = x

    def pairs_above(self, q, least, beam):
        s = q @ self.x.T
        r, i = np.nonzero(s >= least)
        keep = (i < 2000) | (s[r, i] > 0.99998) | (beam >= 96)
        return r[keep], i[keep]


def test_audit_counts_small_groups_and_no_self_hits():
    rng = np.random.default_rng(0)
    hot = rng.normal(size=32) + 0.01 * rng.normal(size=(2000, 32))
    single = rng.normal(size=(180, 32))
    x = np.concatenate([hot, single, single + 0.02 * rng.normal(size=(180, 32))])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    q, own = x[1980:2180], np.arange(1980, 2180)
    r, i, beam = audited_pairs(Misses(x), q, 0.9, own=own)
    assert beam == 96 and {(a, a + 2160) for a in range(20, 200)} <= set(zip(r.tolist(), i.tolist(), strict=True))
    # self hits alone are no recall: 180 vectors with one neighbour each, which is missed
    assert audited_pairs(Misses(x), q[20:], 0.9, own=own[20:])[2] == 96
    assert _places(np.array([5, 7, 9]), np.array([9, 1, 5])).tolist() == [2, -1, 0]


def test_vectors_of_any_scale(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(10, 8))
    rows = [(i, (centres[i % 10] + 0.1 * rng.normal(size=8)).tolist()) for i in range(80)]
    want = vectors_by_hand(rows)
    assert any(n for _, n, _ in want)
    scale = [2.0**-1000, 2.0**-560, 1.0, 2.0**560, 2.0**1020]
    df = spark.createDataFrame([(i, [c * scale[i % 5] for c in v]) for i, v in rows], "vec_id long, embedding array<double>")
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in near_duplicates(df, least_shards=2).collect()), key=repr) == want


def test_queries_stream_in_small_batches(spark, monkeypatch):
    """Results don't depend on streams, batches or the pairs that are held at once; shards follow the bytes."""
    from oppengine.llm import embeddings

    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 12))
    x = np.concatenate([base + 0.05 * rng.standard_normal(base.shape) for _ in range(12)])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, [1.0, float(i), 0.5]) for i in range(5)] + [(2000, [0.0, 0.0]), (2001, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    unit = [np.array(v) / np.linalg.norm(v) if v and any(v) else None for _, v in rows]
    links = [sum(j != i and u is not None and w is not None and len(u) == len(w) and float(u @ w) >= 0.9 for j, w in enumerate(unit)) for i, u in enumerate(unit)]
    monkeypatch.setattr(embeddings, "SHARD_BYTES", 96 * 30)
    monkeypatch.setattr(embeddings, "QUERY_CELLS", 2000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        got = {r.vec_id: r for r in near_duplicates(df, block_rows=100).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [got[i].n_links for i, _ in rows] == links
    assert all(got[i].kept == (got[i].component_id == i) for i, _ in rows)


def test_one_of_each_with_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, 1, 2, "a"), (2, text + " more", 1, 2, "b"), (2, text + " more", 1, 2, "b"), (3, "quite another text of a few words", None, None, None), (None, text, 5, 6, "c"), (4, None, 1, 1, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _d long, _r long, _keep string")
    clash = df.withColumn("rid", df["_d"]).withColumn("own_id", df["_r"]).withColumn("group", df["_d"])
    got = one_of_each(clash, 5, 80)
    assert got.columns == clash.columns
    assert sorted((r.doc_id, r._d, r._r, r._keep, r.rid) for r in got.collect()) == [(1, 1, 2, "a", 1), (3, None, None, None, None), (4, 1, 1, "d", 1)]


def test_large_regions_are_settled_by_pivots(spark):
    """Near copies of one text, a chain of texts that drift away from it, and another cluster in one region; against brute force."""
    from pyspark.sql import functions as F

    from oppengine.llm.jaccard import region_links

    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 80, dtype=np.uint64)
    fresh = lambda k: rng.integers(0, 2**63, k, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(80) > 0.04], fresh(1)])) for _ in range(60)]
    chain = base.copy()
    for _ in range(25):
        chain = np.concatenate([chain[4:], fresh(4)])
        sets.append(np.unique(chain))
    sets += [np.unique(np.concatenate([sets[-1][20:], fresh(20)])) for _ in range(15)]
    other = fresh(50)
    sets += [np.unique(np.append(other, fresh(2))) for _ in range(20)]
    rows = [(7 if i < 118 else 8, i, bytearray(s.tobytes())) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "region long, id long, h binary")
    link = lambda i, j: 100 * (n := len(np.intersect1d(sets[i], sets[j]))) >= 85 * (len(sets[i]) + len(sets[j]) - n)
    want = groups(range(len(sets)), [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if (i < 118) == (j < 118) and link(i, j)])
    for block in (10, 40, 1000):
        got = [(r.a, r.b) for r in region_links(df, 85, block_rows=block).collect()]
        assert groups(range(len(sets)), got) == want
    assert len(set(want.values())) > 2 and region_links(df.where(F.lit(False)), 85).count() == 0


def test_rare_pairs_over_many_shards_and_their_recall(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = embeddings.turned(x[:12], 0.92, seed=1)
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, near.astype(float)]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = near_duplicates(df, least_shards=16, block_rows=500).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted(vectors_by_hand(rows))
    assert {r.vec_id for r in got if r.n_links} == {*range(12), *range(3000, 3012)} and {r.recall for r in got} <= {got[0].recall} and got[0].recall >= 0.99


def test_known_neighbours_are_asked_for_where_a_sample_has_none():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2600, 32))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    q = embeddings.turned(x[:50].astype(float), 0.905)
    assert np.allclose((q * x[:50]).sum(1), 0.905, atol=1e-5) and np.allclose(np.linalg.norm(q, axis=1), 1, atol=1e-5)
    assert embeddings.audited_beam(Misses(x), x[2000:2100], 0.9, 24, np.arange(2000, 2100)) == 24  # no pair, so nothing was measured
    beam, recall = embeddings.planted_beam(Misses(x), 0.9)
    assert beam == 96 and recall >= 0.99
    assert embeddings.planted_beam(Graph(x), 0.9)[1] >= 0.99
    assert embeddings.planted_beam(Graph(x[:1]), 0.9)[1] == 1.0


def test_graphs_and_queries_meet_without_copies_of_either(spark, monkeypatch):
    """A graph was copied for each stream of queries, all of them held at once, and each query for every shard."""
    plans, real = {}, embeddings.stage

    def noted(df, name, **options):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, name, **options)

    monkeypatch.setattr(embeddings, "stage", noted)
    monkeypatch.setattr(embeddings, "TASKS", 8, raising=False)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 16))
    scale = [2.0**-130, 2.0**-60, 1.0, 2.0**60, 2.0**120]
    x = [(centres[i % 30] + 0.15 * rng.normal(size=16)) * scale[i % 5] for i in range(300)] + [rng.normal(size=5) for _ in range(20)]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = near_duplicates(df, least_shards=4, block_rows=20).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted(vectors_by_hand(rows)) and any(r.n_links for r in got)
    assert "Generate" not in plans["vector-links"] and "Exchange" not in plans["vector-links"] and "Coalesce 2" in plans["vector-links"]
    assert plans["graphs"].count("Exchange") == 1


def test_packed_graphs_are_the_same():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1500, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for n in (1, 40, 1500):
        g = Graph(x[:n])
        h = Graph.unpacked(x[:n], g.packed())
        assert len(h.layers) == len(g.layers) and (h.top == g.top).all() and all((a == b).all() and a.dtype == b.dtype for a, b in zip(g.layers, h.layers, strict=True))
