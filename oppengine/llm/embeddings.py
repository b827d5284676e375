"""Near-duplicate embeddings by hierarchical navigable small-world graphs (operator 10).

Equal vectors are one class, so copies cost nothing. Classes are dealt to shards by hash, as many as the bytes of the
vectors need; a task builds one graph per shard (batched insertion, diversified neighbours, sampled upper layers) and
writes it as one row with its vectors. All vectors query every shard: graphs and vectors of those rows meet in a cross
product, whose tasks read both sides from the shared folder, so neither is copied or shuffled for it; a task holds one
graph at a time and takes the queries batch by batch. A query whose whole beam lies above the threshold searches again with a beam twice as wide; and in every
batch an audit compares a sample of queries with brute force and doubles the beam of all until its recall
passes, both over all pairs and averaged over queries with a neighbour, without hits of vectors on themselves (a beam
as wide as the shard is brute force, so it ends). As a sample may have no pair at all, every graph is first asked for
neighbours that are known: a sample of its vectors, each turned by a random direction until its cosine is just above the
threshold, has to find them. The least recall of these audits is returned beside the links. Found pairs are verified by cosine in double
precision. Links leave a task as counts and spanning forests, never as all pairs.

Defined cases: vectors that are null, empty or zero, or hold null, NaN or infinite components, link with nothing;
vectors of different lengths never link; repeated rows are copies of one class; null ids take part and get the
smallest id that they reach, or null.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import components, read_table, spanning_edges, stage, unstage

COSINE = 0.9
#: Shards: as many as ``LEAST_SHARDS``, or more so that none has more than ``SHARD_ROWS`` vectors.
#: Nor more bytes of components. BLOCK_ROWS queries make a batch, which has an audit of its own; a task compares
#: QUERY_CELLS pairs of vectors at most before it counts the links. Up to TASKS shards, TASKS tasks ask them all.
LEAST_SHARDS, SHARD_ROWS, BLOCK_ROWS = 8, 40_000, 20_000
SHARD_BYTES, QUERY_CELLS, TASKS = 96 << 20, 16 << 20, 10_000
NEIGHBOURS, BUILD_BEAM, BEAM = 16, 40, 24
AUDIT_QUERIES, AUDIT_RECALL = 200, 0.99
#: Planted neighbours have a cosine that much above the threshold.
PLANTED_ABOVE = 0.005
#: Graphs of a megabyte and more are row groups of their own, so that a reader holds one at a time.
GRAPH_FILES = {"parquet.block.size": 1 << 20, "parquet.page.size.row.check.min": 1, "parquet.enable.dictionary": False}
_SLACK = 1e-4  # single-precision searches keep candidates this far below the threshold for the exact check


class Graph:
    """One layered graph over unit vectors ``x`` (n, d), single precision."""

    def __init__(self, x: np.ndarray, seed: int = 0) -> None:
        self.x = x
        n = len(x)
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(1 - rng.random(n)) / np.log(NEIGHBOURS)).astype(int), 6)
        order = np.argsort(-level, kind="stable")
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []  # from the top: members, neighbours (-1: none) by node
        self.top = order[: max(1, min(n, 32))]
        for l in range(int(level.max()) if n else 0, -1, -1):
            members = order[: int((level >= l).sum())]
            if len(members) > 32 or l == 0:
                self.layers.append(self._build(members))

    @classmethod
    def unpacked(cls, x: np.ndarray, packed: bytes | pa.Buffer) -> Graph:
        """The graph over ``x`` that ``packed`` was made of."""
        g = cls.__new__(cls)
        g.x, g.layers = x, []
        g.top, layers = pickle.loads(packed)
        for members, near in layers:
            adj = np.full((len(x), 2 * NEIGHBOURS), -1, np.int32)
            adj[members] = near
            g.layers.append(adj)
        return g

    def packed(self) -> bytes:
        """Layers without the rows of nodes that have no neighbours in them; ``x`` is kept elsewhere."""
        layers = [(np.flatnonzero((adj >= 0).any(1)).astype(np.int32), adj) for adj in self.layers]
        return pickle.dumps((self.top, [(members, adj[members]) for members, adj in layers]), protocol=5)

    def _build(self, members: np.ndarray) -> np.ndarray:
        n, x = len(self.x), self.x
        adj = np.full((n, 2 * NEIGHBOURS), -1, np.int32)
        start = min(len(members), 64)
        s = x[members[:start]] @ x[members[:start]].T
        np.fill_diagonal(s, -2)
        self._link(adj, members[:start], np.tile(members[:start], (start, 1)), s)
        done = start
        while done < len(members):
            new = members[done : done + min(done, 1024)]
            near = self._descend(x[new], [*self.layers, adj], BUILD_BEAM, members[: min(done, 32)])
            s = x[new] @ x[new].T
            np.fill_diagonal(s, -2)
            k = min(BUILD_BEAM, len(new))
            own = np.argpartition(-s, k - 1, axis=1)[:, :k]
            ids = np.concatenate([near[0], new[own]], 1)
            self._link(adj, new, ids, np.concatenate([near[1], np.take_along_axis(s, own, 1)], 1))
            done += len(new)
        return adj

    def _select(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of candidates by row: nearest first those nearer to the node than to any taken one, then the nearest others."""
        k = min(ids.shape[1], 2 * most)
        if ids.shape[1] > k:
            part = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            ids, sims = np.take_along_axis(ids, part, 1), np.take_along_axis(sims, part, 1)
        order = np.argsort(-sims, axis=1)
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        out = np.full((len(ids), most), -1, np.int32)
        for a in range(0, len(ids), 2000):
            i, s = ids[a : a + 2000], sims[a : a + 2000]
            v = self.x[np.maximum(i, 0)]
            pair = v @ v.transpose(0, 2, 1)
            taken = np.zeros(i.shape, bool)
            blocked = np.full(i.shape, -2.0, np.float32)
            for c in range(k):
                ok = (s[:, c] > -1.5) & (s[:, c] > blocked[:, c]) & (taken.sum(1) < most)
                taken[ok, c] = True
                blocked = np.where(ok[:, None], np.maximum(blocked, pair[:, c]), blocked)
            rank = np.where(s > -1.5, np.where(taken, 0, 1), 2)
            best = np.argsort(rank, axis=1, kind="stable")[:, :most]
            got = np.where(np.take_along_axis(rank, best, 1) < 2, np.take_along_axis(i, best, 1), -1)
            out[a : a + 2000, : got.shape[1]] = got
        return out

    def _link(self, adj: np.ndarray, new: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        mine = self._select(ids, sims, NEIGHBOURS)
        adj[new, :NEIGHBOURS] = mine
        src, dst = np.repeat(new, NEIGHBOURS), mine.ravel()
        ok = dst >= 0
        src, dst = src[ok], dst[ok]
        s = np.einsum("ij,ij->i", self.x[src], self.x[dst])
        order = np.lexsort((-s, dst))
        src, dst, s = src[order], dst[order], s[order]
        first = np.flatnonzero(np.concatenate([[True], dst[1:] != dst[:-1]])) if len(dst) else np.zeros(0, int)
        rank = np.arange(len(dst)) - np.repeat(first, np.diff(np.append(first, len(dst))))
        keep = rank < 2 * NEIGHBOURS
        at = dst[first]
        row = np.searchsorted(at, dst[keep])
        cand = np.full((len(at), 4 * NEIGHBOURS), -1, np.int64)
        cs = np.full((len(at), 4 * NEIGHBOURS), -2, np.float32)
        cand[row, rank[keep]], cs[row, rank[keep]] = src[keep], s[keep]
        old = adj[at]
        cand[:, 2 * NEIGHBOURS :] = old
        for a in range(0, len(at), 4000):
            o = old[a : a + 4000]
            cs[a : a + 4000, 2 * NEIGHBOURS :] = np.where(o >= 0, np.einsum("ijk,ik->ij", self.x[np.maximum(o, 0)], self.x[at[a : a + 4000]]), -2)
        twice = (cand[:, :, None] == cand[:, None, :]) & (np.arange(cand.shape[1])[:, None] > np.arange(cand.shape[1])[None, :]) if len(at) <= 64 else None
        if twice is not None:
            cs[twice.any(2)] = -2
        else:
            srt = np.argsort(cand, axis=1, kind="stable")
            c2 = np.take_along_axis(cand, srt, 1)
            rep = np.concatenate([np.zeros((len(at), 1), bool), c2[:, 1:] == c2[:, :-1]], 1)
            back = np.zeros_like(rep)
            np.put_along_axis(back, srt, rep, 1)
            cs[back] = -2
        adj[at] = self._select(cand, cs, 2 * NEIGHBOURS)

    def _descend(self, q: np.ndarray, layers: list[np.ndarray], beam: int, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = q @ self.x[top].T
        k = min(4, len(top))
        ids = top[np.argpartition(-s, k - 1, axis=1)[:, :k]]
        for i, adj in enumerate(layers):
            ids, sims = self._beam(q, ids, adj, beam if i == len(layers) - 1 else 8)
        return ids, sims

    def _beam(self, q: np.ndarray, entry: np.ndarray, adj: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        out_i, out_s = [], []
        step = max(1, min(256, (16 << 20) // max(1, len(self.x))))
        for a in range(0, len(q), step):
            i, s = self._beam_block(q[a : a + step], entry[a : a + step], adj, beam)
            out_i.append(i)
            out_s.append(s)
        return np.concatenate(out_i), np.concatenate(out_s)

    def _beam_block(self, q: np.ndarray, entry: np.ndarray, adj: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        b, x = len(q), self.x
        entry = entry[:, : max(1, min(entry.shape[1], beam))]
        ids = np.full((b, beam), -1, np.int64)
        sims = np.full((b, beam), -2, np.float32)
        todo = np.zeros((b, beam), bool)
        seen = np.zeros((b, len(x) + 1), bool)  # the last column stands for "none"
        k = entry.shape[1]
        ids[:, :k] = entry
        sims[:, :k] = np.where(entry >= 0, np.einsum("bkd,bd->bk", x[np.maximum(entry, 0)], q), -2)
        todo[:, :k] = entry >= 0
        np.put_along_axis(seen, np.where(entry >= 0, entry, len(x)), True, 1)
        rows = np.arange(b)
        live = rows
        while len(live):
            best = np.argmax(np.where(todo[live], sims[live], -3), axis=1)
            has = todo[live, best]
            live, best = live[has], best[has]
            if not len(live):
                break
            todo[live, best] = False
            near = adj[ids[live, best]].astype(np.int64)
            near = np.where(near >= 0, near, len(x))
            at = live[:, None], near
            fresh = ~seen[at] & (near < len(x))  # not by whole rows of ``seen``, which are as long as the shard
            seen[at] = True
            s = np.where(fresh, np.einsum("bkd,bd->bk", x[np.where(fresh, near, 0)], q[live]), -2)
            all_i = np.concatenate([ids[live], near], 1)
            all_s = np.concatenate([sims[live], s], 1)
            all_t = np.concatenate([todo[live], fresh], 1)
            top = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
            ids[live] = np.take_along_axis(all_i, top, 1)
            sims[live] = np.take_along_axis(all_s, top, 1)
            todo[live] = np.take_along_axis(all_t, top, 1)
        ids[sims <= -1.5] = -1
        order = np.argsort(-sims, axis=1)
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def pairs_above(self, q: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query row, node) with similarity of at least ``least`` that beams find; full beams are widened."""
        n = len(self.x)
        todo, got_q, got_i = np.arange(len(q)), [], []
        while len(todo):
            if beam * 2 >= n:  # as wide as the shard: brute force, in blocks
                for a in range(0, len(todo), 512):
                    r, i = np.nonzero(q[todo[a : a + 512]] @ self.x.T >= least)
                    got_q.append(todo[a : a + 512][r])
                    got_i.append(i)
                break
            ids, sims = self._descend(q[todo], self.layers, beam, self.top)
            full = (ids[:, -1] >= 0) & (sims[:, -1] >= least)
            r, c = np.nonzero((sims >= least) & (ids >= 0) & ~full[:, None])
            got_q.append(todo[r])
            got_i.append(ids[r, c])
            todo, beam = todo[full], beam * 2
        return np.concatenate(got_q or [np.zeros(0, int)]), np.concatenate(got_i or [np.zeros(0, int)])


def audited_pairs(g: Graph, q: np.ndarray, least: float, beam: int = BEAM, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """``pairs_above`` with the beam of ``audited_beam``, and that beam."""
    beam = audited_beam(g, q, least, beam, own)
    return (*g.pairs_above(q, least, beam), beam)


def audited_beam(g: Graph, q: np.ndarray, least: float, beam: int = BEAM, own: np.ndarray | None = None) -> int:
    """The narrowest beam whose recall passes the audit against brute force.

    ``own`` has each query's own node in the graph (-1: none), which counts neither as there nor as found.
    """
    sample = np.unique(np.linspace(0, len(q) - 1, min(len(q), AUDIT_QUERIES)).astype(int))
    mine = np.full(len(sample), -1) if own is None else own[sample]
    truth = np.zeros(len(sample), int)
    for a in range(0, len(sample), 512):
        r, i = np.nonzero(q[sample[a : a + 512]] @ g.x.T >= least)
        truth[a : a + 512] = np.bincount(r[i != mine[a : a + 512][r]], minlength=len(sample[a : a + 512]))
    has = truth > 0
    while True:
        if has.any():
            r, i = g.pairs_above(q[sample], least, beam)
            found = np.minimum(np.bincount(r[i != mine[r]], minlength=len(sample)), truth)
            recall = min(found.sum() / truth.sum(), (found[has] / truth[has]).mean())
            if recall < AUDIT_RECALL and beam * 2 < len(g.x):
                beam *= 2
                continue
        return beam


def turned(x: np.ndarray, cosine: float, seed: int = 0) -> np.ndarray:
    """Unit vectors at that cosine to the rows of ``x``, each in a random direction."""
    noise = np.random.default_rng([seed, x.shape[1], 7919]).normal(size=x.shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-300)
    return (cosine * x + np.sqrt(max(0.0, 1 - cosine * cosine)) * noise).astype(np.float32)


def planted_beam(g: Graph, least: float, beam: int = BEAM) -> tuple[int, float]:
    """The narrowest beam that finds known neighbours just above ``least``, and the share that it finds."""
    n = len(g.x)
    if g.x.shape[1] < 2:  # no other direction
        return beam, 1.0
    own = np.unique(np.linspace(0, n - 1, min(n, AUDIT_QUERIES)).astype(int))
    q = turned(g.x[own].astype(np.float64), min(1.0, least + PLANTED_ABOVE))
    while True:
        r, i = g.pairs_above(q, least, beam)
        recall = float((own[r] == i).sum()) / len(own)
        if recall >= AUDIT_RECALL or beam * 2 >= n:
            return beam, recall
        beam *= 2


def _places(own: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where each of ``own`` is in ``keys`` (distinct), or -1."""
    order = np.argsort(keys)
    at = order[np.minimum(np.searchsorted(keys, own, sorter=order), len(keys) - 1)]
    return np.where(keys[at] == own, at, -1)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Each row in double precision, by the power of two that brings its largest component to 0.5 or more and under 1."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.sqrt((x * x).sum(1))
    return (x / norm[:, None]).astype(np.float32), norm


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, least_shards: int = LEAST_SHARDS, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept, recall) for every row of ``vectors`` (vec_id, embedding; other columns are ignored)."""
    # Components of single precision stay so wherever they are kept; they are computed with in double precision.
    of = vectors.schema["embedding"].dataType
    kind = "float32" if isinstance(of, ArrayType) and of.elementType == FloatType() else "float64"
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if kind == "float32" else "array<double>").alias("e"))
    fine = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0)
    v = v.withColumn("k", F.when(F.coalesce(F.col("e").isNotNull() & fine, F.lit(False)), F.xxhash64("e")))
    slim = v.select("vec_id", "k")
    classes = v.where("k is not null").groupBy("k").agg(F.first("e").alias("e"), F.count("*").alias("copies"), F.min("vec_id").alias("low"))
    classes = stage(classes.select("k", "e", "copies", "low", F.size("e").alias("dim")), "vector-classes")
    n, dim = classes.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(1))).first()
    shards = max(least_shards, -(-n // max(1, min(shard_rows, SHARD_BYTES // (8 * dim)))))
    dealt = classes.select("k", "e", "copies", "dim", F.pmod(F.xxhash64(F.lit("shard"), "k"), F.lit(shards)).cast("int").alias("shard"))

    def build(table):
        raw = _matrix(table.column("e"))
        unit, _ = _unit(_scaled(raw))
        g = Graph(unit, seed=int(table.column("shard")[0].as_py()))
        beam, recall = planted_beam(g, cosine - _SLACK)
        blobs = {"keys": table.column("k").to_numpy().tobytes(), "copies": table.column("copies").to_numpy().tobytes(), "x": raw.tobytes(), "graph": g.packed()}
        return pa.table({"dim": table.column("dim").slice(0, 1), "shard": table.column("shard").slice(0, 1), **{n: pa.array([b], pa.binary()) for n, b in blobs.items()}, "beam": pa.array([beam], pa.int32()), "recall": pa.array([recall])})

    # A task for each shard: hashed to tasks, some would build several graphs, one after the other.
    by_shard = dealt.repartitionById(shards, "shard").groupBy("dim", "shard")
    graphs = stage(by_shard.applyInArrow(build, "dim int, shard int, keys binary, copies binary, x binary, graph binary, beam int, recall double"), "graphs", **GRAPH_FILES)
    small = stage(classes.select("k", "copies", "low"), "vector-copies")
    unstage(classes)
    # The right side's rows are held by a task, as many as Spark reads in one partition; the left side's pass one by one.
    # The condition is no equality of columns, by which Spark would shuffle all rows of a length to one task.
    queries = graphs.select(F.col("dim").alias("of_dim"), F.col("keys").alias("own"), F.col("x").alias("y"))
    pairs = graphs.drop("recall").coalesce(max(1, TASKS // shards)).hint("shuffle_replicate_nl").join(queries, F.col("dim") - F.col("of_dim") == 0)
    out_schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def query(graph: Graph, norm: np.ndarray, x: np.ndarray, keys: np.ndarray, copies: np.ndarray, own: np.ndarray, y: np.ndarray, beam: int) -> tuple[pa.RecordBatch, int]:
        unit, ynorm = _unit(y)
        beam = audited_beam(graph, unit, cosine - _SLACK, beam, _places(own, keys))
        links, forest = np.zeros(len(y), np.int64), (own[:0], own[:0])
        step = max(64, QUERY_CELLS // len(x))
        for at in range(0, len(y), step):
            r, i = graph.pairs_above(unit[at : at + step], cosine - _SLACK, beam)
            r = r + at
            sure = np.zeros(len(r), bool)
            for a in range(0, len(r), 100_000):
                s = slice(a, a + 100_000)
                sure[s] = np.einsum("ij,ij->i", y[r[s]], x[i[s]]) / (ynorm[r[s]] * norm[i[s]]) >= cosine
            sure &= own[r] != keys[i]
            r, i = r[sure], i[sure]
            links += np.bincount(r, copies[i], len(y)).astype(np.int64)
            forest = spanning_edges(np.concatenate([forest[0], own[r]]), np.concatenate([forest[1], keys[i]]))
        has = np.flatnonzero(links)
        a, b = forest
        m, e = len(has), len(a)
        cols = [pa.array(np.concatenate([own[has], a])), pa.array([None] * m + b.tolist(), pa.int64()), pa.array(links[has].tolist() + [None] * e, pa.int64())]
        return pa.RecordBatch.from_arrays(cols, schema=out_schema), beam

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, beam = None, BEAM
        for batch in batches:
            for at in range(batch.num_rows):
                of = {n: batch.column(n)[at] for n in batch.schema.names}
                dim, name = of["dim"].as_py(), (of["dim"].as_py(), of["shard"].as_py())
                numbers = lambda n, t=np.int64, of=of: np.frombuffer(of[n].as_buffer(), t)
                if held is None or held[0] != name:
                    held = None  # the last graph goes before the next one comes
                    x = _scaled(numbers("x", kind).reshape(-1, dim))
                    unit, norm = _unit(x)
                    held, beam = (name, (Graph.unpacked(unit, of["graph"].as_buffer()), norm, x, numbers("keys").copy(), numbers("copies").copy())), of["beam"].as_py()
                own, y = numbers("own"), numbers("y", kind).reshape(-1, dim)
                for a in range(0, len(own), block_rows):
                    out, beam = query(*held[1], own[a : a + block_rows], _scaled(y[a : a + block_rows]), beam)
                    yield out

    found = stage(pairs.mapInArrow(run, "a long, b long, links long"), "vector-links")
    recall = graphs.agg(F.coalesce(F.min("recall"), F.lit(1.0))).first()[0]
    unstage(graphs)
    counts = found.where("links is not null").groupBy(F.col("a").alias("k")).agg(F.sum("links").alias("links"))
    reach = components(found.where("b is not null").select("a", "b"))
    c = small.join(counts, "k", "left").join(reach.select(F.col("node").alias("k"), F.col("component").alias("c")), "k", "left")
    c = stage(c.select("k", "low", F.coalesce("c", "k").alias("c"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "vector-found")
    least = c.groupBy("c").agg(F.min("low").alias("component_id"))
    c = stage(c.join(least, "c").select("k", "n_links", "component_id"), "vector-components")
    out = slim.join(c, "k", "left")
    component = F.when(F.col("k").isNull(), F.col("vec_id")).otherwise(F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"), F.lit(recall).alias("recall"))


def op10_embeddings(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))
