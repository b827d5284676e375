"""Exact n-gram Jaccard self-join in metric space (operator 9).

Sets of hashed word shingles under the Jaccard distance d = 1 - |A n B| / |A u B|, which is a metric. Documents whose
sets are equal are one class; classes link at similarity of at least ``percent`` / 100.

1. Loners. A linked document shares at least t of its shingles, so one with more than a share 1 - t of shingles that
   no other class has links with nothing. Counting them in a fixed part of the hash space (1.75 (1 - t) of it) is
   enough to find nearly all of them, and can only count too few.
2. Regions. Pivots drawn from a large corpus are at distance 1, or nearly, from almost every document, so their
   Voronoi cells alone separate nothing (README has the measured share). The first cells are therefore those of the
   slice metrics: the shingle space is cut in m slices; |A d B| is the sum of the differences within slices, and a
   linked pair of sizes a, b has |A d B| <= (a + b) (100 - p) / (100 + p) = r. With m = r + 1 + z slices the pair has
   at least z + 1 slices in which it is equal (distance 0). A document has m cells, one a slice; in one order of all
   cells, rarest first, it enters its first r + 1: of z + 1 cells that a linked pair has in common, the first in that
   order is among the first r + 1 of both. So no link is lost, and common passages, whose cells are frequent, hardly
   join what is not alike. The pivot of a cell is its smallest class; connected cells are one region.
3. Regions that are too large for a task are cut again by another family of slices (recursion); of what remains large
   a few members are compared with all others, and only those that this leaves apart are joined block by block.
4. Within a region: sample pivots, nearest-pivot Voronoi cells, windows by the triangle inequality (a document also
   enters the cell of pivot p if d(x, p) - d(x, nearest) <= 2 (1 - t)), recursively, down to small cells that are
   compared exactly by a product of incidence matrices. Shingles of one document only are dropped first; documents
   with more than a share 1 - t of them have no partner at all.

Links leave a task as spanning forests only. Shingles are compared as 64-bit hashes: the links are exact unless two
different shingles of one comparison share a hash, which for all 5e12 pairs of a million shingles has a chance of 3e-7.
Defined cases: null and empty texts have the empty set and link with
nothing; repeated rows share a class; rows with a null id take part and get the smallest id they reach, or null.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import beside, components, read_table, spanning_edges, stage, texts, unstage

WORDS, PERCENT = 4, 85
#: Bytes of shingle hashes, and documents, in one block of a large region.
BLOCK_BYTES, BLOCK_ROWS = 16 << 20, 1024
#: Members of a large region that are compared with all others first, and large regions whose sizes are sent to all tasks.
PIVOTS, SENT_REGIONS = 16, 100_000
#: Documents of a cell that are compared directly, and floats of one incidence matrix.
CELL, TILE_FLOATS = 512, 4 << 20
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles: A-Z lower-cased, words between ASCII white space."""
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else ()
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    if len(h) < words:
        s = np.array([len(h)], np.uint64)
        for x in h:
            s = s * _M3 + x
        return mix(s)
    s = h[: len(h) - words + 1].copy()
    for i in range(1, words):
        s = s * _M3 + h[i : len(h) - words + 1 + i]
    return np.unique(mix(s))


@lru_cache(maxsize=64)
def size_groups(percent: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Upper sizes of the groups, and (slices m, cells to enter r + 1) for pairs whose smaller set is in a group.

    A set of a group has partners as large or larger only in the same or the next group.
    """
    upper, params, low = [], [], 1
    while not upper or upper[-1] < most:
        high = max(low, low * 100 // percent)
        r = (high + high * 100 // percent) * (100 - percent) // (100 + percent)
        params.append((r + 1 + (r + 3) // 4 + (2 if r > 2 else 0), r + 1))
        upper.append(high)
        low = high + 1
    return np.array(upper), np.array(params)


def signatures(h: np.ndarray, percent: int = PERCENT, seed: int = 0) -> list[tuple[int, int, int, np.ndarray]]:
    """For either size group that the set ``h`` (sorted) takes part in: cells it has to enter, slices, filled slices, and
    64-bit names of the cells of filled slices, followed by those of empty ones if it has to enter some of them."""
    n = len(h)
    if not n:
        return []
    upper, params = size_groups(percent, 1 << max(10, (n - 1).bit_length() + 1))
    g = int(np.searchsorted(upper, n))
    if seed:
        h = np.sort(mix(h + np.uint64(seed * int(_M3) & ((1 << 64) - 1))))
    inner = mix(h ^ _M2)
    out = []
    for joint in (g, g - 1):
        if joint < 0:
            continue
        m, enter = (int(x) for x in params[joint])
        slot = ((h >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        at, sums = slot[starts], np.add.reduceat(inner, starts)
        salt = np.uint64(((joint << 8) + seed + 1) * int(_M1) & ((1 << 64) - 1))
        filled = len(at)
        if filled < enter:
            at = np.concatenate([at, np.setdiff1d(np.arange(m, dtype=np.uint64), at)])
            sums = np.concatenate([sums, np.zeros(m - filled, np.uint64)])
        out.append((enter, m, filled, mix(mix(sums) + at * _M3 + salt)))
    return out


def class_key(h: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(h.tobytes())
    return (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63)


def _prepared(docs: DataFrame) -> DataFrame:
    """(id, doc_id, rid, text): id is doc_id, or for null ids a hash of the text; rid is a hash of the text."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.select(F.coalesce("doc_id", F.xxhash64(F.lit("no id"), "text")).alias("id"), "doc_id", F.xxhash64("text").alias("rid"), "text")


def sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """One row a document: id, doc_id, rid, n, k1, k2 (its class) and, once a class and task, its shingles in a part of the hash space."""
    out = pa.schema([("id", pa.int64()), ("doc_id", pa.int64()), ("rid", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("some", pa.list_(pa.int64()))])
    below = np.uint64(min(1.0, 1.75 * (1 - percent / 100)) * (1 << 20))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in batches:
            t = texts(b)
            for at in range(0, len(t), 1000):
                n, k1, k2, some, ends = [], [], [], [], [0]
                for text in t[at : at + 1000]:
                    h = shingles(text, words)
                    key = class_key(h)
                    part = h[:0] if key in seen else h[(h & np.uint64((1 << 20) - 1)) < below]
                    seen.add(key)
                    n.append(len(h))
                    k1.append(key[0])
                    k2.append(key[1])
                    some.append(part)
                    ends.append(ends[-1] + len(part))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(some).view(np.int64)))
                m = len(n)
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(at, m) for i in range(3)), pa.array(n), pa.array(k1), pa.array(k2), lists], schema=out)

    return docs.mapInArrow(run, "id long, doc_id long, rid long, n long, k1 long, k2 long, some array<long>")


def private_shingles(full: DataFrame) -> DataFrame:
    """(k1, own): how many of a class's counted shingles no other class has; ``full`` is from ``sets``."""
    pairs = full.where(F.size("some") > 0).select(F.explode("some").alias("h"), "k1")
    alone = pairs.groupBy("h").agg(F.min("k1").alias("k1"), F.max("k1").alias("other")).where("k1 = other")
    return alone.groupBy("k1").agg(F.count("*").alias("own"))


def cell_stars(cells: DataFrame) -> DataFrame:
    """Edges (a, b) from every member of a cell to the cell's pivot, its smallest member; ``cells`` is (cell, k)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int] | None = None
        known: set[tuple[int, int]] = set()
        for b in batches:
            c, k = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if not len(c):
                continue
            new = np.concatenate([[True], c[1:] != c[:-1]])
            start = np.maximum.accumulate(np.where(new, np.arange(len(c)), 0))
            pivot = k[start]
            if last is not None and c[0] == last[0]:
                pivot[start == 0] = last[1]
            last = (int(c[-1]), int(pivot[-1]))
            keep = pivot != k
            if keep.any():
                pairs = np.unique(np.stack([k[keep], pivot[keep]], 1), axis=0)
                fresh = [p for p in map(tuple, pairs.tolist()) if p not in known]
                known.update(fresh)
                if len(known) > 500_000:
                    known.clear()
                if fresh:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*fresh, strict=True)], schema=schema)

    dealt = cells.repartition("cell").sortWithinPartitions("cell", "k")
    return dealt.select("cell", "k").mapInArrow(run, "a long, b long").distinct()


def cells_of(rows: DataFrame, percent: int, seed: int) -> DataFrame:
    """(cell, k) of one family of slices for ``rows`` (region, id, h); cells of different regions never meet.

    Only cells with two members or more, and of those the rarest that each document has to enter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells, own = [np.zeros(0, np.uint64)], []
            for region, i, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for joint, (enter, m, filled, names) in enumerate(signatures(np.frombuffer(raw, np.uint64), percent, seed)):
                    cells.append(mix(names ^ np.uint64(region & ((1 << 64) - 1))))
                    own.append((i, joint, enter, filled, m, 0, filled))
                    if len(names) > filled:
                        own.append((i, joint, enter, filled, m, 1, m - filled))
            ids, *small, times = (np.array(x, np.int64) for x in (zip(*own, strict=True) if own else [()] * 7))
            cols = [pa.array(np.concatenate(cells).view(np.int64)), pa.array(np.repeat(ids, times)), *(pa.array(np.repeat(x, times).astype(np.int32)) for x in small)]
            yield pa.RecordBatch.from_arrays(cols, names=["cell", "k", "joint", "enter", "filled", "slices", "empty"])

    ddl = "cell long, k long, joint int, enter int, filled int, slices int, empty int"
    every = rows.select("region", "id", "h").mapInArrow(run, ddl)
    counted = every.withColumn("size", F.count("*").over(Window.partitionBy("cell"))).where("size > 1")
    # The order of all cells: filled ones first, rarest first. Cells without another member are left out of the rows,
    # but count in the order.
    mine = Window.partitionBy("k", "joint")
    shared_empty = F.sum("empty").over(mine)
    alone = F.col("filled") - (F.count("*").over(mine) - shared_empty)
    alone = alone + F.when(F.col("empty") == 1, F.col("slices") - F.col("filled") - shared_empty).otherwise(0)
    nth = F.row_number().over(mine.orderBy("empty", "size", "cell"))
    return counted.withColumn("nth", nth + alone).where("nth <= enter").select("cell", "k")


def regions_of(rows: DataFrame, percent: int, seed: int) -> DataFrame:
    """(region, id, h): ``rows`` (region, id, h; stable) parted into the connected cells of a family; rows alone in all their cells go."""
    stars = stage(cell_stars(cells_of(rows, percent, seed)), "jaccard-stars")
    region = components(stars).select(F.col("node").alias("id"), F.col("component").alias("new"))
    return rows.select("id", "h").join(region, "id").select(F.col("new").alias("region"), "id", "h")


def _incidence(codes: list[np.ndarray], width: int) -> np.ndarray:
    m = np.zeros((len(codes), width), np.float32)
    m[np.repeat(np.arange(len(codes)), [len(c) for c in codes]), np.concatenate(codes)] = 1
    return m


class Region:
    """Exact links among the documents of one block of a region."""

    def __init__(self, hashes: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> None:
        self.percent, self.side = percent, side
        self.n = np.array([len(h) for h in hashes], np.int64)
        value, code, count = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        ends = np.cumsum(self.n)
        shared = count > 1
        self.codes = [c[shared[c]] for c in np.split(code, ends[:-1])]
        left = np.array([len(c) for c in self.codes])
        self.alive = np.flatnonzero(100 * left >= percent * self.n)  # others hold too many shingles of their own
        number = np.cumsum(shared) - 1
        self.codes = [number[c] for c in self.codes]
        self.width = int(shared.sum())
        self.a, self.b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def compare(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Sizes of intersections, over the shingles that ``x`` has."""
        used = np.unique(np.concatenate([self.codes[i] for i in x]))
        narrow = np.full(self.width, -1)
        narrow[used] = np.arange(len(used))
        cut = [c[c >= 0] for c in (narrow[self.codes[i]] for i in y)]
        return _incidence([narrow[self.codes[i]] for i in x], len(used)) @ _incidence(cut, len(used)).T

    def direct(self, at: np.ndarray) -> None:
        wide = max(1, max(len(self.codes[i]) for i in at))
        step = max(1, min(CELL, TILE_FLOATS // max(1, min(self.width, 8 * wide))))
        at = at[np.argsort(self.n[at], kind="stable")]
        for i in range(0, len(at), step):
            x = at[i : i + step]
            for j in range(i, len(at), step):
                y = at[j : j + step]
                if self.percent * self.n[y[0]] > 100 * self.n[x[-1]]:
                    break  # larger sets only from here on
                both = self.compare(x, y).astype(np.int64)  # counts below 2 ** 24, so exact
                union = self.n[x][:, None] + self.n[y][None, :] - both
                p, q = np.nonzero(100 * both >= self.percent * union)
                self.add(x[p], y[q])

    def add(self, p: np.ndarray, q: np.ndarray) -> None:
        ok = p != q
        if ok.any():
            a, b = spanning_edges(np.append(self.a[-1], p[ok]), np.append(self.b[-1], q[ok]))
            self.a, self.b = [a], [b]

    def between(self, x: np.ndarray, y: np.ndarray) -> None:
        """Links of documents of ``x`` with documents of ``y``, in tiles of documents of like size."""
        x, y = (at[np.argsort(self.n[at], kind="stable")] for at in (x, y))
        wide = max(1, max(len(self.codes[i]) for i in np.concatenate([x, y])))
        step = max(1, min(CELL, TILE_FLOATS // max(1, min(self.width, 8 * wide))))
        for i in range(0, len(x), step):
            own = x[i : i + step]
            low, high = -(-self.percent * self.n[own[0]] // 100), self.n[own[-1]] * 100 // self.percent
            for j in range(*np.searchsorted(self.n[y], [low, high + 1]), step):
                other = y[j : j + step]
                both = self.compare(own, other).astype(np.int64)
                p, q = np.nonzero(100 * both >= self.percent * (self.n[own][:, None] + self.n[other][None, :] - both))
                self.add(own[p], other[q])

    def join(self, at: np.ndarray, depth: int = 0) -> None:
        """Voronoi cells of pivots, windows by the triangle inequality, recursion; small cells directly."""
        if len(at) < 2:
            return
        if len(at) <= CELL or depth >= 8:
            return self.direct(at)
        pivots = at[np.linspace(0, len(at) - 1, 8).astype(int)]
        d = np.empty((len(at), len(pivots)))
        for i in range(0, len(at), CELL):
            both = self.compare(pivots, at[i : i + CELL])
            union = self.n[pivots][:, None] + self.n[at[i : i + CELL]][None, :] - both
            d[i : i + CELL] = (1 - both / union).T
        near = d.min(1)
        window = 2 * (1 - self.percent / 100) + 1e-9
        regions = [at[d[:, j] - near <= window] for j in range(len(pivots))]
        if sum(len(r) ** 2 for r in regions) >= 0.7 * len(at) ** 2:
            return self.direct(at)  # the windows take in nearly all: cells would only repeat work
        for r in regions:
            if len(r) < len(at):
                self.join(r, depth + 1)
            else:
                self.direct(r)
        return None

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        if self.side is not None:
            x, y = (self.alive[self.side[self.alive] == k] for k in (0, 1))
            if len(x) and len(y):
                self.between(x, y)
        elif len(self.alive) > 1:
            self.join(self.alive)
        return self.a[-1], self.b[-1]


def _links(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Spanning links (a, b) within each group of ``keys``; a group whose rows have a ``side`` links between its sides only."""

    def run(table):
        ids = table.column("id").to_numpy()
        side = table.column("side").to_numpy(zero_copy_only=False) if table.column("side").null_count == 0 else None
        a, b = Region([np.frombuffer(x, np.uint64) for x in table.column("h").to_pylist()], percent, side).links()
        return pa.table({"a": pa.array(ids[a], pa.int64()), "b": pa.array(ids[b], pa.int64())})

    return rows.select(*keys, "id", "h", "side").groupBy(*keys).applyInArrow(run, "a long, b long")


def region_links(rows: DataFrame, percent: int, block_bytes: int = BLOCK_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Spanning links (a, b) of ids within regions; ``rows`` is (region, id, h binary) and stable.

    A region of more than ``block_bytes`` or ``block_rows`` documents is settled first: a few of its members are compared
    with all others, and those that this joins in the region's largest component need no more comparing with each
    other. What is left is compared with itself and with the settled ones, a pair of blocks a task. So near copies of
    one text cost a few passes over them; only members far from every pivot are paired among themselves.
    """
    none = F.lit(None).cast("int").alias("side")
    sizes = rows.groupBy("region").agg(F.sum(F.length("h")).alias("bytes"), F.count("*").alias("g"))
    count = lambda size, g: F.greatest(F.ceil(size / F.lit(block_bytes)), F.ceil(g / F.lit(block_rows))).cast("int")
    large = stage(sizes.select("region", count(F.col("bytes"), F.col("g")).alias("nb")).where("nb > 1"), "jaccard-large-sizes")
    n_large = large.count()
    if not n_large:
        unstage(large)
        return _links(rows.select("region", "id", "h", none), ["region"], percent)
    sent = F.broadcast(large) if n_large <= SENT_REGIONS else large.hint("merge")  # 12 bytes each
    small = _links(rows.join(sent, "region", "left_anti").select("region", "id", "h", none), ["region"], percent)
    big = rows.join(sent, "region")
    own = lambda nb: F.pmod(F.xxhash64("id"), nb).cast("int")
    each = lambda nb: F.explode(F.sequence(F.lit(0), nb - 1))

    first = F.row_number().over(Window.partitionBy("region").orderBy(F.xxhash64(F.lit("pivot"), "id"), "id"))
    pivots = stage(big.withColumn("nth", first).where(F.col("nth") <= PIVOTS).drop("nth"), "jaccard-pivots")
    both = pivots.select("region", each(F.col("nb")).alias("i"), "id", "h", F.lit(0).alias("side")).unionByName(big.select("region", own(F.col("nb")).alias("i"), "id", "h", F.lit(1).alias("side")))
    stars = stage(_links(both, ["region", "i"], percent), "jaccard-settling")
    part = components(stars).select(F.col("node").alias("id"), "component")
    named = stage(big.drop("nb").join(part, "id", "left"), "jaccard-settled")
    main = named.where("component is not null").groupBy("region", "component").agg(F.count("*").alias("g")).groupBy("region").agg(F.max_by("component", "g").alias("main"))
    main = stage(main, "jaccard-main")
    main_sent = F.broadcast(main) if n_large <= SENT_REGIONS else main.hint("merge")  # a row a large region, too
    told = named.join(main_sent, "region", "left").select("region", "id", "h", F.coalesce(F.col("component") == F.col("main"), F.lit(False)).alias("settled"))
    is_rest = (~F.col("settled")).cast("long")
    left = told.groupBy("region").agg(F.sum(is_rest).alias("r"), F.sum(1 - is_rest).alias("s"), F.sum(is_rest * F.length("h")).alias("rb"), F.sum((1 - is_rest) * F.length("h")).alias("sb")).where("r > 0")
    left = stage(left.select("region", count(F.col("rb"), F.col("r")).alias("rest_blocks"), count(F.col("sb"), F.col("s")).alias("settled_blocks")), "jaccard-blocks")
    left_sent = F.broadcast(left) if n_large <= SENT_REGIONS else left.hint("merge")
    dealt = told.join(left_sent, "region")
    rest = dealt.where("not settled").withColumn("own", own(F.col("rest_blocks")))
    within = rest.select("region", "own", each(F.col("rest_blocks")).alias("other"), "id", "h")
    within = within.select("region", F.lit("rest").alias("with"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "h", F.when(F.col("own") != F.col("other"), (F.col("own") < F.col("other")).cast("int")).alias("side"))
    # With a block itself, documents have no side: in these groups all do not.
    across = rest.where("settled_blocks > 0").select("region", F.lit("settled").alias("with"), F.col("own").alias("i"), each(F.col("settled_blocks")).alias("j"), "id", "h", F.lit(0).alias("side"))
    there = dealt.where("settled").withColumn("own", own(F.col("settled_blocks")))
    there = there.select("region", F.lit("settled").alias("with"), each(F.col("rest_blocks")).alias("i"), F.col("own").alias("j"), "id", "h", F.lit(1).alias("side"))
    paired = _links(within.unionByName(across).unionByName(there), ["region", "with", "i", "j"], percent)
    return small.unionByName(stars).unionByName(paired)


def _free(spark) -> None:
    """Let Spark delete the shuffle files of frames that are gone."""
    gc.collect()
    spark._jvm.System.gc()


def similar_documents(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_shingles, component_id, rid, group), a row for each row of ``docs`` (doc_id, text; others are ignored).

    ``rid`` is xxhash64 of the text; ``group`` (a long) is equal for the rows of a component, and null for empty sets.
    """
    spark = docs.sparkSession
    d = _prepared(docs)
    full = stage(sets(d, words, percent), "jaccard-sets")
    rows = stage(full.select("id", "doc_id", "rid", "n", "k1", "k2"), "jaccard-rows")
    own = stage(private_shingles(full), "jaccard-private")
    unstage(full)
    del full
    _free(spark)
    classes = rows.where("n > 0").groupBy("k1", "k2").agg(F.min("id").alias("id"), F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("n").alias("n"))
    # A class is named by its smallest id; classes of different texts that bear one id get names of their own.
    shared = F.count("*").over(Window.partitionBy("id")) > 1
    classes = stage(classes.withColumn("node", F.when(shared, F.xxhash64("k1", "k2")).otherwise(F.col("id"))), "jaccard-classes")
    social = classes.join(own, "k1", "left").where(100 * (F.col("n") - F.coalesce("own", F.lit(0))) >= percent * F.col("n"))
    member = stage(social.select("id", "node", "k1", "k2"), "jaccard-members")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            nodes, k1, k2 = (b.column(i).to_pylist() for i in range(3))
            keep = []
            for i, text in enumerate(texts(b)):
                if nodes[i] not in seen and class_key(h := shingles(text, words)) == (k1[i], k2[i]):  # another text may bear the same id
                    seen.add(nodes[i])
                    keep.append((0, nodes[i], h.tobytes()))
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*keep, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["region", "id", "h"])

    # Members grow with the corpus: sort-merge at every size, never a broadcast.
    with_text = member.hint("merge").join(d.select("id", "text"), "id").select("node", "k1", "k2", "text")
    held = stage(with_text.mapInArrow(hashes, "region long, id long, h binary"), "jaccard-social")
    _free(spark)
    nxt = stage(regions_of(held, percent, 0), "jaccard-regions")
    unstage(held, own)
    held = nxt
    _free(spark)
    for seed in (1, 2):  # regions too large for one task are cut again by another family of slices
        large = held.groupBy("region").agg(F.sum(F.length("h")).alias("bytes")).where(F.col("bytes") > block_bytes).select("region")
        large = stage(large, "jaccard-large")
        if large.isEmpty():
            unstage(large)
            break
        rest = stage(held.join(large, "region", "left_semi"), "jaccard-large-regions")
        nxt = stage(held.join(large, "region", "left_anti").unionByName(regions_of(rest, percent, seed)), "jaccard-regions")
        unstage(held, large, rest)
        held = nxt
        _free(spark)
    links = stage(region_links(held, percent, block_bytes), "jaccard-links")
    unstage(held)
    _free(spark)
    reach = components(links)
    joined = classes.join(reach.select("node", F.col("component").alias("c")), "node", "left")
    joined = stage(joined.where("copies > 1 or c is not null or node <> id").select("k1", "k2", "doc_id", F.coalesce("c", "node").alias("c")), "jaccard-grouped")
    low = joined.groupBy("c").agg(F.min("doc_id").alias("low"))
    found = stage(joined.join(low, "c").select("k1", "k2", "low", "c"), "jaccard-found")
    unstage(reach, links, member, joined)
    out = rows.join(found, ["k1", "k2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("low", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"), "rid", F.when(F.col("n") > 0, F.coalesce("c", "id")).alias("group"))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component: the smallest doc_id (null ids last), then the smallest text hash.

    Rows with the empty set all stay, but for rows that repeat id and text.
    """
    found = similar_documents(docs, words, percent)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid")
    first = found.where("`group` is not null").groupBy("group").agg(F.min(order).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    first = stage(first.select("group", "first"), "jaccard-first")
    gone = found.join(first, "group").where(order != F.col("first")).select("doc_id", "rid")
    gone = stage(gone.distinct(), "jaccard-gone")
    own = beside(docs, docs.columns, docs["doc_id"].cast("long").alias("own_id"), F.xxhash64(docs["text"].cast("string")).alias("own_rid"))
    kept = own.join(gone.hint("merge"), F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_rid") == F.col("rid")), "left_anti")
    if not found.groupBy("doc_id", "rid").count().where("count > 1").isEmpty():  # rows that repeat id and text
        kept = kept.dropDuplicates(["own_id", "own_rid"])
    return kept.select("_keep.*")


def op9_jaccard(spark, sf_dir: str) -> DataFrame:
    return similar_documents(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
