"""Phrase collocations from position bitmaps of words (operator 12).

A task cuts its texts into words and collects them by language in shards of about ``SHARD_WORDS`` words; pieces follow
each other with an empty place between them, so no phrase passes from one to the next. Words are counted in each shard
and summed over the shards; an infrequent word is part of no frequent phrase. Of neighbours, hashed buckets of pairs
and of triples are summed in the same way (Park, Chen and Yu): what falls into a bucket that stays below the threshold
is infrequent, too. What remains at a place is one window: the longest phrase from there whose pairs and triples all
may be frequent. Equal windows are summed in each task and sent to the class of their first three words, pairs to a
class of their own, so every phrase is counted in one class, whole: shards send no counts of phrases, and only frequent
phrases leave a class. A class lays its distinct windows one after the other, a window once for each binary digit of its
number, and builds a bitmap of places for each of its words (8-place blocks, empty ones left out). It gets the pairs
as the AND of one word's bitmap with the next one's, shifted, and extends them depth-first: a phrase's bitmap is ANDed with the
shifted bitmaps of all pairs that begin with its last word, and popcounts, times the value of their digit, are exact
frequencies, which are held against the threshold.

No task sees more than its rows and one shard, or one class; a hot language only has more shards, and a common word,
pair or window is one row or entry a task in every shuffle, until a task has ``HELD`` windows and sends them. Tasks that sum
windows are as many as the cores, so their entries grow with the distinct windows, not with those times the shards; at
most they send one entry for each place with a window, and one for its pair. Only a bit for each bucket comes to the
driver and is broadcast. There is about a bucket for ``WORDS_A_BUCKET`` words, but 2 ** ``MOST_BUCKETS`` at most; in a
corpus that fills them all, they spare less work.

Defined cases: null text is empty, null lang is 'und'; texts without a word count nothing; repeated rows count each;
a text longer than a shard is a shard of its own; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import read_table, stage, unstage

#: Least frequency of a phrase, its most words, and the phrases listed of each language.
LEAST, MOST_WORDS, TOP = 100, 5, 2000
#: A longer phrase with so many percent of a phrase's frequency makes that one superfluous.
COVERED_PERCENT = 100
#: Words of a shard, and of all shards that a task has open.
SHARD_WORDS, OPEN_WORDS = 1_000_000, 2_000_000
#: Words for each hashed bucket, of pairs and again of triples; binary logarithm of the most buckets, and of those in one row.
WORDS_A_BUCKET, MOST_BUCKETS, BUCKETS_ROW = 4, 26, 16
#: Words of the corpus for each class of windows, the fewest classes, and the windows that a task holds before it sums or sends them.
CLASS_WORDS, LEAST_CLASSES, HELD = 1 << 22, 32, 1 << 19
#: Bitmap blocks that are extended together; windows that share bitmaps.
TOGETHER, WINDOWS_TOGETHER = 1 << 17, 1 << 16
#: A-Z become a-z, ends of pieces become a full stop, tabs become blanks; other bytes stay.
_FOLD = bytes(46 if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


class Numbers(dict):
    """A number for each word, in order of arrival; 0 is the place between pieces."""

    def __init__(self):
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def packed(numbers: np.ndarray) -> bytes:
    return len(numbers).to_bytes(8, "little") + pa.compress(numbers.astype(np.int32).tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], 4 * n, "zstd", asbytes=True), np.int32).astype(np.int64)


_SHARD = "lang string, words array<string>, counts array<long>, places binary"
_SLIM = "shard long, ids array<long>, places binary"
_SLIM_ARROW = pa.schema([("shard", pa.int64()), ("ids", pa.list_(pa.int64())), ("places", pa.binary())])
_SENT = "class long, windows binary, counts binary"


def _sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards of (text, lang): words by number, their counts, and the number at each place."""
    open_: dict[str, tuple[Numbers, array]] = {}

    def close(lang: str) -> pa.RecordBatch:
        numbers, places = open_.pop(lang)
        p = np.frombuffer(places, np.int32)
        counts = np.bincount(p, minlength=len(numbers))
        words = pa.array(list(numbers), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array([lang]), pa.ListArray.from_arrays([0, len(words)], words), pa.ListArray.from_arrays([0, len(words)], pa.array(counts)), pa.array([packed(p)], pa.binary())], names=["lang", "words", "counts", "places"])

    for b in batches:
        for text, lang in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist(), strict=True):
            words = text.translate(_FOLD).replace(b".", b" . ").split()
            numbers, places = open_.setdefault(lang, (Numbers(), array("i")))
            places.extend(map(numbers.__getitem__, words))
            places.append(0)
            if len(places) >= SHARD_WORDS:
                yield close(lang)
            elif sum(len(x[1]) for x in open_.values()) >= OPEN_WORDS:
                yield close(max(open_, key=lambda k: len(open_[k][1])))
    for lang in list(open_):
        yield close(lang)


def _frequent_words(shard: pa.Table, known: pa.Table) -> pa.Table:
    """The shard with frequent words only: their global ids, and places where runs of other words are one empty place."""
    at = known["at"].to_numpy()
    row = {c: shard[c][0].as_py() for c in ("shard", "words", "places")}
    to = np.zeros(row["words"], np.int64)
    to[at] = np.arange(1, len(at) + 1)
    p = to[unpacked(row["places"])]
    p = p[(p > 0) | np.concatenate([[True], p[:-1] > 0])] if len(p) else p
    ids = pa.array(np.concatenate([[0], known["id"].to_numpy()]).astype(np.int64))
    one = [pa.array([row["shard"]], pa.int64()), pa.ListArray.from_arrays([0, len(ids)], ids), pa.array([packed(p)], pa.binary())]
    return pa.Table.from_arrays(one, names=["shard", "ids", "places"])


def bucket(buckets: int, *ids: np.ndarray) -> np.ndarray:
    """The hashed bucket, of 2 ** buckets, of each row of global ids."""
    h = np.full(len(ids[0]), len(ids), np.uint64)
    for x in ids:
        h = (h ^ x.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - buckets)).astype(np.int64)


def _bucket_sums(least: int, buckets: int):
    """(kind, row, sums): for each task the sums of its buckets of pairs (0) and triples (1), none above ``least``."""
    of = np.uint8 if least < 256 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(1 << buckets, of) for _ in range(2)]
        for batch in batches:
            for i in range(batch.num_rows):
                p, ids = unpacked(batch.column(1)[i].as_py()), np.asarray(batch.column(0)[i].values)
                m = (p[:-1] > 0) & (p[1:] > 0)
                m3 = m[:-1] & m[1:]
                for k, h in enumerate((bucket(buckets, ids[p[:-1][m]], ids[p[1:][m]]), bucket(buckets, ids[p[:-2][m3]], ids[p[1:-1][m3]], ids[p[2:][m3]]))):
                    at, n = np.unique(h, return_counts=True)
                    sums[k][at] = np.minimum(sums[k][at] + n, least)
        yield from _bucket_rows(sums)

    return run


def _bucket_rows(sums: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for k, v in enumerate(sums):
        for r, row in enumerate(v.reshape(-1, 1 << BUCKETS_ROW)):
            if row.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([r], pa.int32()), pa.array([pa.compress(row.tobytes(), "zstd", asbytes=True)], pa.binary())], names=["kind", "row", "sums"])


def _heavy(least: int):
    """Rows of bits, one for each bucket whose sum over all tasks reaches ``least``; rows of the same buckets come to one task, one after the other."""
    of = np.dtype(np.uint8 if least < 256 else np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for k, r, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                row = np.frombuffer(pa.decompress(data, of.itemsize << BUCKETS_ROW, "zstd", asbytes=True), of)
                had = sums.get((k, r))
                sums[k, r] = row if had is None else np.minimum(had.astype(np.int64) + row, least).astype(of)
        for (k, r), row in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([r], pa.int32()), pa.array([np.packbits(row >= least).tobytes()], pa.binary())], names=["kind", "row", "sums"])

    return run


def heavy_buckets(slim: DataFrame, least: int, buckets: int) -> list[np.ndarray]:
    """Bits of the buckets of pairs and of triples that reach ``least``: twice 2 ** buckets bits."""
    kind = "kind int, row int, sums binary"
    rows = slim.select("ids", "places").mapInArrow(_bucket_sums(least, buckets), kind).repartition("kind", "row").mapInArrow(_heavy(least), kind).collect()
    out = [np.zeros(1 << (buckets - 3), np.uint8) for _ in range(2)]
    for r in rows:
        at = r["row"] << (BUCKETS_ROW - 3)
        out[r["kind"]][at : at + (1 << (BUCKETS_ROW - 3))] = np.frombuffer(r["sums"], np.uint8)
    return out


def among(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


class Bitmaps:
    """Bitmaps of places for many items: rows (item, block, bits) in order, without empty blocks, and a tag for each row."""

    def __init__(self, item: np.ndarray, block: np.ndarray, bits: np.ndarray, tag: np.ndarray, blocks: int):
        """Rows of equal item, tag and block are ORed together."""
        self.blocks = blocks
        order = np.lexsort((tag, block, item))
        item, block, bits, tag = item[order], block[order], bits[order], tag[order]
        new = np.ones(len(item), bool)
        new[1:] = (item[1:] != item[:-1]) | (block[1:] != block[:-1]) | (tag[1:] != tag[:-1])
        at = np.nonzero(new)[0]
        self.item, self.block, self.tag = item[at], block[at], tag[at]
        self.bits = np.bitwise_or.reduceat(bits, at) if len(at) else bits
        self.key = self.item * blocks + self.block

    @classmethod
    def of_places(cls, items: np.ndarray, places: np.ndarray, blocks: int) -> Bitmaps:
        return cls(items, (places >> 3) + 1, np.uint8(1) << (places & 7).astype(np.uint8), np.zeros(len(items), np.int64), blocks)

    def back(self, n: int) -> Bitmaps:
        """Every bit ``n`` places (under 8) before where it is; the first block stays free for that."""
        stay, carry = self.bits >> np.uint8(n), self.bits << np.uint8(8 - n)
        s, c = stay != 0, carry != 0
        return Bitmaps(np.concatenate([self.item[s], self.item[c]]), np.concatenate([self.block[s], self.block[c] - 1]), np.concatenate([stay[s], carry[c]]), np.concatenate([self.tag[s], self.tag[c]]), self.blocks)

    def all_pairs(self, other: Bitmaps) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """AND of every row with every row of ``other`` of the same block: (row here, row there, bits), without empty ones."""
        here, there = np.argsort(self.block, kind="stable"), np.argsort(other.block, kind="stable")
        ends = np.cumsum(np.bincount(other.block, minlength=self.blocks))
        block = self.block[here]
        i, j = spread(np.where(block > 0, ends[block - 1], 0), ends[block])
        i, j = here[i], there[j]
        both = self.bits[i] & other.bits[j]
        some = both != 0
        return i[some], j[some], both[some]

    def meet(self, item: np.ndarray, block: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """AND of given rows with all rows here of the same item and block: (given row, row here, bits), without empty ones."""
        key = item * self.blocks + block
        lo, hi = np.searchsorted(self.key, key), np.searchsorted(self.key, key, side="right")
        given, here = spread(lo, hi)
        both = bits[given] & self.bits[here]
        some = both != 0
        return given[some], here[some], both[some]


def spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) for every i and every j from lo[i] up to hi[i]."""
    n = hi - lo
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + lo[i]


def frequent_phrases(places: np.ndarray, a: np.ndarray, b: np.ndarray, most_words: int = MOST_WORDS, starts: np.ndarray | None = None, values: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(phrases as rows of numbers, frequencies): the pairs (a, b), and all longer phrases whose neighbours are such pairs.

    With ``starts``, only phrases that begin at these places count; a place counts as ``values`` has it for its 8-place block.
    """
    if not len(a):
        return
    used = np.zeros(max(int(places.max(initial=0)), int(max(a.max(), b.max()))) + 1, bool)
    used[a] = used[b] = True
    at = np.nonzero(used[places])[0]
    blocks = (len(places) >> 3) + 3
    word = Bitmaps.of_places(places[at], at, blocks)
    after = word.back(1)
    first, second, bits = word.all_pairs(after)  # the AND of all pairs of words, a block at a time
    u, v = word.item[first], after.item[second]
    some = np.isin(u * len(used) + v, a * len(used) + b)
    pairs = Bitmaps(u[some], word.block[first][some], bits[some], v[some], blocks)  # by first word; the second is the tag
    shifted = {n: pairs.back(n) for n in range(1, most_words - 1)}

    def extend(phrases: np.ndarray, of: np.ndarray, block: np.ndarray, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``phrases`` with their frequencies, and what they grow to; row i of the bitmap belongs to phrase of[i], in order."""
        ones = np.bitwise_count(bits).astype(np.int64)
        yield phrases, np.add.reduceat(ones if values is None else ones * values[block - 1], np.searchsorted(of, np.arange(len(phrases))))
        k = phrases.shape[1]
        if k == most_words:
            return
        next_ = shifted[k - 1]
        given, here, both = next_.meet(phrases[of, -1], block, bits)
        old, new = of[given], next_.tag[here]
        if not len(given):
            return
        order = np.lexsort((block[given], new, old))
        old, new, at, both = old[order], new[order], block[given][order], both[order]
        yield from in_groups(np.concatenate([[True], (old[1:] != old[:-1]) | (new[1:] != new[:-1])]), lambda i: np.column_stack([phrases[old[i]], new[i]]), at, both)

    def in_groups(first: np.ndarray, phrases_at, block: np.ndarray, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Depth first: some phrases whole, with all that they grow to, before the next ones."""
        starts = np.nonzero(first)[0]
        ends = np.append(starts[1:], len(first))
        s = 0
        while s < len(starts):
            e = max(s + 1, int(np.searchsorted(ends, starts[s] + TOGETHER, side="right")))
            rows = slice(starts[s], ends[e - 1])
            yield from extend(phrases_at(starts[s:e]), np.cumsum(first[rows]) - 1, block[rows], bits[rows])
            s = e

    order = np.lexsort((pairs.block, pairs.tag, pairs.item))
    u, v, block, bits = pairs.item[order], pairs.tag[order], pairs.block[order], pairs.bits[order]
    if starts is not None:
        first = np.zeros(blocks, np.uint8)
        np.bitwise_or.at(first, (starts >> 3) + 1, np.uint8(1) << (starts & 7).astype(np.uint8))
        bits = bits & first[block]
        u, v, block, bits = (x[bits > 0] for x in (u, v, block, bits))
    if len(u):
        yield from in_groups(np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])]), lambda i: np.column_stack([u[i], v[i]]), block, bits)


def summed(windows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal rows once, in order, with the sum of their counts."""
    order = np.lexsort(windows.T[::-1])
    windows = windows[order]
    at = np.nonzero(np.concatenate([[True], (windows[1:] != windows[:-1]).any(axis=1)]))[0] if len(windows) else order
    return windows[at], np.add.reduceat(counts[order], at) if len(at) else counts


def windows_of(p: np.ndarray, ids: np.ndarray, pairs, triples, most_words: int = MOST_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(windows as rows of ids, numbers) of places: all pairs, and the longest phrase of three words or more at each place.

    ``pairs`` and ``triples`` tell of ids which can be frequent. Shorter rows are filled up with -1.
    """
    q = np.concatenate([p, np.zeros(most_words, p.dtype)])
    at = lambda m, n: [q[np.nonzero(m)[0] + i] for i in range(n)]
    m2 = (q[:-1] > 0) & (q[1:] > 0)
    m2[m2] = pairs(*(ids[x] for x in at(m2, 2)))
    m3 = m2 & np.append(m2[1:], False)
    m3[m3] = triples(*(ids[x] for x in at(m3, 3)))
    a, b = at(m2, 2)
    key, n2 = np.unique(a * len(ids) + b, return_counts=True)
    two = np.full((len(key), most_words), -1, np.int64)
    two[:, 0], two[:, 1] = key // len(ids), key % len(ids)
    start = np.nonzero(m3)[0]
    long = np.full((len(start), most_words), -1, np.int64)
    goes_on = np.ones(len(start), bool)
    for k in range(most_words):
        if k > 2:
            goes_on &= m3[np.minimum(start + k - 2, len(m3) - 1)]
        long[goes_on, k] = q[start[goes_on] + k]
    long, n3 = summed(long, np.ones(len(long), np.int64))
    out = np.concatenate([two, long])
    return np.where(out < 0, -1, ids[out]), np.concatenate([n2, n3]).astype(np.int64)


class Held:
    """Windows and numbers, equal ones summed now and then."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = self.sum_at = 0

    def add(self, windows: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((windows, counts))
        self.size += len(windows)
        if self.size >= max(HELD, self.sum_at):
            self.sum()
            self.sum_at = 2 * self.size

    def sum(self) -> tuple[np.ndarray, np.ndarray]:
        self.parts = [summed(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))]
        self.size = len(self.parts[0][0])
        return self.parts[0]


def _windows(heavy, buckets: int, classes: int):
    """(class, windows, counts): what a task's shards have of each class, summed, in one row or, if much, in several."""

    def rows(held: Held) -> Iterator[pa.RecordBatch]:
        windows, counts = held.sum()
        of = bucket(32, windows[:, 0], windows[:, 1], windows[:, 2]) % classes
        order = np.argsort(of, kind="stable")
        ends = np.cumsum(np.bincount(of, minlength=classes))
        for k in np.unique(of):
            at = order[ends[k - 1] if k else 0 : ends[k]]
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), *(pa.array([len(at).to_bytes(8, "little") + pa.compress(x.tobytes(), "zstd", asbytes=True)], pa.binary()) for x in (windows[at].T, counts[at]))], names=["class", "windows", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        can = [lambda *x, bits=bits: among(bits, bucket(buckets, *x)) for bits in heavy.value]
        held = Held()
        for batch in batches:
            for ids, places in zip(*batch.columns, strict=True):
                held.add(*windows_of(unpacked(places.as_py()), np.asarray(ids.values), *can))
                if held.size >= HELD:
                    yield from rows(held)
                    held = Held()
        if held.size:
            yield from rows(held)

    return run


def as_many_tasks_as_cores(shards: DataFrame) -> DataFrame:
    """Each task sends sums of all that it has read; with a task for so many MB they would grow with tasks times what is summed."""
    return shards.coalesce(shards.sparkSession.sparkContext.defaultParallelism)


def laid(windows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, starts of windows, values of 8-place blocks): windows with empty places between, once for each binary digit 1 of their count."""
    rows = np.column_stack([windows, np.zeros(len(windows), np.int64)])
    words = (windows > 0).sum(axis=1)
    places, starts, values, n = [], [], [], 0
    for digit in range(int(counts.max(initial=0)).bit_length()):
        some = (counts >> digit) & 1 > 0
        ends = np.cumsum(words[some] + 1)
        size = -(-int(ends[-1]) // 8) * 8 if len(ends) else 0
        one = np.zeros(size, np.int64)
        one[: ends[-1] if len(ends) else 0] = rows[some][np.arange(rows.shape[1]) <= words[some][:, None]]
        places.append(one)
        starts.append(n + ends - words[some] - 1)
        values.append(np.full(size >> 3, 1 << digit, np.int64))
        n += size
    values.append(np.zeros(2, np.int64))
    return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in (places, starts, values))


def counted(windows: np.ndarray, counts: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(phrases as rows of ids, f) with f >= least of distinct windows in order: of two words those of pairs, of more those of the longer windows."""
    two = windows[:, 2] < 0
    for some, kind in ((two, "pairs"), (~two, "longer")):
        w, c = windows[some], counts[some]
        new = np.nonzero(np.concatenate([[True], (w[1:, :3] != w[:-1, :3]).any(axis=1)]))[0] if len(w) else []
        s = 0
        while s < len(w):  # windows with the same first words stay together
            past = new[np.searchsorted(new, s, side="right") :]
            e = int(max([*past[past <= s + WINDOWS_TOGETHER][-1:], *past[:1]], default=len(w))) if len(w) > s + WINDOWS_TOGETHER else len(w)
            ids, local = np.unique(w[s:e], return_inverse=True)
            ids, local = (ids[1:], local) if ids[0] < 0 else (ids, local + 1)
            places, starts, values = laid(local.reshape(w[s:e].shape), c[s:e])
            both = (places[:-1] > 0) & (places[1:] > 0)
            key = np.unique(places[:-1][both] * (len(ids) + 1) + places[1:][both])
            for own, f in frequent_phrases(places, key // (len(ids) + 1), key % (len(ids) + 1), 2 if kind == "pairs" else w.shape[1], starts, values):
                often = f >= least
                if often.any() and (own.shape[1] > 2 or kind == "pairs"):
                    yield ids[own[often] - 1], f[often]
            s = e


def _grown(least: int, most_words: int = MOST_WORDS):
    """(ids, f): the frequent phrases of two words or more of each class; rows of a class follow each other."""

    def rows(held: Held) -> Iterator[pa.RecordBatch]:
        for phrases, f in counted(*held.sum(), least):
            ids = pa.ListArray.from_arrays(np.arange(len(phrases) + 1, dtype=np.int32) * phrases.shape[1], pa.array(phrases.ravel()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(f, pa.int64())], names=["ids", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = Held(), None
        for batch in batches:
            for k, windows, counts in zip(*batch.columns, strict=True):
                if now is not None and k.as_py() != now:
                    yield from rows(held)
                    held = Held()
                now = k.as_py()
                n = int.from_bytes(counts.as_py()[:8], "little")
                data = [np.frombuffer(pa.decompress(x.as_py()[8:], 8 * n * m, "zstd", asbytes=True), np.int64) for x, m in ((windows, most_words), (counts, 1))]
                held.add(data[0].reshape(most_words, n).T, data[1])
        if held.parts:
            yield from rows(held)

    return run


def frequencies(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, f) of all phrases of up to ``MOST_WORDS`` words with f >= least, staged; (lang, n))."""
    read = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    shards = stage(read.mapInArrow(_sharded, _SHARD).withColumn("shard", F.monotonically_increasing_id()), "shards")
    own = shards.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w")).where("at > 0").select("shard", "lang", "at", F.col("w.words").alias("word"), F.col("w.counts").alias("c"))
    sizes = shards.select("lang", (F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x) - F.element_at("counts", 1)).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    sizes = stage(sizes, "words-of-languages")

    # One row a shard and word; the rows of a word get the id of one of them.
    w = Window.partitionBy("lang", "word")
    known = own.repartition("lang", "word").withColumn("row", F.monotonically_increasing_id())
    known = known.withColumn("f", F.sum("c").over(w)).withColumn("id", F.min("row").over(w)).where(F.col("f") >= least)
    known = stage(known.select("shard", "lang", "at", "word", "f", "id", (F.col("row") == F.col("id")).alias("one")), "frequent-words")
    slim = shards.select("shard", F.size("words").alias("words"), "places").groupBy("shard").cogroup(known.select("shard", "at", "id").groupBy("shard"))
    slim = stage(slim.applyInArrow(_if_both(_frequent_words, _SLIM_ARROW), _SLIM), "frequent-places")
    unstage(shards)

    n = sizes.agg(F.sum("n")).first()[0] or 0
    buckets = min(max(int(n // WORDS_A_BUCKET).bit_length(), BUCKETS_ROW), MOST_BUCKETS)
    heavy = docs.sparkSession.sparkContext.broadcast(heavy_buckets(slim, least, buckets))  # 2 x 2 ** MOST_BUCKETS bits at most
    classes = max(n // CLASS_WORDS, LEAST_CLASSES)
    sent = as_many_tasks_as_cores(slim.select("ids", "places")).mapInArrow(_windows(heavy, buckets, classes), _SENT)
    grown = stage(sent.repartition("class").sortWithinPartitions("class").mapInArrow(_grown(least), "ids array<long>, f long"), "frequent-ids")
    words = grown.withColumn("phrase", F.monotonically_increasing_id()).select("phrase", "f", F.posexplode("ids").alias("at", "id")).join(known.where("one").select("id", "lang", "word"), "id")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ")
    grown_text = words.groupBy("phrase").agg(F.first("lang").alias("lang"), text.alias("text"), F.first("f").alias("f")).select("lang", F.col("text").alias("phrase"), "f")
    out = stage(grown_text.union(known.where("one").select("lang", "word", "f")), "phrases")
    unstage(slim, known, grown)
    return out, sizes


def _if_both(f, kind: pa.Schema):
    """``f`` of a shard and its rows; a shard without rows has nothing frequent."""

    def both(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return f(left, right).cast(kind) if left.num_rows and right.num_rows else kind.empty_table()

    return both


def score(a: Column, n: Column, l: Column, r: Column) -> Column:
    """floor(1000 a n / (l r)), exact beyond 64 bits."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide(a) * wide(n), wide(l) * wide(r))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, covered: int = COVERED_PERCENT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first phrases of two words and more."""
    freq, sizes = frequencies(docs, least)
    long = freq.withColumn("w", F.split("phrase", " ")).withColumn("k", F.size("w")).where("k > 1")
    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")
    cuts = long.select("lang", "phrase", F.col("f").alias("a"), "w", "k", cut)
    cuts = cuts.select("lang", "phrase", "a", "cut", F.array_join(F.slice("w", 1, F.col("cut")), " ").alias("left"), F.array_join(F.slice("w", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("right"))
    part = lambda side, f: freq.select("lang", F.col("phrase").alias(side), F.col("f").alias(f))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(sizes, "lang")
    scored = cuts.withColumn("score", score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b")).select("lang", "phrase", "a", "n", "b.l", "b.r", "b.score")
    # A phrase inside a longer one is inside one with a word more, which has no fewer occurrences than the longer one.
    inner = F.explode(F.array(F.array_join(F.slice("w", 1, F.col("k") - 1), " "), F.array_join(F.slice("w", 2, F.col("k") - 1), " "))).alias("phrase")
    longer = long.where("k > 2").select("lang", "f", inner).groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < covered * F.col("a")))
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return kept.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM pieces),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 6) t(k) WHERE len(ws) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f, string_split(phrase, ' ') AS p FROM g GROUP BY lang, k, phrase HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, l.f AS l, r.f AS r, n.n, x.x AS cut, (1000::HUGEINT * c.f * n.n) // (l.f::HUGEINT * r.f) AS score
  FROM f c JOIN range(1, 5) x(x) ON x.x < c.k JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.p[1:x.x], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.p[x.x + 1:c.k], ' ') JOIN n ON n.lang = c.lang
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, cut) = 1),
inner_ AS (SELECT lang, array_to_string(p[i:i + j - 1], ' ') AS phrase, max(f) AS most FROM f, range(1, 5) t(i), range(2, 5) u(j) WHERE j < k AND i + j - 1 <= k GROUP BY ALL),
kept AS (SELECT c.* FROM cuts c LEFT JOIN inner_ i ON i.lang = c.lang AND i.phrase = c.phrase WHERE most IS NULL OR 100 * most < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept QUALIFY rank <= 2000
"""
