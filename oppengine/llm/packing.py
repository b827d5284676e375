"""Best-fit packing of tokenised documents into fixed-length training sequences (operator 1).

Method: large-item matching. Pieces above a third of the capacity can share a sequence with at most one other such
piece, so they are matched greedily, each with the largest partner that fits; smaller pieces then go, longest first,
to the sequence with the smallest gap that holds them.

A length is an integer up to the capacity, so the whole packing problem is a histogram of at most ``capacity``
counts, whatever the corpus. ``plan_packing`` packs that histogram in runs ("ranks r..r+n of length l go to sequences
s..s+n at offset o"). Documents are never gathered: each task numbers its own pieces by length, a prefix sum over
(task, length) counts makes these ranks global, and a binary search in the runs gives every piece its place.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import read_table, stage, texts

CAPACITY = 2048
END_ID = 0
#: Distinct pre-tokens whose ids a Python worker remembers; beyond it the memory is cleared, results are the same.
CACHE_ENTRIES = 250_000

#: The pre-token pattern of the byte-level vocabulary, in ``re`` syntax for texts whose letters and
#: digits are only those that both notations call letters and digits.
FAST_PATTERN = r" ?[^\W\d_]+|'s|'t|'re|'ve|'m|'ll|'d| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
#: Characters for which the two notations may differ: \w or \d of ``re`` without being \p{L} or decimal \p{N}.
_ODD = r"[^\x00-\x1b\x20-\x7fÀ-ÖØ-öø-ʯΑ-ΡΣ-ϿА-я‐-‧€]"


class PreTokenEncoder:
    """Ids of whole texts. A byte-level BPE never merges across pre-tokens, so each distinct one is encoded once."""

    def __init__(self, tokenizer_path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.model = self.tokenizer.model
        self.fast, self.odd = re.compile(FAST_PATTERN), re.compile(_ODD)
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(visible)]
        self.table = {b: b for b in visible} | {b: 256 + i for i, b in enumerate(hidden)}
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids, without special tokens added."""
        if self.odd.search(text) or self.special.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = self.fast.findall(text)
        known = self.known
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            if len(known) > CACHE_ENTRIES:
                known.clear()
            model, table = self.model, self.table
            for w in set(words).difference(known):
                known[w] = b"".join(t.id.to_bytes(4, "little") for t in model.tokenize(w.encode().decode("latin-1").translate(table)))
            return b"".join(map(known.__getitem__, words))


_encoders: dict[str, PreTokenEncoder] = {}


def encoder(path: str) -> PreTokenEncoder:
    if path not in _encoders:
        _encoders[path] = PreTokenEncoder(path)
    return _encoders[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: whole ones of ``capacity``, the first takes what is left over."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("chunk", pa.int64()), ("nth", pa.int64())])
PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, chunk long, nth long"


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of every document; ``nth`` numbers the pieces of a length within the task ``chunk``.

    Null text counts as empty (a single end id). Repeated rows give repeated pieces; null ids stay null.
    """
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen, chunk = encoder(tokenizer_path), Counter(), TaskContext.get().partitionId()
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
                ids = enc.encode(text or "") + end
                for i, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append((doc, i, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), chunk, seen[length]))
                    seen[length] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PIECES.types, strict=True)], schema=PIECES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES_DDL)


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, count, first sequence, offset) that place every piece of the histogram."""
    left = {l: n for l, n in histogram.items() if n > 0}
    if any(l < 1 or l > capacity for l in left):
        raise ValueError("lengths must be between 1 and the capacity")
    used: Counter = Counter()
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: list[int] = []  # the gaps that some open sequences have, ascending
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> (first sequence, count)
    sequences = 0

    def put(length: int, n: int, first: int, offset: int) -> None:
        runs.append((length, used[length], n, first, offset))
        used[length] += n
        left[length] -= n
        if not left[length]:
            del left[length]

    def leave(first: int, n: int, gap: int) -> None:
        if gap:
            if not open_[gap]:
                insort(gaps, gap)
            open_[gap].append((first, n))

    large = sorted(l for l in left if 3 * l > capacity)
    while large:
        a = large[-1]
        n = left[a]
        i = bisect_left(large, capacity - a + 1) - 1  # the largest partner that fits
        if i >= 0:
            b = large[i]
            n = min(n, left[b]) if b != a else n // 2
            if n:
                put(a, n, sequences, 0)
                put(b, n, sequences, a)
                leave(sequences, n, capacity - a - b)
                sequences += n
            elif b == a:  # a single one is left of this length: its partner is the next smaller one, if any
                if i > 0:
                    b = large[i - 1]
                    put(a, 1, sequences, 0)
                    put(b, 1, sequences, a)
                    leave(sequences, 1, capacity - a - b)
                else:
                    put(a, 1, sequences, 0)
                    leave(sequences, 1, capacity - a)
                sequences += 1
        else:
            put(a, n, sequences, 0)
            leave(sequences, n, capacity - a)
            sequences += n
        large = [l for l in large if l in left]
    for l in sorted(left, reverse=True):
        while l in left:
            i = bisect_left(gaps, l)
            if i < len(gaps):
                gap = gaps[i]
                first, have = open_[gap].pop()
                # What the first piece leaves is the smallest gap now, so a sequence is filled before the next one.
                per = gap // l
                whole = min(have, left[l] // per)
                rest = left[l] - whole * per if whole < have else 0
                used_now = whole + (rest > 0)
                if used_now < have:
                    open_[gap].append((first + used_now, have - used_now))
                if not open_[gap]:
                    gaps.pop(i)
                for k in range(per if whole else 0):
                    put(l, whole, first, capacity - gap + k * l)
                for k in range(rest):
                    put(l, 1, first + whole, capacity - gap + k * l)
                if whole:
                    leave(first, whole, gap - per * l)
                if rest:
                    leave(first + whole, 1, gap - rest * l)
            else:
                per, n = capacity // l, left[l]
                whole = n // per
                for k in range(per if whole else 0):
                    put(l, whole, sequences, k * l)
                if whole:
                    leave(sequences, whole, capacity - per * l)
                    sequences += whole
                if rest := n - whole * per:
                    for k in range(rest):
                        put(l, 1, sequences, k * l)
                    leave(sequences, 1, capacity - rest * l)
                    sequences += 1
    return runs


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to the rows of ``tokenize_pieces`` (any table with length, chunk and nth).

    ``pieces`` must be a stable table (staged), as it is read twice. An empty table packs into no sequence.
    """
    counts = pieces.groupBy("chunk", "length").agg(F.count("*").alias("n"))
    counts = stage(counts, "pack-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    runs = sorted(plan_packing(histogram, capacity))
    length, rank, _, seq, off = (np.array(x, dtype=np.int64) for x in (zip(*runs, strict=True) if runs else [()] * 5))
    first_run = {int(l): int(i) for l, i in zip(*np.unique(length, return_index=True), strict=True)}
    span = {l: slice(i, i + int((length == l).sum())) for l, i in first_run.items()}
    before = F.sum("n").over(Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("chunk", "length", F.coalesce(before, F.lit(0)).alias("_base"))
    # A row for every task and length it has: that grows with the corpus, so it is never broadcast.
    placed = pieces.join(base.hint("merge"), ["chunk", "length"]).withColumn("_rank", F.col("_base") + F.col("nth"))
    keep = [c for c in pieces.columns if c not in ("chunk", "nth")]
    out_type = placed.select(*keep).schema.add("sequence_id", "long").add("offset", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ls, rs = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            s, o = np.zeros(len(ls), np.int64), np.zeros(len(ls), np.int64)
            for l in np.unique(ls):
                at, w = np.nonzero(ls == l)[0], span[int(l)]
                i = np.searchsorted(rank[w], rs[at], side="right") - 1
                s[at], o[at] = seq[w][i] + rs[at] - rank[w][i], off[w][i]
            own = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*own, pa.array(s), pa.array(o)], names=[*keep, "sequence_id", "offset"])

    return placed.select(*keep, "_rank").mapInArrow(run, out_type)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pack the texts of ``docs`` (doc_id, text; other columns are ignored) into sequences of ``capacity`` ids.

    Returns one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    return pack(stage(tokenize_pieces(docs, tokenizer_path, capacity, end_id), "pieces"), capacity)


def sequences(docs: DataFrame, placed: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The packed sequences themselves: (sequence_id, ids array<int>, doc_ids array<long>), for unique doc ids.

    Token arrays are made again from the texts, cut as ``placed`` says, and gathered by sequence (at most
    ``capacity`` ids each, so no group is unbounded).
    """
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
                ids = np.frombuffer(enc.encode(text or "") + end, "<u4").astype(np.int32)
                rows += [(doc, i, ids[s : s + n].tolist()) for i, (s, n) in enumerate(cut(len(ids), capacity))]
            if rows:
                d, p, i = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(p, pa.int32()), pa.array(i, pa.list_(pa.int32()))], names=["doc_id", "piece", "ids"])

    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, piece int, ids array<int>")
    got = placed.select("doc_id", "piece", "sequence_id", "offset").join(pieces, ["doc_id", "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return got.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"), F.col("p.doc_id").alias("doc_ids"))


def op1_pack(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
