"""SentencePiece encoding and decoding by weighted finite-state transducers (operator 6).

Three transducers are compiled from a model: the normaliser N (blank to "▁", a "▁" put before the text), the pieces P
(an arc per piece, weight minus its score), and the byte fallback B (a character that no piece has becomes its UTF-8
byte pieces). An input is composed with N, P and B, and the path of least weight in the tropical semiring (min, +) is
its encoding. For unigram models that is the best-scored segmentation. For merge (BPE) models a further acceptor C is
composed: two pieces may follow each other only if merging their joined text gives back those two pieces. A sequence
all of whose neighbours are so compatible is the merge encoding of its text, and the only one, so each position of
the lattice has at most one live state and the shortest path is exact.

No piece crosses from other characters to "▁", and most models have none with a line break or tab (both are looked up
when compiling), so a text is composed in parts between those, and a part's path is remembered.

Defined cases: null text gives null ids and null text back; the empty text gives no ids.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import beside, read_table, texts

SPACE = "▁"
#: Remembered parts and compatible pairs of a Python worker; beyond it the memory is renewed, results are the same.
CACHE_ENTRIES = 300_000
#: Parts of more characters are not remembered.
LONG_PART = 64
INFINITE = float("inf")


class Paths(dict):
    """Ids (4 bytes each) of the parts met so far; ``before`` is what was known when memory was last renewed."""

    def __init__(self, compiled: Transducer, before: dict[str, bytes] | None = None) -> None:
        self.compiled, self.before = compiled, dict(before or {})

    def __missing__(self, part: str) -> bytes:
        raw = self.before.get(part)
        if raw is None:
            raw = b"".join(map(self.compiled.packed.__getitem__, self.compiled.shortest(part)[0]))
        if len(part) <= LONG_PART:
            self[part] = raw
        return raw


class Transducer:
    """The compiled model."""

    def __init__(self, model_path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(model_path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only normalisers that leave characters as they are can be compiled")
        if proto.trainer_spec.model_type not in (1, 2):
            raise ValueError("only unigram and merge models can be compiled")
        self.merges, self.prefix = proto.trainer_spec.model_type == 2, SPACE if norm.add_dummy_prefix else ""
        self.arcs: dict[str, tuple[int, float]] = {}
        self.bytes, self.unknown = {}, 0
        self.output: list[bytes] = []
        for i, p in enumerate(proto.pieces):
            out = p.piece.replace(SPACE, " ").encode()
            if p.type in (1, 4):
                self.arcs[p.piece] = (i, -p.score)
            elif p.type == 6:
                self.bytes[int(p.piece[3:5], 16)] = i
                out = bytes([int(p.piece[3:5], 16)])
            elif p.type == 2:
                self.unknown, out = i, " ⁇ ".encode()
            else:
                out = b""
            self.output.append(out)
        #: the piece automaton, a tree of (arc of the longest piece so far or None, next states by character); an arc is
        #: (id, weight, piece, its length, what the acceptor C has said so far of pieces after it, the next shorter arc)
        self.root: dict[str, tuple] = {}
        for piece in sorted(self.arcs, key=len):  # so that shorter arcs are there before longer ones
            states, longest = self.root, None
            for c in piece[:-1]:
                longest, states = states.setdefault(c, (longest, {}))
            states[piece[-1]] = ((*self.arcs[piece], piece, len(piece), {}, longest), {})
        self.alphabet = set("".join(self.arcs))
        self.fallback_weight = max(w for _, w in self.arcs.values()) + 10
        self.parts = self.part_pattern()
        self.packed = [i.to_bytes(4, "little") for i in range(len(proto.pieces))]
        self.known = Paths(self)
        self.longest = max(map(len, self.arcs), default=0)
        self.first = (-1, 0.0, "", 0, {}, None)  # stands before the first piece, and for characters without one
        self.asked: list[dict[int, bool]] = []
        self.split: dict[str, tuple[str, str] | None] = {}

    def part_pattern(self) -> re.Pattern:
        """What a text can be cut into without cutting a piece, as far as the pieces show."""
        breaks = "".join(c for c in "\n\r\t" if c not in self.alphabet)
        inner = [p.lstrip(SPACE) for p in self.arcs]
        if any(SPACE in p for p in inner):
            return re.compile(r"(?s).+")  # parts can't be told apart: the whole text is one
        odd = ""  # letters to re, but pieces join them to others
        while True:
            letter = rf"[^\W\d_{odd}]"
            mixed = {p for p in inner if re.search(letter, p) and not re.fullmatch(f"{letter}+", p)}
            if not mixed or len(odd) > 50:
                break
            odd += "".join(sorted({c for p in mixed for c in p if re.match(letter, c)}))
        words = f"{SPACE}*[^{SPACE}{breaks}]+" if mixed else rf"{SPACE}*{letter}+|{SPACE}*(?:[^\w{SPACE}{breaks}]|[\d_{odd}])+"
        return re.compile(f"{words}|{SPACE}+" + (f"|[{breaks}]" if breaks else ""))

    def merged(self, text: str, stop: int = 1) -> list[str]:
        """The merge encoding of a short text: the best-scored neighbours first, the leftmost of equals; ends at ``stop`` pieces."""
        s = list(text)
        while len(s) > stop:
            best, at = INFINITE, -1
            for i in range(len(s) - 1):
                arc = self.arcs.get(s[i] + s[i + 1])
                if arc and arc[1] < best:
                    best, at = arc[1], i
            if at < 0:
                break
            s[at : at + 2] = [s[at] + s[at + 1]]
        return s

    def compatible(self, a: tuple, b: tuple) -> bool:
        """The acceptor C for the pieces of two arcs; answers are remembered with the first of them."""
        if len(self.asked) > CACHE_ENTRIES:
            for followers in self.asked:
                followers.clear()
            self.asked.clear()
        self.asked.append(a[4])
        x, y = a[2], b[2]
        ok = a[4][b[0]] = self.halves(y) is not None and (not x or self.separate(x, y))
        return ok

    def halves(self, piece: str) -> tuple[str, str] | None:
        """What was merged last into ``piece``: for one character two empty strings, None if merging doesn't give it."""
        got = self.split.get(piece, 0)
        if got == 0:
            parts = self.merged(piece, stop=2)
            if len(parts) == 2:
                got = tuple(parts) if self.merged(piece) == [piece] else None
            else:
                got = ("", "") if len(piece) == 1 else None
            self.split[piece] = got
        return got

    def separate(self, x: str, y: str) -> bool:
        """Merging x + y never joins across the border: undo the merges of both sides, the last one first, and see
        whether the pieces then at the border would have been merged before it (the left one first of equals)."""
        arcs, limit, also = self.arcs, INFINITE, False
        while True:
            both = arcs.get(x + y)
            if both is not None and (both[1] < limit or also and both[1] == limit):
                return False
            wx, wy = arcs[x][1] if len(x) > 1 else -INFINITE, arcs[y][1] if len(y) > 1 else -INFINITE
            if wx == wy == -INFINITE:
                return True
            if wx > wy:
                x, limit, also = self.halves(x)[1], wx, False
            else:
                y, limit, also = self.halves(y)[0], wy, True

    def fallback(self, char: str) -> list[int]:
        """B: ids of a character that no piece has."""
        return [self.bytes[x] for x in char.encode("utf-8", "surrogatepass")] if len(self.bytes) == 256 else [self.unknown]

    def longest_arc(self, part: str, i: int) -> tuple | None:
        """The arc of the longest piece that starts at ``i``; shorter ones hang on it."""
        arc, states = None, self.root
        for c in part[i : i + self.longest]:
            got = states.get(c)
            if got is None:
                break
            arc, states = got
        return arc

    def shortest(self, part: str) -> tuple[list[int], float]:
        """Ids and weight of the least path of ``part`` (already normalised) through P, B and C."""
        return self.only_path(part) if self.merges else self.least_path(part)

    def least_path(self, part: str) -> tuple[list[int], float]:
        """Relaxes the arcs of P and B position by position, as all of them go forward."""
        n = len(part)
        best: list[tuple[float, int, list[int]] | None] = [None] * (n + 1)
        best[0] = (0.0, 0, [])
        for i in range(n):
            here = best[i]
            if here is None:
                continue
            if part[i] not in self.alphabet:
                ids = self.fallback(part[i])
                arc = (ids, self.fallback_weight * len(ids), "", 1, None, None)
            else:
                arc = self.longest_arc(part, i)
            while arc is not None:
                j, w = i + arc[3], here[0] + arc[1]
                if best[j] is None or w < best[j][0]:
                    best[j] = (w, i, [arc[0]] if arc[2] else arc[0])
                arc = arc[5]
        if best[n] is None:
            raise ValueError(f"no path through {part!r}")
        steps, j = [], n
        while j:
            steps.append(best[j][2])
            j = best[j][1]
        return [x for ids in reversed(steps) for x in ids], best[n][0]

    def only_path(self, part: str) -> tuple[list[int], float]:
        """With C a position has one live state at most, reached by one path, whose weight is therefore the least.

        So no weights need comparing: states are composed when they are reached, longest arcs first, each position
        once, and the first path to the end is the shortest.
        """
        n, root, longest, compatible, alphabet = len(part), self.root, self.longest, self.compatible, self.alphabet
        reached = bytearray(n + 1)
        path: list[tuple] = []  # the arcs taken
        i, last, arc = 0, self.first, None
        while i < n:
            states = root
            for c in part[i : i + longest]:
                got = states.get(c)
                if got is None:
                    break
                arc, states = got
            if arc is None and part[i] not in alphabet:
                ids = self.fallback(part[i])
                arc = (ids, self.fallback_weight * len(ids), "", 1, self.first[4], None)
            while True:
                if arc is None:  # a dead end: back to the state before
                    if not path:
                        raise ValueError(f"no path through {part!r}")
                    arc = path.pop()
                    i -= arc[3]
                    last, arc = path[-1] if path else self.first, arc[5]
                    continue
                if not reached[i + arc[3]]:
                    ok = not arc[2] or last[4].get(arc[0])
                    if ok is None:
                        ok = compatible(last, arc)
                    if ok:
                        break
                arc = arc[5]
            path.append(arc)
            i += arc[3]
            reached[i] = 1
            last, arc = arc, None
        out: list[int] = []
        for arc in path:
            if arc[2]:
                out.append(arc[0])
            else:
                out += arc[0]
        return out, sum([arc[1] for arc in path])

    def encode(self, text: str) -> np.ndarray:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return np.zeros(0, "<u4")
        if len(self.known) > CACHE_ENTRIES:
            self.known = Paths(self, self.known)
        parts = self.parts.findall(self.prefix + text.replace(" ", SPACE))  # composed with N
        return np.frombuffer(b"".join(map(self.known.__getitem__, parts)), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The output tape of the inverse: bytes of the pieces, without the blank that N put before the text."""
        s = b"".join(map(self.output.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return s[1:] if self.prefix and s.startswith(" ") else s


_compiled: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    if path not in _compiled:
        _compiled[path] = Transducer(path)
    return _compiled[path]


def encode(docs: DataFrame, model_path: str, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` and ``ids`` array<int> of its ``text``."""
    own = beside(docs, keep or ["doc_id"], docs["text"].cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model_path)
        for b in batches:
            ids = pa.array([None if x is None else t.encode(x).astype(np.int32) for x in texts(b, "_text")], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["_keep", "ids"])

    return own.mapInArrow(run, own.drop("_text").schema.add("ids", T.ArrayType(T.IntegerType()))).select("_keep.*", "ids")


def decode(rows: DataFrame, model_path: str, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``rows`` and the ``text`` of its ``ids``."""
    own = beside(rows, keep or ["doc_id"], rows["ids"].alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model_path)
        for b in batches:
            text = [None if x is None else t.decode(np.array(x, np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], names=["_keep", "text"])

    return own.mapInArrow(run, own.drop("_ids").schema.add("text", "string")).select("_keep.*", "text")


def round_trip(docs: DataFrame, model_path: str, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep``, n_pieces, ids_crc32 (little-endian unsigned 32-bit ids), n_fallback and whether decoding gives the text back."""
    own = beside(docs, keep or ["doc_id"], docs["text"].cast("string").alias("_text"))
    schema = own.drop("_text").schema.add("n_pieces", "long").add("ids_crc32", "long").add("n_fallback", "long").add("same_text", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model_path)
        low, high = min(t.bytes.values(), default=0), max(t.bytes.values(), default=-1)
        for b in batches:
            rows = []
            for x in texts(b, "_text"):
                if x is None:
                    rows.append((None, None, None, None))
                    continue
                ids = t.encode(x)
                rows.append((len(ids), zlib.crc32(ids.tobytes()), int(((ids >= low) & (ids <= high)).sum()), t.decode(ids) == x))
            cols = zip(*rows, strict=True) if rows else [()] * 4
            new = [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *new], names=["_keep", "n_pieces", "ids_crc32", "n_fallback", "same_text"])

    return own.mapInArrow(run, schema).select("_keep.*", "n_pieces", "ids_crc32", "n_fallback", "same_text")


def op6_sentencepieces(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")).select(F.col("doc_id"), "n_pieces", "ids_crc32", "n_fallback", "same_text")
