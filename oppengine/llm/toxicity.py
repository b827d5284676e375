"""Toxic spans and document scores from a linear-chain conditional random field (operator 4).

Tokens are separated by white space. Labels exist per document, so token labels come first: over distinct labelled
texts, a word or word beginning is a toxic mark if the one-sided lower confidence bound on its share of toxic documents
is high; the tokens of toxic documents that bear a mark are labelled 1, all others 0. The field has two states, hashed
word features (whole word, beginnings, ends, shape) and transitions, and is trained by its conditional likelihood. Forward-backward
gives every token's marginal; expected toxic tokens and the two largest marginals go into a logistic calibration that
gives the document's score. Runs of tokens with a marginal of at least a half are the offending spans.

Defined cases: null and empty texts have no token and get the calibrated score of a text without any sign; with no
labelled document every score is 0. Repeated rows get equal scores; labels of repeated ids count as toxic if any is.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import beside, fold, read_table, stage, unstage

#: Expected bounds on the labelled texts learned from.
SAMPLE_TOXIC, SAMPLE_CLEAN = 2000, 4000
#: Tokens of a training sequence, of which longer texts have several, and of those that are encoded together.
TRAIN_SPAN, TRAIN_BLOCK = 128, 131_072
#: Steps of the training, each a job that sums gradients over all sequences, and the tasks of such a job.
TRAIN_ROUNDS, TRAIN_TASKS = 40, 4
#: A mark: a word with at least so many toxic texts, whose lower bound (z below) on the share of toxic texts is so high.
MARK_TEXTS, MARK_SHARE, MARK_Z = 5, 0.5, 2.58
HASH_BITS = 18
#: Lengths of the word beginnings that can be marks, and of those and the ends that are features.
STEMS, HEADS, TAILS = (4, 5, 6, 7, 8, 9), (3, 4, 5, 6, 7, 8), (3, 4)
CACHE_ENTRIES = 150_000
#: Tasks among which the sample is dealt.
SAMPLE_TASKS = 32
#: Characters of the texts that are split and run through the field together; bounds a worker's memory.
_TOGETHER = 2_000_000


def normal(token: str) -> str:
    """In lower case, without what is neither letter nor digit at the ends."""
    w = token.lower()
    a, b = 0, len(w)
    while a < b and not w[a].isalnum():
        a += 1
    while a < b and not w[b - 1].isalnum():
        b -= 1
    return w[a:b]


def parts(token: str) -> tuple[str, list[str]]:
    """The feature of the whole word, and those that it shares with many others."""
    w = normal(token)
    shared = ["l%d" % min(len(w), 12), "h%d%d" % (token.isupper(), token.isalpha())]
    shared += ["p" + w[:n] for n in HEADS if len(w) > n]
    shared += ["s" + w[-n:] for n in TAILS if len(w) > n]
    return "w" + w, shared


def slot(feature: str) -> int:
    return xxhash.xxh3_64_intdigest(feature) & ((1 << HASH_BITS) - 1)


def features(token: str) -> list[int]:
    word, shared = parts(token)
    return [slot(word), *map(slot, shared)]


def units(word: str) -> list[str]:
    """What of a word can be a mark: the whole word, and its beginnings."""
    return ["=" + word, *(word[:n] for n in STEMS if len(word) >= n)]


@dataclass
class Field:
    weights: np.ndarray  # of state 1 against state 0, by hashed feature
    transition: np.ndarray  # 2 x 2, log
    start: float
    calibration: np.ndarray = field(default_factory=lambda: np.zeros(5))
    known: dict[str, float] = field(default_factory=dict, repr=False)
    shared: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "shared": {}}

    def emission(self, token: str) -> float:
        word, names = parts(token)
        shared, out = self.shared, float(self.weights[slot(word)])
        if len(shared) > CACHE_ENTRIES:
            shared.clear()
        for n in names:
            w = shared.get(n)
            if w is None:
                w = shared[n] = float(self.weights[slot(n)])
            out += w
        return out

    def emissions(self, tokens: list[str]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, tokens), np.float64, len(tokens))
        except KeyError:
            if len(known) > CACHE_ENTRIES:
                known.clear()
            for t in set(tokens).difference(known):
                known[t] = self.emission(t)
            return np.fromiter(map(known.__getitem__, tokens), np.float64, len(tokens))


def marginals(e: np.ndarray, lengths: np.ndarray, transition: np.ndarray, start: float, pairs: bool = False):
    """P(state 1) for each token of sequences of log-odds ``e`` (one after the other, ``lengths`` not increasing, none 0).

    Forward and backward run over all sequences at once, a position at a time, on normalised pairs. With ``pairs``
    also the log-likelihood normaliser and the expected transitions.
    """
    a = np.exp(transition)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    steps = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(1, steps + 1), side="right")  # sequences that have position t
    w = np.exp(np.clip(e, -30, 30))
    f1 = np.empty(len(e))  # filtered P(state 1)
    logz = 0.0
    x = w[first] * np.exp(start)
    if pairs:
        logz += np.log1p(x).sum()
    p = x / (1 + x)
    f1[first] = p
    for t in range(1, steps):
        k = active[t]
        at = first[:k] + t
        p = p[:k]
        s1 = ((1 - p) * a[0, 1] + p * a[1, 1]) * w[at]
        s0 = (1 - p) * a[0, 0] + p * a[1, 0]
        z = s0 + s1
        if pairs:
            logz += np.log(z).sum()
        p = s1 / z
        f1[at] = p
    b = np.ones(0)
    m = np.empty(len(e))
    moves = np.zeros((2, 2))
    # b: backward odds of state 1 against state 0
    for t in range(steps - 1, -1, -1):
        k = active[t]
        at = first[:k] + t
        nb = np.ones(k)
        if t + 1 < steps:
            j = active[t + 1]
            o = w[first[:j] + t + 1] * b[:j]
            d0, d1 = a[0, 0] + a[0, 1] * o, a[1, 0] + a[1, 1] * o
            if pairs:
                p = f1[at[:j]]
                n = (1 - p) * d0 + p * d1
                moves += [[((1 - p) * a[0, 0] / n).sum(), ((1 - p) * a[0, 1] * o / n).sum()], [(p * a[1, 0] / n).sum(), (p * a[1, 1] * o / n).sum()]]
            nb[:j] = d1 / d0
        b = nb
        q = f1[at] * b
        m[at] = q / (q + 1 - f1[at])
    return (m, logz, moves) if pairs else m


def encoded(sequences: list[tuple[list[str], np.ndarray]]) -> dict[str, np.ndarray]:
    """Sequences (tokens, 0/1 labels), none empty, as arrays: what of them does not change while a field is trained."""
    sequences = sorted(sequences, key=lambda s: -len(s[0]))
    words, at = np.unique(np.array([t for s in sequences for t in s[0]], dtype=object), return_inverse=True)
    lists = [np.array(features(t), np.int32) for t in words]
    return {
        "lengths": np.array([len(s[0]) for s in sequences], np.int32), "word": at.astype(np.int32), "y": np.concatenate([s[1] for s in sequences]).astype(np.uint8),
        "of": np.repeat(np.arange(len(words), dtype=np.int32), [len(x) for x in lists]), "feature": np.concatenate(lists),
    }


def gradient(f: Field, block: dict[str, np.ndarray]) -> np.ndarray:
    """Of the likelihood of a block: by weight, by transition, by start."""
    lengths, word, y, of, feature = block["lengths"].astype(np.int64), block["word"], block["y"].astype(np.float64), block["of"], block["feature"]
    n = int(of[-1]) + 1
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    inside = np.ones(len(y), bool)
    inside[first] = False
    to = np.nonzero(inside)[0]
    seen = np.zeros((2, 2))
    np.add.at(seen, (block["y"][to - 1].astype(int), block["y"][to].astype(int)), 1)
    m, _, moves = marginals(np.bincount(of, f.weights[feature], n)[word], lengths, f.transition, f.start, pairs=True)
    left = np.bincount(word, y - m, n)
    return np.concatenate([np.bincount(feature, left[of], 1 << HASH_BITS), (seen - moves).ravel(), [(y[first] - m[first]).sum()]])


def ascend(total, n: int, rounds: int = TRAIN_ROUNDS, l2: float = 1e-5) -> Field:
    """Maximum conditional likelihood by Adagrad; ``total`` sums the gradients of a field over ``n`` tokens."""
    f = Field(np.zeros(1 << HASH_BITS), np.zeros((2, 2)), 0.0)
    gw, gt, gs = np.full(1 << HASH_BITS, 1e-8), np.full((2, 2), 1e-8), 1e-8
    for _ in range(rounds if n else 0):
        got = total(f) / n
        g = got[:-5] - l2 * f.weights
        gw += g * g
        f.weights += 0.5 * g / np.sqrt(gw)
        g2 = got[-5:-1].reshape(2, 2) - l2 * f.transition
        gt += g2 * g2
        f.transition += 0.2 * g2 / np.sqrt(gt)
        gs += got[-1] ** 2
        f.start += 0.2 * got[-1] / np.sqrt(gs)
    return f


def train_field(sequences: list[tuple[list[str], np.ndarray]], rounds: int = TRAIN_ROUNDS) -> Field:
    """A field from sequences (tokens, 0/1 labels) that are at hand."""
    sequences = [s for s in sequences if s[0]]
    if not sequences:
        return ascend(None, 0)
    block = encoded(sequences)
    return ascend(lambda f: gradient(f, block), len(block["y"]), rounds)


_BLOCK = "lengths binary, word binary, y binary, of binary, feature binary, n long"
_BLOCK_TYPES = {"lengths": np.int32, "word": np.int32, "y": np.uint8, "of": np.int32, "feature": np.int32}


def train_on(texts: DataFrame, marks: set[str], rounds: int = TRAIN_ROUNDS) -> Field:
    """A field from all spans of ``texts`` (doc_id, toxic, text): gradients are summed in tasks, a few tasks' sums come to the driver."""
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast(marks)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            b = encoded(held)
            return pa.RecordBatch.from_arrays([*(pa.array([b[c].tobytes()], pa.binary()) for c in _BLOCK_TYPES), pa.array([len(b["y"])], pa.int64())], names=[*_BLOCK_TYPES, "n"])

        for b in batches:
            for toxic, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                for w, y in cut(text, sent.value if toxic else set()):
                    held.append((w, np.array(y, np.uint8)))
                    size += len(w)
                    if size >= TRAIN_BLOCK:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    staged = stage(texts.mapInArrow(blocks, _BLOCK), "toxicity-blocks")

    def total(f: Field) -> np.ndarray:
        with_field = spark.sparkContext.broadcast(f)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = None
            for b in batches:
                for row in range(b.num_rows):
                    g = gradient(with_field.value, {c: np.frombuffer(b.column(i)[row].as_py(), t) for i, (c, t) in enumerate(_BLOCK_TYPES.items())})
                    out = g if out is None else out + g
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["g"])

        # TRAIN_TASKS sums of 2 ** HASH_BITS numbers at most
        sums = [np.frombuffer(r["g"]) for r in staged.select(*_BLOCK_TYPES).coalesce(TRAIN_TASKS).mapInArrow(run, "g binary").collect()]
        with_field.destroy()  # also the blocks that the driver holds
        return np.sum(sums, axis=0)

    f = ascend(total, staged.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], rounds)
    unstage(staged)
    return f


def document_features(f: Field, rows: list[str | None]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray] | None]]:
    """(expected toxic tokens, largest marginal, tokens, second largest marginal) by text, and the marginals of texts with an offending token."""
    size = np.array([len(t) if t else 0 for t in rows], np.int64)
    out, found = np.zeros((len(rows), 4)), [None] * len(rows)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    cuts = np.cumsum(size[order]) // _TOGETHER
    for c in np.unique(cuts):  # texts of like length together, as steps are taken over all of them at once
        at = order[cuts == c]
        tokens = [rows[i].split() for i in at]
        n = np.array([len(t) for t in tokens])
        longest = np.argsort(-n, kind="stable")
        longest = longest[n[longest] > 0]
        if not len(longest):
            continue
        at, n = at[longest], n[longest]
        m = marginals(np.concatenate([f.emissions(tokens[i]) for i in longest]), n, f.transition, f.start)
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        out[at, 0], out[at, 1], out[at, 2] = np.add.reduceat(m, starts), np.maximum.reduceat(m, starts), n
        top = m == np.repeat(out[at, 1], n)
        out[at, 3] = np.where(np.add.reduceat(top, starts, dtype=np.int64) > 1, out[at, 1], np.maximum.reduceat(np.where(top, 0.0, m), starts))
        for i, s, k in zip(at, starts, n, strict=True):
            if out[i, 1] >= 0.5:
                found[i] = m[s : s + k].copy()
    return out, found


def _logit_inputs(x: np.ndarray) -> np.ndarray:
    p = np.clip(x[:, [1, 3]], 1e-4, 1 - 1e-4)
    most, second = np.log(p / (1 - p)).T
    return np.stack([np.ones(len(x)), most, np.log1p(x[:, 0]), (x[:, 2] == 0).astype(float), second], 1)


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 50) -> np.ndarray:
    b = np.zeros(x.shape[1])
    pen = np.full(x.shape[1], l2)
    pen[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pen), x.T @ (y - p) - pen * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def cut(text: str, marks: set[str]) -> Iterator[tuple[list[str], list[int]]]:
    """The whole text in spans of ``TRAIN_SPAN`` tokens, with a 1 for each token that bears one of ``marks``."""
    w = text.split()
    for a in range(0, len(w), TRAIN_SPAN):
        own = w[a : a + TRAIN_SPAN]
        yield own, [int(bool(marks) and not marks.isdisjoint(units(normal(t)))) for t in own]


def learn(docs: DataFrame, labels: DataFrame, sample_toxic: int = SAMPLE_TOXIC, sample_clean: int = SAMPLE_CLEAN) -> Field | None:
    """A field from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic), without ids of fold 0 on either side."""
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(fold() > 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1):
        return None
    rate = F.when(F.col("toxic") == 1, min(1.0, sample_toxic / sizes[1])).otherwise(min(1.0, sample_clean / max(1, sizes.get(0, 0))))
    drawn = known.where(F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1_000_000)) < rate * 1_000_000)
    drawn = stage(drawn, "toxicity-drawn")
    few = drawn.count() <= 4 * (sample_toxic + sample_clean)  # 12 bytes each; a hashed draw is near its expectation
    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    got = got.join(F.broadcast(drawn) if few else drawn.hint("merge"), "doc_id").withColumn("h", F.xxhash64("text")).repartition(SAMPLE_TASKS, "h")
    rows = got.groupBy("h").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id"), F.first("text").alias("text")).select("doc_id", "toxic", "text")
    rows = stage(rows, "toxicity-sample")  # read again below, so the corpus is only once

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bad, every = Counter(), Counter()
            for toxic, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                own = {u for w in {normal(t) for t in text.split()} - {""} for u in units(w)}
                every.update(own)
                if toxic:
                    bad.update(own)
            yield pa.RecordBatch.from_arrays([pa.array(list(every), pa.string()), pa.array([bad[u] for u in every], pa.int64()), pa.array(list(every.values()), pa.int64())], names=["unit", "bad", "n"])

    counts = rows.mapInArrow(count, "unit string, bad long, n long").groupBy("unit").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    counts = counts.where(F.col("bad") >= MARK_TEXTS)
    share, z = F.col("bad") / F.col("n"), MARK_Z
    low = (share + z * z / (2 * F.col("n")) - z * F.sqrt(share * (1 - share) / F.col("n") + z * z / (4 * F.col("n") * F.col("n")))) / (1 + z * z / F.col("n"))
    marks = {r["unit"] for r in counts.where(low >= MARK_SHARE).select("unit").collect()}
    fold5 = F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(3))
    f = train_on(rows.where(fold5 != 0), marks)
    with_field = spark.sparkContext.broadcast(f)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, _ = document_features(with_field.value, b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(1), *(pa.array(c) for c in x.T.copy())], names=["toxic", "expected", "most", "n", "second"])

    seen = rows.where(fold5 == 0).mapInArrow(measure, "toxic int, expected double, most double, n double, second double").toPandas()
    x, y = seen[["expected", "most", "n", "second"]].to_numpy(float), seen["toxic"].to_numpy(float)
    # Draws differ by class; weights undo that, so that scores are calibrated to the labelled rows.
    prior = np.log((sizes[1] / max(1, sizes.get(0, 0))) / (max(y.sum(), 1) / max(1, (1 - y).sum()))) if len(y) and 0 < y.sum() < len(y) else 0.0
    if len(y):
        f.calibration = fit_logistic(_logit_inputs(x), y)
        f.calibration[0] += prior
    unstage(rows, drawn)
    return f


def score(docs: DataFrame, f: Field | None, keep: list[str]) -> DataFrame:
    """Add score, predicted, expected_toxic_tokens and spans (character offsets) to the columns ``keep`` of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(f)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    own = beside(docs, keep, docs["text"].cast("string").alias("_text"))
    schema = own.drop("_text").schema.add("score", "double").add("predicted", "integer").add("expected_toxic_tokens", "double")
    schema = schema.add("spans", T.ArrayType(T.StructType().add("start", "integer").add("end", "integer")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            rows = b.column(1).to_pylist()
            p, x, spans = np.zeros(len(rows)), np.zeros((len(rows), 4)), [[] for _ in rows]
            if m:
                x, found = document_features(m, rows)
                p = 1 / (1 + np.exp(-np.clip(_logit_inputs(x) @ m.calibration, -30, 30)))
                for i, q in enumerate(found):
                    if q is not None:
                        spans[i] = offsets(rows[i], q >= 0.5)
            new = [pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(x[:, 0].copy()), pa.array(spans, span)]
            yield pa.RecordBatch.from_arrays([b.column(0), *new], names=["_keep", "score", "predicted", "expected_toxic_tokens", "spans"])

    return own.mapInArrow(run, schema).select("_keep.*", "score", "predicted", "expected_toxic_tokens", "spans")


def offsets(text: str, bad: np.ndarray) -> list[dict]:
    """Runs of bad tokens as character ranges of the text."""
    at, out, last = 0, [], None
    for token, is_bad in zip(text.split(), bad, strict=True):
        at = text.index(token, at)
        end = at + len(token)
        if is_bad:
            if last is not None:
                out[-1]["end"] = end
            else:
                out.append({"start": at, "end": end})
        last = end if is_bad else None
        at = end
    return out


def detect_toxicity(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, learn_from: DataFrame | None = None) -> DataFrame:
    """Learn from ``learn_from`` (default ``docs``) with ``labels`` and score every text of ``docs``."""
    return score(docs, learn(learn_from if learn_from is not None else docs, labels), keep or ["doc_id"])


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    out = detect_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return out.withColumn("held_out", fold() == 0)
