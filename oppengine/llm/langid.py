"""Language identification with interpolated Kneser-Ney character models (operator 2).

One model per learned language over four-symbol windows of lower-cased letters (any run of other characters is one
blank). All models share one table per order: a sorted array of 64-bit n-gram keys (four 16-bit symbols, so the key
is a collision-free hash; letters beyond 16 bits are all one symbol) and a row of log-probabilities, one per language. A text gets the language with the lowest
cross-entropy per symbol. A calibration fold gives the temperature that turns cross-entropies into a probability,
and, per language, the conformal bound on standardised cross-entropy beyond which a text is rejected. Temperature and
standardisation are fitted on the sampled rows of that fold; the bound is an exact rank among all of its rows.

Defined cases: null text, or text without a letter, is ``und`` with score 0 and is rejected; null or unknown
``lang`` rows are never learned from; with no learnable row every text is ``und``. Repeated rows get equal results. A
language with too few rows for the rank (under 999 at a rate of 0.1 %) gets an uncalibrated bound, and one with fewer
than ten sampled calibration rows rejects nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, fold, read_table, stage, texts, unstage

ORDER = 4
#: Expected bound on the texts learned from, per language (a hashed sample of the rows that may be learned from).
SAMPLE_TEXTS = 1500
#: The learning fold used for calibration only.
CALIBRATION_FOLD = 4
#: Accepted rate of clean texts of a language that rejection may hit.
REJECT_RATE = 0.001
#: Right shifts of the 64-bit keys of scores by round of the selection, so at most 8192 counts a language and round.
_SHIFTS = (51, 38, 25, 12, 0)
_CHUNK = 400_000
#: Symbols that are looked up together, with a number for each language.
_PIECE = 1_000_000
_alpha: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _alpha
    if _alpha is None:
        _alpha = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _alpha


def symbols(text: str) -> np.ndarray:
    """Three blanks, then the letters of the lower-cased text with one blank for any run of other characters."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    is_letter = _letters()[c]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first of a run of others stays, as a blank
    out = np.where(is_letter, np.minimum(c, 0xFFFF), 0)[keep].astype(np.uint64)
    return np.concatenate([np.zeros(ORDER - 1, np.uint64), out])


def keys(s: np.ndarray, order: int) -> np.ndarray:
    """Keys of the n-grams that end at each position of ``s`` (the first ones wrap and are never used)."""
    k = s.copy()
    for i in range(1, order):
        k[i:] |= s[:-i] << np.uint64(16 * i)
    return k


@dataclass
class Model:
    languages: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]  # by order: sorted keys, log-probabilities (n, languages)
    backoff: list[tuple[np.ndarray, np.ndarray]]  # by length of the context: sorted keys, log weights
    floor: np.ndarray
    temperature: float = 1.0
    bounds: np.ndarray | None = None  # per language: mean, variance per symbol, variance besides, largest z

    def entropies(self, rows: list[np.ndarray]) -> np.ndarray:
        """Cross-entropy in nats a symbol for each text (rows of ``symbols``) and language; a piece of symbols at a time."""
        s = np.concatenate(rows)
        lengths = np.array([len(r) for r in rows])
        starts = np.cumsum(lengths) - lengths
        sums = np.zeros((len(rows), len(self.languages)))
        for a in range(0, len(s), _PIECE):
            z = min(a + _PIECE, len(s))
            i = np.searchsorted(starts, a, side="right") - 1, np.searchsorted(starts, z)  # the rows that have symbols here
            valid = np.ones(z - a, bool)
            for k in range(ORDER - 1):
                at = starts[i[0] : i[1]] + k - a
                valid[at[(at >= 0) & (at < z - a)]] = False
            logs = self._log(s, np.nonzero(valid)[0] + a, a, z)
            sums[i[0] : i[1]] += np.add.reduceat(logs, np.maximum(starts[i[0] : i[1]] - a, 0), axis=0)
        return -sums / np.maximum(1, lengths - ORDER + 1)[:, None]

    def _log(self, s: np.ndarray, todo: np.ndarray, a: int, z: int) -> np.ndarray:
        """Log-probabilities by language of the symbols ``todo`` between ``a`` and ``z``, 0 for the others."""
        total = np.zeros((z - a, len(self.languages)), np.float32)
        for order in range(ORDER, 0, -1):
            known, logp = self.grams[order]
            k = _sub(s, todo, order)
            i = np.minimum(np.searchsorted(known, k), len(known) - 1)
            hit = known[i] == k
            total[todo[hit] - a] += logp[i[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
            if order == 1:
                total[todo - a] += self.floor
                break
            known, weight = self.backoff[order - 1]
            k = _sub(s, todo - 1, order - 1)
            i = np.minimum(np.searchsorted(known, k), len(known) - 1)
            total[todo - a] += np.where((known[i] == k)[:, None], weight[i], 0)
        return total.astype(np.float64)


def _sub(s: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    k = s[at].copy()
    for i in range(1, order):
        k |= s[at - i] << np.uint64(16 * i)
    return k


def kneser_ney(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """Models from (n-gram keys, counts) of the highest order by language."""
    languages = sorted(counts)
    per: list[dict] = []
    mask = [np.uint64((1 << 16 * n) - 1) for n in range(ORDER)]
    for lang in languages:
        k, c = counts[lang]
        orders, weights = {}, {}
        by = {ORDER: (k, c.astype(np.float64))}
        for n in range(ORDER - 1, 0, -1):  # continuation counts: distinct symbols before
            u, m = np.unique(by[n + 1][0] & mask[n], return_counts=True)
            by[n] = (u, m.astype(np.float64))
        vocabulary = len(by[1][0]) + 1
        lower_keys, lower = np.zeros(0, np.uint64), np.zeros(0)
        for n in range(1, ORDER + 1):
            key, cnt = by[n]
            order = np.argsort(key)
            key, cnt = key[order], cnt[order]
            n1, n2 = (cnt == 1).sum(), (cnt == 2).sum()
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            ctx, inv = np.unique(key >> np.uint64(16), return_inverse=True)
            total, kinds = np.bincount(inv, cnt), np.bincount(inv)
            lam = d * kinds / total
            if n == 1:
                low = np.full(len(key), 1 / vocabulary)
                floor = math.log(lam[0] / vocabulary)
            else:
                low = lower[np.searchsorted(lower_keys, key & mask[n - 1])]
            p = np.maximum(cnt - d, 0) / total[inv] + lam[inv] * low
            orders[n], weights[n - 1] = (key, np.log(p)), (ctx, np.log(lam))
            lower_keys, lower = key, p
        per.append({"grams": orders, "weights": weights, "floor": floor})

    def look(table: tuple[np.ndarray, np.ndarray], k: np.ndarray, default: np.ndarray | float) -> np.ndarray:
        i = np.minimum(np.searchsorted(table[0], k), len(table[0]) - 1)
        return np.where(table[0][i] == k, table[1][i], default)

    floors = np.array([x["floor"] for x in per])
    grams: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64), np.zeros((0, 0)))]
    backoff = [(np.zeros(0, np.uint64), np.zeros((0, 0)))]
    full: list[np.ndarray] = []  # of the order below, for n-grams that a language hasn't seen
    for n in range(1, ORDER + 1):
        allk = np.unique(np.concatenate([x["grams"][n][0] for x in per]))
        col = []
        for j, x in enumerate(per):
            if n == 1:
                unseen: np.ndarray | float = floors[j]
            else:
                below = grams[n - 1]
                i = np.searchsorted(below[0], allk & mask[n - 1])
                unseen = full[j][i] + look(x["weights"][n - 1], allk >> np.uint64(16), 0.0)
            col.append(look(x["grams"][n], allk, unseen))
        full = col
        grams.append((allk, np.stack(col, 1)))
        if n < ORDER:
            ctx = np.unique(np.concatenate([x["weights"][n][0] for x in per]))
            backoff.append((ctx, np.stack([look(x["weights"][n], ctx, 0.0) for x in per], 1).astype(np.float32)))
    grams = [(k, v.astype(np.float32)) for k, v in grams]
    return Model(languages, grams, backoff, floors.astype(np.float32))


def _blocks(rows: list[str | None]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Texts with a letter, as symbols, in blocks of a bounded number of symbols (a longer text is its own block)."""
    at, held, size = [], [], 0
    for i, t in enumerate(rows):
        if not t:
            continue
        s = symbols(t)
        if not s.any():
            continue
        at.append(i)
        held.append(s)
        size += len(s)
        if size > _CHUNK:
            yield at, held
            at, held, size = [], [], 0
    if at:
        yield at, held


def learn(docs: DataFrame, sample_texts: int = SAMPLE_TEXTS, reject_rate: float = REJECT_RATE) -> Model | None:
    """Models and calibration from rows (text, lang, _fold) with a language and a fold other than 0."""
    spark = docs.sparkSession
    rows = docs.where("lang is not null and text is not null and _fold > 0").select("doc_id", "lang", "text", "_fold")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    rate = F.create_map(*[x for l, n in sizes.items() for x in (F.lit(l), F.lit(min(1.0, sample_texts / n)))])
    drawn = F.pmod(F.xxhash64(F.lit("langid"), "doc_id", "text"), F.lit(1_000_000)) < rate[F.col("lang")] * 1_000_000
    sample = rows.where(drawn)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = symbols(text)
                if s.any():
                    by.setdefault(lang, []).append(keys(s, ORDER)[ORDER - 1 :])
            for lang, ks in by.items():
                k, n = np.unique(np.concatenate(ks), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "k", "n"])

    grams = sample.where(F.col("_fold") != CALIBRATION_FOLD).select("lang", "text").mapInArrow(count, "lang string, k long, n long")
    found = grams.groupBy("lang", "k").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    if found.empty:
        return None
    model = kneser_ney({l: (g["k"].to_numpy().view(np.uint64).copy(), g["n"].to_numpy()) for l, g in found.groupby("lang")})
    sent = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_of = {l: j for j, l in enumerate(sent.value.languages)}
        for b in batches:
            own, drawn = [at_of.get(l, -1) for l in b.column(0).to_pylist()], b.column(2).to_pylist()
            for at, held in _blocks(b.column(1).to_pylist()):
                h = sent.value.entropies(held)
                low = [x if own[i] == j else None for i, j, x in zip(at, h.argmin(1).tolist(), h.min(1).tolist(), strict=True)]
                every = [x if drawn[i] else None for i, x in zip(at, h.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([own[i] for i in at], pa.int32()), pa.array([len(s) - ORDER + 1 for s in held], pa.int64()), pa.array(low, pa.float64()), pa.array(every, pa.list_(pa.float64()))], names=["lang", "n", "low", "h"])

    held_back = rows.where(F.col("_fold") == CALIBRATION_FOLD).select("lang", "text", drawn.alias("drawn"))
    seen = stage(held_back.mapInArrow(measure, "lang int, n long, low double, h array<double>").where("lang >= 0"), "langid-calibration")
    standardise(model, seen.where("h is not null").select("lang", "n", "h").toPandas())
    calibrate(model, seen.where("low is not null").select("lang", "n", "low"), reject_rate)
    unstage(seen)
    return model


def standardise(model: Model, seen) -> None:
    """Temperature by held-back log-loss; per language the mean and variance that standardise cross-entropies."""
    model.bounds = np.tile([0.0, 0.0, 0.0, np.inf], (len(model.languages), 1))
    if not len(seen):
        return
    h, n, y = np.stack(seen["h"].to_numpy()), seen["n"].to_numpy(float), seen["lang"].to_numpy()
    best = (np.inf, 1.0)
    for t in 2.0 ** np.arange(-6, 7):
        p = posterior(h, n, t)
        best = min(best, (-np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean(), t))
    model.temperature = float(best[1])
    for j in range(len(model.languages)):
        own = (y == j) & (h.argmin(1) == j)
        if own.sum() < 10:
            continue
        x, m = h[own, j], n[own]
        mean = np.median(x)
        a, b = np.linalg.lstsq(np.stack([1 / m, np.ones(len(m))], 1), (x - mean) ** 2, rcond=None)[0]
        model.bounds[j, :3] = mean, max(a, 1e-6), max(b, 1e-6)


def standard(low: np.ndarray, n: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Standardised cross-entropies; ``bounds`` has a row for each."""
    mean, a, c = bounds.T[:3]
    return (low - mean) / np.sqrt(np.maximum(a / n + c, 1e-12))


def _ordered(bits: np.ndarray) -> np.ndarray:
    """Bits of doubles as integers in the order of the doubles; its own inverse."""
    return bits ^ ((bits >> 63) & np.int64(0x7FFF_FFFF_FFFF_FFFF))


def calibrate(model: Model, own: DataFrame, reject_rate: float) -> None:
    """Per language the conformal bound: an exact rank of the standardised scores of all rows of ``own`` (lang, n, low).

    Scores are selected by their 64-bit keys, 13 bits a round: tasks count the keys that share the bits found so far,
    and only those counts are collected.
    """
    fitted = {j for j, b in enumerate(model.bounds) if b[2] > 0}
    rank: dict[int, int] = {}
    found: dict[int, int] = {}
    few: set[int] = set()
    before, bounds = 63, model.bounds

    for shift in _SHIFTS:

        def count(batches: Iterator[pa.RecordBatch], shift=shift, before=before, found=dict(found)) -> Iterator[pa.RecordBatch]:
            for b in batches:
                j = b.column(0).to_numpy()
                k = _ordered((standard(b.column(2).to_numpy(), b.column(1).to_numpy().astype(float), bounds[j]) + 0.0).view(np.int64))
                for l in np.unique(j).tolist():
                    mine = k[j == l]
                    if found:
                        mine = mine[mine >> before == found[l]] if l in found else mine[:0]
                    u, n = np.unique(mine >> shift, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([l] * len(u), pa.int32()), pa.array(u), pa.array(n.astype(np.int64))], names=["lang", "k", "n"])

        counts = own.mapInArrow(count, "lang int, k long, n long").groupBy("lang", "k").agg(F.sum("n").alias("n")).toArrow().to_pandas()
        for l, g in counts[counts["lang"].isin(fitted)].groupby("lang"):
            g = g.sort_values("k")
            upto = g["n"].to_numpy().cumsum()
            if l not in rank:
                rank[l] = math.ceil((1 - reject_rate) * (upto[-1] + 1))
                if rank[l] > upto[-1]:  # too few rows: the largest score gives a bound that no rate is claimed for
                    few.add(l)
                    rank[l] = int(upto[-1])
            i = int(np.searchsorted(upto, rank[l]))
            rank[l] -= int(upto[i - 1]) if i else 0
            found[l] = int(g["k"].iloc[i])
        before = shift
        if not found:
            return
    for l, k in found.items():
        z = float(_ordered(np.array([k], np.int64)).view(np.float64)[0])
        bounds[l, 3] = max(3 * z, 12.0) if l in few else z


def posterior(h: np.ndarray, n: np.ndarray, temperature: float) -> np.ndarray:
    """Softmax of -cross-entropy, weighted by the square root of the length, as neighbouring symbols depend on each other."""
    x = -h * np.sqrt(n)[:, None] * temperature
    x -= x.max(1, keepdims=True)
    e = np.exp(x)
    return e / e.sum(1, keepdims=True)


def detect(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """Add lang_pred, score, cross_entropy and accepted to the columns ``keep`` of ``docs`` (which has ``text``)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    add = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("cross_entropy", pa.float64()), ("accepted", pa.bool_())])
    own = beside(docs, keep, docs["text"].cast("string").alias("_text"))
    schema = own.drop("_text").schema.add("lang_pred", "string").add("score", "double").add("cross_entropy", "double").add("accepted", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            rows = b.column(b.num_columns - 1).to_pylist()
            lang, score, ent, ok = ["und"] * len(rows), np.zeros(len(rows)), np.full(len(rows), np.nan), np.zeros(len(rows), bool)
            for at, held in _blocks(rows) if m else ():
                h, n = m.entropies(held), np.array([len(s) - ORDER + 1 for s in held], float)
                j, p = h.argmin(1), posterior(h, n, m.temperature)
                low = h.min(1)
                score[at], ent[at] = np.clip(p[np.arange(len(j)), j], 0, 1), low
                ok[at] = standard(low, n, m.bounds[j]) <= m.bounds[j, 3]
                for i, x in zip(at, j, strict=True):
                    lang[i] = m.languages[x]
            new = [pa.array(lang), pa.array(score), pa.array(ent, from_pandas=True), pa.array(ok)]
            yield pa.RecordBatch.from_arrays([b.column(0), *new], names=["_keep", *add.names])

    return own.mapInArrow(run, schema).select("_keep.*", "lang_pred", "score", "cross_entropy", "accepted")


def identify(docs: DataFrame, keep: list[str] | None = None, labelled: DataFrame | None = None) -> DataFrame:
    """Learn from ``labelled`` (default: ``docs``; doc_id, text, lang) and predict the language of every text of ``docs``."""
    source = labelled if labelled is not None else docs
    source = source.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), fold("doc_id").alias("_fold"))
    return detect(docs, learn(source), keep or ["doc_id"])


def op2_langid(spark, sf_dir: str) -> DataFrame:
    out = identify(read_table(spark, sf_dir, "documents"))
    return out.withColumn("held_out", fold() == 0)
