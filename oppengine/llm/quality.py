"""Quality rules with risk-controlled thresholds (operator 3).

Counts of every whole text feed fixed base rules and learned cutoffs on six metrics (``METRICS``), a set of cutoffs for
each stratum. Labelled texts that pass the base rules are parted by fold:

- On the learning fold, candidate cutoffs of a metric are upper quantiles of the stratum's clean texts. Starting from
  none, the cutoff is tightened that rejects the most further bad texts for the fewest further clean ones, again and
  again, as long as no more than ``RISK`` of the clean texts go: a ladder of rules, each rejecting all that the one
  before it does. (Without labelled bad texts the metrics get their mildest cutoffs one after the other.)
- On the test folds, the rules of the ladder are tested in this order: a rule is certified if an exact binomial test
  rejects "more than ``RISK`` of clean texts are falsely rejected" at error ``ERROR`` divided by the number of strata
  (Bonferroni). Testing stops at the first rule that fails (fixed sequence), so that with probability 1 - ERROR no
  stratum loses more than RISK of its clean texts. The last certified rule is used.

The risk is that of the learned cutoffs among clean texts that pass the base rules, which are fixed and have no bound.
Fold 0 is used for neither, so it can measure both errors.

Defined cases: null and empty texts have no words and fail the base rules; a stratum without enough labelled texts
(436 clean ones on the test folds with four strata) certifies no rule, so only the base rules hold there; null strata
are one stratum; repeated rows are alike; labels that repeat an id count as good only if all are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, fold, read_table, stage, texts, unstage

#: The largest share of clean texts of a stratum that the learned rule may reject, and the chance to miss that.
RISK, ERROR = 0.01, 0.05
#: Shares of clean texts beyond the candidate cutoffs, mild to strict; 0 is the largest value met.
LEVELS = (0.0, 0.001, 0.002, 0.005, 0.01)
LEARN_FOLDS, TEST_FOLDS = (1,), (2, 3, 4)
#: Strata whose cutoffs (some 100 bytes each) are sent to all tasks; beyond, they are joined, each hot stratum in SALTS parts.
SENT_STRATA, SALTS = 10_000, 64
SPACE, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
METRICS = ("symbol_share", "dup_line_share", "repeat_share", "upper_share", "long_words", "short_words")
_M = np.uint64(0x9E3779B97F4A7C15)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words that lie in a window of ``size`` words which the text has at least twice."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    w = h[:n].copy()
    for i in range(1, size):
        w = w * _M + h[i : n + i]
    order = np.argsort(w)
    s = w[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + size, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The values of COUNTS for one text."""
    if not text:
        return (0,) * len(COUNTS)
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [l for l in text.split("\n") if l.strip(SPACE)]
    lower = text.lower()
    upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÂÄÇÉÈÊËÎÏÍÓÔÖÑÙÛÜÚ")) if lower != text else 0
    chars = len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines), upper, max(0, chars - symbols)


def counts(docs: DataFrame, keep: list[str], stratum: Column) -> DataFrame:
    """(_keep struct, doc_id, stratum, COUNTS) of every text."""
    own = beside(docs, keep, docs["doc_id"].alias("doc_id"), F.coalesce(stratum.cast("string"), F.lit("none")).alias("stratum"), docs["text"].cast("string").alias("_text"))
    schema = own.drop("_text").schema
    for c in COUNTS:
        schema = schema.add(c, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = np.array([measure(t) for t in texts(b, "_text")], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), *(pa.array(c) for c in m.T.copy())], names=["_keep", "doc_id", "stratum", *COUNTS])

    return own.mapInArrow(run, schema)


def metrics() -> dict[str, Column]:
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    mean = ratio("word_chars", "n_words")
    return {"symbol_share": ratio("n_symbols", "word_chars"), "dup_line_share": ratio("n_dup_lines", "n_lines"), "repeat_share": ratio("n_repeat_words", "n_words"), "upper_share": ratio("n_upper", "n_letters"), "long_words": mean, "short_words": -mean}


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p), exactly summed in logarithms."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def certify(tested: dict[str, tuple[int, list[int]]], risk: float = RISK, error: float = ERROR) -> dict[str, int]:
    """For each stratum (clean texts, falsely rejected by each rule, mild to strict): the last certified rule, or -1."""
    out = {}
    for s, (n, wrong) in tested.items():
        out[s] = -1
        for i, k in enumerate(wrong):
            if not n or k > n * risk or binomial_tail(k, n, risk) > error / max(1, len(tested)):
                break
            out[s] = i
    return out


def ladder(seen: np.ndarray, good: np.ndarray, weight: np.ndarray, risk: float, levels: int = len(LEVELS)) -> list[np.ndarray]:
    """Rules, mild to strict: for each metric the number of cutoffs, mildest first, that a rejected text is beyond, or 0 for no cutoff.

    ``seen`` has for each pattern and metric how many cutoffs its texts are beyond, counted from the mildest, so a
    text is rejected by cutoff j if it is beyond at least ``levels + 1 - j`` of them; ``good`` and ``weight`` are the
    label and the texts of each pattern. Without any bad text, metrics get their mildest cutoffs in their order.
    """
    rule, out = np.zeros(seen.shape[1], int), []
    if good.all():
        for m in range(seen.shape[1]):
            rule[m] = 1
            out.append(rule.copy())
        return out
    rejected = np.zeros(len(seen), bool)
    all_good, all_bad = max(1, weight[good].sum()), max(1, weight[~good].sum())
    while True:
        best = None
        for m in range(seen.shape[1]):
            for j in range(rule[m] + 1, levels + 1):
                more = rejected | beyond(seen[:, m], j, levels)
                gain, cost = (weight[more & ~rejected & ~good].sum(), weight[more & ~rejected & good].sum())
                if weight[more & good].sum() <= risk * all_good and gain / all_bad > cost / all_good:
                    key = (gain / (cost + 1), -m, -j)
                    if best is None or key > best[0]:
                        best = (key, m, j, more)
        if best is None:
            return out
        _, m, j, rejected = best
        rule[m] = j
        out.append(rule.copy())


def beyond(seen: np.ndarray, j: int, levels: int = len(LEVELS)) -> np.ndarray:
    """Cutoffs get smaller from the mildest on, so a text beyond the mildest is beyond all ``levels``."""
    return (seen >= levels + 1 - j) if j else np.zeros(len(seen), bool)


def by_stratum(rows: DataFrame, table: DataFrame, strata: int, how: str = "inner") -> DataFrame:
    """``rows`` with the one row that ``table`` has for their stratum, whatever share of the rows one stratum has."""
    if strata <= SENT_STRATA:
        return rows.join(F.broadcast(table), "stratum", how)
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.floor(F.rand(1) * SALTS).cast("int")).join(salted.hint("merge"), ["stratum", "_salt"], how).drop("_salt")


def learn(measured: DataFrame, labels: DataFrame, levels: tuple[float, ...] = LEVELS, risk: float = RISK, error: float = ERROR) -> tuple[DataFrame, int]:
    """(stratum, limits array<double>, ...) of the strata, null where a metric has no cutoff, and their number.

    ``measured``: doc_id, stratum, COUNTS; ``labels``: doc_id, quality. Further columns say what was certified: rules
    of the ladder and certified ones, clean texts tested and falsely rejected, bad texts on the test folds and rejected.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") == 1).alias("good"))
    m = metrics()
    rows = measured.withColumn("_fold", fold()).where(F.col("_fold").isin(*LEARN_FOLDS, *TEST_FOLDS) & ~base_failed())
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "stratum", F.col("_fold").isin(*TEST_FOLDS).alias("test"), *(m[k].alias(k) for k in METRICS))
    rows = stage(rows.join(known, "doc_id").drop("doc_id"), "quality-labelled")
    clean = rows.where("good and not test")
    cuts = stage(clean.groupBy("stratum").agg(*(F.percentile_approx(k, [1 - x for x in levels], 20_000).alias(f"cut_{k}") for k in METRICS)), "quality-cutoffs")
    strata, tested = cuts.count(), max(1, rows.where("good and test").select("stratum").distinct().count())
    own = by_stratum(rows, cuts, strata)
    over = [sum((F.col(k) > F.col(f"cut_{k}")[i]).cast("int") for i in range(len(levels))).alias(f"over_{k}") for k in METRICS]
    patterns = own.select("stratum", "test", "good", *over).groupBy("stratum", "test", "good", *(f"over_{k}" for k in METRICS)).agg(F.count("*").alias("n"))
    # A stratum has at most (levels + 1) ** 6 patterns, however many texts.
    ddl = "stratum string, chosen array<int>, rules int, certified int, clean long, wrong long, bad long, caught long"

    def choose(key, table):
        p = table.to_pandas()
        seen, good, test, n = p[[f"over_{k}" for k in METRICS]].to_numpy(int), p["good"].to_numpy(bool), p["test"].to_numpy(bool), p["n"].to_numpy(np.int64)
        rules = ladder(seen[~test], good[~test], n[~test], risk, len(levels))
        hit = [np.logical_or.reduce([beyond(seen[:, i], j, len(levels)) for i, j in enumerate(r)]) for r in rules]
        wrong, clean_n = [int(n[test & good & h].sum()) for h in hit], int(n[test & good].sum())
        k = certify({"": (clean_n, wrong)}, risk, error / tested)[""] + 1
        caught = int(n[test & ~good & hit[k - 1]].sum()) if k else 0
        chosen = rules[k - 1] if k else np.zeros(len(METRICS), int)
        row = {"stratum": key[0].as_py(), "chosen": chosen.tolist(), "rules": len(rules), "certified": k, "clean": clean_n, "wrong": wrong[k - 1] if k else 0, "bad": int(n[test & ~good].sum()), "caught": caught}
        types = [pa.string(), pa.list_(pa.int32()), pa.int32(), pa.int32(), *[pa.int64()] * 4]
        return pa.table({c: pa.array([v], t) for (c, v), t in zip(row.items(), types, strict=True)})

    chosen = patterns.groupBy("stratum").applyInArrow(choose, ddl)
    limits = F.array(*[F.when(F.col("chosen")[i] > 0, F.get(f"cut_{k}", F.col("chosen")[i] - 1)) for i, k in enumerate(METRICS)])
    out = stage(chosen.join(cuts, "stratum").select("stratum", limits.alias("limits"), "rules", "certified", "clean", "wrong", "bad", "caught"), "quality-limits")
    unstage(rows, cuts)
    return out, strata


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: Column | None = None, keep: list[str] | None = None, levels: tuple[float, ...] = LEVELS, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """Columns ``keep`` of ``docs``, the counts, base_failed, kept and ``reason`` (base, the first metric beyond its limit, or null)."""
    measured = stage(counts(docs, keep or ["doc_id"], stratum if stratum is not None else docs["lang"]), "quality-counts")
    limits, strata = learn(measured, labels, levels, risk, error)
    ruled = by_stratum(measured, limits.where("certified > 0").select("stratum", "limits"), strata, "left")
    reason, m = F.lit(None).cast("string"), metrics()
    for j, k in reversed(list(enumerate(METRICS))):
        reason = F.when(m[k] > F.col("limits")[j], F.lit(k)).otherwise(reason)
    reason = F.when(base_failed(), F.lit("base")).otherwise(reason)
    return ruled.select("_keep.*", *COUNTS[:5], base_failed().alias("base_failed"), reason.isNull().alias("kept"), reason.alias("reason"))


def op3_quality(spark, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
