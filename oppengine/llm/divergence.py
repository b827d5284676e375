"""How far each source's words are from those of the other sources of its language (operator 13).

The divergence of two groups (lang, source) is a sum over all kept terms of the language, but each group has only few
of them. So the sum is taken by inclusion and exclusion over the groups' supports: a term of one group alone is priced
by that group's histogram of counts, against the other group's price of a count of zero; a term of neither group has
one constant price; and only terms that both groups have are joined, posting by posting, to put right what the two
histograms and the constant have said about them. The sums are exact: prices are whole numbers below 2**30 + 1, the
only products that could pass 64 bits are taken as decimals.

Texts are read once. A task counts its rows' terms in one dictionary of bounded size, so that a hot group or a common
term meets in the shuffle as one row a task; one shuffle by (lang, term) gives both counts and document frequencies.

Defined cases: null text, lang and source are ''; groups without a term have pairs (of value 0 where the language
keeps no term) and no terms; repeated rows are documents of their own; empty tables give no rows; other columns are
not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import read_table, stage

#: A language keeps the terms of so many of its documents or more; a group lists so many terms.
LEAST_DOCUMENTS, TOP_TERMS = 10, 10
#: Prices are parts of this whole; what is added to each count.
WHOLE, PRIOR = 1_000_000_000, 2
#: Different (lang, source, term) that a task counts before it hands them on.
HELD_COUNTS = 400_000
#: Every ASCII byte that is no letter becomes a blank, A-Z become a-z; other bytes belong to letters beyond ASCII.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, c, d): occurrences and documents by group and term; each group also has a row of the term ''."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (c, d) in held.items():
            terms = list(c)
            for at in range(0, len(terms), 50_000):
                own = terms[at : at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(own), pa.string()), pa.array([source] * len(own), pa.string()), pa.array(own, pa.binary()).cast(pa.string()), pa.array([c[t] for t in own], pa.int64()), pa.array([d[t] for t in own], pa.int64())],
                    names=["lang", "source", "term", "c", "d"],
                )
        held.clear()

    for b in batches:
        for text, lang, source in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            c, d = held.setdefault((lang, source), (Counter({b"": 0}), Counter()))
            words = text.translate(_LETTERS).split()
            c.update(words)
            d.update(set(words))
        if sum(len(c) for c, _ in held.values()) >= HELD_COUNTS:
            yield from flush()
    yield from flush()


def postings(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, source, term, c): counts of kept terms, and a row of the term '' with 0 for each group."""
    part = docs.select(*[F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in ("text", "lang", "source")])
    part = part.mapInArrow(_counted, "lang string, source string, term string, c long, d long").repartition("lang", "term")
    each = part.groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))
    documents = F.sum("d").over(Window.partitionBy("lang", "term"))
    return each.withColumn("d", documents).where((F.col("d") >= least) | (F.col("term") == "")).select("lang", "source", "term", "c")


def price(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(WHOLE * (count + PRIOR) / (total + PRIOR * terms)), exact beyond 64 bits."""
    wide = lambda c: c.cast("decimal(19,0)")
    over = F.lit(WHOLE).cast("decimal(10,0)") * wide(count + PRIOR)
    return F.lit(1) + F.call_function("div", over, wide(total + PRIOR * terms))


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) of all groups of ``docs`` (text, lang, source).

    Part ``pair`` has every other source of the language, part ``term`` the ``top`` terms that the group has more of
    than its language.
    """
    kept = stage(postings(docs, least), "postings")
    some = kept.where("term <> ''")
    terms = some.groupBy("lang", "term").agg(F.sum("c").alias("all_c"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_c").alias("all_n"))
    sums = kept.groupBy("lang", "source").agg(F.sum("c").alias("n"), F.count_if(F.col("term") != "").alias("own"))
    groups = sums.join(langs, "lang", "left").na.fill(0, ["v", "all_n"])
    groups = stage(groups.withColumn("zero", F.when(F.col("v") > 0, price(F.lit(0).cast("long"), F.col("n"), F.col("v")))), "groups")

    priced = some.join(groups.select("lang", "source", "n", "v", "zero"), ["lang", "source"]).select("lang", "source", "term", "c", "zero", price(F.col("c"), F.col("n"), F.col("v")).alias("p"))
    priced = stage(priced, "priced")
    other = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("q_zero"), F.col("own").alias("q_own"))
    # What one group has: its histogram of counts against a count of zero in each other group.
    bars = priced.groupBy("lang", "source", "p").agg(F.count("*").alias("k"))
    alone = bars.join(other.select("lang", "item", "q_zero"), "lang").where("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.col("k") * gap(F.col("p"), F.col("q_zero"))).alias("value"))
    mirrored = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    # What neither has: a constant, for as many terms as if the supports had nothing in common.
    neither = groups.select("lang", "source", "zero", "own", "v").join(other, "lang").where("source <> item")
    neither = neither.select("lang", "source", "item", F.when(F.col("v") > 0, (F.col("v") - F.col("own") - F.col("q_own")) * gap(F.col("zero"), F.col("q_zero"))).otherwise(0).alias("value"))
    # What both have: the right price in place of the two histograms', and one constant too few.
    a, b = priced.drop("c"), priced.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("zero").alias("q_zero"))
    right = gap(F.col("p"), F.col("q")) - gap(F.col("p"), F.col("q_zero")) - gap(F.col("zero"), F.col("q")) + gap(F.col("zero"), F.col("q_zero"))
    both = a.join(b, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(right).alias("value"))
    both = both.union(both.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pairs = alone.union(mirrored).union(neither).union(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    of_lang = terms.join(langs, "lang").select("lang", "term", price(F.col("all_c"), F.col("all_n"), F.col("v")).alias("q"))
    more = priced.join(of_lang, ["lang", "term"]).where("c > 0 and p > q").select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.withColumn("rank", F.row_number().over(w)).select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), "rank")
    return ranked(pairs, "pair").union(ranked(more, "term").where(F.col("rank") <= top))


def op13_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(read_table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10FFFF}]+') AS ts FROM documents),
occ AS (SELECT row, lang, source, unnest(ts) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS all_c FROM occ GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
grp AS (SELECT DISTINCT lang, source FROM docs),
lv AS (SELECT lang, count(*)::HUGEINT AS v, sum(all_c)::HUGEINT AS all_n FROM kept GROUP BY lang),
cnt AS (SELECT o.lang, o.source, o.term, count(*)::HUGEINT AS c FROM occ o JOIN kept USING (lang, term) GROUP BY ALL),
tot AS (SELECT g.lang, g.source, coalesce(sum(c), 0)::HUGEINT AS n FROM grp g LEFT JOIN cnt USING (lang, source) GROUP BY ALL),
p AS (
  SELECT t.lang, t.source, k.term, coalesce(c, 0) AS c, 1 + (1000000000 * (coalesce(c, 0) + 2)) // (n + 2 * v) AS p, 1 + (1000000000 * (k.all_c::HUGEINT + 2)) // (all_n + 2 * v) AS q
  FROM tot t JOIN kept k USING (lang) JOIN lv USING (lang) LEFT JOIN cnt USING (lang, source, term)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM every QUALIFY part = 'pair' OR rank <= 10
"""
