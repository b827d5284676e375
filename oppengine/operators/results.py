"""Filters, sorts, groups, flags and exports of result rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.time import BUCKETS, date_bucket, parse_timestamp
from ..functions.url import safe_domain
from ..schema import ELIGIBILITY, EXPORT_COLUMNS
from ..sources.tables import staged


def matches_search(query: str, *columns: Column) -> Column:
    """The trimmed query is in any one of the columns, whatever the case; null, 0 and false are ''."""
    q = query.strip().lower()
    if not q:
        return F.lit(True)
    hit = lambda c: F.contains(F.lower(F.coalesce(c.cast("string"), F.lit(""))), F.lit(q))
    return reduce(lambda a, b: a | b, map(hit, columns))


def contains_any(query: str, *columns: Column) -> Column:
    """The query as it stands is in any one of the columns, whatever the case."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(query.lower())) for c in columns])


def eligible(label: Column, wanted: list[str]) -> Column:
    return F.coalesce(label, F.lit("")).isin(*wanted) if wanted else F.lit(True)


def at_least_or_unknown(c: Column, least: float) -> Column:
    return c.isNull() | (c >= least)


def min_funding(text: Column, least: float, strict_commas: bool = False) -> Column:
    return F.coalesce(X.funding_max(text, strict_commas) >= least, F.lit(False))


def open_deadline(text: Column, as_of: Column, strict: bool = False) -> Column:
    """Rolling, ongoing or open, or a date not before ``as_of`` (after it, if strict); null is false."""
    ts = parse_timestamp(text)
    late = ts > as_of if strict else ts >= as_of
    return F.coalesce(F.lower(text).rlike("rolling|ongoing|open") | F.coalesce(late, F.lit(False)), F.lit(False))


def from_source(c: Column, source: str) -> Column:
    return F.lit(True) if source == "all" else c == source


def filter_results(df: DataFrame, *, as_of: Column, search: str = "", labels: list[str] = (), only_open: bool = False, least_funding: float | None = None, source: str = "all", archived: DataFrame | None = None, variant: str = "page") -> DataFrame:
    """The conjunction of all result filters. ``variant="simple"`` has the alternate semantics: search in name, URL and
    notes without trimming, the last number as funding (rows without one pass), and deadlines strictly later."""
    if variant == "simple":
        cols = [df[c] for c in ("fund_name", "fund_url", "notes") if c in df.columns]
        out = df.where(contains_any(search, *cols)) if search and cols else df
    else:
        out = df.where(matches_search(search, *[df[c] for c in df.columns]))
    out = out.where(eligible(F.col("eligibility"), list(labels)))
    if only_open:
        out = out.where(open_deadline(F.col("deadline"), as_of, strict=variant == "simple"))
    if least_funding is not None:
        last = X.last_integer(F.col("funding_range"))
        out = out.where(at_least_or_unknown(last, least_funding) if variant == "simple" else min_funding(F.col("funding_range"), least_funding))
    out = out.where(from_source(F.col("discovery_source"), source))
    return out if archived is None else out.join(archived.select("fund_url").distinct(), "fund_url", "left_anti")


def active_filters(search: str = "", labels: list[str] = tuple(ELIGIBILITY), only_open: bool = False, least_funding: float | None = None, source: str = "all") -> int:
    """How many filters differ from the reset state (which selects every label)."""
    return sum([bool(search.strip()), set(labels) != set(ELIGIBILITY), only_open, least_funding is not None, source != "all"])


def sort_recent(ts: Column, deadline: Column | None, order: Column) -> list[Column]:
    """Newest first; without a timestamp the deadline counts, unless it is None (the alternate sort)."""
    others = [] if deadline is None else [parse_timestamp(deadline)]
    when = F.coalesce(parse_timestamp(ts), *others, F.timestamp_seconds(F.lit(0)))
    return [when.desc(), order.asc()]


def sort_alphabetical(name: Column, url: Column | None, order: Column, collation: str = "UNICODE_CI_AI") -> list[Column]:
    """By name, else URL; the alternate sort has no URL and the collation ``UNICODE``."""
    text = F.coalesce(X.first_nonempty(name, url) if url is not None else name, F.lit(""))
    return [F.collate(text, collation).asc(), order.asc()]


def sort_eligibility(label: Column, order: Column, ranks: list[str] = ELIGIBILITY) -> list[Column]:
    """Best first; unknown labels last (their number makes no difference to the order)."""
    return [X.eligibility_rank(label, ranks).asc(), order.asc()]


def newest(df: DataFrame, order: list[Column], n: int = 20) -> DataFrame:
    """The first ``n`` rows in the order."""
    return df.orderBy(*order).limit(n)


def last_reversed(df: DataFrame, ord: str, n: int = 5) -> DataFrame:
    """The ``n`` rows that came last, the last one first."""
    return newest(df, [F.desc(ord)], n)


def numbered(df: DataFrame, by: list[Column], name: str = "place") -> DataFrame:
    """A global place in the order: a range-partitioned sort, counts per partition, and a prefix sum over those.

    No task holds all rows, as a window without partitions would. The sorted rows are written with their partition
    and place in it, as two sorts of one table may cut it at different bounds. ``before`` has a row a partition.
    """
    whole = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]).alias("_row")
    sorted_rows = df.orderBy(*by).select(whole, F.monotonically_increasing_id().alias("_id"))
    part = F.shiftright("_id", 33)
    placed = staged(sorted_rows.select("_row", part.alias("_part"), (F.col("_id") - F.shiftleft(part, 33)).alias("_at")), "sorted")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    out = placed.join(F.broadcast(before), "_part")
    return out.select("_row.*", (F.col("_before") + F.col("_at") + 1).alias(name))


def group_by_eligibility(df: DataFrame, label: str = "eligibility", known: list[str] = ELIGIBILITY) -> DataFrame:
    """(label, position, n): fixed order, null and '' as Unknown last; other labels are dropped."""
    l = X.first_nonempty(df[label], F.lit("Unknown"))
    order = [*known, "Unknown"]
    return df.select(l.alias("label")).where(F.col("label").isin(*order)).groupBy("label").agg(F.count("*").alias("n")).select("label", (F.array_position(F.array(*map(F.lit, order)), F.col("label"))).cast("int").alias("position"), "n")


def group_by_date(df: DataFrame, ts: Column, as_of: Column) -> DataFrame:
    """(label, position, n) by date bucket."""
    g = df.select(date_bucket(ts, as_of).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    return g.select("label", F.array_position(F.array(*map(F.lit, BUCKETS)), F.col("label")).cast("int").alias("position"), "n")


def left_with_default(left: DataFrame, right: DataFrame, on: str, defaults: dict[str, object]) -> DataFrame:
    out = left.join(right, on, "left")
    return out.withColumns({c: F.coalesce(out[c], F.lit(v)) for c, v in defaults.items()})


def labelled(left: DataFrame, right: DataFrame, on: str, order: str, label: str, default: str, name: str = "label") -> DataFrame:
    """``left`` with the ``label`` of the first row (by ``order``) that ``right`` has for its key, else its own ``default``."""
    first = right.groupBy(on).agg(F.min_by(label, order).alias("_first"))
    out = left.join(first, on, "left")
    return out.select(*left.columns, F.coalesce("_first", default).alias(name))


def every_and_some(df: DataFrame, key: str, every: dict[str, Column], some: dict[str, Column]) -> DataFrame:
    """By key: does each of the conditions hold for every row, or for some row?"""
    return df.groupBy(key).agg(*[F.every(c).alias(n) for n, c in every.items()], *[F.some(c).alias(n) for n, c in some.items()])


def domain_counts(urls: DataFrame, url: str) -> DataFrame:
    """(domains, urls): distinct hosts, and all rows; what has no host counts as a row only."""
    return urls.agg(F.countDistinct(F.nullif(safe_domain(F.col(url)), F.lit("unknown"))).alias("domains"), F.count("*").alias("urls"))


def run_counts(candidates: DataFrame, known: DataFrame, on: str) -> DataFrame:
    """(discovered, fresh): candidates of a run, and those whose key is not known yet."""
    f = flagged(candidates.select(on), known, on, "_known")
    return f.agg(F.count("*").alias("discovered"), F.count_if(~F.col("_known")).alias("fresh"))


def flagged(df: DataFrame, keys: DataFrame, on: str, flag: str) -> DataFrame:
    """A boolean column: does the row's key appear in ``keys``?"""
    have = keys.select(on).distinct().withColumn(flag, F.lit(True))
    return df.join(have, on, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def selected(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys.select(on), on, "left_semi")


def without(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys.select(on), on, "left_anti")


def toggle(current: DataFrame, chosen: DataFrame, on: str) -> DataFrame:
    """All chosen keys leave the set if all are in it, else they enter it; decided in the plan, not on the driver."""
    missing = chosen.select(on).distinct().join(current.select(on), on, "left_anti").agg((F.count("*") == 0).alias("_all"))
    return (
        current.select(on).withColumn("_c", F.lit(1)).unionByName(chosen.select(on).withColumn("_c", F.lit(2)))
        .groupBy(on).agg(F.bool_or(F.col("_c") == 1).alias("_in"), F.bool_or(F.col("_c") == 2).alias("_chosen"))
        .join(F.broadcast(missing)).where(F.when(F.col("_all"), F.col("_in") & ~F.col("_chosen")).otherwise(True)).select(on)
    )


def export_line(df: DataFrame, columns: list[str] = EXPORT_COLUMNS) -> Column:
    """A row of ``df`` as one CSV line; arrays are joined with ", ", absent columns are blank."""
    kinds = dict(df.dtypes)

    def cell(c: str) -> Column:
        if c not in kinds:
            return F.lit("")
        return F.array_join(df[c], ", ") if kinds[c].startswith("array") else df[c].cast("string")

    return X.csv_line(*[cell(c) for c in columns])


def export_lines(df: DataFrame, columns: list[str] = EXPORT_COLUMNS) -> DataFrame:
    """(line): one CSV line per row."""
    return df.select(export_line(df, columns).alias("line"))


#: Sections of a record's details, each with its fields, in order.
DETAIL_SECTIONS = {
    "Funding Details": ["funding_range", "application_status", "deadline", "restrictions", "notes"],
    "Eligibility": ["eligibility", "eligibility_reason", "evidence"],
    "Scope & Audience": ["applicant_types", "geographic_scope", "beneficiary_focus"],
    "Source & Technical": ["pages_scraped", "visited_urls_count", "pdf_read", "pdf_pages", "pdf_url", "extraction_timestamp", "error", "source_folder", "Processed"],
}


def section_rules(spark: SparkSession, sections: dict[str, list[str]] | None = None) -> DataFrame:
    """(rank, section, field): ordered rules as a table; a field may be in several sections."""
    rows = [(i, name, f) for i, (name, fields) in enumerate((sections or DETAIL_SECTIONS).items()) for f in fields]
    return spark.createDataFrame(rows, "rank int, section string, field string")


def first_section(fields: DataFrame, rules: DataFrame) -> DataFrame:
    """``fields`` (…, field) with ``section`` of the first rule that has the field, null if none has, and that rule's ``rank``.

    The first rule of each field is found among the rules, so rows meet one rule at most, however many overlap.
    """
    first = rules.where("field is not null").groupBy("field").agg(F.min_by("section", "rank").alias("section"), F.min("rank").alias("rank"))
    return fields.join(first, "field", "left")


def sectioned(records: DataFrame, key: str, rules: DataFrame, ungrouped: str = "") -> DataFrame:
    """(key, rank, section, fields): the nonempty fields of each record by section, in the record's order; fields without a section last."""
    names = [c for c in records.columns if c != key]
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("field"), records[c].cast("string").alias("v")) for i, c in enumerate(names)])
    each = records.select(key, F.explode(cells).alias("c")).where("c.v is not null and c.v <> ''").select(key, "c.i", "c.field")
    got = first_section(each, rules).groupBy(key, "rank", "section").agg(F.array_sort(F.collect_list(F.struct("i", "field"))).alias("f"))
    return got.select(key, "rank", F.coalesce("section", F.lit(ungrouped)).alias("section"), F.transform("f", lambda x: x["field"]).alias("fields"))
