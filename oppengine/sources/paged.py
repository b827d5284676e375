"""Saved responses of paged search APIs as a data source, ``saved_api``.

A search is a folder of pages, ``<key>=<value>/.../page=<n>/count=<records>/``, each with one JSON document whose array
``records`` holds the page's records. A search is read as a client pages through it: from page 0 on, without a gap, up
to the first empty page, to the first short one where ``page_size`` says how long a full one is, and to ``limit``
records of a search. What need not be read is not opened: searches that a filter on their keys rules out, pages behind
the last one, and pages behind the limit.

A large search has as many folders as pages, and making and listing them takes longer than their records. So pages are
saved in blocks of ``BLOCK`` numbers, ``<key>=<value>/.../pages=<first>-<last>-<pages>-<fewest records>-<records>/``,
each page a line with its number, its count and its document. The folder name tells whether the search goes on behind
the block; a block is a partition, and pages of it that the search does not come to are not parsed.

The counts in the folder names tell the planner where a search ends, so every page is a partition of its own. Where
``least`` (a field and a number, which records with that field unknown pass too) comes before a limit, nobody knows
which page has the last record, so a search is one partition that stops when it has enough; so it is where a page has
no count. Filters on records are pushed into the reading tasks if there is no limit, which they would change otherwise. Keys are
texts.

The folder must be one that Arrow opens (local or shared files, hdfs, s3, gs). An unreadable page raises an error.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import qualified

_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
_COMPARED = {
    "EqualTo": lambda v, x: v == x, "GreaterThan": lambda v, x: v > x, "GreaterThanOrEqual": lambda v, x: v >= x,
    "LessThan": lambda v, x: v < x, "LessThanOrEqual": lambda v, x: v <= x, "In": lambda v, x: v in x,
    "StringStartsWith": lambda v, x: v.startswith(x),
}
#: Pages of so many numbers are saved together.
BLOCK = 128
_PLAIN = (T.StringType, T.LongType, T.IntegerType, T.DoubleType, T.BooleanType)


@dataclass
class Page:
    keys: dict[str, str | None]
    number: int
    count: int | None
    path: str


    @property
    def next(self) -> int | None:
        """The number of the page that follows, None if a search does not come to it."""
        return self.number + 1

    def ends(self, page_size: int | None) -> bool:
        return bool(page_size and self.count is not None and self.count < page_size)


@dataclass
class Block(Page):
    """Pages ``number`` to ``last``, if none is missing; ``count`` records in all, ``fewest`` in one."""

    last: int
    pages: int
    fewest: int

    @property
    def next(self) -> int | None:
        return self.last + 1 if self.pages == self.last - self.number + 1 else None

    def ends(self, page_size: int | None) -> bool:
        return self.next is None or self.fewest < max(page_size or 0, 1)


@dataclass
class Pages(D.InputPartition):
    """Pages of one search that a task reads in order, and the most records it takes."""

    pages: list[Page]
    take: int | None = None


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)


def listed(path: str) -> dict[tuple, list[Page]]:
    """The pages of each search below ``path``, in order, as far as they follow each other from 0 on."""
    from pyarrow import fs

    store, root = file_system(path)
    pages: dict[str, Page] = {}
    for f in store.get_file_info(fs.FileSelector(root, recursive=True)):
        parts = f.path[len(root) :].strip("/").split("/")
        if f.type != fs.FileType.File or any(p[:1] in "_." for p in parts):
            continue
        named = [p.split("=", 1) for p in parts[:-1] if "=" in p]
        keys = {k: None if v == _NO_VALUE else unquote(v) for k, v in named if k not in ("page", "pages", "count")}
        own, folder = dict(named), f.path.rsplit("/", 1)[0]
        if "pages" in own:
            first, last, many, fewest, count = map(int, own["pages"].split("-"))
            pages[folder] = Block(keys, first, count, folder, last, many, fewest)
        elif "page" in own:
            pages[folder] = Page(keys, int(own["page"]), int(own["count"]) if "count" in own else None, folder)
    searches: dict[tuple, list[Page]] = {}
    for p in sorted(pages.values(), key=lambda p: p.number):
        own = searches.setdefault(tuple(sorted(p.keys.items(), key=str)), [])
        if p.number == (own[-1].next if own else 0):
            own.append(p)
    return searches


def planned(pages: list[Page], page_size: int | None, limit: int | None, ordered: bool) -> list[Pages]:
    """The partitions of one search, a page or block each. ``ordered``: the limit counts records that only reading tells."""
    known = []
    for p in pages:
        if p.count == 0:
            break
        known.append(p)
        if p.ends(page_size):
            break
    if not known or limit == 0:
        return []
    if any(p.count is None for p in known) or (limit is not None and ordered):
        return [Pages(known, limit)]
    out, offset = [], 0
    for p in known:
        if limit is not None and offset >= limit:
            break
        out.append(Pages([p], None if limit is None else limit - offset))
        offset += p.count
    return out


def converted(v, kind: T.DataType):
    """A JSON value as a column's type; what doesn't fit is null."""
    if v is None:
        return None
    if isinstance(kind, T.StringType):
        return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    if isinstance(kind, T.BooleanType):
        return v if isinstance(v, bool) else None
    if isinstance(kind, (T.LongType, T.IntegerType)):
        return v if isinstance(v, int) and not isinstance(v, bool) else None
    if isinstance(kind, T.DoubleType):
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None
    if isinstance(kind, T.ArrayType):
        return [converted(x, kind.elementType) for x in v] if isinstance(v, list) else None
    if isinstance(kind, T.StructType):
        return tuple(converted(v.get(f.name), f.dataType) for f in kind.fields) if isinstance(v, dict) else None
    raise ValueError(f"saved_api has no columns of type {kind.simpleString()}")


class SavedApiReader(D.DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        number = lambda name: int(options[name]) if options.get(name) else None
        self.path, self.records, self.columns = options["path"], options["records"], schema
        self.page_size, self.limit = number("page_size"), number("limit")
        field, _, least = options.get("least", "").rpartition(":")
        self.least = (field, float(least)) if field else None
        self.keys = [k for k in options.get("keys", "").split(",") if k]
        self.on_keys: list[tuple[str, str, object]] = []
        self.on_records: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        self.on_keys, self.on_records = [], []
        kinds = {f.name: f.dataType for f in self.columns.fields}
        for f in filters:
            name, what = (getattr(f, "attribute", None) or (None,))[0], type(f).__name__
            if len(getattr(f, "attribute", ())) != 1 or name not in kinds or not isinstance(kinds[name], _PLAIN) or what not in (*_COMPARED, "IsNotNull"):
                yield f
            elif name in self.keys and isinstance(kinds[name], T.StringType):
                self.on_keys.append((name, what, getattr(f, "value", None)))
            elif self.limit is None and name not in (*self.keys, "page"):
                self.on_records.append((name, what, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[Pages]:
        out = []
        for pages in listed(self.path).values():
            if pages and all(passes(pages[0].keys.get(name), what, x) for name, what, x in self.on_keys):
                out += planned(pages, self.page_size, self.limit, self.least is not None)
        return out or [Pages([], 0)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        store, _ = file_system(self.path)
        taken = 0
        for p, documents in (x for own in partition.pages for x in self.opened(store, own)):
            if partition.take is not None and taken >= partition.take:
                return
            found = 0
            for text in documents:
                own = json.loads(text).get(self.records) or []
                found += len(own)
                for r in own:
                    row = self.row(r, p)
                    if row is not None and (partition.take is None or taken < partition.take):
                        taken += 1
                        yield row
            if p.count is None and (not found or self.page_size and found < self.page_size):
                return

    def opened(self, store, p: Page) -> Iterator[tuple[Page, Iterable[bytes]]]:
        """The pages that a search comes to, each with its documents."""
        if not isinstance(p, Block):
            yield p, contents(store, p.path)
            return
        lines = [line.split(b" ", 2) for text in contents(store, p.path) for line in text.split(b"\n") if line]
        for i, (number, _, text) in enumerate(sorted(lines, key=lambda x: int(x[0]))):
            if int(number) != p.number + i:
                return
            yield Page(p.keys, int(number), None, p.path), [text]

    def row(self, record: dict, page: Page) -> tuple | None:
        if self.least and record.get(self.least[0]) is not None and record[self.least[0]] < self.least[1]:
            return None
        own = record | page.keys | {"page": page.number}
        row = {f.name: converted(own.get(f.name), f.dataType) for f in self.columns.fields}
        return tuple(row.values()) if all(passes(row[name], what, x) for name, what, x in self.on_records) else None


def contents(store, folder: str) -> Iterator[bytes]:
    from pyarrow import fs

    for f in sorted(store.get_file_info(fs.FileSelector(folder)), key=lambda f: f.path):
        if f.type == fs.FileType.File and f.base_name[:1] not in "_.":
            with store.open_input_stream(f.path) as s:
                yield s.read()


def passes(v, what: str, x) -> bool:
    """Whether a value passes a filter; null passes none."""
    return v is not None and (what == "IsNotNull" or _COMPARED[what](v, x))


class SavedApi(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "saved_api"

    def schema(self):
        raise ValueError("saved_api needs a schema")

    def reader(self, schema: T.StructType) -> SavedApiReader:
        return SavedApiReader(self.options, schema)


def read_saved_api(
    spark: SparkSession, path: str, records: str, schema: str, keys: list[str] | None = None, page_size: int | None = None, limit: int | None = None, least: tuple[str, float] | None = None, where: str | None = None,
) -> DataFrame:
    """Records of the saved pages below ``path``; columns named in ``keys``, and ``page``, come from the folders.

    ``where`` is pushed into the source. Filters that come later are not: Spark 4.1 keeps the pushed filters of a
    Python source with the relation, so that two differently filtered uses of one DataFrame would see each other's.
    """
    spark.dataSource.register(SavedApi)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    r = spark.read.format("saved_api").schema(schema).option("path", qualified(spark, path)).option("records", records).option("keys", ",".join(keys or []))
    for name, v in (("page_size", page_size), ("limit", limit), ("least", least and f"{least[0]}:{least[1]}")):
        r = r.option(name, str(v)) if v is not None else r
    out = r.load()
    return (out.where(where) if where else out).observe(f"saved_api {uuid.uuid4().hex}", F.count(F.lit(1)).alias("records"))


def save_pages(df: DataFrame, path: str, records: str, keys: list[str], order: str, page_size: int, page: str | None = None) -> None:
    """Save ``df`` as searches by ``keys``, pages of so many rows in the order of a column, or by the page that column ``page`` names, in blocks."""
    w = Window.partitionBy(*keys).orderBy(order)
    at = F.col(page) if page else F.floor((F.row_number().over(w) - 1) / page_size)
    fields = [c for c in df.columns if c not in (*keys, page)]
    each = df.select(*keys, at.cast("int").alias("page"), F.struct(F.col(order).alias("_at"), F.struct(*fields).alias("r")).alias("x"))
    pages = each.groupBy(*keys, "page").agg(F.array_sort(F.collect_list("x")).alias("x"))
    body = F.to_json(F.struct(F.col("x.r").alias(records)))
    block, count = Window.partitionBy(*keys, "block"), F.size("x")
    named = F.concat_ws("-", F.min("page").over(block), F.max("page").over(block), F.count(F.lit(1)).over(block), F.min("count").over(block), F.sum("count").over(block))
    pages = pages.select(*keys, "page", F.floor(F.col("page") / BLOCK).alias("block"), count.alias("count"), F.concat_ws(" ", "page", count, body).alias("value"))
    pages.select(*keys, named.alias("pages"), "value").write.partitionBy(*keys, "pages").text(path)
