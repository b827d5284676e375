"""Keyed state in streams: marks that expire by event time, and a page store with a bounded number of entries.

Both are stateful processors, so they need the RocksDB state store (``use_rocksdb``) and a checkpoint in the shared
folder. The rows of a key that come in one micro-batch are put in order before they are taken, which bounds what a
task holds of a hot key by what a trigger lets in (``maxFilesPerTrigger``); state itself is bounded per key.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: How long a row counts as new, and how many pages a store keeps for how long.
MARK_SECONDS, STORE_PAGES, STORE_HOURS = 35, 500, 24


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Marks(StatefulProcessor):
    """A key is new from its first row on, until a timer ends that; it is never new again."""

    def __init__(self, seconds: int):
        self.us = 1_000_000 * seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first = min((r["us"] for r in rows), default=None)
        if first is None or self.seen.exists():
            return
        self.seen.update((first,))
        self.handle.registerTimer(-(-(first + self.us) // 1000))  # timers have milliseconds
        yield Row(key=key[0], us=first, new=True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        (first,) = self.seen.get()
        yield Row(key=key[0], us=first + self.us, new=False)

    def close(self) -> None:
        pass


def expiring_marks(stream: DataFrame, key: str, at: str, seconds: int = MARK_SECONDS, lateness: str = "0 seconds") -> DataFrame:
    """(key, at, new): a row when a key becomes new, and one when the watermark has passed the end of that.

    A row is late, and ignored, if its time is before the watermark. Rows without a key or a time are ignored. State
    is a time per key ever seen, as a key that was seen once is never new again.
    """
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp").alias("at")).where("key is not null and at is not null")
    schema = StructType().add("key", "string").add("us", "long").add("new", "boolean")
    rows = rows.withColumn("us", F.unix_micros("at")).withWatermark("at", lateness)
    return rows.groupBy("key").transformWithState(_Marks(seconds), schema, "Append", "EventTime").select("key", F.timestamp_micros("us").alias("at"), "new")


def live_marks(changes: DataFrame) -> DataFrame:
    """(key, at) of the keys that are new after all ``changes``."""
    return changes.groupBy("key").agg(F.max_by("new", "at").alias("new"), F.max("at").alias("at")).where("new").drop("new")


class _Store(StatefulProcessor):
    """Pages in order of arrival: ``places`` has each page's number and time, ``bodies`` what was fetched.

    A micro-batch reads a store's places once (``pages`` rows at most) and only those bodies that it serves, and writes
    what has changed in the end.
    """

    def __init__(self, pages: int, hours: float):
        self.pages, self.us = pages, int(hours * 3_600_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.places = handle.getMapState("places", "url string", "number long, us long")
        self.bodies = handle.getMapState("bodies", "url string", "body string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = {u: tuple(at) for (u,), at in self.places.iterator()}
        held = dict(sorted(before.items(), key=lambda x: x[1][0]))  # the first of a dictionary came first
        next_ = max((number for number, _ in before.values()), default=-1) + 1
        served: dict[str, str] = {}  # bodies that were read, or fetched in this batch
        for us, number, url, body in sorted(((r["us"], r["number"], r["url"], r["body"]) for r in rows), key=lambda r: r[:2]):
            evicted = None
            hit = url in held and us - held[url][1] < self.us
            if hit:
                if url not in served:
                    (served[url],) = self.bodies.getValue((url,))
                body = served[url]
            else:
                held.pop(url, None)
                if body is not None:
                    if len(held) >= self.pages:
                        evicted = next(iter(held))
                        del held[evicted]
                        served.pop(evicted, None)
                    held[url], served[url] = (next_, us), body
                    next_ += 1
            yield Row(store=key[0], number=number, url=url, hit=hit, body=body, evicted=evicted)
        for url in before.keys() - held.keys():
            self.places.removeKey((url,))
            self.bodies.removeKey((url,))
        for url, at in held.items():
            if before.get(url) != at:
                self.places.updateValue((url,), at)
                self.bodies.updateValue((url,), (served[url],))

    def close(self) -> None:
        pass


def stored_pages(requests: DataFrame, pages: int = STORE_PAGES, hours: float = STORE_HOURS) -> DataFrame:
    """(store, number, url, hit, body, evicted) of ``requests`` (store, number, url, at, body), each answered by its store.

    ``body`` is what fetching the page would give at that time, null if it fails. A page that the store has had for less
    than ``hours`` is a hit and answered from there; otherwise it is fetched and stored as the newest, and the page that
    came first leaves a full store. Old pages leave when they are asked for again, or by that rule. Requests of a store
    are taken by time and number.
    """
    rows = requests.select(F.col("store").cast("string").alias("store"), F.col("number").cast("long").alias("number"), F.col("url").cast("string").alias("url"), F.unix_micros(F.col("at").cast("timestamp")).alias("us"), F.col("body").cast("string").alias("body"))
    rows = rows.where("store is not null and url is not null and us is not null")
    schema = StructType().add("store", "string").add("number", "long").add("url", "string").add("hit", "boolean").add("body", "string").add("evicted", "string")
    return rows.groupBy("store").transformWithState(_Store(pages, hours), schema, "Append", "None")
