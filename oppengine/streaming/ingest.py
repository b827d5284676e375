"""Incremental behaviour as Structured Streaming: new rows, running progress, incremental sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.url import normalize_url
from ..operators.latest import latest_by
from ..operators.mutate import overlay


def read_stream(spark: SparkSession, path: str, like: DataFrame, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def new_rows(stream: DataFrame, key: str, event_time: str | None = None, watermark: str | None = None) -> DataFrame:
    """First row of each key. With a watermark, keys are forgotten after it, so state is bounded."""
    if event_time and watermark:
        return stream.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark([key])
    return stream.dropDuplicates([key])


def progress(stream: DataFrame, job: str, error: str | None = None) -> DataFrame:
    """(job, completed, failed) as completions arrive; use output mode update or complete."""
    failed = F.count_if(F.coalesce(F.col(error), F.lit("")) != "") if error else F.lit(0).cast("long")
    return stream.groupBy(job).agg(F.count("*").alias("completed"), failed.alias("failed"))


def running_progress(completions: DataFrame, job: str, finished: str, total: int | None = None) -> DataFrame:
    """Each completion with the count so far and the whole percent of the job's total."""
    w = Window.partitionBy(job).orderBy(finished)
    done = F.count("*").over(w.rowsBetween(Window.unboundedPreceding, 0))
    of = F.lit(total) if total is not None else F.count("*").over(Window.partitionBy(job))
    return completions.withColumn("completed", done).withColumn("percent", F.floor(100 * F.col("completed") / F.greatest(of, F.lit(1))).cast("int"))


def run_available(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process what is there, once: offsets advance only if ``sink`` succeeds."""
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


def to_memory(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def ingest_new_urls(spark: SparkSession, source_path: str, like: DataFrame, processed_path: str, checkpoint: str, url: str = "url") -> None:
    """Append candidates whose normalised URL is not yet processed; a repeated micro-batch writes the same keys again only if it never committed."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        known = spark.read.parquet(processed_path).select("url_key").distinct()
        keyed = batch.withColumn("url_key", normalize_url(F.col(url)))
        keyed.join(known, "url_key", "left_anti").dropDuplicates(["url_key"]).select("url_key").write.mode("append").parquet(processed_path)

    run_available(read_stream(spark, source_path, like), checkpoint, sink)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Finished versions of a state table (a handful of folder names)."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(folder):
        return []
    done = [x.getPath() for x in store.listStatus(folder)]
    names = [p.getName() for p in done if store.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))


def current_state(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest finished version of a state table, or of those before a batch."""
    found = [v for v in _versions(spark, path) if before is None or v < before]
    return spark.read.parquet(f"{path}/version={found[-1]}") if found else None


def overlay_sink(spark: SparkSession, path: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """A sink that overlays the last row of each key on the state table; keys that a batch doesn't have keep theirs.

    A batch writes its own version from the one before it, so a repeated batch gives the same state, and readers
    always find a whole one. Two versions are kept.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        new = latest_by(batch, F.col(key), F.lit(None).cast("timestamp"), F.col(order))
        old = current_state(spark, path, batch_id)
        (new if old is None else overlay(old, new, key)).write.mode("overwrite").parquet(f"{path}/version={batch_id}")
        for v in [v for v in _versions(spark, path) if v < batch_id][:-1]:
            p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={v}")
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)

    return sink


def recent_marks(rows: DataFrame, seen_at: str, as_of, seconds: int = 35) -> DataFrame:
    """Rows whose "new" mark has not expired."""
    return rows.where(F.col(seen_at) > as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds)))


def rotate(spark: SparkSession, path: str, run: int, ring: DataFrame, n: int, take: int, start: int = 0) -> DataFrame:
    """The rows of ``ring`` (position, …) that run number ``run`` takes, ``take`` of ``n`` from where the run before it stopped.

    Where to go on is a versioned state below ``path``: a run reads the newest version before its own, and writes its own
    after the rows it took, so a run that is repeated, or was broken off, takes the same rows again.
    """
    state = current_state(spark, f"{path}/state", run)
    at = start if state is None else state.first()["next_index"]
    taken = ring.where(F.pmod(F.col("position") - F.lit(at), F.lit(n)) < take)
    taken.withColumn("run", F.lit(run)).write.mode("overwrite").parquet(f"{path}/taken/version={run}")
    spark.createDataFrame([((at + take) % n,)], "next_index int").write.mode("overwrite").parquet(f"{path}/state/version={run}")
    return spark.read.parquet(f"{path}/taken/version={run}")
