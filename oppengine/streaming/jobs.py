"""Jobs that run in the background: progress rows while a stream runs, and cancelling by tag.

Progress goes to a table with a row per micro-batch, written by a listener while the query runs, and once more from the
query's own record when it ends, as listeners may lag; a batch that is written twice gives the same row.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

_PROGRESS = "job string, batch long, rows long, failed long, finished_at string"


def observed(stream: DataFrame, error: str) -> DataFrame:
    """``stream`` that counts its rows, and those with a nonempty ``error``, for the progress table."""
    return stream.observe("progress", F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce(F.col(error), F.lit("")) != "").alias("failed"))


class ProgressTable(StreamingQueryListener):
    """Writes a row per micro-batch of the query named ``job`` below ``path``."""

    def __init__(self, spark: SparkSession, path: str, job: str):
        self.spark, self.path, self.job = spark, path, job
        self.written: set[int] = set()
        self.lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name == self.job:
            self.record(p.batchId, p.observedMetrics.get("progress"), p.timestamp)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def record(self, batch: int, counts, at: str) -> None:
        with self.lock:
            if counts is None or batch in self.written:
                return
            row = (self.job, batch, counts["rows"], counts["failed"], at)
            self.spark.createDataFrame([row], _PROGRESS).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/job-{self.job}/{batch}")
            self.written.add(batch)


def run_with_progress(spark: SparkSession, stream: DataFrame, job: str, checkpoint: str, sink: Callable[[DataFrame, int], None], path: str) -> None:
    """Process what is there, with a progress table below ``path``; ``stream`` is ``observed``."""
    table = ProgressTable(spark, path, job)
    spark.streams.addListener(table)
    try:
        query = stream.writeStream.queryName(job).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        for p in query.recentProgress:
            table.record(p.batchId, p.observedMetrics.get("progress"), p.timestamp)
    finally:
        spark.streams.removeListener(table)


def progress_rows(spark: SparkSession, path: str, totals: dict[str, int] | None = None) -> DataFrame:
    """(job, batch, rows, failed, completed, percent): what each job has done by each batch; the percent of its total, or of what is recorded."""
    rows = spark.read.schema(_PROGRESS).option("recursiveFileLookup", True).parquet(path)
    w = Window.partitionBy("job")
    total = F.sum("rows").over(w)
    for job, n in (totals or {}).items():
        total = F.when(F.col("job") == job, n).otherwise(total)
    done = F.sum("rows").over(w.orderBy("batch"))
    return rows.select("job", "batch", "rows", "failed", done.alias("completed"), F.floor(100 * done / F.greatest(total, F.lit(1))).cast("int").alias("percent"))


class Jobs:
    """Items that a background thread computes one after the other, each written below ``path``.

    ``flag`` marks a job as cancelled and nothing more: its work goes on, and what it finishes is recorded. ``cancel``
    also ends what is running under the job's tag; what was finished before stays. Other jobs are not touched.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.state: dict[str, str] = {}
        self.items: dict[str, int] = {}
        self.errors: dict[str, str] = {}
        self.threads: dict[str, threading.Thread] = {}
        self.stopped: dict[str, threading.Event] = {}

    def start(self, job: str, items: dict[str, Callable[[], DataFrame]]) -> None:
        sc, stop = self.spark.sparkContext, threading.Event()
        self.state[job], self.items[job], self.stopped[job] = "running", len(items), stop

        def work() -> None:
            sc.addJobTag(self.tag(job))
            sc.setInterruptOnCancel(True)
            try:
                for name, build in items.items():
                    if stop.is_set():
                        return
                    build().write.mode("overwrite").parquet(f"{self.path}/job={job}/item={name}")
                if self.state[job] == "running":
                    self.state[job] = "completed"
            except Exception as e:  # what ends the work is the job's error, unless it was asked to end
                if not stop.is_set():
                    self.state[job], self.errors[job] = "failed", str(e)[:500]
            finally:
                sc.removeJobTag(self.tag(job))

        self.threads[job] = InheritableThread(work)
        self.threads[job].start()

    def tag(self, job: str) -> str:
        return f"job-{job}"

    def flag(self, job: str) -> None:
        if self.state.get(job) == "running":
            self.state[job] = "cancelled"

    def cancel(self, job: str, seconds: float = 30) -> bool:
        """Ask until the job's thread has ended, as what is about to start is not running yet; whether it has."""
        self.flag(job)
        self.stopped[job].set()
        until = time.monotonic() + seconds
        while time.monotonic() < until:
            self.spark.sparkContext.cancelJobsWithTag(self.tag(job))
            if self.wait(job, 0.2):
                return True
        return False

    def wait(self, job: str, seconds: float | None = None) -> bool:
        """Whether the job's thread has ended."""
        self.threads[job].join(seconds)
        return not self.threads[job].is_alive()

    def finished(self, job: str) -> list[str]:
        """Items whose results are whole."""
        jvm = self.spark._jvm.org.apache.hadoop.fs
        folder = jvm.Path(f"{self.path}/job={job}")
        store = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [x.getPath() for x in store.listStatus(folder)] if store.exists(folder) else []
        return sorted(p.getName().removeprefix("item=") for p in found if store.exists(jvm.Path(p, "_SUCCESS")))

    def snapshot(self, job: str) -> dict[str, object]:
        done = self.finished(job)
        return {"job": job, "state": self.state[job], "done": self.state[job] != "running", "completed": len(done), "percent": 100 * len(done) // max(1, self.items[job]), "items": done, "error": self.errors.get(job)}
