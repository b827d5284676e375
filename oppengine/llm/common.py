"""Helpers shared by the corpus operators: shared working folder, staged tables, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one beside the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{quote(name, safe='')}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, **options: object) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors. ``options``: the writer's."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def unstage(*frames: DataFrame) -> None:
    """Delete tables made by ``stage`` once nothing reads them any more."""
    for df in frames:
        path = getattr(df, "_staged_path", None)
        if path:
            remove_path(df.sparkSession, path)


def remove_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def fold(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; 0 is the held-out fold. Null ids are never held out (fold -1)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(5)), F.lit(-1)).cast("int")


def quoted(name: str) -> Column:
    """The column of that name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def beside(docs: DataFrame, keep: list[str], *more: Column) -> DataFrame:
    """The columns ``keep`` in one struct ``_keep``, so that their names never meet those of ``more``; undone by ``"_keep.*"``."""
    return docs.select(F.struct(*map(quoted, keep)).alias("_keep"), *more)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def spanning_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the graph given as two arrays of node ids (star edges to each tree's smallest node)."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[ia], label[ib])
        new = label.copy()
        np.minimum.at(new, label[ia], low)
        np.minimum.at(new, label[ib], low)
        while True:  # pointer jumping
            nxt = new[new]
            if np.array_equal(nxt, new):
                break
            new = nxt
        new = new[label]
        if np.array_equal(new, label):
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


EDGE_SCHEMA = "a long, b long"
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_FOREST_ROWS = 1_000_000
#: Edges of a contracted graph that one task may finish.
FINISH_EDGES = 1_000_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Thin one partition's edges to spanning forests, a bounded number of edges at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        x, y = spanning_edges(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], schema=_EDGES)

    for batch in batches:
        held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
        size += batch.num_rows
        if size >= _FOREST_ROWS:
            out = flush()
            yield out
            held, size = [], 0
    if held:
        yield flush()


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, smallest node of its component) of a graph that is known to be small."""
    held = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
    if not held:
        return
    a, b = (np.concatenate(x) for x in zip(*held, strict=True))
    x, y = spanning_edges(a, b)
    roots = np.setdiff1d(np.concatenate([a, b]), x)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x, roots]), pa.int64()), pa.array(np.concatenate([y, roots]), pa.int64())], schema=_EDGES)


def components(edges: DataFrame, finish_edges: int = FINISH_EDGES, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a long, b long) -> (node, component = smallest node of the component).

    Partitions are thinned to spanning forests, then every round hooks each node to its neighbour of least hashed rank
    and contracts the graph, so that paths shrink by a constant factor a round whatever their order. Once no more
    than ``finish_edges`` edges are left (16 bytes each, a fixed bound), one task finishes them. Nothing is collected
    but one count a round. Nodes without an edge do not appear; null ends are ignored.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    e = stage(e.mapInArrow(_forest, EDGE_SCHEMA).distinct(), "edges")
    labels: DataFrame | None = None
    for _ in range(max_rounds):
        last = e.count() <= finish_edges
        if last:
            to = e.coalesce(1).mapInArrow(_finish, "node long, to long")
        else:
            both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
            to = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min(rank("b")), F.min(rank("a")))["n"].alias("to"))
        hook = stage(to, "hooks")
        if labels is None:
            new_labels = hook.select("node", F.col("to").alias("component"))
        else:
            moved = labels.join(hook.select(F.col("node").alias("component"), "to"), "component", "left")
            new_labels = moved.select("node", F.coalesce("to", "component").alias("component"))
        if last:
            break
        kept = stage(new_labels, "labels")
        ha, hb = hook.select(F.col("node").alias("a"), F.col("to").alias("ta")), hook.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        left = e.join(ha, "a").join(hb, "b").where("ta <> tb").select(F.col("ta").alias("a"), F.col("tb").alias("b"))
        nxt = stage(left.mapInArrow(_forest, EDGE_SCHEMA).distinct(), "edges")
        unstage(e, *([labels] if labels is not None else []))
        labels, e = kept, nxt
    else:
        raise RuntimeError("components did not converge")
    unstage(e)
    if labels is None:
        return new_labels
    low = new_labels.groupBy("component").agg(F.min("node").alias("low"))
    out = stage(new_labels.join(low, "component").select("node", F.col("low").alias("component")), "components")
    unstage(labels, hook)
    return out
