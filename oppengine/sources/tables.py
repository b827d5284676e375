"""Readers and writers. Schemas are always given, never inferred."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.url import extract_urls, normalize_url
from ..schema import EXPORT_COLUMNS, RESULTS, conform


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share: ``spark.checkpoint.dir``, or beside the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of the file system that Spark finds it on, as others than Spark need it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return "file://" + whole.removeprefix("file:") if whole.startswith("file:/") and not whole.startswith("file://") else whole


def staged(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back, where several reads have to see the same rows.

    With ``by``, it is a table in buckets of that column, so that joins on it move only their other side.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    if by is None:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    kept = path.rsplit("/", 1)[1].replace("-", "_")
    df.repartition(n, by).write.bucketBy(n, by).option("path", path).format("parquet").saveAsTable(kept)
    return spark.table(kept)


def load_results(spark: SparkSession, path: str) -> DataFrame:
    """All result rows in the 23-column contract, newest text timestamp first (nulls first)."""
    return conform(spark.read.schema(RESULTS).parquet(path)).orderBy(F.desc_nulls_first("extraction_timestamp"))


def load_processed(spark: SparkSession, path: str) -> DataFrame:
    urls = spark.read.schema(T.StructType().add("fund_url", "string")).parquet(path)
    return urls.where("fund_url is not null").select(normalize_url(F.col("fund_url")).alias("url_key")).distinct()


def single_row(df: DataFrame, defaults: dict[str, object] | None = None) -> DataFrame:
    """One configuration row, with defaults where a field is null or the column is missing."""
    have, defaults = set(df.columns), defaults or {}
    cols = [F.coalesce(df[c], F.lit(defaults[c])).alias(c) if defaults.get(c) is not None else df[c] for c in df.columns]
    return df.limit(1).select(*cols, *[F.lit(v).alias(c) for c, v in defaults.items() if c not in have])


def snapshot(config: DataFrame) -> DataFrame:
    """(config_snapshot): each configuration as JSON, as a run stores it, without its identity."""
    return config.drop("id", "updated_at").select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("config_snapshot"))


def stored_runs(runs: DataFrame) -> DataFrame:
    """Runs as they are read: texts and counts have defaults, the rest stays."""
    text, count = {"id": "", "started_at": "", "status": "unknown", "trigger": "scheduled"}, ("urls_discovered", "urls_new")
    cols = {c: F.coalesce(F.col(c).cast("string"), F.lit(v)) for c, v in text.items() if c in runs.columns}
    cols |= {c: F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in count if c in runs.columns}
    return runs.select(*[cols.get(c, F.col(c)).alias(c) for c in (*text, "finished_at", *count, "scrape_job_id", "error_message") if c in runs.columns])


def lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.where(F.col(key) == value).limit(1)


def read_pages(spark: SparkSession, path: str, as_of: Column | None = None, hours: int = 24) -> DataFrame:
    """The offline page store (url, html[, fetched_at]); with ``as_of``, only pages fetched within so many hours."""
    df = spark.read.parquet(path)
    if as_of is not None and "fetched_at" in df.columns:
        df = df.where(F.col("fetched_at") > as_of - F.make_dt_interval(F.lit(0), F.lit(hours)))
    return df


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """Items of feeds: title, link, pubDate."""
    schema = T.StructType().add("title", "string").add("link", "string").add("pubDate", "string")
    return spark.read.format("xml").schema(schema).option("rowTag", "item").load(path)


def read_api_pages(spark: SparkSession, path: str, schema: T.StructType, records: str) -> DataFrame:
    """Records of saved API responses (JSON documents), one row each; ``records`` names the array that holds them."""
    whole = T.StructType().add(records, T.ArrayType(schema))
    return spark.read.schema(whole).option("multiLine", True).json(path).select(F.explode(records).alias("r")).select("r.*")


def read_text_folder(spark: SparkSession, path: str) -> DataFrame:
    """(name, text, folder) of each .txt file under ``path``, in any depth; Spark's readers skip empty files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", True).load(path)
    return files.select(F.substring_index("path", "/", -1).alias("name"), F.col("content").cast("string").alias("text"), F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"))


def combined_text(files: DataFrame) -> DataFrame:
    """(folder, text, files, url): each folder's files in name order, each under a header; the URL comes from the first name with "_".

    A folder is one site's saved pages, as many as a crawl fetches (``crawl.BEST``), so its text fits in a row.
    """
    parts = F.array_sort(F.collect_list(F.struct("name", "text")))
    named = F.filter("p", lambda x: x["name"].contains("_"))
    folder = F.col("folder") if "folder" in files.columns else F.lit("").alias("folder")
    return files.select(folder, "name", "text").groupBy("folder").agg(parts.alias("p")).select(
        "folder", F.array_join(F.transform("p", lambda x: F.concat(F.lit("\n=== "), x["name"], F.lit(" ===\n"), x["text"])), "\n").alias("text"), F.size("p").alias("files"),
        F.when(F.size(named) > 0, F.concat(F.lit("https://"), F.substring_index(named[0]["name"], "_", 1))).otherwise("").alias("url"),
    )


def saved_domains(files: DataFrame) -> DataFrame:
    return files.select(F.lower(F.regexp_extract(F.input_file_name() if "path" not in files.columns else F.col("path"), r"([^/]+)/[^/]+$", 1)).alias("domain")).distinct()


def uploaded_urls(spark: SparkSession, path: str) -> DataFrame:
    """(url): every http(s) URL anywhere in uploaded text."""
    return spark.read.text(path).select(F.explode(extract_urls(F.col("value"))).alias("url"))


def write_results(df: DataFrame, path: str) -> None:
    conform(df).write.mode("append").parquet(path)


def write_fund_csv(df: DataFrame, path: str, domain: Column) -> None:
    """One folder per domain, with header; a domain with many rows is written by several tasks."""
    df.withColumn("domain", domain).hint("rebalance", "domain").write.mode("append").partitionBy("domain").option("header", True).option("escape", '"').csv(path)


def write_page_texts(df: DataFrame, path: str) -> int:
    """Each page of ``df`` (domain, name, text) as the file ``<domain>/<name>.txt`` with exactly its text; how many there are.

    Tasks write files that they alone have, so a repeated task writes the same ones again; of pages of one name, one is
    kept. The folder must be one that Arrow opens.
    """
    root = qualified(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        for b in batches:
            for folder, name, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                store.create_dir(f"{base}/{folder}", recursive=True)
                with store.open_output_stream(f"{base}/{folder}/{name}.txt") as out:
                    out.write((text or "").encode("utf-8"))
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    plain = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "[/\\x00]", "_")
    one = df.select(plain("domain").alias("domain"), plain("name").alias("name"), "text").groupBy("domain", "name").agg(F.min("text").alias("text"))
    return one.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_export(df: DataFrame, path: str, columns: list[str] = EXPORT_COLUMNS) -> None:
    """The results CSV: 22 columns, CRLF, quotes only where needed, arrays joined with ", "."""
    kinds = dict(df.dtypes)
    cols = [F.lit("").alias(c) if c not in kinds else (F.array_join(c, ", ") if kinds[c].startswith("array") else F.col(c).cast("string")).alias(c) for c in columns]
    df.select(*cols).write.option("lineSep", "\r\n").option("header", True).option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(path)


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("record"))
