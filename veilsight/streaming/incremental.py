"""Unattended runs over what is new: a file stream of articles into batch-wise tables.

Each micro-batch adds one partition ``batch=N`` to every table, so what is written grows
with the new articles and not with the state. What is taken back is written too: removed
indicators as ids with the last batch they are removed from, and a refreshed dimension as a
snapshot that stands for all batches up to one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reference import Reference
from ..operators.store import latest_scans
from ..plans.jobs import TABLES, Run, empty_tables, run, run_articles
from ..session import written

ARTICLES = "article_idx long, url string, text string"
PAGES = "page_id long, url string, html string"


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _finished(spark: SparkSession, state: str) -> list[int]:
    path, fs = _path(spark, f"{state}/_finished")
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(path)) if fs.exists(path) else []


def _finish(spark: SparkSession, state: str, batch_id: int) -> None:
    path, fs = _path(spark, f"{state}/_finished/{batch_id}")
    fs.create(path, True).close()


def _add(rows: dict, state: str, batch_id: int) -> None:
    for name, df in rows.items():
        df.write.mode("overwrite").parquet(f"{state}/{name}/batch={batch_id}")


def _named(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    path, fs = _path(spark, folder)
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix))


def load_state(spark: SparkSession, state: str, before: int | None = None) -> dict:
    """The tables of all finished batches, or of those before a batch, without what has been removed."""
    done = [b for b in _finished(spark, state) if before is None or b < before]
    tables = {}
    for name, ddl in TABLES.items():
        rows = spark.read.schema(ddl + ", batch int").parquet(f"{state}/{name}")
        rows = rows.filter(F.col("batch").between(done[0], done[-1]))
        snapshots = [n for n in _named(spark, f"{state}/_snapshots/{name}", "upto=") if n <= done[-1]]
        if snapshots:
            base = spark.read.schema(ddl).parquet(f"{state}/_snapshots/{name}/upto={snapshots[-1]}")
            rows = base.withColumn("batch", F.lit(snapshots[-1])).unionByName(rows.filter(F.col("batch") > snapshots[-1]))
        tables[name] = rows
    if _named(spark, f"{state}/_removed", "upto="):
        gone = spark.read.schema("ioc_id string, upto int").parquet(f"{state}/_removed").groupBy("ioc_id").agg(F.max("upto").alias("upto"))
        drop = lambda t: t.join(gone.withColumnRenamed("ioc_id", "_id"), (t["ioc_id"] == F.col("_id")) & (t["batch"] <= F.col("upto")), "left_anti")
        sightings = drop(tables["sightings"])
        # a sighting may be made again later, so links go by the batch they came with
        lost = tables["sightings"].select("sighting_id", "batch").exceptAll(sightings.select("sighting_id", "batch"))
        for name in ("sighting_actors", "sighting_countries", "sighting_cves"):
            tables[name] = tables[name].join(lost, ["sighting_id", "batch"], "left_anti")
        tables |= {"iocs": drop(tables["iocs"]), "sightings": sightings}
    tables = {name: rows.select([c.split()[0] for c in TABLES[name].split(", ")]) for name, rows in tables.items()}
    tables["history"] = latest_scans(tables["history"])
    return tables


def forget(spark: SparkSession, state: str, ioc_ids: DataFrame) -> None:
    """Remove indicators, their sightings and links. Later batches may find them again."""
    last = _finished(spark, state)[-1]
    ioc_ids.select("ioc_id").distinct().write.mode("append").parquet(f"{state}/_removed/upto={last}")


def replace_table(spark: SparkSession, state: str, name: str, rows: DataFrame) -> None:
    """The state of a dimension from now on; later batches add to it. `rows` may come from load_state."""
    last = _finished(spark, state)[-1]
    columns = [c.split()[0] for c in TABLES[name].split(", ")]
    written(rows.select(columns), "snapshot").write.mode("overwrite").parquet(f"{state}/_snapshots/{name}/upto={last}")


def start_state(spark: SparkSession, state: str, initial: dict | None = None) -> None:
    """Tables to begin with, as batch -1; does nothing when the state exists."""
    if not _finished(spark, state):
        _add({**empty_tables(spark), **(initial or {})}, state, -1)
        _finish(spark, state, -1)


def process_batch(batch: DataFrame, batch_id: int, state: str, as_of: str, ref: Reference) -> None:
    """Add one micro-batch of articles. A batch repeated after a failure replaces its own partition."""
    spark = batch.sparkSession
    if batch_id in _finished(spark, state):
        return
    # of an address given twice the article with the largest index, then text, counts
    others = [c for c in batch.columns if c != "url"]
    last = batch.groupBy("url").agg(F.max_by(F.struct(*others), F.struct("article_idx", "text")).alias("a"))
    articles = written(last.select(*[F.col(f"a.{c}").alias(c) if c != "url" else F.col("url") for c in batch.columns]), "batch")
    done = run_articles(articles, articles.select("url"), load_state(spark, state, batch_id), F.lit(as_of), ref)
    _commit(spark, done, state, batch_id)


def process_pages(batch: DataFrame, batch_id: int, state: str, as_of: str, ref: Reference, export_to: str | None = None) -> None:
    """Add one micro-batch of pages: their links that are due, the articles among them, and exports below `export_to`."""
    spark = batch.sparkSession
    if batch_id in _finished(spark, state):
        return
    pages = written(batch, "pages")
    target = f"{export_to}/batch={batch_id}" if export_to else None
    _commit(spark, run(pages, None, pages, load_state(spark, state, batch_id), F.lit(as_of), ref, target), state, batch_id)


def _commit(spark: SparkSession, done: Run, state: str, batch_id: int) -> None:
    # An untouched table still gets its (empty) partition.
    _add({**{k: v for k, v in empty_tables(spark).items() if k not in done.delta}, **done.delta}, state, batch_id)
    _finish(spark, state, batch_id)


def article_stream(spark: SparkSession, articles_dir: str, max_files: int = 1000) -> DataFrame:
    """Article files not seen before."""
    return spark.readStream.schema(ARTICLES).option("maxFilesPerTrigger", max_files).parquet(articles_dir)


def page_stream(spark: SparkSession, pages_dir: str, max_files: int = 1000) -> DataFrame:
    """Page files not seen before."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", max_files).parquet(pages_dir)


def run_incremental(spark: SparkSession, articles: DataFrame, state: str, checkpoint: str, as_of: str,
                    ref: Reference, initial: dict | None = None, process=process_batch) -> None:
    """Process all of the stream that is new, then stop: of articles, or of pages with ``process=process_pages``."""
    start_state(spark, state, initial)
    query = (
        articles.writeStream.foreachBatch(lambda df, i: process(df, i, state, as_of, ref))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
