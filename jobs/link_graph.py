"""Keeps a document graph up to date with a growing folder of crawled pages.

    python -m jobs.link_graph --pages PAGES --out OUT --checkpoint CHECKPOINT [--config jobs/link_graph.yaml]

PAGES: a folder, file or pattern of Parquet files (page_id long, url string, html string). A file stream takes the files that earlier runs haven't seen, some at a time, and its checkpoint
remembers them. OUT/vertices (title, seq, page_id, name, degree) and OUT/edges (src, dst) are partitioned by bucket; a batch replaces the buckets that its pages
and links fall in. A batch that failed is taken again and gives the same tables, since the upsert is one of sets. OUT/statistics holds one row about the whole graph.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession, functions as F

from dendra.operators.graph import degree_statistics, edges_from_lists
from dendra.operators.links import html_links
from dendra.operators.shared import cut
from dendra.operators.stores import GraphStore
from jobs.common import command

log = logging.getLogger("jobs.link_graph")
PATHS = {"pages": "folder of crawled pages", "out": "folder of the graph", "checkpoint": "folder that remembers the files taken"}
DEFAULTS = {"buckets": 64, "files_per_batch": 100, "hub_degree": 3000}
SCHEMA = "page_id long, url string, html string"
ATTRIBUTES = "page_id long, name string"


def parsed(pages: DataFrame) -> DataFrame:
    """(title, seq, page_id, name, has_html, links) of pages: a page is named by its address, a later page_id is a later visit of it."""
    name = F.nullif(F.trim(F.regexp_extract("html", r"(?is)<title>\s*([^<]*)", 1)), F.lit(""))
    links = F.coalesce(html_links(F.col("url"), F.col("html")), F.array().cast("array<string>"))
    return pages.select(F.col("url").alias("title"), F.coalesce("page_id", F.lit(-1)).alias("seq"), "page_id", name.alias("name"), F.col("html").isNotNull().alias("has_html"), links.alias("links"))


def run(spark: SparkSession, pages: str, out: str, checkpoint: str, buckets: int = 64, files_per_batch: int = 100, hub_degree: int = 3000) -> dict:
    """Takes new pages into the document graph; returns what was read and what the graph has now.

    Pages without an address are left out and counted; pages without html become vertices without links. Of several visits of an address the
    one with the largest page_id names the vertex, and links that any visit had stay.
    """
    store = GraphStore(spark, out, ATTRIBUTES, buckets)
    read = {"batches": 0, "pages": 0, "without_url": 0, "without_html": 0, "links": 0}

    def take(batch: DataFrame, number: int) -> None:
        rows = cut(parsed(batch))
        counts = [F.count("*").alias("pages"), F.count_if(F.col("title").isNull()).alias("without_url"), F.count_if(~F.col("has_html")).alias("without_html")]
        some = rows.agg(*counts, F.coalesce(F.sum(F.size("links")), F.lit(0)).alias("links")).first().asDict()
        touched = store.upsert(rows, edges_from_lists(rows, "links"))
        log.info("batch %d: read %s, wrote %d of %d buckets", number, some, len(touched), store.buckets)
        read["batches"] += 1
        for k, v in some.items():
            read[k] += v

    # a stream takes single files only by a pattern; this one names the same file or folder
    pages = pages if set(pages) & set("*?[{") else f"{pages.rstrip('/')[:-1]}[{pages.rstrip('/')[-1]}]"
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(pages)
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    degree = store.vertices().select("degree")
    hubs = F.lit(degree.where(F.col("degree") > hub_degree).count())
    degree_statistics(degree).withColumn("hubs", hubs).write.mode("overwrite").parquet(f"{out}/statistics")
    written = spark.read.parquet(f"{out}/statistics").first().asDict()
    log.info("read %s from %s", read, pages)
    log.info("%s holds %s", out, written)
    return {"read": read, "graph": written}


if __name__ == "__main__":
    command("link_graph", run, PATHS, DEFAULTS)
