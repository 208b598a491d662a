"""Pages reachable from a start page over stored links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from fiscolake.functions.html import main_text, page_description, page_links, page_text, page_title
from fiscolake.functions.urls import authority
from fiscolake.session import shared_path, written_table


def link_table(pages: DataFrame, host_suffix: str) -> DataFrame:
    """Edges ``src_url, dst_url``, one per link of a page, repeats included."""
    links = F.explode_outer(page_links(F.col("url"), F.col("html"), host_suffix))
    return pages.select(F.col("url").alias("src_url"), links.alias("dst_url")).where("dst_url IS NOT NULL")


def page_records(pages: DataFrame) -> DataFrame:
    """Page record: url, title, description, text."""
    html = F.col("html")
    return pages.select("url", page_title(html).alias("title"),
                        page_description(html).alias("description"), page_text(html).alias("text"))


def structured_pages(pages: DataFrame) -> DataFrame:
    """Main text with title, description and host; pages without text are dropped."""
    html = F.col("html")
    return pages.select("url", authority(F.col("url")).alias("host"), page_title(html).alias("title"),
                        page_description(html).alias("description"),
                        main_text(html).alias("text")).where("text <> ''")


def reachable(pages: DataFrame, start_url: str, host_suffix: str) -> DataFrame:
    """Urls of the stored pages that links lead to from ``start_url``, over pages
    whose url begins with it.

    Breadth first. Links are extracted once and written down, reduced to those
    a crawl could follow. Each round is one equi-join with the newest urls; its
    finds lose their repeats before they meet the stored and the seen urls, so
    a page everybody links to is one row there. Every round is a table in the
    shared folder.
    """
    spark = pages.sparkSession
    stored = written_table(pages.select("url").distinct(), "urls")
    followed = F.col("dst_url").startswith(start_url) & (F.col("src_url") != F.col("dst_url"))
    edges = written_table(link_table(pages, host_suffix).where(followed).distinct(), "edges")
    seen_path = shared_path(spark, "seen")

    newest = stored.where(F.col("url") == start_url)
    round_no = 0
    while True:
        counted = Observation()
        (newest.withColumn("round", F.lit(round_no)).observe(counted, F.count(F.lit(1)).alias("n"))
         .write.mode("append").partitionBy("round").parquet(seen_path))
        seen = spark.read.schema("url string, round int").parquet(seen_path)
        if counted.get["n"] == 0:
            return seen.select("url")
        last = seen.where(F.col("round") == round_no).select("url")
        found = (edges.join(last.withColumnRenamed("url", "src_url"), "src_url", "left_semi")
                 .select(F.col("dst_url").alias("url")).distinct())
        newest = found.join(stored, "url").join(seen.select("url"), "url", "left_anti")
        round_no += 1


def crawl(pages: DataFrame, start_url: str, host_suffix: str) -> DataFrame:
    """The stored pages themselves that a crawl from ``start_url`` reaches."""
    urls = reachable(pages, start_url, host_suffix)
    return pages.join(urls, "url", "left_semi")
