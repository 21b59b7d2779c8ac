"""Command line: crawl, build-index, merge, graph, pagerank, search, pipeline."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from webrank.config import CrawlConfig
from webrank.operators import crawl as C
from webrank.operators import graph, search
from webrank.operators.index import IndexTables, build_index, size_report
from webrank.plans import pipeline
from webrank.functions.text import to_text
from webrank.sources.pages import download, read_pages, write_pages
from webrank.streaming.incremental import compact


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="webrank")
    parser.add_argument("command", choices="crawl build-index merge graph pagerank search pipeline".split())
    parser.add_argument("--pages", default="data/pages", help="folder of page files")
    parser.add_argument("--index", default="data/index", help="folder of index tables")
    parser.add_argument("--config", default="config/crawler.ini")
    parser.add_argument("--query", help="text to search; without it, lines are read until an empty one")
    parser.add_argument("-k", type=int, default=15)
    o = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("webrank").getOrCreate()
    if o.command == "crawl":
        config = CrawlConfig.read(o.config)
        seeds = spark.createDataFrame([(x,) for x in config.seeds], "url string")
        pages = C.crawl(spark, seeds, lambda urls: download(urls, config.user_agent, politeness=config.politeness), state=f"{o.index}/frontier", threads=config.threads)
        logging.info("%d pages fetched, of any status, in all rounds of the crawl", pages.count())
        write_pages(pages.filter("status = 200").select("url", to_text("body").alias("content")), o.pages)
    elif o.command == "build-index":
        build_index(read_pages(spark, o.pages)).save(o.index)
    elif o.command == "merge":
        compact(spark, f"{o.index}/partial", o.index)
        size_report(spark, o.index).show()
    elif o.command == "graph":
        index = IndexTables.load(spark, o.index)
        graph.link_graph(index.links, index.doc_table).write.mode("overwrite").parquet(f"{o.index}/graph_edges")
    elif o.command == "pagerank":
        pipeline.rank(spark, o.index)
    else:
        if o.command == "pipeline":
            pipeline.build(spark, o.pages, o.index)
        index, ranks = IndexTables.load(spark, o.index), spark.read.parquet(f"{o.index}/pagerank")
        while text := o.query or input("query: ").strip():
            for place, url in enumerate(search.search_one(text, index, ranks, o.k), 1):
                print(place, url)
            if o.query:
                break


if __name__ == "__main__":
    main()
