"""Hyperlinks between pages, extracted and resolved like imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import paths
from linkloom.store import attach


def page_node(url: Column) -> Column:
    """``host/path`` of a URL: without scheme, query, fragment and closing slash."""
    return F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://", ""), r"[?#].*$|/+([?#].*)?$", "")


def link_target(page: Column, href: Column) -> Column:
    """Node a link points to, seen from the page it stands on."""
    host = F.substring_index(page, "/", 1)
    clean = F.regexp_replace(href, r"[?#].*$", "")
    return (F.when(href.rlike(r"^[a-z]+://"), page_node(href))
            .when(href.startswith("/"), paths.normalize(F.concat(host, clean)))
            .otherwise(paths.normalize(paths.join_path(paths.dirname(page), clean))))


def page_links(pages: DataFrame) -> DataFrame:
    """source, target, known: one row per link; ``known`` when the target is a page of the table."""
    found = pages.select(page_node(F.col("url")).alias("source"),
                         F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("href"))
    links = found.select("source", link_target(F.col("source"), F.col("href")).alias("target"))
    known = pages.select(page_node(F.col("url")).alias("target")).distinct().withColumn("known", F.lit(True))
    return attach(links, known, ["target"]).select("source", "target", F.coalesce("known", F.lit(False)).alias("known"))
