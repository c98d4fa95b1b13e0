"""Reading tables, and the views of them that retrieval works on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores if their files make fewer tasks than there are cores; larger tables stay as they are read."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def status_of(quality: str = "quality", toxic: str = "toxic"):
    """Toxic texts are archived, good ones current, bad ones obsolete; unlabelled ones have no status."""
    return F.when(F.col(toxic) == 1, "archived").when(F.col(quality) == 1, "current").when(F.col(quality) == 0, "obsolete")


def document_sections(documents: DataFrame) -> DataFrame:
    """A section for each document: its first line is the heading, the rest the body."""
    return documents.select(F.col("doc_id").alias("section_uid"), F.substring_index("text", "\n", 1).alias("heading"), F.expr("substring(text, length(substring_index(text, '\n', 1)) + 2)").alias("body"), F.col("source").alias("path"))


def line_sections(documents: DataFrame) -> DataFrame:
    """A section for each line that isn't empty: (doc_id, line, body), lines from 1."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "body"))
    return lines.filter("body <> ''").select("doc_id", (F.col("line") + 1).alias("line"), "body")


def page_sections(pages: DataFrame) -> DataFrame:
    """A section for each page: the heading is its first <h1>, the body its text without tags, scripts and styles."""
    bare = F.regexp_replace(F.regexp_replace("html", r"(?s)<(?:script|style)[^>]*>.*?</(?:script|style)>", " "), r"<[^>]*>", " ")
    return pages.select(F.col("page_id").alias("section_uid"), F.col("url").alias("path"), F.regexp_replace(F.regexp_extract("html", r"(?s)<h1>(.*?)</h1>", 1), r"<[^>]*>", "").alias("heading"), bare.alias("body"))


def page_links(pages: DataFrame) -> DataFrame:
    """(src, dst, relation): a `link` from each page to each of its href targets."""
    hrefs = F.explode(F.expr("regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)"))
    return pages.select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("src"), hrefs.alias("h")).select("src", F.concat(F.lit("href:"), "h").alias("dst"), F.lit("link").alias("relation")).distinct()


def foreign_keys(nation: DataFrame, customer: DataFrame, supplier: DataFrame) -> DataFrame:
    """(src, dst, relation): nations under regions, customers and suppliers under nations."""
    name = lambda kind, key: F.concat(F.lit(kind + ":"), F.col(key).cast("string"))
    parts = [(nation, "nation", "n_nationkey", "region", "n_regionkey"), (customer, "customer", "c_custkey", "nation", "c_nationkey"), (supplier, "supplier", "s_suppkey", "nation", "s_nationkey")]
    rows = [df.select(name(kind, key).alias("src"), name(up, ref).alias("dst"), F.lit("parent").alias("relation")) for df, kind, key, up, ref in parts]
    return rows[0].union(rows[1]).union(rows[2])
