"""Sources: crawl snapshots, sitemaps, vacancy feeds and suggestion responses, with explicit schemas."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlsmith.functions.dates import age_in_years, age_label, parse_date
from crawlsmith.functions.text import strip_html

SNAPSHOTS = "url string, agent string, http_code int, headers map<string,string>, body string, ttfb_ms int, final_url string, redirect_chain array<struct<from_url:string,to_url:string,status_code:int>>, error string, fetched_at timestamp"
SUGGESTIONS = "struct<totalCount:string,topRequests:array<struct<phrase:string,query:string,count:string,frequency:string,shows:string>>>"


def read_snapshots(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Crawl results with the fixed schema; columns that a job does not use are never read."""
    return spark.read.schema(SNAPSHOTS).format(fmt).load(path)


def plain_xml(raw: bytes) -> str:
    """Text of a sitemap file, gzip or not, without a byte order mark; broken gzip is kept as it is."""
    if raw[:2] == b"\x1f\x8b":
        try:
            raw = gzip.decompress(raw)
        except (OSError, EOFError, zlib.error):
            pass
    return raw.decode("utf-8", "replace").removeprefix("﻿")


def read_sitemap_files(spark: SparkSession, path: str) -> DataFrame:
    """file, kind (index or url), loc, lastmod of every entry of the sitemap files below a path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([plain_xml(x.as_py() or b"") for x in batch.column(1)], pa.string())], ["file", "xml"])

    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content").mapInArrow(run, "file string, xml string")
    return sitemap_entries(files)


def sitemap_entries(files: DataFrame) -> DataFrame:
    """The entries of files (file, xml)."""
    kind = F.when(F.col("xml").rlike("(?i)<sitemapindex"), "index").otherwise("url")
    entries = F.regexp_extract_all("xml", F.lit(r"(?is)(<(?:url|sitemap)>.*?</(?:url|sitemap)>)"), F.lit(1))
    rows = files.select("file", kind.alias("kind"), F.explode(entries).alias("e"))
    value = lambda tag: F.nullif(F.trim(F.regexp_extract("e", rf"(?is)<{tag}>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{tag}>", 1)), F.lit(""))
    return rows.select("file", "kind", value("loc").alias("loc"), value("lastmod").alias("lastmod")).where("loc IS NOT NULL")


def feed_items(feeds: DataFrame) -> DataFrame:
    """title, vacancy_id, url, salary_text, pub_date of the items of RSS documents (xml)."""
    items = feeds.select(F.explode(F.regexp_extract_all("xml", F.lit(r"(?is)<item>(.*?)</item>"), F.lit(1))).alias("i"))
    raw = lambda tag: F.regexp_extract("i", rf"(?is)<{tag}>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{tag}>", 1)
    text = F.trim(F.regexp_replace(raw("description"), "<[^>]+>", " "))
    salary = F.nullif(F.trim(F.regexp_extract(text, r"(?iu)доход[а-я\s]*:\s*(.+?)\s*$", 1)), F.lit(""))
    link = F.regexp_replace(raw("link"), "/+$", "")
    return items.select(raw("title").alias("title"), F.element_at(F.split(link, "/"), -1).alias("vacancy_id"), raw("link").alias("url"), salary.alias("salary_text"), F.nullif(raw("pubDate"), F.lit("")).alias("pub_date"))


def read_vacancy_feed(spark: SparkSession, path: str) -> DataFrame:
    return feed_items(spark.read.text(path, wholetext=True).withColumnRenamed("value", "xml"))


def parse_suggestions(df: DataFrame, response: str = "response") -> DataFrame:
    """df without the response, a row for each suggested phrase with its count, and the seed's total."""
    parsed = df.withColumn("p_", F.from_json(response, SUGGESTIONS)).drop(response)
    number = lambda c: F.coalesce(F.when(c.rlike(r"^\d+(\.\d+)?$"), c.cast("double").cast("bigint")), F.lit(0))
    rows = parsed.withColumn("r_", F.explode("p_.topRequests"))
    r = F.col("r_")
    phrase = F.trim(F.coalesce(r.phrase, r.query))
    return rows.select(*[c for c in df.columns if c != response], phrase.alias("phrase"), number(F.coalesce(r["count"], r.frequency, r.shows)).alias("count"), number(F.col("p_.totalCount")).alias("total")).where(phrase != "")


#: Where a registration record has its date and its registrar, in the order tried.
WHOIS_CREATED = [
    r"(?iu)created\s*[:>]\s*([0-9TZ:\-. ]+)", r"(?iu)registered\s*[:>]\s*([0-9TZ:\-. ]+)", r"(?iu)Дата регистрации\s*[:>]\s*([0-9TZ:\-. ]+)",
    r"(?iu)created[^0-9]*(\d{2}\.\d{2}\.\d{4}|\d{4}-\d{2}-\d{2}(?:T[0-9:]+Z)?)", r"(?iu)registered[^0-9]*(\d{2}\.\d{2}\.\d{4}|\d{4}-\d{2}-\d{2}(?:T[0-9:]+Z)?)",
    r"(?iu)(?:creation date|created(?: on)?|registered(?: on)?|registration date|Дата регистрации)\s*[:>]\s*([^\n<]+)",
]
WHOIS_REGISTRAR = [r"(?iu)registrar\s*[:>]\s*([^\n<]+)", r"(?iu)Регистратор\s*[:>]\s*([^\n<]+)"]


def whois_fields(text: Column, as_of: str) -> dict[str, Column]:
    """registrar, created, age in whole years and its label, of a domain registration record."""
    found = F.transform(F.array(*[F.regexp_extract(text, p, 1) for p in WHOIS_CREATED]), parse_date)
    created = F.get(F.array_compact(found), F.lit(0))
    registrar = F.coalesce(*[F.nullif(strip_html(F.regexp_extract(text, p, 1)), F.lit("")) for p in WHOIS_REGISTRAR])
    return {"registrar": registrar, "created": created, "age_years": F.floor(age_in_years(created, as_of)).cast("int"), "age_label": age_label(age_in_years(created, as_of))}
