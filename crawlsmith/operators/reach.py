"""Can a site be reached? Registry of blocked resources and probe results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlsmith.functions.urls import parents

#: Providers by a mark in headers, CNAME or reverse DNS, in the order tried.
PROVIDERS = [("Cloudflare", "cloudflare"), ("Vercel", "vercel"), ("AWS", "amazonaws|cloudfront"), ("GCP", "googleusercontent|google cloud"), ("Azure", "azure|windows.net"), ("Timeweb", "timeweb"), ("Beget", "beget"), ("Selectel", "selectel")]
FOREIGN, LOCAL = ["Cloudflare", "Vercel", "AWS", "GCP", "Azure"], ["Timeweb", "Beget", "Selectel"]


def probe_status(code: Column, error: Column) -> Column:
    failed = F.lower(F.coalesce(error, F.lit("")))
    return (
        F.when(code.between(200, 399), "accessible")
        .when(code.between(400, 599), "http_error")
        .when(failed.rlike("timeout|timed out"), "timeout")
        .when(failed.contains("refused"), "refused")
        .when(failed != "", "error")
        .otherwise("unknown")
    )


def registry_match(domains: DataFrame, registry: DataFrame) -> DataFrame:
    """domains (domain) with the registry entry that covers them: the domain itself, or *.x above or at it.

    A domain is taken apart into its parents, so the match is an equi-join whatever the size of the registry.
    """
    bare = F.regexp_replace(F.lower("domain"), r"^www\.", "")
    rows = domains.select("domain", F.posexplode(parents(bare)).alias("up", "name"))
    wild = F.col("resource").startswith("*.")
    entries = registry.select(F.when(wild, F.substring("resource", 3, 1 << 20)).otherwise(F.col("resource")).alias("name"), wild.alias("wild"), "resource").distinct()
    hits = rows.join(entries, "name").where(F.col("wild") | (F.col("up") == 0))
    best = hits.groupBy("domain").agg(F.min(F.struct("up", "wild", "resource")).alias("b"))
    return domains.join(best, "domain", "left").select(*domains.columns, F.col("b.resource").alias("registry_entry"), F.col("b").isNotNull().alias("blocked"))


def hosting_provider(text: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, mark in PROVIDERS:
        out = out.when(F.lower(text).rlike(mark), name)
    return out.otherwise("unknown")


def access_verdict(df: DataFrame) -> DataFrame:
    """df (blocked, null if unknown; probe; provider) with key, verdict and recommendation."""
    down = F.col("probe").isin("http_error", "timeout", "refused", "error")
    key = F.when(F.col("blocked").isNull(), "unknown").when(~F.col("blocked") & ~down, "ok").when(F.col("blocked") & down, "blocked_officially").when(F.col("blocked"), "listed_but_accessible").otherwise("not_blocked_but_unavailable")
    df = df.withColumn("key", key)
    advice = F.when(F.col("key") == "blocked_officially", "legal").when(F.col("key") == "listed_but_accessible", "watch").when((F.col("key") == "not_blocked_but_unavailable") & F.col("provider").isin(*FOREIGN), "move_hosting").when((F.col("key") == "not_blocked_but_unavailable") & F.col("provider").isin(*LOCAL), "check_server")
    return df.withColumn("verdict", F.when(F.col("key") == "ok", "ok").when(F.col("key") == "blocked_officially", "fail").otherwise("warn")).withColumn("advice", advice)
