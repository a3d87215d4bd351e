"""Speed: caching and delivery read from headers, states of lab metrics, and what to do about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def header(name: str, headers: str = "headers") -> Column:
    """A header's value in lower case, '' without it; keys of the map are lower case."""
    return F.lower(F.coalesce(F.try_element_at(F.col(headers), F.lit(name)), F.lit("")))


def has(name: str, headers: str = "headers") -> Column:
    return F.map_contains_key(F.col(headers), name)


def cdn() -> Column:
    server, via, cache = header("server"), header("via"), header("x-cache")
    return (
        F.when(has("cf-ray") | server.contains("cloudflare"), "Cloudflare")
        .when(has("x-vercel-cache") | server.contains("vercel"), "Vercel")
        .when(has("x-amz-cf-id"), "CloudFront")
        .when(has("x-served-by") | server.contains("fastly") | via.contains("fastly"), "Fastly")
        .when(server.contains("qrator"), "Qrator")
        .when(server.contains("akamai") | has("akamai-grn"), "Akamai")
        .when(cache.contains("hit") | via.contains("cdn"), "CDN")
    )


def cache_state() -> Column:
    control, valid = header("cache-control"), has("etag") | has("last-modified")
    hit = header("x-cache").contains("hit") | (header("x-vercel-cache") == "hit") | (header("cf-cache-status") == "hit")
    age = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(control, r"max-age=(\d+)", 1), F.lit("")), F.lit("999999999999")), F.lit(0))
    return (
        F.when(hit | (control.contains("public") & (age > 0)), "good")
        .when(control.contains("no-store") | control.contains("no-cache") | header("pragma").contains("no-cache"), "none")
        .when(valid, "partial")
        .when(control == "", "none")
        .otherwise("unknown")
    )


_CACHE_HEADERS = "x-cache x-litespeed-cache x-varnish x-proxy-cache x-fastcgi-cache cf-cache-status x-rocket-nginx-serving-static x-cache-enabled".split()


def server_cache(html: Column, ttfb: Column) -> Column:
    values = F.concat_ws(" ", *[header(h) for h in _CACHE_HEADERS])
    dynamic = F.lower(html).rlike(r"wp-content|/bitrix/|bx\.setcsslist|wordpress")
    return F.when(values.rlike("hit|miss|bypass|varnish|litespeed") | F.coalesce(dynamic & (ttfb < 100), F.lit(False)), "likely").otherwise("not_detected")


def ttfb_state(ttfb: Column) -> Column:
    return F.when(F.coalesce(ttfb, F.lit(0)) == 0, "unknown").when(ttfb > 2000, "critical").when(ttfb > 800, "slow").when(ttfb >= 200, "normal").otherwise("fast")


def lcp_state(v: Column) -> Column:
    return F.when(v.isNull(), "unknown").when(v > 4000, "critical").when(v >= 2500, "slow").otherwise("good")


def cls_state(v: Column) -> Column:
    return F.when(v.isNull(), "unknown").when(v > 0.1, "problem").otherwise("good")


def tbt_state(v: Column) -> Column:
    return F.when(v.isNull(), "unknown").when(v > 300, "problem").when(v < 200, "good").otherwise("slow")


def merge_strategies(reports: DataFrame) -> DataFrame:
    """A row a url from its mobile and desktop reports (url, strategy, score, page_bytes, opportunities, error).

    Of several reports of a strategy the one with the highest score stands, whole.
    """
    row = F.struct(F.coalesce("score", F.lit(-1)).alias("by"), "score", "page_bytes", "opportunities", "error")
    pick = lambda s: F.max(F.when(F.col("strategy") == s, row))
    df = reports.groupBy("url").agg(pick("mobile").alias("m"), pick("desktop").alias("d"))
    none = F.array().cast(reports.schema["opportunities"].dataType)
    df = df.withColumn("all_", F.concat(F.coalesce("m.opportunities", none), F.coalesce("d.opportunities", none)))
    ids = F.transform("all_", lambda o: o.id)
    first = F.filter("all_", lambda o, i: F.array_position(ids, o.id) == i + 1)
    one, other = F.col("m.score").isNotNull(), F.col("d.score").isNotNull()
    return df.select(
        "url", F.col("m.score").alias("mobile"), F.col("d.score").alias("desktop"), (F.col("d.score") - F.col("m.score")).alias("gap"), F.coalesce("m.page_bytes", "d.page_bytes").alias("page_bytes"), first.alias("opportunities"),
        (one | other).alias("available"), (one != other).alias("partial"), F.col("m.error").alias("mobile_error"), F.col("d.error").alias("desktop_error"), (F.col("m.error").isNotNull() | F.col("d.error").isNotNull()).alias("has_error"),
    )


#: Opportunities of a lab report that are tracked, by what they are about.
OPPORTUNITIES = {
    "images": ["modern-image-formats", "uses-optimized-images", "offscreen-images"],
    "scripts": ["render-blocking-resources", "unused-javascript", "unused-css-rules"],
    "fonts": ["font-display"],
}


def speed_problems(df: DataFrame) -> DataFrame:
    """df with problems (severity and kind, gravest first) and verdict.

    Reads ttfb_ms, ttfb_state, cms, cdn, available, partial, gap, opportunities (ids), and the mobile states lcp, cls, tbt.
    """
    seen = lambda k: F.arrays_overlap("opportunities", F.array(*map(F.lit, OPPORTUNITIES[k])))
    late, waits = F.col("lcp").isin("slow", "critical"), F.col("ttfb_state").isin("slow", "critical")
    grave, tilda = F.when(F.col("lcp") == "critical", "critical").otherwise("warn"), F.col("cms") == "Тильда"
    rules: list[tuple[str, Column | str, Column]] = [
        ("report_missing", "warn", ~F.col("available")),
        ("report_partial", "warn", F.col("available") & F.col("partial")),
        ("ttfb", F.when(tilda, "warn").otherwise("critical"), waits),
        ("images", grave, late & seen("images")),
        ("scripts", grave, late & seen("scripts")),
        ("plugins", "warn", (F.col("tbt") == "problem") & (F.col("cms") == "WordPress")),
        ("fonts", "improve", seen("fonts")),
        ("cdn", "improve", F.col("cdn").isNull() & (F.coalesce("ttfb_ms", F.lit(0)) > 500)),
        ("mobile_gap", "warn", F.coalesce("gap", F.lit(0)) > 30),
        ("cls", "warn", F.col("cls") == "problem"),
    ]
    rank = lambda s: F.when(s == "critical", 0).when(s == "warn", 1).otherwise(2)
    card = lambda i, k, s: F.struct(rank(s).alias("rank"), F.lit(i).alias("i"), s.alias("severity"), F.lit(k).alias("kind"))
    found = F.array_compact(F.array(*[F.when(c, card(i, k, F.lit(s) if isinstance(s, str) else s)) for i, (k, s, c) in enumerate(rules)]))
    df = df.withColumn("problems", F.array_sort(found))
    worst = F.get("problems", F.lit(0)).severity
    return df.withColumn("verdict", F.when(worst == "critical", "fail").when(worst == "warn", "warn").otherwise("ok"))


def parse_lab_report(report: Column) -> dict[str, Column]:
    """Score, metrics, bytes and opportunities of a lab report in JSON."""
    get = lambda p: F.get_json_object(report, p).cast("double")
    items = F.from_json(F.get_json_object(report, "$.audits.resource-summary.details.items"), "array<struct<transferSize:double>>")
    total = F.aggregate(items, F.lit(0.0), lambda a, x: a + F.coalesce(x.transferSize, F.lit(0.0)))

    def opportunity(name: str) -> Column:
        at = f"$.audits.{name}"
        ms, size = F.coalesce(get(f"{at}.details.overallSavingsMs"), get(f"{at}.numericValue")), get(f"{at}.details.overallSavingsBytes")
        kept = (F.coalesce(ms, F.lit(0.0)) > 0) | (F.coalesce(size, F.lit(0.0)) > 0) | F.coalesce(get(f"{at}.score") == 0, F.lit(False))
        title = F.coalesce(F.nullif(F.get_json_object(report, f"{at}.title"), F.lit("")), F.lit(name))
        return F.when(F.get_json_object(report, at).isNotNull() & kept, F.struct(F.lit(name).alias("id"), title.alias("title"), ms.alias("savings_ms"), size.alias("savings_bytes")))

    return {
        "score": F.round(get("$.categories.performance.score") * 100).cast("int"),
        "fcp": get("$.audits.first-contentful-paint.numericValue"),
        "lcp": get("$.audits.largest-contentful-paint.numericValue"),
        "cls": get("$.audits.cumulative-layout-shift.numericValue"),
        "tbt": get("$.audits.total-blocking-time.numericValue"),
        "speed_index": get("$.audits.speed-index.numericValue"),
        "page_bytes": F.coalesce(total, get("$.audits.total-byte-weight.numericValue")),
        "opportunities": F.array_compact(F.array(*[opportunity(name) for own in OPPORTUNITIES.values() for name in own])),
    }
