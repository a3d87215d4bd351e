"""Own site against competitors: metric cells, insights and tasks by comparison group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlsmith.operators.site_profile import BUCKETS

#: Whether more is better, by metric.
NUMBERS = {"authority": True, "sitemap_total": True, "informational_count": True, "ttfb_ms": False, "mobile_score": True, "desktop_score": True, "commercial_signals_found": True, "regional": True}
FLAGS = ["gptbot_ok", "llms_txt", "schema_critical", "canonical_ok", "googlebot_ok", "yandexbot_ok"]


def site_metrics(domains: DataFrame, **checks: DataFrame) -> DataFrame:
    """A row for each domain from one table a check (domain, ...); missing checks are named in errors."""
    df = domains.select("domain").distinct()
    for name, part in checks.items():
        df = df.join(part.withColumn(f"has_{name}", F.lit(True)), "domain", "left")
    errors = F.array_compact(F.array(*[F.when(F.col(f"has_{n}").isNull(), n) for n in checks]))
    return df.withColumn("errors", errors).drop(*[f"has_{n}" for n in checks])


#: By check the metrics that it gives a domain, as SQL over the check's rows; several rows of a domain are brought together by maximum.
METRICS = {
    "site_profile": {
        "type": "site_type", "age_years": "age_years", "age_label": "age_label", "cms": "cms", "authority": "iks_count", "sitemap_total": "total",
        **{f"{b}_{k}": f"{b}_{k}" for b in BUCKETS for k in ("count", "percent")},
        "commercial_signals_found": "critical_found + important_found + additional_found", "commercial_signals_total": "CASE WHEN critical_found IS NOT NULL THEN 10 END", "llms_txt": "llms_status = 'ok'",
    },
    "speed": {"ttfb_ms": "ttfb_ms", "mobile_score": "mobile_score", "desktop_score": "desktop_score"},
    "ssr": {f"{bot}bot_ok": f"CASE WHEN agent = '{bot}' THEN coalesce(http_code = 200 AND coalesce(access_state, 'ok') = 'ok', false) END" for bot in ("google", "yandex")},
    "index": {"canonical_ok": "canonical_ok", "robots_ok": "robots_allowed"},
    "llm": {"gptbot_ok": "CASE WHEN agent = 'gptbot' THEN coalesce(http_code = 200 AND coalesce(access_state, 'ok') = 'ok', false) END", "schema_critical": "coalesce(schema_critical_matched, 0) > 0", "faq_found": "coalesce(size(faq_signals), 0) > 0"},
    "subdomains": {"found": "found", "checked": "checked", "regional": "regional"},
    "hosts": {"open_dev_test": "coalesce(category = 'environment' AND state = 'working' AND NOT coalesce(robots_blocked, false) AND NOT coalesce(noindex, false), false)"},
    "content": {
        "page_type": "page_type", "representative_url": "url", "content_verdict": "CASE WHEN critical_count > 0 THEN 'fail' WHEN important_count > 0 THEN 'warn' ELSE 'ok' END",
        **{c: c for c in ("critical_count", "important_count", "improve_count", "items_on_page", "pagination_pages", "estimated_assortment", "infinite_scroll")},
    },
    "article": {f"article_{k}": f"CASE WHEN page_type = 'article' THEN {c} END" for k, c in {"url": "url", "word_count": "word_count", "density_percent": "density", "author_found": "author_found", "schema_found": "article_schema_found", "internal_links": "internal_links", "images_count": "content_images"}.items()},
}
#: Checks whose absence is no error of a comparison: the article is a second look at content, hosts belong to subdomains.
_QUIET = ("hosts", "article")


def derive_metrics(domains: DataFrame, **checks: DataFrame) -> DataFrame:
    """A row for each domain with all METRICS of the checks, and errors, the names of those that failed for it.

    A check is a table (domain, ok, and what its metrics read); rows that are not ok count as missing, and so do checks that are not
    given. Each check's rows become metrics where they are, and all meet in one aggregation by domain.
    """
    kinds = {name: checks[name].where("ok").selectExpr("domain", *[f"{sql} AS `{m}`" for m, sql in METRICS[name].items()], f"true AS `has_{name}`") for name in checks}
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kinds.values(), domains.select("domain").withColumn("wanted_", F.lit(True)))
    made = [m for name in METRICS if name in kinds for m in METRICS[name]]
    per = rows.groupBy("domain").agg(F.max("wanted_").alias("wanted_"), *[F.max(c).alias(c) for c in [*made, *[f"has_{n}" for n in kinds]]]).where("wanted_")
    absent = {m: F.lit(None).cast("string") for name in METRICS if name not in kinds for m in METRICS[name]}
    ok = {n: F.coalesce(F.col(f"has_{n}"), F.lit(False)) if n in kinds else F.lit(False) for n in METRICS}
    errors = F.array_compact(F.array(*[F.when(~ok[n], n) for n in METRICS if n not in _QUIET]))
    # A check of subdomains that found no host has no open one.
    open_ = {"open_dev_test": F.when(ok["subdomains"], F.coalesce("open_dev_test", F.lit(False)))} if "hosts" in kinds else {}
    return per.withColumns(absent | open_ | {"errors": errors}).select("domain", *[m for own in METRICS.values() for m in own], "errors")


def _pairs(metrics: DataFrame) -> DataFrame:
    cols = [*NUMBERS, *FLAGS]
    own = metrics.where("is_own").select("grp", F.struct("domain", *cols).alias("o"))
    return metrics.where("NOT is_own").select("grp", F.struct("domain", *cols).alias("c")).join(own, "grp")


def compare_cells(metrics: DataFrame) -> DataFrame:
    """grp, domain, metric, mark: for each competitor and metric how it stands against the own site."""
    o, c = F.col("o"), F.col("c")
    cells = []
    for m, more in NUMBERS.items():
        better = (c[m] > o[m]) if more else (c[m] < o[m])
        mark = F.when(c[m].isNull() | o[m].isNull(), "none").when(c[m] == o[m], "same").when(better, "better").otherwise("worse")
        cells.append(F.struct(F.lit(m).alias("metric"), mark.alias("mark")))
    for m in FLAGS:
        mark = F.when(c[m].isNull() | o[m].isNull(), "none").when(c[m] == o[m], "same").when(c[m], "risk").otherwise("chance")
        cells.append(F.struct(F.lit(m).alias("metric"), mark.alias("mark")))
    return _pairs(metrics).select("grp", F.col("c.domain").alias("domain"), F.explode(F.array(*cells)).alias("x")).select("grp", "domain", "x.*")


def _round(x: Column) -> Column:
    return F.floor(x + 0.5).cast("bigint")


def compare_insights(metrics: DataFrame, most: dict[str, int] | None = None) -> DataFrame:
    """grp, list, place, key, priority: what the own site lags and leads in, and quick wins.

    Every competitor yields candidates; of equal keys the highest priority stays; the first few of each list are shown.
    """
    most = most or {"lagging": 4, "leading": 3, "quick_win": 3}
    o, c = F.col("o"), F.col("c")
    name = F.concat(F.lit("-"), c.domain)
    num = lambda s, m: F.when(s[m] != 0, s[m])  # noqa: E731  zero counts as missing
    lost = lambda m: ~o[m] & c[m]
    won = lambda m: o[m] & ~c[m]
    iks, total = (num(c, "authority"), num(o, "authority")), (num(c, "sitemap_total"), num(o, "sitemap_total"))
    rules = [
        ("lagging", F.lit("gptbot"), F.lit(100), lost("gptbot_ok"), True),
        ("lagging", F.concat(F.lit("iks"), name), _round(iks[0] / iks[1] * 100), iks[0] >= iks[1] * 1.3, True),
        ("lagging", F.concat(F.lit("sitemap"), name), _round(total[0] / total[1] * 90), total[0] >= total[1] * 1.5, True),
        ("lagging", F.concat(F.lit("informational"), name), _round(c.informational_count / o.informational_count * 80), (o.informational_count > 0) & (c.informational_count >= o.informational_count * 1.5), True),
        ("lagging", F.concat(F.lit("ttfb"), name), _round(o.ttfb_ms / c.ttfb_ms * 70), (c.ttfb_ms > 0) & (c.ttfb_ms <= o.ttfb_ms * 0.7), True),
        ("lagging", F.concat(F.lit("mobile"), name), c.mobile_score - o.mobile_score + 50, c.mobile_score >= o.mobile_score + 15, True),
        ("lagging", F.concat(F.lit("llms"), name), F.lit(65), lost("llms_txt"), True),
        ("lagging", F.concat(F.lit("schema"), name), F.lit(60), lost("schema_critical"), True),
        ("lagging", F.concat(F.lit("canonical"), name), F.lit(55), lost("canonical_ok"), True),
        ("leading", F.concat(F.lit("gptbot-lead"), name), F.lit(70), won("gptbot_ok"), True),
        ("leading", F.concat(F.lit("mobile-lead"), name), o.mobile_score - c.mobile_score + 60, (c.mobile_score > 0) & (o.mobile_score >= c.mobile_score + 20), True),
        ("leading", F.concat(F.lit("regional-lead"), name), F.lit(45), (o.regional > 0) & (F.coalesce(c.regional, F.lit(0)) == 0), True),
        ("quick_win", F.concat(F.lit("llms-win"), name), F.lit(55), won("llms_txt"), True),
        ("quick_win", F.concat(F.lit("canonical-win"), name), F.lit(80), won("canonical_ok"), True),
        ("quick_win", F.concat(F.lit("bots-win"), name), F.lit(65), o.googlebot_ok & o.yandexbot_ok & (~c.googlebot_ok | ~c.yandexbot_ok), True),
        ("lagging", F.concat(F.lit("signals"), name), 35 + c.commercial_signals_found - o.commercial_signals_found, c.commercial_signals_found > o.commercial_signals_found, False),
        ("lagging", F.concat(F.lit("desktop"), name), 20 + c.desktop_score - o.desktop_score, c.desktop_score > o.desktop_score, False),
    ]
    cards = [F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(of).alias("list"), key.alias("key"), priority.cast("bigint").alias("priority"), F.lit(always).alias("always"))) for of, key, priority, cond, always in rules]
    found = _pairs(metrics).select("grp", F.explode(F.array_compact(F.array(*cards))).alias("x")).select("grp", "x.*")
    found = found.groupBy("grp", "list", "key").agg(F.max("priority").alias("priority"), F.max("always").alias("always"))
    enough = found.where("list = 'lagging' AND always").groupBy("grp").agg(F.count(F.lit(1)).alias("n_"))
    found = found.join(enough, "grp", "left").where("always OR coalesce(n_, 0) < 3")
    place = F.row_number().over(Window.partitionBy("grp", "list").orderBy(F.desc("priority"), "key"))
    limit = reduce(lambda a, kv: a.when(F.col("list") == kv[0], kv[1]), most.items(), F.when(F.lit(False), 0))
    return found.withColumn("place", place).where(F.col("place") <= limit).select("grp", "list", "place", "key", "priority")


def merge_insights(primary: DataFrame, secondary: DataFrame, n: int) -> DataFrame:
    """grp, title, detail: primary then secondary, without blanks and repeats, n a group."""
    both = primary.withColumn("of", F.lit(0)).unionByName(secondary.withColumn("of", F.lit(1))).where("trim(title) <> '' AND trim(detail) <> ''")
    first = both.groupBy("grp", "title", "detail").agg(F.min(F.struct("of", "place")).alias("p"))
    place = F.row_number().over(Window.partitionBy("grp").orderBy("p", "title", "detail"))
    return first.withColumn("place", place).where(F.col("place") <= n).select("grp", "place", "title", "detail")
