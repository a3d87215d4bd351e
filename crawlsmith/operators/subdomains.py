"""Hosts below a domain: discovery, categories and the risks that an open or dead host brings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlsmith.functions.urls import host

#: Prefixes that are tried, and what they stand for.
COMMON = "www mail api ru rus en eng dev test stage beta admin panel lk cabinet app static img images cdn media shop store blog news help support docs wiki old new m mobile wap kz by".split()
CITIES = {"msk": "Москва", "moscow": "Москва", "spb": "Санкт-Петербург", "nsk": "Новосибирск", "ekb": "Екатеринбург", "krd": "Краснодар", "nnov": "Нижний Новгород", "kzn": "Казань", "samara": "Самара", "rostov": "Ростов-на-Дону", "ufa": "Уфа"}
LOCALES = {"ru": "Русская версия", "rus": "Русская версия", "en": "English version", "eng": "English version", "kz": "Казахстан", "by": "Беларусь"}
CITY_WORDS = {"Москва": "москва|moscow", "Санкт-Петербург": "санкт-петербург|петербург|spb", "Новосибирск": "новосибирск|nsk", "Екатеринбург": "екатеринбург|ekb", "Краснодар": "краснодар|krd", "Нижний Новгород": "нижний новгород|nnov", "Казань": "казань|kzn", "Самара": "самара|samara", "Ростов-на-Дону": "ростов|rostov", "Уфа": "уфа|ufa"}
LABELS = {
    "environment": "dev|test|stage|staging|beta|demo|sandbox|preprod|apptest|qa",
    "application": "app|lk|cabinet|panel|admin|auth",
    "technical": "mail|smtp|ftp|ns1|ns2|api|cdn|static|img|images|media|files",
    "content": "blog|news|help|support|docs|wiki|shop|store|offer",
}
FIRST_LABELS = {"environment": ["old", "new"]}
PRIORITY = ["environment", "regional", "application", "content", "technical", "unknown"]


def hosts_from_certs(certs: DataFrame) -> DataFrame:
    """domain, host of every name below the domain in certificate rows (domain, name_value)."""
    names = certs.select("domain", F.explode(F.split("name_value", "\n")).alias("n"))
    rows = names.select("domain", F.regexp_replace(F.lower(F.trim("n")), r"^\*\.", "").alias("host"))
    return rows.where(F.col("host").endswith(F.concat(F.lit("."), "domain")) & ~F.col("host").contains("*")).distinct()


def candidate_hosts(domains: DataFrame, probes: DataFrame) -> DataFrame:
    """domain, host of common prefixes that answer; the prefixes are a fixed short list in each row."""
    tried = domains.select("domain", F.explode(F.array(*map(F.lit, [*COMMON, *CITIES]))).alias("p")).select("domain", F.concat("p", F.lit("."), "domain").alias("host"))
    return tried.join(probes.where(probe_state(F.col("status")).isin("working", "redirect", "closed")).select("domain", "host"), ["domain", "host"], "left_semi")


def merge_sources(certs: DataFrame, tried: DataFrame) -> DataFrame:
    """domain, host and where it was found: crt.sh, bruteforce or mixed."""
    rows = certs.select("domain", "host", F.lit(1).alias("a")).unionByName(tried.select("domain", "host", F.lit(2).alias("a")))
    found = rows.groupBy("domain", "host").agg(F.min("a").alias("low"), F.max("a").alias("high"))
    source = F.when(F.col("low") != F.col("high"), "mixed").when(F.col("low") == 1, "crt.sh").otherwise("bruteforce")
    return found.select("domain", "host", source.alias("source"))


def labels(host_: Column, domain: Column) -> Column:
    sub = F.substring(host_, F.lit(1), F.greatest(F.length(host_) - F.length(domain) - 1, F.lit(0)))
    return F.filter(F.split(F.lower(sub), r"\."), lambda x: x != "")


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def city(first: Column, title: Column) -> Column:
    by_title = F.when(F.lit(False), "")
    for name, words in CITY_WORDS.items():
        by_title = by_title.when(title.rlike(rf"(?iu)(?<![\p{{L}}\p{{N}}_])(?:{words})(?![\p{{L}}\p{{N}}_])"), name)
    return F.coalesce(F.try_element_at(_map(CITIES), first), F.try_element_at(_map(LOCALES), first), by_title)


def _matches(pattern: str):
    return lambda x: x.rlike(pattern)


def host_category(df: DataFrame) -> DataFrame:
    """df (host, domain, title) with category and city; a city or locale comes before all other signs."""
    df = df.withColumn("labels_", labels(F.col("host"), F.col("domain")))
    first = F.coalesce(F.get("labels_", F.lit(0)), F.lit(""))
    df = df.withColumn("city", city(first, F.col("title")))
    out = F.when(F.col("city").isNotNull(), "regional")
    for name, words in LABELS.items():
        hit = F.exists("labels_", _matches(rf"(^|[-.])({words})(\d+)?($|[-.])"))
        out = out.when(hit | first.isin(*FIRST_LABELS.get(name, [""])) & (first != ""), name)
    return df.withColumn("category", out.otherwise("unknown")).drop("labels_")


def probe_state(status: Column) -> Column:
    return F.when(status.between(300, 399), "redirect").when(status == 200, "working").when(status.isin(401, 403), "closed").when(status == 404, "missing").when(status.isNull(), "timeout").otherwise("error")


def is_indexable(state: Column, robots_blocked: Column, noindex: Column) -> Column:
    """A working host whose root robots.txt and page let it be indexed."""
    return (state == "working") & ~F.coalesce(robots_blocked, F.lit(False)) & ~F.coalesce(noindex, F.lit(False))


def duplicate_titles(hosts: DataFrame, mains: DataFrame) -> DataFrame:
    """hosts with same_title: whether a working host has its domain's home title."""
    norm = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    m = mains.groupBy("domain").agg(F.max(norm(F.col("title"))).alias("main_"))
    df = hosts.join(m, "domain", "left")
    return df.withColumn("same_title", F.coalesce((F.col("state") == "working") & (F.col("title") != "") & (norm(F.col("title")) == F.col("main_")), F.lit(False))).drop("main_")


RISKS = ["environment-open", "duplicate-main", "old-open", "regional-no-hreflang", "api-no-robots", "application-open", "technical-open", "redirect-external", "cert-ghost"]
CRITICAL = RISKS[:3]


def host_risks(df: DataFrame) -> DataFrame:
    """df with risks (kinds in order) and level.

    Needs host, domain, source, state, category, same_title, robots_found, robots_blocked, noindex, has_hreflang, redirect_target.
    """
    first = F.coalesce(F.get(labels(F.col("host"), F.col("domain")), F.lit(0)), F.lit(""))
    working, kind = F.col("state") == "working", F.col("category")
    open_ = working & ~F.col("robots_blocked") & ~F.col("noindex")
    target = host(F.col("redirect_target"))
    outside = (F.col("state") == "redirect") & (target != "") & (target != F.col("domain")) & ~target.endswith(F.concat(F.lit("."), "domain"))
    conds = [
        (kind == "environment") & open_,
        F.col("same_title") & working & ~F.col("noindex"),
        (first == "old") & open_,
        (kind == "regional") & working & ~F.col("has_hreflang"),
        (first == "api") & working & ~F.col("robots_found"),
        (kind == "application") & open_,
        (kind == "technical") & (first != "api") & open_,
        outside,
        (F.col("source") != "bruteforce") & F.col("state").isin("missing", "timeout", "closed", "error"),
    ]
    risks = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for c, name in zip(conds, RISKS, strict=True)]))
    df = df.withColumn("risks", risks)
    critical = reduce(lambda a, b: a | b, [F.array_contains("risks", r) for r in CRITICAL])
    return df.withColumn("level", F.when(critical, "critical").when(F.size("risks") > 0, "warn").otherwise("ok"))


def domain_risks(hosts: DataFrame) -> DataFrame:
    """domain, kind, severity, host, n: a row a risk; many dead or redirecting hosts become one row with examples."""
    rows = hosts.select("domain", "host", F.explode("risks").alias("kind"))
    counts = rows.groupBy("domain", "kind").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(counts, ["domain", "kind"])
    grouped = ((F.col("kind") == "cert-ghost") & (F.col("n") >= 4)) | ((F.col("kind") == "redirect-external") & (F.col("n") >= 3))
    severity = F.when(F.col("kind").isin(*CRITICAL), "critical").otherwise("warn")
    single = rows.where(~grouped).select("domain", "kind", severity.alias("severity"), "host", F.lit(1).cast("bigint").alias("n"))
    place = F.row_number().over(Window.partitionBy("domain", "kind").orderBy("host"))
    few = rows.where(grouped).withColumn("place", place).where((F.col("place") <= 3) | ((F.col("kind") == "cert-ghost") & (F.col("place") <= 5)))
    many = few.groupBy("domain", "kind").agg(F.array_join(F.sort_array(F.collect_list("host")), ", ").alias("host"), F.max("n").alias("n"))
    kind = F.when(F.col("kind") == "cert-ghost", "cert-ghost-group").otherwise(F.col("kind"))
    return single.unionByName(many.select("domain", kind.alias("kind"), F.lit("warn").alias("severity"), "host", "n"))


def domain_summary(hosts: DataFrame) -> DataFrame:
    c = lambda s: F.count_if(F.col("state") == s)
    return hosts.groupBy("domain").agg(F.count(F.lit(1)).alias("found"), c("working").alias("working"), c("redirect").alias("redirects"), F.count_if(~F.col("state").isin("working", "redirect")).alias("unavailable"))


def prioritize_hosts(df: DataFrame, n: int = 100) -> DataFrame:
    """The first n hosts of each domain: by category, source and name."""
    rank = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("category"))
    source = F.when(F.col("source") == "mixed", 0).when(F.col("source") == "crt.sh", 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy("domain").orderBy(rank, source, "host"))
    return df.withColumn("place", place).where(F.col("place") <= n)


def regional_report(hosts: DataFrame, sitemap_urls: DataFrame) -> DataFrame:
    """Regional hosts with in_main_sitemap and level, the gravest first in each domain."""
    listed = sitemap_urls.select(F.col("site").alias("domain"), host(F.col("loc")).alias("host")).distinct().withColumn("in_main_sitemap", F.lit(True))
    df = hosts.where("category = 'regional'").join(listed, ["domain", "host"], "left").withColumn("in_main_sitemap", F.coalesce("in_main_sitemap", F.lit(False)))
    rank = F.array_position(F.array(F.lit("critical"), F.lit("warn"), F.lit("ok")), F.col("level"))
    return df.withColumn("place", F.row_number().over(Window.partitionBy("domain").orderBy(rank, "host")))


def regional_notes(report: DataFrame) -> DataFrame:
    """The rows of ``regional_report`` with canonical_host and a note, the last sign that holds: unstable, canonical elsewhere, duplicate, no hreflang."""
    own = F.nullif(host(F.col("canonical")), F.lit(""))
    note = (
        F.when(F.col("state") != "working", "unstable")
        .when(F.coalesce(own != F.col("host"), F.lit(False)), F.concat(F.lit("canonical: "), own))
        .when(F.col("same_title"), "duplicate of home")
        .when(F.coalesce(~F.col("has_hreflang"), F.lit(False)), "no hreflang")
        .otherwise("works")
    )
    return report.withColumn("canonical_host", own).withColumn("note", note)


def regional_verdicts(notes: DataFrame) -> DataFrame:
    """domain, hosts, and host and note of the gravest host at risk (null if none is)."""
    risky = F.col("level").isin("warn", "critical")
    first = F.min(F.when(risky, F.struct("place", "host", "note")))
    return notes.groupBy("domain").agg(F.count(F.lit(1)).alias("hosts"), first.alias("f")).select("domain", "hosts", F.col("f.host").alias("risky_host"), F.col("f.note").alias("risky_note"))
