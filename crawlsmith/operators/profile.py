"""The profile of a site: facts of ten sources as rows, brought to one row a site by a single aggregation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlsmith.functions import html as H
from crawlsmith.functions import text as T
from crawlsmith.functions.dates import age_in_years, age_label
from crawlsmith.functions.frames import fenced
from crawlsmith.operators.content import ranked_menu, with_menu
from crawlsmith.operators.context import SEARCH_PATTERNS, llms_txt_status, search_counts
from crawlsmith.operators.site_profile import BUCKETS, SIGNALS, commerce_kind, commerce_score, signal_flags, structure_sums, url_facts, with_percents
from crawlsmith.sources.readers import whois_fields

#: Cities that name a site's region, and the words of the summary.
CITIES = "Москва|Санкт-Петербург|Новосибирск|Екатеринбург|Казань|Нижний Новгород|Челябинск|Самара|Омск|Ростов-на-Дону|Уфа|Краснодар|Пермь|Воронеж"
COUNTRY = r"(?iu)росси|рф(?![\p{L}\p{N}_])|44-фз|госзакуп"
TYPE_NAMES = {"saas": "SaaS-сервис", "shop": "интернет-магазин", "blog": "блог", "aggregator": "агрегатор", "landing": "лендинг", "corporate": "корпоративный сайт"}
AUDIENCE_NAMES = {"mixed": "смешанная", "B2B": "B2B", "B2C": "B2C"}
BUCKET_NAMES = {"commercial": "коммерческих", "informational": "информационных", "application": "приложение", "search": "поиск", "documents": "документы", "video": "видео/вебинары", "faq": "faq", "service": "служебных", "unknown": "не определено"}
#: Words of a site's type, audience and topic.
TYPE_WORDS = {"saas": "crm|saas|платформа|сервис|api|dashboard|demo|trial|личный кабинет", "no_saas": "магазин|каталог|товар", "aggregator": "агрегатор|сравнение|подбор|каталог компаний|marketplace", "corporate": "о компании|контакты|услуги|решения|команда"}
AUDIENCE_WORDS = {"b2b": "b2b|для бизнеса|для компаний|оптом|партнерам|корпоративным клиентам", "b2c": "купить|доставка|каталог|корзина|заказать|для дома|для себя"}


def heuristic_profile(df: DataFrame) -> DataFrame:
    """df (title, h1, description, preview, menu_labels, cart, form, commercial_percent, informational_percent, total) with site_type, audience, topic and region."""
    hay = F.lower(F.concat_ws(" ", "title", "h1", "description", "preview", F.array_join("menu_labels", " ")))
    df = fenced(df.withColumn("hay_", hay))
    has = lambda words: T.any_of(F.col("hay_"), words)
    kind = (
        F.when(has(TYPE_WORDS["saas"]) & ~has(TYPE_WORDS["no_saas"]), "saas")
        .when(F.col("cart") | (F.col("commercial_percent") >= 40), "shop")
        .when(F.col("informational_percent") >= 50, "blog")
        .when(has(TYPE_WORDS["aggregator"]), "aggregator")
        .when((F.col("total") <= 20) & F.col("form"), "landing")
        .when(has(TYPE_WORDS["corporate"]), "corporate")
        .otherwise("unknown")
    )
    b2b, b2c = has(AUDIENCE_WORDS["b2b"]), has(AUDIENCE_WORDS["b2c"])
    head = lambda c: F.trim(F.split(F.split(F.coalesce(F.col(c), F.lit("")), r"\|")[0], "—")[0])
    topic = F.coalesce(*[F.when(F.length(head(c)) >= 8, head(c)) for c in ("h1", "title", "description")])
    city = lambda c: F.nullif(F.regexp_extract(F.coalesce(F.col(c), F.lit("")), rf"(?iu)(?<![\p{{L}}\p{{N}}_])({CITIES})(?![\p{{L}}\p{{N}}_])", 1), F.lit(""))
    region = F.coalesce(*[city(c) for c in ("title", "h1", "description", "preview")], F.when(F.col("hay_").rlike(COUNTRY), "Россия"))
    audience = F.when(b2b & b2c, "mixed").when(b2b, "B2B").when(b2c, "B2C").otherwise("unknown")
    return df.withColumns({"site_type": kind, "audience": audience, "topic": topic, "region": region}).drop("hay_")


def home_facts(pages: DataFrame) -> DataFrame:
    """site, the signals of each page (site, url, html), and home: what is said of a site if this is its home, led by the length of its url."""
    low = F.col("low_")
    df = with_menu(pages.select("site", "url", "html", F.lower("html").alias("low_")), low=low)
    m = H.head_meta(F.col("html"))
    body = F.coalesce(F.when(low.contains("<main"), H.first_inner(F.col("html"), "main")), F.nullif(F.regexp_extract("html", r"(?is)<body\b[^>]*>(.*?)</body>", 1), F.lit("")), F.col("html"))
    said = {"title": m["title"], "h1": m["h1"], "description": m["description"], "preview": F.substring(T.strip_html(body, low), 1, 500), "cms": H.detect_cms(F.col("html"), low), "analytics": H.detect_analytics(F.col("html")), "menu_labels": F.col("menu_labels"), "menu": ranked_menu(F.col("menu_links"))}
    home = F.struct(F.length("url").alias("n"), F.col("url"), *[c.alias(k) for k, c in said.items()])
    return df.select("site", home.alias("home"), *[c.alias(k) for k, c in signal_flags(F.col("html"), low).items()])


#: What each further source says of a site, by its columns; a site's rows are brought together by the aggregate named.
_SOURCES = {
    "sitemap": (["sitemap_found", "sitemap_url"], "max"), "llms": (["llms_status"], "max"), "whois": (["registrar", "created"], "max"), "search": ([f"{k}_count" for k in SEARCH_PATTERNS], "max"),
    "access": (["access_verdict"], "max"), "hosts": (["hosts_found", "hosts_checked", "host_risks"], "sum"), "sitemap_limits": (["truncated_by_files", "truncated_by_urls"], "max"),
}


def facts(urls: DataFrame, pages: DataFrame, as_of: str, **sources: DataFrame) -> DataFrame:
    """Rows of facts on sites, from all sources; columns that a source does not have are null."""
    made = {
        "sitemap": lambda df: df.select("site", "sitemap_found", F.col("url").alias("sitemap_url")),
        "llms": lambda df: llms_txt_status(df).select("site", "llms_status"),
        "whois": lambda df: df.select("site", *[whois_fields(F.col("text"), as_of)[k].alias(k) for k in ("registrar", "created")]),
        "search": lambda df: df.select("site", *[F.when(F.col("engine") == k, search_counts(F.col("html"), ps)).alias(f"{k}_count") for k, ps in SEARCH_PATTERNS.items()]),
        "access": lambda df: df.select("site", F.col("verdict").alias("access_verdict")),
        "hosts": lambda df: df.select("site", F.col("found").alias("hosts_found"), F.col("checked").alias("hosts_checked"), F.col("risks").alias("host_risks")),
        "sitemap_limits": lambda df: df.select("site", "truncated_by_files", "truncated_by_urls"),
    }
    rows = [urls.select("site", *[c.alias(k) for k, c in url_facts().items()]), home_facts(pages), *[made[k](df) for k, df in sources.items()]]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)


def site_profile(urls: DataFrame, pages: DataFrame, as_of: str, **sources: DataFrame) -> DataFrame:
    """A row for each site of any source, with its structure, type, audience, commerce, technology, reach and a summary.

    urls (site, loc, lastmod), pages (site, url, html), and where they are known: sitemap (site, sitemap_found, url), llms (site, status,
    body, first_blocked), whois (site, text), search (site, engine, html), access (site, verdict), hosts (site, found, checked, risks),
    sitemap_limits (site, truncated_by_files, truncated_by_urls). All facts meet in one aggregation with partial sums and minima, so neither a
    site with most of the urls nor one with most of the pages is a hot spot; pages leave their rows as flags and the facts of a home page.
    What a missing source would say is null.
    """
    rows = facts(urls, pages, as_of, **sources)
    how = {"max": F.max, "sum": F.sum}
    others = [how[kind](c).alias(c) for name, (columns, kind) in _SOURCES.items() if name in sources for c in columns]
    flags = [F.coalesce(F.bool_or(n), F.lit(False)).alias(n) for n in [*SIGNALS, "form_", "field_"]]
    per = rows.groupBy("site").agg(*structure_sums(as_of), F.min("home").alias("home"), *flags, *others)
    # Each step's columns are settled before the next reads them: folded into one expression they would be computed over and over.
    per = fenced(with_percents(fenced(per))).withColumn("form", F.col("form_") & F.col("field_")).drop("form_", "field_")
    for column, kind in {"sitemap_found": "boolean", "sitemap_url": "string", "llms_status": "string", "registrar": "string", "created": "date", "access_verdict": "string", "hosts_found": "bigint", "hosts_checked": "bigint", "host_risks": "bigint", "truncated_by_files": "boolean", "truncated_by_urls": "boolean", **{f"{k}_count": "bigint" for k in SEARCH_PATTERNS}}.items():
        if column not in per.columns:
            per = per.withColumn(column, F.lit(None).cast(kind))
    # Without urls of a sitemap nothing is known of the structure.
    known = F.col("total") > 0
    structure = ["total", "level1", "level2", "level3plus", "updated_30d", *[f"{b}_{k}" for b in BUCKETS for k in ("count", "percent")]]
    per = per.withColumns({c: F.when(known, F.col(c)) for c in structure if c != "total"}).withColumn("total", F.when(known, F.col("total")))
    home = ["title", "h1", "description", "preview", "cms", "analytics", "menu_labels", "menu"]
    per = per.withColumns({"home_url": F.col("home.url"), **{c: F.col(f"home.{c}") for c in home}}).drop("home")
    per = fenced(heuristic_profile(fenced(per))).withColumn("age_years", F.round(age_in_years(F.col("created"), as_of), 1)).withColumn("age_label", age_label(age_in_years(F.col("created"), as_of)))
    per = fenced(commerce_score(fenced(per.withColumn("kind_", commerce_kind(F.col("site_type")))), F.col("kind_")))
    per = per.withColumn("access_status", F.when(F.col("access_verdict").isin("ok", "fail"), F.col("access_verdict")).when(F.col("access_verdict").isNotNull(), "warn")).drop("access_verdict")
    note = F.when(F.col("total").isNull(), "no_sitemap").when(F.col("truncated_by_urls"), "first_urls_only").when(F.col("truncated_by_files"), "first_files_only")
    return with_summary(per.withColumn("structure_note", note)).drop("kind_", "preview")


def _number(c: Column) -> Column:
    return F.replace(F.format_number(c, 0), F.lit(","), F.lit("\u00a0"))


def with_summary(df: DataFrame) -> DataFrame:
    """df with summary: sentences on what a site is, what its sitemap holds, and what it lacks."""
    named = lambda c, names: reduce(lambda out, kv: out.when(F.col(c) == kv[0], kv[1]), names.items(), F.when(F.lit(False), ""))
    cells = F.array(*[F.struct((-F.col(f"{b}_percent")).alias("minus"), F.lit(i).alias("i"), F.concat(F.lit(f"{BUCKET_NAMES[b]} "), F.col(f"{b}_percent").cast("string"), F.lit("%")).alias("text"), F.col(f"{b}_count").alias("n")) for i, b in enumerate(BUCKETS)])
    gaps = F.array(
        F.when(~(F.col("address") & (F.col("kind_") == "shop")), "адрес не найден"), F.when(~F.col("reviews"), "отзывы не найдены"),
        F.when(F.col("unknown_count") > 0, F.concat(_number(F.col("unknown_count")), F.lit(" страниц не классифицированы"))),
    )
    df = fenced(df.withColumns({"cells_": cells, "gaps_": F.array_compact(gaps), "what_": F.concat_ws(", ", named("audience", AUDIENCE_NAMES), named("site_type", TYPE_NAMES), "topic", "region")}))
    top = F.array_join(F.transform(F.slice(F.array_sort(F.filter("cells_", lambda x: x.n > 0)), 1, 2), lambda x: x.text), ", ")
    df = fenced(df.withColumn("top_", top))
    pages = F.concat(F.lit("В sitemap найдено "), _number(F.col("total")), F.lit(" URL"), F.when(F.col("top_") != "", F.concat(F.lit("; основные разделы: "), "top_", F.lit("."))).otherwise("."))
    text = F.concat_ws(
        " ", F.when(F.col("what_") == "", "Тип сайта определить не удалось.").otherwise(F.concat("what_", F.lit("."))),
        F.when(F.col("total").isNotNull(), pages).otherwise("Sitemap не найден, структура сайта определена частично."), F.when(F.size("gaps_") > 0, F.concat(F.lit("Пробелы: "), F.array_join("gaps_", ", "), F.lit("."))),
    )
    return df.withColumn("summary", text).drop("cells_", "gaps_", "what_", "top_")
