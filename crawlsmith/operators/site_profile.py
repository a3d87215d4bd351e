"""What is each site made of? URL buckets, structure, sections and page signals by site."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlsmith.functions import text as T
from crawlsmith.functions.urls import depth_level, path, site_keys

BUCKETS = ["commercial", "informational", "application", "search", "documents", "video", "faq", "service", "unknown"]
#: Path parts, segment words and, last, patterns that put a URL into a bucket, in the order tried.
PATHS = {
    "application": ["/app/", "/lk/", "/cabinet/", "/dashboard/", "/platform/", "/calc/", "/calculator/", "/converter/", "/nmck/", "/tekhzadanie/", "/analysis/", "/report/"],
    "search": ["/search/", "/poisk/", "/find/", "/results/", "/reestr/", "/registry/", "/tender/", "/tenders/", "/torgi/", "/contract/", "/contracts/", "/contragent/", "/supplier/", "/customer/", "/ktru/", "/okpd/", "/okpd2/", "/okved/"],
    "documents": ["/docs/", "/documentation/", "/doc-cat/", "/documents/", "/dokument", "/api/"],
    "video": ["/video/", "/videos/", "/webinar", "/webinars/", "/vebinar"],
    "faq": ["/faq/", "/voprosy-otvety/", "/questions/", "/question/", "/answer/", "/dwqa-"],
    "commercial": ["/catalog/", "/product/", "/products/", "/shop/", "/tovar/", "/tovary/", "/price/", "/prices/", "/services/", "/uslugi/", "/order/", "/buy/", "/pricing/", "/tariffs/", "/plans/", "/korzina/", "/cart/", "/checkout/"],
    "informational": ["/blog/", "/articles/", "/stati/", "/news/", "/novosti/", "/help/", "/pomoshch/"],
    "service": ["/about/", "/o-nas/", "/contacts/", "/kontakty/", "/policy/", "/privacy/", "/oferta/", "/dostavka/", "/offer/", "/agreement/", "/terms/"],
}
WORDS = {
    "application": "app lk cabinet dashboard platform calc calculator calculators converter nmck nmcd tekhzadanie texzadanie analiz analysis favorite favorites plan plans report reports checker tool tools",
    "search": "search poisk find results result registry reestr register zakupki zakupka zak tender tenders torgi auction auctions lot lots contract contracts contragent supplier suppliers customer customers procedure procedures trade trades ktru okpd okpd2 okved classifier classifiers",
    "documents": "docs doc documentation document documents manual guide guides instruction instructions api",
    "video": "video videos webinar webinars vebinar recording youtube rutube",
    "faq": "faq voprosy-otvety questions question answers answer dwqa",
    "commercial": "catalog category categories shop store price prices pricing tariff tariffs service services uslugi product products tovar tovary buy order cart checkout",
    "informational": "blog blogs article articles news novosti stati help guide guides pomoshch",
    "service": "about o-nas contacts kontakty policy privacy offer oferta terms agreement delivery dostavka support",
}
PATTERNS = [
    ("search", "search|find|query|lookup|okpd2|nkmi|registry|reestr|ktru|okpd|okved|contragent|contract|zakup|tender|torgi|auction|supplier|customer|trade|procedure"),
    ("application", "calc|calculator|converter|nmck|nmcd|tekhzadanie|analysis|analiz|report|checker|tool"),
    ("documents", "docs?|documentation|document|manual|guide"),
    ("video", "video|webinar|vebinar|recording|youtube|rutube"),
    ("faq", "faq|question|answer|dwqa"),
    ("commercial", "product|shop|catalog|tovar|uslug|price|pricing|tariff"),
    ("informational", "blog|news|guide|help|article|stati"),
]


def classify_url(loc: Column) -> Column:
    """One of nine buckets; a word counts where a path segment contains it, so one pattern tests all of them."""
    lowered = F.lower(loc)
    p = F.when(path(lowered) == "", "/").otherwise(path(lowered))
    p = F.coalesce(F.try_url_decode(p), p)
    out = F.when(F.lit(False), "")
    for bucket, parts in PATHS.items():
        out = out.when(reduce(lambda a, b: a | b, [p.contains(x) for x in parts]), bucket)
    for bucket, words in WORDS.items():
        out = out.when(p.rlike("|".join(words.split())), bucket)
    for bucket, pattern in PATTERNS:
        out = out.when(p.rlike(pattern), bucket)
    return out.otherwise("unknown")


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("bigint")


def site_structure(urls: DataFrame, as_of: str) -> DataFrame:
    """A row for each site of ``urls`` (site, loc, lastmod): totals, buckets, depth and freshness.

    One aggregation with partial sums, so a site with most of the urls is no hot spot.
    """
    rows = urls.select("site", *[c.alias(k) for k, c in url_facts().items()])
    return with_percents(rows.groupBy("site").agg(*structure_sums(as_of)))


def url_facts() -> dict[str, Column]:
    """bucket, level and day of a url (loc, lastmod)."""
    return {"bucket": classify_url(F.col("loc")), "level": depth_level(F.col("loc")), "day": F.try_to_date("lastmod")}


def structure_sums(as_of: str) -> list[Column]:
    """Aggregates of the facts of urls; rows without a bucket do not count."""
    counts = [F.count_if(F.col("bucket") == b).alias(f"{b}_count") for b in BUCKETS]
    levels = [F.count_if(F.col("level") == v).alias(v) for v in ("level1", "level2", "level3plus")]
    recent = F.count_if((F.col("day") > F.date_sub(F.lit(as_of).cast("date"), 30)) & (F.col("day") <= F.lit(as_of).cast("date")))
    return [F.count("bucket").alias("total"), *counts, *levels, F.max("day").cast("string").alias("last_modified"), recent.alias("updated_30d")]


def with_percents(per: DataFrame) -> DataFrame:
    return per.select("*", *[half_up(F.try_divide(100.0 * F.col(f"{b}_count"), F.col("total"))).alias(f"{b}_percent") for b in BUCKETS])


def top_sections(urls: DataFrame, n: int = 12) -> DataFrame:
    """The n most frequent first path segments of each site."""
    counts = urls.select("site", site_keys(F.col("loc"))["section"].alias("section")).groupBy("site", "section").agg(F.count(F.lit(1)).alias("urls"))
    place = F.row_number().over(Window.partitionBy("site").orderBy(F.desc("urls"), "section"))
    return counts.withColumn("place", place).where(F.col("place") <= n)


def top_buckets(structure: DataFrame, n: int = 3) -> DataFrame:
    """The n largest buckets of each site, by percent and then in the fixed order."""
    cells = F.array(*[F.struct(F.lit(b).alias("bucket"), F.lit(i).alias("i"), F.col(f"{b}_percent").alias("percent"), F.col(f"{b}_count").alias("urls")) for i, b in enumerate(BUCKETS)])
    rows = structure.select("site", F.explode(cells).alias("c")).select("site", "c.*").where("urls > 0")
    place = F.row_number().over(Window.partitionBy("site").orderBy(F.desc("percent"), "i"))
    return rows.withColumn("place", place).where(F.col("place") <= n).select("site", "place", "bucket", "percent", "urls")


#: What a page shows when its site has the signal. Words have Unicode edges.
SIGNALS = {
    "phone": r"(?i)tel:|\+7[\s(-]*\d{3}",
    "prices": r"(?iu)\d[\d\s]*(?:₽|руб|\$|€)",
    "cart": r"(?iu)корзин|add to cart|buy now|checkout",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "address": r"(?iu)(?<![\p{L}\p{N}_])(?:ул|улица|проспект|адрес)(?![\p{L}\p{N}_])",
    "requisites": r"(?u)(?<![\p{L}\p{N}_])(?:ИНН|ОГРН|КПП)(?![\p{L}\p{N}_])",
    "reviews": r"(?iu)отзыв|review",
    "chat": r"(?i)jivosite|livechat|chat-widget",
    "messenger": r"(?i)wa\.me|t\.me/|whatsapp|telegram",
    "docs": r"(?iu)документац|/docs/",
    "faq": r"(?iu)faq|вопросы и ответы|frequently asked",
    "demo": r"(?iu)демо|demo|trial",
}
_FORM, _FIELD = r"(?i)<form\b", r"(?iu)name=[\"'](?:name|phone)|телефон|имя"
#: What every text that the pattern of fields finds has, whatever letters fold to the others.
_FIELD_PARTS = "name=|елеф|имя"


def site_signals(pages: DataFrame) -> DataFrame:
    """site and a flag for each signal that any of its pages shows; only booleans are shuffled."""
    flags = signal_flags(F.col("html"))
    rows = pages.select("site", *[c.alias(n) for n, c in flags.items()])
    per = rows.groupBy("site").agg(*[F.coalesce(F.bool_or(n), F.lit(False)).alias(n) for n in flags])
    return per.withColumn("form", F.col("form_") & F.col("field_")).drop("form_", "field_")


#: Signals that count for a kind of site: critical, important, additional.
COMMERCE = {
    "shop": (["phone", "prices", "cart", "form"], ["requisites", "address", "email", "reviews"], ["chat", "messenger"]),
    "service": (["phone", "email", "form", "demo"], ["docs", "faq", "requisites", "reviews"], ["chat", "messenger"]),
    "corporate": (["phone", "email", "form", "address"], ["requisites", "faq", "reviews", "docs"], ["chat", "messenger"]),
}


def commerce_kind(site_type: Column) -> Column:
    """What a site's signals are held against, by its type."""
    return F.when(site_type == "saas", "service").when(site_type.isin("corporate", "landing", "aggregator", "blog"), "corporate").otherwise("shop")


def commerce_score(signals: DataFrame, kind: Column) -> DataFrame:
    """Signals found of those that count for the kind of site (shop, service, corporate)."""
    total = lambda names: sum((F.col(n).cast("int") for n in names), F.lit(0))
    pick = lambda k: F.when(kind == "shop", total(COMMERCE["shop"][k])).when(kind == "service", total(COMMERCE["service"][k])).otherwise(total(COMMERCE["corporate"][k]))
    return signals.select("*", pick(0).alias("critical_found"), pick(1).alias("important_found"), pick(2).alias("additional_found"), (pick(0) + pick(1) + pick(2)).alias("found"), F.lit(10).alias("expected"))


def signal_flags(html: Column, low: Column | None = None) -> dict[str, Column]:
    """A flag for each signal, and the two halves of a form with a field to call back (``low`` is the page in lower case, if it is known).

    A pattern is tried where a plain part of it is found, and in the shortest form that finds the same pages: the last digit
    before a price's sign, the last character before an address's @.
    """
    low = F.lower(html) if low is None else low
    plain = {name: T.any_of(low, SIGNALS[name].partition(")")[2]) for name in ("cart", "reviews", "chat", "messenger", "docs", "faq", "demo")}
    tried = {
        "phone": low.contains("tel:") | (html.contains("+7") & html.rlike(SIGNALS["phone"])),
        "prices": html.rlike(SIGNALS["prices"].replace(r"\d[\d\s]*", r"\d\s*")),
        "email": html.contains("@") & html.rlike(SIGNALS["email"].replace("]+@", "]@")),
        "address": T.any_of(low, "ул|пек|ре") & html.rlike(SIGNALS["address"]),
        "requisites": T.any_of(html, "ИНН|ОГРН|КПП") & html.rlike(SIGNALS["requisites"]),
    }
    flags = {name: html.rlike(pattern) for name, pattern in SIGNALS.items()} | plain | tried
    field = T.any_of(low, _FIELD_PARTS) & html.rlike(_FIELD)
    return {name: flags[name] for name in SIGNALS} | {"form_": low.contains("<form") & html.rlike(_FORM), "field_": field}
