"""Is a page ready for answer engines? Type, schema coverage, FAQ signals and content checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlsmith.functions import html as H
from crawlsmith.functions import text as T
from crawlsmith.functions.frames import fenced
from crawlsmith.functions.urls import compare_key, path, query

#: Schema types by weight.
CRITICAL = ["FAQPage", "QAPage", "Product", "Offer", "AggregateOffer", "Article", "NewsArticle", "BlogPosting", "LocalBusiness", "HowTo", "Review", "AggregateRating"]
IMPORTANT = ["Organization", "Person", "WebSite", "WebPage", "WebApplication", "Service", "Event", "VideoObject", "ImageObject"]
BASIC = ["BreadcrumbList", "ListItem", "SiteLinksSearchBox", "SearchAction"]
SEVERITY = ["fail", "warn", "ok"]
#: Schema types that a kind of page must have, and those of which any will do for others.
NEEDED = {"article": ["Article", "NewsArticle", "BlogPosting"], "product": ["Product", "Offer", "AggregateOffer"], "faq": ["FAQPage", "QAPage"]}
GENERAL = ["Service", "WebSite", "Organization", "WebPage", "BreadcrumbList", "ListItem"]


def faq_signals(html: Column, types: Column) -> Column:
    """Which signs of questions and answers a page has."""
    signs = {
        "schema": F.array_contains(types, "FAQPage"),
        "details": html.rlike(r"(?is)<details\b[^>]*>.*?<summary\b"),
        "classes": html.rlike(r"(?i)class=[\"'][^\"']*(?:faq|question|answer)[^\"']*[\"']"),
        "pairs": F.regexp_count(html, F.lit(r"(?is)<h3\b[^>]*>.*?</h3>\s*<p\b[^>]*>.*?</p>")) >= 2,
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in signs.items()]))


def faq_card(kind: Column, signals: Column) -> Column:
    return F.when(F.size(signals) > 0, "ok").when(kind == "faq", "fail").when(kind == "docs", "warn").otherwise("na")


def schema_card(kind: Column, types: Column) -> Column:
    """Whether a page of that kind has the schema it should have."""
    has = lambda names: F.arrays_overlap(types, F.array(*map(F.lit, names)))
    any_ = has(CRITICAL + IMPORTANT + BASIC)
    card = F.when(F.lit(False), "")
    for name, own in NEEDED.items():
        card = card.when((kind == name) & has(own), "ok").when((kind == name) & any_, "warn").when(kind == name, "fail")
    return card.when((kind == "service") & has(GENERAL), "ok").when(kind == "service", "na").when(any_, "ok").otherwise("na")


def _word(words: str) -> str:
    return rf"/(?:{words})(?![a-z0-9_])"


def ai_page_type(url: Column, html: Column, types: Column, faq: Column) -> Column:
    """The first kind that fits: home, search, faq, docs, article, product, category, service or unknown."""
    p, q, low = F.lower(path(url)), F.lower(query(url)), F.transform(types, F.lower)
    has = lambda *ts: F.arrays_overlap(low, F.array(*map(F.lit, ts)))
    return (
        F.when(p.isin("", "/"), "home")
        .when(p.rlike(_word("search|results|find|poisk")) | q.rlike("(?:^|&)(?:q|query|search|s)="), "search")
        .when(has("faqpage", "qapage") | p.rlike(_word("faq|help|question|answer|voprosy-otvety") + "|/dwqa-") | (F.size(faq) >= 2), "faq")
        .when(p.rlike(_word("docs|documentation|guide|manual|reference|knowledge-base")), "docs")
        .when(has("article", "newsarticle", "blogposting") | p.rlike(_word("blog|news|article|post|stati|novosti")) | (html.rlike(r"(?i)<article\b") & (html.rlike("(?i)datepublished|article:published_time") | html.rlike(r"(?i)rel=[\"'][^\"']*author"))), "article")
        .when(has("product", "offer", "aggregateoffer") | p.rlike(_word("product|products|shop|tovar|buy")) | (html.rlike("(?iu)₽|руб|price|цена") & html.rlike("(?iu)add to cart|в корзину|купить|заказать")), "product")
        .when(p.rlike(_word("catalog|category|categories|collection|tag")), "category")
        .when(has("service") | p.rlike(_word("service|services|uslugi|solution|landing")), "service")
        .otherwise("unknown")
    )


def schema_coverage(types: Column) -> dict[str, Column]:
    match = lambda names: F.size(F.array_intersect(types, F.array(*map(F.lit, names))))
    return {"schema_critical": match(CRITICAL), "schema_important": match(IMPORTANT), "schema_basic": match(BASIC)}


def content_readiness(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with page type, a state for each of eleven checks, how many of the applicable pass, and cards."""
    df = pages.withColumn("types", H.jsonld_types(F.col("html"))).withColumn("faq", faq_signals(F.col("html"), F.col("types")))
    df = df.withColumn("ai_type", ai_page_type(F.col("url"), F.col("html"), F.col("types"), F.col("faq")))
    html, m = F.col("html"), H.head_meta(F.col("html"))
    facts = {f"m_{k}": m[k] for k in ("title", "h1", "description", "canonical", "og_title", "lang")} | {
        "m_og_description": H.meta(html, "og:description", "property"), "m_og_image": H.meta(html, "og:image", "property"), "words": T.word_count(T.strip_html(html)),
        **{f"m_{tag}": F.regexp_count(html, F.lit(rf"(?i)<{tag}\b")) for tag in ("h2", "h3", "table")}, "m_h1s": F.regexp_count(html, F.lit(r"(?i)<h1\b")), "m_lists": F.regexp_count(html, F.lit("(?i)<(?:ul|ol)")),
        "m_dated": html.rlike(r'(?i)"datePublished"\s*:\s*"[^"]') | H.meta(html, "article:published_time", "property").isNotNull() | H.meta(html, "article:published_time").isNotNull(),
        "m_signed": html.rlike(r'(?i)"author"\s*:\s*[\[{"]') | html.rlike(r"(?i)<a[^>]*rel=[\"'][^\"']*author"),
        "m_hidden": html.rlike(r"(?i)<(?:main|article|section|div)\b[^>]*(?:id|class)=[\"'][^\"']*(?:content|main|article|post|entry)[^\"']*[\"'][^>]*(?:style=[\"'][^\"']*display\s*:\s*none|hidden)"),
    }
    df = fenced(df.withColumns(facts))
    kind = F.col("ai_type")
    tokens = lambda c: F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), "(?iu)[^a-zа-я0-9]+", " "), " "), lambda x: F.length(x) > 2))
    a, b = tokens("m_title"), tokens("m_h1")
    topic = (F.size(a) > 0) & (F.size(b) > 0) & (F.size(F.array_intersect(a, b)) >= F.least(F.lit(2), F.size(a), F.size(b)))
    n, text, search = F.length("m_description"), kind.isin("article", "docs", "faq"), kind == "search"
    og = sum((F.col(f"m_og_{k}").isNotNull().cast("int") for k in ("title", "description", "image")), F.lit(0))
    canonical = F.coalesce("m_canonical", F.lit(""))
    wanted = lambda found, where: F.when(found, "ok").when(where, "warn").otherwise("na")
    checks = {
        "h1": F.when(F.col("m_h1s") == 0, "fail").when((F.col("m_h1s") == 1) & topic, "ok").otherwise("warn"),
        "description": F.when(n.isNull(), "fail").when(n.between(120, 160), "ok").otherwise("warn"),
        "headings": F.when(F.col("m_hidden") | (F.col("m_h1s") == 0) | ((F.col("m_h3") > 0) & (F.col("m_h2") == 0)), "fail").otherwise(wanted((F.col("m_h2") > 0) | (F.col("m_h3") > 0), text)),
        "words": F.when(search, "na").when(F.col("words") < 300, "fail").when(F.col("words") <= 500, "warn").otherwise("ok"),
        "lists": wanted(F.col("m_lists") > 0, text),
        "tables": wanted(F.col("m_table") > 0, kind.isin("docs", "article", "product", "category")),
        "date": wanted(F.col("m_dated"), kind.isin("article", "docs")),
        "author": wanted(F.col("m_signed"), kind.isin("article", "docs")),
        "og": F.when(og == 3, "ok").when(og > 0, "warn").when(search, "na").otherwise("fail"),
        "lang": F.when(F.col("m_lang").isNotNull(), "ok").otherwise("warn"),
        "canonical": F.when(canonical == "", "fail").when(compare_key(canonical) == compare_key(F.col("url")), "ok").otherwise("warn"),
    }
    df = fenced(df.withColumns({f"check_{k}": F.coalesce(c, F.lit("fail")) for k, c in checks.items()}))
    count = lambda s: sum(((F.col(f"check_{k}") == s).cast("int") for k in checks), F.lit(0))
    df = df.withColumns({"passed": count("ok"), "applicable": F.lit(len(checks)) - count("na"), "failed": count("fail")})
    few = F.col("passed") <= F.greatest(F.lit(1), F.floor(F.col("applicable") / 2))
    card = F.when((F.col("failed") > 0) & few, "fail").when((F.col("failed") > 0) | (count("warn") > 0), "warn").otherwise("ok")
    cards = {"content_card": card, "schema_card": schema_card(kind, F.col("types")), "faq_card": faq_card(kind, F.col("faq"))}
    return df.withColumns(cards | schema_coverage(F.col("types"))).drop("html", *[c for c in facts if c != "words"])


def ai_readiness_verdict(*cards: Column) -> Column:
    """The worst of the cards that apply."""
    out = F.when(F.lit(False), "")
    for s in SEVERITY:
        hit = F.lit(False)
        for c in cards:
            hit = hit | F.coalesce(c == s, F.lit(False))
        out = out.when(hit, s)
    return out.otherwise("na")
