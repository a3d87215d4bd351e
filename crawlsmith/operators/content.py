"""Content audit: signals of a page, its type by additive scores, and the checks for that type."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlsmith.functions import html as H
from crawlsmith.functions import text as T
from crawlsmith.functions.frames import fenced
from crawlsmith.functions.urls import host, path, resolve
from crawlsmith.operators.listing import listing_cards, pagination_of

#: Order of the types; it breaks ties.
TYPES = ["product", "category", "article", "informational", "home", "landing", "contacts", "unknown"]
#: Words that show a signal, in the visible text or (raw) in the lower-cased page.
TEXT_SIGNALS = {
    "sku": "артикул|sku|код товара|код:",
    "stock": "в наличии|нет в наличии|под заказ|доступно",
    "reviews": "отзыв|reviews?",
    "rating": "rating|рейтинг|звезд",
    "related": "похожие товары|с этим товаром|вам может понравиться|recommended",
    "delivery": "доставк|оплат",
    "toc": "содержание|оглавление|table of contents",
    "reading_time": "время чтения|мин чтения|read time",
    "author": "автор|author",
    "cta": "оставить заявку|получить|заказать|купить|попробовать|зарегистрироваться|подать заявку|buy now",
    "address": r"ул\.|улица|проспект|офис|адрес|г\.|город",
    "related_articles": "похожие статьи|ещё по теме|читайте также|related posts|similar articles",
    "requisites": r"инн|огрн|кпп|ооо|ип(?![\p{L}\p{N}_])|ао(?![\p{L}\p{N}_])|пао(?![\p{L}\p{N}_])",
}
RAW_SIGNALS = {
    "form": r"<form\b",
    "breadcrumbs": "breadcrumb|хлебн",
    "sorting": "sort|сортиров",
    "comments": "comment|комментар",
    "tags": r"rel=[\"']tag[\"']|теги|категор",
    "social": r"telegram|whatsapp|vk\.com/share|facebook\.com/sharer|twitter\.com/intent|sharethis|поделиться",
    "map": r"yandex\.ru/map|google\.com/maps|2gis|leaflet|ymaps|карта",
    "faq": "faq|вопросы и ответы|частые вопросы",
}
#: A signal in the visible text, or else in the page's markup.
EITHER_SIGNALS = {
    "specs": ("характеристик|спецификац", r"<table\b"),
    "description_block": ("описани", r"class=[\"'][^\"']*description"),
    "subcategories": ("подкатегор|подраздел", r"class=[\"'][^\"']*subcategory"),
}
#: Schema types by what they stand for.
SCHEMAS = {
    "product": ["Product", "Offer", "AggregateOffer", "Review", "AggregateRating"],
    "offer": ["Offer", "AggregateOffer"],
    "review": ["Review", "AggregateRating"],
    "item_list": ["ItemList", "CollectionPage", "OfferCatalog"],
    "article": ["Article", "NewsArticle", "BlogPosting"],
    "contact": ["Organization", "LocalBusiness", "PostalAddress", "ContactPoint"],
}
PRICE = r"(?iu)\d[\d\s]{1,12}(?:[,.]\d+)?\s*(?:₽|руб\.?|р\.(?=[A-Za-z0-9_])|₸|\$|€)"
BUY = "купить|в корзину|заказать|buy now|add to cart|оформить"
AUTHOR_ROLE = "редактор|эксперт|author-role|должность|position|контент-менеджер"
#: Names of the elements that are counted.
COUNTS = {"h1": ["h1"], "h2": ["h2"], "h3": ["h3"], "tables": ["table"], "lists": ["ul", "ol"], "quotes": ["blockquote"], "videos": ["video", "iframe"], "code": ["code", "pre"], "images": ["img"]}


def content_image(tag: Column) -> Column:
    """Whether an img tag shows content: sprites, icons and small images do not."""
    src, cls = H.attribute(tag, "src"), F.lower(H.attribute(tag, "class"))
    size = lambda n: F.coalesce(F.nullif(F.regexp_extract(H.attribute(tag, n), r"(\d+)", 1), F.lit("")).cast("int"), F.lit(0))
    return ~cls.rlike("sprite|icon|logo|avatar|emoji") & ~F.lower(src).rlike(r"\.svg(?:$|\?)") & ((size("width") == 0) | (size("width") >= 50)) & ((size("height") == 0) | (size("height") >= 50))


def _if_holds(mark: str, kind: str, found: Column) -> Column:
    """What is found on pages whose lower-cased text (low_) holds a mark, an empty array on others."""
    return F.when(F.coalesce(F.col("low_").contains(mark), F.lit(True)), found).otherwise(F.array().cast(kind))


#: What features are made from, each from the page or from those before it.
_PARTS: dict[str, tuple[str, Callable[[], Column]]] = {
    "low_": ("", lambda: F.lower("html")),
    "text_": ("low_", lambda: H.visible_text(F.col("html"), F.col("low_"))),
    "lowtext_": ("text_", lambda: F.lower("text_")),
    "body_": ("low_", lambda: T.strip_layout(F.col("html"), F.col("low_"))),
    "words_": ("body_ low_", lambda: T.strip_html(F.col("body_"), F.col("low_"))),
    "names_": ("", lambda: F.transform(F.regexp_extract_all("html", F.lit("<([A-Za-z][A-Za-z0-9_]*)"), F.lit(1)), F.lower)),
    "images_": ("low_", lambda: _if_holds("<img", "array<string>", F.filter(H.tags(F.col("html"), "img"), content_image))),
    "links_": ("", lambda: H.tags(F.col("html"), "a")),
    "hrefs_": ("links_", lambda: F.transform("links_", lambda t: H.attribute(t, "href"))),
    "types_": ("low_", lambda: _if_holds("application/ld+json", "array<string>", H.jsonld_types(F.col("html")))),
    "cards_": ("low_", lambda: listing_cards(F.col("html"), F.col("low_"))),
    "prices_": ("text_", lambda: F.regexp_extract_all("text_", F.lit(PRICE), F.lit(0))),
    "pages_": ("low_", lambda: pagination_of(F.col("html"), F.col("url"), F.col("low_"))),
    "metas_": ("low_", lambda: _if_holds("<meta", "array<string>", H.tags(F.col("html"), "meta"))),
}


def _features() -> dict[str, tuple[str, Column]]:
    """By name of a feature the parts that it is made from, and its expression."""
    low, text, types, c = F.col("low_"), F.col("lowtext_"), F.col("types_"), F.col
    has = lambda *ts: F.arrays_overlap(types, F.array(*map(F.lit, ts)))
    named = lambda *ns: F.arrays_overlap(c("names_"), F.array(*map(F.lit, ns)))
    meta = lambda name, by="name": H.meta_of(c("metas_"), name, by)
    out = {f"{k}_found": ("lowtext_", T.any_of(text, words)) for k, words in TEXT_SIGNALS.items()}
    out |= {f"{k}_found": ("low_", T.any_of(low, words)) for k, words in RAW_SIGNALS.items() if k != "form"}
    for k, own in COUNTS.items():
        out[f"{k}_count"] = ("names_", F.size(F.filter("names_", _one_of(own))))
    also = {"reviews": SCHEMAS["review"], "rating": ["AggregateRating"], "breadcrumbs": ["BreadcrumbList"], "faq": ["FAQPage"], "address": ["PostalAddress"]}
    for k, ts in also.items():
        parts, column = out[f"{k}_found"]
        out[f"{k}_found"] = (f"{parts} types_", column | has(*ts))
    href = r"(\d(?<!\d\d)\d?[./]\d{1,2}[./]\d{2,4})(?!\d)"
    inside = lambda h: (h != "") & (~h.rlike("^[a-z]+:") | (host(h) == host(c("url"))))
    outside = lambda h: h.rlike("^(?:https?:)?//") & (host(F.when(h.startswith("//"), F.concat(F.lit("https:"), h)).otherwise(h)) != host(c("url")))
    buttons = F.transform(F.regexp_extract_all("html", F.lit(r"(?is)<(a|button)\b[^>]*>(.*?)</\1>"), F.lit(2)), T.strip_html)
    head = H.head_meta(c("html"))
    some = lambda pattern, column: F.nullif(F.regexp_extract(column, pattern, 1), F.lit(""))
    return out | {
        "types": ("types_", types), "visible_text": ("text_", c("text_")),
        "word_count": ("words_", T.word_count(c("words_"))), "density": ("words_ body_", T.content_density_pct(c("words_"), c("body_"))),
        "form_found": ("names_", named("form")),
        "specs_found": ("lowtext_ names_", T.any_of(text, EITHER_SIGNALS["specs"][0]) | named("table")),
        "description_block_found": ("lowtext_ low_", T.any_of(text, EITHER_SIGNALS["description_block"][0]) | (low.contains("description") & low.rlike(EITHER_SIGNALS["description_block"][1]))),
        "subcategories_found": ("lowtext_ low_", T.any_of(text, EITHER_SIGNALS["subcategories"][0]) | (low.contains("subcategory") & low.rlike(EITHER_SIGNALS["subcategories"][1]))),
        "filter_found": ("low_ names_", T.any_of(low, "filter|фильтр") & named("form", "select", "input")),
        "phone_found": ("text_ low_", low.contains("tel:") | c("text_").contains("+7") | (c("text_").contains("8") & c("text_").rlike(r"8\s?\(?\d{3}\)?[\s-]?\d{3}"))),
        "email_found": ("text_", c("text_").contains("@") & c("text_").rlike(r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}")),
        "author_found": ("lowtext_ low_ metas_", T.any_of(text, TEXT_SIGNALS["author"]) | (low.contains("author") & (meta("author").isNotNull() | low.rlike("rel=[\"']author[\"']")))),
        "author_photo_found": ("low_ names_", low.contains("author") & named("img")),
        "author_role_found": ("lowtext_", T.any_of(text, AUTHOR_ROLE)),
        "author_schema_found": ("low_ types_", has("Person") | low.contains('"author"')),
        "team_found": ("low_", T.any_of(low, "команда|офис|team|about-us|company")),
        "date_schema_found": ("low_", low.contains('"datepublished"')),
        "price_text": ("prices_", F.get("prices_", F.lit(0))),
        "price_count": ("prices_", F.size("prices_")),
        "buy_label": ("lowtext_", F.when(T.any_of(text, BUY), F.get(F.filter(buttons, lambda t: T.any_of(F.lower(t), BUY)), F.lit(0)))),
        "buy_found": ("lowtext_", F.when(T.any_of(text, BUY), F.exists(buttons, lambda t: T.any_of(F.lower(t), BUY))).otherwise(False)),
        "listing_cards": ("cards_", c("cards_")), "pagination_mode": ("pages_", c("pages_.mode")), "pagination_pages": ("pages_", c("pages_.pages")),
        "assortment": ("cards_ pages_", F.when(c("cards_") > 0, c("cards_") * c("pages_.pages"))),
        "content_images": ("images_", F.size("images_")), "images_without_alt": ("images_", F.size(F.filter("images_", lambda t: F.trim(H.attribute(t, "alt")) == ""))),
        "internal_links": ("hrefs_", F.size(F.filter("hrefs_", inside))), "external_links": ("hrefs_", F.size(F.filter("hrefs_", outside))),
        "nofollow_links": ("links_", F.size(F.filter("links_", lambda t: F.lower(H.attribute(t, "rel")).contains("nofollow")))),
        "questions": ("names_ low_", F.size(F.filter("names_", _one_of(["details", "summary"]))) + F.when(T.any_of(low, "faq|question|answer"), F.regexp_count("low_", F.lit(r"(?:class|id)=[\"'][^\"']*(?:faq|question|answer)[^\"']*[\"']"))).otherwise(0)),
        **{f"og_{k}_found": ("metas_", meta(f"og:{k}", "property").isNotNull()) for k in ("title", "description", "image")},
        "product_schemas": ("low_", F.when(low.contains("ld+json"), H.jsonld_type_count(c("html"), ["Product"])).otherwise(0)),
        "published": ("metas_ text_ low_", F.coalesce(meta("article:published_time", "property"), meta("datepublished"), F.when(low.contains("<time"), some(r"(?i)<time\b[^>]*datetime=[\"']([^\"']+)[\"']", "html")), some(href, "text_"))),
        "updated": ("metas_", F.coalesce(meta("article:modified_time", "property"), meta("datemodified"))),
        "robots": ("metas_", F.coalesce(meta("robots"), meta("googlebot"))),
        "description": ("metas_", meta("description")), "og_title": ("metas_", meta("og:title", "property")),
        **{k: ("", head[k]) for k in ("title", "h1", "canonical", "lang")},
    }


def _one_of(names: list[str]) -> Callable[[Column], Column]:
    return lambda n: n.isin(*names)


def page_features(pages: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """page_id, url and the features of each page (page_id, url, html), in one pass and without a shuffle; html is dropped.

    Only what the asked ``columns`` (all by default) are made from is computed, each part once.
    """
    every = _features()
    wanted = list(every) if columns is None else columns
    needed: set[str] = set()
    for part in reversed(list(_PARTS)):
        if any(part in every[k][0].split() for k in wanted) or any(part in _PARTS[x][0].split() for x in needed):
            needed.add(part)
    df = pages.select("page_id", "url", "html")
    for part, (_, make) in _PARTS.items():
        if part in needed:
            df = df.withColumn(part, make())
    return fenced(fenced(df).select("page_id", "url", *[every[k][1].alias(k) for k in wanted]))


#: Features that the scores of types are made from.
TYPE_FEATURES = ["word_count", "types", "published", "listing_cards", "price_count", "product_schemas", "h2_count", "h3_count", "internal_links"]
TYPE_FEATURES += [f"{k}_found" for k in ("buy", "related", "filter", "author", "faq", "phone", "address", "cta", "reviews", "form")]


def page_type_scores(features: DataFrame) -> DataFrame:
    """features with a score for each type."""
    p = F.lower(path(F.col("url")))
    root = p.isin("", "/")
    f, n = (lambda c: F.col(f"{c}_found")), F.col("word_count")
    has = lambda *ts: F.arrays_overlap("types", F.array(*map(F.lit, ts)))
    dated, cards, priced = F.col("published").isNotNull(), F.col("listing_cards"), F.col("price_count") > 0
    catalog = has("ItemList") | ((cards >= 5) & ((F.col("price_count") >= 5) | f("filter") | p.rlike("catalog|category|shop|store|products")))
    inner = ~root
    #: What speaks for a type, and how much.
    rules: dict[str, list[tuple[Column, int]]] = {
        "product": [(inner & p.rlike("product|tovar|item|goods"), 35), (inner & (F.col("product_schemas") == 1) & ~catalog, 70), (inner & has("Product") & ~catalog, 40), (inner & priced & ~catalog, 25), (inner & F.col("buy_found") & ~catalog, 30), (inner & f("related") & priced & F.col("buy_found") & ~catalog, 10)],
        "category": [(inner & p.rlike("catalog|category|shop|store|collection|products"), 25), (inner & catalog, 95), (inner & has("ItemList"), 55), (inner & (cards >= 4), 35), (inner & f("filter"), 25), (inner & (n >= 120) & (cards >= 4), 10)],
        "article": [(inner & p.rlike("blog|article|news|stati|post"), 35), (inner & has("Article", "NewsArticle", "BlogPosting"), 60), (inner & (n >= 500) & (F.col("h2_count") + F.col("h3_count") >= 3), 35), (inner & f("author"), 15), (inner & dated, 20)],
        "informational": [(inner & p.rlike("contact|kontakty|contacts|o-nas|about|faq|help|pomoshch"), 40), (has("Organization", "LocalBusiness"), 30), (inner & (n < 500) & ~f("author") & ~dated, 20), (inner & f("faq") & ~has("Article") & (n < 700), 20), (inner & (f("phone") | f("address")) & ~dated & ~f("author"), 20)],
        "home": [(root, 90), (root & f("cta"), 25), (root & (F.col("internal_links") >= 10), 20), (root & f("reviews"), 10), (root & (n >= 180), 10), (root & f("faq") & ~has("Article") & (n < 700), 10), (root & (f("phone") | f("address")) & ~dated & ~f("author"), 10)],
        "landing": [(inner & p.rlike("landing|lp|promo"), 25), (f("form") & f("cta") & (cards < 3) & root, 70), (f("form") & f("cta") & (cards < 3) & inner, 30), ((n < 220) & f("form") & ~has("Article", "ItemList") & root, 25), ((n < 220) & f("form") & ~has("Article", "ItemList") & inner, 15)],
        "contacts": [(inner & p.rlike("contact|kontakty|contacts|o-nas|about"), 35), (f("phone") & f("address") & f("form"), 35)],
    }
    score = lambda rs: reduce(lambda a, r: a + F.when(F.coalesce(r[0], F.lit(False)), r[1]).otherwise(0), rs, F.lit(0))
    df = features.withColumns({f"score_{t}": score(rs) for t, rs in rules.items()})
    return fenced(df).withColumn("score_unknown", F.when(F.greatest(*[F.col(f"score_{t}") for t in rules]) == 0, 20).otherwise(0))


def resolve_page_type(scored: DataFrame, override: str | None = None, force_best: bool = False) -> DataFrame:
    """scored with page_type, confidence, needs_choice and the three best suggestions."""
    name = lambda t: "informational" if t == "contacts" else t
    cells = F.array(*[F.struct((-F.col(f"score_{t}")).alias("minus"), F.lit(i).alias("i"), F.lit(name(t)).alias("key"), F.col(f"score_{t}").alias("score")) for i, t in enumerate(TYPES)])
    df = fenced(scored.withColumn("all_", F.array_sort(cells)))
    if override and override != "unknown":
        return df.withColumn("page_type", F.lit(override)).withColumn("confidence", F.lit(100)).withColumn("needs_choice", F.lit(False)).withColumn("suggestions", F.array().cast("array<string>")).drop("all_")
    root = F.lower(path(F.col("url"))).isin("", "/")
    df = fenced(df.withColumn("few_", F.when(root, F.filter("all_", lambda x: x.key.isin("home", "landing"))).otherwise(F.col("all_"))))
    best, second = F.get("few_", F.lit(0)), F.get("few_", F.lit(1))
    confidence = F.greatest(F.lit(35), F.least(F.lit(98), 2 * best.score - second.score))
    df = df.withColumn("page_type", best.key).withColumn("confidence", confidence)
    choice = F.lit(False) if force_best else (F.col("page_type") == "unknown") | (F.col("confidence") < 80)
    some = F.slice(F.filter("all_", lambda x: (x.key != "unknown") & (x.score > 0)), 1, 3)
    return df.withColumn("needs_choice", choice).withColumn("suggestions", F.transform(some, lambda x: x.key)).drop("all_", "few_")


#: Numbers of checks by type, which are not the numbers of rules; informational pages about contacts have one more.
TOTALS = {"product": 15, "category": 13, "article": 19, "home": 8, "landing": 8, "contacts": 7, "informational": 6}


def informational_subtype() -> Column:
    """contacts, about, faq or generic, by the path, or by a block of questions."""
    p = F.lower(path(F.col("url")))
    return (
        F.when(p.rlike("/contacts?/|/kontakty?/|/contact-us/|/support/contacts"), "contacts")
        .when(p.rlike("/about/|/o-nas/|/company/|/about-us/"), "about")
        .when(p.rlike("/faq/|/help/|/pomoshch/|/questions/") | F.col("faq_found"), "faq")
        .otherwise("generic")
    )


def content_rules() -> dict[str, list[tuple[str, str, Column]]]:
    """By page type (of informational pages: by subtype), severity, name and condition of each check that fails."""
    no = lambda c: ~F.col(f"{c}_found")
    has = lambda *ts: F.arrays_overlap("types", F.array(*map(F.lit, ts)))
    schema = lambda k: has(*SCHEMAS[k])
    zero = lambda c: F.col(c) == 0
    reviews, crumbs = no("reviews") & ~schema("review"), no("breadcrumbs") & ~has("BreadcrumbList")
    faq, address = no("faq") & ~has("FAQPage"), no("address") & ~has("PostalAddress")
    pages, goods = F.col("pagination_mode") == "pages", F.coalesce("assortment", F.lit(0))
    infinite = F.col("pagination_mode") == "infinite"
    described = (F.col("word_count") >= 120) | F.col("visible_text").rlike("(?iu)описание категории|о категории")
    h1, unreachable = ("critical", "h1", zero("h1_count")), no("phone") & no("email") & address
    empty, thin = ("critical", "nearly_empty", F.col("density") < 10), F.col("word_count") < 250
    return {
        "product": [
            ("critical", "price", zero("price_count")), ("critical", "buy_button", ~F.col("buy_found")), ("critical", "images", zero("content_images")), h1, ("critical", "product_schema", ~schema("product")),
            ("warn", "reviews", reviews), ("warn", "breadcrumbs", crumbs), ("warn", "specs", no("specs")), ("warn", "offer_schema", ~schema("offer")), ("warn", "description_block", no("description_block")), ("warn", "delivery", no("delivery")),
            ("improve", "related", no("related")), ("improve", "faq", faq), ("improve", "review_schema", ~schema("review")), ("improve", "image_alt", (F.col("content_images") > 0) & (F.col("images_without_alt") > 0)),
        ],
        "category": [
            h1, ("critical", "price", zero("price_count")), ("critical", "filter_duplicates", F.col("filter_found") & (F.coalesce("canonical", F.lit("")) == "")),
            ("warn", "category_description", ~described), ("warn", "filter", no("filter")), ("warn", "item_list_schema", ~schema("item_list")), ("warn", "breadcrumbs", crumbs), ("warn", "pagination", ~pages & ~infinite),
            ("warn", "small_assortment", pages & (goods > 0) & (goods < 20)), ("warn", "huge_assortment", pages & (goods > 1000)),
            ("improve", "quick_buy", ~F.col("buy_found")), ("improve", "subcategories", no("subcategories")), ("improve", "infinite_without_pages", infinite), ("improve", "large_assortment", pages & (goods > 500) & (goods <= 1000)),
        ],
        "article": [
            h1, ("critical", "words", F.col("word_count") < 300), ("critical", "article_schema", ~schema("article")), ("critical", "date", F.col("published").isNull()), empty,
            ("warn", "author", no("author")), ("warn", "headings", F.col("h2_count") + F.col("h3_count") == 0), ("warn", "internal_links", zero("internal_links")), ("warn", "images", zero("content_images")), ("warn", "date_schema", no("date_schema")), ("warn", "cta", no("cta")), ("warn", "image_alt", F.col("images_without_alt") > 0), ("warn", "density", (F.col("density") >= 10) & (F.col("density") < 25)),
            ("improve", "toc", no("toc")), ("improve", "reading_time", no("reading_time")), ("improve", "tables", zero("tables_count")), ("improve", "external_links", zero("external_links")), ("improve", "faq_schema", ~has("FAQPage")), ("improve", "related_articles", no("related_articles")), ("improve", "comments", no("comments")), ("improve", "videos", zero("videos_count")), ("improve", "tags", no("tags")),
        ],
        "informational/contacts": [h1, empty, ("critical", "phone", no("phone")), ("critical", "address", address), ("warn", "local_business_schema", ~has("LocalBusiness")), ("warn", "email", no("email")), ("improve", "map", no("map"))],
        "informational/about": [h1, empty, ("warn", "organization_schema", ~has("Organization")), ("warn", "contacts", unreachable), ("improve", "team_photo", no("team") | zero("content_images"))],
        "informational/faq": [h1, empty, ("critical", "faq_schema", ~has("FAQPage")), ("warn", "faq", faq), ("improve", "few_questions", (F.col("questions") > 0) & (F.col("questions") < 5))],
        "informational/generic": [h1, empty, ("warn", "organization_schema", ~has("Organization", "LocalBusiness")), ("warn", "contacts", unreachable), ("improve", "images", zero("content_images"))],
        "home": [
            h1, ("critical", "title", F.col("title").isNull()), ("warn", "cta", no("cta")), ("warn", "contact_or_form", no("phone") & no("email") & no("form")), ("warn", "og_image", no("og_image")), ("warn", "home_schema", ~has("Organization", "WebSite", "WebPage", "Service")),
            ("improve", "trust", reviews), ("improve", "faq", faq), ("improve", "words", thin),
        ],
        "landing": [
            h1, ("critical", "form", no("form")), ("critical", "cta", no("cta")), ("warn", "trust", reviews), ("warn", "og_image", no("og_image")), ("warn", "service_schema", ~has("Service")), ("improve", "faq", faq), ("improve", "words", thin),
        ],
        "contacts": [
            ("critical", "phone", no("phone")), ("critical", "address", address), ("critical", "form", no("form")), ("warn", "email", no("email")), ("warn", "requisites", no("requisites")), ("warn", "contact_schema", ~schema("contact")),
            ("improve", "open_graph", no("og_title") | no("og_description")),
        ],
        "unknown": [h1, ("critical", "title", F.col("title").isNull()), ("warn", "description", F.col("description").isNull()), ("warn", "words", thin), ("improve", "images", zero("content_images"))],
    }


def content_issues(df: DataFrame) -> DataFrame:
    """df (features and page_type) with subtype and issues: severity and what is missing for the type, gravest first."""
    none_yet = F.array().cast("array<struct<severity:string,what:string>>")
    df = fenced(df.withColumn("subtype", F.when(F.col("page_type") == "informational", informational_subtype())))
    kind = F.concat_ws("/", "page_type", "subtype")
    out = F.when(F.lit(False), none_yet)
    for name, checks in content_rules().items():
        out = out.when(kind == name, F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.struct(F.lit(s).alias("severity"), F.lit(w).alias("what"))) for s, w, c in checks])))
    return fenced(df.withColumn("issues", F.coalesce(out, none_yet)))


def content_verdict(df: DataFrame) -> DataFrame:
    """df with verdict, total and passed; pages whose type needs a choice stop at phase detect."""
    any_ = lambda s: F.exists("issues", lambda x: x.severity == s)
    total = reduce(lambda a, kv: a.when(F.col("page_type") == kv[0], kv[1]), TOTALS.items(), F.when(F.col("subtype") == "contacts", 7)).otherwise(5)
    verdict = F.when(any_("critical"), "fail").when(any_("warn"), "warn").otherwise("ok")
    return df.withColumns({"phase": F.when(F.col("needs_choice"), "detect").otherwise("audit"), "verdict": F.when(~F.col("needs_choice"), verdict), "total": total, "passed": F.greatest(F.lit(0), total - F.size("issues"))})


def catalog_structure(df: DataFrame) -> DataFrame:
    """page_id, items_on_page, pagination_pages, infinite_scroll, assortment and a note on it; null but for categories."""
    category, mode, cards = F.col("page_type") == "category", F.col("pagination_mode"), F.nullif("listing_cards", F.lit(0))
    note = (
        F.when((mode == "infinite") & cards.isNotNull(), "infinite_at_least")
        .when(mode == "infinite", "infinite")
        .when((mode == "pages") & (F.coalesce("assortment", F.lit(0)) > 0), "estimate")
        .when(cards.isNotNull(), "no_pagination")
    )
    found = {"items_on_page": cards, "pagination_pages": F.when(mode == "pages", F.col("pagination_pages")), "infinite_scroll": mode == "infinite", "assortment": F.when(mode == "pages", F.col("assortment")), "note": note}
    return df.select("page_id", *[F.when(category, c).alias(k) for k, c in found.items()])


def compare_summary(df: DataFrame) -> DataFrame:
    """What a comparison takes from audited pages: page_id, url, page_type, numbers of issues by severity and figures of the page; null figures where an audit stopped at its type."""
    audited = ~F.col("needs_choice")
    count = lambda s: F.when(audited, F.size(F.filter("issues", lambda x: x.severity == s)))
    category, mode = F.col("page_type") == "category", F.col("pagination_mode")
    figures = {"word_count": F.col("word_count"), "density": F.col("density"), "internal_links": F.col("internal_links"), "content_images": F.col("content_images"), "author_found": F.col("author_found"), "article_schema_found": F.arrays_overlap("types", F.array(*map(F.lit, SCHEMAS["article"])))}
    listing = {"items_on_page": F.when(category, F.nullif("listing_cards", F.lit(0))), "pagination_pages": F.when(category & (mode == "pages"), F.col("pagination_pages")), "estimated_assortment": F.when(category & (mode == "pages"), F.col("assortment")), "infinite_scroll": category & (mode == "infinite")}
    return df.select("page_id", "url", "page_type", count("critical").alias("critical_count"), count("warn").alias("important_count"), count("improve").alias("improve_count"), *[c.alias(k) for k, c in (figures | listing).items()])


def representative_url(urls: DataFrame, kind: str = "default") -> DataFrame:
    """site, url: the url (site, loc, pos) that stands best for a site; the earliest of the best, or none above 0."""
    p = F.lower(path(F.col("loc")))
    s = lambda pattern, n: F.when(p.rlike(pattern), n).otherwise(0)
    if kind == "article":
        score = s("/blog/|/article/|/news/|/stati/|/post/", 120) + s("/blog/|/article/|/news/", 40)
    else:
        score = s("/product/|/tovar/|/item/", 100) + s("/catalog/[^/]+/[^/]+", 90) + s("/catalog/|/category/|/shop/", 70) + s("/blog/|/article/|/news/", 40)
    rows = urls.select("site", "loc", "pos", score.alias("score"))
    best = rows.groupBy("site").agg(F.max(F.struct("score", (-F.col("pos")).alias("m"), "loc")).alias("b"))
    return best.select("site", F.when(F.col("b.score") > 0, F.col("b.loc")).alias("url"), F.col("b.score").alias("score"))


#: What a menu link is about, by how much it says about a site's owner.
MENU_PRIORITY = [
    (5, "contact|контакт|about|о нас|company|requisite|реквизит|legal|privacy|policy|oferta|terms"),
    (4, "faq|вопрос|question|docs|documentation|help|поддержк"),
    (3, "service|услуг|catalog|каталог|product|решени|pricing|тариф"),
]
_MEDIA = r"(?i)\.(?:jpg|jpeg|png|gif|svg|webp|pdf|xml)$"


def with_menu(pages: DataFrame, labels: int = 20, links: int = 10, low: Column | None = None) -> DataFrame:
    """``pages`` (url, html and others) with menu_labels and menu_links (label, url) of the links within nav and header elements, else of the whole page.

    Only links to the page's own origin that are no files and have a label of 80 characters at most; labels and links are distinct,
    and links to the root are left out. ``low`` is the page in lower case, if it is known already.
    """
    clean = H.without_remarks(F.col("html"))
    low = F.lower("html") if low is None else low
    inner = lambda h, name: F.when(low.contains(f"<{name}"), F.transform(H.elements(h, name), lambda e: e.inner)).otherwise(F.array().cast("array<string>"))
    areas = H.bound(clean, lambda h: F.concat(inner(h, "nav"), inner(h, "header")))
    origin = F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    source = F.when(F.size(areas) > 0, F.array_join(areas, " ")).otherwise(clean)
    anchors = lambda h: F.regexp_extract_all(h, F.lit(r"(?is)(<a\b[^>]*href=[\"'][^\"']+[\"'][^>]*>.*?</a>)"), F.lit(1))
    parts = lambda a: F.struct(T.strip_html(F.regexp_replace(a, r"(?is)^<a\b[^>]*>|</a>$", "")).alias("label"), resolve(F.concat(origin, F.lit("/")), H.decoded(F.regexp_extract(a, r"(?i)href=[\"']([^\"']+)[\"']", 1))).alias("url"))
    inside = lambda x: F.lower(F.regexp_extract(x.url, r"^([a-z+.-]+://[^/?#]*)", 1)) == F.lower(origin)
    fine = lambda xs: F.filter(xs, lambda x: (x.label != "") & (F.length(x.label) <= 80) & inside(x) & ~path(x.url).rlike(_MEDIA))
    found = H.bound(source, lambda h: fine(F.transform(anchors(h), parts)))
    first = lambda xs: F.filter(xs, lambda x, i: (F.array_position(F.transform(xs, lambda y: y.url), x.url) == i + 1) & ~path(x.url).isin("", "/"))
    both = H.bound(found, lambda xs: F.struct(F.slice(F.array_distinct(F.transform(xs, lambda x: x.label)), 1, labels).alias("labels"), F.slice(first(xs), 1, links).alias("links")))
    df = fenced(pages.withColumn("menu_", both))
    return df.withColumns({"menu_labels": F.coalesce("menu_.labels", F.array().cast("array<string>")), "menu_links": F.coalesce("menu_.links", F.array().cast("array<struct<label:string,url:string>>"))}).drop("menu_")


def ranked_menu(links: Column, most: int = 6) -> Column:
    """The menu links that say most about a site's owner, in the menu's order where equal."""
    about = lambda x: F.lower(F.concat(x.label, F.lit(" "), x.url))
    rank = lambda x: reduce(lambda out, p: out.when(T.any_of(about(x), p[1]), p[0]), MENU_PRIORITY, F.when(F.lit(False), 0)).otherwise(1)
    ranked = F.array_sort(F.transform(links, lambda x, i: F.struct((-rank(x)).alias("minus"), i.alias("i"), x.url.alias("href"), x.label.alias("label"))))
    return F.transform(F.slice(ranked, 1, most), lambda x: F.struct(x.href.alias("href"), x.label.alias("label")))


def menu(pages: DataFrame) -> DataFrame:
    """page_id, labels and links of each page's menu."""
    return with_menu(pages.select("page_id", "url", "html")).select("page_id", F.col("menu_labels").alias("labels"), F.col("menu_links").alias("links"))


def menu_links(pages: DataFrame, most: int = 6) -> DataFrame:
    """page_id, place, href, label of the best menu links of each page; they are ordered within its row, so nothing is shuffled."""
    return menu(pages).select("page_id", F.posexplode(ranked_menu(F.col("links"), most)).alias("place", "x")).select("page_id", (F.col("place") + 1).alias("place"), "x.href", "x.label")


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, pos, href, internal, text, nofollow of every link that leads to a place on a network."""
    found = F.regexp_extract_all("html", F.lit(r"(?is)(<a\s[^>]*>.*?</a>)"), F.lit(1))
    rows = pages.select("page_id", "url", F.posexplode(found).alias("pos", "a")).withColumn("tag", F.regexp_extract("a", r"(?is)^(<a\s[^>]*>)", 1))
    href = H.attribute(F.col("tag"), "href")
    rows = rows.where(href != "").withColumn("href", resolve(F.col("url"), H.decoded(href)))
    text = F.trim(F.regexp_replace(F.regexp_replace("a", r"(?s)<[^>]+>", " "), r"\s+", " "))
    return fenced(rows).where("href IS NOT NULL").select("page_id", "pos", "href", (host(F.col("href")) == host(F.col("url"))).alias("internal"), text.alias("text"), F.lower(H.attribute(F.col("tag"), "rel")).contains("nofollow").alias("nofollow"))


def page_images(pages: DataFrame) -> DataFrame:
    """page_id, pos, src, alt, content_image; sprites, icons and small images are no content."""
    rows = pages.select("page_id", F.posexplode(H.tags(F.col("html"), "img")).alias("pos", "tag"))
    alt = F.nullif(H.attribute(F.col("tag"), "alt"), F.lit(""))
    return rows.select("page_id", "pos", H.attribute(F.col("tag"), "src").alias("src"), alt.alias("alt"), content_image(F.col("tag")).alias("content_image"))
