"""Listings of a page: its cards and its pagination, from its markup by built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlsmith.functions import html as H
from crawlsmith.functions import text as T
from crawlsmith.functions import urls as U

#: Words of class names that tell a card of a listing, and that tell what is none.
CARD = "product-card|catalog-item|product-item|goods-item|catalog__item|product__item|item-card|grid-item|card-item|listing-item"
NO_CARD = "sidebar|aside|filter|recommend|related|similar|upsell|crosssell|banner|nav|menu|footer|header|breadcrumb|pager"
LISTS = "catalog|products|listing|grid|items"
#: Marks of a price, of a page's number in a url, and of pages that load more as one scrolls.
PRICE_MARK = r"(?iu)₽|руб|р\.(?=[A-Za-z0-9_])|\$|€"
PAGE_NUMBERS = [r"(?i)[?&](?:page|paged|pagen(?:_\d+)?)=(\d{1,5})", r"(?i)/page/(\d{1,5})(?:/|$)", r"(?i)[-_/]page[-_/]?(\d{1,5})(?:/|$)"]
EXPLICIT_PAGE = r"(?i)[?&](?:page|paged|pagen(?:_\d+)?)=\d{1,5}|/page/\d{1,5}(?:/|$)"
PAGE_RELATION = r"(?i)\brel=[\"'][^\"']*(?:last|next|prev)[^\"']*[\"']"
LAST_RELATION = r"(?i)\brel=[\"'][^\"']*last[^\"']*[\"']"
PAGER = r"(?i)pagination|pager|page-nav|nav-pages|pagen"
PAGER_BLOCKS = "pagination|pager|nav-pages|page-nav"
PAGE_LABEL = r"(?iu)^(?:\d{1,5}|следующая|предыдущая|далее|назад|next|prev)$"
INFINITE = r"infinite\s*scroll|load more|show more|показать ещё|загрузить ещё|data-next-page|ajaxpager|catalog-more"


def _quoted(attributes: Column, name: str) -> Column:
    return F.regexp_extract(attributes, rf"(?i){name}=[\"']([^\"']+)[\"']", 1)


def most_of_one(values: Column) -> Column:
    """How often the most frequent value is in an array, by a fold over the runs of the sorted one."""
    state = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(s: Column, x: Column) -> Column:
        run = F.when(s.last == x, s.run + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(s.most, run).alias("most"))

    return F.aggregate(F.array_sort(values), state, step, lambda s: s.most)


def card_classes(html: Column) -> Column:
    """The number of elements of the most frequent class that names a card."""
    classes = F.transform(F.regexp_extract_all(html, F.lit(r"(?i)<(?:div|li|article|section)\b([^>]*)>"), F.lit(1)), lambda a: F.lower(_quoted(a, "class")))
    return most_of_one(F.filter(classes, lambda c: (c != "") & ~c.rlike(NO_CARD) & c.rlike(CARD)))


def list_items(html: Column) -> Column:
    """The most items of a list whose class names a listing, up to its first end tag."""
    blocks = F.regexp_extract_all(html, F.lit(rf"(?is)<(ul|ol)\b[^>]*class=[\"'][^\"']*(?:{LISTS})[^\"']*[\"'][^>]*>.*?</\1>"), F.lit(0))
    fine = F.filter(blocks, lambda b: ~F.regexp_extract(b, r"(?s)^<([^>]*)>", 1).rlike(f"(?i){NO_CARD}"))
    return F.coalesce(F.array_max(F.transform(fine, lambda b: F.regexp_count(b, F.lit(r"(?i)<li\b")))), F.lit(0))


_CARD_TAGS = ("a", "div", "article", "li")


def priced_images(html: Column) -> Column:
    """The number of links, divs, articles and items that hold an image and then a price before the first end tag of their name; the outermost count.

    A fold over the pieces between their tags. Of each name it knows where the earliest open one began and whether an image
    and a price have come since; an end tag counts what is complete, unless a complete one that began before it still waits for its end.
    """
    names = "|".join(_CARD_TAGS)
    def fold(pieces: Column) -> Column:
        rest = lambda p: F.regexp_replace(p, r"(?s)^<[^>]*>", "")
        facts = F.transform(pieces, lambda p: F.struct(
            F.lower(F.regexp_extract(p, rf"(?i)^</?({names})(?=[\s/>])", 1)).alias("name"), p.startswith("</").alias("ends"),
            F.lower(p).contains("<img").alias("image"), p.rlike(PRICE_MARK).alias("price"), F.regexp_extract(rest(p), r"(?is)<img\b(.*)$", 1).rlike(PRICE_MARK).alias("both"),
        ))
        # A name that no end tag follows any more cannot be closed.
        last_end = lambda n: F.coalesce(F.array_max(F.transform(facts, lambda f, i: F.when(f.ends & (f["name"] == n), i))), F.lit(-1))
        state = F.struct(F.lit(0).alias("i"), F.lit(0).alias("count"), *[c for n in _CARD_TAGS for c in (F.lit(-1).alias(f"at_{n}"), F.lit(0).alias(f"stage_{n}"))])

        def step(ends: Column):
            def one(s: Column, f: Column) -> Column:
                closes = {n: f.ends & (f["name"] == n) & (s[f"at_{n}"] >= 0) & (s[f"stage_{n}"] == 2) for n in _CARD_TAGS}
                earlier = lambda n: reduce(lambda a, b: a | b, [(s[f"at_{m}"] >= 0) & (s[f"at_{m}"] < s[f"at_{n}"]) for m in _CARD_TAGS if m != n])
                counted = reduce(lambda a, b: a | b, [closes[n] & ~earlier(n) for n in _CARD_TAGS])
                cells = []
                for n in _CARD_TAGS:
                    ended, begun = f.ends & (f["name"] == n), ~f.ends & (f["name"] == n) & (s.i < ends[n])
                    before = F.when(counted | ended, -1).otherwise(s[f"at_{n}"])
                    at = F.when((before < 0) & begun, s.i).otherwise(before)
                    stage = F.when(before < 0, 0).otherwise(s[f"stage_{n}"])
                    grown = F.when((stage == 1) & f.price, 2).when((stage == 0) & f.both, 2).when((stage == 0) & f.image, 1).otherwise(stage)
                    cells += [at.alias(f"at_{n}"), F.when(at < 0, 0).otherwise(grown).alias(f"stage_{n}")]
                return F.struct((s.i + 1).alias("i"), (s["count"] + F.when(counted, 1).otherwise(0)).alias("count"), *cells)

            return one

        ends = F.struct(*[last_end(n).alias(n) for n in _CARD_TAGS])
        return H.bound(F.struct(facts.alias("facts"), ends.alias("ends")), lambda x: F.aggregate(x.facts, state, step(x.ends), lambda s: s["count"]))

    able = html.rlike(r"(?i)<img\b") & html.rlike(PRICE_MARK)
    return F.when(able, H.bound(F.split(html, rf"(?i)(?=</?(?:{names})(?=[\s/>]))"), fold)).otherwise(0)


def listing_cards(html: Column, lowered: Column | None = None) -> Column:
    """The number of cards that a page lists: the most that one of five rules finds.

    A rule is tried on pages that hold one of its words (``lowered`` is the page in lower case, if it is known already).
    """
    low = F.lower(html) if lowered is None else lowered
    marked = F.regexp_count(html, F.lit(r"(?i)<(?:article|li|div)\b[^>]*data-product"))
    named = F.regexp_count(html, F.lit(r"(?i)class=[\"'][^\"']*(?:product|catalog)[^\"']*(?:card|item)[^\"']*[\"']"))
    tried = lambda able, rule: F.when(able, rule).otherwise(0)
    return F.greatest(
        tried(T.any_of(low, CARD), card_classes(html)), tried(T.any_of(low, LISTS), list_items(html)), tried(low.contains("<img"), priced_images(html)),
        tried(low.contains("data-product"), marked), tried(T.any_of(low, "product|catalog"), named),
    )


def page_number(link: Column) -> Column:
    return F.greatest(*[F.coalesce(F.nullif(F.regexp_extract(link, p, 1), F.lit("")).cast("int"), F.lit(0)) for p in PAGE_NUMBERS])


def pagination_of(html: Column, url: Column, lowered: Column | None = None) -> Column:
    """mode (pages, infinite, single) and pages, as a struct.

    Pages are told by links that look like pagination (by relation, class, label or url) and by the numbers in its blocks;
    the greatest number counts, and blocks alone are no pagination. A url with a page's number holds the word "page".
    """
    low = F.lower(html) if lowered is None else lowered
    anchors = F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*?href=[\"'][^\"']+[\"'][^>]*>.*?</a"), F.lit(0))
    heads = F.regexp_extract_all(html, F.lit(r"(?is)<link\b[^>]*?href=[\"'][^\"']+[\"'][^>]*>"), F.lit(0))
    parts = lambda x: F.struct(F.regexp_extract(x, r"(?s)^<([^>]*)>", 1).alias("tag"), T.strip_html(F.regexp_replace(x, r"(?is)^<[^>]*>|</a$", "")).alias("text"))
    numbered = lambda h: page_number(F.coalesce(U.resolve(url, h), h))
    top = lambda xs: F.coalesce(F.array_max(xs), F.lit(0))

    def by_link(found: Column) -> Column:
        looks = F.filter(found, lambda x: x.tag.rlike(PAGE_RELATION) | x.tag.rlike(PAGER) | x.text.rlike(PAGE_LABEL) | _quoted(x.tag, "href").rlike(EXPLICIT_PAGE))
        last = F.get(F.filter(found, lambda x: x.tag.rlike(LAST_RELATION)), F.lit(0))
        return F.greatest(top(F.transform(looks, lambda x: H.bound(_quoted(x.tag, "href"), numbered))), F.coalesce(page_number(_quoted(last.tag, "href")), F.lit(0)))

    def with_blocks(most: Column) -> Column:
        blocks = F.regexp_extract_all(html, F.lit(rf"(?is)<(nav|div|ul)\b[^>]*class=[\"'][^\"']*(?:{PAGER_BLOCKS})[^\"']*[\"'][^>]*>(.*?)</\1>"), F.lit(2))
        shown = F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(r"(?:^|[>\s])(\d{1,5})(?:[<\s]|$)"), F.lit(1))))
        return F.when(most > 0, F.greatest(most, top(F.transform(shown, lambda x: x.cast("int"))))).otherwise(0)

    able = low.contains("page") | F.lower(url).contains("page")
    most = F.when(able, H.bound(H.bound(F.transform(F.concat(heads, anchors), parts), by_link), with_blocks)).otherwise(0)
    mode = lambda x: F.when(x > 1, "pages").when(T.any_of(low, INFINITE), "infinite").otherwise("single")
    return H.bound(most, lambda x: F.struct(mode(x).alias("mode"), F.when(x > 1, x).alias("pages")))
