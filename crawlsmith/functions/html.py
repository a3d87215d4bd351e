"""What a page's markup says, by patterns over the raw HTML: built-in expressions, one pass over a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlsmith.functions.text import any_of, bound, drop_blocks, drop_remarks, replaced

#: Texts of pages that turn a robot away, by state and in this order.
ACCESS = {
    "blocked": ["access denied", "forbidden", "blocked"],
    "captcha": ["captcha", "recaptcha", "hcaptcha"],
    "challenge": ["turnstile", "cf-challenge", "cloudflare", "checking your browser", "verify you are human", "attention required"],
}
#: Named characters that visible text is decoded for.
NAMED = {"&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&reg;": "®", "&mdash;": "—", "&ndash;": "–", "&hellip;": "…", "&laquo;": "«", "&raquo;": "»", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&lt;": "<", "&gt;": ">", "&amp;": "&"}


def visible_text(html: Column, low: Column | None = None) -> Column:
    """Text outside scripts and styles, the title included, white space collapsed (``low`` as in ``drop_blocks``)."""
    html = F.regexp_replace(drop_remarks(drop_blocks(html, "script", "style", low=low)), r"(?s)<[^>]+>", " ")
    html = replaced(html, NAMED)
    # A blank that stands alone is not matched: replacing each would take most of the time.
    return F.trim(F.regexp_replace(html, r"[\s\xA0]{2,}|[\t\n\x0B\f\r\xA0]", " "))


def links(html: Column) -> Column:
    """Targets of links that lead to a page."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<a\s(?:[^>]*?\s)?href\s*=\s*[\"']?\s*([^\"'\s>]+)"), F.lit(1))
    return F.filter(found, lambda x: ~x.rlike("^(#|javascript:|mailto:|tel:)"))


def access_state(text: Column) -> Column:
    lowered = F.lower(text)
    state = F.when(F.coalesce(text, F.lit("")) == "", "unknown")
    for name, tokens in ACCESS.items():
        for token in tokens:
            state = state.when(lowered.contains(token), name)
    return state.otherwise("ok")


def access_match(text: Column) -> Column:
    lowered, found = F.lower(text), F.when(F.lit(False), "")
    for tokens in ACCESS.values():
        for token in tokens:
            found = found.when(lowered.contains(token), token.replace(" ", "_"))
    return found


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in the text of a start tag; '' if it has none."""
    return F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*[\"']([^\"']*)[\"']", 1)


def tags(html: Column, name: str) -> Column:
    return F.regexp_extract_all(html, F.lit(rf"(?is)(<{name}\b[^>]*>)"), F.lit(1))


def meta(html: Column, name: str, by: str = "name") -> Column:
    """Content of the first meta element of that name, whatever the order of its attributes; null without one."""
    return meta_of(tags(html, "meta"), name, by)


def meta_of(metas: Column, name: str, by: str = "name") -> Column:
    """As ``meta``, of the meta tags of a page."""
    own = F.filter(metas, lambda t: F.lower(attribute(t, by)) == name)
    return F.nullif(attribute(F.get(own, 0), "content"), F.lit(""))


def decoded(value: Column) -> Column:
    """Text with the named characters decoded."""
    for name, char in NAMED.items():
        value = F.replace(value, F.lit(name), F.lit(char))
    return value


def first_text(html: Column, tag: str) -> Column:
    inner = F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1)
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(inner, r"(?s)<[^>]+>", " "), r"\s+", " ")), F.lit(""))


def canonical(html: Column) -> Column:
    own = F.filter(tags(html, "link"), lambda t: F.lower(attribute(t, "rel")).contains("canonical") & (attribute(t, "href") != ""))
    return F.trim(attribute(F.get(own, 0), "href"))


def head_meta(html: Column) -> dict[str, Column]:
    return {
        "title": first_text(html, "title"),
        "h1": first_text(html, "h1"),
        "description": meta(html, "description"),
        "canonical": canonical(html),
        "robots": meta(html, "robots"),
        "og_title": meta(html, "og:title", "property"),
        "lang": F.nullif(attribute(F.regexp_extract(html, r"(?is)(<html\b[^>]*>)", 1), "lang"), F.lit("")),
        "has_hreflang": html.rlike(r"(?is)<link\b[^>]*\shreflang\s*="),
    }


def jsonld_blocks(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?is)<script\b[^>]*application/ld\+json[^>]*>(.*?)</script\s*>"), F.lit(1))


def jsonld_type_count(html: Column, types: list[str]) -> Column:
    """How often one of ``types`` is declared; a list that holds several counts once."""
    values = F.flatten(F.transform(jsonld_blocks(html), lambda b: F.regexp_extract_all(b, F.lit(r'"@type"\s*:\s*("[^"]+"|\[[^\]]*\])'), F.lit(1))))
    return F.size(F.filter(values, lambda v: F.arrays_overlap(F.regexp_extract_all(v, F.lit(r'"([^"]+)"'), F.lit(1)), F.array(*map(F.lit, types)))))


#: Site systems by a mark in the page, in the order in which they are tried.
CMS = {
    "WordPress": r"wp-content|wp-includes",
    "1C-Bitrix": r"/bitrix/|bx-core",
    "Tilda": r"tilda\.ws|tildacdn",
    "Joomla": r"/media/jui/|joomla",
    "Drupal": r"drupal-settings-json|/sites/default/files",
    "OpenCart": r"catalog/view/theme|route=product",
    "Shopify": r"cdn\.shopify\.com",
    "Wix": r"static\.wixstatic\.com|wix\.com",
    "InSales": r"insales",
    "MODX": r"assets/components|modx",
    "Nuxt": r"__nuxt|/_nuxt/",
}


def detect_cms(html: Column, low: Column | None = None) -> Column:
    """The site's system and the front-end layer on top of it, joined by " + " where both are seen (``low`` is the page in lower case, if it is known)."""
    def named(low: Column) -> Column:
        cms = F.when(F.lit(False), "")
        for name, pattern in CMS.items():
            cms = cms.when(any_of(low, pattern), name)
        front = F.when(any_of(low, "__next_data__|/_next/"), "Next.js").when(any_of(low, "data-reactroot|react-dom"), "React").when(low.contains("<div id=") & low.rlike(r'<div id=[\"\'](?:app|root)[\"\']>\s*</div>'), "SPA")
        other = F.when(low.contains(".php") & low.rlike(r"\.php(?:[?\"'])"), "PHP").otherwise("other")
        return F.when(cms.isNotNull() & front.isNotNull(), F.concat(cms, F.lit(" + "), front)).otherwise(F.coalesce(cms, front, other))

    return bound(F.lower(html), named) if low is None else named(low)


#: Marks of counters.
ANALYTICS = {"yandex_metrika": "mc.yandex.ru", "google_analytics": "google-analytics.com", "google_tag_manager": "googletagmanager.com", "vk_pixel": "vk.com/rtrg"}


def detect_analytics(html: Column) -> Column:
    return F.array_compact(F.array(*[F.when(html.contains(mark), name) for name, mark in ANALYTICS.items()]))


_START = r"""<[^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+>"""


def without_remarks(html: Column) -> Column:
    """The page without comments, scripts and styles, whose text may look like tags."""
    return F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", " ")


def elements(html: Column, name: str, opens: str | None = None) -> Column:
    """start and inner of the outermost elements of that name whose start tag ``opens`` (a pattern) finds; '' without any.

    The page is cut before each of the element's tags; a fold over the pieces counts how deep they lie, so an element ends
    at the end tag that matches it, whatever elements of its name it holds. What is never closed is no element.
    """
    start = rf"(?i)^<{name}(?=[\s/>])"
    state = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("from"), F.lit(1).alias("at"), F.array().cast("array<struct<from:int,to:int>>").alias("found"))

    def step(s: Column, piece: Column) -> Column:
        begins, ends = piece.rlike(start), piece.startswith("</")
        mine = begins if opens is None else begins & F.regexp_extract(piece, _START, 0).rlike(opens)
        depth = F.when(s.depth > 0, s.depth + F.when(begins, 1).when(ends, -1).otherwise(0)).when(mine, 1).otherwise(0)
        found = F.when((s.depth == 1) & ends, F.concat(s.found, F.array(F.struct(s["from"].alias("from"), s["at"].alias("to"))))).otherwise(s.found)
        return F.struct(depth.alias("depth"), F.when((s.depth == 0) & mine, s["at"]).otherwise(s["from"]).alias("from"), (s["at"] + 1).alias("at"), found.alias("found"))

    whole = lambda pieces: F.transform(F.aggregate(pieces, state, step, lambda s: s.found), lambda f: F.array_join(F.slice(pieces, f["from"], f["to"] - f["from"]), ""))
    return F.transform(bound(F.split(html, rf"(?i)(?=</?{name}(?=[\s/>]))"), whole), lambda x: F.struct(F.regexp_extract(x, _START, 0).alias("start"), F.regexp_replace(x, f"^{_START}", "").alias("inner")))


def first_inner(html: Column, name: str, opens: str | None = None) -> Column:
    """What the first such element holds; null without one or if it holds nothing."""
    return F.nullif(F.get(F.transform(elements(html, name, opens), lambda e: e.inner), F.lit(0)), F.lit(""))


#: A JSON text in pieces: strings that name a member (with their colon), other strings, and brackets.
_JSON = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*:)?|[{}\[\]]'


def _json_strings(block: Column, member: str, as_type: bool) -> Column:
    """Strings of the members of that name at any depth of a JSON text, in the order of the objects that have them.

    A fold over the pieces of the text with the open brackets as a stack. as_type: lists of strings count, too; else
    the ``name`` of an object does, and blank strings do not.
    """
    kinds = "array<struct<open:int,kind:string,up:int>>"
    tokens = F.regexp_extract_all(block, F.lit(f"(?s){_JSON}"), F.lit(0))
    plain = lambda t: F.when(t.contains("\\"), F.get(F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>"), 0)).otherwise(F.substring(t, 2, F.length(t) - 2))
    state = F.struct(F.lit(0).alias("i"), F.array().cast(kinds).alias("stack"), F.lit("").alias("key"), F.array().cast("array<struct<open:int,at:int,value:string>>").alias("found"))

    def step(s: Column, t: Column) -> Column:
        top = F.get(s.stack, F.size(s.stack) - 1)
        inside = top.kind.isin("o", "f")
        opened = F.coalesce(top["open"], F.lit(-1))
        mine = inside & (s.key == member)
        push = lambda kind: F.concat(s.stack, F.array(F.struct(s.i.alias("open"), kind.alias("kind"), opened.alias("up"))))
        stack = (
            F.when(t == "{", push(F.when(F.lit(not as_type) & mine, "f").otherwise("o")))
            .when(t == "[", push(F.when(F.lit(as_type) & mine, "t").otherwise("a")))
            .when(t.isin("}", "]"), F.slice(s.stack, 1, F.greatest(F.size(s.stack) - 1, F.lit(0))))
            .otherwise(s.stack)
        )
        names = t.endswith(":")
        key = F.when(names, F.coalesce(plain(F.regexp_replace(t, r"\s*:$", "")), F.lit(""))).otherwise(F.lit(""))
        value = F.when(t.startswith('"') & ~names, plain(t))
        owner = F.when(mine, opened).when(top.kind == "t", top.up) if as_type else F.when(mine, opened).when((top.kind == "f") & (s.key == "name"), top.up)
        good = value.isNotNull() & owner.isNotNull() & (F.lit(True) if as_type else F.trim(value) != "")
        found = F.when(F.coalesce(good, F.lit(False)), F.concat(s.found, F.array(F.struct(owner.alias("open"), s.i.alias("at"), value.alias("value"))))).otherwise(s.found)
        return F.struct((s.i + 1).alias("i"), stack.alias("stack"), key.alias("key"), found.alias("found"))

    return F.transform(F.array_sort(F.aggregate(tokens, state, step, lambda s: s.found)), lambda x: x.value)


def _parsed(block: Column) -> Column:
    return F.try_parse_json(block).isNotNull()


def jsonld_types(html: Column) -> Column:
    """Every @type at any depth of the JSON-LD blocks, single or in a list, distinct, objects before what they hold.

    Of a block that is no JSON the types are those that a pattern finds.
    """
    scanned = lambda b: F.regexp_extract_all(b, F.lit(r'"@type"\s*:\s*"([^"]+)"'), F.lit(1))
    of = lambda b: F.when(_parsed(b), _json_strings(b, "@type", True)).otherwise(scanned(b))
    return F.array_distinct(F.flatten(F.transform(jsonld_blocks(html), of)))


def jsonld_string(html: Column, member: str) -> Column:
    """The first string of a member of that name, or the name of the object that it is, in the JSON-LD blocks; null without one."""
    found = F.flatten(F.transform(jsonld_blocks(html), lambda b: F.when(_parsed(b), _json_strings(b, member, False)).otherwise(F.array().cast("array<string>"))))
    return F.trim(F.get(found, F.lit(0)))
