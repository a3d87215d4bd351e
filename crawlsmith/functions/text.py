"""Text columns: cleaning, tokens, phrases and the fields of free text."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Russian function words.
STOPWORDS = ["и", "в", "во", "на", "по", "для", "как", "что", "это", "или", "из", "с", "со", "от", "до", "к", "у", "за", "под", "над", "не", "нет", "ли", "а", "но", "же", "при", "про", "после", "если", "то", "где", "когда", "почему", "зачем", "бы"]
#: Words that an imperative seed shares with most others, and stems too general to anchor one.
GENERIC_WORDS = ["проверить", "проверка", "найти", "сайт", "сайта", "страница", "страницы"]
GENERIC_STEMS = ["провер", "найт", "узнат", "посмотр", "спис", "все", "весь", "сайт", "страниц", "главн", "регион", "региональ", "открыт"]
#: Russian endings, in the order in which they are tried.
ENDINGS = "иями|ями|ами|ов|ев|ей|ий|ый|ой|ое|ее|ая|яя|ые|ие|ым|им|ом|ем|ую|юю|ых|их|ах|ях|ам|ям|а|я|ы|и|у|ю|е|о"
#: Transliteration, by Cyrillic letter.
LETTERS = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s",
    "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "cz", "ч": "ch", "ш": "sh", "щ": "sch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}
#: Entities that are decoded, in this order.
ENTITIES = {"&nbsp;": " ", "&amp;": "&", "&quot;": '"', "&#39;": "'", "&lt;": "<", "&gt;": ">"}


_PLAIN = re.compile(r"(?:[^\\.^$*+?{}\[\]|()]|\\\.)+")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it, also within its lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def any_of(lowered: Column, words: str) -> Column:
    """Whether a lower-cased text holds one of ``words`` (parted by |). Plain ones are looked for as they are, which is many times faster than a pattern."""
    parts = words.split("|")
    return reduce(lambda a, b: a | b, [lowered.contains(w.replace("\\.", ".")) if _PLAIN.fullmatch(w) else _begun(lowered, w) for w in parts])


def _begun(lowered: Column, pattern: str) -> Column:
    """A pattern that is looked for only where the plain characters that it begins with are."""
    plain = _PLAIN.match(pattern)
    begin = plain[0] if plain else ""
    if pattern[len(begin) : len(begin) + 1] in ("?", "*", "{"):
        begin = begin[:-2] if begin.endswith("\\.") else begin[:-1]
    return lowered.contains(begin.replace("\\.", ".")) & lowered.rlike(pattern) if begin else lowered.rlike(pattern)


def collapse(c: Column) -> Column:
    """White space as single blanks, none at the ends. Blanks that stand alone already are not matched: replacing each takes most of the time."""
    return F.trim(F.regexp_replace(F.replace(c, F.lit("\u00a0"), F.lit(" ")), r"\s{2,}|[\t\n\x0B\f\r]", " "))


def drop_blocks(html: Column, *tags: str, low: Column | None = None) -> Column:
    """The page without elements of these names; ``low``, the page or what it is a part of in lower case, saves looking for those that it lacks."""
    for tag in tags:
        pattern = rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>"
        html = F.regexp_replace(html, pattern, " ") if low is None else _if_able(html, lambda h: low.contains(f"<{tag}"), lambda h: F.regexp_replace(h, pattern, " "))  # noqa: B023
    return html


def _if_able(value: Column, able: Callable[[Column], Column], made: Callable[[Column], Column]) -> Column:
    return bound(value, lambda h: F.when(able(h), made(h)).otherwise(h))


def drop_remarks(html: Column) -> Column:
    return _if_able(html, lambda h: h.contains("<!--"), lambda h: F.regexp_replace(h, r"(?s)<!--.*?-->", " "))


def replaced(text: Column, entities: dict[str, str]) -> Column:
    """Text with its entities, which all begin with &, replaced in their order."""
    def each(t: Column) -> Column:
        for entity, char in entities.items():
            t = F.replace(t, F.lit(entity), F.lit(char))
        return t

    return _if_able(text, lambda t: t.contains("&"), each)


def strip_html(html: Column, low: Column | None = None) -> Column:
    """Text of a page without scripts, styles, comments and tags (``low`` as in ``drop_blocks``)."""
    tagless = lambda h: F.regexp_replace(drop_remarks(drop_blocks(h, "script", "style", "noscript", low=low)), r"(?s)<[^>]+>", " ")
    return collapse(replaced(_if_able(html, lambda h: h.contains("<"), tagless), ENTITIES))


def text_nodes(html: Column, between: str) -> Column:
    """The pieces of text between the tags of an element's content, each trimmed and none empty, joined."""
    pieces = F.split(html, r"(?s)<[^>]*>")
    for entity, char in ENTITIES.items():
        pieces = F.transform(pieces, lambda x: F.replace(x, F.lit(entity), F.lit(char)))  # noqa: B023
    return F.array_join(F.filter(F.transform(pieces, lambda x: F.regexp_replace(x, r"^[\s ]+|[\s ]+$", "")), lambda x: x != ""), between)


def strip_layout(html: Column, low: Column | None = None) -> Column:
    """The page without scripts, page furniture and hidden elements (``low`` as in ``drop_blocks``); tags stay."""
    html = drop_remarks(drop_blocks(html, "script", "style", "noscript", low=low))
    html = drop_blocks(html, "header", "nav", "footer", "aside", low=low)
    hidden = lambda h: F.regexp_replace(h, r"(?is)<[^>]+(?:\shidden\b|display\s*:\s*none|aria-hidden=[\"']true[\"'])[^>]*>.*?</[^>]+>", " ")
    return hidden(html) if low is None else _if_able(html, lambda h: low.contains("hidden") | low.contains("display"), hidden)


def word_count(text: Column) -> Column:
    blanks = lambda t: F.length(t) - F.length(F.replace(t, F.lit(" ")))
    return bound(collapse(text), lambda t: F.when(t == "", 0).otherwise(blanks(t) + 1))


def content_density_pct(text: Column, html: Column) -> Column:
    """Share of the page that is text, in percent with one decimal; 0 if either is empty."""
    lengths = F.struct(F.length(collapse(text)).alias("a"), F.length(collapse(html)).alias("b"))
    return bound(lengths, lambda n: F.when((n.a == 0) | (n.b == 0), 0.0).otherwise(F.round(100.0 * n.a / n.b, 1)))


def seed_phrase(c: Column) -> Column:
    """A phrase in the form in which phrases are compared."""
    #: Words that a phrase loses, and imperatives that become infinitives.
    edge = lambda words: rf"(?iu)(?<![\p{{L}}\p{{N}}_])(?:{words})(?![\p{{L}}\p{{N}}_])"
    c = F.regexp_replace(F.lower(c), r"[–—/]+", " ")
    c = F.regexp_replace(c, r"[^\p{L}\p{N}\s-]+", " ")
    c = F.regexp_replace(c, edge("site|tool|checker|check"), " ")
    c = F.regexp_replace(c, edge("ru"), " ")
    c = F.regexp_replace(c, r"^проверьте\s+", "проверить ")
    c = F.regexp_replace(c, r"^найдите\s+", "найти ")
    return collapse(F.regexp_replace(c, r"^проверить\s+проверить\s+", "проверить "))


def is_useful_phrase(c: Column) -> Column:
    """Whether a phrase of 2 to 6 words has none of the listed empty shapes."""
    n = F.size(F.filter(F.split(c, r"\s+"), lambda x: x != ""))
    #: Shapes of phrases that say nothing.
    junk = [
        r"^(?:найти|проверить|проверка)$",
        r"(?i)(?<![A-Za-z0-9_])(?:subdomain|site|tool)(?![A-Za-z0-9_])",
        r"(?:^|\s)(?:найти|проверить)$",
        r"^проверить\s+проверка(?:\s|$)",
        r"(?:^|\s)(?:сайта|страницы)\s+(?:найти|проверить)(?:\s|$)",
        r"(?:^|\s)проверить\s+поддоменов(?:\s|$)",
    ]
    ok = (n >= 2) & (n <= 6)
    for pattern in junk:
        ok &= ~c.rlike(pattern)
    return ok


def stem(token: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(seed_phrase(token), rf"(?:{ENDINGS})$", ""), "ь$", "")


def comparable_tokens(c: Column) -> Column:
    tokens = F.transform(F.filter(F.split(seed_phrase(c), r"\s+"), lambda x: x != ""), stem)
    return F.filter(tokens, lambda x: (F.length(x) >= 4) & ~x.isin(*STOPWORDS, *GENERIC_WORDS))


def anchor_tokens(c: Column) -> Column:
    """Comparable tokens without general stems, or all of them if none is left."""
    tokens = comparable_tokens(c)
    anchors = F.filter(tokens, lambda x: ~x.isin(*GENERIC_STEMS))
    return F.when(F.size(anchors) > 0, anchors).otherwise(tokens)


def query_tokens(c: Column) -> Column:
    words = F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s-]+", " "), r"\s+")
    return F.filter(words, lambda x: (F.length(x) > 2) & ~x.isin(*STOPWORDS))


def ngrams(c: Column, least: int, most: int) -> Column:
    """Distinct phrases of least..most tokens and 8 characters or more, by size and then place."""
    tokens = F.filter(F.split(c, r"\s+"), lambda x: (F.length(x) > 2) & ~x.isin(*STOPWORDS))

    def sized(n: int) -> Column:
        starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))

    return F.array_distinct(F.filter(F.concat(*[sized(n) for n in range(least, most + 1)]), lambda x: F.length(x) >= 8))


def slugify(c: Column) -> Column:
    c = F.lower(c)
    for letter, latin in LETTERS.items():
        if len(latin) != 1:
            c = F.replace(c, F.lit(letter), F.lit(latin))
    single = {k: v for k, v in LETTERS.items() if len(v) == 1}
    c = F.translate(c, "".join(single), "".join(single.values()))
    return F.substring(F.regexp_replace(F.regexp_replace(c, r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), 1, 120)


def split_items(c: Column) -> Column:
    """Items between commas, semicolons, bullets and line ends, first spelling of each, two characters or more."""
    items = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[,;•\n]+"), collapse), lambda x: F.length(x) >= 2)
    lowered = F.transform(items, F.lower)
    return F.filter(items, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)


def salary_floor(c: Column) -> Column:
    """Least number above 1000, or null if there is none or only an upper bound is given."""
    text = F.translate(F.lower(c), " ", " ")
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"(\d[\d\s]{2,})"), F.lit(1)), lambda x: F.regexp_replace(x, r"\D", "").cast("bigint"))
    numbers = F.filter(numbers, lambda x: x > 1000)
    return F.when(text.contains("до") & ~text.contains("от"), None).otherwise(F.array_min(numbers))


def applicants_count(c: Column) -> Column:
    patterns = [r"(?iu)(\d[\d\s]*)\s+человека?\s+уже\s+откликнул", r"(?iu)уже\s+откликнул[ио]сь\s+(\d[\d\s]*)", r"(?iu)(\d[\d\s]*)\s+отклик"]
    found = [F.nullif(F.regexp_replace(F.regexp_extract(c, p, 1), r"\D", ""), F.lit("")) for p in patterns]
    return F.coalesce(*found).cast("int")
