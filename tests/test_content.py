import random
import re
from collections import Counter

from pyspark.sql import functions as F

from crawlsmith.functions import html as H
from crawlsmith.operators import ai_readiness as A
from crawlsmith.operators import content as C
from crawlsmith.operators import listing as L
from crawlsmith.operators import reach as R
from crawlsmith.operators import speed as V


def audit(spark, url, html):
    df = spark.createDataFrame([(1, url, html)], "page_id int, url string, html string")
    return C.content_verdict(C.content_issues(C.resolve_page_type(C.page_type_scores(C.page_features(df))))).first()


def test_article_and_home(spark):
    ld = '<script type="application/ld+json">{"@type":"Article"}</script>'
    body = "<h1>t</h1>" + "<h2>a</h2>" * 3 + "<p>" + "слово " * 600 + "</p><p>Автор: А</p><time datetime='2024-01-01'>x</time>"
    r = audit(spark, "https://a/blog/x", f"<title>t</title>{ld}<article>{body}</article>")
    assert (r.page_type, r.confidence, r.needs_choice, r.total) == ("article", 98, False, 19)
    assert {x.what for x in r.issues} >= {"images", "cta", "date_schema", "toc"} and not {x.what for x in r.issues} & {"author", "words", "h1", "date", "article_schema", "headings"}
    assert r.verdict == "warn"
    home = audit(spark, "https://a", "<title>t</title><h1>h</h1><p>Купить</p>")
    assert home.page_type == "home" and home.score_home == 90 + 25


def test_product_and_landing_and_override(spark):
    ld = '<script type="application/ld+json">{"@type":"Product"}</script>'
    r = audit(spark, "https://a/product/1", f"<title>t</title><h1>h</h1>{ld}<p>1 200 ₽</p><button>В корзину</button>")
    assert r.page_type == "product" and r.score_product == 35 + 70 + 40 + 25 + 30
    assert "price" not in {x.what for x in r.issues}
    r = audit(spark, "https://a/promo/", "<form></form><p>Оставить заявку</p>")
    assert r.page_type in ("landing", "informational") and r.score_landing == 25 + 30 + 15
    df = C.page_type_scores(C.page_features(spark.createDataFrame([(1, "https://a/q", None)], "page_id int, url string, html string")))
    assert C.resolve_page_type(df, "article").first().confidence == 100
    assert C.resolve_page_type(df).first().needs_choice


def typed(spark, cases):
    """Rows of (type, url, html), audited as pages of that type."""
    df = spark.createDataFrame([(n, url, html) for n, (_, url, html) in enumerate(cases)], "page_id int, url string, html string")
    kinds = F.array(*[F.lit(kind) for kind, _, _ in cases])
    return C.page_features(df).withColumn("page_type", F.get(kinds, F.col("page_id"))).withColumn("needs_choice", F.lit(False))


def test_each_content_check_fires_and_is_silent(spark):
    """An empty page fails what asks for something; a full one fails nothing but what only larger or smaller lists fail."""
    ld = lambda *types: "".join(f'<script type="application/ld+json">{{"@type":"{t}","datePublished":"2024-01-01"}}</script>' for t in types)
    og = "<meta property='og:title' content='t'><meta property='og:description' content='d'><meta property='og:image' content='i'>"
    words = "слово " * 400
    full = (
        f"<title>t</title><meta name='description' content='d'>{og}<link rel='canonical' href='/x'>{ld('Product', 'Offer', 'Review', 'ItemList', 'Article', 'FAQPage', 'Organization', 'LocalBusiness', 'Service', 'BreadcrumbList')}"
        f"<h1>h</h1><h2>s</h2><p>{words} 1 200 ₽ Купить описание характеристики доставка похожие товары подкатегории содержание время чтения автор читайте также ИНН ул. +7 900 a@b.ru</p><form><input class='filter'></form>"
        "<button>Купить</button><img src='/a.jpg' alt='a'><a href='/in'>i</a><a href='https://ext/x'>e</a><a href='/x?page=9'>9</a><table></table><iframe></iframe><time datetime='2024-01-01'></time>"
        "<div class='comments tags faq team'>FAQ комментарии теги команда yandex.ru/maps</div>" + "<details></details>" * 5 + "<li data-product></li>" * 4
    )
    rules = C.content_rules()
    by_size = {"category": {"small_assortment", "huge_assortment", "large_assortment", "infinite_without_pages", "filter_duplicates"}, "product": {"image_alt"}, "article": {"image_alt", "density"}, "informational/faq": {"few_questions", "faq"}}
    urls = {"contacts": "https://a/contacts/", "about": "https://a/about/", "faq": "https://a/faq/", "generic": "https://a/q"}
    bare = "<b></b>" * 40 + "<p>x</p>"
    shop = lambda cards, last: "<li data-product></li>" * cards + f"<a href='/x?page={last}'>n</a>"
    cases, wants = [], []

    def case(kind, html, want, sub="generic"):
        cases.append((kind, urls[sub], html))
        wants.append(want)

    for name, own in rules.items():
        kind, _, sub = name.partition("/")
        if name not in ("unknown", "informational/generic"):  # a full page has questions, so it is no generic one
            case(kind, full, lambda got: not got, sub or "generic")
        names = {(s, w) for s, w, _ in own if w not in by_size.get(name, ())}
        case(kind, bare, lambda got, names=names: got >= names, sub or "generic")
    case("category", "<form class=filter>", lambda got: ("critical", "filter_duplicates") in got)
    for cards, last, size in ((2, 3, "small"), (10, 10, None), (10, 60, "large"), (10, 101, "huge")):
        case("category", shop(cards, last), lambda got, size=size: {w for _, w in got if "assortment" in w} == ({f"{size}_assortment"} if size else set()))
    case("category", "load more", lambda got: ("improve", "infinite_without_pages") in got)
    case("informational", "<details>", lambda got: ("improve", "few_questions") in got, "faq")
    case("article", "<img src='/a.jpg'>", lambda got: ("warn", "image_alt") in got)
    case("product", "<img src='/a.jpg'>", lambda got: ("improve", "image_alt") in got)
    case("article", "<p>" + "x " * 20 + "</p>" + "<b></b>" * 20, lambda got: ("warn", "density") in got)
    for r in C.content_verdict(C.content_issues(typed(spark, cases))).collect():
        got = {(x.severity, x.what) for x in r.issues}
        assert wants[r.page_id](got), (cases[r.page_id][0], got)
        assert r.total == {"informational": 7 if r.subtype == "contacts" else 6, "unknown": 5}.get(r.page_type, C.TOTALS.get(r.page_type)) and r.passed == max(0, r.total - len(got))


def test_catalogue(spark):
    shop = "<li data-product></li>" * 6
    cases = [("category", shop + "<a href='/x?page=5'>5</a>"), ("category", shop + "load more"), ("category", shop), ("category", ""), ("article", shop)]
    got = {r.page_id: tuple(r)[1:] for r in C.catalog_structure(typed(spark, [(k, "https://a/x", h) for k, h in cases])).collect()}
    assert got[0] == (6, 5, False, 30, "estimate") and got[1] == (6, None, True, None, "infinite_at_least")
    assert got[2] == (6, None, False, None, "no_pagination") and got[3] == (None, None, False, None, None) and got[4] == (None,) * 5


def test_speed_cards(spark):
    base = {"ttfb_ms": 100, "ttfb_state": "fast", "cms": "other", "cdn": "CDN", "available": True, "partial": False, "gap": 0, "opportunities": ["x"], "lcp": "good", "cls": "good", "tbt": "good"}
    slow = {"ttfb_ms": 900, "ttfb_state": "slow"}
    cases = [
        ({}, [], "ok"), (slow, ["critical ttfb"], "fail"), (slow | {"cms": "Тильда"}, ["warn ttfb"], "warn"), ({"available": False}, ["warn report_missing"], "warn"), ({"partial": True}, ["warn report_partial"], "warn"),
        ({"lcp": "critical", "opportunities": ["offscreen-images"]}, ["critical images"], "fail"), ({"lcp": "slow", "opportunities": ["unused-css-rules"]}, ["warn scripts"], "warn"), ({"lcp": "critical"}, [], "ok"), ({"opportunities": ["offscreen-images"]}, [], "ok"),
        ({"tbt": "problem"}, [], "ok"), ({"tbt": "problem", "cms": "WordPress"}, ["warn plugins"], "warn"), ({"opportunities": ["font-display"]}, ["improve fonts"], "ok"), ({"cdn": None}, [], "ok"), ({"cdn": None, "ttfb_ms": 501}, ["improve cdn"], "ok"),
        ({"gap": 30}, [], "ok"), ({"gap": 31}, ["warn mobile_gap"], "warn"), ({"cls": "problem"}, ["warn cls"], "warn"),
    ]
    kinds = "ttfb_ms int, ttfb_state string, cms string, cdn string, available boolean, partial boolean, gap int, opportunities array<string>, lcp string, cls string, tbt string, n int"
    df = spark.createDataFrame([(*(base | c).values(), n) for n, (c, _, _) in enumerate(cases)], kinds)
    for r in V.speed_problems(df).collect():
        assert ([f"{p.severity} {p.kind}" for p in r.problems], r.verdict) == cases[r.n][1:], cases[r.n]


def test_images_and_links(spark):
    html = '<img src="/a.jpg" alt="x"><img class="icon" src="/b.png"><img src="/c.svg"><img src="/d.png" width="20"><a href="/in" rel="nofollow">I</a><a href="//ext/x">E</a>'
    df = spark.createDataFrame([(1, "https://a/p", html)], "page_id int, url string, html string")
    assert [r.content_image for r in C.page_images(df).orderBy("pos").collect()] == [True, False, False, False]
    assert [(r.href, r.internal, r.nofollow) for r in C.page_links(df).orderBy("pos").collect()] == [("https://a/in", True, True), ("https://ext/x", False, False)]


def test_ai_page_types(spark):
    rows = [("https://a/", "", "home"), ("https://a/x?q=1", "", "search"), ("https://a/faq/x", "", "faq"), ("https://a/docs", "", "docs"), ("https://a/blog/1", "", "article"), ("https://a/k", "цена купить", "product"), ("https://a/category/1", "", "category"), ("https://a/uslugi/", "", "service"), ("https://a/z", "", "unknown"), ("https://a/blogger", "", "unknown")]
    df = spark.createDataFrame(rows, "url string, html string, want string")
    none = F.array().cast("array<string>")
    for r in df.select("url", "want", A.ai_page_type(F.col("url"), F.col("html"), none, none).alias("got")).collect():
        assert r.got == r.want, r


def test_readiness(spark):
    og = "".join(f"<meta property='og:{k}' content='x'>" for k in ("title", "description", "image"))
    full = (
        f"<html lang='en'><title>Red apple pie</title><meta name='description' content='{'d' * 130}'>{og}<link rel='canonical' href='https://a/blog/x'><script type='application/ld+json'>{{\"@type\":\"Article\",\"datePublished\":\"2024-01-01\",\"author\":\"A\"}}</script>"
        "<h1>Apple pie, red</h1><h2>s</h2><ul></ul><table></table><p>" + "word " * 501
    )
    pages = [
        (1, "https://a/blog/x", full), (2, "https://a/blog/x", "<h3>a</h3><p>b</p>"), (3, "https://a/x?q=1", "<h1>h</h1>"), (4, "https://a/x", "<title>Red apple pie</title><h1>Apple pie, red</h1><details><summary>q</summary>a</details><ul></ul><p>" + "word " * 350),
        (5, "https://a/docs/", "<div class='content' hidden></div><h1>one</h1><h1>two</h1><link rel='canonical' href='https://a/other'><meta property='og:title' content='x'>"), (6, "https://a/faq/", ""),
    ]
    got = {r.page_id: r for r in A.content_readiness(spark.createDataFrame(pages, "page_id int, url string, html string")).collect()}
    states = lambda k: " ".join(got[k][f"check_{c}"] for c in "h1 description headings words lists tables date author og lang canonical".split())
    assert states(1) == " ".join(["ok"] * 11) and (got[1].passed, got[1].applicable, got[1].content_card, got[1].schema_card, got[1].faq_card) == (11, 11, "ok", "ok", "na")
    assert states(2) == "fail fail fail fail warn warn warn warn fail warn fail" and (got[2].content_card, got[2].schema_card) == ("fail", "fail")
    assert states(3) == "warn fail na na na na na na na warn fail" and got[3].applicable == 4
    assert states(4) == "ok fail na warn ok na na na fail warn fail" and got[4].faq == ["details"] and got[4].faq_card == "ok"
    assert states(5) == "warn fail fail fail warn warn warn warn warn warn warn" and got[5].faq_card == "warn" and got[5].schema_card == "na"
    assert (got[6].faq_card, got[6].schema_card) == ("fail", "fail")
    assert spark.range(1).select(A.ai_readiness_verdict(F.lit("ok"), F.lit("na"), F.lit("warn"))).first()[0] == "warn"


def test_speed_and_reach(spark):
    df = spark.createDataFrame([("u", "mobile", 40, None, ["a"], None), ("u", "desktop", 90, 5, ["a", "b"], "e")], "url string, strategy string, score int, page_bytes int, o array<string>, error string")
    df = df.withColumn("opportunities", F.transform("o", lambda x: F.struct(x.alias("id")))).drop("o")
    r = V.merge_strategies(df).first()
    assert (r.gap, r.page_bytes, [o.id for o in r.opportunities], r.available, r.has_error) == (50, 5, ["a", "b"], True, True)
    rows = [(True, "timeout", "x"), (True, "accessible", "x"), (False, "refused", "Cloudflare"), (False, "accessible", "x"), (None, "accessible", "x")]
    got = [(r.key, r.verdict, r.advice) for r in R.access_verdict(spark.createDataFrame(rows, "blocked boolean, probe string, provider string")).collect()]
    assert got == [("blocked_officially", "fail", "legal"), ("listed_but_accessible", "warn", "watch"), ("not_blocked_but_unavailable", "warn", "move_hosting"), ("ok", "ok", None), ("unknown", "warn", None)]
    report = '{"categories":{"performance":{"score":0.555}},"audits":{"total-byte-weight":{"numericValue":10}}}'
    p = V.parse_lab_report(F.lit(report))
    assert tuple(spark.range(1).select(p["score"], p["page_bytes"], p["lcp"]).first()) == (56, 10.0, None)
    report = '{"audits":{"resource-summary":{"details":{"items":[{"transferSize":3},{"transferSize":4},{}]}},"total-byte-weight":{"numericValue":10},"font-display":{"score":0,"title":"Fonts"},"unused-javascript":{"score":1},"offscreen-images":{"score":0.5,"details":{"overallSavingsBytes":9}}}}'
    p = V.parse_lab_report(F.lit(report))
    r = spark.range(1).select(p["page_bytes"].alias("b"), p["opportunities"].alias("o")).first()
    assert r.b == 7.0 and [tuple(o) for o in r.o] == [("offscreen-images", "offscreen-images", None, 9.0), ("font-display", "Fonts", None, None)]


def test_cms(spark):
    df = spark.createDataFrame([("<link href='/wp-content/x'><script src='/_next/a'>",), ("<a href='/x.php?a'>",), ("",)], "h string")
    assert [r.c for r in df.select(H.detect_cms(F.col("h")).alias("c")).collect()] == ["WordPress + Next.js", "PHP", "other"]


CARD_PART = ["<a href=x>", "</a>", "<div class='product-card'>", "<div class='Product-Card x'>", "</div>", "<li>", "<li class='grid-item'>", "</li>", "<article>", "</article>", "<img src=a>", "100 ₽", "5 руб.", "$", "р.5", "text", "<span>", "<a title='$'>", "<ul class='catalog'>", "</ul>", "<ol class='filter items'>", "</ol>"]


def test_cards_against_patterns_of_the_whole_page(spark):
    """Each rule as one pattern that looks back and ahead, over pages put together at random."""
    rng = random.Random(1)
    pages = ["".join(rng.choice(CARD_PART) for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    priced = re.compile(r"<(a|div|article|li)\b[^>]*>(?:(?!</\1>).)*?<img\b(?:(?!</\1>).)*?(?:₽|руб\.?|р\.\b|\$|€)(?:(?!</\1>).)*?</\1>", re.I | re.S)

    def classes(h):
        names = [(re.search(r"class=[\"']([^\"']+)[\"']", m[2], re.I) or [0, ""])[1].lower() for m in re.finditer(r"<(div|li|article|section)\b([^>]*?)>", h, re.I)]
        return max(Counter(c for c in names if re.search(L.CARD, c) and not re.search(L.NO_CARD, c)).values(), default=0)

    def lists(h):
        found = re.finditer(rf"<(ul|ol)\b([^>]*class=[\"'][^\"']*({L.LISTS})[^\"']*[\"'][^>]*)>([\s\S]*?)</\1>", h, re.I)
        return max((len(re.findall(r"<li\b", m[4], re.I)) for m in found if not re.search(L.NO_CARD, m[2], re.I)), default=0)

    h = F.col("h")
    df = spark.createDataFrame([(p,) for p in pages], "h string").select("h", L.card_classes(h).alias("c"), L.list_items(h).alias("l"), L.priced_images(h).alias("p"), L.listing_cards(h).alias("all"))
    for r in df.collect():
        assert (r.c, r.l, r.p) == (classes(r.h), lists(r.h), len(priced.findall(r.h))), r.h
        assert r.all >= max(r.c, r.l, r.p)


def test_pagination_rules(spark):
    cases = [
        ("<a href='/c?page=2'>2</a><a href='/c?page=9'>9</a>", ("pages", 9)), ("<a rel='last' href='/c/page/12/'>x</a>", ("pages", 12)), ("<link rel='next' href='?PAGEN_1=3'>", ("pages", 3)),
        ("<div class='pagination'><a href='/x'>1</a><a href='/y'>2</a></div>", ("single", None)), ("<div class='pager'><a href='/c?page=2'>2</a> <span>7</span></div>", ("pages", 7)), ("<a href='page4'>next</a>", ("pages", 4)),
        ("<a href='/page-4/x'>z</a>", ("single", None)), ("Load MORE", ("infinite", None)), ("<a href='/c?page=1'>1</a>", ("single", None)), ("<a class=pagen href='b/page/3'>q</a>", ("pages", 3)), ("", ("single", None)), (None, ("single", None)),
    ]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(cases)], "i int, h string")
    for r in df.select("i", L.pagination_of(F.col("h"), F.lit("https://a/b/c")).alias("p")).collect():
        assert tuple(r.p) == cases[r.i][1], cases[r.i]


def test_menu(spark):
    html = (
        "<nav><div><div><a href='/about/'>About</a></div><a href='/blog'>Blog</a></div><a href='../faq?x=1&amp;y=2'>FAQ</a><a href='https://else/x'>Out</a><a href='/i.PNG'>I</a><a href='/'>Home</a><a href='/about/'>Again</a></nav>"
        f"<header><nav><a href='/price'>Pricing</a></nav><a href='/long'>{'x' * 81}</a><a href='mailto:a@b'>m</a></header><a href='/outside'>o</a><!-- <nav><a href='/no'>n</a></nav> -->"
    )
    df = spark.createDataFrame([(1, "https://a.b/c/d", html), (2, "https://a.b", "<a href='/only'>Only</a>"), (3, "https://a.b", None)], "page_id int, url string, html string")
    got = {r.page_id: r for r in C.menu(df).collect()}
    assert got[1].labels == ["About", "Blog", "FAQ", "Home", "Again", "Pricing"] and [x.url for x in got[1].links] == ["https://a.b/about/", "https://a.b/blog", "https://a.b/faq?x=1&y=2", "https://a.b/price"]
    assert [x.url for x in got[2].links] == ["https://a.b/only"]
    assert [(r.place, r.label) for r in C.menu_links(df).where("page_id = 1").orderBy("place").collect()] == [(1, "About"), (2, "FAQ"), (3, "Pricing"), (4, "Blog")]


def test_compare_summary(spark):
    cases = [("article", "https://a/x", "<h1>t</h1><p>Автор</p>"), ("category", "https://a/x", "<li data-product></li>" * 6 + "<a href='/x?page=5'>5</a>")]
    df = C.content_issues(typed(spark, cases))
    got = {r.page_id: r for r in C.compare_summary(df).collect()}
    issues = {r.page_id: [x.severity for x in r.issues] for r in df.collect()}
    assert all((got[i].critical_count, got[i].important_count, got[i].improve_count) == tuple(map(issues[i].count, ("critical", "warn", "improve"))) for i in (0, 1))
    assert (got[0].author_found, got[0].article_schema_found, got[0].items_on_page, got[0].infinite_scroll) == (True, False, None, False)
    assert (got[1].items_on_page, got[1].pagination_pages, got[1].estimated_assortment) == (6, 5, 30)
    asked = C.compare_summary(df.withColumn("needs_choice", F.lit(True))).first()
    assert asked.critical_count is None and asked.word_count is not None


def test_derived_metrics(spark):
    from crawlsmith.operators import compare as M

    domains = spark.createDataFrame([("a",), ("b",), ("a",)], "domain string")
    speed = spark.createDataFrame([("a", True, 5, 6, None), ("b", False, 7, 8, 9), ("z", True, 1, 1, 1)], "domain string, ok boolean, ttfb_ms int, mobile_score int, desktop_score int")
    ssr = spark.createDataFrame([("a", True, "google", 200, None), ("a", True, "yandex", 200, "captcha"), ("b", True, "google", 403, "ok")], "domain string, ok boolean, agent string, http_code int, access_state string")
    subs = spark.createDataFrame([("a", True, 3, 2, 1), ("b", True, 1, 1, 0)], "domain string, ok boolean, found int, checked int, regional int")
    hosts = spark.createDataFrame([("a", True, "environment", "working", False, False), ("a", True, "mail", "working", False, False)], "domain string, ok boolean, category string, state string, robots_blocked boolean, noindex boolean")
    article = spark.createDataFrame([("a", True, "article", "u", 10, 5.0, True, False, 1, 2), ("b", True, "category", "u", 10, 5.0, True, False, 1, 2)], "domain string, ok boolean, page_type string, url string, word_count int, density double, author_found boolean, article_schema_found boolean, internal_links int, content_images int")
    got = {r.domain: r for r in M.derive_metrics(domains, speed=speed, ssr=ssr, subdomains=subs, hosts=hosts, article=article).collect()}
    assert set(got) == {"a", "b"}
    a, b = got["a"], got["b"]
    assert (a.ttfb_ms, a.desktop_score, a.googlebot_ok, a.yandexbot_ok, a.open_dev_test, a.article_word_count) == (5, None, True, False, True, 10)
    assert (b.ttfb_ms, b.googlebot_ok, b.yandexbot_ok, b.open_dev_test, b.article_word_count, b.found) == (None, False, None, False, None, 1)
    assert a.errors == ["site_profile", "index", "llm", "content"] and b.errors == ["site_profile", "speed", "index", "llm", "content"]


def test_profile_of_a_site(spark):
    from crawlsmith.operators import profile as P

    urls = spark.createDataFrame([("s", f"https://s/{p}", "2024-01-20") for p in ("blog/1", "blog/2", "faq/", "zzz")] + [("t", None, None)], "site string, loc string, lastmod string").where("loc IS NOT NULL")
    home = "<title>Блог для бизнеса | S</title><h1>Самара: новости</h1><nav><a href='/contacts'>Контакты</a></nav><p>отзывы</p>"
    pages = spark.createDataFrame([("s", "https://s/", home), ("s", "https://s/other", "<title>Казань</title><h1>другое</h1>ул. Мира"), ("t", "https://t/", "<p>ничего</p>"), ("u", "https://u/", None)], "site string, url string, html string")
    whois = spark.createDataFrame([("s", "Registrar: R\nCreated: 5 May 2012")], "site string, text string")
    search = spark.createDataFrame([("s", "google", "About 1,200 results"), ("s", "yandex", "nothing"), ("s", "iks", "ИКС 30")], "site string, engine string, html string")
    got = {r.site: r for r in P.site_profile(urls, pages, "2024-02-01", whois=whois, search=search).collect()}
    s, t = got["s"], got["t"]
    assert (s.site_type, s.audience, s.topic, s.region, s.home_url) == ("blog", "B2B", "Самара: новости", "Самара", "https://s/")
    assert (s.total, s.informational_percent, s.google_count, s.yandex_count, s.iks_count, s.registrar, s.age_label, s.age_years) == (4, 50, 1200, None, 30, "R", "11 лет", 11.7)
    assert s.summary == "B2B, блог, Самара: новости, Самара. В sitemap найдено 4 URL; основные разделы: информационных 50%, faq 25%. Пробелы: адрес не найден, 1 страниц не классифицированы."
    assert (t.total, t.structure_note, t.site_type, t.llms_status, t.age_label) == (None, "no_sitemap", "unknown", None, "не удалось определить") and t.summary.startswith("Тип сайта определить не удалось. Sitemap не найден")
    assert got["u"].h1 is None and got["u"].menu == []
    plan = P.site_profile(urls, pages, "2024-02-01", whois=whois)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_types_need_only_their_features(spark):
    """c2 asks for no more of a page than scores are made from, and gets the same scores."""
    rows = [(1, "https://a.example.com/product/1", "<h1>Ring</h1><form></form><p>1 200 $</p><button>Buy now</button><img src=/a.jpg>"), (2, "https://a.example.com/", "<a href='/x'>x</a> contact +7 900"), (3, "https://a.example.com/q", None)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    few = C.page_type_scores(C.page_features(df, C.TYPE_FEATURES))
    assert not {"price_text", "buy_label", "content_images", "assortment"} & set(few.columns)
    scores = ["page_id", *[f"score_{t}" for t in C.TYPES]]
    assert sorted(few.select(scores).collect()) == sorted(C.page_type_scores(C.page_features(df)).select(scores).collect())
