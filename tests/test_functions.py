import json
import random
import re
from urllib.parse import urljoin

from pyspark.sql import functions as F

from crawlsmith.functions import dates as D
from crawlsmith.functions import html as H
from crawlsmith.functions import text as T
from crawlsmith.functions import urls as U


def one(spark, value, *cols):
    df = spark.createDataFrame([(value,)], "v string")
    return df.select(*[c(F.col("v")).alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_compare_key(spark):
    key = lambda u: one(spark, u, U.compare_key)[0]
    assert key("HTTP://A.b/x/") == key("http://a.b/x")
    assert key("http://a.b") == "http://a.b/"
    assert key("http://a.b/x?q=1#f") == "http://a.b/x?q=1"
    assert key("a.b/x y/") == "https://a.b/x y"
    assert key(None) is None


def test_normalize_is_idempotent(spark):
    for u in ["", " a.b ", "http://x", "HTTPS://x"]:
        once = one(spark, u, U.normalize_url)[0]
        assert one(spark, once, U.normalize_url)[0] == once


def test_seed_phrase_and_tokens(spark):
    phrase, tokens, anchors = one(spark, "Проверьте сайт/поддомены — онлайн tool", T.seed_phrase, T.comparable_tokens, T.anchor_tokens)
    assert phrase == "проверить сайт поддомены онлайн"
    assert tokens == ["провер", "поддомен", "онлайн"] or "поддомен" in tokens
    assert "поддомен" in anchors


def test_useful_phrase(spark):
    ok = lambda p: one(spark, p, T.is_useful_phrase)[0]
    assert ok("найти поддомены сайта")
    assert not ok("слово")
    assert not ok("а б в г д е ж")
    assert not ok("сайт проверить")


def test_slug_and_items(spark):
    assert one(spark, "Щука и Ёж — 2024!", T.slugify)[0] == "schuka-i-ezh-2024"
    assert one(spark, "Python, ECONOMY; python • a, ring", T.split_items)[0] == ["Python", "ECONOMY", "ring"]
    assert one(spark, None, T.split_items)[0] == []


def test_salary_floor(spark):
    floor = lambda s: one(spark, s, T.salary_floor)[0]
    assert floor("от 120 000 ₽") == 120000
    assert floor("до 100 000 ₽") is None
    assert floor("100 000 - 150 000") == 100000
    assert floor("нет") is None
    assert floor(None) is None


def test_access_state(spark):
    assert one(spark, "Just checking your browser", H.access_state, H.access_match)[:] == ("challenge", "checking_your_browser")
    assert one(spark, "", H.access_state)[0] == "unknown"
    assert one(spark, None, H.access_state)[0] == "unknown"
    assert one(spark, "hello", H.access_state)[0] == "ok"


def test_links_and_visible_text(spark):
    page = "<script>x='<a href=q>'</script><a href='/a'>A</a> <a class=b href=#t>T</a><a href='mailto:x'>m</a><p>1 &lt; 2&nbsp;&amp;lt;</p>"
    links, text = one(spark, page.replace("<script>x='<a href=q>'</script>", ""), H.links, H.visible_text)
    assert links == ["/a"]
    assert text == "A T m 1 < 2 &lt;"


def test_jsonld(spark):
    page = '<script type="application/ld+json">{"@type":["Article","NewsArticle"],"author":{"@type":"Person"}}</script>'
    assert one(spark, page, H.jsonld_types)[0] == ["Article", "NewsArticle", "Person"]
    assert one(spark, page, lambda c: H.jsonld_type_count(c, ["Article", "NewsArticle"]))[0] == 1


def test_references(spark):
    """RFC 3986, 5.4, and ten thousand pairs against the standard library."""
    want = {
        "g:h": "g:h", "g": "/b/c/g", "./g": "/b/c/g", "g/": "/b/c/g/", "/g": "/g", "?y": "/b/c/d;p?y", "g?y": "/b/c/g?y", "#s": "/b/c/d;p?q#s", "g#s": "/b/c/g#s", "g?y#s": "/b/c/g?y#s", ";x": "/b/c/;x", "g;x": "/b/c/g;x", "": "/b/c/d;p?q",
        ".": "/b/c/", "./": "/b/c/", "..": "/b/", "../": "/b/", "../g": "/b/g", "../..": "/", "../../": "/", "../../g": "/g", "../../../g": "/g", "../../../../g": "/g", "/./g": "/g", "/../g": "/g", "g.": "/b/c/g.", ".g": "/b/c/.g", "g..": "/b/c/g..", "..g": "/b/c/..g",
        "./../g": "/b/g", "./g/.": "/b/c/g/", "g/./h": "/b/c/g/h", "g/../h": "/b/c/h", "g;x=1/./y": "/b/c/g;x=1/y", "g;x=1/../y": "/b/c/y", "g?y/../x": "/b/c/g?y/../x", "g#s/../x": "/b/c/g#s/../x", " g\n": "/b/c/g",
    }
    rows = [("http://a/b/c/d;p?q", h, w if ":" in w else f"http://a{w}") for h, w in want.items()]
    rows += [("http://a/b/c/d;p?q", "//g", "http://g"), ("http://a/b", "HTTPS://x/a/../b", "https://x/b"), ("http://a/b", "mailto:x@y", "mailto:x@y"), ("a/b", "c", None), ("http://a", None, None), ("http://a", "b", "http://a/b")]
    rng = random.Random(1)
    path = lambda: "/".join(rng.choice(["a", "b", ".", "..", "c.d", "é", "x;y", "..."]) for _ in range(rng.randint(1, 5))) + rng.choice(["", "/"])
    for i in range(10_000):
        base = f"http://h{i % 7}" + rng.choice(["", "/", "/" + "/".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) + rng.choice(["", "/"])]) + rng.choice(["", "?q=1"]) + rng.choice(["", "#f"])
        href = rng.choice([path(), "/" + path(), "?p=2", "#x", "//o/a/b", "https://z/y?k", "./" + path(), path() + "?a=b/../c", path() + "#frag"])
        rows.append((base, href, urljoin(base, href)))
    df = spark.createDataFrame(rows, "b string, h string, want string")
    assert df.where(~U.resolve(F.col("b"), F.col("h")).eqNullSafe(F.col("want"))).collect() == []


def test_elements_by_depth(spark):
    page = '<div class=a><div>1<div>2</div></div>3</div><DIV data-x="a > b" class="b x">4<divx>5</divx></DIV><div class="b">6'
    inner = lambda h, *a: [e.inner for e in one(spark, h, lambda c: H.elements(c, "div", *a))[0]]
    assert inner(page) == ["<div>1<div>2</div></div>3", "4<divx>5</divx>"]
    assert inner(page, r"class=[\"'][^\"']*x") == ["4<divx>5</divx>"] and inner("") == inner("</div>text<div>") == []
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert inner(deep) == ["<div>" * 2999 + "x" + "</div>" * 2999]
    assert one(spark, page, lambda c: H.first_inner(c, "div", "class=a"))[0] == "<div>1<div>2</div></div>3"


def test_jsonld_at_any_depth(spark):
    blocks = [
        '{"@type":"A","x":{"@type":["B","C"],"y":[{"@type":"D"},{"z":{"@type":"A"}}]}}', '[{"k":"\\"@type\\": \\"No\\"","@type":"Ar\\u0074"},{"a":[1,2,{"@type":[5,"E",{"@type":"F"},"G"]}]}]', '{"child":{"@type":"Inner"},"@type":"Outer"}',
        '{"@type":"Bro" ,', '{"@graph":[{"@type":"X","s":"}{]["},null,true],"@type":null}', "", '{"\\u0040type":"Esc"}', '"@type"', '{"a":"@type","b":"v"}', '{"a":{"author":{"x":1,"name":" Deep "}},"author":"  "}', '{"author":[{"name":"In list"}],"b":{"author":"Str"}}', '{"b":{"author":"Low"},"author":{"name":"High"}}',
    ]

    def walk(v, out):
        if isinstance(v, dict):
            t = v.get("@type")
            out += [x for x in (t if isinstance(t, list) else [t]) if isinstance(x, str)]
        for x in v.values() if isinstance(v, dict) else v if isinstance(v, list) else ():
            walk(x, out)

    def string(v):
        if isinstance(v, dict):
            own = v.get("author")
            own = own.get("name") if isinstance(own, dict) else own
            if isinstance(own, str) and own.strip():
                return own.strip()
        for x in v.values() if isinstance(v, dict) else v if isinstance(v, list) else ():
            if found := string(x):
                return found
        return None

    df = spark.createDataFrame([(b, f'<script type="application/ld+json">{b}</script>') for b in blocks], "b string, h string")
    for r in df.select("b", H.jsonld_types(F.col("h")).alias("t"), H.jsonld_string(F.col("h"), "author").alias("s")).collect():
        types = []
        try:
            value = json.loads(r.b)
            walk(value, types)
        except ValueError:
            value, types = None, re.findall(r'"@type"\s*:\s*"([^"]+)"', r.b)
        assert (r.t, r.s) == (list(dict.fromkeys(types)), string(value)), r.b


DATES = {
    "2014-06-01": "2014-06-01", "2014-06-01T10:00:00Z": "2014-06-01", "2014-6-1 10:00": "2014-06-01", "2014/06/01": "2014-06-01", "2014.06.01": "2014-06-01", "2014 06 01": "2014-06-01", "01.02.2020": "2020-02-01", "1.2.2020": "2020-02-01",
    "before 01.02.2020": "2020-02-01", "15 Jan 2020": "2020-01-15", "15-Jan-2020": "2020-01-15", "15-jan-98": "1998-01-15", "15-JAN-07": "2007-01-15", "1st March 2011": "2011-03-01", "Wed, 15 Jan 2020 00:00:00 GMT": "2020-01-15",
    "Wed Jan 15 2020": "2020-01-15", "Jan 15, 2020": "2020-01-15", "January 15 2020": "2020-01-15", "Sept. 3, 2001": "2001-09-03", "Wed Jan 15 10:20:30 UTC 2020": "2020-01-15", "2020-Jan-15": "2020-01-15", "2020 jan 5": "2020-01-05",
    "01/15/2020": "2020-01-15", "1/5/49": "2049-01-05", "1/5/50": "1950-01-05", "12-31-1999": "1999-12-31", "Jan 2020": "2020-01-01", "December, 1999": "1999-12-01", "2020-02-30": None, "31.04.2020": None, "29.02.2020": "2020-02-29", "29 Feb 2021": None,
    "13/45/2020": None, "never": None, "": None, "20200115": None, "Jan": None, "99": None, "2014-13-01": None, "Smarch 3, 2001": None, "1234567890": None,
}


def test_dates_in_text(spark):
    df = spark.createDataFrame([*DATES.items(), (None, None)], "t string, want string")
    got = [(r.t, r.d, r.want) for r in df.select("t", "want", D.parse_date(F.col("t")).cast("string").alias("d")).collect() if r.d != r.want]
    assert got == []
    ages = spark.createDataFrame([(None,), (0.4,), (1.9,), (2.0,), (4.99,), (5.0,), (21.0,)], "y double")
    assert [r.a for r in ages.select(D.age_label(F.col("y")).alias("a")).collect()] == ["не удалось определить", "меньше 1 года", "1 год", "2 года", "4 года", "5 лет", "21 лет"]


def test_a_page_is_only_searched_for_what_it_has(spark):
    """Blanks, blocks, signs and prices as the plain patterns find them, where a page in lower case says what need not be looked for."""
    from crawlsmith.operators.site_profile import _FIELD, _FORM, SIGNALS, signal_flags

    pages = [
        "", " ", " ", "a  \t\n b  c ", "a\u00a0b\u00a0\u00a0 c", "\x0ba\x0c\rb ", "<SCRIPT >x<b></Script >y", "<style>p</style><noscript>q</noscript>r", "a<!-- <nav>x</nav> -->b<!-- c", "<Nav>m</nav><b HIDDEN>h</b>t<i style='Display : None'>u</i>",
        "<scr<!-- -->ipt>x</script>", "&amp;lt; &nbsp;&#39;&copy;", "1 < 2 & 3 > 2", "<main>m</main><header><nav><a href='/a'>A</a></nav></header>", "TEL:1", "+7 (900", "+7 x", "12 345 ₽", "5₽ 7 $", "7 Руб", "a@b", "x@y.zz", "@y.zz", "a.@-.zz",
        "ул. Ленина", "проᲃпект Мира", "аᲁреᲃ", "адреса", "ИНН 1", "инн", "NAME='Phone", "ᲄелефᲂн", "ИМЯ", "<FORM>", "<form_", None,
    ]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string")
    h, low = F.col("html"), F.lower("html")
    flags = signal_flags(h, low)
    plain = SIGNALS | {"form_": _FORM, "field_": _FIELD}
    checked = ["phone", "prices", "email", "address", "requisites", "form_", "field_"]
    spaces = F.trim(F.regexp_replace(F.translate(h, "\u00a0", " "), r"\s+", " "))
    both = {
        "collapse": (T.collapse(h), spaces), "words": (T.word_count(h), F.when(spaces == "", 0).otherwise(F.size(F.split(spaces, " ")))),
        "strip": (T.strip_html(h, low), T.strip_html(h)), "layout": (T.strip_layout(h, low), T.strip_layout(h)), "visible": (H.visible_text(h, low), H.visible_text(h)), "cms": (H.detect_cms(h, low), H.detect_cms(h)),
        **{k: (flags[k], h.rlike(plain[k])) for k in checked},
    }
    rows = df.select("html", *[c.alias(f"{k}_{n}") for k, pair in both.items() for n, c in zip("ab", pair, strict=True)]).collect()
    assert [(r.html, k, r[f"{k}_a"], r[f"{k}_b"]) for r in rows for k in both if r[f"{k}_a"] != r[f"{k}_b"]] == []
    assert {k: sum(bool(r[f"{k}_a"]) for r in rows) for k in checked} == {"phone": 2, "prices": 3, "email": 2, "address": 3, "requisites": 1, "form_": 1, "field_": 3}
