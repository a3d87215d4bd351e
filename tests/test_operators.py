import decimal
import itertools
from collections import Counter

import duckdb
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from crawlsmith.functions import urls as U
from crawlsmith.operators import indexability as X
from crawlsmith.operators import keywords as K
from crawlsmith.operators import ledger as L
from crawlsmith.operators import parity as P
from crawlsmith.operators import reach as R
from crawlsmith.operators import subdomains as D
from crawlsmith.operators import vacancies as V
from crawlsmith.plans import registry

SNAP = "http_code int, text_len int, links_count int, has_h1 boolean, has_title boolean, access_state string"


def rules(spark, **agents):
    base = dict(http_code=200, text_len=1000, links_count=20, has_h1=True, has_title=True, access_state="ok")
    rows = [("u", a, *(base | agents.get(a, {})).values()) for a in P.AGENTS]
    df = spark.createDataFrame(rows, f"url string, agent string, {SNAP}")
    r = P.parity_rules(P.agent_pivot(df)).first()
    return [x.id for x in r.rules], r.top_rule, r.rule_verdict


def test_parity_rules(spark):
    assert rules(spark) == (["R001"], "R001", "ok")
    ids, top, verdict = rules(spark, google=dict(http_code=403, access_state="blocked"))
    assert ids == ["R003", "R005"] and top == "R003" and verdict == "fail"
    ids, top, verdict = rules(spark, google=dict(links_count=9))
    assert "R303" in ids and verdict == "warn"
    ids, _, verdict = rules(spark, **{a: dict(has_h1=False) for a in P.AGENTS})
    assert ids == ["R204", "R902"] and verdict == "warn"
    ids, top, _ = rules(spark, browser=dict(text_len=100, has_h1=False), yandex=dict(text_len=10, links_count=0))
    assert "R901" in ids


ROBOTS = "User-agent: a\nUser-agent: googlebot\nDisallow: /x # c\nAllow: /x\nDisallow:\nUser-agent: *\nDisallow: /\nSitemap: s"


def test_robots(spark):
    r = X.parse_robots(spark.createDataFrame([("s", ROBOTS), ("t", "Allow: /\nUser-agent: goo\nDisallow: /p?q"), ("e", "")], "site string, text string"))
    assert r.where("site = 's'").select("group_no").distinct().count() == 2
    pages = spark.createDataFrame([("s", "http://s/xyz"), ("t", "http://t/p?q=1"), ("t", "http://t/p"), ("n", "http://n/")], "site string, url string")
    got = {x.url: (x.robots_allowed, x.robots_rule) for x in X.evaluate_robots(pages, r).collect()}
    assert got == {"http://s/xyz": (True, "allow: /x"), "http://t/p?q=1": (False, "disallow: /p?q"), "http://t/p": (True, None), "http://n/": (True, None)}


def test_redirect_chains(spark):
    hops = spark.createDataFrame([("a", "b", 301), ("b", "c", 302), ("s", "s", 301), *[(f"n{i}", f"n{i + 1}", 301) for i in range(7)]], "from_url string, to_url string, status int")
    got = {r.start: (r.final_url, r.hops) for r in X.redirect_chains(hops).collect()}
    assert got["a"] == ("c", 2) and got["s"] == ("s", 1) and got["n0"] == ("n5", 5)


def test_expand_sitemaps_ends_on_cycles(spark):
    files = spark.createDataFrame([("i", "index", "j", None), ("j", "index", "i", None), ("j", "index", "u", None), ("u", "url", "x", "2024-01-01")], "file string, kind string, loc string, lastmod string")
    out = X.expand_sitemaps(files, spark.createDataFrame([("s", "i")], "site string, file string"))
    assert [tuple(r) for r in out.collect()] == [("s", "x", "2024-01-01", "index", False, False)]


def test_expand_sitemaps_has_no_depth(spark):
    chain = [(f"f{k}", "index", f"f{k + 1}", None) for k in range(13)] + [("f13", "url", "deep", None)]
    files = spark.createDataFrame(chain, "file string, kind string, loc string, lastmod string")
    assert [r.loc for r in X.expand_sitemaps(files, spark.createDataFrame([("s", "f0")], "site string, file string")).collect()] == ["deep"]


def breadth_first(files, roots, max_files, max_urls):
    """A file at a time, as a crawler with a queue takes them."""
    by, out = {}, []
    for f, kind, loc, pos in sorted(files, key=lambda r: r[3]):
        by.setdefault(f, []).append((kind, loc))
    for site, root in roots:
        queue, seen, urls, cut = [root], {root}, [], False
        taken = []
        while queue:
            f = queue.pop(0)
            if max_files is not None and len(taken) >= max_files:
                cut = True
                break
            taken.append(f)
            for kind, loc in by.get(f, ()):
                if kind == "index" and loc not in seen:
                    seen.add(loc)
                    queue.append(loc)
                elif kind == "url":
                    urls.append(loc)
        most = len(urls) if max_urls is None else max_urls
        out += [(site, u, cut, len(urls) > most) for u in urls[:most]]
    return sorted(out)


@pytest.mark.parametrize("most", [(None, None), (3, None), (None, 5), (4, 7), (1, 1), (100, 100)])
def test_sitemap_bounds_carry_over_levels(spark, most):
    files, n = [], 0
    for site in "ab":
        for name, entries in {"r": "i:x i:y i:z", "x": "i:p u:1 u:2", "y": "u:3 i:r i:q", "z": "u:4 u:5 u:6", "p": "u:7 i:z i:missing", "q": "u:8 u:9"}.items():
            for entry in entries.split():
                kind, loc = entry.split(":")
                n += 1
                if site == "a" or name != "y":
                    files.append((site + name, "index" if kind == "i" else "url", site + loc, n))
    roots = [("a", "ar"), ("b", "br")]
    df = spark.createDataFrame([(f, k, loc, None, pos) for f, k, loc, pos in files], "file string, kind string, loc string, lastmod string, pos int").repartition(3)
    got = X.expand_sitemaps(df, spark.createDataFrame(roots, "site string, file string"), *most)
    assert sorted((r.site, r.loc, r.truncated_by_files, r.truncated_by_urls) for r in got.collect()) == breadth_first(files, roots, *most)


def test_regional_notes_and_verdicts(spark):
    rows = [("d", "a.d", "working", None, False, True, "ok", 3), ("d", "b.d", "working", "https://x.d/p", True, False, "warn", 1), ("d", "c.d", "timeout", None, True, False, "warn", 2), ("e", "m.e", "working", None, False, False, "ok", 1), ("e", "n.e", "working", "https://n.e/", True, True, "ok", 2)]
    notes = D.regional_notes(spark.createDataFrame(rows, "domain string, host string, state string, canonical string, same_title boolean, has_hreflang boolean, level string, place int"))
    assert {r.host: r.note for r in notes.collect()} == {"a.d": "works", "b.d": "canonical: x.d", "c.d": "unstable", "m.e": "no hreflang", "n.e": "duplicate of home"}
    assert {tuple(r) for r in D.regional_verdicts(notes).collect()} == {("d", 3, "b.d", "canonical: x.d"), ("e", 2, None, None)}
    got = spark.createDataFrame([("working", None, False), ("working", True, False), ("closed", False, False)], "s string, b boolean, n boolean").select(D.is_indexable(F.col("s"), F.col("b"), F.col("n")))
    assert [r[0] for r in got.collect()] == [True, False, False]


def test_checks_with_people(spark):
    checks = spark.createDataFrame([(1, "ssr", "u1", "1.1", "", 7, 5, 10), (2, "ssr", "u2", "1.2", "", 8, None, 11), (3, "llm", "u3", "1.3", "", 7, 5, 12)], "id int, kind string, url string, ip string, reasons string, user_id int, team_id int, created_at int")
    checks = checks.withColumn("verdict", F.lit(None).cast("string"))
    users, teams = spark.createDataFrame([(7, "ann@x")], "id int, email string"), spark.createDataFrame([(5, "Red"), (6, "Blue")], "id int, name string")
    got = L.list_checks(checks, "ssr", 5, users, teams)
    assert [(r.id, r.user_email, r.team_name) for r in got.collect()] == [(2, None, None), (1, "ann@x", "Red")]
    assert [r.id for r in L.search_checks(got, text="ANN@").collect()] == [1] and [r.verdict for r in L.search_checks(got, "error").collect()] == ["error"] * 2
    members = spark.createDataFrame([(2, 7, 6), (1, 7, 5)], "id int, user_id int, team_id int")
    assert [r.name for r in L.user_team(7, members, teams).collect()] == ["Red"] and L.user_team(9, members, teams).count() == 0


def test_briefs_are_made_whole(spark):
    rows = [("tool_page", [" a  b ", "A B", ""], None, "loud", None, 100, 99_999), ("other", None, ["x"], "simple", "tool_page", None, None)]
    df = spark.createDataFrame(rows, "type string, required_blocks array<string>, schema_types array<string>, tone string, preset string, min_words int, max_words int")
    a, b = K.complete_briefs(df).collect()
    assert a.required_blocks == ["a b"] and a.schema_types == ["FAQPage", "BreadcrumbList"] and (a.preset, a.tone, a.goal, a.min_words, a.max_words, a.include_table) == ("tool_page", "practical", "leads", 500, 15_000, False)
    assert b.required_blocks[0] == "Что это" and b.schema_types == ["x"] and (b.preset, b.tone, b.min_words, b.notes, b.faq_items) == ("tool_page", "simple", 1800, "", [])


def test_searches_of_profiles(spark):
    profiles = spark.createDataFrame([(3, "Lead / Editor", "Growth Ann", "python", "n8n flows"), (5, "x", None, None, None)], "id int, position string, name string, skills string, about string")
    got = [r.keyword for r in V.suggest_keywords(profiles).where("id = 3").orderBy("place").collect()]
    assert got == ["Lead / Editor", "Lead", "Editor", "SEO Growth", "Growth Lead", "n8n"]
    searches = spark.createDataFrame([(1, 5, "kept", True), (2, None, "ownerless", True), (4, 5, "off", False)], "id int, profile_id int, keywords string, active boolean")
    found = spark.createDataFrame([(1, "v1"), (2, "v1"), (4, "v2"), (2, "")], "search_id int, vacancy_id string")
    assert {tuple(r) for r in V.hits_of_searches(found, searches, profiles).collect()} == {(5, "v1", 1, "kept"), (3, "v1", 2, "ownerless")}
    assert [r.search_id for r in V.hits_of_searches(found, searches, profiles, 5).collect()] == [1]
    own = searches.select("profile_id", "keywords", F.lit(1).alias("area"), "active")
    added = V.add_searches(profiles, own)
    assert added.where("profile_id = 5").count() == 2 and added.where("profile_id = 3").count() == 6


def test_registry_match(spark):
    got = R.registry_match(spark.createDataFrame([("www.a.b",), ("x.a.b",), ("q.c",), ("z",)], "domain string"), spark.createDataFrame([("*.a.b",), ("c",), ("z",)], "resource string"))
    assert {r.domain: r.registry_entry for r in got.collect()} == {"www.a.b": "*.a.b", "x.a.b": "*.a.b", "q.c": None, "z": "z"}


def test_clusters_agree(spark):
    rows = [(1, "r", "a1x b1x c1x d1x", 9), (2, "r", "b1x c1x d1x e1x", 8), (3, "r", "c1x d1x e1x f1x", 7), (4, "r", "zzz", 7), (5, "r", "zzz", 7), (6, "q", "и", 1), (7, "q", "и", 1)]
    df = spark.createDataFrame(rows, "id bigint, research_id string, query string, frequency bigint")
    local = {r.id: r.main_query for r in K.cluster_queries(df).collect()}
    far = {r.id: r.main_query for r in K.cluster_queries_distributed(df).collect()}
    assert local[2] == "a1x b1x c1x d1x" and local[3] == "c1x d1x e1x f1x" and local[5] == "zzz"
    assert {k: v for k, v in local.items() if k < 6} == {k: v for k, v in far.items() if k < 6}


def test_cleanup_flags(spark):
    df = spark.createDataFrame([(1, "окпд 2024 запрос", 100), (2, "запрос 2024 год", 100), (3, "v1.2.3 release", 100), (4, "слово", 5), (5, "ahrefs аналог", 100)], "id int, query string, frequency int")
    assert {r.id: r.flag_reason for r in K.cleanup_flags(df).collect()} == {1: "neutral", 2: "version_or_year", 3: "version_or_year", 4: "low_frequency", 5: "competitor_brand"}


def test_upserts_are_idempotent(spark):
    old = spark.createDataFrame([("1", "a", None), ("2", "b", 3)], "vacancy_id string, title string, applicants_count int")
    feed = spark.createDataFrame([("1", "x", 7, 0), ("2", "y", 9, 1), ("3", "z", 1, 2), ("3", "zz", 2, 3)], "vacancy_id string, title string, applicants_count int, pos int")
    once = V.upsert_vacancies(old, feed)
    assert sorted(map(tuple, once.collect())) == [("1", "a", 7), ("2", "b", 3), ("3", "z", 1)]
    assert sorted(map(tuple, V.upsert_vacancies(once, feed).collect())) == sorted(map(tuple, once.collect()))


def test_daily_admission(spark):
    rows = [(1, "i", "https://a/", "2024-01-01 23:59:00"), (2, "i", "https://a/", "2024-01-02 00:01:00"), (3, "i", "https://a/", "2024-01-02 00:02:00"), (4, "i", "https://ex/", "2024-01-02 00:00:30"), (5, "free", "https://a/", "2024-01-02 00:00:00")]
    df = spark.createDataFrame(rows, "id int, ip string, url string, t string").withColumn("ts", F.to_timestamp("t"))
    assert {r.id: r.reason for r in L.daily_admission(df, ["free"], ["ex"]).collect()} == {1: "first", 2: "first", 3: "daily_limit", 4: "exempt", 5: "exempt"}


def test_append_checks(spark, tmp_path):
    raw = spark.createDataFrame([Row(kind="llm", url="u", response='{"verdict":"ok","reasons":["a"]}', ip="1", user_id=1, created_at="2024-01-01"), Row(kind="llm", url="v", response="oops", ip="1", user_id=1, created_at="2024-01-01"), Row(kind="index", url="w", response=" ", ip="1", user_id=1, created_at="2024-01-01")])
    L.append_checks(raw, str(tmp_path / "c"))
    got = {r.url: (r.verdict, r.reasons) for r in spark.read.parquet(str(tmp_path / "c")).collect()}
    assert got == {"u": ("ok", ["a"]), "v": ("error", ["invalid_json"]), "w": ("error", ["empty_response"])}


def test_host_category(spark):
    df = spark.createDataFrame([("msk.a.b", "a.b", None), ("x.a.b", "a.b", "Доставка Москва"), ("old.a.b", "a.b", ""), ("dev2.a.b", "a.b", None), ("q.a.b", "a.b", "Подмосквачье")], "host string, domain string, title string")
    assert {r.host: r.category for r in D.host_category(df).collect()} == {"msk.a.b": "regional", "x.a.b": "regional", "old.a.b": "environment", "dev2.a.b": "environment", "q.a.b": "unknown"}


def plain(value):
    """A value in the form in which both engines' values are compared."""
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return int(value) if isinstance(value, decimal.Decimal) and value == int(value) else value


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_against_sql(spark, name):
    """All rows by value, whatever their order."""
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("supplier", "part", "documents", "pages", "benchmark", "events", "customer", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    result = con.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    got = registry.QUERIES[name](spark, d)
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    want = Counter(repr(tuple(plain(r[names.index(c)]) for c in order)) for r in result.fetchall())
    have = Counter(repr(tuple(plain(r[c]) for c in order)) for r in got.collect())
    assert have == want, (order, list((have - want))[:2], list((want - have))[:2])


@pytest.mark.parametrize("name", ["p2_parity_verdict", "p3_parity_rules", "p4_agent_cards", "p5_ai_parity_reasons", "p6_ai_bot_status"])
def test_pages_that_share_a_url(spark, tmp_path, name):
    """Pages of one url, some of them blocked, cut, empty or not served; the SQL in the order of the table."""
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute("CREATE TABLE pages AS SELECT page_id, 'https://a.example.com/' || page_id // 6 AS url, html FROM '/root/testdata/sf0.001/pages.parquet' ORDER BY page_id")
    con.execute(f"COPY pages TO '{tmp_path}/pages.parquet'")
    result = con.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    # The SQL of p5 leaves open in which order the pairs of one agent come, so these are compared as a bag.
    row = lambda r: repr([sorted(v.split("; ")) if c == "reasons" and name.startswith("p5") else v for c, v in zip(names, r, strict=True)])
    want = sorted(map(row, result.fetchall()))
    assert sorted(row([r[c] for c in names]) for r in registry.QUERIES[name](spark, str(tmp_path)).repartition(3).collect()) == want


@pytest.mark.parametrize("name", ["h1_snapshot_features", "p2_parity_verdict", "p3_parity_rules", "p4_agent_cards", "p5_ai_parity_reasons", "p6_ai_bot_status"])
def test_long_pages_are_read_to_their_end(spark, tmp_path, name):
    """Pages whose text, links and state come after 400,000 and 2,000,000 bytes, served whole to all or cut short for one bot."""
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    for page_id in (3, 8, 9):  # all are served the same; yandex and google get another page
        long = "<html><head><title>t</title></head><body><h1>h</h1><script>" + "é" * (200_000 if page_id < 9 else 1_000_000) + "</script>"
        links = "".join(f'<a href="/{i}">link {i}</a>' for i in range(20))
        con.execute("INSERT INTO pages VALUES (?, ?, ?)", [page_id, f"https://a.example.com/{page_id}", f"{long}<p>Solve the captcha</p>{links}</body></html>"])
    con.execute(f"COPY pages TO '{tmp_path}/pages.parquet'")
    result = con.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    want = sorted(map(repr, result.fetchall()))
    assert sorted(repr(tuple(r[c] for c in names)) for r in registry.QUERIES[name](spark, str(tmp_path)).collect()) == want


def test_registry_covers_all_tables():
    assert registry.FLAGSHIP in registry.QUERIES
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


def test_page_context_and_seeds(spark):
    from crawlsmith.operators import context as C

    ld = '<script type="application/ld+json">{"mainEntity":[{"@type":"Question","name":"Q1","acceptedAnswer":{"text":"A1"}},{"@type":"Question","name":"S","acceptedAnswer":"x"}]}</script><script type="application/ld+json">{bad</script>'
    html = f"<title>Проверка поддоменов домена | X</title>{ld}<main><h1>Найдите поддомены</h1><details><summary>S</summary>T</details>про googlebot</main><ul class='pager'><li> 7 </li></ul><a href='/c?page=4'>4</a>"
    df = spark.createDataFrame([(1, "https://a/tools/t", html), (2, "https://a/", None)], "page_id int, url string, html string")
    ctx = C.page_context(df)
    first = ctx.where("page_id = 1").first()
    assert [(q.question, q.answer) for q in first.faq] == [("S", "T"), ("Q1", "A1")]
    seeds = [r["query"] for r in C.seed_queries(ctx).where("page_id = 1").orderBy("place").collect()]
    assert "как видит googlebot" in seeds and any("поддоменов домена" in s for s in seeds)
    preset = spark.createDataFrame([("t", ["проверить поддомены сайта"])], "slug string, queries array<string>")
    assert C.seed_queries(ctx, preset).where("page_id = 1").first()["query"] == "проверить поддомены сайта"
    assert tuple(C.pagination(df).where("page_id = 1").first()) == (1, "pages", 7)
    got = spark.createDataFrame([("../c",), ("//d/e",), (None,)], "x string").select(U.resolve(F.lit("https://a/b/"), F.col("x")).alias("u"))
    assert [r.u for r in got.collect()] == ["https://a/c", "https://d/e", None]


def test_resume_and_vacancy_page(spark):
    from crawlsmith.operators import context as C

    text = "Иван\n+7 900 123-45-67\na@b.ru\nПроживает: Москва\n150 000 ₽\nОпыт работы\nООО Х\nОбразование\nМГУ\nНавыки\nPython SQL\nОбо мне\nлюблю SEO"
    r = C.parse_resumes(spark.createDataFrame([(text,)], "text string")).first()
    assert (r.email, r.location, r.salary_expected, r.skills, r.about) == ("a@b.ru", "Москва", 150000, "Python SQL", "люблю SEO")
    html = '<meta name="description" content="Опыт: 1–3 года. Занятость: полная."><a data-qa="vacancy-company-name">ACME</a><div data-qa="vacancy-description"><p>Делать</p></div><li data-qa="skills-element">Python</li> 12 человек уже откликнулись'
    v = C.vacancy_page(spark.createDataFrame([("1", html)], "vacancy_id string, html string")).first()
    assert (v.employer, v.description, v.key_skills, v.experience, v.employment, v.applicants_count) == ("ACME", "Делать", '["Python"]', "1–3 года", "полная", 12)


def test_pick_sitemap(spark):
    rows = [("s", 0, "robots", "a", 404), ("s", 1, "robots", "b", 200), ("t", 0, "standard", "c", 500), ("t", 1, "standard", "d", 0)]
    from crawlsmith.operators.context import pick_sitemap

    got = {r.site: (r.sitemap_found, r.url) for r in pick_sitemap(spark.createDataFrame(rows, "site string, pos int, source string, url string, status int")).collect()}
    assert got == {"s": (True, "b"), "t": (False, "c")}


def test_resume_sections_in_any_order(spark):
    from crawlsmith.operators import context as C

    parts = {"Опыт работы — 3 года": "ООО Х\nдо 2020", "Образование": "МГУ", "Навыки": "Python;  SQL", "Обо мне": "люблю\nSEO", "Знание языков": "Русский\nEnglish", "Повышение квалификации, курсы": "Kurs"}
    want = {"experience": "— 3 года ООО Х до 2020", "education": "МГУ", "skills": "Python; SQL", "about": "люблю SEO", "languages": "Русский English", "courses": "Kurs"}
    texts = []
    for order in itertools.islice(itertools.permutations(parts), 0, 720, 23):
        texts.append("Имя\n" + "\n".join(f"{h}\n{parts[h]}" for h in order) + "\nНавыки\nещё раз\nОпыт вождения\nB")
    rows = C.parse_resumes(spark.createDataFrame([(t,) for t in texts] + [("",), ("НАВЫКИ: раз\nНавыкиный текст",)], "text string")).collect()
    assert all({k: r[k] for k in want} == want for r in rows[:-2])
    assert rows[-2].skills == "" and rows[-2]["name"] == "" and rows[-1].skills == "раз Навыкиный текст"


def test_nested_vacancy_page(spark):
    from crawlsmith.operators import context as C

    html = (
        '<script>"<div data-qa=\'vacancy-description\'>no"</script><div class="z"><div data-qa="vacancy-description" id=d><div>One<div>Two &lt;x&gt;</div></div><p> Three </p></div></div>'
        '<a data-qa="vacancy-company-name"><b>AC</b><i>ME</i></a><span data-qa="skills-element"><span>S<i>Q</i>L</span></span><div data-qa="skills-element"><div>A</div></div>'
    )
    v = C.vacancy_page(spark.createDataFrame([("1", html), ("2", None), ("3", "")], "vacancy_id string, html string")).orderBy("vacancy_id").collect()
    assert (v[0].employer, v[0].description, v[0].key_skills) == ("ACME", "One\nTwo <x>\nThree", '["A","SQL"]')
    assert [tuple(r)[1:] for r in v[1:]] == [(None,) * 6] * 2


def test_main_text_keeps_nested_blocks(spark):
    from crawlsmith.operators import context as C

    pages = [("<div class='content'><div>a</div>b<div><div>c</div></div></div><div>d</div>", "a b c"), ("<main>m<main>n</main>o</main><article>x</article>", "m n o"), ("<nav>n</nav><p>p</p>", "p"), ("<article></article><!-- <main>no</main> --><div id=\"entry\">e</div>", "e")]
    df = spark.createDataFrame([(h, w) for h, w in pages], "h string, w string")
    assert [(r.got, r.w) for r in df.select("w", C.main_text(F.col("h")).alias("got")).collect() if r.got != r.w] == []


def test_resume_position_stands_above_the_headings(spark):
    from crawlsmith.operators import context as C

    rows = [
        ("Имя\nНавыки\nosqueraco seostaóñ\nОбо мне\nx Seosmenteoses que\nлюблю SEO", ""),  # words of other fields
        ("Имя\nОпыт вождения\nHead of SEO\n", ""),  # a heading without a field
        ("Имя\r\nTeam Lead\r\nНавыки\r\nSenior Python", "Team Lead"),
        ("Имя\nГород\nSenior Python Developer / Lead", "Senior Python Developer / Lead"),  # no heading at all
        ("НАВЫКИ\nx\nЖелаемая должность и зарплата\nData  Engineer\n100 000 ₽", "Data Engineer"),  # the label counts anywhere
        ("", ""),
        (None, None),
    ]
    got = C.parse_resumes(spark.createDataFrame(rows, "text string, want string")).select("position", "want").collect()
    assert [r.position for r in got] == [r.want for r in got]
