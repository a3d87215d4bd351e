"""Input views derived from the driver's tables; the same SQL runs in Spark and in DuckDB (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark")

VIEWS: dict[str, str] = {
    "v_pages": r"""
SELECT page_id, url, html,
       regexp_extract(lower(url), '^https?://([^/?#]+)', 1) AS host,
       regexp_extract(lower(url), '^https?://(www[.]|m[.]|blog[.])?([^/?#]+)', 2) AS domain
FROM pages
""",
    "v_seo_pages": r"""
SELECT page_id, url, host, domain,
  replace(replace(html, '</head>', concat(CASE page_id % 5
    WHEN 0 THEN concat('<link rel="canonical" href="', url, '">')
    WHEN 1 THEN '<meta name="robots" content="noindex,follow">'
    WHEN 2 THEN '<link rel="canonical" href="https://other.example.com/"><meta name="description" content="A short description of the page">'
    WHEN 3 THEN '<script type="application/ld+json">{"@type":"Article","author":{"@type":"Person","name":"A"},"datePublished":"2024-01-05"}</script>'
    ELSE '<meta property="og:title" content="T">' END, '</head>')),
  '</article>', concat(CASE page_id % 4
    WHEN 0 THEN '<h2>Price</h2><p>1 200 $</p><button>Buy now</button>'
    WHEN 1 THEN '<form><input name="phone"></form><a href="tel:+70000000000">call</a>'
    WHEN 2 THEN '<table><tr><td>1</td></tr></table><img src="/a.jpg" alt="">'
    ELSE '<a rel="nofollow" href="https://ext.example.org/x">ext</a>' END, '</article>')) AS html
FROM v_pages
""",
    "v_rich_pages": r"""
SELECT page_id, url, host, domain,
  replace(replace(replace(html, '</head>', concat(CASE page_id % 6
    WHEN 0 THEN '<script type="application/ld+json">{"@graph":[{"@type":"Product","name":"P","offers":{"price":1,"@type":["Offer","AggregateOffer"]},"author":{"name":"Ann"}},{"x":[{"@type":"BreadcrumbList"}]}]}</script>'
    WHEN 1 THEN concat('<script type="application/ld+json">{"note":"say ', chr(92), '"@type', chr(92), '": no } {","mainEntity":{"@type":"Answer"},"@type":"Ar', chr(92), 'u0074icle","author":" Bob "}</script><meta name="author" content="Bob">')
    WHEN 2 THEN '<script type="application/ld+json">{"@type":"Broken", "x": {"@type": "Two"}</script><link rel="stylesheet" href="/wp-content/a.css">'
    WHEN 3 THEN '<script src="https://mc.yandex.ru/metrika/tag.js"></script><script src="/_next/static/a.js"></script><script src="https://www.googletagmanager.com/gtm.js"></script>'
    WHEN 4 THEN '<link rel="next" href="?page=2"><meta property="article:modified_time" content="2024-01-09">'
    ELSE '<script src="/bitrix/js/a.js"></script>' END, '</head>')),
  '<article>', concat(CASE page_id % 3
    WHEN 0 THEN '<header class="top"><div><div><a href="/contacts/">Contact us</a></div><a href="docs/../faq">Help</a><a href="https://else.example.net/x">Out</a><a href="/logo.png">Logo</a></div><a href="/">Home</a></header>'
    ELSE '' END, '<article>')),
  '</article>', concat(CASE page_id % 5
    WHEN 0 THEN concat('<div class="grid">', repeat('<div class="Product-Card">Item</div>', CAST(page_id % 7 AS INT)), '</div><div class="product-card sidebar">x</div><ul class="pager"><li>1 </li><li>12 </li></ul><a href="?page=3">3</a>')
    WHEN 1 THEN concat('<ul class="catalog">', repeat('<li>one</li>', CAST(page_id % 9 AS INT)), '</ul><a rel="last" href="/list/page/8/">end</a><img class="icon" src="/i.png"><img src="/s.svg" alt="s"><img src="/w.png" width="20"><img src="/ok.png" alt="fine">')
    WHEN 2 THEN concat(repeat('<article class="x"><img src="/p.jpg"><b>90 €</b></article>', CAST(page_id % 4 AS INT)), '<button>Load more</button><p>Артикул 5, 1 500,50 руб. Доставка</p><a href="#" class="b">Add to <b>cart</b></a>')
    WHEN 3 THEN '<details><summary>What is it?</summary>A thing.</details><details><summary>Empty</summary></details><a rel="author" href="/me">me</a><p>Эксперт редакции, ИНН 77</p>'
    ELSE '<div class="pagination"><a class="p" href="page-2/">2</a></div><li data-product="1">a</li><li data-product="2">b</li>' END, '</article>')) AS html
FROM v_pages
""",
    "v_snapshots": r"""
SELECT p.page_id, p.url, a.agent,
  CASE WHEN p.page_id % 29 = 0 THEN 0 WHEN a.k > 0 AND p.page_id % 11 = a.k THEN 403 ELSE 200 END AS http_code,
  CASE WHEN p.page_id % 29 = 0 THEN NULL
       WHEN a.k > 0 AND p.page_id % 11 = a.k THEN '<html><body>Access denied</body></html>'
       WHEN p.page_id % 13 = 5 THEN '<html><head><title>x</title></head><body></body></html>'
       WHEN a.k > 0 AND p.page_id % 7 = a.k THEN concat(substring(p.html, 1, 700), '</body></html>')
       ELSE p.html END AS body,
  CAST((p.page_id * 37 + a.k * 101) % 2500 AS INT) AS ttfb_ms
FROM v_pages p CROSS JOIN (SELECT 'browser' AS agent, 0 AS k UNION ALL SELECT 'yandex', 1 UNION ALL SELECT 'google', 2) a
""",
    "v_sitemap_urls": r"""
SELECT domain AS site,
  CASE WHEN page_id % 4 = 1 THEN concat(regexp_extract(url, '^([^?#]*[^/?#])', 1), '/') ELSE url END AS loc,
  CASE WHEN page_id % 6 = 0 THEN NULL ELSE concat('2024-01-', lpad(CAST(page_id % 28 + 1 AS STRING), 2, '0')) END AS lastmod,
  page_id AS pos
FROM v_pages WHERE page_id % 4 <> 3
""",
    "v_site_urls": r"""
SELECT domain AS site,
  concat('https://', domain, '/', CASE page_id % 11
    WHEN 0 THEN 'catalog/shoes/' WHEN 1 THEN 'blog/' WHEN 2 THEN 'calc/' WHEN 3 THEN 'search/'
    WHEN 4 THEN 'docs/a/' WHEN 5 THEN 'video/' WHEN 6 THEN 'faq/' WHEN 7 THEN 'about/' WHEN 8 THEN 'product/'
    WHEN 9 THEN 'tenders-archive/' ELSE '' END, CAST(page_id AS STRING)) AS loc,
  CASE WHEN page_id % 6 = 0 THEN NULL ELSE concat('2024-01-', lpad(CAST(page_id % 28 + 1 AS STRING), 2, '0')) END AS lastmod,
  page_id AS pos
FROM v_pages
""",
    "v_robots": r"""
SELECT DISTINCT domain AS site, concat(
  CASE length(domain) % 4
    WHEN 0 THEN concat('User-agent: *', chr(10), 'Disallow: /en/2', chr(10), 'Allow: /en/25 # keep')
    WHEN 1 THEN concat('User-agent: googlebot', chr(10), 'User-agent: gptbot', chr(10), 'Disallow: /fr/', chr(10), 'User-agent: *', chr(10), 'Disallow: /')
    WHEN 2 THEN concat('User-agent: *', chr(10), 'Disallow:')
    ELSE concat('User-agent: google', chr(10), 'Disallow: /es', chr(10), 'Allow: /es') END,
  chr(10), 'Sitemap: https://', domain, '/sitemap.xml') AS text
FROM v_pages
""",
    "v_ct_log": r"""
SELECT domain, concat(host, chr(10), CASE page_id % 5 WHEN 0 THEN 'dev.' WHEN 1 THEN 'api.' WHEN 2 THEN '*.' WHEN 3 THEN 'old.' ELSE 'msk.' END, domain) AS name_value
FROM v_pages
""",
    "v_probes": r"""
SELECT domain, concat(x.prefix, domain) AS host,
  CASE (length(domain) + x.k) % 6 WHEN 0 THEN 200 WHEN 1 THEN 200 WHEN 2 THEN 301 WHEN 3 THEN 403 WHEN 4 THEN 404 ELSE NULL END AS status,
  CASE WHEN (length(domain) + x.k) % 6 = 0 THEN concat('Home ', domain) ELSE concat('Page ', x.prefix) END AS title,
  CASE WHEN x.k % 2 = 0 THEN concat('User-agent: *', chr(10), 'Disallow: /') ELSE '' END AS robots_text,
  CASE WHEN (length(domain) + x.k) % 6 = 2 THEN 'https://elsewhere.example.edu/' ELSE NULL END AS redirect_target
FROM (SELECT DISTINCT domain FROM v_pages) d CROSS JOIN (
  SELECT 'dev.' AS prefix, 0 AS k UNION ALL SELECT 'api.', 1 UNION ALL SELECT 'old.', 2 UNION ALL SELECT 'msk.', 3
  UNION ALL SELECT 'blog.', 4 UNION ALL SELECT 'lk.', 5 UNION ALL SELECT 'cdn.', 6 UNION ALL SELECT '', 7) x
""",
    "v_registry": r"""
SELECT DISTINCT CASE WHEN length(domain) % 2 = 0 THEN concat('*.', domain) ELSE domain END AS resource
FROM v_pages WHERE page_id % 5 = 0
""",
    "v_queries": r"""
SELECT doc_id AS id, source AS research_id,
  regexp_extract(lower(replace(text, chr(10), ' ')), '^([^ ]+( [^ ]+)?( [^ ]+)?)', 1) AS query,
  CAST(n_chars * (doc_id % 17) % 60000 AS INT) AS frequency,
  CASE WHEN doc_id % 3 = 0 THEN 'seed' ELSE 'wordstat' END AS source
FROM documents
""",
    "v_suggestions": r"""
SELECT s.research_id, s.query AS seed, q.query AS phrase, q.frequency AS count
FROM v_queries s CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7) o CROSS JOIN (SELECT count(*) AS n FROM v_queries) t
JOIN v_queries q ON q.id = (s.id * 31 + o.k * 17 + 1) % t.n WHERE s.source = 'seed'
""",
    "v_site_metrics": r"""
SELECT s_nationkey AS grp,
  s_suppkey = min(s_suppkey) OVER (PARTITION BY s_nationkey) AS is_own,
  s_name AS domain,
  CAST(s_suppkey * 131 % 900 AS INT) AS authority, CAST(s_suppkey * 577 % 5000 AS INT) AS sitemap_total,
  CAST(s_suppkey * 73 % 400 AS INT) AS informational_count, CAST(s_suppkey * 211 % 1500 + 50 AS INT) AS ttfb_ms,
  CAST(s_suppkey * 37 % 101 AS INT) AS mobile_score, CAST(s_suppkey * 53 % 101 AS INT) AS desktop_score,
  CAST(s_suppkey % 11 AS INT) AS commercial_signals_found, CAST(s_suppkey % 3 AS INT) AS regional,
  s_suppkey % 2 = 0 AS gptbot_ok, s_suppkey % 3 = 0 AS llms_txt, s_suppkey % 5 <> 0 AS schema_critical,
  s_suppkey % 7 <> 0 AS canonical_ok, s_suppkey % 4 <> 0 AS googlebot_ok, s_suppkey % 6 <> 0 AS yandexbot_ok
FROM supplier
""",
    "v_vacancies": r"""
SELECT CAST(d.doc_id AS STRING) AS vacancy_id, concat(p.p_name, ' ', p.p_type) AS title, p.p_brand AS employer,
  CASE d.doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN concat('от ', CAST(50 + d.doc_id % 200 AS STRING), ' 000 ₽')
    WHEN 2 THEN concat('до ', CAST(90 + d.doc_id % 100 AS STRING), ' 000 ₽') ELSE concat('100 000 - ', CAST(150 + d.doc_id % 90 AS STRING), ' 000 ₽') END AS salary_text,
  concat(d.text, CASE d.doc_id % 5 WHEN 0 THEN ' remote' WHEN 1 THEN ' гибрид' WHEN 2 THEN ' office' ELSE '' END) AS description,
  CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE concat('["', p.p_type, '","Python"]') END AS key_skills,
  CASE d.doc_id % 4 WHEN 0 THEN '1–3 года' WHEN 1 THEN '3-6 лет' WHEN 2 THEN 'не требуется' ELSE NULL END AS experience,
  CASE d.doc_id % 3 WHEN 0 THEN 'полная занятость' WHEN 1 THEN 'частичная занятость' ELSE NULL END AS employment,
  CAST(NULL AS STRING) AS pub_date
FROM documents d JOIN part p ON p.p_partkey = d.doc_id % 200 + 1
""",
    "v_vacancy_pages": r"""
SELECT CAST(doc_id AS STRING) AS vacancy_id, concat(
  '<html><head><meta name="description" content="Опыт: ', CASE doc_id % 3 WHEN 0 THEN '1–3 года' WHEN 1 THEN 'более 6 лет' ELSE '' END, '. Занятость: ', CASE doc_id % 2 WHEN 0 THEN 'полная' ELSE 'проект' END, '."><script>var a = "<div>";</script></head><body>',
  '<div class="top"><a class="x" data-qa="vacancy-company-name" href="/e"><span>', source, '</span> &amp; <b>Co</b></a></div>',
  '<div class="d" data-qa="vacancy-description"><div><p>', replace(replace(replace(substring(text, 1, 400), '<', ' '), '>', ' '), chr(10), ' '), '</p><div>Inner</div></div> Tail<div></div></div><section></section>',
  CASE doc_id % 4 WHEN 0 THEN '<ul><li data-qa="skills-element">Py<b>thon</b></li><li data-qa="skills-element"><span>SQL &amp; more</span></li></ul>' WHEN 1 THEN '<div data-qa="skills-element"><div>Spark</div></div>' ELSE '' END,
  CASE doc_id % 5 WHEN 0 THEN '<p>12 человек уже откликнулись</p>' WHEN 1 THEN '<p>Уже откликнулось 1 204 человека</p>' ELSE '' END, '</body></html>') AS html
FROM documents
""",
    "v_resumes": r"""
SELECT doc_id, concat('Резюме обновлено 5 мая', chr(10), 'a@b.cd', chr(10), CASE doc_id % 2 WHEN 0 THEN 'Иван Иванов' ELSE 'Анна' END, chr(10), '+7 900 123-45-', CAST(10 + doc_id % 80 AS STRING), chr(10), 'Проживает:  Город  N', chr(10),
  CASE doc_id % 3 WHEN 0 THEN concat('Желаемая должность и зарплата', chr(10), 'Data  Engineer', chr(10), CAST(100 + doc_id % 300 AS STRING), ' 000 ₽', chr(10)) WHEN 1 THEN concat('Python Developer / Lead', chr(10)) ELSE '' END,
  CASE doc_id % 4 WHEN 0 THEN concat('Формат работы: офис', chr(10)) WHEN 1 THEN concat('Готов работать удалённо', chr(10)) ELSE '' END,
  CASE doc_id % 3 WHEN 0 THEN concat(w, e, l, s, a) WHEN 1 THEN concat(a, s, chr(10), 'Опыт вождения', chr(10), 'B', chr(10), c, w) ELSE concat(s, a, w, l, e, s) END) AS text
FROM (SELECT doc_id, concat('Опыт работы — 5 лет', chr(10), t, chr(10)) AS w, concat('Образование', chr(10), substring(t, 1, 20), chr(10), 'МГУ', chr(10)) AS e, concat('Знание языков', chr(10), 'Русский — Родной', chr(10), 'Английский — B1', chr(10)) AS l,
    concat('Навыки', chr(10), 'Python  SQL', chr(10), substring(t, 5, 30), chr(10)) AS s, concat('Обо мне', chr(10), substring(t, 10, 90), chr(10)) AS a, concat('Повышение квалификации, курсы', chr(10), substring(t, 3, 25), chr(10)) AS c
  FROM (SELECT doc_id, trim(concat('x ', replace(replace(substring(text, 1, 5200), chr(10), ' '), chr(13), ' '))) AS t FROM documents) z) y
""",
    "v_profiles": r"""
SELECT item_id AS id, CASE item_id % 3 WHEN 0 THEN 'Senior Ring Economy' WHEN 1 THEN 'Python widget lead' ELSE 'Standard bolt' END AS position,
  concat('Python, ECONOMY; python', CASE WHEN item_id % 2 = 0 THEN ', ring; widget, the' ELSE '' END) AS skills,
  CASE WHEN item_id % 4 = 0 THEN NULL ELSE CAST(80000 + item_id * 5000 AS INT) END AS salary_expected,
  CASE WHEN item_id % 5 = 0 THEN 'office, PROMO' ELSE NULL END AS stop_words,
  CASE WHEN item_id % 2 = 0 THEN 'удаленно' ELSE NULL END AS work_format,
  CASE WHEN item_id % 3 = 0 THEN 'полная занятость' ELSE NULL END AS employment_type
FROM benchmark
""",
    "v_matches": r"""
SELECT p.id AS profile_id, v.vacancy_id,
  CASE (p.id + CAST(v.vacancy_id AS BIGINT)) % 5 WHEN 0 THEN 'new' WHEN 1 THEN 'scored' WHEN 2 THEN 'skipped' WHEN 3 THEN 'applied' ELSE 'hidden' END AS status,
  CASE WHEN (p.id + CAST(v.vacancy_id AS BIGINT)) % 5 = 0 THEN NULL ELSE CAST((p.id * 7 + CAST(v.vacancy_id AS BIGINT) * 3) % 101 AS INT) END AS score
FROM v_vacancies v CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) o CROSS JOIN (SELECT count(*) AS n FROM v_profiles) t
JOIN v_profiles p ON p.id = (CAST(v.vacancy_id AS BIGINT) * 7 + o.k * 13) % t.n
""",
    "v_checks": r"""
SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'ssr' WHEN 1 THEN 'llm' ELSE 'index' END AS kind,
  concat('https://site', CAST(event_id % 97 AS STRING), '.example.com/') AS url,
  CASE event_type WHEN 'error' THEN NULL WHEN 'click' THEN 'mismatch' WHEN 'view' THEN 'ok' WHEN 'signup' THEN 'warn' ELSE 'fail' END AS verdict,
  CASE event_type WHEN 'click' THEN 'yandex: text_diff' WHEN 'purchase' THEN 'http_not_ok' ELSE '' END AS reasons,
  concat('10.0.0.', CAST(user_id % 40 AS STRING)) AS ip, user_id, ts AS created_at
FROM events
""",
    "v_requests": r"""
SELECT event_id AS id, CASE WHEN user_id % 40 = 0 THEN 'compare-internal' ELSE concat('10.0.0.', CAST(user_id % 40 AS STRING)) END AS ip,
  CASE WHEN event_id % 50 = 0 THEN 'https://exempt.example.com/' ELSE concat('https://site', CAST(event_id % 97 AS STRING), '.example.com/') END AS url, ts
FROM events
""",
}


def with_views(*names: str) -> str:
    """A WITH clause for the named views and those that they are made from."""
    needed: dict[str, None] = {}

    def add(name: str) -> None:
        for other in VIEWS:
            if other != name and other in VIEWS[name].replace(",", " ").replace("(", " ").replace(")", " ").split():
                add(other)
        needed[name] = None

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in needed)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view, or one of the driver's tables."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return _run(spark, sf_dir, f"{with_views(name)}\nSELECT * FROM {name}")


def shared_sql(spark: SparkSession, sf_dir: str, more: str, name: str, *views: str) -> DataFrame:
    """One of the views that ``more``, which the SQL twin shares, defines on top of ``views``."""
    return _run(spark, sf_dir, f"{with_views(*views)},\n{more}\nSELECT * FROM {name}")


def _run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    words = set(sql.replace("(", " ").replace(")", " ").replace(",", " ").split())
    for table in words.intersection(TABLES):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    return spark.sql(sql)
