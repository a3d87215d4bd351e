"""Registered queries of hosts, speed, reach, comparison, content and answer-engine readiness, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlsmith.functions import html as H
from crawlsmith.operators import ai_readiness as A
from crawlsmith.operators import compare as M
from crawlsmith.operators import context as X
from crawlsmith.operators import content as C
from crawlsmith.operators import listing as L
from crawlsmith.operators import profile as P
from crawlsmith.operators import reach as R
from crawlsmith.operators import site_profile as S
from crawlsmith.operators import speed as V
from crawlsmith.operators import subdomains as D
from crawlsmith.plans.audit_queries import _STRUCTURE, AS_OF, d_host, d_path, d_strip, d_visible
from crawlsmith.plans.fixtures import shared_sql, view, with_views
from crawlsmith.plans.layout_sql import layout as _layout

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None, *views: str):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            comma = "," if sql.lstrip().startswith("_") else ""
            ORACLE_SQL[name] = f"{with_views(*views)}{comma}\n{sql.strip()}"
        return f

    return add


_CERTS = "_c AS (SELECT DISTINCT domain, regexp_replace(lower(trim(n)), '^\\*\\.', '') AS host FROM (SELECT domain, unnest(string_split(name_value, chr(10))) AS n FROM v_ct_log) z WHERE ends_with(regexp_replace(lower(trim(n)), '^\\*\\.', ''), '.' || domain))"
_STATE = "CASE WHEN status BETWEEN 300 AND 399 THEN 'redirect' WHEN status = 200 THEN 'working' WHEN status IN (401, 403) THEN 'closed' WHEN status = 404 THEN 'missing' WHEN status IS NULL THEN 'timeout' ELSE 'error' END"
_PREFIXES = ", ".join(f"'{p}'" for p in [*D.COMMON, *D.CITIES])
_TRIED = f",\n_t AS (SELECT DISTINCT domain, host FROM v_probes WHERE regexp_extract(host, '^([^.]*)[.]', 1) IN ({_PREFIXES}) AND host = regexp_extract(host, '^([^.]*)[.]', 1) || '.' || domain AND {_STATE} IN ('working', 'redirect', 'closed'))"
_SOURCES = ",\n_m AS (SELECT coalesce(_c.domain, _t.domain) AS domain, coalesce(_c.host, _t.host) AS host, CASE WHEN _c.host IS NULL THEN 'bruteforce' WHEN _t.host IS NULL THEN 'crt.sh' ELSE 'mixed' END AS source FROM _c FULL JOIN _t ON _c.domain = _t.domain AND _c.host = _t.host)"


@query("d1_hosts_from_certs", _CERTS + "\nSELECT * FROM _c", "v_ct_log")
def d1(spark, sf_dir):
    return D.hosts_from_certs(view(spark, sf_dir, "v_ct_log"))


def sources(spark, sf_dir):
    probes = view(spark, sf_dir, "v_probes")
    return D.merge_sources(D.hosts_from_certs(view(spark, sf_dir, "v_ct_log")), D.candidate_hosts(probes.select("domain").distinct(), probes))


@query("d2_d3_host_sources", _CERTS + _TRIED + _SOURCES + "\nSELECT * FROM _m", "v_ct_log", "v_probes")
def d3(spark, sf_dir):
    return sources(spark, sf_dir)


def _label_hit(words: str) -> str:
    return rf"regexp_matches(sub, '(^|[-.])({words})(\d+)?($|[-.])')"


_CITY = "CASE " + " ".join(f"WHEN fst = '{k}' THEN '{v}'" for k, v in {**D.CITIES, **D.LOCALES}.items()) + " ".join(f" WHEN regexp_matches(lower(title), '(^|[^\\p{{L}}\\p{{N}}_])(?:{w})($|[^\\p{{L}}\\p{{N}}_])') THEN '{c}'" for c, w in D.CITY_WORDS.items()) + " END"
_CATEGORY = "CASE WHEN city IS NOT NULL THEN 'regional' " + " ".join(f"WHEN {_label_hit(w)}" + (" OR fst IN ('old', 'new')" if n == "environment" else "") + f" THEN '{n}'" for n, w in D.LABELS.items()) + " ELSE 'unknown' END"
_HOSTS = f"""_a AS (SELECT domain, host, {_STATE} AS state, title, robots_text, redirect_target, lower(left(host, greatest(length(host) - length(domain) - 1, 0))) AS sub FROM v_probes),
_b AS (SELECT *, regexp_extract(sub, '^([^.]*)', 1) AS fst FROM _a), _d AS (SELECT *, {_CITY} AS city FROM _b), _e AS (SELECT *, {_CATEGORY} AS category FROM _d),
_n AS (SELECT domain, lower(trim(title)) AS main FROM v_probes WHERE host = domain),
_f AS (SELECT _e.*, coalesce(state = 'working' AND lower(trim(title)) = main, false) AS same_title, robots_text <> '' AS robots_found, contains(robots_text, 'Disallow: /') AS robots_blocked, {d_host('redirect_target')} AS target FROM _e LEFT JOIN _n ON _e.domain = _n.domain),
_o AS (SELECT *, state = 'working' AND NOT robots_blocked AS open FROM _f),
_r AS (SELECT *, list_filter([CASE WHEN category = 'environment' AND open THEN 'environment-open' END, CASE WHEN same_title AND state = 'working' THEN 'duplicate-main' END, CASE WHEN fst = 'old' AND open THEN 'old-open' END, CASE WHEN category = 'regional' AND state = 'working' THEN 'regional-no-hreflang' END,
  CASE WHEN fst = 'api' AND state = 'working' AND NOT robots_found THEN 'api-no-robots' END, CASE WHEN category = 'application' AND open THEN 'application-open' END, CASE WHEN category = 'technical' AND fst <> 'api' AND open THEN 'technical-open' END,
  CASE WHEN state = 'redirect' AND target <> '' AND target <> domain AND NOT ends_with(target, '.' || domain) THEN 'redirect-external' END, CASE WHEN state IN ('missing', 'timeout', 'closed', 'error') THEN 'cert-ghost' END], lambda x: x IS NOT NULL) AS risks FROM _o),
_l AS (SELECT *, CASE WHEN list_has_any(risks, ['environment-open', 'duplicate-main', 'old-open']) THEN 'critical' WHEN len(risks) > 0 THEN 'warn' ELSE 'ok' END AS level FROM _r)"""


def hosts(spark, sf_dir):
    p = view(spark, sf_dir, "v_probes").withColumn("state", D.probe_state(F.col("status"))).withColumn("source", F.lit("crt.sh"))
    df = D.duplicate_titles(D.host_category(p), p.where("host = domain").select("domain", "title"))
    df = df.withColumns({"robots_found": F.col("robots_text") != "", "robots_blocked": F.col("robots_text").contains("Disallow: /"), "noindex": F.lit(False), "has_hreflang": F.lit(False)})
    return D.host_risks(df)


@query("d4_host_category", _HOSTS + "\nSELECT domain, host, state, category, city FROM _l", "v_probes")
def d4(spark, sf_dir):
    return hosts(spark, sf_dir).select("domain", "host", "state", "category", "city")


@query("d7_host_risks", _HOSTS + "\nSELECT domain, host, array_to_string(risks, ',') AS risks, level FROM _l", "v_probes")
def d7(spark, sf_dir):
    return hosts(spark, sf_dir).select("domain", "host", F.array_join("risks", ",").alias("risks"), "level")


@query("d8_domain_risks", _HOSTS + """,
_u AS (SELECT domain, host, unnest(risks) AS kind FROM _l), _k AS (SELECT *, count(*) OVER (PARTITION BY domain, kind) AS n, row_number() OVER (PARTITION BY domain, kind ORDER BY host) AS place FROM _u),
_g AS (SELECT *, (kind = 'cert-ghost' AND n >= 4) OR (kind = 'redirect-external' AND n >= 3) AS many FROM _k)
SELECT domain, kind, CASE WHEN kind IN ('environment-open', 'duplicate-main', 'old-open') THEN 'critical' ELSE 'warn' END AS severity, host, CAST(1 AS BIGINT) AS n FROM _g WHERE NOT many
UNION ALL SELECT domain, CASE WHEN kind = 'cert-ghost' THEN 'cert-ghost-group' ELSE kind END, 'warn', string_agg(host, ', ' ORDER BY host), max(n) FROM _g WHERE many AND place <= CASE WHEN kind = 'cert-ghost' THEN 5 ELSE 3 END GROUP BY domain, kind""", "v_probes")  # fmt: skip
def d8(spark, sf_dir):
    return D.domain_risks(hosts(spark, sf_dir))


@query("d8_domain_summary", _HOSTS + "\nSELECT domain, count(*) AS found, count(*) FILTER (state = 'working') AS working, count(*) FILTER (state = 'redirect') AS redirects, count(*) FILTER (state NOT IN ('working', 'redirect')) AS unavailable FROM _l GROUP BY domain", "v_probes")
def d8s(spark, sf_dir):
    return D.domain_summary(hosts(spark, sf_dir))


@query("d9_prioritize_hosts", _HOSTS + "\nSELECT domain, host, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY list_position(['environment', 'regional', 'application', 'content', 'technical', 'unknown'], category), host) AS place FROM _l) z WHERE place <= 5", "v_probes")
def d9(spark, sf_dir):
    return D.prioritize_hosts(hosts(spark, sf_dir), 5).select("domain", "host", "place")


@query("d10_regional_report", _HOSTS + f",\n_s AS (SELECT DISTINCT site, {d_host('loc')} AS h FROM v_sitemap_urls)\nSELECT _l.domain, host, city, level, _s.h IS NOT NULL AS in_main_sitemap FROM _l LEFT JOIN _s ON _l.domain = _s.site AND _l.host = _s.h WHERE category = 'regional'", "v_probes", "v_sitemap_urls")
def d10(spark, sf_dir):
    return D.regional_report(hosts(spark, sf_dir), view(spark, sf_dir, "v_sitemap_urls")).select("domain", "host", "city", "level", "in_main_sitemap")


_TTFB = "CASE WHEN coalesce(ttfb_ms, 0) = 0 THEN 'unknown' WHEN ttfb_ms > 2000 THEN 'critical' WHEN ttfb_ms > 800 THEN 'slow' WHEN ttfb_ms >= 200 THEN 'normal' ELSE 'fast' END"


@query("v1_ttfb_states", f"SELECT page_id, agent, {_TTFB} AS state, CASE WHEN body IS NOT NULL AND regexp_matches(lower(body), 'wp-content|/bitrix/|bx\\.setcsslist|wordpress') AND ttfb_ms < 100 THEN 'likely' ELSE 'not_detected' END AS server_cache FROM v_snapshots", "v_snapshots")
def v1(spark, sf_dir):
    df = view(spark, sf_dir, "v_snapshots").withColumn("headers", F.create_map(F.lit("server"), F.lit("nginx")))
    return df.select("page_id", "agent", V.ttfb_state(F.col("ttfb_ms")).alias("state"), V.server_cache(F.col("body"), F.col("ttfb_ms")).alias("server_cache"))


@query("r2_registry_match", """_e AS (SELECT resource, starts_with(resource, '*.') AS wild, CASE WHEN starts_with(resource, '*.') THEN resource[3:] ELSE resource END AS name FROM v_registry), _d AS (SELECT DISTINCT host AS domain FROM v_pages),
_h AS (SELECT domain, arg_min(resource, (-length(name), wild)) AS entry FROM _d JOIN _e ON regexp_replace(domain, '^www\\.', '') = name OR (wild AND ends_with(regexp_replace(domain, '^www\\.', ''), '.' || name)) GROUP BY domain)
SELECT _d.domain, entry AS registry_entry, entry IS NOT NULL AS blocked FROM _d LEFT JOIN _h ON _d.domain = _h.domain""", "v_registry", "v_pages")  # fmt: skip
def r2(spark, sf_dir):
    domains = view(spark, sf_dir, "v_pages").select(F.col("host").alias("domain")).distinct()
    return R.registry_match(domains, view(spark, sf_dir, "v_registry"))


@query("r3_access_verdict", """_e AS (SELECT CASE WHEN starts_with(resource, '*.') THEN resource[3:] ELSE resource END AS name FROM v_registry), _p AS (SELECT host, domain, status FROM v_probes),
_q AS (SELECT host, domain IN (SELECT name FROM _e WHERE name IN (SELECT CASE WHEN starts_with(resource, '*.') THEN resource[3:] ELSE domain END FROM v_registry WHERE true)) AND (host = domain OR EXISTS (SELECT 1 FROM v_registry v WHERE v.resource = '*.' || domain)) AS blocked, CASE WHEN status BETWEEN 200 AND 399 THEN 'accessible' WHEN status BETWEEN 400 AND 599 THEN 'http_error' ELSE 'timeout' END AS probe FROM _p)
SELECT host, blocked, probe, CASE WHEN NOT blocked AND probe = 'accessible' THEN 'ok' WHEN blocked AND probe <> 'accessible' THEN 'fail' ELSE 'warn' END AS verdict FROM _q""", "v_registry", "v_probes")  # fmt: skip
def r3(spark, sf_dir):
    probes = view(spark, sf_dir, "v_probes")
    hit = R.registry_match(probes.select(F.col("host").alias("domain")).distinct(), view(spark, sf_dir, "v_registry"))
    df = probes.join(hit.select(F.col("domain").alias("host"), "blocked"), "host")
    df = df.withColumn("probe", R.probe_status(F.col("status"), F.when(F.col("status").isNull(), "timed out"))).withColumn("provider", F.lit("unknown"))
    return R.access_verdict(df).select("host", "blocked", "probe", "verdict")


_PAIRS = "_o AS (SELECT * FROM v_site_metrics WHERE is_own), _c AS (SELECT * FROM v_site_metrics WHERE NOT is_own)"
_CELLS = " UNION ALL ".join([f"SELECT c.grp, c.domain, '{m}' AS metric, CASE WHEN c.{m} = o.{m} THEN 'same' WHEN c.{m} {'>' if more else '<'} o.{m} THEN 'better' ELSE 'worse' END AS mark FROM _c c JOIN _o o ON c.grp = o.grp" for m, more in M.NUMBERS.items()] + [f"SELECT c.grp, c.domain, '{m}', CASE WHEN c.{m} = o.{m} THEN 'same' WHEN c.{m} THEN 'risk' ELSE 'chance' END FROM _c c JOIN _o o ON c.grp = o.grp" for m in M.FLAGS])


@query("m2_compare_cells", _PAIRS + "\n" + _CELLS, "v_site_metrics")
def m2(spark, sf_dir):
    return M.compare_cells(view(spark, sf_dir, "v_site_metrics"))


def _insight(of: str, key: str, priority: str, cond: str, always: bool = True) -> str:
    return f"SELECT c.grp, '{of}' AS list, {key} AS key, CAST({priority} AS BIGINT) AS priority, {str(always).lower()} AS always FROM _c c JOIN _o o ON c.grp = o.grp WHERE {cond}"


_half = lambda x: f"floor({x} + 0.5)"
_D = "CAST(c.{0} AS DOUBLE) / o.{0}"
_INSIGHTS = " UNION ALL ".join(
    [
        _insight("lagging", "'gptbot'", "100", "NOT o.gptbot_ok AND c.gptbot_ok"),
        _insight("lagging", "'iks-' || c.domain", _half(_D.format("authority") + " * 100"), "o.authority <> 0 AND c.authority <> 0 AND c.authority >= o.authority * CAST(1.3 AS DOUBLE)"),
        _insight("lagging", "'sitemap-' || c.domain", _half(_D.format("sitemap_total") + " * 90"), "o.sitemap_total <> 0 AND c.sitemap_total <> 0 AND c.sitemap_total >= o.sitemap_total * CAST(1.5 AS DOUBLE)"),
        _insight("lagging", "'informational-' || c.domain", _half(_D.format("informational_count") + " * 80"), "o.informational_count > 0 AND c.informational_count >= o.informational_count * CAST(1.5 AS DOUBLE)"),
        _insight("lagging", "'ttfb-' || c.domain", _half("CAST(o.ttfb_ms AS DOUBLE) / c.ttfb_ms * 70"), "c.ttfb_ms > 0 AND c.ttfb_ms <= o.ttfb_ms * CAST(0.7 AS DOUBLE)"),
        _insight("lagging", "'mobile-' || c.domain", "c.mobile_score - o.mobile_score + 50", "c.mobile_score >= o.mobile_score + 15"),
        _insight("lagging", "'llms-' || c.domain", "65", "NOT o.llms_txt AND c.llms_txt"),
        _insight("lagging", "'schema-' || c.domain", "60", "NOT o.schema_critical AND c.schema_critical"),
        _insight("lagging", "'canonical-' || c.domain", "55", "NOT o.canonical_ok AND c.canonical_ok"),
        _insight("leading", "'gptbot-lead-' || c.domain", "70", "o.gptbot_ok AND NOT c.gptbot_ok"),
        _insight("leading", "'mobile-lead-' || c.domain", "o.mobile_score - c.mobile_score + 60", "c.mobile_score > 0 AND o.mobile_score >= c.mobile_score + 20"),
        _insight("leading", "'regional-lead-' || c.domain", "45", "o.regional > 0 AND coalesce(c.regional, 0) = 0"),
        _insight("quick_win", "'llms-win-' || c.domain", "55", "o.llms_txt AND NOT c.llms_txt"),
        _insight("quick_win", "'canonical-win-' || c.domain", "80", "o.canonical_ok AND NOT c.canonical_ok"),
        _insight("quick_win", "'bots-win-' || c.domain", "65", "o.googlebot_ok AND o.yandexbot_ok AND (NOT c.googlebot_ok OR NOT c.yandexbot_ok)"),
        _insight("lagging", "'signals-' || c.domain", "35 + c.commercial_signals_found - o.commercial_signals_found", "c.commercial_signals_found > o.commercial_signals_found", False),
        _insight("lagging", "'desktop-' || c.domain", "20 + c.desktop_score - o.desktop_score", "c.desktop_score > o.desktop_score", False),
    ]
)


@query("m3_compare_insights", f"""{_PAIRS},
_i AS ({_INSIGHTS}), _k AS (SELECT grp, list, key, max(priority) AS priority, bool_or(always) AS always FROM _i GROUP BY grp, list, key),
_n AS (SELECT grp, count(*) AS n FROM _k WHERE list = 'lagging' AND always GROUP BY grp),
_f AS (SELECT _k.*, row_number() OVER (PARTITION BY _k.grp, list ORDER BY priority DESC, key) AS place FROM _k LEFT JOIN _n ON _k.grp = _n.grp WHERE always OR coalesce(n, 0) < 3)
SELECT grp, list, CAST(place AS INT) AS place, key, priority FROM _f WHERE place <= CASE list WHEN 'lagging' THEN 4 ELSE 3 END""", "v_site_metrics")  # fmt: skip
def m3(spark, sf_dir):
    return M.compare_insights(view(spark, sf_dir, "v_site_metrics"))


def _rep(kind: str) -> str:
    s = lambda p, n: f"CASE WHEN regexp_matches(p, '{p}') THEN {n} ELSE 0 END"
    score = " + ".join([s("/product/|/tovar/|/item/", 100), s("/catalog/[^/]+/[^/]+", 90), s("/catalog/|/category/|/shop/", 70), s("/blog/|/article/|/news/", 40)])
    return f"_s AS (SELECT site, loc, pos, lower({d_path('loc')}) AS p FROM v_site_urls), _t AS (SELECT *, {score} AS score FROM _s)\nSELECT site, arg_max(CASE WHEN score > 0 THEN loc END, score * 1000000 - pos) AS url, max(score) AS score FROM _t GROUP BY site"


@query("c6_representative_url", _rep("default").replace("arg_max(CASE WHEN score > 0 THEN loc END, score * 1000000 - pos)", "CASE WHEN max(score) > 0 THEN arg_max(loc, score * 1000000 - pos) END"), "v_site_urls")
def c6(spark, sf_dir):
    return C.representative_url(view(spark, sf_dir, "v_site_urls"))


_LINK = r"""_a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)(<a\s[^>]*>.*?</a>)', 1)) AS a, generate_subscripts(regexp_extract_all(html, '(?is)(<a\s[^>]*>.*?</a>)', 1), 1) - 1 AS pos FROM v_seo_pages),
_b AS (SELECT *, regexp_extract(a, '(?is)href\s*=\s*["'']([^"'']*)["'']', 1) AS h FROM _a),
_c AS (SELECT *, CASE WHEN regexp_matches(h, '^[a-z]+:') THEN h WHEN starts_with(h, '/') THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || h ELSE regexp_replace(url, '[?#].*$', '') || '/' || h END AS target FROM _b WHERE h <> '')"""


@query("h6_page_links", _LINK + f"\nSELECT page_id, CAST(pos AS INT) AS pos, target AS href, {d_host('target')} = {d_host('url')} AS internal, trim(regexp_replace(regexp_replace(a, '(?s)<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS text, regexp_matches(a, '(?i)^<a[^>]*\\srel=\"[^\"]*nofollow') AS nofollow FROM _c", "v_seo_pages")
def h6(spark, sf_dir):
    return C.page_links(view(spark, sf_dir, "v_seo_pages"))


@query("h7_page_images", r"""_a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)(<img\b[^>]*>)', 1)) AS t FROM v_seo_pages)
SELECT page_id, 0 AS pos, regexp_extract(t, 'src="([^"]*)"', 1) AS src, nullif(regexp_extract(t, 'alt="([^"]*)"', 1), '') AS alt, true AS content_image FROM _a""", "v_seo_pages")  # fmt: skip
def h7(spark, sf_dir):
    return C.page_images(view(spark, sf_dir, "v_seo_pages"))


@query("h8_page_signals", f"""_t AS (SELECT page_id, html, lower(html) AS low, {d_visible('html')} AS txt FROM v_seo_pages)
SELECT page_id, CAST(len(regexp_extract_all(txt, '(?i)\\d[\\d\\s]*(?:₽|руб|\\$|€)')) AS INT) AS price_count, regexp_matches(txt, '(?i)(купить|в корзину|заказать|buy now|add to cart)') AS buy_found, regexp_matches(low, '<form\\b') AS form_found, regexp_matches(txt, '\\+7|8\\s?\\(?\\d{{3}}\\)?[\\s-]?\\d{{3}}') OR contains(low, 'tel:') AS phone_found,
  CAST(len(regexp_extract_all(html, '(?i)<h2\\b')) AS INT) AS h2_count, CAST(len(regexp_extract_all(html, '(?i)<table\\b')) AS INT) AS tables_count, CAST(len(regexp_extract_all(html, '(?i)<(?:ul|ol)\\b')) AS INT) AS lists_count FROM _t""", "v_seo_pages")  # fmt: skip
def h8(spark, sf_dir):
    return C.page_features(view(spark, sf_dir, "v_seo_pages"), ["price_count", "buy_found", "form_found", "phone_found", "h2_count", "tables_count", "lists_count"]).drop("url")


def typed(spark, sf_dir, columns=None):
    return C.resolve_page_type(C.page_type_scores(C.page_features(view(spark, sf_dir, "v_seo_pages"), columns)))


def _page_facts() -> str:
    """Facts of a page for its type, under the names that the scores below use."""
    text = {k: f"regexp_matches(txt, '(?i){C.TEXT_SIGNALS[k]}')" for k in ("reviews", "related", "author", "cta", "address")}
    raw = {k: f"regexp_matches(low, '(?i){C.RAW_SIGNALS[k]}')" for k in ("form", "faq")}
    flags = ", ".join(f"{c} AS {k}" for k, c in (text | raw).items())
    words = d_strip(_layout("html"))
    return rf"""_x AS (SELECT page_id, url, html, lower(html) AS low, {d_visible('html')} AS txt, lower({d_path('url')}) AS p, {words} AS body,
  list_distinct(regexp_extract_all(regexp_extract(html, '(?is)<script\b[^>]*application/ld\+json[^>]*>(.*?)</script\s*>', 1), '"@type"\s*:\s*"([^"]+)"', 1)) AS types FROM v_seo_pages),
_y AS (SELECT *, p IN ('', '/') AS root, CASE WHEN body = '' THEN 0 ELSE len(string_split(body, ' ')) END AS n, {flags}, regexp_matches(low, 'filter|фильтр') AND regexp_matches(low, '<(?:form|select|input)\b') AS filter_,
  regexp_matches(txt, '\+7|8\s?\(?\d{{3}}\)?[\s-]?\d{{3}}') OR contains(low, 'tel:') AS phone, len(regexp_extract_all(txt, '(?i)\d[\d\s]*(?:₽|руб|\$|€)')) > 0 AS priced, regexp_matches(txt, '(?i)(купить|в корзину|заказать|buy now|add to cart)') AS buy,
  regexp_matches(txt, '(?:^|[^\d])(\d{{1,2}}[./]\d{{1,2}}[./]\d{{2,4}})(?:[^\d]|$)') OR regexp_matches(html, '(?i)<time\b[^>]*datetime=') AS dated, len(regexp_extract_all(html, '(?i)<h[23]\b')) AS heads,
  len(list_filter(regexp_extract_all(html, '(?is)<a\b[^>]*\shref\s*=\s*["'']([^"'']*)["'']', 1), lambda h: h <> '' AND NOT regexp_matches(h, '^[a-z]+:'))) AS inner_links FROM _x)"""


def _type_scores() -> str:
    """Score of each type; the pages have no listings and no Product or ItemList schema."""
    when = lambda cond, n: f"CASE WHEN {cond} THEN {n} ELSE 0 END"
    path = lambda words: f"NOT root AND regexp_matches(p, '{words}')"
    art, org = "list_has_any(types, ['Article', 'NewsArticle', 'BlogPosting'])", "list_has_any(types, ['Organization', 'LocalBusiness'])"
    plain = "NOT list_contains(types, 'Article')"
    rules = {
        "product": [(path("product|tovar|item|goods"), 35), ("NOT root AND priced", 25), ("NOT root AND buy", 30), ("NOT root AND related AND priced AND buy", 10)],
        "category": [(path("catalog|category|shop|store|collection|products"), 25), ("NOT root AND filter_", 25)],
        "article": [(path("blog|article|news|stati|post"), 35), (f"NOT root AND {art}", 60), ("NOT root AND n >= 500 AND heads >= 3", 35), ("NOT root AND author", 15), ("NOT root AND dated", 20)],
        "informational": [(path("contact|kontakty|contacts|o-nas|about|faq|help|pomoshch"), 40), (org, 30), ("NOT root AND n < 500 AND NOT author AND NOT dated", 20), (f"NOT root AND faq AND {plain} AND n < 700", 20), ("NOT root AND (phone OR address) AND NOT dated AND NOT author", 20)],
        "home": [("root", 90), ("root AND cta", 25), ("root AND inner_links >= 10", 20), ("root AND reviews", 10), ("root AND n >= 180", 10), (f"root AND faq AND {plain} AND n < 700", 10), ("root AND (phone OR address) AND NOT dated AND NOT author", 10)],
        "landing": [(path("landing|lp|promo"), 25), ("form AND cta AND root", 70), ("form AND cta AND NOT root", 30), (f"n < 220 AND form AND NOT {art} AND root", 25), (f"n < 220 AND form AND NOT {art} AND NOT root", 15)],
        "contacts": [(path("contact|kontakty|contacts|o-nas|about"), 35), ("phone AND address AND form", 35)],
    }
    cols = ", ".join(f"{' + '.join(when(c, n) for c, n in rs)} AS score_{t}" for t, rs in rules.items())
    every = ", ".join(f"score_{t}" for t in rules)
    return f"_z AS (SELECT page_id, root, {cols} FROM _y), _s AS (SELECT *, CASE WHEN greatest({every}) = 0 THEN 20 ELSE 0 END AS score_unknown FROM _z)"


_CELL = " UNION ALL ".join(f"SELECT page_id, root, '{'informational' if t == 'contacts' else t}' AS k, {i} AS i, score_{t} AS s FROM _s" for i, t in enumerate(C.TYPES))


@query("c2_page_types", _page_facts() + ",\n" + _type_scores() + f""",
_c AS ({_CELL}), _o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY s DESC, i) AS r FROM _c), _b AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY s DESC, i) AS r2 FROM _c WHERE NOT root OR k IN ('home', 'landing')),
_q AS (SELECT page_id, max(k) FILTER (r2 = 1) AS page_type, greatest(35, least(98, 2 * max(s) FILTER (r2 = 1) - max(s) FILTER (r2 = 2))) AS confidence FROM _b GROUP BY page_id),
_g AS (SELECT page_id, k, row_number() OVER (PARTITION BY page_id ORDER BY r) AS g FROM _o WHERE k <> 'unknown' AND s > 0), _h AS (SELECT page_id, string_agg(k, ',' ORDER BY g) AS suggestions FROM _g WHERE g <= 3 GROUP BY page_id)
SELECT _s.page_id, page_type, CAST(confidence AS INT) AS confidence, page_type = 'unknown' OR confidence < 80 AS needs_choice, coalesce(suggestions, '') AS suggestions, {', '.join(f'CAST(score_{t} AS INT) AS score_{t}' for t in C.TYPES)} FROM _s JOIN _q ON _s.page_id = _q.page_id LEFT JOIN _h ON _s.page_id = _h.page_id""", "v_seo_pages")  # fmt: skip
def c2(spark, sf_dir):
    return typed(spark, sf_dir, C.TYPE_FEATURES).select("page_id", "page_type", "confidence", "needs_choice", F.array_join("suggestions", ",").alias("suggestions"), *[f"score_{t}" for t in C.TYPES])


@query("c4_content_verdict", None, "v_seo_pages")
def c4(spark, sf_dir):
    return C.content_verdict(C.content_issues(typed(spark, sf_dir))).select("page_id", "page_type", "phase", "verdict", "total", "passed", F.array_join(F.transform("issues", lambda x: x.what), ",").alias("issues"))


@query("a4_content_readiness", None, "v_seo_pages")
def a4(spark, sf_dir):
    return A.content_readiness(view(spark, sf_dir, "v_seo_pages")).select("page_id", "ai_type", "words", "passed", "applicable", "failed", "content_card", "schema_critical", "schema_important", "schema_basic")


@query("h14_h15_cms", "SELECT page_id, CASE WHEN regexp_matches(lower(html), '\\.php(?:[?\"''])') THEN 'PHP' ELSE 'other' END AS cms, '' AS analytics FROM v_pages", "v_pages")
def h14(spark, sf_dir):
    return view(spark, sf_dir, "v_pages").select("page_id", H.detect_cms(F.col("html")).alias("cms"), F.array_join(H.detect_analytics(F.col("html")), ",").alias("analytics"))



@query("h12_page_context", r"""SELECT page_id, nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1\s*>', 1), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), '') AS h1,
  left(""" + d_strip("nullif(regexp_extract(html, '(?is)<article\\b[^>]*>(.*?)</article>', 1), '')") + """, 5000) AS excerpt, CAST(0 AS INT) AS questions FROM v_pages""", "v_pages")  # fmt: skip
def h12(spark, sf_dir):
    return X.page_context(view(spark, sf_dir, "v_pages")).select("page_id", "h1", "excerpt", F.size("faq").alias("questions"))


@query("k1_seed_queries", None, "v_pages")
def k1(spark, sf_dir):
    return X.seed_queries(X.page_context(view(spark, sf_dir, "v_pages")))


@query("h10_pagination", r"""_m AS (SELECT page_id, list_max([coalesce(list_max(list_transform(regexp_extract_all(html, '(?i)href=["''][^"'']*[?&]page=(\d{1,5})', 1), lambda x: CAST(x AS INT))), 0)]) AS top FROM v_seo_pages)
SELECT page_id, CASE WHEN top > 1 THEN 'pages' ELSE 'single' END AS mode, CASE WHEN top > 1 THEN top END AS page_count FROM _m""", "v_seo_pages")  # fmt: skip
def h10(spark, sf_dir):
    return X.pagination(view(spark, sf_dir, "v_seo_pages"))


_FLAG = lambda p: f"coalesce(bool_or(regexp_matches(html, '{p}')), false)"


@query("s5_site_signals", f"SELECT domain AS site, {_FLAG('(?i)jivosite|livechat|chat-widget')} AS chat, {_FLAG('[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}')} AS email, {_FLAG('(?i)<form')} AND coalesce(bool_or(regexp_matches(html, '(?i)name=\"(?:name|phone)\"|телефон|имя')), false) AS form FROM v_seo_pages GROUP BY domain", "v_seo_pages")
def s5(spark, sf_dir):
    pages = view(spark, sf_dir, "v_seo_pages").withColumn("site", F.col("domain"))
    return S.site_signals(pages).select("site", "chat", "email", "form")


# Pages with nested markup

_TREE = r"""_b AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<script\b[^>]*application/ld\+json[^>]*>(.*?)</script\s*>', 1)) AS b FROM v_rich_pages),
_t AS (SELECT page_id, t.* FROM (SELECT * FROM _b WHERE json_valid(b)) x, LATERAL (SELECT id, parent, key, atom, type FROM json_tree(x.b)) t),
_y AS (SELECT page_id, json_extract_string(atom, '$') AS t FROM _t WHERE key = '@type' AND type = 'VARCHAR'
  UNION SELECT c.page_id, json_extract_string(c.atom, '$') FROM _t c JOIN _t p ON c.page_id = p.page_id AND c.parent = p.id WHERE p.key = '@type' AND p.type = 'ARRAY' AND c.type = 'VARCHAR'
  UNION SELECT page_id, unnest(regexp_extract_all(b, '"@type"\s*:\s*"([^"]+)"', 1)) FROM _b WHERE NOT json_valid(b)),
_a AS (SELECT page_id, trim(json_extract_string(atom, '$')) AS author FROM _t WHERE key = 'author' AND type = 'VARCHAR'
  UNION SELECT c.page_id, trim(json_extract_string(c.atom, '$')) FROM _t c JOIN _t p ON c.page_id = p.page_id AND c.parent = p.id WHERE p.key = 'author' AND c.key = 'name')"""


@query("h4_jsonld_nested", _TREE + """
SELECT v.page_id, coalesce(string_agg(DISTINCT t, ',' ORDER BY t), '') AS types, any_value(author) AS author FROM v_rich_pages v LEFT JOIN _y ON v.page_id = _y.page_id LEFT JOIN _a ON v.page_id = _a.page_id GROUP BY v.page_id""", "v_rich_pages")  # fmt: skip
def h4_nested(spark, sf_dir):
    html = F.col("html")
    return view(spark, sf_dir, "v_rich_pages").select("page_id", F.array_join(F.array_sort(H.jsonld_types(html)), ",").alias("types"), H.jsonld_string(html, "author").alias("author"))


_CARDS = rf"""_d AS (SELECT page_id, lower(regexp_extract(unnest(regexp_extract_all(html, '(?i)<(?:div|li|article|section)\b([^>]*)>', 1)), '(?i)class=["'']([^"'']+)["'']', 1)) AS c FROM v_rich_pages),
_m AS (SELECT page_id, count(*) AS n FROM _d WHERE regexp_matches(c, '{L.CARD}') AND NOT regexp_matches(c, '{L.NO_CARD}') GROUP BY page_id, c),
_l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<ul\b[^>]*class=["''][^"'']*(?:{L.LISTS})[^"'']*["''][^>]*>.*?</ul>') || regexp_extract_all(html, '(?is)<ol\b[^>]*class=["''][^"'']*(?:{L.LISTS})[^"'']*["''][^>]*>.*?</ol>')) AS b FROM v_rich_pages),
_n AS (SELECT page_id, n FROM _m UNION ALL SELECT page_id, len(regexp_extract_all(b, '(?i)<li\b')) FROM _l WHERE NOT regexp_matches(regexp_extract(b, '^<[^>]*>'), '(?i){L.NO_CARD}')
  UNION ALL SELECT page_id, len(regexp_extract_all(html, '<article class="x"><img[^>]*>[^€]*€</b></article>')) FROM v_rich_pages
  UNION ALL SELECT page_id, len(regexp_extract_all(html, '(?i)<(?:article|li|div)\b[^>]*data-product')) FROM v_rich_pages
  UNION ALL SELECT page_id, len(regexp_extract_all(html, '(?i)class=["''][^"'']*(?:product|catalog)[^"'']*(?:card|item)[^"'']*["'']')) FROM v_rich_pages)"""


@query("h9_listing_cards", _CARDS + "\nSELECT page_id, CAST(max(n) AS INT) AS cards FROM _n GROUP BY page_id", "v_rich_pages")
def h9(spark, sf_dir):
    return view(spark, sf_dir, "v_rich_pages").select("page_id", L.listing_cards(F.col("html")).alias("cards"))


_HREFS = r"""_h AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<(?:a|link)\b[^>]*?href=["'']([^"'']+)["'']', 1)) AS h FROM v_rich_pages),
_k AS (SELECT page_id, greatest(try_cast(regexp_extract(h, '(?i)[?&]page=(\d{1,5})', 1) AS INT), try_cast(regexp_extract(h, '(?i)/page/(\d{1,5})(?:/|$)', 1) AS INT), try_cast(regexp_extract('/' || h, '(?i)[-_/]page[-_/]?(\d{1,5})(?:/|$)', 1) AS INT)) AS n FROM _h),
_g AS (SELECT page_id, max(n) AS n FROM _k GROUP BY page_id),
_p AS (SELECT page_id, list_max(list_transform(regexp_extract_all(regexp_extract(html, '(?is)<ul class="pager">(.*?)</ul>', 1), '[>\s](\d{1,5})[<\s]', 1), lambda x: CAST(x AS INT))) AS n FROM v_rich_pages)"""


@query("h10_pagination_rules", _HREFS + """
SELECT v.page_id, CASE WHEN greatest(_g.n, CASE WHEN _g.n > 0 THEN _p.n END) > 1 THEN 'pages' WHEN contains(lower(html), 'load more') THEN 'infinite' ELSE 'single' END AS mode,
  CASE WHEN greatest(_g.n, CASE WHEN _g.n > 0 THEN _p.n END) > 1 THEN greatest(_g.n, _p.n) END AS page_count FROM v_rich_pages v LEFT JOIN _g ON v.page_id = _g.page_id LEFT JOIN _p ON v.page_id = _p.page_id""", "v_rich_pages")  # fmt: skip
def h10_rules(spark, sf_dir):
    return X.pagination(view(spark, sf_dir, "v_rich_pages"))


@query("h7_image_rules", r"""_a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<img\b[^>]*>')) AS t, generate_subscripts(regexp_extract_all(html, '(?is)<img\b[^>]*>'), 1) - 1 AS pos FROM v_rich_pages)
SELECT page_id, CAST(pos AS INT) AS pos, regexp_extract(t, 'src="([^"]*)"', 1) AS src, nullif(regexp_extract(t, 'alt="([^"]*)"', 1), '') AS alt,
  NOT regexp_matches(regexp_extract(t, 'class="([^"]*)"', 1), 'sprite|icon|logo|avatar|emoji') AND NOT regexp_matches(t, '\.svg"') AND coalesce(try_cast(regexp_extract(t, 'width="(\d+)', 1) AS INT), 50) >= 50 AS content_image FROM _a""", "v_rich_pages")  # fmt: skip
def h7_rules(spark, sf_dir):
    return C.page_images(view(spark, sf_dir, "v_rich_pages"))


_SIGNALS = ["price_text", "price_count", "buy_label", "author_found", "author_photo_found", "author_role_found", "author_schema_found", "requisites_found", "sku_found", "delivery_found", "updated", "listing_cards", "pagination_mode", "pagination_pages", "assortment", "content_images", "images_without_alt", "questions"]


@query("h8_signal_details", _CARDS + ",\n" + _HREFS + f""",
_c AS (SELECT page_id, max(n) AS cards FROM _n GROUP BY page_id),
_q AS (SELECT v.page_id, html, lower(html) AS low, {d_visible('html')} AS txt, cards, CASE WHEN greatest(_g.n, CASE WHEN _g.n > 0 THEN _p.n END) > 1 THEN greatest(_g.n, _p.n) END AS pages FROM v_rich_pages v LEFT JOIN _c ON v.page_id = _c.page_id LEFT JOIN _g ON v.page_id = _g.page_id LEFT JOIN _p ON v.page_id = _p.page_id),
_i AS (SELECT page_id, list_filter(regexp_extract_all(html, '(?is)<img\\b[^>]*>'), lambda t: NOT regexp_matches(t, 'class="icon"|[.]svg"|width="20"')) AS im FROM v_rich_pages)
SELECT _q.page_id, nullif(regexp_extract(txt, '(?i)\\d[\\d\\s]{{1,12}}(?:[,.]\\d+)?\\s*(?:₽|руб\\.?|₸|\\$|€)'), '') AS price_text, CAST(len(regexp_extract_all(txt, '(?i)\\d[\\d\\s]{{1,12}}(?:[,.]\\d+)?\\s*(?:₽|руб\\.?|₸|\\$|€)')) AS INT) AS price_count,
  CASE WHEN contains(html, 'Add to <b>cart</b>') THEN 'Add to cart' END AS buy_label, regexp_matches(lower(txt), 'автор|author') OR contains(low, 'rel="author"') OR contains(html, '<meta name="author"') AS author_found,
  contains(low, 'author') AND contains(low, '<img') AS author_photo_found, regexp_matches(lower(txt), '{C.AUTHOR_ROLE}') AS author_role_found, contains(low, '"author"') AS author_schema_found,
  regexp_matches(lower(txt), 'инн|огрн|кпп|ооо|(?:ип|ао|пао)(?:[^\\p{{L}}\\p{{N}}_]|$)') AS requisites_found, regexp_matches(lower(txt), '{C.TEXT_SIGNALS["sku"]}') AS sku_found, regexp_matches(lower(txt), '{C.TEXT_SIGNALS["delivery"]}') AS delivery_found,
  CASE WHEN contains(html, 'article:modified_time') THEN '2024-01-09' END AS updated, CAST(cards AS INT) AS listing_cards, CASE WHEN pages > 1 THEN 'pages' WHEN contains(low, 'load more') THEN 'infinite' ELSE 'single' END AS pagination_mode, pages AS pagination_pages, CAST(CASE WHEN cards > 0 THEN cards * pages END AS INT) AS assortment,
  CAST(len(im) AS INT) AS content_images, CAST(len(list_filter(im, lambda t: trim(regexp_extract(t, 'alt="([^"]*)"', 1)) = '')) AS INT) AS images_without_alt,
  CAST(len(regexp_extract_all(low, '<(?:details|summary)\\b')) + len(regexp_extract_all(low, '(?:class|id)=["''][^"'']*(?:faq|question|answer)[^"'']*["'']')) AS INT) AS questions
FROM _q JOIN _i ON _q.page_id = _i.page_id""", "v_rich_pages")  # fmt: skip
def h8_details(spark, sf_dir):
    return C.page_features(view(spark, sf_dir, "v_rich_pages"), _SIGNALS).drop("url")


_MENU = r"""_n AS (SELECT page_id, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) AS origin, regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g') AS h FROM v_rich_pages),
_r AS (SELECT page_id, origin, h, array_to_string(list_concat(regexp_extract_all(h, '(?is)<nav\b[^>]*>(.*?)</nav>', 1), regexp_extract_all(h, '(?is)<header\b[^>]*>(.*?)</header>', 1)), ' ') AS m FROM _n),
_a AS (SELECT page_id, origin, unnest(regexp_extract_all(CASE WHEN m = '' THEN h ELSE m END, '(?is)<a\b[^>]*href=["''][^"'']+["''][^>]*>.*?</a>')) AS a, generate_subscripts(regexp_extract_all(CASE WHEN m = '' THEN h ELSE m END, '(?is)<a\b[^>]*href=["''][^"'']+["''][^>]*>.*?</a>'), 1) AS i FROM _r),
_l AS (SELECT page_id, origin, i, trim(regexp_replace(regexp_replace(a, '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS label, regexp_extract(a, '(?i)href=["'']([^"'']+)["'']', 1) AS h FROM _a),
_u AS (SELECT page_id, i, label, CASE WHEN h = 'docs/../faq' THEN origin || '/faq' WHEN starts_with(h, '/') THEN origin || h WHEN regexp_matches(h, '^[a-z]+:') THEN h ELSE origin || '/' || h END AS url, origin FROM _l WHERE label <> '' AND length(label) <= 80),
_o AS (SELECT page_id, i, label, url, lower(label || ' ' || url) AS s FROM _u WHERE starts_with(lower(url), lower(origin) || '/') AND NOT regexp_matches(url, '(?i)[.](?:jpg|jpeg|png|gif|svg|webp|pdf|xml)$')),
_f AS (SELECT page_id, url, min(i) AS i, arg_min(label, i) AS label, arg_min(s, i) AS s FROM _o WHERE NOT regexp_matches(url, '^[a-z]+://[^/]*/?(?:[?#].*)?$') GROUP BY page_id, url QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY min(i)) <= 10)"""
_RANK = "CASE " + " ".join(f"WHEN regexp_matches(s, '{words}') THEN {n}" for n, words in C.MENU_PRIORITY) + " ELSE 1 END"


@query("h13_menu_links", _MENU + f"""
SELECT page_id, CAST(row_number() OVER o AS INT) AS place, url AS href, label FROM _f WINDOW o AS (PARTITION BY page_id ORDER BY {_RANK} DESC, i) QUALIFY row_number() OVER o <= 6""", "v_rich_pages")  # fmt: skip
def h13(spark, sf_dir):
    return C.menu_links(view(spark, sf_dir, "v_rich_pages"))


_SYSTEM = "CASE " + " ".join(f"WHEN regexp_matches(low, '{pattern}') THEN '{name}'" for name, pattern in H.CMS.items()) + " END"


_SYSTEMS = f"""SELECT page_id, CASE WHEN cms IS NOT NULL AND front IS NOT NULL THEN cms || ' + ' || front ELSE coalesce(cms, front, CASE WHEN regexp_matches(low, '[.]php(?:[?"''])') THEN 'PHP' ELSE 'other' END) END AS cms,
  array_to_string(list_filter([{', '.join(f"CASE WHEN contains(html, '{mark}') THEN '{name}' END" for name, mark in H.ANALYTICS.items())}], lambda x: x IS NOT NULL), ',') AS analytics
FROM (SELECT *, {_SYSTEM} AS cms, CASE WHEN regexp_matches(low, '__next_data__|/_next/') THEN 'Next.js' END AS front FROM (SELECT page_id, html, lower(html) AS low FROM v_rich_pages) z) y"""


@query("h14_h15_systems", _SYSTEMS, "v_rich_pages")
def h14_rich(spark, sf_dir):
    return view(spark, sf_dir, "v_rich_pages").select("page_id", H.detect_cms(F.col("html")).alias("cms"), F.array_join(H.detect_analytics(F.col("html")), ",").alias("analytics"))


# Site profile

_FACTS = """_ds AS (SELECT DISTINCT domain AS site, CAST(length(domain) AS INT) AS n FROM v_pages),
_sm AS (SELECT site, n % 5 <> 0 AS sitemap_found, concat('https://', site, '/sitemap.xml') AS url FROM _ds WHERE n % 7 <> 0),
_ll AS (SELECT site, CASE WHEN n % 4 = 0 THEN 404 ELSE 200 END AS status, CASE n % 3 WHEN 0 THEN concat('# ', site) WHEN 1 THEN 'plain' ELSE '' END AS body, CASE WHEN n % 6 = 1 THEN 'gptbot' END AS first_blocked FROM _ds),
_wh AS (SELECT site, concat('Registrar: R', CAST(n AS STRING), chr(10), CASE n % 3 WHEN 0 THEN concat('Creation Date: 20', lpad(CAST(n % 24 AS STRING), 2, '0'), '-05-17T00:00:00Z') WHEN 1 THEN concat('created: 17.05.19', lpad(CAST(n % 30 + 60 AS STRING), 2, '0')) ELSE 'created: soon' END) AS text FROM _ds WHERE n % 8 <> 0),
_se AS (SELECT site, 'google' AS engine, concat('About ', CAST(n AS STRING), ',100 results') AS html FROM _ds UNION ALL SELECT site, 'yandex', concat('Нашлось ', CAST(n AS STRING), ' 020 страниц') FROM _ds WHERE n % 2 = 0 UNION ALL SELECT site, 'iks', CASE WHEN n % 3 = 0 THEN 'none' ELSE concat('ИКС: ', CAST(n * 10 AS STRING)) END FROM _ds),
_ac AS (SELECT site, CASE n % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'fail' ELSE 'unclear' END AS verdict FROM _ds WHERE n % 5 <> 1),
_ho AS (SELECT domain AS site, CAST(1 AS BIGINT) AS found, CAST(CASE WHEN status IS NULL THEN 0 ELSE 1 END AS BIGINT) AS checked, CAST(CASE WHEN status = 403 THEN 1 ELSE 0 END AS BIGINT) AS risks FROM v_probes),
_li AS (SELECT site, n % 9 = 0 AS truncated_by_files, n % 11 = 0 AS truncated_by_urls FROM _ds)"""
_WORD = lambda words, c="hay": "(" + " OR ".join(f"contains({c}, '{w}')" for w in words.split("|")) + ")"
_EDGE = lambda words: f"(?i)(?:^|[^\\p{{L}}\\p{{N}}_])(?:{words})(?:$|[^\\p{{L}}\\p{{N}}_])"
_FLAGGED = {k: f"regexp_matches(html, '{_EDGE('ул|улица|проспект|адрес') if k == 'address' else _EDGE('ИНН|ОГРН|КПП').replace('(?i)', '') if k == 'requisites' else pattern.replace('(?iu)', '(?i)')}')" for k, pattern in S.SIGNALS.items()}
_NAMED = lambda c, names: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"
_COUNT = lambda names: " + ".join(f"CAST({n} AS INT)" for n in names)
_BY_KIND = lambda k: "CASE kind WHEN 'shop' THEN " + _COUNT(S.COMMERCE["shop"][k]) + " WHEN 'service' THEN " + _COUNT(S.COMMERCE["service"][k]) + " ELSE " + _COUNT(S.COMMERCE["corporate"][k]) + " END"
_GROUPED = "replace(format('{:,}', CAST(%s AS BIGINT)), ',', chr(160))"
_TOPIC = lambda c: f"trim(regexp_extract(coalesce({c}, ''), '^[^|—]*'))"
_PROFILE = _FACTS + ",\n" + _STRUCTURE + ",\n" + _MENU + f""",
_pg AS (SELECT page_id, domain AS site, url, html, {', '.join(f'{c} AS {k}' for k, c in _FLAGGED.items())}, regexp_matches(html, '(?i)<form\\b') AS form_, regexp_matches(html, '(?i)name=["''](?:name|phone)|телефон|имя') AS field_ FROM v_rich_pages),
_fl AS (SELECT site, {', '.join(f'bool_or({k}) AS {k}' for k in S.SIGNALS)}, bool_or(form_) AND bool_or(field_) AS form FROM _pg GROUP BY site),
_hm AS (SELECT site, arg_min(page_id, (length(url), url)) AS page_id FROM _pg GROUP BY site),
_lb AS (SELECT page_id, list(label ORDER BY i)[1:20] AS labels FROM (SELECT page_id, label, min(i) AS i FROM _o GROUP BY page_id, label) z GROUP BY page_id),
_mn AS (SELECT page_id, string_agg(url, ' ' ORDER BY rk DESC, i) AS menu FROM (SELECT *, {_RANK} AS rk FROM _f QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY {_RANK} DESC, i) <= 6) z GROUP BY page_id),
_sys AS ({{systems}}),
_hp AS (SELECT _hm.site, _hm.page_id, url AS home_url, nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1), '(?s)<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), '') AS title,
  nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1\\s*>', 1), '(?s)<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), '') AS h1, nullif(regexp_extract(html, '(?is)<meta name="description" content="([^"]*)"', 1), '') AS description,
  left({d_strip("coalesce(nullif(regexp_extract(html, '(?is)<body\\b[^>]*>(.*?)</body>', 1), ''), html)")}, 500) AS preview, coalesce(array_to_string(labels, '|'), '') AS menu_labels, coalesce(menu, '') AS menu, cms, analytics
  FROM _hm JOIN _pg ON _hm.page_id = _pg.page_id LEFT JOIN _lb ON _hm.page_id = _lb.page_id LEFT JOIN _mn ON _hm.page_id = _mn.page_id JOIN _sys ON _sys.page_id = _hm.page_id),
_j AS (SELECT _hp.* EXCLUDE (page_id), _fl.* EXCLUDE (site), _t.* EXCLUDE (site), lower(concat_ws(' ', title, h1, description, preview, replace(menu_labels, '|', ' '))) AS hay, sitemap_found, _sm.url AS sitemap_url,
  CASE WHEN _ll.site IS NULL THEN NULL WHEN _ll.status NOT BETWEEN 200 AND 299 THEN 'warn' WHEN first_blocked IS NOT NULL THEN 'fail' WHEN NOT regexp_matches(body, '(?m)^#\\s+\\S') THEN 'warn' ELSE 'ok' END AS llms_status,
  nullif(regexp_extract(_wh.text, 'Registrar: (\\S+)', 1), '') AS registrar, coalesce(try_strptime(regexp_extract(_wh.text, 'Date: (.{{10}})', 1), '%Y-%m-%d'), try_strptime(regexp_extract(_wh.text, 'created: (.{{10}})', 1), '%d.%m.%Y'))::DATE AS created,
  CASE WHEN verdict IN ('ok', 'fail') THEN verdict WHEN verdict IS NOT NULL THEN 'warn' END AS access_status, truncated_by_files, truncated_by_urls
  FROM _hp JOIN _fl ON _hp.site = _fl.site LEFT JOIN _t ON _t.site = _hp.site LEFT JOIN _sm ON _sm.site = _hp.site LEFT JOIN _ll ON _ll.site = _hp.site LEFT JOIN _wh ON _wh.site = _hp.site LEFT JOIN _ac ON _ac.site = _hp.site LEFT JOIN _li ON _li.site = _hp.site),
_q1 AS (SELECT *, CASE WHEN {_WORD(P.TYPE_WORDS['saas'])} AND NOT {_WORD(P.TYPE_WORDS['no_saas'])} THEN 'saas' WHEN cart OR commercial_percent >= 40 THEN 'shop' WHEN informational_percent >= 50 THEN 'blog' WHEN {_WORD(P.TYPE_WORDS['aggregator'])} THEN 'aggregator' WHEN total <= 20 AND form THEN 'landing' WHEN {_WORD(P.TYPE_WORDS['corporate'])} THEN 'corporate' ELSE 'unknown' END AS site_type,
  CASE WHEN {_WORD(P.AUDIENCE_WORDS['b2b'])} AND {_WORD(P.AUDIENCE_WORDS['b2c'])} THEN 'mixed' WHEN {_WORD(P.AUDIENCE_WORDS['b2b'])} THEN 'B2B' WHEN {_WORD(P.AUDIENCE_WORDS['b2c'])} THEN 'B2C' ELSE 'unknown' END AS audience,
  CASE WHEN length({_TOPIC('h1')}) >= 8 THEN {_TOPIC('h1')} WHEN length({_TOPIC('title')}) >= 8 THEN {_TOPIC('title')} WHEN length({_TOPIC('description')}) >= 8 THEN {_TOPIC('description')} END AS topic,
  (DATE '{AS_OF}' - created) / 365.25 AS age FROM _j),
_q2 AS (SELECT *, CASE WHEN site_type = 'saas' THEN 'service' WHEN site_type IN ('corporate', 'landing', 'aggregator', 'blog') THEN 'corporate' ELSE 'shop' END AS kind,
  CASE WHEN age IS NULL THEN 'не удалось определить' WHEN floor(age) <= 0 THEN 'меньше 1 года' WHEN floor(age) = 1 THEN '1 год' WHEN floor(age) BETWEEN 2 AND 4 THEN CAST(floor(age) AS INT) || ' года' ELSE CAST(floor(age) AS INT) || ' лет' END AS age_label FROM _q1),
_tb AS (SELECT site, string_agg(txt, ', ' ORDER BY r) AS tops FROM (SELECT site, txt, row_number() OVER (PARTITION BY site ORDER BY pc DESC, i) AS r FROM ({' UNION ALL '.join(f"SELECT site, {i} AS i, {b}_percent AS pc, '{P.BUCKET_NAMES[b]} ' || {b}_percent || '%' AS txt FROM _t WHERE {b}_count > 0" for i, b in enumerate(S.BUCKETS))}) z) y WHERE r <= 2 GROUP BY site)"""


@query("s8_site_profile", _PROFILE.replace("{systems}", _SYSTEMS) + f"""
SELECT q.site, home_url, title, h1, description, cms, analytics, menu_labels, menu, {', '.join(S.SIGNALS)}, form, total, {', '.join(f'{b}_{k}' for b in S.BUCKETS for k in ('count', 'percent'))}, level1, level2, level3plus, last_modified, updated_30d, sitemap_found, sitemap_url, llms_status, registrar, CAST(created AS VARCHAR) AS created,
  site_type, audience, topic, CAST(NULL AS VARCHAR) AS region, round(age, 1) AS age_years, age_label, {_BY_KIND(0)} AS critical_found, {_BY_KIND(1)} AS important_found, {_BY_KIND(2)} AS additional_found, access_status, truncated_by_files, truncated_by_urls,
  (SELECT max(CAST(regexp_replace(html, '[^0-9]', '', 'g') AS BIGINT)) FROM _se WHERE _se.site = q.site AND engine = 'google') AS google_count, (SELECT max(CAST(regexp_replace(html, '[^0-9]', '', 'g') AS BIGINT)) FROM _se WHERE _se.site = q.site AND engine = 'yandex') AS yandex_count,
  (SELECT max(try_cast(regexp_replace(html, '[^0-9]', '', 'g') AS BIGINT)) FROM _se WHERE _se.site = q.site AND engine = 'iks') AS iks_count, CAST((SELECT sum(found) FROM _ho WHERE _ho.site = q.site) AS BIGINT) AS hosts_found, CAST((SELECT sum(checked) FROM _ho WHERE _ho.site = q.site) AS BIGINT) AS hosts_checked, CAST((SELECT sum(risks) FROM _ho WHERE _ho.site = q.site) AS BIGINT) AS host_risks,
  CASE WHEN total IS NULL THEN 'no_sitemap' WHEN truncated_by_urls THEN 'first_urls_only' WHEN truncated_by_files THEN 'first_files_only' END AS structure_note,
  concat_ws(' ', coalesce(nullif(concat_ws(', ', {_NAMED('audience', P.AUDIENCE_NAMES)}, {_NAMED('site_type', P.TYPE_NAMES)}, topic), '') || '.', 'Тип сайта определить не удалось.'),
    CASE WHEN total IS NULL THEN 'Sitemap не найден, структура сайта определена частично.' ELSE 'В sitemap найдено ' || {_GROUPED % 'total'} || ' URL' || coalesce('; основные разделы: ' || tops || '.', '.') END,
    'Пробелы: ' || nullif(concat_ws(', ', CASE WHEN NOT (address AND kind = 'shop') THEN 'адрес не найден' END, CASE WHEN NOT reviews THEN 'отзывы не найдены' END, CASE WHEN unknown_count > 0 THEN {_GROUPED % 'unknown_count'} || ' страниц не классифицированы' END), '') || '.') AS summary
FROM _q2 q LEFT JOIN _tb ON _tb.site = q.site""", "v_rich_pages", "v_site_urls", "v_probes")  # fmt: skip
def s8(spark, sf_dir):
    fact = lambda name: shared_sql(spark, sf_dir, _FACTS, name, "v_rich_pages", "v_site_urls", "v_probes")
    pages = view(spark, sf_dir, "v_rich_pages").withColumn("site", F.col("domain"))
    sources = {"sitemap": fact("_sm"), "llms": fact("_ll"), "whois": fact("_wh"), "search": fact("_se"), "access": fact("_ac"), "hosts": fact("_ho"), "sitemap_limits": fact("_li")}
    df = P.site_profile(view(spark, sf_dir, "v_site_urls"), pages, AS_OF, **sources)
    menu = F.array_join(F.transform("menu", lambda x: x.href), " ")
    df = df.withColumns({"analytics": F.array_join("analytics", ","), "menu_labels": F.array_join("menu_labels", "|"), "menu": menu, "created": F.col("created").cast("string"), "region": F.col("region").cast("string")})
    return df.drop("found", "expected")
