"""Registered queries of merges, plans, list columns and state rules, with the same rows in DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from crawlsmith.functions import text as T
from crawlsmith.functions import urls as U
from crawlsmith.functions.frames import settled, shared_folder
from crawlsmith.operators import compare as M
from crawlsmith.operators import context as C
from crawlsmith.operators import indexability as X
from crawlsmith.operators import keywords as K
from crawlsmith.operators import ledger as L
from crawlsmith.operators import speed as S
from crawlsmith.operators import vacancies as V
from crawlsmith.operators.site_profile import BUCKETS
from crawlsmith.plans.audit_queries import ROBOTS, d_host
from crawlsmith.plans.fixtures import shared_sql, view, with_views
from crawlsmith.plans.layout_sql import layout as _layout
from crawlsmith.plans.research_queries import _CLASSES, _FIRSTS, _ITEMS, CLUSTERS
from crawlsmith.streaming.jobs import collected, vacancy_store

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None, *views: str):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            body = sql.strip()
            ORACLE_SQL[name] = (f"{with_views(*views)}{',' if body.startswith('_') else ''}\n{body}" if views else f"WITH {body}" if body.startswith("_") else body)
        return f

    return add


@query("u1_normalize_url", "_u AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN ' ' || host || '/x ' ELSE '' END AS u FROM v_pages)\nSELECT page_id, CASE WHEN trim(u) = '' OR regexp_matches(trim(u), '(?i)^https?://') THEN trim(u) ELSE 'https://' || trim(u) END AS url, regexp_matches(trim(u), '(?i)^https?://[^/?#\\s]+') AS valid FROM _u", "v_pages")
def u1(spark, sf_dir):
    df = view(spark, sf_dir, "v_pages").withColumn("u", F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, F.concat(F.lit(" "), "host", F.lit("/x "))).otherwise(""))
    return df.select("page_id", U.normalize_url(F.col("u")).alias("url"), U.valid_url(F.trim("u")).alias("valid"))


@query("u4_resolve_url", "SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/a/b?c=' || CAST(page_id AS VARCHAR) AS full_url FROM v_pages", "v_pages")
def u4(spark, sf_dir):
    href = F.concat(F.lit("/x/../a/b?c="), F.col("page_id").cast("string"))
    return view(spark, sf_dir, "v_pages").select("page_id", U.resolve(F.col("url"), href).alias("full_url"))


@query("u6_strip_layout", f"SELECT page_id, {_layout('html')} AS body FROM v_seo_pages", "v_seo_pages")
def u6(spark, sf_dir):
    return view(spark, sf_dir, "v_seo_pages").select("page_id", T.strip_layout(F.col("html")).alias("body"))


@query("u13_split_items", f"SELECT id, array_to_string({_FIRSTS(_ITEMS('skills'))}, '|') AS items FROM v_profiles", "v_profiles")
def u13(spark, sf_dir):
    return view(spark, sf_dir, "v_profiles").select("id", F.array_join(T.split_items(F.col("skills")), "|").alias("items"))


@query("x9_ai_robots_conflict", ROBOTS + """,
_a AS (SELECT unnest(['googlebot', 'gptbot', 'ccbot']) AS agent, unnest([0, 1, 2]) AS k2),
_sc AS (SELECT site, _ag.agent AS want, _ag.k2, group_no, pos, CASE WHEN lower(value) = _ag.agent THEN 100 WHEN value = '*' THEN 1 WHEN starts_with(_ag.agent, lower(value)) THEN length(value) ELSE -1 END AS score FROM _g, _a AS _ag WHERE group_no > 0 AND field = 'user-agent'),
_be AS (SELECT site, want, k2, group_no FROM (SELECT *, row_number() OVER (PARTITION BY site, want ORDER BY score DESC, pos) AS r FROM _sc WHERE score > -1) z WHERE r = 1),
_bl AS (SELECT _be.site, want, k2, arg_max(field, (length(value), field = 'allow', -pos)) AS rule FROM _be JOIN _g ON _be.site = _g.site AND _be.group_no = _g.group_no WHERE field <> 'user-agent' AND NOT (field = 'disallow' AND value = '') AND starts_with('/', value) GROUP BY 1, 2, 3)
SELECT v.site, (SELECT arg_min(want, k2) FROM _bl WHERE _bl.site = v.site AND rule = 'disallow') AS first_blocked FROM v_robots v""".replace("_a AS (SELECT unnest(['g", "_ai AS (SELECT unnest(['g").replace(", _a AS _ag", ", _ai AS _ag"), "v_robots")  # fmt: skip
def x9(spark, sf_dir):
    robots = view(spark, sf_dir, "v_robots")
    return X.robots_home_blocked(X.parse_robots(robots), robots.select("site"), ["googlebot", "gptbot", "ccbot"])


@query("x11_redirect_chains", """_h AS (SELECT 'p' || CAST(page_id AS VARCHAR) AS f, CASE WHEN page_id % 7 = 3 THEN 'p' || CAST(page_id AS VARCHAR) ELSE 'p' || CAST(page_id + 1 AS VARCHAR) END AS t FROM v_pages WHERE page_id % 7 < 4),
_s1 AS (SELECT f AS start, f, t, 1 AS n FROM _h), _s2 AS (SELECT s.start, h.f, h.t, 2 AS n FROM _s1 s JOIN _h h ON s.t = h.f AND s.f <> s.t), _s3 AS (SELECT s.start, h.f, h.t, 3 AS n FROM _s2 s JOIN _h h ON s.t = h.f AND s.f <> s.t),
_s4 AS (SELECT s.start, h.f, h.t, 4 AS n FROM _s3 s JOIN _h h ON s.t = h.f AND s.f <> s.t), _s5 AS (SELECT s.start, h.f, h.t, 5 AS n FROM _s4 s JOIN _h h ON s.t = h.f AND s.f <> s.t),
_al AS (SELECT * FROM _s1 UNION ALL SELECT * FROM _s2 UNION ALL SELECT * FROM _s3 UNION ALL SELECT * FROM _s4 UNION ALL SELECT * FROM _s5)
SELECT start, arg_max(t, n) AS final_url, CAST(max(n) AS INT) AS hops FROM _al GROUP BY start""", "v_pages")  # fmt: skip
def x11(spark, sf_dir):
    p = view(spark, sf_dir, "v_pages").where("page_id % 7 < 4")
    name = lambda c: F.concat(F.lit("p"), c.cast("string"))
    hops = p.select(name(F.col("page_id")).alias("from_url"), F.when(F.col("page_id") % 7 == 3, name(F.col("page_id"))).otherwise(name(F.col("page_id") + 1)).alias("to_url"), F.lit(301).alias("status"))
    return X.redirect_chains(hops).select("start", "final_url", "hops")


#: What the problems of a page's speed are read from: its time to the first byte, and the other measures made of it and of its id.
_METRICS = """_m AS (SELECT page_id, agent, ttfb_ms, ttfb_ms * 3 AS lcp, (ttfb_ms % 20) / CAST(100 AS DOUBLE) AS cls, ttfb_ms % 500 AS tbt, page_id % 7 <> 0 AS available, page_id % 7 = 1 AS partial, page_id % 50 AS gap, CASE WHEN page_id % 2 = 1 THEN 'CDN' END AS cdn,
  CASE page_id % 5 WHEN 0 THEN 'Битрикс' WHEN 1 THEN 'WordPress' WHEN 2 THEN 'Next.js' WHEN 3 THEN 'Тильда' ELSE 'other' END AS cms, CASE page_id % 4 WHEN 0 THEN 'offscreen-images' WHEN 1 THEN 'unused-javascript' WHEN 2 THEN 'font-display' ELSE 'none' END AS opportunity FROM v_snapshots)"""


@query("v2_v4_speed_problems", _METRICS + """,
_t AS (SELECT *, ttfb_ms > 800 AS waits, lcp >= 2500 AS late, lcp > 4000 AS very_late, opportunity = 'offscreen-images' AS img, opportunity = 'unused-javascript' AS js FROM _m),
_p AS (SELECT page_id, agent,
  list_filter([CASE WHEN waits AND cms <> 'Тильда' THEN 'ttfb' END, CASE WHEN very_late AND img THEN 'images' END, CASE WHEN very_late AND js THEN 'scripts' END], lambda x: x IS NOT NULL) AS critical,
  list_filter([CASE WHEN NOT available THEN 'report_missing' WHEN partial THEN 'report_partial' END, CASE WHEN waits AND cms = 'Тильда' THEN 'ttfb' END, CASE WHEN late AND NOT very_late AND img THEN 'images' END, CASE WHEN late AND NOT very_late AND js THEN 'scripts' END,
    CASE WHEN tbt > 300 AND cms = 'WordPress' THEN 'plugins' END, CASE WHEN gap > 30 THEN 'mobile_gap' END, CASE WHEN cls > 0.1 THEN 'cls' END], lambda x: x IS NOT NULL) AS warn,
  list_filter([CASE WHEN opportunity = 'font-display' THEN 'fonts' END, CASE WHEN cdn IS NULL AND ttfb_ms > 500 THEN 'cdn' END], lambda x: x IS NOT NULL) AS improve FROM _t)
SELECT page_id, agent, array_to_string(list_concat(critical, warn, improve), ',') AS problems, CASE WHEN len(critical) > 0 THEN 'fail' WHEN len(warn) > 0 THEN 'warn' ELSE 'ok' END AS verdict FROM _p""", "v_snapshots")  # fmt: skip
def v4(spark, sf_dir):
    t, k = F.col("ttfb_ms"), F.col("page_id")
    among = lambda n, *names: F.element_at(F.array(*map(F.lit, names)), (k % n + 1).cast("int"))
    df = view(spark, sf_dir, "v_snapshots").select(
        "page_id", "agent", "ttfb_ms", S.ttfb_state(t).alias("ttfb_state"), S.lcp_state(t * 3).alias("lcp"), S.cls_state((t % 20) / 100).alias("cls"), S.tbt_state(t % 500).alias("tbt"), (k % 7 != 0).alias("available"), (k % 7 == 1).alias("partial"), (k % 50).alias("gap"),
        F.when(k % 2 == 1, "CDN").alias("cdn"), among(5, "Битрикс", "WordPress", "Next.js", "Тильда", "other").alias("cms"), F.array(among(4, "offscreen-images", "unused-javascript", "font-display", "none")).alias("opportunities"),
    )
    return S.speed_problems(df).select("page_id", "agent", F.array_join(F.transform("problems", lambda p: p.kind), ",").alias("problems"), "verdict")


@query("m1_site_metrics", f"""_d AS (SELECT DISTINCT domain FROM v_pages), _a AS (SELECT domain, count(*) AS pages FROM v_pages WHERE page_id % 3 = 0 GROUP BY domain), _b AS (SELECT site AS domain, count(*) AS urls FROM v_sitemap_urls WHERE pos % 2 = 0 GROUP BY site)
SELECT _d.domain, pages, urls, array_to_string(list_filter([CASE WHEN _a.domain IS NULL THEN 'audit' END, CASE WHEN _b.domain IS NULL THEN 'sitemap' END], lambda x: x IS NOT NULL), ',') AS errors FROM _d LEFT JOIN _a ON _d.domain = _a.domain LEFT JOIN _b ON _d.domain = _b.domain WHERE {d_host("'http://' || _d.domain")} = _d.domain""", "v_pages", "v_sitemap_urls")  # fmt: skip
def m1(spark, sf_dir):
    pages = view(spark, sf_dir, "v_pages")
    audit = pages.where("page_id % 3 = 0").groupBy("domain").agg(F.count(F.lit(1)).alias("pages"))
    sitemap = view(spark, sf_dir, "v_sitemap_urls").where("pos % 2 = 0").groupBy(F.col("site").alias("domain")).agg(F.count(F.lit(1)).alias("urls"))
    return M.site_metrics(pages.select("domain"), audit=audit, sitemap=sitemap).withColumn("errors", F.array_join("errors", ","))


@query("m4_merge_insights", """_a AS (SELECT grp, domain AS title, 'd' AS detail, row_number() OVER (PARTITION BY grp ORDER BY domain) AS place FROM v_site_metrics WHERE authority % 2 = 0), _b AS (SELECT grp, domain AS title, 'd' AS detail, row_number() OVER (PARTITION BY grp ORDER BY domain DESC) AS place FROM v_site_metrics),
_u AS (SELECT *, 0 AS o FROM _a UNION ALL SELECT *, 1 FROM _b), _f AS (SELECT grp, title, detail, min((o, place)) AS p FROM _u GROUP BY 1, 2, 3), _n AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY p, title) AS k FROM _f)
SELECT grp, CAST(k AS INT) AS place, title, detail FROM _n WHERE k <= 3""", "v_site_metrics")  # fmt: skip
def m4(spark, sf_dir):
    from pyspark.sql import Window

    m = view(spark, sf_dir, "v_site_metrics").select("grp", F.col("domain").alias("title"), F.lit("d").alias("detail"), "authority")
    by = Window.partitionBy("grp")
    first = m.where("authority % 2 = 0").withColumn("place", F.row_number().over(by.orderBy("title"))).drop("authority")
    second = m.withColumn("place", F.row_number().over(by.orderBy(F.desc("title")))).drop("authority")
    return M.merge_insights(first, second, 3)


@query("k3_update_seed_frequencies", """_t AS (SELECT lower(trim(query)) AS k, max(frequency + 1) AS f FROM v_queries WHERE id % 3 = 0 AND frequency + 1 > 0 GROUP BY 1)
SELECT id, CASE WHEN source = 'seed' THEN coalesce(f, frequency) ELSE frequency END AS frequency FROM v_queries LEFT JOIN _t ON lower(trim(query)) = k""", "v_queries")  # fmt: skip
def k3(spark, sf_dir):
    df = view(spark, sf_dir, "v_queries")
    return K.update_seed_frequencies(df, df.where("id % 3 = 0").select("query", (F.col("frequency") + 1).alias("frequency"))).select("id", "frequency")


@query("k7_apply_classification", _CLASSES + """,
_o AS (SELECT id, lower(trim(query)) AS k, CASE WHEN id % 5 = 0 THEN 'deleted' ELSE 'blog' END AS d FROM v_queries), _n AS (SELECT lower(trim(query)) AS k, max(type) AS type, max(destination) AS destination, max(relevance) AS relevance FROM _c WHERE id % 2 = 0 GROUP BY 1)
SELECT id, CASE WHEN d = 'deleted' THEN 'old' ELSE coalesce(type, 'old') END AS type, CASE WHEN d = 'deleted' THEN d ELSE coalesce(destination, d) END AS destination, CAST(CASE WHEN d = 'deleted' THEN 3 ELSE coalesce(relevance, 3) END AS INT) AS relevance FROM _o LEFT JOIN _n ON _o.k = _n.k""", "v_queries")  # fmt: skip
def k7(spark, sf_dir):
    df = view(spark, sf_dir, "v_queries")
    old = df.withColumns({"type": F.lit("old"), "destination": F.when(F.col("id") % 5 == 0, "deleted").otherwise("blog"), "relevance": F.lit(3), "cluster_id": F.lit("c")})
    return K.apply_classification(old, K.classify_queries(df.where("id % 2 = 0"))).select("id", "type", "destination", "relevance")


_SLUG = "left(regexp_replace(regexp_replace(lower({q}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 120)"


@query("k10_content_plan", CLUSTERS + ",\n" + _CLASSES + f""",
_kc AS (SELECT research_id, cluster_id, main_query, CAST(sum(frequency) AS BIGINT) AS total_frequency FROM _km GROUP BY ALL),
_kl AS (SELECT cluster_id, string_agg(query, '|' ORDER BY place) AS queries FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY frequency DESC, query) AS place FROM _km) z WHERE place <= 12 GROUP BY cluster_id),
_kp AS (SELECT *, row_number() OVER (PARTITION BY research_id ORDER BY CASE WHEN destination = 'tool' THEN 1 ELSE 0 END DESC, frequency DESC, id) AS place FROM _c),
_kq AS (SELECT research_id, max(query) FILTER (place = 1) AS main_query, coalesce(string_agg(query, '|' ORDER BY place) FILTER (place > 1 AND place <= 13 AND destination = 'tool'), '') AS queries FROM _kp GROUP BY research_id)
SELECT research_id, 'blog_article' AS type, main_query AS title, '/blog/' || {_SLUG.format(q='main_query')} || '/' AS target_url, total_frequency, queries FROM _kc JOIN _kl USING (cluster_id)
UNION ALL SELECT research_id, 'tool_page', main_query, '/tools/' || {_SLUG.format(q='main_query')} || '/', NULL, queries FROM _kq""", "v_queries")  # fmt: skip
def k10(spark, sf_dir):
    df = view(spark, sf_dir, "v_queries")
    members = K.cluster_queries_distributed(df)
    return K.content_plan(K.cluster_totals(members), K.tool_queries(K.classify_queries(df)), members).withColumn("queries", F.array_join("queries", "|"))


@query("k12_replace_partition", "SELECT id, research_id, frequency FROM v_queries WHERE research_id NOT IN (SELECT research_id FROM v_queries WHERE id % 90 = 0) UNION ALL SELECT id, research_id, -1 FROM v_queries WHERE id % 90 = 0", "v_queries")
def k12(spark, sf_dir):
    df = view(spark, sf_dir, "v_queries").select("id", "research_id", "frequency")
    return K.replace_partition(df, df.where("id % 90 = 0").withColumn("frequency", F.lit(-1)))


@query("k14_list_content_plan", "SELECT id, CAST(row_number() OVER (ORDER BY CASE WHEN id % 4 = 0 THEN NULL ELSE id % 10 END NULLS LAST, CASE WHEN id % 3 = 0 THEN NULL ELSE frequency END DESC NULLS FIRST, id DESC) AS INT) AS place FROM v_queries WHERE source = 'seed'", "v_queries")
def k14(spark, sf_dir):
    from pyspark.sql import Window

    i = F.col("id")
    plan = view(spark, sf_dir, "v_queries").select("id", F.col("source").alias("status"), F.when(i % 4 != 0, i % 10).alias("planned_date"), F.when(i % 3 != 0, F.col("frequency")).alias("total_frequency"), i.alias("updated_at"))
    listed = K.list_content_plan(plan, "seed")
    order = Window.orderBy(F.asc_nulls_last("planned_date"), F.desc_nulls_first("total_frequency"), F.desc("updated_at"))
    return listed.select("id", F.row_number().over(order).alias("place"))


@query("j3_upsert_matches", """_h AS (SELECT profile_id, vacancy_id, max(profile_id * 10 + CAST(vacancy_id AS BIGINT) % 3) AS search_id FROM v_matches WHERE CAST(vacancy_id AS BIGINT) % 2 = 0 GROUP BY 1, 2), _e AS (SELECT * FROM v_matches WHERE CAST(vacancy_id AS BIGINT) % 3 <> 0)
SELECT coalesce(_e.profile_id, _h.profile_id) AS profile_id, coalesce(_e.vacancy_id, _h.vacancy_id) AS vacancy_id, coalesce(status, 'new') AS status, score, coalesce(_h.search_id, CASE WHEN _e.profile_id IS NOT NULL THEN 0 END) AS search_id FROM _e FULL JOIN _h ON _e.profile_id = _h.profile_id AND _e.vacancy_id = _h.vacancy_id""", "v_matches")  # fmt: skip
def j3(spark, sf_dir):
    m = view(spark, sf_dir, "v_matches").withColumn("n", F.col("vacancy_id").cast("bigint"))
    existing = m.where("n % 3 <> 0").select("profile_id", "vacancy_id", "status", "score", F.lit(0).cast("bigint").alias("search_id"), F.lit("k").alias("keywords"))
    hits = m.where("n % 2 = 0").select("profile_id", "vacancy_id", (F.col("profile_id") * 10 + F.col("n") % 3).alias("search_id"), F.lit("h").alias("keywords"))
    return V.upsert_matches(existing, hits).drop("keywords")


@query("j4_clear_refreshable", "SELECT profile_id, vacancy_id, status FROM v_matches WHERE NOT (profile_id = 3 AND status IN ('new', 'scored', 'skipped'))", "v_matches")
def j4(spark, sf_dir):
    return V.clear_refreshable(view(spark, sf_dir, "v_matches"), 3).select("profile_id", "vacancy_id", "status")


@query("j10_negotiation_report", "SELECT profile_id, m.vacancy_id, coalesce(v.title, m.vacancy_id) AS title, employer FROM v_matches m LEFT JOIN (SELECT * FROM v_vacancies WHERE CAST(vacancy_id AS BIGINT) % 2 = 0) v ON m.vacancy_id = v.vacancy_id WHERE status = 'applied'", "v_matches", "v_vacancies")
def j10(spark, sf_dir):
    applied = view(spark, sf_dir, "v_matches").where("status = 'applied'").select("profile_id", "vacancy_id")
    return V.negotiation_report(applied, view(spark, sf_dir, "v_vacancies").where("CAST(vacancy_id AS BIGINT) % 2 = 0"))


@query("j12_backfill_matches", "_m AS (SELECT CASE WHEN profile_id % 2 = 0 THEN 1 ELSE profile_id END AS profile_id, vacancy_id, status, score FROM v_matches)\nSELECT * FROM _m UNION ALL SELECT 1, vacancy_id, 'new', NULL FROM v_vacancies WHERE vacancy_id NOT IN (SELECT vacancy_id FROM _m WHERE profile_id = 1)", "v_matches", "v_vacancies")
def j12(spark, sf_dir):
    m = view(spark, sf_dir, "v_matches").withColumn("profile_id", F.when(F.col("profile_id") % 2 != 0, F.col("profile_id")))
    return V.backfill_matches(m, view(spark, sf_dir, "v_vacancies"), 1)


@query("l4_activity_feed", "SELECT e.event_id AS id, e.user_id, c.c_name AS user_name FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey WHERE e.user_id = 7 ORDER BY e.ts DESC, e.event_id DESC LIMIT 10")
def l4(spark, sf_dir):
    users = view(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    activity = view(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", "ts")
    return L.activity_feed(activity, users, 7).select("id", "user_id", "user_name")


_FEED = """_s AS (SELECT id * 10 AS id, CASE WHEN id % 4 = 0 THEN NULL ELSE id END AS profile_id, position AS keywords, id % 5 <> 0 AS active FROM v_profiles),
_f AS (SELECT m.profile_id * 10 AS search_id, v.vacancy_id, v.title, CAST(m.profile_id % 3 AS INT) AS batch, CAST(v.vacancy_id AS BIGINT) * 1000 + m.profile_id AS pos,
  CASE WHEN (CAST(v.vacancy_id AS BIGINT) + m.profile_id % 3) % 2 = 0 THEN NULL ELSE CAST(CAST(v.vacancy_id AS BIGINT) % 7 + m.profile_id % 3 AS INT) END AS applicants_count,
  (CAST(v.vacancy_id AS BIGINT) + m.profile_id) % 4 <> 0 AS page_read
  FROM v_matches m JOIN v_vacancies v ON m.vacancy_id = v.vacancy_id)"""


@query("l7_vacancy_ingest", _FEED + """,
_i AS (SELECT vacancy_id, min(batch * 10000000000 + pos) AS since FROM _f WHERE page_read GROUP BY vacancy_id),
_v AS (SELECT vacancy_id, min(title) AS title, arg_min(applicants_count, batch) FILTER (WHERE applicants_count IS NOT NULL AND page_read) AS applicants_count FROM _f GROUP BY vacancy_id),
_h AS (SELECT coalesce(s.profile_id, (SELECT min(id) FROM v_profiles)) AS profile_id, f.vacancy_id, f.search_id, f.batch FROM _f f JOIN _i i ON f.vacancy_id = i.vacancy_id AND f.batch * 10000000000 + f.pos >= since JOIN _s s ON s.id = f.search_id WHERE s.active)
SELECT profile_id, vacancy_id, 'new' AS status, arg_max(search_id, batch * 10000000000 + search_id) AS search_id, any_value(title) AS title, any_value(applicants_count) AS applicants_count
FROM _h JOIN _v USING (vacancy_id) GROUP BY profile_id, vacancy_id""", "v_matches", "v_vacancies", "v_profiles")  # fmt: skip
def l7(spark, sf_dir):
    """Three micro-batches into one store, then its matches with their vacancies."""
    sql = lambda name: shared_sql(spark, sf_dir, _FEED, name, "v_matches", "v_vacancies", "v_profiles")
    feed, searches, profiles = settled(sql("_f")), sql("_s"), view(spark, sf_dir, "v_profiles")
    store = vacancy_store(spark, f"{shared_folder(spark)}/vacancies-{uuid.uuid4().hex}", 16)
    for batch in range(3):
        store.merge(feed.where(F.col("batch") == batch), batch, lambda tables, rows: collected(tables, rows, searches, profiles))
    return store.read("matches").drop("score", "keywords").join(store.read("vacancies"), "vacancy_id")


def _nodes(inner: str, between: str) -> str:
    """DuckDB: trimmed pieces of text between tags."""
    return f"array_to_string(list_filter(list_transform(regexp_split_to_array({inner}, '(?s)<[^>]*>'), lambda x: regexp_replace(replace(x, '&amp;', '&'), '^[\\s ]+|[\\s ]+$', '', 'g')), lambda x: x <> ''), {between})"


@query("j1_vacancy_pages", f"""_p AS (SELECT vacancy_id, regexp_replace(html, '<script>.*?</script>', ' ') AS html, regexp_extract(html, '<meta name="description" content="([^"]*)"', 1) AS about FROM v_vacancy_pages),
_s AS (SELECT vacancy_id, list_transform(regexp_extract_all(html, '(?s)<li data-qa="skills-element">(.*?)</li>', 1) || regexp_extract_all(html, '(?s)<div data-qa="skills-element">(.*?</div>)</div>', 1), lambda x: {_nodes('x', "''")}) AS skills FROM _p)
SELECT _p.vacancy_id, {_nodes("regexp_extract(html, '(?s)vacancy-company-name[^>]*>(.*?)</a>', 1)", "''")} AS employer, nullif({_nodes("regexp_extract(html, '(?s)vacancy-description[^>]*>(.*)</div><section>', 1)", "chr(10)")}, '') AS description,
  CASE WHEN len(skills) > 0 THEN CAST(to_json(skills) AS VARCHAR) END AS key_skills, nullif(trim(regexp_extract(about, 'Опыт:\\s+([^.]+)', 1)), '') AS experience, nullif(trim(regexp_extract(about, 'Занятость:\\s+([^.]+)', 1)), '') AS employment,
  CASE WHEN contains(html, '12 человек') THEN 12 WHEN contains(html, '1 204') THEN 1204 END AS applicants_count FROM _p JOIN _s ON _p.vacancy_id = _s.vacancy_id""", "v_vacancy_pages")  # fmt: skip
def j1(spark, sf_dir):
    return C.vacancy_page(view(spark, sf_dir, "v_vacancy_pages"))


_STOPS = "Опыт работы|Образование|Повышение квалификации|Знание языков|Навыки|Опыт вождения|Обо мне"


def _part(heading: str, least: str = "") -> str:
    return f"trim(regexp_replace(coalesce(regexp_extract(text, '(?s)(?:^|\\n){heading}({least}.*?)(?:\\n(?:{_STOPS})|$)', 1), ''), '\\s+', ' ', 'g'))"


@query("j9_resumes", f"""SELECT doc_id, CASE doc_id % 2 WHEN 0 THEN 'Иван Иванов' ELSE 'Анна' END AS name, CASE WHEN contains(text, 'Желаемая') THEN 'Data Engineer' WHEN contains(text, 'Python Developer') THEN 'Python Developer / Lead' ELSE '' END AS position,
  CASE WHEN contains(text, 'Формат работы') THEN 'офис' WHEN contains(text, 'удалённо') THEN 'удалённо' ELSE '' END AS work_format, {_part('Знание языков')} AS languages, {_part('Навыки')} AS skills, {_part('Обо мне')} AS about,
  left({_part('Опыт работы ')}, 4000) AS experience, {_part('Образование')} AS education, {_part('Повышение квалификации, курсы')} AS courses, 'Город N' AS location,
  CAST(regexp_replace(nullif(regexp_extract(text, '(\\d+ 000) ₽', 1), ''), ' ', '') AS INT) AS salary_expected FROM v_resumes""", "v_resumes")  # fmt: skip
def j9(spark, sf_dir):
    return C.parse_resumes(view(spark, sf_dir, "v_resumes")).select("doc_id", "name", "position", "work_format", "languages", "skills", "about", "experience", "education", "courses", "location", "salary_expected")


@query("j11_drop_profile", "SELECT 'profiles' AS part, id AS profile_id, CAST(NULL AS VARCHAR) AS vacancy_id FROM v_profiles WHERE id <> 3 UNION ALL SELECT 'matches', profile_id, vacancy_id FROM v_matches WHERE profile_id IS DISTINCT FROM 3", "v_profiles", "v_matches")
def j11(spark, sf_dir):
    profiles, matches = V.drop_profile(3, view(spark, sf_dir, "v_profiles"), view(spark, sf_dir, "v_matches"))
    return profiles.select(F.lit("profiles").alias("part"), F.col("id").alias("profile_id"), F.lit(None).cast("string").alias("vacancy_id")).unionByName(matches.select(F.lit("matches").alias("part"), "profile_id", "vacancy_id"))


_CHECKS = """_dm AS (SELECT DISTINCT domain, CAST(length(domain) AS INT) AS n FROM v_pages),
_sp AS (SELECT domain, n % 7 <> 0 AS ok, CASE WHEN n % 2 = 0 THEN 'shop' ELSE 'blog' END AS site_type, CAST(n AS DOUBLE) AS age_years, 'x' AS age_label, 'PHP' AS cms, CAST(n * 10 AS BIGINT) AS iks_count, CAST(n AS BIGINT) AS total, """ + ", ".join(f"CAST(n % {i + 2} AS BIGINT) AS {b}_count, CAST(n % {i + 3} AS BIGINT) AS {b}_percent" for i, b in enumerate(BUCKETS)) + """,
  n % 5 AS critical_found, n % 4 AS important_found, n % 3 AS additional_found, CASE WHEN n % 3 = 0 THEN 'ok' ELSE 'warn' END AS llms_status FROM _dm WHERE n % 11 <> 0),
_sd AS (SELECT domain, n % 5 <> 1 AS ok, n * 10 AS ttfb_ms, n AS mobile_score, CASE WHEN n % 2 = 0 THEN n + 1 END AS desktop_score FROM _dm),
_ss AS (SELECT domain, true AS ok, agent, http_code, CASE WHEN page_id % 3 = 0 THEN 'captcha' END AS access_state FROM v_snapshots s JOIN v_pages p USING (page_id) WHERE page_id % 4 <> 0),
_ix AS (SELECT domain, true AS ok, n % 2 = 0 AS canonical_ok, n % 3 = 0 AS robots_allowed FROM _dm WHERE n % 3 <> 2),
_lm AS (SELECT domain, true AS ok, CASE n % 2 WHEN 0 THEN 'gptbot' ELSE 'claudebot' END AS agent, 200 AS http_code, CAST(NULL AS STRING) AS access_state, n % 4 AS schema_critical_matched, CASE WHEN n % 5 = 0 THEN {array}('details') ELSE {array}() END AS faq_signals FROM _dm),
_sb AS (SELECT domain, true AS ok, CAST(n AS BIGINT) AS found, CAST(n - 1 AS BIGINT) AS checked, CAST(n % 6 AS BIGINT) AS regional FROM _dm WHERE n % 4 <> 3),
_hs AS (SELECT domain, true AS ok, CASE WHEN host LIKE 'dev.%' THEN 'environment' ELSE 'other' END AS category, CASE WHEN status = 200 THEN 'working' ELSE 'closed' END AS state, false AS robots_blocked, length(host) % 3 = 0 AS noindex FROM v_probes),
_ct AS (SELECT domain, true AS ok, CASE WHEN n % 3 = 0 THEN 'article' ELSE 'category' END AS page_type, concat('https://', domain) AS url, n % 2 AS critical_count, n % 3 AS important_count, n % 4 AS improve_count, n % 5 AS items_on_page, n AS pagination_pages, n * 2 AS estimated_assortment, n % 2 = 0 AS infinite_scroll, n * 3 AS word_count, CAST(n AS DOUBLE) AS density, n % 2 = 1 AS author_found, n % 3 = 0 AS article_schema_found, n AS internal_links, n + 1 AS content_images FROM _dm WHERE n % 5 <> 4)"""
_PARTS = {"site_profile": "_sp", "speed": "_sd", "ssr": "_ss", "index": "_ix", "llm": "_lm", "subdomains": "_sb", "hosts": "_hs", "content": "_ct", "article": "_ct"}


def _metrics_sql() -> str:
    """DuckDB: each check summed up by itself, then left joins."""
    parts, columns, joins = [], [], []
    for name, table in _PARTS.items():
        own = ", ".join(f"max({sql.replace('size(', 'len(')}) AS {m}" for m, sql in M.METRICS[name].items())
        parts.append(f"_z{name} AS (SELECT domain, {own} FROM {table} WHERE ok GROUP BY domain)")
        joins.append(f"LEFT JOIN _z{name} ON _z{name}.domain = _dm.domain")
        columns += [f"CASE WHEN _zsubdomains.domain IS NOT NULL THEN coalesce(open_dev_test, false) END AS {m}" if m == "open_dev_test" else f"_z{name}.{m}" for m in M.METRICS[name]]
    errors = ", ".join(f"CASE WHEN _z{n}.domain IS NULL THEN '{n}' END" for n in _PARTS if n not in ("hosts", "article"))
    return f"{_CHECKS.replace('{array}', 'list_value')},\n{', '.join(parts)}\nSELECT _dm.domain, {', '.join(columns)}, array_to_string(list_filter([{errors}], lambda x: x IS NOT NULL), ',') AS errors FROM _dm {' '.join(joins)}"


@query("m1_derived_metrics", _metrics_sql(), "v_pages", "v_snapshots", "v_probes")
def m1_derived(spark, sf_dir):
    checks = {name: shared_sql(spark, sf_dir, _CHECKS.replace("{array}", "array"), table, "v_pages", "v_snapshots", "v_probes") for name, table in _PARTS.items()}
    return M.derive_metrics(view(spark, sf_dir, "v_pages").select("domain"), **checks).withColumn("errors", F.array_join("errors", ","))


_FILES = """_sf AS (SELECT concat('r:', site) AS file, 'index' AS kind, concat(x.k, ':', site) AS loc, CAST(NULL AS STRING) AS lastmod, x.p AS pos FROM (SELECT DISTINCT site FROM v_sitemap_urls) s CROSS JOIN (SELECT 'a' AS k, 0 AS p UNION ALL SELECT 'b', 1 UNION ALL SELECT 'c', 2 UNION ALL SELECT 'd', 3) x
UNION ALL SELECT DISTINCT concat('a:', site), 'index', concat(x.k, ':', site), CAST(NULL AS STRING), x.p FROM v_sitemap_urls CROSS JOIN (SELECT 'm' AS k, 0 AS p UNION ALL SELECT 'r', 1) x
UNION ALL SELECT concat(CASE pos % 3 WHEN 0 THEN 'b:' WHEN 1 THEN 'c:' ELSE 'd:' END, site), 'url', loc, lastmod, CAST(pos AS INT) FROM v_sitemap_urls
UNION ALL SELECT concat('m:', site), 'url', loc, lastmod, CAST(pos AS INT) FROM v_sitemap_urls WHERE pos % 5 = 0)"""


@query("x4_expand_sitemaps", """SELECT site, loc, lastmod, 'index' AS root_kind, false AS truncated_by_files, false AS truncated_by_urls FROM v_sitemap_urls UNION ALL SELECT site, loc, lastmod, 'index', false, false FROM v_sitemap_urls WHERE pos % 5 = 0""", "v_sitemap_urls")
def x4(spark, sf_dir):
    roots = view(spark, sf_dir, "v_sitemap_urls").select("site", F.concat(F.lit("r:"), "site").alias("file"))
    return X.expand_sitemaps(shared_sql(spark, sf_dir, _FILES, "_sf", "v_sitemap_urls"), roots)


@query("x4_bounded_sitemaps", """_u AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY pos % 3, pos) AS k, count(*) OVER (PARTITION BY site) AS n FROM v_sitemap_urls WHERE pos % 3 < 2)
SELECT site, loc, lastmod, 'index' AS root_kind, true AS truncated_by_files, n > 3 AS truncated_by_urls FROM _u WHERE k <= 3""", "v_sitemap_urls")  # fmt: skip
def x4_bounded(spark, sf_dir):
    roots = view(spark, sf_dir, "v_sitemap_urls").select("site", F.concat(F.lit("r:"), "site").alias("file"))
    return X.expand_sitemaps(shared_sql(spark, sf_dir, _FILES, "_sf", "v_sitemap_urls"), roots, 4, 3)


_DRAFTS = """_rs AS (SELECT DISTINCT research_id, concat('https://', research_id, '.example.com/tools/x') AS url FROM v_queries),
_mb AS (SELECT research_id, concat(research_id, '/', CAST(id % 7 AS STRING)) AS cluster_id, id, query, frequency FROM v_queries),
_cl AS (SELECT research_id, cluster_id, min(query) AS main_query, CAST(sum(frequency) AS BIGINT) AS total_frequency FROM _mb GROUP BY research_id, cluster_id),
_tl AS (SELECT research_id, min(query) AS main_query FROM v_queries WHERE id % 3 = 0 AND length(research_id) % 2 = 0 GROUP BY research_id)"""
_BRIEF = lambda k: "CASE type WHEN 'tool_page' THEN '" + "|".join(K.BRIEFS["tool_page"][k]) + "' ELSE '" + "|".join(K.BRIEFS["blog_article"][k]) + "' END"
_SET = lambda k: "CASE type WHEN 'tool_page' THEN " + repr(K.BRIEFS["tool_page"]["settings"][k]) + " ELSE " + repr(K.BRIEFS["blog_article"]["settings"][k]) + " END"
_DRAFT = lambda k, q: f"CASE type WHEN 'tool_page' THEN replace('{K.DRAFTS['tool_page'][k]}', '{{q}}', {q}) ELSE replace('{K.DRAFTS['blog_article'][k]}', '{{q}}', {q}) END"


@query("k10_plan_drafts", _DRAFTS + f""",
_ol AS (SELECT cluster_id, query, row_number() OVER (PARTITION BY cluster_id ORDER BY frequency DESC, query) AS place FROM _mb QUALIFY place <= 12),
_cx AS (SELECT cluster_id, trim(regexp_replace(query, '\\s+', ' ', 'g')) AS q, place, row_number() OVER (PARTITION BY cluster_id, lower(trim(regexp_replace(query, '\\s+', ' ', 'g'))) ORDER BY place) AS k FROM _ol),
_ls AS (SELECT cluster_id, string_agg(q, '|' ORDER BY place) AS sq FROM _cx WHERE k = 1 AND q <> '' GROUP BY cluster_id),
_al AS (SELECT research_id, cluster_id, 'blog_article' AS type, main_query, sq FROM _cl LEFT JOIN _ls USING (cluster_id) UNION ALL SELECT research_id, NULL, 'tool_page', coalesce(main_query, '{K.NO_TOOL_QUERY}'), NULL FROM _rs LEFT JOIN _tl USING (research_id))
SELECT research_id, cluster_id, type, main_query, coalesce(sq, '') AS secondary_queries, url AS source_url, CASE type WHEN 'tool_page' THEN '/tools/x' ELSE '/blog/' || left(regexp_replace(regexp_replace(lower(main_query), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 120) || '/' END AS target_url,
  {_DRAFT(0, 'upper(left(main_query, 1)) || substr(main_query, 2)')} AS title, {_DRAFT(1, 'main_query')} AS description, {_BRIEF('required_blocks')} AS required_blocks, {_BRIEF('schema_types')} AS schema_types, {_SET('tone')} AS tone, {_SET('min_words')} AS min_words, url AS linking_hints
FROM _al JOIN _rs USING (research_id)""", "v_queries")  # fmt: skip
def k10_drafts(spark, sf_dir):
    part = lambda name: shared_sql(spark, sf_dir, _DRAFTS, name, "v_queries")
    tools = part("_tl").withColumn("secondary_queries", F.array().cast("array<string>"))
    df = K.plan_drafts(part("_rs"), part("_cl"), tools, part("_mb"))
    lists = {c: F.array_join(c, "|") for c in ("secondary_queries", "required_blocks", "schema_types", "linking_hints")}
    return df.withColumns(lists).select("research_id", "cluster_id", "type", "main_query", "secondary_queries", "source_url", "target_url", "title", "description", "required_blocks", "schema_types", "tone", "min_words", "linking_hints")


ORACLE_SQL["k10_content_plan"] = ORACLE_SQL["k10_content_plan"].replace("WITH ", "WITH RECURSIVE ", 1)
