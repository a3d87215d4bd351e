"""Registered queries of keyword research, vacancy matching and the ledger, with the same rows in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlsmith.functions import text as T
from crawlsmith.operators import keywords as K
from crawlsmith.operators import ledger as L
from crawlsmith.operators import vacancies as V
from crawlsmith.plans.fixtures import view, with_views

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None, *views: str):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            comma = "," if sql.lstrip().startswith("_") else ""
            ORACLE_SQL[name] = f"{with_views(*views)}{comma}\n{sql.strip()}" if views else sql.strip()
        return f

    return add


def q(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def d_seed(c: str) -> str:
    out = rf"regexp_replace(regexp_replace(lower({c}), '[–—/]+', ' ', 'g'), '[^\p{{L}}\p{{N}}\s-]+', ' ', 'g')"
    for words in ("site|tool|checker|check", "ru"):
        # No lookaround in RE2: a match takes one edge, so neighbours need a second pass.
        for _ in range(2):
            out = rf"regexp_replace({out}, '(^|[^\p{{L}}\p{{N}}_])(?:{words})($|[^\p{{L}}\p{{N}}_])', '\1 \2', 'g')"
    for a, b in (("^проверьте\\s+", "проверить "), ("^найдите\\s+", "найти "), ("^проверить\\s+проверить\\s+", "проверить ")):
        out = f"regexp_replace({out}, '{a}', '{b}')"
    return rf"trim(regexp_replace(replace({out}, chr(160), ' '), '\s+', ' ', 'g'))"


def d_tokens(c: str) -> str:
    stem = f"regexp_replace(regexp_replace(x, '(?:{T.ENDINGS})$', ''), 'ь$', '')"
    return rf"list_filter(list_transform(list_filter(regexp_split_to_array({d_seed(c)}, '\s+'), lambda x: x <> ''), lambda x: {stem}), lambda x: length(x) >= 4 AND x NOT IN ({q([*T.STOPWORDS, *T.GENERIC_WORDS])}))"


def d_query_tokens(c: str) -> str:
    return rf"list_filter(regexp_split_to_array(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}\s-]+', ' ', 'g'), '\s+'), lambda x: length(x) > 2 AND x NOT IN ({q(T.STOPWORDS)}))"


@query("u8_u9_phrases", f"SELECT id, {d_seed('query')} AS phrase, array_to_string({d_tokens('query')}, '|') AS tokens FROM v_queries", "v_queries")
def u8(spark, sf_dir):
    return view(spark, sf_dir, "v_queries").select("id", T.seed_phrase(F.col("query")).alias("phrase"), F.array_join(T.comparable_tokens(F.col("query")), "|").alias("tokens"))


@query("u10_u11_ngrams", f"""_t AS (SELECT id, {d_query_tokens('query')} AS t FROM v_queries),
_g AS (SELECT id, t, list_filter(CASE WHEN len(t) >= 2 THEN list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) ELSE [] END || CASE WHEN len(t) >= 3 THEN list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]) ELSE [] END, lambda x: length(x) >= 8) AS g FROM _t)
SELECT id, array_to_string(t, '|') AS tokens, array_to_string(list_filter(g, lambda x, i: list_position(g, x) = i), '|') AS grams FROM _g""", "v_queries")  # fmt: skip
def u10(spark, sf_dir):
    df = view(spark, sf_dir, "v_queries").withColumn("t", T.query_tokens(F.col("query")))
    return df.select("id", F.array_join("t", "|").alias("tokens"), F.array_join(T.ngrams(F.array_join("t", " "), 2, 3), "|").alias("grams"))


@query("u12_slugify", r"""_t AS (SELECT id, lower(query) AS s FROM v_queries)
SELECT id, left(regexp_replace(regexp_replace(s, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 120) AS slug FROM _t""", "v_queries")  # fmt: skip
def u12(spark, sf_dir):
    return view(spark, sf_dir, "v_queries").select("id", T.slugify(F.col("query")).alias("slug"))


@query("k2_expand_queries", f"""_s AS (SELECT *, {d_tokens('seed')} AS st, {d_tokens('phrase')} AS pt FROM v_suggestions),
_o AS (SELECT DISTINCT research_id, phrase, count FROM _s WHERE {d_seed('phrase')} <> {d_seed('seed')} AND EXISTS (SELECT 1 FROM (SELECT unnest(CASE WHEN len(list_filter(st, lambda x: x NOT IN ({q(T.GENERIC_STEMS)}))) > 0 THEN list_filter(st, lambda x: x NOT IN ({q(T.GENERIC_STEMS)})) ELSE st END) AS a) u, (SELECT unnest(pt) AS t) v WHERE starts_with(a, t) OR starts_with(t, a)))
SELECT research_id, lower(phrase) AS query_key, max(count) AS frequency, arg_max(phrase, (count, phrase)) AS query, 'wordstat' AS source FROM _o GROUP BY research_id, lower(phrase)""", "v_suggestions")  # fmt: skip
def k2(spark, sf_dir):
    return K.expand_queries(view(spark, sf_dir, "v_suggestions"), None)


@query("k4_dedupe_queries", "SELECT research_id, query_key, id, query, frequency, source FROM (SELECT *, lower(trim(query)) AS query_key, row_number() OVER (PARTITION BY research_id, lower(trim(query)) ORDER BY frequency DESC, id) AS k FROM v_queries) z WHERE k = 1", "v_queries")
def k4(spark, sf_dir):
    return K.dedupe_queries(view(spark, sf_dir, "v_queries"))


_HAS = lambda c, ws: "(" + " OR ".join(f"contains({c}, '{w}')" for w in ws) + ")"
_FLAGS = rf"""_f AS (SELECT *, lower(query) AS lq FROM v_queries)
SELECT id, CASE WHEN frequency < 10 OR {_HAS('lq', K.STOP)} OR len(list_filter(regexp_split_to_array(lq, '\s+'), lambda x: x <> '')) > 7 OR (regexp_matches(lq, '(?:^|[^a-z0-9_])(?:v?\d+(?:\.\d+){{1,3}}|202\d|203\d)(?:[^a-z0-9_]|$)') AND NOT regexp_matches(lq, '44-фз|окпд|оквэд|seo|бот|google|яндекс')) THEN 'danger'
  WHEN frequency > 50000 OR {_HAS('lq', K.BRANDS)} OR (regexp_matches(lq, '[a-z]{{4,}}') AND NOT regexp_matches(lq, 'seo|ssr|csr|bot|render|react|next|google|index')) THEN 'warn' ELSE 'neutral' END AS flag FROM _f"""


@query("k5_cleanup_flags", _FLAGS, "v_queries")
def k5(spark, sf_dir):
    return K.cleanup_flags(view(spark, sf_dir, "v_queries")).select("id", "flag")


_KIND = r"CASE WHEN regexp_matches(lower(query), 'проверить|чекер|симулятор|анализатор|проверка|tool|checker') THEN 1 WHEN regexp_matches(lower(query), 'ошибка|не индекс|не открыва|не работает|упал|404|500|бот') THEN 2 WHEN regexp_matches(lower(query), 'react|next|csr|ssr|canonical|robots|schema|googlebot|llms\.txt') THEN 3 ELSE 4 END"
_CLASSES = f"_k AS (SELECT *, {_KIND} AS kind, {_HAS('lower(query)', K.STOP)} AS bad FROM v_queries),\n_c AS (SELECT *, ['instrumental', 'symptom', 'technical', 'informational'][kind] AS type, CASE WHEN bad THEN 'deleted' WHEN kind = 1 THEN 'tool' ELSE 'blog' END AS destination, CASE WHEN bad THEN 1 ELSE [9, 8, 8, 6][kind] END AS relevance FROM _k)"


@query("k6_classify_queries", _CLASSES + "\nSELECT id, type, destination, CAST(relevance AS INT) AS relevance FROM _c", "v_queries")
def k6(spark, sf_dir):
    return K.classify_queries(view(spark, sf_dir, "v_queries")).select("id", "type", "destination", "relevance")


#: Queries by rank, each held against the leaders before it.
CLUSTERS = f"""_kt AS (SELECT id, research_id, query, coalesce(frequency, 0) AS frequency, list_distinct({d_query_tokens('query')}) AS t FROM v_queries),
_kr AS (SELECT *, row_number() OVER (PARTITION BY research_id ORDER BY frequency DESC, query, id) AS rk FROM _kt),
_kw AS (SELECT DISTINCT research_id, CAST(0 AS BIGINT) AS rk, CAST([] AS STRUCT(t VARCHAR[], q VARCHAR)[]) AS leads, CAST('' AS VARCHAR) AS main FROM _kr
  UNION ALL SELECT research_id, rk, CASE WHEN hit IS NULL THEN list_append(leads, {{'t': t, 'q': query}}) ELSE leads END, coalesce(hit, query)
  FROM (SELECT r.research_id, r.rk, w.leads, r.t, r.query, list_filter(w.leads, lambda x: len(list_intersect(x.t, r.t)) > 0 AND 3 * len(list_intersect(x.t, r.t)) >= len(x.t) + len(r.t))[1].q AS hit FROM _kw w JOIN _kr r ON r.research_id = w.research_id AND r.rk = w.rk + 1) z),
_km AS (SELECT r.id, r.research_id, r.query, CAST(r.frequency AS BIGINT) AS frequency, w.main AS main_query, sha256(concat_ws('|', r.research_id, w.main)) AS cluster_id FROM _kr r JOIN _kw w ON r.research_id = w.research_id AND r.rk = w.rk)"""


@query("k8_cluster_queries", CLUSTERS + "\nSELECT * FROM _km", "v_queries")
def k8(spark, sf_dir):
    return K.cluster_queries_distributed(view(spark, sf_dir, "v_queries"))


@query("k9_tool_queries", _CLASSES + """,
_p AS (SELECT *, row_number() OVER (PARTITION BY research_id ORDER BY CASE WHEN destination = 'tool' THEN 1 ELSE 0 END DESC, frequency DESC, id) AS place FROM _c)
SELECT research_id, max(query) FILTER (place = 1) AS main_query, coalesce(string_agg(query, '|' ORDER BY place) FILTER (place > 1 AND place <= 13 AND destination = 'tool'), '') AS secondary_queries FROM _p GROUP BY research_id""", "v_queries")  # fmt: skip
def k9(spark, sf_dir):
    return K.tool_queries(K.classify_queries(view(spark, sf_dir, "v_queries"))).withColumn("secondary_queries", F.array_join("secondary_queries", "|"))


@query("k13_list_research", "_r AS (SELECT s_suppkey AS id, 'src' || CAST(s_suppkey AS VARCHAR) AS name, s_nationkey AS created_at FROM supplier)\nSELECT id, name, created_at, count(v.id) AS queries_count FROM (SELECT r.id, name, created_at, q.id AS qid FROM _r r LEFT JOIN v_queries q ON r.name = q.research_id) z LEFT JOIN v_queries v ON v.id = qid GROUP BY id, name, created_at ORDER BY created_at DESC, id LIMIT 50".replace("SELECT id, name, created_at, count(v.id)", "SELECT z.id, name, created_at, count(v.id)").replace("GROUP BY id,", "GROUP BY z.id,").replace("DESC, id LIMIT", "DESC, z.id LIMIT"), "v_queries")
def k13(spark, sf_dir):
    research = view(spark, sf_dir, "supplier").select(F.concat(F.lit("src"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("created_at"))
    counts = view(spark, sf_dir, "v_queries").groupBy("research_id").agg(F.count("id").alias("queries_count"))
    df = research.join(counts, research["id"] == counts["research_id"], "left")
    return df.select(F.col("k").alias("id"), F.col("id").alias("name"), "created_at", F.coalesce("queries_count", F.lit(0)).alias("queries_count")).orderBy(F.desc("created_at"), "id").limit(50)


@query("k15_research_board", _CLASSES + """
SELECT research_id, destination, count(*) AS shown, count(*) FILTER (source = 'seed') AS seeds, count(*) FILTER (source <> 'seed') AS expanded, count(*) FILTER (source = 'seed' AND frequency > 0) AS seeds_with_frequency FROM _c WHERE destination <> 'deleted' AND relevance >= 6 GROUP BY research_id, destination""", "v_queries")  # fmt: skip
def k15(spark, sf_dir):
    return K.research_board(K.classify_queries(view(spark, sf_dir, "v_queries")), 6)


# Vacancies

_FLOOR = r"CASE WHEN contains(lower(salary_text), 'до') AND NOT contains(lower(salary_text), 'от') THEN NULL ELSE list_min(list_filter(list_transform(regexp_extract_all(lower(salary_text), '(\d[\d\s]{2,})', 1), lambda x: CAST(regexp_replace(x, '\D', '', 'g') AS BIGINT)), lambda x: x > 1000)) END"
_SKILLS = "coalesce(CAST(CAST(key_skills AS JSON) AS VARCHAR[]), [])"
_WORK = lambda t: "CASE " + " ".join(f"WHEN {_HAS(t, ws)} THEN '{n}'" for n, ws in V.FORMATS.items()) + " ELSE 'unknown' END"


@query("u14_salary_floor", f"SELECT vacancy_id, {_FLOOR} AS salary_floor FROM v_vacancies", "v_vacancies")
def u14(spark, sf_dir):
    return view(spark, sf_dir, "v_vacancies").select("vacancy_id", T.salary_floor(F.col("salary_text")).alias("salary_floor"))


_ITEMS = lambda c: rf"list_filter(list_transform(regexp_split_to_array(coalesce({c}, ''), '[,;•\n]+'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: length(x) >= 2)"
_FIRSTS = lambda l: f"list_filter({l}, lambda x, i: list_position(list_transform({l}, lambda y: lower(y)), lower(x)) = i)"  # noqa: E731, E741
_SCORE = rf"""_v AS (SELECT vacancy_id, lower(coalesce(experience, '')) AS ex, lower(coalesce(employment, '')) AS emp, lower(concat_ws(' ', coalesce(title, ''), coalesce(description, ''))) AS rt,
  lower(concat_ws(' ', coalesce(title, ''), coalesce(employer, ''), coalesce(salary_text, ''), coalesce(experience, ''), coalesce(employment, ''), array_to_string({_SKILLS}, ' '), coalesce(description, ''))) AS hay, {_FLOOR} AS fl FROM v_vacancies),
_p AS (SELECT id AS profile_id, {_FIRSTS(_ITEMS('skills'))} AS sk, {_FIRSTS(_ITEMS('stop_words'))} AS st, list_filter(regexp_extract_all(lower(coalesce(position, '')), '([a-zа-яё+#.]{{3,}})', 1), lambda t: t NOT IN ('lead', 'senior', 'middle')) AS ro, salary_expected AS want, lower(coalesce(work_format, '')) AS wf, lower(coalesce(employment_type, '')) AS we FROM v_profiles),
_j AS (SELECT m.profile_id, m.vacancy_id, _v.* EXCLUDE (vacancy_id), _p.* EXCLUDE (profile_id), {_WORK('hay')} AS fmt FROM v_matches m JOIN _v ON m.vacancy_id = _v.vacancy_id JOIN _p ON m.profile_id = _p.profile_id WHERE status IN ('new', 'scored', 'skipped')),
_h AS (SELECT *, len(list_filter(sk, lambda w: contains(hay, lower(w)))) AS sh, len(list_filter(st, lambda w: contains(hay, lower(w)))) AS oh, len(list_filter(ro, lambda w: contains(rt, w))) AS rh FROM _j),
_s AS (SELECT profile_id, vacancy_id, CAST(CASE WHEN len(sk) = 0 THEN 0 ELSE least(35, round_even(sh * 35 / CAST(greatest(6, least(len(sk), 12)) AS DOUBLE), 0)) END AS INT) AS skills_score,
  CAST(CASE WHEN len(ro) = 0 THEN 8 ELSE least(20, round_even(rh * 20 / CAST(greatest(2, least(len(ro), 5)) AS DOUBLE), 0)) END AS INT) AS role_score,
  CASE WHEN coalesce(want, 0) = 0 THEN 10 WHEN fl IS NULL THEN 6 WHEN fl >= want THEN 15 WHEN fl >= want * 0.8 THEN 9 ELSE 2 END AS salary_score,
  CASE WHEN contains(wf, 'удал') THEN CASE WHEN fmt = 'remote' THEN 15 WHEN fmt IN ('hybrid', 'unknown') THEN 8 ELSE 1 END WHEN fmt <> 'unknown' THEN 10 ELSE 7 END AS format_score,
  CASE WHEN we = '' OR emp = '' THEN 6 WHEN (contains(emp, 'полная') AND contains(we, 'полная')) OR (contains(emp, 'частичная') AND contains(we, 'частичная')) OR (contains(emp, 'проект') AND contains(we, 'проект')) THEN 10 ELSE 4 END AS employment_score,
  CASE WHEN {_HAS('ex', ['не требуется', '1–3', '1-3'])} THEN 7 WHEN {_HAS('ex', ['3–6', '3-6', 'более 6'])} THEN 10 ELSE 5 END AS experience_score, CAST(least(35, 12 * oh) AS INT) AS penalty FROM _h),
_r AS (SELECT *, greatest(0, least(100, skills_score + role_score + salary_score + format_score + employment_score + experience_score - penalty)) AS score FROM _s)
SELECT *, score >= 50 AS recommended, CASE WHEN score >= 50 THEN 'scored' ELSE 'skipped' END AS new_status FROM _r"""


@query("j5_score_matches", _SCORE, "v_matches")
def j5(spark, sf_dir):
    return V.score_matches(view(spark, sf_dir, "v_matches"), view(spark, sf_dir, "v_vacancies"), view(spark, sf_dir, "v_profiles"))


@query("j6_rank_vacancies", "SELECT profile_id, vacancy_id, score, status, CAST(place AS INT) AS place, total FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY score DESC NULLS LAST, vacancy_id DESC) AS place, count(*) OVER (PARTITION BY profile_id) AS total FROM v_matches) z WHERE place <= 20", "v_matches")
def j6(spark, sf_dir):
    return V.rank_vacancies(view(spark, sf_dir, "v_matches"))


_TEXT = "lower(concat_ws(' ', coalesce(title, ''), coalesce(employer, ''), coalesce(employment, ''), coalesce(description, '')))"
_WIDE = f"lower(concat_ws(' ', coalesce(title, ''), coalesce(employer, ''), lower(trim(coalesce(employment, ''))), coalesce(experience, ''), array_to_string({_SKILLS}, ' '), coalesce(description, '')))"


@query("j7_vacancy_flags", f"SELECT vacancy_id, {_WORK(_TEXT)} AS work_format, trim(coalesce(salary_text, '')) <> '' AND lower(trim(salary_text)) NOT IN ('не указан', 'не указана', 'зп не указана') AS has_salary, {_WORK(_TEXT)} = 'remote' AS remote, {_HAS('lower(trim(coalesce(employment, chr(32))))', ['частич', 'проект', 'разовое задание'])} OR {_HAS(_WIDE, ['частичная занятость', 'неполный день', 'part-time', 'part time'])} AS part_time FROM v_vacancies", "v_vacancies")
def j7(spark, sf_dir):
    return V.vacancy_flags(view(spark, sf_dir, "v_vacancies"))


@query("j8_suggest_keywords", """_b AS (SELECT id, trim(position) AS po, lower(concat_ws(' ', position, skills)) AS src FROM v_profiles),
_l AS (SELECT id, [po, po] || CASE WHEN contains(src, 'ai') THEN ['AI Automation', 'AI Specialist'] ELSE [] END || CASE WHEN contains(src, 'python') THEN ['Python', 'Python Backend'] ELSE [] END || CASE WHEN contains(src, 'api') THEN ['API integration'] ELSE [] END || CASE WHEN contains(src, 'product') THEN ['Product Manager'] ELSE [] END AS l FROM _b),
_d AS (SELECT id, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM _l)
SELECT id, CAST(generate_subscripts(l[1:6], 1) - 1 AS INT) AS place, unnest(l[1:6]) AS keyword FROM _d""", "v_profiles")  # fmt: skip
def j8(spark, sf_dir):
    return V.suggest_keywords(view(spark, sf_dir, "v_profiles"))


@query("j2_upsert_vacancies", """_e AS (SELECT vacancy_id, title, CASE WHEN CAST(vacancy_id AS BIGINT) % 2 = 0 THEN CAST(NULL AS INT) ELSE 5 END AS applicants_count FROM v_vacancies WHERE CAST(vacancy_id AS BIGINT) % 3 <> 0),
_f AS (SELECT vacancy_id, title, CAST(CAST(vacancy_id AS BIGINT) % 7 AS INT) AS applicants_count FROM v_vacancies WHERE CAST(vacancy_id AS BIGINT) % 5 <> 1)
SELECT _e.vacancy_id, _e.title, coalesce(_e.applicants_count, _f.applicants_count) AS applicants_count FROM _e LEFT JOIN _f ON _e.vacancy_id = _f.vacancy_id UNION ALL SELECT * FROM _f WHERE vacancy_id NOT IN (SELECT vacancy_id FROM _e)""", "v_vacancies")  # fmt: skip
def j2(spark, sf_dir):
    v = view(spark, sf_dir, "v_vacancies").withColumn("n", F.col("vacancy_id").cast("bigint"))
    existing = v.where("n % 3 <> 0").select("vacancy_id", "title", F.when(F.col("n") % 2 == 0, F.lit(None)).otherwise(5).cast("int").alias("applicants_count"))
    feed = v.where("n % 5 <> 1").select("vacancy_id", "title", (F.col("n") % 7).cast("int").alias("applicants_count"), F.col("n").alias("pos"))
    return V.upsert_vacancies(existing, feed)


# Ledger


@query("l1_list_checks", "SELECT id, kind, url, verdict, reasons, ip, user_id, CAST(created_at AS VARCHAR) AS created_at FROM v_checks WHERE kind = 'llm' ORDER BY v_checks.created_at DESC, id DESC LIMIT 200", "v_checks")
def l1(spark, sf_dir):
    return L.list_checks(view(spark, sf_dir, "v_checks"), "llm").withColumn("created_at", F.col("created_at").cast("string"))


@query("l2_search_checks", """_m AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, id DESC) AS k, count(*) OVER () AS n FROM v_checks WHERE coalesce(verdict, 'error') = 'mismatch' AND contains(lower(concat_ws(' ', url, ip, reasons)), 'site1'))
SELECT id, kind, url, coalesce(verdict, 'error') AS verdict, reasons, ip, user_id FROM _m WHERE (k - 1) // 50 = least(1, (n - 1) // 50)""", "v_checks")  # fmt: skip
def l2(spark, sf_dir):
    return L.search_checks(view(spark, sf_dir, "v_checks"), "mismatch", "site1", 2).drop("created_at")


@query("l3_verdict_options", "SELECT DISTINCT coalesce(verdict, 'error') AS verdict FROM v_checks", "v_checks")
def l3(spark, sf_dir):
    return L.verdict_options(view(spark, sf_dir, "v_checks"))


@query("l5_daily_admission", """_r AS (SELECT *, CAST(ts AS DATE) AS day, ip = 'compare-internal' OR contains(url, 'exempt.example.com') AS ex FROM v_requests),
_k AS (SELECT id, row_number() OVER (PARTITION BY ip, day ORDER BY ts, id) AS k FROM _r WHERE NOT ex)
SELECT _r.id, ip, CAST(day AS VARCHAR) AS day, ex OR coalesce(k = 1, false) AS admitted, CASE WHEN ex THEN 'exempt' WHEN k = 1 THEN 'first' ELSE 'daily_limit' END AS reason FROM _r LEFT JOIN _k ON _r.id = _k.id""", "v_requests")  # fmt: skip
def l5(spark, sf_dir):
    return L.daily_admission(view(spark, sf_dir, "v_requests"), ["compare-internal"], ["exempt.example.com"]).withColumn("day", F.col("day").cast("string"))


# Clusters grow from the ones before, so their SQL is recursive.
ORACLE_SQL["k8_cluster_queries"] = ORACLE_SQL["k8_cluster_queries"].replace("WITH ", "WITH RECURSIVE ", 1)
