"""Vacancies against profiles: merges, component scores, ranking and flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlsmith.functions.text import collapse, salary_floor, split_items

OPEN_STATUSES = ("new", "scored", "skipped")
THRESHOLD = 50
#: Words that tell how one works, in the order tried.
FORMATS = {"remote": ["удален", "удалён", "remote", "дистанц", "home office"], "hybrid": ["гибрид", "hybrid"], "office": ["офис", "office", "на месте"]}


def _any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def skills_of(key_skills: Column) -> Column:
    return F.coalesce(F.from_json(key_skills, "array<string>"), F.array().cast("array<string>"))


def haystack(*parts: Column) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts]))


def work_format(text: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, words in FORMATS.items():
        out = out.when(_any(text, words), name)
    return out.otherwise("unknown")


def upsert_vacancies(existing: DataFrame, feed: DataFrame) -> DataFrame:
    """Unseen vacancies are added, the first of each id; a missing number of applicants is filled in."""
    cols = existing.columns
    first = feed.groupBy("vacancy_id").agg(F.min_by(F.struct(*cols), F.struct("pos")).alias("v")).select("v.*")
    new = first.join(existing.select("vacancy_id"), "vacancy_id", "left_anti").select(*cols)
    fresh = feed.groupBy("vacancy_id").agg(F.max("applicants_count").alias("fresh_"))
    kept = existing.join(fresh, "vacancy_id", "left").withColumn("applicants_count", F.coalesce("applicants_count", "fresh_")).select(*cols)
    return kept.unionByName(new)


def upsert_matches(existing: DataFrame, hits: DataFrame) -> DataFrame:
    """existing and hits (profile_id, vacancy_id, search_id, keywords): conflicts take the last search only."""
    keys = ["profile_id", "vacancy_id"]
    last = hits.groupBy(*keys).agg(F.max(F.struct("search_id", "keywords")).alias("h"))
    both = existing.join(last, keys, "full_outer")
    return both.select(*keys, F.coalesce("status", F.lit("new")).alias("status"), "score", F.coalesce("h.search_id", "search_id").alias("search_id"), F.coalesce("h.keywords", "keywords").alias("keywords"))


def hits_of_searches(found: DataFrame, searches: DataFrame, profiles: DataFrame, profile_id: int | None = None) -> DataFrame:
    """Hits for ``upsert_matches`` from found (search_id, vacancy_id): those of active searches (id, profile_id, keywords, active).

    A search without a profile belongs to the least profile id. With ``profile_id`` only that profile's searches count.
    """
    own = searches.where("active")
    if profile_id is not None:
        own = own.where(F.col("profile_id") == profile_id)
    first = F.broadcast(profiles.agg(F.min("id").alias("first_")))  # one row
    own = own.crossJoin(first).select(F.col("id").alias("search_id"), F.coalesce("profile_id", "first_").alias("profile_id"), "keywords").where("profile_id IS NOT NULL")
    return found.where("vacancy_id <> ''").join(own, "search_id").select("profile_id", "vacancy_id", "search_id", "keywords")


def clear_refreshable(matches: DataFrame, profile_id: int) -> DataFrame:
    return matches.where(~(F.col("profile_id").eqNullSafe(profile_id) & F.col("status").isin(*OPEN_STATUSES)))


def score_matches(matches: DataFrame, vacancies: DataFrame, profiles: DataFrame) -> DataFrame:
    """profile_id, vacancy_id, components, score and status of the open matches.

    Two equi-joins; each text is lower-cased once. Halves are rounded to even.
    """
    v = vacancies.select(
        "vacancy_id", "salary_text", F.lower(F.coalesce("experience", F.lit(""))).alias("exp"), F.lower(F.coalesce("employment", F.lit(""))).alias("emp"),
        F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")))).alias("role_text"),
        haystack(F.col("title"), F.col("employer"), F.col("salary_text"), F.col("experience"), F.col("employment"), F.array_join(skills_of(F.col("key_skills")), " "), F.col("description")).alias("hay"),
    )
    v = v.withColumn("floor", salary_floor(F.col("salary_text"))).withColumn("format", work_format(F.col("hay"))).drop("salary_text")
    tokens = F.filter(F.regexp_extract_all(F.lower(F.coalesce("position", F.lit(""))), F.lit(r"([a-zа-яё+#.]{3,})"), F.lit(1)), lambda t: ~t.isin("lead", "senior", "middle"))
    p = profiles.select(F.col("id").alias("profile_id"), split_items(F.col("skills")).alias("skills"), split_items(F.col("stop_words")).alias("stops"), tokens.alias("roles"), "salary_expected", F.lower(F.coalesce("work_format", F.lit(""))).alias("want_format"), F.lower(F.coalesce("employment_type", F.lit(""))).alias("want_emp"))
    df = matches.where(F.col("status").isin(*OPEN_STATUSES)).select("profile_id", "vacancy_id").join(v, "vacancy_id").join(p, "profile_id")
    hits = lambda words, text: F.size(F.filter(words, lambda w: F.col(text).contains(F.lower(w))))
    df = df.withColumn("skill_hits", hits("skills", "hay")).withColumn("stop_hits", hits("stops", "hay")).withColumn("role_hits", hits("roles", "role_text"))
    n_skills, n_roles = F.size("skills"), F.size("roles")
    shared = reduce(lambda a, b: a | b, [F.col("emp").contains(w) & F.col("want_emp").contains(w) for w in ("полная", "частичная", "проект")])
    want = F.col("salary_expected")
    part = {
        "skills_score": F.when(n_skills == 0, 0).otherwise(F.least(F.lit(35), F.bround(F.col("skill_hits") * 35 / F.greatest(F.lit(6), F.least(n_skills, F.lit(12)))))),
        "role_score": F.when(n_roles == 0, 8).otherwise(F.least(F.lit(20), F.bround(F.col("role_hits") * 20 / F.greatest(F.lit(2), F.least(n_roles, F.lit(5)))))),
        "salary_score": F.when(F.coalesce(want, F.lit(0)) == 0, 10).when(F.col("floor").isNull(), 6).when(F.col("floor") >= want, 15).when(F.col("floor") >= want * 0.8, 9).otherwise(2),
        "format_score": F.when(F.col("want_format").contains("удал"), F.when(F.col("format") == "remote", 15).when(F.col("format").isin("hybrid", "unknown"), 8).otherwise(1)).otherwise(F.when(F.col("format") != "unknown", 10).otherwise(7)),
        "employment_score": F.when((F.col("want_emp") == "") | (F.col("emp") == ""), 6).when(shared, 10).otherwise(4),
        "experience_score": F.when(_any(F.col("exp"), ["не требуется", "1–3", "1-3"]), 7).when(_any(F.col("exp"), ["3–6", "3-6", "более 6"]), 10).otherwise(5),
        "penalty": F.least(F.lit(35), 12 * F.col("stop_hits")),
    }
    df = df.withColumns({k: c.cast("int") for k, c in part.items()})
    total = sum((F.col(k) for k in part if k != "penalty"), F.lit(0)) - F.col("penalty")
    score = F.greatest(F.lit(0), F.least(F.lit(100), total))
    return df.select("profile_id", "vacancy_id", *part, score.alias("score"), (score >= THRESHOLD).alias("recommended"), F.when(score >= THRESHOLD, "scored").otherwise("skipped").alias("new_status"))


def rank_vacancies(matches: DataFrame, status: str | None = None, offset: int = 0, limit: int = 20) -> DataFrame:
    """For each profile its matches by score (none last), a page of them, with the total."""
    if status:
        matches = matches.where(F.col("status") == status)
    by = Window.partitionBy("profile_id")
    place = F.row_number().over(by.orderBy(F.desc_nulls_last("score"), F.desc("vacancy_id")))
    ranked = matches.withColumn("place", place).withColumn("total", F.count(F.lit(1)).over(by))
    return ranked.where((F.col("place") > offset) & (F.col("place") <= offset + limit))


def vacancy_flags(vacancies: DataFrame) -> DataFrame:
    """vacancy_id with work_format, has_salary, remote and part_time."""
    salary, emp = F.lower(F.trim(F.coalesce("salary_text", F.lit("")))), F.lower(F.trim(F.coalesce("employment", F.lit(""))))
    text = haystack(F.col("title"), F.col("employer"), F.col("employment"), F.col("description"))
    wide = haystack(F.col("title"), F.col("employer"), emp, F.col("experience"), F.array_join(skills_of(F.col("key_skills")), " "), F.col("description"))
    part = _any(emp, ["частич", "проект", "разовое задание"]) | _any(wide, ["частичная занятость", "неполный день", "part-time", "part time"])
    return vacancies.select("vacancy_id", work_format(text).alias("work_format"), ((salary != "") & ~salary.isin("не указан", "не указана", "зп не указана")).alias("has_salary"), (work_format(text) == "remote").alias("remote"), part.alias("part_time"))


#: Searches that a word of the profile suggests, in this order.
TITLE_RULES = [("seo", ["SEO", "Technical SEO", "SEO Lead"]), ("growth", ["SEO Growth", "Growth Lead"])]
RULES = [("automation", ["AI Automation", "Automation Specialist"]), ("ai", ["AI Automation", "AI Specialist"]), ("agent", ["AI Agents"]), ("llm", ["LLM", "AI Automation"]), ("n8n", ["n8n"]), ("python", ["Python", "Python Backend"]), ("systems", ["Systems Specialist", "Systems Analyst"]), ("crm", ["CRM", "CRM integration"]), ("api", ["API integration"]), ("product", ["Product Manager"])]


def suggest_keywords(profiles: DataFrame, most: int = 6) -> DataFrame:
    """profile id, place and keyword: the position, its parts, then searches by rule; first spelling of each.

    Rules on titles read position and name, the others also skills and about; columns that are missing count as empty.
    """
    position = F.trim(F.coalesce("position", F.lit("")))
    own = [F.col(c) for c in ("position", "name", "skills", "about") if c in profiles.columns]
    title, source = haystack(*[F.col(c) for c in ("position", "name") if c in profiles.columns]), haystack(*own)
    none = F.array().cast("array<string>")
    when = lambda c, words: F.when(c, F.array(*map(F.lit, words))).otherwise(none)
    parts = [F.array(position), F.transform(F.split(position, r"[/|,]"), lambda x: F.trim(x))]
    parts += [when(title.contains(t), ws) for t, ws in TITLE_RULES] + [when(source.contains(t), ws) for t, ws in RULES]
    items = F.filter(F.transform(F.concat(*parts), collapse), lambda x: F.length(x) >= 2)
    df = profiles.select("id", items.alias("items")).withColumn("lowered", F.transform("items", F.lower))
    first = F.slice(F.filter("items", lambda x, i: F.array_position(F.col("lowered"), F.lower(x)) == i + 1), 1, most)
    return df.select("id", F.posexplode(first).alias("place", "keyword"))


def add_searches(profiles: DataFrame, searches: DataFrame, area: int = 1) -> DataFrame:
    """searches (profile_id, keywords, area, active) and the suggested ones of profiles that have none with keywords."""
    has = searches.where("coalesce(keywords, '') <> ''").select(F.col("profile_id").alias("id")).distinct()
    new = suggest_keywords(profiles.join(has, "id", "left_anti"))
    return searches.unionByName(new.select(F.col("id").alias("profile_id"), F.col("keyword").alias("keywords"), F.lit(area).alias("area"), F.lit(True).alias("active")))


def negotiation_report(negotiations: DataFrame, vacancies: DataFrame) -> DataFrame:
    """negotiations (id, profile_id, vacancy_id, ...) with a title, the id where there is none."""
    v = vacancies.select("vacancy_id", "title", "employer")
    return negotiations.join(v, "vacancy_id", "left").withColumn("title", F.coalesce("title", "vacancy_id"))


def drop_profile(profile_id: int, profiles: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """profiles and tables without a profile; the last profile is never dropped."""
    others = profiles.where(F.col("id") != profile_id).limit(1).count()
    if not others:
        return [profiles, *tables]
    return [profiles.where(F.col("id") != profile_id), *[t.where(~F.col("profile_id").eqNullSafe(profile_id)) for t in tables]]


def backfill_matches(matches: DataFrame, vacancies: DataFrame, owner: int) -> DataFrame:
    """Matches without a profile get the owner; vacancies that it has no match for get a new one."""
    m = matches.withColumn("profile_id", F.coalesce("profile_id", F.lit(owner)))
    new = vacancies.select(F.lit(owner).cast(m.schema["profile_id"].dataType).alias("profile_id"), "vacancy_id").join(m, ["profile_id", "vacancy_id"], "left_anti")
    return m.select("profile_id", "vacancy_id", "status", "score").unionByName(new.select("profile_id", "vacancy_id", F.lit("new").alias("status"), F.lit(None).cast("int").alias("score")))
