"""What a page is about: main text, questions, pagination, seed phrases, profile of the site, vacancy and resume fields."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from crawlsmith.functions import html as H
from crawlsmith.functions import text as T
from crawlsmith.operators.listing import pagination_of


def _questions(value: object, found: dict[str, str]) -> None:
    """Questions with their answers at any depth of a JSON-LD value; the first of equal questions stays."""
    todo = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, list):
            todo.extend(reversed(x))
        elif isinstance(x, dict):
            kinds = x.get("@type") if isinstance(x.get("@type"), list) else [x.get("@type")]
            if any(isinstance(k, str) and "question" in k.lower() for k in kinds):
                answer = x.get("acceptedAnswer")
                answer = answer if isinstance(answer, str) else (answer or {}).get("text") or (answer or {}).get("@value") if isinstance(answer, dict) else ""
                q, a = " ".join(str(x.get("name") or "").split()), " ".join(str(answer or "").split())
                if q and a:
                    found.setdefault(q, a)
            todo.extend(reversed(list(x.values())))


@F.pandas_udf(ArrayType(StructType([StructField("question", StringType()), StructField("answer", StringType())])))
def jsonld_questions(blocks: pd.Series) -> pd.Series:
    out = []
    for own in blocks:
        found: dict[str, str] = {}
        for block in own if own is not None else ():
            try:
                _questions(json.loads(block), found)
            except ValueError:
                continue
        out.append([{"question": q, "answer": a} for q, a in found.items()])
    return pd.Series(out)


def main_text(html: Column) -> Column:
    """Text of main, else article, else a content block, else the page without its furniture; elements end at the end tag that matches."""
    block = r"(?:class|id)=[\"'][^\"']*(?:content|entry|article-body|post-content)[^\"']*[\"']"
    clean = H.without_remarks(html)
    inner = lambda page: F.coalesce(H.first_inner(page, "main"), H.first_inner(page, "article"), F.when(page.rlike(f"(?i)<div\\b[^>]*{block}"), H.first_inner(page, "div", f"(?i){block}")))
    return T.strip_html(F.coalesce(H.bound(clean, inner), T.strip_layout(html)))


def page_context(pages: DataFrame, excerpt: int = 5000, questions: int = 12) -> DataFrame:
    """page_id, url, title, h1, description, excerpt and the questions that the page answers."""
    details = F.regexp_extract_all("html", F.lit(r"(?is)<details\b[^>]*>(.*?)</details>"), F.lit(1))
    summary = r"(?is)<summary\b[^>]*>(.*?)</summary>"
    pairs = F.transform(details, lambda d: F.struct(T.strip_html(F.regexp_extract(d, summary, 1)).alias("question"), T.strip_html(F.regexp_replace(d, summary, "")).alias("answer")))
    pairs = F.filter(pairs, lambda p: (p.question != "") & (p.answer != ""))
    m = H.head_meta(F.col("html"))
    df = pages.withColumn("asked_", pairs).withColumn("ld_", jsonld_questions(H.jsonld_blocks(F.col("html"))))
    ld = F.filter("ld_", lambda q: ~F.exists("asked_", lambda p: p.question == q.question))
    return df.select("page_id", "url", m["title"].alias("title"), m["h1"].alias("h1"), m["description"].alias("description"), F.substring(main_text(F.col("html")), 1, excerpt).alias("excerpt"), F.slice(F.concat("asked_", ld), 1, questions).alias("faq"))


def seed_queries(contexts: DataFrame, presets: DataFrame | None = None, grams: int = 30, most: int = 60) -> DataFrame:
    """page_id, place, query: presets of the tool (slug, queries), else phrases of the page's heads and questions."""
    fragments = F.transform(F.split(F.coalesce("description", F.lit("")), r"[.!?;,:]"), T.seed_phrase)
    base = F.concat(F.array(T.seed_phrase(F.split(F.coalesce("title", F.lit("")), r"\|")[0]), T.seed_phrase(F.coalesce("h1", F.lit("")))), fragments, F.transform("faq", lambda q: T.seed_phrase(q.question)))
    df = contexts.withColumn("base_", F.array_join(F.filter(base, lambda x: x != ""), " "))
    if presets is not None:
        slug = F.regexp_extract("url", r"/tools/([^/?#]+)", 1)
        df = df.withColumn("slug_", slug).join(presets.select(F.col("slug").alias("slug_"), F.col("queries").alias("preset_")), "slug_", "left")
    else:
        df = df.withColumn("preset_", F.lit(None).cast("array<string>"))
    useful = lambda xs: F.filter(xs, T.is_useful_phrase)
    normal = useful(F.transform(F.slice(T.ngrams(F.col("base_"), 2, 4), 1, grams), T.seed_phrase))
    short = lambda x: (F.size(F.split(x, " ")) <= 4) & ~x.rlike(r"^провер(?:ить|ка)(?:\s|$)")
    both = F.flatten(F.transform(normal, lambda x: F.when(short(x), F.array(x, F.concat(F.lit("проверить "), x))).otherwise(F.array(x))))
    low = F.lower("excerpt")
    more = lambda cond, words: F.when(cond, F.array(*map(F.lit, words))).otherwise(F.array().cast("array<string>"))
    #: Seeds that a topic adds.
    extra = F.concat(
        more(low.rlike(r"react|next\.?js|csr|ssr"), ["react индексация", "next js seo", "csr seo проблемы", "проверка рендера сайта"]),
        more(low.rlike("индексац|googlebot|бот"), ["сайт не индексируется", "как видит googlebot", "проверить индексацию страницы", "бот не видит контент сайта", "упал трафик после редизайна"]),
    )
    all_ = F.concat(F.coalesce(F.transform("preset_", T.seed_phrase), both), extra)
    return df.select("page_id", F.posexplode(F.slice(F.array_distinct(useful(F.transform(all_, T.seed_phrase))), 1, most)).alias("place", "query"))


def pagination(pages: DataFrame) -> DataFrame:
    """page_id, mode and page_count."""
    return pages.select("page_id", pagination_of(F.col("html"), F.col("url")).alias("p")).select("page_id", F.col("p.mode").alias("mode"), F.col("p.pages").alias("page_count"))


#: Where result pages of search engines, and the page of an authority index, have their number.
SEARCH_PATTERNS = {
    "google": [r"(?i)About ([\d,.\s]+) results", r"(?iu)Результатов: примерно ([\d\s .,]+)", r"(?is)id=\"result-stats\"[^>]*>(.*?)<"],
    "yandex": [r"(?iu)Нашл(?:ось|о)[^0-9]{0,20}([\d\s .,]+)", r"(?i)found[^0-9]{0,20}([\d\s .,]+)"],
    "iks": [r"(?iu)ИКС[^0-9]{0,20}([\d\s]+)", r"(?i)indexrank[^0-9]{0,20}([\d\s]+)", r"(?i)<title>\s*([\d\s]+)\s*</title>"],
}


def search_counts(html: Column, patterns: list[str]) -> Column:
    """Digits of the first pattern that finds some; null if none does, or if there are more than a number holds."""
    found = [F.nullif(F.regexp_replace(F.regexp_extract(html, p, 1), r"\D", ""), F.lit("")) for p in patterns]
    return F.coalesce(*found).try_cast("bigint")


def pick_sitemap(candidates: DataFrame) -> DataFrame:
    """The sitemap of each site from its candidates (site, pos, source, url, status): the first found, else the last that answered."""
    found = F.col("status").between(200, 299)
    row = F.struct("source", "url", "status")
    best = candidates.groupBy("site").agg(F.min_by(row, F.when(found, F.col("pos"))).alias("a"), F.max_by(row, F.when(F.col("status") > 0, F.col("pos"))).alias("b"), F.bool_or(found).alias("sitemap_found"))
    pick = F.coalesce("a", "b")
    return best.select("site", "sitemap_found", pick.source.alias("source"), pick.url.alias("url"), pick.status.alias("status"))


def llms_txt_status(df: DataFrame) -> DataFrame:
    """df (status, body, first_blocked) with the state of the site's llms.txt."""
    state = F.when(~F.coalesce(F.col("status").between(200, 299), F.lit(False)), "warn").when(F.col("first_blocked").isNotNull(), "fail").when(F.trim(F.coalesce("body", F.lit(""))) == "", "warn").when(~F.col("body").rlike(r"(?m)^#\s+\S"), "warn").otherwise("ok")
    return df.withColumn("llms_status", state)


def vacancy_page(pages: DataFrame) -> DataFrame:
    """vacancy_id with employer, description, key_skills (JSON), experience, employment and applicants of its page (html)."""
    clean = H.without_remarks(F.col("html"))
    marked = lambda name: rf"data-qa=[\"']{name}[\"']"
    inners = lambda page, tag, name: F.transform(H.elements(page, tag, marked(name)), lambda e: e.inner)
    skills = F.concat(*[F.when(F.col("clean_").rlike(marked("skills-element")), inners(F.col("clean_"), tag, "skills-element")).otherwise(F.array().cast("array<string>")) for tag in ("li", "div", "span", "a")])
    about = F.coalesce(H.meta(F.col("html"), "description"), F.lit(""))
    field = lambda name: F.nullif(F.trim(F.regexp_extract(about, rf"(?iu){name}[:\s]+([^.]+)", 1)), F.lit(""))
    df = pages.select("vacancy_id", "html", clean.alias("clean_"))
    df = df.select(
        "vacancy_id", "html", F.transform(skills, lambda x: T.text_nodes(x, "")).alias("skills_"),
        F.get(inners(F.col("clean_"), "a", "vacancy-company-name"), F.lit(0)).alias("employer_"), F.get(inners(F.col("clean_"), "div", "vacancy-description"), F.lit(0)).alias("description_"),
    )
    return df.select(
        "vacancy_id", F.nullif(T.text_nodes(F.col("employer_"), ""), F.lit("")).alias("employer"), F.nullif(T.text_nodes(F.col("description_"), "\n"), F.lit("")).alias("description"),
        F.when(F.size("skills_") > 0, F.to_json("skills_")).alias("key_skills"), field("опыт").alias("experience"), field("занятость").alias("employment"), T.applicants_count(T.strip_html(F.col("html"))).alias("applicants_count"),
    )


#: Headings of a resume; those without a section only end the one before.
HEADINGS = [
    ("опыт работы", "experience"), ("образование", "education"), ("повышение квалификации, курсы", "courses"), ("повышение квалификации", "courses"), ("знание языков", "languages"), ("навыки", "skills"),
    ("ключевые навыки", ""), ("опыт вождения", ""), ("дополнительная информация", ""), ("обо мне", "about"), ("рекомендации", ""),
]


def resume_sections(text: Column) -> Column:
    """above and found: how many lines of a resume stand above its first heading, and section and text of each section.

    A fold over the lines, which may have their sections in any order, with the heading that stands above.
    """
    pattern = lambda words: rf"(?iu)^{words}(?![\p{{L}}\p{{N}}_])[\s:]*"
    named = lambda x: reduce(lambda a, h: a.when(x.rlike(pattern(h[0])), F.lit(h[1])), HEADINGS, F.when(F.lit(False), F.lit("")))
    rest = lambda x: F.regexp_replace(x, pattern(f"(?:{'|'.join(h for h, _ in HEADINGS)})"), "")
    lines = F.transform(F.transform(F.split(text, r"\r?\n"), T.collapse), lambda x: F.struct(x.alias("text"), named(x).alias("heading")))
    state = F.struct(F.lit(0).alias("above"), F.lit(None).cast("string").alias("now"), F.array().cast("array<struct<section:string,text:string>>").alias("found"))

    def step(s: Column, x: Column) -> Column:
        line, heading = x.text, x.heading
        seen = F.exists(s.found, lambda f: f.section == heading)
        last = F.get(s.found, F.size(s.found) - 1)
        longer = F.concat(F.slice(s.found, 1, F.greatest(F.size(s.found) - 1, F.lit(0))), F.array(F.struct(last.section.alias("section"), F.trim(F.concat(last.text, F.lit(" "), line)).alias("text"))))
        begun = F.concat(s.found, F.array(F.struct(heading.alias("section"), rest(line).alias("text"))))
        # A heading that came before ends a section, but its first section stands.
        opens = heading.isNotNull() & (heading != "") & ~seen
        now = F.when(opens, heading).when(heading.isNotNull(), "").otherwise(s.now)
        return F.struct(
            F.when(now.isNull(), s.above + 1).otherwise(s.above).alias("above"), now.alias("now"),
            F.when(opens, begun).when(heading.isNull() & (s.now != ""), longer).otherwise(s.found).alias("found"),
        )

    return F.aggregate(lines, state, step, lambda s: F.struct(s.above.alias("above"), s.found.alias("found")))


def parse_resumes(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the fields of a resume's text; '' where one is missing, null for the salary.

    A position without its label is a line that names a trade and stands above all headings: what stands under one is no position.
    """
    c = F.col(text)
    first = lambda p, c=c: T.collapse(F.regexp_extract(c, p, 1))
    either = lambda *found: reduce(lambda a, b: F.when(a != "", a).otherwise(b), found)
    heads = F.slice(F.filter(F.transform(F.split(c, r"\r?\n"), F.trim), lambda x: x != ""), 1, 8)
    name = F.get(F.filter(heads, lambda x: ~F.lower(x).startswith("резюме обновлено") & ~x.rlike(r"\d|@|\+")), F.lit(0))
    salary = F.nullif(F.regexp_replace(F.regexp_extract(c, r"([\d\s]{5,})\s*₽", 1), r"\D", ""), F.lit(""))
    df = df.withColumn("sections_", resume_sections(c))
    section = lambda k: F.coalesce(F.get(F.filter("sections_.found", lambda s: s.section == k), F.lit(0)).text, F.lit(""))
    above = F.array_join(F.slice(F.split(c, r"\r?\n"), F.lit(1), F.col("sections_.above")), "\n")
    return df.withColumns({
        "name": F.coalesce(name, F.lit("")),
        "position": either(first(r"(?iu)Желаемая должность и зарплата\s+(.+?)(?:\n\s*\d|\n\s*[\d\s]+\s*₽|\n\s*Специализации:)"), first(r"(?imu)^\s*([A-Za-zА-Яа-яЁё /&\-]+(?:SEO|Python|Lead|Developer|Manager)[^\n]*)", above)),
        "phone": first(r"(\+\d[\d\s()\-]+)"),
        "email": first(r"(?i)([A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,})"),
        "location": first(r"(?iu)Проживает:\s*(.+)"),
        "citizenship": first(r"(?iu)Гражданство:\s*(.+)"),
        "work_format": either(first(r"(?iu)Формат работы:\s*(.+)"), F.when(c.rlike("(?iu)готов работать удал[её]нно"), "удалённо").otherwise("")),
        "employment_type": first(r"(?iu)Тип занятости:\s*(.+)"),
        "travel_readiness": first(r"(?iu)(Готов работать.+?командировкам)"),
        "languages": section("languages"),
        "salary_expected": salary.cast("int"),
        "skills": section("skills"),
        "about": section("about"),
        "experience": F.substring(section("experience"), 1, 4000),
        "education": section("education"),
        "courses": section("courses"),
    }).drop("sections_")
