"""Keyword research over tables: expansion, cleaning, classes, clusters and the content plan."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlsmith.functions.frames import fenced, settled
from crawlsmith.functions.text import anchor_tokens, collapse, comparable_tokens, query_tokens, seed_phrase, slugify
from crawlsmith.functions.urls import path

#: Words of worthless intent, and competing brands.
STOP = ["скачать", "торрент", "crack", "вакансия", "работа", "wikipedia", "бесплатно", "реферат"]
BRANDS = ["topvisor", "serpstat", "ahrefs", "semrush", "rush analytics", "pr-cy"]


def contains_any(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def query_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def expand_queries(suggestions: DataFrame, seeds_a_research: int | None = 20) -> DataFrame:
    """research_id, query, frequency, source of suggestions (research_id, seed, phrase, count) that stay on topic.

    A suggestion must differ from its seed and share a token with it, as equal or as one beginning with the other.
    Of the same query the greatest frequency stays. Each distinct seed and phrase is taken apart once.
    """
    s = suggestions
    if seeds_a_research is not None:  # the feature's own limit on seeds, in their given order (position), else that of their text
        given = F.min("position") if "position" in s.columns else F.min("seed")
        first = s.groupBy("research_id", "seed").agg(given.alias("at")).withColumn("place", F.row_number().over(Window.partitionBy("research_id").orderBy("at", "seed")))
        s = s.join(first.where(F.col("place") <= seeds_a_research).select("research_id", "seed"), ["research_id", "seed"], "left_semi")
    overlap = F.exists("anchors_", lambda a: F.exists("tokens_", lambda t: (a == t) | a.startswith(t) | t.startswith(a)))
    seeds = fenced(s.select("seed").distinct().select("seed", seed_phrase(F.col("seed")).alias("seed_"), anchor_tokens(F.col("seed")).alias("anchors_")))
    phrases = fenced(s.select("phrase").distinct().select("phrase", seed_phrase(F.col("phrase")).alias("phrase_"), comparable_tokens(F.col("phrase")).alias("tokens_")))
    s = s.join(seeds, "seed").join(phrases, "phrase").where((F.col("phrase_") != F.col("seed_")) & overlap)
    best = s.groupBy("research_id", F.lower("phrase").alias("query_key")).agg(F.max(F.struct("count", "phrase")).alias("m"))
    return best.select("research_id", "query_key", F.col("m.phrase").alias("query"), F.col("m.count").alias("frequency"), F.lit("wordstat").alias("source"))


def dedupe_queries(queries: DataFrame) -> DataFrame:
    """One row for each research and query: the greatest frequency, the least id among equals."""
    df = queries.withColumn("frequency", F.coalesce("frequency", F.lit(0)))
    best = df.groupBy("research_id", query_key(F.col("query")).alias("query_key")).agg(F.max(F.struct("frequency", (-F.col("id")).alias("m"), "id", "query", "source")).alias("b"))
    return best.select("research_id", "query_key", F.col("b.id").alias("id"), F.col("b.query").alias("query"), F.col("b.frequency").alias("frequency"), F.col("b.source").alias("source"))


def update_seed_frequencies(queries: DataFrame, totals: DataFrame) -> DataFrame:
    """Seeds of ``queries`` take the total (query, frequency) of the same text, if it is above 0."""
    t = totals.where("frequency > 0").groupBy(query_key(F.col("query")).alias("k_")).agg(F.max("frequency").alias("f_"))
    df = queries.join(t, query_key(queries["query"]) == F.col("k_"), "left")
    return df.withColumn("frequency", F.when(F.col("source") == "seed", F.coalesce("f_", "frequency")).otherwise(F.col("frequency"))).drop("k_", "f_")


def cleanup_flags(queries: DataFrame) -> DataFrame:
    """queries with flag (danger, warn, neutral) and its reason, the first that holds."""
    q, f = F.lower("query"), F.coalesce("frequency", F.lit(0))
    words = F.size(F.filter(F.split(q, r"\s+"), lambda x: x != ""))
    #: Bounds, and patterns of versions and years, and what excuses them.
    version = q.rlike(r"(?:^|[^a-z0-9_])(?:v?\d+(?:\.\d+){1,3}|202\d|203\d)(?:[^a-z0-9_]|$)")
    rules = [
        (f < 10, "danger", "low_frequency"),
        (contains_any(q, STOP), "danger", "stop_word"),
        (words > 7, "danger", "too_long"),
        (version & ~q.rlike("44-фз|окпд|оквэд|seo|бот|google|яндекс"), "danger", "version_or_year"),
        (f > 50000, "warn", "too_general"),
        (contains_any(q, BRANDS), "warn", "competitor_brand"),
        (q.rlike("[a-z]{4,}") & ~q.rlike("seo|ssr|csr|bot|render|react|next|google|index"), "warn", "latin"),
    ]
    flag = reason = F.when(F.lit(False), "")
    for cond, level, why in rules:
        flag, reason = flag.when(cond, level), reason.when(cond, why)
    return queries.withColumn("flag", flag.otherwise("neutral")).withColumn("flag_reason", reason.otherwise("neutral"))


def classify_queries(queries: DataFrame) -> DataFrame:
    """queries with type, destination and relevance."""
    q = F.lower("query")
    #: Words that tell a query's type, where it goes and how relevant it is.
    cases = [
        (q.rlike("проверить|чекер|симулятор|анализатор|проверка|tool|checker"), "instrumental", "tool", 9),
        (q.rlike("ошибка|не индекс|не открыва|не работает|упал|404|500|бот"), "symptom", "blog", 8),
        (q.rlike(r"react|next|csr|ssr|canonical|robots|schema|googlebot|llms\.txt"), "technical", "blog", 8),
    ]
    kind, to, score = (F.when(F.lit(False), F.lit(v)) for v in ("", "", 0))
    for cond, a, b, c in cases:
        kind, to, score = kind.when(cond, a), to.when(cond, b), score.when(cond, c)
    bad = contains_any(q, STOP)
    return queries.withColumns({"type": kind.otherwise("informational"), "destination": F.when(bad, "deleted").otherwise(to.otherwise("blog")), "relevance": F.when(bad, 1).otherwise(score.otherwise(6))})


def apply_classification(queries: DataFrame, classes: DataFrame) -> DataFrame:
    """New type, destination and relevance for queries that are not deleted; others keep theirs. Clusters are reset."""
    fields = ["type", "destination", "relevance"]
    c = classes.groupBy(query_key(F.col("query")).alias("k_")).agg(*[F.max(f).alias(f"n_{f}") for f in fields])
    df = queries.join(c, query_key(queries["query"]) == F.col("k_"), "left")
    kept = F.col("destination").eqNullSafe("deleted")
    new = {f: F.when(kept, F.col(f)).otherwise(F.coalesce(f"n_{f}", f)) for f in fields}
    return df.withColumns(new | {"cluster_id": F.lit(None).cast("string")}).drop("k_", *[f"n_{f}" for f in fields])


def cluster_key(research: Column, main: Column) -> Column:
    return F.sha2(F.concat_ws("|", research.cast("string"), main), 256)


def cluster_queries(queries: DataFrame) -> DataFrame:
    """id, research_id, cluster_id, main_query: greedy leader clusters, a research in a task.

    Queries come by frequency, then text, then id; each joins the first leader with token Jaccard of a half or more,
    else it leads. For small researches, and to hold ``cluster_queries_distributed``, which serves all sizes, against.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["frequency", "query", "id"], ascending=[False, True, True], kind="stable")
        leaders: list[tuple[frozenset, str]] = []
        by_token: dict[str, list[int]] = {}
        main = []
        for query, tokens in zip(part["query"], part["tokens"], strict=True):
            own = frozenset(tokens)
            near = sorted({i for t in own for i in by_token.get(t, ())})
            hit = next((i for i in near if 2 * len(own & leaders[i][0]) >= len(own | leaders[i][0])), None)
            if hit is None:
                hit = len(leaders)
                leaders.append((own, query))
                for t in own:
                    by_token.setdefault(t, []).append(hit)
            main.append(leaders[hit][1])
        return part.assign(main_query=main)[["id", "research_id", "query", "frequency", "main_query"]]

    df = queries.select("id", "research_id", "query", F.coalesce("frequency", F.lit(0)).cast("bigint").alias("frequency"), query_tokens(F.col("query")).alias("tokens"))
    out = df.groupBy("research_id").applyInPandas(run, "id bigint, research_id string, query string, frequency bigint, main_query string")
    return out.withColumn("cluster_id", cluster_key(F.col("research_id"), F.col("main_query")))


def cluster_queries_distributed(queries: DataFrame) -> DataFrame:
    """The same clusters by rounds over pairs of similar queries, for researches of any size.

    Queries of the same tokens go as one, the first of them. Two sets of which half is common share one of each side's
    first n - ceil(n / 2) + 1 tokens, the rarest of the research first, so frequent tokens bring few together. In each round an undecided query
    without an earlier undecided or leading neighbour becomes a leader; one with an earlier leading neighbour becomes its member.
    A query without tokens leads itself.
    """
    df = queries.select("id", "research_id", "query", F.coalesce("frequency", F.lit(0)).cast("bigint").alias("frequency"), F.array_sort(F.array_distinct(query_tokens(F.col("query")))).alias("tokens"))
    df = settled(fenced(df).withColumn("rank", F.struct((-F.col("frequency")).alias("f"), "query", "id")))
    sets = settled(df.where("size(tokens) > 0").groupBy("research_id", "tokens").agg(F.min("rank").alias("rank")).withColumn("id", F.col("rank.id")))
    each = sets.select("research_id", "id", F.explode("tokens").alias("t"))
    common = each.groupBy("research_id", "t").agg(F.count(F.lit(1)).alias("df"))
    rarest = each.join(common, ["research_id", "t"]).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("by"))
    first = F.slice("by", F.lit(1), F.size("by") - F.ceil(F.size("by") / 2).cast("int") + 1)
    held = sets.join(rarest, "id").select("research_id", "id", "rank", "tokens", F.explode(F.transform(first, lambda x: x.t)).alias("t"))
    pairs = held.alias("a").join(held.alias("b"), F.expr("a.research_id = b.research_id AND a.t = b.t AND a.rank < b.rank AND 2 * size(array_intersect(a.tokens, b.tokens)) >= size(array_union(a.tokens, b.tokens))"))
    near = settled(pairs.groupBy(F.col("a.id").alias("low"), F.col("b.id").alias("high")).agg(F.first("a.rank").alias("low_rank")))
    state = settled(sets.select("id", F.lit("undecided").alias("state"), F.lit(None).cast("bigint").alias("leader")))
    while state.where("state = 'undecided'").limit(1).count():
        seen = near.join(state.select(F.col("id").alias("low"), F.col("state").alias("low_state")), "low").where("low_state <> 'member'")
        found = seen.groupBy("high").agg(F.min(F.when(F.col("low_state") == "leader", F.struct("low_rank", "low"))).alias("l"), F.min(F.when(F.col("low_state") == "undecided", F.col("low_rank"))).alias("u"))
        now = state.join(found, state["id"] == found["high"], "left")
        # A leading neighbour settles a query once no earlier one is open.
        ready = F.col("l").isNotNull() & (F.col("u").isNull() | (F.col("l.low_rank") < F.col("u")))
        new = F.when(F.col("state") != "undecided", F.col("state")).when(ready, "member").when(F.col("l").isNull() & F.col("u").isNull(), "leader").otherwise("undecided")
        state = settled(now.select("id", new.alias("state"), F.when((F.col("state") == "undecided") & ready, F.col("l.low")).otherwise(F.col("leader")).alias("leader")))
    leads = sets.join(state, "id").select("research_id", "tokens", F.coalesce("leader", "id").alias("lead_id"))
    mains = df.select(F.col("id").alias("lead_id"), F.col("query").alias("main_query"))
    out = df.join(leads.join(mains, "lead_id"), ["research_id", "tokens"], "left").withColumn("main_query", F.coalesce("main_query", "query"))
    return out.select("id", "research_id", "query", "frequency", "main_query", cluster_key(F.col("research_id"), F.col("main_query")).alias("cluster_id"))


def cluster_totals(members: DataFrame) -> DataFrame:
    return members.groupBy("research_id", "cluster_id", "main_query").agg(F.sum("frequency").alias("total_frequency"), F.count(F.lit(1)).alias("queries_count"))


def tool_queries(queries: DataFrame, secondary: int = 12) -> DataFrame:
    """research_id, main (the top query for a tool, else the first of all) and the next ones."""
    tool = (F.col("destination") == "tool").cast("int")
    place = F.row_number().over(Window.partitionBy("research_id").orderBy(F.desc(tool), F.desc("frequency"), "id"))
    top = queries.withColumn("place", place).where((F.col("place") == 1) | ((F.col("destination") == "tool") & (F.col("place") <= secondary + 1)))
    lists = top.groupBy("research_id").agg(F.sort_array(F.collect_list(F.struct("place", "query"))).alias("l"))
    return lists.select("research_id", F.get("l", F.lit(0)).query.alias("main_query"), F.transform(F.slice("l", 2, secondary), lambda x: x.query).alias("secondary_queries"))


def content_plan(clusters: DataFrame, tools: DataFrame, members: DataFrame, listed: int = 12) -> DataFrame:
    """A tool page for each research and an article for each cluster, with target url and queries."""
    ordered = members.withColumn("place", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("frequency"), "query"))).where(F.col("place") <= listed)
    lists = ordered.groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("place", "query"))).alias("l")).select("cluster_id", F.transform("l", lambda x: x.query).alias("queries"))
    articles = clusters.join(lists, "cluster_id", "left").select(
        "research_id", F.lit("blog_article").alias("type"), F.col("main_query").alias("title"), F.concat(F.lit("/blog/"), slugify(F.col("main_query")), F.lit("/")).alias("target_url"), "total_frequency", "queries"
    )
    pages = tools.select("research_id", F.lit("tool_page").alias("type"), F.col("main_query").alias("title"), F.concat(F.lit("/tools/"), slugify(F.col("main_query")), F.lit("/")).alias("target_url"), F.lit(None).cast("bigint").alias("total_frequency"), F.col("secondary_queries").alias("queries"))
    return articles.unionByName(pages)


#: Titles and descriptions of drafts, by their type, and the query of a tool page without one of its own.
DRAFTS = {
    "tool_page": ("{q} — проверка и решение", "Проверьте запрос «{q}» через инструмент и найдите причину проблемы."),
    "blog_article": ("{q}: что проверить и как исправить", "Разбираем запрос «{q}»: причины, диагностика и пошаговые действия."),
}
NO_TOOL_QUERY = "seo инструмент"


def plan_drafts(research: DataFrame, clusters: DataFrame, tools: DataFrame, members: DataFrame, listed: int = 12) -> DataFrame:
    """A draft for the tool page of each research (research_id, url) and one for each of its clusters, with title, description, target and a whole brief.

    A tool page stands at the path of the research's url, an article at the slug of its query; both link to the research.
    """
    ordered = members.withColumn("place", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("frequency"), "query"))).where(F.col("place") <= listed)
    lists = ordered.groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("place", "query"))).alias("l")).select("cluster_id", F.transform("l", lambda x: x.query).alias("secondary_queries"))
    none = F.array().cast("array<string>")
    articles = clusters.join(lists, "cluster_id", "left").select("research_id", "cluster_id", F.lit("blog_article").alias("type"), "main_query", F.coalesce("secondary_queries", none).alias("secondary_queries"))
    pages = research.select("research_id").join(tools, "research_id", "left").select("research_id", F.lit(None).cast("string").alias("cluster_id"), F.lit("tool_page").alias("type"), F.coalesce("main_query", F.lit(NO_TOOL_QUERY)).alias("main_query"), F.coalesce("secondary_queries", none).alias("secondary_queries"))
    rows = articles.withColumn("cluster_id", F.col("cluster_id").cast("string")).unionByName(pages).join(research.select("research_id", F.col("url").alias("source_url")), "research_id")
    spelled = F.concat(F.upper(F.substring("main_query", 1, 1)), F.expr("substring(main_query, 2)"))
    filled = lambda text, q: F.replace(F.lit(text), F.lit("{q}"), q)
    by_type = lambda k, q: F.when(F.col("type") == "tool_page", filled(DRAFTS["tool_page"][k], q)).otherwise(filled(DRAFTS["blog_article"][k], q))
    at = F.when(path(F.col("source_url")) == "", "/").otherwise(path(F.col("source_url")))
    target = F.when(F.col("type") == "tool_page", at).otherwise(F.concat(F.lit("/blog/"), slugify(F.col("main_query")), F.lit("/")))
    rows = rows.withColumns({"target_url": target, "title": by_type(0, spelled), "description": by_type(1, F.col("main_query")), "linking_hints": F.array("source_url")})
    return complete_briefs(rows)


def replace_partition(existing: DataFrame, new: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``existing`` without the researches of ``new``, and ``new``."""
    keys = keys or ["research_id"]
    return existing.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def list_research(research: DataFrame, queries: DataFrame, n: int = 50) -> DataFrame:
    """The newest researches (id, created_at, ...) with their number of queries."""
    counts = queries.groupBy("research_id").agg(F.count("id").alias("queries_count"))
    df = research.join(counts, research["id"] == counts["research_id"], "left").drop("research_id")
    return df.withColumn("queries_count", F.coalesce("queries_count", F.lit(0))).orderBy(F.desc("created_at"), "id").limit(n)


def list_content_plan(plan: DataFrame, status: str | None = None, kind: str | None = None) -> DataFrame:
    """The plan by date (none last), frequency (none first) and age."""
    if status:
        plan = plan.where(F.col("status") == status)
    if kind:
        plan = plan.where(F.col("type") == kind)
    return plan.orderBy(F.asc_nulls_last("planned_date"), F.desc_nulls_first("total_frequency"), F.desc("updated_at"))


def research_board(queries: DataFrame, min_relevance: int = 0, flag: str | None = None, text: str | None = None) -> DataFrame:
    """For each research and destination how many queries are shown, and of which source."""
    df = queries.where(~F.col("destination").eqNullSafe("deleted") & (F.coalesce("relevance", F.lit(10)) >= min_relevance))
    if flag:
        df = df.where(F.col("flag") == flag)
    if text:
        df = df.where(F.lower("query").contains(text.lower()))
    seed = F.col("source") == "seed"
    return df.groupBy("research_id", F.coalesce("destination", F.lit("unclear")).alias("destination")).agg(F.count(F.lit(1)).alias("shown"), F.count_if(seed).alias("seeds"), F.count_if(~seed).alias("expanded"), F.count_if(seed & (F.col("frequency") > 0)).alias("seeds_with_frequency"))


def normalize_brief(items: Column, most: int = 20) -> Column:
    """A list of phrases: trimmed, blanks collapsed, first spelling of each, ``most`` at most."""
    clean = F.filter(F.transform(items, collapse), lambda x: x != "")
    lowered = F.transform(clean, F.lower)
    return F.slice(F.filter(clean, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1), 1, most)


def clamp(c: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


#: Blocks, outline, schema types and settings of a brief by preset.
BRIEFS = {
    "tool_page": {
        "required_blocks": ["Что проверяет инструмент", "Когда использовать", "Как работает проверка", "Пошаговый сценарий", "Частые ошибки", "FAQ", "CTA"],
        "article_outline": ["Что проверяет инструмент", "Когда использовать", "Как запустить проверку", "Как интерпретировать результат", "Типовые ошибки", "FAQ", "Вывод и CTA"],
        "schema_types": ["FAQPage", "BreadcrumbList"],
        "settings": {"tone": "practical", "goal": "leads", "include_faq": True, "include_table": False, "include_lists": True, "include_examples": True, "include_cta": True, "min_words": 1800, "max_words": 2800},
    },
    "blog_article": {
        "required_blocks": ["Что это", "Когда возникает проблема", "Как проверить", "Как исправить", "Частые ошибки", "FAQ", "Вывод"],
        "article_outline": ["Что это", "Почему возникает проблема", "Как проверить", "Как исправить", "Частые ошибки", "FAQ", "Вывод и CTA"],
        "schema_types": ["Article", "FAQPage", "BreadcrumbList"],
        "settings": {"tone": "expert", "goal": "ranking", "include_faq": True, "include_table": True, "include_lists": True, "include_examples": True, "include_cta": True, "min_words": 2500, "max_words": 4000},
    },
}
#: What settings may say, and the bounds of their numbers.
CHOICES = {"preset": ["tool_page", "blog_article"], "tone": ["expert", "practical", "business", "simple"], "goal": ["ranking", "leads", "explain", "compare"]}
WORDS = {"min_words": (500, 10_000), "max_words": (800, 15_000)}
_LISTS = ["secondary_queries", "required_blocks", "article_outline", "faq_items", "schema_types", "linking_hints"]


def complete_briefs(plans: DataFrame) -> DataFrame:
    """plans (type, lists of phrases, notes, preset, tone, goal, include_..., min_words, max_words) made whole.

    Missing columns count as null. Empty blocks, outline and schema types take the preset's of the plan's type, settings those
    of the preset they name; unknown words fall back, numbers are clamped, notes are cut at 4,000 characters.
    """
    have = dict(plans.dtypes)
    given = lambda c, kind: F.col(c) if c in have else F.lit(None).cast(kind)
    by_kind = F.when(F.col("type") == "tool_page", "tool_page").otherwise("blog_article")
    named = F.when(given("preset", "string").isin(*CHOICES["preset"]), given("preset", "string")).otherwise(by_kind)
    pick = lambda preset, get: F.when(preset == "tool_page", get(BRIEFS["tool_page"])).otherwise(get(BRIEFS["blog_article"]))
    out = {"preset": named, "notes": F.substring(F.trim(F.coalesce(given("notes", "string"), F.lit(""))), 1, 4000)}
    for c in _LISTS:
        clean = F.coalesce(normalize_brief(given(c, "array<string>")), F.array().cast("array<string>"))
        fallback = pick(by_kind, lambda b, c=c: F.array(*map(F.lit, b[c]))) if c in BRIEFS["tool_page"] else clean
        out[c] = F.when(F.size(clean) > 0, clean).otherwise(fallback)
    for c, default in BRIEFS["tool_page"]["settings"].items():
        kind = {bool: "boolean", int: "int", str: "string"}[type(default)]
        fallback, own = pick(named, lambda b, c=c: F.lit(b["settings"][c])), given(c, kind)
        own = F.when(own.isin(*CHOICES[c]), own) if c in CHOICES else clamp(own, *WORDS[c]) if c in WORDS else own
        out[c] = F.when(given(c, kind).isNull(), fallback).otherwise(F.coalesce(own, fallback))
    return plans.withColumns(out)
