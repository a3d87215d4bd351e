"""May a page be indexed? robots.txt, meta robots, canonical and sitemap membership as joins and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlsmith.functions import html as H
from crawlsmith.functions.frames import settled
from crawlsmith.functions.urls import compare_key, path_and_query


def robots_lines(robots: DataFrame) -> DataFrame:
    """site, pos, field, value of each line with a field; comments and blanks are gone."""
    lines = robots.select("site", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("pos", "line"))
    lines = lines.withColumn("line", F.trim(F.split("line", "#")[0])).where(F.col("line").contains(":"))
    return lines.select("site", "pos", F.lower(F.trim(F.split("line", ":")[0])).alias("field"), F.trim(F.regexp_replace("line", r"^[^:]*:", "")).alias("value"))


def parse_robots(robots: DataFrame) -> DataFrame:
    """site, group_no, kind (agent or rule), no, directive, value.

    An agent line after a rule opens a group; rules before any agent are dropped; other fields change nothing.
    """
    by = Window.partitionBy("site").orderBy("pos")
    lines = robots_lines(robots).where(F.col("field").isin("user-agent", "allow", "disallow")).withColumn("agent", F.col("field") == "user-agent")
    opens = F.col("agent") & ~F.coalesce(F.lag("agent").over(by), F.lit(False))
    lines = lines.withColumn("group_no", F.sum(opens.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))).where("group_no > 0")
    return lines.select("site", "group_no", F.col("pos").alias("no"), F.col("field").alias("directive"), F.when(F.col("agent"), F.lower("value")).otherwise(F.col("value")).alias("value"))


def match_robots_group(rules: DataFrame, agent: str = "googlebot") -> DataFrame:
    """The one group of each site for ``agent``: an exact name, else the longest prefix of it, else *; first wins."""
    name = F.col("value")
    score = F.when(name == agent, 100).when(name == "*", 1).when(F.lit(agent).startswith(name), F.length(name)).otherwise(-1)
    agents = rules.where("directive = 'user-agent'").withColumn("score", score).where("score > -1")
    best = agents.groupBy("site").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("no"), F.col("group_no"), F.col("value"))).alias("m"))
    return best.select("site", F.col("m.group_no").alias("group_no"), F.col("m.value").alias("matched_agent"))


def evaluate_robots(pages: DataFrame, rules: DataFrame, agent: str = "googlebot") -> DataFrame:
    """pages (url, site) with allowed and the rule that decides: the longest prefix, allow before disallow.

    The chosen group of a site is one row with an array of its rules, so a page is not multiplied by them.
    """
    chosen = rules.join(match_robots_group(rules, agent), ["site", "group_no"]).where("directive <> 'user-agent' AND NOT (directive = 'disallow' AND value = '')")
    per_site = chosen.groupBy("site").agg(F.collect_list(F.struct("value", "directive", "no")).alias("rules_"))
    hit = lambda r: F.col("target_").startswith(r.value)
    order = lambda r: F.struct(F.length(r.value).alias("n"), (r.directive == "allow").alias("a"), (-r.no).alias("k"), r.directive.alias("directive"), r.value.alias("value"))
    df = pages.withColumn("target_", path_and_query(F.col("url"))).join(per_site, "site", "left")
    df = df.withColumn("best_", F.array_max(F.transform(F.filter("rules_", hit), order)))
    df = df.withColumn("robots_allowed", F.coalesce(F.col("best_.directive") != "disallow", F.lit(True)))
    return df.withColumn("robots_rule", F.concat("best_.directive", F.lit(": "), "best_.value")).drop("target_", "rules_", "best_")


def root_blocked(robots: DataFrame) -> DataFrame:
    """site, blocked: whether "Disallow: /" stands while the agent * is current; other fields end the agents."""
    by = Window.partitionBy("site").orderBy("pos")
    lines = robots_lines(robots)
    lines = lines.withColumn("other", ~F.col("field").isin("user-agent", "allow", "disallow"))
    before = F.coalesce(F.lag("field").over(by), F.lit(""))
    opens = F.col("other") | ((F.col("field") == "user-agent") & (before != "user-agent"))
    lines = lines.withColumn("part", F.sum(opens.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    star = F.max((F.col("field") == "user-agent") & (F.col("value") == "*")).over(Window.partitionBy("site", "part"))
    hit = (F.col("field") == "disallow") & (F.col("value") == "/") & star
    return lines.withColumn("hit", hit).groupBy("site").agg(F.max("hit").alias("blocked"))


def pages_in_sitemap(pages: DataFrame, sitemap_urls: DataFrame) -> DataFrame:
    """pages (url, site) with in_sitemap and the number of the site's sitemap urls.

    Both sides are keyed by site and page, so that a large site is spread over the cluster.
    """
    listed = sitemap_urls.select("site", compare_key(F.col("loc")).alias("key_")).distinct().withColumn("in_", F.lit(True))
    counts = sitemap_urls.groupBy("site").agg(F.count(F.lit(1)).alias("sitemap_urls"))
    df = pages.withColumn("key_", compare_key(F.col("url"))).join(listed, ["site", "key_"], "left").join(counts, "site", "left")
    return df.withColumn("in_sitemap", F.coalesce("in_", F.lit(False))).withColumn("sitemap_urls", F.coalesce("sitemap_urls", F.lit(0))).drop("in_", "key_")


def index_signals(pages: DataFrame) -> DataFrame:
    """pages (url, html) with meta_robots, canonical, canonical_self and noindex."""
    metas = F.filter(H.tags(F.col("html"), "meta"), lambda t: F.lower(F.trim(H.attribute(t, "name"))).isin("robots", "googlebot", "yandexbot") & (H.attribute(t, "content") != ""))
    text = F.array_join(F.transform(metas, lambda t: F.concat(F.lower(F.trim(H.attribute(t, "name"))), F.lit(": "), F.trim(H.attribute(t, "content")))), "; ")
    df = pages.withColumn("meta_robots", F.nullif(text, F.lit(""))).withColumn("canonical", F.nullif(H.canonical(F.col("html")), F.lit("")))
    lowered = F.lower("meta_robots")
    df = df.withColumn("noindex", F.coalesce(lowered.contains("noindex") | lowered.contains("none"), F.lit(False)))
    own = F.when(F.col("canonical").rlike("^https?://"), F.col("canonical"))
    return df.withColumn("canonical_self", F.when(F.col("canonical").isNotNull(), F.coalesce(compare_key(own) == compare_key(F.col("url")), F.lit(False))))


def index_verdict(df: DataFrame) -> DataFrame:
    """Reasons and verdict from http_ok, noindex, robots_allowed and in_sitemap."""
    flags = {"http_not_ok": ~F.col("http_ok"), "noindex_detected": F.col("noindex"), "blocked_by_robots": ~F.col("robots_allowed"), "not_in_sitemap": ~F.col("in_sitemap")}
    reasons = F.array_compact(F.array(*[F.when(c, name) for name, c in flags.items()]))
    hard = ~F.col("http_ok") | F.col("noindex") | ~F.col("robots_allowed")
    return df.withColumn("reasons", reasons).withColumn("verdict", F.when(hard, "fail").when(~F.col("in_sitemap"), "warn").otherwise("ok"))


def redirect_chains(hops: DataFrame, most: int = 5) -> DataFrame:
    """start, final_url, first_target and the chain of hops of each url that redirects.

    Follows hops by a join a step, ``most`` at most; a hop to itself or a url without a hop ends the chain.
    """
    step = hops.select(F.col("from_url").alias("at_"), F.struct("from_url", "to_url", "status").alias("hop_"))
    chains = hops.select(F.col("from_url").alias("start"), F.col("to_url").alias("final_url"), F.array(F.struct("from_url", "to_url", "status")).alias("chain"), (F.col("from_url") != F.col("to_url")).alias("open_"))
    for _ in range(most - 1):
        chains = chains.join(step, (F.col("final_url") == F.col("at_")) & F.col("open_"), "left")
        chains = chains.select(
            "start",
            F.coalesce("hop_.to_url", "final_url").alias("final_url"),
            F.when(F.col("hop_").isNotNull(), F.array_append("chain", F.col("hop_"))).otherwise(F.col("chain")).alias("chain"),
            (F.col("hop_").isNotNull() & (F.col("hop_.to_url") != F.col("hop_.from_url"))).alias("open_"),
        )
    return chains.select("start", "final_url", F.get("chain", F.lit(0)).to_url.alias("first_target"), F.size("chain").alias("hops"), "chain")


def expand_sitemaps(files: DataFrame, roots: DataFrame, max_files: int | None = None, max_urls: int | None = None) -> DataFrame:
    """site, loc, lastmod, root_kind, truncated_by_files and truncated_by_urls of all url rows reachable from ``roots`` (site, file), whatever their depth.

    ``files`` has a row for each entry of a sitemap file: file, kind (index or url), loc, lastmod, and pos where its order is known. A file is
    followed once for each site, so cycles end; a level of nesting is a join, and its files are settled before the next. root_kind is
    index if any entry of the site's root is one.

    By default nothing is left out. With bounds a site's files are taken level by level, in the order of the entries that name them, and
    its urls in the order of its files and entries; what a level uses of the bound is carried to the next, and the flags tell which sites lost some.
    """
    if "pos" not in files.columns:
        files = files.withColumn("pos", F.lit(0))
    place = lambda *order: F.row_number().over(Window.partitionBy("site").orderBy(*order))
    first = roots.select("site", "file").distinct().withColumn("place", place("file") if max_files is not None else F.lit(1))
    frontier = settled(first.withColumn("level", F.lit(0)).where("true" if max_files is None else f"place <= {max_files}"))
    cut = first.where(f"place > {max_files}").select("site") if max_files is not None else None
    seen = frontier
    root_kind = frontier.join(files, "file").groupBy("site").agg(F.min("kind").alias("root_kind"))
    level = 0
    while True:
        level += 1
        entries = frontier.select("site", "file", F.col("place").alias("above_")).join(files.where("kind = 'index'"), "file")
        nested = entries.groupBy("site", F.col("loc").alias("file")).agg(F.min(F.struct("above_", "pos")).alias("order_")).join(seen.select("site", "file"), ["site", "file"], "left_anti")
        if max_files is None:
            frontier = settled(nested.select("site", "file", F.lit(1).alias("place"), F.lit(level).alias("level")))
        else:
            # One more than the bound tells that there is more; a window keeps no more rows of a site.
            used = seen.groupBy("site").agg(F.count(F.lit(1)).alias("used_"))
            ranked = settled(nested.withColumn("place", place("order_", "file")).where(f"place <= {max_files} + 1").join(used, "site").withColumn("fits_", F.col("place") + F.col("used_") <= max_files))
            cut = cut.union(ranked.where("NOT fits_").select("site"))
            frontier = settled(ranked.where("fits_").select("site", "file", "place", F.lit(level).alias("level")))
        if not frontier.limit(1).count():
            break
        seen = settled(seen.union(frontier))
    urls = files.where("kind = 'url'")
    rows = seen.join(urls, "file").join(root_kind, "site")
    flag = lambda df, name: df.distinct().withColumn(name, F.lit(True))
    if max_urls is not None:
        # Sums over files, which are few, give where each file's urls begin; only within a file are urls counted one by one.
        counts = seen.join(urls.groupBy("file").agg(F.count(F.lit(1)).alias("n_")), "file")
        before = F.sum("n_").over(Window.partitionBy("site").orderBy("level", "place", "file").rowsBetween(Window.unboundedPreceding, -1))
        starts = settled(counts.withColumn("before_", F.coalesce(before, F.lit(0))).select("site", "file", "before_", "n_"))
        within = F.row_number().over(Window.partitionBy("site", "file").orderBy("pos", "loc", "lastmod"))
        rows = rows.join(starts.where(f"before_ < {max_urls}"), ["site", "file"]).withColumn("within_", within).where(f"before_ + within_ <= {max_urls}")
        rows = rows.join(flag(starts.where(f"before_ + n_ > {max_urls}").select("site"), "truncated_by_urls"), "site", "left")
    else:
        rows = rows.withColumn("truncated_by_urls", F.lit(False))
    rows = rows.join(flag(cut, "truncated_by_files"), "site", "left") if cut is not None else rows.withColumn("truncated_by_files", F.lit(False))
    return rows.select("site", "loc", "lastmod", "root_kind", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("truncated_by_files", "truncated_by_urls")])


def robots_home_blocked(robots_rules: DataFrame, sites: DataFrame, agents: list[str]) -> DataFrame:
    """The first of ``agents``, in order, that may not fetch a site's home page; null if all may."""
    pages = sites.select("site", F.concat(F.lit("https://"), "site", F.lit("/")).alias("url"))
    found = None
    for k, agent in enumerate(agents):  # a fixed short list; each pass reads the rules of one group a site
        part = evaluate_robots(pages, robots_rules, agent).where("NOT robots_allowed").select("site", F.struct(F.lit(k).alias("k"), F.lit(agent).alias("agent")).alias("a"))
        found = part if found is None else found.union(part)
    return sites.select("site").join(found.groupBy("site").agg(F.min("a").alias("a")), "site", "left").select("site", F.col("a.agent").alias("first_blocked"))
