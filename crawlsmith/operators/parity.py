"""Do robots see the page that a browser sees? Snapshots by agent to reasons, rules and cards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlsmith.functions import html as H

AGENTS = ["browser", "google", "yandex"]
FEATURES = ["http_code", "text_len", "links_count", "has_h1", "has_title", "access_state"]
SEVERITIES = ["critical", "high", "medium", "low", "info"]


def snapshot_features(snapshots: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """A narrow row for each snapshot, of its whole body, which is dropped before anything is shuffled. Columns named in ``keep`` are passed on."""
    body = F.col("body")
    df = snapshots.withColumn("text_", H.visible_text(body)).withColumn("links_", F.size(H.links(body)))
    anchors = F.size(H.tags(body, "a"))
    return df.select(
        "url", "agent", "http_code",
        F.coalesce(F.octet_length("body"), F.lit(0)).alias("size_bytes"),
        F.coalesce(F.length("text_"), F.lit(0)).alias("text_len"),
        F.when(F.col("body").isNull(), 0).otherwise(F.col("links_")).alias("links_count"),
        F.when(F.col("body").isNull(), 0).otherwise(anchors).alias("anchor_tags_count"),
        F.col("body").rlike(r"(?i)<h1[\s>/]").alias("has_h1"),
        F.col("body").rlike(r"(?i)<title[\s>/]").alias("has_title"),
        H.access_state(F.col("text_")).alias("access_state"),
        H.access_match(F.col("text_")).alias("access_match"), *keep,
    )


def agent_pivot(features: DataFrame, agents: list[str] = AGENTS, by: str | None = None) -> DataFrame:
    """A row for each url with a struct for each agent; values of the agents are given, so no job looks for them.

    Where several rows share a url and agent, each feature is the first that is not null, in the order of the column ``by``
    (of all features, without it), so that reruns agree.
    """
    order = F.col(by) if by else F.struct(*FEATURES)
    first = lambda c, a: F.min_by(c, F.when((F.col("agent") == a) & F.col(c).isNotNull(), order)).alias(c)
    return features.groupBy("url").agg(*[F.struct(*[first(c, a) for c in FEATURES]).alias(a) for a in agents])


def ratio(a: Column, b: Column) -> Column:
    a, b = F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(0))
    return F.abs(a - b) / F.greatest(a, b, F.lit(1))


def _kept(flags: list[tuple[Column, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), value) for cond, value in flags]))


def parity_verdict(pivot: DataFrame) -> DataFrame:
    """Reasons for which a bot is served another page; null and false flags differ."""
    flags: list[tuple[Column, Column]] = []
    for a in ("browser", "yandex", "google"):
        s = F.col(a)
        code = F.coalesce(s.http_code.cast("string"), F.lit("None"))
        flags.append((~s.http_code.eqNullSafe(200), F.concat(F.lit(f"{a}: http_code="), code)))
        flags.append((s.access_state != "ok", F.concat(F.lit(f"{a}: access="), s.access_state)))
    b = F.col("browser")
    for a in ("yandex", "google"):
        s = F.col(a)
        flags += [
            (ratio(b.text_len, s.text_len) > 0.3, F.lit(f"{a}: text_diff")),
            (F.abs(F.coalesce(b.links_count, F.lit(0)) - F.coalesce(s.links_count, F.lit(0))) > 10, F.lit(f"{a}: links_diff")),
            (~b.has_h1.eqNullSafe(s.has_h1), F.lit(f"{a}: h1_diff")),
            (~b.has_title.eqNullSafe(s.has_title), F.lit(f"{a}: title_diff")),
        ]
    return pivot.withColumn("reasons", _kept(flags)).withColumn("verdict", F.when(F.size("reasons") == 0, "ok").otherwise("mismatch"))


def parity_rules(pivot: DataFrame) -> DataFrame:
    """The rules that hold, in order; the first of the highest severity is on top."""
    b, g, y = (F.col(a) for a in AGENTS)
    n = lambda c: F.coalesce(c, F.lit(0))
    t = {k: n(s.text_len) for k, s in zip("bgy", (b, g, y), strict=True)}
    links = {k: n(s.links_count) for k, s in zip("bgy", (b, g, y), strict=True)}
    code = {k: n(s.http_code) for k, s in zip("bgy", (b, g, y), strict=True)}
    h1 = {k: F.coalesce(s.has_h1, F.lit(False)) for k, s in zip("bgy", (b, g, y), strict=True)}
    title = {k: F.coalesce(s.has_title, F.lit(False)) for k, s in zip("bgy", (b, g, y), strict=True)}
    bad = lambda s, k: ~s.access_state.eqNullSafe("ok") | (code[k] >= 400)
    empty = {k: (t[k] < 50) & (links[k] == 0) for k in "bgy"}
    d = lambda of, i, j: ratio(of[i], of[j])
    rules = [
        ("R002", "critical", bad(b, "b")),
        ("R003", "critical", bad(g, "g")),
        ("R004", "critical", bad(y, "y")),
        ("R005", "critical", ~b.http_code.eqNullSafe(g.http_code) | ~b.http_code.eqNullSafe(y.http_code)),
        ("R101", "medium", empty["b"] & (~empty["g"] | ~empty["y"])),
        ("R102", "critical", ~empty["b"] & (empty["g"] | empty["y"])),
        ("R103", "high", empty["b"] & empty["g"] & empty["y"]),
        ("R104", "high", t["b"] < 0.3 * F.greatest(t["g"], t["y"], F.lit(1))),
        ("R105", "critical", t["g"] < 0.3 * F.greatest(t["b"], F.lit(1))),
        ("R106", "critical", t["y"] < 0.3 * F.greatest(t["b"], F.lit(1))),
        ("R107", "high", d(t, "g", "y") > 0.3),
        ("R201", "high", ~title["b"] & ~title["g"] & ~title["y"]),
        ("R202", "critical", title["b"] & (~title["g"] | ~title["y"])),
        ("R204", "medium", ~h1["b"] & ~h1["g"] & ~h1["y"]),
        ("R205", "high", ~h1["b"] & (h1["g"] | h1["y"])),
        ("R206", "critical", h1["b"] & (~h1["g"] | ~h1["y"])),
        ("R301", "high", (links["b"] == 0) & ((links["g"] > 0) | (links["y"] > 0))),
        ("R302", "critical", (links["b"] > 0) & ((links["g"] == 0) | (links["y"] == 0))),
        ("R303", "medium", (d(links, "b", "g") > 0.5) | (d(links, "b", "y") > 0.5)),
        ("R304", "medium", d(links, "g", "y") > 0.5),
        ("R701", "high", (code["b"] == 200) & (t["b"] < 30) & (links["b"] < 2)),
        ("R702", "medium", (F.greatest(*t.values()) < 150) & ~(empty["b"] & empty["g"] & empty["y"])),
        ("R703", "high", reduce(lambda p, q: p | q, title.values()) & (F.greatest(*t.values()) < 50) & (F.greatest(*links.values()) == 0)),
        ("R601", "critical", ~empty["b"] & empty["g"] & empty["y"]),
        ("R602", "high", empty["b"] & ~empty["g"] & ~empty["y"]),
        ("R603", "high", (d(t, "b", "g") > 0.5) & (d(t, "b", "y") > 0.5) & ~(d(t, "g", "y") > 0.2)),
        ("R604", "high", (d(t, "b", "g") > 0.5) & ~(d(t, "b", "y") > 0.3)),
        ("R605", "high", (d(t, "b", "y") > 0.5) & ~(d(t, "b", "g") > 0.3)),
    ]
    late = [("R903", "medium", (d(t, "b", "y") > 0.4) & ~(d(t, "b", "g") > 0.3)), ("R904", "medium", (d(t, "b", "g") > 0.4) & ~(d(t, "b", "y") > 0.3))]
    card = lambda name, severity: F.struct(F.lit(name).alias("id"), F.lit(severity).alias("severity"))
    hits = lambda found: _kept([(cond, card(name, severity)) for name, severity, cond in found])
    df = pivot.withColumn("rules", hits(rules))
    ids = F.transform("rules", lambda r: r.id)
    among = lambda *names: F.arrays_overlap(ids, F.array(*map(F.lit, names)))
    major = among("R104", "R301", "R205") & among("R105", "R106", "R302", "R206")
    df = df.withColumn("rules", F.concat("rules", hits([("R901", "critical", major)])))
    df = df.withColumn("rules", F.concat("rules", hits([("R902", "low", F.size("rules") == 1)])))
    df = df.withColumn("rules", F.concat("rules", hits(late)))
    df = df.withColumn("rules", F.when(F.size("rules") == 0, F.array(card("R001", "info"))).otherwise(F.col("rules")))
    rank = lambda s: F.array_position(F.array(*map(F.lit, SEVERITIES)), s)
    best = F.array_min(F.transform("rules", lambda r, i: F.struct(rank(r.severity).alias("rank"), i.alias("i"), r.id.alias("id"), r.severity.alias("severity"))))
    df = df.withColumn("top", best)
    worst = F.col("top.severity")
    return df.withColumn("top_rule", F.col("top.id")).withColumn("rule_verdict", F.when(worst == "critical", "fail").when(worst.isin("high", "medium"), "warn").otherwise("ok")).drop("top")


def agent_cards(pivot: DataFrame) -> DataFrame:
    """A card for each bot: critical, important or ok, with what the bot lacks."""
    cards = []
    b = F.col("browser")
    for a in ("google", "yandex"):
        s = F.col(a)
        blocked = (F.coalesce(s.http_code, F.lit(0)) >= 400) | (F.coalesce(s.http_code, F.lit(0)) == 0) | ~s.access_state.eqNullSafe("ok")
        share = s.text_len / F.greatest(b.text_len, F.lit(1))
        lost = lambda flag: F.coalesce(b[flag], F.lit(False)) & ~F.coalesce(s[flag], F.lit(False))  # noqa: B023, E731
        facts = _kept([(blocked, F.lit("access")), (share < 0.7, F.lit("text")), (s.links_count < b.links_count, F.lit("links")), (lost("has_h1"), F.lit("h1")), (lost("has_title"), F.lit("title"))])
        level = F.when(blocked | ((b.text_len >= 100) & (share < 0.3)), "critical").when(F.size(facts) > 0, "important").otherwise("ok")
        cards.append(F.struct(F.lit(a).alias("agent"), level.alias("level"), facts.alias("facts")))
    return pivot.select("url", F.explode(F.array(*cards)).alias("c")).select("url", "c.*")


def ai_parity_reasons(features: DataFrame, base: str = "browser", by: str | None = None) -> DataFrame:
    """For each url the agent:field pairs in which an agent differs from the browser at all.

    Where several pages share a url, each snapshot is held against each of the browser's: the browser's with the greatest
    number in the column ``by`` first, and for each of them the others from the least on.
    """
    at = [F.col(by)] if by else []
    fields = {"http_code": "http_code", "text_len": "text_len", "links_count": "links_count", "has_h1": "has_h1", "has_title": "has_title", "access": "access_state"}
    own = features.where(F.col("agent") == base).select(F.col("url"), F.struct(*FEATURES).alias("b"), *[(-c).alias("b_at") for c in at])
    value = lambda s, f: F.coalesce(s[f], F.lit("ok")) if f == "access_state" else s[f]
    rows = features.where(F.col("agent") != base).select("url", "agent", F.struct(*FEATURES).alias("s"), *[c.alias("s_at") for c in at]).join(own, "url", "left")
    diffs = _kept([(~value(F.col("s"), f).eqNullSafe(value(F.col("b"), f)), F.concat("agent", F.lit(f":{name}"))) for name, f in fields.items()])
    found = rows.withColumn("d", F.when(F.col("b").isNotNull(), diffs).otherwise(F.array().cast("array<string>")))
    found = found.groupBy("url").agg(F.sort_array(F.collect_list(F.struct("agent", *(["b_at", "s_at"] if by else []), "d"))).alias("ds"), F.max(F.col("b").isNull()).alias("no_browser"))
    reasons = F.flatten(F.transform("ds", lambda x: x.d))
    return found.select("url", reasons.alias("reasons"), F.when(F.col("no_browser"), "error").when(F.size(reasons) > 0, "mismatch").otherwise("ok").alias("verdict"))


def ai_bot_status(features: DataFrame, base: str = "browser") -> DataFrame:
    """ok, warn or fail of each agent against the browser."""
    own = features.where(F.col("agent") == base).select("url", F.struct(*FEATURES).alias("b"))
    rows = features.where(F.col("agent") != base).join(own, "url", "left")
    fail = ~F.col("http_code").eqNullSafe(200) | ~F.col("access_state").eqNullSafe("ok")
    lost = lambda f: F.coalesce(F.col(f"b.{f}"), F.lit(False)) & ~F.coalesce(F.col(f), F.lit(False))
    warn = (F.col("text_len") < 0.7 * F.col("b.text_len")) | (F.col("links_count") < F.col("b.links_count")) | lost("has_h1") | lost("has_title")
    return rows.select("url", "agent", F.when(fail, "fail").when(F.coalesce(warn, F.lit(False)), "warn").otherwise("ok").alias("status"))


def availability(status: DataFrame) -> DataFrame:
    """For each url how many agents are blocked, warned about and served."""
    count = lambda s: F.count_if(F.col("status") == s)
    return status.groupBy("url").agg(count("fail").alias("blocked"), count("warn").alias("warned"), count("ok").alias("served"))
