"""The ledger of past checks: lists, search and who may check today."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlsmith.functions.urls import host


def list_checks(checks: DataFrame, kind: str, n: int = 200, users: DataFrame | None = None, teams: DataFrame | None = None) -> DataFrame:
    """The newest checks of a kind, with user_email and team_name where users (id, email) and teams (id, name) are given.

    Spark keeps n rows a partition, no full sort; only those n are joined.
    """
    top = checks.where(F.col("kind") == kind).orderBy(F.desc("created_at"), F.desc("id")).limit(n)
    if users is not None:
        top = top.join(users.select(F.col("id").alias("user_id"), F.col("email").alias("user_email")), "user_id", "left")
    if teams is not None:
        top = top.join(teams.select(F.col("id").alias("team_id"), F.col("name").alias("team_name")), "team_id", "left")
    return top.orderBy(F.desc("created_at"), F.desc("id")) if users is not None or teams is not None else top


def search_checks(checks: DataFrame, verdict: str | None = None, text: str | None = None, page: int = 1, size: int = 50) -> DataFrame:
    """A page of the checks that match, newest first; a page beyond the last is the last.

    The text is looked for in url, ip, reasons and, where there are such columns, user_email and team_name.
    """
    df = checks.withColumn("verdict", F.coalesce("verdict", F.lit("error")))
    if verdict:
        df = df.where(F.col("verdict") == verdict)
    if text:
        df = df.where(F.lower(F.concat_ws(" ", *[c for c in ("url", "user_email", "team_name", "ip", "reasons") if c in checks.columns])).contains(text.lower()))
    last = max(1, -(-df.count() // size))
    page = min(max(1, page), last)
    return df.orderBy(F.desc("created_at"), F.desc("id")).offset((page - 1) * size).limit(size)


def verdict_options(checks: DataFrame) -> DataFrame:
    return checks.select(F.coalesce("verdict", F.lit("error")).alias("verdict")).distinct().orderBy("verdict")


def daily_admission(requests: DataFrame, exempt_ips: list[str], exempt_hosts: list[str]) -> DataFrame:
    """requests (id, ip, url, ts) with admitted and reason: the first of an ip and UTC day passes.

    Exempt ips and hosts pass and use no slot. The first request is an aggregate with partial minima, so an ip with most
    of the requests is no hot spot, and comes back by a join that can be split.
    """
    exempt = F.col("ip").isin(*exempt_ips) | host(F.col("url")).isin(*exempt_hosts)
    df = requests.withColumn("day", F.to_date("ts")).withColumn("exempt", exempt)
    first = df.where("NOT exempt").groupBy("ip", "day").agg(F.min(F.struct("ts", "id")).alias("first_"))
    df = df.join(first, ["ip", "day"], "left")
    admitted = F.col("exempt") | (F.col("first_.id") == F.col("id"))
    return df.select("id", "ip", "day", admitted.alias("admitted"), F.when(F.col("exempt"), "exempt").when(admitted, "first").otherwise("daily_limit").alias("reason"))


def joined_reasons(reasons: Column) -> Column:
    return F.array_join(reasons, "; ")


def export_checks_csv(checks: DataFrame, path: str) -> None:
    """Checks as CSV: line ends become blanks, quotes are doubled, reasons are joined."""
    flat = [F.regexp_replace(joined_reasons(F.col(c)) if t.startswith("array") else F.col(c).cast("string"), r"[\r\n]+", " ").alias(c) for c, t in checks.dtypes]
    checks.select(*flat).write.mode("overwrite").csv(path, header=True, escape='"')


def append_checks(raw: DataFrame, path: str) -> None:
    """Ledger rows from raw responses (kind, url, response, ip, user_id, created_at), appended by kind and day."""
    empty = F.coalesce(F.trim("response"), F.lit("")) == ""
    parsed = F.try_parse_json("response")
    bad = empty | parsed.isNull()
    cut = F.when(F.length("response") > 10_000, F.concat(F.substring("response", 1, 10_000), F.lit("..."))).otherwise(F.col("response"))
    reasons = F.from_json(F.when(~bad, F.get_json_object("response", "$.reasons")), "array<string>")
    why = F.when(empty, F.array(F.lit("empty_response"))).when(bad, F.array(F.lit("invalid_json"))).otherwise(reasons)
    rows = raw.select("kind", "url", F.when(bad, "error").otherwise(F.get_json_object("response", "$.verdict")).alias("verdict"), why.alias("reasons"), F.when(bad, cut).otherwise(F.col("response")).alias("details"), "ip", "user_id", "created_at", F.to_date("created_at").alias("check_date"))
    rows.write.mode("append").partitionBy("kind", "check_date").parquet(path)


def active_users(users: DataFrame, n: int) -> DataFrame:
    return users.where("deleted_at IS NULL").orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def activity_feed(activity: DataFrame, users: DataFrame, user_id: int, n: int = 10) -> DataFrame:
    names = users.select(F.col("id").alias("user_id"), F.col("name").alias("user_name"))
    return activity.where(F.col("user_id") == user_id).join(names, "user_id", "left").orderBy(F.desc("ts"), F.desc("id")).limit(n)


def user_team(user_id: int, members: DataFrame, teams: DataFrame) -> DataFrame:
    """The team (id, name, ...) of a user's first membership (id, user_id, team_id); no row without one."""
    own = members.where(F.col("user_id") == user_id).orderBy("id").limit(1).select(F.col("team_id").alias("id"))
    return teams.join(own, "id", "left_semi")
