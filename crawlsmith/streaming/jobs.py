"""The two streams: admission of one check an ip and day, and vacancies that arrive in files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from crawlsmith.functions.urls import host
from crawlsmith.operators.vacancies import hits_of_searches, upsert_matches, upsert_vacancies
from crawlsmith.streaming.store import BucketStore

ADMISSION = "id bigint, ip string, day string, admitted boolean, reason string"


def daily_admission_stream(requests: DataFrame, exempt_ips: list[str], exempt_hosts: list[str], lateness: str = "1 hour") -> DataFrame:
    """Each request of a stream (id, ip, url, ts) with whether it is the first of its ip and UTC day.

    The state of a key is one flag, and goes when the watermark has passed its day; in a micro-batch requests are
    taken by time. Requests that come later than ``lateness`` are judged as the first of those seen.
    """
    exempt = F.col("ip").isin(*exempt_ips) | host(F.col("url")).isin(*exempt_hosts)
    df = requests.withWatermark("ts", lateness).withColumn("exempt", exempt).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))

    def judge(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        taken = state.exists
        for part in parts:
            part = part.sort_values(["ts", "id"])
            free = part["exempt"].to_numpy()
            first = pd.Series(~free, index=part.index)
            first &= first.cumsum() == 1 if not taken else False
            taken = taken or bool(first.any())
            reason = ["exempt" if e else "first" if f else "daily_limit" for e, f in zip(free, first, strict=True)]
            yield pd.DataFrame({"id": part["id"], "ip": key[0], "day": key[1], "admitted": free | first.to_numpy(), "reason": reason})
        if taken:
            state.update((True,))
            end = pd.Timestamp(key[1], tz="UTC") + pd.Timedelta(days=1)
            state.setTimeoutTimestamp(max(int(end.timestamp() * 1000), state.getCurrentWatermarkMs() + 1))

    return df.groupBy("ip", "day").applyInPandasWithState(judge, ADMISSION, "taken boolean", "append", GroupStateTimeout.EventTimeTimeout)


VACANCY_TABLES = {
    "vacancies": "vacancy_id string, title string, applicants_count int",
    "matches": "profile_id bigint, vacancy_id string, status string, score int, search_id bigint, keywords string",
}


def vacancy_store(spark: SparkSession, path: str, buckets: int = 64) -> BucketStore:
    """vacancies and matches, both dealt by vacancy_id, so that a batch changes the same buckets of either."""
    return BucketStore(spark, path, VACANCY_TABLES, "vacancy_id", buckets)


def collected(tables: dict[str, DataFrame], feed: DataFrame, searches: DataFrame, profiles: DataFrame) -> dict[str, DataFrame]:
    """vacancies and matches after a feed (search_id, vacancy_id, title, applicants_count, page_read, pos).

    An unseen vacancy goes in if its page was read, else neither it nor a match of it does; a seen one takes the number of applicants
    where it has none. Each hit of an active search becomes a match, or names the last search in an old one.
    """
    feed = feed.where("vacancy_id <> ''")
    seen = tables["vacancies"].select("vacancy_id")
    read = feed.where("page_read")
    vacancies = upsert_vacancies(tables["vacancies"], read)
    # A vacancy that none has read yet keeps its hits out; one that is read in a later hit keeps out those before it.
    since = read.groupBy("vacancy_id").agg(F.min("pos").alias("since_"))
    hits = feed.join(seen.withColumn("seen_", F.lit(True)), "vacancy_id", "left").join(since, "vacancy_id", "left").where("seen_ OR pos >= since_")
    hits = hits_of_searches(hits.select("search_id", "vacancy_id"), searches, profiles)
    return {"vacancies": vacancies, "matches": upsert_matches(tables["matches"], hits)}


def ingest_vacancies(feed: DataFrame, store: BucketStore, searches: DataFrame, profiles: DataFrame, checkpoint: str) -> StreamingQuery:
    """Takes a stream of feed rows into a store, a micro-batch a version: vacancies and matches change together or not at all."""

    def merge(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            store.merge(batch, number, lambda tables, rows: collected(tables, rows, searches, profiles))
        finally:
            batch.unpersist()

    return feed.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
