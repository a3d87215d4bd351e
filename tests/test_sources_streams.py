import gzip

import pytest
from pyspark.sql import functions as F

from crawlsmith.operators.ledger import daily_admission
from crawlsmith.operators.speed import cache_state, cdn
from crawlsmith.sources import readers as R
from crawlsmith.streaming.jobs import collected, daily_admission_stream, ingest_vacancies, vacancy_store


def test_sitemap_files(spark, tmp_path):
    index = "<sitemapindex><sitemap><loc> https://s/a.xml.gz </loc></sitemap></sitemapindex>"
    urls = "﻿<urlset><url><loc>https://s/x</loc><lastmod>2024-01-02</lastmod></url><url><loc></loc></url></urlset>"
    (tmp_path / "i.xml").write_text(index)
    (tmp_path / "a.xml.gz").write_bytes(gzip.compress(urls.encode()))
    (tmp_path / "bad.xml.gz").write_bytes(b"\x1f\x8bnope")
    got = sorted((r.kind, r.loc, r.lastmod) for r in R.read_sitemap_files(spark, str(tmp_path)).collect())
    assert got == [("index", "https://s/a.xml.gz", None), ("url", "https://s/x", "2024-01-02")]


def test_feed_and_suggestions(spark):
    xml = "<rss><item><title>T</title><link>https://h/vacancy/12/</link><description><![CDATA[<p>Предполагаемый доход: от 100 000</p>]]></description></item></rss>"
    r = R.feed_items(spark.createDataFrame([(xml,)], "xml string")).first()
    assert (r.title, r.vacancy_id, r.salary_text, r.pub_date) == ("T", "12", "от 100 000", None)
    js = '{"totalCount":"40","topRequests":[{"phrase":"a b","count":"7"},{"query":"c","shows":"x"},{"count":"1"}]}'
    rows = R.parse_suggestions(spark.createDataFrame([("s", js), ("t", "broken")], "seed string, response string")).collect()
    assert sorted((r.phrase, r["count"], r.total) for r in rows) == [("a b", 7, 40), ("c", 0, 40)]


def test_whois(spark):
    w = R.whois_fields(F.col("t"), "2024-01-01")
    df = spark.createDataFrame([("Registrar: X LLC\nCreation Date: 2014-06-01T00:00:00Z",), ("created: 01.02.2020",), ("",)], "t string")
    assert [tuple(r) for r in df.select(w["registrar"], w["age_years"]).collect()] == [("X LLC", 9), (None, 3), (None, None)]


def test_headers(spark):
    df = spark.createDataFrame([({"cf-ray": "1", "cache-control": "public, max-age=60"},), ({"cache-control": "no-store"},), ({"etag": "x"},), ({},)], "headers map<string,string>")
    assert [tuple(r) for r in df.select(cdn(), cache_state()).collect()] == [("Cloudflare", "good"), (None, "none"), (None, "partial"), (None, "none")]


def test_admission_stream_agrees_with_batch(spark, tmp_path):
    rows = [(k, f"10.0.0.{k % 5}", "https://ex/" if k % 11 == 0 else "https://a/", f"2024-01-0{1 + k % 3} {k % 24:02d}:00:00") for k in range(60)]
    df = spark.createDataFrame(rows, "id bigint, ip string, url string, t string").select("id", "ip", "url", F.to_timestamp("t").alias("ts"))
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = daily_admission_stream(stream, ["10.0.0.4"], ["ex"])
    q = out.writeStream.format("memory").queryName("admitted").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.id, r.reason) for r in spark.table("admitted").collect())
    assert got == sorted((r.id, r.reason) for r in daily_admission(df, ["10.0.0.4"], ["ex"]).collect())


FEED = "search_id bigint, vacancy_id string, title string, applicants_count int, page_read boolean, pos bigint"
SEARCHES = [(1, 7, "a", True), (2, None, "b", True), (3, 8, "c", False), (4, 8, "d", True)]


def parties(spark):
    return spark.createDataFrame(SEARCHES, "id bigint, profile_id bigint, keywords string, active boolean"), spark.createDataFrame([(7,), (8,)], "id bigint")


def one_by_one(batches):
    """The collector's loop, a search and an item at a time."""
    vacancies, matches, owner = {}, {}, {s: p or 7 for s, p, _, on in SEARCHES if on}
    for batch in batches:
        for s, v, title, n, read, _ in sorted(batch, key=lambda r: r[5]):
            if not v:
                continue
            if v not in vacancies:
                if not read:
                    continue
                vacancies[v] = (title, n)
            elif read and vacancies[v][1] is None:
                vacancies[v] = (vacancies[v][0], n)
            if s in owner:
                matches.setdefault((owner[s], v), s)
        for key in {(owner[r[0]], r[1]) for r in batch if r[0] in owner and (owner[r[0]], r[1]) in matches}:
            mine = [r[0] for r in batch if r[0] in owner and (owner[r[0]], r[1]) == key]
            matches[key] = max(mine)
    return vacancies, matches


def state(store):
    v = {r.vacancy_id: (r.title, r.applicants_count) for r in store.read("vacancies").collect()}
    return v, {(r.profile_id, r.vacancy_id): r.search_id for r in store.read("matches").collect()}


def files(path):
    return {str(p.relative_to(path)): p.read_bytes() for p in path.rglob("*") if p.is_file() and not p.name.endswith(".crc")}


def batch_of(k, n=10):
    return [(1 + (k + i) % 4, str((k * 3 + i) % 25), f"t{(k * 3 + i) % 25}", None if (k + i) % 3 else i, True, i) for i in range(n)]


def test_store_rewrites_only_what_a_batch_touches(spark, tmp_path):
    searches, profiles = parties(spark)
    store = vacancy_store(spark, str(tmp_path / "s"))
    change = lambda tables, rows: collected(tables, rows, searches, profiles)
    batches = [batch_of(k) for k in range(5)]
    for k, rows in enumerate(batches):
        before = store.manifest()
        touched = store.merge(spark.createDataFrame(rows, FEED), k, change)
        after = store.manifest()
        assert len(touched) <= 10 and after.batch == k
        for name in ("vacancies", "matches"):
            assert {b for b, f in after.tables[name].items() if before.tables.get(name, {}).get(b) != f} <= set(touched)
        assert state(store) == one_by_one(batches[: k + 1])
    held = files(tmp_path / "s")
    assert store.merge(spark.createDataFrame(batches[4], FEED), 4, change) == [] and files(tmp_path / "s") == held  # a replay
    assert store.merge(spark.createDataFrame([], FEED), 5, change) == [] and state(store) == one_by_one(batches)
    # Only folders that the two last manifests name are left.
    named = store.manifest(4).folders() | store.manifest(5).folders()
    left = {str(p.relative_to(tmp_path / "s" / "data")) for p in (tmp_path / "s" / "data").glob("*/*/bucket_=*")}
    assert left == named and sorted(p.name for p in (tmp_path / "s" / "manifests").iterdir() if p.name.isdigit()) == ["4", "5"]


def test_a_stopped_batch_leaves_the_old_version(spark, tmp_path, monkeypatch):
    searches, profiles = parties(spark)
    store = vacancy_store(spark, str(tmp_path / "s"), 8)
    change = lambda tables, rows: collected(tables, rows, searches, profiles)
    store.merge(spark.createDataFrame(batch_of(0), FEED), 0, change)
    old = state(store)

    def stopped(manifest):
        raise RuntimeError("stopped before the manifest is published")

    with monkeypatch.context() as m:
        m.setattr(store, "_publish", stopped)
        with pytest.raises(RuntimeError):
            store.merge(spark.createDataFrame(batch_of(1), FEED), 1, change)
    assert state(store) == old and store.manifest().batch == 0
    store.merge(spark.createDataFrame(batch_of(1), FEED), 1, change)
    assert state(store) == one_by_one([batch_of(0), batch_of(1)])


def test_unread_pages_and_idle_searches(spark, tmp_path):
    searches, profiles = parties(spark)
    rows = [(1, "a", "A", None, False, 0), (2, "a", "A2", 5, True, 1), (4, "b", "B", 1, False, 2), (3, "c", "C", 1, True, 3), (1, "", "x", 1, True, 4), (1, None, "x", 1, True, 5), (4, "d", "D", None, None, 6)]
    store = vacancy_store(spark, str(tmp_path / "s"), 4)
    store.merge(spark.createDataFrame(rows, FEED), 0, lambda tables, feed: collected(tables, feed, searches, profiles))
    assert state(store) == ({"a": ("A2", 5), "c": ("C", 1)}, {(7, "a"): 2})


def test_vacancy_stream(spark, tmp_path):
    searches, profiles = parties(spark)
    for k in range(3):
        spark.createDataFrame(batch_of(k), FEED).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    feed = spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    store = vacancy_store(spark, str(tmp_path / "s"), 8)
    for _ in range(2):  # the second run finds nothing new
        ingest_vacancies(feed, store, searches, profiles, str(tmp_path / "c")).awaitTermination(120)
    assert store.manifest().batch == 2 and set(state(store)[0]) == {r[1] for k in range(3) for r in batch_of(k)}
