"""Document fingerprints: every shingle hash below a fixed fraction of the hash range is retained.

Shingles are five lower-cased words (fewer words: the whole sequence). Their MD5 digests are uniform, so
the fraction FRACTION / 16 is a test of the first hex digit. As the threshold does not depend on the
document, sketches are merged by union (``merge``), and overlaps estimate Jaccard likeness and containment (``contained``)
between texts of very unequal length. Of n shingles about n / 8 are retained: an estimate p from m retained hashes has a
standard error of sqrt(p (1 - p) / m), 0.05 at 100 and 0.16 at 10, so texts of under 100 words are told apart only roughly.

Nulls and edge cases: a null text counts as empty. A text with no retained hash, which one of eight shingles or fewer often is,
has the fingerprint ''. Two texts of which one has none are alike, or hold one another, only if they are equal; ties do not
arise, as hashes are compared for equality; very long texts are folded within their row. Rows with a null doc_id come after all
others in the descending order; rows that share a doc_id are ordered by their text's digest. Other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlsmith.llm._store import materialize
from crawlsmith.llm.quality_rules import SPACES

FRACTION = 2  # sixteenths of the hash range that are retained
DIGITS = 16  # hex digits kept of a retained hash
WORDS = 5


def retained(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out``, the sorted retained hashes of ``text``."""
    w, n = f"__w_{out}", f"__n_{out}"
    df = df.withColumn(w, F.expr(rf"split(btrim(lower({text}), {SPACES}), '[\\x20\\x09-\\x0D]+')"))
    df = df.withColumn(n, F.expr(f"IF({w}[0] = '', 0, size({w}))"))
    joined = " || ' ' || ".join(f"{w}[i + {k}]" for k in range(WORDS))
    hashes = f"CASE WHEN {n} = 0 THEN array() WHEN {n} < {WORDS} THEN array(md5(array_join({w}, ' '))) ELSE transform(sequence(0, {n} - {WORDS}), i -> md5({joined})) END"
    kept = f"transform(filter({hashes}, h -> h < '{FRACTION:x}'), h -> substr(h, 1, {DIGITS}))"
    return df.withColumn(out, F.expr(f"array_sort(array_distinct({kept}))")).drop(w, n)


def likeness(a: str, b: str, equal: Column) -> Column:
    """Jaccard estimate of two retained arrays; where either is empty, whether the texts are equal."""
    both = F.size(F.array_intersect(a, b))
    whole = F.size(a) + F.size(b) - both
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.when(equal, 1.0).otherwise(0.0)).otherwise(both.cast("double") / whole)


def contained(a: str, b: str, equal: Column) -> Column:
    """Estimate of the share of the first text's shingles that the second holds."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.when(equal, 1.0).otherwise(0.0)).otherwise(both / F.size(a))


def hashes(fingerprint: Column) -> Column:
    """The retained hashes of a fingerprint."""
    return F.filter(F.regexp_extract_all(fingerprint, F.lit(f"([0-9a-f]{{{DIGITS}}})"), 1), lambda h: h != "")


def merge(fingerprint: str) -> Column:
    """An aggregate: the fingerprint of all shingles of the texts whose fingerprints are given, merged map-side."""
    return F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(hashes(F.col(fingerprint)))))), "")


def following(rows: DataFrame) -> DataFrame:
    """rows (key, n_chars) with next_key, that of the next in descending order (after the last: the first).

    Only ids are ordered: ranges of ids are ordered each by itself, and the few first and last ones of the
    ranges are joined to each other.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("digest")]
    ranged = materialize(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "fingerprint-order")
    within = Window.partitionBy("part").orderBy(*order)
    keys = ["doc_id", "digest"]
    led = ranged.withColumns({f"next_{c}": F.lead(c).over(within) for c in keys}).withColumn("last", F.lead("digest").over(within).isNull())
    firsts = ranged.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull(), (-F.col("doc_id")).alias("m"), "digest", "doc_id")).alias("f")).select("part", *[F.col(f"f.{c}").alias(f"first_{c}") for c in keys])
    whole = Window.orderBy("part")
    around = firsts.withColumns({f"then_{c}": F.when(F.lead("part").over(whole).isNotNull(), F.lead(f"first_{c}").over(whole)).otherwise(F.first(f"first_{c}").over(whole)) for c in keys})
    led = led.join(F.broadcast(around.select("part", *[f"then_{c}" for c in keys])), "part")  # a row for each range
    return led.select(*keys, "n_chars", *[F.when(F.col("last"), F.col(f"then_{c}")).otherwise(F.col(f"next_{c}")).alias(f"next_{c}") for c in keys])


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text, and the likeness of both and of the next document."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("key", F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("/"), F.sha2("text", 256)))
    digest = lambda key: F.substring_index(key, "/", -1)
    ids = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"))
    order = following(ids.distinct())
    key = lambda c: F.concat(F.coalesce(F.col(f"{c}doc_id").cast("string"), F.lit("null")), F.lit("/"), F.col(f"{c}digest"))
    wants = order.select(key("next_").alias("key"), key("").alias("for_key"), F.expr("n_chars div 3").cast("int").alias("take"))
    # Both joins deal out the same three columns by the same key, so the texts are shuffled once.
    heads = retained(texts.join(wants, "key"), "text", "after")
    heads = heads.select(F.col("for_key"), F.col("text").substr(F.lit(1), F.col("take")).alias("head"), F.col("key").alias("after_key"), F.col("doc_id").alias("next_id"), "after").dropDuplicates(["for_key"])
    rows = texts.join(heads, texts["key"] == heads["for_key"]).withColumn("n_chars", F.length("text").cast("bigint"))
    rows = rows.withColumn("edited", F.expr("concat(left(text, CAST(n_chars - n_chars div 3 AS INT)), head)"))
    rows = retained(retained(rows, "text", "own"), "edited", "changed").withColumn("edited_sha256", F.sha2("edited", 256))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256",
        F.array_join("own", "").alias("fingerprint"), F.array_join("changed", "").alias("edited_fingerprint"),
        likeness("own", "changed", F.col("edited_sha256") == digest("key")).alias("near_edited"),
        likeness("own", "after", digest("after_key") == digest("key")).alias("near_next"),
        "next_id",
        contained("own", "after", digest("after_key") == digest("key")).alias("held_by_next"),
        contained("after", "own", digest("after_key") == digest("key")).alias("holds_next"),
    )


def _sketch_sql(rows: str, name: str) -> str:
    return rf"""{name}_w AS (SELECT doc_id, regexp_extract_all(lower(t), '[^\x20\x09-\x0D]+') AS w FROM {rows}),
{name}_s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [md5(array_to_string(w, ' '))]
  ELSE list_transform(range(1, len(w) - {WORDS - 2}), lambda i: md5({" || ' ' || ".join(f'w[i + {k}]' for k in range(WORDS))})) END) AS h FROM {name}_w),
{name} AS (SELECT doc_id, list_sort(list_distinct(list(h[1:{DIGITS}]))) AS f FROM {name}_s WHERE h < '{FRACTION:x}' GROUP BY doc_id)"""


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, lead(doc_id) OVER (ORDER BY doc_id DESC) AS nx FROM documents),
e AS (SELECT doc_id, t, length(t) AS n, coalesce(nx, (SELECT max(doc_id) FROM documents)) AS nx FROM d),
ed AS (SELECT e.doc_id, e.nx, e.t AS own, x.t AS after, left(e.t, e.n - e.n // 3) || left(x.t, e.n // 3) AS t FROM e JOIN e x ON e.nx = x.doc_id),
{_sketch_sql('d', 'f')},
{_sketch_sql('ed', 'g')},
j AS (SELECT ed.*, coalesce(f.f, []) AS a, coalesce(g.f, []) AS b, coalesce(h.f, []) AS c FROM ed LEFT JOIN f ON ed.doc_id = f.doc_id LEFT JOIN g ON ed.doc_id = g.doc_id LEFT JOIN f h ON ed.nx = h.doc_id)
SELECT doc_id, CAST(length(own) AS BIGINT) AS n_chars, sha256(t) AS edited_sha256, array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint,
  CASE WHEN len(a) = 0 OR len(b) = 0 THEN CASE WHEN own = t THEN 1.0 ELSE 0.0 END ELSE CAST(len(list_intersect(a, b)) AS DOUBLE) / (len(a) + len(b) - len(list_intersect(a, b))) END AS near_edited,
  CASE WHEN len(a) = 0 OR len(c) = 0 THEN CASE WHEN own = after THEN 1.0 ELSE 0.0 END ELSE CAST(len(list_intersect(a, c)) AS DOUBLE) / (len(a) + len(c) - len(list_intersect(a, c))) END AS near_next, nx AS next_id,
  CASE WHEN len(a) = 0 OR len(c) = 0 THEN CASE WHEN own = after THEN 1.0 ELSE 0.0 END ELSE CAST(len(list_intersect(a, c)) AS DOUBLE) / len(a) END AS held_by_next,
  CASE WHEN len(a) = 0 OR len(c) = 0 THEN CASE WHEN own = after THEN 1.0 ELSE 0.0 END ELSE CAST(len(list_intersect(a, c)) AS DOUBLE) / len(c) END AS holds_next
FROM j
"""
