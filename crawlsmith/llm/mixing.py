"""Mixing sources to target weights by entropy balancing.

Every document starts with rate 1; rates w, of at most MOST, are to stay as close to that as the relative entropy
sum(w ln w - w) measures, while the words taken of each source, sum(w n), reach its target. The dual is convex with one
multiplier a source: its minimiser tilts a document of n words exponentially, w = min(MOST, exp(lambda n)). So where a source is to
grow its long documents are repeated first, and where it is to shrink they go first.

1. Words are counted once; documents become counts by source and size, before any shuffle.
2. Each Newton round sums the dual's gradient and curvature over these counts, source by source, and moves every multiplier,
   kept between the bounds that earlier rounds have shown. Rounds end when all gradients are small.
3. Rates, in 1e-8 units, are rounded into copies by carrying the remainder along each source's documents in order of
   size, so that a source's words differ from its target by about one document. The carry runs in blocks
   (a size and a stretch of ids); only block sums meet at a source, so a source with a third of all rows is spread.

Nulls and edge cases: a null text has size 0; a null source is a source, ordered last; rows with a null
or repeated doc_id are carried like any other (a null id comes last among its size, dealt out by its text's hash); ties in
size go by doc_id; documents of size 0 take 0 words; an empty table gives an empty result; very long texts are counted
within their row; other columns, whatever their names, are ignored, or passed on by ``mix``.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlsmith.llm._store import Tables

WEIGHTS = (5, 2, 1)  # repeat along the sources in code point order
MOST = 3  # times a document may be taken
UNIT = 100_000_000  # of a rate
GRID = 1_000_000_000_000  # multipliers are kept in such fractions
ROUNDS = 60  # bound on Newton rounds; ten or so are needed
CLOSE = 1e-9  # of a target: gradients below this end the rounds
LEAST, HIGHEST = -40.0, log(MOST)  # of a multiplier; at the highest every document is taken MOST times
BLOCK_BITS = 24  # a block holds at most so many ids of one size
NULL_BLOCKS = 4096  # as many blocks for null ids of one size

_SIZE = r"CAST(regexp_count(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS BIGINT)"
_BLOCK = f"coalesce(shiftright(CAST(doc_id AS BIGINT), {BLOCK_BITS}), {2**62} + pmod(xxhash64(text), {NULL_BLOCKS}))"


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.expr(_SIZE).alias("size"), F.expr(_BLOCK).alias("block"))


def targets(sized: DataFrame) -> DataFrame:
    """source, source_size and target of each source."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = len(WEIGHTS)
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((place - 1) % n + 1).cast("int")).cast("bigint")
    per = per.withColumn("weight", weight).withColumn("cap", MOST * F.col("source_size"))
    # Sources meet their cap in order of cap / weight; the level is what those left share by weight.
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    per = per.withColumn("total", F.sum("source_size").over(every)).withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after))
    per = per.withColumn("capped", F.col("cap") / F.col("weight") <= F.col("level"))
    per = per.withColumn("final", F.max(F.when(~F.col("capped"), F.col("level"))).over(every))
    per = per.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("final")))
    return per.select("source", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"))


def round_sql(counts: str, state: str, same: str) -> str:
    """One Newton round: source, target, low, high and lambda anew, and the gradient at the old lambda.

    The gradient grows with lambda, so its sign moves a bound. The step is Newton's for the logarithm of the words taken, which is
    nearer to a line than they are; one that leaves the bounds becomes their middle.
    """
    rate = f"CASE WHEN s.tilt * c.size >= {HIGHEST!r} THEN {MOST}.0 ELSE exp(s.tilt * c.size) END"
    free = f"CASE WHEN s.tilt * c.size >= {HIGHEST!r} THEN 0.0 ELSE exp(s.tilt * c.size) END"
    sums = f"""SELECT s.source AS source, max(s.target) AS target, max(s.low) AS low, max(s.high) AS high, max(s.tilt) AS tilt,
  sum(c.k * CAST(c.size AS DOUBLE) * {rate}) - max(s.target) AS gradient, sum(c.k * CAST(c.size AS DOUBLE) * c.size * {free}) AS curvature
  FROM {counts} c JOIN {state} s ON c.source {same} s.source GROUP BY s.source"""
    bounds = f"SELECT source, target, gradient, curvature, tilt, CASE WHEN gradient < 0 THEN tilt ELSE low END AS low, CASE WHEN gradient > 0 THEN tilt ELSE high END AS high FROM ({sums}) q"
    taken = "(gradient + target)"
    newton = f"SELECT *, CASE WHEN curvature > 0 AND target > 0 AND {taken} > 0 THEN tilt - ln({taken} / target) * {taken} / curvature ELSE (low + high) / 2 END AS next FROM ({bounds}) q"
    return f"SELECT source, target, low, high, CASE WHEN gradient = 0 THEN tilt WHEN next > low AND next < high THEN next ELSE (low + high) / 2 END AS tilt, gradient FROM ({newton}) q"


def rates(sized: DataFrame, per: DataFrame, tables: Tables) -> DataFrame:
    """source, size and rate (in units) of each size that occurs in a source."""
    sql = sized.sparkSession.sql
    counts = tables.write(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("k")), "mix-counts")
    # A source whose target is all that it can give is at the highest multiplier from the outset.
    state = tables.write(sql(_start_sql("{per}"), per=per), "mix-multipliers")
    for _ in range(ROUNDS):
        state = tables.write(sql(round_sql("{counts}", "{state}", "<=>"), counts=counts, state=state), "mix-multipliers")
        if not state.where(f"abs(gradient) > {CLOSE} * target AND high > low").limit(1).count():
            break
    return sql(_rate_sql("{counts}", "{state}", "<=>"), counts=counts, state=state)


def _start_sql(per: str) -> str:
    done = f"target >= {MOST} * CAST(source_size AS DOUBLE)"
    at = lambda free: f"CASE WHEN {done} THEN {HIGHEST!r} ELSE {free} END"
    return f"SELECT source, target, {at(LEAST)} AS low, {HIGHEST!r} AS high, {at('0.0')} AS tilt, 0.0 AS gradient FROM {per}"


def _rate_sql(counts: str, state: str, same: str) -> str:
    exponent = f"(CAST(round({GRID} * s.tilt, 0) AS BIGINT) / {GRID}.0) * c.size"
    rate = f"CASE WHEN c.size = 0 OR s.target <= 0 THEN 0 WHEN s.tilt * c.size >= {HIGHEST!r} THEN {MOST * UNIT} ELSE least(CAST(round({UNIT} * exp({exponent}), 0) AS BIGINT), {MOST * UNIT}) END"
    return f"SELECT c.source AS source, c.size AS size, CAST({rate} AS BIGINT) AS rate FROM {counts} c JOIN {state} s ON c.source {same} s.source"


def _copies(docs: DataFrame, tables: Tables) -> DataFrame:
    sized = tables.write(sizes(docs), "mix-sizes")
    per = tables.write(targets(sized), "mix-targets")
    rated = tables.write(rates(sized, per, tables), "mix-rates").withColumnsRenamed({"source": "r_source", "size": "r_size"})
    # A block adds rows times rate; what lies ahead of it is summed along its source.
    blocks = sized.groupBy("source", "size", "block").agg(F.count(F.lit(1)).alias("n"))
    blocks = blocks.join(rated, F.col("source").eqNullSafe(F.col("r_source")) & (F.col("size") == F.col("r_size")))
    key = Window.partitionBy("source").orderBy("size", "block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum(F.col("n") * F.col("rate")).over(key), F.lit(0))
    blocks = blocks.select(F.col("source").alias("b_source"), F.col("size").alias("b_size"), F.col("block").alias("b_block"), "rate", ahead.alias("ahead"))
    rows = sized.withColumn("within", F.row_number().over(Window.partitionBy("source", "size", "block").orderBy(F.col("doc_id").asc_nulls_last())))
    rows = rows.join(blocks, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("size") == F.col("b_size")) & (F.col("block") == F.col("b_block")))
    rows = rows.join(per.withColumnRenamed("source", "p_source"), F.col("source").eqNullSafe(F.col("p_source")))
    reach = lambda k: F.expr(f"(ahead + {k} * rate + {UNIT // 2}) div {UNIT}")
    rows = rows.withColumn("copies", reach("within") - reach("(within - 1)"))
    return rows.select("doc_id", "source", "block", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def copies(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken for each row."""
    with Tables(docs.sparkSession) as tables:
        return tables.keep(_copies(docs, tables), "mix-copies").drop("block")


def mix(docs: DataFrame) -> DataFrame:
    """The documents of the mix, a row for each copy, with the columns of ``docs``.

    Rows that share doc_id, source and size (null ids: by their text's hash) are each taken as often as the first such row.
    """
    with Tables(docs.sparkSession) as tables:
        taken = _copies(docs, tables).groupBy("doc_id", "source", "block", "size").agg(F.max("copies").alias("copies")).where("copies > 0")
        taken = tables.keep(taken, "mix-taken")

    def same(c: str) -> Column:
        return F.col(f"own.{c}").eqNullSafe(F.col(f"t.{c}"))

    # A row a document is never to be broadcast, however small its compressed file.
    taken = taken.hint("merge")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source", F.expr(_BLOCK).alias("block"), F.expr(_SIZE).alias("size")).alias("own")
    out = own.join(taken.alias("t"), same("doc_id") & same("source") & (F.col("own.block") == F.col("t.block")) & (F.col("own.size") == F.col("t.size")))
    return out.select("own.row", F.explode(F.sequence(F.lit(1), F.col("t.copies").cast("int")))).select("row.*")


def _oracle() -> str:
    same = "IS NOT DISTINCT FROM"
    steps = ",\n".join(f"z{k} AS MATERIALIZED ({round_sql('h', f'z{k - 1}', same)})" for k in range(1, ROUNDS + 1))
    return rf"""
WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
p0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
p1 AS (SELECT *, CAST([{', '.join(map(str, WEIGHTS))}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}] AS BIGINT) AS weight FROM p0),
p2 AS (SELECT *, {MOST} * source_size AS cap, CAST({MOST} * source_size AS DOUBLE) / weight AS meet FROM p1),
p3 AS (SELECT *, CAST((SELECT sum(source_size) FROM p0) - coalesce(sum(cap) OVER (ORDER BY meet, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
  / CAST(sum(weight) OVER (ORDER BY meet, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM p2),
p4 AS MATERIALIZED (SELECT source, source_size, CASE WHEN meet <= level THEN CAST(cap AS DOUBLE) ELSE weight * (SELECT max(level) FROM p3 WHERE NOT meet <= level) END AS target FROM p3),
h AS MATERIALIZED (SELECT source, size, count(*) AS k FROM s GROUP BY source, size),
z0 AS MATERIALIZED ({_start_sql('p4')}),
{steps},
r AS ({_rate_sql('h', f'z{ROUNDS}', same)}),
k AS (SELECT s.doc_id, s.source, s.size, r.rate, sum(r.rate) OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id NULLS LAST ROWS UNBOUNDED PRECEDING) AS upto FROM s JOIN r ON s.source {same} r.source AND s.size = r.size)
SELECT doc_id, size, source_size, target, CAST(size * ((upto + {UNIT // 2}) // {UNIT} - (upto - rate + {UNIT // 2}) // {UNIT}) AS BIGINT) AS taken FROM k JOIN p4 ON k.source {same} p4.source
"""


ORACLE_SQL = _oracle()
