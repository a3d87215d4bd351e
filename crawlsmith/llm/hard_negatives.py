"""Hard-negative mining: rows of other labels that score just below an anchor's positives.

Vectors are integers, floor(256 * x). Each row stores its angles' cosines to orthonormal reference directions, the sine left over and its
norm. For one direction the spherical triangle inequality bounds the angle of two rows by the difference and the sum of their angles
to it; for several orthogonal ones the same bound is the product of the projections, give or take the product of what is left over.
Times both norms, and a margin for rounding, this brackets each score. Only rows whose bracket overlaps the window that still matters
get an integer inner product.

1. Anchors and rows are each cut into blocks of bounded size, ordered by label, nearest direction and angle; a block keeps the
   range of its labels, norms and angles.
2. Each block of anchors first meets the block of rows nearest by angle, which gives every anchor a threshold; then all blocks that the
   thresholds and ranges do not exclude. A pair of blocks is a task's unit, so memory is bounded by two blocks.
3. Positives first, then negatives in the score windows of those positives; the best of each pair of blocks are ranked at last.

The directions are the leading ones of SAMPLE rows; results do not depend on them. Directions that hold little of the vectors (uniform
noise of many dimensions) give wide brackets, and then nearly all pairs of the query set are scored.

Nulls and edge cases: rows without vec_id or label, without a vector or with a null or non-finite component take no part; an empty vector scores 0
with all; of vectors of unequal length the shorter counts as filled up with zeros; rows that share a vec_id count once, the least by label and
components; ties go to the smaller vec_id; components and scores beyond 64 bits are held at their ends; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlsmith.llm._store import Tables

#: Parameters.
ANCHOR_EVERY = 50
FLIP_EVERY = 7
POSITIVES = 5
NEGATIVES = 3
LEAST, MOST = 50, 95  # per cent of the positive's score
SAMPLE = 1024  # rows that the directions are taken from
DIRECTIONS = 16
ANCHOR_BLOCK = 256
ROW_BLOCK = 4096
NONE = -(1 << 62)

_BLOCK = "block bigint, n int, label_lo bigint, label_hi bigint, norm_hi double, angle_lo array<double>, angle_hi array<double>, ids binary, labels binary, ints binary, cosines binary, rest binary, norms binary"
_RESULT = "anchor_block bigint, place int, anchor_id bigint, positive int, vec_id bigint, score bigint"


def participants(embeddings: DataFrame) -> DataFrame:
    """vec_id, label after the flips, ints; a row for each vec_id."""
    fine = "vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    rows = embeddings.where(fine).selectExpr(
        "CAST(vec_id AS BIGINT) AS vec_id",
        f"CAST(IF(vec_id % {FLIP_EVERY} = 0, (label + 1) % 10, label) AS BIGINT) AS label",
        "transform(embedding, x -> CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS ints",
    )
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "ints")).alias("r")).select("vec_id", "r.label", "r.ints")


def directions(rows: DataFrame) -> np.ndarray:
    """Orthonormal directions of a bounded sample, one a row."""
    got = [r[0] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("ints").collect()]
    wide = max(map(len, got), default=0)
    unit = _unit(np.array([[*v, *[0] * (wide - len(v))] for v in got], float).reshape(len(got), wide))[0]
    return np.linalg.svd(unit, full_matrices=False)[2][:DIRECTIONS] if unit.size else np.zeros((0, wide))


def _unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norms = np.sqrt(np.einsum("ij,ij->i", v, v))
    return v / np.where(norms > 0, norms, 1)[:, None], norms


def _matrix(column: pa.Array, wide: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(sizes), max(wide, int(sizes.max(initial=0)))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.asarray(column.flatten())
    return out


def _cosines(v: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cosines to the directions, the sine left over, and norms of integer vectors."""
    unit, norms = _unit(v.astype(float))
    cos = unit[:, : refs.shape[1]] @ refs.T
    rest = np.sqrt(np.clip((norms > 0) - np.einsum("ij,ij->i", cos, cos), 0, 1))
    return cos, rest, norms


def located(rows: DataFrame, refs: np.ndarray) -> DataFrame:
    """``rows`` with the nearest direction (cell) and the cosine to it (near), which order the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cos = _cosines(_matrix(b["ints"], refs.shape[1]), refs)[0]
            cell = np.abs(cos).argmax(1) if cos.size else np.zeros(len(b), np.int64)
            near = cos[np.arange(len(b)), cell] if cos.size else np.zeros(len(b))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(near)], [*b.schema.names, "cell", "near"])

    return rows.mapInArrow(run, "vec_id bigint, label bigint, ints array<bigint>, cell int, near double")


def blocks(rows: DataFrame, refs: np.ndarray, most: int, n: int) -> DataFrame:
    """``rows`` in packed blocks of at most ``most``, neighbours by label, direction and angle together."""
    parts = max(1, min(-(-n // most), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    order = ["label", "cell", "near", "vec_id"]

    def pack(t: pa.Table, block: int) -> dict:
        v, labels = _matrix(t["ints"], refs.shape[1]), np.asarray(t["label"])
        cos, rest, norms = _cosines(v, refs)
        angles = np.arccos(np.clip(cos, -1, 1))
        raw = {"ids": np.asarray(t["vec_id"]), "labels": labels, "ints": v, "cosines": cos, "rest": rest, "norms": norms}
        return {"block": block, "n": len(t), "label_lo": int(labels.min()), "label_hi": int(labels.max()), "norm_hi": float(norms.max()), "angle_lo": angles.min(0).tolist(), "angle_hi": angles.max(0).tolist()} | {k: x.tobytes() for k, x in raw.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made, held = TaskContext.get().partitionId() << 32, 0, None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            while held.num_rows >= most:
                yield _packed(pack(held.slice(0, most), base + made))
                made, held = made + 1, held.slice(most)
        if held is not None and held.num_rows:
            yield _packed(pack(held, base + made))

    return rows.repartitionByRange(parts, *order).coalesce(parts).sortWithinPartitions(*order).mapInArrow(run, _BLOCK)


_KINDS = {"block": pa.int64(), "n": pa.int32(), "label_lo": pa.int64(), "label_hi": pa.int64(), "norm_hi": pa.float64(), "angle_lo": pa.list_(pa.float64()), "angle_hi": pa.list_(pa.float64())}


def _packed(row: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], _KINDS.get(k, pa.binary())) for k, x in row.items()], [*row])


class Block:
    """A packed block's arrays."""

    def __init__(self, t: pa.Table) -> None:
        get = lambda name, kind: np.frombuffer(t[name][0].as_py(), kind)
        n = t["n"][0].as_py()
        self.ids, self.labels, self.rest, self.norms = get("ids", np.int64), get("labels", np.int64), get("rest", float), get("norms", float)
        self.ints, self.cosines = get("ints", np.int64).reshape(n, -1), get("cosines", float).reshape(n, -1)


def brackets(a: Block, b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score that each pair of rows can have."""
    norms = np.outer(a.norms, b.norms)
    middle, wide = a.cosines @ b.cosines.T, np.outer(a.rest, b.rest)
    margin = 1 + 1e-7 * norms  # angles and products are off by less
    return norms * (middle - wide) - margin, norms * (middle + wide) + margin


def scores(a: Block, b: Block, wanted: np.ndarray) -> np.ndarray:
    """Integer inner products of the wanted pairs; NONE elsewhere."""
    k = min(a.ints.shape[1], b.ints.shape[1])
    x, y = a.ints[:, :k], b.ints[:, :k]
    out = np.full(wanted.shape, NONE, np.int64)
    largest = (float(np.abs(x.astype(float)).max(initial=0)), float(np.abs(y.astype(float)).max(initial=0)))
    bound = largest[0] * largest[1] * max(k, 1)
    if bound < 2**53 and np.count_nonzero(wanted) * 8 > wanted.size:  # exact in doubles
        out[wanted] = (x.astype(float) @ y.astype(float).T)[wanted].astype(np.int64)
        return out
    at = np.flatnonzero(wanted)
    for s in range(0, len(at), 1 << 15):
        i, j = np.divmod(at[s : s + (1 << 15)], wanted.shape[1])
        if bound < 2**62:
            out[i, j] = np.einsum("ij,ij->i", x[i], y[j])
        else:
            exact = (x[i].astype(object) * y[j].astype(object)).sum(1) if k else np.zeros(len(i), object)
            out[i, j] = np.array([min(max(int(v), NONE + 1), -NONE) for v in exact], np.int64)
    return out


def _first(found: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ``most`` greatest of each line, equal ones of the last all included; NONE never."""
    k = min(most, found.shape[1])
    least = np.partition(found, -k, axis=1)[:, -k] if k else np.zeros(len(found), np.int64)
    return np.nonzero((found >= least[:, None]) & (found > NONE))


def _cut(keys: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Indices of the first ``most`` of each key by score downwards and id upwards."""
    order = np.lexsort((ids, -score, keys))
    k = keys[order]
    start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    rank = np.arange(len(k)) - np.repeat(start, np.diff(np.r_[start, len(k)]))
    return order[rank < most]


def _rows(anchor_block: int, a: Block, i: np.ndarray, positive: np.ndarray, ids: np.ndarray, score: np.ndarray) -> pa.Table:
    columns = [np.full(len(i), anchor_block, np.int64), i.astype(np.int32), a.ids[i], positive.astype(np.int32), ids, score]
    return pa.table(columns, ["anchor_block", "place", "anchor_id", "positive", "vec_id", "score"])


def _limits(t: pa.Table, n: int, most: int) -> np.ndarray:
    """(anchor, positive, field) of what is known: the positive's score, and the least score that still matters."""
    out = np.full((n, most, 2), NONE, np.int64)
    for x in t["limits"][0].as_py() or ():
        out[x["place"], x["positive"]] = (x["score"], x["least"])
    return out


def near(a: Block, b: Block, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The best rows of ``b`` of each anchor's own label."""
    lo, hi = brackets(a, b)
    able = (a.labels[:, None] == b.labels) & (a.ids[:, None] != b.ids)
    k = min(POSITIVES, len(b.ids))
    least = np.partition(np.where(able, lo, -np.inf), -k, axis=1)[:, -k]  # so many score at least this
    found = scores(a, b, able & (hi >= np.maximum(least, limits[:, 0, 1].astype(float))[:, None]))
    i, j = _first(found, POSITIVES)
    at = _cut(i, found[i, j], b.ids[j], POSITIVES)
    return i[at], np.zeros(len(at)), b.ids[j[at]], found[i[at], j[at]]


def window(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest integer score of a negative to a positive of this score; of none, an empty window."""
    whole, part = np.divmod(score, 100)  # apart, so that nothing exceeds 64 bits
    lo, hi = whole * LEAST - (-LEAST * part) // 100, whole * MOST + (MOST * part) // 100
    known = score > NONE // 200
    return np.where(known, lo, 0), np.where(known, hi, -1)


def hard(a: Block, b: Block, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The best rows of ``b`` of other labels in the window of each anchor's positives."""
    lo, hi = brackets(a, b)
    first, last = window(limits[:, :, 0])
    first = np.maximum(first, limits[:, :, 1])
    able = np.zeros(lo.shape, bool)
    for p in range(limits.shape[1]):
        able |= (hi >= first[:, p, None]) & (lo <= last[:, p, None]) & (first[:, p] <= last[:, p])[:, None]
    found = scores(a, b, able & (a.labels[:, None] != b.labels))
    out = []
    for p in range(limits.shape[1]):
        i, j = _first(np.where((found >= first[:, p, None]) & (found <= last[:, p, None]), found, NONE), NEGATIVES)
        at = _cut(i, found[i, j], b.ids[j], NEGATIVES)
        out.append((i[at], np.full(len(at), p), b.ids[j[at]], found[i[at], j[at]]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _scan(anchors: DataFrame, rows: DataFrame, pairs: DataFrame, limits: DataFrame, how, known: int) -> DataFrame:
    """``how`` over each pair of blocks; limits: anchor_block and what is known of its anchors."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = Block(left), Block(right)
        return _rows(left["anchor_block"][0].as_py(), a, *how(a, b, _limits(left, len(a.ids), known)))

    blob = ["n", "ids", "labels", "ints", "cosines", "rest", "norms"]
    left = anchors.select(F.col("block").alias("anchor_block"), *blob).join(pairs, "anchor_block").join(limits, "anchor_block", "left")
    right = rows.select(F.col("block").alias("row_block"), *blob).join(pairs, "row_block")
    keys = ["anchor_block", "row_block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, _RESULT)


def block_pairs(anchors: DataFrame, rows: DataFrame) -> DataFrame:
    """Each block of anchors with each block of rows, by number, and the greatest and least score that a pair of their rows can have.

    Only block ranges are paired: the query set meets all rows in blocks.
    """
    some = lambda df, p: df.select(F.col("block").alias(f"{p}_block"), *[F.col(c).alias(f"{p}_{c}") for c in ("label_lo", "label_hi", "norm_hi", "angle_lo", "angle_hi")])
    last = rows.agg(F.coalesce(F.max(F.shiftright("block", 32)), F.lit(-1)).alias("part"), F.coalesce(F.max(F.col("block").bitwiseAND((1 << 32) - 1)), F.lit(-1)).alias("place")).first()
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n))) if n >= 0 else F.explode(F.lit(None).cast("array<int>"))
    left = some(anchors, "anchor").withColumn("part", upto(last["part"])).withColumn("place", upto(last["place"]))
    left = left.withColumn("row_block", F.shiftleft(F.col("part").cast("bigint"), 32) + F.col("place")).drop("part", "place")
    both = left.join(some(rows, "row"), "row_block")
    gap = F.array_max(F.transform(F.arrays_zip("anchor_angle_lo", "anchor_angle_hi", "row_angle_lo", "row_angle_hi"), lambda x: F.greatest(x["anchor_angle_lo"] - x["row_angle_hi"], x["row_angle_lo"] - x["anchor_angle_hi"], F.lit(0.0))))
    total = F.array_min(F.transform(F.arrays_zip("anchor_angle_hi", "row_angle_hi"), lambda x: F.least(x["anchor_angle_hi"] + x["row_angle_hi"], F.lit(np.pi))))
    norms = F.col("anchor_norm_hi") * F.col("row_norm_hi")
    margin = norms * 1e-6 + 1
    gap, total = F.coalesce(gap, F.lit(0.0)), F.coalesce(total, F.lit(float(np.pi)))
    return both.select(
        "anchor_block", "row_block",
        # The norms of a block begin at 0, so a positive cosine's least score is 0 and a negative one's greatest is 0.
        (F.greatest(F.cos(gap), F.lit(0.0)) * norms + margin).alias("greatest"),
        (F.least(F.cos(total), F.lit(0.0)) * norms - margin).alias("least"),
        gap.alias("gap"),
        ((F.col("anchor_label_lo") <= F.col("row_label_hi")) & (F.col("row_label_lo") <= F.col("anchor_label_hi"))).alias("may_same"),
        ((F.col("anchor_label_lo") != F.col("anchor_label_hi")) | (F.col("row_label_lo") != F.col("row_label_hi")) | (F.col("anchor_label_lo") != F.col("row_label_lo"))).alias("may_differ"),
    )


def _ranked(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _known(limits: DataFrame) -> DataFrame:
    """Limits (anchor_block, place, positive, score, least) as a row for each block, whose size bounds it."""
    return limits.groupBy("anchor_block").agg(F.collect_list(F.struct("place", "positive", "score", "least")).alias("limits"))


def _best(pairs: DataFrame, anchors: DataFrame, rows: DataFrame, limits: DataFrame, how, known: int, most: int, tables: Tables, tag: str) -> DataFrame:
    """The ``most`` best of each anchor and positive: first from the nearest block of rows, then from those that may still matter.

    limits: score, and the least score that matters, by anchor and positive.
    """
    nearest = Window.partitionBy("anchor_block").orderBy("gap", F.desc("greatest"), "row_block")
    pairs = tables.write(pairs.withColumn("turn", F.row_number().over(nearest)), f"{tag}-pairs")
    seeds = tables.write(_scan(anchors, rows, pairs.where("turn = 1").select("anchor_block", "row_block"), _known(limits), how, known), f"{tag}-seeds")
    keys = ["anchor_block", "place", "positive"]
    full = seeds.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"), F.min("score").alias("worst")).where(F.col("k") == most)
    raised = tables.write(limits.join(full, keys, "left").select(*keys, "score", F.greatest("least", F.coalesce("worst", F.col("least"))).alias("least")), f"{tag}-limits")
    over = raised.groupBy("anchor_block").agg(F.min("least").alias("need"), F.max(F.expr(f"CASE WHEN score > {NONE // 200} THEN CAST(score AS DOUBLE) * {MOST} / 100 + 1 ELSE {float(-NONE)} END")).alias("most_"))
    rest = pairs.where("turn > 1").join(over, "anchor_block").where((F.col("greatest") >= F.col("need")) & (F.col("least") <= F.col("most_")))
    later = tables.write(_scan(anchors, rows, rest.select("anchor_block", "row_block"), _known(raised), how, known), f"{tag}-rest")
    return seeds.union(later)


def mine(embeddings: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    with Tables(embeddings.sparkSession) as tables:
        plain = tables.write(participants(embeddings), "negatives-plain")
        refs = directions(plain)
        every = tables.write(located(plain, refs), "negatives-rows")
        some = every.where(F.col("vec_id") % ANCHOR_EVERY == 0)
        rows = tables.write(blocks(every, refs, ROW_BLOCK, every.count()), "negatives-row-blocks")
        anchors = tables.write(blocks(some, refs, ANCHOR_BLOCK, some.count()), "negatives-anchor-blocks")
        pairs = tables.write(block_pairs(anchors, rows), "negatives-block-pairs")
        places = anchors.select(F.col("block").alias("anchor_block"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("place"))
        start = places.select("anchor_block", "place", F.lit(0).alias("positive"), F.lit(NONE).alias("score"), F.lit(NONE).alias("least"))
        found = _best(pairs.where("may_same"), anchors, rows, start, near, 1, POSITIVES, tables, "positives")
        positives = _ranked(found, ["anchor_block", "place"], POSITIVES).select("anchor_block", "place", "anchor_id", (F.col("rank") - 1).alias("positive"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        positives = tables.write(positives, "negatives-positives")
        limits = positives.select("anchor_block", "place", "positive", F.col("positive_score").alias("score"), F.expr(f"(positive_score div 100) * {LEAST} - {LEAST}").alias("least"))
        found = _best(pairs.where("may_differ"), anchors, rows, limits, hard, POSITIVES, NEGATIVES, tables, "negatives")
        keys = ["anchor_block", "place", "positive"]
        ranked = _ranked(found, keys, NEGATIVES).select(*keys, "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        return tables.keep(ranked.join(positives, keys).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "hard-negatives")


ORACLE_SQL = f"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % {FLIP_EVERY} = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, r.vec_id AS r, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
  FROM e a JOIN e r ON a.vec_id <> r.vec_id WHERE a.vec_id % {ANCHOR_EVERY} = 0),
p AS (SELECT a, r, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, r) <= {POSITIVES})
SELECT p.a AS anchor_id, p.r AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.r ORDER BY s.score DESC, s.r) AS INT) AS rank, s.r AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT s.same AND {LEAST} * p.score <= 100 * s.score AND 100 * s.score <= {MOST} * p.score
QUALIFY row_number() OVER (PARTITION BY p.a, p.r ORDER BY s.score DESC, s.r) <= {NEGATIVES}
"""
