"""Quality rules: text statistics, two fixed rules, and a robust multivariate outlier test.

The outlier test holds each document against minimum-covariance-determinant estimates of four transformed
statistics (mean word length, symbols, repeated lines, repeated words) at three levels: all documents, those of its
language, those of its language and source. Length is left out: a long text is no fault.

1. Each level's groups have several deterministic starts: classical moments; medians with quartile widths; medians with
   the covariance of spatial signs.
2. From each start concentration steps follow until no estimate changes: rank the rows by Mahalanobis distance, keep the nearest share H_SHARE,
   estimate again. Of all estimates on the way, that with the least determinant is the group's.
3. A group's centre and covariance are drawn towards those of the level above by its size: n / (n + PRIOR) of its own
   and the rest from above, one formula for groups of every size.
4. Documents further than CUTOFF from their group's centre are rejected.

Sums are of integers, hence exact and the same in any order. The nearest share is found from a histogram of
distances, so one grouped count replaces a sort of the group and a bin's rows go together. Everything is SQL over a narrow
table of four numbers a row; the SQL also runs in DuckDB.

Nulls and edge cases: a null text has no words and fails the base rules; null language or source is a
group of its own; an empty table gives an empty result; rows are judged one by one, so repeated rows and ties get
the same verdict; very long texts are folded within their row; other columns, whatever their names, are ignored by
``assess`` and passed through by ``keep_clean``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsmith.llm._store import Tables

#: Parameters. Features are integers: thousandths of a natural logarithm.
MIN_WORDS = 50
H_SHARE = 0.75
STEPS = 5  # bound on the concentration steps; later ones change nothing once an estimate is settled
STARTS = 3
PRIOR = 200  # documents that the level above counts for
CUTOFF = 30.0  # squared distance; the 0.9999 quantile of chi-square with four degrees of freedom is 23.5
CONSISTENCY = 1.49  # of the covariance of the nearest three quarters, for four dimensions
RIDGE = (60, 250, 400, 450)  # added deviations, as most texts have no symbol and repeat no line or word
P = range(1, 5)

#: The six white-space bytes that part words.
SPACES = "concat(' ', char(9), char(10), char(11), char(12), char(13))"
_SPACE = r"[\\x20\\x09-\\x0D]"
_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _stats() -> list[tuple[str, str]]:
    """Columns to add one after the other, by name; later ones use earlier ones."""
    return [
        ("t_", "coalesce(__text, '')"),
        ("w_", rf"split(btrim(t_, {SPACES}), '{_SPACE}+')"),
        ("n_words", "IF(w_[0] = '', 0, size(w_))"),
        ("word_chars", f"length(translate(t_, {SPACES}, ''))"),
        ("n_symbols", "length(t_) - length(translate(t_, '#*$%&|<>', ''))"),
        ("l_", rf"filter(split(t_, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')"),
        ("n_dup_lines", "size(l_) - size(array_distinct(l_))"),
        ("h_", "IF(n_words < 3, array(), transform(sequence(0, n_words - 3), i -> xxhash64(w_[i], w_[i + 1], w_[i + 2])))"),
        ("s_", "IF(size(array_distinct(h_)) = size(h_), array(), array_sort(transform(h_, (h, i) -> struct(h, i))))"),
        ("p_", "array_sort(transform(filter(s_, (x, j) -> coalesce(get(s_, j - 1).h = x.h, false) OR coalesce(get(s_, j + 1).h = x.h, false)), x -> x.i))"),
        ("n_repeat_words", "aggregate(transform(p_, (p, j) -> coalesce(least(3, get(p_, j + 1) - p), 3)), 0, (a, x) -> a + x)"),
    ]


def with_stats(docs: DataFrame) -> DataFrame:
    """``docs`` as structs (row), with the base statistics and the outlier features; no shuffle, no Python."""
    work = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    work = work.select("row", F.col("row.text").alias("__text"), F.col("row.lang").cast("string").alias("lang_"), F.col("row.source").cast("string").alias("source_"))
    for column, sql in _stats():
        work = work.withColumn(column, F.expr(sql))
    work = work.selectExpr("row", f"{group_sql('lang_', 'source_')} AS gid", f"{language_sql('lang_')} AS lid", *[f"CAST({c} AS BIGINT) AS {c}" for c in _BASE])
    work = work.selectExpr("*", f"{FAILED} AS base_failed", *feature_sql())
    # Through a generator of one row, so that no later expression is folded into these and computes them anew.
    found = F.struct("gid", "lid", *_BASE, "base_failed", *[f"x{i}" for i in P])
    return work.select("row", F.explode(F.array(found)).alias("found")).select("row", "found.*")


#: The SQL below runs unchanged in Spark and in DuckDB.
FAILED = f"(n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words)"
_XS = ", ".join(f"x{i}" for i in P)
_PAIRS = [(i, j) for i in P for j in P if j <= i]


def language_sql(lang: str) -> str:
    """The key of a language; line ends, which part it from the source in the group's key, become blanks."""
    return f"concat('1', coalesce(concat('=', replace({lang}, chr(10), ' ')), '~'))"


def group_sql(lang: str, source: str) -> str:
    return f"concat('2', substr({language_sql(lang)}, 2), chr(10), coalesce(concat('=', {source}), '~'))"


def feature_sql() -> list[str]:
    per = lambda x, n, k: f"CAST({k} * {x} AS DOUBLE) / greatest({n}, 1)"
    raw = [f"{per('word_chars', 'n_words', 1)} - 1 + CASE WHEN n_words = 0 THEN 1 ELSE 0 END", per("n_symbols", "word_chars", 1000), per("n_dup_lines", "n_words", 100), per("n_repeat_words", "n_words", 100)]
    return [f"CAST(round(1000 * ln(1 + greatest({x}, 0)), 0) AS BIGINT) AS x{i}" for i, x in zip(P, raw, strict=True)]


def members_sql(rows: str) -> str:
    """Rows that pass the base rules, once for each level: all ('0'), language ('1...'), language and source ('2...')."""
    return " UNION ALL ".join(f"SELECT {gid} AS gid, {_XS} FROM {rows} WHERE NOT base_failed" for gid in ("'0'", "lid", "gid"))


def sums_sql(rows: str, key: str) -> str:
    parts = [f"sum(x{i}) AS s{i}" for i in P] + [f"sum(x{i} * x{j}) AS s{i}{j}" for i, j in _PAIRS]
    return f"SELECT {key}, count(*) AS n, {', '.join(parts)} FROM {rows} GROUP BY {key}"


def moments_sql(sums: str, key: str, scale: float) -> str:
    """Means m and covariances c, with the ridge, from sums."""
    mean = lambda i: f"CAST(s{i} AS DOUBLE) / n"
    cov = lambda i, j: f"{scale} * (CAST(s{i}{j} AS DOUBLE) / n - ({mean(i)}) * ({mean(j)}))" + (f" + {RIDGE[i - 1] ** 2}.0" if i == j else "")
    return f"SELECT {key}, n, {', '.join(f'{mean(i)} AS m{i}' for i in P)}, {', '.join(f'{cov(i, j)} AS c{i}{j}' for i, j in _PAIRS)} FROM {sums}"


def factor_sql(moments: str, keep: str) -> str:
    """``keep`` columns, means, covariances, the Cholesky factor l and the logarithm of the determinant."""
    out = f"SELECT {keep}, {', '.join(f'm{i}' for i in P)}, {', '.join(f'c{i}{j}' for i, j in _PAIRS)} FROM {moments}"
    for j in P:  # a column of the factor at a time
        less = lambda i: "".join(f" - l{i}{k} * l{j}{k}" for k in range(1, j))  # noqa: B023, E731
        out = f"SELECT *, sqrt(c{j}{j}{less(j)}) AS l{j}{j} FROM ({out}) q"
        if rest := [f"(c{i}{j}{less(i)}) / l{j}{j} AS l{i}{j}" for i in P if i > j]:
            out = f"SELECT *, {', '.join(rest)} FROM ({out}) q"
    return f"SELECT *, round(2 * ({' + '.join(f'ln(l{i}{i})' for i in P)}), 9) AS det FROM ({out}) q"


def quartiles_sql(members: str) -> str:
    at = lambda q, i, name: f"percentile_cont({q}) WITHIN GROUP (ORDER BY x{i}) AS {name}{i}"
    return f"SELECT gid, count(*) AS n, {', '.join(at(q, i, name) for i in P for q, name in ((0.25, 'a'), (0.5, 'b'), (0.75, 'd')))} FROM {members} GROUP BY gid"


def widths_sql(quartiles: str) -> str:
    """Medians b and widths w of each group."""
    return f"SELECT gid, n, {', '.join(f'b{i}' for i in P)}, {', '.join(f'sqrt(((d{i} - a{i}) / 1.349) * ((d{i} - a{i}) / 1.349) + {RIDGE[i - 1] ** 2}.0) AS w{i}' for i in P)} FROM {quartiles}"


def signs_sql(members: str, widths: str) -> str:
    """Sums of products of spatial signs, in millionths, of each group."""
    u = f"SELECT r.gid AS gid, s.n AS n, {', '.join(f's.b{i} AS b{i}, s.w{i} AS w{i}, (r.x{i} - s.b{i}) / s.w{i} AS u{i}' for i in P)} FROM {members} r JOIN {widths} s ON r.gid = s.gid"
    r = f"SELECT *, greatest({' + '.join(f'u{i} * u{i}' for i in P)}, 1e-9) AS rr FROM ({u}) q"
    sums = ", ".join(f"sum(CAST(round(1000000 * u{i} * u{j} / rr, 0) AS BIGINT)) AS g{i}{j}" for i, j in _PAIRS)
    return f"SELECT gid, max(n) AS n, {', '.join(f'max(b{i}) AS b{i}, max(w{i}) AS w{i}' for i in P)}, {sums} FROM ({r}) q GROUP BY gid"


def starts_sql(members: str, widths: str, signs: str) -> str:
    """Means and covariances of all groups at each start."""
    classical = moments_sql(f"({sums_sql(members, 'gid')}) s", "gid, 1 AS start", 1.0)
    centre = ", ".join(f"b{i} AS m{i}" for i in P)
    diagonal = f"SELECT gid, 2 AS start, n, {centre}, {', '.join(f'w{i} * w{i} AS c{i}{j}' if i == j else f'0.0 AS c{i}{j}' for i, j in _PAIRS)} FROM {widths}"
    cov = lambda i, j: f"w{i} * w{j} * (CAST(g{i}{j} AS DOUBLE) / (1000000.0 * n)" + (" + 0.01)" if i == j else ")")
    spatial = f"SELECT gid, 3 AS start, n, {centre}, {', '.join(f'{cov(i, j)} AS c{i}{j}' for i, j in _PAIRS)} FROM {signs}"
    return f"{classical} UNION ALL {diagonal} UNION ALL {spatial}"


def distance_sql(rows: str, stats: str, keep: str) -> str:
    """``keep`` columns of the rows r and stats s, and ``d2``, the squared distance from the centre of the group."""
    out = f"SELECT {keep}, {', '.join(f'r.x{i} - s.m{i} AS y{i}' for i in P)}, {', '.join(f's.l{i}{j} AS l{i}{j}' for i, j in _PAIRS)} FROM {rows} r JOIN {stats} s ON r.gid = s.gid"
    for i in P:
        out = f"SELECT *, (y{i}{''.join(f' - l{i}{k} * z{k}' for k in range(1, i))}) / l{i}{i} AS z{i} FROM ({out}) q"
    return f"SELECT *, {' + '.join(f'z{i} * z{i}' for i in P)} AS d2 FROM ({out}) q"


_BIN = "CAST(floor(32 * ln(1 + d2)) AS BIGINT)"


def nearest_sql(members: str, stats: str) -> str:
    """For each group and start the histogram bin up to which the nearest share of its rows reaches."""
    bins = f"SELECT gid, start, {_BIN} AS bin, count(*) AS k FROM ({distance_sql(members, stats, 'r.gid AS gid, s.start AS start')}) d GROUP BY 1, 2, 3"
    upto = f"SELECT gid, start, bin, sum(k) OVER (PARTITION BY gid, start ORDER BY bin) AS c, sum(k) OVER (PARTITION BY gid, start) AS n FROM ({bins}) b"
    return f"SELECT gid, start, min(bin) AS bin FROM ({upto}) u WHERE c >= {H_SHARE} * n GROUP BY gid, start"


def step_sql(members: str, stats: str, nearest: str) -> str:
    """One concentration step: the sums over the nearest share of each group and start."""
    near = distance_sql(members, stats, f"r.gid AS gid, s.start AS start, {', '.join(f'r.x{i} AS x{i}' for i in P)}")
    kept = f"SELECT d.gid AS gid, d.start AS start, {', '.join(f'd.x{i} AS x{i}' for i in P)} FROM ({near}) d JOIN {nearest} b ON d.gid = b.gid AND d.start = b.start WHERE {_BIN} <= b.bin"
    return sums_sql(f"({kept}) k", "gid, start")


def settled_sql(sums: str, key: str = "gid, start") -> str:
    return factor_sql(f"({moments_sql(sums, key, CONSISTENCY)}) m", f"{key}, n")


def least_sql(estimates: str, groups: str) -> str:
    """Each group's estimate of the least determinant, with the number of its rows."""
    ranked = f"SELECT *, row_number() OVER (PARTITION BY gid ORDER BY det, step, start) AS place FROM {estimates}"
    return f"SELECT e.gid AS gid, g.n AS n, {', '.join(f'e.m{i} AS m{i}' for i in P)}, {', '.join(f'e.c{i}{j} AS c{i}{j}' for i, j in _PAIRS)} FROM ({ranked}) e JOIN {groups} g ON e.gid = g.gid WHERE e.place = 1"


def shrunk_sql(own: str, above: str, parent: str) -> str:
    """Estimates of one level drawn towards those of the level above, whose key ``parent`` gives."""
    share = f"CAST(o.n AS DOUBLE) / (o.n + {PRIOR})"
    mix = lambda c: f"u.{c} + {share} * (o.{c} - u.{c}) AS {c}"
    return f"SELECT o.gid AS gid, o.n AS n, {', '.join(mix(f'm{i}') for i in P)}, {', '.join(mix(f'c{i}{j}') for i, j in _PAIRS)} FROM {own} o JOIN {above} u ON {parent} = u.gid"


def levels_sql(least: str) -> tuple[str, str]:
    """Estimates of the languages, and of languages and sources (given those of the languages as ``languages``)."""
    languages = shrunk_sql(f"(SELECT * FROM {least} WHERE substr(gid, 1, 1) = '1')", f"(SELECT * FROM {least} WHERE gid = '0')", "'0'")
    groups = shrunk_sql(f"(SELECT * FROM {least} WHERE substr(gid, 1, 1) = '2')", "{languages}", "concat('1', split_part(substr(o.gid, 2), chr(10), 1))")
    return languages, groups


def fit(rows: DataFrame, tables: Tables) -> DataFrame:
    """Centre and factor of each group of language and source."""
    sql = rows.sparkSession.sql
    members = tables.write(sql(members_sql("{rows}"), rows=rows), "quality-members")
    widths = tables.write(sql(widths_sql(f"({quartiles_sql('{members}')}) q"), members=members), "quality-widths")
    signs = tables.write(sql(signs_sql("{members}", "{widths}"), members=members, widths=widths), "quality-signs")
    start = sql(factor_sql(f"({starts_sql('{members}', '{widths}', '{signs}')}) m", "gid, start, n"), members=members, widths=widths, signs=signs)
    stats, every, state = tables.write(start, "quality-stats"), None, None
    for step in range(1, STEPS + 1):
        sums = sql(step_sql("{members}", "{stats}", f"({nearest_sql('{members}', '{stats}')})"), members=members, stats=stats)
        sums = tables.write(sums, "quality-sums")
        stats = sql(settled_sql("{sums}"), sums=sums)
        now = sums.withColumn("step", F.lit(step))
        every = now if every is None else every.unionByName(now)
        last, state = state, sums.agg(F.sum(F.xxhash64(*sums.columns).cast("decimal(38,0)"))).first()[0]
        if state == last:
            break
    least = sql(least_sql(f"({settled_sql('{every}', 'gid, start, step')})", "{widths}"), every=every, widths=widths)
    least = tables.write(least, "quality-least")
    languages, groups = levels_sql("{least}")
    languages = tables.write(sql(languages, least=least), "quality-languages")
    groups = sql(factor_sql(f"({groups.replace('{languages}', '{upper}')}) m", "gid, n"), least=least, upper=languages)
    return tables.keep(groups, "quality-groups")


def verdicts(rows: DataFrame, stats: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of rows (gid, x1.., base_failed, ...) with ``distance`` and ``kept``."""
    cols = ", ".join(f"r.`{c}` AS `{c}`" for c in keep)
    near = rows.sparkSession.sql(distance_sql("{rows}", "{stats}", f"{cols}, r.base_failed AS failed_").replace("JOIN {stats}", "LEFT JOIN {stats}"), rows=rows, stats=stats)
    return near.select(*keep, F.col("d2").alias("distance"), (~F.col("failed_") & F.coalesce(F.col("d2") <= CUTOFF, F.lit(True))).alias("kept"))


def assess(docs: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed, distance and kept for each row."""
    with Tables(docs.sparkSession) as tables:
        narrow = with_stats(docs.select("doc_id", "text", "lang", "source")).select("row.doc_id", "gid", "lid", *_BASE, "base_failed", *[f"x{i}" for i in P])
        rows = tables.keep(narrow, "quality-rows")
        return verdicts(rows, fit(rows, tables), ["doc_id", *_BASE, "base_failed"])


def keep_clean(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns; texts are read twice, and no copy of them is written."""
    with Tables(docs.sparkSession) as tables:
        rows = tables.write(with_stats(docs.select("text", "lang", "source")).drop("row"), "quality-rows")
        stats = fit(rows, tables)
    return verdicts(with_stats(docs), stats, ["row"]).where("kept").select("row.*")


def oracle_sql() -> str:
    """The same rules for DuckDB, words and windows unnested instead of folded within a row."""
    steps = []
    for k in range(1, STEPS + 1):
        steps.append(f"nr{k} AS MATERIALIZED ({nearest_sql('members', f'st{k - 1}')})")
        steps.append(f"st{k} AS MATERIALIZED ({settled_sql(f'({step_sql("members", f"st{k - 1}", f"nr{k}")}) s')})")
    estimates = " UNION ALL ".join(f"SELECT *, {k} AS step FROM st{k}" for k in range(1, STEPS + 1))
    languages, groups = levels_sql("least_")
    final = distance_sql("rws", "fitted", f"r.doc_id AS doc_id, {', '.join(f'r.{c} AS {c}' for c in _BASE)}, r.base_failed AS base_failed").replace("JOIN fitted", "LEFT JOIN fitted")
    return f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT doc_id, i, word, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, word, w2, w3) AS k FROM g WHERE w3 IS NOT NULL),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM r, (SELECT unnest([0, 1, 2]) AS j) x WHERE k > 1 GROUP BY doc_id),
li AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
lc AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM li WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
b AS (SELECT d.doc_id, lang, source, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN w ON d.doc_id = w.doc_id LEFT JOIN lc ON d.doc_id = lc.doc_id LEFT JOIN c ON d.doc_id = c.doc_id),
rws AS MATERIALIZED (SELECT doc_id, {', '.join(_BASE)}, {group_sql('lang', 'source')} AS gid, {language_sql('lang')} AS lid, {FAILED} AS base_failed, {', '.join(feature_sql())} FROM b),
members AS MATERIALIZED ({members_sql('rws')}),
widths AS MATERIALIZED ({widths_sql(f"({quartiles_sql('members')}) q")}),
signs AS MATERIALIZED ({signs_sql('members', 'widths')}),
st0 AS MATERIALIZED ({factor_sql(f"({starts_sql('members', 'widths', 'signs')}) m", 'gid, start, n')}),
{', '.join(steps)},
least_ AS MATERIALIZED ({least_sql(f'({estimates})', 'widths')}),
languages AS MATERIALIZED ({languages}),
fitted AS MATERIALIZED ({factor_sql(f"({groups.replace('{languages}', 'languages')}) m", 'gid, n')})
SELECT doc_id, {', '.join(_BASE)}, base_failed, (NOT base_failed AND coalesce(d2 <= {CUTOFF}, true)) AS kept FROM ({final}) f
"""
