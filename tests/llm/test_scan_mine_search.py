import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from crawlsmith.llm import hard_negatives, lexical_search, license_scan
from tests.llm.conftest import prose

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

# Hard negatives


def brute_negatives(rows):
    alive = {}
    for vec_id, vec, label in rows:
        if vec_id is None or label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        key = ((label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * x) for x in vec])
        alive[vec_id] = min(alive.get(vec_id, key), key)
    out = []
    for a, (label, v) in alive.items():
        if a % 50:
            continue
        score = {r: sum(x * y for x, y in zip(v, w, strict=False)) for r, (_, w) in alive.items() if r != a}
        best = sorted(score, key=lambda r: (-score[r], r))
        for p in [r for r in best if alive[r][0] == label][:5]:
            fine = [r for r in best if alive[r][0] != label and 50 * score[p] <= 100 * score[r] <= 95 * score[p]][:3]
            out += [(a, p, k + 1, r, score[p], score[r]) for k, r in enumerate(fine)]
    return sorted(out)


def vectors(kind):
    rng = np.random.default_rng(5)
    if kind == "clusters":  # tight about few directions, norms of all sizes
        centres = rng.normal(size=(12, 24))
        v = centres[rng.integers(0, 12, 700)] + 0.15 * rng.normal(size=(700, 24))
        v *= rng.uniform(0, 9, 700)[:, None]
    elif kind == "ties":
        v = rng.integers(-1, 2, size=(700, 3)).astype(float)
    else:
        v = rng.normal(size=(700, 40))
    return [(int(i), [float(x) for x in np.float32(x)], int(c)) for i, x, c in zip(rng.permutation(700), v, rng.integers(0, 4, 700), strict=True)]


def mined(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<float>, label int, ints string, block int")
    return sorted(tuple(r) for r in hard_negatives.mine(df.repartition(3)).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("kind", ["clusters", "ties", "noise"])
def test_negatives_over_many_blocks(spark, monkeypatch, kind):
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK", 90)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 4)
    rows = vectors(kind)
    got = mined(spark, rows)
    assert got == brute_negatives(rows) and got


def test_negatives_of_odd_rows(spark):
    rows = [(i, v, c) for i, v, c in vectors("clusters")[:150]]
    rows += [(None, [1.0] * 24, 1), (1000, None, 1), (1001, [1.0, None], 1), (1002, [float("nan")], 2), (1003, [float("inf")] * 24, 1), (1004, [1.0] * 24, None)]
    rows += [(1050, [], 1), (1100, [0.0] * 24, 1), (1150, [3.0], 2), (1151, [2.5, 0.5], 2), (1152, [2.0, 0.25], 3), *rows[:20], (rows[3][0], [9.0] * 24, 3)]
    assert mined(spark, rows) == brute_negatives(rows)
    assert mined(spark, [(50, [1.0], 1)]) == [] == mined(spark, [])


def test_negatives_beyond_exact_doubles(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=6) * 1e5)], i % 3) for i in range(120)]
    assert mined(spark, rows) == brute_negatives(rows)


def test_tight_rows_are_hardly_scored():
    rng = np.random.default_rng(7)
    v = np.floor(256 * (np.repeat(rng.normal(size=(16, 32)), 100, 0) + 0.02 * rng.normal(size=(1600, 32)))).astype(np.int64)
    refs = np.linalg.svd(v / np.linalg.norm(v, axis=1)[:, None], full_matrices=False)[2][:16]
    cos, rest, norms = hard_negatives._cosines(v, refs)
    b = hard_negatives.Block.__new__(hard_negatives.Block)
    b.ids, b.labels, b.ints, b.cosines, b.rest, b.norms = np.arange(1600), np.zeros(1600, int), v, cos, rest, norms
    lo, hi = hard_negatives.brackets(b, b)
    exact = v @ v.T
    assert (lo <= exact).all() and (exact <= hi).all()
    fifth = np.partition(lo, -6, axis=1)[:, -6]
    assert (hi >= fifth[:, None]).mean() < 0.1


# Ranked search


def brute_search(docs, items):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    bags = [(i, Counter(term.findall((t or "").translate(LOW)))) for i, t in docs]
    df = Counter(t for _, b in bags for t in b)
    many, total = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    out = []
    for item, text in sorted({(i, t or "") for i, t in items}, key=str):
        asked, scored = term.findall(text.translate(LOW)), []
        for i, b in bags:
            m = 100 - 75 + (75 * b.total() * many) // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * b[t]) // (1000 * b[t] + 8 * m)) for t in asked if b[t])
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:10])]
    return sorted(out, key=str)


def searched(spark, docs, items):
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id bigint, text string, term string").repartition(3)
    q = spark.createDataFrame([(*r, 5) for r in items], "item_id bigint, text string, rank int")
    return sorted((tuple(r) for r in lexical_search.rank(d, q).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    words = [f"W{k}" if k % 3 else f"é{k}" for k in range(80)]
    p = 1 / np.arange(1, 81)
    return [(i, " ".join(rng.choice(words, rng.integers(1, 60), p=p / p.sum()))) for i in range(n)], words


@pytest.mark.parametrize("shard", [37, 16_384])
def test_search_against_all_scores(spark, monkeypatch, shard):
    monkeypatch.setattr(lexical_search, "SHARD_DOCS", shard)
    monkeypatch.setattr(lexical_search, "ITEM_BYTES", 300)
    docs, words = corpus(400, 1)
    docs += [(1000 + i, docs[7][1]) for i in range(60)]  # copies tie
    docs += [(None, docs[3][1]), (5000, None), (5001, ""), (5002, "?! ... "), (3, docs[3][1]), (5003, "w1 " * 20_000)]
    rng = np.random.default_rng(2)
    items = [(i, " ".join(rng.choice(words, 12))) for i in range(20)] + [(50, docs[7][1]), (51, None), (52, ""), (53, "nowhere"), (54, "w1 W1 w2"), (54, "w1 W1 w2"), (54, "é3"), (None, "w4 w5")]
    assert searched(spark, docs, items) == brute_search(docs, items)


def test_search_of_nothing(spark):
    assert searched(spark, [], [(1, "a b")]) == [] == searched(spark, [(1, "a")], [])


def test_sequential_reads_stop_early_and_are_exact(monkeypatch):
    monkeypatch.setattr(lexical_search, "FIRST_BATCH", 1)
    rng = np.random.default_rng(3)
    for _ in range(40):
        docs, terms = int(rng.integers(1, 300)), int(rng.integers(1, 7))
        table = np.where(rng.random((docs, terms)) < 0.4, rng.integers(1, 6, (docs, terms)), 0)
        sizes = (table > 0).sum(1)
        doc, term = np.nonzero(table)
        weights = rng.integers(0, 4, terms) * 100
        shard = lexical_search.Shard(sizes, sizes, term, table[doc, term], weights, docs, int(sizes.sum()))
        whole = np.zeros((docs, terms), np.int64)
        for t in range(terms):
            a, b = shard.start[t], shard.start[t + 1]
            whole[shard.doc[a:b], t] = shard.impact[a:b]
        item = lexical_search.Item(np.arange(terms), rng.integers(1, 3, terms))
        scores = whole @ item.repeats
        enough = int(rng.choice([1, np.median(scores) + 1]))
        want = sorted(((-int(s), i) for i, s in enumerate(scores) if s >= enough))[:10]
        place, score = shard.best(item, enough)
        assert sorted((-int(s), int(i)) for i, s in zip(place, score, strict=True))[:10] == want


# License scans


def test_terms_are_confirmed_byte_by_byte():
    asked = lexical_search.Terms([b"abc", b"abd", b"x"])
    data = np.frombuffer(b"abcabdabexab", np.uint8)
    word, term = asked.find(data, np.array([0, 3, 6, 9, 10]), np.array([3, 6, 9, 10, 12]))
    assert (word.tolist(), term.tolist()) == ([0, 1, 3], [0, 1, 2])
    asked.hashes[:] = asked.hashes[0]  # every hash alike: nothing but equal bytes may pass
    assert set(zip(*(x.tolist() for x in asked.find(data, np.array([6]), np.array([9]))), strict=True)) == set()


def labels(spark, *texts):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, row string, n_words int")
    return [r.asDict() for r in license_scan.scan(df.repartition(2)).orderBy("doc_id").collect()]


def test_phrases(spark):
    got = labels(spark, "The MIT License; see also cc-by, CC\nBY and the Apache  License.", "GNU General Public License", "mit licenses, a cc byte, gnu general public", None, "", "Ümit License")
    assert [(r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got] == [
        (13, 4, 1, 11, "apache,cc-by,mit"), (4, 1, 0, 0, "gpl"), (8, 0, None, None, ""), (0, 0, None, None, ""), (0, 0, None, None, ""), (2, 0, None, None, ""),
    ]
    assert [r["score"] for r in got] == [1.0, 1.0, 0.0, 0.0, 0.0, 0.0]


def test_spans_of_license_texts(spark):
    text = dict((label, t) for label, t in reversed(license_scan.TEMPLATES))
    mit = re.findall(r"[^\W_]+", text["mit"])
    edited = [w for i, w in enumerate(mit) if i % 25] + ["and", "more"]  # every 25th word dropped: diagonals drift
    edited[60:60] = ["new", "words"]
    changed = [w if i % 15 else "xx" for i, w in enumerate(mit)]
    scattered = " ".join(" ".join(mit[i : i + 4]) + " " + prose(i, 30) for i in range(0, len(mit) - 4, 4))
    got = labels(
        spark, prose(1, 200) + " " + text["mit"] + " " + prose(2, 200), " ".join(edited).upper(), " ".join(changed), " ".join(mit[: len(mit) // 2]), scattered,
        text["bsd"] + text["isc"], "Licensed under CC BY-NC 4.0. " * 9, prose(3, 3000), f"{text['gpl']} {prose(4, 20000)} {text['mpl-2.0']}",
    )
    assert [r["labels"] for r in got] == ["mit", "mit", "mit", "", "", "bsd,isc", "cc-by,cc-by-nc-4.0", "", "gpl,mpl-2.0"]
    assert got[0]["score"] == 1.0 and 0.8 <= got[1]["score"] < 1 and got[3]["score"] == 0.0
    assert got[6]["n_spans"] == 9 and got[6]["n_base"] == 9


def test_scan_of_hard_rows(hard_docs, no_docs):
    got = license_scan.scan(hard_docs).collect()
    assert len(got) == hard_docs.count() and license_scan.scan(no_docs).count() == 0
    assert all(r.score == 0 and r.labels == "" for r in got)
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add(r.n_words)
    assert by[9] == {20000} and by[5] == {0} and len(by[10]) == 1
