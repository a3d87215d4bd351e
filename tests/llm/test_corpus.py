import hashlib
import os
import re
import subprocess
import sys
import unicodedata
import zlib
from math import comb
from collections import Counter, defaultdict
from html.parser import HTMLParser

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

import corpus_pipeline
from crawlsmith.llm import bpe, fingerprints, html_text, lexicon, minhash_dedup, mixing, quality_classifier, quality_rules, suffix_dedup, token_counts, token_store
from crawlsmith.llm._graph import components
from crawlsmith.llm._store import Tables
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


# Near-duplicates


def brute_components(docs, percent=85):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = defaultdict(list)
    for i, t in docs:
        w = WORD.findall(t.translate(low))
        sets[i].append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    ids = [i for i in sets if i is not None]
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def check_components(docs):
    got = {r.doc_id: r for r in minhash_dedup.near_duplicates(docs).collect()}
    want = brute_components(texts(docs))
    assert {i: r.component_id for i, r in got.items() if i is not None} == want
    assert all(r.kept == (r.component_id == i) for i, r in got.items() if i is not None)
    return got


def test_near_duplicates_of_hard_rows(hard_docs, no_docs):
    got = check_components(hard_docs)
    assert got[None].component_id is None and got[None].kept
    assert got[5].n_shingles == 0 and got[8].n_shingles == 1
    assert minhash_dedup.near_duplicates(no_docs).count() == 0
    kept = minhash_dedup.keep_one(hard_docs)
    assert kept.columns == hard_docs.columns
    assert sorted(i for i, _ in texts(kept) if i) == sorted(set(brute_components(texts(hard_docs)).values()))


@pytest.mark.parametrize("long_list", [2, 64])
def test_families_of_near_copies(spark, monkeypatch, long_list):
    monkeypatch.setattr(minhash_dedup, "LONG_LIST", long_list)
    docs, base = [], prose(11, 220).split()
    for k in range(24):  # a hub and copies with more and more changes: chains and pairs about the threshold
        copy = list(base)
        for j in range(k % 8):
            copy[(37 * j + 11 * k) % len(copy)] = f"edit{k}x{j}"
        docs.append((k, " ".join(copy)))
    shared = prose(12, 60)
    docs += [(100 + k, f"{prose(40 + k, 12 + k)} {shared}") for k in range(20)]
    check_components(spark.createDataFrame(docs, "doc_id bigint, text string"))


def cut_families():
    """Texts of 30 to 70 words, each with one copy that is cut or edited at an end and about as far off as a link may be."""
    docs = []
    for n in range(30, 71):
        for d in range(1, 8):
            w, i = prose(1000 + 100 * n + d, n).split(), 1000 * n + 10 * d
            edited = [*w[: n - d], *(f"e{i}x{j}" for j in range(d))]
            docs += [(i, " ".join(w)), (i + 1, " ".join(w[: n - d] if d % 2 else w[d:]))]
            docs += [(i + 500, " ".join(f"o{x}" for x in w)), (i + 501, " ".join(f"o{x}" for x in edited))]
    return docs


def test_texts_cut_at_their_ends(spark):
    docs = spark.createDataFrame(cut_families(), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(docs).collect()}
    by = dict(texts(docs))
    for i in (i for i in by if i % 10 == 0):
        assert got[i + 1] == brute_components([(i, by[i]), (i + 1, by[i + 1])])[i + 1], (i, len(by[i].split()))


def test_stage_keeps_one_of_eighty_percent(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "LONG_LIST", 4)
    docs = []
    for k in range(8):
        base = prose(700 + k, 200).split()
        for j in range(7):  # each edit parts five of 196 shingles: 0.815 and 0.774 of the base's at four and five
            docs.append((10 * k + j, " ".join(f"edit{k}x{j}x{i}" if i % 20 == 5 and i < 20 * j * (j > 3) else w for i, w in enumerate(base)), "en", "s"))
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string")
    want = brute_components(texts(df), 80)
    assert want != brute_components(texts(df), 85)
    assert {i for i, _ in texts(corpus_pipeline.near_dedup(spark, df, ""))} == set(want.values())


def test_no_task_holds_a_whole_family(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "LONG_LIST", 2)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 6)
    sizes, whole = [], minhash_dedup.blocks

    def counted(lists, labels, tables):
        out = whole(lists, labels, tables)
        sizes.append(max((r["count"] for r in out.groupBy("v", "at", "left", "right", "inner").count().collect()), default=0))
        return out

    monkeypatch.setattr(minhash_dedup, "blocks", counted)
    docs, base = [], prose(31, 220).split()
    for k in range(60):
        copy = list(base) + (prose(900 + k // 20, 10 * (k // 20)).split() if k >= 20 else [])
        for j in range(k % 8):
            copy[(37 * j + 11 * k) % len(copy)] = f"edit{k}x{j}"
        docs.append((k, " ".join(copy)))
    check_components(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert len(sizes) == 2 and max(sizes) <= 5 * 6 < 60


def test_no_linked_sizes_fall_short_of_their_prefixes():
    """Whole sketches: with the fewest shared values that a link can have, one is in both prefixes in any common order."""
    for percent in (80, 85):
        held = minhash_dedup.least_common(percent)
        for a in range(1, 131):
            for b in range(a, 131):
                fewest = next((i for i in range(a + 1) if 100 * i >= percent * (a + b - i)), None)
                if fewest is None or b > minhash_dedup.K:
                    continue
                for n in (a, b):
                    prefix = n - min(held, -(-percent * n // 100)) + 1
                    assert fewest >= n - prefix + 1, (percent, a, b, n)
        assert sum(comb(64, k) * (percent / 100) ** k * (1 - percent / 100) ** (64 - k) for k in range(held)) <= minhash_dedup.MISSED


def test_rows_that_share_an_id(spark):
    base = prose(50, 120)
    rows = [(1, base, "a"), (2, base + " tail", "b"), (7, prose(51, 90), "c"), (7, prose(52, 90), "d"), (7, prose(52, 90), "e"), (None, base, "f"), (None, base, "f")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, row string")
    kept = minhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(1, base), (7, prose(51, 90)), (7, prose(52, 90)), (None, base), (None, base)])


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "a bigint, b bigint")
    with Tables(spark) as tables:
        got = {r.node: r.component for r in components(links, tables).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100}


# Suffix-array dedup


def brute_marks(docs, n):
    """Which bytes of each text lie in a string of n bytes that also starts elsewhere."""
    data = [t.encode() for _, t in docs]
    seen = Counter(d[i : i + n] for d in data for i in range(len(d) - n + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - n + 1):
            if seen[d[i : i + n]] > 1:
                gone[i : i + n] = True
        out.append((d, gone))
    return out


def brute_removal(docs, n=400):
    out = []
    for d, gone in brute_marks(docs, n):
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(d) else 0
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~gone])).hexdigest()))
    return out


def brute_passages(docs, n):
    return [(gone, runs) for _, gone, runs, _ in brute_removal(docs, n)]


@pytest.mark.parametrize(("group", "stretch"), [(1, 600), (3, 1 << 20), (4000, 1 << 20)])
def test_removals(spark, hard_docs, no_docs, monkeypatch, group, stretch):
    """Also with every anchor's places split, down to single offsets, and texts scanned in stretches."""
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    monkeypatch.setattr(suffix_dedup, "MOST", group)
    monkeypatch.setattr(suffix_dedup, "STRETCH", stretch)
    passage = prose(20, 90)
    more = [(200 + k, f"{prose(60 + k, 30)} {passage[k : 700 - k]} {prose(90 + k, 30)}") for k in range(8)] + [(300, "ab" * 700), (301, "x" + "ab" * 300), (302, passage[:400] + passage[100:])]
    more += [(400 + k, f"{prose(160 + k, 20)} {passage[300 + k : 560]} {prose(190 + k, 20)}") for k in range(6)] + [(500, prose(500, 3) + "ab" * 140)]
    small = hard_docs.where("doc_id IS NULL OR doc_id <> 9").select("doc_id", "text").union(spark.createDataFrame(more, "doc_id bigint, text string"))
    docs = texts(small)
    want = Counter((i, *r, *s) for (i, _), r, s in zip(docs, brute_removal(docs), brute_passages(docs, 250), strict=True))
    got = suffix_dedup.removals(small).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes", "n_passages")) for r in got) == want
    left = suffix_dedup.remove(small, 250)
    assert Counter(hashlib.sha256(t.encode()).hexdigest() for _, t in texts(left)) == Counter(r[3] for r in brute_removal(docs, 250))


def test_removals_at_the_edges_of_windows(spark):
    """Shared strings just under, at and over the lengths, at starts, ends and within of texts, beside equal and other bytes."""
    rng = np.random.default_rng(5)
    noise = lambda n, letters=20: bytes(rng.integers(97, 97 + letters, n, dtype=np.uint8)).decode()
    rows = []
    for n in (249, 250, 251, 262, 399, 400, 401, 413, 700):
        x = noise(n)
        rows += [x + noise(300), noise(300) + x, noise(150) + x + noise(150), noise(40) + x[:-1], x[1:] + noise(1, 2)]
    rows += [noise(900, 2) for _ in range(6)] + ["".join(noise(9, 2) * 40 + noise(60) for _ in range(3)) for _ in range(6)]
    docs = [(k, t) for k, t in enumerate(rows)]
    want = Counter((i, *r, *s) for (i, _), r, s in zip(docs, brute_removal(docs), brute_passages(docs, 250), strict=True))
    got = suffix_dedup.removals(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes", "n_passages")) for r in got) == want


def test_windows_of_an_anchor():
    """Each window has the anchors of its least hash, and no anchor has another's windows."""
    texts_ = [prose(1, 200).encode(), b"ab" * 300, b"x" * 500, prose(2, 20).encode(), prose(1, 90).encode()]
    offsets, data = np.cumsum([0, *map(len, texts_)]), np.frombuffer(b"".join(texts_), np.uint8)
    for shortest in (250, 400):
        row, at, gram, (least, most, _, _) = suffix_dedup.find_anchors(data, offsets, shortest)
        hashed = {int(p): int(g) for p, g in zip(at, gram, strict=True)}
        got = {(int(p - o), int(p)) for p, a, b in zip(at, least, most, strict=True) for o in range(a, b + 1)}
        want = set()
        for r in range(len(texts_)):
            for s in range(offsets[r], offsets[r + 1] - shortest + 1):
                own = [p for p in range(s, s + shortest - suffix_dedup.GRAM + 1) if p in hashed]
                want |= {(s, p) for p in own if hashed[p] == min(hashed[q] for q in own)}
        assert got == want and want


def test_bytes_that_repeats_move(spark):
    """Texts that share nothing, and those one in twenty that share a passage, move under 45 % of their bytes; half, when digests went with each anchor."""
    rng = np.random.default_rng(9)
    words = np.array(["".join(map(chr, rng.integers(97, 123, n))) for n in rng.integers(3, 9, 3000)])
    passages = [" ".join(rng.choice(words, 80)) for _ in range(10)]
    texts_ = [" ".join(rng.choice(words, 800)) for _ in range(400)]
    docs = [(k, t + passages[k // 20 % 10] if k % 20 == 0 else t) for k, t in enumerate(texts_)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    sc = spark.sparkContext._jsc.sc()

    def moved():
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorSummary("driver").totalShuffleWrite()

    before = moved()
    assert suffix_dedup.removals(df).where("n_removed > 0").count() == 20
    size = sum(len(t) for _, t in docs)
    assert moved() - before < 0.45 * size, (moved() - before) / size


def test_removal_of_hard_rows(hard_docs, no_docs):
    assert suffix_dedup.removals(no_docs).count() == 0
    left = suffix_dedup.remove(hard_docs)
    assert left.columns == hard_docs.columns and left.count() == hard_docs.count()
    odd = hard_docs.withColumnRenamed("stats", "__text").withColumnRenamed("digest", "row").withColumnRenamed("size", "copies")
    assert suffix_dedup.remove(odd).columns == odd.columns
    assert suffix_dedup.remove(odd).where("__text = 'x' AND copies = 'y' AND row = 'z'").count() == hard_docs.count()


def test_memory_of_the_most_places_of_one_anchor():
    """As many places as one task may sort, of one passage in texts of their own."""
    code = (
        "import resource, numpy as np, pyarrow as pa\n"
        "from crawlsmith.llm import suffix_dedup as s\n"
        "n, rng = s.MOST, np.random.default_rng(1)\n"
        "size = 2 * s.LENGTH - s.GRAM\n"
        "data = rng.integers(97, 123, (n, size), dtype=np.uint8)\n"
        "data[:, 150:500] = data[0, 150:500]\n"
        "around = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * size, size, dtype=np.int32)), pa.py_buffer(data.tobytes())])\n"
        "before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
        "places = pa.ListArray.from_arrays(pa.array(range(n + 1), pa.int32()), pa.array([s.LENGTH - s.GRAM] * n, pa.int32()))\n"
        "found = s.repeated_windows(s.Suffixes(np.zeros(n, np.int64), np.zeros(n, np.int32), places, around), (400, 250))\n"
        "assert len(found) == n, len(found)\n"
        "print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)\n"
    )
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.path.dirname(corpus_pipeline.__file__))
    assert int(out.stdout.split()[-1]) < 700_000  # kB


def test_stretches_of_a_text_have_its_anchors(monkeypatch):
    import pyarrow as pa

    column = pa.array([prose(5, 3000), "short", None, "ab" * 900])
    whole = [x for a, b, _, (ends, places, grams) in suffix_dedup.scan(column, (400, 250)) for x in zip(places.tolist(), grams.tolist(), strict=True)]
    monkeypatch.setattr(suffix_dedup, "STRETCH", 700)
    parts = [x for a, b, _, (ends, places, grams) in suffix_dedup.scan(column, (400, 250)) for x in zip(places.tolist(), grams.tolist(), strict=True)]
    assert set(whole) <= set(parts) and len(whole) > 200  # equal surroundings are settled within a stretch only


def test_suffix_sort_and_collisions(monkeypatch):
    import pyarrow as pa

    data = [prose(k % 3, 160).encode() for k in range(7)]
    s = suffix_dedup.Suffixes(np.zeros(7, np.int64), np.zeros(7, np.int32), pa.array([[350]] * 7, pa.list_(pa.int32())), pa.array(data, pa.binary()))
    order = s.sorted()
    assert [data[i][350:750] for i in order] == sorted(d[350:750] for d in data)
    windows = lambda found: {(i, n, o) for i, n, a, b in found for o in range(a, b + 1)}
    want = windows(suffix_dedup.exact_windows(s, (400, 250)))
    assert windows(suffix_dedup.repeated_windows(s, (400, 250))) == want and want
    monkeypatch.setattr(suffix_dedup.Suffixes, "hashed", lambda self, i, start, end: np.zeros(len(start), np.uint64))  # everything collides
    assert windows(suffix_dedup.repeated_windows(s, (400, 250))) == want


# Tokens


def test_bpe_is_the_library(hard_docs, no_docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    lex = bpe.build_lexicon(hard_docs, path)
    got = Counter((r.doc_id, bytes(r.ids), r.decoded) for r in bpe.encode(hard_docs, path, lex).collect())
    want = Counter()
    for i, t in texts(hard_docs):
        ids = library.encode(t, add_special_tokens=False).ids
        want[i, np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)] += 1
    assert got == want
    assert bpe.encode(no_docs, path, lex).count() == 0


def test_lexicon_holds_the_whole_vocabulary(spark, hard_docs, no_docs, tmp_path):
    """No sample of the documents decides what is in it: each word that the vocabulary holds whole is, with its ids."""
    path = public_tokenizers.path("word_bpe_49k.json")
    (tmp_path / "l").write_bytes(built := bpe.build_lexicon(hard_docs, path))
    assert built == bpe.build_lexicon(no_docs, path) == bpe.build_lexicon(spark.range(3).selectExpr("id AS doc_id", "'ring' AS text"), path)
    library, lex = Tokenizer.from_file(path), lexicon.Lexicon(str(tmp_path / "l"))
    words = [t.removesuffix("</w>") for t in library.get_vocab() if t.endswith("</w>") and t.isascii() and t == t.lower() and t.removesuffix("</w>").isalpha()]
    assert len(words) > 10_000
    for w in words:
        assert lex.get(w.encode()) == library.encode(w, add_special_tokens=False).ids


def test_words_of_all_documents_are_counted(spark, hard_docs, no_docs, tmp_path, monkeypatch):
    """What is frequent among all words of all texts is in the lexicon of op5, also words of several tokens; other words are merged."""
    from crawlsmith.llm import queries

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = hard_docs.select("doc_id", "text").union(spark.range(6000).selectExpr("id + 100", "concat('Zzqxring! Ünz', id, ' <|endoftext|>zzqxring')"))
    own, want = bpe.Encoder(path, None), Counter()
    for _, text in texts(docs):
        for part in text.split("<|endoftext|>"):
            want.update(p for w in own.split(part) for p in own.pieces(w))
    assert {r.word: r.n for r in bpe.word_counts(docs, path).collect()} == want
    assert bpe.word_counts(no_docs, path).count() == 0 and bpe.frequent_words(no_docs, path) == []
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    built = []
    monkeypatch.setattr(bpe, "compile_words", lambda entries: lexicon.compile_words(built.append(dict(entries)) or entries))
    got = queries.op5_bpe(spark, str(tmp_path))
    library, total = Tokenizer.from_file(path), want.total()
    frequent = {w.encode() for w, n in want.items() if n > 1 and n * bpe.FREQUENT >= len(w.encode()) * total}
    assert b"zzqxring" in frequent and len(library.encode("zzqxring", add_special_tokens=False).ids) > 1 and len(frequent) < len(want)
    assert set(built[-1]) == frequent | {unicodedata.normalize("NFC", w).encode() for w in bpe.whole_words(bpe.Merger(path))}
    ids = {i: library.encode(t, add_special_tokens=False).ids for i, t in texts(docs) if i is not None and i != 10}
    assert {r.doc_id: r.ids_sha256 for r in got.collect() if r.doc_id in ids} == {i: hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest() for i, x in ids.items()}


def test_lexicon_file_in_a_relative_folder(tmp_path, monkeypatch):
    """Executors call their folder "."; both paths of the rename must be spelled alike, as they may else be on two devices."""
    path, moves, replace = public_tokenizers.path("word_bpe_49k.json"), [], os.replace
    monkeypatch.chdir(tmp_path)
    monkeypatch.setattr(bpe.SparkFiles, "getRootDirectory", lambda: ".")
    monkeypatch.setattr(bpe.os, "replace", lambda a, b: (moves.append((a, b)), replace(a, b)))
    monkeypatch.setattr(bpe, "_encoders", {})
    own = bpe.encoder(path, "words", lexicon.compile_words([(b"ring", [7])]))
    assert own.lexicon.get(b"ring") == [7] and (tmp_path / "words.lexicon").exists()
    assert [(os.path.dirname(a), os.path.dirname(b)) for a, b in moves] == [(str(tmp_path), str(tmp_path))]


def test_lexicon(tmp_path):
    words = {f"{a}{b}ing".encode(): [len(a), k] for k, a in enumerate(["r", "s", "st", "str", ""]) for b in ("", "ea", "o")}
    (tmp_path / "l").write_bytes(lexicon.compile_words(list(words.items())))
    lex = lexicon.Lexicon(str(tmp_path / "l"))
    assert all(lex.get(w) == ids for w, ids in words.items())
    assert lex.get(b"") is None and lex.get(b"stri") is None and lex.get(b"stringing") is None
    assert len(lex.first) < sum(map(len, words))  # suffixes are shared
    (tmp_path / "e").write_bytes(lexicon.compile_words([]))
    assert lexicon.Lexicon(str(tmp_path / "e")).get(b"a") is None


def test_token_shards(spark, hard_docs, no_docs, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    folder = f"file://{tmp_path}/shards"
    manifest = token_store.write(hard_docs, path, 2, folder)
    got = token_store.read(manifest, folder).collect()
    at = 0
    order = sorted(texts(hard_docs), key=lambda r: (r[0] is None, r[0] or 0))
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == [i for i, _ in order]
    want = Counter((i, np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in order)
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == want
    for r in got:
        assert (r.start, r.ids_crc32) == (at, zlib.crc32(bytes(r.ids)))
        at += r.n_tokens
    keys = spark.createDataFrame([(10,), (4,), (77,), (None,)], "doc_id bigint")
    assert Counter(r.doc_id for r in token_store.lookup(manifest, folder, keys).collect()) == {10: 2, 4: 1}
    empty = token_store.write(no_docs, path, 2, f"{folder}-none")
    assert token_store.read(empty, f"{folder}-none").count() == 0


def test_minimal_perfect_hash():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 400):
        keys = np.unique(rng.integers(-(2**62), 2**62, n))
        _, slot = token_store.build_hash(keys)
        assert sorted(slot) == list(range(len(keys)))


def test_token_counts(hard_docs, no_docs, tmp_path):
    path, cache = public_tokenizers.path("piece_bpe_32k.model"), str(tmp_path / "cache")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    want = Counter((i, len(t.encode()), len(sp.encode(t))) for i, t in texts(hard_docs))
    for _ in range(2):
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(hard_docs, path, cache).collect()) == want
        stored = hard_docs.sparkSession.read.parquet(cache)
        assert stored.count() == len({t for _, t in texts(hard_docs)})  # the second run encodes nothing
    assert token_counts.count_tokens(no_docs, path, cache).count() == 0


# Quality, mixing, fingerprints, HTML


def test_quality_rules(hard_docs, no_docs):
    got = {r.doc_id: r for r in quality_rules.assess(hard_docs).collect()}
    for i, t in texts(hard_docs):
        w = WORD.findall(t)
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(cover), len(lines) - len(set(lines)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t)
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert got[12].base_failed and got[1].kept
    kept = quality_rules.keep_clean(hard_docs)
    assert kept.columns == hard_docs.columns
    assert Counter(i for i, _ in texts(kept)) == Counter(r.doc_id for r in quality_rules.assess(hard_docs).collect() if r.kept)
    assert quality_rules.assess(no_docs).count() == 0


def test_outliers_are_rejected(spark):
    docs = [(k, prose(k, 150 + k), "en", "s") for k in range(120)] + [(900 + k, " ".join(x + "&&&" for x in prose(k, 150).split()), "en", "s") for k in range(12)]
    got = {r.doc_id: r.kept for r in quality_rules.assess(spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string")).collect()}
    assert all(got[k] for k in range(120)) and not any(got[900 + k] for k in range(12))


def test_rare_sources_are_judged_against_all(spark):
    spam = lambda k: " ".join(x + "&&&" for x in prose(k, 150).split())
    docs = [(k, prose(k, 150 + k), "en", "s") for k in range(120)] + [(800, spam(800), "en", "lone"), (801, prose(801, 160), "en", "fine")] + [(900 + k, spam(900 + k), None, "few") for k in range(5)]
    got = {r.doc_id: r.kept for r in quality_rules.assess(spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string")).collect()}
    assert all(got[k] for k in range(120)) and got[801]
    assert not got[800] and not any(got[900 + k] for k in range(5))


def test_mixing(spark, hard_docs, no_docs):
    docs = [(k, prose(k, 20 + k % 30), "abc"[k % 3] if k % 50 else None) for k in range(600)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    got = mixing.copies(df).collect()
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert 0 <= r.taken <= 3 * r.size
    for own in by.values():
        assert abs(sum(r.taken for r in own) - own[0].target) <= 2 * max(r.size for r in own)
    assert abs(sum(own[0].target for own in by.values()) - sum(r.size for r in got)) < 1e-6 * sum(r.size for r in got)
    assert rows(mixing.copies(df.repartition(7)), "doc_id", "taken") == rows(mixing.copies(df), "doc_id", "taken")
    assert mixing.copies(hard_docs).count() == hard_docs.count() and mixing.copies(no_docs).count() == 0
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    assert sum(len(t.split()) for _, t in texts(mixed)) == sum(r.taken for r in got)


def test_fingerprints(hard_docs, no_docs):
    got = fingerprints.compare_edited(hard_docs).collect()
    assert len(got) == hard_docs.count()
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == by[2].fingerprint and by[2].near_next > 0.9
    order = sorted((r for r in texts(hard_docs) if r[0] is not None and r[0] not in (10,)), reverse=True)
    (_, a), (_, b) = order[0], order[1]
    n = len(a) // 3
    assert by[order[0][0]].edited_sha256 == hashlib.sha256((a[: len(a) - n] + b[:n]).encode()).hexdigest()
    assert by[5].fingerprint == "" and 0 <= by[3].near_edited <= 1
    assert fingerprints.compare_edited(no_docs).count() == 0


def test_classifier(spark, hard_docs, no_docs):
    docs = [(k, prose(k, 80) if k % 2 else " ".join(w + "&&&" for w in prose(k, 80).split())) for k in range(400)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)] + [(None, 1), (5, None)], "doc_id bigint, quality int")
    got = quality_classifier.classify(df, labels).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.predicted == r.doc_id % 2 for r in held) >= 0.97 * len(held)
    assert quality_classifier.classify(hard_docs, labels).count() == hard_docs.count()
    assert {r.score for r in quality_classifier.classify(hard_docs, labels.where("false")).collect()} == {0.5}
    assert quality_classifier.classify(no_docs, labels).count() == 0


def slow_ftrl(rows):
    """The updates one feature at a time, in dictionaries."""
    q = quality_classifier
    z, n = defaultdict(float), defaultdict(float)
    weight = lambda i: 0.0 if abs(z[i]) <= q.L1 else (np.sign(z[i]) * q.L1 - z[i]) / ((q.BETA + n[i] ** 0.5) / q.ALPHA + q.L2)
    for _ in range(q.PASSES):
        for counts, label in rows:
            x = {i: c * q.SCALE / max(sum(counts.values()), 1) for i, c in counts.items()} | {1 << q.BITS: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + np.exp(-np.clip(sum(w[i] * v for i, v in x.items()), -35, 35)))
            for i, v in x.items():
                g = (p - label) * v
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / q.ALPHA * w[i]
                n[i] += g * g
    return {i: weight(i) for i in list(z)}


def test_updates_one_by_one():
    rng = np.random.default_rng(5)
    rows = [(dict(Counter(rng.integers(0, 40, 30).tolist())), int(k % 3 == 0)) for k in range(60)] + [({}, 1)]
    arrays = [(np.array(sorted(c), np.uint32), np.array([c[i] for i in sorted(c)], np.uint32), y) for c, y in rows]
    got, want = quality_classifier.train(lambda: iter([arrays[:25], arrays[25:]])), slow_ftrl(rows)
    assert all(abs(got[i] - w) < 1e-5 for i, w in want.items()) and np.count_nonzero(got) <= len(want)


def test_classifier_learns_once_from_repeated_rows(spark):
    docs = spark.createDataFrame([(k, prose(k, 40)) for k in range(40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(8, 1)], "doc_id bigint, quality int")
    one = {r.doc_id: r.score for r in quality_classifier.classify(docs, labels).collect()}
    twice = {r.doc_id: r.score for r in quality_classifier.classify(docs.union(docs), labels.union(labels)).collect()}
    assert one == twice


def test_merged_and_contained_fingerprints(spark):
    whole, part = prose(70, 600), " ".join(prose(70, 600).split()[:200])
    rows = fingerprints.compare_edited(spark.createDataFrame([(2, part), (1, whole)], "doc_id bigint, text string"))
    got = {r.doc_id: r for r in rows.collect()}
    assert got[2].held_by_next == 1.0 and got[1].holds_next == 1.0 and got[2].holds_next < 0.5 and got[2].near_next == got[1].near_next
    merged = rows.agg(fingerprints.merge("fingerprint").alias("f")).first().f
    assert merged == got[1].fingerprint  # the part adds nothing


def test_html_of_odd_rows(spark):
    pages = spark.createDataFrame([(1, "<p>x" * 40000, "a", "b"), (2, "<b>" * 20000 + "y", "a", "b")], "page_id bigint, html string, title string, text string")
    got = {r.page_id: r for r in html_text.extract_text(pages).collect()}
    assert got[1].n_blocks == 40000 and got[2].text == "y"
    assert html_text.extract_text(pages.where("false")).count() == 0


def test_html(spark):
    page = "<title>T</title><p>a<p>b <b>c</b><ul><li>x<li>y<ol><li>n</ol></ul><table><tr><th>k<th>value<tr><td>longer<td>1</table><div hidden>no</div><pre>1\n  2</pre><script>'</p>'</script>z"
    assert html_text.extract(page) == ("T", "a\n\nb c\n\n- x\n- y\n  1. n\n\nk      | value\nlonger | 1\n\n1\n  2\n\nz", 10)
    assert html_text.extract("<div style='display:none'>x</div><details><summary>s</summary>t</details>a<br>b")[1] == "s\n\na\nb"
    assert html_text.extract("<div>" * 5000 + "deep")[1] == "deep"
    assert html_text.extract("1 < 2 & <\"x' y")[1]
    pages = spark.createDataFrame([(1, None), (None, ""), (2, "<p>x"), (2, "<p>x")], "page_id bigint, html string")
    assert rows(html_text.extract_text(pages), "page_id", "text") == sorted([(1, None), (None, ""), (2, "x"), (2, "x")], key=str)


def test_all_that_is_in_a_table_is_kept():
    text = lambda page: html_text.extract(f"<table>{page}</table>")[1]
    assert text("<tr><form><td>a</td><td>b</td></form></tr>") == "a | b"
    assert text("<tbody><form><tr><td>a<td>b</tr><tr><td>c<td>d</tr></form></tbody>") == "a | b\nc | d"
    assert text("<tr><a><span><td>a</td></span></a><div><th>b</th></div></tr>") == "a | b"
    assert text("<tbody>t <tr>r <td>a</td><b>x</b></tr><p>y</p></tbody>").split() == ["t", "r", "x", "y", "a"]
    assert text("<tr><div hidden><td>no</td></div><td>a</td></tr><details><summary>s</summary><p>no</p></details>").split() == ["s", "a"]
    assert text("<tr><td><table><tr><form><td>in</form></table></td><td>b</td></tr>") == "in | b"


def test_what_is_hidden_and_what_is_seen():
    text = lambda page: html_text.extract(page)[1]
    assert text("<div>" * 3000 + "<div hidden>SECRET</div>seen") == "seen"
    assert text("<p hidden/>SECRET<p>seen") == "seen"
    assert text("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b><i>no</i></div>") == "yes"
    assert text("<table><tr style='visibility:collapse'><td>no</td><td style='visibility:visible'>yes</td></tr></table>").strip() == "| yes"
    assert text("<select><option>a<option>b</select><textarea>t</textarea><svg><g/><title>no</title><text>drawn</text></svg>").split() == ["a", "b", "t", "drawn"]
    assert text("<pre>a<table><tr><td>1</td><td>2</td></tr></table>b<p>c</p></pre>").split("\n") == ["a", "", "1 | 2", "", "b", "", "c"]
    assert text("<pre>\n\n  x\n\n y<br>z\n\n</pre>after") == "  x\n\n y\nz\n\nafter"


class Words(HTMLParser):
    """Visible words by the stdlib's parser, for pages whose markup hides nothing but by element, attribute or style."""

    hidden = ("script", "style", "head", "template", "noscript", "title", "iframe", "object", "video", "audio", "canvas", "datalist", "noembed", "noframes", "map")
    void = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")

    def __init__(self):
        super().__init__()
        self.stack, self.words = [], []

    def handle_starttag(self, tag, attrs):
        own = dict(attrs)
        if tag in self.void:
            self.words += (own.get("alt") or "").split() if tag == "img" and not any(x for _, x in self.stack) else []
            return
        self.stack.append((tag, tag in self.hidden or "hidden" in own or bool(re.search(r"display\s*:\s*none", own.get("style") or ""))))

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                return

    def handle_data(self, data):
        if not any(x for _, x in self.stack):
            self.words += data.split()


def test_all_pages_against_the_stdlib(spark):
    """Every visible word of every page, as a multiset; marks of lists and cells are the layout's own."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    got = {r.page_id: r.text for r in html_text.extract_text(pages).collect()}
    marks = re.compile(r"^\d+\.$|^[-|>]$")
    for i, page in html.items():
        if page is None or re.search("visibility|<details", page):
            continue
        own = Words()
        own.feed(page)
        own.close()
        keep = lambda words: Counter(w for w in words if not marks.match(w))
        assert keep(re.sub(r"\s", " ", " ".join(got[i].split())).split()) == keep(own.words), i


# Pipeline


def test_pipeline_stages(spark, hard_docs, no_docs):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "minhash near-dedup", "suffix-array dedup", "mix sources", "bpe"]
    for docs in (hard_docs, no_docs):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, "")
            out.count()
            if k < 4:
                assert out.columns == hard_docs.columns
                docs = out


def test_pipeline_against_brute_force(spark, tmp_path):
    """Each stage by another way: DuckDB's SQL, all pairs, all windows, and the tokenizer's library."""
    passage = prose(800, 45)
    docs = [(k, prose(k, 60 + k % 70), ("en", "de", None)[k % 3], "abcd"[k % 4]) for k in range(90)]
    docs += [(100 + k, docs[k][1] + f" tail{k}", "en", "a") for k in range(8)] + [(120 + k, f"{prose(900 + k, 40)} {passage} {prose(950 + k, 40)}", "en", "b") for k in range(6)]
    docs += [(140, "spam " * 200, "en", "a"), (141, " ".join(x + "&&&" for x in prose(141, 150).split()), "en", "a"), (142, None, "en", "a"), (143, "few words", "de", "b")]
    frame = pd.DataFrame([(*d, len(d[1] or "")) for d in docs], columns=["doc_id", "text", "lang", "source", "n_chars"])
    frame.to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()

    def sql(query, rows):
        con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"]))
        return con.sql(query).df()

    verdict = sql(quality_rules.oracle_sql(), docs)
    clean = set(verdict.doc_id[verdict.kept])
    rows = [d for d in docs if d[0] in clean]
    assert not clean & {140, 141, 142, 143} and len(rows) > 90
    groups = brute_components([(d[0], d[1]) for d in rows], corpus_pipeline.NEAR_PERCENT)
    rows = [d for d in rows if groups[d[0]] == d[0]]
    assert len(rows) < len(clean)
    left = [bytes(np.frombuffer(b, np.uint8)[~gone]).decode("utf-8", "ignore") for b, gone in brute_marks([(d[0], d[1]) for d in rows], suffix_dedup.PASSAGE)]
    assert sum(map(len, left)) < sum(len(d[1]) for d in rows)
    rows = [(d[0], t, *d[2:]) for d, t in zip(rows, left, strict=True)]
    mixed = sql(mixing.ORACLE_SQL, rows)
    copies = {i: round(t / s) for i, t, s in zip(mixed.doc_id, mixed.taken, mixed["size"], strict=True) if s}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, t, *_ in rows:
        want[i, np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()] += copies.get(i, 0)
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == +want
    assert all(r.n_tokens == len(r.ids) // 4 for r in got)


def test_long_clean_documents_stay(spark):
    docs = [(k, prose(k, 150 + k), "en", "s") for k in range(120)] + [(500, prose(500, 30000), "en", "s")]
    got = {r.doc_id: r.kept for r in quality_rules.assess(spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string")).collect()}
    assert got[500] and all(got.values())
