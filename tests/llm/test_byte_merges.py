import random

import numpy as np
import public_tokenizers
import pytest

from crawlsmith.llm.byte_merges import LONGEST, WORD, ByteMerges
from crawlsmith.llm.token_store import PieceEncoder, wide

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "é", "ö", "th", "ing", "Str", "ß", "ſ", "ǅ", "x", "ÿ", "Q", "ous", "ñ", "tion", "ZZ", "ɏ", "À"]


@pytest.fixture(scope="module")
def encoder():
    return PieceEncoder(PATH)


def test_rounds_give_the_librarys_ids(encoder):
    rng = random.Random(5)
    words = [rng.choice(["", " "]) + "".join(rng.choice(PARTS) for _ in range(rng.randint(1, 9))) for _ in range(20_000)]
    ids, at = encoder.merges.ids([w.encode() for w in words])
    want = encoder.tokenizer.encode_batch_fast(words, add_special_tokens=False)
    assert all(np.array_equal(ids[i:j], w.ids) for i, j, w in zip(at, at[1:], want, strict=False))
    none, at = encoder.merges.ids([])
    assert len(none) == 0 and at.tolist() == [0]


def test_pieces_with_tails_and_all_others(encoder):
    rng = random.Random(6)
    tails = ["", "", ",", ".", "...", "!?", "(", "-", '"', ";:", "'", "'s", "1", "_", "``", "~", "日"]
    pieces = sorted({rng.choice(["", " ", " "]) + "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) + rng.choice(tails) for _ in range(20_000)})
    got = encoder.pieces(pieces)
    assert [got[p] for p in pieces] == encoder.library(pieces)
    assert any(len(p) * 2 > LONGEST for p in pieces) and sum(WORD.fullmatch(p) is None for p in pieces) > 100


def test_texts_of_many_kinds(encoder):
    rng = random.Random(7)
    parts = [" ", " ", "a", "é", "'s", "1", "22", ",", "!", "\n", "日本", "x", " ", "😀", "don't", "A", "_", "word", "\t", "<|endoftext|>", "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    assert encoder.encode(texts) == encoder.library(texts)
    assert encoder.encode(texts[:50]) == encoder.library(texts[:50]) and len(wide(encoder.encode(["a b"])[0], encoder.width)) == 8


def test_other_tokenizers_are_left_to_the_library():
    assert ByteMerges.load(public_tokenizers.path("word_bpe_49k.json")) is None
