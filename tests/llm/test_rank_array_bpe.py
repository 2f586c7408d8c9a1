import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wavequarry.llm import rank_array_bpe
from wavequarry.llm.rank_array_bpe import SHORT, WordTokenizer, decode_ids, encode_words, stretches

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return WordTokenizer(PATH)


def ids_of(own, text):
    return [k for part in own.encode(text) for k in part.tolist()]


def check(rows, docs, library):
    want = []
    for doc, t in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((doc, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted((tuple(r)[:4] for r in rows), key=key) == sorted(want, key=key)


def test_odd_documents(spark, odd_docs, no_docs, library):
    check(encode_words(odd_docs).collect(), [(r["doc_id"], r["text"]) for r in odd_docs.collect()], library)
    assert encode_words(no_docs).count() == 0


def test_random_texts_equal_the_library(own, library):
    rnd = random.Random(5)
    letters = ["a", "b", "th", "in", "ing", "er", "'", "'s", "'LL", "É", "é", "Σ", "ς", "İ", "ß", "1", "²", "-", "...", "🙂", "中", "‍", "<|endoftext|>", "<|startoftext|>", "<|", "|>",
               " ", "  ", "\n", "\t", "\x1c", "\x85", " ", " ", "　", "\0", "﻿", "ﬁ", "Ⅷ", "ẞ", "ͅ"]
    for _ in range(3000):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40)))
        assert ids_of(own, text) == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_quick_units_equal_the_library(own, library):
    assert own._quick
    rnd = random.Random(6)
    letters = [chr(k) for k in [*range(0x21, 0x7F), *range(0xC0, 0x100)]] + ["'s", "'LL", "the"] * 8
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 12))) for _ in range(4000)]
    text = " ".join(texts)
    assert ids_of(own, text) == library.encode(text, add_special_tokens=False).ids
    for got, t in zip(own.texts(texts), texts, strict=True):
        assert [k for part in got for k in part.tolist()] == library.encode(t, add_special_tokens=False).ids, t


def test_every_length_around_the_limit_of_short_words(own, library):
    rnd = random.Random(7)
    for n in [*range(1, 20), SHORT - 1, SHORT, SHORT + 1, 2 * SHORT, 3000]:
        for alphabet in ("a", "ab", "thein", "abcdefghijklmnopqrstuvwxyz"):
            word = "".join(rnd.choice(alphabet) for _ in range(n))
            assert ids_of(own, word) == library.encode(word, add_special_tokens=False).ids
            raw = word.encode()
            assert own.arrays.encode_long(raw).tolist() == own.arrays._encode_matrix([raw], 4096)[0].tolist()


def test_merges_against_plain_code(own):
    """Scan, merge, scan again, from the definition."""
    arrays, rnd = own.arrays, random.Random(3)
    joined = {int(k): (int(r), int(arrays._joined[r])) for k, r in zip(arrays._keys, arrays._rank, strict=True)}
    words = ["".join(rnd.choice("aeinrst") for _ in range(rnd.randint(1, 24))).encode() for _ in range(400)]
    for word, got in zip(words, arrays.encode(words), strict=True):
        parts = arrays.symbols(word).tolist()
        while True:
            found = min(((joined[k][0], i) for i, k in enumerate(a * arrays._width + b for a, b in zip(parts, parts[1:], strict=False)) if k in joined), default=None)
            if found is None:
                break
            i = found[1]
            parts[i:i + 2] = [joined[parts[i] * arrays._width + parts[i + 1]][1]]
        assert got.tolist() == parts


def test_forgetting_and_stretches_change_nothing(library, monkeypatch):
    small = WordTokenizer(PATH, held=3)
    texts = ["one two three four five", "Five FOUR three\ntwo one <|endoftext|> one", "x" * 500 + " " + "y" * 400]
    monkeypatch.setattr(rank_array_bpe, "STRETCH", 8)
    monkeypatch.setattr(rank_array_bpe.stretches, "__defaults__", (8,))
    for t in texts * 2:
        assert ids_of(small, t) == library.encode(t, add_special_tokens=False).ids
        assert "".join(stretches(t, 5)) == t


def test_very_long_texts_repeated_rows_and_ids(spark, library):
    docs = [(0, "Don't stop, 12345 words\n" * 60_000), (1, None), (1, ""), (None, "z" * 300_000), (2, " \n "), (3, "same"), (3, "same")]
    rows = encode_words(spark.createDataFrame(docs, "doc_id bigint, text string"), keep_ids=True).collect()
    check(rows, docs, library)
    for r in rows:
        if r["n_tokens"] < 100:
            assert decode_ids(r["ids"]) == library.decode(r["ids"], skip_special_tokens=False)
