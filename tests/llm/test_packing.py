import functools
import os
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from wavequarry.llm.bpe_units import UnitEncoder, added_tokens, load_encoding, segments, units
from wavequarry.llm.packing import best_fit_decreasing, bin_bound, pack, pack_documents

os.environ["TOKENIZERS_PARALLELISM"] = "false"


@functools.cache
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def reference_ids(text):
    return tokenizer().encode(text, add_special_tokens=False).ids


def test_units_equal_the_tokenizer():
    enc = UnitEncoder(load_encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), held=5,
                      added=added_tokens(public_tokenizers.path("byte_bpe_50k.json")))
    rng = random.Random(1)
    pool = ["a", "bc", " ", "\n", "  ", "\t", "'s", "é", "🙂", "12", "!", " ", "\x1c", "\x85", "Word", "<|endoftext|>"]
    texts = ["".join(rng.choices(pool, k=rng.randrange(30))) for _ in range(300)] + ["a b\nc d", "", " ", "x\n", "a<|endoftext|>b", "<|endoftext|><|endoftext|> c", "<|endoftext|", " <|endoftext|>\n"]
    got = enc.encode(texts)
    for t, raw in zip(texts, got):
        assert np.frombuffer(raw, "<u4").tolist() == reference_ids(t), repr(t)
        u = units(t)
        assert u is None or "".join(u) == t


def test_long_text_is_cut_at_blanks():
    text = "ab cd\n\n" * 700_000
    assert "".join(segments(text)) == text and len(segments(text)) > 1


def test_bound_never_exceeds_a_packing():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 60, 300):
        for top in (60, 300, 1023):
            sizes = rng.integers(1, top + 1, n)
            where, bins = best_fit_decreasing(sizes, 1024)
            fills = np.bincount(where, weights=sizes)
            assert fills.max() <= 1024 and len(fills) == bins
            assert -(-sizes.sum() // 1024) <= bin_bound(sizes, 1024) <= bins
    assert bin_bound(np.array([600] * 5), 1024) == 5
    assert bin_bound(np.array([400] * 5), 1024) == 3
    assert bin_bound(np.array([], dtype=int), 1024) == 0


def check(rows, texts):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for own in by.values():
        own.sort(key=lambda r: r["offset"])
        at = 0
        for r in own:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    want = []
    for doc, t in texts:
        ids = reference_ids(t or "") + [2]
        stop = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        at = piece = 0
        while at < len(ids):
            want.append((doc, piece, at, stop - at, zlib.crc32(np.array(ids[at:stop], "<u4").tobytes())))
            at, stop, piece = stop, stop + 1024, piece + 1
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=key) == sorted(want, key=key)
    return len(by)


def test_odd_documents(spark, odd_docs, no_docs):
    rows = pack_documents(odd_docs).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert pack_documents(no_docs).count() == 0


def test_exchange_reaches_the_bound(spark):
    rng = random.Random(5)
    items = [(k, 0, 0, rng.randrange(1, 700), 0, k) for k in range(3000)]
    pieces = spark.createDataFrame(items, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, rid bigint")
    rows = pack(pieces, per_part=100).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(3000))
    seqs = {}
    for r in rows:
        seqs[r["sequence_id"]] = seqs.get(r["sequence_id"], 0) + r["length"]
    bound = -(-sum(x[3] for x in items) // 1024)
    assert max(seqs.values()) <= 1024 and len(seqs) <= 1.01 * bound
