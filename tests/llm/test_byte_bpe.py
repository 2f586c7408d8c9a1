import hashlib

import numpy as np
import public_tokenizers

from wavequarry.llm.bpe_units import load_encoding
from wavequarry.llm.byte_bpe import decode_ids, encode_and_decode, token_bytes

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def check(rows, docs):
    enc = load_encoding(PATH, public_tokenizers.PATTERN)
    want = []
    for doc, t in docs:
        ids = np.array(enc.encode_ordinary(t or ""), "<u4").tobytes()
        want.append((doc, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted((tuple(r)[:4] for r in rows), key=key) == sorted(want, key=key)


def test_odd_documents(spark, odd_docs, no_docs):
    check(encode_and_decode(odd_docs).collect(), [(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert encode_and_decode(no_docs).count() == 0


def test_many_blocks_and_a_hot_text(spark):
    docs = [(k, "hot text, many times" if k % 3 == 0 else f"own words {k} and some more {k * 7919}") for k in range(240)]
    rows = encode_and_decode(spark.createDataFrame(docs, "doc_id bigint, text string"), block_chars=500, keep_ids=True).collect()
    check(rows, docs)
    texts = dict(docs)
    assert all(decode_ids(np.array(r["ids"], "<u4"), PATH).decode() == texts[r["doc_id"]] for r in rows)


def test_every_token_of_the_table_round_trips():
    enc = load_encoding(PATH, public_tokenizers.PATTERN)
    flat, ends = token_bytes(PATH)
    assert len(ends) == enc.n_vocab + 1
    for k in range(enc.n_vocab):
        assert enc.decode_single_token_bytes(k) == flat[ends[k]:ends[k + 1]].tobytes()


def test_one_very_long_text_among_short_ones(spark):
    docs = [(0, "don't stop, 12345 words\n" * 120_000), (1, ""), (2, "short"), (None, "x" * 3000), (3, " \t\n odd  space ")]
    check(encode_and_decode(spark.createDataFrame(docs, "doc_id bigint, text string"), block_chars=1000).collect(), docs)
