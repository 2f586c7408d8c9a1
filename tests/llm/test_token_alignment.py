import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from wavequarry.llm import token_alignment
from wavequarry.llm.rank_array_bpe import byte_letters
from wavequarry.llm.token_alignment import Aligner, align_tokens, stretches, units

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plain(libraries, docs):
    """Whole texts, token spans compared with each other one by one."""
    a, b = libraries
    letter = {c: k for k, c in enumerate(byte_letters())}

    def spans(parts):
        at, out = 0, []
        for k, raw in parts:
            out.append((k, at, at + len(raw)))
            at += len(raw)
        return out, b"".join(raw for _, raw in parts)

    rows, count = [], Counter()
    for doc, text in docs:
        whole = (" " + text).encode() if text else b""
        tokens_a = [(k, bytes(letter[c] for c in a.id_to_token(k))) for k in a.encode(" " + text, add_special_tokens=False).ids] if text else []
        tokens_b = []
        for k in b.encode(text) if text else []:
            piece = b.id_to_piece(k)
            tokens_b.append((k, bytes([int(piece[3:5], 16)]) if b.is_byte(k) else piece.replace("▁", " ").encode()))
        (sa, ra), (sb, rb) = spans(tokens_a), spans(tokens_b)
        if not text or ra != whole or rb != whole:
            rows.append((doc, 0, 0, 0, [], ""))
            continue
        links, j0 = [], 0
        for k, s, e in sa:
            while sb[j0][2] <= s:
                j0 += 1
            j = j0
            while j < len(sb) and sb[j][1] < e:
                links.append((k, sb[j][0]))
                j += 1
        cuts = sorted({e for _, _, e in sa} & {e for _, _, e in sb})
        groups, i, j = [], 0, 0
        for c in cuts:
            ga, gb = [], []
            while i < len(sa) and sa[i][2] <= c:
                ga.append(str(sa[i][0]))
                i += 1
            while j < len(sb) and sb[j][2] <= c:
                gb.append(str(sb[j][0]))
                j += 1
            groups.append(",".join(ga) + "|" + ",".join(gb))
        count.update(links)
        rows.append((doc, len(sa), len(sb), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    high = {}
    for (_, k), n in count.items():
        high[k] = max(high.get(k, 0), n)
    return [(doc, na, nb, ng, len(x), sum(count[p] == high[p[1]] for p in x), sum(count[p] for p in x), sha) for doc, na, nb, ng, x, sha in rows]


def check(rows, docs, libraries):
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    got = [(r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in rows]
    assert sorted(got, key=key) == sorted(plain(libraries, docs), key=key)


def test_odd_documents(spark, odd_docs, no_docs, libraries):
    check(align_tokens(odd_docs).collect(), [(r["doc_id"], r["text"]) for r in odd_docs.collect()], libraries)
    assert align_tokens(no_docs).count() == 0


LETTERS = ["a", "the", "ing", " ", "  ", " the", "\n", "\n\n", "\t", "\r\n", " \n ", "É", "ß", "中文", "🙂", "1", "234", "'s", "...", "<s>", "</s>", "<unk>", "<0x41>", "<|endoftext|>",
           "\x1c", "\x85", " ", "　", "\0", "é", "﻿"]


def test_random_texts_in_many_blocks(spark, libraries):
    rnd = random.Random(11)
    docs = [(k, "".join(rnd.choice(LETTERS) for _ in range(rnd.randint(0, 30)))) for k in range(400)]
    docs += [(400 + k, "a ▁ b") for k in range(3)] + [(500, "▁"), (501, "word ▁word")]
    check(align_tokens(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5), block_chars=300).collect(), docs, libraries)


def test_units_hold_the_text_and_are_independent(libraries):
    rnd, aligner = random.Random(2), Aligner(A, B, held=10)
    assert aligner._alone
    for _ in range(1500):
        text = "".join(rnd.choice(LETTERS) for _ in range(rnd.randint(1, 25)))
        assert "".join(units(" " + text)) == " " + text and "".join(stretches(text, 4)) == text
        ids = [k for u in units(" " + text) for k in libraries[0].encode(u, add_special_tokens=False).ids]
        assert ids == libraries[0].encode(" " + text, add_special_tokens=False).ids, repr(text)
        assert [k for x in aligner._tokens_b(units(" " + text)) for k in x] == libraries[1].encode(text), repr(text)


def test_hot_and_very_long_texts(spark, libraries, monkeypatch):
    docs = [(k, "hot text, many times") for k in range(200)] + [(None, "own words 123"), (1, "x" * 20_000), (2, "don't stop, 12345 words\n" * 4000)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    check(align_tokens(frame, block_chars=500).collect(), docs, libraries)
    monkeypatch.setattr(token_alignment, "BATCH_CHARS", 10)
    check(align_tokens(frame).collect(), docs, libraries)
