import os
import random

import public_tokenizers
from tokenizers import Tokenizer, models, pre_tokenizers

from wavequarry.llm.token_counts import UnigramCounter, count_tokens, load_vocabulary

os.environ["TOKENIZERS_PARALLELISM"] = "false"


def library(vocabulary, unk, byte_fallback):
    t = Tokenizer(models.Unigram(vocabulary, unk, byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    return t


def test_counts_equal_the_library():
    vocabulary, unk = load_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    t, mine = library(vocabulary, unk, True), UnigramCounter(vocabulary, unk, held=50)
    rng = random.Random(5)
    parts = ["the", "er", "x", " ", "  ", "\n", "é", "ñ", "🙂", "漢字", "12", ".", "\u2581", "<unk>", "<0x41>", "\t", "tion", "\x00"]
    texts = ["", " ", "a", "  lead", "trail ", "thion ereaning of"] + ["".join(rng.choices(parts, k=rng.randrange(1, 25))) for _ in range(400)]
    for x in texts:
        assert mine.text(x)[0] == len(t.encode(x, add_special_tokens=False).ids), repr(x)


def test_ties_and_unknowns_equal_the_library():
    rng = random.Random(6)
    for trial in range(60):
        pieces = {"".join(rng.choices("abc", k=rng.randrange(1, 5))) for _ in range(8)} | {"\u2581"}
        vocabulary = [("<unk>", 0.0)] + [(p, float(-rng.randrange(1, 4))) for p in sorted(pieces)]
        t, mine = library(vocabulary, 0, False), UnigramCounter(vocabulary)
        for _ in range(30):
            x = "".join(rng.choices("abcd ", k=rng.randrange(1, 12)))
            assert mine.text(x)[0] == len(t.encode(x, add_special_tokens=False).ids), (vocabulary, x)


def brute(word, vocabulary):
    scores, low = dict(vocabulary), min(s for _, s in vocabulary) - 10
    best = [0.0] + [None] * len(word)
    for e in range(1, len(word) + 1):
        for s in range(e):
            x = scores.get(word[s:e], low if e - s == 1 else None)
            if x is not None and (best[e] is None or best[s] + x > best[e]):
                best[e] = best[s] + x
    return best[-1]


def test_best_score_by_brute_force():
    vocabulary = [("<unk>", 0.0), ("a", -1.0), ("ab", -1.5), ("b", -2.0), ("bab", -2.25), ("\u2581", -0.5), ("\u2581a", -3.0)]
    mine = UnigramCounter(vocabulary)
    for w in ("a", "abab", "bab", "xay", "abbaxb"):
        assert mine.word("\u2581" + w)[2] == brute("\u2581" + w, vocabulary)


def test_odd_documents(spark, odd_docs, no_docs):
    mine = UnigramCounter(*load_vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    want = [(r["doc_id"], *mine.text(r["text"])) for r in odd_docs.collect()]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in count_tokens(odd_docs).collect())
    assert count_tokens(no_docs).count() == 0
