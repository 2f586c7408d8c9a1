import hashlib
import random
from collections import Counter

from wavequarry.llm.suffix_dedup import reach, remove_repeats, removal_digests
from wavequarry.llm.suffix_sort import BlindTrie, common_prefix, deep_shallow_sort


def random_strings(rng, n, alphabet, top):
    return [bytes(rng.choices(alphabet, k=rng.randrange(top))) for _ in range(n)]


def test_sort_is_an_order():
    rng = random.Random(3)
    for alphabet, top in ((b"ab", 12), (b"abc", 60), (bytes(range(256)), 5), (b"a", 40)):
        strings = random_strings(rng, 200, alphabet, top)
        strings += [b"x" * 90 + s for s in strings]
        for shallow in (8, 64):
            assert [strings[k] for k in deep_shallow_sort(strings, shallow)] == sorted(strings)
        trie = BlindTrie(strings)
        for k in range(len(strings)):
            trie.add(k)
        assert [strings[k] for k in trie.in_order()] == sorted(strings)
    assert common_prefix(b"abc", b"abd") == 2 and common_prefix(b"", b"a") == 0 and common_prefix(b"ab", b"ab") == 2


def test_reach_against_all_pairs():
    rng = random.Random(4)
    for _ in range(40):
        n = rng.randrange(2, 30)
        ctx = list({(bytes(rng.choices(b"ab", k=rng.randrange(8))), b"seed" + bytes(rng.choices(b"ab", k=rng.randrange(10)))) for _ in range(n)})
        counts = [rng.choice([1, 1, 1, 2]) for _ in ctx]
        for length, found in zip((12, 8), reach(ctx, counts, (12, 8))):
            for (left, right), c, got in zip(ctx, counts, found):
                pairs = [(common_prefix(left[::-1], a[::-1]), common_prefix(right, b)) for a, b in ctx if (a, b) != (left, right)]
                if c > 1:
                    pairs.append((len(left), len(right)))
                good = [p for p in pairs if sum(p) >= length]
                assert got == ((max(p[0] for p in good), max(p[1] for p in good)) if good else None)


def plain(docs, length, passage=None, rows=False):
    raws = [(t or "").encode() for _, t in docs]
    seen = Counter(r[k:k + length] for r in raws for k in range(len(r) - length + 1))
    out = []
    for (d, _), r in zip(docs, raws):
        gone = [False] * len(r)
        for k in range(len(r) - length + 1):
            if seen[r[k:k + length]] > 1:
                gone[k:k + length] = [True] * length
        kept = bytes(b for b, g in zip(r, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((d, len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    if passage:
        out = [(*x, y[2]) for x, y in zip(out, plain(docs, passage, rows=True))]
    return out if rows else sorted(map(str, out))


def made(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randrange(1, 6)))
    passage = " ".join(word() for _ in range(30))
    docs = []
    for k in range(90):
        body = [" ".join(word() for _ in range(rng.randrange(1, 40)))]
        if k % 3 == 0:
            at = rng.randrange(20)
            body.insert(rng.randrange(2), passage[at:at + rng.randrange(30, 90)])
        docs.append((k, " ".join(body)))
    docs += [(100 + k, docs[5][1]) for k in range(3)] + [(200, "ab" * 100), (201, "a" * 77), (202, docs[7][1] + docs[7][1])]
    return docs


def test_against_brute_force_on_both_paths(spark):
    docs = made(1)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    for limit in (2048, 3):
        for passage in (None, 14):
            rows = removal_digests(df, 24, passage, seed=8, group_limit=limit, ranges=4).collect()
            assert sorted(str(tuple(r)) for r in rows) == plain(docs, 24, passage)


def test_boundaries_at_full_length(spark):
    """Passages of 399, 400 and 401 bytes at texts' starts and ends, within texts, and cut through characters."""
    rng = random.Random(6)
    filler = lambda n: "".join(rng.choices("abcdefghij ", k=n))
    docs = []
    for k, n in enumerate((399, 400, 401)):
        for j in range(3):
            p = filler(n)
            docs += [(100 * k + 10 * j, p + filler(300)), (100 * k + 10 * j + 1, filler(300) + p), (100 * k + 10 * j + 2, filler(50) + p + filler(60))]
        wide = "é" * 3 + filler(n - 4) + "🙂"  # repeats may begin and end within a character
        docs += [(100 * k + 50, "é" + wide[1:] + "x" * 20), (100 * k + 51, "è" + wide[1:-1] + "🙃")]
    docs.append((900, filler(3_000_000) + docs[3][1]))
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    got = removal_digests(df, 400, 240).collect()
    assert sorted(str(tuple(r)) for r in got if r["doc_id"] != 900) == [x for x in plain([d if d[0] != 900 else (900, docs[3][1]) for d in docs], 400, 240) if not x.startswith("(900")]
    long = next(r for r in got if r["doc_id"] == 900)
    assert (long["n_bytes"], long["n_removed"], long["n_spans"], long["n_passage_bytes"]) == (3_000_000 + len(docs[3][1]), len(docs[3][1]), 1, len(docs[3][1]))


def test_odd_documents_at_full_length(spark, odd_docs, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert sorted(str(tuple(r)) for r in removal_digests(odd_docs).collect()) == plain(docs, 400)
    cut = remove_repeats(odd_docs)
    assert cut.columns == odd_docs.columns and cut.count() == len(docs)
    assert cut.where("doc_id = 7").first()["text"] == "" and cut.where("doc_id = 1").first()["text"] is None
    assert removal_digests(no_docs).count() == 0 and remove_repeats(no_docs).columns == no_docs.columns and remove_repeats(no_docs).count() == 0
