import random

import numpy as np
import xxhash

from wavequarry.llm.common import connected_components
from wavequarry.llm.simhash import (BANDS, REACH, ROWS, BKTree, fingerprint, fingerprint_of, keep_one, link_fingerprints, near_duplicates, shard_groups,
                                    shard_links, sketch_of)


def plain_fingerprint(text, width=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[k:k + width]) for k in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(values, radius=2):
    left, label = set(values), {}
    while left:
        start = left.pop()
        todo, own = [start], {start}
        while todo:
            x = todo.pop()
            near = {y for y in left if (x ^ y).bit_count() <= radius}
            left -= near
            own |= near
            todo += near
        label.update(dict.fromkeys(own, min(own)))
    return label


def clustered(n, seed, flips=3):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(8)] + [0]
    out = set(base)
    while len(out) < n:
        x = rng.choice(base)
        for _ in range(rng.randrange(1, flips + 1)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint_by_definition():
    for t in ["", None, "one", "One two", "a b c", "É a b\tc\nd\x0be", "w " * 9, " x y z", "a b c d e f g h i j k l"]:
        assert fingerprint(t) == plain_fingerprint(t), t


def test_tree_finds_all_within_the_radius():
    values = clustered(300, 1)
    tree = BKTree()
    for v in values:
        assert tree.values[tree.add(v)] == v
    assert tree.add(values[0]) == 0
    for v in values[:60]:
        assert {tree.values[k] for k in tree.within(v, 2)} == {x for x in values if (x ^ v).bit_count() <= 2}
    label = groups(values)
    assert dict(shard_links(values)) == {v: m for v, m in label.items() if v != m}


def test_links_on_both_paths(spark):
    values = clustered(400, 2, 4)
    df = spark.createDataFrame([(signed(v),) for v in values], "fp bigint")
    want = groups(values)
    classes = lambda m: {frozenset(k for k in m if m[k] == x) for x in set(m.values())}
    for limit in (4096, 5):
        got = {r["node"]: r["label"] for r in connected_components(link_fingerprints(df, limit)).collect()}
        full = {signed(v): got.get(signed(v), signed(v)) for v in values}
        assert classes(full) == classes({signed(v): m for v, m in want.items()})


def test_components_of_chains(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (200, 200)] + [(500, k) for k in range(501, 540)]
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = dict.fromkeys(range(41), 0) | {100: 100, 101: 100} | dict.fromkeys(range(500, 540), 500)
    assert got == want
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_odd_documents(spark, odd_docs, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    rows = near_duplicates(odd_docs).collect()
    label = groups({plain_fingerprint(t) for _, t in docs})
    least = {}
    for d, t in docs:
        m = label[plain_fingerprint(t)]
        if d is not None:
            least[m] = min(d, least.get(m, d))
    want = [(d, f"{plain_fingerprint(t):016x}", least.get(label[plain_fingerprint(t)])) for d, t in docs]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in rows)
    assert near_duplicates(no_docs).count() == 0
    kept = keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    words = {" ".join((t or "").lower().split()) for _, t in docs}  # no two of these are similar without being equal
    assert kept.count() == len({w for w in words if w}) + 1
    assert keep_one(no_docs).count() == 0


def test_similar_texts_leave_one(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    docs, want = [], set()
    for g in range(12):
        base = [word() for _ in range(rng.randrange(100, 300))]
        want.add(10 * g)
        docs.append((10 * g, " ".join(base)))
        for k in range(1, 6 if g % 2 else 1):
            near = list(base)
            near[rng.randrange(len(near))] = word()
            docs.append((10 * g + k, " ".join(near)))
    far = docs[0][1].split()
    docs.append((900, " ".join(far[:len(far) // 2] + [word() for _ in range(len(far) // 2)])))
    want.add(900)
    got = {r["doc_id"] for r in keep_one(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == want


def jaccard_groups(texts):
    sets = [{tuple(t[k:k + 5]) for k in range(len(t) - 4)} for t in texts]
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                label = [label[b] if v == label[a] else v for v in label]
    return label


def test_a_large_group_of_near_copies_keeps_every_link(spark):
    """Chains: most pairs of a group are not similar. Small limits deal it to many parts and turns."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    base = [word() for _ in range(80)]
    texts = []
    for _ in range(150):
        near = list(base)
        for at in rng.sample(range(80), rng.randrange(0, 5)):
            near[at] = word()
        texts.append(near)
    texts += [[word() for _ in range(60)] for _ in range(30)]
    label = jaccard_groups(texts)
    want = {min(k for k, v in enumerate(label) if v == g) for g in set(label)}
    assert 40 < len(want) < 150
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id bigint, text string")
    for how in ({}, {"shard_limit": 4, "part_texts": 10, "pivots": 3}, {"part_shingles": 400, "pivots": 1}):
        assert {r["doc_id"] for r in keep_one(df, **how).collect()} == want


def test_recall_of_near_copies_by_similarity():
    """Shares of pairs at a similarity that the bands and the fingerprints' reach propose."""
    rng = np.random.default_rng(12)
    lost = 0
    for _ in range(400):
        n = int(rng.integers(20, 400))
        same = int(np.ceil(2 * n * 0.8 / 1.8))  # of two sets of n, at a similarity of 0.8 or just above
        h = rng.integers(0, 1 << 64, 2 * n - same, dtype=np.uint64)
        a, b = h[:n], h[n - same:]
        x, y = sketch_of(a).reshape(BANDS, ROWS), sketch_of(b).reshape(BANDS, ROWS)
        lost += not (x == y).all(axis=1).any() or (fingerprint_of(a) ^ fingerprint_of(b)).bit_count() > REACH
    assert lost <= 2


def test_shard_groups_hold_all_pairs():
    rng = np.random.default_rng(4)
    rows = []
    for k in range(0, 900, 3):  # b is near a, and c near b alone
        a = int(rng.integers(0, 1 << 63))
        b, c = a ^ ((1 << 20) - 1), a ^ ((1 << 40) - 1)
        rows += [(k, signed(a), 50), (k + 1, signed(b), 50), (k + 2, signed(c), 50)]
    order = rng.permutation(900)
    got = dict(shard_groups([rows[k] for k in order], reach=20))
    for k in range(0, 900, 3):
        assert len({got.get(k + j, k + j) for j in range(3)}) == 1


def test_repeated_words_are_no_difference(spark):
    rng = random.Random(5)
    docs = []
    for k in range(6):  # the run's shingle fifty times or once: equal sets, fingerprints far apart
        words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(300)]
        docs += [(2 * k, " ".join(words + ["-"] * 54)), (2 * k + 1, " ".join(words + ["-"] * 5))]
    assert any((fingerprint(a, 5) ^ fingerprint(b, 5)).bit_count() > 18 for (_, a), (_, b) in zip(docs[::2], docs[1::2]))
    got = {r["doc_id"] for r in keep_one(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == {2 * k for k in range(6)}


def test_threshold_is_exact(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(40):  # one changed word costs five shingles of 36 to 60: true similarities between 0.75 and 0.85
        base = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(rng.randrange(40, 65))]
        near = list(base)
        near[len(near) // 2] = "changed"
        texts += [base, near]
    label = jaccard_groups(texts)
    assert 40 < len(set(label)) < 80  # some pairs are similar, some are just not
    want = {min(k for k, v in enumerate(label) if v == g) for g in set(label)}
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id bigint, text string")
    assert {r["doc_id"] for r in keep_one(df).collect()} == want
