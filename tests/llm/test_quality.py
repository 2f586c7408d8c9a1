import random
import re
import zlib

import numpy as np

from wavequarry.llm.quality import _ODD, CHAR_BITS, CHAR_NS, WORD_BITS, _slots, base_counts, base_failed, fit, features, judge, keep_good, platt, train_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[k:k + 5]) for k in range(len(words) - 4)]
    hit = set()
    for k, w in enumerate(windows):
        if windows.count(w) > 1:
            hit.update(range(k, k + 5))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_counts_by_definition():
    rng = random.Random(2)
    texts = ["", None, " ", "a\n\na\n a\na", "one two three four five one two three four five", "\x85 x y \x1c"]
    texts += ["".join(rng.choices(["a ", "b ", "cé ", "#", "\n", "\t", "a b c d e "], k=rng.randrange(60))) for _ in range(200)]
    for t in texts:
        assert base_counts(t) == plain(t), repr(t)
    assert base_failed(9, 0) and not base_failed(10, 2) and base_failed(10, 3)


def corpus(n, seed):
    rng = random.Random(seed)
    good, bad = "river stone gentle morning light house road garden".split(), "click$$$ buy### cheap&&& win!!! now%%% free***".split()
    return [(k, " ".join(rng.choice(good if k % 2 else bad + good[:3]) for _ in range(rng.randrange(15, 60))), k % 2) for k in range(n)]


def test_held_out_accuracy_and_calibration(spark):
    rows = corpus(400, 1)
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, y, 0) for k, _, y in rows], "doc_id bigint, quality int, toxic int")
    model = train_quality(docs, labels, 150)
    fresh = corpus(300, 2)
    p = np.array([model.probability(t) for _, t, _ in fresh])
    y = np.array([y for *_, y in fresh])
    assert ((p >= 0.5) == y).mean() > 0.97 and ((p - y) ** 2).mean() < 0.05
    again = train_quality(docs.repartition(5), labels, 150)
    assert np.allclose(again.weights, model.weights) and again.bias == model.bias
    out = {r["doc_id"]: r for r in judge(docs, model).collect()}
    for k, t, _ in rows:
        failed = base_failed(out[k]["n_words"], out[k]["n_repeat_words"])
        assert out[k]["base_failed"] == failed and out[k]["kept"] == (not failed and out[k]["probability"] >= 0.5)
    assert {r["doc_id"] for r in keep_good(docs, model).collect()} == {k for k, r in out.items() if r["kept"]}


def test_nothing_to_learn_keeps_all_but_base_failures(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(5, 1, 0), (None, 0, 0), (6, None, 0)], "doc_id bigint, quality int, toxic int")
    model = train_quality(odd_docs, labels)
    assert model.weights is None
    rows = judge(odd_docs, model).collect()
    texts = [r["text"] for r in odd_docs.collect()]
    assert sorted(str(tuple(r)[1:6]) for r in rows) == sorted(str(plain(t)) for t in texts)
    assert all(r["kept"] != r["base_failed"] for r in rows)
    assert judge(no_docs, model).count() == 0 and train_quality(no_docs, labels).weights is None
    assert keep_good(odd_docs, model).columns == odd_docs.columns
    assert keep_good(no_docs, model).columns == no_docs.columns and keep_good(no_docs, model).count() == 0


def test_platt_and_features():
    slope, shift = platt(np.array([-2.0, -1, -0.5, 0.2, 1, 2, 3]), np.array([0.0, 0, 0, 1, 0, 1, 1]))
    assert slope > 0 and abs(shift) < 3
    s, v = features("a a b")
    assert abs(v.sum() - 2) < 1e-6 and len(features("")[0]) == 0
    assert fit([]).weights is None


def test_slots_against_plain_code():
    u32 = lambda x: x & 0xFFFFFFFF
    for text in ("", "a", "ab", "abc", "Ab  çd\té🙂 zz zz", "word " * 50):
        want = []
        h = [zlib.crc32(w) for w in text.encode().split()]
        want += [u32(x * _ODD) >> 32 - WORD_BITS for x in h + [u32(a * _ODD) ^ b for a, b in zip(h, h[1:])]]
        for n in CHAR_NS:
            for k in range(len(text) - n + 1):
                x = 0
                for c in text[k:k + n]:
                    x = u32((x ^ ord(c)) * _ODD)
                want.append((u32((x ^ x >> 15) * _ODD) >> 32 - CHAR_BITS) + (1 << WORD_BITS))
        assert sorted(k for _, s in _slots(text) for k in s.tolist()) == sorted(want)


def test_fit_against_dense_steps():
    """The sparse steps are those of dense AdaGrad, and the calibration has the least loss."""
    rng = np.random.default_rng(2)
    rows = []
    for k in range(60):
        y = k % 2
        slots = np.unique(rng.integers(0, 40, 6)) + (20 if y else 0)
        rows.append((k % 5, y, slots.astype(np.int32), np.full(len(slots), 1 / len(slots), np.float32)))
    model = fit(rows, epochs=2)
    train = [r for r in rows if r[0]]
    share = [sum(r[1] == y for r in train) / len(train) for y in (0, 1)]
    w, g2, b, b2 = [0.0] * 60, [1e-8] * 60, 0.0, 1e-8
    order = np.random.default_rng(7)
    for _ in range(2):
        for k in order.permutation(len(train)):
            _, y, s, v = train[k]
            g = (1 / (1 + np.exp(-(sum(w[i] * float(x) for i, x in zip(s, v)) + b))) - y) * 0.5 / share[y]
            for i, x in zip(s, v):
                step = g * float(x) + 1e-4 * w[i]
                g2[i] += step * step
                w[i] -= 0.5 * step / g2[i] ** 0.5
            b2 += g * g
            b -= 0.1 * g / b2 ** 0.5
    assert np.allclose(model.weights[:60], w, atol=1e-3) and abs(model.bias - b) < 1e-4
    held = [(sum(w[i] * float(x) for i, x in zip(r[2], r[3])) + b, r[1]) for r in rows if not r[0]]
    up = sum(y for _, y in held)
    target = [(up + 1) / (up + 2) if y else 1 / (len(held) - up + 2) for _, y in held]
    loss = lambda a, c: sum(np.logaddexp(0, a * m + c) - t * (a * m + c) for (m, _), t in zip(held, target)) + 1e-3 * ((a - 1) ** 2 + c * c)
    best = loss(model.slope, model.shift)
    assert all(best <= loss(model.slope + d, model.shift + e) + 1e-9 for d in (-0.1, 0, 0.1) for e in (-0.1, 0, 0.1))
