import hashlib
import random
import re
from collections import Counter
from math import log2

from wavequarry.llm.pii import _EDGES, _text_key, find_personal_data, lower_share, sanitise, term_class, term_counts, text_terms

KINDS = ["email", "ip", "card", "phone"]
PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def luhn(d):
    t = 0
    for k, c in enumerate(reversed(d)):
        x = int(c)
        if k % 2:
            x = 2 * x - 9 if x > 4 else 2 * x
        t += x
    return t % 10 == 0


def plain_spans(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            if k == 0 or k == 1 and all(int(x) <= 255 for x in m.group().split(".")) or k == 2 and 14 <= len(d) <= 19 and luhn(d) or k == 3 and 10 <= len(d) <= 15:
                out.append((m.start(), k, m.end()))
    return sorted(out)


TRICKY = ["a@b.c_d@e.f", "a@b.c%d@e.f x", "a.b@-", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.255", "0001.00002.3.4", "4111 1111 1111 1111", "x4111-1111-1111-1111 5", "41111111111111112222",
          "4111  1111 1111 1111", "+1 (555) 123-4567.", "+1 (555) 123-4567890123 456", "+1+44 20 7946 0958", "é a@b.cc 🙂 1.2.3.4", "99999999999999999999.1.1.1", "a@b@c.d", "..@x.y", "0" * 40000,
          "a" * 30000 + "@", "a@" + "b." * 8000 + "c", "4 " * 9000, "1.1.1.1" * 3, "+1234567890+1234567890", "-4111111111111111-", "4111 1111 1111 1111 1", "1 4111 1111 1111 1111"]


def check(rows, docs):
    want = []
    for d, t in docs:
        spans = plain_spans(t or "")
        s = ",".join(f"{KINDS[k]}:{a}:{e}" for a, k, e in spans)
        want.append((d, *(sum(x[1] == k for x in spans) for k in range(4)), hashlib.sha256(s.encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:6]) for r in rows)


def test_base_kinds_by_definition(spark, odd_docs, no_docs):
    docs = list(enumerate(TRICKY))
    rows = find_personal_data(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    check(rows, docs)
    check(find_personal_data(odd_docs).collect(), [(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert find_personal_data(no_docs).count() == 0


def test_terms_that_give_an_entity_away(spark):
    filler = ["common words here and there", "there and here common words", "words common and here there"]
    docs = [(k, f"{filler[k % 3]} {k} Zanzibor wrote to joe{k // 100}@mail.com about {k} things") for k in range(12)]
    docs += [(100 + k, f"{filler[k % 3]} and the things about wrote to {k}") for k in range(600)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = {r["doc_id"]: r["spans"] for r in find_personal_data(df).collect()}
    for k, t in docs[:12]:
        found = {t[int(a):int(b)]: kind for kind, a, b in (x.split(":") for x in rows[k].split(","))}
        assert found["Zanzibor"] == "term_removed" and "common" not in found and "about" not in found
    assert all(rows[k] == "" for k, _ in docs[12:])
    clean = {r["doc_id"]: r["text"] for r in sanitise(df).collect()}
    assert "Zanzibor" not in clean[0] and "[EMAIL]" in clean[0] and "mail.com" not in clean[0]
    assert all(clean[k] == t for k, t in docs[12:])


def test_sanitised_rows_keep_their_columns(spark, odd_docs):
    out = sanitise(odd_docs)
    assert out.columns == odd_docs.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, odd_docs.collect()))
    df = spark.createDataFrame([(1, "card 4111 1111 1111 1111, a@b.cc 1.2.3.4 é")], "doc_id bigint, text string")
    assert sanitise(df).first()["text"] == "card [CARD], [EMAIL] [IP] é"
    none = spark.createDataFrame([], "doc_id bigint, text string, spans string")
    assert sanitise(none).columns == none.columns and sanitise(none).count() == 0


def test_terms_go_wherever_they_stand(spark):
    filler = ["common words here and there", "there and here common words", "words common and here there"]
    docs = [(k, f"{filler[k % 3]} Zanzibor wrote to joe@mail.com about things") for k in range(24)]
    docs += [(24, f"{filler[0]} wrote to ann.quillan@mail.com about Quillan, things")]
    docs += [(25, f"{filler[0]} " * 9 + f"and (zanzibor) again {filler[1]}")]  # no entity in this text
    docs += [(100 + k, f"{filler[k % 3]} wrote to and about the things") for k in range(1200)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    spans = {r["doc_id"]: r["spans"] for r in find_personal_data(df).collect()}
    at = docs[25][1].index("(zanzibor)")
    assert spans[25] == f"term_removed:{at}:{at + 10}" and "term_removed" in spans[0]
    at = docs[24][1].index("Quillan")  # beside one address, which contains it
    assert f"term_general:{at}:{at + 8}" in spans[24].split(",")
    assert all(spans[k] == "" for k, _ in docs[26:])
    clean = {r["doc_id"]: r["text"] for r in sanitise(df).collect()}
    assert clean[24].endswith("[EMAIL] about [NAME] things")
    assert not any("zanzibor" in t.lower() or "Quillan" in t for t in clean.values())
    assert clean[25] == docs[25][1].replace("(zanzibor)", "") and clean[100] == docs[26][1]
    texts = df.select("text", *_text_key(df["text"]))
    every, terms = term_counts(texts), spark.createDataFrame([("zanzibor", "term_removed"), ("quillan", "term_general")], "term string, kind string")
    want = sorted(map(str, text_terms(texts, terms, every).collect()))
    assert len(want) == 5 and all(sorted(map(str, text_terms(texts, terms, every, k).collect())) == want for k in (0, 3))


def plain_terms(texts, window=64, z=1.645):
    """Kinds of the disclosing terms, from shares and bits by definition."""
    word, term = re.compile(r"[^\x20\x09-\x0D]+"), lambda w: w.lower().strip(_EDGES)
    every = Counter(x for t in texts for w in word.findall(t) if (x := term(w)))
    beside, entity = Counter(), Counter()
    for t in texts:
        base = plain_spans(t)
        for s, kind, e in base:
            own = t[s:e].lower() if kind < 2 else re.sub("[^0-9]", "", t[s:e])
            for m in word.finditer(t):
                a, b = m.span()
                inside = max(0, s - window) <= a and b <= s or e <= a and b <= e + window
                whole = not (a == max(0, s - window) > 0) and b != s and a != e and not (b == e + window < len(t))
                if inside and whole and term(m.group()) and not any(x < b and y > a for x, _, y in base):
                    beside[term(m.group()), (kind, own)] += 1
                    entity[kind, own] += 1
    total, kinds = sum(every.values()), {}
    for (x, own), n in beside.items():
        p, m = min(n, every[x]) / every[x], every[x]
        share = (p + z * z / (2 * m) - z * (p * (1 - p) / m + z * z / (4 * m * m)) ** 0.5) / (1 + z * z / m)
        if share >= 0.5 and share * log2(share * total / entity[own]) >= 4:
            kinds[x] = max(kinds.get(x, ""), "term_removed" if share >= 0.8 else "term_general")
        elif p == 1 and len(x) >= 4 and x in own[1]:
            kinds[x] = max(kinds.get(x, ""), "term_general")
    return kinds


def test_shares_bits_and_verdicts_against_plain_code(spark):
    rng = random.Random(11)
    common, rare = [f"w{k}" for k in range(60)], [f"Name{k}," for k in range(25)]
    people = [f"p{k}@mail.com" for k in range(8)] + ["10.0.0.7", "+1 555 123 4567"]
    texts = []
    for _ in range(300):
        t = rng.choices(common, k=rng.randrange(5, 300))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(t))
            t[at:at] = [rng.choice(rare)] if rng.random() < 0.4 else [rng.choice(people)]
        if rng.random() < 0.5:
            k, at = rng.randrange(10), rng.randrange(len(t))
            t[at:at] = [rare[k], people[k]] + [rare[k + 10]] * (k % 3) + [f"(Sole{k})"] * (k < 6)
        texts.append(rng.choice([" ", "  ", "\n"]).join(t))
    texts += ["w1 p3@mail.com mail.com w2", "w3 mail.co P2@mail"] + texts[:20]
    kinds = plain_terms(texts)
    assert {"term_removed", "term_general"} == set(kinds.values())
    got = {r["doc_id"]: r["spans"] for r in find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)).collect()}
    for k, t in enumerate(texts):
        base = plain_spans(t)
        spans = [(a, r, KINDS[r], b) for a, r, b in base]
        for m in re.finditer(r"[^\x20\x09-\x0D]+", t):
            kind = kinds.get(m.group().lower().strip(_EDGES))
            if kind and not any(a < m.end() and b > m.start() for a, _, b in base):
                spans.append((m.start(), 4 if kind == "term_removed" else 5, kind, m.end()))
        assert got[k] == ",".join(f"{x}:{a}:{b}" for a, _, x, b in sorted(spans))


def test_planted_disclosers_are_told_from_rare_words(spark):
    """Of what is marked, all was planted; rare words that stand beside an entity once or twice are left alone."""
    rng = random.Random(5)
    common = [f"common{k}" for k in range(80)]
    texts, planted, spelling = [], [f"planted{k}" for k in range(10)], [f"speller{k}" for k in range(10)]
    for k in range(900):
        t = rng.choices(common, k=40)
        who = k % 30
        if k % 3 == 0:
            t[20:20] = [f"rare{k}x", f"person{who}@host.org", f"rare{k // 6}y"]  # rare words: one of their own, one shared by two texts
        if who < 10 and k % 3 == 1:
            t[10:10] = [planted[who], f"known{who}@host.org"]
        texts.append(" ".join(t))
    texts += [f"{common[k]} {s} wrote from {s}.a@host.org {common[k + 1]}" for k, s in enumerate(spelling)]
    rows = find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    marked = {(texts[r["doc_id"]][int(a):int(b)], kind) for r in rows if r["spans"] for kind, a, b in (x.split(":") for x in r["spans"].split(",")) if kind.startswith("term")}
    held = {p for p in planted if any(p in t.split() for t in texts)}
    assert len(held) >= 3 and marked == {(p, "term_removed") for p in held} | {(s, "term_general") for s in spelling}


def test_bounds_and_classes(spark):
    pairs = [(k, n) for n in (1, 2, 3, 4, 10, 11, 1000) for k in {1, n // 2, n} if k]
    got = spark.createDataFrame([(float(k), float(n)) for k, n in pairs], "k double, n double")
    low = {(r["k"], r["n"]): r["low"] for r in got.select("k", "n", lower_share(got["k"], got["n"]).alias("low")).collect()}
    assert low[2, 2] < 0.5 <= low[3, 3] and low[10, 10] < 0.8 <= low[11, 11] and all(0 <= v < k / n for (k, n), v in low.items())
    words = ["Quillan,", "x9", "(1907)", "zebra", "--", "Éva"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(term_class(df["w"])).collect()] == ["[NAME]", "[CODE]", "[NUMBER]", "[WORD]", "[SIGN]", "[NAME]"]
