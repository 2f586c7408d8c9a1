import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from wavequarry.llm import source_divergence
from wavequarry.llm.source_divergence import audit_sources, term_counts, terms_of, top_terms


def plain(docs, least=10, top=10):
    """Every kept term of every pair of groups, from the definition."""
    pattern = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    n, in_docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        text, lang, source = text or "", lang or "", source or ""
        found = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in pattern.findall(text)]
        n[lang, source].update(found)
        in_docs[lang].update(set(found))
        groups[lang].add(source)
    rows = []
    for lang, sources in groups.items():
        kept = [t for t, d in in_docs[lang].items() if d >= least]
        counts = {s: {t: n[lang, s][t] for t in kept} for s in sources}
        counts[None] = {t: sum(n[lang, s][t] for s in sources) for t in kept}
        p = {s: {t: 1 + 10**9 * (c + 2) // (sum(own.values()) + 2 * len(kept)) for t, c in own.items()} for s, own in counts.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(x, sum(f(p[s][t], p[x][t]) for t in kept)) for x in sources if x != s]
            terms = [(t, f(p[s][t], p[None][t])) for t in kept if counts[s][t] and p[s][t] > p[None][t]]
            for part, own, most in (("pair", pairs, None), ("term", terms, top)):
                own.sort(key=lambda x: (-x[1], x[0].encode()))
                rows += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(own[:most])]
    return sorted(rows)


def frame(spark, docs):
    return spark.createDataFrame(docs, "text string, lang string, source string")


def check(spark, docs, **more):
    got = audit_sources(frame(spark, docs), **more).collect()
    assert sorted(map(tuple, got)) == plain(docs, more.get("least_docs", 10), more.get("top", 10))


def test_random_documents_with_hot_and_empty_groups(spark):
    rnd = random.Random(1)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)] + ["Été", "été", "中文", "ab", "abc", "abcd", "ÀB", "z" * 300, "z" * 301]
    docs = []
    for k in range(300):
        source = "hot" if k % 3 == 0 else f"s{k % 7}"
        docs.append((" ".join(rnd.choice(words[:20] if source == "hot" else words) for _ in range(rnd.randint(0, 40))), rnd.choice(["en", "de"]), source))
    docs += [(None, "en", "silent"), ("", None, None), ("123 !?", "en", ""), ("alone words", "fr", "one"), ("other words", "fr", "two"), docs[0], docs[0]]
    check(spark, docs)
    check(spark, docs, least_docs=1, top=3)


def test_ties_are_decided_by_bytes(spark):
    """All terms of a source occur equally often: the rank is the order of their bytes alone."""
    rnd = random.Random(4)
    words = ["a" * k for k in range(1, 30)] + ["prefix" * 4 + x for x in ("a", "b", "ab", "é", "中", "🙂", "aé", "ﬁ")] + ["b", "ba", "bb"]
    docs = [(" ".join(rnd.sample(words, len(words))), "en", "all") for _ in range(12)]
    docs += [("other " * 5 + " ".join(words[:2]), "en", "few") for _ in range(12)]
    check(spark, docs)
    for k in (1, 2, 17):
        check(spark, docs, top=k)


def test_selection_alone(spark):
    rnd = random.Random(9)
    rows = [("x", f"s{g}", f"t{k:04d}" if k % 2 else "common-start-" + "q" * (k % 50) + str(k), rnd.choice([0, 1, 5, 1023, 1024, 10**9 - 1, rnd.randrange(10**9)]))
            for g in range(3) for k in range(10 if g == 0 else 400)]
    rated = spark.createDataFrame(rows, "lang string, source string, item string, value bigint")
    for k in (1, 10, 60):
        want = []
        for g in range(3):
            own = sorted((r for r in rows if r[1] == f"s{g}"), key=lambda r: (-r[3], r[2].encode()))
            want += own[:k]
        assert sorted(map(tuple, top_terms(rated, k).collect())) == sorted(want)


def test_counts_given_out_early_add_up(spark):
    docs = [(f"one two w{chr(97 + k % 26)} Two", "en", "a" if k % 3 else "b") for k in range(90)]
    small = {tuple(r) for r in term_counts(frame(spark, docs), held=2).collect()}
    assert small == {tuple(r) for r in term_counts(frame(spark, docs)).collect()}
    assert ("en", "b", "two", 60, 30) in small and ("en", "b", None, 0, 0) in small


def test_batches_of_any_number_of_terms(monkeypatch):
    monkeypatch.setattr(source_divergence, "ROWS", 2)
    for k in range(6):
        found = {("en", ""): (Counter({b"t%d" % i: 1 for i in range(k)}), Counter({b"t%d" % i: 1 for i in range(k)}))}
        batches = list(source_divergence._given(found))
        assert len({b.schema for b in batches}) == 1 and sum(b.num_rows for b in batches) == k + 1


def test_terms_are_those_of_the_pattern():
    pattern, rnd = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+"), random.Random(3)
    for _ in range(500):
        text = "".join(rnd.choice(["a", "Z", "É", "İ", " ", " ", "\x85", "1", "_", "\x7f", "\x80", "🙂", "\0", "["]) for _ in range(20))
        assert [t.decode() for t in terms_of(text)] == [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in pattern.findall(text)]


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    odd = odd_docs.withColumns({"lang": F.lit("x"), "source": F.col("part"), "item": F.lit(1), "term": F.lit("t"), "salt": F.lit(2), "p": F.lit(3)})
    docs = [(r["text"], "x", r["part"]) for r in odd.collect()]
    assert sorted(map(tuple, audit_sources(odd, least_docs=2).collect())) == plain(docs, 2)
    assert audit_sources(no_docs).count() == 0


def test_a_value_fits_its_digits():
    assert source_divergence.ONE + 1 < 1 << source_divergence.DIGIT_BITS * source_divergence.DIGITS


def test_query_equals_its_sql(spark):
    import duckdb

    from wavequarry.llm.queries import ORACLE, QUERIES

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = QUERIES["op13_source_divergence"](spark, sf)
    cur = con.execute(ORACLE["op13_source_divergence"])
    names = [d[0] for d in cur.description]
    assert names == got.columns and got.count() > 100
    assert sorted(map(tuple, got.collect())) == sorted(cur.fetchall())
