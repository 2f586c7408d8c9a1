"""How sources differ in their words: exact divergence of all pairs of sources, and each source's most telling terms."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavequarry.llm.common import discard, materialise, table

#: Documents of its language that hold a kept term, at least.
LEAST_DOCS = 10
#: A share of one, in the whole numbers that all is reckoned in.
ONE = 1_000_000_000
#: What a count is raised by.
RAISE = 2
#: Terms of a group that are returned.
TOP = 10
#: Bits of a value that one histogram takes, and how many of them a value has at most: it is below ONE + 1.
DIGIT_BITS, DIGITS = 10, 3
#: Bytes of a term that one histogram takes.
DIGIT_BYTES = 2
#: Term counts that a task holds before it gives them out.
HELD = 300_000
#: Rows of a batch that a task gives out.
ROWS = 10_000
#: Parts that the rows of one group are dealt to where they meet the group's own figures.
SALTS = 32

GROUP = ["lang", "source"]
#: ASCII bytes that are no letters end a term, A to Z are lower-cased, all others stay: a byte of 128 and more belongs to a letter.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(_LETTERS).split()


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", held: int = HELD) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences and documents; each group has a row without a term besides.

    Tasks count before the shuffle, and give out what they hold when it reaches ``held`` entries.
    """
    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))

    def count(batches):
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                if (lang, source) not in found:
                    found[lang, source] = Counter(), Counter()
                n, in_docs = found[lang, source]
                before = len(n)
                terms = terms_of(text)
                n.update(terms)
                in_docs.update(set(terms))
                size += len(n) - before
                if size > held:
                    yield from _given(found)
                    found, size = {}, 0
        yield from _given(found)

    rows = plain.mapInArrow(count, "lang string, source string, term string, n bigint, docs bigint")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _given(found: dict[tuple[str, str], tuple[Counter, Counter]]):
    names = ["lang", "source", "term", "n", "docs"]
    for (lang, source), (n, in_docs) in found.items():
        terms = list(n)
        for a in range(0, max(1, len(terms)), ROWS):
            own = terms[a:a + ROWS]
            term, counts, docs = [t.decode() for t in own], [n[t] for t in own], [in_docs[t] for t in own]
            if a == 0:
                term, counts, docs = [None, *term], [0, *counts], [0, *docs]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(term), pa.string()), pa.array([source] * len(term), pa.string()), pa.array(term, pa.string()),
                                              pa.array(counts, pa.int64()), pa.array(docs, pa.int64())], names)


def meet(rows: DataFrame, figures: DataFrame, on: list[str], spread: str) -> DataFrame:
    """``rows`` joined with ``figures``, which are few for each key: a hot key's rows, told apart by ``spread``, are dealt to several tasks."""
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    copied = figures.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copied, [*on, "salt"]).drop("salt")


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(ONE * (n + RAISE) / (total + RAISE * kept)), in whole numbers of 38 digits."""
    wide = lambda c, digits: c.cast(f"decimal({digits},0)")
    above = wide(F.lit(ONE), 10) * wide(n + RAISE, 19)
    return F.lit(1).cast("bigint") + F.call_function("div", above, wide(total + RAISE * kept, 19))


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)): below 2^63 as shares are at most ONE + 1."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def pair_values(held: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` for every two groups of a language, from ``held(lang, source, term, n, p)`` and ``groups(lang, source, p0, kept)``.

    Only terms that occur are touched. A pair starts as if both lacked every kept term, at their
    shares ``p0`` of an absent one. What a group has corrects that against the other's ``p0``, once
    for each of its distinct counts, not for each term; terms that both have are corrected once more.
    """
    one = groups.select("lang", F.col("source").alias("s"), F.col("p0").alias("s0"), "kept")
    two = groups.select("lang", F.col("source").alias("t"), F.col("p0").alias("t0"))
    start = meet(one, two, ["lang"], "s").where("s < t").select("lang", "s", "t", (F.col("kept") * divergence(F.col("s0"), F.col("t0"))).alias("v"))
    levels = held.groupBy(*GROUP, "p").agg(F.count("*").alias("m"))
    levels = meet(levels, groups.select(*GROUP, "p0"), GROUP, "p")
    others = groups.select("lang", F.col("source").alias("o"), F.col("p0").alias("o0"))
    own = (meet(levels, others, ["lang"], "p").where("source <> o")
           .select("lang", F.least("source", "o").alias("s"), F.greatest("source", "o").alias("t"),
                   (F.col("m") * (divergence(F.col("p"), F.col("o0")) - divergence(F.col("p0"), F.col("o0")))).alias("v")))
    rich = meet(held.select(*GROUP, "term", "p"), groups.select(*GROUP, "p0"), GROUP, "term")
    left = rich.select("lang", "term", F.col("source").alias("s"), F.col("p").alias("sp"), F.col("p0").alias("s0"))
    right = rich.select("lang", "term", F.col("source").alias("t"), F.col("p").alias("tp"), F.col("p0").alias("t0"))
    c = F.col
    both = (left.join(right, ["lang", "term"]).where("s < t")
            .select("lang", "s", "t", (divergence(c("sp"), c("tp")) - divergence(c("sp"), c("t0")) - divergence(c("s0"), c("tp")) + divergence(c("s0"), c("t0"))).alias("v")))
    summed = start.union(own).union(both).groupBy("lang", "s", "t").agg(F.sum("v").alias("value"))
    return (summed.select("lang", F.col("s").alias("source"), F.col("t").alias("item"), "value")
            .union(summed.select("lang", F.col("t").alias("source"), F.col("s").alias("item"), "value")))


def top_terms(rated: DataFrame, k: int = TOP) -> DataFrame:
    """Each group's ``k`` rows of ``rated(lang, source, item, value)`` with the greatest value, and of equal values the least item by its UTF-8 bytes.

    Radix selection: histograms over ten bits of the value at a time, the highest first, narrow each
    group to the value of its kth row. Of the rows at that value, histograms over two bytes at
    a time, behind what they all begin with, find how many go with it. No group is sorted as a whole,
    and a histogram has at most 1,024 or 65,537 bins. Items of a group are distinct.
    """
    state, old = rated.select(*GROUP).distinct().select(*GROUP, F.lit(0).cast("bigint").alias("digit"), F.lit(k).cast("bigint").alias("need")), []
    for step in reversed(range(DIGITS)):
        shift = step * DIGIT_BITS
        narrowed = meet(rated.withColumn("digit", F.shiftright("value", shift + DIGIT_BITS)), state, [*GROUP, "digit"], "item") if step < DIGITS - 1 else meet(rated, state, GROUP, "item")
        bins = narrowed.groupBy(*GROUP, F.shiftright("value", shift).alias("bin"), "need").agg(F.count("*").alias("c"))
        state = _threshold(bins, F.col("bin").desc()).select(*GROUP, F.col("bin").alias("digit"), "need", "c")
        state = materialise(state, "radix")
        old.append(state)
        state = state if step == 0 else state.drop("c")
    limit = state.select(*GROUP, F.col("digit").alias("limit"), "need", "c")
    marked = meet(rated, limit, GROUP, "item")
    sure = [marked.where("value > limit OR value = limit AND c <= need").select(*GROUP, "item", "value")]
    ties = materialise(marked.where("value = limit AND c > need").select(*GROUP, "item", "value", "need", F.encode("item", "UTF-8").alias("raw")), "ties")
    old.append(ties)
    while not ties.isEmpty():
        ends = ties.groupBy(*GROUP).agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).select(*GROUP, _common("lo", "hi").alias("same"))
        digits = meet(ties, ends, GROUP, "item").withColumn("bin", F.expr(f"substring(raw, same + 1, {DIGIT_BYTES})"))
        bins = digits.groupBy(*GROUP, "bin", "need").agg(F.count("*").alias("c"))
        edge = _threshold(bins, F.col("bin").asc()).select(*GROUP, F.col("bin").alias("edge"), F.col("need").alias("more"), "c")
        split = materialise(meet(digits, edge, GROUP, "item").where("bin <= edge").select(
            *GROUP, "item", "value", "raw", F.col("more").alias("need"), (F.expr("bin < edge OR c <= more")).alias("sure")), "ties")
        old.append(split)
        sure.append(split.where("sure").select(*GROUP, "item", "value"))
        ties = split.where("NOT sure").drop("sure")
    out = sure[0]
    for more in sure[1:]:
        out = out.union(more)
    chosen = materialise(out, "chosen")  # at most k rows for each group
    discard(*old)
    return chosen


def _threshold(bins: DataFrame, order: Column) -> DataFrame:
    """The bin of each group's needed row, or its last one; ``need`` is then what is needed from that bin."""
    along = W.partitionBy(*GROUP).orderBy(order)
    before = F.coalesce(F.sum("c").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    reached = bins.withColumn("before", before).withColumn("last", F.lead("c").over(along).isNull())
    return reached.where("before < need AND (before + c >= need OR last)").withColumn("need", F.col("need") - F.col("before"))


def _common(lo: str, hi: str) -> Column:
    """How many bytes two strings share at their start."""
    return F.expr(f"coalesce(try_element_at(filter(sequence(1, greatest(1, least(length({lo}), length({hi})))), i -> substring({lo}, i, 1) <> substring({hi}, i, 1)), 1) - 1, "
                  f"least(length({lo}), length({hi})))")


def audit_sources(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: part ``pair`` has every other source of the language, part ``term`` the group's ``top`` terms.

    A null text, language or source is the empty string; a group without terms, or in a language
    without kept terms, has its pairs. Rows are documents, so repeated ones count again. Long
    texts and terms are taken whole. Equal values rank by the item's UTF-8 bytes. An empty
    table gives no rows; other columns are not read.
    """
    terms = materialise(term_counts(docs, text_col, lang_col, source_col), "term-counts")
    named = terms.where("term IS NOT NULL")
    kept = materialise(named.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("d")).where(F.col("d") >= least_docs).drop("d"), "kept-terms")
    found = named.select(*GROUP, "term", "n").join(kept, ["lang", "term"])
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    own = found.groupBy(*GROUP).agg(F.sum("n").alias("total"))
    none = F.lit(0).cast("bigint")
    groups = (terms.where("term IS NULL").select(*GROUP).join(own, GROUP, "left").join(langs, "lang", "left")
              .select(*GROUP, *(F.coalesce(c, none).alias(c) for c in ("kept", "total", "lang_total"))))
    groups = materialise(groups.withColumn("p0", F.when(F.col("kept") > 0, share(none, F.col("total"), F.col("kept"))).otherwise(F.lit(1).cast("bigint"))), "groups")
    c = F.col
    held = materialise(meet(found, groups.drop("p0"), GROUP, "term").select(
        *GROUP, "term", "n", share(c("n"), c("total"), c("kept")).alias("p"), share(c("lang_n"), c("lang_total"), c("kept")).alias("q")), "held-terms")
    discard(terms, kept)
    telling = held.where("p > q").select(*GROUP, F.col("term").alias("item"), divergence(c("p"), c("q")).alias("value"))
    best = W.partitionBy(*GROUP, "part").orderBy(F.col("value").desc(), F.col("item"))
    both = (pair_values(held, groups).withColumn("part", F.lit("pair"))
            .unionByName(top_terms(telling, top).withColumn("part", F.lit("term"))))
    return both.select(*GROUP, "part", "item", "value", F.row_number().over(best).alias("rank"))


def op13_source_divergence(spark, sf_dir):
    """All documents, by language and source."""
    return audit_sources(table(spark, sf_dir, "documents"))


OP13_SQL = r"""WITH d AS (
  SELECT coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc FROM documents),
w AS (
  SELECT doc, lang, source, translate(term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT doc, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d)),
kept AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY lang, term HAVING count(DISTINCT doc) >= 10),
own AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term),
grp AS (SELECT DISTINCT lang, source FROM d),
dense AS (
  SELECT lang, source, term, lang_n, coalesce(n, 0) AS n FROM grp JOIN kept USING (lang) LEFT JOIN own USING (lang, source, term)),
p AS (
  SELECT lang, source, term, n,
         1 + (1000000000 * (n + 2)::HUGEINT) // (sum(n) OVER g + 2 * count(*) OVER g) AS p,
         1 + (1000000000 * (lang_n + 2)::HUGEINT) // (sum(lang_n) OVER g + 2 * count(*) OVER g) AS q
  FROM dense WINDOW g AS (PARTITION BY lang, source)),
pair AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
v AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pair.value, 0)::BIGINT AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM v)
WHERE part = 'pair' OR rank <= 10"""
