"""Personal data: patterns, and terms that give protected entities away by co-occurrence.

DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavequarry.llm.common import id_and_text, materialise, table

KINDS = ("email", "ip", "card", "phone")
#: Kinds of the terms that the method adds.
REMOVED, GENERAL = "term_removed", "term_general"
#: Code points on either side of an entity in which its terms are looked for.
WINDOW = 64
#: One-sided normal quantile of the share's lower bound (95 %).
Z = 1.645
#: Code points from which on a term that an entity's own text contains is one that spells it.
SPELLED = 4
#: Most frequent terms, by which words that can't be disclosing leave before a shuffle.
FREQUENT = 65_536
#: Least lower bound of the share of a term's occurrences that lie beside one entity: to be generalised (three of three), and to be removed (eleven of eleven).
GENERAL_SHARE, REMOVED_SHARE = 0.5, 0.8
#: Least disclosure in bits: lower bound * log2(lower bound / share of the entity among all words).
BITS = 4.0

# The patterns find what the plain ones find, in time linear in the text: what can't be
# given back is possessive, and runs are entered at their start alone (or where a match ended).
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# whole runs of 14 to 19 digits with single separators; other runs can't pass
_CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_WORD = r"[^\x20\x09-\x0D]+"
_SPACE = r"[\x20\x09-\x0D]+"
_EDGES = ".,;:!?()[]{}<>\"'"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, F.lit("[^0-9]"), F.lit(""))


def _ip_ok(match: Column) -> Column:
    def part_ok(p: Column) -> Column:
        short = F.regexp_replace(p, F.lit("^0+"), F.lit(""))
        return (F.length(short) < 3) | ((F.length(short) == 3) & (short <= F.lit("255")))

    return F.forall(F.split(match, r"\."), part_ok)


def _luhn_ok(match: Column) -> Column:
    d = _digits(match)

    def add(total: Column, i: Column) -> Column:
        x = F.ascii(F.substr(d, i, F.lit(1))) - 48
        twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return total + F.when((F.length(d) - i) % 2 == 1, twice).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def _phone_ok(match: Column) -> Column:
    return F.length(_digits(match)).between(10, 15)


def _located(text: Column, pattern: str, keep=None) -> Column:
    """``array<struct<s, e, m>>``: leftmost matches with their places, in code points, end exclusive; of those, the ones that ``keep(m)`` names.

    What lies before each match is as long as the pieces and matches up to it.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<s:int,e:int,m:string>>")
    zipped = F.arrays_zip(matches.alias("m"), F.slice(pieces, F.lit(1), F.size(matches)).alias("p"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["1"])
        e = s + F.length(x["0"])
        more = F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["0"].alias("m"))))
        return F.struct(e.alias("at"), (more if keep is None else F.when(keep(x["0"]), more).otherwise(acc["out"])).alias("out"))

    named = F.transform(zipped, lambda x: F.struct(x["m"].alias("0"), x["p"].alias("1")))
    return F.when(F.size(matches) == 0, empty).otherwise(
        F.aggregate(named, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"]))


def base_spans(text: Column) -> Column:
    """``array<struct<s, rank, kind, e, m>>`` of the four kinds, by start and kind."""
    def of(rank: int, needs: str, pattern: str, ok) -> Column:
        found = F.filter(_located(text, pattern), lambda x: ok(x["m"])) if ok else _located(text, pattern)
        shaped = F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("rank"), F.lit(KINDS[rank]).alias("kind"), x["e"].alias("e"), x["m"].alias("m")))
        none = F.array().cast("array<struct<s:int,rank:int,kind:string,e:int,m:string>>")
        return F.when(text.rlike(needs), shaped).otherwise(none)

    return F.array_sort(F.concat(of(0, "@", _EMAIL, None), of(1, r"[0-9]\.[0-9]", _IP, _ip_ok),
                                 of(2, _CARD, _CARD, _luhn_ok), of(3, r"\+[0-9]", _PHONE, _phone_ok)))


def span_string(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def _text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def _term(word: Column) -> Column:
    return F.btrim(F.lower(word), F.lit(_EDGES))


def _entity(kind: Column, match: Column) -> Column:
    plain = F.when(kind.isin("card", "phone"), _digits(match)).otherwise(F.lower(match))
    return F.concat_ws(":", kind, plain)


def found_entities(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(t1, t2, n, base, near)`` for the rows of ``texts(t1, t2, text)`` that have base spans: n code points, the spans, and each one's text around it as ``(b, ls, lw, rw)``."""
    def around(b: Column) -> Column:
        ls = F.greatest(b["s"] - window, F.lit(0))
        return F.struct(b.alias("b"), ls.alias("ls"), F.substr("text", ls + 1, b["s"] - ls).alias("lw"), F.substr("text", b["e"] + 1, F.lit(window)).alias("rw"))

    based = texts.select("t1", "t2", "text", base_spans(F.col("text")).alias("base")).where(F.size("base") > 0)
    return based.select("t1", "t2", F.length("text").alias("n"), "base", F.transform("base", around).alias("near"))


def entity_words(found: DataFrame) -> DataFrame:
    """``(t1, t2, entity, term, s, e)``: the whole words around each base span of ``found_entities``.

    Words that a window's end or the entity itself parts, and words that overlap a base span, are left out.
    """
    near = (
        found.select("t1", "t2", "n", "base", F.explode("near").alias("x"))
        .select("t1", "t2", "n", "base", _entity(F.col("x.b.kind"), F.col("x.b.m")).alias("entity"), "x.ls", F.col("x.b.s").alias("bs"), F.col("x.b.e").alias("be"), "x.lw", "x.rw")
    )
    sides = F.array(
        F.struct(F.col("ls").alias("at"), F.col("lw").alias("w"), (F.col("ls") > 0).alias("cut_l"), F.lit(True).alias("cut_r")),
        F.struct(F.col("be").alias("at"), F.col("rw").alias("w"), F.lit(True).alias("cut_l"), (F.col("be") + F.length("rw") < F.col("n")).alias("cut_r")))
    words = (
        near.select("t1", "t2", "base", "entity", F.explode(sides).alias("side"))
        .select("t1", "t2", "base", "entity", "side", F.explode(_located(F.col("side.w"), _WORD)).alias("x"))
        .where(~(F.col("side.cut_l") & (F.col("x.s") == 0)) & ~(F.col("side.cut_r") & (F.col("x.e") == F.length("side.w"))))
        .select("t1", "t2", "base", "entity", _term(F.col("x.m")).alias("term"),
                (F.col("side.at") + F.col("x.s")).alias("s"), (F.col("side.at") + F.col("x.e")).alias("e"))
        .where(F.col("term") != "")
    )
    apart = F.expr("NOT exists(base, b -> b.s < e AND b.e > s)")
    return words.where(apart).select("t1", "t2", "entity", "term", "s", "e")


def term_counts(texts: DataFrame) -> DataFrame:
    """``(term, n_t)``: occurrences in all texts, summed in parts before they are shuffled."""
    return (texts.select(F.explode(F.split(F.lower("text"), _SPACE)).alias("w")).select(F.btrim("w", F.lit(_EDGES)).alias("term"))
            .where("term <> ''").groupBy("term").agg(F.count("*").alias("n_t")))


def lower_share(k: Column, n: Column, z: float = Z) -> Column:
    """Wilson's lower bound of a share of which ``k`` of ``n`` are seen: few occurrences are little evidence."""
    return (k + z * z / 2 - z * F.sqrt(k * (n - k) / n + z * z / 4)) / (n + z * z)


def disclosing_terms(words: DataFrame, every: DataFrame, z: float = Z, general: float = GENERAL_SHARE,
                     removed: float = REMOVED_SHARE, bits: float = BITS, spelled: int = SPELLED) -> DataFrame:
    """``(term, kind)`` for terms whose occurrences give an entity away.

    share = the lower bound, at ``z``, of the part of all of the term's occurrences in ``every`` that lie beside the entity;
    disclosure = share * log2(share / (entity's words / all words)). One or two occurrences are no evidence of co-occurrence and never
    reach a threshold: such a term, or any other that stands beside one entity alone, is generalised only where the entity's own text contains it, from
    ``spelled`` code points on (a name in an address). A term of several entities takes the strictest kind.
    """
    beside = words.groupBy("term", "entity").agg(F.count("*").alias("n_te"))
    entity = beside.groupBy("entity").agg(F.sum("n_te").alias("n_e"))
    total = every.agg(F.sum("n_t").alias("n"))
    k = F.least("n_te", "n_t").cast("double")
    own = F.regexp_replace("entity", "^[a-z]+:", "")
    spells = (F.col("n_te") >= F.col("n_t")) & (F.length("term") >= spelled) & F.contains(own, F.col("term"))
    rated = (
        beside.join(every, "term").join(entity, "entity").join(F.broadcast(total))
        .select("term", lower_share(k, F.col("n_t").cast("double"), z).alias("share"), "n", "n_e", spells.alias("spells"))
        .select("term", "share", "spells", (F.col("share") * F.log2(F.col("share") * F.col("n") / F.col("n_e"))).alias("bits"))
    )
    told = (F.col("share") >= general) & (F.col("bits") >= bits)
    return rated.where(told | F.col("spells")).groupBy("term").agg(
        F.max(F.when(told & (F.col("share") >= removed), F.lit(REMOVED)).otherwise(F.lit(GENERAL))).alias("kind"))


def text_terms(texts: DataFrame, terms: DataFrame, every: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """``(t1, t2, gone, general)``: for each text that holds any of ``terms(term, kind)``, wherever it stands, those to be removed and generalised.

    The ``frequent`` most frequent terms are broadcast with their kinds, so the words
    of a text that are shuffled are the rarer ones, and no key of theirs is large.
    """
    top = every.orderBy(F.desc("n_t"), "term").limit(frequent).select("term").join(terms, "term", "left").select("term", F.lit(True).alias("top"), F.col("kind").alias("top_kind"))
    held = texts.select("t1", "t2", F.explode(F.array_distinct(F.transform(F.split("text", _SPACE), _term))).alias("term")).where("term <> ''")
    some = (held.join(F.broadcast(top), "term", "left").where("top IS NULL OR top_kind IS NOT NULL")
            # what is decided gets a key that no term has, apart for each text
            .withColumn("key", F.when(F.col("top").isNull(), F.col("term")).otherwise(F.concat(F.lit(" "), F.col("t1").cast("string")))))
    rare = terms.select(F.col("term").alias("key"), "kind")
    hits = some.join(rare, "key", "left").select("t1", "t2", "term", F.coalesce("top_kind", "kind").alias("kind")).where("kind IS NOT NULL")
    of = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.col("term")))
    return hits.groupBy("t1", "t2").agg(of(REMOVED).alias("gone"), of(GENERAL).alias("general"))


def marked_texts(texts: DataFrame, how: dict | None = None) -> DataFrame:
    """``(t1, t2, base, gone, general)`` for each distinct text of ``texts(t1, t2, text)`` that has base spans or disclosing terms."""
    found = materialise(found_entities(texts), "entities")
    every = materialise(term_counts(texts), "terms")
    terms = materialise(disclosing_terms(entity_words(found), every, **(how or {})), "disclosing-terms")
    hits = text_terms(texts, terms, every)
    return found.select("t1", "t2", "base").dropDuplicates(["t1", "t2"]).join(hits, ["t1", "t2"], "full")


def _extra() -> Column:
    """The spans of all occurrences of a text's ``gone`` and ``general`` terms; words that overlap a base span are left out."""
    def among(kind: str):
        return lambda m: F.array_contains(F.col(kind), _term(m))

    found = F.filter(_located(F.col("text"), _WORD, lambda m: among("gone")(m) | among("general")(m)),
                     lambda w: ~F.exists("base", lambda b: (b["s"] < w["e"]) & (b["e"] > w["s"])))
    shaped = F.transform(found, lambda w: F.struct(
        w["s"].alias("s"), F.when(among("gone")(w["m"]), 4).otherwise(5).alias("rank"),
        F.when(among("gone")(w["m"]), REMOVED).otherwise(GENERAL).alias("kind"), w["e"].alias("e"), F.lit("").alias("m")))
    none = F.array().cast("array<struct<s:int,rank:int,kind:string,e:int,m:string>>")
    return F.when(F.col("gone").isNotNull(), shaped).otherwise(none)


def _with_spans(keyed: DataFrame, how: dict) -> DataFrame:
    """The rows of ``keyed(t1, t2, text, ...)`` with ``base``, ``gone`` and ``general``. Base patterns run once over each text."""
    marked = marked_texts(keyed.select("t1", "t2", "text"), how)
    none = F.array().cast("array<struct<s:int,rank:int,kind:string,e:int,m:string>>")
    return keyed.join(marked, ["t1", "t2"], "left").withColumn("base", F.coalesce("base", none))


def _all_spans() -> Column:
    return F.array_sort(F.concat(F.col("base"), _extra()))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans.

    A null text is empty and has no spans. Equal texts have equal spans; null ids and
    repeated rows are rows of their own, though a text's copies count for the
    corpus as often as they occur. An empty table gives none.
    """
    plain = id_and_text(docs, id_col, text_col)
    keyed = plain.select("doc_id", "text", *_text_key(F.col("text")))
    counts = [F.size(F.filter("base", lambda x: x["kind"] == F.lit(k))).cast("bigint").alias(f"n_{k}") for k in KINDS]  # noqa: B023
    return _with_spans(keyed, how).select(
        "doc_id", *counts, F.sha2(span_string(F.col("base")), 256).alias("base_sha256"), span_string(_all_spans()).alias("spans"))


def _merged(spans: Column) -> Column:
    """Overlapping spans joined; the first one's kind names them."""
    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1),
                          F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"), last["kind"].alias("kind"))))
        more = F.concat(acc, F.array(F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["e"] > x["s"]), joined).otherwise(more)

    return F.aggregate(spans, F.array().cast("array<struct<s:int,e:int,kind:string>>"), step)


def term_class(word: Column) -> Column:
    """What a generalised term becomes: the class of its shape."""
    bare = F.btrim(word, F.lit(_EDGES))
    letter, digit = bare.rlike(r"\p{L}"), bare.rlike(r"\p{N}")
    return F.when(digit & letter, "[CODE]").when(digit, "[NUMBER]").when(bare.rlike(r"^\p{Lu}"), "[NAME]").when(letter, "[WORD]").otherwise("[SIGN]")


def _rewritten(text: Column, spans: Column) -> Column:
    """Base spans become their kind in brackets, generalised terms the class of their shape; removed terms go."""
    word = lambda x: F.substr(text, x["s"] + 1, x["e"] - x["s"])
    mark = lambda x: F.when(x["kind"] == REMOVED, "").when(x["kind"] == GENERAL, term_class(word(x))).otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
    before = lambda x, i: F.when(i == 0, 0).otherwise(F.element_at(spans, F.greatest(i, F.lit(1)))["e"])
    parts = F.transform(spans, lambda x, i: F.concat(F.substr(text, before(x, i) + 1, x["s"] - before(x, i)), mark(x)))
    return F.concat(F.array_join(parts, ""), F.substr(text, F.element_at(spans, -1)["e"] + 1))


def sanitise(docs: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """All rows and columns of ``docs``, the text without personal data and the terms that give it away.

    A text without spans, null included, stays as it is; a very long one is treated as a whole. Equal texts are treated alike; repeated
    rows and null ids are rows like others. An empty table gives none.
    """
    cols = docs.columns
    inner = docs.select(F.struct(*(F.col(f"`{c}`") for c in cols)).alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    keyed = inner.select("row", "text", *_text_key(F.col("text")))
    spans = _with_spans(keyed, how).select("row", "text", _merged(_all_spans()).alias("spans"))
    new = F.when(F.size("spans") == 0, F.col(f"row.`{text_col}`")).otherwise(_rewritten(F.col("text"), F.col("spans")))
    return spans.select(*(new.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in cols))


def op10_personal_data(spark, sf_dir):
    """Personal data and disclosing terms of all documents."""
    return find_personal_data(table(spark, sf_dir, "documents"))
