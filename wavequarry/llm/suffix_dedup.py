"""Exact removal of byte strings that repeat, by sorting sampled suffixes and their contexts."""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavequarry.llm.common import discard, let_go, materialise, table
from wavequarry.llm.suffix_sort import common_prefix, deep_shallow_sort

LENGTH = 400
#: Bytes of a repeated passage of over 50 words: in the languages at hand 99 of 100 stretches of 51 words have more.
PASSAGE = 240
#: Bytes of an anchor's seed; any window of the least length looked for has an anchor whose seed lies in it.
SEED = 64
#: Distinct contexts of a seed that are sorted in one task; seeds with more are decided by window hashes.
GROUP_LIMIT = 16_384
RANGES = 16
_SEGMENT = 1 << 20
_MULT = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


class Anchors:
    """Positions chosen by content: the seed of least hash, leftmost of equals, of every window."""

    def __init__(self, length: int = LENGTH, seed: int = SEED):
        self.length, self.seed = length, seed
        rng = np.random.default_rng(11)
        self._bytes = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
        self._up = self._down = np.empty(0, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self._up) < n:
            base = np.uint64(0x5851F42D4C957F2D)
            inverse = np.uint64(pow(int(base), -1, 1 << 64))
            size = min(max(n, 4096) * 2, _SEGMENT + self.length + 8)
            with np.errstate(over="ignore"):
                self._up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, base)]))
                self._down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, inverse)]))

    def _segment(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, k = len(a), self.seed
        self._powers(n + 1)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        with np.errstate(over="ignore"):
            np.cumsum(self._bytes[a] * self._down[:n], out=total[1:])
            h = (total[k:] - total[:-k]) * self._up[: n - k + 1]
            h ^= h >> np.uint64(29)
            h *= np.uint64(_MULT)
            h ^= h >> np.uint64(32)
        w = self.length - k + 1
        m = len(h)
        low = np.uint64((1 << 22) - 1)
        v = (h & ~low) | np.arange(m, dtype=np.uint64)
        padded = np.full(-(-m // w) * w, _MASK, np.uint64)
        padded[:m] = v
        grid = padded.reshape(-1, w)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        at = (np.minimum(behind[: m - w + 1], ahead[w - 1:m]) & low).astype(np.int64)
        at = at[np.concatenate([[True], at[1:] != at[:-1]])]
        return at, h[at]

    def of(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Positions and seed hashes; none for texts shorter than a window."""
        if len(raw) < self.length:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        a = np.frombuffer(raw, np.uint8)
        found = []
        for at in range(0, len(a) - self.length + 1, _SEGMENT):
            p, h = self._segment(a[at:at + _SEGMENT + self.length - 1])
            found.append((p + at, h))
        if len(found) == 1:
            return found[0]
        p, h = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
        p, first = np.unique(p, return_index=True)
        return p, h[first]


def reach(contexts: list[tuple[bytes, bytes]], counts: list[int], lengths: tuple[int, ...], start: int = 0) -> list[list[tuple[int, int] | None]]:
    """For each of ``lengths`` and each context ``(left, right)`` of one seed: how far left and right repeats of that many bytes around it go, or None.

    A repeat with another context reaches l bytes left and r right, where l and r are
    the pair's common suffix and prefix and l + r >= length. Right sides are sorted;
    left sides are sorted reversed and merged from the longest common suffix down,
    the smaller set into the larger, each element meeting its neighbours in the
    order of the right sides: all other pairs reach no farther. Contexts that
    occur twice or more repeat as a whole.
    """
    n = len(contexts)
    right = [r for _, r in contexts]
    left = [x[::-1] for x, _ in contexts]
    rank = [0] * n
    by_right = deep_shallow_sort(right, start=start)
    for k, i in enumerate(by_right):
        rank[i] = k
    by_left = deep_shallow_sort(left)
    far_l, far_r, best = [[-1] * n for _ in lengths], [[-1] * n for _ in lengths], [-1] * n
    sets: list[list[int] | None] = [[rank[i]] for i in by_left]
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    least, each = min(lengths), list(zip(lengths, far_l, far_r, strict=True))
    shared = [common_prefix(left[a], left[b]) for a, b in zip(by_left, by_left[1:], strict=False)]
    for k in sorted(range(n - 1), key=shared.__getitem__, reverse=True):
        depth, a, b = shared[k], root(k), root(k + 1)
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        large, small = sets[a], sets[b]
        for x in small:
            at = bisect_left(large, x)
            i = by_right[x]
            for y in large[max(0, at - 1):at + 1]:
                j = by_right[y]
                r = common_prefix(right[i], right[j])
                for p in (i, j):
                    if r > best[p]:
                        best[p] = r
                        if depth + r >= least:
                            for length, fl, fr in each:
                                if depth + r >= length:
                                    fr[p] = r
                                    if fl[p] < 0:
                                        fl[p] = depth
        up[b] = a
        if len(small) < 16:
            for x in small:
                insort(large, x)
        else:
            large += small
            large.sort()
        sets[b] = None
    return [[(len(x), len(r)) if c > 1 and len(x) + len(r) >= length else (fl, fr) if fl >= 0 else None
             for (x, r), c, fl, fr in zip(contexts, counts, left_of, right_of, strict=True)] for length, left_of, right_of in each]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _text_key(text: F.Column) -> list[F.Column]:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_ANCHOR = "kmer bigint, ctx bigint, t1 bigint, t2 bigint, pos int, lead int, trail int"


def anchor_rows(texts: DataFrame, lengths: tuple[int, ...], seed: int = SEED) -> DataFrame:
    """Anchors of ``texts(t1, t2, text)`` with a hash of their context: ``least - seed`` bytes before, the greatest of ``lengths`` from it on."""

    def find(batches):
        least, after = min(lengths), max(lengths)
        anchors, digest, before = Anchors(least, seed), xxhash.xxh3_64_intdigest, least - seed
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for t1, t2, text in zip(*(batch.column(c).to_pylist() for c in ("t1", "t2", "text")), strict=True):
                raw = text.encode()
                at, h = anchors.of(raw)
                n = len(raw)
                at = at.tolist()
                cols[0].append(h.view(np.int64))
                cols[1] += [digest(raw[max(0, p - before):p + after], min(p, before)) for p in at]
                cols[2] += [t1] * len(at)
                cols[3] += [t2] * len(at)
                cols[4] += at
                cols[5] += [min(p, before) for p in at]
                cols[6] += [min(n - p, after) for p in at]
            kmer = np.concatenate(cols[0]) if cols[0] else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kmer), pa.array(np.array(cols[1], np.uint64).view(np.int64)), pa.array(cols[2], pa.int64()),
                 pa.array(cols[3], pa.int64()), *(pa.array(c, pa.int32()) for c in cols[4:])],
                ["kmer", "ctx", "t1", "t2", "pos", "lead", "trail"])

    return texts.mapInArrow(find, _ANCHOR)


def _once_a_task(batches):
    """Drops copies of a text that the same task has sent already; 16 bytes are held for each text seen, up to a million."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        keep = []
        for k, key in enumerate(zip(batch.column("t1").to_pylist(), batch.column("t2").to_pylist(), strict=True)):
            if key not in seen:
                if len(seen) >= 1_000_000:
                    seen.clear()
                seen.add(key)
                keep.append(k)
        yield batch.take(pa.array(keep, pa.int64()))


_CONTEXT = "kmer bigint, ctx bigint, n bigint, m bigint, t1 bigint, t2 bigint, pos int, lft binary, rgt binary"


def _contexts(before: int, after: int):

    def cut(batches):
        for batch in batches:
            out = []
            for text, t1, t2, wanted in zip(*(batch.column(c).to_pylist() for c in ("text", "t1", "t2", "wanted")), strict=True):
                raw = text.encode()
                for w in wanted:
                    p = w["pos"]
                    out.append((w["kmer"], w["ctx"], w["n"], w["m"], t1, t2, p, raw[max(0, p - before):p], raw[p:p + after]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            cols = list(zip(*out, strict=True)) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                                             [x.split()[0] for x in _CONTEXT.split(", ")])

    return cut


_SPAN = "t1 bigint, t2 bigint, k int, s int, e int"


def _sort_groups(lengths: tuple[int, ...]):
    """Contexts, sorted by seed, to spans of those that occur once (the others are known to repeat)."""

    def decide(group, out):
        if len(group) > 1:
            found = reach([(g[6], g[7]) for g in group], [g[2] for g in group], lengths)
            out += [(g[3], g[4], k, g[5] - f[0], g[5] + f[1]) for k, own in enumerate(found) for g, f in zip(group, own, strict=True) if f and g[2] == 1]

    def run(batches):
        key, group, names = None, [], ("kmer", "ctx", "n", "t1", "t2", "pos", "lft", "rgt")
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if row[0] != key:
                    decide(group, out)
                    key, group = row[0], []
                if not group or group[-1][1] != row[1]:  # a context may come from several copies
                    group.append(row)
            yield _spans(out)
        out = []
        decide(group, out)
        yield _spans(out)

    return run


def _spans(rows) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)],
                                      ["t1", "t2", "k", "s", "e"])


def _range_rows(length: int, before: int, ranges: int):
    """For each range of window offsets: a hash of the bytes that all its windows share, and of all bytes they cover."""
    step = -(-(before + 1) // ranges)

    def run(batches):
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            out = []
            for kmer, ctx, n, lft, rgt in zip(*(batch.column(c).to_pylist() for c in ("kmer", "ctx", "n", "lft", "rgt")), strict=True):
                low, high = max(0, length - len(rgt)), len(lft)  # windows start ``i`` bytes before the anchor
                whole, at = lft + rgt, len(lft)
                for j in range(ranges):
                    first, last = j * step, min(before, (j + 1) * step - 1)
                    a, b = max(low, first), min(high, last)  # near a text's ends some windows are missing
                    if a <= b:
                        core, cover = whole[at - first:at + length - last], whole[at - b:at + length - a]
                        out.append((kmer, ctx, n, j, _signed(digest(core)), _signed(digest(cover, (a << 16) + b)), a, b))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            cols = list(zip(*out, strict=True)) if out else [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                                             ["kmer", "ctx", "n", "j", "core", "cover", "a", "b"])

    return run


def _window_rows(length: int):
    def run(batches):
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            out = []
            for kmer, ctx, n, lft, rgt, spans in zip(*(batch.column(c).to_pylist() for c in ("kmer", "ctx", "n", "lft", "rgt", "spans")), strict=True):
                whole, at = lft + rgt, len(lft)
                out += [(kmer, ctx, n, i, _signed(digest(whole[at - i:at - i + length]))) for s in spans for i in range(s["a"], s["b"] + 1)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["kmer", "ctx", "n", "i", "win"])

    return run


def _hot_spans(hot: DataFrame, length: int, before: int, ranges: int) -> DataFrame:
    """Spans of contexts whose seed has very many: windows are counted, no group is gathered.

    Ranges of window offsets whose shared bytes don't repeat are out, those whose
    covered bytes repeat are in, and of the rest each window is counted. Hashes
    stand for bytes, beside the seed's hash and the offset: 128 bits in all.
    """
    rows = materialise(hot.mapInArrow(_range_rows(length, before, ranges), "kmer bigint, ctx bigint, n bigint, j int, core bigint, cover bigint, a int, b int"), "ranges")
    core = rows.groupBy("kmer", "j", "core").agg(F.sum("n").alias("c")).where("c > 1").select("kmer", "j", "core")
    cover = rows.groupBy("kmer", "j", "cover").agg(F.sum("n").alias("c")).where("c > 1").select("kmer", "j", "cover", F.lit(True).alias("whole"))
    open_ = rows.join(core, ["kmer", "j", "core"], "left_semi").join(cover, ["kmer", "j", "cover"], "left")
    open_ = materialise(open_.select("kmer", "ctx", "j", "core", "a", "b", F.coalesce("whole", F.lit(False)).alias("whole")), "ranges-open")
    mixed = open_.where("NOT whole").select("kmer", "j", "core").distinct()  # one that is in may be what makes another's window repeat
    todo = open_.join(mixed, ["kmer", "j", "core"], "left_semi").groupBy("kmer", "ctx").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    windows = materialise(hot.join(todo, ["kmer", "ctx"]).select("kmer", "ctx", "n", "lft", "rgt", "spans")
                          .mapInArrow(_window_rows(length), "kmer bigint, ctx bigint, n bigint, i int, win bigint"), "windows")
    twice = windows.groupBy("kmer", "i", "win").agg(F.sum("n").alias("c")).where("c > 1").select("kmer", "i", "win")
    found = (windows.join(twice, ["kmer", "i", "win"], "left_semi").select("kmer", "ctx", F.col("i").alias("a"), F.col("i").alias("b"))
             .union(open_.where("whole").select("kmer", "ctx", "a", "b"))
             .groupBy("kmer", "ctx").agg(F.max("b").alias("far"), F.min("a").alias("near")))
    return hot.where("n = 1").select("kmer", "ctx", "t1", "t2", "pos").join(found, ["kmer", "ctx"]).select(
        "t1", "t2", (F.col("pos") - F.col("far")).alias("s"), (F.col("pos") + length - F.col("near")).alias("e"))


def repeated_spans(texts: DataFrame, lengths: tuple[int, ...] = (LENGTH,), seed: int = SEED, group_limit: int = GROUP_LIMIT, ranges: int = RANGES) -> DataFrame:
    """Per distinct text of ``texts(t1, t2, text)`` that has any: ``spans`` of ``(k, s, e)``, bytes s to e covered by strings of ``lengths[k]`` bytes that start elsewhere too.

    1. Anchors, one in about ``(least length - seed) / 2`` bytes, are chosen by content, so that
       equal windows have equal anchors. Only hashes of them are shuffled.
    2. Anchors whose whole context occurs twice repeat as a whole.
    3. Of seeds with several contexts, one text of each context gives its bytes, and
       each seed's contexts are sorted in a task; seeds with more than
       ``group_limit`` are decided by counting windows.
    """
    before, after = min(lengths) - seed, max(lengths)
    texts = texts.where(F.octet_length("text") >= min(lengths))
    rows = materialise(anchor_rows(texts, lengths, seed), "anchors")
    each = rows.groupBy("kmer", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("t1", "t2", "pos")).alias("at"))
    seeds = each.groupBy("kmer").agg(F.count("*").alias("m"), F.sum("n").alias("all")).where("all > 1").select("kmer", "m")
    ctx = materialise(each.join(seeds, "kmer").select("kmer", "ctx", "n", "m", "at.*"), "contexts")  # of seeds that occur once nothing repeats
    wanted = ctx.where("m > 1").groupBy("t1", "t2").agg(F.collect_list(F.struct("kmer", "ctx", "n", "m", "pos")).alias("wanted"))
    sent = texts.mapInArrow(_once_a_task, "t1 bigint, t2 bigint, text string")
    cut = sent.join(wanted, ["t1", "t2"]).select("t1", "t2", "text", "wanted").mapInArrow(_contexts(before, after), _CONTEXT)
    hot = ctx.where(F.col("m") > group_limit).limit(1).count()
    if hot:
        cut = materialise(cut, "cut")
    sorted_ = (cut.where(F.col("m") <= group_limit).repartition("kmer").sortWithinPartitions("kmer", "ctx")
               .mapInArrow(_sort_groups(lengths), _SPAN))
    sorted_ = materialise(sorted_, "sorted-spans")  # the texts' and contexts' shuffles can go
    again = rows.join(ctx.where("n > 1").select("kmer", "ctx"), ["kmer", "ctx"], "left_semi").select(
        "t1", "t2", (F.col("pos") - F.col("lead")).alias("s"), (F.col("pos") + F.col("trail")).alias("e"))
    spans = sorted_
    for k, length in enumerate(lengths):
        spans = spans.union(again.where(F.col("e") - F.col("s") >= length).select("t1", "t2", F.lit(k).alias("k"), "s", "e"))
        if hot:
            own = _hot_spans(cut.where(F.col("m") > group_limit).dropDuplicates(["kmer", "ctx"]), length, before, ranges)
            spans = spans.union(own.select("t1", "t2", F.lit(k).alias("k"), "s", "e"))
    found = materialise(spans.groupBy("t1", "t2").agg(F.collect_set(F.struct("k", "s", "e")).alias("spans")), "spans")
    discard(rows, ctx, sorted_, *([cut] if hot else []))
    let_go(texts.sparkSession)
    return found


def _cut(text: str, spans, k: int = 0) -> tuple[bytes, bytes, int, int]:
    """The text's bytes, those without the spans of length ``k``, how many go, and in how many runs."""
    raw = text.encode()
    m = merged([(x["s"], x["e"]) for x in spans if x["k"] == k]) if spans is not None else []
    kept = b"".join(raw[a:b] for a, b in zip([0, *(e for _, e in m)], [*(s for s, _ in m), len(raw)], strict=True))
    return raw, kept, sum(e - s for s, e in m), len(m)


def _with_spans(docs: DataFrame, text_col: str, lengths: tuple[int, ...], **how) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    spans = repeated_spans(docs.select(*_text_key(text), text.alias("text")), lengths, **how)
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *_text_key(text))
    return keyed.join(spans, ["t1", "t2"], "left").select("row", F.coalesce(F.col(f"row.`{text_col}`"), F.lit("")).alias("text"), "spans")


def removal_digests(docs: DataFrame, length: int = LENGTH, passage: int | None = None, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans and kept_sha256; with ``passage``, n_passage_bytes also: how many bytes strings of that shorter length cover that start elsewhere too.

    A null text is empty; texts shorter than ``length`` keep all. Of texts that occur
    twice all bytes go, in each copy. Null ids and repeated rows are rows of their
    own. An empty table gives none.
    """
    inner = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", n_passage_bytes bigint" * (passage is not None)

    @F.pandas_udf(schema)
    def digest(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for t, s in zip(text, spans, strict=True):
            raw, kept, gone, n = _cut(t, s)
            rows.append((len(raw), gone, n, hashlib.sha256(kept).hexdigest(), *([_cut(t, s, 1)[2]] if passage is not None else [])))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])

    lengths = (length,) if passage is None else (length, passage)
    return _with_spans(inner, "text", lengths, **how).select("row.doc_id", digest("text", "spans").alias("d")).select("doc_id", "d.*")


def remove_repeats(docs: DataFrame, length: int = LENGTH, text_col: str = "text", **how) -> DataFrame:
    """All rows and columns of ``docs``, bytes of strings of ``length`` bytes that start elsewhere too cut from the text.

    Where a cut parts a character, its other bytes go too. A text without repeats,
    null included, stays as it is; one that repeats as a whole becomes empty, and so do all
    rows of a repeated row. Texts shorter than ``length`` stay. An empty table gives none.
    """

    @F.pandas_udf("string")
    def kept(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([_cut(t, s)[1].decode("utf-8", "ignore") for t, s in zip(text, spans, strict=True)], dtype=object)

    found = _with_spans(docs, text_col, (length,), **how)
    new = F.when(F.col("spans").isNull(), F.col(f"row.`{text_col}`")).otherwise(kept("text", "spans"))
    return found.select(*(new.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def op8_repeats(spark, sf_dir):
    """All documents without the bytes of repeated 400-byte strings, and how much of each is repeated passages."""
    return removal_digests(table(spark, sf_dir, "documents"), LENGTH, PASSAGE)
