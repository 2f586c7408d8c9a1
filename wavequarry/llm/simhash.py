"""SimHash near-duplicates, found with BK-trees over shards of fingerprints."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavequarry.llm.common import connected_components, discard, id_and_text, materialise, table

RADIUS = 2
SEED = 42
#: Fingerprints of one shard's tree; larger shards take the exact neighbour path.
TREE_LIMIT = 4096
_CHUNK = 65_536


def shingles(text: str | None, width: int, seed: int = SEED) -> np.ndarray:
    """Hashes of the word shingles, repeats included; none for a text without words.

    Words are runs of characters other than ASCII white space, A-Z lower-cased.
    A text shorter than ``width`` words is one shingle.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        grams: Iterable[bytes] = [b" ".join(words)]
        n = 1
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
        n = len(words) - width + 1
    return np.fromiter((digest(g, seed) for g in grams), np.uint64, n)


def fingerprint(text: str | None, width: int = 3, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of one text; 0 for a text without words."""
    return fingerprint_of(shingles(text, width, seed))


def fingerprint_of(hashes: np.ndarray) -> int:
    n = len(hashes)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        part = hashes[at:at + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(width: int = 3, seed: int = SEED):
    """A column function: text to signed 64-bit fingerprint."""

    @F.pandas_udf("bigint")
    def of(text: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, width, seed) for t in text], np.uint64).view(np.int64))

    return of


class BKTree:
    """Distinct 64-bit values; a node's children are keyed by their Hamming distance to it."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """The value's node, a new one if it isn't there."""
        values, children = self.values, self.children
        if not values:
            values.append(value)
            children.append({})
            return 0
        at = 0
        while True:
            d = (values[at] ^ value).bit_count()
            if not d:
                return at
            nxt = children[at].get(d)
            if nxt is None:
                children[at][d] = len(values)
                values.append(value)
                children.append({})
                return len(values) - 1
            at = nxt

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Nodes at distance at most ``radius``: only edges between d - radius and d + radius are followed."""
        values, children, todo = self.values, self.children, [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                yield at
            below = children[at]
            if below:
                low, high = d - radius, d + radius
                todo += [c for e, c in below.items() if low <= e <= high]


def shard_links(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """``(value, least value of its group)`` for grouped values other than the least, groups being the shard's own components."""
    tree = BKTree()
    up: list[int] = []

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for v in values:
        near = list(tree.within(v, radius))
        node = tree.add(v)
        if node == len(up):
            up.append(node)
        for other in near:
            a, b = root(node), root(other)
            if a != b:
                lo, hi = (a, b) if tree.values[a] < tree.values[b] else (b, a)
                up[hi] = lo
    return [(v, tree.values[r]) for k, v in enumerate(tree.values) if (r := root(k)) != k]


_PAIRS = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]


def _shard_keys(fp: F.Column) -> F.Column:
    """Six keys: each pair of the four 16-bit blocks. Values at distance 2 or less agree on two blocks at least."""
    block = [F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(4)]
    return F.array(*(F.lit(t << 32) + F.shiftleft(block[i], 16) + block[j] for t, (i, j) in enumerate(_PAIRS)))


def _tree_links(radius: int):
    def link(batches):
        key, held = None, []

        def flush():
            return shard_links(held, radius) if len(held) > 1 else []

        for batch in batches:
            keys, fps, out = batch.column("key").to_pylist(), batch.column("fp").to_pylist(), []
            for k, f in zip(keys, fps, strict=True):
                if k != key:
                    out += flush()
                    key, held = k, []
                held.append(f & 0xFFFFFFFFFFFFFFFF)
            yield _edges(out)
        yield _edges(flush())

    return link


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])


def link_fingerprints(distinct: DataFrame, tree_limit: int = TREE_LIMIT) -> DataFrame:
    """Edges ``(a, b)`` whose components are those of all pairs of ``distinct(fp)`` at distance 2 or less.

    Shards: values that share two of four blocks. Each shard of two or more values
    gets a BK-tree in the task that holds it, which every value of the shard
    searches; a shard's links are given as a star, one edge a value. Shards of
    more than ``tree_limit`` values, which dense groups make, are linked exactly
    by shared neighbours instead: two values differ in at most 2 bits if and only
    if some value is within 1 bit of both, and at most 65 values are within 1 bit of one.
    """
    keyed = distinct.select(F.explode(_shard_keys(F.col("fp"))).alias("key"), "fp")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    some = keyed.join(sizes, "key")
    small = some.where(F.col("c") <= tree_limit).select("key", "fp")
    edges = small.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_tree_links(RADIUS), "a bigint, b bigint")
    near = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_signed(1 << k))) for k in range(64)))
    dense = (some.where(F.col("c") > tree_limit).select("fp").distinct()
             .select("fp", F.explode(near).alias("mid"))
             .select("fp", F.min("fp").over(W.partitionBy("mid")).alias("b")).where("fp <> b")
             .select(F.col("fp").alias("a"), "b"))
    return edges.union(dense)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def components(printed: DataFrame, tree_limit: int = TREE_LIMIT) -> DataFrame:
    """``printed(doc_id, fp)`` to ``(fp, component_id)``, one row a distinct fingerprint.

    component_id is the least doc_id of the component, null ids aside.
    """
    distinct = materialise(printed.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fps")
    labels = connected_components(link_fingerprints(distinct.select("fp"), tree_limit))
    labelled = distinct.join(labels, distinct.fp == labels.node, "left").select(
        "fp", "rep", F.coalesce("label", "fp").alias("label"))
    least = labelled.groupBy("label").agg(F.min("rep").alias("component_id"))
    return materialise(labelled.join(least, "label").select("fp", "component_id"), "components")


def near_duplicates(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row.

    Null and wordless texts have fingerprint zero and link like any other. Rows
    with a null id link and get their component; it is null where no row of the
    component has an id. Repeated rows come back as often. An empty table gives none.
    """
    printed = materialise(id_and_text(docs, id_col, text_col).select("doc_id", fingerprints(width)("text").alias("fp")), "simhash")
    return printed.join(components(printed), "fp", "left").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: For groups by similarity: five-word shingles, and the least Jaccard similarity.
WIDTH, SIMILARITY = 5, 0.8
#: Shard keys of a text: BANDS keys of ROWS least rehashed shingles each.
BANDS, ROWS = 18, 4
#: Bits in which the fingerprints of two similar texts may differ.
REACH = 20
#: Texts of a shard that are searched by a tree; all texts of a larger shard are proposed as one group.
SHARD_LIMIT = 1024
#: Texts and shingles of a candidate group that one task holds besides its guests; larger groups are dealt to several tasks.
PART_TEXTS, PART_SHINGLES = 2048, 4 << 20
#: Texts, about, of a dealt group that all its parts get.
PIVOTS = 64
_FACTORS = np.random.default_rng(19).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketch_of(hashes: np.ndarray) -> np.ndarray:
    """The least of each of BANDS * ROWS rehashings of the shingles."""
    out = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        h = hashes[at:at + 4096]
        h = h ^ (h >> np.uint64(33))
        np.minimum(out, (h[:, None] * _FACTORS).min(axis=0), out=out)
    return out


def similarity_keys():
    """A column function: text to node (a hash of the distinct shingles), their number, their fingerprint, and shard keys (none for a text without words)."""

    @F.pandas_udf("node bigint, n bigint, fp bigint, bands array<bigint>")
    def of(text: pd.Series) -> pd.DataFrame:
        nodes, sizes, fps, bands = [], [], [], []
        for t in text:
            h = np.unique(shingles(t, WIDTH))
            s = sketch_of(h)
            nodes.append(_signed(xxhash.xxh3_64_intdigest(h.tobytes())))
            sizes.append(len(h))
            fps.append(_signed(fingerprint_of(h)))
            bands.append([_signed(xxhash.xxh3_64_intdigest(s[ROWS * k:ROWS * (k + 1)].tobytes(), k)) for k in range(BANDS)] if len(h) else [])
        return pd.DataFrame({"node": nodes, "n": sizes, "fp": fps, "bands": bands})

    return of


class _Groups:
    """Union-find over rows 0 to n - 1; a group's root is its first row."""

    def __init__(self, n: int):
        self._up = list(range(n))

    def root(self, x: int) -> int:
        up = self._up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self._up[max(a, b)] = min(a, b)

    def stars(self) -> list[tuple[int, int]]:
        return [(k, r) for k in range(len(self._up)) if (r := self.root(k)) != k]


def shard_groups(rows: list[tuple[int, int, int]], reach: int = REACH) -> list[tuple[int, int]]:
    """``(node, node of its group)`` for a shard's ``(node, fp, n)``: texts linked where a BK-tree finds their fingerprints within ``reach`` and their sizes allow the similarity."""
    tree, groups = BKTree(), _Groups(len(rows))
    held: list[list[int]] = []
    for k, (_, fp, n) in enumerate(rows):
        fp &= 0xFFFFFFFFFFFFFFFF
        for at in tree.within(fp, reach):
            for other in held[at]:
                m = rows[other][2]
                if min(n, m) >= SIMILARITY * max(n, m):
                    groups.join(k, other)
        at = tree.add(fp)
        if at == len(held):
            held.append([])
        held[at].append(k)
    return [(rows[k][0], rows[r][0]) for k, r in groups.stars()]


class ShingleSets:
    """Texts' sets of distinct shingles, numbered among themselves, in one array."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        self._words, ids = np.unique(flat, return_inverse=True)
        self.flat, self.ends = ids.astype(np.int32), np.concatenate([[0], np.cumsum(self.sizes)])
        self._mark = np.zeros(len(self._words), np.int32)

    def numbered(self, s: np.ndarray) -> np.ndarray:
        """The numbers of those of another set's shingles that are here."""
        at = np.searchsorted(self._words, s)
        at[at == len(self._words)] = 0
        return at[self._words[at] == s] if len(self._words) else at

    def of(self, k: int) -> np.ndarray:
        return self.flat[self.ends[k]:self.ends[k + 1]]

    def alike(self, ids: np.ndarray, size: int, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Which of the sets (``flat`` from each of ``starts``, none empty) have a Jaccard similarity of SIMILARITY or more with one of ``size`` shingles, ``ids`` among them."""
        self._mark[ids] = 1
        same = np.add.reduceat(self._mark[flat], starts)
        self._mark[ids] = 0
        return same / (sizes + size - same) >= SIMILARITY

    def groups(self) -> np.ndarray:
        """For each set the first of its group: the components of all pairs that are alike.

        Each set is held against all that no group has yet; those that are found leave
        and are searched from in turn, so copies cost one comparison each.
        """
        n = len(self.sizes)
        first, left = np.arange(n), np.arange(n)
        flat, starts, sizes = self.flat, self.ends[:-1], self.sizes
        todo: list[int] = []
        seed = 0
        while len(left):
            if not todo:
                seed = int(left[0])
                at, near = seed, np.arange(len(left)) == 0
            else:
                at = todo.pop()
                near = self.alike(self.of(at), int(self.sizes[at]), flat, starts, sizes)
                if not near.any():
                    continue
            first[left[near]] = seed
            todo += left[near].tolist()
            flat = flat[np.repeat(~near, sizes)]
            left, sizes = left[~near], sizes[~near]
            starts = np.cumsum(sizes) - sizes
        return first


def _group_shards(batches):
    key, held = None, []
    for batch in batches:
        out = []
        for k, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "node", "fp", "n")), strict=True):
            if k != key:
                out += shard_groups(held)
                key, held = k, []
            held.append(row)
        yield _signed_edges(out)
    yield _signed_edges(shard_groups(held))


def _exact_links(batches):
    """Rows ``(label, part, turn, guest, comp, node, text)``, sorted, to edges ``(a, b)`` between similar texts of a part.

    In turn 0 all of a part's texts are grouped, guests included. In a later turn its
    guests are held against its own texts: of several of one component that are similar, one is named.
    """
    key, own, guests, sets = None, [], [], {}

    def flush() -> list[tuple[int, int]]:
        if key is None or key[2] == 0:
            names = [n for n, _ in own] + [g for g in guests if g not in {n for n, _ in own}]
            if len(names) < 2:
                return []
            return [(names[k], names[f]) for k, f in enumerate(ShingleSets([sets[x] for x in names]).groups().tolist()) if k != f]
        if not own:
            return []
        held, comps = ShingleSets([sets[n] for n, _ in own]), np.array([c for _, c in own], np.int64)
        out = []
        for g in guests:
            s = sets[g]
            near = np.flatnonzero(held.alike(held.numbered(s), len(s), held.flat, held.ends[:-1], held.sizes))
            out += [(g, own[k][0]) for k in near[np.unique(comps[near], return_index=True)[1]].tolist() if own[k][0] != g]
        return out

    for batch in batches:
        out = []
        for *k, guest, comp, node, text in zip(*(batch.column(c).to_pylist() for c in ("label", "part", "turn", "guest", "comp", "node", "text")), strict=True):
            if k != key:
                out += flush()
                key, own, guests, sets = k, [], [], {}
            # equal nodes have equal shingles; a node may come from several equal rows
            if node not in sets:
                sets[node] = np.unique(shingles(text, WIDTH))
            if guest and (not guests or guests[-1] != node):
                guests.append(node)
            elif not guest and (not own or own[-1][0] != node):
                own.append((node, comp))
        yield _signed_edges(out)
    yield _signed_edges(flush())


def _signed_edges(pairs) -> pa.RecordBatch:
    both = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])


def candidate_groups(nodes: DataFrame, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """``(node, label)`` for the nodes of ``nodes(node, n, fp, bands)`` that may have a similar one.

    Shards are texts that share a band. In each, a BK-tree links texts whose
    fingerprints are near; a shard of more than ``shard_limit`` texts is linked as a
    whole, without a search. A label's nodes are a superset of its similar ones: no similar pair is
    apart but by chance of the bands and the fingerprints.
    """
    keyed = nodes.select("node", "fp", "n", F.posexplode("bands").alias("band", "key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("c"), F.min("node").alias("hub")).where("c > 1")
    shards = keyed.join(sizes, "key")
    trees = (shards.where(F.col("c") <= shard_limit).select("key", "node", "fp", "n")
             .repartition("key").sortWithinPartitions("key", "node").mapInArrow(_group_shards, "a bigint, b bigint"))
    whole = shards.where((F.col("c") > shard_limit) & (F.col("node") != F.col("hub"))).select(F.col("node").alias("a"), F.col("hub").alias("b"))
    return connected_components(trees.union(whole))


def similar_groups(maybe: DataFrame, texts: DataFrame, part_texts: int = PART_TEXTS, part_shingles: int = PART_SHINGLES, pivots: int = PIVOTS) -> DataFrame:
    """``(node, label)`` of the components of all pairs of similar texts within each label of ``maybe(label, node, n, w_id, w_tie)``; nodes alone are left out.

    ``texts(d_id, d_tie, text)`` are joined on. A label of up to ``part_texts`` texts and ``part_shingles``
    shingles is grouped in one task. A larger one is dealt to parts by hash: each is
    grouped with the label's pivots, which connect what is alike across parts. Texts
    that are then not in the label's largest component, in turns of ``part_texts`` at
    most, are held against all parts. So every pair is compared, save those that are connected already.
    """
    sizes = maybe.groupBy("label").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    parts = F.greatest(F.ceil(F.col("c") / part_texts), F.ceil(F.col("s") / part_shingles)).cast("int")
    dealt = materialise(maybe.join(sizes, "label").select("label", "node", "w_id", "w_tie", "n", "c", parts.alias("parts"))
                        .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")), "similar-dealt")

    def rows(df: DataFrame, part: str, turn: str, guest: bool, comp: str = "0L") -> DataFrame:
        return df.selectExpr("label", f"{part} AS part", f"{turn} AS turn", f"{str(guest).lower()} AS guest", f"{comp} AS comp", "node", "w_id", "w_tie")

    def linked(parted: DataFrame) -> DataFrame:
        same = F.col("w_id").eqNullSafe(F.col("d_id")) & (F.col("w_tie") == F.col("d_tie"))
        return (texts.join(parted, same).select("label", "part", "turn", "guest", "comp", "node", "text")
                .repartition("label", "part", "turn").sortWithinPartitions("label", "part", "turn", "guest", "node").mapInArrow(_exact_links, "a bigint, b bigint"))

    large = dealt.where("parts > 1")
    chosen = large.where(F.pmod(F.xxhash64("node", F.lit(7)), F.greatest(F.lit(1), F.floor(F.col("c") / pivots))) == 0).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    edges = materialise(linked(rows(dealt, "part", "0", False).union(rows(chosen, "to", "0", True))), "similar-edges")
    if not large.limit(1).count():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select("b", "b").distinct())
    found = connected_components(edges).withColumnRenamed("label", "comp")
    comps = materialise(large.join(found, "node", "left").select("label", "node", "w_id", "w_tie", "n", "part", "parts", F.coalesce("comp", "node").alias("comp")), "similar-comps")
    most = comps.groupBy("label", "comp").agg(F.count("*").alias("c")).groupBy("label").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"))
    apart = materialise(comps.join(most, "label").where("comp <> main").drop("main"), "similar-apart")
    turns = apart.groupBy("label").agg(F.greatest(F.ceil(F.count("*") / part_texts), F.ceil(F.sum("n") / part_shingles)).cast("int").alias("turns"))
    guests = (apart.join(turns, "label").withColumn("turn", F.pmod(F.xxhash64("node", F.lit(11)), F.col("turns")).cast("int") + 1)
              .withColumn("to", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))))
    own = comps.join(turns, "label").withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("turns"))))
    more = materialise(linked(rows(own, "part", "turn", False, "comp").union(rows(guests, "to", "turn", True))), "similar-edges")
    return connected_components(edges.union(more))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_limit: int = SHARD_LIMIT, **how) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group, one row of the least id stays.

    Groups are components of texts whose sets of five-word shingles have a Jaccard
    similarity of 0.8 or more. BK-trees over fingerprints of the distinct shingles propose
    groups with a margin; within one, pairs are decided on the whole texts' shingles. A
    null text is empty; texts without words are one group. Ties between rows of one id go
    to the least content hash; of wholly equal rows one stays. An id stands before none.
    All columns are kept as they are. An empty table gives none.
    """
    cols = docs.columns
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in cols)).alias("row"), F.col(f"`{id_col}`").cast("bigint").alias("doc_id")).withColumn("tie", F.xxhash64("row"))
    text = F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))
    full = materialise(rows.select("doc_id", "tie", similarity_keys()(text).alias("s")).select("doc_id", "tie", "s.*"), "similar-keys")  # no texts: the rows are read again
    one = F.min(F.struct(F.col("doc_id").alias("w_id"), F.col("tie").alias("w_tie")))
    nodes = materialise(full.groupBy("node").agg(F.min(F.struct("n", "fp", "bands")).alias("s"), one.alias("w")).select("node", "s.*", "w.*"), "similar-nodes")
    maybe = candidate_groups(nodes, shard_limit).join(nodes, "node").select("label", "node", "n", "w_id", "w_tie")
    labels = similar_groups(maybe, rows.select(F.col("doc_id").alias("d_id"), F.col("tie").alias("d_tie"), text.alias("text")), **how)
    ranked = full.select("doc_id", "tie", "node").join(labels, "node", "left").select(
        F.coalesce("label", "node").alias("label"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie").alias("w"))
    best = materialise(ranked.groupBy("label").agg(F.min("w").alias("w")).select(F.col("w.doc_id").alias("w_id"), F.col("w.tie").alias("w_tie")), "similar-best")
    again = full.groupBy("doc_id", "tie").agg(F.count("*").alias("c")).where("c > 1").limit(1).count()
    discard(full, nodes)
    kept = rows.join(best, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("tie") == F.col("w_tie")), "left_semi")
    if again:
        kept = kept.groupBy("doc_id", "tie").agg(F.first("row").alias("row"))
    return kept.select("row.*")


def op6_near_duplicates(spark, sf_dir):
    """Components of all documents' fingerprints at 2 or fewer differing bits."""
    return near_duplicates(table(spark, sf_dir, "documents"))
