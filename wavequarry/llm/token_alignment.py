"""Alignment of two tokenizations by byte owners, and corpus-wide counts of the id pairs that overlap."""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavequarry.llm.byte_bpe import gathered
from wavequarry.llm.common import id_and_text, materialise, table
from wavequarry.llm.rank_array_bpe import byte_letters

#: Characters of text in one block, about; a longer text is a block of its own.
BLOCK_CHARS = 4 << 20
#: Characters of a text handled at once.
STRETCH = 1 << 20
#: Distinct units whose alignment a worker holds.
HELD = 400_000
#: Characters of new units that are aligned at once.
BATCH_CHARS = 1 << 20
BLANK = "▁"

#: A unit: what stands between two places where a blank or line end follows something else than white space.
#: Both tokenizers end a token at each such place.
_QUICK = re.compile("[ \n]*[^ \n]+|[ \n]+").findall
_OTHER_SPACE = re.compile(r"[^\S \n]").search
_CUT = re.compile(r"(?<=\S)(?=[ \n])")
#: A word with a blank before it and no other white space.
_PLAIN = re.compile(r" \S+").fullmatch


def units(text: str) -> list[str]:
    return _CUT.split(text) if _OTHER_SPACE(text) else _QUICK(text)


def stretches(text: str, size: int = STRETCH):
    """``text`` in stretches of about ``size`` characters, cut where a unit ends."""
    at = 0
    while len(text) - at > size:
        found = _CUT.search(text, at + size)
        if found is None:
            break
        yield text[at:found.start()]
        at = found.start()
    yield text[at:]


class Aligned:
    """The alignment of one unit: numbers of tokens, groups and links, the groups as text, and the links' pairs."""

    __slots__ = ("n_a", "n_b", "n_groups", "n_links", "groups", "links")

    def __init__(self, n_a: int, n_b: int, n_groups: int, n_links: int, groups: bytes, links: bytes):
        self.n_a, self.n_b, self.n_groups, self.n_links, self.groups, self.links = n_a, n_b, n_groups, n_links, groups, links


class Aligner:
    """Units to alignments, each distinct one aligned once while it is held.

    ``a_path`` is a byte-level tokenizer's JSON file, ``b_path`` a sentencepiece model that
    puts a blank before a text. A pair is one number: A's id times B's size, plus B's id.
    """

    def __init__(self, a_path: str, b_path: str, held: int = HELD):
        import sentencepiece

        names, encoding = _byte_level(a_path)
        self._a = encoding._core_bpe.encode_ordinary
        self._b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self._b.id_to_piece(k) for k in range(self._b.get_piece_size())]
        # what makes units independent: no piece goes over a blank that follows something else, nor over a line end
        self._alone = not any(BLANK in p.lstrip(BLANK) or "\n" in p for k, p in enumerate(pieces) if not self._b.is_byte(k))
        self._a_bytes = _table(names)
        self._b_bytes = _table([bytes([int(p[3:5], 16)]) if self._b.is_byte(k) else p.replace(BLANK, " ").encode() for k, p in enumerate(pieces)])
        self._blank_id = self._b.piece_to_id(BLANK)
        self._ends = self._a("\n"), [k for k in self._b.encode("\n", num_threads=1) if k != self._blank_id]
        self.b_size = len(pieces)
        self.kind = "<u4" if len(names) * self.b_size <= 1 << 32 else "<i8"
        self._held, self._known = held, {}
        self._decimal = _table([b"%d," % k for k in range(max(len(names), len(pieces)))])

    def _tokens_b(self, batch: list[str]) -> list[list[int]]:
        """B's ids of units; the blank that the model puts first is the unit's own, or is taken off where it has none."""
        found = self._b.encode([u[1:] if u[0] == " " else u for u in batch], num_threads=1)
        for k, u in enumerate(batch):
            if u == " ":  # the model gives nothing for nothing
                found[k] = [self._blank_id]
            elif u[0] != " ":
                if found[k][:1] != [self._blank_id]:
                    raise RuntimeError("a piece goes over the start of a line")
                del found[k][0]
        return found

    def align(self, batch: list[str]) -> dict[str, Aligned | None]:
        """Alignments of units; None where the bytes of A's or B's tokens aren't the unit's.

        Words with the blank before them go to each tokenizer in one text, a line end between each two;
        the others one by one.
        """
        plain = [u for u in batch if _PLAIN(u)] if self._alone else []
        out: dict[str, Aligned | None] = {}
        if plain:
            a, b = np.array(self._a("\n".join(plain)), np.int64), np.array(self._b.encode("\n".join(plain)[1:], num_threads=1), np.int64)
            (end_a,), (end_b,) = self._ends
            cut_a, cut_b = np.flatnonzero(a == end_a), np.flatnonzero(b == end_b)
            if len(cut_a) == len(cut_b) == len(plain) - 1:
                count = lambda x, cuts: np.diff(cuts, prepend=-1, append=len(x)) - 1
                out.update(self._owners(plain, a[a != end_a], count(a, cut_a), b[b != end_b], count(b, cut_b)))
        rest = [u for u in batch if u not in out]
        if rest:
            a, b = [self._a(u) for u in rest], self._tokens_b(rest)
            flat = lambda x: np.fromiter(chain.from_iterable(x), np.int64)
            out.update(self._owners(rest, flat(a), np.array([len(x) for x in a]), flat(b), np.array([len(x) for x in b])))
        return out

    def _owners(self, batch: list[str], ids_a: np.ndarray, n_a: np.ndarray, ids_b: np.ndarray, n_b: np.ndarray) -> dict[str, Aligned | None]:
        """Byte owners: each byte gets the place of the token that holds it, for A and B. A link begins
        wherever the pair of owners changes, a group ends wherever both do."""
        raw = [u.encode() for u in batch]
        size = np.array([len(x) for x in raw])
        size_a, size_b = np.diff(self._a_bytes[1])[ids_a], np.diff(self._b_bytes[1])[ids_b]
        whole = np.frombuffer(b"".join(raw), np.uint8)

        def same(ids, n, sizes, of) -> np.ndarray:
            """Which units' tokens have the unit's bytes."""
            ends = np.concatenate([[0], np.cumsum(sizes)])
            own = ends[np.cumsum(n)] - ends[np.cumsum(n) - n]
            right = own == size
            if right.all():
                differ = np.flatnonzero(gathered(*of, ids) != whole)
                right[np.searchsorted(np.cumsum(size), differ, "right")] = False
                return right
            part, at = gathered(*of, ids).tobytes(), np.concatenate([[0], np.cumsum(own)]).tolist()
            return np.array([part[i:j] == x for i, j, x in zip(at, at[1:], raw, strict=False)])

        good = same(ids_a, n_a, size_a, self._a_bytes) & same(ids_b, n_b, size_b, self._b_bytes)
        out: dict[str, Aligned | None] = dict.fromkeys(batch)
        if not good.all():
            keep_a, keep_b = np.repeat(good, n_a), np.repeat(good, n_b)
            ids_a, size_a, ids_b, size_b, n_a, n_b, size = ids_a[keep_a], size_a[keep_a], ids_b[keep_b], size_b[keep_b], n_a[good], n_b[good], size[good]
            batch = [u for u, g in zip(batch, good.tolist(), strict=True) if g]
        owner_a, owner_b = np.repeat(np.arange(len(ids_a)), size_a), np.repeat(np.arange(len(ids_b)), size_b)
        new_a, new_b = np.diff(owner_a, prepend=-1) != 0, np.diff(owner_b, prepend=-1) != 0
        starts, cuts, ends = np.flatnonzero(new_a | new_b), np.flatnonzero(new_a & new_b), np.cumsum(size)
        links = (ids_a[owner_a[starts]] * self.b_size + ids_b[owner_b[starts]]).astype(self.kind)
        link_at, cut_at = (np.concatenate([[0], np.searchsorted(x, ends)]) for x in (starts, cuts))
        text, text_at = self._groups(ids_a, ids_b, owner_a[cuts], owner_b[cuts], cut_at)
        raw_links, width = links.tobytes(), links.itemsize
        rows = zip(batch, n_a.tolist(), n_b.tolist(), np.diff(cut_at).tolist(), link_at[:-1].tolist(), link_at[1:].tolist(), text_at[:-1].tolist(), text_at[1:].tolist(), strict=True)
        for u, a, b, groups, i, j, p, q in rows:
            out[u] = Aligned(a, b, groups, j - i, text[p:q - 1], raw_links[width * i:width * j])
        return out

    def _groups(self, ids_a, ids_b, first_a, first_b, cut_at) -> tuple[bytes, np.ndarray]:
        """All groups as text, a semicolon after each, and where each unit's begin; ``first_a`` and ``first_b`` are the groups' first tokens."""
        n = len(first_a)
        in_a, in_b = np.diff(first_a, append=len(ids_a)), np.diff(first_b, append=len(ids_b))
        side = np.concatenate([np.repeat(2 * np.arange(n), in_a), np.repeat(2 * np.arange(n) + 1, in_b)])
        order = np.argsort(side, kind="stable")
        ids, side = np.concatenate([ids_a, ids_b])[order], side[order]
        text = gathered(*self._decimal, ids)
        last = np.cumsum(np.diff(self._decimal[1])[ids]) - 1  # the comma after each id
        final = np.flatnonzero(np.diff(side, append=-1) != 0)
        text[last[final]] = np.where(side[final] % 2, ord(";"), ord("|"))
        group_at = np.concatenate([[0], last[final][1::2] + 1])
        return text.tobytes(), group_at[cut_at]

    def learn(self, wanted: set[str]) -> None:
        if len(self._known) > self._held:
            self._known = {}
        new = sorted(wanted.difference(self._known))
        at = 0
        while at < len(new):
            to, chars = at, 0
            while to < len(new) and (to == at or chars + len(new[to]) <= BATCH_CHARS):
                chars += len(new[to])
                to += 1
            self._known.update(self.align(new[at:to]))
            at = to

    def texts(self, texts: list[str]):
        """For each text the alignments of the units of a space and it, in order; None where the whole has none. Units of short texts are learned together."""
        at = 0
        while at < len(texts):
            to, chars = at, 0
            while to < len(texts) and chars + len(texts[to]) <= STRETCH:
                chars += len(texts[to])
                to += 1
            if to == at or not self._alone:
                yield self._long(texts[at])
                at += 1
                continue
            cut = [units(" " + t) if t else [] for t in texts[at:to]]
            self.learn(set(chain.from_iterable(cut)))
            get = self._known.__getitem__
            for text, us in zip(texts[at:to], cut, strict=True):
                yield self._whole(text, list(map(get, us)))
            at = to

    def _long(self, text: str) -> list[Aligned] | None:
        out: list[Aligned | None] = []
        for part in stretches(" " + text) if self._alone else ():
            us = units(part)
            self.learn(set(us))
            out += map(self._known.__getitem__, us)
        return self._whole(text, out)

    def _whole(self, text: str, found: list[Aligned | None]) -> list[Aligned] | None:
        if not text or found and None not in found:
            return found
        own = self.align([" " + text])[" " + text]  # bytes that differ in one unit could still be equal on the whole
        return None if own is None else [own]


def _byte_level(path: str):
    """The bytes of each id of a byte-level BPE's JSON file, and its encoding; special tokens have no ids here, so that their strings are plain text."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, merges = spec["model"]["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    special = {t["content"] for t in spec["added_tokens"]}
    own = {c: b for b, c in enumerate(byte_letters())}
    ranks = {bytes(map(own.__getitem__, name)): k for name, k in vocab.items() if name not in special}
    joined = [vocab["".join(m)] for m in merges]
    if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or joined != sorted(joined):
        raise ValueError("only a byte-level BPE whose ids rise with its merges is supported")
    names = {k: name for name, k in ranks.items()}
    return [names.get(k, b"") for k in range(max(names) + 1)], tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _table(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw], dtype=np.int64)])


class _Block:
    """Documents with their own numbers, and their links as places in the list of the block's distinct pairs."""

    def __init__(self):
        self.rows: list[tuple] = []
        self._links: list[bytes] = []
        self.chars = 0

    def add(self, doc: int | None, text: str, found: list[Aligned] | None) -> None:
        self.chars += len(text)
        if not found:
            self.rows.append((doc, 0, 0, 0, 0, ""))
            return
        digest = hashlib.sha256()
        for k in range(0, len(found), 4096):
            digest.update((b";" if k else b"") + b";".join([x.groups for x in found[k:k + 4096]]))
        self.rows.append((doc, sum([x.n_a for x in found]), sum([x.n_b for x in found]), sum([x.n_groups for x in found]), sum([x.n_links for x in found]), digest.hexdigest()))
        self._links.append(b"".join([x.links for x in found]))

    def record(self, block: int, kind: str) -> pa.RecordBatch:
        links = pa.array(np.frombuffer(b"".join(self._links), kind)).dictionary_encode()
        pairs, places = links.dictionary.to_numpy(), links.indices.to_numpy()
        counts = np.bincount(places, minlength=len(pairs))
        places = places.astype("<u2" if len(pairs) <= 1 << 16 else "<u4").tobytes()
        docs = [dict(zip(_DOC.names, r, strict=True)) for r in self.rows]
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), pa.array([docs], pa.list_(pa.struct(_DOC))), pa.array([places], pa.binary()),
             pa.array([pairs.astype(np.int64)], pa.list_(pa.int64())), pa.array([counts.astype(np.int64)], pa.list_(pa.int64()))], ["block", "docs", "places", "pairs", "counts"])


_DOC = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())])
_DOC_DDL = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"


def aligned_blocks(docs: DataFrame, a_path: str, b_path: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(block, docs, places, pairs, counts)`` of ``docs(doc_id, text)``: per block its documents' own numbers, their links as
    places in ``pairs``, the block's distinct pairs, and how many links each has."""

    def run(batches):
        aligner, first, k = Aligner(a_path, b_path), TaskContext.get().partitionId() << 32, 0
        block = _Block()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for doc, text, found in zip(batch.column("doc_id").to_pylist(), texts, aligner.texts(texts), strict=True):
                if block.rows and block.chars + len(text) > block_chars:
                    yield block.record(first + k, aligner.kind)
                    block, k = _Block(), k + 1
                block.add(doc, text, found)
        if block.rows:
            yield block.record(first + k, aligner.kind)

    return docs.mapInArrow(run, f"block bigint, docs array<struct<{_DOC_DDL.replace(' ', ':').replace(',:', ', ')}>>, places binary, pairs array<bigint>, counts array<bigint>")


def align_tokens(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                 block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    1. Texts become blocks, written once: each distinct unit's tokens are aligned by byte owners.
    2. A pair of ids counts its links over the corpus: a block gives one row for each of its
       distinct pairs, so a pair that is everywhere has a row for each block, not for each link.
    3. The counts, with a mark at those that are their B id's highest, go back to the blocks,
       where each document looks its links up.

    A null or empty text, or one whose tokens' bytes aren't the space and the text, has zeros and
    an empty digest. Null ids and repeated rows are rows of their own, and each counts; equal
    texts get equal values; of pairs with equal counts all are highest. A long text is a block of
    its own, handled by stretches. An empty table gives no rows; other columns are not read.
    """
    import public_tokenizers
    import sentencepiece

    a_path = a_path or public_tokenizers.path("byte_bpe_50k.json")
    b_path = b_path or public_tokenizers.path("piece_bpe_32k.model")
    b_size = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    blocks = materialise(aligned_blocks(id_and_text(docs, id_col, text_col), a_path, b_path, block_chars), "aligned")
    held = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "x")).select("block", "place", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    counts = held.groupBy("pair").agg(F.sum("n").alias("n"))
    top = F.max("n").over(W.partitionBy(F.expr(f"pair % {b_size}")))  # at most as many rows as A has ids
    rated = counts.select("pair", "n", (F.col("n") == top).alias("best"))
    back = (held.drop("n").join(rated, "pair").groupBy("block")
            .agg(F.collect_list(F.struct("place", "n", "best")).alias("rated")))

    def look_up(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                rows = batch.column("docs")[row].as_py()
                own = batch.column("rated")[row].values
                n, best = np.zeros(0, np.int64), np.zeros(0, bool)
                if own is not None and len(own):
                    order = np.argsort(own.field("place").to_numpy())
                    n, best = own.field("n").to_numpy()[order], own.field("best").to_numpy(zero_copy_only=False)[order]
                places = np.frombuffer(batch.column("places")[row].as_py(), "<u2" if len(n) <= 1 << 16 else "<u4")
                ends = np.cumsum([0, *(r["n_links"] for r in rows)]).tolist()
                sums = [(int(best[places[a:b]].sum()), int(n[places[a:b]].sum())) for a, b in zip(ends, ends[1:], strict=False)]
                columns = {c: [r[c] for r in rows] for c in _DOC.names}
                columns |= {"n_best": [x for x, _ in sums], "count_sum": [x for _, x in sums]}
                yield pa.RecordBatch.from_pydict(columns, schema=_OUT)

    return blocks.select("block", "docs", "places").join(back, "block", "left").select("docs", "places", "rated").mapInArrow(look_up, f"{_DOC_DDL}, n_best bigint, count_sum bigint")


_OUT = pa.schema([*_DOC, ("n_best", pa.int64()), ("count_sum", pa.int64())])


def op12_token_alignment(spark, sf_dir):
    """Every document's tokens by two tokenizers, aligned."""
    return align_tokens(table(spark, sf_dir, "documents"))
