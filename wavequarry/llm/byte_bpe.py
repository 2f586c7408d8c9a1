"""Byte-level BPE through a global shuffle of distinct pre-tokens, and decoding by the token-byte table."""

from __future__ import annotations

import hashlib
import zlib
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavequarry.llm.bpe_units import load_encoding, load_ranks, segments, units
from wavequarry.llm.common import id_and_text, table

#: Characters of text in one block, about; a longer text is a block of its own.
BLOCK_CHARS = 4 << 20
#: Blocks for each class of pre-tokens.
BLOCKS_PER_CLASS = 8
#: Pre-tokens of a text that are put in place at once.
CHUNK = 1 << 20


class _Block:
    """Texts as positions in the list of the block's distinct pre-tokens.

    A text is read as its units (see ``bpe_units``), each distinct unit is split once.
    """

    def __init__(self, findall):
        self._findall, self._of, self._words = findall, {}, {}
        self.docs: list[int | None] = []
        self._texts: list[np.ndarray] = []
        self.chars = 0

    def _numbers(self, unit: str) -> list[int]:
        words = self._words
        return [words.setdefault(w, len(words)) for w in self._findall(unit)]

    def add(self, doc: int | None, text: str) -> None:
        of, parts = self._of, []
        for s in segments(text):
            u = units(s)
            if u is None:
                parts.append(np.array(self._numbers(s), np.uint32))
                continue
            for x in set(u).difference(of):
                of[x] = self._numbers(x)
            parts.append(np.fromiter(chain.from_iterable(map(of.__getitem__, u)), np.uint32))
        self.docs.append(doc)
        self._texts.append(np.concatenate(parts))
        self.chars += len(text)

    def packed(self, classes: int) -> bytes:
        """The texts, and the distinct pre-tokens by class: sorted within one, and numbered from class to class."""
        of_class: dict[int, list[bytes]] = {}
        raw = [w.encode() for w in self._words]
        for w in raw:
            of_class.setdefault(zlib.crc32(w) % classes, []).append(w)
        number = {w: k for k, w in enumerate(chain.from_iterable(sorted(of_class[c]) for c in sorted(of_class)))}
        flat = np.concatenate(self._texts)
        often = np.argsort(-np.bincount(flat, minlength=len(raw)), kind="stable")  # frequent pre-tokens get small numbers, whose high bytes take no room
        rank = np.empty(len(raw), np.uint32)
        rank[often] = np.arange(len(raw), dtype=np.uint32)
        planes = rank[flat].astype("<u4").view(np.uint8).reshape(-1, 4).T
        place = np.array([number[raw[k]] for k in often.tolist()], "<u4")
        none = np.array([d is None for d in self.docs], bool)
        held = [np.array([d or 0 for d in self.docs], "<i8"), none, np.array([len(t) for t in self._texts], "<i8"), place, *planes]
        own = sorted(of_class)
        return _framed([_framed([zstandard.compress(np.ascontiguousarray(a).tobytes(), 3) for a in held]), np.array(own, "<i4").tobytes(),
                        *(_pack_strings(sorted(of_class[c])) for c in own)])


def read_texts(blob: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, each text's number of pre-tokens, the place of each frequency rank in the list of pre-tokens, and the ranks of all texts in order."""
    docs, none, sizes, place, *planes = map(zstandard.decompress, _frames(next(_frames(blob))))
    ranks = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).view("<u4").ravel() if planes[0] else np.empty(0, "<u4")
    ids = [None if x else d for d, x in zip(np.frombuffer(docs, "<i8").tolist(), none, strict=True)]
    return ids, np.frombuffer(sizes, "<i8"), np.frombuffer(place, "<u4").astype(np.int64), ranks


def read_words(blob: bytes) -> list[tuple[int, bytes]]:
    """A block's ``(class, packed pre-tokens)``."""
    _, own, *packed = _frames(blob)
    return list(zip(np.frombuffer(own, "<i4").tolist(), packed, strict=True))


def _framed(parts: list[bytes]) -> bytes:
    return b"".join(len(x).to_bytes(8, "little") + x for x in parts)


def _frames(blob: bytes):
    at = 0
    while at < len(blob):
        size = int.from_bytes(blob[at:at + 8], "little")
        yield blob[at + 8:at + 8 + size]
        at += 8 + size


def _pack_strings(parts: list[bytes]) -> bytes:
    """Lengths, one byte each where all fit, then the strings; compressed."""
    wide = max(map(len, parts), default=0) > 255
    lens = np.array([len(p) for p in parts], "<u4" if wide else "u1").tobytes()
    return zstandard.compress(bytes([wide]) + len(parts).to_bytes(4, "little") + lens + b"".join(parts), 3)


def _unpack_strings(blob: bytes) -> tuple[bytes, np.ndarray]:
    """The strings in one, and where each begins and the last ends."""
    raw = zstandard.decompress(blob)
    kind, n = np.dtype("<u4" if raw[0] else "u1"), int.from_bytes(raw[1:5], "little")
    at = 5 + kind.itemsize * n
    return raw[at:], np.concatenate([[0], np.cumsum(np.frombuffer(raw, kind, n, 5), dtype=np.int64)])


def gathered(flat: np.ndarray, ends: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The stretches ``flat[ends[k]:ends[k + 1]]`` for each k of ``which``, one after the other."""
    start = ends[which]
    size = ends[which + 1] - start
    stop = np.cumsum(size)
    return flat[np.repeat(start - stop + size, size) + np.arange(stop[-1] if len(stop) else 0)]


def text_blocks(docs: DataFrame, pattern: str, classes: int, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(block, held)``: blocks of ``docs(doc_id, text)``, with texts as positions and the distinct pre-tokens by class.

    Rows are sorted within their partition first, so that one that is evaluated again after a loss gives the same blocks.
    """

    def gather(batches):
        import regex

        findall, first, k = regex.compile(pattern).findall, TaskContext.get().partitionId() << 32, 0
        block = _Block(findall)

        def row():
            return pa.RecordBatch.from_arrays([pa.array([first + k]), pa.array([block.packed(classes)], pa.binary())], ["block", "held"])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if block.docs and block.chars + len(text) > block_chars:
                    yield row()
                    block, k = _Block(findall), k + 1
                block.add(doc, text)
        if block.docs:
            yield row()

    return docs.sortWithinPartitions("doc_id", "text").mapInArrow(gather, "block bigint, held binary").repartition("block")


def encode_texts(docs: DataFrame, rank_path: str, pattern: str, per_text, schema: str, classes: int, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``per_text(doc_id, pieces of its ids)``, a row of ``schema``, for every row of ``docs(doc_id, text)``.

    1. A block explodes its texts into pre-tokens with positions; what it keeps of a text is, at
       each position, which of the block's distinct pre-tokens stands there. Blocks are shuffled once.
    2. Distinct pre-tokens, packed by hash class, go through one shuffle: a class gathers its
       blocks' pre-tokens and encodes each distinct one once. The ids are joined back by block and class.
    3. Each block, from the same shuffle, puts its pre-tokens' ids at their positions.

    A class holds a share of the distinct pre-tokens, never occurrences, so a frequent one costs one
    entry per block. However many classes, there are no more packets than pairs of block and distinct pre-token.
    """
    blocks = text_blocks(docs, pattern, classes, block_chars)

    def split(batches):
        for batch in batches:
            for block, held in zip(batch.column("block").to_pylist(), batch.column("held").to_pylist(), strict=True):
                own = read_words(held)
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(own), pa.int64()), pa.array([c for c, _ in own], pa.int32()), pa.array([w for _, w in own], pa.binary())],
                                                 ["block", "class", "words"])

    def look_up(pdf: pd.DataFrame) -> pd.DataFrame:
        encoding = load_cached(rank_path, pattern)
        encode, kind = encoding._core_bpe.encode_single_piece, _id_kind(encoding)
        known: dict[bytes, bytes] = {}
        out = []
        for blob in pdf["words"]:
            raw, ends = _unpack_strings(blob)
            words = [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            for w in words:
                if w not in known:
                    known[w] = np.array(encode(w), kind).tobytes()
            out.append(_pack_strings([known[w] for w in words]))
        return pd.DataFrame({"block": pdf["block"], "class": pdf["class"], "ids": out})

    packets = blocks.mapInArrow(split, "block bigint, class int, words binary")
    found = (packets.groupBy("class").applyInPandas(look_up, "block bigint, class int, ids binary")
             .groupBy("block").agg(F.collect_list(F.struct("class", "ids")).alias("found")))
    names = [x.split()[0] for x in schema.split(", ")]

    def place(batches):
        kind = np.dtype(_id_kind(load_cached(rank_path, pattern)))
        for batch in batches:
            for texts, own in zip(batch.column("held").to_pylist(), batch.column("found").to_pylist(), strict=True):
                parts = [_unpack_strings(x["ids"]) for x in sorted(own or [], key=lambda x: x["class"])]
                ids = np.frombuffer(b"".join(p for p, _ in parts), kind)
                sizes = np.concatenate([np.diff(e) for _, e in parts]) // kind.itemsize if parts else np.empty(0, np.int64)
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
                docs, lengths, place_of, ranks = read_texts(texts)
                if len(place_of) != len(sizes):
                    raise RuntimeError("a block's pre-tokens changed between two evaluations")
                stops = np.cumsum(lengths).tolist()
                rows = [per_text(doc, (gathered(ids, ends, place_of[ranks[k:min(k + CHUNK, b)]]).astype("<u4") for k in range(b - n, b, CHUNK)))
                        for doc, n, b in zip(docs, lengths.tolist(), stops, strict=True)]
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=_arrow_schema(schema))

    return blocks.join(found, "block", "left").select("held", "found").mapInArrow(place, schema)


def _arrow_schema(schema: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])


_cached: dict[tuple[str, str], object] = {}


def load_cached(rank_path: str, pattern: str):
    key = (rank_path, pattern)
    if key not in _cached:
        _cached[key] = load_encoding(rank_path, pattern)
    return _cached[key]


def _id_kind(encoding) -> str:
    """Two bytes for an id where the vocabulary allows it."""
    return "<u2" if encoding.n_vocab <= 1 << 16 else "<u4"


_byte_tables: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def token_bytes(rank_path: str) -> tuple[np.ndarray, np.ndarray]:
    """The token-byte table: all tokens' bytes in one, and where each id's begin. It has as many entries as the vocabulary."""
    if rank_path not in _byte_tables:
        own = {v: k for k, v in load_ranks(rank_path).items()}
        raw = [own.get(k, b"") for k in range(max(own, default=-1) + 1)]
        _byte_tables[rank_path] = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw], dtype=np.int64)])
    return _byte_tables[rank_path]


def decode_ids(ids: np.ndarray, rank_path: str) -> bytes:
    """Ids to text bytes, joined with the token-byte table."""
    return gathered(*token_bytes(rank_path), ids.astype(np.int64)).tobytes()


def encode_and_decode(docs: DataFrame, rank_path: str | None = None, pattern: str | None = None, id_col: str = "doc_id",
                      text_col: str = "text", block_chars: int = BLOCK_CHARS, keep_ids: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ``ids``, with keep_ids).

    A null or empty text has no tokens. Repeated rows and null ids come back as
    rows of their own; equal texts get equal values. An empty table gives none.
    """
    import public_tokenizers

    rank_path = rank_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    pattern = pattern or public_tokenizers.PATTERN
    plain = id_and_text(docs, id_col, text_col)
    size = plain.agg(F.coalesce(F.sum(F.char_length("text").cast("bigint")), F.lit(0))).first()[0]

    def digests(doc, pieces) -> tuple:
        n, own, back, raw = 0, hashlib.sha256(), hashlib.sha256(), []
        for ids in pieces:
            n += len(ids)
            own.update(ids)
            back.update(decode_ids(ids, rank_path))
            if keep_ids:
                raw += ids.tolist()
        return doc, n, own.hexdigest(), back.hexdigest(), *([raw] if keep_ids else [])

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return encode_texts(plain, rank_path, pattern, digests, schema, max(16, size // (block_chars * BLOCKS_PER_CLASS)), block_chars)


def op5_byte_bpe(spark, sf_dir):
    """Every document encoded by the ranks and decoded again."""
    return encode_and_decode(table(spark, sf_dir, "documents"))
