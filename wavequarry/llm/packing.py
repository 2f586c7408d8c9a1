"""Bound-certified best-fit-decreasing packing of token pieces into sequences."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavequarry.llm.bpe_units import UnitEncoder, added_tokens, load_encoding
from wavequarry.llm.common import id_and_text, materialise, parts_for, table

CAPACITY = 1024
END_ID = 2
PER_PART = 16_384
ROUNDS = 5

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, rid bigint"


def token_pieces(docs: DataFrame, rank_path: str, pattern: str, capacity: int = CAPACITY, end_id: int = END_ID,
                 added: dict[str, int] | None = None) -> DataFrame:
    """Each document's ids and the end id, cut into pieces of at most ``capacity``.

    Only longer documents are cut: the remainder comes first, then whole pieces.
    ``rid`` numbers the rows of this one evaluation: write the result before using it twice.
    """

    def cut(batches):
        encoder = UnitEncoder(load_encoding(rank_path, pattern), added=added)
        end = np.array([end_id], dtype="<u4").tobytes()
        base, k = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            ids, cols = batch.column("doc_id").to_pylist(), ([], [], [], [], [], [])
            for doc, raw in zip(ids, encoder.encode(batch.column("text").to_pylist()), strict=True):
                raw += end
                n, view = len(raw) // 4, memoryview(raw)
                at, stop, piece = 0, n if n <= capacity else n % capacity or capacity, 0
                while at < n:
                    row = (doc, piece, at, stop - at, zlib.crc32(view[at * 4:stop * 4]), base + k)
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                    at, stop, piece, k = stop, stop + capacity, piece + 1, k + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "rid"])

    return docs.mapInArrow(cut, _PIECES)


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[list[int], int]:
    """Bin of each item; items by falling size, each to the fullest bin it fits.

    Bins stand in one stack per room left; a bit mask over the rooms finds the
    least room that is large enough.
    """
    order = np.argsort(-sizes, kind="stable").tolist()
    size_of = sizes.tolist()
    where = [0] * len(size_of)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins = 0, 0
    for i in order:
        s = size_of[i]
        fit = mask >> s
        if fit:
            room = s + (fit & -fit).bit_length() - 1
            stack = stacks[room]
            b = stack.pop()
            if not stack:
                mask &= ~(1 << room)
        else:
            room, b = capacity, bins
            bins += 1
        left = room - s
        if left:
            stacks[left].append(b)
            mask |= 1 << left
        where[i] = b
    return where, bins


def bin_bound(sizes: np.ndarray, capacity: int, steps: int = 32) -> int:
    """A lower bound on the bins, by dual feasible functions.

    The largest over: the volume; the threshold functions (sizes below e count
    nothing, above capacity - e a whole bin) for each e; the rounding functions
    x -> floor((k + 1) x) / k, exact at multiples of 1 / (k + 1), for k to ``steps``.
    """
    if not len(sizes):
        return 0
    hist = np.bincount(sizes, minlength=capacity + 1)[: capacity + 1].astype(np.int64)
    values = np.arange(capacity + 1, dtype=np.int64)
    volume = hist * values
    best = -(-int(volume.sum()) // capacity)
    some, mass = np.cumsum(hist), np.cumsum(volume)
    e = np.arange(1, capacity // 2 + 1)
    whole = some[-1] - some[capacity - e]
    middle = mass[capacity - e] - mass[e - 1]
    best = max(best, int((whole + -(-middle // capacity)).max()))
    for k in range(1, steps + 1):
        scaled = (k + 1) * values
        # in units of 1 / (k * capacity)
        f = np.where(scaled % capacity == 0, values * k, scaled // capacity * capacity)
        best = max(best, -(-int((hist * f).sum()) // (k * capacity)))
    return best


_PACKED = ("doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, rid bigint, part bigint, "
           "seq bigint, offset bigint, fill bigint, gap int, last boolean")


def _pack_group(capacity: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rid", kind="stable").reset_index(drop=True)
        sizes = pdf["length"].to_numpy(np.int64)
        where, bins = best_fit_decreasing(sizes, capacity)
        bound = bin_bound(sizes, capacity)
        old = pdf["seq"]
        if old.notna().all() and old.nunique() <= bins:  # an exchange that gains nothing keeps what stood
            bins = int(old.nunique())
            where = pd.factorize(old)[0]
        where = np.asarray(where)
        order = np.argsort(where, kind="stable")
        fills = np.bincount(where, weights=sizes, minlength=bins).astype(np.int64)
        ends = np.cumsum(sizes[order])
        begin = np.concatenate([[0], np.cumsum(fills)[:-1]])
        offset = np.empty(len(sizes), np.int64)
        offset[order] = ends - sizes[order] - begin[where[order]]
        first = np.full(bins, np.iinfo(np.int64).max)
        np.minimum.at(first, where, pdf["rid"].to_numpy(np.int64))
        pdf["seq"], pdf["offset"], pdf["fill"] = first[where] * 2 + 1, offset, fills[where]
        pdf["gap"] = max(0, bins - bound)
        pdf["last"] = where == int(np.argmin(fills))
        return pdf[["doc_id", "piece", "start", "length", "ids_crc32", "rid", "part", "seq", "offset", "fill", "gap", "last"]]

    return pack


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_part: int = PER_PART, rounds: int = ROUNDS) -> DataFrame:
    """Sequence and offset of each piece, in as few sequences as best-fit decreasing and exchange reach.

    Pieces are dealt evenly by row number to partitions of about ``per_part``. Each
    is packed by best-fit decreasing and its bins held against its lower bound. A
    partition that meets the bound is certified and keeps its bins, save its emptiest;
    one with a gap keeps its full bins. What is left is exchanged: dealt anew to
    fewer partitions and packed again. An exchange that gains nothing keeps what stood.
    The last round keeps all.

    ``pieces`` needs ``rid`` unique and fixed. Pieces of full length are sequences of their own.
    """
    spark = pieces.sparkSession
    whole = pieces.where(F.col("length") >= capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("rid") * 2).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    pool = pieces.where(F.col("length") < capacity).withColumn("seq", F.lit(None).cast("bigint"))
    done, parts = [whole], None
    for k in range(rounds):
        n = pool.count()
        if not n:
            break
        now = parts_for(n, per_part)
        final = k == rounds - 1 or now == 1 or parts is not None and now >= parts
        parts = now
        # bins move whole: the old sequence number, or at first the row number, is dealt
        dealt = pool.withColumn("part", F.pmod(F.xxhash64(F.coalesce("seq", "rid"), F.lit(k)), F.lit(parts)))
        packed = materialise(dealt.select("doc_id", "piece", "start", "length", "ids_crc32", "rid", "part", "seq")
                             .repartition(parts, "part").groupBy("part").applyInPandas(_pack_group(capacity), _PACKED), f"pack{k}")
        keep = F.lit(True) if final else (F.col("fill") == capacity) | ((F.col("gap") == 0) & ~F.col("last"))
        done.append(packed.where(keep).select("doc_id", "piece", "start", "length", "ids_crc32",
                                              F.col("seq").alias("sequence_id"), "offset"))
        if final:
            break
        pool = packed.where(~keep).select("doc_id", "piece", "start", "length", "ids_crc32", "rid", "seq")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def pack_documents(docs: DataFrame, rank_path: str | None = None, pattern: str | None = None, tokenizer_path: str | None = None,
                   id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    The ids are those of the ``tokenizers`` file at ``tokenizer_path``, special tokens that a
    text spells included; ``rank_path`` has the same vocabulary in a form that loads faster.

    A null or empty text is the end id alone. Repeated rows and null ids are packed as
    rows of their own. An empty table gives no rows. Other columns are ignored.
    """
    import public_tokenizers

    rank_path = rank_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    added = added_tokens(tokenizer_path or public_tokenizers.path("byte_bpe_50k.json"))
    pieces = token_pieces(id_and_text(docs, id_col, text_col), rank_path, pattern or public_tokenizers.PATTERN, capacity, added=added)
    return pack(materialise(pieces, "pieces"), capacity)


def op2_packing(spark, sf_dir):
    """All documents packed into sequences of at most 1024 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))
