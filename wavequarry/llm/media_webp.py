"""Lossless WebP media columns: payloads to stored images, images to pixel arrays and features."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavequarry.llm.common import id_and_text, table
from wavequarry.llm.webp_codec import MAX_SIDE, WebPError, decode, encode

ROW = 64
#: Bytes of a payload that one image holds at most; bounds a task's memory.
IMAGE_BYTES = 1 << 24
_OPAQUE = np.uint32(0xFF000000)


def payload_of(text: str | None) -> bytes:
    """UTF-8, with zero bytes up to a positive multiple of 64."""
    raw = (text or "").encode()
    return raw + b"\0" * (payload_size(len(raw)) - len(raw))


def store(payload: bytes, image_bytes: int = IMAGE_BYTES) -> bytes:
    """The payload as the green samples of images whose rows are a multiple of 64 wide.

    An image holds at most ``image_bytes``; the images of a longer payload follow one another. Where
    no width divides an image's part, zero samples fill the last row: ``read_back`` takes the payload's length.
    """
    return b"".join(_image(payload[k:k + image_bytes]) for k in range(0, len(payload), image_bytes))


def _image(payload: bytes) -> bytes:
    samples = np.frombuffer(payload, np.uint8)
    rows = len(samples) // ROW
    least = -(-rows // MAX_SIDE)
    # a width that divides the payload, so that no sample is made up, if there is one
    per = next((w for w in range(least, MAX_SIDE // ROW + 1) if rows % w == 0), least)
    if rows % per:
        samples = np.pad(samples, (0, -rows % per * ROW))
    samples = samples.reshape(-1, per * ROW)
    return encode(_OPAQUE | samples.astype(np.uint32) << np.uint32(8), transforms_for(samples))


def _entropy(counts: np.ndarray) -> float:
    share = counts[counts > 0] / counts.sum()
    return float(-(share * np.log2(share)).sum())


def transforms_for(samples: np.ndarray) -> tuple:
    """The transforms that make the samples shorter: a palette for sixteen values or fewer, the left neighbour as prediction where its residual has clearly less entropy."""
    if samples.size < 256:
        return ()
    counts = np.bincount(samples.ravel(), minlength=256)
    steps = np.bincount(np.diff(samples, axis=1).ravel(), minlength=256)
    if _entropy(steps) < _entropy(counts) - 0.25:
        modes = np.ones((-(-samples.shape[0] // 512), -(-samples.shape[1] // 512)), np.uint32)
        return (("predictor", modes, 9),)
    return (("palette",),) if np.count_nonzero(counts) <= 16 else ()


def stored_images(media: bytes) -> list[bytes]:
    """The files that follow one another in ``media``."""
    out, at = [], 0
    while at < len(media):
        size = int.from_bytes(media[at + 4:at + 8], "little") + 8
        out.append(media[at:at + size])
        at += size
    return out


def read_back(media: bytes, size: int) -> tuple[bytes, str]:
    """The payload of ``size`` bytes that ``media`` stores, and the features of its images, joined by ``|``."""
    parts, features = [], []
    for image in stored_images(media):
        pixels = decode(image)
        own = min(pixels.size, size - sum(map(len, parts)))
        parts.append(samples_of(pixels, own))
        features.append(features_of(pixels, own))
    return b"".join(parts), "|".join(features)


def payload_size(n_bytes: int) -> int:
    """The length of the payload of a text of ``n_bytes``."""
    return max(ROW, -(-n_bytes // ROW) * ROW)


def samples_of(pixels: np.ndarray, size: int) -> bytes:
    """The payload of ``size`` bytes that an image stores."""
    return (pixels >> 8 & 255).astype(np.uint8).tobytes()[:size]


def features_of(pixels: np.ndarray, size: int | None = None) -> str:
    """Size, mean, deviation, entropy in bits, share of zero samples and a mean hash (8 columns, up to 8 rows) of the green plane, of its first ``size`` samples if given."""
    g = np.ascontiguousarray(pixels).view(np.uint8)[:, 1::4]
    n, levels = g.size if size is None else size, np.arange(256)
    count = np.bincount(g.ravel()[:n], minlength=256)
    total, squares = int(count @ levels), int(count @ levels**2)
    mean = total / n
    some = count[count > 0] / n
    bands = min(8, len(g))
    top, left = np.arange(bands) * len(g) // bands, np.arange(8) * g.shape[1] // 8
    sums = np.add.reduceat(np.add.reduceat(g, top, axis=0, dtype=np.int64), left, axis=1)
    area = np.outer(np.diff([*top, len(g)]), np.diff([*left, g.shape[1]]))
    if n < g.size:
        real = (np.arange(g.size) < n).reshape(g.shape)
        area = np.add.reduceat(np.add.reduceat(real, top, axis=0, dtype=np.int64), left, axis=1)
    code = np.packbits((sums * n > total * area).ravel(), bitorder="big").tobytes().hex()
    return (f"{g.shape[1]}x{len(g)};mean={mean:.6f};std={max(0.0, squares / n - mean * mean) ** 0.5:.6f};"
            f"entropy={-(some * np.log2(some)).sum() + 0.0:.6f};zero={count[0] / n:.6f};hash={code}")


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, media)``: every text stored as an image, or several that follow one another. Null and empty texts are 64 zero bytes.

    ``read_back`` takes ``payload_size(n_bytes)``. Equal texts have equal images; null ids and
    repeated rows are rows of their own. An empty table gives none.
    """

    @F.pandas_udf("binary")
    def media(text: pd.Series) -> pd.Series:
        return pd.Series([store(payload_of(t)) for t in text], dtype=object)

    return id_and_text(docs, id_col, text_col).select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), media("text").alias("media"))


def decode_images(media: DataFrame, media_col: str = "media") -> DataFrame:
    """All columns but ``image``, and ``image``: width, height, pixels (RGBA bytes, row by row), or the error that bytes which aren't an image give.

    A null image has a null struct; empty bytes are an error. Of several images that follow one
    another the first is read. Repeated rows come back as often; an empty table gives none.
    """

    @F.pandas_udf("width int, height int, pixels binary, error string")
    def read(col: pd.Series) -> pd.DataFrame:
        rows = []
        for b in col:
            try:
                p = decode(bytes(b)) if b is not None else None
                rows.append((None,) * 4 if p is None else (p.shape[1], p.shape[0], p.view(np.uint8).reshape(-1, 4)[:, [2, 1, 0, 3]].tobytes(), None))
            except WebPError as e:
                rows.append((None, None, None, str(e)))
        return pd.DataFrame(rows, columns=["width", "height", "pixels", "error"]).astype({"width": "Int32", "height": "Int32"})

    image = F.when(F.col(f"`{media_col}`").isNotNull(), read(F.col(f"`{media_col}`")))
    return media.select(*(F.col(f"`{c}`") for c in media.columns if c.lower() != "image"), image.alias("image"))


_DIGEST = ("payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, and digests of what is read back from the stored image.

    Equal texts have equal values. Null ids and repeated rows are rows of their own. An
    empty table gives none.
    """

    @F.pandas_udf(_DIGEST)
    def digest(text: pd.Series) -> pd.DataFrame:
        rows = []
        for t in text:
            payload = payload_of(t)
            stored = store(payload)
            back, feature = read_back(stored, len(payload))
            rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-ROW:]), len(stored), hashlib.sha256(stored).hexdigest(), feature))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in _DIGEST.split(", ")])

    plain = id_and_text(docs, id_col, text_col)
    return plain.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), digest("text").alias("d")).select("doc_id", "n_bytes", "d.*")


def op1_webp(spark, sf_dir):
    """Every document stored as a lossless image and read back."""
    return media_digests(table(spark, sf_dir, "documents"))
