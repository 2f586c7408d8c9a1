"""Quality rules: counts of a text, and a calibrated logistic regression on hashed n-grams."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavequarry.llm.common import table

WORD_BITS = 16
CHAR_BITS = 17
CHAR_NS = (3, 4)
_ODD = 2654435761
DIM = (1 << WORD_BITS) + (1 << CHAR_BITS)
#: Labelled rows of each class that the fit may take: the documented bound.
SAMPLE = 1000
#: A text is kept from this probability of good quality on.
THRESHOLD = 0.5
#: Characters of a text handled at once.
CHUNK = 1 << 20

_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_U64 = np.uint64


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text (null: empty)."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    chars = len(text or "") - (len(raw) - len(raw.translate(None, _SPACE)))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    dup = 0
    if b"\n" in raw:
        lines = [line for line in raw.split(b"\n") if line.strip(_SPACE)]
        dup = len(lines) - len(set(lines))
    return n, chars, symbols, dup, repeated_words(words)


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    # ranks of longer and longer windows: each step pairs two ranks exactly
    rank = ids
    for k in range(1, width):
        key = rank[: len(words) - k] * len(number) + ids[k:]
        rank = np.unique(key, return_inverse=True)[1] if k < width - 1 else key
    _, inverse, count = np.unique(rank, return_inverse=True, return_counts=True)
    hit = np.flatnonzero(count[inverse] > 1)
    if not len(hit):
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


def _slots(text: str):
    """Hash slots of all words and word pairs (kind 0) and of all character n-grams of three and four code points (kind 1), in bounded pieces."""
    words = text.encode().split()
    for at in range(0, len(words), 1 << 18):
        part = words[at:at + (1 << 18) + 1]
        h = np.fromiter(map(zlib.crc32, part), np.uint32, len(part))
        pairs = h[:-1] * np.uint32(_ODD) ^ h[1:]
        for x in (h[:1 << 18], pairs):
            yield 0, (x * np.uint32(_ODD) >> np.uint32(32 - WORD_BITS)).astype(np.int32)
    top = max(CHAR_NS)
    for at in range(0, len(text), CHUNK):
        c = np.frombuffer(text[at:at + CHUNK + top - 1].encode("utf-32-le"), "<u4")
        h = c[:min(len(c), CHUNK)] * np.uint32(_ODD)
        for n in range(2, top + 1):
            m = min(len(c) - n + 1, CHUNK)
            if m <= 0:
                break
            h = (h[:m] ^ c[n - 1:n - 1 + m]) * np.uint32(_ODD)
            if n in CHAR_NS:
                yield 1, ((h ^ h >> np.uint32(15)) * np.uint32(_ODD) >> np.uint32(32 - CHAR_BITS)).astype(np.int32) + (1 << WORD_BITS)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted slots and their values: each kind's counts divided by that kind's total."""
    slots, values = [], []
    kinds: dict[int, list[np.ndarray]] = {}
    for kind, s in _slots(text):
        kinds.setdefault(kind, []).append(s)
    for kind in sorted(kinds):
        u, c = np.unique(np.concatenate(kinds[kind]), return_counts=True)
        slots.append(u)
        values.append((c / c.sum()).astype(np.float32))
    if not slots:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    return np.concatenate(slots), np.concatenate(values)


@dataclass(frozen=True)
class QualityModel:
    """Weights, bias and the calibration ``p = sigmoid(slope * margin + shift)``; no weights: every text scores 1."""

    weights: np.ndarray | None = None
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, text: str) -> float:
        total, n = [0.0, 0.0], [0, 0]
        for kind, s in _slots(text):
            total[kind] += float(self.weights[s].sum(dtype=np.float64))
            n[kind] += len(s)
        return self.bias + sum(t / k for t, k in zip(total, n, strict=True) if k)

    def probability(self, text: str | None) -> float:
        if self.weights is None:
            return 1.0
        z = self.slope * self.margin(text or "") + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def fit(rows: list[tuple[int, int, np.ndarray, np.ndarray]], epochs: int = 12, rate: float = 0.5, decay: float = 1e-4) -> QualityModel:
    """``(fold, label, slots, values)`` to a model: AdaGrad on folds 1 to 4, Platt scaling on fold 0.

    With fewer than two labels in the training or the calibration rows there is nothing to
    learn, and the model scores every text 1.
    """
    train = [r for r in rows if r[0]]
    held = [r for r in rows if not r[0]]
    if len({r[1] for r in train}) < 2 or len({r[1] for r in held}) < 2:
        return QualityModel()
    w, b = np.zeros(DIM, np.float32), 0.0
    grad, bias_grad = np.full(DIM, 1e-8, np.float32), 1e-8
    share = np.bincount([r[1] for r in train], minlength=2) / len(train)
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for k in rng.permutation(len(train)):
            _, y, s, v = train[k]
            p = 1 / (1 + np.exp(-np.clip(float(w[s] @ v) + b, -30, 30)))
            g = (p - y) * 0.5 / share[y]
            gs = g * v + decay * w[s]
            grad[s] += gs * gs
            w[s] -= rate * gs / np.sqrt(grad[s])
            bias_grad += g * g
            b -= 0.1 * g / bias_grad**0.5
    m = np.array([float(w[s] @ v) + b for _, _, s, v in held])
    y = np.array([r[1] for r in held], float)
    slope, shift = platt(m, y)
    return QualityModel(w, b, slope, shift)


def platt(margin: np.ndarray, label: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and shift of the logistic curve, by Newton's method on smoothed targets."""
    up = label.sum()
    target = np.where(label > 0, (up + 1) / (up + 2), 1 / (len(label) - up + 2))
    x = np.stack([margin, np.ones_like(margin)], 1)
    at = np.array([1.0, 0.0])

    def loss(c):
        z = x @ c
        return float((np.logaddexp(0, z) - target * z).sum()) + 1e-3 * float((c - [1, 0]) @ (c - [1, 0]))

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -60, 60)))
        g = x.T @ (p - target) + 2e-3 * (at - [1, 0])
        h = (x * (p * (1 - p))[:, None]).T @ x + 2e-3 * np.eye(2)
        step, size = np.linalg.solve(h, g), 1.0
        while size > 1e-4 and loss(at - size * step) > loss(at):
            size /= 2
        at = at - size * step
        if np.abs(step).max() < 1e-8:
            break
    return (float(at[0]), float(at[1])) if at[0] > 0 else (1.0, 0.0)


def train_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality") -> QualityModel:
    """Fit on at most ``sample`` labelled documents of each class: those of least id hash.

    Rows without an id or label don't count; of rows with one id, the greatest label and
    text do. Labelled ids that ``docs`` lacks leave the sample smaller.
    """
    known = (docs.select(F.col(id_col).cast("bigint").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
             .join(labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
                   .where("doc_id IS NOT NULL AND y IN (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y")), "doc_id")
             .withColumn("h", F.xxhash64("doc_id")))
    chosen = [r for y in (0, 1) for r in known.where(F.col("y") == y).orderBy("h", "doc_id").limit(sample).collect()]
    if not chosen:
        return QualityModel()
    picked = docs.sparkSession.createDataFrame([(r["doc_id"], r["y"], r["h"] % 5) for r in chosen], "doc_id bigint, y int, fold bigint")
    texts = (docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
             .join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y", "fold").agg(F.max("text").alias("text")))

    def featurise(batches):
        for batch in batches:
            out = [(f, y, *features(t)) for f, y, t in zip(*(batch.column(c).to_pylist() for c in ("fold", "y", "text")), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int32()),
                 pa.array([r[2].astype("<i4").tobytes() for r in out], pa.binary()),
                 pa.array([r[3].astype("<f4").tobytes() for r in out], pa.binary())], ["fold", "y", "slots", "vals"])

    rows = [(r["fold"], r["y"], np.frombuffer(r["slots"], "<i4"), np.frombuffer(r["vals"], "<f4"))
            for r in texts.mapInArrow(featurise, "fold bigint, y int, slots binary, vals binary").toLocalIterator()]
    rows.sort(key=lambda r: (r[0], r[1], zlib.crc32(r[2].tobytes()), len(r[2])))  # whatever order the tasks end in
    return fit(rows)


_SCORES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, probability double, kept boolean"


def quality_scores(model: QualityModel, threshold: float = THRESHOLD):
    """A column function, run over Arrow batches: text to counts, base verdict, probability and verdict."""

    @F.pandas_udf(_SCORES)
    def of(text: pd.Series) -> pd.DataFrame:
        rows = []
        for t in text:
            c = base_counts(t)
            failed, p = base_failed(c[0], c[4]), model.probability(t)
            rows.append((*c, failed, p, not failed and p >= threshold))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in _SCORES.split(", ")])

    return of


def judge(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, the counts, base_failed, probability and kept.

    A null text counts as empty: no words, so base_failed. Repeated rows and null ids
    are judged like others, equal texts alike. An empty table gives none.
    """
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), quality_scores(model, threshold)(F.col(text_col)).alias("s")).select("doc_id", "s.*")


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they are.

    A null text counts as empty and goes. Equal texts are judged alike; repeated rows and
    null ids like others. An empty table gives none.
    """

    @F.pandas_udf("boolean")
    def good(text: pd.Series) -> pd.Series:
        out = []
        for t in text:
            c = base_counts(t)
            out.append(not base_failed(c[0], c[4]) and model.probability(t) >= threshold)
        return pd.Series(out, dtype=bool)

    return docs.where(good(F.col(f"`{text_col}`")))


def op9_quality(spark, sf_dir):
    """All documents judged by a model that is trained on ``labels``."""
    docs = table(spark, sf_dir, "documents")
    return judge(docs, train_quality(docs, table(spark, sf_dir, "labels")))
