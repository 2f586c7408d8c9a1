"""BPE with word ends: each distinct word merged in a contiguous array of ranks, and decoding by the token table."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wavequarry.llm.byte_bpe import gathered
from wavequarry.llm.common import id_and_text, table

#: Characters of a text handled at once; a stretch without a blank or line end stays whole.
STRETCH = 1 << 20
#: Symbols of a short word. Longer ones keep their ranks in a heap: repeated scans are quadratic.
SHORT = 128
#: Cells of a matrix of words.
CELLS = 1 << 20
#: Distinct words whose ids a worker holds.
HELD = 500_000
NONE = np.iinfo(np.int32).max


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: its own where it has one, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    own = dict.fromkeys(shown)
    more = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(more)) for b in range(256)]


def stretches(text: str, size: int = STRETCH):
    """``text`` in stretches of about ``size`` characters that end before a blank or line end."""
    cut, at = re.compile("[ \n]"), 0
    while len(text) - at > size:
        found = cut.search(text, at + size)
        if found is None:
            break
        yield text[at:found.start()]
        at = found.start()
    yield text[at:]


class RankArrays:
    """The merges of a BPE vocabulary over byte symbols, whose last symbol carries the word end.

    A group of short words is a matrix: a row holds a word's parts, and beside each the rank
    of its merge with the next one. A round finds each row's least rank (the leftmost of
    equal ones), joins the two parts, deletes the boundary between them by moving what
    follows one place down, and looks up the ranks of the two pairs that changed.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], word_end: str):
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.final = np.array([vocab[c + word_end] for c in letters], np.int32)
        self._width = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self._width + vocab[b] for a, b in merges], np.int64)
        self._joined = np.array([vocab[a + b] for a, b in merges], np.int32)
        order = np.argsort(keys, kind="stable")
        self._keys, self._rank = keys[order], order.astype(np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NONE where they don't merge or a side is missing (negative)."""
        key = left.astype(np.int64) * self._width + right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self._keys[at] == key), self._rank[at], NONE)

    def symbols(self, word: bytes) -> np.ndarray:
        raw = np.frombuffer(word, np.uint8)
        out = self.inner[raw]
        out[-1] = self.final[raw[-1]]
        return out

    def encode(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word; words are not empty."""
        out: list[np.ndarray] = [None] * len(words)
        by_width: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            if len(w) > SHORT:
                out[k] = self.encode_long(w)
            else:
                by_width.setdefault(1 << (len(w) - 1).bit_length(), []).append(k)
        for width, which in by_width.items():
            step = max(1, CELLS // width)
            for a in range(0, len(which), step):
                part = which[a:a + step]
                for k, ids in zip(part, self._encode_matrix([words[k] for k in part], width), strict=True):
                    out[k] = ids
        return out

    def _encode_matrix(self, words: list[bytes], width: int) -> list[np.ndarray]:
        sizes = np.array([len(w) for w in words])
        raw, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - 1
        flat = self.inner[raw]
        flat[ends] = self.final[raw[ends]]
        parts = np.full((len(words), width), -1, np.int32)
        parts[np.arange(width) < sizes[:, None]] = flat
        rank = np.full(parts.shape, NONE, np.int32)
        rank[:, :-1] = self.ranks(parts[:, :-1], parts[:, 1:])
        done = np.empty_like(parts)
        left, place = np.arange(len(words)), np.arange(width)
        while len(left):
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(left)), at]
            more = best < NONE
            done[left[~more]] = parts[~more]
            left, parts, rank, at, best = left[more], parts[more], rank[more], at[more], best[more]
            if not len(left):
                break
            row = np.arange(len(left))
            source = np.minimum(place + (place > at[:, None]), width - 1)
            parts, rank = np.take_along_axis(parts, source, 1), np.take_along_axis(rank, source, 1)
            parts[:, -1], rank[:, -1] = -1, NONE
            parts[row, at] = self._joined[best]
            after = np.where(at + 1 < width, parts[row, np.minimum(at + 1, width - 1)], -1)
            rank[row, at] = self.ranks(parts[row, at], after)
            inside = np.flatnonzero(at > 0)
            rank[inside, at[inside] - 1] = self.ranks(parts[inside, at[inside] - 1], parts[inside, at[inside]])
        kept = done >= 0
        return np.split(done[kept], np.cumsum(kept.sum(axis=1))[:-1])

    def encode_long(self, word: bytes) -> np.ndarray:
        """The same merges for a word of any length: pairs wait in a heap by rank and place, parts are linked."""
        parts = self.symbols(word)
        n = len(parts)
        after, before = np.arange(1, n + 1).tolist(), np.arange(-1, n - 1).tolist()
        first = self.ranks(parts[:-1], parts[1:])
        at = np.flatnonzero(first < NONE)
        waiting = list(zip(first[at].tolist(), at.tolist(), strict=True))
        heapq.heapify(waiting)
        ids, current = parts.tolist(), first.tolist() + [NONE]

        def rate(k: int) -> None:
            current[k] = self._one(ids[k], ids[after[k]]) if after[k] < n else NONE
            if current[k] < NONE:
                heapq.heappush(waiting, (current[k], k))

        while waiting:
            rank, k = heapq.heappop(waiting)
            if ids[k] < 0 or current[k] != rank:
                continue
            gone = after[k]
            ids[k], ids[gone], current[gone] = int(self._joined[rank]), -1, NONE
            after[k] = after[gone]
            if after[k] < n:
                before[after[k]] = k
            rate(k)
            if before[k] >= 0:
                rate(before[k])
        out = np.array(ids, np.int32)
        return out[out >= 0]

    def _one(self, left: int, right: int) -> int:
        key = left * self._width + right
        at = int(np.searchsorted(self._keys, key))
        return int(self._rank[at]) if at < len(self._keys) and self._keys[at] == key else NONE


_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_QUICK_SPEC = json.dumps([{"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}, {"Regex": _PATTERN}])
_QUICK = re.compile("[!-~À-ÿ]+").fullmatch
#: The pattern over these characters in lower case; a line end stands between units.
_QUICK_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\na-zß-öø-ÿ0-9]+|\n").findall


class WordTokenizer:
    """A tokenizer's JSON file: its added tokens, its normaliser and pre-tokenizer as the library has them, and its merges by ``RankArrays``.

    Added tokens are cut out of the raw text first. Texts are taken by stretches between blanks
    or line ends: both are white space, which the pre-tokenizer drops and which nothing composes with.
    """

    def __init__(self, path: str, held: int = HELD):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model["dropout"] or model["unk_token"] or model["continuing_subword_prefix"] or model["byte_fallback"] or model["ignore_merges"] or spec["decoder"]:
            raise ValueError("only plain BPE with word ends and without a decoder is supported")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("only added tokens that match as they stand are supported")
        self._added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        own = sorted(self._added, key=len, reverse=True)
        self._split = re.compile("(" + "|".join(map(re.escape, own)) + ")").split if own else lambda t: [t]
        # what the quick form of splitting stands for
        self._quick = json.dumps([spec["normalizer"], spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]]) == _QUICK_SPEC
        whole = Tokenizer.from_file(path)
        self._normal, self._words_of = whole.normalizer.normalize_str, whole.pre_tokenizer.pre_tokenize_str
        letter = {c: b for b, c in enumerate(byte_letters())}
        self._byte = letter.__getitem__
        self.arrays = RankArrays(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]], model["end_of_word_suffix"] or "")
        names = {v: k for k, v in model["vocab"].items()} | {v: k for k, v in self._added.items()}
        self.vocab = [names.get(k, "") for k in range(max(names) + 1)]
        self._kind = "<u2" if len(self.vocab) <= 1 << 16 else "<u4"
        self._held, self._ids, self._merged = held, {"": b""}, {}
        self.decimal = _table(str(k) for k in range(len(self.vocab)))
        self.tokens = _table(self.vocab)

    def _parsed(self, units: list[str]):
        """Each unit's words and added tokens, as the library finds them."""
        for u in units:
            parts: list[str | int] = []
            for k, piece in enumerate(self._split(u)):
                if k % 2:
                    parts.append(self._added[piece])
                elif piece:
                    parts += [bytes(map(self._byte, w)).decode() for w, _ in self._words_of(self._normal(piece))]
            yield parts

    def learn(self, wanted: set[str]) -> None:
        """The ids of the units that are not held; their distinct words are merged together.

        Units of printable ASCII and Latin letters are normalised and split by the same rules in one go: they are
        composed already, and the classes of these characters are fixed.
        """
        if len(self._ids) + len(self._merged) > self._held:
            self._ids, self._merged = {"": b""}, {}
        new = wanted.difference(self._ids)
        quick = [u for u in new if self._quick and _QUICK(u) and not any(t in u for t in self._added)]
        found = _QUICK_WORDS("\n".join(quick).lower()) if quick else []
        others = list(new.difference(quick))
        parsed = list(self._parsed(others))
        words = list({*found, *(w for parts in parsed for w in parts if not isinstance(w, int))}.difference(self._merged, ("\n",)))
        merged = self._merged
        merged.update(zip(words, (ids.astype(self._kind).tobytes() for ids in self.arrays.encode([w.encode() for w in words])), strict=True))
        own: list[bytes] = []
        at = iter(quick)
        for w in found:
            if w == "\n":
                self._ids[next(at)] = b"".join(own)
                own = []
            else:
                own.append(merged[w])
        if quick:
            self._ids[next(at)] = b"".join(own)
        for u, parts in zip(others, parsed, strict=True):
            self._ids[u] = b"".join(np.array([w], self._kind).tobytes() if isinstance(w, int) else merged[w] for w in parts)

    def texts(self, texts: list[str]):
        """For each text its ids, a stretch at a time. Units of short texts are learned together."""
        at = 0
        while at < len(texts):
            to, chars = at, 0
            while to < len(texts) and chars + len(texts[to]) <= STRETCH:
                chars += len(texts[to])
                to += 1
            if to == at:
                yield self.encode(texts[at])
                at += 1
                continue
            cut = [t.replace("\n", " ").split(" ") for t in texts[at:to]]
            self.learn(set(chain.from_iterable(cut)))
            for units in cut:
                yield [self._looked_up(units)]
            at = to

    def encode(self, text: str):
        """The ids of ``text``, a stretch at a time."""
        for part in stretches(text):
            units = part.replace("\n", " ").split(" ")
            self.learn(set(units))
            yield self._looked_up(units)

    def _looked_up(self, units: list[str]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self._ids.__getitem__, units)), self._kind).astype(np.int64)


def _table(names) -> tuple[np.ndarray, np.ndarray]:
    """Strings in UTF-8, a space after each, in one, and where each begins."""
    raw = [n.encode() + b" " for n in names]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw], dtype=np.int64)])


class _Spaced:
    """The digest of strings that come with a space after each, without the last space."""

    def __init__(self):
        self._sum, self._begun = hashlib.sha256(), False

    def add(self, raw: bytes) -> None:
        if raw:
            if self._begun:
                self._sum.update(b" ")
            self._sum.update(memoryview(raw)[:-1])
            self._begun = True

    def hexdigest(self) -> str:
        return self._sum.hexdigest()


def encode_words(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ``ids``, with keep_ids).

    One pass without a shuffle: a worker holds ids of a bounded number of distinct words, and
    forgets them all beyond it; a long text is handled by stretches. A null or empty text, or
    one of white space, has no tokens and the digests of nothing. Null ids and repeated rows
    come back as rows of their own; equal texts get equal values. An empty table gives no
    rows; other columns are not read.
    """
    import public_tokenizers

    path = path or public_tokenizers.path("word_bpe_49k.json")

    def run(batches):
        tokenizer = WordTokenizer(path)
        for batch in batches:
            rows: list[tuple] = []
            for parts in tokenizer.texts(batch.column("text").to_pylist()):
                n, own, back, kept = 0, _Spaced(), _Spaced(), []
                for ids in parts:
                    n += len(ids)
                    own.add(gathered(*tokenizer.decimal, ids).tobytes())
                    back.add(gathered(*tokenizer.tokens, ids).tobytes())
                    if keep_ids:
                        kept += ids.tolist()
                rows.append((n, own.hexdigest(), back.hexdigest(), kept))
            n, own, back, kept = map(list, zip(*rows, strict=True)) if rows else ([], [], [], [])
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(own, pa.string()), pa.array(back, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns, names = [*columns, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)


def decode_ids(ids: list[int], path: str | None = None) -> str:
    """Ids to text: the tokens, a space between each two."""
    import public_tokenizers

    vocab = WordTokenizer(path or public_tokenizers.path("word_bpe_49k.json")).vocab
    return " ".join(vocab[k] for k in ids)


def op11_rank_array_bpe(spark, sf_dir):
    """Every document encoded with word ends and decoded again."""
    return encode_words(table(spark, sf_dir, "documents"))
