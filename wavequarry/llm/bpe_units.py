"""Byte-level BPE over units: stretches of text that no pre-token crosses."""

from __future__ import annotations

import base64
import json
import re
from itertools import chain

import numpy as np

#: Characters handled at once; bounds a worker's memory on very long texts.
SEGMENT = 2_000_000
_ISOLATED = re.compile(r"(?<=\S)(?= \S)")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def load_encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


def added_tokens(path: str) -> dict[str, int]:
    """The tokens that a tokenizer's JSON file adds to its vocabulary: they are found in a text before all else."""
    with open(path, "rb") as f:
        found = json.load(f)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in found):
        raise ValueError("only added tokens that match as they stand are supported")
    return {t["content"]: t["id"] for t in found}


def segments(text: str) -> list[str]:
    """``text`` cut before single spaces, into stretches of about SEGMENT characters.

    A space between two other characters always starts a pre-token, so the cuts
    change nothing; a stretch without such a space stays whole.
    """
    if len(text) <= SEGMENT:
        return [text]
    out, at = [], 0
    while len(text) - at > SEGMENT:
        cut = _ISOLATED.search(text, at + SEGMENT)
        if cut is None:
            break
        out.append(text[at:cut.start()])
        at = cut.start()
    out.append(text[at:])
    return out


def units(text: str) -> list[str] | None:
    """Words with the space before them, and line ends; None unless all white space is single blanks or line ends.

    Concatenated, they are the text, and each pre-token lies in one of them.
    """
    words = text.split()
    single = text.count(" ") + text.count("\n")
    if len(words) != single + 1 or sum(map(len, words)) + single != len(text):
        return None
    lines = text.split("\n")
    out: list[str] = []
    for k, line in enumerate(lines):
        if k:
            out.append("\n")
        first, *rest = line.split(" ")
        out.append(first)
        out += [" " + w for w in rest]
    return out


class UnitEncoder:
    """Texts to id bytes (little-endian unsigned 32-bit), each distinct unit encoded once while it is held.

    ``held`` bounds the units kept between calls. ``added`` tokens are cut out of a text first, leftmost and longest.
    """

    def __init__(self, encoding, held: int = 300_000, added: dict[str, int] | None = None):
        self._added = {t: np.array([k], "<u4").tobytes() for t, k in (added or {}).items()}
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(self._added, key=len, reverse=True))) + ")").split
        self._encode = encoding._core_bpe.encode_ordinary if hasattr(encoding, "_core_bpe") else encoding.encode_ordinary
        self._held, self._ids = held, {}
        line_end = self._encode("\n")
        self._line_end = line_end[0] if len(line_end) == 1 else None

    def _raw(self, text: str) -> bytes:
        return np.array(self._encode(text), dtype="<u4").tobytes()

    def learn(self, wanted) -> None:
        """Encode the units that are not held, joined by line ends, in one call."""
        known = self._ids
        if len(known) > self._held:
            known.clear()
        new = [u for u in set(wanted) if u not in known]
        if not new:
            return
        if self._line_end is None:
            known.update((u, self._raw(u)) for u in new)
            return
        own = [u for u in new if "\n" in u or not u or u[-1].isspace() or u[0].isspace() and u[0] != " " or u.isspace()]
        known.update((u, self._raw(u)) for u in own)
        if own:
            left = set(own)
            new = [u for u in new if u not in left]
        if new:
            ids = np.array(self._encode("\n".join(new)), dtype="<u4")
            raw = ids.tobytes()
            ends = (np.flatnonzero(ids == self._line_end) * 4).tolist()
            if len(ends) != len(new) - 1:
                known.update((u, self._raw(u)) for u in new)
                return
            known.update(zip(new, map(raw.__getitem__, map(slice, [0, *(e + 4 for e in ends)], [*ends, len(raw)])), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        odd = {k: self._split(t) for k, t in enumerate(texts) if any(x in t for x in self._added)}
        if not odd:
            return self._plain(texts)
        out = self._plain(["" if k in odd else t for k, t in enumerate(texts)])
        for k, parts in odd.items():
            between = self._plain(parts[::2])
            out[k] = b"".join(x for a, t in zip(between, [*parts[1::2], None], strict=True) for x in (a, self._added[t] if t else b""))
        return out

    def _plain(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for group in _grouped(texts):
            cut = [[units(s) or s for s in segments(t)] if t else [] for t in group]
            self.learn(chain.from_iterable(u for parts in cut for u in parts if not isinstance(u, str)))
            get = self._ids.__getitem__
            out += [b"".join(self._raw(u) if isinstance(u, str) else b"".join(map(get, u)) for u in parts) for parts in cut]
        return out


def _grouped(texts: list[str]):
    group, chars = [], 0
    for t in texts:
        if group and chars + len(t) > SEGMENT:
            yield group
            group, chars = [], 0
        group.append(t)
        chars += len(t)
    if group:
        yield group
