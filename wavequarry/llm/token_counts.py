"""Token counts without tokens: best unigram segmentation by Aho-Corasick and dynamic programming."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavequarry.llm.common import id_and_text, table

BLANK = "\u2581"
#: What an unknown character scores below the vocabulary's least score.
UNKNOWN_PENALTY = 10.0
#: Distinct words whose counts a worker holds.
HELD = 300_000


def load_vocabulary(path: str) -> tuple[list[tuple[str, float]], int]:
    """The pieces with their scores, and the unknown piece's id, of a sentencepiece model file."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(p.id_to_piece(k), p.get_score(k)) for k in range(p.get_piece_size())], p.unk_id()


class UnigramCounter:
    """Piece counts and scores of the best segmentation.

    The tokenizer's rules: blanks become U+2581, a text starts with one, and each one
    starts a word of its own; a word's best path has the greatest sum of scores; of
    paths to a place that tie, the one whose last piece starts first stands. A
    character that is no piece may stand alone at ``UNKNOWN_PENALTY`` below the least
    score. Unknown characters that follow one another, and the unknown piece where a
    text spells it, are one stretch: one token if it is a piece, else its UTF-8 bytes
    where the vocabulary has bytes, else one token.
    """

    def __init__(self, vocabulary: list[tuple[str, float]], unknown_id: int = 0, held: int = HELD):
        import ahocorasick

        self._machine = ahocorasick.Automaton()
        for k, (piece, score) in enumerate(vocabulary):
            if piece:
                self._machine.add_word(piece, (len(piece), score, k == unknown_id))
        self._machine.make_automaton()
        self._single = {piece for piece, _ in vocabulary if len(piece) == 1}
        self._unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        self._names = {piece for piece, _ in vocabulary}
        self._bytes = all(f"<0x{b:02X}>" in self._names for b in range(256))
        self._words: dict[str, tuple[int, int, float]] = {}
        self._held = held

    def _stretch(self, chars: str) -> int:
        return len(chars.encode()) if self._bytes and chars not in self._names else 1

    def word(self, word: str) -> tuple[int, int, float]:
        """Pieces, pieces that stand for unknown characters, and the best score of one word."""
        n = len(word)
        best: list[float | None] = [0.0] + [None] * n
        # up to the stretch of unknown characters that a path ends in, which starts at ``open_``
        pieces, unknown, open_ = [0] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        found, k, single = list(self._machine.iter(word)), 0, self._single
        total = len(found)

        def reach(at: int, start: int, score: float, known: bool) -> None:
            best[at] = score
            if open_[start] < 0:
                pieces[at], unknown[at], open_[at] = pieces[start] + known, unknown[start], -1 if known else start
            elif not known:
                pieces[at], unknown[at], open_[at] = pieces[start], unknown[start], open_[start]
            else:
                more = self._stretch(word[open_[start]:start])
                pieces[at], unknown[at], open_[at] = pieces[start] + more + 1, unknown[start] + more, -1

        for end in range(n):
            at = end + 1
            while k < total and found[k][0] == end:  # longest first: by rising start
                size, score, is_unknown = found[k][1]
                k += 1
                score += best[at - size]
                if best[at] is None or score > best[at]:
                    reach(at, at - size, score, not is_unknown)
            if word[end] not in single:
                score = self._unknown + best[end]
                if best[at] is None or score > best[at]:
                    reach(at, end, score, False)
        more = self._stretch(word[open_[n]:]) if open_[n] >= 0 else 0
        return pieces[n] + more, unknown[n] + more, best[n]

    def text(self, text: str | None) -> tuple[int, int, float]:
        if not text:
            return 0, 0, 0.0
        s = text.replace(" ", BLANK)
        words = s.split(BLANK)
        if s[0] == BLANK:
            del words[0]
        known = self._words
        if len(known) > self._held:
            known.clear()
        n = u = 0
        score = 0.0
        for w in words:
            got = known.get(w)
            if got is None:
                got = known[w] = self.word(BLANK + w)
            n += got[0]
            u += got[1]
            score += got[2]
        return n, u, score


def count_tokens(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, n_unknown (tokens for unknown characters) and score of the best segmentation.

    A null or empty text has none and scores 0. Null ids and repeated rows are rows
    of their own; equal texts have equal counts. An empty table gives none. Each
    worker holds counts of a bounded number of words, and forgets them all beyond it.
    """
    import public_tokenizers

    path = model_path or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches):
        counter = UnigramCounter(*load_vocabulary(path))
        for batch in batches:
            rows = [counter.text(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([r[2] for r in rows], pa.float64())], ["doc_id", "n_tokens", "n_unknown", "score"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, n_tokens bigint, n_unknown bigint, score double")


def op4_token_counts(spark, sf_dir):
    """Unigram token counts of all documents."""
    return count_tokens(table(spark, sf_dir, "documents"))
