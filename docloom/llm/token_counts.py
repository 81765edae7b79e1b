"""Token counts of a unigram vocabulary by a count-only Viterbi search.

An Aho-Corasick automaton finds every vocabulary piece that ends at each place;
the search keeps, for each place, the best score and the number of pieces on that
path, and nothing to trace back. Ties and unknown characters follow the
tokenizers library's Unigram model: at each end the longest of equally good
pieces wins (it starts first), a character without a piece of its own gets the
least score minus 10, and neighbouring unknowns fuse to one piece.

Text becomes words as by its Metaspace pre-tokenizer: spaces turn into U+2581,
one is put in front, and each starts a word. Words are scored apart, so a
worker keeps the counts of those it has seen.

The vocabulary is a parameter: by default the pieces of piece_bpe_32k.model with
the scores that file gives them, control, unknown and byte pieces left out, which
can't stand in text. (The installed files hold no vocabulary trained as unigram,
and none is trained here.)

Defined results: a null text counts as empty: no tokens, score 0. Null and
repeated doc_ids keep their rows; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import from_arrow_schema

from docloom.llm import common, tokenizers_

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Not in any vocabulary: stands between words while the automaton runs over many.
BORDER = "\x00"
#: For that character in a text: as unknown as itself.
STAND_IN = "\ue000"


class CountingViterbi:
    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece and BORDER not in piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.kept: dict[str, tuple[int, float]] = {}

    def words(self, words: list[str]) -> list[tuple[int, float]]:
        """(pieces, score) of each word."""
        out, at = [], 0
        joined = BORDER.join(words) + BORDER
        hits = self.automaton.iter(joined)
        end, hit = next(hits, (len(joined), None))
        unknown = self.unknown
        for word in words:
            n = len(word)
            best, count, last_unknown = [0.0] * (n + 1), [0] * (n + 1), bytearray(n + 1)
            for i in range(1, n + 1):
                place, top, pieces, own, is_unknown = at + i - 1, None, 0, False, 0
                while end == place:
                    length, score = hit
                    score += best[i - length]
                    if top is None or score > top:  # longer pieces come first
                        top, pieces, is_unknown = score, count[i - length] + 1, 0
                    own = own or length == 1
                    end, hit = next(hits, (len(joined), None))
                if not own:
                    score = unknown + best[i - 1]
                    if top is None or score > top:
                        top, is_unknown = score, 1
                        pieces = count[i - 1] + (not last_unknown[i - 1])
                best[i], count[i], last_unknown[i] = top, pieces, is_unknown
            out.append((count[n], best[n]))
            at += n + 1
        return out

    def __call__(self, texts: list[str]) -> list[tuple[int, int, float]]:
        """(pieces, words, score) of each text."""
        cut = [self.cut(t) for t in texts]
        every = set().union(*cut)
        new = every.difference(self.kept)
        full = len(self.kept) + len(new) > tokenizers_.CACHE_CHUNKS
        if full and len(new) > len(every) // 2:  # other texts than those it was filled with
            self.kept, new, full = {}, every, False
        kept, listed = self.kept, list(new)
        kept.update(zip(listed, self.words(listed), strict=True))
        out = []
        for words in cut:
            got = list(map(kept.__getitem__, words))
            out.append((sum(n for n, _ in got), len(got), sum(s for _, s in got)))
        for w in new if full else [w for w in new if len(w) > tokenizers_.CACHE_CHARS]:
            del kept[w]
        return out

    @staticmethod
    def cut(text: str) -> list[str]:
        """A text's words, each with its space sign in front."""
        if not text:
            return []
        text = text.replace(" ", SPACE).replace(BORDER, STAND_IN)
        parts = text.split(SPACE)
        return [SPACE + p for p in (parts[1:] if text[0] == SPACE else parts)]


def pieces_of(file: str) -> list[tuple[str, float]]:
    """The pieces of a sentencepiece model that can stand in text, with their scores."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=file)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


@lru_cache(maxsize=2)
def counter(file: str) -> CountingViterbi:
    return CountingViterbi(pieces_of(file))


COUNTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_words", pa.int64()), ("score", pa.float64())])


def count_tokens(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_words and score (the sum of the best paths') of every row, without a shuffle."""
    file = model or tokenizers_.path("piece_bpe_32k.model")

    def count(batches):
        of = counter(file)
        for b in common.slices(batches):
            tokens, words, scores = zip(*of(common.texts(b["text"])), strict=True)
            yield common.record(COUNTS, doc_id=b["doc_id"], n_tokens=tokens, n_words=words, score=np.array(scores, float))

    return common.map_arrow(common.ids_and_texts(docs, id_col, text_col), count, COUNTS)


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(common.table(spark, sf_dir, "documents"))
