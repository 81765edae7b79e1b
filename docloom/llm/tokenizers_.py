"""Encoders of the public tokenizer files, one of each per Python worker.

Paths are parameters; by default the installed files. Every encoder gives
exactly the ids of the tokenizers library for the same file.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np

#: Entries of a worker's caches of encoded chunks and words; a full
#: table of words starts anew, one of chunks takes no more (frequent ones come early).
CACHE_CHUNKS, CACHE_WORDS = 400_000, 700_000
#: Longer chunks are not kept.
CACHE_CHARS = 64
#: From this length on the library itself encodes (tiktoken's regex engine has a stack limit).
LONG_TEXT = 500_000


def path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(file: str) -> dict:
    with open(file, encoding="utf-8") as f:
        return json.load(f)


def _byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=4)
def byte_bpe(file: str) -> Callable[[str], np.ndarray]:
    """Encoder of a byte-level BPE file: same ids as the tokenizers library, by
    the same merges in tiktoken's faster engine. Special tokens that stand in a
    text get their own ids, as the library gives without encode_special_tokens."""
    import tiktoken

    spec = load(file)
    chars = _byte_chars()
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    ranks = {bytes(chars[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    enc = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    slow = None

    def encode(text: str) -> np.ndarray:
        nonlocal slow
        if len(text) < LONG_TEXT:
            return enc.encode_to_numpy(text, allowed_special="all")
        if slow is None:
            from tokenizers import Tokenizer

            slow = Tokenizer.from_file(file)
            slow.no_truncation()
        return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


#: The characters of the Unicode property White_Space, as a class for re.
WHITE_SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
#: str.split() splits there as well.
_MORE = ("\x1c", "\x1d", "\x1e", "\x1f")


#: From here on, character classes differ between Unicode versions, and the
#: library's own normaliser and word pattern cut the text into words.
NEWER = "\u0530"
#: The word pattern of word-level files, for characters before NEWER and no white space.
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_\xb2\xb3\xb9\xbc-\xbe]+|[\d\xb2\xb3\xb9\xbc-\xbe]|[\W_]+").findall


class WordEncoder:
    """Encodes whole texts with a word-level BPE file (NFC, lower case, words by
    the file's pattern, white space dropped). Nothing looks across white space, so
    a worker keeps the ids of chunks between white space, and of their words.
    ``word_ids`` gives the ids of one word, as byte characters."""

    def __init__(self, file: str, word_ids: Callable[[str], list[int]]):
        spec = load(file)
        self.file, self.word_ids = file, word_ids
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split
        most = max([*spec["model"]["vocab"].values(), *self.special.values()])
        self.dtype, self.code = ("<u2", "H") if most < 1 << 16 else ("<u4", "I")
        self.shown = {b: c for c, b in _byte_chars().items()}
        self.kept: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.by_class = re.compile(WHITE_SPACE).split
        self.library = None

    def split(self, text: str) -> list[str]:
        return self.by_class(text) if any(c in text for c in _MORE) else text.split()

    def _raw(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes() if sys.byteorder == "little" else np.array(ids, self.dtype).tobytes()

    def word(self, w: str) -> bytes:
        got = self._raw(self.word_ids(w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.shown)))
        if len(w) <= CACHE_CHARS:
            self.words[w] = got
        return got

    def _by_library(self, part: str) -> bytes:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.file)
        words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
        return b"".join([self._raw(self.word_ids(w)) for w, _ in words])

    def part(self, part: str) -> bytes:
        if not part.isascii():
            if max(part) >= NEWER:
                return self._by_library(part)
            if not unicodedata.is_normalized("NFC", part):
                part = unicodedata.normalize("NFC", part)
            part = part.replace("Σ", "σ")  # letter by letter: no final sigma
        known, word, low = self.words, self.word, part.lower()
        if (got := known.get(low)) is not None:  # one word
            return got
        if low[-1:] in ".,;:!?" and low[-2:-1].isalpha() and (got := known.get(low[:-1])) is not None:  # and one mark
            return got + (known.get(low[-1]) or word(low[-1]))
        return b"".join([known.get(w) or word(w) for w in _WORDS(low)])

    def chunk(self, chunk: str) -> bytes:
        if "<|" not in chunk or not self.special:
            return self.part(chunk)
        return b"".join([self._raw([self.special[p]]) if p in self.special else self.part(p) for p in self.cut(chunk) if p])

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian bytes of dtype."""
        split = [self.split(t) for t in texts]
        every = set().union(*split)
        new = every.difference(self.kept)
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        full = len(self.kept) + len(new) > CACHE_CHUNKS
        if full and len(new) > len(every) // 2:  # other texts than those it was filled with
            self.kept, new, full = {}, every, False
        kept, chunk = self.kept, self.chunk
        for c in new:
            kept[c] = chunk(c)
        out = [b"".join(map(kept.__getitem__, chunks)) for chunks in split]
        for c in new if full else [c for c in new if len(c) > CACHE_CHARS]:
            del kept[c]
        return out


@lru_cache(maxsize=2)
def word_bpe(file: str) -> WordEncoder:
    """Encoder by the tokenizers library's own model, which is asked for each
    distinct word once. Ids take two bytes where they fit."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenize = Tokenizer.from_file(file).model.tokenize
    return WordEncoder(file, lambda w: [t.id for t in tokenize(w)])
