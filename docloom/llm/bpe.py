"""BPE encoding by backtracking, and decoding by an offset table.

An Aho-Corasick automaton finds all vocabulary tokens in a word. The encoder
takes the longest token at each place, goes on only where the pair-compatibility
table allows the neighbours, and steps back otherwise; places found dead are
never tried again, so a word takes linear time. The result is exactly that of
the merges in rank order.

Defined results: a null text counts as empty and gives no ids, and an empty
decoded text. Special tokens written in a text get their own ids, as in the
tokenizers library. Rows are kept as they are, null or repeated doc_ids too.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import from_arrow_schema

from docloom.llm import common, tokenizers_

#: Entries of the pair-compatibility table; a full table starts anew.
PAIRS = 1 << 19
NEVER = 1 << 60


class Backtracking:
    """The BPE model of a tokenizer file; words are strings of its byte characters."""

    def __init__(self, spec: dict):
        import ahocorasick

        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        ids = {self._symbols(token): i for token, i in vocab.items()}
        self.merges: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int]] = {}
        self.born = dict.fromkeys(ids.values(), NEVER)
        for rank, pair in enumerate(model["merges"]):
            a, b = (ids[self._symbols(x)] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            made = vocab[pair.replace(" ", "", 1) if isinstance(pair, str) else pair[0] + pair[1]]
            if (a, b) not in self.merges:
                self.merges[a, b] = rank
            if made not in parts:
                parts[made] = (a, b)
                self.born[made] = rank
        for symbols, i in ids.items():
            if len(symbols) == 1:
                self.born[i] = -1
        self.parts = parts
        #: For each token its left and right edge over time: (token, rank at which it is used up), last the token itself.
        self.left, self.right = self._edges(0), self._edges(1)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.whole: dict[str, int] = {}
        self.automaton = ahocorasick.Automaton()
        for symbols, i in sorted(ids.items(), key=lambda x: len(x[0])):
            if self.born[i] == NEVER or len(symbols) > 1 and not self._reached(i):
                continue  # a special token, or one that no merges lead to
            self.whole[symbols] = i
            self.automaton.add_word(symbols, (len(symbols), i))
        self.automaton.make_automaton()
        self.lengths = {i: len(s) for s, i in self.whole.items()}

    def _symbols(self, token: str) -> str:
        """One character for each symbol: a byte character that ends a word stands apart from the same within."""
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            token = token[: -len(self.suffix)]
            return token[:-1] + chr(0xE000 + ord(token[-1]))
        return token

    def _edges(self, side: int) -> dict[int, list[tuple[int, int]]]:
        out: dict[int, list[tuple[int, int]]] = {}
        for i in sorted(self.born, key=self.born.get):
            inner = self.parts.get(i)
            out[i] = ([*out[inner[side]][:-1], (inner[side], self.born[i])] if inner and self.born[i] >= 0 else []) + [(i, NEVER)]
        return out

    def _crosses(self, a: int, b: int, before: int) -> bool:
        """Whether, while a and b are being built side by side, a merge across
        their border comes first (of rank below ``before``)."""
        left, right = self.right[a], self.left[b]
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = left[i], right[j]
            rank = self.merges.get((x, y), NEVER)
            # of equal ranks the leftmost merge comes first
            if rank < before and rank < x_until and rank <= y_until:
                return True
            if x_until <= y_until:
                if x_until == NEVER:
                    return False
                i += 1
            else:
                j += 1

    def _reached(self, i: int) -> bool:
        a, b = self.parts[i]
        return not self._crosses(a, b, self.born[i])

    def compatible(self, a: int, b: int) -> bool:
        ok = self.pairs.get((a, b))
        if ok is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            ok = self.pairs[a, b] = not self._crosses(a, b, NEVER)
        return ok

    def word(self, chars: str) -> list[int]:
        """The ids of one word, given as byte characters."""
        if self.suffix:
            chars = chars[:-1] + chr(0xE000 + ord(chars[-1]))
        if (i := self.whole.get(chars)) is not None:
            return [i]
        return self._backtrack(chars)

    def _backtrack(self, chars: str) -> list[int]:
        n = len(chars)
        found: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, hit in self.automaton.iter(chars):
            found[end + 1 - hit[0]].append(hit)  # shorter ones first
        dead = bytearray(n + 1)
        out: list[int] = []
        took: list[int] = []  # for each token in out, its place in found
        pos, k = 0, len(found[0]) - 1
        pairs, compatible = self.pairs, self.compatible
        while pos < n:
            here, last = found[pos], out[-1] if out else None
            while k >= 0:
                length, token = here[k]
                if not dead[pos + length]:
                    if last is None:
                        break
                    ok = pairs.get((last, token))
                    if ok or ok is None and compatible(last, token):
                        break
                k -= 1
            if k >= 0:
                out.append(token)
                took.append(k)
                pos += length
                k = len(found[pos]) - 1 if pos < n else -1
            else:
                if not out:
                    raise ValueError("the vocabulary lacks a byte")
                dead[pos] = 1
                token, k = out.pop(), took.pop()
                pos -= self.lengths[token]
                k -= 1
        return out


class OffsetTable:
    """Decoding: all token strings in one byte array, and where each begins.

    Without a decoder the library joins token strings with spaces; with the
    byte-level one it maps their characters back to bytes."""

    def __init__(self, spec: dict):
        tokens = {i: t for t, i in spec["model"]["vocab"].items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.spaced = not spec.get("decoder")
        chars, special = tokenizers_._byte_chars(), {x["id"] for x in spec["added_tokens"]}
        plain = lambda i: tokens[i].encode() if self.spaced or i in special else bytes(chars[c] for c in tokens[i])
        parts = [(plain(i) + b" " * self.spaced if i in tokens else b"") for i in range(max(tokens) + 1)]
        self.data = np.frombuffer(b"".join(parts), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        self.sizes = np.diff(self.starts)

    def decode(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.starts[ids] - (ends - sizes), sizes)
        at += np.arange(total)
        raw = self.data[at].tobytes()
        return raw[:-1] if self.spaced and raw else raw if self.spaced else raw.decode("utf-8", "replace").encode()


@lru_cache(maxsize=2)
def word_codec(file: str) -> tuple[tokenizers_.WordEncoder, OffsetTable]:
    """Encoder and decoder of a word-level BPE file."""
    spec = tokenizers_.load(file)
    return tokenizers_.WordEncoder(file, Backtracking(spec).word), OffsetTable(spec)


CODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode_decode(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """doc_id, ids and decoded text of every row; with ``digests`` their length
    and SHA-256 instead (ids as little-endian unsigned 32-bit)."""
    file = tokenizer or tokenizers_.path("word_bpe_49k.json")
    schema = DIGEST if digests else CODED

    def code(batches):
        encoder, table = word_codec(file)
        for b in common.slices(batches):
            raw = [np.frombuffer(x, encoder.dtype) for x in encoder(common.texts(b["text"]))]
            if digests:
                yield common.record(
                    schema,
                    doc_id=b["doc_id"],
                    n_tokens=[len(x) for x in raw],
                    ids_sha256=[hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in raw],
                    decoded_sha256=[hashlib.sha256(table.decode(x)).hexdigest() for x in raw],
                )
            else:
                yield common.record(schema, doc_id=b["doc_id"], ids=[x.astype(np.int32) for x in raw], decoded=[table.decode(x).decode() for x in raw])

    return common.map_arrow(common.ids_and_texts(docs, id_col, text_col), code, schema)


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_decode(common.table(spark, sf_dir, "documents"), digests=True)
