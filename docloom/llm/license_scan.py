"""License scan: ordered signature rules behind a keyword prefilter.

A rule is a regular expression with a label, a priority, a confidence and a
keyword that every match contains; license_rules.py lists them. An Aho-Corasick
automaton over all keywords tells in one pass which rules can match a text at all;
only these run. Before it, a cheaper gate over the bytes asks for one of a few words
that cover all keywords. Of overlapping detections the one of higher priority stays
(of equal priority the longer, then the earlier), and detections inside it are
suppressed, by a sweep over the places where kept ones begin.

Beside them stand the base phrases: runs of whole words, counted in all places.

Defined results: a null text counts as empty: no words, no labels, score 0. Null
and repeated doc_ids keep their rows; other columns are ignored, whatever their
names. Of rules with one priority and one place the first listed names the
detection. An empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import from_arrow_schema

from docloom.llm import common, license_rules

#: Base phrases and their labels.
BASE = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

#: Keywords that count only as whole words, since many words hold them.
WHOLE = {"cc", "mit", "bsd"}
#: Words that are too common to gate by.
COMMON = {"the", "of", "and", "or", "to", "in", "is", "by", "be", "not", "any", "this", "under", "used", "with", "without", "you", "buy", "all", "copy", "free"}


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    confidence: float
    keyword: str
    match: re.Pattern


def _compile(pattern: str) -> re.Pattern:
    """A rule's pattern as whole words; spaces as license_rules.py says."""
    spaced = re.sub(r"\[[^\]]*\]| \?| ", lambda m: {" ?": r"\s*", " ": r"\s+"}.get(m[0], m[0].replace(" ", r"\s")), pattern)
    return re.compile(r"(?<![a-z0-9])(?:" + spaced + r")(?![a-z0-9])")


def parse_rules(lines: str) -> list[Rule]:
    """The rules of a listing, in order of priority, else as listed."""
    rows = [line.split(" :: ") for line in lines.strip().splitlines()]
    return sorted((Rule(label, int(priority), float(sure), word, _compile(p)) for label, priority, sure, word, p in rows), key=lambda r: -r.priority)


def gate_words(keywords: list[str]) -> list[str]:
    """Words of which every keyword holds one, anywhere in it unless WHOLE: those that cover most come first."""
    left, out = {k: set(k.split(" ")) - COMMON for k in keywords}, []
    while left:
        worth: dict[str, int] = {}
        for words in left.values():
            for w in words:
                worth[w] = worth.get(w, 0) + len(w)
        best = max(sorted(worth), key=worth.__getitem__)
        out.append(best)
        left = {k: words for k, words in left.items() if best not in (words if best in WHOLE else k)}
    return out


class Gate:
    """Whether a text, in lower-case bytes, holds one of some words; those of WHOLE by themselves."""

    def __init__(self, words: list[str]):
        self.anywhere = [w.encode() for w in words if w not in WHOLE]
        self.whole = [(w.encode(), re.compile(rf"(?<![0-9a-z]){re.escape(w)}(?![0-9a-z])".encode())) for w in words if w in WHOLE]

    def __call__(self, low: bytes) -> bool:
        return any(w in low for w in self.anywhere) or any(w in low and p.search(low) for w, p in self.whole)


class Scanner:
    def __init__(self, rules: list[Rule]):
        import ahocorasick

        self.rules = rules
        by_word: dict[str, list[int]] = {}
        for k, r in enumerate(rules):
            by_word.setdefault(r.keyword, []).append(k)
        self.automaton = ahocorasick.Automaton()
        for word, ks in by_word.items():
            self.automaton.add_word(word, (len(word) if word in WHOLE else 0, ks))
        self.automaton.make_automaton()
        self.gate = gate_words(list(by_word))

    def ready(self, text: str) -> list[int]:
        """The rules whose keyword stands in a lower-case text."""
        spaced = " ".join(text.split())  # any white space, as in the rules
        alone = lambda c: not ("0" <= c <= "9" or "a" <= c <= "z")
        out: set[int] = set()
        for end, (size, ks) in self.automaton.iter(spaced):
            if not size or alone(spaced[end - size : end - size + 1] if end >= size else " ") and alone(spaced[end + 1 : end + 2] or " "):
                out.update(ks)
        return sorted(out)

    def __call__(self, text: str, every: bool = False) -> list[tuple[int, int, str, float]]:
        """(start, end, label, confidence) of the detections that stay, in a
        lower-case text; ``every`` runs all rules, without the prefilter."""
        found = []
        for k in range(len(self.rules)) if every else self.ready(text):
            r = self.rules[k]
            found += [(-r.priority, m.start() - m.end(), m.start(), m.end(), k) for m in r.match.finditer(text)]
        return sorted((a, z, self.rules[k].label, self.rules[k].confidence) for a, z, k in outer(sorted(found)))


def outer(found: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, rule) of the detections, in the given order, that lie in none
    before them. A tree over the places where they begin holds the furthest end."""
    starts = sorted({x[2] for x in found})
    tree, kept = [0] * (len(starts) + 1), []
    for _, _, a, z, k in found:
        at = i = bisect_right(starts, a)
        reach = 0
        while i:
            reach = max(reach, tree[i])
            i &= i - 1
        if reach < z:
            kept.append((a, z, k))
            while at < len(tree):
                tree[at] = max(tree[at], z)
                at += at & -at
    return kept


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner(parse_rules(license_rules.RULES))


#: Bytes of words: 0-9, a-z and all of non-ASCII characters.
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_BETWEEN = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
_IN = rb"[0-9a-z\x80-\xff]"


@lru_cache(maxsize=16)
def _gate(base: tuple) -> Gate:
    """Any detection at all: of a rule, or of a base phrase, which holds its longest word."""
    return Gate(list(dict.fromkeys([*scanner().gate, *(max(p.split(" "), key=len) for p, _ in base)])))


def base_places(low: bytes, base: list[tuple[str, str]]) -> list[tuple[int, str]]:
    """(byte place, label) of all places of base phrases."""
    return sorted((m.start(), label) for phrase, label in base for m in _phrase(phrase).finditer(low))


@lru_cache(maxsize=4096)
def _phrase(phrase: str) -> re.Pattern:
    """Whole words, one after the other; a look-ahead, so that places may overlap."""
    words = [re.escape(w.encode()) for w in phrase.split(" ")]
    return re.compile(rb"(?<!" + _IN + rb")(?=" + _BETWEEN.join(words) + rb"(?!" + _IN + rb"))")


SPANS = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("confidence", pa.float64())])
FOUND = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(SPANS))]
)


def scan(docs: DataFrame, base: list[tuple[str, str]] = BASE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: word and base phrase counts, labels, score, and spans
    (character places in the text) of the detections. One pass, no shuffle."""

    def run(batches):
        gate = _gate(tuple(base))
        for b in common.slices(batches):
            rows = [one(t, gate) for t in common.texts(b["text"])]
            cols = list(zip(*rows, strict=True))
            yield common.record(FOUND, doc_id=b["doc_id"], **{f.name: c for f, c in zip(list(FOUND)[1:], cols, strict=True)})

    def one(text: str, gate: Gate) -> tuple:
        low = text.encode("utf-8", "replace").lower()
        is_word = _WORD[np.frombuffer(low, np.uint8)]
        starts = is_word.copy()
        starts[1:] &= ~is_word[:-1]
        n_words = int(np.count_nonzero(starts))
        if not gate(low):
            return n_words, 0, None, None, "", "", 0.0, []
        places = base_places(low, base)
        spans = scanner()(low.decode("utf-8", "replace"))
        number = lambda at: int(np.count_nonzero(starts[:at]))
        basic = sorted({label for _, label in places})
        labels = sorted({*basic, *(label for _, _, label, _ in spans)})
        sure = max([0.6 * bool(places), *(c for *_, c in spans)])
        return (
            n_words, len(places), number(places[0][0]) if places else None, number(places[-1][0]) if places else None, ",".join(basic), ",".join(labels), float(sure),
            [{"start": a, "end": z, "label": label, "confidence": c} for a, z, label, c in spans],
        )

    return common.map_arrow(common.ids_and_texts(docs, id_col, text_col), run, FOUND)


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents")).drop("spans")
