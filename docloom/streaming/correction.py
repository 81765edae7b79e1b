"""Ordered correction of documents' components as a stream with keyed state.

Each document is a key of its own, so documents run side by side. Components may
come in any order; a document's state holds those that wait for their turn, the
next index, the tail of the last corrected text and the spellings seen so far. A
row of a newer generation starts the document anew; rows of an older one are
dropped and counted. A corrector that fails, or whose output fails validation,
leaves the raw text in place.

A row with the label END closes a document at its index: what is still missing before
it is given up and what waits goes out in order. A row with the label ABORT throws
away all that waits of its generation; later rows of it are dropped.

With a glossary, names of the corrected texts of a document are counted as they come,
and the spellings seen often enough go to the corrector with each segment. State need
not stay for ever: a closed document's can be removed some time after it closed, and one
that hears nothing for long be closed, with what waits for it going out in order.
"""

from __future__ import annotations

import itertools
import json
import unicodedata
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docloom.functions import prompts
from docloom.functions.names import name_candidates_py
from docloom.functions.splitters import split_segments_py

Corrector = Callable[[str, str], str]

#: Labels that are corrected, sizes.
LABELS = ["doc_title", "paragraph_title", "text", "caption"]
#: Labels of rows that end a document.
END, ABORT = "<end>", "<abort>"
PREVIOUS_CHARS, SEGMENT_CHARS = 600, 1200

INPUT = "document_id string, generation int, index int, label string, raw_text string"
OUTPUT = "document_id string, generation int, index int, label string, content string, content_raw string, previous string, status string"


def tail_py(text: str, limit: int) -> str:
    """The last characters of a text, from a sentence start in their first half, else a word start."""
    import re

    if len(text) <= limit:
        return text
    tail = text[len(text) - max(0, limit) :]
    starts = [m.end() for m in re.finditer(r"[.!?…]\s+", tail[: limit // 2])] or [tail.find(" ") + 1]
    return tail[starts[0] :]


def sound(raw: str, new: str) -> bool:
    """Not empty, of a like length, and with all numbers of the raw text."""
    import re

    numbers = lambda t: set(re.findall(r"(?<!\w)\d[\d.,/%:-]*(?!\w)", t))
    return bool(new.strip()) and 0.35 <= len(new.strip()) / max(1, len(raw)) <= 3.0 and numbers(raw) <= numbers(new)


class Ledger:
    """Spellings of names in the order they were seen; adding up two in order gives that of both."""

    def __init__(self, counts: dict[str, dict[str, int]] | None = None):
        self.counts = counts or {}
        self.changed: set[str] = set()

    def add(self, text: str) -> None:
        for name in name_candidates_py(text):
            key = "".join(c for c in unicodedata.normalize("NFD", name) if not unicodedata.combining(c)).replace("đ", "d").replace("Đ", "D").lower()
            spelled = self.counts.setdefault(key, {})
            spelled[name] = spelled.get(name, 0) + 1
            self.changed.add(key)

    def terms(self, min_count: int = 2, limit: int = 20, max_chars: int = 400) -> list[str]:
        """Names seen often enough, most frequent first, up to the first that breaks a
        limit; the spelling used most, then the one with most marks, then the first."""
        out, used = [], 0
        for key, spelled in sorted(self.counts.items(), key=lambda kv: (-sum(kv[1].values()), kv[0])):
            if sum(spelled.values()) < min_count or len(out) == limit:
                break
            best = max(spelled, key=lambda v: (spelled[v], sum(ord(c) > 127 for c in v)))
            used += len(best) + 2
            if used > max_chars:
                break
            out.append(best)
        return out


def correct_text(text: str, previous: str, corrector: Corrector, segment: int = SEGMENT_CHARS, previous_chars: int = PREVIOUS_CHARS, ledger: Ledger | None = None) -> tuple[str, str]:
    """(content, status: success, partial or failed): segment by segment with the
    tail of what went before; one more try without it; then the raw segment. With a
    ledger the first try is given its terms as well, and each segment's names join it."""
    out, bad = "", 0
    parts = split_segments_py(text, segment)
    for part in parts:
        tail = tail_py(out or previous, previous_chars)
        tries = [(tail,), ("",)] if ledger is None else [(tail, "; ".join(ledger.terms())), ("", "")]
        for context in tries:
            try:
                new = corrector(part, *context)
            except Exception:  # a corrector's failure leaves the text as it is
                continue
            if sound(part, new):
                break
        else:
            new, bad = part, bad + 1
        out += new
        if ledger is not None:
            ledger.add(new)
    return out, "success" if not bad else "failed" if bad == len(parts) else "partial"


_COLUMNS = ["document_id", "generation", "index", "label", "content", "content_raw", "previous", "status"]


class OrderedCorrection(StatefulProcessor):
    def __init__(self, corrector: Corrector, labels: list[str], glossary: bool = False, keep_seconds: float | None = None, idle_seconds: float | None = None):
        self.corrector, self.labels, self.glossary, self.keep, self.idle = corrector, labels, glossary, keep_seconds, idle_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "generation int, next int, tail string, dropped long, closed boolean")
        self.waiting = handle.getMapState("waiting", "index int", "row string")
        self.names = handle.getMapState("names", "key string", "spellings string") if self.glossary else None

    def _ledger(self) -> Ledger | None:
        if self.names is None:
            return None
        return Ledger({k: json.loads(v) for (k,), (v,) in self.names.iterator()} if self.names.exists() else {})

    def _forget(self) -> None:
        for part in (self.state, self.waiting, self.names):
            if part is not None:
                part.clear()

    def _done(self, key: Any, order, generation: int, tail: str, fresh: dict[int, tuple], stored: bool = True) -> tuple[list[tuple], str]:
        """The rows of some indexes, corrected in turn, up to the first that is not there, and
        the tail after them. They are taken out of fresh, and of the state if some are stored."""
        out, ledger = [], self._ledger()
        for at in order:
            if (row := fresh.pop(at, None)) is None:
                if not stored or (held := self.waiting.getValue((at,))) is None:
                    break
                row = json.loads(held[0])
                self.waiting.removeKey((at,))
            elif stored and self.waiting.containsKey((at,)):  # an earlier one of the same index
                self.waiting.removeKey((at,))
            label, raw = row
            previous = tail
            content, status = raw, "skipped"
            if label in self.labels:
                if (raw or "").strip():
                    content, status = correct_text(raw, previous, self.corrector, ledger=ledger)
                tail = tail_py(content or "", PREVIOUS_CHARS)
            out.append((key[0], generation, at, label, content, raw, previous, status))
        for name in ledger.changed if ledger else ():
            self.names.updateValue((name,), (json.dumps(ledger.counts[name], ensure_ascii=False),))
        return out, tail

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known = self.state.get() if self.state.exists() else None
        generation, at, tail, dropped, closed = known or (0, 0, "", 0, False)
        # Rows whose turn it is never go through the state; only what has to wait is stored.
        end, fresh, stored = None, {}, known is not None and self.waiting.exists()
        for frame in rows:
            for r in (frame.sort_values(["generation", "index"]) if len(frame) > 1 else frame).itertuples(index=False):
                if r.generation > generation:
                    if known is not None:
                        self._forget()
                    fresh, stored = {}, False
                    generation, at, tail, closed, end = r.generation, 0, "", False, None
                if r.generation < generation or closed:
                    dropped += 1
                elif r.label == ABORT:
                    closed, fresh, stored = True, {}, False
                    self.waiting.clear()
                elif r.label == END:
                    end = int(r.index)
                elif r.index >= at:  # earlier ones are done already
                    fresh[int(r.index)] = r.label, r.raw_text
        order = itertools.count(at)
        if end is not None and not closed:
            order = sorted(k for k in {*fresh, *(k for (k,) in (self.waiting.keys() if stored else ()))} if k < end)
        out, tail = self._done(key, order, generation, tail, fresh, stored)
        if out:
            at = out[-1][2] + 1
        if end is not None and not closed:
            at, closed, fresh = max(at, end), True, {}
            self.waiting.clear()
        for k, row in fresh.items():
            self.waiting.updateValue((k,), (json.dumps(row),))
        if closed and self.names is not None:
            self.names.clear()
        self.state.update((generation, at, tail, dropped, closed))
        if self.keep is not None or self.idle is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if (wait := self.keep if closed else self.idle) is not None:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(1000 * wait))
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        out = []
        if self.state.exists():
            generation, _, tail, _, closed = self.state.get()
            if not closed:
                out, _ = self._done(key, sorted(k for (k,) in self.waiting.keys()), generation, tail, {})
        self._forget()
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS)

    def close(self) -> None:
        pass


def json_corrector(generate: Callable[[str, str], str], most: int = prompts.MAX_CORRECTION_CHARS) -> Corrector:
    """A corrector made of a text generator: a prompt of at most ``most`` characters,
    an output that must be one JSON object with the one string corrected_text. All
    else raises, which leaves the text as it is."""

    def run(text: str, previous: str, terms: str = "") -> str:
        prompt = prompts.correction_py(text, previous, terms)
        if len(prompt) > most:
            raise ValueError("the passage is too long for one prompt")
        out = generate(prompts.CORRECTION_SYSTEM, prompt).strip().removeprefix("```json").removeprefix("```").removesuffix("```")
        made = json.loads(out)
        if not isinstance(made, dict) or list(made) != ["corrected_text"] or not isinstance(made["corrected_text"], str):
            raise ValueError("the output is not {corrected_text}")
        return made["corrected_text"]

    return run


def correct_tables(tables: DataFrame, corrector: Corrector) -> DataFrame:
    """tables (document_id, block_id, rows) with corrected cells: cells that hold
    letters are corrected one by one, and a change counts only if it is sound()."""

    def cell(text: str) -> str:
        if not any(map(str.isalpha, text or "")):
            return text
        try:
            new = corrector(text, "")
        except Exception:  # as with texts
            return text
        return new if sound(text, new) else text

    @F.pandas_udf("array<array<string>>")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda t: None if t is None else [[cell(c) for c in r] for r in t])

    return tables.withColumn("rows", run("rows"))


def correct(components: DataFrame, corrector: Corrector, labels: list[str] | None = None, glossary: bool = False, keep_seconds: float | None = None, idle_seconds: float | None = None) -> DataFrame:
    """Corrected components, each after the one before it. components: INPUT, a
    stream (with the RocksDB state store) or a batch. With ``glossary`` the corrector
    takes the known spellings as a third argument.

    In a stream that runs on (with them, one of the trigger availableNow does not end) a
    document's state ends ``keep_seconds`` after it is closed or ``idle_seconds`` after
    its last row, if these are given; a row of it that comes later begins a new document."""
    _ = components.sparkSession.streams  # a batch needs the coordinator of state stores, too
    timers = components.isStreaming and (keep_seconds is not None or idle_seconds is not None)
    made = OrderedCorrection(corrector, labels or LABELS, glossary, *((keep_seconds, idle_seconds) if timers else ()))
    return components.groupBy("document_id").transformWithStateInPandas(made, OUTPUT, "Append", "ProcessingTime" if timers else "None")


CLAIMS = "name string, sha256 string, event_id long, kind string"


class _Claims(StatefulProcessor):
    def __init__(self, lease_seconds: float | None):
        self.lease = lease_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "event_id long, done boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        holder, done = self.held.get() if self.held.exists() else (None, False)
        out = []
        for r in pd.concat(list(rows)).sort_values("event_id").itertuples(index=False):
            if r.kind == "claim":
                out.append((*key, int(r.event_id), holder is None))
                if holder is None:
                    holder, done = int(r.event_id), False
            elif r.kind == "failed":
                holder, done = None, False
            elif r.kind == "done" and holder is not None:
                done = True
        if holder is None:
            self.held.clear()
        else:
            self.held.update((holder, done))
        if self.lease is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if holder is not None and not done:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(1000 * self.lease))
        if out:
            yield pd.DataFrame(out, columns=["name", "sha256", "event_id", "accepted"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def upload_claims(events: DataFrame, lease_seconds: float | None = None) -> DataFrame:
    """name, sha256, event_id, accepted of each claim of a stream or batch of upload
    events (CLAIMS; kind: claim, done or failed, in order of event_id). A claim is accepted
    if nobody holds the file; a failure releases it. In a stream that runs on, a claim of
    which nothing is heard for ``lease_seconds``, if given, is released as well."""
    _ = events.sparkSession.streams
    timers = events.isStreaming and lease_seconds is not None
    made = _Claims(lease_seconds if timers else None)
    return events.groupBy("name", "sha256").transformWithStateInPandas(made, "name string, sha256 string, event_id long, accepted boolean", "Append", "ProcessingTime" if timers else "None")


def repeat_uploads(uploads: DataFrame, delay: str = "1 day") -> DataFrame:
    """Uploads (name, sha256, at) of a stream, each (name, sha256) once within the delay."""
    return uploads.withWatermark("at", delay).dropDuplicatesWithinWatermark(["name", "sha256"])


def ingest_stream(files: DataFrame, ingest: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True):
    """Run ingest on each micro-batch of new files; the size of a batch
    (maxFilesPerTrigger of the source) is the buffer between reading and ingesting."""
    w = files.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()
