"""Short license notices in texts, exact or with a few edits.

A text is lower-cased (A-Z) and reduced to its words, one space between them. A notice of n
characters may differ by up to ``edits`` characters (inserted, deleted or replaced). Cut into
edits + 1 pieces, at least one piece of every such occurrence is intact (pigeonhole): exact search
for the pieces over whole Arrow buffers names all candidate places. Around each, the regex
library looks for the best match within the bound, from word start to word end, and gives
its span and number of edits. Repeated surroundings are verified once (bounded memo).

Base notices are counted at all places where their words stand consecutively: each candidate of
the first piece is compared with the whole phrase.

Defined results: a null text has no words; an empty or wordless text has no place and score 0;
first and last word are null without a base place; words never join across documents; a
row is scanned by itself, so repeated rows, null ids and ties need no rule; an empty table gives an
empty table. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces


@dataclass(frozen=True)
class Notice:
    """A phrase in lower-case words; ``exact`` words at its start admit no edit."""
    label: str
    phrase: str
    edits: int
    exact: str = ""
    base: bool = False

    def cuts(self) -> list[tuple[int, bytes]]:
        """(offset, piece): edits + 1 pieces of nearly equal length."""
        n, k = len(self.phrase), self.edits + 1
        at = [n * i // k for i in range(k + 1)]
        return [(a, self.phrase[a:b].encode()) for a, b in zip(at, at[1:])]

    def pattern(self) -> regex.Pattern:
        """Matches between two spaces, so from word start to word end."""
        rest = regex.escape(self.phrase[len(self.exact):], literal_spaces=True)
        return regex.compile(f"(?b)(?<= ){regex.escape(self.exact, literal_spaces=True)}(?:{rest}){{e<={self.edits}}}(?= )")


# The base phrases and labels of the contract.
BASE = (Notice("mit", "mit license", 1, exact="mit ", base=True), Notice("apache", "apache license", 1, base=True),
        Notice("gpl", "general public license", 2, base=True))
# Opening words of widely used notices.
MORE = (Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 5),
        Notice("apache", "licensed under the apache license version", 3),
        Notice("bsd", "redistribution and use in source and binary forms", 4),
        Notice("bsd", "bsd license", 1, exact="bsd "),
        Notice("gpl", "you can redistribute it and or modify it under the terms of the gnu", 5),
        Notice("mpl", "mozilla public license", 2),
        Notice("isc", "permission to use copy modify and or distribute this software for any purpose", 5),
        Notice("cc", "creative commons attribution", 2),
        Notice("reserved", "all rights reserved", 1))
NOTICES = BASE + MORE

_KEPT = np.full(256, 0x20, dtype=np.uint8)
for _low, _high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
    _KEPT[_low:_high + 1] = np.arange(_low, _high + 1)
_KEPT[0x41:0x5B] = np.arange(0x61, 0x7B)

#: Verified surroundings kept in a worker, and the longest of them.
MEMO_ENTRIES, MEMO_BYTES = 100_000, 400


def normalised(texts: pa.Array) -> tuple[bytes, np.ndarray]:
    """The words of all texts, each followed by a space, each text by a line feed; where each text starts."""
    n = len(texts)
    filled = pc.fill_null(texts, "")
    sizes = pc.binary_length(filled).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), filled.cast(pa.string())), "\n")[0]
    # One separator more, so that the last text ends like the others.
    raw = np.empty(int(sizes.sum()) + n, dtype=np.uint8)
    raw[:-1] = np.frombuffer(joined.as_buffer(), dtype=np.uint8)
    ends = np.cumsum(sizes + 1) - 1
    low = _KEPT[raw]
    low[ends] = 0x20
    word = low != 0x20
    # A separator stays if a word byte stands before it; the end of a text stays in any case.
    keep = word.copy()
    keep[1:] |= word[:-1]
    out_at = np.cumsum(keep)
    out = low[keep]
    start_of_next = out_at[ends]  # words and spaces up to the end of each text
    flat = np.insert(out, start_of_next, 0x0A)
    starts = np.concatenate(([0], start_of_next + np.arange(1, n + 1)))
    return flat.tobytes(), starts


def found_at(data: bytes, piece: bytes) -> Iterator[int]:
    at = data.find(piece)
    while at >= 0:
        yield at
        at = data.find(piece, at + 1)


class Scanner:
    """Finds notices in normalised texts."""

    def __init__(self, notices: tuple[Notice, ...]) -> None:
        self.notices = notices
        self.patterns = [n.pattern() for n in notices]
        self.memo: dict[tuple[int, bytes], tuple[int, int, int] | None] = {}
        self.seeds: dict[bytes, list[tuple[int, int]]] = {}
        for k, notice in enumerate(notices):
            for offset, piece in notice.cuts():
                self.seeds.setdefault(piece, []).append((k, offset))

    def verify(self, k: int, window: bytes) -> tuple[int, int, int] | None:
        """(first byte, end byte, edits) of the best match within a window; memo by its bytes."""
        key = (k, window)
        if key in self.memo:
            return self.memo[key]
        lost = 0  # bytes of a character that is cut at the front
        while lost < len(window) and 0x80 <= window[lost] < 0xC0:
            lost += 1
        text = window[lost:].decode("utf-8", "ignore")
        m = self.patterns[k].search(text)
        hit = m and (lost + len(text[:m.start()].encode()), lost + len(text[:m.end()].encode()), sum(m.fuzzy_counts))
        if len(window) <= MEMO_BYTES:
            if len(self.memo) >= MEMO_ENTRIES:
                self.memo.clear()
            self.memo[key] = hit
        return hit

    def scan(self, data: bytes, starts: np.ndarray) -> tuple[list, list]:
        """Base places (notice, place) and fuzzy matches (notice, first byte, end byte, edits)."""
        base, near = set(), set()
        for piece, owners in self.seeds.items():
            for at in found_at(data, piece):
                doc = int(np.searchsorted(starts, at, side="right")) - 1
                lo_doc, hi_doc = int(starts[doc]), int(starts[doc + 1]) - 1
                for k, offset in owners:
                    notice, at0 = self.notices[k], at - offset
                    phrase = notice.phrase.encode()
                    if notice.base and not offset and data.startswith(phrase + b" ", at) and (
                            at == lo_doc or data[at - 1] == 0x20):
                        base.add((k, at0))
                        near.add((k, at0, at0 + len(phrase), 0))
                        continue
                    # An edit may be a character of four bytes; one more on either side shows the word's edge.
                    lo = max(lo_doc, at0 - 4 * notice.edits - 1)
                    hi = min(hi_doc, at0 + len(phrase) + 4 * notice.edits + 1)
                    front = b" " if lo == lo_doc or data[lo - 1] == 0x20 else b""
                    hit = self.verify(k, front + data[lo:hi])
                    if hit:
                        near.add((k, lo + hit[0] - len(front), lo + hit[1] - len(front), hit[2]))
        return sorted(base), sorted(near)


SPAN = "struct<label:string,first_word:long,last_word:long,edits:long,score:double>"
FOUND = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
         f"spans array<{SPAN}>")


def scan_texts(scanner: Scanner, texts: pa.Array) -> list[dict]:
    data, starts = normalised(texts)
    spaces = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 0x20)
    before = np.searchsorted(spaces, starts)  # words before each text
    base, near = scanner.scan(data, starts)
    rows = [{"n_words": int(w), "n_base": 0, "first_word": None, "last_word": None, "base_labels": set(), "labels": set(),
             "score": 0.0, "spans": []} for w in np.diff(before)]

    def place(at: int) -> tuple[int, int]:
        doc = int(np.searchsorted(starts, at, side="right")) - 1
        return doc, int(np.searchsorted(spaces, at) - before[doc])

    for k, at in base:
        doc, word = place(at)
        row = rows[doc]
        row["n_base"] += 1
        row["first_word"] = word if row["first_word"] is None else min(word, row["first_word"])
        row["last_word"] = word if row["last_word"] is None else max(word, row["last_word"])
        row["base_labels"].add(scanner.notices[k].label)
    for k, at, end, edits in near:
        (doc, word), (_, last), notice = place(at), place(end - 1), scanner.notices[k]
        row, score = rows[doc], 1.0 - edits / len(notice.phrase)
        row["labels"].add(notice.label)
        row["score"] = max(row["score"], score)
        row["spans"].append({"label": notice.label, "first_word": word, "last_word": last, "edits": edits, "score": score})
    for row in rows:
        row["base_labels"], row["labels"] = ",".join(sorted(row["base_labels"])), ",".join(sorted(row["labels"]))
        row["spans"].sort(key=lambda s: (s["first_word"], s["last_word"], s["label"], s["edits"]))
    return rows


def scan_licenses(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Every document's id, number of words, base places, labels, score and spans of notices."""
    rows = docs.select(F.col(id_col).alias("_ev_id"), F.col(text_col).cast("string").alias("_ev_body"))
    schema = f"_ev_id {rows.schema[0].dataType.simpleString()}, {FOUND}"
    found = pa.struct([
        ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
        ("spans", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                                      ("edits", pa.int64()), ("score", pa.float64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices)
        for batch in batches:
            for part in pieces(batch, 1, 4 << 20):
                got = pa.array(scan_texts(scanner, part.column(1)), type=found)
                yield pa.RecordBatch.from_arrays([part.column(0), *got.flatten()], names=["_ev_id", *found.names])

    return rows.mapInArrow(run, schema).withColumnRenamed("_ev_id", id_col)
