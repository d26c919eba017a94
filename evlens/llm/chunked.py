"""Whole texts through a byte-level BPE of the tokenizers library, each distinct chunk once.

The patterns of these tokenisers never match across a space that stands before a
non-space character, except as the first character of a match, nor from an ASCII letter to
an ASCII character that is neither letter, digit nor apostrophe: a text may be cut at
these places and the ids of its chunks joined. Natural text repeats its chunks: the
equal ones of a slice are found together (``spans``), and a bounded memo of chunk -> ids
saves most of the library's work. Neither changes a result.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from .spans import kinds, put_together, text_buffer

#: Bytes before which a space is a cut: visible ASCII and the first bytes of longer characters, but for
#: those that begin one of Unicode's further spaces (a cut left out only makes a chunk longer).
_AFTER_CUT = np.zeros(256, dtype=bool)
_AFTER_CUT[0x21:0x7F] = _AFTER_CUT[0xC3:0xF5] = True
_AFTER_CUT[[0xE1, 0xE2, 0xE3]] = False
_LETTER, _BEHIND = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_BEHIND[0x21:0x7F] = True
_BEHIND[0x30:0x3A] = _BEHIND[0x41:0x5B] = _BEHIND[0x61:0x7B] = _BEHIND[0x27] = False
_BEHIND[[0x09, 0x0A, 0x0D]] = True
#: Chunks kept in each of the memo's two generations, and the longest chunk that is kept.
MEMO_ENTRIES, MEMO_CHARS = 400_000, 48


class Memo:
    """A bounded dictionary: when the young generation is full it becomes the old one, and
    what is then asked for again moves back, so that frequent entries stay."""

    def __init__(self, entries: int = MEMO_ENTRIES) -> None:
        self.entries, self.young, self.old = entries, {}, {}

    def look_up(self, keys: list, make) -> list:
        """The value of every key; ``make`` gives the values of the unknown ones."""
        found = list(map(self.young.get, keys))
        gaps = [i for i, v in enumerate(found) if v is None]
        if not gaps:
            return found
        old = self.old.get
        for i in gaps:
            found[i] = old(keys[i])
        fresh = [i for i in gaps if found[i] is None]
        for i, value in zip(fresh, make([keys[i] for i in fresh]) if fresh else []):
            found[i] = value
        keep = [i for i in gaps if len(keys[i]) <= MEMO_CHARS]
        if len(self.young) + len(keep) > self.entries:
            self.old, self.young = self.young, {}
        if len(keep) <= self.entries:
            self.young.update((keys[i], found[i]) for i in keep)
        return found


class ChunkEncoder:
    def __init__(self, tokenizer, dtype: str, memo_entries: int = MEMO_ENTRIES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        self.tokenizer, self.dtype, self.memo = tokenizer, np.dtype(dtype), Memo(memo_entries)

    def _encode(self, chunks: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)
        return [np.array(x.ids, dtype=self.dtype).tobytes() for x in found]

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty), one text after the other, and where each text's ids end."""
        raw, offsets = text_buffer(texts)
        size = int(offsets[-1])
        if not size:
            return np.empty(0, dtype=self.dtype), np.zeros(len(texts), dtype=np.int64)
        starts = np.zeros(size, dtype=bool)
        starts[:-1] = (raw[:size - 1] == 0x20) & _AFTER_CUT[raw[1:size]]
        starts[offsets[1:-1][offsets[1:-1] > 0] - 1] = False  # the last byte of a text is no cut
        starts[1:] |= _LETTER[raw[:size - 1]] & _BEHIND[raw[1:size]]
        starts[offsets[:-1][offsets[:-1] < size]] = True
        start = np.flatnonzero(starts)
        length = np.diff(start, append=size)
        of, kind = kinds(raw, start, length)
        data = raw[:size].tobytes()
        keys = [data[a:b] for a, b in zip(start[of].tolist(), (start[of] + length[of]).tolist())]
        found = self.memo.look_up(keys, self._encode)
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // self.dtype.itemsize
        ids, ends = put_together(np.frombuffer(b"".join(found), dtype=self.dtype), sizes, kind)
        chunks_before = np.searchsorted(start, offsets[1:])
        return ids, np.concatenate(([0], ends))[chunks_before]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian bytes of ``dtype``."""
        ids, ends = self.encode_array(pa.array(texts, pa.large_string()))
        return [x.tobytes() for x in np.split(ids, ends[:-1])] if len(texts) else []
