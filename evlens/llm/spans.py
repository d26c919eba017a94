"""Equal spans of bytes in one buffer, by a vectorised open-addressing hash table.

Every hit is verified byte by byte, so the result is exact whatever the hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import mix

#: Spans up to this many bytes go through the table.
LONGEST = 64


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: empty), eight more at the end, and where each text starts; one place more."""
    texts = pc.fill_null(texts, "")
    width = np.int32 if pa.types.is_string(texts.type) else np.int64
    offsets = np.frombuffer(texts.buffers()[1], dtype=width)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    size = int(offsets[-1] - offsets[0])
    raw = np.zeros(size + 8, dtype=np.uint8)
    if size:
        raw[:size] = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]]
    return raw, offsets - offsets[0]


def eight_bytes(raw: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Up to eight bytes from each place as a number; ``raw`` has eight bytes to spare at its end."""
    view = np.ndarray((len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))
    cut = (8 * np.clip(8 - left, 0, 7)).astype(np.uint64)
    return view[at] << cut


def span_hash(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    out = mix(eight_bytes(raw, start, size) ^ size.astype(np.uint64))
    more = np.flatnonzero(size > 8)
    step = 8
    while len(more):
        out[more] = mix(out[more] * np.uint64(0x9E3779B97F4A7C15) + eight_bytes(raw, start[more] + step, size[more] - step))
        step += 8
        more = more[size[more] > step]
    return out


def spans_equal(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the spans of ``size`` bytes at a and b hold the same bytes."""
    same = eight_bytes(raw, a, size) == eight_bytes(raw, b, size)
    more = np.flatnonzero(same & (size > 8))
    step = 8
    while len(more):
        left = size[more] - step
        equal = eight_bytes(raw, a[more] + step, left) == eight_bytes(raw, b[more] + step, left)
        same[more[~equal]] = False
        step += 8
        more = more[equal & (left > 8)]
    return same


def holders(raw: np.ndarray, group: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each span the number of the one that stands for its (group, bytes); that one's own number for itself."""
    out = np.arange(len(start))
    room = 1 << max(4, int(2 * len(start)).bit_length())
    table = np.full(room, -1, dtype=np.int64)
    with np.errstate(over="ignore"):
        place = (mix(span_hash(raw, start, size) + group.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
                 & np.uint64(room - 1)).astype(np.int64)
    waiting = np.arange(len(start))
    while len(waiting):
        at = place[waiting]
        free = table[at] < 0
        table[at[free]] = waiting[free]  # of several, the last one written holds the place
        holder = table[at]
        alike = (group[holder] == group[waiting]) & (size[holder] == size[waiting])
        check = np.flatnonzero(alike & (holder != waiting))
        alike[check] = spans_equal(raw, start[holder[check]], start[waiting[check]], size[waiting[check]])
        out[waiting[alike]] = holder[alike]  # its own place included
        waiting = waiting[~alike]
        place[waiting] = (place[waiting] + 1) & (room - 1)
    return out


def kinds(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of spans that stand for each kind of bytes, and each span's kind. Long spans are kinds of their own."""
    holder = np.arange(len(start))
    short = np.flatnonzero(size <= LONGEST)
    holder[short] = short[holders(raw, np.zeros(len(short), dtype=np.int64), start[short], size[short])]
    own = holder == np.arange(len(start))
    return np.flatnonzero(own), (np.cumsum(own) - 1)[holder]


def put_together(values: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``values`` (one after the other, of ``sizes``) in another order, with repeats; and their ends."""
    first = np.cumsum(sizes) - sizes
    n = sizes[order]
    ends = np.cumsum(n)
    return values[np.repeat(first[order] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)], ends
