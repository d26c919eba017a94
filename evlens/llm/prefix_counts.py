"""Exact token counts at every prefix of a text, by dynamic programming.

For a lower-casing BPE with word ends (a ``.json`` file of the tokenizers library), the
encoding of a prefix is the encoding of a shorter prefix plus one last token, and that
token is the only one whose pair with the token before it survives the merges. So the
counts of all prefixes of a word come from one pass over its characters. A text's table
holds, for each character, by how much the count changes there: the count of any prefix is
a running sum, and truncation and budget questions need no further encoding.

Table format: ``unit`` 1 or 4 (bytes a signed little-endian entry), one entry a character
of the original text. A prefix is the encoding of exactly those characters by themselves,
special strings included where they are complete.

Defined results: null or empty text -> 0 tokens and an empty table; rows are handled one by
one, so repeated rows, null keys and other columns don't matter; an empty table gives an
empty table. Texts are counted whole, whatever their length and normal form: the library only
normalises clusters (a character and those that may compose with it), and where the start of a
cluster normalises otherwise than the whole one, the programme goes on from the cluster's start
and back again. Memory is proportional to the text in hand.
"""

from __future__ import annotations

import bisect
import functools
import json
import os
import unicodedata
from array import array
from collections.abc import Iterator
from operator import sub

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .byte_bpe import byte_to_char
from .chunked import MEMO_CHARS, Memo
from .common import pieces
from .spans import kinds, put_together, text_buffer

# Unicode's White_Space characters, which the tokeniser's \s means.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
_SPLIT = regex.compile(f"([{WHITE}])")
_LETTER = regex.compile(r"\p{L}")
PAIRS_KEPT, WORDS_KEPT = 500_000, 400_000
FIT_BITS = 20
#: Before entries of four bytes; as an entry of one byte it would be -128, which isn't used.
WIDE = b"\x80"
#: From so many characters on, a piece is not counted anew for each start of a cluster.
LONG = 64


@functools.lru_cache(maxsize=1)
def _clusters() -> regex.Pattern:
    """Matches a character and all that may compose or change places with it: NFC never reaches beyond."""
    chars = [chr(k) for k in range(0x300, 0x20000)]  # the planes above have only starters that stand alone
    after = {chr(k) for k in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))} | {c for c in chars if unicodedata.combining(c)}
    pairs = [unicodedata.decomposition(c).split() for c in chars + [chr(k) for k in range(0x80, 0x300)]]
    after |= {chr(int(x[1], 16)) for x in pairs if len(x) == 2 and x[0][0] != "<"}
    after |= {c for c in chars if unicodedata.normalize("NFD", c)[0] in after}
    return regex.compile(f".[{''.join(sorted(after))}]*", regex.DOTALL)


class WordCounter:
    """Prefix counts of words under the merges of one tokeniser file."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.library = Tokenizer.from_file(path)
        self.end = model["end_of_word_suffix"]
        self._number([tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]])
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, self.specials)) or r"(?!)")
        self.chars = byte_to_char()
        self.pairs: dict[int, bool] = {}
        self.memo = Memo(400_000)
        self.words: dict[str, list[int]] = {}
        self.previous: tuple = ("", [-1], [0], [0])

    def _number(self, merges: list[tuple[str, str]]) -> None:
        """Number the tokens: single symbols first, then each merge in its rank's order.

        ``open`` and ``closed`` give the number of a token within and at the end of a word,
        ``parts`` the two numbers that a token was merged from (itself twice for a symbol).
        """
        symbols = [*byte_to_char().values()]
        names = symbols + [c + self.end for c in symbols]
        number = {name: i for i, name in enumerate(names)}
        self.parts = [(i, i) for i in range(len(names))]
        self.joined: dict[int, int] = {}
        for left, right in merges:
            pair = number[left], number[right]
            self.joined[pair[0] << 24 | pair[1]] = number.setdefault(left + right, len(self.parts))
            self.parts.append(pair)
        # Every end of a token: the numbers of the open and of the closed token it is, -1 for none.
        self.ends: dict[str, tuple[int, int]] = {}
        for name, i in number.items():
            if self.alone(i):
                closed = name.endswith(self.end) and name != self.end
                text = name[:-len(self.end)] if closed else name
                for k in range(len(text) - 1, 0, -1):
                    self.ends.setdefault(text[k:], (-1, -1))
                known = self.ends.get(text, (-1, -1))
                self.ends[text] = (known[0], i) if closed else (i, known[1])

        self._link()

    def _link(self) -> None:
        """The ends as a tree that grows to the left: sorted (node, byte) pairs and the nodes they lead to."""
        byte = {c: b for b, c in byte_to_char().items()}
        names = sorted((e for e in self.ends if all(c in byte for c in e)), key=len)
        node = {"": 0} | {name: k for k, name in enumerate(names, 1)}
        steps = np.array([node[name[1:]] << 8 | byte[name[0]] for name in names], dtype=np.int64)
        order = np.argsort(steps)
        self.steps, self.leads = np.append(steps[order], np.int64(1) << 62), np.append(order + 1, 0)
        self.tokens = np.array([(-1, -1), *(self.ends[name] for name in names)], dtype=np.int64).T.copy()
        self.fit_key, self.fit = np.full(1 << FIT_BITS, -1, dtype=np.int64), np.zeros(1 << FIT_BITS, dtype=bool)

    def _fits(self, left: np.ndarray, token: np.ndarray) -> np.ndarray:
        """``_stable`` of many pairs, kept in a table with one place a hash."""
        key = left << 24 | token
        with np.errstate(over="ignore"):
            at = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - FIT_BITS)).astype(np.int64)
        miss = np.flatnonzero(self.fit_key[at] != key)
        out = self.fit[at]
        if len(miss):
            fresh, turn = np.unique(key[miss], return_inverse=True)
            found = np.array([self._stable(k >> 24, k & 0xFFFFFF) for k in fresh.tolist()], dtype=bool)
            out[miss] = found[turn]
            self.fit_key[at[miss]], self.fit[at[miss]] = key[miss], found[turn]  # of several for a place the last stays
            clash = self.fit_key[at[miss]] != key[miss]
            self.fit_key[at[miss][clash]] = -1  # two arrays were written: keep no pair that may be mixed
        return out

    def fill_words(self, words: list[str]) -> None:
        """The programme for many pre-tokens at once: every step does one place of all words."""
        words.sort(key=len, reverse=True)
        data = [w.encode() for w in words]
        data, words = zip(*sorted(zip(data, words), key=lambda x: -len(x[0])))
        sizes = np.array([len(d) for d in data])
        n, longest = len(data), int(sizes[0])
        text = np.frombuffer(b"".join(d.ljust(longest, b"\0") for d in data), dtype=np.uint8).reshape(n, longest)
        last, count, ended = (np.full((longest + 1, n), v, dtype=np.int64) for v in (-1, 0, 0))
        for i in range(1, longest + 1):
            at = np.arange(np.searchsorted(-sizes, -i, side="right"))
            node = np.zeros(len(at), dtype=np.int64)
            for j in range(i - 1, -1, -1):
                step = node << 8 | text[at, j]
                k = np.searchsorted(self.steps, step)
                on = self.steps[k] == step
                at, node = at[on], self.leads[k[on]]
                if not len(at):
                    break
                left = last[j, at]
                for kind, have in enumerate((last[i] >= 0, ended[i] > 0)):
                    token = self.tokens[kind, node]
                    may = np.flatnonzero((token >= 0) & ~have[at])
                    bound = may[left[may] >= 0]
                    good = np.ones(len(at), dtype=bool)
                    good[bound] = self._fits(left[bound], token[bound])
                    may = may[good[may]]
                    if kind:
                        ended[i, at[may]] = count[j, at[may]] + 1
                    else:
                        last[i, at[may]], count[i, at[may]] = token[may], count[j, at[may]] + 1
                open_ = (last[i, at] < 0) | (ended[i, at] == 0)
                at, node = at[open_], node[open_]
        if len(self.words) + n > WORDS_KEPT:
            self.words.clear()
        rows = ended[1:].T.tolist()
        for word, size, row in zip(words, sizes.tolist(), rows):
            self.words[word] = row[:size] if size == len(word) else [row[i - 1] for i in np.cumsum([len(c.encode()) for c in word])]

    def unknown_words(self, chunks: list[str]) -> list[str]:
        """The pre-tokens of plain chunks that have no entry yet, long ones left out."""
        out = set()
        for chunk in chunks:
            lower = chunk.lower()
            if len(lower) == len(chunk):  # else it is taken apart later
                out.update((lower,) if lower.isascii() and lower.isalpha() else self.pattern.findall(lower))
        return [w for w in out if w not in self.words and len(w.encode()) <= MEMO_CHARS]

    def alone(self, token: int) -> bool:
        """Whether the token's own characters encode to just this token: at every merge that
        built it the two parts meet unmerged, as far as better merges go."""
        left, right = self.parts[token]
        return left == token or self.alone(left) and self.alone(right) and self._stable(left, right, token)

    def _stable(self, left: int, right: int, limit: int = 1 << 60) -> bool:
        """Whether no merge numbered below ``limit`` joins across the border of two tokens.

        Undoing the merges from the latest on, the border symbols at each moment are the
        parts next to it; a merge of those that comes before the last one undone would have won.
        """
        joined, parts = self.joined, self.parts
        while True:
            if joined.get(left << 24 | right, 1 << 60) < limit:
                return False
            inner_left, inner_right = parts[left][1], parts[right][0]
            if left > right and inner_left != left:
                limit, left = left, inner_left
            elif inner_right != right:
                limit, right = right + 1, inner_right
            elif inner_left != left:
                limit, left = left, inner_left
            else:
                return True

    def _fill(self, s: str, same: int, last: list[int], count: list[int], ended: list[int]) -> None:
        """The programme's entries after ``same`` for the symbols of one pre-token."""
        n, ends, pairs, stable = len(s), self.ends.get, self.pairs, self._stable
        if len(pairs) >= PAIRS_KEPT:
            pairs.clear()
        for i in range(same + 1, n + 1):
            j = i - 1
            while j >= 0 and (found := ends(s[j:i])) is not None:
                for kind, token in enumerate(found):
                    if token < 0 or (ended[i] if kind else last[i] >= 0):
                        continue
                    left = last[j]
                    if left >= 0:
                        fits = pairs.get(key := left << 24 | token)
                        if fits is None:
                            fits = pairs[key] = stable(left, token)
                        if not fits:
                            continue
                    if kind:
                        ended[i] = count[j] + 1
                    else:
                        last[i], count[i] = token, count[j] + 1
                if ended[i] and last[i] >= 0:
                    break
                j -= 1

    def word(self, piece: str) -> list[int]:
        """Token count of each prefix (by character) of one pre-token, each ended by the word end."""
        known = self.words.get(piece)
        if known is not None:
            return known
        s = piece if piece.isalpha() and piece.isascii() else "".join(map(self.chars.__getitem__, piece.encode()))
        n = len(s)
        before, last, count, ended = self.previous  # what the last word has in common with this one is known
        same, most = 0, min(n, len(before))
        while same < most and before[same] == s[same]:
            same += 1
        last, count, ended = (x[:same + 1] + [v] * (n - same) for x, v in ((last, -1), (count, 0), (ended, 0)))
        self._fill(s, same, last, count, ended)
        self.previous = s, last, count, ended
        out = ended[1:] if n == len(piece) else [ended[i] for i in np.cumsum([len(c.encode()) for c in piece])]
        if len(self.words) >= WORDS_KEPT:
            self.words.clear()
        if len(piece) <= MEMO_CHARS:
            self.words[piece] = out
        return out

    def plain(self, chunk: str) -> list[int]:
        """Counts of each prefix of a run of non-space characters without special strings."""
        lower = chunk.lower() if chunk.isascii() else "".join(map(str.lower, chunk))  # by character: no final sigma
        if len(lower) != len(chunk) or not unicodedata.is_normalized("NFC", chunk):
            return self.aligned(chunk)
        return self.normal(lower)

    def normal(self, lower: str) -> list[int]:
        """Counts of each prefix of a normalised run of non-space characters."""
        if lower.isascii() and lower.isalpha():
            return self.word(lower)
        out: list[int] = []
        base = 0
        for m in self.pattern.finditer(lower):
            piece = m[0]
            counts = self.word(piece)
            if piece[0] == "'" and len(piece) == 3 and piece[1].isalpha():  # a part of 're, 've or 'll is a quote and a letter
                counts[1] = counts[0] + self.word(piece[1])[0]
            out += [base + c for c in counts]
            base += counts[-1]
        return out

    def aligned(self, chunk: str) -> list[int]:
        """Counts of each prefix of a run whose characters don't normalise one by one."""
        normalise = self.library.normalizer.normalize_str
        clusters = _clusters().findall(chunk)
        parts = [c.lower() if c.isascii() else normalise(c) for c in clusters]
        text = "".join(parts)
        counts, tails = self.normal(text), None
        out: list[int] = []
        at = 0
        for cluster, part in zip(clusters, parts):
            for k in range(1, len(cluster)):
                start = normalise(cluster[:k])
                if part.startswith(start):
                    out.append(counts[at + len(start) - 1])
                else:
                    tails = tails or Tails(self, text, counts)
                    out.append(tails.count(at, start))
            at += len(part)
            out.append(counts[at - 1])
        return out

    def run(self, chunk: str) -> list[int]:
        """Counts of each prefix of a run of non-space characters."""
        if not any(x in chunk for x in self.specials):
            return self.plain(chunk)
        out: list[int] = []
        base = at = 0
        for m in self.special.finditer(chunk):
            counts = self.plain(chunk[at:m.end() - 1])
            out += [base + c for c in counts]
            base += (counts[m.start() - at - 1] if m.start() > at else 0) + 1
            out.append(base)
            at = m.end()
        if at < len(chunk):
            out += [base + c for c in self.plain(chunk[at:])]
        return out

    def deltas(self, chunk: str) -> list[int]:
        """Change of the count at each character of any text."""
        out: list[int] = []
        for part in _SPLIT.split(chunk):
            if part in WHITE and part:
                out.append(0)
            elif part:
                counts = self.run(part)
                out += map(sub, counts, [0, *counts[:-1]])
        return out

    def _narrow(self, chunks: list[bytes]) -> list[bytes]:
        """The changes of each chunk in a byte each, or, behind a mark, in four."""
        texts = [c.decode() for c in chunks]
        if fresh := self.unknown_words(texts):
            self.fill_words(fresh)
        found = map(self.deltas, texts)
        return [WIDE + np.array(d, dtype="<i4").tobytes() if d and (min(d) < -127 or max(d) > 127) else array("b", d).tobytes()
                for d in found]

    def tables(self, texts: list[str] | pa.Array) -> list[tuple[int, bytes]]:
        """(unit, table) of each text."""
        raw, offsets = text_buffer(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
        size, n = int(offsets[-1]), len(offsets) - 1
        # Runs between spaces; a text's start begins one as well. Spaces themselves change nothing.
        inside = raw[:size] != 0x20
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        at = offsets[:-1][offsets[:-1] < size]
        first[at] = inside[at]
        start = np.flatnonzero(first)
        stop = np.concatenate((np.flatnonzero(~inside), offsets[1:]))
        stop.sort()
        length = stop[np.searchsorted(stop, start, side="right")] - start if len(start) else start
        of, kind = kinds(raw, start, length)
        data = raw[:size].tobytes()
        keys = [data[a:b] for a, b in zip(start[of].tolist(), (start[of] + length[of]).tolist())]
        found = self.memo.look_up(keys, self._narrow)
        wide = np.array([x[:1] == WIDE for x in found], dtype=bool)
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        sizes[wide] = 0
        values, _ = put_together(np.frombuffer(b"".join(x for x, w in zip(found, wide.tolist()) if not w), dtype=np.int8), sizes, kind)
        # A run's entries go where its characters stand among all characters of the slice.
        starts_char = (raw[:size] & 0xC0) != 0x80
        chars = np.concatenate(([0], np.cumsum(starts_char)))
        table = np.zeros(int(chars[-1]), dtype=np.int8)
        table[_places(chars[start], sizes[kind])] = values
        ends = chars[offsets]
        out = [(1, table[a:b].tobytes()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        if wide.any():
            runs_before = np.searchsorted(start, offsets)
            for k in np.flatnonzero(np.add.reduceat(np.append(wide[kind], False), np.minimum(runs_before[:-1], len(kind)))
                                    * (np.diff(runs_before) > 0)).tolist():
                entries = table[ends[k]:ends[k + 1]].astype("<i4")
                for r in range(runs_before[k], runs_before[k + 1]):
                    if wide[kind[r]]:
                        x = np.frombuffer(found[kind[r]][1:], dtype="<i4")
                        lo = chars[start[r]] - ends[k]
                        entries[lo:lo + len(x)] = x
                out[k] = (4, entries.tobytes())
        return out


def _places(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of runs that begin at ``first``."""
    ends = np.cumsum(sizes)
    return np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Tails:
    """Token counts of a normalised run up to some place, followed by other characters."""

    def __init__(self, counter: WordCounter, text: str, counts: list[int]) -> None:
        self.counter, self.text, self.counts = counter, text, counts
        self.starts = [m.start() for m in counter.pattern.finditer(text)]
        self.longest = max(map(len, counter.ends))
        self.piece = -1  # the long piece whose programme is at hand

    def whole(self, text: str) -> int:
        return sum(self.counter.word(m[0])[-1] for m in self.counter.pattern.finditer(text))

    def count(self, at: int, tail: str) -> int:
        """Tokens of the first ``at`` characters and ``tail``."""
        if not at:
            return self.whole(tail)
        k = bisect.bisect_left(self.starts, at) - 1  # the piece of the last character
        first = self.starts[k]
        if at - first <= LONG:
            if k and self.text[self.starts[k - 1]:first] == "'":  # a quote may be a part of 're with what follows
                first = self.starts[k - 1]
            return (self.counts[first - 1] if first else 0) + self.whole(self.text[first:at] + tail)
        # A long piece is a run of letters or of other characters: any of its kind stands for it.
        more = self.counter.pattern.match(("a" if _LETTER.match(self.text[at - 1]) else "!") + tail)[0][1:]
        if not more:
            return self.counts[at - 1] + self.whole(tail)
        return (self.counts[first - 1] if first else 0) + self._grown(k, at, more) + self.whole(tail[len(more):])

    def _grown(self, k: int, at: int, more: str) -> int:
        """Tokens of the k-th piece up to ``at`` and the characters ``more``, as one piece."""
        symbols = lambda x: "".join(map(self.counter.chars.__getitem__, x.encode()))
        first = self.starts[k]
        if self.piece != k:
            s = symbols(self.text[first:self.starts[k + 1] if k + 1 < len(self.starts) else len(self.text)])
            self.piece, self.symbols, self.table = k, s, ([-1] * (len(s) + 1), [0] * (len(s) + 1), [0] * (len(s) + 1))
            self.counter._fill(s, 0, *self.table)
        there, new = len(self.text[first:at].encode()), symbols(more)
        low = max(0, there - self.longest)  # no token reaches further back
        last, count, ended = (x[low:there + 1] + [v] * len(new) for x, v in zip(self.table, (-1, 0, 0)))
        self.counter._fill(self.symbols[low:there] + new, there - low, last, count, ended)
        return ended[-1]


@functools.lru_cache(maxsize=2)
def _counter(path: str) -> WordCounter:
    return WordCounter(path)


def changes(unit: int, table: bytes) -> np.ndarray:
    return np.frombuffer(table, dtype="i1" if unit == 1 else "<i4")


def count_at(unit: int, table: bytes, chars: int) -> int:
    """Tokens of the text's first ``chars`` characters."""
    return int(changes(unit, table)[:chars].sum(dtype=np.int64))


def longest_within(unit: int, table: bytes, budget: int) -> int:
    """The longest prefix, in characters, whose count is at most ``budget``."""
    counts = np.cumsum(changes(unit, table), dtype=np.int64)
    fitting = np.flatnonzero(counts <= budget)
    return int(fitting[-1]) + 1 if len(fitting) else 0


def prefix_tables(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes, unit and prefix_table of each text."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()),
                           T.StructField("unit", T.IntegerType()), T.StructField("prefix_table", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            for part in pieces(batch, 1, 2 << 20):
                units, tables = zip(*counter.tables(part.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pc.fill_null(pc.binary_length(part.column(1)), 0).cast(pa.int64()),
                     pa.array(units, pa.int32()), pa.array(tables, pa.binary())], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def answer(tables: DataFrame, budget: int, id_col: str = "doc_id") -> DataFrame:
    """From the stored tables alone: n_tokens, and the longest prefix (characters) within ``budget``."""
    schema = T.StructType([tables.schema[id_col], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()),
                           T.StructField("chars_within", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([count_at(u, t, len(t)) for u, t in rows], pa.int64()),
                 pa.array([longest_within(u, t, budget) for u, t in rows], pa.int64())], names=schema.names)

    return tables.select(F.col(id_col), "n_bytes", "unit", "prefix_table").mapInArrow(run, schema)
