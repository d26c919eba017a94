"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The ranks of a ``.tiktoken`` file become a BPE model of the tokenizers library: every byte
is written as one printable character (``byte_to_char``), every pair of tokens whose bytes
joined are a token becomes a merge of that token's rank. Decoding reads each token's
characters back to bytes and joins them before any UTF-8 decoding, so a character that is
split over several tokens comes out whole.

Defined results: null or empty text -> no ids, empty bytes; ids that are null -> empty
bytes; rows are handled one by one, so repeated rows, null keys and other columns don't
matter; an empty table gives an empty table. A text of any length is encoded whole.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from .chunked import ChunkEncoder
from .common import pieces, tidy


def byte_to_char() -> dict[int, str]:
    """Printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def bpe_tokenizer(path: str, pattern: str) -> Tokenizer:
    """The tokenizers form of a rank file; ``pattern`` splits the text before the merges."""
    ranks, chars = read_ranks(path), byte_to_char()
    name = {token: "".join(map(chars.__getitem__, token)) for token in ranks}
    merges = [(rank, -cut, name[token[:cut]], name[token[cut:]])
              for token, rank in ranks.items()
              for cut in range(1, len(token)) if token[:cut] in ranks and token[cut:] in ranks]
    merges.sort(key=lambda m: m[:2])
    tok = Tokenizer(models.BPE(vocab={name[t]: r for t, r in ranks.items()},
                               merges=[m[2:] for m in merges], ignore_merges=True))
    tok.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tok


@functools.lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> ChunkEncoder:
    """One per Python worker, so that its memo serves all tasks of that worker."""
    return ChunkEncoder(bpe_tokenizer(path, pattern), "<i4", memo_entries=75_000)


@functools.lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id: the tokenizers names read back through the reversed byte table."""
    back = {c: b for b, c in byte_to_char().items()}
    chars = byte_to_char()
    names = {r: "".join(map(chars.__getitem__, t)) for t, r in read_ranks(path).items()}
    return [bytes(map(back.__getitem__, names[i])) if i in names else b"" for i in range(max(names) + 1)]


def char_offsets(text: str, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and end (exclusive) of each token, from the tokens' byte lengths.

    A token that holds only a part of a character spans that whole character.
    """
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80, dtype=np.int32) - 1
    end = np.cumsum(lengths)
    return char[end - lengths], char[end - 1] + 1


def _int_lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.empty(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32, copy=False)))


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
                     text_col: str = "text", with_offsets: bool = True, with_decoded: bool = False) -> DataFrame:
    """``id_col``, n_tokens, ids and, as asked for, each token's char_start and char_end, and
    ``decoded``: the bytes that the ids give again, as ``decode_documents`` has them."""
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()),
              T.StructField("ids", T.ArrayType(T.IntegerType(), False))]
    if with_offsets:
        fields += [T.StructField(n, T.ArrayType(T.IntegerType(), False)) for n in ("char_start", "char_end")]
    if with_decoded:
        fields += [T.StructField("decoded", T.BinaryType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        sizes = np.array([len(b) for b in token_bytes(path)], dtype=np.int64)
        for batch in batches:
            for part in pieces(batch, 1, 1 << 20):
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = [np.frombuffer(x, dtype="<i4") for x in encoder.encode(texts)]
                cols = [part.column(0), pa.array([len(x) for x in ids], pa.int64()), _int_lists(ids)]
                if with_offsets:
                    spans = [char_offsets(t, sizes[x]) for t, x in zip(texts, ids)]
                    cols += [_int_lists([s[k] for s in spans]) for k in (0, 1)]
                if with_decoded:
                    cols.append(pa.array([decode(x, token_bytes(path)) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return docs.select(id_col, text_col).mapInArrow(tidy(run), T.StructType(fields))


def decode(ids: np.ndarray, table: list[bytes]) -> bytes:
    """The bytes of a sequence of ids; joined before any character is read, so split ones are whole."""
    if len(ids) and (ids.min() < 0 or ids.max() >= len(table)):
        raise ValueError("an id outside the vocabulary")
    return b"".join(map(table.__getitem__, ids.tolist()))


def decode_documents(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """All columns of ``encoded`` and ``decoded``: the bytes that the ids stand for.

    Unknown ids (negative or beyond the vocabulary) raise an error.
    """
    at = encoded.columns.index(ids_col)
    schema = T.StructType(encoded.schema.fields + [T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path)
        for batch in batches:
            out = []
            for ids in batch.column(at):
                out.append(decode(ids.values.to_numpy() if ids.is_valid else np.empty(0, dtype=np.int32), table))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=schema.names)

    return encoded.mapInArrow(tidy(run), schema)
