"""How the filters of a corpus interact: what each removes in every order.

One pass over a text's bytes gives its statistics. A byte transducer with two states (outside
and inside a word) is driven by a table: ``EMIT[state, byte]`` names what a byte
begins or is (word, word's end, capital, code point, symbol). The state after a byte depends on
that byte alone, so the pass runs over whole Arrow buffers at once: the state before a byte is
the table's entry for the byte before it, or "outside" at the start of a text. The word spans go
into an open-addressing hash table in which every hit is verified byte by byte, so counts of
distinct words are exact.

A document then is a set of failed filters. Documents are counted by part, set and labels
(pre-aggregated before every shuffle); everything that the orders ask for follows from those
few counts: what filter f removes after the filters S depends on (S, f) only, so 80
numbers a part serve all 120 orders. Equal texts meet by their SHA-256 digest, counted by part
and labels before they meet, so a group of copies of any size is a few rows.

Defined results: a null text is the empty text (no words: it fails A alone, B and C compare 0
with 0); a null part is the empty string; a row without an id matches no label, isn't a copy of
any other and makes none a copy; rows that share an id and a text are not copies of
each other; a document counts as good or toxic if any of its label rows says so; repeated rows
count each; an empty table gives an empty table. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, stored
from .spans import LONGEST, holders, text_buffer

#: What a byte emits, by the state before it.
WORD, END, CAPITAL, POINT, SYMBOL = 1, 2, 4, 8, 16
SYMBOLS = b"#$%&*|"
_IN_WORD = np.ones(256, dtype=np.uint8)
_IN_WORD[[0x20, *range(0x09, 0x0E)]] = 0


def _emit_table() -> np.ndarray:
    out = np.zeros((2, 256), dtype=np.uint8)
    out[0, _IN_WORD == 1] |= WORD
    out[1, _IN_WORD == 0] |= END
    out[:, ord("A"):ord("Z") + 1] |= CAPITAL
    out[:, list(SYMBOLS)] |= SYMBOL
    point = np.ones(256, dtype=bool)
    point[0x80:0xC0] = False  # continuation bytes
    out[:, point] |= POINT
    return out


EMIT = _emit_table()


def text_statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """words, distinct, capitals, points (long) and symbols (bool) of each text."""
    raw, offsets = text_buffer(texts)
    size = int(offsets[-1])
    # The state before each byte, and after the last: a text starts outside a word.
    state = np.zeros(size + 1, dtype=np.uint8)
    state[1:] = _IN_WORD[raw[:size]]
    ends_inside = state[offsets[1:]] & (offsets[1:] > offsets[:-1])
    state[offsets] = 0
    out = EMIT.reshape(-1)[(state[:size].astype(np.int16) << 8) | raw[:size]]

    def per_text(flag: int) -> np.ndarray:
        return np.diff(np.searchsorted(np.flatnonzero(out & flag), offsets))

    start = np.flatnonzero(out & WORD)
    words = np.diff(np.searchsorted(start, offsets))
    doc = np.repeat(np.arange(len(texts)), words)
    # A word ends at the separator after it, or with its text.
    end = np.sort(np.concatenate([np.flatnonzero(out & END), offsets[1:][ends_inside == 1]]))
    length = end - start
    short = np.flatnonzero(length <= LONGEST)
    first = holders(raw, doc[short], start[short], length[short]) == np.arange(len(short))
    distinct = np.bincount(doc[short[first]], minlength=len(texts))
    long = np.flatnonzero(length > LONGEST)  # these few through a set of their bytes
    if len(long):
        data = memoryview(raw)
        kinds = {(d, bytes(data[a:b])) for d, a, b in zip(doc[long].tolist(), start[long].tolist(), end[long].tolist())}
        distinct = distinct + np.bincount([d for d, _ in kinds], minlength=len(texts))
    total = np.zeros(size + 1, dtype=np.int64)
    np.cumsum((out & POINT) >> 3, dtype=np.int64, out=total[1:])
    return {"words": words, "distinct": distinct, "capitals": per_text(CAPITAL),
            "points": total[offsets[1:]] - total[offsets[:-1]], "symbols": per_text(SYMBOL) > 0}


def with_statistics(docs: DataFrame, text_col: str, keep: dict[str, Column]) -> DataFrame:
    """The columns ``keep`` and words, distinct, capitals, points and symbols of every text."""
    names = list(keep)
    rows = docs.select(*[c.alias(f"_ev_{n}") for n, c in keep.items()], F.col(text_col).cast("string").alias("_ev_body"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]),
                        "words long, distinct long, capitals long, points long, symbols boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, len(names), 2 << 20):
                got = text_statistics(part.column(len(names)))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], *[pa.array(v) for v in got.values()]], names=[*part.schema.names[:-1], *got])

    out = rows.mapInArrow(run, schema)
    return out.withColumnsRenamed({f"_ev_{n}": n for n in names})


#: The filters by letter, as failure conditions on the statistics; E (an earlier copy) needs the table.
FILTERS = {"A": "words < 50", "B": "100 * distinct < 65 * words", "C": "100 * capitals > 5 * points", "D": "symbols"}
LETTERS = "ABCDE"


def failures(docs: DataFrame, labels: DataFrame, part_col: str = "source", id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """Counts of documents: part, failed (bit k: the k-th filter), good, toxic, n."""
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    stats = with_statistics(docs, text_col, {"part": F.coalesce(F.col(part_col).cast("string"), F.lit("")),
                                             "id": F.col(id_col).cast("long"), "digest": digest})
    failed = sum((F.when(F.expr(cond), F.lit(1 << k)).otherwise(F.lit(0)) for k, cond in enumerate(FILTERS.values())), F.lit(0))
    per_row = stats.select("part", "id", "digest", failed.alias("failed")).groupBy("part", "id", "digest", "failed").agg(
        F.count(F.lit(1)).alias("n"))
    per_row = stored(per_row, "audit-rows")
    flags = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.bool_or(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.bool_or(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    labelled = per_row.join(flags, "id", "left").fillna({"good": False, "toxic": False})
    # Of one kind (part, text, labels): the rows with an id, the least id and its rows, the rows without an id.
    kinds = labelled.groupBy("digest", "part", "failed", "good", "toxic").agg(
        F.sum(F.when(F.col("id").isNotNull(), F.col("n"))).alias("named"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("least"),
        F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("unnamed"))
    kinds = stored(kinds, "audit-kinds")
    earliest = kinds.groupBy("digest").agg(F.min("least.id").alias("earliest"), F.count(F.lit(1)).alias("of"))
    # Only texts of several kinds need the least id of the others.
    shared = stored(earliest.filter("of > 1").drop("of"), "audit-shared")
    kinds = kinds.join(shared, "digest", "left").withColumn("earliest", F.coalesce("earliest", "least.id"))
    # Rows with an id below the table's earliest of the text: none; with that id: not copies; the rest: copies.
    at_first = F.when(F.col("least.id") == F.col("earliest"), F.col("least.n")).otherwise(F.lit(0))
    at_first = F.coalesce(at_first, F.lit(0))
    split = F.array(F.struct(F.col("failed").alias("failed"), (at_first + F.col("unnamed")).alias("n")),
                    F.struct((F.col("failed") + (1 << 4)).alias("failed"), (F.coalesce("named", F.lit(0)) - at_first).alias("n")))
    return kinds.select("part", "good", "toxic", F.explode(split).alias("s")).groupBy(
        "part", "good", "toxic", F.col("s.failed").alias("failed")).agg(F.sum("s.n").alias("n")).filter("n > 0")


def audit(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Every part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost and shapley, from counts of failed sets (``failures``)."""
    k = len(letters)
    subsets = [(f, sum(1 << i for i in s)) for f in range(k) for r in range(k)
               for s in combinations([i for i in range(k) if i != f], r)]
    cases = F.explode(F.array(*[F.struct(F.lit(1 << f).alias("f"), F.lit(s).alias("s")) for f, s in subsets]))
    each = counts.select("*", cases.alias("c")).select("part", "good", "toxic", "failed", "n", "c.f", "c.s")
    fails, before = F.col("failed").bitwiseAND(F.col("f")) != 0, F.col("failed").bitwiseAND(F.col("s")) != 0

    def total(condition: Column, name: str) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(F.lit(0))).alias(name)

    per_case = each.groupBy("part", "f", "s").agg(
        total(~fails & ~before, "kept"), total(fails & ~before, "removed"), total(fails & before, "redundant"),
        total(F.col("failed") == F.col("f"), "unique_fails"), total(fails & ~before & F.col("good"), "good_lost"),
        total(fails & ~before & F.col("toxic"), "toxic_lost"))
    # A set of r filters stands before f in r! (k - 1 - r)! orders.
    weight = F.element_at(F.array(*[F.lit(factorial(r) * factorial(k - 1 - r)) for r in range(k)]), F.bit_count("s") + 1)
    shapley = per_case.groupBy("part", "f").agg(F.sum(F.col("removed") * weight).alias("shapley"))
    steps = [("".join(order), i + 1, 1 << letters.index(order[i]), sum(1 << letters.index(x) for x in order[:i]))
             for order in permutations(letters) for i in range(k)]
    orders = counts.sparkSession.createDataFrame(steps, "filter_order string, step int, f int, s int")
    return per_case.join(shapley, ["part", "f"]).join(F.broadcast(orders), ["f", "s"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame, part_col: str = "source", id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """The whole audit of ``docs``: see ``failures`` and ``audit``."""
    return audit(stored(failures(docs, labels, part_col, id_col, text_col), "audit-counts"))
