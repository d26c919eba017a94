"""Near-duplicate join of documents on the Jaccard similarity of word n-grams.

Documents with the same shingle set are one vertex. ``TREES`` trees propose pairs: in each
a vertex's label is a sequence of min-hashes, hashed into one key, and vertices with the same
key meet in a node. This is fixed banding in place of a forest of tries: one length for all
labels, the longest up to ``DEPTH`` at which the expected recall of pairs at the threshold
reaches ``RECALL``. All pairs are verified by their exact shingle sets:

1. every vertex of a node against the node's least vertex (a star, not all pairs); links
   found so give components;
2. nodes whose vertices lie in more than one component: all pairs across components, in
   blocks of bounded size;
3. within each component, the exact number of links of every vertex, again in blocks.

So no link that the forest can see is lost, large groups never meet in one task, and pairs
of a group are counted but never written. The result has one row a document: the least id
of its component and the number of other documents that its own text is linked to.

Words are runs of bytes other than blanks, unchanged; a text of fewer than ``words`` words
is one shingle of all its words. Defined results: null texts and texts without words are
linked to none (class_id is their own id); null ids compare above all others, a component
of null ids only has a null class_id; repeated rows and ids are documents of their own with
the same links; an empty table gives an empty table. Texts of any length are used whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix, pieces, stored, tidy, window_hashes, word_hashes
from .components import components

TREES, DEPTH, RECALL = 32, 12, 0.9999
#: A block of documents that is compared in one task: at most about so many documents and shingles.
BLOCK_DOCS, BLOCK_SHINGLES, CHUNK = 1024, 1 << 20, 4096


def prefix_length(threshold: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which a pair at the threshold meets in some tree with probability ``recall``."""
    while depth > 1 and 1 - (1 - threshold ** depth) ** trees < recall:
        depth -= 1
    return depth


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams."""
    hashes = word_hashes(np.frombuffer((text or "").encode(), dtype=np.uint8))[0]
    return np.unique(window_hashes(hashes, min(words, len(hashes)))) if len(hashes) else hashes


def _minhash_seeds(n: int) -> np.ndarray:
    return np.random.default_rng(7).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def labels(sets: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """One 64-bit hash for each tree of the first ``depth`` min-hashes of its label."""
    seeds = _minhash_seeds(trees * depth)
    least = np.full(len(seeds), np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for start in range(0, len(sets), 512):
            part = sets[start:start + 512, None] * seeds[None, :]
            part ^= part >> np.uint64(32)
            part *= np.uint64(0xD6E8FEB86659FD93)
            np.minimum(least, part.min(axis=0), out=least)
        out = np.zeros(trees, dtype=np.uint64)
        for level in least.reshape(trees, depth).T:
            out = mix(out * np.uint64(31) + level)
    return out


def digest(sets: np.ndarray) -> bytes:
    """128 bits of a shingle set."""
    with np.errstate(over="ignore"):
        a = np.array([mix(sets).sum(dtype=np.uint64), mix(sets + np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)])
    return mix(a + np.uint64(len(sets))).astype(">u8").tobytes()


def sketch(docs: DataFrame, id_col: str, text_col: str, words: int, trees: int, depth: int) -> DataFrame:
    """id, vertex (128-bit digest of the shingle set; null without words), n and the tree labels of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1, 1 << 20):
                sets = [shingles(t.as_py(), words) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([digest(s) if len(s) else None for s in sets], pa.binary()),
                     pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([labels(s, trees, depth).view(np.int64) if len(s) else None for s in sets], pa.list_(pa.int64()))],
                    names=["id", "vertex", "n", "labels"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("vertex", T.BinaryType()),
                           T.StructField("n", T.LongType()), T.StructField("labels", T.ArrayType(T.LongType()))])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).mapInArrow(tidy(run), schema)


def shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(vertex, sets): the shingles of every wanted vertex, from the document with its least id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in (batch.slice(i, 256) for i in range(0, len(batch), 256)):
                sets = [shingles(t.as_py(), words) for t in one.column(1)]
                right = [digest(s) == v.as_py() for s, v in zip(sets, one.column(0))]
                yield pa.RecordBatch.from_arrays(
                    [one.column(0).filter(pa.array(right)), pa.array([s.tobytes() for s, r in zip(sets, right) if r], pa.binary())],
                    names=["vertex", "sets"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).join(
        wanted.select(F.col("first_id"), "vertex"), F.col("id").eqNullSafe(F.col("first_id")))
    return rows.select("vertex", "body").mapInArrow(tidy(run), "vertex binary, sets binary").dropDuplicates(["vertex"])


def overlap(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections between two lists of sorted sets, by products of incidence blocks."""
    out = np.zeros((len(a), len(b)), dtype=np.float32)
    left, right = np.concatenate(a), np.concatenate(b)
    common = np.intersect1d(left, right)
    rows_a = np.repeat(np.arange(len(a)), [len(x) for x in a])
    rows_b = np.repeat(np.arange(len(b)), [len(x) for x in b])
    at_a, at_b = np.searchsorted(common, left), np.searchsorted(common, right)
    for rows, at, values in ((rows_a, at_a, left), (rows_b, at_b, right)):
        miss = (at == len(common))
        at[miss] = 0
        at[common[at] != values if len(common) else slice(None)] = -1
        at[miss] = -1
    for start in range(0, len(common), CHUNK):
        parts = []
        for size, rows, at in ((len(a), rows_a, at_a), (len(b), rows_b, at_b)):
            inside = (at >= start) & (at < start + CHUNK)
            m = np.zeros((size, min(CHUNK, len(common) - start)), dtype=np.float32)
            m[rows[inside], at[inside] - start] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def linked(a: list[np.ndarray], b: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs reach the threshold exactly."""
    size_a, size_b = (np.array([len(x) for x in s], dtype=np.float64) for s in (a, b))
    common = overlap(a, b).astype(np.float64)
    return common >= threshold * (size_a[:, None] + size_b[None, :] - common) - 1e-9


def _blocks(members: DataFrame, sets: DataFrame, group: str) -> DataFrame:
    """Members of each group with their shingles, dealt to pairs of blocks (p <= q)."""
    sizes = members.groupBy(group).agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    dealt = members.join(sizes, group).withColumn("own", F.pmod(F.xxhash64("vertex"), F.col("blocks")).cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return pairs.withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other")).drop(
        "other", "blocks").join(sets, "vertex")


def _sides(group: pa.Table) -> tuple[list[np.ndarray], pa.Table, list[np.ndarray], pa.Table, bool]:
    """Sets and rows of the group's block p and of its block q, and whether they are the same."""
    p, q = group["p"][0].as_py(), group["q"][0].as_py()
    own = group["own"].to_numpy()
    sides = [group.filter(pa.array(own == k)) for k in (p, q)]
    a, b = ([np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in side["sets"]] for side in sides)
    return a, sides[0], b, sides[1], p == q


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) whose exact similarity reaches the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = (np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in (x, y))
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(common >= threshold * (len(a) + len(b) - common) - 1e-9)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], names=["u", "v"])

    left = sets.select(F.col("vertex").alias("u"), F.col("sets").alias("a"))
    right = sets.select(F.col("vertex").alias("v"), F.col("sets").alias("b"))
    rows = pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b")
    return rows.mapInArrow(tidy(run), "u binary, v binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8,
                    trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """``id_col``, class_id, n_links and class_size of every row."""
    depth = prefix_length(threshold, trees, recall=recall)
    rows = stored(sketch(docs, id_col, text_col, words, trees, depth), "sketch")
    vertices = stored(rows.filter("vertex is not null").groupBy("vertex").agg(
        F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"),
        F.first("labels").alias("labels")), "vertices")

    # Nodes with two vertices or more.
    meets = vertices.select("vertex", "n", F.posexplode("labels").alias("tree", "label"))
    nodes = meets.groupBy("tree", "label").agg(F.count(F.lit(1)).alias("m"), F.min("vertex").alias("hub")).filter("m > 1")
    members = stored(meets.join(nodes, ["tree", "label"]), "nodes")
    sets = stored(shingle_sets(docs, vertices.join(members.select("vertex").distinct(), "vertex"), id_col, text_col, words), "sets")

    # 1. Stars.
    sizes = vertices.select(F.col("vertex").alias("hub"), F.col("n").alias("n_hub"))
    stars = members.filter("vertex <> hub").select("hub", "vertex", "n").distinct().join(sizes, "hub").filter(
        F.least("n", "n_hub") >= F.greatest("n", "n_hub") * F.lit(threshold) - 1e-6)
    edges = stored(verified(stars.select(F.col("hub").alias("u"), F.col("vertex").alias("v")), sets, threshold), "stars")
    cells = components(edges)

    # 2. Nodes that lie in several components: pairs across them.
    placed = members.filter("m > 2").join(cells.select(F.col("v").alias("vertex"), "label").withColumnRenamed("label", "cell"),
                                          "vertex", "left").withColumn("cell", F.coalesce("cell", "vertex"))
    mixed = placed.groupBy("tree", "label").agg(F.min("cell").alias("low"), F.max("cell").alias("high")).filter("low <> high")
    open_nodes = placed.join(mixed, ["tree", "label"]).select(
        F.xxhash64("tree", "label").alias("node"), "vertex", "n", "cell").distinct()

    def across(group: pa.Table) -> pa.Table:
        a, left, b, right, _ = _sides(group)
        i, j = np.nonzero(linked(a, b, threshold)) if a and b else ([], [])
        cu, cv = left["cell"].to_pylist(), right["cell"].to_pylist()
        found = {(cu[x], cv[y]): (x, y) for x, y in zip(i, j) if cu[x] != cv[y]}  # one link for each two components
        return pa.table({"u": left["vertex"].take(pa.array([x for x, _ in found.values()], pa.int64())),
                         "v": right["vertex"].take(pa.array([y for _, y in found.values()], pa.int64()))})

    more = _blocks(open_nodes, sets, "node").groupBy("node", "p", "q").applyInArrow(across, "u binary, v binary")
    more = stored(more, "across")
    if not more.isEmpty():
        cells = components(edges.unionByName(more))

    # 3. Links of every vertex within its component, counted in documents.
    inside = cells.join(vertices.select(F.col("vertex").alias("v"), "n", "copies"), "v").select(
        F.col("label").alias("cell"), F.col("v").alias("vertex"), "n", "copies")

    def count(group: pa.Table) -> pa.Table:
        a, left, b, right, same = _sides(group)
        hit = linked(a, b, threshold) if a and b else np.zeros((len(a), len(b)), dtype=bool)
        if same:
            np.fill_diagonal(hit, False)
        parts = [(left, hit @ right["copies"].to_numpy())]
        if not same:
            parts.append((right, hit.T @ left["copies"].to_numpy()))
        return pa.concat_tables([pa.table({"vertex": side["vertex"], "links": pa.array(n.astype(np.int64))}) for side, n in parts])

    links = _blocks(inside, sets, "cell").groupBy("cell", "p", "q").applyInArrow(
        count, "vertex binary, links long").groupBy("vertex").agg(F.sum("links").alias("links"))
    classes = inside.join(vertices.select("vertex", "first_id"), "vertex").groupBy("cell").agg(
        F.min("first_id").alias("class_id"), F.sum("copies").alias("class_size"))
    known = vertices.select("vertex", "first_id", "copies").join(inside.select("vertex", "cell"), "vertex", "left").join(
        links, "vertex", "left").join(classes, "cell", "left").select(
        "vertex", F.coalesce("class_id", "first_id").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("class_size", "copies").alias("class_size"))
    own = rows.select("id", "vertex", F.pmod(F.xxhash64("id"), F.lit(16)).alias("salt"))
    spread = known.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
    return own.join(spread, ["vertex", "salt"], "left").select(
        F.col("id").alias(id_col), F.when(F.col("vertex").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("class_size", F.lit(1)).alias("class_size"))
