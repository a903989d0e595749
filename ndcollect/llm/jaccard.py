"""N-gram Jaccard join by chosen paths.

Documents are sets of word 5-grams; pairs with a Jaccard similarity of 0.8 or more are linked. Equal sets are
one node with a weight, so groups of copies cost one row. Then:

1. Each node's set is embedded as ``SKETCH`` minhash tokens. A run is a tree over the nodes: at a tree node, a
   set goes to the child of every token that the tree node's random function picks (each with probability
   1 / (threshold * SKETCH), so 1 / threshold children are expected). Sets that share a child share a sampled
   token. Children with at most ``bucket`` sets are compared by brute force; larger ones are split again, and
   those still larger at ``depth`` are compared in pairs of blocks. A pair at the threshold survives a run
   with probability ``survival``, so ``runs`` repetitions reach the target recall.
2. Comparing sketches only proposes candidates; connected candidates form components. Inside a component all
   pairs are verified on the whole sets, in blocks where it is large, whichever run found them. Links are
   counted there, never emitted one by one; a cell emits at most one edge a member.
3. Components of verified links are the classes.

Buckets, cells and components are met through sorts and merge joins between written tables; no pair list, set
or component reaches the driver. Node ids are 64-bit hashes of whole sets (documents with equal hashes and
different sets are expected once in 2**64 pairs).

Words are the white-space separated parts of the lower-cased text; a text of one to four words has one gram
of all of them. Defined cases: a null, empty or blank text has no grams, no links and a class of its own; a
row with a null id takes part like any other and ranks last (the class of rows all without ids is null); rows
that repeat id and text count as copies, of which ``deduplicate`` keeps one; rows of one id with different texts
are told apart by a hash of the text; extra columns, whatever their names, are ignored by ``links`` and kept by
``deduplicate``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fewer, materialize, merged, mix64, modest_batches, text_of, tidy
from .exact_dedup import without

GRAM = 5
SKETCH = 64
SLICE = 512 << 10  # bytes of text worked on at once
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = []


def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


_GRAM_KEYS = mix64(np.arange(1, GRAM + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
_MIN_KEYS = mix64(np.arange(101, 101 + SKETCH, dtype=np.uint64) * np.uint64(0xAF251AF3B0F025B5)) | np.uint64(1)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and how many each text has."""
    norm = [" ".join(t.lower().split()) for t in texts]
    n = np.fromiter((t.count(" ") + 1 if t else 0 for t in norm), np.int64, len(norm))
    data = np.frombuffer(" ".join(t for t in norm if t).encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), n
    up, down = _table(len(data) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])
    gaps = np.flatnonzero(data == 32)
    start, end = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(data)]])
    return mix64((sums[end] - sums[start]) * down[start]), n


def gram_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct gram hashes of each text."""
    words, n = word_hashes(texts)
    if len(words) >= GRAM:
        total = np.zeros(len(words) - GRAM + 1, np.uint64)
        for k in range(GRAM):
            total += words[k : len(words) - GRAM + 1 + k] * _GRAM_KEYS[k]
        grams = mix64(total)
    out, at = [], 0
    for m in n.tolist():
        if m >= GRAM:
            out.append(np.unique(grams[at : at + m - GRAM + 1]))
        elif m:
            out.append(mix64(np.array([np.uint64(m) + (words[at : at + m] * _GRAM_KEYS[:m]).sum(dtype=np.uint64)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += m
    return out


def sketches(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Node ids and minhash sketches of non-empty sets."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    node = np.add.reduceat(mix64(flat ^ np.uint64(0x5851F42D4C957F2D)), starts) + np.array([len(s) for s in sets], np.uint64)
    out = np.empty((len(sets), SKETCH), np.uint32)
    for k in range(SKETCH):
        out[:, k] = np.minimum.reduceat(((flat * _MIN_KEYS[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return mix64(node).view(np.int64), out


_NODES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text_key", T.LongType()), T.StructField("node", T.LongType()), T.StructField("n_grams", T.LongType()), T.StructField("sketch", T.BinaryType())])


def _embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in merged(batches, "text", SLICE):
        sets = gram_sets([t or "" for t in batch.column("text").to_pylist()])
        full = [i for i, s in enumerate(sets) if len(s)]
        node, sketch = np.zeros(len(sets), np.int64), [None] * len(sets)
        if full:
            node[full], rows = sketches([sets[i] for i in full])
            for i, row in zip(full, rows):
                sketch[i] = row.tobytes()
        n = np.array([len(s) for s in sets], np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(node, mask=n == 0), pa.array(n), pa.array(sketch, pa.binary())], names=["doc_id", "text_key", "node", "n_grams", "sketch"])


def survival(threshold: float, depth: int) -> float:
    """Chance that a pair at the threshold shares a tree node ``depth`` levels down, in one run."""
    q = 1.0
    for _ in range(depth):
        q = 1 - math.exp(-q)  # the number of shared children is close to Poisson with mean threshold / threshold
    return q


def runs_for(recall: float, threshold: float, depth: int) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(threshold, depth)))


def _tokens(data: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(data), np.uint32).reshape(-1, SKETCH)


def _children(parent: np.ndarray, sketch: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and keys of the children that the sets (rows of ``sketch``) go to below their tree nodes."""
    salt = mix64(parent.view(np.uint64))[:, None]
    token = sketch.astype(np.uint64) | (np.arange(SKETCH, dtype=np.uint64) << np.uint64(32))[None, :]
    h = mix64(salt + token * np.uint64(0xDA942042E4DD58B5))
    row, at = np.nonzero((h >> np.uint64(11)) < np.uint64(int((1 << 53) / (threshold * SKETCH))))
    return row, mix64(h[row, at] ^ np.uint64(0x2545F4914F6CDD1D)).view(np.int64)


def _grow(threshold: float, runs: int | None):
    """Rows (key, node) of children: of all runs' roots, or of the tree nodes in ``key``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sketch, node = _tokens(batch.column("sketch").to_pylist()), batch.column("node").to_numpy()
                parents = [np.full(len(node), r, np.int64) for r in range(runs)] if runs else [batch.column("key").to_numpy()]
                for parent in parents:
                    row, key = _children(parent, sketch, threshold)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node[row])], names=["key", "node"])
        tidy()

    return run


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index connected to each of n, over edges a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def _groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of whole groups, of rows sorted by ``columns``."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        keys = [rows.column(c).to_numpy() for c in columns]
        last = np.ones(rows.num_rows, bool)
        for k in keys:
            last &= k == k[-1]
        cut = rows.num_rows - int(last[::-1].argmin() if not last.all() else rows.num_rows)
        if cut:
            yield rows.slice(0, cut).combine_chunks().to_batches()[0]
        rest = rows.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks().to_batches()[0]
    tidy()


def _compare(least: float):
    """Edges (node, to) that connect the similar sketches of each bucket: at most one a row."""
    enough = math.ceil(least * SKETCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches, ["key", "cell"]):
            key, cell, node = (batch.column(c).to_numpy() for c in ("key", "cell", "node"))
            sketch = _tokens(batch.column("sketch").to_pylist())
            left, right = [], []
            at, step = np.arange(len(key)), 1
            while True:
                at = at[at + step < len(key)]
                at = at[(key[at] == key[at + step]) & (cell[at] == cell[at + step])]
                if not len(at):
                    break
                for low in range(0, len(at), 100_000):
                    i = at[low : low + 100_000]
                    i = i[(sketch[i] == sketch[i + step]).sum(1) >= enough]
                    left.append(i)
                    right.append(i + step)
                step += 1
            if left:
                a, b = np.concatenate(left), np.concatenate(right)
                label = _roots(len(node), a, b)
                own = np.flatnonzero((label != np.arange(len(node))) & (node[label] != node))
                yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(node[label[own]])], names=["node", "to"])

    return run


def _blocked(rows: DataFrame, size: str, key: str, half: int) -> DataFrame:
    """Rows once for every pair of blocks that theirs takes part in: one cell where a group has at most 2 * half rows."""
    n = F.when(F.col(size) <= 2 * half, F.lit(1)).otherwise(F.ceil(F.col(size) / half)).cast("int")
    rows = rows.withColumn("__n", n).withColumn("block", F.pmod(F.xxhash64("node", key), F.col("__n")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("__n") - 1))
    rows = rows.withColumn("__other", other)
    return rows.withColumn("cell", F.least("block", "__other").cast("long") * F.col("__n") + F.greatest("block", "__other")).drop("__n", "__other")


def candidates(nodes: DataFrame, *, threshold: float, recall: float, bucket: int, depth: int, slack: float) -> DataFrame:
    """Edges (node, to) between nodes whose sketches agree in at least ``threshold - slack``, connected as in the buckets."""
    edges: DataFrame | None = None
    spark = nodes.sparkSession
    keys = nodes.select("node", "sketch").repartition(spark.sparkContext.defaultParallelism).mapInArrow(_grow(threshold, runs_for(recall, threshold, depth)), "key long, node long")
    for level in range(1, depth + 1):
        sizes = materialize(fewer(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")), "jaccard-sizes")
        live = keys.join(sizes.hint("merge"), "key").join(nodes.select("node", "sketch").hint("merge"), "node")
        live = materialize(live.select("key", "node", "n", "sketch"), "jaccard-live")
        near = live if level == depth else live.where(F.col("n") <= bucket)
        met = _blocked(near, "n", "key", max(1, bucket // 2)).select("key", "cell", "node", "sketch")
        found = met.repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(_compare(threshold - slack), "node long, to long")
        edges = found if edges is None else edges.unionByName(found)
        if level < depth:
            large = live.where(F.col("n") > bucket)
            if large.isEmpty():
                break
            keys = large.repartition("key", "node").mapInArrow(_grow(threshold, None), "key long, node long")
    return edges


def _stars(edges: DataFrame) -> bool:
    """Whether every node with an edge to a smaller one has just that edge, and nobody has an edge to it."""
    ends = edges.select(F.col("a").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node on an edge (node, to): the smallest node connected to it.

    Alternating large-star and small-star steps until only stars are left; every step is an aggregate and a
    merge join, both on written tables.
    """
    edges = materialize(fewer(edges.select(F.greatest("node", "to").alias("a"), F.least("node", "to").alias("b")).where("a <> b").distinct()), "components")
    while not _stars(edges):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = materialize(fewer(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))), "components-low")
        large = both.where("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        edges = materialize(fewer(large.where("a <> b").distinct()), "components")
        low = materialize(fewer(edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))), "components-low")
        small = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).join(low.hint("merge"), "u")
        edges = materialize(fewer(small.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()), "components")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in merged(batches, "text", SLICE):
        sets = gram_sets([t or "" for t in batch.column("text").to_pylist()])
        node = batch.column("node").to_numpy()
        full = [i for i, s in enumerate(sets) if len(s)]
        ids = sketches([sets[i] for i in full])[0] if full else []
        keep = [i for i, x in zip(full, ids) if x == node[i]]  # a repeated id may have other texts
        rows = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([rows.column("node"), rows.column("label"), rows.column("n"), rows.column("weight"), pa.array([sets[i].tobytes() for i in keep], pa.binary())], names=["node", "label", "n", "weight", "grams"])


def similar(sets: list[np.ndarray], threshold: tuple[int, int], most: int = 1 << 24) -> np.ndarray:
    """Which pairs have a Jaccard similarity of at least ``threshold`` (a fraction), by exact counts."""
    size = np.array([len(s) for s in sets], np.int64)
    own, to, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    shared = n[to] > 1
    row, column = row[shared], (np.cumsum(n > 1) - 1)[to[shared]]
    both = np.zeros((len(sets), len(sets)), np.float64)
    width = max(1, most // len(sets))
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for low in range(0, int((n > 1).sum()), width):
        a, b = np.searchsorted(column, [low, low + width])
        block = np.zeros((len(sets), min(width, int((n > 1).sum()) - low)), np.float32)
        block[row[a:b], column[a:b] - low] = 1
        both += block @ block.T
    union = size[:, None] + size[None, :] - both
    return both * threshold[1] >= union * threshold[0]


def _verify(threshold: tuple[int, int]):
    """By cell and member: the weight of verified links of pairs that this cell answers for, and the first member it is connected to.

    ``whole`` marks cells that hold their whole component: there, that member names the class.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches, ["label", "cell"]):
            label, cell, node, block, weight = (batch.column(c).to_numpy() for c in ("label", "cell", "node", "block", "weight"))
            whole = batch.column("whole").to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.r_[True, (label[1:] != label[:-1]) | (cell[1:] != cell[:-1]), True])
            grams = batch.column("grams")
            out: list[list] = [[], [], [], []]
            for a, b in zip(cut[:-1], cut[1:]):
                if b - a < 2:
                    continue
                like = similar([np.frombuffer(grams[i].as_py(), np.uint64) for i in range(a, b)], threshold)
                np.fill_diagonal(like, False)
                own = block[a:b]
                if own.min() != own.max():  # pairs of one block belong to that block's own cell
                    like &= own[:, None] != own[None, :]
                i, j = np.nonzero(like)
                root = _roots(b - a, i, j)
                out[0].append(node[a:b])
                out[1].append(node[a:b][root])
                out[2].append(like @ weight[a:b])
                out[3].append(whole[a:b])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["node", "to", "links", "whole"])

    return run


def _texts(docs: DataFrame) -> DataFrame:
    text = text_of("text")
    return docs.select("doc_id", F.xxhash64(text).alias("text_key"), text.alias("text"))


def classes(docs: DataFrame, *, threshold: tuple[int, int] = (4, 5), recall: float = 0.999, bucket: int = 1000, depth: int = 3, slack: float = 0.18) -> DataFrame:
    """By row: doc_id, text_key, class_id, n_links, class_size, and the row that stands for the class (keep_id, keep_key; no key where there are no grams)."""
    modest_batches(docs.sparkSession)
    level = threshold[0] / threshold[1]
    schema = T.StructType([docs.schema["doc_id"], *_NODES.fields[1:]])
    embedded = materialize(_texts(docs).mapInArrow(_embed, schema), "jaccard-embedded")
    known = embedded.where("node IS NOT NULL")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    nodes = materialize(fewer(known.groupBy("node").agg(F.min(place).alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("sketch").alias("sketch"))), "jaccard-nodes")
    edges = candidates(nodes, threshold=level, recall=recall, bucket=bucket, depth=depth, slack=slack)
    grouped = materialize(fewer(components(edges)), "jaccard-components")
    sizes = materialize(fewer(grouped.groupBy("label").agg(F.count(F.lit(1)).alias("n"))), "jaccard-component-sizes")
    members = grouped.join(sizes.hint("merge"), "label").join(nodes.drop("sketch").hint("merge"), "node")
    members = materialize(fewer(members.select("node", "label", "n", "weight", F.col("rep.doc_id").alias("id"), F.col("rep.text_key").alias("key"))), "jaccard-members")
    texts = _texts(docs).join(members.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")))
    texts = texts.select("text", "node", "label", "n", "weight")
    sets = materialize(texts.mapInArrow(_sets, "node long, label long, n long, weight long, grams binary").dropDuplicates(["node"]), "jaccard-sets")
    half = max(1, bucket // 2)
    met = _blocked(sets, "n", "label", half).select("label", "cell", "block", "node", "weight", (F.col("n") <= 2 * half).alias("whole"), "grams")
    verified = met.repartition("label", "cell").sortWithinPartitions("label", "cell").mapInArrow(_verify(threshold), "node long, to long, links long, whole boolean")
    verified = materialize(verified, "jaccard-verified")
    own = verified.groupBy("node").agg(F.sum("links").alias("links"), F.min(F.when(F.col("whole"), F.col("to"))).alias("own_label"))
    placed = nodes.select("node", "rep", "weight").join(own.hint("merge"), "node", "left")
    parts = verified.where("NOT whole").select("node", "to")
    if parts.isEmpty():
        placed = placed.withColumn("label", F.lit(None).cast("long"))
    else:
        placed = placed.join(components(parts).hint("merge"), "node", "left")
    placed = materialize(fewer(placed.select("node", F.coalesce("own_label", "label", "node").alias("label"), "rep", "weight", F.coalesce("links", F.lit(0)).alias("links"))), "jaccard-placed")
    named = placed.groupBy("label").agg(F.min("rep.doc_id").alias("class_id"), F.min("rep").alias("keep"), F.sum("weight").alias("class_size"))
    named = materialize(fewer(named), "jaccard-named")
    result = placed.join(named.hint("merge"), "label").select("node", "class_id", F.col("keep.text_key").alias("keep_key"), F.col("keep.doc_id").alias("keep_id"), "class_size", (F.col("links") + F.col("weight") - 1).alias("n_links"))
    out = ["doc_id", "text_key", "class_id", "n_links", "class_size", "keep_id", "keep_key"]
    linked = known.select("doc_id", "text_key", "node").join(result.hint("merge"), "node").select(*out)
    none = F.lit(None).cast("long")
    alone = embedded.where("node IS NULL").select("doc_id", "text_key", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("class_size"), none.alias("keep_id"), none.alias("keep_key"))
    return linked.unionByName(alone)


def links(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id (smallest id of the class), n_links (documents linked to this one, copies included), class_size.

    Options as of ``classes``.
    """
    return classes(docs, **options).select("doc_id", "class_id", "n_links", "class_size")


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with its columns and, of each class, one row: one of the smallest id."""
    placed = classes(docs, **options).where("keep_key IS NOT NULL")
    own = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("text_key") == F.col("keep_key"))
    counted = placed.select("doc_id", "text_key", own.alias("again")).groupBy("doc_id", "text_key", "again").agg(F.count(F.lit(1)).alias("n"))
    gone = materialize(fewer(counted.where("NOT again OR n > 1").drop("n")), "jaccard-gone")
    return without(docs, gone, F.xxhash64(text_of("text")))
