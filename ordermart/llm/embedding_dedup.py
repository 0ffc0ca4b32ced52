"""Near-duplicate embeddings by spherical-cap filters from structured random codes.

A rotated vector is split into blocks, each with a small random code of its own. The
filter directions are all combinations of one code word per block, and a vector
belongs to every direction with which its inner product exceeds its bound, set so
that there are `filters` of them. They are found by list decoding: sorted lists of
partial sums are joined without trying all directions. Vectors of cosine 0.98 have
many filters in common, so they are joined on filters and compared exactly. For each
length of vectors there are as many directions as the number of vectors asks for and
the recall allows, which is measured on random pairs at the threshold: short vectors get
fewer directions, or more filters, and larger filters are compared in more tiles.

Vectors with the same components and label are one node, whatever their number.
Filters with one node only are dropped before any vector moves. Within a filter,
nodes are compared in tiles, each pair in its first common filter only, and a tile
hands on counts and a spanning forest instead of pairs.

Rows without a label, and vectors that are null, empty, zero or hold null or
non-finite components, link with nothing; they keep their own id. Only vectors of
equal length are compared. Repeated rows are vectors of their own that link with each
other. An empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordermart.llm.common import map_slices, saved
from ordermart.llm.components import components
from ordermart.llm.topk_search import usable

#: The least share of links that filters may find, and pairs that it is measured on.
RECALL = 0.999
PAIRS = 4000
#: Code words of a block at most and at least.
MOST_WORDS, LEAST_WORDS = 64, 8
#: Nodes in a tile; of larger filters every pair of tiles is compared on its own.
TILE = 1024


class Code:
    """Rotation and block codes for one length of vectors."""

    def __init__(self, size: int, words: int, seed: int = 7):
        rng = np.random.default_rng([seed, size, words])
        self.rotation = np.linalg.qr(rng.standard_normal((size, size)))[0]
        blocks = min(4, size)
        self.edges = np.linspace(0, size, blocks + 1).astype(int)
        self.words = words
        self.codes = []
        for a, b in zip(self.edges, self.edges[1:]):
            c = rng.standard_normal((words, b - a))
            self.codes.append(c / np.linalg.norm(c, axis=1, keepdims=True) / math.sqrt(blocks))

    def block_products(self, unit: np.ndarray) -> list[np.ndarray]:
        turned = unit @ self.rotation
        return [
            turned[:, a:b] @ c.T for a, b, c in zip(self.edges, self.edges[1:], self.codes)
        ]

    def decode(self, unit: np.ndarray, filters: int) -> tuple[np.ndarray, np.ndarray]:
        """For each vector the directions of the `filters` largest inner products and
        these. Of two sorted lists of partial sums, only pairs whose places multiply to
        at most that many can be among them, so lists are joined two at a time."""
        lists = []
        for p in self.block_products(unit):
            order = np.argsort(-p, axis=1, kind="stable")[:, :filters]
            lists.append((order, np.take_along_axis(p, order, axis=1), self.words))
        while len(lists) > 1:
            joined = [
                self.join(a, b, filters) for a, b in zip(lists[::2], lists[1::2])
            ]
            lists = joined + lists[len(joined) * 2 :]
        return lists[0][:2]

    @staticmethod
    def join(a: tuple, b: tuple, filters: int) -> tuple:
        i, j = np.meshgrid(np.arange(a[0].shape[1]), np.arange(b[0].shape[1]), indexing="ij")
        near = (i + 1) * (j + 1) <= filters
        i, j = i[near], j[near]
        total = a[1][:, i] + b[1][:, j]
        order = np.argsort(-total, axis=1, kind="stable")[:, :filters]
        place = np.take_along_axis(a[0][:, i] * b[2] + b[0][:, j], order, axis=1)
        return place, np.take_along_axis(total, order, axis=1), a[2] * b[2]


@cache
def code(size: int, words: int) -> Code:
    return Code(size, words)


def recall(size: int, words: int, filters: int, threshold: float) -> float:
    """The share of random pairs of just this cosine that have a filter in common."""
    rng = np.random.default_rng([3, size])
    a, b = rng.standard_normal((2, PAIRS, size))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    near = threshold * a + math.sqrt(1 - threshold**2) * b
    x, y = (code(size, words).decode(v, filters)[0] for v in (a, near))
    return float(np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(x, y)]))


def scheme(size: int, vectors: int, filters: int, threshold: float) -> tuple[int, int]:
    """Words of a block and filters of a vector, for vectors of a length of which there are
    so many: on average an eighth of a vector in each direction, so that strangers seldom
    meet, but no more directions than the recall allows. Where the fewest are too many,
    vectors get more filters, in the end all directions."""
    if size == 1:  # two vectors are the same or opposite
        return LEAST_WORDS, LEAST_WORDS
    words = min(MOST_WORDS, max(LEAST_WORDS, math.ceil((8 * filters * vectors) ** 0.25)))
    while words > LEAST_WORDS and recall(size, words, filters, threshold) < RECALL:
        words = max(LEAST_WORDS, words * 3 // 4)
    everywhere = LEAST_WORDS ** min(4, size)
    while filters < everywhere and recall(size, words, filters, threshold) < RECALL:
        filters = min(everywhere, filters * 2)
    return words, filters


def units(vectors: list[np.ndarray]) -> np.ndarray:
    v = np.stack(vectors).astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # squares of huge numbers overflow
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def filters_of(nodes: DataFrame, schemes: dict[int, tuple[int, int]]) -> DataFrame:
    """node, filter for every direction of every node; `schemes` by length of vectors."""

    def run(batch: pa.RecordBatch) -> dict:
        ids = np.array(batch.column("node").to_pylist(), dtype=np.int64)
        vectors = lists(batch.column("v"))
        sizes = np.array([len(v) for v in vectors], dtype=int)
        found_ids, found = [], []
        for size in np.unique(sizes):
            own = np.flatnonzero(sizes == size)
            words, filters = schemes[int(size)]
            place, _ = code(int(size), words).decode(units([vectors[i] for i in own]), filters)
            found_ids.append(np.repeat(ids[own], place.shape[1]))
            found.append(place.ravel())
        return {
            "node": np.concatenate(found_ids) if found else [],
            "filter": np.concatenate(found) if found else [],
        }

    return map_slices(nodes.select("node", "v"), run, "node long, filter long", rows=512)


def forest(linked: np.ndarray) -> np.ndarray:
    """For each node of a symmetric link matrix, the first node of its component."""
    label = np.arange(len(linked))
    while True:
        near = np.where(linked, label[None, :], len(label)).min(axis=1, initial=len(label))
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compare(tile: dict[str, np.ndarray | list], threshold: float) -> tuple[np.ndarray, ...]:
    """Links within one tile, or between two: nodes, their forest, weights of links."""
    unit, part, own = tile["unit"], tile["part"], tile["filter"][0]
    linked = unit @ unit.T >= threshold
    np.fill_diagonal(linked, False)
    if tile["a"][0] != tile["b"][0]:
        linked &= part[:, None] != part[None, :]
    if linked.any():
        # pairs that share an earlier filter are counted there
        earlier = [f[f < own] for f in tile["filters"]]
        names = np.unique(np.concatenate(earlier))
        if len(names):
            holds = np.zeros((len(unit), len(names)), dtype=np.float32)
            for i, f in enumerate(earlier):
                holds[i, np.searchsorted(names, f)] = 1
            linked &= (holds @ holds.T) == 0
    some = np.flatnonzero(linked.any(axis=1))
    node = tile["node"]
    return node[some], node[forest(linked)[some]], (linked @ tile["copies"])[some]


def lists(column: pa.Array) -> list[np.ndarray]:
    ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(ends, ends[1:])]


def runs_by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows with one `key`, out of rows that are sorted by it."""
    rest = None
    for batch in chain(batches, [None]):
        held = [x for x in (rest, batch) if x is not None and x.num_rows]
        rest = None
        if not held:
            continue
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        keys = np.array(rows.column("key").to_pylist(), dtype=object)
        starts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        if batch is not None:
            rest = rows.slice(starts[-2])
            starts.pop()
        for s, e in zip(starts, starts[1:]):
            yield rows.slice(s, e - s)


def tiles_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for rows in runs_by_key(batches):
        tile = {
            n: rows.column(n).to_numpy(zero_copy_only=False)
            for n in ("node", "copies", "filter", "part", "a", "b")
        }
        yield tile | {"filters": lists(rows.column("filters")), "unit": units(lists(rows.column("v")))}


def links_of(nodes: DataFrame, threshold: float, filters: int) -> DataFrame:
    """node, root (a node of the same component), links (vectors, counted by copies):
    parts that add up."""
    largest = nodes.groupBy("label", "size").count().groupBy("size").agg(F.max("count").alias("n"))
    # one row for each length of vectors
    schemes = {
        r["size"]: scheme(r["size"], r["n"], filters, threshold) for r in largest.collect()
    }
    key = ["label", "size", "filter"]
    held = filters_of(nodes, schemes).join(nodes.select("node", "label", "size"), "node")
    held = saved(held)
    shared = held.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")
    held = held.join(shared, key)
    places = held.groupBy("node").agg(
        F.sort_array(F.collect_list("filter")).alias("filters"),
        F.collect_list(F.struct("filter", "n")).alias("places"),
    )
    member = (
        nodes.join(places, "node")
        .select("*", F.explode("places").alias("place"))
        .select("node", "v", "copies", "filters", "label", "size", "place.filter", "place.n")
    )
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    part = F.pmod(F.xxhash64("node"), tiles).cast("int")
    member = (
        member.withColumn("part", part)
        .withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
        .withColumn("a", F.least("part", "other"))
        .withColumn("b", F.greatest("part", "other"))
    )
    # the label, which may hold any letters, comes last
    named = F.concat_ws("|", "size", "filter", "a", "b", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in tiles_of(batches):
            node, root, links = compare(tile, threshold)
            if len(node):
                yield pa.RecordBatch.from_pydict({"node": node, "root": root, "links": links})

    return (
        member.withColumn("key", named)
        .drop("label", "size", "n", "other")
        .repartition("key")
        .sortWithinPartitions("key", "node")
        .mapInArrow(run, "node long, root long, links long")
    )


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.98,
    filters: int = 32,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(vector_col).alias("v"),
        F.col(label_col).alias("label"),
    )
    takes_part = usable(F.col("v")) & F.col("label").isNotNull() & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("takes_part", takes_part)
    same = ["label", "v"]
    nodes = (
        rows.filter("takes_part")
        .groupBy(*same)
        .agg(F.count("*").alias("copies"), F.min("vec_id").alias("least_id"))
        .withColumn("size", F.size("v"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    nodes = saved(nodes)
    parts = saved(links_of(nodes, threshold, filters))
    roots = components(parts.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = parts.groupBy("node").agg(F.sum("links").alias("links"))
    placed = (
        nodes.join(links, "node", "left")
        .join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    smallest = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    found = placed.join(smallest, "root").select(
        *same,
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        "component_id",
    )
    linked = rows.filter("takes_part").join(found, same).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~F.col("takes_part")).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
