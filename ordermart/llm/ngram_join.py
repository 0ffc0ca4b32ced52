"""N-gram Jaccard join by MinHash banding.

Each distinct text gets MinHash values in bands; rows in a band and bands are chosen
for a target recall at the threshold. Texts that share a band hash are candidates.
They are tied into clusters by one link for each member of a band, so the full n-gram
sets travel once, to their cluster, where all pairs are compared exactly. A large
cluster is split into tiles of bounded size; tiles hand on counts of links and a
spanning forest, never pairs, and the forests make the classes.

Texts with the same words in the same order are one node, however many there are.
Letter case and white space don't matter. Null texts, empty ones and those without
words link with nothing and are classes of their own. A text of fewer words than a
shingle is one shingle. Texts are taken whole. Repeated rows are documents of their
own. An empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordermart.llm.common import fresh, id_and_text, map_slices, saved, texts
from ordermart.llm.components import components
from ordermart.llm.embedding_dedup import forest, lists, runs_by_key
from ordermart.llm.shingles import Bands, band_hashes, shingle_set, words_text
from ordermart.operators.keyfilter import key_filter, may_hold

#: Documents, and shingles, that a tile may hold on average.
TILE_DOCS = 256
TILE_SHINGLES = 1_000_000
#: Columns of the incidence matrix at once.
COLUMNS = 4096


def key_of(plain: str) -> bytes:
    return hashlib.blake2b(plain.encode(), digest_size=16).digest()


def smallest_id() -> Column:
    """What documents are compared by: id, null last, then the text's hash."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "hash")


def hashed(docs: DataFrame) -> DataFrame:
    return id_and_text(docs).withColumn("hash", F.xxhash64("text"))


def node_texts(docs: DataFrame, members: DataFrame) -> DataFrame:
    """One text for each member, by id and hash. Documents are thinned by a filter of bounded
    size over the members before any text is shuffled, so that the plan is the same
    whatever the number of members; of documents with the same id and text one goes on."""
    own = ["doc_id", "hash"]
    found = may_hold(hashed(docs), own, key_filter(members, own))
    found = found.groupBy(*own).agg(F.first("text").alias("text"))
    met = [F.col(f"d.{c}").eqNullSafe(F.col(f"m.{c}")) for c in own]
    return found.alias("d").join(members.alias("m"), met).select("m.*", "d.text")


def signatures(docs: DataFrame, size: int, bands: Bands) -> DataFrame:
    """doc_id, key (of the words), hash (of the text), n (shingles) and the band hashes
    of every row."""

    def run(batch: pa.RecordBatch) -> dict:
        plain = [words_text(t) for t in texts(batch)]
        sets = [shingle_set(p, size) for p in plain]
        return {
            "doc_id": batch.column("doc_id"),
            "key": [key_of(p) for p in plain],
            "hash": batch.column("hash"),
            "n": [len(s) for s in sets],
            "bands": [
                band_hashes(s, bands).view(np.int64).tolist() if len(s) else [] for s in sets
            ],
        }

    return map_slices(hashed(docs), run, "doc_id long, key binary, hash long, n int, bands array<long>")


def clusters(nodes: DataFrame) -> DataFrame:
    """node and cluster of the nodes that share a band hash with another."""
    held = nodes.select("node", F.explode("bands").alias("band"))
    shared = held.groupBy("band").agg(F.min("node").alias("first"), F.max("node").alias("last"))
    ties = (
        held.join(shared.filter("first < last"), "band")
        .filter("node > first")
        .select(F.col("node").alias("a"), F.col("first").alias("b"))
        .distinct()
    )
    tied = components(ties).withColumnRenamed("root", "cluster")
    tied = saved(tied)
    roots = tied.select(F.col("cluster").alias("node"), "cluster").distinct()
    return tied.union(roots)


def jaccard(sets: list[np.ndarray]) -> np.ndarray:
    """All similarities of some sets, by products of their incidence matrix, a part of
    its columns at a time."""
    sizes = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), sizes)
    value = np.concatenate(sets)
    order = np.argsort(value, kind="stable")
    row, value = row[order], value[order]
    new = np.concatenate([[True], value[1:] != value[:-1]])
    column = np.cumsum(new) - 1
    often = np.bincount(column)[column] > 1  # a shingle of one set is in no intersection
    row = row[often]
    column = np.unique(column[often], return_inverse=True)[1]
    both = np.zeros((len(sets), len(sets)), dtype=np.float64)
    last = int(column[-1]) + 1 if len(column) else 0
    for start in range(0, last, COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        part[row[a:b], column[a:b] - start] = 1
        both += part @ part.T
    return both / (sizes[:, None] + sizes[None, :] - both)


def verify(rows: pa.RecordBatch, similarity: float) -> tuple[np.ndarray, ...] | None:
    """Links within a tile, or between two: nodes, their forest, weights of links."""
    node, first = np.unique(rows.column("node").to_numpy(), return_index=True)
    if len(node) < 2:
        return None
    rows = rows.take(pa.array(first))  # a repeated row brings its node again
    sets = lists(rows.column("shingles"))
    linked = jaccard(sets) >= similarity
    np.fill_diagonal(linked, False)
    if rows.column("a")[0].as_py() != rows.column("b")[0].as_py():
        part = rows.column("part").to_numpy()
        linked &= part[:, None] != part[None, :]
    if not linked.any():
        return None
    some = np.flatnonzero(linked.any(axis=1))
    copies = rows.column("copies").to_numpy()
    return node[some], node[forest(linked)[some]], (linked @ copies)[some]


def links_of(docs: DataFrame, members: DataFrame, size: int, similarity: float) -> DataFrame:
    """node, root (a node of the same class), links (documents): parts that add up.
    `members`: nodes in clusters, with doc_id, hash and key of one document of each."""
    sizes = members.groupBy("cluster").agg(
        F.greatest(
            F.ceil(F.count("*") / TILE_DOCS), F.ceil(F.sum("n") / TILE_SHINGLES)
        ).cast("int").alias("tiles")
    )
    placed = members.join(sizes, "cluster").withColumn(
        "part", F.pmod(F.xxhash64("node"), "tiles").cast("int")
    )
    found = node_texts(docs, placed)

    def sets(batch: pa.RecordBatch) -> dict:
        plain = [words_text(t) for t in texts(batch)]
        # should two texts of one id have the same hash, the node's own one counts
        own = [i for i, (p, k) in enumerate(zip(plain, batch.column("key").to_pylist())) if key_of(p) == k]
        rows = batch.take(pa.array(own, pa.int64()))
        return {
            "shingles": [shingle_set(plain[i], size).view(np.int64) for i in own],
            **{n: rows.column(n) for n in ("node", "cluster", "part", "tiles", "copies")},
        }

    found = map_slices(
        found.drop("doc_id", "hash", "n"),
        sets,
        "node long, cluster long, part int, tiles int, copies long, shingles array<long>",
    )
    found = (
        found.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .withColumn("a", F.least("part", "other"))
        .withColumn("b", F.greatest("part", "other"))
        .withColumn("key", F.concat_ws("|", "cluster", "a", "b"))
        .drop("other", "tiles", "cluster")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs_by_key(batches):
            got = verify(rows, similarity)
            if got is not None:
                yield pa.RecordBatch.from_pydict(dict(zip(("node", "root", "links"), got)))

    return (
        found.repartition("key")
        .sortWithinPartitions("key", "node")
        .mapInArrow(run, "node long, root long, links long")
    )


def join(
    docs: DataFrame, similarity: float = 0.8, size: int = 5, recall: float = 0.999
) -> DataFrame:
    """One row for each document: doc_id, class_id (smallest id reachable by links),
    copy_id (smallest id of a document with the same words), n_links (other documents
    that are similar), key (of its words), hash (of its text), n (its shingles), kept (its id
    is the class's), first (the hash of the one document of its class that stays). A null
    id comes last."""
    signed = saved(signatures(docs, size, Bands.choose(similarity, recall)))
    nodes = (
        signed.filter("n > 0")
        .groupBy("key")
        .agg(
            F.count("*").alias("copies"),
            F.min(smallest_id()).alias("own"),
            F.first("n").alias("n"),
            F.first("bands").alias("bands"),
        )
        .select("key", "copies", "own.doc_id", "own.hash", "n", "bands")
        .withColumn("node", F.monotonically_increasing_id())
    )
    nodes = saved(nodes)
    members = saved(nodes.drop("bands").join(clusters(nodes), "node"))
    parts = saved(links_of(docs, members, size, similarity))
    roots = components(parts.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = parts.groupBy("node").agg(F.sum("links").alias("links"))
    placed = (
        nodes.select("node", "key", "copies", smallest_id().alias("own"))
        .join(links, "node", "left")
        .join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    smallest = placed.groupBy("root").agg(F.min("own").alias("least"))
    found = placed.join(smallest, "root").select(
        "key",
        F.col("least.doc_id").alias("class_id"),
        F.col("least.hash").alias("first"),
        F.col("own.doc_id").alias("copy_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    linked = signed.filter("n > 0").select("doc_id", "key", "hash", "n").join(found, "key")
    linked = linked.select(
        "doc_id", "class_id", "copy_id", "n_links", "key", "hash", "n", "first"
    )
    own = F.col("doc_id")
    alone = signed.filter("n = 0").select(
        own, own.alias("class_id"), own.alias("copy_id"),
        F.lit(0).cast("long").alias("n_links"), "key", "hash", "n", F.col("hash").alias("first"),
    )
    rows = linked.union(alone)
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def keep_first(docs: DataFrame, similarity: float = 0.8, size: int = 5) -> DataFrame:
    """The documents without all but one of each class, with all their columns: the one
    with the smallest id, among those the one whose text has the smallest hash, among rows
    of the same id and text any one. Documents without words all stay."""
    kept = join(docs, similarity, size).filter("kept AND hash = first")
    # a struct, as null ids equal each other in it, and as one key it serves the
    # join and the choice behind it with the same shuffle
    kept = kept.select(
        F.struct("doc_id", "hash").alias("own_row"), (F.col("n") == 0).alias("own_blank")
    ).distinct()
    own, nth = fresh("__row", docs.columns), fresh("__nth", docs.columns)
    row = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"))
    keyed = docs.withColumn(own, row)
    found = keyed.join(kept, keyed[own] == kept["own_row"]).select(
        *[keyed[c] for c in keyed.columns],
        F.when(kept["own_blank"], F.monotonically_increasing_id()).otherwise(-1).alias(nth),
    )
    return found.dropDuplicates([own, nth]).drop(own, nth)
