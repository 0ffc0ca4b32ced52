"""A Merkle manifest of a dataset: a digest of every row, a tree of digests for each
value of one column, and one root over the trees.

A row's leaf is the SHA-256 of its columns, each as `-` for null, else its length in
UTF-8 bytes, `:` and its value, so that no two rows have the same text. In a tree the
leaves ascend by id. While several nodes remain, every `ARITY` consecutive ones, the last
run being shorter or even of one, become the digest of their hex digests one after the
other. The trees' roots, in order of the column's value, make the upper tree the same way.

Each level is one equijoin of nodes with nodes: the sibling at slot s of a run stands at
index run * ARITY + s, so slot-zero rows look up the slots behind theirs by run number
and emit the parent. All slots share one key and thus one shuffle; a run has at most
ARITY rows, so no key is hot, however many rows share a tree. Proofs go down the
levels: a node's siblings, then those of its parent. They are kept per run, so the
leaves share what stands above them.

Null ids come first; rows with one id are ordered by leaf, and equal rows each have a
place. Null is a tree of its own, the first one. A table of one row has that row's leaf as
root; an empty table gives no rows. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordermart.llm.common import saved
from ordermart.llm.ordering import numbered, placed

ARITY = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: One level of a path: digests before and after the node's own.
STEP = "array<struct<before:string, after:string>>"


def digest(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def spelled(value: Column) -> Column:
    """A value so that it can't run into the next one."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return digest(F.concat(*[spelled(v) for v in values]))


def tree_key(value: Column) -> Column:
    """Text that is never null and sorts as the value does, null first."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("-"))


@dataclass(frozen=True)
class Forest:
    """Trees over one set of nodes. `levels` holds frames of (tree, run, nodes, digests,
    parent), from the leaves up, `nodes` being how many parents the tree has there; `tops`
    one row (tree, digest) for each tree."""

    levels: list[DataFrame]
    tops: DataFrame


def parents(nodes: DataFrame) -> DataFrame:
    """One row for each run of siblings: tree, run, number of runs of the tree, the run's
    digests by slot, their parent."""
    slots = nodes.select(
        "tree",
        F.floor(F.col("idx") / ARITY).alias("run"),
        F.pmod("idx", F.lit(ARITY)).alias("slot"),
        F.ceil(F.col("nodes") / ARITY).alias("nodes"),
        "digest",
    )
    runs = slots.filter("slot = 0").select("tree", "run", "nodes", F.col("digest").alias("d0"))
    for s in range(1, ARITY):
        behind = slots.filter(F.col("slot") == s)
        behind = behind.select("tree", "run", F.col("digest").alias(f"d{s}"))
        runs = runs.join(behind, ["tree", "run"], "left")
    digests = F.array_compact(F.array(*[f"d{s}" for s in range(ARITY)]))
    return runs.select(
        "tree",
        "run",
        "nodes",
        digests.alias("digests"),
        digest(F.array_join(digests, "")).alias("parent"),
    )


def grow(leaves: DataFrame) -> Forest:
    """All levels over leaves (tree, idx, nodes, digest): idx from 0 in each tree, `nodes`
    how many the tree has."""
    largest = leaves.agg(F.max("nodes")).first()[0] or 0
    nodes, levels = leaves, []
    tops = nodes.filter("nodes = 1").select("tree", "digest")
    while largest > 1:
        level = saved(parents(nodes.filter("nodes > 1")))
        levels.append(level)
        nodes = level.select("tree", F.col("run").alias("idx"), "nodes", F.col("parent").alias("digest"))
        tops = tops.unionByName(nodes.filter("nodes = 1").select("tree", "digest"))
        largest = -(-largest // ARITY)
    return Forest(levels, saved(tops))


def paths(forest: Forest, above: DataFrame) -> DataFrame | None:
    """(tree, run, digests, path, *marks) of each run of leaves, None if no tree has two
    leaves. `above` has a row (tree, path, *marks) for each tree: the siblings beyond its
    top, and columns to hand on. A path holds, from a run's parent up, what stands before
    and after the node."""
    marks = [c for c in above.columns if c not in ("tree", "path")]
    runs = None
    for level in reversed(forest.levels):
        met = level.filter("nodes = 1").join(above, "tree")
        below = ["tree", "run", "digests", "path", *marks]
        here = met.select(*below)
        if runs is not None:
            known = children(runs, marks).withColumnRenamed("idx", "run")
            inner = level.filter("nodes > 1").join(known, ["tree", "run"])
            here = here.unionByName(inner.select(*below))
        runs = here
    return runs


def step(digests: Column, slot: Column) -> Column:
    before = F.array_join(F.slice(digests, F.lit(1), slot), "")
    after = F.array_join(F.slice(digests, slot + 2, F.lit(ARITY)), "")
    return F.struct(before.alias("before"), after.alias("after"))


def children(runs: DataFrame, marks: Sequence[str]) -> DataFrame:
    """The nodes of each run with their paths."""
    each = runs.select(
        "tree", "run", "digests", "path", *marks, F.posexplode("digests").alias("slot", "own")
    )
    longer = F.concat(F.array(step(F.col("digests"), F.col("slot"))), F.col("path"))
    return each.select(
        "tree",
        (F.col("run") * ARITY + F.col("slot")).alias("idx"),
        longer.alias("path"),
        *marks,
    )


def fold(own: Column, path: Column) -> Column:
    """The root that a leaf leads to along its path."""
    return F.aggregate(
        path, own, lambda x, p: digest(F.concat(p.getField("before"), x, p.getField("after")))
    )


def siblings(path: Column) -> Column:
    """All digests of a path, level by level, left to right."""
    return F.array_join(
        F.transform(path, lambda p: F.concat(p.getField("before"), p.getField("after"))), ""
    )


def manifest(
    docs: DataFrame,
    columns: Sequence[str] = COLUMNS,
    id_col: str = "doc_id",
    tree_col: str = "lang",
    others: dict[str, Column] | None = None,
) -> DataFrame:
    """doc_id, leaf, subroot, root, path of every row, and `others`, which may use any
    column of the table."""
    others = others or {}
    rows = docs.select(
        tree_key(F.col(tree_col)).alias("tree"),
        F.col(id_col).cast("long").alias("doc_id"),
        leaf([F.col(c) for c in columns]).alias("leaf"),
        *[value.alias(name) for name, value in others.items()],
    )
    order = ["tree", "doc_id", "leaf", "uid"]
    rows = placed(numbered(rows), order, group="tree")
    rows = saved(rows.withColumnsRenamed({"place": "idx", "members": "nodes"}))
    trees = grow(rows.select("tree", "idx", "nodes", F.col("leaf").alias("digest")))

    ranks = placed(trees.tops, ["tree"]).withColumnRenamed("tree", "name")
    ranks = saved(ranks.withColumnsRenamed({"place": "idx", "members": "nodes"}))
    upper = grow(ranks.select(F.lit("").alias("tree"), "idx", "nodes", "digest"))
    start = upper.tops.select(
        "tree", F.array().cast(STEP).alias("path"), F.col("digest").alias("root")
    )
    known = paths(upper, start)
    if known is None:  # one tree at most
        known = start.withColumn("idx", F.lit(0).cast("long"))
    else:
        known = children(known, ["root"])
    above = saved(
        ranks.join(known, "idx").select(
            F.col("name").alias("tree"), "path", F.col("digest").alias("subroot"), "root"
        )
    )

    kept = ["doc_id", "leaf", "subroot", "root", "path", *others]
    found = rows.filter("nodes = 1").join(above, "tree").select(*kept)
    runs = paths(trees, above)
    if runs is not None:
        placed_rows = rows.filter("nodes > 1").withColumns(
            {
                "run": F.floor(F.col("idx") / ARITY),
                "slot": F.pmod("idx", F.lit(ARITY)).cast("int"),
            }
        )
        longer = F.concat(F.array(step(F.col("digests"), F.col("slot"))), F.col("path"))
        several = placed_rows.join(runs, ["tree", "run"]).withColumn("path", longer)
        found = found.unionByName(several.select(*kept))
    return found


def proof_digest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: the manifest, with
    each row checked against it after some texts were put into lower case."""
    chosen = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 0
    text = F.translate(F.col("text").cast("string"), UPPER, UPPER.lower())
    text = F.when(F.coalesce(chosen, F.lit(False)), text).otherwise(F.col("text"))
    tampered = leaf([text if c == "text" else F.col(c) for c in COLUMNS])
    rows = manifest(docs, others={"tampered": tampered})
    folded = fold(F.col("tampered"), F.col("path"))
    return rows.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        digest(siblings(F.col("path"))).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
