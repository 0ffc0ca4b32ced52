r"""Ranked lexical search, term at a time with a limited set of accumulators.

A text's terms are the runs of digits, letters and characters beyond ASCII, only A to Z
in lower case. With N documents that have a term, L terms in all of them, n terms in
one, df documents that hold a term and tf occurrences in one document,

    weight(term)      = floor(1000 * ln((2N + 2) / (2df + 1)))
    m(document)       = 100 - 50 + (50 n N) div L
    score             = sum of weight * ((10^9 tf) div (1000 tf + 20 m))

over a query's terms, once each, all but the logarithm in whole numbers. Each query gets
its k highest scores above 0.

One pass over the texts turns each document into its length and its counts of the
queries' terms; all counts of the corpus come out of that. The documents of a task are
then searched in blocks. In a block a query's terms run from the rarest to the most
frequent. Each adds its part to the accumulators of its documents, and makes new ones
while a document without one could still get among the k best: once the greatest parts
of the terms left sum to less than the k-th highest partial score, none can. From then on
long lists are only looked up for the documents that still can, whose scores end exact.
The k best scores that a task has seen so far in earlier blocks count for that bound too.
The tasks' lists are merged over a tree of groups, so that no task sees more than a few
lists of a query.

Queries are taken in runs of a bounded number of terms, and each run is one search.
Rows are documents of their own also where ids or whole rows repeat; a null id comes
before all others among equal scores. Null, empty and blank texts have no term, nor can
they be found. Repeated query ids each get their results. Empty tables give no rows.
Other columns don't matter, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ordermart.llm.common import map_slices, saved

#: Bytes of terms stay, A-Z becomes a-z, all others part terms. In UTF-8 only
#: characters beyond ASCII have bytes from 0x80 on.
TO_TERMS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20
    for b in range(256)
)
#: Documents, and counts of terms, that are searched as one block.
BLOCK_DOCS = 65_536
BLOCK_COUNTS = 8_000_000
#: Pairs of query and term that are searched at once.
QUERY_TERMS = 250_000
#: Groups of task lists in the first merge.
GROUPS = 64


def terms(text: bytes) -> list[bytes]:
    return text.translate(TO_TERMS).split()


@dataclass(frozen=True)
class Queries:
    """A run of queries: their ids, and each one's numbers of terms in `vocabulary`."""

    ids: list[int | None]
    terms: list[list[int]]
    vocabulary: dict[bytes, int]


@dataclass(frozen=True)
class Corpus:
    """N, L, and each vocabulary term's weight and number of documents."""

    docs: int
    length: int
    weights: np.ndarray
    df: np.ndarray


def query_runs(items: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[Queries]:
    """The queries with terms, in runs of at most `most` terms (or one query)."""
    ids, numbers, vocabulary, size = [], [], {}, 0
    rows = items.select(F.col(id_col).cast("long"), F.col(text_col)).toLocalIterator()
    for item, text in rows:
        found = sorted(set(terms((text or "").encode())))
        if ids and size + len(found) > most:
            yield Queries(ids, numbers, vocabulary)
            ids, numbers, vocabulary, size = [], [], {}, 0
        if found:
            ids.append(item)
            numbers.append([vocabulary.setdefault(t, len(vocabulary)) for t in found])
            size += len(found)
    if ids:
        yield Queries(ids, numbers, vocabulary)


def counted(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """doc_id, n, terms, tfs of every document with a term; `terms` are numbers of the
    vocabulary's terms in it, with their occurrences."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batch: pa.RecordBatch) -> dict:
        known = shared.value
        out = {"doc_id": [], "n": [], "terms": [], "tfs": []}
        ids = batch.column("doc_id").to_pylist()
        for doc, text in zip(ids, batch.column("text").cast(pa.binary()).to_pylist()):
            words = terms(text or b"")
            if words:
                found = [(known[w], c) for w, c in Counter(words).items() if w in known]
                out["doc_id"].append(doc)
                out["n"].append(len(words))
                out["terms"].append([t for t, _ in found])
                out["tfs"].append([c for _, c in found])
        return out

    plain = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )
    return map_slices(plain, count, "doc_id long, n long, terms array<int>, tfs array<int>")


def corpus(rows: DataFrame, size: int) -> Corpus:
    """The counts over all documents; one number for each term of a bounded vocabulary
    comes to the driver."""
    sums = rows.agg(F.count("*").alias("docs"), F.sum("n").alias("length")).first()
    df = np.zeros(size, dtype=np.int64)
    for term, n in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[term] = n
    weights = [math.floor(1000 * math.log((2 * sums["docs"] + 2) / (2 * int(d) + 1))) for d in df]
    return Corpus(sums["docs"], sums["length"] or 0, np.array(weights, dtype=np.int64), df)


def length_terms(n: np.ndarray, stats: Corpus) -> np.ndarray:
    """m of documents with n terms; in Python's integers where 64 bits are too few."""
    if 50 * int(n.max()) * stats.docs < 2**63:
        return 50 + (50 * n * stats.docs) // stats.length
    return np.array([50 + 50 * int(x) * stats.docs // stats.length for x in n], dtype=np.int64)


class Block:
    """The inverted lists of some documents: each term's documents and parts of scores."""

    def __init__(self, ids: pa.Array, n: np.ndarray, terms: pa.ListArray, tfs: pa.ListArray, stats: Corpus):
        missing = np.asarray(ids.is_null())
        ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        order = np.lexsort((ids, ~missing))  # null first, then by id
        self.missing, self.ids = missing[order], ids[order]
        lengths = np.diff(terms.offsets.to_numpy())
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        doc = np.repeat(place, lengths)
        term = terms.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        tf = tfs.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        m = np.repeat(length_terms(n, stats), lengths)
        part = stats.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
        by = np.lexsort((doc, term))
        term, self.doc, self.part = term[by], doc[by], part[by]
        self.at = np.searchsorted(term, np.arange(len(stats.weights) + 1))
        self.size = len(order)
        top = np.zeros(len(stats.weights), dtype=np.int64)
        np.maximum.at(top, term, self.part)
        self.top = top

    def list_of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        return (
            self.doc[self.at[term] : self.at[term + 1]],
            self.part[self.at[term] : self.at[term + 1]],
        )

    def search(self, query: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the k best above 0, best first. `query` has its terms
        from the rarest on. Documents below `floor` may be missing."""
        query = query[self.top[query] > 0]
        left = np.cumsum(self.top[query][::-1])[::-1]
        total = np.zeros(self.size, dtype=np.int64)
        alive = None
        for i, term in enumerate(query):
            # the k-th partial score is at most what the terms so far can give
            if i and left[0] - left[i] > left[i]:
                kth = floor
                if self.size >= k:
                    kth = max(kth, int(np.partition(total, self.size - k)[self.size - k]))
                if left[i] < kth:
                    alive = np.flatnonzero(total + left[i] >= kth)
                    alive = alive[total[alive] > 0]
                    break
            docs, parts = self.list_of(term)
            total[docs] += parts
        if alive is None:
            alive = np.flatnonzero(total)
            scores = total[alive]
        else:
            scores = total[alive]
            for term in query[i:]:
                docs, parts = self.list_of(term)
                at = np.minimum(np.searchsorted(docs, alive), len(docs) - 1)
                scores += np.where(docs[at] == alive, parts[at], 0)
        if len(alive) > k:
            least = np.partition(scores, len(alive) - k)[len(alive) - k]
            near = scores >= least
            alive, scores = alive[near], scores[near]
        best = np.lexsort((alive, -scores))[:k]  # documents are numbered in order of id
        return alive[best], scores[best]


def task_lists(rows: DataFrame, queries: Queries, stats: Corpus, k: int) -> DataFrame:
    """query, doc_id, score: for each task's documents the k best of every query."""
    schema = "query int, doc_id long, score long"
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))
    weighty = [np.array([t for t in q if stats.weights[t] > 0], dtype=np.int64) for q in queries.terms]
    rarest = [q[np.lexsort((q, stats.df[q]))] for q in weighty]
    shared = rows.sparkSession.sparkContext.broadcast((rarest, stats))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, docs, counts = [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                held.append(part)
                docs += part.num_rows
                counts += len(part.column("terms").flatten())
                if docs >= BLOCK_DOCS or counts >= BLOCK_COUNTS:
                    yield pa.Table.from_batches(held)
                    held, docs, counts = [], 0, 0
        if docs:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarest, stats = shared.value
        best: list[list[tuple]] = [[] for _ in rarest]
        for block in blocks(batches):
            c = {name: block.column(name).combine_chunks() for name in block.column_names}
            index = Block(c["doc_id"], c["n"].to_numpy(), c["terms"], c["tfs"], stats)
            for q, query in enumerate(rarest):
                floor = -best[q][k - 1][0] if len(best[q]) == k else 0
                docs, scores = index.search(query, k, floor)
                found = zip(scores, index.missing[docs], index.ids[docs])
                new = [(-int(s), not m, int(d)) for s, m, d in found]
                best[q] = sorted(best[q] + new)[:k]
        for at in range(0, len(best), 1024):
            out = [(q, d if there else None, -s) for q in range(at, min(at + 1024, len(best)))
                   for s, there, d in best[q]]
            columns = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_pydict(dict(zip(arrow.names, map(list, columns))), schema=arrow)

    return rows.mapInArrow(run, schema)


def merged(lists: DataFrame, k: int) -> DataFrame:
    """The k best of each query out of the tasks' lists, in two steps."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    dealt = lists.withColumn("part", F.spark_partition_id() % GROUPS)
    first = Window.partitionBy("query", "part").orderBy(*order)
    short = dealt.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
    last = Window.partitionBy("query").orderBy(*order)
    short = short.drop("rank", "part").withColumn("rank", F.row_number().over(last))
    return short.filter(F.col("rank") <= k)


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    query_terms: int = QUERY_TERMS,
) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item."""
    spark = docs.sparkSession
    found = []
    for queries in query_runs(items, item_col, item_text_col, query_terms):
        rows = saved(counted(docs, queries.vocabulary, id_col, text_col))
        stats = corpus(rows, len(queries.vocabulary))
        top = merged(task_lists(rows, queries, stats, k), k)
        names = spark.createDataFrame(
            list(enumerate(queries.ids)), "query int, item_id long"
        )  # as many rows as the run has queries
        found.append(saved(top.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    result = found[0]
    for part in found[1:]:
        result = result.unionByName(part)
    return result
