"""Lexical search, curve sharding and Merkle manifests against plain Python."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ordermart.llm import curve_shards, lexical_search, merkle
from ordermart.session import shared_dir

from .conftest import AWKWARD

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
def key(row):
    return tuple(map(repr, row))


def full_rows(rows):
    """(doc_id, text) rows with metadata that has nulls and ties."""
    return [
        (d, t, [None, "en", "", "é"][i % 4], ["a", "a", None][i % 3], [None, 7, 7, -1, i][i % 5])
        for i, (d, t) in enumerate(rows)
    ]


@pytest.fixture
def documents(spark):
    def frame(rows):
        df = spark.createDataFrame(rows, DOCUMENT)
        for name in ("tree", "idx", "uid", "nodes", "run", "path", "size", "curve", "shard",
                     "slot", "place", "before", "terms", "tfs", "n", "dim0"):
            df = df.withColumn(name, F.lit("other"))
        return df

    return frame


# Lexical search.

RUN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans(merkle.UPPER, merkle.UPPER.lower())


def plain_terms(text):
    return [w.translate(LOWER) for w in RUN.findall(text or "")]


def plain_search(docs, items, k=50):
    counted = [(d, collections.Counter(plain_terms(t))) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    total, length = len(counted), sum(n for *_, n in counted)
    df = collections.Counter(w for _, c, _ in counted for w in c)
    weight = {w: math.floor(1000 * math.log((2 * total + 2) / (2 * n + 1))) for w, n in df.items()}
    out = []
    for item, text in items:
        found = []
        for d, c, n in counted:
            m = 100 - 50 + (50 * n * total) // length
            parts = [
                weight[w] * ((10**9 * c[w]) // (1000 * c[w] + 20 * m))
                for w in set(plain_terms(text)) & set(c)
            ]
            if sum(parts) > 0:
                found.append((-sum(parts), d is not None, d or 0, d))
        found.sort(key=lambda r: r[:3])
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(found[:k], start=1)]
    return sorted(out, key=key)


def zipf_texts(n, seed=5):
    """Texts of words of very different frequency, with copies."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    texts = [" ".join(rng.choices(words, weights, k=rng.randint(1, 60))) for _ in range(n)]
    return [texts[i // 3] if i % 3 == 2 else t for i, t in enumerate(texts)]


def test_terms():
    for text in ("Ab-c_D 9É\x00ß x İ", "ONE.two", "", " \n", "a" * 100_000, "漢字か@é`z{y"):
        assert [t.decode() for t in lexical_search.terms(text.encode())] == plain_terms(text)


def test_search_equals_brute_force(spark, documents, monkeypatch):
    rows = [(i // 2 if i % 10 == 0 else i, t) for i, t in enumerate(zipf_texts(700))]
    rows += AWKWARD + [(None, "w1 w2 w250"), (None, "w1 w2 w250")]
    items = [(0, "w1 w2 w3 w250 w299 W299"), (0, "w1 w2 w3 w250 w299"), (1, None), (2, ""), (3, "nowhere"),
             (None, "w0 w7 id words"), (5, " ".join(f"w{i}" for i in range(300)))]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("query", F.lit(1))
    want = plain_search(rows, items)
    docs = documents(full_rows(rows))
    got = sorted((tuple(r) for r in lexical_search.search(docs, asked).collect()), key=key)
    assert got == want
    monkeypatch.setattr(lexical_search, "GROUPS", 3)
    got = lexical_search.search(docs.repartition(7), asked, query_terms=5)
    assert sorted((tuple(r) for r in got.collect()), key=key) == want
    assert lexical_search.search(docs.limit(0), asked).count() == 0
    assert lexical_search.search(docs, asked.limit(0)).count() == 0


def test_accumulators_stay_limited_and_exact():
    """Most documents hold only frequent words: they get no accumulator, with the k best
    the same as of all sums."""
    texts = zipf_texts(4000)
    counts = [collections.Counter(int(w[1:]) for w in t.split()) for t in texts]
    df = np.bincount([t for c in counts for t in c], minlength=300)
    weights = [math.floor(1000 * math.log((2 * len(texts) + 2) / (2 * int(d) + 1))) for d in df]
    n = np.array([sum(c.values()) for c in counts])
    stats = lexical_search.Corpus(len(texts), int(n.sum()), np.array(weights), df)
    block = lexical_search.Block(
        pa.array(range(len(texts)), pa.int64()), n,
        pa.array([list(c) for c in counts], pa.list_(pa.int32())),
        pa.array([list(c.values()) for c in counts], pa.list_(pa.int32())), stats,
    )
    looked_up = []
    lists = block.list_of

    class Watched(lexical_search.Block):
        def __init__(self):
            self.__dict__.update(block.__dict__)

        def list_of(self, term):
            looked_up.append(int(term))
            return lists(term)

    rng = random.Random(1)
    for _ in range(20):
        query = np.array(rng.sample(range(300), 12) + [0, 1])
        query = query[np.lexsort((query, df[query]))]
        sums = np.zeros(len(texts), dtype=np.int64)
        for term in query:
            docs, parts = lists(term)
            sums[docs] += parts
        order = [d for d in np.lexsort((np.arange(len(texts)), -sums))[:10] if sums[d] > 0]
        docs, scores = Watched().search(query, 10, 0)
        assert list(docs) == order and list(scores) == list(sums[order])
        floor = int(sums[order[-1]])
        docs, scores = Watched().search(query, 10, floor)
        assert list(docs) == order and list(scores) == list(sums[order])


# Curve sharding.


def test_curve_visits_neighbours():
    for dims, bits in ((1, 5), (2, 4), (3, 3), (4, 2)):
        grid = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        index = curve_shards.curve_index(grid, bits)
        assert sorted(index) == list(range(len(grid)))
        steps = np.abs(np.diff(grid[np.argsort(index)], axis=0)).sum(axis=1)
        assert (steps == 1).all()


@pytest.mark.parametrize("law", curve_shards.LAWS)
def test_shards_keep_their_law(documents, law):
    rows = [(i, "x" * (i * 37 % 500)) for i in range(900)] + AWKWARD
    rows += [(None, "copy of one text")] * 450 + [(7, "same row")] * 100
    got = curve_shards.shard_digest(documents(full_rows(rows)), 24, law).collect()
    want = collections.Counter(
        (d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows
    )
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots = collections.defaultdict(list)
    load = collections.Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        load[r.shard] += r["size"] if law == "bytes" else 1
        assert r.grown_shard is None and r.law == law
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(24))
    if law == "rows":
        assert len(slots) == 24 and max(load.values()) - min(load.values()) <= 1
    else:
        largest = max(size for _, size, _ in want)
        share = sum(load.values()) / 24
        assert max(load.values()) <= share + largest
    # along the shards the curve only goes up
    ends = [(min(r.curve for r in got if r.shard == s), max(r.curve for r in got if r.shard == s))
            for s in sorted(slots)]
    assert all(a[1] <= b[0] for a, b in itertools.pairwise(ends))


def test_few_rows_and_none(documents):
    assert curve_shards.shard_digest(documents([])).count() == 0
    got = curve_shards.shard_digest(documents(full_rows([(1, "a"), (2, None)])), law="rows").collect()
    assert sorted((r.shard, r.slot) for r in got) == [(0, 0), (12, 0)]


def test_cells_follow_null_nan_and_other_types(spark):
    df = spark.createDataFrame(
        [(i, "t", float("nan") if i % 3 == 0 else None if i % 3 == 1 else float(i), i % 2 == 0)
         for i in range(60)], "doc_id long, text string, x double, b boolean",
    )
    got = curve_shards.assign(df, 4, "rows", dims=("x", "b"), bits=4).collect()
    assert sorted(collections.Counter(r.shard for r in got).items()) == [(s, 15) for s in range(4)]


def test_files_can_be_skipped(spark, documents):
    """A filter on any dimension touches few of the shards, as each spans little of it."""
    rng = random.Random(2)
    rows = [(i, "x" * rng.randint(0, 50), f"l{rng.randint(0, 15)}", f"s{rng.randint(0, 63)}",
             rng.randint(0, 10_000)) for i in range(4000)]
    docs = spark.createDataFrame(rows, DOCUMENT)
    path = shared_dir(spark)
    curve_shards.write_shards(docs, path, shards=64, files=2)
    back = spark.read.parquet(path)
    assert sorted(map(tuple, back.select(*docs.columns).collect())) == sorted(rows)
    spans = back.groupBy("shard").agg(
        *[f(c).alias(f"{f.__name__}_{c}") for c in curve_shards.DIMENSIONS for f in (F.min, F.max)]
    ).collect()
    assert len(spans) == 64
    for c, value in (("lang", "l3"), ("source", "s17"), ("n_chars", 4321)):
        touched = sum(r[f"min_{c}"] <= value <= r[f"max_{c}"] for r in spans)
        assert touched <= 64 * 0.6, (c, touched)


# Merkle manifest.


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    doc_id, text, lang, source, n_chars = row
    cells = (doc_id, source, lang, n_chars, text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in cells))


def plain_tree(nodes):
    """The root, and each leaf's steps of (before, after)."""
    steps = [[] for _ in nodes]
    under = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(a, min(a + 8, len(nodes))) for a in range(0, len(nodes), 8)]
        for run in runs:
            for j in run:
                step = ("".join(nodes[i] for i in run if i < j), "".join(nodes[i] for i in run if i > j))
                for member in under[j]:
                    steps[member].append(step)
        nodes, under = (
            [sha("".join(nodes[i] for i in run)) for run in runs],
            [[m for i in run for m in under[i]] for run in runs],
        )
    return nodes[0], steps


def plain_proofs(rows):
    trees = collections.defaultdict(list)
    for row in rows:
        doc_id, text = row[:2]
        changed = row
        if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0:
            changed = (doc_id, text.translate(LOWER), *row[2:])
        trees[row[2]].append((doc_id, plain_leaf(row), plain_leaf(changed)))
    names = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    for name in names:
        trees[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    grown = [plain_tree([r[1] for r in trees[name]]) for name in names]
    root, above = plain_tree([g[0] for g in grown])
    out = []
    for name, (subroot, steps), upper in zip(names, grown, above):
        for (doc_id, own, changed), path in zip(trees[name], steps):
            x = changed
            for before, after in path + upper:
                x = sha(before + x + after)
            proof = sha("".join(b + a for b, a in path + upper))
            out.append((doc_id, own, subroot, root, proof, x, x == root))
    return sorted(out, key=key)


@pytest.mark.parametrize(
    "counts",
    [{"en": 1}, {None: 2}, {"en": 9}, {"en": 8, "fr": 1, None: 65}, {f"l{i}": 1 + i % 3 for i in range(75)}],
    ids=str,
)
def test_manifest_equals_brute_force(documents, counts):
    ids = itertools.count(10)
    rows = [(next(ids), "Some Text", lang, "s", 9) for lang, n in counts.items() for _ in range(n)]
    got = merkle.proof_digest(documents(rows)).collect()
    assert sorted(map(tuple, got), key=key) == plain_proofs(rows)


def test_manifest_of_awkward_rows(documents):
    rows = full_rows(AWKWARD + [(None, "No Id")] * 3 + [(i // 2, "ONE") for i in range(8, 40)])
    got = merkle.proof_digest(documents(rows)).collect()
    assert sorted(map(tuple, got), key=key) == plain_proofs(rows)
    assert {r.verified for r in got} == {True, False}
    assert merkle.proof_digest(documents([])).count() == 0
