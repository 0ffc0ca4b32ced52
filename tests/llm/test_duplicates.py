import hashlib
import math
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ordermart.llm import embedding_dedup, ngram_join, suffix_dedup
from ordermart.llm.components import components
from ordermart.llm.queries import QUERIES
from ordermart.llm.shingles import Bands, band_hashes, shingle_set, words_text

from .conftest import AWKWARD, SF


class Union:
    def __init__(self):
        self.up = {}

    def root(self, x):
        while self.up.get(x, x) != x:
            x = self.up[x]
        return x

    def tie(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


@pytest.mark.parametrize("n", [0, 1, 400])
def test_components(spark, n):
    rng = random.Random(n)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(n)]
    links += [(i, i + 1) for i in range(1000, 1000 + n // 8)] + [(3000, 3001 + i) for i in range(n)]
    u = Union()
    for a, b in links:
        u.tie(a, b)
    frame = spark.createDataFrame(links, "a long, b long")
    found = {r.node: r.root for r in components(frame).collect()}
    for x in {x for link in links for x in link}:
        assert found.get(x, x) == u.root(x)


# --- exact strings


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    for d in data:
        mark = np.zeros(len(d) + 1, dtype=int)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                mark[i] += 1
                mark[i + length] -= 1
        gone = np.cumsum(mark)[: len(d)] > 0
        kept = np.frombuffer(d, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        yield len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()


def told(r):
    return (r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)


def check_repeats(docs, given, length):
    found = suffix_dedup.remove_repeats(docs(given), length).collect()
    want = [(i, *w) for (i, _), w in zip(given, brute_repeats([t for _, t in given], length))]
    assert sorted(map(told, found), key=repr) == sorted(want, key=repr)


def passages(seed):
    """Texts of shared pieces, of few letters, periodic ones, and edited copies."""
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abc é") for _ in range(rng.randint(20, 400))) for _ in range(12)]
    out = []
    for _ in range(60):
        text = "".join(rng.choice(pool) + rng.choice(["", "x", "yz"]) for _ in range(rng.randint(0, 6)))
        if text and rng.random() < 0.3:
            i = rng.randrange(len(text))
            text = text[:i] + "#" + text[i + 1 :]
        out.append(text)
    out += ["a" * 700, "a" * 260, "ab" * 300, "abc" * 200 + "d" + "abc" * 200, "", None]
    return list(enumerate(out))


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_by_brute_force(docs, seed):
    check_repeats(docs, passages(seed), 100)


@pytest.mark.parametrize("given", [AWKWARD, []])
def test_repeats_in_awkward_rows(docs, given):
    given = [(i, t[:3000] if t else t) for i, t in given]
    check_repeats(docs, given, 64)


def test_repeats_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = [(r.doc_id, *w) for r, w in zip(rows, brute_repeats([r.text for r in rows], 200))]
    assert sorted(map(told, QUERIES["op2_suffix_dedup"](spark, SF).collect())) == sorted(want)


def test_strings_are_found_in_pieces_of_long_texts(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 500)
    rng = random.Random(1)
    rows = [bytes(rng.choice(b"abcd") for _ in range(n)) for n in (3000, 0, 99, 100, 5000)]
    places = defaultdict(list)
    for row, low, high, *_ in suffix_dedup.found_in(rows, 100):
        for r, a, b in zip(row.tolist(), low.tolist(), high.tolist()):
            places[r] += range(a, b + 1)
    for r, text in enumerate(rows):
        assert sorted(places[r]) == list(range(max(0, len(text) - 99)))


def test_merge_is_a_sort():
    rng = random.Random(3)
    runs = []
    for _ in range(7):
        words = sorted(bytes(rng.choice(b"ab") for _ in range(suffix_dedup.GRAM)) for _ in range(rng.randint(0, 40)))
        words += words[-1:] * 2
        rows = np.array([list(w) for w in words], np.uint8).reshape(-1, suffix_dedup.GRAM)
        known = suffix_dedup.common_prefixes(rows) if len(rows) else []
        runs.append(list(zip([int(k) for k in known], words)))
    found = list(suffix_dedup.merged([iter(r) for r in runs]))
    assert [w for *_, w in found] == sorted(w for r in runs for _, w in r)
    for (_, _, a), (_, prefix, b) in zip(found, found[1:]):
        same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
        assert prefix == same


@pytest.mark.parametrize("spread", [False, True])
def test_strings_of_a_group(spark, spread):
    rng = random.Random(1)
    stretches = [bytes(rng.choice(b"ab") for _ in range(60)) for _ in range(30)]
    rows = [(7, spread, False, t, t, 100, s) for t, s in enumerate(stretches)]
    rows += rows[:1]
    frame = spark.createDataFrame(rows, suffix_dedup.CUT)
    compare = suffix_dedup.compare_spread if spread else suffix_dedup.compare_gathered
    places = defaultdict(set)
    for r in compare(frame, 8).collect():
        places[r.doc_id] |= set(range(r.low - 100, r.high - 99))
    for t, text in enumerate(stretches):
        want = {
            i for i in range(53)
            if any(text[i : i + 8] in other for k, other in enumerate(stretches) if k != t)
        }
        assert places[t] == want


@pytest.mark.parametrize("together", [1, 4096])
def test_one_passage_in_most_texts_is_spread_over_ranges(docs, monkeypatch, together):
    monkeypatch.setattr(suffix_dedup, "RANGE_BYTES", 2000)
    monkeypatch.setattr(suffix_dedup, "SAMPLE_SHARE", 1)
    monkeypatch.setattr(suffix_dedup, "TOGETHER", together)
    rng = random.Random(5)

    def noise(n):
        return "".join(rng.choice("abcdefgh ") for _ in range(n))

    passage = noise(150)
    given = [(i, noise(rng.randint(0, 90)) + passage + noise(rng.randint(0, 90))) for i in range(120)]
    given += [(200 + i, t) for i, t in given[:10]] + passages(3)
    seen, borders = [], suffix_dedup.range_borders
    monkeypatch.setattr(
        suffix_dedup, "range_borders", lambda *a: seen.append(borders(*a)) or seen[-1]
    )
    check_repeats(docs, given, 100)
    suffixes = [b[: suffix_dedup.GRAM] for b in seen[0]]
    assert len(set(seen[0])) > len(set(suffixes))  # one suffix's group lies in several ranges


def test_a_batch_is_cut_by_slices():
    """10,000 rows with many spans: Python holds those of a slice, not of the batch."""
    n, length = 10_000, 200
    spans = [{"low": 500 * i, "high": 500 * i} for i in range(8)]
    text = pa.array(["x" * 200 + "é" * 1900] * (n - 2) + [None, ""])
    places = pa.array([spans] * (n - 3) + [None, spans, None])
    tracemalloc.start()
    found = suffix_dedup.cut_texts(text, places, length)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4_000_000
    data = text[0].as_py().encode()
    left = b"".join(data[a:b] for a, b in zip(range(200, 4000, 500), range(500, 4001, 500)))
    want = left.decode("utf-8", "ignore")
    assert found.to_pylist() == [want] * (n - 3) + [text[0].as_py(), None, ""]
    assert len(suffix_dedup.cut_texts(text[:0], places[:0], length)) == 0


def test_cut_repeats_keeps_columns(docs):
    shared = "é shared passage " * 20
    given = [(1, "one " + shared), (2, shared + " two"), (3, None), (4, "alone")]
    frame = docs(given)
    found = suffix_dedup.cut_repeats(frame)
    assert found.columns == frame.columns
    texts = {r.doc_id: r.text for r in found.collect()}
    assert texts[3] is None and texts[4] == "alone"
    assert len(texts[1]) < 10 and len(texts[2]) < 10


# --- near copies of texts


def brute_near(given, similarity=0.8):
    """doc number -> (class, links), by all pairs that share a shingle."""
    sets, holders = [], defaultdict(list)
    for k, (_, t) in enumerate(given):
        w = (t or "").lower().split()
        s = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        sets.append(s)
        for g in s:
            holders[g].append(k)
    pairs = {(a, b) for h in holders.values() for a in h for b in h if a < b}
    u, n = Union(), Counter()
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if both / (len(sets[a]) + len(sets[b]) - both) >= similarity:
            n[a] += 1
            n[b] += 1
            u.tie(a, b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(given):
        if i is not None:
            least[u.root(k)].append(i)
    return [
        (i, min(least[u.root(k)], default=None), n[k]) for k, (i, _) in enumerate(given)
    ]


def check_near(docs, given):
    found = ngram_join.join(docs(given)).collect()
    got = [(r.doc_id, r.class_id, r.n_links) for r in found]
    assert sorted(got, key=repr) == sorted(brute_near(given), key=repr)
    return found


@pytest.mark.parametrize("given", [AWKWARD, []])
def test_near_copies_in_awkward_rows(docs, given):
    check_near(docs, given)


def test_large_group_of_near_copies_is_split(docs):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    given = []
    for i in range(600):
        own = list(words)
        for _ in range(rng.randint(0, 5)):
            own[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        given.append((i, " ".join(own)))
    given += [(1000 + i, given[0][1].upper()) for i in range(50)]
    found = ngram_join.join(docs(given)).collect()
    brute = brute_near(given)
    want = {i: n for i, _, n in brute}
    got = {r.doc_id: r.n_links for r in found}
    assert sum(got.values()) >= 0.995 * sum(want.values())
    assert all(got[i] <= want[i] for i in want)
    assert {r.doc_id: r.class_id for r in found} == {i: c for i, c, _ in brute}


def test_no_link_of_a_large_group_near_the_threshold_is_lost(docs):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    given = []
    for i in range(700):
        own = list(words)
        for _ in range(3):  # two texts have about 0.82
            own[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        given.append((i, " ".join(own)))
    check_near(docs, given)


def test_near_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    found = QUERIES["op3_ngram_join"](spark, SF).collect()
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in found)
    assert got == sorted(brute_near([tuple(r) for r in rows]))


def test_one_of_each_class_stays(docs):
    given = [*AWKWARD, (90, "The same row twice is two documents of the same words"), (91, None)]
    frame = docs(given)
    found = ngram_join.keep_first(frame)
    assert found.columns == frame.columns
    want = [(i, t) for i, t in dict.fromkeys(given) if i != 90]
    want += [(i, t) for i, t in given if not (t or "").split() and given.count((i, t)) > 1]
    assert sorted([(r.doc_id, r.text) for r in found.collect()], key=repr) == sorted(want, key=repr)


def test_near_copies_that_share_an_id_leave_one(docs):
    """Near copies under one id, without any, and repeated rows: one of each class."""
    words = [f"w{i}" for i in range(60)]
    near = [" ".join(words[:i] + ["x"] + words[i + 1 :]) for i in (0, 30, 59)]
    other = " ".join(f"v{i}" for i in range(40))
    for ids in ((7, 7, 7), (None, None, None), (None, 3, 3)):
        given = [*zip(ids, near), (ids[0], other), (ids[0], other), (9, "short text")]
        frame = docs(given).withColumn("__row", F.lit("kept")).withColumn("__nth", F.lit(5))
        got = ngram_join.keep_first(frame)
        assert got.columns == frame.columns
        assert sorted(r.text == other for r in got.collect()) == [False, False, True]


def test_texts_without_ids_do_not_multiply(spark, docs):
    """600 rows without id in 300 classes: each text meets its own node only."""
    rows = []
    for i in range(300):
        words = [f"a{i}x{j}" for j in range(50)]
        rows += [(None, " ".join(words)), (None, " ".join([*words[:-1], "end"]))]
    frame = docs(rows)
    signed = ngram_join.signatures(frame, 5, Bands.choose(0.8, 0.999))
    members = signed.withColumn("node", F.monotonically_increasing_id()).select("doc_id", "hash", "node")
    assert ngram_join.node_texts(frame, members).count() == 600
    found = ngram_join.join(frame).collect()
    assert len(found) == 600 and {r.n_links for r in found} == {1}


def test_choice_shuffles_documents_once_and_without_python(docs):
    found = ngram_join.keep_first(docs([(None, "a b"), (None, "A  b"), (None, ""), (None, "")]))
    assert sorted(r.text for r in found.collect())[:2] == ["", ""]
    assert found.count() == 3
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    assert plan.split("Initial Plan")[0].count("hashpartitioning(__row") <= 1


def test_bands_reach_their_recall():
    bands = Bands.choose(0.8, 0.999)
    assert 1 - (1 - 0.8**bands.rows) ** bands.count >= 0.999
    rng = np.random.default_rng(1)
    hits = 0
    for _ in range(300):
        common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (160, 20, 20))
        x, y = (np.unique(np.concatenate([common, own])) for own in (a, b))
        hits += bool(set(band_hashes(x, bands)) & set(band_hashes(y, bands)))
    assert hits >= 297


def test_shingles_are_the_words_runs():
    rng = random.Random(2)
    names = {}
    for _ in range(100):
        words = [rng.choice(["a", "b", "ab", "ba", "é"]) for _ in range(rng.randint(0, 40))]
        runs = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
        found = shingle_set(words_text("  ".join(words).upper()))
        assert len(found) == len(runs)
        for r in runs:
            (h,) = shingle_set(" ".join(r), len(r))
            assert names.setdefault(int(h), r) == r and h in found


# --- near copies of vectors


def brute_vectors(given, threshold=0.98):
    good = [
        v is not None and label is not None and len(v) > 0
        and all(x is not None and np.isfinite(x) for x in v) and any(v)
        for _, v, label in given
    ]
    u, n = Union(), Counter()
    for a in range(len(given)):
        for b in range(a):
            (_, v, lv), (_, w, lw) = given[a], given[b]
            if good[a] and good[b] and lv == lw and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    n[a] += 1
                    n[b] += 1
                    u.tie(a, b)
    least = defaultdict(list)
    for k, (i, *_) in enumerate(given):
        if i is not None:
            least[u.root(k)].append(i)
    roots = [min(least[u.root(k)], default=None) for k in range(len(given))]
    return [(i, n[k], roots[k], i == roots[k]) for k, (i, *_) in enumerate(given)]


def check_vectors(spark, given):
    frame = spark.createDataFrame(given, "vec_id long, embedding array<float>, label int")
    frame = frame.selectExpr("*", "'x' AS node", "'x' AS v", "'x' AS links", "'x' AS filter")
    found = embedding_dedup.near_duplicates(frame).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(brute_vectors(given), key=repr)


def test_vectors_in_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    given = [
        (1, [1.0, 0.0, 0.0], 1), (2, [2.0, 0.0, 0.0], 1), (3, [1.0, 0.0, 0.0], 2),
        (4, [1.0, 0.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0, 0.0], 1), (7, [nan, 0.0, 1.0], 1),
        (8, [inf, 0.0, 1.0], 1), (9, [None, 0.0, 1.0], 1), (10, [], 1), (11, [1.0, 0.0], 1),
        (12, [1.0, 0.0], 1), (12, [1.0, 0.0], 1), (13, [3e38, 0.0], 1), (14, [1.0, 0.1, 0.0], 1),
        (None, [0.0, 1.0, 0.0], 1), (15, [5.0], 1), (16, [7.0], 1), (17, [-7.0], 1),
    ]
    check_vectors(spark, given)
    check_vectors(spark, [])


def test_large_group_of_vectors_is_split(spark):
    rng = np.random.default_rng(1)
    centre = rng.standard_normal(32)
    vectors = centre + 0.11 * rng.standard_normal((1300, 32))
    check_vectors(spark, [(i, v.tolist(), 1) for i, v in enumerate(vectors.astype(np.float32))])


def test_filters_find_nearly_all_links():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = a + 0.0252 * rng.standard_normal(a.shape)
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    near = (a * b).sum(axis=1) >= 0.98
    code = embedding_dedup.code(64, 32)
    x, y = code.decode(a, 32)[0], code.decode(b, 32)[0]
    assert (x[:, :, None] == y[:, None, :]).any(axis=(1, 2))[near].mean() >= 0.999


@pytest.mark.parametrize("size", [2, 3, 8, 16, 64, 384])
@pytest.mark.parametrize("vectors", [10, 2000, 10**7])
def test_recall_is_the_same_for_every_length_and_number(size, vectors):
    """On pairs of cosine 0.98 that the scheme wasn't chosen on."""
    words, filters = embedding_dedup.scheme(size, vectors, 32, 0.98)
    rng = np.random.default_rng([9, size])
    a, b = rng.standard_normal((2, 3000, size))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    code = embedding_dedup.code(size, words)
    x, y = (code.decode(v, filters)[0] for v in (a, 0.98 * a + math.sqrt(1 - 0.98**2) * b))
    assert np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(x, y)]) >= 0.998


@pytest.mark.parametrize("size", [1, 2, 5])
def test_short_vectors(spark, size):
    rng = np.random.default_rng(size)
    vectors = rng.standard_normal((150, size)).astype(np.float32)
    check_vectors(spark, [(i, v.tolist(), 1) for i, v in enumerate(vectors)])


def test_decoding_is_exact():
    rng = np.random.default_rng(3)
    v = rng.standard_normal((5, 12))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    code = embedding_dedup.code(12, 8)
    place, total = code.decode(v, 20)
    sums = np.zeros((5, 1))
    for p in code.block_products(v):
        sums = (sums[:, :, None] + p[:, None, :]).reshape(5, -1)
    np.testing.assert_allclose(total, -np.sort(-sums, axis=1)[:, :20])
    np.testing.assert_allclose(np.take_along_axis(sums, place, axis=1), total)


def test_vector_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label")
    found = QUERIES["op5_embedding_dedup"](spark, SF).collect()
    want = brute_vectors([tuple(r) for r in rows.collect()])
    assert sorted(map(tuple, found)) == sorted(want)
