import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from ordermart.llm import pu_learning, secret_scan
from ordermart.llm.common import saved
from ordermart.session import shared_dir

from .conftest import AWKWARD
from .test_duplicates import brute_near
from .test_tokens import check_packing

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = saved(stage(spark, docs, SF))
        assert docs.columns == columns
        counts.append(docs.count())
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    assert counts[0] > counts[1] > counts[2] == counts[3] == counts[4]
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    good = {r.doc_id for r in labels if r.quality == 1}
    assert len(good & seen["quality classifier"].keys()) >= 0.98 * len(good)
    assert len({" ".join(t.lower().split()) for t in seen["n-gram Jaccard join"].values()}) == counts[2]
    after = seen["secret scans"]
    assert not any("AKIA" in t or "password=" in t for t in after.values())
    assert any("<secret>" in t for t in after.values())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == after.keys()


def without_near_copies(rows):
    """The row with the smallest id of each class, repeated rows once, all rows without words."""
    kept, seen = [], set()
    for (i, t), (_, least, _) in zip(rows, brute_near(rows)):
        blank = not (t or "").split()
        if blank or (i == least and (i, t) not in seen):
            kept.append((i, t))
            seen.add((i, t))
    return kept


def without_repeats(rows, length=200):
    data = [(t or "").encode() for _, t in rows]
    places = {}
    for d in data:
        for i in range(len(d) - length + 1):
            s = hash(d[i : i + length])
            places[s] = places.get(s, 0) + 1
    for (i, t), d in zip(rows, data):
        gone = np.zeros(len(d), dtype=bool)
        for j in range(len(d) - length + 1):
            if places[hash(d[j : j + length])] > 1:
                gone[j : j + length] = True
        left = np.frombuffer(d, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
        yield i, t if t is None or not gone.any() else left


def without_secrets(rows, formats):
    for i, t in rows:
        base = secret_scan.base_spans(t or "")
        spans = [(a, b) for a, b, _ in base]
        spans += secret_scan.format_spans(t or "", base, formats, 5.0) if t else []
        out, at = "", 0
        for a, b in sorted(spans):
            if a >= at:
                out += t[at:a] + "<secret>"
            at = max(at, b)
        yield i, t if t is None else out + t[at:]


@pytest.fixture
def folder(spark):
    """The smallest tables with awkward rows and columns of names that stages use."""
    path = shared_dir(spark)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(i if i is None else 10**6 + i, t if t is None or len(t) < 10**4 else t[:9000])
            for i, t in AWKWARD if t != "another text under the same id"]
    more = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.unionByName(more, allowMissingColumns=True)
    for name in ("hash", "key", "node", "own", "first", "score", "spans", "n", "__row", "__nth"):
        docs = docs.withColumn(name, F.lit("other"))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{SMALL}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


def test_run_is_a_plain_chain_of_the_stages(spark, folder):
    """Rows of run() against plain Python, given the classifier and the formats."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = pu_learning.learn(docs, labels, "quality")
    rows = [(i, t) for i, t in rows if model.score(t or "") >= 0.3]
    rows = without_near_copies(rows)
    rows = list(without_repeats(rows))
    formats = secret_scan.learn(spark.createDataFrame(rows, "doc_id long, text string"))
    rows = list(without_secrets(rows, formats))
    assert check_packing(corpus_pipeline.run(spark, folder).collect(), rows) == 0


def test_run_of_empty_documents(spark, folder):
    path = shared_dir(spark)
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0
