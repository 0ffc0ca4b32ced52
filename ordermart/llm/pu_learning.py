"""Text classifiers by non-negative positive-unlabelled learning.

Only positives are trusted; everything else is unlabelled text, in which a share of
positives, the class prior, is hidden. The risk of calling unlabelled text negative
is corrected by that share of the positives' own risk, and may not fall below zero:
where it does, the step goes back instead. The classifier is a linear model in numpy
on the words that tell positives from unlabelled text, and on how letters, signs,
repeated words and repeated lines make up a text.

The labelled sample is bounded by `positives` and `unlabelled`, chosen by the hash of
the id; the prior is the share of label 1 among all labelled rows; every text is
scored whole. Held-out rows, crc32 of the id as text divisible by five, are used for
nothing but scores. Label, language, source and id never enter a score.

Null and empty texts get the score of a text without any feature. Without a positive
example all scores equal the prior. Repeated rows are scored each for itself; an
empty table gives no rows. Labels that are null count as missing; of several labels
for a document each counts.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordermart.llm.common import id_and_text, map_slices, saved, texts

#: Signs become spaces before a text is split into words.
SIGNS = {c: " " for c in range(128) if not chr(c).isalnum()}
SHAPES = 134


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no model may learn from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def words_of(text: str) -> list[str]:
    return text.lower().translate(SIGNS).split()


def marks_of(words: list[str]) -> set[str]:
    """A text's words, and beginnings of words, which inflected forms share."""
    distinct = set(words)
    return distinct | {w[:4] + "-" for w in distinct if len(w) > 4}


def shape_of(text: str, words: list[str]) -> np.ndarray:
    """Roots of the shares of each ASCII letter class or sign, other letters, capitals,
    of words and lines that repeat earlier ones, and of words like the one before."""
    found = np.zeros(SHAPES)
    if not text:
        return found
    counts = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    total = counts.sum()
    capitals, small, digits = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum()
    signs = counts[:128].astype(float)
    signs[65:91] = signs[97:123] = signs[48:58] = 0
    found[:128] = signs / total
    found[128] = capitals / max(1, capitals + small)
    found[129] = digits / total
    found[130] = counts[128:].sum() / total
    found[131] = 1 - len(set(words)) / len(words) if words else 0
    lines = text.split("\n")
    found[132] = 1 - len(set(lines)) / len(lines)
    found[133] = sum(map(eq, words, words[1:])) / len(words) if words else 0
    return np.sqrt(found)


@dataclass
class Model:
    weights: dict[str, float]
    shape_weights: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        words = words_of(text)
        told = marks_of(words) & self.weights.keys()
        total = self.bias + sum([self.weights[w] for w in sorted(told)])
        total += float(shape_of(text, words) @ self.shape_weights)
        return float(1 / (1 + np.exp(-np.clip(total, -500, 500))))


def telling_words(bags: DataFrame, n: int, m: int, least_z: float, most: int) -> list[str]:
    """Words whose share of texts differs most significantly between the n positive and
    the m other bags."""
    found = bags.select("positive", F.explode("words").alias("word")).groupBy("word")
    found = found.agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u"))
    share = (F.col("p") + F.col("u")) / (n + m)
    spread = F.sqrt(share * (1 - share) * (1 / n + 1 / m))
    found = found.filter((F.col("p") + F.col("u") >= 5) & (share < 1)).withColumn(
        "z", F.abs(F.col("p") / n - F.col("u") / m) / spread
    )
    best = found.filter(F.col("z") >= least_z).orderBy(F.desc("z"), "word").limit(most)
    return [r.word for r in best.collect()]


def log_loss(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, -z)


def minimise(
    positive: np.ndarray, other: np.ndarray, prior: float, steps: int = 400, decay: float = 3e-4
) -> np.ndarray:
    """Weights (the last is the bias) that minimise the non-negative unbiased risk with
    logistic loss, by Adam. `decay` keeps them small."""
    xp, xu = np.asarray(positive, np.float32), np.asarray(other, np.float32)
    w = np.zeros(xp.shape[1] + 1)
    w[-1] = np.log(prior / (1 - prior))
    mean, square = np.zeros_like(w), np.zeros_like(w)

    def down(x: np.ndarray, each: np.ndarray) -> np.ndarray:
        """Means of the columns, and of the bias's ones, weighted row by row."""
        return np.append(x.T @ each.astype(np.float32), each.sum()) / len(x)

    for step in range(1, steps + 1):
        plain = w[:-1].astype(np.float32)
        zp = (xp @ plain).astype(np.float64) + w[-1]
        zu = (xu @ plain).astype(np.float64) + w[-1]
        sp, su = np.exp(-log_loss(zp)), np.exp(-log_loss(zu))
        as_positive = prior * down(xp, sp - 1)
        as_negative = down(xu, su) - prior * down(xp, sp)
        risk = log_loss(-zu).mean() - prior * log_loss(-zp).mean()
        # a negative risk means that the unlabelled positives are being fitted as negatives
        gradient = as_positive + as_negative if risk >= 0 else -as_negative
        gradient[:-1] += decay * w[:-1]
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        w -= 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return w


def fit(bags: DataFrame, prior: float, least_z: float = 4.5, most_words: int = 1000) -> Model:
    """A model from bags of positive and other texts: (positive, words, shape). Only
    the words that tell the two apart, and which bag holds which, come to the driver."""
    n, m = bags.agg(F.count_if("positive"), F.count_if(~F.col("positive"))).first()
    if not n or not m:
        return Model({}, np.zeros(SHAPES), float(np.log(prior / (1 - prior))))
    words = telling_words(bags, n, m, least_z, most_words)
    place = {w: i for i, w in enumerate(words)}

    def told(batch: pa.RecordBatch) -> dict:
        return {
            "positive": batch.column("positive"),
            "places": [[place[w] for w in ws if w in place] for ws in batch.column("words").to_pylist()],
            "shape": batch.column("shape"),
        }

    def matrix(positive: bool, rows: int) -> np.ndarray:
        some = bags.filter(F.col("positive") == positive)
        held = map_slices(some, told, "positive boolean, places array<int>, shape array<double>")
        found = np.zeros((rows, len(words) + SHAPES), np.float32)
        for i, r in enumerate(held.select("places", "shape").toLocalIterator()):
            found[i, r.places] = 1
            found[i, len(words) :] = r.shape
        return found

    xp, xu = matrix(True, n), matrix(False, m)
    centre, spread = xu.mean(axis=0), xu.std(axis=0)
    # words are present or not; rare ones must not weigh more for being rare
    spread[: len(words)], centre[: len(words)] = 1.0, 0.0
    spread[spread < 1e-3] = 1e-3
    for x in (xp, xu):
        x -= centre
        x /= spread
    w = minimise(xp, xu, prior)
    plain = w[:-1] / spread
    return Model(
        dict(zip(words, plain[: len(words)].tolist())),
        plain[len(words) :],
        float(w[-1] - centre @ plain),
    )


def learn(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str,
    positives: int = 3000,
    unlabelled: int = 6000,
) -> Model:
    """A model of label_col = 1, from rows that aren't held out."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).alias("y"))
    marks = marks.filter(F.col("y").isNotNull() & ~held_out())
    n, ones = marks.agg(F.count("*"), F.count_if(F.col("y") == 1)).first()
    prior = (ones + 1) / (n + 2)
    rows = id_and_text(docs).filter(~held_out())

    def bag(batch: pa.RecordBatch) -> dict:
        found = [(t, words_of(t)) for t in texts(batch)]
        return {
            "words": [sorted(marks_of(words)) for _, words in found],
            "shape": [shape_of(t, words).tolist() for t, words in found],
        }

    def sample(ids: DataFrame, most: int, seed: int, positive: bool) -> DataFrame:
        """Bags of the texts whose ids have the smallest hashes; `most` ids are few
        enough to go to every task. Of several texts under an id the smallest counts."""
        some = ids.distinct().orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most)
        chosen = rows.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
        bags = map_slices(chosen, bag, "words array<string>, shape array<double>")
        return bags.withColumn("positive", F.lit(positive))

    ids = rows.select("doc_id")
    trusted = ids.join(marks.filter("y = 1").select("doc_id"), "doc_id", "left_semi")
    bags = sample(trusted, positives, 1, True).union(sample(ids, unlabelled, 2, False))
    return fit(saved(bags), prior)


def score(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""

    def run(batch: pa.RecordBatch) -> dict:
        found = [model.score(t) for t in texts(batch)]
        return {
            "doc_id": batch.column("doc_id"),
            "score": found,
            "predicted": [int(s >= threshold) for s in found],
        }

    scored = map_slices(id_and_text(docs), run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep_positive(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The rows, with all their columns, whose text scores the threshold at least."""

    @F.pandas_udf("boolean")
    def good(column):
        return column.map(lambda t: model.score(t or "") >= threshold)

    return docs.filter(good(F.col("text")))
