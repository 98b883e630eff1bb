"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; a seeded sample of all documents of the
training fold, labelled or not, is the unlabelled set, and its labels aren't looked at.
A linear classifier on the presence of words is trained in numpy with the
class-prior-corrected risk

    R = prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)]),

where a step at which the second term is below zero raises it again. The prior is
the smoothed share of toxic labels in the training fold. The same risk of wrong
decisions then tells which margin stands for a score of CUT, so labelled clean
documents count for the prior and nothing else.

Words are runs of letters (A-Z folded) of whole texts, so marks around a word
don't hide it; beside whole words their beginnings count (PREFIXES, in bytes), so
that an inflected or compounded word is known by its stem. Features are hashes of
words; those that lean to positive texts beyond chance (MIN_G, met from some eight
texts on at any number of them) are weighed, VOCABULARY at most. Word choice and training use bounded seeded samples
(MAX_POSITIVE, MAX_UNLABELLED). Every text is scored whole. Null and empty texts
score as texts without any weighed word. Documents without id are scored and
not held out. Without positives, or without unlabelled texts, all scores are the
prior. Repeated rows score alike; extra columns pass through, and one named like the
output is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import buffers, fold, label_sample, prefix_hashes, read, row_sums, small_batches, spans, unique_per_row

#: Documents that training may use at most, of each kind.
MAX_POSITIVE, MAX_UNLABELLED = 4_000, 12_000
#: Words in the model at most, and the likelihood ratio statistic that a word must reach.
VOCABULARY, MIN_G = 8_192, 16.0
#: A word is a candidate if it is this share of 1/prior times likelier among positives than among unlabelled texts.
MIN_RATIO = 0.3
CUT = 0.7
#: Bytes of a word's beginnings that are features of their own.
PREFIXES = [4, 5, 6, 7]

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


def letter_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Hash and row of each run of letters and of its beginnings, and the number of rows."""
    raw, offsets = buffers(column)
    starts, ends, rows = spans(_LETTER[raw], offsets)
    hashes = prefix_hashes(_LOW[raw], starts, ends, PREFIXES)
    return np.stack(hashes, axis=1).ravel(), np.repeat(rows, len(hashes)), len(offsets) - 1


def find(words: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the hashes that are among the sorted words, and which words they are."""
    seen = np.zeros(1 << 16, bool)
    seen[words & np.uint64(0xFFFF)] = True
    may = np.flatnonzero(seen[hashes & np.uint64(0xFFFF)])
    at = np.minimum(np.searchsorted(words, hashes[may]), len(words) - 1)
    hit = words[at] == hashes[may]
    return may[hit], at[hit]


@dataclass
class PuModel:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float

    def margins(self, column: pa.Array) -> np.ndarray:
        hashes, rows, n = letter_words(column)
        out = np.full(n, self.bias)
        if len(self.words):
            places, at = find(self.words, hashes)
            seen = np.unique(rows[places] * len(self.words) + at)  # presence, not counts
            out += np.bincount(seen // len(self.words), weights=self.weights[seen % len(self.words)], minlength=n)
        return out

    def score(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(column), -35, 35)))


class Bits:
    """Rows of a sparse 0/1 matrix: the columns of each."""

    def __init__(self, rows: list[np.ndarray]):
        self.offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        self.columns = np.concatenate([np.asarray(r, np.int64) for r in rows]) if rows else np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def take(self, at: np.ndarray) -> Bits:
        return Bits([self.columns[self.offsets[i] : self.offsets[i + 1]] for i in at])

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return row_sums(weights[self.columns], self.offsets)

    def sums(self, values: np.ndarray, width: int) -> np.ndarray:
        """Sums of the rows' values by column."""
        return np.bincount(self.columns, weights=np.repeat(values, np.diff(self.offsets)), minlength=width)


def fit_nnpu(pos: Bits, unl: Bits, width: int, prior: float, steps: int = 300, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear model under the non-negative risk (logistic loss, Adam over whole samples)."""
    theta = np.zeros(width + 1)
    theta[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    up = lambda x, g: np.append(x.sums(g, width), g.sum()) / len(x)
    for t in range(1, steps + 1):
        zp, zu = (x.dot(theta[:-1]) + theta[-1] for x in (pos, unl))
        sp, su = 1 / (1 + np.exp(-np.clip(zp, -30, 30))), 1 / (1 + np.exp(-np.clip(zu, -30, 30)))
        up_p, down_p, down_u = -up(pos, 1 - sp), up(pos, sp), up(unl, su)  # gradients of E_p[loss(+)], E_p[loss(-)], E_u[loss(-)]
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        grad = prior * up_p + down_u - prior * down_p if negative >= 0 else prior * down_p - down_u
        grad = grad + decay * np.append(theta[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:-1], float(theta[-1])


def fit_cut(pos: np.ndarray, unl: np.ndarray, prior: float) -> float:
    """The margin at which decisions have the least non-negative risk; the middle of the widest gap of such margins."""
    z = np.unique(np.concatenate([pos, unl]))
    if len(z) < 2:
        return float(z[0]) if len(z) else 0.0
    low = np.searchsorted(np.sort(pos), z[1:]) / len(pos)  # positives under a cut between z[i] and z[i + 1]
    high = 1 - np.searchsorted(np.sort(unl), z[1:]) / len(unl)
    risk = prior * low + np.maximum(0, high - prior * (1 - low))
    near = np.flatnonzero(risk <= risk.min() + 2e-3 * prior)
    i = near[np.argmax(np.diff(z)[near])]
    return float((z[i] + z[i + 1]) / 2)


def train(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, vocabulary: int = VOCABULARY) -> PuModel:
    """Learn from rows whose crc32(doc_id) mod 3 is not 1."""
    spark = docs.sparkSession
    small_batches(spark)
    fold_of = fold(F.col("doc_id"), 3) != 1
    known = labels.where(fold_of & F.col("toxic").isin(0, 1)).agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("p")).first()
    prior = float(np.clip((known["p"] + 1) / (known["n"] + 20), 1e-3, 0.9))
    positive = label_sample(labels, "doc_id", "toxic", fold_of & (F.col("toxic") == 1), max_positive)
    unlabelled = docs.select(F.col("doc_id").alias("_id")).where(F.col("_id").isNotNull() & (fold(F.col("_id"), 3) != 1)).distinct().orderBy(F.xxhash64("_id", F.lit(23)), "_id").limit(max_unlabelled)
    # 1: positive, 0: unlabelled; a document can be both
    sample = positive.select("_id", F.col("_label").cast("int")).unionByName(unlabelled.withColumn("_label", F.lit(0)))
    text = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))

    def distinct_words(column: pa.Array) -> pa.Array:
        hashes, rows, n = letter_words(column)
        got, off = unique_per_row(hashes, rows, n)
        return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(got.view(np.int64)))

    of = F.arrow_udf(distinct_words, "array<bigint>")
    rows = text.join(F.broadcast(sample), "_id").select("_id", "_label", of("_text").alias("_w")).groupBy("_id", "_label").agg(F.min("_w").alias("_w"))
    n1, n0 = sample.agg(F.count_if(F.expr("_label = 1")), F.count_if(F.expr("_label = 0"))).first()
    empty = PuModel(np.zeros(0, np.uint64), np.zeros(0), float(np.log(prior / (1 - prior))))
    if not n1 or not n0:
        return empty
    share1, share0 = (F.col("a") + 0.5) / (n1 + 1.0), (F.col("b") + 0.5) / (n0 + 1.0)
    chance = (F.col("b") + 0.5) * (n1 / n0)  # positive texts that would hold the word if toxic texts were like all
    chosen = (
        rows.select("_label", "_w").distinct().select("_label", F.explode("_w").alias("w")).groupBy("w").agg(F.count_if(F.expr("_label = 1")).alias("a"), F.count_if(F.expr("_label = 0")).alias("b"))
        .where((share1 / share0 >= max(1.5, MIN_RATIO / prior)) & (2 * (F.col("a") * F.log(F.col("a") / chance) - (F.col("a") - chance)) >= MIN_G)).withColumn("gain", share1 * F.log(share1 / share0)).orderBy(F.desc("gain"), "w").limit(vocabulary)
        .select("w").toPandas()["w"].to_numpy(np.int64).view(np.uint64)
    )
    if not len(chosen):
        return empty
    words = np.sort(chosen)

    def columns(column: pa.Array) -> pa.Array:
        hashes, rows_of, n = letter_words(column)
        places, at = find(words, hashes)
        got, off = unique_per_row(at, rows_of[places], n)
        return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(got.astype(np.int32)))

    got = text.join(F.broadcast(sample), "_id").select("_id", "_label", F.arrow_udf(columns, "array<int>")("_text").alias("_c")).groupBy("_id", "_label").agg(F.min("_c").alias("_c")).orderBy("_label", "_id").toPandas()
    pos, unl = (Bits([*got["_c"][got["_label"] == k]]) for k in (1, 0))
    if not len(pos) or not len(unl):
        return empty
    weights, bias = fit_nnpu(pos, unl, len(words), prior)
    cut = fit_cut(pos.dot(weights) + bias, unl.dot(weights) + bias, prior)
    return PuModel(words, weights, bias - cut + float(np.log(CUT / (1 - CUT))))


def score(docs: DataFrame, model: PuModel, out: str = "score") -> DataFrame:
    """docs with the toxicity score of each whole text in column `out`."""
    small_batches(docs.sparkSession)
    return docs.withColumn(out, F.arrow_udf(lambda t: pa.array(model.score(t)), "double")(F.col("text")))


def op9_toxicity_nnpu(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
