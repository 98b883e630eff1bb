"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes a few surface features, each feature a bin. Cyclic boosting
visits the features in turn and adds a shallow tree over one feature's bins to
that feature's lookup table; then the strongest pairs of features get tables of
two dimensions the same way. A score is the sum of the looked-up bins through
the logistic function, computed for a whole Arrow batch at once.

Labels come from a bounded sample (MAX_LABELS) of the training fold; features,
scores and decisions cover every whole text. Null and empty texts score like any
other (their features are zeros). A document without id is scored and not held
out. With no usable labels, or only one class, every score is the smoothed mean
label. Repeated rows get equal scores; extra columns pass through, and a column
named like an output is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import buffers, fold, label_sample, read, row_sums, small_batches, span_hashes, spans, unique_per_row

#: Labelled documents that training may use at most.
MAX_LABELS = 20_000
CUT = 0.3

FEATURES = (
    "log_words", "mean_word", "upper", "digit", "symbol", "bar", "bang", "comma_stop", "line_rate",
    "short_words", "long_words", "distinct_words", "distinct_lines", "stop_words", "nonascii", "capital_words",
)
_STOP = "the of and to in is that it for on with as be by der die und das von zu mit ist nicht le la les de des et en un une el los las que y del".split()

_SPACE, _UPPER, _LETTER, _DIGIT, _END = (np.zeros(256, bool) for _ in range(5))
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True
_DIGIT[48:58] = True
_END[[ord(c) for c in ".,;:"]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[33:127] = True
_SYMBOL &= ~(_LETTER | _DIGIT | _END)
_SYMBOL[[ord(c) for c in "'\"-()?"]] = False
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
#: Two counts in one 64-bit field each, so that one pass over the bytes sums both.
_PAIRS = [(a.astype(np.int64) | (b.astype(np.int64) << 32)) for a, b in (
    (_UPPER, _LETTER), (_DIGIT, _SYMBOL), (np.arange(256) == ord("|"), np.arange(256) == ord("!")), (_END, np.arange(256) >= 128))]


def _stop_hashes() -> np.ndarray:
    raw, off = buffers(pa.array(_STOP))
    return np.sort(span_hashes(raw, off[:-1], off[1:]))


_STOP_HASHES = _stop_hashes()


def features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text."""
    raw, offsets = buffers(column)
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    low = (1 << 32) - 1
    counts = []
    for lut in _PAIRS:
        both = row_sums(lut[raw], offsets)
        counts += [both & low, both >> 32]
    upper, letter, digit, symbol, bar, bang, end, wide = counts
    lowered = _LOW[raw]
    starts, ends, rows = spans(~_SPACE[raw], offsets)
    words = np.bincount(rows, minlength=n)
    some = np.maximum(words, 1)
    lengths = ends - starts
    hashes = span_hashes(lowered, starts, ends)
    word_sum = lambda x: np.bincount(rows, weights=x, minlength=n)
    _, distinct = unique_per_row(hashes, rows, n)
    at = np.minimum(np.searchsorted(_STOP_HASHES, hashes), len(_STOP_HASHES) - 1)
    ls, le, lrows = spans(raw != 10, offsets)
    lines = np.bincount(lrows, minlength=n)
    _, distinct_lines = unique_per_row(span_hashes(lowered, ls, le), lrows, n)
    return np.column_stack([
        np.log1p(words), word_sum(lengths) / some, upper / np.maximum(letter, 1), digit / size, symbol / size, bar / size, bang / size,
        end / some, lines / some, word_sum(lengths <= 3) / some, word_sum(lengths >= 14) / some,
        np.diff(distinct) / np.sqrt(some), np.diff(distinct_lines) / np.maximum(lines, 1), word_sum(_STOP_HASHES[at] == hashes) / some,
        wide / size, word_sum(_UPPER[raw[starts]] if len(starts) else lengths) / some,
    ]).astype(np.float64)


def _leaf(g: float, h: float) -> float:
    return g / (h + 1.0)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best single cut of a run of bins."""
    if len(g) < 2:
        return 0.0, 0
    cg, ch = np.cumsum(g), np.cumsum(h)
    lg, lh, rg, rh = cg[:-1], ch[:-1], cg[-1] - cg[:-1], ch[-1] - ch[:-1]
    gain = lg**2 / (lh + 1) + rg**2 / (rh + 1) - cg[-1] ** 2 / (ch[-1] + 1)
    i = int(np.argmax(gain))
    return float(gain[i]), i + 1


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 4) -> np.ndarray:
    """A shallow tree over ordered bins as the value of each bin."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        cuts = [(*_best_cut(g[a:b], h[a:b]), a, b) for a, b in parts]
        gain, cut, a, b = max(cuts)
        if gain <= 1e-9:
            break
        parts.remove((a, b))
        parts += [(a, a + cut), (a + cut, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, int, int]:
    """Gain and cuts of the best division of a grid of bins into four."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a, b = G[:-1, :-1], H[:-1, :-1]
    top, left, whole = (G[:-1, -1:], H[:-1, -1:]), (G[-1:, :-1], H[-1:, :-1]), (G[-1, -1], H[-1, -1])
    four = [(a, b), (top[0] - a, top[1] - b), (left[0] - a, left[1] - b), (whole[0] - top[0] - left[0] + a, whole[1] - top[1] - left[1] + b)]
    gain = sum(x**2 / (y + 1) for x, y in four) - whole[0] ** 2 / (whole[1] + 1)
    if not gain.size:
        return 0.0, 0, 0
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return float(gain[i, j]), int(i) + 1, int(j) + 1


@dataclass
class Gam:
    """Lookup tables by feature and by pair of features, and the edges of their bins."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for f, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += t[np.searchsorted(e, x[:, f], side="right")]
        for i, j, t in self.pairs:
            z += t[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="higher"))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 200, pair_rounds: int = 60, n_pairs: int = 6, rate: float = 0.1, bins: int = 64) -> Gam:
    """Cyclic boosting of main tables, then of the strongest pairs, on the log loss."""
    p0 = (y.sum() + 1) / (len(y) + 2)
    m = Gam(intercept=float(np.log(p0 / (1 - p0))))
    if not len(y) or y.min() == y.max():
        return m
    m.edges = [_edges(x[:, f], bins) for f in range(x.shape[1])]
    m.coarse = [_edges(x[:, f], 12) for f in range(x.shape[1])]
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    at = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(m.edges)]
    z = np.full(len(y), m.intercept)
    for _ in range(rounds):
        for f, b in enumerate(at):
            p = 1 / (1 + np.exp(-z))
            g, h = np.bincount(b, y - p, len(m.tables[f])), np.bincount(b, p * (1 - p), len(m.tables[f]))
            step = rate * _tree(g, h)
            m.tables[f] += step
            z += step[b]
    cell = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(m.coarse)]
    wide = [len(e) + 1 for e in m.coarse]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(cell[i] * wide[j] + cell[j], v, wide[i] * wide[j]).reshape(wide[i], wide[j])

    p = 1 / (1 + np.exp(-z))
    found = sorted(((_quadrants(grid(i, j, y - p), grid(i, j, p * (1 - p)))[0], i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True)
    m.pairs = [(i, j, np.zeros((wide[i], wide[j]))) for gain, i, j in found[:n_pairs] if gain > 0]
    for _ in range(pair_rounds):
        for i, j, t in m.pairs:
            p = 1 / (1 + np.exp(-z))
            g, h = grid(i, j, y - p), grid(i, j, p * (1 - p))
            gain, a, b = _quadrants(g, h)
            if gain <= 1e-9:
                continue
            step = np.zeros_like(t)
            for s in ((slice(0, a), slice(0, b)), (slice(0, a), slice(b, None)), (slice(a, None), slice(0, b)), (slice(a, None), slice(b, None))):
                step[s] = rate * _leaf(g[s].sum(), h[s].sum())
            t += step
            z += step[cell[i], cell[j]]
    return m


def train(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELS) -> Gam:
    """Fit on labelled documents outside the held-out fold (crc32 of the id mod 5 is 0)."""
    small_batches(docs.sparkSession)
    of = F.arrow_udf(lambda t: pa.array(list(features(t)), pa.list_(pa.float64())), "array<double>")
    sample = label_sample(labels, "doc_id", "quality", fold(F.col("doc_id"), 5) != 0, bound)
    rows = (
        docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).join(F.broadcast(sample), "_id")
        .select("_id", "_label", of("_text").alias("_x")).groupBy("_id", "_label").agg(F.min("_x").alias("_x")).orderBy("_id").toPandas()
    )
    x = np.array([*rows["_x"]], np.float64).reshape(-1, len(FEATURES))
    return fit(x, rows["_label"].to_numpy(np.float64))


def score(docs: DataFrame, model: Gam, out: str = "score") -> DataFrame:
    """docs with the score of each whole text in column `out`."""
    small_batches(docs.sparkSession)
    return docs.withColumn(out, F.arrow_udf(lambda t: pa.array(model.score(features(t))), "double")(F.col("text")))


def op8_quality_gam(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
