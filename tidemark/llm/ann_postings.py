"""Approximate nearest neighbours over balanced posting lists.

Centroids are fitted on a bounded seeded sample (MAX_TRAIN) by k-means that
splits lists grown too large; every row is then indexed. A vector near a border
goes to each list whose centroid is nearly as near as its own (REPLICA_RATIO,
REPLICAS at most). A query walks an in-memory neighbour graph of the centroids
and keeps every list whose centroid distance is within a ratio of the nearest one.
The ratio is measured: it is the least one at which RECALL of the nearest rows of sampled
queries, found by brute force inside the sample, lie in a kept list. A row is stored once,
with its lists, in the bundle of neighbouring lists that its nearest one is in; a query goes once
to each bundle where rows of its lists are, with the set of its lists, and meets the rows that
share a list with it. Bundles and their queries are cut into cells of bounded size, so a list that
holds a third of all rows is many tasks, and a cell is searched in blocks. Found rows are scored in
double precision on the original vectors. Queries whose lists hold too few rows are asked again of all lists.

Vectors that are null, empty, zero, or hold null or non-finite components take no
part, nor do rows without id; vectors of another length than the commonest in the
sample are left out too. Vectors are scaled by a power of two before norms are taken,
so no finite one over- or underflows. Rows that repeat id and vector count once. Ties
go to the smaller id. Columns besides id and vector are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Scratch, read

#: Rows that fit centroids, lists at most, and rows that a list is meant to hold.
MAX_TRAIN, MAX_LISTS, LIST_ROWS = 20_000, 2_048, 256
REPLICAS, REPLICA_RATIO = 4, 1.15
#: Share of the sampled queries' nearest rows that the lists must hold, and how many of both are looked at.
RECALL, SAMPLED_QUERIES, SAMPLED_NEAREST = 0.92, 1_000, 5
DEGREE = 16
#: Bundles at most, rows and queries of one cell of a bundle, and pairs that are compared at once.
MAX_BUNDLES, CELL_ROWS, CELL_QUERIES, BLOCK = 32, 65_536, 32_768, 1 << 18
#: Vectors whose distances to all centroids are held at once, so that memory doesn't grow with rows.
SLICE = 256


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component to between 0.5 and 1."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) if x.size else x


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _slices(n: int, width: int = SLICE):
    return (slice(a, a + width) for a in range(0, n, width))


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The centroid nearest to each unit vector."""
    return np.concatenate([np.zeros(0, int), *(np.argmax(x[s] @ c.T, axis=1) for s in _slices(len(x)))])


def fit_centroids(x: np.ndarray, lists: int, rounds: int = 10, seed: int = 3) -> np.ndarray:
    """Unit centroids; a list of over twice the mean size gives its place to halves of it."""
    rng = np.random.default_rng(seed)
    x = np.unique(_unit(x), axis=0)
    lists = min(lists, len(x))
    c = x[rng.choice(len(x), lists, replace=False)]
    for r in range(rounds):
        own = _nearest(x, c)
        size = np.bincount(own, minlength=lists)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        alive = size > 0
        c[alive] = _unit(sums[alive])
        if r < rounds - 2:  # move the smallest lists into the largest
            big, small = np.argsort(-size), np.argsort(size)
            for b, s in zip(big, small, strict=True):
                if size[b] < 2 * len(x) / lists or size[s] >= size[b] / 4 or b == s:
                    break
                a, z = x[own == b][rng.choice(size[b], 2, replace=False)]
                c[b], c[s] = _unit((c[b] + 0.3 * a)[None])[0], _unit((c[b] + 0.3 * z)[None])[0]
    return c


def neighbour_graph(c: np.ndarray, degree: int = DEGREE, seed: int = 9) -> np.ndarray:
    """Neighbours of each centroid: the nearest ones, and a few seeded far links."""
    n = len(c)
    if n == 1:
        return np.zeros((1, 1), int)
    near = np.argsort(-(c @ c.T - 2 * np.eye(n)), axis=1, kind="stable")[:, : min(degree, n - 1)]
    far = np.random.default_rng(seed).integers(0, n, (n, 4))
    return np.hstack([near, far])


def graph_search(q: np.ndarray, c: np.ndarray, graph: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, list) of the centroids within the ratio of each query's nearest one, by a walk.

    A query walks on from all centroids it has met that are within the ratio of the nearest one met.
    """
    n, k = len(q), len(c)
    sim = np.full((n, k), -np.inf)
    done = np.zeros((n, k), bool)
    entry = np.linspace(0, k - 1, min(k, 8)).astype(int)
    sim[:, entry] = q @ c[entry].T
    within = lambda: _distance(sim) <= ratio * _distance(sim.max(axis=1, keepdims=True)) + 1e-12
    while True:
        row, at = np.nonzero(within() & ~done)
        if not len(row):
            return np.nonzero(within())
        done[row, at] = True
        met = np.zeros((n, k), bool)
        met[row[:, None], graph[at]] = True
        row, at = np.nonzero(met & (sim == -np.inf))
        for s in _slices(len(row), BLOCK // 8):
            sim[row[s], at[s]] = np.einsum("nd,nd->n", q[row[s]], c[at[s]])


def _distance(sim: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * sim, 0))


def own_lists(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of the lists that unit vectors go to, the nearest first."""
    rows, lists, m = [np.zeros(0, int)], [np.zeros(0, int)], min(REPLICAS, len(c))
    for s in _slices(len(x)):
        sim = x[s] @ c.T
        at, top, d = np.arange(len(sim)), np.empty((len(sim), m), int), np.empty((len(sim), m))
        for i in range(m):
            top[:, i] = np.argmax(sim, axis=1)
            d[:, i] = _distance(sim[at, top[:, i]])
            sim[at, top[:, i]] = -np.inf
        row, col = np.nonzero(d <= REPLICA_RATIO * d[:, :1] + 1e-12)
        rows.append(row + s.start)
        lists.append(top[row, col])
    return np.concatenate(rows), np.concatenate(lists)


def bundle_lists(c: np.ndarray) -> np.ndarray:
    """The bundle of each list: lists whose centroids lie together."""
    return _nearest(c, fit_centroids(c, min(MAX_BUNDLES, -(-len(c) // 4))))


def fit_ratio(x: np.ndarray, c: np.ndarray) -> float:
    """The least ratio at which lists hold RECALL of the nearest sample rows of sampled queries."""
    q = np.linspace(0, len(x) - 1, min(len(x), SAMPLED_QUERIES)).astype(int)
    m = min(SAMPLED_NEAREST, len(x) - 1)
    if m < 1 or len(c) < 2:
        return 1.0
    holds = np.zeros((len(x), len(c)), bool)
    holds[own_lists(x, c)] = True
    reach = []
    for part in np.array_split(q, -(-len(q) // 50)):  # a few queries at a time, so that the driver stays small
        sim = x[part] @ x.T
        sim[np.arange(len(part)), part] = -np.inf
        near = np.argpartition(sim, len(x) - m, axis=1)[:, len(x) - m :]
        d = _distance(x[part] @ c.T)
        reach.append(np.where(holds[near], d[:, None, :], np.inf).min(axis=2) / np.maximum(d.min(axis=1, keepdims=True), 1e-9))
    return float(max(1.0, np.quantile(np.concatenate(reach), RECALL, method="higher")))


def _good(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def _lowest(rows: DataFrame, n: int) -> DataFrame:
    """The MAX_TRAIN of n rows with the lowest hashes; each task would send as many, so most are left out by their hash before."""
    h = F.xxhash64("vec_id", F.lit(5))
    low = rows.where(h < -(1 << 63) + int((1 << 64) * 1.5 * MAX_TRAIN / n)) if n > 2 * MAX_TRAIN else rows
    if n > 2 * MAX_TRAIN and low.count() < MAX_TRAIN:  # few ids, each with many vectors
        low = rows
    return low.orderBy(h, "vec_id", "v").limit(MAX_TRAIN)


def _stack(v: pd.Series) -> np.ndarray:
    return _scaled(np.stack(v.to_numpy()).astype(float))


def _keep(s: np.ndarray, ids: np.ndarray, q: np.ndarray, score: np.ndarray, found: np.ndarray) -> None:
    """Puts the found rows of queries q into their rows of s and ids, which hold the best ones so far, ties to the smaller id."""
    n, k = s.shape
    live, at = np.unique(q, return_inverse=True)
    own = np.concatenate([at, np.repeat(np.arange(len(live)), k)])
    score, found = np.concatenate([score, s[live].ravel()]), np.concatenate([found, ids[live].ravel()])
    order = np.lexsort((found, -score, own))
    place = np.arange(len(order)) - np.searchsorted(own[order], own[order])
    order, place = order[place < k], place[place < k]
    s[live[own[order]], place], ids[live[own[order]], place] = score[order], found[order]


def _cell(k: int, lists: int):
    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        v, ids, q, query_ids = _stack(left["v"]), left["vec_id"].to_numpy(), _stack(right["v"]), right["vec_id"].to_numpy()
        norm, qn = np.sqrt((v * v).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
        u, uq = (v / norm[:, None]).astype(np.float32), (q / qn[:, None]).astype(np.float32)
        off = (v.shape[1] + 8) * 2.4e-7  # more than 32-bit cosines can be off by
        # whether a list is asked by a query; the last row stands for no list
        asked = np.zeros((lists + 1, len(q)), bool)
        bits = np.frombuffer(b"".join(right["asked"]), np.uint8).reshape(len(q), -1)
        for s in _slices(len(q)):
            asked[:lists, s] = np.unpackbits(bits[s], axis=1, count=lists).T
        own = np.full((len(v), REPLICAS), lists)
        for i, at in enumerate(left["lists"]):
            own[i, : len(at)] = at
        best, best_ids = np.full((len(q), k), -np.inf), np.zeros((len(q), k), np.int64)

        def block(rows: np.ndarray, at: np.ndarray) -> None:
            """Queries `at` against rows; only those that share a list count."""
            rough = u[rows] @ uq[at].T
            least, groups = best[at, k - 1], 4 * k
            if len(rows) >= groups and np.isinf(least).any():  # k groups of rows have one as near as this
                some, where = np.unique(own[rows], return_inverse=True)
                asks, where = asked[some][:, at], where.reshape(-1, REPLICAS)
                share = asks[where[:, 0]]
                for i in range(1, REPLICAS):
                    share |= asks[where[:, i]]
                share &= ids[rows][:, None] != query_ids[at]
                tops = np.where(share, rough, -np.inf)[: len(rows) // groups * groups].reshape(groups, -1, len(at)).max(axis=1)
                least = np.maximum(least, np.partition(tops, groups - k, axis=0)[groups - k])
            r, c = np.divmod(np.flatnonzero(rough >= np.maximum(least - off, -2).astype(np.float32)), len(at))
            r, c = rows[r], at[c]
            good = (ids[r] != query_ids[c]) & asked[own[r], c[:, None]].any(axis=1)
            r, c = r[good], c[good]
            if len(r):
                score = np.concatenate([(v[r[s]] * q[c[s]]).sum(axis=1) / (norm[r[s]] * qn[c[s]]) for s in _slices(len(r), BLOCK // 8)])  # the same sum for equal vectors wherever they lie
                _keep(best, best_ids, c, score, ids[r])

        order = np.argsort(own[:, 0], kind="stable")
        for near in np.split(order, np.flatnonzero(np.diff(own[order, 0])) + 1):  # rows by their nearest list
            for rows in (near[s] for s in _slices(len(near), BLOCK // 64)):
                asking = np.flatnonzero(asked[np.unique(own[rows])].any(axis=0))
                for s in _slices(len(asking), BLOCK // len(rows)):
                    block(rows, asking[s])
        row, col = np.nonzero(best > -np.inf)
        return pd.DataFrame({"query_id": query_ids[row], "vec_id": best_ids[row, col], "score": best[row, col]})

    return search


def nearest(vectors: DataFrame, id_col: str, vec_col: str, is_query: Column, k: int) -> DataFrame:
    """The k nearest found rows of each query by cosine: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "postings")
    # 32-bit vectors stay so in tables; all sums are in double precision
    v = F.col(vec_col) if vectors.schema[vec_col].dataType == T.ArrayType(T.FloatType(), vectors.schema[vec_col].dataType.containsNull) else F.transform(F.col(vec_col), lambda x: x.cast("double"))
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), is_query.alias("is_query"))
    base = scratch.save(base.where("vec_id is not null").where(_good(F.col("v"))).dropDuplicates(["vec_id", "v"]), "vectors")
    n = base.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = _lowest(base.select("vec_id", "v"), n).toPandas()["v"]
    dims = sample.map(len)
    dim = int(dims.mode().iloc[0])
    whole, base = base, base.where(F.size("v") == dim)
    sample = _unit(np.stack(sample[dims == dim].to_numpy()).astype(float))
    c = fit_centroids(sample, max(1, min(MAX_LISTS, math.ceil(n / LIST_ROWS))))
    graph, ratio, bundle = neighbour_graph(c), fit_ratio(sample, c), bundle_lists(c)
    del sample

    def deal(batches):
        for b in batches:
            if len(b):
                row, at = own_lists(_unit(b["v"].flatten().to_numpy().reshape(len(b), dim).astype(float)), c)
                ends = np.searchsorted(row, np.arange(len(b) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(bundle[at[ends[:-1]]]), pa.ListArray.from_arrays(ends, at), b["vec_id"], b["v"]], ["bundle", "lists", "vec_id", "v"])

    kind = base.schema["v"].dataType.simpleString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    posts = scratch.save(base.select("vec_id", "v").mapInArrow(deal, f"bundle long, lists array<long>, vec_id long, v {kind}"), "lists")
    holds = np.zeros((len(c), int(bundle.max()) + 1), bool)  # in which bundles rows of a list are
    at = posts.select(F.explode("lists").alias("list"), "bundle").distinct().toPandas()
    holds[at["list"], at["bundle"]] = True

    def asks_of(queries: DataFrame, walk: bool) -> DataFrame:
        def ask(batches):
            for b in batches:
                for s in _slices(len(b), 64):
                    part = b.iloc[s]
                    asked = np.full((len(part), len(c)), not walk)
                    if walk:
                        asked[graph_search(_unit(np.stack(part["v"].to_numpy()).astype(float)), c, graph, ratio)] = True
                    yield pd.DataFrame({"bundles": [np.flatnonzero(holds[x].any(axis=0)) for x in asked], "asked": [x.tobytes() for x in np.packbits(asked, axis=1)], "vec_id": part["vec_id"].to_numpy(), "v": part["v"].to_numpy()})

        return queries.select("vec_id", "v").mapInPandas(ask, f"bundles array<long>, asked binary, vec_id long, v {kind}")

    asks = scratch.save(asks_of(base.where("is_query"), True), "probes")
    scratch.drop(whole)
    found = scratch.save(_search(posts, asks, len(c), k), "found")
    # a query that its lists leave with fewer than k rows is asked of every list
    got = found.select("query_id", "vec_id").distinct().groupBy("query_id").count().where(F.col("count") >= k)
    short = scratch.save(asks.join(got, asks.vec_id == got.query_id, "left_anti").select("vec_id", "v"), "short")
    if not short.isEmpty() and len(c) > 1:
        found = found.union(_search(posts, asks_of(short, False), len(c), k))
    found = found.repartition("query_id").distinct()  # ranks need no other shuffle
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _search(posts: DataFrame, asks: DataFrame, lists: int, k: int) -> DataFrame:
    """The best k rows of each cell for each query asked of it."""
    asks = asks.select(F.explode("bundles").alias("bundle"), "asked", "vec_id", "v")
    # one row for each bundle, MAX_BUNDLES at most
    rows, queries = (t.groupBy("bundle").count().toPandas().set_index("bundle")["count"] for t in (posts, asks))
    cut = posts.sparkSession.createDataFrame(
        [(int(i), max(1, math.ceil(rows[i] / CELL_ROWS)), max(1, math.ceil(queries.get(i, 0) / CELL_QUERIES))) for i in rows.index], "bundle long, cr long, cq long")
    zero = F.lit(0).cast("long")
    p = posts.join(F.broadcast(cut), "bundle").select("bundle", F.pmod(F.xxhash64("vec_id"), F.col("cr")).alias("r"), F.explode(F.sequence(zero, F.col("cq") - 1)).alias("q"), "lists", "vec_id", "v")
    a = asks.join(F.broadcast(cut), "bundle").select("bundle", F.explode(F.sequence(zero, F.col("cr") - 1)).alias("r"), F.pmod(F.xxhash64("vec_id"), F.col("cq")).alias("q"), "asked", "vec_id", "v")
    return p.groupBy("bundle", "r", "q").cogroup(a.groupBy("bundle", "r", "q")).applyInPandas(_cell(k, lists), "query_id long, vec_id long, score double")


def op10_ann_postings(spark, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 50 == 0, 5)
