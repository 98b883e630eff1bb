"""Exact top-k search by inner product over a bit-sliced index.

Each vector component is quantised to an integer; bit j of attribute d over a
block of rows is one bitmap, a *slice*. The slices of a block are made once and stored
as one row of an index table, an eighth or less of its vectors; queries travel to them
in packed groups. The scores of a query against a whole block are built by adding slices
with bitmap arithmetic (carry-save adders), so the sum is itself bit-sliced. The best
rows are then found from the most significant slice of the sum downward, and rows equal
at the boundary are resolved by their id.

Rows whose vector is null, empty, or holds null or non-finite components, or
whose id is null, take no part. Vectors of different lengths compare over the
longer one, missing components counting 0 after quantisation. Quantised components
beyond a long are its nearest end. Sums are exact at any size; a score beyond a long is
ranked and shown as its nearest end. Repeated rows are candidates each and one query;
rows of one id with different vectors are queries of their own, ranked apart. A query
never meets rows of its own id. Columns other than the id and the vector are ignored,
whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, read

WORD = 64


def quantise(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component as double; null where the vector takes no part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.when((F.size(vector) > 0) & finite, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _slices(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bitmaps [slice, word] of values - low, the lows of all dims, and the number of slices of each dim."""
    low = values.min(axis=0)
    shifted = values.view(np.uint64) - low.view(np.uint64)  # right even where the range exceeds a long
    bits = np.array([int(x).bit_length() for x in shifted.max(axis=0)], np.int64)
    words = -(-len(values) // WORD)
    out = np.zeros((int(bits.sum()), words * 8), np.uint8)
    at = 0
    for d, n in enumerate(bits.tolist()):
        for j in range(n):
            packed = np.packbits(((shifted[:, d] >> np.uint64(j)) & np.uint64(1)).astype(np.uint8), bitorder="little")
            out[at, : len(packed)] = packed
            at += 1
    return out.view(np.uint64), low, bits


def _digits(q: int) -> list[tuple[int, int]]:
    """Signed binary digits (position, sign) of q with no two adjacent: few adders per weight."""
    out, i = [], 0
    while q:
        if q & 1:
            d = 2 - (q & 3)
            out.append((i, d))
            q -= d
        q >>= 1
        i += 1
    return out


def _add_slices(heap: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Sum bitmaps by weight: full adders turn three of a weight into one and a carry."""
    out, w = [], 0
    while w < len(heap):
        col = heap[w]
        if len(col) > 1 and w + 1 == len(heap):
            heap.append([])
        while len(col) > 2:
            a, b, c = col.pop(), col.pop(), col.pop()
            x = a ^ b
            heap[w + 1].append((a & b) | (x & c))
            col.insert(0, x ^ c)
        if len(col) == 2:
            a, b = col.pop(), col.pop()
            heap[w + 1].append(a & b)
            col.append(a ^ b)
        out.append(col[0] if col else None)
        w += 1
    return out


def _sum_bits(planes: list, rows: np.ndarray, constant: int) -> np.ndarray:
    """The integers at some rows of a bit-sliced sum, plus a constant, as longs or their nearest ends."""
    wide = len(planes) > 61 or abs(constant) >> 61
    total = np.full(len(rows), constant, object if wide else np.int64)
    word, bit = rows // WORD, (rows % WORD).astype(np.uint64)
    for j, p in enumerate(planes):
        if p is not None:
            one = ((p[word] >> bit) & np.uint64(1)).astype(np.int64)
            total += one.astype(object) << j if wide else one << j
    return np.array([min(max(t, -(1 << 63)), (1 << 63) - 1) for t in total], np.int64) if wide else total


def _bits_to_rows(bitmap: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[:n])


def _count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def block_top(index: np.ndarray, low: np.ndarray, bits: np.ndarray, ids: np.ndarray, query: np.ndarray, query_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the best k rows of a block; every row tied at the last place is weighed by id."""
    heap: list[list[np.ndarray]] = [[]]
    start, constant = np.concatenate([[0], np.cumsum(bits)]), 0
    for d in np.flatnonzero(query[: len(bits)]).tolist():
        q = int(query[d])
        constant += q * int(low[d])
        for pos, sign in _digits(q):
            for j in range(int(bits[d])):
                while len(heap) <= pos + j:
                    heap.append([])
                plane = index[start[d] + j]
                if sign < 0:  # -x = ~x - 1 on one bit
                    plane = ~plane
                    constant -= 1 << (pos + j)
                heap[pos + j].append(plane)
    planes = _add_slices(heap)
    open_ = np.packbits(ids != query_id, bitorder="little")
    open_ = np.pad(open_, (0, -len(open_) % 8)).view(np.uint64)
    sure, need = np.zeros(len(open_), np.uint64), k
    for p in reversed(planes):
        if p is None:
            continue
        high = open_ & p
        n = _count(high)
        if n > need:
            open_ = high
        else:
            sure |= high
            need -= n
            open_ = open_ & ~p
            if not need:
                open_[:] = 0
                break
    rows = _bits_to_rows(sure, len(ids))
    if need:  # all still open have one score: the smallest ids win
        tied = _bits_to_rows(open_, len(ids))
        rows = np.concatenate([rows, tied[np.argsort(ids[tied], kind="stable")[:need]]])
    return ids[rows], _sum_bits(planes, rows, constant)


def _matrix(vectors: pd.Series) -> np.ndarray:
    """Vectors as rows of longs, short ones filled up with zeros."""
    dim = max(map(len, vectors))
    return np.array([np.pad(np.asarray(x, np.int64), (0, dim - len(x))) for x in vectors]).reshape(len(vectors), dim)


def _index(rows: pd.DataFrame) -> pd.DataFrame:
    """A block's slices as one row."""
    slices, low, bits = _slices(_matrix(rows["v"]))
    return pd.DataFrame({"b": [rows["b"].iloc[0]], "ids": [rows["vec_id"].to_numpy(np.int64).tobytes()], "low": [low.tobytes()], "bits": [bits.tobytes()], "slices": [slices.tobytes()]})


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    """A group of queries as one row."""
    return pd.DataFrame({"qb": [rows["qb"].iloc[0]], "qids": [rows["vec_id"].to_numpy(np.int64).tobytes()], "asks": [_matrix(rows["v"]).tobytes()]})


def _search(k: int):
    def search(batches):
        for batch in batches:
            for r in batch.itertuples():
                ids, low, bits = (np.frombuffer(x, np.int64) for x in (r.ids, r.low, r.bits))
                index = np.frombuffer(r.slices, np.uint64).reshape(int(bits.sum()), -(-len(ids) // WORD))
                qids = np.frombuffer(r.qids, np.int64)
                asks = np.frombuffer(r.asks, np.int64).reshape(len(qids), -1)
                for n, (q, qid) in enumerate(zip(asks, qids, strict=True)):
                    i, s = block_top(index, low, bits, ids, q, qid, k)
                    yield pd.DataFrame({"query_id": qid, "q": f"{r.qb}.{n}", "vec_id": i, "score": s})

    return search


def top_k(vectors: DataFrame, id_col: str, vec_col: str, is_query: Column, k: int, scale: int = 64, block: int = 32768, query_block: int = 512) -> DataFrame:
    """Best k rows of each query: query_id, rank (from 1), vec_id, score.

    Rows are dealt by hash into blocks and queries into groups; a (block, group) pair
    is a task's unit, so memory is bounded by the two sizes whatever the table holds,
    and no broadcast grows with the data.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "bitslice")
    base = scratch.save(
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantise(F.col(vec_col), scale).alias("v"), is_query.alias("is_query")).where("vec_id is not null and v is not null"), "quantised")
    n, nq = base.agg(F.count("*"), F.count_if("is_query")).first()
    blocks, groups = max(1, math.ceil(n / block)), max(1, math.ceil(nq / query_block))
    rows = base.select(F.pmod(F.xxhash64("vec_id", "v", F.monotonically_increasing_id()), F.lit(blocks)).alias("b"), "vec_id", "v")
    index = scratch.save(rows.groupBy("b").applyInPandas(_index, "b long, ids binary, low binary, bits binary, slices binary"), "index")
    asks = base.where("is_query").select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(groups)).alias("qb"), "vec_id", "v").dropDuplicates(["vec_id", "v"])
    packed = scratch.save(asks.groupBy("qb").applyInPandas(_pack, "qb long, qids binary, asks binary"), "queries")
    cells = index.withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))).join(packed, "qb")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    cells = cells.repartition(min(blocks * groups, 20_000), "b", "qb")
    return ranked(cells.mapInPandas(_search(k), "query_id long, q string, vec_id long, score long"), k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query by score, ties to the smaller id, from a few candidates per block."""
    from pyspark.sql import Window

    w = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_exact_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0, 20)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
