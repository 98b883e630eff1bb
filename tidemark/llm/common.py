"""Helpers shared by the corpus operators: scratch tables, hashing and text buffers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_MIX1, _MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
#: Rows of a table in one Arrow batch of a Python stage; keeps a worker's memory small with long texts.
BATCH_ROWS = "1000"


def session() -> SparkSession:
    return SparkSession.getActiveSession()


def small_batches(spark: SparkSession, rows: str = BATCH_ROWS) -> None:
    """Bound the rows of an Arrow batch, so that a batch of long texts stays a few MB."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; on local[*] a temporary one where none is set."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        conf = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, conf, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage; drop() removes them, the end of the program at the latest."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.top, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0
        atexit.register(self.drop)

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.top}/{self.n:03d}-{name}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for path in [t._scratch_path for t in tables] or [self.top]:
            jvm = self.spark._jvm
            with suppress(Exception):
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spare(df: DataFrame, *names: str) -> list[str]:
    """These names with underscores before them, as many as it takes to clash with no column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken or not name.startswith("_"):
            name = f"_{name}"
        out.append(name)
    return out


def fold(key: Column, n: int) -> Column:
    """crc32 of the key written as text, modulo n."""
    return F.crc32(key.cast("string").cast("binary")) % n


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x.astype(U64, copy=True)
        x ^= x >> U64(30)
        x *= _MIX1
        x ^= x >> U64(27)
        x *= _MIX2
        x ^= x >> U64(31)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n+1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


_BYTE = seeded(256, 11)
_STEP = U64(0x9E3779B97F4A7C15 | 1)
_INV = U64(pow(int(_STEP), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out, dtype=U64)


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of True that end at row borders: start, end and row of each."""
    flags = np.zeros(len(inside) + 2, np.int8)
    flags[1:-1] = inside
    edge = np.diff(flags)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(inside))]
    cuts = np.unique(cuts[inside[cuts] & inside[cuts - 1]]) if len(cuts) else cuts
    if len(cuts):
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 22) -> np.ndarray:
    """A 64-bit hash of each byte span: a polynomial by running sums, then a finaliser."""
    return prefix_hashes(raw, starts, ends, [], block)[0]


def prefix_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lengths: list[int], block: int = 1 << 22) -> list[np.ndarray]:
    """Hashes of whole spans, and of their first bytes for each length (whole where a span is shorter)."""
    out = [np.empty(len(starts), U64) for _ in range(len(lengths) + 1)]
    with np.errstate(over="ignore"):
        i = 0
        while i < len(starts):  # in blocks of spans, so that the running sums stay small
            base = int(starts[i])
            j = max(i + 1, int(np.searchsorted(ends, base + block, side="right")))
            top = int(ends[j - 1])
            sums = np.zeros(top - base + 1, U64)
            np.cumsum(_BYTE[raw[base:top]] * _powers(_STEP, top - base), out=sums[1:], dtype=U64)
            s, e = starts[i:j] - base, ends[i:j] - base
            back = _powers(_INV, top - base + 1)[s]
            for o, cut in zip(out, [e, *(np.minimum(e, s + n) for n in lengths)], strict=True):
                o[i:j] = (sums[cut] - sums[s]) * back + (cut - s).astype(U64)
            i = j
    return [mix(o) for o in out]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each white-space word, with A-Z in lower case."""
    raw, offsets = buffers(column)
    raw = _LOWER[raw]
    starts, ends, rows = spans(~_SPACE[raw], offsets)
    return span_hashes(raw, starts, ends), rows


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums over [offsets[i], offsets[i+1]); 0 where that is empty."""
    out = np.zeros(len(offsets) - 1, np.int64 if values.dtype.kind in "iub" else values.dtype)
    full = offsets[:-1] < offsets[1:]
    if full.any():
        out[full] = np.add.reduceat(values, offsets[:-1][full], dtype=out.dtype)
    return out


def unique_per_row(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row, sorted within it, and n+1 offsets."""
    bounds = np.searchsorted(rows, np.arange(n + 1))
    parts = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return (np.concatenate(parts) if parts else hashes[:0]), offsets


def label_sample(labels: DataFrame, id_col: str, label_col: str, train: Column, bound: int) -> DataFrame:
    """At most `bound` labelled ids of the training fold, the same ones each time.

    An id whose label rows disagree, and null ids or labels, are left out.
    """
    return (
        labels.where(train & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
        .groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_label"), F.max(label_col).alias("_high"))
        .where("_label = _high").drop("_high")
        .orderBy(F.xxhash64("_id", F.lit(17)), "_id").limit(bound)
    )
