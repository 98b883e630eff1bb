"""Packing of token pieces into sequences by exact complements, then best fit.

Documents are tokenised and cut in one pass, and the pieces are written with their number among
the pieces of the same length in their partition. Only the count of each length goes to the
driver: at most `capacity` numbers, however many documents there are. There a plan is made over
lengths, not over pieces. It opens a sequence with the longest length left and looks the gap up
in an index of the lengths, and of the sums of two and of three of them, that are still in stock;
a combination that fills the gap exactly is used, and the whole filling as many times
as the stock allows. Where no combination fits, the longest length that fits goes in (best fit), and the
smaller gap is looked up again. Each filling used up at least one length, so the plan has at
most a few fillings per length.

A length's places in the plan are intervals of its piece numbers. The number of a piece is its
number in the partition plus the count of the partitions before, a window over counts,
so no length is ever gathered, not even one that a third of all pieces share. The plan
goes to the tasks as arrays that `capacity` bounds.

A null text counts as the empty one; every document has its end mark, so no document is without a piece.
Null and repeated ids, and repeated rows, are packed like any other row. Extra columns are
ignored. An empty table gives no rows. Only documents longer than `capacity` are cut. A text of any
length is one row of a task's batch; ids leave the task in batches of a few MB.

A text of Latin letters, digits and ASCII signs is split by the vocabulary's own pattern, and the ids of each word are
asked of the library once and remembered; any other text goes to the library whole. The ids are the same.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, read

CAPACITY = 4096
END = 1
VOCABULARY = "word_bpe_49k.json"
#: The split pattern of the vocabulary over Latin letters, and what has to go to the library whole.
_LETTER = "a-zA-Z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
_DIGIT = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^\\s{_LETTER}{_DIGIT}]+")
_ODD = re.compile("[^\t\n\r -~\u00a1-\u012f\u0131-\u017f]|<\\|(?:start|end)oftext\\|>")
#: Longer words aren't remembered; beyond so many words a worker forgets them all and begins anew.
_WORD, _WORDS = 40, 1_000_000
_BATCH_BYTES = 4 << 20
_PIECES = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("nth", pa.int64()), ("ids", pa.binary())])


class _Words(dict):
    """Little-endian unsigned 32-bit ids of the vocabulary's words, filled as they come."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.word = Tokenizer(self.whole.model)
        self.word.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def __missing__(self, word: str) -> bytes:
        ids = _packed(self.word.encode(word, add_special_tokens=False).ids)
        if len(word) <= _WORD:
            if len(self) >= _WORDS:
                self.clear()
            self[word] = ids
        return ids


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def words(path: str) -> _Words:
    return _Words(path)


def token_bytes(known: _Words, text: str) -> bytes:
    """The ids of a text, four bytes each."""
    if _ODD.search(text):
        return _packed(known.whole.encode(text, add_special_tokens=False).ids)
    return b"".join(map(known.__getitem__, _SPLIT.findall(text.lower())))


def _cutter(vocabulary: str, capacity: int, end: int):
    mark = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen, part = words(public_tokenizers.path(vocabulary)), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        rows: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)

        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                ids, doc_id = token_bytes(known, text.as_py() or "") + mark, doc_id.as_py()
                for at in range(0, len(ids), 4 * capacity):
                    own = ids[at : at + 4 * capacity]
                    rows.append((part, doc_id, at // (4 * capacity), at // 4, len(own) // 4, int(seen[len(own) // 4]), own))
                    seen[len(own) // 4] += 1
                    held += len(own) + 64
                    if held >= _BATCH_BYTES:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()

    return run


def cut_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces of all documents: part and nth (which number a length's pieces), doc_id, piece, start, length, ids.

    Written to the shared folder: the numbers hold for this one writing.
    """
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _cutter(vocabulary, capacity, end), "part int, doc_id long, piece int, start long, length long, nth long, ids binary")
    return Scratch(docs.sparkSession, "pieces").save(out, "pieces")


class Stock:
    """Counts of lengths, with an index of the sums of two of them: how many pairs make each sum."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64)
        self.top = len(counts) - 1
        self.have = self.left > 0
        self.pairs = np.zeros(self.top + 1, np.int64)
        for x in np.flatnonzero(self.have).tolist():
            self._pair(x, np.flatnonzero(self.have[:x]), 1)
            self.pairs[2 * x : 2 * x + 1] += self.left[x] > 1

    def _pair(self, x: int, others: np.ndarray, by: int) -> None:
        sums = others + x
        self.pairs[sums[sums <= self.top]] += by

    def take(self, x: int, n: int) -> None:
        if not n:
            return
        before = self.left[x]
        self.left[x] = after = before - n
        if before > 1 >= after:
            self.pairs[2 * x : 2 * x + 1] -= 1
        if after == 0:
            self.have[x] = False
            self._pair(x, np.flatnonzero(self.have), -1)

    def longest(self, most: int) -> int:
        """The longest length in stock that isn't above `most`; 0 if there is none."""
        found = np.flatnonzero(self.have[: most + 1])
        return int(found[-1]) if len(found) else 0

    def _pairs_of(self, total: int) -> np.ndarray:
        low = np.arange(1, total // 2 + 1)
        return low[self.have[low] & self.have[total - low] & ((2 * low < total) | (self.left[low] > 1))]

    def exact(self, gap: int, most: int = 3) -> tuple[int, ...]:
        """Up to `most` (of three) lengths in stock that add up to the gap, long ones first; empty if none do."""
        if self.have[gap]:
            return (gap,)
        if most > 1 and self.pairs[gap]:
            low = int(self._pairs_of(gap)[0])
            return (gap - low, low)
        firsts = np.flatnonzero(self.have[:gap]) if most > 2 else np.zeros(0, np.int64)
        for x in firsts[self.pairs[gap - firsts] > 0][::-1].tolist():
            for low in self._pairs_of(gap - x).tolist():
                three = (x, gap - x - low, low)
                if all(self.left[y] >= three.count(y) for y in three):
                    return three
        return ()


def fillings(counts: np.ndarray, most: int = 3) -> list[tuple[tuple[int, ...], int]]:
    """Fillings of sequences by exact combinations of up to `most` lengths, then best fit, and how often each is used."""
    stock, out = Stock(counts), []
    while first := stock.longest(stock.top):
        filling, gap = [first], stock.top - first
        stock.take(first, 1)
        while gap and (more := stock.exact(gap, most) or (stock.longest(gap),)) != (0,):
            for x in more:
                stock.take(x, 1)
            filling += more
            gap -= sum(more)
        each = Counter(filling)
        again = int(min(stock.left[x] // n for x, n in each.items()))
        for x, n in each.items():
            stock.take(x, n * again)
        out.append((tuple(filling), again + 1))
    return out


def plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Fillings of sequences of len(counts) - 1 tokens, and how often each is used; counts[x] pieces have length x.

    Triples can use up short lengths that later sequences lack, so where waste is left, plans by
    pairs and by single lengths are made too, and the one with the fewest sequences is taken.
    """
    least, best = -(-int(counts @ np.arange(len(counts))) // (len(counts) - 1)), None
    for most in (3, 2, 1):
        made = fillings(counts, most)
        used = sum(times for _, times in made)
        if best is None or used < best[0]:
            best = used, made
        if used == least:
            break
    return best[1]


def _places(planned: list[tuple[tuple[int, ...], int]], capacity: int) -> tuple[np.ndarray, ...]:
    """Intervals of piece numbers: length, first number, sequence of the first number, offset; by length and number."""
    used, sequence, rows = np.zeros(capacity + 1, np.int64), 0, []
    for filling, times in planned:
        offset = 0
        for x in filling:
            rows.append((x, used[x], sequence, offset))
            used[x] += times
            offset += x
        sequence += times
    table = np.array(rows, np.int64).reshape(-1, 4)
    return tuple(table[np.lexsort((table[:, 1], table[:, 0]))].T)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces (without part and nth) with sequence_id and offset; other columns of pieces come along."""
    spark = pieces.sparkSession
    counts = Scratch(spark, "lengths").save(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "counts")
    totals = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        totals[r["length"]] = r["n"]
    sent = spark.sparkContext.broadcast(_places(plan(totals), capacity))  # bounded by capacity

    @F.pandas_udf("sequence_id long, offset long")
    def place(of: pd.Series, number: pd.Series) -> pd.DataFrame:
        length, low, sequence, offset = sent.value
        x, k = of.to_numpy(np.int64), number.to_numpy(np.int64)
        begin, end = np.searchsorted(length, x), np.searchsorted(length, x, side="right")
        at = np.empty(len(x), np.int64)
        for own in np.unique(x):
            rows = np.flatnonzero(x == own)
            b, e = begin[rows[0]], end[rows[0]]
            at[rows] = b + np.searchsorted(low[b:e], k[rows], side="right") - 1
        return pd.DataFrame({"sequence_id": sequence[at] + k - low[at], "offset": offset[at]})

    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("_before"))
    rows = pieces.join(base, ["length", "part"])
    kept = [c for c in pieces.columns if c not in ("part", "nth")]
    return rows.select(*kept, place("length", F.col("_before") + F.col("nth")).alias("_place")).select(*kept, "_place.*")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length and ids (little-endian unsigned 32-bit) of each sequence, and its spans: doc_id, piece, offset, length."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id", "piece", "length")))
    joined = F.aggregate("parts", F.lit(b""), lambda all_, p: F.concat(all_, p["ids"]))
    spans = F.transform("parts", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["piece"].alias("piece"), p["offset"].alias("offset"), p["length"].alias("length")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("length")).select("sequence_id", "length", joined.alias("ids"), spans.alias("spans"))


def op12_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Where each piece of every document lies, with a checksum of its ids."""
    pieces = cut_pieces(read(spark, sf_dir, "documents")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
