"""MinHash near-duplicate groups: one-permutation hashing with optimal densification.

A document's set holds the 64-bit hashes of its distinct five-word shingles (of
its whole word sequence if that is shorter). One hash of each shingle picks both
its bin and its value; an empty bin borrows the value of the bin that its own
seeded probe order meets first. The signature is cut into bands, equal bands meet
in a bucket, and each bucket proposes a star: its hub against the others. Pairs
whose signatures agree in too few bins (MIN_EQUAL) are dropped, the others
confirmed on full sets (100 * shared >= 75 * union). Buckets whose members then still
lie in several components propose further stars (STARS), each from a new hub to the
members of other components. What is left after them is gone through exactly:
blocks of a bucket's members are compared across components inside a task (a pair only in the
bucket of the first band in which it agrees), by signature and, where that allows a link, on full sets, and a task returns a spanning forest of the links it found, so fewer rows than
it read. Blocks by themselves come first; only buckets that they leave in several
components are compared block against block. So a star loses no link that its
bucket holds, and no bucket's pairs are written out.

With 32 bands of 4 values a pair of similarity exactly 0.75 is missed with a
probability of about 5e-6, of 0.8 with 5e-8; that it agrees in under 72 of 128
bins has a probability of about 5e-7.

Equal sets are one class from the start and take part once. Empty and null texts
have empty sets and link with nothing. Rows of one doc_id are one document.
Rows without doc_id get no component and are not kept. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, mix, read, row_sums, seeded, small_batches, unique_per_row, word_hashes
from tidemark.llm.components import connected

SHINGLE = 5
BINS, ROWS = 128, 4
PERCENT = 75
#: Bins in which two signatures must agree; 96 are expected at similarity 0.75, with a deviation of 5.
MIN_EQUAL = 72
#: Rounds of stars before buckets are compared in blocks.
STARS = 3
#: Members of a bucket, and shingles of theirs, in one block; a task compares two blocks.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
_BIN_BITS = 7
_MULT = seeded(64, 31) | np.uint64(1)
_TAG = seeded(SHINGLE + 1, 37)


def _probes() -> np.ndarray:
    """For each bin an own seeded order of all bins."""
    rng = np.random.Generator(np.random.PCG64(41))
    return np.stack([rng.permutation(BINS) for _ in range(BINS)])


_PROBES = _probes()


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and n+1 offsets."""
    hashes, rows = word_hashes(column)
    n = len(column)
    count = np.bincount(rows, minlength=n)
    with np.errstate(over="ignore"):
        if len(hashes) >= SHINGLE:
            m = len(hashes) - SHINGLE + 1
            whole = sum(hashes[i : i + m] * _MULT[i] for i in range(SHINGLE)) + _TAG[SHINGLE]
            ok = rows[:m] == rows[SHINGLE - 1 :]
            whole, of = mix(whole[ok]), rows[:m][ok]
        else:
            whole, of = hashes[:0], rows[:0]
        start = np.concatenate([[0], np.cumsum(count)])
        short = np.flatnonzero((count > 0) & (count < SHINGLE))
        if len(short):
            alone = np.array([sum((int(hashes[start[r] + i]) * int(_MULT[i]) for i in range(count[r])), int(_TAG[count[r]])) & 0xFFFFFFFFFFFFFFFF for r in short], np.uint64)
            whole, of = np.concatenate([whole, mix(alone)]), np.concatenate([of, short])
            order = np.argsort(of, kind="stable")
            whole, of = whole[order], of[order]
    return unique_per_row(whole, of, n)


def signatures(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One value for each bin of each set; rows of empty sets are meaningless."""
    n = len(offsets) - 1
    rows = np.repeat(np.arange(n), np.diff(offsets))
    bins = (sets >> np.uint64(64 - _BIN_BITS)).astype(np.int64)
    cell = rows * BINS + bins
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]  # sets are sorted, so a bin's least value comes first
    sig, full = np.zeros((n, BINS), np.uint64), np.zeros((n, BINS), bool)
    sig.ravel()[cell[first]], full.ravel()[cell[first]] = sets[first], True
    row, empty = np.nonzero(~full & (np.diff(offsets) > 0)[:, None])
    for t in range(BINS):
        if not len(row):
            break
        source = _PROBES[empty, t]
        hit = full[row, source]
        sig[row[hit], empty[hit]] = sig[row[hit], source[hit]]
        row, empty = row[~hit], empty[~hit]
    return sig


#: The bucket of each band of a stored signature: a hash of the band's values, with the band's number in its low five bits.
_KEYS = f"transform(sequence(0L, {BINS // ROWS - 1}L), b -> shiftleft(xxhash64(substring(sig, cast({2 * ROWS} * b + 1 as int), {2 * ROWS})), 5) | b)"
_SKETCH = "struct<n:bigint,d1:bigint,d2:bigint,sig:binary>"


def sketch(column: pa.Array) -> pa.Array:
    """Set size, two sums that tell sets apart, and 16 bits of each bin."""
    sets, offsets = shingle_sets(column)
    n = len(offsets) - 1
    size = np.diff(offsets)
    at = np.concatenate([[0], np.cumsum(mix(sets ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    other = np.concatenate([[0], np.cumsum(mix(sets + np.uint64(0x14057B7EF767814F)), dtype=np.uint64)])
    with np.errstate(over="ignore"):
        d1, d2 = at[offsets[1:]] - at[offsets[:-1]], other[offsets[1:]] - other[offsets[:-1]]
    short = signatures(sets, offsets).astype(np.uint16)
    return pa.StructArray.from_arrays(
        [pa.array(size.astype(np.int64)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array([x.tobytes() for x in short], pa.binary())],
        names=["n", "d1", "d2", "sig"])


def alike(left: pa.Array, right: pa.Array) -> pa.Array:
    """Whether two signatures agree in enough bins."""
    a, b = (np.frombuffer(b"".join(x.to_pylist()), np.uint16).reshape(-1, BINS) for x in (left, right))
    return pa.array((a == b).sum(axis=1) >= MIN_EQUAL)


def set_bytes(column: pa.Array) -> pa.Array:
    """The sorted shingle hashes of each text."""
    sets, offsets = shingle_sets(column)
    return pa.array([sets[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())


def linked(left: pa.Array, right: pa.Array) -> pa.Array:
    """Whether the full sets of two texts are similar enough."""
    a, ao = shingle_sets(left)
    b, bo = shingle_sets(right)
    shared = np.array([len(np.intersect1d(a[p:q], b[r:s], assume_unique=True)) for p, q, r, s in zip(ao[:-1], ao[1:], bo[:-1], bo[1:], strict=True)], np.int64)
    union = np.diff(ao) + np.diff(bo) - shared
    return pa.array((100 * shared >= PERCENT * union) & (union > 0))


def _confirm(pairs: DataFrame, sigs: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) whose texts link. Texts travel, as they are smaller than their sets."""
    both = pairs.join(sigs.toDF("a", "sa"), "a").join(sigs.toDF("b", "sb"), "b")
    near = scratch.save(both.where(F.arrow_udf(alike, "boolean")("sa", "sb")).select("a", "b").distinct(), "near")
    if near.isEmpty():
        return near
    full = near.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")
    return scratch.save(full.where(F.arrow_udf(linked, "boolean")("ta", "tb")).select("a", "b").distinct(), "links")


def near_groups(docs: DataFrame) -> DataFrame:
    """docs' doc_id with n_shingles, component_id and kept; one row per row of docs."""
    spark = docs.sparkSession
    small_batches(spark, "256")
    scratch = Scratch(spark, "neardup")
    docs = docs.select("doc_id", "text")
    base = scratch.save(docs.select("doc_id", F.arrow_udf(sketch, _SKETCH)("text").alias("s")).select("doc_id", "s.*"), "sketch")
    live = base.where("n > 0 and doc_id is not null")
    classes = scratch.save(live.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep")), "classes")
    members = scratch.save(live.select("doc_id", "n", "d1", "d2").join(classes, ["d1", "d2", "n"]).select("doc_id", "n", "rep"), "members")
    twice = members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("a", "b")

    reps = live.withColumnRenamed("doc_id", "rep").join(classes, ["rep", "n", "d1", "d2"]).select(F.col("rep").alias("id"), "n", "sig")
    bands = reps.select(F.explode(F.expr(_KEYS)).alias("key"), "id", "n")
    shared = bands.groupBy("key").count().where("count > 1").select("key")
    cand = scratch.save(bands.join(shared, "key"), "buckets")
    # The texts of bucket members are shuffled once; their ids grow with the input, so they are never broadcast.
    in_buckets = scratch.save(cand.select("id").distinct(), "ids").hint("merge")
    sigs = scratch.save(reps.select("id", "sig").join(in_buckets, "id", "left_semi"), "signatures")
    texts = scratch.save(docs.join(in_buckets.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi"), "texts")
    groups = scratch.save(connected(twice, scratch), "groups")
    rest, tested = _unsettled(cand, groups, scratch, 2), None
    for seed in range(STARS):
        if rest.isEmpty():
            break
        pairs = _stars(rest, seed)
        pairs = scratch.save(pairs.join(tested, ["a", "b"], "left_anti") if tested else pairs, "pairs")
        tested = tested.union(pairs) if tested else pairs
        groups = _merge(groups, _confirm(pairs, sigs, texts, scratch), scratch)
        rest = _unsettled(rest, groups, scratch)
        if not rest.isEmpty():
            sigs, texts = _narrow(rest, scratch, sigs, texts)
    for across in (False, True):
        if rest.isEmpty() or across and rest.where("blocks > 1").isEmpty():
            break
        cells = _cells(rest, across).join(sigs, "id").select(*_CELL, "sig")
        hopeful = scratch.save(cells.groupBy("key", "x", "y").applyInPandas(_hopeful, cells.schema), "hopeful")
        ids = hopeful.select(F.col("id").alias("doc_id")).distinct()
        full = texts.join(ids, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), F.arrow_udf(set_bytes, "binary")("text").alias("set"))
        found = scratch.save(hopeful.join(full, "id").groupBy("key", "x", "y").applyInPandas(_cell, "a long, b long").distinct(), "links")
        groups = _merge(groups, found, scratch)
        rest = _unsettled(rest, groups, scratch)

    scratch.drop(cand, sigs, texts)
    component = members.join(groups, members.rep == groups.id, "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    return (
        base.select("doc_id", F.col("n").alias("n_shingles")).join(component, "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    )


def _merge(groups: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Components after further links, found among the components that the links touch."""
    if links.isEmpty():
        return groups
    of = lambda c: groups.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    moved = scratch.save(connected(between, scratch).select(F.col("id").alias("component"), F.col("component").alias("to")), "moved")
    kept = groups.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    fresh = moved.select(F.col("component").alias("id"), F.col("to").alias("component")).join(groups.select("id"), "id", "left_anti")
    return scratch.save(kept.union(fresh), "groups")


def _unsettled(cand: DataFrame, groups: DataFrame, scratch: Scratch, least: int = 3) -> DataFrame:
    """Rows of buckets whose members lie in several components: key, id, n, c, and the bucket's number of blocks.

    In a bucket of two, the first star has compared the only pair.
    """
    now = cand.select("key", "id", "n").join(groups, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("c"))
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    mixed = now.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), blocks.alias("blocks"), F.count("*").alias("m"))
    mixed = mixed.where((F.col("lo") != F.col("hi")) & (F.col("m") >= least)).select("key", "blocks")
    return scratch.save(now.join(mixed, "key"), "unsettled")


def _narrow(rest: DataFrame, scratch: Scratch, *tables: DataFrame) -> list[DataFrame]:
    """The rows of tables whose id a bucket still holds, so that later rounds shuffle no others."""
    ids = rest.select("id").distinct()
    out = [scratch.save(t.join(ids.withColumnRenamed("id", t.columns[0]), t.columns[0], "left_semi"), "narrow") for t in tables]
    scratch.drop(*tables)
    return out


def _stars(rest: DataFrame, seed: int) -> DataFrame:
    """Pairs a < b of each bucket's hub and its members of other components whose sizes allow the similarity.

    Hubs follow one seeded order of all documents, so that the buckets of a group mostly share theirs.
    """
    hub = rest.groupBy("key").agg(F.min(F.struct(F.xxhash64("id", F.lit(3 + seed)).alias("o"), F.col("id"), F.col("n"), F.col("c"))).alias("hub"))
    fits = (F.col("c") != F.col("hub.c")) & (100 * F.least("n", "hub.n") >= PERCENT * F.greatest("n", "hub.n"))
    return rest.join(hub, "key").where(fits).select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")).distinct()


def _cells(rest: DataFrame, across: bool) -> DataFrame:
    """Members dealt to the cells (key, x, y) of their buckets: x = y for blocks by themselves, x < y for two blocks."""
    dealt = rest.withColumn("own", F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks")).cast("int"))
    if not across:
        return dealt.select("key", F.col("own").alias("x"), F.col("own").alias("y"), "own", "id", "n", "c")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = dealt.where("blocks > 1").withColumn("other", other).where("other <> own")
    return pairs.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", "n", "c")


_CELL = ("key", "x", "y", "own", "id", "n", "c")


def _place(rows: pd.DataFrame) -> tuple[int, int, int | None]:
    """A cell's two blocks and its band; without a key it is one cell for all bands."""
    return int(rows["x"].iloc[0]), int(rows["y"].iloc[0]), int(rows["key"].iloc[0]) & (BINS // ROWS - 1) if "key" in rows else None


def _agree(i: int, band: int | None, x: int, y: int, own: np.ndarray, n: np.ndarray, label: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """Members of other components, in the other block or after i in its own, whose size and signature allow a link with i.

    Two members meet in a bucket of each band in which they agree; the first of these has the pair.
    """
    later = np.arange(len(own)) > i if x == y else own == y
    may = np.flatnonzero(later & (label != label[i]) & (100 * np.minimum(n, n[i]) >= PERCENT * np.maximum(n, n[i])))
    if not len(may):
        return may
    same = sig[may] == sig[i]
    near = same.sum(axis=1) >= MIN_EQUAL
    if band is not None:
        near &= same.reshape(len(may), -1, ROWS).all(axis=2).argmax(axis=1) == band
    return may[near]


def _hopeful(rows: pd.DataFrame) -> pd.DataFrame:
    """The members of a cell that may link with another of it, by signature: only their sets are looked at."""
    x, y, band = _place(rows)
    n, own, label = (rows[k].to_numpy() for k in ("n", "own", "c"))
    sig = np.frombuffer(b"".join(rows["sig"]), np.uint16).reshape(-1, BINS)
    keep = np.zeros(len(rows), bool)
    for i in np.flatnonzero(own == x):
        may = _agree(i, band, x, y, own, n, label, sig)
        keep[may] = True
        keep[i] |= len(may) > 0
    return rows[keep]


def _cell(rows: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the links between the components of a cell's members."""
    x, y, band = _place(rows)
    ids, n, own = (rows[k].to_numpy() for k in ("id", "n", "own"))
    _, label = np.unique(rows["c"].to_numpy(), return_inverse=True)
    sig = np.frombuffer(b"".join(rows["sig"]), np.uint16).reshape(-1, BINS)
    sets = [np.frombuffer(s, np.uint64) for s in rows["set"]]
    out = []
    for i in np.flatnonzero(own == x):
        may = _agree(i, band, x, y, own, n, label, sig)
        if not len(may):
            continue
        other = np.concatenate([sets[j] for j in may])
        at = np.minimum(np.searchsorted(sets[i], other), len(sets[i]) - 1)
        shared = row_sums(sets[i][at] == other, np.concatenate([[0], np.cumsum([len(sets[j]) for j in may])]))
        for j in may[100 * shared >= PERCENT * (n[i] + n[may] - shared)]:
            if label[j] != label[i]:
                out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
                label[label == label[j]] = label[i]
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def op4_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_groups(read(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN ws IS NULL OR len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w
), e AS (SELECT doc_id, unnest(sh) AS x FROM s), n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * k >= 75 * (na.n + nb.n - k)),
y AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT y.b, r.c FROM r JOIN y ON r.id = y.a)
SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id, min(r.c) = n.doc_id AS kept FROM n JOIN r ON n.doc_id = r.id GROUP BY n.doc_id, n.n
"""
