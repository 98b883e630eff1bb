"""Language of web pages by Bayesian evidence fusion.

Four pieces of evidence are multiplied: the likelihood of the text under byte
trigram models, the declared markup language, the address suffix (a two-letter
first path segment, else the last label of the host), and a prior of the host that
is smoothed toward its site (last two labels), which is smoothed toward all pages.
The tables for the last three are grouped sums of the text posteriors over all
pages but the one that is told, so a wrong declaration, suffix or host costs what it is
worth in the corpus and no page speaks for itself.

Trigram models are fitted on a bounded seeded sample of labelled documents, PER_LANGUAGE
of each language, so every language that labels any document can be answered. A
text's log likelihood is its mean per trigram times min(trigrams, TEMPER), since
neighbouring trigrams are not independent. Null, empty and very short pages rest on
the other evidence; pages without url share the empty host and suffix. Without
labelled documents lang is null. Rows repeat as they come; columns besides
page_id, url and html are ignored by the query; identify() keeps all columns but html,
and replaces those named like its outputs.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, U64, buffers, read, row_sums, small_batches
from tidemark.llm.html_extract import host_of

#: Documents of each language that its model is fitted on.
PER_LANGUAGE = 1_000
BUCKETS_LOG2 = 14
#: Trigrams that a text counts as at most.
TEMPER = 48
#: Pseudo-counts: of a site's prior in a host's, of all pages' in a site's, and in the evidence tables.
HOST_WEIGHT, SITE_WEIGHT, TABLE_WEIGHT = 5.0, 5.0, 2.0

_STRIP = re.compile(r"<script\b.*?(?:</script[^>]*>|\Z)|<style\b.*?(?:</style[^>]*>|\Z)|<!--.*?(?:-->|\Z)|<[^>]*+>|&[#\w]{1,12};", re.DOTALL | re.IGNORECASE)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[:65] = 32  # digits, marks and white space are borders alike
_FOLD[91:97] = _FOLD[123:128] = 32


def trigram_buckets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each trigram inside a row, and n+1 offsets; runs of borders don't count."""
    b = _FOLD[raw]
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    a = b.astype(np.uint32)
    code = a[:-2] << np.uint32(16) | a[1:-1] << np.uint32(8) | a[2:]
    ok = (b[1:-1] != 32) | ((b[:-2] != 32) & (b[2:] != 32))
    cut = offsets[1:-1]
    for k in (1, 2):  # windows over the end of a row
        at = cut - k
        ok[at[(at >= 0) & (at < len(ok))]] = False
    keep = np.flatnonzero(ok)
    bucket = (code[keep].astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - BUCKETS_LOG2)
    return bucket.astype(np.int64), np.searchsorted(keep, offsets)


def _grams(text: pa.Array) -> pa.Array:
    raw, offsets = buffers(text)
    bucket, off = trigram_buckets(raw, offsets)
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(bucket.astype(np.int32)))


def text_model(docs: DataFrame, bound: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities of buckets [bucket, language], from counts made in Spark."""
    small_batches(docs.sparkSession, "500")
    order = F.struct(F.xxhash64("doc_id", F.lit(29)).alias("o"), "doc_id")
    # the first by the seeded order of each part of a language, then of the language: no language is one task
    part = Window.partitionBy("lang", F.pmod("doc_id", F.lit(256))).orderBy(order)
    ids = docs.where("doc_id is not null and lang is not null").select("doc_id", "lang").distinct()
    ids = ids.withColumn("r", F.row_number().over(part)).where(F.col("r") <= bound).withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(order))).where(F.col("r") <= bound)
    chosen = docs.select("doc_id", "lang", "text").join(ids.select("doc_id", "lang"), ["doc_id", "lang"])
    counts = chosen.select("lang", F.explode(F.arrow_udf(_grams, "array<int>")("text")).alias("b")).groupBy("lang", "b").count().toPandas()
    names = sorted(counts["lang"].unique())
    table = np.full((len(names), 1 << BUCKETS_LOG2), 0.5)
    for i, name in enumerate(names):
        own = counts[counts["lang"] == name]
        table[i, own["b"].to_numpy()] += own["count"].to_numpy()
    return names, np.log(table / np.maximum(table.sum(axis=1, keepdims=True), 1)).T.copy()


def _likelihoods(model: np.ndarray):
    def score(html: pa.Array) -> pa.Array:
        texts = [_STRIP.sub(" ", h) if h else "" for h in html.to_pylist()]
        raw, offsets = buffers(pa.array(texts, pa.large_string()))
        bucket, off = trigram_buckets(raw, offsets)
        n = np.diff(off)
        scale = np.minimum(n, TEMPER) / np.maximum(n, 1)
        lls = np.column_stack([row_sums(model[bucket, j], off) * scale for j in range(model.shape[1])])
        return pa.array(list(lls), pa.list_(pa.float64()))

    return score


def _softmax(x: Column) -> Column:
    e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def _sums(df: DataFrame, by: list[str], post: Column, n: int) -> DataFrame:
    return df.groupBy(*by).agg(F.array(*[F.sum(post[i]) for i in range(n)]).alias("s"))


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


OUTPUTS = ["host", "declared", "suffix", "text_lang", "lang", "probability"]


def identify(pages: DataFrame, names: list[str], model: np.ndarray) -> DataFrame:
    """pages with host, declared, suffix, text_lang, lang and probability."""
    spark = pages.sparkSession
    kept = [c for c in pages.columns if c.lower() not in [*OUTPUTS, "html"]]
    row = F.struct(*[F.col(c) for c in kept])
    if not names:
        return pages.select(*kept, host_of(F.col("url")).alias("host"), *[F.lit(None).cast("string").alias(c) for c in OUTPUTS[1:5]], F.lit(None).cast("double").alias("probability"))
    small_batches(spark, "500")
    scratch, n = Scratch(spark, "language"), len(names)
    host = host_of(F.col("url"))
    path = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([A-Za-z]{2})(?:[-_/?#]|$)", 1))
    lang_attr = F.regexp_extract("html", r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1)
    seen = pages.select(
        row.alias("row"), host.alias("host"), F.coalesce(F.lower(lang_attr), F.lit("")).alias("declared"),
        F.coalesce(F.when(path != "", F.concat(F.lit("/"), path)), F.regexp_extract(host, r"\.([a-z]{2,})$", 1), F.lit("")).alias("suffix"),
        F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("site"), F.arrow_udf(_likelihoods(model), "array<double>")("html").alias("ll"))
    seen = scratch.save(seen.withColumn("own", _softmax(F.col("ll"))), "text")
    # one row for each host, declaration and suffix is summed once; the coarser tables are sums of it
    cube = scratch.save(_sums(seen, ["site", "host", "declared", "suffix"], F.col("own"), n), "sums")
    s, own = F.col("s"), F.col("own")
    whole = [x or 0.0 for x in (cube.agg(*[F.sum(s[i]) for i in range(n)]).first() or [0.0] * n)]
    every = F.array(*map(F.lit, whole))
    tables = {by: scratch.save(_sums(cube, by.split(), s, n).withColumnRenamed("s", by.split()[-1] + "_s"), "table") for by in ("site", "site host", "declared", "suffix")}
    joined = seen.join(tables["site"], "site").join(tables["site host"], ["site", "host"]).join(tables["declared"], "declared").join(tables["suffix"], "suffix")

    # the tables without the page's own posterior, and their totals
    less = lambda sums: F.zip_with(sums, own, lambda a, b: F.greatest(a - b, F.lit(0.0)))
    joined = joined.withColumn("all_s", every)
    joined = joined.withColumns({k: less(F.col(k)) for k in ("all_s", "site_s", "host_s", "declared_s", "suffix_s")})
    joined = joined.withColumns({k.replace("_s", "_n"): _total(F.col(k)) for k in ("all_s", "site_s", "host_s", "declared_s", "suffix_s")})

    def smoothed(by: str, toward: Column, weight: float) -> Column:
        return F.zip_with(F.col(f"{by}_s"), toward, lambda a, p: (a + weight * p) / (F.col(f"{by}_n") + weight))

    def evidence(by: str) -> Column:
        """log P(value | language) for a page's value, smoothed toward the value's share of all pages."""
        share = (F.col(f"{by}_n") + 1e-6) / (F.col("all_n") + 1e-6)
        return F.zip_with(F.col(f"{by}_s"), F.col("all_s"), lambda a, w: F.log((a + TABLE_WEIGHT * share) / (w + TABLE_WEIGHT)))

    base = F.transform("all_s", lambda a: (a + 1.0) / (F.col("all_n") + n))
    joined = joined.withColumn("site_p", smoothed("site", base, SITE_WEIGHT))
    terms = joined.withColumns({"prior": smoothed("host", F.col("site_p"), HOST_WEIGHT), "d": evidence("declared"), "x": evidence("suffix")})
    fused = F.transform(F.arrays_zip("ll", "d", "x", "prior"), lambda t: t["ll"] + t["d"] + t["x"] + F.log(t["prior"]))
    best = lambda x: F.element_at(F.array(*map(F.lit, names)), F.array_position(x, F.array_max(x)).cast("int"))
    out = terms.withColumn("posterior", _softmax(fused))
    return out.select("row.*", "host", "declared", "suffix", best(F.col("ll")).alias("text_lang"), best(F.col("posterior")).alias("lang"), F.array_max("posterior").alias("probability"))


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    names, model = text_model(read(spark, sf_dir, "documents"))
    got = identify(read(spark, sf_dir, "pages").select("page_id", "url", "html"), names, model)
    return got.select("page_id", "url", "host", "declared", "suffix", "text_lang", "lang", F.round("probability", 6).alias("probability"))
