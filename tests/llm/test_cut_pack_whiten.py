"""Fill-in-the-middle, packing and whitening against SQL, plain tokenisation and exact arithmetic, with edge cases."""

import hashlib
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from tidemark.llm import best_fit_pack, fill_middle, whitening


def docs_of(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    kinds = "doc_id long, text string, n long, form string, output string, part int, nth int, length int, piece int"
    return spark.createDataFrame([(i, t, 1, "x", "y", 2, 3, 4, 5) for i, t in rows], kinds)


EDGES = [(1, None), (2, ""), (3, "one"), (None, "no id here"), (None, None), (5, "ab " * 60_000), (6, "Äé\U0001F600\n\nx"), (6, "Äé\U0001F600\n\nx"), (7, "has <M> inside"), (2**62 + 1, "big id, 12 units")]


# 11. Fill in the middle


def test_fim_same_as_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(fill_middle.SQL).fetchdf().sort_values("doc_id").reset_index(drop=True)
    got = fill_middle.op11_fill_in_middle(spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert len(got) == len(want) > 0 and set(got["form"]) == {"plain", "psm", "spm"}
    for c in want.columns:
        pd.testing.assert_series_equal(got[c], want[c], check_dtype=False)
    assert dict(fill_middle.op11_fill_in_middle(spark, sf).dtypes) == {
        "doc_id": "bigint", "n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint", "output_sha256": "string", "restored_sha256": "string"}


def test_fim_edges(spark):
    rows = fill_middle.fill_in_middle(docs_of(spark, EDGES), plain_from=100)
    got = rows.withColumn("back", fill_middle.restore(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(EDGES)
    assert sorted((r["doc_id"] or 0, r["back"]["text"]) for r in got) == sorted((i or 0, t or "") for i, t in EDGES)
    by = {(r["doc_id"], r["n"]): r for r in got}
    assert by[1, 0]["form"] == by[2, 0]["form"] == by[None, 0]["form"] == "plain" and by[1, 0]["prefix_chars"] is None
    assert by[7, 7]["form"] == "plain" and by[7, 7]["output"] == "has <M> inside"
    assert by[5, 120_000]["output_sha256"] == hashlib.sha256(by[5, 120_000]["output"].encode()).hexdigest()
    assert by[6, 6]["n"] == 6 and len([r for r in got if r["doc_id"] == 6]) == 2
    n, form, prefix, middle, out = fill_middle.rearrange("big id, 12 units", 2**62 + 1, plain_from=100)
    big = by[2**62 + 1, n]
    assert (form, prefix, middle, out) == (big["form"], big["prefix_chars"], big["middle_chars"], big["output"])
    assert fill_middle.fill_in_middle(docs_of(spark, EDGES).limit(0)).count() == 0


def test_fim_forms_by_hand():
    text = "ab, cd<P"
    units = regex.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    for doc in range(400):
        h = hashlib.sha256(f"1:{doc}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
        a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        want = text if h3 % 100 >= 90 else f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
        n, form, _, _, out = fill_middle.rearrange(text, doc)
        assert (n, out) == (len(units), want) and fill_middle.rebuild(out, form) == text
    for bad in (("no marks", "psm"), ("<P>a<S>b", "psm"), ("<S>a<M>b", "spm"), ("x", "other")):
        with pytest.raises(ValueError):
            fill_middle.rebuild(*bad)


# 12. Packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(best_fit_pack.VOCABULARY))


def test_word_ids_are_the_tokenizers(tokenizer):
    known, rng = best_fit_pack.words(public_tokenizers.path(best_fit_pack.VOCABULARY)), np.random.default_rng(3)
    plain, odd = "abcXYZ ÀéßıſÿŸŉª²½·×'.,!<|>_-\t\n\r0123'sdt'RE", "ab ÀİǅȺ日本̈ΣσςKJ̌H̱\x0b\x1c\x85\xa0\xad<|>'s1"
    for i in range(8000):
        text = "".join(rng.choice(list(odd if i % 2 else plain), rng.integers(0, 30)))
        if i % 9 == 0:
            text += f"<|endoftext|>{text}<|STARTOFTEXT|>"
        assert np.frombuffer(best_fit_pack.token_bytes(known, text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def check_packing(got: pd.DataFrame, want: dict, capacity: int) -> int:
    """Every piece of every document once, with its checksum, sequences gapless and none too long; returns their number."""
    seen = {}
    for r in got.itertuples():
        key = (r.doc_id if r.doc_id == r.doc_id else None, r.piece, r.start, r.length, r.ids_crc32)
        seen[key] = seen.get(key, 0) + 1
    assert seen == want
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        ends = s["length"].cumsum()
        assert (s["offset"].to_numpy() == np.concatenate([[0], ends[:-1]])).all() and ends.iloc[-1] <= capacity
    return got["sequence_id"].nunique()


def pieces_of(tokenizer, docs, capacity):
    want = {}
    for i, t in docs:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for p in range(-(-len(ids) // capacity)):
            own = ids[p * capacity : (p + 1) * capacity]
            key = (i, p, p * capacity, len(own), zlib.crc32(own.tobytes()))
            want[key] = want.get(key, 0) + 1
    return want


def test_packing_query(spark, sf, tokenizer):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    df = best_fit_pack.op12_best_fit_packing(spark, sf)
    assert dict(df.dtypes) == {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    used = check_packing(df.toPandas(), pieces_of(tokenizer, docs, 4096), 4096)
    assert used == -(-df.agg(F.sum("length")).first()[0] // 4096)


def test_packing_edges(spark, tokenizer):
    rows = [*EDGES[:-1], *[(100 + i, "same text") for i in range(500)]]
    pieces = best_fit_pack.cut_pieces(docs_of(spark, rows), capacity=64)
    packed = best_fit_pack.pack(pieces, 64)
    got = packed.withColumn("ids_crc32", F.crc32("ids"))
    used = check_packing(got.toPandas(), pieces_of(tokenizer, rows, 64), 64)
    assert used <= -(-packed.agg(F.sum("length")).first()[0] // 64) + 1
    whole = best_fit_pack.sequences(packed).collect()
    assert len(whole) == used and all(len(r["ids"]) == 4 * r["length"] for r in whole)
    by = {(r["sequence_id"], r["offset"]): bytes(r["ids"]) for r in packed.collect()}
    for r in whole:
        for s in r["spans"]:
            assert bytes(r["ids"])[4 * s["offset"] : 4 * (s["offset"] + s["length"])] == by[r["sequence_id"], s["offset"]]
    empty = best_fit_pack.pack(best_fit_pack.cut_pieces(docs_of(spark, rows).limit(0)))
    assert empty.count() == 0


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for x in sorted(lengths, reverse=True):
        fit = [(g, i) for i, g in enumerate(gaps) if g >= x]
        if fit:
            gaps[min(fit)[1]] -= x
        else:
            gaps.append(capacity - x)
    return len(gaps)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_no_worse_than_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([10, 64, 300]))
    lengths = rng.integers(1, capacity + 1, 400) if seed % 3 else np.minimum(rng.geometric(4 / capacity, 700), capacity)
    counts = np.bincount(lengths, minlength=capacity + 1)
    made = best_fit_pack.plan(counts)
    used = np.zeros(capacity + 1, int)
    for filling, times in made:
        assert sum(filling) <= capacity
        np.add.at(used, list(filling), times)
    assert (used == counts).all()
    assert sum(t for _, t in made) <= best_fit_decreasing(lengths, capacity)


def test_combinations_fill_gaps_exactly():
    stock = best_fit_pack.Stock(np.bincount([5, 5, 9, 20, 21, 21], minlength=64))
    assert stock.exact(9) == (9,) and stock.exact(10) == (5, 5) and stock.exact(29) == (20, 9) and stock.exact(47) == (21, 21, 5)
    assert stock.exact(15) == () and stock.exact(63) == ()
    stock.take(5, 1)
    assert stock.exact(10) == () and stock.exact(14) == (9, 5)


def test_plan_for_many_pieces_has_few_fillings():
    rng = np.random.default_rng(5)
    counts = np.bincount(np.minimum(rng.geometric(1 / 300, 200_000), 4096), minlength=4097)
    counts[777] += 100_000
    one, many = best_fit_pack.plan(counts), best_fit_pack.plan(counts * 1000)
    assert len(many) < 20_000 and sum(t for _, t in many) == -(-int((counts * 1000) @ np.arange(4097)) // 4096)
    assert sum(t for _, t in one) == -(-int(counts @ np.arange(4097)) // 4096)


# 13. Whitening


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2.0, 3) for i, v in rows], "vec_id long, embedding array<float>, n int, x double, component int")


def exact(rows):
    """n, sums, covariance (fractions made doubles), and the x of every row, in plain integers."""
    xs = [(i, tuple(int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v)) for i, v in rows]
    fit = sorted({x for _, x in xs})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    cov = [[float(sum((Fraction(n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in fit), Fraction(0)) / n**3) for j in range(len(sums))] for i in range(len(sums))]
    return n, sums, np.array(cov), xs


def check_whitening(got: pd.DataFrame, rows, dim):
    n, sums, cov, xs = exact(rows)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(16, dim)
    assert len(got) == len(xs) * k and (got["n"] == n).all()
    assert (got["identity_error"] <= 1e-4).all() and got["identity_error"].nunique() == 1
    deviation = {}
    for i, x in xs:
        deviation.setdefault(i, []).append(sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)))
    for (i, _), g in got.groupby(["vec_id", "component"]):
        assert sorted(g["deviation"]) == sorted(deviation[i])
    for c, g in got.groupby("component"):
        assert g["explained"].to_numpy() == pytest.approx(values[c - 1] / np.trace(cov), rel=1e-9)
        want = {i: [] for i, _ in xs}
        for i, x in xs:
            want[i].append(float((np.array([Fraction(n * a - s, n) for a, s in zip(x, sums, strict=True)]).astype(float)) @ axes[:, c - 1] / np.sqrt(values[c - 1])))
        own = {i: sorted(w["whitened"]) for i, w in g.groupby("vec_id")}
        flip = 1 if np.allclose([own[i] for i in sorted(own)][0], sorted([want[i] for i in sorted(want)][0]), atol=1e-6) else -1
        for i in own:
            assert own[i] == pytest.approx(sorted(flip * v for v in want[i]), abs=1e-6)


def test_whitening_against_exact_arithmetic(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 20)) @ np.diag(np.logspace(0.5, -1, 20)) + rng.normal(size=20)
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)] + [rows[3], rows[3]]
    bad = [(5000, None), (5001, [float("nan")] * 20), (5002, [*rows[0][1][:19], None]), (5003, [*rows[0][1][:19], float("inf")])]
    got = whitening.whiten(vectors_of(spark, rows + bad).repartition(7), "vec_id", "embedding").toPandas()
    check_whitening(got, rows, 20)
    assert set(got["component"]) == set(range(1, 17)) and not set(got["vec_id"]) & {b[0] for b in bad}


def test_whitening_query(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    df = whitening.op13_embedding_whitening(spark, sf)
    assert dict(df.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    usable = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    got = df.toPandas()
    x = np.array([np.floor(64 * np.array(v, np.float64)).astype(np.int64) + 1_000_000 for _, v in usable])
    fit = np.unique(x, axis=0)
    centred = fit - fit.mean(axis=0)
    values = np.linalg.eigvalsh(centred.T @ centred / len(fit))[::-1]
    assert len(got) == len(usable) * 16 and (got["n"] == len(fit)).all() and (got["identity_error"] < 1e-9).all()
    deviation = ((len(fit) * x - fit.sum(axis=0)) ** 2).sum(axis=1)
    assert got[got["component"] == 1].set_index("vec_id")["deviation"].sort_index().tolist() == [d for _, d in sorted(zip([i for i, _ in usable], deviation.tolist(), strict=True))]
    assert got.groupby("component")["explained"].first().to_numpy() == pytest.approx(values[:16] / values.sum(), rel=1e-9)


def test_whitening_edges(spark):
    assert whitening.whiten(vectors_of(spark, [(1, [1.0, 2.0])]).limit(0), "vec_id", "embedding").count() == 0
    assert whitening.whiten(vectors_of(spark, [(1, None)]), "vec_id", "embedding").count() == 0
    assert whitening.whiten(vectors_of(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]), "vec_id", "embedding").count() == 0  # no variance
    short = whitening.whiten(vectors_of(spark, [(1, [1.0, 2.0]), (2, [1.0]), (None, [3.0, 1.0]), (4, [])]), "vec_id", "embedding").toPandas()
    assert len(short) == 8 and set(short["n"]) == {4} and short["vec_id"].isna().sum() == 2
    flat = whitening.whiten(vectors_of(spark, [(i, [float(i), float(-i), 7.0]) for i in range(9)]), "vec_id", "embedding").toPandas()
    assert set(flat["component"]) == {1} and flat["explained"].to_numpy() == pytest.approx(1.0) and (flat["identity_error"] < 1e-9).all()
    huge = whitening.whiten(vectors_of(spark, [(0, [0.0, 0.0]), (1, [3e38, 1.0]), (2, [-3e38, 5.0])]), "vec_id", "embedding").toPandas()
    assert len(huge) == 3 and (huge["identity_error"] < 1e-4).all() and huge["deviation"].max() == 2**63 - 1


def test_jacobi_finds_small_eigenvalues():
    rng = np.random.default_rng(0)
    for d in (1, 2, 5, 16, 33):
        scale = np.logspace(0, -9, d)
        q, _ = np.linalg.qr(rng.normal(size=(d, d)))
        a = (q * scale) @ q.T
        a = (a + a.T) / 2
        values, axes = whitening.jacobi(a)
        assert values == pytest.approx(scale, abs=1e-15) and axes.T @ axes == pytest.approx(np.eye(d), abs=1e-13)
        graded = np.diag(scale) @ (np.eye(d) + 0.1 * np.ones((d, d))) @ np.diag(scale)  # its small eigenvalues are well defined
        values, axes = whitening.jacobi(graded)
        assert np.prod(values / scale**2) == pytest.approx(1 + 0.1 * d, rel=1e-10)
    assert (whitening.jacobi(np.zeros((3, 3)))[0] == 0).all()
    assert sorted(tuple(x) for p, r in whitening._meets(7) for x in zip(p, r, strict=True)) == [(i, j) for i in range(7) for j in range(i + 1, 7)]
