"""Fill-in-the-middle: texts cut in three and their parts put in another order.

An Arrow-batched pandas UDF cuts a text into units (a run of A-Z letters, or one other
character) with the regex library; the ends of all units of a text lie in one array of
4-byte offsets, and the two cuts are two look-ups in it. The cuts and the form come from
the SHA-256 of seed and document id alone, so a rerun, a retried task or another
order of the rows gives the same output.

Forms: plain (the text itself), psm (prefix, suffix, middle) and spm (suffix, prefix, middle),
each part behind its mark. A text that is empty or holds a mark stays plain, so a mark in an
output is always one that was put there, and `restore` rebuilds the text from output
and form.

A null text counts as the empty one and a null id as an id of no digits. Rows that repeat an id
share its draws, and repeated rows repeat the output. Extra columns are ignored, whatever
their names. Texts are never cut short; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import read

UNIT = regex.compile(r"[A-Za-z]+|[^A-Za-z]")
P, S, M = "<P>", "<S>", "<M>"
_CUT = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"
_BACK = "text string, sha256 string"


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four numbers below 2**32 that belong to a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


def rearrange(text: str, doc_id: int | None, seed: int = 1, plain_from: int = 90, spm_below: int = 20) -> tuple:
    """Units, form, code points of prefix and middle (None where plain), and the output of one text."""
    ends = array("I", (unit.end() for unit in UNIT.finditer(text)))
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not text or h3 % 100 >= plain_from or P in text or S in text or M in text:
        return len(ends), "plain", None, None, text
    first, second = sorted((h1 % (len(ends) + 1), h2 % (len(ends) + 1)))
    a, b = (ends[i - 1] if i else 0 for i in (first, second))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_below:
        return len(ends), "spm", a, b - a, f"{S}{suffix}{P}{prefix}{M}{middle}"
    return len(ends), "psm", a, b - a, f"{P}{prefix}{S}{suffix}{M}{middle}"


def rebuild(output: str, form: str) -> str:
    """The text that an output of a form was made from."""
    if form == "plain":
        return output
    opening, inner = (P, S) if form == "psm" else (S, P)
    one, found, rest = output.removeprefix(opening).partition(inner)
    two, found_m, middle = rest.partition(M)
    if form not in ("psm", "spm") or not output.startswith(opening) or not found or not found_m:
        raise ValueError(f"this is no output of the form {form}")
    return one + middle + two if form == "psm" else two + middle + one


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output and output_sha256 of every document.

    Of 100 documents about `plain_from` are rearranged, and `spm_below` of 100 such with the suffix first.
    """

    @F.pandas_udf(_CUT)
    def cut(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        ids = ids.astype("object").where(ids.notna(), None)
        rows = [rearrange(t or "", None if i is None else int(i), seed, plain_from, spm_below) for i, t in zip(ids, texts, strict=True)]
        out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
        out = out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})
        out["output_sha256"] = [_sha(x[-1]) for x in rows]
        return out

    key = F.col(id_col).cast("decimal(20,0)").cast("string")  # a nullable long would reach pandas as a double
    return docs.select(F.col(id_col).alias("doc_id"), cut(key, F.col(text_col)).alias("cut")).select("doc_id", "cut.*")


def restore(output: Column, form: Column) -> Column:
    """Struct of the text that an output was made from, and its SHA-256."""

    @F.pandas_udf(_BACK)
    def back(outputs: pd.Series, forms: pd.Series) -> pd.DataFrame:
        texts = [rebuild(o, f) for o, f in zip(outputs, forms, strict=True)]
        return pd.DataFrame({"text": pd.Series(texts, dtype="object"), "sha256": pd.Series([_sha(t) for t in texts], dtype="object")})

    return back(output, form)


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """Digests of the output of every document, and of the text rebuilt from it."""
    rows = fill_in_middle(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.withColumn("back", restore(F.col("output"), F.col("form"))).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.col("back.sha256").alias("restored_sha256"))


SQL = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS s, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), u AS (
  SELECT doc_id, s, regexp_extract_all(s, '[A-Za-z]+|[^A-Za-z]') AS w,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM t
), c AS (
  SELECT *, CAST(len(w) AS BIGINT) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
         CASE WHEN s = '' OR contains(s, '<P>') OR contains(s, '<S>') OR contains(s, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (
  SELECT doc_id, s, n, form, coalesce(array_to_string(w[1:a], ''), '') AS pre, coalesce(array_to_string(w[a + 1:b], ''), '') AS mid,
         coalesce(array_to_string(w[b + 1:n], ''), '') AS suf FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN s WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(s) AS restored_sha256
FROM p
"""
