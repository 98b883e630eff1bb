"""Registered queries: lossless codes in blocks, and back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import coded_blocks as B
from tidemark.operators.cut import cut
from tidemark.plans.registry import register
from tidemark.points import POINTS_SQL, from_events, r6

_SIZE = 64
_I = f"i AS (SELECT *, (r - 1) // {_SIZE} AS block, CAST((r - 1) % {_SIZE} AS INTEGER) AS i FROM (SELECT *, row_number() OVER (PARTITION BY tag_id ORDER BY us, seq) AS r FROM p))"
_W = "OVER (PARTITION BY tag_id, block ORDER BY i)"
_BYTES = " || ".join(
    f"CASE WHEN {k} = 0 OR z >> {7 * k} > 0 THEN lpad(to_hex(((z >> {7 * k}) & 127) + CASE WHEN {'z >> ' + str(7 * (k + 1)) + ' > 0' if k < 8 else 'false'} THEN 128 ELSE 0 END), 2, '0') ELSE '' END" for k in range(9))


@register("time_blocks", f"""WITH {POINTS_SQL}, {_I}, d AS (SELECT *, us - coalesce(lag(us) {_W}, 0) AS d FROM i), z AS (SELECT *, CASE WHEN d >= 0 THEN 2 * d ELSE -2 * d - 1 END AS z FROM d)
SELECT tag_id, block, CAST(count(*) AS INTEGER) AS n, string_agg({_BYTES}, '' ORDER BY i) AS data FROM z GROUP BY tag_id, block""")
def _times(spark, sf_dir):
    return B.encode_times(from_events(spark, sf_dir), _SIZE).withColumn("data", F.hex("data"))


@register("time_blocks_back", f"WITH {POINTS_SQL}, {_I} SELECT tag_id, block, i, us FROM i")
def _times_back(spark, sf_dir):
    return B.decode_times(cut(B.encode_times(from_events(spark, sf_dir), _SIZE)))


def _two(width: int) -> str:
    return f"right(lpad(bin(CASE WHEN s < 0 THEN s + {1 << width}::HUGEINT ELSE s END), {width}, '0'), {width})"


@register("second_difference_blocks", f"""WITH {POINTS_SQL}, {_I}, d AS (SELECT *, us - lag(us) {_W} AS d FROM i), s AS (SELECT *, CAST(d - coalesce(lag(d) {_W}, 0) AS HUGEINT) AS s FROM d),
c AS (SELECT *, CASE WHEN i = 0 THEN lpad(bin(us), 64, '0') WHEN s = 0 THEN '0' WHEN s BETWEEN -64 AND 63 THEN '10' || {_two(7)} WHEN s BETWEEN -256 AND 255 THEN '110' || {_two(9)} WHEN s BETWEEN -2048 AND 2047 THEN '1110' || {_two(12)} ELSE '1111' || {_two(64)} END AS code FROM s)
SELECT tag_id, block, CAST(count(*) AS INTEGER) AS n, CAST((sum(length(code)) + 7) // 8 AS INTEGER) AS bytes, left(rpad(string_agg(code, '' ORDER BY i), CAST((sum(length(code)) + 7) // 8 * 8 AS INTEGER), '0'), 200) AS head FROM c GROUP BY tag_id, block""")
def _second(spark, sf_dir):
    b = B.encode_second(from_events(spark, sf_dir), _SIZE)
    return b.select("tag_id", "block", "n", F.length("data").alias("bytes"), F.substring(B._unpacked("data"), 1, 200).alias("head"))


@register("second_difference_back", f"WITH {POINTS_SQL}, {_I} SELECT tag_id, block, i, us FROM i")
def _second_back(spark, sf_dir):
    return B.decode_second(cut(B.encode_second(from_events(spark, sf_dir), _SIZE)))


def _symbols(spark, sf_dir):
    return from_events(spark, sf_dir).where("value is not null").withColumn("symbol", F.least(F.lit(255), F.greatest(F.lit(0), F.floor("value"))).cast("int"))


_SYMBOL = "CAST(least(255, greatest(0, floor(value))) AS INTEGER)"


@register("prefix_code_cost", f"""WITH RECURSIVE {POINTS_SQL}, c AS (SELECT {_SYMBOL} AS symbol, count(*) AS n FROM p WHERE value IS NOT NULL GROUP BY ALL),
h AS (SELECT list_sort(list(n)) AS l, 0::BIGINT AS cost FROM c UNION ALL SELECT list_sort(list_append(l[3:], l[1] + l[2])), cost + l[1] + l[2] FROM h WHERE len(l) > 1)
SELECT (SELECT count(*) FROM c) AS symbols, CAST((SELECT sum(n) FROM c) AS BIGINT) AS n, round(max(cost) / (SELECT sum(n) FROM c), 6) + 0.0 AS average_bits, round((SELECT sum(-n / t * log2(n / t)) FROM c, (SELECT sum(n) AS t FROM c)), 6) + 0.0 AS entropy FROM h""")
def _cost(spark, sf_dir):
    """Mean bits of the whole parts of all values in an optimal prefix code, whichever of them it is."""
    return B.average_bits(B.code_table(_symbols(spark, sf_dir))).select("symbols", "n", r6(F.col("average_bits")).alias("average_bits"), r6(F.col("entropy")).alias("entropy"))


@register("prefix_code_back", f"WITH {POINTS_SQL.replace('FROM events)', 'FROM events WHERE isfinite(value))')}, {_I} SELECT tag_id, block, i, {_SYMBOL} AS symbol FROM i")
def _symbols_back(spark, sf_dir):
    p = _symbols(spark, sf_dir)
    table = cut(B.code_table(p))
    return B.decode_symbols(cut(B.encode_symbols(p, table, _SIZE)), table)


@register("value_blocks_back", f"WITH {POINTS_SQL.replace('FROM events)', 'FROM events WHERE isfinite(value))')}, {_I} SELECT tag_id, block, i, value FROM i")
def _values_back(spark, sf_dir):
    return B.decode_values(cut(B.encode_values(from_events(spark, sf_dir), _SIZE)))
