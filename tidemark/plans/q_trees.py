"""Registered queries: trees as intervals, path search, closures under changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import hierarchy as H
from tidemark.operators import intervals as V
from tidemark.operators import tree_changes as C
from tidemark.plans.q_series import _TREE_SQL, _tree
from tidemark.plans.registry import register
from tidemark.points import r6

_ORDERED = """o AS (SELECT id, [id] AS line FROM t WHERE parent IS NULL UNION ALL SELECT t.id, list_append(line, t.id) FROM o JOIN t ON t.parent = o.id)"""
_LABELS = "l AS (SELECT id, row_number() OVER (ORDER BY line) AS pre, CAST(len(line) - 1 AS INTEGER) AS depth FROM o), z AS (SELECT ancestor AS id, count(*) AS size FROM c GROUP BY ancestor)"


@register("tree_intervals", f"WITH RECURSIVE {_TREE_SQL}, {_ORDERED}, {_LABELS} SELECT id, pre, pre + size - 1 AS last, depth, size FROM l JOIN z USING (id)")
def _intervals(spark, sf_dir):
    return V.labels(_tree(spark, sf_dir))


_SPINE_SQL = """t AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 10 <> 0 THEN p_partkey - p_partkey % 10 WHEN p_partkey > 0 THEN p_partkey - 10 END AS raw FROM part),
u AS (SELECT t.id, y.id AS parent FROM t LEFT JOIN t y ON t.raw = y.id), r AS (SELECT id, parent, id AS root, 0 AS depth FROM u WHERE parent IS NULL UNION ALL SELECT u.id, u.parent, r.root, r.depth + 1 FROM r JOIN u ON u.parent = r.id)"""


def _spine(spark, sf_dir):
    """Parts in a tree that is a tenth as deep as there are parts."""
    k = F.col("p_partkey")
    parent = F.when(k % 10 != 0, k - k % 10).when(k > 0, k - 10)
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(k.alias("id"), parent.alias("parent"), F.col("p_retailprice").alias("value"))


@register("deep_tree_totals", f"""WITH RECURSIVE {_SPINE_SQL}, x AS (SELECT id AS ancestor, id FROM u UNION ALL SELECT u.parent, x.id FROM x JOIN u ON x.ancestor = u.id WHERE u.parent IS NOT NULL)
SELECT r.id, r.depth, count(*) AS n, round(sum(p_retailprice), 4) + 0.0 AS total, round(avg(p_retailprice), 4) + 0.0 AS average FROM x JOIN r ON r.id = x.ancestor JOIN part ON p_partkey = x.id GROUP BY r.id, r.depth""")
def _deep(spark, sf_dir):
    t = _spine(spark, sf_dir)
    lab = V.labels(t)
    return V.subtree_sums(lab, t).join(lab.select("id", "depth"), "id").select("id", "depth", "n", r6(F.col("total"), 4).alias("total"), r6(F.col("average"), 4).alias("average"))


@register("subtree_totals", f"WITH RECURSIVE {_TREE_SQL} SELECT c.ancestor AS id, count(value) AS n, round(sum(value), 6) + 0.0 AS total, round(avg(value), 6) + 0.0 AS average FROM c JOIN t ON c.id = t.id GROUP BY c.ancestor")
def _totals(spark, sf_dir):
    t = _tree(spark, sf_dir)
    return V.subtree_sums(V.labels(t), t).select("id", "n", r6(F.col("total")).alias("total"), r6(F.col("average")).alias("average"))


@register("subtree_search", f"WITH RECURSIVE {_TREE_SQL} SELECT c.id, t.name FROM c JOIN t ON t.id = c.id WHERE c.ancestor = 'r:2' AND t.name GLOB '*[0-9]*'")
def _search(spark, sf_dir):
    t = _tree(spark, sf_dir)
    return V.below(V.labels(t), "r:2").join(t.where(F.col("name").rlike("[0-9]")), "id").select("id", "name")


@register("nearest_marked", f"""WITH RECURSIVE {_TREE_SQL}, m AS (SELECT id FROM t WHERE value > 5000 OR name LIKE '%A%' AND id NOT LIKE 'c:%')
SELECT t.id, n.mark FROM t LEFT JOIN (SELECT c.id, arg_min(c.ancestor, c.distance) AS mark FROM c JOIN m ON m.id = c.ancestor GROUP BY c.id) n USING (id)""")
def _nearest(spark, sf_dir):
    t = _tree(spark, sf_dir)
    return V.nearest_above(t, t.where((F.col("value") > 5000) | (F.col("name").like("%A%") & ~F.col("id").like("c:%"))))


@register("path_search", f"WITH RECURSIVE {_TREE_SQL}, q AS (SELECT c.id, string_agg(t.name, '/' ORDER BY distance DESC) AS path FROM c JOIN t ON c.ancestor = t.id GROUP BY c.id) SELECT id, path FROM q WHERE path GLOB '*A*/*I*/*7?'")
def _path_search(spark, sf_dir):
    return V.paths(_tree(spark, sf_dir), "name", "/").where(F.col("path").rlike(S.glob_regex("*A*/*I*/*7?")))


@register("path_lookup", f"""WITH RECURSIVE {_TREE_SQL}, q AS (SELECT c.id, string_agg(t.name, '/' ORDER BY distance DESC) AS path FROM c JOIN t ON c.ancestor = t.id GROUP BY c.id)
SELECT w.path, min(q.id) AS first_id, count(*) AS n FROM (SELECT DISTINCT r_name || '/' || n_name || '/' || c_name AS path FROM region CROSS JOIN nation JOIN customer ON c_nationkey = n_nationkey) w JOIN q USING (path) GROUP BY w.path""")
def _path_lookup(spark, sf_dir):
    r, n, c = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("region", "nation", "customer"))
    wanted = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r.select("r_name"), how="cross").select(F.concat_ws("/", "r_name", "n_name", "c_name").alias("path"))
    return V.find_paths(_tree(spark, sf_dir), wanted, "name", "/").groupBy("path").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))


@register("relative_paths", f"""WITH RECURSIVE {_TREE_SQL} SELECT t.parent AS base, t.id, './' || t.name AS path FROM t WHERE t.parent IS NOT NULL
UNION ALL SELECT y.parent, t.id, './' || y.name || '/' || t.name FROM t JOIN t y ON t.parent = y.id WHERE y.parent IS NOT NULL UNION ALL SELECT id, id, './' FROM t""")
def _relative(spark, sf_dir):
    t = _tree(spark, sf_dir)
    up = t.select(F.col("id").alias("parent"), F.col("parent").alias("far"))
    pairs = t.join(up, "parent", "left").select(F.explode(F.array("id", "parent", "far", F.lit("r:none"))).alias("base"), "id").where("base is not null")
    return V.relative_paths(t, pairs, "name", "/")


_CHANGED_SQL = f"""{_TREE_SQL}, g AS (SELECT 'c:' || c_custkey AS id, c_custkey AS k, c_nationkey AS n FROM customer),
a AS (SELECT id, CASE WHEN id LIKE 'n:%' AND CAST(substr(id, 3) AS INTEGER) % 5 = 0 THEN 'r:' || (CAST(substr(id, 3) AS INTEGER) + 1) % 5 WHEN id LIKE 'c:%' AND CAST(substr(id, 3) AS INTEGER) % 10 = 0 THEN 'n:' || (CAST(substr(id, 3) AS INTEGER) // 10) % 25 ELSE parent END AS parent
  FROM t WHERE NOT (id LIKE 'c:%' AND CAST(substr(id, 3) AS INTEGER) % 11 = 0)
  UNION ALL SELECT 'x:' || k, id FROM g WHERE k % 7 = 0 AND k % 11 <> 0 UNION ALL SELECT 'y:' || k, 'x:' || k FROM g WHERE k % 14 = 0 AND k % 11 <> 0),
d AS (SELECT id AS ancestor, id, 0 AS distance FROM a UNION ALL SELECT a.parent, d.id, d.distance + 1 FROM d JOIN a ON d.ancestor = a.id WHERE a.parent IS NOT NULL)"""


@register("closure_changes", f"WITH RECURSIVE {_CHANGED_SQL} SELECT ancestor, id, distance FROM d")
def _changes(spark, sf_dir):
    """Nations and customers moved, customers removed, nodes added in two levels; the closure follows the changes."""
    t = _tree(spark, sf_dir)
    k = F.substring("id", 3, 20).cast("int")
    row = lambda seq, id_, action, parent: F.struct(F.lit(seq).alias("seq"), id_.alias("id"), F.lit(action).alias("action"), parent.alias("parent"))
    none, of = F.lit(None).cast("string"), lambda p, n: F.concat(F.lit(p), n.cast("string"))
    nation, customer = F.col("id").like("n:%"), F.col("id").like("c:%")
    each = F.array(
        F.when(nation & (k % 5 == 0), row(1, F.col("id"), "move", of("r:", (k + 1) % 5))), F.when(customer & (k % 10 == 0), row(1, F.col("id"), "move", of("n:", F.floor(k / 10) % 25))),
        F.when(customer & (k % 7 == 0), row(2, of("x:", k), "add", F.col("id"))), F.when(customer & (k % 14 == 0), row(2, of("y:", k), "add", of("x:", k))), F.when(customer & (k % 11 == 0), row(3, F.col("id"), "remove", none)))
    changes = t.select(F.explode(each).alias("e")).where("e is not null").select("e.*")
    return C.changed_closure(t, H.closure(t), changes)[1]
