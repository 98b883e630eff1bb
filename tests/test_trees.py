"""Trees as intervals and closures under changes, against plain Python, deep trees and cycles."""

import random

import pytest

from tidemark.operators import hierarchy as H
from tidemark.operators import intervals as V
from tidemark.operators import tree_changes as C


def tree_of(spark, parents):
    return spark.createDataFrame([(i, p, f"n{i}", float(i)) for i, p in parents.items()], "id long, parent long, name string, value double")


def walk(parents):
    """(pre, last, depth) of each node by a plain depth-first walk."""
    kids = {}
    for i, p in sorted(parents.items()):
        kids.setdefault(p if p in parents else None, []).append(i)
    out, todo, n = {}, [(i, 0) for i in reversed(kids.get(None, []))], 0
    order = []
    while todo:
        i, d = todo.pop()
        n += 1
        out[i] = [n, n, d]
        order.append(i)
        todo += [(k, d + 1) for k in reversed(kids.get(i, []))]
    for i in reversed(order):
        if parents[i] in out:
            out[parents[i]][1] = max(out[parents[i]][1], out[i][1])
    return {i: tuple(v) for i, v in out.items()}


def random_tree(n, seed, flat=False, reach=9):
    rng = random.Random(seed)
    ids = list(range(1, n + 1))
    rng.shuffle(ids)
    return {i: None if k < 3 else ids[0] if flat and k % 3 else ids[rng.randrange(max(0, k - reach), k)] for k, i in enumerate(ids)}


@pytest.mark.parametrize("parents", [random_tree(150, 1), random_tree(150, 2, flat=True), {5: 99, 6: 5}, {1: None}], ids=["deep", "flat", "orphan", "one"])
def test_labels_are_a_depth_first_walk(spark, parents):
    got = {r["id"]: (r["pre"], r["last"], r["depth"]) for r in V.labels(tree_of(spark, parents)).collect()}
    assert got == walk(parents)


def test_a_thousand_levels(spark):
    parents = {i: i - 1 if i > 1 else None for i in range(1, 1001)}
    t = tree_of(spark, parents)
    lab = V.labels(t)
    assert {(r["id"], r["pre"], r["last"], r["depth"]) for r in lab.collect()} == {(i, i, 1000, i - 1) for i in parents}
    sums = {r["id"]: (r["n"], r["total"]) for r in V.subtree_sums(lab, t).collect()}
    assert sums == {i: (1001 - i, float(sum(range(i, 1001)))) for i in parents}
    assert {r["id"] for r in V.below(lab, 990).collect()} == set(range(990, 1001)) and V.below(lab, 5000).count() == 0
    marks = spark.createDataFrame([(3,), (700,)], "id long")
    near = {r["id"]: r["mark"] for r in V.nearest_above(t, marks).collect()}
    assert near == {i: None if i < 3 else 3 if i < 700 else 700 for i in parents}


def test_paths_and_names(spark):
    t = tree_of(spark, {1: None, 2: 1, 3: 2, 4: 1, 7: None})
    paths = {r["id"]: r["path"] for r in V.paths(t).collect()}
    assert paths == {1: "n1", 2: "n1\\n2", 3: "n1\\n2\\n3", 4: "n1\\n4", 7: "n7"}
    wanted = spark.createDataFrame([("\\\\n1\\n2\\n3",), ("n1",), ("n1\\n9",), ("n2",), ("",)], "path string")
    assert {(r["path"], r["id"]) for r in V.find_paths(t, wanted).collect()} == {("\\\\n1\\n2\\n3", 3), ("n1", 1)}
    pairs = spark.createDataFrame([(1, 3), (2, 3), (3, 3), (4, 3), (7, 3)], "base long, id long")
    assert {(r["base"], r["path"]) for r in V.relative_paths(t, pairs).collect()} == {(1, ".\\n2\\n3"), (2, ".\\n3"), (3, ".\\")}
    by_name = {r["id"]: r["pre"] for r in V.labels(t.withColumn("name", -t["value"]), "name").collect()}
    assert by_name == {7: 1, 1: 2, 4: 3, 2: 4, 3: 5}


def test_cycles_are_errors(spark):
    for parents in ({1: 2, 2: 1}, {1: 1}, {1: None, 2: 3, 3: 4, 4: 2}):
        with pytest.raises(ValueError):
            V.labels(tree_of(spark, parents)).collect()
        with pytest.raises(ValueError):
            V.paths(tree_of(spark, parents)).collect()


def test_sums_of_nulls_and_nothing(spark):
    t = tree_of(spark, {1: None, 2: 1})
    values = spark.createDataFrame([(2, None), (2, 0.1), (2, 0.2), (9, 5.0)], "id long, value double")
    got = {r["id"]: (r["n"], r["total"], r["average"]) for r in V.subtree_sums(V.labels(t), values).collect()}
    assert got[1] == got[2] == (2, pytest.approx(0.3), pytest.approx(0.15))
    none = {r["id"]: r["total"] for r in V.subtree_sums(V.labels(t), values.limit(0)).collect()}
    assert none == {1: None, 2: None}


# Changes


def rows(closed):
    return sorted((r["ancestor"], r["id"], r["distance"]) for r in closed.collect())


def applied(parents, changes):
    """The tree after the changes, in plain Python."""
    after, last = dict(parents), {}
    for seq, i, action, p in sorted(changes):
        last[i] = (action, p)
    for i, (action, p) in last.items():
        after.pop(i, None)
        if action != "remove":
            after[i] = p
    gone = {i for i, (a, _) in last.items() if a == "remove"}
    while gone:
        gone = {i for i, p in after.items() if p in gone}
        for i in gone:
            del after[i]
    return after


CHANGES = {
    "add a leaf and a root": [(1, 500, "add", 3), (2, 501, "add", None), (3, 502, "add", 500)],
    "move a subtree": [(1, 10, "move", 1), (2, 11, "move", None)],
    "move under what moves": [(1, 20, "move", 1), (2, 21, "move", 20)],
    "remove with what is below": [(1, 5, "remove", None), (2, 40, "remove", None)],
    "the last change counts": [(1, 7, "remove", None), (2, 7, "move", 1), (3, 8, "move", 2), (4, 8, "remove", None)],
    "out of a removed subtree": [(1, 1, "remove", None), (2, 30, "move", 2)],
}


@pytest.mark.parametrize("name", CHANGES)
def test_changed_closure_is_the_closure_anew(spark, name):
    parents = random_tree(30, 4, reach=20)
    if name == "out of a removed subtree":
        parents = {1: None, 2: None, 3: 1, 30: 3, 31: 30, 4: 2}
    t = tree_of(spark, parents)
    changes = spark.createDataFrame(CHANGES[name], "seq long, id long, action string, parent long")
    want = applied(parents, CHANGES[name])
    try:
        expected = rows(H.closure(tree_of(spark, want)))
    except ValueError:
        with pytest.raises(ValueError):
            C.changed_closure(t, H.closure(t), changes)
        return
    after, closed = C.changed_closure(t, H.closure(t), changes)
    assert {r["id"]: r["parent"] for r in after.collect()} == want and rows(closed) == expected


def test_untouched_rows_stay(spark):
    t = tree_of(spark, random_tree(40, 9, reach=30))
    none = spark.createDataFrame([], "seq long, id long, action string, parent long")
    closed = H.closure(t)
    assert rows(C.changed_closure(t, closed, none)[1]) == rows(closed)
    with pytest.raises(ValueError):  # under one of its own descendants
        chain = tree_of(spark, {1: None, 2: 1, 3: 2})
        C.changed_closure(chain, H.closure(chain), spark.createDataFrame([(1, 2, "move", 3)], "seq long, id long, action string, parent long"))
