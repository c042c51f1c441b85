"""Orphans and duplicates of many keys in one pass, against the single-key jobs."""

from functools import reduce

from pyspark.sql import DataFrame

from tessera.operators import quality as Q


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_orphans_of_all_equal_those_of_each_key(spark):
    parent = spark.createDataFrame([(k,) for k in range(0, 40, 2)], "id int")
    other = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "code string")
    child = spark.createDataFrame([(k, k % 50 if k % 7 else None, "abc"[k % 3], 0) for k in range(300)] + [(900, 41, None, 41)] * 2,
                                  "id int, p int, c string, hot int")
    small = spark.createDataFrame([("x", 3), ("y", None)], "name string, p int")
    got = Q.orphans_of_all([(child, "id", [("child.p", "p", "parent"), ("child.c", "c", "other"), ("child.hot", "hot", "parent")]),
                            (small, "name", [("small.p", "p", "parent")])], {"parent": (parent, "id"), "other": (other, "code")})
    each = [Q.orphans(child, parent, "p", "id", "child.p"), Q.orphans(child, other, "c", "code", "child.c"),
            Q.orphans(child, parent, "hot", "id", "child.hot"), Q.orphans(small, parent, "p", "id", "small.p", "name")]
    assert _rows(got) == _rows(reduce(DataFrame.unionByName, each)) and got.where("fk_name = 'child.hot'").count() == 2
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_duplicates_of_all_equal_those_of_each_key(spark):
    a = spark.createDataFrame([(k % 9, f"n{k % 4}", None if k % 2 else "z") for k in range(20)], "x int, y string, z string")
    b = spark.createDataFrame([(1,), (2,)], "x int")
    got = Q.duplicates_of_all([(a, [("a.x", ["x"]), ("a.x+y", ["x", "y"]), ("a.z", ["z"]), ("a.y+z", ["y", "z"])]), (b, [("b.x", ["x"])])])
    each = [Q.duplicates(a, ["x"], "a.x"), Q.duplicates(a, ["x", "y"], "a.x+y"), Q.duplicates(a, ["z"], "a.z"),
            Q.duplicates(a, ["y", "z"], "a.y+z"), Q.duplicates(b, ["x"], "b.x")]
    assert _rows(got) == _rows(reduce(DataFrame.unionByName, each))
