import random

import pytest

from arealis.operators import Leaf, compound, compound_join

A = [("x", 1, "a1", None, 5), ("x", 2, "a2", 7, 6), ("y", 1, "a3", None, None), (None, 1, "a4", 1, 1), ("w", 1, "a5", 2, 2)]
B = [("x", 1, "b1", 70, 1), ("y", 1, "b2", 8, 2), ("y", 2, "b3", 9, 3), (None, 2, "b4", 4, 4), ("z", 1, "b5", 6, 5)]


def leaf(spark, rows, own, shared="s"):
    return Leaf(spark.createDataFrame(rows, f"k string, o_{own} int, {own} string, {shared} int, t_{own} int"), [f"o_{own}"])


def brute(left, right, how):
    """Last row per key; join; the first operand's non-null value wins."""

    def last(rows):
        return {r[0]: r for r in sorted((r for r in rows if r[0] is not None), key=lambda r: r[1])}

    l, r = last(left), last(right)
    keys = {"inner": l.keys() & r.keys(), "left": l.keys(), "right": r.keys(), "full": l.keys() | r.keys()}[how]
    none = (None,) * 5
    out = []
    for k in keys:
        a, b = l.get(k, none), r.get(k, none)
        out.append((k, a[1], a[2], a[3] if a[3] is not None else b[3], a[4], b[1], b[2], b[4]))
    if how in ("left", "full"):
        out += [(None, *row[1:5], None, None, None) for row in left if row[0] is None]
    if how in ("right", "full"):
        out += [(None, None, None, row[3], None, row[1], row[2], row[4]) for row in right if row[0] is None]
    return sorted(out, key=repr)


COLUMNS = ["k", "o_a", "a", "s", "t_a", "o_b", "b", "t_b"]


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_join_types(spark, how):
    got = compound((leaf(spark, A, "a"), how, leaf(spark, B, "b")), "k")
    assert got.columns == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(A, B, how)


def test_outer_is_full(spark):
    got = compound((leaf(spark, A, "a"), "OUTER", leaf(spark, B, "b")), "k")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(A, B, "full")


def test_unknown_join_type(spark):
    with pytest.raises(ValueError):
        compound((leaf(spark, A, "a"), "cross", leaf(spark, B, "b")), "k")


def test_order_is_required(spark):
    df = spark.createDataFrame(A, "k string, o int, a string, s int, t int")
    with pytest.raises(ValueError):
        compound(df, "k")
    with pytest.raises(ValueError):
        compound(Leaf(df), "k")


def test_single_operand_keeps_keyless_rows(spark):
    got = compound(leaf(spark, A, "a"), "k").collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted([A[1], A[2], A[3], A[4]], key=repr)


@pytest.mark.parametrize("shape", ["first", "second"])
def test_nested_trees(spark, shape):
    a, b = leaf(spark, A, "a"), leaf(spark, B, "b")
    c = Leaf(spark.createDataFrame([("x", 100, "c1"), ("y", 200, "c2")], "k string, s int, c string"), unique=True)
    tree = ((a, "inner", b), "inner", c) if shape == "first" else (a, "inner", (b, "inner", c))
    got = {r["k"]: r for r in compound(tree, "k").collect()}
    assert set(got) == {"x", "y"}
    assert (got["x"]["a"], got["x"]["b"], got["x"]["c"], got["x"]["s"]) == ("a2", "b1", "c1", 7)
    # null on the first operand is filled by the second, then the third
    assert got["y"]["s"] == 9


def merged(a, b, how):
    """Brute force of one join of {key: row dict} and lists of keyless rows, null values as missing ones."""
    (left, left_solo), (right, right_solo) = a, b
    keys = {"inner": left.keys() & right.keys(), "left": left.keys(), "right": right.keys(), "full": left.keys() | right.keys()}[how]
    rows = {}
    for k in keys:
        rows[k] = {c: v for c, v in right.get(k, {}).items() if v is not None}
        rows[k] |= {c: v for c, v in left.get(k, {}).items() if v is not None}
    return rows, (left_solo if how in ("left", "full") else []) + (right_solo if how in ("right", "full") else [])


@pytest.mark.parametrize("seed", range(6))
def test_any_tree_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    leaves = []
    for i in range(4):
        rows = [
            (rng.choice([None, None, *"uvwxyz"]), j, rng.choice([None, j]), rng.choice([None, i])) for j in range(rng.randrange(0, 12))
        ]
        rows += [r for r in rows if r[0] is None]  # equal keyless rows
        df = spark.createDataFrame(rows, f"k string, o{i} int, v{i} int, shared int")
        last = {r[0]: {f"o{i}": r[1], f"v{i}": r[2], "shared": r[3]} for r in sorted(rows, key=lambda r: r[1]) if r[0]}
        solo = [{f"o{i}": r[1], f"v{i}": r[2], "shared": r[3]} for r in rows if r[0] is None]
        leaves.append((Leaf(df, [f"o{i}"]), (last, [{c: v for c, v in s.items() if v is not None} for s in solo])))

    def build(items):
        if len(items) == 1:
            return items[0]
        at, how = rng.randrange(1, len(items)), rng.choice(["inner", "left", "right", "full"])
        (a, x), (b, y) = build(items[:at]), build(items[at:])
        return (a, how, b), merged(x, y, how)

    tree, (rows, solo) = build([*leaves, leaves[0]] if seed % 2 else leaves)
    got = [{c: v for c, v in r.asDict().items() if v is not None} for r in compound(tree, "k").collect()]
    want = [{"k": k} | row for k, row in rows.items()] + solo
    assert sorted(map(repr, (sorted(r.items()) for r in got))) == sorted(map(repr, (sorted(r.items()) for r in want)))


def test_columns_of_any_name(spark):
    a = Leaf(spark.createDataFrame([("x", 1, 2, 3)], "k string, key int, leaf0 int, `a.b` int"), unique=True)
    b = Leaf(spark.createDataFrame([("x", 4), (None, 5)], "k string, copies int"), ["copies"])
    got = compound((a, "full", b), "k")
    assert got.columns == ["k", "key", "leaf0", "a.b", "copies"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, [("x", 1, 2, 3, 4), (None, None, None, None, 5)]))
    only = spark.createDataFrame([("x",), ("x",), ("y",)], "k string")
    assert sorted(r["k"] for r in compound(Leaf(only, ["k"]), "k").collect()) == ["x", "y"]


def test_three_levels(spark):
    leaves = [
        Leaf(spark.createDataFrame([(k, i) for k in "xyz"[: 3 - i % 2]], f"k string, v{i} int"), unique=True) for i in range(4)
    ]
    tree = (((leaves[0], "inner", leaves[1]), "left", leaves[2]), "full", leaves[3])
    got = {r["k"]: (r["v0"], r["v1"], r["v2"], r["v3"]) for r in compound(tree, "k").collect()}
    assert got == {"x": (0, 1, 2, 3), "y": (0, 1, 2, 3)}


def test_repeated_key_many_times(spark):
    """A key with most of the rows collapses to its last row."""
    rows = [("x", i, "a", i, i) for i in range(500)] + [("y", 1, "a", 1, 1)]
    got = compound((leaf(spark, rows, "a"), "inner", leaf(spark, B, "b")), "k").collect()
    assert {(r["k"], r["o_a"]) for r in got} == {("x", 499), ("y", 1)}


def test_quoted_keys(spark):
    a = Leaf(spark.createDataFrame([('"x"', 1)], "k string, p int"), unique=True)
    b = Leaf(spark.createDataFrame([("x", 2)], "k string, q int"), unique=True)
    assert compound((a, "inner", b), "k").count() == 0
    assert [tuple(r) for r in compound((a, "inner", b), "k", normalize=True).collect()] == [("x", 1, 2)]


def test_compound_join(spark):
    a = spark.createDataFrame([(1, "p"), (2, "q")], "k int, u string")
    b = spark.createDataFrame([(1, 1, "r"), (1, 2, "s")], "k int, o int, w string")
    got = [tuple(r) for r in compound_join(a, b, "k", right_order_by=["o"]).collect()]
    assert got == [(1, "p", 2, "s")]
    assert compound_join(a, b, "k", how="left", right_order_by=["o"]).count() == 2
