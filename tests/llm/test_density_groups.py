import numpy as np

from promptbook.llm import components as comp
from promptbook.llm.components import components, contract
from promptbook.llm.density_groups import describe_groups, touching_groups

SCHEMA = "character_id string, x double, y double, id int, cx string, label int"


def frame(spark, points):
    return spark.createDataFrame([(i, None if x is None else float(x), None if y is None else float(y), 1, "clash", 2) for i, x, y in points], SCHEMA)


def brute(points, least, radius=0.5):
    ids = [p[0] for p in points]
    x = np.array([[p[1], p[2]] for p in points], float)
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(((x[i + 1 :] - x[i]) ** 2).sum(1) <= radius * radius):
            root[find(i)] = find(i + 1 + j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return {(min(g), m) for g in groups.values() if len(g) >= least for m in g}


def found(df, **kw):
    return {(r.group_key, r.member) for r in touching_groups(df, "character_id", "x", "y", **kw).collect()}


def test_equals_brute_force_on_scattered_and_dense_points(spark):
    rng = np.random.default_rng(3)
    spread = [(f"s{i:04d}", *p) for i, p in enumerate(rng.uniform(0, 9, size=(400, 2)))]
    dense = [(f"d{i:04d}", *p) for i, p in enumerate(rng.normal(20, 0.2, size=(500, 2)))]
    # two dense blocks, just within and just beyond the radius of each other: pairs of cells too large to compare directly
    left = [(f"l{i:04d}", *p) for i, p in enumerate(rng.uniform([40, 0], [40.3, 0.3], size=(120, 2)))]
    near = [(f"n{i:04d}", *p) for i, p in enumerate(rng.uniform([40.75, 0], [41.0, 0.3], size=(120, 2)))]
    far = [(f"f{i:04d}", *p) for i, p in enumerate(rng.uniform([41.52, 0], [41.8, 0.3], size=(120, 2)))]
    points = spread + dense + left + near + far
    assert found(frame(spark, points), min_size=20) == brute(points, 20)


def test_radius_itself_touches_and_beyond_does_not(spark):
    points = [("a", 0, 0), ("b", 0.5, 0), ("c", 1.0001, 0), ("d", -7, -7)]
    assert found(frame(spark, points), min_size=1) == {("a", "a"), ("a", "b"), ("c", "c"), ("d", "d")}


def test_invalid_repeated_and_equal_points(spark):
    nan, inf = float("nan"), float("inf")
    points = [("a", 0, 0), ("a", 0, 0), ("b", 0, 0), ("n", None, 0), ("m", 0, nan), ("i", inf, 0), (None, 0, 0)]
    assert found(frame(spark, points), min_size=2) == {("a", "a"), ("a", "b")}
    assert found(frame(spark, points[:0]), min_size=1) == set()


def test_long_chain_settles(spark):
    rng = np.random.default_rng(1)
    order = rng.permutation(300)
    points = [(f"c{order[i]:03d}", 0.4 * i, 0) for i in range(300)]
    assert found(frame(spark, points), min_size=300) == brute(points, 300)


def test_description_lists_members_of_dense_cells(spark):
    points = [(f"p{i:02d}", 0.01 * i, 0) for i in range(25)]
    row = describe_groups(touching_groups(frame(spark, points), "character_id", "x", "y"), 3).first()
    assert row.group_key == "p00" and row.n_members == 25 and len(row.typical.split(" | ")) == 3


def test_components_ignore_nulls_and_loops(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("z", "z"), (None, "a"), ("y", "x")], "a string, b string")
    assert {(r.node, r.label) for r in components(edges).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("z", "z"), ("x", "x"), ("y", "x")}


def test_contracted_links_have_the_same_components(spark, monkeypatch):
    rng = np.random.default_rng(6)
    chain = [(i, i + 1, i // 40) for i in range(400)] + [(1000 + int(a), 1000 + int(b), int(t)) for a, b, t in rng.integers(0, 60, (50, 3))]
    edges = spark.createDataFrame(chain, "a long, b long, near long")
    want = {(r.node, r.label) for r in components(edges).collect()}
    for most in (500_000, 7):
        monkeypatch.setattr(comp, "LOCAL_EDGES", most)
        assert {(r.node, r.label) for r in components(contract(edges, "near")).collect()} == want
    assert components(contract(edges.where("false"), "near")).count() == 0
