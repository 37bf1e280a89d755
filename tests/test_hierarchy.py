import random

from stemma.operators import hierarchy as H


def brute(parents, nodes):
    out = {}
    for n in nodes:
        path, seen, at = [n], {n}, n
        while (p := parents.get(at)) is not None and p not in seen:
            path.append(p)
            seen.add(p)
            at = p
        if p is None:
            out[n] = (path[-1], len(path) - 1, path[::-1])
        else:  # p closes a cycle; n lies on it if p is n
            out[n] = ("", -1 if p == n else -2, None)
    return out


def frame(spark, parents):
    return spark.createDataFrame(list(parents.items()), "node string, parent string")


def test_against_brute_force(spark):
    rng = random.Random(3)
    parents = {f"n{i}": f"n{rng.choice([max(0, i - 1), rng.randrange(i)])}" for i in range(1, 160)}
    parents |= {"c1": "c2", "c2": "c3", "c3": "c1", "d1": "c1", "d2": "d1", "s": "s", "t": "s"}
    parents |= {f"hot{i}": "n7" for i in range(60)}
    nodes = {*parents, *parents.values()}
    want = brute(parents, nodes)
    rows = {r["node"]: r for r in H.hierarchy(frame(spark, parents)).collect()}
    assert set(rows) == nodes
    for n, (root, depth, path) in want.items():
        r = rows[n]
        assert (r["root"], r["depth"], r["path"]) == (root, depth, path), n
        if depth >= 0:
            assert r["size"] == sum(1 for p in want.values() if p[2] and n in p[2])
    assert rows["d1"]["size"] == 2 and rows["c1"]["size"] is None


def test_descendants(spark):
    tree = H.peel(frame(spark, {"b": "a", "c": "b", "x": "x"}))
    assert sorted(map(tuple, H.descendants(tree).collect())) == [("a", "b", 1), ("a", "c", 2), ("b", "c", 1)]


def test_descendants_on_and_below_cycles(spark):
    parents = {"b": "a", "c1": "c2", "c2": "c3", "c3": "c1", "d1": "c1", "e1": "d1", "f1": "e1", "f2": "d1", "g": "c3", "s": "s", "t": "s", "u": "t"}
    parents |= {f"r{i}": f"r{(i + 1) % 11}" for i in range(11)} | {"h": "r4", "i": "h"}
    want = set()
    for n in {*parents, *parents.values()}:
        at, seen, k = n, {n}, 0
        while (at := parents.get(at)) is not None and at not in seen:
            seen.add(at)
            want.add((at, n, k := k + 1))
    got = [tuple(r) for r in H.all_descendants(H.peel(frame(spark, parents))).collect()]
    assert len(got) == len(want)
    assert set(got) == want
    assert ("d1", "f1", 2) in want
    assert ("c2", "f1", 4) in want
    assert H.all_descendants(H.peel(frame(spark, {"s": "s"}))).count() == 0


def test_nulls_ties_and_empty(spark):
    df = spark.createDataFrame([("b", "a"), ("b", "a"), ("b", "z"), (None, "q"), ("q", None)], "node string, parent string")
    rows = {r["node"]: (r["root"], r["depth"]) for r in H.hierarchy(df, paths=False).collect()}
    assert rows == {"a": ("a", 0), "z": ("z", 0), "b": ("a", 1)}
    assert H.hierarchy(df.filter("false")).count() == 0
    extra = spark.createDataFrame([("lone",), (None,)], "node string")
    assert [tuple(r)[3:5] for r in H.hierarchy(df.filter("false"), nodes=extra).collect()] == [("lone", 0)]


def test_deep_chain(spark):
    """A chain of 100,000 with a side branch at every 1,000th node: rounds of joins, not one per generation."""
    n = 100_000
    main = spark.range(1, n).selectExpr("concat('v', id) node", "concat('v', id - 1) parent")
    side = spark.range(0, n, 1_000).selectExpr("concat('w', id) node", "concat('v', id) parent")
    tree = H.hierarchy(main.unionByName(side), paths=False)
    assert tuple(tree.filter("node = 'v99999'").first())[2:5] == (1, "v0", n - 1)
    assert tuple(tree.filter("node = 'w5000'").first())[2:5] == (1, "v0", 5_001)
    assert tree.filter("node = 'v0'").first()["size"] == n + n // 1_000
    assert tree.filter("status = 'rooted'").count() == n + n // 1_000


def test_no_python_in_the_plan(spark):
    tree = H.hierarchy(frame(spark, {"b": "a", "c": "b"}))
    assert "Python" not in tree._jdf.queryExecution().toString() and "Pandas" not in tree._jdf.queryExecution().toString()
