import inspect
import random

import pytest

from stemma.operators import genealogy as N


def walk(parents, node, maternal):
    path = [node]
    while True:
        father, mother = parents.get(path[-1], (None, None))
        up = (mother or father) if maternal else (father or mother)
        if up is None or up in path:
            return path[::-1]
        path.append(up)


@pytest.mark.parametrize("maternal", [False, True])
def test_lines_of_everyone(spark, maternal):
    """Fathers only, mothers only, both, cycles, nobody; and a line of more than 1,000 steps."""
    rng = random.Random(5)
    pick = lambda i: f"n{rng.randrange(i)}" if rng.random() < 0.6 else None
    parents = {f"n{i}": (pick(i), pick(i)) for i in range(1, 200)}
    parents |= {"a": ("b", None), "b": (None, "c"), "c": ("a", "n3"), "e": ("a", None), "f": ("e", "n9"), "s": ("s", None), "t": ("s", None)}
    parents |= {f"v{i}": (f"v{i - 1}", None) for i in range(1, 1_205)}
    rows = [(k, *p) for k, p in parents.items()]
    df = spark.createDataFrame(rows, "child string, father string, mother string")
    starts = spark.createDataFrame([(k,) for k in [*parents, "nobody", "a"]], "node string")
    got = {r["node"]: r["path"] for r in N.ancestry(df, starts, maternal).collect()}
    assert got == {k: walk(parents, k, maternal) for k in [*parents, "nobody"]}
    assert len(got["v1204"]) == 1_205


def test_below_has_no_bound(spark):
    assert "generations" not in inspect.signature(N.below).parameters
    links = spark.createDataFrame([(f"v{i}", f"v{i + 1}", "father-of") for i in range(30)] + [("v30", "v0", "mother-of")], "person_from string, person_to string, type string")
    got = N.below(links, spark.createDataFrame([("v0",)], "node string"), stride=4)
    assert sorted((r["node"], r["depth"]) for r in got.collect()) == sorted((f"v{i}", i) for i in range(31))
