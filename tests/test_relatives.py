import random
from collections import Counter

from stemma.operators import entities as E


def settle(people, family, groups):
    """The same by whole rounds over all pairs."""
    ext, cand = {i: x for i, x, _ in people if x}, {i: set(c) for i, x, c in people if not x and c}
    near = lambda a, b: a != b and bool(groups.get(a, set()) & groups.get(b, set()))
    while True:
        winners = {}
        for i, cs in cand.items():
            n = Counter({a: sum(near(a, ext[r]) for r in family.get(i, ()) if r in ext) for a in cs})
            if most := max(n.values()):
                winners[i] = {a for a in cs if n[a] == most}
        if not any(len(w) == 1 for w in winners.values()):
            return ext
        for i, w in winners.items():
            if len(w) == 1:
                ext[i] = w.pop()
                del cand[i]
            else:
                cand[i] = w


def frames(spark, people, family, groups):
    p = spark.createDataFrame([(i, i, x, "name-unique" if x else None, c) for i, x, c in people], "id string, name string, external_id string, stage string, candidates array<string>")
    f = spark.createDataFrame([(i, r) for i, rs in family.items() for r in rs], "id string, relative string")
    return p, f, spark.createDataFrame([(a, g) for a, gs in groups.items() for g in gs], "a string, group string")


def test_all_of_a_group_are_neighbours(spark):
    rng = random.Random(8)
    groups = {f"e{i:02}": {f"g{rng.randrange(12)}" for _ in range(rng.randint(1, 3))} for i in range(60)}
    people = [(f"p{i:02}", f"e{i:02}", None) if i < 15 else (f"p{i:02}", None, sorted(rng.sample(sorted(groups), 3))) for i in range(50)]
    family = {f"p{i:02}": {f"p{rng.randrange(50):02}" for _ in range(3)} - {f"p{i:02}"} for i in range(50)}
    p, f, g = frames(spark, people, family, groups)
    got = {r["id"]: r["external_id"] for r in E.resolve_by_relatives(p, f, groups=g).collect() if r["external_id"]}
    assert got == settle(people, family, groups)
    assert len(got) > 25
