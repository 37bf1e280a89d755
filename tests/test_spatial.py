import math
import random

from stemma.operators import spatial as S


def km(a, b):
    la, lb = math.radians(a[0]), math.radians(b[0])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def points():
    rng = random.Random(5)
    out = {}
    for lat, lng in ((89.99, 10), (-89.98, -170), (0.01, 179.99), (0.01, -179.99), (45, 45), (10, 0.0)):
        for i in range(40):
            x = lng + rng.uniform(-0.08, 0.08) / max(0.001, math.cos(math.radians(lat)))
            out[f"{lat}/{lng}/{i:02}"] = (min(90.0, max(-90.0, lat + rng.uniform(-0.08, 0.08))), (x + 180) % 360 - 180)
    return out


def test_near_against_brute_force(spark):
    pts = points()
    df = spark.createDataFrame([(k, float(v[0]), float(v[1])) for k, v in pts.items()], "id string, lat double, lng double")
    want = {(a, b) for a in pts for b in pts if a < b and km(pts[a], pts[b]) <= 5}
    assert len(want) > 100
    for hot in (5, 2_000):  # with and without salted cells
        got = [(r["id_a"], r["id_b"]) for r in S.near(df, "id", 5.0, hot=hot).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_no_location(spark):
    bad = [("a", None, 1.0), ("b", 0.0, 0.0), ("c", 91.0, 0.0), ("d", 1.0, 181.0), ("e", float("nan"), 1.0), (None, 1.0, 1.0), ("f", 1.0, 1.0), ("f", 1.0, 1.0), ("g", 1.0, 1.0)]
    df = spark.createDataFrame(bad, "id string, lat double, lng double")
    assert [(r["id_a"], r["id_b"], r["km"]) for r in S.near(df, "id", 5.0).collect()] == [("f", "g", 0.0)]
    assert S.near(df.filter("false"), "id", 5.0).count() == 0


def test_within_against_brute_force(spark):
    rng = random.Random(2)
    rings = {("a", 1): [(0, 0), (20, 5), (25, 30), (3, 22)], ("a", 2): [(60, 60), (70, 60), (65, 75), (65, 66)], ("b", 1): [(10, 10), (15, 12), (11, 18)], ("c", 1): [(-179, -80), (179, -80), (0, -60)], ("line", 1): [(1, 1), (2, 2)]}
    regions = spark.createDataFrame([(k, n, [{"lng": float(x), "lat": float(y)} for x, y in r]) for (k, n), r in rings.items()] + [("null", 1, None)], "t string, n int, ring array<struct<lng:double,lat:double>>")
    pts = {f"p{i}": (rng.uniform(-5, 80), rng.uniform(-5, 80)) for i in range(800)} | {"south": (-70.0, 1.0)}
    df = spark.createDataFrame([(k, float(v[0]), float(v[1])) for k, v in pts.items()], "id string, lat double, lng double")

    def inside(lat, lng, r):
        odd = False
        for (x1, y1), (x2, y2) in zip(r, r[1:] + r[:1]):
            if (y1 > lat) != (y2 > lat) and lng < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
                odd = not odd
        return odd

    want = {(p, k) for p, (lat, lng) in pts.items() for (k, _), r in rings.items() if inside(lat, lng, r)}
    for border_cells in (1, 30, 400):
        got = [(r["id"], r["region"]) for r in S.within(df, "id", regions, "t", "ring", border_cells=border_cells).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert S.within(df, "id", regions.filter("false"), "t", "ring").count() == 0


def test_coverage_fits_the_region(spark):
    """A region of a few hundred metres has interior cells, as has one of 20,000 vertices; a border cell carries the edges that touch it only."""
    n = 20_000
    big = [{"lng": 10 + 5 * (1 + 0.1 * math.sin(50 * 2 * math.pi * i / n)) * math.cos(2 * math.pi * i / n), "lat": 20 + 5 * math.sin(2 * math.pi * i / n)} for i in range(n)]
    small = [{"lng": x, "lat": y} for x, y in ((1.0, 1.0), (1.004, 1.001), (1.003, 1.005))]
    regions = spark.createDataFrame([("big", big), ("small", small)], "t string, ring array<struct<lng:double,lat:double>>")
    rows = S.coverage(regions, "t", "ring").collect()
    for t, edges in (("big", n), ("small", 3)):
        mine = [r for r in rows if r["region"] == t]
        border = [r for r in mine if not r["inner"]]
        assert 30 < len(border) <= 260 and any(r["inner"] for r in mine)
        assert sum(len(r["edges"]) for r in border) < 2 * edges + 2 * len(border)
    df = spark.createDataFrame([("in", 1.002, 1.0025), ("out", 1.004, 1.0001), ("mid", 20.0, 10.0), ("far", 0.0, 100.0)], "id string, lat double, lng double")
    assert sorted((r["id"], r["region"]) for r in S.within(df, "id", regions, "t", "ring").collect()) == [("in", "small"), ("mid", "big")]


def test_no_nested_loop(spark):
    regions = spark.createDataFrame([("a", [{"lng": 0.0, "lat": 0.0}, {"lng": 1.0, "lat": 0.0}, {"lng": 1.0, "lat": 1.0}])], "t string, ring array<struct<lng:double,lat:double>>")
    df = spark.createDataFrame([("p", 0.5, 0.7)], "id string, lat double, lng double")
    plan = S.within(df, "id", regions, "t", "ring")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
