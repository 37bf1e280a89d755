import datetime as dt
import random

from pyspark.sql import functions as F

from stemma.llm import survivors as S

T = [dt.datetime(2024, 1, d, tzinfo=dt.timezone.utc) for d in range(1, 28)]
RANK = {"a": 1, "b": 2, "c": 3, "d": 4}


def registry(spark):
    return spark.createDataFrame([("p", k, v) for k, v in RANK.items()], "kind string, source string, precedence int")


def run(spark, rows):
    df = spark.createDataFrame(rows, "kind string, id string, field string, src string, val string, at timestamp")
    facts = S.newest(df, ["kind", "id", "field"], "src", "val", "at")
    return {(r["id"], r["field"]): (r["source"], r["value"], r["layer"]) for r in S.choose(facts, ["kind", "id"], "field", registry(spark)).collect()}


def test_against_the_rule(spark):
    rng = random.Random(8)
    rows = [("p", f"e{rng.randrange(30)}", f"f{rng.randrange(3)}", rng.choice([" A", "b ", "C", "d", "zz", None]), rng.choice([None, " ", "n/a", "Unknown", "x", "y", " z "]), rng.choice([None, *T])) for _ in range(1_500)]
    rows += rows[:200]
    best = {}
    for _, e, f, s, v, at in rows:
        s, v = (s or "").strip().lower(), (v or "").strip()
        if s in RANK and v.lower() not in S.PLACEHOLDERS:
            key = (RANK[s], -(at.timestamp()) if at else float("inf"), v)
            best[e, f] = min(best.get((e, f), (key, s, v)), (key, s, v))
    got = run(spark, rows)
    assert {k: v[:2] for k, v in got.items()} == {k: (s, v) for k, (_, s, v) in best.items()}


def brute_layers(records):
    """records: source -> (stated fields, trust, time or None)."""
    at = lambda r: r[2].timestamp() if r[2] else float("-inf")
    beats = lambda a, b: a[0] >= b[0] and a[1] <= b[1] and at(a) >= at(b) and (a[0], a[1], at(a)) != (b[0], b[1], at(b))
    left, out, k = dict(records), {}, 1
    while left:
        best = [s for s, r in left.items() if not any(beats(o, r) for o in left.values())]
        out |= dict.fromkeys(best, k)
        for s in best:
            del left[s]
        k += 1
    return out


def test_layers_against_brute_force(spark):
    rng = random.Random(4)
    records = {e: {s: (rng.randint(0, 4), RANK[s] if rng.random() < 0.8 else 1, rng.choice([None, *T[:6]])) for s in "abcd" if rng.random() < 0.9} for e in range(60)}
    rows = [(e, s, *r) for e, rs in records.items() for s, r in rs.items()]
    df = spark.createDataFrame(rows, "e int, source string, fields long, trust int, at timestamp")
    got = df.groupBy("e").agg(F.collect_list(F.struct("fields", "trust", "at", "source")).alias("p")).select("e", F.explode(S.layers(F.col("p"))).alias("x")).select("e", "x.source", "x.layer").collect()
    assert {(r["e"], r["source"]): r["layer"] for r in got} == {(e, s): k for e, rs in records.items() for s, k in brute_layers(rs).items()}


def test_fields_are_filled_from_further_layers(spark):
    """b's record is dominated by a's, which states nothing of field h; d is in a later layer still, and alone states i."""
    rows = [("p", "e", f, "a", "x", T[9]) for f in "fgj"] + [("p", "e", "h", "a", "n/a", T[9])]
    rows += [("p", "e", "f", "b", "y", T[5]), ("p", "e", "h", "b", "z", T[5]), ("p", "e", "i", "d", "w", T[1]), ("p", "e", "h", "d", "late", T[20])]
    got = run(spark, rows)
    assert got[("e", "f")] == ("a", "x", 1)
    # d's newer record is in the first layer and states h; b is better trusted, and overrules it from the second
    assert got[("e", "h")] == ("b", "z", 2)
    assert got[("e", "i")] == ("d", "w", 1)


def test_ties_nulls_and_empty(spark):
    assert run(spark, [("p", "e", "f", "a", "y", T[0]), ("p", "e", "f", "a", "x", T[0]), ("p", "e", "f", "A_", "q", T[1])]) == {("e", "f"): ("a", "x", 1)}
    assert run(spark, [("p", "e", "f", "a", None, None), ("p", "e", "f", "zz", "v", T[0]), ("q", "e", "f", "a", "v", T[0])]) == {}
    assert run(spark, []) == {}
    assert run(spark, [("p", None, "f", "a", "v", None), ("p", "e", "f", "a", "v", None)]) == {("e", "f"): ("a", "v", 1)}


def test_hot_group(spark):
    rows = [("p", "hot", "f", "abcd"[i % 4], f"v{i:05}", T[i % 27]) for i in range(4_000)]
    assert run(spark, rows)[("hot", "f")][0] == "a"


def test_lists(spark):
    df = spark.createDataFrame([("e", [("Stone Index", [" nameMeaning", "NAME"]), (None, ["x"]), ("b", None)]), ("g", None)], "id string, sources array<struct<source_id:string,fields:array<string>>>")
    got = sorted((r["entity_id"], r["source"] or "", r["listed_field"]) for r in S.listed(df, "id", "sources").collect())
    assert got == [("e", "", "x"), ("e", "stone-index", "name"), ("e", "stone-index", "namemeaning")]
