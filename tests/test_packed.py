import pytest
from pyspark.sql import functions as F

from stemma.operators import packed as P
from stemma.operators.packed import unpack

CASES = [
    ('Gan.1.2, "x, y""z"; “b;c”,, Gan.1.3 Gan.1.4 and Kh 1:5<br>q', ["Gan.1.2", 'x, y"z', "b;c", "Gan.1.3", "Gan.1.4", "Kh 1:5", "q"]),
    ("['A.1.2', 'B.2.3']", ["A.1.2", "B.2.3"]),
    ('["A.1.2","B 2:3-5"]', ["A.1.2", "B 2:3-5"]),
    ("{A.1.2,B.3.4}", ["A.1.2", "B.3.4"]),
    ('"A.1.2 | alt"', ["A.1.2 | alt"]),
    ("A.1.2 / B.1.2 · C.1.3 & D.1.4 + E.1.5 // F.1.6", ["A.1.2", "B.1.2", "C.1.3", "D.1.4", "E.1.5", "F.1.6"]),
    ("A.1.2; B.1.2\r\nC.1.2\tD.1.2，E.1.2、F.1.2；G.1.2", ["A.1.2", "B.1.2", "C.1.2", "D.1.2", "E.1.2", "F.1.2", "G.1.2"]),
    ('"never closed, A.1.2', ["never closed", "A.1.2"]),
    ("one", ["one"]),
    (" , ; ", []),
    ("", []),
    (None, []),
    ("[]", []),
    ('""', []),
    ("2Sam 3:4 2Sam.3.5", ["2Sam 3:4", "2Sam.3.5"]),
    ("Gan 1:1,3; Tor 2:3,4", ["Gan 1:1,3", "Tor 2:3,4"]),
    ("Gan 1:1, 3", ["Gan 1:1", "3"]),
    ("Gan 1:1, 3, Tor 2:3", ["Gan 1:1", "3", "Tor 2:3"]),
    ("Gan.1.1;2 Tor.1.3;4", ["Gan.1.1;2", "Tor.1.3;4"]),
]


def test_values_and_positions(spark):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(CASES)], "k int, f string")
    got = {}
    for r in unpack(df, "f", ["k"]).orderBy("k", "pos").collect():
        assert r["pos"] == len(got.setdefault(r["k"], []))
        got[r["k"]].append(r["value"])
    assert got == {i: v for i, (_, v) in enumerate(CASES) if v}


def test_rules_decide(spark):
    """One pattern for all skeletons gives other rows."""
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(CASES)], "k int, f string")
    every = r"(?:[,;|/&+·、，；•\s]|<br>|(?<=\s)and(?=\s))+"
    one = unpack(df, "f", ["k"], rule=lambda s: F.when(s != "", F.lit(every)).otherwise("(?!)"))
    ours = unpack(df, "f", ["k"])
    assert ours.exceptAll(one).count() > 0
    assert one.exceptAll(ours).count() > 0


def test_skeletons_are_few(spark):
    df = spark.range(500).select(F.expr("array_join(transform(sequence(1, 1 + id % 40), i -> concat('Gan.', i, '.', id)), '; ')").alias("f"))
    s = df.select(P._skeleton(F.col("f"), F.lit(False)).alias("s")).distinct()
    assert s.count() == 2


def test_empty_repeated_and_clashing(spark):
    df = spark.createDataFrame([(1, "a,b", "x"), (1, "a,b", "y")], "pos int, f string, value string")
    assert unpack(df.filter("false"), "f", ["pos"], "p", "v").count() == 0
    assert unpack(df, "f", [], "pos", "value").count() == 4
    with pytest.raises(ValueError):
        unpack(df, "f", ["pos"])


def test_long_field_and_shuffled_rules(spark):
    df = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(50_000)), lambda i: F.concat(F.lit("A.1."), i)), "; ").alias("f"))
    rows = unpack(df, "f", rules_limit=0)
    assert rows.count() == 50_000
    assert rows.filter("value <> concat('A.1.', pos + 1)").count() == 0


def test_random_fields_come_apart_as_they_were_put_together(spark):
    import random

    rng = random.Random(12)
    seps = [",", ", ", ";", "; ", "|", " | ", "//", " / ", " & ", " + ", " · ", " and ", ", and ", "<br>", "\n", "\r\n", "\t", "、", "；", "，", ";\xa0"]

    def value():
        v = f"{rng.choice(['', '1', '2'])}{rng.choice(['Gan', 'Tor', 'Mik'])}{rng.choice(['.{0}.{1}', ' {0}:{1}', '.{0}.{1}-{1}'])}".format(rng.randint(1, 50), rng.randint(1, 40))
        if rng.random() < 0.3:
            v += rng.choice([", 7", ";8", " | alt", ' "or"', " / x", " and y"])
            return v, '"' + v.replace('"', '""') + '"' if '"' in v or rng.random() < 0.6 else f"“{v}”"
        return v, v

    rows, want = [], {}
    for i in range(400):
        values = [value() for _ in range(rng.randint(1, 12))]
        two = [rng.choice(seps) for _ in range(2)]
        text = values[0][1]
        for _, v in values[1:]:
            text += rng.choice(two) + (rng.choice(["", "", two[0]])) + v
        rows.append((i, rng.choice(["", " ", "\t"]) + text + rng.choice(["", "  "])))
        want[i] = [v for v, _ in values]
    df = spark.createDataFrame(rows, "k int, f string")
    got = {}
    for r in unpack(df, "f", ["k"]).orderBy("k", "pos").collect():
        got.setdefault(r["k"], []).append(r["value"])
    assert got == want
