import pytest

from stemma.operators import malformed as M

PERSON = [
    ("12,A.1,Ana_1,son,Bo-ra_2,note", None, None),
    ('"12", A.1 ,"Ana_1",son,O\'dan_2,"a ""b"", c\nd"\r', None, None),
    ("12,A.1,Ana_1,son,Bo_2,", None, None),
    ('12,A.1,"Ana_1,son,Bo_2,note', "quoting", "source"),
    ('12,A.1,"Ana_1" x,son,Bo_2,note', "quoting", "source"),
    ('12,A.1,An"a_1,son,Bo_2,note', "quoting", "source"),
    ("12,A.1,Ana_1,son,Bo_2", "columns", "note"),
    ("12,A.1,Ana_1,son,Bo_2,note,more", "columns", None),
    ("12|A.1|Ana_1", "columns", "number"),
    ("0,A.1,Ana_1,son,Bo_2,note", "value", "number"),
    ("1.0,A.1,Ana_1,son,Bo_2,note", "value", "number"),
    ("12,A.1,Ana,son,Bo_2,note", "value", "source"),
    ("12,A.1,-Ana_1,son,Bo_2,note", "value", "source"),
    ("12,A.1,Ana_1,son,Bo_0,note", "value", "target"),
    ("12,A.1,Ana_1,son,Bo_2,a\x0bb", "value", "note"),
    ("12,A.1,Ana_1,son,Bo_2,a�b", "value", "note"),
    ("\u00a012\u00a0,A.1,\u00a0Ana_1,son,\"\u00a0Bo_2 \u00a0\",note", None, None),
    ("\u00a0,A.1,Ana_1,son,Bo_2,note", "value", "number"),
    ("", "columns", "number"),
    (None, "columns", "number"),
]
STRONGS = [
    ('7,קול,"kol (kol)\n1. a voice"', None, None),
    ("7,קול,1. a voice", None, None),
    ('7," ","kol\n1. a voice"', "value", "word"),
    ("7,,1. a voice", "value", "word"),
    ("7,\u00a0,1. a voice", "value", "word"),
    ('7,"\u00a0 \u00a0",1. a voice', "value", "word"),
    ("\u00a07,\u00a0קול,1. a voice", None, None),
    ('7,קול,"kol a voice 1. no"', "value", "gloss"),
    ("7,קול,", "value", "gloss"),
    ("x,קול,1. a voice", "value", "number"),
]


@pytest.mark.parametrize("kind, cases", [("person_relationship", PERSON), ("hebrew_strongs", STRONGS)])
def test_reasons(spark, kind, cases):
    df = spark.createDataFrame([(i, kind, c[0]) for i, c in enumerate(cases)], "k int, feed string, raw string")
    got = {r["k"]: (r["reason"], r["field"]) for r in M.split_rows(df, "raw", "feed", M.FEEDS).collect()}
    assert got == {i: (c[1], c[2]) for i, c in enumerate(cases)}


def test_unknown_kind_empty_and_clash(spark):
    df = spark.createDataFrame([("nope", "1"), (None, "1"), (None, "1")], "feed string, raw string")
    assert [r["reason"] for r in M.split_rows(df, "raw", "feed", M.FEEDS).collect()] == ["columns"] * 3
    assert M.split_rows(df.filter("false"), "raw", "feed", M.FEEDS).count() == 0
    with pytest.raises(ValueError):
        M.split_rows(df.withColumnRenamed("raw", "reason"), "reason", "feed", M.FEEDS)


def test_cells_and_long_rows(spark):
    long = "9,A.1,Ana_1,son,Bo_2,\"" + 'x ""y"" ' * 20_000 + '"'
    many = "1," * 30_000
    df = spark.createDataFrame([("person_relationship", long), ("person_relationship", many)], "feed string, raw string")
    rows = M.split_rows(df, "raw", "feed", M.FEEDS)
    assert [r["reason"] for r in rows.collect()] == [None, "columns"]
    c = rows.filter("reason is null").select(M.cells(rows["raw"], M.FEEDS["person_relationship"]).alias("c")).first()["c"]
    assert (c["number"], c["source"], c["note"][:6]) == ("9", "Ana_1", 'x "y" ')


def parse(raw):
    """A strict parser, character by character: the cells, or None for broken quoting."""
    raw = raw[:-1] if raw.endswith("\r") else raw
    cells, i = [], 0
    while True:
        if raw[i : i + 1] == '"':
            i, cell = i + 1, ""
            while True:
                if i >= len(raw):
                    return None
                if raw[i] == '"':
                    if raw[i + 1 : i + 2] != '"':
                        break
                    i += 1
                cell += raw[i]
                i += 1
            i += 1
            if raw[i : i + 1] not in ("", ","):
                return None
        else:
            end = raw.find(",", i)
            end = len(raw) if end < 0 else end
            cell = raw[i:end]
            if '"' in cell:
                return None
            i = end
        cells.append(cell)
        if i >= len(raw):
            return cells
        i += 1


def test_random_rows_against_a_strict_parser(spark):
    import random

    rng = random.Random(21)
    parts = ['"', '""', ",", "a_1", "7", "x", " ", "\n", "Ana_2", '"Bo_3"', "1,A.1,Ana_1,son,Bo_2,", "-", "note"]
    raws = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(1_500)]
    raws += ["1,A.1,Ana_1,son,Bo_2," + "".join(rng.choice(parts) for _ in range(rng.randint(0, 4))) for _ in range(700)]
    df = spark.createDataFrame([(i, "person_relationship", r) for i, r in enumerate(raws)], "k int, feed string, raw string")
    got = {r["k"]: r["reason"] for r in M.split_rows(df, "raw", "feed", M.FEEDS).collect()}
    for i, raw in enumerate(raws):
        cells = parse(raw)
        if cells is None:
            assert got[i] == "quoting", raw
        elif len(cells) != 6:
            assert got[i] == "columns", raw
        else:
            assert got[i] in (None, "value"), raw
            assert (got[i] is None) <= cells[0].strip().isdigit(), raw
    assert {"quoting", "columns", "value", None} <= set(got.values())
