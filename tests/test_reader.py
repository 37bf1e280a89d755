from pyspark.sql import functions as F

from stemma.operators import reader as V
from stemma.operators import search as S


def test_selection(spark):
    sel = spark.createDataFrame([("A", 1, v, "s") for v in (1, 2, 4, 4)], "book string, chapter int, verse int, slug string")
    rows = V.annotation_rows(sel)
    assert sorted((r["verse_start"], r["verse_end"]) for r in rows.collect()) == [("A.1.1", "A.1.2"), ("A.1.4", "A.1.4")]
    assert V.annotation_rows(sel, rows.filter("verse_start = 'A.1.4'").select("slug", "verse_start", "verse_end")).count() == 1
    ann = spark.createDataFrame([(1, "A", 1, 3, 1, 9), (2, "A", 1, 5, 1, 6)], "id int, book string, ch int, v int, ch_end int, v_end int")
    assert [r["id"] for r in V.without_overlapping(ann, sel, "id").collect()] == [2]


def test_small_helpers(spark):
    tags = V.add_missing(spark.createDataFrame([("old",)], "name string"), spark.createDataFrame([(" New ",), ("OLD",), ("new",), ("",), (None,)], "name string"))
    assert sorted(r["name"] for r in tags.collect()) == ["new", "old"]
    df = spark.createDataFrame([(list("abcdefgh"),), (list("ab"),)], "p array<string>")
    assert [r[0] for r in df.select(V.breadcrumb(F.col("p"))).collect()] == [["a", "…", "d", "e", "f", "g", "h"], ["a", "b"]]
    refs = spark.createDataFrame([(["A.1.3", "A.1.2", "A.11.1", "B.1.1"],)], "r array<string>")
    assert tuple(refs.select(V.refs_here(F.col("r"), "A", 1)).first()[0]) == ([2, 3], 2)
    assert spark.range(1).select(V.current_mode(F.lit("lexicon")), V.current_mode(F.lit("text"))).first() == ("concordance", "text")


def test_palette_and_stored_index(spark, tmp_path):
    verses = spark.createDataFrame([(1, "in the beginning"), (2, "another beginning"), (3, "end")], "seq long, text string")
    notes = spark.createDataFrame([(9, "My Beginning note")], "event_id long, label string")
    p = str(tmp_path / "index")
    index = V.stored_index(spark, p, verses)
    assert index.count() == V.stored_index(spark, p, verses).count() == S.postings(verses, "seq", "text").count()
    assert V.stored_index(spark, p, verses.limit(2)).select("seq").distinct().count() == 2
    got = sorted(map(tuple, V.palette("beginning", verses, index, notes).collect()))
    assert got == [(2, "verse", "1"), (2, "verse", "2"), (3, "note", "9")]
    assert sorted(map(tuple, V.palette("Gen 1:2", verses, index, notes).collect())) == [(0, "reference", "Gen.1.2")]
    assert [r["key"] for r in V.palette("Jo", verses, index, notes).orderBy("key").collect()] == ["Job", "Joel", "Josh"]
