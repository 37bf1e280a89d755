import json

import pytest
from pyspark.sql import functions as F

from stemma.functions import text as T
from stemma.sources import delimited as D
from stemma.sources import markup as K
from stemma.sources import records as J
from stemma.sources import stores as W

CODES = {"GEN": "Gen", "EXO": "Exod", "MAT": "Matt"}


def one(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes('﻿id,name,note\r\n1, Ana ,"a ""b"", c\nd"\r\n2,x"y,\r\n,,\r\n3\r\n'.encode())
    rows = [tuple(r) for r in D.read_csv(spark, str(p)).collect()]
    assert rows == [("1", "Ana", 'a "b", c\nd'), ("2", 'x"y', ""), ("3", "", "")]


def test_csv_loose(spark, tmp_path):
    p = tmp_path / "h.csv"
    p.write_text('1,אב,"av (ab- \ncd) n.\n1. father"\r\nx,y\n7, z ,a"b,c"d\n')
    rows = D.read_csv_loose(spark, str(p), ["number", "word", "gloss"]).orderBy("seq").collect()
    assert [(r["number"], r["word"], r["gloss"]) for r in rows][:3] == [("1", "אב", "av (ab- \ncd) n.\n1. father"), ("x", "y", None), ("7", " z ", "ab,cd")]
    lex = D.hebrew_lexicon(D.read_csv_loose(spark, str(p), ["number", "word", "gloss"])).collect()
    assert [(r["id"], r["transliteration"], r["pronunciation"], r["gloss"]) for r in lex] == [("H1", "av", "ab-cd", "father"), ("H7", "ab,cd", None, "ab,cd")]


def test_naive_split(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text('h,h,h,h,h\na,1,"x,y",son\nb,2,u,v,w,more\nshort,1\n')
    rows = D.read_split(spark, str(p), 5, {"source": 2, "type": 3, "target": 4}).collect()
    assert [(r["source"], r["type"], r["target"]) for r in rows] == [('"x', 'y"', "son"), ("u", "v", "w")]


def test_links(spark):
    lines = ["From Verse\tTo\tVotes", "# note", "", "Gen.1.1\tJohn.1.1-John.1.3\t12abc", "Gen.1.1\tJohn.1.1\t99", "Gen.1.1\tGen.1.1\t5", "Gen.1.2\tGen.1.3\t0", "Gen.1.2\tGen.1.3", "Gen\tGen.1.3\t4", "Gen.1.2\tGen.1.4\t-3", "Gen.1.5\tGen.1.6\t3"]
    df = spark.createDataFrame(list(enumerate(lines)), "seq long, value string")
    assert sorted(map(tuple, D.parse_links(df).collect())) == [("Gen.1.1→John.1.1", "Gen.1.1", "John.1.1", 12), ("Gen.1.5→Gen.1.6", "Gen.1.5", "Gen.1.6", 3)]


def test_tables(spark):
    people = spark.createDataFrame([("a_1", "Ana", "Female", "Gen.1.1, Gen.1.2-Gen.1.5; bad"), ("", "Bo", None, ""), ("c_1", None, "x", None)], "personLookup string, displayTitle string, gender string, verses string")
    assert [tuple(r) for r in D.persons_table(people).collect()] == [("a_1", "Ana", "Female", ["Gen.1.1", "Gen.1.2"])]
    places = spark.createDataFrame([("p", "P", "1.5", "2", "", "0.7"), ("q", "Q", "1.5", "", "Rough", None)], "placeLookup string, displayTitle string, latitude string, longitude string, precision string, confidence string")
    assert [tuple(r)[:6] for r in D.places_table(places).collect()] == [("p", "P", 1.5, 2.0, 0.7, None), ("q", "Q", None, None, None, "Rough")]
    words = spark.createDataFrame([("Ark", "see [Noah](x/y)")], "term string, definition string")
    assert [tuple(r) for r in D.dictionary_table(words).collect()] == [("ark", "Ark", "see Noah")]


def test_geo_lines(spark):
    good = {"friendly_id": "Ur 1", "id": "a", "url_slug": "ur-1", "identifications": [{"score": {"time_total": 1500}, "resolutions": [{"lonlat": "46.1, 30.9"}]}], "extra": json.dumps({"osises": ["Gen.1.1", "x", "Gen.1.1"]})}
    bare = {"friendly_id": "Ai", "id": "b", "url_slug": "ai", "identifications": []}
    low = good | {"identifications": [{"score": {"time_total": -5}, "resolutions": [{"lonlat": "1,2"}]}], "extra": "{broken"}
    rows = J.parse_geo(one(spark, json.dumps(good), json.dumps(bare), "{bad", json.dumps(low), json.dumps({"id": "z"}))).collect()
    assert [(r["name"], r["lat"], r["lng"], r["confidence"], r["verse_refs"]) for r in rows] == [("Ur 1", 30.9, 46.1, 1.0, ["Gen.1.1"]), ("Ur 1", 2.0, 1.0, 0.0, [])]


def test_scripts(spark):
    script = 'var dict = {"G2": {"lemma": "β", "translit": "b", "strongs_def": "; second: more; x", "derivation": "from"}, "G1": {"lemma": "α", "kjv_def": "first"}, "X": {"lemma": "?"}};'
    rows = J.greek_lexicon(one(spark, script)).collect()
    assert [(r["id"], r["lemma"], r["gloss"]) for r in rows] == [("G1", "α", "first"), ("G2", "β", "second: more")] or rows[1]["gloss"].startswith("second")
    calls = "links.push({linkID:1,bkSource:'MAT',chpSource:1,bkTarget:\"GEN\",chpTarget:2,type:'q'});links.push({bkSource:'MAT',chpSource:3,bkTarget:'ZZZ',chpTarget:2});links.push({bkSource:'MAT',chpSource:3,bkTarget:'EXO',chpTarget:4})"
    assert sorted(map(tuple, J.script_links(one(spark, calls), CODES).collect())) == [("Matt.1", "Gen.2", "quotation"), ("Matt.3", "Exod.4", "possible_allusion")]
    xml = '<P><Passage id="1"><Verse HEB="x">GEN 1:2-3</Verse><Verse GRK="y">MAT 3:4</Verse></Passage><Passage><Verse HEB="x">ZZZ 1:1</Verse></Passage></P>'
    assert sorted(map(tuple, K.passage_groups(one(spark, xml), CODES).collect())) == [(0, 0, "Gen.1.2", "OT"), (0, 1, "Matt.3.4", "NT")]


def test_milestones(spark):
    xml = (
        '<div><verse osisID="Gen.01.002" sID="a"/><w lemma="strong:H0430 strong:H1">In  the</w> <transChange>so</transChange> <divineName>Lord</divineName><note>gone</note> &amp; end<verse eID="a"/>'
        '<verse sID="b" osisID="Gen.1.3"/><w lemma="strong:H7">one</w> <w lemma="strong:H7">two</w><verse eID="b"/><verse osisID="Gen.1.4" sID="c"/>lost<verse osisID="Gen" sID="d"/>x<verse eID="d"/></div>'
    )
    rows = K.milestones(one(spark, xml), "KX").orderBy("seq").collect()
    assert [(r["osis_id"], r["text"], r["lemmas"]) for r in rows] == [("Gen.1.2", "In the so LORD & end", ["H430", "H1"]), ("Gen.1.3", "one two", ["H7"])]
    assert json.loads(rows[1]["align"]) == [[0, 3, "H7"], [4, 7, "H7"]]
    assert rows[0]["align"] is None  # the capitals differ from the walked text


def test_stateful(spark):
    xml = (
        '<usfx><book id="FRT"/><c id="1"/><v id="1"/>front<ve/><book id="GEN"/><c id="1"/><v id="1"/><w s="H0001">A</w><f>no <f>t</f></f> b&lt;c<ve/><v id="2-3"/>two<ve/><v id="4-4"/>four<ve/>'
        '<v id="5a"/><w lemma="H2">x</w> y<ve/><v id="5b"/><wj>z <w s="H3">q</w></wj><ve/><v id="6"/>open<c id="2"/><ve/><v id="1"/><w s="H9">n</w><ve/></usfx>'
    )
    rows = K.stateful(one(spark, xml), "W", CODES).orderBy("chapter", "verse").collect()
    assert [(r["osis_id"], r["text"], r["verse_end"]) for r in rows] == [("Gen.1.1", "A b<c", None), ("Gen.1.2", "two", 3), ("Gen.1.4", "four", None), ("Gen.1.5", "x y z q", None), ("Gen.2.1", "n", None)]
    five = rows[3]
    assert five["lemmas"] == ["H2", "H3"]
    assert [(s["start"], s["end"], s["ids"]) for s in five["align"]] == [(0, 1, ["H2"]), (6, 7, ["H3"])]
    assert [(s["start"], s["end"]) for s in five["wj"]] == [(4, 7)]


def test_equal_files_stay_apart(spark):
    xml = '<usfx><book id="GEN"/><c id="1"/><v id="1"/>one<ve/><v id="2"/>two<ve/></usfx>'
    rows = K.stateful(one(spark, xml, xml), "W", CODES).collect()
    assert sorted((r["osis_id"], r["text"]) for r in rows) == [("Gen.1.1", "one")] * 2 + [("Gen.1.2", "two")] * 2


def test_nested_elements(spark):
    df = one(spark, "a<f>x<f>y</f>z</f>b<fe/>c", "a<f x='1'/>b", "a<f>never closed", "<fe>kept</fe>", None)
    assert [r[0] for r in df.select(T.remove_elements(F.col("value"), "f")).collect()] == ["ab<fe/>c", "a<f x='1'/>b", "a", "<fe>kept</fe>", None]


def test_parts(spark, tmp_path):
    df = spark.range(1_000).select(F.col("id"), F.lpad(F.col("id").cast("string"), 50, "x").alias("t"))
    p = str(tmp_path / "parts")
    W.write_parts(df, p, "id", budget=10_000, whole=20_000)
    back = W.read_parts(spark, p, "id long, t string")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    sizes = [r["n"] for r in spark.read.text(f"{p}/parts").groupBy("part").agg(F.sum(F.octet_length("value") + 1).alias("n")).collect()]
    assert len(sizes) > 5 and max(sizes) <= 10_000
    many = W.parts_of(df, "id", 200, 300)
    assert sorted(r[0] for r in many.select("part").distinct().collect()) == list(range(1, many.agg(F.max("part")).first()[0] + 1))
    assert many.groupBy("part").agg(F.sum(F.octet_length("json") + 1).alias("n")).filter("n > 200").count() == 0
    W.write_parts(df.limit(3), p, "id")
    assert W.read_parts(spark, p, "id long, t string").count() == 3
    spark.range(1).select(F.lit(7).alias("parts")).write.mode("overwrite").json(f"{p}/manifest")
    with pytest.raises(FileNotFoundError):
        W.read_parts(spark, p, "id long, t string")


def test_seed_and_log(spark, tmp_path):
    a = spark.createDataFrame([("1", "x")], "id string, v string")
    p = str(tmp_path / "t")
    assert W.seed(spark, p, a) and not W.seed(spark, p, a)
    assert W.seed(spark, p, spark.createDataFrame([("1", "y"), ("2", "z")], "id string, v string"), force=True)
    assert sorted(map(tuple, spark.read.parquet(p).collect())) == [("1", "y"), ("2", "z")]

    def broken():
        raise RuntimeError("no file")

    assert W.seed_all([("a", lambda: True), ("b", broken), ("c", lambda: False)]) == {"a": "written", "b": "failed: no file", "c": "kept"}
    log = str(tmp_path / "log")
    W.record_run(spark, log, {"source_ids": ["s"], "rows": 3}, ["s"])
    W.record_run(spark, log, {"source_ids": ["s"], "rows": 4}, ["s"])
    assert spark.read.json(log).count() == 2
    with pytest.raises(ValueError):
        W.record_run(spark, log, {"source_ids": ["t"]}, ["s"])


def test_streaming(spark, tmp_path):
    from stemma.streaming import ingest

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.tsv").write_text("# c\nGen.1.1\tGen.1.2\t3\nbad\tGen.1.2\t3\nGen.1.1\tGen.1.2\t3\n")
    q = ingest.write(ingest.unique_links(ingest.links(spark, str(folder))), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert [tuple(r)[:3] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("Gen.1.1", "Gen.1.2", 3)]


def test_stages_and_external(spark, tmp_path):
    out = W.run_stages([("a", lambda t: spark.range(3)), ("b", lambda t: t["a"].filter("id > 0"))], str(tmp_path / "s"), spark)
    assert out["b"].count() == 2
    people = spark.createDataFrame([("p", "P"), ("", "Q"), ("r", None)], "person_id string, person_name string")
    assert [tuple(r) for r in D.external_persons(people).collect()] == [("p", "P")]
    labels = spark.createDataFrame([("p", None, "Proper Name", "x")], "person_id string, english_label string, label_type string, hebrew_label_meaning string")
    assert [tuple(r) for r in D.external_labels(labels).collect()] == [("p", "", "Proper Name", "x", "")]
