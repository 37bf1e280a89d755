import pytest
from pyspark.sql import functions as F

from stemma.operators import crossrefs as X
from stemma.operators import entities as E
from stemma.operators import genealogy as N
from stemma.operators import graph as G
from stemma.operators import quality as Q
from stemma.operators import search as S
from stemma.operators import store
from stemma.util import keep_first


def test_upsert_delete_defaults_migrate(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    new = spark.createDataFrame([("b", 5, 1), ("b", 6, 2), ("c", 7, 1)], "id string, v int, at int")
    out = store.upsert(t, new, ["id"], ["at"])
    assert sorted((r["id"], r["v"]) for r in out.collect()) == [("a", 1), ("b", 6), ("c", 7)]
    assert [r["id"] for r in store.delete(t, new, ["id"]).collect()] == ["a"]
    assert store.with_defaults(t.filter("false").select("v"), {"v": 3, "w": "x"}).first().asDict() == {"v": 3, "w": "x"}
    tables, version = store.migrate({"t": t}, 1, [(3, "t", lambda d: d.withColumn("w", F.lit(0))), (2, "t", lambda d: d.filter("v > 1")), (1, "t", lambda d: d.limit(0)), (4, "none", lambda d: d)])
    assert version == 4 and [tuple(r) for r in tables["t"].collect()] == [("b", 2, 0)]
    assert store.read_or_empty(spark, "/nowhere/at/all", "id string").count() == 0
    with_time = store.stamped(t)
    assert "modified" in with_time.columns and store.seeded(t) and not store.seeded(t.limit(0))


def test_keep_first_is_by_order_with_nulls(spark):
    df = spark.createDataFrame([(1, None, "x"), (0, None, "y"), (2, "k", "z"), (2, "k", "z")], "seq int, k string, v string")
    assert sorted((r["k"] or "", r["v"]) for r in keep_first(df, ["k"], ["seq"]).collect()) == [("", "y"), ("k", "z")]


def test_sets_and_tags(spark):
    df = spark.createDataFrame([([1, 5], 2, 4)], "s array<int>, a int, b int")
    assert df.select(store.sorted_union(F.col("s"), F.col("b"), F.col("a"))).first()[0] == [1, 2, 3, 4, 5]
    ann = spark.createDataFrame([(["x"], "theme"), (["x"], "note"), (None, "theme")], "tags array<string>, type string")
    assert store.tagged(ann, "tags", "x", "theme").count() == 1 and store.tagged(ann, "tags", "x").count() == 2


def test_classify_boundaries(spark):
    rows = [("O", "N", 100, "quotation"), ("O", "N", 99, "allusion"), ("O", "N", 29, "theme"), ("O", "N", 9, "keyword"), ("O", "N", 2, "theme"), ("O", "O", 5, "parallel"), ("O", "O", 4, "keyword"), ("O", "O", 1, "parallel"), ("O", "P", 20, "theme"), ("O", "P", 19, "keyword"), ("O", "P", 1, "keyword"), ("O", "A", 200, "theme"), ("S", "T", 1, "parallel")]
    part = {"O": "OT", "P": "OT", "N": "NT", "A": "AP", "S": "NT", "T": "NT"}
    df = spark.createDataFrame([(a, b, v, part[a], part[b], w) for a, b, v, w in rows], "a string, b string, v int, pa string, pb string, want string")
    none = F.lit(None).cast("string")
    got = df.select("want", X.classify(F.col("v"), F.col("a"), F.col("b"), F.lit(1), F.lit(6), F.col("pa"), F.col("pb"), none, (("S", "T"),)).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)
    far = df.limit(1).select(X.classify(F.lit(5), F.lit("O"), F.lit("O"), F.lit(1), F.lit(7), F.lit("OT"), F.lit("OT"), none, ()), X.classify(F.lit(1), F.lit("O"), F.lit("N"), F.lit(1), F.lit(1), F.lit("OT"), F.lit("NT"), F.lit("possible_allusion"), ())).first()
    assert tuple(far) == ("keyword", "allusion")


@pytest.fixture
def net(spark):
    links = spark.createDataFrame([("a.1.1", "b.1.1", "theme", 1), ("c.1.1", "a.1.1", "theme", 2), ("b.1.1", "d.1.1", "quotation", 3), ("x.1.1", "y.1.1", "theme", 4)], "source_verse string, target_verse string, type string, seq long").withColumn("id", F.concat("source_verse", F.lit("→"), "target_verse"))
    mentions = spark.createDataFrame([("a.1.1", "person", "p", 1), ("a.1.1", "place", "q", 1), ("d.1.1", "event", "e", 1)], "osis_id string, kind string, entity_id string, seq long")
    return links, mentions


def test_neighbourhood(net):
    links, mentions = net
    nodes, edges, cut = G.neighbourhood(links, mentions, "a.1.1", 1)
    assert [r["node"] for r in nodes.orderBy("ord").collect()] == ["verse:a.1.1", "verse:b.1.1", "verse:c.1.1", "person:p", "place:q"] and not cut and edges.count() == 4
    nodes, edges, cut = G.neighbourhood(links, mentions, "a.1.1", 3)
    assert nodes.count() == 7 and edges.count() == 6
    nodes, edges, cut = G.neighbourhood(links, mentions, "a.1.1", 2, max_nodes=3)
    assert [r["node"] for r in nodes.orderBy("ord").collect()] == ["verse:a.1.1", "verse:b.1.1", "verse:c.1.1"] and cut and edges.count() == 2
    nodes, _, _ = G.neighbourhood(links, mentions, "a.1.1", 2, types=["quotation"])
    assert sorted(r["node"] for r in nodes.collect()) == ["person:p", "place:q", "verse:a.1.1"]
    nodes, edges, _ = G.neighbourhood(links, mentions, "a.1.1", 1, kinds=["place"])
    assert sorted(r["node"] for r in nodes.collect()) == ["place:q", "verse:a.1.1"] and edges.count() == 1
    nodes, edges, cut = G.neighbourhood(links, mentions, "none.1.1", 2)
    assert nodes.count() == 1 and edges.count() == 0 and not cut


def test_visits(spark):
    df = spark.createDataFrame([("u", t, e) for t, e in enumerate("aabbacd")], "who string, at int, entry string")
    assert [r["entry"] for r in G.visits(df, "who", "at", "entry", kept=3).orderBy("rank").collect()] == ["d", "c", "a"]


def test_family(spark):
    links = spark.createDataFrame([("r", "father-of", "a", 1), ("r", "father-of", "b", 2), ("m", "mother-of", "a", 3), ("a", "mother-of", "c", 4), ("z", "father-of", "a", 5), ("c", "father-of", "r2", 6), ("r2", "father-of", "c", 7), ("a", "spouse-of", "q", 8)], "person_from string, type string, person_to string, seq long")
    p = N.parents(links)
    assert {r["child"]: (r["father"], r["mother"], r["both"]) for r in p.collect()} == {"a": ("r", "m", True), "b": ("r", None, False), "c": ("r2", "a", True), "r2": ("c", None, False)}
    roots = spark.createDataFrame([("r",)], "node string")
    assert sorted((r["node"], r["depth"]) for r in N.below(links, roots).collect()) == [("a", 1), ("b", 1), ("c", 2), ("r", 0), ("r2", 3)]
    start = spark.createDataFrame([("c",)], "node string")
    assert N.ancestry(p, start, maternal=True).first()["path"] == ["m", "a", "c"]
    assert N.ancestry(p, start).first()["path"] == ["r2", "c"]  # ends before the cycle closes
    assert [tuple(r) for r in N.many_fathers(links).collect()] == [("a", 2)]
    named = spark.createDataFrame([("x_1", "Dan"), ("x_2", "Dan")], "id string, name string")
    counts = spark.createDataFrame([("x_2", 3)], "id string, below long")
    assert N.find_root("dan", named, named, counts).first()["id"] == "x_2" and N.find_root("x_1", named, named, counts).first()["id"] == "x_1"
    assert N.find_root("nobody", named, named, counts).count() == 0


def test_layout(spark):
    from stemma.operators.hierarchy import hierarchy

    tree = hierarchy(spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "b"), ("e", "b")], "node string, parent string"))
    y = {r["node"]: r["y"] for r in N.layout(tree, y0=0, row=10).collect()}
    assert y == {"d": 0.0, "e": 10.0, "b": 5.0, "c": 20.0, "a": 12.5}
    rail = N.rail(tree, spark.createDataFrame([("a", "root"), ("b", "B"), ("c", "C")], "node string, branch string"))
    assert [(r["node"], r["branch"], r["relation"]) for r in rail.orderBy("ord").collect()] == [("a", "root", "focused"), ("b", "B", "son"), ("d", "B", "grandson"), ("e", "B", "grandson"), ("c", "C", "son")]


def test_place_fold(spark):
    places = spark.createDataFrame([("n", None, None, None), ("h", 1.0, 1.0, 0.8), ("u", 1.0, 1.0, None), ("l", 1.0, 1.0, 0.5)], "id string, lat double, lng double, confidence double")
    rows = spark.createDataFrame([("n", 5.0, 5.0, 0.9, 1), ("n", 6.0, 6.0, 0.95, 2), ("h", 2.0, 2.0, 0.9, 1), ("u", 2.0, 2.0, 0.9, 1), ("l", 9.0, 9.0, 0.9, 1), ("l", 1.1, 1.1, 0.6, 2), ("l", 1.2, 1.2, 0.7, 3)], "place_id string, lat double, lng double, confidence double, seq long")
    got = {r["id"]: (r["lat"], r["confidence"], r["source"], r["added"], r["protected"], r["unknown"], r["drifted"], r["replaced"]) for r in E.enrich_places(places, rows).collect()}
    assert got == {"n": (5.0, 0.9, "row", 1, 1, 0, 0, 0), "h": (1.0, 0.8, "own", 0, 1, 0, 0, 0), "u": (1.0, None, "own", 0, 0, 1, 0, 0), "l": (1.2, 0.7, "merged", 0, 0, 0, 1, 2)}


def test_relatives(spark):
    start = spark.createDataFrame([("p", "P", "X", "name-unique", None), ("q", "Q", None, None, ["A", "B"]), ("s", "S", None, None, ["C", "D"]), ("t", "T", None, None, ["E", "F"])], "id string, name string, external_id string, stage string, candidates array<string>")
    family = spark.createDataFrame([("q", "p"), ("s", "q"), ("t", "p")], "id string, relative string")
    near = spark.createDataFrame([("A", "X"), ("C", "A"), ("E", "X"), ("F", "X")], "a string, b string")
    got = {r["id"]: (r["external_id"], r["stage"]) for r in E.resolve_by_relatives(start, family, near).collect()}
    assert got == {"p": ("X", "name-unique"), "q": ("A", "genealogy-context"), "s": ("C", "genealogy-context"), "t": (None, None)}


def test_merge(spark):
    claims = spark.createDataFrame([("e", "f", "b", "1", 1), ("e", "f", "a", "2", 2), ("e", "f", "z", None, 3), ("e", "own", "b", "9", 1), ("e", "own", "a", "8", 2), ("g", "f", "z", "1", 1)], "entity_id string, field string, source_id string, value string, seq long")
    got = {(r["entity_id"], r["field"]): (r["value"], r["source"], r["conflicted"]) for r in E.merge_fields(claims, E.MergePolicy(("a", "b"), exclusive=(("own", "b"),))).collect()}
    assert got == {("e", "f"): ("2", "a", True), ("e", "own"): ("9", "b", False), ("g", "f"): ("1", "z", False)}
    lists = spark.createDataFrame([("e", ["b", "a"], 2), ("e", ["c", "b"], 1), ("e", None, 3)], "entity_id string, refs array<string>, seq long")
    assert E.merge_lists(lists, ["entity_id"], "refs").first()["refs"] == ["c", "b", "a"]


def test_quality(spark):
    ref = spark.createDataFrame([("A", 1, 3), ("A", 2, 2)], "book string, chapter int, verses int")
    rows = [("t", "A", 1, 1, None, "A.1.1", "x", 1), ("t", "A", 1, 1, None, "A.1.1", "x", 2), ("t", "A", 1, 2, 3, "A.1.2", " ", 3), ("t", "A", 1, 3, None, "A.1.3", "x", 4), ("t", "A", 3, 1, None, "A.3.1", "x", 5), ("t", "Z", 1, 1, None, "Z.1.1", "x", 6), ("t", "A", 0, 1, None, "A.0.1", "x", 7), ("t", "A", 2, 2, 2, "A.2.2", "x", 8), ("t", "A", 2, 3, None, "A.2.3", "x", 9)]
    v = spark.createDataFrame(rows, "translation_id string, book string, chapter int, verse int, verse_end int, osis_id string, text string, seq long")
    got = {(r["check"], r["where"]) for r in Q.validate(v, ref).collect()}
    assert got == {("duplicate", "A.1.1"), ("unknown book", "Z.1.1"), ("blank text", "A.1.2"), ("bad number", "A.0.1"), ("inverted range", "A.2.2"), ("overlap", "A.1.3"), ("too many chapters", "A"), ("gap", "A.2.1"), ("gap", "A.2.2"), ("overrun", "A.2")}
    known = spark.createDataFrame([("t", "A.2.1")], "translation_id string, osis_id string")
    assert {(r["where"], r["severity"]) for r in Q.interior_gaps(v, ref, known).collect()} == {("A.2.1", "expected"), ("A.2.2", "warning")}
    assert Q.validate(v.filter("false"), ref).count() == 0


def test_lemma_groups(spark):
    rows = [("t", "A.1.1", 1, "Love loves love", [(0, 4, ["G1"]), (5, 10, ["G1", "G2"])], ["G1", "G2"]), ("t", "A.1.2", 2, "glove Love", None, None)]
    v = spark.createDataFrame(rows, "translation_id string, osis_id string, seq long, text string, align array<struct<start:int,end:int,ids:array<string>>>, lemmas array<string>")
    got = {r["lemma"]: (r["hits"], r["verses"], r["surfaces"]) for r in S.lemma_groups(S.lemma_hits(v, "love", True)).collect()}
    assert got == {"G1": (2, 1, "love 1, loves 1"), "G2": (1, 1, "loves 1"), None: (2, 2, "love 2")}
    assert [(r["surface"], r["count"]) for r in S.id_search(v, "g1").orderBy("surface").collect()] == [("love", 1), ("loves", 1)]
    assert S.dispatch("h12", ["x"], ["t"]) == ("id", ["t"]) and S.dispatch("love", ["x"], ["t"]) == ("flat", ["x"]) and S.dispatch("love", ["t", "x"], ["t"]) == ("lemma", ["t"])


def test_search_ranks(spark):
    docs = spark.createDataFrame([(1, "the good shepherd"), (2, "shepherds and shepherds"), (3, "a sheperd"), (4, "nothing"), (5, None)], "id int, text string")
    index = S.postings(docs, "id", "text")
    got = [r["id"] for r in S.top(S.search(index, "id", "shepherd"), "id").collect()]
    assert got[0] == 1 and set(got) == {1, 2, 3}
    assert S.search(index, "id", "the").count() == 0
    scored = S.search(index, "id", "good shepherd", fuzzy=0).join(docs, "id")
    assert S.rerank(scored, "text", "good shepherd").orderBy(F.desc("score")).first()["score"] > 50


def test_supplement(spark):
    rows = spark.createDataFrame([("A", " Father ", "B", 1), ("A", "father", "B", 2), ("A", "friend", "B", 3), ("A", "wife", "Z", 4), ("B", "wife", "A", 5), ("A", "wife", "B", 6), ("A", "father", "A", 7)], "source string, type string, target string, seq long")
    ids = spark.createDataFrame([("A", "a"), ("B", "b")], "external_id string, id string")
    got = sorted(map(tuple, N.supplement_links(rows, ids, {"father": "father-of", "wife": "spouse-of"}).collect()))
    assert got == [("a→father-of→b", "a", "b", "father-of"), ("a→spouse-of→b", "b", "a", "spouse-of")]
    links = N.without_divine(spark.createDataFrame([("god", "a"), ("a", "b")], "person_from string, person_to string"), ("god",))
    assert links.count() == 1


def test_cut_and_clean(spark):
    from stemma.util import broadcast_if_small, checkpoint_root, clean, cut, spread

    df = cut(spark.range(5).filter("id > 9"))
    assert df.count() == 0 and df.columns == ["id"]
    assert checkpoint_root(spark) == checkpoint_root(spark)
    assert broadcast_if_small(spark.range(10), 5).count() == 10
    one = spark.range(0, 100, 1, 1)
    assert spread(one).rdd.getNumPartitions() > 1 and spread(spark.range(0, 100, 1, 64)).rdd.getNumPartitions() == 64
    assert clean(spark) > 0 and clean(spark) == 0
