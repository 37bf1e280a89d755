"""Queries of the table store, of link lookups and of what a reader's panes keep, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.functions import text as T
from stemma.operators import crossrefs as X
from stemma.operators import genealogy as N
from stemma.operators import graph as G
from stemma.operators import reader as V
from stemma.operators import search as S
from stemma.operators import store
from stemma.plans import adapters as A
from stemma.plans import lookup as L
from stemma.util import scratch, table


def filled_tables(spark: SparkSession, d: str) -> DataFrame:
    """Which tables have rows, and how many a full scan reads."""
    rows = [(t, store.seeded(df), df.count()) for t, df in ((t, table(spark, d, t)) for t in ("person", "place", "territory"))] + [("none", store.seeded(table(spark, d, "person").limit(0)), 0)]
    return spark.createDataFrame(rows, "name string, seeded boolean, n long")


def keyed_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows by key: one order, one source by its key in any case."""
    order = store.get(table(spark, d, "orders"), "o_orderkey", 7).select(F.lit("order").alias("kind"), F.col("o_orderkey").cast("string").alias("key"), F.col("o_custkey").cast("string").alias("value"))
    source = store.get_folded(table(spark, d, "source_registry"), "source_id", " Lampstand ").select(F.lit("source").alias("kind"), F.col("source_id").alias("key"), F.col("domain").alias("value"))
    return order.unionByName(source)


def tagged_annotations(spark: SparkSession, d: str) -> DataFrame:
    """Annotations of one kind among those with a tag."""
    a = A.annotations(spark, d).withColumns({"type": F.when(F.col("event_id") % 2 == 0, "theme").otherwise("note"), "tags": F.array("slug", F.concat(F.lit("b"), F.col("book")))})
    return store.tagged(a, "tags", "click", "theme").select("event_id", "type", "slug").unionByName(store.tagged(a, "tags", "view").filter("type = 'note'").select("event_id", "type", "slug"))


def upserted_customers(spark: SparkSession, d: str) -> DataFrame:
    """Customers with new rows put in, some replaced by the last of several, and some deleted."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", F.lit(0).cast("long").alias("version"))
    new = c.filter("c_custkey % 5 = 0").select(F.explode(F.array("c_custkey", -F.col("c_custkey"))).alias("c_custkey"), F.upper("c_name").alias("c_name"), F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("version"))
    put = store.upsert(c, new, ["c_custkey"], ["version"])
    return store.delete(put, c.filter("c_custkey % 7 = 0"), ["c_custkey"])


def settings_rows(spark: SparkSession, d: str) -> DataFrame:
    """Settings with defaults, of a stored row with gaps, and of none."""
    stored = table(spark, d, "nation").filter("n_nationkey = 3").select(F.col("n_name").alias("theme"), F.lit(None).cast("int").alias("size"))
    defaults = {"theme": "plain", "size": 12, "lang": "en"}
    have, none = (store.with_defaults(s, defaults) for s in (stored, stored.limit(0)))
    return have.withColumn("of", F.lit("stored")).unionByName(none.withColumn("of", F.lit("none")))


def migrated_store(spark: SparkSession, d: str) -> DataFrame:
    """Nations after the steps above version 1; a step for a table that isn't there is passed over."""
    steps = [(3, "nation", lambda t: t.withColumn("n_name", F.concat("n_name", F.lit("!")))), (2, "nation", lambda t: t.withColumn("n_name", F.lower("n_name"))), (1, "nation", lambda t: t.limit(0)), (4, "gone", lambda t: t)]
    tables, version = store.migrate({"nation": table(spark, d, "nation").select("n_nationkey", "n_name")}, 1, steps)
    return tables["nation"].withColumn("version", F.lit(version))


def links_of_verse(spark: SparkSession, d: str) -> DataFrame:
    """The links from, to, and of the passage with most outgoing ones."""
    rows = A.stored_links(spark, d)
    best = rows.groupBy("source_verse").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_verse").first()
    at = best[0] if best else ""
    one = lambda df, k: df.select(F.lit(k).alias("side"), "id", "votes")
    return one(X.from_verse(rows, at), "from").unionByName(one(X.to_verse(rows, at), "to")).unionByName(one(X.for_verse(rows, at), "any"))


def links_of_chapter(spark: SparkSession, d: str) -> DataFrame:
    """All links of the passages of the busiest chapter, ranked within each passage."""
    rows = A.stored_links(spark, d)
    p = X.parts(rows)
    best = p.groupBy("src_book", "src_ch").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "src_book", "src_ch").first()
    return X.for_chapter(rows, best[0] if best else "", best[1] if best else 0, [F.col("target_verse")])


def word_study(spark: SparkSession, d: str) -> DataFrame:
    """Lemma groups with their lexicon entries, in one testament, the group of no lemma last; then the lexicon's hits that no group has."""
    half = A.book_order(spark, d).select("book", F.when(F.col("ord") % 2 == 0, "OT").otherwise("NT").alias("testament"))
    verses = S.in_testament(L.tagged(spark, d), half, "NT")
    groups = S.lemma_groups(S.lemma_hits(verses, "gather", variants=True))
    return S.study(groups, _lexicon(spark, d), "gather").select("ord", "lemma", "hits", "gloss")


def _lexicon(spark: SparkSession, d: str) -> DataFrame:
    """A lexicon of the ids that words of five letters and more can have."""
    ids = spark.range(10 * 97, 10 * 123).select(F.concat(F.lit("H"), F.col("id").cast("string")).alias("id"), F.when(F.col("id") % 4 == 0, "to gather").otherwise(F.concat(F.lit("sense "), F.col("id").cast("string"))).alias("gloss"))
    return ids.filter(~F.col("id").endswith("3")).withColumns({"lemma": F.lower("id"), "transliteration": F.lit("x")})


def verse_entries(spark: SparkSession, d: str) -> DataFrame:
    """The lexicon's entries for the lemmas of each verse, once each."""
    return S.entries_of(L.tagged(spark, d), _lexicon(spark, d), ["seq"]).select("seq", F.col("id").alias("entry"))


def palette_results(spark: SparkSession, d: str) -> DataFrame:
    """What a short query offers: a passage it refers to, books it begins, its best verses, notes that hold it."""
    docs = A.verses(spark, d)
    index = S.postings(docs, "seq", "text")
    out = None
    for q in ("John 3:16", "jo", "covenant", "click 1"):
        rows = V.palette(q, docs, index, A.annotations(spark, d)).filter("kind <> 'verse'").withColumn("query", F.lit(q))
        out = rows if out is None else out.unionByName(rows)
    return out.select("query", "ord", "kind", "key")


def palette_verses(spark: SparkSession, d: str) -> DataFrame:
    """The five best verses of a query from three letters on."""
    docs = A.verses(spark, d)
    return V.palette("shepherd", docs, S.postings(docs, "seq", "text"), A.annotations(spark, d)).filter("kind = 'verse'").select("key")


def kept_index(spark: SparkSession, d: str) -> DataFrame:
    """The stored index's terms: built, found again, and built anew after the verses changed."""
    path = scratch(spark, "index")
    docs = A.verses(spark, d)
    V.stored_index(spark, path, docs)
    same = V.stored_index(spark, path, docs)
    new = V.stored_index(spark, path, docs.filter("seq % 2 = 0"))
    count = lambda df, k: df.groupBy("term").agg(F.sum("tf").alias("tf")).withColumn("version", F.lit(k))
    return count(same, "same").unionByName(count(new, "new"))


def dispatched_queries(spark: SparkSession, d: str) -> DataFrame:
    """Which search a query gets, over which translations."""
    cases = [("h07225", ["en"]), ("H123456", ["en"]), ("g1", ["de"]), ("word", ["de", "en"]), ("word", ["de"])]
    rows = [(i, q, *(lambda kind, over: (kind, " ".join(over)))(*S.dispatch(q, sel, ["en", "la"]))) for i, (q, sel) in enumerate(cases)]
    modes = spark.createDataFrame([(i, m) for i, m in enumerate(["lexicon", "fulltext", "concordance", None, "x"])], "i int, mode string")
    return spark.createDataFrame(rows, "i int, query string, kind string, over string").join(modes.select("i", V.current_mode(F.col("mode")).alias("mode")), "i")


def neighbourhood_nodes(spark: SparkSession, d: str) -> DataFrame:
    """What a bounded search finds within two hops of the busiest passage, with entities as leaves: nodes and edges, and whether it was cut off."""
    nodes, edges, cut_off = _neighbourhood(spark, d, 10_000)
    n = nodes.groupBy("kind", "hop").agg(F.count("*").alias("n"))
    e = edges.groupBy(F.col("category").alias("kind")).agg(F.count("*").alias("n")).withColumn("hop", F.lit(-1))
    return n.unionByName(e).withColumn("cut_off", F.lit(cut_off))


def neighbourhood_capped(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty nodes: outgoing links by place before incoming ones, then entities."""
    nodes, _, cut_off = _neighbourhood(spark, d, 20)
    return nodes.select("node", "hop", "ord").withColumn("cut_off", F.lit(cut_off))


def _neighbourhood(spark: SparkSession, d: str, most: int) -> tuple[DataFrame, DataFrame, bool]:
    rows = A.stored_links(spark, d).withColumns({"type": F.when(F.col("votes") > 25, "theme").otherwise("keyword"), "seq": F.xxhash64("id")}).withColumn("seq", F.col("votes"))
    best = rows.groupBy("source_verse").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_verse").first()
    seed = best[0] if best else ""
    # every passage mentions its supplier as a person and its line as a place
    mentions = rows.select(F.col("source_verse").alias("osis_id")).distinct().select("osis_id", F.explode(F.array(F.struct(F.lit("person").alias("kind"), F.split_part("osis_id", F.lit("."), F.lit(2)).alias("entity_id")), F.struct(F.lit("place").alias("kind"), F.split_part("osis_id", F.lit("."), F.lit(3)).alias("entity_id")))).alias("m")).select("osis_id", "m.*", F.lit(0).alias("seq"))
    return G.neighbourhood(rows, mentions, seed, 2, most, types=("theme",))


def kept_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The matrix of books, written once and read twice: each book's links out and in."""
    m = G.kept_matrix(A.links(spark, d))
    out, into = m.groupBy(F.col("src_book").alias("book")).agg(F.sum("edges").alias("out")), m.groupBy(F.col("tgt_book").alias("book")).agg(F.sum("edges").alias("in"))
    return out.join(into, "book", "full_outer").select("book", F.coalesce("out", F.lit(0)).alias("out"), F.coalesce("in", F.lit(0)).alias("in"))


def fallback_graph(spark: SparkSession, d: str) -> DataFrame:
    """The graph drawn where there are no links yet: each book with the next, and seeded chords."""
    return G.fallback(A.books(spark, d).select("book", "ord"), seed=7)


def tree_drawing(spark: SparkSession, d: str) -> DataFrame:
    """Regions, nations and customers' market segments as a tree on rows and columns."""
    return N.layout(_tree(spark, d)).select("node", "depth", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), "leaf")


def tree_rail(spark: SparkSession, d: str) -> DataFrame:
    """The first generations of the tree with the branch that each inherits."""
    branches = table(spark, d, "region").select(F.col("r_name").alias("node"), F.concat(F.lit("b"), "r_regionkey").alias("branch")).unionByName(spark.createDataFrame([("world", "root")], "node string, branch string"))
    return N.rail(_tree(spark, d), branches)


def _tree(spark: SparkSession, d: str) -> DataFrame:
    from stemma.operators.hierarchy import hierarchy

    n, r = table(spark, d, "nation"), table(spark, d, "region")
    links = r.select(F.col("r_name").alias("node"), F.lit("world").alias("parent")).unionByName(n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.concat(F.lit("n:"), "n_name").alias("node"), F.col("r_name").alias("parent")))
    deep = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("k")).join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("s:"), "n_name").alias("node"), F.concat(F.lit("n:"), "n_name").alias("parent"))
    return hierarchy(links.unionByName(deep))


def supplement_rows(spark: SparkSession, d: str) -> DataFrame:
    """Links of another source between persons whose ids both ends have; kinds that aren't allowed go."""
    rel = table(spark, d, "relationship").select(F.col("person_from").alias("source"), F.col("person_to").alias("target"), "type", "seq")
    ids = table(spark, d, "lineage_head").select(F.col("person_id").alias("external_id"), F.concat(F.lit("x-"), "person_id").alias("id")).distinct()
    every = rel.select(F.col("target").alias("external_id")).filter("external_id is not null").distinct().select("external_id", F.concat(F.lit("y-"), "external_id").alias("id"))
    known = ids.unionByName(every.join(ids.select("external_id"), "external_id", "left_anti"))
    return N.without_divine(N.supplement_links(rel, known, {"father-of": "father-of", "mother-of": "mother-of", "spouse-of": "spouse-of"}), ("y-nobody",))


def named_descent(spark: SparkSession, d: str) -> DataFrame:
    """Whom labels 'Name (son of Parent)' mean: the person of the base name, whose parent must agree where one is named."""
    links = table(spark, d, "relationship").select("id", "person_from", "person_to", "type", "seq").filter("person_from is not null and person_to is not null")
    known = N.parents(links).select(F.col("child").alias("id"), T.name_from_id(F.col("child")).alias("name"), T.name_from_id(F.col("parent")).alias("parent_name"))
    labels = known.select("id", F.concat("name", F.lit(" (son of "), F.when(F.length("id") % 3 == 0, F.lit("Nobody")).otherwise(F.col("parent_name")), F.lit(")")).alias("label"))
    return N.match_names(labels, known).groupBy("id").agg(F.count("person_id").alias("matches"))


def verse_markup(spark: SparkSession, d: str) -> DataFrame:
    """Verses as HTML: the words of a name marked, within and across a quoted stretch, everything else escaped."""
    v = A.verses(spark, d).filter("text is not null").select("seq", "text", F.array(F.struct(F.lit(4).alias("start"), F.lit(30).alias("end"))).alias("quoted"))
    return v.select("seq", F.md5(T.verse_html(F.col("text"), ["the covenant", "covenant", "river"], F.col("quoted"))).alias("digest"))


def last_visits(spark: SparkSession, d: str) -> DataFrame:
    """The last six kinds of events of each user, without consecutive repeats."""
    e = table(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("at"), "event_type")
    return G.visits(e, "user_id", "at", "event_type", kept=6).select("user_id", "rank", "event_type")


def crumbs(spark: SparkSession, d: str) -> DataFrame:
    """Long paths with their middle left out."""
    p = table(spark, d, "person").select("seq", F.filter("verse_refs", lambda r: r.isNotNull()).alias("path")).filter("path is not null")
    return p.select("seq", F.array_join(V.breadcrumb(F.col("path")), ">").alias("crumbs"))


def selected_verses(spark: SparkSession, d: str) -> DataFrame:
    """A selection with a range added, as sorted numbers."""
    c = table(spark, d, "ref_counts")
    picked = F.array((F.col("verses") % 7 + 1).cast("int"), F.col("verses").cast("int"))
    return c.select("book", "chapter", F.array_join(F.transform(store.sorted_union(picked, (F.col("chapter") % 5 + 4).cast("int"), F.lit(3)), lambda n: n.cast("string")), " ").alias("selected"))


def added_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags after names were added: trimmed, lower case, only where they are new."""
    tags = table(spark, d, "events").select(F.col("event_type").alias("name")).distinct()
    names = table(spark, d, "nation").select(F.concat(F.lit("  "), "n_name", F.lit(" ")).alias("name")).unionByName(tags.select(F.upper("name").alias("name"))).unionByName(spark.createDataFrame([("  ",), (None,)], "name string"))
    return V.add_missing(tags, names)


def saved_searches(spark: SparkSession, d: str) -> DataFrame:
    """Saved searches: the last of a name replaces what was saved; retired modes are read as the one that took their place."""
    e = table(spark, d, "events").select(F.col("event_type").alias("name"), "event_id", F.when(F.col("event_id") % 2 == 0, "lexicon").otherwise("fulltext").alias("mode"))
    empty = e.select("name", "event_id", "mode").limit(0)
    return store.upsert(empty, e, ["name"], ["event_id"]).select("name", "event_id", V.current_mode(F.col("mode")).alias("mode"))


QUERIES = {
    f.__name__: f
    for f in (
        filled_tables, keyed_rows, tagged_annotations, upserted_customers, settings_rows, migrated_store, links_of_verse, links_of_chapter, word_study, verse_entries, palette_results, palette_verses, kept_index,
        dispatched_queries, neighbourhood_nodes, neighbourhood_capped, kept_matrix, fallback_graph, tree_drawing, tree_rail, supplement_rows, named_descent, verse_markup, last_visits, crumbs, selected_verses, added_tags, saved_searches,
    )
}

_W = f"with {A.LINKS}"
_BEST = "(select source_verse from links group by 1 order by count(*) desc, 1 limit 1)"
_TREE = """with t as (select 'world' node, 0 depth, ['world'] path, null parent union all select r_name, 1, ['world', r_name], 'world' from region
  union all select 'n:' || n_name, 2, ['world', r_name, 'n:' || n_name], r_name from nation join region on r_regionkey = n_regionkey
  union all select distinct 's:' || n_name, 3, ['world', r_name, 'n:' || n_name, 's:' || n_name], 'n:' || n_name from supplier join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey)"""
_NAME = r"array_to_string(list_transform(string_split(regexp_replace(%s, '_\d+$', ''), '_'), lambda p: upper(p[1]) || p[2:]), ' ')"
_NORM = r"trim(regexp_replace(regexp_replace(trim(lower(%s)), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"
SQL = {
    "filled_tables": "select 'person' \"name\", count(*) > 0 seeded, count(*) n from person union all select 'place', count(*) > 0, count(*) from place union all select 'territory', count(*) > 0, count(*) from territory union all select 'none', false, 0",
    "keyed_rows": "select 'order' kind, o_orderkey::varchar \"key\", o_custkey::varchar \"value\" from orders where o_orderkey = 7 union all select 'source', source_id, \"domain\" from source_registry where source_id = 'lampstand'",
    "tagged_annotations": f"with {A.ANNOTATIONS}, x as (select event_id, case when event_id % 2 = 0 then 'theme' else 'note' end \"type\", slug from ann) select * from x where slug = 'click' and \"type\" = 'theme' or slug = 'view' and \"type\" = 'note'",
    "upserted_customers": """with n as (select c_custkey k, upper(c_name) c_name from customer where c_custkey % 5 = 0), p as (select c_custkey, c_name, 0 version from customer where c_custkey % 5 <> 0 union all select k, c_name, 2 from n union all select -k, c_name, 2 from n where k <> 0)
select c_custkey, c_name, version::bigint "version" from p where not (c_custkey >= 0 and c_custkey % 7 = 0)""",
    "settings_rows": "select n_name theme, 12 size, 'en' lang, 'stored' \"of\" from nation where n_nationkey = 3 union all select 'plain', 12, 'en', 'none'",
    "migrated_store": "select n_nationkey, lower(n_name) || '!' n_name, 4 \"version\" from nation",
    "links_of_verse": f"{_W} select 'from' side, id, votes from links where source_verse = {_BEST} union all select 'to', id, votes from links where target_verse = {_BEST} union all select 'any', id, votes from links where source_verse = {_BEST} or target_verse = {_BEST}",
    "links_of_chapter": f"{_W}, b as (select sb, sc from parts group by all order by count(*) desc, sb, sc limit 1) select id, source_verse, target_verse, votes, row_number() over (partition by source_verse order by votes desc, target_verse)::int as rank from parts join b using (sb, sc)",
    "dispatched_queries": "select * from (values (0, 'h07225', 'id', 'en', 'concordance'), (1, 'H123456', 'lemma', 'en', 'fulltext'), (2, 'g1', 'id', 'en la', 'concordance'), (3, 'word', 'lemma', 'en', null), (4, 'word', 'flat', 'de', 'x')) t(i, query, kind, \"over\", \"mode\")",
    "palette_results": f"""with {A.ANNOTATIONS} select 'John 3:16' query, 0 ord, 'reference' kind, 'John.3.16' as "key" union all select 'jo', 1, 'book', k from (values ('Josh'), ('Job'), ('Joel')) t(k)
union all (select 'click 1', 3, 'note', event_id::varchar from ann where contains(lower("label"), 'click 1') order by event_id limit 3) union all (select 'jo', 3, 'note', event_id::varchar from ann where contains(lower("label"), 'jo') order by event_id limit 3)
union all (select 'covenant', 3, 'note', event_id::varchar from ann where contains(lower("label"), 'covenant') order by event_id limit 3)""",
    "neighbourhood_nodes": f"""{_W}, l as (select * from links where votes > 25), s as (select {_BEST} v), m as (select distinct source_verse v, 'person:' || split_part(source_verse, '.', 2) e, 'person' kind from links union select distinct source_verse, 'place:' || split_part(source_verse, '.', 3), 'place' from links),
h1 as (select distinct case when source_verse = v then target_verse else source_verse end v from l, s where (source_verse = v or target_verse = v)), n0 as (select v, 0 hop from s), n1 as (select v, 1 hop from h1 where v not in (select v from s)),
h2 as (select distinct case when source_verse = n1.v then target_verse else source_verse end v from l join n1 on source_verse = n1.v or target_verse = n1.v), n2 as (select v, 2 hop from h2 where v not in (select v from n0 union select v from n1)),
vs as (select * from n0 union all select * from n1 union all select * from n2), e1 as (select distinct e, kind from m join n0 using (v)), e2 as (select distinct e, kind from m join n1 using (v)),
es as (select e, kind, 1 hop from e1 union all select e, kind, 2 from e2 where e not in (select e from e1)),
le as (select distinct id from l where (source_verse in (select v from n0 union select v from n1) or target_verse in (select v from n0 union select v from n1)) and source_verse in (select v from vs) and target_verse in (select v from vs)),
me as (select distinct m.v, m.e from m join (select v from n0 union select v from n1) q on q.v = m.v)
select kind, hop, count(*) n, false cut_off from (select 'verse' kind, hop from vs union all select kind, hop from es) group by all union all select 'link', -1, count(*), false from le having count(*) > 0 union all select 'mention', -1, count(*), false from me having count(*) > 0""",
    "kept_matrix": f"{_W} select coalesce(a.b, b.b) book, coalesce(a.n, 0)::bigint \"out\", coalesce(b.n, 0)::bigint \"in\" from (select sb b, count(*) n from parts group by 1) a full join (select tb b, count(*) n from parts group by 1) b on a.b = b.b",
    "tree_drawing": f"""{_TREE}, l as (select t.*, not exists (select 1 from t c where c.parent = t.node) leaf from t), y3 as (select *, case when leaf then 20 + 60 * (row_number() over (partition by leaf order by path) - 1) end y from l),
d2 as (select n.node, n.path, n.depth, n.parent, n.leaf, coalesce(n.y, (arg_min(c.y, c.path) + arg_max(c.y, c.path)) / 2) y from y3 n left join y3 c on c.parent = n.node where n.depth = 2 group by n.node, n.path, n.depth, n.parent, n.leaf, n.y),
d1 as (select n.node, n.path, n.depth, n.parent, n.leaf, coalesce(n.y, (arg_min(c.y, c.path) + arg_max(c.y, c.path)) / 2) y from y3 n left join d2 c on c.parent = n.node where n.depth = 1 group by n.node, n.path, n.depth, n.parent, n.leaf, n.y),
d0 as (select n.node, n.path, n.depth, n.parent, n.leaf, coalesce(n.y, (arg_min(c.y, c.path) + arg_max(c.y, c.path)) / 2) y from y3 n left join d1 c on c.parent = n.node where n.depth = 0 group by n.node, n.path, n.depth, n.parent, n.leaf, n.y)
select node, depth, round(20.0 + depth * 200, 3)::double x, round(y, 3)::double y, leaf from (select * from d0 union all select * from d1 union all select * from d2 union all select node, path, depth, parent, leaf, y from y3 where depth = 3)""",
    "tree_rail": f"{_TREE} select node, depth, case when depth = 0 then 'root' else 'b' || r_regionkey end branch, (['focused', 'son', 'grandson'])[depth + 1] relation, row_number() over (order by path)::int ord from t left join region on r_name = path[2] where depth <= 2",
    "supplement_rows": """with r as (select person_from s, person_to t, lower(trim("type")) k, seq from relationship), x as (select distinct person_id e from lineage_head), y as (select distinct person_to e from relationship where person_to is not null and person_to not in (select e from x)),
i as (select e, 'x-' || e id from x union all select e, 'y-' || e from y), j as (select a.id a, k, b.id b, seq from r join i a on a.e = s join i b on b.e = t where k in ('father-of', 'mother-of', 'spouse-of') and a.id <> b.id),
z as (select case when k = 'spouse-of' then least(a, b) || '→' || k || '→' || greatest(a, b) else a || '→' || k || '→' || b end id, a person_from, b person_to, k "type", seq from j)
select id, person_from, person_to, "type" from z where person_from <> 'y-nobody' and person_to <> 'y-nobody' qualify row_number() over (partition by id order by seq) = 1""",
    "last_visits": """with e as (select user_id, ts, event_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) b from events), m as (select * from e where event_type is distinct from b)
select user_id, row_number() over (partition by user_id order by ts desc, event_id desc)::int as rank, event_type from m qualify rank <= 6""",
    "crumbs": "with p as (select seq, list_filter(verse_refs, lambda r: r is not null) r from person where verse_refs is not null) select seq, case when len(r) > 7 then r[1] || '>…>' || array_to_string(r[-5:], '>') else array_to_string(r, '>') end crumbs from p",
    "selected_verses": "select book, chapter, array_to_string(list_sort(list_distinct([(verses % 7 + 1)::int, verses::int] || range(3, (chapter % 5 + 5)::int)::int[])), ' ') selected from ref_counts",
    "added_tags": "select distinct event_type \"name\" from events union select lower(n_name) from nation",
    "saved_searches": "select event_type \"name\", max(event_id) event_id, case when max(event_id) % 2 = 0 then 'concordance' else 'fulltext' end \"mode\" from events group by 1",
}
_LEX = "lex as (select 'H' || i id, case when i % 4 = 0 then 'to gather' else 'sense ' || i end gloss from range(970, 1230) t(i) where not ends_with(i::varchar, '3'))"
SQL["word_study"] = rf"""with {A.VERSES}, {A.BOOK_ORDER}, {L.TAGGED}, {_LEX}, h as (select * from long join book_order on book = split_part(osis_id, '.', 1) where ord % 2 = 1 and regexp_full_match(s, 'gathere?(?:s|d|th|ing|eth|est|er|ers|ieth|ied|ies|y)?')),
g as (select id, count(*) hits from h group by 1), u as (select 0 part, g.id lemma, hits, gloss from g left join lex using (id) union all select 1, id, 0, gloss from lex where contains(gloss, 'gather') and id not in (select id from g))
select row_number() over (order by part, lemma is null, hits desc, lemma)::int ord, lemma, hits, gloss from u"""
SQL["verse_entries"] = f"with {A.VERSES}, {L.TAGGED}, {_LEX} select distinct seq, id entry from long join lex using (id)"
SQL["named_descent"] = rf"""with rel as (select * from relationship where person_from is not null and person_to is not null), f as (select person_to id, coalesce(arg_min(person_from, (seq, person_from)) filter (where "type" = 'father-of'), arg_min(person_from, (seq, person_from)) filter (where "type" = 'mother-of')) pa from rel where "type" in ('father-of', 'mother-of') group by 1),
k as (select id, lower(trim({_NAME % 'id'})) n, lower(trim({_NAME % 'pa'})) p from f), c as (select n, p, count(*) m from k group by all) select id, case when length(id) % 3 = 0 then 0 else m end matches from k join c using (n, p)"""
SQL["fallback_graph"] = f"""with {A.BOOKS}, k as (select count(*) n from books), d as (select ord, c, s, (7 + (ord * 4 + 2 * c + s)::hugeint * 1831565813) & 4294967295 a from books, range(0, 2) t(c), range(1, 3) q(s)),
t as (select *, (xor(a, a >> 15) * (a | 1)) & 4294967295 t from d), u as (select *, xor((t + ((xor(t, t >> 7) * (t | 61)) & 4294967295)) & 4294967295, t) u from t), r as (select ord, c, s, xor(u, u >> 14)::double / 4294967296 r from u),
e as (select a.ord o, floor(a.r * n)::int t, (floor(b.r * 20) + 1)::int w from r a join r b on a.ord = b.ord and a.c = b.c and a.s = 1 and b.s = 2, k union all select ord, (ord + 1) % n, 5 from books, k),
p as (select least(o, t) i, greatest(o, t) j, max(w) w from e where o <> t group by all) select x.book a, y.book b, w weight from p join books x on x.ord = i join books y on y.ord = j"""
