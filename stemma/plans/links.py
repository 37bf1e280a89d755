"""Queries over links between passages, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.operators import crossrefs as X
from stemma.operators import graph as G
from stemma.plans import adapters as A
from stemma.util import table

NARRATIVES = (("N1", "N2", "N3"), ("N18", "N19", "N20", "N21"))


def book_matrix(spark: SparkSession, d: str) -> DataFrame:
    return X.book_matrix(A.links(spark, d))


def symmetric_adjacency(spark: SparkSession, d: str) -> DataFrame:
    return X.adjacency(X.book_matrix(A.links(spark, d)))


def book_degrees(spark: SparkSession, d: str) -> DataFrame:
    return X.degrees(symmetric_adjacency(spark, d))


def top_hubs(spark: SparkSession, d: str) -> DataFrame:
    """The six books with most neighbours, the heavier first."""
    return book_degrees(spark, d).orderBy(F.desc("degree"), F.desc("weight"), "book").limit(6)


def strongest_links(spark: SparkSession, d: str) -> DataFrame:
    """Seven strongest partners of each book."""
    return X.strongest_per_book(symmetric_adjacency(spark, d))


def drawn_edges(spark: SparkSession, d: str) -> DataFrame:
    """The 300 strongest pairs with their opacity, and whether they cross the testaments."""
    pairs = symmetric_adjacency(spark, d)
    b = A.books(spark, d).select("book", "part")
    top = pairs.orderBy(F.desc("weight"), "a", "b").limit(300)
    top = top.join(b.select(F.col("book").alias("a"), F.col("part").alias("pa")), "a").join(b.select(F.col("book").alias("b"), F.col("part").alias("pb")), "b")
    most = top.agg(F.max("weight").alias("most"))
    return top.join(F.broadcast(most)).select("a", "b", "weight", (F.col("pa") != F.col("pb")).alias("crosses"), F.round(F.sqrt(F.col("weight") / F.col("most")), 6).alias("opacity"))


def chapter_connections(spark: SparkSession, d: str) -> DataFrame:
    return X.chapter_connections(A.links(spark, d), "N3")


def links_from_book(spark: SparkSession, d: str) -> DataFrame:
    return X.from_book(A.links(spark, d), "N1")


def links_to_book(spark: SparkSession, d: str) -> DataFrame:
    return X.to_book(A.links(spark, d), "N1")


def links_for_supplier_verse(spark: SparkSession, d: str) -> DataFrame:
    """Links of one passage in either direction: the passage with the most outgoing links."""
    rows = A.stored_links(spark, d)
    best = rows.groupBy("source_verse").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_verse").limit(1).select(F.col("source_verse").alias("v"))
    out = rows.join(F.broadcast(best), F.col("source_verse") == F.col("v"))
    into = rows.join(F.broadcast(best), F.col("target_verse") == F.col("v")).filter("source_verse <> target_verse")
    return out.unionByName(into).drop("v")


def links_between_books(spark: SparkSession, d: str) -> DataFrame:
    return X.between_books(A.links(spark, d), "N4", "N7")


def chapter_links_top5(spark: SparkSession, d: str) -> DataFrame:
    """The five links with most votes of each passage."""
    from pyspark.sql import Window

    w = Window.partitionBy("source_verse").orderBy(F.desc("votes"), "target_verse")
    return A.links(spark, d).withColumn("rank", F.row_number().over(w)).filter("rank <= 5")


def dedupe_first_wins(spark: SparkSession, d: str) -> DataFrame:
    return A.links(spark, d)


def _classified(spark: SparkSession, d: str) -> DataFrame:
    rows = X.parts(overlay_lookup(spark, d))
    b = A.books(spark, d).select("book", "part")
    rows = rows.join(b.select(F.col("book").alias("src_book"), F.col("part").alias("src_part")), "src_book", "left").join(b.select(F.col("book").alias("tgt_book"), F.col("part").alias("tgt_part")), "tgt_book", "left")
    c = F.col
    return rows.withColumn("type", X.classify(c("votes"), c("src_book"), c("tgt_book"), c("src_ch"), c("tgt_ch"), c("src_part"), c("tgt_part"), c("overlay"), NARRATIVES))


def classify_edges(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d).select("id", "type")


def classification_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return X.breakdown(_classified(spark, d)).select("type", "edges", F.round("share", 6).alias("share"), F.round("avg_votes", 6).alias("avg_votes"), "min_votes", "max_votes")


def _overlays(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Invented overlays: the links with most votes by verse, some others by chapter, typed by their votes."""
    kind = lambda n: F.element_at(F.array(*map(F.lit, X.OVERLAY_PRIORITY)), n.cast("int"))
    verse = rows.filter("votes >= 48").select(F.col("source_verse").alias("src"), F.col("target_verse").alias("tgt"), kind(F.col("votes") - 47).alias("type"))
    key = lambda c: F.concat_ws(".", X.book_of(F.col(c)), F.split_part(c, F.lit("."), F.lit(2)))
    chapter = rows.filter("votes between 13 and 16").select(key("source_verse").alias("src"), key("target_verse").alias("tgt"), kind(F.col("votes") - 12).alias("type"))
    return verse, chapter


def overlay_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = A.stored_links(spark, d)
    return X.with_overlay(rows, *_overlays(rows))


def overlay_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs within passage groups: each order's line items as a group."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("group_id"), F.col("l_suppkey"), F.col("l_linenumber").alias("ord")).distinct()
    m = li.join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.concat(F.lit("N"), "s_nationkey").alias("book")), "l_suppkey").join(A.books(spark, d).select("book", "part"), "book")
    first = m.groupBy("group_id", "ord").agg(F.min_by(F.struct("l_suppkey", "book", "part"), "l_suppkey").alias("x")).select("group_id", "ord", F.concat_ws(".", "x.book", "x.l_suppkey", "ord").alias("osis"), "x.part")
    return X.group_pairs(first)


def bfs_two_hops(spark: SparkSession, d: str) -> DataFrame:
    """Passages within two hops of the busiest passage of a book, with their distance."""
    rows = A.stored_links(spark, d)
    seed = rows.groupBy("source_verse").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_verse").limit(1).select(F.col("source_verse").alias("node"))
    return G.reach(rows.select(F.col("source_verse").alias("a"), F.col("target_verse").alias("b")), seed, 2)


def ring_layout(spark: SparkSession, d: str) -> DataFrame:
    """Angle and radius of each book on the ring."""
    n = table(spark, d, "ref_counts").groupBy("book").agg(F.max("chapter").alias("chapters"))
    b = n.join(A.book_order(spark, d).select("book", "ord"), "book").withColumn("section", F.floor(F.col("ord") / 8).cast("int"))
    return G.ring(b).select("book", F.round("angle", 6).alias("angle"), F.round("r", 6).alias("r"))


QUERIES = {
    f.__name__: f
    for f in (
        book_matrix, symmetric_adjacency, book_degrees, top_hubs, strongest_links, drawn_edges, chapter_connections, links_from_book, links_to_book, links_for_supplier_verse, links_between_books,
        chapter_links_top5, dedupe_first_wins, classify_edges, classification_breakdown, overlay_lookup, overlay_pairs, bfs_two_hops, ring_layout,
    )
}

_W = f"with {A.LINKS}, {A.BOOKS}"
_ADJ = ", adj as (select least(sb, tb) a, greatest(sb, tb) b, count(*) weight from parts where sb <> tb group by all having count(*) >= 5), two as (select a, b, weight from adj union all select b, a, weight from adj), deg as (select a book, count(*) degree, sum(weight)::bigint weight from two group by 1)"
_BEST = "(select source_verse from links group by 1 order by count(*) desc, 1 limit 1)"
_KIND = "(['quotation', 'allusion', 'parallel', 'possible_allusion'])"
_OVER = f""", ov as (select source_verse src, target_verse tgt, votes - 48 k from links where votes >= 48),
oc as (select sb || '.' || sc src, tb || '.' || tc tgt, votes - 13 k from parts where votes between 13 and 16),
bv as (select src, tgt, min(k) k from (select * from ov union all select tgt, src, k from ov) group by all),
bc as (select src, tgt, min(k) k from (select * from oc union all select tgt, src, k from oc) group by all),
over as (select p.*, {_KIND}[(case when bc.k is not null and (bv.k is null or bc.k < bv.k) then bc.k else bv.k end) + 1] overlay
  from parts p left join bv on bv.src = source_verse and bv.tgt = target_verse left join bc on bc.src = sb || '.' || sc and bc.tgt = tb || '.' || tc),
typed as (select o.*, case when overlay = 'possible_allusion' then 'allusion' when overlay is not null then overlay
  when x and votes >= 100 then 'quotation' when sb <> tb and ((sb in ('N1','N2','N3') and tb in ('N1','N2','N3')) or (sb in ('N18','N19','N20','N21') and tb in ('N18','N19','N20','N21'))) then 'parallel'
  when sb = tb and votes >= 5 and abs(sc - tc) <= 5 then 'parallel' when x and votes >= 30 then 'allusion' when x and votes >= 10 or not x and votes >= 20 then 'theme'
  when votes >= 3 then 'keyword' when x then 'theme' when sb = tb then 'parallel' else 'keyword' end "type"
  from (select over.*, (a.part = 'OT' and b.part = 'NT') or (a.part = 'NT' and b.part = 'OT') x from over join books a on a.book = sb join books b on b.book = tb) o)"""
SQL = {
    "book_matrix": f"{_W} select sb src_book, tb tgt_book, count(*) edges from parts group by all",
    "symmetric_adjacency": f"{_W}{_ADJ} select * from adj",
    "book_degrees": f"{_W}{_ADJ} select * from deg",
    "top_hubs": f"{_W}{_ADJ} select * from deg order by degree desc, weight desc, book limit 6",
    "strongest_links": f"{_W}{_ADJ} select a, b, weight, row_number() over (partition by a order by weight desc, b)::int as rank from two qualify rank <= 7",
    "drawn_edges": f"{_W}{_ADJ}, t as (select * from adj order by weight desc, a, b limit 300) select a, b, weight, x.part <> y.part crosses, round(sqrt(weight / (select max(weight) from t)), 6) opacity from t join books x on x.book = a join books y on y.book = b",
    "chapter_connections": f"""{_W}, e as (select sc chapter, 'chapter:N3.' || tc neighbor from parts where sb = 'N3' and tb = 'N3' and sc <> tc union all
  select tc, 'chapter:N3.' || sc from parts where sb = 'N3' and tb = 'N3' and sc <> tc union all
  select sc, 'book:' || tb from parts where sb = 'N3' and tb <> 'N3' union all select tc, 'book:' || sb from parts where tb = 'N3' and sb <> 'N3')
select chapter, neighbor, count(*) edges from e group by all""",
    "links_from_book": f"{_W} select * from links where source_verse like 'N1.%'",
    "links_to_book": f"{_W} select * from links where target_verse like 'N1.%'",
    "links_for_supplier_verse": f"{_W} select * from links where source_verse = {_BEST} or target_verse = {_BEST}",
    "links_between_books": f"{_W} select id, source_verse, target_verse, votes from parts where (sb = 'N4' and tb = 'N7') or (sb = 'N7' and tb = 'N4')",
    "chapter_links_top5": f"{_W} select *, row_number() over (partition by source_verse order by votes desc, target_verse)::int as rank from links qualify rank <= 5",
    "dedupe_first_wins": f"{_W} select * from links",
    "overlay_lookup": f"{_W}{_OVER} select id, source_verse, target_verse, votes, overlay from over",
    "classify_edges": f'{_W}{_OVER} select id, "type" from typed',
    "classification_breakdown": f'{_W}{_OVER} select "type", count(*) edges, round(count(*) * 100 / sum(count(*)) over (), 6) "share", round(avg(votes), 6) avg_votes, min(votes) min_votes, max(votes) max_votes from typed group by "type"',
    "overlay_pairs": f"""with {A.BOOKS}, m as (select l_orderkey g, l_linenumber o, min(l_suppkey) s from lineitem join supplier on s_suppkey = l_suppkey group by all),
k as (select g, o, book || '.' || s || '.' || o osis, part from m join supplier on s_suppkey = s join books on book = 'N' || s_nationkey),
x as (select g, bool_or(part = 'OT') and bool_or(part = 'NT') mixed from k group by g),
p as (select a.osis src, b.osis tgt, case when mixed then 'quotation' else 'parallel' end t from k a join k b on a.g = b.g and a.o < b.o join x on x.g = a.g
  where not mixed or (a.part || b.part in ('OTNT', 'NTOT')))
select distinct src, tgt, t "type" from (select * from p union all select tgt, src, t from p)""",
    "bfs_two_hops": f"""{_W}, two as (select source_verse a, target_verse b from links union select target_verse, source_verse from links),
h as (select {_BEST} node, 0 hop union all select b, 1 from two where a = {_BEST} union all select y.b, 2 from two x join two y on x.b = y.a where x.a = {_BEST})
select node, min(hop) hop from h group by node""",
    "ring_layout": f"""with {A.BOOK_ORDER}, s as (select *, ord // 8 section from book_order), k as (select count(*) n, count(distinct section) g from s)
select book, round(-90 + 5.2 / 2 + (ord + 0.5) * ((360 - 5.2 * g) / n) + section * 5.2, 6) angle, round(6 + 1.5 * sqrt(chapters), 6) r from s, k""",
}
