"""Directed links between keyed passages: matrices, roll-ups, typed classification, lookups.

A links table has source_verse, target_verse (Book.chapter.verse), votes, and what
else it likes. ``parts`` materialises the parts of both keys, so that filters by
book or chapter are equalities that Parquet statistics can serve.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The overlay types by falling priority.
OVERLAY_PRIORITY = ("quotation", "allusion", "parallel", "possible_allusion")


def book_of(osis: Column) -> Column:
    return F.split_part(osis, F.lit("."), F.lit(1))


def chapter_of(osis: Column) -> Column:
    return F.split_part(osis, F.lit("."), F.lit(2)).try_cast("int")


def parts(links: DataFrame) -> DataFrame:
    """links with src_book, src_ch, tgt_book, tgt_ch."""
    s, t = F.col("source_verse"), F.col("target_verse")
    return links.withColumns({"src_book": book_of(s), "src_ch": chapter_of(s), "tgt_book": book_of(t), "tgt_ch": chapter_of(t)})


def book_matrix(links: DataFrame) -> DataFrame:
    """src_book, tgt_book, edges; links within a book included. One map-side count and one small shuffle."""
    return links.select(book_of(F.col("source_verse")).alias("src_book"), book_of(F.col("target_verse")).alias("tgt_book")).groupBy("src_book", "tgt_book").agg(F.count("*").alias("edges"))


def adjacency(matrix: DataFrame, min_weight: int = 5) -> DataFrame:
    """a, b, weight of unordered pairs of different books, both directions added, from ``min_weight``."""
    a, b = F.least("src_book", "tgt_book"), F.greatest("src_book", "tgt_book")
    pairs = matrix.filter("src_book <> tgt_book").groupBy(a.alias("a"), b.alias("b")).agg(F.sum("edges").alias("weight"))
    return pairs.filter(F.col("weight") >= min_weight)


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b", "weight").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))


def degrees(pairs: DataFrame) -> DataFrame:
    return both_ways(pairs).groupBy(F.col("a").alias("book")).agg(F.count("*").alias("degree"), F.sum("weight").alias("weight"))


def strongest_per_book(pairs: DataFrame, n: int = 7) -> DataFrame:
    w = Window.partitionBy("a").orderBy(F.desc("weight"), "b")
    return both_ways(pairs).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def chapter_connections(links: DataFrame, book: str) -> DataFrame:
    """chapter, neighbor, edges of one book: other chapters of it as chapter:Book.c, other books as book:Book; links within a chapter don't count.

    A link between two chapters of the book counts on both sides, one with another book once.
    """
    p = parts(links).filter((F.col("src_book") == book) | (F.col("tgt_book") == book))
    inside = (F.col("src_book") == book) & (F.col("tgt_book") == book)
    chapter = lambda c: F.concat(F.lit(f"chapter:{book}."), c.cast("string"))
    ends = F.when(
        inside & (F.col("src_ch") != F.col("tgt_ch")),
        F.array(F.struct(F.col("src_ch").alias("chapter"), chapter(F.col("tgt_ch")).alias("neighbor")), F.struct(F.col("tgt_ch").alias("chapter"), chapter(F.col("src_ch")).alias("neighbor"))),
    ).when(inside, F.array()).when(
        F.col("src_book") == book, F.array(F.struct(F.col("src_ch").alias("chapter"), F.concat(F.lit("book:"), "tgt_book").alias("neighbor")))
    ).otherwise(F.array(F.struct(F.col("tgt_ch").alias("chapter"), F.concat(F.lit("book:"), "src_book").alias("neighbor"))))
    return p.select(F.explode(ends).alias("e")).groupBy("e.chapter", "e.neighbor").agg(F.count("*").alias("edges"))


def from_book(links: DataFrame, book: str) -> DataFrame:
    """The dot keeps books apart whose names start alike."""
    return links.filter(F.col("source_verse").startswith(book + "."))


def to_book(links: DataFrame, book: str) -> DataFrame:
    return links.filter(F.col("target_verse").startswith(book + "."))


def from_verse(links: DataFrame, osis: str) -> DataFrame:
    return links.filter(F.col("source_verse") == osis)


def to_verse(links: DataFrame, osis: str) -> DataFrame:
    return links.filter(F.col("target_verse") == osis)


def for_verse(links: DataFrame, osis: str) -> DataFrame:
    """In either direction, each link once."""
    return links.filter((F.col("source_verse") == osis) | (F.col("target_verse") == osis))


def between_books(links: DataFrame, a: str, b: str) -> DataFrame:
    s, t = F.col("source_verse"), F.col("target_verse")
    return links.filter((s.startswith(a + ".") & t.startswith(b + ".")) | (s.startswith(b + ".") & t.startswith(a + ".")))


def for_chapter(links: DataFrame, book: str, chapter: int, order: list[Column], top: int | None = None) -> DataFrame:
    """The chapter's outgoing links, ranked by votes within their source verse; the first ``top`` of each, or all."""
    w = Window.partitionBy("source_verse").orderBy(F.desc("votes"), *order)
    ranked = links.filter(F.col("source_verse").startswith(f"{book}.{chapter}.")).withColumn("rank", F.row_number().over(w))
    return ranked.filter(F.col("rank") <= top) if top else ranked


def overlay_best(overlay: DataFrame) -> DataFrame:
    """src, tgt, type: the strongest type of each directed key, with the reverse of every pair added."""
    rank = F.array_position(F.array(*map(F.lit, OVERLAY_PRIORITY)), F.col("type"))
    both = overlay.select("src", "tgt", "type").unionByName(overlay.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"), "type"))
    return both.withColumn("rank", rank).filter("rank > 0").groupBy("src", "tgt").agg(F.min_by("type", "rank").alias("type"), F.min("rank").alias("rank"))


def with_overlay(links: DataFrame, verse_pairs: DataFrame, chapter_pairs: DataFrame) -> DataFrame:
    """links with overlay: of the type of the verse pair and that of the chapter pair the stronger; a tie is the verse pair's."""
    key = lambda c: F.concat_ws(".", book_of(c), F.split_part(c, F.lit("."), F.lit(2)))
    v = overlay_best(verse_pairs).select(F.col("src").alias("source_verse"), F.col("tgt").alias("target_verse"), F.col("type").alias("v_type"), F.col("rank").alias("v_rank"))
    c = overlay_best(chapter_pairs).select(F.col("src").alias("c_src"), F.col("tgt").alias("c_tgt"), F.col("type").alias("c_type"), F.col("rank").alias("c_rank"))
    joined = links.withColumns({"c_src": key(F.col("source_verse")), "c_tgt": key(F.col("target_verse"))}).join(v, ["source_verse", "target_verse"], "left").join(c, ["c_src", "c_tgt"], "left")
    chapter_wins = F.col("c_rank").isNotNull() & (F.col("v_rank").isNull() | (F.col("c_rank") < F.col("v_rank")))
    return joined.select(*links.columns, F.when(chapter_wins, F.col("c_type")).otherwise(F.col("v_type")).alias("overlay"))


def classify(votes: Column, src_book: Column, tgt_book: Column, src_ch: Column, tgt_ch: Column, src_part: Column, tgt_part: Column, overlay: Column, narratives: Collection[Collection[str]]) -> Column:
    """The type of a link, first rule that holds.

    An overlay type decides. Then by votes: across the two testaments (parts 'OT' and 'NT')
    100 a quotation; different books of one group of ``narratives`` are parallel, as are chapters of one
    book at most 5 apart from 5 votes; across 30 an allusion, 10 a theme; else 20 a theme; 3 a keyword. Below that:
    across a theme, within a book parallel, else a keyword.
    """
    across = F.coalesce(((src_part == "OT") & (tgt_part == "NT")) | ((src_part == "NT") & (tgt_part == "OT")), F.lit(False))
    told_twice = F.lit(False)
    for group in narratives:
        told_twice = told_twice | (src_book.isin(*group) & tgt_book.isin(*group))
    same = src_book == tgt_book
    return (
        F.when(overlay.isin("quotation", "allusion", "parallel"), overlay)
        .when(overlay == "possible_allusion", "allusion")
        .when(across & (votes >= 100), "quotation")
        .when(~same & told_twice, "parallel")
        .when(same & (votes >= 5) & (F.abs(src_ch - tgt_ch) <= 5), "parallel")
        .when(across & (votes >= 30), "allusion")
        .when(F.when(across, votes >= 10).otherwise(votes >= 20), "theme")
        .when(votes >= 3, "keyword")
        .when(across, "theme")
        .when(same, "parallel")
        .otherwise("keyword")
    )


def breakdown(classified: DataFrame) -> DataFrame:
    """type, edges, share in per cent, and the votes' average, least and most."""
    total = F.sum("edges").over(Window.partitionBy())  # a handful of rows by then
    by = classified.groupBy("type").agg(F.count("*").alias("edges"), F.avg("votes").alias("avg_votes"), F.min("votes").alias("min_votes"), F.max("votes").alias("max_votes"))
    return by.withColumn("share", F.col("edges") * 100 / total)


def group_pairs(groups: DataFrame) -> DataFrame:
    """src, tgt, type of the members (group_id, ord, osis, part) of passage groups, both directions.

    In a group with both testaments each old member pairs with each new one, as a quotation; in any other each
    pair is parallel. Groups are short lists by nature; the join is within a group, earlier with later members.
    """
    sides = groups.groupBy("group_id").agg(F.max((F.col("part") == "OT").cast("int")).alias("ot"), F.max((F.col("part") == "NT").cast("int")).alias("nt"))
    m = groups.join(sides.withColumn("mixed", (F.col("ot") == 1) & (F.col("nt") == 1)).select("group_id", "mixed"), "group_id")
    a = m.select("group_id", "mixed", F.col("ord").alias("oa"), F.col("osis").alias("src"), F.col("part").alias("pa"))
    b = m.select("group_id", F.col("ord").alias("ob"), F.col("osis").alias("tgt"), F.col("part").alias("pb"))
    hits = a.join(b, "group_id").filter((F.col("oa") < F.col("ob")) & (~F.col("mixed") | (F.col("pa").isin("OT", "NT") & F.col("pb").isin("OT", "NT") & (F.col("pa") != F.col("pb")))))
    one = hits.select("src", "tgt", F.when(F.col("mixed"), "quotation").otherwise("parallel").alias("type"))
    return one.unionByName(one.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"), "type")).distinct()
