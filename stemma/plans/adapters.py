"""The test tables in the roles of the engine's tables, as DataFrames and as the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.util import cut, keep_first, spread, table

_FIRST = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_extendedprice", "l_quantity")


def raw_links(spark: SparkSession, d: str) -> DataFrame:
    """Every line item as a link from its supplier's passage to its customer's: repeated keys included."""
    li = spread(table(spark, d, "lineitem").select(*_FIRST))
    j = li.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    j = j.join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    j = j.join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    key = lambda n, k: F.concat_ws(".", F.concat(F.lit("N"), n), k, F.col("l_linenumber"))
    source, target = key(F.col("s_nationkey"), F.col("l_suppkey")), key(F.col("c_nationkey"), F.col("o_custkey"))
    return j.select(F.concat(source, F.lit("→"), target).alias("id"), source.alias("source_verse"), target.alias("target_verse"), F.col("l_quantity").cast("int").alias("votes"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(_FIRST)])


def links(spark: SparkSession, d: str) -> DataFrame:
    """One link per key: the first."""
    rows = raw_links(spark, d)
    return keep_first(rows, ["id"], [f"o{i}" for i in range(len(_FIRST))]).select("id", "source_verse", "target_verse", "votes")


def stored_links(spark: SparkSession, d: str) -> DataFrame:
    """The links as a table, for queries that read them more than once."""
    return cut(links(spark, d))


LINKS = f"""raw_links as (
  select 'N' || s_nationkey || '.' || l_suppkey || '.' || l_linenumber source_verse, 'N' || c_nationkey || '.' || o_custkey || '.' || l_linenumber target_verse,
    cast(l_quantity as int) votes, {", ".join(f"{c} o{i}" for i, c in enumerate(_FIRST))}
  from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join supplier on s_suppkey = l_suppkey),
links as (
  select source_verse || '→' || target_verse id, source_verse, target_verse, votes from raw_links
  qualify row_number() over (partition by source_verse, target_verse order by {", ".join(f"o{i}" for i in range(len(_FIRST)))}) = 1),
parts as (select *, split_part(source_verse, '.', 1) sb, split_part(target_verse, '.', 1) tb, split_part(source_verse, '.', 2)::int sc, split_part(target_verse, '.', 2)::int tc from links)
"""


def books(spark: SparkSession, d: str) -> DataFrame:
    """book, ord, part: nations as books, their regions as testaments."""
    part = F.when(F.col("n_regionkey") < 2, "OT").when(F.col("n_regionkey") == 2, "AP").otherwise("NT")
    return table(spark, d, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("book"), F.col("n_nationkey").alias("ord"), part.alias("part"), F.col("n_name").alias("name"))


BOOKS = "books as (select 'N' || n_nationkey book, n_nationkey ord, case when n_regionkey < 2 then 'OT' when n_regionkey = 2 then 'AP' else 'NT' end part, n_name name from nation)"


def verses(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a passage, as verses of the translation that their language names."""
    doc = spread(table(spark, d, "documents").filter("osis_ref is not null"))
    at = lambda i: F.split_part("osis_ref", F.lit("."), F.lit(i))
    return doc.select(F.coalesce("lang", F.lit("und")).alias("translation_id"), at(1).alias("book"), at(2).try_cast("int").alias("chapter"), at(3).try_cast("int").alias("verse"), F.col("osis_ref").alias("osis_id"), "text", F.col("doc_id").alias("seq"), "source", "doc_kind", "written_at")


VERSES = """verses as (select coalesce(lang, 'und') translation_id, split_part(osis_ref, '.', 1) book, try_cast(split_part(osis_ref, '.', 2) as int) chapter,
  try_cast(split_part(osis_ref, '.', 3) as int) verse, osis_ref osis_id, text, doc_id seq, source, doc_kind, written_at from documents where osis_ref is not null)"""


def grid(spark: SparkSession, d: str) -> DataFrame:
    """Every passage of the reference counts: book, chapter, verse."""
    return table(spark, d, "ref_counts").select("book", "chapter", F.explode(F.sequence(F.lit(1), F.col("verses"))).alias("verse"))


GRID = "grid as (select book, chapter, unnest(range(1, verses + 1))::int verse from ref_counts)"


def book_order(spark: SparkSession, d: str) -> DataFrame:
    """Distinct books of the reference counts by name, numbered from 0 (a few dozen rows)."""
    return table(spark, d, "ref_counts").groupBy("book").agg(F.max("chapter").alias("chapters")).orderBy("book").select("book", "chapters", (F.expr("row_number() over (order by book)") - 1).alias("ord"))


BOOK_ORDER = "book_order as (select book, max(chapter) chapters, row_number() over (order by book) - 1 ord from ref_counts group by book)"


def annotations(spark: SparkSession, d: str) -> DataFrame:
    """Events as annotations: slug, label, modified, and an interval from (ch, v) to (ch_end, v_end) in a book."""
    e = table(spark, d, "events")
    b = F.broadcast(book_order(spark, d))  # a few dozen books
    n = table(spark, d, "ref_counts").select(F.countDistinct("book").alias("n"))
    e = e.join(F.broadcast(n)).withColumn("ord", F.col("user_id") % F.col("n")).join(b, "ord")
    ch = (F.col("event_id") % F.col("chapters") + 1).cast("int")
    return e.select("event_id", F.col("event_type").alias("slug"), F.concat("event_type", F.lit(" "), F.col("user_id").cast("string")).alias("label"), F.col("ts").alias("modified"), "book", ch.alias("ch"), (F.col("event_id") % 20 + 1).cast("int").alias("v"), (ch + (F.col("event_id") % 3 == 0).cast("int")).alias("ch_end"), (F.col("event_id") % 20 + 1 + F.col("event_id") % 4).cast("int").alias("v_end"))


ANNOTATIONS = (
    BOOK_ORDER
    + """, ann as (select event_id, event_type slug, event_type || ' ' || user_id "label", ts modified, book, (event_id % chapters + 1)::int ch, (event_id % 20 + 1)::int v,
  (event_id % chapters + 1 + case when event_id % 3 = 0 then 1 else 0 end)::int ch_end, (event_id % 20 + 1 + event_id % 4)::int v_end
  from events join book_order on ord = user_id % (select count(distinct book) from ref_counts))"""
)
