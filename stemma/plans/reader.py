"""Queries of what a reader's panes derive, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.operators import reader as V
from stemma.plans import adapters as A
from stemma.util import table


def selection_runs(spark: SparkSession, d: str) -> DataFrame:
    """A highlight per run of verses that documents of one kind are about."""
    v = A.verses(spark, d).filter("verse is not null").select("book", "chapter", "verse", F.col("doc_kind").alias("slug"))
    return V.annotation_rows(v).select("slug", "verse_start", "verse_end")


def untouched_annotations(spark: SparkSession, d: str) -> DataFrame:
    sel = A.verses(spark, d).select("book", "chapter", "verse").filter("verse is not null").distinct()
    return V.without_overlapping(A.annotations(spark, d), sel, "event_id").select("event_id")


def refs_here(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "person").filter("verse_refs is not null").select("seq", V.refs_here(F.filter("verse_refs", lambda r: r.isNotNull()), "Khun", 16).alias("x"))
    return p.select("seq", F.array_join(F.transform("x.here", lambda n: n.cast("string")), " ").alias("here"), F.col("x.elsewhere").alias("elsewhere"))


def quotation_badges(spark: SparkSession, d: str) -> DataFrame:
    rows = A.links(spark, d).withColumn("type", F.when(F.col("votes") >= 40, "quotation").otherwise("theme"))
    return V.badges(rows)


def landing(spark: SparkSession, d: str) -> DataFrame:
    """Where each chapter of the reference leads in the Hebrew texts."""
    present = A.verses(spark, d).filter("translation_id = 'he'").join(F.broadcast(A.book_order(spark, d).select("book", "ord")), "book")
    wanted = table(spark, d, "ref_counts").select(F.lit("he").alias("translation_id"), "book", "chapter")
    return V.land(wanted, present)


QUERIES = {f.__name__: f for f in (selection_runs, untouched_annotations, refs_here, quotation_badges, landing)}
SQL = {
    "selection_runs": f"""with {A.VERSES}, s as (select distinct book, chapter, verse, doc_kind slug from verses where verse is not null), i as (select *, verse - row_number() over (partition by book, chapter, slug order by verse) g from s)
select slug, book || '.' || chapter || '.' || min(verse) verse_start, book || '.' || chapter || '.' || max(verse) verse_end from i group by book, chapter, slug, g""",
    "untouched_annotations": f"with {A.VERSES}, {A.ANNOTATIONS} select event_id from ann a where not exists (select 1 from verses s where s.book = a.book and s.verse is not null and (s.chapter, s.verse) >= (ch, v) and (s.chapter, s.verse) <= (ch_end, v_end))",
    "refs_here": """with p as (select seq, list_filter(verse_refs, lambda r: r is not null) r from person where verse_refs is not null), h as (select seq, r, list_filter(r, lambda x: starts_with(x, 'Khun.16.')) o from p)
select seq, array_to_string(list_sort(list_distinct(list_transform(o, lambda x: split_part(x, '.', 3)::int))), ' ') here, (len(r) - len(o))::int elsewhere from h""",
    "quotation_badges": f"with {A.LINKS} select verse, count(*) n from (select source_verse verse from links where votes >= 40 union all select target_verse from links where votes >= 40 and source_verse <> target_verse) group by 1",
    "landing": f"""with {A.VERSES}, {A.BOOK_ORDER}, p as (select book, chapter, ord from verses join book_order using (book) where translation_id = 'he'), f as (select book, min(chapter) c from p group by 1), t as (select min((ord, chapter, book)) x from p)
select 'he' translation_id, r.book, r.chapter, case when f.book is not null then r.book else x[3] end to_book, case when exists (select 1 from p where p.book = r.book and p.chapter = r.chapter) then r.chapter else coalesce(f.c, x[2]) end::int to_chapter from ref_counts r left join f on f.book = r.book, t""",
}
