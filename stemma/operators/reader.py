"""What a reader's panes derive from the tables: annotations from selections, badges, fallbacks, the palette, a stored index."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.functions import refs as R
from stemma.operators import search as S
from stemma.operators import store
from stemma.util import islands


def annotation_rows(selected: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """book, chapter, slug, verse_start, verse_end of selected verses (book, chapter, verse, slug): one row per run of verses; runs that ``existing`` has are left out."""
    runs = islands(selected.select("book", "chapter", "slug", "verse").distinct(), ["book", "chapter", "slug"], "verse").groupBy("book", "chapter", "slug", "island").agg(F.min("verse").alias("a"), F.max("verse").alias("b"))
    key = lambda v: F.concat_ws(".", "book", "chapter", v)
    rows = runs.select("book", "chapter", "slug", key("a").alias("verse_start"), key("b").alias("verse_end"))
    return rows if existing is None else rows.join(existing, ["slug", "verse_start", "verse_end"], "left_anti")


def without_overlapping(annotations: DataFrame, selected: DataFrame, key: str) -> DataFrame:
    """annotations (book, ch, v, ch_end, v_end) without those that a selected verse (book, chapter, verse) lies in."""
    hit = store.overlapping(selected, annotations, [key]).select(key).distinct()
    return annotations.join(hit, key, "left_anti")


def add_missing(tags: DataFrame, names: DataFrame, column: str = "name") -> DataFrame:
    """tags with the trimmed lower-case names that it lacks."""
    new = names.select(F.lower(F.trim(column)).alias(column)).filter(F.length(column) > 0).distinct()
    return tags.unionByName(new.join(tags.select(F.lower(column).alias(column)), column, "left_anti"), allowMissingColumns=True)


def refs_here(refs: Column, book: str, chapter: int) -> Column:
    """struct(here: sorted verse numbers in the chapter, elsewhere: how many other references)."""
    own = F.filter(refs, lambda r: r.startswith(f"{book}.{chapter}."))
    numbers = F.filter(F.transform(own, lambda r: F.split_part(r, F.lit("."), F.lit(3)).try_cast("int")), lambda n: n.isNotNull())
    return F.struct(F.array_sort(F.array_distinct(numbers)).alias("here"), (F.size(refs) - F.size(own)).alias("elsewhere"))


def badges(links: DataFrame, kind: str = "quotation") -> DataFrame:
    """verse, n: how many links of a kind each verse has in either direction."""
    ends = links.filter(F.col("type") == kind).select(F.explode(F.array_distinct(F.array("source_verse", "target_verse"))).alias("verse"))
    return ends.groupBy("verse").agg(F.count("*").alias("n"))


def land(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """wanted (translation_id, book, chapter) with to_book and to_chapter: as wanted; else the book's first chapter; else the first book's.

    present: translation_id, ord, book, chapter.
    """
    first = present.groupBy("translation_id", "book").agg(F.min("chapter").alias("first_chapter"))
    top = present.groupBy("translation_id").agg(F.min(F.struct("ord", "chapter", "book")).alias("top"))
    exact = present.select("translation_id", "book", "chapter", F.lit(True).alias("hit")).distinct()
    j = wanted.join(exact, ["translation_id", "book", "chapter"], "left").join(first, ["translation_id", "book"], "left").join(top, "translation_id", "left")
    return j.select("translation_id", "book", "chapter", F.when(F.col("first_chapter").isNotNull(), F.col("book")).otherwise(F.col("top.book")).alias("to_book"), F.when(F.col("hit"), F.col("chapter")).otherwise(F.coalesce("first_chapter", "top.chapter")).alias("to_chapter"))


def breadcrumb(path: Column, most: int = 7, last: int = 5) -> Column:
    """The first, '…' and the last five of a path that is longer than seven."""
    return F.when(F.size(path) > most, F.concat(F.slice(path, 1, 1), F.array(F.lit("…")), F.slice(path, -last, last))).otherwise(path)


def palette(query: str, verses: DataFrame, index: DataFrame, annotations: DataFrame, key: str = "seq") -> DataFrame:
    """ord, kind, key of a short query: the passage that it refers to; up to three books that it begins; from three letters the five best verses; up to three notes that hold it."""
    spark = verses.sparkSession
    q = query.strip()
    refs = spark.range(1).select(R.parse_reference(F.lit(q)).alias("r")).filter("r is not null").select(F.lit(0).alias("ord"), F.lit("reference").alias("kind"), R.to_osis(F.col("r.book"), F.col("r.chapter"), F.col("r.verse")).alias("key"))
    names = [(n, b) for part in R.BOOKS.values() for b, n, _ in part if q and n.lower().startswith(q.lower())][:3]
    out = refs.unionByName(spark.createDataFrame([(1, "book", b) for _, b in names], "ord int, kind string, key string"))
    if len(q) >= 3:
        best = S.top(S.search(index, key, q), key, n=5)
        out = out.unionByName(best.select(F.lit(2).alias("ord"), F.lit("verse").alias("kind"), F.col(key).cast("string").alias("key")))
    notes = annotations.filter(F.lower("label").contains(q.lower())).orderBy("event_id").limit(3) if q else annotations.limit(0)
    return out.unionByName(notes.select(F.lit(3).alias("ord"), F.lit("note").alias("kind"), F.col("event_id").cast("string").alias("key")))


def stored_index(spark: SparkSession, path: str, verses: DataFrame, key: str = "seq", text: str = "text") -> DataFrame:
    """The inverted index kept at a path; built again where it is missing or made from another number of verses."""
    n = verses.count()
    try:
        meta = spark.read.json(f"{path}/meta").first()
        if meta is not None and meta["verses"] == n:
            return spark.read.parquet(meta["at"])
    except AnalysisException:
        pass
    at = f"{path}/postings-{uuid.uuid4().hex}"  # who reads the old one can go on
    S.postings(verses, key, text).sortWithinPartitions("term").write.parquet(at)
    spark.createDataFrame([(n, at)], "verses long, at string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")
    return spark.read.parquet(at)


def current_mode(mode: Column) -> Column:
    """Saved searches' mode; a retired one is the concordance."""
    return F.when(mode == "lexicon", "concordance").otherwise(mode)
