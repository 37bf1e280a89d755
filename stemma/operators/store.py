"""The table store: lookups, ranges, containment, upserts and migrations over DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def chapter(verses: DataFrame, translation: str, book: str, number: int) -> DataFrame:
    return verses.filter((F.col("translation_id") == translation) & (F.col("book") == book) & (F.col("chapter") == number)).orderBy("verse", "seq")


def resolve_verses(wanted: DataFrame, verses: DataFrame) -> DataFrame:
    """wanted (translation_id, osis_id) with seq of the verse that has the key, else of the one whose range (verse, verse_end] covers it; null if neither.

    The range is looked up within (translation, book, chapter): an equi-join with a condition, not a nested loop.
    """
    at = lambda i: F.split_part("osis_id", F.lit("."), F.lit(i))
    w = wanted.select("translation_id", "osis_id", at(1).alias("book"), at(2).try_cast("int").alias("chapter"), at(3).try_cast("int").alias("v")).distinct()
    exact = verses.groupBy("translation_id", "osis_id").agg(F.min("seq").alias("exact_seq"))
    spans = verses.filter("verse_end > verse").select("translation_id", "book", "chapter", F.col("verse").alias("from_"), "verse_end", F.col("seq").alias("span_seq"))
    covered = w.join(spans, ["translation_id", "book", "chapter"]).filter((F.col("from_") < F.col("v")) & (F.col("v") <= F.col("verse_end"))).groupBy("translation_id", "osis_id").agg(F.min("span_seq").alias("span_seq"))
    return w.join(exact, ["translation_id", "osis_id"], "left").join(covered, ["translation_id", "osis_id"], "left").select("translation_id", "osis_id", F.coalesce("exact_seq", "span_seq").alias("seq"))


def books_present(verses: DataFrame, books: DataFrame, translation: str) -> DataFrame:
    """book, ord of the books of a translation, in canonical order; unknown ones are left out."""
    return verses.filter(F.col("translation_id") == translation).select("book").distinct().join(books.select("book", "ord"), "book").orderBy("ord")


def chapters_present(verses: DataFrame, translation: str, book: str) -> DataFrame:
    return verses.filter((F.col("translation_id") == translation) & (F.col("book") == book)).select("chapter").distinct().orderBy("chapter")


def seeded(df: DataFrame) -> bool:
    return not df.isEmpty()


def newest_first(df: DataFrame, at: str, key: str) -> DataFrame:
    return df.orderBy(F.desc(at), key)


def get(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.filter(F.col(key) == value)


def get_folded(df: DataFrame, key: str, value: str) -> DataFrame:
    """By a key that is stored in lower case."""
    return df.filter(F.col(key) == value.strip().lower())


def mentions(entities: DataFrame, key: str, refs: str) -> DataFrame:
    """key, osis_id: the bridge that a multi-entry index is; distinct."""
    return entities.select(key, F.explode(refs).alias("osis_id")).filter("osis_id is not null").distinct()


def touching(entities: DataFrame, key: str, refs: str, wanted: DataFrame) -> DataFrame:
    """Entities with any of the wanted osis_id, each row once: a semi-join over the bridge."""
    hit = mentions(entities, key, refs).join(wanted.select("osis_id").distinct(), "osis_id", "left_semi").select(key).distinct()
    return entities.join(hit, key, "left_semi")


def tagged(df: DataFrame, tags: str, slug: str, kind: str | None = None) -> DataFrame:
    hit = F.array_contains(tags, slug)
    return df.filter(hit & (F.col("type") == kind) if kind else hit)


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """table with rows put in: the last of equal keys (by ``order``) replaces what was there. Missing columns become null."""
    if order:
        last = F.max_by(F.struct(*rows.columns), F.struct(*order))
        rows = rows.groupBy(*keys).agg(last.alias("__r")).select("__r.*")
    return table.join(rows.select(*keys).distinct(), list(keys), "left_anti").unionByName(rows, allowMissingColumns=True)


def delete(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return table.join(rows.select(*keys).distinct(), list(keys), "left_anti")


def stamped(rows: DataFrame, column: str = "modified") -> DataFrame:
    return rows.withColumn(column, F.current_timestamp())


def with_defaults(settings: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """One row: the settings, with the default where one is missing or no row is there."""
    spark = settings.sparkSession
    base = spark.createDataFrame([tuple(defaults.values())], [f"__{k}" for k in defaults])
    joined = base.join(settings.limit(1), F.lit(True), "left")
    have = set(settings.columns)
    return joined.select(*[(F.coalesce(F.col(k), F.col(f"__{k}")) if k in have else F.col(f"__{k}")).alias(k) for k in defaults])


Migration = tuple[int, str, Callable[[DataFrame], DataFrame]]


def migrate(tables: dict[str, DataFrame], version: int, steps: Sequence[Migration]) -> tuple[dict[str, DataFrame], int]:
    """The tables after all steps above ``version``, in order; each rewrites one table. A missing table is passed over."""
    out = dict(tables)
    for number, name, change in sorted(steps, key=lambda s: s[0]):
        if number > version:
            if name in out:
                out[name] = change(out[name])
            version = number
    return out, version


def read_or_empty(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet") -> DataFrame:
    """The data at a path, or no rows of the schema where there is none."""
    try:
        return spark.read.format(fmt).schema(schema).load(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def overlapping(rows: DataFrame, intervals: DataFrame, keep: Sequence[str]) -> DataFrame:
    """rows (book, chapter, verse, ...) with the intervals (book, ch, v, ch_end, v_end, kept columns) they lie in, both ends included.

    Intervals become one row per chapter they touch, so that the join is equal on (book, chapter) and only verses within the chapter are compared.
    """
    top = 1 << 30
    by_chapter = intervals.filter("ch_end >= ch").select("book", *keep, "ch", "v", "ch_end", "v_end", F.explode(F.sequence("ch", "ch_end")).alias("chapter"))
    by_chapter = by_chapter.select("book", "chapter", *keep, F.when(F.col("chapter") == F.col("ch"), F.col("v")).otherwise(0).alias("lo"), F.when(F.col("chapter") == F.col("ch_end"), F.col("v_end")).otherwise(top).alias("hi"))
    return rows.join(by_chapter, ["book", "chapter"]).filter(F.col("verse").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def neighbours(chapters: DataFrame) -> DataFrame:
    """chapters (translation_id, ord, book, chapter) with the previous and next one, across books, as 'Book.c'."""
    w = Window.partitionBy("translation_id").orderBy("ord", "chapter")
    key = F.concat_ws(".", "book", "chapter")
    return chapters.withColumns({"prev": F.lag(key).over(w), "next": F.lead(key).over(w)})


def nearest_filled(grid: DataFrame, present: DataFrame) -> DataFrame:
    """grid (translation_id, ord, book, chapter) with the chapter to open: itself if present, else the next present one of the translation, else the last before."""
    w = Window.partitionBy("translation_id").orderBy("ord", "chapter")
    key = F.concat_ws(".", "book", "chapter")
    marked = grid.join(present.select("translation_id", "book", "chapter").distinct().withColumn("here", F.lit(True)), ["translation_id", "book", "chapter"], "left")
    filled = F.when(F.col("here"), key)
    after = F.first(filled, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    before = F.last(filled, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("open", F.coalesce(after, before)).drop("here")


def highlights(annotated: DataFrame, keys: Sequence[str], colour: str, at: str, tie: str) -> DataFrame:
    """The colour of the most recent annotation of each key; the first of equally recent ones."""
    return annotated.groupBy(*keys).agg(F.min_by(colour, F.struct((-F.unix_micros(F.col(at).cast("timestamp"))).alias("age"), tie)).alias(colour))


def sorted_union(selected: Column, low: Column, high: Column) -> Column:
    """A selection with the range from low to high added."""
    return F.array_sort(F.array_union(selected, F.sequence(F.least(low, high), F.greatest(low, high))))
