"""Checks of a translation's verses against a reference versification, one row per finding.

verses: translation_id, book, chapter, verse, verse_end, osis_id, text, seq.
reference: book, chapter, verses (the canonical counts). Every check keeps the order of the others: a repeated key only
counts once, rows of unknown books and of impossible numbers are left out of what comes after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.functions.text import runs
from stemma.util import keep_first

T = "translation_id"


def _finding(df: DataFrame, check: str, severity: Column | str, where: Column | str, detail: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    s = F.lit(severity) if isinstance(severity, str) else severity
    return df.select(T, F.lit(check).alias("check"), s.alias("severity"), (F.col(where) if isinstance(where, str) else where).alias("where"), (none if detail is None else detail.cast("string")).alias("detail"))


def first_copies(verses: DataFrame) -> DataFrame:
    return keep_first(verses, [T, "osis_id"], ["seq"])


def duplicates(verses: DataFrame) -> DataFrame:
    """V2: keys that come more than once, with how many copies are too many. Counted on the map side, so hot keys cost nothing."""
    n = verses.groupBy(T, "osis_id").agg(F.count("*").alias("n")).filter("n > 1")
    return _finding(n, "duplicate", "error", "osis_id", F.col("n") - 1)


def _known(verses: DataFrame, reference: DataFrame) -> DataFrame:
    return first_copies(verses).join(reference.select("book").distinct(), "book", "left_semi")


def valid(verses: DataFrame, reference: DataFrame) -> DataFrame:
    """First copies of known books with possible numbers and a range that isn't inverted."""
    return _known(verses, reference).filter("chapter >= 1 and verse >= 1 and (verse_end is null or verse_end > verse)")


def unknown_books(verses: DataFrame, reference: DataFrame) -> DataFrame:
    """V3."""
    return _finding(first_copies(verses).join(reference.select("book").distinct(), "book", "left_anti"), "unknown book", "error", "osis_id", F.col("book"))


def blank_texts(verses: DataFrame, reference: DataFrame) -> DataFrame:
    """V4."""
    return _finding(_known(verses, reference).filter("text is null or not text rlike '\\\\S'"), "blank text", "error", "osis_id")


def bad_numbers(verses: DataFrame, reference: DataFrame) -> DataFrame:
    """V5: a chapter or verse that is missing or below 1."""
    return _finding(_known(verses, reference).filter("chapter is null or chapter < 1 or verse is null or verse < 1"), "bad number", "error", "osis_id")


def inverted(verses: DataFrame, reference: DataFrame) -> DataFrame:
    """V6: a range that ends where it starts, or before."""
    return _finding(_known(verses, reference).filter("chapter >= 1 and verse >= 1 and verse_end <= verse"), "inverted range", "error", "osis_id")


def _covered(verses: DataFrame, reference: DataFrame) -> DataFrame:
    return valid(verses, reference).select(T, "book", "chapter", "osis_id", "seq", F.explode(F.sequence("verse", F.coalesce("verse_end", "verse"))).alias("n"))


def overlaps(verses: DataFrame, reference: DataFrame) -> DataFrame:
    """V7: verses that several records cover, with the first of these."""
    c = _covered(verses, reference).groupBy(T, "book", "chapter", "n").agg(F.count("*").alias("k"), F.min_by("osis_id", "seq").alias("owner")).filter("k > 1")
    return _finding(c, "overlap", "error", F.concat_ws(".", "book", "chapter", "n"), F.col("owner"))


def _chapters(verses: DataFrame, reference: DataFrame) -> DataFrame:
    """translation, book, chapter, last: the last verse that is covered."""
    return valid(verses, reference).groupBy(T, "book", "chapter").agg(F.max(F.coalesce("verse_end", "verse")).alias("last"))


def too_many_chapters(verses: DataFrame, reference: DataFrame, more: dict[str, int] | None = None) -> DataFrame:
    """V8: books that run past the canon, or past ``more`` where a book may have more."""
    canon = reference.groupBy("book").agg(F.max("chapter").alias("canon"))
    allowed = F.col("canon")
    for book, n in (more or {}).items():
        allowed = F.when(F.col("book") == book, n).otherwise(allowed)
    c = _chapters(verses, reference).groupBy(T, "book").agg(F.max("chapter").alias("most")).join(canon, "book").filter(F.col("most") > allowed)
    return _finding(c, "too many chapters", "error", "book", F.col("most"))


def missing_chapters(verses: DataFrame, reference: DataFrame, sparse: tuple[str, ...] = (), more: dict[str, int] | None = None) -> DataFrame:
    """V9: the chapters that a book lacks, as runs; not for sparse books and for those with too many."""
    canon = reference.groupBy("book").agg(F.max("chapter").alias("canon"))
    have = _chapters(verses, reference).groupBy(T, "book").agg(F.collect_set("chapter").alias("have"), F.max("chapter").alias("most")).join(canon, "book")
    allowed = F.col("canon")
    for book, n in (more or {}).items():
        allowed = F.when(F.col("book") == book, n).otherwise(allowed)
    lacks = F.array_except(F.sequence(F.lit(1), "canon"), "have")
    gaps = have.filter((F.col("most") <= allowed) & ~F.col("book").isin(*sparse) if sparse else (F.col("most") <= allowed)).withColumn("lacks", lacks).filter(F.size("lacks") > 0)
    return _finding(gaps, "missing chapters", "warning", "book", runs(F.col("lacks")))


def _classified_gaps(gaps: DataFrame, check: str, known: DataFrame | None) -> DataFrame:
    """A gap of ``known`` (translation_id, osis_id) is expected."""
    where = F.concat_ws(".", "book", "chapter", "n")
    if known is None:
        return _finding(gaps, check, "warning", where)
    k = known.select(T, F.col("osis_id").alias("__k")).distinct().withColumn("__known", F.lit(True))
    marked = gaps.withColumn("__k", where).join(k, [T, "__k"], "left")
    return _finding(marked, check, F.when(F.col("__known"), "expected").otherwise("warning"), "__k")


def interior_gaps(verses: DataFrame, reference: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """V10: verses below the last one of their chapter that nothing covers."""
    every = _chapters(verses, reference).select(T, "book", "chapter", F.explode(F.sequence(F.lit(1), "last")).alias("n"))
    return _classified_gaps(every.join(_covered(verses, reference), [T, "book", "chapter", "n"], "left_anti"), "gap", known)


def _expected(verses: DataFrame, reference: DataFrame, variants: DataFrame | None) -> DataFrame:
    """_chapters with the number of verses they should have; variants (translation_id, book, chapter, verses) come first."""
    c = _chapters(verses, reference).join(reference.select("book", "chapter", "verses"), ["book", "chapter"])
    if variants is not None:
        c = c.join(variants.select(T, "book", "chapter", F.col("verses").alias("__v")), [T, "book", "chapter"], "left").withColumn("verses", F.coalesce("__v", "verses")).drop("__v")
    return c


def overruns(verses: DataFrame, reference: DataFrame, variants: DataFrame | None = None) -> DataFrame:
    """V11: chapters with more verses than expected."""
    return _finding(_expected(verses, reference, variants).filter("last > verses"), "overrun", "warning", F.concat_ws(".", "book", "chapter"), F.col("last"))


def trailing_gaps(verses: DataFrame, reference: DataFrame, variants: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """V12: verses after the last one that a chapter should have."""
    short = _expected(verses, reference, variants).filter("last < verses")  # before sequence, which would count down
    return _classified_gaps(short.select(T, "book", "chapter", F.explode(F.sequence(F.col("last") + 1, F.col("verses"))).alias("n")), "trailing gap", known)


def empty(verses: DataFrame, translations: DataFrame) -> DataFrame:
    """V1: translations (translation_id) without any verse."""
    return _finding(translations.join(verses.select(T).distinct(), T, "left_anti"), "no verses", "error", T)


def validate(verses: DataFrame, reference: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Every finding of every check."""
    out = duplicates(verses)
    for check in (unknown_books, blank_texts, bad_numbers, inverted, overlaps, too_many_chapters, missing_chapters, overruns):
        out = out.unionByName(check(verses, reference))
    return out.unionByName(interior_gaps(verses, reference, known)).unionByName(trailing_gaps(verses, reference, None, known))


def versification(verses: DataFrame) -> DataFrame:
    """book, chapter, verses: the last verse of each chapter."""
    return verses.filter("chapter >= 1 and verse >= 1").groupBy("book", "chapter").agg(F.max(F.coalesce("verse_end", "verse")).alias("verses"))


def versification_diff(raw: DataFrame, processed: DataFrame) -> DataFrame:
    """Chapters whose counts differ, or that only one side has."""
    a, b = raw.withColumnRenamed("verses", "raw"), processed.withColumnRenamed("verses", "processed")
    return a.join(b, ["book", "chapter"], "full_outer").filter(~F.col("raw").eqNullSafe(F.col("processed")))
