"""Delimited text: two CSV dialects, a naive one, tab-separated links, and the tables of people, places, events and terms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.functions import refs as R
from stemma.functions import text as T
from stemma.util import keep_first


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """RFC 4180 with a header: quotes open at a cell's start only, doubled ones stand for one, lines may break inside; cells are trimmed, missing ones are '', rows of blank cells are dropped. A byte order mark is passed over."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, encoding="UTF-8", enforceSchema=False)
    names = [c.lstrip("﻿").strip() for c in df.columns]
    df = df.toDF(*names).select(*[F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c) for c in names])
    filled = F.greatest(*[F.length(f"`{c}`") for c in names]) if len(names) > 1 else F.length(f"`{names[0]}`")
    return df.filter(filled > 0)


def read_csv_loose(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """The second dialect: quotes open anywhere in a cell, nothing is trimmed, blank rows stay. Columns by position, without a header.

    Whole files are read as text; a record ends at a line break outside quotes, which is where the number of quotes so far is even.
    """
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "\r", "").alias("t"))
    row = r"((?:[^\"\n]|\"[^\"]*\")*)(?:\n|$)"
    rows = text.select(F.posexplode(F.regexp_extract_all("t", F.lit(row), 1)).alias("seq", "line"))
    cell = r"(?:^|,)((?:[^\",]|\"[^\"]*\")*)"
    cells = F.transform(F.regexp_extract_all("line", F.lit(cell), 1), lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, '""', ""), '"', ""), "", '"'))
    return rows.withColumn("c", cells).select("seq", *[F.get("c", F.lit(i)).alias(n) for i, n in enumerate(columns)], F.size("c").alias("cells"))


def read_split(spark: SparkSession, path: str, least: int, take: dict[str, int]) -> DataFrame:
    """Naive commas: quotes mean nothing; the first line of a file is its header; lines of fewer than ``least`` cells are dropped."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("seq", "line")).filter("seq > 0")
    cells = lines.withColumn("c", F.split("line", ",")).filter(F.size("c") >= least)
    return cells.select("seq", *[F.trim(F.get("c", F.lit(i))).alias(n) for n, i in take.items()])


def parse_links(lines: DataFrame, value: str = "value", seq: str = "seq") -> DataFrame:
    """id, source_verse, target_verse, votes of lines 'from, to, votes' by tabs: no comments (#), headers (From), short lines, links to oneself,
    malformed keys or votes below 1. A range counts by its start. Votes are a leading number. The first of equal pairs stays.
    """
    v = F.trim(value)
    rows = lines.filter((v != "") & ~v.startswith("#") & ~v.startswith("From")).withColumn("c", F.split(value, "\t")).filter(F.size("c") >= 3)
    votes = F.regexp_extract(F.get("c", F.lit(2)), r"^\s*([+-]?\d+)", 1).try_cast("int")
    rows = rows.select(seq, R.normalize_verse(F.get("c", F.lit(0))).alias("source_verse"), R.normalize_verse(F.get("c", F.lit(1))).alias("target_verse"), votes.alias("votes"))
    ok = rows.filter("source_verse is not null and target_verse is not null and source_verse <> target_verse and votes > 0")
    return keep_first(ok.withColumn("id", F.concat("source_verse", F.lit("→"), "target_verse")), ["id"], [seq]).select("id", "source_verse", "target_verse", "votes")


def read_links(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).withColumn("seq", F.monotonically_increasing_id())
    return parse_links(lines)


def present(df: DataFrame, *aliases: str) -> Column:
    """The first of these columns that the table has, even if it is empty; null if it has none."""
    return next((F.nullif(F.trim(F.col(f"`{a}`")), F.lit("")) for a in aliases if a in df.columns), F.lit(None).cast("string"))


def persons_table(df: DataFrame) -> DataFrame:
    """id, name, gender, verse_refs of a people table; rows without an id or a name are dropped."""
    return df.select(
        present(df, "personLookup", "person_lookup", "id").alias("id"), present(df, "displayTitle", "display_title", "name").alias("name"), present(df, "gender").alias("gender"), R.normalize_refs(present(df, "verses", "verse_refs")).alias("verse_refs")
    ).filter("id is not null and name is not null")


def _number(c: Column) -> Column:
    return F.regexp_extract(c, r"^\s*([+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)", 1).try_cast("double")


def places_table(df: DataFrame, lat_columns: Sequence[str] = ("latitude", "lat"), lng_columns: Sequence[str] = ("longitude", "lng")) -> DataFrame:
    """id, name, lat, lng, confidence (if it is a number), precision (if it isn't), verse_refs; both coordinates or none."""
    lat, lng = _number(present(df, *lat_columns)), _number(present(df, *lng_columns))
    both = lat.isNotNull() & lng.isNotNull()
    sure, precise = present(df, "confidence"), present(df, "precision")
    return df.select(
        present(df, "placeLookup", "place_lookup", "id").alias("id"), present(df, "displayTitle", "display_title", "name").alias("name"), F.when(both, lat).alias("lat"), F.when(both, lng).alias("lng"),
        F.coalesce(_number(sure), _number(precise)).alias("confidence"), F.when(_number(precise).isNull(), precise).alias("precision"), R.normalize_refs(present(df, "verses", "verse_refs")).alias("verse_refs"),
    ).filter("id is not null and name is not null")


def events_table(df: DataFrame) -> DataFrame:
    return df.select(
        present(df, "eventID", "event_id", "id").alias("id"), present(df, "title", "name").alias("name"), present(df, "startDate", "start_date", "date").alias("date"), R.normalize_refs(present(df, "verses", "verse_refs")).alias("verse_refs")
    ).filter("id is not null and name is not null")


def dictionary_table(df: DataFrame) -> DataFrame:
    """id (the term in lower case), term, definition without the links' targets."""
    term, text = present(df, "term", "dictLookup"), present(df, "definition", "dictText")
    return df.select(F.lower(term).alias("id"), term.alias("term"), T.without_links(text).alias("definition")).filter("id is not null and definition is not null")


def external_persons(df: DataFrame) -> DataFrame:
    return df.select(present(df, "person_id").alias("person_id"), present(df, "person_name").alias("person_name")).filter("person_id is not null and person_name is not null")


def external_labels(df: DataFrame) -> DataFrame:
    filled = lambda *a: F.coalesce(present(df, *a), F.lit(""))
    return df.select(
        present(df, "person_id").alias("person_id"), filled("english_label").alias("english_label"), filled("label_type").alias("label_type"), filled("hebrew_label_meaning", "hebrew_meaning").alias("hebrew_meaning"), filled("greek_label_meaning", "greek_meaning").alias("greek_meaning")
    ).filter("person_id is not null")


def hebrew_lexicon(rows: DataFrame) -> DataFrame:
    """id, strongs_number, language, lemma, transliteration, pronunciation, gloss, description of rows (number, word, gloss, cells): those of three cells and a number."""
    ok = rows.filter((F.col("cells") >= 3) & F.trim("number").rlike(r"^\d+$")).withColumn("g", T.gloss_parts(F.col("gloss")))
    ident = F.concat(F.lit("H"), F.regexp_replace(F.trim("number"), "^0+(?=.)", ""))
    return ok.select(ident.alias("id"), ident.alias("strongs_number"), F.lit("hebrew").alias("language"), F.trim("word").alias("lemma"), F.col("g.translit").alias("transliteration"), F.col("g.pronunciation").alias("pronunciation"), F.col("g.gloss").alias("gloss"), F.trim("gloss").alias("description"))
