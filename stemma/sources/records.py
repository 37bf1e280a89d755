"""Line-wise JSON and records inside scripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.functions import refs as R
from stemma.functions import text as T

_GEO = "friendly_id string, id string, url_slug string, identifications array<struct<score:struct<time_total:double>,resolutions:array<struct<lonlat:string>>>>, extra string"


def parse_geo(lines: DataFrame, value: str = "value") -> DataFrame:
    """id, url_slug, name, lat, lng, confidence (the score by 1000, from 0 to 1), verse_refs of JSON lines.

    A line without a name or without the first identification's first location (longitude first) is dropped, as is a
    malformed one. The references are JSON inside a text; where that is malformed there are none.
    """
    j = lines.select(F.from_json(value, _GEO).alias("j")).filter("j.friendly_id is not null")
    first = F.get("j.identifications", F.lit(0))
    at = F.split(F.get(first["resolutions"], F.lit(0))["lonlat"], ",")
    part = lambda i: F.trim(F.get(at, F.lit(i))).try_cast("double")
    score = F.coalesce(first["score"]["time_total"], F.lit(0.0)) / 1000
    refs = F.from_json("j.extra", "osises array<string>")["osises"]
    clean = F.array_distinct(F.filter(F.transform(F.coalesce(refs, F.array().cast("array<string>")), R.normalize_verse), lambda r: r.isNotNull()))
    rows = j.select("j.id", "j.url_slug", F.col("j.friendly_id").alias("name"), part(1).alias("lat"), part(0).alias("lng"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("confidence"), clean.alias("verse_refs"))
    return rows.filter("lat is not null and lng is not null")


def read_geo(spark: SparkSession, path: str) -> DataFrame:
    return parse_geo(spark.read.text(path))


def greek_lexicon(texts: DataFrame, value: str = "value") -> DataFrame:
    """Lexicon entries of a script 'name = {"G1": {...}, ...}': from the first brace after the first = to the last one, keys G and a number, by number."""
    body = F.regexp_extract(value, r"(?s)=[^{]*(\{.*\})", 1)
    entries = texts.select(F.explode(F.map_entries(F.from_json(body, "map<string,struct<lemma:string,translit:string,strongs_def:string,kjv_def:string,derivation:string>>"))).alias("e"))
    rows = entries.select("e.key", "e.value.*").filter(F.col("key").rlike(r"^G\d+$"))
    short, long = F.nullif(F.trim("kjv_def"), F.lit("")), F.trim("strongs_def")
    text = F.concat_ws("\n", F.nullif(F.trim("derivation"), F.lit("")), F.nullif(long, F.lit("")), short)
    return rows.select(F.col("key").alias("id"), F.col("key").alias("strongs_number"), F.lit("greek").alias("language"), F.coalesce("lemma", F.lit("")).alias("lemma"), F.coalesce("translit", F.lit("")).alias("transliteration"), F.lit(None).cast("string").alias("pronunciation"), T.fallback_gloss(short, long).alias("gloss"), F.nullif(text, F.lit("")).alias("description")).orderBy(F.substring("id", 2, 20).try_cast("int"))


def script_links(texts: DataFrame, codes: dict[str, str], value: str = "value") -> DataFrame:
    """src, tgt ('Book.c'), type of calls links.push({bkSource, chpSource, bkTarget, chpTarget, type}): q, a and p as quotation, allusion and possible_allusion; unknown books are dropped."""
    one = texts.select(F.explode(F.regexp_extract_all(value, F.lit(r"(?s)links\.push\(\{(.*?)\}\)"), 1)).alias("b"))
    field = lambda n: F.regexp_extract("b", rf"\b{n}\s*:\s*[\"']?([^\"',}}]*)[\"']?", 1)
    book = lambda n: F.try_element_at(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv]), F.trim(field(n)))
    kind = F.when(F.trim(field("type")) == "q", "quotation").when(F.trim(field("type")) == "a", "allusion").otherwise("possible_allusion")
    rows = one.select(book("bkSource").alias("a"), F.trim(field("chpSource")).alias("ac"), book("bkTarget").alias("b"), F.trim(field("chpTarget")).alias("bc"), kind.alias("type"))
    return rows.filter("a is not null and b is not null and ac rlike '^[0-9]+$' and bc rlike '^[0-9]+$'").select(F.concat_ws(".", "a", "ac").alias("src"), F.concat_ws(".", "b", "bc").alias("tgt"), "type")
