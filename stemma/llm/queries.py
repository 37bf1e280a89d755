"""Queries of the operators for training data, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm import matching, packing, reading, survivors, tokens
from stemma.util import table


def _matches(spark: SparkSession, d: str) -> DataFrame:
    source = lambda t, *columns: matching.Source(table(spark, d, t), *columns)
    person = matching.match(source("person", "id", "name", "verse_refs", None, None, "name_meaning", "gender"), source("ext_person", "ext_id", "english_label", "verse_refs", None, None, "meaning", "gender"))
    place = matching.match(source("place", "id", "name", "verse_refs", "lat", "lng"), source("geo_row", "id", "name", "verse_refs", "lat", "lng"))
    return person.withColumn("kind", F.lit("person")).unionByName(place.withColumn("kind", F.lit("place")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d).select("kind", F.col("left_id").alias("id"), F.col("right_id").alias("ext_id"))


def p3_confidence(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d).select("kind", F.col("left_id").alias("id"), F.col("right_id").alias("ext_id"), F.round("confidence", 6).alias("confidence"))


def _survivors(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "conflict_record")
    claims = records.select("entity_type", "entity_id", "field", F.explode("claims").alias("c")).select("entity_type", "entity_id", "field", "c.source_id", "c.value", "c.asserted_at")
    # the last claim of each source first, then the entities' lists: the hot groups are small by then
    facts = survivors.newest(claims, ["entity_type", "entity_id", "field"], "source_id", "value", "asserted_at")
    entities = [survivors.listed(table(spark, d, t), "id", "sources").withColumn("entity_type", F.lit(t)) for t in ("person", "place")]
    known = entities[0].unionByName(entities[1])
    facts = facts.withColumn("listed_field", survivors.field_name(F.col("field"))).join(known, ["entity_type", "entity_id", "source", "listed_field"], "left_semi")
    trust = table(spark, d, "source_registry").select(F.col("domain").alias("entity_type"), F.col("source_id").alias("source"), "precedence")
    return survivors.choose(facts, ["entity_type", "entity_id"], "field", trust)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _survivors(spark, d).select("entity_id", "field", F.col("source").alias("source_id"), "value")


def p5_layers(spark: SparkSession, d: str) -> DataFrame:
    """The dominance layer of each surviving value's record, and the first that states the field."""
    return _survivors(spark, d).select("entity_id", "field", "layer", "first_layer", "records")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


def p7_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Decoded texts beside the originals: one row per document, which should all be equal."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    back = tokens.decode(tokens.encode(docs, "doc_id", "text"), "doc_id")
    return back.select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Documents in containers; copies of a text (but for case and blanks) are one duplicate cluster."""
    docs = table(spark, d, "documents")
    text = F.lower(F.regexp_replace(F.trim("text"), r"\s+", " "))
    items = tokens.lengths(docs.select("doc_id", "source", F.when(F.length(text) > 0, F.xxhash64(text)).alias("cluster"), "text"), ["doc_id", "source", "cluster"], "text")
    profiles = table(spark, d, "pack_profile")
    return packing.pack(items, profiles, "doc_id")


def p8_check(spark: SparkSession, d: str) -> DataFrame:
    """What the containers keep, by capacity: items, tokens, items in more or less than all their tokens, containers over capacity, items split though they fit, clusters that share a container before all room is used; and whether there are at most 3 % more containers than tokens ask for, and two."""
    c = p8_containers(spark, d)
    docs = tokens.lengths(table(spark, d, "documents").select("doc_id", "text"), ["doc_id"], "text").groupBy("doc_id").agg(F.sum("n_tokens").alias("want"))
    by_item = c.groupBy("capacity", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("pieces")).join(docs, "doc_id")
    items = by_item.groupBy("capacity").agg(F.count("*").alias("items"), F.sum("n").alias("tokens"), F.count(F.when(F.col("n") != F.col("want"), 1)).alias("wrong"), F.count(F.when((F.col("pieces") > 1) & (F.col("want") <= F.col("capacity")), 1)).alias("split"))
    full = c.filter("container_id is not null").groupBy("capacity", "container_id").agg(F.sum("n_tokens").alias("n"))
    boxes = full.groupBy("capacity").agg(F.count(F.when(F.col("n") > F.col("capacity"), 1)).alias("over"), F.count("*").alias("boxes"))
    tight = F.col("boxes") <= F.ceil(F.col("tokens") / F.col("capacity")) * 1.03 + 2
    return items.join(boxes, "capacity").select("capacity", "items", "wrong", "split", "over", tight.alias("tight"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.hard_documents(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "reading_labels")).distinct()


def p9_levels(spark: SparkSession, d: str) -> DataFrame:
    """Every document's level, rounded, with its words and whether it counts as English; null without words."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    model = reading.train(docs, table(spark, d, "reading_labels"))
    scored = reading.score(docs, model, "doc_id", "text")
    return scored.select("doc_id", F.floor(F.col("score") + 0.5).cast("int").alias("level"), (F.col("english") >= reading.ENGLISH).alias("is_english"), "words")


QUERIES = {f.__name__: f for f in (p3_found, p3_confidence, p5_found, p5_layers, p7_ids, p7_roundtrip, p8_containers, p8_check, p9_found, p9_levels)}
_STATED = "nullif(trim(c.value, chr(32) || chr(9) || chr(10) || chr(13) || chr(160)), '')"
_SOURCE = r"regexp_replace(lower(trim(%s)), '[\s_-]+', '-', 'g')"
_SQL_CLAIMS = rf"""
with k as (select entity_type, entity_id, field, unnest(claims) c from conflict_record),
c as (select entity_type, entity_id, field, {_SOURCE % "c.source_id"} source_id, {_STATED} v, c.asserted_at at_ from k),
e as (select 'person' entity_type, id, unnest(sources) s from person union all select 'place', id, unnest(sources) from place),
f as (select entity_type, id, {_SOURCE % "s.source_id"} source_id, unnest(s.fields) f from e),
l as (select distinct entity_type, id entity_id, source_id, regexp_replace(lower(f), '[^a-z0-9]', '', 'g') f from f),
x as (select c.*, precedence, lower(v) in ('?', '-', '—', '...', 'n/a', 'na', 'none', 'null', 'tbd', 'unknown', 'not known') is false ok
  from c join source_registry r on r.domain = entity_type and r.source_id = c.source_id
  semi join l on l.entity_type = c.entity_type and l.entity_id = c.entity_id and l.source_id = c.source_id and l.f = regexp_replace(lower(c.field), '[^a-z0-9]', '', 'g'))
"""
SQL = {
    "p5_found": _SQL_CLAIMS
    + """select entity_id, field, source_id, v "value" from x where ok
qualify row_number() over (partition by entity_type, entity_id, field order by precedence, at_ desc nulls last, v) = 1""",
    "p5_layers": _SQL_CLAIMS.replace("with k as", "with recursive k as", 1)
    + """, s as (select entity_type, entity_id, field, source_id, precedence, ok, max(at_) at_ from x group by all),
rec as (select entity_type, entity_id, source_id, min(precedence) p, coalesce(max(at_), timestamptz '0001-01-01') at_, count(distinct case when ok then field end) n from s group by all),
dom as (select a.entity_type, a.entity_id, a.source_id hi, b.source_id lo from rec a join rec b using (entity_type, entity_id)
  where a.p <= b.p and a.at_ >= b.at_ and a.n >= b.n and (a.p < b.p or a.at_ > b.at_ or a.n > b.n)),
lay as (select entity_type, entity_id, source_id, 1 k from rec union select dom.entity_type, dom.entity_id, lo, k + 1 from lay join dom on dom.entity_type = lay.entity_type and dom.entity_id = lay.entity_id and hi = source_id),
l1 as (select entity_type, entity_id, source_id, max(k) layer from lay group by all), ly as (select *, count(*) over (partition by entity_type, entity_id) records from l1)
select x.entity_id, field, layer::int layer, (min(layer) over (partition by x.entity_type, x.entity_id, field))::int first_layer, records::int records
from x join ly on ly.entity_type = x.entity_type and ly.entity_id = x.entity_id and ly.source_id = x.source_id where ok
qualify row_number() over (partition by x.entity_type, x.entity_id, field order by precedence, x.at_ desc nulls last, v) = 1""",
    # what must hold of any packing
    "p8_check": "select distinct capacity::bigint capacity, (select count(distinct doc_id) from documents) items, 0::bigint \"wrong\", 0::bigint \"split\", 0::bigint \"over\", true tight from pack_profile where capacity is not null",
    "p7_roundtrip": "select doc_id, length(coalesce(text, '')) n_chars, md5(coalesce(text, '')) digest from documents",
}
