"""One surviving record per entity, built field by field out of the records that sources have of it.

Skyline selection: a source's record of an entity is as good as its completeness
(how many fields it states), its trust (the source's precedence) and its recency
(its latest claim). Records that no other dominates in all three are the first
layer, those that only the first dominates the second, and so on. A
lexicographic policy (trust, then recency) orders the values of a layer; fields
that one layer leaves empty are filled from the next. A later layer overrules an
earlier one only for a field that a better trusted record there states. Claims are
reduced to the latest per source before they are shuffled, and an entity never has
more records than there are registered sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.util import broadcast_if_small

#: What stands for a missing value, in lower case.
PLACEHOLDERS = ("", "?", "-", "—", "...", "n/a", "na", "none", "null", "tbd", "unknown", "not known")


def stated(value: Column) -> Column:
    """The trimmed value, or null if it states nothing."""
    v = F.regexp_replace(value, r"^[\s\u00a0]+|[\s\u00a0]+$", "")
    return F.when(~F.lower(v).isin(*PLACEHOLDERS), v)


def identifier(c: Column) -> Column:
    """A source's id as registries write it: lower case, hyphens."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"^[\s\u00a0]+|[\s\u00a0]+$", "")), r"[\s\u00a0_-]+", "-")


def field_name(c: Column) -> Column:
    """A field's name without case and punctuation, for comparison."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def _age(at: Column) -> Column:
    """Less for later times; a null time is the oldest."""
    return F.coalesce(-F.unix_micros(at), F.lit(1 << 62))


def layers(records: Column) -> Column:
    """An array of structs (fields, trust, at, source) with the dominance layer of each, from 1.

    A record is dominated by one that is at least as good in all of completeness (most fields), trust (least is best) and recency, and better in one.
    """
    ordered = F.array_sort(F.transform(records, lambda r: F.struct((-r["fields"]).alias("gap"), r["trust"].alias("trust"), _age(r["at"]).alias("age"), r["source"].alias("source"))))

    def dominated(p: Column, q: Column) -> Column:
        as_good = (q["gap"] <= p["gap"]) & (q["trust"] <= p["trust"]) & (q["age"] <= p["age"])
        return as_good & ((q["gap"] < p["gap"]) | (q["trust"] < p["trust"]) | (q["age"] < p["age"]))

    # in this order every dominator comes before what it dominates
    return F.aggregate(
        ordered,
        F.array().cast("array<struct<gap:bigint,trust:int,age:bigint,source:string,layer:int>>"),
        lambda acc, x: F.concat(acc, F.array(F.struct(x["gap"], x["trust"], x["age"], x["source"], (F.coalesce(F.array_max(F.transform(F.filter(acc, lambda q: dominated(x, q)), lambda q: q["layer"])), F.lit(0)) + 1).alias("layer")))),
    )


def newest(claims: DataFrame, group: list[str], source: str, value: str, asserted_at: str) -> DataFrame:
    """group columns, source, full, at, value: of each source's claims in a group the latest that states a value, and the latest that doesn't.

    Added up on the map side. Claims of null sources don't count; of equally late values the least in order is taken.
    """
    named = claims.select(*group, identifier(F.col(source)).alias("source"), stated(F.col(value)).alias("value"), F.col(asserted_at).cast("timestamp").alias("at")).withColumn("full", F.col("value").isNotNull())
    late = F.struct(F.coalesce(-F.unix_micros("at"), F.lit(1 << 62)), "value")
    latest = named.filter("source is not null").groupBy(*group, "source", "full").agg(F.min_by(F.struct("at", "value"), late).alias("c"))
    return latest.select(*group, "source", "full", "c.at", "c.value")


def choose(facts: DataFrame, entity: list[str], field: str, trust: DataFrame) -> DataFrame:
    """entity columns, field, source, value, layer, first_layer, records: the surviving value of each field that a trusted source states.

    ``facts`` are claims as :func:`newest` gives them for the entity columns and the field. ``trust`` has a row per trusted source: those of the
    entity columns that it depends on, ``source``, ``precedence`` (least is best). Claims of other sources don't count. ``layer`` is the dominance
    layer of the value's record, ``first_layer`` the first that states the field, ``records`` how many records the entity has.
    Of equally trusted values the later stands, then the least in order. Rows with a null entity take no part. Empty tables give no rows.
    """
    shared = [c for c in trust.columns if c in entity]
    ranks = trust.groupBy(*shared, identifier(F.col("source")).alias("source")).agg(F.min("precedence").cast("int").alias("trust"))
    ranked = facts.join(broadcast_if_small(ranks), [*shared, "source"])
    by_source = ranked.groupBy(*entity, "source").agg(F.countDistinct(F.when(F.col("full"), F.col(field))).alias("fields"), F.max("at").alias("at"), F.min("trust").alias("trust"))
    points = by_source.groupBy(*entity).agg(F.collect_list(F.struct("fields", "trust", "at", "source")).alias("p"))  # at most one for each registered source
    placed = points.select(*entity, F.size("p").alias("records"), F.explode(layers(F.col("p"))).alias("r")).select(*entity, "records", F.col("r.source").alias("source"), F.col("r.layer").alias("layer"))
    stated_ = ranked.filter("full").join(placed, [*entity, "source"])
    policy = F.struct("trust", _age(F.col("at")).alias("age"), "value", "source")
    # the best of each layer by the policy, then from layer to layer
    by_layer = stated_.groupBy(*entity, field, "layer").agg(F.min(policy).alias("best"), F.max("records").alias("records"))
    filled = by_layer.groupBy(*entity, field).agg(F.min(F.struct("best", "layer")).alias("b"), F.min("layer").alias("first_layer"), F.max("records").alias("records"))
    return filled.select(*entity, field, F.col("b.best.source").alias("source"), F.col("b.best.value").alias("value"), F.col("b.layer").alias("layer"), "first_layer", "records")


def listed(entities: DataFrame, key: str, sources: str) -> DataFrame:
    """entity_id, source, listed_field: the distinct fields that an entity's sources list, by comparable names."""
    one = entities.select(F.col(key).alias("entity_id"), F.explode(sources).alias("s")).select("entity_id", identifier(F.col("s.source_id")).alias("source"), F.explode("s.fields").alias("f"))
    return one.select("entity_id", "source", field_name(F.col("f")).alias("listed_field")).distinct()
