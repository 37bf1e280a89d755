"""Resolving, merging and auditing entities of several sources."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.functions import text as T
from stemma.operators.spatial import haversine_km
from stemma.util import cut

#: The rank of a source that a policy doesn't name, and the confidence of each way to resolve.
UNKNOWN_RANK = 999
STAGE_CONFIDENCE = {"id-direct": 1.0, "name-unique": 0.95, "id-discriminant": 0.9, "base-name": 0.85, "genealogy-context": 0.85, "label-fallback": 0.8}
PRECISION_CONFIDENCE = {"Precise": 0.9, "Center": 0.7, "Related-Within": 0.5, "Rough": 0.4, "Unverified": 0.3, "Unlocated": 0.1}
PROTECTED, DRIFT_KM, CORROBORATION_KM = 0.8, 100.0, 25.0


@dataclass(frozen=True)
class MergePolicy:
    """Sources by falling precedence; fields whose lists add up; fields that one source owns."""

    precedence: tuple[str, ...]
    additive: tuple[str, ...] = ()
    exclusive: tuple[tuple[str, str], ...] = ()

    def rank(self, source: Column) -> Column:
        return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, self.precedence)), source), F.lit(0)), F.lit(UNKNOWN_RANK))


def merge_fields(claims: DataFrame, policy: MergePolicy, group: Sequence[str] = ("entity_id", "field"), order: str = "seq") -> DataFrame:
    """group columns, value, source, conflicted of claims (source_id, value, <order>): the owner's value for an owned field, else the best source's (the first of equal ones).

    conflicted: some claim says otherwise (never for owned fields). The whole is map-side aggregates.
    """
    owner = F.lit(None).cast("string")
    for field, source in policy.exclusive:
        owner = F.when(F.col("field") == field, source).otherwise(owner)
    rank = F.when(owner.isNotNull(), F.when(F.col("source_id") == owner, 0).otherwise(1)).otherwise(policy.rank(F.col("source_id")))
    rows = claims.withColumns({"__o": owner, "__r": rank})
    best = F.min_by(F.struct("value", "source_id"), F.struct("__r", order))
    said = F.countDistinct("value") + F.max(F.col("value").isNull().cast("int"))
    out = rows.groupBy(*group).agg(best.alias("b"), said.alias("n"), F.first("__o").alias("__o"))
    return out.select(*group, F.col("b.value").alias("value"), F.coalesce("__o", "b.source_id").alias("source"), ((F.col("n") > 1) & F.col("__o").isNull()).alias("conflicted"))


def merge_lists(claims: DataFrame, group: Sequence[str], values: str, order: str = "seq") -> DataFrame:
    """group columns, values: the distinct values of all lists, sorted by where they first came.

    Values are deduplicated before the lists are put together.
    """
    one = claims.select(*group, order, F.posexplode(values).alias("__i", "__v")).groupBy(*group, "__v").agg(F.min(F.struct(order, "__i")).alias("__at"))
    return one.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__v"))), lambda s: s["__v"]).alias(values))


def conflicts(claims: DataFrame, policy: MergePolicy, group: Sequence[str] = ("entity_type", "entity_id", "field")) -> DataFrame:
    """id, group columns, claims (source_id, value by precedence) where the sources disagree."""
    listed = claims.groupBy(*group).agg(F.collect_list(F.struct(policy.rank(F.col("source_id")).alias("r"), "seq", "source_id", "value")).alias("c"), (F.countDistinct("value") + F.max(F.col("value").isNull().cast("int"))).alias("n"))
    return listed.filter("n > 1").select(F.concat_ws(":", *group).alias("id"), *group, F.transform(F.array_sort("c"), lambda c: F.struct(c["source_id"], c["value"])).alias("claims"))


def source_refs(contributions: DataFrame, key: str = "entity_id") -> DataFrame:
    """key, source_id, external_id (the first), fields (distinct, in order) of contributions (source_id, external_id, field, seq)."""
    by_field = contributions.groupBy(key, "source_id", "field").agg(F.min("seq").alias("at"))
    fields = by_field.groupBy(key, "source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "field"))), lambda s: s["field"]).alias("fields"))
    ids = contributions.groupBy(key, "source_id").agg(F.min_by("external_id", F.when(F.col("external_id").isNotNull(), F.col("seq"))).alias("external_id"))
    return fields.join(ids, [key, "source_id"])


def last_by_id(records: DataFrame, keys: Sequence[str] = ("id",), order: Sequence[str] = ("seq",)) -> DataFrame:
    """Keep-last store: the last record of each id. A map-side max over a struct."""
    return records.groupBy(*keys).agg(F.max_by(F.struct(*records.columns), F.struct(*order)).alias("r")).select("r.*")


def reverse_index(resolution: DataFrame) -> DataFrame:
    """source_id, external_id, canonical_id of a resolution map (canonical_id, external_ids map, seq); of several the last."""
    rows = resolution.select("canonical_id", "seq", F.explode("external_ids").alias("source_id", "external_id"))
    return rows.groupBy("source_id", "external_id").agg(F.max_by("canonical_id", "seq").alias("canonical_id"))


def unique_keys(rows: DataFrame, key: Column, value: str, name: str) -> DataFrame:
    """key, candidates (distinct, sorted), n of each key that isn't empty."""
    return rows.select(key.alias(name), value).filter(F.length(name) > 0).groupBy(name).agg(F.array_sort(F.collect_set(value)).alias("candidates"), F.countDistinct(value).alias("n"))


def resolve_persons(persons: DataFrame, external: DataFrame, labels: DataFrame) -> DataFrame:
    """id, name, external_id, stage, candidates of persons (id, name) against external (person_id, person_name) and labels (person_id, english_label, label_type).

    Stages: the same id; a name that one external person has; the same id among several of the name (never reached before the first,
    kept for its label); a proper-name label that one has; the name without its parenthesis, by name, then by label. Otherwise external_id is
    null and candidates lists who is left (null: nobody).
    """
    by_id = external.groupBy(F.lower("person_id").alias("k_id")).agg(F.max("person_id").alias("id_hit"))
    names = unique_keys(external, T.normalize_name(F.col("person_name")), "person_id", "k").select("k", F.col("candidates").alias("nc"), F.col("n").alias("nn"))
    proper = labels.filter(F.lower("label_type").rlike("proper|name"))
    labelled = unique_keys(proper, T.normalize_name(F.col("english_label")), "person_id", "k").select("k", F.col("candidates").alias("lc"), F.col("n").alias("ln"))
    rows = persons.select("id", "name").withColumns({"k_id": F.lower("id"), "k": T.normalize_name(F.col("name")), "b": T.base_name(F.col("name"))})
    base = lambda t, a, n: t.select(F.col("k").alias("b"), F.col(a).alias(f"b{a}"), F.col(n).alias(f"b{n}"))
    j = rows.join(by_id, "k_id", "left").join(names, "k", "left").join(labelled, "k", "left").join(base(names, "nc", "nn"), "b", "left").join(base(labelled, "lc", "ln"), "b", "left")
    none = F.col("nn").isNull() & F.col("ln").isNull()
    first = lambda c: F.get(F.col(c), F.lit(0))
    stage = (
        F.when(F.col("id_hit").isNotNull(), F.struct(F.col("id_hit").alias("x"), F.lit("id-direct").alias("stage")))
        .when(F.col("nn") == 1, F.struct(first("nc").alias("x"), F.lit("name-unique").alias("stage")))
        .when(F.col("ln") == 1, F.struct(first("lc").alias("x"), F.lit("label-fallback").alias("stage")))
        .when(none & (F.col("bnn") == 1), F.struct(first("bnc").alias("x"), F.lit("base-name").alias("stage")))
        .when(none & F.col("bnn").isNull() & (F.col("bln") == 1), F.struct(first("blc").alias("x"), F.lit("base-name").alias("stage")))
    )
    left = F.when(F.col("s").isNull(), F.coalesce("nc", "lc", "bnc", "blc"))
    return j.withColumn("s", stage).select("id", "name", F.col("s.x").alias("external_id"), F.col("s.stage").alias("stage"), left.alias("candidates"))


def resolve_by_relatives(resolved: DataFrame, family: DataFrame, neighbours: DataFrame | None = None, groups: DataFrame | None = None) -> DataFrame:
    """resolved (as :func:`resolve_persons`) with the ambiguous ones settled by whose resolved relatives are neighbours of a candidate.

    family: id, relative; neighbours: a, b (external ids, both directions). With groups (a, group: external ids and what they belong to) those who
    share a group are neighbours too, without a table of all pairs; each relative counts once for a candidate. In each round the candidate with most such relatives wins if it is the only one; of
    tied ones only these stay. A round uses what the rounds before resolved, until nothing changes.
    """
    done = cut(resolved)
    pairs = cut(neighbours.select("a", "b").distinct()) if neighbours is not None else None
    members = cut(groups.select("a", "group").filter("a is not null and group is not null").distinct()) if groups is not None else None
    while True:  # each round but the last settles somebody
        open_ = done.filter("external_id is null and candidates is not null").select("id", F.explode("candidates").alias("a"))
        anchors = family.join(done.filter("external_id is not null").select(F.col("id").alias("relative"), F.col("external_id").alias("b")), "relative").select("id", "relative", "b").distinct()
        met = None if pairs is None else open_.join(anchors, "id").join(pairs, ["a", "b"]).select("id", "a", "relative")
        if members is not None:
            near = open_.join(members, "a").join(anchors.join(members.withColumnRenamed("a", "b"), "b"), ["id", "group"]).filter("a <> b").select("id", "a", "relative")
            met = near if met is None else met.unionByName(near)
        scores = met.distinct().groupBy("id", "a").agg(F.count("*").alias("n"))
        best = scores.groupBy("id").agg(F.max("n").alias("n")).join(scores, ["id", "n"]).groupBy("id").agg(F.array_sort(F.collect_list("a")).alias("winners"))
        best = cut(best)
        changed = best.filter("size(winners) = 1")
        if changed.isEmpty():
            break
        w = F.col("winners")
        one = F.size(w) == 1
        done = cut(
            done.join(best, "id", "left").select(
                "id", "name", F.when(one, F.get(w, F.lit(0))).otherwise(F.col("external_id")).alias("external_id"), F.when(one, "genealogy-context").otherwise(F.col("stage")).alias("stage"),
                F.when(one, None).when(w.isNotNull(), w).otherwise(F.col("candidates")).alias("candidates"),
            )
        )
    return done


def confidence(stage: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in STAGE_CONFIDENCE.items() for x in kv]), stage)


def best_meaning(labels: DataFrame, names: DataFrame) -> DataFrame:
    """person_id, meaning of labels (person_id, english_label, label_type, hebrew_meaning, greek_meaning, seq): the first of the best level.

    Levels: a proper name equal to the display name with a Hebrew meaning, any proper name, any label; then the same with Greek ones.
    """
    rows = labels.join(names.select("person_id", F.col("name").alias("__name")), "person_id", "left")
    proper = F.lower("label_type").rlike("proper|name")
    same = proper & T.normalize_name(F.col("english_label")).eqNullSafe(T.normalize_name(F.col("__name")))
    level = F.when(same, 1).when(proper, 2).otherwise(3)
    said = F.array(F.struct(level.alias("l"), F.col("hebrew_meaning").alias("m")), F.struct((level + 3).alias("l"), F.col("greek_meaning").alias("m")))
    one = rows.select("person_id", "seq", F.explode(F.filter(said, lambda x: F.length(x["m"]) > 0)).alias("x"))
    return one.groupBy("person_id").agg(F.min_by("x.m", F.struct("x.l", "seq")).alias("meaning"))


def exact_ids(persons: DataFrame, overrides: DataFrame | None = None, least: float = 0.85) -> DataFrame:
    """external_id, id of persons (external_id, external_confidence, corroborated, id, seq) sure enough or corroborated; later rows win, overrides (external_id, id) last."""
    sure = persons.filter(F.col("external_id").isNotNull() & ((F.col("external_confidence") >= least) | F.coalesce("corroborated", F.lit(False))))
    rows = sure.select("external_id", "id", F.lit(0).alias("o"), "seq")
    if overrides is not None:
        rows = rows.unionByName(overrides.select("external_id", "id", F.lit(1).alias("o"), F.lit(0).cast("long").alias("seq")))
    return rows.groupBy("external_id").agg(F.max_by("id", F.struct("o", "seq")).alias("id"))


def match_places(places: DataFrame, rows: DataFrame) -> DataFrame:
    """row_id, stage, n, place_id, overlap of rows (row_id, name, refs) against places (id, name, refs).

    By the same name, else the normalized one, else that without its number. Of several places the one with most references
    in common wins if it is alone; else place_id is null. n counts the candidates; rows without any are left out.
    """
    stages = ((0, F.col("name"), F.col("name")), (1, T.normalize_place(F.col("name")), T.normalize_place(F.col("name"))), (2, T.without_number(F.col("name")), F.col("name")), (3, T.normalize_place(T.without_number(F.col("name"))), T.normalize_place(F.col("name"))))
    found = None
    for stage, row_key, place_key in stages:
        r = rows.select("row_id", F.col("refs").alias("row_refs"), row_key.alias("k"))
        p = places.select(F.col("id").alias("place_id"), F.col("refs").alias("place_refs"), place_key.alias("k"))
        hit = r.join(p, "k").select("row_id", "place_id", F.lit(stage).alias("stage"), F.size(F.filter("place_refs", lambda x: F.array_contains("row_refs", x))).alias("overlap"))
        found = hit if found is None else found.unionByName(hit)
    by = Window.partitionBy("row_id")
    first = found.distinct().withColumn("best", F.min("stage").over(by)).filter("stage = best")
    ranked = first.groupBy("row_id", "stage").agg(F.count("*").alias("n"), F.max("overlap").alias("most"), F.max_by("place_id", "overlap").alias("top"), F.sort_array(F.collect_list("overlap"), asc=False).alias("o"))
    alone = (F.col("n") == 1) | ((F.col("most") > 0) & (F.get("o", F.lit(1)) < F.col("most")))
    return ranked.select("row_id", "stage", "n", F.when(alone, F.col("top")).alias("place_id"), F.col("most").alias("overlap"))


def enrich_places(places: DataFrame, matched: DataFrame) -> DataFrame:
    """id, lat, lng, confidence, source, added, protected, unknown, drifted, replaced: places after their matched rows (place_id, lat, lng, confidence, seq), one after the other.

    A place without coordinates takes the row's. One with a confidence from 0.8 keeps its own, as does one with an
    unknown confidence, and one that the row would move by more than 100 km; else the row's replace them. The second row meets what the first left.
    """
    rows = matched.groupBy("place_id").agg(F.array_sort(F.collect_list(F.struct("seq", "lat", "lng", "confidence"))).alias("rows"))
    j = places.join(rows, places["id"] == rows["place_id"], "left")
    start = F.struct(F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"), F.col("confidence").cast("double").alias("confidence"), F.lit("own").alias("source"), *[F.lit(0).alias(c) for c in ("added", "protected", "unknown", "drifted", "replaced")])

    def step(s: Column, r: Column) -> Column:
        bare = s["lat"].isNull() | s["lng"].isNull()
        km = haversine_km(s["lat"], s["lng"], r["lat"], r["lng"])
        what = F.when(bare, "added").when(s["confidence"] >= PROTECTED, "protected").when(s["confidence"].isNull(), "unknown").when(km > DRIFT_KM, "drifted").otherwise("replaced")
        take = what.isin("added", "replaced")
        new = lambda c: F.when(take, r[c]).otherwise(s[c])
        counts = [(s[c] + (what == c).cast("int")).alias(c) for c in ("added", "protected", "unknown", "drifted", "replaced")]
        return F.struct(new("lat").alias("lat"), new("lng").alias("lng"), new("confidence").alias("confidence"), F.when(what == "added", "row").when(what == "replaced", "merged").otherwise(s["source"]).alias("source"), *counts)

    empty = F.array().cast("array<struct<seq:bigint,lat:double,lng:double,confidence:double>>")
    return j.select("id", F.aggregate(F.coalesce("rows", empty), start, step).alias("s")).select("id", "s.*")


def corroborate(places: DataFrame, matched: DataFrame) -> DataFrame:
    """id, confidence, outcome, km of places (id, lat, lng, confidence, precision): a missing confidence is the nearest matched row's if it lies within 25 km, else that of the precision; else it stays unknown.

    outcome: kept, corroborated, precision, unknown; disagrees tells that the nearest row was too far.
    """
    p = places.filter("lat is not null and lng is not null")
    open_ = p.filter("confidence is null").select("id", F.col("lat").alias("la"), F.col("lng").alias("ln"))
    near = open_.join(matched, open_["id"] == matched["place_id"]).withColumn("km", haversine_km(F.col("la"), F.col("ln"), F.col("lat"), F.col("lng")))
    nearest = near.groupBy("id").agg(F.min_by(F.struct("km", F.col("confidence").alias("c")), F.struct("km", "seq")).alias("x"))
    mapped = F.try_element_at(F.create_map(*[F.lit(v) for kv in PRECISION_CONFIDENCE.items() for v in kv]), F.col("precision"))
    j = p.join(nearest, "id", "left")
    close = F.coalesce(F.col("x.km") <= CORROBORATION_KM, F.lit(False))
    outcome = F.when(F.col("confidence").isNotNull(), "kept").when(close, "corroborated").when(mapped.isNotNull(), "precision").otherwise("unknown")
    value = F.coalesce("confidence", F.when(close, F.col("x.c")), mapped)
    return j.select("id", value.alias("confidence"), outcome.alias("outcome"), F.col("x.km").alias("km"), (F.col("confidence").isNull() & (F.col("x.km") > CORROBORATION_KM)).alias("disagrees"))


def entity_marks(mentions: DataFrame, lineage: DataFrame) -> DataFrame:
    """osis_id, kind, entity_id, name of mentions (with those columns): in a verse that has a lineage (osis_id, name), persons and places of that name give way to it."""
    named = mentions.withColumn("low", F.lower("name"))
    heads = lineage.select("osis_id", F.lower("name").alias("low")).distinct()
    kept = named.join(heads, ["osis_id", "low"], "left_anti").select("osis_id", "kind", "entity_id", "name")
    return kept.unionByName(lineage.select("osis_id", F.lit("lineage").alias("kind"), F.col("person_id").alias("entity_id"), "name"))


def lookup_words(words: DataFrame, *sources: tuple[str, DataFrame]) -> DataFrame:
    """word, kind, key: for each word the first source (word, key) that has it, in the order given; kind 'none' where none has."""
    found = None
    for i, (kind, source) in enumerate(sources):
        part = source.select(F.lower("word").alias("word"), F.lit(i).alias("o"), F.lit(kind).alias("kind"), "key")
        found = part if found is None else found.unionByName(part)
    first = found.groupBy("word").agg(F.min_by(F.struct("kind", "key"), F.struct("o", "key")).alias("x"))
    return words.select(F.lower("word").alias("word")).distinct().join(first, "word", "left").select("word", F.coalesce("x.kind", F.lit("none")).alias("kind"), F.col("x.key").alias("key"))


def domain_sources(registry: DataFrame, domain: str) -> DataFrame:
    return registry.filter(F.col("domain") == domain).orderBy("precedence")


def unregistered(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Source ids that the registry lacks."""
    return rows.select("source_id").distinct().join(registry.select("source_id").distinct(), "source_id", "left_anti")
