"""Queries of entity resolution, family links and quality checks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.functions import text as T
from stemma.operators import entities as E
from stemma.operators import genealogy as N
from stemma.operators import quality as Q
from stemma.plans import adapters as A
from stemma.util import cut, keep_first, table

MALE, FEMALE = ("male", "m"), ("female", "f")
POLICY = E.MergePolicy(("scribe-ledger", "north-codex", "ember-catalog", "stone-index", "lampstand"), exclusive=(("precision", "lampstand"),))


def _claims(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conflict_record").select("entity_type", "entity_id", "field", F.col("seq").alias("row_seq"), F.posexplode("claims").alias("i", "c"))
    return c.select("entity_type", "entity_id", "field", "c.source_id", "c.value", (F.col("row_seq") * 100 + F.col("i")).alias("seq"))


def field_merge(spark: SparkSession, d: str) -> DataFrame:
    return E.merge_fields(_claims(spark, d), POLICY)


def conflict_records(spark: SparkSession, d: str) -> DataFrame:
    c = E.conflicts(_claims(spark, d), POLICY)
    return c.select("id", F.array_join(F.transform("claims", lambda x: F.concat_ws("=", F.coalesce(x["source_id"], F.lit("?")), F.coalesce(x["value"], F.lit("?")))), "|").alias("claims"))


def conflict_summary(spark: SparkSession, d: str) -> DataFrame:
    return E.last_by_id(table(spark, d, "conflict_record").select("id", "entity_type", "seq")).groupBy("entity_type").agg(F.count("*").alias("n"))


def conflict_latest(spark: SparkSession, d: str) -> DataFrame:
    return E.last_by_id(table(spark, d, "conflict_record").select("id", "entity_type", "entity_id", "field", "seq"))


def source_refs(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "person").select(F.col("id").alias("entity_id"), "seq", F.posexplode("sources").alias("i", "s"))
    c = p.select("entity_id", "seq", "i", "s.source_id", "s.external_id", F.posexplode("s.fields").alias("j", "field")).withColumn("seq", F.col("seq") * 10000 + F.col("i") * 100 + F.col("j"))
    r = E.source_refs(c.filter("source_id is not null and field is not null"))
    return r.select("entity_id", "source_id", "external_id", F.array_join("fields", "|").alias("fields"))


def merged_refs(spark: SparkSession, d: str) -> DataFrame:
    """All references of the persons of one name, in order of first appearance."""
    p = table(spark, d, "person").select("name", "seq", "verse_refs")
    return E.merge_lists(p, ["name"], "verse_refs").select("name", F.array_join("verse_refs", " ").alias("refs"))


def reverse_ids(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "person").select(F.col("id").alias("canonical_id"), "seq", F.explode("sources").alias("s")).filter("s.external_id is not null and s.source_id is not null")
    m = p.select("canonical_id", "seq", F.create_map("s.source_id", "s.external_id").alias("external_ids"))
    return E.reverse_index(m)


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ext_person").select(F.col("ext_id").alias("person_id"), "english_label", F.coalesce("label_type", F.lit("")).alias("label_type"), "meaning", "gender", "seq")


def label_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Normalized labels with the external persons that have them."""
    return E.unique_keys(_labels(spark, d), T.normalize_name(F.col("english_label")), "person_id", "label").select("label", F.array_join("candidates", " ").alias("candidates"), "n")


def ambiguous_names(spark: SparkSession, d: str) -> DataFrame:
    return label_candidates(spark, d).filter("n > 1").orderBy(F.desc("n"), "label").limit(10).select("label", "n")


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    ext = _labels(spark, d)
    persons = table(spark, d, "person").groupBy("id").agg(F.min_by("name", "seq").alias("name"))
    people = ext.filter("gender is not null").select("person_id", F.col("english_label").alias("person_name"))
    return E.resolve_persons(persons, people, ext.select("person_id", "english_label", "label_type"))


def name_resolution(spark: SparkSession, d: str) -> DataFrame:
    r = _resolved(spark, d)
    return r.select("id", "external_id", "stage", E.confidence(F.col("stage")).alias("confidence"), F.size("candidates").alias("n"))


def resolution_outcomes(spark: SparkSession, d: str) -> DataFrame:
    r = _resolved(spark, d)
    outcome = F.coalesce("stage", F.when(F.col("candidates").isNull(), "no-match").otherwise("ambiguous"))
    return r.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def relatives_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Ambiguous persons settled by their relatives, to a fixed point."""
    rel = table(spark, d, "relationship").filter("person_from is not null and person_to is not null")
    family = N.neighbours(rel, "person_from", "person_to").select(F.col("a").alias("id"), F.col("b").alias("relative"))
    ext = table(spark, d, "ext_person").select("ext_id", F.explode("verse_refs").alias("v")).filter("v is not null").distinct()
    # external persons of one chapter count as neighbours
    key = F.concat_ws(".", F.split_part("v", F.lit("."), F.lit(1)), F.split_part("v", F.lit("."), F.lit(2)))
    out = E.resolve_by_relatives(_resolved(spark, d), family, groups=ext.select(F.col("ext_id").alias("a"), key.alias("group")))
    return out.select("id", "external_id", "stage")


def best_meaning(spark: SparkSession, d: str) -> DataFrame:
    ext = _labels(spark, d)
    names = ext.select("person_id", F.initcap("english_label").alias("name")).dropDuplicates(["person_id"])
    hebrew = F.when(F.col("seq") % 2 == 0, F.col("meaning"))
    return E.best_meaning(ext.withColumns({"hebrew_meaning": hebrew, "greek_meaning": F.when(F.col("seq") % 2 == 1, F.col("meaning"))}), names)


def exact_ids(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "person").select("id", "external_confidence", F.get("sources", F.lit(0)).alias("s"), "seq")
    return E.exact_ids(p.select("id", "external_confidence", F.col("s.external_id").alias("external_id"), (F.col("s.note") == "derived").alias("corroborated"), "seq"))


def _places(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "place")
    ok = F.col("lat").between(-90, 90) & F.col("lng").between(-180, 180)
    return keep_first(rows, ["id"], ["seq"]).select("id", "name", F.col("verse_refs").alias("refs"), F.when(ok, F.col("lat")).alias("lat"), F.when(ok, F.col("lng")).alias("lng"), "confidence", "precision")


def _matched(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "geo_row").select(F.col("id").alias("row_id"), "name", F.col("verse_refs").alias("refs"))
    return E.match_places(_places(spark, d), rows)


def place_match(spark: SparkSession, d: str) -> DataFrame:
    return _matched(spark, d)


def _geo(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "geo_row").filter("lat is not null and lng is not null").select(F.col("id").alias("row_id"), "lat", "lng", "confidence", "seq")
    return g.join(_matched(spark, d).filter("place_id is not null").select("row_id", "place_id"), "row_id")


def place_enrichment(spark: SparkSession, d: str) -> DataFrame:
    return E.enrich_places(_places(spark, d), _geo(spark, d))


def place_corroboration(spark: SparkSession, d: str) -> DataFrame:
    c = E.corroborate(_places(spark, d), _geo(spark, d))
    return c.select("id", "confidence", "outcome", F.round("km", 4).alias("km"), "disagrees")


def entity_marks(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "person").select("id", "name", F.explode("verse_refs").alias("osis_id")).filter("osis_id is not null").select("osis_id", F.lit("person").alias("kind"), F.col("id").alias("entity_id"), "name").distinct()
    heads = table(spark, d, "lineage_head")
    # a head is present in the passages that a person of its name is mentioned in by an id of the head's branch list
    lineage = m.join(F.broadcast(heads), "name").select("osis_id", "person_id", "name").distinct()
    return E.entity_marks(m, lineage)


def word_lookup(spark: SparkSession, d: str) -> DataFrame:
    word = lambda t, c, k: table(spark, d, t).select(F.col(c).alias("word"), F.col(k).cast("string").alias("key")).filter("word is not null")
    words = word("ext_person", "english_label", "ext_id").select("word")
    return E.lookup_words(words, ("person", word("person", "name", "id")), ("place", word("place", "name", "id")), ("event", word("bible_events", "title", "event_id")))


def registry_by_domain(spark: SparkSession, d: str) -> DataFrame:
    return E.domain_sources(table(spark, d, "source_registry"), "place")


def unregistered_sources(spark: SparkSession, d: str) -> DataFrame:
    return E.unregistered(_claims(spark, d).filter("source_id is not null"), table(spark, d, "source_registry"))


def family_links(spark: SparkSession, d: str) -> DataFrame:
    return N.family_links(table(spark, d, "people"), male=MALE, female=FEMALE)


def family_stats(spark: SparkSession, d: str) -> DataFrame:
    return N.family_stats(table(spark, d, "people"), male=MALE, female=FEMALE)


def family_relatives(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "people").select("seq", F.array_join(F.concat(*[N.id_list(F.col(c)) for c in N.FAMILY]), " ").alias("relatives"))


def _links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "relationship").select("id", "person_from", "person_to", "type", "seq").filter("person_from is not null and person_to is not null")


def first_parents(spark: SparkSession, d: str) -> DataFrame:
    return N.parents(_links(spark, d))


def both_lines(spark: SparkSession, d: str) -> DataFrame:
    return N.parents(_links(spark, d)).filter("both").select("child")


def many_fathers(spark: SparkSession, d: str) -> DataFrame:
    return N.many_fathers(_links(spark, d))


def relationship_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d).groupBy("type").agg(F.count("*").alias("n"))


def neighbour_sets(spark: SparkSession, d: str) -> DataFrame:
    return N.neighbours(_links(spark, d), "person_from", "person_to")


def _roots(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineage_head").select(F.col("person_id").alias("node"))


def family_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Everyone below each head of a line, with the distance."""
    return N.below(_links(spark, d), _roots(spark, d))


def descendant_counts(spark: SparkSession, d: str) -> DataFrame:
    return family_descendants(spark, d).filter("depth > 0").groupBy("root").agg(F.count("*").alias("below"))


def ancestry_paths(spark: SparkSession, d: str) -> DataFrame:
    """The mothers' line of every child of a mother; ancestry_lines has everyone's."""
    p = N.parents(_links(spark, d))
    rows = N.ancestry(p, p.filter("mother is not null").select(F.col("child").alias("node")), maternal=True)
    return rows.select("node", F.array_join("path", ">").alias("path"))


def ancestry_lines(spark: SparkSession, d: str) -> DataFrame:
    """The fathers' and the mothers' line of every child of a parent."""
    p = cut(N.parents(_links(spark, d)))
    starts = p.select(F.col("child").alias("node"))
    lines = [N.ancestry(p, starts, m).select("node", F.lit(n).alias("line"), F.array_join("path", ">").alias("path")) for n, m in (("father", False), ("mother", True))]
    return lines[0].unionByName(lines[1])


def family_names(spark: SparkSession, d: str) -> DataFrame:
    return N.names(_links(spark, d), table(spark, d, "person"))


def tree_root(spark: SparkSession, d: str) -> DataFrame:
    """Whom the most frequent name of the tree means: the one with most below."""
    named = family_names(spark, d)
    often = named.groupBy(F.lower("name").alias("low")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "low").limit(1).first()
    same = named.filter(F.lower("name") == (often[0] if often else ""))
    counts = N.below(_links(spark, d), same.select(F.col("id").alias("node"))).filter("depth > 0").groupBy(F.col("root").alias("id")).agg(F.count("*").alias("below"))
    return N.find_root(often[0] if often else "", named, table(spark, d, "person"), counts)


def _checked(spark: SparkSession, d: str) -> DataFrame:
    """Documents as verses with every kind of flaw: each ninth a range over two, some backwards."""
    v = A.verses(spark, d)
    end = F.when(F.col("seq") % 9 == 0, F.col("verse") + 2).when(F.col("seq") % 31 == 0, F.col("verse"))
    return v.withColumn("verse_end", end)


def _check(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        f = getattr(Q, name)
        v = _checked(spark, d)
        return f(v) if name == "duplicates" else f(v, table(spark, d, "ref_counts"))

    run.__name__ = f"quality_{name}"
    run.__doc__ = getattr(Q, name).__doc__
    return run


CHECKS = ("duplicates", "unknown_books", "blank_texts", "bad_numbers", "inverted", "overlaps", "too_many_chapters", "missing_chapters", "interior_gaps", "overruns", "trailing_gaps")


def quality_empty(spark: SparkSession, d: str) -> DataFrame:
    return Q.empty(A.verses(spark, d), spark.createDataFrame([("en",), ("la",), ("he",)], "translation_id string"))


def versification(spark: SparkSession, d: str) -> DataFrame:
    return Q.versification(_checked(spark, d))


def versification_diff(spark: SparkSession, d: str) -> DataFrame:
    return Q.versification_diff(table(spark, d, "ref_counts"), Q.versification(_checked(spark, d)))


QUERIES = {
    f.__name__: f
    for f in (
        field_merge, conflict_records, conflict_summary, conflict_latest, source_refs, merged_refs, reverse_ids, label_candidates, ambiguous_names, name_resolution, resolution_outcomes, relatives_resolution,
        best_meaning, exact_ids, place_match, place_enrichment, place_corroboration, entity_marks, word_lookup, registry_by_domain, unregistered_sources, family_links, family_stats, family_relatives, first_parents,
        both_lines, many_fathers, relationship_breakdown, neighbour_sets, family_descendants, descendant_counts, ancestry_paths, ancestry_lines, family_names, tree_root, quality_empty, versification, versification_diff,
        *map(_check, CHECKS),
    )
}

_PREC = "list_position(['scribe-ledger', 'north-codex', 'ember-catalog', 'stone-index', 'lampstand'], c.source_id)"
_CL = f"""with k as (select entity_type, entity_id, field, seq, unnest(claims) c, generate_subscripts(claims, 1) - 1 i from conflict_record),
cl as (select entity_type, entity_id, field, c.source_id source_id, c.value v, seq * 100 + i seq, coalesce(nullif({_PREC}, 0), 999) r from k)"""
_NORM = r"trim(regexp_replace(regexp_replace(trim(lower(%s)), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_RES = f"""with ps as (select id, arg_min(name, seq) n from person group by id), ex as (select ext_id, english_label l, coalesce(label_type, '') t, gender from ext_person),
nm as (select {_NORM % 'l'} k, count(distinct ext_id) n, min(ext_id) x from ex where gender is not null and {_NORM % 'l'} <> '' group by 1),
lb as (select {_NORM % 'l'} k, count(distinct ext_id) n, min(ext_id) x from ex where regexp_matches(lower(t), 'proper|name') and {_NORM % 'l'} <> '' group by 1),
q as (select id, n, {_NORM % 'n'} k, case when contains(n, '(') and {_NORM % "split_part(n, '(', 1)"} not in ('', {_NORM % 'n'}) then {_NORM % "split_part(n, '(', 1)"} end b from ps),
j as (select q.id, nm.n nn, nm.x nx, lb.n ln, lb.x lx, a.n bn, a.x bx, c.n cn, c.x cx, e.x idx from q left join nm on nm.k = q.k left join lb on lb.k = q.k left join nm a on a.k = q.b left join lb c on c.k = q.b
  left join (select lower(ext_id) lo, max(ext_id) x from ex where gender is not null group by 1) e on e.lo = lower(q.id)),
res as (select id, case when idx is not null then 'id-direct' when nn = 1 then 'name-unique' when ln = 1 then 'label-fallback' when nn is null and ln is null and bn = 1 then 'base-name' when nn is null and ln is null and bn is null and cn = 1 then 'base-name' end stage,
  case when idx is not null then idx when nn = 1 then nx when ln = 1 then lx when nn is null and ln is null and bn = 1 then bx when nn is null and ln is null and bn is null and cn = 1 then cx end external_id, coalesce(nn, ln, bn, cn) cand from j)"""
_PL = r"""with pl as (select * from place qualify row_number() over (partition by id order by seq) = 1)"""
_NPL = r"trim(replace(regexp_replace(regexp_replace(regexp_replace(lower(%s), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'), '\bmount\b', 'mt', 'g'), 'city of', ''))"
_MATCH = rf"""{_PL}, g as (select id row_id, name n, verse_refs refs, regexp_replace(name, '\s+\d+$', '') b from geo_row),
h as (select row_id, pl.id pid, 0 stage, verse_refs vr, refs from g join pl on pl.name = n union all select row_id, pl.id, 1, verse_refs, refs from g join pl on {_NPL % 'pl.name'} = {_NPL % 'n'}
  union all select row_id, pl.id, 2, verse_refs, refs from g join pl on pl.name = b union all select row_id, pl.id, 3, verse_refs, refs from g join pl on {_NPL % 'pl.name'} = {_NPL % 'b'}),
f as (select *, len(list_filter(coalesce(vr, []), lambda x: list_contains(coalesce(refs, []), x)))::int ov from h qualify stage = min(stage) over (partition by row_id)),
m as (select row_id, stage, count(*) n, max(ov) overlap, arg_max(pid, ov) top, count(*) filter (where ov = mx) ties from (select *, max(ov) over (partition by row_id) mx from f) group by all),
mt as (select row_id, stage, n, case when n = 1 or (overlap > 0 and ties = 1) then top end place_id, overlap from m)"""
_KM = "2 * 6371 * atan2(sqrt(a), sqrt(1 - a))"
_HAV = "pow(sin(radians(g.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(g.lat)) * pow(sin(radians(g.lng - p.lng) / 2), 2)"
_REL = "with recursive rel as (select * from relationship where person_from is not null and person_to is not null), kid as (select distinct person_from p, person_to c from rel where \"type\" in ('father-of', 'mother-of'))"
_LISTS = "list_filter(list_transform(string_split(coalesce(%s, ''), ','), lambda x: trim(x)), lambda x: x <> '')"
_FAM = f"""with pp as (select trim(person_lookup) me, seq, lower(trim(gender)) g, father, mother, partners, siblings, children from people where trim(person_lookup) <> ''),
l as (select me, seq, g, 0 o, 'father-of' t, false dir, unnest({_LISTS % 'father'}) x from pp union all select me, seq, g, 1, 'mother-of', false, unnest({_LISTS % 'mother'}) from pp union all
  select me, seq, g, 2, 'spouse-of', true, unnest({_LISTS % 'partners'}) from pp union all select me, seq, g, 3, 'sibling-of', true, unnest({_LISTS % 'siblings'}) from pp union all
  select me, seq, g, 4, case when g in ('male', 'm') then 'father-of' when g in ('female', 'f') then 'mother-of' end, true, unnest({_LISTS % 'children'}) from pp)"""
_VV = f"""with {A.VERSES}, vs as (select *, case when seq % 9 = 0 then verse + 2 when seq % 31 = 0 then verse end ve from verses),
f1 as (select * from vs qualify row_number() over (partition by translation_id, osis_id order by seq) = 1), bk as (select distinct book from ref_counts),
kn as (select * from f1 where book in (select book from bk)), ok as (select * from kn where chapter >= 1 and verse >= 1 and (ve is null or ve > verse)),
cv as (select translation_id, book, chapter, osis_id, seq, unnest(range(verse, coalesce(ve, verse) + 1)) n from ok), ch as (select translation_id, book, chapter, max(coalesce(ve, verse)) last from ok group by all)"""


def _f(check: str, severity: str, where: str, rest: str, detail: str = "null") -> str:
    return f"{_VV} select translation_id, '{check}' \"check\", '{severity}' severity, {where} \"where\", ({detail})::varchar detail from {rest}"


SQL = {
    "field_merge": f"""{_CL}, g as (select entity_id, field, arg_min({{'v': v, 's': source_id}}, (case when field = 'precision' then case when source_id = 'lampstand' then 0 else 1 end else r end, seq)) b, count(distinct v) + max((v is null)::int) n from cl group by all)
select entity_id, field, b.v as "value", case when field = 'precision' then 'lampstand' else b.s end source, n > 1 and field <> 'precision' conflicted from g""",
    "conflict_records": f"""{_CL} select entity_type || ':' || entity_id || ':' || field id, string_agg(coalesce(source_id, '?') || '=' || coalesce(v, '?'), '|' order by r, seq, source_id nulls first, v nulls first) claims from cl group by entity_type, entity_id, field having count(distinct v) + max((v is null)::int) > 1""",
    "conflict_summary": "select entity_type, count(distinct id) n from conflict_record group by 1",
    "conflict_latest": "select id, entity_type, entity_id, field, seq from conflict_record qualify row_number() over (partition by id order by seq desc) = 1",
    "source_refs": """with p as (select id, seq, unnest(sources) s, generate_subscripts(sources, 1) - 1 i from person), c as (select id, s.source_id src, s.external_id x, unnest(s.fields) f, seq * 10000 + i * 100 + generate_subscripts(s.fields, 1) - 1 k from p),
d as (select id, src, f, min(k) k from c where src is not null and f is not null group by all), e as (select id, src, arg_min(x, k) x from c where src is not null and f is not null and x is not null group by all)
select d.id entity_id, d.src source_id, any_value(e.x) external_id, string_agg(f, '|' order by k) fields from d left join e on e.id = d.id and e.src = d.src group by all""",
    "merged_refs": "with p as (select name, seq, unnest(verse_refs) v, generate_subscripts(verse_refs, 1) i from person), d as (select name, v, min((seq, i)) k from p where v is not null group by all) select name, string_agg(v, ' ' order by k) refs from d group by 1",
    "reverse_ids": "with p as (select id, seq, unnest(sources) s from person) select s.source_id source_id, s.external_id external_id, arg_max(id, seq) canonical_id from p where s.source_id is not null and s.external_id is not null group by all",
    "label_candidates": f"""select {_NORM % 'english_label'} "label", array_to_string(list_sort(list(distinct ext_id)), ' ') candidates, count(distinct ext_id) n from ext_person where {_NORM % 'english_label'} <> '' group by 1""",
    "ambiguous_names": f"""select {_NORM % 'english_label'} "label", count(distinct ext_id) n from ext_person where {_NORM % 'english_label'} <> '' group by 1 having n > 1 order by n desc, 1 limit 10""",
    "name_resolution": f"{_RES} select id, external_id, stage, case stage when 'id-direct' then 1.0 when 'name-unique' then 0.95 when 'base-name' then 0.85 when 'label-fallback' then 0.8 end::double confidence, case when stage is null then cand end::int n from res",
    "resolution_outcomes": f"{_RES} select coalesce(stage, case when cand is null then 'no-match' else 'ambiguous' end) outcome, count(*) n from res group by 1",
    "best_meaning": f"""with r as (select ext_id, seq, meaning m, regexp_matches(lower(coalesce(label_type, '')), 'proper|name') p, english_label l from ext_person where length(meaning) > 0)
select ext_id person_id, arg_min(m, (case when p then 1 else 3 end + case when seq % 2 = 1 then 3 else 0 end, seq)) meaning from r group by 1""",
    "exact_ids": "with p as (select id, seq, external_confidence c, sources[1].external_id x, coalesce(sources[1].note = 'derived', false) d from person) select x external_id, arg_max(id, seq) id from p where x is not null and (c >= 0.85 or d) group by 1",
    "place_match": f"{_MATCH} select * from mt",
    "place_corroboration": f"""{_MATCH}, p as (select id, case when lat between -90 and 90 and lng between -180 and 180 then lat end lat, case when lat between -90 and 90 and lng between -180 and 180 then lng end lng, confidence c, precision pr from pl),
gg as (select mt.place_id, lat, lng, confidence, seq from geo_row join mt on mt.row_id = geo_row.id where lat is not null and lng is not null and mt.place_id is not null),
k as (select p.id, g.confidence gc, g.seq, {_HAV} a from p join gg g on g.place_id = p.id where c is null and p.lat is not null and p.lng is not null), n as (select id, arg_min({{'c': gc}}, ({_KM}, seq)).c gc, min({_KM}) km from k group by 1),
o as (select p.*, gc, km, case pr when 'Precise' then 0.9 when 'Center' then 0.7 when 'Related-Within' then 0.5 when 'Rough' then 0.4 when 'Unverified' then 0.3 when 'Unlocated' then 0.1 end::double pc from p left join n using (id) where lat is not null and lng is not null)
select id, coalesce(c, case when km <= 25 then gc end, pc) confidence, case when c is not null then 'kept' when km <= 25 then 'corroborated' when pc is not null then 'precision' else 'unknown' end outcome, round(km, 4) km, case when c is not null then false else km > 25 end disagrees from o""",
    "entity_marks": """with m as (select distinct unnest(verse_refs) o, id, name from person), v as (select * from m where o is not null), h as (select distinct o, person_id, v.name from v join lineage_head l on l.name = v.name)
select o osis_id, 'person' kind, id entity_id, name "name" from v where not exists (select 1 from h where h.o = v.o and lower(h.name) = lower(v.name)) union all select o, 'lineage', person_id, name from h""",
    "word_lookup": """with w as (select distinct lower(english_label) word from ext_person where english_label is not null), s as (select lower(name) word, 0 o, 'person' k, id key from person union all select lower(name), 1, 'place', id from place union all select lower(title), 2, 'event', event_id from bible_events),
f as (select word, min((o, k, key)) x from s where word is not null group by 1) select w.word, coalesce(x[2], 'none') kind, x[3] as "key" from w left join f using (word)""",
    "registry_by_domain": "select * from source_registry where domain = 'place'",
    "unregistered_sources": f"{_CL} select distinct source_id from cl where source_id is not null and source_id not in (select source_id from source_registry)",
    "family_links": f"""{_FAM}, k as (select *, case when t in ('spouse-of', 'sibling-of') then least(me, x) || '→' || t || '→' || greatest(me, x) when dir then me || '→' || t || '→' || x else x || '→' || t || '→' || me end id from l where t is not null and me <> x and x in (select me from pp))
select id, case when dir then me else x end person_from, case when dir then x else me end person_to, t "type" from k qualify row_number() over (partition by id order by seq, o) = 1""",
    "family_stats": f"{_FAM} select (select count(distinct me) from pp) persons, count(*) filter (where x not in (select me from pp)) dangling, count(*) filter (where o = 4 and t is null and x in (select me from pp)) skipped from l",
    "family_relatives": f"select seq, array_to_string({_LISTS % 'father'} || {_LISTS % 'mother'} || {_LISTS % 'partners'} || {_LISTS % 'children'} || {_LISTS % 'siblings'}, ' ') relatives from people",
    "first_parents": f"""{_REL}, f as (select person_to child, arg_min(person_from, (seq, person_from)) filter (where "type" = 'father-of') father, arg_min(person_from, (seq, person_from)) filter (where "type" = 'mother-of') mother from rel where "type" in ('father-of', 'mother-of') group by 1)
select child, father, mother, coalesce(father, mother) parent, father is not null and mother is not null as "both" from f""",
    "both_lines": f"""{_REL} select person_to child from rel where "type" in ('father-of', 'mother-of') group by 1 having count(distinct "type") = 2""",
    "many_fathers": f"""{_REL} select person_to child, count(distinct person_from) fathers from rel where "type" = 'father-of' group by 1 having fathers > 1""",
    "relationship_breakdown": f'{_REL} select "type", count(*) n from rel group by 1',
    "neighbour_sets": f"{_REL} select person_from a, person_to b from rel union select person_to, person_from from rel",
    "family_descendants": f"{_REL}, r as (select person_id root, person_id node, 0 depth from lineage_head union select r.root, c, depth + 1 from r join kid on kid.p = r.node where depth < 200) select root, node, min(depth) depth from r group by all",
    "descendant_counts": f"{_REL}, r as (select person_id root, person_id node from lineage_head union select r.root, c from r join kid on kid.p = r.node) select root, count(*) below from r where root <> node group by 1",
    "ancestry_paths": f"""{_REL}, f as (select person_to child, arg_min(person_from, (seq, person_from)) filter (where "type" = 'father-of') fa, arg_min(person_from, (seq, person_from)) filter (where "type" = 'mother-of') mo from rel where "type" in ('father-of', 'mother-of') group by 1),
u as (select child, coalesce(mo, fa) up from f), w as (select child node, child hit, [child] path, 0 k from f where mo is not null union all select node, up, list_prepend(up, path), k + 1 from w join u on u.child = w.hit where not list_contains(path, up))
select node, array_to_string(arg_max(path, k), '>') path from w group by 1""",
    "ancestry_lines": f"""{_REL}, f as (select person_to child, arg_min(person_from, (seq, person_from)) filter (where "type" = 'father-of') fa, arg_min(person_from, (seq, person_from)) filter (where "type" = 'mother-of') mo from rel where "type" in ('father-of', 'mother-of') group by 1),
u as (select child, 'father' line, coalesce(fa, mo) up from f union all select child, 'mother', coalesce(mo, fa) from f),
w as (select child node, line, child hit, [child] path, 0 k from u union all select node, line, up, list_prepend(up, path), k + 1 from w join u using (line) where u.child = w.hit and not list_contains(path, up))
select node, line, array_to_string(arg_max(path, k), '>') path from w group by 1, 2""",
    "family_names": f"""{_REL}, i as (select person_from id from rel union select person_to from rel), n as (select id, max(name) name from person group by 1)
select i.id, coalesce(n.name, array_to_string(list_transform(string_split(regexp_replace(i.id, '_\\d+$', ''), '_'), lambda p: upper(p[1]) || p[2:]), ' ')) "name" from i left join n on n.id = i.id""",
    "tree_root": f"""{_REL}, i as (select person_from id from rel union select person_to from rel), n as (select id, max(name) name from person group by 1),
nm as (select i.id, lower(coalesce(n.name, array_to_string(list_transform(string_split(regexp_replace(i.id, '_\\d+$', ''), '_'), lambda p: upper(p[1]) || p[2:]), ' '))) low from i left join n on n.id = i.id),
o as (select low from nm group by 1 order by count(*) desc, 1 limit 1), r as (select id root, id node from nm join o using (low) union select r.root, c from r join kid on kid.p = r.node)
select root id from r group by 1 order by count(*) desc, 1 limit 1""",
    "quality_empty": f"with {A.VERSES} select t translation_id, 'no verses' \"check\", 'error' severity, t \"where\", null::varchar detail from (values ('en'), ('la'), ('he')) x(t) where t not in (select translation_id from verses)",
    "quality_duplicates": _f("duplicate", "error", "osis_id", "(select translation_id, osis_id, count(*) k from vs group by all having k > 1)", "k - 1"),
    "quality_unknown_books": _f("unknown book", "error", "osis_id", "f1 where book not in (select book from bk)", "book"),
    "quality_blank_texts": _f("blank text", "error", "osis_id", r"kn where text is null or not regexp_matches(text, '\S')"),
    "quality_bad_numbers": _f("bad number", "error", "osis_id", "kn where chapter is null or chapter < 1 or verse is null or verse < 1"),
    "quality_inverted": _f("inverted range", "error", "osis_id", "kn where chapter >= 1 and verse >= 1 and ve <= verse"),
    "quality_overlaps": _f("overlap", "error", "book || '.' || chapter || '.' || n", "(select translation_id, book, chapter, n, arg_min(osis_id, seq) o from cv group by all having count(*) > 1)", "o"),
    "quality_too_many_chapters": _f("too many chapters", "error", "book", "(select translation_id, book, max(chapter) m from ch group by all) join (select book, max(chapter) c from ref_counts group by 1) using (book) where m > c", "m"),
    "quality_missing_chapters": f"""{_VV}, cn as (select book, max(chapter) c from ref_counts group by 1), tb as (select translation_id, book, max(chapter) m from ch group by all), lk as (select translation_id, book, unnest(range(1, c + 1)) n from tb join cn using (book) where m <= c),
g as (select *, n - row_number() over (partition by translation_id, book order by n) i from lk where not exists (select 1 from ch where ch.translation_id = lk.translation_id and ch.book = lk.book and ch.chapter = lk.n)), r as (select translation_id, book, min(n) a, max(n) b from g group by translation_id, book, i)
select translation_id, 'missing chapters' "check", 'warning' severity, book "where", string_agg(case when a = b then a::varchar else a || '–' || b end, ', ' order by a) detail from r group by translation_id, book""",
    "quality_interior_gaps": _f("gap", "warning", "book || '.' || chapter || '.' || n", "(select translation_id, book, chapter, unnest(range(1, last + 1)) n from ch) e where not exists (select 1 from cv where cv.translation_id = e.translation_id and cv.book = e.book and cv.chapter = e.chapter and cv.n = e.n)"),
    "quality_overruns": _f("overrun", "warning", "book || '.' || chapter", "ch join ref_counts using (book, chapter) where last > verses", "last"),
    "quality_trailing_gaps": _f("trailing gap", "warning", "book || '.' || chapter || '.' || n", "(select translation_id, book, chapter, unnest(range(last + 1, verses + 1)) n from ch join ref_counts using (book, chapter) where last < verses)"),
    "versification": f"{_VV} select book, chapter, max(coalesce(ve, verse)) verses from vs where chapter >= 1 and verse >= 1 group by all",
    "versification_diff": f"""{_VV}, p as (select book, chapter, max(coalesce(ve, verse)) v from vs where chapter >= 1 and verse >= 1 group by all)
select coalesce(r.book, p.book) book, coalesce(r.chapter, p.chapter) chapter, r.verses raw, p.v processed from ref_counts r full join p on p.book = r.book and p.chapter = r.chapter where r.verses is distinct from p.v""",
}
