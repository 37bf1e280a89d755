"""Queries of the data-pipeline operators in the core, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.operators import hierarchy as H
from stemma.operators import malformed as M
from stemma.operators import packed, spatial
from stemma.util import table

#: Kilometres within which places are near each other.
NEAR_KM = 5.0


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    feeds = reduce(DataFrame.unionByName, [table(spark, d, t).select(F.lit(t).alias("feed"), "seq", "verses") for t in ("people", "places", "bible_events")])
    return packed.unpack(feeds, "verses", ["feed", "seq"], value="verse")


def parent_links(relationship: DataFrame) -> DataFrame:
    """child, parent, rank (0 father, 1 mother), seq of the rows that state a parent."""
    clean = lambda c: F.lower(F.regexp_replace(c, r"^[\s\u00a0]+|[\s\u00a0]+$", ""))
    kind = F.regexp_replace(clean(F.col("type")), r"[\s\u00a0_-]+", "-")
    a, b = clean(F.col("person_from")), clean(F.col("person_to"))
    down = kind.isin("father-of", "mother-of")
    return (
        relationship.filter(kind.isin("father-of", "mother-of", "has-father", "has-mother"))
        .select(F.when(down, b).otherwise(a).alias("child"), F.when(down, a).otherwise(b).alias("parent"), F.when(kind.contains("father"), 0).otherwise(1).alias("rank"), "seq")
        .filter("child <> '' and parent <> ''")
    )


def person_trees(spark: SparkSession, d: str, paths: bool) -> H.Forest:
    links = parent_links(table(spark, d, "relationship"))
    parents = H.preferred_parents(links, "child", "parent", "rank", "seq")
    return H.peel(parents, nodes=links.select(F.col("parent").alias("node")), paths=paths)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return H.placed(person_trees(spark, d, paths=False)).select(F.col("node").alias("person_id"), F.col("root").alias("root_id"), "depth")


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    return H.placed(person_trees(spark, d, paths=True)).select(F.col("node").alias("person_id"), F.array_join("path", ">").alias("path"), F.col("size").alias("subtree_size"), "status")


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    return H.descendants(person_trees(spark, d, paths=False)).select(F.col("ancestor").alias("ancestor_id"), F.col("node").alias("person_id"), "distance")


def p2_all_descendants(spark: SparkSession, d: str) -> DataFrame:
    """As p2_descendants, with all that is below nodes that hang on cycles or lie on them."""
    return H.all_descendants(person_trees(spark, d, paths=False)).select(F.col("ancestor").alias("ancestor_id"), F.col("node").alias("person_id"), "distance")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    place = table(spark, d, "place")
    near = spatial.near(place, "id", NEAR_KM).select(F.lit("near").alias("kind"), "id_a", "id_b")
    within = spatial.within(place, "id", table(spark, d, "territory"), "territory_id", "ring")
    return near.unionByName(within.select(F.lit("within").alias("kind"), F.col("id").alias("id_a"), F.col("region").alias("id_b")))


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return M.split_rows(table(spark, d, "raw_record").select("record_id", "feed", "raw"), "raw", "feed", M.FEEDS)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).filter("reason is not null").select("record_id", "reason")


def p6_fields(spark: SparkSession, d: str) -> DataFrame:
    """Each failing row with the first broken field."""
    return _rows(spark, d).filter("reason is not null").select("record_id", "feed", "reason", "field")


def p6_relationships(spark: SparkSession, d: str) -> DataFrame:
    """The valid rows of one feed, loaded."""
    ok = _rows(spark, d).filter("reason is null and feed = 'person_relationship'")
    c = ok.select("record_id", M.cells(F.col("raw"), M.FEEDS["person_relationship"]).alias("c"))
    return c.select("record_id", F.col("c.number").cast("long").alias("number"), "c.chapter", "c.source", "c.type", "c.target", "c.note")


def p6_strongs(spark: SparkSession, d: str) -> DataFrame:
    ok = _rows(spark, d).filter("reason is null and feed = 'hebrew_strongs'")
    return ok.select("record_id", M.cells(F.col("raw"), M.FEEDS["hebrew_strongs"]).alias("c")).select("record_id", F.col("c.number").cast("long").alias("number"), "c.word", "c.gloss")


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_paths, p2_descendants, p2_all_descendants, p4_found, p6_found, p6_fields, p6_relationships, p6_strongs)}

_Q = r"""'"(?:[^"]|"")*"|“[^”]*”'"""
_SQL_TREES = r"""
with recursive l as (
  select lower(trim(person_from)) a, lower(trim(person_to)) b, regexp_replace(lower(trim(type)), '[\s_-]+', '-', 'g') k, seq from relationship),
links as (
  select case when k in ('father-of','mother-of') then b else a end child, case when k in ('father-of','mother-of') then a else b end parent,
         case when k in ('father-of','has-father') then 0 else 1 end r, seq
  from l where k in ('father-of','mother-of','has-father','has-mother') and a <> '' and b <> ''),
par as (select child, arg_min(parent, (r, seq, parent)) parent from links group by 1),
nodes as (select child n from links union select parent from links),
t as (
  select n, n root, 0 depth, [n] path from nodes where n not in (select child from par)
  union all select par.child, t.root, t.depth + 1, list_append(t.path, par.child) from t join par on par.parent = t.n),
up as (select child n, parent hit, 1 k from par where child not in (select n from t)
  union select up.n, par.parent, k + 1 from up join par on par.child = up.hit where up.hit <> up.n and k < 500)
"""
SQL = {
    "p1_found": rf"""
with f as (select 'people' feed, seq, verses v from people union all select 'places', seq, verses from places union all select 'bible_events', seq, verses from bible_events),
t as (select feed, seq, regexp_replace(v, '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g') v from f),
u as (select feed, seq, case when regexp_full_match(v, '(?s)\[.*\]|\{{.*\}}|\(.*\)') then v[2:-2] else v end v from t),
w as (select feed, seq, regexp_replace(v, '''([^'']*)''', '"\1"', 'g') v from u),
q as (select feed, seq, regexp_extract_all(v, {_Q}) qs,
      string_split_regex(regexp_replace(regexp_replace(regexp_replace(v, {_Q}, '©', 'g'), '[\s\x{{a0}}]and[\s\x{{a0}}]|<br>|[,;|/&+·、，；•\t\r\n]', '¬', 'g'),
        '([\pL\pN©])[\s\x{{a0}}]+(\pN?\pL+[. ]\pN|©)', '\1¬\2', 'g'), '¬') x from w),
e as (select feed, seq, qs, unnest(x) s, generate_subscripts(x, 1) i from q),
n as (select *, sum(length(s) - length(replace(s, '©', ''))) over (partition by feed, seq order by i rows unbounded preceding)::bigint c from e),
r as (select feed, seq, i, case when contains(s, '©') then replace(qs[c][2:-2], '""', '"') else s end s from n),
z as (select feed, seq, i, regexp_replace(s, '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g') verse from r)
select feed, seq, cast(row_number() over (partition by feed, seq order by i) - 1 as int) pos, verse from z where verse <> ''""",
    "p2_found": _SQL_TREES
    + """
select n person_id, root root_id, depth from t
union all select distinct n, '', case when exists (select 1 from up u where u.n = up.n and u.hit = u.n) then -1 else -2 end from up""",
    "p2_paths": _SQL_TREES
    + """, anc as (select n, unnest(path) a from t),
down as (select n, hit from up where hit <> n union select child, parent from par where child not in (select n from t) and child <> parent),
cyc as (select distinct n from up where hit = n),
below as (select distinct n, hit from down where n not in (select n from cyc) and hit not in (select n from cyc)),
sz as (select a n, count(*) c from anc group by 1 union all
       select hit, count(*) + 1 from below group by 1)
select nodes.n person_id, array_to_string(t.path, '>') path, cast(case when cyc.n is null then coalesce(sz.c, 1) end as bigint) subtree_size,
  case when t.n is not null then 'rooted' when cyc.n is not null then 'cycle' else 'below' end status
from nodes left join t on t.n = nodes.n left join cyc on cyc.n = nodes.n left join sz on sz.n = nodes.n""",
    "p2_descendants": _SQL_TREES
    + "select path[i] ancestor_id, n person_id, depth - i + 1 distance from (select n, path, depth, unnest(range(1, len(path))) i from t) where true",
    "p2_all_descendants": _SQL_TREES
    + """, w as (select child n, parent a, 1 k, [child, parent] seen from par where child not in (select n from t) and child <> parent
  union all select w.n, par.parent, k + 1, list_append(seen, par.parent) from w join par on par.child = w.a where not list_contains(seen, par.parent))
select path[i] ancestor_id, n person_id, depth - i + 1 distance from (select n, path, depth, unnest(range(1, len(path))) i from t) union all select a, n, k from w""",
    "p4_found": """
with p as (select distinct id, lat, lng from place where lat between -90 and 90 and lng between -180 and 180 and not (lat = 0 and lng = 0) and not isnan(lat) and not isnan(lng)),
e as (select territory_id t, ring_no, unnest(range(1, len(ring) + 1)) i, ring from territory),
s as (select t, ring_no, ring[i].lng x1, ring[i].lat y1, ring[i % len(ring) + 1].lng x2, ring[i % len(ring) + 1].lat y2 from e),
c as (select id, lat, lng, t, ring_no from p join s on (y1 > lat) <> (y2 > lat) and lng < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 group by all having count(*) % 2 = 1)
select distinct 'near' kind, a.id id_a, b.id id_b from p a join p b on a.id < b.id and b.lat between a.lat - 0.046 and a.lat + 0.046
where 2 * 6371 * asin(least(1, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2)))) <= 5
union all select distinct 'within', id, t from c""",
}
_CELL = r'(?:"(?:[^"]|"")*"|[^",]*)'
_SQL_ROWS = rf"""
with r as (select record_id, feed, raw, case feed when 'person_relationship' then 6 when 'hebrew_strongs' then 3 else 0 end n from raw_record),
v as (select *, not regexp_full_match(raw, '{_CELL}(?:,{_CELL})*\r?') quoting,
  not (case n when 6 then regexp_full_match(raw, '{_CELL}(?:,{_CELL}){{5}}\r?') else regexp_full_match(raw, '{_CELL}(?:,{_CELL}){{2}}\r?') end) cols,
  list_transform(regexp_extract_all(regexp_replace(raw, '\r$', ''), '(?:^|,)({_CELL})', 1), lambda x: trim(case when x[1] = '"' then replace(x[2:-2], '""', '"') else x end, chr(32) || chr(9) || chr(10) || chr(13) || chr(160))) c from r),
w as (select *, not regexp_full_match(c[1], '0*[1-9][0-9]*') bad_number,
  regexp_matches(replace(replace(regexp_replace(raw, '\r$', ''), chr(13) || chr(10), ''), chr(10), ''), '[\x00-\x1f\x7f-\x{{9f}}\x{{fffd}}]') bad_text,
  not regexp_full_match(c[3], '[\pL\pM]+(?:[-''][\pL\pM]+)*_0*[1-9][0-9]*') bad_source,
  not regexp_full_match(c[5], '[\pL\pM]+(?:[-''][\pL\pM]+)*_0*[1-9][0-9]*') bad_target,
  c[2] = '' bad_word, not regexp_matches(c[3], '(?m)^[ \t]*[0-9]+\.[ \t]*[^\s"]') bad_gloss from v),
x as (select *, case when quoting then 'quoting' when cols then 'columns' when bad_number or bad_text then 'value'
  when n = 6 and (bad_source or bad_target) then 'value' when n = 3 and (bad_word or bad_gloss) then 'value' end reason from w)
"""
SQL["p6_found"] = _SQL_ROWS + "select record_id, reason from x where reason is not null"
SQL["p6_relationships"] = (
    _SQL_ROWS
    + "select record_id, cast(c[1] as bigint) number, nullif(c[2], '') chapter, c[3] source, nullif(c[4], '') as \"type\", c[5] target, nullif(c[6], '') note from x where reason is null and n = 6"
)
SQL["p6_strongs"] = _SQL_ROWS + "select record_id, cast(c[1] as bigint) number, c[2] word, c[3] gloss from x where reason is null and n = 3"
