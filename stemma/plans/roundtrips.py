"""Queries of sources and sinks: a table is written as text of a format, and read back by the format's reader. The SQL states the table itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.functions import text as T
from stemma.operators import crossrefs as X
from stemma.operators import genealogy as N
from stemma.operators import store
from stemma.plans import adapters as A
from stemma.plans import entities
from stemma.sources import delimited as D
from stemma.sources import markup as K
from stemma.sources import records as J
from stemma.sources import stores as W
from stemma.util import scratch, table

#: The books of the links as a format's codes.
CODES = {f"B{i:02}": f"N{i}" for i in range(25)}


def _code(book: Column) -> Column:
    return F.concat(F.lit("B"), F.lpad(F.substring(book, 2, 9), 2, "0"))


def _as_text(df: DataFrame, name: str) -> str:
    """A folder with the lines of a one-column table."""
    path = scratch(df.sparkSession, name)
    df.write.text(path)
    return path


def csv_people(spark: SparkSession, d: str) -> DataFrame:
    """People through a quoted CSV with a header."""
    path = scratch(spark, "csv")
    table(spark, d, "people").select("person_lookup", "display_title", "gender", "father").write.csv(path, header=True, quoteAll=True, escape='"')
    return D.read_csv(spark, path)


def csv_loose_lexicon(spark: SparkSession, d: str) -> DataFrame:
    """Parts as rows of the second dialect: quotes anywhere, lines that break inside them, doubled quotes."""
    quoted = F.concat(F.lit('"'), F.replace(F.concat_ws(', "', "p_type", "p_name"), F.lit('"'), F.lit('""')), F.lit('\n1. '), "p_brand", F.lit('"'))
    path = _as_text(table(spark, d, "part").select(F.concat_ws(",", "p_partkey", "p_name", quoted).alias("value")), "loose")
    return D.read_csv_loose(spark, path, ["number", "word", "gloss"]).select("number", "word", "gloss", "cells").filter("cells >= 3")  # a file ends with a line break


def hebrew_entries(spark: SparkSession, d: str) -> DataFrame:
    """Lexicon entries of rows (number, word, gloss): transliteration, pronunciation, gloss of the cell."""
    gloss = F.concat("p_brand", F.lit(" ("), F.lower("p_brand"), F.lit("- x)\n"), F.lit("1. "), "p_name", F.lit("\n2. "), "p_type")
    rows = table(spark, d, "part").select(F.lpad(F.col("p_partkey").cast("string"), 7, "0").alias("number"), F.col("p_name").alias("word"), gloss.alias("gloss"), F.lit(3).alias("cells"))
    return D.hebrew_lexicon(rows)


def split_suppliers(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers through naive commas; each file starts with a header."""
    s = table(spark, d, "supplier")
    path = scratch(spark, "split")
    lines = s.select(F.concat_ws(",", "s_suppkey", "s_name", "s_nationkey").alias("value"))
    short = spark.createDataFrame([("a,b",)], "value string")
    header = spark.createDataFrame([("key,name,nation",)], "value string")
    header.unionByName(lines).unionByName(short).coalesce(1).write.text(path)  # a header per file
    return D.read_split(spark, path, 3, {"key": 0, "name": 1, "nation": 2}).drop("seq")


def links_file(spark: SparkSession, d: str) -> DataFrame:
    """Links through tab-separated lines, among comments, headers, short lines, links to oneself and links without votes."""
    rows = A.links(spark, d)
    line = lambda a, b, v: F.concat_ws("\t", a, b, v)
    good = rows.select(line("source_verse", F.when(F.col("votes") % 2 == 0, F.concat("target_verse", F.lit("-"), "source_verse")).otherwise(F.col("target_verse")), F.col("votes").cast("string")).alias("value"))
    bad = rows.select(F.explode(F.array(line("source_verse", "source_verse", F.lit("5")), line("target_verse", F.lit("nowhere"), F.lit("5")), F.concat(F.lit("# "), "id"), line("source_verse", "target_verse", F.lit("0")))).alias("value"))
    head = spark.createDataFrame([("From Verse\tTo Verse\tVotes",), ("x\ty",), ("",)], "value string")
    return D.read_links(spark, _as_text(good.unionByName(bad).unionByName(head), "links"))


def geo_lines(spark: SparkSession, d: str) -> DataFrame:
    """Located rows through JSON lines with their references as JSON inside a text."""
    g = table(spark, d, "geo_row")
    at = F.when(F.col("lat").isNotNull() & F.col("lng").isNotNull(), F.concat_ws(",", F.col("lng").cast("string"), F.col("lat").cast("string")))
    seen = F.struct(F.struct((F.col("confidence") * 1000).alias("time_total")).alias("score"), F.array(F.struct(at.alias("lonlat"))).alias("resolutions"))
    line = F.to_json(F.struct(F.col("name").alias("friendly_id"), "id", "url_slug", F.array(seen).alias("identifications"), F.to_json(F.struct(F.col("verse_refs").alias("osises"))).alias("extra")))
    broken = spark.createDataFrame([("{not json",), ("{}",)], "value string")
    rows = J.read_geo(spark, _as_text(g.select(line.alias("value")).unionByName(broken), "geo"))
    return rows.select("id", "url_slug", "name", "lat", "lng", F.round("confidence", 9).alias("confidence"), F.array_join(F.array_sort("verse_refs"), " ").alias("refs"))


def greek_script(spark: SparkSession, d: str) -> DataFrame:
    """Parts as a script's object of lexicon entries, a thousand keys a file."""
    p = table(spark, d, "part")
    entry = F.concat(F.lit('"G'), "p_partkey", F.lit('":'), F.to_json(F.struct(F.col("p_name").alias("lemma"), F.col("p_brand").alias("translit"), F.concat(F.lit(" : "), "p_type", F.lit("; more")).alias("strongs_def"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("kjv_def"), F.lit("from it").alias("derivation"))))
    files = p.groupBy(F.floor(F.col("p_partkey") / 1000).alias("k")).agg(F.concat(F.lit("var dictionary = {"), F.array_join(F.collect_list(entry), ","), F.lit(',"X":{}};')).alias("value"))
    return J.greek_lexicon(files.select("value"))


def script_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Links between chapters scraped out of a script's calls, a call per link."""
    p = X.parts(A.links(spark, d))
    kind = F.element_at(F.array(*map(F.lit, ("q", "a", "p", ""))), (F.col("votes") % 4 + 1).cast("int"))
    call = F.concat(F.lit("links.push({linkID: 7, bkSource: '"), _code(F.col("src_book")), F.lit("', chpSource: "), "src_ch", F.lit(', bkTarget: "'), _code(F.col("tgt_book")), F.lit('", chpTarget: '), "tgt_ch", F.lit(", type: '"), kind, F.lit("'})"))
    return J.script_links(p.select(F.concat(call, F.lit(";\nlinks.push({linkID: 8, bkSource: 'ZZ', chpSource: 1, bkTarget: 'ZZ', chpTarget: 2})")).alias("value")), CODES)


def passage_file(spark: SparkSession, d: str) -> DataFrame:
    """Each order's line items as a passage group in XML."""
    li = table(spark, d, "lineitem").join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    side = F.when(F.col("s_nationkey") % 2 == 0, "HEB").otherwise("GRK")
    verse = F.concat(F.lit("<Verse "), side, F.lit('="x">'), _code(F.concat(F.lit("N"), "s_nationkey")), F.lit(" "), "l_suppkey", F.lit(":"), "l_linenumber", F.lit("-99</Verse>"))
    one = li.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", verse.alias("v")))), lambda x: x["v"]), "").alias("v"))  # an order's few items
    files = one.select(F.concat(F.lit("<All><Passage id='1'>"), "v", F.lit('<Verse HEB="y">ZZ 1:1</Verse></Passage></All>')).alias("value"))
    return K.passage_groups(files, CODES).groupBy("ord", "osis", "part").agg(F.count("*").alias("n"))


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a passage of three parts, as text safe in XML."""
    v = A.verses(spark, d).filter("chapter is not null and verse is not null and text is not null").filter(F.size(F.split("osis_id", r"\.")) == 3)
    return v.select("book", "chapter", "verse", "osis_id", "seq", T.escape_html(F.col("text")).alias("body"))


def milestone_edition(spark: SparkSession, d: str) -> DataFrame:
    """Documents through an edition that marks where verses start and end, a file each; the first word is tagged, notes go."""
    b = _bodies(spark, d)
    word = r"(?s)^([A-Za-z]+)(.*)$"
    tagged = F.when(F.col("body").rlike(word), F.regexp_replace("body", word, '<w lemma="strong:H0007225">$1</w>$2')).otherwise(F.col("body"))
    value = F.concat(F.lit("<osis><verse sID='"), F.lit("'/>"), F.lit('<verse osisID="'), "osis_id", F.lit('" sID="'), "osis_id", F.lit('"/>'), tagged, F.lit('<note>no <note>deeper</note></note><verse eID="'), "osis_id", F.lit('"/></osis>'))
    rows = K.milestones(b.select(F.col("seq").cast("string").alias("path"), value.alias("value")), "M")
    return rows.select("osis_id", "chapter", "verse", F.md5("text").alias("digest"), F.array_join("lemmas", " ").alias("lemmas"), "align")


def stateful_edition(spark: SparkSession, d: str) -> DataFrame:
    """Documents through an edition whose tags set what is open, a file each: every third a range, every fifth in two lettered parts that come together again."""
    b = _bodies(spark, d)
    v = F.col("verse").cast("string")
    cut_at = r"(?s)^(\S+)\s+(\S.*)$"
    two = (F.col("seq") % 5 == 0) & F.col("body").rlike(cut_at)
    verse = lambda ident, text: F.concat(F.lit('<v id="'), ident, F.lit('"/>'), text, F.lit("<f>a <f>note</f></f><ve/>"))
    ident = F.when(F.col("seq") % 3 == 0, F.concat(v, F.lit("-"), (F.col("verse") + 2).cast("string"))).otherwise(v)
    body = F.when(two, F.concat(verse(F.concat(v, F.lit("a")), F.regexp_extract("body", cut_at, 1)), verse(F.concat(v, F.lit("b")), F.regexp_extract("body", cut_at, 2)))).otherwise(verse(ident, F.col("body")))
    value = F.concat(F.lit('<usfx><book id="FRT"/><c id="1"/><v id="1"/>front<ve/><book id="'), "book", F.lit('"/><c id="'), "chapter", F.lit('"/>'), body, F.lit('<c id="99"/></usfx>'))
    books = {r[0]: r[0] for r in table(spark, d, "ref_counts").select("book").distinct().collect()}  # a few dozen
    rows = K.stateful(b.select(F.col("seq").cast("string").alias("path"), value.alias("value")), "S", books)
    return rows.select("osis_id", "chapter", "verse", "verse_end", F.md5("text").alias("digest"))


def people_rows(spark: SparkSession, d: str) -> DataFrame:
    p = D.persons_table(table(spark, d, "people").withColumnRenamed("person_lookup", "personLookup"))
    return p.select("id", "name", "gender", F.array_join("verse_refs", " ").alias("refs"))


def place_rows(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "place").select(F.col("id").alias("placeLookup"), "name", F.col("lat").cast("string").alias("latitude"), F.col("lng").cast("string").alias("longitude"), F.coalesce(F.col("confidence").cast("string"), F.lit("")).alias("confidence"), "precision", F.array_join("verse_refs", ", ").alias("verses"))
    return D.places_table(t).select("id", "name", "lat", "lng", "confidence", "precision", F.array_join("verse_refs", " ").alias("refs"))


def event_rows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "bible_events").select(F.col("event_id").alias("eventID"), "title", F.col("start_date").alias("startDate"), "verses")
    return D.events_table(e).select("id", "name", "date", F.array_join("verse_refs", " ").alias("refs"))


def dictionary_rows(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part").select(F.concat("p_name", F.lit(" "), "p_partkey").alias("term"), F.concat(F.lit("see ["), "p_type", F.lit("](/a/"), "p_brand", F.lit(") and [x](y)")).alias("definition"))
    return D.dictionary_table(t)


def external_people(spark: SparkSession, d: str) -> DataFrame:
    return D.external_persons(table(spark, d, "ext_person").select(F.col("ext_id").alias("person_id"), F.col("english_label").alias("person_name")))


def external_label_rows(spark: SparkSession, d: str) -> DataFrame:
    return D.external_labels(table(spark, d, "ext_person").select(F.col("ext_id").alias("person_id"), "english_label", "label_type", F.col("meaning").alias("hebrew_meaning")))


def stored_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders through a store partitioned by status."""
    path = scratch(spark, "store")
    W.write_table(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), path, partition_by=["o_orderstatus"], sort_by=["o_orderkey"])
    return spark.read.parquet(path).select("o_orderkey", "o_orderstatus", "o_totalprice")


def budgeted_parts(spark: SparkSession, d: str) -> DataFrame:
    """Customers through JSON parts of at most 16 KB each."""
    path = scratch(spark, "parts")
    W.write_parts(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), path, "c_custkey", budget=16 << 10, whole=20 << 10)
    return W.read_parts(spark, path, "c_custkey long, c_name string, c_acctbal double")


def present_or_empty(spark: SparkSession, d: str) -> DataFrame:
    """A table that is there, and one that isn't."""
    kind = "n_nationkey int, n_name string"
    there = store.read_or_empty(spark, f"{d}/nation.parquet", kind)
    return there.unionByName(store.read_or_empty(spark, f"{d}/no-such-table.parquet", kind))


def seeded_store(spark: SparkSession, d: str) -> DataFrame:
    """Nations seeded, seeded again to no effect, and seeded with force for some."""
    path = scratch(spark, "seed")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    steps = [
        ("first", lambda: W.seed(spark, path, n, ["n_nationkey"])),
        ("again", lambda: W.seed(spark, path, n.withColumn("n_name", F.lit("lost")), ["n_nationkey"])),
        ("fails", lambda: W.seed(spark, path, n.select("n_name"), ["nothing"], force=True)),
        ("forced", lambda: W.seed(spark, path, n.filter("n_nationkey < 5").withColumn("n_name", F.lower("n_name")), ["n_nationkey"], force=True)),
    ]
    told = {k: v.split(":")[0] for k, v in W.seed_all(steps).items()}
    return spark.read.parquet(path).withColumn("steps", F.lit(" ".join(f"{k}={v}" for k, v in told.items())))


def run_log(spark: SparkSession, d: str) -> DataFrame:
    """Two runs of an import in the log; one of an unknown source is refused."""
    path = scratch(spark, "log")
    known = [r[0] for r in table(spark, d, "source_registry").select("source_id").distinct().orderBy("source_id").collect()]  # the registry is small
    rows = {t: table(spark, d, t).count() for t in ("person", "place")}
    for t, n in rows.items():
        W.record_run(spark, path, {"source_ids": known[:2], "records": n, "name": t}, known)
    refused = 0
    try:
        W.record_run(spark, path, {"source_ids": ["nobody"]}, known)
    except ValueError:
        refused = 1
    return spark.read.json(path).select("name", F.col("records").cast("long").alias("records"), F.lit(refused).alias("refused"))


def import_run(spark: SparkSession, d: str) -> DataFrame:
    """A chain of stages: people, their links, their conflicts counted; each starts from what the last one wrote."""
    stages = [
        ("people", lambda _: table(spark, d, "people")),
        ("links", lambda t: N.family_links(t["people"], male=entities.MALE, female=entities.FEMALE)),
        ("counts", lambda t: t["links"].groupBy("type").agg(F.count("*").alias("n"))),
    ]
    return W.run_stages(stages, scratch(spark, "run"), spark)["counts"]


QUERIES = {
    f.__name__: f
    for f in (
        csv_people, csv_loose_lexicon, hebrew_entries, split_suppliers, links_file, geo_lines, greek_script, script_overlay, passage_file, milestone_edition, stateful_edition, people_rows, place_rows, event_rows,
        dictionary_rows, external_people, external_label_rows, stored_orders, budgeted_parts, present_or_empty, seeded_store, run_log, import_run,
    )
}

_ORDINARY = r"regexp_full_match(x, '[A-Za-z0-9_]+\.\d+\.\d+')"
_REFS = r"""(select string_agg(k, ' ' order by i) from (select k, min(i) i from (select regexp_replace(split_part(regexp_replace(s, '^[\s\x{a0}\x{2007}\x{202f}\x{3000}]+|[\s\x{a0}\x{2007}\x{202f}\x{3000}]+$', '', 'g'), '-', 1), '[\s\x{a0}\x{2007}\x{202f}\x{3000}]+$', '') k, i
  from (select unnest(string_split_regex(%s, '[,;]')) s, generate_subscripts(string_split_regex(%s, '[,;]'), 1) i)) where regexp_full_match(k, '[A-Za-z0-9_]+\.\d+\.\d+') group by k))"""
_SPACED = r"trim(regexp_replace(%s, '[ \t\n\x0b\f\r\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+', ' ', 'g'), ' ')"
_DOCS = f"""with {A.VERSES}, b as (select *, {_SPACED % 'text'} t from verses where chapter is not null and verse is not null and text is not null and len(string_split(osis_id, '.')) = 3)"""
SQL = {
    "csv_people": "with p as (select trim(coalesce(person_lookup, '')) person_lookup, trim(coalesce(display_title, '')) display_title, trim(coalesce(gender, '')) gender, trim(coalesce(father, '')) father from people) select * from p where length(person_lookup || display_title || gender || father) > 0",
    "csv_loose_lexicon": "select p_partkey::varchar number, p_name word, p_type || ', \"' || p_name || chr(10) || '1. ' || p_brand gloss, 3 cells from part",
    "hebrew_entries": "select 'H' || p_partkey id, 'H' || p_partkey strongs_number, 'hebrew' as \"language\", trim(p_name) lemma, split_part(p_brand, ' ', 1) transliteration, lower(p_brand) || '-x' pronunciation, p_name gloss, p_brand || ' (' || lower(p_brand) || '- x)' || chr(10) || '1. ' || p_name || chr(10) || '2. ' || p_type description from part",
    "split_suppliers": 'select s_suppkey::varchar "key", s_name "name", s_nationkey::varchar nation from supplier',
    "links_file": f"with {A.LINKS} select id, source_verse, target_verse, votes from links where source_verse <> target_verse and votes > 0",
    "geo_lines": rf"select id, url_slug, name, lat, lng, round(greatest(0, least(1, coalesce(confidence * 1000, 0) / 1000)), 9) confidence, coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform(verse_refs, lambda r: trim(split_part(trim(r), '-', 1))), lambda x: {_ORDINARY}))), ' '), '') refs from geo_row where name is not null and lat is not null and lng is not null",
    "greek_script": "select 'G' || p_partkey id, 'G' || p_partkey strongs_number, 'greek' as \"language\", p_name lemma, p_brand transliteration, null::varchar pronunciation, case when p_size % 2 = 0 then p_name else regexp_replace(p_type, '^[ :;,.–—-]+', '') end gloss, concat_ws(chr(10), 'from it', trim(' : ' || p_type || '; more'), case when p_size % 2 = 0 then p_name end) description from part",
    "script_overlay": f"with {A.LINKS} select sb || '.' || sc src, tb || '.' || tc tgt, (['quotation', 'allusion', 'possible_allusion', 'possible_allusion'])[votes % 4 + 1] \"type\" from parts",
    "passage_file": """with g as (select l_orderkey o, row_number() over (partition by l_orderkey order by l_linenumber, l_suppkey) - 1 ord, 'N' || s_nationkey || '.' || l_suppkey || '.' || l_linenumber osis, case when s_nationkey % 2 = 0 then 'OT' else 'NT' end part from lineitem join supplier on s_suppkey = l_suppkey)
select ord::int ord, osis, part, count(*) n from g group by all""",
    "milestone_edition": rf"""{_DOCS} select osis_id, chapter, verse, md5(t) digest, case when regexp_matches(text, '^[A-Za-z]') then 'H7225' else '' end lemmas, case when regexp_matches(text, '^[A-Za-z]') then '[[0, ' || length(regexp_extract(text, '^[A-Za-z]+')) || ', "H7225"]]' end align from b where t <> ''""",
    "stateful_edition": rf"""{_DOCS} select osis_id, chapter, verse, case when seq % 3 = 0 and not (seq % 5 = 0 and regexp_matches(text, '^\S+\s+\S')) then verse + 2 end verse_end, md5(t) digest from b where t <> '' and book in (select book from ref_counts)""",
    "people_rows": rf"""select trim(person_lookup) id, trim(display_title) "name", nullif(trim(gender), '') gender, coalesce({_REFS % ("nullif(trim(verses), '')", "nullif(trim(verses), '')")}, '') refs from people where trim(person_lookup) <> '' and trim(display_title) <> ''""",
    "place_rows": rf"""select id, trim(name) "name", case when lat is not null and lng is not null and not isnan(lat) and not isnan(lng) then lat end lat, case when lat is not null and lng is not null and not isnan(lat) and not isnan(lng) then lng end lng, confidence, nullif(trim(precision), '') "precision", coalesce({_REFS % ("array_to_string(verse_refs, ', ')", "array_to_string(verse_refs, ', ')")}, '') refs from place where trim(id) <> '' and trim(name) <> ''""",
    "event_rows": rf"""select trim(event_id) id, trim(title) "name", nullif(trim(start_date), '') "date", coalesce({_REFS % ("nullif(trim(verses), '')", "nullif(trim(verses), '')")}, '') refs from bible_events where trim(event_id) <> '' and trim(title) <> ''""",
    "dictionary_rows": "select lower(p_name || ' ' || p_partkey) id, p_name || ' ' || p_partkey term, 'see ' || p_type || ' and x' definition from part",
    "external_people": "select trim(ext_id) person_id, trim(english_label) person_name from ext_person where trim(ext_id) <> '' and trim(english_label) <> ''",
    "external_label_rows": "select trim(ext_id) person_id, coalesce(trim(english_label), '') english_label, coalesce(trim(label_type), '') label_type, coalesce(trim(meaning), '') hebrew_meaning, '' greek_meaning from ext_person where trim(ext_id) <> ''",
    "stored_orders": "select o_orderkey, o_orderstatus, o_totalprice from orders",
    "budgeted_parts": "select c_custkey, c_name, c_acctbal from customer",
    "present_or_empty": "select n_nationkey, n_name from nation",
    "seeded_store": "select n_nationkey, case when n_nationkey < 5 then lower(n_name) else n_name end n_name, 'first=written again=kept fails=failed forced=written' steps from nation",
    "run_log": "select 'person' as \"name\", (select count(*) from person) records, 1 refused union all select 'place', (select count(*) from place), 1",
}
SQL["import_run"] = f'select "type", count(*) n from ({entities.SQL["family_links"]}) group by 1'
