"""Queries of names, references, markup and labels as column expressions, with their SQL. The texts are put together from the part table's columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.functions import refs as R
from stemma.functions import text as T
from stemma.plans import adapters as A
from stemma.util import table

_BOOKS = [(b, n) for b, n, _ in chain.from_iterable(R.BOOKS.values())]
_ALIASES = sorted(R.aliases().items())


def _parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts with a book, a chapter and a verse that their keys choose."""
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("p_partkey") % len(values) + 1).cast("int"))
    return table(spark, d, "part").withColumns({"b": pick([b for b, _ in _BOOKS]), "name": pick([n for _, n in _BOOKS]), "alias": pick([a for a, _ in _ALIASES]), "c": F.col("p_size") % 20 + 1, "v": (F.col("p_partkey") % 30 + 1).cast("int")})


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def parsed_references(spark: SparkSession, d: str) -> DataFrame:
    """Readable references, keys, chapters alone, and what is neither; each back to a label and a key."""
    p = _parts(spark, d)
    c, v, name = F.col("c"), F.col("v"), F.col("name")
    k = F.col("p_partkey") % 7
    written = F.when(k == 0, _text(" ", name, " ", c, ":", v, " ")).when(k == 1, _text(F.lower("name"), " ", c, ":", v, " - ", v + 2)).when(k == 2, _text(F.col("b"), ".", c, ".", v)).when(k == 3, _text(F.upper("name"), " ", c)).when(k == 4, _text(c, ":", v)).when(k == 5, _text(F.col("b"), ".", c)).otherwise(_text("No such book ", c, ":", v))
    r = p.select("p_partkey", R.parse_reference(written).alias("r"))
    label = R.format_reference(F.col("r.book"), F.col("r.chapter"), F.col("r.verse"), F.col("r.verse_end"))
    return r.select("p_partkey", "r.*", label.alias("label"), F.when(F.col("r").isNotNull(), R.to_osis(F.col("r.book"), F.col("r.chapter"), F.col("r.verse"))).alias("osis"))


def found_books(spark: SparkSession, d: str) -> DataFrame:
    """Books by id or name in any case, and by short forms."""
    p = _parts(spark, d)
    return p.select("p_partkey", R.find_book(F.upper("name")).alias("by_name"), R.find_book(F.col("b")).alias("by_id"), R.find_book(F.col("alias")).alias("alias_as_name"), R.resolve_book(_text(" ", F.initcap("alias"), " ")).alias("by_alias"))


def markup_forms(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    n, b, t = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    deep = F.concat(*[F.lit("<f>x")] * 12, b, *[F.lit("</f>")] * 12)
    return p.select(
        "p_partkey", T.without_links(_text("see [", n, "](/x/", b, ") and [y](z)")).alias("bare"), T.remove_elements(_text("a", deep, t, "<fe/><f>open ", n), "f").alias("without"),
        T.plain_text(_text("<w s='H1'>", n, "</w><q>", b, "</q>&amp;lt;  x\n")).alias("plain"), T.osis_text(_text("<divineName>", n, "</divineName><seg>x</seg><p/>", b)).alias("osis"),
        T.escape_html(_text("<", n, ' & "', b, '">')).alias("html"), T.mark(n, ["cold", "river"]).alias("marked"), F.array_join(T.senses(_text("first (1) ", n, " (2) ", b, " (3) ")), "|").alias("senses"), F.array_join(T.senses(_text(" (1) ", n)), "|").alias("one_sense"),
    )


def tagged_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of word tags, one id, the id a query asks for, and spans and ranges of JSON cells."""
    k = F.col("p_partkey").cast("string")
    tags = _text('<w lemma="strong:H00', k, " lemma.g5 x", k, '">a</w><w lemma="H', k, ' h07a">b</w>')
    p = table(spark, d, "part")
    spans = T.spans(F.when(F.col("p_size") % 9 == 0, F.lit("[[broken")).otherwise(_text("[[0, ", F.col("p_size"), ', "H', k, ' G2"], [7, 9, "G1"]]')))
    ranges = T.ranges(F.when(F.col("p_size") % 9 == 1, F.lit(None).cast("string")).otherwise(_text("[[1, ", F.col("p_size"), "]]")))
    return p.select(
        "p_partkey", F.array_join(T.lemmas(tags), " ").alias("ids"), F.array_join(T.lemmas(tags, strip_zeros=False), " ").alias("raw_ids"), T.normalize_id(_text(" strong:g000", k)).alias("one"), T.normalize_id(F.col("p_name")).alias("none"),
        T.id_query(_text(" h00", k, " ")).alias("asked"), F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"], s["end"], F.array_join(s["ids"], "+"))), " ").alias("spans"), F.array_join(F.transform(ranges, lambda r: F.concat_ws("-", r["start"], r["end"])), " ").alias("ranges"),
    )


def gloss_forms(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    g = T.gloss_parts(_text(F.col("p_brand"), " (", F.lower("p_brand"), "-  x\n y)\nno sense\n 3.  ", F.col("p_name")))
    plain = T.gloss_parts(_text(F.col("p_name"), "\nmore"))
    short = F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(" ")
    return p.select("p_partkey", g["translit"].alias("translit"), g["pronunciation"].alias("pronunciation"), g["gloss"].alias("gloss"), plain["gloss"].alias("first_line"), T.fallback_gloss(short, _text(" : ", F.col("p_type"), "; more. ", F.col("p_name"))).alias("fallback"))


def cited_verses(spark: SparkSession, d: str) -> DataFrame:
    """Keys that a definition cites: a reference, further verses of its chapter, a range by its start; words that are no books are passed over."""
    p = _parts(spark, d).filter(F.col("b").rlike("^[A-Za-z]+$") & ~F.col("name").contains(" "))
    text = _text("as in ", F.col("name"), " ", F.col("c"), ":", F.col("v"), ", 40; see Chapter 3:4 and ", F.col("b"), ". ", F.col("c"), ":7-9.")
    return p.select("p_partkey", F.array_join(R.citations(text), " ").alias("cited"))


def label_forms(spark: SparkSession, d: str) -> DataFrame:
    """What a descendant is called, colours and their mixtures, whether two records are equal whatever is null, and names out of labels."""
    p = table(spark, d, "part")
    colour = _text("#", F.lpad(F.lower(F.hex(F.col("p_partkey") * 7919 % 16777216)), 6, "0"))
    a, b = F.struct("p_size", F.nullif(F.col("p_size") % 3, F.lit(0))), F.struct(F.col("p_size"), F.nullif(F.col("p_size") % 6, F.lit(0)))
    return p.select("p_partkey", T.relation(F.col("p_size") % 8).alias("relation"), F.array_join(F.transform(T.channels(colour), lambda c: c.cast("string")), ",").alias("channels"), T.mixed(colour, 255, 0.5).alias("lighter"), a.eqNullSafe(b).alias("same"), T.base_name(_text(F.col("p_brand"), " (son of ", F.col("p_name"), ")")).alias("base"))


def random_numbers(spark: SparkSession, d: str) -> DataFrame:
    """The first numbers of a seeded generator for each nation's key."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("seed"), F.explode(F.sequence(F.lit(1), F.lit(8))).alias("nth"))
    return n.select("seed", "nth", F.round(T.nth_random(F.col("seed"), F.col("nth")), 12).alias("value"))


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """Links as a graph's edges between verse nodes, and the nodes' keys again."""
    e = A.links(spark, d).select(R.link_to_edge(F.col("id"), F.col("source_verse"), F.col("target_verse"), F.when(F.col("votes") > 25, "theme").otherwise("keyword"), F.col("votes")).alias("e")).select("e.*")
    return e.select("id", "source", "target", "category", "type", "weight", R.verse_of_node(F.col("source")).alias("key"))


QUERIES = {f.__name__: f for f in (parsed_references, found_books, markup_forms, tagged_ids, gloss_forms, cited_verses, label_forms, random_numbers, graph_edges)}


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_P = f"p as (select *, ({_list([b for b, _ in _BOOKS])})[p_partkey % {len(_BOOKS)} + 1] b, ({_list([n for _, n in _BOOKS])})[p_partkey % {len(_BOOKS)} + 1] bn, p_size % 20 + 1 c, (p_partkey % 30 + 1)::int v from part)"
_KNOWN = ", ".join(f"'{x}'" for x in sorted({b.lower() for b, _ in _BOOKS} | {n.lower() for _, n in _BOOKS}))
SQL = {
    "parsed_references": f"""with {_P}, k as (select *, p_partkey % 7 k from p), r as (select p_partkey, bn, case when k in (0, 1, 2, 3, 5) then b end book, case when k in (0, 1, 2, 3, 5) then c end chapter, case when k in (0, 1, 2) then v end verse, case when k = 1 then v + 2 end verse_end from k)
select p_partkey, book, chapter, verse, verse_end, bn || ' ' || chapter || coalesce(':' || verse, '') || coalesce('-' || verse_end, '') "label", concat_ws('.', book, chapter, verse) osis from r where book is not null union all select p_partkey, null, null, null, null, null, null from r where book is null""",
    "found_books": f"""with {_P}, a as (select *, ({_list([a for a, _ in _ALIASES])})[p_partkey % {len(_ALIASES)} + 1] al, ({_list([b for _, b in _ALIASES])})[p_partkey % {len(_ALIASES)} + 1] ab from p)
select p_partkey, b by_name, b by_id, case when al in ({_KNOWN}) then ab end alias_as_name, ab by_alias from a""",
    "markup_forms": r"""select p_partkey, 'see ' || p_name || ' and y' bare, 'a' || p_type || '<fe/>' "without", trim(p_name || ' ' || p_brand || ' < x') "plain", upper(p_name) || 'x ' || p_brand osis,
  '&lt;' || p_name || ' &amp; &quot;' || p_brand || '&quot;&gt;' html, regexp_replace(p_name, '(?i)\b(cold|river)\b', '<mark>\1</mark>', 'g') marked, 'first|' || p_name || '|' || p_brand senses, '(1) ' || p_name one_sense from part""",
    "tagged_ids": """select p_partkey, 'H' || p_partkey || case when p_partkey = 7 then '' else '' end || ' G5 H7A' ids, concat_ws(' ', 'H00' || p_partkey, 'G5', 'H' || p_partkey, 'H07A') raw_ids, 'G' || p_partkey "one", null::varchar "none",
  case when length(p_partkey::varchar) <= 5 then 'H' || p_partkey end asked, case when p_size % 9 = 0 then '' else '0:' || p_size || ':H' || p_partkey || '+G2 7:9:G1' end spans, case when p_size % 9 = 1 then '' else '1-' || p_size end ranges from part""",
    "gloss_forms": "select p_partkey, split_part(p_brand, ' ', 1) translit, lower(p_brand) || '-x y' pronunciation, p_name gloss, p_name first_line, case when p_size % 2 = 0 then p_brand else p_type end fallback from part",
    "cited_verses": f"with {_P} select p_partkey, concat_ws(' ', b || '.' || c || '.' || v, b || '.' || c || '.40', b || '.' || c || '.7') cited from p where regexp_full_match(b, '[A-Za-z]+') and not contains(bn, ' ')",
    "label_forms": """with h as (select *, (p_partkey * 7919 % 16777216)::bigint h, p_size % 8 d from part), c as (select *, h // 65536 r, h // 256 % 256 g, h % 256 bl from h)
select p_partkey, case d when 0 then 'focused' when 1 then 'son' when 2 then 'grandson' when 3 then 'great-grandson' else (d - 2) || '× great-grandson' end relation, r || ',' || g || ',' || bl channels,
  '#' || printf('%02x', floor(r + (255 - r) * 0.5 + 0.5)::int) || printf('%02x', floor(g + (255 - g) * 0.5 + 0.5)::int) || printf('%02x', floor(bl + (255 - bl) * 0.5 + 0.5)::int) lighter,
  nullif(p_size % 3, 0) is not distinct from nullif(p_size % 6, 0) same, trim(regexp_replace(regexp_replace(lower(p_brand), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) base from c""",
    "random_numbers": """with s as (select n_nationkey seed, i nth, (n_nationkey + i::hugeint * 1831565813) & 4294967295 a from nation, range(1, 9) t(i)),
t as (select *, (xor(a, a >> 15) * (a | 1)) & 4294967295 t from s), u as (select *, xor((t + ((xor(t, t >> 7) * (t | 61)) & 4294967295)) & 4294967295, t) u from t)
select seed, nth::int nth, round(xor(u, u >> 14)::double / 4294967296, 12) "value" from u""",
    "graph_edges": f"with {A.LINKS} select id, 'verse:' || source_verse source, 'verse:' || target_verse target, 'link' category, case when votes > 25 then 'theme' else 'keyword' end \"type\", votes weight, source_verse \"key\" from links",
}
