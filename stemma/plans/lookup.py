"""Queries of the table store and of search, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemma.functions import refs as R
from stemma.functions import text as T
from stemma.operators import search as S
from stemma.operators import store
from stemma.plans import adapters as A
from stemma.util import islands, number_within, table


def chapter_verses(spark: SparkSession, d: str) -> DataFrame:
    """Verses of the chapter that most English documents are about."""
    v = A.verses(spark, d).filter("translation_id = 'en'")
    best = v.groupBy("book", "chapter").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "book", "chapter").first()
    return store.chapter(v, "en", best[0] if best else "", best[1] if best else 0).select("seq", "osis_id", "verse", F.length("text").alias("n_chars"))


def _spans(spark: SparkSession, d: str) -> DataFrame:
    """Verses, each third one as a bridge over the two after it."""
    return A.verses(spark, d).withColumn("verse_end", F.when(F.col("seq") % 3 == 0, F.col("verse") + 2))


def verse_lookup_bridge(spark: SparkSession, d: str) -> DataFrame:
    wanted = A.grid(spark, d).select(F.lit("en").alias("translation_id"), F.concat_ws(".", "book", "chapter", "verse").alias("osis_id"))
    return store.resolve_verses(wanted, _spans(spark, d))


def book_list(spark: SparkSession, d: str) -> DataFrame:
    return store.books_present(A.verses(spark, d), A.book_order(spark, d), "en")


def chapter_list(spark: SparkSession, d: str) -> DataFrame:
    v = A.verses(spark, d)
    return v.select("translation_id", "book", "chapter").distinct()


def prev_next_chapter(spark: SparkSession, d: str) -> DataFrame:
    rows = chapter_list(spark, d).join(F.broadcast(A.book_order(spark, d).select("book", "ord")), "book")  # a few dozen books
    return store.neighbours(rows)


def nearest_chapter(spark: SparkSession, d: str) -> DataFrame:
    chapters = table(spark, d, "ref_counts").select("book", "chapter").join(F.broadcast(A.book_order(spark, d).select("book", "ord")), "book").withColumn("translation_id", F.lit("he"))
    return store.nearest_filled(chapters, A.verses(spark, d).filter("translation_id = 'he'")).select("translation_id", "book", "chapter", "open")


def entities_for_chapter(spark: SparkSession, d: str) -> DataFrame:
    """Persons and places that the chapter most persons are mentioned in mentions."""
    person, place = table(spark, d, "person"), table(spark, d, "place")
    m = store.mentions(person, "id", "verse_refs").withColumns({"book": F.split_part("osis_id", F.lit("."), F.lit(1)), "ch": F.split_part("osis_id", F.lit("."), F.lit(2))})
    best = m.groupBy("book", "ch").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "book", "ch").limit(1).select("book", "ch")
    g = A.grid(spark, d).withColumn("ch", F.col("chapter").cast("string")).join(F.broadcast(best), ["book", "ch"]).select(F.concat_ws(".", "book", "chapter", "verse").alias("osis_id"))
    hit = lambda e, k: store.touching(e, "id", "verse_refs", g).select(F.lit(k).alias("kind"), "id").distinct()
    return hit(person, "person").unionByName(hit(place, "place"))


def mention_bridge(spark: SparkSession, d: str) -> DataFrame:
    return store.mentions(table(spark, d, "person"), "id", "verse_refs")


def relationships_for_person(spark: SparkSession, d: str) -> DataFrame:
    rel = table(spark, d, "relationship")
    who = "head_khreibraekhor_2"
    other = store.get(rel, "person_to", who).filter(~F.col("person_from").eqNullSafe(F.lit(who)))
    return store.get(rel, "person_from", who).unionByName(other).select("id", "person_from", "person_to", "type", "seq")


def annotations_newest(spark: SparkSession, d: str) -> DataFrame:
    return store.newest_first(A.annotations(spark, d), "modified", "event_id").select("event_id", "slug", "modified")


def themes(spark: SparkSession, d: str) -> DataFrame:
    """Slugs of annotations with their number and latest label; of equally late ones the first."""
    a = A.annotations(spark, d)
    return a.groupBy("slug").agg(F.count("*").alias("n"), F.max_by("label", F.struct("modified", -F.col("event_id"))).alias("label"))


def annotation_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Verses with the annotations they lie in."""
    return store.overlapping(A.grid(spark, d), A.annotations(spark, d), ["event_id"]).select("book", "chapter", "verse", "event_id")


def theme_thread(spark: SparkSession, d: str) -> DataFrame:
    """The verse numbers of each annotation's first chapter, joined in order."""
    rows = store.overlapping(A.grid(spark, d), A.annotations(spark, d).withColumn("at", F.col("ch")), ["event_id", "at"]).filter("chapter = at")
    return rows.groupBy("event_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("verse")), lambda v: v.cast("string")), " ").alias("verses"))


def highlight_colour(spark: SparkSession, d: str) -> DataFrame:
    rows = store.overlapping(A.grid(spark, d), A.annotations(spark, d), ["event_id", "slug", "modified"])
    return store.highlights(rows, ["book", "chapter", "verse"], "slug", "modified", "event_id")


def contiguous_groups(spark: SparkSession, d: str) -> DataFrame:
    """Runs of verses that documents are about."""
    v = A.verses(spark, d).filter("verse is not null").select("book", "chapter", "verse").distinct()
    return islands(v, ["book", "chapter"], "verse").groupBy("book", "chapter", "island").agg(F.min("verse").alias("first"), F.max("verse").alias("last")).drop("island")


def canonical_order(spark: SparkSession, d: str) -> DataFrame:
    """Verses' place in canonical order within their translation; those of unknown books last."""
    v = A.verses(spark, d).join(F.broadcast(A.book_order(spark, d).select("book", "ord")), "book", "left")
    placed = number_within(v.select("seq", "translation_id", "book", "chapter", "verse", F.coalesce("ord", F.lit(1000)).alias("ord")), ["translation_id", "book"], ["chapter", "verse", "seq"], "nth")
    return placed.select("seq", "translation_id", "ord", "nth")


def xref_counts_per_verse(spark: SparkSession, d: str) -> DataFrame:
    """Each passage's quotations badge: how many of its mentions are shared with places."""
    p = store.mentions(table(spark, d, "person"), "id", "verse_refs").groupBy("osis_id").agg(F.count("*").alias("persons"))
    q = store.mentions(table(spark, d, "place"), "id", "verse_refs").groupBy("osis_id").agg(F.count("*").alias("places"))
    return p.join(q, "osis_id", "full_outer").select("osis_id", F.coalesce("persons", F.lit(0)).alias("persons"), F.coalesce("places", F.lit(0)).alias("places"))


def concordance_exact(spark: SparkSession, d: str) -> DataFrame:
    return S.concordance(A.verses(spark, d), "covenant")


def concordance_variants(spark: SparkSession, d: str) -> DataFrame:
    return S.concordance(A.verses(spark, d), "gather", variants=True)


def hit_totals(spark: SparkSession, d: str) -> DataFrame:
    c = S.concordance(A.verses(spark, d), "the")
    return c.groupBy("translation_id").agg(F.sum("count").alias("hits"), F.countDistinct("seq").alias("verses"))


def _ident(word: Column) -> Column:
    return F.concat(F.lit("H"), (F.ascii(word) * 10 + F.length(word) % 10).cast("string"))


def tagged(spark: SparkSession, d: str) -> DataFrame:
    """English verses whose every word of five letters and more is tagged with an id made from its first letter and length, in a span of its own."""
    v = A.verses(spark, d).filter("translation_id = 'en' and text is not null")
    found = S.matches(F.col("text"), r"[A-Za-z]{5,}")
    align = F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.array(_ident(m["surface"])).alias("ids")))
    return v.withColumn("align", align).withColumn("lemmas", F.array_distinct(F.flatten(F.transform("align", lambda s: s["ids"]))))


def strongs_tokens(spark: SparkSession, d: str) -> DataFrame:
    return S.id_search(tagged(spark, d), "h01196")


def lemma_groups(spark: SparkSession, d: str) -> DataFrame:
    return S.lemma_groups(S.lemma_hits(tagged(spark, d), "gather", variants=True))


def lexicon_search(spark: SparkSession, d: str) -> DataFrame:
    lex = table(spark, d, "part").select(F.concat(F.lit("H"), "p_partkey").alias("id"), F.col("p_name").alias("gloss"), F.col("p_type").alias("lemma"), F.col("p_brand").alias("transliteration"))
    return S.lexicon_search(lex, "Éco")


def _index(spark: SparkSession, d: str) -> DataFrame:
    return S.postings(A.verses(spark, d).filter("translation_id = 'en'"), "seq", "text")


def fulltext_bm25(spark: SparkSession, d: str) -> DataFrame:
    """Scores of every document for a word, by exact, prefix and fuzzy terms."""
    return S.search(_index(spark, d), "seq", "shepherd").select("seq", F.round("score", 6).alias("score"))


def phrase_rerank(spark: SparkSession, d: str) -> DataFrame:
    q = "distant promise"
    scored = S.search(_index(spark, d), "seq", q, fuzzy=0.0).join(A.verses(spark, d).select("seq", "text"), "seq")
    best = S.top(S.rerank(scored, "text", q).withColumn("score", F.round("score", 6)), "seq")
    return best.select("seq", "score")


def _everywhere(spark: SparkSession, d: str, q: str, fuzzy: float = 0.2) -> DataFrame:
    """Scores for a query of all documents of all translations; those that are tagged also by lemma."""
    # the lemmas of tagged(), without the spans
    lemmas = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit("([A-Za-z]{5,})"), 1), lambda w: _ident(F.lower(w))))
    docs = A.verses(spark, d).withColumn("lemmas", F.when((F.col("translation_id") == "en") & F.col("text").isNotNull(), lemmas))
    return S.search_docs(docs, "seq", q, fuzzy=fuzzy)


def fulltext_translations(spark: SparkSession, d: str) -> DataFrame:
    """As fulltext_bm25 over every translation, each with its own document frequencies."""
    return _everywhere(spark, d, "shepherd h01196").select("translation_id", "seq", F.round("score", 6).alias("score"))


def testament_search(spark: SparkSession, d: str) -> DataFrame:
    """The best 50 of all translations in the later half of the books."""
    q = "distant promise"
    half = A.book_order(spark, d).select("book", F.when(F.col("ord") * 2 < F.count("*").over(Window.partitionBy(F.lit(0))), "OT").otherwise("NT").alias("testament"))
    # the bonus where the text is read: no text is shuffled
    there = S.in_testament(A.verses(spark, d).select("translation_id", "seq", "book", S.bonus(F.col("text"), q).alias("bonus")), half, "NT")
    # translations may use the same numbers
    scored = _everywhere(spark, d, q, fuzzy=0.0).join(there, ["translation_id", "seq"]).withColumn("score", F.round(F.col("score") + F.col("bonus"), 6))
    return S.top(scored, "seq", "translation_id", "book").select("translation_id", "seq", "book", "score")


def fuzzy_vocab(spark: SparkSession, d: str) -> DataFrame:
    vocab = _index(spark, d).select("term").distinct()
    return S.expand(vocab, ["gathered", "river"]).select("word", "term", F.round("weight", 6).alias("weight"))


def reading_time(spark: SparkSession, d: str) -> DataFrame:
    """Minutes to read each chapter's documents."""
    v = A.verses(spark, d).groupBy("book", "chapter").agg(F.sum(T.word_count(F.col("text"))).alias("words"))
    return v.select("book", "chapter", "words", T.minutes(F.col("words")).alias("minutes"))


def year_labels(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "bible_events")
    return e.select("seq", F.trim("start_date").try_cast("int").alias("year"), T.year_label(F.trim("start_date")).alias("label"))


def confidence_bins(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "place").groupBy(T.confidence_label(F.col("confidence")).alias("label")).agg(F.count("*").alias("n"))


def name_forms(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "ext_person")
    n = F.col("english_label")
    return p.select("ext_id", T.normalize_name(n).alias("name"), T.base_name(n).alias("base"), T.without_number(n).alias("bare"), T.slug(n).alias("slug"), T.initials(n).alias("initials"))


def place_forms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "geo_row").select("id", T.normalize_place(F.col("name")).alias("name"), T.fold(F.col("name")).alias("folded"))


def id_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "person").select("seq", T.name_from_id(F.col("id")).alias("name"))


def verse_labels(spark: SparkSession, d: str) -> DataFrame:
    m = mention_bridge(spark, d)
    return m.select("id", "osis_id", R.verse_label(F.col("osis_id")).alias("label"), R.node_id("verse", F.col("osis_id")).alias("node"))


def normalized_refs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "people").select("seq", F.array_join(R.normalize_refs(F.col("verses")), " ").alias("refs"))


def event_props(spark: SparkSession, d: str) -> DataFrame:
    """Fields of a JSON cell; null where it is malformed."""
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.page").alias("page"), F.get_json_object("props", "$.ref").alias("ref"))


def verse_runs(spark: SparkSession, d: str) -> DataFrame:
    """The verses that documents are about, by chapter, as '1–3, 7'."""
    v = A.verses(spark, d).filter("verse is not null").groupBy("book", "chapter").agg(F.collect_set("verse").alias("n"))
    return v.select("book", "chapter", T.runs(F.col("n")).alias("verses"))


def stemmed_words(spark: SparkSession, d: str) -> DataFrame:
    v = _index(spark, d).select("term").distinct()
    return v.filter(F.col("term").rlike("^[a-z]+$")).select("term", T.stem(F.col("term")).alias("stem"))


QUERIES = {
    f.__name__: f
    for f in (
        chapter_verses, verse_lookup_bridge, book_list, chapter_list, prev_next_chapter, nearest_chapter, entities_for_chapter, mention_bridge, relationships_for_person, annotations_newest, themes,
        annotation_overlap, theme_thread, highlight_colour, contiguous_groups, canonical_order, xref_counts_per_verse, concordance_exact, concordance_variants, hit_totals, strongs_tokens, lemma_groups,
        lexicon_search, fulltext_bm25, phrase_rerank, fulltext_translations, testament_search, fuzzy_vocab, reading_time, year_labels, confidence_bins, name_forms, place_forms, id_names, verse_labels, normalized_refs, event_props, verse_runs, stemmed_words,
    )
}

_STOP = "(" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + ")"
_V = f"with {A.VERSES}"
_MEN = "men as (select distinct id, unnest(verse_refs) osis_id from person), m as (select * from men where osis_id is not null)"
TAGGED = r"""tok as (select translation_id, osis_id, seq, unnest(string_split_regex(text, '[^A-Za-z]+')) w from verses where translation_id = 'en' and text is not null),
long as (select *, lower(w) s, 'H' || (ascii(lower(w)) * 10 + length(w) % 10) id from tok where length(w) >= 5)"""
_IDX = rf"""idx as (select seq, term, length, count(*) tf from (select seq, unnest(t) term, len(t) length from (
  select seq, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\pL\pN]+'), lambda w: w <> '' and w not in {_STOP}) t from verses where translation_id = 'en')) group by all),
stat as (select count(*) n, avg(l) mean from (select max(length) l from idx group by seq)), df as (select term, count(*) df from idx group by term)"""
_BM = "weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * (0.5 + tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)))"


def _expansion(word: str, reach: int) -> str:
    fuzzy = f"when abs(length(term) - {len(word)}) <= {reach} and levenshtein(term, '{word}') <= {reach} then 0.45 * (1 - levenshtein(term, '{word}') / {len(word)})" if reach else ""
    return f"select '{word}' word, term, df, case when term = '{word}' then 1 when starts_with(term, '{word}') then 0.375 * {len(word)} / length(term) {fuzzy} end weight from df"


_STEM = " ".join(f"when ends_with(term, '{o}') and length(term) - {len(o)} >= 3 then term[:-{len(o) + 1}]" for o, _ in T.STEM_RULES)
SQL = {
    "chapter_verses": f"{_V}, b as (select book, chapter from verses where translation_id = 'en' group by all order by count(*) desc, book, chapter limit 1) select seq, osis_id, verse, length(text) n_chars from verses join b using (book, chapter) where translation_id = 'en'",
    "verse_lookup_bridge": f"""{_V}, {A.GRID}, w as (select *, book || '.' || chapter || '.' || verse osis_id from grid), s as (select *, case when seq % 3 = 0 then verse + 2 end ve from verses where translation_id = 'en'),
x as (select osis_id, min(seq) e from s group by 1), c as (select w.osis_id, min(s.seq) r from w join s on s.book = w.book and s.chapter = w.chapter and s.verse < w.verse and w.verse <= s.ve group by 1)
select 'en' translation_id, w.osis_id, coalesce(e, r) seq from w left join x using (osis_id) left join c using (osis_id)""",
    "book_list": f"{_V}, {A.BOOK_ORDER} select book, ord::int ord from book_order where book in (select book from verses where translation_id = 'en')",
    "chapter_list": f"{_V} select distinct translation_id, book, chapter from verses",
    "prev_next_chapter": f"""{_V}, {A.BOOK_ORDER}, c as (select distinct translation_id, book, chapter from verses)
select book, translation_id, chapter, ord::int ord, lag(book || '.' || chapter) over w as prev, lead(book || '.' || chapter) over w as "next" from c join book_order using (book) window w as (partition by translation_id order by ord, chapter)""",
    "nearest_chapter": f"""{_V}, {A.BOOK_ORDER}, h as (select distinct book, chapter from verses where translation_id = 'he'),
g as (select r.book, r.chapter, ord, case when h.book is not null then r.book || '.' || r.chapter end k from ref_counts r join book_order using (book) left join h on h.book = r.book and h.chapter = r.chapter)
select 'he' translation_id, book, chapter, coalesce(first_value(k ignore nulls) over (order by ord, chapter rows between current row and unbounded following),
  last_value(k ignore nulls) over (order by ord, chapter rows between unbounded preceding and current row)) "open" from g""",
    "entities_for_chapter": f"""with {_MEN}, b as (select split_part(osis_id, '.', 1) book, split_part(osis_id, '.', 2) ch from m group by all order by count(*) desc, 1, 2 limit 1),
g as (select r.book || '.' || chapter || '.' || v osis_id from (select book, chapter, unnest(range(1, verses + 1)) v from ref_counts) r join b on b.book = r.book and b.ch = r.chapter::varchar),
e as (select 'person' kind, id, unnest(verse_refs) o from person union all select 'place', id, unnest(verse_refs) from place)
select distinct kind, id from e where o in (select osis_id from g)""",
    "mention_bridge": f"with {_MEN} select * from m",
    "relationships_for_person": "select id, person_from, person_to, \"type\", seq from relationship where person_from = 'head_khreibraekhor_2' or person_to = 'head_khreibraekhor_2'",
    "annotations_newest": f"with {A.ANNOTATIONS} select event_id, slug, modified from ann order by modified desc, event_id",
    "themes": f'with {A.ANNOTATIONS} select slug, count(*) n, arg_max("label", (modified, -event_id)) "label" from ann group by slug',
    "annotation_overlap": f"with {A.GRID}, {A.ANNOTATIONS} select g.book, chapter, verse, event_id from grid g join ann a on a.book = g.book and (chapter, verse) >= (ch, v) and (chapter, verse) <= (ch_end, v_end)",
    "theme_thread": f"with {A.GRID}, {A.ANNOTATIONS} select event_id, string_agg(verse::varchar, ' ' order by verse) verses from grid g join ann a on a.book = g.book and chapter = ch and verse >= v and (chapter, verse) <= (ch_end, v_end) group by 1",
    "highlight_colour": f"with {A.GRID}, {A.ANNOTATIONS} select g.book, chapter, verse, arg_max(slug, (modified, -event_id)) slug from grid g join ann a on a.book = g.book and (chapter, verse) >= (ch, v) and (chapter, verse) <= (ch_end, v_end) group by all",
    "contiguous_groups": f"""{_V}, d as (select distinct book, chapter, verse from verses where verse is not null), i as (select *, verse - row_number() over (partition by book, chapter order by verse) g from d)
select book, chapter, min(verse) "first", max(verse) "last" from i group by book, chapter, g""",
    "canonical_order": f"{_V}, {A.BOOK_ORDER} select seq, translation_id, coalesce(ord, 1000)::int ord, row_number() over (partition by translation_id, book order by chapter nulls first, verse nulls first, seq)::int nth from verses left join book_order using (book)",
    "xref_counts_per_verse": """with p as (select o, count(distinct id) n from (select id, unnest(verse_refs) o from person) where o is not null group by 1), q as (select o, count(distinct id) n from (select id, unnest(verse_refs) o from place) where o is not null group by 1)
select coalesce(p.o, q.o) osis_id, coalesce(p.n, 0) persons, coalesce(q.n, 0) places from p full join q on p.o = q.o""",
    "concordance_exact": rf"""{_V} select translation_id, osis_id, seq, lower(s) surface, count(*) as "count" from (select *, unnest(regexp_extract_all(text, '(?i)\b(covenant)\b')) s from verses) group by all""".replace("text, unnest", "unnest"),
    "concordance_variants": rf"""{_V} select translation_id, osis_id, seq, lower(s) surface, count(*) as "count" from (select translation_id, osis_id, seq, unnest(regexp_extract_all(text, '(?i)\bgathere?(?:s|d|th|ing|eth|est|er|ers|ieth|ied|ies|y)?\b')) s from verses) group by all""",
    "hit_totals": rf"""{_V} select translation_id, sum(c)::bigint hits, count(distinct seq) verses from (select translation_id, seq, len(regexp_extract_all(text, '(?i)\bthe\b')) c from verses) where c > 0 group by 1""",
    "strongs_tokens": f'{_V}, {TAGGED} select translation_id, osis_id, seq, s surface, count(*) as "count" from long where id = \'H1196\' group by all',
    "lemma_groups": rf"""{_V}, {TAGGED}, h as (select * from long where regexp_full_match(s, 'gathere?(?:s|d|th|ing|eth|est|er|ers|ieth|ied|ies|y)?')), c as (select id, s, count(*) n from h group by all)
select h.id lemma, count(*) hits, count(distinct (translation_id, osis_id)) verses, any_value(x) surfaces from h join (select id, string_agg(s || ' ' || n, ', ' order by n desc, s) x from c group by id) k on k.id = h.id group by 1""",
    "lexicon_search": "select 'H' || p_partkey id, p_name gloss, p_type lemma, p_brand transliteration from part where contains(lower(p_name), 'eco') or contains(lower(p_type), 'eco') or contains(strip_accents(lower(p_brand)), 'eco')",
    "fulltext_bm25": f"{_V}, {_IDX}, e as ({_expansion('shepherd', 2)}) select seq, round(sum({_BM}), 6) score from idx join e using (term), stat where weight is not null group by seq",
    "phrase_rerank": f"""{_V}, {_IDX}, e as ({_expansion('distant', 0)} union all {_expansion('promise', 0)}), s as (select seq, sum({_BM}) score from idx join e using (term), stat where weight is not null group by seq)
select seq, round(score + case when contains(lower(text), 'distant promise') then 50 when contains(lower(text), 'distant') and contains(lower(text), 'promise') then 15 else 0 end, 6) score from s join verses using (seq) order by 2 desc, 1 limit 50""",
    "fuzzy_vocab": f"{_V}, {_IDX}, e as ({_expansion('gathered', 2)} union all {_expansion('river', 1)}) select word, term, round(weight, 6) weight from e where weight is not null",
    "reading_time": rf"""{_V}, w as (select book, chapter, sum(len(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '')))::bigint words from verses group by all) select book, chapter, words, greatest(1, floor(words / 200 + 0.5))::int as "minutes" from w""",
    "year_labels": "with e as (select seq, try_cast(trim(start_date) as int) y from bible_events) select seq, y as \"year\", case when y < 0 then '~' || -y || ' BC' when y >= 0 then 'AD ' || y end \"label\" from e",
    "confidence_bins": "select case when confidence >= 0.9 then 'certain' when confidence >= 0.7 then 'probable' when confidence >= 0.5 then 'possible' else 'uncertain' end \"label\", count(*) n from place group by 1",
    "name_forms": r"""with n as (select ext_id, english_label e, trim(regexp_replace(regexp_replace(trim(lower(english_label)), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) n, trim(regexp_replace(regexp_replace(trim(lower(split_part(english_label, '(', 1))), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) b from ext_person)
select ext_id, n "name", case when contains(e, '(') and b <> '' and b <> n then b end base, regexp_replace(e, '\s+\d+$', '') bare,
  regexp_replace(regexp_replace(regexp_replace(trim(lower(e)), '[''’]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') slug,
  array_to_string(list_transform(list_filter(string_split_regex(trim(e), '\s+'), lambda w: w <> '')[1:2], lambda w: upper(w[1])), '') initials from n""",
    "place_forms": r"""select id, trim(replace(regexp_replace(regexp_replace(regexp_replace(lower(name), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'), '\bmount\b', 'mt', 'g'), 'city of', '')) "name", strip_accents(lower(name)) folded from geo_row""",
    "id_names": r"select seq, array_to_string(list_transform(string_split(regexp_replace(id, '_\d+$', ''), '_'), lambda p: upper(p[1]) || p[2:]), ' ') \"name\" from person".replace('\\"', '"'),
    "verse_labels": f"with {_MEN} select id, osis_id, case when len(string_split(osis_id, '.')) = 3 then split_part(osis_id, '.', 1) || ' ' || split_part(osis_id, '.', 2) || ':' || split_part(osis_id, '.', 3) else osis_id end \"label\", 'verse:' || osis_id node from m",
    "normalized_refs": r"""with p as (select seq, generate_subscripts(x, 1) i, unnest(x) s from (select seq, string_split_regex(verses, '[,;]') x from people where verses is not null)),
u as (select seq, i, split_part(regexp_replace(s, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g'), '-', 1) k from p), t as (select seq, i, regexp_replace(k, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g') k from u), f as (select seq, k, min(i) i from t where regexp_full_match(k, '[A-Za-z0-9_]+\.\d+\.\d+') group by all)
select people.seq, coalesce(r, '') refs from people left join (select seq, string_agg(k, ' ' order by i) r from f group by 1) x on x.seq = people.seq""",
    "event_props": "select event_id, props::json->>'$.page' page, props::json->>'$.ref' as \"ref\" from events",
    "verse_runs": f"""{_V}, d as (select distinct book, chapter, verse from verses where verse is not null), i as (select *, verse - row_number() over (partition by book, chapter order by verse) g from d), r as (select book, chapter, min(verse) a, max(verse) b from i group by book, chapter, g)
select book, chapter, string_agg(case when a = b then a::varchar else a || '–' || b end, ', ' order by a) verses from r group by all""",
    "stemmed_words": f"{_V}, {_IDX} select term, case {_STEM} else term end stem from df where regexp_full_match(term, '[a-z]+')",
}
SQL["concordance_exact"] = rf"""{_V} select translation_id, osis_id, seq, lower(s) surface, count(*) as "count" from (select translation_id, osis_id, seq, unnest(regexp_extract_all(text, '(?i)\bcovenant\b')) s from verses) group by all"""
