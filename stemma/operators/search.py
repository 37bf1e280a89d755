"""Concordance, ids of tagged words, lemma groups and ranked full-text search over verses.

A verses table has translation_id, book, chapter, verse, osis_id, text and, where tagged, lemmas (array) and align (array of spans).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.functions import text as T
from stemma.util import cut

#: BM25+ (Lv & Zhai 2011): saturation, length, lower bound.
K1, B, DELTA = 1.2, 0.75, 0.5
PREFIX_WEIGHT, FUZZY_WEIGHT = 0.375, 0.45


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, surface>> of a pattern's matches; positions count characters from 0."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct((F.length(g) + F.length(m)).alias("n"), m.alias("m")))
    block = 128  # positions add up within a block, blocks start at the sum before them: long texts stay cheap

    def walk(z: Column, b: Column) -> Column:
        start = F.aggregate(F.slice(z, F.lit(1), b * block), F.lit(0), lambda acc, x: acc + x["n"])
        row = lambda end, m: F.struct((end - F.length(m)).alias("start"), end.alias("end"), F.lower(m).alias("surface"))
        return F.aggregate(
            F.slice(z, b * block + 1, F.lit(block)),
            F.struct(start.alias("at"), F.array().cast("array<struct<start:int,end:int,surface:string>>").alias("out")),
            lambda acc, x: F.struct((acc["at"] + x["n"]).alias("at"), F.concat(acc["out"], F.array(row(acc["at"] + x["n"], x["m"]))).alias("out")),
        )["out"]

    # bound to a variable, so that it is evaluated once
    placed = F.transform(F.array(pairs), lambda z: F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(z) / block).cast("int") - 1, F.lit(0))), lambda b: walk(z, b))))
    return F.coalesce(F.get(placed, F.lit(0)), F.array().cast("array<struct<start:int,end:int,surface:string>>"))


def concordance(verses: DataFrame, word: str, variants: bool = False, keep: tuple[str, ...] = ("translation_id", "osis_id", "seq")) -> DataFrame:
    """The kept columns, surface, count of every verse that has the word: one row per verse and surface. A blank word finds nothing."""
    pattern = T.word_pattern(word, variants)
    if pattern is None:
        return verses.select(*keep, F.lit("").alias("surface"), F.lit(0).cast("bigint").alias("count")).limit(0)
    # the cheap test first: rows without the word never build arrays
    hits = verses.filter(F.col("text").rlike(pattern)).select(*keep, F.explode(F.regexp_extract_all("text", F.lit(f"({pattern})"), 1)).alias("surface"))
    return hits.groupBy(*keep, F.lower("surface").alias("surface")).agg(F.count("*").alias("count"))


def id_search(verses: DataFrame, query: str, keep: tuple[str, ...] = ("translation_id", "osis_id", "seq")) -> DataFrame:
    """The kept columns, surface, count of verses whose lemmas have the id: by its aligned words if there are any, else the id itself stands in."""
    wanted = T.id_query(F.lit(query))
    aligned = F.filter("align", lambda s: F.array_contains(s["ids"], wanted))
    words = F.transform(aligned, lambda s: F.lower(F.substr("text", s["start"] + 1, s["end"] - s["start"])))
    bag = F.transform(F.filter("lemmas", lambda t: t == wanted), lambda t: t)
    rows = verses.filter(F.array_contains("lemmas", wanted)).select(*keep, F.explode(F.when(F.size(F.coalesce(words, F.array().cast("array<string>"))) > 0, words).otherwise(bag)).alias("surface"))
    return rows.groupBy(*keep, "surface").agg(F.count("*").alias("count"))


def lemma_hits(verses: DataFrame, word: str, variants: bool = False, keep: tuple[str, ...] = ("translation_id", "osis_id", "seq")) -> DataFrame:
    """The kept columns, hit (number of the match in its verse), surface, lemma: a row per match and id of the words it lies on; lemma is null where none does."""
    pattern = T.word_pattern(word, variants)
    if pattern is None:
        return verses.select(*keep, F.lit(0).alias("hit"), F.lit("").alias("surface"), F.lit("").alias("lemma")).limit(0)
    rows = verses.filter(F.col("text").rlike(pattern)).select(*keep, "align", F.posexplode(matches(F.col("text"), pattern)).alias("hit", "m"))
    covering = F.filter(F.coalesce("align", F.array().cast("array<struct<start:int,end:int,ids:array<string>>>")), lambda s: (s["start"] < F.col("m.end")) & (s["end"] > F.col("m.start")))
    ids = F.array_distinct(F.flatten(F.transform(covering, lambda s: s["ids"])))
    return rows.select(*keep, "hit", F.col("m.surface").alias("surface"), F.explode_outer(ids).alias("lemma"))


def lemma_groups(hits: DataFrame, keep: tuple[str, ...] = ("translation_id", "osis_id")) -> DataFrame:
    """lemma, hits, verses, surfaces (text: 'surface count', most frequent first), of each group; the group of no lemma has null.

    Hits of several translations add up. A match on words of several ids counts for each of them.
    """
    hits = cut(hits)  # read twice
    surfaces = hits.groupBy("lemma", "surface").agg(F.count("*").alias("n"))
    lists = surfaces.groupBy("lemma").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "surface", "n"))), lambda s: F.concat_ws(" ", s["surface"], s["n"])), ", ").alias("surfaces"))
    counts = hits.groupBy("lemma").agg(F.count("*").alias("hits"), F.countDistinct(*keep).alias("verses"))
    return counts.join(lists, counts["lemma"].eqNullSafe(lists["lemma"])).select(counts["lemma"], "hits", "verses", "surfaces")


def lexicon_search(lexicon: DataFrame, query: str) -> DataFrame:
    """Entries whose gloss or lemma has the folded query, or whose folded transliteration has it, or whose id it is."""
    q = T.fold(F.lit(query.strip()))
    wanted = T.id_query(F.lit(query))
    return lexicon.filter(F.lower("gloss").contains(q) | F.lower("lemma").contains(q) | T.fold(F.col("transliteration")).contains(q) | F.coalesce(F.col("id") == wanted, F.lit(False)))


def study(groups: DataFrame, lexicon: DataFrame, query: str) -> DataFrame:
    """ord, lemma, hits, gloss: lemma groups with their lexicon entry (id, gloss, ...; null where there is none), the most frequent first, the group of no lemma after them; then the entries that the query finds in the lexicon and no group has.

    The groups of one word are few, which is why they are numbered in one task.
    """
    named = groups.select("lemma", "hits").join(lexicon.select(F.col("id").alias("lemma"), "gloss"), "lemma", "left").select(F.lit(0).alias("part"), "lemma", "hits", "gloss")
    more = lexicon_search(lexicon, query).join(groups.select(F.col("lemma").alias("id")), "id", "left_anti").select(F.lit(1).alias("part"), F.col("id").alias("lemma"), F.lit(0).cast("long").alias("hits"), "gloss")
    order = Window.orderBy("part", F.col("lemma").isNull(), F.desc("hits"), "lemma")
    return named.unionByName(more).select(F.row_number().over(order).alias("ord"), "lemma", "hits", "gloss")


def entries_of(verses: DataFrame, lexicon: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns and the lexicon entry (all columns) of each distinct lemma of a verse; lemmas without an entry are left out."""
    ids = verses.select(*keep, F.explode(F.array_distinct("lemmas")).alias("id")).distinct()
    return ids.join(lexicon, "id")


def terms(text: Column) -> Column:
    """Lower-case words of a text without stop words."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*T.STOP_WORDS))


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf, length: the inverted index. The only shuffle is on (key, term), after a map-side count."""
    rows = docs.select(F.col(key), terms(F.col(text)).alias("terms")).withColumn("length", F.size("terms"))
    return rows.select(key, "length", F.explode("terms").alias("term")).groupBy(key, "term", "length").agg(F.count("*").alias("tf"))


def _found_by(term: Column, w: str, prefix: bool, fuzzy: float) -> Column:
    """The weight by which a word finds a term; null if it doesn't."""
    best = F.when(term == w, 1.0)
    if prefix:
        best = best.when(term.startswith(w), PREFIX_WEIGHT * len(w) / F.length(term))
    reach = int(fuzzy * len(w) + 0.5) if len(w) > 4 and not (w[0] in "hg" and w[1:2].isdigit()) else 0
    if reach:
        d = F.levenshtein(term, F.lit(w))
        best = best.when((F.abs(F.length(term) - len(w)) <= reach) & (d <= reach), FUZZY_WEIGHT * (1 - d / len(w)))
    return best


def expand(vocabulary: DataFrame, words: list[str], prefix: bool = True, fuzzy: float = 0.2) -> DataFrame:
    """word, term, weight: the terms that each word finds: itself (1), those it begins (less by length), and, for words over 4 letters that are no ids,
    those within fuzzy x length edits. Each pair once, by its best weight.
    """
    out = None
    for w in words:
        part = vocabulary.select(F.lit(w).alias("word"), "term", _found_by(F.col("term"), w, prefix, fuzzy).alias("weight")).filter("weight is not null")
        out = part if out is None else out.unionByName(part)
    return out


def search(index: DataFrame, key: str, query: str, prefix: bool = True, fuzzy: float = 0.2) -> DataFrame:
    """key, score by BM25+ of every document that has a term of the query or of its expansion (any of the words)."""
    words = [w for w in dict.fromkeys(query.lower().split()) if w not in T.STOP_WORDS]
    docs = index.groupBy(key).agg(F.max("length").alias("length")).agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    if not words:
        return index.select(key, F.lit(0.0).alias("score")).limit(0)
    found = expand(df, words, prefix, fuzzy).join(df, "term")
    # a few expanded terms; the planner sees their size
    rows = index.join(found.select("term", "weight", "df"), "term").join(F.broadcast(docs))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("weight") * idf * (DELTA + F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean"))))
    return rows.groupBy(key).agg(F.sum(part).alias("score"))


def _fields(docs: DataFrame, key: str, by: str, text: str, lemmas: str | None) -> DataFrame:
    """by, key, field, length, terms: a row per document and field; text and lemmas (array, may be null) are the fields."""
    fields = [F.struct(F.lit("text").alias("field"), terms(F.col(text)).alias("terms"))]
    if lemmas:
        low = F.filter(F.transform(F.coalesce(lemmas, F.array().cast("array<string>")), lambda x: F.lower(x)), lambda x: (x != "") & ~x.isin(*T.STOP_WORDS))
        fields.append(F.struct(F.lit("lemmas").alias("field"), low.alias("terms")))
    return docs.select(by, key, F.explode(F.array(*fields)).alias("f")).select(by, key, "f.field", F.size("f.terms").alias("length"), "f.terms")


def field_postings(docs: DataFrame, key: str, by: str = "translation_id", text: str = "text", lemmas: str | None = "lemmas") -> DataFrame:
    """by, key, field, term, tf, length: as :func:`postings`, of the text and of the lemmas (array, may be null), with the column that tells the indexes apart."""
    rows = _fields(docs, key, by, text, lemmas).select(by, key, "field", "length", F.explode("terms").alias("term"))
    return rows.groupBy(by, key, "field", "term", "length").agg(F.count("*").alias("tf"))


def _query_words(query: str) -> list[str]:
    return [w for w in dict.fromkeys(query.lower().split()) if w not in T.STOP_WORDS]


def _score_each(hits: DataFrame, lengths: DataFrame, key: str, by: str, words: list[str], prefix: bool, fuzzy: float) -> DataFrame:
    """by, key, score from postings (hits: at least all of those that the words find) and the lengths of all documents' fields."""
    counts = lengths.groupBy(by).agg(F.countDistinct(key).alias("n"))
    means = lengths.groupBy(by, "field", key).agg(F.max("length").alias("length")).groupBy(by, "field").agg(F.avg("length").alias("mean"))
    df = hits.groupBy(by, "field", "term").agg(F.count("*").alias("df"))
    found = expand(df.select("term").distinct(), words, prefix, fuzzy)
    rows = hits.join(found.select("term", "weight"), "term").join(df, [by, "field", "term"]).join(means, [by, "field"]).join(counts, by)
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("weight") * idf * (DELTA + F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean"))))
    return rows.groupBy(by, key).agg(F.sum(part).alias("score"))


def search_each(index: DataFrame, key: str, query: str, by: str = "translation_id", prefix: bool = True, fuzzy: float = 0.2) -> DataFrame:
    """by, key, score by BM25+ over the fields of :func:`field_postings`: each index has its own number of documents, and each of its fields its own document frequencies and mean length. by and field aren't null."""
    if not (words := _query_words(query)):
        return index.select(by, key, F.lit(0.0).alias("score")).limit(0)
    index = cut(index)  # read several times
    return _score_each(index, index, key, by, words, prefix, fuzzy)


def search_docs(docs: DataFrame, key: str, query: str, by: str = "translation_id", text: str = "text", lemmas: str | None = "lemmas", prefix: bool = True, fuzzy: float = 0.2) -> DataFrame:
    """:func:`search_each` over documents that have no stored index: one pass over the texts, which keeps every field's length and, of its terms, those that the query finds. No other term counts in a score."""
    if not (words := _query_words(query)):
        return docs.select(by, key, F.lit(0.0).alias("score")).limit(0)
    asked = lambda t: F.coalesce(*[_found_by(t, w, prefix, fuzzy) for w in words]).isNotNull()
    rows = _fields(docs, key, by, text, lemmas).filter("length > 0")
    seen = cut(rows.select(by, key, "field", "length", F.filter("terms", asked).alias("terms")))  # read several times
    hits = seen.select(by, key, "field", "length", F.explode("terms").alias("term")).groupBy(by, key, "field", "term", "length").agg(F.count("*").alias("tf"))
    return _score_each(hits, seen, key, by, words, prefix, fuzzy)


def in_testament(scored: DataFrame, books: DataFrame, testament: str) -> DataFrame:
    """Of scored rows (book) those whose book (book, testament) is of the testament; before :func:`top`, so that the limit counts these only."""
    return scored.join(books.filter(F.col("testament") == testament).select("book").distinct(), "book", "left_semi")


def bonus(text: Column, query: str) -> Column:
    """50 where the text has the whole phrase, else 15 where it has all of several words, else 0; 0 for queries without a blank."""
    phrase = query.strip().lower()
    if " " not in phrase:
        return F.lit(0)
    words = [w for w in phrase.split() if w not in T.STOP_WORDS]
    low = F.lower(F.coalesce(text, F.lit("")))
    every = F.lit(len(words) > 1)
    for w in words:
        every = every & low.contains(w)
    return F.when(low.contains(phrase), 50).when(every, 15).otherwise(0)


def rerank(scored: DataFrame, text: str, query: str) -> DataFrame:
    """scored with its :func:`bonus` added; only for queries with a blank."""
    return scored.withColumn("score", F.col("score") + bonus(F.col(text), query)) if " " in query.strip() else scored


def top(scored: DataFrame, *ties: str, n: int = 50) -> DataFrame:
    return scored.orderBy(F.desc("score"), *ties).limit(n)


def dispatch(query: str, selected: list[str], tagged: list[str]) -> tuple[str, list[str]]:
    """Which search a query gets and over which translations: ids over the tagged ones selected, else over all tagged; words by lemma
    if any selected one is tagged, else flat over the selected.
    """
    both = [t for t in selected if t in tagged]
    q = query.strip()
    if q[:1].lower() in ("h", "g") and q[1:].isdigit() and len(q[1:].lstrip("0") or "0") <= 5:
        return "id", both or tagged
    return ("lemma", both) if both else ("flat", selected)
