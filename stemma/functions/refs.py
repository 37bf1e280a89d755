"""Passage references: books, keys and their readable forms, as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The books in canonical order as OSIS id, name and chapters, by part.
BOOKS = {
    "OT": (
        ("Gen", "Genesis", 50), ("Exod", "Exodus", 40), ("Lev", "Leviticus", 27), ("Num", "Numbers", 36), ("Deut", "Deuteronomy", 34), ("Josh", "Joshua", 24), ("Judg", "Judges", 21), ("Ruth", "Ruth", 4),
        ("1Sam", "1 Samuel", 31), ("2Sam", "2 Samuel", 24), ("1Kgs", "1 Kings", 22), ("2Kgs", "2 Kings", 25), ("1Chr", "1 Chronicles", 29), ("2Chr", "2 Chronicles", 36), ("Ezra", "Ezra", 10), ("Neh", "Nehemiah", 13),
        ("Esth", "Esther", 10), ("Job", "Job", 42), ("Ps", "Psalms", 150), ("Prov", "Proverbs", 31), ("Eccl", "Ecclesiastes", 12), ("Song", "Song of Solomon", 8), ("Isa", "Isaiah", 66), ("Jer", "Jeremiah", 52),
        ("Lam", "Lamentations", 5), ("Ezek", "Ezekiel", 48), ("Dan", "Daniel", 12), ("Hos", "Hosea", 14), ("Joel", "Joel", 3), ("Amos", "Amos", 9), ("Obad", "Obadiah", 1), ("Jonah", "Jonah", 4), ("Mic", "Micah", 7),
        ("Nah", "Nahum", 3), ("Hab", "Habakkuk", 3), ("Zeph", "Zephaniah", 3), ("Hag", "Haggai", 2), ("Zech", "Zechariah", 14), ("Mal", "Malachi", 4),
    ),
    "AP": (
        ("Tob", "Tobit", 14), ("Jdt", "Judith", 16), ("EsthGr", "Greek Esther", 16), ("Wis", "Wisdom of Solomon", 19), ("Sir", "Sirach", 51), ("Bar", "Baruch", 6), ("EpJer", "Epistle of Jeremiah", 1), ("PrAzar", "Prayer of Azariah", 1),
        ("Sus", "Susanna", 1), ("Bel", "Bel and the Dragon", 1), ("1Macc", "1 Maccabees", 16), ("2Macc", "2 Maccabees", 15), ("1Esd", "1 Esdras", 9), ("2Esd", "2 Esdras", 16), ("PrMan", "Prayer of Manasseh", 1), ("AddPs", "Additional Psalm", 1), ("3Macc", "3 Maccabees", 7),
    ),
    "NT": (
        ("Matt", "Matthew", 28), ("Mark", "Mark", 16), ("Luke", "Luke", 24), ("John", "John", 21), ("Acts", "Acts", 28), ("Rom", "Romans", 16), ("1Cor", "1 Corinthians", 16), ("2Cor", "2 Corinthians", 13), ("Gal", "Galatians", 6),
        ("Eph", "Ephesians", 6), ("Phil", "Philippians", 4), ("Col", "Colossians", 4), ("1Thess", "1 Thessalonians", 5), ("2Thess", "2 Thessalonians", 3), ("1Tim", "1 Timothy", 6), ("2Tim", "2 Timothy", 4), ("Titus", "Titus", 3),
        ("Phlm", "Philemon", 1), ("Heb", "Hebrews", 13), ("Jas", "James", 5), ("1Pet", "1 Peter", 5), ("2Pet", "2 Peter", 3), ("1John", "1 John", 5), ("2John", "2 John", 1), ("3John", "3 John", 1), ("Jude", "Jude", 1), ("Rev", "Revelation", 22),
    ),
}
#: Short forms that no rule gives, by book.
SHORT_FORMS = {
    "Gen": ("ge",), "Exod": ("exo", "ex"), "Lev": ("le",), "Num": ("nu",), "Deut": ("dt",), "Josh": ("jos",), "Judg": ("jdg",), "Ruth": ("ru",), "1Sam": ("1sa",), "2Sam": ("2sa",), "1Kgs": ("1ki",), "2Kgs": ("2ki",),
    "1Chr": ("1ch",), "2Chr": ("2ch",), "Ezra": ("ezr",), "Neh": ("ne",), "Esth": ("est",), "Job": ("jb",), "Ps": ("psalm", "psa"), "Prov": ("pr", "pro"), "Eccl": ("ecc", "ec"), "Song": ("sos", "ss"), "Isa": ("is",),
    "Jer": ("je",), "Lam": ("la",), "Ezek": ("eze",), "Dan": ("da",), "Hos": ("ho",), "Joel": ("joe",), "Amos": ("am",), "Obad": ("ob",), "Jonah": ("jon",), "Nah": ("na",), "Zeph": ("zep",), "Zech": ("zec",),
    "Matt": ("mat", "mt"), "Mark": ("mk", "mr"), "Luke": ("lk", "lu"), "John": ("joh", "jn"), "Acts": ("act", "ac"), "Rom": ("ro",), "1Cor": ("1co",), "2Cor": ("2co",), "Gal": ("ga",), "Phil": ("php",), "1Thess": ("1th",),
    "2Thess": ("2th",), "1Tim": ("1ti",), "2Tim": ("2ti",), "Titus": ("tit",), "Phlm": ("phm",), "Jas": ("jm",), "1Pet": ("1pe",), "2Pet": ("2pe",), "1John": ("1jn",), "2John": ("2jn",), "3John": ("3jn",), "Jude": ("jud",),
    "Rev": ("re", "apocalypse"),
}


def aliases() -> dict[str, str]:
    """Lower-case names by book id: names, ids, short forms, and the numbered ones with and without a blank after the digit."""
    found: dict[str, str] = {}
    for book, name, _ in chain.from_iterable(BOOKS.values()):
        for form in (name.lower(), book.lower(), *SHORT_FORMS.get(book, ())):
            found.setdefault(form, book)
            if form[0].isdigit():
                rest = form[1:].strip()
                found.setdefault(f"{form[0]} {rest}", book)
                found.setdefault(form[0] + rest, book)
    return found


def _lookup(pairs: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


def find_book(q: Column, also: dict[str, str] | None = None) -> Column:
    """The id of a book by its id (case counts), or by name or id in any case; null if unknown. ``also``: further lower-case names."""
    ids = [b for b, _, _ in chain.from_iterable(BOOKS.values())]
    names = {n.lower(): b for b, n, _ in chain.from_iterable(BOOKS.values())} | {b.lower(): b for b in ids} | (also or {})
    return F.when(q.isin(*ids), q).otherwise(_lookup(names, F.lower(q)))


def resolve_book(q: Column) -> Column:
    return find_book(F.trim(q), aliases())


def parse_reference(s: Column) -> Column:
    """struct(book, chapter, verse, verse_end) of a key ('Gen.1.1') or a readable reference ('1 Cor 13:4-7', 'Ps 119'); null if it is neither or the book is unknown.

    A key is a book of one word and one or two numbers, by full stops. A readable reference ends, after a blank, in a chapter, perhaps with a colon and a
    verse or a range of verses; blanks around the hyphen don't count.
    """
    s = F.trim(s)
    number = lambda c: F.when(c.rlike("^[0-9]+$"), c.try_cast("int"))
    at = lambda c, i: F.get(c, F.lit(i))
    none = F.lit(None).cast("int")

    key = F.split(s, r"\.")
    bad_key = F.exists(F.slice(key, 2, 2), lambda n: ~n.rlike("^[0-9]+$")) | ~F.size(key).isin(2, 3) | (F.size(F.split(F.regexp_replace(at(key, 0), r"^[0-9] ?", ""), " ")) > 1)
    by_key = F.when(~bad_key, F.struct(resolve_book(at(key, 0)).alias("book"), number(at(key, 1)).alias("chapter"), number(at(key, 2)).alias("verse"), none.alias("verse_end")))

    words = F.split(F.regexp_replace(s, r"\s*-\s*", "-"), r"\s+")
    where = F.split(F.element_at(words, -1), ":")
    verses = F.split(F.coalesce(at(where, 1), F.lit("")), "-")
    name = F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " ")
    fits = number(at(where, 0)).isNotNull() & ((F.size(where) == 1) | (F.size(where) == 2) & (F.size(verses) <= 2) & ~F.exists(verses, lambda v: ~v.rlike("^[0-9]+$")))
    readable = F.when((F.size(words) > 1) & fits, F.struct(resolve_book(name).alias("book"), number(at(where, 0)).alias("chapter"), number(at(verses, 0)).alias("verse"), number(at(verses, 1)).alias("verse_end")))

    known = lambda r: F.when(r["book"].isNotNull(), r)
    return F.coalesce(known(by_key), known(readable))


def format_reference(book: Column, chapter: Column, verse: Column, verse_end: Column) -> Column:
    """'Name c', 'Name c:v' or 'Name c:v-w'; the end only if it differs; an unknown book as it is."""
    names = {b: n for b, n, _ in chain.from_iterable(BOOKS.values())}
    name = F.coalesce(_lookup(names, book), book)
    tail = F.when(verse.isNotNull(), F.concat(F.lit(":"), verse.cast("string"), F.when(verse_end.isNotNull() & (verse_end != verse), F.concat(F.lit("-"), verse_end.cast("string"))).otherwise("")))
    return F.concat(name, F.lit(" "), chapter.cast("string"), F.coalesce(tail, F.lit("")))


def to_osis(book: Column, chapter: Column, verse: Column) -> Column:
    return F.concat_ws(".", book, chapter.cast("string"), verse.cast("string"))


def _strip(c: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(c, r"^[\s\u00a0\u2007\u202f\u3000]+|[\s\u00a0\u2007\u202f\u3000]+$", "")


def normalize_verse(raw: Column) -> Column:
    """The first verse of a reference as a key; null if it is none."""
    first = _strip(F.split_part(_strip(raw), F.lit("-"), F.lit(1)))
    return F.when(first.rlike(r"^[A-Za-z0-9_]+\.\d+\.\d+$"), first)


def normalize_refs(raw: Column) -> Column:
    """Distinct keys of a list that commas and semicolons separate, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), "[,;]"), normalize_verse), lambda x: x.isNotNull()))


def verse_label(osis: Column) -> Column:
    """'B c:v' of 'B.c.v'; anything else as it is."""
    p = F.split(osis, r"\.")
    return F.when(F.size(p) == 3, F.concat(F.get(p, F.lit(0)), F.lit(" "), F.get(p, F.lit(1)), F.lit(":"), F.get(p, F.lit(2)))).otherwise(osis)


def node_id(kind: str, *key: Column) -> Column:
    """'verse:', 'book:', 'chapter:', 'person:', 'place:' or 'event:' and the key's parts."""
    return F.concat(F.lit(f"{kind}:"), F.concat_ws(".", *key))


def verse_of_node(node: Column) -> Column:
    return F.when(node.startswith("verse:"), F.substring(node, 7, 1 << 20))


def link_to_edge(link_id: Column, source: Column, target: Column, kind: Column, votes: Column) -> Column:
    """A link as a graph edge between verse nodes."""
    return F.struct(link_id.alias("id"), node_id("verse", source).alias("source"), node_id("verse", target).alias("target"), F.lit("link").alias("category"), kind.alias("type"), votes.alias("weight"))


def citations(text: Column) -> Column:
    """Keys that a text cites, in order: 'Book c:v' (a range by its start), and further verses of the chapter after a comma ('John 3:16, 18'). Unknown books are passed over."""
    pattern = r"((?:[1-3]\s?)?[A-Z][A-Za-z]*\.?\s+\d+:\d+(?:[-–]\d+)?(?:,\s*\d+(?:[-–]\d+)?(?![:\d]))*)"
    found = F.regexp_extract_all(text, F.lit(pattern), 1)

    def keys(c: Column) -> Column:
        head = r"^((?:[1-3]\s?)?[A-Z][A-Za-z]*)\.?\s+(\d+):(.*)$"
        book = resolve_book(F.regexp_extract(c, head, 1))
        verses = F.transform(F.split(F.regexp_extract(c, head, 3), r",\s*"), lambda v: F.concat_ws(".", book, F.regexp_extract(c, head, 2), F.regexp_extract(v, r"^(\d+)", 1)))
        return F.when(book.isNotNull(), verses).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(found, keys))
