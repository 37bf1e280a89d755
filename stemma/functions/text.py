"""Names, words, markup and labels as column expressions. Everything stays in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that the full-text index leaves out.
STOP_WORDS = (
    "the", "and", "of", "in", "to", "a", "is", "was", "that", "it", "for", "his", "he", "she", "her", "with", "be", "not", "but", "they", "shall", "unto", "upon", "from", "by", "as", "all", "are", "this", "them", "which",
    "their", "were",
)
#: Endings that the variant search takes off, one after the other, and what replaces each.
STEM_RULES = (("ieth", "y"), ("ied", "y"), ("ies", "y"), ("eth", ""), ("est", ""), ("ing", ""), ("ed", ""), ("es", ""), ("s", ""), ("e", ""))
#: Endings that the variant search accepts after the stem.
ENDINGS = ("s", "d", "th", "ing", "eth", "est", "er", "ers", "ieth", "ied", "ies", "y")
#: White space of any kind.
SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
#: Word boundaries as ASCII sees them, on both sides.
WORD_START, WORD_END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def word_pattern(word: str, variants: bool = False) -> str | None:
    """The regular expression (for any case) of a whole word or, with variants, of its stem with common endings; None for a blank word.

    All rules apply in turn, so that a word may not match itself; a stem under three letters falls back to the word.
    """
    w = word.strip().lower()
    if not w:
        return None
    if not variants:
        return f"(?i){WORD_START}{re.escape(w)}{WORD_END}"
    stem = w
    for old, new in STEM_RULES:
        stem = stem.removesuffix(old) + new if stem.endswith(old) else stem
    if len(stem) < 3:
        stem = w
    return f"(?i){WORD_START}{re.escape(stem)}e?(?:{'|'.join(ENDINGS)})?{WORD_END}"


def normalize_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.lower(c)), r"[^a-z0-9\s]", " "), r"\s+", " "))


def normalize_place(c: Column) -> Column:
    """Lower case, punctuation to blanks, one blank each; 'mount' as 'mt', without 'city of'."""
    c = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", " "), r"\s+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\bmount\b", "mt"), r"\bcity of\b", ""))


def without_number(c: Column) -> Column:
    """Without the number that tells homonyms apart ('Jericho 1')."""
    return F.regexp_replace(c, r"\s+\d+$", "")


def base_name(c: Column) -> Column:
    """The normalized text before a parenthesis; null if there is none, or nothing before it."""
    base = normalize_name(F.split_part(c, F.lit("("), F.lit(1)))
    return F.when(c.contains("(") & (base != "") & (base != normalize_name(c)), base)


def without_links(c: Column) -> Column:
    """[text](target) as text."""
    return F.regexp_replace(c, r"\[([^\]]*)\]\([^)]*\)", "$1")


def remove_elements(xml: Column, *tags: str) -> Column:
    """Without the elements and their content, however deep they nest; a self-closing one stays, one that is never closed takes the rest with it, a closing tag without an opening one goes."""
    for tag in tags:
        xml = _without_element(xml, tag)
    return xml


def _without_element(xml: Column, tag: str) -> Column:
    """The text is cut at the tags; a count of open elements tells which pieces are outside."""
    opens, closes = rf"<{tag}(?=[\s>])(?:[^>/]|/(?!>))*>", rf"</{tag}\s*>"
    pieces = F.split(xml, f"(?={opens}|{closes})", -1)  # every piece but the first begins with its tag

    def keep(acc: Column, x: Column) -> Column:
        depth = F.when(x.rlike(f"^{closes}"), F.greatest(acc["depth"] - 1, F.lit(0))).when(x.rlike(f"^{opens}"), acc["depth"] + 1).otherwise(acc["depth"])
        return F.struct(depth.alias("depth"), F.when(depth == 0, F.concat(acc["kept"], F.array(F.regexp_replace(x, f"^(?:{opens}|{closes})", "")))).otherwise(acc["kept"]).alias("kept"))

    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("kept"))
    return F.when(xml.rlike(f"{opens}|{closes}"), F.array_join(F.aggregate(pieces, start, keep)["kept"], "")).otherwise(xml)


def decode_entities(c: Column) -> Column:
    """The five entities, '&amp;' first: '&amp;lt;' becomes '<'."""
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def plain_text(xml: Column, inline: tuple[str, ...] = ("w",)) -> Column:
    """Inline tags vanish, other tags become blanks, entities are decoded, blanks collapse."""
    c = F.regexp_replace(xml, rf"</?(?:{'|'.join(inline)})(?=[\s>/])[^>]*>", "")
    return F.trim(F.regexp_replace(decode_entities(F.regexp_replace(c, r"<[^>]*>", " ")), f"{SPACE}+", " "))


def osis_text(xml: Column) -> Column:
    """As :func:`plain_text` with the inline wrappers of tagged editions, and divine names in capitals."""
    name = r"(?s)<divineName[^>]*>(.*?)</divineName>"
    outside, inside = F.split(xml, name, -1), F.regexp_extract_all(xml, F.lit(name), 1)
    joined = F.array_join(F.zip_with(outside, inside, lambda o, i: F.concat(o, F.coalesce(F.upper(i), F.lit("")))), "")
    return plain_text(joined, ("w", "transChange", "divineName", "seg", "q"))


def lemmas(xml: Column, attributes: tuple[str, ...] = ("lemma",), strip_zeros: bool = True) -> Column:
    """Distinct ids (H or G, a number, perhaps a letter) of the word tags, in order; leading zeros go, or stay."""
    found = F.regexp_extract_all(xml, F.lit(rf"\b(?:{'|'.join(attributes)})=\"([^\"]*)\""), 1)
    words = F.flatten(F.transform(found, lambda x: F.split(F.trim(x), r"\s+")))
    ids = F.transform(words, lambda x: F.upper(F.regexp_replace(x, r"(?i)^(?:strong:|lemma\.)", "")))
    ids = F.filter(ids, lambda x: x.rlike(r"^[HG]\d+[A-Z]?$"))
    return F.array_distinct(F.transform(ids, lambda x: F.regexp_replace(x, r"^([HG])0+(?=\d)", "$1")) if strip_zeros else ids)


def normalize_id(c: Column) -> Column:
    """One id without prefix and leading zeros; null if it is none."""
    x = F.regexp_replace(F.upper(F.regexp_replace(F.trim(c), r"(?i)^(?:strong:|lemma\.)", "")), r"^([HG])0+(?=\d)", "$1")
    return F.when(x.rlike(r"^[HG]\d+[A-Z]?$"), x)


def id_query(c: Column) -> Column:
    """The id that a query asks for ('h007225' as H7225); null if it asks for none. Ids with a letter can't be asked for."""
    p = r"(?i)^([HG])0*(\d{1,5})$"
    c = F.trim(c)
    return F.when(c.rlike(p), F.concat(F.upper(F.regexp_extract(c, p, 1)), F.regexp_extract(c, p, 2)))


def spans(align: Column) -> Column:
    """array<struct<start, end, ids>> of '[[start, end, "H1 H2"], ...]'; empty if missing or malformed."""
    rows = F.from_json(align, "array<array<string>>")
    parsed = F.transform(rows, lambda r: F.struct(F.get(r, F.lit(0)).try_cast("int").alias("start"), F.get(r, F.lit(1)).try_cast("int").alias("end"), F.split(F.get(r, F.lit(2)), " ").alias("ids")))
    return F.coalesce(parsed, F.array().cast("array<struct<start:int,end:int,ids:array<string>>>"))


def ranges(wj: Column) -> Column:
    """array<struct<start, end>> of '[[start, end], ...]'; empty if missing or malformed."""
    parsed = F.transform(F.from_json(wj, "array<array<int>>"), lambda r: F.struct(F.get(r, F.lit(0)).alias("start"), F.get(r, F.lit(1)).alias("end")))
    return F.coalesce(parsed, F.array().cast("array<struct<start:int,end:int>>"))


def gloss_parts(raw: Column) -> Column:
    """struct(translit, pronunciation, gloss) of a lexicon cell: the first word; the first parenthesis with broken hyphens mended; the first numbered line, else the first line."""
    first = F.trim(F.split_part(raw, F.lit("\n"), F.lit(1)))
    said = F.regexp_replace(F.regexp_replace(F.regexp_extract(raw, r"(?s)\(([^)]*)\)", 1), r"-\s+", "-"), r"\s+", " ")
    sense = F.trim(F.regexp_extract(raw, r"(?m)^\s*\d+\.\s*(.*)$", 1))
    return F.struct(F.regexp_extract(F.ltrim(raw), r"^([^\s(]*)", 1).alias("translit"), F.nullif(F.trim(said), F.lit("")).alias("pronunciation"), F.when(sense != "", sense).otherwise(first).alias("gloss"))


def fallback_gloss(short: Column, long: Column) -> Column:
    """The short definition, else the long one up to its first ; or full stop, without leading punctuation."""
    cut = F.regexp_extract(long, r"^([^;.]+)[;.]?", 1)
    return F.trim(F.regexp_replace(F.coalesce(F.nullif(F.trim(short), F.lit("")), F.when(cut != "", cut).otherwise(long)), r"^[\s:;,.\-–—]+", ""))


def fold(c: Column) -> Column:
    """Lower case without the marks of accented letters."""
    import unicodedata

    marked = [chr(i) for i in [*range(0xC0, 0x250), *range(0x370, 0x400), *range(0x1E00, 0x2000)] if unicodedata.normalize("NFD", chr(i))[0] != chr(i)]
    plain = "".join(unicodedata.normalize("NFD", x)[0] for x in marked)
    return F.lower(F.translate(c, "".join(marked) + "".join(map(chr, range(0x300, 0x370))), plain))


def slug(c: Column) -> Column:
    c = F.regexp_replace(F.trim(F.lower(c)), "['’]", "")
    return F.regexp_replace(F.regexp_replace(c, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def name_from_id(c: Column) -> Column:
    """'simon_peter_12' as 'Simon Peter': only first letters change."""
    parts = F.split(F.regexp_replace(c, r"_\d+$", ""), "_")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 20))), " ")


def senses(c: Column) -> Column:
    """Numbered senses '(1) ... (2) ...': the text before them first, if any, empty ones left out; with fewer than two markers the whole text is one."""
    parts = F.transform(F.split(c, r"\(\d+\)"), lambda p: F.trim(p))
    return F.when(F.regexp_count(c, F.lit(r"\(\d+\)")) >= 2, F.filter(parts, lambda p: p != "")).otherwise(F.array(F.trim(c)))


def relation(depth: Column) -> Column:
    """What a descendant is called at a depth."""
    return F.when(depth == 0, "focused").when(depth == 1, "son").when(depth == 2, "grandson").when(depth == 3, "great-grandson").otherwise(F.concat((depth - 2).cast("string"), F.lit("× great-grandson")))


def confidence_label(c: Column) -> Column:
    return F.when(c >= 0.9, "certain").when(c >= 0.7, "probable").when(c >= 0.5, "possible").otherwise("uncertain")


def year_label(raw: Column) -> Column:
    """'~N BC' for years below 0, else 'AD N'; null if it isn't a number."""
    y = raw.try_cast("int")
    return F.when(y < 0, F.concat(F.lit("~"), (-y).cast("string"), F.lit(" BC"))).when(y >= 0, F.concat(F.lit("AD "), y.cast("string")))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != ""))


def minutes(words: Column, per_minute: int = 200) -> Column:
    """Reading time, rounded half up, at least 1."""
    return F.greatest(F.lit(1), F.floor(words / per_minute + 0.5)).cast("int")


def stem(c: Column) -> Column:
    """Without the first ending that leaves three letters."""
    low = F.lower(c)
    out = None
    for old, _ in STEM_RULES:
        hit = low.endswith(old) & (F.length(low) - len(old) >= 3)
        cut = F.substr(low, F.lit(1), F.length(low) - len(old))
        out = F.when(hit, cut) if out is None else out.when(hit, cut)
    return out.otherwise(low)


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def mark(c: Column, words: list[str]) -> Column:
    """HTML with each match of the words, whole and in any case, in <mark>; stop words alone mark nothing."""
    kept = [w for w in words if w.lower() not in STOP_WORDS and w.strip()]
    safe = escape_html(c)
    return F.regexp_replace(safe, f"(?i){WORD_START}({'|'.join(map(re.escape, kept))}){WORD_END}", "<mark>$1</mark>") if kept else safe


def verse_html(text: Column, names: list[str], quoted: Column) -> Column:
    """HTML of a text: whole names (in any case, the longest first) in <mark>, the ``quoted`` stretches (start, end) in <q>, which end and begin again where a mark does; everything else escaped.

    The text is cut wherever a mark or a stretch begins or ends, so that a name may reach over the edge of a stretch.
    """
    from stemma.operators.search import matches

    longest = sorted({n.lower() for n in names if n.strip()}, key=lambda n: (-len(n), n))
    none = F.array().cast("array<struct<start:int,end:int,surface:string>>")
    marks = matches(text, f"(?i){WORD_START}(?:{'|'.join(map(re.escape, longest))}){WORD_END}") if longest else none
    size = F.length(text)
    stretches = F.filter(F.coalesce(quoted, F.array().cast("array<struct<start:int,end:int>>")), lambda r: r["start"] < F.least(r["end"], size))

    def pieces(k: Column) -> Column:
        """Each piece of a text, k: its struct of marks and stretches."""
        cuts = F.concat(F.array(F.lit(0), size), F.transform(k["m"], lambda m: m["start"]), F.transform(k["m"], lambda m: m["end"]), F.transform(k["r"], lambda r: F.greatest(r["start"], F.lit(0))), F.transform(k["r"], lambda r: F.least(r["end"], size)))
        edges = F.array_sort(F.array_distinct(cuts))
        return bound(edges, lambda e: F.zip_with(F.slice(e, F.lit(1), F.size(e) - 1), F.slice(e, F.lit(2), F.size(e) - 1), lambda a, b: piece(k, a, b)))

    def piece(k: Column, a: Column, b: Column) -> Column:
        safe = escape_html(F.substr(text, a + 1, b - a))
        within = F.exists(k["r"], lambda r: (r["start"] <= a) & (b <= r["end"]))
        opens, closes = F.exists(k["m"], lambda m: m["start"] == a), F.exists(k["m"], lambda m: m["end"] == b)
        return F.concat(F.when(opens, "<mark>").otherwise(""), F.when(within, F.concat(F.lit("<q>"), safe, F.lit("</q>"))).otherwise(safe), F.when(closes, "</mark>").otherwise(""))

    return F.when(size > 0, F.array_join(bound(F.struct(marks.alias("m"), stretches.alias("r")), pieces), "")).otherwise(text)


def runs(numbers: Column) -> Column:
    """'1–3, 7' of [1, 2, 3, 7]: sorted distinct numbers by runs."""
    n = F.array_sort(F.array_distinct(numbers))
    starts = F.filter(n, lambda x: ~F.array_contains(n, x - 1))
    ends = F.filter(n, lambda x: ~F.array_contains(n, x + 1))
    return F.array_join(F.zip_with(starts, ends, lambda a, b: F.when(a == b, a.cast("string")).otherwise(F.concat(a.cast("string"), F.lit("–"), b.cast("string")))), ", ")


def initials(c: Column) -> Column:
    return F.array_join(F.transform(F.slice(F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != ""), 1, 2), lambda w: F.upper(F.substring(w, 1, 1))), "")


def channels(hex_colour: Column) -> Column:
    """[r, g, b] of '#rrggbb'."""
    h = F.regexp_replace(hex_colour, "^#", "")
    return F.array(*[F.conv(F.substring(h, i, 2), 16, 10).try_cast("int") for i in (1, 3, 5)])


def mixed(hex_colour: Column, to: int, amount: float) -> Column:
    """A colour moved by a share towards white (to=255) or black (to=0)."""
    step = lambda c: F.lpad(F.lower(F.hex(F.floor(c + (to - c) * amount + 0.5).cast("long"))), 2, "0")
    return F.concat(F.lit("#"), F.array_join(F.transform(channels(hex_colour), step), ""))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def nth_random(seed: Column, n: Column) -> Column:
    """The n-th number (from 1) that :func:`seeded_random` gives, as an expression."""
    mask = 0xFFFFFFFF

    def times(a: Column, b: Column) -> Column:
        # 32-bit product from halves, which fit in a long
        return ((a.bitwiseAND(0xFFFF) * b) + F.shiftleft((F.shiftright(a, 16) * b).bitwiseAND(0xFFFF), 16)).bitwiseAND(mask)

    start = (seed.cast("long") + n.cast("long") * 0x6D2B79F5).bitwiseAND(mask)
    one = bound(start, lambda a: times(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(1)))
    two = bound(one, lambda t: (t + times(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(61))).bitwiseAND(mask).bitwiseXOR(t))
    return bound(two, lambda t: t.bitwiseXOR(F.shiftright(t, 14)) / 4294967296)


def seeded_random(seed: int):
    """Function that gives the next number in [0, 1): the public-domain generator mulberry32, whose numbers must be the same on every machine."""
    state = seed & 0xFFFFFFFF

    def draw() -> float:
        nonlocal state
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        t = (state ^ state >> 15) * (1 | state) & 0xFFFFFFFF
        t = (t + ((t ^ t >> 7) * (61 | t) & 0xFFFFFFFF) & 0xFFFFFFFF) ^ t
        return ((t ^ t >> 14) & 0xFFFFFFFF) / 4294967296

    return draw
