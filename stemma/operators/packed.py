"""Several values packed in one field, with inconsistent delimiters and quoting, to one value per row.

Ordinary characters are masked, a stretch at a time, by what they begin: a whole
value, a bare number, another word, a quotation. What is left is the field's
skeleton: the delimiters, each with the blanks around it and what follows it, in
order of first appearance, so that long and short fields of one style share it.
For each distinct skeleton a rule decides which delimiters separate values and
which belong to them; the rules are joined back (broadcast while they are few)
and give the positions at which the field is cut. Masks are made once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.util import broadcast_if_small, cut

BLANK = r"[\s\u00a0\u2007\u202f\u3000]"
_NEWLINE = r"[\t\r\n\x0b\x0c\u0085\u2028\u2029]"
#: Stands for a quoted stretch in a masked field (private use area).
SLOT = chr(0xE000)
#: Characters that may separate, and what stands for them inside quotes.
_PLAIN = "<,;|/&+·、，；• \t\r\n\x0b\x0c" + "".join(map(chr, (0x85, 0xA0, 0x2028, 0x2029, 0x3000)))
_HIDDEN = "".join(chr(0xE001 + i) for i in range(len(_PLAIN)))
_QUOTED = (
    r"\"[^\"]*+(?:\"\"[^\"]*+)*+\""
    r"|“[^”]*+”"
    rf"|(?<=[\[{{(,;|]|[\[{{(,;|]{BLANK})'[^']*+'(?={BLANK}*+[\]}})),;|])"
)
#: The separators a rule may use, as they stand in a skeleton and as a pattern. Blanks and line breaks have patterns of their own.
SEPARATORS = {
    ",": ",", ";": ";", "|": r"\|", "/": "/", "&": "&", "+": r"\+", "·": "·", "、": "、", "，": "，", "；": "；", "•": "•", "⏎": "<br>", "∧": rf"(?<={BLANK})and(?={BLANK})",
}
#: What a masked stretch begins: a whole value (a name and a number), a number alone, another word.
VALUE, NUMBER, WORD = "ᐯ", "ᐁ", "ᐃ"
_GAP = rf"\s\u00a0\u2007\u202f\u3000{''.join(k for k in SEPARATORS)}"
_START = rf"(?<![^{_GAP}])"
#: Between the tokens of a skeleton.
_END = "\x1f"


def _unwrap(c: Column) -> Column:
    """Without outer blanks, and without one pair of brackets around the whole."""
    strip = lambda x: F.regexp_replace(x, rf"^{BLANK}++|{BLANK}++$", "")
    c = strip(c)
    return F.when(F.substring(c, 1, 1).isin("[", "{", "(") & c.rlike(r"(?s)^(?:\[.*\]|\{.*\}|\(.*\))$"), strip(F.substr(c, F.lit(2), F.length(c) - 2))).otherwise(c)


def _skeleton(field: Column, quotes: Column) -> Column:
    """The distinct transitions (delimiters and blanks, and what begins after them) of a field, in order of first appearance; '' if there are none."""
    s = F.when(quotes, F.regexp_replace(field, _QUOTED, SLOT)).otherwise(field)
    s = F.regexp_replace(F.replace(s, F.lit("<br>"), F.lit("⏎")), SEPARATORS["∧"], "∧")
    s = F.regexp_replace(s, rf"{_START}\p{{N}}?\p{{L}}++(?=[. ]\p{{N}})[^{_GAP}]*+", VALUE)
    s = F.regexp_replace(s, rf"{_START}\p{{N}}[^{_GAP}]*+", NUMBER)
    s = F.regexp_replace(s, rf"[^{_GAP}{VALUE}{NUMBER}{SLOT}]++", WORD)
    s = F.regexp_replace(F.regexp_replace(s, rf"{_NEWLINE}++", "¶"), rf"{BLANK}++", "_")
    runs = f"{VALUE}{NUMBER}{WORD}{SLOT}"
    tokens = F.array_distinct(F.regexp_extract_all(s, F.lit(f"([^{runs}]++[{runs}]?)"), 1))
    # a gap of any length says as much as its repeating part
    return F.array_join(F.array_distinct(F.transform(tokens, lambda t: F.regexp_replace(t, r"(.{1,4}?)\1++", "$1"))), _END)


def _rule(skeleton: Column) -> Column:
    """The splitting pattern of a skeleton; one that never matches if nothing in it separates.

    A delimiter separates if a whole value, a word or a quotation comes after it somewhere. One that only comes before bare
    numbers belongs to the values, if another one separates ('Gan 1:1,3; Tor 2:4': the comma is part of a value); if none
    does, it separates after all. A line break always separates, a blank only before a whole value or a quotation.
    """
    tokens = F.split(skeleton, _END)
    has = lambda test: F.exists(tokens, test)
    # a delimiter with nothing after it (the field's end, or other delimiters) decides nothing
    before = lambda k, runs: has(lambda t: t.contains(k) & t.rlike(f"[{runs}]$"))
    strong = {k: before(k, VALUE + WORD + SLOT) for k in SEPARATORS}
    line = has(lambda t: t.contains("¶"))
    blank = has(lambda t: t.isin(f"_{VALUE}", f"_{SLOT}"))
    some = line | blank
    for c in strong.values():
        some = some | c
    parts = []
    for k, p in SEPARATORS.items():
        there = skeleton.contains(k)
        only_numbers = before(k, NUMBER) & ~strong[k]
        parts.append(F.when(there & ~(only_numbers & some), F.lit(p)))
    delimiters = F.concat_ws("|", *parts)
    whole = F.concat_ws(
        "|",
        # blanks around a delimiter go with it, as do empty slots
        F.when(delimiters != "", F.concat(F.lit(f"{BLANK}*+(?:(?:"), delimiters, F.lit(f"){BLANK}*+)++"))),
        F.when(line, F.lit(rf"[ \u00a0\u2007\u202f\u3000]*+{_NEWLINE}{BLANK}*+")),
        F.when(blank, F.lit(rf"(?<=[\p{{L}}\p{{N}}.\"”'{SLOT}]){BLANK}++(?=\p{{N}}?\p{{L}}++[. ]\p{{N}}|[\"“'{SLOT}])")),
    )
    return F.when(whole == "", F.lit("(?!)")).otherwise(whole)


def unpack(df: DataFrame, column: str, keep: Sequence[str] = (), pos: str = "pos", value: str = "value", rules_limit: int = 20_000, rule=_rule) -> DataFrame:
    """One row per value of ``column``: the kept columns, ``pos`` from 0, ``value``.

    - null, empty, blank and separator-only fields give no row; empty slots don't count in pos;
    - a quoted stretch is one value and doubled quotes in it read as one; quotes that are never
      closed are taken as ordinary characters and stripped at a value's ends;
    - outer blanks, quotes and brackets are dropped, anything else is kept as written;
    - repeated rows each give their values; columns of df named like the outputs are only lost if not kept
      (a kept column that clashes with ``pos`` or ``value`` raises ValueError).

    ``rule`` gives the splitting pattern of a skeleton. Fields without any gap need no rule.
    """
    if clash := {pos, value} & set(keep):
        raise ValueError(f"kept columns clash with outputs: {sorted(clash)}")
    field = F.col("__f")
    base = df.select(*keep, _unwrap(F.col(column).cast("string")).alias("__f")).filter(F.length("__f") > 0)
    base = base.withColumn("__q", field.rlike("[\"“']"))
    base = cut(base.withColumn("__s", F.when(field.rlike(f"[{_GAP}<]"), _skeleton(field, F.col("__q"))).otherwise("")))
    rules = cut(base.select("__s").distinct().withColumn("__r", rule(F.col("__s"))))
    ruled = base.join(broadcast_if_small(rules, rules_limit), "__s")

    # inside quotes, separators change places with private characters while the field is split
    outside = F.split("__f", F.lit(_QUOTED), -1)
    quoted = F.regexp_extract_all("__f", F.lit(f"({_QUOTED})"), 1)
    hidden = F.array_join(F.zip_with(outside, quoted, lambda o, q: F.concat(o, F.coalesce(F.translate(q, _PLAIN, _HIDDEN), F.lit("")))), "")
    slots = F.transform(F.split(hidden, F.col("__r"), -1), lambda v: _bare(F.translate(v, _HIDDEN, _PLAIN)))
    plain = F.when(F.col("__s") == "", F.array("__f")).otherwise(F.split("__f", F.col("__r"), -1))
    bracketed = F.when(field.rlike(r"[\[{(]"), F.transform(plain, _unwrap)).otherwise(plain)
    values = F.when(F.col("__q"), slots).otherwise(bracketed)
    return ruled.select(*keep, F.posexplode(F.filter(values, lambda v: v != "")).alias(pos, value))


def _bare(v: Column) -> Column:
    v = _unwrap(v)
    inner = F.when(
        v.rlike(r"(?s)^\".*\"$") & (F.length(v) > 1), F.replace(F.substr(v, F.lit(2), F.length(v) - 2), F.lit('""'), F.lit('"'))
    ).when(v.rlike(r"(?s)^(?:“.*”|'.*')$") & (F.length(v) > 1), F.substr(v, F.lit(2), F.length(v) - 2)).otherwise(
        F.regexp_replace(v, r"^[\"“”]++|[\"“”]++$", "")
    )
    return F.regexp_replace(inner, rf"^{BLANK}++|{BLANK}++$", "")
