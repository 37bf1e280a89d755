"""Tagged text: passage groups, milestone editions and stateful editions, to verses with words and their ids.

A file is split into tokens inside the JVM and exploded; state (the open book and chapter) is a forward fill over the
token's place. Only the walk that gives the tagged words' positions runs in Python, on Arrow batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemma.functions import text as T
from stemma.util import ship

_ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'"}
_TOKEN = re.compile(r"<[^>]*>|&(?:amp|lt|gt|quot|apos);|[^<&]|&|<")
_SPACE = re.compile(r"[ \t\n\x0b\f\r\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]")
_IDS = re.compile(r"\b(?:lemma|s)=\"([^\"]*)\"")
VERSE = "file string, translation_id string, book string, chapter int, verse int, verse_end int, osis_id string, text string, lemmas array<string>, align string, wj string, seq long"


def _clean(ids: str, strip: bool) -> list[str]:
    found = [re.sub(r"(?i)^(?:strong:|lemma\.)", "", x).upper() for x in ids.split()]
    found = [x for x in found if re.fullmatch(r"[HG]\d+[A-Z]?", x)]
    return [re.sub(r"^([HG])0+(?=\d)", r"\1", x) if strip else x for x in found]


def walk(xml: str, inline: tuple[str, ...] = ("w",), strip_zeros: bool = True, quoted: str = "wj") -> tuple[str, list[list], list[list[int]]]:
    """(text, [[start, end, 'ids'], ...], [[start, end], ...]): the text with blanks collapsed, where its tagged words lie, and where the ``quoted`` element does.

    Entities are decoded once. Neighbouring characters of equal ids make one span; blanks at a span's ends are not part of it.
    """
    out: list[str] = []
    tags: list[str] = []
    marks: list[bool] = []
    stack: list[str] = []
    deep = 0
    for t in _TOKEN.findall(xml):
        if t[0] == "<" and len(t) > 1:
            name = re.match(r"</?\s*([\w:]+)", t)
            tag = name[1] if name else ""
            if tag == "w":
                if t[1] == "/":
                    stack[-1:] = []
                elif not t.endswith("/>"):
                    m = _IDS.search(t)
                    stack.append(" ".join(dict.fromkeys(_clean(m[1], strip_zeros))) if m else "")
            elif tag == quoted and not t.endswith("/>"):
                deep = max(0, deep - 1) if t[1] == "/" else deep + 1
            if tag in inline or tag == quoted:
                continue
            t = " "
        c = _ENTITIES.get(t, t)
        if _SPACE.match(c):
            if not out or out[-1] == " ":
                continue
            c = " "
        out.append(c)
        tags.append(stack[-1] if stack else "")
        marks.append(deep > 0)
    while out and out[-1] == " ":
        out.pop()
        tags.pop()
        marks.pop()
    text = "".join(out)

    def spans(values: list) -> Iterator[tuple[int, int, object]]:
        at = 0
        while at < len(values):
            end = at
            while end < len(values) and values[end] == values[at]:
                end += 1
            a, b = at, end
            while a < b and text[a] == " ":
                a += 1
            while b > a and text[b - 1] == " ":
                b -= 1
            if values[at] and a < b:
                yield a, b, values[at]
            at = end

    return text, [[a, b, v] for a, b, v in spans(tags)], [[a, b] for a, b, _ in spans(marks)]


def _walked(batches: Iterator[pd.DataFrame], inline: tuple[str, ...], strip_zeros: bool) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for xml, text in zip(b["xml"], b["text"], strict=True):
            seen, align, wj = walk(xml, inline, strip_zeros)
            same = seen == text  # where decoding once and in sequence differ, positions would be wrong
            rows.append((json.dumps(align, ensure_ascii=False) if align and same else None, json.dumps(wj) if wj and same else None))
        b = b.drop(columns=["xml"])
        b["align"], b["wj"] = [r[0] for r in rows], [r[1] for r in rows]
        yield b[["file", "translation_id", "book", "chapter", "verse", "verse_end", "osis_id", "text", "lemmas", "align", "wj", "seq"]]


def _aligned(verses: DataFrame, inline: tuple[str, ...], strip_zeros: bool) -> DataFrame:
    ship(verses.sparkSession)
    return verses.mapInPandas(lambda it: _walked(it, inline, strip_zeros), VERSE)


def milestones(files: DataFrame, translation: str, value: str = "value") -> DataFrame:
    """Verses of an edition that marks where verses start (sID) and end (eID): the text from a start to the end of the same id, which must come before the next start.

    Attributes in any order; ids of three parts; verses without text are dropped.
    """
    parts = _told_apart(files, value).select("file", F.posexplode(F.split(value, r"(?=<verse\b[^>]*\bsID=)")).alias("i", "s"))
    start = r"(?s)^<verse\b([^>]*)>"
    tag = F.regexp_extract("s", start, 1)
    rows = parts.select("file", "i", "s", F.regexp_extract(tag, r"\bosisID=\"([^\"]*)\"", 1).alias("osis_id"), F.regexp_extract(tag, r"\bsID=\"([^\"]*)\"", 1).alias("sid"))
    pieces = F.split("s", r"(?=<verse\b[^>]*\beID=)")
    body = F.regexp_replace(F.get(pieces, F.lit(0)), start, "")
    end = F.regexp_extract(F.get(pieces, F.lit(1)), r"^<verse\b[^>]*\beID=\"([^\"]*)\"", 1)
    rows = rows.filter((F.col("sid") != "") & (end == F.col("sid"))).withColumn("xml", T.remove_elements(body, "note", "title"))
    bare = F.regexp_replace("osis_id", r"\.0+(?=\d)", ".")
    at = lambda k: F.split_part(bare, F.lit("."), F.lit(k))
    verses = rows.filter(F.size(F.split("osis_id", r"\.")) == 3).select(
        "file", F.lit(translation).alias("translation_id"), at(1).alias("book"), at(2).try_cast("int").alias("chapter"), at(3).try_cast("int").alias("verse"), F.lit(None).cast("int").alias("verse_end"), bare.alias("osis_id"), T.osis_text(F.col("xml")).alias("text"), T.lemmas(F.col("xml")).alias("lemmas"), F.col("i").cast("long").alias("seq"), "xml",
    )
    return _aligned(verses.filter("text <> '' and chapter is not null and verse is not null"), ("w", "transChange", "divineName", "seg", "q"), True).drop("file")


def _told_apart(files: DataFrame, value: str) -> DataFrame:
    """file, value: files by their path, else by their place in the table; equal files are two."""
    file = F.col("path") if "path" in files.columns else F.monotonically_increasing_id().cast("string")
    return files.select(file.alias("file"), value)  # a step of its own, before rows are exploded


def stateful(files: DataFrame, translation: str, codes: dict[str, str], value: str = "value") -> DataFrame:
    """Verses of an edition whose tokens <book>, <c>, <v>, <ve> set what is open. Books without a code are skipped.

    A verse ends at a <ve> that follows it directly; a book or chapter in between cancels it. 'id="15-16"' is a range. Records of
    one key that follow each other ('3a', '3b') are put together.
    """
    token = r"(?=<(?:book|c|v|ve)\b)"
    t = _told_apart(files, value).select("file", F.posexplode(F.split(value, token)).alias("i", "s"))
    kind = F.regexp_extract("s", r"^<(book|c|ve|v)\b", 1)
    ident = F.regexp_extract("s", r"^<\w+\b[^>]*?\bid=\"([^\"]*)\"", 1)
    w = Window.partitionBy("file").orderBy("i")
    far = w.rowsBetween(Window.unboundedPreceding, 0)
    code = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    rows = t.withColumns({"kind": kind, "ident": ident})
    rows = rows.withColumns({"code": F.last(F.when(F.col("kind") == "book", F.col("ident")), ignorenulls=True).over(far), "ends": F.coalesce(F.lead("kind").over(w) == "ve", F.lit(False)), "book_at": F.last(F.when(F.col("kind") == "book", F.col("i")), ignorenulls=True).over(far)})
    rows = rows.withColumn("chapter", F.last(F.when(F.col("kind") == "c", F.col("ident").try_cast("int")), ignorenulls=True).over(Window.partitionBy("file", "book_at").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    v = rows.filter("kind = 'v' and ends").withColumn("book", F.try_element_at(code, F.col("code")))
    number = F.regexp_extract("ident", r"^(\d+)", 1).try_cast("int")
    end = F.regexp_extract("ident", r"^\d+[a-z]?\s*-\s*(\d+)", 1).try_cast("int")
    v = v.withColumns({"verse": number, "verse_end": F.when(end > number, end), "xml": T.remove_elements(F.regexp_replace("s", r"^<v\b[^>]*>", ""), "f", "x", "note")})
    v = v.filter("book is not null and chapter is not null and verse is not null")
    verses = v.select(
        "file", F.lit(translation).alias("translation_id"), "book", "chapter", "verse", "verse_end", F.concat_ws(".", "book", "chapter", "verse").alias("osis_id"), T.plain_text(F.col("xml"), ("w", "wj")).alias("text"), T.lemmas(F.col("xml"), ("lemma", "s"), False).alias("lemmas"), F.col("i").cast("long").alias("seq"), "xml",
    )
    return merge_segments(_aligned(verses.filter("text <> ''"), ("w", "wj"), False))


def merge_segments(verses: DataFrame) -> DataFrame:
    """Records of one key that follow each other as one: texts joined by a blank, ids united, positions moved, the furthest end.

    Runs are islands of equal keys in the order of seq within a book of a file (column ``file``, which isn't kept).
    """
    w = Window.partitionBy("file", "translation_id", "book").orderBy("seq")
    run = verses.withColumn("new", F.coalesce((F.col("osis_id") != F.lag("osis_id").over(w)).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = "array<struct<start:int,end:int,ids:array<string>>>"
    ranges = "array<struct<start:int,end:int>>"
    parts = F.array_sort(F.collect_list(F.struct("seq", "text", "lemmas", T.spans(F.col("align")).alias("align"), T.ranges(F.col("wj")).alias("wj"), "verse_end")))
    g = run.groupBy("file", "translation_id", "book", "chapter", "verse", "osis_id", "run").agg(parts.alias("p"), F.min("seq").alias("first"))
    zero = F.struct(F.lit("").alias("text"), F.array().cast(spans).alias("align"), F.array().cast(ranges).alias("wj"))

    def add(acc, x):
        at = F.when(acc["text"] == "", 0).otherwise(F.length(acc["text"]) + 1)
        moved = F.transform(x["align"], lambda s: F.struct((s["start"] + at).alias("start"), (s["end"] + at).alias("end"), s["ids"].alias("ids")))
        shifted = F.transform(x["wj"], lambda s: F.struct((s["start"] + at).alias("start"), (s["end"] + at).alias("end")))
        text = F.when(acc["text"] == "", x["text"]).otherwise(F.concat(acc["text"], F.lit(" "), x["text"]))
        return F.struct(text.alias("text"), F.concat(acc["align"], moved).alias("align"), F.concat(acc["wj"], shifted).alias("wj"))

    one = g.withColumn("m", F.aggregate("p", zero, add))
    return one.select("translation_id", "book", "chapter", "verse", F.array_max(F.transform("p", lambda x: x["verse_end"])).alias("verse_end"), "osis_id", F.col("m.text").alias("text"), F.array_distinct(F.flatten(F.transform("p", lambda x: x["lemmas"]))).alias("lemmas"), F.col("m.align").alias("align"), F.col("m.wj").alias("wj"), F.col("first").alias("seq"))


def passage_groups(files: DataFrame, codes: dict[str, str], value: str = "value") -> DataFrame:
    """group_id, ord, osis, part of <Passage> elements with <Verse HEB=...> (OT) and <Verse GRK=...> (NT) whose text is 'BOOK c:v', a range by its start; unknown books are dropped."""
    groups = files.select(F.posexplode(F.regexp_extract_all(value, F.lit(r"(?s)<Passage\b[^>]*>(.*?)</Passage>"), 1)).alias("group_id", "p"))
    v = groups.select("group_id", F.posexplode(F.regexp_extract_all("p", F.lit(r"(?s)(<Verse\b[^>]*>[^<]*)</Verse>"), 1)).alias("ord", "v"))
    ref = r"(?s)>\s*(\w+)\s+(\d+):(\d+)"
    book = F.try_element_at(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv]), F.regexp_extract("v", ref, 1))
    part = F.when(F.col("v").rlike(r"\bHEB="), "OT").when(F.col("v").rlike(r"\bGRK="), "NT")
    return v.select("group_id", "ord", F.concat_ws(".", book, F.regexp_extract("v", ref, 2), F.regexp_extract("v", ref, 3)).alias("osis"), part.alias("part"), book.alias("b")).filter("b is not null").drop("b")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """value, path of each file; an edition is best kept as one file per book, so that books are read in parallel."""
    return spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
