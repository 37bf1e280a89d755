"""Rows of delimited text that fail to parse, told apart from the valid ones with the reason.

One anchored pattern per schema takes whole rows. Only what fails it goes
through patterns of the first 1, 2, ... fields, which name the first broken one.
All of it is regular expressions inside one projection: no shuffle, no Python.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BAD = r"\p{Cc}�"
#: Blanks as in other text: Java's, and the no-break space; within a line, and anywhere.
_INLINE, _BLANK = r"[ \t\x0b\f\u00a0]", r"[\s\u00a0]"


@dataclass(frozen=True)
class Field:
    """A field's name and its content as it may stand, without outer blanks, in an unquoted and in a quoted cell."""

    name: str
    plain: str
    quoted: str

    @property
    def cell(self) -> str:
        return rf"(?:{_INLINE}*+{self.plain}{_INLINE}*+|\"{_BLANK}*+{self.quoted}{_BLANK}*+\")"


def number(name: str) -> Field:
    """A positive integer."""
    return Field(name, r"0*+[1-9][0-9]*+", r"0*+[1-9][0-9]*+")


def numbered_name(name: str) -> Field:
    """Letters (with - or ' inside), underscore, positive integer."""
    p = r"[\p{L}\p{M}]++(?:[-'][\p{L}\p{M}]++)*+_0*+[1-9][0-9]*+"
    return Field(name, p, p)


def free(name: str) -> Field:
    """Any text without control or replacement characters; lines may break inside quotes."""
    return Field(name, rf"[^\",{_BAD}]*", rf"(?:[^\"{_BAD}]++|\"\"|\r?\n)*+")


def filled(name: str) -> Field:
    """As free text, but not blank."""
    return Field(name, rf"(?=[^\",]*[^\s\u00a0\",])[^\",{_BAD}]*", rf"(?=[^\s\u00a0\"]|\"\")(?:[^\"{_BAD}]++|\"\"|\r?\n)*+")


def senses(name: str) -> Field:
    """Text in which at least one line starts with a number, a full stop and something after it."""
    line = r"[^\S\n]*[0-9]++\.[^\S\n]*[^\s\"]"
    return Field(name, rf"(?={line})[^\",{_BAD}]*", rf"(?=(?:(?:[^\"\n]++|\"\")*+\n)*?{line})(?:[^\"{_BAD}]++|\"\"|\r?\n)*+")


@dataclass(frozen=True)
class Schema:
    """The fields of one kind of row."""

    fields: tuple[Field, ...]

    @property
    def row(self) -> str:
        return r"\A" + ",".join(f.cell for f in self.fields) + r"\r?\z"

    def prefix(self, k: int) -> str:
        return r"\A" + ",".join(f.cell for f in self.fields[:k]) + r"(?=,|\r?\z)"


#: A well-formed quoted cell, from one delimiter to the next.
_QUOTED_CELL = r"(?<=\A|,)\"[^\"]*+(?:\"\"[^\"]*+)*+\"(?=,|\r?\z)"


def diagnose(raw: Column, schema: Schema) -> Column:
    """struct(reason, field): reason is null for a valid row, else 'quoting', 'columns' or 'value', in this order.

    field is the name of the first broken field (null if all fields are in order and more follow).
    A quote may open only at a cell's start; elsewhere in an unquoted cell, after the
    closing one, or never closed, it is a 'quoting' failure. A null row has no cells: 'columns'.
    """
    text = F.coalesce(raw, F.lit(""))
    outer = F.regexp_replace(text, _QUOTED_CELL, "q")
    cells = F.length(outer) - F.length(F.replace(outer, F.lit(","), F.lit(""))) + 1
    first = reduce(lambda rest, k: F.when(~text.rlike(schema.prefix(k)), F.lit(schema.fields[k - 1].name)).otherwise(rest), range(len(schema.fields), 0, -1), F.lit(None).cast("string"))
    reason = F.when(outer.contains('"'), "quoting").when(raw.isNull() | (cells != len(schema.fields)), "columns").otherwise("value")
    return F.when(raw.isNotNull() & text.rlike(schema.row), F.struct(F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("field"))).otherwise(
        F.struct(reason.alias("reason"), first.alias("field"))
    )


def split_rows(df: DataFrame, raw: str, kind: str, schemas: dict[str, Schema], reason: str = "reason", field: str = "field") -> DataFrame:
    """df with the columns ``reason`` and ``field`` of :func:`diagnose`, by the schema that ``kind`` names.

    Rows of an unknown or null kind have the reason 'columns'. Every row of df stays, repeated ones too;
    clashing names raise ValueError.
    """
    if clash := {reason, field} & set(df.columns):
        raise ValueError(f"columns clash with outputs: {sorted(clash)}")
    unknown = F.struct(F.lit("columns").alias("reason"), F.lit(None).cast("string").alias("field"))
    verdict = reduce(lambda rest, k: F.when(F.col(kind) == k, diagnose(F.col(raw), schemas[k])).otherwise(rest), schemas, unknown)
    return df.withColumn("__v", verdict).select(*df.columns, F.col("__v.reason").alias(reason), F.col("__v.field").alias(field))


def cells(raw: Column, schema: Schema) -> Column:
    """struct of the fields of a valid row: trimmed, unquoted, '' as null."""
    groups = r"\A" + ",".join(f"({f.cell})" for f in schema.fields) + r"\r?\z"

    def value(k: int) -> Column:
        c = F.regexp_replace(F.regexp_extract(raw, groups, k + 1), rf"\A{_BLANK}++|{_BLANK}++\z", "")
        c = F.when(c.startswith('"'), F.replace(F.substr(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c)
        c = F.regexp_replace(c, rf"\A{_BLANK}++|{_BLANK}++\z", "")
        return F.when(c != "", c).alias(schema.fields[k].name)

    return F.struct(*[value(k) for k in range(len(schema.fields))])


#: The row kinds of the reference data's two feeds.
FEEDS = {
    "person_relationship": Schema((number("number"), free("chapter"), numbered_name("source"), free("type"), numbered_name("target"), free("note"))),
    "hebrew_strongs": Schema((number("number"), filled("word"), senses("gloss"))),
}
